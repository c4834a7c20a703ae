"""Scalar functions on texts, scores, names and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import NEGATIONS, PERSON_PRONOUNS, PRONOUNS, STOPWORDS_RU
from ..functions import scalars as sc
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators.ordered import with_scalars
from ._sql import AWL, N, TTR, band, clamp, count_of, listed, r
from .registry import Registry, r6

registry = Registry()
q = registry.query
ID = ["session_id", "segment_idx"]
EN = {"i_pronoun": ["i", "me", "my"], "we_pronoun": ["we", "us", "our"], "you_pronoun": ["you", "your"]}
EN_STOP = ["the", "of", "in", "and", "with", "is", "that", "on", "que", "la", "de", "et"]
KEYWORDS = ["the", "that", "with", "and", "never", "la"]


def _text(key, needs, select, **cols):
    """One row per segment with computed columns."""
    @q(key, needs, f"SELECT session_id, segment_idx, {select} FROM toks")
    def run(t):
        return t.segments.select(*ID, *[c().alias(n) for n, c in cols.items()])
    return run


_text("word_count", "tokens", f"{N} AS word_count", word_count=lambda: tx.word_count("text"))
_text("speech_rate", "tokens", r("CASE WHEN duration > 0 THEN len(w) / duration ELSE 0 END", "speech_rate"),
      speech_rate=lambda: F.round(tx.speech_rate("text", "duration"), 6))
_text("articulation_rate", "tokens",
      r("CASE WHEN duration * (1 - score) > 0 THEN len(w) / (duration * (1 - score)) ELSE 0 END", "articulation_rate"),
      articulation_rate=lambda: F.round(tx.articulation_rate("text", "duration", "score"), 6))
_text("type_token_ratio", "tokens", r(TTR, "type_token_ratio"), type_token_ratio=lambda: F.round(tx.type_token_ratio("text"), 6))
_text("unique_tokens", "tokens", "CAST(len(list_distinct(lw)) AS INTEGER) AS unique_tokens", unique_tokens=lambda: tx.unique_tokens("text"))
_text("char_count", "tokens", "CAST(length(text) AS INTEGER) AS char_count", char_count=lambda: tx.char_count("text"))
_text("pronoun_count", "tokens", f"{listed(PRONOUNS['en'])} AS pronouns_en, {listed(PRONOUNS['ru'])} AS pronouns_ru",
      pronouns_en=lambda: tx.pronoun_count("text", "en"), pronouns_ru=lambda: tx.pronoun_count("text", "ru"))
_text("negation_count", "tokens", f"{listed(NEGATIONS['en'])} AS negations_en, {listed(NEGATIONS['ru'])} AS negations_ru",
      negations_en=lambda: tx.negation_count("text", "en"), negations_ru=lambda: tx.negation_count("text", "ru"))
_text("person_pronouns", "tokens",
      ", ".join([*(f"{listed(w)} AS {k}" for k, w in PERSON_PRONOUNS.items()), *(f"{listed(w)} AS {k}_en" for k, w in EN.items())]),
      **{k: (lambda w=w: tx.listed_count("text", w)) for k, w in PERSON_PRONOUNS.items()},
      **{f"{k}_en": (lambda w=w: tx.listed_count("text", w)) for k, w in EN.items()})
_text("stopword_ratio", "tokens",
      f"{listed(STOPWORDS_RU)} AS stopwords_ru, {listed(EN_STOP)} AS stopwords, " + r(f"{listed(EN_STOP)} / (len(w) + 1e-10)", "stopword_ratio"),
      stopwords_ru=lambda: tx.stopword_count("text"), stopwords=lambda: tx.stopword_count("text", EN_STOP),
      stopword_ratio=lambda: F.round(tx.ratio_of_tokens(tx.stopword_count("text", EN_STOP), "text"), 6))
_text("complex_word_ratio", "tokens",
      "CAST(len(list_filter(w, lambda x: length(x) > 6)) AS INTEGER) AS complex_words, "
      + r("len(list_filter(w, lambda x: length(x) > 6)) / (len(w) + 1e-10)", "complex_word_ratio"),
      complex_words=lambda: tx.complex_word_count("text"),
      complex_word_ratio=lambda: F.round(tx.ratio_of_tokens(tx.complex_word_count("text"), "text"), 6))
_text("avg_word_length", "tokens", r(AWL, "avg_word_length"), avg_word_length=lambda: F.round(tx.avg_word_length("text"), 6))
_text("sentence_count", "tokens", f"{count_of('[.!?]')} + 1 AS sentences", sentences=lambda: tx.sentence_count("text"))
_text("punctuation_counts", "tokens",
      f"{count_of('[?]')} AS qmarks, {count_of('!')} AS exclamations, "
      + r(f"{count_of('[!?.,;:]')} / CAST(greatest(1, length(text)) AS DOUBLE)", "punctuation_ratio"),
      qmarks=lambda: tx.marks("text", r"\?"), exclamations=lambda: tx.marks("text", "!"),
      punctuation_ratio=lambda: F.round(tx.punctuation_ratio("text"), 6))
_WT = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_text("lexical_diversity", "tokens",
      r(f"CASE WHEN len({_WT}) > 0 THEN CAST(len(list_distinct({_WT})) AS DOUBLE) / len({_WT}) ELSE 0 END", "diversity") + ", "
      + r(f"CASE WHEN len({_WT}) > 0 THEN 1 - CAST(len(list_distinct({_WT})) AS DOUBLE) / len({_WT}) ELSE 1 END", "repetition"),
      diversity=lambda: F.round(tx.lexical_diversity("text"), 6),
      repetition=lambda: F.round(1 - tx.lexical_diversity("text"), 6))
_text("bag_of_words", "tokens",
      ", ".join([f"CAST(len(list_filter(lw, lambda x: x = '{k}')) AS INTEGER) AS n_{k}" for k in KEYWORDS]
                + [f"CASE WHEN list_contains(lw, '{k}') THEN 1 ELSE 0 END AS has_{k}" for k in KEYWORDS]),
      **{f"n_{k}": (lambda i=i: F.get(tx.bag_of_words("text", KEYWORDS), F.lit(i))) for i, k in enumerate(KEYWORDS)},
      **{f"has_{k}": (lambda i=i: F.get(tx.bag_of_words("text", KEYWORDS, counts=False), F.lit(i))) for i, k in enumerate(KEYWORDS)})


@q("clean_text", "", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[.,!?;:“”"''—–\-«»]', '', 'g'),
    '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ''), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '') AS cleaned FROM documents""")
def _(t):
    return t.table("documents").select("doc_id", tx.clean_text("text").alias("cleaned"))


@q("pause_ratio", "words", "SELECT session_id, segment_idx, " + r(
    "least(1, greatest(0, (max(duration) - sum(greatest(0, word_end - word_start))) / max(duration)))", "pause_ratio")
   + " FROM words GROUP BY session_id, segment_idx")
def _(t):
    words = F.transform(tx.tokens("text"), lambda w, i: F.struct(
        (F.col("start_time") + F.col("_slot") * i).alias("start"), (F.col("start_time") + F.col("_slot") * i + F.col("_slot") * 0.75).alias("end")))
    slotted = t.segments.where(tx.word_count("text") > 0).withColumn("_slot", F.col("duration") / tx.word_count("text"))
    return slotted.withColumn("words", words).select(*ID, r6(tx.pause_ratio("words", "start_time", "end_time"), "pause_ratio"))


@q("asr_confidence", "words", "SELECT session_id, segment_idx, " + r("coalesce(avg(word_score), 0)", "asr_conf_mean") + ", "
   + r("coalesce(stddev_samp(word_score), 0)", "asr_conf_std") + " FROM words GROUP BY session_id, segment_idx")
def _(t):
    return t.words.groupBy(*ID).agg(
        r6(F.coalesce(F.avg("word_score"), F.lit(0.0)), "asr_conf_mean"),
        r6(F.coalesce(F.stddev_samp("word_score"), F.lit(0.0)), "asr_conf_std"))


@q("segment_text_from_words", "tokens",
   "SELECT session_id, segment_idx, coalesce(nullif(array_to_string(w, ' '), ''), text) AS segment_text FROM toks")
def _(t):
    joined = F.array_join(tx.tokens("text"), " ")
    return t.segments.select(*ID, F.coalesce(F.nullif(joined, F.lit("")), "text").alias("segment_text"))


@q("format_time", "segments", """SELECT session_id, segment_idx,
    format('{:02d}:{:02d}', CAST(floor(start_time % 3600 / 60) AS BIGINT), CAST(floor(start_time % 60) AS BIGINT)) AS at_start,
    CASE WHEN start_time * 100 >= 3600 THEN format('{:02d}:{:02d}:{:02d}', CAST(floor(start_time * 100 / 3600) AS BIGINT),
        CAST(floor(CAST(floor(start_time * 100) AS BIGINT) % 3600 / 60) AS BIGINT), CAST(floor(start_time * 100) AS BIGINT) % 60)
    ELSE format('{:02d}:{:02d}', CAST(floor(start_time * 100 / 60) AS BIGINT), CAST(floor(start_time * 100) AS BIGINT) % 60) END AS at_long
    FROM segments""")
def _(t):
    return t.segments.select(*ID, sc.format_time("start_time").alias("at_start"),
                             sc.format_time(F.col("start_time") * 100).alias("at_long"))


@q("text_preview", "segments", """SELECT session_id, segment_idx, left(text, 100) AS preview_100,
    CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE left(text, 200) END AS preview_200 FROM segments""")
def _(t):
    return t.segments.select(*ID, sc.text_preview("text", 100).alias("preview_100"), sc.text_preview("text", 200, True).alias("preview_200"))


@q("pretty_feature_name", "", r"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '_sma3nz_amean'
        WHEN 1 THEN '_SMA3NZ' ELSE '_amean_' END AS feature FROM part)
    SELECT p_partkey, feature, trim(regexp_replace(regexp_replace(regexp_replace(replace(feature, '_', ' '),
        '\bsma3nz\b', '', 'gi'), '\bamean\b', 'avg', 'gi'), '\s+', ' ', 'g')) AS pretty FROM n""")
def _(t):
    suffix = F.when(F.col("p_size") % 3 == 0, "_sma3nz_amean").when(F.col("p_size") % 3 == 1, "_SMA3NZ").otherwise("_amean_")
    named = t.table("part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), suffix).alias("feature"))
    return named.select("p_partkey", "feature", sc.pretty_feature_name("feature").alias("pretty"))


@q("path_label", "listing", r"""SELECT listing_id, path, CAST(nullif(regexp_extract(path, '(?:^|/)([01])(?:/|$)', 1), '') AS INTEGER) AS label FROM listing""")
def _(t):
    return t.media_listing.select("listing_id", "path", sc.path_label("path").alias("label"))


@q("parse_feature_name", "", r"""WITH s AS (SELECT l_orderkey AS session_id, avg(l_quantity) AS audio_loudness_mean,
        max(l_tax) AS audio_jitter_local_max, min(l_discount) AS audio_f0_range_min FROM lineitem GROUP BY 1),
    u AS (UNPIVOT s ON audio_loudness_mean, audio_jitter_local_max, audio_f0_range_min INTO NAME feature VALUE value)
    SELECT session_id, regexp_extract(feature, '^audio_(.+)_(mean|std|median|min|max)$', 1) AS base_name,
        regexp_extract(feature, '^audio_(.+)_(mean|std|median|min|max)$', 2) AS stat, round(value, 6) AS value FROM u""")
def _(t):
    wide = t.table("lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(
        F.avg("l_quantity").alias("audio_loudness_mean"), F.max("l_tax").alias("audio_jitter_local_max"), F.min("l_discount").alias("audio_f0_range_min"))
    long = wide.unpivot(["session_id"], [c for c in wide.columns if c.startswith("audio_")], "feature", "value")
    rule = "^audio_(.+)_(mean|std|median|min|max)$"
    return long.select("session_id", F.regexp_extract("feature", rule, 1).alias("base_name"),
                       F.regexp_extract("feature", rule, 2).alias("stat"), r6("value"))


@q("sigmoid", "", "SELECT event_id, " + r("1 / (1 + exp(-((value - 50) / 25)))", "p") + " FROM events")
def _(t):
    return t.table("events").select("event_id", r6(sc.sigmoid((F.col("value") - 50) / 25), "p"))


@q("softmax", "vectors", """WITH e AS (SELECT frame_idx, unnest(list_transform(vec, lambda x: exp(x))) AS e,
    generate_subscripts(vec, 1) - 1 AS pos, list_sum(list_transform(vec, lambda x: exp(x))) AS total,
    vec[1] AS a, vec[2] AS b FROM vectors)
    SELECT frame_idx, pos, round(e / total, 6) AS p, round(1 / (1 + exp(a - b)), 6) AS p_two FROM e""")
def _(t):
    v = t.vectors.select("frame_idx", vec.softmax("vec").alias("s"), F.slice("vec", 1, 2).alias("two"))
    long = v.select("frame_idx", "two", F.posexplode("s").alias("pos", "p"))
    return long.select("frame_idx", F.col("pos").cast("long").alias("pos"), r6("p"), r6(vec.positive_probability("two"), "p_two"))


def _long(df, column, name="x"):
    return df.select("frame_idx", F.posexplode(column).alias("pos", name)).select("frame_idx", F.col("pos").cast("long").alias("pos"), r6(name))


@q("scale_and_clip", "vectors", """WITH l AS (SELECT frame_idx, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vectors),
    s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM l GROUP BY pos)
    SELECT frame_idx, l.pos, round(greatest(-10, least(10, (x - m) / CASE WHEN d = 0 THEN 1 ELSE d END)), 6) + CAST(0 AS DOUBLE) AS x FROM l JOIN s ON l.pos = s.pos""")
def _(t):
    from ..operators.series import vector_stats
    stats = vector_stats(t.vectors, [], "vec")
    return _long(with_scalars(t.vectors, stats), vec.scale_and_clip(F.col("vec"), F.col("vec_mean"), F.col("vec_std")))


@q("vector_mvn", "vectors", """WITH l AS (SELECT frame_idx, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vectors),
    s AS (SELECT pos, min(x) AS a, max(x) AS b FROM l GROUP BY pos)
    SELECT frame_idx, l.pos, round(CASE WHEN b = a THEN 0 ELSE (x - a) / (b - a) END, 6) AS x FROM l JOIN s ON l.pos = s.pos""")
def _(t):
    from ..operators.series import vector_stats
    stats = vector_stats(t.vectors, [], "vec")
    return _long(with_scalars(t.vectors, stats), vec.range_normalize(F.col("vec"), F.col("vec_min"), F.col("vec_max")))


@q("concat_vectors", "vectors", """WITH c AS (SELECT frame_idx, list_concat(vec[1:13], vec[14:64]) AS v FROM vectors)
    SELECT frame_idx, generate_subscripts(v, 1) - 1 AS pos, round(unnest(v), 6) + CAST(0 AS DOUBLE) AS x FROM c""")
def _(t):
    return _long(t.vectors, F.concat(F.slice("vec", 1, 13), F.slice("vec", 14, 51)))


_UNARY = ["mul", "add", "abs", "exp", "log", "sqrt", "pow", "dBp", "dBv", "norm_l2", "norm_max", "norm_range"]
_UNARY_SQL = {
    "mul": "x * 2", "add": "x + 2", "abs": "abs(x)", "exp": "exp(x)", "log": "ln(greatest(x, 1e-10))",
    "sqrt": "sqrt(greatest(x, 0))", "pow": "pow(greatest(x, 0), 2)", "dBp": "10 * log10(greatest(x, 1e-10))",
    "dBv": "20 * log10(greatest(x, 1e-10))", "norm_l2": "CASE WHEN n2 > 0 THEN x / n2 ELSE 0 END",
    "norm_max": "CASE WHEN nm > 0 THEN x / nm ELSE 0 END", "norm_range": "CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END",
}


@q("vector_ops", "vectors", """WITH s AS (SELECT frame_idx, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n2,
        list_max(list_transform(vec, lambda x: abs(x))) AS nm, list_min(vec) AS lo, list_max(vec) AS hi,
        list_sum(vec) AS total, list_sum(list_transform(vec, lambda x: x * x)) AS ssq,
        list_sum(list_transform(vec, lambda x: abs(x))) / len(vec) AS l1 FROM vectors),
    l AS (SELECT *, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM s)
    SELECT frame_idx, pos, """ + ", ".join(r(_UNARY_SQL[o], f"v_{o.lower()}") for o in _UNARY)
   + ", " + ", ".join([r("total", "r_sum"), r("ssq", "r_ssq"), r("l1", "r_l1"), r("sqrt(ssq / len(vec))", "r_l2"), r("lo", "r_min"), r("hi", "r_max")]) + " FROM l")
def _(t):
    red = {op: F.round(vec.reduce_vector("vec", op), 6).alias(f"r_{op}") for op in ("sum", "ssq", "l1", "l2", "min", "max")}
    zipped = F.arrays_zip(*[vec.unary("vec", op, 2.0).alias(f"v_{op.lower()}") for op in _UNARY])
    long = t.vectors.select("frame_idx", *red.values(), F.posexplode(zipped).alias("pos", "z"))
    return long.select("frame_idx", F.col("pos").cast("long").alias("pos"), *[f"r_{op}" for op in red],
                       *[r6(F.col("z").getItem(f"v_{op.lower()}"), f"v_{op.lower()}") for op in _UNARY])


_BIN = ["add", "sub", "mul", "div", "pow", "min", "max"]
_BIN_SQL = {"add": "x + y", "sub": "x - y", "mul": "x * y", "div": "CASE WHEN y = 0 THEN 0 ELSE x / y END", "pow": "pow(abs(x), abs(y))",
            "min": "least(x, y)", "max": "greatest(x, y)"}


@q("vector_binary_ops", "vectors", """WITH l AS (SELECT frame_idx, unnest(vec[1:32]) AS x, unnest(vec[33:64]) AS y,
    generate_subscripts(vec[1:32], 1) - 1 AS pos FROM vectors) SELECT frame_idx, pos, """
   + ", ".join(r(_BIN_SQL[o], f"b_{o}") for o in _BIN) + " FROM l")
def _(t):
    a, b = F.slice("vec", 1, 32), F.slice("vec", 33, 32)
    pos_a, pos_b = F.transform(a, lambda x: F.abs(x)), F.transform(b, lambda x: F.abs(x))
    zipped = F.arrays_zip(*[(vec.binary(pos_a, pos_b, op) if op == "pow" else vec.binary(a, b, op)).alias(op) for op in _BIN])
    long = t.vectors.select("frame_idx", F.posexplode(zipped).alias("pos", "z"))
    return long.select("frame_idx", F.col("pos").cast("long").alias("pos"), *[r6(F.col("z").getItem(op), f"b_{op}") for op in _BIN])


@q("top_k_indices", "vectors", """WITH l AS (SELECT frame_idx, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vectors),
    k AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY abs(x) DESC, pos) AS rank FROM l)
    SELECT frame_idx, rank, pos FROM k WHERE rank <= 5""")
def _(t):
    top = t.vectors.select("frame_idx", F.posexplode(vec.top_indices("vec", 5)).alias("r", "p"))
    return top.select("frame_idx", (F.col("r") + 1).cast("long").alias("rank"), F.col("p").cast("long").alias("pos"))


@q("frequency_scale", "", "WITH h AS (SELECT event_id, value * 10 + 30 AS hz FROM events) SELECT event_id, "
   + ", ".join([r("1127 * ln(1 + hz / 700)", "mel"), r("26.81 / (1 + 1960 / hz) - 0.53", "bark"), r("12 * log2(hz / 27.5)", "semitone"),
                r("hz", "hz_mel"), r("hz", "hz_bark"), r("hz", "hz_semitone")]) + " FROM h")
def _(t):
    h = t.table("events").select("event_id", (F.col("value") * 10 + 30).alias("hz"))
    scaled = h.select("event_id", *[sc_.alias(n) for n, sc_ in ((n, vec.hz_to("hz", n)) for n in ("mel", "bark", "semitone"))])
    return scaled.select("event_id", *[r6(n) for n in ("mel", "bark", "semitone")],
                         *[r6(vec.hz_from(n, n), f"hz_{n}") for n in ("mel", "bark", "semitone")])


@q("clamp01", "", "SELECT event_id, " + r(clamp("value / 100 - 0.1"), "x") + " FROM events")
def _(t):
    return t.table("events").select("event_id", r6(sc.clamp01(F.col("value") / 100 - 0.1), "x"))


@q("risk_level_bands", "segments", "SELECT session_id, segment_idx, score, "
   + ", ".join(f"{band('score', m, h)} AS {n}_level" for n, (m, h) in {"overall": (0.4, 0.5), "segment": (0.3, 0.6), "session": (0.59, 0.69)}.items()) + " FROM segments")
def _(t):
    return t.segments.select(*ID, "score", *[sc.risk_level("score", b).alias(f"{b}_level") for b in ("overall", "segment", "session")])


@q("threshold_prediction", "segments", """SELECT session_id, segment_idx, CAST(score >= 0.69 AS INTEGER) AS prediction,
    CASE WHEN score >= 0.69 THEN 'experimental' ELSE 'control' END AS prediction_label,
    CASE WHEN score >= 0.6 THEN 'anomaly' ELSE 'normal' END AS anomaly_label FROM segments""")
def _(t):
    p = t.segments.select(*ID, sc.predict("score", 0.69).alias("prediction"), sc.predict("score", 0.6).alias("_a"))
    return p.select(*ID, "prediction", sc.prediction_label("prediction").alias("prediction_label"),
                    sc.prediction_label("_a", "anomaly", "normal").alias("anomaly_label"))


@q("confidence", "segments", "SELECT session_id, segment_idx, " + r("greatest(score, 1 - score)", "confidence") + " FROM segments")
def _(t):
    return t.segments.select(*ID, r6(sc.confidence("score"), "confidence"))


@q("normalize_session_id", "", r"""WITH i AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0_rec-' || o_custkey WHEN 1 THEN 'rec.' || o_custkey || ' (2)'
        WHEN 2 THEN 'rec ' || o_custkey || '_transcript' ELSE 'Rec_' || o_custkey END AS raw_id FROM orders)
    SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(raw_id, '^0_', ''), '_transcript$', ''), '\s*\(\d+\)$', '') AS session_id,
        lower(regexp_replace(regexp_replace(regexp_replace(raw_id, '[-().]', '_', 'g'), '[_\s]+', '_', 'g'), '^_+|_+$', '', 'g')) AS subject FROM i""")
def _(t):
    k = F.col("o_custkey").cast("string")
    raw = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("0_rec-"), k)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("rec."), k, F.lit(" (2)")))
           .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("rec "), k, F.lit("_transcript"))).otherwise(F.concat(F.lit("Rec_"), k)))
    return t.table("orders").select("o_orderkey", sc.base_session_id(raw).alias("session_id"), sc.normalize_subject(raw).alias("subject"))


@q("label_to_group", "", """SELECT o_orderkey, CASE WHEN regexp_matches(lower(l), 'control|negative') THEN 'control' ELSE 'experimental' END AS grp
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Control group' WHEN 'O' THEN 'NEGATIVE' ELSE 'Positive' END AS l FROM orders)""")
def _(t):
    l = F.when(F.col("o_orderstatus") == "F", "Control group").when(F.col("o_orderstatus") == "O", "NEGATIVE").otherwise("Positive")
    return t.table("orders").select("o_orderkey", sc.label_to_group(l).alias("grp"))


@q("coerce_numeric", "", r"""WITH p AS (SELECT event_id, json_extract_string(props, '$.k') AS raw,
        CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS mixed FROM events)
    SELECT event_id, try_cast(raw AS DOUBLE) AS k, CASE WHEN isfinite(try_cast(mixed AS DOUBLE)) THEN try_cast(mixed AS DOUBLE) END AS mixed FROM p""")
def _(t):
    raw = F.get_json_object("props", "$.k")
    mixed = F.when(F.col("event_id") % 4 == 0, "nan").when(F.col("event_id") % 4 == 1, "n/a").otherwise(raw)
    return t.table("events").select("event_id", sc.to_number(raw).alias("k"), sc.to_number(mixed).alias("mixed"))


@q("coalesce_time_fields", "segments", """WITH f AS (SELECT session_id, segment_idx, CASE WHEN segment_idx % 2 = 0 THEN start_time END AS s,
        CASE WHEN segment_idx % 3 <> 0 THEN start_time END AS s2, CASE WHEN segment_idx % 2 = 1 THEN end_time END AS e,
        CASE WHEN segment_idx % 4 = 2 THEN duration END AS d FROM segments),
    g AS (SELECT *, coalesce(s, s2, CAST(0 AS DOUBLE)) AS start_time, CASE WHEN e IS NULL OR e = 0 THEN coalesce(s, s2, CAST(0 AS DOUBLE)) ELSE e END AS end_time FROM f)
    SELECT session_id, segment_idx, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time,
        round(coalesce(d, greatest(CAST(0 AS DOUBLE), end_time - start_time)), 6) AS duration FROM g""")
def _(t):
    i = F.col("segment_idx")
    b = sc.segment_bounds(F.when(i % 2 == 0, F.col("start_time")), F.when(i % 3 != 0, F.col("start_time")),
                          F.when(i % 2 == 1, F.col("end_time")), F.lit(None).cast("double"), F.when(i % 4 == 2, F.col("duration")))
    return t.segments.select(*ID, *[r6(c, n) for n, c in b.items()])


@q("json_lookup_fallback", "", r"""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.meta.score') AS DOUBLE),
    try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS found FROM events""")
def _(t):
    return t.table("events").select("event_id", sc.first_finite_json("props", ["$.meta.score", "$.k"]).alias("found"))
