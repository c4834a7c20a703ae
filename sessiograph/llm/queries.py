"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_format
from .exact_dedup import exact_duplicates
from .language_id import language_of
from .lexical_search import search
from .license_scan import license_scan
from .lm_scoring import lm_scores
from .minhash_dedup import near_duplicates
from .packing import pack
from .quality_rules import HOST_RATE, PRIOR, REPEATED_LINES, REPEATED_WORDS, SYMBOLS_PER_WORD, WORD_LENGTH, quality
from .secret_scan import secrets
from .sentencepiece_codec import encode
from .spelling import LEAST_COUNT, LEAST_LENGTH, RATIO, SPOILED, spelling_variants
from .suffix_dedup import repeated_spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Lower-casing of A-Z alone, in DuckDB.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


#: Words of every text with their place, and the counts of the quality rules, in DuckDB.
COUNTS_SQL = r"""
t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM places),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM win WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
counts AS (
  SELECT t.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t JOIN w USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))"""

QUALITY_SQL = f"""
{COUNTS_SQL},
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols > {SYMBOLS_PER_WORD} * n_words OR n_dup_lines > {REPEATED_LINES} * n_lines OR word_chars < {WORD_LENGTH[0]} * n_words
    OR word_chars > {WORD_LENGTH[1]} * n_words OR n_repeat_words > {REPEATED_WORDS} * n_words AS soft_failed
  FROM counts),
hosts AS (SELECT source, count(*) AS n, sum(CAST(soft_failed AS BIGINT)) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT avg(failed / n) AS mean, var_pop(failed / n) AS var FROM hosts),
weight AS (SELECT mean, CASE WHEN var > 0 THEN greatest({PRIOR}, mean * (1 - mean) / var - 1) ELSE {PRIOR} END AS k FROM prior),
verdicts AS (SELECT source, (failed + mean * k) / (n + k) AS rate FROM hosts, weight)"""


@query("op6_quality_rules", f"""
WITH {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(rate > {HOST_RATE}, FALSE) AND soft_failed) AS kept
FROM judged LEFT JOIN verdicts USING (source)""")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).drop("host_rate")


@query("op8_minhash_dedup")
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2).drop("stays")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(documents(spark, sf_dir))


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s, row_number() OVER o AS j,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER o AS prefix, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE j = n GROUP BY n, prefix),
stays AS (SELECT conv_id, copies FROM whole ANTI JOIN (SELECT DISTINCT j AS n, prefix FROM p WHERE j < n) USING (n, prefix))
SELECT conv_id, count(*) AS n_turns, copies, string_agg(s, '' ORDER BY j) AS rendered FROM p JOIN stays USING (conv_id) GROUP BY conv_id, copies"""


@query("op4_chat_format", CHAT_SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_lexical_search", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS_SQL} AS words FROM documents),
sized AS (SELECT rid, doc_id, len(words) AS n, words FROM d WHERE len(words) > 0),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
asked AS (SELECT qid, item_id, term, count(*) AS times
  FROM (SELECT qid, item_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS qid, item_id, {TERMS_SQL} AS words FROM benchmark)) GROUP BY qid, item_id, term),
post AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(words) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY rid, doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM post GROUP BY term), tot),
scores AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM post JOIN weights USING (term) JOIN asked USING (term), tot GROUP BY qid, item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 of a text in DuckDB: its table of remainders, then one step a byte.
CRC_TABLE_SQL = ("list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), "
                 "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")
CRC_SQL = ("xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(key))), lambda i: CAST('0x' || substr(hex(encode(key)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), "
           "lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)")


@query("op12_spelling", f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
long AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS (SELECT run, c, {CRC_SQL} AS h FROM (SELECT run, c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM long), (SELECT {CRC_TABLE_SQL} AS steps)),
words AS (SELECT CASE WHEN h % {SPOILED} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
vocabulary AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
shorter AS (SELECT DISTINCT c.word, c.n, v.word AS other, v.n AS m FROM cuts c JOIN vocabulary v ON c.cut = v.word),
near AS (SELECT word, n, other, m FROM shorter UNION ALL SELECT other, m, word, n FROM shorter UNION ALL
  SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word != b.word),
found AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
best AS (SELECT found.word, any_value(n_near) AS n_near, any_value(found.m) AS m, min(other) AS other FROM found JOIN near ON found.word = near.word AND found.m = near.m GROUP BY found.word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * v.n THEN other END AS form, CASE WHEN m >= {RATIO} * v.n THEN m END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS up FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.up = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT chain.word, chain.up FROM chain JOIN forms ON chain.up = forms.word WHERE forms.form IS NULL)
SELECT forms.word, form, up AS root, n, n_near, form_n FROM forms JOIN ends USING (word)""")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


@query("op13_license_scan")
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("places")
