"""Secret scan: candidates by pattern, a random forest removes the false ones. DataFrame expressions and Spark ML only.

A candidate is a provider's key format, a value assigned to a telling name, or any long run of key-like characters. The
forest sees the value (length, character transitions, share of digits and capitals, variety, dictionary coverage), the
neighbouring words and the path, never which pattern found it. It is trained from labelled findings; without a table of
such, the corpus labels its own clear cases (``weak_label``).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

# Published key formats and the names that secrets are assigned to.
PROVIDERS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"AIza[0-9A-Za-z_-]{35}",
    r"[rs]k_live_[0-9A-Za-z]{16,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
)
NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
#: Words that make a value a placeholder or plain prose, and words beside a value that speak for a digest or an example.
DICTIONARY = ("changeme", "password", "passwort", "example", "sample", "placeholder", "default", "secret", "token", "dummy", "admin", "test", "demo", "your", "here",
              "none", "null", "true", "false", "xxxx", "1234", "abcd", "login", "user", "enter", "the", "and", "ing", "tion", "ment", "lich", "keit", "ción", "que")
HARMLESS = r"(?<![\w.@-])(?:commit|sha-?\d*|md5|checksum|digest|hash|uuid|example|sample|placeholder|revision|etag)(?![\w-]|\.\w)"
TELLING = r"(?i)(?:" + NAMES[3:-1] + r"|credential|bearer|login|key)"
TEST_PATH = r"(?i)(?:test|example|sample|fixture|doc|mock)"

_BEFORE = NAMES + r"[\"']?\s{0,4}(?:=|:|:=|=>)\s{0,4}[\"']?"
ASSIGNED = rf"(?i:{_BEFORE})[^\s\"'<>]{{6,}}"
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
CANDIDATE = "|".join([*PROVIDERS, ASSIGNED, LONG])

FEATURES = ["length", "transitions", "digits", "capitals", "variety", "covered", "telling", "harmless", "assigned", "quoted", "in_path", "test_path"]
#: The documented bound on labelled findings that the forest is fitted on (both labels together), and its size.
FIT_ROWS, TREES, DEPTH, SEED = 20_000, 30, 6, 11
CONTEXT = 60


def scanned(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, carry: bool) -> DataFrame:
    """Rows with a candidate: rid, doc_id, path, matches, gaps (the text around them, one more), with ``carry`` the row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    row = F.struct(*[docs[c] for c in docs.columns]) if carry else F.lit(None).cast("int")
    found = docs.select(row.alias("row"), docs[id_col].cast("long").alias("doc_id"), (docs[path_col] if path_col else F.lit(None)).cast("string").alias("path"), text.alias("body"),
                        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("matches")).where(F.size("matches") > 0)
    return found.select(F.monotonically_increasing_id().alias("rid"), "row", "doc_id", "path", "matches", F.split("body", CANDIDATE, -1).alias("gaps"))


def findings(found: DataFrame) -> DataFrame:
    """One row per candidate: rid, pos, doc_id, path, kind, start and length of the value, value, before, after."""
    each = found.select("rid", "doc_id", "path", "gaps", F.posexplode("matches").alias("pos", "match")).select(
        "rid", "pos", "doc_id", "path", "match", F.length(F.get("gaps", F.col("pos"))).alias("gap"),
        F.substring(F.get("gaps", F.col("pos")), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get("gaps", F.col("pos") + 1), 1, CONTEXT).alias("after"))
    name = F.regexp_extract("match", rf"^(?i:{_BEFORE})", 0)
    end = F.sum(F.col("gap").cast("long") + F.length("match")).over(Window.partitionBy("rid").orderBy("pos"))
    value = F.expr("substring(match, length(name) + 1)")
    return each.withColumn("name", name).withColumn("value", value).select(
        "rid", "pos", "doc_id", "path",
        F.when(F.col("match").rlike("^(?:" + "|".join(PROVIDERS) + ")$"), "provider").when(F.col("name") != "", "assigned").otherwise("long").alias("kind"),
        (end - F.length("value")).alias("start"), F.length("value").cast("long").alias("length"), "value", F.concat("before", "name").alias("before"), "after")


def with_features(rows: DataFrame) -> DataFrame:
    """Feature columns from value, before, after and path."""
    v, size = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    words = "(?i)(?:" + "|".join(DICTIONARY) + ")"
    steps = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace(v, pattern, ""))) / size

    near = F.concat(F.coalesce("before", F.lit("")), F.lit(" "), F.coalesce("after", F.lit("")))
    return rows.select(
        "*", size.cast("double").alias("len"), (F.size(F.regexp_extract_all(v, F.lit(steps), F.lit(0))) / size).alias("transitions"), share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"), (F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(36))).alias("variety"), share(words).alias("covered"),
        F.coalesce(F.col("before"), F.lit("")).rlike(TELLING).cast("double").alias("telling"), near.rlike("(?i)" + HARMLESS).cast("double").alias("harmless"),
        F.coalesce(F.col("before"), F.lit("")).rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"), F.coalesce(F.col("before"), F.lit("")).rlike(r"[\"']$").cast("double").alias("quoted"),
        (F.coalesce(F.col("before"), F.lit("")).rlike(r"(?:/|://\S*)$") | v.rlike(r"^[^/]*(?:/[^/]+){3,}$")).cast("double").alias("in_path"),
        F.coalesce(F.col("path"), F.lit("")).rlike(TEST_PATH).cast("double").alias("test_path")).withColumnRenamed("len", "length_")


def weak_label() -> Column:
    """1 for a provider format or a varied value with digits assigned to a telling name, 0 for words, digests beside their name and placeholders,
    null where neither is clear."""
    filler = (F.col("covered") > 0.3) | (F.col("variety") < 0.15)
    return (F.when(filler, 0).when(F.col("kind") == "provider", 1)
            .when((F.col("digits") == 0) | ((F.col("harmless") == 1) & (F.col("kind") == "long")), 0)
            .when((F.col("kind") == "assigned") & (F.col("length_") >= 12), 1).cast("double"))


def train(rows: DataFrame):
    """A forest from rows with features and a 0/1 ``label``, or None unless both labels are there.

    At most about FIT_ROWS rows are drawn, each label by its own rate: all of a rare one (half of FIT_ROWS
    at most), the rest from the other. Both labels weigh the same in the fit, so that a verdict does not follow their ratio or the size of the table.
    """
    known = rows.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    seen = known.agg(F.count_if(F.col("label") == 0).alias("no"), F.count_if(F.col("label") == 1).alias("yes")).first()
    if not min(seen):
        return None
    rare = min(*seen, FIT_ROWS // 2)
    drawn = known.where(F.rand(SEED) < F.when(F.col("label") == 1, _rate(seen["yes"], rare)).when(F.col("label") == 0, _rate(seen["no"], rare)))
    data = stored(_assembled(drawn).select("features", "label"), "labelled")
    got = data.agg(F.count_if(F.col("label") == 0).alias("no"), F.count_if(F.col("label") == 1).alias("yes")).first()
    weighed = data.withColumn("weight", F.when(F.col("label") == 1, sum(got) / (2 * got["yes"])).otherwise(sum(got) / (2 * got["no"])))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=64, weightCol="weight").fit(weighed)


def _rate(n: int, rare: int) -> float:
    """Share of ``n`` rows of a label that leaves FIT_ROWS in all, where ``rare`` rows of the other label stay."""
    return min(1.0, (FIT_ROWS - rare) / n)


def evidence() -> Column:
    """Score of a candidate without a forest: the clear cases as ``weak_label`` has them, the others by what stands in and around the value."""
    clues = 0.6 * F.col("telling") + 0.2 * F.col("assigned") + 0.1 * F.col("quoted") + F.when(F.col("variety") >= 0.5, 0.1).otherwise(0.0)
    against = 0.5 * F.col("harmless") + 0.5 * F.col("in_path") + 0.3 * F.col("test_path")
    return F.coalesce(weak_label().cast("double"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), clues - against)))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"{c}_" if c == "length" else c for c in FEATURES], outputCol="features").transform(rows)


def scored(rows: DataFrame, model) -> DataFrame:
    """``score`` (probability of a secret where both labels are equally frequent) and ``secret``; without a model the candidate's own ``evidence``."""
    if model is None:
        out = rows.withColumn("score", evidence())
    else:
        out = model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("secret", F.col("score") >= 0.5)


def _judged(found: DataFrame, labelled: DataFrame | None) -> DataFrame:
    rows = stored(with_features(findings(found)), "findings")
    examples = rows.withColumn("label", weak_label()) if labelled is None else with_features(labelled)
    return scored(rows, train(examples))


def secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start (code points before the value), length, kind, score, secret, value_sha256.

    ``labelled``: findings with value, before, after, path and label. Texts without candidates, null and empty ones give no
    rows; repeated rows and null ids each give theirs; an empty table gives an empty result.
    """
    found = stored(scanned(docs, id_col, text_col, path_col, carry=False).drop("row"), "scanned")
    return _judged(found, labelled).select("doc_id", "start", "length", "kind", "score", "secret", F.sha2(F.col("value"), 256).alias("value_sha256"))


def redacted(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text",
             path_col: str | None = "source", length_col: str | None = None) -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``mark``; ``length_col``, if given, follows the new text. Rows without one are unchanged."""
    found = stored(scanned(docs, id_col, text_col, path_col, carry=True), "scanned")
    flags = _judged(found, labelled).groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "secret", "length"))), lambda s: F.struct(s["secret"], s["length"])).alias("flags"))

    def piece(gap: Column, i: Column) -> Column:
        match, flag = F.get("matches", i), F.get("flags", i)
        shown = F.when(flag["secret"], F.concat(match.substr(F.lit(1), F.length(match) - flag["length"].cast("int")), F.lit(mark))).otherwise(match)
        return F.concat(gap, F.coalesce(shown, F.lit("")))

    changed = found.join(flags, "rid").withColumn("body", F.when(F.exists("flags", lambda f: f["secret"]), F.array_join(F.transform("gaps", piece), "")))
    new = {text_col: F.coalesce("body", F.col("row")[text_col])}
    if length_col:
        new[length_col] = F.when(F.col("body").isNull(), F.col("row")[length_col]).otherwise(F.length("body"))
    rewritten = changed.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.where(~text.rlike(CANDIDATE)).unionByName(rewritten)
