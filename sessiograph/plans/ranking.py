"""Sorting, limits, top-k, set operations, term and feature rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TERM_STOPWORDS
from ..functions import scalars as sc
from ..operators import ordered, ranking, scoring
from ._sql import band, r
from .registry import Registry, r6

registry = Registry()
q = registry.query
ID = ["session_id", "segment_idx"]


@q("order_segments", "segments", "SELECT session_id, segment_idx, start_time FROM segments ORDER BY session_id, start_time, segment_idx")
def _(t):
    return ranking.order_segments(t.segments.select(*ID, "start_time"), "session_id", "start_time", "segment_idx")


@q("limit_distinct_sessions", "", """SELECT event_id, user_id FROM events WHERE user_id IN
    (SELECT user_id FROM events GROUP BY 1 ORDER BY min(event_id), user_id LIMIT 20)""")
def _(t):
    return ranking.limit_distinct(t.table("events").select("event_id", "user_id"), "user_id", "event_id", 20)


@q("top_segments", "segments", """SELECT session_id, rank, segment_id, start_time, end_time, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_id
    ORDER BY score DESC, segment_idx) AS INTEGER) AS rank FROM segments) WHERE rank <= 5""")
def _(t):
    return scoring.top_per_session(t.segments, "session_id", "score", ["segment_idx"], 5).select("session_id", "rank", "segment_id", "start_time", "end_time", "score")


@q("high_risk_segments", "segments", "SELECT session_id, count(*) AS n_segments, count(*) FILTER (score >= 0.6) AS n_high FROM segments GROUP BY 1")
def _(t):
    return ranking.high_risk_count(t.segments, "session_id", sc.risk_level("score", "segment"))


@q("segment_timeline", "segments", f"SELECT session_id, segment_idx, start_time, end_time, score, {band('score', 0.3, 0.6)} AS level, left(text, 100) AS preview FROM segments")
def _(t):
    return ranking.segment_timeline(t.segments, "session_id")


_W = [((i * 37) % 64 + 1) / 64.0 for i in range(64)]
_CONTRIB = f"""l AS (SELECT frame_idx, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vectors),
    c AS (SELECT frame_idx, 'f' || pos AS feature, pos, x, ((pos * 37) % 64 + 1) / CAST(64 AS DOUBLE) * abs(x) AS contribution FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY contribution DESC, pos) AS rank FROM c)"""


def _contributions(t):
    names = [f"f{i}" for i in range(64)]
    return t.vectors.select("frame_idx", ranking.top_contributions(names, F.array(*[F.lit(w) for w in _W]), F.col("vec"), 10).alias("top"))


@q("top_contributions", "vectors", f"WITH {_CONTRIB} SELECT frame_idx, rank, feature, {r('contribution', 'contribution')} FROM k WHERE rank <= 10")
def _(t):
    e = _contributions(t).select("frame_idx", F.posexplode("top").alias("p", "f"))
    return e.select("frame_idx", (F.col("p") + 1).cast("long").alias("rank"), "f.feature", r6(F.col("f.contribution"), "contribution"))


@q("feature_influence", "vectors", f"""WITH {_CONTRIB} SELECT feature, {r('avg(contribution)', 'contribution')}, {r('avg(contribution * 2)', 'value_mean')}, count(*) AS n
    FROM k WHERE rank <= 10 GROUP BY feature ORDER BY avg(contribution) DESC, feature LIMIT 10""")
def _(t):
    rows = _contributions(t).select(F.transform("top", lambda f: F.struct(f["feature"].alias("feature"), f["contribution"].alias("contribution"),
                                                                         (f["contribution"] * 2).alias("value"))).alias("top"))
    return ranking.feature_influence(rows, "top").withColumns({c: F.round(c, 6) for c in ("contribution", "value_mean")})


@q("feature_importance_rank", "vectors", """WITH l AS (SELECT frame_idx % 5 AS fold, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM vectors),
    i AS (SELECT fold, 'f' || pos AS feature, avg(abs(x)) AS importance FROM l GROUP BY 1, 2)
    SELECT feature, round(avg(importance), 6) AS importance FROM i GROUP BY 1 ORDER BY avg(importance) DESC, feature LIMIT 15""")
def _(t):
    l = t.vectors.select((F.col("frame_idx") % 5).alias("fold"), F.posexplode("vec").alias("pos", "x"))
    i = l.groupBy("fold", F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature")).agg(F.avg(F.abs("x")).alias("importance"))
    return ranking.importance_rank(i, 15).withColumn("importance", F.round("importance", 6))


_STOP = ", ".join(f"'{w}'" for w in TERM_STOPWORDS)


@q("risk_terms", "segments", rf"""WITH e AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}'']{{4,}}')) AS term, score FROM segments),
    c AS (SELECT term, count(*) AS count, max(score) AS max_risk FROM e WHERE term NOT IN ({_STOP}) GROUP BY 1)
    SELECT term, count, round(max_risk, 6) AS max_risk, round(least(1, greatest(0, max_risk * 0.7 + least(1, count / CAST(6 AS DOUBLE)) * 0.3)), 6) AS weight
    FROM c ORDER BY max_risk * 2 + count * 0.08 DESC, term LIMIT 10""")
def _(t):
    return ranking.risk_terms(t.segments, "text", "score").withColumns({c: F.round(c, 6) for c in ("max_risk", "weight")})


@q("frame_capture_times", "frames", """WITH n AS (SELECT series_id, max(t) * 0.9 AS d FROM frames GROUP BY 1),
    k AS (SELECT f.series_id, greatest(CAST(0 AS DOUBLE), least(d, t)) AS x, row_number() OVER (PARTITION BY f.series_id ORDER BY value DESC, frame_idx) AS rank FROM frames f JOIN n ON n.series_id = f.series_id)
    SELECT series_id, round(x, 2) AS time, CAST(min(rank) AS INTEGER) AS rank FROM k WHERE rank <= 4 GROUP BY 1, 2""")
def _(t):
    d = t.frames.groupBy("series_id").agg((F.max("t") * 0.9).alias("d"), F.max("frame_idx").alias("_top"))
    return ranking.frame_capture_times(ordered.attach(t.frames, d, ["series_id"], "frame_idx"), "series_id", "t", "value", ["frame_idx"], F.col("d"))


@q("union_append", "", """SELECT o_orderkey AS k, o_totalprice AS price, CAST(NULL AS DOUBLE) AS tax FROM orders
    UNION ALL SELECT l_orderkey, CAST(NULL AS DOUBLE), l_tax FROM lineitem""")
def _(t):
    a = t.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return ranking.union_append(a, t.table("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_tax").alias("tax")))


@q("checked_union", "", "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    a = t.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return ranking.checked_union(a, t.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")))


@q("intersect_sessions", "", "SELECT user_id AS session_id FROM events INTERSECT SELECT o_custkey FROM orders")
def _(t):
    return t.table("events").select(F.col("user_id").alias("session_id")).intersect(t.table("orders").select("o_custkey"))


@q("except_sessions", "", "SELECT o_custkey AS session_id FROM orders EXCEPT SELECT user_id FROM events")
def _(t):
    return t.table("orders").select(F.col("o_custkey").alias("session_id")).subtract(t.table("events").select("user_id"))


@q("dedup_segments", "segments", """WITH c AS (SELECT *, 'first' AS source FROM segments UNION ALL SELECT *, 'second' FROM segments WHERE score > 0.5)
    SELECT session_id, segment_idx, source FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, start_time, end_time, text ORDER BY source) AS rn FROM c) WHERE rn = 1""")
def _(t):
    both = t.segments.withColumn("source", F.lit("first")).unionByName(t.segments.where("score > 0.5").withColumn("source", F.lit("second")))
    return ranking.dedup_segments(both, ["source"]).select(*ID, "source")


@q("dedup_records", "", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    d = t.table("documents").select("doc_id", "text")
    return ranking.first_by_key(d, [F.col("text")], ["doc_id"])
