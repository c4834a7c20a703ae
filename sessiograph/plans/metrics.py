"""Evaluation metrics. Predictions: event values as scores, the event type gives the label, days are folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import metrics as m
from ._sql import r
from .registry import Registry, r6
from .sessions import _rounded

registry = Registry()
q = registry.query
PRED = """pr AS (SELECT user_id % 5 AS fold, least(1, (value + CASE WHEN event_type IN ('error', 'click') THEN 15 ELSE 0 END) / 100) AS p,
    CAST(event_type IN ('error', 'click') AS INTEGER) AS y FROM events)"""
K = ["fold"]


def predictions(t):
    pos = F.col("event_type").isin("error", "click")
    return t.table("events").select((F.col("user_id") % 5).alias("fold"), F.least(F.lit(1.0), (F.col("value") + F.when(pos, 15).otherwise(0)) / 100).alias("p"), pos.cast("int").alias("y"))


CURVE = f"""{PRED}, c AS (SELECT fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM pr GROUP BY 1, 2),
    cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS np, sum(neg) OVER (PARTITION BY fold) AS nn FROM c WINDOW w AS (PARTITION BY fold ORDER BY p DESC))"""


@q("roc_auc", "", f"WITH {CURVE} SELECT fold, {r('sum(neg * (tp - pos + pos / CAST(2 AS DOUBLE))) / max(CAST(np AS DOUBLE) * nn)', 'roc_auc')} FROM cv GROUP BY 1")
def _(t):
    return _rounded(m.roc_auc(predictions(t), K), K)


@q("average_precision", "", f"WITH {CURVE} SELECT fold, {r('sum(pos / CAST(np AS DOUBLE) * tp / (tp + fp))', 'average_precision')} FROM cv GROUP BY 1")
def _(t):
    return _rounded(m.average_precision(predictions(t), K), K)


@q("pr_curve", "", f"WITH {CURVE} SELECT fold, p AS threshold, {r('tp / (tp + fp)', 'precision')}, {r('tp / np', 'recall')} FROM cv")
def _(t):
    return m.pr_curve(predictions(t), K).select("fold", "threshold", r6("precision"), r6("recall"))


@q("best_f1_threshold", "", f"WITH {CURVE}, f AS (SELECT *, round(2 * tp / CAST(tp + fp + np AS DOUBLE), 12) AS f FROM cv) SELECT fold, arg_max(p, (f, -p)) AS threshold, {r('max(f)', 'f1')} FROM f GROUP BY 1")
def _(t):
    return m.best_f1_threshold(predictions(t), K).select("fold", "threshold", r6("f1"))


def _grid(lo, hi, n):
    return [float(x) for x in np.linspace(lo, hi, n)]


def _grid_sql(grid, expr, name):
    values = ", ".join(f"(CAST({g!r} AS DOUBLE))" for g in grid)
    return f"""WITH {PRED}, th(th) AS (VALUES {values}), g AS (SELECT fold, th, CAST(sum(CASE WHEN p >= th AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN p >= th AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(sum(CASE WHEN p < th AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, CAST(sum(CASE WHEN p < th AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM pr, th GROUP BY 1, 2),
    s AS (SELECT *, round({expr}, 12) AS s FROM g) SELECT fold, arg_max(th, (s, -th)) AS threshold, {r('max(s)', name)} FROM s GROUP BY 1"""


@q("grid_f1_threshold", "", _grid_sql(_grid(0.3, 0.7, 41), "CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END", "f1"))
def _(t):
    return m.grid_f1(predictions(t), K, _grid(0.3, 0.7, 41)).select("fold", "threshold", r6("f1"))


@q("grid_balanced_accuracy", "", _grid_sql(_grid(0.1, 0.9, 100), "(tp / (tp + fn) + tn / (tn + fp)) / 2", "balanced_accuracy"))
def _(t):
    return m.grid_balanced_accuracy(predictions(t), K, _grid(0.1, 0.9, 100)).select("fold", "threshold", r6("balanced_accuracy"))


@q("confusion_matrix", "", f"WITH {PRED} SELECT fold, y, CAST(p >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM pr GROUP BY 1, 2, 3")
def _(t):
    return m.confusion_matrix(predictions(t).withColumn("pred", (F.col("p") >= 0.5).cast("int")), K, "y", "pred")


_CLS = f"""WITH {PRED}, k AS (SELECT fold, CAST(count(*) FILTER (y = 1 AND p >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND p >= 0.5) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (y = 1 AND p < 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND p < 0.5) AS DOUBLE) AS tn FROM pr GROUP BY 1),
    a AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp + fn AS s1, tn + fp AS s0 FROM k), b AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0, s0 + s1 AS n FROM a),
    u AS (SELECT fold, '0' AS "class", p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM b UNION ALL SELECT fold, '1', p1, r1, f1, s1 FROM b
    UNION ALL SELECT fold, 'macro', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM b UNION ALL SELECT fold, 'weighted', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM b
    UNION ALL SELECT fold, 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM b)"""


@q("classification_summary", "", _CLS + f" SELECT fold, \"class\", {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, support FROM u")
def _(t):
    return _rounded(m.classification_summary(predictions(t).withColumn("pred", (F.col("p") >= 0.5).cast("int")), K, "y", "pred"), K)


@q("log_loss", "", f"WITH {PRED}, c AS (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS c FROM pr) SELECT fold, {r('avg(-ln(CASE WHEN y = 1 THEN c ELSE 1 - c END))', 'log_loss')} FROM c GROUP BY 1")
def _(t):
    return _rounded(m.log_loss(predictions(t), K), K)


@q("fold_metric_mean", "", f"""WITH {CURVE}, f AS (SELECT fold, sum(neg * (tp - pos + pos / CAST(2 AS DOUBLE))) / max(CAST(np AS DOUBLE) * nn) AS a, sum(pos / CAST(np AS DOUBLE) * tp / (tp + fp)) AS b FROM cv GROUP BY 1)
    SELECT 'roc_auc' AS metric, {r('avg(a)', 'mean')}, {r('stddev_samp(a)', 'std')} FROM f UNION ALL SELECT 'average_precision', round(avg(b), 6), round(stddev_samp(b), 6) FROM f""")
def _(t):
    p = predictions(t)
    both = m.roc_auc(p, K).join(m.average_precision(p, K), K).withColumn("model", F.lit("rule"))
    return _rounded(m.fold_means(both.drop("fold"), ["model"], ["roc_auc", "average_precision"]).drop("model"), [])
