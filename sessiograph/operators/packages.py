"""Session models as stored packages: trained once under group folds, saved, loaded and applied to any session.

A package is a folder: three Spark ML pipelines (text, audio, fusion), the scores of the training rows held out of their own
fold, and a small file of names and settings. Fits of different folds run side by side; loops run over folds and models.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as ft
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, packed
from .boosting import fit_trees
from .folds import group_kfold
from .models import TextVectors, assemble, class_weights, term_counts
from .svc import fit_svcs

#: Fits that run at the same time, and ranges of a column that trees tell apart.
SIDE_BY_SIDE, BINS = 16, 32


@dataclass(frozen=True)
class Settings:
    """How the models are trained."""

    folds: int = 5
    max_terms: int = 3000
    min_df: int = 3
    max_df: float = 0.9
    svc_iterations: int = 10_000
    svc_tolerance: float = 1e-4
    svc_c: float = 0.3
    calibration_folds: int = 3
    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    min_rows: int = 7
    column_share: float = 0.7
    row_share: float = 1.0
    meta_c: float = 0.5
    seed: int = 42


#: Boosted trees over segments.
SEGMENT = Settings(rounds=300, depth=5, rate=0.03, min_rows=5, column_share=1.0, row_share=0.8)


def side_by_side(jobs: list[Callable]) -> list:
    """Results of independent fits, in order."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def calibrated_svc(train: DataFrame, s: Settings, features: str = "features") -> list:
    """Stages that turn ``features`` into ``p`` (a probability vector): a balanced linear SVC and a logistic curve over margins
    held out by group. ``train``: group_id, label and the features; store it before, every fit reads it."""
    rows = train.count()
    balanced = class_weights(packed(train.select("group_id", "label", features), rows))
    reg = 1 / (s.svc_c * max(1, rows))
    svc = C.LinearSVC(featuresCol=features, maxIter=s.svc_iterations, tol=s.svc_tolerance, regParam=reg, weightCol="weight", rawPredictionCol="svc_raw", predictionCol="svc_label")
    margin = ft.VectorSlicer(inputCol="svc_raw", outputCol="margin", indices=[1])
    inner = group_kfold(balanced, "group_id", s.calibration_folds, "inner")
    *others, final = fit_svcs(inner, svc, "inner", s.calibration_folds)
    parts = [margin.transform(m.transform(inner.where(F.col("inner") == i))).select("label", "margin") for i, m in enumerate(others)]
    margins = parts[0]
    for p in parts[1:]:
        margins = margins.unionByName(p)
    curve = C.LogisticRegression(maxIter=100, featuresCol="margin", probabilityCol="p", rawPredictionCol="p_raw", predictionCol="p_label").fit(margins)
    return [final, margin, curve]


def text_model(train: DataFrame, s: Settings, counts: DataFrame | None = None) -> PipelineModel:
    """From ``terms`` to ``p``: tf-idf vectors over a bounded vocabulary, calibrated SVC. ``counts``: ``term_counts`` of ``train`` if known."""
    vectors = TextVectors.of_counts(term_counts(train) if counts is None else counts, train.count(), s.max_terms, s.min_df, s.max_df)
    stored = durable(vectors.transform(train).select("group_id", "label", "text_vec"), "vectors")
    return PipelineModel([*vectors.stages, *calibrated_svc(stored, s, "text_vec")])


def cut_points(train: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Where each column is cut into at most ``bins`` ranges: between any two values if there are that few, else at quantiles of all rows."""
    few = side_by_side([lambda f=f: [r[0] for r in train.select(f).distinct().limit(bins + 3).collect()] for f in features])
    few = [sorted(float(v) for v in values if v is not None and math.isfinite(v)) for values in few]
    many = [f for f, v in zip(features, few, strict=True) if len(v) > bins]
    found = dict(zip(many, train.approxQuantile(many, [i / bins for i in range(1, bins)], 0.05 / bins) if many else [], strict=True))
    cuts = [sorted({c for c in found[f] if math.isfinite(c)} if f in found else {a + (b - a) / 2 for a, b in zip(v, v[1:])}) for f, v in zip(features, few, strict=True)]
    return [[-math.inf, *(c or [0.0]), math.inf] for c in cuts]


def cells(ranged: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that agree in all ``columns`` as one row with their number (``n``), stored.

    Their count follows the ranges a column is cut into, not the input: at most 2048 for two columns of 32 ranges and a label.
    """
    stored = durable(ranged.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("n")), "cells")
    return packed(stored, stored.count())


def tree_model(train: DataFrame, features: list[str], s: Settings, balanced: bool = False) -> PipelineModel:
    """From the columns to ``p``: cut into ranges, as the learner itself does, then boosted trees over the rows of equal ranges, weighted by their number.

    A leaf holds rows of a weight of ``min_rows`` at least. Where every round draws its rows (``row_share``), each row stands for itself.
    """
    names = [f"{f}_range" for f in features]
    ranges = ft.Bucketizer(splitsArray=cut_points(train, features), inputCols=features, outputCols=names, handleInvalid="keep")
    if s.row_share == 1:
        rows = cells(ranges.transform(train), [*names, "label"])
    else:
        rows = packed(ranges.transform(train), train.count()).withColumn("n", F.lit(1.0))
    weighted = class_weights(rows, count="n") if balanced else rows.withColumn("weight", F.col("n"))
    least = min(0.49, (s.min_rows - 0.5) / max(1.0, weighted.agg(F.sum("weight")).first()[0] or 1.0))
    gbt = C.GBTClassifier(maxIter=s.rounds, maxDepth=s.depth, stepSize=s.rate, minWeightFractionPerNode=least, maxBins=BINS + 2, weightCol="weight",
                          featureSubsetStrategy=str(s.column_share) if s.column_share < 1 else "all", subsamplingRate=s.row_share, seed=s.seed)
    gbt = gbt.setProbabilityCol("p").setRawPredictionCol("p_raw").setPredictionCol("p_label")
    assembler = assemble(names)
    model = fit_trees(weighted, names, gbt) if s.row_share == 1 else gbt.fit(assembler.transform(weighted))
    return PipelineModel([ranges, assembler, model])


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """A tree pipeline's importance of each column; the assembler keeps the order of the names."""
    return dict(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray()), strict=True))


def mean_importances(spark: SparkSession, folds: list[dict[str, float]], top: int | None = None) -> DataFrame:
    """feature, importance (mean over folds) and rank, most important first, equal ones by name."""
    names = sorted(folds[0], key=lambda f: (-sum(x[f] for x in folds), f))[:top]
    return spark.createDataFrame([(i + 1, f, sum(x[f] for x in folds) / len(folds)) for i, f in enumerate(names)], "rank int, feature string, importance double")


def probability(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.get(vector_to_array("p"), F.lit(1)))


def with_score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` and the model's probability of class 1 alone."""
    return probability(model.transform(df), name).select(*df.columns, name)


def held_out(df: DataFrame, k: int, fit: Callable[[DataFrame], PipelineModel], name: str) -> tuple[DataFrame, list[PipelineModel]]:
    """Every row's score by the model of the other folds, and the models."""
    fitted = side_by_side([lambda i=i: fit(df.where(F.col("fold") != i)) for i in range(k)])
    parts = [with_score(m, df.where(F.col("fold") == i), name) for i, m in enumerate(fitted)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fitted


def meta_model(oof: DataFrame, s: Settings) -> PipelineModel:
    """Balanced logistic regression over (p_text, p_audio)."""
    lr = C.LogisticRegression(maxIter=1000, regParam=1 / (s.meta_c * max(1, oof.count())), weightCol="weight", featuresCol="meta", probabilityCol="p", rawPredictionCol="p_raw", predictionCol="p_label")
    return Pipeline(stages=[assemble(["p_text", "p_audio"], "meta"), lr]).fit(class_weights(oof))


def stored_at(spark: SparkSession, path: str) -> bool:
    """Whether a complete package is there: its file of names is written last."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/info/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_info(spark: SparkSession, path: str, info: dict) -> None:
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def read_info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/info").first()[0])


def train_segments(segments: DataFrame, features: list[str], path: str, s: Settings = SEGMENT, name: str = "segment_score") -> None:
    """Boosted trees over labelled segments (with ``fold``): held-out scores, one pipeline per fold and their importances, saved at ``path``."""
    oof, fitted = held_out(durable(segments, "segments"), s.folds, lambda d: tree_model(d, features, s, balanced=True), name)
    oof.write.mode("overwrite").parquet(f"{path}/oof")
    for i, m in enumerate(fitted):
        m.write().overwrite().save(f"{path}/fold-{i}")
    write_info(oof.sparkSession, path, {"features": features, "settings": asdict(s), "importances": [importances(m, features) for m in fitted]})


class SessionPackage:
    """Text, audio and fusion models of sessions."""

    def __init__(self, text: PipelineModel, audio: PipelineModel, meta: PipelineModel, oof: DataFrame, info: dict):
        self.text, self.audio, self.meta, self.oof, self.info = text, audio, meta, oof, info

    @staticmethod
    def train(sessions: DataFrame, session: str, features: list[str], s: Settings = Settings()) -> SessionPackage:
        """``sessions``: the session, group_id, label, terms and the feature columns, one row a session; stored before."""
        data = durable(group_kfold(sessions.select(session, "group_id", "label", "terms", *features), "group_id", s.folds), "training")
        text, audio = _both_kinds(data, features, s)
        oof = durable(text.scores.select(session, "group_id", "fold", "label", "p_text").join(audio.scores.select(session, "p_audio"), session), "oof")
        final, folds = side_by_side([lambda: meta_model(oof, s), lambda: held_out(oof, s.folds, lambda d: meta_model(d, s), "p_final")])
        lr = final.stages[-1]
        info = {"session": session, "features": features, "settings": asdict(s), "w_text": float(lr.coefficients[0]), "w_audio": float(lr.coefficients[1]),
                "intercept": float(lr.intercept), "importances": [importances(m, features) for m in audio.models]}
        return SessionPackage(text.final, audio.final, final, durable(folds[0], "oof"), info)

    def save(self, path: str) -> None:
        """Write all parts; the file of names comes last, so a package that has it is complete."""
        for name in ("text", "audio", "meta"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        self.oof.write.mode("overwrite").parquet(f"{path}/oof")
        write_info(self.oof.sparkSession, path, self.info)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SessionPackage:
        info = read_info(spark, path)
        parts = [PipelineModel.load(f"{path}/{name}") for name in ("text", "audio", "meta")]
        return SessionPackage(*parts, spark.read.parquet(f"{path}/oof"), info)

    def score(self, sessions: DataFrame) -> DataFrame:
        """session, p_text, p_audio, p_final of every row: trained rows by the models of the other folds, all others by the final ones.

        Where every feature is missing there is no audio score and no fused one; a single missing feature counts as 0.
        """
        session, features = self.info["session"], self.info["features"]
        heard = F.coalesce(*[F.col(f) for f in features]).isNotNull()
        rows = sessions.select(session, "terms", heard.alias("heard"), *[F.coalesce(f, F.lit(0.0)).alias(f) for f in features])
        scored = with_score(self.audio, with_score(self.text, rows, "p_text").drop("terms"), "p_audio")
        fused = with_score(self.meta, scored, "p_final").select(session, "p_text", *[F.when(F.col("heard"), F.col(c)).alias(c) for c in ("p_audio", "p_final")])
        known = self.oof.select(session, *[F.col(c).alias(f"{c}_oof") for c in ("p_text", "p_audio", "p_final")])
        joined = fused.join(known, session, "left")
        trained = F.col("p_text_oof").isNotNull()
        return joined.select(session, F.coalesce("p_text_oof", "p_text").alias("p_text"), *[F.when(trained, F.when(F.col(c).isNotNull(), F.col(f"{c}_oof"))).otherwise(F.col(c)).alias(c)
                                                                                             for c in ("p_audio", "p_final")], trained.alias("trained"))


@dataclass
class Kind:
    """Models of the folds, the one of all rows, and the held-out scores."""

    models: list[PipelineModel]
    final: PipelineModel
    scores: DataFrame


def _both_kinds(data: DataFrame, features: list[str], s: Settings) -> list[Kind]:
    """Text and audio models; the fits of both run side by side."""
    counts = durable(term_counts(data, "fold"), "terms")
    rows, known = ([x.where(F.col("fold") != i) for i in range(s.folds)] + [x] for x in (data, counts))
    fitted = side_by_side([lambda d=d, c=c: text_model(d, s, c) for d, c in zip(rows, known, strict=True)] + [lambda d=d: tree_model(d, features, s) for d in rows])
    out = []
    for models, name in ((fitted[: s.folds + 1], "p_text"), (fitted[s.folds + 1 :], "p_audio")):
        parts = [with_score(m, data.where(F.col("fold") == i), name) for i, m in enumerate(models[:-1])]
        scores = parts[0]
        for p in parts[1:]:
            scores = scores.unionByName(p)
        out.append(Kind(models[:-1], models[-1], scores))
    return out
