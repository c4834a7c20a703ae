"""Text, audio and fusion models on Spark ML, under group-safe folds.

Learners are Spark's own. Loops run over folds and models, never over rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml import classification as C
from pyspark.ml import feature as ft
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.vectors import let
from .ordered import with_scalars

# letters with a mark and the letter without it, derived from Unicode (Latin blocks)
_MARKED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
ACCENTED = "".join(_MARKED)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def plain_text(text: str | Column) -> Column:
    return F.translate(F.lower(F.coalesce(sc.col(text), F.lit(""))), ACCENTED, PLAIN)


def ngram_terms(text: str | Column) -> Column:
    """Words of two or more letters and pairs of neighbouring words."""
    words = F.regexp_extract_all(plain_text(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))

    def with_pairs(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)))
    return let(words, with_pairs)


def tfidf(df: DataFrame, doc: str, text: str, min_df: int = 2, max_df: float = 0.95, *, max_terms: int | None) -> DataFrame:
    """(doc, term, weight): 1 + ln tf, smoothed idf + 1, unit length per document.

    The vocabulary is the terms within the document-frequency limits, or the ``max_terms`` most frequent of them; only
    one of such a fixed size is broadcast. Texts, not their terms, are dealt by document, so terms are counted where the text is;
    the counted terms move twice, to the vocabulary and back to their document.
    """
    texts = df.select(doc, text).repartition(doc)
    counts = texts.select(doc, F.explode(ngram_terms(text)).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_total"))
    terms = with_scalars(terms, n)
    usable = terms.where((F.col("_df") >= min_df) & (F.col("_df") <= F.col("_n") * max_df))
    chosen = usable if max_terms is None else usable.orderBy(F.desc("_total"), "term").limit(max_terms)
    vocabulary = chosen.select("term", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("_idf"))
    weighted = counts.join(vocabulary if max_terms is None else F.broadcast(vocabulary), "term").withColumn("_w", (1 + F.log("tf")) * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", (F.col("_w") / norm).alias("weight"))


class LogTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln of the counts of a count vector, zeros kept; the result is compressed. Part of saved pipelines."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        logged = F.transform(vector_to_array(self.getInputCol()), lambda x: F.when(x > 0, 1 + F.log(F.when(x > 0, x).otherwise(1.0))).otherwise(0.0))
        raw = df.withColumn("_log", array_to_vector(logged))
        return ft.VectorAssembler(inputCols=["_log"], outputCol=self.getOutputCol()).transform(raw).drop("_log")


def term_counts(df: DataFrame, *by: str) -> DataFrame:
    """Documents (``df``) and occurrences (``tf``) of each term, per value of the columns ``by``: one pass serves every fold."""
    each = df.select(*by, F.explode("terms").alias("term"), F.lit(0).alias("_d"), F.lit(1).alias("_t"))
    once = df.select(*by, F.explode(F.array_distinct("terms")).alias("term"), F.lit(1).alias("_d"), F.lit(0).alias("_t"))
    return each.unionByName(once).groupBy(*by, "term").agg(F.sum("_d").alias("df"), F.sum("_t").alias("tf"))


class TextVectors:
    """Fitted text features: counts over a bounded vocabulary, log tf, idf + 1, unit length."""

    def __init__(self, stages: list):
        self.stages = stages

    @staticmethod
    def fit(df: DataFrame, max_terms: int, min_df: int = 2, max_df: float = 0.95) -> TextVectors:
        """``df`` has the terms of a document in ``terms``; store it before, it is read several times."""
        return TextVectors.of_counts(term_counts(df), df.count(), max_terms, min_df, max_df)

    @staticmethod
    def of_counts(counts: DataFrame, n: int, max_terms: int, min_df: int = 2, max_df: float = 0.95) -> TextVectors:
        """From ``term_counts`` of ``n`` documents, or of any folds of them: the ``max_terms`` most frequent terms, equal ones by name."""
        sums = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where((F.col("df") >= min_df) & (F.col("df") <= n * max_df))
        chosen = sums.orderBy(F.desc("tf"), "term").limit(max_terms).collect()
        counter = ft.CountVectorizerModel.from_vocabulary([r.term for r in chosen], inputCol="terms", outputCol="_counts")
        scale = ft.ElementwiseProduct(scalingVec=Vectors.dense([math.log((n + 1) / (r.df + 1)) + 1 for r in chosen]), inputCol="_tf", outputCol="_scaled")
        return TextVectors([counter, LogTf(inputCol="_counts", outputCol="_tf"), scale, ft.Normalizer(inputCol="_scaled", outputCol="text_vec", p=2.0)])

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for s in self.stages:
            out = s.transform(out)
        return out.drop("terms", "_counts", "_tf", "_scaled")


def class_weights(df: DataFrame, label: str = "label", count: str | None = None) -> DataFrame:
    """n / (2 n_class) per row, from one aggregate; times ``count`` where a row stands for that many."""
    each = F.lit(1) if count is None else F.col(count)
    n = df.agg(F.sum(each).alias("_n"), F.sum(F.col(label) * each).alias("_p"))
    w = F.when(F.col(label) == 1, F.try_divide(F.col("_n"), 2 * F.col("_p"))).otherwise(F.try_divide(F.col("_n"), 2 * (F.col("_n") - F.col("_p"))))
    return with_scalars(df, n).withColumn("weight", F.coalesce(w, F.lit(1.0)) * each).drop("_n", "_p")


def assemble(features: list[str], output: str = "features") -> ft.VectorAssembler:
    return ft.VectorAssembler(inputCols=features, outputCol=output, handleInvalid="keep")


def numeric_pipeline(features: list[str], learner) -> Pipeline:
    """Scale the columns, then learn the probability vector ``p``; missing values are filled before."""
    return Pipeline(stages=[assemble(features, "raw"), ft.StandardScaler(inputCol="raw", outputCol="features", withMean=True), learner.setProbabilityCol("p")])


def learners(seed: int = 42, width: int | None = None) -> dict[str, Callable]:
    """The baseline learners by name."""
    out = {
        "logistic_l2": lambda: C.LogisticRegression(maxIter=1000, regParam=0.1, elasticNetParam=0.0),
        "logistic_l1": lambda: C.LogisticRegression(maxIter=1000, regParam=0.02, elasticNetParam=1.0),
        "random_forest": lambda: C.RandomForestClassifier(numTrees=200, maxDepth=5, seed=seed),
        "naive_bayes": lambda: C.NaiveBayes(modelType="gaussian"),
        "gradient_boosting": lambda: C.GBTClassifier(maxIter=50, maxDepth=3, seed=seed),
    }
    if width:
        out["perceptron"] = lambda: C.MultilayerPerceptronClassifier(layers=[width, 64, 32, 2], maxIter=200, seed=seed)
    return out


def linear_score(features: dict[str, float], intercept: float, stats: DataFrame, df: DataFrame, name: str = "risk_score") -> DataFrame:
    """Score of a stored linear model package: fill, scale by saved statistics, logistic function."""
    from .projections import fill_missing_features
    from .series import standardize
    filled = fill_missing_features(df, list(features)).withColumns({f"_raw_{f}": F.col(f) for f in features})
    scaled = standardize(filled, stats, list(features))
    z = sum((F.col(f) * w for f, w in features.items()), F.lit(float(intercept)))
    return scaled.withColumn(name, sc.sigmoid(z))


def foreign_scores(df: DataFrame, model, features: list[str], name: str = "p") -> DataFrame:
    """Score with any Python model: predict_proba, else a logistic curve of decision_function, else predict.

    The model is broadcast once per executor and called on Arrow batches.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        import numpy as np
        m, x = shared.value, cols.to_numpy(dtype=float)
        if hasattr(m, "predict_proba"):
            p = np.asarray(m.predict_proba(x), dtype=float)
            return pd.Series(p.reshape(p.shape[0], -1)[:, -1])
        if hasattr(m, "decision_function"):
            return pd.Series(1 / (1 + np.exp(-np.asarray(m.decision_function(x), dtype=float).reshape(-1))))
        return pd.Series(np.asarray(m.predict(x), dtype=float).reshape(-1))
    return df.withColumn(name, score(F.struct(*[sc.finite(f).alias(f) for f in features])))


def text_fallback(sessions: DataFrame, session: str) -> DataFrame:
    """The fused score, or the text score alone where there are no features, with the reason."""
    out = sessions.withColumns({
        "score": F.coalesce("p_final", "p_text"),
        "source": F.when(F.col("p_final").isNotNull(), "nlp").when(F.col("p_text").isNotNull(), "nlp_text_fallback").otherwise("none"),
        "reason": F.when(F.col("p_final").isNull(), "no segment features")})
    return out


def select_by_label(df: DataFrame, features: list[str], top: int) -> list[str]:
    """The features most related to the label (ANOVA F)."""
    data = assemble(features).transform(df)
    sel = ft.UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="selected", selectionMode="numTopFeatures")
    model = sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top).fit(data)
    return [features[i] for i in model.selectedFeatures]


def project_pca(df: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """First k principal components of the centred vectors."""
    v = df.withColumn("_v", array_to_vector(vec))
    scaled = ft.StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    out = ft.PCA(k=k, inputCol="_c", outputCol="_p").fit(scaled).transform(scaled)
    parts = vector_to_array("_p")
    return out.select(*[c for c in df.columns if c != vec], *[F.get(parts, F.lit(i)).alias(f"pc{i + 1}") for i in range(k)])


