"""Readers with explicit schemas and writers for feature, series, report and vector tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as sc


def scan_feature_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def csv_sink(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def scan_series(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";", index: str = "frame_idx",
                first: int | None = None, last: int | None = None) -> DataFrame:
    """Delimited frame series, optionally only the frames first..last."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    if first is not None:
        df = df.where(F.col(index) >= first)
    return df if last is None else df.where(F.col(index) <= last)


def series_sink(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def jsonl_sink(df: DataFrame, path: str) -> None:
    """One JSON object per row and line."""
    df.write.mode("overwrite").json(path)


def report_sink(df: DataFrame, report: str, path: str) -> None:
    """One JSON document per line from a JSON text column."""
    df.select(report).write.mode("overwrite").text(path)


def libsvm_sink(df: DataFrame, label: str, features: list[str], path: str) -> None:
    vec = array_to_vector(F.array(*[F.coalesce(sc.finite(f), F.lit(0.0)) for f in features]))
    df.select(F.col(label).cast("double").alias("label"), vec.alias("features")).write.mode("overwrite").format("libsvm").save(path)


def scan_libsvm(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    df = spark.read.format("libsvm").option("numFeatures", str(len(names))).load(path)
    return df.withColumn("_a", vector_to_array("features")).select("label", *[F.get("_a", F.lit(i)).alias(n) for i, n in enumerate(names)])


def vector_sink(df: DataFrame, path: str, by: list[str]) -> None:
    """Vectors as array columns, one folder per group. Rows are spread inside a folder, so a large group
    becomes many files instead of one task."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


ARFF_KINDS = "numeric|real|integer"


def arff_sink(df: DataFrame, relation: str, path: str) -> None:
    """Header and rows as two text folders below ``path``; unknown values are written as ?."""
    spark = df.sparkSession
    numeric = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    kinds = [f"@attribute {c} {'numeric' if n else 'string'}" for c, n in numeric.items()]
    header = spark.createDataFrame([("\n".join([f"@relation {relation}", *kinds, "@data"]),)], "value string")
    header.write.mode("overwrite").text(f"{path}/0-header")

    def cell(c: str):
        if numeric[c]:
            return F.coalesce(F.col(c).cast("string"), F.lit("?"))
        return F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))
    df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("value")).write.mode("overwrite").text(f"{path}/1-data")


def arff_ingest(spark: SparkSession, path: str, keep_text: tuple[str, ...] = ("name",)) -> DataFrame:
    """Attribute tables below ``path``: names from the header lines, one row per instance.

    ?, unknown, NaN and infinities are null. Only the header of one file is read by the driver: its
    length is the number of columns. All files share the attributes.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.trim("value").alias("l"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")))
    attribute = lines.where(F.lower("l").startswith("@attribute"))
    head = attribute.join(F.broadcast(attribute.agg(F.min("f").alias("f"))), "f")
    names = [r[0] for r in head.orderBy("n").select(F.regexp_extract("l", r"(?i)^@attribute\s+(\S+)", 1)).collect()]
    data = lines.where((F.col("l") != "") & ~F.col("l").rlike("^[@%]"))
    cells = F.transform(F.split("l", ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    row = data.select(cells.alias("c"))

    def column(i: int, name: str):
        raw = F.get("c", F.lit(i))
        return (raw if name in keep_text else sc.to_number(raw)).alias(name)
    return row.select(*[column(i, n) for i, n in enumerate(names)])


def upsert_by_session(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop the old rows of the sessions in the new batch and append the batch; columns may differ."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
