"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: Characters that separate words in every contract of this subpackage: space, tab to carriage return.
SPACES = r"\x20\x09-\x0D"


def stored(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, purpose)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the files of a ``stored`` table, or one partition folder of it, that nothing reads any more.

    The driver's garbage goes too: Spark frees shuffle files once the plans that wrote them are collected.
    """
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        gc.collect()
        spark._jvm.System.gc()


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with a number behind it where ``df`` already has such a column."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name if not i else f"{name}_{i}" for i in count()) if x.lower() not in taken)


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text alone, named ``doc_id`` and ``text``: clashing extra columns end here."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``narrow`` rows with ``raw``, a 64-bit hash of the text: texts are fetched by id and hash, so an id that many rows bear
    is not one key."""
    return narrow(docs, id_col, text_col).withColumn("raw", F.xxhash64("text"))


def slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` bytes; one text is never cut."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)



def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod).cast("long"))


def with_digest(docs: DataFrame, name: str, text_col: str, digests) -> DataFrame:
    """``docs`` with one more binary column: ``digests`` of each batch of texts (null as empty)."""
    fields = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            out = [d for lo, hi in slices(texts, 1_000_000) for d in digests(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, fields)


def keep_marked(docs: DataFrame, flags: DataFrame, id_col: str, text_col: str, digests) -> DataFrame:
    """The rows of ``docs`` that ``flags`` (doc_id, digest, kept) keeps, unchanged.

    Rows are addressed by id and digest, so null ids and ids with several texts are told apart; of rows that agree in both,
    as many stay as are kept there (one).
    """
    name = free_name(docs, "_digest")
    tagged = with_digest(docs, name, text_col, digests)
    sums = stored(flags.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("stay"))
                  .where("stay < n").select(F.col("doc_id").alias("_of"), F.col("digest").alias("_by"), "stay"), "dropped")
    same = tagged[id_col].cast("long").eqNullSafe(sums["_of"]) & (tagged[name] == sums["_by"])
    rest = tagged.join(sums.hint("merge"), same, "left_anti")  # one plan at every size: the dropped rows grow with the table
    if sums.where("stay > 0").isEmpty():
        return rest.drop(name)
    once = sums.where("stay > 0")
    again = tagged.join(once, tagged[id_col].cast("long").eqNullSafe(once["_of"]) & (tagged[name] == once["_by"]), "left_semi").dropDuplicates([id_col, name])
    return rest.unionByName(again).drop(name)
