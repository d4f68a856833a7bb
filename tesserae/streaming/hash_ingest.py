"""Incremental ingestion: files arrive in a folder, and only new content is appended to a ledger.

The ledger is dealt into buckets by the first digits of the SHA-256.  A batch opens the buckets of
its own hashes and no other, so that what it reads grows with the batch and with what a bucket
holds, and Parquet's own Bloom filters spare the row groups that lack a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import file_hashes, new_ledger_rows
from ..sources.scratch import materialize
from ..sources.tables import _fs

LEDGER = "path string, md5 string, sha256 string, size long"
#: Digits of a bucket: 256 buckets, the bound on folders that a batch opens.
DIGITS = 2


def bucket(sha256: str = "sha256"):
    return F.substring(sha256, 1, DIGITS).alias("bucket")


def known_hashes(spark: SparkSession, ledger: str, hashes: DataFrame, number: int) -> DataFrame:
    """Ledger rows of the buckets that ``hashes`` fall into, from other batches than ``number``."""
    hit = [r["bucket"] for r in hashes.select(bucket()).distinct().orderBy("bucket").collect()]
    fs, _ = _fs(spark, ledger)
    there = [f"{ledger}/bucket={b}" for b in hit if fs.exists(_fs(spark, f"{ledger}/bucket={b}")[1])]
    if not there:
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.option("basePath", ledger).schema(f"{LEDGER}, bucket string, batch long").parquet(*there)
    return rows.filter(F.col("batch") != number).drop("bucket", "batch")


def append_batch(files: DataFrame, ledger: str, number: int) -> None:
    """Append the first files of hashes that the ledger lacks; a batch that runs again replaces its rows."""
    spark = files.sparkSession
    hashes = materialize(file_hashes(files), "hashes")
    known = known_hashes(spark, ledger, hashes, number)
    new = new_ledger_rows(hashes, known).select("path", "md5", "sha256", "size", bucket(), F.lit(number).cast("long").alias("batch"))
    new = new.repartition(F.col("bucket")).sortWithinPartitions("bucket", "sha256")
    writer = new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#sha256", "true")
    writer.partitionBy("bucket", "batch").parquet(ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of the ledger."""
    fs, at = _fs(spark, ledger)
    if not fs.exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(f"{LEDGER}, bucket string, batch long").parquet(ledger).drop("bucket", "batch")


def ingest_available(spark: SparkSession, source: str, schema: str, ledger: str, checkpoint: str, to_files) -> DataFrame:
    """Run one stream over what is in ``source`` (Parquet) and return the ledger.

    ``to_files`` maps a batch to ``path, content``.  Each batch is hashed, first occurrences
    that the ledger lacks are appended: the result is that of one pass over all files.
    Rows are kept by batch number: a batch that runs again replaces its own.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, number: append_batch(to_files(batch), ledger, number))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_ledger(spark, ledger)
