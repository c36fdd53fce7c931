"""Files that arrive one after the other, encoded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans import advisor
from lattica.sources.blobs import segments


def encode_folder(spark: SparkSession, source: str, sink: str, checkpoint: str, o: advisor.Options | None = None, segment: int = 1 << 20):
    """Start a query that encodes each file put into ``source`` into rows of ``sink`` (parquet), once each.

    Files are cut into segments, so a row stays small however large its file is; every segment is decoded and
    compared before it is written.  ``decode_folder`` gives the files back.
    """
    o = o or advisor.Options()
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(source)
        .select(F.col("path").alias("blob_id"), "content")
    )

    def write(batch: DataFrame, number: int) -> None:
        # A folder for each batch: one that is tried again replaces what it wrote.
        advisor.encoded(segments(batch, segment), o, "segment").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decode_folder(spark: SparkSession, sink: str) -> DataFrame:
    """``blob_id, segment, content`` in segments; their order is the file."""
    return advisor.decoded(spark.read.parquet(sink), "segment")
