"""Corpus entries as a stream: a bounded pull of new files, and the same operators on what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import grid


def documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files_a_batch: int = 100) -> DataFrame:
    """Parquet documents as they arrive, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def entries(spark: SparkSession, root: str, pattern: str = "*", files_a_batch: int = 100) -> DataFrame:
    """New files of a corpus with the folder they belong to."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    return files.withColumn("entry", F.regexp_extract("path", r"([^/]+\.d)/", 1))


def marked(stream: DataFrame, regex: str, column: str = "entry") -> DataFrame:
    """Rows marked ``run`` or ``skip`` by a filter on their descriptor; none is dropped."""
    return stream.withColumn("status", F.when(F.col(column).rlike(f"^(?:{regex})$"), "run").otherwise("skip"))


def text_grids(stream: DataFrame) -> DataFrame:
    """Cells of the texts that arrive; the batch operator works on a stream as it stands."""
    return grid.from_text(stream)


def drain(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Writes all there is now and stops; run again it goes on where it left off, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(partition) if partition else writer).start()
