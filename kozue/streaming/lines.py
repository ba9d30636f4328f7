"""Lines as a stream: analysis has no state over lines, so a stream's plan is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.formats import formatted
from ..plans.registry import Settings, analyse


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of files as they appear in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def read_socket(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    """Lines from a socket, as typed; for interactive use."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def analyse_stream(lines: DataFrame, settings: Settings | None = None, choice: str = "conllu") -> DataFrame:
    """doc_id (a hash of the line), sent_id, out of a stream of lines (value); comment lines are dropped."""
    named = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.xxhash64("value").alias("doc_id"), F.lit(0).alias("sent_id"), F.col("value").alias("text"))
    return formatted(analyse(named, settings, choice != "mecab"), choice)


def write_stream(out: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Exactly once to Parquet files."""
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
