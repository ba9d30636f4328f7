"""Lines of text files and of standard input, in order."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMENT_MODES = ("print", "skip", "analyze")


def read_lines(spark: SparkSession, paths: Iterable[str], recursive: bool = False) -> DataFrame:
    """src, file_no, line_no, line of UTF-8 files: files in the order of the arguments (those of a folder by name), lines as they come.

    Lines are numbered within the blocks that tasks read; a table of a row a block adds what came before."""
    parts = []
    for k, path in enumerate(paths):
        df = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
        parts.append(df.select(F.lit(k).alias("arg"), F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")))
    if not parts:
        return from_lines(spark, [])
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    blocks = lines.groupBy("arg", "src", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("arg", "src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("file_no", F.dense_rank().over(Window.orderBy("arg", "src")) - 1).drop("n")
    return lines.join(blocks, ["arg", "src", "block"]).select("src", "file_no", (F.col("offset") + F.col("id") - F.col("first")).alias("line_no"), "line")


def from_lines(spark: SparkSession, lines: Iterable[str], src: str = "-") -> DataFrame:
    rows = [(src, 0, k, line.rstrip("\n")) for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "src string, file_no int, line_no bigint, line string")


def read_stdin(spark: SparkSession) -> DataFrame:
    return from_lines(spark, sys.stdin)


def comments(lines: DataFrame, mode: str = "print") -> DataFrame:
    """lines with `kind`: "text" is to be analysed, "comment" to be printed as it is. Lines that begin with # are comments unless the
    mode is analyze; skip drops them."""
    if mode not in COMMENT_MODES:
        raise ValueError(f"comment mode is one of {', '.join(COMMENT_MODES)}, not {mode}")
    hashed = F.col("line").startswith("#")
    if mode == "skip":
        lines = lines.filter(~hashed)
    kind = F.when(hashed, "comment").otherwise("text") if mode == "print" else F.lit("text")
    return lines.withColumn("kind", kind)


def treebank_sentences(lines: DataFrame) -> DataFrame:
    """Texts in the comments of a treebank's files."""
    return lines.filter(F.col("line").startswith("# text = ")).select("src", "line_no", F.regexp_replace("line", "^# text = ", "").alias("text"))
