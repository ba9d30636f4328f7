"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table of few files is moved to have a task for each core.
SMALL = 512 << 20
#: Bytes of the largest row group that one task may have to read; tables with larger ones are moved, whatever their size.
PIECE = 32 << 20
#: Bytes of a table that one task reads, if its row groups aren't larger.
SPLIT = 16 << 20


def in_pieces(spark: SparkSession, path: str, most: int = SPLIT) -> DataFrame:
    """A table whose tasks read `most` bytes each, or one row group. Spark's splits grow with a table up to 128 MB, and the longest task with
    them. Only the scan has that setting, from a copy of the session; all else of the plan is the session's own."""
    copy = spark._jsparkSession.cloneSession()
    copy.conf().set("spark.sql.files.maxPartitionBytes", str(min(most, int(copy.sessionState().conf().filesMaxPartitionBytes()))))
    plan = copy.read().parquet(path).queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def largest_piece(df: DataFrame, least: int = PIECE) -> int:
    """Bytes of the largest row group in the table's files, or `least` if there is none above it. Footers are read of files that are larger
    than that only, so their number is bounded by the table's size."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    largest = least
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        if path.getFileSystem(conf).getFileStatus(path).getLen() > largest:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
            try:
                largest = max(largest, *(b.getCompressedSize() for b in reader.getFooter().getBlocks()), 0)
            finally:
                reader.close()
    return largest


def spread(df: DataFrame, small: int = SMALL, piece: int = PIECE) -> DataFrame:
    """df in two partitions for each core at least, if it is small and comes in fewer files than there are cores, or if it has row groups
    of more than `piece` bytes: a row group is read by one task, however large. Other tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # py4j gives an int or an object
    few = len(df.inputFiles()) < cores and size <= small
    return df.repartition(max(2 * cores, -(-size * 2 // piece))) if few or largest_piece(df, piece) > piece else df


def read_table(spark: SparkSession, folder: str, name: str, most: int | None = None) -> DataFrame:
    """A table of a folder, spread over the cores; its tasks read `most` bytes each, if that is given."""
    path = f"{folder}/{name}.parquet"
    return spread(in_pieces(spark, path, most) if most else spark.read.parquet(path))
