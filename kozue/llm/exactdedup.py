"""Exact deduplication by distributed most-significant-digit radix partitioning.

The first digits are the text's byte length and its first 64 bytes. Spark counts the documents of each group that shares them;
groups that are too crowded for one task and hold different texts are split by the next bytes, counted and split again, until none
is left. So each document has a prefix that is as long as its group needs, and Spark partitions the documents by length and
prefix. Within a partition, the documents that agree so far are split by the next bytes, again and again, until each group is a
single document or its texts have ended; documents that end together are equal, byte by byte, without any digest. The same
splitting also runs before the shuffle over each Arrow batch, so many copies of one text shrink to one a batch before they meet,
and the shuffle carries each text once at most. After it, rows come sorted by length and prefix, so a partition holds the distinct
texts of one group at a time, which the crowd's limit bounds.

Cases: of equal texts the row with the lowest id is kept (null ids last; among equal ids any row, they are alike but for extra
columns); empty texts equal each other; a null text equals nothing and is kept; repeated rows are copies; an empty table gives no
rows. All columns of the input are returned, whatever their names; copies_col must be a name of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import numbered, small
from .kernels import scatter, slices, text_buffers

FIRST_BYTES = 64
#: Bytes of text beyond which a group with different texts is split further in Spark.
CROWD_BYTES = 64 << 20
#: Widths in bytes of successive digits; the last one repeats.
DIGITS = (8, 8, 16, 32, 64, 128, 256, 512, 1024)


def equal_groups(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A group number for each text; equal numbers mean equal bytes."""
    size = np.diff(offsets)
    n = len(size)
    group = np.unique(size, return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, np.int64)
    settled, names = np.zeros(n, np.int64), 0
    active = np.arange(n)
    depth = level = 0
    while len(active):
        count = np.bincount(group)[group]
        done = (count == 1) | (size[active] <= depth)
        if done.any():
            known, number = np.unique(group[done], return_inverse=True)
            settled[active[done]] = names + number
            names += len(known)
            active, group = active[~done], group[~done]
            if not len(active):
                break
        width = DIGITS[min(level, len(DIGITS) - 1)]
        take = np.minimum(width, size[active] - depth)
        digit = np.zeros((len(active), width), np.uint8)  # texts of a group are of one length, so zeros fill up alike
        digit.ravel()[scatter(np.arange(len(active)) * width, take)] = data[scatter(offsets[active] + depth, take)]
        split = np.empty(len(active), [("group", np.int64), ("digit", f"V{width}")])
        split["group"], split["digit"] = group, digit.view(f"V{width}").ravel()
        key = split.view(f"V{8 + width}").ravel()
        group = np.unique(key.view(np.uint64).reshape(len(key), -1), axis=0, return_inverse=True)[1].ravel().astype(np.int64)
        depth, level = depth + width, level + 1
    return settled


def _keep_first(table: pa.Table, text: int, ident: int, copies: int) -> pa.Table:
    """One row of each text, the one of the lowest id, with the copies of its group added up."""
    texts = table.column(text).combine_chunks()
    n = len(texts)
    if n < 2:
        return table
    group = equal_groups(*text_buffers(texts))
    void = np.asarray(texts.is_null().to_numpy(zero_copy_only=False), bool)
    group[void] = n + np.arange(void.sum())  # a null equals nothing
    order = pc.sort_indices(pa.table({"g": group, "i": table.column(ident)}), sort_keys=[("g", "ascending"), ("i", "ascending")]).to_numpy()
    ordered = group[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if len(first) == n:
        return table
    total = np.add.reduceat(table.column(copies).to_numpy()[order], first)
    kept = table.take(pa.array(order[first]))
    return kept.set_column(copies, table.schema.field(copies), pa.array(total, pa.int64()))


def crowded_prefixes(texts: DataFrame, limit: int) -> list[DataFrame]:
    """Groups (size, head) of crowded texts (size, bytes, hash), level by level; a head is a prefix, twice as long at each level. The
    hash only tells a group of copies, which needs no splitting, from one of different texts."""

    def counted(some: DataFrame, width: int) -> DataFrame:
        grouped = some.groupBy("size", F.substring("bytes", 1, width).alias("head")).agg(F.sum("size").alias("weight"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        return grouped.filter((F.col("weight") > limit) & (F.col("low") != F.col("high")) & (F.col("size") > width)).select("size", "head")

    levels: list[DataFrame] = []
    width = FIRST_BYTES
    while True:
        crowded = small(counted(texts, width))
        if crowded.isEmpty():
            return levels
        levels.append(crowded)
        texts = texts.withColumn("head", F.substring("bytes", 1, width)).join(crowded, ["size", "head"], "left_semi").drop("head")
        width *= 2


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies_col: str | None = None, crowd_bytes: int = CROWD_BYTES) -> DataFrame:
    """Rows of df whose text is the first of its kind; copies_col, if given, is added with the number of rows that share it."""
    if copies_col is not None and copies_col.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {copies_col}")
    columns, ids = df.columns, [f"c{k}" for k in range(len(df.columns))]
    text, ident = columns.index(text_col), columns.index(id_col)
    work = numbered(df)
    schema = StructType([*work.schema.fields, StructField("copies", LongType(), False)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 16 << 20):
            yield from _keep_first(pa.Table.from_batches([batch]), text, ident, len(columns)).to_batches()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = range(len(columns) + 1)
        held: list[pa.Table] = []  # rows of the last row's group, which may go on in the next batch
        weight = least = 0
        for batch in slices(batches, text, 16 << 20):
            table = pa.Table.from_batches([batch])
            sizes, heads = table.column(len(columns) + 1), table.column(len(columns) + 2)

            def same(row: pa.Table) -> np.ndarray:
                return pc.and_(pc.equal(sizes, row.column(len(columns) + 1)[-1]), pc.equal(heads, row.column(len(columns) + 2)[-1])).to_numpy()

            goes_on = int(same(held[-1]).sum()) if held else 0
            begin = table.num_rows - int(same(table).sum())
            if goes_on:
                held.append(table.slice(0, goes_on))
                weight += held[-1].nbytes
            if goes_on < table.num_rows:
                if held:
                    yield from _keep_first(pa.concat_tables(held).select(own), text, ident, len(columns)).to_batches()
                if begin > goes_on:
                    yield from _keep_first(table.slice(goes_on, begin - goes_on).select(own), text, ident, len(columns)).to_batches()
                held = [table.slice(begin)]
                weight, least = held[0].nbytes, 0
            # Copies are dropped when a group has doubled since it was last split, so the work stays in proportion to the rows.
            if len(held) > 1 and weight > max(2 * least, 32 << 20):
                held = [_keep_first(pa.concat_tables(held), text, ident, len(columns))]
                weight = least = held[0].nbytes
        if held:
            yield from _keep_first(pa.concat_tables(held).select(own), text, ident, len(columns)).to_batches()

    body = F.col(ids[text]).cast("binary")
    # A null text is no group; spread, it is in nobody's way.
    size = F.coalesce(F.octet_length(ids[text]), -1 - F.pmod(F.hash(ids[ident]), F.lit(4096))).cast("bigint")
    levels = crowded_prefixes(work.filter(F.col(ids[text]).isNotNull()).select(size.alias("size"), body.alias("bytes"), F.xxhash64(ids[text]).alias("hash")), crowd_bytes)
    digits = (
        work.withColumn("copies", F.lit(1).cast("bigint"))
        .mapInArrow(local, schema)
        .withColumn("size", size)
        # Bytes, so that a character cut in two doesn't matter.
        .withColumn("head", F.coalesce(F.substring(body, 1, FIRST_BYTES), F.lit(b"")))
    )
    for k, crowded in enumerate(levels):
        split = crowded.select(F.col("size").alias("c_size"), F.col("head").alias("c_head"))
        digits = digits.join(split, (F.col("size") == F.col("c_size")) & (F.col("head") == F.col("c_head")), "left")
        digits = digits.withColumn("head", F.when(F.col("c_head").isNotNull(), F.substring(body, 1, FIRST_BYTES << k + 1)).otherwise(F.col("head"))).drop("c_size", "c_head")
    out = digits.repartition("size", "head").sortWithinPartitions("size", "head").mapInArrow(grouped, schema)
    if copies_col is None:
        return out.drop("copies").toDF(*columns)
    return out.toDF(*columns, copies_col)
