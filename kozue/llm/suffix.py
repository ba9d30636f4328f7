"""Passages that repeat, by distributed prefix doubling over the suffixes that begin at words.

A word position's rank stands for the first words of its suffix: equal ranks, equal words. Spark sorts positions by the pair of
their rank and the rank as many words on, which ranks them by twice as many words; those that are alone with their pair are unique
and drop out, the others get the name of their pair as their new rank. Offsets grow until the threshold is reached (13, 26, 50
words by default); what then shares its pair with another position begins a passage of at least that many words that occurs twice
or more in the corpus, within one text or in several. Overlapping ones are joined.

To begin with, not every suffix is ranked. Of each run of positions that a passage of threshold length spans, the one whose first
h words have the least fingerprint is sorted (the leftmost of equal ones). Wherever a passage occurs, the same position within it
is chosen, so a passage of threshold length that repeats always has a chosen position whose first h words repeat; only passages
around those go on to the doubling. Nothing that repeats is lost, and some 5 % of the positions are sorted first.

A position is one number, its document's and its place. The first ranks are 64-bit fingerprints of h words; a later rank is the name
of a pair, its least position, so later ranks are exact. Two different passages pass for equal with a chance of about 2^-128 a pair,
as both first ranks of a pair must coincide.

No group is gathered in one task: counts are aggregated before they move, joins by rank are split where they are skewed, and pairs
that a sample of positions finds to hold more than a part of a partition are counted and joined apart from the others.

Words are what lies between ASCII white space. Cases: null and shorter texts hold no passage; repeated rows and equal texts repeat
each other; an id that several texts have is reported for each; null ids are reported as null; extra columns don't matter; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, small, written
from .kernels import U64, Words, release, slices, text_buffers, whitespace_table, windows

THRESHOLD = 50
#: Documents (8 bytes each) up to which those that hold a repeated start are sent to all executors; beyond it, they are joined.
BROADCAST_DOCS = 1_000_000
#: Positions that share a pair, from which on the pair is counted apart; a quarter of a partition, but never fewer than this.
HOT = 50_000
#: One of so many positions is sampled to find such pairs.
SAMPLE = 64
#: Bits of a position that hold the place in the document.
PLACE_BITS = 28


def least_in_runs(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of its least one, the leftmost of equal ones."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        reach += step
    return at


class _Texts:
    """Words of a batch, and the ranks of all runs of h words."""

    def __init__(self, texts: pa.Array, h: int):
        self.words = Words(*text_buffers(texts), whitespace_table())
        n = len(self.words.hash)
        self.rank = np.zeros(n, np.uint64)
        grams = windows(self.words.hash, h)
        self.rank[: len(grams)] = grams
        self.row = self.words.row()
        self.place = np.arange(n) - self.words.first[self.row]
        self.count = np.diff(self.words.first)


def _starts(texts: DataFrame, threshold: int, h: int) -> DataFrame:
    """doc, at, rank of the chosen positions; texts: doc, text."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            t = _Texts(batch.column(1), h)
            least = least_in_runs(t.rank, threshold - h + 1)
            whole = t.place[: len(least)] <= t.count[t.row[: len(least)]] - threshold
            at = np.unique(least[whole])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t.row[at])), pa.array(t.place[at].astype(np.int32)), pa.array(t.rank[at].view(np.int64))], ["doc", "at", "rank"])

    return texts.mapInArrow(stage, "doc bigint, at int, rank bigint")


def _ranked(texts: DataFrame, threshold: int, h: int, step: int, one_in: int = 1) -> DataFrame:
    """at, r1, r2 of the positions within passages of threshold length whose chosen position repeats: the position, and the ranks of it
    and of the one `step` words on, by h words. texts: number, text, starts."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            t = _Texts(batch.column(1), h)
            n = len(t.rank)
            number, starts = batch.column(0).to_numpy(), batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
            repeats = np.zeros(n, bool)
            repeats[t.words.first[:-1][row] + starts.flatten().to_numpy()] = True
            least = least_in_runs(t.rank, threshold - h + 1)
            begins = np.flatnonzero(repeats[least] & (t.place[: len(least)] <= t.count[t.row[: len(least)]] - threshold))
            # Later rounds look further into the passage.
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, begins, 1)
            np.add.at(depth, begins + threshold - h - step + 1, -1)
            at = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
            if one_in > 1:
                at = at[t.rank[at] * U64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * U64(0xBF58476D1CE4E5B9) >> U64(32) & U64(one_in - 1) == 0]
            # A row of the result takes 24 bytes and more: a batch is no larger than what goes into one.
            for k in range(0, len(at), 50_000):
                p = at[k : k + 50_000]
                ranks = [pa.array(t.rank[q].view(np.int64)) for q in (p, p + step)]
                yield pa.RecordBatch.from_arrays([pa.array(number[t.row[p]] << PLACE_BITS | t.place[p]), *ranks], ["at", "r1", "r2"])

    return texts.mapInArrow(stage, "at bigint, r1 bigint, r2 bigint")


def _ahead(ranked: DataFrame, step: int) -> DataFrame:
    """at, r1, r2 of the positions of ranked (at, r1) that have one `step` words on."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = rank = np.zeros(0, np.int64)
        for batch in batches:
            at, rank = (np.concatenate((x, batch.column(k).to_numpy())) for k, x in enumerate((at, rank)))
            # Positions whose partner may still come are held; a step is at most as many.
            cut = int(np.searchsorted(at, at[-1] - step)) if len(at) else 0
            if cut:
                yield pairs(at, rank, cut)
                at, rank = at[cut:], rank[cut:]
        if len(at):
            yield pairs(at, rank, len(at))
        release()

    def pairs(at: np.ndarray, rank: np.ndarray, n: int) -> pa.RecordBatch:
        to = np.minimum(np.searchsorted(at, at[:n] + step), len(at) - 1)
        found = np.flatnonzero(at[to] == at[:n] + step)
        return pa.RecordBatch.from_arrays([pa.array(at[found]), pa.array(rank[found]), pa.array(rank[to[found]])], ["at", "r1", "r2"])

    by_document = ranked.repartition(F.shiftright("at", PLACE_BITS)).sortWithinPartitions("at")
    return by_document.mapInArrow(stage, "at bigint, r1 bigint, r2 bigint")


def _spans(threshold: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, first, size = [], [], []
            for k in range(batch.num_rows):
                at = np.unique(batch.column(1)[k].values.to_numpy())
                cut = np.flatnonzero(np.diff(at) > threshold)
                begin, end = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + threshold
                doc += [k] * len(begin)
                first += begin.tolist()
                size += (end - begin).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(first, pa.int32()), pa.array(size, pa.int32())], ["doc", "first_word", "n_words"])

    return stage


def _shared(pairs: DataFrame, hot: DataFrame | None) -> DataFrame:
    """at, name of the positions that share their pair of ranks with another; pairs: at, r1, r2; hot: r1, r2."""
    by_pair = Window.partitionBy("r1", "r2")

    def sort(some: DataFrame) -> DataFrame:
        return some.withColumn("n", F.count(F.lit(1)).over(by_pair)).withColumn("name", F.min("at").over(by_pair)).filter("n > 1").select("at", "name")

    if hot is None:
        return sort(pairs)
    hot = F.broadcast(hot)  # at most four for each partition
    crowded = pairs.join(hot, ["r1", "r2"], "left_semi")
    names = crowded.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("name")).filter("n > 1")
    return sort(pairs.join(hot, ["r1", "r2"], "left_anti")).union(crowded.join(names, ["r1", "r2"]).select("at", "name"))


def _hot(sample: DataFrame, one_in: int, least: int) -> DataFrame | None:
    """The pairs that hold more than a quarter of a partition's positions, by a sample."""
    parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = checkpointed(sample.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, least // one_in // 4)))
    total = sample.count()
    hot = counted.filter(F.col("n") > max(least // one_in, total // (4 * parts))).select("r1", "r2")
    return None if hot.isEmpty() else hot


def _numbered(starts: DataFrame) -> DataFrame:
    """starts with the documents' dense numbers. What the driver gets is a row a partition."""
    starts = checkpointed(starts.withColumn("id", F.monotonically_increasing_id()))
    part, sizes = F.shiftright("id", 33).cast("int"), {}
    for r in starts.groupBy(part.alias("part")).count().collect():
        sizes[r["part"]] = r["count"]
    before = [sum(sizes.get(p, 0) for p in range(k)) for k in range(max(sizes, default=0) + 1)]
    return starts.withColumn("number", F.get(F.lit(before), part) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id")


def repeated_positions(texts: DataFrame, threshold: int, h: int, hot: int = HOT, one_in: int = SAMPLE) -> DataFrame:
    """doc, places: where in a document passages of `threshold` words begin that occur again; texts: doc, text, one row a document."""
    found = written(_starts(texts, threshold, h))
    shared = found.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    starts = _numbered(found.join(shared, "rank").groupBy("doc").agg(F.collect_set("at").alias("starts"), F.max("n").alias("most")))
    # A crowded pair has a crowded start nearby; only where one comes near a part of a partition is it worth looking for such pairs.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most, total = starts.agg(F.max("most"), F.sum(F.size("starts"))).first()
    positions = (total or 0) * (threshold - h + 2) // 2
    crowded = (most or 0) > max(hot // 8, positions // (8 * parts)) or one_in == 1
    # Only texts that hold a repeated start are moved.
    around = texts.join(small(starts.select("doc"), BROADCAST_DOCS), "doc", "left_semi").join(starts, "doc").select("number", "text", "starts")
    length, step = h, min(h, threshold - h)
    now = _ranked(around, threshold, h, step)
    sample = _ranked(around, threshold, h, step, one_in) if crowded else None
    while True:
        length += step
        again = _shared(now, _hot(sample, one_in, hot) if crowded else None)
        if length >= threshold:
            break
        ranked = written(again.select("at", F.col("name").alias("r1")))
        step = min(length, threshold - length)
        now = _ahead(ranked, step)
        sample = now.filter(F.pmod(F.xxhash64("at"), F.lit(one_in)) == 0) if crowded else None
    place = F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    places = again.groupBy(F.shiftright("at", PLACE_BITS).alias("number")).agg(F.collect_set(place).alias("places"))
    return places.join(starts.select("number", "doc"), "number").select("doc", "places")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, first: int | None = None, **options) -> DataFrame:
    """Maximal runs of words that are covered by repeated passages: doc_id, first_word (from 0), n_words.

    first: words that the first ranks stand for, a quarter of the threshold unless given."""
    if threshold < 2:
        raise ValueError("a passage has two words at least")
    h = -(-threshold // 4) if first is None else max(1, min(first, threshold - 1))
    texts = df.select(F.xxhash64(col(id_col), col(text_col)).alias("doc"), col(text_col).alias("text"), col(id_col).alias("doc_id")).filter("text is not null")
    at = repeated_positions(texts.select("doc", "text"), threshold, h, **options)
    spans = at.mapInArrow(_spans(threshold), "doc bigint, first_word int, n_words int")
    return spans.join(texts.select("doc", "doc_id"), "doc").select("doc_id", "first_word", "n_words")
