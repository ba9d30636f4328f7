"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Signatures of 3-word shingles are cut into bands; documents that agree in a band are candidates. The signatures of a candidate
pair are compared batch by batch. After n compared values of which m agree, the similarity has the posterior Beta(1+m, 1+n-m);
the pair is dropped as soon as the posterior probability of a similarity of at least the threshold falls under the miss
probability. Survivors are verified exactly, by the Jaccard similarity of their shingle sets.

Equal texts are one text throughout.

Cases: a row with a null text is in no pair and a class of its own; a null id is in no pair, but its text counts in classes, which
are named by their lowest id that isn't null (the filter keeps rows with a null text; of copies and of groups it keeps the row of
the lowest id, null ids last); a text with no word is near its own copies only; a text of one or two words has itself as its only
shingle; repeated rows are copies; an id that several texts have names each of them; an empty table gives no rows. Other columns
don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, content_key, fresh, small
from .graph import components
from .kernels import U64, Words, mix, release, slices, text_buffers, whitespace_table, windows

SHINGLE = 3
THRESHOLD = 0.45
BANDS, ROWS = 40, 4
BATCH = 16
#: Probability at which a pair above the threshold may be dropped at a batch.
MISS = 0.005


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each text on end, sorted within a text, and where each text's begin."""
    data, offsets = text_buffers(texts)
    words = Words(data, offsets, whitespace_table())
    n = len(words.hash)
    grams = windows(words.hash, size)
    whole = np.zeros(n, np.uint64)
    whole[: len(grams)] = grams
    row = words.row()
    count = np.diff(words.first)
    place = np.arange(n) - words.first[row]
    good = place <= count[row] - size
    # A text shorter than a shingle has itself as its only one.
    for k in range(1, size):
        short = np.flatnonzero((count[row] == k) & (place == 0))
        if len(short):
            whole[short] = mix(sum(words.hash[short + j] * U64(2 * j + 3) for j in range(k)) + U64(k))
            good[short] = True
    row, value = row[good], whole[good]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


@lru_cache(4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, 1 << 63, n, np.uint64) * U64(2) + U64(1), r.integers(0, 1 << 63, n, np.uint64)


def signatures(values: np.ndarray, begins: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n minima for each text that has shingles: 32 bits of multiplied and shifted fingerprints."""
    filled = np.flatnonzero(np.diff(begins))
    out = np.zeros((len(begins) - 1, n), np.uint32)
    if len(filled):
        at = begins[:-1][filled]
        for k, (a, b) in enumerate(zip(*_permutations(n), strict=True)):
            out[filled, k] = np.minimum.reduceat(((values * a + b) >> U64(32)).astype(np.uint32), at)
    return out


@lru_cache(8)
def least_agreements(n: int, threshold: float, miss: float) -> int:
    """The fewest agreements among n values at which the posterior of similarity >= threshold is at least `miss`."""
    # With a uniform prior, P(s >= t | m of n) is the probability of at most m successes in n + 1 draws at t.
    tail = 0.0
    for m in range(n + 2):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


def sequential_survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float, batch: int = BATCH) -> np.ndarray:
    """Rows of two signature matrices that outlast every batch."""
    alive, agree, n = np.arange(len(left)), np.zeros(len(left), np.int64), left.shape[1]
    for at in range(0, n, batch):
        to = min(at + batch, n)
        agree = agree + (left[alive, at:to] == right[alive, at:to]).sum(1)
        stay = agree >= least_agreements(to, threshold, miss)
        alive, agree = alive[stay], agree[stay]
    return alive


def _signed(texts: DataFrame, n: int, size: int) -> DataFrame:
    """key, sig of each text that has shingles; texts: key, text."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, begins = shingle_sets(batch.column(1), size)
            keep = np.flatnonzero(np.diff(begins))
            if len(keep):
                sig = signatures(values, begins, n)[keep]
                ends = np.arange(0, sig.nbytes + 1, 4 * n, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), packed], ["key", "sig"])

    return texts.mapInArrow(stage, "key binary, sig binary")


def band_codes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The codes of each signature's bands."""
    sig = sig.reshape(-1, rows, bands)
    code = np.zeros((len(sig), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        code = mix(code * U64(31) + sig[:, r].astype(np.uint64) + U64(1))
    return code


def _banded(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """key and the codes of its bands."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code = band_codes(np.frombuffer(text_buffers(batch.column(1))[0], np.uint32), bands, rows)
            codes = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(code.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], ["key", "bands"])

    return signed.mapInArrow(stage, "key binary, bands array<bigint>")


def _sequential(threshold: float, miss: float, batch: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                left, right = (np.frombuffer(text_buffers(part.column(c))[0], np.uint32).reshape(part.num_rows, -1) for c in (2, 3))
                yield part.select([0, 1]).take(pa.array(sequential_survivors(left, right, threshold, miss, batch)))

    return stage


def _jaccards(va: np.ndarray, ba: np.ndarray, left: np.ndarray, vb: np.ndarray, bb: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities of the left and right texts of two collections of shingle sets."""
    out = np.zeros(len(left))
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = va[ba[i] : ba[i + 1]], vb[bb[j] : bb[j + 1]]
        both = len(np.intersect1d(a, b, assume_unique=True))
        out[k] = both / max(1, len(a) + len(b) - both)
    return out


def _exact(threshold: float, size: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                (va, ba), (vb, bb) = shingle_sets(some.column(2), size), shingle_sets(some.column(3), size)
                every = np.arange(some.num_rows)
                out = _jaccards(va, ba, every, vb, bb, every)
                good = np.flatnonzero(out >= threshold)
                yield pa.RecordBatch.from_arrays([*some.select([0, 1]).take(pa.array(good)).columns, pa.array(out[good])], ["a", "b", "jaccard"])

    return stage


def near_texts(keyed: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, miss: float = MISS, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b, jaccard) of keys of distinct texts, and the components (node, root) that they make; keyed: key, text,
    one row or more for a text.

    A family of n near copies has n squared pairs, which groups don't need. First, each member of a band's bucket is compared with
    the bucket's least one only, and of those that it may be near to, verified with one. What these pairs connect is contracted;
    then every other pair of a bucket that still lies in two components is compared and verified. So no candidate that could
    connect two groups is left out.
    """
    signed = checkpointed(_signed(keyed, bands * rows, size).groupBy("key").agg(F.first("sig").alias("sig")))
    # Counts are aggregated before they move, so a crowded band is no single task's; joins by band are split where they are skewed.
    banded = _banded(signed, bands, rows).select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("center"), F.max("key").alias("most")).filter("center <> most").select("band", "center")
    crowded = checkpointed(banded.join(buckets, "band").select("key", "band", "center"))

    def maybe_near(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(signed.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a")
            .join(signed.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
            .select("a", "b", "sa", "sb")
            .mapInArrow(_sequential(threshold, miss, batch), "a binary, b binary")
        )

    def verified(pairs: DataFrame) -> DataFrame:
        involved = small(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        texts = keyed.join(involved, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        both = (
            pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb")
        )
        return checkpointed(both.mapInArrow(_exact(threshold, size), "a binary, b binary, jaccard double"))

    spokes = checkpointed(maybe_near(crowded.filter("key <> center").select(F.col("center").alias("a"), F.col("key").alias("b")).distinct()))
    first = checkpointed(spokes.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    edges = verified(first)
    roots = components(edges)

    def rooted(pairs: DataFrame, key: str, root: str) -> DataFrame:
        of = roots.select(F.col("node").alias(key), F.col("root").alias("of"))
        return pairs.join(of, key, "left").withColumn(root, F.coalesce("of", key)).drop("of")

    placed = rooted(crowded, "key", "root")
    several = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("band")
    mixed = checkpointed(placed.join(several, "band"))
    others = (
        mixed.select("band", "center", F.col("key").alias("a"), F.col("root").alias("ra"))
        .join(mixed.select("band", F.col("key").alias("b"), F.col("root").alias("rb")), "band")
        .filter("a < b and ra <> rb and a <> center")  # those of the center are among the spokes
        .select("a", "b")
        .distinct()
    )
    apart = rooted(rooted(spokes.join(first, ["a", "b"], "left_anti"), "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b")
    edges = edges.unionByName(verified(checkpointed(maybe_near(others).union(apart).distinct())))
    return edges, components(edges)


#: Weight of a block of a component's texts: characters, and TEXT_WEIGHT for each text (250 short texts at most).
BLOCK_WEIGHT, TEXT_WEIGHT = 4_000_000, 16_000
#: Pairs of texts whose bands are compared at a time.
PAIRS = 20_000


def _within(threshold: float, bands: int, rows: int, batch: int, miss: float, size: int, counted: bool):
    """Verified pairs of rows i, j, block, key, text, root, that come sorted by root, i, j: of block i with block j, and within a block
    if i = j. If counted, keys and how many pairs they are in instead."""

    def pairs(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = np.array(group.column("key").to_pylist(), object)
        block, first, second = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        values, begins = shingle_sets(group.column("text"), size)
        sig = signatures(values, begins, bands * rows)
        codes = band_codes(sig, bands, rows)
        if first == second:
            left, right = np.triu_indices(len(keys), 1)
        else:
            left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == first), np.flatnonzero(block == second), indexing="ij"))
        links = np.zeros(len(keys), np.int64)
        for at in range(0, len(left), PAIRS):
            a, b = left[at : at + PAIRS], right[at : at + PAIRS]
            found = np.flatnonzero((codes[a] == codes[b]).any(1))
            a, b = a[found], b[found]
            alive = sequential_survivors(sig[a], sig[b], threshold, miss, batch)
            a, b = a[alive], b[alive]
            out = _jaccards(values, begins, a, values, begins, b)
            good = np.flatnonzero(out >= threshold)
            if counted:
                links += np.bincount(a[good], minlength=len(keys)) + np.bincount(b[good], minlength=len(keys))
                continue
            a, b = keys[a[good]], keys[b[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).tolist(), pa.binary()), pa.array(np.maximum(a, b).tolist(), pa.binary()), pa.array(out[good])], ["a", "b", "jaccard"])
        if counted:
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].tolist(), pa.binary()), pa.array(links[some])], ["key", "n"])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for part in batches:
            groups = list(zip(*(part.column(c).to_pylist() for c in ("root", "i", "j")), strict=True))
            starts = [k for k in range(len(groups)) if not k or groups[k] != groups[k - 1]]
            for at, to in zip(starts, [*starts[1:], len(groups)], strict=True):
                if held and groups[at] != now:
                    yield from pairs(pa.concat_batches(held))
                    held = []
                now = groups[at]
                held.append(part.slice(at, to - at))
        if held:
            yield from pairs(pa.concat_batches(held))
        release()

    return stage


def _members(groups: DataFrame) -> DataFrame:
    """key, root of all texts of components of two or more."""
    return small(groups.select(F.col("node").alias("key"), "root").union(groups.select("root", "root")).distinct())


def near_text_pairs(keyed: DataFrame, members: DataFrame, counted: bool = False, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, miss: float = MISS, size: int = SHINGLE) -> DataFrame:
    """All verified candidates: pairs a < b of keys of distinct near texts, with their exact similarity (a, b, jaccard); if counted,
    the number of such pairs by key (key, n). keyed: key, text; members: key, root.

    Both texts of a verified pair are in one component, so within each component every two texts are looked at again: those that
    agree in a band are compared batch by batch, survivors verified. A component's texts are cut into blocks and every two blocks
    meet in a task; so a text moves once for each block of its component, not once for each of its pairs.
    """
    texts = keyed.join(members, "key").groupBy("key", "root").agg(F.first("text").alias("text"))
    weights = keyed.select("key", F.length("text").alias("length")).join(members, "key").groupBy("key", "root").agg(F.max("length").alias("length"))
    last = weights.groupBy("root").agg(F.floor(F.sum(F.col("length") + TEXT_WEIGHT) / BLOCK_WEIGHT).cast("int").alias("last"))
    placed = texts.join(small(last), "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("last") + 1).cast("int"))
    meeting = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "text")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = meeting.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = sorted_.mapInArrow(_within(threshold, bands, rows, batch, miss, size, counted), "key binary, n bigint" if counted else "a binary, b binary, jaccard double")
    return found.groupBy("key").agg(F.sum("n").alias("n")) if counted else found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Members of groups of near or equal texts, each with its group's lowest id: doc_a, doc_b. A group is a connected component of
    verified pairs."""
    named = df.select(col(id_col).alias("id"), col(text_col).alias("text")).filter("id is not null and text is not null")
    keyed = named.select(content_key(F.col("text")).alias("key"), "id", "text")
    _, groups = near_texts(keyed.select("key", "text"), **options)
    ids = keyed.select("key", "id").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    leaders = ids.groupBy("root").agg(F.min("id").alias("doc_a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.join(leaders, "root").filter("id <> doc_a").select("doc_a", F.col("id").alias("doc_b")).distinct()


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pairs of ids: the firsts (lowest ids) of all near texts, with their exact similarity, and each copy with the first of its text
    (jaccard 1). Columns doc_a < doc_b, jaccard. A family of n texts that are all near each other has n squared / 2 of them."""
    named = df.select(col(id_col).alias("id"), col(text_col).alias("text")).filter("id is not null and text is not null")
    keyed = named.select(content_key(F.col("text")).alias("key"), "id", "text")
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = keyed.select("key", "id").join(firsts.filter("n > 1"), "key").select(F.col("first").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    ids = firsts.select("key", "first")
    texts = keyed.select("key", "text")
    near = (
        near_text_pairs(texts, _members(near_texts(texts, **options)[1]), **options)
        .join(ids.select(F.col("key").alias("a"), F.col("first").alias("fa")), "a")
        .join(ids.select(F.col("key").alias("b"), F.col("first").alias("fb")), "b")
        .select(F.least("fa", "fb").alias("doc_a"), F.greatest("fa", "fb").alias("doc_b"), "jaccard")
    )
    # Only where an id names several texts has a pair of ids several similarities.
    return near.unionByName(copies).filter("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of df: doc_id; class_id, the lowest id of its connected component of near and equal texts; n_links, the
    number of other texts that are verified to be near its own; n_copies, the rows that have its very text."""
    named = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    keyed = named.filter("text is not null").select(content_key(F.col("text")).alias("key"), "id", "text")
    texts = keyed.select("key", "text")
    members = _members(near_texts(texts, **options)[1])
    links = near_text_pairs(texts, members, True, **options).withColumnRenamed("n", "n_links")
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_copies")).join(members, "key", "left")
    several = firsts.filter("root is not null")
    classes = several.groupBy("root").agg(F.min("first").alias("class_id"))
    found = several.join(classes, "root").join(links, "key", "left").select("key", "class_id", "n_links", "n_copies")
    copies = firsts.filter("root is null and n_copies > 1").select("key", F.col("first").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "n_copies")
    of_text = named.select("id", content_key(F.col("text")).alias("key")).join(small(found.unionByName(copies)), "key", "left")
    return of_text.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of df, one for each group of near or equal texts: the one of the lowest id."""
    key, mark, several, rank = fresh(df, "key", "mark", "several", "rank")
    keyed = df.filter(col(text_col).isNotNull()).select(content_key(col(text_col)).alias("key"), col(text_col).alias("text"), col(id_col).alias("id"))
    _, groups = near_texts(keyed.select("key", "text"), **options)
    rooted = groups.select(F.col("node").alias("key"), "root").union(groups.select("root", "root").distinct())
    # Narrow rows decide which text stays of each group, and which texts have copies; no text moves but that of copies.
    texts = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).join(rooted, "key", "left")
    by_group = Window.partitionBy(F.coalesce("root", "key")).orderBy(F.col("id").asc_nulls_last(), "key")
    marks = (
        texts.withColumn("place", F.when(F.col("root").isNull(), 1).otherwise(F.row_number().over(by_group)))
        .filter("place > 1 or n > 1")
        .select(F.col("key").alias(mark), (F.col("place") == 1).alias(several))
    )
    marked = df.withColumn(key, content_key(col(text_col))).join(small(marks), F.col(key) == F.col(mark), "left")
    columns = [col(c) for c in df.columns]
    order = Window.partitionBy(F.col(key)).orderBy(col(id_col).asc_nulls_last())
    copies = marked.filter(F.col(several)).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return marked.filter(F.col(mark).isNull()).select(*columns).unionByName(copies.select(*columns))
