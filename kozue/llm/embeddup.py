"""Near-duplicate embeddings by an exact metric range join.

Vectors are scaled to length 1; a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c). Pivots partition the
vectors: each has its home in the cell of its nearest pivot. If x has its home in cell i and y in cell j, and d(x, y) <= r, then
by the triangle inequality d(x, p_j) <= d(y, p_j) + r <= d(y, p_i) + r <= d(x, p_i) + 2r; x visits the later cells within that
bound, and within r of the plane between the two pivots. So each pair meets in one cell, and cells join independently. Cells of
many vectors are cut into blocks that are held one at a time while the rest of the cell streams by.

Classes are the connected components of such pairs. Cells don't send their pairs on, which a family of copies has n squared of:
each adds up the links of its vectors and reduces what they connect to a forest. Equal vectors are one vector in all that.

Cases: null vectors and those with a null or not finite number or of length 0 are in no pair and classes of their own; vectors of
different dimensions are never near; ties and repeated rows are vectors of their own; a null id counts as a link of others, but
names no class. Pairs have no null id, no equal ids, and a pair of ids only once, with its highest cosine. Extra columns don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, col, small
from .graph import components

COSINE = 0.95
#: Vectors a pivot should have; pivots are at most so many, which bounds what goes to every executor. Vectors of a block.
CELL, MAX_PIVOTS, BLOCK = 8192, 2048, 8192
SLACK = 1e-6  # distances are computed with rounding; a pair is decided by its cosine


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit vectors from packed doubles of one dimension."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _unit(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dims, v (packed unit vector, null where there is none)."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = [], []
            values = batch.column(1).cast(pa.list_(pa.float64()))
            for k in range(batch.num_rows):
                item = values[k]
                v = item.values.to_numpy(zero_copy_only=False) if item.is_valid else np.zeros(0)
                norm = np.linalg.norm(v) if len(v) else 0.0
                good = norm > 0 and math.isfinite(norm)
                dims.append(len(v))
                out.append((v / norm).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dims", "v"])

    named = df.select(col(id_col).alias("id"), col(vector_col).alias("v"))
    return named.mapInArrow(stage, f"id {named.schema['id'].dataType.simpleString()}, dims int, v binary")


def _homes(unit: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], radius: float) -> DataFrame:
    """id, v, n, home cell and the later cells that a vector visits; unit: id, dims, v, n; pivots: by dimension, the number of the
    first cell and the pivots."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                first, p = pivots[int(d)]
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                for at in range(0, part.num_rows, 2000):
                    some = part.slice(at, 2000)
                    far = np.sqrt(np.maximum(2 - 2 * _matrix(some.column(2)) @ p.T, 0))
                    home = far.argmin(1)
                    near = far[np.arange(len(far)), home][:, None]
                    to_plane = (far**2 - near**2) / np.maximum(2 * apart[home], 1e-12)
                    visits = (far <= near + 2 * radius + SLACK) & (to_plane <= radius + SLACK) & (np.arange(len(p)) > home[:, None])
                    ends = np.concatenate(([0], np.cumsum(visits.sum(1)))).astype(np.int32)
                    cells = pa.ListArray.from_arrays(ends, pa.array((np.nonzero(visits)[1] + first).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array((home + first).astype(np.int32)), cells], ["id", "v", "n", "home", "visits"])

    return unit.mapInArrow(stage, f"id {unit.schema['id'].dataType.simpleString()}, v binary, n bigint, home int, visits array<int>")


def merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label with the components of u and v merged, edge by edge. Labels are least members, and stay so."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(then := label[label], label):
            label = then


def _join_blocks(cosine: float, kind: str, counted: bool):
    """Rows cell, block, probe, id, n, v come sorted by the first three: a block's own vectors, then those that stream by. Gives pairs
    (a, b, cosine), or if counted, (a, n, b): the weight of what vector a is near to in this block, and one it is connected with."""

    def near(a: np.ndarray, b: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(a), 1024):
            c = a[at : at + 1024] @ b.T
            hit = c >= cosine - 1e-12
            if within:
                hit &= np.arange(len(b)) > (at + np.arange(len(c)))[:, None]
            x, y = np.nonzero(hit)
            if len(x):
                yield at + x, y, np.minimum(c[x, y], 1.0)

    class Block:
        def __init__(self, kind: pa.DataType):
            self.kind = kind
            self.parts: list[tuple] = []
            self.v: np.ndarray | None = None

        def pairs(self, a, b, c) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, self.kind), pa.array(b, self.kind), pa.array(c)], ["a", "b", "cosine"])

        def counts(self, a, n, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, self.kind), pa.array(n), pa.array(b, self.kind)], ["a", "n", "b"])

        def settle(self) -> Iterator[pa.RecordBatch]:
            if self.v is not None or not self.parts:
                return
            self.v, self.id, self.n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = []
            self.links, self.label = np.zeros(len(self.v), np.int64), np.arange(len(self.v))
            for x, y, c in near(self.v, self.v, True):
                if counted:
                    self.links += np.bincount(x, self.n[y], len(self.v)).astype(np.int64) + np.bincount(y, self.n[x], len(self.v)).astype(np.int64)
                    self.label = merged(self.label, x, y)
                else:
                    yield self.pairs(self.id[x], self.id[y], c)

        def probe(self, v: np.ndarray, ident: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from self.settle()
            if self.v is None:
                return
            size = len(self.v)
            links, label = np.zeros(len(v), np.int64), np.concatenate((self.label, np.arange(size, size + len(v))))
            for x, y, c in near(v, self.v, False):
                if counted:
                    links += np.bincount(x, self.n[y], len(v)).astype(np.int64)
                    self.links += np.bincount(y, n[x], size).astype(np.int64)
                    label = merged(label, size + x, y)
                else:
                    yield self.pairs(ident[x], self.id[y], c)
            if counted:
                self.label = label[:size]
                some = np.flatnonzero(links)
                yield self.counts(ident[some], links[some], self.id[label[size + some]])

        def end(self) -> Iterator[pa.RecordBatch]:
            yield from self.settle()
            if counted and self.v is not None:
                some = np.flatnonzero(self.links)
                yield self.counts(self.id[some], self.links[some], self.id[self.label[some]])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, probe = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (probe[1:] != probe[:-1])) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                if (cell[a], number[a]) != now:
                    if block:
                        yield from block.end()
                    now, block = (cell[a], number[a]), Block(batch.schema.field(3).type)
                part = batch.slice(a, b - a)
                row = _matrix(part.column(5)), part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy()
                if not probe[a]:
                    block.parts.append(row)
                else:
                    yield from block.probe(*row)
        if block:
            yield from block.end()

    return stage, f"a {kind}, n bigint, b {kind}" if counted else f"a {kind}, b {kind}, cosine double"


def _joined(unit: DataFrame, cosine: float, cell: int, block: int, counted: bool) -> DataFrame:
    """The join of unit vectors id, dims, v, n."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    kind = unit.schema["id"].dataType.simpleString()
    pivots: dict[int, tuple[int, np.ndarray]] = {}
    first = 0
    for dims, n in sorted((r["dims"], r["count"]) for r in unit.groupBy("dims").count().collect()):
        want = min(MAX_PIVOTS, -(-n // cell))
        chosen = unit.filter(F.col("dims") == dims).groupBy("v").agg(F.lit(1)).select("v").orderBy(F.xxhash64("v"), "v").limit(want).toPandas().v
        pivots[dims] = first, np.frombuffer(b"".join(chosen), np.float64).reshape(len(chosen), dims)
        first += len(chosen)
    homes = checkpointed(_homes(unit.select("id", "dims", "v", "n"), pivots, radius))
    # A row a cell: its blocks.
    sizes = homes.groupBy("home").count().collect()
    blocks = {r["home"]: -(-r["count"] // block) for r in sizes if r["count"] > block}
    many = F.coalesce(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("cell")], F.lit(1)) if blocks else F.lit(1)
    own = homes.select(F.col("home").alias("cell"), "id", "n", "v").withColumn("many", many).withColumn("own", F.pmod(F.xxhash64("id", "v"), F.col("many")).cast("int"))
    held = own.select("cell", F.col("own").alias("block"), F.lit(0).alias("probe"), "id", "n", "v")
    others = own.filter("own > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("block"), F.lit(1).alias("probe"), "id", "n", "v")
    visitors = (
        homes.select(F.explode("visits").alias("cell"), "id", "n", "v")
        .withColumn("many", many)
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"), F.lit(1).alias("probe"), "id", "n", "v")
    )
    rows = held.unionByName(others).unionByName(visitors).repartition("cell", "block").sortWithinPartitions("cell", "block", "probe")
    return rows.mapInArrow(*_join_blocks(cosine, kind, counted))


def near_pairs(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """All pairs of ids whose vectors have at least that cosine: vec_a < vec_b, cosine."""
    unit = checkpointed(_unit(df, id_col, vector_col).filter("id is not null and v is not null").withColumn("n", F.lit(1).cast("bigint")))
    pairs = _joined(unit, cosine, cell, block, False).filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).agg(F.max("cosine").alias("cosine"))


def near_classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """A row for each row of df: vec_id; class_id, the lowest id of its connected component; n_links, the number of other rows whose
    vectors have at least that cosine with its own."""
    rows = checkpointed(_unit(df, id_col, vector_col).withColumn("key", F.unhex(F.md5("v"))))
    vectors = checkpointed(rows.filter("v is not null").groupBy("key", "dims", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    found = checkpointed(_joined(vectors.select(F.col("key").alias("id"), "dims", "v", "n"), cosine, cell, block, True))
    groups = components(found.filter("a <> b").select("a", "b"))
    members = groups.select(F.col("node").alias("key"), "root").union(groups.select("root", "root").distinct())
    links = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("near"))
    placed = vectors.select("key", "n", "first").join(members, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = placed.groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("vectors"))
    several = placed.join(classes, "root").filter("n > 1 or vectors > 1").join(links, "key", "left")
    known = several.select("key", "class_id", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("id", "key").join(small(known), "key", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
