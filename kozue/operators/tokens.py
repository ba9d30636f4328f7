"""Token tables and tree navigation over recognised sentences, without joins: a head is a place in its own row's array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.flow import ints, joined as joined_stretches, owners, per_row, starts
from ..schema import STRINGS
from .recognize import flatten
from .trees import resolve, ways

#: What is put between joined elements unless something else is asked for.
SEP = "+"


def joined(elements: Column, sep: str = SEP) -> Column:
    return F.array_join(F.transform(elements, lambda x: x.cast("string")), sep)


def token_table(recognised: DataFrame) -> DataFrame:
    """A row a token: doc_id, sent_id, i, the token's fields and, if there, its units'."""
    units = "units" in recognised.columns
    zipped = F.arrays_zip("tokens", "units") if units else F.arrays_zip("tokens")
    rows = recognised.select("doc_id", "sent_id", F.posexplode(zipped).alias("i", "x"))
    fields = [F.col(f"x.tokens.{n}") for n in (*STRINGS, "head", "ent_iob", "ent_type", "reading", "inflection", "idx")]
    if units:
        fields.append(F.col("x.units.*"))
    return rows.select("doc_id", "sent_id", "i", *fields)


def at(tokens: Column, i: Column) -> Column:
    """Token at place i, null outside of the sentence."""
    return F.get(tokens, i)


def head_of(tokens: Column, token: Column) -> Column:
    return at(tokens, token["head"])


def children(tokens: Column, i: Column, side: str | None = None) -> Column:
    """Places of the tokens below i: all, or those to its "left" or "right"."""
    places = F.transform(tokens, lambda t, k: F.when((t["head"] == i) & (k != i), k))

    def wanted(k: Column) -> Column:
        return k.isNotNull() & (k < i if side == "left" else k > i if side == "right" else F.lit(True))

    return F.filter(places, wanted)


def ancestors(tokens: Column, i: Column) -> Column:
    """Places on the way from i's head to the root; it stops where a circle closes."""
    empty = F.array().cast("array<int>")

    def climb(way: Column, _: Column) -> Column:
        last = F.coalesce(F.try_element_at(way, F.lit(-1)), i.cast("int"))
        up = at(tokens, last)["head"]
        return F.when((up == last) | F.array_contains(way, up) | (up == i), way).otherwise(F.concat(way, F.array(up)))

    return F.aggregate(tokens, empty, climb)


def in_subtree(units: Column, tokens: Column, k: Column, i: Column) -> Column:
    """Whether k is i or below it."""
    return (k == i) | F.array_contains(ancestors(tokens, k), i)


def traverse(elements: Column, func: Callable[[Column], Column], condition: Callable[[Column], Column] | None = None, join: Callable[[Column], Column] = joined) -> Column:
    """Filter, map and join an array; the functions build Columns, so the work stays in the JVM."""
    chosen = F.filter(elements, condition) if condition else elements
    return join(F.transform(chosen, func))


def conjuncts(sentences: DataFrame) -> DataFrame:
    """Tokens of coordinations: doc_id, sent_id, i, first (place of the coordination's first token). A conjunct's relation is conj,
    and its head is the conjunct before it."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = flatten(batch.column(2))
            sizes = np.diff(f.begin)
            row = np.repeat(np.arange(len(sizes)), sizes)
            conj = pc.fill_null(pc.starts_with(f.strings("dep"), "conj"), False).to_numpy(zero_copy_only=False)
            first = resolve(np.where(conj, f.head, np.arange(len(f.head))))
            at = np.flatnonzero(np.bincount(first, minlength=len(first))[first] > 1)
            begin = f.begin[:-1][row[at]]
            ids = [batch.column(k).take(pa.array(row[at])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array((at - begin).astype(np.int32)), pa.array((first[at] - begin).astype(np.int32))], ["doc_id", "sent_id", "i", "first"])

    return sentences.select("doc_id", "sent_id", "tokens").mapInArrow(stage, "doc_id bigint, sent_id int, i int, first int")


def child_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each token that has tokens below it: i, n_children, n_lefts, n_rights."""
    f = flatten(batch.column("tokens"))
    n, here = len(f.head), np.arange(len(f.head))
    lefts, rights = (np.bincount(f.head[side], minlength=n) for side in (here < f.head, here > f.head))
    at = np.flatnonzero(lefts + rights)
    row = owners(batch.column("tokens"))[at]
    return per_row(batch, row, i=ints(at - f.begin[row]), n_children=pa.array((lefts + rights)[at]), n_lefts=pa.array(lefts[at]), n_rights=pa.array(rights[at]))


def first_paths(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row a sentence: the way from its first token to the root (places), and whether its last token is that token or on the way."""
    f = flatten(batch.column("tokens"))
    first = f.begin[:-1][np.diff(f.begin) > 0]
    way, steps = ways(f.head, first)
    row = np.searchsorted(f.begin, way, side="right") - 1
    order = np.lexsort((steps, row))
    way, row = way[order], row[order]
    below = np.diff(f.begin) == 1
    below[row[way == f.begin[row + 1] - 1]] = True
    path = joined_stretches(ints(way - f.begin[row]), np.searchsorted(row, np.arange(batch.num_rows + 1)), " ")
    return per_row(batch, path=path, below_last=pa.array(below, pa.bool_()))


def root_children(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row a sentence: the tokens below the root of its first token, to the left and to the right (places), and their number."""
    tokens = batch.column("tokens")
    f, row = flatten(tokens), owners(tokens)
    here, first = np.arange(len(f.head)), f.begin[:-1][row]
    root = batch.column("units").flatten().field("root").to_numpy(zero_copy_only=False).astype(np.int64)[first] + first if len(row) else here
    below = (f.head == root) & (here != root)

    def side(chosen: np.ndarray) -> pa.Array:
        return joined_stretches(ints((here - first)[chosen]), np.searchsorted(row[chosen], np.arange(batch.num_rows + 1)), " ")

    return per_row(batch, lefts=side(below & (here < root)), rights=side(below & (here > root)), n_children=pa.array(np.bincount(row[below], minlength=batch.num_rows)))
