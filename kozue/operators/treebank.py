"""Treebank conversion: bunsetu heads, entity spans, checks of trees, retokenisation, paragraphs, augmentation.

What runs in a kernel gets a sentence as Python values and returns it changed or with an error; the rest is relational.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType, _parse_datatype_string

from ..functions.fields import swap_width
from .evaluate import Side
from ..plans.flow import Step, field, ints, joined, owners, per_row, starts, with_column, with_fields
from .recognize import SUFFIX, flatten, token_slices
from .trees import crossing, depths, scatter


def mark_bunsetu_heads(head: list[int], dep: list[str], bi: list[str | None]) -> list[str]:
    """Relations with the suffix on each bunsetu's root, but not on the tree's."""
    if any(b is None for b in bi):
        raise ValueError("a token without a bunsetu label")
    out = list(dep)
    start = root = -1

    def close() -> None:
        if root >= 0 and out[root].lower() != "root":
            out[root] += SUFFIX

    for i, label in enumerate(bi):
        if label == "B" or start < 0:
            close()
            start = root = i
        elif head[i] < start or i <= head[root] < head[i] or dep[i].lower() == "root" or head[i] == i:
            root = i
    close()
    return out


def append_suffix(head: list[int], dep: list[str], spans: list[tuple[int, int]]) -> list[str]:
    """Relations with the suffix on the first token of each span that has its head outside of it."""
    out = list(dep)
    for a, b in spans:
        for i in range(a, b):
            if not a <= head[i] < b or head[i] == i:
                if out[i].lower() != "root" and not out[i].endswith(SUFFIX):
                    out[i] += SUFFIX
                break
    return out


def decode_labels(labels: list[str | None], begin: list[int], end: list[int], must_have: bool = False) -> list[tuple[int, int, str]]:
    """Character spans of labels like B-X; U is B, L is I. A ValueError tells of an inside that continues nothing."""
    out: list[list] = []
    now: list | None = None
    for k, label in enumerate(labels):
        if label is None and must_have:
            raise ValueError("a token without a label")
        kind, _, name = (label or "O").partition("-")
        kind = {"U": "B", "L": "I"}.get(kind, kind)
        if kind == "B":
            now = [begin[k], end[k], name]
            out.append(now)
        elif kind == "I":
            if now is None or now[2] != name:
                raise ValueError(f"{label} continues nothing")
            now[1] = end[k]
        elif kind in ("O", "_", ""):
            now = None
        else:
            raise ValueError(f"no label: {label}")
    return [tuple(x) for x in out]


def merge_to(spans: list[tuple[int, int]], tokens: list[dict]) -> list[dict]:
    """Tokens with those merged that share a span of another tokenisation. Only one of a merged group may have its head outside of
    the group; else it's a ValueError. Spans and tokens that cross make one group."""
    begin = [t["idx"] for t in tokens]
    end = [t["idx"] + len(t["orth"]) for t in tokens]
    groups: list[list[int]] = []
    s = 0
    upto = -1
    for i in range(len(tokens)):
        while s < len(spans) and spans[s][1] <= begin[i]:
            s += 1
        if begin[i] >= upto:
            groups.append([])
        groups[-1].append(i)
        upto = max(upto, end[i])
        k = s
        while k < len(spans) and spans[k][0] < upto:
            upto = max(upto, spans[k][1])
            k += 1
    of = {i: g for g, members in enumerate(groups) for i in members}
    out = []
    for g, members in enumerate(groups):
        outer = [i for i in members if of[tokens[i]["head"]] != g or tokens[i]["head"] == i]
        if len({of[tokens[i]["head"]] if tokens[i]["head"] != i else -1 for i in outer}) != 1:
            raise ValueError(f"tokens {members} have several heads outside")
        lead = tokens[outer[-1]]
        parts = [tokens[i] for i in members]
        text = "".join(p["orth"] + (p["ws"] if k < len(parts) - 1 else "") for k, p in enumerate(parts))
        head = g if lead["head"] in members else of[lead["head"]]
        out.append(lead | {"orth": text, "ws": parts[-1]["ws"], "lemma": "".join(p["lemma"] for p in parts), "norm": "".join(p["norm"] for p in parts), "head": head, "idx": parts[0]["idx"]} if len(parts) > 1 else lead | {"head": head})
    return out


#: Tokens of a slice whose tokens become Python values.
ROWS_TOKENS = 1 << 13


def rewritten(sentences: DataFrame, change: Callable[..., list[dict]], *columns: str, error: str | None = None) -> DataFrame:
    """sentences with tokens that `change` makes of them and of the values of the columns. Where it raises a ValueError, the sentence is
    left out; or if `error` is given, its tokens are null and that column says why."""
    names = sentences.columns
    place, places = names.index("tokens"), [names.index(c) for c in columns]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in token_slices(whole, ROWS_TOKENS)):
            keep, changed, said = [], [], []
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (place, *places)), strict=True)):
                try:
                    changed.append(change(*row))
                    said.append(None)
                except ValueError as e:
                    if error is None:
                        continue
                    changed.append(None)
                    said.append(str(e))
                keep.append(k)
            out = batch.take(pa.array(keep, pa.int64())).columns
            out[place] = pa.array(changed, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*out, pa.array(said, pa.string())] if error else out, [*names, error] if error else names)

    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, StructField(error, StringType())]) if error else sentences.schema)


def with_bunsetu_heads(sentences: DataFrame, bi: str = "bi", error: str | None = None) -> DataFrame:
    """sentences with the suffix on the relation of each bunsetu's root; bi: the column with the tokens' bunsetu labels."""

    return _stepped(sentences, bunsetu_head_deps(bi), error=error)


def with_suffix(sentences: DataFrame, spans: str = "spans") -> DataFrame:
    """sentences with the suffix on the first token of each span that has its head outside; spans: start and end, places of tokens."""
    return _stepped(sentences, suffixed(spans))


def retokenised(sentences: DataFrame, spans: str = "spans", error: str | None = None) -> DataFrame:
    """sentences with tokens merged to those of another tokenisation; spans: begin and end, characters."""
    return _stepped(sentences, merged(spans), error=error)


#: A batch's tokens changed, and what is wrong with each sentence (null: nothing).
Change = Callable[[pa.RecordBatch], tuple[pa.ListArray, pa.Array]]


def _stepped(sentences: DataFrame, change: Change, error: str | None = None) -> DataFrame:
    """sentences changed, as `rewritten` does it, by a kernel over batches."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(stepped(change, error), token_slices(batch))

    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, StructField(error, StringType())]) if error else sentences.schema)


def stepped(change: Change, error: str | None = None) -> Step:
    """Batches of sentences changed; those with an error are left out, or have null tokens if there is a column for it."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, said = change(batch)
        good = said.is_null()
        if error is None:
            return with_column(batch, "tokens", tokens).filter(good)
        tokens = tokens if said.null_count == len(said) else pc.if_else(good, tokens, pa.scalar(None, tokens.type))
        return with_column(with_column(batch, "tokens", tokens), error, said)

    return step


def _roots(head: np.ndarray, is_root: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The root that mark_bunsetu_heads finds of each bunsetu; start: where they begin, first of all at the first token."""
    n = len(head)
    here, of = np.arange(n), np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    # The last token that is taken whatever was before; after it, only those count that its head, and theirs in turn, lies under.
    root = np.maximum.reduceat(np.where((head < start[of]) | is_root | (head == here) | (here == start[of]), here, -1), start)
    after = head[root][of]
    later = (here > root[of]) & (here <= after) & (head > after)
    ends = np.append(start[1:], n)
    for g in np.unique(of[later]).tolist():
        a, b = int(root[g]), int(ends[g])
        part, at = head[a:b].tolist(), 0
        for i in range(1, b - a):
            if a + i <= part[at] < part[i]:
                at = i
        root[g] = a + at
    return root


def _marked_one_by_one(tokens: pa.ListArray, labels: pa.ListArray) -> tuple[pa.ListArray, pa.Array]:
    head, dep = (field(tokens, n).to_pylist() for n in ("head", "dep"))
    begin, flat, at = starts(tokens).tolist(), labels.flatten().to_pylist(), starts(labels).tolist()
    said: list[str | None] = []
    for k, (a, b) in enumerate(zip(begin, begin[1:], strict=False)):
        try:
            dep[a:b] = mark_bunsetu_heads(head[a:b], dep[a:b], flat[at[k] : at[k + 1]])
            said.append(None)
        except ValueError as e:
            said.append(str(e))
    return with_fields(tokens, dep=pa.array(dep, pa.string())), pa.array(said, pa.string())


def bunsetu_head_deps(bi: str = "bi") -> Change:
    """mark_bunsetu_heads for all sentences of a batch at once."""

    def change(batch: pa.RecordBatch) -> tuple[pa.ListArray, pa.Array]:
        tokens, labels = batch.column("tokens"), batch.column(bi)
        flat, begin = labels.flatten(), starts(tokens)
        if not np.array_equal(begin, starts(labels)):
            return _marked_one_by_one(tokens, labels)
        f, row = flatten(tokens), owners(tokens)
        dep = f.strings("dep")
        is_root = pc.fill_null(pc.equal(pc.utf8_lower(dep), "root"), False).to_numpy(zero_copy_only=False)
        without = np.bincount(row[flat.is_null().to_numpy(zero_copy_only=False)], minlength=batch.num_rows) > 0
        if len(row):
            begins = pc.fill_null(pc.equal(flat, "B"), False).to_numpy(zero_copy_only=False).copy()
            begins[begin[:-1][np.diff(begin) > 0]] = True
            mark = np.zeros(len(row), bool)
            mark[_roots(f.head, is_root, np.flatnonzero(begins))] = True
            dep = pc.if_else(pa.array(mark & ~is_root & ~without[row]), pc.binary_join_element_wise(dep, SUFFIX, ""), dep)
        said = pa.array(["a token without a bunsetu label"]).take(pa.array(np.zeros(batch.num_rows, np.int64), mask=~without))
        return with_fields(tokens, dep=dep), said

    return change


def suffixed(spans: str = "spans") -> Change:
    """append_suffix for all sentences of a batch at once."""

    def change(batch: pa.RecordBatch) -> tuple[pa.ListArray, pa.Array]:
        tokens, found = batch.column("tokens"), batch.column(spans)
        f = flatten(tokens)
        base = f.begin[:-1][owners(found)]
        begin, end = (field(found, n).to_numpy(zero_copy_only=False).astype(np.int64) + base for n in ("start", "end"))
        some = end > begin
        begin, end = begin[some], end[some]
        at, of = scatter(begin, end - begin), np.repeat(np.arange(len(begin)), end - begin)
        up, n = f.head[at], len(f.head)
        outside = (up < begin[of]) | (up >= end[of]) | (up == at)
        first = np.minimum.reduceat(np.where(outside, at, n), np.cumsum(end - begin) - (end - begin)) if len(begin) else at
        mark = np.zeros(n, bool)
        mark[first[first < n]] = True
        dep = f.strings("dep")
        free = pc.and_(pc.not_equal(pc.utf8_lower(dep), "root"), pc.invert(pc.ends_with(dep, SUFFIX)))
        marked = pc.if_else(pc.and_(pa.array(mark), free), pc.binary_join_element_wise(dep, SUFFIX, ""), dep)
        return with_fields(tokens, dep=marked), pa.nulls(batch.num_rows, pa.string())

    return change


def groups(spans: list[tuple[int, int]], begin: list[int], end: list[int]) -> list[int]:
    """The group of each token, as merge_to makes them."""
    of, s, upto, g, n = [], 0, -1, -1, len(spans)
    for b, e in zip(begin, end, strict=True):
        while s < n and spans[s][1] <= b:
            s += 1
        if b >= upto:
            g += 1
        of.append(g)
        if e > upto:
            upto = e
        k = s
        while k < n and spans[k][0] < upto:
            if spans[k][1] > upto:
                upto = spans[k][1]
            k += 1
    return of


def _within(begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
    """The span of each token as its group, if spans and tokens come in order without overlaps and each token lies in one; else None."""
    if not len(begin) or not len(low) or (end <= begin).any() or (high <= low).any() or (begin[1:] < end[:-1]).any() or (low[1:] < high[:-1]).any():
        return None
    of = np.searchsorted(low, begin, side="right") - 1
    return of if (of >= 0).all() and (end <= high[of]).all() else None


def merged(spans: str = "spans") -> Change:
    """merge_to for all sentences of a batch at once; only groups of spans and tokens that cross are found one by one."""

    def change(batch: pa.RecordBatch) -> tuple[pa.ListArray, pa.Array]:
        tokens, found = batch.column("tokens"), batch.column(spans)
        f, row, n = flatten(tokens), owners(tokens), len(owners(tokens))
        orth, ws = f.strings("orth"), pc.fill_null(f.strings("ws"), "")
        begin = f.strings("idx").to_numpy(zero_copy_only=False).astype(np.int64)
        end = begin + pc.utf8_length(orth).to_numpy(zero_copy_only=False)
        low, high = (field(found, name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("begin", "end"))
        of = _within(row << 32 | begin, row << 32 | end, owners(found) << 32 | low, owners(found) << 32 | high)
        if of is None:
            b, e, pairs = begin.tolist(), end.tolist(), list(zip(low.tolist(), high.tolist(), strict=True))
            at, own = f.begin.tolist(), starts(found).tolist()
            of = np.array([g for k in range(len(tokens)) for g in groups(pairs[own[k] : own[k + 1]], b[at[k] : at[k + 1]], e[at[k] : at[k + 1]])], np.int64)
        new = np.append(True, (of[1:] != of[:-1]) | (row[1:] != row[:-1])) if n else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        group, here = np.cumsum(new) - 1, np.arange(n)
        to = np.where(f.head == here, -1, group[f.head]) if n else here
        outer = to != group if n else new
        # Heads outside of a group: all must lie in one group, or be none's.
        low, high, lead = (np.zeros(0, np.int64),) * 3
        if n:
            low, high = np.minimum.reduceat(np.where(outer, to, n), first), np.maximum.reduceat(np.where(outer, to, -2), first)
            lead = np.maximum.reduceat(np.where(outer, here, -1), first)
        said: list[str | None] = [None] * batch.num_rows
        for g in np.flatnonzero(low != high)[::-1].tolist():
            a = int(first[g] - f.begin[row[first[g]]])
            said[row[first[g]]] = f"tokens {list(range(a, a + int(size[g])))} have several heads outside"
        lead = np.where(lead < 0, first, lead)
        start = np.append(np.searchsorted(row[first], np.arange(batch.num_rows)), len(first))
        head = np.where(low == -1, np.arange(len(first)), np.clip(low, 0, max(0, len(first) - 1))) - start[row[first]]
        last, bounds = first + size - 1, np.append(first, n)
        final = np.zeros(n, bool)
        final[last] = True
        take = pa.array(lead)
        values = {name: f.strings(name).take(take) for name in f.columns}
        values |= {
            "orth": joined(pc.binary_join_element_wise(orth, pc.if_else(pa.array(final), "", ws), ""), bounds, ""),
            "ws": f.strings("ws").take(pa.array(last)),
            "lemma": joined(f.strings("lemma"), bounds, ""),
            "norm": joined(f.strings("norm"), bounds, ""),
            "head": ints(head),
            "idx": f.strings("idx").take(pa.array(first)),
        }
        kind = tokens.type.value_type
        struct = pa.StructArray.from_arrays([values[x.name].cast(x.type) for x in kind], fields=list(kind))
        return pa.ListArray.from_arrays(ints(start), struct), pa.array(said, pa.string())

    return change


def decoded(sentences: DataFrame, labels: str = "labels", must_have: bool = False) -> DataFrame:
    """sentences with `entities` (begin, end: places of tokens; label) of their labels, and `error` where these are bad."""
    place = sentences.columns.index(labels)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, said = [], []
            for row in batch.column(place).to_pylist():
                every = range(len(row or []))
                try:
                    found.append([dict(zip(("begin", "end", "label"), x, strict=True)) for x in decode_labels(row or [], list(every), [i + 1 for i in every], must_have)])
                    said.append(None)
                except ValueError as e:
                    found.append(None)
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(said, pa.string())], [*batch.schema.names, "entities", "error"])

    kinds = _parse_datatype_string("entities array<struct<begin:int,end:int,label:string>>, error string")
    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, *kinds.fields]))


def aligned_tags(files: DataFrame) -> DataFrame:
    """files with `labels`, those of their sentences' tokens by tags of the text, and `error` where a token isn't in it. files: text, tags
    (label, begin, end), sentences (arrays of words)."""
    places = [files.columns.index(c) for c in ("text", "tags", "sentences")]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, said = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in places), strict=True):
                try:
                    found.append(align_tags(*row))
                    said.append(None)
                except ValueError as e:
                    found.append(None)
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.list_(pa.string()))), pa.array(said, pa.string())], [*batch.schema.names, "labels", "error"])

    kinds = _parse_datatype_string("labels array<array<string>>, error string")
    return files.mapInArrow(stage, StructType([*files.schema.fields, *kinds.fields]))


def projective(sentences: DataFrame, flag: str = "ok") -> DataFrame:
    """sentences with a flag that is false where the tree has crossing arcs or a circle."""
    names = sentences.columns
    place = names.index("tokens")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = flatten(batch.column(place))
            bad = crossing(f.head, f.begin) if len(f.head) else np.zeros(batch.num_rows, bool)
            round_ = np.add.reduceat(np.append(depths(f.head) < 0, False).astype(int), f.begin[:-1]) * (np.diff(f.begin) > 0) > 0 if len(f.head) else bad
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~(bad | round_))], [*names, flag])

    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, StructField(flag, BooleanType())]))


def gold_ready(sentences: DataFrame, bunsetu_heads: bool = False, luw: bool = False) -> DataFrame:
    """Sentences as they go into gold JSON: without those whose tree has crossing arcs or a circle or whose labels are bad, with
    BILUO labels of entities, or with luw of long units (all tokens must have one); with bunsetu_heads, the suffix on relations of
    bunsetu heads (sentences in which a token has no bunsetu label are left out). sentences: those of CoNLL-U."""
    from ..sources.conllu import misc_fields

    def ready(tokens: list[dict], bi: list[str | None], misc: list[str]) -> list[dict]:
        fields = [misc_fields(m) for m in misc]
        if luw:
            labels = [f"{f['LUWBILabel']}-{f['LUWPOS']}" if "LUWBILabel" in f and "LUWPOS" in f else None for f in fields]
            if any(x is not None and x[0] not in "BILU" for x in labels):
                raise ValueError("a token outside of long units")
        else:
            labels = [f.get("ENE") or f.get("NE") for f in fields]
        every = range(len(tokens))
        spans = decode_labels(labels, list(every), [i + 1 for i in every], luw)
        dep = mark_bunsetu_heads([t["head"] for t in tokens], [t["dep"] for t in tokens], bi) if bunsetu_heads else [t["dep"] for t in tokens]
        out = [t | {"dep": d, "ent_iob": "O", "ent_type": ""} for t, d in zip(tokens, dep, strict=True)]
        for a, b, name in spans:
            for i in range(a, b):
                out[i] |= {"ent_iob": "U" if b - a == 1 else "B" if i == a else "L" if i == b - 1 else "I", "ent_type": name}
        return out

    return rewritten(projective(sentences).filter("ok").drop("ok"), ready, "bi", "misc")


def biluo(sentences: DataFrame) -> DataFrame:
    """sentences with `labels`, those of their tokens by `entities` (begin, end, label; characters). A token belongs to the span that it
    overlaps; if several, to the first."""
    place, spans_place = sentences.columns.index("tokens"), sentences.columns.index("entities")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Side(batch.column(place))
            lists = batch.column(spans_place)
            flat = lists.flatten()
            begin, end = (flat.field(flat.type.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("begin", "end"))
            name = np.array(flat.field(flat.type.get_field_index("label")).to_pylist(), object)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())).astype(np.int64)
            order = np.lexsort((end, begin, row))
            base = t.row << 32
            low = np.searchsorted(base | t.last, (row << 32 | begin)[order], side="right")
            high = np.searchsorted(base | t.first, (row << 32 | end)[order], side="left")
            labels = np.full(len(t.row), "O", object)
            taken = 0
            for k, a, b in zip(order.tolist(), low.tolist(), high.tolist(), strict=True):
                a = max(a, taken)
                if b > a:
                    taken = b
                    labels[a:b] = f"I-{name[k]}"
                    labels[b - 1] = f"L-{name[k]}"
                    labels[a] = f"B-{name[k]}" if b - a > 1 else f"U-{name[k]}"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(t.begin.astype(np.int32)), pa.array(labels, pa.string()))], [*batch.schema.names, "labels"])

    return sentences.mapInArrow(stage, StructType([*sentences.schema.fields, StructField("labels", ArrayType(StringType()))]))


def invalid_labels(sentences: DataFrame) -> DataFrame:
    """Places where a BILUO sequence breaks its rules: sent, i, label; none in a valid one. sentences: sent, labels."""
    labels = F.col("labels")

    def kind(x: Column) -> Column:
        return F.substring(x, 1, 1)

    def bad(x: Column, i: Column) -> Column:
        before, after = F.get(labels, i - 1), F.get(labels, i + 1)
        opened = F.coalesce(kind(before).isin("B", "I"), F.lit(False))
        other = F.substring(before, 2, F.length(before)) != F.substring(x, 2, F.length(x))
        return (kind(x).isin("I", "L") & (~opened | other)) | (kind(x).isin("B", "U", "O") & opened) | (after.isNull() & kind(x).isin("B", "I"))

    each = F.transform("labels", lambda x, i: F.struct(i.alias("i"), x.alias("label"), bad(x, i).alias("bad")))
    return sentences.select("sent", F.inline(F.filter(each, lambda e: e["bad"]))).select("sent", "i", "label")


def paragraph_numbers(n: int, doc: object, closes: list[bool], groups: list | None, seed: int = 1) -> list[int]:
    """The paragraph of each sentence of a document: a paragraph ends when it has as many as it should and its last one may close it, or
    before a sentence of another group; what is left at the end that can't close a paragraph joins the one before it."""

    def size(k: int) -> int:
        if n > 0:
            return n
        u = int(hashlib.md5(f"{doc}:{k}:{seed}".encode()).hexdigest()[:8], 16) / float(1 << 32)
        return math.floor(u * u * -n + 1)

    out: list[int] = []
    k = held = 0
    due = size(0) if n else 1 << 62
    for i, close in enumerate(closes):
        if held and groups is not None and groups[i] != groups[i - 1]:
            k, held, due = k + 1, 0, size(k + 1) if n else due
        out.append(k)
        held += 1
        if held >= due and close:
            k, held, due = k + 1, 0, size(k + 1)
    if held and k and not closes[-1] and (groups is None or groups[-1] == groups[-1 - held]):
        out[-held:] = [k - 1] * held
    return out


def paragraphs(sentences: DataFrame, n: int, order: str = "sent_id", doc: str = "doc_id", seed: int = 1, closes: Column | None = None, group: Column | None = None) -> DataFrame:
    """sentences with `paragraph`. n > 0: n sentences each, a shorter rest joining the last whole one; 0: the whole document; n < 0:
    as many as floor(-n u^2 + 1), u being drawn by md5 from document, number of the paragraph and seed. closes: whether a sentence may
    be a paragraph's last; group: a paragraph's sentences agree in it. With either, a rest that may close a paragraph is its own."""
    if n >= 0 and closes is None and group is None:
        by = Window.partitionBy(doc).orderBy(order)
        if n == 0:
            return sentences.withColumn("paragraph", F.lit(0).cast("bigint"))
        number, total = F.row_number().over(by) - 1, F.count(F.lit(1)).over(Window.partitionBy(doc))
        return sentences.withColumn("paragraph", F.least(F.floor(number / n), F.greatest(F.floor(total / n) - 1, F.lit(0))).cast("bigint"))
    # Lengths depend on what came before, so a document's places are folded in one row; they are narrow.
    one = F.struct(F.col(order).alias("o"), (F.lit(True) if closes is None else closes).alias("c"), (F.lit(None).cast("string") if group is None else group.cast("string")).alias("g"))
    docs = sentences.groupBy(doc).agg(F.sort_array(F.collect_list(one)).alias("x")).select(doc, F.col(doc).cast("string").alias("name"), "x.o", "x.c", "x.g")

    grouped = group is not None

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [paragraph_numbers(n, d, c, g if grouped else None, seed) for d, c, g in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int64()))], [doc, "o", "k"])

    kind = _parse_datatype_string("k array<bigint>")
    folded = docs.mapInArrow(stage, StructType([docs.schema[doc], docs.schema["o"], *kind.fields]))
    numbered = folded.select(doc, F.inline(F.arrays_zip(F.col("o").alias(order), F.col("k").alias("paragraph"))))
    return sentences.join(numbered, [doc, order])


def augment_width(sentences: DataFrame, key: list[str], seed: int = 1) -> DataFrame:
    """Sentences and, of those that it changes, a second one with swapped widths, whose `copy` is 1. In two thirds of these the surface is
    swapped, and in half of them the lemmas too; in the others only the lemmas. The choice is an md5 of the key and seed."""
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    draw = F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint"), F.lit(6))
    surface, lemmas = draw < 4, (draw < 2) | (draw >= 4)
    tokens = F.transform(
        "tokens",
        lambda t: t.withField("orth", F.when(surface, swap_width(t["orth"])).otherwise(t["orth"])).withField("lemma", F.when(lemmas, swap_width(t["lemma"])).otherwise(t["lemma"])),
    )
    text = swap_width(F.col("text"))
    second = sentences.filter(text != F.col("text")).withColumn("tokens", tokens).withColumn("text", F.when(surface, text).otherwise(F.col("text"))).withColumn("copy", F.lit(1))
    return sentences.withColumn("copy", F.lit(0)).unionByName(second)


def width_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row a sentence and a row for its copy of swapped widths, as augment_width has them by doc_id and sent_id: copy, text, lemmas."""
    from ..functions.fields import SWAPPED

    lemmas = joined(field(batch.column("tokens"), "lemma"), starts(batch.column("tokens")), " ")
    rows, texts, changed = [], [], []
    for k, (d, n, text, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), lemmas.to_pylist(), strict=True)):
        swapped = text.translate(SWAPPED)
        if swapped != text:
            draw = int(hashlib.md5(f"{d}:{n}:1".encode()).hexdigest()[:8], 16) % 6
            rows.append(k)
            texts.append(swapped if draw < 4 else text)
            changed.append(words.translate(SWAPPED) if draw < 2 or draw >= 4 else words)
    every = np.append(np.arange(batch.num_rows), np.array(rows, np.int64)).astype(np.int64)
    copies = ints(np.arange(len(every)) >= batch.num_rows)
    return per_row(batch, every, copy=copies, text=pa.concat_arrays([batch.column(2), pa.array(texts, pa.string())]), lemmas=pa.concat_arrays([lemmas, pa.array(changed, pa.string())]))


def dep_report(table: DataFrame) -> DataFrame:
    """dep, n over the bunsetu heads of a token table."""
    return table.filter("is_head").groupBy("dep").agg(F.count(F.lit(1)).alias("n"))


def rewrite_ne(misc: Column, label: Column) -> Column:
    """The last column of CoNLL-U with NE= set: in place of nothing, of an earlier one at its end, or after the rest."""
    ne = F.concat(F.lit("NE="), label)
    return F.when(misc == "_", ne).when(misc.rlike(r"(^|\|)NE=[^|]*$"), F.regexp_replace(misc, r"NE=[^|]*$", F.concat(F.lit(""), ne))).otherwise(F.concat(misc, F.lit("|"), ne))


def align_tags(text: str, tags: list[dict], sentences: list[list[str]]) -> list[list[str]]:
    """BILUO labels of sentences of tokens by spans of a text, line ends and white space in the text aside. A span that runs over a
    sentence's end is cut there."""
    begin, end, at = [], [], 0
    for words in sentences:
        for w in words:
            b = None
            for ch in w:
                if ch.isspace():
                    continue
                while at < len(text) and text[at].isspace():
                    at += 1
                if at >= len(text) or text[at] != ch:
                    raise ValueError(f"{w} isn't at {at} of the text")
                b = at if b is None else b
                at += 1
            begin.append(at if b is None else b)
            end.append(at)
    out, k = [], 0
    spans = sorted((t["begin"], t["end"], t["label"]) for t in tags)
    for words in sentences:
        n = len(words)
        labels = ["O"] * n
        for a, b, name in spans:
            if not n or b <= begin[k] or a >= end[k + n - 1]:
                continue
            first, last = bisect_right(end, a, k, k + n), bisect_left(begin, b, k, k + n)
            mine = [i - k for i in range(first, last) if labels[i - k] == "O"]
            for j, i in enumerate(mine):
                labels[i] = ("U" if len(mine) == 1 else "B" if not j else "L" if j == len(mine) - 1 else "I") + "-" + name
        out.append(labels)
        k += n
    return out
