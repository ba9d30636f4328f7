"""Recognition of base phrases (bunsetu) and clauses.

Runs over Arrow batches of sentences, without a shuffle. Rules that depend on the order of tokens (recovery of heads, pruning of
clauses) are small loops; the rest is array arithmetic over all tokens of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping
from dataclasses import dataclass, field as field_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..plans.flow import with_column, with_fields
from ..schema import ARROW_UNIT, UNIT
from .trees import depths, edges, resolve, scatter, total_below

SUFFIX = "_bunsetu"
PHRASE_RELATIONS = ("compound", "nummod", "nmod")
PHRASE_LABELS = dict.fromkeys(("NOUN", "NUM", "PRON", "PROPN"), "NP") | {"VERB": "VP", "ADJ": "ADJP", "ADV": "ADVP", "CCONJ": "CCONJP"}
FUNCTION_POS = ("AUX", "ADP", "SCONJ", "CCONJ", "PART")
#: Position types; kernels work on their places.
POSITIONS = ("ROOT", "SEM_HEAD", "NO_HEAD", "SYN_HEAD", "CONT")
ROOT, SEM_HEAD, NO_HEAD, SYN_HEAD, CONT = range(5)
DEFAULT_MARKERS = ({"tag": "補助記号-読点"},)


@dataclass(frozen=True)
class Options:
    """Whether the dependency keeps its suffix; which tokens mark clauses (all patterns of one rule must match); the fewest
    bunsetu of a clause; relations of a phrase."""

    keep_suffix: bool = False
    markers: tuple[Mapping[str, str], ...] = DEFAULT_MARKERS
    least: int = 2
    relations: tuple[str, ...] = PHRASE_RELATIONS


@dataclass
class Flat:
    """Tokens of a batch of sentences on end."""

    begin: np.ndarray
    head: np.ndarray
    columns: dict[str, pa.Array]
    codes: dict[str, tuple[list[str | None], np.ndarray]] = field_(default_factory=dict)

    def strings(self, name: str) -> pa.Array:
        return self.columns[name]

    def coded(self, name: str) -> tuple[list[str | None], np.ndarray]:
        """A column's different values, None last, and each token's place among them."""
        if name not in self.codes:
            coded = self.columns[name].dictionary_encode()
            values = coded.dictionary.to_pylist()
            self.codes[name] = [*values, None], pc.fill_null(coded.indices, len(values)).to_numpy(zero_copy_only=False)
        return self.codes[name]

    def holds(self, name: str, test: Callable[[str], bool]) -> np.ndarray:
        """Whether a column's value passes the test, which is made once for each different value; null doesn't."""
        values, code = self.coded(name)
        return np.array([v is not None and test(v) for v in values], bool)[code]

    def changed(self, name: str, change: Callable[[str | None], str | None]) -> pa.Array:
        """Strings that `change` makes of a column's different values and of null."""
        values, code = self.coded(name)
        return pa.array([change(v) for v in values], pa.string()).take(pa.array(code))

    def is_in(self, name: str, values: Iterable[str]) -> np.ndarray:
        return self.holds(name, frozenset(values).__contains__)


def flatten(tokens: pa.ListArray) -> Flat:
    flat = tokens.flatten()
    begin = tokens.offsets.to_numpy().astype(np.int64)
    begin = begin - begin[0]
    sizes = np.diff(begin)
    columns = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
    head = columns["head"].to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(begin[:-1], sizes)
    return Flat(begin, head, columns)


def recover_heads(heads: list[bool], parent: list[int], punct: list[bool]) -> None:
    """Make the parents of bunsetu heads heads as well, in place and in order, so that later tokens see earlier changes."""
    for t in range(len(heads)):
        if heads[t]:
            at, up = t, parent[t]
            while up < at and not heads[up]:
                heads[up] = not punct[up]
                at, up = up, parent[up]
            heads[up] = True


def one_head_for_entity(heads: np.ndarray, parent: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
    """Of each entity [begin, end) whose links to the outside agree, only the first token that has such a link may stay a head."""
    if not len(begins):
        return
    size = ends - begins
    at = scatter(begins, size)
    up, of = parent[at], np.repeat(np.arange(len(begins)), size)
    out = (up < begins[of]) | (up >= ends[of]) | (up == at)
    n = len(parent)
    cut = np.cumsum(size) - size
    low, high = np.minimum.reduceat(np.where(out, up, n), cut), np.maximum.reduceat(np.where(out, up, -1), cut)
    first = np.minimum.reduceat(np.where(out, at, n), cut)
    agree = (low == high) & (first < n)
    kept = first[agree & heads[np.minimum(first, n - 1)]]
    heads[at[agree[of]]] = False
    heads[kept] = True


def entity_spans(begin: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where entities begin and end: a B and the I that follow it."""
    begins = np.flatnonzero(begin)
    ends = np.flatnonzero(np.append(~inside, True))
    return begins, ends[np.searchsorted(ends, begins + 1)]


def prune_clauses(candidates: np.ndarray, root: np.ndarray, above: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
    """Candidates, by place, that hold `least` bunsetu beside those of the candidates within them; a root that doesn't takes theirs.
    above: the nearest candidate over each (-1: none); held: bunsetu heads of its subtree.

    Each is decided in the order of places; sums over what lies within are carried up as candidates drop out, so the work is in
    proportion to their number."""
    number = {c: k for k, c in enumerate(candidates.tolist())}
    up = [number.get(a, -1) for a in above.tolist()]
    held_, is_root = held.tolist(), root.tolist()
    within: list[list[int]] = [[] for _ in up]
    inner = [0] * len(up)
    for k, u in enumerate(up):
        if u >= 0:
            within[u].append(k)
            inner[u] += held_[k]
    there = [True] * len(up)

    def over(k: int) -> int:
        way = []
        k = up[k]
        while k >= 0 and not there[k]:
            way.append(k)
            k = up[k]
        for w in way:
            up[w] = k
        return k

    for k in range(len(up)):
        if not there[k] or held_[k] - inner[k] >= least:
            continue
        if is_root[k]:
            below = list(within[k])
            while below:
                d = below.pop()
                there[d] = False
                below += within[d]
                within[d] = []
            inner[k], within[k] = 0, []
        else:
            there[k] = False
            if (u := over(k)) >= 0:
                inner[u] += inner[k] - held_[k]
    return candidates[np.array(there, bool)] if len(candidates) else candidates


#: Fields of units that trees alone tell.
TREE_FIELDS = ("depth", "root", "left", "right", "descendants")


def read_for(wanted: Collection[str] | None, options: Options) -> set[str]:
    """Fields of tokens that are read to find the wanted fields of units (None: all)."""
    needed = set(ARROW_UNIT.names if wanted is None else wanted)
    words = {"dep", "pos", "ent_iob"} if not needed <= set(TREE_FIELDS) else set()
    return {"head"} | words | ({name for rule in options.markers for name in rule} if "clause" in needed else set())


def recognize_batch(tokens: pa.ListArray, options: Options, wanted: Collection[str] | None = None) -> pa.ListArray:
    """Units of tokens; wanted: the fields that they are to have (None: all), so that nothing is found for others."""
    f = flatten(tokens)
    return _units(f, options, ARROW_UNIT.names if wanted is None else wanted)


def _units(f: Flat, options: Options, wanted: Collection[str]) -> pa.ListArray:
    n, begin, head = len(f.head), f.begin, f.head
    here = np.arange(n)
    sizes = np.diff(begin)
    first = np.repeat(begin[:-1], sizes)
    found: dict[str, np.ndarray | pa.Array] = {}
    needed = set(wanted)

    def result() -> pa.ListArray:
        types = {x.name: x for x in ARROW_UNIT if x.name in needed}
        values = [x if isinstance(x, pa.Array) else pa.array(x if types[k].type == pa.bool_() else x.astype(np.int32)) for k, x in ((k, found[k]) for k in types)]
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.StructArray.from_arrays(values, fields=list(types.values())))

    if "root" in needed:
        found["root"] = (resolve(head) if n else here) - first
    if needed <= {"root"}:
        return result()
    if needed - {"is_head"}:
        depth = depths(head)
        left, right, below = edges(head, depth)
        found |= {"depth": depth, "left": left - first, "right": right - first, "descendants": below}
    if needed <= set(TREE_FIELDS):
        return result()

    # Reference trees have every self-headed token as ROOT; only the label counts for a head.
    is_root = f.is_in("dep", ("ROOT", "root"))
    heads = is_root | f.holds("dep", lambda x: x.endswith(SUFFIX))
    # Only where a head's parent is to its left and no head yet, or no head at all, is there something to recover.
    if (heads & ~heads[head]).any():
        as_list = heads.tolist()
        recover_heads(as_list, head.tolist(), f.is_in("pos", ("PUNCT",)).tolist())
        heads = np.array(as_list, bool)
    inside = f.is_in("ent_iob", ("I",))
    one_head_for_entity(heads, head, *entity_spans(f.is_in("ent_iob", ("B",)) | inside & (here == first), inside & (here != first)))
    found["is_head"] = heads
    if "clause" in needed:
        found["clause"] = _clauses(f, options, is_root, heads, depth, first)
    if needed <= {"is_head", "clause", *TREE_FIELDS}:
        return result()

    b = np.zeros(n, bool)
    b[begin[:-1][sizes > 0]] = True
    at = np.flatnonzero(heads)
    l, r = at[:-1], at[1:]
    pair = first[l] == first[r] if len(at) else np.zeros(0, bool)
    l, r = l[pair], r[pair]
    b[np.where(right[l] >= r, left[r], np.minimum(right[l] + 1, n - 1))] = True
    bunsetu = np.cumsum(b) - 1
    start = np.flatnonzero(b)
    stop = np.append(start[1:], n)
    number = bunsetu - bunsetu[first] if n else here
    found |= {"bi": pa.array(("I", "B"), pa.string()).take(pa.array(b.astype(np.int8))), "bunsetu": number, "start": start[bunsetu] - first, "end": stop[bunsetu] - first}
    if needed <= found.keys():
        return result()

    # The root of a bunsetu: linked to the outside, nearest to the tree's root, the first of equals.
    outside = (bunsetu[head] != bunsetu) | (head == here) if n else np.zeros(0, bool)
    candidates = np.flatnonzero(outside)
    order = candidates[np.lexsort((candidates, depth[candidates], bunsetu[candidates]))]
    firsts = np.unique(bunsetu[order], return_index=True)[1]
    root_of = start.copy()
    root_of[bunsetu[order[firsts]]] = order[firsts]
    broot = root_of[bunsetu] if n else here
    found["bunsetu_root"] = broot - first

    related = f.is_in("dep", [x for d in options.relations for x in (d, d + SUFFIX)])
    chain = np.where(related & (bunsetu[head] == bunsetu) & (here != broot), head, here) if n else here
    in_phrase = resolve(chain) == broot
    low, high = np.full(len(start), n), np.full(len(start), -1)
    np.minimum.at(low, bunsetu[in_phrase], here[in_phrase])
    np.maximum.at(high, bunsetu[in_phrase], here[in_phrase])
    phrase_start, phrase_end = low[bunsetu], high[bunsetu] + 1
    found |= {"phrase_start": phrase_start - first, "phrase_end": phrase_end - first}
    if "label" in needed:
        values, code = f.coded("pos")
        names = pa.array([PHRASE_LABELS.get(x, "") for x in values], pa.string())
        found["label"] = names.take(pa.array(code[root_of][bunsetu] if n else code))
    if needed <= found.keys():
        return result()

    hull = (here >= phrase_start) & (here < phrase_end)
    last_head = np.full(len(start), -1)
    np.maximum.at(last_head, bunsetu[heads], here[heads])
    has_head = last_head[bunsetu] >= 0
    function = f.is_in("pos", FUNCTION_POS)
    sem = np.where(f.is_in("dep", ("punct", "punct" + SUFFIX)), NO_HEAD, SEM_HEAD)
    inner = np.where(head == here, ROOT, np.where(last_head[bunsetu] == here, sem, CONT))
    position = np.where(hull & has_head, inner, np.where(function, SYN_HEAD, CONT))
    found["position"] = pa.array(POSITIONS, pa.string()).take(pa.array(position))
    if needed <= found.keys():
        return result()

    # Links between bunsetu: the last token that has its head in another, that bunsetu, and the first function word.
    leaves = np.flatnonzero(bunsetu[head] != bunsetu) if n else here
    link = np.full(len(start), -1)
    np.maximum.at(link, bunsetu[leaves], leaves)
    func = stop.copy()
    is_func = np.flatnonzero(position == SYN_HEAD)
    np.minimum.at(func, bunsetu[is_func], is_func)
    link_offset = np.where(link >= 0, link - start, 0)
    link_bunsetu = np.where(link >= 0, number[head[np.maximum(link, 0)]], -1) if n else link
    found |= {"link_offset": link_offset[bunsetu], "link_bunsetu": link_bunsetu[bunsetu], "func_offset": (func - start)[bunsetu]}
    return result()


def _clauses(f: Flat, options: Options, is_root: np.ndarray, heads: np.ndarray, depth: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The head of each token's clause, a place in the sentence, or -1."""
    n, head = len(f.head), f.head
    here = np.arange(n)
    marked = np.zeros(n, bool)
    for rule in options.markers:
        hit = np.ones(n, bool)
        for name, pattern in rule.items():
            hit &= pc.fill_null(pc.match_substring_regex(f.strings(name), f"^(?:{pattern})$"), False).to_numpy(zero_copy_only=False)
        marked |= hit
    marked &= ~is_root
    clause_head = is_root.copy()
    if marked.any():
        held = total_below(head, depth, heads)
        above = heads[resolve(np.where(heads, here, head))] if n else heads  # a head at or above
        chosen = np.zeros(n, bool)
        chosen[np.where(heads, here, head)[marked & above]] = True
        chosen = chosen & (held >= options.least) | is_root
        nearest = resolve(np.where(chosen, here, head))
        over = np.where((head != here) & chosen[nearest[head]], nearest[head], -1)
        at = np.flatnonzero(chosen)
        clause_head[:] = False
        clause_head[prune_clauses(at, is_root[at], over[at], held[at], options.least)] = True
    owner = resolve(np.where(clause_head, here, head)) if n else here
    return np.where(clause_head[owner], owner - first, -1) if n else here


#: Tokens of a slice that is recognised at once.
TOKENS = 1 << 16


def token_slices(batch: pa.RecordBatch, most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that have `most` tokens, or one sentence."""
    upto = batch.column(batch.schema.get_field_index("tokens")).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def recognised(batch: pa.RecordBatch, options: Options, wanted: Collection[str] | None = None) -> pa.RecordBatch:
    """A batch of sentences with `units`, which have the wanted fields (None: all; none: there are no units)."""
    tokens = batch.column("tokens")
    f = flatten(tokens)
    wanted = ARROW_UNIT.names if wanted is None else wanted
    units = _units(f, options, wanted) if wanted else None
    if not options.keep_suffix and "dep" in f.columns:
        batch = with_column(batch, "tokens", with_fields(tokens, dep=f.changed("dep", lambda x: x and x.removesuffix(SUFFIX))))
    return with_column(batch, "units", units) if wanted else batch


def recognize(sentences: DataFrame, options: Options | None = None) -> DataFrame:
    """sentences with `units`, an array parallel to `tokens`. The bunsetu suffix is taken off dependencies unless it is to be kept."""
    options = options or Options()
    for rule in options.markers:
        for pattern in rule.values():
            re.compile(pattern)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in token_slices(batch):
                yield recognised(part, options)

    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([*sentences.schema.fields, StructField("units", _parse_datatype_string(f"array<{UNIT}>"))])
    return sentences.mapInArrow(stage, schema)
