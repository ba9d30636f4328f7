"""Token counts by two compiled finite-state transducers.

The first splits a text into pieces. Its eleven states and eleven character classes are compiled from the pattern of the byte-level
vocabularies; each transition is annotated with the pieces whose first character becomes certain there, this one or the one
before. A text is cut into chunks of fixed length. Every chunk is run from all states at once, which gives its state map (exit
state and emitted pieces for each entry state); the maps compose by a parallel prefix scan, and the scan gives each chunk its
true entry state.

The second runs over the bytes of a piece. Its states are the prefixes' last tokens at the cuts that a longer token could still
begin at, so the merge order of the vocabulary is decided without merging; a transition is annotated with the change of the
token count. It is determinised as the data need it.

Cases: a null text counts null; an empty text counts 0; a text of any length is read whole; ids may be null or repeated; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import DEFAULT_RANKS, Memo, load_ranks
from .common import col, numbered
from .kernels import slices

# Character classes. The letters that contractions need have their own.
WHITE, SPACE, NUMBER, QUOTE, OTHER, LETTER, STMD, RV, L, E, NONE = range(11)
# States: after a boundary; in a run of letters, numbers, others; after one white character (a space, another) or several
# (a space last, another last); after a quote that begins a piece, and after r or v, or l, behind it.
(START, LETTERS, NUMBERS, OTHERS, SPACE1, WHITE1, SPACES, WHITES, QUOTED, QUOTED_RV, QUOTED_L) = range(11)
STATES = 11
#: Annotations: a piece begins at this character; at the one before.
HERE, BEFORE = 1, 2
CHUNK = 256
#: Characters after which chunks are looked at for having come to one state.
SETTLE = 12


def _compile() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state and annotation by class and state, and the annotation at the end of a text, where BEFORE means its last character."""
    to, marks = np.zeros((11, STATES), np.uint8), np.zeros((11, STATES), np.uint8)
    letters = (LETTER, STMD, RV, L, E)
    run = {NUMBER: NUMBERS, OTHER: OTHERS, **dict.fromkeys(letters, LETTERS)}
    fresh = run | {QUOTE: QUOTED, SPACE: SPACE1, WHITE: WHITE1}
    joined = run | {QUOTE: OTHERS}

    def put(state, kind, target, mark):
        to[kind, state], marks[kind, state] = target, mark

    for state in range(STATES):
        put(state, NONE, state, 0)
        for kind in range(NONE):
            put(state, kind, fresh[kind], HERE)
    for kind in letters:
        put(LETTERS, kind, LETTERS, 0)
    put(NUMBERS, NUMBER, NUMBERS, 0)
    for state in (OTHERS, QUOTED):
        put(state, OTHER, OTHERS, 0)
        put(state, QUOTE, OTHERS, 0)
    for state in (SPACE1, WHITE1, SPACES, WHITES):
        put(state, SPACE, SPACES, 0)
        put(state, WHITE, WHITES, 0)
    for kind, target in joined.items():
        put(SPACE1, kind, target, 0)
        put(SPACES, kind, target, BEFORE)
    for kind, target in fresh.items():
        if kind not in (SPACE, WHITE):
            put(WHITES, kind, target, HERE | BEFORE)
    put(QUOTED, STMD, START, 0)
    put(QUOTED, RV, QUOTED_RV, 0)
    put(QUOTED, L, QUOTED_L, 0)
    for state, last in ((QUOTED_RV, E), (QUOTED_L, L)):
        for kind in range(NONE):
            put(state, kind, fresh[kind], BEFORE if kind in letters else HERE | BEFORE)
        put(state, last, START, 0)
    final = np.zeros(STATES, np.uint8)
    final[[QUOTED_RV, QUOTED_L]] = BEFORE
    return to, marks, final


_TO, _MARKS, _FINAL = _compile()
_PIECES = np.array([0, 1, 1, 2], np.int32)[_MARKS]
_TO_FLAT, _MARKS_FLAT = _TO.ravel().astype(np.int16), _MARKS.ravel()
#: Next state and 16 times the emitted pieces, by class and state.
_MOVES = (_TO + 16 * _PIECES).ravel().astype(np.int16)


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    table[32], table[39] = SPACE, QUOTE
    for letters, kind in (("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
        table[[ord(x) for x in letters]] = kind
    return table


def _run(kinds: np.ndarray, state: np.ndarray, emitted: np.ndarray) -> None:
    """Take state and emitted, by chunk and entry state, through the characters of kinds, by place and chunk."""
    for row in kinds:
        move = _MOVES.take(state + row[:, None])
        emitted += move >> 4
        np.bitwise_and(move, 15, out=state)


def piece_starts(points: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins at each character; points are the code points of texts on end, and offsets where texts begin."""
    sizes = np.diff(offsets)
    lanes_of = -(-sizes // chunk)
    lanes = int(lanes_of.sum())
    starts = np.zeros(len(points) + 1, bool)
    if not lanes:
        return starts[:0]
    lane_text = np.repeat(np.arange(len(sizes)), lanes_of)
    first_lane = np.cumsum(lanes_of) - lanes_of
    begin = offsets[lane_text] + (np.arange(lanes) - first_lane[lane_text]) * chunk
    stop = np.minimum(begin + chunk, offsets[lane_text + 1])
    kinds = np.append(classes()[points], NONE)
    at = begin[None, :] + np.arange(chunk)[:, None]
    at[at >= stop[None, :]] = len(points)
    kinds = kinds[at].astype(np.int16) * STATES  # by place in the chunk and lane
    # The state map of each chunk, from all entry states at once. A few characters on, most chunks are in one state whatever
    # they were entered in; from there on, one run serves all entry states of such a chunk.
    exits = np.tile(np.arange(STATES, dtype=np.int16), (lanes, 1))
    emitted = np.zeros((lanes, STATES), np.int32)
    _run(kinds[:SETTLE], exits, emitted)
    settled = np.flatnonzero((exits == exits[:, :1]).all(1))
    one, more = np.ascontiguousarray(exits[settled, :1]), np.zeros((len(settled), 1), np.int32)
    _run(kinds[SETTLE:, settled], one, more)
    open_ = np.flatnonzero((exits != exits[:, :1]).any(1))
    rest, rest_emitted = exits[open_], emitted[open_]
    _run(kinds[SETTLE:, open_], rest, rest_emitted)
    exits[settled], exits[open_] = one, rest
    emitted[settled] += more
    emitted[open_] = rest_emitted
    opening = np.zeros(lanes, bool)
    opening[first_lane[lanes_of > 0]] = True
    exits[opening], emitted[opening] = exits[opening, :1], emitted[opening, :1]  # a text begins at a boundary, whatever came before
    # Prefix scan: after the step of width d, a map covers the 2d chunks that end with its own.
    reach = 1
    while reach < lanes:
        left, right = exits[:-reach], exits[reach:]
        emitted[reach:] = np.where(opening[reach:, None], emitted[reach:], emitted[:-reach] + np.take_along_axis(emitted[reach:], left.astype(np.int64), 1))
        exits = np.concatenate((exits[:reach], np.where(opening[reach:, None], right, np.take_along_axis(right, left.astype(np.int64), 1))))
        opening = np.concatenate((opening[:reach], opening[reach:] | opening[:-reach]))
        reach *= 2
    entry = np.zeros(lanes, np.int16)
    entry[1:] = exits[:-1, 0]
    entry[first_lane[lanes_of > 0]] = START
    # With its entry state known, each chunk writes the marks that the count stood for.
    state = entry
    starts[:] = False
    for row, place in zip(kinds, at, strict=True):
        index = state + row
        mark = _MARKS_FLAT[index]
        starts[place[mark & HERE > 0]] = True
        starts[place[mark & BEFORE > 0] - 1] = True
        state = _TO_FLAT[index]
    last = first_lane + lanes_of - 1
    open_end = (lanes_of > 0) & (_FINAL[state[np.maximum(last, 0)]] > 0)
    starts[offsets[1:][open_end] - 1] = True
    starts = starts[:-1]
    counted = emitted[last[lanes_of > 0], 0] + open_end[lanes_of > 0]
    marked = np.add.reduceat(starts.astype(np.int64), offsets[:-1][lanes_of > 0])
    if not np.array_equal(counted, marked):
        raise AssertionError("composed state maps and marks disagree")
    return starts


class CountingAutomaton:
    """Deterministic transducer from the bytes of a piece to changes of its token count.

    `states` bounds the memory of what has been determinised: beyond it, it starts anew and results stay the same. It should be
    well above the states that the data keep coming back to, or they are made again and again.
    """

    def __init__(self, ranks: dict[bytes, int], states: int = 300_000):
        from .bpe import Encoder

        self.ranks, self.limit = ranks, states
        self.merge = Encoder(ranks).merge
        self.prefixes = {part: part for token in ranks for part in (token[:k] for k in range(1, len(token)))}
        self.tokens = {token: token for token in ranks}
        self.reset()

    def reset(self) -> None:
        self.cuts: dict[tuple, tuple] = {}  # one object for equal cuts of all states
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: dict[int, int] = {}  # (state, byte) to (next state, change + 2^15), each packed into an integer
        self.pairs: dict[int, bool] = {}
        self.add([(b"", b"", 0)])

    def add(self, cuts: list[tuple]) -> int:
        """A state is a tuple of open cuts: the bytes since the cut, the last token before it, and tokens added since the cut."""
        key = tuple(self.cuts.setdefault(c, c) for c in cuts)
        state = self.ids.setdefault(key, len(self.keys))
        if state == len(self.keys):
            self.keys.append(key)
        return state

    def follows(self, left: bytes, token: bytes) -> bool:
        """Whether token can come right after left (none at a piece's start) in an encoding."""
        before, rank = self.ranks[left] if left else -1, self.ranks[token]
        pair = (before + 1) << 24 | rank
        if (known := self.pairs.get(pair)) is None:
            known = self.pairs[pair] = self.merge(left + token) == ([before] if left else []) + [rank]
        return known

    def step(self, state: int, byte: int) -> int:
        key, b = self.keys[state], bytes((byte,))
        for since, left, added in key:  # longest first
            token = self.tokens.get(since + b)
            if token is not None and self.follows(left, token):
                break
        else:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        change = 1 - added  # from the count now, over this cut, to one more than at the cut
        cuts = [(part, before, n + change) for since, before, n in key if (part := self.prefixes.get(since + b)) is not None]
        move = self.moves[state << 8 | byte] = self.add([*cuts, (b"", token, 0)]) << 16 | change + 0x8000
        return move

    def count(self, piece: bytes) -> int:
        if len(self.keys) > self.limit or len(self.pairs) > 4 * self.limit:
            self.reset()
        state = total = 0
        get = self.moves.get
        for byte in piece:
            move = get(state << 8 | byte)
            if move is None:
                move = self.step(state, byte)
            state = move >> 16
            total += (move & 0xFFFF) - 0x8000
        return total


@lru_cache(2)
def _counter(path: str) -> Memo:
    automaton = CountingAutomaton(load_ranks(path))
    return Memo(lambda piece: automaton.count(piece.encode()), 150_000)


def count_batch(texts: list[str | None], memo: Memo) -> np.ndarray:
    joined = "".join(t or "" for t in texts)
    offsets = np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))
    starts = np.flatnonzero(piece_starts(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets))
    bounds = [*starts.tolist(), len(joined)]
    pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    counts = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces)), out=counts[1:])
    memo.age()
    return np.diff(counts[np.searchsorted(starts, offsets)])


def counted(df: DataFrame, text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """df with each text replaced by the number of its tokens."""
    place = df.columns.index(text_col)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _counter(ranks)
        for batch in slices(batches, place, 1 << 20):
            texts = batch.column(place).to_pylist()
            void = np.array([t is None for t in texts], bool)
            columns = list(batch.columns)
            columns[place] = pa.array(count_batch(texts, memo), pa.int64(), mask=void)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    work = numbered(df)
    schema = StructType([StructField(f.name, LongType() if k == place else f.dataType) for k, f in enumerate(work.schema.fields)])
    return work.mapInArrow(stage, schema).toDF(*df.columns)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Number of tokens of each text in the vocabulary: columns doc_id, n_tokens."""
    return counted(df.select(col(id_col).alias("doc_id"), col(text_col).alias("n_tokens")), "n_tokens", ranks)
