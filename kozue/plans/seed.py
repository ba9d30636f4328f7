"""Seed annotator: a deterministic stand-in for a trained parser, so that every operator has input in any language.

Its trees are head-final by construction and no linguistic analysis; annotations of a real parser come in through the registry or
as CoNLL-U. Sentences are lines that aren't blank. Tokens are runs of letters and numbers, and single other characters.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ARROW_TOKEN, SENTENCE
from ..operators.trees import scatter
from .flow import field, run, with_column

SEGMENT = r"[ \t\r\f\x0b]+|[\p{L}\p{N}]+|[^ \t\r\f\x0b\p{L}\p{N}]"
ENTITIES = ("Person", "City", "Company", "Country")
CONTENT = ("NUM", "PROPN", "VERB", "NOUN")
#: Parts of speech, those of content first, and relations; kernels work on their places.
POS = (*CONTENT, "ADP", "PUNCT")
NUM, PROPN, VERB, NOUN, ADP, PUNCT = range(6)
RELATIONS = ("ROOT", "case", "punct", "nummod", "compound", "advcl_bunsetu", "nmod_bunsetu")
#: Clause rule of seed trees.
SEED_MARKERS = ({"orth": "[,;]"},)


def pos_of(word: str) -> str:
    if len(word) == 1 and not word.isalnum():
        return "PUNCT"
    if word.isascii() and word.isdigit():
        return "NUM"
    if len(word) <= 2:
        return "ADP"
    if word[0] != word[0].lower():
        return "PROPN"
    return "VERB" if len(word) % 4 == 0 else "NOUN"


def sentences_of(documents: DataFrame) -> DataFrame:
    """doc_id, sent_id, text: the lines of documents that aren't blank, counted from 0 with the blank ones."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sent_id", "text"))
    return lines.filter(F.col("text").rlike(r"[^ \t\r\f\x0b]"))


#: Characters whose small form depends on what is around them, or is more than one.
IRREGULAR = (0x130, 0x3A3)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character: its class (0 blank, 1 letter or number, 2 other), its small form, and whether Python takes it for a letter or
    number."""
    import regex

    known = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    there = np.append(np.arange(0xD800), np.arange(0xE000, 0x110000))
    kind, small, alnum = np.full(0x110000, 2, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for k, pattern in enumerate((r"[ \t\r\f\x0b]+", r"[\p{L}\p{N}]+")):
        for m in regex.finditer(pattern, known):
            kind[there[m.start() : m.end()]] = k
    alnum[there] = np.fromiter(map(str.isalnum, known), bool, len(known))
    for c in regex.findall(r"[\p{Lu}\p{Lt}\p{Lo}\p{So}\p{Nl}]", known[:0x20000]):
        if len(low := c.lower()) == 1:
            small[ord(c)] = ord(low)
    return kind, small, alnum


class Segments:
    """Tokens of lines as SEGMENT finds them: their words, small forms and parts of speech (places in POS), lengths and places in the line
    (characters), whether white space follows, and where each line's tokens begin."""

    def __init__(self, texts: pa.StringArray):
        kind_of, small_of, alnum_of = _characters()
        n = len(texts)
        texts = pc.fill_null(texts, "")
        _, where, held = texts.buffers()
        offset = np.frombuffer(where, np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(held, np.uint8)[offset[0] : offset[-1]] if held else np.zeros(0, np.uint8)
        line = offset - offset[0]
        code, width = _codes(data)
        if width is not None:
            line = np.append(0, np.cumsum((data & 0xC0) != 0x80))[line]
        kind = kind_of[code]
        word, other = kind == 1, kind == 2
        cut = np.zeros(len(kind) + 1, bool)
        cut[line] = True
        at = np.flatnonzero(other | word & (cut[:-1] | np.append(True, ~word)[: len(word)]))
        end = np.flatnonzero(other | word & (cut[1:] | np.append(~word, True)[1:])) + 1
        self.begin = np.searchsorted(at, line)
        row = np.repeat(np.arange(n), np.diff(self.begin))
        self.idx, self.length = at - line[row], end - at
        self.gap = (np.append(kind, 2)[end] == 0) & (end < line[row + 1])
        held_ = kind != 0
        self.words = _strings(data[held_ if width is None else np.repeat(held_, width)], self.length if width is None else _between(width, at, end))
        self._code = code[held_]
        digit = (code >= 48) & (code < 58)
        begins = code[at]
        large = (small_of[begins] != begins) | np.isin(begins, IRREGULAR)
        self.pos = np.select(
            [(self.length == 1) & ~alnum_of[begins], _between(digit, at, end) == self.length, self.length <= 2, large, self.length % 4 == 0], [PUNCT, NUM, ADP, PROPN, VERB], NOUN
        )

    @cached_property
    def low(self) -> pa.StringArray:
        return _lowered(self.words, self._code, self.length)


def _between(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(values, dtype=np.int64))
    return upto[ends] - upto[begins]


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The characters of UTF-8, and how many bytes each has (None: one)."""
    if (data < 128).all():
        return data, None
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), np.diff(np.flatnonzero(np.append((data & 0xC0) != 0x80, True)))


def _lowered(words: pa.StringArray, code: np.ndarray, length: np.ndarray) -> pa.StringArray:
    """Small forms of words; code: their characters on end."""
    small = _characters()[1][code]
    if code.dtype == np.uint8:
        return _strings(small.astype(np.uint8), length)
    if np.isin(code, IRREGULAR).any():
        coded = words.dictionary_encode()
        return pa.array([w.lower() for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    size = 1 + (small > 0x7F) + (small > 0x7FF) + (small > 0xFFFF).astype(np.int64)
    upto = np.append(0, np.cumsum(length))
    return _strings(np.frombuffer(small.tobytes().decode("utf-32-le").encode(), np.uint8), _between(size, upto[:-1], upto[1:]))


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """Strings that follow one another in `data`."""
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def tokens_of(texts: pa.StringArray, wanted: Collection[str] | None = None) -> pa.ListArray:
    """Tokens of lines, by arithmetic over all characters of a batch; wanted: the fields that they are to have (None: all)."""
    found = Segments(texts)
    bounds, codes, n = found.begin, found.pos, len(found.words)
    head, dep = tree(codes, bounds)
    first = np.repeat(bounds[:-1], np.diff(bounds))
    proper = codes == PROPN
    here = np.arange(n)
    follows = proper & np.append(False, proper[:-1]) & (here != first) if n else proper
    start = np.maximum.accumulate(np.where(proper & ~follows, here, 0)) if n else here
    kind = np.where(proper, found.length[start] % 4, 4) if n else here

    def among(names: tuple[str | None, ...], code: np.ndarray) -> pa.Array:
        return pa.array(names, pa.string()).take(pa.array(code))

    fields = {
        "orth": lambda: found.words,
        "ws": lambda: among(("", " "), found.gap.astype(np.int64)),
        "lemma": lambda: found.low,
        "norm": lambda: found.low,
        "pos": lambda: among(POS, codes),
        "tag": lambda: among(tuple(f"{p.lower()}-general" for p in POS), codes),
        "dep": lambda: among(RELATIONS, dep),
        "head": lambda: pa.array((head - first).astype(np.int32)),
        "ent_iob": lambda: among(("O", "B", "I"), proper.astype(np.int64) + follows),
        "ent_type": lambda: among((*ENTITIES, ""), kind),
        "reading": lambda: pc.binary_join_element_wise(among((None, "<"), (codes <= NOUN).astype(np.int64)), found.low, ">", ""),
        "inflection": lambda: among((None, "godan;basic"), (codes == VERB).astype(np.int64)),
        "idx": lambda: pa.array(found.idx.astype(np.int32)),
    }
    kinds = [f for f in ARROW_TOKEN if wanted is None or f.name in wanted]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([fields[f.name]() for f in kinds], fields=kinds))


def tree(pos: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads (places in the batch) and places of relations in RELATIONS; pos: places in POS."""
    n = len(pos)
    here, sizes = np.arange(n), np.diff(begin)
    first, last = np.repeat(begin[:-1], sizes), np.repeat(begin[1:] - 1, sizes)
    if not n:
        return here, here
    verb, noun, content = pos == VERB, (pos == NOUN) | (pos == PROPN), pos <= NOUN

    def before(flag):  # the nearest flagged place to the left, -1 if there is none
        return np.append(-1, np.maximum.accumulate(np.where(flag, here, -1))[:-1])

    def after(flag):
        return np.append(np.minimum.accumulate(np.where(flag, here, n)[::-1])[::-1][1:], n)

    lastly = np.maximum.accumulate(np.where(content, here, -1))[last]
    root = np.where(lastly >= first, lastly, first)
    left, right, next_verb = before(content), after(content), after(verb)
    joined = content & np.append(noun[1:], False) & (here < last) & ((pos == NUM) | noun)
    head = np.where(joined, here + 1, np.where(next_verb <= last, next_verb, root))
    loose = np.where(left >= first, left, np.where(right <= last, right, first))
    head = np.where(content, head, loose)
    head[here == root] = root[here == root]
    dep = np.select([here == root, pos == ADP, pos == PUNCT, joined & (pos == NUM), joined, verb], [0, 1, 2, 3, 4, 5], 6)
    return head, dep


def annotated(batch: pa.RecordBatch, wanted: Collection[str] | None = None) -> pa.RecordBatch:
    """A batch of lines with their tokens, which have the wanted fields (None: all)."""
    return with_column(batch, "tokens", tokens_of(batch.column(2).cast(pa.string()), wanted))


def annotate(lines: DataFrame) -> DataFrame:
    """doc_id, sent_id, text and tokens of lines (doc_id, sent_id, text)."""
    return run(lines, [annotated], SENTENCE)


def with_sub_tokens(sentences: DataFrame, least: int = 8) -> DataFrame:
    """Seed sentences with sub-tokens for words of at least `least` characters: of three characters for A, two halves for B."""

    def sub(piece, token):
        return F.struct(
            piece.alias("surface"), token["tag"].alias("tag"), F.lit("").alias("inf"),
            F.lower(piece).alias("lemma"), F.lit("").alias("reading"), F.lower(piece).alias("norm"),
        )

    def split(t):
        n = F.length(t["orth"])
        thirds = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int")), lambda k: sub(F.substring(t["orth"], k * 3 + 1, F.lit(3)), t))
        half = F.ceil(n / 2).cast("int")
        halves = F.array(sub(F.substring(t["orth"], F.lit(1), half), t), sub(F.substring(t["orth"], half + 1, n), t))
        return F.when(n >= least, F.struct(thirds.alias("a"), halves.alias("b")))

    return sentences.withColumn("sub_tokens", F.transform("tokens", split))


def pieces(tokens: pa.ListArray, mode: str, least: int = 8) -> pa.ListArray:
    """The sub-tokens of each token in a mode, as with_sub_tokens has them; null for short words."""
    orth = field(tokens, "orth")
    length = pc.fill_null(pc.utf8_length(orth), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    long = np.flatnonzero(length >= least)
    words, size = orth.take(pa.array(long)), length[long]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: np.frombuffer(words.buffers()[1], np.int32)[len(long)] if len(long) else 0]
    code, width = _codes(data)
    number = -(-size // 3) if mode == "A" else np.full(len(long), 2)
    of = np.repeat(np.arange(len(long)), number)
    k = np.arange(len(of)) - (np.cumsum(number) - number)[of]
    each = np.minimum(3, size[of] - 3 * k) if mode == "A" else np.where(k == 0, (size[of] + 1) // 2, size[of] // 2)
    upto = np.append(0, np.cumsum(each))
    surface = _strings(data, each if width is None else _between(width, upto[:-1], upto[1:]))
    low = _lowered(surface, code, each)
    tag = field(tokens, "tag").take(pa.array(long[of]))
    none = pa.array([""], pa.string()).take(pa.array(np.zeros(len(of), np.int64)))
    count = np.zeros(len(length), np.int64)
    count[long] = number
    bounds = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
    flat = pa.StructArray.from_arrays([surface, tag, none, low, none, low], ["surface", "tag", "inf", "lemma", "reading", "norm"])
    return pa.ListArray.from_arrays(bounds, flat, mask=pa.array(count == 0))
