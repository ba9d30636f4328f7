"""CoNLL-U: one row a sentence. Files are split at blank lines by the reader itself, so no file is held whole."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trees import scatter
from ..plans.flow import ints, joined, slices
from ..schema import ARROW_TOKEN, TOKEN

SCHEMA = f"src string, sent_id string, newdoc string, text string, tokens array<{TOKEN}>, bi array<string>, ne array<string>, misc array<string>, error string, place struct<block:bigint,row:bigint>"
_ARROW = pa.schema([("src", pa.string()), ("sent_id", pa.string()), ("newdoc", pa.string()), ("text", pa.string()), ("tokens", pa.list_(ARROW_TOKEN)), *[(n, pa.list_(pa.string())) for n in ("bi", "ne", "misc")], ("error", pa.string()), ("place", pa.struct([("block", pa.int64()), ("row", pa.int64())]))])
_TOKEN_ID = re.compile(r"[0-9]+")


def misc_fields(field: str) -> dict[str, str]:
    return dict(x.split("=", 1) if "=" in x else (x, "") for x in field.split("|")) if field != "_" else {}


def parse_block(block: str) -> dict | None:
    """A sentence from its lines; what is wrong with it goes to `error`, and its tokens are then null. None if there is nothing in it."""
    out: dict = dict.fromkeys(_ARROW.names)
    tokens, bi, ne, miscs = [], [], [], []
    try:
        for line in block.split("\n"):
            line = line.rstrip("\r")
            if not line:
                continue
            if line.startswith("#"):
                for key, name in (("# sent_id = ", "sent_id"), ("# newdoc id = ", "newdoc"), ("# text = ", "text")):
                    if line.startswith(key):
                        out[name] = line[len(key) :]
                continue
            f = line.split("\t")
            if len(f) != 10:
                raise ValueError(f"{len(f)} columns: {line[:80]}")
            if not _TOKEN_ID.fullmatch(f[0]):
                continue  # ranges and empty nodes
            if int(f[0]) != len(tokens) + 1:
                raise ValueError(f"token {f[0]} after {len(tokens)}")
            m = misc_fields(f[9])
            head = int(f[6]) - 1
            label = m.get("ENE") or m.get("NE") or "O"
            iob, _, kind = label.partition("-")
            tokens.append(
                {
                    "orth": f[1], "ws": "" if m.get("SpaceAfter") == "No" else " ", "lemma": f[2], "norm": f[2], "pos": f[3], "tag": f[4], "dep": f[7],
                    "head": len(tokens) if head < 0 else head, "ent_iob": iob, "ent_type": kind, "reading": m.get("Reading"), "inflection": m.get("Inf"), "idx": None,
                }
            )
            bi.append(m.get("BunsetuBILabel"))
            ne.append(m.get("NE"))
            miscs.append(f[9])
        if any(t["head"] >= len(tokens) for t in tokens):
            raise ValueError("a head beyond the sentence")
    except ValueError as e:
        return out | {"error": str(e)}
    if not tokens:
        return None if not (out["sent_id"] or out["text"]) else out | {"error": "no tokens"}
    at = 0
    surface = out["text"] if out["text"] is not None else "".join(t["orth"] + t["ws"] for t in tokens).rstrip()
    for t in tokens:  # places by search in the text, white space and all
        found = surface.find(t["orth"], at)
        if found < 0 or surface[at:found].strip():
            return out | {"error": f"{t['orth']} isn't at {at} of the text"}
        t["idx"], at = found, found + len(t["orth"])
    for t, then in zip(tokens, [*tokens[1:], None], strict=False):
        end = t["idx"] + len(t["orth"])
        t["ws"] = surface[end : then["idx"]] if then else surface[end:]
    return out | {"text": surface, "tokens": tokens, "bi": bi, "ne": ne, "misc": miscs}


#: Characters of the blocks that are parsed at once: about 10,000 tokens, which are Python values then.
CHARACTERS = 1 << 20


_TEXT = "# text = "
#: White space beyond ASCII, and that within it.
_RARE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True


def _numbers(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of one to nine digits in stretches of bytes, -1 for anything else."""
    size = end - begin
    value, good = np.zeros(len(begin), np.int64), (size > 0) & (size < 10)
    for k in range(int(size[good].max()) if good.any() else 0):
        digit = data[np.minimum(begin + k, len(data) - 1)].astype(np.int64) - 48
        within = k < size
        good &= ~within | (digit >= 0) & (digit < 10)
        value = np.where(within & good, value * 10 + digit, value)
    return np.where(good, value, -1)


def plain_heads(blocks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which blocks are plain and without fault (a line of text, then tokens alone, whose words follow one another in it with nothing
    between but white space of ASCII), how many tokens they have, and the heads (places) of all their tokens on end. Nothing is said of the
    other blocks: parse_block reads them."""
    plain = np.array(pc.fill_null(pc.and_(pc.starts_with(blocks, _TEXT), pc.ends_with(blocks, "\n")), False), bool)
    rows = np.flatnonzero(plain)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return plain, none, none
    chosen = blocks.take(pa.array(rows))
    offset = np.frombuffer(chosen.buffers()[1], np.int32, len(rows) + 1, chosen.offset * 4).astype(np.int64)
    data = np.frombuffer(chosen.buffers()[2], np.uint8)[offset[0] : offset[-1]]
    offset -= offset[0]
    good = np.ones(len(rows), bool)
    good[np.searchsorted(offset, np.flatnonzero(data == 13), side="right") - 1] = False
    end = np.flatnonzero(data == 10)
    begin = np.append(0, end[:-1] + 1)
    # The first line of each block is its text; those that aren't empty are tokens else.
    first = np.searchsorted(begin, offset[:-1])
    text_begin, text_end = offset[:-1] + len(_TEXT), end[first]
    token = end > begin
    token[first] = False
    begin, end = begin[token], end[token]
    of = np.searchsorted(offset, begin, side="right") - 1
    count = np.bincount(of, minlength=len(rows))
    good &= count > 0
    i = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    tabs = np.flatnonzero(data == 9)
    at = np.searchsorted(tabs, begin)
    right = (np.searchsorted(tabs, end) - at == 9) & (data[begin] != 35)
    good[of[~right]] = False
    tab = lambda k: np.where(right, tabs[np.minimum(at + k, len(tabs) - 1)] if len(tabs) else begin, begin)
    word, word_end = tab(0) + 1, tab(1)
    head = _numbers(data, tab(5) + 1, tab(6))
    good[of[(_numbers(data, begin, tab(0)) != i + 1) | (head < 0) | (head > count[of])]] = False
    # Words on end are the text without its white space, which may be between words only.
    length = text_end - text_begin
    letters = data[scatter(text_begin, length)]
    texts = pa.StringArray.from_buffers(len(rows), pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32)), pa.py_buffer(letters))
    good &= ~np.array(pc.match_substring_regex(texts, _RARE), bool)
    size = np.where(right, word_end - word, 0)
    blank, text = _SPACE[letters], np.repeat(np.arange(len(rows)), length)
    good &= length - np.bincount(text[blank], minlength=len(rows)) == np.bincount(of, size, len(rows))
    some, shown = good[of], good[text]
    letters, blank, text = letters[shown], blank[shown], text[shown]
    written = data[scatter(word[some], size[some])]
    cut = np.zeros(len(written) + 1, bool)
    cut[np.append(0, np.cumsum(size[some]))] = True
    good[text[~blank][letters[~blank] != written]] = False
    good[text[blank & ~cut[np.cumsum(~blank)]]] = False
    plain[rows[~good]] = False
    some = good[of]
    return plain, count[good], np.where(head == 0, i, head - 1)[some]


def parsed_heads(batch: pa.RecordBatch) -> pa.RecordBatch:
    """src, n, error and heads (places) of blocks: doc_id, sent_id, out; src is of the two ids."""
    blocks = batch.column(2)
    plain, count, heads = plain_heads(blocks)
    order, slow = np.flatnonzero(plain), []
    others = np.flatnonzero(~plain)
    for k, block in zip(others.tolist(), blocks.take(pa.array(others)).to_pylist(), strict=True):
        if s := parse_block(block or ""):
            t = s["tokens"]
            slow.append((k, None if t is None else len(t), s["error"], "" if t is None else " ".join([str(x["head"]) for x in t])))
    order = np.append(order, np.array([x[0] for x in slow], np.int64))
    by = pa.array(np.argsort(order))
    rest = [pa.array([x[k] for x in slow], kind) for k, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
    found = (ints(count), pa.nulls(len(count), pa.string()), joined(ints(heads), np.append(0, np.cumsum(count)), " "))
    src = pc.binary_join_element_wise(batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), "-")
    return pa.RecordBatch.from_arrays([src.take(pa.array(np.sort(order))), *[pa.concat_arrays([a, b]).take(by) for a, b in zip(found, rest, strict=True)]], ["src", "n", "error", "heads"])


def parse(blocks: DataFrame) -> DataFrame:
    """Sentences of blocks (src, value and, if known, place: what orders those of a file)."""
    placed = blocks if "place" in blocks.columns else blocks.withColumn("place", F.lit(None).cast("struct<block:bigint,row:bigint>"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, CHARACTERS)):
            rows = [s | {"src": src, "place": place} for src, b, place in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (s := parse_block(b or ""))]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return placed.select("src", "value", "place").mapInArrow(stage, SCHEMA)


def read_conllu(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """Sentences of files, of folders and what is in them, of a list of such, or of standard input for "-"."""
    paths = [path] if isinstance(path, str) else list(path)
    parts = []
    if files := [p for p in paths if p != "-"]:
        raw = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", str(recursive).lower()).text(files)
        row = F.monotonically_increasing_id().alias("row")
        parts.append(raw.select(F.col("_metadata.file_path").alias("src"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), row).alias("place")))
    if "-" in paths:
        rows = [("-", block, (0, k)) for k, block in enumerate(sys.stdin.read().split("\n\n"))]
        parts.append(spark.createDataFrame(rows, "src string, value string, place struct<block:bigint,row:bigint>"))
    blocks = parts[0]
    for p in parts[1:]:
        blocks = blocks.unionByName(p)
    return parse(blocks)


def write_conllu_text(tokens: list[dict], misc: list[str], text: str, sent_id: str | None = None) -> str:
    """Lines of a sentence from what was read."""
    lines = ([f"# sent_id = {sent_id}"] if sent_id else []) + [f"# text = {text}"]
    for i, (t, m) in enumerate(zip(tokens, misc, strict=True)):
        lines.append("\t".join((str(i + 1), t["orth"], t["lemma"], t["pos"], t["tag"], "_", str(0 if t["head"] == i else t["head"] + 1), t["dep"], "_", m)))
    return "\n".join(lines) + "\n\n"
