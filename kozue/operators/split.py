"""Compound splitting: tokens are replaced by their sub-tokens of mode A (short) or B (middle); C and None leave them.

`sub_tokens` is an array parallel to `tokens`; an element is null or holds lists a and b. Heads are resolved at once: each old
token has a range of new places, and an anchor that others attach to. So the order of splitting doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ARROW_TOKEN
from .recognize import Flat, flatten, token_slices
from .tokens import joined

MODES = ("A", "B", "C", None)
DEP_BY_TAG = {"ADJ": "amod", "ADP": "case", "NUM": "nummod", "PART": "mark", "PUNCT": "punct"}
TIGHT = ("compound", "nummod", "punct")

#: (surface, tag, next tag) to the part of speech, and that of the next piece if it is decided with it.
PosRule = Callable[[str, str, str | None], tuple[str, str | None]]


def default_pos(surface: str, tag: str, following: str | None) -> tuple[str, str | None]:
    """Universal part of speech by the head of a hyphenated tag."""
    table = {"名詞": "NOUN", "動詞": "VERB", "形容詞": "ADJ", "形状詞": "ADJ", "副詞": "ADV", "代名詞": "PRON", "連体詞": "DET", "接続詞": "CCONJ", "感動詞": "INTJ", "助詞": "ADP", "助動詞": "AUX", "接頭辞": "NOUN", "接尾辞": "NOUN", "補助記号": "PUNCT", "記号": "SYM", "空白": "SPACE"}
    if tag.startswith("名詞-固有名詞"):
        return "PROPN", None
    if tag.startswith("名詞-数詞"):
        return "NUM", None
    if tag.startswith("名詞") and "サ変可能" in tag and (following or "").startswith("動詞-非自立可能"):
        return "VERB", "AUX"
    head = tag.split("-")[0]
    return table.get(head, head.upper() if head.isascii() and head else "X"), None


#: Rules that don't look at the surface.
BY_TAGS = (default_pos,)


def check_mode(mode: str | None) -> str | None:
    if mode not in MODES:
        raise ValueError(f"split mode is A, B, C or None, not {mode}")
    return mode


def split_sentence(tokens: list[dict], subs: list[dict | None] | None, mode: str, pos_rule: PosRule = default_pos) -> list[dict]:
    pieces = [(s or {}).get(mode.lower()) or None for s in subs or []] or [None] * len(tokens)
    first, last, n = [], [], 0
    for p in pieces:
        first.append(n)
        n += len(p) if p else 1
        last.append(n - 1)
    dep = ["ROOT" if t["head"] == i else t["dep"] for i, t in enumerate(tokens)]
    anchor = [first[i] if dep[i] in TIGHT else last[i] for i in range(len(tokens))]
    out = []
    for i, (t, p) in enumerate(zip(tokens, pieces, strict=True)):
        up = last[i] if t["head"] == i else anchor[t["head"]]
        if not p:
            out.append(t | {"head": first[i] if t["head"] == i else up})
            continue
        tags = [x["tag"] for x in p] + [tokens[i + 1]["tag"] if i + 1 < len(tokens) else None]
        pending, at = None, t["idx"]
        for k, x in enumerate(p):
            if pending:
                pos, pending = pending, None
            else:
                pos, pending = pos_rule(x["surface"], x["tag"], tags[k + 1])
            final = k == len(p) - 1
            inside = t["head"] != i and dep[i] not in TIGHT and not final
            reading = (x.get("reading") or "").replace("=", "_").replace("|", "_") or None
            out.append(
                t
                | {
                    "orth": x["surface"],
                    "ws": t["ws"] if final else "",
                    "lemma": x["lemma"],
                    "norm": x["norm"],
                    "tag": x["tag"],
                    "pos": pos,
                    "dep": t["dep"] if final else DEP_BY_TAG.get(x["tag"], "compound"),
                    "head": last[i] if inside else up,
                    "ent_iob": t["ent_iob"] if not k else ("I" if t["ent_iob"] == "B" else t["ent_iob"]),
                    "reading": reading,
                    "inflection": x.get("inf") or None,
                    "idx": at,
                }
            )
            at = None if at is None else at + len(x["surface"])
    return out


def split_batch(tokens: pa.ListArray, subs: pa.ListArray, mode: str, pos_rule: PosRule = default_pos) -> pa.ListArray:
    """split_sentence for all sentences of a batch at once."""
    return split_lists(tokens, _aligned(tokens, subs, mode), pos_rule)


def split_lists(tokens: pa.ListArray, lists: pa.ListArray, pos_rule: PosRule = default_pos) -> pa.ListArray:
    """Sentences with their tokens replaced by pieces; lists: those of each token, null for none. Pieces have the fields that tokens have;
    reading and inflection may be left out."""
    f = flatten(tokens)
    n, head = len(f.head), f.head
    sizes = np.where(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)) > 0, np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), 0)
    has = sizes > 0
    count = np.maximum(sizes, 1)
    last = np.cumsum(count) - 1
    first = last - count + 1
    here = np.arange(n)
    root = head == here
    tight = f.is_in("dep", TIGHT) & ~root
    anchor = np.where(tight, first, last)
    old = np.repeat(here, count)
    k = np.arange(len(old)) - first[old]
    final = k == count[old] - 1
    piece = has[old]
    up = np.where(root, last, anchor[head] if n else here)[old]
    new_head = np.where(piece & ~root[old] & ~tight[old] & ~final, last[old], up)
    values = lists.flatten()
    place = np.where(piece, np.cumsum(piece) - 1, 0)
    mask, of_own, of_both = pa.array(piece), pa.array(old), pa.array(np.where(piece, n + place, old))

    def both(name: str, sub: str) -> pa.Array:
        return pa.concat_arrays([f.strings(name), values.field(sub)]).take(of_both) if len(values) else f.strings(name).take(of_own)

    surface, tag = both("orth", "surface"), both("tag", "tag")
    replaced = {"orth", "tag", "lemma", "norm", "head"} if len(values) else {"head"}
    fields = {name: f.strings(name).take(of_own) for name in f.columns if name not in replaced}
    if len(values):
        empty = pa.scalar(None, pa.string())
        if "reading" in fields:
            read = pc.replace_substring(pc.replace_substring(pc.fill_null(values.field("reading"), ""), "=", "_"), "|", "_")
            fields["reading"] = pc.if_else(mask, pc.if_else(pc.equal(read, ""), empty, read).take(pa.array(place)), fields["reading"])
        if "inflection" in fields:
            inflection = both("inflection", "inf")
            fields["inflection"] = pc.if_else(mask, pc.if_else(pc.equal(pc.fill_null(inflection, ""), ""), empty, inflection), fields["inflection"])
        coded = tag.dictionary_encode()
        dep_of = pa.array([DEP_BY_TAG.get(x, "compound") for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        later = pa.array(piece & (k > 0))
        iob = pc.if_else(pc.and_(later, pc.equal(fields["ent_iob"], "B")), "I", fields["ent_iob"])
        width = np.asarray(pc.fill_null(pc.utf8_length(surface), 0)).astype(np.int64)
        before = np.cumsum(width) - width
        shift = pa.array((before - before[first[old]]).astype(np.int32))
        pos = _pieces_pos(f, has, first, last, old, piece, fields["pos"], surface, tag, pos_rule)
        fields |= {
            "orth": surface,
            "tag": tag,
            "lemma": both("lemma", "lemma"),
            "norm": both("norm", "norm"),
            "ent_iob": iob,
            "pos": pos,
            "ws": pc.if_else(pa.array(piece & ~final), "", fields["ws"]),
            "dep": pc.if_else(pa.array(piece & ~final), dep_of, fields["dep"]),
            "idx": pc.add(fields["idx"], shift),
        }
    begin = np.append(0, np.cumsum(count))[f.begin]
    fields["head"] = pa.array((new_head - np.repeat(begin[:-1], np.diff(begin))).astype(np.int32))
    kinds = [x for x in ARROW_TOKEN if x.name in fields]
    struct = pa.StructArray.from_arrays([fields[x.name].cast(x.type) for x in kinds], fields=kinds)
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), struct)


def _pieces_pos(f: Flat, has: np.ndarray, first: np.ndarray, last: np.ndarray, old: np.ndarray, piece: np.ndarray, own: pa.Array, surface: pa.Array, tag: pa.Array, pos_rule: PosRule) -> pa.Array:
    """Parts of speech of pieces. A rule that looks at tags alone is asked once for each pair of tags, unless it decides for two pieces
    at once somewhere; then, as with other rules, they are decided one by one."""
    ends = np.zeros(len(has) + 1, bool)
    ends[f.begin[1:]] = True
    if pos_rule in BY_TAGS and not tag.null_count:
        coded = tag.dictionary_encode()
        known = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64)
        end = np.arange(len(old)) == last[old]
        # What follows a token's last piece is the next token's own tag, which isn't that of its first piece where it is cut.
        words = f.strings("tag").dictionary_encode()
        names = words.dictionary.to_pylist()
        word = words.indices.to_numpy().astype(np.int64)
        inner = np.append(code[1:], 0)
        outer = np.where(ends[old + 1], -1, np.append(word, 0)[old + 1]) + len(known)
        pairs, of = np.unique(np.where(piece, code * (len(known) + len(names) + 1) + np.where(end, outer + 1, inner), -1), return_inverse=True)
        followers = [*known, None, *names]
        found = [pos_rule("", known[p // len(followers)], followers[p % len(followers)]) if p >= 0 else ("", None) for p in pairs.tolist()]
        if all(b is None for _, b in found):
            return pc.if_else(pa.array(piece), pa.array([a for a, _ in found], pa.string()).take(pa.array(of)), own)
    pos, surfaces, tags, own_tags = own.to_pylist(), surface.to_pylist(), tag.to_pylist(), f.strings("tag").to_pylist()
    for i in np.flatnonzero(has).tolist():
        pending, a, b = None, int(first[i]), int(last[i])
        for j in range(a, b + 1):
            if pending:
                pos[j], pending = pending, None
            else:
                following = tags[j + 1] if j < b else own_tags[i + 1] if not ends[i + 1] else None
                pos[j], pending = pos_rule(surfaces[j], tags[j], following)
    return pa.array(pos, pa.string())


def _aligned(tokens: pa.ListArray, subs: pa.ListArray, mode: str) -> pa.ListArray:
    """The lists of a mode, one for each token; sentences without sub-tokens get nulls."""
    if not subs.null_count and subs.offsets.equals(tokens.offsets):
        flat = subs.flatten()
        lists = flat.field(mode.lower())
        return pc.if_else(flat.is_valid(), lists, pa.scalar(None, lists.type)) if flat.null_count else lists
    kind = subs.type.value_type.field(mode.lower()).type
    rows = [([(x or {}).get(mode.lower()) for x in s] if s else [None] * len(t)) for s, t in zip(subs.to_pylist(), tokens.to_pylist(), strict=True)]
    return pa.array([x for r in rows for x in r], kind)


def split_compounds(sentences: DataFrame, mode: str | None, pos_rule: PosRule = default_pos) -> DataFrame:
    """sentences with tokens split; `sub_tokens` is dropped where it has been used up, and kept for mode None."""
    check_mode(mode)
    if mode is None or "sub_tokens" not in sentences.columns:
        return sentences
    if mode == "C":
        return sentences.drop("sub_tokens")
    names = sentences.columns
    t, s = names.index("tokens"), names.index("sub_tokens")
    rest = [n for n in names if n != "sub_tokens"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in token_slices(batch):
                split = split_batch(part.column(t), part.column(s), mode, pos_rule)
                yield pa.RecordBatch.from_arrays([split if n == "tokens" else part.column(names.index(n)) for n in rest], rest)

    return sentences.mapInArrow(stage, sentences.drop("sub_tokens").schema)


def sub_tokens(token: Column, sub: Column, mode: str, func: Callable[[Column], Column] = lambda x: x["surface"], join: Callable[[Column], Column] = joined) -> Column:
    """Sub-tokens of a token, mapped and joined; a token without any stands for itself."""
    own = F.array(
        F.struct(
            token["orth"].alias("surface"), token["tag"].alias("tag"), F.coalesce(token["inflection"], F.lit("")).alias("inf"),
            token["lemma"].alias("lemma"), F.coalesce(token["reading"], F.lit("")).alias("reading"), token["norm"].alias("norm"),
        )
    )
    return join(F.transform(F.coalesce(sub[check_mode(mode).lower()], own), func))
