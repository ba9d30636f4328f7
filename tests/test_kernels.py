"""Kernels over all characters or tokens of a batch against their definitions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import regex

from kozue.operators import formats, phrases, tokens, treebank, trees
from kozue.operators.recognize import Options, recognised
from kozue.plans import flow, seed
from kozue.schema import ARROW_TOKEN
from kozue.sources import conllu

LETTERS = " \tabcdefghXYZ019,.;-#=|\\éÈİΣσ漢٣²\x85\xa0\U0001f600"


def lines(r: random.Random, letters: str = LETTERS, n: int = 6) -> pa.RecordBatch:
    texts = ["".join(r.choice(letters) for _ in range(r.choice((0, 1, 5, 40)))) + "x" for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array(texts)], ["doc_id", "sent_id", "text"])


def test_segments_equal_the_pattern():
    r = random.Random(1)
    for _ in range(200):
        batch = lines(r).slice(1)
        found = seed.Segments(batch.column(2))
        assert len(found.begin) == batch.num_rows + 1
        for k, text in enumerate(batch.column(2).to_pylist()):
            a, b = found.begin[k : k + 2]
            parts = [m for m in regex.finditer(seed.SEGMENT, text) if m[0][0] not in " \t\r\f\x0b"]
            words = [m[0] for m in parts]
            assert found.words[a:b].to_pylist() == words
            assert found.low[a:b].to_pylist() == [w.lower() for w in words]
            assert [seed.POS[p] for p in found.pos[a:b]] == [seed.pos_of(w) for w in words]
            assert found.idx[a:b].tolist() == [m.start() for m in parts]
            assert found.gap[a:b].tolist() == [text[m.end() : m.end() + 1] in tuple(" \t\r\f\x0b") for m in parts]


def test_pieces_are_cut_by_characters():
    r = random.Random(2)
    for letters in ("abcdefghé ", "abcdefgh Σİ漢"):
        tokens = seed.annotated(lines(r, letters, 60)).column("tokens")
        words = [t["orth"] for s in tokens.to_pylist() for t in s]
        for mode in "AB":
            for word, found in zip(words, seed.pieces(tokens, mode).to_pylist(), strict=True):
                half = (len(word) + 1) // 2
                cut = [word[k : k + 3] for k in range(0, len(word), 3)] if mode == "A" else [word[:half], word[half:]]
                assert (found and [(p["surface"], p["lemma"]) for p in found]) == ([(c, c.lower()) for c in cut] if len(word) >= 8 else None)


def test_plain_blocks_have_the_heads_that_the_parser_reads():
    r = random.Random(3)
    some = 0
    for k in range(200):
        batch = formats.conllu_lines(recognised(seed.annotated(lines(r, "ab Z1, .;\tQrsé#\xa0" if k % 2 else LETTERS)), Options(markers=())))
        blocks = batch.column(2).to_pylist()
        for j, block in enumerate(blocks):
            c = r.randrange(len(block))
            blocks[j] = r.choice((block, block[:c] + block[c + 1 :], block[:c] + r.choice("\t\n 0#9\rab+_") + block[c:], "# sent_id = 3\n" + block, block[:c]))
        plain, count, heads = conllu.plain_heads(pa.array(blocks, pa.string()))
        some += plain.sum()
        ends = np.append(0, np.cumsum(count))
        for n, j in enumerate(np.flatnonzero(plain).tolist()):
            read = conllu.parse_block(blocks[j])
            assert read["error"] is None and [t["head"] for t in read["tokens"]] == heads[ends[n] : ends[n + 1]].tolist()
        rows = conllu.parsed_heads(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.string())], batch.schema.names)).to_pylist()
        read = [(f"{j}-0", s) for j, b in enumerate(blocks) if (s := conllu.parse_block(b))]
        assert [(x["src"], x["error"], x["n"]) for x in rows] == [(k, s["error"], None if s["tokens"] is None else len(s["tokens"])) for k, s in read]
    assert some > 200


def test_bunsetu_roots_equal_those_found_token_by_token():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 12)
        head, dep = [r.randrange(n) for _ in range(n)], [r.choice(("ROOT", "nmod", "case", "case")) for _ in range(n)]
        start = sorted({0, *(r.randrange(n) for _ in range(r.randint(0, 4)))})
        roots = treebank._roots(np.array(head), np.array([d == "ROOT" for d in dep]), np.array(start))
        marked = treebank.mark_bunsetu_heads(head, dep, ["B" if i in start else "I" for i in range(n)])
        assert [d if d == "ROOT" or i not in roots else d + "_bunsetu" for i, d in enumerate(dep)] == marked


def forest(r: random.Random, n: int, circles: bool) -> list[int]:
    """Heads of n tokens: chains and bushes, in any order of places."""
    order = r.sample(range(n), n)
    head = list(range(n))
    for k, i in enumerate(order):
        if r.random() < 0.95:
            head[i] = order[r.randrange(n)] if circles and r.random() < 0.2 else order[max(0, k - r.choice((1, 1, 1, 30)))]
    return head


def test_sums_over_subtrees_equal_those_by_climbing():
    r = random.Random(5)
    for k in range(120):
        n = r.choice((0, 1, 5, 60, 400))
        head = forest(r, n, circles=k % 3 == 0)
        held = [[] for _ in head]
        for i in range(n):
            way, at = [i], i
            while head[at] != at and head[at] not in way:
                at = head[at]
                way.append(at)
            for a in way if head[at] == at else [i]:  # a way into a circle isn't summed up
                held[a].append(i)
        h = np.array(head, np.int64)
        depth = trees.depths(h)
        left, right, size = trees.edges(h, depth)
        assert (left.tolist(), right.tolist(), size.tolist()) == ([min(x) for x in held], [max(x) for x in held], [len(x) - 1 for x in held])
        assert trees.total_below(h, depth, np.arange(n) % 3).tolist() == [sum(i % 3 for i in x) for x in held]


def test_deep_trees_cost_no_array_a_level():
    n = 30_000
    for head in (np.minimum(np.arange(n) + 1, n - 1), np.append(np.minimum(np.arange(n) + 1, n - 1), np.full(n, n - 1))):
        depth = trees.depths(head)
        wide, nodes, above = trees.levels(depth)
        assert len(wide) <= 1 and sum(map(len, wide)) + len(nodes) - above == len(head) - 1
        left, right, size = trees.edges(head, depth)
        assert size[n - 1] == len(head) - 1 and size[: n - 1].tolist() == list(range(n - 1)) and not left[:n].any() and right[n - 1] == len(head) - 1


def test_first_paths_equal_those_by_climbing():
    r = random.Random(6)
    for k in range(120):
        heads = [forest(r, r.choice((0, 1, 2, 3, 9, 70)), circles=k % 3 == 0) for _ in range(r.randint(0, 6))]
        flat = pa.array([i for h in heads for i in h], pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(h) for h in heads])).astype(np.int32)), pa.StructArray.from_arrays([flat], fields=[ARROW_TOKEN.field(ARROW_TOKEN.get_field_index("head"))]))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(heads)), pa.int64()), pa.array([0] * len(heads), pa.int32()), lists], ["doc_id", "sent_id", "tokens"])
        wanted = []
        for h in heads:
            way, at = [], 0
            while h and h[at] not in (at, 0, *way):
                at = h[at]
                way.append(at)
            wanted.append((" ".join(map(str, way)), len(h) == 1 or len(h) - 1 in way))
        assert [(x["path"], x["below_last"]) for x in tokens.first_paths(batch).to_pylist()] == wanted
        if len(heads) > 1:
            assert [(x["path"], x["below_last"]) for x in tokens.first_paths(batch.slice(1)).to_pylist()] == wanted[1:]


def test_phrase_spans_leave_the_stage_as_counts_by_length():
    batch = lines(random.Random(7), "abcd efgh XY, 12", 400)
    found = recognised(seed.annotated(batch), Options(markers=()), ("is_head", "label", "phrase_start", "phrase_end"))
    rows = flow.token_rows(["is_head", "label", "phrase_start", "phrase_end"])(found).to_pylist()
    wanted: dict[tuple, int] = {}
    for x in rows:
        if x["is_head"]:
            key = x["label"], x["phrase_end"] - x["phrase_start"]
            wanted[key] = wanted.get(key, 0) + 1
    part = found
    for step in phrases.span_counts:
        part = step(part)
    assert {(x["label"], x["n_words"]): x["n"] for x in part.to_pylist()} == wanted and part.num_rows == len(wanted)
