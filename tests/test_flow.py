"""Kernels that run one after another in a single stage, against plain Python and against expressions of Spark."""

import io
import os
import random
from contextlib import redirect_stdout

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kozue import queries
from kozue.operators import formats, treebank
from kozue.operators.recognize import Options, recognize, token_slices
from kozue.plans import flow, seed
from kozue.schema import ARROW_TOKEN
from kozue.sources import conllu

SF = "/root/testdata/sf0.001"
ONE_STAGE = """composite_score conllu_round_trip eval_counts gold_bunsetu_heads head_suffixes retokenised children label_rates split_a root_children
split_b width_augmentation conllu json_sentences token_annotations bunsetu_spans cabocha dep_report sub_phrases field_functions first_path subtrees clause_heads
phrase_spans position_types entity_labels bunsetu_heads""".split()
SUMMED = "composite_score eval_counts label_rates dep_report field_functions phrase_spans entity_labels".split()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ONE_STAGE)
def test_one_stage_and_no_shuffle_of_tokens(spark, name):
    """F1 to F27: before, two or three stages handed all tokens through the JVM, or tokens were shuffled (children)."""
    if not os.path.exists(SF):
        pytest.skip("the tables aren't here")
    steps = plan(queries.QUERIES[name](spark, SF))
    assert steps.count("MapInArrow") == 1
    assert name in SUMMED or "hashpartitioning" not in steps


def lines(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts, pa.string())], ["doc_id", "sent_id", "text"])


def test_slices_are_bounded():
    batch = lines(["ab cd " * k for k in range(1, 60)] + ["x" * 5000, "y"])
    parts = list(flow.slices(batch, most=600))
    assert [t for p in parts for t in p.column(2).to_pylist()] == batch.column(2).to_pylist()
    assert all(p.num_rows == 1 or sum(len(t) + 1 for t in p.column(2).to_pylist()) <= 600 for p in parts) and max(p.num_rows for p in parts) > 1
    tokens = seed.annotated(batch)
    cut = list(token_slices(tokens, 50))
    assert [t for p in cut for t in p.column(2).to_pylist()] == batch.column(2).to_pylist()
    assert all(p.num_rows == 1 or len(p.column(3).flatten()) <= 50 for p in cut)


def test_python_values_are_of_bounded_slices(monkeypatch, spark):
    """a batch of blocks was parsed at once, and all its tokens were Python values."""
    monkeypatch.setattr(conllu, "slices", lambda batch, column, most: (batch.slice(k, 1) for k in range(batch.num_rows)))
    block = "# text = a b\n1\ta\ta\tNOUN\tn\t_\t0\troot\t_\t_\n2\tb\tb\tNOUN\tn\t_\t1\tdep\t_\t_\n"
    got = conllu.parse(spark.createDataFrame([("f", block)] * 3, "src string, value string")).select("src", F.size("tokens")).collect()
    assert [tuple(r) for r in got] == [("f", 2)] * 3
    assert conllu.CHARACTERS <= 1 << 20 and treebank.ROWS_TOKENS <= 1 << 14


def test_seed_tokens_of_lines_with_line_ends():
    texts = ["one\ntwo  three", " \tAb cd", "e", "\n", "x\x00y \n"]
    got = [[(t["orth"], t["ws"], t["idx"]) for t in s] for s in seed.annotated(lines(texts)).column(3).to_pylist()]
    assert got[0] == [("one", "", 0), ("\n", "", 3), ("two", " ", 4), ("three", "", 9)]
    assert got[1] == [("Ab", " ", 2), ("cd", "", 5)] and got[2] == [("e", "", 0)] and got[3] == [("\n", "", 0)]
    assert got[4] == [("x", "", 0), ("\x00", "", 1), ("y", " ", 2), ("\n", "", 4)]


def random_sentence(rnd, n):
    at, out = 0, []
    for i in range(n):
        orth, ws = "abcdefgh"[: rnd.randint(1, 4)], rnd.choice(["", " "])
        root = rnd.randrange(n)
        out.append({"orth": orth, "ws": ws, "lemma": orth, "norm": orth, "pos": "NOUN", "tag": "n", "dep": rnd.choice(["ROOT", "nmod", "x_bunsetu"]), "head": rnd.choice([i, root]), "ent_iob": "O", "ent_type": "", "reading": None, "inflection": None, "idx": at})
        at += len(orth) + len(ws)
    return out, at


def test_merging_and_suffixes_of_a_batch_are_those_of_its_sentences():
    """F5, F6."""
    rnd = random.Random(4)
    rows, spans, places = [], [], []
    for _ in range(400):
        tokens, end = random_sentence(rnd, rnd.randint(1, 6))
        cuts = sorted(rnd.sample(range(end + 1), min(end + 1, rnd.randint(1, 4))))
        rows.append(tokens)
        spans.append([{"begin": a, "end": b} for a, b in zip(cuts, cuts[1:], strict=False)])
        cuts = sorted(rnd.sample(range(len(tokens) + 1), min(len(tokens) + 1, rnd.randint(1, 4))))
        places.append([{"start": a, "end": b} for a, b in zip(cuts, cuts[1:], strict=False)])
    kind = {k: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())])) for k, a, b in (("spans", "begin", "end"), ("places", "start", "end"))}
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(ARROW_TOKEN)), pa.array(spans, kind["spans"]), pa.array(places, kind["places"])], ["tokens", "spans", "places"])
    merged, said = (x.to_pylist() for x in treebank.merged()(batch))
    each = [treebank.merged()(batch.slice(k, 1)) for k in range(400)]  # without others that cross, groups are found at once
    assert [x[0].to_pylist()[0] for x in each if x[1][0].as_py() is None] == [m for m, s in zip(merged, said, strict=True) if s is None]
    assert [x[1][0].as_py() for x in each] == said
    marked = treebank.suffixed("places")(batch)[0].to_pylist()
    bad = 0
    for k, tokens in enumerate(rows):
        try:
            assert treebank.merge_to([(x["begin"], x["end"]) for x in spans[k]], tokens) == merged[k] and said[k] is None
        except ValueError as e:
            bad += 1
            assert str(e) == said[k]
        assert treebank.append_suffix([t["head"] for t in tokens], [t["dep"] for t in tokens], [(x["start"], x["end"]) for x in places[k]]) == [t["dep"] for t in marked[k]]
    assert 20 < bad < 380


def test_formats_of_a_batch_are_the_expressions(spark):
    """F13, F14, F17."""
    texts = ["The Big red dog, 12 cats of Rome; running away", 'a "quoted" \\ back\x01slash | x\x1fy', "Ünïcode ＡＢ 日本語テキスト"]
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id bigint, sent_id int, text string")
    both = recognize(seed.annotate(rows), Options()).drop("units")
    changed = F.transform("tokens", lambda t, i: t.withField("reading", F.when(i % 3 == 0, F.lit("r|\\=")).when(i % 3 == 1, None).otherwise("")).withField("inflection", F.when(i % 2 == 0, None).otherwise("a;b")).withField("tag", F.lit("x,*-y,z")).withField("dep", F.when(i == 2, "").otherwise(t["dep"])))
    table = recognize(both.withColumn("tokens", changed), Options())
    for name, kernel in (("conllu", formats.conllu_lines), ("cabocha", formats.cabocha_lines), ("json", formats.json_lines)):
        want = {r.doc_id: r.out for r in formats.formatted(table, name).collect()}
        got = {r.doc_id: r.out for r in table.mapInArrow(lambda batches, f=kernel: map(f, batches), "doc_id bigint, sent_id int, out string").collect()}
        assert got == want
    want = {r.doc_id: r.out for r in formats.formatted(table, "mecab", normalized=True).collect()}
    assert {r.doc_id: r.out for r in table.mapInArrow(lambda batches: map(formats.mecab_lines, batches), "doc_id bigint, sent_id int, out string").collect()} == want
