"""The registered job over a small folder of tables, against brute force."""

import random

import pytest

import corpus_pipeline
from kozue.llm import quality, queries

from .test_operators import SCHEMA, brute_mix, first, shingles, token_count, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    base = [words(rng, 60) for _ in range(30)]
    texts = base + base[:6] + [b.rsplit(" ", 2)[0] + " at end" for b in base[10:16]]
    made = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), made


def test_pipeline_run(spark, folder):
    at, made = folder
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.classify(docs, quality.train(docs, labels)).collect() if r.keep}
    kept = []
    for row in made:  # the lowest id of equal and near texts stays
        a = shingles(row[1])
        if row[0] in good and all(len(a & b) < 0.45 * len(a | b) for b in (shingles(k[1]) for k in kept)):
            kept.append(row)
    total = brute_mix(kept, corpus_pipeline.WEIGHTS, 10**9, token_count)[-1][-1]
    want = {x[0] for x in brute_mix(kept, corpus_pipeline.WEIGHTS, int(total * corpus_pipeline.BUDGET_FRACTION), token_count)}
    got = corpus_pipeline.run(spark, at).collect()
    text = {m[0]: m[1] for m in made}
    assert len(kept) == 30 and {r.doc_id for r in got} == want and len(got) == len(want) < 30
    assert all(r.decoded == text[r.doc_id] for r in got)


def test_pipeline_on_awkward_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    base = [words(rng, 40) for _ in range(12)]
    texts = [*base, base[0], base[1], "", "", None, None, " \n\t", "one", "x" * 60_000, words(rng, 8000), base[2].rsplit(" ", 2)[0] + " at end"]
    rows = [(i, t, "en", f"src{i % 4}" if i % 5 else None, len(t or ""), "clash", "k", "c", "d") for i, t in enumerate(texts)]
    rows += [(None, base[3], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[4], rows[4]]
    at = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, at)
        assert docs.columns == [c for c in spark.read.parquet(f"{at}/documents.parquet").columns]
        docs.write.parquet(f"{at}/stage{k}")
        docs = spark.read.parquet(f"{at}/stage{k}")
    staged = sorted((first(r.doc_id), r.text) for r in docs.collect())
    kept = []
    seen = sorted((r for r in rows if r[1] and r[1].split()), key=lambda r: first(r[0]))  # texts without a word are rejected
    for row in seen:
        a = shingles(row[1])
        if all(len(a & b) < 0.45 * len(a | b) for b in (shingles(k[1]) for k in kept)):
            kept.append(row)
    total = sum(token_count(r[1]) for r in kept)
    named = [(r[0], r[1], r[2], r[3]) for r in kept]
    want = {x[0] for x in brute_mix(named, corpus_pipeline.WEIGHTS, int(total * corpus_pipeline.BUDGET_FRACTION), token_count)}
    assert all(r[0] is not None for r in kept) and {i[1] for i, _ in staged} == want and len(staged) == len(want)
    monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {})
    got = corpus_pipeline.run(spark, at)
    assert all(r.decoded == dict((k[0], k[1]) for k in kept)[r.doc_id] for r in got.collect())
    (tmp_path / "none").mkdir()
    for t in ("documents", "labels"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{at}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{at}/none").count() == 0


def test_queries_over_documents(spark, folder):
    at, made = folder
    text = {m[0]: m[1] for m in made}
    run = lambda name: queries.QUERIES[name](spark, at).collect()
    total = brute_mix(made, queries.WEIGHTS, 10**9)[-1][-1]
    want = brute_mix(made, queries.WEIGHTS, int(total * queries.BUDGET_FRACTION))
    assert [(r.doc_id, r.source, r.tokens, r.finish_time, r.served) for r in run("op1_mixing")] == want
    groups = {}
    for i, t in text.items():
        groups.setdefault(t, []).append(i)
    assert sorted((r.doc_id, r.n_copies) for r in run("op6_exact_dedup")) == sorted((min(g), len(g)) for g in groups.values())
    coded = run("op7_bpe")
    assert {r.doc_id: r.decoded for r in coded} == text
    assert {r.doc_id: r.n_tokens for r in run("op2_token_counts")} == {r.doc_id: r.n_tokens for r in coded}
    assert {(r.doc_id, r.language) for r in run("op8_language_id")} == {(i, "en") for i in text}
    near = {i: shingles(t) for i, t in text.items() if groups[t][0] == i}
    label = {i: groups[t][0] for i, t in text.items()}
    links = {i: sum(a != i and len(near[i] & near[a]) >= 0.45 * len(near[i] | near[a]) for a in near) for i in near}
    for _ in text:
        for a in near:
            for b in near:
                if len(near[a] & near[b]) >= 0.45 * len(near[a] | near[b]):
                    low = min(label[a], label[b])
                    label = {i: low if x in (label[a], label[b]) else x for i, x in label.items()}
        break
    want = sorted((i, label[i], links[groups[t][0]], len(groups[t])) for i, t in text.items())
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in run("op10_minhash")) == want


def test_short_pieces_merge_as_with_a_queue():
    import random

    from kozue.llm import bpe

    r = random.Random(7)
    letters = [bytes((b,)) for b in range(256)]
    ranks = {b: k for k, b in enumerate(letters)}
    for n in (2, 3, 4, 6):  # longer strings of few letters, so that merges overlap
        for _ in range(60):
            ranks.setdefault(bytes(r.choice(b"ab ") for _ in range(n)), len(ranks))
    coder = bpe.Encoder(ranks)
    for _ in range(2000):
        piece = bytes(r.choice(b"ab c") for _ in range(r.randint(1, 40)))
        assert coder.scanned(piece) == coder.queued(piece)
