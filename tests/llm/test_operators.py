"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from kozue.llm import bpe, chat, embeddup, exactdedup, langid, minhash, mixing, quality, suffix, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, `__key` string, `__copies` string, `a.b` string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 160)) for _ in range(40)]
    passage = words(rng, 60)
    texts = base + [base[0], base[0], base[1]] + [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(3)]
    texts += [base[2].replace(base[2].split()[3], "changed"), "", "", None, None, " \n\t", "one", "two words", words(rng, 9000), "x" * 50_000, "y y " * 3000]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "clash", "k", "c", "d") for i, t in enumerate(texts)]
    out += [(None, base[4], None, "s0", 1, None, None, None, None), (None, "", None, None, None, None, None, None, None)]
    return out + [out[5], out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def first(id_):
    return (id_ is None, id_ or 0)


# 1


def word_count(text):
    return len(re.findall(mixing.WORD, text or ""))


def token_count(text):
    return len(bpe.encoder(bpe.DEFAULT_RANKS).encode(text or "")) // 4


def brute_mix(rows, weights, budget, size=word_count):
    queue = collections.defaultdict(list)
    for r in rows:
        n = size(r[1])
        queue[r[3]].append((hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] if r[0] is not None else -1, n))
    timed = []
    for source, items in queue.items():
        total = 0
        for key, i, n in sorted(items):
            total += n
            timed.append((total / weights.get(source, 1.0), source or "", key, i, n))
    out, total = [], 0
    for t, source, _, i, n in sorted(timed):
        total += n
        if total <= budget:
            out.append((i, source, n, t, total))
    return out


@pytest.mark.parametrize("budget", [0, 10, 700, 5000, 10**9])
def test_mix(docs, rows, budget):
    unique = [r for r in rows if r[0] is not None]
    weights = {"s0": 3.0, "s1": 0.5}
    got = mixing.mix(docs.filter("doc_id is not null"), weights, budget=budget).collect()
    assert [(r.doc_id, r.source or "", r.tokens, r.finish_time, r.served) for r in got] == brute_mix(unique, weights, budget)
    got = mixing.mix(docs.filter("doc_id is not null"), weights, budget=budget, counter=tokencount.counted).collect()
    assert [(r.doc_id, r.source or "", r.tokens, r.finish_time, r.served) for r in got] == brute_mix(unique, weights, budget, token_count)
    whole = mixing.mix_documents(docs, weights, budget=budget)
    assert whole.columns == docs.columns
    counted = mixing.mix_documents(docs.filter("doc_id is not null"), weights, budget=budget, counter=bpe.counted)
    assert counted.columns == docs.columns and sorted(r.doc_id for r in counted.collect()) == sorted(r.doc_id for r in got)
    for count in (None, "n_chars"):
        mixed = mixing.mix(docs, weights, budget=budget, tokens_col=count).collect()
        kept = mixing.mix_documents(docs, weights, budget=budget, tokens_col=count).collect()
        size = lambda r: len(re.findall(mixing.WORD, r.text or "")) if count is None else r.n_chars or 0  # noqa: E731, B023
        assert sorted((first(r.doc_id), r.source or "", size(r)) for r in kept) == sorted((first(r.doc_id), r.source or "", r.tokens) for r in mixed)
        assert sum(map(size, kept)) <= budget


@pytest.mark.parametrize("limit", [0, 100_000])
def test_mix_repeated_rows_at_the_cut(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    df = spark.createDataFrame([(1, "a b c d e f g h i j", "s", k) for k in range(5)] + [(None, "x", None, 9), (None, "x", None, 8)], "doc_id long, text string, source string, nth int").repartition(3)
    for budget, rows in ((10, 2 * ["x"]), (12, 2 * ["x"] + ["a"]), (35, 2 * ["x"] + 3 * ["a"]), (1, ["x"])):
        mixed, kept = (f(df, {"s": 1.0}, default_weight=1.0, budget=budget).collect() for f in (mixing.mix, mixing.mix_documents))
        assert sorted(r.text[0] for r in kept) == sorted(rows) and len(mixed) == len(rows)


def test_mix_edges(empty, docs):
    assert mixing.mix(empty, {}).count() == mixing.mix_documents(empty, {}).count() == 0
    assert {r.source for r in mixing.mix(docs, {"s0": 0.0, "s1": 1.0}, default_weight=0.0, budget_fraction=1.0).collect()} == {"s1"}


# 2 and 7


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    alphabet = "ab 's t'rel'lvd\n\t  12,.!éß中　' \U0001f600"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 1500))) for _ in range(150)] + ["", "'r", "'l", "'", "  ", "a  ", "'re", "'ll x", "it's'", "'" * 700, " " * 700]


def test_encoding_is_that_of_the_library(awkward):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks()
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Encoder(ranks)
    for text in awkward:
        ids = np.frombuffer(coder.encode(text), np.int32)
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids)[0].tobytes().decode() == text


def test_memo_forgets_and_stays_right():
    memo = bpe.Memo(len, 3)
    for k in range(50):
        assert memo["x" * (k % 7)] == k % 7
        memo.age()
    assert len(memo) <= 4


def test_piece_starts_at_any_chunk_length(awkward):
    split = regex.compile(bpe.PATTERN).findall
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in awkward])))
    expected = np.zeros(offsets[-1], bool)
    for text, at in zip(awkward, offsets, strict=False):
        for piece in split(text):
            expected[at] = True
            at += len(piece)
    points = np.frombuffer("".join(awkward).encode("utf-32-le"), np.uint32)
    for chunk in (1, 2, 3, 17, 256, 4000):
        assert np.array_equal(tokencount.piece_starts(points, offsets, chunk), expected)


def test_automaton_counts_after_resets():
    ranks = bpe.load_ranks()
    coder, automaton = bpe.Encoder(ranks), tokencount.CountingAutomaton(ranks, 300)
    rng = random.Random(1)
    for _ in range(1500):
        piece = "".join(rng.choice("thearionsdé") for _ in range(rng.randint(1, 20))).encode()
        assert automaton.count(piece) == len(coder.merge(piece))


def test_encode_and_count(docs, empty):
    got = bpe.encode_decode(docs)
    assert got.columns == ["doc_id", "tokens", "n_tokens", "decoded"]
    want = sorted((first(r.doc_id), r.text is not None, r.text or "") for r in docs.collect())
    assert sorted((first(r.doc_id), r.decoded is not None, r.decoded or "") for r in got.collect()) == want
    assert all((r.tokens is None) == (r.decoded is None) and (r.tokens is None or len(r.tokens) == r.n_tokens) for r in got.collect())
    counts = tokencount.token_counts(docs)
    key = lambda r: (first(r.doc_id), r.n_tokens is None, r.n_tokens or 0)
    assert sorted(map(key, counts.collect())) == sorted(map(key, got.collect()))
    assert bpe.encode_decode(empty).count() == tokencount.token_counts(empty).count() == 0


def test_vocabulary_must_exist(docs):
    with pytest.raises(FileNotFoundError):
        bpe.encoder("/nowhere.tiktoken")


# 3


def test_quality_separates_held_out_rows(spark):
    rng = random.Random(2)
    made = []
    for i in range(700):
        text, q, t = words(rng, rng.randint(20, 80)), 1, 0
        if i % 5 == 0:
            text, q = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif i % 5 == 1:
            text, q = " ".join(w for w in text.split()[:6] for _ in range(9)), 0
        elif i % 5 == 2:
            at = text.split()
            for k in range(4):
                at.insert(rng.randint(0, len(at)), rng.choice(["zzvile", "zzhateful", "zzrotten"]))
            text, t = " ".join(at), 1
        made.append((i, text, q, t))
    df = spark.createDataFrame(made, "doc_id long, text string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text", F.lit("x").alias("keep")), df.select("doc_id", "quality", "toxic")
    model = quality.train(docs, labels.filter("doc_id % 7 < 4"))
    out = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    held = [m for m in made if m[0] % 7 >= 4]
    wrong = [m for m in held if out[m[0]].keep != (m[2] == 1 and m[3] == 0)]
    assert len(wrong) <= 0.02 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.keep}


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (None, 1, 1), (2, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    none = quality.train(docs, labels.limit(0))
    out = quality.classify(docs, none).collect()
    assert len(out) == docs.count() and {r.keep for r in out if r.quality > 0} == {True}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.keep == bool((texts[r.doc_id] or "").split()) for r in out if r.doc_id is not None)
    some = quality.train(docs, labels)
    assert quality.classify(docs, some).count() == docs.count()
    assert quality.classify(empty, quality.train(empty, labels)).count() == 0
    one = quality.train(docs, labels.filter("doc_id = 3"))
    assert all(r.quality > 0.99 or r.quality == 0 for r in quality.classify(docs, one).collect())


def plain_features(text, hits):
    """The measures of a text by plain Python; hits: whether a unit (a 5-gram of letters, or a word) is in the lexicon."""
    data = text.encode()
    low = bytes(b + 32 if 65 <= b < 91 else b for b in data)
    letter = [chr(b).isalpha() if b < 128 else True for b in data]
    symbol = [b < 128 and not letter[k] and chr(b) not in "0123456789 \t\n\r\f\v.,;:'\"()-?" for k, b in enumerate(data)]
    w = re.findall(rb"[^ \t\n\r\f\v]+", data)
    upper, digits = sum(65 <= b < 91 for b in data), sum(48 <= b < 58 for b in data)
    counts = collections.Counter(w)
    n, total = max(1, len(data)), max(1, len(w))
    found = [u for u in [low[k : k + 5] for k in range(len(data) - 4) if all(letter[k : k + 5])] + re.findall(rb"[a-z\x80-\xff]+", low) if u in hits]
    log1p = lambda x: float(np.log1p(x))
    return [
        log1p(len(data)), upper / max(1, sum(letter)), sum(symbol) / n, digits / n, len(data) / total, len(counts) / total,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / total, max(counts.values(), default=0) / total,
        sum(a and b for a, b in zip(symbol, symbol[1:], strict=False)) / n, data.count(10) / total, log1p(len(found)), len(found) / total, log1p(len(set(found))),
    ]


def test_features_and_scores_are_the_plain_ones(spark):
    import pyarrow as pa

    rng = random.Random(3)
    letters = "abcdeABé#@!.,'1 \n\t "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(80)] + ["", None, " \n", "a", "aaaaa", "éé", "x" * 4000, "hate hateful " * 50]
    whole = [t or "" for t in texts]
    # 5-grams and words of a few texts make the lexicon; their buckets are those that the kernel gives them.
    units = {}
    for t in whole[:20] + whole[-3:]:
        low = t.encode().lower()
        for u in re.findall(rb"[a-z\x80-\xff]{5}", low) + re.findall(rb"[a-z\x80-\xff]+", low):
            data = np.frombuffer(u, np.uint8)
            found, _ = quality.lexicon_units(data, np.array([0, len(u)]))
            units[u] = set(found.tolist()) if len(u) in (1, 2, 3, 4) else None
    word_bucket = {u: next(iter(b)) for u, b in units.items() if b}
    flags = np.zeros(1 << quality.BUCKET_BITS, bool)
    flags[list(word_bucket.values())] = True
    every, _ = quality.lexicon_units(np.frombuffer("".join(f"{t} " for t in whole).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) + 1 for t in whole]))
    got = quality.features(pa.array(texts, pa.string()), flags)
    want = np.array([plain_features(t, set(word_bucket)) for t in whole])
    clash = len({int(b) for b in every}) and any(flags[b] for b in {int(x) for x in every} - set(word_bucket.values()))
    assert not clash and np.allclose(got, want)
    # A score is the logistic function of the sum of the table entries of its bins.
    y = (want[:, 4] > np.median(want[:, 4])).astype(float)
    model = quality.fit(want, y)
    for x, score in zip(want, model.score(want), strict=True):
        bins = [sum(e <= v for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        z = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        z += sum(t[bins[i] * quality.GRID // quality.BINS, bins[j] * quality.GRID // quality.BINS] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in quality.classify(df, quality.Classifier(np.array(sorted(word_bucket.values())), model, None)).collect()}
    for i, (t, score) in enumerate(zip(whole, model.score(want), strict=True)):
        assert abs(out[i].quality - (score if t.split() else 0.0)) < 1e-9 and out[i].keep == bool(t.split() and score >= 0.5)


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "_fit_sample", lambda sample, size: seen.append(sample.collect()))
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(900)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 3, "doc_id long, quality int, toxic int"), sample_rows=25)
    assert len(seen[0]) == 25 and {len({r.text for r in seen[0]})} == {25}


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) & (x[:, 2] > 0.2)).astype(float)  # an interaction, which no sum of features has
    model = quality.fit(x, y)
    assert (model.pairs[0]) == (1, 0)
    assert (((model.score(x) > 0.5) == y).mean()) > 0.95


# 4


@pytest.mark.parametrize(("cell", "block"), [(2000, 4096), (20, 7)])
def test_embedding_pairs(spark, cell, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    v = np.concatenate((base, base[:20] + 0.05 * rng.normal(size=(20, 16)), np.repeat(base[:1] * 3, 30, 0), base[:5]))
    made = [(i, x.tolist(), "e", 1) for i, x in enumerate(v)]
    odd = [(900, None, "", 0), (901, [], "", 0), (902, [0.0] * 16, "", 0), (903, [1.0, 0.0], "", 0), (904, [2.0, 0.0], "", 0), (None, v[0].tolist(), "", 0), (905, [float("nan")] * 16, "", 0), (906, [None] * 16, "", 0), made[3], made[3]]
    df = spark.createDataFrame(made + odd, "vec_id long, embedding array<double>, v string, home int").repartition(3)
    got = embeddup.near_pairs(df, cell=cell, block=block).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cosine = unit @ unit.T
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if cosine[i, j] >= embeddup.COSINE} | {(903, 904)}
    assert {(r.vec_a, r.vec_b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.cosine - cosine[r.vec_a, r.vec_b]) < 1e-9 for r in got if r.vec_a < 900)
    assert embeddup.near_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(("cell", "block"), [(2000, 4096), (20, 7)])
def test_embedding_classes(spark, tmp_path, cell, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(50, 16))
    chain = base[0] / np.linalg.norm(base[0]) + np.arange(12)[:, None] * 0.12 * base[1] / np.linalg.norm(base[1])  # ends are not near
    v = np.concatenate((base, chain, base[:20] + 0.05 * rng.normal(size=(20, 16)), np.repeat(base[2:3] * 3, 40, 0), base[:5]))
    made = [(i, x.tolist(), 7) for i, x in enumerate(v)] + [(3, v[3].tolist(), 0), (3, v[3].tolist(), 0)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0, 0.0], 0), (904, [2.0, 0.0], 0), (905, [float("nan")] * 16, 0), (906, [None] * 16, 0)]
    df = spark.createDataFrame(made + odd + [(None, v[7].tolist(), 0)], "vec_id long, embedding array<double>, class_id int").repartition(3)
    got = sorted((first(r.vec_id), r.class_id, r.n_links) for r in embeddup.near_classes(df, cell=cell, block=block).collect())
    every = made + [(None, v[7].tolist(), 0)]
    unit = np.array([m[1] for m in every])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= embeddup.COSINE - 1e-12
    label = list(range(len(every)))
    for _ in label:
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(label))]
    low = {g: min(every[i][0] for i in range(len(every)) if label[i] == g and every[i][0] is not None) for g in set(label)}
    want = [(first(m[0]), low[label[i]], int(near[i].sum()) - 1) for i, m in enumerate(every)]
    want += [(first(o[0]), 903 if o[0] == 904 else o[0], int(o[0] in (903, 904))) for o in odd]
    assert got == sorted(want)
    assert embeddup.near_classes(df.limit(0)).count() == 0


def test_embedding_query_is_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from kozue.llm import queries

    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 64))
    v = np.concatenate((base, base[:10] + 0.02 * rng.normal(size=(10, 64)), base[:4] + 0.1 * rng.normal(size=(4, 64)), base[:3]))
    df = spark.createDataFrame([(100 - i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op4_embedding_near_dedup"](spark, str(tmp_path)).select("vec_id", "class_id", "n_links").collect()))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(duckdb.sql(f"SELECT vec_id, class_id, n_links FROM ({queries.ORACLES['op4_embedding_near_dedup']})").fetchall())
    assert got == want and sum(n > 0 for _, _, n in want) >= 20


# 5


def test_chat_events(spark):
    events = [
        (1, 0, "message", "system", "be <|im_end|> kind", None),
        (1, 1, "message", "user", "hi", None),
        (1, 2, "delta", "assistant", "he", None),
        (1, 3, "delta", "assistant", "llo", None),
        (1, 3, "delta", "assistant", "llo", None),
        (1, 4, "edit", "user", "hello", 1),
        (1, 5, "regenerate", "assistant", "", None),
        (1, 6, "delta", "assistant", "good ", None),
        (1, 7, "delta", "assistant", "day", None),
        (1, 8, "unheard", "user", "x", None),
        (2, None, None, None, None, None),
        (2, 2, "edit", "user", "y", 77),
        (None, 0, "message", "user", "lost", None),
        (3, 0, "edit", "user", "nothing to edit", None),
        (4, 0, "message", "user", "a", None),
        (4, 1, "message", "assistant", "b", None),
        (4, 2, "message", "user", "c", None),
        (4, 3, "edit", "user", "C", None),
        (4, 4, "regenerate", "assistant", "B", 1),
    ]
    df = spark.createDataFrame(events, "conv_id long, turn long, kind string, role string, text string, target long").withColumn("seq", F.lit("x")).repartition(5)
    got = {r.conv_id: (r.n_messages, r.rendered) for r in chat.format_chats(df, kind_col="kind", target_col="target").collect()}

    def say(*turns):
        return len(turns), "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns)

    assert got == {
        1: say(("system", "be < |im_end|> kind"), ("user", "hello"), ("assistant", "good day")),
        2: say(("unknown", "")),
        3: say(),
        4: say(("user", "a"), ("assistant", "B")),
    }
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_random_logs(spark):
    """Random logs against a fold that makes the list of messages anew at each event."""
    rng = random.Random(14)
    kinds = ["message", "message", "delta", "delta", "edit", "regenerate", "other", None]
    made = []
    for conv in range(60):
        for seq in range(rng.randint(0, 25)):
            for _ in range(2 if rng.random() < 0.1 else 1):
                made.append((conv, seq if rng.random() < 0.97 else None, rng.choice(kinds), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b <|x", None]), rng.choice([None, None, rng.randint(0, 25)])))
    made += made[::9]

    def brute(events):
        key = lambda e: tuple((v is not None, v if v is not None else 0) for v in (e[0],)) + (e[1], e[2], e[3]) + ((e[4] is not None, e[4] or 0),)
        shown, last = [], None
        for e in sorted(events, key=key):
            if e == last:
                continue
            last = e
            seq, kind, role, text, target = e
            where = {"edit": [k for k, m in enumerate(shown) if target is None or m[0] == target][-1:], "regenerate": [k for k, m in enumerate(shown) if (m[1] == role if target is None else m[0] == target)][-1:]}.get(kind)
            if kind == "message":
                shown = [*shown, (seq, role, text)]
            elif kind == "delta":
                shown = [*shown[:-1], (*shown[-1][:2], shown[-1][2] + text)] if shown and shown[-1][1] == role else [*shown, (seq, role, text)]
            elif kind == "edit":
                shown = [(*m[:2], text) if k in where else m for k, m in enumerate(shown)]
            elif kind == "regenerate":
                shown = [*(shown[: where[0]] if where else shown), (seq, role, text)]
        clean = lambda x: x.replace("<|", "< |")
        return len(shown), "".join(f"<|im_start|>{clean(r)}\n{clean(t)}<|im_end|>\n" for _, r, t in shown)

    logs = collections.defaultdict(list)
    for c, seq, kind, role, text, target in made:
        logs[c].append((seq, kind or "message", role or "unknown", text or "", target))
    df = spark.createDataFrame(made, "conv_id long, turn long, kind string, role string, text string, target long").repartition(5)
    got = {r.conv_id: (r.n_messages, r.rendered) for r in chat.format_chats(df, kind_col="kind", target_col="target").collect()}
    assert got == {c: brute(e) for c, e in logs.items()} and len(got) > 50


def test_chat_long(spark):
    df = spark.range(20_000).selectExpr("id % 2 as conv_id", "id as turn", "'user' as role", "repeat('é', 600) as text")
    assert [(r.n_messages, len(r.rendered)) for r in chat.format_chats(df).collect()] == [(10_000, 10_000 * (600 + len("<|im_start|>user\n<|im_end|>\n")))] * 2


# 6


def test_exact(docs, rows, empty):
    got = exactdedup.exact_dedup(docs, copies_col="n").collect()
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[r[1] if r[1] is not None else ("null", k)].append(r[0])
    assert sorted((first(r.doc_id), r.n) for r in got) == sorted((min(map(first, g)), len(g)) for g in groups.values())
    plain = exactdedup.exact_dedup(docs)
    assert plain.columns == docs.columns and plain.count() == len(groups)
    assert exactdedup.exact_dedup(empty).count() == 0


def test_radix_groups():
    rng = random.Random(0)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 3000]))) for _ in range(12)]
        texts += [t[:-1] + "c" for t in texts if t] + texts[:4]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        groups = exactdedup.equal_groups(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        assert all((groups[i] == groups[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(i))


def test_exact_copies_over_many_batches(spark):
    df = spark.range(60_000).selectExpr("59999 - id as doc_id", "concat(repeat('long start ', 40), id % 3) as text").repartition(4)
    got = exactdedup.exact_dedup(df, copies_col="n").orderBy("doc_id").collect()
    assert [(r.doc_id, r.n) for r in got] == [(0, 20_000), (1, 20_000), (2, 20_000)]


def test_exact_hot_prefix(spark):
    """Most texts agree in length and their first 3,000 bytes; some are copies of one, which need no splitting."""
    rng = random.Random(6)
    start = words(rng, 700)[:3000]
    texts = [f"{start}{rng.randrange(400):04d}{'z' * 50}" for _ in range(1500)] + [f"{start}0001{'z' * 50}"] * 300 + ["y" * 900] * 500 + [f"{k}" for k in range(50)] + [None] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t if t is not None else i].append(i)
    want = sorted((g[0], len(g)) for g in groups.values())
    for crowd in (1 << 30, 100_000, 5000):
        got = exactdedup.exact_dedup(df, copies_col="n", crowd_bytes=crowd)
        assert sorted((r.doc_id, r.n) for r in got.collect()) == want
    bytes_ = df.filter("text is not null").select(F.octet_length("text").cast("bigint").alias("size"), F.col("text").cast("binary").alias("bytes"), F.xxhash64("text").alias("hash"))
    levels = exactdedup.crowded_prefixes(bytes_, 100_000)
    assert len(levels) == 6 and all(level.count() == 1 for level in levels)  # 64 to 2,048 bytes; 4,096 are more than there are
    with pytest.raises(ValueError):
        exactdedup.exact_dedup(df, copies_col="Text")


# 8


def test_language_id(spark):
    rng = random.Random(4)
    kinds = {"aa": ["th", "ing", "er", "and"], "bb": ["éa", "oui", "que", "ль"], "cc": ["sch", "ung", "ze", "ich"]}
    made = [(i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(rng.randint(2, 60))), lang) for i, lang in enumerate(sorted(kinds) * 60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(df.filter("doc_id % 2 = 0"))
    got = langid.identify(df.filter("doc_id % 2 = 1"), *model).collect()
    lang = {m[0]: m[2] for m in made}
    assert model[0] == ["aa", "bb", "cc"] and len(got) == 90
    assert sum(r.language == lang[r.doc_id] for r in got) >= 88
    # Counting trigrams with a dictionary gives the same cosines, for every document.
    found = {r.doc_id: r for r in langid.identify(df, *model).collect()}
    for i, text, _ in made:
        padded = f" {re.sub('[^a-zа-яé]+', ' ', text.lower()).strip()} "
        counts = collections.Counter(g for g in zip(padded, padded[1:], padded[2:], strict=False) if g[1] != " ")
        codes = np.array([ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in counts], np.int64)
        vector = np.array(list(counts.values())) @ langid.trigram_vectors(codes, langid.DIMENSIONS).astype(float)
        cosine = vector @ model[1].T / np.linalg.norm(vector)
        assert abs(found[i].score - cosine.max()) < 1e-4 and abs(found[i].lead - np.diff(np.sort(cosine))[-1]) < 1e-4 and found[i].language == model[0][int(cosine.argmax())]


def test_rare_language_has_a_prototype(spark):
    made = [(i, "the thing there" if i != 77 else "ой где ты", "aa" if i != 77 else "bb") for i in range(400)] + [(5, "the thing there", "aa")] * 9
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    langs, prototypes = langid.train(df, sample_rows=3)
    assert langs == ["aa", "bb"] and len(prototypes) == 2
    assert langid.identify(df.filter("doc_id = 77"), langs, prototypes).first().language == "bb"


def test_language_edges(docs, empty):
    model = langid.train(docs)
    got = langid.identify(docs, *model).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id]
            assert r.language == (None if text is None else "en" if text.strip() else "und")
    assert langid.identify(empty, *model).count() == 0
    assert {r.language for r in langid.identify(docs, *langid.train(empty)).collect()} == {None, "und"}


# 9


@pytest.mark.parametrize(("threshold", "start", "limits"), [(50, None, {}), (50, None, {"hot": 4, "one_in": 1}), (50, 25, {}), (50, 3, {}), (7, 2, {"hot": 8, "one_in": 2}), (2, None, {})])
def test_repeated_passages(docs, rows, threshold, start, limits, monkeypatch):
    if limits:  # crowded pairs are counted apart, and texts are joined where documents are too many to be sent
        monkeypatch.setattr(suffix, "BROADCAST_DOCS", 0)
    texts = [(r[0], (r[1] or "").split()) for r in rows]
    seen = collections.Counter(tuple(w[i : i + threshold]) for _, w in texts for i in range(len(w) - threshold + 1))
    want = []
    for ident, w in texts:
        covered = [False] * (len(w) + 1)
        for i in range(len(w) - threshold + 1):
            if seen[tuple(w[i : i + threshold])] > 1:
                covered[i : i + threshold] = [True] * threshold
        for flag, run in itertools.groupby(range(len(covered)), covered.__getitem__):
            run = list(run)
            if flag:
                want.append((first(ident), run[0], len(run)))
    got = suffix.repeated_passages(docs, threshold=threshold, first=start, **limits).collect()
    assert sorted((first(r.doc_id), r.first_word, r.n_words) for r in got) == sorted(want)


def test_hot_passage(spark):
    """A passage that most documents share, and one that all hold many times."""
    rng = random.Random(12)
    hot, line = words(rng, 55), words(rng, 25)
    made = [(i, f"{words(rng, 20)} a{i} {hot} z{i} {words(rng, 10 + i % 5)}") for i in range(400)] + [(1000 + i, words(rng, 80)) for i in range(100)] + [(5000, " ".join([line] * 300))]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    want = sorted([(i, 21, 55) for i in range(400)] + [(5000, 0, 7500)])
    for limits in ({}, {"hot": 100, "one_in": 4}):
        assert sorted(map(tuple, suffix.repeated_passages(df, **limits).collect())) == want


def test_repeated_edges(empty):
    assert suffix.repeated_passages(empty).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated_passages(empty, threshold=1)


# 10


def shingles(text):
    w = text.split()
    return set(zip(w, w[1:], w[2:], strict=False)) or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(9)
    made = []
    for _ in range(80):
        w = words(rng, rng.randint(30, 200)).split()
        made.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.randint(0, len(w) // 8)):
                v[rng.randrange(len(v))] = words(rng, 1)
            made.append(" ".join(v))
    made += ["", "", "a", "a", "a b", "a b", None, " "]
    out = [(i, t, "x") for i, t in enumerate(made)]
    return out + [(None, made[0], "x"), out[1]]


@pytest.mark.parametrize("weight", [None, 3000])
def test_minhash_pairs_and_classes(spark, near, tmp_path, monkeypatch, weight):
    from kozue.llm.queries import QUERIES

    if weight:  # families in many blocks
        monkeypatch.setattr(minhash, "BLOCK_WEIGHT", weight)
        monkeypatch.setattr(minhash, "TEXT_WEIGHT", 1000)
    spark.createDataFrame(near, "doc_id long, text string, jaccard string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for i, t, _ in near:
        if t is not None and i is not None:
            ids.setdefault(t, i)
    sets = {i: shingles(t) for t, i in ids.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= minhash.THRESHOLD * len(sets[a] | sets[b])}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = minhash.near_pairs(docs).collect()
    assert len(got) == len({(r.doc_a, r.doc_b) for r in got})
    firsts = {(r.doc_a, r.doc_b) for r in got if r.doc_b in sets}
    assert firsts <= want and len(firsts) >= 0.95 * len(want)
    assert all(abs(r.jaccard - len(sets[r.doc_a] & sets[r.doc_b]) / len(sets[r.doc_a] | sets[r.doc_b])) < 1e-12 for r in got if r.doc_b in sets)
    copies = {(ids[t], i) for i, t, _ in near if t is not None and i is not None and ids[t] != i}
    assert {(r.doc_a, r.doc_b) for r in got} - firsts == copies and all(r.jaccard == 1 for r in got if r.doc_b not in sets)
    # The registered query has a row for each row: the class, the links of its text, its copies.
    text = {i: t for i, t, _ in near}
    degree = collections.Counter(i for pair in firsts for i in pair)
    label = {i: i for i in text if i is not None}
    while True:
        then = dict(label)
        for a, b in firsts | copies:
            then[a] = then[b] = min(then[a], then[b])
        if then == label:
            break
        label = then
    size = collections.Counter(t for _, t, _ in near if t is not None)
    want = []
    for i, t, _ in near:
        named = i if i is not None else ids[t]
        want.append((first(i), label[named], 0, 1) if t is None else (first(i), label[ids[t]], degree[ids[t]], size[t]))
    rows = [(first(r.doc_id), r.class_id, r.n_links, r.n_copies) for r in QUERIES["op10_minhash"](spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted(want)


def test_minhash_recall_and_precision(spark, near):
    df = spark.createDataFrame(near, "doc_id long, text string, jaccard string").repartition(3)
    ids = {}
    for i, t, _ in near:
        if t is not None and i is not None:
            ids.setdefault(t, i)
    sets = {i: shingles(t) for t, i in ids.items()}
    alike = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= minhash.THRESHOLD * len(sets[a] | sets[b])}
    keyed = df.filter("text is not null").select(minhash.content_key(F.col("text")).alias("key"), "text")
    edges, _ = minhash.near_texts(keyed)
    key_ids = {hashlib.md5(t.encode()).digest(): i for t, i in ids.items()}
    for r in edges.collect():
        a, b = sorted((key_ids[bytes(r.a)], key_ids[bytes(r.b)]))
        assert (a, b) in alike and abs(r.jaccard - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-12
    got = [(r.doc_a, r.doc_b) for r in minhash.near_duplicates(df).collect()]
    leader = {i: i for i, t, _ in near if i is not None and t is not None}

    def root(x):
        while leader[x] != x:
            x = leader[x]
        return x

    def union(a, b):
        a, b = sorted((root(a), root(b)))
        leader[b] = a

    for i, t, _ in near:
        if t is not None and i is not None:
            union(ids[t], i)
    for a, b in alike:
        union(a, b)
    want = {(root(x), x) for x in leader if root(x) != x}
    assert set(got) <= want and len(got) >= 0.97 * len(want) and len(got) == len(set(got))
    leader = {i: i for i in leader}
    for a, b in got:
        union(a, b)
    kept = minhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(first(r.doc_id) for r in kept.collect()) == sorted([(False, i) for i in sets if root(i) == i] + [first(i) for i, t, _ in near if t is None])


def test_minhash_edges(empty, docs):
    assert minhash.near_duplicates(empty).count() == minhash.near_dedup(empty).count() == minhash.near_classes(empty).count() == 0
    assert minhash.near_dedup(docs).columns == docs.columns


def test_minhash_hot_family(spark, monkeypatch):
    """Most rows are near copies and copies of one text, and share every band; beyond the broadcasts' limit too."""
    rng = random.Random(1)
    base = words(rng, 120).split()
    made = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        made.append((i, " ".join(w)))
    made += [(300 + i, " ".join(base)) for i in range(300)] + [(600 + i, words(rng, 60)) for i in range(50)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    want = sorted([(i, 0, 300, 1) for i in range(300)] + [(300 + i, 0, 300, 300) for i in range(300)] + [(600 + i, 600 + i, 0, 1) for i in range(50)])
    for limit in (10**6, 0):
        monkeypatch.setattr("kozue.llm.common.BROADCAST_KEYS", limit)
        assert sorted(map(tuple, minhash.near_classes(df).collect())) == want
        assert minhash.near_dedup(df).count() == 51


def test_least_agreements_is_the_posterior():
    rng = np.random.default_rng(0)
    s = rng.random(400_000)
    for n in (16, 64, 160):
        m = rng.binomial(n, s)
        least = minhash.least_agreements(n, 0.45, 0.005)
        assert (s[m == least] >= 0.45).mean() >= 0.003
        assert least == 0 or (s[m == least - 1] >= 0.45).mean() <= 0.012


def test_components(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    leader = {x: x for e in edges for x in e}

    def root(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        leader[y] = x
    assert got == {x: root(x) for x in leader if root(x) != x}
