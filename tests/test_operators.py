"""Splitting, formats, phrases, evaluation and treebank operators on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kozue.functions import fields
from kozue.operators import evaluate, formats, phrases, split, tokens, treebank
from kozue.operators.recognize import recognize
from kozue.plans import lattice, registry
from kozue.schema import SENTENCE

from .test_recognize import GOLDEN, tok


def sentence(rows):
    return [(1, 0, "".join(r["orth"] + r["ws"] for r in rows), rows)]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [tok(h, d, p, o) for o, h, d, p in GOLDEN]
    extra = {0: ("名詞-固有名詞-地名-一般", "ギンザ", None, "B", "City"), 6: ("動詞-非自立可能", "シ", "サ行変格;連用形-一般", "O", ""), 8: ("補助記号-句点", "a|b", None, "O", "")}
    for i, (tag, reading, inflection, iob, kind) in extra.items():
        rows[i] |= {"tag": tag, "reading": reading, "inflection": inflection, "ent_iob": iob, "ent_type": kind}
    return recognize(spark.createDataFrame(sentence(rows), SENTENCE))


def test_conllu(golden):
    lines = formats.formatted(golden, 0).first().out.split("\n")
    assert lines[0] == "# text = 銀座でランチをご一緒しましょう。" and lines[-2:] == ["", ""]
    assert lines[1].split("\t") == ["1", "銀座", "銀座", "PROPN", "名詞-固有名詞-地名-一般", "_", "6", "nmod", "_", "SpaceAfter=No|BunsetuBILabel=B|BunsetuPositionType=SEM_HEAD|NP_B|Reading=ギンザ|NE=B-GPE|ENE=B-City|ClauseHead=6"]
    assert lines[6].split("\t")[6:] == ["0", "root", "_", "SpaceAfter=No|BunsetuBILabel=I|BunsetuPositionType=ROOT|NP_I|ClauseHead=6"]
    assert lines[7].split("\t")[9] == "SpaceAfter=No|BunsetuBILabel=I|BunsetuPositionType=SYN_HEAD|Inf=サ行変格,連用形-一般|Reading=シ|ClauseHead=6"
    assert lines[9].split("\t")[9].split("|", 3)[3] == "Reading=a\\\\|b|ClauseHead=6"
    assert not formats.formatted(golden, "conllu", origin=False).first().out.startswith("#")
    assert "Reading=を" in formats.formatted(golden, "conllu", use_orth=True).first().out


def test_cabocha_and_mecab(golden):
    lines = formats.formatted(golden, "1").first().out.split("\n")
    assert [x for x in lines if x.startswith("* ")] == ["* 0 2D 0/1 0.000000", "* 1 2D 0/1 0.000000", "* 2 -1D 0/2 0.000000"]
    assert lines[1] == "銀座\t名詞,固有名詞,地名,一般,*,*,銀座,ギンザ,*\tB-City"
    assert lines[-3:] == ["EOS", "", ""] and "し\t動詞,非自立可能,*,*,サ行変格,連用形-一般,し,シ,*\tO" in lines
    assert formats.formatted(golden, "mecab").first().out.startswith("銀座\t名詞,固有名詞,地名,一般,*,*,銀座,ギンザ,*\n")
    with pytest.raises(ValueError):
        formats.formatted(golden, "4")
    with pytest.raises(ValueError):
        formats.formatted(golden.drop("units"), "cabocha")


def test_json(golden):
    doc = json.loads(formats.formatted(golden, 3).first().out)
    first = doc["paragraphs"][0]["sentences"][0]["tokens"][0]
    assert first == {"id": 1, "orth": "銀座", "tag": "名詞-固有名詞-地名-一般", "pos": "PROPN", "lemma": "銀座", "norm": "銀座", "head": 5, "dep": "nmod", "ner": "B-City"}


def test_labels(spark):
    df = spark.createDataFrame([("B", "City"), ("I", "God"), ("O", ""), ("", "City"), (None, None), ("B", "Nothing")], "a string, b string")
    got = df.select(fields.ent_label_ene(F.col("a"), F.col("b")), fields.ent_label_ontonotes(F.col("a"), F.col("b")), fields.ontonotes(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("B-City", "B-GPE", "GPE"), ("I-God", "I-PERSON", "PERSON"), ("O", "O", "OTHERS"), ("O", "O", "GPE"), ("O", "O", "OTHERS"), ("B-Nothing", "B-OTHERS", "OTHERS")]
    assert len(fields.label_rows()) == 277 and len({b for _, b, _ in fields.label_rows()}) == 23 and sum(c is not None for *_, c in fields.label_rows()) == 266
    assert [r[0] for r in df.select(fields.in_hierarchy(F.col("b"), "1.5")).collect()][:2] == [True, False]


def test_scalars(spark):
    row = spark.range(1).select(fields.inflection_form(F.lit("a;b")), fields.inflection_form(F.lit(None).cast("string")), fields.reading_form(F.lit(None).cast("string"), F.lit("x")), fields.swap_width(F.lit("aＢ!　")), fields.to_half_width(F.lit("Ａ！")), fields.text_with_ws(F.lit("a"), F.lit(None).cast("string")), fields.file_stem(F.lit("/a/b.c.xml")), fields.is_stop(F.lit("a"), ["a"]), fields.is_stop(F.lit("a"), [])).first()
    assert list(row) == ["a,b", "", "x", "ａB！　", "A!", "a", "b", True, False]


def test_navigation(golden):
    t = F.col("tokens")
    row = golden.select(tokens.children(t, F.lit(5)), tokens.children(t, F.lit(5), "left"), tokens.children(t, F.lit(5), "right"), tokens.ancestors(t, F.lit(1)), tokens.ancestors(t, F.lit(5)), tokens.in_subtree(F.col("units"), t, F.lit(1), F.lit(0)), tokens.traverse(t, phrases.orth, lambda x: x["pos"] == "NOUN")).first()
    assert list(row) == [[0, 2, 4, 6, 7, 8], [0, 2, 4], [6, 7, 8], [0, 5], [], True, "ランチ+ご+一緒"]


def test_phrases(golden):
    assert [(r.bunsetu, r.phrase, r.label) for r in phrases.bunsetu_table(golden).orderBy("start").collect()] == [("銀座+で", "銀座", "NP"), ("ランチ+を", "ランチ", "NP"), ("ご+一緒+し+ましょう+。", "ご+一緒", "NP")]
    assert sorted((r.dep, r.phrase, r.head_phrase) for r in phrases.sub_phrases(golden).collect()) == [("nmod", "銀座", "ご+一緒"), ("obj", "ランチ", "ご+一緒")]
    assert [tuple(r) for r in phrases.frames(golden.union(golden), ("nmod", "obj"), "NOUN").collect()] == [("銀座", "ランチ", "ご+一緒", 1)]
    assert [(r.clause, len(r.places)) for r in phrases.clauses(golden).collect()] == [(5, 9)]
    assert phrases.available(golden) and not phrases.available(golden.drop("units"))


def test_conjuncts(spark):
    rows = [tok(0, "ROOT", "NOUN"), tok(0, "conj", "NOUN"), tok(1, "conj", "NOUN"), tok(0, "nmod", "NOUN")]
    got = tokens.conjuncts(spark.createDataFrame(sentence(rows), SENTENCE)).orderBy("i").collect()
    assert [(r.i, r.first) for r in got] == [(0, 0), (1, 0), (2, 0)]


# Splitting.


def one_by_one(toks, subs, mode):
    """The same by splitting tokens from the right, one after another, in a list of nodes."""
    nodes = [dict(t, id=i) for i, t in enumerate(toks)]
    for n in nodes:
        n["up"] = nodes[n["head"]]
    for i in range(len(toks) - 1, -1, -1):
        pieces = subs[i] and subs[i][mode.lower()]
        if not pieces:
            continue
        old = nodes[i]
        root = old["up"] is old
        dep = "ROOT" if root else old["dep"]
        tight = dep in ("compound", "nummod", "punct")
        new = [dict(old, orth=p["surface"], dep=split.DEP_BY_TAG.get(p["tag"], "compound")) for p in pieces]
        new[-1]["dep"] = old["dep"]
        for k, n in enumerate(new):
            n["up"] = new[-1] if root or (not tight and k < len(new) - 1) else old["up"]
        at = next(k for k, n in enumerate(nodes) if n is old)
        nodes[at : at + 1] = new
        for n in nodes:
            if n["up"] is old:
                n["up"] = new[0] if tight else new[-1]
    return [(n["orth"], n["dep"], next(k for k, m in enumerate(nodes) if m is n["up"])) for n in nodes]


def test_split_is_that_of_single_splits():
    rng = random.Random(0)
    piece = lambda s: {"surface": s, "tag": rng.choice(["NOUN", "NUM", "ADP"]), "inf": "", "lemma": s, "reading": "a=b|c", "norm": s}
    for _ in range(400):
        n = rng.randint(1, 6)
        root = rng.randrange(n)
        order = [root, *rng.sample([i for i in range(n) if i != root], n - 1)]
        head = list(range(n))
        for k, i in enumerate(order[1:], 1):
            head[i] = order[rng.randrange(k)]
        toks = [tok(h, "ROOT" if h == i else rng.choice(["compound", "nmod", "punct", "nummod"]), "NOUN", f"w{i}") for i, h in enumerate(head)]
        subs = [{"a": [piece(f"{i}{c}") for c in "abc"[: rng.randint(1, 3)]], "b": None} if rng.random() < 0.5 else None for i in range(n)]
        got = split.split_sentence(toks, subs, "A")
        assert [(t["orth"], t["dep"], t["head"]) for t in got] == one_by_one(toks, subs, "A")
        assert all(t["reading"] == "a_b_c" for t in got if t["orth"][0] != "w")


def test_split_batches_are_split_sentences():
    import pyarrow as pa

    from kozue.plans.lattice import _subs_type
    from kozue.schema import ARROW_TOKEN

    rng = random.Random(1)
    piece = lambda s: {"surface": s, "tag": rng.choice(["NOUN", "NUM", "名詞-普通名詞-サ変可能", "動詞-非自立可能"]), "inf": rng.choice(["", "x;y"]), "lemma": s, "reading": rng.choice(["", "a=b|c"]), "norm": s}
    sents, subs = [], []
    for _ in range(300):
        n = rng.randint(0, 6)
        root = rng.randrange(n) if n else 0
        toks = [tok(rng.randrange(n) if i != root else i, rng.choice(["compound", "nmod", "punct", "ROOT"]), "NOUN", f"w{i}é", rng.choice("OBI"), "動詞-非自立可能") | {"ws": " "} for i in range(n)]
        sents.append(toks)
        subs.append(None if rng.random() < 0.1 else [{"a": [piece(f"{i}{c}") for c in "abc"[: rng.randint(1, 3)]], "b": None} if rng.random() < 0.5 else None for i in range(n)])
    for some in (slice(None), [k for k in range(300) if subs[k] is not None]):
        a = sents if isinstance(some, slice) else [sents[k] for k in some]
        b = subs if isinstance(some, slice) else [subs[k] for k in some]
        got = split.split_batch(pa.array(a, pa.list_(ARROW_TOKEN)), pa.array(b, pa.list_(_subs_type())), "A").to_pylist()
        assert got == [split.split_sentence(x, y, "A") for x, y in zip(a, b, strict=True)]


def test_split_modes(spark):
    lines = spark.createDataFrame([(1, 0, "機能性食品を食べた。")], "doc_id long, sent_id int, text string")
    analysed = lattice.annotate(lines)
    words = lambda mode: [t.orth for t in split.split_compounds(analysed, mode).first().tokens]
    assert words("A") == ["機能", "性", "食品", "を", "食べ", "た", "。"]
    assert words("B") == ["機能性", "食品", "を", "食べ", "た", "。"]
    assert words("C") == words(None) == ["機能性食品", "を", "食べ", "た", "。"]
    assert "sub_tokens" not in split.split_compounds(analysed, "C").columns
    with pytest.raises(ValueError):
        split.split_compounds(analysed, "D")
    parts = F.transform(F.arrays_zip("tokens", "sub_tokens"), lambda x: split.sub_tokens(x["tokens"], x["sub_tokens"], "B"))
    assert analysed.select(parts.alias("p")).first().p[:2] == ["機能性+食品", "を"]
    kept = split.split_compounds(analysed.withColumn("tokens", F.transform("tokens", lambda t: t.withField("ent_iob", F.lit("B")))), "A").first().tokens
    assert [t.ent_iob for t in kept[:4]] == ["B", "I", "I", "B"]


def test_lattice_user_dictionary(spark):
    lines = spark.createDataFrame([(1, 0, "東京スカイ 2024!"), (2, 0, ""), (3, 0, None)], "doc_id long, sent_id int, text string")
    plain = {r.doc_id: [t.orth for t in r.tokens] for r in lattice.annotate(lines).collect()}
    assert plain == {1: ["東京", "スカイ", "2024", "!"], 2: [], 3: []}
    user = lattice.annotator(user=[lattice.Entry("東京スカイ", "名詞-固有名詞-一般", 200)])
    first = user(lines.filter("doc_id = 1")).first()
    assert [(t.orth, t.ws, t.idx) for t in first.tokens] == [("東京スカイ", " ", 0), ("2024", "", 6), ("!", "", 10)]


def test_registry_and_settings():
    assert registry.find("no-such", "seed")[0] == "seed"
    with pytest.raises(LookupError):
        registry.find("no-such-annotator")
    s = registry.Settings(split_mode="A", least=3)
    assert registry.Settings.from_json(s.to_json()) == s
    with pytest.raises(ValueError):
        registry.Settings.from_json('{"other": 1}')
    with pytest.raises(ValueError):
        registry.Settings(split_mode="Z")


def test_whole_lines(spark):
    a, b = [tok(1, "nmod", "NOUN", "a"), tok(1, "ROOT", "VERB", "b")], [tok(0, "ROOT", "NOUN", "c")]
    rows = spark.createDataFrame([(1, 0, "ab", a), (1, 0, "c", b)], SENTENCE).coalesce(1)
    got = registry.whole_lines(rows).first()
    assert got.text == "abc" and [t.head for t in got.tokens] == [1, 1, 2]


# Evaluation.


def table(spark, sents):
    rows = [(s, i, *t) for s, ts in sents.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "sent string, i int, orth string, ws string, pos string, tag string, dep string, head int, ent_iob string, ent_type string")


def walk(gold, system):
    """The same counters by walking two token lists with their offsets."""
    def spans(ts):
        out, at = [], 0
        for t in ts:
            out.append((at, at + len(t[0])))
            at += len(t[0]) + len(t[1])
        return out

    c = dict.fromkeys(("tokens", "tag", "pos", "uas", "las", "pos_uas", "pos_las", "root"), 0)
    pos = {}
    g, s = spans(gold), spans(system)
    for k, (t, at) in enumerate(zip(gold, g, strict=True)):
        m = next((j for j, x in enumerate(s) if x == at), None)
        if m is None:
            if not any(x[1] == at[1] for x in s):
                pos[t[2], "_"] = pos.get((t[2], "_"), 0) + 1
            continue
        u = system[m]
        pos[t[2], u[2]] = pos.get((t[2], u[2]), 0) + 1
        groot, sroot = t[4] == "root", u[4] == "root"
        a, b = g[t[5]], s[u[5]]
        uas = groot and sroot or not groot and not sroot and (a[0] >= b[0] and a[1] <= b[1] or a[0] <= b[0] and a[1] >= b[1])
        las = uas and t[4] == u[4]
        for name, good in (("tokens", True), ("tag", t[3] == u[3]), ("pos", t[2] == u[2]), ("uas", uas), ("las", las), ("pos_uas", uas and t[2] == u[2]), ("pos_las", las and t[2] == u[2]), ("root", groot and sroot)):
            c[name] += bool(good)
    return c, pos


def test_counts_over_different_tokens(spark):
    rng = random.Random(6)

    def cut(text):
        parts, at = [], 0
        while at < len(text):
            n = rng.randint(1, 3)
            parts.append(text[at : at + n])
            at += n
        root = rng.randrange(len(parts))
        return [(p, "", rng.choice("NV"), rng.choice("xy"), "root" if i == root else rng.choice(["a", "b"]), i if i == root else rng.randrange(len(parts)), "O", "") for i, p in enumerate(parts)]

    gold = {str(k): cut("abcdefghij") for k in range(40)}
    system = {k: cut("abcdefghij") for k in gold}
    total, matrix = {}, {}
    for k in gold:
        c, pos = walk(gold[k], system[k])
        for m, n in c.items():
            total[m] = total.get(m, 0) + n
        for m, n in pos.items():
            matrix[m] = matrix.get(m, 0) + n
    g, s = table(spark, gold), table(spark, system)
    pairs = evaluate.paired(evaluate.nested(g), evaluate.nested(s))
    counted = {r.measure: r for r in evaluate.rates(evaluate.counts(pairs)).collect()}
    assert {m: counted[m].correct for m in total} == total
    assert counted["tokens"].gold == g.count() and counted["tokens"].system == s.count() and counted["ent_span"].f1 == 0
    assert {(r.gold, r.system): r.n for r in evaluate.confusion(pairs, "pos").collect()} == matrix
    assert evaluate.composite_score(evaluate.counts(pairs)).first().score >= sum(total.values())
    assert evaluate.report(evaluate.rates(evaluate.counts(pairs))).count() == len(evaluate.MEASURES)


def test_entities(spark):
    labels = ["B-X", "I-X", "O", "U-Y", "B-Z", "L-Z", "I-X", "O"]
    ts = [("ab", "", "N", "t", "a", 0, lab.split("-")[0], lab.partition("-")[2]) for lab in labels]
    got = sorted((r.begin, r.end, r.label) for r in evaluate.entities(evaluate.nested(table(spark, {"s": ts}))).collect())
    assert got == [(0, 4, "X"), (6, 8, "Y"), (8, 12, "Z"), (12, 14, "X")]


def test_sentences_of_one_side(spark):
    t = lambda *words: [(w, "", "N", "t", "root", 0, "B", "X") for w in words]
    g, s = (evaluate.nested(table(spark, x)) for x in ({"a": t("ab"), "b": t("c")}, {"a": t("ab"), "z": t("d", "e")}))
    got = {r.measure: (r.correct, r.gold, r.system) for r in evaluate.counts(evaluate.paired(g, s)).collect()}
    assert got["tokens"] == (1, 2, 3) and got["sentence"] == (1, 2, 2) and got["ent_label"] == (1, 2, 3)
    none = evaluate.counts(evaluate.paired(g.limit(0), s.limit(0))).collect()
    assert len(none) == len(evaluate.MEASURES) and all(r.correct == r.gold == r.system == 0 for r in none)


def test_upper_median(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.random() * 100, 5.0, -3.0])) for k in ("a", "b", None) for _ in range(rng.randint(1, 200))] + [("one", 7.0), ("same", 2.0), ("same", 2.0), ("same", None)]
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    got = evaluate.upper_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    assert {r.k: r.median for r in got} == {k: sorted(v)[len(v) // 2] for k, v in want.items()} and len(got) == len(want)


def test_biluo_of_crossing_spans(spark):
    ts = [(w, " ", "N", "t", "a", 0, "O", "") for w in ("ab", "c", "de", "f")]  # 0-2, 3-4, 5-7, 8-9
    df = evaluate.nested(table(spark, {"s": ts})).withColumn("entities", F.from_json(F.lit('[{"begin":6,"end":9,"label":"Z"},{"begin":1,"end":4,"label":"X"},{"begin":3,"end":6,"label":"Y"}]'), "array<struct<begin:int,end:int,label:string>>"))
    assert treebank.biluo(df).first().labels == ["B-X", "L-X", "U-Y", "U-Z"]


# Treebank.


def test_bunsetu_heads_in_gold():
    dep = treebank.mark_bunsetu_heads([2, 0, 4, 2, 4], ["nmod", "case", "obj", "case", "root"], ["B", "I", "B", "I", "B"])
    assert dep == ["nmod_bunsetu", "case", "obj_bunsetu", "case", "root"]
    assert treebank.mark_bunsetu_heads([1, 2, 2], ["compound", "nmod", "root"], ["B", "I", "B"]) == ["compound", "nmod_bunsetu", "root"]
    with pytest.raises(ValueError):
        treebank.mark_bunsetu_heads([0], ["root"], [None])
    assert treebank.append_suffix([1, 2, 2], ["a", "b", "root"], [(0, 2), (2, 3)]) == ["a", "b_bunsetu", "root"]


def test_label_spans():
    at = dict(begin=[0, 1, 2, 3], end=[1, 2, 3, 4])
    assert treebank.decode_labels(["B-X", "I-X", "O", "U-Y"], **at) == [(0, 2, "X"), (3, 4, "Y")]
    assert treebank.decode_labels(["B-X", "B-X", "L-X", None], **at) == [(0, 1, "X"), (1, 3, "X")]
    for bad in (["I-X", "O", "O", "O"], ["B-X", "I-Y", "O", "O"]):
        with pytest.raises(ValueError):
            treebank.decode_labels(bad, **at)
    with pytest.raises(ValueError):
        treebank.decode_labels([None] * 4, **at, must_have=True)


def test_merging():
    toks = [tok(1, "compound", "N", "ab") | {"idx": 0}, tok(2, "nmod", "N", "c") | {"idx": 2}, tok(2, "ROOT", "V", "de") | {"idx": 3}]
    got = treebank.merge_to([(0, 3), (3, 5)], toks)
    assert [(t["orth"], t["head"], t["dep"]) for t in got] == [("abc", 1, "nmod"), ("de", 1, "ROOT")]
    assert [t["orth"] for t in treebank.merge_to([(0, 2), (2, 3), (3, 5)], toks)] == ["ab", "c", "de"]
    assert [t["orth"] for t in treebank.merge_to([(0, 1), (1, 5)], toks)] == ["abcde"]
    with pytest.raises(ValueError):
        treebank.merge_to([(0, 3), (3, 5)], [toks[0] | {"head": 2}, toks[1] | {"head": 0 + 1, "dep": "ROOT"}, toks[2] | {"head": 1}])


def test_paragraph_sizes(spark):
    df = spark.createDataFrame([(d, s) for d, n in ((1, 10), (2, 2), (3, 7)) for s in range(n)], "doc_id long, sent_id int")
    def sizes(n):
        got = {}
        for r in treebank.paragraphs(df, n).collect():
            got.setdefault(r.doc_id, {}).setdefault(r.paragraph, []).append(r.sent_id)
        return {d: [len(p) for _, p in sorted(x.items())] for d, x in got.items()}

    assert sizes(3) == {1: [3, 3, 4], 2: [2], 3: [3, 4]}
    assert sizes(0) == {1: [10], 2: [2], 3: [7]}
    drawn = sizes(-3)
    assert {d: sum(x) for d, x in drawn.items()} == {1: 10, 2: 2, 3: 7} and all(1 <= k <= 4 for x in drawn.values() for k in x)


def test_projectivity_flag(spark):
    good, bad = [tok(0, "ROOT", "N")] * 1, [tok(2, "a", "N"), tok(3, "a", "N"), tok(2, "ROOT", "N"), tok(2, "a", "N")]
    circle = [tok(1, "a", "N"), tok(0, "a", "N")]
    df = spark.createDataFrame([(1, 0, "", good), (2, 0, "", bad), (3, 0, "", circle), (4, 0, "", [])], SENTENCE)
    assert {r.doc_id: r.ok for r in treebank.projective(df).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_invalid_sequences(spark):
    seqs = {"a": ["B-X", "I-X", "L-X", "O", "U-Y"], "b": ["B-X", "O"], "c": ["I-X"], "d": ["B-X", "L-Y"], "e": ["O", "B-X"]}
    df = spark.createDataFrame(list(seqs.items()), "sent string, labels array<string>")
    got = {(r.sent, r.i, r.label) for r in treebank.invalid_labels(df).collect()}
    assert got == {("b", 1, "O"), ("c", 0, "I-X"), ("d", 1, "L-Y"), ("e", 1, "B-X")} | {("c", 0, "I-X")}


def test_tags_align_with_tokens():
    text = "Hello big\nWorld of\n Tags"
    tags = [{"label": "X", "begin": 6, "end": 15}, {"label": "Y", "begin": 20, "end": 24}]
    assert treebank.align_tags(text, tags, [["Hello", "bi", "g", "World"], ["of", "Tags"]]) == [["O", "B-X", "I-X", "L-X"], ["O", "U-Y"]]
    assert treebank.align_tags(text, tags, [["Hello", "big"], ["World", "of", "Tags"]]) == [["O", "U-X"], ["U-X", "O", "U-Y"]]
    with pytest.raises(ValueError):
        treebank.align_tags(text, tags, [["Hullo"]])


def test_misc_rewrite(spark):
    df = spark.createDataFrame([("_",), ("A=1",), ("A=1|NE=B-X",), ("NE=O",)], "m string")
    assert [r[0] for r in df.select(treebank.rewrite_ne(F.col("m"), F.lit("B-Z"))).collect()] == ["NE=B-Z", "A=1|NE=B-Z", "A=1|NE=B-Z", "NE=B-Z"]


def test_augmentation(spark):
    df = spark.createDataFrame([(i, 0, "ab!", [tok(0, "ROOT", "N", "ab!")]) for i in range(300)], SENTENCE)
    same = spark.createDataFrame([(900, 0, "　", [tok(0, "ROOT", "N", "　")])], SENTENCE)
    got = treebank.augment_width(df.union(same), ["doc_id"]).filter("copy = 1").collect()
    kinds = [(r.text == "ａｂ！", r.tokens[0].orth == "ａｂ！", r.tokens[0].lemma == "ａｂ！") for r in got]
    assert len(got) == 300 and {a == b for a, b, _ in kinds} == {True}
    assert all(70 < kinds.count(k) < 130 for k in ((True, True, True), (True, True, False), (False, False, True)))
