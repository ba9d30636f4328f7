"""The recogniser against the documented sentence and against plain definitions on random trees."""

import random

import pyarrow as pa
import pytest

from kozue.operators import recognize as R
from kozue.operators.trees import crossing, depths, edges
from kozue.schema import ARROW_TOKEN


def tok(head, dep, pos, orth="w", iob="O", tag="t"):
    return {"orth": orth, "ws": "", "lemma": orth, "norm": orth, "pos": pos, "tag": tag, "dep": dep, "head": head, "ent_iob": iob, "ent_type": "X" if iob != "O" else "", "reading": None, "inflection": None, "idx": 0}


GOLDEN = [
    ("銀座", 5, "nmod_bunsetu", "PROPN"), ("で", 0, "case", "ADP"), ("ランチ", 5, "obj_bunsetu", "NOUN"), ("を", 2, "case", "ADP"), ("ご", 5, "compound", "NOUN"),
    ("一緒", 5, "ROOT", "NOUN"), ("し", 5, "aux", "AUX"), ("ましょう", 5, "aux", "AUX"), ("。", 5, "punct", "PUNCT"),
]


def run(sentences, **options):
    return R.recognize_batch(pa.array(sentences, pa.list_(ARROW_TOKEN)), R.Options(**options)).to_pylist()


def test_golden_sentence():
    s = [tok(h, d, p, o) for o, h, d, p in GOLDEN]
    for units in run([[], s, [], s])[1::2]:
        assert [u["bi"] for u in units] == list("BIBIBIIII")
        assert [u["position"] for u in units] == ["SEM_HEAD", "SYN_HEAD", "SEM_HEAD", "SYN_HEAD", "CONT", "ROOT", "SYN_HEAD", "SYN_HEAD", "CONT"]
        assert {u["clause"] for u in units} == {5}
        assert [(u["link_bunsetu"], u["link_offset"], u["func_offset"]) for u in units if u["bi"] == "B"] == [(2, 0, 1), (2, 0, 1), (-1, 0, 2)]
        assert [u["label"] for u in units if u["bi"] == "B"] == ["NP"] * 3
        assert [(u["phrase_start"], u["phrase_end"]) for u in units if u["bi"] == "B"] == [(0, 1), (2, 3), (4, 6)]


POS = ["NOUN", "VERB", "ADP", "PUNCT", "AUX", "PROPN"]
DEP = ["nmod", "compound", "nummod", "case", "punct", "nmod_bunsetu", "advcl_bunsetu"]


def random_tree(rng, n, projective):
    while True:
        root = rng.randrange(n)
        head = [rng.randrange(n) if i != root else root for i in range(n)]
        if not projective:
            order = [root, *rng.sample([i for i in range(n) if i != root], n - 1)]
            head = list(range(n))
            for k, i in enumerate(order[1:], 1):
                head[i] = order[rng.randrange(k)]
        up = [ancestors(head, i) for i in range(n)]
        if all(u is not None for u in up) and (not projective or not crosses(head)):
            return head


def ancestors(head, i):
    out = []
    while head[i] != i:
        i = head[i]
        if i in out:
            return None
        out.append(i)
    return out


def crosses(head):
    return any(not (m == h or m == i or h in ancestors(head, m)) for i, h in enumerate(head) for m in range(min(i, h), max(i, h)))


def naive(tokens, markers, least=2):
    n = len(tokens)
    head = [t["head"] for t in tokens]
    up = [ancestors(head, i) for i in range(n)]
    sub = [{j for j in range(n) if j == i or i in up[j]} for i in range(n)]
    heads = {i for i, t in enumerate(tokens) if t["dep"] == "ROOT" or t["dep"].endswith("_bunsetu")}
    for i in range(n):
        if i in heads:
            t = i
            while head[t] < t and head[t] not in heads:
                if tokens[head[t]]["pos"] != "PUNCT":
                    heads.add(head[t])
                t = head[t]
            heads.add(head[t])
    i = 0
    while i < n:
        if tokens[i]["ent_iob"] == "B":
            j = i + 1
            while j < n and tokens[j]["ent_iob"] == "I":
                j += 1
            out = [t for t in range(i, j) if head[t] == t or not i <= head[t] < j]
            if out and len({head[t] for t in out}) == 1:
                heads -= set(range(i, j)) - {out[0]}
            i = j
        else:
            i += 1
    hs = sorted(heads)
    bi = ["B"] + ["I"] * (n - 1)
    for left, right in zip(hs, hs[1:], strict=False):
        l_edge, r_edge = max(sub[left]), min(sub[right])
        if l_edge + 1 == r_edge or l_edge >= right:
            bi[r_edge] = "B"
        else:
            bi[l_edge + 1] = "B"
    number = [bi[: i + 1].count("B") - 1 for i in range(n)]
    position, phrases = [None] * n, {}
    for b in set(number):
        members = [i for i in range(n) if number[i] == b]
        outer = [i for i in members if number[head[i]] != b or head[i] == i]
        root = min(outer, key=lambda i: (len(up[i]), i))
        inside, grown = {root}, True
        while grown:
            more = {i for i in members if head[i] in inside and i != root and tokens[i]["dep"].removesuffix("_bunsetu") in R.PHRASE_RELATIONS} - inside
            inside |= more
            grown = bool(more)
        phrases[b] = (min(inside), max(inside) + 1)
    for h in hs:
        a, b = phrases[number[h]]
        for i in range(a, b):
            position[i] = "ROOT" if head[i] == i else ("NO_HEAD" if tokens[i]["dep"].removesuffix("_bunsetu") == "punct" else "SEM_HEAD") if i == h else "CONT"
    position = [p or ("SYN_HEAD" if t["pos"] in R.FUNCTION_POS else "CONT") for p, t in zip(position, tokens, strict=True)]
    roots = {i for i, t in enumerate(tokens) if t["dep"] == "ROOT"}
    now = set()
    for i, t in enumerate(tokens):
        if t["tag"] in markers and i not in roots:
            if i in heads:
                now.add(i)
            elif any(a in heads for a in up[i]):
                now.add(head[i])
    now = {c for c in now - roots if len(sub[c] & heads) >= least} | roots
    for c in sorted(now):
        if c not in now:
            continue
        own, nested = sub[c] & heads, (sub[c] & now) - {c}
        for d in nested:
            own -= sub[d]
        if len(own) < least:
            now = now - nested if c in roots else now - {c}
    clause = [next((a for a in [i, *up[i]] if a in now), -1) for i in range(n)]
    return heads, bi, position, phrases, clause, up, sub


@pytest.mark.parametrize("projective", [True, False])
def test_random_trees(projective):
    rng = random.Random(projective)
    sentences = []
    for _ in range(1500):
        n = rng.randint(1, 9)
        head = random_tree(rng, n, projective)
        s = []
        for i in range(n):
            dep = "ROOT" if head[i] == i else rng.choice(DEP)
            iob = rng.choice("OOOBI")
            iob = "O" if iob == "I" and (not s or s[-1]["ent_iob"] == "O") else iob
            s.append(tok(head[i], dep, rng.choice(POS), iob=iob, tag=rng.choice(["t", "t", "m"])))
        sentences.append(s)
    for s, units in zip(sentences, run(sentences, markers=({"tag": "m"},)), strict=True):
        heads, bi, position, phrases, clause, up, sub = naive(s, {"m"})
        assert {i for i, u in enumerate(units) if u["is_head"]} == heads
        assert [u["bi"] for u in units] == bi
        assert [u["position"] for u in units] == position
        assert {u["bunsetu"]: (u["phrase_start"], u["phrase_end"]) for u in units} == phrases
        assert [u["clause"] for u in units] == clause
        assert [u["depth"] for u in units] == list(map(len, up))
        assert [(u["left"], u["right"], u["descendants"]) for u in units] == [(min(x), max(x), len(x) - 1) for x in sub]


def test_trees_with_circles_and_crossings():
    import numpy as np

    head = np.array([1, 0, 2, 2])
    assert depths(head).tolist() == [-1, -1, 0, 1]
    assert edges(head, depths(head))[2].tolist() == [0, 0, 1, 0]
    rng = random.Random(1)
    trees = [random_tree(rng, rng.randint(1, 8), False) for _ in range(400)]
    begin = np.concatenate(([0], np.cumsum([len(t) for t in trees])))
    flat = np.concatenate([np.array(t) + b for t, b in zip(trees, begin, strict=False)])
    assert crossing(flat, begin).tolist() == [crosses(t) for t in trees]


def test_markers_are_whole_matches_of_all_patterns():
    s = [tok(1, "nmod_bunsetu", "NOUN"), tok(3, "advcl_bunsetu", "VERB"), tok(1, "punct", "PUNCT", ",", tag="mm"), tok(5, "advcl_bunsetu", "VERB"), tok(5, "nmod_bunsetu", "NOUN"), tok(5, "ROOT", "VERB")]
    assert {u["clause"] for u in run([s], markers=({"tag": "m"},))[0]} == {5}
    assert {u["clause"] for u in run([s], markers=({"tag": "m+", "orth": ";"},))[0]} == {5}
    assert [u["clause"] for u in run([s], markers=({"tag": "m+", "orth": "[,;]"},))[0]] == [1, 1, 1, 5, 5, 5]


def test_wanted_fields_are_those_of_all(monkeypatch):
    """F5, F10, F22 to F25: every field of tokens and units was made for each query, whatever it returned."""
    from kozue.plans import seed
    from kozue.schema import ARROW_UNIT

    texts = ["The Big red dog, 12 cats of Rome; running away fast, it seems", "", "a b", "Ünïcode ＡＢ, 日本語テキスト Abc Def ; ghij klmn"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([0] * 4, pa.int32()), pa.array(texts)], ["doc_id", "sent_id", "text"])
    options = R.Options(markers=seed.SEED_MARKERS)
    whole = R.recognised(seed.annotated(batch), options)
    full = {n: whole.column("units").flatten().field(n).to_pylist() for n in ARROW_UNIT.names}
    names = list(ARROW_UNIT.names)
    for wanted in [[n] for n in names] + [["left", "right", "descendants"], ["bi", "start", "end"], ["is_head", "label", "phrase_start", "phrase_end"], names]:
        tokens = seed.annotated(batch, R.read_for(wanted, options))
        units = R.recognised(tokens, options, wanted).column("units").flatten()
        assert sorted(units.type.names) == sorted(wanted)
        assert all(units.field(n).to_pylist() == full[n] for n in wanted)
    assert [f.name for f in seed.annotated(batch, ("head",)).column("tokens").type.value_type] == ["head"]
    assert "units" not in R.recognised(seed.annotated(batch, ("head", "orth")), options, ()).schema.names

    def not_needed(*_):
        raise AssertionError("subtrees aren't needed for roots")

    monkeypatch.setattr(R, "edges", not_needed)
    assert R.recognised(seed.annotated(batch, ("head",)), options, ("root",)).column("units").flatten().field("root").to_pylist() == full["root"]
