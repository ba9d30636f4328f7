"""Sources, sinks, the command line and streams."""

import io
import json

import pytest
from pyspark.sql import functions as F

from kozue import cli
from kozue.plans import seed
from kozue.sources import conllu, gold, lines, sinks, tagged
from kozue.streaming import lines as stream

TEXT = "#comment\nThe Great cats sleep, and Many dogs run.\n\nsecond Line here\n"


@pytest.fixture
def files(tmp_path):
    a, b = tmp_path / "b.txt", tmp_path / "a.txt"
    a.write_text(TEXT, encoding="utf-8")
    b.write_text("".join(f"line number {k}\n" for k in range(5000)), encoding="utf-8")
    return [str(a), str(b)]


def test_lines_keep_order(spark, files):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = lines.read_lines(spark, files).orderBy("file_no", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in got] == TEXT.rstrip("\n").split("\n") + [f"line number {k}" for k in range(5000)]
    assert [r.line_no for r in got] == list(range(4)) + list(range(5000)) and {r.file_no for r in got} == {0, 1}
    assert lines.read_lines(spark, []).count() == 0


def test_comment_modes(spark):
    df = lines.from_lines(spark, ["#a\n", "b\n", "#c", "d"])
    kinds = lambda mode: [r.kind for r in lines.comments(df, mode).orderBy("line_no").collect()]
    assert kinds("print") == ["comment", "text", "comment", "text"]
    assert kinds("skip") == ["text"] * 2 and kinds("analyze") == ["text"] * 4
    with pytest.raises(ValueError):
        lines.comments(df, "other")
    assert lines.treebank_sentences(lines.from_lines(spark, ["# text = a b", "x"])).first().text == "a b"


CONLLU = """# newdoc id = d1
# sent_id = s1
# text = ab c.
1\tab\tAB\tNOUN\tn\t_\t2\tnmod\t_\tBunsetuBILabel=B|NE=B-GPE|SpaceAfter=Yes
2\tc\tc\tVERB\tv\t_\t0\troot\t_\tBunsetuBILabel=B|SpaceAfter=No
3\t.\t.\tPUNCT\tp\t_\t2\tpunct\t_\t_

# sent_id = s2
# text = bad
1\tbad\tbad\tNOUN

# sent_id = s3
# text = xy
1-2\txy\t_\t_\t_\t_\t_\t_\t_\t_
1\tx\tx\tNOUN\tn\t_\t2\tnmod\t_\tSpaceAfter=No
2\ty\ty\tNOUN\tn\t_\t0\troot\t_\tSpaceAfter=No

# sent_id = s4
# text = zz
1\ty\ty\tNOUN\tn\t_\t0\troot\t_\t_
"""


def test_conllu(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.conllu").write_text(CONLLU, encoding="utf-8")
    got = {r.sent_id: r for r in conllu.read_conllu(spark, str(tmp_path)).collect()}
    s = got["s1"]
    assert s.newdoc == "d1" and s.bi == ["B", "B", None] and s.error is None
    assert [(t.orth, t.ws, t.idx, t.head, t.ent_iob, t.ent_type) for t in s.tokens] == [("ab", " ", 0, 1, "B", "GPE"), ("c", "", 3, 1, "O", ""), (".", "", 4, 1, "O", "")]
    assert got["s2"].error == "4 columns: 1\tbad\tbad\tNOUN" and got["s2"].tokens is None
    assert [t.orth for t in got["s3"].tokens] == ["x", "y"]
    assert "isn't at" in got["s4"].error
    again = conllu.parse_block(conllu.write_conllu_text([t.asDict() for t in s.tokens], s.misc, s.text, "s1"))
    assert again["text"] == s.text and [t["head"] for t in again["tokens"]] == [1, 1, 1]


def test_gold(spark, tmp_path):
    tokens = [{"id": 1, "orth": "ab", "tag": "n", "pos": "NOUN", "lemma": "ab", "head": 1, "dep": "nmod", "ner": "U-GPE", "whitespace": " "}, {"id": 2, "orth": "c", "tag": "v", "pos": "VERB", "lemma": "c", "head": 0, "dep": "root", "ner": "O"}]
    (tmp_path / "g.json").write_text(json.dumps([{"id": "d", "paragraphs": [{"raw": "ab c", "sentences": [{"tokens": tokens}]}]}]), encoding="utf-8")
    sents = gold.read_gold(spark, str(tmp_path / "g.json"))
    rows = sents.select(gold.plain_tokens().alias("tokens")).first().tokens
    assert [(r.orth, r.ws, r.head, r.ent_iob, r.ent_type) for r in rows] == [("ab", " ", 1, "U", "GPE"), ("c", "", 1, "O", "")]
    back = json.loads(gold.to_gold(sents.withColumnRenamed("id", "doc_id"), ["doc_id"]).first().json)
    assert back["paragraphs"][0]["sentences"][0]["tokens"][0]["orth"] == "ab"
    (tmp_path / "s.conllu").write_text("# sent_id = 1\n# text = ab c\n1\tab\tab\tNOUN\tn\t_\t2\tnmod\t_\tNE=B-GPE\n2\tc\tc\tNOUN\tv\t_\t0\troot\t_\tSpaceAfter=No\n", encoding="utf-8")
    counted = {r.measure: (r.correct, r.gold, r.system) for r in cli.evaluate_texts(sents, conllu.read_conllu(spark, str(tmp_path / "s.conllu"))).collect()}
    assert counted["las"] == (2, 2, 2) and counted["pos"] == (1, 2, 2) and counted["ent_label"] == (1, 1, 1)
    live = {r.measure: (r.correct, r.gold, r.system) for r in cli.evaluate_texts(sents, cli.live_parses(sents, "seed")).collect()}
    assert live["tokens"] == (2, 2, 2) and live["sentence"] == (1, 1, 1)


def test_tagged(spark):
    files = [("f1", "<DOC><TEXT>In <LOC>New <X>York</X></LOC> and\n<P a='1'>Ann</P><br/>!</TEXT></DOC>"), ("f2", "<rejectedBlock/><TEXT></TEXT>"), ("f3", "<TEXT><A>x</B></TEXT>"), ("f4", "<TEXT><A>x</TEXT>"), ("f5", None)]
    got = {r.file_id: r for r in tagged.parse(spark.createDataFrame(files, "file_id string, value string")).collect()}
    assert got["f1"].text == "In New York and\nAnn!" and [(t.label, t.begin, t.end) for t in got["f1"].tags] == [("LOC", 3, 11), ("P", 16, 19)]
    assert "f2" not in got and all(got[f].error for f in ("f3", "f4", "f5"))
    assert tagged.tag_table(tagged.parse(spark.createDataFrame(files[:1], "file_id string, value string"))).count() == 2


def test_meta():
    assert sinks.merge_meta({"a": 1}, {"a": 2, "b": 3}) == {"a": 1, "b": 3}


def output(spark, source, *argv):
    args = cli.parser().parse_args([*argv])
    out = io.StringIO()
    sinks.write_one(cli.run_lines(spark, source, args), out, args.output_format == "json")
    return out.getvalue()


def test_command_line_formats(spark, files):
    source = lines.read_lines(spark, files[:1])
    text = output(spark, source, "analyze")
    assert text.startswith("#comment\n# text = The Great cats") and text.count("# text") == 2
    assert output(spark, source, "analyze", "-c", "skip").count("#comment") == 0
    assert output(spark, source, "analyze", "-c", "analyze").count("# text") == 3
    assert all(len(x.split("\t")) == 10 for x in text.splitlines() if x and not x.startswith("#"))
    docs = json.loads(output(spark, source, "analyze", "-f", "json", "-c", "skip"))
    assert len(docs) == 2
    assert len(json.loads(output(spark, source, "analyze", "-f", "json"))) == 3  # comments are analysed then
    assert output(spark, source, "morphemes", "-c", "skip").count("EOS") == 2
    assert output(spark, source, "analyze", "-f", "1", "-c", "skip").count("EOS") == 2
    assert json.loads(output(spark, source.filter("false"), "analyze", "-f", "json")) == []


def test_command_line_arguments(spark, files, tmp_path):
    for bad in (["analyze", "-s", "D"], ["analyze", "-c", "x"], ["evaluate", "x"], []):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2
    with pytest.raises(SystemExit):
        cli.main(["analyze", "-b", "seed", "-m", "seed"])
    with pytest.raises(ValueError):
        cli.main(["analyze", "-f", "9"])
    assert set(cli.bench(spark, lines.from_lines(spark, ["a b", "c d"]), ["seed", "lattice"], 2)) == {"seed", "lattice"}


def test_written_parts_are_in_order(spark, files, tmp_path):
    args = cli.parser().parse_args(["analyze", "-c", "print"])
    out = cli.run_lines(spark, lines.read_lines(spark, files), args)
    sinks.write_parts(out, str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    whole = io.StringIO()
    sinks.write_one(out, whole)
    assert "".join(p.read_text(encoding="utf-8") for p in parts) == whole.getvalue()


def test_stream_is_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.txt").write_text(f"{TEXT}file {k} has Words\n", encoding="utf-8")
    query = stream.write_stream(stream.analyse_stream(stream.read_stream(spark, str(folder), 1)), str(tmp_path / "out"), str(tmp_path / "ckpt"), True)
    query.awaitTermination(120)
    streamed = sorted(r.out for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted(r.out for r in stream.analyse_stream(spark.read.text(str(folder))).collect())
    assert streamed == batch and len(batch) == 12


def test_seed_covers_its_text(spark):
    texts = ["Tab\there , and\r ends", "  leading", "é中文 mixed123 ! ?", "x" * 3000, "😀 a_b"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sent_id int, text string")
    for r in seed.annotate(rows).collect():
        assert all(r.text[t.idx : t.idx + len(t.orth)] == t.orth for t in r.tokens)
        assert "".join(t.orth for t in r.tokens) == "".join(r.text.split())
        assert sum(t.dep == "ROOT" for t in r.tokens) == 1
    assert seed.sentences_of(spark.createDataFrame([(1, None), (2, ""), (3, "\n \n a")], "doc_id long, text string")).select("doc_id", "sent_id").collect() == [(3, 2)]
    assert rows.select(F.lit(1)).count() == 5


def test_convert_skips_and_marks(spark, tmp_path):
    def block(name, *tokens):
        rows = [f"{i + 1}\t{orth}\t{orth}\tN\tn\t_\t{head}\t{dep}\t_\tSpaceAfter=No|{misc}" for i, (orth, head, dep, misc) in enumerate(tokens)]
        return "\n".join([f"# sent_id = {name}", f"# text = {''.join(t[0] for t in tokens)}", *rows]) + "\n\n"

    b, i = "BunsetuBILabel=B|LUWBILabel=B|LUWPOS=x", "BunsetuBILabel=I|LUWBILabel=I|LUWPOS=x"
    text = block("good", ("a", 3, "nmod", b + "|NE=B-P"), ("b", 1, "case", i + "|NE=I-P"), ("c", 0, "root", b + "|NE=B-Q"))
    text += block("crossing", ("d", 3, "x", b), ("e", 4, "x", b), ("f", 0, "root", b), ("g", 3, "x", b))
    text += block("circle", ("h", 2, "x", b), ("i", 1, "x", b), ("j", 0, "root", b))
    text += block("badlabel", ("k", 0, "root", b + "|NE=I-P"))
    text += block("nolabels", ("m", 0, "root", "A=1"))
    (tmp_path / "t.conllu").write_text(text)
    sents = conllu.read_conllu(spark, str(tmp_path / "t.conllu")).filter("error is null").coalesce(1).cache()

    def tokens(*options):
        (row,) = cli.convert(sents, 0, *options).collect()
        return {t["orth"]: (t["dep"], t["ner"]) for p in json.loads(row.json)["paragraphs"] for s in p["sentences"] for t in s["tokens"]}

    plain = {"a": ("nmod", "B-P"), "b": ("case", "L-P"), "c": ("root", "U-Q")}
    assert tokens() == plain | {"m": ("root", "O")}
    assert tokens(True) == plain | {"a": ("nmod_bunsetu", "B-P")}
    assert tokens(False, True) == {"a": ("nmod", "B-x"), "b": ("case", "L-x"), "c": ("root", "U-x"), "k": ("root", "U-x")}


def test_convert_options(spark, tmp_path, monkeypatch):
    def block(name, *tokens):
        rows = [f"{i + 1}\t{orth}\t{orth}\tN\tn\t_\t{head}\t{dep}\t_\tSpaceAfter=No|BunsetuBILabel={'I' if i else 'B'}" for i, (orth, head, dep) in enumerate(tokens)]
        return "\n".join([f"# sent_id = {name}", f"# text = {''.join(t[0] for t in tokens)}", *rows]) + "\n\n"

    text = "".join(block(f"p{k // 6}-{k}", (f"食{k}", 2, "compound"), ("品", 0, "root")) if k % 3 else block(f"p{k // 6}-{k}", ("。", 0, "root")) for k in range(12))
    text += block("q-1", ("機能", 3, "compound"), ("性", 3, "compound"), ("食品", 0, "root"))
    monkeypatch.setattr("sys.stdin", io.StringIO(text))
    sents = conllu.read_conllu(spark, "-").filter("error is null").cache()
    assert sents.count() == 13

    def paragraphs(n, **options):
        (row,) = cli.convert(sents, n, **options).collect()
        return [["".join(t["orth"] for t in s["tokens"]) for s in p["sentences"]] for p in json.loads(row.json)["paragraphs"]]

    whole = [w for p in paragraphs(0) for w in p]
    assert len(whole) == 13 and whole[10] == "食10品" and whole[-1] == "機能性食品"  # in the order of the file
    assert [len(p) for p in paragraphs(5)] == [5, 8]
    assert [len(p) for p in paragraphs(2, end_period=True)] == [4, 3, 6]
    assert [len(p) for p in paragraphs(100, paragraph_pattern=r"^(.*)-[^-]*$")] == [6, 6, 1]
    tokens = lambda mode: [[t["orth"] for t in s["tokens"]] for p in json.loads(cli.convert(sents, 0, retokenize=mode).first().json)["paragraphs"] for s in p["sentences"]][-1]
    assert tokens("A") == ["機能", "性", "食品"] and tokens("B") == ["機能性", "食品"] and tokens("C") == ["機能性食品"]
    more = paragraphs(0, augment=True)
    assert more[0] == whole and 0 < len(more[1]) < 13
    (tmp_path / "t.conllu").write_text(text, encoding="utf-8")
    monkeypatch.setattr(cli, "session", lambda _: spark)
    assert cli.main(["convert", str(tmp_path / "t.conllu"), "-n", "1,10,-15", "-o", str(tmp_path / "out")]) == 0
    assert [len(json.loads(spark.read.text(str(tmp_path / "out" / f"n={n}")).first().value)["paragraphs"]) for n in (1, 10)] == [13, 1]
    with pytest.raises(SystemExit):
        cli.main(["convert", "-l", "-r", "A", "-o", "x"])


def test_analysis_into_a_folder(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda _: spark)
    assert cli.main(["analyze", "-g", "-o", f"{tmp_path}/parts/", files[0]]) == 0
    assert cli.main(["analyze", "-o", f"{tmp_path}/one.conllu", files[0]]) == 0
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text(encoding="utf-8") for p in parts) == (tmp_path / "one.conllu").read_text(encoding="utf-8") != ""


def test_evaluation_of_an_annotator(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda _: spark)
    rows = spark.createDataFrame([("d", 0, 0, "The cats sleep"), ("d", 0, 1, "Dogs run , fast"), ("d", 1, 0, "The cats sleep")], "id string, paragraph long, sent_id int, text string")
    named = seed.annotate(rows.select(F.xxhash64("id", "paragraph", "sent_id").alias("doc_id"), "sent_id", "text"))
    from kozue.operators.formats import gold_tokens

    docs = gold.to_gold(named.select(F.lit("d").alias("id"), F.lit(0).alias("paragraph"), F.col("doc_id").alias("sent_id"), "text", gold_tokens().alias("tokens")), ["id"])
    (tmp_path / "g.json").write_text(docs.first().json, encoding="utf-8")
    assert cli.main(["evaluate", "-b", "seed", str(tmp_path / "g.json")]) == 0
    out = capsys.readouterr().out
    assert out.count("\n") == 13 and "f1 1.0000" in out and "f1 0" not in out.replace("f1 0.0000", "")


def test_dictionary_tables(spark):
    from kozue.plans import lattice

    table = spark.createDataFrame([("東京スカイ", "名詞-固有名詞-一般", 200, None), ("", "x", 1, None), ("y", None, 1, None)], "surface string, tag string, cost int, other string")
    entries = lattice.read_entries(table)
    assert [e.surface for e in entries] == ["東京スカイ"]
    got = lattice.annotator(user=entries)(spark.createDataFrame([(1, 0, "東京スカイ")], "doc_id long, sent_id int, text string")).first()
    assert [t.orth for t in got.tokens] == ["東京スカイ"]
    with pytest.raises(ValueError):
        lattice.read_entries(table, 0)


def test_socket_stream(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        with server.accept()[0] as c:
            c.sendall(b"The cats sleep\n#said\n\nDogs run\n")
            done.wait(60)

    done = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    query = stream.write_stream(stream.analyse_stream(stream.read_socket(spark, "127.0.0.1", server.getsockname()[1])), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.read.schema("doc_id long, sent_id int, out string").parquet(str(tmp_path / "out")).count() == 2:
                break
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    finally:
        query.stop()
        done.set()
        server.close()


def test_small_tables_are_spread(spark, tmp_path):
    from kozue.sources.tables import read_table, spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    df = read_table(spark, str(tmp_path), "one")
    assert df.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and df.count() == 1000
    one = spark.read.parquet(str(tmp_path / "one.parquet"))
    assert spread(one, 10) is one
    spark.range(1000).repartition(20).write.parquet(str(tmp_path / "many.parquet"))
    many = spark.read.parquet(str(tmp_path / "many.parquet"))
    assert spread(many) is many


def test_tables_of_large_row_groups_are_spread(spark, tmp_path):
    from kozue.sources.tables import largest_piece, spread

    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    one = spark.read.parquet(str(tmp_path / "one.parquet"))
    assert largest_piece(one, 1000) > 1000 and largest_piece(one) == 32 << 20
    size = largest_piece(one, 1000)
    assert spread(one, 10, size) is one
    moved = spread(one, 10, size // 40)
    assert moved.rdd.getNumPartitions() > 40 and moved.count() == 100_000


def test_tasks_read_bounded_pieces_of_a_table(spark, tmp_path):
    """F20 to F25: splits of up to 128 MB, which grow with the table, made tasks that take as much longer."""
    from kozue.sources.tables import in_pieces, read_table

    path = str(tmp_path / "t.parquet")
    spark.range(200_000).selectExpr("id", "md5(cast(id as string)) as h").coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = in_pieces(spark, path, 1 << 20)
    assert spark.read.parquet(path).rdd.getNumPartitions() < 6 <= got.rdd.getNumPartitions()
    assert got.agg({"id": "sum"}).first()[0] == sum(range(200_000)) and got.sparkSession is spark
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert read_table(spark, str(tmp_path), "t", 1 << 20).count() == 200_000
