import json

from pyspark.sql import functions as F

from lodestone.sinks import writers
from lodestone.sources import structures, tables, text
from lodestone.streaming import streams


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content, encoding="utf-8")
    return str(p)


def test_smi(spark, tmp_path):
    got = text.smi(spark, put(tmp_path, "a.smi", "CC ethane x y\n\nC*\n")).collect()
    assert [(r.smiles, r.name) for r in got] == [("CC", "ethane"), ("C*", "C*")]


def test_documents_and_articles(spark, tmp_path):
    got = text.blank_line_documents(spark, put(tmp_path, "d.txt", "\na\nb\n\n\nc\n")).orderBy("at").collect()
    assert [(r.doc, r.value) for r in got] == [(0, "a"), (0, "b"), (1, "c")]
    got = text.tagged_articles(spark, put(tmp_path, "w.txt", '<doc id="1">\nTitle\n\none\ntwo\n</doc>\n<doc id="2">\nT\nlost\n')).orderBy("at").collect()
    assert [(r.doc, r.value) for r in got] == [(0, "one"), (0, "two")]


def test_reference_lines(spark, tmp_path):
    a, b = put(tmp_path, "t.txt", "x\n\ny\n"), put(tmp_path, "r.txt", "[1]\n[2, 3]\n")
    assert [(r.line, r.ref) for r in text.with_reference(spark, a, b, "array<int>").orderBy("nth").collect()] == [("x", [1]), ("y", [2, 3])]


def test_reference_lines_of_several_files(spark, tmp_path):
    for kind, cut in (("t", [3, 3]), ("r", [1, 4, 1])):
        (tmp_path / kind).mkdir()
        at = 0
        for i, n in enumerate(cut):
            (tmp_path / kind / f"{i}.txt").write_text("".join(f"line {k}\n\n" if kind == "t" else f"[{k}]\n" for k in range(at, at + n)))
            at += n
    got = text.with_reference(spark, str(tmp_path / "t"), str(tmp_path / "r"), "array<int>").orderBy("nth").collect()
    assert [(r.nth, r.line, r.ref) for r in got] == [(k, f"line {k}", [k]) for k in range(6)]


def test_tasks(spark, tmp_path):
    p = put(tmp_path, "cola.tsv", "﻿s\t1\t\tFirst one.\ns\t0\t\tTwo.\n")
    got = tables.task_examples(spark, p, "cola", "train").orderBy("guid").collect()
    assert [(r.guid, r.text_a, r.label) for r in got] == [("train-0", "First one.", "1"), ("train-1", "Two.", "0")]
    p = put(tmp_path, "qqp.tsv", "id\tq\tr\ta\tb\tl\n7\t1\t2\tx\ty\t1\n8\t1\n")
    got = tables.task_examples(spark, p, "qqp", "dev").collect()
    assert [(r.guid, r.text_a, r.text_b, r.label) for r in got] == [("dev-7", "x", "y", "1")]
    p = put(tmp_path, "x.tsv", "h\nde\tcontradictory\t\t\t\t\tp\th\nfr\tneutral\t\t\t\t\tp\th\n")
    assert [(r.text_a, r.label) for r in tables.xnli(spark, p, "test", "de").collect()] == [("p", "contradiction")]


def test_squad(spark, tmp_path):
    qa = {"id": "q", "question": "?", "answers": [{"text": "t", "answer_start": 2}]}
    no = {"id": "n", "question": "?", "is_impossible": True, "answers": []}
    p = put(tmp_path, "s.json", json.dumps({"data": [{"title": "T", "paragraphs": [{"context": "c t", "qas": [qa, no]}]}]}))
    got = {r.qas_id: (r.is_impossible, r.answer_text, r.answer_start) for r in tables.squad(spark, p, True).collect()}
    assert got == {"q": (False, "t", 2), "n": (True, None, None)}


def test_pdb_and_sdf_round_trip(spark, tmp_path):
    line = "ATOM      1  CA  ALA A   2      11.104   6.134  -6.504  1.00  0.00           C"
    p = put(tmp_path, "a.pdb", f"MODEL        1\n{line}\nENDMDL\nMODEL        2\n{line}\nENDMDL\n")
    atoms = structures.pdb_atoms(spark, p)
    r = atoms.first()
    assert atoms.count() == 1 and (r.name, r.res_name, r.res_seq, r.x, r.element, r.error) == ("CA", "ALA", 2, 11.104, "C", None)
    assert structures.sequences(atoms).first().sequence == "A"
    mols = spark.createDataFrame([("m", [(1, "C", 0.0, 0.5, -1.0), (2, "O", 1.0, 0.0, 0.0)], [(1, 2, 2)])], "title string, atoms array<struct<idx:int,symbol:string,x:double,y:double,z:double>>, bonds array<struct<a:int,b:int,order:int>>")
    block = writers.molblock(mols.withColumn("k", F.lit(1)), "k").first().molblock
    back = structures.sdf(spark, put(tmp_path, "m.sdf", block)).first()
    assert (back.title, back.n_atoms, back.n_bonds) == ("m", 2, 1) and back.atoms[1].symbol == "O" and back.bonds[0].order == 2


def _record(title, n, bad=False):
    atoms = [f"{i:10.4f}{0:10.4f}{'x' if bad and i == 1 else format(1, '.4f'):>10} C   0  0" for i in range(n)]
    bonds = [f"{i:3d}{i + 1:3d}  1  0" for i in range(1, n)]
    return "\n".join([title, "", "", f"{n:3d}{n - 1:3d}  0  0  0  0  0  0  0  0999 V2000", *atoms, *bonds, "M  END", "$$$$", ""])


def test_structure_files_are_cut_over_blocks(spark, tmp_path):
    """Records with and without titles, in several blocks and with both kinds of line ends; the first readable one."""
    for i, end in enumerate(("\n", "\r\n")):
        text = "".join(_record("" if k % 3 == 0 else f"m{k}", 2 + k % 5, bad=k % 7 == 0) for k in range(60)) + "bad\n\n\nxx\n"
        (tmp_path / f"{i}.sdf").write_bytes(text.replace("\n", end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        records = structures.sdf(spark, str(tmp_path)).cache()
        assert spark.read.text(str(tmp_path / "0.sdf")).rdd.getNumPartitions() > 10
        rows = records.orderBy("path", "nth").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2 * 61
    for part in (rows[:61], rows[61:]):
        assert [(r.nth, r.title, r.n_atoms, r.error) for r in part[:60]] == [(k, "" if k % 3 == 0 else f"m{k}", 2 + k % 5, "atoms" if k % 7 == 0 else None) for k in range(60)]
        assert part[60].error == "counts" and all(len(r.atoms) == r.n_atoms and [(b.a, b.b) for b in r.bonds] == [(i, i + 1) for i in range(1, r.n_atoms)] for r in part[:60])
    assert [(r.nth, r.title) for r in structures.first_readable(records).orderBy("path").collect()] == [(1, "m1")] * 2
    records.unpersist()


def test_models_are_numbered_by_file(spark, tmp_path):
    line = "ATOM  {:5d}  CA  ALA A{:4d}      11.104   6.134  -6.504  1.00  0.00           C"
    for name, begin in (("a", "MODEL        1"), ("b", "REMARK"), ("c", "MODEL        1")):
        (tmp_path / f"{name}.pdb").write_text("\n".join([begin, line.format(1, 1), "ENDMDL", "MODEL        2", line.format(2, 2)]) + "\n")
    for model, want in ((1, [("a", 1), ("b", 1), ("b", 2), ("c", 1)]), (2, [("a", 2), ("b", 1), ("c", 2)])):
        got = structures.pdb_atoms(spark, str(tmp_path), model).collect()
        assert sorted((r.path[-5], r.serial) for r in got) == want


def test_documents_of_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    (tmp_path / "b.txt").write_text("z\n\n\nw\n")
    apart = {(r.path[-5], r.doc, r.value) for r in text.blank_line_documents(spark, str(tmp_path)).collect()}
    assert apart == {("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("b", 1, "w")}
    assert {(r.doc, r.value) for r in text.blank_line_documents(spark, str(tmp_path), whole=True).collect()} == {(0, "x"), (1, "y"), (1, "z"), (2, "w")}
    for name in ("c", "d"):
        (tmp_path / name).mkdir()
    for i, t in enumerate(('lost\n<doc id="1">\nT\n\na\n', 'b\n</doc>\n<doc id="2">\nU\nc\n</doc>\n')):
        (tmp_path / "c" / f"{i}.txt").write_text(t)
        (tmp_path / "d" / f"{i}.txt").write_text('<doc id="1">\nT\nfirst\n</doc>\n')
    assert sorted((r.doc, r.value) for r in text.tagged_articles(spark, str(tmp_path / "c"), whole=True).collect()) == [(0, "a"), (0, "b"), (1, "c")]
    assert sorted((r.path[-5], r.doc, r.value) for r in text.tagged_articles(spark, str(tmp_path / "d")).collect()) == [("0", 0, "first"), ("1", 0, "first")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("CC", 0.12345)], "smiles string, similarity double")
    writers.top_k_tsv(rows, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()] == [("CC", "0.123")]
    writers.once(rows, str(tmp_path / "o"))
    writers.once(rows.union(rows), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 1
    used = spark.createDataFrame([("train", "r", "C"), ("train", "r", "C")], "split string, receptor string, fragment string")
    assert writers.examples_used(used).first().used == {"r": ["C", "C"]}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    turns.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    got = streams.drained(streams.conversation_state(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    # A row a conversation and micro-batch, of which there is one.
    assert sorted((r.conv_id, r.last_turn, r.n_turns, r.history) for r in got.collect()) == [(1, 1, 2, "user: a\nassistant: \n"), (2, 0, 1, "user: b\n")]
    (tmp_path / "txt").mkdir()
    put(tmp_path / "txt", "x.txt", "q\tc\nonly\n")
    piped = streams.piped(spark.readStream.text(str(tmp_path / "txt")), ["question", "context"])
    got = streams.drained(piped, str(tmp_path / "p"), str(tmp_path / "pc"))
    assert sorted((r.question, r.context) for r in got.collect()) == [("only", None), ("q", "c")]


def test_structure_families(spark, tmp_path):
    meta = put(tmp_path, "m.csv", "family,pdb_id,ligand,valid,smiles\n1,1ABC,LIG,valid,CC\n1,2xyz,X,invalid,O\n2,3nof,Y,valid,N\n")
    (tmp_path / "s").mkdir()
    for name in ("1abc.bio1", "1abc.bio2", "2XYZ.bio1", "1abc.txt"):
        (tmp_path / "s" / name).write_text("END\n")
    got = sorted((r.family, r.pdb_id, r.ligand, r.valid, r.smiles, r.path.split("/")[-1]) for r in tables.structure_families(spark, meta, str(tmp_path / "s")).collect())
    assert got == [("1", "1ABC", "LIG", True, "CC", "1abc.bio1"), ("1", "1ABC", "LIG", True, "CC", "1abc.bio2"), ("1", "2xyz", "X", False, "O", "2XYZ.bio1")]
