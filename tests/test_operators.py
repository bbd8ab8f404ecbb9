from pyspark.sql import functions as F

from lodestone.functions import atoms, owa, text, tokens, vectors
from lodestone.operators import decoding, metrics, retrieval, sequences, splits, vocabulary, voxels
from lodestone.plans import evaluation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_top_k_accuracy_of_the_known_example(spark):
    labels = [[0, 0, 0, 0, 1], [0, 0, 0, 1, 1], [0, 0, 1, 0, 0], [0, 1, 0, 0, 0], [1, 0, 0, 0, 0], [1, 1, 0, 0, 0]]
    preds = [[0, 0, 0, 0, 0.5], [0, 0, 0, 0.5, 0.1], [1, 0.6, 0, 0, 0.1], [0, 0.4, 0, 0, 0.1]]
    library = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(labels)], "id long, vector array<double>")
    queries = spark.createDataFrame([(100 + i, [float(x) for x in v], [0.0, 0.0, 0.0, 0.0, 1.0]) for i, v in enumerate(preds)], "id long, vector array<double>, target array<double>")
    got = {r.k: r.accuracy for r in retrieval.top_k_accuracy(retrieval.target_ranks(queries, library), [1, 2, 3, 4, 5]).collect()}
    assert got == {1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0, 5: 1.0}


def test_top_k_ties_and_empty(spark):
    library = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "id long, vector array<double>")
    assert [(r.rank, r.match_id) for r in retrieval.top_k(queries, library, 2).orderBy("rank").collect()] == [(1, 1), (2, 3)]
    assert retrieval.top_k(queries.limit(0), library, 2).count() == 0


def test_top_k_finds_the_row_with_the_id_of_the_query(spark):
    import pytest

    library = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.1])], "id long, vector array<double>")
    assert [r.match_id for r in retrieval.top_k(queries, library, 2).orderBy("rank").collect()] == [0, 1]
    assert [r.match_id for r in retrieval.top_k(queries, library, 1, exclude_self=True).collect()] == [1]
    with pytest.raises(ValueError):
        retrieval.top_k(queries, library, 3)


def test_a_target_outside_the_label_set_is_snapped(spark):
    library = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0], [1.0, 1.9])], "id long, vector array<double>, target array<double>")
    assert retrieval.target_ranks(queries, library).first()["rank"] == 2


def test_label_set_keeps_the_earlier_source_and_the_last_row(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x")], "entry int, fp string")
    b = spark.createDataFrame([(8, "x"), (9, "y")], "entry int, fp string")
    assert sorted((r.fp, r.entry) for r in retrieval.label_set([a, b], "fp", "entry").collect()) == [("x", 2), ("y", 9)]


def test_smoothing_weights(spark):
    assert [round(x, 6) for x in one(spark, owa.smoothing_weights(F.lit(4), 0.1, 1))] == [0.1, 0.09, 0.081, 0.729]
    assert [round(x, 6) for x in one(spark, owa.smoothing_weights(F.lit(4), 0.1, 2))] == [0.001, 0.009, 0.09, 0.9]
    assert one(spark, owa.smoothing_weights(F.lit(1), 0.3, 1)) == [1.0] == one(spark, owa.smoothing_weights(F.lit(1), 0.3, 2))
    smoothed = {f"owa_exp_smooth{n}_0{i}" for n in (1, 2) for i in range(1, 10)}
    assert set(owa.OPERATORS) == {"mean", "owa1", "owa2", "owa3", "choquet", "choquet_symmetric", "sugeno"} | smoothed and round(one(spark, owa.operator("mean")(F.array(F.lit(1.0), F.lit(3.0)))), 9) == 2


def test_truncated_pair(spark):
    a, b = F.sequence(F.lit(0), F.lit(9)), F.sequence(F.lit(0), F.lit(4))
    x, y = tokens.truncated_pair(a, b, 20)
    assert (one(spark, x), one(spark, y)) == (list(range(10)), list(range(5)))
    x, y = tokens.truncated_pair(a, b, 10)
    assert (one(spark, x), one(spark, y)) == (list(range(5)), list(range(5)))


def test_tensor_size():
    assert voxels.VoxelParams().tensor_size(9) == (1, 9, 24, 24, 24)


def test_text(spark):
    assert one(spark, text.normalize_answer(F.lit("The  Cat, an a!"))) == "cat"
    assert one(spark, text.tokenize_numbers(F.lit("5,000,123 and 1.73"))) == "5 @,@ 000 @,@ 123 and 1 @.@ 73"
    assert one(spark, text.reduce_lengthening(F.lit("waaaaay"))) == "waaay"
    assert one(spark, text.remove_handles(F.lit("hi @user x@y"))) == "hi   x@y"
    assert one(spark, text.normalize_tweet(F.lit("@bob I don't see http://x.y"))) == "@USER I do n't see HTTPURL"
    assert one(spark, text.token_f1(F.lit(""), F.lit("the"))) == 1.0
    assert one(spark, text.token_f1(F.lit("a b c d"), F.lit("b b"))) == 2 / 5


def test_activations(spark):
    for name, f in vectors.ACTIVATIONS.items():
        assert abs(one(spark, f(F.lit(0.0)))) <= 0.5, name


def test_rotation_keeps_length(spark):
    x, y, z = atoms.rotated(tuple(map(F.lit, (0.5, 0.5, 0.5, 0.5))), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, F.array(x, y, z)) == [3.0, 1.0, 2.0]


def test_metrics_of_nothing_in_common(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0)], "p int, g int")
    r = metrics.classification(rows, "p", "g").first()
    assert (r.acc, r.f1, r.mcc) == (0.0, 0.0, 0.0)


def test_beam_and_bans(spark):
    seq = spark.createDataFrame([("a", i, t) for i, t in enumerate([1, 2, 3, 1, 2])], "k string, pos int, token int")
    assert [r.token for r in decoding.banned_ngrams(seq, "k", 3).collect()] == [3]
    c = spark.createDataFrame([(0, 0, 5, -1.0), (0, 0, 6, -2.0), (0, 1, 7, -3.0), (0, 1, 8, -4.0)], "batch int, beam int, token int, score double")
    on, ended = decoding.beam_step(c, 2, 5)
    assert [r.token for r in on.orderBy("slot").collect()] == [6, 7] and [r.token for r in ended.collect()] == [5]


def test_numbered_and_batched(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    n = sequences.numbered(rows, ["v"])
    assert n.where("nth <> v").count() == 0
    b = sequences.batched(n, "nth", 300, "v").orderBy("batch").collect()
    assert [len(r["values"]) for r in b] == [300, 300, 300, 100]


def test_numbered_has_no_gap_in_a_large_written_table(spark, tmp_path):
    rows = spark.range(3_000_000, numPartitions=6).select(F.xxhash64("id").alias("v"), F.concat(F.lit("text of row "), "id").alias("t"))
    sequences.numbered(rows, ["v"]).write.parquet(str(tmp_path / "n"))
    got = spark.read.parquet(str(tmp_path / "n"))
    assert got.agg(F.countDistinct("nth"), F.min("nth"), F.max("nth")).first()[:] == (3_000_000, 0, 2_999_999)


def test_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(2).alias("x"))
    assert sequences.running(rows, ["v"], {"upto": "x"}).where("upto <> 2 * (v + 1)").count() == 0


def test_task_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (2, 2), (1, 0)], "p int, g int")
    assert metrics.task_metrics("mnli", rows, "p", "g").first()["mnli/acc"] == 0.5
    assert set(metrics.task_metrics("mrpc", rows.where("p < 2"), "p", "g").columns) == {"acc", "f1", "acc_and_f1"}
    flat = metrics.regression(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "p double, g double"), "p", "g").first()
    assert flat["mae"] == 1.0 and flat["r2"] != flat["r2"]


def test_splits_do_not_overlap(spark):
    rows = spark.range(500).select("id", (F.col("id") % 50).alias("item"), splits.split_of(F.col("id")).alias("split"))
    out = splits.without_overlap(rows, "item")
    assert out.count() == 500 and out.select("item", "split").distinct().count() == 50
    assert splits.negatives(sequences.numbered(rows.select("id"), ["id"]), "nth", "id").where("id = other").count() == 0


def test_vocabulary_and_encoding(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "z"])], "k int, tokens array<string>")
    v = vocabulary.vocabulary(rows, "tokens", ["<unk>"], 3)
    assert [(r.token, r.id) for r in v.orderBy("id").collect()] == [("<unk>", 0), ("b", 1), ("a", 2), ("c", 3)]
    assert {r.k: r.ids for r in vocabulary.encoded(rows, "k", "tokens", v, 0).collect()} == {1: [1, 2, 1], 2: [3, 0]}


def test_evaluation(spark):
    library = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vector array<double>")
    preds = spark.createDataFrame([(7, c, r, [1.0, 0.1 * r], [1.0, 0.0]) for c in (0, 1) for r in (0, 1)], "entry long, checkpoint int, rotation int, vector array<double>, target array<double>")
    matches, accuracy = evaluation.evaluated(preds, library, 2)
    assert matches.where("rank = 1").first().match_id == 0 and accuracy.where("k = 1").first().accuracy == 1.0
    assert evaluation.label_codes("all,x.smi") == ["train", "val", "test", "x.smi"]


def test_fragments_of_ibuprofen(spark):
    """CC(C)CC1=CC=C(C=C1)C(C)C(=O)O has 8 single bonds outside its ring; each end has a heavy atom."""
    from lodestone.operators.fragments import heavy_atoms, mass, split_bonds

    symbols = "CCCCCCCCCCCCCOO"
    pairs = [(1, 2, 1), (2, 3, 1), (2, 4, 1), (4, 5, 1), (5, 6, 2), (6, 7, 1), (7, 8, 2), (8, 9, 1), (9, 10, 2), (10, 5, 1), (8, 11, 1), (11, 12, 1), (11, 13, 1), (13, 14, 2), (13, 15, 1)]
    rows = [("m", [(i + 1, s, 0.0, 0.0, 0.0) for i, s in enumerate(symbols)], pairs), ("none", [], [])]
    mols = spark.createDataFrame(rows, "k string, atoms array<struct<idx:int,symbol:string,x:double,y:double,z:double>>, bonds array<struct<a:int,b:int,order:int>>")
    got = split_bonds(mols, "k").orderBy("bond").collect()
    assert len(got) == 8 and all(sorted(r.parent + r.fragment) == list(range(1, 16)) for r in got)
    assert [r.fragment for r in got][0] == [1] and all(len(r.fragment) <= len(r.parent) for r in got)
    assert split_bonds(mols, "k", most_mass=20).count() == 4
    r = mols.select(mass(F.transform("atoms", lambda a: a["symbol"])).alias("m"), heavy_atoms(F.transform("atoms", lambda a: a["symbol"])).alias("n")).first()
    assert abs(r.m - (13 * 12 + 2 * 15.99491461956)) < 1e-9 and r.n == 15


def test_smiles(spark):
    from lodestone.functions import smiles

    assert one(spark, smiles.decode(smiles.encode(F.lit("ClC(Br)[Si]")))) == "ClC(Br)[Si]"
    ids = one(spark, smiles.ids(F.lit("CCl"), 6))
    assert ids == [1, smiles.VOCABULARY["C"], smiles.VOCABULARY["L"], 2, 0, 0] and one(spark, smiles.ids(F.lit("CCCCC"), 6)) == [0] * 6


def test_projection_is_centred(spark):
    from lodestone.operators.projection import fitted

    rows = spark.createDataFrame([(i, [float(i % 3 + 1), float(i % 5 + 1), 1.0]) for i in range(30)], "id long, vector array<double>")
    project, explained = fitted(rows, 2)
    means = project(rows).select(*[F.avg(F.get("components", F.lit(i))).alias(f"m{i}") for i in range(2)]).first()
    assert abs(means.m0) < 1e-9 and abs(means.m1) < 1e-9 and 90 < sum(explained) <= 100.001


def test_whole_texts_are_assembled_masked_and_counted(spark, tmp_path):
    from lodestone.queries import QUERIES

    texts = {1: " ".join("abc"[: i % 3 + 1] for i in range(250)), 2: "one two", 3: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {k: [len(w) for w in t.split()] for k, t in texts.items()}
    got = QUERIES["tokens_assembled_whole"](spark, str(tmp_path)).orderBy("doc_id", "start").collect()
    for k, w in words.items():
        assert [x for r in got if r.doc_id == k for x in map(int, r.input_ids.split(",")[1 : r.n - 1])] == w
    got = QUERIES["tokens_masked_whole"](spark, str(tmp_path)).orderBy("doc_id", "pos").collect()
    assert all([r.label if r.label >= 0 else r.input_id for r in got if r.doc_id == k] == w for k, w in words.items())
    assert any(r.label >= 0 for r in got if r.pos >= 100)
    assert sum(r.n for r in QUERIES["tokens_ngrams_whole"](spark, str(tmp_path)).collect()) == 248


def test_batch_evaluation_looks_all_entries_up(spark):
    import numpy as np

    from lodestone.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    own, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-6)
    want, ranks = {}, []
    for e in set(own // 15):
        at = own // 15 == e
        v = unit(np.mean([x[at & (own % 15 // 5 == c)].mean(axis=0) for c in sorted(set(own[at] % 15 // 5))], axis=0))
        near = unit(x) @ v
        want[-1 - e] = sorted(-near)[:5]
        ranks.append((near > unit(x[at][0]) @ v + 1e-12).sum())
    got = QUERIES["batch_evaluation"](spark, sf).collect()
    assert len(got) == 5 * len(want) and {r.query_id for r in got} == set(want)
    assert all(abs(r.similarity + want[r.query_id][r["rank"] - 1]) < 1e-9 for r in got)
    assert all(abs(r.accuracy - np.mean(np.array(ranks) < r["rank"])) < 1e-9 for r in got)
