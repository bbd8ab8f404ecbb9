"""Steps whose work or shuffles once grew faster than their input, against plain loops."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import answers, clusters, decoding, masking, merges, streams_of_tokens, voxels


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tanimoto(a, b):
    return len(a & b) / len(a | b)


def test_similar_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    r = random.Random(3)
    sets = [(i, r.sample(range(30), r.randint(4, 7))) for i in range(300)]
    rows = spark.createDataFrame(sets, "id long, bits array<int>").withColumn("bits", F.transform("bits", lambda x: x.cast("string")))
    for least in (0.5, 0.6, 0.8):
        want = sorted((a, b) for a, x in sets for b, y in sets if a < b and 1 - tanimoto(set(x), set(y)) <= 1 - least)
        assert sorted(map(tuple, clusters.similar_pairs(rows, least).collect())) == want


def test_blocks_with_more_marks_than_a_matrix_holds(monkeypatch):
    r = random.Random(4)
    marks = [r.sample(range(40), r.randint(1, 9)) for _ in range(90)]
    table = pa.table({"id": list(range(90)), "own": pa.array([int(i > 50) for i in range(90)], pa.int32()), "marks": pa.array(marks, pa.list_(pa.int64()))})
    found = []
    for dense in (clusters.DENSE, 0):
        monkeypatch.setattr(clusters, "DENSE", dense)
        got = clusters._similar(0.4)(table)
        found.append(sorted(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)))
    want = sorted((a, b) for a in range(51) for b in range(51, 90) if tanimoto(set(marks[a]), set(marks[b])) >= 0.4 - 1e-9)
    assert found == [want, want]


def test_max_context_shuffles_spans_and_not_tokens(spark):
    r = random.Random(5)
    spans = [(k, s * 5, r.randint(1, 17)) for k in range(20) for s in range(6)]
    rows = spark.createDataFrame(spans, "doc int, start int, n int")
    found = answers.max_context(rows, "doc")
    want = {}
    for k, s, n in spans:
        for p in range(s, s + n):
            new = (min(p - s, s + n - 1 - p) + 0.01 * n, -s)
            want[k, p] = max(new, want.get((k, p), new))
    assert {(x.doc, x.pos): x.start for x in found.collect()} == {k: -v[1] for k, v in want.items()}
    text = plan(found)
    assert text.count("Aggregate") == 1 and "Aggregate [doc" in text and text.index("explode") < text.index("Aggregate")


def test_banned_ngrams_have_one_order_and_no_join(spark):
    r = random.Random(6)
    rows = [(k, [r.randint(0, 3) for _ in range(r.randint(0, 40))]) for k in range(30)]
    frame = spark.createDataFrame(rows, "k int, s array<int>").select("k", F.posexplode("s").alias("pos", "token"))
    for n in (2, 3, 4):
        found = decoding.banned_ngrams(frame, "k", n)
        want = {(k, s[i + n - 1]) for k, s in rows for i in range(len(s) - n + 1) if s[i : i + n - 1] == s[len(s) - n + 1 :]}
        assert {tuple(x) for x in found.collect()} == want
        assert "Join" not in plan(found)


def test_whole_words_shuffle_nothing(spark):
    r = random.Random(7)
    rows = [(k, ["[CLS]", *(r.choice(["a", "##b", "c"]) for _ in range(r.randint(0, 60))), "[SEP]"]) for k in range(40)] + [(99, []), (98, ["[CLS]"])]
    found = masking.whole_words(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", seed=2)
    assert not any(x in plan(found) for x in ("Aggregate", "Window", "Repartition"))

    def hashed(x):
        first = (x + 2) * 2654435761 % (1 << 32)
        return ((first >> 7) * (2246822519 % (1 << 31)) + first) % (1 << 32)

    want = set()
    for k, tokens in rows:
        words, budget, used = [], max(1, int(np.rint(len(tokens) * 0.15))), 0
        for i, t in enumerate(tokens):
            if t in ("[CLS]", "[SEP]"):
                continue
            if not words or not t.startswith("##"):
                words.append([])
            words[-1].append(i)
        for w in sorted(words, key=lambda w: (hashed((k * 4096 + w[0]) % (1 << 31)), w[0])):
            if used + len(w) <= budget:
                used += len(w)
                want |= {(k, i) for i in w}
    assert {tuple(x) for x in found.collect()} == want


def test_what_grows_from_a_small_file_is_not_broadcast(spark):
    points = spark.range(1000).select(F.col("id").alias("item"), *[F.lit(0.0).alias(c) for c in "xyz"])
    tokens = spark.range(8000).select(F.col("id").alias("nth"), F.col("id").alias("token"))
    streams = streams_of_tokens.stream_batches(tokens, "nth", "token", 8, lambda t, n: streams_of_tokens.fixed_batches(t, n, 35), look_back=8)
    for found, hinted in ((voxels.near_any(points, points, 2.0), "Generate"), (streams, "explode")):
        text = found._jdf.queryExecution().executedPlan().toString()
        last = [line for line in text.splitlines() if "Join" in line][0]
        assert "SortMergeJoin" in last, (hinted, text)
    assert voxels.near_any(points, points, 2.0).count() == 1000


def test_work_on_few_bytes_is_dealt_to_all_cores(spark):
    from lodestone.queries import collating, tokens

    for rows in (tokens.ids(spark, "/root/testdata/sf0.001"), collating._smiles(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_merges_in_one_pass_over_the_words(spark, monkeypatch):
    r = random.Random(8)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(300)})
    pairs, pool = [], ["a", "b", "c"]
    while len(pairs) < 40:
        p = (r.choice(pool), r.choice(pool))
        if p not in pairs:
            pairs.append(p)
            pool.append(p[0] + p[1])
    # Later pairs first too, so that a pair can come up that is of lower rank than the one that made it.
    r.shuffle(pairs)

    def plain(out):
        while known := [pairs.index(p) for p in zip(out, out[1:], strict=False) if p in pairs]:
            (a, b), old, out = pairs[min(known)], out, []
            while old:
                n = 2 if tuple(old[:2]) == (a, b) else 1
                out, old = [*out, "".join(old[:n])], old[n:]
        return out

    want = {w: plain(list(w)) for w in words}
    frame = spark.createDataFrame([(w, list(w)) for w in words] + [("null", None)], "word string, symbols array<string>")
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "rank int, left string, right string")
    names, written = [], merges.written
    monkeypatch.setattr(merges, "written", lambda df, name: names.append(name) or written(df, name))
    for most in (1 << 19, 0):
        monkeypatch.setattr(merges, "BROADCAST_MERGES", most)
        assert {x.word: x.symbols for x in merges.merged(frame, table).collect()} == want | {"null": None}
        assert {x.word: x.symbols for x in merges.merged(frame, table.limit(0)).collect()} == {x.word: x.symbols for x in frame.collect()}
    # Nothing is written for a round of merges.
    assert set(names) == {"merges"}


def test_merges_of_a_long_word_take_the_work_of_its_symbols():
    pairs = [(a + b, c + d) for a in "abcd" for b in ("", "a") for c in "abcd" for d in ("", "b")]
    ranks = {p: i for i, p in enumerate(pairs)}
    long = random.Random(9).choices("abcd", k=300_000)
    begin = time.perf_counter()
    assert "".join(merges._joined(long, ranks)) == "".join(long)
    assert time.perf_counter() - begin < 30


def test_words_are_counted_before_they_are_shuffled(spark, tmp_path, monkeypatch):
    from lodestone.queries import molecules

    monkeypatch.setattr(molecules, "COUNTED", 3)
    texts = ["a b\ta c\n", None, "", " \x0b\x0c\r a\x1cb é é é ", "a b c d e f g a"]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(w for t in texts for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w)
    found = molecules._words(spark, str(tmp_path))
    assert {x.word: x.n for x in found.collect()} == want
    assert "Generate" not in plan(found)
    # Bytes of words, 0 and those over 127 included, as merges.
    words = spark.createDataFrame([("\x00\x00aé字\x00\x00", 30), ("aé", 19), ("é", 1)], "word string, n long")
    letters = merges.byte_letters()
    sums = Counter()
    for w, n in (("\x00\x00aé字\x00\x00", 30), ("aé", 19), ("é", 1)):
        x = [letters[b] for b in w.encode()]
        for level, (a, b) in enumerate([(1, 1), (2, 1), (2, 2)]):
            for i in range(len(x) - a - b + 1):
                sums[level, "".join(x[i : i + a]), "".join(x[i + a : i + a + b])] += n
    got = molecules._merge_table(words).collect()
    assert {(x.rank.level, x.left, x.right): -x.rank.n for x in got} == {k: n for k, n in sums.items() if n >= 20}
    assert all((x.rank.left, x.rank.right) == (x.left, x.right) for x in got)
