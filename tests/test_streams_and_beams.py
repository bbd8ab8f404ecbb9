"""Token streams and beam search against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import beams, streams_of_tokens


def plain_streams(sentences, streams, steps, look_back):
    line, held, before, out = iter(sentences), [[] for _ in range(streams)], [[] for _ in range(streams)], []
    while True:
        rows = []
        for i in range(streams):
            data, target = [], []
            while len(target) < steps:
                while len(held[i]) <= 1:
                    held[i] = next(line, None)
                    if held[i] is None:
                        return out
                n = min(len(held[i]) - 1, steps - len(target))
                data += held[i][:n]
                target += held[i][1 : n + 1]
                held[i] = held[i][n:]
            rows.append((before[i] + data, target))
        for i, (data, target) in enumerate(rows):
            out.append((len(out) // streams, i, data, target))
            before[i] = data[len(data) - min(len(data), look_back) :]


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_shuffled_streams(spark, seed):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", "b", "b", None]), i, None if i % 31 == 0 else [rng.randrange(1000) for _ in range(rng.choice([0, 1, 2, 5, 9, 70]))]) for i in range(300)]
    frame = spark.createDataFrame(rows, "file string, id long, tokens array<int>").repartition(5)
    key = {r.id: r.k for r in frame.select("id", F.xxhash64(F.lit(seed or 0), "id").alias("k")).collect()}
    got = {(r.part, r.batch, r.stream): (r.data, r.target) for r in streams_of_tokens.shuffled_streams(frame, 3, 8, 5, seed).collect()}
    want = {}
    for file in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == file and r[2]), key=lambda r: key[r[1]] if seed is not None else r[1])
        want |= {(file or "", n, i): (data, target) for n, i, data, target in plain_streams([r[2] for r in mine], 3, 8, 5)}
    assert got == want and len(want) > 100
    # A large file is several parts, none of a sentence twice.
    parts = streams_of_tokens.shuffled_streams(frame, 1, 1, 0, seed or 0, part_sentences=40).collect()
    assert len({r.part for r in parts if r.part.startswith("b")}) > 3
    assert len(parts) == sum(max(0, len(r[2]) - 1) for r in rows if r[2])


def plain_variable(length, sizes):
    out, start = [], 0
    for size in sizes:
        n = min(size, length - 1 - start)
        out.append((start, n))
        start += n
        if start >= length - 2:
            return out
    raise AssertionError("too few sizes")


@pytest.mark.parametrize("length", [2, 3, 4, 5, 36, 37, 200, 1234])
def test_variable_batches_follow_each_other(spark, length):
    drawn = streams_of_tokens.variable_batches(spark.range(1), 100000, 35, seed=length).orderBy("batch").collect()
    assert {r["size"] for r in drawn[:-1]} >= set(range(32, 38)) and all(5 <= r["size"] <= 50 for r in drawn[:-1])
    got = [(r["start"], r["size"]) for r in streams_of_tokens.variable_batches(spark.range(1), length, 35, seed=length).orderBy("batch").collect()]
    assert got == plain_variable(length, [r["size"] for r in drawn])


def test_fixed_batches_are_the_parallel_streams(spark):
    tokens = spark.range(1003).select(F.col("id").alias("nth"), (F.col("id") * 37 % 101).alias("token"))
    a = streams_of_tokens.parallel_streams(tokens, "nth", "token", 4, 9)
    b = streams_of_tokens.stream_batches(tokens, "nth", "token", 4, lambda t, n: streams_of_tokens.fixed_batches(t, n, 9))
    rows = lambda f: sorted((r.batch, r.stream, r.at, r.token, r.target) for r in f.collect())
    assert rows(a) == rows(b)


def plain_beams(start, score, n, max_length, eos, penalty, early, keep, vocabulary):
    live, hyps, done = [(list(start), 0.0)] + [(list(start), -1e9)] * (n - 1), [], False

    def add(tokens, total):
        s = total / len(tokens) ** penalty
        if len(hyps) < n or s > min(h[0] for h in hyps):
            hyps.append((s, tokens))
            if len(hyps) > n:
                worst = min(range(len(hyps)), key=lambda i: (hyps[i][0], i))
                del hyps[worst]

    while len(live[0][0]) < max_length and not done:
        found = sorted(((-(total + score(tokens, t)), b, t) for b, (tokens, total) in enumerate(live) for t in range(vocabulary)))[: 2 * n]
        after, length = [], len(live[0][0])
        for rank, (minus, b, t) in enumerate(found):
            if t == eos:
                if rank < n:
                    add(live[b][0], -minus)
            else:
                after.append((live[b][0] + [t], -minus))
            if len(after) == n:
                break
        live = after
        done = len(hyps) >= n and (early or min(h[0] for h in hyps) >= -found[0][0] / length**penalty)
    if not done:
        for tokens, total in live:
            add(tokens, total)
    best = sorted(hyps, key=lambda h: h[0])[::-1][:keep]
    return [(i, tokens + [eos] * (len(tokens) < max_length), s) for i, (s, tokens) in enumerate(best, 1)]


@pytest.mark.parametrize(("penalty", "early", "max_length"), [(1.0, False, 7), (0.7, False, 8), (2.0, True, 7), (0.0, False, 5)])
def test_beam_search(spark, penalty, early, max_length):
    rng = random.Random(int(penalty * 10) + max_length)
    table = {(a, t): math.log(rng.choice([0.05, 0.1, 0.3, 0.6])) + (rng.random() * 0.5 if t != 1 else 0.4) for a in range(8) for t in range(8)}
    like = lambda b, t: (b * 7 + t * 13) % 17 / 9
    starts = spark.createDataFrame([(b, [2 + b % 6, b % 5]) for b in range(40)], "batch long, tokens array<int>").repartition(3)
    scorer = beams.table_scorer(spark.createDataFrame([(a, t, s) for (a, t), s in table.items()], "last int, token int, score double"))
    found = beams.beam_search(starts, lambda x: scorer(x).withColumn("score", F.col("score") - (F.col("batch") * 7 + F.col("token") * 13) % 17 / 9), 3, max_length, 1, penalty, early, keep=2)
    got = {}
    for r in found.collect():
        got.setdefault(r.batch, []).append((r.place, r.tokens, r.score))
    ended = set()
    for b in range(40):
        want = plain_beams([2 + b % 6, b % 5], lambda tokens, t, b=b: table[tokens[-1], t] - like(b, t), 3, max_length, 1, penalty, early, 2, 8)
        mine = sorted(got[b])
        assert [(p, t) for p, t, _ in mine] == [(p, t) for p, t, _ in want]
        assert all(math.isclose(x[2], y[2], rel_tol=1e-12) for x, y in zip(mine, want, strict=True))
        ended |= {len(t) for _, t, _ in want}
    assert len(ended) > 1
    with pytest.raises(ValueError, match="two beams"):
        beams.beam_search(starts, scorer, 1, 5, 1)


def test_beam_search_of_nothing(spark):
    starts = spark.createDataFrame([], "batch long, tokens array<int>")
    assert beams.beam_search(starts, beams.table_scorer(spark.createDataFrame([(1, 1, 0.0)], "last int, token int, score double")), 2, 5, 1).count() == 0
