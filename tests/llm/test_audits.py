"""Language identification, source divergence and filter interaction against plain versions."""

import glob
import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, interaction, langid, quality

SF = "/root/testdata/sf0.001"


def rows_of_sql(sql, sf=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], Counter(found.fetchall())


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_filter_interaction"])
def test_rows_of_the_sql(spark, name):
    from lodestone.llm.queries import ORACLE_SQL, QUERIES

    columns, want = rows_of_sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns) and Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


# Filter interaction


def failing(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
    return set(out + "D" * bool(re.search("[#$%&*|]", text)))


def interactions(docs, labels):
    least, marks, parts = {}, defaultdict(lambda: [0, 0]), defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, good, toxic in labels:
        marks[i] = [max(marks[i][0], int(good == 1)), max(marks[i][1], int(toxic == 1))]
    for i, t, lang in docs:
        fails = failing(t or "") | ({"E"} if i is not None and i > least[t or ""] else set())
        parts[lang or ""].append((fails, *(marks[i] if i is not None and i in marks else (0, 0))))
    out, shares = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                out[part, "".join(order), step] = (len(left), len(gone), sum(x in r[0] for r in rows) - len(gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                shares[part, x] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_interactions(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrnKL") for _ in range(rng.randint(1, 6)))
    texts = [None, "", " \t\x0b", "X", "é" * 20, "# a", "a " * 70000, "\x1f\x1c a"] + [" ".join(word() for _ in range(rng.choice([5, 150, 220, 400]))) for _ in range(40)]
    texts += [t.lower() for t in texts[8:30] if t] + texts[20:40] + texts[:4] + ["lower " * 199 + "case", "a b " * 100 + "c"]
    docs = [(rng.randrange(500) if i % 17 else None, t, rng.choice(["en", "de", None, "", "x"]), 1, 2) for i, t in enumerate(texts)]
    docs += [docs[30], docs[30]]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1, None]), 5) for d in docs[::2]] + [(None, 1, 1, 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int, part int").repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, digest int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in interaction.audit(frame, marked).collect()}
    assert got == interactions([d[:3] for d in docs], [x[:3] for x in labels])
    assert interaction.audit(frame.limit(0), marked).count() == 0
    assert interaction.audit(frame, marked.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_interactions_of_other_filters(spark):
    """Three filters; every state is persisted once, and given up."""
    rows = spark.createDataFrame([("p", 0, 0, 0), ("p", 3, 1, 0), ("p", 7, 0, 1), ("q", 2, 1, 1)], "part string, mask int, good int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in interaction.filter_interactions(rows, ["x", "y", "z"]).collect()}
    assert len(got) == 2 * math.factorial(3) * 3
    assert got["p", "xyz", 1] == (2 - 1, 2, 0) and got["p", "xyz", 2] == (1, 0, 2) and got["p", "zyx", 1] == (2, 1, 0) and got["q", "yxz", 1] == (0, 1, 0)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0 or not rows.is_cached


# Source divergence


def divergences(docs, min_docs):
    terms = [(i, lang or "", source or "", t) for i, (text, lang, source) in enumerate(docs) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    held = defaultdict(set)
    for i, lang, _, t in terms:
        held[lang, t].add(i)
    groups, out = {(d[1] or "", d[2] or "") for d in docs}, set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (x, t), ids in held.items() if x == lang and len(ids) >= min_docs), key=lambda t: t.encode())
        v, sources = len(kept), sorted(s for x, s in groups if x == lang)
        n = Counter((s, t) for _, x, s, t in terms if x == lang and t in set(kept))
        total = Counter()
        for (s, _), c in n.items():
            total[s] += c
        whole = sum(total.values())
        p = {(s, t): 1 + 10**9 * (n[s, t] + 2) // (total[s] + 2 * v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(n[s, t] for s in sources) + 2) // (whole + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s, t], p[o, t]) for t in kept), o.encode(), o) for o in sources if o != s)
            best = sorted((-f(p[s, t], q[t]), t.encode(), t) for t in kept if n[s, t] and p[s, t] > q[t])[:10]
            out |= {(lang, s, part, item, -value, rank) for part, found in (("pair", pairs), ("term", best)) for rank, (value, _, item) in enumerate(found, 1)}
    return out


def test_source_divergence(spark):
    rng = random.Random(9)
    vocabulary = ["the", "THE", "été", "ÉTÉ", "ﬂow", "a_b", "don't", "x1y", "字", "ab" * 3000] + ["".join(rng.choice("abcdeé") for _ in range(2)) for _ in range(30)]
    docs = [(None, "en", "s1"), ("", None, None), ("@[`{\x7f 12", "fr", "s1"), ("", "fr", "s2"), ("rare words only", "de", "s1"), ("the " * 40000, "en", "s3")]
    docs += [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))), rng.choice(["en", "es", None, ""]), rng.choice(["s1", "s2", "s3", None, "é", "Z"])) for _ in range(90)]
    docs += docs[20:24]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n int, term string").repartition(4)
    got = [tuple(r) for r in divergence.source_divergence(frame, 4).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == divergences(docs, 4)
    assert divergence.source_divergence(frame.limit(0)).count() == 0


def test_terms_go_on_when_many_are_held(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CHUNK", 200)
    rng = random.Random(2)
    texts = [" ".join(f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(40))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 60), pa.array([f"s{i % 3}" for i in range(60)]), pa.array(texts)], ["lang", "source", "text"])
    got, docs = Counter(), Counter()
    for out in divergence._counted(iter([batch])):
        for r in out.to_pylist():
            got[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert got == Counter((f"s{i % 3}", t) for i, x in enumerate(texts) for t in x.split())
    assert docs == Counter((f"s{i % 3}", t) for i, x in enumerate(texts) for t in set(x.split()))


# Language identification


def plain_path(scores, prior, switch):
    v, back = np.array(prior, float), []
    for e in scores:
        best, at = v.max() - switch, int(v.argmax())
        back.append([at if x < best else i for i, x in enumerate(v)])
        v = np.maximum(v, best) + e
    out = [int(v.argmax())]
    for b in back[:0:-1]:
        out.append(b[out[-1]])
    return out[::-1]


def test_paths_are_viterbi_paths(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    lengths = np.array([0, 1, 6, 7, 8, 40, 0, 15, 100, 3])
    scores = (rng.integers(-60, 1, (lengths.sum(), 3)) / 8).astype(np.float32) + rng.normal(0, 1e-3, (lengths.sum(), 3)).astype(np.float32)
    prior = np.log([0.5, 0.3, 0.2])
    monkeypatch.setattr(langid, "SWITCH", 5.0)
    want, at = [], 0
    for n in lengths:
        want += plain_path(scores[at : at + n], prior, 5.0) if n else []
        at += n
    assert langid.paths(scores, lengths, prior).tolist() == want and len(set(want)) == 3


def test_words_and_scripts():
    texts = ["Hello, wörld!", "", "Привет abc字字", "été ́x", "a" * 60, "12 ..."]
    words = langid.cut_words(*langid._points(texts))
    names = list(langid.SCRIPTS)
    found = [(int(o), int(b), int(n), names[s]) for o, b, n, s in zip(words.owner, words.begins, words.lengths, words.script, strict=True)]
    ends = np.cumsum([0] + [len(t) for t in texts])
    text = "".join(texts)
    assert [(o, text[b : b + n], s) for o, b, n, s in found] == [
        (0, "Hello", "Latin"), (0, "wörld", "Latin"), (2, "Привет", "Cyrillic"), (2, "abc", "Latin"), (2, "字字", "Han"),
        (3, "été", "Latin"), (3, "x", "Latin"), (4, "a" * 24, "Latin"), (4, "a" * 24, "Latin"), (4, "a" * 12, "Latin"),
    ]
    assert all(ends[o] <= b < ends[o + 1] for o, b, _, _ in found)


def test_languages_are_learned_and_spans_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    assert model.langs == ["de", "en", "es", "fr"]
    held = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].lang_pred == lang for i, lang in held.items()]) > 0.98
    # A text of two languages has a span of each.
    by = {lang: docs.where(f"lang = '{lang}' and length(text) > 2000").orderBy("doc_id").first().text for lang in ("fr", "en")}
    en, fr = re.sub(r"\W+", " ", by["en"])[:900], re.sub(r"\W+", " ", by["fr"])[:500]
    rows = [(1, f"{en} {fr}", "x"), (2, None, "x"), (3, "", "x"), (3, "12 !", "x"), (None, fr, "x"), (4, "字字字", "x"), (5, "字", "x")]
    out = langid.label(spark.createDataFrame(rows, "doc_id long, text string, spans string"), model).collect()
    first = next(r for r in out if r.doc_id == 1)
    assert first.lang_pred == "en" and [s.lang for s in first.spans] == ["en", "fr"] and abs(first.spans[1].begin - len(en)) < 40 and first.spans[1].end <= len(rows[0][1])
    assert [(r.lang_pred, r.score, r.spans) for r in out if r.doc_id in (2, 3)] == [("und", 0, [])] * 3
    assert [r.lang_pred for r in out if r.doc_id is None] == ["fr"] and all(r.lang_pred in model.langs for r in out if r.doc_id in (4, 5))


def test_scripts_narrow_the_languages(spark):
    ru, en = "это мой дом и твой сад ", "this is my house and your garden "
    rows = [(i, (ru if i % 2 else en) * 3, "ru" if i % 2 else "en") for i in range(40)] + [(90, "x", None), (91, "...", "zz"), (92, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.langs == ["en", "ru"] and model.scripts[:3].tolist() == [[True, False], [False, False], [False, True]]
    out = langid.label(spark.createDataFrame([(1, ru + "garden сад " + "ЖЖЖ " * 9), (2, en * 4 + ru * 4)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert out[0].lang_pred == "ru" and [s.lang for s in out[1].spans] == ["en", "ru"]
    none = langid.identify(docs.where("lang is null or lang in ('zz', 'yy')"))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and langid.identify(docs.limit(0)).count() == 0


def test_long_texts_are_labelled_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    text = " ".join(r.text or "" for r in docs.select("text").limit(80).collect())
    whole = langid.label_texts(model, [text])
    monkeypatch.setattr(langid, "_CHUNK", 1 << 13)
    assert len(text) > 1 << 15
    parts = langid.label_texts(model, [text])
    for name in ("span_begin", "span_end", "span_lang", "letters"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name


# Quality of very long texts


def random_model(rng):
    e, a, draw = quality.ENCODED, quality.ATTENTION, lambda *shape: rng.normal(size=shape)
    return quality.AttentionModel(draw(quality.FEATURES), np.abs(draw(quality.FEATURES)) + 0.5, {"E": draw(quality.FEATURES, e) * 0.2, "e": draw(e), "V": draw(e, a), "U": draw(e, a), "w": draw(a), "c": draw(e), "b": draw(1)})


def test_quality_of_long_texts_is_that_of_all_passages(monkeypatch):
    rng = np.random.default_rng(3)
    model, pick = random_model(rng), random.Random(5)
    lines = lambda n: "\n".join("ab C1é,"[: pick.randrange(8)] * pick.randrange(200) for _ in range(n))
    texts = ["", None, "short", lines(300), "x" * 9000, "\n" * 3000, lines(40) + "\n", "a\n" * 500, lines(2)]
    want = np.concatenate([model.forward(x, first)["p"] for x, first in quality.encode_passages(pa.array(texts))])
    assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-12)
    monkeypatch.setattr(quality, "_CHUNK", 2048)
    monkeypatch.setattr(quality, "_SLICE", 16)
    assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-9)
    assert np.allclose([model.scores(pa.array([t]))[0] for t in texts], want, atol=1e-9)


def test_quality_of_line_feeds_in_bounded_memory():
    """6 MB of empty lines in one text, in a process of its own."""
    code = """
import resource, numpy as np, pyarrow as pa
from lodestone.llm import quality
e, a, rng = quality.ENCODED, quality.ATTENTION, np.random.default_rng(1)
draw = lambda *s: rng.normal(size=s)
model = quality.AttentionModel(draw(quality.FEATURES), np.ones(quality.FEATURES), {"E": draw(quality.FEATURES, e), "e": draw(e), "V": draw(e, a), "U": draw(e, a), "w": draw(a), "c": draw(e), "b": draw(1)})
texts = pa.array(["\\n" * (6 << 20)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.scores(texts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, env={**os.environ, "OMP_NUM_THREADS": "1"})
    assert int(out.stdout) < 300


def test_the_training_sample_is_bounded_by_passages(spark, monkeypatch):
    rows = [(i, "\n" * 20000 if i % 3 == 0 else f"word {i} " * 30, i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    usable = frame.select(F.col("doc_id").alias("labelled"), F.col("quality").alias("label"))
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1 << 20)
    kept = quality._sample(frame, usable).collect()
    assert len(kept) == 40 and all(r.text[0] == "w" for r in kept)
