"""Reading, collating and feature operators against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import collating, reading, statistics, text, vectors
from lodestone.operators import answers, masking, sequences, subwords
from lodestone.sources import text as lines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values):
    return F.array(*map(F.lit, values)).cast("array<int>")


def plain_truncation(a, b, remove, stride):
    a, b, over = list(a), list(b), []
    for _ in range(max(0, remove)):
        side = a if len(a) > len(b) else b
        take = min(len(side), stride + 1) if not over else 1
        over += side[-take:]
        side.pop()
    return a, b, over


@pytest.mark.parametrize("n, m, remove, stride", [(9, 4, 3, 0), (9, 4, 8, 2), (3, 8, 7, 1), (5, 5, 4, 3), (6, 5, 0, 2), (2, 1, 3, 5)])
def test_truncation_with_overflow(spark, n, m, remove, stride):
    a, b = list(range(1, n + 1)), list(range(101, m + 101))
    got = one(spark, reading.truncated(array(a), array(b), F.lit(remove), "longest_first", stride))
    assert (got["a"], got["b"], got["overflow"]) == plain_truncation(a, b, remove, stride)
    got = one(spark, reading.truncated(array(a), array(b), F.lit(remove), "only_first", stride))
    fits = 0 < remove < n
    assert got["a"] == (a[:-remove] if fits else a) and got["overflow"] == (a[-min(n, remove + stride) :] if fits else []) and got["b"] == b
    with pytest.raises(ValueError):
        reading.truncated(array(a), array(b), F.lit(1), "both")


def test_padding(spark):
    got = one(spark, reading.padded(array([5, 6]), F.lit(3), 9, left=True, multiple=4))
    assert (got["input_ids"], got["attention_mask"], got["special_tokens_mask"]) == ([9, 9, 5, 6], [0, 0, 1, 1], [1, 1, 0, 0])
    assert one(spark, reading.padded(array([5, 6]), F.lit(1)))["input_ids"] == [5, 6]


def test_final_text_and_spans(spark):
    # The known example: the answer without what the tokeniser has split off.
    assert one(spark, reading.final_text(F.lit("steve smith"), F.lit("Steve Smith's"))) == "Steve Smith"
    assert one(spark, reading.final_text(F.lit("not there"), F.lit("Steve Smith"))) == "Steve Smith"
    span = one(spark, reading.improved_span(F.split(F.lit("the ( 1895 - 1943 ) ."), " "), F.lit(1), F.lit(5), F.lit("1895")))
    assert (span["first"], span["last"]) == (2, 2)
    assert one(spark, reading.word_at(F.lit("  ab c"), F.lit(0))) == -1 and one(spark, reading.word_at(F.lit("  ab c"), F.lit(5))) == 1
    got = one(spark, reading.span_to_answer(F.lit("My name is Sarah Lee"), array([1, 1, 1, 2, 1]), F.lit(3), F.lit(5)))
    assert (got["answer"], got["start"], got["end"]) == ("Sarah Lee", 11, 20)


def test_n_best_answers(spark):
    found = spark.createDataFrame([(1, 0, 2, 3, "a", 5.0), (1, 1, 2, 3, "a", 4.0), (1, 0, 1, 1, "b", 3.0), (1, 0, 4, 4, "c", 2.0)], "k int, feature int, start_at int, end_at int, text string, score double")
    examples = spark.createDataFrame([(1, 1.0), (2, 7.0)], "k int, null_score double")
    got = answers.n_best_answers(found, examples, "k", 2)
    rows = sorted((r.k, r.place, r.text, r.score) for r in got.collect())
    assert rows == [(1, 1, "a", 5.0), (1, 2, "b", 3.0), (1, 3, "", 1.0), (2, 1, "empty", 0.0), (2, 2, "", 7.0)]
    assert abs(sum(r.probability for r in got.where("k = 1").collect()) - 1) < 1e-12
    said = {r.k: (r.text, r.score_diff) for r in answers.predictions(got, examples, "k").collect()}
    assert said == {1: ("a", -4.0), 2: ("", 7.0)}


def plain_pieces(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if ("##" if at else "") + word[at : at + n] in vocabulary), 0)
        if not size:
            return ["[UNK]"]
        out.append(("##" if at else "") + word[at : at + size])
        at += size
    return out


def test_word_pieces(spark):
    rng = random.Random(4)
    vocabulary = {"a", "##b", "##ab", "un", "##aff", "##able", "##a"} | {"".join(rng.choice("ab") for _ in range(3)) for _ in range(4)}
    words = sorted({"unaffable", "a" * 101, "x"} | {"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(60)})
    got = subwords.word_pieces(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(v,) for v in vocabulary], "token string"))
    assert {r.word: r.pieces for r in got.collect()} == {w: plain_pieces(w, vocabulary) if len(w) <= 100 else ["[UNK]"] for w in words}


def test_whole_words_keep_the_budget(spark):
    tokens = ["[CLS]", *["a", "##b", "##c", "d", "e", "##f"] * 6, "[SEP]"]
    rows = spark.createDataFrame([(i, tokens) for i in range(30)], "k long, t array<string>")
    found = {}
    for r in masking.whole_words(rows, "k", "t").collect():
        found.setdefault(r.k, set()).add(r.pos)
    words = [(1 + 6 * i + j, n) for i in range(6) for j, n in ((0, 3), (3, 1), (4, 2))]
    for places in found.values():
        assert len(places) == 6 and all(set(range(p, p + n)) <= places or not set(range(p, p + n)) & places for p, n in words)
    assert len(found) == 30 and len({tuple(sorted(v)) for v in found.values()}) > 1


def test_chunks_cover_a_document(spark):
    sizes = [5, 20, 3, 30, 8, 1, 9, 40, 2]
    sums = collating.running_sums(array(sizes))
    got = one(spark, collating.chunks(sums, F.lit(25), F.lit(3)))
    assert [(c["first"], c["past"]) for c in got] == [(0, 2), (2, 4), (4, 8), (8, 9)]
    assert all(c["first"] < c["split"] < c["past"] or c["past"] - c["first"] == 1 == c["split"] - c["first"] for c in got)
    back = one(spark, collating.chunks(sums, F.lit(25), F.lit(3), put_back=1.0))
    assert back[0]["first"] == 0 and all(a["split"] == b["first"] and a["random"] for a, b in zip(back, back[1:]))
    assert one(spark, collating.chunks(collating.running_sums(array([])), F.lit(25), F.lit(3))) == []


def test_error_function_and_distributions(spark):
    for x in (-6.0, -3.1, -2.9, -0.3, 0.0, 1e-9, 1.0, 2.999, 3.0, 5.0):
        assert abs(one(spark, vectors.erf(F.lit(x))) - math.erf(x)) < 1e-12
    assert abs(one(spark, statistics.cdf_normalised(F.lit(3.0), "norm", [1.0, 2.0], -9, 9)) - 0.8413447460685429) < 1e-10
    assert one(spark, statistics.cdf_normalised(F.lit(30.0), "uniform", [0.0, 10.0], 0, 5)) == 0.5
    with pytest.raises(ValueError):
        statistics.cdf("none", F.lit(1.0), [0.0, 1.0])


def test_lines_of_several_blocks(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(want) + "\n")
    (tmp_path / "b.txt").write_text("\n\nend")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = {}
        for r in lines.ordered_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.path[-5:], {})[r.at] = r.value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["a.txt"] == dict(enumerate(want)) and got["b.txt"] == {0: "", 1: "", 2: "end"}


def test_text_of_other_scripts(spark):
    assert one(spark, text.basic_tokens(F.lit("Café «Où» — Ёлка…\x00 中文 5$"))) == ["cafe", "«", "ou", "»", "—", "елка", "…", "中", "文", "5", "$"]
    assert one(spark, text.html_entities(F.lit("&eacute;&#233;&#xE9; &amp;lt; &unknown; &#0; &#x1F600;"))) == "ééé &lt; &unknown; &#0; 😀"
    assert one(spark, text.html_entities(F.lit("a\x01b &amp; c&lt;\x01"))) == "a\x01b & c<\x01" and one(spark, text.html_entities(F.lit(""))) == ""
    assert one(spark, text.remove_handles(F.lit("hi @short, x@no @" + "a" * 25))) == "hi  , x@no  " + "a" * 5


def test_valid_batches_come_again(spark):
    rows = spark.createDataFrame([(i, i % 3 > 0) for i in range(9)], "k int, valid boolean")
    got = sequences.valid_batches(rows, ["k"], "valid", 4, 3).orderBy("batch", "at").collect()
    assert [r.k for r in got] == [1, 2, 4, 5, 7, 8] * 2
    assert sequences.valid_batches(rows.where("not valid"), ["k"], "valid", 4, 3).count() == 0
