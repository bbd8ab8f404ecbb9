"""Rows that a function fails on."""

from pyspark.sql import functions as F

from lodestone.operators.rejects import _attempts, attempted, rejected_counts


def test_one_bad_row_in_a_thousand(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") == 617, "x").otherwise(F.col("id").cast("string")).alias("text")).repartition(3)
    good, bad = attempted(rows, lambda b: b["text"].map(int) * 2, "long", ["text"])
    assert {r.id: r.value for r in good.collect()} == {i: 2 * i for i in range(1000) if i != 617}
    assert [(r.id, r.reason) for r in bad.collect()] == [(617, "ValueError: invalid literal for int() with base 10: 'x'")]
    assert [tuple(r) for r in rejected_counts(bad).collect()] == [("ValueError", 1)]


def test_all_rows_bad_or_none(spark):
    rows = spark.range(20)
    good, bad = attempted(rows, lambda b: 1 / 0, "double")
    assert good.count() == 0 and bad.count() == 20 and rejected_counts(bad).first().kind == "ZeroDivisionError"
    good, bad = attempted(rows.limit(0), lambda b: b["id"] * 1.0, "double")
    assert good.count() == bad.count() == 0
    # Too few values are a failure of the rows.
    assert attempted(rows, lambda b: b["id"].iloc[:-1], "long")[1].count() == 20


def test_a_batch_with_many_bad_rows_goes_on_whole(spark):
    rows = spark.range(1000).repartition(1)
    parts = []
    for batch in _attempts(lambda b: [1 // (i % 10) for i in b["id"]], ["id"])(iter([rows.toPandas()])):
        parts.append(batch)
    assert len(parts) == 1 and len(parts[0]) == 1000
    good, bad = attempted(rows, lambda b: [(1 << 60) + 1 // (i % 10) for i in b["id"]], "long")
    assert {r.id: r.value for r in good.collect()} == {i: (1 << 60) + 1 // (i % 10) for i in range(1000) if i % 10}
    assert bad.count() == 100
