"""Conversation state: long conversations, turns out of order, expiry."""

from pyspark.sql import functions as F

from lodestone.streaming import streams


def drained(spark, tmp_path, files, **options):
    path = tmp_path / "in"
    path.mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(str(path / f"{i}"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    return streams.drained(streams.conversation_state(stream, **options), str(tmp_path / "out"), str(tmp_path / "state"), empty_batches=False).collect()


def test_whole_turns_that_fit_are_kept(spark, tmp_path):
    files = [[(1, 3, "u", "ccc"), (1, 1, "u", "aaa"), (2, 1, "u", "x" * 50)], [(1, 2, "a", None), (1, 4, None, "dd"), (3, None, None, None)]]
    last = {}
    for r in drained(spark, tmp_path, files, keep=16):
        if r.conv_id not in last or r.n_turns > last[r.conv_id].n_turns:
            last[r.conv_id] = r
    assert (last[1].n_turns, last[1].first_turn, last[1].last_turn, last[1].history) == (4, 2, 4, "a: \nu: ccc\n: dd\n")
    assert last[2].history == "u: " + "x" * 50 + "\n" and last[3].history == ": \n"


def test_output_of_a_long_conversation_is_bounded(spark, tmp_path):
    n = 100_000
    path = str(tmp_path / "in")
    spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("word " * 10).alias("text")).repartition(4).write.parquet(path)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(path)
    rows = streams.drained(streams.conversation_state(stream, 2000), str(tmp_path / "out"), str(tmp_path / "state"), empty_batches=False).collect()
    assert len(rows) == 1 and rows[0].n_turns == n and rows[0].last_turn == n - 1 and len(rows[0].history) <= 2000 < len(rows[0].history) + 54


def test_silent_conversations_are_forgotten(spark, tmp_path):
    files = [[(1, 1, "u", "a")], [(2, 1, "u", "b")], [(2, 2, "u", "c")], [(1, 2, "u", "d")]]
    rows = drained(spark, tmp_path, files, idle_ms=1)
    assert sorted(r.n_turns for r in rows if r.conv_id == 1) == [1, 1]
    (tmp_path / "b").mkdir()
    kept = drained(spark, tmp_path / "b", files, idle_ms=None)
    assert sorted(r.n_turns for r in kept if r.conv_id == 1) == [1, 2]
