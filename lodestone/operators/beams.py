"""Beam search over many steps: live beams, ended hypotheses and batches that are done, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import written

_TOKENS = "array<int>"
_BEAM = f"struct<tokens: {_TOKENS}, score: double>"


def _added(hyps: str, tokens: str, total: str, beams: int, penalty: float) -> str:
    """hyps with one more, if there is room or it is better than the worst, which goes then (the earliest of equal ones)."""
    score = f"({total}) / pow(size({tokens}), {penalty}D)"
    scores = f"transform({hyps}, h -> h.score)"
    longer = f"concat({hyps}, array(named_struct('tokens', {tokens}, 'score', {score})))"
    without = f"transform(array({longer}), more -> filter(more, (h, i) -> i + 1 <> array_position(transform(more, x -> x.score), array_min(transform(more, x -> x.score)))))[0]"
    return f"CASE WHEN size({hyps}) < {beams} THEN {longer} WHEN {score} > array_min({scores}) THEN {without} ELSE {hyps} END"


def _taken(beams: int, eos: int, penalty: float) -> str:
    """The hypotheses and next beams after the candidates c, best first: an end among the first beams of them is a
    hypothesis, others go on until all beams are taken."""
    tokens = "beams[c.beam].tokens"
    ended = f"named_struct('hyps', {_added('s.hyps', tokens, 'c.score', beams, penalty)}, 'next', s.next, 'rank', s.rank + 1)"
    on = f"named_struct('hyps', s.hyps, 'next', concat(s.next, array(named_struct('tokens', concat({tokens}, array(c.token)), 'score', c.score))), 'rank', s.rank + 1)"
    passed = "named_struct('hyps', s.hyps, 'next', s.next, 'rank', s.rank + 1)"
    start = f"named_struct('hyps', hyps, 'next', CAST(array() AS array<{_BEAM}>), 'rank', 0)"
    return f"aggregate(found, {start}, (s, c) -> CASE WHEN size(s.next) = {beams} THEN s WHEN c.token = {eos} AND s.rank >= {beams} THEN {passed} WHEN c.token = {eos} THEN {ended} ELSE {on} END)"


def beam_search(
    starts: DataFrame, scorer: Callable[[DataFrame], DataFrame], beams: int, max_length: int, eos: int, length_penalty: float = 1.0, early_stopping: bool = False, keep: int = 1
) -> DataFrame:
    """(batch, place, tokens, score): the keep best hypotheses of each batch, place from 1; score is the sum of the logarithms
    over length ** length_penalty.

    starts has batch and tokens (all of one length); scorer gives candidates (batch, beam, token, score: a logarithm) for
    beams (batch, beam, tokens).  Of the 2 * beams best candidates of a batch (ties: the smaller beam, then the smaller token)
    those with eos end, if among the first beams; a batch is done when it has so many hypotheses and, unless
    early_stopping, no beam can be better than the worst of them.  At max_length the open beams are hypotheses too.  eos is
    put behind a hypothesis that is shorter.

    A step reads the open batches only, and writes them; batches that are done leave.  Each batch is a row with its
    beams and hypotheses (at most so many of each), so a step shuffles the candidates once, by batch.
    """
    if beams < 2:
        raise ValueError("a beam search needs two beams or more")
    first = starts.select("batch", "tokens", F.size("tokens").alias("n")).first()
    length = first["n"] if first else max_length
    others = F.array_repeat(F.struct("tokens", F.lit(-1e9).alias("score")), beams - 1)
    state = starts.select("batch", F.concat(F.array(F.struct(F.col("tokens").cast(_TOKENS).alias("tokens"), F.lit(0.0).alias("score"))), others.cast(f"array<{_BEAM}>")).alias("beams"), F.array().cast(f"array<{_BEAM}>").alias("hyps"))
    done = None
    open_ = written(state, "beams")
    while length < max_length and not open_.isEmpty():
        live = open_.select("batch", F.posexplode("beams").alias("beam", "b")).select("batch", "beam", "b.tokens", F.col("b.score").alias("total"))
        scored = scorer(live.select("batch", "beam", "tokens")).select("batch", "beam", F.col("token").cast("int").alias("token"), F.col("score").cast("double").alias("score"))
        # What is live is many times its file, which Spark would judge a broadcast by.
        scored = scored.join(live.select("batch", "beam", "total").hint("merge"), ["batch", "beam"]).select("batch", "beam", "token", (F.col("total") + F.col("score")).alias("score"))
        order = Window.partitionBy("batch").orderBy(F.desc("score"), "beam", "token")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * beams)
        found = best.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("rank", "beam", "token", "score"))).alias("found"))
        taken = open_.join(found, "batch", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<rank: int, beam: int, token: int, score: double>>")))
        taken = taken.select("batch", "found", F.expr(_taken(beams, eos, length_penalty)).alias("s")).select("batch", F.col("s.next").alias("beams"), F.col("s.hyps").alias("hyps"), F.get("found", F.lit(0))["score"].alias("top"))
        enough = F.size("hyps") >= beams
        closed = enough if early_stopping else enough & (F.array_min(F.transform("hyps", lambda h: h["score"])) >= F.col("top") / float(length) ** length_penalty)
        # Without a candidate, nothing goes on.
        after = written(taken.select("batch", "beams", "hyps", F.coalesce(closed, F.lit(True)).alias("done")), "beams")
        ended = after.where("done").select("batch", "hyps")
        done = ended if done is None else done.union(ended)
        open_ = after.where("not done").select("batch", "beams", "hyps")
        length += 1
    rest = open_.select("batch", F.expr(f"aggregate(beams, hyps, (hs, b) -> {_added('hs', 'b.tokens', 'b.score', beams, length_penalty)})").alias("hyps"))
    every = rest if done is None else done.union(rest)
    return _best(every, keep, max_length, eos)


def _best(rows: DataFrame, keep: int, max_length: int, eos: int) -> DataFrame:
    """The best first; of equal ones, the one that came last."""
    ranked: Column = F.array_sort(F.transform("hyps", lambda h, i: F.struct((-h["score"]).alias("minus"), (-i).alias("late"), h["tokens"].alias("tokens"), h["score"].alias("score"))))
    each = rows.select("batch", F.posexplode(F.slice(ranked, 1, keep)).alias("place", "h"))
    ended = F.when(F.size("h.tokens") < max_length, F.concat("h.tokens", F.array(F.lit(eos)))).otherwise(F.col("h.tokens"))
    return each.select("batch", (F.col("place") + 1).alias("place"), ended.alias("tokens"), "h.score")


def table_scorer(scores: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Candidates from a table (last, token, score) by a beam's last token."""

    def scorer(beams: DataFrame) -> DataFrame:
        return beams.withColumn("last", F.element_at("tokens", -1)).join(scores, "last").select("batch", "beam", "token", "score")

    return scorer
