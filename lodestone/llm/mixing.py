"""Mixing sources to target weights by hierarchical budgeting.

The documents form a tree: domain, language, source.  A token budget goes down from the root by the
weights of a node's children.  No child gets more than its documents give in max_epochs passes; what
a child falls short of goes to its siblings by their weights, and only what all siblings can't take
is left to their ancestors' other children.  A leaf then takes its budget in seeded epochs: whole passes
over its documents, and of one more pass the documents within the first tokens of its order, which
is a hash of seed, epoch and doc_id.

The tree is a table for each level, so any number of leaves will do.  Among the children of a node,
sorted by limit over weight, those before a certain place are full and the others get one number times
their weight; the place is found by running sums over all children of a level, dealt out by range.

The prefix of a leaf's order is found over buckets of that order: buckets before the limit are taken
whole, and rows are ranked only in the one bucket that holds it, so a source with any share of the rows
is never in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.sequences import running
from .common import free_name, sized, written

ROWS_TOGETHER = 1000
LEVELS = ["domain", "lang", "source"]
#: Weights are rounded to whole parts of so many, so that their sums are exact in any order.
PARTS = 1_000_000


@dataclass(frozen=True)
class Mix:
    """weights[level][value]; a value that isn't named has weight 1.  Sources not in domains belong to other_domain."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    other_domain: str = "other"
    budget_share: float = 1.0
    max_epochs: int = 2
    seed: int = 17


def _weight(mix: Mix, level: str) -> Column:
    """The weight of a node of a level, from its key."""
    out = None
    for value, weight in mix.weights.get(level, {}).items():
        test, parts = F.col(level) == f"={value}", F.lit(round(weight * PARTS)).cast("bigint")
        out = F.when(test, parts) if out is None else out.when(test, parts)
    one = F.lit(PARTS).cast("bigint")
    return one if out is None else out.otherwise(one)


def shared_out(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """amount of each child (parent, key, amount of the parent, weight, limit): by weights, none above its
    limit; what one can't take goes to the others by their weights.  A child without weight gets nothing."""
    rows = children.where("weight > 0").withColumn("ratio", F.col("limit") / F.col("weight"))
    sums = running(rows, [*parent, "ratio", key], {"_limits": "limit", "_weights": "weight"})
    sums = sums.withColumn("_limits", F.col("_limits") - F.col("limit")).withColumn("_weights", F.col("_weights") - F.col("weight"))
    whole = sums.groupBy(*parent).agg(F.min("_limits").alias("_limits0"), F.min("_weights").alias("_weights0"), F.sum("limit").alias("_limit"), F.sum("weight").alias("_weight"))
    sums = sums.join(whole, parent) if parent else sums.crossJoin(F.broadcast(whole))  # one row
    # Before this child all are full; from it on each gets level times its weight, if it is the first for which that is no more than its limit.
    full, open_ = F.col("_limits") - F.col("_limits0"), F.col("_weight") - (F.col("_weights") - F.col("_weights0"))
    have = F.least(F.col("amount"), F.col("_limit"))
    level = F.when(have <= full + F.col("ratio") * open_, (have - full) / open_)
    sums = sums.withColumn("_level", level)
    found = sums.groupBy(*parent).agg(F.max("_level").alias("_top"))
    sums = sums.join(found, parent) if parent else sums.crossJoin(F.broadcast(found))  # one row
    return sums.select(*parent, key, F.coalesce(F.least(F.col("limit").cast("double"), F.col("_top") * F.col("weight")), F.col("limit").cast("double")).alias("amount"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """budget of each leaf (LEVELS, tokens); leaves whose node or an ancestor has no weight are left out."""
    tables, rows = [], leaves.select(*LEVELS, (F.col("tokens") * mix.max_epochs).alias("limit"))
    for depth in (3, 2, 1):
        rows = written(rows.withColumn("weight", _weight(mix, LEVELS[depth - 1])), "mix-level")
        tables.append(rows)
        # A child without weight takes nothing, so its parent can't count on it.
        rows = rows.groupBy(*LEVELS[: depth - 1]).agg(F.sum(F.when(F.col("weight") > 0, F.col("limit")).otherwise(0)).alias("limit"))
    budget = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(mix.budget_share)).alias("amount"))
    for depth, children in enumerate(reversed(tables)):
        parent = LEVELS[:depth]
        given = children.crossJoin(F.broadcast(budget)) if not parent else children.join(budget, parent)  # the root: one row
        budget = written(shared_out(given, parent, LEVELS[depth]), "mix-budgets")
    return budget.select(*LEVELS, F.floor(F.col("amount") + 1e-6).cast("bigint").alias("budget"))


def words(text: Column) -> Column:
    """The tokens that budgets count: runs of other than white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def _key(value: Column) -> Column:
    """A key of its own for null, one for each text."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def mixed(docs: DataFrame, mix: Mix, tokens: Column | None = None) -> DataFrame:
    """The chosen rows of docs (doc_id, text, lang, source and any others) and their epoch, from 0.

    Null languages and sources are leaves of their own, apart from empty ones; null texts have no token, and
    go with every pass that their place in the order falls into, as empty ones do.  Repeated rows stand next to
    each other in the order and are counted each; ties in the hash go by doc_id and text.  In an empty table,
    or with a budget of nothing, nothing is chosen.  A column named epoch in docs is replaced, all others may
    have any names.
    """
    count = tokens if tokens is not None else words(F.col("text"))
    domains = F.create_map(*[F.lit(x) for pair in mix.domains.items() for x in pair]) if mix.domains else None
    domain = F.coalesce(domains[F.col("source")], F.lit(mix.other_domain)) if mix.domains else F.lit(mix.other_domain)
    docs = docs.drop("epoch")
    own = [F.col(f"`{c}`") for c in docs.columns]
    leaf, plan, place, sums_of, of_leaf, of_bucket = (free_name(docs.columns, x) for x in ("_leaf", "_plan", "_place", "_sums", "_of_leaf", "_of_bucket"))
    rows = docs.withColumn(leaf, F.struct(_key(domain).alias("domain"), _key(F.col("lang")).alias("lang"), _key(F.col("source")).alias("source")))
    light = written(rows.select("doc_id", F.col(leaf).alias("leaf"), count.alias("tokens")), "mix-light")
    leaves = written(light.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).select("leaf.*", "tokens", "rows"), "mix-leaves")
    budgets = leaves.join(leaf_budgets(leaves, mix), LEVELS).where("tokens > 0")
    whole = F.least(F.lit(mix.max_epochs), F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    budgets = budgets.withColumn("whole", whole).select(F.struct(*LEVELS).alias(of_leaf), F.struct("whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest"), F.ceil(F.col("rows") / ROWS_TOGETHER).alias("buckets")).alias("plan"))
    budgets = written(budgets, "mix-plan")
    n_leaves = budgets.count()

    def dealt(frame: DataFrame, leaf: str, plan: str, place: str) -> DataFrame:
        """frame with the leaf's plan, and in place the hash that orders it in its last epoch and its bucket."""
        out = frame.join(sized(budgets.withColumnRenamed("plan", plan), n_leaves, 256), F.col(leaf) == F.col(of_leaf)).drop(of_leaf)
        order = F.xxhash64(F.lit(mix.seed), F.col(plan)["whole"], F.col("doc_id"))
        bucket = F.least(F.col(plan)["buckets"] - 1, F.floor((order.cast("double") / 2.0**64 + 0.5) * F.col(plan)["buckets"]).cast("bigint"))
        return out.withColumn(place, F.struct(order.alias("order"), bucket.alias("bucket")))

    before = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt(light, "leaf", "plan", "place").where("plan.rest > 0").groupBy("leaf", F.col("place.bucket").alias("bucket")).agg(F.sum("tokens").alias("held"), F.first("plan.rest").alias("rest"))
    sums = sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).where("base <= rest")
    sums = written(sums.select(F.struct("leaf", "bucket").alias(of_bucket), F.struct("base", (F.col("base") + F.col("held") > F.col("rest")).alias("last")).alias(sums_of)), "mix-buckets")

    placed = dealt(rows, leaf, plan, place)
    passes = placed.where(F.col(plan)["whole"] > 0).select(*own, F.explode(F.sequence(F.lit(0), F.col(plan)["whole"] - 1)).alias("epoch"))
    at = F.struct(F.col(leaf).alias("leaf"), F.col(place)["bucket"].alias("bucket"))
    partial = placed.where(F.col(plan)["rest"] > 0).join(sized(sums, sums.count(), 256), at == F.col(of_bucket))
    taken = partial.where(~F.col(sums_of)["last"]).select(*own, F.col(plan)["whole"].alias("epoch"))
    upto = Window.partitionBy(of_bucket).orderBy(F.col(place)["order"], "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col(sums_of)["base"] + F.sum(count).over(upto)
    last = partial.where(F.col(sums_of)["last"]).withColumn(place, end).where(F.col(place) <= F.col(plan)["rest"]).select(*own, F.col(plan)["whole"].alias("epoch"))
    return passes.union(taken).union(last)
