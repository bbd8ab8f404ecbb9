"""N-gram Jaccard self-join with a token-group matrix.

Texts become sets of five-word shingles (see ``shingles``).  Two texts link when
``100 * |A & B| >= 80 * |A | B|``.  The result says for each document which texts it can reach by
links, which needs no pair twice and never all pairs of a group of copies:

1. Equal sets are one node from the start (128-bit digest).  Every text is cut into shingles once;
   the sets are written.
2. Similar nodes are partitioned into groups.  A node has a key for each of BANDS bands, made of the
   least hashes of ROWS ranges of the hash space, and belongs to the group of the key that most nodes
   have.  Members of a group needn't link.
3. Within a group, a bounded number of leaders is compared with each member, and with each other;
   what these links connect is a cell, so a group of near copies is one cell or a few.
4. The token-group matrix holds (token, group) for the union of the tokens that a group's members are
   indexed by.  Let tokens be in any fixed order, and sets have n <= m tokens.  Linked sets share
   ``ceil((n + m) * 4 / 9)`` of them, of which those outside the first n - ceil(n * 8 / 9) + l tokens
   of the one (by which it is indexed) and the first m - ceil(.8 m) + l of the other (by which it
   asks) are at most the larger of the two rests.  Tokens of many nodes come last in the order, so
   passages that many texts share stay out of the matrix.
5. The overlap of what a node asks by with a group's union, without tokens that its own cell alone has
   there, bounds its overlap with any member of another cell.  Only groups whose sizes fit and that reach
   the bound are opened, in blocks bounded on both sides; in each the overlap with the block's whole union
   is looked at first, then that with every member is counted exactly.
6. Components of the links of steps 3 and 5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_BYTES, arrow_rows, free_name, released, sized, written
from .components import connected_components
from .shingles import digest, mix, shingle_sets

PERCENT = 80
#: Longer prefixes ask for more common tokens: 1 + n // SLACK of them.
SLACK = 20
BANDS, ROWS = 8, 3
#: Blocks of a group have about so many members, or askers, and so many bytes of tokens at most on average.
BLOCK, BLOCK_BYTES = 512, 1 << 22
#: About so many members of a group, and so many bytes of them, lead it.
LEADERS, LEADER_BYTES = 64, 1 << 22
#: Tokens that are LOCAL times in a portion of PORTION tokens of texts, FREQUENT times in all such
#: portions, and tokens in the matrix for more than HOT groups, move to the end of the order.
PORTION, LOCAL, FREQUENT, HOT = 1 << 21, 2, 12, 12
#: The order knows as many of them as may be broadcast (those of most texts); it is a hint, links don't depend on it.
MOST_HOT = BROADCAST_BYTES // 16
#: Where the matrix would be met by this many rows for each row that asks, hot tokens are looked for again.
OPENED_A_ROW = 8

_ROWS = "doc_id {id}, row_key binary, n int, digest binary, keys array<bigint>, tokens binary, token bigint, held int"
_NAMES = ["doc_id", "row_key", "n", "digest", "keys", "tokens", "token", "held"]
#: A task remembers so many digests; what it repeats beyond them is dropped later.
_SEEN = 1 << 16
ARROW_ROWS = 1000


def _band_keys(s: np.ndarray) -> np.ndarray:
    """One key for each band that has a token: a hash of the least tokens in its ranges, of 32 in all."""
    at = np.searchsorted(s, np.arange(BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(59))
    lowest = np.where(at[:-1] < at[1:], s[np.minimum(at[:-1], len(s) - 1)], np.uint64(0)).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in lowest.T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys[lowest.any(axis=1)].view(np.int64)


@released
def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the tokens where the task meets the set first, and rows (token,
    held) for the tokens frequent in a portion of the sets."""
    seen: set[bytes] = set()
    kept: list[np.ndarray] = []
    size, types = 0, [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def frequent(id_type: pa.DataType) -> pa.RecordBatch:
        every = np.concatenate(kept)
        kept.clear()
        every.sort()
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        held = np.diff(np.append(starts, len(every)))
        tokens, held = every[starts[held >= LOCAL]].view(np.int64), held[held >= LOCAL].astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(tokens), t) for t in (id_type, *types)), pa.array(tokens), pa.array(held)], _NAMES)

    def documents(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int32())], _NAMES)

    id_type = None
    for batch in batches:
        id_type, found, begun, held = batch.column(0).type, [], 0, 0
        for s in shingle_sets(batch.column(1)):
            if not len(s):
                found.append((0, None, [], None))
            else:
                d = digest(s)
                new = d not in seen
                if new:
                    if len(seen) < _SEEN:
                        seen.add(d)
                    kept.append(s)
                    size += len(s)
                    held += len(s)
                with np.errstate(over="ignore"):
                    found.append((len(s), d, _band_keys(s), s.tobytes() if new else None))
            if held > 1 << 20:
                yield documents(batch.slice(begun, len(found)), found)
                begun, found, held = begun + len(found), [], 0
            if size >= PORTION:
                yield frequent(id_type)
                size = 0
        if found:
            yield documents(batch.slice(begun, len(found)), found)
    if kept:
        yield frequent(id_type)


class _Members:
    """Sets whose overlaps with another set are all counted at once, by posts in token order."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def linked(self, s: np.ndarray) -> np.ndarray:
        """The places of the sets that link with s."""
        low, high = (np.searchsorted(self.tokens, s, side) for side in ("left", "right"))
        posts = high - low
        # A link takes so many tokens of s, all of them in the union.
        if 100 * np.count_nonzero(posts) < PERCENT * len(s):
            return np.zeros(0, np.int64)
        at = np.repeat(low - np.cumsum(posts) + posts, posts) + np.arange(posts.sum())
        same = np.bincount(self.owner[at], minlength=len(self.n))
        return np.flatnonzero(100 * same >= PERCENT * (self.n + len(s) - same))


def _edges(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


@released
def _leader_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of nodes with leaders of their group, one for each that connects something new.

    Rows (grp, block, follows, digest, tokens) come sorted, the leaders of a block before its others.
    """
    at, leaders, sets, root, a, b = None, [], [], None, [], []

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    def settle() -> _Members:
        nonlocal root
        members, root = _Members(sets), list(range(len(sets)))
        for i, s in enumerate(sets):
            for j in members.linked(s).tolist():
                if find(i) != find(j):
                    root[find(i)] = find(j)
                    a.append(leaders[i])
                    b.append(leaders[j])
        return members

    members, last = None, None
    for batch in batches:
        for grp, block, follows, d, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            if (grp, block) != at:
                if len(sets) > 1 and members is None:
                    settle()
                at, leaders, sets, members, last = (grp, block), [], [], None, None
            if d == last:  # a set that several tasks have met
                continue
            last = d
            s = np.frombuffer(tokens.as_buffer(), np.uint64)
            if not follows:
                leaders.append(d)
                sets.append(s.copy())
            elif sets:
                members = settle() if members is None else members
                for i in {find(i): i for i in members.linked(s).tolist()}.values():
                    a.append(d)
                    b.append(leaders[i])
        yield _edges(a, b)
        a, b = [], []
    if len(sets) > 1 and members is None:
        settle()
    yield _edges(a, b)


@released
def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the nodes that ask with a member of each other cell of the block they open.

    Rows (grp, block, part, asks, digest, cell, tokens) come sorted, a block's members before those that ask.
    """
    at, held, members = None, [], None
    for batch in batches:
        a, b = [], []
        for grp, block, part, asks, d, cell, tokens in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), strict=True):
            if (grp, block, part) != at:
                at, held, members = (grp, block, part), [], None
            s = np.frombuffer(tokens.as_buffer(), np.uint64)
            if not asks:
                held.append((d, cell, s.copy()))
            elif held:
                members = _Members([s for _, _, s in held]) if members is None else members
                known = {cell}
                for i in members.linked(s).tolist():
                    if held[i][1] not in known:
                        known.add(held[i][1])
                        a.append(d)
                        b.append(held[i][0])
        yield _edges(a, b)


def _digests(digests: list[bytes], times: list[int]) -> pa.Array:
    data = np.repeat(np.frombuffer(b"".join(digests), np.dtype("V16")), times)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _prefix_rows(hot):
    """Rows (token, digest, n, indexed) for the tokens by which each set (digest, tokens) asks, and is indexed.

    hot holds the sorted hot tokens and their places at the end of the order.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late_tokens, places = hot.value
        for batch in batches:
            tokens, digests, sizes, lengths, indexed, held = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), _digests(digests, lengths), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(np.concatenate(indexed))], ["token", "digest", "n", "indexed"])

            for d, buffer in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(buffer.as_buffer(), np.uint64)
                n = len(s)
                asks = min(n, n - -(-PERCENT * n // 100) + 1 + n // SLACK)
                by = min(asks, n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1 + n // SLACK)
                if len(late_tokens):
                    at = np.minimum(np.searchsorted(late_tokens, s), len(late_tokens) - 1)
                    late = late_tokens[at] == s
                    s = np.concatenate([s[~late], s[late][np.argsort(places[at[late]])]])
                tokens.append(s[:asks])
                digests.append(d)
                sizes.append(n)
                lengths.append(asks)
                indexed.append(np.arange(asks) < by)
                held += asks
                if held > 1 << 17:
                    yield out()
                    tokens, digests, sizes, lengths, indexed, held = [], [], [], [], [], 0
            if held:
                yield out()

    return released(rows)


def _needed(m: Column, lo: Column, hi: Column) -> Column:
    """Least overlap of what a set of m tokens asks by with what a linked set of lo to hi tokens, m at
    most, is indexed by.

    For a size n it is what a link needs less the larger rest of the two; between two sizes it is, but
    for roundings of 3 in all, least at one end.
    """

    def rest(k: Column, percent: int, of: int) -> Column:
        return F.greatest(F.lit(0), F.ceil(k * percent / of) - 1 - F.floor(k / SLACK))

    def at(n: Column) -> Column:
        return F.ceil((n + m) * PERCENT / (100 + PERCENT)) - F.greatest(rest(n, 2 * PERCENT, 100 + PERCENT), rest(m, PERCENT, 100))

    lo, hi = F.greatest(lo, F.ceil(m * PERCENT / 100)), F.least(hi, m)
    return F.greatest(F.lit(1), F.least(at(lo), at(hi)) - F.when(lo < hi, 3).otherwise(0))


def _order(spark, held: DataFrame):
    """A broadcast order for the tokens (token, held) that many texts have, most frequent last."""
    top = held.orderBy(F.desc("held"), "token").limit(MOST_HOT).toArrow()
    token, places = top["token"].to_numpy().view(np.uint64), -np.arange(len(top))
    by_token = np.argsort(token)
    return spark.sparkContext.broadcast((token[by_token], places[by_token]))


def _parts(rows: Column, tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(tokens * 8 / BLOCK_BYTES)).cast("int")


def _dealt(parts: str) -> Column:
    return F.pmod(F.xxhash64("digest"), F.col(parts)).cast("int")


def _each(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _groups(nodes: DataFrame) -> DataFrame:
    """digest, n and grp of the nodes (digest, n, keys) that share their most frequent key with another."""
    keyed = nodes.select("digest", "n", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    best = keyed.join(often, "key").groupBy("digest", "n").agg(F.max(F.struct("held", "key"))["key"].alias("key"))
    best = written(best.select("digest", "n", F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("grp")), "jaccard-best")
    several = best.groupBy("grp").agg(F.count("*").alias("held"), F.sum("n").alias("sum"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("held > 1")
    return written(best.join(several, "grp"), "jaccard-groups")


def _cells(groups: DataFrame, count: int, sets: DataFrame) -> DataFrame:
    """node and root: what the leaders of the groups connect."""
    share = F.least(F.lit(1.0), LEADERS / F.col("held"), LEADER_BYTES / (8 * F.col("sum")))
    leads = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20)
    rows = groups.withColumn("parts", _parts(F.col("held"), F.col("sum"))).withColumn("follows", ~leads)
    places = F.when(F.col("follows"), F.array(_dealt("parts"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.select("digest", "grp", F.explode(places).alias("block"), "follows")
    full = sets.join(sized(rows, 2 * count, 64), "digest").select("grp", "block", "follows", "digest", "tokens")
    full = full.repartition("grp", "block").sortWithinPartitions("grp", "block", "follows", "digest")
    return connected_components(full.mapInArrow(_leader_links, "a binary, b binary"), "jaccard-cells")


def _matrix(sets: DataFrame, moved: DataFrame, count: int, order) -> tuple[DataFrame, DataFrame]:
    """The tokens that more than one node has: (token, digest, n, grp, cell) by which nodes ask, and
    the matrix (token, other, first, last, least, most) of groups, the cells that hold the token
    there, and the sizes in the group."""
    of_token = Window.partitionBy("token")
    prefix = sets.select("digest", "tokens").mapInArrow(_prefix_rows(order), "token bigint, digest binary, n int, indexed boolean").repartition(F.col("token"))
    several = prefix.withColumn("lo", F.min("digest").over(of_token)).withColumn("hi", F.max("digest").over(of_token)).where("lo <> hi")
    several = several.select("token", "digest", "n", "indexed").dropDuplicates(["token", "digest"])
    # A node of no group is its own one and its own cell, which needn't be written.
    placed = several.join(sized(moved, count, 96), "digest", "left").select("token", "digest", "n", "indexed", "grp", "cell", "lo", "hi")
    placed = written(placed, "jaccard-placed").select("token", "digest", "n", "indexed", F.coalesce("grp", "digest").alias("grp"), F.coalesce("cell", "digest").alias("cell"), F.coalesce("lo", "n").alias("lo"), F.coalesce("hi", "n").alias("hi"))
    matrix = placed.where("indexed").groupBy("token", F.col("grp").alias("other")).agg(F.min("cell").alias("first"), F.max("cell").alias("last"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    return placed.select("token", "digest", "n", "grp", "cell"), written(matrix, "jaccard-matrix")


def _verified(asked: DataFrame, node: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the nodes that ask (digest, n, cell, other) with members of the groups they open."""
    asked = written(asked, "jaccard-asked")
    askers = asked.groupBy(F.col("other").alias("grp")).agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
    members = node.join(askers.select("grp"), "grp", "left_semi")
    sizes = written(askers.join(members.groupBy("grp").agg(_parts(F.count("*"), F.sum("n")).alias("blocks")), "grp"), "jaccard-opened")
    inner = members.join(sizes, "grp").select("grp", _dealt("blocks").alias("block"), _each("parts").alias("part"), F.lit(False).alias("asks"), "digest", "cell")
    outer = asked.withColumnRenamed("other", "grp").join(sizes, "grp").select("grp", _each("blocks").alias("block"), _dealt("parts").alias("part"), F.lit(True).alias("asks"), "digest", "cell")
    rows = written(inner.union(outer), "jaccard-rows")
    need = written(rows.select("digest").distinct(), "jaccard-need")
    wanted = sets.select("digest", "tokens").join(sized(need, need.count(), 48), "digest", "left_semi").dropDuplicates(["digest"])
    full = rows.join(wanted, "digest").select("grp", "block", "part", "asks", "digest", "cell", "tokens")
    full = full.repartition("grp", "block", "part").sortWithinPartitions("grp", "block", "part", "asks", "digest")
    return full.mapInArrow(_opened, "a binary, b binary")


def jaccard_nodes(docs: DataFrame, row_key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(light, roots): each row of docs (doc_id, text) with row_key, its set's size n and digest, and the
    root digest of every digest that links with another.
    """
    # Sets are long rows: small batches keep what a task holds at once small.
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        return _nodes(docs, F.lit(None).cast("binary") if row_key is None else row_key)


def _nodes(docs: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.select("doc_id", "text", key.alias("row_key")).mapInArrow(_set_rows, _ROWS.format(id=id_kind)), "jaccard-sets", 1 << 24)
    light = rows.where("n is not null").select("doc_id", "row_key", "n", "digest")
    sets = rows.where("tokens is not null").select("digest", "tokens")
    nodes = rows.where("tokens is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(nodes, "jaccard-nodes")
    groups = _groups(nodes)
    count = groups.count()
    cells = _cells(groups, count, sets)
    moved = groups.join(cells, groups["digest"] == cells["node"], "left")
    moved = written(moved.select("digest", "grp", F.coalesce("root", "digest").alias("cell"), "lo", "hi"), "jaccard-moved")

    frequent = written(rows.where("token is not null").groupBy("token").agg(F.sum("held").alias("held")).where(f"held >= {FREQUENT}"), "jaccard-frequent")
    asking, matrix = _matrix(sets, moved, count, _order(spark, frequent))
    in_groups = matrix.groupBy("token").agg(F.count("*").alias("held"))
    met = written(asking.groupBy("token").agg(F.count("*").alias("rows")).join(in_groups, "token"), "jaccard-tokens")
    opened, held = met.agg(F.sum(F.col("rows") * F.col("held")), F.sum("rows")).first()
    if (opened or 0) > OPENED_A_ROW * (held or 0):
        every = frequent.union(met.where(F.col("held") > HOT).select("token", "held")).groupBy("token").agg(F.max("held").alias("held"))
        asking, matrix = _matrix(sets, moved, count, _order(spark, every))
    # The larger set asks the smaller one; of equal sizes both ask.
    fits = (F.col("least") <= F.col("n")) & (F.col("most") * 100 >= F.col("n") * PERCENT)
    others = (F.col("first") != F.col("last")) | (F.col("first") != F.col("cell"))
    pairs = asking.join(matrix, "token").where(fits & others)
    overlap = pairs.groupBy("digest", "n", "cell", "other", "least", "most").agg(F.count("*").alias("overlap"))
    asked = overlap.where(F.col("overlap") >= _needed(F.col("n"), F.col("least"), F.col("most"))).select("digest", "n", "cell", "other")
    node = nodes.join(moved.select("digest", "grp", "cell"), "digest", "left").select("digest", "n", F.coalesce("grp", "digest").alias("grp"), F.coalesce("cell", "digest").alias("cell"))
    links = _verified(asked, written(node, "jaccard-node"), sets)
    more = links.union(cells.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return light, connected_components(more, "jaccard-components")


def _placed(docs: DataFrame, row_key: Column | None = None) -> DataFrame:
    """doc_id, row_key, n and root: the digest that stands for a row's component, null without words."""
    light, roots = jaccard_nodes(docs, row_key)
    placed = light.join(roots, light["digest"] == roots["node"], "left")
    return written(placed.select("doc_id", "row_key", "n", F.coalesce("root", "digest").alias("root")), "jaccard-found")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    docs needs doc_id and text; further columns are ignored.  Null and wordless texts have no
    shingle and their own doc_id as component.  Rows with equal sets share a component, repeated
    rows are returned as often as they come.  A null doc_id takes part by its text; it is the
    component_id only where no document of its component has one.  Very long texts are cut into
    shingles a megabyte at a time or, if longer, at once.  An empty table gives no rows.
    """
    placed = _placed(docs)
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest doc_id, of several
    texts with it that of the smallest MD5 digest; a null doc_id only where there is no other.

    Texts without words are linked with nothing and all stay.  Of rows repeated with one doc_id and
    text, one stays.  Columns may have any names.  An empty table gives no rows.
    """
    text_key = F.unhex(F.md5(F.col("text").cast("binary")))
    placed = _placed(docs.select("doc_id", "text"), text_key)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    best = placed.where("root is not null").groupBy("root").agg(first.alias("best")).select("best.doc_id", "best.row_key")
    keep_id, keep_key, own = (free_name(docs.columns, x) for x in ("_keep_id", "_keep_key", "_own_key"))
    kept = best.union(placed.where("root is null").select("doc_id", "row_key").distinct()).toDF(keep_id, keep_key)
    kept = written(kept, "jaccard-kept")
    same = F.col("doc_id").eqNullSafe(F.col(keep_id)) & F.col(own).eqNullSafe(F.col(keep_key))
    rows = docs.withColumn(own, text_key).join(sized(kept, kept.count(), 96), same, "left_semi")
    repeated = placed.groupBy("doc_id", "row_key").agg(F.count("*").alias("held")).where("held > 1")
    return (rows if repeated.isEmpty() else rows.dropDuplicates(["doc_id", own])).drop(own)
