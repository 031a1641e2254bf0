"""The prefix trie of all conversations, by ROLLUP over positional turn columns.

1. A turn is known by a digest of its role and text that also holds its length, so no text is
   shuffled. Turns are numbered in their conversation by a range partitioning: a conversation
   of any length, or rows that are all the same, fall into many tasks (``running``).
2. A conversation is cut into blocks of ``WIDTH`` turns, one row each with a column per place. A
   block is keyed by the node that the block before it ends at, named by its depth and two
   64-bit sums over the places and digests up to there.
3. One ``GROUP BY block, node, ROLLUP(t0, .., t7)`` over all blocks makes every prefix a group;
   grouping_id tells its depth. Each group is a node of the trie with its number of members and
   the smallest one, its owner. Partial sums go ahead of the shuffle, so a prefix that all
   conversations share is no burden.
4. An owner of a node owns what it has below, so its nodes are one chain. Where the chains begin
   tells how much text of a conversation lies in nodes of others, and a second ROLLUP sums that,
   and the leaves, over all subtrees at once. Turns after the last shared one stay out of it.
5. Members that end at a node are sorted by a range partitioning and joined to strings of some
   thousand ids; only these strings, not the rows, meet in the task that hashes a node's ids.

Rows without a conversation id belong to none. A missing role or text is empty. Turns come
by turn number, missing ones first, and by digest where numbers repeat; repeated rows are turns
each. No conversation, no node; conversations without turns end at the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_key_join
from .staging import Scratch

WIDTH = 8
#: Bytes of ids in one string.
STRING_BYTES = 1 << 16
DIGEST, LENGTH = 16, 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Sixteen bytes that tell (role, text) apart, then the code points of the text in six."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    length = F.lpad(F.hex(F.length(text).cast("long")), 2 * LENGTH, "0")
    return F.unhex(F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), length))


def turn_chars(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, DIGEST + 1, LENGTH)), 16, 10).cast("long")


def running(
    rows: DataFrame, group: str, order: Sequence[str], scratch: Scratch, sums: Sequence[str] = (), xors: Sequence[str] = ()
) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in their group, and for each column x of ``sums`` and ``xors``
    its running value over the earlier rows as ``x_before``. All but ``rows``' other columns are longs.

    Rows are dealt by range and numbered in their own part. A group that goes on in later parts
    gets the value at the end of each part added there; that table has one row per part.
    """
    names, given = [*sums, *xors], rows.columns
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried, before, held = TaskContext.get().partitionId(), None, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            keys = batch.column(group).to_numpy()
            place = np.arange(len(keys))
            new = np.concatenate([[keys[0] != carried], keys[1:] != keys[:-1]])
            first = np.maximum.accumulate(np.where(new, place, -1))
            goes_on = first < 0
            out = {"rank": place - first + np.where(goes_on, before.get("rank", 0), 1)}
            out["rank"][goes_on] = place[goes_on] + 1 + before.get("rank", 0)
            for name in names:
                x = batch.column(name).to_numpy()
                if name in sums:
                    upto = np.cumsum(x) - x
                    out[name] = upto - np.where(goes_on, -before.get(name, 0), upto[first])
                else:
                    upto = np.bitwise_xor.accumulate(x) ^ x
                    out[name] = upto ^ np.where(goes_on, before.get(name, 0), upto[first])
            carried = keys[-1]
            before = {"rank": int(out["rank"][-1])}
            for name in names:
                x = int(batch.column(name)[-1].as_py())
                before[name] = int(out[name][-1]) + x if name in sums else int(out[name][-1]) ^ x
            held = _batch([*batch.columns, *map(pa.array, out.values())], columns, part, False, before)
        if held is not None:
            yield _batch(held.columns[: -2 - len(names)], columns, part, True, before)

    columns = [*given, "rank", *[f"{n}_before" for n in names], "_part", "_last", *[f"_{n}_end" for n in names]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    longs = "".join(f", {n} long" for n in columns[len(given) : -2 - len(names)])
    ends = "".join(f", {n} long" for n in columns[-len(names) :]) if names else ""
    found = scratch.stage(dealt.mapInArrow(number, f"{schema}{longs}, _part int, _last boolean{ends}"), "running")
    add, group_now, total = [], None, {}
    for r in found.filter("_last").orderBy("_part").collect():
        if group_now is not None:
            add.append((r["_part"], group_now, *[total[n] for n in ["rank", *names]]))
        same = r[group] == group_now
        own = {"rank": r["rank"]} | {n: r[f"_{n}_end"] for n in names}
        total = {n: (own[n] ^ total[n] if n in xors else own[n] + total[n]) if same else own[n] for n in own}
        group_now = r[group]
    more = rows.sparkSession.createDataFrame(add, f"_part int, {group} long" + "".join(f", _{n} long" for n in ["rank", *names]))
    joined = found.join(F.broadcast(more), ["_part", group], "left")
    plus = lambda c, n: (F.col(c) + F.coalesce(F.col(n), F.lit(0))).alias(c)
    return joined.select(
        *given, plus("rank", "_rank"), *[plus(f"{n}_before", f"_{n}") for n in sums],
        *[F.col(f"{n}_before").bitwiseXOR(F.coalesce(f"_{n}", F.lit(0))).alias(f"{n}_before") for n in xors],
    )


def _batch(columns: list[pa.Array], names: list[str], part: int, last: bool, ends: dict[str, int]) -> pa.RecordBatch:
    n = len(columns[0])
    flag = np.zeros(n, bool)
    flag[-1] = last
    more = [pa.array(np.full(n, part, np.int32)), pa.array(flag), *[pa.array(np.full(n, v, np.int64)) for k, v in ends.items() if k != "rank"]]
    return pa.RecordBatch.from_arrays([*columns, *more], names)


def numbered_turns(
    turns: DataFrame, scratch: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, rank, t): every turn with its number in its conversation, from 1, and its digest."""
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("t"),
        # Equal rows are dealt out too.
        F.monotonically_increasing_id().alias("row"),
    )
    return running(rows, "conv_id", ["turn", "t", "row"], scratch).select("conv_id", "rank", "t")


def _blocks(turns: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """One row per block: conv_id, block, t0 .., the sums of the block and those before it."""
    at = F.col("pos") - 1
    cell = F.struct(
        (at % width).alias("slot"), "t", F.xxhash64("pos", "t").alias("x1"), F.xxhash64("t", "pos").alias("x2"),
        turn_chars(F.col("t")).alias("chars"),
    )
    rows = turns.groupBy("conv_id", F.floor(at / width).alias("block")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    xor = lambda s, c: s.bitwiseXOR(c)
    rows = rows.select(
        "conv_id", "block", *[F.get("cells", F.lit(i))["t"].alias(f"t{i}") for i in range(width)], F.size("cells").cast("long").alias("n"),
        *[F.aggregate(F.col(f"cells.{x}"), F.lit(0).cast("long"), xor).alias(x) for x in ("x1", "x2")],
        F.aggregate(F.col("cells.chars"), F.lit(0).cast("long"), lambda s, c: s + c).alias("chars"),
    )
    return scratch.stage(running(rows, "conv_id", ["block"], scratch, sums=["chars"], xors=["x1", "x2"]), "blocks")


def _rollup(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """All prefixes of all blocks: (depth, p1, p2), those of the prefix without its last turn
    (q1, q2), its ``chars`` and those ``before`` them, and the aggregates ``sums``."""
    turns = ", ".join(f"t{i}" for i in range(width))
    # Of the bits of grouping_id those of the columns that are rolled up are set.
    groups = blocks.sparkSession.sql(
        f"""SELECT * FROM (
              SELECT block, x1_before, x2_before, chars_before, {turns}, {width} - bit_count(grouping_id()) AS d, {sums}
              FROM {{blocks}} GROUP BY block, x1_before, x2_before, chars_before, ROLLUP({turns}))
            WHERE d > 0 AND element_at(array({turns}), d) IS NOT NULL""",
        blocks=blocks,
    )
    d, first = F.col("d"), F.col("block") * width
    p1, p2, q1, q2, before, last = F.col("x1_before"), F.col("x2_before"), F.col("x1_before"), F.col("x2_before"), F.col("chars_before"), F.lit(0)
    zero = F.lit(0).cast("long")
    for i in range(width):
        t, pos = F.col(f"t{i}"), first + i + 1
        h1, h2, chars = F.xxhash64(pos, t), F.xxhash64(t, pos), turn_chars(t)
        p1, p2 = p1.bitwiseXOR(F.when(d > i, h1).otherwise(zero)), p2.bitwiseXOR(F.when(d > i, h2).otherwise(zero))
        q1, q2 = q1.bitwiseXOR(F.when(d > i + 1, h1).otherwise(zero)), q2.bitwiseXOR(F.when(d > i + 1, h2).otherwise(zero))
        before = before + F.when(d > i + 1, chars).otherwise(zero)
        last = F.when(d == i + 1, chars).otherwise(last)
    named = [c for c in groups.columns if c not in ("block", "x1_before", "x2_before", "chars_before", "d", *turns.split(", "))]
    return groups.select(
        (first + d).alias("depth"), p1.alias("p1"), p2.alias("p2"), q1.alias("q1"), q2.alias("q2"),
        before.alias("before"), last.alias("chars"), *named,
    )


def _key(depth: Column, a: str, b: str) -> Column:
    return F.struct(depth.cast("long").alias("depth"), F.col(a).alias("a"), F.col(b).alias("b"))


def ids_digest(ends: DataFrame, string_bytes: int = STRING_BYTES) -> DataFrame:
    """(key, sha): for each key the digest of its conv_ids in ascending order, comma-joined."""
    flat = ends.select("key.depth", "key.a", "key.b", "conv_id")
    keys = ["depth", "a", "b"]
    sides = "depth long, a long, b long"

    def runs_of(batch: pa.RecordBatch):
        """Runs of rows of one key."""
        columns = [batch.column(c).to_numpy() for c in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if a < b:
                yield tuple(int(c[a]) for c in columns), a, b

    def to_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, string_bytes // 12)
        for batch in batches:
            ids, rows, size = batch.column(3).to_numpy(), [], 0
            for key, a, b in runs_of(batch):
                for low in range(a, b, most):
                    part = ids[low : min(low + most, b)].tolist()
                    rows.append((*key, part[0], ",".join(map(str, part))))
                    size += len(rows[-1][-1])
                    if size > 16 * string_bytes:
                        yield to_batch(rows, [*keys, "first", "ids"])
                        rows, size = [], 0
            if rows:
                yield to_batch(rows, [*keys, "first", "ids"])

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            rows, strings = [], batch.column(4)
            for key, a, b in runs_of(batch):
                if key != now:
                    if now is not None:
                        rows.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                    digest.update(strings[a].as_py().encode())
                    a += 1
                for k in range(a, b):
                    digest.update(b"," + strings[k].as_py().encode())
            if rows:
                yield to_batch(rows, [*keys, "sha"])
        if now is not None:
            yield to_batch([(*now, digest.hexdigest())], [*keys, "sha"])

    joined = flat.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(join_ids, f"{sides}, first long, ids string")
    hashed = joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hash_ids, f"{sides}, sha string")
    return hashed.select(F.struct(*keys).alias("key"), "sha")


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, scratch: Scratch | None = None) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv_id, pos, t) with positions from 1 without gaps and digests of ``turn_id``;
    ``convs``: (conv_id) of all conversations, those without turns among them."""
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark)
    blocks = _blocks(turns, width, scratch)
    totals = blocks.groupBy("conv_id").agg(
        F.sum("n").alias("n"), F.expr("bit_xor(x1)").alias("x1"), F.expr("bit_xor(x2)").alias("x2"), F.sum("chars").alias("chars")
    )
    whole = scratch.stage(convs.select("conv_id").distinct().join(totals, "conv_id", "left").na.fill(0), "conversations")

    zero = F.lit(0).cast("long")
    root = whole.withColumn("z", zero).groupBy("z").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).select(
        _key(F.lit(0), "z", "z").alias("key"), F.when(F.lit(False), _key(F.lit(0), "z", "z")).alias("parent"),
        zero.alias("before"), "n_convs", "conv_id",
    )
    below = _rollup(blocks, width, "count(*) AS n_convs, min(conv_id) AS conv_id").select(
        _key(F.col("depth"), "p1", "p2").alias("key"), _key(F.col("depth") - 1, "q1", "q2").alias("parent"), "before", "n_convs", "conv_id"
    )
    nodes = scratch.stage(root.union(below), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    owners = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = scratch.stage(
        hot_key_join(nodes, owners, "parent", ["conv_id"], "left").join(children, "key", "left")
        .withColumn("n_children", F.coalesce("n_children", zero)).drop("parent"),
        "linked",
    )

    begins = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    chains = linked.groupBy("conv_id").agg(
        F.min(F.when(begins, F.col("before"))).alias("own_from"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.min(F.when(F.col("n_convs") == 1, F.col("key.depth"))).alias("alone_from"),
    )
    # In nodes of others: all before the first own node, or everything.
    shared = scratch.stage(
        whole.join(chains, "conv_id", "left").select(
            "conv_id", F.coalesce("own_from", "chars").alias("others"), F.coalesce("leaf", zero).alias("leaf"), "alone_from"
        ),
        "chains",
    )
    sums = "sum(others) AS others, min(others) AS least, sum(leaf) AS n_leaves"
    places = hot_key_join(blocks, shared, "conv_id", ["block"]).withColumn(
        "alone_from", F.coalesce("alone_from", F.lit(2**62)) - F.col("block") * width
    )
    places = places.filter("alone_from > 1").withColumns(
        {f"t{i}": F.when(F.col("alone_from") > i + 1, F.col(f"t{i}")) for i in range(width)}
    )
    over_root = shared.withColumn("z", zero).groupBy("z").agg(
        F.sum("others").alias("others"), F.min("others").alias("least"), F.sum("leaf").alias("n_leaves")
    ).select(_key(F.lit(0), "z", "z").alias("key"), "others", "least", "n_leaves")
    subtrees = over_root.union(
        _rollup(places, width, sums).select(_key(F.col("depth"), "p1", "p2").alias("key"), "others", "least", "n_leaves")
    )
    ends = ids_digest(whole.select(_key(F.col("n"), "x1", "x2").alias("key"), "conv_id"))
    saved = F.col("others") - F.col("least") - (F.col("n_convs") - 1) * F.col("before")
    alone = F.col("n_convs") == 1
    return (
        linked.join(subtrees, "key", "left").join(ends, "key", "left")
        .select(
            "conv_id", "key.depth", "parent_conv_id", "n_convs", "n_children",
            F.when(alone, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
            F.when(alone, 0).otherwise(saved).cast("long").alias("saved_tokens"),
            F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )


def with_openings(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: (conv_id, pos, t) and the list of conversations.

    Conversation c gets the first h turns of conversation c - c % ``every`` (none if there is none)
    in place of its own first h; h is crc32 of c as text modulo ``most`` + 1.
    ``turns``: (conv_id, rank, t). A conversation is opened for at most ``every`` - 1 others.
    """
    c = F.col("conv_id")
    cut = F.crc32(c.cast("string")) % (most + 1)
    opened = c - c % every
    convs = turns.filter("rank = 1").select("conv_id", opened.alias("opening"), cut.alias("h"))
    heads = turns.filter((c == opened) & (F.col("rank") <= most)).select(c.alias("opening"), F.col("rank").alias("pos"), "t")
    sizes = heads.groupBy("opening").agg(F.count("*").alias("has"))
    moved = convs.join(sizes, "opening", "left").select("conv_id", (F.least("h", F.coalesce("has", F.lit(0))) - F.col("h")).alias("shift"))
    own = hot_key_join(turns.filter(F.col("rank") > cut), moved, "conv_id", ["rank"])
    opening = convs.join(heads, "opening").filter("pos <= h").select("conv_id", "pos", "t")
    return opening.union(own.select("conv_id", (F.col("rank") + F.col("shift")).alias("pos"), "t")), convs.select("conv_id")
