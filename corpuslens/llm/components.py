"""Connected components of a graph of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Scratch


#: Edges that one task may hold: below 100 MB whatever the data.
BLOCK = 500_000


def _block_components(live: DataFrame) -> DataFrame:
    """(node, to) of a graph of at most ``BLOCK`` edges, in one task."""
    kind = live.schema["a"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).combine_chunks()
        ends = pa.concat_arrays([c for side in (0, 1) for c in held.column(side).chunks]).dictionary_encode()
        a, b = np.split(ends.indices.to_numpy(), 2)
        root = np.arange(len(ends.dictionary))
        # Every root with a smaller neighbour is hung below it, so the roots halve each time.
        while len(apart := np.flatnonzero(root[a] != root[b])):
            x, y = root[a[apart]], root[b[apart]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, up := root[root]):
                root = up
        yield pa.RecordBatch.from_arrays([ends.dictionary, ends.dictionary.take(pa.array(root))], ["node", "to"])

    return live.select("a", "b").coalesce(1).mapInArrow(solve, f"node {kind}, to {kind}")


def connected_components(edges: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is one node of the class.

    Each round every node moves to the neighbour (or itself) that comes first in an order
    drawn anew, and the graph shrinks to the nodes that were moved to. A round removes a
    constant share of the nodes on average whatever the shape, stars and chains alike. A
    node's neighbours are only ever aggregated to their minimum, so a hub is no burden.
    What is left of the graph when it has at most ``block`` edges is solved by one task
    instead of by ever smaller rounds.
    """
    a, b = F.col("a"), F.col("b")
    live = scratch.stage(
        edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges"
    )
    moves: list[DataFrame] = []
    while n_edges := live.count():
        if n_edges <= block:
            moves.append(scratch.stage(_block_components(live), "moves"))
            break
        salt = F.lit(len(moves))
        both = live.select("a", "b").union(live.select(b, a))
        moved = scratch.stage(
            both.groupBy("a").agg(F.min(F.struct(F.xxhash64(b, salt).alias("h"), b.alias("n"))).alias("m"))
            .select(
                F.col("a").alias("node"),
                F.least(F.col("m"), F.struct(F.xxhash64("a", salt).alias("h"), a.alias("n")))["n"].alias("to"),
            ),
            "moves",
        )
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        after = (
            live.join(left, "a").join(right, "b").filter("ta != tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        shrunk = scratch.stage(after, "edges")
        scratch.drop(live)
        live, moves = shrunk, [*moves, moved]
    if not moves:
        return edges.select(a.alias("node"), a.alias("root")).limit(0)
    roots = moves[0].select("node", F.col("to").alias("root"))
    for k, step in enumerate(moves[1:]):
        step = step.select(F.col("node").alias("root"), "to")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = scratch.stage(roots, "components")
    scratch.drop(live, *moves)
    return out
