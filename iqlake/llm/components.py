"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Edges that a task contracts at a time; what it holds is bounded by them. Tables of no more edges are settled by one task.
CHUNK = 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components: of every chunk of a partition a spanning forest of stars is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def forest() -> pa.RecordBatch:
            stars = [(x, find(x)) for x in list(root)]
            stars = [(u, v) for u, v in stars if u != v]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([u for u, _ in stars], [v for _, v in stars])], names=["u", "v"])

        held = 0
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root.setdefault(u, u)
                root.setdefault(v, v)
                x, y = find(u), find(v)
                if x != y:
                    root[max(x, y)] = min(x, y)
            held += b.num_rows
            if held >= CHUNK:
                yield forest()
                root.clear()
                held = 0
        if root:
            yield forest()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def unsettled(edges: DataFrame) -> bool:
    """True until every node has one edge to its component's smallest node, which has none itself. Counts are summed before the shuffle."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    wrong = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child > 0 and parent > 0")
    return not wrong.isEmpty()


def connected(edges: DataFrame, name: str = "cc", most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. ``edges`` has long columns a and b; nodes without edges aren't returned.

    Edges are contracted where they lie, without a shuffle, then once more with up to ``CHUNK`` of what is left to a task: few edges
    are settled by that. More go through alternating large-star and small-star rounds: every node points at the smallest neighbour it
    knows. A node's neighbours are never gathered, only their minimum is. In a large-star round a hub can be a hot key: the minima that
    change anything are written first, so that the join has a table on either side and Spark can split the key. Rounds grow with
    the logarithm of the longest path; small groups settle in one or two. More than ``most`` rounds raise: no unfinished answer is given.
    """
    given = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    local = materialize(contracted(given), name + "-local")
    held = local.count()
    met = contracted(local.coalesce(max(1, -(-held // CHUNK))))
    now = materialize(met if held <= CHUNK else met.distinct(), name)
    drop_table(local)
    for _ in range(most):
        if not unsettled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower = materialize(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), name + "-min")
        large = now.join(lower.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = materialize(large.where("u <> v").distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u <> v").distinct(), name)
        for old in (now, lower, large):
            drop_table(old)
        now = small
    else:
        if unsettled(now):
            raise RuntimeError(f"the components didn't settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
