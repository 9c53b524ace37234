"""Connected components and directed ownership as iterated joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from siteloom.session import checkpointed, ship


#: Edges from which the aggregate of a step is written before it is joined. Both sides of the join then
#: come from shuffles of their own, and adaptive execution can split the edges of a node that has very many.
SPLIT_EDGES = 1_000_000


def _large_star(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = keep(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    least = keep(edges.groupBy("src").agg(F.min("dst").alias("low")))
    moved = edges.join(least, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst")))


#: Nodes of which a task holds a forest at once, and edges that one task can finish.
FOREST_NODES, FINISHED_EDGES = 500_000, 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst): each node of a task's edges (src, dst longs) and the smallest one that it reaches by them, itself if that is it."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        y = up.setdefault(x, x)
        while y != x:
            up[x] = z = up[y]
            x, y = y, z
        return x

    def stars() -> pa.RecordBatch:
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["src", "dst"])

    for batch in batches:
        for x, y in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST_NODES:
            yield stars()
            up.clear()
    yield stars()


def _claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, owner) from all directed edges (src, dst longs): the smallest node that reaches each."""
    steps: dict[int, list[int]] = {}
    for batch in batches:
        for x, y in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist()):
            steps.setdefault(x, []).append(y)
            steps.setdefault(y, [])
    owner: dict[int, int] = {}
    for first in sorted(steps):
        open_ = [first] if first not in owner else []
        owner.setdefault(first, first)
        while open_:
            for y in steps[open_.pop()]:
                if y not in owner:
                    owner[y] = first
                    open_.append(y)
    yield pa.RecordBatch.from_arrays([pa.array(owner.keys(), pa.int64()), pa.array(owner.values(), pa.int64())], names=["node", "owner"])


def in_order(nodes: DataFrame, order: list[str], name: str = "__id") -> DataFrame:
    """nodes with `name`, longs that rise in the order. Rows are sorted in ranges."""
    return checkpointed(nodes.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node that stands in an edge, the smallest node it can reach.

    Nodes that aren't numbers are numbered in their order first. Each task turns its edges into a forest, so that no more edges than
    nodes leave it. Up to FINISHED_EDGES of them one task joins; beyond, large-star and small-star steps alternate until nothing moves, a number of rounds that grows
    with the logarithm of the longest path. Each step is an aggregate with partial results and a join;
    from SPLIT_EDGES edges on, the join's heavy side can be split, so a node with very many edges doesn't end in one task.
    Null ends and loops are ignored (a node that only has a loop is still returned); an empty input
    gives an empty result.
    """
    ship(edges.sparkSession)
    raw = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    kind = raw.schema["src"].dataType
    if not isinstance(kind, LongType):
        raw = checkpointed(raw)
        named = in_order(raw.select(F.col("src").alias("name")).union(raw.select("dst")).distinct(), ["name"])
        of = lambda c: named.select(F.col("name").alias(c), F.col("__id").alias(f"__{c}"))
        found = connected_components(raw.join(of("src"), "src").join(of("dst"), "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst")), max_rounds=max_rounds)
        return found.join(of("n"), found["node"] == F.col("__n")).join(of("c"), found["component"] == F.col("__c")).select(F.col("n").alias("node"), F.col("c").alias("component"))
    forest = checkpointed(raw.mapInArrow(_forest, "src long, dst long"))
    if forest.count() <= FINISHED_EDGES:
        return checkpointed(forest.repartition(1).mapInArrow(_forest, "src long, dst long")).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    loops = forest.where("src = dst").select(F.col("src").alias("node")).distinct()
    now = checkpointed(forest.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(max_rounds if seen[0] else 0):
        keep = checkpointed if seen[0] >= SPLIT_EDGES else lambda df: df
        now = checkpointed(_small_star(_large_star(now, keep).distinct(), keep).distinct())
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"connected_components: no fixpoint in {max_rounds} rounds")
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = found.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def least_reaching(steps: DataFrame) -> DataFrame:
    """(node, owner): for every node that stands in a directed edge (src, dst longs), the smallest node that reaches it, itself too.

    Up to FINISHED_EDGES edges one task walks them; beyond, labels are handed along the edges until none improves, and in a
    round only the nodes hand on whose label has changed.
    """
    ship(steps.sparkSession)
    steps = checkpointed(steps.select("src", "dst"))
    if steps.count() <= FINISHED_EDGES:
        return checkpointed(steps.repartition(1).mapInArrow(_claimed, "node long, owner long"))
    ends = steps.select(F.col("src").alias("node")).union(steps.select("dst")).distinct()
    now = checkpointed(ends.select("node", F.col("node").alias("owner"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        handed = now.where("moved").select(F.col("node").alias("src"), "owner").join(steps, "src").groupBy(F.col("dst").alias("node")).agg(F.min("owner").alias("new"))
        better = now.drop("moved").join(handed, "node", "left").withColumn("moved", F.coalesce(F.col("new") < F.col("owner"), F.lit(False)))
        now = checkpointed(better.select("node", F.when(F.col("moved"), F.col("new")).otherwise(F.col("owner")).alias("owner"), "moved"))
    return now.select("node", "owner")


def overruled(edges: DataFrame, node: str = "node", over: str = "over") -> DataFrame:
    """(node): those that give way, from edges of a node to one that goes before it and would overrule it.

    In order, a node gives way if one that overrules it didn't give way itself. Who comes first in the whole order doesn't matter to
    that: a node decides as soon as all of its own edges have been decided. In each round the nodes without edges left stand,
    those with an edge to one that stands give way, and edges of or to nodes that give way are dropped. Edges must not form circles;
    there are half as many rounds as the longest chain of edges that matter has nodes.
    """
    left = checkpointed(edges.select(F.col(node).alias("node"), F.col(over).alias("over")).distinct())
    out = None
    while left.limit(1).count():
        stand = left.select("over").distinct().join(left.select(F.col("node").alias("over")).distinct(), "over", "left_anti")
        gone = checkpointed(left.join(stand, "over").select("node").distinct())
        out = gone if out is None else out.unionByName(gone)
        left = checkpointed(left.join(gone, "node", "left_anti").join(gone.select(F.col("node").alias("over")), "over", "left_anti"))
    return left.select("node") if out is None else out
