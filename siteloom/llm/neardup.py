"""Embedding near-dedup: an exact metric range join.

Cosine >= t between unit vectors is a Euclidean distance of at most r = sqrt(2 - 2t). Pivots, taken
from a bounded sample of each label, part its vectors into cells by the nearest pivot; cells that are
still large are parted once more by pivots of their own. A vector x of cell p is copied to cell q only
if the triangle inequality leaves room for a partner there, at both levels: d(x,q) <= r + (largest
distance from q within its cell), d(x,q) - d(x,p) <= 2r and, as the border between two cells is a plane,
(d(x,q)^2 - d(x,p)^2) / 2d(p,q) <= r. For each two cells only one side is copied. A cell is joined by itself; a large one in blocks of bounded size past which the
other rows stream, so no task holds a cell. Only counts and spanning edges leave a block, no pairs.
Equal vectors of a label are joined once, with their number as weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.llm.vectors import bounded_sample, matrix, runs, unit, usable
from siteloom.operators.graph import connected_components
from siteloom.session import checkpointed, ship, table

#: A label of n vectors has sqrt(n) / ROOT pivots, LABEL_PIVOTS at most.
ROOT, LABEL_PIVOTS = 2, 512
#: A cell of more than LARGE_CELL vectors is parted by one pivot for every CELL_ROWS of them, CELL_PIVOTS at most.
LARGE_CELL, CELL_ROWS, CELL_PIVOTS = 8192, 2048, 64
#: Pivots of all labels and cells of one level; labels and cells beyond, the smallest ones, are left in one piece.
ALL_PIVOTS = 16384
#: Rows of a block, about; cells that stay large are cut in more blocks.
BLOCK_ROWS = 1024
#: Vectors from which the pivots of one level are chosen.
SAMPLE_ROWS = 16384
#: Added to every bound against rounding.
SLACK = 1e-9


def _visits(a: int, b: int) -> bool:
    """Of two different numbers exactly one visits the other, each about half of the others."""
    return (a < b) == ((a + b) % 2 == 0)


def _spread(rows: np.ndarray, k: int) -> np.ndarray:
    """k rows, each the farthest from those before (fewer if the rest are copies)."""
    chosen = [0]
    gap = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < k and gap.max() > 1e-12:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (rows @ pivots.T)))


class Cells:
    """The cells of one label: top pivots, and pivots within some of their cells. A cell's number is first[top] + its place."""

    def __init__(self, top: np.ndarray):
        self.top, self.within = top, {}
        self.part({})

    def part(self, within: dict[int, np.ndarray]) -> None:
        self.within = within
        many = np.array([len(within[p]) if p in within else 1 for p in range(len(self.top))])
        self.first = np.cumsum(many) - many

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, top, distance to it) of unit vectors."""
        d = _distances(rows, self.top)
        top, far = d.argmin(1), d.min(1)
        cell, near = self.first[top], far.copy()
        for p, pivots in self.within.items():
            if len(at := np.flatnonzero(top == p)):
                e = _distances(rows[at], pivots)
                cell[at] += e.argmin(1)
                near[at] = e.min(1)
        return cell, near, top, far

    @staticmethod
    def _room(d: np.ndarray, pivots: np.ndarray, far: np.ndarray, r: float) -> np.ndarray:
        """Rows by pivots: whether a vector whose nearest pivot is this one, at most `far` from it, can lie within r of the row."""
        home = d.argmin(1)
        least = d.min(1)[:, None]
        between = _distances(pivots, pivots)[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (d**2 - least**2) / (2 * between) > r
        return (d - least <= 2 * r) & ~beyond & (d <= r + far[None, :])

    def visits(self, rows: np.ndarray, r: float, far: dict[int, float], top_far: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells in which a partner of the row may be, its own cell among them; far, top_far: largest
        distances from the pivots of cells and of tops that hold vectors."""
        reach = np.array([top_far.get(p, -np.inf) for p in range(len(self.top))])
        row, top = np.nonzero(self._room(_distances(rows, self.top), self.top, reach, r))
        whole = ~np.isin(top, list(self.within))
        out = [(row[whole], self.first[top[whole]])]
        for p, pivots in self.within.items():
            if len(at := row[top == p]):
                reach = np.array([far.get(int(self.first[p]) + j, -np.inf) for j in range(len(pivots))])
                i, j = np.nonzero(self._room(_distances(rows[at], pivots), pivots, reach, r))
                out.append((at[i], self.first[p] + j))
        return tuple(np.concatenate(x) for x in zip(*out))


def _asked(sizes: list, wanted) -> list[tuple]:
    """(key, pivots) of the largest groups, as long as ALL_PIVOTS last."""
    out, left = [], ALL_PIVOTS
    for key, n in sizes:
        k = min(wanted(n), left)
        if k > 1:
            out.append((key, k))
            left -= k
    return out


def _sampled(rows: DataFrame, keys: list[str], groups: list[tuple]) -> dict[tuple, np.ndarray]:
    """Pivots of each (key, number), spread over a bounded sample of the groups' rows."""
    named = rows.sparkSession.createDataFrame([key for key, _ in groups], rows.select(*keys).schema)
    held: dict[tuple, list] = {}
    for x in bounded_sample(rows.join(F.broadcast(named), keys), [*keys, "embedding"], "embedding", SAMPLE_ROWS):
        held.setdefault(tuple(x[c] for c in keys), []).append(x.embedding)
    return {key: _spread(unit(np.array(held[key], np.float64)), k) for key, k in groups if key in held}


def _cells(distinct: DataFrame, sizes: DataFrame, typed: dict[str, str]) -> tuple[dict[tuple, Cells], dict[tuple, tuple[dict, dict, dict]]]:
    """The cells of each label that has some, and their (blocks, far, far of the tops)."""
    spark, keys = distinct.sparkSession, ["label", "dim"]
    large = [((x.label, x.dim), x.n) for x in sizes.where(F.col("n") > ROOT**2).orderBy(F.desc("n"), *keys).limit(ALL_PIVOTS // 2).collect()]
    groups = _asked(large, lambda n: min(math.ceil(math.sqrt(n) / ROOT), LABEL_PIVOTS))
    if not groups:
        return {}, {}
    cells = {key: Cells(top) for key, top in _sampled(distinct, keys, groups).items()}
    named = F.broadcast(spark.createDataFrame(list(cells), sizes.select(*keys).schema))

    def homes() -> DataFrame:
        shared = spark.sparkContext.broadcast(cells)

        def assign(batches):
            for batch in batches:
                got = [np.zeros(batch.num_rows, t) for t in (np.int64, float, np.int64, float)]
                for key, at in _by_label(batch):
                    for column, found in zip(got, shared.value[key].home(unit(matrix(batch.column("embedding").take(pa.array(at)))))):
                        column[at] = found
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "embedding")), *map(pa.array, got)], names=[*keys, "embedding", "cell", "near", "top", "far"])

        return distinct.join(named, keys).select(*keys, "embedding").mapInArrow(assign, f"label {typed['label']}, dim int, embedding {typed['embedding']}, cell long, near double, top long, far double")

    def counted() -> list:
        return homes().groupBy(*keys, "top", "cell").agg(F.count("*").alias("n"), F.max("near").alias("near"), F.max("far").alias("far")).orderBy(F.desc("n"), *keys, "cell").collect()  # 2 * ALL_PIVOTS rows at most

    found = counted()
    more = _asked([((x.label, x.dim, x.top), x.n) for x in found if x.n > LARGE_CELL], lambda n: min(math.ceil(n / CELL_ROWS), CELL_PIVOTS))
    if more:
        within: dict[tuple, dict] = {}
        for (label, dim, top), pivots in _sampled(homes(), [*keys, "top"], more).items():
            within.setdefault((label, dim), {})[top] = pivots
        for key, own in within.items():
            cells[key].part(own)
        found = counted()
    known: dict[tuple, tuple[dict, dict, dict]] = {}
    for x in found:
        blocks, far, tops = known.setdefault((x.label, x.dim), ({}, {}, {}))
        blocks[x.cell], far[x.cell], tops[x.top] = math.ceil(x.n / BLOCK_ROWS), x.near, max(x.far, tops.get(x.top, 0.0))
    return cells, known


def _by_label(batch: pa.RecordBatch):
    """(label, dim, row numbers) of a batch."""
    where: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
        where.setdefault(key, []).append(k)
    return where.items()


class _Block:
    """The rows of one block and what is known of their links."""

    def __init__(self, cosine: float):
        self.cosine, self.parts = cosine, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def close(self) -> None:
        raw = np.concatenate([matrix(b.column("embedding")) for b in self.parts])
        self.raw, self.rows = raw, unit(raw)
        self.node = np.concatenate([b.column("node").to_numpy() for b in self.parts])
        self.weight = np.concatenate([b.column("m").to_numpy() for b in self.parts])
        self.parts = []
        near = self._near(self.rows, raw)
        np.fill_diagonal(near, False)
        self.links = near @ self.weight
        self.root = np.arange(len(raw))
        for k in np.flatnonzero(near.any(1)):
            self._unite(np.flatnonzero(near[k, : k + 1]), k)

    def _near(self, rows: np.ndarray, raw: np.ndarray) -> np.ndarray:
        got = rows @ self.rows.T
        near = got >= self.cosine
        for i, j in zip(*np.nonzero(np.abs(got - self.cosine) < SLACK)):  # too near to tell from rounded unit vectors
            x, y = raw[i], self.raw[j]
            near[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x)) / math.sqrt(math.fsum(y * y)) >= self.cosine
        return near

    def _find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def _unite(self, linked: np.ndarray, k: int | None = None) -> int:
        """One root for all of linked (and k)."""
        roots = {self._find(j) for j in np.unique(self.root[linked])} | (set() if k is None else {self._find(k)})
        low = min(roots)
        for r in roots:
            self.root[r] = low
        return low

    def meet(self, batch: pa.RecordBatch) -> list[tuple]:
        raw = matrix(batch.column("embedding"))
        weight, node, out = batch.column("m").to_numpy(), batch.column("node").to_numpy(), []
        near = self._near(unit(raw), raw)
        self.links = self.links + weight @ near
        counts = near @ self.weight
        for k in np.flatnonzero(counts):
            out.append((int(node[k]), int(counts[k]), int(self.node[self._unite(np.flatnonzero(near[k]))])))
        return out

    def end(self) -> list[tuple]:
        return [(int(self.node[k]), int(self.links[k]), int(self.node[self._find(k)])) for k in np.flatnonzero(self.links)]


def range_join(distinct: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root): for the rows (label, dim, embedding, node, m) partial sums of the weights m of
    the rows linked to a node, and edges node-root that connect what the links connect."""
    spark = distinct.sparkSession
    ship(spark)
    r = math.sqrt(2 - 2 * cosine) + SLACK
    fields = "label, dim, embedding, node, m"
    typed = {f.name: f.dataType.simpleString() for f in distinct.schema}
    ddl = ", ".join(f"{c} {typed[c]}" for c in fields.split(", "))
    shared = spark.sparkContext.broadcast(_cells(distinct, sizes, typed))

    def deal(batches):
        cells, known = shared.value
        for batch in batches:
            take, cell, block, role = [], [], [], []

            def put(k, c, b, own):
                take.append(k)
                cell.append(c)
                block.append(b)
                role.append(0 if own else 1)

            whole, mixed = batch.column("blocks").to_pylist(), batch.column("mixed").to_pylist()
            for key, at in _by_label(batch):
                if key not in known:
                    homes, blocks, reach = [0] * len(at), {0: whole[at[0]]}, []
                else:
                    blocks, far, tops = known[key]
                    rows = unit(matrix(batch.column("embedding").take(pa.array(at))))
                    homes = cells[key].home(rows)[0].tolist()
                    reach = zip(*(x.tolist() for x in cells[key].visits(rows, r, far, tops)))
                for k, home in zip(at, homes):
                    own = mixed[k] % blocks[home]
                    for b in range(blocks[home]):
                        if b == own or _visits(own, b):
                            put(k, home, b, b == own)
                for k, c in reach:
                    if c != homes[k] and c in blocks and _visits(homes[k], c):
                        for b in range(blocks[c]):
                            put(at[k], c, b, False)
            got = batch.select(fields.split(", ")).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(cell, pa.int64()), pa.array(block, pa.int64()), pa.array(role, pa.int32())], names=[*fields.split(", "), "cell", "block", "role"])

    def join(batches):
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        give = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("node", "links", "root"), x)) for x in rows], schema=schema)
        block, opened, last = None, False, None
        for key, new, part in runs(batches, ["label", "dim", "cell", "block", "role"]):
            if key[:4] != last:
                if block is not None:
                    if opened:
                        block.close()
                    yield give(block.end())
                block, opened, last = _Block(cosine), True, key[:4]
            if key[4] == 0:
                block.add(part)
                continue
            if opened:
                if not block.parts:  # nobody is at home in this block
                    block = None
                    last = key[:4]
                    opened = False
                    continue
                block.close()
                opened = False
            if block is not None:
                for first in range(0, part.num_rows, BLOCK_ROWS):
                    yield give(block.meet(part.slice(first, BLOCK_ROWS)))
        if block is not None:
            if opened:
                block.close()
            yield give(block.end())

    sized = distinct.join(sizes.select("label", "dim", F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("blocks")), ["label", "dim"])
    dealt = sized.withColumn("mixed", F.pmod(F.xxhash64("node"), F.lit(1 << 40))).mapInArrow(deal, f"{ddl}, cell long, block long, role int")
    group = ["label", "dim", "cell", "block"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "role").mapInArrow(join, "node long, links long, root long")


def embedding_neardup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null, their vectors have one length and their cosine
    is at least `cosine`. Vectors that are null, zero or hold null or non-finite components link with
    nothing: 0 links, themselves the component, kept. Equal vectors count as links of one another;
    repeated rows are rows of their own. A row without id takes part, but names no component that has
    other rows. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    valid = rows.where(F.col("label").isNotNull() & usable("embedding"))
    distinct = checkpointed(
        valid.groupBy("label", "embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep")).select("label", F.size("embedding").alias("dim"), "embedding", F.monotonically_increasing_id().alias("node"), "m", "rep")
    )
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
    found = checkpointed(range_join(distinct.drop("rep"), sizes, cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")).where("src <> dst"))
    named = distinct.select("node", "m", "rep").join(links, "node", "left").join(parts, "node", "left").select("node", "m", "rep", "links", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    known = named.join(least, "part").select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    known = distinct.select("label", "embedding", "node").join(known, "node").drop("node").withColumn("linked", F.lit(True))
    out = rows.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    )
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of `embeddings`, as embedding_neardup states (nulls, ties, repeated rows, empty tables: see there)."""
    return embedding_neardup(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
