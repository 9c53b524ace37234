"""Exact top-k by inner product of vectors with integer components: best-first search in an M-tree.

An inner product isn't a metric. With M the largest norm of all rows, each row x gets one component more,
sqrt(M*M - |x|*|x|), and a query q a zero; then |q - x|**2 = |q|**2 + M**2 - 2 * (q, x), so the nearest rows are those
with the largest products, and the triangle inequality holds. The tree has the usual parts: routing
objects (rows), covering radii, and for each entry the distance to its parent's routing object. Its upper nodes
are fitted on a bounded sample and broadcast; their radii cover all rows. Below, the rows of a
region are cut in pages by their distance to its routing object; a page is a subtree that one task builds.
A query first visits the page that may hold the nearest rows, and then only pages that can hold better ones than found there.
Within a page nodes wait in a queue by the least distance they can hold. Distances only prune, with a margin for rounding; scores are whole numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siteloom.llm.vectors import bounded_sample, runs
from siteloom.session import broadcast_if_small, checkpointed, ship, table

#: A component x of a vector counts as floor(SCALE * x).
SCALE = 1024
#: Rows on which the upper nodes are fitted, rows for which there is one more region, and the most regions of a vector length.
SAMPLE_ROWS, REGION_ROWS, MOST_REGIONS = 8192, 4096, 1024
#: Rows of a page, about, rings by distance that a region's rows are counted in, and queries that a task holds against a page.
PAGE_ROWS, RINGS, QUERY_ROWS = 8192, 256, 8192
#: Entries of an inner node and rows of a leaf.
FANOUT, LEAF_ROWS = 16, 128
#: Rounding margin of distances as a share of the largest norm.
MARGIN = 1e-6
#: Largest squared norm for which products are exact in double precision, and in 64 bits.
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**62


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch, all of dim components, as whole numbers (in doubles)."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).reshape(batch.num_rows, dim)


def products(rows: np.ndarray, others: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers, exact as long as no squared norm exceeds `most`."""
    if most < EXACT_DOUBLE:
        return (rows @ others.T).astype(np.int64)
    return rows.astype(np.int64) @ others.astype(np.int64).T


def lifted(rows: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that gives all of them the norm sqrt(most)."""
    return np.hstack([rows, np.sqrt(np.maximum(0, most - (rows * rows).sum(1)))[:, None]])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all a from all b."""
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def medoids(points: np.ndarray, k: int) -> np.ndarray:
    """Places of at most k points, each the one nearest to the mean of those around it."""
    rng = np.random.default_rng(11)
    means = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(4):
        home = apart(points, means).argmin(1)
        sums = np.zeros_like(means)
        np.add.at(sums, home, points)
        n = np.bincount(home, minlength=len(means))
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return np.unique(apart(points, means).argmin(0))


# --- the upper nodes


class Upper:
    """Two levels of routing objects, fitted on some points. A region is what hangs on one of the lower level."""

    def __init__(self, points: np.ndarray, regions: int):
        self.routers = points[medoids(points, regions)]
        self.heads = self.routers[medoids(self.routers, max(1, round(len(self.routers) ** 0.5)))]
        far = apart(self.routers, self.heads)
        self.home = far.argmin(1)
        self.parent = far[np.arange(len(far)), self.home]

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region of each point and its distance to the routing object: the nearest head's nearest entry."""
        head = apart(points, self.heads).argmin(1)
        region, far = np.zeros(len(points), np.int64), np.zeros(len(points))
        for h in np.unique(head):
            own, entries = np.flatnonzero(head == h), np.flatnonzero(self.home == h)
            d = apart(points[own], self.routers[entries])
            at = d.argmin(1)
            region[own], far[own] = entries[at], d[np.arange(len(own)), at]
        return region, far

    def cover(self, radius: np.ndarray) -> None:
        """radius of each region over all rows; negative: it holds none."""
        self.radius = radius
        reach = np.where(radius < 0, -np.inf, self.parent + radius)
        self.reach = np.array([reach[self.home == h].max(initial=-np.inf) for h in range(len(self.heads))])

    def near(self, queries: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(queries, region, distance to its routing object) of the regions that may hold rows within each query's limit."""
        far = apart(queries, self.heads)
        for h in range(len(self.heads)):
            open_ = np.flatnonzero(far[:, h] - self.reach[h] <= limit)
            for r in np.flatnonzero((self.home == h) & (self.radius >= 0)):
                some = open_[np.abs(far[open_, h] - self.parent[r]) - self.radius[r] <= limit[open_]]  # by the stored distance
                d = apart(queries[some], self.routers[r : r + 1])[:, 0]
                hit = d - self.radius[r] <= limit[some]
                if hit.any():
                    yield some[hit], int(r), d[hit]


# --- a page


class Node:
    """An inner node has child nodes with their routing objects and radii, a leaf has rows; parent: distances of these to the node's own routing object."""

    __slots__ = ("children", "routers", "radius", "rows", "parent")


class Page:
    """An M-tree over some rows. computed and skipped count rows whose product was computed, or avoided."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: float):
        self.own, self.ids, self.rows, self.most = own, ids, rows, most
        self.margin = MARGIN * np.sqrt(most)
        self.points = lifted(rows, most)
        self.router = self.points[:1].mean(0)
        self.root, self.radius = self._node(np.arange(len(ids)), self.router)
        self.computed = self.skipped = 0

    def _node(self, rows: np.ndarray, router: np.ndarray) -> tuple[Node, float]:
        node = Node()
        far = apart(self.points[rows], router[None, :])[:, 0]
        if len(rows) > LEAF_ROWS:
            picks = self.points[rows[medoids(self.points[rows], FANOUT)]]
            home = apart(self.points[rows], picks).argmin(1)
            if len(parts := np.unique(home)) > 1:
                node.rows = None
                made = [self._node(rows[home == p], picks[p]) for p in parts]
                node.children, node.radius = [m[0] for m in made], np.array([m[1] for m in made])
                node.routers = picks[parts]
                node.parent = apart(node.routers, router[None, :])[:, 0]
                return node, far.max()
        node.rows, node.parent = rows, far  # equal rows stay in one leaf, however many
        return node, far.max()

    def search(self, own: int, query: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows but the query's own with a score of at least bound; ties go to the smaller id."""
        lifted_query, square = np.append(query, 0.0), float(query @ query) + self.most
        best, places = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def limit() -> float:
            least = max(bound, float(best[-1])) if len(best) == k else bound
            return np.inf if least == -np.inf else np.sqrt(max(0.0, square - 2 * least)) + self.margin

        d = float(apart(lifted_query[None, :], self.router[None, :])[0, 0])
        queue, turn = [(max(0.0, d - self.radius), 0, self.root, d)], 0
        while queue:
            least, _, node, d = heapq.heappop(queue)
            reach = limit()
            if least > reach:
                break
            if node.rows is None:
                some = np.flatnonzero(np.abs(d - node.parent) - node.radius <= reach)
                to = apart(lifted_query[None, :], node.routers[some])[0]
                for c, x in zip(some[(hit := to - node.radius[some] <= reach)], to[hit]):
                    heapq.heappush(queue, (max(least, x - node.radius[c]), turn := turn + 1, node.children[c], x))
                continue
            some = node.rows[np.abs(d - node.parent) <= reach]
            self.computed += len(some)
            self.skipped += len(node.rows) - len(some)
            scores = products(self.rows[some], query[None, :], self.most)[:, 0]
            good = (scores >= bound) & (self.own[some] != own)
            scores, some = np.concatenate([best, scores[good]]), np.concatenate([places, some[good]])
            order = np.lexsort((self.own[some], self.ids[some], -scores))[:k]
            best, places = scores[order], some[order]
        return places, best


# --- the search


def _usable(col: str) -> Column:
    """Whether the vector is there and has only finite components."""
    return F.coalesce(F.forall(F.col(col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for first in range(0, len(at), 2048):
                yield int(dim), batch.take(pa.array(at[first : first + 2048]))


def _regions(rows: DataFrame, shared, most: float) -> DataFrame:
    """rows with region and far, the distance to its routing object; of a length that the sample doesn't hold all rows are region 0, at 0."""

    def run(batches):
        for dim, part in _by_length(batches):
            upper = shared.value.get(dim)
            region, far = upper.place(lifted(whole(part, dim), most)) if upper else (np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region), pa.array(far)], names=[*part.schema.names, "region", "far"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", region long, far double")


def _paged(placed: DataFrame) -> DataFrame:
    """placed with page: rows of a region, in rings of about PAGE_ROWS; a ring's part that is larger still, as of equal rows, is cut by row number."""
    key = ["dim", "region"]
    ends = placed.groupBy(*key).agg(F.min("far").alias("lo"), F.max("far").alias("hi"))
    at = placed.join(broadcast_if_small(ends), key)
    at = at.withColumn("ring", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(RINGS - 1), F.floor((F.col("far") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RINGS))).otherwise(F.lit(0)).cast("int")).drop("lo", "hi")
    counts = at.groupBy(*key, "ring").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("ring").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")  # RINGS rows at most
    cut = counts.select(*key, "ring", F.floor(before / PAGE_ROWS).alias("first"), F.ceil(F.col("n") / PAGE_ROWS).alias("parts"))
    return at.join(broadcast_if_small(cut), [*key, "ring"]).withColumn("page", F.col("first") * F.lit(1 << 24) + F.pmod(F.xxhash64("own"), F.col("parts"))).drop("ring", "first", "parts")


def _asked(queries: DataFrame, shared, most: float, k: int) -> DataFrame:
    """(own, dim, region, far, square, bound): the regions that a query may have to visit, with a score that k sampled rows reach."""

    def run(batches):
        uppers, samples = shared.value
        margin = MARGIN * np.sqrt(most)
        schema = pa.schema([("own", pa.int64()), ("dim", pa.int32()), ("region", pa.int64()), ("far", pa.float64()), ("square", pa.float64()), ("bound", pa.float64())])
        for dim, part in _by_length(batches):
            own, rows = part.column("own").to_numpy(), whole(part, dim)
            square, bound = (rows * rows).sum(1) + most, np.full(len(rows), -np.inf)
            upper = uppers.get(dim)
            if upper:
                names, sampled = samples[dim]
                if len(names) > k:
                    got = products(rows, sampled, most).astype(np.float64)
                    got[own[:, None] == names[None, :]] = -np.inf
                    bound = np.partition(got, got.shape[1] - k, axis=1)[:, -k]
                    bound -= 1e-9 * np.abs(bound)
                limit = np.sqrt(np.maximum(0, square - 2 * bound)) + margin
                found = list(upper.near(np.hstack([rows, np.zeros((len(rows), 1))]), limit))
            else:
                found = [(np.arange(len(rows)), 0, np.zeros(len(rows)))]
            for at, region, far in found:
                cols = [own[at], np.full(len(at), dim), np.full(len(at), region), far, square[at], bound[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return queries.mapInArrow(run, "own long, dim int, region long, far double, square double, bound double")


def _searched(paged: DataFrame, queries: DataFrame, visits: DataFrame, most: float, k: int) -> DataFrame:
    """(own, query_id, vec_id, other, score): the best rows of each page for the queries (own, bound) that visit it.

    A page's queries are cut in parts as well, so that a task holds about PAGE_ROWS rows against QUERY_ROWS queries."""
    key = ["dim", "region", "page"]
    tiles = broadcast_if_small(visits.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("tiles")))
    cols = ["own", "id", "embedding", *key, "tile", "role", "bound"]
    held = paged.join(tiles, key).select("own", "id", "embedding", *key, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("role"), F.lit(0.0).alias("bound"))
    asks = visits.join(tiles, key).join(queries.select("own", "id", "embedding"), "own").select("own", "id", "embedding", *key, F.pmod(F.xxhash64("own"), F.col("tiles")).cast("int").alias("tile"), F.lit(1).alias("role"), "bound")
    sent = held.unionByName(asks).select(*cols).repartition(*key, "tile").sortWithinPartitions(*key, "tile", "role")

    def scan(batches):
        schema = pa.schema([("own", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
        page, rows, last = None, [], None
        for tile, _, part in runs(batches, [*key, "tile", "role"]):
            if tile[:4] != last:
                page, rows, last = None, [], tile[:4]
            if tile[4] == 0:
                rows.append(part)
                continue
            if page is None:
                if not rows:
                    continue
                page = Page(*(np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("own", "id")), np.concatenate([whole(r, tile[0]) for r in rows]), most)
                rows = rows[:1]
            own, ids, bound, vectors = part.column("own").to_numpy(), part.column("id").to_numpy(), part.column("bound").to_numpy(), whole(part, tile[0])
            found = [page.search(own[j], vectors[j], bound[j], k) for j in range(part.num_rows)]
            n = np.array([len(f[0]) for f in found], np.int64)
            places, scores = (np.concatenate([f[c] for f in found]).astype(np.int64) for c in (0, 1))
            got = [np.repeat(own, n), np.repeat(ids, n), page.ids[places], page.own[places], scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, schema)], schema=schema)

    return sent.mapInArrow(scan, "own long, query_id long, vec_id long, other long, score long")


def top_products(df: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank int, vec_id, score long) of the k rows with the largest inner product for each query, exactly.

    Components count as floor(SCALE * x). is_query: Column on id_col. All rows are candidates but the query's own row; rows that share
    an id are rows of their own, as queries and as candidates. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without id, as no result could name them; zero vectors do. Vectors of different
    lengths have no product and don't meet. Ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives no
    rows; other columns are left out. Vectors so long that a score could leave 64 bits (norm from 2**31 on) are an error.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding")).where(F.col("id").isNotNull() & _usable("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("own"), "id", "embedding", F.size("embedding").alias("dim"), square.alias("square")))
    total, most = rows.agg(F.count("*"), F.coalesce(F.max("square"), F.lit(0.0))).first()
    if most >= EXACT_LONG:
        raise ValueError("vectors are too long for scores of 64 bits")
    most = float(most) * (1 + 1e-12)
    rows = rows.drop("square")
    sample = bounded_sample(rows, ["own", "embedding", "dim"], "own", SAMPLE_ROWS)
    uppers, samples = {}, {}
    for dim in {r.dim for r in sample if r.dim}:
        own = np.array([r.own for r in sample if r.dim == dim], np.int64)
        vectors = np.floor(SCALE * np.array([r.embedding for r in sample if r.dim == dim], np.float64))
        regions = min(MOST_REGIONS, max(1, round(total * len(own) / len(sample) / REGION_ROWS)), max(1, len(own) // 8))
        uppers[dim], samples[dim] = Upper(lifted(vectors, most), regions), (own, vectors)
    placed = checkpointed(_regions(rows, spark.sparkContext.broadcast(dict(uppers)), most))
    for dim, upper in uppers.items():
        upper.cover(np.full(len(upper.routers), -1.0))
    for r in placed.where(F.col("dim").isin(list(uppers))).groupBy("dim", "region").agg(F.max("far").alias("radius")).collect():  # MOST_REGIONS for each sampled length, SAMPLE_ROWS / 8 at most in all
        uppers[r.dim].radius[r.region] = r.radius
    for upper in uppers.values():
        upper.cover(upper.radius)
    paged = checkpointed(_paged(placed))
    pages = paged.groupBy("dim", "region", "page").agg(F.min("far").alias("lo"), F.max("far").alias("hi"))
    queries = checkpointed(rows.where(F.coalesce(is_query(F.col("id")), F.lit(False))))
    asked = _asked(queries, spark.sparkContext.broadcast((uppers, samples)), most, k)
    least = F.greatest(F.lit(0.0), F.col("far") - F.col("hi"), F.col("lo") - F.col("far")) - F.lit(MARGIN * most**0.5)
    could = (F.col("square") - F.pow(F.greatest(F.lit(0.0), least), F.lit(2.0))) / 2 * F.lit(1 + 1e-9) + 1e-3
    visits = asked.join(pages, ["dim", "region"]).select("own", "dim", "region", "page", "bound", least.alias("least"), could.alias("could"))
    visits = checkpointed(visits.where("could >= bound"))
    ahead = visits.groupBy("own").agg(F.min(F.struct("least", "dim", "region", "page")).alias("v"), F.first("bound").alias("bound")).select("own", "v.dim", "v.region", "v.page", "bound")
    first = checkpointed(_searched(paged, queries, ahead, most, k))
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "other")
    reached = first.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("own", F.col("score").cast("double").alias("reached"))
    rest = visits.join(ahead.select("own", "dim", "region", "page"), ["own", "dim", "region", "page"], "left_anti").join(reached, "own", "left")
    rest = rest.withColumn("bound", F.greatest("bound", F.coalesce("reached", F.lit(float("-inf"))))).where("could >= bound").select("own", "dim", "region", "page", "bound")
    found = first.unionByName(_searched(paged, queries, checkpointed(rest), most, k))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of every vector of `embeddings` whose vec_id is divisible by 100, as top_products states (nulls, ties, repeated rows, empty tables: see there)."""
    return top_products(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
