"""Approximate nearest neighbours by inner product: an adaptive dimension scan over probed lists.

The index is fitted on a bounded sample: list centres (k-means), a random rotation and the number of
lists to probe, the smallest that finds RECALL of the sample's own neighbours. Every row is indexed.
Within a list, rotated vectors lie in column blocks. A larger inner product means a smaller distance
once the norms are known, so the 20th best product of a query, with the sample at first, then with the rows it
holds, is for each candidate a bound on the distance. After each column block the partial distance, scaled by D/d, estimates the whole
one; as the rotation is random, its error after d dimensions is of the order of 1/sqrt(d), and a
candidate is abandoned when the hypothesis that it is near enough can be rejected. Survivors are
scored exactly, on the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siteloom.llm.vectors import bounded_sample, matrix, runs, usable
from siteloom.session import checkpointed, ship, table

#: Rows on which the index is fitted.
SAMPLE_ROWS = 8192
#: Rows for which one more list is made, and sampled rows that a list is fitted on at least.
LIST_ROWS, LIST_SAMPLE = 2048, 8
#: Rows of a list that one group scans; a larger list is cut in more groups.
BLOCK_ROWS = 4096
#: Share of the sample's true neighbours that the probed lists must hold.
RECALL = 0.97
#: Dimensions of a column block, and the width of the test in units of 1/sqrt(dimensions).
COLUMNS, WIDTH = 16, 2.1
#: Candidates between two updates of a query's bound, and queries scanned at once.
STEP, QUERIES = 1024, 256


def _centres(rows: np.ndarray, k: int, rng) -> np.ndarray:
    got = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(12):
        near = ((got**2).sum(1)[None, :] - 2 * rows @ got.T).argmin(1)
        for c in range(k):
            if (own := near == c).any():
                got[c] = rows[own].mean(0)
    return got


class Index:
    """What the sample tells: centres, rotation, lists to probe, and the sample for first bounds. own: row numbers."""

    def __init__(self, own: np.ndarray, rows: np.ndarray, total: int, k: int):
        rng = np.random.default_rng(7)
        self.own, self.rows, self.k = own, rows, k
        lists = int(min(max(1, round(total / LIST_ROWS)), max(1, len(rows) // LIST_SAMPLE)))
        self.centres = _centres(rows, lists, rng)
        self.rotation = np.linalg.qr(rng.standard_normal((rows.shape[1],) * 2))[0]
        home = self.lists(rows)
        self.blocks = np.maximum(1, np.ceil(np.bincount(home, minlength=lists) / len(rows) * total / BLOCK_ROWS)).astype(int)
        some = rng.choice(len(rows), min(256, len(rows)), replace=False)
        self.probes = lists
        if lists > 1:
            got = rows[some] @ rows.T
            got[np.arange(len(some)), some] = -np.inf
            true = home[np.argsort(-got, axis=1)[:, :k]]
            place = np.argsort(np.argsort(-(rows[some] @ self.centres.T), axis=1), axis=1)
            needed = np.take_along_axis(place, true, 1)
            self.probes = next(p for p in range(1, lists + 1) if (needed < p).mean() >= RECALL or p == lists)

    def lists(self, rows: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1)[None, :] - 2 * rows @ self.centres.T).argmin(1)

    def first_bounds(self, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A product that at least k sampled rows other than the query (told by row number) reach."""
        got = rows @ self.rows.T
        got[own[:, None] == self.own[None, :]] = -np.inf
        return np.partition(got, got.shape[1] - self.k, axis=1)[:, -self.k] if got.shape[1] > self.k else np.full(len(rows), -np.inf)

    def blocks_of(self, home: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A block of the list for each row, by a hash of its number."""
        h = own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(20)) % self.blocks[home].astype(np.uint64)).astype(np.int64)


class Scan:
    """One block of a list: its rows, rotated and cut in column blocks."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, index: Index):
        self.own, self.ids, self.rows, self.k, self.rotation = own, ids, rows, index.k, index.rotation
        self.columns = [slice(a, min(a + COLUMNS, rows.shape[1])) for a in range(0, rows.shape[1], COLUMNS)]
        turned = rows @ index.rotation
        self.parts = [np.ascontiguousarray(turned[:, c]) for c in self.columns]
        self.squares = (rows * rows).sum(1)

    def _survivors(self, parts: list[np.ndarray], squares: np.ndarray, bound: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row - a) whose partial distances never rejected that they reach the bound."""
        limit = self.squares[None, a:b] + squares[:, None] - 2 * bound[:, None]  # squared distance that reaches the bound
        dims, done = self.rows.shape[1], 0
        q = x = far = None
        for part, own, c in zip(parts, self.parts, self.columns):
            own, done = own[a:b], c.stop
            if q is None:
                step = (part**2).sum(1)[:, None] + (own**2).sum(1)[None, :] - 2 * part @ own.T
                far = step if far is None else far + step
            else:
                far = far + ((part[q] - own[x]) ** 2).sum(1)
            if done < dims:
                rejected = far * (dims / done) > limit * (1 + WIDTH / np.sqrt(done)) ** 2
            else:
                rejected = far > limit + 1e-9 * (1 + np.abs(limit))
            if q is None and (done == dims or rejected.mean() > 0.7):
                q, x = np.nonzero(~rejected)
                far, limit = far[q, x], limit[q, x]
            elif q is not None:
                keep = ~rejected
                q, x, far, limit = q[keep], x[keep], far[keep], limit[keep]
        return q, x

    def search(self, own: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query's row number, candidate's row number, its id, score): for each query the k best of this block that reach its bound."""
        turned = rows @ self.rotation
        parts, squares = [turned[:, c] for c in self.columns], (rows * rows).sum(1)
        best, found, which = np.full((len(own), self.k), -np.inf), np.full((len(own), self.k), np.iinfo(np.int64).max), np.full((len(own), self.k), -1)
        for a in range(0, len(self.ids), STEP):
            b = min(a + STEP, len(self.ids))
            q, x = self._survivors(parts, squares, np.maximum(bound, best[:, -1]), a, b)
            other = self.own[x + a] != own[q]
            q, x = q[other], x[other]
            if not len(q):
                continue
            exact = (self.rows[x + a] * rows[q]).sum(1)
            use, at = np.unique(q, return_inverse=True)
            place = np.arange(len(q)) - np.searchsorted(q, q)  # q is in order
            scores = np.full((len(use), place.max() + 1), -np.inf)
            names, rows_of = np.full(scores.shape, np.iinfo(np.int64).max), np.full(scores.shape, -1)
            scores[at, place], names[at, place], rows_of[at, place] = exact, self.ids[x + a], self.own[x + a]
            scores, names, rows_of = np.hstack([best[use], scores]), np.hstack([found[use], names]), np.hstack([which[use], rows_of])
            order = np.lexsort((names, -scores), axis=-1)[:, : self.k]
            best[use], found[use], which[use] = (np.take_along_axis(c, order, 1) for c in (scores, names, rows_of))
        got = np.isfinite(best)
        return own[np.nonzero(got)[0]], which[got], found[got], best[got]


def _searched(rows: DataFrame, asked: DataFrame, index, everywhere: bool) -> DataFrame:
    """(query long, own long, vec_id, score) of the rows found for the asked rows (own, id, embedding); everywhere: in all lists, without the sample's bounds."""
    kind = rows.schema["embedding"].dataType.simpleString()

    def deal(asks: bool):
        def run(batches):
            ix: Index = index.value
            probes = len(ix.centres) if everywhere else ix.probes
            for batch in batches:
                for first in range(0, batch.num_rows, 2048):
                    part = batch.slice(first, 2048)
                    own, vectors = part.column("own").to_numpy(), matrix(part.column("embedding"))
                    if asks:
                        probed = np.argsort(-(vectors @ ix.centres.T), axis=1, kind="stable")[:, :probes]
                        at, lists = np.repeat(np.arange(len(own)), probed.shape[1]), probed.ravel()
                        many = ix.blocks[lists]
                        block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        at, lists = np.repeat(at, many), np.repeat(lists, many)
                        bound = np.full(len(at), -np.inf) if everywhere else ix.first_bounds(own, vectors)[at]
                    else:
                        at, lists = np.arange(len(own)), ix.lists(vectors)
                        block, bound = ix.blocks_of(lists, own), np.zeros(len(own))
                    got = part.select(["own", "id", "embedding"]).take(pa.array(at))
                    more = [lists.astype(np.int64), block.astype(np.int64), np.full(len(at), int(asks)), bound]
                    yield pa.RecordBatch.from_arrays([*got.columns, *map(pa.array, more)], names=["own", "id", "embedding", "list", "block", "role", "bound"])

        return run

    def scan(batches):
        schema = pa.schema([("query", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        scanner, held, last = None, [], None
        for key, _, part in runs(batches, ["list", "block", "role"]):
            if key[:2] != last:
                scanner, held, last = None, [], key[:2]
            if key[2] == 0:
                held.append(part)
                continue
            if scanner is None:
                if not held:
                    continue
                scanner = Scan(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("own", "id")), np.concatenate([matrix(h.column("embedding")) for h in held]), index.value)
                held = held[:1]
            for first in range(0, part.num_rows, QUERIES):
                some = part.slice(first, QUERIES)
                found = scanner.search(some.column("own").to_numpy(), matrix(some.column("embedding")), some.column("bound").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(found, schema)], schema=schema)

    ddl = f"own long, id long, embedding {kind}, list long, block long, role long, bound double"
    dealt = rows.mapInArrow(deal(False), ddl).unionByName(asked.mapInArrow(deal(True), ddl))
    return dealt.repartition("list", "block").sortWithinPartitions("list", "block", "role").mapInArrow(scan, "query long, own long, vec_id long, score double")


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank int, vec_id, score) of the k rows with the largest inner product for each query.

    is_query: Column on id_col. All rows are candidates but the query's own row; rows that share an id are
    rows of their own, as queries and as candidates. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without id, as no result could name them. Vectors of different
    lengths have no product: each length is searched by itself, with an index of its own. A query that finds
    fewer than k rows in the lists probed looks into all lists, without first bounds; fewer candidates than k give fewer rows.
    Ties go to the smaller id. An empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding")).where(F.col("id").isNotNull() & usable("embedding"))
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("own"), "id", "embedding", F.size("embedding").alias("dim")))
    sizes = rows.groupBy("dim").count().orderBy("dim").collect()  # one row for each length of vectors
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, total in sizes:
        same = rows.where(F.col("dim") == dim).drop("dim")
        sample = bounded_sample(same, ["own", "embedding"], "own", SAMPLE_ROWS)
        index = spark.sparkContext.broadcast(Index(np.array([r.own for r in sample], np.int64), np.array([r.embedding for r in sample], np.float64), total, k))
        asked = same.where(F.coalesce(is_query(F.col("id")), F.lit(False)))
        found = checkpointed(_searched(same, asked, index, False))
        if total > 1:
            held = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
            short = checkpointed(asked.join(held, F.col("own") == F.col("query"), "left_anti"))
            if short.limit(1).count():
                more = _searched(same, short, index, True)
                found = found.join(short.select(F.col("own").alias("query")), "query", "left_anti").unionByName(more)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "own"))).where(F.col("rank") <= k)
        named = ranked.join(asked.select(F.col("own").alias("query"), F.col("id").alias("query_id")), "query")
        out = out.unionByName(named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector of `embeddings` whose vec_id is divisible by 20, as nearest states (nulls, ties, repeated rows, empty tables: see there)."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
