"""Abundance by fragment lengths: how many cells a site stands for, if lengths collide.

A published estimator: with phi the chance of a length and theta the abundance of a site, a length is
seen at a site with probability 1 - exp(-theta * phi). Expectation-maximisation alternates a Newton step on theta and a
smoothed phi. phi is one number for each length and lives on the driver; theta is one for each site. Samples of up to
TOGETHER pairs of site and length are estimated in one task each, larger ones over many tasks, by the same rules: a site is a row there, with
its lengths, and a round is a pass over these rows that sends back sums by length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siteloom.session import checkpointed, ship

#: Pairs of site and length of a sample that one task estimates.
TOGETHER = 1_000_000
#: Rounds at least and at most, and what the largest gradient, as it is and by its theta, may be at the end.
LEAST_ROUNDS, MOST_ROUNDS, MOST_GRADIENT, MOST_SHARE = 3, 2000, 0.01, 1e-6
#: Empty lengths that follow the last one in the fit of phi, and the smallest fitted value.
PADDING, LEAST_FIT = 9, 1e-5
#: Terms of the curvature that are computed at once.
TERMS = 1 << 20

_EPS = np.finfo(float).eps


# --- phi


def basis(x: np.ndarray, knots: list[float], degree: int) -> np.ndarray:
    """B-splines of a degree at x, with the given inner knots."""
    low, high = x.min(), x.max()
    t = np.concatenate([np.full(degree + 1, low), np.sort(np.asarray(knots, float)), np.full(degree + 1, high)])
    b = ((x[:, None] >= t[None, :-1]) & (x[:, None] < t[None, 1:])).astype(float)
    b[x == high, np.flatnonzero(t[:-1] < t[1:])[-1]] = 1
    for d in range(1, degree + 1):
        left, right = t[d:-1] - t[: -d - 1], t[d + 1 :] - t[1:-d]
        up = np.where(left > 0, (x[:, None] - t[None, : -d - 1]) / np.where(left > 0, left, 1), 0)
        down = np.where(right > 0, (t[None, d + 1 :] - x[:, None]) / np.where(right > 0, right, 1), 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def splines(x: np.ndarray, seen: np.ndarray) -> list[tuple[list[float], int]]:
    """(inner knots, degree) to try, one after the other, for lengths numbered x of which `seen` aren't empty."""
    n = len(seen)
    if n <= 3:
        first = [], min(max(1, n - 1), 2)
    elif n <= 10:
        first = [int(np.median(seen))], 2
    else:
        first = [int(k) for k in np.percentile(seen, [25, 75] if n < 20 else [20, 50, 80])], 3
    span = int(x.max() - x.min())
    return [first] + ([([x.min() + span // 3, x.min() + 2 * span // 3], 3)] if span > 10 else [])


def poisson_fit(y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Means of a Poisson regression of y on b with logarithmic link, by reweighted least squares until the deviance stands still.
    A dispersion doesn't change them."""
    mu = (y + y.mean()) / 2
    eta, before = np.log(mu), np.inf
    for _ in range(100):
        root = np.sqrt(mu)
        beta = np.linalg.lstsq(b * root[:, None], (eta + (y - mu) / mu) * root, rcond=None)[0]
        eta = b @ beta
        mu = np.exp(eta)
        deviance = 2 * (y * np.log(y / mu) - (y - mu)).sum()
        if not np.isfinite(deviance):
            raise ArithmeticError("no fit")
        if abs(deviance - before) <= 1e-12:
            break
        before = deviance
    return mu


def smooth(sums: np.ndarray) -> tuple[np.ndarray, bool]:
    """(phi, whether it is fitted): expected fragments of each length, smoothed over the lengths' numbers and brought to a sum of 1; the sums themselves where no fit works."""
    y = np.concatenate([sums, np.zeros(PADDING)]) + 1e-10
    x = np.arange(len(y), dtype=float)
    for knots, degree in splines(x, x[y > 1e-5]):
        try:
            with np.errstate(all="ignore"):
                fit = np.maximum(poisson_fit(y, basis(x, knots, degree)), LEAST_FIT)[: len(sums)]
            return fit / fit.sum(), True
        except (ArithmeticError, np.linalg.LinAlgError):
            continue
    return y[: len(sums)] / y[: len(sums)].sum(), False


# --- the two steps, on pairs (row: number of the length, site, x: fragments); lengths of a site that aren't among its pairs have x = 0


def expected(rate: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Expected fragments behind x that were seen at the rate phi * theta."""
    return x * rate / np.maximum(-np.expm1(-rate), _EPS)


def likelihood(rate: np.ndarray, x: np.ndarray, theta: np.ndarray, phi: np.ndarray) -> float:
    """Logarithm of the chance that just these pairs were seen. All other lengths of a site follow from its theta; pairs with several fragments don't count."""
    unseen = rate.sum() - theta.sum() * phi.sum()
    return float(unseen + np.log(np.maximum(-np.expm1(-rate[x == 1]), _EPS)).sum())


def curvature(theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Sum of phi**2 / (exp(phi * theta) - 1) over all lengths, seen or not, for each site."""
    out, step = np.empty(len(theta)), max(1, TERMS // max(1, len(phi)))
    for first in range(0, len(theta), step):
        with np.errstate(over="ignore"):
            out[first : first + step] = (phi[None, :] ** 2 / np.expm1(phi[None, :] * theta[first : first + step, None])).sum(1)
    return out


def newton(row: np.ndarray, site: np.ndarray, x: np.ndarray, theta: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(theta after one step, gradient) of each site."""
    rate = phi[row] * theta[site]
    grad = np.bincount(site, x * phi[row] / np.maximum(-np.expm1(-rate), _EPS), len(theta)) - phi.sum()
    return np.maximum(theta + grad / curvature(theta, phi), _EPS), grad


class Held:
    """A sample in one task."""

    def __init__(self, row: np.ndarray, site: np.ndarray, x: np.ndarray):
        self.row, self.site, self.x = row, site, x.astype(float)
        self.theta = np.bincount(site, self.x)

    def sums(self) -> np.ndarray:
        """Fragments by length."""
        return np.bincount(self.row, self.x)

    def start(self, phi: np.ndarray) -> np.ndarray:
        """theta becomes the expected fragments; these by length."""
        y = expected(phi[self.row] * self.theta[self.site], self.x)
        self.theta = np.bincount(self.site, y)
        return np.bincount(self.row, y)

    def step(self, phi: np.ndarray) -> dict:
        """Tries a Newton step. Largest gradient and its share of the new and the old theta, the new likelihood, and the expected fragments by length under both."""
        self.tried, grad = newton(self.row, self.site, self.x, self.theta, phi)
        new, old = (phi[self.row] * t[self.site] for t in (self.tried, self.theta))
        share = lambda t: float(np.abs(grad / np.maximum(np.abs(t), 1e-10)).max())
        return {"grad": float(np.abs(grad).max()), "share": (share(self.tried), share(self.theta)), "likelihood": likelihood(new, self.x, self.tried, phi), "sums": tuple(np.bincount(self.row, expected(r, self.x)) for r in (new, old))}

    def keep(self, new: bool) -> None:
        self.theta = self.tried if new else self.theta

    def likelihood(self, phi: np.ndarray) -> float:
        return likelihood(phi[self.row] * self.theta[self.site], self.x, self.theta, phi)


class Spread:
    """A sample over many tasks: rows (site, rows array<int>, xs array<double>), one for each site, with a theta that each step writes anew."""

    def __init__(self, sites: DataFrame, lengths: int):
        self.lengths = lengths
        self.state = checkpointed(sites.withColumn("theta", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)))

    @staticmethod
    def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(batch.column("rows").offsets.to_numpy())
        return batch.column("rows").flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), batch.column("xs").flatten().to_numpy()

    def _with(self, change) -> DataFrame:
        """The state with column tried, as change(row, site, x, theta) gives it, and grad."""

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    got = change(*Spread._pairs(batch), batch.column("theta").to_numpy())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("site", "rows", "xs", "theta")), *map(pa.array, got)], names=["site", "rows", "xs", "theta", "tried", "grad"])

        return checkpointed(self.state.select("site", "rows", "xs", "theta").mapInArrow(run, "site long, rows array<int>, xs array<double>, theta double, tried double, grad double"))

    def _summed(self, df: DataFrame, of) -> np.ndarray:
        """of(row, site, x, batch) of all batches added up: an array of floats. Tasks add up their own first, one row for each number leaves them."""

        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    got = of(*Spread._pairs(batch), batch)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

        rows = df.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a few numbers for each length
        out = np.zeros(len(rows))
        for r in rows:
            out[r.k] = r.v
        return out

    def sums(self) -> np.ndarray:
        n = self.lengths
        return self._summed(self.state, lambda row, site, x, _: np.bincount(row, x, n))

    def start(self, phi: np.ndarray) -> np.ndarray:
        def first(row, site, x, theta):
            got = np.bincount(site, expected(phi[row] * theta[site], x), len(theta))
            return got, got

        n = self.lengths
        sums = self._summed(self.state, lambda row, site, x, b: np.bincount(row, expected(phi[row] * b.column("theta").to_numpy()[site], x), n))
        self.state = self._with(first).drop("theta").withColumnRenamed("tried", "theta")
        return sums

    def step(self, phi: np.ndarray) -> dict:
        n = self.lengths
        self.next = self._with(lambda row, site, x, theta: newton(row, site, x, theta, phi))

        def both(row, site, x, batch):
            new, old = (batch.column(c).to_numpy() for c in ("tried", "theta"))
            rates = [phi[row] * t[site] for t in (new, old)]
            return np.concatenate([*(np.bincount(row, expected(r, x), n) for r in rates), [likelihood(rates[0], x, new, phi)]])

        got = self._summed(self.next, both)
        share = lambda c: F.max(F.abs(F.col("grad")) / F.greatest(F.abs(F.col(c)), F.lit(1e-10)))
        grad, *shares = self.next.agg(F.max(F.abs("grad")), share("tried"), share("theta")).first()
        return {"grad": grad, "share": tuple(shares), "likelihood": got[-1], "sums": (got[:n], got[n : 2 * n])}

    def keep(self, new: bool) -> None:
        self.state = self.next.select("site", "rows", "xs", F.col("tried" if new else "theta").alias("theta"))

    def likelihood(self, phi: np.ndarray) -> float:
        def of(row, site, x, batch):
            theta = batch.column("theta").to_numpy()
            return np.array([likelihood(phi[row] * theta[site], x, theta, phi)])

        return float(self._summed(self.state, of)[0])


def maximise(sample: Held | Spread, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, int, bool]:
    """(phi, rounds taken, whether it converged); theta is the sample's.

    A round tries a Newton step on theta and then a new phi, and keeps of each what raises the likelihood. It ends after LEAST_ROUNDS
    or more when the gradient is small enough, or when a round could keep neither.
    """
    sums = np.maximum(sample.sums(), _EPS)
    phi, fitted = smooth(sample.start(sums / sums.sum()))
    phi = np.maximum(phi, _EPS) / np.maximum(phi, _EPS).sum()
    best = -np.inf
    for k in range(1, rounds + 1):
        tried = sample.step(phi)
        up = bool(np.isfinite(tried["likelihood"]) and tried["likelihood"] > best)
        best = tried["likelihood"] if up else best
        sample.keep(up)
        new, fitted = smooth(tried["sums"][0 if up else 1])
        new = np.maximum(new, _EPS) / np.maximum(new, _EPS).sum()
        likely = sample.likelihood(new)
        better = bool(np.isfinite(likely) and likely > best)
        best, phi = (likely, new) if better else (best, phi)
        if not up and not better:
            return phi, k, False
        if k >= LEAST_ROUNDS and tried["grad"] <= MOST_GRADIENT and tried["share"][0 if up else 1] <= MOST_SHARE:
            return phi, k, fitted
    return phi, rounds, False


# --- tables


def length_matrix(sites: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, chrom, site_start, site_strand, length, n)"""
    return sites.groupBy(*by, "chrom", "site_start", "site_strand", (F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("n"))


_PLACE = ["chrom", "site_start", "site_strand"]


def first_round(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, place, theta, grad, next): of a length matrix the start of each theta, the expected fragments, and one Newton step from there, with phi
    the shares of the lengths, not smoothed. DataFrame aggregates only; a sample's lengths are joined to its sites for the curvature."""
    share = cells.groupBy(*by, "length").agg(F.sum("n").alias("m")).join(cells.groupBy(*by).agg(F.sum("n").alias("all")), by) if by else cells.groupBy("length").agg(F.sum("n").alias("m")).crossJoin(F.broadcast(cells.agg(F.sum("n").alias("all"))))
    phi = checkpointed(share.select(*by, "length", (F.col("m") / F.col("all")).alias("phi")))
    held = cells.join(phi, [*by, "length"])
    total = held.groupBy(*by, *_PLACE).agg(F.sum("n").alias("t"))
    rate = F.col("phi") * F.col("t")
    start = held.join(total, [*by, *_PLACE]).groupBy(*by, *_PLACE).agg(F.sum(F.col("n") * rate / (1 - F.exp(-rate))).alias("theta"))
    start = checkpointed(start)
    rate = F.col("phi") * F.col("theta")
    grad = held.join(start, [*by, *_PLACE]).groupBy(*by, *_PLACE, "theta").agg((F.sum(F.col("n") * F.col("phi") / (1 - F.exp(-rate))) - 1).alias("grad"))
    lists = phi.groupBy(*by).agg(F.array_sort(F.collect_list("phi")).alias("phis"))  # one number for each length
    at = grad.join(F.broadcast(lists), by) if by else grad.crossJoin(F.broadcast(lists))
    bend = F.aggregate("phis", F.lit(0.0), lambda s, p: s + p * p / (F.exp(p * F.col("theta")) - 1))
    # where all of exp(phi * theta) pass the doubles the curvature is zero, and the step as long as doubles can say
    step = lambda b: F.when(b != 0, F.try_divide(F.col("grad"), b)).otherwise(F.col("grad") * F.lit(float("inf")))
    bent = F.get(F.transform(F.array(bend), step), F.lit(0))
    return at.select(*by, *_PLACE, "theta", "grad", F.greatest(F.col("theta") + bent, F.lit(_EPS)).alias("next"))


def abundance(sites: DataFrame, by: str | None = None, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(by, chrom, site_start, site_strand, fragments, theta) for each value of `by` (such as a sample; none: all rows are one).

    Samples with up to TOGETHER pairs of site and length are estimated in one task each; larger ones one after the other, each over
    many tasks (Spread). Lengths that no fragment has don't count. No rows give no rows.
    """
    ship(sites.sparkSession)
    keys = [by] if by else []
    cells = checkpointed(length_matrix(sites, keys))
    of_row = [F.col(by).alias("__by")] if by else [F.lit(1).alias("__by")]
    cells = cells.select(*of_row, *_PLACE, "length", "n")
    sizes = cells.groupBy("__by").agg(F.count("*").alias("pairs"))
    kind = cells.schema["__by"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        site, names = pd.factorize(pd.MultiIndex.from_frame(pdf[_PLACE]))
        row = np.unique(pdf["length"].to_numpy(), return_inverse=True)[1]
        sample = Held(row, site, pdf["n"].to_numpy())
        maximise(sample, rounds)
        out = pd.DataFrame(list(names), columns=_PLACE)
        return out.assign(__by=pdf["__by"].iloc[0], fragments=np.bincount(site, pdf["n"], len(names)).astype(int), theta=sample.theta)[["__by", *_PLACE, "fragments", "theta"]]

    able = sizes.where(F.col("pairs") <= TOGETHER).select(F.col("__by").alias("__able"))
    small = cells.join(able, F.col("__by").eqNullSafe(F.col("__able")), "left_semi")  # a group has TOGETHER rows at most
    out = small.groupBy("__by").applyInPandas(run, f"__by {kind}, chrom string, site_start long, site_strand string, fragments long, theta double")
    for r in sizes.where(F.col("pairs") > TOGETHER).select("__by").collect():  # each of them is a long job of its own
        own = cells.where(F.col("__by").eqNullSafe(F.lit(r[0])))
        rows = own.select("length").distinct().orderBy("length").collect()  # one for each length
        number = own.sparkSession.createDataFrame([(x.length, k) for k, x in enumerate(rows)], "length long, row int")
        numbered = own.join(F.broadcast(number), "length")
        grouped = numbered.groupBy(*_PLACE).agg(F.collect_list(F.struct("row", F.col("n").cast("double").alias("x"))).alias("c"), F.sum("n").alias("fragments"))  # a site's lengths
        named = checkpointed(grouped.withColumn("site", F.monotonically_increasing_id()))
        sample = Spread(named.select("site", F.col("c.row").alias("rows"), F.col("c.x").alias("xs")), len(rows))
        maximise(sample, rounds)
        found = named.join(sample.state.select("site", "theta"), "site").select(F.lit(r[0]).cast(kind).alias("__by"), *_PLACE, "fragments", "theta")
        out = out.unionByName(found)
    return out.select(*([F.col("__by").alias(by)] if by else []), *_PLACE, "fragments", "theta")
