"""SimHash fingerprints and multi-index hashing over them.

A fingerprint is cut into two segments, each with a table of the fingerprints that hold a value.
If two fingerprints differ in at most r bits, either their first segments differ in at most r//2
bits or their second ones in at most r - r//2 - 1. So each fingerprint enumerates these small
Hamming balls within its segments, fetches the table entries and verifies the whole distance.
A table value that very many different fingerprints share would give the square of their number in
candidates. Its fingerprints and those whose balls reach it meet at their centres instead: each is
dealt to all values within r/2 bits of the whole fingerprint. Two of them differ in at most r bits
exactly if they share such a value, so this is exact as well, and makes no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siteloom.llm.common import documents, fresh, map_texts
from siteloom.operators.graph import connected_components
from siteloom.operators.neargroups import near_groups
from siteloom.session import broadcast_if_small, checkpointed, release, ship

SEED = 42
#: Different fingerprints with one table value, above which they meet at centres.
HOT_BUCKET = 32
#: Shingles hashed at once.
CHUNK = 65_536


def fingerprint(text: str, words: int) -> int:
    """The 64 majority bits of the XXH64 of all word shingles, as a signed long; 0 if there are no words."""
    parts = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not parts:
        return 0
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    n, hashed, counts = len(parts) - words + 1, xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        end = min(at + CHUNK, n)
        got = [hashed(b" ".join(s), SEED) for s in zip(*(parts[at + k : end + k] for k in range(words)))]
        counts += np.unpackbits(np.array(got, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp long) of every row; null texts count as empty."""

    def make():
        return lambda texts: {"fp": [fingerprint(t, words) for t in texts]}

    return map_texts(df, [id_col], text_col, "fp long", make)


def _ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` ones."""
    masks, layer = [0], [0]
    for _ in range(radius):
        layer = sorted({m | 1 << b for m in layer for b in range(width) if not m >> b & 1})
        masks += layer
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _segments(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def hamming_links(fps: DataFrame, radius: int = 2, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (src, dst) whose connected components are those of all pairs of the different longs in
    column fp that differ in at most `radius` bits (even, at most 4). Fingerprints without a partner
    have no edge. Nulls are ignored; repeated values count once; an empty table gives no edges."""
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    fps = fps.select("fp").where("fp is not null").distinct()
    reach = (radius // 2, max(0, radius - radius // 2 - 1))
    held = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), seg.alias("seg")) for t, seg in enumerate(_segments(F.col("fp")))])).alias("s")).select("fp", "s.t", "s.seg")
    masks = [F.array(*[F.lit(m).cast("long") for m in _ball(32, r)]) for r in reach]

    def near(t: int, seg: Column) -> Column:
        return F.struct(F.lit(t).alias("t"), F.transform(masks[t], lambda m: seg.bitwiseXOR(m)).alias("near"), seg.alias("own"))

    probes = fps.select("fp", F.explode(F.array(*[near(t, seg) for t, seg in enumerate(_segments(F.col("fp")))])).alias("s"))
    probes = probes.select("fp", "s.t", "s.own", F.explode("s.near").alias("seg"))
    hot = checkpointed(held.groupBy("t", "seg").count().where(F.col("count") > hot_bucket).select("t", "seg"))
    # each pair of different segments is fetched from its smaller side only
    cold = probes.where("seg >= own").join(held.withColumnRenamed("fp", "other").join(hot, ["t", "seg"], "left_anti"), ["t", "seg"])
    pairs = cold.where((F.col("own") < F.col("seg")) | (F.col("fp") < F.col("other"))).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    edges = pairs.select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    # the balls around the few hot values, instead of all balls against them: distance is symmetric
    around = hot.withColumn("seg", F.explode(F.when(F.col("t") == 0, F.transform(masks[0], lambda m: F.col("seg").bitwiseXOR(m))).otherwise(F.transform(masks[1], lambda m: F.col("seg").bitwiseXOR(m))))).distinct()
    near_hot = held.join(around, ["t", "seg"], "left_semi").select("fp").distinct()
    centres = near_hot.select("fp", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in _ball(64, radius // 2)]), lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    least = centres.groupBy("centre").agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst < top").select("centre", "dst")
    met = centres.join(least, "centre").where("fp > dst").select(F.col("fp").alias("src"), "dst")
    return edges.unionByName(met).distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id_col, fp long, component_id): the smallest id reachable over links of fingerprints.

    Exact copies share a fingerprint and are linked (also empty texts, whose fingerprint is 0); a
    row whose id is null takes part with its fingerprint but is never a component's name, unless it
    has only such rows. Repeated rows stay; an empty table gives an empty one; other columns are left out. Texts of any
    length are read whole, CHUNK shingles at a time. Documents are reduced to (id, fingerprint) in the one
    pass over texts; all further steps move only those. An id column with the name of another one of the result lets that have underscores.
    """
    docs = checkpointed(fingerprints(df.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__of")), "__doc", "__of", words))
    reps = checkpointed(docs.groupBy("fp").agg(F.min("__doc").alias("rep")))
    links = connected_components(hamming_links(reps, radius))
    named = reps.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = named.join(least, "root").select("fp", "component_id")
    return docs.join(found, "fp").select(F.col("__doc").alias(id_col), F.col("fp").alias(fresh([id_col], "fp")), F.col("component_id").alias(fresh([id_col], "component_id")))


#: Least similarity (Jaccard) of the shingle sets of near copies, as a fraction.
NEAR = (4, 5)
#: Words of 64 bits in a wide fingerprint, and the bits of 256 past which a pair isn't compared exactly: at a
#: similarity J of the shingle sets the expected share is acos(2J / (1 + J)) / pi, 39 bits for J = 0.8 (up to
#: 48 in sets of a few shingles), with a deviation of 6 bits, so that NEAR_BITS is 6 deviations away.
WIDE, NEAR_BITS = 4, 88
#: Least bits of a segment of the wide fingerprint, the rows that a table value should hold on average (more rows make
#: longer segments), and the chance that a pair of similarity 0.8 has no segment in common, which sets the number of tables.
SEGMENT_BITS, VALUE_ROWS, MISS = 6, 4096, 3e-6
#: Blocks of a table value at most (they get larger beyond), so that the number of a pair of blocks has 24 bits.
MOST_BLOCKS = 4095
#: Shingles below which a set is near to no other set: one of n shingles shares at most n of n + 1.
LEAST_SET = NEAR[0] // (NEAR[1] - NEAR[0])
#: Fingerprints that are held against a table value's at once.
ROWS_AT_ONCE = 256
#: Texts of a block that must hold a shingle for it to become a column of a matrix, and columns of one matrix.
COMMON, COLUMNS = 16, 4096


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The sorted XXH64 of the different word shingles; of a shorter text, of all its words; none without words."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    n, hashed = len(parts) - words + 1, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(b" ".join(s), SEED) for s in zip(*(parts[k : k + n] for k in range(words)))), np.uint64, n))


def name_of(hashes: np.ndarray) -> int:
    """One signed long for a set of hashes; 0 for none."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def wide(h: np.ndarray) -> list[int]:
    """256 majority bits over different hashes, as four signed longs."""
    counts = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(h), CHUNK):
        for k in range(WIDE):
            g = h[at : at + CHUNK] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)  # further hashes, from the first one
            g ^= g >> np.uint64(29)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(32)
            counts[k] += np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def segments(rows: int) -> np.ndarray:
    """The bits of each table's segment, one table a line. Tables are cut from random orders of all bits, so those
    of one order have no bit in common: the 42 tables of 6 bits hold every pair of at most 41 differing bits."""
    bits, width = 64 * WIDE, max(SEGMENT_BITS, math.ceil(math.log2(max(rows, 1) / VALUE_ROWS)))
    share = math.acos(2 * NEAR[0] / (NEAR[0] + NEAR[1])) / math.pi
    chance = np.array([math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)])
    equal = np.array([math.comb(bits - d, width) / math.comb(bits, width) for d in range(bits + 1)])
    tables = bits // width
    while (chance * (1 - equal) ** tables).sum() > MISS:
        tables += 1
    rng, lines = np.random.default_rng(SEED), []
    while len(lines) < tables:
        lines += rng.permutation(bits)[: bits // width * width].reshape(-1, width).tolist()
    return np.array(lines[:tables])


def fulls(column: pa.Array) -> np.ndarray:
    """The wide fingerprints of an Arrow column, a line each."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE)


def in_reach(size: np.ndarray, full: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the held fingerprints differ in at most NEAR_BITS bits from each given one, with sets of sizes that can be near."""
    far = np.zeros((len(full), len(held)), np.uint16)
    for k in range(WIDE):
        far += np.bitwise_count(full[:, k, None] ^ held[None, :, k])
    small, large = np.minimum(size[:, None], sizes[None, :]), np.maximum(size[:, None], sizes[None, :])
    return (far <= NEAR_BITS) & (NEAR[1] * small >= NEAR[0] * large)


class Side:
    """Rows of one place (a table's value, or a block of it) by size, which are told what each of them has in reach."""

    marks: list[str] = []  # what it needs besides (node, size, full)
    gives: list[str] = []  # the columns of out(), longs

    def __init__(self, rows: dict[str, np.ndarray]):
        order = np.argsort(rows["size"], kind="stable")
        self.rows = {c: v[order] for c, v in rows.items()}
        self.node, self.size, self.full = self.rows["node"], self.rows["size"].astype(np.int64), self.rows["full"]

    def meet(self, at: np.ndarray, other: Side, of: np.ndarray) -> None:
        """The rows `at` have the other's rows `of` in reach."""
        raise NotImplementedError

    def out(self) -> list[np.ndarray]:
        raise NotImplementedError


class Reached(Side):
    """How many each row has in reach."""

    gives = ["node", "n"]

    def __init__(self, rows):
        super().__init__(rows)
        self.n = np.zeros(len(self.node), np.int64)

    def meet(self, at, other, of):
        self.n += np.bincount(at, minlength=len(self.n))

    def out(self):
        return [c[self.n > 0] for c in (self.node, self.n)]


class Leads(Side):
    """The row of highest rank that each row has in reach, if that is higher than its own."""

    marks, gives = ["rank"], ["node", "lead", "high"]

    def __init__(self, rows):
        super().__init__(rows)
        self.rank, self.lead, self.high = self.rows["rank"], self.node.copy(), self.rows["rank"].copy()

    def meet(self, at, other, of):
        order, best = np.argsort(other.rank[of], kind="stable"), np.full(len(self.node), -1)
        best[at[order]] = of[order]  # the last one stays
        more = np.flatnonzero(best >= 0)
        more = more[other.rank[best[more]] > self.high[more]]
        self.high[more], self.lead[more] = other.rank[best[more]], other.node[best[more]]

    def out(self):
        return [c[self.lead != self.node] for c in (self.node, self.lead, self.high)]


class Guests(Side):
    """For each pair in reach with different homes, the one whose home ranks lower as a guest of the other's home (with equal ranks: both)."""

    marks, gives = ["rank", "home"], ["node", "band"]

    def __init__(self, rows):
        super().__init__(rows)
        self.rank, self.home = self.rows["rank"], self.rows["home"]
        self.at, self.band = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, at, other, of):
        asks = (other.home[of] != self.home[at]) & (other.rank[of] >= self.rank[at])
        at, band = np.append(self.at, at[asks]), np.append(self.band, other.home[of[asks]])
        homes, place = np.unique(band, return_inverse=True)
        once = np.unique(at * len(homes) + place)
        if len(once):
            self.at, self.band = once // len(homes), homes[once % len(homes)]

    def out(self):
        return [self.node[self.at], self.band]


def pairs_in_reach(mine: Side, held: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (in mine, in held) of all pairs in reach, in parts; those of a side with itself once."""
    for first in range(0, len(mine.node), ROWS_AT_ONCE):
        part = slice(first, first + ROWS_AT_ONCE)
        size = mine.size[part]
        low = first if mine is held else np.searchsorted(held.size, -(-size[0] * NEAR[0] // NEAR[1]))
        high = np.searchsorted(held.size, size[-1] * NEAR[1] // NEAR[0], "right")
        at, of = np.nonzero(in_reach(size, mine.full[part], held.size[low:high], held.full[low:high]))
        at, of = at + first, of + low
        once = at < of if mine is held else slice(None)
        yield at[once], of[once]


def _told(batches: Iterator[pa.RecordBatch], kind: type[Side]) -> Iterator[pa.RecordBatch]:
    """What `kind` gives for rows (place, role, node, size, full, its marks) sorted by the first two: a place's rows of role 0 among themselves, those of role 1 with those of role 2."""
    now, parts, held, across = None, [], None, False

    def met(mine, other):
        for at, of in pairs_in_reach(mine, other):
            mine.meet(at, other, of)
            other.meet(of, mine, at)

    def close():
        side = kind({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})
        if not across:
            met(side, side)
        return side

    def sent(side):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in side.out()], names=kind.gives)

    for batch in batches:
        mark = batch.column("place").to_numpy() * 4 + batch.column("role").to_numpy()
        rows = {c: batch.column(c).to_numpy() for c in ("node", "size", *kind.marks)} | {"full": fulls(batch.column("full"))}
        cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
        for first, last in zip(cuts, cuts[1:]):
            if first == last:
                continue
            place, role = divmod(int(mark[first]), 4)
            if place != now:
                if parts:
                    yield sent(held or close())
                now, parts, held, across = place, [], None, role > 0
            some = {c: v[first:last] for c, v in rows.items()}
            if role < 2:
                parts.append(some)
            elif parts:
                held = held or close()
                guests = kind(some)
                met(guests, held)
                yield sent(guests)
    if parts:
        yield sent(held or close())


def wide_bands(rows: DataFrame, value_rows: int = VALUE_ROWS) -> DataFrame:
    """(node, band) from rows (node, size, full), different nodes. Every two which have a segment in common, at most
    NEAR_BITS different bits and sizes that can be near stand in one band, which is named by one of the nodes.

    Multi-index hashing of the wide fingerprints: each segment has a table, the fingerprints of one table value meet,
    and the whole distance decides. A value of more than value_rows fingerprints is dealt to blocks, and each two
    blocks meet in a place of their own, so no task holds more than two of them.

    A family of near fingerprints meets in many values of all tables. So that it has the same few bands in all of them, they
    meet three times. First each fingerprint's partners are counted; those without any leave. Then each gets a home: of all that it
    has met, itself too, the one with most partners. A band is a home with its fingerprints, and so holds most pairs of a family.
    Last, pairs of different homes make one of the two a guest of the other's home.
    """
    ship(rows.sparkSession)
    rows = checkpointed(rows.where(F.col("size") >= LEAST_SET).select("node", "size", "full"))
    bits = segments(rows.count())
    kinds = rows.schema

    def keys(batches):
        powers = 1 << np.arange(bits.shape[1], dtype=np.int64)
        for batch in batches:
            ones = np.unpackbits(fulls(batch.column("full")).view(np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little")
            values = np.stack([ones[:, line] @ powers for line in bits], axis=1) if batch.num_rows else np.zeros((0, len(bits)), np.int64)
            value = pa.ListArray.from_arrays(pa.array(np.arange(len(ones) + 1, dtype=np.int32) * len(bits)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "size", "full")], value], names=["node", "size", "full", "values"])

    keyed = checkpointed(rows.mapInArrow(keys, StructType(kinds.fields + StructType.fromDDL("values array<long>").fields)))
    full_ones = keyed.select(F.posexplode("values").alias("t", "value")).groupBy("t", "value").count().where(F.col("count") > value_rows)
    blocks = broadcast_if_small(full_ones.select("t", "value", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("count") / value_rows)).cast("int").alias("blocks")))

    def met(some: DataFrame, kind: type[Side]) -> DataFrame:
        dealt = some.select("node", "size", "full", *kind.marks, F.posexplode("values").alias("t", "value"))
        dealt = dealt.join(blocks, ["t", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        place = F.shiftleft(F.col("t").cast("long"), 48) + F.shiftleft(F.col("value"), 24) + low * F.col("blocks") + high
        role = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        sent = dealt.select(place.alias("place"), role.alias("role"), "node", "size", "full", *kind.marks)
        return sent.repartition("place").sortWithinPartitions("place", "role").mapInArrow(lambda b: _told(b, kind), ", ".join(f"{c} long" for c in kind.gives))

    known = met(keyed, Reached).groupBy("node").agg(F.sum("n").alias("pop"))
    rank = F.shiftleft(F.least("pop", F.lit(1 << 38)), 24).bitwiseOR(F.xxhash64("node").bitwiseAND(F.lit((1 << 24) - 1)))
    ranked = checkpointed(keyed.join(known, "node").withColumn("rank", rank).drop("pop"))
    leads = met(ranked, Leads).groupBy("node").agg(F.max_by("lead", F.struct("high", "lead")).alias("home"), F.max("high").alias("high"))
    homes = ranked.join(leads, "node", "left").select("node", "size", "full", "values", F.coalesce("home", "node").alias("home"), F.coalesce("high", "rank").alias("rank"))
    homes = checkpointed(homes)
    release(rows.sparkSession)
    return homes.select("node", F.col("home").alias("band")).unionByName(met(homes, Guests)).distinct()


class SetBlock:
    """The shingle sets of a block's texts, by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, place, self.held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.values, self.owner = values, owner[np.argsort(place, kind="stable")]
        self.starts = np.cumsum(self.held) - self.held

    def shared(self, sets: list[np.ndarray]) -> np.ndarray:
        """How many shingles each of the given sets has in common with each text: rare shingles are
        counted by their owners, those that COMMON texts or more hold are columns of matrices."""
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        asked = np.concatenate(sets)
        at = np.minimum(np.searchsorted(self.values, asked), len(self.values) - 1)
        known = self.values[at] == asked
        row, at = row[known], at[known]
        rare = self.held[at] < COMMON
        many = self.held[at[rare]]
        first = np.repeat(self.starts[at[rare]], many)
        owner = self.owner[first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)]
        n = len(self.sizes)
        out = np.bincount(np.repeat(row[rare], many) * n + owner, minlength=len(sets) * n).reshape(-1, n)
        row, at = row[~rare], at[~rare]
        common = np.unique(at)
        place = np.searchsorted(common, at)
        for low in range(0, len(common), COLUMNS):
            part = common[low : low + COLUMNS]
            mine, theirs = np.zeros((len(sets), len(part)), np.float32), np.zeros((n, len(part)), np.float32)
            here = (place >= low) & (place < low + COLUMNS)
            mine[row[here], place[here] - low] = 1
            for k, v in enumerate(part):
                theirs[self.owner[self.starts[v] : self.starts[v] + self.held[v]], k] = 1
            out = out + (mine @ theirs.T).astype(np.int64)
        return out


def near_sets(block: list[bytes]) -> Callable[[list[bytes]], np.ndarray]:
    """Whether the sets of shingle hashes are similar enough, for other sets against those of a block."""
    held = SetBlock([np.frombuffer(b, np.uint64) for b in block])

    def near(others: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(b, np.uint64) for b in others]
        common = held.shared(sets)
        return NEAR[1] * common >= NEAR[0] * (np.array([len(s) for s in sets])[:, None] + held.sizes[None, :] - common)

    return near


def within_reach(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Leaves of pairs (lead, node) those whose sizes and fingerprints in rows (node, size, full) don't rule out that they are near."""
    side = lambda c: rows.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("full").alias(f"{c}_full"))
    far = F.aggregate(F.zip_with("lead_full", "node_full", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    alike = NEAR[1] * F.least("lead_size", "node_size").cast("long") >= NEAR[0] * F.greatest("lead_size", "node_size").cast("long")
    return lambda pairs: pairs.join(side("lead"), "lead").join(side("node"), "node").where(alike & (far <= NEAR_BITS)).select("lead", "node")


def first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """df with one row of each group of near copies: one that has the group's smallest id. Columns as they were.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of 0.8 or more. They meet by SimHash and
    multi-index hashing (wide_bands): the segments of fingerprints of 256 bits have tables, the whole distance decides
    which of a table value's texts are candidates, and of those the sets themselves. A radius of 2 of 64 bits would
    find only nearly equal texts. Texts without words are one group. Rows without
    id form groups like others, but a row with id goes before them. Of rows with that id and equal
    texts one stays, of different texts one as well. An empty table stays empty.
    """
    named = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    named = named.withColumn("key", F.xxhash64("id", "h"))

    def make():
        def work(texts):
            sets = [shingle_hashes(t, words) for t in texts]
            return {"node": [name_of(s) for s in sets], "size": [len(s) for s in sets], "full": [wide(s) for s in sets]}

        return work

    docs = checkpointed(map_texts(named, ["id", "h"], "text", "node long, size int, full array<long>", make))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    texts = checkpointed(docs.groupBy("node", "size", "full").agg(F.min(order).alias("first")).withColumn("key", F.xxhash64("first.id", "first.h")))

    def make_sets():
        def work(texts):
            sets = [shingle_hashes(t, words) for t in texts]
            return {"node": [name_of(s) for s in sets], "payload": [s.tobytes() for s in sets]}

        return work

    def sets_of(nodes):
        """The sets of these nodes, made again from their first texts."""
        asked = broadcast_if_small(texts.join(nodes, "node").select("key").distinct())
        made = map_texts(named.join(asked, "key", "left_semi"), [], "text", "node long, payload binary", make_sets)
        return made.dropDuplicates(["node"])

    held = checkpointed(wide_bands(texts))
    release(df.sparkSession)
    links = near_groups(held, texts.select("node", "size"), sets_of, near_sets, within_reach(texts), named=True)
    grouped = texts.join(links, "node", "left").select("first", F.coalesce("component", "node").alias("part"))
    least = grouped.groupBy("part").agg(F.min("first").alias("stays"))
    stays = least.select("stays.id", "stays.h")
    every = docs.groupBy("id", "h").agg(F.count("*").alias("n"))
    marked = checkpointed(every.join(stays.withColumn("stay", F.lit(True)), every["id"].eqNullSafe(stays["id"]) & (every["h"] == stays["h"]), "left").select(every["id"], every["h"], "n", "stay"))
    release(df.sparkSession)
    own, name, hashed = (fresh(df.columns, c) for c in ("__own", "__id", "__h"))
    gone = broadcast_if_small(marked.where("stay is null").select(F.col("id").alias(name), F.col("h").alias(hashed)))
    left = df.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    left = left.join(gone, F.col(id_col).eqNullSafe(F.col(name)) & (F.col(own) == F.col(hashed)), "left_anti")
    again = broadcast_if_small(marked.where("stay and n > 1").select(F.col("id").alias(name), F.col("h").alias(hashed)))
    if again.limit(1).count():  # only the rows that repeat are shuffled
        same = F.col(id_col).eqNullSafe(F.col(name)) & (F.col(own) == F.col(hashed))
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, own]))
    return left.select(*df.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, as simhash_groups states (nulls, empty and long texts, repeated rows, empty tables: see there)."""
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
