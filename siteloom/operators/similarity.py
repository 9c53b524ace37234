"""Similarity of reads: minimizers, MinHash, groups of signatures, verified sequence groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siteloom.functions.sequences import revcomp, similarity
from siteloom.operators.dedup import _merge, umi_clusters
from siteloom.operators.graph import connected_components, in_order
from siteloom.operators.neargroups import near_groups
from siteloom.session import broadcast_if_small, checkpointed, ship


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none if the sequence is shorter."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def minimizers(df: DataFrame, seq: str, k: int, w: int, out: str = "tokens") -> DataFrame:
    """df with the k-mers that have the smallest hash of some window of w k-mers (the leftmost of equal ones), each place once; all k-mers if there are fewer than w."""
    found = F.transform(kmers(F.col(seq), k), lambda t, i: F.struct(F.md5(t).alias("h"), i.alias("i"), t.alias("t")))
    # bound by a transformation of an array of one, so that hashes are not made anew for each window
    windows = lambda at: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(at) - w + 1), lambda i: F.array_min(F.slice(at, i, w))))
    picked = F.transform(F.array(found), lambda at: F.transform(F.when(F.size(at) < w, at).otherwise(windows(at)), lambda x: x["t"]))
    return df.withColumn(out, F.get(picked, F.lit(0)))


#: A prime above 2^32: (a * x + b) mod PRIME is a family of hashes of 32-bit numbers.
PRIME = 4_294_967_311


def seeds(num_perm: int) -> list[tuple[int, int]]:
    """A factor and a summand for each hash, from digests of their numbers."""
    of = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:7], 16)
    return [(of(f"a{i}") + 1, of(f"b{i}")) for i in range(num_perm)]


def minhash(tokens: Column, num_perm: int = 128, bits: int = 32) -> Column:
    """The low bits of the smallest hash of the tokens for each of num_perm hashes; null without tokens."""
    mask = F.lit((1 << bits) - 1).cast("long")
    factors, summands = zip(*seeds(num_perm))
    numbers = F.transform(F.array_distinct(tokens), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"))
    both = F.arrays_zip(F.array(*map(F.lit, factors)).alias("a"), F.array(*map(F.lit, summands)).alias("b"))
    # the numbers are bound once, not made anew for each hash
    bound = F.transform(F.array(numbers), lambda n: F.transform(both, lambda h: F.array_min(F.transform(n, lambda x: F.pmod(h["a"].cast("long") * x + h["b"].cast("long"), F.lit(PRIME)))).bitwiseAND(mask)))
    return F.when(F.size(tokens) > 0, bound[0])


def default_hash_similarity(seq_sim: float, token: int) -> float:
    return round(max(0.0, seq_sim**token / (2 - seq_sim**token) - 0.05), 3)


#: Chance at which the bands may miss a pair at the limit.
MISS = 1e-4


def band_rows(hash_sim: float, num_perm: int) -> int:
    """The most values in a band with which two signatures that share a part hash_sim of num_perm values have no band in common with a chance of at most MISS; 1 if none does."""
    return max((r for r in range(1, num_perm + 1) if (1 - hash_sim**r) ** (num_perm // r) <= MISS), default=1)


def _near_signatures(most: float, width: int):
    """Signatures (values of `width` bytes) that differ in at most `most` bits for each value."""

    def opened(block: list[bytes]):
        theirs = np.stack([np.frombuffer(b, f"<u{width}") for b in block])

        def near(others: list[bytes]) -> np.ndarray:
            mine, far = np.stack([np.frombuffer(b, f"<u{width}") for b in others]), np.zeros((len(others), len(block)), np.int64)
            for k in range(theirs.shape[1]):
                far += np.bitwise_count(mine[:, k, None] ^ theirs[None, :, k])
            return far <= theirs.shape[1] * most

        return near

    return opened


def signature_groups(df: DataFrame, id_col: str, sig: str, hash_sim: float, bits: int = 32, rows: int | None = None, keep: list[str] = []) -> DataFrame:
    """(id_col, keep, component): rows whose signatures differ in at most len * bits * (1 - hash_sim) / 2 bits, and chains of them;
    component is the smallest id. Signatures are of one length; rows without one are left out.

    Candidates meet in bands of `rows` values, by default as many as miss a pair at the limit with a chance of
    at most MISS; equal signatures are one node. The limit itself is exact, and no table of pairs is made.
    """
    df = checkpointed(df.select(id_col, *keep, sig))  # signatures are costly, and the optimiser would make them anew for each use
    nodes = df.where(F.col(sig).isNotNull()).groupBy(F.col(sig).alias("sig")).agg(F.min(id_col).alias("rep"))
    nodes = checkpointed(nodes.select("sig", "rep", F.monotonically_increasing_id().alias("node")))
    rows = rows or band_rows(hash_sim, nodes.agg(F.max(F.size("sig"))).first()[0] or 1)
    held = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("sig") / rows).cast("int") - 1), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))).alias("band"))
    hexed = F.unhex(F.array_join(F.transform("sig", lambda v: F.lpad(F.hex(v), 16, "0")), ""))
    links = near_groups(held, nodes.select("node", F.size("sig").alias("size")), lambda asked: nodes.join(asked, "node").select("node", hexed.alias("payload")), _near_signatures(bits * (1 - hash_sim) / 2, 8))
    named = nodes.join(links, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = named.groupBy("part").agg(F.min("rep").alias("component"))
    named = named.select("sig", "part").join(least, "part").select(F.col("sig").alias(sig), "component")
    return df.join(named, sig).select(id_col, *keep, "component")


def minhash_groups(df: DataFrame, id_col: str, seq: str, hash_sim: float, token: int = 4, window: int | None = None, num_perm: int = 128, bits: int = 32) -> DataFrame:
    """(id_col, component): signature_groups of the MinHash signatures of sequences. A sequence is signed once, whatever number of rows have it; rows without tokens are left out."""
    one = df.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("__seq")).agg(F.min(id_col).alias("__first"))
    signed = minimizers(one, "__seq", token, window or token, "__tokens").withColumn("__sig", minhash(F.col("__tokens"), num_perm, bits))
    parts = signature_groups(signed, "__first", "__sig", hash_sim, bits, keep=["__seq"])
    return df.select(id_col, F.col(seq).alias("__seq")).join(parts, "__seq").select(id_col, "component")


def compare_sequence(seq_sim: float) -> Column:
    """seq1 if there is no second read or it is similar to its reverse complement, else both."""
    alike = F.col("seq2").isNull() | (similarity(F.col("seq1"), revcomp(F.col("seq2"))) >= seq_sim)
    return F.when(alike, F.col("seq1")).otherwise(F.concat("seq1", "seq2"))


def sequence_groups(df: DataFrame, keys: list[str], seq: str, seq_sim: float = 0.95, len_diff: int = 5, out: str = "seq_group") -> DataFrame:
    """df with `out`, the smallest sequence that is linked to the row's within keys.

    Sequences link if their lengths differ by at most len_diff and their similarity is at least
    seq_sim. Exact, without comparing all pairs: a sequence of length l is cut in D + 1 pieces, D the
    most edits that a partner can have, so one piece stands unchanged in the partner, shifted by at
    most D; pieces are joined, then the distance is computed.
    """
    nodes = df.select(*keys, F.col(seq).alias("s")).where("s is not null").distinct().withColumn("l", F.length("s"))
    most = lambda n: F.floor((1 - seq_sim) * n + 1e-9).cast("int")
    held = nodes.withColumn("d", most(F.col("l") + len_diff)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    cut = lambda i, n, d: F.floor(i * n / (d + 1)).cast("int")
    held = held.select(*keys, F.col("s").alias("t"), F.col("l").alias("tl"), "i", F.expr("substring(s, cast(floor(i * l / (d + 1)) as int) + 1, cast(floor((i + 1) * l / (d + 1)) as int) - cast(floor(i * l / (d + 1)) as int))").alias("piece"))
    look = nodes.withColumn("tl", F.explode(F.sequence(F.greatest(F.lit(0), F.col("l") - len_diff), F.col("l")))).withColumn("d", most(F.col("tl") + len_diff)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    look = look.withColumn("a", cut(F.col("i"), F.col("tl"), F.col("d"))).withColumn("b", cut(F.col("i") + 1, F.col("tl"), F.col("d")))
    look = look.withColumn("p", F.explode(F.array_distinct(F.transform(F.sequence(-F.col("d"), F.col("d")), lambda x: F.col("a") + x)))).where("p >= 0 and p + b - a <= l")
    look = look.select(*keys, "s", "l", "tl", "i", F.expr("substring(s, p + 1, b - a)").alias("piece")).distinct()
    pairs = look.join(held, [*keys, "tl", "i", "piece"]).where("s <> t and (tl < l or t < s)").select(*keys, "s", "t").distinct()
    edges = pairs.where(similarity(F.col("s"), F.col("t")) >= seq_sim)
    node = lambda c: F.struct(*keys, F.col(c).alias("s"))
    parts = connected_components(edges.select(node("s").alias("src"), node("t").alias("dst")))
    named = parts.select("node.*", F.col("component.s").alias(out)).withColumnRenamed("s", seq)
    return df.join(named, [*keys, seq], "left").withColumn(out, F.coalesce(out, seq)).select(*df.columns, out)


def multi_fuzzy(df: DataFrame, group: list[str], seq_sim: float = 0.95, len_diff: int = 5, frag_ratio: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates) of multimapping reads: verified sequence groups within coarse ones, UMI clusters within these, then the best row by (count, map_qual, mean_qual)."""
    named = df.withColumn("__compare", compare_sequence(seq_sim))
    grouped = sequence_groups(named, group, "__compare", seq_sim, len_diff, "__seq_group")
    clustered = checkpointed(umi_clusters(grouped, [*group, "__seq_group"], frag_ratio))
    return _merge(clustered, [*group, "__seq_group", "umi_owner"], df.columns)


def multi_dedup(df: DataFrame, seq_sim: float = 0.95, token: int = 4, window: int | None = None, num_perm: int = 128, len_diff: int = 5, frag_ratio: float = 2.0, hash_sim: float | None = None, bits: int = 32) -> tuple[DataFrame, DataFrame]:
    """multi_fuzzy within groups of MinHash signatures."""
    named = checkpointed(df.withColumn("__compare", compare_sequence(seq_sim)))
    parts = minhash_groups(named, "read_name", "__compare", default_hash_similarity(seq_sim, token) if hash_sim is None else hash_sim, token, window, num_perm, bits)
    grouped = named.join(parts, "read_name", "left").withColumn("__coarse", F.coalesce("component", "read_name")).select(*df.columns, "__coarse")
    kept, dup = multi_fuzzy(grouped, ["__coarse"], seq_sim, len_diff, frag_ratio)
    return kept.select(*df.columns), dup


def kmer_cosine(a: Column, b: Column, k: int = 4) -> Column:
    """Cosine of the k-mer count vectors of two sequences."""
    dot = lambda x, y: F.aggregate(x, F.lit(0.0), lambda s, t: s + F.size(F.filter(y, lambda u: u == t)))
    cosine = lambda p: F.when((F.size(p["x"]) > 0) & (F.size(p["y"]) > 0), dot(p["x"], p["y"]) / F.sqrt(dot(p["x"], p["x"]) * dot(p["y"], p["y"]))).otherwise(0.0)
    # bound by a transformation of an array of one, so that k-mers aren't cut anew for each other one
    return F.get(F.transform(F.array(F.struct(kmers(a, k).alias("x"), kmers(b, k).alias("y"))), cosine), F.lit(0))


#: Rows of one block of the sequences that share a k-mer, and the cosine below which two sequences are no candidates.
COSINE_BLOCK, COSINE_LIMIT = 1024, 0.5


def _nearest_in_tile(limit: float, top: int | None):
    """(node, other, cosine) of the rows of a tile (node, part, s, feats array<struct<t, c>>): each row's `top` best of the other part, or, if there is one part only, of the same."""

    def run(rows: pa.Table) -> pa.Table:
        node, part, s = (np.array(rows.column(c).to_pylist()) for c in ("node", "part", "s"))
        feats = rows.column("feats").to_pylist()
        names = {t: k for k, t in enumerate(sorted({f["t"] for r in feats for f in r}))}
        x = np.zeros((len(node), len(names)))
        for k, r in enumerate(feats):
            for f in r:
                x[k, names[f["t"]]] = f["c"]
        square = (x * x).sum(1)
        out: tuple[list, list, list] = ([], [], [])
        across = len(np.unique(part)) > 1
        for first in range(0, len(node), 256):
            some = slice(first, first + 256)
            cosine = (x[some] @ x.T) / np.sqrt(square[some, None] * square[None, :])
            bad = part[some, None] == part[None, :] if across else node[some, None] == node[None, :]
            cosine[bad | (cosine < limit)] = -1
            for k, line in enumerate(cosine):
                at = np.flatnonzero(line >= 0)
                at = at[np.lexsort((s[at], -line[at]))][:top]
                out[0].extend([node[first + k]] * len(at))
                out[1].extend(node[at])
                out[2].extend(line[at])
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["node", "other", "cosine"])

    return run


def cosine_neighbours(df: DataFrame, keys: list[str], seq: str, limit: float = COSINE_LIMIT, top: int | None = 20, k: int = 4) -> DataFrame:
    """(keys, s, t, cosine): for each distinct sequence s the `top` others of its keys (None: all) whose k-mer counts have the largest cosine with its own, at least `limit`.
    Ties go to the smaller sequence; sequences shorter than k, and rows with a null key or sequence, have no neighbours.

    Exact. K-mers are ordered from the rarest on; what follows the first ones of a sequence has a norm below limit of the whole, so two sequences that
    reach the limit share one of these first ones. The sequences that share one are cut in blocks and meet in tiles of two blocks, of which only each one's best leave.
    """
    ship(df.sparkSession)
    nodes = in_order(df.select(*keys, F.col(seq).alias("s")).where("s is not null").distinct(), ["s"], "node")
    counts = nodes.select("node", F.explode(kmers(F.col("s"), k)).alias("t")).groupBy("node", "t").agg(F.count("*").alias("c"))
    counts = checkpointed(counts)
    often = counts.groupBy("t").agg(F.count("*").alias("f"))
    held = counts.join(broadcast_if_small(often), "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "t", "c"))).alias("l"))  # the k-mers of a sequence
    square = lambda l: F.aggregate(l, F.lit(0).cast("long"), lambda a, x: a + x["c"] * x["c"])
    first = F.filter(F.transform("l", lambda x, i: F.struct(x["t"].alias("t"), square(F.slice("l", i + 1, F.size("l"))).alias("rest"))), lambda x: x["rest"] >= F.lit(limit * limit * (1 - 1e-12)) * F.col("all"))
    held = checkpointed(nodes.join(held, "node").withColumn("all", square(F.col("l"))).select(*keys, "node", "s", F.transform("l", lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"))).alias("feats"), F.transform(first, lambda x: x["t"]).alias("first")))
    met = held.select(*keys, "node", F.explode("first").alias("t"))
    size = checkpointed(met.groupBy(*keys, "t").agg(F.ceil(F.count("*") / COSINE_BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1"))
    dealt = met.join(size, [*keys, "t"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select(F.xxhash64(*keys, "t", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), F.col("own").alias("part"), "node")
    sent = tiles.join(held.select("node", "s", "feats"), "node")
    found = sent.groupBy("tile").applyInArrow(_nearest_in_tile(limit - 1e-12, top), "node long, other long, cosine double").distinct()  # two blocks at most
    named = found.join(held.select("node", *keys, "s"), "node").join(held.select(F.col("node").alias("other"), *(F.col(c).alias(f"__{c}") for c in keys), F.col("s").alias("t")), "other")
    for c in keys:  # tiles are told by a hash
        named = named.where(F.col(c).eqNullSafe(F.col(f"__{c}")))
    if top is not None:
        named = named.withColumn("__n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "t"))).where(F.col("__n") <= top)
    return named.select(*keys, "s", "t", "cosine")


def neighbour_groups(df: DataFrame, keys: list[str], seq: str, seq_sim: float = 0.95, len_diff: int = 5, out: str = "seq_group", limit: float = COSINE_LIMIT, top: int | None = 20) -> DataFrame:
    """sequence_groups, with candidates by the cosine of their k-mers: of each sequence only the `top` nearest are compared.

    With all of them (top None) and a limit that no similar pair falls below, the groups are those of sequence_groups.
    """
    near = cosine_neighbours(df, keys, seq, limit, top)
    alike = (F.abs(F.length("s") - F.length("t")) <= len_diff) & (similarity(F.col("s"), F.col("t")) >= seq_sim)
    node = lambda c: F.struct(*keys, F.col(c).alias("s"))
    parts = connected_components(near.where(alike).select(node("s").alias("src"), node("t").alias("dst")))
    named = parts.select("node.*", F.col("component.s").alias(out)).withColumnRenamed("s", seq)
    return df.join(named, [*keys, seq], "left").withColumn(out, F.coalesce(out, seq)).select(*df.columns, out)
