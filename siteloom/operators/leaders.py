"""Leader clustering in a fixed order, as rounds over all rows instead of one walk.

Longest first (of equal length the larger one first) a sequence joins a leader that was there before it, or becomes one. Who
leads is decided side by side: a sequence only has to wait for those before it that it could join.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siteloom.functions.align import edits_within
from siteloom.operators.neargroups import stretches
from siteloom.session import checkpointed, ship

#: Sequences of a cluster of which leaders are found at once, sequences that a task holds against them, and pairs aligned at once.
HEADS, TILE_ROWS, PAIRS = 512, 4096, 1 << 15


def band_shape(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, values in a band) for which sets below the threshold meet, and sets above it don't, with the least chance on average."""
    s = (np.arange(2000) + 0.5) / 2000
    below = s < threshold

    def wrong(bands: int, rows: int) -> float:
        meet = 1 - (1 - s**rows) ** bands
        return float(meet[below].sum() + (1 - meet[~below]).sum())

    return min(((b, r) for b in range(1, num_perm + 1) for r in range(1, num_perm // b + 1)), key=lambda x: (wrong(*x), x))


def banded_leaders(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(seq, leader) of rows (seq, sig array<long>), sequences different: a sequence joins a leader that has one of its bands of values; of several the
    longest, then the one with most values in common, then the largest. Sequences without values lead themselves.

    A band has one leader at most. In each round the sequences that are first in all of their bands become leaders, and what shares a band
    with them is decided; the rest goes on. Of equal signatures only the first can lead.
    """
    signed = checkpointed(signed.select("seq", "sig", F.struct(F.length("seq").alias("n"), "seq").alias("ord")))
    able = signed.where(F.size("sig") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))
    nodes = able.groupBy("sig").agg(F.max("ord").alias("ord"))
    open_ = checkpointed(nodes.select("ord", "sig", F.explode(cut).alias("band")))
    led = None
    while open_.limit(1).count():
        heads = open_.groupBy("band").agg(F.max("ord").alias("head"))
        first = open_.join(heads, "band").groupBy("ord").agg(F.bool_and(F.col("ord") == F.col("head")).alias("leads")).where("leads").select("ord")
        new = checkpointed(open_.join(first, "ord").select("band", F.col("ord").alias("leader"), F.col("sig").alias("leader_sig")))
        led = new if led is None else led.unionByName(new)
        decided = open_.join(new.select("band"), "band").select("ord").distinct()
        open_ = checkpointed(open_.join(decided, "ord", "left_anti"))
    alone = signed.where(F.size("sig") <= 0).select("seq", F.col("seq").alias("leader"))
    if led is None:
        return alone
    same = F.aggregate(F.zip_with("sig", "leader_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    met = able.select("seq", "sig", "ord", F.explode(cut).alias("band")).join(led, "band").where(F.col("leader") >= F.col("ord"))
    best = met.groupBy("seq").agg(F.max(F.struct(F.col("leader.n").alias("n"), same.alias("same"), F.col("leader.seq").alias("leader"))).alias("b"))
    return best.select("seq", F.col("b.leader").alias("leader")).unionByName(alone)


def most_edits(n: int, seq_sim: float) -> int:
    """The most edits with which two sequences of n letters have a similarity 1 - edits / n of at least seq_sim."""
    e = int((1 - seq_sim) * n) + 1
    while e >= 0 and n and 1 - e / n < seq_sim:
        e -= 1
    return e


def nearest_leaders(seqs: list[str], leaders: list[str], seq_sim: float) -> tuple[np.ndarray, np.ndarray]:
    """(edits, place) of the leader that goes before each sequence and has, cut to its length, the fewest edits, if these reach seq_sim (else -1, -1).
    Of equally near ones the shortest, then the smallest."""
    ranked = sorted(range(len(leaders)), key=lambda k: (len(leaders[k]), leaders[k]))
    edits, place = np.full(len(seqs), -1), np.full(len(seqs), -1)
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(seqs):
        by_length.setdefault(len(s), []).append(k)
    letters = lambda texts, n: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), n)
    for n, own in by_length.items():
        if (most := most_edits(n, seq_sim)) < 0:
            continue
        able = [k for k in ranked if len(leaders[k]) >= n]
        if not able:
            continue
        cuts, place_of = np.unique([leaders[k][:n] for k in able], return_inverse=True)
        theirs = letters(cuts.tolist(), n)
        order = [(len(leaders[k]), leaders[k]) for k in able]  # rising, and those after a sequence's own place go before it
        step = max(1, PAIRS // len(cuts))
        for first in range(0, len(own), step):
            some = own[first : first + step]
            mine = letters([seqs[k] for k in some], n)
            far = edits_within(np.repeat(mine, len(cuts), 0), np.tile(theirs, (len(some), 1)), most).reshape(len(some), -1)[:, place_of]
            before = np.arange(len(able))[None, :] >= np.array([bisect_right(order, (n, seqs[j])) for j in some])[:, None]
            far = np.where(before, far, most + 1)
            at = far.argmin(1)  # the first of equal ones
            for j, a, d in zip(some, at, far[np.arange(len(some)), at]):
                if d <= most:
                    edits[j], place[j] = d, able[a]
    return edits, place


def first_leaders(seqs: list[str], seq_sim: float) -> list[str]:
    """Of some sequences, none of which can join an earlier leader, those that lead: in order, each that can't join one of them."""
    order = sorted(seqs, key=lambda s: (len(s), s), reverse=True)
    out: list[str] = []
    while order:
        out.append(order[0])
        near = nearest_leaders(order[1:], order[:1], seq_sim)[0]
        order = [s for s, e in zip(order[1:], near) if e < 0]
    return out


def similar_leaders(clustered: DataFrame, seq_sim: float) -> DataFrame:
    """(seq, leader) of rows (seq, cluster), sequences different: within a cluster a sequence joins the most similar of the leaders before it, each
    cut to its length, if the similarity is at least seq_sim (of equally similar ones the shortest, then the smallest), else it leads.

    Round by round the first HEADS sequences of each cluster that have found no leader yet tell which of them lead; then all sequences
    after these are held against the new leaders, in tiles. So a task holds HEADS leaders and TILE_ROWS sequences, however large a cluster is.
    """
    ship(clustered.sparkSession)
    order = F.struct(F.length("seq").alias("n"), "seq")
    left = checkpointed(clustered.select("cluster", "seq", order.alias("ord"), F.lit(-1).alias("edits"), F.lit(None).cast("string").alias("leader")))
    out = None
    while left.limit(1).count():
        ranked = left.where("leader is null").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("ord")))).where(F.col("r") <= HEADS)
        heads = checkpointed(ranked.select("cluster", "seq", "ord"))

        def lead(pdf: pd.DataFrame) -> pd.DataFrame:
            found = first_leaders(pdf["seq"].tolist(), seq_sim)
            return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]] * len(found), "seq": found})

        new = checkpointed(heads.select("cluster", "seq").groupBy("cluster").applyInPandas(lead, "cluster string, seq string"))  # HEADS rows at most
        last = heads.groupBy("cluster").agg(F.min("ord").alias("last"), F.count("*").alias("n"))
        tiles = left.groupBy("cluster").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles")).join(last.select("cluster"), "cluster")
        ask = left.join(new, ["cluster", "seq"], "left_anti").join(tiles, "cluster").select("cluster", F.pmod(F.xxhash64("seq"), F.col("tiles")).cast("int").alias("tile"), F.lit(1).alias("role"), "seq", "edits", "leader")
        told = new.join(tiles, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("role"), "seq", F.lit(-1).alias("edits"), F.lit(None).cast("string").alias("leader"))

        def meet(batches):
            schema = pa.schema([("cluster", pa.string()), ("seq", pa.string()), ("edits", pa.int32()), ("leader", pa.string())])
            leaders, now = [], None
            for key, part in stretches(batches, ["cluster", "tile", "role"]):
                if key[:2] != now:
                    leaders, now = [], key[:2]
                seqs = part.column("seq").to_pylist()
                if key[2] == 0:
                    leaders += seqs
                    continue
                got, place = nearest_leaders(seqs, leaders, seq_sim) if leaders else (np.full(len(seqs), -1),) * 2
                had, lead = part.column("edits").to_pylist(), part.column("leader").to_pylist()
                for k, (d, at) in enumerate(zip(got.tolist(), place.tolist())):
                    # leaders of later rounds go later, so they are shorter, or smaller
                    if at >= 0 and (had[k] < 0 or d <= had[k]):
                        had[k], lead[k] = d, leaders[at]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((part.column("cluster").to_pylist(), seqs, had, lead), schema)], schema=schema)

        sent = told.unionByName(ask).repartition("cluster", "tile").sortWithinPartitions("cluster", "tile", "role")
        seen = checkpointed(sent.mapInArrow(meet, "cluster string, seq string, edits int, leader string").withColumn("ord", order).join(last, "cluster"))
        # up to the last head all is decided; of a cluster with fewer heads than HEADS everything is
        done = (F.col("ord") >= F.col("last")) | (F.col("n") < HEADS)
        settled = seen.where(done).select("seq", "leader").unionByName(new.select("seq", F.col("seq").alias("leader"))).unionByName(left.join(last, "cluster", "left_anti").select("seq", "leader"))
        out = settled if out is None else out.unionByName(settled)
        left = checkpointed(seen.where(~done).select("cluster", "seq", "ord", "edits", "leader"))
    return left.select("seq", "leader") if out is None else out
