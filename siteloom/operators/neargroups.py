"""Groups of rows that are near to each other by a test that only two rows together can pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siteloom.operators.graph import connected_components
from siteloom.session import checkpointed, release, ship

#: Rows of one block of a group, about, sum of sizes in it, and guests that are held against a block at once.
BLOCK_ROWS, BLOCK_SIZE, GUESTS = 1024, 1 << 20, 256

#: Given the payloads of a block, what tells for other payloads which of the block are near: a matrix of others by block.
Opener = Callable[[list[bytes]], Callable[[list[bytes]], np.ndarray]]


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for stretches of equal keys in batches sorted by them; a long stretch may come in parts."""
    for batch in batches:
        rows = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        first = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k] != rows[first]:
                yield rows[first], batch.slice(first, k - first)
                first = k


def _met(batches, opener: Opener):
    """(src, dst) from rows (lead, block, tile, role, node, part, payload) sorted by the first four: a node of a guest (role 1)
    and one of a row of the block (role 0) that is near it, for each other part which holds such a row. Parts that an
    earlier guest has joined count as one, so a block gives one edge for each guest, and one for each of its parts at most."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    near, last, held = None, None, []
    for key, part in stretches(batches, ["lead", "block", "tile", "role"]):
        if key[:3] != last:
            near, last, held = None, key[:3], []
        if key[3] == 0:
            held.append(part)
            continue
        if near is None:
            if not held:
                continue
            near = opener([h for p in held for h in p.column("payload").to_pylist()])
            node, own = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("node", "part"))
            joined, held = own.copy(), held[:1]
        for first in range(0, part.num_rows, GUESTS):
            some = part.slice(first, GUESTS)
            found = near(some.column("payload").to_pylist()) & (some.column("part").to_numpy()[:, None] != own[None, :])
            src, dst = [], []
            for at in np.flatnonzero(found.any(1)):
                of = np.flatnonzero(found[at])
                parts, one = np.unique(joined[of], return_index=True)
                if len(parts) > 1:
                    joined[np.isin(joined, parts)] = parts[0]
                src += [some.column("node")[int(at)].as_py()] * len(one)
                dst += node[of[one]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=schema)


def near_groups(held: DataFrame, sizes: DataFrame, payloads: Callable[[DataFrame], DataFrame], opener: Opener, close: Callable[[DataFrame], DataFrame] | None = None, named: bool = False) -> DataFrame:
    """(node, component) of the nodes (longs) that are linked to another one, over all pairs that have a band in common.

    held: (node, band). sizes: (node, size), how much of a block a node fills. payloads(nodes): (node, payload
    binary) of the given ones. opener: the test, on payloads. close: may leave out pairs of a table (lead, node)
    which can't pass it. named: a band's name is a node, which leads it whether it is held by it or not.

    Other bands are led by the node that shares bands with most others, so that few nodes lead most bands of a
    family. All nodes of a leader's bands are one group. First they are held against the leader only; what this
    links needs no comparison any more. In groups that are still in several parts the nodes outside the largest
    part then look up all others. Both go in tiles, a block of the group against a block of those that look it up, and
    only edges leave a tile: neither pairs nor a whole group, nor all its guests, are ever in one task.
    """
    ship(held.sparkSession)
    shared = held.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    busy = checkpointed(held.join(shared, "band"))
    if named:
        members = busy.select(F.col("band").alias("lead"), "node")
        members = members.unionByName(members.select("lead", F.col("lead").alias("node")))
    else:
        known = busy.groupBy("node").agg(F.sum("n").alias("pop"))
        leads = busy.select("node", "band").join(known, "node").groupBy("band").agg(F.max_by("node", F.struct("pop", "node")).alias("lead"))
        members = busy.select("node", "band").join(leads, "band").select("lead", "node")
    members = checkpointed(members.distinct())  # the leader too
    payload = checkpointed(payloads(members.select("node").distinct()))

    def met(homes: DataFrame, guests: DataFrame) -> DataFrame:
        """Edges between guests and the homes of their group; both (lead, node, part)."""
        enough: Column = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SIZE)).cast("int")
        blocks = homes.join(sizes, "node").groupBy("lead").agg(enough.alias("blocks"))
        tiles = guests.join(sizes, "node").groupBy("lead").agg(enough.alias("tiles"))
        cut = checkpointed(blocks.join(tiles, "lead"))
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = homes.join(cut, "lead").select("lead", own("blocks").alias("block"), each("tiles").alias("tile"), F.lit(0).alias("role"), "node", "part")
        asks = guests.join(cut, "lead").select("lead", each("blocks").alias("block"), own("tiles").alias("tile"), F.lit(1).alias("role"), "node", "part")
        sent = dealt.unionByName(asks).join(payload, "node").select("lead", "block", "tile", "role", "node", "part", "payload")
        return checkpointed(sent.repartition("lead", "block", "tile").sortWithinPartitions("lead", "block", "tile", "role").mapInArrow(lambda b: _met(b, opener), "src long, dst long"))

    pairs = members.where("lead <> node")
    pairs = checkpointed((close(pairs) if close else pairs).select("lead", "node", F.col("node").alias("part")))
    edges = met(pairs, pairs.select("lead", F.col("lead").alias("node"), F.col("lead").alias("part")).distinct())
    parts = connected_components(edges)
    placed = checkpointed(members.join(parts, "node", "left").select("lead", "node", F.coalesce("component", "node").alias("part")))
    release(held.sparkSession)
    many = placed.groupBy("lead", "part").agg(F.count("*").alias("n")).groupBy("lead").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
    mixed = placed.join(many.where("parts > 1"), "lead")
    # the leader has met the rest of its group
    rest = met(mixed.select("lead", "node", "part"), mixed.where("part <> main and node <> lead").select("lead", "node", "part"))
    part = lambda c: placed.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part")).distinct()
    joined = connected_components(rest.join(part("src"), "src").join(part("dst"), "dst").select(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")))
    every = parts.select("node", F.col("component").alias("part")).unionByName(joined.join(parts, "node", "left_anti").select("node", F.col("node").alias("part")))
    return every.join(joined.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("component", "part").alias("component"))
