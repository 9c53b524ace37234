"""Phrases whose words stand together more often than their parts foretell, by hierarchical naming of pairs.

Texts become blocks of codes of their frequent words. A level then knows its units (words, later k-grams) by global ids:
pairs of adjacent units are counted over all blocks, frequent ones get an id and are the units of the next level,
and everything else leaves the blocks, which so get shorter and shorter. A phrase is frequent only if
both phrases that lack its last or its first word are, so none is lost. The two ids of a named pair point to these two, its parents:
the counts of a phrase's first and last k words, for any cut, are handed down through them, and a
phrase tells them whether it occurs as often as they do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siteloom.llm.common import documents, give_back, slices
from siteloom.session import checkpointed, ship

#: Ends of pieces; words are what spaces and tabs part.
ENDS = re.compile(r"[.,;:!?\n-\r]+")
#: Occurrences, words of a phrase, and share of its occurrences (percent) that a longer phrase must have to stand for it.
LEAST_COUNT, MOST_WORDS, SHARE = 100, 5, 100
#: Phrases of a language that are returned.
TOP = 2000
#: Words of a block, about (it ends with a piece), and characters of a text that are split at once.
BLOCK_WORDS, SPLIT_CHARS = 1 << 18, 1 << 20
#: Pairs that a task counts at once, words of the corpus for which pairs are counted in one more part, and names up to which a pair is one number.
HELD_PAIRS, PART_WORDS, PACKED_IDS = 4_000_000, 4_000_000, (1 << 31) - 1
#: Named units of a level up to which they are broadcast; beyond, a join brings each block the names of its own.
BROADCAST_NAMES = 400_000
#: The language of texts that have none.
NO_LANG = "und"

_END, _GAP = -1, -2


# --- blocks


class Codes(dict):
    """The local codes of a language's words in a block; keys lists (language, word) by code."""

    def __init__(self, lang: str, keys: list[tuple[str, str]]):
        super().__init__({"": _GAP, "\n": _END})
        self.lang, self.keys_ = lang, keys

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self.keys_)
        self.keys_.append((self.lang, word))
        return code


def parts_of(text: str) -> Iterator[str]:
    """The text, lower-cased in A-Z, in parts of about SPLIT_CHARS that end with a piece."""
    text = text.encode().lower().decode()
    first = 0
    while first < len(text):
        end = ENDS.search(text, first + SPLIT_CHARS) if len(text) - first > SPLIT_CHARS else None
        last = end.end() if end else len(text)
        yield text[first:last]
        first = last


def coded(part: str, codes: Codes) -> np.ndarray:
    """The codes of the words of a part, END after each piece."""
    words = ENDS.sub(" \n ", part).replace("\t", " ").split(" ")
    got = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
    return np.append(got[got != _GAP], np.int32(_END))


def squeezed(codes: np.ndarray) -> np.ndarray:
    """codes with one END for each stretch of them."""
    end = codes == _END
    return codes[~(end & np.concatenate([[True], end[:-1]]))]


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def coded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[str, str]]]]:
    """(codes, keys) of blocks of whole pieces from rows (lang, text): local codes of their words in order, END between pieces, and the (language, word) of each code."""
    keys, dicts, held, size = [], {}, [], 0
    for batch in batches:
        for part, texts in slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                for some in parts_of(text):
                    got = coded(some, dicts[lang] if lang in dicts else dicts.setdefault(lang, Codes(lang, keys)))
                    held.append(got)
                    size += len(got)
                    if size >= BLOCK_WORDS:
                        yield squeezed(np.concatenate(held)), keys
                        keys, dicts, held, size = [], {}, [], 0
    if size:
        yield squeezed(np.concatenate(held)), keys


def kept(codes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, names) without the units that have no name: these are ends, and the others are numbered anew."""
    named = names >= 0
    new = np.append(np.where(named, np.cumsum(named) - 1, _END), _END).astype(np.int32)  # the last one is for END itself
    return squeezed(new[codes]), names[named]


def paired(codes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, left, right, counts) of the next level: the unit at a place and the one at the next place are a pair, a unit
    of one more word that begins at the place. New codes number the different pairs; left and right are the ids of their parts."""
    whole = (codes[:-1] >= 0) & (codes[1:] >= 0)
    key = codes[:-1][whole].astype(np.int64) * len(names) + codes[1:][whole]
    pairs, new, counts = np.unique(key, return_inverse=True, return_counts=True)
    out = np.full(max(0, len(codes) - 1), _END, np.int32)
    out[whole] = new
    return out, names[pairs // max(1, len(names))], names[pairs % max(1, len(names))], counts


BLOCK = "codes binary, names binary"


def block_row(codes: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([packed(codes.astype(np.int32))], pa.binary()), pa.array([packed(names.astype(np.int64))], pa.binary())], names=["codes", "names"])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(its row, codes, names) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            yield row, unpacked(row.column("codes")[0].as_py(), np.int32), unpacked(row.column("names")[0].as_py(), np.int64)


# --- counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) of the words of rows (lang, text), added up block by block before they leave a task."""

    def run(batches):
        for codes, keys in coded_blocks(batches):
            counts = np.bincount(codes[codes >= 0], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts)], names=["lang", "word", "f"])
        give_back()

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def pair_counts(blocks: DataFrame, least: int, parts: int, ids: int) -> DataFrame:
    """(left, right, f) of the pairs of all blocks that occur at least `least` times.

    While ids have 31 bits, a task sends its pairs as sorted numbers, one compressed list for each of `parts` parts of all pairs, and the lists of a part are
    merged; beyond, they are rows of an aggregate.
    """
    if ids > PACKED_IDS:

        def rows(batches):
            for _, codes, names in blocks_of(batches):
                _, left, right, counts = paired(codes, names)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(counts)], names=["left", "right", "f"])

        return blocks.mapInArrow(rows, "left long, right long, f long").groupBy("left", "right").agg(F.sum("f").alias("f")).where(F.col("f") >= least)

    def merged(held):
        key, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return key, np.bincount(place, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

    def send(batches):
        def lists(key, counts):
            part = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[ends[p] : ends[p + 1]]
                if len(own):
                    cols = [pa.array([p], pa.int32()), *(pa.array([packed(v)], pa.binary()) for v in (np.diff(key[own], prepend=0), counts[own]))]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "steps", "counts"])

        held, size = [], 0
        for _, codes, names in blocks_of(batches):
            _, left, right, counts = paired(codes, names)
            held.append(((left << 31) | right, counts))
            size += len(counts)
            if size > HELD_PAIRS:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield from lists(*held[0])
                    held, size = [], 0
        if size:
            yield from lists(*merged(held))
        give_back()

    def merge(batches):
        def out(held):
            key, counts = merged(held)
            often = counts >= least
            key = key[often]
            return pa.RecordBatch.from_arrays([pa.array(key >> 31), pa.array(key & ((1 << 31) - 1)), pa.array(counts[often])], names=["left", "right", "f"])

        now, held = None, []
        for batch in batches:
            for part, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "steps", "counts"))):
                if part != now and held:
                    yield out(held)
                    held = []
                now = part
                held.append((np.cumsum(unpacked(steps, np.int64)), unpacked(counts, np.int64)))
                if sum(len(h[0]) for h in held[1:]) > HELD_PAIRS:
                    held = [merged(held)]
        if held:
            yield out(held)
        give_back()

    sent = blocks.mapInArrow(send, "part int, steps binary, counts binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "left long, right long, f long")


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """(df with id, its number of rows): ids are 0, 1, 2, ...; only the sizes of partitions are collected."""
    df = checkpointed(df.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = sorted((r.part, r.n) for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, first = 0, []
    for p, n in sizes:
        first.append((p, total))
        total += n
    if not total:
        return df, 0
    starts = df.sparkSession.createDataFrame(first, "part long, first long")
    return df.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("id", F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first"), total


# --- names


def word_names(spark: SparkSession, named: DataFrame) -> Callable[[list[tuple[str, str]]], np.ndarray]:
    """The ids of (language, word) keys, END for those without, from the table of names (id, lang, word), which is broadcast."""
    rows = named.select("id", "lang", "word").toArrow()
    tables: dict[str, dict[str, int]] = {}
    for i, lang, word in zip(*(rows.column(c).to_pylist() for c in ("id", "lang", "word"))):
        tables.setdefault(lang, {})[word] = i
    shared = spark.sparkContext.broadcast(tables)
    return lambda keys: np.fromiter((shared.value.get(g, {}).get(w, _END) for g, w in keys), np.int64, len(keys))


def pair_names(spark: SparkSession, named: DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The ids of pairs (left, right), END for those without, from the table of names (id, left, right), which is broadcast."""
    rows = named.select("id", "left", "right").toArrow()
    ids, left, right = (rows.column(c).to_numpy() for c in ("id", "left", "right"))
    order = np.lexsort((right, left))
    lefts, rights = np.unique(left), np.unique(right)
    # A pair is one number: the places of its parts among all left and all right ones.
    shared = spark.sparkContext.broadcast((lefts, rights, np.searchsorted(lefts, left[order]) * len(rights) + np.searchsorted(rights, right[order]), ids[order]))

    def names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        lefts, rights, known, ids = shared.value
        if not len(known):
            return np.full(len(left), _END, np.int64)
        a, b = (np.minimum(np.searchsorted(t, v), len(t) - 1) for t, v in ((lefts, left), (rights, right)))
        at = np.minimum(np.searchsorted(known, a * len(rights) + b), len(known) - 1)
        return np.where((lefts[a] == left) & (rights[b] == right) & (known[at] == a * len(rights) + b), ids[at], _END)

    return names


def joined_names(blocks: DataFrame, asked: DataFrame, named: DataFrame, unit: list[str]) -> DataFrame:
    """blocks with at and ids, the places and ids of those of their own units that have a name. asked: (block, pos, unit columns). A join over all blocks; a list has a block's units at most."""
    known = asked.join(named.select("id", *unit), unit).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("known"))
    return blocks.join(known.select("block", F.col("known.pos").alias("at"), F.col("known.id").alias("ids")), "block", "left")


def placed_names(row: pa.RecordBatch, size: int) -> np.ndarray:
    got = np.full(size, _END, np.int64)
    at, ids = (row.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "ids"))
    got[at] = ids
    return got


def word_blocks(texts: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """The blocks of level 1: words of (lang, text) by the names (id, lang, word)."""
    if total <= BROADCAST_NAMES:
        names = word_names(texts.sparkSession, named)

        def run(batches):
            for codes, keys in coded_blocks(batches):
                yield block_row(*kept(codes, names(keys)))
            give_back()

        return texts.mapInArrow(run, BLOCK)

    def raw(batches):
        for codes, keys in coded_blocks(batches):
            cols = [pa.array([packed(codes)], pa.binary()), *(pa.array([[k[c] for k in keys]], pa.list_(pa.string())) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["codes", "langs", "words"])
        give_back()

    blocks = checkpointed(texts.mapInArrow(raw, "codes binary, langs array<string>, words array<string>").withColumn("block", F.monotonically_increasing_id()))
    asked = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words"))).select("block", "pos", F.col("col.langs").alias("lang"), F.col("col.words").alias("word"))

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield block_row(*kept(unpacked(row.column("codes")[0].as_py(), np.int32), placed_names(row, row.column("size")[0].as_py())))

    return joined_names(blocks.select("block", "codes", F.size("words").alias("size")), asked, named, ["lang", "word"]).mapInArrow(read, BLOCK)


def pair_blocks(blocks: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """The blocks of the next level: pairs by the names (id, left, right)."""
    if total <= BROADCAST_NAMES:
        names = pair_names(blocks.sparkSession, named)

        def run(batches):
            for _, codes, own in blocks_of(batches):
                codes, left, right, _ = paired(codes, own)
                codes, own = kept(codes, names(left, right))
                if len(own):
                    yield block_row(codes, own)
            give_back()

        return blocks.mapInArrow(run, BLOCK)
    blocks = checkpointed(blocks.withColumn("block", F.monotonically_increasing_id()))

    def ask(batches):
        for row, codes, own in blocks_of(batches):
            _, left, right, _ = paired(codes, own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), row.column("block")[0].as_py())), pa.array(np.arange(len(left))), pa.array(left), pa.array(right)], names=["block", "pos", "left", "right"])

    def read(batches):
        for row, codes, own in blocks_of(batches):
            codes, left, _, _ = paired(codes, own)
            yield block_row(*kept(codes, placed_names(row, len(left))))

    return joined_names(blocks, blocks.mapInArrow(ask, "block long, pos long, left long, right long"), named, ["left", "right"]).mapInArrow(read, BLOCK)


def phrase_table(docs: DataFrame, text_col: str, lang_col: str, least: int, most_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for k = 1, 2, ..., the frequent phrases of k words: (id, f) with lang and word, or left and right."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    words = checkpointed(word_counts(texts).groupBy("lang", F.when(F.col("f") >= least, F.col("word")).alias("word")).agg(F.sum("f").alias("f")))  # the others only count for n
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = max(1, -(-(words.agg(F.sum("f")).first()[0] or 0) // PART_WORDS))
    level, total = numbered(words.where("word is not null"))
    levels, blocks = [level], None
    while len(levels) < most_words:
        made = word_blocks(texts, level, total) if blocks is None else pair_blocks(blocks, level, total)
        blocks = checkpointed(made if total else made.limit(0))
        level, total = numbered(pair_counts(blocks, least, parts, total))
        levels.append(level)
    return totals, levels


def with_parts(levels: list[DataFrame]) -> list[DataFrame]:
    """Each level with lang, phrase, its last word, and the counts of its first and last 1, 2, ... words, handed down by its parents."""
    none = F.array().cast("array<bigint>")
    out = [levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("firsts"), none.alias("rests"))]
    for level in levels[1:]:
        up = out[-1]
        left = up.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begun"), F.concat("firsts", F.array("f")).alias("firsts"))
        right = up.select(F.col("id").alias("right"), "last", F.concat("rests", F.array("f")).alias("rests"))
        own = level.join(left, "left").join(right, "right")
        out.append(checkpointed(own.select("id", "left", "right", "lang", F.concat_ws(" ", "begun", "last").alias("phrase"), "last", "f", "firsts", "rests")))
    return out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_count: int = LEAST_COUNT, most_words: int = MOST_WORDS, share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of 2 to most_words words that occur at least least_count times within pieces.

    All counts are of one language (null: NO_LANG): n of all its words, a of the phrase, l and r of the two parts of the cut
    with the lowest score floor(1000 * a * n / (l * r)), computed in 38 digits (ties: the shortest first part). A phrase
    doesn't count if a longer one that holds its words in a row, whether or not that one counts, has at least `share` percent of its occurrences.
    rank is by score and a, both falling, then phrase in byte order; the first `top` of a language are returned (None: all).
    Null and empty texts hold no words; rows that repeat count again; no texts give no rows.
    """
    totals, levels = phrase_table(docs, text_col, lang_col, least_count, most_words)
    known = with_parts(levels)
    found = None
    for k, level in enumerate(known[1:], 2):
        if k < most_words:
            longer = known[k]
            # what an even longer phrase has, the one between has as well
            most = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            level = level.join(most, "id", "left").where(F.coalesce(F.lit(100) * F.col("most") < F.lit(share) * F.col("f"), F.lit(True)))
        level = level.select("lang", "phrase", F.col("f").alias("a"), "firsts", "rests")
        found = level if found is None else found.unionByName(level)
    cuts = found.join(totals, "lang").select("lang", "phrase", "a", "n", F.posexplode(F.arrays_zip("firsts", F.reverse("rests").alias("rests"))).alias("k", "cut"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.col("cut.firsts").alias("l"), F.col("cut.rests").alias("r"))
    whole = lambda c: f"cast({c} as decimal(17, 0))"
    score = F.expr(f"cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')} div ({whole('l')} * {whole('r')})")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    scored = lowest.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language over all whole texts of `documents`, as collocations states (nulls, ties, repeated rows, empty tables: see there)."""
    return collocations(documents(spark, sf_dir))


OP13_SQL = """
WITH
pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
words AS (SELECT lang, p, unnest(w) AS w, unnest(range(len(w))) AS i FROM numbered),
grams AS (
  SELECT lang, p, i, w AS w1, lead(w, 1) OVER (PARTITION BY p ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY p ORDER BY i) AS w3,
         lead(w, 3) OVER (PARTITION BY p ORDER BY i) AS w4, lead(w, 4) OVER (PARTITION BY p ORDER BY i) AS w5 FROM words),
every AS (
  SELECT lang, [w1] AS g, count(*) AS f FROM grams GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM grams WHERE w4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM grams WHERE w5 IS NOT NULL GROUP BY ALL),
known AS (SELECT * FROM every WHERE f >= 100),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM every WHERE len(g) = 1 GROUP BY lang),
inner_parts AS (
  SELECT lang, f, g[s + 1 : s + z] AS g
  FROM (SELECT lang, f, g, s, unnest(range(2, len(g))) AS z FROM (SELECT lang, f, g, unnest(range(len(g) - 1)) AS s FROM known WHERE len(g) > 2))
  WHERE s + z <= len(g)),
longest AS (SELECT lang, g, max(f) AS f FROM inner_parts GROUP BY lang, g),
kept AS (
  SELECT k.lang, k.g, k.f FROM known k LEFT JOIN longest o ON o.lang = k.lang AND o.g = k.g
  WHERE len(k.g) > 1 AND (o.f IS NULL OR 100 * o.f < 100 * k.f)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, t.n,
         CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM kept) c
  JOIN known x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN known y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)] JOIN total t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cuts),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM lowest WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
