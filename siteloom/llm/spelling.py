"""Spelling variants: words that are one edit apart, and the much commoner word that a variant stands for.

Full neighbourhood generation: for each word all distinct deletions, replacements and insertions over the
observed alphabet are made, and those that are words are its near words. A rolling hash gives each candidate's
hash from those of the word's prefixes, so that a candidate is a number until a filter over the vocabulary's
hashes lets it pass; only what passes is spelled out and joined to the vocabulary. The join is on the
string, so nothing needs a distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.llm.common import documents, give_back, slices
from siteloom.session import checkpointed, ship

#: A word of a text: a maximal run of these letters. Of their code points only A-Z are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many (document, run) pairs loses a letter before it is counted.
DROP_ONE_IN = 97
#: Words that count: at least so many code points, at least so many occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form occurs at least so many times as often.
RATIO = 2
#: Different words that a task counts before it hands them on, and runs of one text that are listed at once.
HELD_WORDS, LISTED = 300_000, 200_000
#: Bits of the filter for each word (about), the most bits of all (64 MB), those of a chunk, probes of a word and of a long one (code points).
FILTER_BITS, MOST_BITS, CHUNK_BITS, PROBES, LONG_PROBES, LONG = 24, 1 << 29, 1 << 16, 3, 24, 64
#: Pairs of a word and a place whose candidates are hashed at once.
PLACES = 1 << 14

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """x, each bit of it spread over all bits (a bijection of 64 bits)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# --- counting


def runs_of(text: str) -> Counter:
    """Each run of a text, lower-cased in A-Z, with its number; runs of a long text aren't listed all at once."""
    text = text.encode().lower().decode()
    if len(text) <= LISTED:
        return Counter(RUN.findall(text))
    found, rest = Counter(), RUN.finditer(text)
    while part := [m.group() for m in islice(rest, LISTED)]:
        found.update(part)
    return found


def misspelt(doc: object, run: str, one_in: int) -> str:
    """The run, without one letter where the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = DROP_ONE_IN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts with at least least_length code points and least_count occurrences.

    A null text holds no words, a null id counts as an empty one; rows that repeat count again. Only counts
    leave a task, added up over its texts (HELD_WORDS different words at once).
    """
    ship(docs.sparkSession)
    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for doc, text in zip(part.column("id").to_pylist(), texts):
                    for run, n in runs_of(text).items():
                        word = misspelt(doc, run, one_in)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield give()
                    held.clear()
        yield give()
        held.clear()
        give_back()

    counted = sent.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- hashes of words and of their neighbours


class Places:
    """The places of some words, one after the other: for each of its code points, and one for its end, what the hashes of neighbours are made of."""

    def __init__(self, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.words = words
        self.word = np.repeat(np.arange(len(words)), sizes + 1)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        self.at = np.arange(len(self.word)) - np.repeat(starts, sizes + 1)
        self.end = self.at == sizes[self.word]
        self.size = sizes[self.word]
        self.code = np.zeros(len(self.word), np.uint32)
        self.code[~self.end] = code
        powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(len(powers) - 1, _BASE), dtype=np.uint64)
        self.power = powers[self.at]
        value = np.where(self.end, np.uint64(0), letters(self.code) * self.power)
        total = np.cumsum(value, dtype=np.uint64)
        first = total - value
        self.before = first - np.repeat(first[starts], sizes + 1)  # the hash of what stands before the place
        self.value = value
        self.whole = np.repeat(self.before[starts + sizes], sizes + 1)
        self.hashes = self.before[starts + sizes]
        self.sizes = sizes
        #: The code point before equals this one: deleting this one gives the same word as deleting that.
        self.twin = np.zeros(len(self.word), bool)
        self.twin[1:] = (self.at[1:] > 0) & ~self.end[1:] & (self.code[1:] == self.code[:-1])
        #: The code point before (0: none), after which the same one needn't be inserted.
        self.last = np.where(self.at > 0, np.concatenate([[0], self.code[:-1]]), 0).astype(np.uint32)


def letters(code: np.ndarray) -> np.ndarray:
    return _mixed(code.astype(np.uint64) + np.uint64(0x51_7C_C1B7))


def neighbours(p: Places, alphabet: np.ndarray, first: int, last: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, place, code point, hash, length) of all distinct deletions, replacements and insertions at the places first to last.

    Of equal letters in a row the first is deleted, and a letter isn't inserted after itself, so none comes twice.
    """
    places = np.arange(first, last)
    gone = places[~p.end[first:last] & ~p.twin[first:last]]
    yield "delete", gone, np.zeros(len(gone), np.uint32), p.before[gone] + (p.whole[gone] - p.before[gone] - p.value[gone]) * _BACK, p.size[gone] - 1
    value = letters(alphabet)
    inside = places[~p.end[first:last]]
    new = (p.whole[inside] - p.value[inside])[:, None] + value[None, :] * p.power[inside][:, None]
    at, c = np.nonzero(alphabet[None, :] != p.code[inside][:, None])
    yield "replace", inside[at], alphabet[c], new[at, c], p.size[inside[at]]
    new = (p.before[places] + (p.whole[places] - p.before[places]) * _BASE)[:, None] + value[None, :] * p.power[places][:, None]
    at, c = np.nonzero(alphabet[None, :] != p.last[places][:, None])
    yield "insert", places[at], alphabet[c], new[at, c], p.size[places[at]] + 1


def spelled(p: Places, kind: str, place: int, code: int) -> str:
    word, at = p.words[p.word[place]], p.at[place]
    return word[:at] + ("" if kind == "delete" else chr(code)) + word[at + (kind != "insert") :]


# --- the filter over the vocabulary


class Filter:
    """A Bloom filter in chunks: a hash's first bits name its chunk, the others its bits there. What it lets pass may be a word, what it holds back is none."""

    def __init__(self, chunks: np.ndarray):
        self.bits = chunks  # one row of bytes for each chunk
        self.shift = np.uint64(64 - max(0, len(chunks).bit_length() - 1))

    def maybe(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of hashes (of words of these lengths) that pass."""
        key = _mixed(hashes)
        chunk = (key >> self.shift).astype(np.int64) if len(self.bits) > 1 else np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        for k in range(LONG_PROBES):
            if k >= PROBES:
                more = sizes[left] > LONG
                passed, left = left[~more], left[more]
                done = passed if k == PROBES else np.concatenate([done, passed])
                if not len(left):
                    return np.sort(done)
            bit = probe(key[left], k)
            left = left[(self.bits[chunk[left], bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return np.sort(np.concatenate([done, left]))


def probe(key: np.ndarray, k: int) -> np.ndarray:
    """The bit of the chunk that probe k of a mixed hash looks at."""
    step = (key >> np.uint64(17)) | np.uint64(1)
    return ((key + np.uint64(k) * step) & np.uint64(CHUNK_BITS - 1)).astype(np.int64)


def vocabulary_filter(words: DataFrame, total: int) -> Filter:
    """The filter over the column word of words, at most MOST_BITS large: each chunk is filled by one group, and the chunks are collected."""
    chunks = 1
    while chunks * CHUNK_BITS < min(total * FILTER_BITS, MOST_BITS):
        chunks *= 2
    shift = np.uint64(64 - (chunks.bit_length() - 1))

    def hashed(batches):
        for batch in batches:
            p = Places(batch.column("word").to_pylist())
            key = _mixed(p.hashes)
            chunk = (key >> shift).astype(np.int64) if chunks > 1 else np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(key.view(np.int64)), pa.array(p.sizes > LONG)], names=["chunk", "key", "long"])

    def fill(rows: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK_BITS // 8, np.uint8)
        key, more = rows.column("key").to_numpy().view(np.uint64), rows.column("long").to_numpy()
        for k in range(LONG_PROBES):
            bit = probe(key if k < PROBES else key[more], k)
            np.bitwise_or.at(bits, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = words.select("word").mapInArrow(hashed, "chunk long, key long, long boolean").groupBy("chunk").applyInArrow(fill, "chunk long, bits binary").collect()  # MOST_BITS bits at most
    held = np.zeros((chunks, CHUNK_BITS // 8), np.uint8)
    for r in rows:
        held[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return Filter(held)


# --- groups


def alphabet_of(words: DataFrame) -> np.ndarray:
    """The code points of the words, in order (there are at most 1,114,112)."""

    def run(batches):
        for batch in batches:
            code = np.unique(np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64))], names=["code"])

    return np.array(sorted(r.code for r in words.select("word").mapInArrow(run, "code long").distinct().collect()), np.uint32)


def near_words(words: DataFrame) -> DataFrame:
    """(wid, near, near_n): each pair of words of words (wid, word, n; words distinct) that are one edit apart, in both directions."""
    spark = words.sparkSession
    ship(spark)
    alphabet, known = alphabet_of(words), vocabulary_filter(words, words.count())
    shared = spark.sparkContext.broadcast((alphabet, known.bits))
    schema = pa.schema([("wid", pa.int64()), ("near", pa.string())])

    def run(batches):
        alphabet, bits = shared.value
        known = Filter(bits)
        step = max(1, PLACES * 64 // max(64, len(alphabet)))
        for batch in batches:
            for top in range(0, batch.num_rows, 4096):
                part = batch.slice(top, 4096)
                p, wid = Places(part.column("word").to_pylist()), part.column("wid").to_numpy()
                for first in range(0, len(p.word), step):
                    ids, got = [], []
                    for kind, place, code, hashes, sizes in neighbours(p, alphabet, first, min(first + step, len(p.word))):
                        for k in known.maybe(hashes, sizes):
                            ids.append(wid[p.word[place[k]]])
                            got.append(spelled(p, kind, place[k], code[k]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.string())], schema=schema)
        give_back()

    made = words.select("wid", "word").mapInArrow(run, "wid long, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("wid", "near", "near_n")


def variant_groups(counted: DataFrame, ratio: float = RATIO, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table of words with their counts.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. form: the near
    word with the largest n (of equal ones the first in code-point order), if that n is at least ratio times
    the word's own, else null. root: what following the forms leads to, the word itself if it has none. A word
    in several rows counts once with the sum of its counts; null words and counts are left out; an empty table gives no rows.
    """
    given = counted.select(F.col(word_col).alias("word"), F.col(n_col).cast("long").alias("n")).where("word is not null and n is not null")
    words = checkpointed(given.groupBy("word").agg(F.sum("n").alias("n")).withColumn("wid", F.monotonically_increasing_id()))
    found = near_words(words).groupBy("wid").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    first = words.join(found, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= ratio * F.col("n")
    formed = checkpointed(first.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
    # Forms lead to ever larger counts, so there is no circle. Each round doubles the steps that are followed.
    jumps = formed.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        next_ = jumps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        jumps = checkpointed(jumps.join(next_, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if not jumps.where("moved").limit(1).count():
            break
        jumps = jumps.drop("moved")
    return formed.join(jumps.select("word", F.col("to").alias("root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all whole texts of `documents` with their forms, as word_counts and variant_groups state (nulls, ties, repeated rows, empty tables: see there)."""
    return variant_groups(word_counts(documents(spark, sf_dir)))


OP12_SQL = """
WITH RECURSIVE
bit(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
tab AS (SELECT b, v FROM bit WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
per_doc AS (SELECT doc, run, count(*) AS n, doc || ':' || run AS whole FROM runs GROUP BY doc, run),
letters AS (SELECT doc, run, whole, unnest(string_split(whole, '')) AS c, unnest(range(1, length(whole) + 1)) AS pl FROM per_doc),
coded AS (SELECT doc, run, pl, unicode(c) AS u FROM letters),
bytes AS (
  SELECT doc, run, 2 * pl AS pl, CASE WHEN u < 128 THEN u ELSE 195 END AS b FROM coded
  UNION ALL SELECT doc, run, 2 * pl + 1, u - 64 FROM coded WHERE u >= 128),
placed AS (
  SELECT doc, run, b, count(*) OVER (PARTITION BY doc, run) AS size,
         count(*) OVER (PARTITION BY doc, run) - row_number() OVER (PARTITION BY doc, run ORDER BY pl) AS d FROM bytes),
far(d, b, v) AS (
  SELECT 0, b, v FROM tab
  UNION ALL SELECT far.d + 1, far.b, xor(far.v >> 8, tab.v) FROM far JOIN tab ON tab.b = far.v & 255
  WHERE far.d < (SELECT max(size) FROM placed)),
init(d, v) AS (
  SELECT 0, CAST(4294967295 AS BIGINT)
  UNION ALL SELECT init.d + 1, xor(init.v >> 8, tab.v) FROM init JOIN tab ON tab.b = init.v & 255
  WHERE init.d < (SELECT max(size) FROM placed)),
crc AS (
  SELECT p.doc, p.run, xor(xor(bit_xor(far.v), any_value(init.v)), 4294967295) AS h
  FROM placed p JOIN far ON far.d = p.d AND far.b = p.b JOIN init ON init.d = p.size GROUP BY p.doc, p.run),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM per_doc JOIN crc USING (doc, run)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
fewer AS (SELECT DISTINCT c.word, c.n, w.word AS near, w.n AS near_n FROM cut c JOIN words w ON w.word = c.rest),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT * FROM fewer
  UNION ALL SELECT near, near_n, word, n FROM fewer),
placed_near AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.near_n >= 2 * w.n THEN p.near END AS form,
         CASE WHEN p.near_n >= 2 * w.n THEN p.near_n END AS form_n
  FROM words w LEFT JOIN placed_near p ON p.word = w.word AND p.r = 1),
chain(word, pl) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.pl WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.pl AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed g ON g.word = c.pl AND g.form IS NULL
"""
