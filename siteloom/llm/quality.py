"""Quality classifier by weak labels.

Heuristic labellers look at a text and vote good, bad or not at all. How accurate each of them is
comes from expectation-maximisation over the counts of all vote patterns of the corpus, without any
given label. The posteriors of a bounded sample then train a hashed linear scorer on runs of byte
classes and short byte n-grams, which generalises beyond the votes. A document's score is the mean of the
scorer's log-odds and those of its own votes, as a probability: not the scorer's alone.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.llm.common import documents, give_back, map_texts, slices
from siteloom.llm.ngrams import Batch, logistic
from siteloom.session import checkpointed, ship

#: Documents whose posteriors train the scorer.
TRAIN_ROWS = 3000
#: Buckets of 4-byte n-grams; classes of bytes and the length of their runs' n-grams.
BITS, CLASSES, SHAPE = 12, 10, 3
PENALTY, ROUNDS = 1e-3, 200
#: No labeller is trusted to see more than this share of the bad texts: each knows its own kind only.
MOST_SEEN = 0.85
#: Weight of the scorer against the posterior of the votes, both as log-odds.
SCORER_SHARE = 0.5

# Fixed list of frequent words, for four languages.
FREQUENT = frozenset(
    "the of and to in is that it for on with as was be by this are or an at from which not have"
    " der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an"
    " de la le et les des en un une du que est pour qui dans par sur au plus ne pas se ce il"
    " el los y las del por con para una su al lo como más o pero sus".split()
)
_SYMBOLS = np.frombuffer(b"#$%&*|@^~<>{}[]\\_=+", np.uint8)


def _class_table() -> np.ndarray:
    t = np.full(256, 9, np.uint8)  # control
    t[128:] = 1  # letters beyond ASCII, counted as lower case
    t[ord("a") : ord("z") + 1] = 1
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("0") : ord("9") + 1] = 3
    t[ord(" ")] = 0
    t[[10, 13]] = 4
    for k, chars in ((5, b".,"), (6, b"!?"), (7, b";:'\"()-/")):
        t[list(chars)] = k
    t[_SYMBOLS] = 8
    return t


_CLASS = _class_table()

LABELLERS = ("length", "case", "symbols", "exclamations", "frequent words", "repeated lines", "stuck words", "few words", "word length", "cells")


def votes(text: str) -> list[int]:
    """A vote of each labeller: 2 good, 0 bad, 1 none."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    n = len(words)
    if not n:
        return [0] + [1] * (len(LABELLERS) - 1)
    held = np.bincount(_CLASS[data], minlength=CLASSES)
    letters = max(1, int(held[1] + held[2]))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols, calls, shout = held[8] / len(data), held[6] / n, held[2] / letters
    common = sum(w in FREQUENT for w in map(str.lower, words)) / n
    again = 1 - len(set(lines)) / len(lines)
    varied = len(set(words)) / n
    stuck, long = sum(map(eq, words, words[1:])) / n, letters / n
    judge = lambda bad, good: 0 if bad else 2 if good else 1
    return [
        judge(n < 3, n >= 40),
        judge(shout > 0.3, shout < 0.1),
        judge(symbols > 0.03, symbols < 0.005),
        judge(calls > 0.2, calls < 0.03),
        judge(n >= 20 and common < 0.04, common > 0.12),
        judge(len(lines) >= 4 and again > 0.3, again < 0.1 and len(lines) >= 4),
        judge(stuck > 0.1, stuck < 0.03 and n >= 10),
        judge(n >= 50 and varied < 0.35 and stuck > 0.05, n >= 50 and varied > 0.35),
        judge(long < 2 or long > 14, 3 < long < 9),
        judge(text.count("|") + text.count("\t") > 0.1 * n, len(lines) >= 3 and "|" not in text),
    ]


def _pattern(given: list[int]) -> int:
    out = 0
    for v in given:
        out = out * 3 + v
    return out


def _unpattern(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


class Labelling:
    """Accuracies of the labellers and the share of good texts, by expectation-maximisation.

    table[y, k, v] is the probability that labeller k, if it votes on a text of class y, votes v.
    Not voting tells nothing of the class, or else the length of a text, on which most abstentions
    rest, would be learnt as its quality. The start takes one bad vote for a bad text.
    """

    def __init__(self, patterns: list[tuple[int, int]], rounds: int = 200):
        given = np.array([_unpattern(c) for c, _ in patterns]).reshape(-1, len(LABELLERS))
        n = np.array([k for _, k in patterns], float)
        p = np.where((given == 0).any(1), 0.1, 0.9)
        self.table = np.full((2, len(LABELLERS), 3), 0.5)
        self.share = 0.5
        for _ in range(rounds if len(n) else 0):
            for y, q in ((0, n * (1 - p)), (1, n * p)):
                bad, good = (((given == v) * q[:, None]).sum(0) + 1 for v in (0, 2))
                seen = bad / (bad + good) if y else np.minimum(bad / (bad + good), MOST_SEEN)
                self.table[y, :, 0], self.table[y, :, 2] = seen, 1 - seen
            self.table[:, :, 1] = 1
            self.share = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
            new = self.posterior(given)
            if np.abs(new - p).max() < 1e-7:
                break
            p = new

    def log_odds(self, given: np.ndarray) -> np.ndarray:
        ratio = np.log(self.table[1]) - np.log(self.table[0])
        return np.log(self.share / (1 - self.share)) + ratio[np.arange(len(LABELLERS)), given].sum(-1)

    def posterior(self, given: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(given), -30, 30)))


def _features(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte n-grams and of byte-class n-grams at each place."""
    classes = _CLASS[batch.data].astype(np.uint16)
    padded = np.concatenate([classes, np.zeros(SHAPE - 1, np.uint16)])
    shape = np.zeros(len(classes), np.uint16)
    for k in range(SHAPE):
        shape = shape * np.uint16(CLASSES) + padded[k : k + len(classes)]
    return batch.hashed(4, BITS), shape


_PAD = 3


class Scorer:
    """Linear in the square roots of relative counts is costly; linear in relative counts, scaled, isn't."""

    def __init__(self, grams: np.ndarray, shapes: np.ndarray, intercept: float):
        self.grams, self.shapes, self.intercept = grams.astype(np.float32), shapes.astype(np.float32), intercept

    def log_odds(self, texts: list[str]) -> np.ndarray:
        batch = Batch([t.encode("utf-8", "replace") for t in texts], _PAD)
        g, s = _features(batch)
        return (batch.sums(self.grams[g]) + batch.sums(self.shapes[s])).astype(float) / batch.sizes + self.intercept


#: Relative counts are small; features are multiplied by these, so that one penalty suits both.
_SCALE = (40.0, 20.0)


def fit(df: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> tuple[Labelling, Scorer]:
    """Accuracies from the vote patterns of all rows; the scorer from the `rows` with the smallest hash of id and text."""
    spark = df.sparkSession
    ship(spark)
    named = df.select(F.xxhash64(F.lit(3), id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    voted = checkpointed(map_texts(named, ["h"], "text", "pattern int", lambda: lambda texts: {"pattern": [_pattern(votes(t)) for t in texts]}))
    counts = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3**10 patterns at most
    labelling = Labelling([(r.pattern, r.n) for r in counts])
    last = voted.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return labelling, Scorer(np.zeros(1 << BITS), np.zeros(CLASSES**SHAPE), 0.0)
    some = named.where(F.col("h") <= last).dropDuplicates(["h"])

    def featured(texts):
        out: dict[str, list] = {"pattern": [], "x": []}
        for text in texts:
            batch = Batch([text.encode("utf-8", "replace")], _PAD)
            g, s = _features(batch)
            both = np.concatenate([np.bincount(g, minlength=1 << BITS) * _SCALE[0], np.bincount(s, minlength=CLASSES**SHAPE) * _SCALE[1]]) / batch.sizes[0]
            at = np.flatnonzero(both)
            out["pattern"].append(_pattern(votes(text)))
            out["x"].append(at.astype(np.int32).tobytes() + both[at].astype(np.float32).tobytes())
        return out

    got = map_texts(some, ["h"], "text", "pattern int, x binary", lambda: featured).orderBy("h").collect()  # buckets of at most `rows` texts
    x = np.zeros((len(got), (1 << BITS) + CLASSES**SHAPE), np.float32)
    for k, r in enumerate(got):
        half = len(r.x) // 2
        x[k, np.frombuffer(r.x[:half], np.int32)] = np.frombuffer(r.x[half:], np.float32)
    y = labelling.posterior(np.array([_unpattern(r.pattern) for r in got]))
    del got
    w, b = logistic(x, y, np.ones(len(y)), PENALTY, ROUNDS)
    return labelling, Scorer(w[: 1 << BITS] * _SCALE[0], w[1 << BITS :] * _SCALE[1], b)


def _log_odds(fitted: tuple[Labelling, Scorer], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good by the votes alone, and by both: a document is kept from 0 on."""
    labelling, scorer = fitted
    by_votes = labelling.log_odds(np.array([votes(t) for t in texts]))
    return by_votes, (1 - SCORER_SHARE) * by_votes + SCORER_SHARE * scorer.log_odds(texts)


def quality(df: DataFrame, id_cols: list[str], text_col: str = "text", fitted: tuple[Labelling, Scorer] | None = None) -> DataFrame:
    """id_cols, posterior (of the votes), score (0 to 1) and kept (score >= 0.5) of every row.

    A null text counts as empty; empty texts have the one vote "too short". Texts of any length are read whole. Repeated rows
    get the same score. An empty table gives an empty one; other columns are left out. All texts vote; TRAIN_ROWS of them train.
    """
    fitted = fitted or fit(df, id_cols[0], text_col)
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def make():
        def work(texts):
            by_votes, both = _log_odds(shared.value, texts)
            odds = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return {"posterior": odds(by_votes), "score": odds(both), "kept": both >= 0}

        return work

    return map_texts(df, id_cols, text_col, "posterior double, score double, kept boolean", make)


def kept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that the classifier rejects, columns as they were. As quality otherwise."""
    ids = [c for c in df.columns if c != text_col]
    shared = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col))
    ship(df.sparkSession)

    def run(batches):
        give_back()
        for batch in batches:
            for part, texts in slices(batch, text_col):
                yield part.filter(pa.array(_log_odds(shared.value, texts)[1] >= 0))
        give_back()

    return df.select(*ids, text_col).mapInArrow(run, df.select(*ids, text_col).schema).select(*df.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and verdict of every document, as quality states (nulls, empty and long texts, repeated rows, empty tables: see there)."""
    return quality(documents(spark, sf_dir), ["doc_id"])
