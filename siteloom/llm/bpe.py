"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece's bytes exactly one token can end its encoding; that token is stored.
The encoding of any prefix is read by walking back, an append only adds entries, and an edit
recomputes from the edit on until the entries agree again with those of the old bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession

from siteloom.llm.common import documents, map_texts

#: Pieces whose encodings one worker keeps; an older generation of as many stays readable.
CACHE_PIECES = 150_000
#: Characters from which a text's pieces are taken one by one instead of as a list.
LONG = 1_000_000
#: Pairs of tokens whose adjacency one worker keeps.
CACHE_PAIRS = 100_000


class Vocabulary:
    """Ranks of byte tokens, with the two halves that each token was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.backward: dict = {}
        self.known = Pairs(self.adjacent)
        for token in sorted(ranks, key=ranks.__getitem__):
            rank = ranks[token]
            parts = [token] if len(token) == 1 else self._merged(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            elif len(parts) > 2:  # no run of merges leads to this token; tiktoken gives it for a whole piece only
                continue
            else:
                self.halves[rank] = (rank, rank)
            node = self.backward
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = rank

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """token after every merge of a rank smaller than `below`."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens.

        Undoes merges from the later to the earlier. A token across the border that would have been
        formed before the last undone merge forbids the pair.
        """
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        bound = len(bytes_of) * 2
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], bound) < bound:
                return False
            if left > right:  # the left one is the later merge
                bound, inner = left, halves[left][1]
                if inner != left:
                    left = inner
                    continue
                bound = right + 1  # a single byte: only the right one can be undone
                inner = halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, inner = right + 1, halves[right][0]
                if inner != right:
                    right = inner
                    continue
                bound = left
                inner = halves[left][1]
                if inner == left:
                    return True
                left = inner


class Pairs(dict):
    """adjacent() by pair of tokens (left * 2**32 + right), as far as it was asked; starts anew when full."""

    def __init__(self, adjacent):
        self.adjacent = adjacent

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        found = self[pair] = self.adjacent(pair >> 32, pair & 0xFFFFFFFF)
        return found


class PrefixEncoder:
    """The encoding of one piece of bytes, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes; each new prefix gets the one token that can end its encoding (the longest is the likeliest)."""
        first = len(self.data)
        self.data += more
        data, last, root, known = self.data, self.last, self.vocabulary.backward, self.vocabulary.known
        for end in range(first, len(data)):
            node, at, fits = root, end, []
            while at >= 0:
                node = node.get(data[at])
                if node is None:
                    break
                at -= 1
                if -1 in node:
                    fits.append((at, node[-1]))
            while fits:
                at, token = fits.pop()
                if at < 0 or known[last[at] << 32 | token]:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end] and returns how many entries were computed anew.

        Entries before start stand. After the new bytes, as soon as as many entries in a row as the
        longest token has bytes equal the old ones, all further ones must be equal too.
        """
        old, longest = self.last[end:], max(map(len, self.vocabulary.ranks))
        rest = bytes(self.data[end:])
        del self.data[start:], self.last[start:]
        self.append(new)
        done = equal = 0
        for k in range(len(rest)):
            self.append(rest[k : k + 1])
            done += 1
            equal = equal + 1 if self.last[-1] == old[k] else 0
            if equal >= longest:
                self.data += rest[k + 1 :]
                self.last += old[k + 1 :]
                break
        return len(new) + done

    def tokens(self) -> list[int]:
        """The encoding of all bytes, walked back from the last entry."""
        out, at, size = [], len(self.data), self.vocabulary.size
        while at:
            out.append(self.last[at - 1])
            at -= size[out[-1]]
        return out[::-1]


def short_tokens(vocabulary: Vocabulary, data: bytes) -> tuple[int, ...]:
    """As PrefixEncoder(vocabulary, data).tokens(), for short data: entries are computed from the end, only those that are asked for."""
    root, known, last = vocabulary.backward, vocabulary.known, [None] * len(data)

    def ask(end: int) -> int:
        token = last[end]
        if token is None:
            node, at, fits = root, end, []
            while at >= 0:
                node = node.get(data[at])
                if node is None:
                    break
                at -= 1
                if -1 in node:
                    fits.append((at, node[-1]))
            while fits:
                at, token = fits.pop()
                if at < 0 or known[ask(at) << 32 | token]:
                    break
            last[end] = token
        return token

    out, at, size = [], len(data) - 1, vocabulary.size
    while at >= 0:
        out.append(ask(at))
        at -= size[out[-1]]
    out.reverse()
    return tuple(out)


#: Bytes up to which short_tokens is used; it recurses.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Cache(dict):
    """ids by piece; forgets the older half when it is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}
        self.names = {i: str(i) for i in vocabulary.bytes_of}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            data = piece.encode("utf-8", "replace")
            whole = self.vocabulary.ranks.get(data)
            found = (whole,) if whole is not None else short_tokens(self.vocabulary, data) if len(data) <= SHORT else tuple(PrefixEncoder(self.vocabulary, data).tokens())
        if len(piece) <= SHORT:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


_READY: dict[str, Cache] = {}


def name_of(ranks: dict[bytes, int]) -> str:
    """A digest of a vocabulary."""
    return hashlib.sha256(b"".join(b"%d %d " % (v, len(k)) + k for k, v in sorted(ranks.items()))).hexdigest()


def ready(name: str, ranks: Callable[[], dict[bytes, int]]) -> Cache:
    """This process's cache for the vocabulary of that name, built when it is first asked for. Workers find this
    function by import, so tasks that follow each other in one worker share it; only the last vocabulary is kept."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Cache(Vocabulary(ranks()))
    return _READY[name]


def encode(texts: Iterable[str], pattern, cache: Cache) -> Iterable[tuple[str, list[int]]]:
    """(decimal ids joined by one space, ids) of each text."""
    of, name = cache.__getitem__, cache.names.__getitem__
    for text in texts:
        pieces = pattern.findall(text) if len(text) < LONG else (m[0] for m in pattern.finditer(text))
        ids = list(chain.from_iterable(map(of, pieces)))
        yield " ".join(map(name, ids)), ids


def bpe_encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_cols: list[str], text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    Returns id_cols, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids (array of int).
    A null or empty text has no ids (both digests are those of the empty string); repeated rows are
    kept; an empty table gives an empty table. The ranks (one vocabulary file, about 1 MB) are
    broadcast; each worker process builds its tables once.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    name = name_of(ranks)

    def make():
        cache, rx = ready(name, lambda: shared.value), regex.compile(pattern)
        bytes_of = cache.vocabulary.bytes_of.__getitem__

        def work(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            for written, ids in encode(texts, rx, cache):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(written.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join(map(bytes_of, ids))).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return work

    return map_texts(df, id_cols, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)


def vocabulary_file() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and digests of every document, as bpe_encode states; equal to tiktoken's ids. Null, empty and very long texts, repeated rows and an empty table: see there."""
    ranks, pattern = vocabulary_file()
    return bpe_encode(documents(spark, sf_dir), ranks, pattern, ["doc_id"])
