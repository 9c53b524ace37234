"""Exact top-k search, spelling variants and phrases, each against a plain computation."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siteloom.llm import collocations, mtree, spelling
from siteloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_topk", "op12_spelling", "op13_collocations"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(ORACLE[name]).select(*got.columns).fetchall(), key=repr)


# --- top-k


def best(rows, k, every):
    out = set()
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for a, (q, v) in enumerate(whole):
        if q % every == 0:
            got = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(whole) if b != a and len(w) == len(v))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(got, 1)}
    return out


@pytest.mark.parametrize("page, sample", [(8192, 8192), (40, 64)])
def test_top_products_by_brute_force(spark, monkeypatch, page, sample):
    for name, value in (("PAGE_ROWS", page), ("SAMPLE_ROWS", sample), ("REGION_ROWS", page), ("QUERY_ROWS", 3)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 6)) * rng.choice([0.1, 1, 30], (30, 1))
    rows = np.repeat(base, 20, 0) + 0.05 * rng.standard_normal((600, 6))
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    data += [(1000 + i, [2.5, 0.0, -1.0, 3.0, 0.5, 1.0]) for i in range(200)]  # a third of all rows are copies
    got = {tuple(r) for r in mtree.top_products(spark.createDataFrame(data, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, k=7).collect()}
    assert got == best(data, 7, 20)


def test_top_products_odd_rows(spark):
    bad = [(20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (None, [5.0, 5.0])]
    data = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0]), (3, [-1e3, 0.5]), (100, [0.0, 0.0]), (120, [1.0, 1.0, 1.0]), (5, [0.3, 0.3, 0.3]), (140, []), (7, []), *bad]
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in data], "vec_id long, embedding array<double>, own string, region int, score double")
    got = {tuple(r) for r in mtree.top_products(df, lambda i: i % 20 == 0).collect()}
    assert got == best(data, 10, 20)
    assert mtree.top_products(df.limit(0), lambda i: i % 20 == 0).collect() == []
    with pytest.raises(ValueError):
        mtree.top_products(spark.createDataFrame([(0, [1e38])], df.select("vec_id", "embedding").schema), lambda i: i >= 0)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_page_prunes_and_is_exact(scale):
    rng = np.random.default_rng(5)
    rows = np.floor(1024 * scale * (np.repeat(rng.standard_normal((40, 8)), 100, 0) + 0.02 * rng.standard_normal((4000, 8))))
    rows[:500] = rows[0]  # ties
    most = float((rows * rows).sum(1).max()) * (1 + 1e-12)
    page = mtree.Page(np.arange(4000), np.arange(4000)[::-1].copy(), rows, most)
    for q in range(0, 4000, 200):
        places, scores = page.search(q, rows[q], -np.inf, 10)
        exact = rows.astype(np.int64) @ rows[q].astype(np.int64)
        order = [j for j in np.lexsort((page.ids, -exact)) if j != q][:10]
        assert places.tolist() == order and scores.tolist() == exact[order].tolist()
    assert page.skipped + page.computed <= 20 * 4000 and page.computed < 20 * 4000 / 3  # most rows are never computed


# --- spelling


def plain_variants(counts, ratio=2):
    letters, out = sorted(set("".join(counts))), {}
    for w, n in counts.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for j in (0, 1) if i + j <= len(w) for c in letters}
        out[w] = sorted((-counts[v], v) for v in near - {w} if v in counts)
    form = {w: v[0][1] if v and -v[0][0] >= ratio * counts[w] else None for w, v in out.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(out[w]), counts[form[w]] if form[w] else None) for w in counts}


def test_spelling_by_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(150)] + ["aaaa", "aaaaa", "aabaa", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150, "𝔘nicode", "Unicode", "𝔘nicodé"]
    counts = {w: rng.choice([1, 2, 3, 7, 20, 90]) for w in base}
    df = spark.createDataFrame([(w, n, "z", 0) for w, n in counts.items()] + [(None, 3, "z", 0), ("abc", None, "z", 0)], "word string, n long, near string, wid int")
    assert {tuple(r) for r in spelling.variant_groups(df).collect()} == plain_variants(counts)


def test_spelling_forms_lead_to_the_root(spark):
    counts = {"abcdef"[: 6 - k] or "g": 3**k for k in range(6)}  # each is the next one's variant
    got = {r["word"]: r["root"] for r in spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a"}


def test_spelling_without_a_bound_on_the_filter(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BITS", 1 << 12)  # several chunks
    counts = {w: len(w) for w in {"".join(random.Random(k).choices("abc", k=5)) for k in range(90)}}
    assert {tuple(r) for r in spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()} == plain_variants(counts)


def test_neighbours_are_distinct():
    words = ["aab", "a", "baaa", "é"]
    p, alphabet = spelling.Places(words), np.array(sorted(map(ord, "abé")), np.uint32)
    made = Counter()
    for kind, place, code, hashes, sizes in spelling.neighbours(p, alphabet, 0, len(p.word)):
        for k, c, h, n in zip(place, code, hashes, sizes):
            text = spelling.spelled(p, kind, k, c)
            assert len(text) == n and spelling.Places([text]).hashes[0] == h
            made[p.words[p.word[k]], text] += 1
    assert set(made.values()) == {1}
    assert {t for w, t in made if w == "a"} == {"", "b", "é", "aa", "ba", "ab", "éa", "aé"}


def test_runs_of_a_long_text(monkeypatch):
    text = "Ab cd, Straße 12 Ab " * 50
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "LISTED", 7)
    assert spelling.runs_of(text) == whole == {"ab": 100, "cd": 50, "straße": 50}


def test_word_counts(spark):
    rows = [(1, "Straße ÀBCDE straße, ab×cd÷ef naïve" * 3), (2, None), (3, ""), (None, "Straße naïve naïve"), (4, "word " * 500), (4, "word " * 500), (5, "x" * 30000)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    assert {tuple(r) for r in spelling.word_counts(df, least_length=4, least_count=2).collect()} == {(w, n) for w, n in want.items() if n >= 2 and len(w) >= 4}
    assert spelling.variant_groups(spelling.word_counts(df.limit(0))).collect() == []


# --- phrases


def plain_phrases(rows, least, most_words, share, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + z])) for z in range(1, most_words + 1) for i in range(len(words) - z + 1))
    known = {g: a for g, a in f.items() if a >= least}
    inside = lambda g, h: len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))
    found = {}
    for (lang, g), a in known.items():
        if len(g) > 1 and not any(x == lang and inside(g, h) and 100 * b >= share * a for (x, h), b in known.items()):
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return {(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, got in found.items() for r, (s, a, p, x, y) in enumerate(sorted(got)[:top], 1)}


@pytest.mark.parametrize("names, ids, share, most_words, top", [(10**6, 10**6, 100, 5, 2000), (0, 10**6, 60, 4, 20), (10**6, 0, 100, 3, 5)])
def test_collocations_by_brute_force(spark, monkeypatch, names, ids, share, most_words, top):
    monkeypatch.setattr(collocations, "BROADCAST_NAMES", names)
    monkeypatch.setattr(collocations, "PACKED_IDS", ids)
    monkeypatch.setattr(collocations, "PART_WORDS", 100)
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(["the cat", "sat", "on the mat", "the", "a a", "é x", "ZÄ", "zÄ"]) for _ in range(rng.randint(0, 9)))
    texts = [rng.choice([", ", ".", "\n", "\t", "\r\n \v"]).join(line() for _ in range(rng.randint(0, 8))) for _ in range(150)]
    rows = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts] + [(None, "en"), ("", None), ("a a a a", "fr")]
    df = spark.createDataFrame([(t, g, 1, "y") for t, g in rows], "text string, lang string, n int, words string")
    got = collocations.collocations(df, least_count=4, most_words=most_words, share=share, top=top)
    assert {tuple(r) for r in got.collect()} == plain_phrases(rows, 4, most_words, share, top)


def test_collocations_block_ends(monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_CHARS", 7)
    text = "One two. three,, four five six seven eight nine; ten" + " eleven" * 5
    keys = []
    codes = collocations.Codes("en", keys)
    whole = np.concatenate([collocations.coded(p, codes) for p in collocations.parts_of(text)])
    monkeypatch.setattr(collocations, "SPLIT_CHARS", 1 << 20)
    assert collocations.squeezed(whole).tolist() == collocations.squeezed(collocations.coded(text.lower(), codes)).tolist()


def test_collocations_empty_and_exact(spark):
    schema = "text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, "en"), ("", None), ("once only", "en")], schema)).collect() == []
    long = spark.createDataFrame([("word pair " * 60_000, "en")], schema)
    assert [r["phrase"] for r in collocations.collocations(long, most_words=2).collect()] == ["word pair", "pair word"]


# --- names that clash


def test_clashing_names(spark):
    from siteloom.llm import mixing, secrets, simhash

    rows = [(1, "password: abcdefgh1 x", "a"), (2, "nothing here", "b"), (None, None, "a")]
    for name in ("tokens", "base", "found", "text2", "__text"):
        df = spark.createDataFrame(rows, f"`{name}` long, text string, source string")
        got = secrets.secret_spans(df, [name]).collect()
        assert {r[0]: len(r[1]) for r in got} == {1: 1, 2: 0, None: 0}
    for name in ("fp", "rep", "component_id"):
        df = spark.createDataFrame(rows + [(7, "nothing here", "c")], f"`{name}` long, text string, source string")
        assert {r[0]: r[2] for r in simhash.simhash_groups(df, name).collect()} == {1: 1, 2: 2, 7: 2, None: None}
    df = spark.createDataFrame([(k, "one two three", "ab"[k % 2], 7, 8) for k in range(6)], "doc_id long, text string, source string, __mix_n int, __mix_s int")
    got = mixing.mix(df, max_repeats=2.0).collect()
    assert {(r["__mix_n"], r["__mix_s"]) for r in got} == {(7, 8)} and {r.doc_id for r in got} == set(range(6))


def test_simhash_groups_empty_and_long(spark, monkeypatch):
    from siteloom.llm import simhash

    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "ab cd ef gh " * 30
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, 3) == whole
