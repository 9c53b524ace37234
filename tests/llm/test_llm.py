import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import ann, bpe, chat, mixing, neardup, pii, quality, secrets, simhash, toxicity
from siteloom.llm.queries import ORACLE, QUERIES
from siteloom.operators import neargroups

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def held(spark, tmp_path, rows):
    """A folder with these documents."""
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ODD = [(1, None, "a"), (2, "", None), (3, "é" * 3000, "a"), (4, "a b", "b"), (4, "a b", "b"), (None, "token: abcdefgh12345", "a")]


# --- vectors


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def clusters(seed=0, n=400, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 8, dim))
    rows = np.repeat(base, 8, 0) + rng.standard_normal((n // 8 * 8, dim)) * rng.choice([0, 0.1, 0.3], (n // 8 * 8, 1))
    return [(int(k), [float(x) for x in row], int(k // 8 % 3)) for k, row in enumerate(rows)]


@pytest.mark.parametrize("root, large, cell, block", [(2, 8192, 2048, 1024), (1000, 8192, 2048, 1024), (1, 6, 3, 8), (6, 10, 4, 5)])
def test_neardup_by_brute_force(spark, monkeypatch, root, large, cell, block):
    """With one level of pivots, none, and two of them."""
    for name, value in (("ROOT", root), ("LARGE_CELL", large), ("CELL_ROWS", cell), ("BLOCK_ROWS", block)):
        monkeypatch.setattr(neardup, name, value)
    rows = clusters()
    odd = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0, None] * 4, 1), (1004, rows[0][1], None), (1005, rows[0][1][:4], 0), (1006, [3e38] * 8, 2)]
    got = neardup.embedding_neardup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)))
    e = np.array([r[1] for r in rows], np.float32).astype(float)
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    comp = components(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    res = {r.vec_id: r for r in got.collect()}
    assert len(res) == len(rows) + len(odd)
    for k in range(len(rows)):
        assert (res[k].n_links, res[k].component_id, res[k].kept) == (near[k].sum(), comp[k], comp[k] == k)
    assert all((res[k].n_links, res[k].component_id, res[k].kept) == (0, k, True) for k, _, _ in odd)
    assert neardup.embedding_neardup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cells_leave_no_partner_out():
    """Whatever lies within r of a row is in a cell that the row visits; most other cells aren't visited."""
    rng = np.random.default_rng(5)
    rows = neardup.unit(np.repeat(rng.standard_normal((60, 16)), 20, 0) + 0.15 * rng.standard_normal((1200, 16)))
    cells = neardup.Cells(neardup._spread(rows[::3], 12))
    top = cells.home(rows)[2]
    cells.part({int(p): neardup._spread(rows[top == p], 4) for p in range(12) if (top == p).sum() > 60})
    cell, near, top, far = cells.home(rows)
    most = lambda keys, d: {int(k): float(d[keys == k].max()) for k in np.unique(keys)}
    r = math.sqrt(2 - 2 * 0.93)
    visited = set(zip(*(x.tolist() for x in cells.visits(rows, r + neardup.SLACK, most(cell, near), most(top, far)))))
    i, j = np.nonzero(np.linalg.norm(rows[:, None] - rows[None], axis=2) <= r)
    assert all((a, c) in visited for a, c in zip(i.tolist(), cell[j].tolist())) and len(cells.within) > 2
    assert len(visited) < 0.5 * len(rows) * len(np.unique(cell))


def test_neardup_query_uses_pivots(spark, monkeypatch):
    seen, plain = [], neardup._cells
    monkeypatch.setattr(neardup, "_cells", lambda *a: seen.append(plain(*a)) or seen[-1])
    neardup.op1_neardup(spark, "/root/testdata/sf0.01").count()
    assert seen and all(len(c.top) > 1 for c in seen[0][0].values()) and seen[0][0]


def test_neardup_sql(compare):
    compare(QUERIES["op1_neardup"], ORACLE["op1_neardup"])


@pytest.mark.parametrize("sample, lists, n", [(8192, 100, 1500), (400, 200, 6000)])
def test_ann_recall_and_scores(spark, monkeypatch, sample, lists, n):
    """Also with a sample that is a small part of the table."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(ann, "LIST_ROWS", lists)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    e = rng.standard_normal((n, 32)) * rng.uniform(0.5, 2, (n, 1))
    e[7] = e[8]  # a tie
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(e)] + [(50_000, None), (50_020, [0.0] * 32), (None, [1.0] * 32), (50_040, [float("inf")] * 32)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("own", F.lit(1)), lambda i: i % 20 == 0).collect()
    by, hits = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, n, 20))
    for q, own in by.items():
        s = e @ e[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(n), -s))[:20]
        own.sort(key=lambda r: r.rank)
        hits += len({r.vec_id for r in own} & set(want.tolist()))
        assert [r.rank for r in own] == list(range(1, 21)) and all(own[i].score >= own[i + 1].score for i in range(19))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
    assert hits / (len(by) * 20) >= 0.9


def test_ann_odd_rows(spark):
    kind = "vec_id long, embedding array<double>"
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], kind), lambda i: i == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in few] == [(1, 1), (2, 2)]
    assert ann.nearest(spark.createDataFrame([], kind), lambda i: i == 0).count() == 0
    mixed = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [5.0, 0.0]), (0, [2.0, 0.0]), (20, [1.0, 1.0, 1.0]), (21, [1.0, 0.0, 0.0]), (40, [1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(mixed, kind), lambda i: i % 20 == 0).collect())
    assert got == sorted([(0, 1, 1, 5.0), (0, 2, 0, 2.0), (0, 3, 1, 1.0), (0, 1, 1, 10.0), (0, 2, 0, 2.0), (0, 3, 1, 2.0), (20, 1, 21, 1.0)])


def test_ann_looks_into_all_lists(spark, monkeypatch):
    """A query whose probed lists hold too few rows still gets k results."""
    monkeypatch.setattr(ann, "LIST_ROWS", 3)
    monkeypatch.setattr(ann, "LIST_SAMPLE", 3)
    monkeypatch.setattr(ann, "RECALL", 0.0)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.standard_normal(4)]) for k in range(120)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {k: 20 for k in range(0, 120, 20)}


# --- secrets


def test_secrets_base(spark, tmp_path):
    texts = ["é api_key: 'abcdefgh' TOKEN=x token = secret=short PassWord=\"12345678\"", "AKIA" + "B" * 12 + " AKIA1 " + "0af9" * 8 + "g" + "a" * 31, "ſecret=abcdefghij", "token=token=abcdefgh", "a" * 5000 + " secret : " + "z" * 3000]
    rows = [(100 + k, t, "s") for k, t in enumerate(texts)] + ODD
    rx = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def base(t):
        out = [(m.start(), 0, "assign", m.end()) for m in rx.finditer(t) if len(m[1]) >= 8] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])

    got = secrets.op3_secrets(spark, held(spark, tmp_path, rows)).collect()
    want = sorted(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in base(t or "")).encode()).hexdigest() for _, t, _ in rows)
    assert sorted(r.base_sha256 for r in got) == want
    assert sum(r.n_assign for r in got) == sum(sum(x[2] == "assign" for x in base(t or "")) for _, t, _ in rows)


def test_secrets_many_in_one_text(spark):
    text = " ".join(f"token={k:08d}" for k in range(1500))
    found = secrets.secret_spans(docs(spark, [(1, text, "a")]), ["doc_id"]).first().base
    assert [(x.start, x.end) for x in found] == [m.span() for m in re.finditer(r"token=\d{8}", text)]


def test_secrets_randomness(spark):
    import base64

    rng = random.Random(4)
    rows = [(k, base64.b64encode(rng.randbytes(30)).decode() + " " + rng.randbytes(20).hex() + " some_long_identifier_name_2_of_things aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 0123456789abcdef0123456789abcdef0123456789abcdef01234567", "s") for k in range(60)]
    spans = [x.kind for r in secrets.secret_spans(docs(spark, rows), ["doc_id"]).collect() for x in r.found]
    assert spans.count("random_base64") >= 50 and 50 <= spans.count("random_hex") <= 70 and spans.count("random_base36") == 0
    assert secrets.cleared_from([(5, 0, 10), (5, 200, 10)]) == {5: 27} or 0 < secrets.cleared_from([(5, 0, 10), (5, 200, 10)])[5] <= 200


def test_secrets_after_equals_signs(spark):
    import base64

    rng = random.Random(5)
    rows, values = [], {}
    for k in range(60):
        v = base64.b64encode(rng.randbytes(32)).decode()
        text = f"AWS_SECRET_ACCESS_KEY={v}\nauth={v} https://x.y/z?sig={v}&a=b"
        rows.append((k, text, "s"))
        values[k] = [m.span() for m in re.finditer(re.escape(v), text)]
    got = {r.doc_id: [(x.start, x.end) for x in r.found if x.kind == "random_base64"] for r in secrets.secret_spans(docs(spark, rows), ["doc_id"]).collect()}
    assert sum(got[k] == values[k] for k in values) >= 50


def test_secrets_precision_and_recall(spark):
    """Planted random values against ordinary long tokens: identifiers, paths, numbers, words run together."""
    import base64

    rng = random.Random(9)
    words = "user account session profile handler request response manager config service index table value error message parser buffer stream worker thread".split()
    plain = [lambda: "_".join(rng.choice(words) for _ in range(5)), lambda: "/".join(rng.choice(words) for _ in range(6)), lambda: "".join(rng.choice(words).title() for _ in range(5)), lambda: "0" * 24 + str(rng.randrange(1000)), lambda: "2024" * 9]
    rows, planted, at = [], set(), {}
    for k in range(300):
        tokens = [rng.choice(plain)() for _ in range(3)]
        if k % 2:
            tokens.insert(rng.randrange(4), base64.b64encode(rng.randbytes(32)).decode() if k % 4 == 1 else rng.randbytes(20).hex())
        rows.append((k, " and ".join(tokens), "s"))
        planted |= {k} if k % 2 else set()
    for r in secrets.secret_spans(docs(spark, rows), ["doc_id"]).collect():
        at[r.doc_id] = [x for x in r.found if x.kind.startswith("random_")]
    caught = {k for k in planted if at[k]}
    false = sum(len(v) for k, v in at.items() if k not in planted)
    assert len(caught) / len(planted) >= 0.9 and false <= 0.1 * len(caught)
    assert secrets.secret_spans(docs(spark, []), ["doc_id"]).count() == 0


# --- BPE


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = bpe.vocabulary_file()
    return bpe.Vocabulary(ranks), pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, tmp_path, vocabulary):
    texts = ["Hello  world's\n\n\tüber 12345 <|endoftext|> 日本語 😀", " " * 3000, "a" * 5000, "it'll we've"]
    rows = [(10 + k, t, "s") for k, t in enumerate(texts)] + ODD
    got = bpe.op4_bpe(spark, held(spark, tmp_path, rows)).collect()
    want = sorted((len(ids := vocabulary[2].encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t, _ in rows)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_bpe_very_long_text(vocabulary):
    """Past LONG characters pieces are taken one by one; the ids are the same."""
    text = "Der 12th über-word's\n\n  end 日本語; " * 40_000
    assert len(text) > bpe.LONG
    (written, ids), = bpe.encode([text], regex.compile(vocabulary[1]), bpe.Cache(vocabulary[0]))
    assert ids == vocabulary[2].encode_ordinary(text) and written == " ".join(map(str, ids))


def test_bpe_empty_table(spark, tmp_path):
    assert bpe.op4_bpe(spark, held(spark, tmp_path, [])).count() == 0


def test_bpe_tables_once_in_each_worker(spark, tmp_path, vocabulary):
    """Many tasks, few workers: each worker process builds the tables once."""
    ranks, pattern = bpe.vocabulary_file()
    name, where = bpe.name_of(ranks), str(tmp_path)

    def build():
        open(f"{where}/{os.getpid()}-{random.random()}", "w").close()
        return {bytes([k]): k for k in range(256)}

    df = docs(spark, [(k, "some words", "s") for k in range(64)]).repartition(32)
    bpe.map_texts(df, ["doc_id"], "text", "n long", lambda: (bpe.ready(name + "test", build), lambda texts: {"n": [0] * len(texts)})[1]).count()
    built = [f.split("-")[0] for f in os.listdir(where)]
    assert len(built) == len(set(built)) <= 8


def test_bpe_appends_and_edits(vocabulary):
    v, _, enc = vocabulary
    rng, e = random.Random(2), bpe.PrefixEncoder(v, b"hello world this is a test " * 20)
    for _ in range(60):
        data, a = bytes(e.data), rng.randrange(len(e.data) - 6)
        b, new = a + rng.randrange(6), rng.choice([b"", b"x", b"ing the ", b"zz"])
        e.edit(a, b, new)
        assert bytes(e.data) == data[:a] + new + data[b:] and e.last == bpe.PrefixEncoder(v, bytes(e.data)).last
    for n in range(1, 40):
        data = bytes(rng.choice(b"abehinorst ") for _ in range(n))
        e = bpe.PrefixEncoder(v, data[: n // 2])
        e.append(data[n // 2 :])
        assert tuple(e.tokens()) == bpe.short_tokens(v, data) == tuple(enc._encode_single_piece(data))


# --- mixing


def plain_exponent(tokens, entropy=None, repeats=None, budget=None):
    """By plain bisection; and how often each source is read."""
    total = sum(tokens.values())

    def passes(a):
        z = sum((t / total) ** a for t in tokens.values())
        w = {s: (t / total) ** a / z for s, t in tokens.items()}
        own = budget or max(t / w[s] for s, t in tokens.items())
        return w, {s: w[s] * own / t for s, t in tokens.items()}

    def enough(a):
        w, often = passes(a)
        return -sum(x * math.log(x) for x in w.values()) <= entropy if entropy is not None else max(often.values()) <= repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    if enough(0.0):
        return 0.0, passes(0.0)[1]
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high, passes(high)[1]


@pytest.mark.parametrize("asked", [{"target_entropy": 0.9}, {"max_repeats": 4}, {"max_repeats": 3.0, "budget": 1500}, {"target_entropy": 9.0}, {"max_repeats": 0.5}])
def test_mixing_exponent(asked):
    tokens = {"a": 800, "b": 150, "c": 50}

    def sums(exponents):
        return [(sum((t / 1000) ** a for t in tokens.values()), sum((t / 1000) ** a * math.log(t / 1000) for t in tokens.values())) for a in exponents]

    want = plain_exponent(tokens, asked.get("target_entropy"), asked.get("max_repeats"), asked.get("budget"))[0]
    assert mixing.exponent_for(sums, 1000, 50, 800, **asked) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.exponent_for(sums, 1000, 50, 800)


def mixed_rows():
    rng = random.Random(1)
    return [(k, " ".join(["w"] * rng.randint(1, 9)), "big" if k < 900 else f"s{k % 3}" if k < 990 else None) for k in range(1000)]


def test_mixing_rows(spark):
    rows = mixed_rows()
    df = docs(spark, rows)
    out = mixing.mix(df, max_repeats=2.0).collect()
    size = {k: len(t.split()) for k, t, _ in rows}
    tokens = {}
    for k, _, s in rows:
        tokens[s] = tokens.get(s, 0) + size[k]
    often = plain_exponent(tokens, repeats=2.0)[1]
    got = {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + size[r.doc_id]
    assert {r.doc_id for r in out} == set(range(1000))  # every document at least once
    for s in tokens:
        assert 0 <= got[s] - often[s] * tokens[s] + 0.5 <= 10
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(7), max_repeats=2.0).collect()))
    assert mixing.mix(df.limit(0), max_repeats=2.0).count() == 0 and mixing.mix(docs(spark, ODD), max_repeats=2.0).count() >= len(ODD)
    assert sum(size[r.doc_id] for r in mixing.mix(df, target_entropy=1.0, budget=2000).collect()) == pytest.approx(2000, abs=45)
    again = mixing.mix(mixing.mix(df, max_repeats=2.0), max_repeats=2.0)
    assert again.columns == [*df.columns, "__epoch", "__block", "__place"]


@pytest.mark.parametrize("blocks, ranges", [(4096, 4096), (8, 4)])
def test_mixing_by_brute_force(spark, monkeypatch, blocks, ranges):
    """A part of a pass is the first documents in the order of block key, block and place whose tokens reach it."""
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    monkeypatch.setattr(mixing, "RANGES", ranges)
    rows = mixed_rows() + [(5000, "w " * 3000, "big"), (7, "w w", "big")]
    df = docs(spark, rows)
    out = mixing.mix(df, max_repeats=3.0).groupBy("source", "doc_id").count().collect()
    tokens, size = {}, {}
    for k, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
        size[s, k] = size.get((s, k), 0) + len(t.split())
    often = plain_exponent(tokens, repeats=3.0)[1]
    block = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.lit(blocks))
    key = F.coalesce("source", F.lit(mixing._NULL))
    for s in tokens:
        whole = math.floor(often[s] + 1e-9)
        part = round((often[s] - whole) * tokens[s])
        one = df.where(F.col("source").eqNullSafe(s)).select("doc_id", F.xxhash64(F.lit(mixing.SEED + 1), key, F.lit(whole), block), block, F.xxhash64(F.lit(mixing.SEED + 2), "doc_id", F.lit(whole))).distinct().collect()
        want, used = set(), 0
        for k, *_ in sorted(map(tuple, one), key=lambda x: (x[1:], x[0])):
            if used < part:
                want.add(k)
                used += size[s, k]
        rows_of = {k: sum(1 for i, _, z in rows if (i, z) == (k, s)) for k in {r.doc_id for r in out if r.source == s}}
        assert {r.doc_id: r["count"] for r in out if r.source == s} == {k: n * (whole + (k in want)) for k, n in rows_of.items()}


def test_mixing_many_sources(spark):
    """More sources than were once allowed on the driver."""
    df = spark.range(120_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 90_000, F.col("id")).otherwise(0).cast("string").alias("source"))
    got = mixing.mix(df, max_repeats=1.5).groupBy("source").count().orderBy(F.desc("count")).limit(3).collect()
    assert got[0]["count"] >= 30_001 and got[1]["count"] in (1, 2)


# --- SimHash


def plain_fingerprint(text, n=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("hot", [32, 1])
def test_simhash_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng, rows = random.Random(3), list(ODD[:5])
    for k in range(40):
        t = " ".join(rng.choice("abcdefgh") * 3 for _ in range(60))
        rows += [(100 + 10 * k, t, "s"), (101 + 10 * k, t + " end", "s"), (102 + 10 * k, t, "s")]
    fp = {(i, t): plain_fingerprint(t) for i, t, _ in rows}
    values = sorted(set(fp.values()))
    least = components(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 2])
    low = {}
    for (i, _), f in fp.items():
        low[least[f]] = min(low.get(least[f], i), i)
    got = simhash.simhash_groups(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted((i, plain_fingerprint(t), low[least[plain_fingerprint(t)]]) for i, t, _ in rows)


@pytest.mark.parametrize("hot", [32, 0])
def test_hamming_links(spark, hot):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(20)}
    signed = lambda v: v - 2**64 if v >> 63 else v
    want = components([signed(v) for v in values], [(signed(a), signed(b)) for a in values for b in values if (a ^ b).bit_count() <= 2])
    edges = simhash.hamming_links(spark.createDataFrame([(signed(v),) for v in values] + [(None,)], "fp long"), 2, hot).collect()
    assert components(list(want), [(r.src, r.dst) for r in edges]) == want


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neargroups, "BLOCK_ROWS", 4)
    rng, rows, word = random.Random(6), [], lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for k in range(12):
        w = [word() for _ in range(200)]
        for c in range(6):
            v = list(w)
            for x in rng.sample(range(200), 3 if c else 0):
                v[x] = word()
            rows.append((100 * k + c, " ".join(v), "s"))
    left = simhash.first_of_groups(docs(spark, rows + [(100, rows[6][1], "s"), (5000, None, "s"), (5001, "", "s")]))
    assert sorted(r.doc_id for r in left.collect()) == sorted([100 * k for k in range(12)] + [5000])
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and simhash.first_of_groups(docs(spark, [])).count() == 0


def appended_and_cut(rng, groups, words):
    """For each group a text, one with words appended and one that is cut, and the 5-word similarity of both to it."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, n = [], words - 4
    for k in range(groups):
        w = [word() for _ in range(words)]
        rows += [(10 * k, " ".join(w), "s"), (10 * k + 1, " ".join(w + [word() for _ in range(words * 16 // 100)]), "s"), (10 * k + 2, " ".join(w[: words * 86 // 100]), "s")]
    assert n / (n + words * 16 // 100) > 0.8 and (words * 86 // 100 - 4) / n > 0.8
    return rows


def test_near_copies_appended_and_cut(spark):
    rng = random.Random(16)
    left = simhash.first_of_groups(docs(spark, appended_and_cut(rng, 40, 200))).collect()
    assert sum(r.doc_id % 10 > 0 for r in left) <= 6  # of 80


def shingle_set(t, words=5):
    w = (t or "").lower().split()
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copies_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neargroups, "BLOCK_ROWS", block)
    rng = random.Random(26)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = appended_and_cut(rng, 20, 200)
    for k in range(30):
        w = [word() for _ in range(60)]
        rows += [(1000 + 10 * k, " ".join(w), "s"), (1001 + 10 * k, " ".join(w + [word() for _ in range(16 + k % 10)]), "s")]  # 0.68 to 0.78
        short = [word() for _ in range(10)]
        rows += [(2000 + 10 * k, " ".join(short), "s"), (2001 + 10 * k, " ".join(short[:9] + [word()]), "s"), (2002 + 10 * k, " ".join(short[:9]), "s")]  # 5 of 7, 5 of 6
    frame = [word() for _ in range(120)]
    rows += [(3000 + k, " ".join(frame[: 60 + k]), "s") for k in range(0, 60, 3)] + [(4000 + k, " ".join(frame[:80] + [word() for _ in range(15)]), "s") for k in range(10)]
    rows += [(5000, None, "s"), (5001, " ", "s"), (5002, "a b", "s"), (5003, "A  b", "s"), (5004, "a c", "s")]
    sets = {i: shingle_set(t) for i, t, _ in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sorted(r.doc_id for r in simhash.first_of_groups(docs(spark, rows)).collect()) == sorted(set(components(list(sets), near).values()))


def family(rng, n, words=100, swaps=9):
    """Copies of one text with up to `swaps` words replaced: similar to it by 0.4 to 1, to each other less."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    w, out = [word() for _ in range(words)], []
    for _ in range(n):
        v = list(w)
        for x in rng.sample(range(words), rng.randrange(swaps + 1)):
            v[x] = word()
        out.append(" ".join(v))
    return out


def test_near_copies_one_family(spark, monkeypatch):
    """A large family of copies makes no table of pairs, and the groups are those of all pairs."""
    made, kept = {}, neargroups.checkpointed
    for n in (400, 1600):

        def counted(df):
            got = kept(df)
            made[n] = max(made.get(n, 0), got.count())
            return got

        monkeypatch.setattr(neargroups, "checkpointed", counted)
        rows = [(k, t, "s") for k, t in enumerate(family(random.Random(n), n))]
        left = sorted(r.doc_id for r in simhash.first_of_groups(docs(spark, rows)).collect())
        sets = {i: shingle_set(t) for i, t, _ in rows}
        near = [(a, b) for a in sets for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        assert left == sorted(set(components(list(sets), near).values()))
    assert made[1600] <= 6 * made[400] and made[1600] < 30 * 1600


@pytest.mark.parametrize("value_rows", [4096, 3])
def test_wide_bands(spark, value_rows):
    """The pipeline's candidates: fingerprints of 256 bits meet by segments, as a plain comparison of all pairs says."""
    rng = np.random.default_rng(12)
    rows, full = [], rng.integers(0, 2, (60, 256), np.uint8)
    for f in full:
        for flips in (0, 10, 20, 41, 70, 87, 88, 89, 95):
            g = f.copy()
            g[rng.choice(256, flips, False)] ^= 1
            rows.append((int(rng.integers(-(2**62), 2**62)), int(rng.choice([3, 4, 5, 80, 90, 100])), g))
    table = [(n, s, np.packbits(g, bitorder="little").view(np.int64).tolist()) for n, s, g in rows]
    bands = {}
    for r in simhash.wide_bands(spark.createDataFrame(table, "node long, size int, full array<long>"), value_rows).collect():
        bands.setdefault(r.node, set()).add(r.band)
    cut = simhash.segments(len(rows))
    assert cut.shape == (42, 6) and len(set(cut.ravel().tolist())) == 252
    meet = sure = 0
    for k, (a, s, f) in enumerate(rows):
        for b, t, g in rows[:k]:
            far = int((f != g).sum())
            if far <= 88 and min(s, t) >= 4 and 5 * min(s, t) >= 4 * max(s, t):
                common = (f[cut] == g[cut]).all(1).any()
                assert common or far > 41
                meet, sure = meet + common, sure + (far <= 41)
                assert not common or bands[a] & bands[b]
    assert meet > sure > 50
    assert not any(s == 3 and n in bands for n, s, _ in rows)


def test_wide_bands_one_family(spark, monkeypatch):
    """A large family of texts near to each other has few bands over all tables, and makes few edges; no pair is lost for it."""
    made, kept = {}, neargroups.checkpointed

    def counted(df):
        got = kept(df)
        made[tuple(df.columns)] = max(made.get(tuple(df.columns), 0), got.count())
        return got

    texts = sorted(set(family(random.Random(31), 1200, 150, 40)))
    n = len(texts)
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    table = [(simhash.name_of(h), len(h), simhash.wide(h)) for h in sets]
    held = simhash.wide_bands(spark.createDataFrame(table, "node long, size int, full array<long>")).collect()
    assert len(held) < 2 * n
    order = {node: k for k, (node, _, _) in enumerate(table)}
    names, rows = {b: k for k, b in enumerate({r.band for r in held})}, np.zeros((n, len({r.band for r in held})), np.float32)
    rows[[order[r.node] for r in held], [names[r.band] for r in held]] = 1
    full, size = np.array([f for _, _, f in table]).view(np.uint64), np.array([s for _, s, _ in table])
    ones = np.unpackbits(full.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    met = np.zeros((n, n), bool)
    for line in simhash.segments(n):
        value = ones[:, line] @ (1 << np.arange(len(line)))
        met |= value[:, None] == value[None, :]
    far = (ones[:, None, :] != ones[None, :, :]).sum(2)
    pairs = met & (far <= simhash.NEAR_BITS) & (5 * np.minimum.outer(size, size) >= 4 * np.maximum.outer(size, size)) & ~np.eye(n, dtype=bool)
    assert pairs.sum() > 100 * n and not (pairs & (rows @ rows.T == 0)).any()
    monkeypatch.setattr(neargroups, "checkpointed", counted)
    left = sorted(r.doc_id for r in simhash.first_of_groups(docs(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect())
    assert made["src", "dst"] < n and made["lead", "node"] < 2 * n
    plain = [shingle_set(t) for t in texts]
    near = [(a, b) for a in range(n) for b in range(a) if pairs[a, b] and 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])]
    assert left == sorted(set(components(list(range(n)), near).values())) and 1 < len(left) < n


def test_near_copies_meet_by_simhash(spark, monkeypatch):
    """The near-dedup stage takes its candidates from the tables of fingerprints: none from them, none at all."""
    w = [f"w{k}" for k in range(200)]
    rows = docs(spark, [(1, " ".join(w), "s"), (2, " ".join(w[:190]), "s"), (3, " ".join(w), "s")])
    assert [r.doc_id for r in corpus_pipeline.dedup_stage(spark, rows, None).collect()] == [1]
    monkeypatch.setattr(simhash, "wide_bands", lambda rows: spark.createDataFrame([], "node long, band long"))
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, rows, None).collect()) == [1, 2]


@pytest.mark.parametrize("common", [1, 6, 99])
def test_shared_shingles(monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "COLUMNS", 50)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 90)).astype(np.uint64)) for _ in range(70)]
    found = simhash.SetBlock(sets[:50]).shared(sets[50:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[:50]] for a in sets[50:]]


# --- classifiers


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    own = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert sum(a == b for a, b in own) / len(own) > 0.94


def test_toxicity_scores_by_brute_force():
    """A score is that of the characters' n-grams, one after the other; also in a very long text and beyond ASCII."""
    rng = np.random.default_rng(4)
    table = rng.standard_normal(len(toxicity.ORDERS) << toxicity.BITS).astype(np.float32)
    model = toxicity.Model(table, 0.25)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 16777619 + ord(c)) % 2**32
        h ^= h >> 15
        return (h * 0x9E3779B1 % 2**32) >> 32 - toxicity.BITS

    def plain(t):
        pad = " " * (max(toxicity.ORDERS) - 1)
        x = pad + t.lower() + pad
        total = sum(float(table[bucket((x + " " * n)[k : k + n]) + (j << toxicity.BITS)]) for j, n in enumerate(toxicity.ORDERS) for k in range(len(x)))
        return 1 / (1 + math.exp(-(total / math.sqrt(len(x)) + 0.25)))

    texts = ["", "a", "Straße ÄÖÜ 😀 naïve", "Some words of a text", "très long " * 3000]
    assert model.scores(texts) == pytest.approx([plain(t) for t in texts], abs=2e-3)
    assert model.scores(["ÄRGER"]) == pytest.approx(model.scores(["ärger"]))


def test_toxicity_bound_on_texts(spark, monkeypatch):
    """Repeated rows of an id don't make the sample larger."""
    seen, kept = [], toxicity.checkpointed
    monkeypatch.setattr(toxicity, "checkpointed", lambda df: seen.append(kept(df)) or seen[-1])
    d = docs(spark, [(k % 4, f"text {k} of some words", "s") for k in range(200)])
    toxicity.fit(d, spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert seen[0].count() == 4


def test_toxicity_odd_inputs(spark):
    d = docs(spark, ODD)
    none = toxicity.fit(d, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert {round(r.score, 6) for r in toxicity.toxicity(d, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), none, ["doc_id"]).count() == 0


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in quality.op8_quality(spark, folder).collect()}
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    good, bad = [k for q, k in labels if q == 1], [k for q, k in labels if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
    odd = docs(spark, ODD)
    assert quality.quality(odd, ["doc_id"]).count() == len(ODD) and quality.quality(odd.limit(0), ["doc_id"]).count() == 0
    assert quality.kept(odd).columns == odd.columns


def test_label_model():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.7, 0.9, 0.8, 0.75, 0.9, 0.8]
    given = np.stack([np.where(rng.random(4000) < r, y, ~y) * 2 for r in right], 1)
    given[rng.random(given.shape) < 0.3] = 1
    found = quality.Labelling(list(zip(*[x.tolist() for x in np.unique([quality._pattern(g) for g in given.tolist()], return_counts=True)])))
    assert found.share == pytest.approx(0.8, abs=0.03) and np.abs(found.table[1, :, 2] - right).max() < 0.06
    assert ((found.posterior(given) > 0.5) == y).mean() > 0.95


def test_label_posterior_by_brute_force():
    """Naive Bayes over the votes that were given, one labeller after the other."""
    rng = np.random.default_rng(6)
    given = rng.integers(0, 3, (500, len(quality.LABELLERS)))
    found = quality.Labelling([(quality._pattern(g), 1) for g in given.tolist()])
    for g, p in zip(given[:50].tolist(), found.posterior(given[:50])):
        good, bad = found.share, 1 - found.share
        for k, v in enumerate(g):
            if v != 1:
                good *= found.table[1, k, v]
                bad *= found.table[0, k, v]
        assert p == pytest.approx(good / (good + bad), rel=1e-6)


def test_quality_decision_by_brute_force(spark):
    """kept and score of each text, from its votes and its n-grams counted one by one."""
    texts = ["", None, "Buy now!!! $$$ " * 20, "The quick brown fox of the river and the old house. " * 30, "a|b|c\t" * 50, "é" * 9000, "the man and the sea " * 4000]
    df = docs(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(100 + k, f"The answer of question {k} is in the book that was read by many." * (1 + k % 3), "s") for k in range(60)])
    labelling, scorer = quality.fit(df, "doc_id", "text")
    got = {r.doc_id: r for r in quality.quality(df, ["doc_id"], fitted=(labelling, scorer)).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        data = b"   " + t.encode() + b"   "
        g, s = quality._features(quality.Batch([t.encode()], quality._PAD))
        assert len(g) == len(data)
        shape = lambda k: sum(int(quality._CLASS[b]) * quality.CLASSES ** (quality.SHAPE - 1 - j) for j, b in enumerate((data + b" " * quality.SHAPE)[k : k + quality.SHAPE]))
        assert s[: len(data) - 2].tolist() == [shape(k) for k in range(len(data) - 2)]
        by_grams = sum(float(scorer.grams[x]) + float(scorer.shapes[y]) for x, y in zip(g, s)) / len(data) + scorer.intercept
        odds = labelling.log_odds(np.array([quality.votes(t)]))[0]
        z = (1 - quality.SCORER_SHARE) * odds + quality.SCORER_SHARE * by_grams
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=2e-3) and got[k].kept == (got[k].score >= 0.5)


# --- chat


def test_chat(spark):
    first = "Hello there, how are you today?\n\nI have a question about Spark joins."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "On Monday, Bob wrote:\n> Hello there, how are you today?\n>\n> I have a question about\n> Spark joins.\n\nFine thanks, what is it?"),
        (1, 2, "user", "> > I have a question about Spark joins.\n> Fine thanks, what is it?\nHow do I broadcast?"), (1, 3, "assistant", "> Hello there, how are you today?\nto the first"),
        (1, 4, "user", None), (None, 5, "user", "> Fine thanks, what is it?"), (2, 1, None, "> Fine thanks, what is it?\r\nx"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, k].reply_to, got[1, k].thread, got[1, k].depth) for k in range(5)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (0, 0, 1), (None, 4, 0)]
    assert [got[1, k].content for k in range(5)] == [first, "Fine thanks, what is it?", "How do I broadcast?", "to the first", ""]
    assert got[2, 1].reply_to is None and got[2, 1].content == "x" and got[None, 5].reply_to is None
    assert chat.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    chain = [(1, k, "u", (f"> message number {k - 1} says this\n" if k else "") + f"message number {k} says this") for k in range(20)]
    deep = chat.reply_order(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.depth, r.thread) for r in deep} == {k: (k, 0) for k in range(20)}


def test_chat_short_quotes(spark):
    rows = [(1, 0, "u", "Thanks!"), (1, 1, "a", "> Thanks!\nYou are welcome"), (1, 2, "u", "Yes, do it"), (1, 3, "a", ">  yes,  do it\nDone"), (1, 4, "u", "ok\n\nA longer paragraph of words"), (1, 5, "a", "> \nx")]
    got = {r.turn: r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[k].reply_to for k in range(6)] == [None, 0, None, 2, None, None] and [got[k].n_quotes for k in (1, 3, 5)] == [1, 1, 0]


def plain_replies(rows):
    """Reply, thread, depth, position and number of quotes of each (conv, turn), message by message."""
    norm = lambda t: " ".join(t.lower().split())

    def units(body):
        parts = [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]
        out = {}
        for k, u in enumerate(map(norm, parts)):
            if u:
                out.setdefault(u, k > 0 and len(u) < chat.SHORT_CHARS)
        return out

    said, quotes, count = {}, {}, {}
    for conv, turn, text in rows:
        lines = [(len(re.match(r"(?:[ \t]*>)*", x)[0].replace(" ", "").replace("\t", "")), re.sub(r"^(?:[ \t]*>)+ ?", "", x)) for x in (text or "").split("\n")]
        passages = []
        for depth, body in lines:
            if passages and passages[-1][0] == depth:
                passages[-1][1] += "\n" + body
            else:
                passages.append([depth, body])
        own = "\n".join(b for d, b in passages if d == 0)
        if any(d for d, _ in passages):
            own = "\n".join(x for x in own.split("\n") if not re.search(chat.LEAD_IN, x))
        said[conv, turn] = units(own.strip())
        quotes[conv, turn] = [(d, units(b)) for d, b in passages if d and b.strip()]
        count[conv, turn] = len(quotes[conv, turn])
    up = {}
    for (conv, turn), told in quotes.items():
        score = {}
        for u, depth in {(u, d) for d, us in told for u in us}:
            weak = all(us[u] for d, us in told if d == depth and u in us)
            before = sorted(t for c, t in said if c == conv and t < turn and u in said[c, t])
            strong = [t for t in before if not said[conv, t][u]]
            to = strong[0] if strong and not weak else before[0] if len(before) == 1 else None
            if to is not None:
                score[depth, to] = score.get((depth, to), 0) + len(u)
        if score:
            up[conv, turn] = max(score, key=lambda k: (-k[0], score[k], k[1]))[1]
    out = {}

    def walk(conv, turn, root, depth):
        out[conv, turn] = (up.get((conv, turn)), root, depth, sum(1 for k, v in out.items() if k[0] == conv and v[1] == root), count[conv, turn])
        for child in sorted(t for (c, t), u in up.items() if (c, u) == (conv, turn)):
            walk(conv, child, root, depth + 1)

    for conv, turn in said:
        if (conv, turn) not in up:
            walk(conv, turn, turn, 0)
    return out


@pytest.mark.parametrize("width", [1 << 16, 2])
def test_chat_by_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(chat, "BIN", width)
    rng, rows = random.Random(12), []
    word = lambda: rng.choice(["yes", "no", "spark", "join", "the", "table", "shuffle", "broadcast", "executor"])
    for conv in range(12):
        texts = []
        for turn in range(25):
            own = "\n".join(" ".join(word() for _ in range(rng.choice([1, 1, 3, 8]))) if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 4)))
            head = ""
            for _ in range(rng.choice([0, 1, 1, 2])):
                if texts:
                    source = rng.choice(texts).split("\n")
                    a = rng.randrange(len(source))
                    head += "".join(f"> {x}\n" for x in source[a : a + rng.randint(1, 6)]) + ("" if rng.random() < 0.5 else "well\n")
            texts.append(("On Monday Bob wrote:\n" if head and rng.random() < 0.3 else "") + head + own)
            rows.append((conv, turn, texts[-1]))
    want = plain_replies(rows)
    got = chat.reply_order(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.position, r.n_quotes) for r in got} == want
    assert sum(v[0] is not None for v in want.values()) > 100 and max(v[2] for v in want.values()) > 3


def test_chat_odd_rows(spark):
    long = "\n".join(f"> line number {k} of a long message" for k in range(3000))
    rows = [(1, 0, "u", "line number 5 of a long message"), (1, 0, "u", "another row of turn 0"), (1, 1, "a", long), (1, 1, "a", "> another row of turn 0"), (1, 2, "a", "> " * 300 + "line number 5 of a long message")]
    got = chat.reply_order(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, thread int")).collect()
    assert sorted((r.turn, r.reply_to, r.position) for r in got) == [(0, None, 0), (0, None, 0), (1, 0, 1), (1, 0, 1), (2, 0, 2)]
    deep = [(1, k, "u", (f"> message number {k - 1} says this\n" if k else "") + f"message number {k} says this") for k in range(300)]
    got = chat.reply_order(spark.createDataFrame(deep, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.depth, r.position, r.thread) for r in got} == {k: (k, k, 0) for k in range(300)}


# --- PII


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_spans(t):
    ok = lambda m: all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
    digits = lambda s: re.sub(r"\D", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if ok(m)]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base_by_brute_force():
    rng = random.Random(7)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.04", "4111 1111-1111 1111", "4111111111111111", "+1 (338) 555-7198", "+49.(", "é", " ", "-", ".", "5", "+", "%_", "a@b.c@d.e"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert [x[:3] for x in pii.scored(t) if x[0] in ("email", "ip", "card", "phone")] == plain_spans(t), t
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000") and pii.luhn("79927398713")


def test_pii_query_and_redaction(spark, tmp_path):
    rows = [(9, "IBAN DE89 3704 0044 0532 0130 00 and mail a@b.cd, ssn 123-45-6789", "s"), (10, "part 123-45-6789", "s"), (11, "a" * 200_000 + "1" * 100_000 + "@" * 1000, "s"), *ODD]
    got = {r.doc_id: r for r in pii.op10_pii(spark, held(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows) - 1 and [x.split(":")[0] for x in got[9].spans.split(",")] == ["email", "iban", "ssn"] and got[10].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.op10_pii(spark, held(spark, tmp_path / "none", [])).count() == 0
    red = {r.doc_id: r.text for r in pii.redacted(docs(spark, rows)).collect()}
    assert red[9] == "IBAN [IBAN] and mail [EMAIL], ssn [SSN]" and red[1] is None and red[2] == ""


def test_pii_context_words():
    """Whole words count, the nearer ones more."""
    ssn = lambda t: [x[3] for x in pii.scored(t) if x[0] == "ssn"]
    assert ssn("the taxpayer department: 123-45-6789") and not ssn("the compartment 123-45-6789") and not ssn("taxpayers: part 123-45-6789")
    assert ssn("ssn 123-45-6789")[0] > ssn("ssn" + " of the man" * 3 + " 123-45-6789")[0] >= 0.6
    score = lambda t: pii.scored(t)[0][3]
    assert score("hotel +49 30 1234567") == 0.7 < score("tel +49 30 1234567") and score("script 1.2.3.4") == 0.6 < score("ip 1.2.3.4")
    assert score("x" * 60 + "discard 4111111111111111") == 0.8 < score("x" * 60 + " card 4111111111111111")


# --- the pipeline


def test_pipeline(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    seen, now = {}, base
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        rows = out.collect()
        now = spark.createDataFrame(rows, out.schema)
        seen[name] = rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == base.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept, single, clean, mixed, encoded = (seen[n] for n in names)
    assert 0 < len(kept) < base.count() and len({r.doc_id for r in single}) == len(single) < len(kept)
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} == {r.doc_id for r in mixed} and not any(EMAIL.search(r.text) for r in clean)
    text = {r.doc_id: r.text for r in clean}
    ranks, pattern = bpe.vocabulary_file()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert len(encoded) == len(mixed) and all(list(r.ids) == enc.encode_ordinary(text[r.doc_id]) for r in encoded)
    assert corpus_pipeline.run(spark, SF).count() == len(encoded)
    assert [f.split("_")[0] for f in QUERIES] == [f"op{k}" for k in range(1, 11)] + ["pipeline"] and math.isfinite(len(os.listdir(SF)))


def test_pipeline_odd_inputs(spark, tmp_path):
    """Empty tables, null columns, repeated rows, very long texts and extra columns with clashing names."""
    assert corpus_pipeline.run(spark, held(spark, tmp_path / "none", [])).count() == 0
    good = [(20 + k, f"The old house of the family {k} is in the valley, and the river that runs by it was blue. It is not far from the town of {k}.\n" * 3, "a" if k else None) for k in range(12)]
    rows = [*good, good[0], good[0], (None, good[1][1] + " And so it goes.", "b"), (40, good[2][1] * 400, "b"), (41, None, "a"), (42, "", "a"), (None, None, None)]
    folder = tmp_path / "odd"
    named = docs(spark, rows).withColumns({c: F.lit(1) for c in ("node", "__epoch", "key", "h", "s", "__text", "part")})
    named.write.parquet(f"{folder}/documents.parquet")
    docs_, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, str(folder))
        docs_ = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs_.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == named.columns
    assert seen[0] >= len(good) and seen[1] <= seen[0] - 2 and seen[2] == seen[1] <= seen[3] == seen[4]
    assert {r.doc_id for r in docs_.collect()} >= {r[0] for r in good[3:]}
