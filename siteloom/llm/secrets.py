"""Secret scans, in DataFrame functions only.

Base kinds are patterns. Beyond them, long runs of token characters are candidates: their encoding
is inferred from the characters, and a battery of randomness tests in that encoding follows:
chi-squared uniformity over the alphabet, runs above and below its middle, and serial correlation
of neighbours, combined by Fisher's method. A candidate is cleared when randomness can be rejected.
The false-discovery rate of the clearings is held within each class of lengths (powers of two) over
the whole corpus: tests of short strings are weak and many, those of long ones strong and few. So what is bounded
is the share of random strings among those let go, not the share of ordinary ones among those reported, and a text's
random spans depend on the rest of the corpus. What isn't cleared and carries enough bits for the tests to tell is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteloom.llm.common import documents, fresh
from siteloom.session import checkpointed

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"  # runs of 32 and more, each from its start

# '=' belongs to a run as trailing padding only: what stands after NAME= is a run of its own
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,6}+(?![A-Za-z0-9+/_=-]))?+"
#: Level of the false-discovery control, and bits that a reported string must carry at least.
LEVEL, LEAST_BITS = 0.05, 90
#: p-values are counted in bins of this many powers of ten, up to LAST_BIN.
BIN, LAST_BIN = 0.05, 400
#: Values that are summed at once where places are computed.
STRIDE = 256

_ENCODINGS = (
    # name, what the string without padding must match, alphabet, size, whether case matters
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 16, False),
    ("base32", "^(?=.*[2-7])[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 32, False),
    ("base36", "^(?=.*[0-9])(?:[a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 36, False),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64, True),
)


def _places(text: Column, pattern: str, df: DataFrame, name: str, extra: int | None = None) -> DataFrame:
    """df with the array `name` of struct(start, end, hit, inner) of all matches, in code points.

    Starts are sums of the lengths of what lies between matches and of the matches before; the sums
    are built in strides, so the cost stays near the number of matches.
    """
    c = f"__{name}"
    df = df.withColumn(f"{c}_hit", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    if extra is not None:
        df = df.withColumn(f"{c}_in", F.when(F.size(f"{c}_hit") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(extra))))
    df = df.withColumn(f"{c}_gap", F.when(F.size(f"{c}_hit") > 0, F.transform(F.split(text, pattern, -1), F.length)))
    df = df.withColumn(f"{c}_len", F.expr(f"zip_with(slice({c}_gap, 1, size({c}_hit)), {c}_hit, (g, h) -> g + length(h))"))  # from the end of one to the end of the next
    df = df.withColumn(f"{c}_sum", F.expr(f"transform(sequence(0, (size({c}_len) - 1) div {STRIDE}), b -> aggregate(slice({c}_len, cast(b * {STRIDE} + 1 as int), {STRIDE}), 0L, (s, x) -> s + x))"))
    df = df.withColumn(f"{c}_up", F.expr(f"transform({c}_sum, (x, b) -> aggregate(slice({c}_sum, 1, b), 0L, (s, y) -> s + y))"))
    df = df.withColumn(
        f"{c}_end",
        F.expr(f"transform({c}_len, (x, i) -> {c}_up[cast(i div {STRIDE} as int)] + aggregate(slice({c}_len, cast((i div {STRIDE}) * {STRIDE} + 1 as int), cast(i % {STRIDE} + 1 as int)), 0L, (s, y) -> s + y))"),
    )
    inner = f"{c}_in[i]" if extra is not None else "h"
    df = df.withColumn(name, F.expr(f"coalesce(transform({c}_hit, (h, i) -> struct({c}_end[i] - length(h) as start, {c}_end[i] as `end`, h as hit, {inner} as inner)), array())"))
    return df.drop(*[x for x in df.columns if x.startswith(f"{c}_")])


def _tail(z: str) -> str:
    """SQL for P(Z > z) of a normal Z (a well-known polynomial approximation of the error function)."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    half = f"(0.5 * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({z}) * ({z}) / 2))"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def tests(df: DataFrame, col: str) -> DataFrame:
    """df, with a column `hit` of strings, and of each its encoding (null: none), bits and `col`, the combined p-value of randomness."""
    bare = F.regexp_replace("hit", "=+$", "")
    df = df.withColumn("__s", bare)
    df = df.withColumn("__e", F.coalesce(*[F.when(F.col("__s").rlike(rx), F.struct(F.lit(n).alias("name"), F.lit(a).alias("alphabet"), F.lit(float(k)).alias("k"), F.lit(c).alias("cased"))) for n, rx, a, k, c in _ENCODINGS]))
    df = df.withColumn("__s", F.expr("CASE WHEN __e.cased THEN translate(__s, '-_', '+/') ELSE lower(__s) END")).withColumn("__n", F.length("__s").cast("double"))
    df = df.withColumn("__x", F.expr("transform(filter(split(__s, ''), c -> c <> ''), c -> cast(instr(__e.alphabet, c) - 1 as double))"))
    df = df.withColumn("__sq", F.expr("aggregate(array_distinct(filter(split(__s, ''), c -> c <> '')), 0D, (s, c) -> s + pow(__n - length(replace(__s, c, '')), 2))"))
    df = df.withColumn("__chi", F.expr("(pow(greatest(1e-9, (__e.k / __n * __sq - __n) / (__e.k - 1)), 1D / 3) - (1 - 2 / (9 * (__e.k - 1)))) / sqrt(2 / (9 * (__e.k - 1)))"))
    df = df.withColumn("__up", F.expr("aggregate(__x, 0D, (s, x) -> s + if(x >= __e.k / 2, 1, 0))")).withColumn("__mean", F.expr("aggregate(__x, 0D, (s, x) -> s + x) / __n"))
    df = df.withColumn("__runs", F.expr("1 + aggregate(transform(__x, (x, i) -> if(i > 0 and (x >= __e.k / 2) <> (__x[i - 1] >= __e.k / 2), 1D, 0D)), 0D, (s, x) -> s + x)"))
    df = df.withColumn("__two", F.expr("2 * __up * (__n - __up)"))
    df = df.withColumn("__z", F.expr("CASE WHEN __two <= __n THEN 12D ELSE abs(__runs - __two / __n - 1) / sqrt(__two * (__two - __n) / (__n * __n * (__n - 1))) END"))
    df = df.withColumn("__var", F.expr("aggregate(__x, 0D, (s, x) -> s + (x - __mean) * (x - __mean))"))
    df = df.withColumn("__r", F.expr("CASE WHEN __var = 0 THEN 12D ELSE abs(aggregate(transform(__x, (x, i) -> if(i > 0, (x - __mean) * (__x[i - 1] - __mean), 0D)), 0D, (s, x) -> s + x) / __var) * sqrt(__n) END"))
    least = "greatest(1e-30, {})"
    df = df.withColumn("__h", -(F.expr(f"ln({least.format(_tail('__chi'))})") + F.expr(f"ln(least(1D, {least.format('2 * ' + _tail('__z'))}))") + F.expr(f"ln(least(1D, {least.format('2 * ' + _tail('__r'))}))")))
    df = df.withColumn(col, F.expr("exp(-__h) * (1 + __h + __h * __h / 2)"))
    return df.withColumn("encoding", F.col("__e.name")).withColumn("bits", F.expr("__n * log2(__e.k)"))


def cleared_from(counts: list[tuple[int, int, int]], level: float = LEVEL) -> dict[int, int]:
    """From (class, bin, count): the first bin of each class in which randomness is rejected (Benjamini and Hochberg's step-up on bins)."""
    by: dict[int, dict[int, int]] = {}
    for c, b, n in counts:
        by.setdefault(c, {})[b] = n
    out = {}
    for c, bins in by.items():
        total, below, first = sum(bins.values()), 0, LAST_BIN + 1
        for b in range(LAST_BIN, -1, -1):
            below += bins.get(b, 0)
            if below and 10 ** (-BIN * b) <= level * below / total:
                first = b
        out[c] = first
    return out


def secret_spans(df: DataFrame, id_cols: list[str], text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """id_cols, base and found, arrays of struct(start, ord, kind, end) by start, then kind as listed.

    base holds the pattern kinds assign, access and hex (leftmost, not overlapping within a kind,
    failing matches dropped); found holds these and the untested kinds random_<encoding>. A null or
    empty text has none; texts of any length are read whole. Repeated rows stay. An empty table gives an empty one.
    Offsets are code points, ends exclusive. Other columns are left out. Id columns may have any name; base and found get underscores if one has theirs.
    """
    text, named = F.col("__text"), id_cols
    id_cols = [f"__id{k}" for k in range(len(named))]
    docs = df.select(*[F.col(c).alias(i) for c, i in zip(named, id_cols)], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    docs = _places(text, ASSIGN, docs, "__assign", 2)
    docs = _places(text, ACCESS, docs, "__access")
    docs = _places(text, HEX, docs, "__hexes")
    docs = _places(text, CANDIDATE, docs, "__tokens")
    kinds = (("assign", "length(x.inner) >= 8", "__assign"), ("access", "length(x.hit) >= 16", "__access"), ("hex", "length(x.hit) >= 32", "__hexes"))
    spans = [F.expr(f"transform(filter({c}, x -> {test}), x -> struct(x.start as start, {k} as ord, '{name}' as kind, x.end as `end`))") for k, (name, test, c) in enumerate(kinds)]
    docs = docs.select(*id_cols, F.array_sort(F.concat(*spans)).alias("base"), F.expr("transform(__tokens, x -> struct(x.start as start, x.end as `end`, x.hit as hit))").alias("tokens"), F.monotonically_increasing_id().alias("__row"))
    docs = checkpointed(docs)
    tested = tests(docs.select("__row", F.explode("tokens").alias("t")).select("__row", "t.start", "t.end", "t.hit"), "p").where("encoding is not null")
    tested = checkpointed(
        tested.select("__row", "start", "end", "encoding", "bits", F.floor(F.log2(F.col("end") - F.col("start"))).cast("int").alias("class"), F.expr(f"cast(least({LAST_BIN}, floor(-log10(greatest(p, 1e-30)) / {BIN})) as int)").alias("bin"))
    )
    counts = tested.groupBy("class", "bin").count().collect()  # at most LAST_BIN + 1 for each of about 30 classes
    first = cleared_from([tuple(r) for r in counts], level)
    cut = F.coalesce(*[F.when(F.col("class") == c, F.lit(b)) for c, b in first.items()]) if first else F.lit(0)
    order = F.coalesce(*[F.when(F.col("encoding") == e[0], F.lit(3 + k)) for k, e in enumerate(_ENCODINGS)])
    kept = tested.where((F.col("bin") < cut) & (F.col("bits") >= LEAST_BITS))
    kept = kept.groupBy("__row").agg(F.collect_list(F.struct("start", order.alias("ord"), F.concat(F.lit("random_"), "encoding").alias("kind"), "end")).alias("more"))  # of one text, as many as it holds
    found = docs.join(kept, "__row", "left")
    ids = [F.col(i).alias(c) for c, i in zip(named, id_cols)]
    return found.select(*ids, F.col("base").alias(fresh(named, "base")), F.expr("array_sort(concat(base, coalesce(more, array())))").alias(fresh(named, "found")))


def written(col: str) -> Column:
    return F.expr(f"array_join(transform({col}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document, as secret_spans states (nulls, empty and long texts, repeated rows, empty tables: see there)."""
    found = secret_spans(documents(spark, sf_dir), ["doc_id"])
    many = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *many, F.sha2(written("base"), 256).alias("base_sha256"), written("found").alias("spans"))
