"""Views in the shapes of the operators over the driver's tables, whole tables each; and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.session import table

_LETTERS = "ACGT"


def _letter(n):
    return F.substr(F.lit(_LETTERS), (F.floor(n) % 4 + 1).cast("int"), F.lit(1))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fragments: the day is the place, customer and key give the rest."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    start = (4 * F.floor(day / 4)).cast("long")
    return o.select(
        F.concat(F.lit("r"), F.lpad(key.cast("string"), 10, "0")).alias("read_name"), F.col("o_orderpriority").alias("chrom"), F.when(key % 2 == 0, "+").otherwise("-").alias("strand"),
        start.alias("start"), (start + 25 + cust % 40).alias("end"), (1 + key % 5).alias("count"), F.concat(_letter(cust / 16), _letter(cust / 4)).alias("ltr_umi"), _letter(cust).alias("linker_umi"),
        (key % 43).cast("int").alias("map_qual"), (20 + key % 17).cast("double").alias("mean_qual"),
    )


FRAGMENTS = """fragments AS (
  SELECT concat('r', lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS read_name, o_orderpriority AS chrom, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    4 * (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 4) AS start, 4 * (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 4) + 25 + o_custkey % 40 AS "end",
    1 + o_orderkey % 5 AS count, concat(substr('ACGT', CAST((o_custkey // 16) % 4 + 1 AS INT), 1), substr('ACGT', CAST((o_custkey // 4) % 4 + 1 AS INT), 1)) AS ltr_umi, substr('ACGT', CAST(o_custkey % 4 + 1 AS INT), 1) AS linker_umi,
    CAST(o_orderkey % 43 AS INT) AS map_qual, CAST(20 + o_orderkey % 17 AS DOUBLE) AS mean_qual FROM orders)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads: 200 families of 32 bases, one base of each read set by its key."""
    o = table(spark, sf_dir, "orders")
    key, family = F.col("o_orderkey"), F.col("o_custkey") % 200
    base = F.translate(F.md5(family.cast("string")), "0123456789abcdef", "ACGT" * 4)
    at = (key % 32 + 1).cast("int")
    seq = F.concat(F.substr(base, F.lit(1), at - 1), _letter(key / 32), F.substr(base, at + 1, F.lit(32)))
    return o.select(
        F.concat(F.lit("r"), F.lpad(key.cast("string"), 10, "0")).alias("read_name"), family.alias("family"), seq.alias("seq1"), F.lit(None).cast("string").alias("seq2"), _letter(F.col("o_custkey") / 200).alias("ltr_umi"), F.lit("N").alias("linker_umi"),
        (1 + key % 5).alias("count"), (key % 43).cast("int").alias("map_qual"), (20 + key % 17).cast("double").alias("mean_qual"),
    )


READS = """base AS (SELECT *, translate(md5(CAST(o_custkey % 200 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM orders),
reads AS (SELECT concat('r', lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS read_name, o_custkey % 200 AS family,
    concat(substr(b, 1, CAST(o_orderkey % 32 AS INT)), substr('ACGT', CAST((o_orderkey // 32) % 4 + 1 AS INT), 1), substr(b, CAST(o_orderkey % 32 + 2 AS INT))) AS seq1, CAST(NULL AS VARCHAR) AS seq2,
    substr('ACGT', CAST((o_custkey // 200) % 4 + 1 AS INT), 1) AS ltr_umi, 'N' AS linker_umi, 1 + o_orderkey % 5 AS count, CAST(o_orderkey % 43 AS INT) AS map_qual, CAST(20 + o_orderkey % 17 AS DOUBLE) AS mean_qual FROM base)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sites: the minute is the place."""
    e = table(spark, sf_dir, "events")
    minute = F.floor((F.unix_timestamp("ts") - 1704067200) / 60)
    return e.select(F.col("event_id").alias("site_id"), F.col("event_type").alias("chrom"), minute.alias("site_start"), (minute + 1).alias("site_end"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("site_strand"))


SITES = """sites AS (SELECT event_id AS site_id, event_type AS chrom, CAST(floor((floor(epoch(ts)) - 1704067200) / 60) AS BIGINT) AS site_start, CAST(floor((floor(epoch(ts)) - 1704067200) / 60) AS BIGINT) + 1 AS site_end,
    CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS site_strand FROM events)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as annotated intervals on the sites' chromosomes."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    start = key * 37 % 43200
    chrom = F.element_at(F.array(*[F.lit(c) for c in ("click", "error", "purchase", "signup", "view")]), (key % 5 + 1).cast("int"))
    return p.select(chrom.alias("chrom"), start.alias("start"), (start + F.col("p_size")).alias("end"), F.concat(F.lit("f"), F.lpad(key.cast("string"), 10, "0")).alias("name"))


FEATURES = """features AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][p_partkey % 5 + 1] AS chrom, p_partkey * 37 % 43200 AS start, p_partkey * 37 % 43200 + p_size AS "end", concat('f', lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS name FROM part)"""


def _quals(k, size):
    """(i + k) % (8 + k % 30) + 3 for each i from 1 to size. These are stretches of 30 rising rows, one for each divisor, that lie behind each other in one array, so nothing is computed base by base."""
    rows = F.split(F.lit(",".join(str(j % m + 3) for m in range(8, 38) for j in range(128))), ",").cast("array<int>")
    m = 8 + k % 30
    cut = F.slice(rows, ((m - 8) * 128 + (k + 1) % m + 1).cast("int"), size)
    return F.when((k >= 0) & size.between(1, 90), cut).otherwise(F.transform(F.sequence(F.lit(1), size), lambda i: ((i + k) % m + 3).cast("int")))


def quality_letters(k, size):
    """The letters of _quals in SAM and FASTQ text, likewise a piece of a string, one for each divisor."""
    texts = F.split(F.lit(" ".join("".join(chr(j % m + 36) for j in range(128)) for m in range(8, 38))), " ")
    m = 8 + k % 30
    cut = F.substr(F.get(texts, (m - 8).cast("int")), ((k + 1) % m + 1).cast("int"), size)
    return F.when((k >= 0) & size.between(1, 90), cut).otherwise(F.array_join(F.transform(_quals(k, size), lambda q: F.char(q + 33)), ""))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments of two mates each."""
    line = table(spark, sf_dir, "lineitem")
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    size = (30 + p % 60).cast("int")
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    cigar = F.when(p % 11 == 0, F.array(op(4, F.lit(3)), op(0, size - 3))).otherwise(F.array(op(0, size)))
    seq = F.substr(F.repeat(F.when(k % 7 == 0, "NACGT").otherwise("GACGT"), 20), F.lit(1), size)
    return line.select(
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")]).alias("read_name"), F.lit(1).alias("mate"), F.col("l_returnflag").alias("ref"),
        k.alias("start"), (k + size).alias("end"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (k % 43).cast("int").alias("mapq"), cigar.alias("cigar"),
        F.when(p % 3 == 0, F.concat(F.lit("0A"), (size - 1).cast("string"))).when(p % 6 == 1, F.concat(F.lit("0^GT0C"), (size - 1).cast("string"))).otherwise(size.cast("string")).alias("md"), (p % 9).cast("int").alias("nm"), F.when(k % 2 == 0, (p % 7).cast("int")).alias("xm"),
        (p % 50).cast("int").alias("score"), F.when(k % 3 == 0, (p % 50 - 1 + k % 3 + p % 2).cast("int")).alias("second"), seq.alias("seq"),
        _quals(k, size).alias("quals"), (k % 2200 - 100).cast("int").alias("tlen"),
    )


ALIGNMENTS = r"""lines AS (SELECT *, concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS read_name, l_orderkey AS k, l_partkey AS p, CAST(30 + l_partkey % 60 AS INT) AS size FROM lineitem),
al AS (SELECT read_name, l_returnflag AS ref, k AS start, k + size AS "end", CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, CAST(k % 43 AS INT) AS mapq, p % 11 = 0 AS clipped, size,
    CASE WHEN p % 3 = 0 THEN concat('0A', size - 1) WHEN p % 6 = 1 THEN concat('0^GT0C', size - 1) ELSE CAST(size AS VARCHAR) END AS md, CAST(p % 9 AS INT) AS nm, CASE WHEN k % 2 = 0 THEN CAST(p % 7 AS INT) END AS xm, p % 50 AS score,
    CASE WHEN k % 3 = 0 THEN p % 50 - 1 + p % 2 END AS second, substr(repeat(CASE WHEN k % 7 = 0 THEN 'NACGT' ELSE 'GACGT' END, 20), 1, size) AS seq, list_avg([pow(10, -((i + k) % (8 + k % 30) + 3) / 10.0) FOR i IN range(1, size + 1)]) AS error, CAST(k % 2200 - 100 AS INT) AS tlen FROM lines),
counted AS (SELECT *, length(regexp_replace(regexp_extract(md, '^([^1-9]*)', 1), '[^A-Za-z]', '', 'g')) AS early, length(replace(seq, 'N', '')) AS known, (substr(seq, 1, 1) = 'N')::INT + (substr(seq, 2, 1) = 'N')::INT AS n2, CASE WHEN clipped THEN 3 ELSE 0 END AS clips,
    coalesce(second = score AND mapq <= 1, false) AS multi, floor(size * 0.1) AS most, floor(size * 0.02) AS gaps FROM al),
mism AS (SELECT *, CASE WHEN xm IS NOT NULL THEN xm + clips ELSE length(regexp_replace(regexp_replace(md, '\^[A-Z]+', '', 'g'), '[^ACGT]', '', 'g')) + length(seq) - known + clips END AS mm FROM counted),
tested AS (SELECT *, true AS t_first_operation, NOT clipped AS t_no_clips, early + clips + CASE WHEN early > 0 OR clips > 0 THEN n2 ELSE 0 END <= 2 AS t_start_matches, second IS NULL OR second <= score AS t_not_beaten, true AS t_multi_allowed,
    multi OR mapq >= 2 AS t_mapping_quality, error <= 0.1 AS t_base_quality, abs(tlen) BETWEEN 25 AND 2000 AS t_length, nm <= most + gaps AS t_edits, mm <= most AS t_mismatches, nm - mm <= gaps AS t_indels FROM mism)"""


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pairs: some mates are missing, some stand on one strand or on two references."""
    a = alignments(spark, sf_dir).withColumns({c: F.lit("N") for c in ("ltr_umi", "linker_umi", "ltr_match", "linker_match")})
    a = a.select("read_name", "mate", "ref", "start", "end", "strand", "mapq", "seq", "ltr_umi", "linker_umi", "ltr_match", "linker_match", F.lit(False).alias("multi"), (F.lit(1.0) / (2 + F.col("mapq"))).alias("error"), F.col("seq").alias("read_seq"))
    other = F.when(F.col("start") % 13 == 0, F.col("strand")).when(F.col("strand") == "-", "+").otherwise("-")
    b = a.where("start % 17 <> 0").withColumn("mate", F.lit(2)).withColumn("strand", other).withColumn("ref", F.when(F.col("end") % 19 == 0, "X").otherwise(F.col("ref"))).withColumn("start", F.col("start") + 40).withColumn("end", F.col("end") + 40)
    return a.unionByName(b.withColumn("mapq", F.col("mapq") % 7).withColumn("error", F.lit(0.05)))


#: Invented sequences of a library's two ends, and a contaminant.
LTR, LINKER, CONTAMINANT = "GTCATTGCACAGTC", "CCTATAGTGAGTCG", "GGATCTTGACCATTCAGGCA"


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as they come from the machine: UMI, integrant end and genome in mate 1, UMI, linker and genome in mate 2. Some run through to the
    other end, lack an end or a UMI, stand the other way round or begin with a contaminant."""
    r = reads(spark, sf_dir)
    key = F.substring("read_name", 2, 20).cast("long")
    body = F.concat(F.when(key % 17 == 0, CONTAMINANT).otherwise(""), "seq1")
    one = F.concat("ltr_umi", F.when(key % 7 == 0, "").otherwise("G"), F.when(key % 11 == 0, "").when(key % 5 == 0, LTR[:12]).otherwise(LTR), body, F.when(key % 2 == 0, F.translate(F.reverse(F.lit(LINKER)), "ACGT", "TGCA")).otherwise(""))
    two = F.concat("ltr_umi", F.lit("C"), F.when(key % 13 == 0, "").otherwise(LINKER), F.translate(F.reverse(body), "ACGT", "TGCA"), F.when(key % 3 == 0, F.substr(F.translate(F.reverse(F.lit(LTR)), "ACGT", "TGCA"), F.lit(1), F.lit(7))).otherwise(""))
    return r.select("read_name", one.alias("seq1"), F.repeat(F.lit("I"), F.length(one)).alias("qual1"), two.alias("seq2"), F.repeat(F.lit("J"), F.length(two)).alias("qual2"))


RAW_PAIRS = f"""{READS}, keyed AS (SELECT *, CAST(substr(read_name, 2) AS BIGINT) AS key, concat(CASE WHEN CAST(substr(read_name, 2) AS BIGINT) % 17 = 0 THEN '{CONTAMINANT}' ELSE '' END, seq1) AS body FROM reads),
raw_pairs AS (SELECT read_name, concat(ltr_umi, CASE WHEN key % 7 = 0 THEN '' ELSE 'G' END, CASE WHEN key % 11 = 0 THEN '' WHEN key % 5 = 0 THEN '{LTR[:12]}' ELSE '{LTR}' END, body, CASE WHEN key % 2 = 0 THEN reverse(translate('{LINKER}', 'ACGT', 'TGCA')) ELSE '' END) AS seq1,
    concat(ltr_umi, 'C', CASE WHEN key % 13 = 0 THEN '' ELSE '{LINKER}' END, reverse(translate(body, 'ACGT', 'TGCA')), CASE WHEN key % 3 = 0 THEN substr(reverse(translate('{LTR}', 'ACGT', 'TGCA')), 1, 7) ELSE '' END) AS seq2 FROM keyed)"""
