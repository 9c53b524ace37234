"""Queries of the insertion-site operators over the driver's tables, and their SQL, written apart from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siteloom.functions.sequences import error_probability, extract_umi, natural_key, phred, revcomp
from siteloom.operators import abundance, annotate, consensus, crop, dedup, demux, finalpass, leaders, mispriming, peaks, qc, reassign, similarity, sites as sites_
from siteloom.plans import adapters as a
from siteloom.session import checkpoint_dir, checkpointed
from siteloom.sources import files, setup
from siteloom.streaming.dedup import gap_runs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_COLS = ["read_name", "chrom", "strand", "start", "end", "count", "ltr_umi", "linker_umi", "map_qual", "mean_qual"]
_LIST = 'read_name, chrom, strand, start, "end", count, ltr_umi, linker_umi, map_qual, mean_qual'
_SUM = "CAST(sum(count) OVER (PARTITION BY {k}) AS BIGINT) AS total, row_number() OVER (PARTITION BY {k} ORDER BY {o}, read_name) AS n"
_KEPT = 'read_name, chrom, strand, start, "end", total AS count, ltr_umi, linker_umi, map_qual, mean_qual'


@query(f"""WITH {a.FRAGMENTS}, r AS (SELECT *, {_SUM.format(k='chrom, strand, start, "end", ltr_umi, linker_umi', o='map_qual DESC, mean_qual DESC')} FROM fragments) SELECT {_KEPT} FROM r WHERE n = 1""")
def unique_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_exact(a.fragments(spark, sf_dir)).select(*_COLS)


@query(f"""WITH {a.READS}, r AS (SELECT *, {_SUM.format(k="ltr_umi, linker_umi, seq1, seq2", o='map_qual DESC, mean_qual DESC')} FROM reads) SELECT read_name, ltr_umi, linker_umi, seq1, total AS count, map_qual, mean_qual FROM r WHERE n = 1""")
def multi_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.multi_exact(a.reads(spark, sf_dir)).select("read_name", "ltr_umi", "linker_umi", "seq1", "count", "map_qual", "mean_qual")


_GROUPS = f"""{a.FRAGMENTS}, l AS (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe FROM fragments WINDOW w AS (PARTITION BY chrom, strand ORDER BY start, "end", read_name)),
g AS (SELECT *, sum(CASE WHEN ps IS NULL OR start - ps > 5 OR abs("end" - pe) > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY start, "end", read_name ROWS UNBOUNDED PRECEDING) AS g FROM l),
b AS (SELECT chrom, strand, g, min(start) AS lo, max("end") AS hi FROM g GROUP BY ALL),
e AS (SELECT x.chrom, x.strand, x.g AS a, y.g AS b FROM b x JOIN b y ON x.chrom = y.chrom AND x.strand = y.strand AND x.g <> y.g AND y.lo BETWEEN x.lo - 5 AND x.lo + 5 AND y.hi BETWEEN x.hi - 5 AND x.hi + 5),
c(chrom, strand, a, b) AS (SELECT chrom, strand, g, g FROM b UNION SELECT c.chrom, c.strand, c.a, e.b FROM c JOIN e ON c.chrom = e.chrom AND c.strand = e.strand AND c.b = e.a),
m AS (SELECT chrom, strand, a AS g, min(b) AS grp FROM c GROUP BY ALL),
grouped AS (SELECT g.* EXCLUDE (ps, pe, g), CAST(m.grp AS BIGINT) AS grp FROM g JOIN m USING (chrom, strand, g))"""


@query(f'WITH RECURSIVE {_GROUPS} SELECT read_name, chrom, strand, start, "end", grp AS "group" FROM grouped')
def tolerance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.tolerance_groups(a.fragments(spark, sf_dir), 5).select("read_name", "chrom", "strand", "start", "end", "group")


_OWNERS = f"""{_GROUPS}, um AS (SELECT *, concat(ltr_umi, linker_umi) AS umi FROM grouped),
nd AS (SELECT chrom, strand, grp, umi, sum(count) AS n, (array_agg(read_name ORDER BY count DESC, map_qual DESC, mean_qual DESC, read_name))[1] AS rep FROM um GROUP BY chrom, strand, grp, umi),
st AS (SELECT u.chrom, u.strand, u.grp, u.umi AS u, v.umi AS v FROM nd u JOIN nd v ON u.chrom = v.chrom AND u.strand = v.strand AND u.grp = v.grp AND hamming(u.umi, v.umi) = 1 AND u.n >= 2 * v.n - 1),
rc(chrom, strand, grp, u, v) AS (SELECT chrom, strand, grp, umi, umi FROM nd UNION SELECT rc.chrom, rc.strand, rc.grp, rc.u, st.v FROM rc JOIN st ON rc.chrom = st.chrom AND rc.strand = st.strand AND rc.grp = st.grp AND rc.v = st.u),
ow AS (SELECT rc.chrom, rc.strand, rc.grp, rc.v AS umi, (array_agg(nd.umi ORDER BY nd.n DESC, nd.rep))[1] AS owner FROM rc JOIN nd ON rc.chrom = nd.chrom AND rc.strand = nd.strand AND rc.grp = nd.grp AND rc.u = nd.umi GROUP BY rc.chrom, rc.strand, rc.grp, rc.v)"""


@query(f'WITH RECURSIVE {_OWNERS} SELECT um.read_name, um.grp AS "group", ow.owner AS umi_owner FROM um JOIN ow USING (chrom, strand, grp, umi)')
def umi_directional_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = dedup.tolerance_groups(a.fragments(spark, sf_dir), 5)
    return dedup.umi_clusters(grouped, ["chrom", "strand", "group"], 2.0).select("read_name", "group", "umi_owner")


@query(f"""WITH RECURSIVE {_OWNERS}, r AS (SELECT um.*, {_SUM.format(k="um.chrom, um.strand, um.grp, ow.owner", o='count DESC, map_qual DESC, mean_qual DESC')} FROM um JOIN ow USING (chrom, strand, grp, umi)) SELECT {_KEPT} FROM r WHERE n = 1""")
def unique_fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_fuzzy(a.fragments(spark, sf_dir))[0].select(*_COLS)


@query(f"""WITH RECURSIVE {_GROUPS}, r AS (SELECT * REPLACE ('N' AS ltr_umi, 'N' AS linker_umi), {_SUM.format(k="chrom, strand, grp", o='count DESC, map_qual DESC, mean_qual DESC')} FROM grouped) SELECT {_KEPT} FROM r WHERE n = 1""")
def no_umi_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments without UMIs: a tolerance group is one cluster."""
    none = a.fragments(spark, sf_dir).withColumn("ltr_umi", F.lit("N")).withColumn("linker_umi", F.lit("N"))
    return dedup.unique_fuzzy(none)[0].select(*_COLS)


_PROJECT = """CASE WHEN strand = '-' THEN "end" - 4 - 1 ELSE start + 4 END AS site_start, CASE WHEN strand = '-' THEN "end" - 4 ELSE start + 4 + 1 END AS site_end, CASE WHEN strand = '-' THEN '+' ELSE '-' END AS site_strand"""


@query(f"WITH {a.FRAGMENTS} SELECT read_name, chrom, {_PROJECT} FROM fragments")
def site_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_.project_sites(a.fragments(spark, sf_dir), tsd=5, u3=True).select("read_name", "chrom", "site_start", "site_end", "site_strand")


_COUNTS = f"""{a.FRAGMENTS}, p AS (SELECT chrom, {_PROJECT} FROM (SELECT DISTINCT chrom, strand, start, "end", ltr_umi, linker_umi FROM fragments)), sc AS (SELECT chrom, site_start, site_end, site_strand, count(*) AS fragments FROM p GROUP BY ALL)"""


def _site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_.site_counts(sites_.project_sites(dedup.unique_exact(a.fragments(spark, sf_dir)), tsd=5, u3=True))


@query(f"WITH {_COUNTS} SELECT * FROM sc")
def unique_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_.ordered(_site_counts(spark, sf_dir))


@query(f"""WITH {_COUNTS}, q AS (SELECT chrom, fragments / sum(fragments) OVER (PARTITION BY chrom) AS p FROM sc)
SELECT chrom, count(*) AS sites, round(-sum(p * ln(p)), 6) AS shannon, round(-sum(p * ln(p)) / ln(count(*)), 6) AS pielou, round(1 - sum(p * p), 6) AS simpson FROM q GROUP BY chrom""")
def site_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_.diversity(_site_counts(spark, sf_dir), by=["chrom"]).select("chrom", "sites", *[F.round(c, 6).alias(c) for c in ("shannon", "pielou", "simpson")])


_POS = f"""{a.FRAGMENTS}, ps AS (SELECT *, CASE WHEN strand = '-' THEN "end" ELSE start END AS pos FROM fragments), pc AS (SELECT chrom, strand, pos, count(*) AS fragments, CAST(sum(count) AS BIGINT) AS total FROM ps GROUP BY ALL)"""


@query(f"WITH {_POS} SELECT * FROM pc")
def position_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalpass.position_counts(a.fragments(spark, sf_dir))


_COLLAPSE = f"""{_POS}, ab AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 5 THEN 0 ELSE 1 END AS cut FROM pc WHERE fragments >= 2 WINDOW w AS (PARTITION BY chrom, strand ORDER BY pos)),
il AS (SELECT *, sum(cut) OVER (PARTITION BY chrom, strand ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM ab), ls AS (SELECT chrom, strand, island, array_agg({{'pos': pos, 'f': fragments, 't': total}} ORDER BY fragments DESC, pos DESC) AS l FROM il GROUP BY ALL),
wk(chrom, strand, island, i, alive) AS (SELECT chrom, strand, island, CAST(0 AS BIGINT), l[1:0] FROM ls UNION ALL SELECT w.chrom, w.strand, w.island, w.i + 1, CASE WHEN len(n) > 0 AND (list_max([q.f FOR q IN n]) >= 2 * x.f OR list_max([q.t FOR q IN n]) >= 2 * x.t) THEN w.alive ELSE list_append(w.alive, x) END
  FROM wk w JOIN ls USING (chrom, strand, island), LATERAL (SELECT ls.l[w.i + 1] AS x), LATERAL (SELECT [q FOR q IN w.alive IF abs(q.pos - x.pos) <= 5] AS n) WHERE w.i < len(ls.l)),
kp AS (SELECT chrom, strand, unnest(alive) AS k FROM wk JOIN ls USING (chrom, strand, island) WHERE i = len(l)), tg AS (SELECT pc.chrom, pc.strand, pc.pos, (array_agg(k.pos ORDER BY k.f, k.pos))[1] AS target FROM pc JOIN kp ON pc.chrom = kp.chrom AND pc.strand = kp.strand AND abs(pc.pos - k.pos) <= 5 GROUP BY pc.chrom, pc.strand, pc.pos),
moved AS (SELECT read_name, chrom, strand, CASE WHEN strand = '-' THEN start ELSE coalesce(target, pos) END AS start, CASE WHEN strand = '-' THEN coalesce(target, pos) ELSE "end" END AS "end", count, ltr_umi, linker_umi, map_qual, mean_qual FROM ps LEFT JOIN tg USING (chrom, strand, pos))"""


@query(f"WITH RECURSIVE {_COLLAPSE} SELECT * FROM moved")
def abundant_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalpass.collapse(a.fragments(spark, sf_dir), window=5, min_count=2, fold=2.0).select(*_COLS)


@query(f"""WITH {a.FRAGMENTS}, r AS (SELECT *, {_SUM.format(k='chrom, strand, start, "end", ltr_umi, linker_umi', o='count DESC, map_qual DESC, mean_qual DESC')} FROM fragments) SELECT {_KEPT} FROM r WHERE n = 1""")
def new_duplicate_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalpass.new_duplicates(a.fragments(spark, sf_dir)).select(*_COLS)


@query(f"""WITH {_POS}, s AS (SELECT concat(ltr_umi, linker_umi) AS umi, chrom, strand, pos, sum(count) AS c, max(map_qual) AS m FROM ps GROUP BY ALL),
q AS (SELECT s.*, (SELECT max(mean_qual) FROM ps WHERE concat(ps.ltr_umi, ps.linker_umi) = s.umi AND ps.chrom = s.chrom AND ps.strand = s.strand AND ps.pos = s.pos AND ps.map_qual = s.m) AS mq FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY umi ORDER BY c DESC, m DESC, mq DESC, chrom, strand, pos) AS n FROM q)
SELECT ps.read_name, ps.chrom, ps.pos FROM ps JOIN w ON w.n = 1 AND concat(ps.ltr_umi, ps.linker_umi) = w.umi AND ps.chrom = w.chrom AND ps.strand = w.strand AND ps.pos = w.pos""")
def umi_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalpass.with_position(finalpass.umi_conflicts(a.fragments(spark, sf_dir))).select("read_name", "chrom", "pos")


@query(f"WITH {_POS} SELECT ps.read_name FROM ps JOIN pc USING (chrom, strand, pos) WHERE pc.total >= (SELECT floor(avg(total) / 2) FROM pc)")
def low_confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalpass.low_confidence(a.fragments(spark, sf_dir), fold=2.0).select("read_name")


@query(f"""WITH RECURSIVE {_COLLAPSE}, rn AS (SELECT *, {_SUM.format(k='chrom, strand, start, "end", ltr_umi, linker_umi', o='count DESC, map_qual DESC, mean_qual DESC')} FROM moved),
on_ AS (SELECT {_KEPT}, CASE WHEN strand = '-' THEN "end" ELSE start END AS pos, concat(ltr_umi, linker_umi) AS umi FROM rn WHERE n = 1),
us AS (SELECT umi, chrom, strand, pos, sum(count) AS c, max((map_qual, mean_qual)) AS q FROM on_ GROUP BY ALL), uw AS (SELECT *, row_number() OVER (PARTITION BY umi ORDER BY c DESC, q DESC, chrom, strand, pos) AS w FROM us),
un AS (SELECT on_.* FROM on_ JOIN uw ON w = 1 AND on_.umi = uw.umi AND on_.chrom = uw.chrom AND on_.strand = uw.strand AND on_.pos = uw.pos), pt AS (SELECT chrom, strand, pos, sum(count) AS total FROM un GROUP BY ALL),
fi AS (SELECT {_LIST} FROM un JOIN pt USING (chrom, strand, pos) WHERE total >= (SELECT floor(avg(total) / 100) FROM pt))
SELECT *, true AS kept FROM fi UNION ALL SELECT *, false FROM moved WHERE read_name NOT IN (SELECT read_name FROM fi)""")
def final_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, removed = finalpass.final_pass(a.fragments(spark, sf_dir), min_count=2, umi_dedup=True)
    return kept.select(*_COLS).withColumn("kept", F.lit(True)).unionByName(removed.select(*_COLS).withColumn("kept", F.lit(False)))


def _event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_.site_counts(a.sites(spark, sf_dir))


_EVENTS = f"""{a.SITES}, ec AS (SELECT chrom, site_start, site_end, site_strand, count(*) AS fragments FROM sites GROUP BY ALL)"""
_UNSTRANDED = f"""{_EVENTS}, sd AS (SELECT chrom, CASE WHEN site_strand = '-' THEN site_end ELSE site_start END AS start, sum(CASE WHEN site_strand = '+' THEN fragments ELSE 0 END) AS p, sum(CASE WHEN site_strand = '-' THEN fragments ELSE 0 END) AS m FROM ec GROUP BY ALL),
sh AS (SELECT sum(p) / sum(p + m) AS s, sum(p + m) AS t FROM sd WHERE p > 0 AND m > 0), pp AS (SELECT CASE WHEN t > 0 AND sqrt(s * (1 - s) / t) <= 0.1 THEN s ELSE 0.5 END AS p FROM sh),
st AS (SELECT chrom, start, start + 1 AS "end", CASE WHEN p > 0 AND m > 0 THEN '.' WHEN p > 0 THEN '+' ELSE '-' END AS strand, p + m AS c, p > 0 AS plus, m > 0 AS minus,
  (p > 0 AND m > 0) OR pow(CASE WHEN p > 0 THEN (SELECT p FROM pp) ELSE 1 - (SELECT p FROM pp) END, p + m) >= 0.05 AS good FROM sd),
lg AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY chrom ORDER BY start) <= 25 THEN 0 ELSE 1 END AS cut FROM st)"""


@query(f"""WITH {_UNSTRANDED}, gr AS (SELECT *, sum(cut) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM lg)
SELECT chrom, min(start) AS start, max("end") AS "end", '.' AS strand, CAST(sum(c) FILTER (good) AS BIGINT) AS count, CAST(count(*) FILTER (good) AS BIGINT) AS n_sites, (array_agg(start ORDER BY c DESC, start) FILTER (good))[1] AS apex, CAST(max(c) FILTER (good) AS BIGINT) AS apex_count
FROM gr GROUP BY chrom, g HAVING count(*) FILTER (good) > 2 AND bool_or(good AND plus) AND bool_or(good AND minus)""")
def peaks_unstranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.peaks(peaks.peak_sites(_event_counts(spark, sf_dir)), 25)


@query(f"""WITH {_UNSTRANDED}, gr AS (SELECT *, sum(cut) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM lg), pk AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM gr GROUP BY chrom, g HAVING count(*) FILTER (good) > 2 AND bool_or(good AND plus) AND bool_or(good AND minus))
SELECT concat('peak_', row_number() OVER (ORDER BY chrom, start)) AS name, chrom, start, "end" FROM pk""")
def peaks_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.named(peaks.peaks(peaks.peak_sites(_event_counts(spark, sf_dir)), 25)).select("name", "chrom", "start", "end")


@query(f"""WITH {_EVENTS}, st AS (SELECT chrom, CASE WHEN site_strand = '-' THEN site_end ELSE site_start END AS start, site_end AS "end", site_strand AS strand, fragments AS c FROM ec),
lg AS (SELECT *, CASE WHEN start - lag("end") OVER w <= 25 AND strand = lag(strand) OVER w THEN 0 ELSE 1 END AS cut FROM st WINDOW w AS (PARTITION BY chrom ORDER BY start, CASE WHEN strand = '-' THEN 0 ELSE 1 END)),
gr AS (SELECT *, sum(cut) OVER (PARTITION BY chrom ORDER BY start, CASE WHEN strand = '-' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS g FROM lg)
SELECT chrom, min(start) AS start, max("end") AS "end", min(strand) AS strand, CAST(sum(c) AS BIGINT) AS count, count(*) AS n_sites, (array_agg(start ORDER BY c DESC, start))[1] AS apex, max(c) AS apex_count FROM gr GROUP BY chrom, g HAVING count(*) > 2""")
def peaks_stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.peaks(peaks.peak_sites(_event_counts(spark, sf_dir), stranded=True), 25, stranded=True)


@query(f"""WITH {a.SITES}, {a.FEATURES} SELECT s.site_id, count(f.name) AS n_overlaps FROM sites s LEFT JOIN features f ON s.chrom = f.chrom AND s.site_start < f."end" AND f.start < s.site_end GROUP BY s.site_id""")
def annotation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.overlaps(a.sites(spark, sf_dir), a.features(spark, sf_dir)).select("site_id", "n_overlaps")


@query(f"""WITH {a.SITES}, {a.FEATURES}, d AS (SELECT s.site_id, f.name, f.start, f."end", CASE WHEN s.site_start < f."end" AND f.start < s.site_end THEN 0 WHEN f."end" <= s.site_start THEN s.site_start - f."end" + 1 ELSE f.start - s.site_end + 1 END AS distance
  FROM (SELECT DISTINCT chrom, site_start, site_end, min(site_id) OVER (PARTITION BY chrom, site_start) AS site_id FROM sites) s JOIN features f ON s.chrom = f.chrom),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY distance, start, "end", name) AS n FROM d), o AS (SELECT site_id, min(site_id) OVER (PARTITION BY chrom, site_start) AS one FROM sites)
SELECT o.site_id, r.distance, r.name AS feature FROM o LEFT JOIN r ON r.site_id = o.one AND r.n = 1""")
def annotation_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.nearest(a.sites(spark, sf_dir), a.features(spark, sf_dir)).select("site_id", "distance", "feature")


_TESTS = ["first_operation", "no_clips", "start_matches", "not_beaten", "multi_allowed", "mapping_quality", "base_quality", "length", "edits", "mismatches", "indels"]


@query(f"""WITH {a.ALIGNMENTS} SELECT ref, count(*) AS n, {", ".join(f"CAST(count(*) FILTER (t_{t}) AS BIGINT) AS {t}" for t in _TESTS if t not in ("first_operation",))}, CAST(count(*) FILTER (t_first_operation) AS BIGINT) AS first_operation FROM tested GROUP BY ref""")
def qc_alignment_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = qc.tests(qc.Limits())
    return a.alignments(spark, sf_dir).groupBy("ref").agg(F.count("*").alias("n"), *[F.count_if(checks[t]).alias(t) for t in _TESTS])


@query(f"""WITH {a.ALIGNMENTS} SELECT read_name, ref AS chrom, start, "end", CAST(1 AS BIGINT) AS count, strand, 'N' AS ltr_umi, 'N' AS linker_umi, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq1, multi, round(-10 * log10(error), 6) AS mean_qual, mapq AS map_qual, 'N' AS ltr_match, 'N' AS linker_match
FROM tested WHERE {" AND ".join(f"t_{t}" for t in _TESTS)}""")
def qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    al = a.alignments(spark, sf_dir).withColumns({c: F.lit("N") for c in ("ltr_umi", "linker_umi", "ltr_match", "linker_match")})
    return qc.single_fragments(qc.qc(al)).drop("seq2").withColumn("mean_qual", F.round("mean_qual", 6))


@query(f"""WITH {a.ALIGNMENTS}, m AS (SELECT read_name, 1 AS mate, ref, start, "end", strand, mapq, 1.0 / (2 + mapq) AS error, seq FROM al
  UNION ALL SELECT read_name, 2, CASE WHEN "end" % 19 = 0 THEN 'X' ELSE ref END, start + 40, "end" + 40, CASE WHEN start % 13 = 0 THEN strand WHEN strand = '-' THEN '+' ELSE '-' END, mapq % 7, 0.05, seq FROM al WHERE start % 17 <> 0),
g AS (SELECT read_name FROM m GROUP BY read_name HAVING count(*) FILTER (mate = 1) = 1 AND count(*) FILTER (mate = 2) = 1 AND count(DISTINCT ref) = 1 AND count(DISTINCT strand) = 2 AND NOT bool_or(ref = 'R'))
SELECT x.read_name, x.ref AS chrom, CASE WHEN x.strand = '-' THEN y.start ELSE x.start END AS start, CASE WHEN x.strand = '-' THEN x."end" ELSE y."end" END AS "end", x.strand, x.seq AS seq1, y.seq AS seq2, round(-10 * log10((x.error + y.error) / 2), 6) AS mean_qual, least(x.mapq, y.mapq) AS map_qual
FROM g JOIN m x ON x.read_name = g.read_name AND x.mate = 1 JOIN m y ON y.read_name = g.read_name AND y.mate = 2""")
def fragments_from_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = qc.fragments(qc.proper_pairs(a.mates(spark, sf_dir), ["R"]))
    return got.select("read_name", "chrom", "start", "end", "strand", "seq1", "seq2", F.round("mean_qual", 6).alias("mean_qual"), "map_qual")


@query(f"""WITH RECURSIVE {a.READS}, n AS (SELECT DISTINCT family, seq1 AS s FROM reads),
e AS (SELECT x.family, x.s AS a, y.s AS b FROM n x JOIN n y ON x.family = y.family AND x.s <> y.s AND abs(length(x.s) - length(y.s)) <= 5 AND 1 - levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s)) >= 0.95),
c(family, a, b) AS (SELECT family, s, s FROM n UNION SELECT c.family, c.a, e.b FROM c JOIN e ON c.family = e.family AND c.b = e.a), m AS (SELECT family, a AS s, min(b) AS seq_group FROM c GROUP BY ALL)
SELECT read_name, m.seq_group FROM reads JOIN m ON reads.family = m.family AND reads.seq1 = m.s""")
def sequence_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.sequence_groups(a.reads(spark, sf_dir), ["family"], "seq1", 0.95, 5).select("read_name", "seq_group")


_SIGNATURES = f"""{a.READS}, sq AS (SELECT DISTINCT family, seq1 AS s FROM reads), km AS (SELECT family, s, i, md5(substr(s, i, 4)) AS h FROM sq, range(1, 30) AS r(i) WHERE i <= length(s) - 3),
tk AS (SELECT DISTINCT family, s, h FROM (SELECT family, s, min(h) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS h, i FROM km) WHERE i <= length(s) - 6),
nu AS (SELECT family, s, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS x FROM tk), pm AS (SELECT i, CAST(concat('0x', substr(md5(concat('a', i)), 1, 7)) AS BIGINT) + 1 AS a, CAST(concat('0x', substr(md5(concat('b', i)), 1, 7)) AS BIGINT) AS b FROM range(128) AS r(i)),
sg AS (SELECT family, s, i, min((a * x + b) % 4294967311) & 4294967295 AS v FROM nu, pm GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_SIGNATURES}, e1 AS MATERIALIZED (SELECT x.family, x.s AS a, y.s AS b FROM sg x JOIN sg y ON x.family = y.family AND x.i = y.i AND x.s < y.s GROUP BY ALL HAVING sum(bit_count(xor(x.v, y.v))) <= 128 * 32 * (1 - 0.637) / 2), ed AS (SELECT * FROM e1 UNION ALL SELECT family, b, a FROM e1),
rc(family, a, b) AS (SELECT family, s, s FROM sq UNION SELECT rc.family, rc.a, ed.b FROM rc JOIN ed ON rc.family = ed.family AND rc.b = ed.a), lo AS (SELECT rc.family, rc.a AS s, min(r.read_name) AS component FROM rc JOIN reads r ON r.family = rc.family AND r.seq1 = rc.b GROUP BY ALL)
SELECT read_name, component FROM reads JOIN lo ON reads.family = lo.family AND reads.seq1 = lo.s""")
def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.minhash_groups(a.reads(spark, sf_dir), "read_name", "seq1", similarity.default_hash_similarity(0.95, 4), 4, 4, 128)


@query(f"""WITH RECURSIVE {a.READS}, rk AS (SELECT *, {_SUM.format(k="ltr_umi, linker_umi, seq1, seq2", o='map_qual DESC, mean_qual DESC')} FROM reads), ex AS (SELECT * EXCLUDE (count, total, n), total AS count FROM rk WHERE n = 1),
n AS (SELECT DISTINCT family, seq1 AS s FROM ex), e AS (SELECT x.family, x.s AS a, y.s AS b FROM n x JOIN n y ON x.family = y.family AND x.s <> y.s AND abs(length(x.s) - length(y.s)) <= 5 AND 1 - levenshtein(x.s, y.s) / greatest(length(x.s), length(y.s)) >= 0.95),
c(family, a, b) AS (SELECT family, s, s FROM n UNION SELECT c.family, c.a, e.b FROM c JOIN e ON c.family = e.family AND c.b = e.a), m AS (SELECT family, a AS s, min(b) AS grp FROM c GROUP BY ALL),
um AS (SELECT ex.*, m.grp, concat(ltr_umi, linker_umi) AS umi FROM ex JOIN m ON ex.family = m.family AND ex.seq1 = m.s), nd AS (SELECT family, grp, umi, sum(count) AS n, (array_agg(read_name ORDER BY count DESC, map_qual DESC, mean_qual DESC, read_name))[1] AS rep FROM um GROUP BY family, grp, umi),
st AS (SELECT u.family, u.grp, u.umi AS u, v.umi AS v FROM nd u JOIN nd v ON u.family = v.family AND u.grp = v.grp AND hamming(u.umi, v.umi) = 1 AND u.n >= 2 * v.n - 1),
rc(family, grp, u, v) AS (SELECT family, grp, umi, umi FROM nd UNION SELECT rc.family, rc.grp, rc.u, st.v FROM rc JOIN st ON rc.family = st.family AND rc.grp = st.grp AND rc.v = st.u),
ow AS (SELECT rc.family, rc.grp, rc.v AS umi, (array_agg(nd.umi ORDER BY nd.n DESC, nd.rep))[1] AS owner FROM rc JOIN nd ON rc.family = nd.family AND rc.grp = nd.grp AND rc.u = nd.umi GROUP BY rc.family, rc.grp, rc.v),
r AS (SELECT um.*, {_SUM.format(k="um.family, um.grp, ow.owner", o='count DESC, map_qual DESC, mean_qual DESC')} FROM um JOIN ow USING (family, grp, umi)) SELECT read_name, seq1, total AS count FROM r WHERE n = 1""")
def multi_fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.multi_fuzzy(dedup.multi_exact(a.reads(spark, sf_dir)), ["family"])[0].select("read_name", "seq1", "count")


@query(f"""WITH {a.READS}, k AS (SELECT read_name, unnest(list_distinct([substr(seq1, i, 4) FOR i IN range(1, length(seq1) - 2)])) AS kmer FROM reads) SELECT kmer, count(*) AS reads FROM k GROUP BY kmer""")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = a.reads(spark, sf_dir).select(F.explode(F.array_distinct(similarity.kmers(F.col("seq1"), 4))).alias("kmer"))
    return held.groupBy("kmer").agg(F.count("*").alias("reads"))


_INDEX = f"""{a.READS}, u AS (SELECT *, 'chr' || CAST(1 + family % 4 AS VARCHAR) AS chrom, CASE WHEN family % 2 = 0 THEN '+' ELSE '-' END AS strand, family * 1000 + length(read_name) AS pos FROM reads),
ux AS (SELECT chrom, strand, substr(seq1, 1, 15) AS prefix, pos, seq1, row_number() OVER (PARTITION BY chrom, strand, substr(seq1, 1, 15) ORDER BY pos, length(seq1), seq1, read_name) AS n FROM u)"""


def _unique_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.reads(spark, sf_dir)
    pos = F.col("family") * 1000 + F.length("read_name")
    return r.withColumn("chrom", F.concat(F.lit("chr"), (1 + F.col("family") % 4).cast("string"))).withColumn("strand", F.when(F.col("family") % 2 == 0, "+").otherwise("-")).withColumn("start", pos).withColumn("end", pos)


@query(f"WITH {_INDEX} SELECT chrom, strand, prefix, pos, seq1 FROM ux WHERE n = 1")
def unique_prefix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassign.prefix_index(_unique_reads(spark, sf_dir), 15).select("chrom", "strand", "prefix", "pos", "seq1")


@query(f"""WITH RECURSIVE {_INDEX}, fr AS (SELECT chrom, strand, pos, count(*) AS fragments FROM u GROUP BY ALL), ix AS (SELECT ux.*, fr.fragments FROM ux JOIN fr USING (chrom, strand, pos) WHERE n = 1 AND length(seq1) >= 15),
cd AS (SELECT r.read_name, x.chrom, x.strand, x.pos, x.fragments, CASE WHEN length(r.seq1) = 0 THEN 1.0 ELSE 1 - levenshtein(r.seq1, substr(x.seq1, 1, length(r.seq1))) / length(r.seq1) END AS sim,
  row_number() OVER (PARTITION BY r.read_name ORDER BY x.chrom, x.strand, x.pos, length(x.seq1), x.seq1) AS i FROM reads r JOIN ix x ON substr(r.seq1, 1, 15) = x.prefix AND length(x.seq1) >= length(r.seq1)),
fo(read_name, i, chrom, strand, pos, fragments, sim) AS (SELECT read_name, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS DOUBLE) FROM reads
  UNION ALL SELECT f.read_name, c.i, CASE WHEN z THEN c.chrom ELSE f.chrom END, CASE WHEN z THEN c.strand ELSE f.strand END, CASE WHEN z THEN c.pos ELSE f.pos END, CASE WHEN z THEN c.fragments ELSE f.fragments END, CASE WHEN z THEN c.sim ELSE f.sim END
  FROM fo f JOIN (SELECT * FROM cd) c ON c.read_name = f.read_name AND c.i = f.i + 1, LATERAL (SELECT c.sim > f.sim + 0.05 OR (abs(c.sim - f.sim) <= 0.05 AND c.fragments > 2 * f.fragments) AS z)),
la AS (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY read_name ORDER BY i DESC) = 1)
SELECT r.read_name, CASE WHEN g THEN la.chrom ELSE 'chrX' END AS chrom, CASE WHEN g THEN la.strand ELSE '+' END AS strand, CASE WHEN NOT g THEN 0 WHEN la.strand = '-' THEN la.pos - length(r.seq1) ELSE la.pos END AS start, CASE WHEN NOT g THEN length(r.seq1) WHEN la.strand = '-' THEN la.pos ELSE la.pos + length(r.seq1) END AS "end",
  CASE WHEN g THEN 'multi_relocated' ELSE 'multi' END AS mapping_class FROM reads r JOIN la ON la.read_name = r.read_name, LATERAL (SELECT la.sim >= 0.95 AS g)""")
def prefix_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _unique_reads(spark, sf_dir)
    multi = a.reads(spark, sf_dir).withColumn("chrom", F.lit("chrX")).withColumn("strand", F.lit("+")).withColumn("start", F.lit(0).cast("long")).withColumn("end", F.length("seq1").cast("long"))
    return reassign.relocate(multi, reassign.prefix_index(unique, 15)).select("read_name", "chrom", "strand", "start", "end", "mapping_class")


_BANDS, _VALUES_OF_BAND = leaders.band_shape(0.5, 32)


@query(f"""WITH RECURSIVE {a.READS}, sq AS (SELECT seq1 AS s, row_number() OVER (ORDER BY length(seq1) DESC, seq1 DESC) AS o FROM (SELECT DISTINCT seq1 FROM reads)), tk AS (SELECT DISTINCT s, md5(substr(s, i, 4)) AS h FROM sq, range(1, 23) AS r(i)),
nu AS (SELECT s, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS x FROM tk), pm AS (SELECT i, CAST(concat('0x', substr(md5(concat('a', i)), 1, 7)) AS BIGINT) + 1 AS a, CAST(concat('0x', substr(md5(concat('b', i)), 1, 7)) AS BIGINT) AS b FROM range(32) AS r(i)),
sg AS MATERIALIZED (SELECT s, i, min((a * x + b) % 4294967311) & 4294967295 AS v FROM nu, pm GROUP BY ALL), bn AS MATERIALIZED (SELECT s, sq.o, i // {_VALUES_OF_BAND} AS b, string_agg(v, ' ' ORDER BY i) AS v FROM sg JOIN sq USING (s) WHERE i < {_BANDS * _VALUES_OF_BAND} GROUP BY ALL),
ro(s, o, leads) AS (SELECT s, o, false FROM sq UNION ALL (WITH op AS (SELECT s, o FROM ro WHERE NOT leads), bo AS (SELECT bn.*, min(bn.o) OVER (PARTITION BY b, v) AS head FROM bn JOIN op USING (s)), ld AS (SELECT s FROM bo GROUP BY s HAVING bool_and(o = head)),
  tk2 AS (SELECT DISTINCT b, v FROM bo JOIN ld USING (s)), gone AS (SELECT DISTINCT bo.s FROM bo JOIN tk2 USING (b, v)) SELECT op.s, op.o, ld.s IS NOT NULL FROM op LEFT JOIN ld USING (s) LEFT JOIN gone USING (s) WHERE ld.s IS NOT NULL OR gone.s IS NULL)),
ct AS (SELECT m.s, l.s AS c, l.o FROM bn m JOIN bn l ON m.b = l.b AND m.v = l.v AND l.o <= m.o WHERE l.s IN (SELECT s FROM ro WHERE leads) GROUP BY ALL), cs AS (SELECT ct.s, ct.c, sum((x.v = y.v)::INT) AS same FROM ct JOIN sg x ON x.s = ct.s JOIN sg y ON y.s = ct.c AND y.i = x.i GROUP BY ALL),
co AS MATERIALIZED (SELECT s, (array_agg(c ORDER BY length(c) DESC, same DESC, c DESC))[1] AS c FROM cs GROUP BY s), pr AS MATERIALIZED (SELECT x.s, y.s AS t, levenshtein(x.s, substr(y.s, 1, length(x.s))) AS d FROM co x JOIN co y ON x.c = y.c JOIN sq p ON p.s = x.s JOIN sq q ON q.s = y.s AND q.o < p.o WHERE 1 - levenshtein(x.s, substr(y.s, 1, length(x.s))) / length(x.s) >= 0.95),
rf(s, leads) AS (SELECT s, false FROM sq UNION ALL (WITH op AS (SELECT s FROM rf WHERE NOT leads), po AS (SELECT pr.s, pr.t FROM pr JOIN op USING (s) JOIN op o2 ON o2.s = pr.t), ld AS (SELECT op.s FROM op LEFT JOIN (SELECT DISTINCT s FROM po) x USING (s) WHERE x.s IS NULL), gone AS (SELECT DISTINCT po.s FROM po JOIN ld ON ld.s = po.t)
  SELECT op.s, ld.s IS NOT NULL FROM op LEFT JOIN (SELECT s FROM ld) ld ON ld.s = op.s LEFT JOIN gone ON gone.s = op.s WHERE gone.s IS NULL)),
bt AS (SELECT pr.s, (array_agg(t ORDER BY d, length(t), t))[1] AS g FROM pr WHERE t IN (SELECT s FROM rf WHERE leads) AND s NOT IN (SELECT s FROM rf WHERE leads) GROUP BY pr.s)
SELECT sq.s AS seq1, co.c AS coarse, coalesce(bt.g, sq.s) AS mm_group FROM sq JOIN co USING (s) LEFT JOIN bt USING (s)""")
def sequence_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = a.reads(spark, sf_dir).select("seq1").distinct()
    coarse = reassign.coarse_clusters(seqs, 25, 32, 4, 0.5)
    fine = reassign.sequence_clusters(seqs, 0.95, 25, 32, 4, 0.5)
    return fine.join(coarse.select(F.col("seq").alias("seq1"), F.col("cluster").alias("coarse")), "seq1").select("seq1", "coarse", "mm_group")


@query()
def multi_reassignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.fragments(spark, sf_dir).join(a.reads(spark, sf_dir).select("read_name", "seq1", "seq2"), "read_name")
    f = checkpointed(f.select("read_name", "chrom", "strand", "start", "end", "count", "map_qual", "seq1"))  # the views' join once, not for each look at the reads
    return reassign.reassign(f.where("map_qual < 4"), f.where("map_qual >= 4")).select("read_name", "chrom", "strand", "start", "end", "mapping_class")


_CODES = [("s1", "ACGT"), ("s2", "GGTT"), ("s3", "TACA"), ("s4", "CCGA")]
_VALUES = ", ".join(f"('{s}', '{b}', {k})" for k, (s, b) in enumerate(_CODES))


def _barcodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, b, k) for k, (s, b) in enumerate(_CODES)], "sample string, barcode string, ord int")


@query(f"""WITH {a.READS}, codes(sample, barcode, ord) AS (VALUES {_VALUES}), m AS (SELECT read_name, sample, row_number() OVER (PARTITION BY read_name ORDER BY ord) AS n FROM reads JOIN codes ON hamming(substr(seq1, 1, 4), barcode) <= 1)
SELECT read_name, sample FROM reads LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (read_name)""")
def barcode_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.index_demux(a.reads(spark, sf_dir), F.substring("seq1", 1, 4), _barcodes(spark), error_rate=0.25).select("read_name", "sample")


@query(f"""WITH {a.READS}, codes(sample, barcode, ord) AS (VALUES {_VALUES}),
m1 AS (SELECT read_name, sample, row_number() OVER (PARTITION BY read_name ORDER BY ord) AS n FROM reads JOIN codes ON hamming(substr(seq1, 1, 4), barcode) <= 1), m2 AS (SELECT read_name, sample, row_number() OVER (PARTITION BY read_name ORDER BY ord) AS n FROM reads JOIN codes ON hamming(substr(seq1, 5, 4), barcode) <= 1)
SELECT m1.read_name, m1.sample FROM m1 JOIN m2 ON m1.n = 1 AND m2.n = 1 AND m1.read_name = m2.read_name AND m1.sample = m2.sample""")
def dual_barcode_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = demux.index_demux(a.reads(spark, sf_dir), F.substring("seq1", 1, 4), _barcodes(spark), F.substring("seq1", 5, 4), _barcodes(spark), error_rate=0.25)
    return got.where("sample is not null").select("read_name", "sample")


@query(f"""WITH {a.READS}, t AS (SELECT read_name, concat('NNNNNN', substr(seq1, 1, 1 + CAST(count AS INT))) AS p FROM reads), v AS (SELECT read_name, substr(right(p, 6), 1, 4) AS w FROM t) SELECT read_name, CASE WHEN regexp_matches(w, '[ATGC]{{3}}') THEN w ELSE 'N' END AS umi FROM v""")
def umi_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.substr(F.col("seq1"), F.lit(1), (1 + F.col("count")).cast("int"))
    return a.reads(spark, sf_dir).select("read_name", extract_umi(before, 4, 2, "NNN").alias("umi"))


@query(f"""WITH {a.READS}, x AS (SELECT i - 1 AS position, substr(rpad(seq1, 40, 'N'), i, 1) AS base FROM reads, (SELECT unnest(range(1, 41)) AS i)), c AS (SELECT position, base, count(*) AS n FROM x GROUP BY ALL),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY position) AS share, row_number() OVER (PARTITION BY position ORDER BY n DESC, base) AS k FROM c)
SELECT CAST(position AS INT) AS position, base, round(share, 6) AS share, CASE WHEN share >= 0.3 THEN base ELSE 'N' END AS called FROM r WHERE k = 1""")
def positional_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.positional_consensus(a.reads(spark, sf_dir), "seq1", 40, 0.3).withColumn("share", F.round("share", 6))


@query(f"""WITH {a.READS}, c AS (SELECT substr(seq1, 1, 2) AS matched, count(*) AS n FROM reads GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
SELECT CASE WHEN n >= 0.06 * t THEN matched ELSE 'Other' END AS matched, round(sum(n) / any_value(t), 6) AS share FROM c, t GROUP BY 1""")
def variant_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.shares(a.reads(spark, sf_dir).select(F.substring("seq1", 1, 2).alias("matched")), 0.06).withColumn("share", F.round("share", 6))


@query(f"""WITH {a.READS}, e AS (SELECT 'integrant' AS "end", 'short' AS mode, regexp_extract(seq1, '^(.*)(AC[ACGT]T)(.*)$', ['b', 'm', 'a']) AS x, false AS l FROM reads UNION ALL SELECT 'linker', 'short', regexp_extract(reverse(seq1), '^(.*)(GG[ACGT]A)(.*)$', ['b', 'm', 'a']), false FROM reads
  UNION ALL SELECT 'integrant', 'long', regexp_extract(seq1, '^(.*)(AC[ACGT]T)(.*)$', ['b', 'm', 'a']), false FROM reads UNION ALL SELECT 'linker', 'long', regexp_extract(seq1, '^(.*?)(T[ACGT]CC)(.*)$', ['b', 'm', 'a']), true FROM reads),
m AS (SELECT mode, "end", x.m AS matched, CASE WHEN l THEN right(x.b, 15) ELSE substr(x.a, 1, 15) END AS beside, count(*) OVER (PARTITION BY mode, "end") AS t FROM e WHERE x.m <> ''),
k AS (SELECT mode, "end", 'match' AS kind, matched AS sequence, count(*) AS n, any_value(t) AS t FROM m GROUP BY ALL), o AS (SELECT mode, "end", 'match', 'Other', coalesce(sum(n) FILTER (n < 0.3 * t), 0), any_value(t) FROM k GROUP BY ALL),
b AS (SELECT mode, "end", 'adjoining', beside, count(*) AS n, any_value(t) AS t FROM m GROUP BY ALL) SELECT mode, "end", kind, sequence, round(n / t, 6) AS share FROM (SELECT * FROM k WHERE n >= 0.3 * t UNION ALL SELECT * FROM o UNION ALL SELECT * FROM b WHERE n >= 0.3 * t)""")
def end_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.reads(spark, sf_dir).withColumn("seq2", F.reverse("seq1"))
    report = lambda long_read: consensus.end_variants(r, "ACNT", "GGNA", long_read, None, 0.0, 0.3)
    both = report(False).withColumn("mode", F.lit("short")).unionByName(report(True).withColumn("mode", F.lit("long")))
    return both.select("mode", "end", "kind", "sequence", F.round("share", 6).alias("share"))


@query(f"""WITH {a.READS}, e AS (SELECT 'integrant' AS "end", rpad(substr(seq1, 1, 36), 36, 'N') AS s, false AS l FROM reads UNION ALL SELECT 'linker', lpad(right(seq1, 36), 36, 'N'), true FROM reads),
c AS (SELECT "end", l, i, substr(s, i, 1) AS base, count(*) AS n FROM e, (SELECT unnest(range(1, 37)) AS i) GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY "end", i) AS share, row_number() OVER (PARTITION BY "end", i ORDER BY n DESC, base) AS k FROM c),
w AS (SELECT "end", l, string_agg(CASE WHEN share >= 0.3 THEN base ELSE 'N' END, '' ORDER BY i) AS s FROM r WHERE k = 1 GROUP BY ALL) SELECT "end", CASE WHEN l THEN reverse(translate(s, 'ACGTN', 'TGCAN')) ELSE s END AS raw FROM w""")
def end_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.end_consensus(a.reads(spark, sf_dir), 36, None, 0.3, long_read=True).select("end", "raw")


@query(f"""WITH {a.FRAGMENTS} SELECT chrom, {_PROJECT.split(", CASE")[0]}, CASE WHEN strand = '-' THEN '+' ELSE '-' END AS site_strand, "end" - start AS length, count(*) AS n FROM fragments GROUP BY ALL""")
def length_location_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundance.length_matrix(sites_.project_sites(a.fragments(spark, sf_dir), tsd=5, u3=True))


@query(f"""WITH {a.FRAGMENTS}, c AS (SELECT chrom, {_PROJECT.split(", CASE")[0]}, CASE WHEN strand = '-' THEN '+' ELSE '-' END AS site_strand, "end" - start AS length, count(*) AS n FROM fragments GROUP BY ALL),
ph AS (SELECT chrom, length, sum(n) / sum(sum(n)) OVER (PARTITION BY chrom) AS phi FROM c GROUP BY chrom, length), h AS (SELECT c.*, phi, sum(n) OVER (PARTITION BY chrom, site_start, site_strand) AS t FROM c JOIN ph USING (chrom, length)),
st AS (SELECT chrom, site_start, site_strand, sum(n * phi * t / (1 - exp(-phi * t))) AS theta FROM h GROUP BY ALL), g AS (SELECT chrom, site_start, site_strand, theta, sum(n * phi / (1 - exp(-phi * theta))) - 1 AS grad FROM h JOIN st USING (chrom, site_start, site_strand) GROUP BY ALL),
b AS (SELECT chrom, site_start, site_strand, sum(phi * phi / (exp(phi * theta) - 1)) AS bend FROM g JOIN ph USING (chrom) GROUP BY ALL)
SELECT chrom, site_start, site_strand, round(theta, 5) AS theta, round(grad, 5) AS grad, round(greatest(theta + grad / bend, 2.220446049250313e-16), 5) AS next FROM g JOIN b USING (chrom, site_start, site_strand)""")
def abundance_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = abundance.first_round(abundance.length_matrix(sites_.project_sites(a.fragments(spark, sf_dir), tsd=5, u3=True)), ["chrom"])
    return got.select("chrom", "site_start", "site_strand", *(F.round(c, 5).alias(c) for c in ("theta", "grad", "next")))


@query()
def mle_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundance.abundance(sites_.project_sites(a.fragments(spark, sf_dir)).withColumn("sample", F.col("chrom")), "sample")


@query(f"WITH {a.READS} SELECT read_name, seq1, repeat('I', 31) AS qual1, substr(ltr_umi, 2, 1) AS ltr_umi, 'N' AS linker_umi, 'GTCATTGCAC' AS ltr_match, CAST(NULL AS VARCHAR) AS linker_match FROM (SELECT * REPLACE (concat(ltr_umi, ltr_umi) AS ltr_umi) FROM reads)")
def adapter_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.reads(spark, sf_dir)
    tagged = r.select("read_name", F.concat("ltr_umi", "ltr_umi", F.lit("GTCATTGCAC"), "seq1").alias("seq1"), F.repeat(F.lit("I"), 43).alias("qual1"))
    return crop.crop(tagged, "GTCATTGCAC", min_frag_len=20, ltr_umi=(1, 0, None))


_REV = lambda seq: f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


def _cut(seq: str, adapter: str) -> str:
    """SQL for what is left of a read before an adapter at its 3' end, whole or at least 5 bases of its beginning, without errors."""
    return f"(CASE WHEN strpos({seq}, {adapter}) > 0 THEN substr({seq}, 1, strpos({seq}, {adapter}) - 1) ELSE substr({seq}, 1, length({seq}) - coalesce(list_max([k FOR k IN range(5, length({adapter})) IF right({seq}, k) = substr({adapter}, 1, k)]), 0)) END)"


_UMI = lambda before, n: f"lpad(right({before}, {n}), {n}, 'N')"


@query(f"""WITH {a.RAW_PAIRS}, f AS (SELECT read_name, regexp_extract(seq1, '^(.*)({a.LTR})(.*)$', ['b', 'm', 'a']) AS x, seq2 FROM raw_pairs), g AS (SELECT read_name, x.b AS before, x.a AS s1, seq2 FROM f WHERE x.m <> '' AND length(x.a) >= 20),
h AS (SELECT * FROM g WHERE list_min(flatten([[levenshtein(substr(s1, i, n), '{a.CONTAMINANT}') FOR n IN range(14, 27) IF i + n <= 31] FOR i IN range(1, 18)])) > 6),
t AS (SELECT read_name, before, {_cut("s1", _REV(f"'{a.LINKER}'"))} AS s1, regexp_extract(seq2, '^(.*)({a.LINKER})(.*)$', ['b', 'm', 'a']) AS y FROM h), u AS (SELECT read_name, before, s1, y.b AS before2, y.a AS s2 FROM t WHERE length(s1) >= 20 AND y.m <> '' AND length(y.a) >= 20),
w AS (SELECT read_name, s1 AS seq1, {_cut("s2", _REV(f"'{a.LTR}'"))} AS seq2, {_UMI("before", 2)} AS ltr_umi, {_UMI("before2", 2)} AS linker_umi FROM u)
SELECT *, length(seq1) AS n1, length(seq2) AS n2, '{a.LTR}' AS ltr_match, '{a.LINKER}' AS linker_match FROM w WHERE length(seq2) >= 20 AND NOT contains(ltr_umi, 'N') AND NOT contains(linker_umi, 'N')""")
def paired_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates cropped: integrant, contaminants, linker, what runs through, UMIs."""
    got = crop.crop(a.raw_pairs(spark, sf_dir), a.LTR, a.LINKER, ltr_error_rate=0.0, linker_error_rate=0.0, min_frag_len=20, ltr_umi=(2, 0, None), linker_umi=(2, 0, "NN"), contaminants=[a.CONTAMINANT])
    return got.select("read_name", "seq1", "seq2", "ltr_umi", "linker_umi", F.length("qual1").alias("n1"), F.length("qual2").alias("n2"), "ltr_match", "linker_match")


_SHORTER = [a.LTR[:n] for n in (14, 13, 12, 11, 10)]


@query(f"""WITH {a.RAW_PAIRS}, f AS (SELECT read_name, seq1, (list_filter(['{"', '".join(_SHORTER)}'], lambda x: contains(seq1, x)))[1] AS m FROM raw_pairs), g AS (SELECT read_name, m, length(seq1) - strpos(reverse(seq1), reverse(m)) + 1 AS e, seq1 FROM f WHERE m IS NOT NULL)
SELECT read_name, substr(seq1, e + 1) AS seq1, length(seq1) - e AS n1, {_UMI("substr(seq1, 1, e - length(m))", 1)} AS ltr_umi, m AS ltr_match FROM g WHERE length(seq1) - e >= 20""")
def truncated_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose integrant end may be cut short: the longest prefix of the ladder counts, with the errors that the shortest one allows."""
    r = a.raw_pairs(spark, sf_dir).select("read_name", "seq1", "qual1")
    got = crop.crop(r, a.LTR, ltr_error_rate=0.05, min_frag_len=20, ltr_umi=(1, 0, None), truncated=True, cap_error=True)
    return got.select("read_name", "seq1", F.length("qual1").alias("n1"), "ltr_umi", "ltr_match")


@query(f"""WITH {a.RAW_PAIRS}, p AS (SELECT read_name, CASE WHEN key2 % 2 = 0 THEN seq1 ELSE seq2 END AS seq1, CASE WHEN key2 % 2 = 0 THEN seq2 ELSE seq1 END AS seq2 FROM (SELECT *, CAST(substr(read_name, 3) AS BIGINT) // 3 AS key2 FROM raw_pairs)),
b AS (SELECT 'pair' AS mode, read_name, seq1, seq2 FROM p UNION ALL SELECT 'pair', read_name, seq2, seq1 FROM p UNION ALL SELECT 'long', read_name, s, NULL FROM (SELECT read_name, unnest([s, {_REV("s")}]) AS s FROM (SELECT read_name, CASE WHEN seq1 < seq2 THEN seq1 ELSE {_REV("seq1")} END AS s FROM raw_pairs))),
x AS (SELECT mode, read_name, seq2, regexp_extract(seq1, '^(.*)({a.LTR})(.*)$', ['b', 'm', 'a']) AS x FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY mode, read_name ORDER BY length(x.b) DESC) AS n FROM x WHERE x.m <> '' AND length(x.a) >= 20),
c AS (SELECT mode, read_name, seq2, x.a AS s1, strpos(x.a, {_REV(f"'{a.LINKER}'")}) > 0 OR len([k FOR k IN range(5, 14) IF right(x.a, k) = substr({_REV(f"'{a.LINKER}'")}, 1, k)]) > 0 AS has, {_cut("x.a", _REV(f"'{a.LINKER}'"))} AS t1 FROM k WHERE n = 1),
y AS (SELECT mode, read_name, t1 AS seq1, regexp_extract(seq2, '^(.*)({a.LINKER})(.*)$', ['b', 'm', 'a']) AS y FROM c WHERE length(t1) >= 20 AND (mode = 'pair' OR has))
SELECT mode, read_name, seq1, CASE WHEN mode = 'pair' THEN {_cut("y.a", _REV(f"'{a.LTR}'"))} END AS seq2 FROM y WHERE mode = 'long' OR (y.m <> '' AND length(y.a) >= 20 AND length({_cut("y.a", _REV(f"'{a.LTR}'"))}) >= 20)""")
def mixed_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates that may stand the other way round, and long reads of either strand."""
    raw = a.raw_pairs(spark, sf_dir)
    turned = raw.withColumn("__k", F.floor(F.substring("read_name", 3, 20).cast("long") / 3) % 2 == 0)
    pick = lambda x, y: F.when(F.col("__k"), F.col(x)).otherwise(F.col(y)).alias(x)
    pairs = turned.select("read_name", pick("seq1", "seq2"), pick("qual1", "qual2"), pick("seq2", "seq1"), pick("qual2", "qual1"))
    long = raw.select("read_name", F.when(F.col("seq1") < F.col("seq2"), F.col("seq1")).otherwise(revcomp(F.col("seq1"))).alias("seq1"), "qual1")
    options = {"ltr_error_rate": 0.0, "linker_error_rate": 0.0, "min_frag_len": 20, "mixed": True}
    one = crop.crop(pairs, a.LTR, a.LINKER, **options).select(F.lit("pair").alias("mode"), "read_name", "seq1", "seq2")
    return one.unionByName(crop.crop(long, a.LTR, a.LINKER, long_read=True, **options).select(F.lit("long").alias("mode"), "read_name", "seq1", F.lit(None).cast("string").alias("seq2")))


@query(f"""WITH {a.READS}, r AS (SELECT read_name, CASE WHEN family % 9 = 0 THEN NULL ELSE family END AS mm_group, concat('chr', ltr_umi) AS chrom, 100 * (family % 3) AS start, 100 * (family % 3) + 50 AS "end", CASE WHEN family % 2 = 0 THEN '+' ELSE '-' END AS strand, seq1, CASE WHEN ltr_umi = 'A' THEN 50 * count ELSE count END AS count FROM reads),
p AS (SELECT mm_group, chrom, start, "end", strand, sum(count) AS c, count(*) AS n FROM r WHERE mm_group IS NOT NULL GROUP BY ALL), g AS (SELECT mm_group, sum(n) AS n, sum(c) AS t, count(*) AS k FROM p GROUP BY mm_group), able AS (SELECT p.*, count(*) OVER (PARTITION BY mm_group) AS many FROM p JOIN g USING (mm_group) WHERE g.n >= 6 AND 2 * g.k * p.c >= g.t)
SELECT r.read_name, a.mm_group IS NOT NULL AS moved, CASE WHEN a.mm_group IS NOT NULL THEN 'multi_grouped' ELSE 'multi' END AS mapping_class, CASE WHEN a.many > 1 THEN 'one of several' ELSE coalesce(a.chrom, r.chrom) END AS chrom, CASE WHEN a.many IS NULL THEN r.start WHEN r.strand = '-' THEN r."end" - length(r.seq1) ELSE r.start END AS start,
  CASE WHEN a.many IS NULL THEN r."end" WHEN r.strand = '-' THEN r."end" ELSE r.start + length(r.seq1) END AS "end" FROM r LEFT JOIN (SELECT * FROM able QUALIFY row_number() OVER (PARTITION BY mm_group ORDER BY chrom) = 1) a USING (mm_group)""")
def group_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of multimapping reads moved to one of their able places; which one of several is a seeded draw, so only that it is one of them is told."""
    r = a.reads(spark, sf_dir)
    f, u = F.col("family"), F.col("ltr_umi")
    rows = r.select("read_name", F.when(f % 9 != 0, f).alias("mm_group"), F.concat(F.lit("chr"), u).alias("chrom"), (100 * (f % 3)).alias("start"), (100 * (f % 3) + 50).alias("end"), F.when(f % 2 == 0, "+").otherwise("-").alias("strand"), "seq1", F.when(u == "A", 50 * F.col("count")).otherwise(F.col("count")).alias("count"))
    got = reassign.assign_groups(rows, 6)
    able = rows.where("mm_group is not null").groupBy("mm_group", "chrom").agg(F.sum("count").alias("c")).withColumn("k", F.count("*").over(Window.partitionBy("mm_group"))).withColumn("t", F.sum("c").over(Window.partitionBy("mm_group"))).where(2 * F.col("k") * F.col("c") >= F.col("t"))
    able = able.groupBy("mm_group").agg(F.collect_set("chrom").alias("able"))
    moved = F.col("mapping_class") == "multi_grouped"
    several = moved & (F.size("able") > 1) & F.array_contains("able", F.col("chrom"))
    return got.join(able, "mm_group", "left").select("read_name", moved.alias("moved"), "mapping_class", F.when(several, "one of several").otherwise(F.col("chrom")).alias("chrom"), "start", "end")


@query(f"""WITH {a.READS}, sq AS (SELECT DISTINCT family, seq1 AS s FROM reads), k AS (SELECT family, s, substr(s, i, 4) AS t, count(*) AS c FROM sq, range(1, 30) AS r(i) GROUP BY ALL), n AS (SELECT family, s, sum(c * c) AS q FROM k GROUP BY ALL),
d AS (SELECT x.family, x.s, y.s AS t, sum(x.c * y.c) AS dot FROM k x JOIN k y ON x.family = y.family AND x.t = y.t AND x.s <> y.s GROUP BY ALL), c AS (SELECT d.*, dot / sqrt(a.q * b.q) AS cosine FROM d JOIN n a ON a.family = d.family AND a.s = d.s JOIN n b ON b.family = d.family AND b.s = d.t)
SELECT family, s, t, round(cosine, 6) AS cosine FROM c WHERE cosine >= 0.8 - 1e-12 QUALIFY row_number() OVER (PARTITION BY family, s ORDER BY cosine DESC, t) <= 20""")
def cosine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest sequences of each one by their 4-mers."""
    return similarity.cosine_neighbours(a.reads(spark, sf_dir), ["family"], "seq1", 0.8).withColumn("cosine", F.round("cosine", 6))


@query()
def mispriming_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _unique_reads(spark, sf_dir)
    contigs = r.groupBy(F.col("chrom").alias("contig")).agg(F.array_join(F.array_sort(F.collect_set(F.col("seq1"))), "").alias("seq"))
    placed = r.select("read_name", "chrom", (F.col("start") % 5000).alias("site_start"), (F.col("start") % 5000 + 1).alias("site_end"), F.col("strand").alias("site_strand")).distinct()
    kept, bad = mispriming.split_misprimed(placed, mispriming.genome_chunks(contigs, 1 << 14), "ACGTTGCACGTACCATGGCA")
    return kept.withColumn("misprimed", F.lit(False)).unionByName(bad.select(*kept.columns).withColumn("misprimed", F.lit(True)))


@query(f"""WITH {a.SITES}, e AS (SELECT event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), l AS (SELECT *, CASE WHEN t - lag(t) OVER w < 3600 THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY event_type, user_id ORDER BY t)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY event_type, user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT event_type, user_id, min(t) AS start, max(t) + 3600 AS "end", count(*) AS n FROM g GROUP BY event_type, user_id, g""")
def event_gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").select("event_type", "user_id", F.date_trunc("second", "ts").cast("timestamp").alias("ts"))
    got = gap_runs(e, "ts", "3600 seconds", ["event_type", "user_id"])
    return got.withColumn("start", F.unix_timestamp("start")).withColumn("end", F.unix_timestamp("end"))


@query("""SELECT c_name AS name, coalesce(upper(n_name), c_mktsegment) AS ltr, n_name IS NOT NULL AS ltr_known FROM customer LEFT JOIN nation ON CAST(c_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR) AND n_nationkey < 20""".replace("c_mktsegment)", "CAST(c_nationkey AS VARCHAR))"))
def primer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = a.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("ltr"), F.lit("x").alias("linker"))
    primers = a.table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("sequence"))
    return setup.primer_lookup(sheet, primers).select("name", "ltr", "ltr_known")


# --- scalar functions and small operators


@query(f"""WITH {a.READS} SELECT read_name, reverse(translate(s, 'ACGTRYSWKMBDHVNacgt', 'TGCAYRSWMKVHDBNTGCA')) AS other FROM (SELECT read_name, translate(md5(read_name), '0123456789abcdef', 'ACGTRYSWKMBDHVNa') AS s FROM reads)""")
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.translate(F.md5("read_name"), "0123456789abcdef", "ACGTRYSWKMBDHVNa")
    return a.reads(spark, sf_dir).select("read_name", revcomp(s).alias("other"))


@query("""SELECT p_partkey, dense_rank() OVER (ORDER BY CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END, p_size) AS place FROM part""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of names such as chr2, chr10, contig7 in natural order."""
    p = a.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 7 == 0, "contig").otherwise("chr"), F.col("p_size").cast("string")).alias("name"))
    places = p.select("name").distinct().withColumn("place", F.dense_rank().over(Window.orderBy(natural_key(F.col("name")))))
    return p.join(places, "name").select("p_partkey", F.col("place").cast("long").alias("place"))


@query(f"""WITH {a.ALIGNMENTS} SELECT read_name, round(error, 9) AS error, round(-10 * log10(error), 6) AS phred FROM al""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.alignments(spark, sf_dir).select("read_name", error_probability(F.col("quals")).alias("error"))
    return e.select("read_name", F.round("error", 9).alias("error"), F.round(phred(F.col("error")), 6).alias("phred"))


@query(f"""WITH {a.READS}, m AS (SELECT read_name, seq1, CASE WHEN k % 3 = 0 THEN r WHEN k % 3 = 1 THEN concat('GG', substr(r, 3)) END AS seq2, r FROM (SELECT *, CAST(substr(read_name, 2) AS BIGINT) AS k, reverse(translate(seq1, 'ACGT', 'TGCA')) AS r FROM reads))
SELECT read_name, CASE WHEN seq2 IS NULL OR 1 - levenshtein(seq1, reverse(translate(seq2, 'ACGT', 'TGCA'))) / greatest(length(seq1), length(seq2)) >= 0.95 THEN seq1 ELSE concat(seq1, seq2) END AS compared FROM m""")
def compared_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    other, k = revcomp(F.col("seq1")), F.substring("read_name", 2, 20).cast("long")
    r = a.reads(spark, sf_dir).withColumn("seq2", F.when(k % 3 == 0, other).when(k % 3 == 1, F.concat(F.lit("GG"), F.substring(other, 3, 100))))
    return r.select("read_name", similarity.compare_sequence(0.95).alias("compared"))


@query(f"""WITH {a.READS}, k AS (SELECT read_name, [substr(seq1, i, 4) FOR i IN range(1, length(seq1) - 2)] AS x, [substr(b, i, 4) FOR i IN range(1, length(b) - 2)] AS y FROM (SELECT read_name, seq1, translate(md5(CAST(family AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM reads)),
d AS (SELECT read_name, list_sum([len([u FOR u IN y IF u = t]) FOR t IN x]) AS xy, list_sum([len([u FOR u IN x IF u = t]) FOR t IN x]) AS xx, list_sum([len([u FOR u IN y IF u = t]) FOR t IN y]) AS yy FROM k) SELECT read_name, round(xy / sqrt(xx * yy), 6) AS cosine FROM d""")
def kmer_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.translate(F.md5(F.col("family").cast("string")), "0123456789abcdef", "ACGT" * 4)
    return a.reads(spark, sf_dir).select("read_name", F.round(similarity.kmer_cosine(F.col("seq1"), base, 4), 6).alias("cosine"))


@query(f"""WITH {a.READS} SELECT read_name, substr(seq1, 1, 4) AS first, CASE WHEN k % 2 = 0 THEN substr(seq1, 5, 4) END AS second FROM (SELECT *, CAST(substr(read_name, 2) AS BIGINT) AS k FROM reads)""")
def header_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("read_name", 2, 20).cast("long")
    header = F.concat("read_name", F.lit(" 1:N:0:"), F.substring("seq1", 1, 4), F.when(k % 2 == 0, F.concat(F.lit("+"), F.substring("seq1", 5, 4))).otherwise(""))
    first, second = demux.header_index(header)
    return a.reads(spark, sf_dir).select("read_name", first.alias("first"), second.alias("second"))


def _inline(read: str, code: str, out: str) -> str:
    return f"{out} AS (SELECT read_name, sample, row_number() OVER (PARTITION BY read_name ORDER BY ord) AS n FROM rd JOIN codes ON hamming({read}, {code}) <= 1)"


@query(f"""WITH {a.READS}, codes(sample, barcode, ord) AS (VALUES {_VALUES}), rd AS (SELECT read_name, seq1, substr(seq1, 5) AS seq2 FROM reads), {_inline("substr(seq1, 1, 4)", "barcode", "f")}, {_inline("substr(seq2, 1, 4)", "barcode", "s")}, {_inline("right(seq1, 4)", "reverse(translate(barcode, 'ACGT', 'TGCA'))", "t")},
p AS (SELECT f.read_name, f.sample AS a, s.sample AS b FROM f JOIN s ON f.read_name = s.read_name AND f.n = 1 AND s.n = 1), l AS (SELECT f.read_name, f.sample AS a, t.sample AS b FROM f JOIN t ON f.read_name = t.read_name AND f.n = 1 AND t.n = 1)
SELECT read_name, 'both' AS mode, a AS sample FROM p WHERE a = b UNION ALL SELECT read_name, 'all', concat(a, '-', b) FROM p UNION ALL SELECT read_name, 'linked', a FROM l WHERE a = b
UNION ALL SELECT rd.read_name, 'first', coalesce(f.sample, 'unknown') FROM rd LEFT JOIN f ON f.read_name = rd.read_name AND f.n = 1 UNION ALL SELECT rd.read_name, 'three', CASE WHEN t.sample = 's1' THEN 'renamed' ELSE coalesce(t.sample, 'unknown') END FROM rd LEFT JOIN t ON t.read_name = rd.read_name AND t.n = 1""")
def inline_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline barcodes at both ends (paired, all combinations, linked in one read), at the first end, and at the 3' end with a renamed sample."""
    r = checkpointed(a.reads(spark, sf_dir).select("read_name", "seq1", F.substring("seq1", 5, 100).alias("seq2")))  # the view's hashes once, not wherever a mode looks at a read
    codes = _barcodes(spark)
    demux.check_barcodes(codes)
    demux.check_same_ids(codes, codes)
    got = {
        "both": demux.inline_demux(r, codes, codes, 0.25), "all": demux.inline_demux(r, codes, codes, 0.25, keep_all=True), "linked": demux.inline_demux(r, codes, codes, 0.25, seq2=None), "first": demux.inline_demux(r, codes, None, 0.25),
        "three": demux.renamed(demux.inline_demux(r, None, codes, 0.25, seq2=None), spark.createDataFrame([("s1", "renamed")], "old string, new string")),
    }
    out = None
    for mode, df in got.items():
        one = df.select("read_name", F.lit(mode).alias("mode"), "sample")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {a.FRAGMENTS}, e AS (SELECT sum(count) AS count FROM fragments GROUP BY chrom, strand, start, "end", ltr_umi, linker_umi), t AS (SELECT 'all' AS stage, count(*) AS rows, CAST(sum(count) AS BIGINT) AS reads FROM fragments UNION ALL SELECT 'exact', count(*), CAST(sum(count) AS BIGINT) FROM e UNION ALL SELECT 'plus', count(*), CAST(sum(count) AS BIGINT) FROM fragments WHERE strand = '+' UNION ALL SELECT 'none', 0, 0)
SELECT stage, rows, reads, round(100 * reads / (SELECT reads FROM t WHERE stage = 'all'), 6) AS percent FROM t""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.fragments(spark, sf_dir)
    return sites_.statistics({"all": f, "exact": dedup.unique_exact(f), "plus": f.where("strand = '+'"), "none": f.where("false")}).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {a.FRAGMENTS} SELECT chrom, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS site_start, CASE WHEN strand = '-' THEN "end" ELSE start + 1 END AS site_end, read_name, count, strand AS site_strand, start, "end", ltr_umi, linker_umi, map_qual, mean_qual, CAST(NULL AS VARCHAR) AS seq1, CAST(NULL AS VARCHAR) AS multi FROM fragments""")
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_.summary(sites_.project_sites(a.fragments(spark, sf_dir)))


@query(f"""WITH {a.SITES}, {a.FEATURES}, n AS (SELECT s.chrom, s.site_start, s.site_strand, count(DISTINCT s.site_id) AS w, bool_or(f.name IS NOT NULL) AS hit FROM sites s LEFT JOIN features f ON s.chrom = f.chrom AND s.site_start < f."end" AND f.start < s.site_end GROUP BY ALL)
SELECT unit, round(sum(CASE WHEN hit THEN v ELSE 0 END) / sum(v), 6) AS share FROM (SELECT 'fragments' AS unit, w AS v, hit FROM n UNION ALL SELECT 'sites', 1, hit FROM n) GROUP BY unit""")
def annotation_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that overlaps a feature, counted by fragments and by unique sites."""
    one = a.sites(spark, sf_dir).groupBy("chrom", "site_start", "site_end", "site_strand").agg(F.min("site_id").alias("site_id"), F.count("*").alias("w"))
    counted = annotate.overlaps(one, a.features(spark, sf_dir))
    share = lambda unit, weight: annotate.overlap_share(counted, weight).select(F.lit(unit).alias("unit"), F.round("share", 6).alias("share"))
    return share("fragments", "w").unionByName(share("sites", None))


@query(f"""WITH {a.READS}, c AS (SELECT CAST(family AS VARCHAR) AS contig, string_agg(seq1, '' ORDER BY read_name) AS g FROM reads GROUP BY family), s AS (SELECT read_name, CAST(family AS VARCHAR) AS contig, CAST(substr(read_name, 2) AS BIGINT) % 400 AS place, CASE WHEN count % 2 = 0 THEN '+' ELSE '-' END AS strand FROM reads),
w AS (SELECT read_name, strand, substr(g, greatest(0, place - 25) + 1, place + 26 - greatest(0, place - 25)) AS x FROM s JOIN c USING (contig)) SELECT read_name, CASE WHEN strand = '-' THEN reverse(translate(x, 'ACGT', 'TGCA')) ELSE x END AS window_seq FROM w""")
def site_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genome windows around sites, from contigs cut in chunks of 64 bases."""
    r = a.reads(spark, sf_dir)
    contigs = r.groupBy(F.col("family").cast("string").alias("contig")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_name", "seq1"))), lambda x: x["seq1"]), "").alias("seq"))
    at = F.substring("read_name", 2, 20).cast("long") % 400
    placed = r.select("read_name", F.col("family").cast("string").alias("chrom"), at.alias("site_start"), (at + 1).alias("site_end"), F.when(F.col("count") % 2 == 0, "+").otherwise("-").alias("site_strand"))
    return mispriming.site_windows(placed, mispriming.genome_chunks(contigs, 64), size=64).select("read_name", F.coalesce("window_seq", F.lit("")).alias("window_seq"))


# --- files: written in the shared folder and read again


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query(f"WITH {a.READS} SELECT read_name, concat('RX:Z:', ltr_umi, '-N') AS comment, seq1 AS seq, repeat('I', length(seq1)) AS qual FROM reads")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    r = a.reads(spark, sf_dir).select("read_name", "seq1", F.expr("repeat('I', length(seq1))").alias("qual1"), F.concat("read_name", F.lit(" RX:Z:"), "ltr_umi", F.lit("-N")).alias("header"))
    files.write_fastq(r.unionByName(r.withColumn("seq1", F.concat(F.lit("Z"), "seq1"))), path, F.col("header"))  # of two records of a name the first
    return files.read_fastq(spark, path).select("read_name", "comment", "seq", "qual")


@query(f"""WITH {a.READS} SELECT CAST(family AS VARCHAR) AS contig, string_agg(seq1, '' ORDER BY read_name) AS seq FROM reads GROUP BY family""")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    lines = a.reads(spark, sf_dir).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("read_name", "seq1"))).alias("l"))
    files.write_text(lines.select(F.concat(F.lit(">"), "family", F.lit(" a comment\n"), F.array_join(F.transform("l", lambda x: F.lower(x["seq1"])), "\n")).alias("value")), path)
    return files.read_fasta(spark, path).select("contig", "seq")


@query(f"""WITH {a.FRAGMENTS} SELECT chrom, start, "end", read_name AS name, CAST(count AS DOUBLE) AS score, strand FROM fragments""")
def bed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    files.write_bed(a.fragments(spark, sf_dir), path, ["chrom", "start", "end", "read_name", "count", "strand"])
    return files.read_bed(spark, path)


@query(f"""WITH {a.ALIGNMENTS} SELECT read_name, 1 AS mate, ref, start, start + size - CASE WHEN clipped THEN 3 ELSE 0 END AS "end", strand, mapq, CASE WHEN clipped THEN 2 ELSE 1 END AS operations, md, nm, coalesce(xm, -1) AS xm, CAST(score AS INT) AS score, CAST(coalesce(second, -99) AS INT) AS second, seq, tlen, strand <> '-' AS primary FROM al WHERE start % 5 <> 0""")
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as SAM text, with a header and unmapped records, read again."""
    path, al = _folder(spark), a.alignments(spark, sf_dir)
    flag = F.when(F.col("start") % 5 == 0, 4).otherwise(0) + F.when(F.col("strand") == "-", 16 + 256).otherwise(0)
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), F.substr(F.lit("MIDNSHP=X"), c["op"] + 1, F.lit(1)))), "")
    tag = lambda name, c: F.concat(F.lit(f"{name}:i:"), F.col(c).cast("string"))
    line = F.concat_ws("\t", "read_name", flag.cast("string"), "ref", (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), cigar, F.lit("="), F.lit("0"), F.col("tlen").cast("string"), "seq",
                       a.quality_letters(F.col("start"), (F.col("end") - F.col("start")).cast("int")), F.concat(F.lit("MD:Z:"), "md"), tag("NM", "nm"), tag("XM", "xm"), tag("AS", "score"), tag("XS", "second"))
    files.write_text(spark.createDataFrame([("@HD\tVN:1.6",)], "value string").unionByName(al.select(line.alias("value"))), path)
    return files.read_sam(spark, path).select("read_name", "mate", "ref", "start", "end", "strand", "mapq", F.size("cigar").alias("operations"), "md", "nm", F.coalesce("xm", F.lit(-1)).alias("xm"), "score", F.coalesce("second", F.lit(-99)).alias("second"), "seq", "tlen", "primary")


@query(f"""WITH {a.READS}, codes(sample, barcode, ord) AS (VALUES {_VALUES}), m AS (SELECT read_name, sample, row_number() OVER (PARTITION BY read_name ORDER BY ord) AS n FROM reads JOIN codes ON hamming(substr(seq1, 1, 4), barcode) <= 1), r AS (SELECT coalesce(sample, 'un known/x') AS sample, reads.* EXCLUDE (count) FROM reads LEFT JOIN (SELECT * FROM m WHERE n = 1) x USING (read_name))
SELECT sample, 1 AS mate, read_name, seq1 AS seq, repeat('I', length(seq1)) AS qual FROM r UNION ALL SELECT sample, 2, read_name, reverse(seq1), repeat('J', length(seq1)) FROM r""")
def sample_fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demultiplexed reads, written as FASTQ of each sample and mate, and read again."""
    path = _folder(spark)
    r = demux.index_demux(a.reads(spark, sf_dir), F.substring("seq1", 1, 4), _barcodes(spark), error_rate=0.25).withColumn("sample", F.coalesce("sample", F.lit("un known/x")))
    files.write_sample_fastq(r.select("sample", "read_name", "seq1", F.expr("repeat('I', length(seq1))").alias("qual1"), F.reverse("seq1").alias("seq2"), F.expr("repeat('J', length(seq1))").alias("qual2")), path)
    return files.read_sample_fastq(spark, path).select("sample", "mate", "read_name", "seq", "qual")


@query("""WITH s AS (SELECT p_partkey, concat('part', p_partkey) AS nm, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS x FROM part), l AS (SELECT nm, x AS a, reverse(x) AS b FROM s), c AS (SELECT nm, right(a, 20) AS ltr, right(b, 18) AS linker, concat('NN', substr(a, 3, 8)) AS lb, substr(b, 1, 10) AS kb, substr(a, 5, 8) AS i1 FROM l)
SELECT nm, kind, seq, ltr, linker, concat('demux/', nm, '_Rltr.fq.gz') AS r1, concat('demux/', nm, '_Rlink.fq.gz') AS r2 FROM (SELECT *, 'ltr_barcode' AS kind, lb AS seq FROM c UNION ALL SELECT *, 'linker_barcode', kb FROM c UNION ALL SELECT *, 'index1', i1 FROM c)""")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of all parts as samples, its vectors, and its barcodes and indices as FASTA."""
    path = _folder(spark)
    x = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    rows = a.table(spark, sf_dir, "part").select(F.concat_ws("\t", F.concat(F.lit("part "), F.col("p_partkey").cast("string")), x, F.reverse(x), F.concat(F.lit(" "), F.substring(x, 5, 8))).alias("value"))
    rows.write.text(f"{path}/sheet")
    sheet = setup.read_sheet(spark, f"{path}/sheet", indices=(4, 0), lengths=(20, 18), masks=(2, 0))
    out = None
    for kind in setup.write_sheet_fasta(sheet, f"{path}/fasta"):
        got = files.read_fasta(spark, f"{path}/fasta/{kind}").select(F.col("contig").alias("nm"), F.lit(kind).alias("kind"), "seq")
        out = got if out is None else out.unionByName(got)
    return out.join(sheet.select("nm", "ltr", "linker", "r1", "r2"), "nm").select("nm", "kind", "seq", "ltr", "linker", "r1", "r2")
