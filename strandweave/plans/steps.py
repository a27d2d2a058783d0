"""Queries over the chain of filters, interval sets, long reads and group references."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import chain, filters, links, reads
from strandweave.plans import proxy
from strandweave.plans.iteration import checkpointed
from strandweave.plans.proxy import named, with_
from strandweave.plans.queries import _AGP, _DENS, _NX, _RANKS, Frames, Numbered, _agp, query, rounded

_DEPTH = "(re_sites * 7 + len) % 41"


def _with_depth(contigs):
    return contigs.withColumn("depth", (F.col("re_sites") * 7 + F.col("len")) % 41)


_AMONG = """, lk0 AS (SELECT l.* FROM links l WHERE ctg_i IN (SELECT ctg FROM s) AND ctg_j IN (SELECT ctg FROM s)),
dg AS (SELECT ctg, sum(links)::BIGINT AS degree FROM (SELECT ctg_i AS ctg, links FROM lk0 UNION ALL SELECT ctg_j, links FROM lk0) GROUP BY 1),
dn AS (SELECT s.ctg, re_sites, coalesce(degree, 0) AS degree, coalesce(degree, 0) / re_sites AS density FROM s LEFT JOIN dg ON s.ctg = dg.ctg),
m AS (SELECT sum(degree) / (1 + sum(re_sites - 1)) AS m FROM dn WHERE degree > 0),
dq AS (SELECT quantile_cont(depth, 0.25) AS q1, quantile_cont(depth, 0.75) AS q3 FROM s),
k AS (SELECT ctg FROM dn, m WHERE density >= 0.2 * m AND density <= 1.9 * m INTERSECT SELECT ctg FROM s, dq WHERE depth <= q3 + 1.5 * (q3 - q1))"""


@query(with_("links", f", s AS (SELECT *, {_DEPTH} AS depth FROM contigs)" + _AMONG + " SELECT ctg FROM k"))
def density_and_depth(spark, d):
    f = Frames(spark, d)
    return chain.dense_enough(_with_depth(f.contigs), f.links, chain.Chain())


_CHAIN = _NX + f", s AS (SELECT *, {_DEPTH} AS depth FROM nx WHERE re_sites > 5)" + _AMONG + _RANKS.replace("SELECT ctg FROM contigs WHERE hap = 1", "SELECT ctg FROM k")


@query(with_("links", _CHAIN + """, rq AS (SELECT quantile_cont(rank_sum, 0.25) AS q1, quantile_cont(rank_sum, 0.75) AS q3 FROM rs)
SELECT ctg FROM rs, rq WHERE rank_sum <= q3 + 1.5 * (q3 - q1) UNION SELECT ctg FROM contigs WHERE hap = 0"""))
def filter_chain(spark, d):
    f = Frames(spark, d)
    return chain.filter_fragments(_with_depth(f.contigs), named(Numbered(spark, d).links, "ctg_i", "ctg_j"), f.contigs.where("hap = 0"), chain.Chain(sites=5))


@query(with_("links", _RANKS + " SELECT ctg, rank_sum FROM rs WHERE rank_sum <= 95"))
def rank_sum_cutoff(spark, d):
    f = Numbered(spark, d)
    return named(chain.at_most(filters.rank_sums(checkpointed(f.links), f.contigs.where("hap = 1"), 5), 95), "ctg")


# --- intervals ---

_ISLANDS = """, iv AS (SELECT rname AS k, rstart AS s, rend AS e FROM paf WHERE {0}), ix AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv),
ig AS (SELECT *, sum(CASE WHEN s > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM ix), isl AS (SELECT k, min(s) AS s, max(e) AS e FROM ig GROUP BY k, g)"""


def _spans(spark, d, where):
    return proxy.alignments(spark, d).where(where).select("rname", F.col("rstart").alias("start"), F.col("rend").alias("end"))


@query(with_("paf", _ISLANDS.format("mapq >= 30") + ' SELECT k AS rname, s AS start, e AS "end" FROM isl'))
def interval_union(spark, d):
    return chain.interval_union(_spans(spark, d, "mapq >= 30"), "rname")


@query(with_("paf", _ISLANDS.format("mapq >= 30") + """, sz AS (SELECT DISTINCT rname AS k, rlen AS n FROM paf), ev AS (SELECT k, n AS s, n AS e FROM sz UNION ALL SELECT k, s, e FROM isl),
c AS (SELECT k, coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM ev) SELECT k AS rname, a AS start, b AS "end" FROM c WHERE b > a"""))
def interval_complement(spark, d):
    sizes = proxy.alignments(spark, d).select("rname", F.col("rlen").alias("size")).distinct()
    return chain.interval_complement(chain.interval_union(_spans(spark, d, "mapq >= 30"), "rname"), sizes, "rname")


@query(with_("paf", """, p AS (SELECT rname, unnest(range(rstart, rend)) AS x FROM paf WHERE mapq >= 30 EXCEPT SELECT rname, unnest(range(rstart, rend)) FROM paf WHERE mapq < 15)
SELECT rname, count(*) AS bases FROM p GROUP BY 1"""))
def interval_difference(spark, d):
    """Bases of each reference in the difference; SQL lists them one by one."""
    parts = chain.interval_difference(_spans(spark, d, "mapq >= 30"), _spans(spark, d, "mapq < 15"), "rname")
    return parts.groupBy("rname").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query(with_("paf", ' SELECT rname, min(rstart) AS start, max(rend) AS "end" FROM paf GROUP BY 1'))
def interval_hull(spark, d):
    return chain.interval_hull(_spans(spark, d, "true"), "rname")


# --- long reads ---

_READS = ", al AS (SELECT *, 'r' || (line % 997)::VARCHAR AS read, line % 4 <> 0 AS supplementary, matches AS score FROM paf)"


def _reads(spark, d):
    paf = proxy.alignments(spark, d)
    line = F.col("line")
    return paf.withColumns({"read": F.concat(F.lit("r"), (line % 997).cast("string")), "supplementary": line % 4 != 0, "score": F.col("matches")})


@query(with_("paf", _READS + " SELECT line FROM al WHERE mapq >= 20 AND rlen >= 1000 AND least(rstart, rlen - rend) <= 20000"))
def ends_of_contigs(spark, d):
    return reads.near_an_end(_reads(spark, d), 20, 1000, 20_000).select("line")


_BEST = _READS + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, line) AS n FROM al WHERE supplementary) WHERE n = 1)"


@query(with_("paf", _BEST + " SELECT read, line, score FROM best"))
def best_supplementary(spark, d):
    return reads.best_supplementary(_reads(spark, d)).select("read", "line", "score")


@query(with_("paf", _BEST + """, j AS (SELECT a.read, a.rname AS ctg_i, b.rname AS ctg_j, least(a.qend, b.qend) - greatest(a.qstart, b.qstart) AS overlap, least(a.qend - a.qstart, b.qend - b.qstart) AS shorter
FROM al a JOIN best b ON a.read = b.read WHERE NOT a.supplementary AND a.rname <> b.rname)
SELECT read, ctg_i, ctg_j, overlap FROM j WHERE CASE WHEN overlap >= 0 THEN overlap <= 0.3 * shorter ELSE -overlap <= 50 END"""))
def long_read_joins(spark, d):
    own = _reads(spark, d)
    return reads.joins(own.where("not supplementary"), reads.best_supplementary(own), 0.3, 50)


@query(with_("raw", " SELECT read_id, ref, pos, mref, mpos FROM raw WHERE read_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)"))
def pairs_without_reads(spark, d):
    listed = proxy.read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("read_id"))
    return reads.without_reads(proxy.raw_pairs(spark, d), listed)


# --- groups and references ---


@query(with_("contigs paf", " SELECT DISTINCT grp FROM contigs WHERE grp IS NOT NULL AND grp NOT IN (SELECT grp FROM contigs WHERE grp IS NOT NULL AND ctg IN (SELECT qname FROM paf))"))
def unaligned_groups(spark, d):
    return reads.unaligned_groups(proxy.contigs(spark, d).where("grp is not null").select("grp", "ctg"), proxy.alignments(spark, d))


@query(with_("contigs", " SELECT grp, ctg, len FROM contigs WHERE grp IN (SELECT grp FROM contigs GROUP BY 1 HAVING count(*) > 1 OR sum(len) >= 500)"))
def solo_groups_out(spark, d):
    return reads.enough_contigs(proxy.contigs(spark, d).where("grp is not null").select("grp", "ctg", "len"), 500)


@query(with_("paf contigs", """, ln AS (SELECT grp, rname, sum(qend - qstart)::BIGINT AS len FROM paf JOIN contigs ON qname = ctg WHERE grp IS NOT NULL GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY len DESC, rname DESC) AS n FROM ln) WHERE n = 1)
SELECT grp, rname, len, row_number() OVER (PARTITION BY rname ORDER BY len DESC, grp) AS idx FROM b"""))
def reference_order(spark, d):
    c = proxy.contigs(spark, d).where("grp is not null").select(F.col("ctg").alias("qname"), "grp")
    lengths = proxy.alignments(spark, d).join(c, "qname").groupBy("grp", "rname").agg(F.sum(F.col("qend") - F.col("qstart")).alias("len"))
    return reads.reference_order(lengths)


# --- links ---


@query(with_("pairs", """, e AS (SELECT ctg_i AS ctg, pos_i AS pos, ctg_j AS other FROM pairs WHERE ctg_i <> ctg_j UNION ALL SELECT ctg_j, pos_j, ctg_i FROM pairs WHERE ctg_i <> ctg_j),
n AS (SELECT e.ctg, floor(pos / 100)::BIGINT AS bin, hap, count(*) AS n FROM e JOIN contigs c ON other = c.ctg GROUP BY ALL)
SELECT ctg, bin, hap, n, round(sum(n) OVER (PARTITION BY ctg, bin ORDER BY hap ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY ctg, bin), 6) AS upto FROM n"""))
def haplotype_tracks(spark, d):
    f = Numbered(spark, d)
    return named(rounded(reads.haplotype_tracks(f.pairs, f.contigs, 100), "upto"), "ctg")


@query(with_("links", _DENS + """, r AS (SELECT ctg_i, ctg_j, links, (links % 10) / 10.0 AS ratio FROM links)
SELECT ctg_i, ctg_j, (links * CASE WHEN ratio > 0.5 THEN 3.0 ELSE 1.0 END)::DOUBLE AS links FROM r"""))
def concentrated_links(spark, d):
    full = Frames(spark, d).links
    return reads.multiplied(full, full.withColumn("ratio", (F.col("links") % 10) / 10.0), 0.5, 3.0)


@query(with_("layout", _AGP + """ SELECT object, component, start - floor((part - 1) / 2 * 100)::BIGINT AS start, "end" - floor((part - 1) / 2 * 100)::BIGINT AS "end" FROM agp WHERE type = 'W'"""))
def gapless_places(spark, d):
    return reads.without_gaps(_agp(spark, d), 100)


@query(" SELECT o_orderkey AS job, o_orderkey % 30 * 3600 + o_orderkey % 60 * 60 + o_orderkey * 7 % 60 AS seconds FROM orders")
def job_seconds(spark, d):
    o = F.col("o_orderkey")
    clock = F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (o % 30, o % 60, o * 7 % 60)))
    return proxy.read(spark, d, "orders").select(o.alias("job"), reads.seconds(clock).alias("seconds"))


@query(" SELECT sum(o_orderkey % 30 * 3600)::BIGINT AS total, max(o_orderkey % 30 * 3600) AS longest FROM orders")
def job_totals(spark, d):
    s = (F.col("o_orderkey") % 30 * 3600).cast("long")
    return proxy.read(spark, d, "orders").agg(F.sum(s).alias("total"), F.max(s).alias("longest"))


@query(with_("links", _DENS + """ SELECT hap, count(*) AS n, round(avg(density), 6) AS density FROM dens JOIN contigs USING (ctg) GROUP BY 1"""))
def density_by_haplotype(spark, d):
    f = Frames(spark, d)
    dens = filters.density(f.contigs, links.degree(f.links)).select("ctg", "density").join(f.contigs.select("ctg", "hap"), "ctg")
    return rounded(dens.groupBy("hap").agg(F.count("*").alias("n"), F.avg("density").alias("density")), "density")
