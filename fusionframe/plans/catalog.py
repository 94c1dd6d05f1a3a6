"""The registered queries on the supplied tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fusionframe.fixtures import transcripts, view
from fusionframe.functions import columns as C
from fusionframe.operators import evidence as E
from fusionframe.operators import intervals as I
from fusionframe.operators import proximity as P
from fusionframe.operators import scoring as S
from fusionframe.operators import transcripts as T
from fusionframe.plans import contigs, frames, records, sites  # noqa: F401  (they register their queries)
from fusionframe.plans.registry import ORACLES, QUERIES
from fusionframe.plans.registry import register as _register


def _points(spark, sf):
    return view(spark, sf, "fx_pairs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("st"), F.col("posa").alias("en"))


_A01 = """select chrom, case when side='+' then en else st end pos, side, count(*) reads, cast(sum(clip) as bigint) bases, count(*) filter (strand='+') plus_clip,
 count(*) filter (strand='-') minus_clip, cast(coalesce(sum(clip) filter (clip>=20),0) as bigint) long_bases from fx_reads where flag & 1024 = 0 group by 1,2,3"""
_DEPTH = """, a01 as (""" + _A01 + """), d as (select s.chrom, s.pos, count(r.st) depth, count(*) filter (r.strand='+') plus_depth, count(*) filter (r.strand='-') minus_depth
 from (select distinct chrom, pos from a01) s left join fx_reads r on r.chrom=s.chrom and r.st<=s.pos and r.en>=s.pos and r.flag & 4 = 0 group by 1,2)"""
_register("A01_clip_evidence", lambda s, d: E.clip_evidence(view(s, d, "fx_reads")), _A01)
_W01 = """, a01 as (""" + _A01 + """), w as (select *, sum(reads) over ar t_reads, sum(bases) over ar t_bases, sum(plus_clip) over ar t_plus, sum(minus_clip) over ar t_minus, sum(long_bases) over ar t_long,
 sum(bases) over ah cover, arg_max(pos, bases*1000000-pos) over ah centre from a01 window ar as (partition by chrom, side order by pos range between 5 preceding and 5 following),
 ah as (partition by chrom, side order by pos range between current row and 5 following)),
 c as (select w.chrom, w.side, w.pos p, w.centre, k.t_reads reads, k.t_bases bases, k.t_plus plus_clip, k.t_minus minus_clip from w join w k on k.chrom=w.chrom and k.side=w.side and k.pos=w.centre
 where w.cover>=2 and k.t_reads>=2 and k.t_long>=20),
 walk as (select chrom, side, min(p) p from c group by 1,2 union all
 select chrom, side, nxt from (select k.chrom, k.side, (select min(n.p) from c n where n.chrom=k.chrom and n.side=k.side and n.p>k.centre+5) nxt from walk join c k on k.chrom=walk.chrom and k.side=walk.side and k.p=walk.p) where nxt is not null)
 select c.chrom, c.side, c.centre pos, cast(c.reads as bigint) reads, cast(c.bases as bigint) bases, cast(c.plus_clip as bigint) plus_clip, cast(c.minus_clip as bigint) minus_clip from walk join c using (chrom, side, p)"""
_register("W01_cluster_positions", lambda s, d: E.cluster_positions(E.clip_evidence(view(s, d, "fx_reads"))), _W01)


def _sites(s, d):
    sites = E.clip_evidence(view(s, d, "fx_reads"))
    return sites.join(E.depth_at(view(s, d, "fx_reads"), sites), ["chrom", "pos"])


def _expressed_genes(s, d):
    genes = view(s, d, "fx_genes").withColumn("mrna_length", F.col("en") - F.col("st") + 1)
    counts = I.count_overlaps(genes, view(s, d, "fx_reads"), "gene_id")
    return E.gene_cutoff(genes.join(counts, "gene_id"), 100)


_register("A02_depth_at", lambda s, d: E.depth_at(view(s, d, "fx_reads"), E.clip_evidence(view(s, d, "fx_reads"))),
          _DEPTH + " select chrom, pos, depth, plus_depth, minus_depth from d")
_register("A03_depth_short", lambda s, d: E.depth_at(view(s, d, "fx_reads").withColumn("en", F.col("en") + F.col("clip") * 4), E.clip_evidence(view(s, d, "fx_reads")), 200),
          """, a01 as (""" + _A01 + """) select s.chrom, s.pos, count(r.st) depth, count(*) filter (r.strand='+') plus_depth, count(*) filter (r.strand='-') minus_depth from (select distinct chrom, pos from a01) s
 left join (select chrom, strand, flag, st, en+clip*4 en from fx_reads) r on r.chrom=s.chrom and r.st<=s.pos and r.en>=s.pos and r.flag & 4 = 0 and r.en-r.st+1<=200 group by 1,2""")
_GENES = """, n as (select g.gene_id, count(r.st) n_reads from fx_genes g left join fx_reads r on r.chrom=g.chrom and r.st<=g.en and r.en>=g.st and r.flag & 1028 = 0 group by 1),
 gi as (select g.*, n_reads, g.en-g.st+1 mrna_length, (80*n_reads)/(100*(g.en-g.st+1)) cutoff from fx_genes g join n on n.gene_id=g.gene_id)"""
_register("A04_gene_cutoff", lambda s, d: _expressed_genes(s, d).select("gene_id", "n_reads", F.round("cutoff", 6).alias("cutoff"), F.round("per_kb", 6).alias("per_kb")),
          _GENES + " select gene_id, n_reads, round(cast(cutoff as double),6) cutoff, round(1000*cast(n_reads as double)/mrna_length,6) per_kb from gi")
_register("F08_expressed_sites", lambda s, d: E.expressed_sites(_sites(s, d), _expressed_genes(s, d), 100, view(s, d, "fx_genes").where("gene_id % 50 = 0").select("name")).select(
    "chrom", "pos", "side", "reads", F.round("cutoff", 6).alias("cutoff"), "bases", "expression_ratio"),
    _DEPTH + _GENES + """, ex as (select distinct name from fx_genes where gene_id%50=0),
 h as (select a.*, gi.gene_id, gi.cutoff, gi.name in (select name from ex) or gi.cutoff<0.01 ends, (a.bases/80)/((gi.n_reads*100)/(2*gi.mrna_length)) ratio,
 greatest(a.plus_clip/(d.plus_depth+0.01), a.minus_clip/(d.minus_depth+0.01)) share from a01 a join d on d.chrom=a.chrom and d.pos=a.pos join gi on gi.chrom=a.chrom and gi.st<=a.pos and gi.en>=a.pos and gi.n_reads>0),
 f as (select chrom, pos, side, min(gene_id) gene_id from h where ends or ratio>0.01 or share>0.05 group by 1,2,3)
 select h.chrom, h.pos, h.side, h.reads, round(cast(h.cutoff as double),6) cutoff, h.bases, h.ratio expression_ratio from h join f on f.chrom=h.chrom and f.pos=h.pos and f.side=h.side and f.gene_id=h.gene_id where not h.ends
 union all select chrom, pos, side, reads, -1.0, bases, 0.0 from a01 a where reads>=5 and not exists (select 1 from h where h.chrom=a.chrom and h.pos=a.pos and h.side=a.side)""")
_register("F10_depth_gate", lambda s, d: E.depth_gate(_sites(s, d)).select("chrom", "pos", "side", "reads", "depth"),
          _DEPTH + """ select a.chrom, a.pos, a.side, a.reads, d.depth from a01 a join d on d.chrom=a.chrom and d.pos=a.pos where d.depth>0 and ((d.depth<2000 and a.reads>d.depth/200.0) or a.reads>d.depth/20.0)""")
_register("F07_min_support", lambda s, d: E.min_support(E.clip_evidence(view(s, d, "fx_reads")), 3, view(s, d, "fx_genes").where("gene_id % 2 = 0").select("chrom", F.col("st").alias("pos"))),
          ", a01 as (" + _A01 + ") select * from a01 where reads>=3 or exists (select 1 from fx_genes g where g.gene_id%2=0 and g.chrom=a01.chrom and g.st=a01.pos)")
_FRACTION = "round(least(1.0, case when plus_depth>0 or minus_depth>0 then greatest(case when plus_depth>0 then plus_clip/cast(plus_depth as double) else 0 end, case when minus_depth>0 then minus_clip/cast(minus_depth as double) else 0 end) else (reads+0.01)/(depth+1) end),6)"
_register("A15_allele_fraction", lambda s, d: _sites(s, d).select("chrom", "pos", "side", F.round(S.allele_fraction(F.col("plus_clip"), F.col("minus_clip"), F.col("plus_depth"), F.col("minus_depth"), (F.col("reads") + 0.01) / (F.col("depth") + 1)), 6).alias("maf")),
          _DEPTH + f" select a.chrom, a.pos, a.side, {_FRACTION} maf from a01 a join d on d.chrom=a.chrom and d.pos=a.pos")
_register("A16_total_reads", lambda s, d: _sites(s, d).select("chrom", "pos", "side", S.total_reads(F.col("plus_depth"), F.col("minus_depth"), F.col("depth"), F.col("reads")).alias("total")),
          _DEPTH + " select a.chrom, a.pos, a.side, greatest(case when plus_depth>0 and minus_depth>0 then plus_depth+minus_depth else depth end, reads) total from a01 a join d on d.chrom=a.chrom and d.pos=a.pos")
_register("J01_interval_join", lambda s, d: I.dense_join(view(s, d, "fx_reads").select("chrom", "st", "en"), view(s, d, "fx_genes").select("gene_id", "chrom", "st", "en")).select(
    "chrom", "st", "en", F.col("r_gene_id").alias("gene_id"),
    C.overlap_len(F.col("st"), F.col("en"), F.col("r_st"), F.col("r_en")).alias("shared")),
    """select r.chrom, r.st, r.en, g.gene_id, least(r.en,g.en)-greatest(r.st,g.st)+1 shared from fx_reads r join fx_genes g
 on r.chrom=g.chrom and r.st<=g.en and r.en>=g.st""")
_register("J02_count_overlaps", lambda s, d: I.count_overlaps(view(s, d, "fx_genes"), view(s, d, "fx_reads"), "gene_id"),
          """select g.gene_id, count(r.st) n_reads from fx_genes g left join fx_reads r
 on r.chrom=g.chrom and r.st<=g.en and r.en>=g.st and r.flag & 1028 = 0 group by 1""")
_register("J03_first_interval", lambda s, d: I.first_interval(_points(s, d), view(s, d, "fx_genes"), "ord", "gene_id"),
          """select ord, min(gene_id) gene_id from fx_pairs join fx_genes on chra=chrom and posa between st and en group by 1""")
_register("J05_tiered_overlap", lambda s, d: I.tiered_overlap(_points(s, d), view(s, d, "fx_genes"), "ord", "name"),
          """, h as (select ord, name, greatest(0, st-posa, posa-en) gap from fx_pairs join fx_genes on chra=chrom
 and st<=posa+10000 and en>=posa-10000), t as (select ord, name, case when gap<=0 then 0 when gap<=5000 then 5000 else 10000 end tier from h),
 b as (select ord, min(tier) tier from t group by 1)
 select b.ord, cast(b.tier as bigint) tier, string_agg(distinct t.name, ',' order by t.name) as names
 from b join t on b.ord=t.ord and b.tier=t.tier group by 1,2""")
_register("J08_pair_band_join", lambda s, d: I.pair_band_join(view(s, d, "fx_pairs"), view(s, d, "fx_pairs"), 10),
          """select distinct l.ord l_ord, r.ord r_ord from fx_pairs l join fx_pairs r on
 (l.chra=r.chra and l.chrb=r.chrb and abs(l.posa-r.posa)<10 and abs(l.posb-r.posb)<10)
 or (l.chra=r.chrb and l.chrb=r.chra and abs(l.posa-r.posb)<10 and abs(l.posb-r.posa)<10)""")
_MERGED = """, o as (select chrom, st, en, max(en) over (partition by chrom order by st, en rows between unbounded preceding and 1 preceding) reach from fx_genes),
 g as (select chrom, st, en, sum(case when reach is null or st>reach then 1 else 0 end) over (partition by chrom order by st, en rows unbounded preceding) grp from o),
 m as (select chrom, min(st) st, max(en) en from g group by chrom, grp)"""
_register("A18_merge_intervals", lambda s, d: I.merge_intervals(view(s, d, "fx_genes")),
          _MERGED + " select chrom, st, en from m")
_register("U03_subtract_intervals", lambda s, d: I.subtract_intervals(
    view(s, d, "fx_genes").groupBy("chrom").agg((F.max("en") + 500).alias("len")), view(s, d, "fx_genes")),
    _MERGED + """, p as (select chrom, coalesce(lag(en) over (partition by chrom order by st),0)+1 st, st-1 en from m
 union all select chrom, max(en)+1, max(en)+500 from m group by 1) select chrom, st, en from p where en>=st""")
_register("A12_junction_support", lambda s, d: E.junction_support(view(s, d, "fx_maps"), view(s, d, "fx_cuts"), "key"),
          """, l as (select c.key, m.read, case when c.ort>0 then tend-pos else pos-tstart end length from fx_cuts c join fx_maps m on m.contig=c.contig and m.matches>25 and cast(m.matches as double)/(m.qend-m.qstart)>0.95 and tend>pos+5 and tstart<pos-5)
 select c.key, (select count(distinct read) from l where l.key=c.key) reads, coalesce((select cast(sum(length) as bigint) from (select length from l where l.key=c.key qualify row_number() over (partition by length order by read)<=2) z), 0) support from fx_cuts c""")
_NAMES = """, na as (select ord, unnest(string_split(replace(genea,'|',','),',')) x from fx_svs), nb as (select ord, unnest(string_split(replace(geneb,'|',','),',')) y from fx_svs)"""
_register("A08_partner_recurrence", lambda s, d: E.partner_recurrence(view(s, d, "fx_svs"), 10, view(s, d, "fx_deny")),
          _NAMES + """, p as (select distinct least(x,y) x, greatest(x,y) y from na join nb on na.ord=nb.ord where x<>y), e as (select x gene from p union all select y from p)
 select gene, count(*) partners from e where gene not in (select name from fx_deny) group by 1 having count(*)>=10""")
_register("A09_contig_recurrence", lambda s, d: E.contig_recurrence(view(s, d, "fx_contig")),
          "select least(seq, translate(reverse(seq),'ACGT','TGCA')) seq, count(*) \"rows\" from fx_contig group by 1")
_register("A10_modal_position", lambda s, d: E.modal_position(view(s, d, "fx_reads"), ["chrom", "side"], "clip"),
          ", n as (select chrom, side, clip, count(*) n from fx_reads group by 1,2,3) select chrom, side, clip, n from n qualify row_number() over (partition by chrom, side order by n desc, clip)=1")
_register("A10_majority_strand", lambda s, d: E.majority_strand(view(s, d, "fx_reads"), ["chrom", "st"], "strand"),
          "select chrom, st, case when sum(case when strand='+' then 1 else -1 end)>0 then '+' when sum(case when strand='+' then 1 else -1 end)<0 then '-' else '=' end strand from fx_reads group by 1,2")
_register("A11_partner_counts", lambda s, d: S.partner_counts(view(s, d, "fx_known")),
          ", p as (select distinct least(genea,geneb) x, greatest(genea,geneb) y from fx_known), e as (select x gene from p union all select y from p) select gene, count(*) partners from e group by 1")
_register("W10_uniquify", lambda s, d: E.uniquify(view(s, d, "fx_genes"), "name", "gene_id"),
          """, k as (select gene_id, name, count(*) over (partition by name) n, row_number() over (partition by name order by gene_id)-1 i from fx_genes)
 select gene_id, case when n>1 then concat(name,'-loc',case when i>=26 then chr(cast(64+i//26 as int)) else '' end,chr(cast(65+i%26 as int))) else name end unique_name from k""")
_SAME = """, nm as (select ord, string_split(replace(genea,'|',','),',') a, string_split(replace(geneb,'|',','),',') b from fx_svs),
 pr as (select ord, i, j, a[i] x, b[j] y from nm, range(1,4) r(i), range(1,4) q(j) where i<=len(a) and j<=len(b)),
 ft as (select ord, arg_min(case when x='NA' then 0 else 1 end, i*10+j) v from pr where x=y group by 1), sg as (select s.ord, coalesce(v,0)=1 same from fx_svs s left join ft on ft.ord=s.ord)"""
_TYPE = """case when chra<>chrb then 'CTX' when same and qsa*qsb<0 then 'Internal_inv' when same and qsa*orta*(posa-posb-10)<0 then 'Internal_splicing' when same then 'Internal_dup'
 when qsa*qsb<0 then 'ITX' when qsa*orta*(posa-posb-10)<0 and abs(posa-posb)<100000 then 'read_through' when qsa*orta*(posa-posb-10)<0 then 'DEL' else 'INS' end"""
_register("C01_sv_type", lambda s, d: view(s, d, "fx_svs").select("ord", S.sv_type().alias("sv_type")), _SAME + f" select s.ord, {_TYPE} sv_type from fx_svs s join sg on sg.ord=s.ord")
_register("C02_same_gene", lambda s, d: view(s, d, "fx_svs").select("ord", C.same_gene(F.col("genea"), F.col("geneb")).alias("same")), _SAME + " select ord, same from sg")


def _rated(s, d):
    return S.rate(view(s, d, "fx_svs"), view(s, d, "fx_known"), view(s, d, "fx_itd"))


_KNOWN = _NAMES + """, pn as (select genea n from fx_known union select geneb from fx_known), kp as (select distinct na.ord from na join nb on na.ord=nb.ord join fx_known k on (k.genea=x and k.geneb=y) or (k.genea=y and k.geneb=x)),
 it as (select na.ord, bool_or(s.posa>=i.st and s.posa<=i.en and s.posb>=i.st and s.posb<=i.en) inside from na join fx_itd i on i.gene=na.x join fx_svs s on s.ord=na.ord group by 1),
 md as (select s.*, it.ord is not null has_itd, coalesce(it.inside,false) in_itd, s.ord in (select ord from na where x in (select n from pn)) ka, s.ord in (select ord from nb where y in (select n from pn)) kb, s.ord in (select ord from kp) kpair from fx_svs s left join it on it.ord=s.ord),
 mm as (select *, case when in_itd and type='Internal_dup' then 4 when kpair then 4 when ka and kb and type not like '%Internal%' then 3 when kb and sv_ort='>' then 2 when kb then 1 when ka then 1 else 0 end medal, frame in ('1','2') fr from md),
 sc as (select *, 0.5*(areaa*(case when mafa>0 and mafa<0.01 then exp(0.01/mafa) when mafa>0 then 1 else mafa end)*(case when matchb<50 then exp(0.5*(matchb-50)) else 1 end)*(1-repb)
 + areab*(case when mafb>0 and mafb<0.01 then exp(0.01/mafb) when mafb>0 then 1 else mafb end)*(case when matcha<50 then exp(0.5*(matcha-50)) else 1 end)*(1-repa))
 *(case when sv_ort='>' then 2 else 1 end)*(case when fr then 2 else 1 end)*(case when (not fr and type='DEL') or type='read_through' then cast(0.1 as double) else 1 end)*(case when not fr and type='Internal_dup' then cast(0.1 as double) else 1 end)
 *(case when not has_itd and type='Internal_dup' then cast(0.1 as double) else 1 end)*(case when chra=chrb and qsa<>qsb and abs(posa-posb)<40000 then cast(0.1 as double) else 1 end)*(case when chra=chrb and qsa<>qsb and abs(posa-posb)<10000 then cast(0.1 as double) else 1 end) score from mm),
 rt as (select *, case when medal=4 then 'HQ' when readsa+readsb<=2 or (repa>0.7 and repb>0.7) or (mafa<0.01 and mafb<0.01) or score<1 then 'bad' when type='read_through' then 'RT' else 'LQ' end rating from sc)"""
_register("C07_medal", lambda s, d: _rated(s, d).select("ord", F.col("medal").cast("int").alias("medal")), _KNOWN + " select ord, cast(medal as int) medal from rt")
_register("C08_score", lambda s, d: _rated(s, d).select("ord", F.round("score", 4).alias("score")), _KNOWN + " select ord, round(score,4) score from rt")
_register("C09_rating", lambda s, d: _rated(s, d).select("ord", "rating"), _KNOWN + " select ord, rating from rt")
_register("C10_effect", lambda s, d: view(s, d, "fx_svs").select("ord", S.effect().alias("effect")),
          """select ord, case when type='Internal_dup' then 'ITD' when frame='1' then 'Fusion' when frame='2' then 'upTSS' when featurea='coding' and featureb='coding' then 'Fusion' when featurea='coding' then 'CLoss' when featureb='coding' then 'NLoss' else 'other' end effect from fx_svs""")
_register("W08_rank_svs", lambda s, d: _rated(s, d).select("ord", "rating", F.round("score", 4).alias("score"), F.row_number().over(
    Window.partitionBy("rating").orderBy(F.desc(F.round("score", 4)), "ord")).cast("long").alias("place")),
    _KNOWN + " select ord, rating, round(score,4) score, row_number() over (partition by rating order by round(score,4) desc, ord) place from rt")
_register("W09_quota_rating", lambda s, d: S.quota_rating(_rated(s, d).withColumn("score", F.round("score", 4))).select("ord", "final_rating"),
          _KNOWN + """, kk as (select *, row_number() over (order by rating, round(score,4) desc, ord)-1 k from rt where rating in ('HQ','LQ'))
 select ord, case when rating='HQ' then 'HQ' when k<=10 and readsa>2 and readsb>2 then 'HQ' when (k<10 or readsa<=2 or readsb<=2) and fr then 'HQ' when medal>1 and fr then 'HQ' else 'LQ' end final_rating from kk
 union all select ord, 'RT' from rt where rating='RT'""")
_register("C06_orient", lambda s, d: S.orient(view(s, d, "fx_svs")).select("ord", "seq", "genea", "posa", "qsa", "orta", "qposa", "geneb", "posb", "qsb", "ortb", "qposb", "sv_ort"),
          """, t as (select *, case when scorea+scoreb<0 then -1 else 1 end f from fx_svs), u as (select ord, case when f<0 then translate(reverse(seq),'ACGT','TGCA') else seq end seq, genea, geneb, posa, posb, qsa*f qa, qsb*f qb, orta*f oa, ortb*f ob,
 case when f<0 then length(seq)-qposa+1 else qposa end pa, case when f<0 then length(seq)-qposb+1 else qposb end pb, case when scorea+scoreb=0 then '?' else '>' end sv_ort from t)
 select ord, seq, case when oa<0 then geneb else genea end genea, case when oa<0 then posb else posa end posa, case when oa<0 then qb else qa end qsa, case when oa<0 then ob else oa end orta, case when oa<0 then pb else pa end qposa,
 case when oa<0 then genea else geneb end geneb, case when oa<0 then posa else posb end posb, case when oa<0 then qa else qb end qsb, case when oa<0 then oa else ob end ortb, case when oa<0 then pa else pb end qposb, sv_ort from u""")
_register("F11_drop_genes", lambda s, d: E.drop_genes(view(s, d, "fx_svs"), view(s, d, "fx_deny")).select("ord"),
          _NAMES + " select ord from fx_svs where ord not in (select ord from na where x in (select name from fx_deny)) and ord not in (select ord from nb where y in (select name from fx_deny))")
_register("F12_drop_genes_unless_known", lambda s, d: E.drop_genes(view(s, d, "fx_svs"), view(s, d, "fx_deny"), view(s, d, "fx_known")).select("ord"),
          _NAMES + """, kp as (select distinct na.ord from na join nb on na.ord=nb.ord join fx_known k on (k.genea=x and k.geneb=y) or (k.genea=y and k.geneb=x))
 select ord from fx_svs where (ord not in (select ord from na where x in (select name from fx_deny)) and ord not in (select ord from nb where y in (select name from fx_deny))) or ord in (select ord from kp)""")
_register("F06_drop_chroms", lambda s, d: E.drop_chroms(view(s, d, "fx_svs"), ["CHR1$", "M"]).select("ord"), "select ord from fx_svs where chra<>'chr1' and chrb<>'chr1'")


def _complex(s, d):
    rows, regions = view(s, d, "fx_svs"), view(s, d, "fx_regions")
    for x in "ab":
        at = rows.select("ord", F.col(f"chr{x}").alias("chrom"), F.col(f"pos{x}").alias("st"), F.col(f"pos{x}").alias("en"))
        rows = rows.join(I.region_of(at, regions, "ord", "ord").withColumnRenamed("name", f"region{x}"), "ord", "left")
    kept = rows.where("regiona is null or regionb is null")
    return kept.select("ord", F.coalesce("regiona", "genea").alias("genea"), F.coalesce("regionb", "geneb").alias("geneb"))


_REGION = """, ra as (select s.ord, arg_min(r.name, r.ord) n from fx_svs s join fx_regions r on r.chrom=s.chra and s.posa>r.st and s.posa<r.en group by 1), rb as (select s.ord, arg_min(r.name, r.ord) n from fx_svs s join fx_regions r on r.chrom=s.chrb and s.posb>r.st and s.posb<r.en group by 1)"""
_register("F13_complex_regions", _complex, _REGION + " select s.ord, coalesce(ra.n, genea) genea, coalesce(rb.n, geneb) geneb from fx_svs s left join ra on ra.ord=s.ord left join rb on rb.ord=s.ord where ra.n is null or rb.n is null")
_register("J04_region_of", lambda s, d: I.region_of(view(s, d, "fx_svs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("st"), F.col("posa").alias("en")), view(s, d, "fx_regions"), "ord", "ord"),
          _REGION + " select ord, n as name from ra")
_register("F16_in_itd", lambda s, d: S.with_itd(view(s, d, "fx_svs"), view(s, d, "fx_itd")).select("ord", "has_itd", "in_itd"),
          _NAMES + """, it as (select na.ord, bool_or(s.posa>i.st and s.posa<i.en and s.posb>i.st and s.posb<i.en) v from na join fx_itd i on i.gene=na.x join fx_svs s on s.ord=na.ord group by 1)
 select s.ord, it.ord is not null has_itd, coalesce(v,false) in_itd from fx_svs s left join it on it.ord=s.ord""")
_register("F17_known_names", lambda s, d: S.with_pair(S.with_name(view(s, d, "fx_svs"), "genea", view(s, d, "fx_deny"), "any_name"), view(s, d, "fx_known"), "any_pair").select("ord", "any_name", "any_pair"),
          _NAMES + """ select ord, ord in (select ord from na where x in (select name from fx_deny)) any_name, ord in (select na.ord from na join nb on na.ord=nb.ord join fx_known k on (k.genea=x and k.geneb=y) or (k.genea=y and k.geneb=x)) any_pair from fx_svs""")
_register("F18_evidence_flags", lambda s, d: view(s, d, "fx_svs").select("ord", S.evidence_flags(F.col("seq").contains("AAAA")).cast("int").alias("flags")),
          """select ord, cast((case when contains(seq,'AAAA') then 2 else 0 end)+(case when gap>5 then 1 else 0 end)+(case when matcha<50 then 1 else 0 end)+(case when repa>0.9 then 1 else 0 end)+(case when percent<0.95 then 1 else 0 end) as int) flags from fx_svs""")
_register("J09_offset_lookup", lambda s, d: P.offset_lookup(view(s, d, "fx_svs").select("ord", F.concat(F.lit("chr"), (F.col("ord") % 22 + 1).cast("string")).alias("chrom"), F.when(F.col("orta") > 0, "+").otherwise("-").alias("side"), F.col("posa").alias("pos")),
                                                             E.clip_evidence(view(s, d, "fx_reads")).select("chrom", "side", "pos", "reads"), "ord"),
          ", a01 as (" + _A01 + """) select s.ord, cast(a.pos-s.posa as int) "offset", a.reads from fx_svs s join a01 a on a.chrom=concat('chr',cast(s.ord%22+1 as varchar)) and a.side=case when orta>0 then '+' else '-' end and abs(a.pos-s.posa)<=5
 qualify row_number() over (partition by s.ord order by a.pos<>s.posa, a.pos-s.posa)=1""")
_NEAR = "{k}.ca={r}.ca and {k}.cb={r}.cb and abs({k}.pa-{r}.pa)<10 and abs({k}.pb-{r}.pb)<10"
_TURNED = "k.ca=b.r.cb and k.cb=b.r.ca and abs(k.pa-b.r.pb)<10 and abs(k.pb-b.r.pa)<10"
#: The folds as an ordered walk over the rows of each pair of chroms, which carries the list of kept rows.
_WALK = """, b as (select least(chra,chrb) c1, greatest(chra,chrb) c2, struct_pack(o:=ord, ca:=chra, pa:=posa, cb:=chrb, pb:=posb, rs:=readsa+readsb, ms:=matcha+matchb) r, row_number() over (partition by least(chra,chrb), greatest(chra,chrb) order by ord) i from fx_svs),
 walk as (select c1, c2, i, [r] kept from b where i=1 union all select c1, c2, i, case when spot is null then list_append(kept, r) when {same} then kept
 else list_concat(list_append(kept[1:spot-1], struct_pack(o:=kept[spot].o, ca:=kept[spot].ca, pa:=kept[spot].pa, cb:=r.ca, pb:=r.pa, rs:=kept[spot].rs, ms:=kept[spot].ms)), kept[spot+1:]) end
 from (select b.c1, b.c2, b.i, b.r, walk.kept, list_position(list_transform(walk.kept, lambda k: {drops}), true) spot from walk join b on b.c1=walk.c1 and b.c2=walk.c2 and b.i=walk.i+1) z)
 select s.ord, k.ca chra, k.pa posa, k.cb chrb, k.pb posb, s.readsa, s.readsb, s.matcha, s.matchb from (select unnest(kept) k from (select kept from walk qualify i=max(i) over (partition by c1, c2)) z) u join fx_svs s on s.ord=k.o"""
_DIRECT = _NEAR.format(k="k", r="b.r")
for _mode, _key, _same, _drops in (("raw", "W02", _NEAR.format(k="kept[spot]", r="r"), f"({_DIRECT}) or ({_TURNED})"), ("annotated", "W03", "true", f"{_DIRECT} and (k.rs>=b.r.rs or k.ms>=b.r.ms)"),
                                   ("rank", "W04", "true", f"{_DIRECT} and k.rs>b.r.rs")):
    _register(f"{_key}_dedupe_{_mode}", lambda s, d, m=_mode: P.dedupe_pairs(view(s, d, "fx_svs"), m), _WALK.format(same=_same, drops=_drops))
_register("W05_merge_sites", lambda s, d: P.merge_sites(view(s, d, "fx_svs").select("chra", "posa", "orta", "readsa", "ord"), ["chra", "posa", "orta"], "readsa", "ord"),
          "select chra, posa, orta, arg_max(readsa, ord) readsa, max(ord) ord from fx_svs where readsa>0 group by 1,2,3")
_register("M07_merge_candidates", lambda s, d: P.merge_candidates(view(s, d, "fx_svs")).select("ord"),
          """, b as (select least(chra,chrb) c1, greatest(chra,chrb) c2, struct_pack(o:=ord, ca:=chra, pa:=posa, cb:=chrb, pb:=posb, w:=matcha*matchb) r, row_number() over (partition by least(chra,chrb), greatest(chra,chrb) order by ord) i from fx_svs),
 walk as (select c1, c2, i, [r] kept from b where i=1 union all select c1, c2, i, case when spot is null then list_append(kept, r) when r.w>kept[spot].w then list_concat(list_append(kept[1:spot-1], r), kept[spot+1:]) else kept end
 from (select b.c1, b.c2, b.i, b.r, walk.kept, list_position(list_transform(walk.kept, lambda k: (k.ca=b.r.ca and k.cb=b.r.cb and abs(k.pa-b.r.pa)<50 and abs(k.pb-b.r.pb)<50) or (k.ca=b.r.cb and k.cb=b.r.ca and abs(k.pa-b.r.pb)<50 and abs(k.pb-b.r.pa)<50)), true) spot
 from walk join b on b.c1=walk.c1 and b.c2=walk.c2 and b.i=walk.i+1) z)
 select unnest(list_transform(kept, lambda k: k.o)) ord from (select kept from walk qualify i=max(i) over (partition by c1, c2)) z""")
_register("W07_top_hits", lambda s, d: P.top_hits(view(s, d, "fx_svs").select("ord", (F.col("ord") % 900).alias("contig"), (F.col("matcha") + F.col("matchb")).alias("matches"), (90 + F.col("ord") % 900 % 40).alias("qlen"), (F.col("ord") % 900 % 150).alias("best")), 5, 100).select("ord", "contig", "matches"),
          """, c as (select ord, ord%900 contig, matcha+matchb matches, 90+ord%900%40 qlen, ord%900%150 best from fx_svs), n as (select *, count(*) over (partition by contig) n, row_number() over (partition by contig order by matches desc, ord) r from c),
 k as (select *, max(case when r=5 then matches end) over (partition by contig) least_m from n) select ord, contig, matches from k where not (n>=5 and qlen<105) and (n<=5 or matches>=least_m) and matches>=best qualify row_number() over (partition by contig order by ord)<=5""")
_register("W12_split_rows", lambda s, d: P.split_rows(view(s, d, "fx_svs").select("ord", "chra"), "ord", 100, "chra"),
          "select ord, chra, cast((row_number() over (partition by chra order by ord)-1)//100 as bigint) part from fx_svs")
_register("W14_drop_pcr_dups", lambda s, d: P.drop_pcr_dups(view(s, d, "fx_sam").select("chrom", "st", "mate_st", "clip", "qname"), ["chrom", "st", "mate_st", "clip"], "qname"),
          "select chrom, st, mate_st, clip, min(qname) qname from fx_sam group by 1,2,3,4")
_register("U04_distinct_pairs", lambda s, d: P.distinct_pairs(view(s, d, "fx_svs"), "genea", "geneb"), "select distinct least(genea,geneb) x, greatest(genea,geneb) y from fx_svs")
_register("U06_prune_nested", lambda s, d: P.prune_nested(view(s, d, "fx_genes").withColumn("st", F.col("st") - F.col("st") % 200), "gene_id", "name").select("gene_id"),
          """, g as (select gene_id, name, chrom, st-st%200 st, en from fx_genes) select gene_id from g l where not exists (select 1 from g r where r.name=l.name and r.gene_id<>l.gene_id and r.st<=l.st and r.en>=l.en
 and (r.st<l.st or r.en>l.en or r.gene_id<l.gene_id))""")
_register("S13_upsert", lambda s, d: P.upsert(view(s, d, "fx_svs").select("ord", "genea", "readsa"), view(s, d, "fx_svs").where("ord % 3 = 0").select((F.col("ord") * 2).alias("ord"), "genea", "readsa"), "ord", no_zero=True),
          """, n as (select ord*2 ord, genea, readsa from fx_svs where ord%3=0) select coalesce(n.ord, s.ord) ord, coalesce(n.genea, s.genea) genea, case when n.readsa<>0 then n.readsa else s.readsa end readsa
 from (select ord, genea, readsa from fx_svs) s full join n on n.ord=s.ord""")
_register("S01_scan_region", lambda s, d: view(s, d, "fx_reads").where("chrom = 'chr5' and st <= 60000 and en >= 20000").select("chrom", "st", "en", "clip"),
          "select chrom, st, en, clip from fx_reads where chrom='chr5' and st<=60000 and en>=20000")
_register("J24_query_intervals", lambda s, d: I.query_intervals(view(s, d, "fx_svs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("st"), F.col("posa").alias("en")), view(s, d, "fx_regions"), "ord", 20).select("ord"),
          "select distinct ord from fx_svs s where exists (select 1 from fx_regions r where r.chrom=s.chra and s.posa<=r.en+20 and s.posa>=r.st-20)")
_register("P05_explode_clips", lambda s, d: E.explode_clips(view(s, d, "fx_sam")),
          """select qname, chrom, '-' side, st pos, clip, strand from fx_sam where cigar like clip||'S%' and clip>=10 union all select qname, chrom, '-', st+204, clip+4, strand from fx_sam where cigar like clip||'S4M200N%' and clip>=10-3 and clip+4>=10
 union all select qname, chrom, '+', case when cigar like '60M300N3M%' then st+362 else st+99-clip end, clip, strand from fx_sam where cigar like '%M'||clip||'S' and clip>=10
 union all select qname, chrom, '+', st+59, clip+3, strand from fx_sam where cigar like '60M300N3M%S' and clip>=10-3 and clip+3>=10""")
_register("F01_eligible_clips", lambda s, d: E.eligible_clips(view(s, d, "fx_sam")).select("qname"), "select qname from fx_sam where contains(cigar,'S') and flag & 1024 = 0 and mate_st>0")
_register("P03_cigar", lambda s, d: view(s, d, "fx_sam").select("qname", F.size(C.cigar_ops(F.col("cigar"))).alias("n_ops"), C.ref_span(F.col("cigar")).alias("span"), C.clip_len(F.col("cigar"), "-").alias("left_clip"), C.clip_len(F.col("cigar"), "+").alias("right_clip")),
          """select qname, cast(len(regexp_extract_all(cigar,'[A-Z]')) as int) n_ops, cast(list_sum(list_transform(regexp_extract_all(cigar,'([0-9]+)[MDN]',1), lambda x: cast(x as bigint))) as bigint) span,
 coalesce(try_cast(regexp_extract(cigar,'^([0-9]+)S',1) as int),0) left_clip, coalesce(try_cast(regexp_extract(cigar,'([0-9]+)S$',1) as int),0) right_clip from fx_sam""")
_register("P07_high_quality", lambda s, d: view(s, d, "fx_sam").select("qname", C.is_high_quality(F.col("qual")).alias("good")), "select qname, length(regexp_replace(qual,'[0-4]','','g'))*100>(length(qual)-1)*80 good from fx_sam")
_register("F21_del_reads", lambda s, d: E.del_reads(view(s, d, "fx_sam").withColumn("en", F.col("st") + 99), F.lit(30_000), 200).select("qname"), "select qname from fx_sam where st<=30000 and st+99>=30000 and contains(cigar,'M200N')")
_register("P02_revcomp_iupac", lambda s, d: view(s, d, "fx_contig").select("doc_id", C.revcomp_iupac(F.replace("seq", F.lit("AC"), F.lit("rY"))).alias("rc")),
          "select doc_id, translate(reverse(replace(seq,'AC','rY')),'ACGTRYKMBVDHacgtrykmbvdh','TGCAYRMKVBHDtgcayrmkvbhd') rc from fx_contig")
_register("P06_garbage", lambda s, d: view(s, d, "fx_contig").select("doc_id", C.is_garbage(F.replace("seq", F.lit("A"), F.lit("N"))).alias("bad")),
          "select doc_id, regexp_matches(replace(seq,'A','N'),'N{5,}') or length(regexp_replace(seq,'[^A]','','g'))>length(seq)*0.3 bad from fx_contig")
_register("P08_low_complexity", lambda s, d: view(s, d, "fx_contig").select("doc_id", C.low_complexity_clip(F.col("seq")).alias("clip_form"), C.low_complexity_junction(F.col("seq")).alias("junction_form")))
_register("P10_norm_chrom", lambda s, d: view(s, d, "fx_svs").select("ord", C.norm_chrom_like(F.col("chra"), F.when(F.col("ord") % 2 == 0, "chr1").otherwise("1")).alias("name")),
          "select ord, case when ord%2=0 then chra else substr(chra,4) end as name from fx_svs")
_register("P11_cook_chrom", lambda s, d: view(s, d, "fx_pairs").select("ord", C.cook_chrom(F.concat(F.lit("chr"), (F.col("ord") % 26).cast("string"))).alias("name")),
          "select ord, case ord%26 when 23 then 'X' when 24 then 'Y' when 25 then 'MT' else cast(ord%26 as varchar) end as name from fx_pairs")
_register("P13_name_conflicts", lambda s, d: P.name_conflicts(view(s, d, "fx_pairs").select("chra"), view(s, d, "fx_pairs").select(F.expr("substr(chrb, 4)")), C.cook_chrom),
          """, b as (select chra raw from fx_pairs union select substr(chrb,4) from fx_pairs) select replace(raw,'chr','') as name, string_agg(raw,',' order by raw) spellings from b group by 1 having count(*)>1""")
_register("P14_parse_range", lambda s, d: view(s, d, "fx_genes").select("gene_id", *C.parse_range(F.concat("chrom", F.lit(":"), F.col("st").cast("string"), F.when(F.col("gene_id") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.col("en").cast("string")))))),
          "select gene_id, chrom, st, case when gene_id%3=0 then null else en end en from fx_genes")
_register("P15_parse_junction", lambda s, d: view(s, d, "fx_svs").select("ord", *C.parse_junction(F.concat("chra", F.lit(":"), F.col("posa").cast("string"), F.lit(":+,"), "chrb", F.lit(":"), F.col("posb").cast("string"), F.lit(":-")))),
          "select ord, chra, posa, '+' stranda, chrb, posb, '-' strandb from fx_svs")
_register("P17_derive_bp", lambda s, d: view(s, d, "fx_svs").select("ord", *C.derive_bp(F.col("orta"), F.col("qsa"), F.col("posa"), F.col("posa") + 50, F.col("qposa"), F.col("qposa") + 40)),
          "select ord, case when qsa*orta>0 then posa+50 else posa end tpos, case when orta>0 then qposa+40 else qposa end qpos, qsa*orta clip from fx_svs")
_register("P18_dbinom", lambda s, d: view(s, d, "fx_svs").select("ord", F.round(C.dbinom(F.col("readsa") + 8, F.col("readsa"), 0.25), 9).alias("density")),
          "select ord, round(exp(lgamma(readsa+9)-lgamma(readsa+1)-lgamma(9)+readsa*ln(0.25)+8*ln(0.75)),9) density from fx_svs")
_register("P20_split_names", lambda s, d: view(s, d, "fx_svs").select("ord", F.explode(C.split_names(F.col("geneb"))).alias("name")), _NAMES + " select ord, y as name from nb")
_register("P23_junction_window", lambda s, d: view(s, d, "fx_contig").select("doc_id", C.junction_window(F.col("seq"), F.col("doc_id") % 128).alias("window")),
          "select doc_id, case when doc_id%128>30 and doc_id%128<length(seq)-30 then substr(seq,doc_id%128-29,60) end \"window\" from fx_contig")
_register("P24_annot_field", lambda s, d: view(s, d, "fx_svs").select("ord", C.annot_field([F.col("type"), C.tagged("gene", F.col("genea")), F.when(F.col("ord") % 2 == 0, F.col("type"))]).alias("field")),
          "select ord, concat(type,';gene=',genea) field from fx_svs")
_register("P26_float_trim", lambda s, d: view(s, d, "fx_svs").select("ord", C.float_trim(F.format_string("%.3f", "mafa")).alias("text")),
          "select ord, case when mafa=0 then '0' else rtrim(ltrim(printf('%.3f',mafa),'0'),'0') end \"text\" from fx_svs")
_register("P28_format_duration", lambda s, d: view(s, d, "fx_svs").select("ord", C.format_duration(F.col("posb")).alias("text")),
          """select ord, trim(concat(case when posb//86400>0 then concat(posb//86400,'d ') else '' end, case when posb%86400//3600>0 then concat(posb%86400//3600,'h ') else '' end,
 case when posb%3600//60>0 then concat(posb%3600//60,'m ') else '' end, case when posb%60>0 then concat(posb%60,'s') else '' end)) \"text\" from fx_svs""")
_TX = """, ex as (select tx, gene, chrom, strand, cds_st, cds_en, st, e1 en, 1 i from fx_tx union all select tx, gene, chrom, strand, cds_st, cds_en, s2, e2, 2 from fx_tx union all select tx, gene, chrom, strand, cds_st, cds_en, s3, en, 3 from fx_tx),
 en as (select *, case when strand='+' then i else 4-i end number from ex)"""
_FEATURE = "case when {p}<t.st or {p}>t.en then 'intergenic' when not (({p}>t.st and {p}<t.e1) or ({p}>t.s2 and {p}<t.e2) or ({p}>t.s3 and {p}<t.en)) then 'intron' when {p}<=t.cds_st then case when t.strand='+' then '5utr' else '3utr' end when {p}>t.cds_en then case when t.strand='+' then '3utr' else '5utr' end else 'coding' end"
_FS = "case {f} when 'coding' then 1.0 when '5utr' then 0.8 when '3utr' then 0.8 when 'intron' then 0.5 else 0.1 end"
_register("C04_gene_feature", lambda s, d: T.gene_features(_points(s, d), transcripts(s, d), "ord"),
          ", h as (select ord, t.gene, " + _FEATURE.format(p="posa") + " f from fx_pairs join fx_tx t on t.chrom=chra and posa between t.st and t.en) select ord, gene, arg_max(f, concat(cast(" + _FS.format(f="f") + " as varchar),f)) feature from h group by 1,2")
_register("A06_gene_lengths", lambda s, d: T.gene_lengths(transcripts(s, d)),
          _TX + ", l as (select tx, gene, cast(sum(en-st+1) as bigint) m, cast(sum(greatest(0,least(en,cds_en)-greatest(st,cds_st)+1)) as bigint) c from ex group by 1,2) select gene, max(m) mrna_length, max(c) cds_length from l group by 1")
_register("A17_gene_interval", lambda s, d: T.gene_interval(transcripts(s, d), 100, 500),
          "select gene, chrom, strand, greatest(1, min(st)-100-case when strand='+' then 500 else 0 end) st, max(en)+100+case when strand='-' then 500 else 0 end en from fx_tx group by 1,2,3")
_BASES = _TX + """, bf as (select tx, unnest(range(st,en+1)) pos, strand, cds_st, cds_en, number from en), f as (select tx, pos, case when pos<cds_st then case when strand='+' then '5utr' else '3utr' end when pos>cds_en then case when strand='+' then '3utr' else '5utr' end else 'coding' end feature, number from bf
 union all select tx, unnest(range(e1+1,s2)), 'intron', case when strand='+' then 1 else 2 end from fx_tx union all select tx, unnest(range(e2+1,s3)), 'intron', case when strand='+' then 2 else 1 end from fx_tx)"""
_register("W16_base_features", lambda s, d: T.base_features(transcripts(s, d)), _BASES + " select tx, pos, feature, cast(number as int) number from f")
_register("A19_feature_summary", lambda s, d: T.feature_summary(transcripts(s, d)), _BASES + " select tx, feature, cast(number as int) number, min(pos) st, max(pos) en from f group by 1,2,3")
_CODON = _BASES + """, o as (select *, row_number() over (partition by tx order by case when strand='+' then pos else -pos end) n, count(*) filter (case when strand='+' then pos<cds_st else pos>cds_en end) over (partition by tx) u from bf)"""
_register("W15_codon_map", lambda s, d: T.codon_map(transcripts(s, d)),
          _CODON + " select tx, pos, cast(number as int) exon, case when n>u then n-u else n-u-1 end coding_base, case when n>u then (n-u-1)//3+1 else cast(floor((n-u-1)/3.0) as bigint) end codon, cast((((n-u-1)%3)+3)%3+1 as bigint) codon_base from o")
_register("J16_transcripts_at", lambda s, d: T.transcripts_at(_points(s, d), transcripts(s, d), "ord"), "select ord, tx, gene from fx_pairs join fx_tx t on t.chrom=chra and posa between t.st and t.en")


def _in_tx(s, d):
    """(chrom, pos) of the different points with the transcripts over each, and the points of each place."""
    points, tx = _points(s, d), transcripts(s, d).where("cds_st < cds_en")
    hits = I.interval_join(points.select("chrom", "st", "en").distinct(), tx, width=500, dealt=True)
    rows = hits.select(F.struct("chrom", "st").alias("place"), F.col("st").alias("pos"), F.col("r_tx").alias("tx"), F.col("r_strand").alias("strand"), F.col("r_exons").alias("exons"))
    return rows, points.select("ord", F.struct("chrom", "st").alias("place"))


def _seek_base(s, d):
    hits, points = _in_tx(s, d)
    return I.listed_join(points, T.seek_base(hits, "place", True), ["place"]).select(F.concat_ws("_", F.col("ord").cast("string"), F.col("tx").cast("string")).alias("ord"), "tx", "pos", "distance")


def _exon_of(s, d):
    hits, points = _in_tx(s, d)
    return I.listed_join(points, T.nearest_exon(hits, "place"), ["place"]).drop("place")


_register("J18_seek_base", _seek_base,
          _TX + """, h as (select concat(ord,'_',t.tx) ord, t.tx, t.strand, posa from fx_pairs join fx_tx t on t.chrom=chra and posa between t.st and t.en), b as (select tx, unnest(range(st,en+1)) pos from ex),
 q as (select h.ord, h.tx, b.pos, (b.pos-posa)*case when strand='+' then 1 else -1 end step from h join b on b.tx=h.tx) select ord, tx, arg_min(pos, step) pos, min(step) distance from q where step between 0 and 1000 group by 1,2""")
_register("J20_exon_of", _exon_of,
          _TX + """, h as (select ord, n.tx, n.number, n.st, greatest(0, n.st-posa, posa-n.en) g from fx_pairs join fx_tx t on t.chrom=chra and posa between t.st and t.en join en n on n.tx=t.tx)
 select ord, tx, cast(arg_min(number, g*1000000+st) as bigint) exon, count(*) exons, min(g) distance from h group by 1,2""")
_register("J25_neighbor_exons", lambda s, d: T.neighbor_exons(_points(s, d), transcripts(s, d), "ord"),
          """, i as (select tx, chrom, strand, e1+1 st, s2-1 en, case when strand='+' then 1 else 2 end number from fx_tx union all select tx, chrom, strand, e2+1, s3-1, case when strand='+' then 2 else 1 end from fx_tx)
 select ord, tx, cast(number as bigint) intron, case when strand='+' then posa-st+1 else en-posa+1 end to_previous, case when strand='+' then en-posa+1 else posa-st+1 end to_next from fx_pairs join i on i.chrom=chra and posa between st and en""")
_register("J06_annotate_site", lambda s, d: T.annotate_site(view(s, d, "fx_pairs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("pos"), F.col("orta").alias("qs"), F.col("ortb").alias("ort")), transcripts(s, d), "ord"),
          """, h as (select ord, t.gene, t.tx, t.strand<>case when orta>0 then '+' else '-' end other, least(abs(t.st-posa),abs(t.en-posa)) edge, greatest(0,t.st-posa,posa-t.en) g, """
          + _FEATURE.format(p="(posa+case when (ortb>0)=(orta>0) then -10 else 10 end)") + """ f from fx_pairs join fx_tx t on t.chrom=chra and t.st<=posa+40000 and t.en>=posa-40000),
 k as (select *, """ + _FS.format(f="f") + """ sc, case when g<=10 then 1 when g<=5000 then 2 when g<=10000 then 3 else 4 end tier from h where f<>'intergenic' or edge<40000),
 b as (select * from k qualify row_number() over (partition by ord order by sc desc, case when f='intergenic' then edge else 0 end, tier, other, tx)=1)
 select p.ord, coalesce(b.gene,'NA') gene, coalesce(b.f,'intergenic') feature, coalesce(cast(b.sc as double)*case when other then -1 else 1 end, 0.0) score from fx_pairs p left join b on b.ord=p.ord""")
_register("J23_genes_between", lambda s, d: T.genes_between(view(s, d, "fx_svs"), transcripts(s, d).select(F.col("tx").alias("gene"), "chrom", "strand", "st", "en", (F.col("en") - F.col("st")).alias("cds_length"))),
          """, p as (select ord, chra chrom, least(posa,posb) s, greatest(posa,posb) e from fx_svs where chra=chrb), h as (select p.*, t.tx, t.strand, t.st, t.en, t.st<=s+10000 and t.en>=e-10000 span from p join fx_tx t on t.chrom=p.chrom and t.st<=e and t.en>=s),
 n as (select ord, bool_or(span) span, count(*) filter (st>s and en<e and en-st>300 and not exists (select 1 from h y where y.ord=h.ord and y.tx<>h.tx and y.strand=h.strand and y.st<h.st and y.en>h.en)) n from h group by 1)
 select p.ord, coalesce(case when span then 0 else n end,0) genes from p left join n on n.ord=p.ord""")
_register("R01_three_frames", lambda s, d: view(s, d, "fx_contig").select("doc_id", *T.three_frames(F.col("seq"))),
          ", ".join(["", *["f%d as (select doc_id, list_aggregate(list_transform(range(%d, length(seq)-1, 3), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', cast((instr('TCAG',substr(seq,i,1))-1)*16+(instr('TCAG',substr(seq,i+1,1))-1)*4+instr('TCAG',substr(seq,i+2,1)) as int), 1)),'string_agg','') frame%d from fx_contig)" % (k, k + 1, k) for k in range(3)]])
          + " select f0.doc_id, frame0, frame1, frame2 from f0 join f1 on f1.doc_id=f0.doc_id join f2 on f2.doc_id=f0.doc_id")
_register("R04_unique_anchor", lambda s, d: view(s, d, "fx_contig").select("doc_id", T.unique_anchor(F.col("seq"), F.substring("seq", 50, 20), 3).alias("place")),
          """, k as (select doc_id, seq, substr(seq,50,20) w from fx_contig), l as (select doc_id, n, instr(seq,substr(w,1,n)) a, substr(seq, instr(seq,substr(w,1,n))+1) rest, substr(w,1,n) part from k, range(3,21) r(n))
 select doc_id, cast(coalesce(arg_min(a,n) filter (a>0 and instr(rest,part)=0),0) as int) place from l group by 1""")
_register("R07_coding_frame", lambda s, d: view(s, d, "fx_contig").select("doc_id", T.coding_frame(F.substring(T.translate(F.col("seq")), 1, 20), F.substring(T.translate(F.col("seq")), 21, 30)).alias("usable")),
          """, f as (select doc_id, substr(list_aggregate(list_transform(range(1, length(seq)-1, 3), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', cast((instr('TCAG',substr(seq,i,1))-1)*16+(instr('TCAG',substr(seq,i+1,1))-1)*4+instr('TCAG',substr(seq,i+2,1)) as int), 1)),'string_agg',''),1,50) aa from fx_contig)
 select doc_id, coalesce(bool_or(substr(aa,i,1)='M' and length(regexp_extract(substr(aa,i),'^M[^*]*'))>=11 and i+length(regexp_extract(substr(aa,i),'^M[^*]*'))-1>=20), false) usable from f, range(1,51) r(i) group by 1""")
_register("R08_prune_pairs", lambda s, d: T.prune_pairs(view(s, d, "fx_svs").select("ord", "genea", F.col("frame").cast("int").alias("frame")), "genea", "frame"),
          ", q as (select ord, genea, cast(frame as int) frame from fx_svs) select ord, genea, frame from q where frame>0 or genea not in (select genea from q where frame>0)")
_register("R10_frame_summary", lambda s, d: T.frame_summary(view(s, d, "fx_svs").select("chra", F.col("genea").alias("gene"), F.col("frame").cast("int").alias("frame")), "chra"),
          """, q as (select chra, genea gene, cast(frame as int) frame from fx_svs) select chra, cast(max(case when frame>0 then 1 else 0 end) as bigint) in_frame, string_agg(distinct cast(frame as varchar), ',' order by cast(frame as varchar)) frames,
 case when count(distinct case when frame>0 then gene end)=1 then max(case when frame>0 then gene end) end gene from q group by 1""")
_register("R02_mask_frame", lambda s, d: view(s, d, "fx_contig").select("doc_id", T.mask_frame(F.col("seq"), F.col("doc_id").cast("int") % 150).alias("masked")),
          "select doc_id, concat(repeat('X', cast(least(doc_id%150,length(seq)) as int)), substr(seq, doc_id%150+1)) masked from fx_contig")
_register("P01_revcomp", lambda s, d: view(s, d, "fx_contig").select("doc_id", C.revcomp(F.col("seq")).alias("rc"), C.canonical_seq(F.col("seq")).alias("canonical")),
          "select doc_id, translate(reverse(seq),'ACGT','TGCA') rc, least(seq, translate(reverse(seq),'ACGT','TGCA')) canonical from fx_contig")
_register("P21_pair_key", lambda s, d: view(s, d, "fx_pairs").select("ord", C.pair_key(F.col("chra"), F.col("chrb")).alias("key"), C.sign_code(F.col("orta")).alias("sign")),
          "select ord, concat(least(chra,chrb),':',greatest(chra,chrb)) \"key\", case when orta<0 then '-' when orta>0 then '+' else '=' end sign from fx_pairs")
