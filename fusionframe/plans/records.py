"""Registered queries on reads at sites, records, contig hits and reports, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusionframe.fixtures import transcripts, view
from fusionframe.operators import intervals as I
from fusionframe.operators import reads as G
from fusionframe.operators import records as R
from fusionframe.operators import transcripts as T
from fusionframe.plans.registry import register

_READ = ("qname", "st", "flag", "cigar")
_WINDOWS = """, wa as (select name, chrom, st, en from fx_regions), wb as (select name, chrom, st+150 st, en+600 en from fx_regions)"""


def _windows(s, d):
    w = view(s, d, "fx_regions").select("name", "chrom", "st", "en")
    return w, w.select("name", "chrom", (F.col("st") + 150).alias("st"), (F.col("en") + 600).alias("en"))


register("J10_pair_reads", lambda s, d: G.pair_reads(view(s, d, "fx_mates"), *_windows(s, d), "name").select("name", "side", *_READ),
         _WINDOWS + """, u as (select * from fx_mates where flag & 1 = 1 and flag & 1036 = 0), a as (select w.name, 'a' side, u.* from u join wa w on u.chrom=w.chrom and u.st>=w.st and u.en<=w.en),
 b as (select w.name, 'b' side, u.* from u join wb w on u.chrom=w.chrom and u.st>=w.st and u.en<=w.en)
 select name, side, qname, st, flag, cigar from a where exists (select 1 from b where b.name=a.name and b.qname=a.qname) union all select name, side, qname, st, flag, cigar from b where exists (select 1 from a where a.name=b.name and a.qname=b.qname)""")
register("J11_mates_of", lambda s, d: G.mates_of(_windows(s, d)[0].join(view(s, d, "fx_mates").where("flag % 4 = 1").drop("st", "en"), "chrom").select("name", "qname", "flag"), view(s, d, "fx_mates"), _windows(s, d)[1], "name").select("name", *_READ),
         _WINDOWS + """, g as (select wa.name, qname, max(case when flag & 64 > 0 then 1 else 2 end) e from wa join fx_mates m on m.chrom=wa.chrom where flag%4=1 group by 1,2),
 w as (select name, chrom, st-case when en-st<=100 then 100 else 0 end st, en+case when en-st<=100 then 100 else 0 end en from wb)
 select w.name, m.qname, m.st, m.flag, m.cigar from fx_mates m join w on m.chrom=w.chrom and m.st<=w.en and m.en>=w.st join g on g.name=w.name and g.qname=m.qname
 where flag & 1 = 1 and flag & 4 = 0 and not regexp_matches(seq,'N{5,}') and length(regexp_replace(seq,'[^N]','','g'))<=length(seq)*0.3 and e<>case when flag & 64 > 0 then 1 else 2 end""")
register("J12_unmapped_mates", lambda s, d: G.unmapped_mates(view(s, d, "fx_mates"), view(s, d, "fx_regions").select("name", "chrom", F.expr("case when ord % 2 = 0 then 1 else -1 end strand"), "st", (F.col("en") + F.expr("ord % 3 * 600 - 450")).alias("en")).where("st < en"), "name").select("name", "qname", "mate_st", "flag"),
         """, w0 as (select name, chrom, case when ord%2=0 then 1 else -1 end strand, st, en+ord%3*600-450 en from fx_regions where st<en+ord%3*600-450), w as (select name, chrom, strand, st-case when en-st<=100 then 100 else 0 end st, en+case when en-st<=100 then 100 else 0 end en from w0)
 select name, qname, mate_st, flag from fx_mates m join w on m.chrom=w.chrom and mate_st between w.st and w.en and (w.en-w.st<=800 or mate_st<=w.st+400 or mate_st>=w.en-400) and strand=case when flag & 32 > 0 then -1 else 1 end
 where flag & 5 = 5 and flag & 1032 = 0 and length(regexp_replace(qual,'[!-4]','','g'))*100>(length(qual)-1)*80 and not regexp_matches(seq,'N{5,}') and length(regexp_replace(seq,'[^N]','','g'))<=length(seq)*0.3""")
register("J13_junction_reads", lambda s, d: G.junction_reads(view(s, d, "fx_mates"), view(s, d, "fx_svs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("pos"), F.col("orta").alias("clip"), (F.col("ord") % 40 + 180).alias("gap")), "ord").select("ord", *_READ),
         """select ord, qname, m.st, flag, cigar from fx_mates m join fx_svs s on s.chra=m.chrom and m.st<=posa+15 and m.en>=posa-15 where flag & 1 = 1 and flag & 1036 = 0 and contains(cigar,'N') and m1>10 and m2>10 and abs(m.gap-(ord%40+180))<10
 and case when orta>0 then abs(m.st+m1-posa)<15 else abs(m.st+m1+m.gap-posa)<15 end""")
register("F02_clip_quality", lambda s, d: view(s, d, "fx_sam").select("qname", G.clip_quality_ok(F.col("qual"), F.least("clip", F.lit(32)), "-").alias("ok_left"), G.clip_quality_ok(F.col("qual"), F.least("clip", F.lit(32)), "+").alias("ok_right")),
         "select qname, length(regexp_replace(substr(qual,1,least(clip,32)),'[0-4]','','g'))*100>(least(clip,32)-1)*80 ok_left, length(regexp_replace(substr(qual,33-least(clip,32)),'[0-4]','','g'))*100>(least(clip,32)-1)*80 ok_right from fx_sam")
register("F03_align_ok", lambda s, d: view(s, d, "fx_mates").select("qname", "st", G.align_ok(F.col("seq"), F.translate("seq", "GN", "A-"), F.translate(F.replace("qual", F.lit("5I"), F.lit("++")), "5", "+")).alias("ok")),
         """, l as (select qname, st, seq, replace(replace(qual,'5I','++'),'5','+') ql from fx_mates), p as (select qname, st, seq, ql, list_filter(range(1,length(seq)+1), lambda i: substr(seq,i,1)<>'N' and substr(ql, i-(length(substr(seq,1,i))-length(replace(substr(seq,1,i),'N',''))), 1)='I') k from l)
 select qname, st, case when len(k)<20 then len(list_filter(k, lambda i: substr(seq,i,1)='G'))<=1 else len(list_filter(k, lambda i: substr(seq,i,1)<>'G'))*100>=len(k)*80 end ok from p""")
register("P29_parse_sample", lambda s, d: view(s, d, "fx_samples").select("ord", *R.parse_sample(F.col("name"))),
         """, p as (select ord, name, regexp_extract(name,'^SJ(ALL)([0-9]{3})_([A-Z])(-.+)?$',['a','b','c']) v1, regexp_extract(name,'^SJ(AML)([0-9]{6})_([ADGOR])([1-9])$',['a','b','c','i']) v2 from fx_samples)
 select ord, case when v1.c not in ('','O') then concat('SJ',v1.a,v1.b) when v2.c<>'' then concat('SJ',v2.b) end subject, case when v1.c not in ('','O') then v1.a when v2.c<>'' then v2.a end disease,
 case when v1.c not in ('','O') then translate(v1.c,'BEHISTZ','ADGGRRX') when v2.c<>'' then v2.c end "type", case when v1.c in ('A','D','G','X') then 1 when v1.c in ('B','E','H','S') then 2 when v1.c in ('I','T','Z') then 3 when v2.c<>'' then try_cast(v2.i as int) end "index" from p""")
register("P30_tumor_normal", lambda s, d: view(s, d, "fx_samples").select("ord", R.tumor_normal(F.col("name")).alias("tn")),
         """, p as (select ord, case when ord%5=0 then regexp_extract(name,'_([A-Z])',1) when ord%5=1 then regexp_extract(name,'_([A-Z])',1) when ord%5=2 then regexp_extract(name,'_([A-Z]).bam',1) when ord%5=3 then regexp_extract(name,'Bin([A-Z])',1) end k, ord%5=0 v1, name from fx_samples)
 select ord, case when v1 and k='B' then 'T' when k in ('G','H','I') then 'N' when k in ('A','C','D','E','F','M','O','R','S','T','X','Y','Z') then 'T' end tn from p""")
register("W20_protein_versions", lambda s, d: R.protein_versions(view(s, d, "fx_prot")),
         """, n as (select accession, protein, max(version) version from fx_prot group by 1,2), l as (select *, first_value(protein) over w top, row_number() over w rn from n window w as (partition by accession order by version desc, protein)),
 m as (select *, case when length(protein)=length(top) then len(list_filter(range(1,length(protein)+1), lambda i: substr(protein,i,1)<>substr(top,i,1)))/length(protein) end share from l)
 select accession, version, protein, case when rn=1 then 'latest' when share is null then 'length change' else printf('%s difference (%.3f)', case when share>=0.04 then 'major' else 'minor' end, share) end note from m""")
register("W21_older_versions", lambda s, d: R.older_versions(view(s, d, "fx_prot")),
         "select concat(accession,'.',cast(unnest(range(1,version)) as varchar)) id from fx_prot where accession like 'NM%'")


def _latest(s, d):
    return R.protein_versions(view(s, d, "fx_prot")).where("note = 'latest'").select("accession", "protein", F.concat(F.lit("g"), "accession").alias("gene"))


register("J15_protein_of", lambda s, d: R.protein_of(view(s, d, "fx_svs").select("ord", F.expr("concat('NM_', cast(ord % 310 as string), case when ord % 3 = 0 then '-locA-1' else '' end) acc")), _latest(s, d), "acc"),
         """, t as (select accession, arg_max(protein, version) protein from fx_prot group by 1), q as (select ord, concat('NM_',cast(ord%310 as varchar)) base, concat('NM_',cast(ord%310 as varchar),case when ord%3=0 then '-locA-1' else '' end) acc from fx_svs)
 select ord, acc, t.protein, case when ord%3<>0 then 'g'||t.accession end gene from q left join t on t.accession=q.base""")
register("C12_aa_status", lambda s, d: view(s, d, "fx_prot").select("accession", "version", R.aa_status(F.expr("case when version = 7 then '' else md5(substr(accession, 4)) end"), F.col("protein"), F.col("version") % 2).alias("status")),
         """, q as (select accession, version, case when version=7 then '' else md5(substr(accession,4)) end k, protein from fx_prot) select accession, version, case when k='' then -1 when k=protein then 1 when length(k)=length(protein) then
 case when len(list_filter(range(1,length(k)+1), lambda i: substr(k,i,1)<>substr(protein,i,1)))/length(k)>=0.04 then -3 else -2 end when contains(k,protein) then 2 when version%2=1 then -4 else -5 end status from q""")
register("A20_digest_proteins", lambda s, d: R.digest_proteins(view(s, d, "fx_svs").select(F.col("type").alias("sample"), F.col("chra").alias("genea"), F.col("chrb").alias("geneb"), F.expr("left(seq, cast(ord % 32 as int)) full"), F.expr("case when ord % 6 = 0 then 'A*' end interstitial"))),
         """, u as (select concat(chra,'_',chrb) fusion, type sample, substr(seq,1,ord%32) p from fx_svs where ord%6<>0 and ord%32>0), b as (select fusion, sample, p from u qualify row_number() over (partition by fusion, sample order by length(p) desc, p)=1), t as (select fusion, p from u qualify row_number() over (partition by fusion order by length(p) desc, p)=1),
 s as (select fusion, count(distinct substr(p,1,10)) n from u group by 1), g as (select fusion, p, string_agg(distinct sample, ',' order by sample) samples, count(distinct sample) n from u group by 1,2)
 select g.fusion, g.p "full", length(g.p) length, samples, g.n sample_count, s.n unique_starts, case when exists (select 1 from b where b.fusion=g.fusion and b.p=g.p) then 1 else 0 end best_in_sample, case when t.p=g.p then 1 else 0 end best_overall from g join s on s.fusion=g.fusion join t on t.fusion=g.fusion""")


def _reconcile(s, d):
    rows = view(s, d, "fx_svs").selectExpr("ord", "array('a_' || ord % 3, 'b', 'c_' || ord % 2) w", "array('a_' || ord % 2, 'a_9', 'b', 'd_' || ord % 5) f")
    return rows.select("ord", *[F.array_join(c, ",").alias(n) for c, n in zip(R.reconcile(F.col("w"), F.col("f")), ("missing", "additional", "missing_adjusted", "additional_adjusted"))])


register("A21_reconcile", _reconcile,
         """, w as (select ord, unnest(['a_'||ord%3,'b','c_'||ord%2]) x from fx_svs), f as (select ord, unnest(['a_'||ord%2,'a_9','b','d_'||ord%5]) x from fx_svs), m as (select distinct ord, x from w where not exists (select 1 from f where f.ord=w.ord and f.x=w.x)),
 a as (select distinct ord, x from f where not exists (select 1 from w where f.ord=w.ord and f.x=w.x)), ma as (select * from m where not exists (select 1 from a where a.ord=m.ord and split_part(a.x,'_',1)=split_part(m.x,'_',1))),
 l as (select *, max(x) over (partition by ord, split_part(x,'_',1)) top from a), aa as (select ord, x from l where not (x=top and exists (select 1 from m where m.ord=l.ord and split_part(m.x,'_',1)=split_part(l.x,'_',1))))
 select s.ord, coalesce((select string_agg(x,',' order by x) from m where m.ord=s.ord),'') missing, coalesce((select string_agg(x,',' order by x) from a where a.ord=s.ord),'') additional,
 coalesce((select string_agg(x,',' order by x) from ma where ma.ord=s.ord),'') missing_adjusted, coalesce((select string_agg(x,',' order by x) from aa where aa.ord=s.ord),'') additional_adjusted from fx_svs s""")
register("A22_stats", lambda s, d: R.stats(view(s, d, "fx_svs"), ["chra", "type"], "readsa").join(R.deciles(view(s, d, "fx_svs"), ["chra", "type"], "readsa", 0.9), ["chra", "type"]).select("chra", "type", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "deviation")], "median", "decile"),
         """, q as (select chra, type, readsa, row_number() over (partition by chra, type order by readsa) r, count(*) over (partition by chra, type) n from fx_svs) select chra, type, round(avg(readsa),6) mean, round(var_pop(readsa),6) variance, round(stddev_pop(readsa),6) deviation,
 cast(max(case when r=n//2+1 then readsa end) as double) median, max(case when r=least(cast(floor(n*0.9) as bigint),n-1)+1 then readsa end) decile from q group by 1,2""")
register("A23_bucket", lambda s, d: R.bucket(view(s, d, "fx_svs"), "chra", "genea"),
         """, q as (select chra, genea, first_value(genea) over (partition by chra order by length(genea) desc, genea) l from fx_svs) select chra, count(*) "rows", string_agg(distinct genea, ',' order by genea) "values", max(l) longest from q group by 1""")
register("U02_union_events", lambda s, d: R.union_events(view(s, d, "fx_svs").where("readsa > 10").select("ord", "type", "readsa"), view(s, d, "fx_svs").where("frame = '1'").select("ord", "type")),
         "select ord, type, readsa, 1 source from fx_svs where readsa>10 union all select ord, type, null, 2 from fx_svs where frame='1'")
register("A27_stage_qc", lambda s, d: R.stage_qc({"sites": view(s, d, "fx_svs"), "internal": view(s, d, "fx_svs").where("type = 'none'"), "blank": view(s, d, "fx_svs").withColumn("frame", F.lit(""))}, {"sites": ["frame"], "blank": ["frame", "type"]}),
         "select 'sites' stage, count(*) \"rows\", '' blank, 'ok' message from fx_svs union all select 'internal', 0, '', 'no rows' union all select 'blank', count(*), 'frame', 'empty columns' from fx_svs")
register("J27_excerpt", lambda s, d: R.excerpt(view(s, d, "fx_known").select(F.concat_ws("_", "genea", "geneb").alias("fusion"), F.col("genea").alias("gene_from"), F.col("geneb").alias("gene_to")), view(s, d, "fx_svs").select("ord", "genea", "geneb", F.concat("frame", F.lit(",")).alias("frame"))).select("ord", "fusion"),
         """, x as (select distinct ord, unnest(string_split(genea,',')) g, geneb, frame from fx_svs), y as (select ord, g, unnest(string_split(geneb,',')) h, frame from x), k as (select distinct genea, geneb from fx_known)
 select ord, concat(genea,'_',k.geneb) fusion from y join k on k.genea=g and k.geneb=h where frame<>'0'""")
register("R09_reannotate", lambda s, d: R.reannotate(view(s, d, "fx_svs").select("ord", "chra", "genea"), view(s, d, "fx_svs").where("frame = '3' and ord % 11 = 0").select(F.col("ord"), F.col("geneb").alias("symbol")).unionByName(view(s, d, "fx_svs").where("ord % 7 = 0").select("ord", F.col("genea").alias("symbol"))), "ord", "genea"),
         """, p as (select ord, geneb symbol from fx_svs where frame='3' and ord%11=0 union all select ord, genea from fx_svs where ord%7=0), o as (select ord, min(symbol) g from p group by 1 having count(distinct symbol)=1)
 select s.ord, chra, coalesce(g, genea) genea, case when g<>genea then concat('reannotated genea from ',genea,' to ',g) end note from fx_svs s left join o on o.ord=s.ord""")
register("R16_junction_indexes", lambda s, d: view(s, d, "fx_svs").select("ord", *R.junction_indexes(F.col("seq"), F.col("qposa").cast("int"), F.col("qposb").cast("int"), F.col("ord") % 3)),
         "select ord, case when qposb>qposa then substr(seq,qposa+1,qposb-qposa) else '' end interstitial, (qposa-1)*3+ord%3+2 contig_a, qposb*3+ord%3 contig_b from fx_svs")
_PART = "concat(substr(seq, 41, 20), 'T', substr(seq, 62, 29))"
register("R05_approx_anchor", lambda s, d: view(s, d, "fx_contig").select("doc_id", R.approx_anchor(F.col("seq"), F.expr("case when doc_id % 4 = 0 then reverse(substr(seq, 1, 30)) else " + _PART + " end")).alias("place")),
         """, k as (select doc_id, seq, case when doc_id%4=0 then reverse(substr(seq,1,30)) else """ + _PART + """ end part from fx_contig), l as (select doc_id, seq, part, unnest(range(1,length(seq)-length(part)+2)) i from k),
 m as (select doc_id, i, length(part) n, len(list_filter(range(1,length(part)+1), lambda j: substr(part,j,1)<>substr(seq,i+j-1,1))) e from l) select doc_id, cast(coalesce(arg_min(i, e*1000+i) filter (e<=floor(n*0.04) and n-e>=10),0) as int) place from m group by 1""")
register("A13_best_match", lambda s, d: R.best_match(view(s, d, "fx_hits"), "contig", "matches"), "select contig, max(matches) best from fx_hits group by 1")
register("A14_repeat_score", lambda s, d: R.repeat_score(view(s, d, "fx_svs").select("ord", F.col("ord").alias("contig"), (F.col("matcha") + 5).alias("left_matches"), (F.col("matchb") + 5).alias("right_matches")), view(s, d, "fx_hits")).select("ord", F.round("repeat_left", 9).alias("repeat_left"), F.round("repeat_right", 9).alias("repeat_right")),
         """, h as (select *, qstart+qend<qlen l from fx_hits where matches>25 and matches/(qend-qstart+1)>=0.75), e as (select ord, matcha+5 a, matchb+5 b from fx_svs),
 t as (select ord, sum(matches) filter (l and matches>=case when a>100 then a-10 else a*0.9 end) sl, sum(matches) filter (not l and matches>=case when b>100 then b-10 else b*0.9 end) sr from e join h on h.contig=ord group by 1)
 select e.ord, coalesce(round(1-a/sl,9),0.0) repeat_left, coalesce(round(1-b/sr,9),0.0) repeat_right from e left join t on t.ord=e.ord""")
register("M09_select_targets", lambda s, d: R.select_targets(view(s, d, "fx_hits"), "id", 3).select("contig", "part", "id", "matches"),
         """, k as (select contig from fx_hits group by 1 having bool_or(abs(tstart-site)<=15 or abs(tend-site)<=15) and not bool_or(qstart<=25 and qlen-qend<=25))
 select contig, case when qstart<=25 then 'left' else 'right' end part, id, matches from fx_hits where contig in (select contig from k) qualify row_number() over (partition by contig order by matches desc, id)<=3""")
register("M08_second_end_check", lambda s, d: R.second_end_check(view(s, d, "fx_svs").select("ord", F.col("ord").alias("contig"), (F.col("matcha") + F.col("matchb")).alias("matches"), F.lit(140).alias("qlen")), view(s, d, "fx_svs").selectExpr("ord contig", "posa", "posb", "areaa % 60 matcha", "areab % 60 matchb")).select("ord"),
         "select ord from fx_svs where not (abs(posa-posb)<=10000 and (areaa%60+areab%60>=matcha+matchb or least(areaa%60,areab%60)>50 or areaa%60+areab%60>90))")


register("J17_pair_transcripts", lambda s, d: R.pair_transcripts(view(s, d, "fx_svs"), transcripts(s, d), "ord"),
         "select ord, a.tx txa, b.tx txb from fx_svs left join fx_tx a on a.chrom=chra and posa between a.st and a.en left join fx_tx b on b.chrom=chrb and posb between b.st and b.en")
register("J21_salvage_nearest", lambda s, d: R.salvage_nearest(view(s, d, "fx_svs").select("ord", F.expr("concat('T', cast(ord % 300 as string)) gene"), F.col("chra").alias("chrom"), F.col("posa").alias("pos")), transcripts(s, d), "ord"),
         """, c as (select ord, tx, case when posa<st then st-posa else posa-en end d from fx_svs join fx_tx on gene=concat('T',cast(ord%300 as varchar)) and chrom=chra) select ord, tx from c qualify rank() over (partition by ord order by d)=1""")
register("J26_symbol_of", lambda s, d: T.symbol_of(view(s, d, "fx_svs").select("ord", (F.col("ord") % 3000).alias("acc")), transcripts(s, d), "acc").select("ord", "symbol"),
         ", k as (select tx, min(gene) g from fx_tx group by 1 having count(distinct gene)=1) select ord, g symbol from fx_svs left join k on k.tx=ord%3000")
register("F14_junctions_over_cutoff", lambda s, d: R.junctions_over_cutoff(view(s, d, "fx_svs").select("ord", "chra", "posa", "chrb", "posb", F.col("readsa").alias("perfect"), F.col("readsb").alias("flanking"), F.col("areaa").alias("deptha"), F.col("areab").alias("depthb")),
         view(s, d, "fx_genes").select("chrom", "strand", "st", "en", (F.col("gene_id") % 40).cast("double").alias("cutoff")).where("cutoff > 2"), "ord").select("ord"),
         """, e as (select ord, strand, coalesce(max(case when x='a' then c end),-1) a, coalesce(max(case when x='b' then c end),-1) b from (select ord, 'a' x, strand, gene_id%40 c from fx_svs join fx_genes g on g.chrom=chra and g.st<=posa+5000 and g.en>=posa-5000 where gene_id%40>2
 union all select ord, 'b', strand, gene_id%40 from fx_svs join fx_genes g on g.chrom=chrb and g.st<=posb+5000 and g.en>=posb-5000 where gene_id%40>2) group by 1,2), k as (select ord, max((a+b)/2) c from e group by 1)
 select s.ord from fx_svs s left join k on k.ord=s.ord where readsa>=coalesce(c,-1) and (coalesce(c,-1)<>-1 or (areaa*areab>0 and (readsb>=areaa*0.01 or readsb>=areab*0.01)))""")
register("F15_internal_events", lambda s, d: R.internal_events(view(s, d, "fx_svs").select("ord", "genea", "posa", "posb", "type", F.col("readsa").alias("reads"), (F.col("ord") % 4).alias("cutoff")), view(s, d, "fx_itd")).select("ord"),
         """, g as (select ord, posa, posb, unnest(string_split(genea,',')) n from fx_svs), w as (select distinct ord from g join fx_itd i on i.gene=n where least(posa,posb)>i.st and greatest(posa,posb)<i.en) select ord from fx_svs where type not like '%Internal%' or (type='Internal_dup' and ord in (select ord from w))""")
register("F09_intergenic_sites", lambda s, d: R.intergenic_sites(view(s, d, "fx_svs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("st"), F.col("posa").alias("en"), F.col("readsa").alias("reads")), view(s, d, "fx_tx"), "ord").select("ord"),
         "select ord from fx_svs where readsa>=5 and not exists (select 1 from fx_tx t where t.chrom=chra and posa between t.st and t.en)")
_V2 = "case when {p}<t.st or {p}>t.en then 'intergenic' when not (({p} between t.st and t.e1) or ({p} between t.s2 and t.e2) or ({p} between t.s3 and t.en)) then 'intron' when {p} between t.cds_st and t.cds_en then 'coding' when ({p}<t.cds_st)=(t.strand='+') then '5utr' else '3utr' end"
_AT = "(case when {p}>=t.st then 1 else 0 end+case when {p}>=t.s2 then 1 else 0 end+case when {p}>=t.s3 then 1 else 0 end)"


def _tx_hits(s, d, tx, *more):
    """(place, pos) of the different points with the transcripts over each, and the points of each place."""
    at = (F.col("posa") + F.col("ord") % 900 - 300).alias("pos")
    points = view(s, d, "fx_svs").select("ord", F.struct(F.col("chra").alias("chrom"), F.col("posa").alias("st"), at).alias("place"))
    hits = I.interval_join(points.select("place.*").distinct().withColumn("en", F.col("st")), tx.select("chrom", "st", "en", "tx", "strand", *more), width=500, dealt=True)
    return hits.select(F.struct("chrom", "st", "pos").alias("place"), "pos", *[F.col(f"r_{c}").alias(c) for c in ("tx", "strand", "st", "en", *more)]), points


def _numbered(s, d):
    hits, points = _tx_hits(s, d, transcripts(s, d).where("cds_st < cds_en"), "cds_st", "cds_en", "exons")
    found = hits.select("place", "tx", T.numbered_feature(F.col("pos"), *[F.col(c) for c in ("strand", "st", "en", "cds_st", "cds_en", "exons")]).alias("f")).select("place", "tx", "f.*")
    return I.listed_join(points, found, ["place"]).drop("place")


def _nearest_cds(s, d):
    hits, points = _tx_hits(s, d, T.with_coding_parts(transcripts(s, d).where("cds_st < cds_en")), "parts")
    return I.listed_join(points, T.nearest_cds(hits, "place"), ["place"]).drop("place")


register("C05_numbered_feature", _numbered,
         ", h as (select ord, t.*, posa+ord%900-300 p from fx_svs join fx_tx t on t.chrom=chra and posa between t.st and t.en), g as (select ord, tx, strand, " + _V2.format(p="p") + " feature, " + _AT.format(p="p") + """ a from h t)
 select ord, tx, feature, case when feature='intergenic' then 0 when strand='+' then a when feature='intron' then 3-a else 4-a end number from g""")
register("A25_feature_annot", lambda s, d: T.feature_annot(view(s, d, "fx_svs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("st"), F.col("posa").alias("en")), transcripts(s, d), "ord"),
         ", h as (select ord, " + _V2.format(p="posa") + """ f, string_agg(distinct cast(tx as varchar), ',' order by cast(tx as varchar)) l from fx_svs join fx_tx t on t.chrom=chra and posa between t.st and t.en group by 1,2), k as (select ord, string_agg(concat(f,'=',l),';' order by f) x from h group by 1)
 select s.ord, coalesce(x,'intergenic=no_transcripts_found') "text" from fx_svs s left join k on k.ord=s.ord""")
register("J19_nearest_cds", _nearest_cds,
         """, ex as (select tx, strand, cds_st, cds_en, st, e1 en from fx_tx union all select tx, strand, cds_st, cds_en, s2, e2 from fx_tx union all select tx, strand, cds_st, cds_en, s3, en from fx_tx), b as (select tx, strand, cds_st, cds_en, unnest(range(st,en+1)) pos from ex),
 c as (select tx, pos, row_number() over (partition by tx order by case when strand='+' then pos else -pos end) cb from b where case when strand='+' then pos>=cds_st else pos<=cds_en end),
 h as (select ord, t.tx, posa+ord%900-300 p from fx_svs join fx_tx t on t.chrom=chra and posa between t.st and t.en) select ord, h.tx, arg_min(cb, abs(pos-p)*1000000+pos) coding_base, max(cb) last_base from h join c on c.tx=h.tx group by 1,2""")
_OLD = "case when not (({p}>t.st and {p}<t.e1) or ({p}>t.s2 and {p}<t.e2) or ({p}>t.s3 and {p}<t.en)) then 'intron' when {p}<=t.cds_st then '5utr' when {p}>t.cds_en then '3utr' else 'coding' end"


def _enhancer(s, d):
    check = F.col("st") + F.col("shift")
    feature = T.feature_at(check, F.lit("+"), F.col("r_st"), F.col("r_en"), F.col("r_cds_st"), F.col("r_cds_en"), F.col("r_exons"))
    feature = F.when(feature.isin("5utr", "3utr"), "utr").otherwise(feature)
    points = view(s, d, "fx_svs").select("ord", F.col("chra").alias("chrom"), F.col("posa").alias("pos"), F.when(F.col("qsa") > 0, "+").otherwise("-").alias("strand"),
                                           F.when(F.col("ord") % 2 == 0, -10).otherwise(10).alias("shift"))
    genes = transcripts(s, d).select(F.concat(F.lit("E"), F.col("tx").cast("string")).alias("gene"), "chrom", "strand", "st", "en", "cds_st", "cds_en", "exons")
    return R.enhancer_gene(points, genes, genes.where("cast(substr(gene, 2) as int) % 25 = 3").select("gene"), "ord", feature)


register("J07_enhancer_gene", _enhancer,
         ", h as (select ord, t.strand=case when qsa>0 then '+' else '-' end same, t.*, posa+case when ord%2=0 then -10 else 10 end p from fx_svs join fx_tx t on t.chrom=chra and t.st<=posa+1000000 and t.en>=posa-1000000 where tx%25=3), f as (select ord, same, tx, st, case when p<st or p>en then 'intergenic' else " + _OLD.format(p="p")
         + """ end f0 from h t), g as (select ord, same, concat('E',cast(tx as varchar)) gene, st, case when f0 in ('5utr','3utr') then 'utr' else f0 end feature from f)
 select ord, gene, feature, same same_strand from g qualify row_number() over (partition by ord order by case when feature='coding' then case when same then 0 else 1 end when same then 3 else 2 end, case when feature='coding' then st else -st end, gene)=1""")
