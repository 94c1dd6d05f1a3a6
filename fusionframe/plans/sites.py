"""Queries on gene models, gathered reads, clip consensus and loci, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusionframe.fixtures import transcripts, view
from fusionframe.operators import evidence as E
from fusionframe.operators import scoring as S
from fusionframe.operators import transcripts as T
from fusionframe.plans.registry import register

register("A05_build_genes", lambda s, d: T.build_genes(transcripts(s, d)),
         """, ex as (select tx, chrom, strand, st, e1 en from fx_tx union all select tx, chrom, strand, s2, e2 from fx_tx union all select tx, chrom, strand, s3, en from fx_tx),
 ed as (select distinct a.tx a, b.tx b from ex a join ex b on a.chrom=b.chrom and a.strand=b.strand and a.st<=b.en and a.en>=b.st),
 walk as (select tx root, tx node from fx_tx union select walk.root, ed.b from walk join ed on ed.a=walk.node where ed.b>walk.root),
 rt as (select node tx, min(root) gene_no from (select root, node from walk union all select a, a from ed) z group by 1),
 deep as (select tx, gene_no from rt)
 select gene_no, chrom, strand, min(st) st, max(en) en, string_agg(distinct gene, ',' order by gene) as names, count(*) transcripts from fx_tx join deep using (tx) group by 1,2,3""")


def _gather_sites(s, d):
    return view(s, d, "fx_gather")


register("J14_clip_reads_at", lambda s, d: E.clip_reads_at(view(s, d, "fx_sam").withColumn("flag", F.col("flag") + F.when(F.col("strand") == "-", 32).otherwise(0)), _gather_sites(s, d), "key"),
         r""", r as (select *, st+list_sum(list_transform(regexp_extract_all(cigar,'(\d+)[MDN]',1), lambda x: cast(x as bigint)))-1 en, len(regexp_extract_all(cigar,'\d+[A-Z]')) ops, case when strand='-' then 1 else 0 end mminus from fx_sam where flag & 1024 = 0 and cigar like '%S%'),
 c as (select qname, chrom, st, en, mate_st, flag, mminus, '-' side, st at_pos, cast(regexp_extract(cigar,'^(\d+)S',1) as bigint) clip, 0 moved from r where regexp_matches(cigar,'^\d+S') union all
 select qname, chrom, st, en, mate_st, flag, mminus, '+', en, cast(regexp_extract(cigar,'(\d+)S$',1) as bigint), 0 from r where regexp_matches(cigar,'\d+S$') union all
 select qname, chrom, st, en, mate_st, flag, mminus, '-', st+cast(regexp_extract(cigar,'^\d+S(\d+)M',1) as bigint)-cast(regexp_extract(cigar,'^\d+S\d+M(\d+)N',1) as bigint), cast(regexp_extract(cigar,'^(\d+)S',1) as bigint)+cast(regexp_extract(cigar,'^\d+S(\d+)M',1) as bigint), 1
 from r where regexp_matches(cigar,'^\d+S\d+M\d+N') and ops>=4 and cast(regexp_extract(cigar,'^(\d+)S',1) as bigint)>=3 and cast(regexp_extract(cigar,'^\d+S(\d+)M',1) as bigint)<=6 and cast(regexp_extract(cigar,'^\d+S\d+M(\d+)N',1) as bigint)>100 union all
 select qname, chrom, st, en, mate_st, flag, mminus, '+', en-cast(regexp_extract(cigar,'(\d+)M\d+S$',1) as bigint)-cast(regexp_extract(cigar,'(\d+)N\d+M\d+S$',1) as bigint), cast(regexp_extract(cigar,'(\d+)S$',1) as bigint)+cast(regexp_extract(cigar,'(\d+)M\d+S$',1) as bigint), 1
 from r where regexp_matches(cigar,'\d+N\d+M\d+S$') and ops>=4 and cast(regexp_extract(cigar,'(\d+)S$',1) as bigint)>=3 and cast(regexp_extract(cigar,'(\d+)M\d+S$',1) as bigint)<=6 and cast(regexp_extract(cigar,'(\d+)N\d+M\d+S$',1) as bigint)>100),
 m as (select g.key, c.* from fx_gather g join c on c.chrom=g.chrom and c.side=g.side and c.at_pos between g.pos-3 and g.pos+3 and c.clip>=3 and (c.moved=0 or (c.en>=g.pos-3 and c.st<=g.pos+3))),
 o as (select * from m qualify row_number() over (partition by key, qname, st, en, mate_st, flag, mminus order by moved, at_pos, clip)=1), u as (select * from o qualify row_number() over (partition by key, st, en, mate_st, clip order by qname, flag, at_pos)=1),
 p as (select key, at_pos, count(*) n from u group by 1,2), q as (select key, at_pos from p qualify row_number() over (partition by key order by n desc, at_pos)=1)
 select u.key, count(*) reads, max(q.at_pos) pos, case when count(*)-sum(mminus)>sum(mminus) then '+' else '-' end mate_strand, min(mate_st) mate_from, max(mate_st) mate_to, max(clip) longest from u join q on q.key=u.key group by 1 having max(clip)>=20""")


def _clips(s, d):
    clips = E.explode_clips(E.eligible_clips(view(s, d, "fx_sam"), paired=False))
    letters = F.translate(F.md5(F.concat("chrom", F.col("pos").cast("string"), F.substring(F.md5(F.col("qname").cast("binary")), 1, 1)).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    return clips.select("chrom", "pos", "side", F.substring(letters, F.lit(1), F.least(F.col("clip"), F.lit(32)).cast("int")).alias("seq"))


register("M12_clip_consensus", lambda s, d: E.clip_consensus(_clips(s, d), ["chrom", "pos", "side"]),
         r""", r as (select *, st+list_sum(list_transform(regexp_extract_all(cigar,'(\d+)[MDN]',1), lambda x: cast(x as bigint)))-1 en, len(regexp_extract_all(cigar,'\d+[A-Z]')) ops from fx_sam where flag & 1024 = 0 and cigar like '%S%'),
 c as (select qname, chrom, '-' side, st pos, cast(regexp_extract(cigar,'^(\d+)S',1) as bigint) clip from r where regexp_matches(cigar,'^\d+S') union all select qname, chrom, '+', en, cast(regexp_extract(cigar,'(\d+)S$',1) as bigint) from r where regexp_matches(cigar,'\d+S$') union all
 select qname, chrom, '-', st+cast(regexp_extract(cigar,'^\d+S(\d+)M',1) as bigint)+cast(regexp_extract(cigar,'^\d+S\d+M(\d+)N',1) as bigint), cast(regexp_extract(cigar,'^(\d+)S',1) as bigint)+cast(regexp_extract(cigar,'^\d+S(\d+)M',1) as bigint)
 from r where regexp_matches(cigar,'^\d+S\d+M\d+N') and ops>=4 and cast(regexp_extract(cigar,'^(\d+)S',1) as bigint)>=7 and cast(regexp_extract(cigar,'^\d+S(\d+)M',1) as bigint)<=5 union all
 select qname, chrom, '+', en-cast(regexp_extract(cigar,'(\d+)M\d+S$',1) as bigint)-cast(regexp_extract(cigar,'(\d+)N\d+M\d+S$',1) as bigint), cast(regexp_extract(cigar,'(\d+)S$',1) as bigint)+cast(regexp_extract(cigar,'(\d+)M\d+S$',1) as bigint)
 from r where regexp_matches(cigar,'\d+N\d+M\d+S$') and ops>=4 and cast(regexp_extract(cigar,'(\d+)S$',1) as bigint)>=7 and cast(regexp_extract(cigar,'(\d+)M\d+S$',1) as bigint)<=5),
 q as (select chrom, pos, side, substr(translate(md5(concat(chrom,cast(pos as varchar),substr(md5(qname),1,1))),'0123456789abcdef','ACGTACGTACGTACGN'),1,least(clip,32)) seq from c where clip>=10),
 b as (select chrom, pos, side, i, case when side='+' then substr(seq,i+1,1) else substr(seq,length(seq)-i,1) end base from (select *, unnest(range(length(seq))) i from q) z),
 n as (select chrom, pos, side, i, base, count(*) n, sum(count(*)) over (partition by chrom, pos, side, i) depth from b group by 1,2,3,4,5),
 w as (select * from n where depth>=2 qualify row_number() over (partition by chrom, pos, side, i order by base='N', n desc, base)=1)
 select chrom, pos, side, case when side='+' then string_agg(base, '' order by i) else string_agg(base, '' order by i desc) end consensus, min(n) support, cast(max(depth) filter (i=0) as bigint) reads from w group by 1,2,3""")


def _locus_pairs(s, d):
    rows = view(s, d, "fx_svs").withColumns({"posb": F.when(F.col("ord") % 4 == 0, F.col("posa") + F.col("ord") % 7000).otherwise(F.col("posb")), "chrb": F.when(F.col("ord") % 4 == 0, F.col("chra")).otherwise(F.col("chrb"))})
    return rows.select("ord", *[F.col(f"{c}{x}") for x in "ab" for c in ("chr", "pos")], *[c for x in "ab" for c in ((F.col(f"pos{x}") - 20).alias(f"st{x}"), (F.col(f"pos{x}") + 60).alias(f"en{x}"), F.col(f"qs{x}"))])


register("J22_same_locus", lambda s, d: S.same_locus(_locus_pairs(s, d), view(s, d, "fx_genes").where("gene_id % 3 = 0")),
         """, p as (select ord, chra, posa, case when ord%4=0 then chra else chrb end chrb, case when ord%4=0 then posa+ord%7000 else posb end posb, qsa, qsb from fx_svs),
 e as (select ord, 'a' e, chra chrom, posa-20 s, posa+60 t from p union all select ord, 'b', chrb, posb-20, posb+60 from p),
 h as (select e.ord, e.e, g.gene_id, g.st, g.en, case when greatest(0,g.st-t,s-g.en)<=0 then 0 when greatest(0,g.st-t,s-g.en)<=5000 then 1 else 2 end tier from e join fx_genes g on g.gene_id%3=0 and g.chrom=e.chrom and g.st<=t+10000 and g.en>=s-10000),
 k as (select *, min(tier) over (partition by ord, e) low from h), x as (select * from k where tier=low),
 sh as (select distinct a.ord from x a join x b on a.ord=b.ord and a.e='a' and b.e='b' join p on p.ord=a.ord where a.gene_id=b.gene_id or (p.chra=p.chrb and ((a.st-1000<b.st and a.en+1000>b.en) or (b.st-1000<a.st and b.en+1000>a.en)))),
 f as (select p.*, not exists (select 1 from x where x.ord=p.ord and e='a' and tier=0) na, not exists (select 1 from x where x.ord=p.ord and e='b' and tier=0) nb, least(abs(posa-(posb-20)),abs(posa-(posb+60)),abs(posb-(posa-20)),abs(posb-(posa+60))) near from p)
 select ord, (chra=chrb and (((na or nb) and near<1000) or (na and nb and (near<5000 or (abs(posa-posb)<1000 and qsa=qsb))))) or ord in (select ord from sh) same from f""")


def _known(s, d):
    name = lambda c: F.when(F.col(c) == "G0", "IGH").when(F.col(c) == "G6", "TRA").when(F.col(c) == "G12", "IGK").otherwise(F.col(c))
    return view(s, d, "fx_kord").select("ord", name("genea").alias("genea"), name("geneb").alias("geneb"))


register("U05_known_pairs", lambda s, d: S.known_pairs(_known(s, d)),
         """, k as (select row_number() over (order by ord) i, case genea when 'G0' then 'IGH' when 'G6' then 'TRA' when 'G12' then 'IGK' else genea end a, case geneb when 'G0' then 'IGH' when 'G6' then 'TRA' when 'G12' then 'IGK' else geneb end b from fx_kord),
 walk as (select cast(0 as bigint) i, cast([] as varchar[]) active, cast(false as boolean) kept, cast('' as varchar) a, cast('' as varchar) b union all
 select k.i, case when list_contains(active, k.a) or list_contains(active, k.b) then active else list_concat(list_concat(active, case when regexp_matches(k.a,'^(IG|TR).$') then [k.b] else [] end), case when regexp_matches(k.b,'^(IG|TR).$') then [k.a] else [] end) end,
 not (list_contains(active, k.a) or list_contains(active, k.b)), k.a, k.b from walk join k on k.i=walk.i+1)
 select distinct a x, b y from walk where kept union select distinct b, a from walk where kept""")
