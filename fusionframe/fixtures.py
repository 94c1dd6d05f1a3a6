"""Evidence views over the supplied tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_reads": ("lineitem", """select concat('chr',cast(l_suppkey%22+1 as varchar(5))) chrom,
 cast(1000+(l_partkey*37+l_orderkey*11)%100000 as bigint) st, cast(1000+(l_partkey*37+l_orderkey*11)%100000+99 as bigint) en,
 cast(l_quantity as int) clip, case when l_linenumber%3=0 then '+' else '-' end side, case when l_linenumber%2=0 then '+' else '-' end strand,
 case when l_returnflag='R' then 1024 else 0 end + case when l_linestatus='O' then 16 else 0 end flag from lineitem"""),
    "fx_genes": ("part", """select p_partkey gene_id, concat('chr',cast(p_partkey%22+1 as varchar(5))) chrom,
 case when p_size%2=0 then '+' else '-' end strand, cast(1000+(p_partkey*977)%100000 as bigint) st,
 cast(1000+(p_partkey*977)%100000+300+p_size*40 as bigint) en, concat(p_brand,'_',cast(p_partkey%7 as varchar(5))) name from part"""),
    "fx_pairs": ("orders", """select o_orderkey ord, concat('chr',cast(o_custkey%22+1 as varchar(5))) chra,
 cast(1000+(o_orderkey*131)%5000 as bigint) posa, concat('chr',cast(o_custkey%3+1 as varchar(5))) chrb,
 cast(1000+(o_orderkey*577)%5000 as bigint) posb, case when o_orderkey%2=0 then 1 else -1 end orta,
 case when o_orderkey%3=0 then 1 else -1 end ortb, cast(floor(o_totalprice) as bigint)%100 readsa,
 cast(floor(o_totalprice/100) as bigint)%100 readsb from orders"""),
    "fx_svs": ("orders", """select o_orderkey ord, concat('chr',cast(o_custkey%4+1 as varchar(5))) chra, cast(1000+(o_orderkey*131)%5000 as bigint) posa,
 concat('chr',cast((o_custkey+o_orderkey%2)%4+1 as varchar(5))) chrb, cast(1000+(o_orderkey*577)%5000+case when o_orderkey%5=0 then 200000 else 0 end as bigint) posb,
 case when o_orderkey%2=0 then 1 else -1 end orta, case when o_orderkey%3=0 then 1 else -1 end ortb, case when o_orderkey%7<4 then 1 else -1 end qsa, case when o_orderkey%11<6 then 1 else -1 end qsb,
 case when o_orderkey%9=0 then concat('G',cast(o_custkey%40 as varchar(5)),',G',cast(o_orderkey%13 as varchar(5))) when o_orderkey%17=0 then 'NA' else concat('G',cast(o_custkey%40 as varchar(5))) end genea,
 case when o_orderkey%8=0 then concat('G',cast(o_orderkey%41 as varchar(5)),'|G',cast(o_custkey%40 as varchar(5))) when o_orderkey%34=0 then 'NA' else concat('G',cast(o_orderkey%41 as varchar(5))) end geneb,
 cast(floor(o_totalprice) as bigint)%30 readsa, cast(floor(o_totalprice/100) as bigint)%30 readsb, cast(o_orderkey%120 as bigint) matcha, cast((o_orderkey*7)%120 as bigint) matchb,
 cast(o_orderkey%10 as double)/10 repa, cast(o_custkey%10 as double)/10 repb, cast(o_orderkey%2000 as bigint) areaa, cast(o_custkey%2000 as bigint) areab,
 cast(o_orderkey%50 as double)/1000 mafa, cast(o_custkey%50 as double)/1000 mafb, case o_orderkey%5 when 0 then 'coding' when 1 then '5utr' when 2 then '3utr' when 3 then 'intron' else 'intergenic' end featurea,
 case o_custkey%5 when 0 then 'coding' when 1 then '5utr' when 2 then '3utr' when 3 then 'intron' else 'intergenic' end featureb, case when o_orderkey%3=0 then '?' else '>' end sv_ort,
 case o_custkey%7 when 0 then 'CTX' when 1 then 'DEL' when 2 then 'read_through' when 3 then 'Internal_dup' when 4 then 'ITX' when 5 then 'INS' else 'Internal_inv' end type,
 cast(o_orderkey%4 as varchar(3)) frame, cast(o_orderkey%12 as bigint) gap, cast(o_orderkey%100 as double)/100 percent, cast(o_orderkey%7-3 as bigint) scorea, cast(o_custkey%5-2 as bigint) scoreb,
 cast(o_orderkey%32+1 as bigint) qposa, cast(o_custkey%32+1 as bigint) qposb, translate(md5(cast(o_orderkey as varchar(12))),'0123456789abcdef','ACGTACGTACGTACGT') seq from orders"""),
    "fx_known": ("supplier", """select concat('G',cast(s_suppkey%40 as varchar(5))) genea, concat('G',cast((s_suppkey*3)%41 as varchar(5))) geneb from supplier"""),
    "fx_deny": ("nation", """select concat('G',cast(n_nationkey%7 as varchar(5))) name from nation"""),
    "fx_itd": ("nation", """select concat('G',cast(n_nationkey as varchar(5))) gene, cast(1000+n_nationkey*50 as bigint) st, cast(4000+n_nationkey*50 as bigint) en from nation"""),
    "fx_regions": ("nation", """select concat('R',cast(n_nationkey as varchar(5))) name, cast(n_nationkey as bigint) ord, concat('chr',cast(n_nationkey%4+1 as varchar(5))) chrom, cast(1000+n_nationkey*180 as bigint) st, cast(1500+n_nationkey*200 as bigint) en from nation"""),
    "fx_sam": ("lineitem", """select concat('r',cast(l_orderkey as varchar(12)),'_',cast(l_linenumber as varchar(5)),'_',cast(l_partkey as varchar(12)),'_',cast(l_suppkey as varchar(12)),'_',cast(l_extendedprice as varchar(24))) qname,
 concat('chr',cast(l_suppkey%22+1 as varchar(5))) chrom, cast(1000+(l_partkey*37+l_orderkey*11)%100000 as bigint) st, case when l_linenumber%2=0 then '+' else '-' end strand,
 case when l_returnflag='R' then 1024 else 0 end flag, cast((l_partkey%5)*100 as bigint) mate_st, cast(l_quantity as int) clip,
 case l_orderkey%5 when 0 then concat(cast(cast(l_quantity as int) as varchar(4)),'S',cast(100-cast(l_quantity as int) as varchar(4)),'M') when 1 then concat(cast(100-cast(l_quantity as int) as varchar(4)),'M',cast(cast(l_quantity as int) as varchar(4)),'S')
 when 2 then concat(cast(cast(l_quantity as int) as varchar(4)),'S4M200N',cast(96-cast(l_quantity as int) as varchar(4)),'M') when 3 then '40M10D60M' else concat('60M300N3M',cast(cast(l_quantity as int) as varchar(4)),'S') end cigar,
 md5(concat(cast(l_orderkey as varchar(12)),cast(l_partkey as varchar(12)))) qual from lineitem"""),
    "fx_tx": ("part", """select p_partkey tx, concat('T',cast(p_partkey%300 as varchar(5))) gene, concat('chr',cast(p_partkey%22+1 as varchar(5))) chrom, case when p_size%2=0 then '+' else '-' end strand,
 cast(1000+(p_partkey*977)%100000 as bigint) st, cast(1000+(p_partkey*977)%100000+300+p_size*4 as bigint) en, cast(1000+(p_partkey*977)%100000+20 as bigint) cds_st, cast(1000+(p_partkey*977)%100000+280 as bigint) cds_en,
 cast(1000+(p_partkey*977)%100000+60 as bigint) e1, cast(1000+(p_partkey*977)%100000+100 as bigint) s2, cast(1000+(p_partkey*977)%100000+160 as bigint) e2, cast(1000+(p_partkey*977)%100000+240 as bigint) s3 from part"""),
    "fx_mates": ("lineitem", """select concat('q',cast(l_orderkey as varchar(12))) qname, concat('chr',cast(l_orderkey%4+1 as varchar(5))) chrom, cast(1000+(l_partkey*37)%5000 as bigint) st, cast(1000+(l_partkey*37)%5000+99 as bigint) en,
 cast(1000+(l_suppkey*53+l_partkey*7)%5000 as bigint) mate_st, 1+case when l_linenumber%2=1 then 64 else 128 end+case when l_returnflag='R' then 1024 else 0 end+case when l_partkey%6=0 then 4 else 0 end+case when l_linenumber=4 then 8 else 0 end
 +case when l_linestatus='O' then 16 else 0 end+case when l_quantity>25 then 32 else 0 end flag, concat(cast(4+cast(l_quantity as int) as varchar(4)),'M',cast(190+l_partkey%20 as varchar(5)),case when l_linenumber=2 then 'D' else 'N' end,cast(96-cast(l_quantity as int) as varchar(4)),'M') cigar,
 cast(4+cast(l_quantity as int) as bigint) m1, cast(190+l_partkey%20 as bigint) gap, cast(96-cast(l_quantity as int) as bigint) m2, translate(md5(cast(l_partkey as varchar(12))),'0123456789abcdef','ACGTACGTACGTACGN') seq, translate(md5(cast(l_orderkey as varchar(12))),'0123456789abcdef','+5II5IIIII5IIIII') qual from lineitem"""),
    "fx_samples": ("orders", """select o_orderkey ord, case o_orderkey%5 when 0 then concat('SJALL',lpad(cast(o_custkey%1000 as varchar(5)),3,'0'),'_',substr('ABDEGHIOSTXZ',cast(o_custkey%12+1 as int),1),case when o_custkey%2=0 then '-TB' else '' end)
 when 1 then concat('SJAML',lpad(cast(o_custkey as varchar(12)),6,'0'),'_',substr('ABDGOR',cast(o_custkey%6+1 as int),1),cast(o_custkey%4 as varchar(5))) when 2 then concat('/x/SJE2A012_',substr('DGQ',cast(o_custkey%3+1 as int),1),'.bam')
 when 3 then concat('Bin',substr('DGQ',cast(o_custkey%3+1 as int),1),cast(o_custkey as varchar(12)),'_x') else concat('s',cast(o_custkey as varchar(12))) end as name from orders"""),
    "fx_prot": ("orders", """select concat(case when o_custkey%5=0 then 'NP_' else 'NM_' end,cast(o_custkey%300 as varchar(5))) accession, cast(o_orderkey%7+1 as int) version, max(case o_orderkey%7 when 0 then md5(cast(o_custkey%300 as varchar(5))) when 1 then concat(substr(md5(cast(o_custkey%300 as varchar(5))),1,31),'W')
 when 2 then concat(md5(cast(o_custkey%300 as varchar(5))),'K') when 3 then translate(md5(cast(o_custkey%300 as varchar(5))),'abc','ABC') when 4 then substr(md5(cast(o_custkey%300 as varchar(5))),3,20) else md5(cast(o_custkey%300 as varchar(5))) end) protein from orders group by 1, 2"""),
    "fx_hits": ("lineitem", """select l_orderkey contig, concat(cast(l_partkey as varchar(12)),'_',cast(l_suppkey as varchar(12)),'_',cast(l_linenumber as varchar(5)),'_',cast(l_extendedprice as varchar(24))) id, cast(1000+(l_orderkey*131)%5000 as bigint) site, cast(1000+(l_orderkey*131)%5000-l_partkey%60 as bigint) tstart,
 cast(1000+(l_orderkey*131)%5000-l_partkey%60+l_suppkey%90 as bigint) tend, cast(l_quantity as bigint) qstart, cast(l_quantity as bigint)+20+l_partkey%60 qend, cast(140 as bigint) qlen, cast(floor((21+l_partkey%60)*(70+l_suppkey%30)/100) as bigint) matches from lineitem"""),
    "fx_psl": ("lineitem", """select contig, id, tname, tstart, cast(tstart+l1+case when l2>0 then gt+l2 else 0 end-1 as bigint) tend, qstart, cast(qstart+l1+case when l2>0 then gq+l2 else 0 end-1 as bigint) qend, qstrand, cast(200 as bigint) qlen,
 cast(l1+l2-mm as bigint) matches, mm mismatches, l1, l2, gt, gq, sc_chrom, sc_site, clip from (select contig, id, clip, qstrand, sc_chrom, sc_site, case when far then 'chrX' when p%7=0 then substr(sc_chrom,4,9) else sc_chrom end tname, qstart, l1, l2, gt, gq,
 cast(case p%4 when 0 then 0 when 1 then s%3 when 2 then s%9 else s%25 end as bigint) mm, cast(greatest(1, case role when 0 then sc_site-l1-p%5+2 when 1 then case when clip>0 then sc_site-l1+p%9 else sc_site-p%9+3 end when 2 then sc_site+(p*131+s)%30000-9000 else 5000+p%400 end) as bigint) tstart
 from (select *, role=3 or (role=0 and s%9=0) far, case when role=0 then cast(1+s%24 as bigint) when first then cast(1+s%20 as bigint) else cast(88+p%30 as bigint) end qstart,
 cast(case when role=0 then 60+p%50 when role=4 then 20+p%12 when first then 75+p%30 else 70+s%12 end as bigint) l1, cast(case when role=0 and p%6>0 then 60+s%40 when h%3=0 and role in (1,2) then 12+p%9 else 0 end as bigint) l2,
 cast(case when role=0 and k%3<2 then 40+p%700 when h%3=0 then 30+p%90 else 0 end as bigint) gt, cast(case when role=0 and k%3=2 then 4+p%20 else 0 end as bigint) gq
 from (select l_orderkey k, l_orderkey contig, l_partkey p, l_suppkey s, l_linenumber h, concat(cast(l_partkey as varchar(12)),'_',cast(l_suppkey as varchar(12)),'_',cast(l_linenumber as varchar(5)),'_',cast(l_extendedprice as varchar(24))) id,
 case when l_orderkey%2=0 then 1 else -1 end clip, case when (l_orderkey+l_linenumber)%4=0 then -1 else 1 end qstrand, concat('chr',cast(l_orderkey%3+1 as varchar(5))) sc_chrom, cast(20000+(l_orderkey*131)%5000 as bigint) sc_site,
 case when l_orderkey%4=0 then (l_partkey%3) else 1+l_partkey%4 end role, case when l_partkey%5>0 then (l_orderkey%2=0)=((l_partkey%4)=0) else l_partkey%2=0 end first from lineitem) a) b) c"""),
    "fx_maps": ("lineitem", """select l_orderkey contig, concat('m',cast(l_partkey%60 as varchar(12))) as read, case when l_linenumber%2=0 then 'b' else 'a' end side, cast(60+l_partkey%40-l_suppkey%4 as bigint) matches, cast(l_suppkey%3 as bigint) qstart, cast(l_suppkey%3+60+l_partkey%40 as bigint) qend,
 cast((l_partkey*7+l_suppkey)%90+20 as bigint) tstart, cast((l_partkey*7+l_suppkey)%90+80+l_partkey%40 as bigint) tend from lineitem"""),
    "fx_cuts": ("orders", """select o_orderkey key, o_orderkey contig, cast(60+o_custkey%80 as bigint) pos, case when o_custkey%2=0 then 1 else -1 end ort from orders"""),
    "fx_gather": ("orders", """select o_orderkey key, concat('chr',cast(o_custkey%22+1 as varchar(5))) chrom, cast(1000+(o_orderkey*611+o_custkey*37)%100000 as bigint) pos, case when o_orderkey%2=0 then '+' else '-' end side from orders"""),
    "fx_kord": ("orders", """select o_orderkey ord, concat('G',cast(o_custkey%37 as varchar(5))) genea, concat('G',cast((o_orderkey*7+o_custkey)%41 as varchar(5))) geneb from orders where o_orderkey%8=0"""),
    "fx_aa": ("documents", """select doc_id, translate(concat(md5(concat(text,'p')),md5(concat(text,'q'))),'0123456789abcdef','ARNDCQEGHILKMFP*') aa, cast(1+doc_id%9 as int) c1, cast(64-doc_id%13 as int) c2, cast(1+doc_id*7%66 as int) at_codon from documents"""),
    "fx_contig": ("documents", """select doc_id, translate(concat(md5(text),md5(concat(text,'1')),md5(concat(text,'2')),
 md5(concat(text,'3'))),'0123456789abcdef','ACGTACGTACGTACGT') seq from documents"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    base = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"from {table}", "from {base}"), base=base)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_tx with its three exons as an array."""
    from pyspark.sql import functions as F
    exons = F.array(*[F.struct(F.col(a).alias("st"), F.col(b).alias("en")) for a, b in (("st", "e1"), ("s2", "e2"), ("s3", "en"))])
    return view(spark, sf_dir, "fx_tx").withColumn("exons", exons).drop("e1", "s2", "e2", "s3")


def mappings(spark: SparkSession, sf_dir: str, lay: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, sites, contigs): fx_psl with its one or two blocks as an array, the site of each contig, and a sequence of its length.

    With `lay` the rows are written by contig once, so that nothing that is done for a contig moves them again.
    """
    from pyspark.sql import functions as F

    from fusionframe.operators.graph import written_by
    rows = view(spark, sf_dir, "fx_psl")
    rows = written_by(rows, "psl", "contig", deal=True) if lay else rows
    forward = F.col("qstrand") > 0
    first = F.struct(F.col("tstart").alias("t"), F.when(forward, F.col("qstart")).otherwise(F.col("qend")).alias("q"), F.col("l1").alias("len"))
    step = F.col("l1") + F.col("gq")
    second = F.struct((F.col("tstart") + F.col("l1") + F.col("gt")).alias("t"), F.when(forward, F.col("qstart") + step).otherwise(F.col("qend") - step).alias("q"), F.col("l2").alias("len"))
    hits = rows.withColumn("blocks", F.when(F.col("l2") > 0, F.array(first, second)).otherwise(F.array(first)))
    sites = rows.select("contig", "sc_chrom", "sc_site", "clip").distinct()
    letters = F.translate(F.concat(*[F.md5(F.concat(F.col("contig").cast("string"), F.lit(f"_{i}")).cast("binary")) for i in range(7)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    return hits.drop("l1", "l2", "gt", "gq", "sc_chrom", "sc_site", "clip"), sites, sites.select("contig", F.substring(letters, 1, 200).alias("seq"))


def with_views(sql: str) -> str:
    """DuckDB text with the views it names in front."""
    used = [f"{n} as ({s})" for n, (_, s) in VIEWS.items() if n in sql]
    sql = sql.strip()
    return f"with {'recursive ' if 'walk as' in sql else ''}{', '.join(used)}{sql if sql.startswith(',') else ' ' + sql}"
