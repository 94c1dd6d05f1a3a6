"""Queries on reading frames and annotation records, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusionframe.fixtures import view
from fusionframe.operators import frames as R
from fusionframe.operators import transcripts as T
from fusionframe.plans.registry import register
from fusionframe.sources import annotation as A

def _proteins(s, d):
    """fx_aa: 64 letters of each document that stand for the codons of a transcript, its coding codons and a place."""
    return view(s, d, "fx_aa").withColumnRenamed("at_codon", "at")


for _way, _name in ((True, "R03_fragment_forward"), (False, "R03_fragment_backward")):
    register(_name, lambda s, d, way=_way: _proteins(s, d).withColumn("f", R.aa_fragment(F.col("aa"), F.col("c1"), F.col("c2"), F.col("at"), 10, way)).where("f is not null").select("doc_id", "f.*"),
             f""", k as (select doc_id, c1, c2, i, substr(aa,i,1) letter, row_number() over (partition by doc_id order by {'i' if _way else '-i'}) n from fx_aa, range(1,65) r(i) where i{'>=' if _way else '<='}at_codon and at_codon<=64),
 l as (select *, min(case when i between c1 and c2 then n end) over (partition by doc_id) coding from k), m as (select *, least(3, coalesce(coding-1, max(n) over (partition by doc_id))) skipped from l)
 select doc_id, coalesce(string_agg(letter, '' order by i) filter (n>skipped), '') fragment, cast(count(*) filter (i<c1 or i>c2) as int) utr_codons, bool_and(i>c2) all_utr3 from m where n<=skipped+10 group by doc_id""")


def _upstream(s, d):
    aa, k = F.col("aa"), F.col("doc_id") % 5
    part = F.substring(aa, F.col("at") % 20 + 1, F.lit(40))
    text = F.when(k == 0, part).when(k == 1, F.concat(F.substring(part, 1, 22), F.lit("WWWW"))).when(k == 2, F.concat(F.substring(part, 1, 9), F.lit("W"), F.substring(part, 11, 9), F.lit("W"), F.substring(part, 21, 9))).when(
        k == 3, F.lit("WWWWWWWWWWWW")).otherwise(F.substring(part, 1, 5))
    whole = F.when(F.col("doc_id") % 7 == 0, F.concat(F.substring(aa, 1, 40), F.substring(aa, 1, 24))).otherwise(aa)
    return _proteins(s, d).select("doc_id", text.alias("up"), whole.alias("aa"))


register("R06_match_upstream", lambda s, d: _upstream(s, d).select("doc_id", R.match_upstream(F.col("up"), F.col("aa")).alias("m")).select("doc_id", "m.*"),
         """, p as (select doc_id, aa, substr(aa, at_codon%20+1, 40) part from fx_aa),
 u as (select doc_id, case doc_id%5 when 0 then part when 1 then substr(part,1,22)||'WWWW' when 2 then substr(part,1,9)||'W'||substr(part,11,9)||'W'||substr(part,21,9) when 3 then 'WWWWWWWWWWWW' else substr(part,1,5) end up,
 case when doc_id%7=0 then substr(aa,1,40)||substr(aa,1,24) else aa end aa from p),
 t as (select doc_id, i, substr(up,i,10) tp, instr(aa,substr(up,i,10)) at_aa, instr(substr(aa,instr(aa,substr(up,i,10))+1),substr(up,i,10)) again from u, range(1,32) r(i) where i<=length(up)-9),
 s1 as (select doc_id, max(i) i from t where at_aa>0 and again=0 group by 1), s2 as (select t.doc_id, t.i, t.at_aa from t join s1 on s1.doc_id=t.doc_id and s1.i=t.i),
 am as (select distinct t.doc_id from t left join s1 using (doc_id) where t.at_aa>0 and t.again>0 and (s1.i is null or t.i>s1.i)),
 ap as (select doc_id, arg_min(i, wrong*1000+i) place from (select u.doc_id, i, length(up) n, (select count(*) from range(1,length(up)+1) q(j) where substr(up,j,1)<>substr(aa,i+j-1,1)) wrong from u, range(1,65) r(i) where i+length(up)-1<=length(aa)) z
 where wrong<=floor(n*0.04) and n-wrong>=10 group by 1)
 select u.doc_id, cast(case when instr(aa,up)>0 then instr(aa,up)+length(up) when s2.i is not null then s2.at_aa+10 else ap.place end as int) codon,
 case when instr(aa,up)>0 then 'perfect' when s2.i is not null then 'tuple' when ap.place is not null then 'approximate' else '' end anchor,
 cast(case when instr(aa,up)>0 then length(up) when s2.i is not null then s2.i+9 when ap.place is not null then length(up) end as int) upstream_end, instr(aa,up)=0 and am.doc_id is not null ambiguous
 from u left join s2 using (doc_id) left join ap using (doc_id) left join am using (doc_id)""")


def _calls(s, d):
    p = _proteins(s, d).withColumns({"up": F.substring("aa", 1, 30), "down": F.substring("aa", 31, 34)})
    seen = R.start_seen(F.lit(1000), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-"), 990 + F.col("doc_id") % 60, F.col("down"), F.substring("aa", 33, 1))
    call = R.frame_call(F.col("doc_id") % 3 == 0, F.substring("up", 21, 10), F.substring("down", 1, 10), F.col("doc_id") % 2, seen, T.coding_frame(F.col("up"), F.col("down")))
    return p.select("doc_id", call.alias("frame"))


register("R07_frame_call", _calls,
         """, c as (select doc_id, aa, substr(aa,1,30) up, substr(aa,31,34) down, case when doc_id%2=0 then 990+doc_id%60-1000 else 1000-990-doc_id%60 end ahead from fx_aa),
 m as (select c.doc_id, bool_or(substr(aa,i,1)='M' and length(regexp_extract(substr(aa,i),'^M[^*]*'))>=11 and i+length(regexp_extract(substr(aa,i),'^M[^*]*'))-1>=30) coding from c, range(1,65) r(i) group by 1)
 select doc_id, case when doc_id%3=0 then case when contains(substr(up,21,10),'*') or (doc_id%2>0 and contains(substr(down,1,10),'*')) then 0 else 1 end when substr(aa,33,1)='M' and ahead+2>=0 and greatest(ahead,0)<=33 then 2 when coding then 3 else 0 end frame from c join m using (doc_id)""")


def _junctions(s, d):
    rows = view(s, d, "fx_pairs").select("ord", F.concat(F.lit("chr"), (F.col("ord") % 3 + 1).cast("string")).alias("chra"), (100 + F.col("posa") % 900).alias("posa"),
                                         F.concat(F.lit("chr"), (F.col("ord") % 3 + 1).cast("string")).alias("chrb"), (1100 + F.col("posb") % 900).alias("posb"))
    chunks = view(s, d, "fx_contig").where("doc_id < 60").select(F.concat(F.lit("chr"), (F.col("doc_id") % 3 + 1).cast("string")).alias("name"), F.floor(F.col("doc_id") / 3).alias("chunk"), "seq")
    tx = view(s, d, "fx_genes").select(F.concat(F.lit("chr"), (F.col("gene_id") % 3 + 1).cast("string")).alias("chrom"), (F.col("st") % 2000).alias("st"), (F.col("st") % 2000 + 30).alias("en"), "strand").where("st % 5 = 0")
    return R.junction_contigs(rows, chunks, tx, 128)


register("R11_junction_contigs", _junctions,
         """, g as (select concat('chr',cast(doc_id%3+1 as varchar)) name, string_agg(seq, '' order by doc_id) seq from fx_contig where doc_id<60 group by 1),
 j as (select ord, concat('chr',cast(ord%3+1 as varchar)) chrom, 100+posa%900 posa, 1100+posb%900 posb from fx_pairs),
 t as (select concat('chr',cast(gene_id%3+1 as varchar)) chrom, st%2000 st, st%2000+30 en, strand from fx_genes where (st%2000)%5=0),
 k as (select j.ord, count(distinct t.strand) n, min(t.strand) strand from j left join t on t.chrom=j.chrom and ((t.st<=j.posa and t.en>=j.posa) or (t.st<=j.posb and t.en>=j.posb)) group by 1),
 c as (select j.*, k.n, k.strand, substr(g.seq,posa-59,60)||substr(g.seq,posb,60) contig from j join k using (ord) join g on g.name=j.chrom)
 select ord, case n when 1 then '>' when 0 then '?: no strand info found' else '?: matching transcripts hit multiple strands' end sv_ort, case when n=1 then strand end strand, case when n=1 and strand='-' then posb else posa end posa,
 case when n=1 and strand='-' then posa else posb end posb, case when n<>1 then 'error' when strand='-' then translate(reverse(contig),'ACGT','TGCA') else contig end contig from c""")


def _collapse(s, d):
    rows = view(s, d, "fx_prot").select(F.col("accession").alias("grp"), F.concat_ws(".", "accession", F.col("version").cast("string")).alias("id"), F.col("protein").alias("seq"))
    return R.collapse_proteins(rows)


register("R15_collapse_proteins", _collapse,
         """, p as (select accession grp, concat(accession,'.',cast(version as varchar)) id, protein seq, cast(floor(length(protein)*0.05) as int) most from fx_prot),
 c as (select a.grp, a.id, a.most, b.id other, min(levenshtein(a.seq, substr(b.seq, s.i, a_len.n))) edits from p a join p b on a.grp=b.grp and a.id<>b.id and (length(b.seq)>length(a.seq) or (length(b.seq)=length(a.seq) and b.id>a.id)),
 range(1,40) s(i), lateral (select unnest(range(length(a.seq)-a.most, length(a.seq)+a.most+1)) n) a_len where s.i<=length(b.seq) group by 1,2,3,4)
 select grp, id, arg_min(other, (edits, other)) into, cast(min(edits) as int) edits from c where edits<=most group by 1,2""".replace("other, (edits, other)) into", 'other, (edits, other)) "into"'))


def _records(s, d):
    """Records written from the protein view, with descriptions, wrapped translations, nested locations and sequences over lines."""
    p = view(s, d, "fx_prot").withColumn("n", F.length("protein"))
    gap = F.lit("\n                     ")
    variant = F.when(F.col("version") == 1, "").when(F.col("version") == 2, ", transcript variant 12").when(F.col("version") == 3, ", transcript variant\n            b").otherwise(", transcript variant X1-a, mRNA")
    wrapped = F.regexp_replace("protein", "(.{20})", "$1\n                     ")
    seq = F.lower(F.translate(F.concat("protein", "protein"), "0123456789abcdefABCKW", "acgtacgtacgtacgtacgta"))
    lines = F.regexp_replace(seq, "(.{10})", "$1 ")
    where = F.when(F.col("version") % 2 == 0, F.concat(F.lit("join(3..8,\n                     10.."), (F.col("n") + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("complement(<3..>"), F.col("n").cast("string"), F.lit(")")))
    cds = F.when(F.col("version") == 5, "").otherwise(F.concat(F.lit("     CDS             "), where, gap, F.lit('/gene="'), F.col("accession"), F.lit('G"'), gap, F.lit('/db_xref="GI:'), F.col("n").cast("string"), F.lit('"'), gap, F.lit('/translation="'), wrapped, F.lit('"\n')))
    text = F.concat(F.lit("LOCUS       "), "accession", F.lit("  99 bp    mRNA    linear\nDEFINITION  Some gene, of\n            note"), variant, F.lit(".\nACCESSION   "), F.col("accession"), F.lit("\nVERSION     "), F.col("accession"), F.lit("."), F.col("version").cast("string"),
                    F.lit('\nFEATURES             Location/Qualifiers\n     source          1..99\n                     /map="7q'), F.col("version").cast("string"), F.lit('"\n     gene            1..99\n                     /gene="'), F.col("accession"), F.lit('G"\n'), cds,
                    F.lit("ORIGIN      \n        1 "), lines, F.lit("\n"))
    return p.select(text.alias("value"))


register("S09_protein_table", lambda s, d: A.protein_table(_records(s, d)),
         """select accession, version, case when version=5 then '' else cast(length(protein) as varchar) end gi, accession||'G' gene, case when version=5 then '' else protein end protein, case version when 1 then '' when 2 then '12' when 3 then 'b' else 'X1-a' end variant,
 cast(case version when 2 then 12 when 3 then 2 else 9999 end as bigint) variant_numeric, accession||'.'||cast(version as varchar) accession_versioned, case when version=5 then 0 else 1 end cds_count from fx_prot where accession like 'NM%' or accession like 'NR%'""")
register("S10_transcript_cds", lambda s, d: A.transcript_sequences(_records(s, d), cds_only=True),
         """select accession||'.'||cast(version as varchar) accession, accession||'.'||cast(version as varchar)||' Some gene, of note'||case version when 1 then '' when 2 then ', transcript variant 12' when 3 then ', transcript variant b' else ', transcript variant X1-a, mRNA' end
 ||' /gene='||accession||'G /map=7q'||cast(version as varchar) title, case when version=5 then '' else upper(substr(translate(protein||protein,'0123456789abcdefABCKW','acgtacgtacgtacgtacgta'), 3, length(protein)-2+case when version%2=0 then 1 else 0 end)) end seq from fx_prot where accession like 'NM%' or accession like 'NR%'""")
