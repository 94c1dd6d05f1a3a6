"""Queries that resolve mapped contigs into pairs of breakpoints, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fusionframe.fixtures import mappings, view
from fusionframe.operators import contigs as C
from fusionframe.operators.graph import written_by
from fusionframe.plans.registry import register

READ_LEN = 100
ENDS_A, ENDS_B = [f"{c}a" for c in C.END], [f"{c}b" for c in C.END]


def _hits(s, d):
    hits, sites, contigs = mappings(s, d)
    return C.sort_hits(hits), sites, contigs


def _triage(s, d):
    hits, sites, contigs = _hits(s, d)
    return hits, sites, contigs, C.triage_contigs(hits, sites, READ_LEN)


def _partial(s, d):
    hits, sites, contigs, triage = _triage(s, d)
    return hits, C.partial_hits(hits, sites, triage, contigs).withColumn("key", F.col("contig"))


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# The SQL works on the two scalar blocks of fx_psl: lengths l1 and l2, gaps gt on the target and gq on the contig.
_H = """, h0 as (select *, row_number() over (partition by contig order by matches desc, tname, id) n, lag(tname) over (partition by contig order by matches desc, tname, id) before from fx_psl),
 h as (select *, sum(case when before is distinct from tname then 1 else 0 end) over (partition by contig order by n) run, cast(matches as double)/(qend-qstart+1) pc, qstart<25 and qlen-qend<25 whole,
 replace(tname,'chr','')=replace(sc_chrom,'chr','') here, tstart t1, case when qstrand>0 then qstart else qend end q1, tstart+l1+gt t2, case when qstrand>0 then qstart+l1+gq else qend-l1-gq end q2 from h0)"""
register("W06_sort_hits", lambda s, d: C.sort_hits(mappings(s, d, lay=False)[0]).select("contig", "id", F.col("n").cast("long").alias("n"), F.col("run").cast("long").alias("run")),
         _H + " select contig, id, cast(n as bigint) n, cast(run as bigint) run from h")
_M01 = _H + """, t as (select *, (qstart<=25 or qlen-qend<=25) near_end, l2=0 single, here and (tstart+12.5-sc_site)*(tend-12.5-sc_site)<0 over_site from h),
 u as (select *, near_end and pc=1 and single and whole perfect, near_end and whole and pc>0.9 and matches>qend-qstart-20 and (not here or (tstart-sc_site)*(tend-sc_site)>0) beside,
 near_end and over_site and not (pc=1 and single) and (whole or qend-qstart>0.9*qlen) mapped, near_end and not over_site part, qstart+qend<qlen is_left from t),
 lm as (select *, row_number() over (partition by contig, run order by n) i, max(case when here and ((qstrand>0 and tstart<sc_site and abs(tend-sc_site)<50) or (qstrand<0 and abs(tstart-sc_site)<50 and tend>sc_site+25)) then 1 else 0 end)
 over (partition by contig, run order by n) stopped from u where part and is_left),
 rm as (select *, max(case when here and ((qstrand>0 and abs(tstart-sc_site)<50 and tend>sc_site) or (qstrand<0 and tstart<sc_site-25 and abs(tend-sc_site)<50)) then 1 else 0 end) over (partition by contig, run order by n) stopped,
 max(case when here and ((qstrand>0 and abs(tstart-sc_site)<50 and tend>sc_site) or (qstrand<0 and tstart<sc_site-25 and abs(tend-sc_site)<50)) then 1 else 0 end) over (partition by contig, run) any_stop from u where part and not is_left),
 sp as (select distinct lm.contig from lm join rm on lm.contig=rm.contig and lm.run=rm.run where lm.stopped=0 and (rm.any_stop=0 or (lm.i=1 and rm.stopped=0)) and lm.qend+25>rm.qstart
 and least(abs(lm.tend-rm.tstart),abs(lm.tstart-rm.tstart),abs(lm.tend-rm.tend),abs(lm.tstart-rm.tend))<40000),
 m01 as (select contig, max(qlen)<=100 or bool_or(perfect) or bool_or(beside) or contig in (select contig from sp) bad,
 max(qlen)>100 and not bool_or(beside) and coalesce(min(n) filter (mapped) < coalesce(min(n) filter (perfect), 1000000), false) site_mapped, max(matches) best from u group by contig)"""
register("M01_triage_contigs", lambda s, d: _triage(s, d)[3], _M01 + " select contig, bad, site_mapped, best from m01")


def _block_events(s, d):
    hits, sites, _, triage = _triage(s, d)
    return C.block_events(hits, sites, triage.where("site_mapped"))


_M02 = _M01 + """, v as (select h.*, case when whole and l2>0 then qstrand*(q2-q1)-l1 else 0 end dup from h join m01 using (contig) where site_mapped and tname=sc_chrom and tstart<=sc_site+1000 and tend>=sc_site-1000),
 w as (select *, case when l2=0 then 'one_block' when dup>10 then 'dup' when t2+5>=sc_site and t1-5<=sc_site then 'gap' end kind, clip*qstrand ort from v),
 x as (select *, case when kind in ('one_block','dup') then sc_site when clip>0 then t1+l1 else t2 end pa, case kind when 'one_block' then sc_site when 'dup' then sc_site-clip*dup else case when clip>0 then t2 else t1+l1 end end pb,
 case kind when 'one_block' then case when qstrand>0 then qstart+sc_site-tstart else qstart+tend-sc_site end when 'dup' then q2 else q1+qstrand*l1 end qa from w),
 y as (select *, case when kind='one_block' then qa else q2 end qb from x),
 z as (select *, case when ort>0 then qstart else qa end qs1, case when ort>0 then qa else qend end qe1, case when ort>0 then qb else qstart end qs2, case when ort>0 then qend else qb end qe2 from y),
 st as (select contig, run, min(n) filter (kind is null or (qe1-qs1+1>=25 and qe2-qs2+1>=25)) stop, min(n) filter (kind='dup') dup_at from z group by 1,2),
 fl as (select contig, stop, max(case when dup_at is not null and (stop is null or dup_at<=stop) then 1 else 0 end) over (partition by contig order by run)=1 itd from st)"""
register("M02_block_events", lambda s, d: _block_events(s, d).select("contig", "id", "kind", "itd", *[c for c in ENDS_A + ENDS_B if not c.startswith("percent")]),
         _M02 + """ select z.contig, id, kind, itd, ort orta, tname tnamea, case when clip>0 then tstart else pa end tstarta, case when clip>0 then pa else tend end tenda, pa tposa, qs1 qstarta, qe1 qenda, qa qposa, qstrand qstranda, qe1-qs1+1 matchesa,
 -ort ortb, tname tnameb, case when clip<0 then tstart else pb end tstartb, case when clip<0 then pb else tend end tendb, pb tposb, qs2 qstartb, qe2 qendb, qb qposb, qstrand qstrandb, qe2-qs2+1 matchesb
 from z join fl on fl.contig=z.contig and fl.stop=z.n where kind is not null""")
_M03 = _M01 + """, a as (select h.*, best, clip>0 and tend>sc_site cr, clip<0 and tstart<sc_site cl from h join m01 using (contig) where not bad and qend-qstart>=25 and not (whole and cast(matches-mismatches as double)/(qend-qstart+1)>0.9)),
 b as (select *, case when cr then case when l2>0 and t2<=sc_site then 2 when t1<=sc_site then 1 end when cl then case when t1+l1>=sc_site then 1 when l2>0 and t2+l2>=sc_site then 2 end end blk from a),
 c as (select *, case when cr then case when blk=2 then t2+l2-sc_site when blk=1 then t1+l1-sc_site end when cl then case when blk=1 then sc_site-t1 when blk=2 then sc_site-t2 end end ov,
 case when cr then case when blk=2 then 0 when blk=1 then l2 else l1+l2 end when cl then case when blk=1 then 0 when blk=2 then l1 else l1+l2 end else 0 end gone from b),
 e as (select *, matches-gone-coalesce(ov,0) m, case when cr then sc_site else tend end te, case when cl then sc_site else tstart end ts, case when cr and qstrand>0 and blk is not null then case blk when 2 then q2+l2 else q1+l1 end-ov else qend end qe0,
 case when cr and qstrand<0 and blk is not null then case blk when 2 then q2-l2 else q1-l1 end+ov else qstart end qs0 from c),
 f as (select *, case when clip*qstrand>0 then qstart else qend-m end qs, case when clip*qstrand>0 then qstart+m else qend end qe from e),
 g as (select *, cast(m as double)/(qe-qs+1) part, here and qe0-qs0>=25 and m>=25 and case when clip>0 then sc_site-te<=50 and ts<=sc_site-25 else ts-sc_site<=50 and te>=sc_site+25 end and cast(m as double)/(qe-qs+1)>=0.8 ok from f),
 rr as (select contig, run, min(n) filter (ok) hit, min(n) first_n, bool_or(here) mine from g group by 1,2),
 tt as (select g.contig, sum(matches) total from g join rr on rr.contig=g.contig and rr.run=g.run where case when mine then hit is null or n<=hit else n=first_n end group by 1),
 pm as (select g.*, tt.total, case when qs+qe>qlen then -1 else 1 end ort, substr(translate(concat(md5(concat(cast(g.contig as varchar),'_0')),md5(concat(cast(g.contig as varchar),'_1')),md5(concat(cast(g.contig as varchar),'_2')),md5(concat(cast(g.contig as varchar),'_3')),
 md5(concat(cast(g.contig as varchar),'_4')),md5(concat(cast(g.contig as varchar),'_5')),md5(concat(cast(g.contig as varchar),'_6'))),'0123456789abcdef','ACGTACGTACGTACGT'),1,200) seq
 from g join (select contig, max(hit) hit from rr where hit is not null group by 1) k on k.contig=g.contig and k.hit=g.n join tt on tt.contig=g.contig),
 p0 as (select contig, id, best, sc_chrom, sc_site, clip, qlen, ort, tname, ts tstart, te tend, case when clip>0 then te else ts end tpos, qs qstart, qe qend, case when ort>0 then qe else qs end qpos, qstrand, m matches, part percent,
 1-m/total repeat, case when ort<0 then substr(seq,1,qs+1) else substr(seq,qe) end overhang, seq from pm)"""
register("M03_partial_hits", lambda s, d: _rounded(_partial(s, d)[1].select("contig", "id", "best", *C.END, "repeat", "overhang", "junction")),
         _M03 + """ select contig, id, best, ort, tname, tstart, tend, tpos, qstart, qend, qpos, qstrand, matches, round(percent,9) percent, round(repeat,9) "repeat", overhang,
 case when length(overhang)<=25 then overhang when ort<0 then substr(seq,qstart-23,25) else substr(seq,qend,25) end junction from p0""")
_PAIR = """, pp as (select h.*, p0.ort p_ort, p0.tname p_tname, p0.tpos p_tpos, p0.qstart p_qstart, p0.qend p_qend, p0.qpos p_qpos, p0.matches p_matches, length(p0.overhang) over_len from p0 join h on h.contig=p0.contig)"""
_M04 = _M03 + _PAIR + """, lo as (select *, case when p_ort>0 then qstart<p_qpos and qend>p_qpos+10 else qend>p_qpos and qstart<p_qpos-10 end lap, -p_ort*qstrand side from pp where replace(tname,'chr','')=replace(p_tname,'chr','')),
 lb as (select *, case when not lap then null when side>0 then case when l2>0 and not (case when qstrand>0 then q2>p_qpos else q2<p_qpos end) then 2 when not (case when qstrand>0 then q1>p_qpos else q1<p_qpos end) then 1 end
 else case when not (case when qstrand>0 then q1+l1<p_qpos else q1-l1>p_qpos end) then 1 when l2>0 and not (case when qstrand>0 then q2+l2<p_qpos else q2-l2>p_qpos end) then 2 end end blk from lo where not (abs(qstart-p_qstart)<25 and qend<25)),
 lc as (select *, case blk when 1 then t1 when 2 then t2 end bt, case blk when 1 then q1 when 2 then q2 end bq, case blk when 1 then l1 when 2 then l2 end bl,
 case when not lap then 0 when side>0 then case when blk=2 then 0 when blk=1 then l2 else l1+l2 end else case when blk=1 then 0 when blk=2 then l1 else l1+l2 end end gone from lb),
 ld as (select *, case when side>0 then case when qstrand>0 then bq+bl-p_qpos else p_qpos-bq end else case when qstrand>0 then p_qpos-bq else bq-p_qpos end end ov from lc),
 le as (select *, coalesce(blk is not null and ov>=0, false) cut from ld),
 lf as (select *, matches-gone-case when cut then ov else 0 end m, case when cut and side>0 then bt+bl-ov+1 else tend end te, case when cut and side<0 then bt+ov+1 else tstart end ts,
 case when cut and (case when side>0 then qstrand<0 else qstrand>0 end) then p_qpos else qstart end qs, case when cut and (case when side>0 then qstrand>0 else qstrand<0 end) then p_qpos else qend end qe from le),
 lg as (select *, case when qs+qe<2*p_qpos then 1 else -1 end ort, cast(m-mismatches as double)/nullif(qe-qs+1,0) part from lf),
 lh as (select *, case when qstrand*ort<0 then ts else te end tpos, case when ort<0 then qs else qe end at_q from lg),
 li as (select *, ort<>p_ort and not (p_qstart>qs-10 and p_qend<qe+10) and abs(at_q-p_qpos)<=75 and coalesce((part>=0.99 and m>25) or (m>25 and part>0.75), false) kept, abs(tpos-p_tpos) dist from lh),
 lr as (select contig, run, count(*) filter (kept) partners, coalesce(min(dist) filter (kept and qlen-(p_matches+m)<25 and dist<10000), 10000) nearest from li group by 1,2),
 lx as (select distinct lo.contig from lo left join lr on lr.contig=lo.contig and lr.run=lo.run where coalesce(partners,0)=0),
 local as (select li.*, nearest from li join lr on lr.contig=li.contig and lr.run=li.run where kept and (nearest>=10000 or dist<=nearest) and li.contig not in (select contig from lx))"""


def _local(s, d):
    hits, pm = _partial(s, d)
    return C.overhang_local(pm, hits, READ_LEN)


register("M04_overhang_local", lambda s, d: _rounded(_local(s, d).select("contig", "id", *C.END)),
         _M04 + """ select contig, id, ort, tname, ts tstart, te tend, tpos, qs qstart, qe qend, case when ort>0 then qs else qe end qpos, qstrand, m matches, round(part,9) percent from local""")
# The best hit of an overhang: hits come with most matches first, so a later one replaces the first only where both reach the overhang's length or tie.
_M05 = _M03 + _PAIR + """, ra as (select *, case when qstart+qend>2*p_qpos then -1 else 1 end<>p_ort and case when p_ort>0 then qstart>p_qend-15 and qstart<p_qend+50 else qend<p_qstart+15 and qend>p_qstart-50 end tried from pp where matches>=25),
 rb as (select contig, least(max(matches), max(over_len)) length, max(matches) top, max(over_len) over_len from ra where tried group by 1),
 rc as (select ra.contig, rb.length, least(arg_max(pc, n), 0.95) part from ra join rb on rb.contig=ra.contig where tried and matches>=rb.length group by 1,2),
 remote as (select pp.*, case when qstart+qend>qlen then -1 else 1 end ort from pp join rc on rc.contig=pp.contig where rc.length>0 and rc.part>=0.9 and pp.matches>=25 and p_matches>=25 and replace(tname,'chr','')<>replace(p_tname,'chr','')
 and matches>=rc.length-10 and pc>=0.9 and case when qstart+qend>qlen then -1 else 1 end<>p_ort and case when p_ort>0 then qstart-p_qend else p_qstart-qend end between -15 and 50)"""


def _remote(s, d):
    hits, pm = _partial(s, d)
    return C.overhang_remote(pm, hits)


register("M05_overhang_remote", lambda s, d: _rounded(_remote(s, d).select("contig", "id", *C.END)),
         _M05 + """ select contig, id, ort, tname, tstart, tend, case when ort*qstrand>0 then tend else tstart end tpos, qstart, qend, case when ort>0 then qend else qstart end qpos, qstrand, matches, round(pc,9) percent from remote""")


def _second(hits):
    """Hits of second-pass mappings: those of the contig, moved to the front of an overhang of 110 bases."""
    moved = 1 + F.col("qstart") % 30
    return C.sort_hits(hits.withColumns({"qend": moved + F.col("qend") - F.col("qstart"), "qstart": moved, "qlen": F.lit(110).cast("long")}))


def _second_partners(s, d):
    hits, pm = _partial(s, d)
    return C.overhang_second(pm, _second(hits))


_M06 = _M03 + """, s0 as (select h.contig, id, n, tname, tstart, tend, 1+qstart%30 qstart, 1+qstart%30+qend-qstart qend, qstrand, matches, pc, 110 qlen from h),
 s1 as (select s0.*, p0.ort p_ort, p0.tpos p_tpos, case when p0.ort>0 then p0.qend else 0 end shift, s0.tname=p0.tname and least(abs(s0.tstart-p0.tpos),abs(s0.tend-p0.tpos))<10000 near, least(abs(s0.tstart-p0.tpos),abs(s0.tend-p0.tpos)) dist,
 p0.qend p_qend, p0.qstart p_qstart from s0 join p0 using (contig) where s0.matches>=25),
 s2 as (select *, case when p_ort>0 then abs(qstart+shift-p_qend)<50 else abs(qend+shift-p_qstart)<50 end beside, min(case when pc>=0.9 and near then dist end) over (partition by contig order by n rows between unbounded preceding and 1 preceding) prev from s1),
 s3 as (select *, pc>=0.9 and (not near or prev is null or dist<=prev) taken from s2),
 s4 as (select *, max(matches) filter (taken) over (partition by contig) length, sum(matches) filter (pc>=0.9) over (partition by contig) total, max(n) filter (taken and near and beside) over (partition by contig) pick from s3),
 second as (select *, -p_ort ort from s4 where length is not null and case when pick is not null then n=pick else pc>=0.8 and (matches>=0.8*qlen or pc>=0.98) and matches=length end)"""
register("M06_overhang_second", lambda s, d: _rounded(_second_partners(s, d).select("contig", "id", *C.END, "repeat")),
         _M06 + """ select contig, id, ort, tname, tstart, tend, case when ort*qstrand>0 then tend else tstart end tpos, qstart+shift qstart, qend+shift qend, case when ort>0 then qend+shift else qstart+shift end qpos, qstrand, matches,
 round(pc,9) percent, round(case when pick is not null then 0.0 else 1-cast(length as double)/total end,9) "repeat" from second""")


def _detected(s, d):
    hits, sites, contigs = _hits(s, d)
    return C.detect_pairs(hits, sites, contigs, _second(hits), READ_LEN, 3)


register("M10_detect_pairs", lambda s, d: _rounded(_detected(s, d)))


def _requantified(s, d):
    hits, pm = _partial(s, d)
    pm = written_by(pm, "partial", "contig")
    a = pm.select("contig", *[F.col(c).alias(f"{c}a") for c in ("tname", "tpos", "qpos", "ort")])
    b = C.overhang_remote(pm, hits).select("contig", "id", *[F.col(c).alias(f"{c}b") for c in ("tname", "tpos", "qpos", "ort")])
    events = written_by(a.join(b, "contig").withColumns({"event": F.concat_ws("_", F.col("contig").cast("string"), "id"), "ord": F.col("contig")}), "events", "ord")
    turn, off = F.col("contig") % 3 == 0, F.col("contig") % 70 - 15
    ends = [F.when(turn, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}")) for x, y in ("ab", "ba") for c in ("tname", "tpos")]
    pairs = events.groupBy("ord").agg(F.min_by(F.struct("contig", *[f"{c}{x}" for x in "ab" for c in ("tname", "tpos")]), "id").alias("e")).select("ord", "e.*").select(
        "ord", ends[0].alias("chra"), (ends[1] + off).alias("posa"), ends[2].alias("chrb"), ends[3].alias("posb"))
    maps = view(s, d, "fx_maps").withColumn("ord", F.col("contig"))
    return C.requantify(pairs, events, maps)


_M11 = _M05 + """, ev as (select p0.contig, remote.id, p0.tname na, p0.tpos ta, p0.qpos qa, p0.ort oa, remote.tname nb, case when remote.ort*remote.qstrand>0 then remote.tend else remote.tstart end tb, case when remote.ort>0 then remote.qend else remote.qstart end qb, remote.ort ob
 from p0 join remote on remote.contig=p0.contig),
 sv as (select contig, case when contig%3=0 then nb else na end chra, case when contig%3=0 then tb else ta end+contig%70-15 posa, case when contig%3=0 then na else nb end chrb, case when contig%3=0 then ta else tb end posb from ev qualify row_number() over (partition by contig order by id)=1),
 mt as (select ev.*, chra=na and abs(posa-ta)<50 and chrb=nb and abs(posb-tb)<50 straight, chra=nb and abs(posa-tb)<50 and chrb=na and abs(posb-ta)<50 turned from ev join sv using (contig)),
 pt as (select contig, id, straight, 'a' ending, case when straight then 'a' else 'b' end side, qa pos, oa ort from mt where straight or turned union all select contig, id, straight, 'b', case when straight then 'b' else 'a' end, qb, ob from mt where straight or turned),
 ln as (select pt.contig, pt.id, pt.ending, m.read, case when pt.ort>0 then m.tend-pt.pos else pt.pos-m.tstart end length from pt join fx_maps m on m.contig=pt.contig and m.side=pt.side and m.matches>25 and cast(m.matches as double)/(m.qend-m.qstart)>0.95 and m.tend>pt.pos+5 and m.tstart<pt.pos-5),
 su as (select contig, id, ending, count(distinct read) reads from ln group by 1,2,3), ar as (select contig, id, ending, cast(sum(length) as bigint) area from (select * from ln qualify row_number() over (partition by contig, id, ending, length order by read)<=2) z group by 1,2,3),
 fi as (select pt.*, coalesce(reads,0) reads, case when exists (select 1 from fx_maps m where m.contig=pt.contig and m.side=pt.side) then coalesce(area,0) else 1 end area from pt left join su on su.contig=pt.contig and su.id=pt.id and su.ending=pt.ending
 left join ar on ar.contig=pt.contig and ar.id=pt.id and ar.ending=pt.ending)"""
register("M11_requantify", _requantified,
         _M11 + """ select contig ord, concat(cast(contig as varchar),'_',id) event, not straight swapped, max(reads) filter (ending='a') readsa, max(area) filter (ending='a') areaa, max(reads) filter (ending='b') readsb, max(area) filter (ending='b') areab from fi group by contig, id, straight""")
