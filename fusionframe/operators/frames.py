"""Reading frames of joined transcripts: fragments, anchors, frame calls, junction contigs and near-duplicate proteins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import approx_anchor

TUPLE = 10


def aa_fragment(aa: Column, first: Column, last: Column, at: Column, length: int, forward: bool, skip: int = 3) -> Column:
    """(fragment, utr_codons, all_utr3): up to `length` amino acids from codon `at` on, or back from it, in reading order.

    `aa` holds the amino acids of a transcript's codons by rank, `first` to `last` are the coding ones. Up to `skip` codons of UTR at
    the breakpoint are passed over, as places there are less sure. utr_codons counts the UTR codons seen, all_utr3 holds if all lie
    after the coding ones. Nothing is read beyond the ends of the transcript; null for a place outside of it.
    """
    n = F.length(aa)
    ahead = F.when(at < first, first - at).when(at > last, n - at + 1).otherwise(0) if forward else F.when(at > last, at - last).when(at < first, at).otherwise(0)
    skipped = F.least(F.lit(skip), ahead)
    near = at + skipped if forward else at - skipped
    far = F.least(near + length - 1, n) if forward else F.greatest(near - length + 1, F.lit(1))
    lo, hi = (F.lit(at), far) if forward else (far, F.lit(at))
    taken = F.substring(aa, near, F.greatest(far - near + 1, F.lit(0))) if forward else F.substring(aa, far, F.greatest(near - far + 1, F.lit(0)))
    seen_lo, seen_hi = (at, F.greatest(hi, near - 1)) if forward else (F.least(lo, near + 1), at)
    five = F.greatest(F.lit(0), F.least(seen_hi, first - 1) - seen_lo + 1)
    three = F.greatest(F.lit(0), seen_hi - F.greatest(seen_lo, last + 1) + 1)
    whole = (at >= 1) & (at <= n)
    return F.when(whole, F.struct(taken.alias("fragment"), (five + three).cast("int").alias("utr_codons"), (three == seen_hi - seen_lo + 1).alias("all_utr3")))


def _once(text: Column, part: Column) -> Column:
    place = F.position(part, text)
    return (place > 0) & (F.position(part, F.substring(text, place + 1, F.length(text))) == 0)


def match_upstream(upstream: Column, aa: Column, size: int = TUPLE) -> Column:
    """(codon, anchor, upstream_end, ambiguous): where the protein `aa` holds the letters before the breakpoint.

    perfect: the whole of `upstream`. tuple: its last `size` letters that occur exactly once in `aa`, looked for from the right; ambiguous
    marks that some on the way occur more often. approximate: the whole, with at most 4 % substituted and `size` equal letters. codon is the place right
    after the match (for approximate its start), upstream_end the letters of `upstream` up to its end. Without a match codon is null and anchor ''.
    """
    n = F.length(upstream)
    whole = F.position(upstream, aa)
    starts = F.when(n >= size, F.sequence(n - size + 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    tuples = F.transform(starts, lambda i: F.struct(i.alias("i"), F.substring(upstream, i, F.lit(size)).alias("t")))
    single = F.get(F.filter(tuples, lambda x: _once(aa, x["t"])), F.lit(0))
    repeated = F.filter(tuples, lambda x: (F.position(x["t"], aa) > 0) & ~_once(aa, x["t"]) & (single.isNull() | (x["i"] > single["i"])))
    near = approx_anchor(aa, upstream, least=size)

    def found(codon, anchor, end, ambiguous):
        return F.struct(codon.cast("int").alias("codon"), F.lit(anchor).alias("anchor"), end.cast("int").alias("upstream_end"), ambiguous.alias("ambiguous"))

    many = F.size(repeated) > 0
    return (F.when(whole > 0, found(whole + n, "perfect", n, F.lit(False))).when(single.isNotNull(), found(F.position(single["t"], aa) + size, "tuple", single["i"] + size - 1, many))
            .when(near > 0, found(near, "approximate", n, many)).otherwise(found(F.lit(None), "", F.lit(None), many)))


def start_seen(pos: Column, strand: Column, start: Column, downstream: Column, first_aa: Column) -> Column:
    """Whether the start codon (its first base at `start`) lies at or after `pos` along the strand, no farther than downstream has letters; `first_aa` must be M."""
    ahead = F.when(strand == "+", start - pos).otherwise(pos - start)
    return (first_aa == "M") & (ahead + 2 >= 0) & (F.greatest(ahead, F.lit(0)) <= F.length(downstream) - 1)


def frame_call(in_frame: Column, after_a: Column, fragment: Column, utr_codons: Column, canonical_start: Column, coding: Column) -> Column:
    """0, 1, 2 or 3. 1: the upstream part is in frame and no stop lies between it and the second gene (nor, where that begins in UTR, in its fragment).

    Where the upstream part is not in frame: 2 if the second gene's own start codon is seen downstream, 3 if an M with enough letters reads into
    it, else 0. A stop between makes an in-frame row 0.
    """
    stop = F.coalesce(after_a, F.lit("")).contains("*") | ((utr_codons > 0) & F.coalesce(fragment, F.lit("")).contains("*"))
    return F.when(in_frame, F.when(stop, 0).otherwise(1)).when(canonical_start, 2).when(coding, 3).otherwise(0)


def junction_contigs(junctions: DataFrame, chunks: DataFrame, transcripts: DataFrame, size: int, flank: int = 60) -> DataFrame:
    """(ord, sv_ort, strand, posa, posb, contig) of junctions (ord, chra, posa, chrb, posb; optional `strand`).

    The contig is the reference up to posa and from posb on, `flank` bases each; on strand - it is reverse-complemented and the ends change places.
    The strand is the one given, else that of all transcripts over both ends; without one, or with both, contig is `error` and sv_ort says why. The reference
    comes in chunks (name, chunk, seq) of `size` bases.
    """
    from fusionframe.functions.columns import revcomp
    from fusionframe.sources.text import base_range

    from .intervals import overlap_nodes

    ends = junctions.select("ord", F.explode(F.array(*[F.struct(F.col(f"chr{x}").alias("chrom"), F.col(f"pos{x}").alias("st"), F.col(f"pos{x}").alias("en")) for x in "ab"])).alias("e")).select("ord", "e.*")
    met = overlap_nodes(ends, transcripts.select("chrom", "st", "en", "strand"), lambda rows, keys: rows.select(*keys, "strand").distinct())
    over = ends.join(met.select("chrom", "st", "en", F.col("strand").alias("r_strand")).distinct(), ["chrom", "st", "en"]).groupBy("ord").agg(F.collect_set("r_strand").alias("strands"))
    given = F.col("strand") if "strand" in junctions.columns else F.lit(None).cast("string")
    rows = junctions.withColumn("_given", given).join(over, "ord", "left").withColumn("strands", F.when(F.col("_given").isNotNull(), F.array("_given")).otherwise(F.coalesce("strands", F.array().cast("array<string>"))))
    spans = rows.select("ord", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("chra").alias("chrom"), (F.col("posa") - flank + 1).alias("st"), F.col("posa").alias("en")),
        F.struct(F.lit("b").alias("side"), F.col("chrb").alias("chrom"), F.col("posb").alias("st"), (F.col("posb") + flank - 1).alias("en")))).alias("s")).select(
            F.concat_ws("/", F.col("ord").cast("string"), "s.side").alias("key"), "ord", "s.*")
    bases = base_range(chunks, spans.withColumn("st", F.greatest("st", F.lit(1))), "key", size)
    joined = bases.withColumn("side", F.substring_index("key", "/", -1)).groupBy(F.substring_index("key", "/", 1).alias("ord_text")).agg(
        F.max(F.when(F.col("side") == "a", F.col("seq"))).alias("before"), F.max(F.when(F.col("side") == "b", F.col("seq"))).alias("after"))
    out = rows.join(joined, F.col("ord").cast("string") == F.col("ord_text"), "left")
    one, none = F.size("strands") == 1, F.size("strands") == 0
    minus = one & (F.get("strands", F.lit(0)) == "-")
    contig = F.concat(F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    return out.select("ord", F.when(one, ">").when(none, "?: no strand info found").otherwise("?: matching transcripts hit multiple strands").alias("sv_ort"), F.when(one, F.get("strands", F.lit(0))).alias("strand"),
                      F.when(minus, F.col("posb")).otherwise(F.col("posa")).alias("posa"), F.when(minus, F.col("posa")).otherwise(F.col("posb")).alias("posb"),
                      F.when(~one, "error").when(minus, revcomp(contig)).otherwise(contig).alias("contig"))


def edits_within(query: str, text: str, most: int) -> int:
    """The fewest edits between `query` and any stretch of `text`; most + 1 where more are needed. Ends of the text are free."""
    row = list(range(len(query) + 1))
    best = row[-1]
    for ch in text:
        above, row[0] = row[0], 0
        for i, q in enumerate(query, 1):
            here = row[i]
            row[i] = above if q == ch else 1 + min(above, here, row[i - 1])
            above = here
        best = min(best, row[-1])
    return min(best, most + 1)


def collapse_proteins(proteins: DataFrame, share: float = 0.05, q: int = 4) -> DataFrame:
    """(grp, id, into, edits) of the proteins (grp, id, seq; id unique) that nearly lie within a longer one of their group: it and the edits (the fewest, then the lowest id).

    A protein goes if some stretch of a longer one (of equal ones that with the greater id) differs from it by at most `share` of its letters in edits. As
    only longer ones count, the rows not returned are those that stay whatever the order. Each edit spoils at most q of a protein's q-grams, so of its first
    q * edits + 1 grams, the rarest first, the longer protein must hold at least one; only such pairs are compared, and common grams bring none. Proteins with
    too few letters for that many grams are found by the empty gram, which all longer proteins of the group have.
    """
    n = F.length("seq")
    rows = proteins.select("grp", "id", "seq", F.floor(n * F.lit(share)).cast("int").alias("most")).where("seq is not null")
    places = F.when(n >= q, F.sequence(F.lit(1), n - q + 1)).otherwise(F.array().cast("array<int>"))
    grams = rows.select("grp", "id", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("seq", i, F.lit(q))))).alias("gram"))
    common = grams.groupBy("grp", "gram").agg(F.count("*").alias("held"))
    listed = grams.join(common, ["grp", "gram"]).groupBy("grp", "id").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("grams"))
    asked = rows.join(listed, ["grp", "id"], "left").withColumn("wanted", q * F.col("most") + 1)
    enough = F.coalesce(F.size("grams"), F.lit(0)) >= F.col("wanted")
    probes = asked.select("grp", "id", "seq", "most", F.explode(F.when(enough, F.slice(F.transform("grams", lambda g: g["gram"]), F.lit(1), F.col("wanted"))).otherwise(F.array(F.lit("")))).alias("gram"))
    held = grams.unionByName(rows.select("grp", "id", F.lit("").alias("gram"))).select("grp", F.col("id").alias("other"), "gram")
    met = probes.select("grp", "id", "gram").join(held, ["grp", "gram"]).where("id <> other").select("grp", "id", "other").distinct()
    short = probes.select("grp", "id", "seq", "most").distinct()
    pairs = met.join(short, ["grp", "id"]).join(rows.select("grp", F.col("id").alias("other"), F.col("seq").alias("text")), ["grp", "other"])
    longer = (F.length("text") > F.length("seq")) | ((F.length("text") == F.length("seq")) & (F.col("other") > F.col("id")))

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([edits_within(*x) for x in zip(a, b, most)], dtype="int32")

    checked = pairs.where(longer).withColumn("edits", edits("seq", "text", "most")).where("edits <= most")
    return checked.groupBy("grp", "id").agg(F.min(F.struct("edits", "other")).alias("m")).select("grp", "id", F.col("m.other").alias("into"), "m.edits")
