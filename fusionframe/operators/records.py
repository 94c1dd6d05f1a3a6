"""Sample names, protein records, contig hits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .intervals import interval_join, overlap_nodes
from .scoring import with_itd, with_name
from .sweep import running_max

#: Patterns of sample names (two conventions and two loose ones), and codes of sample types.
SAMPLE_V1 = r"^SJ([A-Za-z0-9]*[A-Za-z]\d?)(\d{3})_([A-Z])(-(.+))?$"
SAMPLE_V2 = r"^SJ([A-Za-z0-9]*[A-Za-z]\d?)(\d{6})_([ACDGMORX])([1-9]\d*)(-(.+))?$"
LOOSE = (r"^SJ[A-Z\d]+[A-Z]\d+_([A-Z])", r"^Bin([A-Z])\d+_")
TYPE_INDEX = {**dict.fromkeys("ACDGMRX", 1), **dict.fromkeys("BEHSY", 2), **dict.fromkeys("FITZ", 3)}
GENERIC_TYPE = {"B": "A", "E": "D", "F": "D", "H": "G", "I": "G", "S": "R", "T": "R", "Y": "X", "Z": "X"}
TUMOR_NORMAL = {**dict.fromkeys("GHI", "N"), **dict.fromkeys("CDEFORSTMAXYZ", "T")}
#: Transcripts of a piece, and rows of a pair of places in one task, in `pair_transcripts`.
LIST, ROWS = 512, 100_000
#: Translation status codes.
PERFECT, TRUNCATED, NO_DATA, MINOR, MAJOR, LENGTH_ONE, LENGTH_MANY = 1, 2, -1, -2, -3, -4, -5


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def sample_of_file(name: Column) -> Column:
    """The sample name in a .bam path."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(_\d{9}M?)?\.bam$", "")


def parse_sample(name: Column) -> list[Column]:
    """subject, disease, type and index of a sample name by either convention; all null for other names."""
    one, two = [[F.nullif(F.regexp_extract(name, p, i), F.lit("")) for i in (1, 2, 3, 4)] for p in (SAMPLE_V1, SAMPLE_V2)]
    index = _lookup(one[2], TYPE_INDEX)
    first, second = index.isNotNull(), two[2].isNotNull()
    prefix = F.lit("SJ")
    return [F.when(first, F.concat(prefix, one[0], one[1])).when(second, F.concat(prefix, two[1])).alias("subject"),
            F.when(first, one[0]).when(second, two[0]).alias("disease"),
            F.when(first, F.coalesce(_lookup(one[2], GENERIC_TYPE), one[2])).when(second, two[2]).alias("type"),
            F.when(first, index).when(second, two[3].cast("int")).alias("index")]


def tumor_normal(name: Column) -> Column:
    """T or N by the type of the sample, or by two loose patterns where the name follows no convention; null if neither fits."""
    base = F.regexp_replace(name, "^.*/", "")
    kind = F.coalesce(parse_sample(base)[2], *[F.nullif(F.regexp_extract(base, p, 1), F.lit("")) for p in LOOSE])
    return _lookup(kind, TUMOR_NORMAL)


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two texts of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def protein_versions(rows: DataFrame) -> DataFrame:
    """The latest version of each accession and every older one with a protein that no newer one has, with a note.

    Notes: latest, length change, or major or minor difference with the share of differing places (major from 0.04). Rows with
    a null or empty protein are left out.
    """
    known = rows.where(F.length("protein") > 0)
    newest = known.groupBy("accession", "protein").agg(F.max("version").alias("version"))
    latest = Window.partitionBy("accession").orderBy(F.desc("version"), "protein")
    last = newest.withColumns({"_top": F.first("protein").over(latest), "_n": F.row_number().over(latest)})
    share = mismatches(F.col("protein"), F.col("_top")) / F.length("protein")
    note = F.when(F.col("_n") == 1, "latest").when(F.length("protein") != F.length("_top"), "length change").otherwise(
        F.format_string("%s difference (%.3f)", F.when(share >= 0.04, "major").otherwise("minor"), F.bround(share, 3)))
    return last.select("accession", "version", "protein", note.alias("note"))


def older_versions(rows: DataFrame) -> DataFrame:
    """(id): accession.v for each version before that of an NM_ accession."""
    used = rows.where(F.col("accession").startswith("NM_") & (F.col("version") > 1))
    older = used.select("accession", F.explode(F.sequence(F.lit(1), F.col("version") - 1)).alias("v"))
    return older.select(F.concat("accession", F.lit("."), F.col("v").cast("string")).alias("id"))


def protein_of(rows: DataFrame, table: DataFrame, accession: str) -> DataFrame:
    """Add protein and gene of an accession; the protein also by the accession without what follows its first hyphen."""
    exact = table.select(F.col("accession").alias(accession), F.nullif("protein", F.lit("")).alias("_p1"), "gene")
    base = table.select(F.col("accession").alias("_base"), F.nullif("protein", F.lit("")).alias("_p2"))
    out = rows.join(exact, accession, "left").withColumn("_base", F.regexp_replace(accession, "-.*", ""))
    return out.join(base, "_base", "left").withColumn("protein", F.coalesce("_p1", "_p2")).drop("_base", "_p1", "_p2")


def aa_status(protein: Column, translated: Column, mappings: Column) -> Column:
    """Status of a translated sequence against the known protein, positive if it may be used."""
    share = mismatches(protein, translated) / F.length(protein)
    return (F.when(protein.isNull() | (protein == ""), NO_DATA).when(protein == translated, PERFECT)
            .when(F.length(protein) == F.length(translated), F.when(share >= 0.04, MAJOR).otherwise(MINOR))
            .when(protein.contains(translated), TRUNCATED).when(mappings == 1, LENGTH_ONE).otherwise(LENGTH_MANY))


def digest_proteins(rows: DataFrame, start: int = 10) -> DataFrame:
    """One row per fusion and protein (sample, genea, geneb, full, interstitial): samples, genes and the best ones.

    Rows with a stop between the anchors or no protein are left out. The best protein of a sample, and of the fusion, is the
    longest, the first in order among equals. unique_starts counts the starts of `start` letters within a fusion.
    """
    used = rows.where((F.length("full") > 0) & ~F.coalesce(F.col("interstitial").contains("*"), F.lit(False)))
    used = used.withColumn("fusion", F.concat_ws("_", "genea", "geneb"))
    best = used.groupBy("fusion", "sample").agg(F.min_by("full", F.struct(-F.length("full"), "full")).alias("full"))
    per = used.groupBy("fusion", "full").agg(F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("samples"), F.count_distinct("sample").alias("sample_count"))
    whole = used.groupBy("fusion").agg(F.min_by("full", F.struct(-F.length("full"), "full")).alias("_top"), F.count_distinct(F.substring("full", 1, start)).alias("unique_starts"))
    marked = per.join(best.select("fusion", "full").distinct().withColumn("_best", F.lit(1)), ["fusion", "full"], "left").join(whole, "fusion")
    return marked.select("fusion", "full", F.length("full").cast("long").alias("length"), "samples", "sample_count", "unique_starts",
                         F.coalesce("_best", F.lit(0)).alias("best_in_sample"), (F.col("full") == F.col("_top")).cast("int").alias("best_overall"))


def reconcile(wanted: Column, found: Column) -> list[Column]:
    """missing, additional, and both again once names that agree up to their first _ are matched; sorted arrays.

    With nothing wanted nothing is additional. Of several additional names with one prefix, the last in order is matched.
    """
    def prefix(x):
        return F.regexp_replace(x, "_.*", "")

    missing = F.array_sort(F.array_except(wanted, found))
    extra = F.when(F.size(wanted) > 0, F.array_sort(F.array_except(found, wanted))).otherwise(F.array().cast("array<string>"))
    matched = lambda x: F.exists(missing, lambda m: prefix(m) == prefix(x)) & ~F.exists(extra, lambda y: (prefix(y) == prefix(x)) & (y > x))
    return [missing.alias("missing"), extra.alias("additional"),
            F.filter(missing, lambda m: ~F.exists(extra, lambda x: prefix(x) == prefix(m))).alias("missing_adjusted"),
            F.filter(extra, lambda x: ~matched(x)).alias("additional_adjusted")]


def stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, variance and deviation of the population, and the upper median of each group; nulls are left out."""
    middle = F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)")
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("deviation"), middle.alias("median"))


def deciles(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, decile): the value at place floor(n * share), counted from 0, of each group in ascending order, or the last one."""
    by = Window.partitionBy(*keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = counts.withColumns({"_to": F.sum("_c").over(by.orderBy(value)), "_all": F.sum("_c").over(by)})
    place = F.least(F.floor(F.col("_all") * share), F.col("_all") - 1)
    return upto.where(F.col("_to") > place).groupBy(*keys).agg(F.min(value).alias("decile"))


def bucket(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rows, values, longest): count, sorted distinct values and the longest value, the first in order among equals."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(value)), ",").alias("values"),
                                 F.min_by(value, F.struct(-F.length(value), F.col(value))).alias("longest"))


def union_events(clips: DataFrame, junctions: DataFrame) -> DataFrame:
    """Both sets of events with `source` 1 for clips and 2 for junctions, the order in which they are taken."""
    return clips.withColumn("source", F.lit(1)).unionByName(junctions.withColumn("source", F.lit(2)), allowMissingColumns=True)


def stage_qc(stages: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(stage, rows, blank, message) of each stage: its rows, the checked columns that are all null or empty, and what is wrong."""
    out = None
    for name, rows in stages.items():
        blank = [F.when(F.count(F.nullif(F.col(c).cast("string"), F.lit(""))) == 0, F.lit(c)) for c in columns.get(name, [])]
        row = rows.agg(F.count("*").alias("rows"), F.concat_ws(",", *blank).alias("blank"))
        message = F.when(F.col("rows") == 0, "no rows").when(F.col("blank") != "", "empty columns").otherwise("ok")
        row = row.select(F.lit(name).alias("stage"), "rows", "blank", message.alias("message"))
        out = row if out is None else out.unionByName(row)
    return out


def excerpt(fusions: DataFrame, results: DataFrame) -> DataFrame:
    """Results with a frame over 0 whose name lists hold both genes of a wanted fusion (fusion, gene_from, gene_to)."""
    names = results.withColumns({"gene_from": F.explode(F.array_distinct(F.split("genea", ",")))}).withColumn("gene_to", F.explode(F.array_distinct(F.split("geneb", ","))))
    usable = F.exists(F.split("frame", ","), lambda f: f.try_cast("double") > 0)
    return names.where(usable).join(fusions.select("fusion", "gene_from", "gene_to").distinct(), ["gene_from", "gene_to"])


def reannotate(rows: DataFrame, pairs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the gene of `column` replaced by the one symbol (key, symbol) in frame, if there is exactly one; `note` says so."""
    one = pairs.where("symbol is not null").groupBy(key).agg(F.min("symbol").alias("_a"), F.max("symbol").alias("_b")).where("_a = _b")
    changed = F.coalesce((F.length(column) > 0) & (F.col("_a") != F.col(column)), F.lit(False))
    text = F.concat(F.lit(f"reannotated {column} from "), F.col(column), F.lit(" to "), F.col("_a"))
    out = rows.join(one, key, "left").withColumn("note", F.when(changed, text))
    return out.withColumn(column, F.when(changed, F.col("_a")).otherwise(F.col(column))).drop("_a", "_b")


def junction_indexes(frame: Column, a_end: Column, b_start: Column, offset: Column) -> list[Column]:
    """interstitial, contig_a and contig_b from the end of A (exclusive) and start of B in a frame, counted from 0."""
    last = a_end - 1
    between = F.when(b_start > last + 1, F.substring(frame, last + 2, b_start - last - 1)).otherwise("")
    return [between.alias("interstitial"), (last * 3 + offset + 2).alias("contig_a"), (b_start * 3 + offset).alias("contig_b")]


def approx_anchor(text: Column, part: Column, share: float = 0.04, least: int = 10) -> Column:
    """The place (from 1) at which `text` is most like `part`, at most `share` of its letters substituted; 0 if none is.

    The first of the best places counts; a part needs `least` equal letters.
    """
    n = F.length(part)
    most = F.floor(n * share).cast("int")
    letters = F.split(part, "")

    def distance(i):
        return F.size(F.filter(F.zip_with(F.split(F.substring(text, i, n), ""), letters, lambda x, y: x != y), lambda d: d))

    places = F.when((n > 0) & (F.length(text) >= n), F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    scored = F.filter(F.transform(places, lambda i: F.struct(distance(i).alias("d"), i.alias("i"))), lambda s: (s["d"] <= most) & (n - s["d"] >= least))
    return F.coalesce(F.array_min(scored)["i"], F.lit(0))


def best_match(hits: DataFrame, key: str, value: str) -> DataFrame:
    """(key, best): the highest value of each query."""
    return hits.groupBy(key).agg(F.max(value).alias("best"))


def repeat_score(pairs: DataFrame, hits: DataFrame, min_hit: int = 25) -> DataFrame:
    """(ord, repeat_left, repeat_right): 1 - matches / the sum of like matches of the contig's hits on that side; 0 without any.

    Pairs have ord, contig, left_matches and right_matches; hits have contig, qstart, qend, qlen and matches. Hits count with over
    `min_hit` matches in at least 75 % of their range and nearly as many as the end itself (10 fewer, or 90 % up to 100).
    """
    used = hits.where((F.col("matches") > min_hit) & (F.col("matches") / (F.col("qend") - F.col("qstart") + 1) >= 0.75))
    used = used.select("contig", F.when(F.col("qstart") + F.col("qend") < F.col("qlen"), "left").otherwise("right").alias("side"), "matches")
    ends = pairs.select("ord", "contig", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_matches").alias("own")),
                                                           F.struct(F.lit("right").alias("side"), F.col("right_matches").alias("own")))).alias("e")).select("ord", "contig", "e.*")
    least = F.when(F.col("own") > 100, F.col("own") - 10).otherwise(F.col("own") * 0.9)
    sums = ends.join(used, ["contig", "side"]).where(F.col("matches") >= least).groupBy("ord", "side").agg(F.sum("matches").alias("total"))
    score = ends.join(sums, ["ord", "side"], "left").withColumn("score", F.coalesce(1 - F.col("own") / F.col("total"), F.lit(0.0)))
    return score.groupBy("ord").agg(F.max(F.when(F.col("side") == "left", F.col("score"))).alias("repeat_left"),
                                    F.max(F.when(F.col("side") == "right", F.col("score"))).alias("repeat_right"))


def select_targets(hits: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first `most` hits by matches of each contig that meets its site, with `part` left or right.

    Hits have contig, site, tstart, tend, qstart, qend, qlen and matches. A contig meets its site if a hit starts or ends within
    15 bases; contigs with a hit within 25 bases of both their ends are left out. `order` decides among equals.
    """
    whole = (F.col("qstart") <= 25) & (F.col("qlen") - F.col("qend") <= 25)
    near = (F.abs(F.col("tstart") - F.col("site")) <= 15) | (F.abs(F.col("tend") - F.col("site")) <= 15)
    kept = hits.groupBy("contig").agg(F.bool_or(whole).alias("w"), F.bool_or(near).alias("n")).where("n and not w").select("contig")
    rank = F.row_number().over(Window.partitionBy("contig").orderBy(F.desc("matches"), order))
    out = hits.join(kept, "contig", "left_semi").withColumns({"part": F.when(F.col("qstart") <= 25, "left").otherwise("right"), "_n": rank})
    return out.where(F.col("_n") <= most).drop("_n")


def second_end_check(events: DataFrame, local: DataFrame, min_dist: int = 10_000, min_hit: int = 25) -> DataFrame:
    """Events (contig, matches, qlen) without those of contigs that map as well with both parts near one end.

    Local maps have contig, posa, posb, matcha and matchb. One drops all events of its contig if its ends are at most `min_dist`
    apart and it has the matches of an event, or over twice `min_hit` on both parts or all but that many of the contig.
    """
    total = F.col("matcha") + F.col("matchb")
    near = local.where(F.abs(F.col("posa") - F.col("posb")) <= min_dist).select("contig", total.alias("_t"), F.least("matcha", "matchb").alias("_l"))
    best = near.groupBy("contig").agg(F.max("_t").alias("_t"), F.max("_l").alias("_l"))
    need = events.groupBy("contig").agg(F.min("matches").alias("_m"), F.min("qlen").alias("_q"))
    bad = best.join(need, "contig").where((F.col("_t") >= F.col("_m")) | (F.col("_l") > 2 * min_hit) | (F.col("_t") > F.col("_q") - 2 * min_hit))
    return events.join(bad.select("contig"), "contig", "left_anti")


def pair_transcripts(pairs: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """(key, txa, txb): every coding transcript over the A end with every one over the B end; null where an end has none.

    The transcripts of a place are found once and kept as a list, the two lists of each different pair of places are cut into pieces of `LIST`
    and written, and a row unpacks the pieces that it meets: each row moves once for each two pieces, and not once for each pair.
    """
    sides = ["chra", "posa", "chrb", "posb"]
    deal = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: the pairs of a task do not show in the bytes it reads
    rows = pairs.select(key, F.struct(*sides).alias("_at"))
    met = rows.groupBy("_at").agg(F.count("*").alias("_rows"))
    ends = {e: met.select(F.col(f"_at.chr{e}").alias("chrom"), F.col(f"_at.pos{e}").alias("st"), F.col(f"_at.pos{e}").alias("en")) for e in "ab"}
    hits = interval_join(ends["a"].unionByName(ends["b"]).distinct(), transcripts.where("cds_st < cds_en").select("tx", "chrom", "st", "en"))
    lists = hits.groupBy("chrom", "st").agg(F.collect_list("r_tx").alias("txs"))
    for e in "ab":
        met = met.join(lists.select(F.struct("chrom", "st").alias(f"_on{e}"), F.col("txs").alias(f"_l{e}")), F.struct(f"_at.chr{e}", f"_at.pos{e}") == F.col(f"_on{e}"), "left").drop(f"_on{e}")
    def count(e: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(F.size(f"_l{e}"), F.lit(0)) / LIST))
    # a pair of places with many rows is spread over several tasks
    met = written(met.withColumns({"_na": count("a"), "_nb": count("b"), "_deals": F.ceil(F.col("_rows") / ROWS)}), "place_pairs")

    def dealt(df: DataFrame, deals: Column) -> DataFrame:
        """A row for each piece of A, piece of B and deal."""
        for c, of in (("_a", F.sequence(F.lit(0), F.col("_na") - 1)), ("_b", F.sequence(F.lit(0), F.col("_nb") - 1)), ("_d", deals)):
            df = df.withColumn(c, F.explode(of))
        return df

    pieces = dealt(met, F.sequence(F.lit(0), F.col("_deals") - 1))
    cut = [F.slice(f"_l{e}", (F.col(f"_{e}") * LIST + 1).cast("int"), LIST).alias(f"_p{e}") for e in "ab"]
    pieces = pieces.select(*[F.col(c).alias(f"_m{c}") for c in ("_at", "_a", "_b", "_d")], *cut)
    counts = met.select(F.col("_at").alias("_place"), "_na", "_nb", "_deals")
    rows = rows.join(counts, F.col("_at") == F.col("_place"))
    rows = dealt(rows, F.array(F.pmod(F.xxhash64(key), "_deals"))).select(key, "_at", "_a", "_b", "_d").repartition(deal, "_at", "_a", "_b", "_d")
    both = rows.join(pieces.hint("merge"), (F.col("_at") == F.col("_m_at")) & (F.col("_a") == F.col("_m_a")) & (F.col("_b") == F.col("_m_b")) & (F.col("_d") == F.col("_m_d")))
    # `coalesce` to the number it has moves nothing, but the second list is then unpacked row by row, where Spark else holds the product of both
    return both.select(key, F.explode_outer("_pa").alias("txa"), "_pb").coalesce(deal).select(key, "txa", F.explode_outer("_pb").alias("txb"))


def salvage_nearest(points: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """(key, tx): the coding transcripts of the point's gene on its chrom nearest to it, ties kept; distances are negative inside. `key` is unique.

    Nearest is the next start after a point or the farthest end of those that start up to it, both found by a sweep; only the transcripts with
    that start or end meet the point.
    """
    name = ["gene", "chrom"]
    tx = transcripts.where("cds_st < cds_en").select(*name, "tx", "st", "en").dropna(subset=["st", "en"])
    points = points.select(key, *name, "pos")
    blank = F.lit(None).cast("long")
    asked = points.select(*name, F.col("pos").alias("at")).distinct().select(*name, "at", F.lit(1).alias("late"), blank.alias("en"))
    rows = tx.select(*name, F.col("st").alias("at"), F.lit(0).alias("late"), "en").unionByName(asked).dropna(subset=[*name, "at"])
    down = running_max(rows, name, "at", ["late"], {"reach": F.col("en")}).withColumn("back", -F.col("at"))
    # starts at the place itself lie before it, so going back they come after it
    both = running_max(down.withColumn("first", 1 - F.col("late")), name, "back", ["first"], {"next": F.when(F.col("late") == 0, F.col("back"))})
    found = both.where("late = 1").select(*name, F.col("at").alias("pos"), "reach", (-F.col("next")).alias("next"))
    least = F.least(F.col("pos") - F.col("reach"), F.col("next") - F.col("pos"))
    found = found.withColumn("least", least).where("least is not null")
    ahead = found.where("next - pos = least").join(tx.withColumnRenamed("st", "next").drop("en"), [*name, "next"])
    inside = found.where("pos - reach = least").join(tx.withColumnRenamed("en", "reach"), [*name, "reach"]).where("st <= pos")
    met = ahead.select(*name, "pos", "tx").unionByName(inside.select(*name, "pos", "tx"))
    return points.join(met, [*name, "pos"]).select(key, "tx")


def junctions_over_cutoff(junctions: DataFrame, genes: DataFrame, key: str, near: int = 5000) -> DataFrame:
    """Junctions with at least the mean cut-off of the genes at both ends, or, without genes, 1 % of the depth at an end.

    Junctions have key, chra, posa, chrb, posb, perfect, flanking, deptha and depthb; genes have chrom, strand, st, en and cutoff.
    The highest cut-off of each end within `near` counts by strand (-1 without a gene), and the strand with the higher mean.
    """
    place = ["chrom", "st", "en"]
    ends = [junctions.select(F.col(f"chr{x}").alias("chrom"), (F.col(f"pos{x}") - near).alias("st"), (F.col(f"pos{x}") + near).alias("en")) for x in "ab"]
    highest = F.max("cutoff").alias("cutoff")
    met = overlap_nodes(ends[0].unionByName(ends[1]), genes.select("chrom", "strand", "st", "en", "cutoff"), lambda rows, keys: rows.groupBy(*keys, "strand").agg(highest))
    high = met.groupBy(*place, "strand").agg(highest).groupBy(*place).agg(F.collect_list(F.struct("strand", "cutoff")).alias("high"))  # a row for each strand
    out = junctions
    for x in "ab":
        out = out.join(high.select(F.col("chrom").alias(f"chr{x}"), (F.col("st") + near).alias(f"pos{x}"), F.col("high").alias(f"_{x}")), [f"chr{x}", f"pos{x}"], "left")

    def means(x: str, y: str) -> Column:
        """The means of the strands of one end."""
        other = lambda e: F.get(F.filter(y, lambda o: o["strand"].eqNullSafe(e["strand"])), F.lit(0))["cutoff"]
        return F.coalesce(F.transform(x, lambda e: (F.coalesce(e["cutoff"], F.lit(-1.0)) + F.coalesce(other(e), F.lit(-1.0))) / 2), F.array().cast("array<double>"))

    out = out.withColumn("_cutoff", F.array_max(F.concat(means("_a", "_b"), means("_b", "_a"))))
    cutoff = F.greatest(F.coalesce("_cutoff", F.lit(-1.0)), F.lit(-1.0))
    deep = (F.col("deptha") * F.col("depthb") > 0) & ((F.col("flanking") >= F.col("deptha") * 0.01) | (F.col("flanking") >= F.col("depthb") * 0.01))
    return out.where((F.col("perfect") >= cutoff) & ((cutoff != -1) | deep)).select(*junctions.columns)


def internal_events(rows: DataFrame, windows: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """All events but internal ones that do not qualify; rows have ord, genea, posa, posb, type, reads and cutoff.

    An internal event must be a duplication, of a gold gene or, without a gold list, inside a window (gene, st, en) of its gene. Outside
    a window it needs ten reads and five times the cut-off.
    """
    marked = with_itd(rows, windows)
    listed = F.col("in_itd") if gold is None else F.col("_gold")
    marked = marked if gold is None else with_name(marked, "genea", gold, "_gold")
    enough = F.col("in_itd") | ((F.col("reads") >= 5 * F.col("cutoff")) & (F.col("reads") >= 10))
    ok = ~F.col("type").contains("Internal") | ((F.col("type") == "Internal_dup") & listed & enough)
    return marked.where(ok).select(*rows.columns)


def intergenic_sites(sites: DataFrame, genes: DataFrame, key: str, least: int = 5) -> DataFrame:
    """Sites (key, chrom, st, en, reads) with `least` reads or more in none of the expressed genes."""
    place = ["chrom", "st", "en"]
    met = overlap_nodes(sites, genes.select(*place), lambda rows, keys: rows.select(*keys).distinct()).select(*place).distinct()
    inside = sites.join(met, place, "left_semi").select(key).distinct()
    return sites.where(F.col("reads") >= least).join(inside, key, "left_anti")


def enhancer_gene(points: DataFrame, genes: DataFrame, names: DataFrame, key: str, feature, reach: int = 1_000_000) -> DataFrame:
    """(key, gene, feature, same_strand) of the listed gene within `reach` of a point (key, chrom, pos, strand).

    The first coding gene of the point's strand is taken, else the first coding one of the other strand, else the last gene of the
    other strand, else of its own. Genes are in order of start, then by name; `feature` is the feature column of the joined pair, of the gene's columns
    (r_*), st and any further columns of the points. Points alike in these are looked up once.
    """
    used = genes.join(names.select("gene").distinct(), "gene", "left_semi")
    more = [c for c in points.columns if c not in (key, "chrom", "pos", "strand")]
    points = points.select(key, "chrom", F.col("pos").alias("st"), F.col("strand").alias("own"), *more)
    place = [c for c in points.columns if c != key]
    hits = interval_join(points.select(*place).distinct().withColumn("en", F.col("st")), used, width=100_000, pad=reach)
    rows = hits.withColumns({"feature": feature, "same": F.col("r_strand") == F.col("own")})
    coding = F.col("feature") == "coding"
    tier = F.when(coding, F.when(F.col("same"), 0).otherwise(1)).otherwise(F.when(F.col("same"), 3).otherwise(2))
    first, last = F.when(coding, F.col("r_st")).otherwise(-F.col("r_st")), F.col("r_gene")
    best = rows.groupBy(*place).agg(F.min_by(F.struct(F.col("r_gene").alias("gene"), "feature", F.col("same").alias("same_strand")), F.struct(tier, first, last)).alias("b"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in place], "b")
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    return points.join(best, alike).select(key, "b.*")
