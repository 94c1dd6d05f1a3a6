"""Readers and writers of the domain's text files; each returns or takes a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAM_FIELDS = ("qname string, flag int, chrom string, st long, mapq int, cigar string, mate_chrom string, mate_st long, tlen long, seq string, qual string")


def read_sam_text(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed fields of SAM text lines; header lines are passed over, mate_chrom `=` is the read's own chrom."""
    part = F.split("value", "\t")
    fields = [f.split() for f in SAM_FIELDS.split(", ")]
    rows = spark.read.text(path).where("value not like '@%' and value <> ''").select(*[part[i].cast(t).alias(n) for i, (n, t) in enumerate(fields)])
    return rows.withColumn("mate_chrom", F.when(F.col("mate_chrom") == "=", F.col("chrom")).otherwise(F.col("mate_chrom")))


def read_refflat(spark: SparkSession, path: str, skip_nr: bool = True, canonical: bool = True, strip_suffix: bool = True) -> DataFrame:
    """Transcripts (gene, tx, chrom, strand, st, en, cds_st, cds_en, exons) of refFlat lines of 11 columns or 16 (with a bin in front).

    Starts are made 1-based. Comments, other widths and lines whose exon count differs from their lists are passed over, as are
    NR_ accessions and other than canonical chroms if asked; _locX and -locX endings of names go.
    """
    raw = spark.read.text(path).where("value not like '#%'").select(F.split("value", "\t").alias("p")).where(F.size("p").isin(11, 16))
    wide = F.size("p") == 16

    def field(narrow: int, broad: int) -> Column:
        return F.when(wide, F.get("p", F.lit(broad))).otherwise(F.get("p", F.lit(narrow)))

    def places(text: Column) -> Column:
        return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("long"))

    rows = raw.select(field(0, 12).alias("gene"), field(1, 1).alias("tx"), field(2, 2).alias("chrom"), field(3, 3).alias("strand"),
                      (field(4, 4).cast("long") + 1).alias("st"), field(5, 5).cast("long").alias("en"), (field(6, 6).cast("long") + 1).alias("cds_st"),
                      field(7, 7).cast("long").alias("cds_en"), field(8, 8).cast("int").alias("n"), places(field(9, 9)).alias("s"), places(field(10, 10)).alias("e"))
    rows = rows.where((F.size("s") == F.col("n")) & (F.size("e") == F.col("n")))
    if skip_nr:
        rows = rows.where("tx not like 'NR\\\\_%'")
    if canonical:
        rows = rows.where(F.col("chrom").rlike("^(chr)?([0-9]{1,2}|X|Y|M|MT)$"))
    if strip_suffix:
        rows = rows.withColumn("gene", F.regexp_replace("gene", "[-_]loc[A-Z]+$", ""))
    exons = F.zip_with("s", "e", lambda a, b: F.struct((a + 1).alias("st"), b.alias("en")))
    return rows.select("gene", "tx", "chrom", "strand", "st", "en", "cds_st", "cds_en", exons.alias("exons"))


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    """A junction table with header, its `chrom:pos:strand,chrom:pos:strand` key parsed as well."""
    from fusionframe.functions.columns import parse_junction
    rows = spark.read.csv(path, sep="\t", header=True)
    numbers = [c for c in rows.columns if c == "count" or c.startswith("qc_")]
    return rows.withColumns({c: F.col(c).cast("long") for c in numbers}).select("*", *parse_junction(F.col("junction")))


#: Columns of the lookup lists by kind; a header line is told by its first field.
LOOKUPS = {"excluded_genes": "gene string", "gold_genes": "gene string", "known_fusions": "genea string, geneb string",
           "itd_windows": "gene string, chrom string, st long, en long", "complex_regions": "name string, chrom string, st long, en long",
           "excluded_fusions": "chra string, posa long, chrb string, posb long", "breakpoints": "chrom string, pos long",
           "excluded_regions": "chrom string, st long, en long, type string", "chrom_lengths": "chrom string, len long"}


def read_lookup(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A tab-separated list of one of the kinds of `LOOKUPS`; lines without its numbers (headers) and empty lines are passed over."""
    fields = [f.split() for f in LOOKUPS[kind].split(", ")]
    part = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(
        *[F.expr(f"try_cast(get(split(value, '\t'), {i}) as {t})").alias(n) for i, (n, t) in enumerate(fields)])
    numbers = [n for n, t in fields if t == "long"]
    return rows.dropna(subset=numbers) if numbers else rows


def detect_layout(spark: SparkSession, path: str, lines: int = 30) -> tuple[str, int]:
    """(delimiter, field count): tab or comma by vote of the first `lines` lines, and the most frequent number of fields."""
    sample = [r.value for r in spark.read.text(path).where("value not like '#%'").limit(lines).collect()]
    votes = {d: sum(line.count(d) > 0 for line in sample) for d in ("\t", ",")}
    delimiter = "\t" if votes["\t"] >= votes[","] else ","
    counts = [len(line.split(delimiter)) for line in sample]
    return delimiter, max(sorted(set(counts)), key=counts.count) if counts else 0


def read_delimited(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A delimited file by its own layout; lines of another width are passed over."""
    delimiter, width = detect_layout(spark, path)
    return spark.read.csv(path, sep=delimiter, header=header, mode="DROPMALFORMED")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of FASTA records."""
    record = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    return record.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("name"),
                         F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def chunked(sequences: DataFrame, size: int = 10_000) -> DataFrame:
    """(name, chunk, seq) pieces of `size` bases, numbered from 0."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / size)))
    return sequences.select("name", "seq", at.alias("chunk")).select("name", "chunk", F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def base_range(chunks: DataFrame, ranges: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """(key, seq) of ranges (chrom, st, en), 1-based and closed, put together from the chunks they touch."""
    asked = ranges.select(key, "chrom", "st", "en", F.explode(F.sequence(F.floor((F.col("st") - 1) / size), F.floor((F.col("en") - 1) / size))).alias("chunk"))
    got = asked.join(chunks.select(F.col("name").alias("chrom"), "chunk", "seq"), ["chrom", "chunk"])
    first = F.greatest(F.col("st") - F.col("chunk") * size, F.lit(1))
    part = F.substring("seq", first.cast("int"), (F.least(F.col("en") - F.col("chunk") * size, F.lit(size)) - first + 1).cast("int"))
    parts = got.select(key, F.struct("chunk", part.alias("part")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select(key, F.array_join(F.col("p.part"), "").alias("seq"))


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rows of PSL lines with 1-based starts and blocks as an array of (qst, tst, len); header lines are passed over."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("value rlike '^[0-9]+\t'").select(p.alias("p")).where(F.size("p") >= 21)

    def at(i: int, kind: str) -> Column:
        return F.col("p")[i].cast(kind)

    def numbers(i: int) -> Column:
        return F.transform(F.filter(F.split(F.col("p")[i], ","), lambda x: x != ""), lambda x: x.cast("long"))

    blocks = F.transform(F.arrays_zip(numbers(18), numbers(19), numbers(20)), lambda b: F.struct((b["1"] + 1).alias("qst"), (b["2"] + 1).alias("tst"), b["0"].alias("len")))
    return rows.select(at(0, "long").alias("matches"), at(8, "string").alias("strand"), at(9, "string").alias("query"), at(10, "long").alias("qsize"), (at(11, "long") + 1).alias("qst"),
                       at(12, "long").alias("qen"), at(13, "string").alias("target"), (at(15, "long") + 1).alias("tst"), at(16, "long").alias("ten"), blocks.alias("blocks"))


def union_files(spark: SparkSession, paths: list[str], dedup: bool = False) -> DataFrame:
    """Rows of tab-separated files with the same header, which is checked; empty files are passed over."""
    frames = [spark.read.csv(p, sep="\t", header=True) for p in paths]
    frames = [f for f in frames if f.columns]
    if not frames:
        raise ValueError("all files are empty")
    out = frames[0]
    for f, p in zip(frames[1:], paths[1:]):
        if f.columns != out.columns:
            raise ValueError(f"another header in {p}")
        out = out.unionAll(f)
    return out.distinct() if dedup else out


def write_tsv(rows: DataFrame, path: str, layout: list[tuple[str, str | None]]) -> None:
    """A tab-separated file of the layout's columns in order, numbers by their printf format where one is given."""
    cells = [(F.format_string(f, F.col(c)) if f else F.col(c).cast("string")).alias(c) for c, f in layout]
    rows.select(*cells).write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def reshape(rows: DataFrame, rename: dict | None = None, first: dict | None = None, last: dict | None = None, remove: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Columns renamed, removed by name or pattern, and constants put in front or behind."""
    import re
    kept = [c for c in rows.columns if c not in (remove or []) and not (pattern and re.search(pattern, c))]
    new = [F.col(c).alias((rename or {}).get(c, c)) for c in kept]
    return rows.select(*[F.lit(v).alias(k) for k, v in (first or {}).items()], *new, *[F.lit(v).alias(k) for k, v in (last or {}).items()])


def missing_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): rows with a null or empty value."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "missing"))


def check_widths(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """(fields, lines): how many lines have each number of fields; one row for a sound file."""
    return spark.read.text(path).groupBy(F.size(F.split("value", delimiter)).alias("fields")).agg(F.count("*").alias("lines"))


def check_unique(columns: list[str]) -> None:
    """Raise for a header with a repeated name."""
    twice = sorted({c for c in columns if columns.count(c) > 1})
    if twice:
        raise ValueError(f"repeated columns: {twice}")
