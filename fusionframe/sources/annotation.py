"""Annotation records of the flat-file format: feature tables, location expressions and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a transcript variant that is neither a number nor one letter.
OTHER_VARIANT = 9999


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row for each record of the files, cut at lines of `//`."""
    return spark.read.text(path, lineSep="\n//").where("value rlike '(?m)^LOCUS'").select(F.ltrim("value").alias("value"))


def _line(text: Column, word: str) -> Column:
    """The text of a header entry with its continuation lines, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?ms)^{word}\s+(.*?)(?=^\S|\z)", 1), r"\s+", " "))


def _features(text: Column, kind: str) -> Column:
    """The texts of all features of a kind, each from its location on."""
    return F.regexp_extract_all(text, F.lit(rf"(?ms)^ {{5}}{kind} {{2,}}(.*?)(?=^ {{5}}\S|^\S|\z)"), F.lit(1))


def _values(feature: Column, tag: str) -> Column:
    return F.regexp_extract_all(feature, F.lit(rf'(?s)/{tag}="([^"]*)"'), F.lit(1))


def _set(lists: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(lists))), ",")


def location(feature: Column) -> Column:
    """(st, en, complement, parts): the location in front of a feature's tags; it may run over lines and nest join, order and complement.

    parts are the ranges (st, en) in the order written; a single base is a range of one, and marks of open ends are passed over.
    """
    text = F.regexp_replace(F.regexp_extract(feature, r"(?s)^(.*?)(?=\n\s*/|\z)", 1), r"[\s<>]", "")
    ranges = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\.\d+)?)"), F.lit(1))
    parts = F.transform(ranges, lambda r: F.struct(F.substring_index(r, "..", 1).cast("long").alias("st"), F.substring_index(r, "..", -1).cast("long").alias("en")))
    return F.struct(F.array_min(F.transform(parts, lambda p: p["st"])).alias("st"), F.array_max(F.transform(parts, lambda p: p["en"])).alias("en"), text.contains("complement(").alias("complement"), parts.alias("parts"))


def _known(records: DataFrame) -> DataFrame:
    """The records of transcripts (NM_, NR_) with accession, version, desc, gene and their CDS features."""
    text = F.col("value")
    rows = records.where(F.regexp_extract(text, r"(?m)^LOCUS\s+(\w+)", 1).rlike("^N[MR]_"))
    genes = _set(F.transform(_features(text, "gene"), lambda f: F.slice(_values(f, "gene"), 1, 1)))
    return rows.select(
        F.regexp_extract(text, r"(?m)^ACCESSION\s+(\S+)", 1).alias("accession"), F.regexp_extract(text, r"(?m)^VERSION\s+\S+\.(\d+)", 1).cast("int").alias("version"),
        F.regexp_replace(_line(text, "DEFINITION"), r"\.$", "").alias("desc"), genes.alias("gene"), _features(text, "CDS").alias("cds"), text.alias("value"))


def protein_table(records: DataFrame) -> DataFrame:
    """(accession, version, gi, gene, protein, variant, variant_numeric, accession_versioned, cds_count) of the records (value).

    gi is that of the protein. The variant is what the description calls `transcript variant` up to a comma: a number counts as it is, one letter by its
    place in the alphabet, all else as 9999. Records without CDS have an empty protein; of several the first counts, and cds_count tells.
    """
    rows = _known(records)
    first = F.coalesce(F.get("cds", F.lit(0)), F.lit(""))
    protein = F.regexp_replace(F.coalesce(F.get(_values(first, "translation"), F.lit(0)), F.lit("")), r"\s", "")
    gi = F.filter(_values(first, "db_xref"), lambda v: v.startswith("GI:"))
    variant = F.regexp_extract("desc", "transcript variant ([^,]+)", 1)
    letter = F.ascii(F.upper(variant)) - 64
    number = F.when(variant.rlike(r"^\d+$"), variant.cast("long")).when(variant.rlike("^[A-Za-z]$"), letter.cast("long")).otherwise(OTHER_VARIANT)
    return rows.select("accession", "version", F.coalesce(F.substring(F.element_at(F.when(F.size(gi) > 0, gi), -1), 4, 1 << 20), F.lit("")).alias("gi"), "gene", protein.alias("protein"), variant.alias("variant"),
                       number.cast("long").alias("variant_numeric"), F.concat_ws(".", "accession", F.col("version").cast("string")).alias("accession_versioned"), F.size("cds").alias("cds_count"))


def transcript_sequences(records: DataFrame, cds_only: bool = False) -> DataFrame:
    """(accession, title, seq) of the records: the versioned accession, the FASTA title and the upper-case sequence.

    With cds_only the sequence is cut to the range of the first CDS; records without one have an empty sequence then.
    """
    rows = _known(records)
    body = F.regexp_extract("value", r"(?ms)^ORIGIN[^\n]*\n(.*?)(?=^//|\z)", 1)
    seq = F.regexp_replace(F.upper(body), "[^A-Z]", "")
    at = location(F.get("cds", F.lit(0)))
    if cds_only:
        seq = F.coalesce(F.substring(seq, at["st"].cast("int"), (at["en"] - at["st"] + 1).cast("int")), F.lit(""))
    maps = _set(F.transform(_features(F.col("value"), "source"), lambda f: _values(f, "map")))
    accession = F.concat_ws(".", "accession", F.col("version").cast("string"))
    title = F.concat(accession, F.lit(" "), F.col("desc"), F.lit(" /gene="), F.col("gene"), F.when(maps != "", F.concat(F.lit(" /map="), maps)).otherwise(""))
    return rows.select(accession.alias("accession"), title.alias("title"), seq.alias("seq"))
