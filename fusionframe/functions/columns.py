"""Column functions on sequences, ranges, pairs and flags."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def revcomp(seq: Column) -> Column:
    """Reverse complement of upper-case ACGT; other letters stay."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical_seq(seq: Column) -> Column:
    """The same value for a sequence and its reverse complement."""
    return F.least(seq, revcomp(seq))


def is_garbage(seq: Column) -> Column:
    """Five unknown bases in a row, or over 30 % of them."""
    unknown = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    return seq.rlike("N{5,}") | (unknown > F.length(seq) * 0.3)


def overlap_len(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common length of two closed intervals."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def pair_key(a: Column, b: Column) -> Column:
    """One key for a pair of names, whichever comes first."""
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def flag_is(flag: Column, bit: int) -> Column:
    """Whether a bit of the flag is set; null for a null flag."""
    return flag.bitwiseAND(F.lit(bit)) != 0


def norm_chrom(name: Column, with_prefix: bool = True) -> Column:
    """Chrom names in the style of a reference: with or without the prefix `chr`."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.concat(F.lit("chr"), bare) if with_prefix else bare


def norm_chrom_like(name: Column, template: Column) -> Column:
    """The name with a `chr` prefix exactly if the template has one."""
    bare = F.regexp_replace(name, "^chr", "")
    return F.when(template.contains("chr"), F.concat(F.lit("chr"), bare)).otherwise(bare)


def parse_range(text: Column) -> list[Column]:
    """chrom, st and en of `chrom:start-end`; st and en are null where that part is missing."""
    pattern = r"^([^:]+)(?::(\d+))?(?:-(\d+))?$"
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return [F.nullif(parts[0], F.lit("")).alias("chrom"), F.nullif(parts[1], F.lit("")).cast("long").alias("st"),
            F.nullif(parts[2], F.lit("")).cast("long").alias("en")]


def sign_code(value: Column, mode: str = "c") -> Column:
    """Mode c: -, = or +; mode d: -1, 0 or 1."""
    if mode == "d":
        return F.signum(value).cast("int")
    return F.when(value < 0, "-").when(value > 0, "+").otherwise("=")


#: Ambiguity codes and their complements.
IUPAC, IUPAC_COMPLEMENT = "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"


def complement(seq: Column) -> Column:
    """Complement of ambiguity codes, case kept."""
    return F.translate(seq, IUPAC, IUPAC_COMPLEMENT)


def revcomp_iupac(seq: Column) -> Column:
    return complement(F.reverse(seq))


def cigar_ops(cigar: Column) -> Column:
    """Array of (len, op) of a CIGAR text."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def ref_span(cigar: Column) -> Column:
    """Reference bases that an alignment covers (M, D, N, = and X)."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def clip_len(cigar: Column, side: str) -> Column:
    """Soft-clipped bases at the start (side -) or the end (side +); 0 if none."""
    pattern = r"^(\d+)S" if side == "-" else r"(\d+)S$"
    return F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))


def quality_count(qual: Column, least: int = 20) -> Column:
    """Bases of a SAM quality text with a quality of at least `least`."""
    return F.length(F.regexp_replace(qual, f"[!-{chr(33 + least - 1)}]", ""))


def is_high_quality(qual: Column) -> Column:
    """Over 80 % of the bases but one have a quality of 20 or more (the rule divides by length - 1)."""
    return quality_count(qual) * 100 > (F.length(qual) - 1) * 80


def most_common_base(seq: Column) -> Column:
    """How often the most frequent of A, C, G and T occurs."""
    return F.greatest(*[F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in "ACGT"])


@F.pandas_udf(StringType())
def mask_tandem(seqs: pd.Series, least: pd.Series) -> pd.Series:
    """Runs of one unit repeated at least `least` times, as N of the same length."""
    return pd.Series([None if s is None else re.sub(r"(.+?)\1{%d,}" % (n - 1), lambda m: "N" * len(m.group()), s) for s, n in zip(seqs, least)])


def low_complexity_clip(seq: Column) -> Column:
    """One base in over 80 % of the places, or at least 60 % in tandem runs of four units or more."""
    masked = mask_tandem(seq, F.lit(4))
    n = F.length(masked) - F.length(F.replace(masked, F.lit("N"), F.lit("")))
    return (most_common_base(seq) > F.length(seq) * 0.8) | (n >= F.length(seq) * 0.6)


@F.pandas_udf(BooleanType())
def _masked_stretch(masked: pd.Series) -> pd.Series:
    return pd.Series([s is not None and ("N" * 20 in s or any(s.count("N", i, i + 25) > 20 for i in range(len(s) - 25))) for s in masked])


def low_complexity_junction(seq: Column) -> Column:
    """With tandem runs of ten units or more masked: 20 masked bases in a row, or over 20 within 25."""
    return _masked_stretch(mask_tandem(seq, F.lit(10)))


def cook_chrom(name: Column) -> Column:
    """Canonical chrom name without prefix: 23, 24 and 25 are X, Y and MT, and M is MT."""
    bare = F.upper(F.regexp_replace(F.trim(name), "(?i)^chr", ""))
    return F.when(bare == "23", "X").when(bare == "24", "Y").when(bare.isin("25", "M"), "MT").otherwise(bare)


def name_candidates(name: Column) -> Column:
    """Spellings of a chrom name in the order they are tried: exact, with and without chr, M for MT and back."""
    bare = F.regexp_replace(name, "(?i)^chr", "")
    twin = F.when(F.upper(bare) == "M", "MT").when(F.upper(bare) == "MT", "M")
    return F.array_distinct(F.filter(F.array(name, bare, F.concat(F.lit("chr"), bare), twin, F.concat(F.lit("chr"), twin)), lambda x: x.isNotNull()))


def parse_junction(text: Column) -> list[Column]:
    """chra, posa, stranda, chrb, posb, strandb of `chrom:pos:strand,chrom:pos:strand`."""
    part = F.split(text, "[:,]")
    names = ["chra", "posa", "stranda", "chrb", "posb", "strandb"]
    return [(part[i].cast("long") if "pos" in n else part[i]).alias(n) for i, n in enumerate(names)]


def derive_bp(ort: Column, strand: Column, tstart: Column, tend: Column, qstart: Column, qend: Column) -> list[Column]:
    """tpos, qpos and clip of one end: the target end if strand and orientation agree, else its start."""
    return [F.when(strand * ort > 0, tend).otherwise(tstart).alias("tpos"), F.when(ort > 0, qend).otherwise(qstart).alias("qpos"), (strand * ort).alias("clip")]


def log_dbinom(n: Column, k: Column, p: float) -> Column:
    """Logarithm of the binomial density, by sums of logarithms."""
    choose = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0),
                         lambda acc, i: acc + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))
    return choose + k * math.log(p) + (n - k) * math.log(1 - p)


def dbinom(n: Column, k: Column, p: float) -> Column:
    return F.exp(log_dbinom(n, k, p))


def smallest_cover(count: int, p: float, crit: float) -> int:
    """The smallest depth at which `count` or fewer successes have a probability below `crit`."""
    n = count
    while sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
              for k in range(count + 1)) >= crit:
        n += 1
    return n


def split_names(names: Column) -> Column:
    """Names of a list joined by commas or bars."""
    return F.split(names, "[,|]")


def junction_window(seq: Column, qpos: Column, flank: int = 30) -> Column:
    """The `2 * flank` bases around qpos; null too near to either end."""
    return F.when((qpos > flank) & (qpos < F.length(seq) - flank), F.substring(seq, qpos.cast("int") - flank + 1, F.lit(2 * flank)))


def annot_field(items: list[Column], unique: bool = True) -> Column:
    """Items joined by semicolons, empty and null ones left out, each once if `unique`."""
    kept = F.filter(F.array(*items), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(kept) if unique else kept, ";")


def tagged(tag: str, value: Column) -> Column:
    """`tag=value`, with commas between the values of an array; null for a null value."""
    return F.concat(F.lit(tag + "="), value)


def join_list(values: Column) -> Column:
    """All places of an array joined by commas, blank where null."""
    return F.array_join(values, ",", "")


def float_trim(text: Column, precision: int | None = None) -> Column:
    """Decimal texts without a leading 0 before the point and without closing zeros; other texts stay."""
    value = text
    if precision:
        long = F.length(F.regexp_extract(text, r"\.(\d+)$", 1)) > precision
        value = F.when(long, F.format_string(f"%.{precision}f", text.cast("double"))).otherwise(text)
    cut = F.regexp_replace(F.regexp_replace(value, r"^([-+]?)0\.", "$1."), r"0+$", "")
    zero = F.regexp_replace(cut, r"^([-+]?)\.$", "$10")
    return F.when(text.rlike(r"^[-+]?\d+\.\d+$"), zero).otherwise(text)


def clean_text(text: Column) -> Column:
    """Without outer white space and without one pair of matching quotes."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^(['\"])(.*)\1$", "$2")


def format_duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds that are not zero, as `1d 2h 3m 4s`; `0s` for none."""
    total = F.floor(seconds).cast("long")
    parts = [(F.floor(total / 86400), "d"), (F.floor(total % 86400 / 3600), "h"), (F.floor(total % 3600 / 60), "m"), (total % 60, "s")]
    text = F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in parts])
    return F.when(text == "", "0s").otherwise(text)


def shares_name(a: Column, b: Column) -> Column:
    """Whether two name lists share a name."""
    return F.arrays_overlap(split_names(a), split_names(b))


def same_gene(a: Column, b: Column) -> Column:
    """Whether two name lists share a name; false where the first pair of NA and NA comes before it."""
    pairs = F.flatten(F.transform(split_names(a), lambda x: F.transform(split_names(b), lambda y: F.when((x == "NA") & (y == "NA"), 0).when(x == y, 1))))
    return F.coalesce(F.get(F.filter(pairs, lambda v: v.isNotNull()), F.lit(0)), F.lit(0)) == 1


def collapse_genes(names: Column, single: bool = False) -> Column:
    """A sorted name array without read-through names of its members, then without orf, LOC and ENSG names unless all are."""
    out = F.array_sort(F.array_distinct(names))
    plain = F.transform(F.filter(out, lambda g: ~g.contains("-")), F.lower)
    out = F.filter(out, lambda g: ~(g.contains("-") & F.arrays_overlap(F.split(F.lower(g), "-"), plain)))
    for pattern in (r"(?i)^\w\d+orf\d+$", "^LOC", "^ENSG"):
        rest = F.filter(out, lambda g: ~g.rlike(pattern))
        out = F.when(F.size(rest) > 0, rest).otherwise(out)
    return F.slice(out, 1, 1) if single else out
