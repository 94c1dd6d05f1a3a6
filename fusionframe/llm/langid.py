"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_but, load

PIECE = 4096  # characters compressed at a time, so that a long text keeps meeting the dictionary


def learn(labelled: DataFrame, sample_rows: int = 400, dict_bytes: int = 65536, piece_chars: int = 200) -> dict[str, bytes]:
    """Raw dictionaries by language, from rows of (text, lang).

    The fit uses a bounded sample: per language about `sample_rows` distinct texts, chosen by a hash of the text. They are cut
    into pieces of `piece_chars` characters from end to end, and where these are more than about `dict_bytes` together, as many
    are kept by a hash of text and place, so that all parts of all sampled texts count alike. Every language gets a
    dictionary; rows with null text or lang are not used.
    """
    rows = labelled.where("text is not null and lang is not null and text rlike '\\\\p{L}'").select("lang", "text")
    different = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = {r.lang: r.n for r in different.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return {}
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample_rows / n)))])
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6
    sample = (rows.where(place < share[F.col("lang")]).select("lang", F.xxhash64("text").alias("h"), F.lower("text").alias("text"))
              .dropDuplicates(["lang", "h"]))
    sizes = sample.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    starts = F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(piece_chars)))
    pieces = sample.select("lang", "h", "text", starts.alias("at")).join(F.broadcast(sizes), "lang")  # one row for each language
    kept = pieces.where(F.pmod(F.xxhash64("h", "at"), F.lit(1_000_000)) / 1e6 * F.col("bytes") < dict_bytes)
    texts = kept.select("lang", "h", "at", F.col("text").substr(F.col("at"), F.lit(piece_chars)).alias("piece"))
    joined = texts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("h", "at", "piece"))).alias("pieces")).collect()  # about dict_bytes each
    return {r.lang: " ".join(x.piece for x in r.pieces).encode("utf-8") for r in joined}


@functools.lru_cache(maxsize=4)
def _compressors(dicts: tuple, level: int):
    made = []
    for lang, data in dicts:
        raw = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        made.append((lang, zstd.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False)))
    return made


def classify(text: str | None, dicts: tuple, level: int, margin: float) -> tuple[str, float, bool]:
    """(language, score, accepted): the language whose dictionary leaves the fewest bytes."""
    if not dicts or not text or not any(ch.isalpha() for ch in text):
        return "und", 0.0, False
    low = text.lower()
    pieces = [low[i:i + PIECE].encode("utf-8") for i in range(0, len(low), PIECE)]
    sizes = np.array([sum(len(c.compress(p)) for p in pieces) for _, c in _compressors(dicts, level)], dtype=float)
    best = int(sizes.argmin())
    second = np.partition(sizes, 1)[1] if len(sizes) > 1 else sizes[best]
    narrow = len(sizes) > 1 and (second - sizes[best]) / max(1.0, second) < margin
    weights = np.exp2(-np.minimum(sizes - sizes[best], 60.0))
    return dicts[best][0], float(1 / weights.sum()), not narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, margin: float = 0.02) -> DataFrame:
    """Add lang_pred, score and accepted to rows with a `text`.

    accepted is false where the margin between the two smallest sizes is narrow.
    Null, empty and letterless texts get `und`, score 0. Ties go to the language first by name.
    Columns with the names of the new ones are replaced.
    """
    dicts = tuple(sorted(dictionaries.items()))

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(t, dicts, level, margin) for t in texts], columns=["lang", "score", "accepted"])

    packed = docs.select(F.struct(*all_but(docs, "lang_pred", "score", "accepted")).alias("_row"), predict("text").alias("_p"))
    return packed.select("_row.*", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.accepted").alias("accepted"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark, sf_dir) -> DataFrame:
    """The language of every whole text; dictionaries are learned from the rows that are not held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    dictionaries = learn(docs.where(~F.col("held_out")))
    out = identify(docs.select("doc_id", "text", "held_out"), dictionaries)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
