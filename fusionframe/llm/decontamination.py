"""Benchmark overlap by spaced-seed hashing."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_but, load, materialize, salted_join

#: Positions of a window that count (1) or are ignored (0).
MASKS = ("11101101", "11011011", "10110111")
#: Shorter items than a mask are found as they are anywhere in a document from this many words on, else only as a whole document.
LEAST = 4
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the sieve of the benchmark's seeds: 4 MB at least, 16 MB at most, whatever the benchmark.
SIEVE_BITS = (25, 27)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(words: list[str], seen: dict) -> np.ndarray:
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept positions of every window."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), dtype=np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[j:j + n]) * BASE
            out ^= out >> np.uint64(29)
    return out


def all_seeds(h: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of all masks and their places, and of all stretches of the lengths `short`, which are those of items shorter than a mask.

    A stretch of fewer than `LEAST` words counts only where it is the whole text.
    """
    seeds = [seed_hashes(h, m) for m in MASKS]
    seeds += [seed_hashes(h, "1" * n) if n >= LEAST or n == len(h) else h[:0] for n in short]
    return np.concatenate(seeds), np.concatenate([np.arange(len(s)) for s in seeds])


def overlap(doc: np.ndarray, item: np.ndarray, min_match: int, identity: float) -> bool:
    """Whether a stretch of two aligned word sequences has enough equal words, at least `identity` of it.

    With gains of 1 - identity for a hit and -identity for a miss, a stretch fits if its
    sum is not negative; for each end the earliest such start has the most hits.
    """
    same = item == doc
    scale = 1000
    gain = np.where(same, scale - round(identity * scale), -round(identity * scale))
    total = np.concatenate(([0], np.cumsum(gain)))
    hits = np.concatenate(([0], np.cumsum(same)))
    low = np.minimum.accumulate(total)  # falls: the first place at most total[end] is found by bisection
    start = np.searchsorted(-low, -total, side="left")
    return bool((hits - hits[start]).max() >= min_match)


def needed(length: int, min_match: int, identity: float) -> int:
    """The equal words that an item of `length` words asks for."""
    return min(min_match, math.ceil(round(identity * length, 6)))


def _items(benchmark: DataFrame) -> DataFrame:
    """(n, item_id, len, words, seeds): one row per item row, n a number of its own once written."""
    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            seen, out = {}, []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                h = word_hashes(words_of(text), seen)
                seeds, places = all_seeds(h, (len(h),) if 0 < len(h) < len(MASKS[0]) else ())
                out.append(((part << 33) + count, item, len(h), h.tobytes(),
                            [{"seed": s, "at": a} for s, a in zip(seeds.view(np.int64).tolist(), places.tolist())]))
                count += 1
            kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)],
                                             ["n", "item_id", "len", "words", "seeds"])
    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "n long, item_id long, len int, words binary, seeds array<struct<seed:long,at:int>>")


def seed_sieve(seeds: DataFrame) -> np.ndarray:
    """Bits that hold two places of each seed (a Bloom filter of bounded size; a full one lets everything pass)."""
    most = seeds.count() * 32
    bits = min(max(SIEVE_BITS[0], most.bit_length()), SIEVE_BITS[1])
    places = F.transform(F.array(F.col("seed"), F.shiftrightunsigned("seed", 32)), lambda p: p.bitwiseAND(F.lit((1 << bits) - 1)))
    cells = seeds.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(p & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _hits(rows: DataFrame, sieve: np.ndarray, short: tuple[int, ...]) -> DataFrame:
    """(uid, n_words, words, hits) of the texts with a seed that passes the sieve."""
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())]))
    mask = np.uint64(len(sieve) * 64 - 1)

    def passes(p):
        return (sieve[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)

    def run(batches):
        seen: dict = {}
        for batch in batches:
            out = []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                h = word_hashes(words_of(text), seen)
                seeds, places = all_seeds(h, short)
                at = np.flatnonzero(passes(seeds & mask))
                at = at[passes((seeds[at] >> np.uint64(32)) & mask) == 1]
                if len(at):
                    out.append((uid, len(h), h.tobytes(), [{"seed": s, "pos": p} for s, p in
                                                          zip(seeds[at].view(np.int64).tolist(), places[at].tolist())]))
                if len(seen) > 500_000:
                    seen.clear()
            types = [pa.int64(), pa.int32(), pa.binary(), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)],
                                             ["uid", "n_words", "words", "hits"])
    return rows.select("uid", "text").mapInArrow(run, "uid long, n_words int, words binary, hits array<struct<seed:long,pos:int>>")


def leaks(rows: DataFrame, benchmark: DataFrame, min_match: int, identity: float) -> DataFrame:
    """(uid, leaked_items) of the rows of (uid, text) that hold passages of the benchmark."""
    items = materialize(_items(benchmark.where("item_id is not null and text is not null")), "items")
    seeds = items.select("n", "len", F.inline("seeds"))
    short = tuple(sorted(r.len for r in items.where((F.col("len") > 0) & (F.col("len") < len(MASKS[0]))).select("len").distinct().collect()))  # at most 7
    hits = materialize(_hits(rows, seed_sieve(seeds), short), "hits")
    probes = hits.select("uid", F.inline("hits"))
    table = seeds.groupBy("seed").agg(F.collect_list(F.struct("n", "len", "at")).alias("found"))
    table = table.join(probes.groupBy("seed").agg(F.count("*").alias("rows")), "seed")
    found = salted_join(probes, table, "seed", "rows", probes.count(), ["uid", "pos"]).select("uid", "pos", F.inline("found"))
    pairs = materialize(found.select("uid", "n", "len", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "pairs")
    first, last = F.greatest("shift", F.lit(0)), F.least(F.col("shift") + F.col("len"), F.col("n_words"))
    slices = pairs.join(hits.select("uid", "n_words", "words"), "uid").select(
        "uid", "n", "shift", F.substring("words", first * 8 + 1, (last - first) * 8).alias("part"))
    sides = items.select("n", "item_id", F.col("words").alias("item")).join(pairs.groupBy("n").agg(F.count("*").alias("rows")), "n")

    def verify(batches):
        for batch in batches:
            uids, ids = [], []
            for uid, shift, part, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("uid", "shift", "part", "item_id", "item"))):
                doc, words = np.frombuffer(part, np.uint64), np.frombuffer(item, np.uint64)
                at = max(0, -shift)
                if overlap(doc, words[at:at + len(doc)], needed(len(words), min_match, identity), identity):
                    uids.append(uid)
                    ids.append(item_id)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ids, pa.int64())], ["uid", "item_id"])

    checked = salted_join(slices, sides, "n", "rows", pairs.count(), ["uid", "shift"]).select("uid", "shift", "part", "item_id", "item") \
        .mapInArrow(verify, "uid long, item_id long")
    return checked.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("leaked_items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 13, identity: float = 0.8) -> DataFrame:
    """Add `leaked_items` (item ids, ascending) to rows with a `text`.

    Seeds of all documents that pass a sieve of the benchmark's seeds are joined with them, and
    each hit is verified on its diagonal: some stretch around it must have at least `min_match`
    equal words (of an item of fewer than 17 words, `identity` of them), at least `identity` of
    the stretch. Items with fewer words than a mask (8) are found word by word: anywhere in a document if they have at
    least 4 words, else where they are the whole document. Wordless items and null texts match nothing, and an empty
    benchmark matches none. Repeated rows get the same items; a column `leaked_items` is replaced.
    """
    rows = docs.select(F.struct(*all_but(docs, "leaked_items")).alias("row"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(rows.select("row", "uid"), "rows")
    found = leaks(rows.select("uid", "row.text"), benchmark, min_match, identity)
    return rows.join(found, "uid", "left").select("row.*", F.coalesce("leaked_items", F.array().cast("array<long>")).alias("leaked_items"))


def op8_decontamination(spark, sf_dir) -> DataFrame:
    """Whether each document holds a passage of the benchmark, and the items."""
    out = find_leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), "leaked_items")
