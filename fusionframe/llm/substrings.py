"""Repeated word windows by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_runs, load, lookup_join, materialize
from .words import chunks, gram_hashes, joined_words

WINDOW, PREFIX = 35, 12
#: Widths of the ranges of window offsets that share a prefix: the prefix has WINDOW + 1 - width words.
WIDTHS = (WINDOW - PREFIX + 1, 6, 1)
PLACE = np.uint64(28)


def anchored_runs(hashes: np.ndarray, heads: np.ndarray, window: int = WINDOW, prefix: int = PREFIX):
    """Runs of windows with the same anchor: (first window, windows, anchor word, prefix hash).

    The anchor of a window is its `prefix`-gram of least hash, the first of equal ones, so
    equal windows have equal anchors at equal places. Windows that cross the head of a text are none.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
    grams = gram_hashes(hashes, prefix)
    low = ((grams >> PLACE) << PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, step = window - prefix + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[:step - width], low[width - step:])
    anchor = (low & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    text = np.searchsorted(heads, np.arange(len(hashes)), side="right")
    at = np.flatnonzero(text[:n] == text[window - 1:])
    if not len(at):
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor[at]) != 0) | (np.diff(at) != 1))))
    lo = at[first]
    return lo, np.diff(np.append(first, len(at))), anchor[lo], grams[anchor[lo]]


RUNS = "digest string, h1 long, h2 long, runs array<struct<lo:int,n:int,o:int,key:long,again:boolean>>"


def _runs(docs: DataFrame) -> DataFrame:
    """One row for each text of `window` words or more: its digest and its runs (`o`: words from first window to anchor)."""
    kind = pa.struct([("lo", pa.int32()), ("n", pa.int32()), ("o", pa.int32()), ("key", pa.int64()), ("again", pa.bool_())])

    def run(batches):
        for batch in batches:
            texts, digests = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("digest").to_pylist()
            for start, stop in chunks([len(t) for t in texts]):
                _, _, _, hashes, heads = joined_words(texts[start:stop])
                lo, n, anchor, keys = anchored_runs(hashes, heads)
                owner = np.searchsorted(heads, lo, side="right") - 1
                order = np.lexsort((keys, owner))
                same = (np.diff(owner[order]) == 0) & (np.diff(keys[order].view(np.int64)) == 0)
                again = np.zeros(len(lo), bool)
                again[order[1:]] = same
                again[order[:-1]] |= same
                ends = np.searchsorted(owner, np.arange(stop - start + 1))
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array((lo - heads[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((anchor - lo).astype(np.int32)),
                     pa.array(keys.view(np.int64)), pa.array(again)], fields=list(kind)))
                halves = [struct.unpack(">qq", bytes.fromhex(d)) for d in digests[start:stop]]
                out = pa.RecordBatch.from_arrays(
                    [pa.array(digests[start:stop]), pa.array([h for h, _ in halves], pa.int64()),
                     pa.array([h for _, h in halves], pa.int64()), rows], ["digest", "h1", "h2", "runs"])
                yield out.filter(pa.array(np.diff(ends) > 0))
    return docs.select("digest", "text").mapInArrow(run, RUNS)


def subtree_repeats(rows: list[tuple[list, int, int]], window: int = WINDOW) -> list[int]:
    """For each (words, windows, copies) of a group: a bit for each window that occurs more than once in it.

    The leaves of the group's suffix tree are the suffixes that start a window, in sorted order;
    the words that neighbours share are the depth of the node where they part. A span of leaves
    whose common prefixes all reach `window` hangs below one internal node of that depth or more,
    and its windows repeat if the leaves have two copies or more.
    """
    number: dict = {}
    # four big-endian bytes for each word, so that slices of bytes sort as the lists of numbers do
    codes = [np.array([number.setdefault(w, len(number)) for w in words], ">u4").tobytes() for words, _, _ in rows]
    leaves = sorted((code[4 * i:], r, i) for r, (code, (_, n, _)) in enumerate(zip(codes, rows)) for i in range(n))
    masks, start, depth = [0] * len(rows), 0, 4 * window
    for at in range(1, len(leaves) + 1):
        if at < len(leaves) and leaves[at][0].startswith(leaves[at - 1][0][:depth]):
            continue
        if sum(rows[r][2] for _, r, _ in leaves[start:at]) > 1:
            for _, r, i in leaves[start:at]:
                masks[r] |= 1 << i
        start = at
    return masks


def split_run(body: list[bytes], n: int, o: int, width: int, window: int = WINDOW):
    """Parts of a run whose windows share a longer prefix: (shift, windows, offset of the first, body, prefix).

    Windows whose distance to the anchor lies in one range of `width` share all words from
    the start of the last to the end of the first: WINDOW + 1 - width of them.
    """
    i = 0
    while i < n:
        least = (o - i) // width * width
        m = min(n - i, o - i - least + 1)
        yield i, m, o - i, body[i:i + m + window - 1], body[o - least:o - least - width + 1 + window]
        i += m


def _hash64(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _tree_masks(rows: DataFrame) -> DataFrame:
    """(key, same, mask) by one suffix tree for each key, in a sorted stream of the keys' runs."""
    def tree(batches):
        out: list = []

        def table():
            keys, same, masks = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(same, pa.binary()), pa.array(masks, pa.int64())], ["key", "same", "mask"])

        for (key,), (same, bodies, ns, copies) in key_runs(batches, ["key"], ["same", "body", "n", "copies"]):
            out += zip([key] * len(same), same, subtree_repeats(list(zip([b.split() for b in bodies], ns, copies))))
            if len(out) > 20_000:
                yield table()
        if out:
            yield table()

    ordered = rows.select("key", "same", "body", "n", "copies").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(tree, "key long, same binary, mask long")


def repeat_masks(rows: DataFrame, group_rows: int) -> DataFrame:
    """(key, same, mask) of different runs (key, same, copies, n, o, body).

    Suffixes are grouped by a prefix of 12 words; a group of over `group_rows` different
    runs gets prefixes of 30 and then of all 35 words. A group of that last kind is one
    window, whose copies are summed and not gathered.
    """
    out, parents = [], []
    for width in WIDTHS[1:]:
        sizes = rows.groupBy("key").agg(F.count("*").alias("kinds"))
        sized = materialize(rows.join(sizes, "key"), "sized")
        large = sized.where(F.col("kinds") > group_rows)

        def split(batches, width=width):
            for batch in batches:
                made = []
                for r in batch.to_pylist():
                    for shift, m, o, body, prefix in split_run(r["body"].split(), r["n"], r["o"], width):
                        whole = b" ".join(body)
                        made.append((r["key"], r["same"], shift, _hash64(prefix), hashlib.blake2b(b"%d %s" % (o, whole), digest_size=16).digest(),
                                     r["copies"], m, o, whole))
                        if len(made) == 20_000:
                            yield table(made)
                            made = []
                if made:
                    yield table(made)

        def table(made):
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)],
                                              ["up_key", "up_same", "shift", "key", "same", "copies", "n", "o", "body"])

        out.append(_tree_masks(sized.where(F.col("kinds") <= group_rows)))
        empty = large.isEmpty()
        if not empty:
            parted = materialize(large.mapInArrow(split, "up_key long, up_same binary, shift int, key long, same binary, copies long, n int, o int, body binary"), "parted")
            rows = parted.groupBy("key", "same").agg(F.sum("copies").alias("copies"), F.min("n").alias("n"), F.min("o").alias("o"), F.min("body").alias("body"))
            parents.append(parted.select("up_key", "up_same", "shift", "key", "same"))
        if empty:
            break
    else:
        out.append(rows.select("key", "same", F.when(F.col("copies") > 1, 1).otherwise(0).cast("long").alias("mask")))
    masks = out.pop()
    while parents:
        up = parents.pop().join(masks, ["key", "same"]).groupBy("up_key", "up_same").agg(
            F.bit_or(F.expr("shiftleft(mask, shift)")).alias("mask"))
        masks = out.pop().unionByName(up.withColumnsRenamed({"up_key": "key", "up_same": "same"}))
    return masks


def _cut(touched: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, same, copies, n, o, body) of the asked runs (digest, key, same, copies, lo, n, o)."""
    lists = asked.groupBy("digest").agg(F.collect_list(F.struct("key", "same", "copies", "lo", "n", "o")).alias("asked"))

    def cut(batches):
        names = ["key", "same", "copies", "n", "o"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            out, size = [], 0
            for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist()):
                words = text.split()
                for r in runs:
                    body = b" ".join(words[r["lo"]:r["lo"] + r["n"] + WINDOW - 1])
                    out.append((*(r[c] for c in names), body))
                    size += len(body)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types, pa.binary()])], [*names, "body"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types, pa.binary()])], [*names, "body"])
    return touched.select("digest", "text").join(lists, "digest").mapInArrow(
        cut, "key long, same binary, copies long, n int, o int, body binary")


def _touched(docs: DataFrame) -> DataFrame:
    """Each different text with a run whose prefix occurs elsewhere: (digest, text, runs with `same`, a digest of the run's words)."""
    runs = materialize(_runs(docs), "runs")
    flat = runs.select("digest", "h1", "h2", F.inline("runs"))
    keys = flat.groupBy("key").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("h1", "h2") for f in (F.min, F.max)],
                                   F.max("again").alias("again"), F.count("*").alias("rows"))
    keys = keys.where("again or min_h1 <> max_h1 or min_h2 <> max_h2").select("key", "rows")
    total = runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    spans = lookup_join(flat.select("digest", "lo", "n", "o", "key"), keys, "key", "rows", total) \
        .groupBy("digest").agg(F.collect_set(F.struct("lo", "n", "o", "key")).alias("spans"))
    texts = docs.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text"))

    def mark(batches):
        for batch in batches:
            spans = batch.column("spans")
            ends_of, flat = np.cumsum(pc.list_value_length(spans).to_numpy()), spans.flatten()
            lo, n, o = (flat.field(c).to_numpy().tolist() for c in ("lo", "n", "o"))
            same, at = [], 0
            for text, stop in zip(batch.column("text").cast(pa.binary()).to_pylist(), ends_of.tolist()):
                words = text.split()
                whole = b" ".join(words)
                ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)).tolist()
                for k in range(at, stop):
                    first = lo[k]
                    body = whole[ends[first - 1] if first else 0:ends[first + n[k] + WINDOW - 2] - 1]
                    same.append(hashlib.blake2b(b"%d %s" % (o[k], body), digest_size=16).digest())
                at = stop
            runs = pa.StructArray.from_arrays([*(flat.field(c) for c in ("lo", "n", "o", "key")), pa.array(same, pa.binary())], ["lo", "n", "o", "key", "same"])
            offsets = pa.array(np.concatenate(([0], ends_of)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("text"), pa.ListArray.from_arrays(offsets, runs)],
                                             ["digest", "text", "runs"])
    return materialize(texts.join(spans, "digest").select("digest", "text", "spans").mapInArrow(
        mark, "digest string, text string, runs array<struct<lo:int,n:int,o:int,key:long,same:binary>>"), "touched")


def _removed(docs: DataFrame, group_rows: int) -> DataFrame:
    """(digest, n_removed, kept) of each different text that loses words to another place."""
    touched = _touched(docs)
    links = touched.select("digest", F.inline("runs"))
    kinds = links.groupBy("key", "same").agg(F.count("*").alias("copies"), F.min(F.struct("digest", "lo", "n", "o")).alias("first"))
    kinds = materialize(kinds, "kinds")
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    asked = kinds.join(mixed, "key", "left_semi").select("key", "same", "copies", "first.*")
    alike = kinds.join(mixed, "key", "left_anti").where("copies > 1") \
        .select("key", "same", F.expr("shiftleft(cast(1 as bigint), first.n) - 1").alias("mask"))
    masks = repeat_masks(_cut(touched, asked), group_rows).where("mask <> 0").unionByName(alike)
    masks = masks.join(kinds.select("key", "same", "copies"), ["key", "same"]).select(F.struct("key", "same").alias("run"), "copies", "mask")
    masks = materialize(masks, "masks")
    total = kinds.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    covered = lookup_join(links.select(F.struct("key", "same").alias("run"), "digest", "lo"), masks, "run", "copies", total)
    per_text = covered.groupBy("digest").agg(F.collect_list(F.struct("lo", "mask")).alias("hits"))

    def keep(batches):
        for batch in batches:
            removed, kept = [], []
            for text, hits in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("hits").to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int32)
                for hit in hits:
                    for i in range(hit["mask"].bit_length()):
                        if hit["mask"] >> i & 1:
                            edge[hit["lo"] + i] += 1
                            edge[hit["lo"] + i + WINDOW] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             ["digest", "n_removed", "kept"])
    return touched.select("digest", "text").join(per_text, "digest").select("digest", "text", "hits") \
        .mapInArrow(keep, "digest string, n_removed long, kept string")


def remove_repeats(docs: DataFrame, group_rows: int = 256, finish=None) -> DataFrame:
    """Remove each word covered by a 35-word window that starts more than once in the table.

    Takes rows of (doc_id, text) and returns doc_id, n_words, n_removed, kept (the kept words
    joined by one space, or `finish` of that column, applied before rows are joined).
    A sieve over all texts keeps the runs of windows whose 12-word prefix occurs in another text or
    again in the same one; their suffixes go to suffix trees by prefix (`repeat_masks`), words compared.
    Equal texts and equal runs meet a tree once: they are counted by 128-bit digests.
    Null and short texts have no windows; repeated rows repeat each other's windows; other
    columns are left out.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", "text", F.md5("text").alias("digest"))
    finish = finish or (lambda kept: kept)
    gone = _removed(keyed, group_rows).select("digest", F.col("n_removed").alias("part_removed"), finish(F.col("kept")).alias("part_kept"))
    copies = keyed.groupBy("digest").agg(F.count("*").alias("copies"))
    known = materialize(copies.where("copies > 1").join(gone, "digest", "full").select(
        "digest", F.coalesce("copies", F.lit(1)).alias("copies"), "part_removed", "part_kept"), "known")
    n_words = F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)
    rows = keyed.select("doc_id", "digest", n_words.cast("long").alias("n_words"), finish(spaced).alias("whole"))
    # Equal texts lose all words, so a hot text needs no more than its digest: at most 1000 have over 1/1000 of all rows.
    hot = (F.col("copies") > 1) & (F.col("copies") * 1000 > F.lit(docs.count()))
    tagged = rows.join(F.broadcast(known.where(hot).select("digest", F.lit(True).alias("hot"))), "digest", "left")
    nothing = {"copies": F.lit(2).cast("long"), "part_removed": F.lit(None).cast("long"), "part_kept": F.lit(None).cast("string")}
    every = tagged.where("hot").withColumns(nothing).unionByName(
        tagged.where("hot is null").join(known.where(~hot), "digest", "left"))
    full = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_words") >= WINDOW)
    return every.select(
        "doc_id", "n_words", F.when(full, F.col("n_words")).otherwise(F.coalesce("part_removed", F.lit(0))).alias("n_removed"),
        F.when(full, finish(F.lit(""))).otherwise(F.coalesce("part_kept", "whole")).alias("kept"))


def op10_suffix_trees(spark, sf_dir) -> DataFrame:
    """Words removed from every document as parts of repeated passages, with the digest of what is kept."""
    out = remove_repeats(load(spark, sf_dir, "documents"), finish=lambda kept: F.sha2(F.encode(kept, "UTF-8"), 256))
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
