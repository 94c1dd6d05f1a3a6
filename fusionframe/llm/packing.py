"""Mixture-controlled sequence packing by deficit round-robin."""

from __future__ import annotations

import functools
import re
import zlib
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize
from .words import chunks

WINDOW = 4096
BLOCK_WINDOWS = 64
#: The table of places of parts and queues is broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 8 << 20
#: Fixed value: the pattern of the tokenizer's pre-tokens inside a word of lower-case text.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: A full stop or comma between a letter or digit and white space: a pre-token of its own.
STOP = re.compile(r"(?<=[^\W_])([.,])(?=[ \n])")
#: Letters whose lower case depends on their neighbours, or that lower case and composition treat in another order.
TIED = re.compile("[\u03a3\u0130\u0300-\u036f]")


class _Places(dict):
    """Numbers of words; a new word gets the next one and is noted in `fresh`."""

    fresh: list

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordIds:
    """The tokenizer's ids of whole texts, put together from the ids of their words.

    No pre-token crosses a space, tab, CR or LF, so a text's ids are those of its words; the tokenizer
    lower-cases, so words are kept in lower case. New words are encoded in one joined call, cut where a
    word's last pre-token ends (each pre-token ends with one id written with the end-of-word mark). The memo is
    emptied beyond `most` words or 16 times as many letters.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer
        self.tok, self.most = Tokenizer.from_file(path), most
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self):
        self.place, self.letters = _Places({"": 0}), 0
        self.place.fresh = []
        self.ids, self.start, self.size = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        if not TIED.search(text) and not any(m in text for m in self.marks):
            text = STOP.sub(r" \1", text.lower())
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def coded(self, words: list[str]) -> list[np.ndarray]:
        """Arrays of ids, and of their number for each word, in the order of the words."""
        marked = [i for i, w in enumerate(words) if any(m in w for m in self.marks)]
        if len(words) == 1 or marked:
            if len(words) > 1:
                cuts = sorted({0, len(words), *marked, *(i + 1 for i in marked)})
                parts = [self.coded(words[i:j]) for i, j in zip(cuts, cuts[1:])]
                return [np.concatenate(x) for x in zip(*parts)]
            ids = np.array(self.tok.encode(words[0], add_special_tokens=False).ids, "<u4")
            return [ids, np.array([len(ids)], np.int64)]
        counts = np.fromiter((1 if w.isalpha() and "\u0130" not in w else len(PRE_TOKEN.findall(normalize("NFC", w).lower())) for w in words), np.int64, len(words))
        joined = [" ".join(words[i:i + 400]) for i in range(0, len(words), 400)]
        flat = np.concatenate([np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
        cuts = np.concatenate(([0], np.flatnonzero(self.ends[flat]) + 1))
        if len(cuts) - 1 != counts.sum():  # letters that this pattern and the tokenizer class apart: find their word
            half = len(words) // 2
            return [np.concatenate(x) for x in zip(self.coded(words[:half]), self.coded(words[half:]))]
        at = cuts[np.concatenate(([0], np.cumsum(counts)))]
        return [flat[:at[-1]], np.diff(at).astype(np.int64)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > self.most or self.letters > 16 * self.most:
            self.clear()
        look = self.place.__getitem__
        places = [np.fromiter(map(look, words), np.int64, len(words)) for words in map(self.words, texts)]
        if self.place.fresh:
            ids, sizes = self.coded(self.place.fresh)
            self.letters += sum(map(len, self.place.fresh))
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(sizes) - sizes))
            self.size = np.concatenate((self.size, sizes))
            self.ids = np.concatenate((self.ids, ids))
            self.place.fresh = []
        out = []
        for at in places:
            size = self.size[at]
            before = np.cumsum(size) - size
            out.append(self.ids[np.arange(size.sum()) + np.repeat(self.start[at] - before, size)])
        return out


@functools.lru_cache(maxsize=2)
def word_ids(path: str, most: int = 400_000) -> WordIds:
    """One memo for each worker process, kept from task to task."""
    return WordIds(path, most)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, path: str, end_id: int = 2, batch_bytes: int = 1 << 20, memo_words: int = 400_000) -> DataFrame:
    """(doc_id, queue, doc_tokens, ids, part, at): ids as little-endian 16-bit numbers, closed by end_id.

    `at` is the row's place among its queue's tokens in this task's output `part`, so
    the result has to be written before use. A null text has only end_id.
    """
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, end = word_ids(path, memo_words), np.array([end_id], "<u2")
        part, used = TaskContext.get().partitionId(), {}
        for rows in batches:
            sizes = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_pylist()
            for i, j in chunks(sizes, batch_bytes):
                some = rows.slice(i, j - i)
                coded = coder.encode([t or "" for t in some.column("text").to_pylist()])
                if any(x.size and x.max() > 65535 for x in coded):
                    raise ValueError("ids must fit in 16 bits")
                queues, ids, at = some.column("queue").to_pylist(), [np.concatenate((x.astype("<u2"), end)) for x in coded], []
                for q, x in zip(queues, ids):
                    at.append(used.get(q, 0))
                    used[q] = at[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("queue"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([part] * len(ids), pa.int64()),
                     pa.array(at, pa.int64())],
                    ["doc_id", "queue", "doc_tokens", "ids", "part", "at"])
    return docs.mapInArrow(run, "doc_id long, queue string, doc_tokens long, ids binary, part long, at long")


def fill_windows(segments: list[tuple[str, int]], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Deficit round-robin over queues of given lengths: (queue index, window, tokens) in order.

    Every window adds to each queue's deficit its share of the window; whole tokens of
    it are served, what is left stays as deficit for the next window, and room left
    over goes to the queues with the highest deficits.
    """
    lengths = np.array([n for _, n in segments], dtype=np.int64)
    total, left = int(lengths.sum()), lengths.copy()
    deficit, taken, number = np.zeros(len(lengths)), [], 0
    while total > 0:
        room = min(window, total)
        deficit += lengths / lengths.sum() * room
        serve = np.minimum(np.maximum(np.floor(deficit + 1e-9), 0).astype(np.int64), left)
        over = int(serve.sum()) - room
        short = -over
        for i in np.argsort(-(deficit - serve), kind="stable"):
            if short <= 0:
                break
            more = min(int(left[i] - serve[i]), 1)
            serve[i] += more
            short -= more
        for i in np.argsort(-(left - serve), kind="stable"):
            if short <= 0:
                break
            more = min(int(left[i] - serve[i]), short)
            serve[i] += more
            short -= more
        for i in np.argsort(deficit - serve, kind="stable"):
            if over <= 0:
                break
            less = min(int(serve[i]), over)
            serve[i] -= less
            over -= less
        deficit -= serve
        left -= serve
        taken.extend((int(i), number, int(serve[i])) for i in np.nonzero(serve)[0])
        total -= room
        number += 1
    return taken


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, memo_words: int = 400_000) -> DataFrame:
    """Pack rows of (doc_id, text, source) into windows of the corpus's own source mix.

    Each source is a queue; its tokens form one line. The lines are cut into as many equal
    blocks as fill `block_windows` windows together (more, where sources are so many that a block
    could not hold two tokens of each); block b of queue s ends at floor(total_s * (b + 1) / blocks),
    so what a block owes of a token goes to the next block. Inside a block, deficit round-robin
    fills the windows. Only a block's last window can be short.
    Returns one row per piece: doc_id, start, length, ids (16-bit), ids_crc32,
    doc_tokens, sequence_id, offset, padded_to (window, or the power of two above the fill).
    Null texts and sources are empty text and a queue of their own; an empty table gives no rows.
    Repeated rows are packed each; other columns are left out. `memo_words` bounds the memory of a worker's
    word memo (about 250 bytes a word), not the result.
    """
    path = path or tokenizer_path()
    queue = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    coded = materialize(tokenize(docs.select(F.col("doc_id").cast("long"), "text", queue.alias("queue")), path, memo_words=memo_words), "ids")
    parts = materialize(coded.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "parts")
    totals = parts.groupBy("queue").agg(F.sum("n").alias("total"))
    queues, tokens = totals.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    block_windows = max(block_windows, -(-2 * (queues + 1) // window))
    blocks = max(1, -(-tokens // (block_windows * window - queues - 1)))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(totals, "queue")
    if (parts.agg(F.sum(F.octet_length("queue") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        base = F.broadcast(base)

    def cut(batches):
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                total, first, n = r["total"], r["base"] + r["at"], r["doc_tokens"]
                done = 0
                while done < n:
                    block = ((first + done + 1) * blocks + total - 1) // total - 1
                    end = min(n, total * (block + 1) // blocks - first)
                    out.append((block, r["queue"], first + done, r["doc_id"], done, n, r["ids"][2 * done:2 * end]))
                    done = end
            names = ["block", "queue", "line", "doc_id", "start", "doc_tokens", "ids"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    lines = coded.join(base, ["queue", "part"]).mapInArrow(
        cut, "block long, queue string, line long, doc_id long, start long, doc_tokens long, ids binary")

    def fill(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["queue"], r["line"]))
        by_queue = {}
        for r in rows:
            by_queue.setdefault(r["queue"], []).append([r, 0])
        names = sorted(by_queue)
        lengths = [(q, sum(len(r["ids"]) // 2 for r, _ in by_queue[q])) for q in names]
        heads, offsets, out = [0] * len(names), {}, []
        for i, number, room in fill_windows(lengths, window):
            while room:
                row, used = by_queue[names[i]][heads[i]]
                n = min(room, len(row["ids"]) // 2 - used)
                ids = row["ids"][2 * used:2 * (used + n)]
                offset = offsets.get(number, 0)
                out.append((row["doc_id"], row["start"] + used, n, ids,
                            zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), row["doc_tokens"],
                            key[0].as_py() * block_windows + number, offset))
                offsets[number] = offset + n
                room -= n
                if used + n == len(row["ids"]) // 2:
                    heads[i] += 1
                else:
                    by_queue[names[i]][heads[i]][1] = used + n
        fields = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
        padded = [min(window, 1 << (offsets[r[6] - key[0].as_py() * block_windows] - 1).bit_length()) for r in out]
        arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.table(dict(zip(fields, arrays)) | {"padded_to": pa.array(padded, pa.int64())})

    return lines.groupBy("block").applyInArrow(
        fill, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, padded_to long")


def op3_packing(spark, sf_dir) -> DataFrame:
    """All documents in windows of 4096 tokens by the corpus's own mix of sources, one row for each piece."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pack(docs, memo_words=1_000_000).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")
