"""Cross-tokenizer alignment: each distinct text is tokenized and aligned once, its pair counts weigh as often as it occurs."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, lookup_join, materialize

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
#: A space after a letter, digit or mark of ASCII. No token of either tokenizer ends in such a mark's right neighbour: see `Aligner`.
CUT = re.compile(r"(?<=[\w!-~]) ")
#: Units that end like this can be encoded one after the other as one text.
TAIL = re.compile(r"[\w!-~]\Z")
BLOCK_BYTES = 16 << 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, x, y) of two rising arrays of token ends over the same bytes.

    i and j are the pairs of tokens whose byte ranges overlap, x and y the counts of tokens up to each place where both
    tokenizers end a token.
    """
    starts = np.concatenate(([0], a[:-1])) if len(a) else a
    first, last = np.searchsorted(b, starts, "right"), np.searchsorted(b, a, "left")
    counts = last - first + 1
    i = np.repeat(np.arange(len(a)), counts)
    j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts - first, counts)
    ends = a[np.isin(a, b, assume_unique=True)]
    return i, j, np.searchsorted(a, ends) + 1, np.searchsorted(b, ends) + 1


class Aligner:
    """Aligned tokens of whole texts, put together from those of their units.

    A unit is a space and what follows up to the next space that stands after a letter, digit or ASCII mark; the text
    gets a space in front. Tokenizer A's pre-tokens never hold such a mark and then a space, and no piece of B has a space
    after another character (checked at the start), so both end a token where a unit ends, and a text's tokens, groups and
    links are those of its units one after the other. Units are remembered; the memo is emptied beyond
    `most` units or 16 times as many letters.
    """

    def __init__(self, path_a: str, path_b: str, most: int):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b, self.most = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces with an inner space cannot be aligned by units")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        self.space = self.b.piece_to_id("▁")
        self.clear()

    def clear(self):
        self.place, self.letters, self.rows = {}, 0, []
        self.groups: list[str] = []
        self.table = np.zeros((6, 0), np.int64)  # n_a, n_b, n_groups, n_links, whole, place of the links in `links`
        self.links = np.empty(0, np.uint32)

    def units(self, text: str) -> list[int]:
        """Numbers of the text's units; new ones are noted for `settle`."""
        out = []
        for body in CUT.split(text):
            n = self.place.get(body)
            if n is None:
                n = self.place[body] = len(self.place)
                self.letters += len(body)
                self.rows.append(body)
            out.append(n)
        return out

    def settle(self):
        """Encode and align the units noted since the last call."""
        added, groups, links = np.zeros((6, len(self.rows)), np.int64), [""] * len(self.rows), [self.links]
        plain = [k for k, body in enumerate(self.rows) if TAIL.search(body)]
        parts = [plain[k:k + 4096] for k in range(0, len(plain), 4096)] + [[k] for k, body in enumerate(self.rows) if not TAIL.search(body)]
        while parts:
            some = parts.pop()
            if self._joined(some, added, groups, links):
                continue
            if len(some) > 1:  # one of them does not come out as it went in: find it
                parts += [some[:len(some) // 2], some[len(some) // 2:]]
        self.table = np.concatenate((self.table, added), axis=1)
        self.groups += groups
        self.links, self.rows = np.concatenate(links), []

    def _joined(self, some: list[int], added: np.ndarray, groups: list, links: list) -> bool:
        """Encode units as one text and share out tokens, groups and links; False if the tokens do not spell it or cross a unit's end."""
        text = " ".join([self.rows[k] for k in some])
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text, num_threads=1) or [self.space], np.int64)
        data = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data:
            return False
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        ends = np.cumsum([len(self.rows[k].encode()) + 1 for k in some])
        if not (np.isin(ends, ends_a).all() and np.isin(ends, ends_b).all()):
            return False
        i, j, x, y = align(ends_a, ends_b)
        names = self.names
        text_a, text_b = [names[t] for t in a.tolist()], [names[t] for t in b.tolist()]
        x0, y0 = [0, *x.tolist()], [0, *y.tolist()]
        written = [",".join(text_a[p:q]) + "|" + ",".join(text_b[r:s]) for p, q, r, s in zip(x0, x0[1:], y0, y0[1:])]
        upto = [np.searchsorted(e, ends, "left") + 1 for e in (ends_a, ends_b, ends_a[x - 1])]
        upto.append(np.searchsorted(i, upto[0], "left"))
        g = 0
        for k, g1 in zip(some, upto[2].tolist()):
            groups[k], g = ";".join(written[g:g1]), g1
        added[:4, some] = [np.diff(u, prepend=0) for u in upto]
        added[4, some] = 1
        added[5, some] = sum(map(len, links)) + upto[3] - added[3, some]
        links.append((a[i] << 16 | b[j]).astype(np.uint32))
        return True


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str, most: int) -> Aligner:
    """One memo for each worker process, kept from task to task."""
    return Aligner(path_a, path_b, most)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_texts(texts: DataFrame, path_a: str, path_b: str, memo_units: int = 200_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Align distinct texts (key, text, copies), in blocks of about `block_bytes` of a task; write the result before use.

    For each text a row (block, key, copies, the measures, groups_sha256, units: its units' numbers within the block),
    and for each block a row without key: lens (links of each unit), codes (A id << 16 | B id of each link) and
    weights (occurrences of each unit in the corpus).
    """
    names = ["block", "key", "copies", *MEASURES, "groups_sha256", "units", "lens", "codes", "weights"]
    types = [pa.int64(), pa.binary(), pa.int64(), *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4]

    def close(coder, block, keys, copies, units):
        coder.settle()
        sizes = np.array([len(u) for u in units])
        flat = np.fromiter(itertools.chain.from_iterable(units), np.int32, int(sizes.sum()))
        heads = np.cumsum(sizes) - sizes
        sums = np.stack([np.add.reduceat(column[flat], heads) for column in coder.table[:5]], axis=1)  # no text is without units
        whole = sums[:, 4] == sizes
        sums[~whole] = 0
        counted = np.repeat(whole, sizes)
        used, local = np.unique(flat[counted], return_inverse=True)
        weights = np.bincount(local, weights=np.repeat(np.array(copies, np.float64), sizes)[counted], minlength=len(used)).astype("<i8")
        lens = coder.table[3, used]
        every = coder.links[np.arange(lens.sum()) + np.repeat(coder.table[5, used] - np.cumsum(lens) + lens, lens)]
        at, rows = 0, []
        for k, (key, n, u, ok) in enumerate(zip(keys, copies, units, whole)):
            text = hashlib.sha256(";".join([coder.groups[x] for x in u]).encode()).hexdigest() if ok else ""
            mine = local[at:at + sizes[k]].astype("<u4") if ok else np.empty(0, "<u4")
            at += len(mine)
            rows.append((block, key, n, *sums[k, :4].tolist(), text, mine.tobytes(), None, None, None))
        rows.append((block, None, None, None, None, None, None, None, None, lens.astype("<u4").tobytes(), every.astype("<u4").tobytes(), weights.tobytes()))
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 1000]), types)], names)

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, number, size = aligner(path_a, path_b, memo_units), TaskContext.get().partitionId() << 24, 0
        keys, copies, units = [], [], []
        for rows in batches:
            for key, text, n in zip(*[rows.column(c).to_pylist() for c in ("key", "text", "copies")]):
                if not keys and (len(coder.place) > coder.most or coder.letters > 16 * coder.most):
                    coder.clear()
                keys.append(key)
                copies.append(n)
                units.append(coder.units(text))
                size += len(text)
                if size > block_bytes:
                    yield from close(coder, number, keys, copies, units)
                    number, size, keys, copies, units = number + 1, 0, [], [], []
        if keys:
            yield from close(coder, number, keys, copies, units)

    schema = "block long, key binary, copies long, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string, units binary, lens binary, codes binary, weights binary"
    return texts.select("key", "text", "copies").mapInArrow(run, schema)


def block_pairs(aligned: DataFrame) -> DataFrame:
    """(block, pair, n): how often the corpus links each id pair through the texts of a block."""
    def run(batches):
        for rows in batches:
            for block, lens, codes, weights in zip(*[rows.column(c).to_pylist() for c in ("block", "lens", "codes", "weights")]):
                n = np.repeat(np.frombuffer(weights, "<i8"), np.frombuffer(lens, "<u4"))
                pairs, inverse = np.unique(np.frombuffer(codes, "<u4"), return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, inverse, n)
                for i in range(0, len(pairs), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[part]), block)), pa.array(pairs[part].astype(np.int64)), pa.array(total[part])], ["block", "pair", "n"])
    return aligned.where("key is null").select("block", "lens", "codes", "weights").mapInArrow(run, "block long, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): corpus counts of the id pairs, and whether no pair of the same B id counts more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFF)))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def measure(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, memo_units: int = 200_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Measures of rows (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The corpus is shuffled by full text; each distinct text is tokenized and aligned once, in blocks of bounded size.
    Pair counts are summed over blocks, each block's pairs get them back by a join of (block, pair) rows (a pair is at
    most once in a block, so no pair is a hot key), and the measures join the documents by the SHA-256 of the text.
    Null and empty texts, and those whose tokens do not spell space + text, have zeros and ''; repeated rows are measured
    each; other columns are left out; an empty table gives no rows.
    """
    default_a, default_b = tokenizer_paths() if not (path_a and path_b) else (None, None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    used = F.length("text") > 0
    texts = rows.where(used).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies")
    aligned = materialize(align_texts(keyed, path_a or default_a, path_b or default_b, memo_units, block_bytes), "aligned")
    pairs = materialize(block_pairs(aligned), "pairs")
    found = pairs.select("block", "pair").join(pair_counts(pairs), "pair")
    ours = aligned.where("key is not null").select("block", "key", "copies", *MEASURES, "groups_sha256", "units", F.lit(None).cast("binary").alias("lens"), F.lit(None).cast("binary").alias("codes"))
    dictionary = aligned.where("key is null").select("block", "key", "copies", *MEASURES, "groups_sha256", "units", "lens", "codes")
    both = ours.unionByName(dictionary)

    def score(key, left, right):
        order = np.argsort(right.column("pair").to_numpy())
        pair, count, best = (right.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
        is_text = left.column("key").is_valid().to_numpy()
        head = left.filter(pa.array(~is_text)).to_pylist()[0]
        mine = left.filter(pa.array(is_text))
        lens = np.frombuffer(head["lens"], "<u4").astype(np.int64)
        at = np.searchsorted(pair, np.frombuffer(head["codes"], "<u4").astype(np.int64))
        ends = np.cumsum(lens)
        sums = [np.concatenate(([0], np.cumsum(v[at].astype(np.int64)))) for v in (best, count)] if len(at) else [np.zeros(1, np.int64)] * 2
        n_best, total = (s[ends] - s[ends - lens] for s in sums)
        units = [np.frombuffer(u, "<u4") for u in mine.column("units").to_pylist()]
        return pa.table({"key": mine.column("key"), "copies": mine.column("copies"), **{m: mine.column(m) for m in MEASURES},
                         "n_best": pa.array([int(n_best[u].sum()) for u in units], pa.int64()), "count_sum": pa.array([int(total[u].sum()) for u in units], pa.int64()),
                         "groups_sha256": mine.column("groups_sha256")})

    fields = ["key", "copies", *MEASURES, "n_best", "count_sum", "groups_sha256"]
    schema = "key binary, copies long, " + ", ".join(f"{m} long" for m in [*MEASURES, "n_best", "count_sum"]) + ", groups_sha256 string"
    measures = materialize(both.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema).select(fields), "measures")
    keys = materialize(rows.select("doc_id", F.when(used, F.unhex(F.sha2("text", 256))).alias("key")), "keys")
    total = keys.count()
    joined = lookup_join(keys.where("key is not null"), measures.withColumn("_n", F.col("copies")), "key", "_n", total)
    columns = ["doc_id", *fields[2:]]
    none = keys.where("key is null").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in fields[2:-1]], F.lit("").alias("groups_sha256"))
    return joined.select(columns).unionByName(none)


def op13_alignment(spark, sf_dir) -> DataFrame:
    """Alignment measures of all documents under the byte-level and the piece vocabulary."""
    return measure(load(spark, sf_dir, "documents").select("doc_id", "text"))
