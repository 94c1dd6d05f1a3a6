import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fusionframe.llm import alignment, mixing, negatives

SF = "/root/testdata/sf0.001"


def same(got, con, sql, digits=9):
    want = con.execute(sql).df()
    got = got.toPandas()
    def value(v):
        return None if pd.isna(v) else round(float(v), digits) if isinstance(v, (int, float)) else v

    def order(f):
        return sorted((tuple(map(value, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=repr)

    assert sorted(got.columns) == sorted(want.columns)
    assert order(got) == order(want)
    return got


# Mixing

def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = same(mixing.op11_mixing(spark, SF), con, mixing.OP11_SQL)
    assert (got["taken"] <= 3 * got["size"]).all()


def write_docs(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, rate double").write.parquet(f"{path}/documents.parquet")


def test_mixing_odd_rows_equal_sql(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 97), "hot" if i % 3 else f"s{i % 11}", 0.5) for i in range(3000)]
    rows += [(7, "twice  \t told\ntale", None, None)] * 700 + [(None, "x", "s1", 0.0), (5001, None, "void", 1.0), (5002, " \n", "void", 1.0), (5003, "a" * 100_000, "é", 1.0), (5004, "w " * 60_000, "z", 1.0)]
    write_docs(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = same(mixing.op11_mixing(spark, str(tmp_path)), con, mixing.OP11_SQL)
    assert len(got) == len(rows)
    for (size, target), taken in got.groupby(["source_size", "target"])["taken"].sum().items():
        if size > 20_000 and size != 60_000:
            assert abs(taken - target) < 0.01 * target


def test_mixing_empty_table(spark, tmp_path):
    write_docs(spark, tmp_path, [])
    assert mixing.op11_mixing(spark, str(tmp_path)).count() == 0


def test_mixing_reruns_agree_on_other_splits(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", i * i % 501) for i in range(2000)], "doc_id long, source string, size long")
    one = sorted(map(tuple, mixing.mix(docs.repartition(1)).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(7, "size")).collect()))


def test_word_count(spark):
    texts = [None, "", " \t", "a", " a b\x0bc ", " x y", "a\x1fb c\n\nd"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()]
    assert got == [0, 0, 0, 1, 3, 2, 3]


def test_capped_targets_reshare(spark):
    groups = spark.createDataFrame([("a", 1, 1), ("b", 10, 2), ("c", 100, 3), ("d", 1000, 1)], "g string, mass long, weight long")
    got = {r.g: r.target for r in mixing.capped_targets(groups).collect()}
    # 1111 shared by weight: a, b and c stop at 3, 30 and 300, the rest goes to d
    assert got == {"a": 3.0, "b": 30.0, "c": 300.0, "d": 778.0}


def test_balance_two_margins(spark):
    rng = np.random.default_rng(3)
    cells = [(s, l, int(m)) for (s, l), m in zip([(s, l) for s in "abc" for l in "xy"], rng.integers(50, 500, 6))]
    total = sum(m for *_, m in cells)
    frame = spark.createDataFrame(cells, "s string, l string, mass long")
    by_s = spark.createDataFrame([("a", total * 0.5), ("b", total * 0.2), ("c", total * 0.3)], "s string, t double")
    by_l = spark.createDataFrame([("x", total * 0.45), ("y", total * 0.55)], "l string, t double")
    got = {(r.s, r.l): r.rate for r in mixing.balance(frame, {"s": by_s, "l": by_l}, 10.0, 1e-10).collect()}
    for value, want in zip("abc", (0.5, 0.2, 0.3)):
        assert abs(sum(m * got[s, l] for s, l, m in cells if s == value) - total * want) < 1e-6 * total
    odds = [np.log(got[s, "x"]) - np.log(got[s, "y"]) for s in "abc"]  # tilted exponentially: one multiplier for each target
    assert max(odds) - min(odds) < 1e-6


def test_balance_refuses_contradictions(spark):
    frame = spark.createDataFrame([("a", 10)], "s string, mass long")
    with pytest.raises(ValueError):
        mixing.balance(frame, {"s": spark.createDataFrame([("a", 100.0)], "s string, t double")}, 3.0)


# Hard negatives

def test_negatives_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    same(negatives.op12_hard_negatives(spark, SF), con, negatives.OP12_SQL)


def loop(rows, is_anchor):
    out, anchors = [], {}
    for i, label, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if is_anchor(i):
            anchors.setdefault(i, (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, u)), j, l) for j, l, u in rows if j != a and len(u) == len(v))
        wanted = sorted({(s, j) for s, j in [(s, j) for s, j, l in scored if l == label][:5]})
        for s, j in wanted:
            window = [(t, n) for t, n, l in scored if l != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(window[:3])]
    return sorted(out)


@pytest.mark.parametrize("case", ["ties", "wide", "copies", "lengths", "anchors", "negative"])
def test_negatives_equal_loop(spark, case):
    rng = np.random.default_rng(5)
    if case == "ties":
        rows = [(i, int(rng.integers(3)), rng.integers(-2, 3, 4).tolist()) for i in range(600)]
    elif case == "wide":  # products beyond doubles
        rows = [(i, i % 2, (rng.integers(-2, 3, 3) * (1 << 29) + rng.integers(0, 9, 3)).tolist()) for i in range(120)]
    elif case == "copies":
        rows = [(i, 0, [5, 5, 5]) for i in range(300)] + [(300 + i, 1, [4, 4, 3]) for i in range(200)] + [(50, 0, [5, 5, 5]), (50, 1, [1, 1, 1]), (60, 0, [9, 0, 0]), (60, 0, [9, 0, 0])]
    elif case == "lengths":
        rows = [(i, i % 3, rng.integers(-3, 4, 2 + i % 2).tolist()) for i in range(300)]
    elif case == "anchors":
        rows = [(i * 50, i % 3, rng.integers(-3, 9, 3).tolist()) for i in range(40)]
    else:
        rows = [(i, i % 2, [-(i % 5) if i % 50 else 1, 1]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>").withColumn("tile", F.lit("clash"))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0, tile_bytes=3000).collect()
    assert sorted(map(tuple, got)) == loop(rows, lambda i: i % 50 == 0)


def test_negatives_empty_and_null_rows(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert negatives.op12_hard_negatives(spark, f"{tmp_path}/none").count() == 0
    odd = [(0, [1.0, 0.5], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (6, [1.0, 0.25], 1), (8, [0.5, 0.5], 2)]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/odd/embeddings.parquet/*.parquet' where vec_id is not null")
    same(negatives.op12_hard_negatives(spark, f"{tmp_path}/odd"), con, negatives.OP12_SQL)


# Alignment

def pieces(text):
    """(ids, bytes) of the whole text by both tokenizers, without units."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    global A, B, LETTERS
    if "A" not in globals():
        A, B = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        A.encode_special_tokens, LETTERS = True, alignment.byte_letters()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    return a, [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a], b, [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]


def brute(text):
    a, ba, b, bb = pieces(text)
    if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return None
    ea, eb = np.cumsum([0, *map(len, ba)]).tolist(), np.cumsum([0, *map(len, bb)]).tolist()
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(max(0, np.searchsorted(eb, ea[i]) - 1), len(b)) if eb[j] < ea[i + 1] and eb[j + 1] > ea[i]] if len(a) < 300 else None
    cuts = sorted(set(ea) & set(eb))
    groups = [(a[ea.index(x):ea.index(y)], b[eb.index(x):eb.index(y)]) for x, y in zip(cuts, cuts[1:])]
    return len(a), len(b), groups, links


TEXTS = ["same text here", "same text here", "same text here", "Zuckerguß naïve café 東京 🙂🙂", "  lead and  double   spaces ", "tab\there\r\nand lines\n\n\nend ", "don't 's 'll x's 3.14159 12 345",
         "<|endoftext|> <s> </s> <unk> <0x0A>", "literal ▁ mark", "word.Next, (paren) [x]  nbsp  wide  space", "a\x1f b\x85 c᠎ d", "\n", " ", "   ", "x", "zero\x00byte here", "é ́alone"]


def test_alignment_equals_brute_force(spark):
    texts = [*TEXTS, None, ""]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, copies int")
    for size in (20, 1 << 20):  # many blocks, one block
        got = {r.doc_id: r for r in alignment.measure(frame, block_bytes=size).collect()}
        want = {i: brute(t) if t else None for i, t in enumerate(texts)}
        counts = Counter(p for w in want.values() if w for p in w[3])
        top = defaultdict(int)
        for (_, b), n in counts.items():
            top[b] = max(top[b], n)
        for i, w in want.items():
            r = got[i]
            if not w:
                assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, ""), texts[i]
                continue
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in w[2])
            assert tuple(r)[1:] == (w[0], w[1], len(w[2]), len(w[3]), sum(counts[p] == top[p[1]] for p in w[3]), sum(counts[p] for p in w[3]), hashlib.sha256(text.encode()).hexdigest()), texts[i]


def test_alignment_edges(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.measure(frame).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.measure(only).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    long = spark.createDataFrame([(1, "x" * 30_000), (1, "word " * 20_000), (3, "word " * 20_000)], "doc_id long, text string")
    got = alignment.measure(long, memo_units=1).collect()
    assert [r.n_groups > 0 for r in got] == [True] * 3


def test_align_links_and_cuts():
    for ends_a, ends_b, links, cuts in [([2, 5, 6], [3, 6], [(0, 0), (1, 0), (1, 1), (2, 1)], [(3, 2)]), ([1, 3], [1, 3], [(0, 0), (1, 1)], [(1, 1), (2, 2)])]:
        i, j, x, y = alignment.align(np.array(ends_a), np.array(ends_b))
        assert list(zip(i, j)) == links and list(zip(x, y)) == cuts
