"""Findings of round 3: what the training-data operators move and make."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fusionframe.llm import common, minhash, sharding, substrings, topk


def test_written_shards_are_not_moved_again(spark, tmp_path):
    docs = spark.range(500).selectExpr("id doc_id", "concat('text ', id) text")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on a table whose size Spark cannot tell
    try:
        sharding.write_shards(docs, str(tmp_path / "s"), "doc_id", ["doc_id", "text"], shards=3, bucket_bytes=2000)
        out = sharding.read_shards(spark, str(tmp_path / "s"), "doc_id long, text string, grown_shard int, bucket int, place int, shard int")
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for shard in range(3):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def near_misses(n, seed=5):
    """Variants of one text of 120 words, each with 2 to 6 words of its own, and their five-word shingles."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(n):
        words = list(base)
        for at in rng.choice(120, 2 + k % 5, replace=False):
            words[at] = f"own{k}x{at}"
        rows.append(" ".join(words))
    return rows, [{tuple(t.split()[i:i + 5]) for i in range(116)} for t in rows]


def test_near_misses_are_not_made_into_rows(spark, monkeypatch):
    texts, sets = near_misses(400)
    made, write = {}, minhash.materialize

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.col("doc_id"))
    kept = sorted(r.uid for r in minhash.first_of_groups(frame).collect())
    assert max(made["pairs"]) <= 400 * 15 * 31 / 8  # the pairs of this group are 79,800, nearly all in some bucket
    root = list(range(400))
    for i in range(400):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    want = sorted(set(root))
    assert set(want) <= set(kept) and len(kept) <= len(want) * 1.03 and 40 < len(want) < 390


def test_blocks_find_all_pairs():
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 2 ** 62, 3000).astype(np.uint64)
    sets = []
    for k in range(120):
        own = rng.choice(pool, 100, replace=False)
        sets += [np.unique(own), np.unique(np.concatenate((own[k % 25:], rng.choice(pool, k % 9))))]
    left, right = np.arange(0, 240, 3), np.arange(240)
    got = set(zip(*(x.tolist() for x in minhash.alike(sets, left, right))))
    want = set()
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                want.add((i, j))
    assert got == want and len(want) > 100
    assert minhash.joining([(0, 1), (1, 2), (0, 2), (3, 0), (4, 3)], [5, 6, 7, 5, 8]) == [(0, 1), (1, 2), (4, 3)]


def test_large_buckets_in_many_blocks(spark, monkeypatch):
    texts, _ = near_misses(150, 7)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.col("doc_id"))
    whole = {r.uid for r in minhash.first_of_groups(frame).collect()}
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 20)
    assert {r.uid for r in minhash.first_of_groups(frame).collect()} == whole
    monkeypatch.setattr(minhash, "PAIRED", 1000)
    assert {r.uid for r in minhash.first_of_groups(frame).collect()} == whole


def test_simhash_links_make_buckets(spark):
    rows = [(1, 9, 9, 0b1000), (2, 9, 9, 0b1011), (3, 9, 9, 0b11111011), (4, 9, 9, 0b1111000000000000), (5, 0, 0, 0b1000), (6, 9, 9, 0b1111000000000000)]
    classes = spark.createDataFrame(rows, "rep long, size long, bytes long, fp long")
    key = {r.rep: r.key for r in minhash._simhash_keys(classes).collect()}
    assert set(key) == {1, 2, 3, 4, 6} and key[1] == key[2] and key[4] == key[6] and len({key[1], key[3], key[4]}) == 3


def test_top_k_of_a_tile_that_bounds_do_not_prune():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(5000, 64)) * 256).astype(np.int64)
    vectors[100:140] = vectors[60:100]  # equal scores
    ids = rng.permutation(5000)

    def plain():
        scores = vectors[:1000].astype(float) @ vectors.astype(float).T
        scores[np.arange(1000), np.arange(1000)] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :5]
        return ids[order], np.take_along_axis(scores, order, axis=1)

    start = time.process_time()
    want = plain()
    middle = time.process_time()
    q, v, s = topk.block_top_k(ids[:1000], vectors[:1000], ids, vectors, 5)
    took, allowed = time.process_time() - middle, 4 * (middle - start)
    assert (q.reshape(-1, 5) == ids[:1000, None]).all() and (v.reshape(-1, 5) == want[0]).all() and (s.reshape(-1, 5) == want[1]).all()
    assert took < allowed  # pair by pair: over eight times the time of sorting all scores


def test_small_trees_are_a_stream(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key in range(300):
        base = [f"w{x}" for x in rng.integers(0, 50, 45)]
        other = base[:40] + ["z"] * 5
        rows += [(key, b"a", bytearray(" ".join(base).encode()), 11, 1), (key, b"b", bytearray(" ".join(other).encode()), 11, 1)]
        want |= {(key, b"a"): 0b111111, (key, b"b"): 0b111111}
    frame = spark.createDataFrame(rows, "key long, same binary, body binary, n int, copies long")
    masks = substrings._tree_masks(frame)
    assert {(r.key, bytes(r.same)): r.mask for r in masks.collect()} == want
    # one call of Python for each key costs more than its tree
    assert "FlatMapGroups" not in masks._jdf.queryExecution().executedPlan().toString()


def test_runs_of_keys_go_on_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([], []), ([2], [4]), ([2, 3], [5, 6]))]
    batches[1] = batches[0].slice(0, 0)
    assert list(common.key_runs(batches, ["k"], ["v"])) == [((1,), [[1, 2]]), ((2,), [[3, 4, 5]]), ((3,), [[6]])]
