"""Problem 6: pairs of the same content in different formatting."""

import random

import __spark_entry__
from tidemark.llm import copies
from tidemark.llm.pairs import pairs_within


def test_pairs_and_copies(spark, tmp_path):
    d = str(tmp_path)
    texts = [(1, "It's broken, again!"), (2, "ITS  broken again"), (3, "its broken"), (4, None), (5, "its-broken-again"), (6, "Café zu"), (7, "CAFÉ ZU"), (8, "cafe zu")]
    spark.createDataFrame(texts, "id bigint, raw_text string").write.parquet(f"{d}/nuggets.parquet")
    batches = [
        (1, '[{"id":"a","score":1,"body":"Hello there"}]'), (2, '[ {"body":"hello, THERE", "score":1.0, "id":"A"} ]'), (3, '[{"id":"a","score":"1","body":"Hello there"}]'),
        (4, "[]"), (5, "[ ]"), (6, '[{"id":"a"'), (7, '[{"id":"a"'), (8, None), (9, '[{"id":"a","score":1,"body":"Hello there"},{"id":"b"}]'), (10, '[{"id":"b"},{"id":"a","score":1,"body":"Hello there"}]'),
        (11, '[{"id":"a","score":null,"body":"Hello there"}]'), (12, '[{"id":"a","body":"Hello there"}]'), (13, '[{"id":"a","score":true,"body":"Hello there"}]'),
    ]
    spark.createDataFrame(batches, "id bigint, comments string").write.parquet(f"{d}/ingest_batch.parquet")
    q = __spark_entry__.queries()
    assert sorted(map(tuple, q["p6_found"](spark, d).collect())) == [("ingest_batch", 1, 2), ("nuggets", 1, 2), ("nuggets", 1, 5), ("nuggets", 2, 5), ("nuggets", 6, 7)]
    assert sorted((r.id, r.copies) for r in q["p6_copies"](spark, d).collect() if r.table_name == "nuggets") == [(1, 3), (3, 1), (6, 2), (8, 1)]


def test_trie_counts_by_terminal():
    rng, trie, want = random.Random(1), copies.Trie(), {}
    for i in range(3000):
        k = bytes(rng.choice(b"ab") for _ in range(8))
        trie.add(k, 2, i)
        n, first = want.get(k, (0, i))
        want[k] = (n + 2, min(first, i))
    assert sorted(trie.terminals()) == sorted([k, n, first] for k, (n, first) in want.items())


def test_oversized_buckets_are_split_and_a_hot_content_is_one_state(spark):
    texts = [(i, "hot") for i in range(900)] + [(1000 + i, f"text {i % 300}") for i in range(600)] + [(None, "hot"), (5000, None)]
    keyed = copies.digests(spark.createDataFrame(texts, "id bigint, t string").repartition(3), "id", "t", copies.text_form)
    got = {(r.copies, r.first_id) for r in copies.count_copies(keyed, bucket_states=7).collect()}
    assert got == {(900, 0)} | {(2, 1000 + i) for i in range(300)}
    assert copies.count_copies(keyed.limit(0)).count() == 0


def test_pairs_of_a_group_larger_than_a_block(spark):
    m = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("b", 2), ("b", 2), (None, 3), ("c", None)], "g string, id bigint")
    got = sorted(map(tuple, pairs_within(m, "g", "id", block=7).collect()))
    assert got == sorted([(i, j) for i in range(50) for j in range(i + 1, 50)] + [(1, 2)])
