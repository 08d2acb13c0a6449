"""Problem 4: batches against all history."""

import __spark_entry__
from tidemark.llm import history
from tidemark.llm.winnow import fingerprints

OLD = "School secretaries lose money on Tremanest since the licence check expects American dates and overdue curves are slow to copy"
OTHER = "Wish for a Lumsamint replacement able to plan weekly exports, as the access assistant tears long tables apart for contractors"
NEW = "Because the webhook fires twice so deadlines slip, sponsored hive inspections pile up in Bripadial and nobody finds time"


def write(spark, d, incoming):
    spark.createDataFrame([(1, "r:a:1", OLD), (2, None, None), (3, "r:a:3", "")], "id bigint, unique_key string, extracted_insight string").write.parquet(f"{d}/nuggets.parquet")
    spark.createDataFrame([("AB12", "t"), ("ab12", "t"), (None, "t")], "fingerprint string, thread_id string").write.parquet(f"{d}/ingested_comments.parquet")
    spark.createDataFrame(incoming, "incoming_id bigint, batch_no int, fingerprint string, unique_key string, extracted_insight string").write.parquet(f"{d}/nuggets_incoming.parquet")


def test_batches(spark, tmp_path):
    d = str(tmp_path)
    rows = [
        (1, 1, " aB12 ", None, NEW), (2, 1, None, " R:A:1", None), (3, 1, "zz", "r:b:9", OLD.upper() + " !!"), (4, 1, None, None, NEW), (5, 1, None, None, NEW.replace(",", " ;")),
        (6, 1, None, None, "note: " + NEW), (7, 1, None, None, None), (8, 1, None, None, ""), (9, 2, None, None, NEW.replace("twice", "twcie")), (10, 2, None, None, OTHER), (11, 2, "", "", "short"),
        (12, 3, None, None, "Short"), (13, 3, None, None, OTHER.replace("Lumsamint", "Kelmint").replace("weekly exports", "daily maps").replace("long tables", "every sheet")), (14, None, None, None, OLD[:-12]),
    ]
    write(spark, d, rows)
    got = {r.incoming_id: r.reason for r in __spark_entry__.queries()["p4_decisions"](spark, d).collect() if r.decision == "refuse"}
    assert got == {1: "known_key", 2: "known_key", 3: "known_key", 5: "same_text", 6: "near_text", 9: "known_text", 12: "known_key", 14: "known_text"}


def test_no_incoming_rows(spark, tmp_path):
    d = str(tmp_path)
    write(spark, d, [])
    assert __spark_entry__.queries()["p4_found"](spark, d).count() == 0


def test_bloom_has_no_false_negatives():
    import numpy as np

    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bloom = history.bloom_build(h)
    assert history.bloom_test(bloom, h).all()
    assert history.bloom_test(bloom, h + 1).mean() < 0.01


def test_fingerprints_of_shared_text_and_short_texts():
    a, b = "x" * 5 + "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog" + "y" * 9
    row, h = fingerprints([a, b, "", "abc", "abc "], 12, 4)
    of = lambda i: set(h[row == i].tolist())
    assert of(0) & of(1) and not of(2) and of(3) == of(4) != set()
    one = fingerprints([b], 12, 4)[1]
    assert of(1) == set(one.tolist())


def test_word_marks_refuse_no_rewording(spark):
    import random
    from difflib import SequenceMatcher

    import numpy as np

    rng, words = random.Random(3), [f"w{i}" for i in range(400)]
    pairs = []
    for _ in range(400):
        a = rng.choices(words, k=rng.choice([1, 8, 25, 300]))
        b = [w if rng.random() > 0.1 else rng.choice(words) for w in a if rng.random() > 0.05]
        pairs.append((" ".join(a), " ".join(b)))
    shared = " ".join(words[:8])
    pairs.append((shared + " " + " ".join(words[50:70]), shared + " " + " ".join(words[80:100])))  # one fingerprint in common, else unlike
    x, y = history.word_marks([a for a, _ in pairs]), history.word_marks([b for _, b in pairs])
    got = history.may_reword(x, y, 0.86)
    want = np.array([SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio() >= 0.86 for a, b in pairs])
    assert want.sum() > 100 and got[want].all() and not got[-1]
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, a bigint, b bigint")
    assert {r.i for r in df.where(history._may_reword("a", "b", 0.86)).collect()} == set(np.flatnonzero(got).tolist())


def test_a_part_is_asked_once_for_all_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "h": pa.array(h, pa.int64())}) for p, h in (([], []), ([1, 1], [5, 6]), ([1, 2], [7, 8]), ([2], [9]), ([4], [3]))]
    assert [(p, b["h"].to_pylist()) for p, b in history._by_part(iter(batches))] == [(1, [5, 6, 7]), (2, [8, 9]), (4, [3])]
