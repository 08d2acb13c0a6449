"""Problem 3: groups of the same complaint."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.llm import mixture

#: (product, thing, cause); each is told in several ways.
MATTERS = [("Zorvex", "sealed vans", "the clock stops"), ("Zorvex", "metered bills", "a frame melts"), ("Kelmint", "sealed vans", "the clock stops"), ("Dornap", "urgent maps", "the cable hums")]
TELLINGS = ["Frustration with {0} over {1}: hard to sort, {2}, say nurses.", "Many users cannot sort {1} in {0} because {2}.", "Wish for a {0} replacement able to order {1}, as {2}.", "In Oakford people leave {0}; {2} whenever they arrange {1}."]


def rows(models=("m",)):
    out, i = [], 0
    for m in models:
        for p, t, c in MATTERS:
            for form in TELLINGS:
                i += 1
                out.append((i, m, form.format(p, t, c), f"{m}|{p}|{t}"))
    return out


def labels(df, **kw):
    return {r.id: r.group_id for r in mixture.same_meaning(df, record_id="id", text="text", model="model", left_out=F.col("model") == "fake", **kw).collect()}


def test_groups(spark):
    data = rows(("m", "n", "fake"))
    extra = [(900, "m", None, ""), (901, None, "Zorvex is slow", ""), (902, "m", "", ""), (903, "m", "...", ""), (904, "m", data[0][2], data[0][3]), (905, "m", "Nothing like it", "alone")]
    df = spark.createDataFrame(data + extra, "id bigint, model string, text string, want string").withColumn("words", F.lit(1)).withColumn("block", F.lit("x"))
    got = labels(df)
    want = {i: w for i, m, t, w in data + extra if m not in (None, "fake") and w}
    assert set(got) == set(want)
    by_group = {}
    for i, g in got.items():
        by_group.setdefault(g, set()).add(want[i])
    assert all(len(x) == 1 for x in by_group.values())
    assert len(by_group) == len(set(want.values()))


def test_a_hot_group_is_cut_into_pieces_and_comes_back_whole(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))
    nouns, adjectives, causes, people = [word(3) + "s" for _ in range(40)], [word(3) for _ in range(40)], [f"the {word(3)} {word(3)}s" for _ in range(30)], [word(3) for _ in range(30)]
    data, i = [], 0
    for m in range(60):
        matter = (word(4).title(), f"{rng.choice(adjectives)} {rng.choice(nouns)}", rng.choice(causes))
        for _ in range(120 if m == 7 else 4):
            i += 1
            data.append((i, "m", rng.choice(TELLINGS).replace("nurses", rng.choice(people)).replace("users", rng.choice(people)).format(*matter), m))
    df = spark.createDataFrame(data, "id bigint, model string, text string, m int")
    got = labels(df, piece_rows=16)
    hot = {got[i] for i, _, _, m in data if m == 7}
    assert len(got) == len(data) and len(hot) == 1 and sum(g in hot for g in got.values()) == 120


def test_empty(spark):
    assert labels(spark.createDataFrame([], "id bigint, model string, text string")) == {}


def test_mixture_finds_separate_samples():
    rng = np.random.default_rng(1)
    x = np.zeros((2, 12, 8))
    x[0, :6], x[0, 6:] = rng.normal(0, 0.1, (6, 8)), rng.normal(5, 0.1, (6, 8))
    x[1, :5] = rng.normal(0, 0.1, (5, 8))
    mask = np.ones((2, 12), bool)
    mask[1, 5:] = False
    label, density = mixture.fit(x, mask)
    assert len(set(label[0, :6])) == len(set(label[0, 6:])) == 1 and label[0, 0] != label[0, 6]
    assert len(set(label[1, :5])) == 1
    assert np.isfinite(density[mask]).all()


def test_query(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(i, m, t) for i, m, t, _ in rows(("m", "n"))], "id bigint, embedding_model string, extracted_insight string")
    df.write.parquet(f"{d}/nuggets.parquet")
    q = __spark_entry__.queries()
    got = sorted(map(tuple, q["p3_found"](spark, d).collect()))
    assert got == sorted((4 * g + a, 4 * g + b) for g in range(8) for a in range(1, 5) for b in range(a + 1, 5))
    groups = q["p3_groups"](spark, d).collect()
    assert sorted(r.size for r in groups) == [4] * 8 and all(len(r.typical_insights) == 3 for r in groups)
