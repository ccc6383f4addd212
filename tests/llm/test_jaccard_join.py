import random

import pytest

from lexirun.llm import common, jaccard_join
from lexirun.llm.components import components
from lexirun.llm.jaccard_join import drop_similar, similar_documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(data):
    sets = [shingles(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (d, *_) in enumerate(data):
        least[find(k)] = min(least.get(find(k), d), d)
    return sorted((d, len(sets[k]), least[find(k)]) for k, (d, *_) in enumerate(data))


def corpus(seed, n):
    """Clusters of edited copies around the threshold, exact copies, common passages, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([4, 5, 7, 20, 60, 90]))] for _ in range(8)]
    out = []
    for _ in range(n):
        kind, w = rng.random(), list(rng.choice(bases))
        if kind < 0.7:
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.85:
            w = passage + [word() for _ in range(rng.randint(3, 12))]
        elif kind < 0.9:
            w = w[: rng.randint(0, 6)]
        out.append(" ".join(w).upper() if rng.random() < 0.2 else " \n".join(w))
    return [(k, t, "x", 1.0) for k, t in enumerate([*out, None, "", " \t "])]


SCHEMA = "doc_id bigint, text string, token string, n double"


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    data = corpus(seed, 260)
    assert sorted(tuple(r) for r in similar_documents(spark.createDataFrame(data, SCHEMA)).collect()) == brute(data)


def test_exact_pass_alone_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TURNS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HOT_PARTS", 20)
    data = corpus(3, 140)
    assert sorted(tuple(r) for r in similar_documents(spark.createDataFrame(data, SCHEMA)).collect()) == brute(data)


def test_threshold_is_inclusive(spark):
    w = [f"w{k}" for k in range(100)]
    # 45 of 45 + 5 + 6 shingles are 80.4 %, and 40 of 50 exactly 80 %
    data = [(1, " ".join(w[:44]), "", 0.0), (2, " ".join(w[:54]), "", 0.0), (3, " ".join(w[:55]), "", 0.0)]
    found = sorted(tuple(r) for r in similar_documents(spark.createDataFrame(data, SCHEMA)).collect())
    assert found == brute(data) == [(1, 40, 1), (2, 50, 1), (3, 51, 1)]


def test_null_ids_and_repeats(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, "other words here in this text"), (None, None)], "doc_id bigint, text string")
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in similar_documents(df).collect()), key=str)
    assert found == sorted([(0, 2, 4), (4, 2, 4), (4, 2, 4), (9, 2, 9), (0, 0, None)], key=str)
    assert similar_documents(df.limit(0)).count() == 0


def test_drop_similar(spark):
    data = corpus(4, 80)
    df = spark.createDataFrame(data, SCHEMA)
    kept = drop_similar(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in brute(data)})


def test_dropping_similar_with_odd_rows_and_names(spark):
    text, near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", "ONE two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    long = " ".join(f"w{k}" for k in range(60_000))
    data = [(None, text, "a"), (4, near, "b"), (4, text, "c"), (9, "other words here in this text", "d"), (9, text, "e"), (None, None, "f"), (11, "", "g"), (11, "", "h")]
    data += [(None, "no id in this group at all", "i"), (None, "no id in this group at all", "j"), (20, long, "k"), (21, f"{long} more", "l")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, row string")
    df = df.selectExpr("*", "1 AS comp", "2 AS key", "3 AS k1", "'x' AS kept")
    kept = drop_similar(df)
    assert kept.columns == df.columns
    names = sorted(r.row for r in kept.collect())
    assert len({"b", "c"} & set(names)) == 1 and len({"i", "j"} & set(names)) == 1
    assert [n for n in names if n not in "bcij"] == ["d", "f", "g", "h", "k"]
    assert drop_similar(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()} == expected
