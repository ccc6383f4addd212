import hashlib
import random

from pyspark.sql import functions as F

from lexirun.llm import common
from lexirun.llm.components import components
from lexirun.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id bigint, text string, keep_id string, kept string, __len int"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(seed=1, n=300):
    rng = random.Random(seed)
    pool = [None, "", "a", "A", "É", "é", "x" * 70, "X" * 69 + "y", "x" * 5000, "x" * 4999 + "y"] + ["".join(rng.choice("aAbB é") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    out = [(k, rng.choice(pool), "extra", None, k) for k in range(n)]
    return out + [(n + k, "hot", "extra", None, k) for k in range(n // 2)]


def check(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    found = exact_dedup(df, with_digest=True).collect()
    groups = {}
    for d, t, *_ in data:
        groups.setdefault(low(t), []).append(d)
    assert len(found) == len(data)
    for r in found:
        mine = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.content)
        assert (r.keep_id, r.group_size, r.kept) == (max(mine), len(mine), r.doc_id == max(mine))
        assert r.doc_id in mine


def test_against_brute_force(spark):
    check(spark, rows())


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HOT_PARTS", 5)
    check(spark, rows(2))


def test_full_hash_only_for_survivors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "abd"), (4, "AB")], "doc_id bigint, text string")
    found = {r.doc_id: r.content is not None for r in exact_dedup(df).collect()}
    assert found == {1: True, 2: False, 3: False, 4: True}


def test_null_ids_repeats_and_empty_table(spark):
    data = [(None, "a"), (None, "A"), (7, "b"), (7, "b"), (7, "c"), (None, "z"), (3, "z")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    found = exact_dedup(df).collect()
    assert sorted((r.group_size, r.kept) for r in found) == [(1, True), (2, False), (2, False), (2, False), (2, True), (2, True), (2, True)]
    assert {r.doc_id: r.kept for r in found if r.keep_id == 3} == {None: False, 3: True}
    assert exact_dedup(df.limit(0)).count() == 0
    kept = sorted(tuple(r) for r in drop_copies(df.filter("doc_id is not null")).collect())
    assert kept == [(3, "z"), (7, "b"), (7, "c")]


def test_drop_copies_keeps_columns(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    best = {}
    for d, t, *_ in rows(3):
        best[low(t)] = max(d, best.get(low(t), -1))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values())


def test_attach_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HOT_PARTS", 10)
    left = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(200)] + [(None, 900)], "key bigint, v bigint")
    groups = left.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("key is not null and key % 3 <> 0")
    got = {r.v: (r.n, r.top) for r in common.attach(left, groups, ["key"], "n", 200).collect()}
    known = {r.key: (r.n, r.top) for r in groups.collect()}
    assert got == {r.v: known.get(r.key, (None, None)) for r in left.collect()}


def test_dropping_copies_with_odd_rows_and_names(spark):
    schema = "doc_id bigint, text string, row string, id int, __len int, __content string, size string"
    data = [(None, "a", "x"), (None, "A", "x"), (7, "b", "x"), (7, "B", "x"), (7, "c", "x"), (None, "z", "x"), (3, "z", "x"), (8, None, "x"), (9, "", "x"), (1, "y" * 300_000, "x"), (2, "Y" * 300_000, "x")]
    df = spark.createDataFrame([(*r, 1, 2, "c", "s") for r in data], schema)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id or 0, low(r.text)[:3]) for r in kept.collect()), key=str) == sorted([(0, "a"), (7, "b"), (7, "c"), (3, "z"), (9, ""), (2, "yyy")], key=str)
    assert drop_copies(df.limit(0)).count() == 0


def largest_share(df):
    """Of the rows that one partition holds at most."""
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_no_key_gathers_in_one_partition(spark, monkeypatch):
    """Null keys and hot keys, beyond the broadcast limits and without help by Spark's own re-planning."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HOT_PARTS", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = common.cut(spark.range(6000).select(F.expr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE cast(id AS string) END").alias("key"), F.col("id").alias("v")))
        groups = common.cut(rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("first")))
        for met in (common.attach(rows, groups, ["key"], "n", 6000), common.lookup(rows, groups, ["key"])):
            assert largest_share(met) < 0.15
            assert met.filter("key = 'hot' and first <> 1 or key is null and first is not null").count() == 0 and met.filter("first is not null").count() == 4000
        hub = [(0, k) for k in range(1, 2000)] + [(5000 + k, 5001 + k) for k in range(30)]
        found = {r.node: r.comp for r in components(spark.createDataFrame(hub, "a bigint, b bigint")).collect()}
        assert found == {**{k: 0 for k in range(2000)}, **{5000 + k: 5000 for k in range(31)}}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scratch_leaves_only_what_is_kept(spark):
    import os

    with common.scratch() as keep:
        a, b = common.cut(spark.range(3)), common.cut(spark.range(4))
        with common.scratch() as inner:
            c, d = common.cut(spark.range(5)), common.cut(spark.range(6))
            inner(c)
        keep(a)
        assert [os.path.exists(x.cut_path) for x in (a, b, c, d)] == [True, True, True, False]
    assert [os.path.exists(x.cut_path) for x in (a, b, c)] == [True, False, False]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    try:
        common.shared_dir(Elsewhere)
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError
