import zlib

import pytest

from lexirun.llm import ranking
from lexirun.llm.common import cut
from lexirun.llm.queries import op1_sampled_splitters
from lexirun.llm.sharding import assign_shards


def check(spark, data, shards):
    df = spark.createDataFrame(data, "doc_id bigint, text string, shard int")
    found = assign_shards(df, shards).collect()
    sizes = {}
    for d, t, _ in data:
        sizes.setdefault(d, []).append((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in found) == sorted((d if d is not None else -1, *x) for d, v in sizes.items() for x in v)
    total, by = sum(r.size for r in found), {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    largest = max((r.size for r in found), default=0)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / shards) < largest + 1
    return {(r.doc_id, r.shard, r.slot) for r in found}


def texts(n):
    return [(k, None if k % 50 == 0 else f"text é {k * k % 97} " * (k % 13), k) for k in range(n)]


def test_bytes_are_equal_and_slots_gapless(spark):
    data = texts(2000) + [(5000 + k, "the same copy " * 9, 0) for k in range(1000)]
    assert check(spark, data, 40) == check(spark, data[::-1], 40)


def test_hot_group_is_subdivided(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGES", 16)
    keys = cut(spark.createDataFrame([(7, k, 10) for k in range(3000)] + [(k, k, 10) for k in range(300)], "major bigint, minor bigint, weight bigint"))
    found = ranking.ranked(keys, 16).collect()
    found.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == list(range(3300)) and [r.before for r in found] == [10 * k for k in range(3300)]
    assert [(r.major, r.minor) for r in found] == sorted((r.major, r.minor) for r in found)


def test_rows_equal_in_id_and_text_are_divisible(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGES", 16)
    seen = []
    monkeypatch.setattr(ranking, "_array", lambda pairs, binary, made=ranking._array: seen.append(len(pairs)) or made(pairs, binary))
    check(spark, [(7, "the same", 0)] * 1500 + [(k, f"text {k}", 0) for k in range(300)], 8)
    assert seen[-1] > 10


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found, shards = op1_sampled_splitters(spark, sf_dir).collect(), {}
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        shards.setdefault(r.shard, []).append(r)
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    assert set(shards) <= set(range(40))
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 40) <= largest


def test_order_by_bytes(spark):
    words = [f"{k % 7}/{k}".encode() for k in range(500)]
    keys = cut(spark.createDataFrame([(bytearray(w), 1, 1) for w in words], "major binary, minor bigint, weight bigint"))
    found = sorted(ranking.ranked(keys, 8).collect(), key=lambda r: r["rank"])
    assert [bytes(r.major) for r in found] == sorted(words)


@pytest.mark.parametrize("data", [[], [(1, None, 0)], [(None, "a", 0), (None, "a", 0), (3, "a", 0)], [(k, "x" * 100_000 * (k == 3), 0) for k in range(9)]])
def test_small_and_odd_tables(spark, data):
    check(spark, data, 4)
