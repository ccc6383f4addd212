import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_index import asked, made

from lexirun.functions import matcher, statistics
from lexirun.operators import patterns as P
from lexirun.operators import runs as R
from lexirun.operators import search as U
from lexirun.plans import strategy
from lexirun.plans.strategy import choose, windows_of
from lexirun.sources import formats
from lexirun.streaming.locate import count_stream, locate_stream


def every(text: bytes, pattern: bytes) -> list[int]:
    return [k for k in range(len(text) - len(pattern) + 1) if text.startswith(pattern, k)]


@pytest.mark.parametrize("strategy", ["scan", "seeds"])
def test_locate_and_count(spark, strategy):
    rng = random.Random(4)
    texts = {k: bytes(rng.choice(b"ab\xc3\xa9\n") for _ in range(rng.randint(0, 60))) for k in range(40)}
    texts |= {50: b"aaaa", 51: b"", 52: b"aaaa"}
    patterns = [b"aa", b"a", b"\xa9\xc3", b"ab\n", b"zz", b"aa", b"b" * 90]
    corpus, ask = made(spark, texts), asked(spark, patterns)
    got = sorted(tuple(r) for r in U.locate(corpus, ask, strategy).select("pat_id", "text_id", "pos").collect())
    assert got == sorted((p, k, x) for p, pattern in enumerate(patterns) for k, t in texts.items() for x in every(t, pattern))
    counts = {r.pat_id: r.n_occ for r in U.count(corpus, ask, strategy).collect()}
    assert counts == {p: sum(len(every(t, pattern)) for t in texts.values()) for p, pattern in enumerate(patterns)}
    stats = U.query_statistics(U.count(corpus, ask, strategy), ask).first()
    assert (stats.n_pats, stats.n_occ, stats.missed) == (7, sum(counts.values()), sum(v == 0 for v in counts.values()))


@pytest.mark.parametrize("strategy", ["scan", "seeds"])
def test_empty_inputs(spark, strategy):
    corpus, ask = made(spark, {1: b"abc"}), asked(spark, [b"a"])
    assert U.locate(corpus.limit(0), ask, strategy).count() == 0
    assert U.locate(corpus, ask.limit(0), strategy).count() == 0
    with pytest.raises(Exception, match="empty pattern"):
        U.locate(corpus, asked(spark, [b"a", b""]), strategy).collect()
    assert choose(ask) == "scan"


def test_no_match_spans_texts(spark):
    assert U.locate(made(spark, {1: b"ab", 2: b"cd"}), asked(spark, [b"bc"])).count() == 0


def test_sampling(spark):
    texts = {1: b"abc\ndefghij", 2: b"klmnop", 3: b"xy"}
    corpus = made(spark, texts)
    drawn = P.sample_patterns(corpus, 5, 3, 10).collect()
    assert len(drawn) == 5 == len({(r.text_id, r.pos) for r in drawn})
    assert all(bytes(r.pattern) == texts[r.text_id][r.pos : r.pos + 3] and 10 not in r.pattern for r in drawn)
    assert drawn == P.sample_patterns(corpus.repartition(3), 5, 3, 10).collect()
    assert P.sample_patterns(corpus, 5, 3, 10, seed=1).collect() != drawn
    assert P.sample_patterns(corpus, 100, 3, 10).count() == 1 + 5 + 4
    kept = P.at_most(corpus, asked(spark, [b"a", b"k", b"q"]), 0)
    assert [r.pat_id for r in kept.collect()] == [2]


def test_windows_and_histogram(spark):
    corpus = made(spark, {1: b"aab", 2: b"b"})
    assert sorted(bytes(r.window) for r in windows_of(corpus, 2).collect()) == [b"aa", b"ab"]
    assert {(r.sym, r.freq) for r in R.symbol_histogram(corpus).collect()} == {(97, 2), (98, 2)}
    assert [(r.sym, r.c_lo, r.code) for r in R.alphabet(R.symbol_histogram(corpus)).orderBy("sym").collect()] == [(97, 0, 0), (98, 2, 1)]
    values = spark.createDataFrame([(float(x),) for x in [*range(20), 1000]], "x double")
    assert sum(r.n for r in statistics.histogram(values, "x").collect()) == 20
    assert statistics.histogram(spark.createDataFrame([(3.0,)], "x double"), "x").collect()[0].n == 1


def test_histogram_against_brute_force(spark):
    drawn = np.random.default_rng(3).integers(0, 60, 203) ** 2
    found = statistics.histogram(spark.createDataFrame([(float(x),) for x in drawn] + [(None,)], "x double"), "x")
    q1, q3 = np.percentile(drawn, [25, 75])
    kept = drawn[drawn <= q3 + 1.5 * (q3 - q1)]
    width = (kept.max() - kept.min()) / 20
    bins = Counter(min(19, int((x - kept.min()) / width)) for x in kept.tolist())
    assert {r.bin: r.n for r in found.collect()} == bins
    assert statistics.histogram(spark.createDataFrame([], "x double"), "x").collect() == []


def test_pattern_files(spark, tmp_path):
    path, ask = f"{tmp_path}/p.pat", asked(spark, [b"a\nb", b"\0\xffc", b"   "])
    formats.write_patterns(ask, path, "some text", 10)
    with open(path, "rb") as f:
        assert f.read() == b"# number=3 length=3 file=some text forbidden=10\na\nb\0\xffc   "
    assert sorted((r.pat_id, bytes(r.pattern)) for r in formats.read_patterns(spark, path).collect()) == [(0, b"a\nb"), (1, b"\0\xffc"), (2, b"   ")]
    with pytest.raises(ValueError, match="different lengths"):
        formats.write_patterns(asked(spark, [b"a", b"ab"]), path)
    (tmp_path / "bad").write_bytes(b"# number=9 length=3 file=x forbidden=\nabc")
    with pytest.raises(Exception, match="announced"):
        formats.read_patterns(spark, f"{tmp_path}/bad").collect()
    fasta = [r.value for r in P.fasta(asked(spark, [b"ab"])).collect()]
    assert fasta == [">pat_0\nab"]


def test_transform_files(spark, tmp_path):
    (tmp_path / "x.bwt").write_bytes(b"ccbc\0aaaabbb")
    plain = formats.read_bwt(spark, f"{tmp_path}/x.bwt", "plain")
    rows = [(r.run_id, r.sym, r.head_i, r.len) for r in plain.orderBy("run_id").collect()]
    assert rows == [(0, 99, 0, 2), (1, 98, 2, 1), (2, 99, 3, 1), (3, 0, 4, 1), (4, 97, 5, 4), (5, 98, 9, 3)]
    formats.write_rle_bwt(plain, f"{tmp_path}/x.rle")
    assert (tmp_path / "x.rle").read_bytes()[:28] == bytes([1, *[0] * 7, 5, *[0] * 7, 99, 2, 0, 0, 0, 0, 98, 1, 0, 0, 0, 0])
    again = formats.read_bwt(spark, f"{tmp_path}/x.rle", "rle")
    assert [(r.run_id, r.sym, r.head_i, r.len) for r in again.orderBy("run_id").collect()] == rows
    with pytest.raises(ValueError, match="unknown format"):
        formats.read_bwt(spark, f"{tmp_path}/x.rle", "other")
    (tmp_path / "broken").write_bytes(b"\1" * 21)
    with pytest.raises(Exception, match="not a run-length file"):
        formats.read_bwt(spark, f"{tmp_path}/broken", "rle").collect()


def test_sample_files(spark, tmp_path):
    samples = spark.createDataFrame([(0, 11), (1, (1 << 39) + 5)], "run_id bigint, sample bigint")
    formats.write_samples(samples, f"{tmp_path}/s")
    assert len((tmp_path / "s").read_bytes()) == 20
    assert sorted(tuple(r) for r in formats.read_samples(spark, f"{tmp_path}/s").collect()) == [(0, 11), (1, (1 << 39) + 5)]
    (tmp_path / "both").write_bytes(b"".join(x.to_bytes(8, "little") for x in (4, 5, 6, 7)))
    assert sorted(tuple(r) for r in formats.read_collection_samples(spark, f"{tmp_path}/both").collect()) == [(0, 4, 5), (1, 6, 7)]
    assert sorted(tuple(r) for r in formats.read_string_ranges(spark, f"{tmp_path}/both").collect()) == [(0, 4, 5), (1, 5, 6), (2, 6, 7)]


def test_stream(spark, tmp_path):
    made(spark, {1: b"abab"}).write.parquet(f"{tmp_path}/in")
    made(spark, {2: b"ba"}).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("text_id bigint, bytes binary").parquet(f"{tmp_path}/in")
    ask = asked(spark, [b"ab", b"ba"])
    for name, df, mode in (("places", locate_stream(source, ask), "append"), ("counts", count_stream(source, ask), "complete")):
        running = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        running.processAllAvailable()
        running.stop()
    assert sorted(tuple(r) for r in spark.table("places").collect()) == [(0, 1, 0), (0, 1, 2), (1, 1, 1), (1, 2, 0)]
    assert {r.pat_id: r.n_occ for r in spark.table("counts").collect()} == {0: 2, 1: 2}


def test_lengths_by_expression(spark):
    assert made(spark, {1: "é".encode()}).select(F.octet_length("bytes")).first()[0] == 2


def many_patterns(rng, texts, number, longest):
    out = []
    for _ in range(number):
        t = texts[rng.choice(list(texts))]
        a = rng.randrange(len(t))
        out.append(t[a : a + rng.randint(1, longest)])
    return out


def test_seeds_of_all_lengths(spark):
    rng = random.Random(11)
    texts = {k: bytes(rng.choice(b"abc\xc3\0") for _ in range(rng.randint(1, 400))) for k in range(30)}
    texts[40] = b"ab" * 3000
    patterns = many_patterns(rng, texts, 300, 100) + [b"a", b"ab", b"abc", b"ab" * 400, b"\0", b"zz"]
    corpus, ask = made(spark, texts), asked(spark, patterns)
    assert sorted(U.locate(corpus, ask, "seeds").collect()) == sorted(U.locate(corpus, ask, "scan").collect())


def test_seeds_shuffle_no_texts_with_windows(spark):
    corpus, ask = made(spark, {1: b"abc" * 50}), asked(spark, [b"abcab"])
    windows = strategy.seed_windows(corpus, strategy._seeded(ask))
    assert windows.columns == ["seed", "text_id", "pos"] and windows.count() < 60


def test_windows_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(matcher, "STRETCH", 64)
    text = bytes(random.Random(2).choice(b"ab") for _ in range(1000))
    patterns = [text[k : k + 40] for k in range(0, 960, 7)] + [b"a", b"abba"]
    which, where = matcher.Matcher(patterns).find(text)
    assert sorted(zip(which.tolist(), where.tolist(), strict=True)) == sorted((p, x) for p, pattern in enumerate(patterns) for x in every(text, pattern))
    corpus, ask = made(spark, {1: text}), asked(spark, patterns)
    assert sorted(U.locate(corpus, ask, "seeds").collect()) == sorted(U.locate(corpus, ask, "scan").collect())


def test_twenty_megabytes_of_patterns(spark):
    """More than goes to every task: chosen by size, one pattern of one byte among them."""
    rng = random.Random(3)
    texts = {k: rng.randbytes(60_000) for k in range(8)}
    patterns = [t[a : a + 2000] for t in texts.values() for a in range(0, 58_000, 43)] + [b"\x07"]
    patterns += [rng.randbytes(2000) for _ in range(300)]
    corpus, ask = made(spark, texts), asked(spark, patterns)
    assert choose(ask) == "seeds" and sum(map(len, patterns)) > 20 << 20
    counts = {r.pat_id: r.n_occ for r in U.count(corpus, ask).collect()}
    assert all(counts[k] == 1 for k in range(len(patterns) - 301)) and not any(counts[k] for k in range(len(patterns) - 300, len(patterns)))
    assert counts[len(patterns) - 301] == sum(t.count(7) for t in texts.values())
    with pytest.raises(ValueError, match="over 16 MB"):
        U.locate(corpus, ask, "scan")


@pytest.mark.parametrize("plan", ["scan", "seeds"])
def test_null_and_repeated_patterns(spark, plan):
    corpus = spark.createDataFrame([(1, bytearray(b"aab")), (2, None), (None, bytearray(b"b"))], "text_id bigint, bytes binary")
    ask = spark.createDataFrame([(1, bytearray(b"a")), (1, bytearray(b"b")), (2, None), (3, bytearray(b"a"))], "pat_id bigint, pattern binary")
    assert sorted((r.pat_id, r.n_occ) for r in U.count(corpus, ask, plan).collect()) == [(1, 1), (1, 2), (2, 0), (3, 2)]
    found = [(r.pat_id, r.text_id, r.pos) for r in U.locate(corpus, ask, plan).collect()]
    assert sorted(found) == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (3, 1, 0), (3, 1, 1)]
    assert U.intervals(corpus, ask).filter("pat_id = 2").count() == 0


def test_draws_are_even(spark):
    corpus = made(spark, {1: b"x" * 40, 2: b"y" * 4000})
    places = [r.pos for s in range(20) for r in P.sample_patterns(corpus, 20, 3, seed=s).collect()]
    assert len(places) == 400 and 1600 < sum(places) / len(places) < 2400
    sizes = spark.createDataFrame([(1, 3), (2, 5000), (3, 0)], "text_id bigint, n bigint")
    drawn = [(r.text_id, r.i) for r in P.sample_positions(sizes, 10).collect()]
    assert len(set(drawn)) == len(drawn) == 13 and all(0 <= i < 5000 for _, i in drawn)
