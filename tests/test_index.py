import random

import pytest
from naive import bwt, occurrences, runs, suffix_array
from pyspark.sql import functions as F

from lexirun.functions import suffixsort
from lexirun.operators import corpus as C
from lexirun.operators import primitives as Q
from lexirun.operators import runs as R
from lexirun.operators import samples as S
from lexirun.operators import search as U
from lexirun.operators import suffix as X
from lexirun.plans import index as index_plans
from lexirun.plans.index import build_index, load_index, read_metadata
from lexirun.sources import formats

#: Text, suffix array, transform, head and tail samples.
GOLDEN = {
    1: (b"abcabcababc", [11, 6, 8, 3, 0, 7, 9, 4, 1, 10, 5, 2], b"ccbc\0aaaabbb", [11, 8, 3, 0, 7, 10], [6, 8, 3, 0, 1, 2]),
    2: (b"abracadabra", [11, 10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2], b"ard\0rcaaaabb", [11, 10, 7, 0, 3, 5, 8, 9], [11, 10, 7, 0, 3, 5, 6, 2]),
    3: (b"alabaralaalabarda", [17, 16, 8, 2, 11, 6, 0, 9, 4, 13, 3, 12, 15, 7, 1, 10, 5, 14], None, [17, 16, 8, 6, 0, 9, 4, 3, 15, 7], [17, 16, 11, 6, 0, 9, 13, 12, 15, 14]),
    4: (b"mississippi", [11, 10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2], b"ipssm\0pissii", [11, 10, 7, 1, 0, 9, 8, 6, 5], [11, 10, 4, 1, 0, 9, 8, 3, 2]),
}


def made(spark, texts: dict[int, bytes]):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "text_id bigint, bytes binary")


def asked(spark, patterns):
    return spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(patterns)], "pat_id bigint, pattern binary")


@pytest.fixture(scope="module")
def golden(spark):
    return made(spark, {k: v[0] for k, v in GOLDEN.items()})


def by_text(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.text_id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_golden_suffixes_and_runs(golden):
    rows = X.suffixes(golden)
    found = by_text(rows, "i", "pos", "sym")
    heads = by_text(R.runs(rows), "head_i", "sym", "len", "head_sa", "tail_sa")
    for k, (text, order, symbols, head_sa, tail_sa) in GOLDEN.items():
        assert [x[1] for x in found[k]] == order
        assert symbols is None or bytes(x[2] for x in found[k]) == symbols
        assert [x[3] for x in heads[k]] == head_sa and [x[4] for x in heads[k]] == tail_sa
        assert [(c, n, i) for i, c, n, *_ in heads[k]] == runs(bwt(text + b"\0"))
    assert found == by_text(X.suffixes_by_window(golden), "i", "pos", "sym")


def test_golden_c_table(golden):
    table = by_text(R.c_table(R.runs(X.suffixes(golden.filter("text_id = 1")))), "sym", "c_lo")
    assert table[1] == [(0, 0), (97, 1), (98, 5), (99, 9)]


def test_golden_samples_and_blocks(golden):
    found = R.runs(X.suffixes(golden))
    kept, blocks = by_text(S.head_samples(found, 4), "head_sa"), by_text(S.phi_blocks(found, 4), "start", "len", "diff", "valid_area")
    assert [x[0] for x in kept[1]] == [0, 3, 7, 11]
    assert [x[0] for x in kept[3]] == [0, 4, 8, 9, 15, 17]
    assert blocks[1] == [(0, 3, 7, 1), (3, 5, -3, 3), (8, 4, -5, 0)]
    assert blocks[3] == [(0, 6, 9, 0), (6, 3, -6, 0), (9, 3, -5, 2), (12, 4, 3, 1), (16, 2, -8, 1)]


def test_golden_locate(spark, golden):
    patterns = asked(spark, [b"ab", b"aba", b"bc", b"zz", b"ca\0"[:2]])
    index = build_index(golden.filter("text_id = 1"), "csa", 4)
    got = {}
    for r in index.locate(patterns).collect():
        got.setdefault(r.pat_id, []).append((r.ord, r.pos))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {0: [6, 8, 3, 0], 1: [6], 2: [9, 4, 1], 4: [5, 2]}
    assert sorted((r.pat_id, r.l, r.r) for r in index.count(patterns).collect()) == [(0, 1, 4), (1, 1, 1), (2, 6, 8), (4, 10, 11)]


def random_texts(seed: int, number: int) -> dict[int, bytes]:
    rng, out = random.Random(seed), {}
    for k in range(number):
        base = bytes(rng.choice(b"acgt\xc3\xff"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 30)))
        out[k] = b"".join(base if rng.random() < 0.7 else base[: rng.randint(0, len(base))] + b"a" for _ in range(rng.randint(1, 4)))
    return out


@pytest.mark.parametrize("step", [1, 2, 4, 16])
def test_index_against_brute_force(spark, step):
    texts, rng = random_texts(step, 60), random.Random(step)
    texts |= {100: b"", 101: b"a", 102: b"aaaa", 103: b"cba", 104: b"zyxzyx"}
    patterns = {p for t in texts.values() if t for p in (t[: rng.randint(1, 5)], t[-rng.randint(1, 4) :], t[len(t) // 2 :][:3])} | {b"q", b"aa", b"a" * 200}
    patterns = sorted(p for p in patterns if p)
    index, ask = build_index(made(spark, texts), "csa", step), asked(spark, patterns)
    got, spans = {}, {(r.text_id, r.pat_id): (r.l, r.r, r.first_pos) for r in index.count_with_head(ask).collect()}
    for r in index.locate(ask).collect():
        got.setdefault((r.text_id, r.pat_id), {})[r.ord] = r.pos
    for k, text in texts.items():
        order = suffix_array(text + b"\0")
        for p, pattern in enumerate(patterns):
            expected = occurrences(text + b"\0", pattern)
            assert [x for _, x in sorted(got.get((k, p), {}).items())] == expected
            if expected:
                l = order.index(expected[0])
                assert spans[k, p] == (l, l + len(expected) - 1, expected[0])
            else:
                assert (k, p) not in spans


def test_primitives_against_brute_force(spark):
    texts = random_texts(9, 25)
    rows = X.suffixes(made(spark, texts))
    found = R.runs(rows).cache()
    table = R.c_table(found)
    full = {k: t + b"\0" for k, t in texts.items()}
    every = spark.createDataFrame([(k, i, c) for k, t in full.items() for i in range(len(t) + 1) for c in {*t, 98}], "text_id bigint, i bigint, sym smallint")
    symbols = {k: bwt(t) for k, t in full.items()}
    for r in Q.rank(found, every).collect():
        s = symbols[r.text_id]
        assert r["rank"] == s[: r.i].count(r.sym)
        assert r.is_head == (not (0 < r.i < len(s) and s[r.i - 1] == s[r.i] == r.sym))
    heads = {k: {i: suffix_array(full[k])[i] for _, _, i in runs(s)} for k, s in symbols.items()}
    for r in Q.successor_head(found, every).collect():
        after = [i for i in sorted(heads[r.text_id]) if i >= r.i and symbols[r.text_id][i] == r.sym]
        assert (r.succ_i, r.succ_sa) == ((after[0], heads[r.text_id][after[0]]) if after else (None, None))
    places = every.select("text_id", "i").distinct()
    for r in Q.access(found, places).collect():
        s = symbols[r.text_id]
        assert r.sym == (s[r.i] if r.i < len(s) else None)
    inside = R.expand(found).select("text_id", "i")
    lf = {(r.text_id, r.i): r.lf for r in Q.lf(found, table, inside).collect()}
    fl = {(r.text_id, r.i): r.fl for r in Q.fl(found, table, inside).collect()}
    psi = {(r.text_id, r.i): r.psi for r in X.psi(rows).collect()}
    assert len(lf) == sum(map(len, full.values())) and fl == psi
    assert all(fl[k, j] == i for (k, i), j in lf.items())
    for k, t in full.items():
        order = suffix_array(t)
        assert all(order[lf[k, i]] == (order[i] - 1) % len(t) for i in range(len(t)))


def test_blocks_agree_with_phi(spark):
    rows = X.suffixes(made(spark, random_texts(5, 40)))
    blocks = S.phi_blocks(R.runs(rows), 4)
    true = Q.phi_inverse(rows)
    told = Q.phi_from_blocks(blocks, rows.select("text_id", "pos")).filter("next_pos is not null").withColumnRenamed("next_pos", "told")
    wrong = told.join(true, ["text_id", "pos"]).filter("next_pos is not null and told <> next_pos")
    assert told.count() > 100 and wrong.count() == 0


def test_invariants(spark):
    texts = random_texts(6, 30)
    found = R.runs(X.suffixes(made(spark, texts)))
    assert all(r.n == len(texts[r.text_id]) + 1 for r in R.statistics(found).collect())
    split = R.split_separators(found, 97)
    assert split.filter("sym = 97 and len <> 1").count() == 0
    assert split.agg(F.sum("len")).first() == found.agg(F.sum("len")).first()
    assert R.run_length(R.expand(split)).count() == found.count()
    assert S.overlaps(found).agg(F.sum("gaps")).first()[0] == found.count()


def test_suffix_sort_of_long_repeats():
    text = b"ab" * 500 + b"a"
    assert list(suffixsort.suffix_array(text)) == suffix_array(text)


def test_terminator_in_text_is_refused(spark):
    bad = made(spark, {1: b"a\0b"})
    assert C.reserved_symbols(bad).count() == 1
    for df in (X.suffixes(bad), C.checked(bad)):
        with pytest.raises(Exception, match="terminator"):
            df.collect()


def test_levels_save_and_load(spark, golden, tmp_path):
    with pytest.raises(ValueError, match="unknown level"):
        build_index(golden, "all")
    with pytest.raises(ValueError, match="step"):
        build_index(golden, "csa", 0)
    runs_only = build_index(golden, "rlbwt")
    with pytest.raises(ValueError, match="level rlbwt"):
        runs_only.locate(asked(spark, [b"a"]))
    index = build_index(golden, "csa", 4)
    index.save(f"{tmp_path}/index")
    again = load_index(spark, f"{tmp_path}/index")
    ask = asked(spark, [b"a", b"ss"])
    assert sorted(again.locate(ask).collect()) == sorted(index.locate(ask).collect())
    assert read_metadata(spark, f"{tmp_path}/index").step == 4
    spark.createDataFrame([(9,)], "format int").write.parquet(f"{tmp_path}/other/metadata")
    with pytest.raises(ValueError, match="not an index"):
        load_index(spark, f"{tmp_path}/other")


def test_intervals_and_decode(spark, golden):
    rows, ask = X.suffixes(golden), asked(spark, [b"a", b"ab", b"issi"])
    spans = U.intervals(golden, ask)
    assert {(r.text_id, r.l, r.r, r.first_pos) for r in spans.filter("pat_id = 2").collect()} == {(4, 3, 4, 4)}
    assert {r.pos for r in U.locate_ordered(rows, spans.filter("pat_id = 2")).collect()} == {4, 1}
    index = build_index(golden, "toehold", 8)
    told = {(r.text_id, r.i): r.pos for r in U.decode(index.runs, rows.select("text_id", "i")).collect()}
    assert told == {(r.text_id, r.i): r.pos for r in rows.collect()}


def test_strategies_against_each_other(spark):
    texts = random_texts(12, 40) | {100: b"", 101: b"a", 102: b"aaaa"}
    patterns = sorted({t[k : k + m] for t in texts.values() if t for k in (0, len(t) // 2) for m in (1, 2, 4)} - {b""})
    corpus, ask = made(spark, texts), asked(spark, patterns)
    sampled, whole = build_index(corpus, "csa", 4), build_index(corpus, "rindex")
    found = [sorted(index.locate(ask, s).collect()) for index, s in ((sampled, "blocks"), (sampled, "samples"), (whole, "phi"), (whole, "down"), (whole, "samples"))]
    assert found[0] and all(f == found[0] for f in found)
    tails = {(r.text_id, r.pat_id): (r.l, r.r, r.last_pos) for r in whole.count_with_tail(ask).collect()}
    heads = {(r.text_id, r.pat_id): (r.l, r.r) for r in sampled.count(ask).collect()}
    assert {k: v[:2] for k, v in tails.items()} == heads
    assert {(r.text_id, r.pat_id): r.pos for r in whole.locate(ask).collect() if r.ord == heads[r.text_id, r.pat_id][1] - heads[r.text_id, r.pat_id][0]} == {k: v[2] for k, v in tails.items()}
    with pytest.raises(ValueError, match="this takes rindex"):
        sampled.locate(ask, "phi")
    with pytest.raises(ValueError, match="unknown strategy"):
        sampled.locate(ask, "other")


def test_texts_are_sorted_once(spark, golden, monkeypatch):
    calls = []
    monkeypatch.setattr(index_plans, "sorted_runs", lambda *a, made=index_plans.sorted_runs: calls.append(1) or made(*a))
    index = build_index(golden, "csa", 4)
    for df in (index.runs, index.blocks, index.c_table, index.locate(asked(spark, [b"a"]))):
        plan = df._jdf.queryExecution().toString()
        assert "sorted" not in plan and "runs_of" not in plan
    assert len(calls) == 1


def test_index_from_files(spark, golden, tmp_path):
    text, order, symbols, heads, tails = GOLDEN[1]
    (tmp_path / "x.bwt").write_bytes(symbols)
    for name, values in (("heads", heads), ("tails", tails)):
        formats.write_samples(spark.createDataFrame(list(enumerate(values)), "run_id bigint, sample bigint"), f"{tmp_path}/{name}")
    ask = asked(spark, [b"ab", b"bc", b"abcab", b"q"])
    expected = sorted((r.pat_id, r.ord, r.pos) for r in build_index(golden.filter("text_id = 1"), "csa", 4).locate(ask).collect())
    formats.write_rle_bwt(formats.read_bwt(spark, f"{tmp_path}/x.bwt", "plain"), f"{tmp_path}/x.rle")
    for files in ((f"{tmp_path}/x.bwt", "plain"), (f"{tmp_path}/x.rle", "rle", f"{tmp_path}/heads", f"{tmp_path}/tails")):
        for level in ("csa", "rindex"):
            index = index_plans.index_from_files(spark, *files, level=level, step=4)
            assert sorted((r.pat_id, r.ord, r.pos) for r in index.locate(ask).collect()) == expected
    formats.write_samples(spark.createDataFrame([(0, 11)], "run_id bigint, sample bigint"), f"{tmp_path}/few")
    with pytest.raises(ValueError, match="fewer samples"):
        index_plans.index_from_files(spark, f"{tmp_path}/x.bwt", "plain", f"{tmp_path}/few", f"{tmp_path}/tails")
    (tmp_path / "two").write_bytes(b"\0a\0")
    with pytest.raises(Exception, match="not the transform of one text"):
        index_plans.index_from_files(spark, f"{tmp_path}/two")


def test_space_and_sorters(spark, golden, tmp_path):
    index = build_index(golden, "csa", 4, "comparing")
    with pytest.raises(ValueError, match="saved"):
        index.space()
    saved = index.save(f"{tmp_path}/i")
    rows = {r.table: r for r in saved.space().collect()}
    assert set(rows) == {"runs", "c_table", "blocks"} and all(r.bytes > 0 and r.rows > 0 for r in rows.values())
    assert sorted(saved.runs.collect()) == sorted(build_index(golden, "csa", 4).runs.collect())
    with pytest.raises(Exception, match="unknown sorter"):
        X.suffixes(golden, "other").collect()


def test_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"ab"))], "text_id bigint, bytes binary")
    assert {r.text_id for r in X.suffixes(df).collect()} == {2} and X.sorted_runs(df).filter("text_id = 1").count() == 0


def test_range_operators_keep_every_probe(spark, golden):
    found = R.runs(X.suffixes(golden))
    probes = spark.createDataFrame([(1, 0, 4, 97, "x"), (1, 0, 4, 97, "x"), (1, 0, 4, 97, "y"), (1, 2, 2, 99, "z"), (9, 0, 1, 97, "w")], "text_id bigint, i bigint, j bigint, sym smallint, note string")
    ranks = sorted((r.note, r.rank_i, r.rank_j) for r in Q.range_rank(found, probes).collect())
    assert ranks == [("w", 0, 0), ("x", 0, 0), ("x", 0, 0), ("y", 0, 0), ("z", 2, 2)]
    assert sorted((r.note, r.l, r.r) for r in Q.lf_range(found, R.c_table(found), probes).collect()) == [("w", None, None), ("x", None, None), ("x", None, None), ("y", None, None), ("z", None, None)]


#: The published cases of LF over ranges of the transform 4 4 3 4 1 2 2 2 2 3 3 3 (empty: None).
LF_CASES = [
    ((0, 11), 0, None), ((0, 11), 1, (0, 0)), ((0, 11), 2, (1, 4)), ((0, 11), 3, (5, 8)), ((0, 11), 4, (9, 11)), ((1, 4), 1, (0, 0)), ((1, 4), 2, None), ((1, 4), 3, (5, 5)),
    ((1, 4), 4, (10, 11)), ((10, 11), 2, None), ((10, 11), 3, (7, 8)),
]


def test_published_ranges(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([4, 4, 3, 4, 1, 2, 2, 2, 2, 3, 3, 3])], "text_id bigint, i bigint, sym smallint")
    found = R.with_ranks(R.run_length(rows))
    probes = spark.createDataFrame([(1, *r, c, k) for k, (r, c, _) in enumerate(LF_CASES)], "text_id bigint, i bigint, j bigint, sym smallint, k int")
    got = {r.k: (r.l, r.r) if r.l is not None else None for r in Q.lf_range(found, R.c_table(found), probes).collect()}
    assert got == {k: e for k, (*_, e) in enumerate(LF_CASES)}


#: Step, required, expected order of samples of two texts when they are taken from the end.
SPACED = [
    ([2, 6, 7, 9, 10, 11], 1, [], [11, 10, 9, 7, 6, 2]), ([2, 6, 7, 9, 10, 11], 2, [], [11, 9, 7, 6, 2]), ([2, 6, 7, 9, 10, 11], 4, [], [11, 7, 6, 2]), ([2, 6, 7, 9, 10, 11], 8, [], [11, 6, 2]),
    ([2, 6, 7, 9, 10, 11], 8, [7, 6], [11, 7, 6, 2]), ([2, 3, 5, 6, 7, 8, 14, 15, 16, 17], 4, [], [17, 14, 8, 5, 2]),
]


@pytest.mark.parametrize(("values", "step", "required", "expected"), SPACED)
def test_published_subsampling(values, step, required, expected):
    assert S.spaced(values, step, required, backward=True) == expected[::-1]
    assert S.spaced([], 3) == [] and S.spaced([5], 3) == [5] and S.spaced([5, 90], 3) == [5, 90]


def test_run_string_operators(spark):
    texts = random_texts(21, 20)
    rows = X.suffixes(made(spark, texts))
    found = R.runs(rows)
    symbols = {k: bwt(t + b"\0") for k, t in texts.items()}
    rng = random.Random(4)
    probes = [(k, *sorted(rng.randrange(len(s)) for _ in "ab"), rng.choice(s)) for k, s in symbols.items() for _ in range(15)]
    df = spark.createDataFrame([(*p, n) for n, p in enumerate(probes)], "text_id bigint, i bigint, j bigint, sym smallint, n int")
    parts = {}
    for r in Q.break_range(found, df, 8).collect():
        parts.setdefault(r.n, []).append((r.l, r.r))
    closest = {r.n: r.closest for r in Q.closest_break(found, df).collect()}
    for n, (k, i, j, c) in enumerate(probes):
        inside = [x for x in range(i, j + 1) if symbols[k][x] == c]
        expected = []
        for x in inside:
            if expected and expected[-1][1] == x - 1:
                expected[-1] = (expected[-1][0], x)
            else:
                expected.append((x, x))
        assert sorted(parts.get(n, [])) == expected
        broken = [x for x in inside if any(i <= y <= j and symbols[k][y] != c for y in (x - 1, x + 1))]
        assert closest[n] == (broken[0] if broken else None)
