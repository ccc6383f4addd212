import random
from collections import Counter

import numpy as np
import pytest

from lexirun.llm import decontaminate as D
from lexirun.llm.decontaminate import MultiIndex, drop_contaminated, find_contamination, fingerprints
from lexirun.llm.shingles import shingle_set, shingles_of, words_of

SCHEMA = "doc_id bigint, text string, item_id bigint, similarity double"


def bag(words):
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def best_window(text, item):
    """Greatest weighted similarity of any item-sized window."""
    d, i = words_of(text), words_of(item)
    other, best = bag(i), 0.0
    size = max(len(i), 5) if len(i) >= 5 else len(i)
    windows = [d] if len(d) <= size else [d[k : k + size] for k in range(len(d) - size + 1)]
    for w in windows:
        own = bag(w) if len(d) >= 5 or len(w) == len(d) else Counter()
        union = sum((own | other).values())
        if other and own:
            best = max(best, sum((own & other).values()) / union)
    return best


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 5)))
    items = [[word() for _ in range(rng.randint(14, 60))] for _ in range(25)]
    docs = []
    for k in range(160):
        w = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = list(rng.choice(items))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = p if rng.random() < 0.8 else [x.upper() for x in p]
        docs.append((k, rng.choice([" ", "\n"]).join(w), 1, 1.0))
    return docs + [(900, None, 1, 1.0), (901, "", 1, 1.0), (902, "two words", 1, 1.0)], [(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, ""), (92, "Two  words")]


def test_against_brute_force(spark):
    docs, items = made()
    found = {(r.doc_id, r.item_id): r for r in find_contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    expected = {(d, i): s for d, t, *_ in docs for i, p in items if (s := best_window(t, p)) >= 0.8}
    assert len(expected) > 60 and (902, 92) in expected
    assert set(found) <= set(expected)
    missed = set(expected) - set(found)
    assert len(missed) <= 0.02 * len(expected) and all(expected[m] < 0.85 for m in missed)
    texts = {d: t for d, t, *_ in docs}
    for key, r in found.items():
        assert r.similarity == pytest.approx(expected[key])
        window = texts[r.doc_id][r.start : r.end]
        assert best_window(window, dict(items)[r.item_id]) == pytest.approx(r.similarity)


def test_passes_and_tables(spark, monkeypatch):
    docs, items = made(2)
    docs, items = spark.createDataFrame(docs[:60] * 2 + [(None, items[3][1], 0, 0.0)], SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(str, find_contamination(docs, items).collect()))
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 7)
    assert sorted(map(str, find_contamination(docs, items).collect())) == whole
    hit = {r.doc_id for r in find_contamination(docs, items).collect()}
    assert None in hit
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in hit)
    assert find_contamination(docs.limit(0), items).count() == find_contamination(docs, items.limit(0)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    stored = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    asked = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for s in stored for k in (0, 5, 13, 19, 20, 25)]
    asked = np.array(asked, np.uint64)
    found = set(zip(*(x.tolist() for x in MultiIndex(stored).pairs(asked)), strict=True))
    assert found == {(a, b) for a in range(len(asked)) for b in range(len(stored)) if int(asked[a] ^ stored[b]).bit_count() <= D.RADIUS}


def test_fingerprints_by_definition():
    s = shingles_of([str(k % 37).encode() for k in range(400)])
    starts = np.array([0, 1, 2, 90, 91, 300])
    for start, print_ in zip(starts, fingerprints(s, starts, 50), strict=True):
        ones = sum(((int(h) >> np.arange(64, dtype=object)) & 1).astype(int) for h in s[start : start + 50])
        assert int(print_) == sum(1 << b for b in range(64) if 2 * ones[b] > 50)


def test_shingles():
    assert words_of("A É b\x0bC\n") == ["a É".encode(), b"b", b"c"]
    assert len(shingles_of([])) == 0 and len(shingles_of([b"a", b"b"])) == 1
    assert len(shingle_set("a b c d e " * 50)) == 5
    assert shingles_of([b"a", b"b"])[0] != shingles_of([b"a", b"b", b"c"])[0]


def test_many_items_take_one_scan_of_all_documents(spark, monkeypatch):
    docs, items = made(5)
    docs = [*docs, *[(1000 + k, f"nothing in common {k} at all here", 1, 1.0) for k in range(200)]]
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(str, find_contamination(docs, items).collect()))
    monkeypatch.setattr(D, "BYTES_PER_PASS", 500)
    assert D._passes(items) > 5
    assert sorted(map(str, find_contamination(docs, items).collect())) == whole
    assert 0 < D._meeting(docs, "text", items).count() < docs.count() - 200


def test_dropping_by_row(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(30))
    data = [(None, item, 1, "a"), (None, "clean text of some words here", 2, "b"), (4, f"x y {item}", 3, "c"), (4, "clean as well it is so far", 4, "d"), (5, None, 5, "e"), (6, "", 6, "f")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, k1 int, row string")
    items = spark.createDataFrame([(1, item), (2, "other words that no document has at all")], "item_id int, text string")
    for limit in (4096, 1):
        monkeypatch.setattr(D, "ITEMS_PER_PASS", limit)
        left = drop_contaminated(docs, items)
        assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == ["b", "d", "e", "f"]
        assert drop_contaminated(docs.limit(0), items).count() == 0 and drop_contaminated(docs, items.limit(0)).count() == 6


def test_very_long_texts_and_ties(spark):
    rng = random.Random(7)
    item = [f"w{k}" for k in range(25)]
    noise = [f"n{rng.randrange(10**6)}" for _ in range(150_000)]
    text = " ".join([*noise[:100], *item, *noise[100:], *item, *noise[:50]])
    found = find_contamination(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")).collect()
    assert len(found) == 1 and found[0].similarity == 1.0 and text[found[0].start : found[0].end] == " ".join(item)
    assert found[0].start == len(" ".join(noise[:100])) + 1 and found[0].windows >= 2  # of two as good, the first


def test_index_stays_small():
    prints = np.random.default_rng(3).integers(0, 1 << 63, 1000, dtype=np.uint64)
    tables = MultiIndex(prints).tables
    assert sum(x.nbytes for t in tables for x in t[2:]) < 12_000 * len(prints)
    left, right = MultiIndex(prints[:0]).pairs(prints)
    assert len(left) == len(right) == 0
