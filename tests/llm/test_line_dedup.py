import random
import re

import pytest

from lexirun.llm import common
from lexirun.llm.line_dedup import cut_spans, remove_repeats, repeated_passages, repeated_spans, units_of


def norm(part):
    return b" ".join(part.encode().lower().split())


def brute(data, least, sentences=False, separator="\n"):
    seen, out = {}, []
    placed = []
    for d, t in data:
        at, number = 0, 0
        t = re.sub(r"([.!?])[ \t]", r"\1\n", t or "") if sentences else t or ""
        for part in t.split(separator):
            if norm(part):
                placed.append((d, number, at, at + len(part), norm(part)))
                number += 1
            at += len(part) + len(separator)
    for d, number, *_, key in sorted(placed):
        seen.setdefault(key, (d, number))
    run = []
    for p in [*placed, None]:
        if p and seen[p[4]] != (p[0], p[1]) and (not run or (run[-1][0] == p[0] and run[-1][1] + 1 == p[1])):
            run.append(p)
            continue
        words = sum(len(x[4].split()) for x in run)
        if run and words >= least:
            out.append((run[0][0], run[0][2], run[-1][3], len(run), words, seen[run[0][4]][0]))
        run = [p] if p and seen[p[4]] != (p[0], p[1]) else []
    return sorted(out)


def made(seed=1):
    rng = random.Random(seed)
    pool = ["one two", "One. two! Three?  four. x", "a b. One two", "One  TWO ", "é x y z", "a b c d e f", "", "  ", "w " * 30] + [f"line {k}" for k in range(30)]
    return [(k, None if k == 3 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for k in range(60)]


@pytest.mark.parametrize("least", [1, 4, 12])
@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("unit", ["line", "sentence"])
def test_against_brute_force(spark, monkeypatch, least, broadcast, unit):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(common, "HOT_PARTS", 20)
    df = spark.createDataFrame([(d, t, "k") for d, t in made()], "doc_id bigint, text string, digest string")
    assert sorted(tuple(r) for r in repeated_spans(df, least, unit).select("doc_id", "start", "end", "units", "words", "kept_doc_id").collect()) == brute(made(), least, unit == "sentence")


def test_paragraphs_and_cutting(spark):
    text = "p q\nr s\n\nfresh words\n\np q\nr s"
    assert [u[1:4] for u in units_of(text, "paragraph")] == [(0, 7, 4), (9, 20, 2), (22, 29, 4)]
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = [(r.start, r.end) for r in repeated_spans(df, 1, "paragraph").collect()]
    assert cut_spans(text, spans) == "p q\nr s\n\nfresh words\n\n"
    assert cut_spans("a\nb\nc", [(2, 3)]) == "a\nc"
    assert [text[a:b] for text in ("a b. c d?\te\n f.",) for _, a, b, *_ in units_of(text)] == ["a b.", "c d?", "e", " f."]


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (6, "a b")], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.kept_doc_id) for r in repeated_spans(df, 1).collect())
    assert found == [(5, None), (5, None), (6, None)]
    assert repeated_spans(df.limit(0), 1).count() == 0


def test_short_repeats_stay(spark):
    df = spark.createDataFrame([(1, "same line"), (2, "same line\nother")], "doc_id bigint, text string")
    assert repeated_spans(df).count() == 0


def passages_brute(data, least, size):
    """The places that go: those of runs of repeated units, and of repeated windows that hold a unit of a shorter run."""
    seen, gone = {}, set()
    for d, a, b, *_ in brute(data, least, True):
        gone |= {(d, k) for k in range(a, b)}
    short = [(d, a, b) for d, a, b, _, n, _ in brute(data, 1, True) if n < least]
    for d, t in data:
        spans = [m.span() for m in re.finditer(r"[^ \t-\r]+", t or "")]
        at, units = 0, []
        for _, start, end, n, _ in units_of(t or ""):
            units.append((at, at + n, any(x == d and a <= start and end <= b for x, a, b in short)))
            at += n
        for k in range(len(spans) - size + 1):
            held = [lone for a, b, lone in units if k <= a and b <= k + size and b - a < least]
            if held:
                key = tuple(t[a:b].lower() for a, b in spans[k : k + size])
                e, j = seen.setdefault(key, (d, k))
                if any(held) and (e != d or k - j >= size):
                    gone |= {(d, c) for c in range(spans[k][0], spans[k + size - 1][1])}
    return gone


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("least, size", [(4, 7), (5, 6), (6, 12)])
def test_passages_against_brute_force(spark, monkeypatch, least, size, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(common, "HOT_PARTS", 20)
    rng = random.Random(least)
    words = [w + rng.choice(["", "", ".", "\n"]) for w in "a b c d e f g h i j k l".split()] + ["é.", "A", "x!"]
    story = [rng.choice(words) for _ in range(60)]
    data = []
    for k in range(40):
        a = rng.randrange(40)
        data.append((k, " ".join([*rng.choices(words, k=5), *story[a : a + rng.randint(4, 20)], *rng.choices(words, k=5)])))
    data += [(40, "z. " * 30), (41, ""), (42, None)]
    found = repeated_passages(spark.createDataFrame(data, "doc_id bigint, text string"), least, size).collect()
    rows = [(r.doc_id, c) for r in found for c in range(r.start, r.end)]
    assert len(rows) == len(set(rows)) and set(rows) == passages_brute(data, least, size)


def test_short_run_inside_a_passage(spark):
    rng = random.Random(3)
    said = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    stock, passage = "All rights reserved.", f"{said(25)}. {said(18)}. {said(26)}"
    data = [(1, f"{said(9)} {passage} {said(9)}\n{stock}"), (2, f"{said(7)} {passage} {said(8)}. {stock}"), (3, f"{said(40)}.\n{stock}")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert repeated_spans(df).count() == 0
    found = [(r.doc_id, data[r.doc_id - 1][1][r.start : r.end], r.runs, r.kept_doc_id) for r in repeated_passages(df).collect()]
    assert found == [(2, passage, 0, 1)]


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
@pytest.mark.parametrize("least", [1, 6])
def test_removal_from_a_table(spark, unit, least):
    """The texts that are left, and the offsets of what went, beside a brute force."""
    data = [(d, t if t is None or d % 2 else t.replace("\n", "\n\n"), "x", d) for d, t in made(3)] + [(500, "w " * 60_000 + "\n\nend", "x", 1), (501, "w " * 60_000 + "\n\nother", "x", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, removed string, row int")
    found = remove_repeats(df, least, unit)
    assert found.columns == ["doc_id", "text", "removed", "row", "_removed"]
    gone = {}
    for d, start, end, _, _, kept in brute([r[:2] for r in data], least, unit == "sentence", "\n\n" if unit == "paragraph" else "\n"):
        gone.setdefault(d, []).append((start, end, kept))
    texts, rows = {r[0]: r[1] for r in data}, found.collect()
    assert len(rows) == len(data) and sum(map(len, gone.values())) > 10
    for r in rows:
        text, mine = texts[r.doc_id], gone.get(r.doc_id, [])
        assert [tuple(x) for x in r._removed] == mine and r.removed == "x"
        for start, end, _ in reversed(mine):
            text = text[:start] + text[end + (text[end : end + 1] in ("\n", "\t", " ") and end < len(text)) :]
        assert r.text == text
    assert remove_repeats(df.limit(0)).count() == 0
