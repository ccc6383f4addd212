"""Substring dedup by hashing lines: of what repeats across the corpus, the earliest occurrence stays.

Passages often begin and end inside a line, so lines are cut further after sentence ends unless asked otherwise.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, cut, discard, packed, release, slices

#: Repeated units go if they, with the repeated units next to them, have this many words. A passage of over 50 words
#: whose first sentence is joined to what stands before it still reaches that, short lines that recur don't.
MIN_WORDS = 30
#: A passage is as many words in a row.
PASSAGE_WORDS = 51
SEPARATORS = {"sentence": "\n", "line": "\n", "paragraph": "\n\n"}
SENTENCE_END = re.compile(r"([.!?])[ \t]")
SCHEMA = "unit int, start int, end int, words int, digest binary"
WORD = re.compile(r"[^ \t-\r]+")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def units_of(text: str, unit: str = "sentence"):
    """(number, start, end, words, digest) of the units of text that have words; offsets in code points.

    Lines end at line breaks, paragraphs at two, sentences at line breaks and at a space or tab after . ! or ?
    A unit is normalised before hashing: A-Z lower-cased, ASCII white space trimmed and squeezed to one space.
    """
    for number, (start, end, words) in enumerate(_split(text, unit)):
        yield number, start, end, len(words), xxhash.xxh3_128_digest(b" ".join(words))


def _split(text: str, unit: str):
    separator, at = SEPARATORS[unit], 0
    if unit == "sentence":
        text = SENTENCE_END.sub(r"\1\n", text)  # as long as before
    for part in text.split(separator):
        words = part.encode("utf-8", "replace").lower().split()
        if words:
            yield at, at + len(part), words
        at += len(part) + len(separator)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of docs that repeat earlier text and should go.

    Units are grouped by digest over all docs; the occurrence with the smallest (doc_id, number) stays, all others
    are repeats. Repeats next to each other in a document make one run (units without words don't part it); runs
    of at least min_words words are returned: doc_id, start, end (code points of the original text, end
    exclusive), units, words, kept_doc_id (the document that keeps the run's first unit). Null and empty texts have
    no units; texts of any length are read whole; an empty table gives an empty one. Rows equal in id rank alike: all of
    them keep what is theirs first. A null id ranks first. Other columns are ignored, whatever their names.
    """
    return _runs(_repeats(_units(_numbered(docs, id_col, text_col), unit)), min_words).drop("row")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, unit: str = "sentence") -> DataFrame:
    """docs, all columns, with the spans that repeated_spans names cut out of text, each with one white space character after it.

    A column more, removed (with as many _ in front as make its name new), has the spans as array of start, end
    (code points of the original text) and kept_doc_id, in order; it is empty where nothing went. A null text stays
    null. With min_words 1 all but the earliest occurrence of every unit goes.
    """
    name = "removed"
    while name in docs.columns:
        name = f"_{name}"
    rows = cut(packed(docs, number=F.monotonically_increasing_id(), doc_id=F.col("doc_id"), text=F.col("text")))
    spans = _runs(_repeats(_units(rows.select(F.col("number").alias("row"), "doc_id", "text"), unit)), min_words)
    held = spans.groupBy(F.col("row").alias("number")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kept_doc_id"))).alias("spans"))
    kind = held.schema["spans"].dataType.simpleString()
    met = rows.join(held, "number", "left").select("row", "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))

    def without(batches):
        for b in batches:
            texts = [cut_spans(t.as_py(), [(s["start"], s["end"]) for s in x.as_py()]) if len(x) else t.as_py() for t, x in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.column(1).type), b.column(2)], names=["row", "text", "spans"])

    out = met.mapInArrow(without, met.schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("spans").alias(name))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _units(numbered: DataFrame, unit: str, around: int | None = None, below: int = 0) -> DataFrame:
    """The units of all rows, cut; with around, each with what sides() gives."""
    kind = numbered.schema["doc_id"].dataType.simpleString()
    added = [] if around is None else ["first", "before", "after"]
    names = ["row", "doc_id", "unit", "start", "end", "words", "digest", *added]

    def units(batches):
        for b in slices(batches):
            cols = [[] for _ in names]
            for row, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = list(_split(t.as_py() or "", unit))
                extra = sides([u[2] for u in found], around, below) if added else [()] * len(found)
                for number, ((start, end, words), more) in enumerate(zip(found, extra, strict=True)):
                    for col, value in zip(cols, (row, doc, number, start, end, len(words), xxhash.xxh3_128_digest(b" ".join(words)), *more), strict=True):
                        col.append(value)
            types = [pa.int64(), b.column(1).type, *[pa.int32()] * 4, pa.binary(), *[pa.int32(), pa.int64(), pa.int64()][: len(added)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return cut(numbered.mapInArrow(units, f"row bigint, doc_id {kind}, {SCHEMA}" + (", first int, before bigint, after bigint" if added else "")))


def _repeats(found: DataFrame) -> DataFrame:
    """The units that aren't the first of their digest, with the first's place and the number of their run."""
    rank = F.struct("doc_id", "unit")
    groups = cut(found.groupBy("digest").agg(F.count("*").alias("__n"), F.min(rank).alias("__first")).filter("__n > 1"))
    met = attach(found, groups, ["digest"], "__n", found.count())
    repeats = met.filter(F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.struct("doc_id", "unit")))
    return repeats.withColumn("__run", F.col("unit") - F.row_number().over(Window.partitionBy("row").orderBy("unit")))


def _runs(repeats: DataFrame, min_words: int) -> DataFrame:
    runs = repeats.groupBy("row", "__run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.count("*").alias("units"), F.sum("words").alias("words"), F.min(F.struct("unit", "__first.doc_id"))["doc_id"].alias("kept_doc_id")
    )
    return runs.filter(F.col("words") >= min_words).drop("__run")


class Words:
    """Digests of any words in a row of a text, normalised as units are."""

    def __init__(self, words: list[bytes]):
        hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
        self._sums, self._shifts = [], []
        for base in BASES:  # polynomials mod 2^64; an odd base has an inverse
            powers, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            self._sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)]))
            self._shifts.append(inverse)

    def digests(self, at: np.ndarray, to: np.ndarray, k: int = 0) -> np.ndarray:
        """Of the words at..to, for arrays of both, by the base k."""
        return ((self._sums[k][to] - self._sums[k][at]) * self._shifts[k][at]).view(np.int64)


def sides(found: list[list[bytes]], around: int, below: int):
    """For each unit: its first word, and digests of it with so many words before and after it; None where these aren't there or it has below words or more."""
    words = Words([w for unit in found for w in unit])
    size = np.array([len(unit) for unit in found], np.int64)
    to = np.cumsum(size)
    first, total = to - size, int(size.sum())
    before = words.digests(np.maximum(first - around, 0), to).tolist()
    after = words.digests(first, np.minimum(to + around, total), 1).tolist()
    for f, n, x, y in zip(first.tolist(), size.tolist(), before, after, strict=True):
        yield f, x if n < below and f >= around else None, y if n < below and f + n + around <= total else None


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What repeated_spans returns, together with the passages around repeated units of runs too short for it.

    A window of passage_words words that holds a whole repeated unit of a run of fewer than min_words words goes if the
    same words, cut alike, stand earlier, by (doc_id, word); in one document, without overlap. So sentences joined to other text are found by those
    between them, and stock lines alone stay. Windows that go and runs are put together where they overlap: doc_id,
    start, end (as in repeated_spans), runs (how many of them are within), kept_doc_id (the document that keeps the
    first of them). Ids and null texts are as in repeated_spans.

    Such a window holds at least passage_words - min_words + 1 words besides the unit, so half of these stand on one side of it: only units
    alike in themselves and in so many words before or after them have their windows compared.
    """
    spark = docs.sparkSession
    around = max(0, -(-(passage_words - min_words + 1) // 2))
    numbered = cut(_numbered(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))))
    found = _units(numbered, unit, around, min_words)
    short = F.sum("words").over(Window.partitionBy("row", "__run")) < min_words
    repeats = cut(_repeats(found).drop("digest", "__n").withColumns({k: F.when(short, F.col(k)) for k in ("before", "after")}))
    runs = cut(_runs(repeats, min_words).select("row", "doc_id", "start", "end", F.lit(1).alias("runs"), "kept_doc_id"))
    release(spark)
    key = F.explode(F.array("before", "after")).alias("key")
    asked = cut(repeats.select(key).filter("key is not null").distinct())
    placed = found.select("row", "first", "words", key).filter("key is not null")
    groups = cut(placed.groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1").join(asked, "key", "left_semi"))
    at = F.collect_set(F.struct("first", "words")).alias("at")
    lone = repeats.filter(F.coalesce("before", "after").isNotNull()).groupBy("row").agg(F.collect_list(F.struct("first", "words")).alias("lone"))
    held = cut(attach(placed, groups, ["key"], "__n", placed.count()).filter("__n is not null").groupBy("row").agg(at).join(lone, "row", "left"))
    discard(found, repeats, asked, groups)
    release(spark)
    parts = runs.unionByName(_passages(numbered, held, passage_words).withColumn("runs", F.lit(0)))
    in_row = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))
    whole = parts.withColumn("__opens", opens).withColumn("__span", F.sum("__opens").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.groupBy("row", "__span").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("runs").alias("runs"), F.min(F.struct("start", "kept_doc_id"))["kept_doc_id"].alias("kept_doc_id")
    ).drop("row", "__span")


def _passages(numbered: DataFrame, held: DataFrame, passage_words: int) -> DataFrame:
    """The repeated windows around the units that held names by row (at; lone are those of short runs), put together where they overlap."""
    kind = numbered.schema["doc_id"].dataType.simpleString()

    def windows(batches):
        names = ["row", "doc_id", "word", "start", "end", "lone", "one", "two"]
        for b in slices(batches, 64):
            parts = []
            for k, (row, t, at, lone) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                text = t.as_py()
                spans = np.array([m.span() for m in WORD.finditer(text)], np.int64)
                words = Words(text.encode("utf-8", "replace").lower().split())
                asked, alone = np.zeros((2, max(0, len(spans) - passage_words + 1)), bool)
                for marked, places in ((asked, at), (alone, lone or [])):
                    for u in places:
                        marked[max(0, u["first"] + u["words"] - passage_words) : u["first"] + 1] = True
                w = np.flatnonzero(asked)
                to = w + passage_words
                parts.append((np.full(len(w), k), np.full(len(w), row), w, spans[w, 0], spans[to - 1, 1], alone[w], words.digests(w, to), words.digests(w, to, 1)))
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            types = [pa.int64(), b.column(1).type, *[pa.int32()] * 3, pa.bool_(), pa.int64(), pa.int64()]
            arrays = [cols[1], b.column(1).take(pa.array(cols[0])), *cols[2:]]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a).cast(t) for a, t in zip(arrays, types, strict=True)], names=names)

    texts = numbered.join(held, "row").select("row", "doc_id", "text", "at", "lone")
    asked = cut(texts.mapInArrow(windows, f"row bigint, doc_id {kind}, word int, start int, end int, lone boolean, one bigint, two bigint"))
    release(numbered.sparkSession)
    rank = F.struct("doc_id", "word")
    first = cut(asked.groupBy("one", "two").agg(F.count("*").alias("__n"), F.min(rank).alias("__first")).filter("__n > 1"))
    met = attach(asked, first, ["one", "two"], "__n", asked.count()).filter(F.col("lone") & F.col("__first").isNotNull())
    apart = ~F.col("__first.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("word") - F.col("__first.word") >= passage_words)
    in_row = Window.partitionBy("row").orderBy("word")
    opens = F.coalesce((F.col("word") - F.lag("word").over(in_row) >= passage_words).cast("int"), F.lit(1))
    met = met.filter(apart).withColumn("__opens", opens).withColumn("__passage", F.sum("__opens").over(in_row))
    return met.groupBy("row", "__passage").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.min(F.struct("word", "__first.doc_id"))["doc_id"].alias("kept_doc_id")
    ).drop("__passage")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without spans (sorted, apart), nor the white space character that follows one."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end + (text[end : end + 1] in ("\n", " ", "\t"))
    return "".join([*out, text[at:]])
