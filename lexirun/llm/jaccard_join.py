"""Exact Jaccard self-join of word-shingle sets, as components, by a token-group matrix.

Groups of similar documents are made first: each set is compared with one promising other, and what links is
one group. The matrix then says which of the tokens that may decide a link each group has, with bounds over its
members. A document's overlap with another group is bounded by the matrix alone; only groups whose bound
reaches the threshold are opened and compared member by member. Pairs within a group need no look at all, which
is what keeps thousands of near copies from making millions of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_PARTS, attach, cut, discard, fits, lookup, only_ids, packed, release, row_key, scratch, slices
from .components import components
from .shingles import shingle_set

PERCENT = 80
#: Counters of the frequency table, whatever the input: 8 bytes each.
BUCKETS, CHUNK = 1 << 20, 1 << 12
#: Turns of grouping before the exact pass; it stops sooner if nothing links.
TURNS = 2
#: Bits that tell how many tokens of a set fall in each of as many parts, odd or even. Where two sets' bits differ,
#: so does a token at least, which bounds from below by how many tokens the sets differ.
PARITY = 256
BITS = [f"p{k}" for k in range(PARITY // 64)]


def _least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """What a set of n tokens must share with any other at least, to link."""
    return -(-PERCENT * n // 100)


def _describe(raw: DataFrame, kind: str) -> DataFrame:
    """A row for each document: doc_id, n, key (digest of its set); and each task's counts of tokens by bucket, in chunks."""

    def described(batches):
        counts = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "n", "key", "chunk", "counts"]
        doc_type = pa.int64()
        for b in slices(batches):
            doc_type = b.column(0).type
            n, keys = [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *none], names=names)
        used = [k for k in range(BUCKETS // CHUNK) if counts[k * CHUNK : (k + 1) * CHUNK].any()]
        for k in used:
            part = counts[k * CHUNK : (k + 1) * CHUNK].tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([part], pa.binary())], names=names)

    return cut(raw.mapInArrow(described, f"doc_id {kind}, n bigint, key binary, chunk int, counts binary"))


def _frequencies(described: DataFrame) -> np.ndarray:
    """How many documents' tokens fall in each bucket: a table of fixed size over all documents."""

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(c.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = described.filter("chunk is not null").select("chunk", "counts").mapInArrow(summed, schema).repartition("chunk").mapInArrow(summed, schema).collect()
    table = np.zeros(BUCKETS, np.int64)
    for k, c in parts:
        table[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(bytes(c), np.int64)
    return table


def _nodes(raw: DataFrame, frequency: np.ndarray, sets: int) -> DataFrame:
    """One row for each distinct set: node, key, n, min_doc, copies, tokens (its prefix, rarest bucket first), and cold.

    Only so many of the tokens, the first, are in buckets of less than 1 / HOT_PARTS of all sets.
    """
    shared = raw.sparkSession.sparkContext.broadcast(np.minimum(frequency, np.iinfo(np.int32).max).astype(np.int32))
    hot = max(2, sets // HOT_PARTS)

    def prefixed(batches):
        rare = shared.value
        for b in slices(batches):
            cols = [[] for _ in range(5 + len(BITS))]
            for d, t in zip(b.column(0), b.column(1), strict=True):
                s = shingle_set(t.as_py())
                if len(s):
                    times = rare[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    order = np.argsort(times, kind="stable")[: len(s) - _least_overlap(len(s)) + 1]
                    cold = int((times[order] < hot).sum())
                    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
                    bits = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
                    for col, value in zip(cols, (d.as_py(), xxhash.xxh3_128_digest(s.tobytes()), len(s), s[order].view(np.int64), cold, *bits), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[5:]]], names=["doc_id", "key", "n", "tokens", "cold", *BITS])

    kind = raw.schema["doc_id"].dataType.simpleString()
    rows = raw.mapInArrow(prefixed, f"doc_id {kind}, key binary, n bigint, tokens array<bigint>, cold int, " + ", ".join(f"{c} bigint" for c in BITS))
    grouped = rows.groupBy("key").agg(F.min("doc_id").alias("min_doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), *[F.first(c).alias(c) for c in ("cold", *BITS)])
    return cut(grouped.withColumn("node", F.monotonically_increasing_id()))


def _shared_tokens(nodes: DataFrame) -> DataFrame:
    """The matrix's raw rows: token, node, pos, n, and BITS, for prefix tokens that two sets or more have.

    Tokens of cold buckets meet in one shuffle; those of hot ones, few in any prefix, are counted before they do.
    """
    every = nodes.select("node", "n", "cold", F.posexplode("tokens").alias("pos", "token"))
    columns = ["token", "node", "pos", "n"]

    def repeated(batches):
        held, before = None, None  # the last row, which the next batch decides on, and the token ahead of it
        for b in batches:
            if held is not None:
                b = pa.concat_batches([held, b])
            if not b.num_rows:
                continue
            token = b.column(0).to_numpy(zero_copy_only=False)
            same = token[1:] == token[:-1]
            yield b.slice(0, b.num_rows - 1).filter(pa.array(same | np.concatenate([[token[0] == before], same])[:-1]))
            held, before = b.slice(b.num_rows - 1), token[-2] if len(token) > 1 else before
        if held is not None and held.column(0)[0].as_py() == before:
            yield held

    cold = every.filter("pos < cold").select(columns).repartition("token").sortWithinPartitions("token").mapInArrow(repeated, "token bigint, node bigint, pos int, n bigint")
    hot = cut(every.filter("pos >= cold").select(columns))
    times = cut(hot.groupBy("token").agg(F.count("*").alias("__n")).filter("__n > 1"))
    found = cut(cold.unionByName(attach(hot, times, ["token"], "__n").filter("__n is not null").drop("__n")))
    release(nodes.sparkSession)
    return cut(found.join(nodes.select("node", *BITS), "node"))


def _linking(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b: nodes) whose sets link, compared exactly, a pair at a time, where the join puts them together."""
    first, second = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    if fits(pairs):
        met = F.broadcast(pairs).join(first, "a").join(second, "b")
    else:  # a hub's tokens are copied to as many places as its pairs are spread over
        met = lookup(cut(lookup(pairs, first, ["a"])), second, ["b"])
    both = F.size(F.array_intersect("x", "y"))
    return cut(met.withColumn("both", both).filter(100 * F.col("both") >= PERCENT * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"))


def _sets(raw: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and the tokens of the nodes in pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = cut(nodes.select("node", "key", "min_doc").join(wanted, "node", "left_semi"))
    small = fits(named)
    ids = named.select(F.col("min_doc").alias("doc_id"))  # semi-joined, so one that comes twice does no harm
    docs = raw.join(F.broadcast(ids), "doc_id", "left_semi") if small else only_ids(raw, cut(ids.distinct()), "doc_id")
    docs = docs.unionByName(raw.filter("doc_id is null"))

    def tokens(batches):
        for b in slices(batches):
            found = [shingle_set(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["key", "tokens"])

    return cut(docs.mapInArrow(tokens, "key binary, tokens array<bigint>").join(F.broadcast(named) if small else named, "key").select("node", "tokens"))


def _differ(other: list[str]):
    """By how many tokens two sets differ at least: in so many of their BITS."""
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(d))) for c, d in zip(BITS, other, strict=True)), F.lit(0))


def _may_link(n: str, pos: str, n2: str, pos2: str, other: list[str]):
    """Whether two sets can link that have their first common token at these places.

    They share at most what follows there in either, and differ by _differ at least.
    """
    rest = F.least(F.col(n) - F.col(pos), F.col(n2) - F.col(pos2))
    total = F.col(n) + F.col(n2)
    return ((100 + PERCENT) * rest >= PERCENT * total) & ((100 + PERCENT) * _differ(other) <= (100 - PERCENT) * total)


def _merge(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after links between nodes; nodes that never linked aren't listed."""
    if comp is None:
        return components(links)
    ends = links
    for c in ("a", "b"):
        ends = cut(lookup(ends, comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")), [c]).withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c)))
    moved = components(ends.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    known = cut(comp.unionByName(moved.join(comp, "node", "left_anti").select("node", F.col("node").alias("comp"))))
    return cut(lookup(known, moved.select(F.col("node").alias("comp"), F.col("comp").alias("new")), ["comp"]).select("node", F.coalesce("new", "comp").alias("comp")))


def _mixed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The matrix's rows with their comp, of tokens that more than one comp has."""
    placed = cut(rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mixed = cut(placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("__n")).filter("lo <> hi").select("token", "__n"))
    return cut(attach(placed, mixed, ["token"], "__n").filter("__n is not null").drop("__n"))


def _promising(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node with the owner, of another comp, of one of its tokens from which it seems to differ least.

    A token's owner is the node that has it at the lowest place, that is, with the fewest rare tokens, and in
    later turns any.
    """
    rank = F.struct("pos", "n", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
    columns = ["pos", "n", "node", "comp", *BITS]
    owner = rows.groupBy("token").agg(F.count("*").alias("__n"), F.min_by(F.struct(*columns), rank).alias("o"))
    owner = cut(owner.select("token", "__n", *[F.col(f"o.{c}").alias(f"o_{c}") for c in columns]))
    other = [f"o_{c}" for c in BITS]
    met = attach(rows, owner, ["token"], "__n").filter(F.col("comp") != F.col("o_comp")).filter(_may_link("n", "pos", "o_n", "o_pos", other))
    return met.groupBy("node").agg(F.min(F.struct(_differ(other).alias("d"), F.col("o_node").alias("b")))["b"].alias("b")).select(F.col("node").alias("a"), "b")


def _qualifying(rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of nodes of different comps that the matrix doesn't rule out.

    The matrix has a row for each token and group: the sizes of its members there, the best of 5 n - 9 pos, which
    tells for any query how much of some member can still be shared, and for a group of one its BITS. Each pair is
    looked at from its larger set (at equal sizes from the larger node), whose partner has the token in its first
    ninth.
    """
    p, q = PERCENT, 100 + PERCENT
    slack = (q - p) * F.col("n") - q * F.col("pos")
    short = F.col("pos") <= F.col("n") - F.ceil(2 * p * F.col("n") / q)
    members = rows.filter(short)
    other = [f"g_{c}" for c in BITS]
    matrix = members.groupBy("token", F.col("comp").alias("group")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(slack).alias("best"), F.count("*").alias("members"), F.min("node").alias("one"), *[F.max(c).alias(d) for c, d in zip(BITS, other, strict=True)]
    )
    asked = rows.select("token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("pos").alias("apos"), "comp", *BITS)
    bound = (F.col("best") >= p * F.col("an")) & ((q - p) * F.col("an") - q * F.col("apos") >= p * F.col("least")) & (100 * F.col("most") >= p * F.col("an")) & (F.col("least") <= F.col("an"))
    alone = (F.col("members") > 1) | ((q * _differ(other) <= (100 - p) * (F.col("an") + F.col("least"))) & ((F.col("least") < F.col("an")) | (F.col("one") < F.col("a"))))
    met = asked.join(cut(matrix), "token").filter(F.col("comp") != F.col("group")).filter(bound & alone)
    open_ = cut(met.select("token", "a", "an", "apos", "group", *BITS))
    inside = members.select("token", F.col("comp").alias("group"), F.col("node").alias("b"), "n", "pos", *[F.col(c).alias(d) for c, d in zip(BITS, other, strict=True)])
    order = (F.col("n") < F.col("an")) | ((F.col("n") == F.col("an")) & (F.col("b") < F.col("a")))
    return open_.join(inside, ["token", "group"]).filter(order & (100 * F.col("n") >= p * F.col("an")) & _may_link("an", "apos", "n", "pos", other)).select("a", "b").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of docs under links between texts with 5-word shingle sets of Jaccard similarity 0.8 or more.

    Returns one row per row of docs: doc_id, n_shingles, component_id (the smallest id that links lead to, its own
    included; null ids don't count, but link). Texts without words have no shingles and link with nothing; those
    of fewer than five words have one; texts of any length are read whole. Rows that repeat are in one component, as
    equal sets are. Ids may be null or come twice; other columns are ignored, whatever their names; an empty table
    gives an empty one.
    """
    with scratch() as keep:
        rows, sets = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        keep(rows, sets)
    out = attach(rows, sets, ["key"], "__n")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, key of each row, and key, component_id, comp, __n (how many rows have it) of each distinct set; both of tables cut here."""
    spark: SparkSession = raw.sparkSession
    kind = raw.schema["doc_id"].dataType.simpleString()
    described = _describe(raw, kind)
    rows = described.filter("chunk is null").select("doc_id", "n", "key")
    rows.cut_path = described.cut_path
    full = _nodes(raw, _frequencies(described), rows.count())
    release(spark)
    with scratch() as keep:
        stored, comp = _shared_tokens(full), None
        nodes = cut(full.drop("tokens"))
        keep(stored, nodes)
    discard(full)
    linked = False
    for turn in range(TURNS + 1):
        release(spark)
        with scratch() as keep:  # of a turn only the components and the rows that are left outlive it
            if comp is None:
                left = stored.withColumn("comp", F.col("node"))
            elif linked:  # if the turn before linked nothing, what is left is what it was
                left, before = _mixed(stored.drop("comp"), comp), stored
                discard(before)
                stored = left
                keep(stored)
            pairs = cut(_promising(left, turn) if turn < TURNS else _qualifying(left))
            linked = False
            if not pairs.isEmpty():
                links = _linking(pairs, _sets(raw, nodes, pairs))
                linked = not links.isEmpty()
                if linked:
                    comp = _merge(comp, links)
                    keep(comp)
    ids = nodes.select("node", "key", "min_doc", F.col("copies").alias("__n"))
    if comp is not None:
        ids = ids.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = cut(ids.groupBy("comp").agg(F.min("min_doc").alias("component_id"), F.count("*").alias("__c")))
        ids = attach(ids, least, ["comp"], "__c").select("key", "component_id", "comp", "__n")
    else:
        ids = ids.select("key", F.col("min_doc").alias("component_id"), F.col("node").alias("comp"), "__n")
    return rows, cut(ids)


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component of similar_documents: that whose id names it.

    Of rows that share this id, or have none where no row of the component has one, one stays: of different texts
    that with the least hash, of equal ones any. Texts without words are like nothing and stay. Columns may have any
    names; an empty table gives an empty one.
    """
    with scratch() as keep:
        named = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
        rows, sets = _grouped(named.select(F.struct("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k")).alias("doc_id"), "text"))
        met = attach(rows.filter("key is not null"), sets, ["key"], "__n")
        each = cut(met.select("doc_id", "comp").groupBy("comp", "doc_id").agg(F.count("*").alias("times")))
        stays = cut(each.groupBy("comp").agg(F.min_by(F.struct("doc_id", "times"), F.struct(F.isnull("doc_id.doc_id"), "doc_id")).alias("s"), F.count("*").alias("__n")))
        judged = attach(each, stays.select("comp", F.col("s.doc_id").alias("kept"), "__n"), ["comp"], "__n")
        gone = cut(judged.filter("doc_id <> kept").select("doc_id.k.*"))
        twice = cut(stays.filter("s.times > 1").select("s.doc_id.k.*"))
        keep(gone, twice)
    marked = packed(docs, k=row_key(F.col("doc_id"), F.col("text"))).select("row", "k.*")
    left = only_ids(marked, gone, ["k1", "k2"], "left_anti")
    if twice.isEmpty():
        return left.select("row.*")
    once = only_ids(left, twice, ["k1", "k2"], "left_anti").select("row.*")
    return once.unionByName(only_ids(left, twice, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*"))
