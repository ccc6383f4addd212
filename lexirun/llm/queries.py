"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, jaccard_join, line_dedup, pieces, pii, sharding, token_counts, toxicity
from .common import table

SHARDS = 40


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary files are; executors have them at the same place."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return str(Path("/opt/tokenizers") / name)


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))


def op4_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op7_progressive_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), with_digest=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("content").alias("text_sha256"))


def op8_offset_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


def op9_count_only_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sampled_splitters, op2_page_differencing, op3_anchor_expansion, op4_token_group_matrix, op5_simhash_windows,
        op6_line_hashing, op7_progressive_refinement, op8_offset_preserving, op9_count_only_viterbi, op10_classifier_chain,
    )
}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op7_progressive_refinement": f"""
        WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS h FROM documents),
             g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
    "op4_token_group_matrix": f"""
        WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all({_NORMAL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             bag AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM word),
             shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM bag),
             pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS either
                      FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
             link AS (SELECT a, b FROM pair WHERE 100 * common >= 80 * either UNION ALL SELECT b, a FROM pair WHERE 100 * common >= 80 * either),
             reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.seen)
        SELECT b.doc_id, CAST(len(b.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
        FROM bag b JOIN reach r ON r.doc_id = b.doc_id GROUP BY b.doc_id, b.s""",
    "op5_simhash_windows": f"""
        WITH source AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
             part AS (SELECT kind, id, unnest(l) AS p, unnest(range(len(l))) AS k
                      FROM (SELECT kind, id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS l FROM source)),
             placed AS (SELECT kind, id, k, {_NORMAL.replace('text', 'p')} AS w, sum(length(p)) OVER (PARTITION BY kind, id ORDER BY k) AS fin, length(p) AS len FROM part),
             word AS (SELECT kind, id, row_number() OVER (PARTITION BY kind, id ORDER BY k) - 1 AS i, w, fin - len AS start, fin FROM placed WHERE regexp_matches(w, '^[^\\x20\\x09-\\x0D]')),
             five AS (SELECT kind, id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS x
                      FROM word WINDOW o AS (PARTITION BY kind, id ORDER BY i)),
             shingle AS (SELECT * FROM five WHERE x IS NOT NULL UNION ALL
                         SELECT kind, id, 0, string_agg(w, ' ' ORDER BY i) FROM word GROUP BY kind, id HAVING count(*) < 5),
             size AS (SELECT kind, id, count(*) AS n FROM shingle GROUP BY kind, id),
             item AS (SELECT id AS item_id, x, count(*) AS c FROM shingle WHERE kind = 'i' GROUP BY id, x),
             hit AS (SELECT d.id AS doc_id, t.item_id, d.i, d.x, t.c, least(a.n, b.n) AS size, a.n AS n, b.n AS m
                     FROM shingle d JOIN item t USING (x) JOIN size a ON a.kind = 'd' AND a.id = d.id JOIN size b ON b.kind = 'i' AND b.id = t.item_id WHERE d.kind = 'd'),
             near AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) AS hits FROM hit),
             few AS (SELECT * FROM near WHERE 180 * hits >= 80 * (size + m)),
             start AS (SELECT DISTINCT doc_id, item_id, size, m, unnest(range(greatest(0, i - size + 1), least(i, n - size) + 1)) AS s FROM few),
             met AS (SELECT t.doc_id, t.item_id, t.size, t.m, t.s, h.x, least(count(*), any_value(h.c)) AS c FROM start t JOIN few h
                     ON h.doc_id = t.doc_id AND h.item_id = t.item_id AND h.i BETWEEN t.s AND t.s + t.size - 1 GROUP BY ALL),
             scored AS (SELECT doc_id, item_id, size, s, sum(c) AS a, any_value(size) + any_value(m) - sum(c) AS u FROM (SELECT doc_id, item_id, size, m, s, x, c FROM met) GROUP BY doc_id, item_id, size, s),
             good AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY a / u DESC, s) AS k, count(*) OVER (PARTITION BY doc_id, item_id) AS windows FROM scored WHERE 100 * a >= 80 * u),
             words AS (SELECT id AS doc_id, count(*) AS n FROM word WHERE kind = 'd' GROUP BY id)
        SELECT g.doc_id, g.item_id, CAST(a / u AS DOUBLE) AS similarity, CAST(b.start AS BIGINT) AS start, CAST(e.fin AS BIGINT) AS "end", windows
        FROM good g JOIN words n USING (doc_id) JOIN word b ON b.kind = 'd' AND b.id = g.doc_id AND b.i = g.s
        JOIN word e ON e.kind = 'd' AND e.id = g.doc_id AND e.i = least(g.s + g.size + 4, n.n) - 1 WHERE g.k = 1""",
    "op6_line_hashing": f"""
        WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                              generate_subscripts(string_split(text, chr(10)), 1) AS i
                       FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?])[ \\t]', '\\1' || chr(10), 'g') AS text FROM documents)),
             placed AS (SELECT doc_id, i, line,
                               sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start,
                               trim(regexp_replace({_NORMAL.replace('text', 'line')}, '[\\x09-\\x0D ]+', ' ', 'g')) AS norm FROM split),
             unit AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit,
                             len(string_split(norm, ' ')) AS words FROM placed WHERE norm <> ''),
             met AS (SELECT *, first_value(doc_id) OVER w AS kept_doc, row_number() OVER w AS n
                     FROM unit WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit)),
             run AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM met WHERE n > 1)
        SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(start + length(line)) AS BIGINT) AS "end",
               count(*) AS units, CAST(sum(words) AS BIGINT) AS words, arg_min(kept_doc, unit) AS kept_doc_id
        FROM run GROUP BY doc_id, run HAVING sum(words) >= {line_dedup.MIN_WORDS}""",
}
