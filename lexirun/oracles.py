"""The queries of catalog.py in SQL that DuckDB runs on the same tables, by another way: sorted hex strings."""

from __future__ import annotations

STEP, FIXED, DRAWN, MOST, BINS = 8, 16, 200, 1, 20

_SUFFIXES = """corpus AS (SELECT CAST(p_size AS BIGINT) AS text_id, string_agg(hex(p_name), '01' ORDER BY p_partkey) || '00' AS h
            FROM part GROUP BY p_size),
 each AS (SELECT text_id, h, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS pos FROM corpus),
 suf AS (SELECT text_id, h, n, pos, row_number() OVER (PARTITION BY text_id ORDER BY substr(h, 2 * pos + 1)) - 1 AS i,
                CAST('0x' || substr(h, 2 * ((pos + n - 1) % n) + 1, 2) AS SMALLINT) AS sym FROM each)"""
_RUNS = (
    _SUFFIXES
    + """,
 fresh AS (SELECT *, CASE WHEN sym <> lag(sym) OVER (PARTITION BY text_id ORDER BY i) THEN 1 ELSE 0 END AS starts FROM suf),
 numbered AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY text_id ORDER BY i) AS BIGINT) AS run_id FROM fresh),
 run AS (SELECT text_id, run_id, any_value(sym) AS sym, min(i) AS head_i, count(*) AS len, arg_min(pos, i) AS head_sa,
                arg_max(pos, i) AS tail_sa, any_value(n) AS n FROM numbered GROUP BY text_id, run_id)"""
)
_PATTERNS = """,
 named AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name),
 pat AS (SELECT CAST(2 * k AS BIGINT) AS pat_id, hex(p_name) AS p FROM named UNION ALL
         SELECT CAST(2 * k + 1 AS BIGINT), hex(reverse(p_name)) FROM named),
 hit AS (SELECT pat_id, text_id, i, pos FROM suf JOIN pat ON starts_with(substr(h, 2 * pos + 1), p)),
 span AS (SELECT pat_id, text_id, min(i) AS l, max(i) AS r, count(*) AS n_occ, arg_min(pos, i) AS first_pos FROM hit GROUP BY pat_id, text_id)"""
#: Probes: all positions (place), with symbols at and before them (symbol), and ranges of them (ends).
_PLACES = """,
 size AS (SELECT DISTINCT text_id, n FROM suf),
 place AS (SELECT text_id, n, unnest(range(n + 1)) AS i FROM size),
 kind AS (SELECT DISTINCT text_id, sym FROM suf),
 symbol AS (SELECT text_id, i, sym FROM suf UNION SELECT text_id, i + 1, sym FROM suf UNION
            SELECT text_id, unnest([0, n]), sym FROM size JOIN kind USING (text_id))"""
_ENDS = """,
 ends AS (SELECT text_id, head_i AS i, least(head_i + 2 * len + 1, n - 1) AS j, sym FROM run UNION
          SELECT text_id, n // 4, 3 * n // 4, sym FROM size JOIN kind USING (text_id)),
 nth AS (SELECT text_id, sym, i, row_number() OVER (PARTITION BY text_id, sym ORDER BY i) AS k FROM suf)"""
_KEPT = (
    _RUNS
    + f""",
 head AS (SELECT text_id, head_sa AS p, row_number() OVER w - 1 AS k, lead(head_sa) OVER w AS nxt, count(*) OVER (PARTITION BY text_id) AS m
          FROM run WINDOW w AS (PARTITION BY text_id ORDER BY head_sa)),
 walk AS (SELECT text_id, k, p AS last, CAST(NULL AS BIGINT) AS kept FROM head WHERE k = 0 UNION ALL
          SELECT h.text_id, h.k, CASE WHEN h.nxt - w.last > {STEP} THEN h.p ELSE w.last END, CASE WHEN h.nxt - w.last > {STEP} THEN w.last END
          FROM walk w JOIN head h ON h.text_id = w.text_id AND h.k = w.k + 1 WHERE h.nxt IS NOT NULL),
 keep AS (SELECT text_id, kept AS head_sa FROM walk WHERE kept IS NOT NULL UNION
          SELECT w.text_id, w.last FROM walk w JOIN head h ON h.text_id = w.text_id AND h.k = 0 AND w.k = greatest(0, h.m - 2) UNION
          SELECT text_id, p FROM head WHERE nxt IS NULL)"""
)


def _blocks(tail: str) -> str:
    return f"""WITH RECURSIVE {_KEPT},
 pair AS (SELECT text_id, n, {tail} AS tail, head_sa AS head FROM run),
 marked AS (SELECT p.text_id, n, tail, head, sum(CASE WHEN k.head_sa IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.text_id ORDER BY tail) AS g
            FROM pair p LEFT JOIN keep k ON k.text_id = p.text_id AND k.head_sa = p.head WHERE tail IS NOT NULL),
 gap AS (SELECT *, lead(tail) OVER (PARTITION BY text_id, g ORDER BY tail) - tail AS area,
                coalesce(lead(tail) OVER (PARTITION BY text_id ORDER BY tail), n) AS nxt FROM marked WHERE g > 0),
 group_end AS (SELECT *, max(nxt) OVER (PARTITION BY text_id, g) AS fin,
                coalesce(min(area) OVER (PARTITION BY text_id, g ORDER BY tail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {STEP}) AS least FROM gap)
 SELECT text_id, tail AS start, CASE WHEN area >= {STEP} THEN area ELSE fin - tail END AS len, head - tail AS diff,
        CAST(CASE WHEN area IS NULL OR area >= {STEP} THEN 0 ELSE area END AS INTEGER) AS valid_area FROM group_end WHERE least >= {STEP}"""


_FOUND = """pair AS (SELECT item_id, doc_id, d.text AS t, b.text AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
 step AS (SELECT *, unnest(range(1, length(t) - length(p) + 2)) AS k FROM pair),
 occ AS (SELECT item_id AS pat_id, doc_id AS text_id, CAST(strlen(substr(t, 1, k - 1)) AS BIGINT) AS pos FROM step WHERE substr(t, k, length(p)) = p),
 tally AS (SELECT item_id AS pat_id, b.text AS p, coalesce(n, 0) AS n_occ FROM benchmark b LEFT JOIN (SELECT pat_id, count(*) AS n FROM occ GROUP BY pat_id) o ON o.pat_id = item_id)"""
_BYTES = """byte AS (SELECT doc_id, unnest(regexp_extract_all(hex(text), '..')) AS b FROM documents),
 hist AS (SELECT CAST('0x' || b AS SMALLINT) AS sym, count(*) AS freq FROM byte GROUP BY b)"""

ORACLES: dict[str, str] = {
    "locate_benchmark_in_documents": f"WITH {_FOUND} SELECT * FROM occ",
    "locate_benchmark_by_seeds": f"WITH {_FOUND} SELECT * FROM occ",
    "count_benchmark_in_documents": f"WITH {_FOUND} SELECT pat_id, n_occ FROM tally",
    "count_statistics": f"WITH {_FOUND} SELECT count(*) AS n_pats, avg(strlen(p)) AS pat_len, CAST(sum(n_occ) AS BIGINT) AS n_occ, count(*) FILTER (n_occ = 0) AS missed FROM tally",
    "qgram_count_fixed_len": f"""WITH w AS (SELECT hex(text) AS h, unnest(range(strlen(text) - {FIXED - 1})) AS k FROM benchmark WHERE strlen(text) >= {FIXED}),
        pat AS (SELECT DISTINCT substr(h, 2 * k + 1, {2 * FIXED}) AS pattern FROM w),
        d AS (SELECT hex(text) AS h, unnest(range(strlen(text) - {FIXED - 1})) AS k FROM documents WHERE strlen(text) >= {FIXED}),
        n AS (SELECT substr(h, 2 * k + 1, {2 * FIXED}) AS pattern, count(*) AS n FROM d GROUP BY 1)
        SELECT pattern, coalesce(n, 0) AS n_occ FROM pat LEFT JOIN n USING (pattern)""",
    "pattern_sample_forbidden": f"""WITH t AS (SELECT doc_id, hex(text) AS h, strlen(text) - {2 * FIXED - 1} AS n FROM documents WHERE strlen(text) >= {2 * FIXED}),
        b AS (SELECT greatest(1, CAST(sum(n) AS BIGINT) // {DRAWN * 64}) AS block FROM t),
        each AS (SELECT doc_id, h, n, block, unnest(range((n - 1) // block + 1)) AS k FROM t, b),
        drawn AS (SELECT *, md5('0:' || doc_id || ':' || k) AS key FROM each),
        ok AS (SELECT doc_id, h, n, key, k * block + CAST('0x' || key[1:8] AS BIGINT) % block AS pos FROM drawn),
        fit AS (SELECT doc_id, pos, key, substr(h, 2 * pos + 1, {4 * FIXED}) AS pattern FROM ok WHERE pos < n),
        top AS (SELECT * FROM fit WHERE NOT regexp_matches(pattern, '^(..)*0A') ORDER BY key, doc_id, pos LIMIT {DRAWN})
        SELECT row_number() OVER (ORDER BY key, doc_id, pos) - 1 AS pat_id, doc_id AS text_id, pos, pattern FROM top""",
    "pattern_filter_max_freq": f"WITH {_FOUND} SELECT pat_id, hex(p) AS pattern, n_occ FROM tally WHERE n_occ <= {MOST}",
    "pattern_fasta": "SELECT '>pat_' || item_id || chr(10) || text AS value FROM benchmark",
    "symbol_histogram": f"WITH {_BYTES} SELECT sym, freq FROM hist",
    "c_array": f"WITH {_BYTES} SELECT sym, CAST(sum(freq) OVER (ORDER BY sym) - freq AS BIGINT) AS c_lo FROM hist",
    "effective_alphabet": f"WITH {_BYTES} SELECT sym, row_number() OVER (ORDER BY sym) - 1 AS code, freq FROM hist",
    "suffix_array_part_names": f"WITH {_SUFFIXES} SELECT text_id, i, pos FROM suf",
    "suffix_array_by_window": """WITH each AS (SELECT p_partkey AS text_id, hex(p_name) || '00' AS h, unnest(range(strlen(p_name) + 1)) AS pos, strlen(p_name) + 1 AS n FROM part)
        SELECT CAST(text_id AS BIGINT) AS text_id, row_number() OVER (PARTITION BY text_id ORDER BY substr(h, 2 * pos + 1)) - 1 AS i, pos,
               CAST('0x' || substr(h, 2 * ((pos + n - 1) % n) + 1, 2) AS SMALLINT) AS sym FROM each""",
    "bwt_part_names": f"WITH {_SUFFIXES} SELECT text_id, i, sym FROM suf",
    "rle_roundtrip": f"WITH {_SUFFIXES} SELECT text_id, i, sym FROM suf",
    "rle_runs_part_names": f"WITH {_RUNS} SELECT text_id, run_id, sym, head_i, len, CAST(sum(len) OVER (PARTITION BY text_id, sym ORDER BY head_i) - len AS BIGINT) AS rank_before FROM run",
    "separator_run_split": f"""WITH {_RUNS}, cut AS (SELECT text_id, sym, i AS head_i, 1 AS len FROM suf WHERE sym = 1 UNION ALL SELECT text_id, sym, head_i, len FROM run WHERE sym <> 1)
        SELECT text_id, sym, head_i, CAST(len AS BIGINT) AS len, row_number() OVER (PARTITION BY text_id ORDER BY head_i) - 1 AS run_id FROM cut""",
    "run_heads_tails": f"WITH {_RUNS} SELECT text_id, run_id, head_sa, tail_sa FROM run",
    "c_table_part_names": f"""WITH {_SUFFIXES}, f AS (SELECT text_id, sym, count(*) AS freq FROM suf GROUP BY text_id, sym)
        SELECT text_id, sym, freq, CAST(sum(freq) OVER (PARTITION BY text_id ORDER BY sym) - freq AS BIGINT) AS c_lo, row_number() OVER (PARTITION BY text_id ORDER BY sym) - 1 AS code FROM f""",
    "access_points": f"WITH {_SUFFIXES}{_PLACES} SELECT p.text_id, p.i, sym FROM place p LEFT JOIN suf s ON s.text_id = p.text_id AND s.i = p.i",
    "rank_points": f"""WITH {_RUNS}{_PLACES}{_ENDS} SELECT p.text_id, p.i, p.sym, coalesce(a.k, 0) AS rank, NOT (coalesce(a.i = p.i - 1, false) AND z.i IS NOT NULL) AS is_head
        FROM symbol p ASOF LEFT JOIN nth a ON a.text_id = p.text_id AND a.sym = p.sym AND p.i > a.i LEFT JOIN suf z ON z.text_id = p.text_id AND z.i = p.i AND z.sym = p.sym""",
    "range_rank_points": f"""WITH {_RUNS}{_PLACES}{_ENDS} SELECT e.text_id, e.sym, e.i, e.j, coalesce(a.k, 0) AS rank_i, coalesce(b.k, 0) AS rank_j, NOT (coalesce(a.i = e.i - 1, false) AND z.i IS NOT NULL) AS i_is_head
        FROM ends e ASOF LEFT JOIN nth a ON a.text_id = e.text_id AND a.sym = e.sym AND e.i > a.i ASOF LEFT JOIN nth b ON b.text_id = e.text_id AND b.sym = e.sym AND e.j > b.i
        LEFT JOIN suf z ON z.text_id = e.text_id AND z.i = e.i AND z.sym = e.sym""",
    "select_points": f"""WITH {_RUNS}{_PLACES}{_ENDS}, f AS (SELECT text_id, sym, count(*) AS freq FROM suf GROUP BY text_id, sym),
        probe AS (SELECT text_id, sym, unnest(range(freq + 1)) AS k FROM f)
        SELECT p.text_id, p.sym, p.k, a.i FROM probe p LEFT JOIN nth a ON a.text_id = p.text_id AND a.sym = p.sym AND a.k = p.k + 1""",
    "inverse_select_points": f"""WITH {_RUNS} SELECT s.text_id, s.i, s.sym, row_number() OVER (PARTITION BY s.text_id, s.sym ORDER BY s.i) - 1 AS rank, r.head_sa
        FROM suf s LEFT JOIN run r ON r.text_id = s.text_id AND r.head_i = s.i""",
    "lf_mapping": f"WITH {_SUFFIXES} SELECT a.text_id, a.i, b.i AS lf FROM suf a JOIN suf b ON b.text_id = a.text_id AND b.pos = (a.pos + a.n - 1) % a.n",
    "fl_mapping": f"WITH {_SUFFIXES} SELECT a.text_id, a.i, b.i AS fl FROM suf a JOIN suf b ON b.text_id = a.text_id AND b.pos = (a.pos + 1) % a.n",
    "psi_function": f"WITH {_SUFFIXES} SELECT a.text_id, a.i, b.i AS psi FROM suf a JOIN suf b ON b.text_id = a.text_id AND b.pos = (a.pos + 1) % a.n",
    "successor_run_head": f"""WITH {_RUNS}{_PLACES} SELECT p.text_id, p.i, p.sym, r.head_i AS succ_i, r.head_sa AS succ_sa
        FROM symbol p ASOF LEFT JOIN run r ON r.text_id = p.text_id AND r.sym = p.sym AND p.i <= r.head_i""",
    "circular_predecessor": f"""WITH {_RUNS}, top AS (SELECT text_id, max(head_sa) AS last FROM run GROUP BY text_id)
        SELECT s.text_id, s.pos, coalesce(r.head_sa, last) AS pred FROM suf s JOIN top USING (text_id) ASOF LEFT JOIN run r ON r.text_id = s.text_id AND s.pos >= r.head_sa""",
    "soft_successor": f"WITH {_RUNS} SELECT s.text_id, s.pos, r.tail_sa AS succ FROM suf s ASOF LEFT JOIN run r ON r.text_id = s.text_id AND s.pos <= r.tail_sa",
    "head_gaps": f"WITH {_RUNS} SELECT text_id, head_sa, head_sa - lag(head_sa, 1, -1) OVER (PARTITION BY text_id ORDER BY head_sa) AS gap FROM run",
    "lf_range": f"""WITH {_RUNS}{_PLACES}{_ENDS} SELECT e.text_id, e.sym, e.i, e.j, min(b.i) AS l, max(b.i) AS r FROM ends e
        LEFT JOIN suf s ON s.text_id = e.text_id AND s.sym = e.sym AND s.i BETWEEN e.i AND e.j
        LEFT JOIN suf b ON b.text_id = s.text_id AND b.pos = (s.pos + s.n - 1) % s.n GROUP BY e.text_id, e.sym, e.i, e.j""",
    "random_positions": f"""WITH {_SUFFIXES}, size AS (SELECT DISTINCT text_id, n, greatest(1, n // 40) AS block FROM suf),
        slot AS (SELECT text_id, n, block, unnest(range((n - 1) // block + 1)) AS k FROM size),
        drawn AS (SELECT *, md5('0:' || text_id || ':' || k) AS key FROM slot),
        ok AS (SELECT text_id, n, key, k * block + CAST('0x' || key[1:8] AS BIGINT) % block AS i FROM drawn)
        SELECT text_id, i FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY key, i) AS k FROM ok WHERE i < n) WHERE k <= 10""",
    "reserved_symbols": "SELECT doc_id AS text_id FROM documents WHERE contains(text, chr(0)) OR contains(text, chr(10))",
    "phi_inverse": f"WITH {_SUFFIXES} SELECT text_id, pos, lead(pos) OVER (PARTITION BY text_id ORDER BY i) AS next_pos FROM suf",
    "phi_backward": f"WITH {_SUFFIXES} SELECT text_id, pos, lag(pos) OVER (PARTITION BY text_id ORDER BY i) AS prev_pos FROM suf",
    "sa_interval_count": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, l, r, n_occ FROM span",
    "toehold": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, l, first_pos FROM span",
    "locate_sa_order": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, i - min(i) OVER (PARTITION BY pat_id, text_id) AS ord, pos FROM hit",
    "locate_via_phi": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, i - min(i) OVER (PARTITION BY pat_id, text_id) AS ord, pos FROM hit",
    "backward_search": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, l, r, first_pos FROM span",
    "backward_search_runs_only": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, l, r FROM span",
    "decode_suffix_array": f"WITH {_SUFFIXES} SELECT text_id, i, pos FROM suf",
    "index_metadata": f"WITH {_RUNS} SELECT 1 AS format, 'csa' AS level, {STEP} AS step, count(DISTINCT text_id) AS texts, CAST(sum(len) AS BIGINT) AS n, count(*) AS r, count(DISTINCT sym) AS sigma FROM run",
    "qgram_intervals_k3": f"""WITH {_SUFFIXES}, d AS (SELECT *, unnest([1, 2, 3]) AS depth FROM suf)
        SELECT text_id, depth, substr(h, 2 * pos + 1, 2 * depth) AS prefix, min(i) AS l, max(i) AS r FROM d WHERE pos + depth < n GROUP BY ALL""",
    "index_stats": f"WITH {_RUNS} SELECT text_id, CAST(sum(len) AS BIGINT) AS n, count(*) AS r, count(DISTINCT sym) AS sigma, max(len) AS max_run, sum(len) / count(*) AS mean_run FROM run GROUP BY text_id",
    "run_length_histogram": f"WITH {_RUNS} SELECT len, count(*) AS runs FROM run GROUP BY len",
    "run_blocks": f"WITH {_RUNS}, b AS (SELECT text_id, unnest(range(head_i // 64, (head_i + len - 1) // 64 + 1)) AS block FROM run) SELECT text_id, block, count(*) AS runs FROM b GROUP BY ALL",
    "overlap_stats": f"""WITH {_RUNS}, head AS (SELECT text_id, head_sa AS a, lead(head_sa, 1, 1099511627776) OVER (PARTITION BY text_id ORDER BY head_sa) AS b FROM run),
        g AS (SELECT h.text_id, h.a, count(r.tail_sa) AS tails FROM head h LEFT JOIN run r ON r.text_id = h.text_id AND r.tail_sa >= h.a AND r.tail_sa < h.b GROUP BY h.text_id, h.a)
        SELECT tails, count(*) AS gaps FROM g GROUP BY tails""",
    "head_subsample": f"WITH RECURSIVE {_KEPT} SELECT text_id, head_sa FROM keep",
    "phi_blocks": _blocks("lag(tail_sa) OVER (PARTITION BY text_id ORDER BY run_id)"),
    "phi_blocks_circular": _blocks("coalesce(lag(tail_sa) OVER (PARTITION BY text_id ORDER BY run_id), first_value(tail_sa) OVER (PARTITION BY text_id ORDER BY run_id DESC))"),
    "document_size_histogram": f"""WITH x AS (SELECT CAST(strlen(text) AS DOUBLE) AS x FROM documents WHERE text IS NOT NULL), q AS (SELECT quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.25) AS q1 FROM x),
        k AS (SELECT x FROM x, q WHERE x <= q3 + 1.5 * (q3 - q1)), e AS (SELECT min(x) AS lo, max(x) AS hi FROM k)
        SELECT CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / ((hi - lo) / {BINS})), {BINS - 1}) AS BIGINT) ELSE 0 END AS bin, count(*) AS n FROM k, e GROUP BY ALL""",
    "price_extremes": "SELECT p_type, min(p_retailprice) AS least, max(p_retailprice) AS most, max(p_retailprice) / min(p_retailprice) AS ratio FROM part GROUP BY p_type",
    "locate_by_samples": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, i - min(i) OVER (PARTITION BY pat_id, text_id) AS ord, pos FROM hit",
    "locate_all_samples": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, i - min(i) OVER (PARTITION BY pat_id, text_id) AS ord, pos FROM hit",
    "locate_downwards": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, i - min(i) OVER (PARTITION BY pat_id, text_id) AS ord, pos FROM hit",
    "count_with_tail": f"WITH {_SUFFIXES}{_PATTERNS} SELECT pat_id, text_id, min(i) AS l, max(i) AS r, arg_max(pos, i) AS last_pos FROM hit GROUP BY pat_id, text_id",
    "locate_in_strings": """WITH named AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name),
        pat AS (SELECT CAST(2 * k AS BIGINT) AS pat_id, p_name AS p FROM named UNION ALL SELECT CAST(2 * k + 1 AS BIGINT), reverse(p_name) FROM named),
        pair AS (SELECT pat_id, p_partkey, p_name AS t, p FROM part JOIN pat ON contains(p_name, p)),
        step AS (SELECT *, unnest(range(length(t) - length(p) + 1)) AS k FROM pair)
        SELECT pat_id, CAST(p_partkey AS BIGINT) AS string_id, CAST(strlen(substr(t, 1, k)) AS BIGINT) AS "offset" FROM step WHERE substr(t, k + 1, length(p)) = p""",
    "run_of_position": f"""WITH {_RUNS}{_PLACES} SELECT p.text_id, p.i, r.run_id, p.i - r.head_i AS "offset", p.i = r.head_i AS is_head, p.i = r.head_i + r.len - 1 AS is_tail
        FROM place p LEFT JOIN run r ON r.text_id = p.text_id AND p.i BETWEEN r.head_i AND r.head_i + r.len - 1""",
    "run_range": f"""WITH {_RUNS} SELECT text_id, run_id, sym, head_i AS l, head_i + len - 1 AS r FROM run
        UNION ALL SELECT text_id, count(*), NULL, NULL, NULL FROM run GROUP BY text_id""",
    "break_range": f"""WITH {_RUNS}{_PLACES}{_ENDS}, part_of AS (SELECT e.text_id, e.i, e.j, e.sym, s.i AS spot, s.i - row_number() OVER (PARTITION BY e.text_id, e.i, e.j, e.sym ORDER BY s.i) AS g
        FROM ends e JOIN suf s ON s.text_id = e.text_id AND s.sym = e.sym AND s.i BETWEEN e.i AND e.j)
        SELECT text_id, i, j, sym, min(spot) AS l, max(spot) AS r FROM part_of GROUP BY text_id, i, j, sym, g""",
    "closest_run_break": f"""WITH {_RUNS}{_PLACES}{_ENDS}, held AS (SELECT e.*, s.i AS spot, b.sym AS before, a.sym AS after FROM ends e JOIN suf s ON s.text_id = e.text_id AND s.sym = e.sym AND s.i BETWEEN e.i AND e.j
        LEFT JOIN suf b ON b.text_id = s.text_id AND b.i = s.i - 1 AND b.i >= e.i LEFT JOIN suf a ON a.text_id = s.text_id AND a.i = s.i + 1 AND a.i <= e.j),
        met AS (SELECT text_id, i, j, sym, min(spot) AS spot FROM held WHERE before <> sym OR after <> sym GROUP BY text_id, i, j, sym)
        SELECT e.text_id, e.i, e.j, e.sym, m.spot AS closest FROM ends e LEFT JOIN met m ON m.text_id = e.text_id AND m.i = e.i AND m.j = e.j AND m.sym = e.sym""",
    "suffix_array_from_transform": f"WITH {_SUFFIXES} SELECT text_id, i, pos FROM suf",
    "run_samples_from_transform": f"WITH {_RUNS} SELECT text_id, run_id, head_sa, tail_sa, CAST(sum(len) OVER (PARTITION BY text_id, sym ORDER BY head_i) - len AS BIGINT) AS rank_before FROM run",
    "required_subsample": f"""WITH RECURSIVE {_RUNS},
        head AS (SELECT text_id, head_sa AS p, len >= 4 AS needed, row_number() OVER w - 1 AS k, lead(head_sa) OVER w AS nxt FROM run WINDOW w AS (PARTITION BY text_id ORDER BY head_sa DESC)),
        walk AS (SELECT text_id, k, p AS last, p AS kept FROM head WHERE k = 0 UNION ALL
                 SELECT h.text_id, h.k, CASE WHEN h.nxt IS NULL OR h.needed OR w.last - h.nxt > {STEP} THEN h.p ELSE w.last END, CASE WHEN h.nxt IS NULL OR h.needed OR w.last - h.nxt > {STEP} THEN h.p END
                 FROM walk w JOIN head h ON h.text_id = w.text_id AND h.k = w.k + 1)
        SELECT text_id, kept AS head_sa FROM walk WHERE kept IS NOT NULL""",
    "phi_steps": f"""WITH RECURSIVE block AS ({_blocks("lag(tail_sa) OVER (PARTITION BY text_id ORDER BY run_id)")}), {_SUFFIXES},
        one AS (SELECT s.text_id, s.pos, CASE WHEN b.valid_area = 0 OR s.pos - b.start < b.valid_area THEN s.pos + b.diff END AS nxt FROM suf s ASOF LEFT JOIN block b ON b.text_id = s.text_id AND s.pos >= b.start),
        three AS (SELECT a.text_id, a.pos, a.nxt AS n1, b.nxt AS n2, c.nxt AS n3 FROM one a LEFT JOIN one b ON b.text_id = a.text_id AND b.pos = a.nxt LEFT JOIN one c ON c.text_id = a.text_id AND c.pos = b.nxt)
        SELECT text_id, pos, unnest([1, 2, 3]) AS ord, unnest([n1, n2, n3]) AS next_pos, unnest([n1 IS NOT NULL, n2 IS NOT NULL, n3 IS NOT NULL]) AS valid FROM three""",
    "psi_runs": f"""WITH {_SUFFIXES}, p AS (SELECT a.text_id, a.i, b.i AS psi, b.sym AS first FROM suf a JOIN suf b ON b.text_id = a.text_id AND b.pos = (a.pos + 1) % a.n),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY text_id, first, psi - i ORDER BY i) AS g FROM p)
        SELECT text_id, first, min(i) AS head_i, min(psi) AS psi, count(*) AS len FROM g GROUP BY text_id, first, psi - i, g""",
    "psi_lookup": f"WITH {_SUFFIXES} SELECT a.text_id, a.i, b.i AS psi FROM suf a JOIN suf b ON b.text_id = a.text_id AND b.pos = (a.pos + 1) % a.n",
    "psi_range": f"""WITH {_RUNS}{_PLACES}{_ENDS} SELECT e.text_id, e.sym, e.i, e.j, min(b.i) AS l, max(b.i) AS r FROM ends e
        LEFT JOIN suf s ON s.text_id = e.text_id AND s.sym = e.sym AND s.i BETWEEN e.i AND e.j
        LEFT JOIN suf b ON b.text_id = s.text_id AND b.pos = (s.pos + s.n - 1) % s.n GROUP BY e.text_id, e.sym, e.i, e.j""",
}
