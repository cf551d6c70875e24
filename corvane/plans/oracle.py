"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

TERM, WORD = "the", "the"
QUERY_AND, QUERY_OR, QUERY_NESTED, QUERY_MISSING = "the idiot AND", "idiot moron OR", "the of AND idiot moron OR AND la OR", "zzzz the AND"
SOURCES, KEYWORDS, PARTS = [1, 17, 42], ["click", "err"], 8

SPACE = r"'[ \t\n\x0B\f\r]+'"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {SPACE}), lambda t: t <> '')"


TERMS = f"tok AS (SELECT doc_id AS docno, unnest({tokens('text')}) AS term FROM documents)"
LINES = "ln AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"
BIGRAMS = f"{LINES}, tl AS (SELECT {tokens('line')} AS t FROM ln), bg AS (SELECT unnest(list_zip(t[1:len(t)-1], t[2:len(t)])) AS b FROM tl WHERE len(t) > 1), big AS (SELECT b[1] AS first, b[2] AS second, count(*) AS cnt FROM bg GROUP BY 1, 2)"
MARGINALS = f"{LINES}, lt AS (SELECT doc_id, line_no, unnest(list_distinct({tokens('line')})) AS term FROM ln), mg AS (SELECT term, count(*) AS cnt, row_number() OVER (ORDER BY term) AS n FROM lt GROUP BY term HAVING count(*) >= 10)"
PAIRS = f"{MARGINALS}, lid AS (SELECT doc_id, line_no, n FROM lt JOIN mg USING (term)), half AS (SELECT a.n AS x, b.n AS y, count(*) AS cnt FROM lid a JOIN lid b USING (doc_id, line_no) WHERE a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 10), prs AS (SELECT l.term AS \"left\", r.term AS \"right\", z.cnt AS cnt, l.cnt AS lc, r.cnt AS rc FROM (SELECT x, y, cnt FROM half UNION ALL SELECT y, x, cnt FROM half) z JOIN mg l ON l.n = z.x JOIN mg r ON r.n = z.y)"
PMI = f"{PAIRS}, tot AS (SELECT count(*) AS n FROM ln), pm AS (SELECT \"left\", \"right\", round(ln(cnt / (lc * rc) * n), 6) AS pmi FROM prs, tot)"
TF = f"{TERMS}, tf AS (SELECT term, docno, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY 1, 2)"
#: Document numbers of one range of an index, as the engine has it by default, and as one query has it.
CHUNK, SMALL_CHUNK = 1 << 20, 300


def index(chunk: int) -> str:
    return f"WITH {TF}, ch AS (SELECT term, docno // {chunk} AS chunk, string_agg(docno || ':' || tf, ',' ORDER BY docno) AS postings, count(*) AS n FROM tf GROUP BY 1, 2) SELECT term, chunk, n, postings FROM ch"


def edges(where: str = "true") -> str:
    return f"e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE {where})"


EDGES, ACYCLIC = edges(), edges("a.l_partkey < b.l_partkey")
SPARSE = "nd AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0)"
NODES = "nd AS (SELECT p_partkey AS id FROM part)"
THIN = f"{NODES}, {ACYCLIC}, te AS (SELECT src, dst FROM e WHERE (src * 7 + dst) % 13 = 0), un AS (SELECT src AS s, dst AS d FROM te UNION SELECT dst, src FROM te), r(id, lab) AS (SELECT id, id FROM nd UNION SELECT un.d, r.lab FROM r JOIN un ON un.s = r.id WHERE un.d > r.lab), w AS (SELECT id, min(lab) AS component FROM r GROUP BY id)"


def labelled(rounds: int) -> str:
    """CTEs up to w (id, component): each node's least label after so many rounds, more than this dense graph needs."""
    out = [NODES, EDGES, "un AS MATERIALIZED (SELECT src AS s, dst AS d FROM e UNION SELECT dst, src FROM e)", "l0 AS (SELECT id, id AS lab FROM nd)"]
    for i in range(1, rounds + 1):
        out.append(f"l{i} AS MATERIALIZED (SELECT id, min(lab) AS lab FROM (SELECT id, lab FROM l{i - 1} UNION ALL SELECT un.d, l{i - 1}.lab FROM un JOIN l{i - 1} ON un.s = l{i - 1}.id) z WHERE id IN (SELECT id FROM nd) GROUP BY id)")
    return ", ".join([*out, f"w AS (SELECT id, lab AS component FROM l{rounds})"])


def vint(v: str) -> str:
    hexed = f"hex(CAST({v} AS BIGINT))"
    digits = f"CASE WHEN {v} = 0 THEN '0' ELSE ltrim({hexed}, '0') END"
    size = f"CAST(ceil(length({digits}) / 2.0) AS INTEGER)"
    return f"CASE WHEN {v} <= 127 THEN lpad({digits}, 2, '0') ELSE ltrim(hex(CAST(144 - {size} AS BIGINT)), '0') || lpad({digits}, 2 * {size}, '0') END"


def finds(query: str) -> str:
    """The document numbers that a query in reverse Polish notation finds."""
    stack: list[str] = []
    for t in query.split():
        if t in ("AND", "OR"):
            b, a = stack.pop(), stack.pop()
            stack.append(f"({a} {'INTERSECT' if t == 'AND' else 'UNION'} {b})")
        else:
            stack.append(f"(SELECT docno FROM tok WHERE term = '{t}')")
    return f"SELECT DISTINCT docno FROM {stack[0]} q"


def ranked(k: int, nodes: str = NODES, edges: str = EDGES) -> str:
    """CTEs up to p{k}: k iterations of PageRank."""
    out = [nodes, edges, "dg AS (SELECT src, count(*) AS deg FROM e GROUP BY src)", "es AS MATERIALIZED (SELECT e.src, e.dst, 1.0::DOUBLE / deg AS part FROM e JOIN dg USING (src))", "nn AS (SELECT count(*)::DOUBLE AS n FROM nd)", "p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS p FROM nd, nn)"]
    for i in range(1, k + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT nd.id, coalesce(x.m, 0.0::DOUBLE) AS m FROM nd LEFT JOIN (SELECT es.dst, sum(p * part) AS m FROM p{i - 1} JOIN es ON es.src = p{i - 1}.id GROUP BY es.dst) x ON x.dst = nd.id)")
        out.append(f"p{i} AS MATERIALIZED (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * (m + lost / n) AS p FROM m{i}, nn, (SELECT greatest(0.0::DOUBLE, 1.0::DOUBLE - sum(m)) AS lost FROM m{i}) l)")
    return ", ".join(out)


def personalized(k: int) -> str:
    """CTEs up to p{k}: k iterations of personalized PageRank, rows (source, id, p)."""
    sources = " UNION ALL ".join(f"SELECT {s}::BIGINT AS source" for s in SOURCES)
    out = [NODES, EDGES, "dg AS (SELECT src, count(*) AS deg FROM e GROUP BY src)", "es AS MATERIALIZED (SELECT e.src, e.dst, 1.0::DOUBLE / deg AS part FROM e JOIN dg USING (src))", f"so AS ({sources})", "p0 AS MATERIALIZED (SELECT source, id, CASE WHEN id = source THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM nd, so)"]
    for i in range(1, k + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT q.source, q.id, coalesce(x.m, 0.0::DOUBLE) AS m FROM (SELECT source, id FROM nd, so) q LEFT JOIN (SELECT source, es.dst, sum(p * part) AS m FROM p{i - 1} JOIN es ON es.src = p{i - 1}.id GROUP BY source, es.dst) x ON x.dst = q.id AND x.source = q.source)")
        out.append(f"p{i} AS MATERIALIZED (SELECT m{i}.source, id, CASE WHEN id = m{i}.source THEN 0.15::DOUBLE + 0.85::DOUBLE * (m + lost) ELSE 0.85::DOUBLE * m END AS p FROM m{i} JOIN (SELECT source, greatest(0.0::DOUBLE, 1.0::DOUBLE - sum(m)) AS lost FROM m{i} GROUP BY source) l ON l.source = m{i}.source)")
    return ", ".join(out)


def hours(fmt: str, where: str = "ts IS NOT NULL", ts: str = "ts") -> str:
    return f"SELECT strftime({ts}, '{fmt}') AS hour, count(*) AS cnt FROM events WHERE {where} GROUP BY 1"


def sql() -> dict[str, str]:
    alpha = "regexp_full_match(term, '[A-Za-z]+')"
    keyword = " OR ".join(f"contains(lower(event_type), '{k}')" for k in KEYWORDS)
    pattern = f"regexp_matches(event_type, '(?i){'|'.join(KEYWORDS)}')"
    gaps = f"WITH {TF}, g AS (SELECT term, docno // {CHUNK} AS chunk, docno, tf, docno - coalesce(lag(docno) OVER (PARTITION BY term, docno // {CHUNK} ORDER BY docno), 0) AS gap FROM tf), h AS (SELECT term, chunk, docno, {vint('gap')} || {vint('tf')} AS b FROM g), f AS (SELECT term, chunk, count(*) AS n, string_agg(b, '' ORDER BY docno) AS body FROM h GROUP BY 1, 2) SELECT term, chunk, n, {vint('n')} || body AS blob FROM f"
    top = "SELECT id, round(p, 9) AS p FROM p10"
    ppr = "SELECT source, id, round(p, 9) AS p FROM p10"
    return {
        "word_count_alpha": f"WITH {TERMS} SELECT term, count(*) AS cnt FROM tok WHERE {alpha} GROUP BY term",
        "word_count_all": f"WITH {TERMS} SELECT term, count(*) AS cnt FROM tok GROUP BY term",
        "vocab_size": f"WITH {TERMS} SELECT count(DISTINCT term) AS terms FROM tok",
        "vocab_size_alpha": f"WITH {TERMS} SELECT count(DISTINCT term) AS terms FROM tok WHERE {alpha}",
        "bigram_count": f"WITH {BIGRAMS} SELECT first, second, cnt FROM big",
        "bigram_count_text": f"WITH {BIGRAMS} SELECT first || '_' || second AS bigram, CAST(sum(cnt) AS BIGINT) AS cnt FROM big GROUP BY 1",
        "cooc_marginals": f"WITH {MARGINALS} SELECT term, cnt FROM mg",
        "cooc_pairs": f'WITH {PAIRS} SELECT "left", "right", cnt FROM prs',
        "cooc_conditional": f'WITH {PAIRS} SELECT "left", "right", cnt / lc AS p FROM prs',
        "cooc_stripes": f'WITH {PAIRS} SELECT "left", "right", cnt FROM prs',
        "pmi": f"WITH {PMI} SELECT * FROM pm",
        "pmi_compat": f'WITH {PAIRS} SELECT "left", "right", round(ln(cnt / (lc * rc)), 6) AS pmi FROM prs',
        "pmi_stripes": f"WITH {PMI} SELECT * FROM pm",
        "pmi_count": f"WITH {PAIRS} SELECT count(*) AS pairs FROM prs",
        "pmi_top_pair": f'WITH {PMI} SELECT * FROM pm ORDER BY pmi DESC, "left", "right" LIMIT 1',
        "pmi_topk_for_word": f'WITH {PMI} SELECT "right", pmi FROM pm WHERE "left" = \'{WORD}\' ORDER BY pmi DESC, "right" LIMIT 10',
        "inverted_index": index(CHUNK),
        "inverted_index_compressed": gaps,
        "document_frequencies": f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
        "index_roundtrip": index(CHUNK),
        "index_two_shuffles": index(SMALL_CHUNK),
        "postings_lookup": f"WITH {TF} SELECT docno, tf FROM tf WHERE term = '{TERM}'",
        "postings_lookup_compressed": f"WITH {TF} SELECT docno, tf FROM tf WHERE term = '{TERM}'",
        "tf_histogram": f"WITH {TF} SELECT tf, count(*) AS cnt FROM tf WHERE term = '{TERM}' GROUP BY tf",
        "bool_and": f"WITH {TERMS} {finds(QUERY_AND)}",
        "bool_or": f"WITH {TERMS} {finds(QUERY_OR)}",
        "bool_nested": f"WITH {TERMS} {finds(QUERY_NESTED)}",
        "bool_nested_compressed": f"WITH {TERMS} {finds(QUERY_NESTED)}",
        "bool_missing_term": f"WITH {TERMS} {finds(QUERY_MISSING)}",
        "fetch_stored_lines": f"WITH {TERMS} SELECT doc_id AS docno, text FROM documents WHERE doc_id IN ({finds(QUERY_AND)})",
        "fetch_lines": f"WITH {TERMS} SELECT doc_id AS docno, text FROM documents WHERE doc_id IN ({finds(QUERY_AND)})",
        "graph_stats": f"WITH {NODES}, {EDGES}, dg AS (SELECT src, count(*) AS deg FROM e GROUP BY src) SELECT count(*) AS nodes, CAST(coalesce(sum(deg), 0) AS BIGINT) AS edges, count(deg) AS active, count(*) - count(deg) AS dangling FROM nd LEFT JOIN dg ON dg.src = nd.id",
        "graph_adjacency": f"WITH {NODES}, {EDGES} SELECT id, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst), '') AS adj FROM nd LEFT JOIN e ON e.src = nd.id GROUP BY id",
        "graph_repeated_nodes": f"WITH {NODES}, {EDGES} SELECT id, count(*) AS cnt FROM (SELECT id FROM nd UNION ALL SELECT src FROM e) z GROUP BY id HAVING count(*) > 1",
        "graph_range_partition": f"WITH {NODES} SELECT id, CAST(CAST(floor(id * {PARTS}.0 / (SELECT count(*) FROM nd)) AS BIGINT) % {PARTS} AS INTEGER) AS part FROM nd",
        "graph_hash_partition": f"WITH {NODES} SELECT id, CAST(id % {PARTS} AS INTEGER) AS part FROM nd",
        "graph_hash_partition_counts": f"WITH {NODES} SELECT CAST(id % {PARTS} AS INTEGER) AS part, count(*) AS cnt FROM nd GROUP BY 1",
        "graph_missing_targets": f"WITH {EDGES} SELECT dst, count(*) AS cnt FROM e WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) GROUP BY dst",
        "pagerank_k": f"WITH {ranked(10)} {top}",
        "pagerank_missing_nodes": f"WITH {ranked(10, SPARSE, edges('a.l_partkey % 7 <> 0'))} SELECT id, round(p, 9) AS p FROM p10",
        "pagerank_acyclic": f"WITH {ranked(10, NODES, ACYCLIC)} {top}",
        "pagerank_resumed": f"WITH {ranked(10)} {top}",
        "pagerank_converged": f"WITH {ranked(50)} SELECT id, round(p, 8) AS p FROM p50",
        "pagerank_counters": f"WITH {SPARSE}, {EDGES}, s AS (SELECT dst, count(*) AS n FROM e WHERE src IN (SELECT id FROM nd) GROUP BY dst), t AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (dst NOT IN (SELECT id FROM nd)) AS missing FROM s) SELECT (SELECT count(*) FROM nd) AS nodes, n AS edges, n AS messages, n AS received, missing FROM t",
        "pagerank_top": f"WITH {ranked(10)} {top} ORDER BY p DESC, id LIMIT 20",
        "pagerank_log": f"WITH {ranked(10)} SELECT id, round(p, 7) AS p, round(ln(p), 7) AS logp FROM p10",
        "ppr_k": f"WITH {personalized(10)} {ppr}",
        "ppr_top": f"WITH {personalized(10)}, q AS ({ppr}) SELECT source, place, id, p FROM (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY p DESC, id) AS INTEGER) AS place, id, p FROM q) z WHERE place <= 10",
        "ppr_report": f"WITH {personalized(10)}, q AS ({ppr}) SELECT source, place, line FROM (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY p DESC, id) AS INTEGER) AS place, printf('%.5f', p) || ' ' || id AS line FROM q) z WHERE place <= 10",
        "wcc_labels": f"WITH {labelled(12)} SELECT id, component FROM w",
        "wcc_thinned": f"WITH RECURSIVE {THIN} SELECT id, component FROM w",
        "graph_summary": f"WITH {labelled(12)} SELECT (SELECT count(DISTINCT component) FROM w) AS components, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM nd)) AS edges, (SELECT count(*) FROM nd) AS nodes, 0.15::DOUBLE AS jump",
        "src_text": "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS value FROM nation",
        "src_gzip": "SELECT c_custkey || chr(9) || c_name || chr(9) || c_nationkey || chr(9) || c_acctbal || chr(9) || c_mktsegment AS value FROM customer",
        "src_offsets": "SELECT CAST(coalesce(sum(strlen(value) + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS docno, value FROM (SELECT s_suppkey AS k, s_suppkey || chr(9) || s_name AS value FROM supplier) z",
        "src_tuples": 'SELECT CAST(o_orderkey AS VARCHAR) AS "left", o_orderstatus AS "right", o_totalprice AS value FROM orders',
        "src_parquet": "SELECT * FROM part",
        "src_keyed": "SELECT * FROM orders WHERE o_orderkey IN (7, 42, 4242)",
        "src_adjacency": f"WITH {EDGES} SELECT src, dst FROM e",
        "src_tab_adjacency": f"WITH {EDGES} SELECT src, dst FROM e",
        "src_events": hours("%Y%m%d%H"),
        "src_events_csv": hours("%Y%m%d%H", f"ts IS NOT NULL AND ({keyword})"),
        "sink_iterations": "SELECT r_name, 2 AS k FROM region",
        "wcc_count": f"WITH RECURSIVE {THIN} SELECT count(DISTINCT component) AS components FROM w",
        "hourly_all": hours("%Y%m%d%H"),
        "hourly_all_mdh": "SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS cnt FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3",
        "hourly_month_day": hours("%-m/%d %H"),
        "hourly_zone": hours("%Y%m%d%H", ts="ts + INTERVAL 9 HOUR"),
        "hourly_keyword": hours("%-m/%d %H", f"ts IS NOT NULL AND ({keyword})"),
        "hourly_keyword_regex": f"SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS cnt FROM events WHERE ts IS NOT NULL AND {pattern} GROUP BY 1, 2, 3",
        "hourly_parsed_text": hours("%Y%m%d%H", "ts IS NOT NULL AND event_id % 11 <> 0"),
    }
