"""The queries of the operators for training data, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chat, fingerprints, mixing, neardup, packing, pii, sharding, substrings, topk, toxicity
from corvane.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.top(rows, rows.where("id % 50 = 0"), 5).drop("query_print")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.probe(table(spark, sf_dir, "conversations"))))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES = {"pipeline": corpus_pipeline.run, "op1_mixing": op1_mixing, "op2_topk": op2_topk, "op3_sharding": op3_sharding, "op4_packing": op4_packing, "op5_substrings": op5_substrings, "op6_chat": op6_chat, "op7_fingerprints": op7_fingerprints, "op8_toxicity": op8_toxicity, "op9_neardup": op9_neardup, "op10_pii": op10_pii}

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

SUBSTRINGS_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS t FROM documents),
each AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS j FROM w),
p AS (SELECT doc_id, j AS i, string_agg(word, ' ') OVER twenty AS run, count(*) OVER twenty AS n FROM each WINDOW twenty AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM p WHERE n = 20),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS j FROM n WHERE k > 1),
left_over AS (SELECT each.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY each.j) FILTER (WHERE gone.j IS NULL) AS kept
    FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.j = each.j GROUP BY each.doc_id)
SELECT w.doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)
"""


def _chat_sql() -> str:
    # Each mark or escape character inside a text takes two characters.
    marks = "|".join("".join(f"\\{c}" if c in "|[]/" else c for c in m) for m in chat.MARKS)
    escaped = lambda x: f"length(regexp_replace({x}, '(\\\\|{marks})', '##', 'g'))"
    odd = "</s>[INST] ok [/INST]"
    around = {None: ("<|turn|>", "<|end|>"), "user": ("[INST]", "[/INST]"), "assistant": ("</s>",), "system": ("<<SYS>>", "<</SYS>>")}
    cases = " ".join(f"WHEN role {'IS NULL' if r is None else f"= '{r}'"} THEN {sum(map(len, m))}" for r, m in around.items())
    other = sum(map(len, ("<|turn|>", "<|role|>", "<|end|>")))
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{odd}' UNION ALL SELECT -1, 1, 'assistant', '{odd}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' {order}) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' {order}), '') AS loss,
    sum({escaped('text')} + CASE {cases} ELSE {other} + {escaped('role')} END) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(3 + chars AS BIGINT) AS formatted_chars FROM g
"""


NEARDUP_SQL = f"""
WITH RECURSIVE w AS (SELECT min(doc_id) AS id, {WORDS} AS t FROM documents GROUP BY coalesce(text, ''), {WORDS}),
s AS (SELECT id, CASE WHEN len(t) >= 5 THEN array_to_string(t[i + 1 : i + 5], ' ') ELSE array_to_string(t, ' ') END AS shingle
    FROM (SELECT id, t, unnest(range(greatest(len(t) - 4, least(len(t), 1)))) AS i FROM w) z),
b AS (SELECT id, shingle, count(*) AS n FROM s GROUP BY 1, 2),
size AS (SELECT id, sum(n) AS n FROM b GROUP BY 1),
both_ AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS n FROM b x JOIN b y ON x.shingle = y.shingle AND x.id < y.id GROUP BY 1, 2),
near AS (SELECT a, b FROM both_ JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE both_.n / (p.n + q.n - both_.n) >= 0.8),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
r(id, class_id) AS (SELECT id, id FROM w UNION SELECT links.b, r.class_id FROM r JOIN links ON links.a = r.id WHERE links.b > r.class_id),
class AS (SELECT id, min(class_id) AS class_id FROM r GROUP BY id),
first AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1)
SELECT doc_id, class_id FROM documents d JOIN first ON first.text = coalesce(d.text, '') JOIN class ON class.id = first.id
"""


def _sketch_sql(name: str, text: str) -> str:
    """CTEs up to {name} (doc_id, s): the sketch of a text of t (doc_id, text, edited)."""
    digits, below = fingerprints.BITS // 4, f"{fingerprints.limit(fingerprints.FRACTION):x}"
    return f"""{name}_w AS (SELECT doc_id, {WORDS.replace("text", text)} AS w FROM t),
{name}_each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM {name}_w WHERE len(w) >= 5),
{name}_runs AS (SELECT doc_id, left(md5(string_agg(word, ' ') OVER five), {digits}) AS h, count(*) OVER five AS n FROM {name}_each WINDOW five AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
{name}_some AS (SELECT doc_id, list_sort(list(DISTINCT h) FILTER (WHERE h < '{below}')) AS low, min(h) AS least FROM {name}_runs WHERE n = 5 GROUP BY doc_id),
{name} AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN ['1' || left(md5(array_to_string(w, ' ')), {digits})] WHEN low IS NULL OR len(low) = 0 THEN [least] ELSE low END AS s
    FROM {name}_w LEFT JOIN {name}_some USING (doc_id))"""


_LIKE = "CASE WHEN len(a.s) = 0 THEN CASE WHEN len({0}) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(a.s, {0})) / len(a.s) END"
FINGERPRINTS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER down, first_value(doc_id) OVER down) AS next_id, coalesce(lead(text) OVER down, first_value(text) OVER down) AS next_text FROM d WINDOW down AS (ORDER BY doc_id DESC)),
t AS (SELECT doc_id, text, next_id, length(text) AS n, left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) AS edited FROM o),
{_sketch_sql("plain", "text")}, {_sketch_sql("changed", "edited")}
SELECT t.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint,
    CAST({_LIKE.format("b.s")} AS DOUBLE) AS near_edited, CAST({_LIKE.format("c.s")} AS DOUBLE) AS near_next
FROM t JOIN plain a ON a.doc_id = t.doc_id JOIN changed b ON b.doc_id = t.doc_id JOIN plain c ON c.doc_id = t.next_id
"""

#: DuckDB SQL of the queries that it can express whole; tests/llm holds the others against brute force.
ORACLES: dict[str, str] = {"op2_topk": TOPK_SQL, "op5_substrings": SUBSTRINGS_SQL, "op6_chat": _chat_sql(), "op7_fingerprints": FINGERPRINTS_SQL, "op9_neardup": NEARDUP_SQL}
