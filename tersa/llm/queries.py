"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.llm import (
    decontaminate, lm_score, packing, paragraphs, prefix_trie, quality, repair, secrets, sharding, simhash, suffix_dedup, topk, toxicity,
)
from tersa.llm.common import Scratch
from tersa.workload.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


_OP6_SQL = r"""
WITH alphabet AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, alphabet),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, alphabet),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, i, m FROM dw SEMI JOIN (SELECT DISTINCT m, t FROM bw) USING (m, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM dw JOIN bw USING (m, t)) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register("op6_decontaminate", _OP6_SQL)
def op6(spark, sf_dir):
    out, _ = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op6")
    )
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


@register("op2_pack_sequences")
def op2(spark, sf_dir):
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    return packing.pack(pieces, Scratch(spark, "op2"))


@register("op4_simhash_dedup")
def op4(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_quality_gam")
def op10(spark, sf_dir):
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op10"))
    return scored.withColumn("predicted", quality.accepted().cast("int"))


_OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, j, h[200 * j + 1:200 * j + 298] AS h
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 200 + 1)) AS j FROM d WHERE len(h) >= 100)),
g AS (SELECT doc_id, 100 * j + o AS i, md5(h[2 * o + 1:2 * o + 100]) AS k
  FROM (SELECT doc_id, j, h, unnest(range(0, least(100, len(h) // 2 - 49))) AS o FROM p WHERE len(h) >= 100)),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
w AS (SELECT doc_id, i FROM g JOIN f USING (k) WHERE least < doc_id),
s AS (SELECT doc_id, i, i > coalesce(lag(i) OVER by_doc, -100) + 50 AS fresh FROM w WINDOW by_doc AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
r AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY 1, 2),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS tail,
    string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS head FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || h[2 * coalesce(tail, 0) + 1:])) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""


@register("op9_suffix_dedup", _OP9_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = suffix_dedup.remove_repeats(docs, Scratch(spark, "op9"))
    return done.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_balanced_shards")
def op8(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register("op5_threshold_topk", _OP5_SQL)
def op5(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), Scratch(spark, "op5"))


@register("op3_toxic_segments")
def op3(spark, sf_dir):
    found = toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op3"))
    return found.select("doc_id", "held_out", "score", toxicity.flagged().cast("int").alias("predicted"))


@register("op1_pseudo_likelihood")
def op1(spark, sf_dir):
    return lm_score.score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


@register("op7_near_paragraphs")
def op7(spark, sf_dir):
    return paragraphs.near_paragraphs(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), passage=paragraphs.PASSAGE)


def _crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of an ASCII text, bit by bit."""
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
    )


_OP11_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(k := md5(length(role) || ':' || role || text),
    w := len(regexp_extract_all(text, '[^ 	-
]+'))) ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS t
  FROM r GROUP BY conv_id),
h AS (SELECT conv_id, t, {_crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM o),
f AS (SELECT h.conv_id, list_concat(coalesce(o.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, len(t) = d AS ends, t[d].w AS w, md5(array_to_string(list_transform(t[1:d], lambda x: x.k), ',')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(t[1:d - 1], lambda x: x.k), ',')) END AS parent
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM f)),
n AS (SELECT node, any_value(d) AS depth, any_value(parent) AS parent, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM p GROUP BY node),
c AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (node)),
s AS (SELECT p.node, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * coalesce(x.w, 0)) AS saved
  FROM x JOIN p ON p.conv_id = x.conv_id AND p.d <= x.depth GROUP BY p.node)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM x JOIN s ON s.node = x.node LEFT JOIN n u ON u.node = x.parent"""


@register("op11_prefix_trie", _OP11_SQL)
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), Scratch(spark, "op11"))


@register("op13_conversation_repair")
def op13(spark, sf_dir):
    return repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")))


def _op12_kind(number: int, kind: str, pattern: str) -> str:
    pattern = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, owner, {number} AS k, '{kind}' AS kind, i, g, m, {f"regexp_extract(m, {pattern}, 2)" if number == 0 else "m"} AS v FROM (
    SELECT r, owner, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS g, unnest(m) AS m FROM (
      SELECT r, owner, regexp_extract_all(text, {pattern}) AS m, regexp_split_to_array(text, {pattern}) AS g FROM d) WHERE len(m) > 0)"""


_OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_replace(coalesce(source, ''), '/[^/]*$', '') AS owner FROM documents),
c AS ({" UNION ALL ".join(_op12_kind(k, kind, p) for k, (kind, p) in enumerate(zip(secrets.KINDS, secrets.PATTERNS)))}),
p AS (SELECT *, sum(g + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS stop FROM c),
s AS (SELECT r, owner, k, kind, stop - length(m) AS start, stop, v FROM p WHERE k > 0 OR length(v) >= {secrets.ASSIGN_LEAST}),
o AS (SELECT v, count(DISTINCT owner) >= {secrets.COPIED_OWNERS} AS copied FROM s GROUP BY v),
q AS (SELECT s.*, NOT copied AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND length(v) <= {secrets.TOKEN_MOST}
    AND NOT regexp_matches(v, '{secrets.PLACEHOLDER}') AND len(list_distinct(string_split(v, ''))) >= {secrets.DIFFERENT} AS owned FROM s JOIN o USING (v)),
u AS (SELECT * FROM q WHERE k < 3 OR (owned AND NOT EXISTS (
    SELECT 1 FROM q b WHERE b.r = q.r AND b.k < 3 AND b.start < q.stop AND q.start < b.stop))),
w AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) AS spans FROM u GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN w USING (r)"""


@register("op12_secret_ownership", _OP12_SQL)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found, _, _ = secrets.scan_secrets(docs, Scratch(spark, "op12"))
    base = F.sha2(F.array_join("base", ",").cast("binary"), 256)
    return found.select(
        "doc.doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )
