"""Named queries of the training-text operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayline.llm import best_fit, exact_dedup, fingerprints, hard_negatives, jaccard_join, language_id, mixing, secret_scan, spelling, substring_dedup, tool_calls, toxicity, url_filter
from wayline.plans.registry import Query

C = F.col
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(kinds):
    """kind:start:end of the spans of these kinds, comma-joined."""
    return F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_secrets")
def op1(spark, sf_dir):
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.find_secrets(documents(spark, sf_dir)).select(
        "doc_id", count("assign"), count("access"), count("hex"), count("novel"),
        F.sha2(_joined(secret_scan.KINDS[:3]), 256).alias("base_sha256"), _joined(secret_scan.KINDS).alias("spans"))


_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM w),
s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM g UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT g.doc_id, any_value(len(grams)) AS n_shingles, min(y) AS component_id FROM g JOIN reach ON g.doc_id = x GROUP BY g.doc_id"""


@query("op2_ngram_join", _NEAR)
def op2(spark, sf_dir):
    return jaccard_join.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held_out", language_id.held_out(1, 3))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language_id.held_out(1, 3))
    return toxicity.score(docs, toxicity.fit(docs.where("NOT held_out"), labels), ["held_out"]).select(
        "doc_id", "held_out", "score", (C("score") >= 0.7).cast("int").alias("predicted"), F.size("hits").alias("n_hits"),
        F.size(F.filter("hits", lambda h: h["quoted"])).alias("n_quoted"))


_COPIES = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


@query("op4_exact_dedup", _COPIES)
def op4(spark, sf_dir):
    return exact_dedup.exact_copies(documents(spark, sf_dir), hash_all=True).withColumnRenamed("text_hash", "text_sha256")


#: the two tools that the turns of a conversation stand for; parameters as in their schemas
_SCHEMAS = [
    ("configure", "prompt", "string", True, 1, 400), ("configure", "turn", "integer", True, 0, 0),
    ("reply", "prompt", "string", True, 1, 600), ("reply", "turn", "integer", True, 0, 0),
]

_CALLS = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE role WHEN 'system' THEN 'configure' ELSE 'reply' END AS tool, text
  FROM conversations WHERE role IN ('system', 'user')),
results AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM conversations WHERE role NOT IN ('system', 'user')),
lv AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn IN (c.turn - 1, c.turn - 2))
  UNION SELECT c.conv_id, c.turn, l.level + 1 FROM lv l JOIN calls c ON c.conv_id = l.conv_id AND c.turn IN (l.turn + 1, l.turn + 2)),
top AS (SELECT conv_id, turn, max(level) AS level FROM lv GROUP BY conv_id, turn)
SELECT c.conv_id, c.call_id, c.turn, c.tool, t.level, r.call_id IS NOT NULL AS linked,
  array_to_string(list_filter([
    CASE WHEN length(c.text) < 1 THEN 'too short prompt' WHEN length(c.text) > CASE c.tool WHEN 'reply' THEN 600 ELSE 400 END THEN 'too long prompt' END,
    CASE WHEN r.call_id IS NULL THEN 'no result' END], lambda e: e IS NOT NULL), ', ') AS errors,
  '{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"call_id":"' || c.call_id || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null')
    || ',"tool":"' || c.tool || '"}' AS json
FROM calls c JOIN top t USING (conv_id, turn) LEFT JOIN results r ON r.call_id = c.call_id
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, NULL, NULL, FALSE, 'result without call',
  '{"arguments":null,"call_id":"' || r.call_id || '","result":' || to_json(r.text) || ',"tool":null}'
FROM results r ANTI JOIN calls c ON c.call_id = r.call_id"""


@query("op8_tool_calls", _CALLS)
def op8(spark, sf_dir):
    """Every user turn calls 'reply', every system turn 'configure'; the next other turn is the result.

    A call waits for the calls one and two turns before it.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda back: F.concat_ws(":", "conv_id", C("turn") - back)
    asks = C("role").isin("system", "user")
    before = turns.where(asks).select(C("conv_id"), C("turn").alias("earlier"))
    calls = turns.where(asks).select(
        "conv_id", name(0).alias("call_id"), "turn", F.when(C("role") == "system", "configure").otherwise("reply").alias("tool"),
        F.to_json(F.struct("turn", C("text").alias("prompt"))).alias("arguments"), F.array(name(1), name(2)).alias("near"))
    known = before.select("conv_id", F.concat_ws(":", "conv_id", "earlier").alias("id"))
    after = calls.select("conv_id", "call_id", F.explode("near").alias("id")).join(known, ["conv_id", "id"], "left_semi").groupBy("conv_id", "call_id").agg(F.collect_set("id").alias("after"))
    calls = calls.drop("near").join(after, ["conv_id", "call_id"], "left")
    results = turns.where(~asks).select("conv_id", name(1).alias("call_id"), "turn", C("text").alias("content"))
    schemas = spark.createDataFrame(_SCHEMAS, "tool string, name string, type string, required boolean, min_length int, max_length int")
    return tool_calls.link_calls(calls, results, schemas).select(
        "conv_id", "call_id", "turn", "tool", "level", "linked", F.array_join("errors", ", ").alias("errors"), "json")


@query("op9_fingerprints")
def op9(spark, sf_dir):
    return fingerprints.edited_pairs(documents(spark, sf_dir))


@query("op10_language")
def op10(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held_out", language_id.held_out(2, 4))
    model = language_id.fit(docs.where("NOT held_out"))
    return language_id.predict(docs, model, ["held_out"])


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_packing")
def op6(spark, sf_dir):
    return best_fit.pack_documents(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_mixing")
def op7(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: a listing of sites, as such lists come: names under several endings
_SITES = [(f"{name}.example.{end}", "/") for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]

_URLS = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in _RULES)}),
sites(h, p) AS (VALUES {", ".join(str(r) for r in _SITES)}),
judged AS (
  SELECT *, (SELECT max(struct_pack(n := length(h || p), h := length(h), rule := h || p, v := v)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
    EXISTS (SELECT 1 FROM sites WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS listed FROM split)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


@query("op12_url_filter", _URLS)
def op12(spark, sf_dir):
    """Rules first; URLs without a rule are judged by a listing of sites."""
    rules = spark.createDataFrame(_RULES, "host string, path string, verdict string")
    sites = spark.createDataFrame(_SITES, "host string, path string")
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, sites, ["page_id"]).drop("listed_key")


_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS d FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.d, b.d) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3"""


@query("op13_hard_negatives", _NEGATIVES)
def op13(spark, sf_dir):
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.forall("embedding", finite)).select(
        "vec_id", F.when(C("vec_id") % 7 == 0, (C("label") + 1) % 10).otherwise(C("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("dims"))
    return hard_negatives.mine(rows, C("vec_id") % 50 == 0)


@query("op11_spelling")
def op11(spark, sf_dir):
    words = spelling.count_words(documents(spark, sf_dir), spelling.edited_runs(), 6, 5)
    return spelling.group_variants(words)
