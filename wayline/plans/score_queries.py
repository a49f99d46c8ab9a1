"""Named queries: text scores, field scores, composites, agreement, retrieval."""

from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import normalize as N
from wayline.functions import scores as S
from wayline.functions import text as T
from wayline.operators import agreement, evaluation, joins, pairwise, reports, retrieval
from wayline.plans import tables as t
from wayline.plans.join_queries import FIRST, PAIRED
from wayline.plans.oracle_views import with_views
from wayline.plans.registry import query
from wayline.plans.report_queries import MAJORITY
from wayline.plans.sqltext import case_of, space_tokens_sql, word_tokens_sql

TURN = ["conv_id", "turn"]
STRINGS = "array<string>"


def overlap_views(source: str, keys: str, pred: str, ref: str, tokens, prefix: str, orders=(1, 2, 3, 4), lcs=True) -> dict[str, str]:
    """Views that end in {prefix}ov: source rows with np, nr, m1..m4 and lcs."""
    views = {f"{prefix}tok": f"SELECT *, {tokens(pred)} AS p, {tokens(ref)} AS r FROM {source}"}
    grams = lambda side, n: (
        f"SELECT {keys}, g, COUNT(*) AS c FROM (SELECT {keys}, UNNEST(list_transform(range(1, len({side}) - {n} + 2), "
        f"lambda i: array_to_string({side}[i:i+{n}-1], ' '))) AS g FROM {prefix}tok) GROUP BY ALL"
    )
    for n in orders:
        views[f"{prefix}m{n}"] = (
            f"SELECT {keys}, CAST(SUM(LEAST(a.c, b.c)) AS BIGINT) AS m{n} FROM ({grams('p', n)}) a JOIN ({grams('r', n)}) b USING ({keys}, g) GROUP BY ALL"
        )
    zero = "CAST(0 AS BIGINT)"
    lcs_sql = f"""CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0 ELSE
  list_reduce(list_prepend(list_transform(range(0, len(r) + 1), lambda k: {zero}), list_transform(range(1, len(p) + 1), lambda i: [i])),
    lambda prev, i: list_reduce(list_prepend([{zero}], list_transform(range(1, len(r) + 1), lambda j: [j])),
      lambda row, j: list_append(row, CASE WHEN p[i[1]] = r[j[1]] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], row[j[1]]) END)))[-1] END"""
    joins_sql = " ".join(f"LEFT JOIN {prefix}m{n} USING ({keys})" for n in orders)
    views[f"{prefix}ov"] = (
        f"SELECT *, {lcs_sql if lcs else 'NULL'} AS lcs, len(p) AS np, len(r) AS nr, "
        f"{', '.join(f'COALESCE(m{n}, 0) AS k{n}' for n in orders)} FROM {prefix}tok {joins_sql}"
    )
    return views


def f1_sql(hits: str, np_: str, nr: str) -> str:
    p, r = f"(CAST({hits} AS DOUBLE) / {np_})", f"(CAST({hits} AS DOUBLE) / {nr})"
    return f"(CASE WHEN {hits} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE CAST(0 AS DOUBLE) END)"


ROUGE_L = f1_sql("lcs", "np", "nr")
rouge_n_sql = lambda n: f"round_even({f1_sql(f'k{n}', f'(np - {n - 1})', f'(nr - {n - 1})')}, 4)"
TOKEN_F1 = f1_sql("k1", "np", "nr")


def bleu_sql(n: int) -> str:
    cond = " OR ".join(f"k{i} = 0 OR np < {i}" for i in range(1, n + 1))
    logs = " + ".join(f"ln(CAST(k{i} AS DOUBLE) / (np - {i - 1})) / {i}" for i in range(1, n + 1))
    return (
        f"(CASE WHEN np = 0 OR nr = 0 OR {cond} THEN CAST(0 AS DOUBLE) ELSE "
        f"round_even(LEAST(CAST(1 AS DOUBLE), exp(1 - CAST(nr AS DOUBLE) / np)) * exp({logs}), 4) END)"
    )


CIDER = "LEAST(CAST(1 AS DOUBLE), " + " + ".join(
    f"{w} * {f1_sql(f'k{n}', f'(np - {n - 1})', f'(nr - {n - 1})')}" for n, w in enumerate(fixed.CIDER_WEIGHTS, 1)
) + ")"

T2_VIEWS = overlap_views("a_pairs", "conv_id, turn", "pred_text", "ref_text", space_tokens_sql, "s")
T1_VIEWS = overlap_views("a_pairs", "conv_id, turn", "pred_text", "ref_text", word_tokens_sql, "w")


def pair_query(name: str, columns, sql: dict, tokens, views: dict, orders=(1, 2, 3, 4), lcs=True):
    """Register a text measure over all conversation pairs."""
    prefix = "s" if tokens is T.space_tokens else "w"
    body = ", ".join(f"{v} AS {k}" for k, v in sql.items())

    @query(name, with_views("a_pairs", f"SELECT conv_id, turn, {body} FROM {prefix}ov", **views))
    def _(spark, sf):
        df = T.with_overlap(t.pairs(spark, sf), F.col("pred_text"), F.col("ref_text"), tokens, "_", orders, lcs)
        return df.select(*TURN, *[c.alias(k) for k, c in columns().items()])


@query("reference_text", with_views("a_results", """
SELECT ordinal, CASE ordinal % 5 WHEN 0 THEN 'label ' || ordinal WHEN 1 THEN '' WHEN 2 THEN 'own' WHEN 3 THEN 'prior' ELSE 'plain' END AS text FROM a_results"""))
def _(spark, sf):
    o = F.col("ordinal") % 5
    label = F.when(o == 0, F.concat(F.lit("label "), F.col("ordinal").cast("string"))).when(o == 1, "")
    text = T.reference_text(label, F.when(o <= 2, "own").otherwise(""), F.when(o == 3, "prior"), F.lit("plain"))
    return t.results(spark, sf).select("ordinal", text.alias("text"))


pair_query("rouge_l_v1", lambda: {"score": F.bround(T.rouge_l("_"), 9)}, {"score": f"round_even({ROUGE_L}, 9)"}, T.word_tokens, T1_VIEWS, ())
pair_query("rouge_l_v2", lambda: {"score": F.bround(T.rouge_l("_"), 9)}, {"score": f"round_even({ROUGE_L}, 9)"}, T.space_tokens, T2_VIEWS, ())
pair_query("rouge_n", lambda: {f"rouge_{n}": T.rouge_n("_", n) for n in (1, 2)}, {f"rouge_{n}": rouge_n_sql(n) for n in (1, 2)},
           T.space_tokens, overlap_views("a_pairs", "conv_id, turn", "pred_text", "ref_text", space_tokens_sql, "s", (1, 2), False), (1, 2), False)
_BAG2 = overlap_views("a_pairs", "conv_id, turn", "pred_text", "ref_text", space_tokens_sql, "s", lcs=False)
_BAG1 = overlap_views("a_pairs", "conv_id, turn", "pred_text", "ref_text", word_tokens_sql, "w", lcs=False)
pair_query("bleu", lambda: {f"bleu_{n}": T.bleu("_", n) for n in range(1, 5)}, {f"bleu_{n}": bleu_sql(n) for n in range(1, 5)}, T.space_tokens, _BAG2, lcs=False)
pair_query("token_f1_v2", lambda: {"score": T.token_f1_rounded("_")},
           {"score": f"CASE WHEN np = 0 AND nr = 0 THEN 1 ELSE round_even({TOKEN_F1}, 4) END"}, T.space_tokens, _BAG2, (1,), False)
pair_query("token_f1_v1", lambda: {"score": F.bround(T.token_f1("_"), 9)}, {"score": f"round_even({TOKEN_F1}, 9)"}, T.word_tokens, _BAG1, (1,), False)
pair_query("cider_like", lambda: {"score": F.bround(T.cider_like("_"), 9)}, {"score": f"round_even({CIDER}, 9)"}, T.word_tokens, _BAG1, lcs=False)


@query("length_reward", f"""
SELECT conv_id, turn, CASE WHEN n BETWEEN 4 AND 16 THEN CAST(1 AS DOUBLE) WHEN n BETWEEN 1 AND 20 THEN 0.5 ELSE 0 END AS score
FROM (SELECT conv_id, turn, len({word_tokens_sql('text')}) AS n FROM conversations)""")
def _(spark, sf):
    return t.table(spark, sf, "conversations").select(*TURN, T.length_reward(F.size(T.word_tokens(F.col("text")))).alias("score"))


INSTR_SQL = {
    "rouge_1": rouge_n_sql(1), "rouge_2": rouge_n_sql(2), "rouge_l": f"round_even({ROUGE_L}, 4)",
    **{f"bleu_{n}": bleu_sql(n) for n in range(1, 5)}, "token_f1": f"round_even({TOKEN_F1}, 4)",
    "semantic_similarity": f"round_even({ROUGE_L}, 4)", "bertscore_f1": f"round_even({ROUGE_L}, 4)",
}


@query("instruction_metrics", with_views(
    "a_pairs", f"SELECT conv_id, turn, {', '.join(f'CASE WHEN np = 0 OR nr = 0 THEN 0 ELSE {v} END AS {k}' for k, v in INSTR_SQL.items())} FROM sov", **T2_VIEWS))
def _(spark, sf):
    df = T.instruction_metrics(t.pairs(spark, sf), F.col("pred_text"), F.col("ref_text"))
    return df.select(*TURN, *INSTR_SQL)


_VECPAIRS = """
SELECT a.vec_id, a.embedding AS a, b.embedding AS b, CASE WHEN a.vec_id % 7 = 0 THEN ' Same' ELSE 'x' || a.vec_id END AS pred,
  CASE WHEN a.vec_id % 7 = 0 THEN 'same ' WHEN a.vec_id % 11 = 0 THEN ' ' ELSE 'y' END AS ref
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
_DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))"


def _vector_pairs(spark, sf):
    v = F.col("vec_id")
    emb = t.table(spark, sf, "embeddings")
    after = emb.select((v - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return emb.select("vec_id", F.col("embedding").alias("a")).join(after, "vec_id", "left").withColumns({
        "pred": F.when(v % 7 == 0, " Same").otherwise(F.concat(F.lit("x"), v.cast("string"))),
        "ref": F.when(v % 7 == 0, "same ").when(v % 11 == 0, " ").otherwise("y"),
    })


@query("embed_similarity", f"""WITH vp AS ({_VECPAIRS})
SELECT vec_id, round_even(CASE WHEN trim(ref) = '' THEN 0 WHEN lower(trim(pred)) = lower(trim(ref)) THEN 1 ELSE greatest(0, least(1, {_DOT})) END, 6) AS score FROM vp WHERE b IS NOT NULL""")
def _(spark, sf):
    pairs = _vector_pairs(spark, sf).where(F.col("b").isNotNull())
    score = T.embed_similarity(F.col("a"), F.col("b"), F.col("pred"), F.col("ref"))
    return pairs.select("vec_id", F.bround(score, 6).alias("score"))


@query("clip_similarity", f"""WITH vp AS ({_VECPAIRS})
SELECT vec_id, round_even(CASE WHEN b IS NULL THEN 0 ELSE greatest(0, least(1, ({_DOT} + 1) / 2)) END, 6) AS score FROM vp""")
def _(spark, sf):
    return _vector_pairs(spark, sf).select("vec_id", F.bround(T.clip_similarity(F.col("a"), F.col("b")), 6).alias("score"))


# --- structured fields ----------------------------------------------------------

_FIELDS = """
SELECT r.*, g.next_action AS gt_action, g.acceptable_actions, g.lane_change_required AS gt_change, g.lanes_count AS gt_lanes, g.maneuver,
  g.relevant_landmarks AS gt_landmarks, g.potential_hazards AS gt_hazards, g.instruction AS gt_text FROM a_results r JOIN a_gt g USING (sample_id)"""


def _fields(spark, sf):
    gt = t.ground_truth(spark, sf).select(
        "sample_id", F.col("next_action").alias("gt_action"), "acceptable_actions", F.col("lane_change_required").alias("gt_change"),
        F.col("lanes_count").alias("gt_lanes"), "maneuver", F.col("relevant_landmarks").alias("gt_landmarks"),
        F.col("potential_hazards").alias("gt_hazards"), F.col("instruction").alias("gt_text"))
    return t.results(spark, sf).join(gt, "sample_id").withColumn("pred_change", N.lane_change_flag(F.col("lane_change_required")))


_GROUPS = {a: g for g, xs in fixed.ACTION_GROUPS.items() for a in xs}
_FAMILIES = {a: g for g, xs in fixed.ACTION_FAMILIES.items() for a in xs}
def action_sql(p: str, g: str, acc: str) -> str:
    accepted = f"COALESCE(list_contains(list_transform({acc}, lambda x: trim(lower(x))), {p}), FALSE)"
    return f"CASE WHEN {p} = {g} OR {accepted} THEN CAST(1 AS DOUBLE) WHEN {case_of(p, _GROUPS)} = {case_of(g, _GROUPS)} THEN 0.75 ELSE 0 END"


def strict_sql(p: str, g: str, acc: str) -> str:
    return f"CASE WHEN {p} = {g} OR COALESCE(list_contains(list_transform({acc}, lambda x: trim(lower(x))), {p}), FALSE) THEN CAST(1 AS DOUBLE) ELSE 0 END"


CHANGE_SQL = "CASE WHEN {g} IS NULL THEN NULL WHEN COALESCE({p} = {g}, FALSE) THEN CAST(1 AS DOUBLE) ELSE 0 END"
LANES_SQL = "CASE WHEN {g} IS NULL THEN NULL WHEN abs({p} - {g}) = 0 THEN CAST(1 AS DOUBLE) WHEN abs({p} - {g}) = 1 THEN 0.5 ELSE 0 END"


def field_query(name: str, columns, sql: dict):
    body = ", ".join(f"{v} AS {k}" for k, v in sql.items())

    @query(name, with_views("a_results a_gt", f"SELECT ordinal, {body} FROM fields", fields=_FIELDS))
    def _(spark, sf):
        return _fields(spark, sf).select("ordinal", *[c.alias(k) for k, c in columns().items()])


C = F.col
field_query("score_action", lambda: {"score": S.score_action(C("next_action"), C("gt_action"), C("acceptable_actions"))},
            {"score": action_sql("next_action", "gt_action", "acceptable_actions")})
field_query("score_action_strict", lambda: {"score": S.score_action_strict(C("next_action"), C("gt_action"), C("acceptable_actions"))},
            {"score": strict_sql("next_action", "gt_action", "acceptable_actions")})
EXPECTED = case_of("trim(upper(maneuver))", fixed.ACTION_BY_MANEUVER, "replace(lower(trim(maneuver)), ' ', '_')")
REWARD = f"""CASE WHEN next_action = '' OR {EXPECTED} = '' THEN CAST(0 AS DOUBLE) WHEN next_action = {EXPECTED} THEN 1
  WHEN {case_of('next_action', _FAMILIES)} = {case_of(EXPECTED, _FAMILIES)} THEN 0.5 ELSE 0 END"""
field_query("action_reward", lambda: {"score": S.action_reward(C("next_action"), C("maneuver"))}, {"score": REWARD})
field_query("score_lane_change", lambda: {"score": S.score_lane_change(C("pred_change"), C("gt_change"))},
            {"score": CHANGE_SQL.format(p="(lane_change_required = 'yes')", g="gt_change")})
field_query("score_lanes", lambda: {
    "score": S.score_lanes(C("lanes_count"), C("gt_lanes")), "exact": S.lanes_exact(C("lanes_count"), C("gt_lanes")),
    "abs_err": S.lanes_abs_err(C("lanes_count"), C("gt_lanes")),
}, {
    "score": LANES_SQL.format(p="lanes_count", g="gt_lanes"), "exact": CHANGE_SQL.format(p="lanes_count", g="gt_lanes"),
    "abs_err": "CAST(abs(lanes_count - gt_lanes) AS DOUBLE)",
})
LANE_REWARD = """greatest(0, least(CAST(1 AS DOUBLE), CASE WHEN COALESCE(lane_change_required, '') NOT IN ('yes', 'no') THEN CAST(0 AS DOUBLE) WHEN ordinal % 8 = 0 THEN 0.5
  WHEN lane_change_required = CASE WHEN gt_change IS NULL THEN 'none' WHEN gt_change THEN 'yes' ELSE 'no' END THEN 0.6 ELSE 0.2 END
  + CASE WHEN COALESCE(lanes_count NOT BETWEEN 1 AND 8, TRUE) THEN CAST(0 AS DOUBLE) WHEN gt_lanes IS NULL THEN 0.5 WHEN lanes_count = gt_lanes THEN 0.4
    WHEN abs(lanes_count - gt_lanes) = 1 THEN 0.2 ELSE 0 END))"""
def _label_change():
    return F.when(C("gt_change"), "Yes").when(~C("gt_change"), " no")



field_query("lane_reward", lambda: {"score": S.lane_reward(C("lane_change_required"), C("lanes_count"), C("ordinal") % 8 != 0, _label_change(), C("gt_lanes"))},
            {"score": LANE_REWARD})
field_query("latency_reward", lambda: {"score": S.latency_reward(F.when(C("ordinal") % 9 != 0, C("latency_ms")))},
            {"score": "CASE WHEN ordinal % 9 = 0 THEN CAST(0 AS DOUBLE) WHEN latency_ms < 5000 THEN 1 WHEN latency_ms < 10000 THEN 0.8 WHEN latency_ms < 15000 THEN 0.6 WHEN latency_ms < 20000 THEN 0.4 WHEN latency_ms < 25000 THEN 0.2 ELSE 0 END"})
field_query("match_flags", lambda: S.match_flags(C("next_action"), C("gt_action"), C("acceptable_actions"), C("lane_change_required"), C("gt_change")), {
    "action_match": "next_action = gt_action OR COALESCE(list_contains(acceptable_actions, next_action), FALSE)",
    "lane_change_match": "COALESCE((lower(COALESCE(lane_change_required, 'null')) = 'yes') = gt_change, TRUE)",
})

_SETS = """
SELECT conv_id, turn, list_transform(string_split(pred_text, '.'), lambda s: trim(lower(s), chr(10) || ' ')) AS p,
  list_transform(string_split(ref_text, '.'), lambda s: trim(lower(s), chr(10) || ' ')) AS r FROM a_pairs"""


@query("set_jaccard", with_views("a_pairs", """
SELECT conv_id, turn, len(list_intersect(p, r)) / CAST(len(list_distinct(list_concat(p, r))) AS DOUBLE) AS score FROM sets""", sets=_SETS))
def _(spark, sf):
    items = lambda c: F.split(c, "\\.")
    return t.pairs(spark, sf).select(*TURN, S.set_jaccard(items("pred_text"), items("ref_text")).alias("score"))


def prf_sql(hits: str, n: str, m: str) -> str:
    p, r = f"CAST({hits} AS DOUBLE) / {n}", f"CAST({hits} AS DOUBLE) / {m}"
    return f"""CASE WHEN {n} = 0 AND {m} = 0 THEN CAST(1 AS DOUBLE) WHEN {n} = 0 THEN 1 WHEN {m} = 0 THEN 0 ELSE round_even({p}, 4) END AS precision,
  CASE WHEN {n} = 0 AND {m} = 0 THEN CAST(1 AS DOUBLE) WHEN {n} = 0 THEN 0 WHEN {m} = 0 THEN 1 ELSE round_even({r}, 4) END AS recall,
  CASE WHEN {n} = 0 AND {m} = 0 THEN CAST(1 AS DOUBLE) WHEN {n} = 0 OR {m} = 0 OR {hits} = 0 THEN 0 ELSE round_even(2 * ({p}) * ({r}) / ({p} + {r}), 4) END AS f1"""


@query("set_prf_exact", with_views("a_pairs", f"SELECT conv_id, turn, {prf_sql('h', 'n', 'm')} FROM (SELECT conv_id, turn, len(p) AS n, len(r) AS m, len(list_intersect(p, r)) AS h FROM words)",
    words=f"SELECT conv_id, turn, {space_tokens_sql('pred_text')} AS p, {space_tokens_sql('ref_text')} AS r FROM a_pairs"))
def _(spark, sf):
    parts = S.set_prf_exact(T.space_tokens(C("pred_text")), T.space_tokens(C("ref_text")))
    return t.pairs(spark, sf).select(*TURN, *[c.alias(k) for k, c in parts.items()])


def fuzzy_sql(source: str, key: str, pred: str, gt: str) -> str:
    """Distinct GT items that are the best token-Jaccard match (>= 0.5) of a predicted item."""
    clean = lambda c: f"list_filter(list_transform(COALESCE({c}, []), lambda s: trim(lower(s))), lambda s: s <> '')"
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
    return f"""SELECT {key}, len(any_value(p)) AS n, len(any_value(r)) AS m, COUNT(DISTINCT best) AS h FROM (
  SELECT {key}, p, r, pi, CASE WHEN max(sim) >= 0.5 THEN r[arg_max(j, sim * 1000000 - j)] END AS best FROM (
    SELECT {key}, p, r, pi, j, CASE WHEN j IS NOT NULL THEN len(list_intersect({words('p[pi]')}, {words('r[j]')})) / CAST(len(list_distinct(list_concat({words('p[pi]')}, {words('r[j]')}))) AS DOUBLE) END AS sim
    FROM (SELECT {key}, {clean(pred)} AS p, {clean(gt)} AS r FROM {source})
    LEFT JOIN LATERAL (SELECT UNNEST(range(1, len(p) + 1)) AS pi) ON TRUE LEFT JOIN LATERAL (SELECT UNNEST(range(1, len(r) + 1)) AS j) ON TRUE) GROUP BY {key}, p, r, pi) GROUP BY {key}"""


@query("set_prf_fuzzy", with_views("a_results a_gt", f"SELECT ordinal, {prf_sql('h', 'n', 'm')} FROM ({fuzzy_sql('fields', 'ordinal', 'relevant_landmarks', 'gt_landmarks')})", fields=_FIELDS))
def _(spark, sf):
    parts = S.set_prf_fuzzy(C("relevant_landmarks"), C("gt_landmarks"))
    return _fields(spark, sf).select("ordinal", *[c.alias(k) for k, c in parts.items()])


def _answer_keys():
    o = C("ordinal")
    raw = (
        F.when(o % 3 == 0, '{"enhanced_instruction": null, "lane_change_required": 1, "next_action": ""}')
        .when(o % 3 == 1, '{"enhanced_instruction": "x", "next_action": "y"}').otherwise('{"next_action": "y"}')
    )
    return F.json_object_keys(raw)


FORMAT_SQL = "CASE ordinal % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN 0.5 ELSE 0 END"


@query("format_reward", with_views("a_results", f"SELECT ordinal, {FORMAT_SQL} AS score FROM a_results"))
def _(spark, sf):
    return t.results(spark, sf).select("ordinal", S.format_reward(_answer_keys()).alias("score"))


# --- composites -----------------------------------------------------------------

REWARD_NAMES = list(fixed.COMPOSITE_WEIGHTS_V2)
_COMPOSITE_SOURCE = """
SELECT f.*, COALESCE(enhanced_instruction, '') AS pred_text, gt_text AS ref_text, a.embedding AS a, b.embedding AS b
FROM fields f LEFT JOIN embeddings a ON a.vec_id = f.sample_id LEFT JOIN embeddings b ON b.vec_id = f.sample_id + 1"""
_REWARDS_SQL = {
    "action_reward": REWARD, "lane_reward": LANE_REWARD, "format_reward": FORMAT_SQL,
    "length_reward": "CASE WHEN np BETWEEN 4 AND 16 THEN CAST(1 AS DOUBLE) WHEN np BETWEEN 1 AND 20 THEN 0.5 ELSE 0 END",
    "bertscore_reward": TOKEN_F1,
    "clipscore_reward": f"CASE WHEN a IS NULL OR b IS NULL THEN CAST(0 AS DOUBLE) ELSE greatest(0, least(1, ({_DOT} + 1) / 2)) END",
    "cider_reward": CIDER, "rouge_l_reward": ROUGE_L,
    "latency_reward": "CASE WHEN latency_ms < 5000 THEN CAST(1 AS DOUBLE) WHEN latency_ms < 10000 THEN 0.8 WHEN latency_ms < 15000 THEN 0.6 WHEN latency_ms < 20000 THEN 0.4 WHEN latency_ms < 25000 THEN 0.2 ELSE 0 END",
}


def composite_views(weights: dict) -> dict[str, str]:
    rewards = ", ".join(f"{v} AS {k}" for k, v in _REWARDS_SQL.items())
    total = " + ".join(f"{w} * {k}" for k, w in weights.items())
    return {
        "fields": _FIELDS, "src": _COMPOSITE_SOURCE,
        **overlap_views("src", "ordinal", "pred_text", "ref_text", word_tokens_sql, "w"),
        "rewards": f"SELECT ordinal, sample_id, {rewards} FROM wov",
        "composed": f"SELECT *, round_even(greatest(0, least(1, {total})), 6) AS composite_score FROM rewards",
    }


def composite_rows(spark, sf, with_latency=False):
    emb = t.table(spark, sf, "embeddings")
    clip = lambda shift, name: emb.select((C("vec_id") - shift).alias("sample_id"), C("embedding").alias(name))
    paired = _fields(spark, sf).join(clip(0, "clip_text"), "sample_id", "left").join(clip(1, "clip_image"), "sample_id", "left")
    paired = paired.withColumns({
        "response": F.lit(None).cast("string"), "label_maneuver": C("maneuver"), "label_has_change": C("ordinal") % 8 != 0,
        "label_lane_change": _label_change(), "label_lanes_count": C("gt_lanes"), "answer_keys": _answer_keys(),
    }).withColumns({"pred_text": evaluation.pred_text(), "ref_text": T.reference_text(F.lit(None).cast("string"), C("gt_text"), F.lit(None).cast("string"), F.lit(None).cast("string"))})
    return evaluation.composite_rewards(paired, ["ordinal", "sample_id"], with_latency)


@query("composite_v1", with_views("a_results a_gt", "SELECT ordinal, round_even(cider_reward, 6) AS cider_reward, round_even(clipscore_reward, 6) AS clipscore_reward, composite_score FROM composed", **composite_views(fixed.COMPOSITE_WEIGHTS_V1)))
def _(spark, sf):
    return composite_rows(spark, sf).select(
        "ordinal", F.bround("cider_reward", 6).alias("cider_reward"), F.bround("clipscore_reward", 6).alias("clipscore_reward"), "composite_score")


@query("composite_v2", with_views("a_results a_gt", "SELECT ordinal, latency_reward, composite_score FROM composed", **composite_views(fixed.COMPOSITE_WEIGHTS_V2)))
def _(spark, sf):
    return composite_rows(spark, sf, True).select("ordinal", "latency_reward", "composite_score")


@query("composite_means", with_views("a_results a_gt", f"SELECT COUNT(*) AS matched_samples, {', '.join(f'round_even(AVG({k}), 6) AS {k}' for k in [*REWARD_NAMES, 'composite_score'])} FROM composed", **composite_views(fixed.COMPOSITE_WEIGHTS_V2)))
def _(spark, sf):
    return evaluation.composite_means(composite_rows(spark, sf, True), [*REWARD_NAMES, "composite_score"])


@query("composite_eval", with_views("a_results a_gt", f"""
SELECT (SELECT COUNT(*) FROM a_results) AS total_predictions, COUNT(*) AS matched_samples, (SELECT COUNT(*) FROM a_results) - COUNT(*) AS unmatched_samples,
  {', '.join(f'round_even(AVG({k}), 6) AS {k}' for k in [*fixed.COMPOSITE_WEIGHTS_V1, 'composite_score'])} FROM composed""", **composite_views(fixed.COMPOSITE_WEIGHTS_V1)))
def _(spark, sf):
    names = [*fixed.COMPOSITE_WEIGHTS_V1, "composite_score"]
    means = evaluation.composite_means(composite_rows(spark, sf), names)
    counts = joins.match_counts(t.results(spark, sf), t.ground_truth(spark, sf))
    both = counts.select(F.struct("total_predictions", "unmatched_samples").alias("s")).scalar()
    of = lambda c: both.getField(c).alias(c)
    return means.select(of("total_predictions"), "matched_samples", of("unmatched_samples"), *names)


# --- field scores end to end ------------------------------------------------------

_S = {
    "next_action": action_sql("a_pred", "a_gt_", "acceptable_actions"),
    "lane_change_required": CHANGE_SQL.format(p="(lane_change_required = 'yes')", g="(CASE WHEN gt_lane_change_required IS NOT NULL THEN gt_lane_change_required = 'yes' END)"),
    "lanes_count": LANES_SQL.format(p="lanes_count", g="gt_lanes_count"),
    "relevant_landmarks": "CASE WHEN len(lu) = 0 THEN CAST(1 AS DOUBLE) ELSE len(li) / CAST(len(lu) AS DOUBLE) END",
    "potential_hazards": "CASE WHEN len(hu) = 0 THEN CAST(1 AS DOUBLE) ELSE len(hi) / CAST(len(hu) AS DOUBLE) END",
    "enhanced_instruction": ROUGE_L,
    "semantic_similarity": ROUGE_L,
    "next_action_strict": strict_sql("a_pred", "a_gt_", "acceptable_actions"),
    "lanes_count_exact": CHANGE_SQL.format(p="lanes_count", g="gt_lanes_count"),
    "lanes_count_abs_err": "CAST(abs(lanes_count - gt_lanes_count) AS DOUBLE)",
    **{k: INSTR_SQL[k] for k in ("rouge_1", "rouge_2", "rouge_l", "bleu_1", "bleu_2", "bleu_3", "bleu_4", "token_f1", "bertscore_f1")},
}
_clean = lambda c: f"list_transform(COALESCE({c}, []), lambda s: trim(lower(s)))"
SCORE_VIEWS = {
    "first_res": FIRST, "paired": PAIRED,
    "src": f"""SELECT *, COALESCE(enhanced_instruction, '') AS pred_text, COALESCE(gt_enhanced_instruction, '') AS ref_text, COALESCE(next_action, '') AS a_pred, COALESCE(gt_next_action, '') AS a_gt_,
  list_intersect({_clean('relevant_landmarks')}, {_clean('gt_relevant_landmarks')}) AS li, list_distinct(list_concat({_clean('relevant_landmarks')}, {_clean('gt_relevant_landmarks')})) AS lu,
  list_intersect({_clean('potential_hazards')}, {_clean('gt_potential_hazards')}) AS hi, list_distinct(list_concat({_clean('potential_hazards')}, {_clean('gt_potential_hazards')})) AS hu FROM paired""",
    **overlap_views("src", "ordinal", "pred_text", "ref_text", space_tokens_sql, "s"),
    "raw_scores": f"SELECT ordinal, sample_id, model_id, gt_model, {', '.join(f'{v} AS {k}' for k, v in _S.items())} FROM sov",
    "lmf": "SELECT ordinal, " + prf_sql("h", "n", "m") + " FROM (" + fuzzy_sql("paired", "ordinal", "relevant_landmarks", "gt_relevant_landmarks") + ")",
    "hzf": "SELECT ordinal, " + prf_sql("h", "n", "m") + " FROM (" + fuzzy_sql("paired", "ordinal", "potential_hazards", "gt_potential_hazards") + ")",
    "scores": "SELECT sample_id, model_id, gt_model, " + ", ".join(f"round_even({k}, 4) AS {k}" for k in _S) + ", "
    + ", ".join(f"{v}.{p} AS {n}_{p}" for v, n in (("lmf", "landmark"), ("hzf", "hazard")) for p in ("precision", "recall", "f1"))
    + ", round_even((" + " + ".join(f"COALESCE({k} * {w}, 0)" for k, w in fixed.TOTAL_WEIGHTS.items()) + ") / ("
    + " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w} END" for k, w in fixed.TOTAL_WEIGHTS.items()) + "), 4) AS total FROM raw_scores JOIN lmf USING (ordinal) JOIN hzf USING (ordinal)",
}
SCORE_COLUMNS = ["sample_id", "model_id", "gt_model", *_S, *[f"{n}_{p}" for n in ("landmark", "hazard") for p in ("precision", "recall", "f1")], "total"]
SUMMARY = f"SELECT model_id, COUNT(*) AS n, {', '.join(f'round_even(AVG({k}), 6) AS {k}' for k in fixed.SUMMARY_FIELDS)} FROM scores GROUP BY model_id"


def _scores(spark, sf):
    return evaluation.metric_eval(t.results(spark, sf), t.ground_truth(spark, sf))


@query("score_result", with_views("a_results a_gt", f"SELECT {', '.join(SCORE_COLUMNS)} FROM scores", **SCORE_VIEWS))
def _(spark, sf):
    return _scores(spark, sf).select(*SCORE_COLUMNS)


@query("weighted_total", with_views("a_results a_gt", "SELECT sample_id, model_id, total FROM scores", **SCORE_VIEWS))
def _(spark, sf):
    return _scores(spark, sf).select("sample_id", "model_id", "total")


@query("metric_eval", with_views("a_results a_gt", SUMMARY, **SCORE_VIEWS))
def _(spark, sf):
    return evaluation.model_summary(_scores(spark, sf))


@query("model_summary", with_views("a_results a_gt", SUMMARY, **SCORE_VIEWS))
def _(spark, sf):
    return evaluation.model_summary(_scores(spark, sf))


@query("sort_model_total", with_views("a_results a_gt", "SELECT model_id, row_number() OVER (ORDER BY total DESC, model_id) AS place, total FROM (" + SUMMARY + ")", **SCORE_VIEWS))
def _(spark, sf):
    from wayline.operators.ordered import dense_ordinal

    best = evaluation.model_summary(_scores(spark, sf)).select("model_id", "total").withColumn("_down", -C("total"))
    return dense_ordinal(best, ["_down", "model_id"], "place").select("model_id", "place", "total")


_BOARD = ", ".join(
    f"round_even(AVG(CASE WHEN modality = '{m}' THEN {v} END), 3) AS {s}{x}"
    for m, s in reports.MODALITY_SHORT.items() for x, v in (("", "text_score"), ("_act", "action"), ("_lc", "lane_change"), ("_ln", "lanes"))
)


@query("leaderboard_pivot", with_views("a_results a_gt", f"SELECT model_id, {_BOARD}, round_even(AVG(latency_ms / CAST(1000 AS DOUBLE)), 1) AS lat, round_even(AVG(np), 1) AS len FROM board GROUP BY model_id",
    fields=_FIELDS, src="SELECT *, COALESCE(enhanced_instruction, '') AS pred_text, gt_text AS ref_text FROM fields",
    **overlap_views("src", "ordinal", "pred_text", "ref_text", space_tokens_sql, "s"),
    board=f"SELECT *, {ROUGE_L} AS text_score, {action_sql('next_action', 'gt_action', 'acceptable_actions')} AS action, {CHANGE_SQL.format(p=chr(40) + 'lane_change_required = ' + chr(39) + 'yes' + chr(39) + chr(41), g='gt_change')} AS lane_change, {LANES_SQL.format(p='lanes_count', g='gt_lanes')} AS lanes FROM sov"))
def _(spark, sf):
    df = T.with_overlap(_fields(spark, sf), F.coalesce("enhanced_instruction", F.lit("")), C("gt_text"), T.space_tokens, "_s", ())
    scored = df.select(
        "model_id", "modality", "latency_ms", C("_snp").alias("words"), T.rouge_l("_s").alias("text_score"),
        S.score_action(C("next_action"), C("gt_action"), C("acceptable_actions")).alias("action"),
        S.score_lane_change(C("pred_change"), C("gt_change")).alias("lane_change"), S.score_lanes(C("lanes_count"), C("gt_lanes")).alias("lanes"))
    return reports.leaderboard(scored)


# --- agreement --------------------------------------------------------------------

_XY = "SELECT ordinal, round_even(confidence, 2) AS x, CAST(latency_ms % 40 + lanes_count * 3 AS DOUBLE) AS y FROM a_results WHERE lanes_count IS NOT NULL"
_RANKS = """SELECT *, rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / CAST(2 AS DOUBLE) AS rx,
  rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / CAST(2 AS DOUBLE) AS ry FROM xy"""
_TAU = """SELECT COUNT(*) FILTER (WHERE (a.x - b.x) * (a.y - b.y) > 0) AS c, COUNT(*) FILTER (WHERE (a.x - b.x) * (a.y - b.y) < 0) AS d,
  COUNT(*) FILTER (WHERE a.x = b.x AND a.y <> b.y) AS tx, COUNT(*) FILTER (WHERE a.x <> b.x AND a.y = b.y) AS ty FROM xy a JOIN xy b ON a.ordinal < b.ordinal"""
TAU = "round_even((c - d) / sqrt(CAST(c + d + tx AS DOUBLE) * CAST(c + d + ty AS DOUBLE)), 6)"


def _xy(spark, sf):
    return t.results(spark, sf).where(C("lanes_count").isNotNull()).select(
        "ordinal", F.bround("confidence", 2).alias("x"), (C("latency_ms") % 40 + C("lanes_count") * 3).cast("double").alias("y"))


@query("avg_rank", with_views("a_results", "SELECT ordinal, x, rx AS rank FROM ranks", xy=_XY, ranks=_RANKS))
def _(spark, sf):
    return agreement.average_ranks(_xy(spark, sf).select("ordinal", "x"), "x").select("ordinal", "x", "rank")


@query("pearson", with_views("a_results", "SELECT round_even(corr(x, y), 6) AS pearson, CAST(0 AS DOUBLE) AS flat FROM xy", xy=_XY))
def _(spark, sf):
    rows = _xy(spark, sf).withColumn("one", F.lit(1.0))
    return rows.agg(F.bround(agreement.pearson(rows, "x", "y"), 6).alias("pearson"), agreement.pearson(rows, "x", "one").alias("flat"))


@query("spearman", with_views("a_results", "SELECT COUNT(*) AS n, round_even(corr(rx, ry), 6) AS spearman FROM ranks", xy=_XY, ranks=_RANKS))
def _(spark, sf):
    return agreement.spearman(_xy(spark, sf), "x", "y")


@query("kendall_tau", with_views("a_results", f"SELECT (SELECT COUNT(*) FROM xy) AS n, {TAU} AS kendall FROM tau", xy=_XY, tau=_TAU))
def _(spark, sf):
    return agreement.kendall(_xy(spark, sf), "x", "y")


def _judged(spark, sf):
    """Judge answers: one per sample, with a ranking of prediction and reference."""
    s = C("sample_id")
    rank = lambda name, score: F.struct(F.lit(name).alias("model"), score.cast("double").alias("total_score"))
    return t.samples(spark, sf).select(
        "sample_id", F.when(s % 13 == 0, "timeout").alias("error"),
        F.array(rank("prediction", s % 17 + C("n_chars") % 5), rank("reference", s % 19)).alias("rankings"))


@query("ranking_rows", with_views("a_samples", """
SELECT sample_id, 'prediction' AS model, CAST(sample_id % 17 + n_chars % 5 AS DOUBLE) AS total_score FROM a_samples WHERE sample_id % 13 <> 0
UNION ALL SELECT sample_id, 'reference', sample_id % 19 FROM a_samples WHERE sample_id % 13 <> 0"""))
def _(spark, sf):
    return pairwise.ranking_rows(_judged(spark, sf))


@query("ranking_counts", with_views("a_samples", """
SELECT COUNT(*) AS judged, COUNT(*) FILTER (WHERE sample_id % 13 <> 0) AS successful, COUNT(*) FILTER (WHERE sample_id % 13 = 0) AS failed FROM a_samples"""))
def _(spark, sf):
    return pairwise.ranking_counts(_judged(spark, sf))


@query("judge_calibration", with_views("a_results a_gt a_samples", f"""
SELECT (SELECT COUNT(*) FROM xy) AS successful_judged, (SELECT round_even(corr(rx, ry), 6) FROM ranks) AS spearman, {TAU} AS kendall,
  (SELECT round_even(corr(rx, ry), 6) FROM ranks) < 0.35 AS needs_weight_refit FROM tau""", **composite_views(fixed.COMPOSITE_WEIGHTS_V1),
    xy="SELECT ordinal, composite_score AS x, CAST(sample_id % 17 + n_chars % 5 AS DOUBLE) AS y FROM composed JOIN a_samples USING (sample_id) WHERE sample_id % 13 <> 0", ranks=_RANKS, tau=_TAU))
def _(spark, sf):
    composite = composite_rows(spark, sf).select("sample_id", "composite_score")
    return agreement.calibration(composite, pairwise.ranking_rows(_judged(spark, sf)))


_MATRIX = """SELECT m, o, SUM(CASE WHEN w = m THEN 1 WHEN w IS NULL THEN 0.5 ELSE 0 END)::DOUBLE AS points, COUNT(*)::DOUBLE AS games FROM (
  SELECT model_a AS m, model_b AS o, majority_winner AS w FROM maj UNION ALL SELECT model_b, model_a, majority_winner FROM maj) GROUP BY ALL"""


def _rounds(n: int) -> dict[str, str]:
    """The fit as one view per round."""
    views = {"r0": "SELECT DISTINCT m, CAST(1 AS DOUBLE) AS s FROM mat"}
    for i in range(n):
        views[f"r{i + 1}"] = f"""SELECT m, s / exp(avg(ln(s)) OVER ()) AS s FROM (SELECT mat.m, (SUM(points) + 0.5) / (SUM(games / (a.s + b.s)) + 1 / (any_value(a.s) + 1)) AS s
FROM mat JOIN r{i} a ON a.m = mat.m JOIN r{i} b ON b.m = mat.o GROUP BY mat.m)"""
    return views


@query("pair_ratings", with_views("a_votes", "SELECT m AS model_id, round_even(1000 + 400 * log10(s), 3) AS rating FROM r24", maj=MAJORITY, mat=_MATRIX, **_rounds(24)).replace(" AS (SELECT m, s / exp", " AS MATERIALIZED (SELECT m, s / exp"))
def _(spark, sf):
    rated = pairwise.ratings(pairwise.majority(t.votes(spark, sf)))
    return rated.select("model_id", F.bround("rating", 3).alias("rating"))


# --- retrieval ----------------------------------------------------------------------

_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"


def _index(spark, sf):
    """Vectors written twice: the second version of a row replaces the first."""
    v = t.vectors(spark, sf).withColumn("maneuver", F.concat(F.lit("m"), C("maneuver").cast("string")))
    old = v.withColumns({"maneuver": F.lit("old"), "version": F.lit(1)})
    return retrieval.index_rows(old.unionByName(v.withColumn("version", F.lit(2))), "vec_id", "version")


def _query_vector(spark, sf):
    return t.vectors(spark, sf).where(C("vec_id") == 0).select("embedding").scalar()


@query("topk_similar", with_views("a_vectors", f"""
SELECT v.vec_id, 'm' || v.maneuver AS maneuver, round_even({_COS}, 6) AS score FROM a_vectors v, (SELECT embedding FROM a_vectors WHERE vec_id = 0) q ORDER BY {_COS} DESC, v.vec_id LIMIT 20"""))
def _(spark, sf):
    top = retrieval.top_similar(_index(spark, sf), _query_vector(spark, sf), 20)
    return top.select("vec_id", "maneuver", F.bround("score", 6).alias("score"))


@query("retrieve_diverse", with_views("a_vectors", f"""
SELECT vec_id, same AS same_maneuver, round_even(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY score DESC, vec_id) AS pos FROM (
  SELECT v.vec_id, v.maneuver = q.maneuver AS same, {_COS} AS score FROM a_vectors v, (SELECT embedding, maneuver FROM a_vectors WHERE vec_id = 0) q WHERE v.reward >= 0.3 ORDER BY score DESC, v.vec_id LIMIT 15))
ORDER BY CASE WHEN same AND pos <= 2 THEN 0 WHEN NOT same AND pos = 1 THEN 1 WHEN same THEN 2 ELSE 3 END, pos LIMIT 5"""))
def _(spark, sf):
    maneuver = t.vectors(spark, sf).where(C("vec_id") == 0).select(F.concat(F.lit("M"), C("maneuver").cast("string")).alias("m")).scalar()
    best = retrieval.diverse_examples(_index(spark, sf), _query_vector(spark, sf), maneuver, k=5, min_reward=0.3)
    return best.select("vec_id", "same_maneuver", F.bround("score", 6).alias("score"))
