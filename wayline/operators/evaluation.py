"""End-to-end scoring of model answers against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import normalize as N
from wayline.functions import scores as S
from wayline.functions import text as T
from wayline.functions.core import first_present, strip
from wayline.operators import joins


def score_rows(paired: DataFrame, keys: list[str], detailed: bool = True) -> DataFrame:
    """All field scores and the weighted total of answers next to their truth.

    Input columns are the answer fields and the same fields with ``gt_`` in
    front.  Null scores mean an open label and drop out of the total.
    """
    texts = paired.withColumns(
        {
            "_pred": strip(F.coalesce("enhanced_instruction", F.lit(""))),
            "_truth": strip(F.coalesce("gt_enhanced_instruction", F.lit(""))),
        }
    )
    items = (("relevant_landmarks", "landmark"), ("potential_hazards", "hazard")) if detailed else ()
    # counts first: precision, recall and F1 are arithmetic over the same three
    for field, short in items:
        counts = S.fuzzy_counts(F.col(field), F.col(f"gt_{field}"))
        texts = texts.withColumns({f"_{short}_{n}": c for n, c in counts.items()})
    base = T.instruction_metrics(texts, F.col("_pred"), F.col("_truth"), "_i")
    text_score = T.rouge_l("_i")
    change = lambda c: N.lane_change_flag(F.col(c))
    accept = F.col("acceptable_actions")
    scores = {
        "next_action": S.score_action(F.col("next_action"), F.col("gt_next_action"), accept),
        "lane_change_required": S.score_lane_change(change("lane_change_required"), change("gt_lane_change_required")),
        "lanes_count": S.score_lanes(F.col("lanes_count"), F.col("gt_lanes_count")),
        "relevant_landmarks": S.set_jaccard(F.col("relevant_landmarks"), F.col("gt_relevant_landmarks")),
        "potential_hazards": S.set_jaccard(F.col("potential_hazards"), F.col("gt_potential_hazards")),
        "enhanced_instruction": text_score,
        "semantic_similarity": text_score,
    }
    if detailed:
        scores |= {
            "next_action_strict": S.score_action_strict(F.col("next_action"), F.col("gt_next_action"), accept),
            "lanes_count_exact": S.lanes_exact(F.col("lanes_count"), F.col("gt_lanes_count")),
            "lanes_count_abs_err": S.lanes_abs_err(F.col("lanes_count"), F.col("gt_lanes_count")),
        }
        for name in ("rouge_1", "rouge_2", "rouge_l", "bleu_1", "bleu_2", "bleu_3", "bleu_4", "token_f1", "bertscore_f1"):
            scores[name] = F.col(name)
        for _, short in items:
            counted = [F.col(f"_{short}_{n}") for n in ("hits", "pred", "gt")]
            for part, value in S.set_prf(*counted).items():
                scores[f"{short}_{part}"] = value
    staged = base.select(
        *keys, *[v.alias(f"s_{k}") for k, v in scores.items()],
        change("lane_change_required").alias("lane_change_pred"),
        change("gt_lane_change_required").alias("lane_change_gt"),
    )
    total = S.weighted_total({k: F.col(f"s_{k}") for k in scores}, fixed.TOTAL_WEIGHTS)
    return staged.select(
        *keys, *[F.bround(f"s_{k}", 4).alias(k) for k in scores], total.alias("total"),
        "lane_change_pred", "lane_change_gt",
    )


def metric_eval(results: DataFrame, gt: DataFrame) -> DataFrame:
    """Scores per sample and model of all results against the manual labels."""
    paired = joins.results_with_gt(joins.first_results(results), gt)
    return score_rows(paired, ["sample_id", "model_id", "gt_model"])


def model_summary(scores: DataFrame) -> DataFrame:
    """Mean scores per model, best total first; null scores are left out."""
    return scores.groupBy("model_id").agg(
        F.count("*").alias("n"), *[F.bround(F.avg(f), 6).alias(f) for f in fixed.SUMMARY_FIELDS]
    ).orderBy(F.desc("total"), "model_id")


def composite_rewards(paired: DataFrame, keys: list[str], with_latency: bool = False) -> DataFrame:
    """All rewards and the composite score of predictions next to their labels.

    Expects pred_text and ref_text, the answer fields, ``label_*`` columns,
    ``answer_keys`` (keys present in the raw answer) and ``clip_text`` /
    ``clip_image`` vectors.  A row is few bytes and much work, so the rows are
    dealt by their keys, in a fixed number of parts that no size merges again.
    """
    parts = int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = paired.withColumn("_clip", T.clip_similarity(F.col("clip_text"), F.col("clip_image"))).drop("clip_text", "clip_image")
    df = T.with_overlap(seen.repartition(parts, *keys), F.col("pred_text"), F.col("ref_text"), T.word_tokens, "_w")
    rewards = {
        "action_reward": S.action_reward(F.col("next_action"), F.col("label_maneuver")),
        "lane_reward": S.lane_reward(
            F.col("lane_change_required"), F.col("lanes_count"), F.col("label_has_change"),
            F.col("label_lane_change"), F.col("label_lanes_count"),
        ),
        "format_reward": S.format_reward(F.col("answer_keys")),
        "length_reward": T.length_reward(F.col("_wnp")),
        "bertscore_reward": T.token_f1("_w"),
        "clipscore_reward": F.col("_clip"),
        "cider_reward": T.cider_like("_w"),
        "rouge_l_reward": T.rouge_l("_w"),
    }
    weights = fixed.COMPOSITE_WEIGHTS_V1
    if with_latency:
        rewards["latency_reward"] = S.latency_reward(F.col("latency_ms"))
        weights = fixed.COMPOSITE_WEIGHTS_V2
    staged = df.select(*keys, *[v.alias(k) for k, v in rewards.items()])
    return staged.withColumn("composite_score", S.composite(weights))


def composite_means(scored: DataFrame, rewards: list[str]) -> DataFrame:
    """Mean of every reward over the matched samples, 0 without any."""
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 6), F.lit(0.0)).alias(c)
    return scored.agg(F.count("*").alias("matched_samples"), *[mean(c) for c in rewards])


def pred_text() -> Column:
    return F.coalesce(first_present(F.col("enhanced_instruction"), F.col("response")), F.lit(""))
