"""Scores of structured answer fields and their weighted sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions.core import let, lookup, strip
from wayline.functions.normalize import expected_action


def _clean(col: Column) -> Column:
    return strip(F.lower(F.coalesce(col, F.lit(""))))


def _one(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def _accepted(pred: Column, acceptable: Column) -> Column:
    cleaned = F.transform(acceptable, lambda a: strip(F.lower(a)))
    return F.coalesce(F.array_contains(cleaned, pred), F.lit(False))


def score_action(pred: Column, gt: Column, acceptable: Column) -> Column:
    groups = {a: g for g, actions in fixed.ACTION_GROUPS.items() for a in actions}
    p, g = _clean(pred), _clean(gt)
    return (
        F.when((p == g) | _accepted(p, acceptable), F.lit(1.0))
        .when(lookup(groups, p) == lookup(groups, g), F.lit(0.75))
        .otherwise(F.lit(0.0))
    )


def score_action_strict(pred: Column, gt: Column, acceptable: Column) -> Column:
    p, g = _clean(pred), _clean(gt)
    return _one((p == g) | _accepted(p, acceptable))


def action_reward(pred: Column, maneuver: Column) -> Column:
    families = {a: f for f, actions in fixed.ACTION_FAMILIES.items() for a in actions}
    p, e = _clean(pred), expected_action(maneuver)
    return (
        F.when((p == "") | (e == ""), F.lit(0.0))
        .when(p == e, F.lit(1.0))
        .when(lookup(families, p) == lookup(families, e), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def score_lane_change(pred: Column, gt: Column) -> Column:
    """Both sides boolean; null where the label is open."""
    return F.when(gt.isNotNull(), _one(F.coalesce(pred == gt, F.lit(False))))


def score_lanes(pred: Column, gt: Column) -> Column:
    gap = F.abs(pred - gt)
    score = F.when(gap == 0, F.lit(1.0)).when(gap == 1, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.when(gt.isNotNull(), score)


def lanes_exact(pred: Column, gt: Column) -> Column:
    return F.when(gt.isNotNull(), _one(F.coalesce(pred == gt, F.lit(False))))


def lanes_abs_err(pred: Column, gt: Column) -> Column:
    return F.abs(pred - gt).cast("double")


def lane_reward(
    pred_change: Column, pred_lanes: Column, label_has_change: Column,
    label_change: Column, label_lanes: Column,
) -> Column:
    """Lane-change word and lane count together, at most 1."""
    p = _clean(pred_change)
    word = (
        F.when(~p.isin("yes", "no"), F.lit(0.0))
        .when(~label_has_change, F.lit(0.5))
        .when(p == strip(F.lower(F.coalesce(label_change, F.lit("none")))), F.lit(0.6))
        .otherwise(F.lit(0.2))
    )
    gap = F.abs(label_lanes - pred_lanes)
    count = (
        F.when(~F.coalesce(pred_lanes.between(1, 8), F.lit(False)), F.lit(0.0))
        .when(label_lanes.isNull(), F.lit(0.5))
        .when(gap == 0, F.lit(0.4))
        .when(gap <= 1, F.lit(0.2))
        .otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), word + count))


def _items(items: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(items, empty), lambda s: strip(F.lower(s)))


def overlap_sets(pred: Column, gt: Column) -> tuple[Column, Column]:
    """(intersection, union) of the cleaned item sets."""
    p, g = _items(pred), _items(gt)
    return F.array_intersect(p, g), F.array_union(p, g)


def set_jaccard(pred: Column, gt: Column) -> Column:
    both, either = overlap_sets(pred, gt)
    return F.when(F.size(either) == 0, F.lit(1.0)).otherwise(
        F.size(both) / F.nullif(F.size(either), F.lit(0))
    )


def kept_items(items: Column) -> Column:
    """Cleaned items without the blank ones, repeats included."""
    return F.filter(_items(items), lambda s: s != "")


def set_prf(hits: Column, n_pred: Column, n_gt: Column) -> dict[str, Column]:
    """Precision, recall and F1 with the conventions for empty sides."""
    p, r = hits / F.nullif(n_pred, F.lit(0)), hits / F.nullif(n_gt, F.lit(0))
    harmonic = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    none_pred, none_gt = n_pred == 0, n_gt == 0
    case = lambda both, no_pred, no_gt, value: (
        F.when(none_pred & none_gt, F.lit(both))
        .when(none_pred, F.lit(no_pred))
        .when(none_gt, F.lit(no_gt))
        .otherwise(F.bround(value, 4))
    )
    return {
        "precision": case(1.0, 1.0, 0.0, p),
        "recall": case(1.0, 0.0, 1.0, r),
        "f1": case(1.0, 0.0, 0.0, harmonic),
    }


def set_prf_exact(pred: Column, gt: Column) -> dict[str, Column]:
    p, g = kept_items(pred), kept_items(gt)
    return set_prf(F.size(F.array_intersect(p, g)), F.size(p), F.size(g))


def best_match_count(pred: Column, gt: Column, threshold: float) -> Column:
    """How many distinct GT items are the best match of some predicted item.

    The matcher is ours: token Jaccard at or above the threshold, the first of
    the best in GT order.  Item lists belong to one answer, so the comparison
    stays inside the row.
    """
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")

    def match(p: Column, g: Column) -> Column:
        def best(item: Column) -> Column:
            def scored(w: Column) -> Column:
                sims = F.transform(
                    g,
                    lambda t: F.size(F.array_intersect(w, words(t)))
                    / F.size(F.array_union(w, words(t))),
                )
                return let(
                    sims,
                    lambda s: F.when(
                        F.array_max(s) >= threshold,
                        F.get(g, (F.array_position(s, F.array_max(s)) - 1).cast("int")),
                    ),
                )

            return let(words(item), scored)

        return F.size(F.array_distinct(F.filter(F.transform(p, best), lambda m: m.isNotNull())))

    return let(kept_items(pred), lambda p: let(kept_items(gt), lambda g: match(p, g)))


def fuzzy_counts(pred: Column, gt: Column, threshold: float = 0.5) -> dict[str, Column]:
    """Matched items and list sizes, for ``set_prf``."""
    return {
        "hits": best_match_count(pred, gt, threshold),
        "pred": F.size(kept_items(pred)), "gt": F.size(kept_items(gt)),
    }


def set_prf_fuzzy(pred: Column, gt: Column, threshold: float = 0.5) -> dict[str, Column]:
    return set_prf(*fuzzy_counts(pred, gt, threshold).values())


def format_reward(keys: Column) -> Column:
    """Presence of the answer keys in the raw object, whatever their values."""
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    text = has("enhanced_instruction")
    return (
        F.when(text & has("lane_change_required") & has("next_action"), F.lit(1.0))
        .when(text, F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def latency_reward(ms: Column) -> Column:
    out = F.lit(0.0)
    for limit, value in reversed(fixed.LATENCY_TIERS):
        out = F.when(ms < limit, F.lit(value)).otherwise(out)
    return F.when(ms.isNull(), F.lit(0.0)).otherwise(out)


def composite(weights: dict[str, float]) -> Column:
    """Weighted sum of reward columns, clamped to 0..1, six decimals."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def weighted_total(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the metrics that are not null, weights renormalised, 4 decimals."""
    weight, total = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        if name not in scores:
            continue
        weight = weight + F.when(scores[name].isNull(), F.lit(0.0)).otherwise(F.lit(w))
        total = total + F.coalesce(scores[name] * F.lit(w), F.lit(0.0))
    return F.when(weight > 0, F.bround(total / weight, 4)).otherwise(F.lit(0.0))


def match_flags(action: Column, gt_action: Column, acceptable: Column,
                change: Column, gt_change: Column) -> dict[str, Column]:
    """Exact comparison of the viewer: no trimming, an open label counts as a match."""
    accepted = F.coalesce(F.array_contains(acceptable, action), F.lit(False))
    changed = F.coalesce(F.lower(change).isin("yes", "true"), F.lit(False))
    return {
        "action_match": action.eqNullSafe(gt_action) | accepted,
        "lane_change_match": gt_change.isNull() | (changed == F.coalesce(gt_change, F.lit(False))),
    }
