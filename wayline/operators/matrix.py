"""Planning and accounting of evaluation runs over samples x models x modalities."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions.core import present
from wayline.operators.joins import CELL, _cells
from wayline.operators.ordered import dense_ordinal


def assign_augments(samples: DataFrame, cycle: list[str] | None = None) -> DataFrame:
    """One augment per route, round robin over the sorted distinct routes."""
    cycle = cycle or fixed.AUGMENT_CYCLE
    bad = [a for a in cycle if a not in fixed.AUGMENTS]
    if bad:
        raise ValueError(f"invalid augments in cycle: {bad}")
    routes = samples.where(present(F.col("route_id")).isNotNull()).select("route_id").distinct()
    placed = dense_ordinal(routes, ["route_id"], "no")
    pick = F.get(F.array(*[F.lit(a) for a in cycle]), ((F.col("no") - 1) % len(cycle)).cast("int"))
    return placed.select("route_id", pick.alias("augment"))


def assignment_problems(samples: DataFrame, assignments: DataFrame) -> DataFrame:
    """Routes without an assignment and assignments of an unknown augment."""
    routes = samples.select("route_id").distinct()
    missing = routes.join(assignments, "route_id", "left_anti").select(
        "route_id", F.lit("missing").alias("problem")
    )
    invalid = assignments.where(~F.coalesce(F.col("augment").isin(fixed.AUGMENTS), F.lit(False)))
    return missing.unionByName(invalid.select("route_id", F.lit("invalid augment").alias("problem")))


def missing_routes(samples: DataFrame, assignments: DataFrame) -> DataFrame:
    return samples.select("route_id").distinct().subtract(assignments.select("route_id"))


def _options(models: list[dict], tasks: list[str], defaults: dict | None = None) -> Column:
    """Every (model, task) of the run configuration as one literal array; a model option overrides the default."""
    unknown = [t for t in tasks if t not in fixed.TASKS]
    if unknown:
        raise ValueError(f"invalid modalities: {unknown}")
    defaults = defaults or {}
    text = lambda v: F.lit(v).cast("string")
    return F.array(
        *[
            F.struct(
                text(m["model_id"]).alias("model_id"), text(m.get("variant")).alias("variant"),
                text(m["provider"] if m.get("provider") is not None else defaults.get("provider")).alias("provider"),
                text(t).alias("task"), text(fixed.TASKS[t][0]).alias("modality"), F.lit(fixed.TASKS[t][1]).alias("augmented"),
            )
            for m in models for t in tasks
        ]
    )


def _assigned(samples: DataFrame, assignments: DataFrame) -> DataFrame:
    return samples.select("sample_id", "route_id").join(
        assignments.select("route_id", F.col("augment").alias("_assigned")), "route_id", "left"
    )


def expand_tasks(
    samples: DataFrame, models: list[dict], tasks: list[str], assignments: DataFrame,
    defaults: dict | None = None,
) -> DataFrame:
    """One row per (sample, model, task): what a full run would ask.

    ``models`` and ``tasks`` are the run configuration, so they are literals
    inside an explode and not a join.  The counts below never make these rows.
    """
    rows = _assigned(samples, assignments).withColumn("o", F.explode(_options(models, tasks, defaults)))
    return rows.select(
        "sample_id", "route_id", "o.model_id", "o.variant", "o.provider", "o.task", "o.modality",
        F.when(F.col("o.augmented"), F.col("_assigned")).alias("augment"),
    )


def task_table(
    samples: DataFrame, models: list[dict], tasks: list[str], assignments: DataFrame,
    defaults: dict | None = None,
) -> DataFrame:
    """One row per task of the run with its number of samples.

    Samples are counted per assigned augment, a handful of rows, and only
    those counts meet the configuration.
    """
    counts = _assigned(samples, assignments).groupBy("_assigned").agg(F.count("*").alias("_n"))
    rows = counts.withColumn("o", F.explode(_options(models, tasks, defaults))).select(
        "o.*", F.when(F.col("o.augmented"), F.col("_assigned")).alias("augment"), "_n"
    )
    return rows.groupBy("model_id", "variant", "provider", "task", "modality", "augment").agg(
        F.sum("_n").alias("attempted")
    )


def _asked(
    cells: DataFrame, samples: DataFrame, models: list[dict], tasks: list[str], assignments: DataFrame,
) -> DataFrame:
    """The cells (one row per identity) that the run asks for, with their route.

    A cell comes once for every sample row and option that asks for it.  The
    work follows the stored results and not the grid; the options are as many
    rows as the configuration has models times tasks.
    """
    options = samples.sparkSession.range(1).select(F.inline(_options(models, tasks))).select(
        F.col("model_id").alias("_model"), present(F.col("variant")).alias("_variant"),
        F.col("modality").alias("_modality"), F.col("augmented").alias("_augmented"),
    )
    c = F.col
    option = c("model_id").eqNullSafe(c("_model")) & c("modality").eqNullSafe(c("_modality")) & c("variant").eqNullSafe(c("_variant"))
    rows = cells.join(F.broadcast(options), option)
    by_sample = _assigned(samples, assignments).select(
        c("sample_id").alias("_sample"), "route_id", present(c("_assigned")).alias("_assigned")
    )
    same = c("sample_id").eqNullSafe(c("_sample")) & c("augment").eqNullSafe(F.when(c("_augmented"), c("_assigned")))
    return rows.join(by_sample, same).drop("_sample", "_assigned", "_model", "_variant", "_modality", "_augmented")


def task_summary(
    samples: DataFrame, models: list[dict], tasks: list[str], assignments: DataFrame,
    existing: DataFrame, new: DataFrame,
) -> DataFrame:
    """attempted, skipped_existing, written and errors per task.

    Attempts are counted by arithmetic; the stored runs are brought to one row
    per identity before they meet their sample.
    """
    none = F.lit(0).cast("long")
    seen = _cells(existing).select(*CELL, F.lit(1).cast("long").alias("_old"), none.alias("_rows"), none.alias("_bad")).unionByName(
        _cells(new).select(
            *CELL, none.alias("_old"), F.lit(1).cast("long").alias("_rows"),
            present(F.col("error")).isNotNull().cast("long").alias("_bad"),
        )
    )
    cells = seen.groupBy(*CELL).agg(F.max("_old").alias("_old"), F.sum("_rows").alias("_rows"), F.sum("_bad").alias("_bad"))
    todo = lambda n: F.when(F.col("_old") == 0, F.col(n)).otherwise(none)
    task = ["model_id", "variant", "modality", "augment"]
    found = _asked(cells, samples, models, tasks, assignments).select(
        *task, none.alias("_n"), F.col("_old").alias("_skipped"), todo("_rows").alias("_written"), todo("_bad").alias("_errors")
    )
    planned = _cells(task_table(samples, models, tasks, assignments)).select(
        *task, F.col("attempted").alias("_n"), none.alias("_skipped"), none.alias("_written"), none.alias("_errors")
    )
    return planned.unionByName(found).groupBy(*task).agg(
        F.sum("_n").alias("attempted"), F.sum("_skipped").alias("skipped_existing"),
        F.sum("_written").alias("written"), F.sum("_errors").alias("errors"),
    )


def coverage(
    samples: DataFrame, models: list[dict], tasks: list[str], assignments: DataFrame, results: DataFrame,
) -> DataFrame:
    """Expected, present and missing runs per model, modality and route.

    Rows with a null route are totals over the routes, and so on upwards.  The
    report is ours: the original gives no formula, only where it is called.
    Expected runs are samples per route times tasks of the modality; present
    ones follow the distinct successful results.
    """
    keys = ["model_id", "modality", "route_id"]
    times = Counter((m["model_id"], fixed.TASKS[t][0]) for m in models for t in tasks)
    kinds = F.array(
        *[
            F.struct(F.lit(m).cast("string").alias("model_id"), F.lit(k).alias("modality"), F.lit(n).cast("long").alias("n"))
            for (m, k), n in times.items()
        ]
    )
    # the join gives a route twice where the assignments do, as the grid would
    routes = _assigned(samples, assignments).groupBy("route_id").agg(F.count("*").alias("_n"))
    expected = routes.withColumn("k", F.explode(kinds)).select(
        "k.model_id", "k.modality", "route_id", (F.col("_n") * F.col("k.n")).alias("_all"), F.lit(0).cast("long").alias("_ok")
    )
    done = _cells(results).where(present(F.col("error")).isNull()).select(*CELL).distinct()
    found = _asked(done, samples, models, tasks, assignments).groupBy(*keys).agg(F.count("*").alias("_ok"))
    found = found.select(*keys, F.lit(0).cast("long").alias("_all"), "_ok")
    # counted per route first, so the rollup copies counts and not runs
    return expected.unionByName(found).rollup(*keys).agg(
        F.sum("_all").alias("expected"), F.sum("_ok").alias("present"),
        F.sum(F.col("_all") - F.col("_ok")).alias("missing"),
    )
