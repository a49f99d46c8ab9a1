"""Where to place camera frames on a step: arrays of metres before its end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions.core import indices, let, strip, whole

NONE = "array<int>"


def _positive_distinct(values: Column) -> Column:
    whole_m = F.transform(values, lambda v: whole(v).cast("int"))
    return F.array_distinct(F.filter(whole_m, lambda v: v > 0))


def clamp_targets(step_len: Column, targets: list[int]) -> Column:
    d = F.coalesce(step_len.cast("double"), F.lit(0.0))
    # no lambda: the array is made in compiled code
    clamped = F.array(*[whole(F.greatest(F.least(d, F.lit(float(t))), F.lit(0.0))).cast("int") for t in targets])
    return F.when(d > 0, F.array_remove(F.array_distinct(clamped), 0)).otherwise(F.array().cast(NONE))


def spaced_targets(
    step_len: Column, spacing: Column | float = fixed.VIDEO_SPACING_M,
    start: Column | None = None, end: Column | float = fixed.VIDEO_END_M,
) -> Column:
    """start, start - spacing, ... down to end, and end itself."""
    col = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    d = F.coalesce(step_len.cast("double"), F.lit(0.0))
    gap = F.greatest(F.lit(0.5), col(spacing))
    floor_m = F.greatest(F.lit(0.0), col(end))
    first = d if start is None else F.coalesce(F.least(col(start), d), d)

    def walk(first: Column) -> Column:
        steps = F.transform(
            indices(F.floor((first - floor_m) / gap) + 1), lambda i: first - i * gap
        )
        return let(
            steps,
            lambda v: F.when(
                F.element_at(v, -1) > floor_m, F.concat(v, F.array(floor_m))
            ).otherwise(v),
        )

    short = F.array(F.greatest(F.lit(1).cast("bigint"), whole(d)).cast("int"))
    return (
        F.when(d <= 0, F.array().cast(NONE))
        .when(d <= floor_m, short)
        .when(first <= floor_m, _positive_distinct(F.array(floor_m)))
        .otherwise(_positive_distinct(let(first, walk)))
    )


def profile_distances(
    step_len: Column, profile: Column, spacing: Column | float = 20.0,
    start: Column | None = None, end: Column | float = 0.0,
) -> Column:
    """Targets of a named profile; an unknown profile is an error."""
    name = strip(F.lower(profile))
    return (
        F.when(name == "single", clamp_targets(step_len, fixed.SINGLE_TARGETS))
        .when(name == "sparse4", clamp_targets(step_len, fixed.SPARSE4_TARGETS))
        .when(name == "video5m", spaced_targets(step_len))
        .when(name == "custom", spaced_targets(step_len, spacing, start, end))
        .otherwise(F.raise_error(F.concat(F.lit("unknown frame profile: "), name)).cast(NONE))
    )


def effective_profile(
    profile: Column, spacing: Column, start: Column, end: Column
) -> Column:
    """A spacing or window other than the default makes the profile custom."""
    windowed = (spacing != 20.0) | start.isNotNull() | end.isNotNull()
    return F.when(windowed, F.lit("custom")).otherwise(F.coalesce(profile, F.lit("sparse4")))


def profile_of_mode(mode: Column) -> Column:
    name = strip(F.lower(F.coalesce(mode, F.lit(""))))
    return (
        F.when(name == "dense", F.lit("video5m"))
        .when(name == "custom", F.lit("custom"))
        .otherwise(F.lit("sparse4"))
    )


def frames_in_profile(frames: Column, step_len: Column, profile: str = "sparse4") -> Column:
    """Frames whose remaining_m is a target, one per distance, far to near."""
    if profile == "all":
        return frames
    if profile != "sparse4":
        raise ValueError("profile must be 'sparse4' or 'all'")
    far_to_near = F.reverse(F.array_sort(clamp_targets(step_len, fixed.SPARSE4_TARGETS)))
    pick = lambda t: F.get(F.filter(frames, lambda f: f["remaining_m"] == t), F.lit(0))
    return F.filter(F.transform(far_to_near, pick), lambda f: f.isNotNull())


def closest_frame(frames: Column) -> Column:
    """The first frame with the smallest remaining_m, null without frames."""
    low = F.array_min(F.transform(frames, lambda f: f["remaining_m"]))
    return let(
        low, lambda m: F.get(F.filter(frames, lambda f: f["remaining_m"] == m), F.lit(0))
    )
