"""Column rules that clean route steps, names and model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions.core import (
    first_present, let, lookup, one_decimal, present, strip, whole,
)


def strip_html(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"(?i)<(?:div|br|p|span)[^>]*>", " ")
    bare = F.regexp_replace(spaced, r"<[^>]+>", "")
    return strip(F.regexp_replace(bare, r" {2,}", " "))


def maneuver_type(maneuver: Column, code: Column) -> Column:
    named = F.when(
        maneuver.isNotNull() & ~maneuver.isin("", "?"),
        F.replace(F.upper(maneuver), F.lit("-"), F.lit("_")),
    )
    coded = F.coalesce(
        lookup(fixed.MANEUVER_BY_CODE, code.cast("int")),
        F.concat(F.lit("TYPE_"), code.cast("string")),
    )
    return F.coalesce(named, coded, F.lit("UNKNOWN"))


def maneuver_code(maneuver: Column) -> Column:
    return F.coalesce(
        lookup(fixed.CODE_BY_MANEUVER, maneuver), F.lit(fixed.DEFAULT_MANEUVER_CODE)
    )


def expected_action(maneuver: Column) -> Column:
    key = strip(F.upper(F.coalesce(maneuver, F.lit(""))))
    return F.coalesce(
        lookup(fixed.ACTION_BY_MANEUVER, key),
        F.replace(F.lower(key), F.lit(" "), F.lit("_")),
    )


def _after_marker(text: Column) -> Column:
    """Text behind the first listed marker, null when there is none."""
    out = F.lit(None).cast("string")
    for marker in reversed(fixed.STREET_NAME_MARKERS):
        at = F.instr(F.lower(text), marker)
        behind = F.substring(text, at + F.lit(len(marker)), F.length(text))
        out = F.when(at > 0, strip(behind)).otherwise(out)
    return out


def street_names(instruction: Column) -> Column:
    def cut(rest: Column) -> Column:
        out = rest
        for end in reversed(fixed.STREET_NAME_TERMINATORS):
            out = F.when(
                F.contains(rest, F.lit(end)), strip(F.substring_index(rest, end, 1))
            ).otherwise(out)
        return out

    rest = F.coalesce(_after_marker(instruction), F.lit(""))
    parts = let(rest, lambda r: F.transform(F.split(cut(r), "/"), strip))
    return F.filter(parts, lambda name: F.length(name) > 1)


def road_name(osm_name: Column, names: Column, instruction: Column) -> Column:
    return F.coalesce(
        present(osm_name),
        F.get(names, F.lit(0)),
        F.rtrim(_after_marker(instruction), F.lit(".")),
    )


def lane_change_flag(value: Column) -> Column:
    """Union-typed yes/no text or boolean (read as text) to a boolean."""
    text = strip(F.lower(value.cast("string")))
    return F.when(value.isNotNull(), text.isin("yes", "true"))


def highway_flag(instruction: Column, maneuver: Column) -> Column:
    pattern = "|".join(fixed.HIGHWAY_KEYWORDS)
    return F.lower(instruction).rlike(pattern) | F.coalesce(
        maneuver.isin(fixed.HIGHWAY_MANEUVERS), F.lit(False)
    )


def continue_text(metres: Column) -> Column:
    km = metres.cast("double") / 1000.0
    number = (
        F.when(metres < 100, F.concat(metres.cast("bigint").cast("string"), F.lit(" meters.")))
        .when(
            metres < 1000,
            F.concat(((metres / 10).cast("bigint") * 10).cast("string"), F.lit(" meters.")),
        )
        .when(km < 10, F.concat(one_decimal(km), F.lit(" kilometers.")))
        .otherwise(F.concat(km.cast("bigint").cast("string"), F.lit(" kilometers.")))
    )
    return F.concat(F.lit("Continue for "), number)


def parse_duration(text: Column) -> Column:
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)\s*s$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def to_metres(text: Column) -> Column:
    plain = F.lower(strip(text))
    plain = F.replace(plain, F.lit("meters"), F.lit("m"))
    plain = F.replace(plain, F.lit("metres"), F.lit("m"))
    km = present(F.regexp_extract(plain, r"^\s*([0-9]*\.?[0-9]+)\s*km\s*$", 1))
    m = present(F.regexp_extract(plain, r"^\s*([0-9]*\.?[0-9]+)\s*m\s*$", 1))
    return F.coalesce(
        km.try_cast("double") * 1000.0, m.try_cast("double"), plain.try_cast("double")
    )


def format_distance(metres: Column) -> Column:
    m = metres.cast("double")
    km = m / 1000.0
    unknown = m.isNull() | F.isnan(m) | (F.abs(m) == float("inf"))
    return (
        F.when(unknown, F.lit("--"))
        .when(m < 1000, F.concat(whole(m).cast("string"), F.lit(" m")))
        .when(km > 1e9, F.lit(">>> km"))
        .when(km < 10, F.concat(one_decimal(km), F.lit(" km")))
        .otherwise(F.concat(whole(km).cast("string"), F.lit(" km")))
    )


def format_eta(minutes: Column) -> Column:
    total = F.greatest(F.lit(0).cast("bigint"), whole(minutes))
    hours, rest = F.floor(total / 60).cast("string"), total % 60
    return (
        F.when(minutes.isNull() | F.isnan(minutes.cast("double")), F.lit("--"))
        .when(total < 60, F.concat(total.cast("string"), F.lit("m")))
        .when(rest == 0, F.concat(hours, F.lit("h")))
        .otherwise(F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m")))
    )


def _three(n: Column) -> Column:
    """A whole number from 0 with at least three digits."""
    text = n.cast("bigint").cast("string")
    return F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)


def sample_id(route: Column, step: Column) -> Column:
    return F.concat(route, F.lit("_step"), _three(step))


def map_filename(route: Column, step: Column) -> Column:
    return F.concat(sample_id(route, step), F.lit("_map.png"))


def frame_filename(
    route: Column, step: Column, remaining: Column, step_len: Column,
    augment: Column | None = None,
) -> Column:
    rem = remaining.cast("bigint")
    into = F.greatest(F.lit(0).cast("bigint"), step_len.cast("bigint") - rem)
    name = F.concat(sample_id(route, step), F.lit("_"), _three(into), F.lit("m_"), _three(rem), F.lit("m"))
    if augment is not None:
        tail = F.when(present(augment).isNull(), "").otherwise(F.concat(F.lit("_"), augment))
        name = F.concat(name, tail)
    return F.concat(name, F.lit(".jpg"))


def route_of_frame(name: Column) -> Column:
    """The route in the name of a frame: what stands before its last step; a name without a step is its own."""
    behind = F.length(F.substring_index(name, "_step", -1)) + 5
    return F.when(F.contains(name, F.lit("_step")), F.left(name, F.length(name) - behind)).otherwise(name)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_frame_filename(name: Column) -> Column:
    """struct(distance_into_step_m, remaining_m), zeros where nothing matches."""
    stem = F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")

    def number(part: Column) -> Column:
        return F.regexp_extract(part, r"^\s*([+-]?\d+)\s*m$", 1).try_cast("int")

    def read(parts: Column) -> Column:
        marks = F.transform(parts, lambda p: p.startswith("step") & (F.length(p) == 7))
        at = F.array_position(marks, F.lit(True)).cast("int")  # 1-based: the part behind
        into, rem = F.get(parts, at), F.get(parts, at + 1)
        ok = (at > 0) & into.endswith("m") & rem.endswith("m")
        into_n = F.when(ok, number(into))
        rem_n = F.when(into_n.isNotNull(), number(rem))
        return F.struct(
            F.coalesce(into_n, F.lit(0)).alias("distance_into_step_m"),
            F.coalesce(rem_n, F.lit(0)).alias("remaining_m"),
        )

    return let(F.split(stem, "_"), read)


def slugify(text: Column, max_len: int = 40) -> Column:
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.left(F.btrim(dashed, F.lit("-")), F.lit(max_len))


def city_of_sample(city: Column, sample: Column) -> Column:
    return F.coalesce(city, F.substring_index(sample, "_route", 1))


def company_of_model(model: Column) -> Column:
    return F.lower(F.substring_index(model, "/", 1))


def model_display_name(model: Column) -> Column:
    name = F.substring_index(model, "/", -1)
    for suffix in ("-instruct", "-preview", "-beta"):
        name = F.regexp_replace(name, f"(?i){suffix}$", "")
    return name


RESPONSE_SCHEMA = (
    "array<struct<enhanced_instruction:string,lane_change_required:string,"
    "lanes_count:int,next_action:string,relevant_landmarks:array<string>,"
    "potential_hazards:array<string>,reasoning:string>>"
)


def response_json(raw: Column) -> Column:
    """The JSON object text inside a raw model response, or null."""
    text = strip(F.regexp_replace(strip(raw), r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_replace(text, r"^```[^\n]*(\n|$)", "")
    fenced = F.regexp_replace(fenced, r"(^|\n)[^\S\n]*```[^\S\n]*$", "")
    text = F.when(text.startswith("```"), fenced).otherwise(text)
    return present(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def response_fields(raw: Column, prior: Column) -> Column:
    """struct of the answer fields with their defaults.

    The object is parsed as the only element of an array, so that trailing
    text behind it makes it invalid instead of being ignored.
    """
    parsed = F.from_json(
        F.concat(F.lit("["), response_json(raw), F.lit("]")), RESPONSE_SCHEMA
    )
    empty = F.array().cast("array<string>")

    def fill(rows: Column) -> Column:
        row = F.when(F.size(rows) == 1, F.get(rows, F.lit(0)))
        return F.struct(
            F.coalesce(row["enhanced_instruction"], prior).alias("enhanced_instruction"),
            F.coalesce(row["lane_change_required"], F.lit("no")).alias("lane_change_required"),
            row["lanes_count"].alias("lanes_count"),
            F.coalesce(row["next_action"], F.lit("unknown")).alias("next_action"),
            F.coalesce(row["relevant_landmarks"], empty).alias("relevant_landmarks"),
            F.coalesce(row["potential_hazards"], empty).alias("potential_hazards"),
            row["reasoning"].alias("reasoning"),
        )

    return let(parsed, fill)


def split_latlon(text: Column) -> Column:
    """struct(lat, lng) of a "lat,lng" / "lat;lng" / "lat lng" text, or null."""
    parts = F.filter(F.split(strip(text), r"[,;\s]+"), lambda p: p != "")
    return let(
        parts,
        lambda p: F.when(
            F.size(p) == 2,
            F.struct(
                F.get(p, F.lit(0)).try_cast("double").alias("lat"),
                F.get(p, F.lit(1)).try_cast("double").alias("lng"),
            ),
        ),
    )


def nav_fields(
    nav_instruction: Column, step_instruction: Column, effective: Column,
    nav_maneuver: Column, step_maneuver: Column,
    nav_remaining: Column, step_remaining: Column, distance: Column,
) -> dict[str, Column]:
    """Maneuver, instruction and metres by the fallback order of the overlay."""
    some = lambda c: F.nullif(c, F.lit(0).cast("double"))  # zero counts as missing
    return {
        "nav_maneuver": F.coalesce(
            first_present(nav_maneuver, step_maneuver), F.lit("MANEUVER_UNSPECIFIED")
        ),
        "nav_instruction": F.coalesce(
            first_present(nav_instruction, step_instruction, effective), F.lit("")
        ),
        "nav_metres": F.coalesce(
            some(nav_remaining), some(step_remaining), distance
        ).cast("double"),
    }
