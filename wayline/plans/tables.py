"""Views of the driver tables in the shape of navigation data.

Each function here has a SQL twin of the same name in ``oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators.ordered import NO_KEY

STRINGS = "array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(
        *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per route step: route = order, step = place of the line in its order (an order has few lines)."""
    place = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return described(_lines(spark, sf_dir).withColumn("line", F.row_number().over(place))).select(*STEP)


def route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that ``described`` makes the rows of ``steps`` of, laid by the name of their route.

    That is the key of ``ordered.cut``, so ordered steps over routes move nothing again.  The order of the lines
    names all columns: every read then shuffles the same ones, and all reads of a plan share one shuffle.
    """
    route = route_key(_route(F.col("l_orderkey")))
    place = Window.partitionBy("l_orderkey", route).orderBy(*_LINE_ORDER, "q", "rf")
    return _lines(spark, sf_dir).repartition(route).withColumn("line", F.row_number().over(place))


def route_key(route_id: Column) -> Column:
    """What ``route_lines`` lays rows by."""
    return F.coalesce(route_id, F.lit(NO_KEY["string"]))


def route_of_key(key: Column) -> Column:
    return F.nullif(key, F.lit(NO_KEY["string"]))


STEP = [
    "route_id", "step_index", "distance_m", "duration_s", "type_code", "maneuver_raw", "lat_e5", "lng_e5", "instruction",
    "q", "pk", "sk", "rf",
]
LINE = ["line", "q", "price", "pk", "sk", "rf"]
_LINE_ORDER = ["l_linenumber", "pk", "sk", "price", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_returnflag").alias("rf"),
    )


def _route(order: Column) -> Column:
    return _text("city", order % 5, "_route", order)


def described(lines: DataFrame, route_id: Column | None = None) -> DataFrame:
    """Numbered lines with the columns of a step, all made in the row; ``route_id`` for lines without their order."""
    return lines.withColumns({
        "route_id": _route(F.col("l_orderkey")) if route_id is None else route_id,
        "step_index": (F.col("line") - 1).cast("int"),
        "distance_m": (F.col("q") * 5).cast("int"),
        "duration_s": F.floor(F.col("price") / 1000.0).cast("int"),
        "type_code": (F.col("pk") % 31).cast("int"),
        "maneuver_raw": F.when(F.col("pk") % 4 == 0, "turn-left").when(F.col("pk") % 4 == 1, "")
        .when(F.col("pk") % 4 == 2, "ramp-right"),
        "lat_e5": (F.lit(-2747000) + F.col("pk") % 1000 * 10).cast("bigint"),
        "lng_e5": (F.lit(15302000) + F.col("sk") % 1000 * 10).cast("bigint"),
        "instruction": F.when(F.col("rf") == "N", "").otherwise(
            _text("Turn ", F.lower("rf"), " onto Road ", F.col("sk"))
        ),
    })


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_points(steps(spark, sf_dir))


def with_points(rows: DataFrame) -> DataFrame:
    """Steps with 1 to 4 path points on a 1e-5 degree grid."""
    count = F.when(F.col("pk") % 29 == 0, 1).otherwise(2 + F.col("pk") % 3).cast("int")
    e5 = lambda c: c.cast("double") / 100000.0
    point = lambda i: F.struct(
        e5(F.col("lat_e5") + i * F.col("q") * (F.col("pk") % 5 - 2)).alias("lat"),
        e5(F.col("lng_e5") + i * (F.col("sk") % 3) * 20).alias("lng"),
    )
    return rows.withColumn("points", F.slice(F.array(*[point(F.lit(i)) for i in range(4)]), F.lit(1), count))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model answer: ten answers per sample, some of them errors."""
    return results_of(table(spark, sf_dir, "events"))


def results_of(events: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    return events.select(
        e.alias("ordinal"),
        F.floor(e / 10).cast("bigint").alias("sample_id"),
        _text("co", u % 7, "/m", u % 21).alias("model_id"),
        F.when(kind == "view", "video + prior").when(kind == "click", "image + prior")
        .when(kind == "signup", "prior").otherwise("augment + prior").alias("modality"),
        F.when(e % 9 == 0, "v2").when(e % 9 == 1, "").alias("variant"),
        F.when(e % 6 == 0, "rain").when(e % 6 == 1, "").when(e % 6 == 2, "haze").alias("augment"),
        F.when(kind == "error", "failed").alias("error"),
        F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
        F.when(e % 7 != 6, (e % 7).cast("int")).alias("lanes_count"),
        F.when(e % 4 == 0, "yes").when(e % 4 == 1, "no").when(e % 4 == 2, "unknown")
        .alias("lane_change_required"),
        F.when(e % 5 == 0, "turn_left").when(e % 5 == 1, "keep_left")
        .when(e % 5 == 2, "turn_right").when(e % 5 == 3, "straight").otherwise("")
        .alias("next_action"),
        F.when(e % 17 == 0, "").otherwise(
            _text(
                "Turn ", F.when(e % 2 == 0, "left").otherwise("right"), " onto Road ", u % 40,
                " then continue for ", F.floor("value"), " meters",
            )
        ).alias("enhanced_instruction"),
        F.when(e % 5 == 0, F.array().cast(STRINGS)).otherwise(
            F.array(_text("Shop ", e % 3), _text(" park ", u % 4), _text("shop ", e % 3))
        ).alias("relevant_landmarks"),
        F.when(e % 4 == 0, F.array().cast(STRINGS)).otherwise(
            F.array(_text("cyclist ", e % 2))
        ).alias("potential_hazards"),
        (100 + e % 50).alias("tokens_in"),
        (10 + u % 30).alias("tokens_out"),
        (F.col("value") / 500.0).alias("confidence"),
        F.col("ts"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of some samples; one in ten is automatic."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        d.alias("sample_id"),
        (d % 10 == 0).alias("is_auto"),
        F.when(d % 4 == 0, "").otherwise(_text("co", d % 7, "/m", d % 21, "::human"))
        .alias("result_key"),
        _text("Turn left onto Road ", d % 40, " then continue").alias("instruction"),
        F.when(d % 5 == 0, F.array(F.lit("keep_left"), F.lit("TURN_RIGHT ")))
        .otherwise(F.array().cast(STRINGS)).alias("acceptable_actions"),
        F.when(d % 11 != 0, F.col("quality") == 1).alias("lane_change_required"),
        F.when(d % 13 != 0, (1 + d % 4).cast("int")).alias("lanes_count"),
        F.when(F.col("toxic") == 1, "turn_right").otherwise("turn_left").alias("next_action"),
        F.when(d % 3 == 0, F.array().cast(STRINGS)).otherwise(
            F.array(_text("shop ", d % 3), F.lit("bridge"))
        ).alias("relevant_landmarks"),
        F.when(d % 2 == 0, F.array().cast(STRINGS)).otherwise(F.array(F.lit("Cyclist 1")))
        .alias("potential_hazards"),
        F.when(d % 6 == 0, "RAMP_LEFT").when(d % 6 == 1, "TURN_RIGHT").when(d % 6 == 2, "straight")
        .when(d % 6 == 3, "U Turn").when(d % 6 == 4, "").otherwise("KEEP_LEFT").alias("maneuver"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read as a route step: seven steps a route."""
    d = F.col("doc_id")
    route = F.floor(d / 7).cast("bigint")
    return table(spark, sf_dir, "documents").select(
        d.alias("sample_id"),
        _text("city", route % 5, "_route", route).alias("route_id"),
        (d % 7).cast("int").alias("step_index"),
        F.when(d % 7 == 6, "Arrive").when(d % 7 == 0, F.lit(None)).when(d % 2 == 0, "TURN_LEFT")
        .otherwise("KEEP_RIGHT").alias("maneuver"),
        F.col("source"),
        _text("Go ", F.col("n_chars"), " then ", F.col("lang")).alias("instruction"),
        F.when(d % 3 == 0, _text("city", route % 5)).alias("city"),
        F.col("n_chars"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn (reference) with the turn after it (prediction)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    later = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred_text")
    )
    return turns.withColumnRenamed("text", "ref_text").join(later, ["conv_id", "turn"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("maneuver"), "embedding",
        (F.col("vec_id") % 10 / 10.0).alias("reward"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road points: one per part, laid over the area of the steps."""
    p = F.col("p_partkey")
    kind = p % 8
    return table(spark, sf_dir, "part").select(
        p.alias("road_id"),
        ((F.lit(-2747000) + p % 1000 * 10 + p % 3 * 4).cast("double") / 100000.0).alias("lat"),
        ((F.lit(15302000) + p % 97 * 10).cast("double") / 100000.0).alias("lng"),
        F.when(kind == 0, "motorway").when(kind == 1, "primary").when(kind == 2, "secondary_link")
        .when(kind == 3, "tertiary").when(kind == 4, "residential").when(kind == 5, "unclassified")
        .when(kind == 6, "footway").otherwise("service").alias("highway"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 4 == 0, "two").otherwise((F.col("p_size") % 5).cast("string"))
        .alias("lanes"),
        F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no").alias("oneway"),
        F.when(p % 5 == 0, _text("M", p % 50)).alias("ref"),
        F.when(p % 3 != 0, (F.col("p_size") % 6 * 10 + 30).cast("string")).alias("maxspeed"),
        F.when(p % 4 != 1, F.col("p_brand")).alias("surface"),
        F.when(p % 7 == 0, "yes").when(p % 7 == 1, "no").alias("lit"),
        F.when(p % 9 == 0, "both").alias("sidewalk"), F.when(p % 10 == 0, "lane").alias("cycleway"),
        F.when(p % 11 == 0, "yes").alias("bridge"), F.when(p % 13 == 0, "yes").alias("tunnel"), F.when(p % 17 == 0, "yes").otherwise("no").alias("toll"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by supplier; each knows itself and older names as aliases."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _text("co", s % 7, "/x", s).alias("model_id"),
        F.array(_text("co", s % 7, "/m", s), _text("old/m", s)).alias("aliases"),
        F.col("s_name").alias("display_name"),
        (s % 20 / 4.0).alias("input_cost_per_mtok"),
        (s % 20 / 2.0).alias("output_cost_per_mtok"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs: neighbouring answers of one sample from two companies.

    Three votes per comparison, spread over the values of the event id.
    """
    res = results(spark, sf_dir).select("ordinal", "sample_id", "model_id", "modality")
    after = res.select(
        (F.col("ordinal") - 1).alias("ordinal"), F.col("sample_id").alias("next_sample"),
        F.col("model_id").alias("model_b"),
    )
    o = F.col("ordinal")
    vote = lambda k: F.struct(
        F.lit(f"judge{k}").alias("judge_model"),
        F.when((o * k) % 3 == 0, "A").when((o * k + k) % 3 == 1, "B").otherwise("tie").alias("winner"),
        F.when(((o + k) % 11 == 0) | ((o % 13 == 0) & F.lit(k < 3)), "timeout").alias("error"),
    )
    return (
        res.join(after, "ordinal")
        .where((F.col("sample_id") == F.col("next_sample")) & (F.col("model_id") != F.col("model_b")))
        .select(
            "ordinal", "sample_id", "modality", F.col("model_id").alias("model_a"), "model_b",
            F.array(vote(1), vote(2), vote(3)).alias("judge_votes"),
        )
    )
