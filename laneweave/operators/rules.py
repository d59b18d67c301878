"""Findings on proposed changes, from counts alone.

Findings are codes, in a fixed order; ``WORDING`` has a sentence for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bbox_area_km2
from ..functions.text import name_or_default, plural
from .features import count_classes
from .validate import is_edit

# Kinds of edits, in the order of the summary, with their labels.
EDIT_KINDS = ("sidewalk", "bike", "crossing", "signal", "roundabout", "road")
LABELS = {"sidewalk": "sidewalk", "bike": "bike lane", "crossing": "crossing", "signal": "traffic signal", "roundabout": "roundabout", "road": "road or lane"}
DISCLAIMER = "These findings follow fixed rules; they replace neither an engineer nor a traffic model."

WORDING = {
    "SAFE_CROSSING": "People on foot are easier to see where crossings are added.",
    "SAFE_SIGNAL": "Signals separate movements in time; volumes and speeds need a check.",
    "SAFE_ROUNDABOUT": "A roundabout slows traffic; its arms need safe crossings.",
    "SAFE_BIKE": "Cyclists get a space of their own; fast streets call for protection.",
    "SAFE_NO_CROSSING": "Much is added along streets and nothing across them.",
    "SAFE_DEFAULT": "These edits give no clear sign for safety.",
    "PED_SIDEWALK": "Walking routes become more continuous.",
    "PED_CROSSING": "Streets become easier to cross.",
    "PED_SIGNAL": "Signal phases can give people on foot their turn.",
    "PED_LIMITED": "Little changes for people on foot.",
    "SUG_CROSS_AT_ENDS": "Join new sidewalks to the network with crossings at their ends.",
    "SUG_BIKE_CONFLICT": "Look at where cyclists and traffic meet.",
    "SUG_RB_SETBACK": "Set crossings back from roundabout arms.",
    "SUG_MORE_SIDEWALK": "With this many roads, more sidewalks are worth drawing.",
    "SUG_SMALLER_AREA": "A smaller area gives sharper findings.",
    "SUG_DEFAULT": "Add a crossing, sidewalk or bike lane and look again.",
}


def count_edits(edits: DataFrame, projects: DataFrame, key: str = "project_id") -> DataFrame:
    """Six counters and the total of valid edits per project; projects without edits have zeros.

    An edit of unknown kind counts in the total only.
    """
    n = [F.count_if(F.col("type") == k).alias(f"{k}_edits") for k in EDIT_KINDS]
    counted = edits.where(is_edit(F.col("id"), F.col("type"))).groupBy(key).agg(*n, F.count(F.lit(1)).alias("total_edits"))
    joined = projects.join(counted, key, "left")
    return joined.na.fill(0, [*[f"{k}_edits" for k in EDIT_KINDS], "total_edits"])


def _codes(*rules: tuple[Column, str], default: str | None = None) -> Column:
    found = F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in rules]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found) if default else found


def summary(name: Column, total: Column, counts: dict[str, Column], road_count: Column) -> Column:
    """One sentence: what is added, in a fixed order, and how many roads there are."""
    parts = F.concat_ws(", ", F.filter(F.array(*[plural(counts[k], LABELS[k]) for k in EDIT_KINDS]), lambda p: p != ""))
    roads = F.concat(road_count.cast("string"), F.lit(" mapped roads"))
    return F.when(total == 0, F.concat(name, F.lit(": nothing drawn yet, "), roads)).otherwise(F.concat(name, F.lit(": adds "), parts, F.lit(" among "), roads))


def safety_codes(c: dict[str, Column], roads: Column) -> Column:
    return _codes(
        (c["crossing"] > 0, "SAFE_CROSSING"),
        (c["signal"] > 0, "SAFE_SIGNAL"),
        (c["roundabout"] > 0, "SAFE_ROUNDABOUT"),
        (c["bike"] > 0, "SAFE_BIKE"),
        ((c["crossing"] == 0) & ((c["sidewalk"] > 0) | (c["bike"] > 0)) & (roads > 10), "SAFE_NO_CROSSING"),
        default="SAFE_DEFAULT",
    )


def pedestrian_codes(c: dict[str, Column], roads: Column) -> Column:
    return _codes(
        (c["sidewalk"] > 0, "PED_SIDEWALK"),
        (c["crossing"] > 0, "PED_CROSSING"),
        (c["signal"] > 0, "PED_SIGNAL"),
        ((c["sidewalk"] == 0) & (c["crossing"] == 0) & (roads > 0), "PED_LIMITED"),
    )


def suggestion_codes(c: dict[str, Column], roads: Column, area_km2: Column) -> Column:
    return _codes(
        ((c["sidewalk"] > 0) & (c["crossing"] == 0), "SUG_CROSS_AT_ENDS"),
        ((c["bike"] > 0) & (c["signal"] == 0) & (c["crossing"] == 0), "SUG_BIKE_CONFLICT"),
        (c["roundabout"] > 0, "SUG_RB_SETBACK"),
        ((roads > 40) & (c["sidewalk"] < 2), "SUG_MORE_SIDEWALK"),
        (area_km2 > 2, "SUG_SMALLER_AREA"),
        default="SUG_DEFAULT",
    )


def provider_reject_reason(provider: Column) -> Column:
    """Only ``rules`` is there, in any case; none named means it."""
    return F.when(F.lower(F.coalesce(provider, F.lit("rules"))) != "rules", F.lit("UNKNOWN_PROVIDER"))


def analyze(projects: DataFrame, edits: DataFrame, features: DataFrame) -> DataFrame:
    """Summary and the three lists of codes for every project (project_id, name, bbox).

    Roads are counted from the features; a column ``road_count_override`` of
    projects, where it is there and not null, takes their place.
    """
    counted = count_edits(edits, projects)
    roads = count_classes(features, "project_id").select("project_id", F.col("road_count").alias("__roads"))
    joined = counted.join(roads, "project_id", "left")
    given = [F.col("road_count_override")] if "road_count_override" in projects.columns else []
    joined = joined.withColumn("road_count", F.coalesce(*given, "__roads", F.lit(0)).cast("bigint"))
    c = {k: F.col(f"{k}_edits") for k in EDIT_KINDS}
    n = F.col("road_count")
    return joined.select(
        "project_id",
        summary(name_or_default(F.col("name"), "This project"), F.col("total_edits"), c, n).alias("summary"),
        safety_codes(c, n).alias("safety"),
        pedestrian_codes(c, n).alias("pedestrian"),
        suggestion_codes(c, n, bbox_area_km2(F.col("bbox"))).alias("suggestions"),
        F.lit(DISCLAIMER).alias("disclaimer"),
        F.lit("rules").alias("provider"),
    )
