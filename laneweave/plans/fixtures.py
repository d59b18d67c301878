"""Streets, edits, drafts and requests derived from the driver's tables, one area per nation.

Coordinates are whole numbers divided once, so every engine holds the same double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import BBOX


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key: a table of one file is one task otherwise, whatever it grows to in the plan."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return dealt(o, "o_orderkey").join(c, o["o_custkey"] == c["c_custkey"])


KIND = """case when o_orderkey % 29 = 0 then 'proposed' when o_orderkey % 23 = 0 then 'footway'
 when o_orderpriority = '1-URGENT' then 'primary' when o_orderpriority = '2-HIGH' then 'secondary'
 when o_orderpriority = '3-MEDIUM' then 'residential' when o_orderpriority = '5-LOW' then 'service' else 'unclassified' end"""
SIDEWALK = "case when o_orderstatus = 'F' then 'both' when o_orderstatus = 'O' then 'no' else null end"


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of class road: project_id, feature_seq, feature_id, kind, tags, geometry."""
    base = _orders(spark, sf_dir).selectExpr(
        "cast(c_nationkey as bigint) as project_id", "o_orderkey as feature_seq", "'road' as feature_class", "o_orderkey as feature_id", f"{KIND} as kind",
        f"map_filter(map('sidewalk', {SIDEWALK}), (k, v) -> v is not null) as tags",
        "(o_orderkey*31) % 48 as gx", "(o_orderkey*17 + o_custkey) % 48 as gy", "o_orderkey % 2 as vertical", "cast(2 + o_orderkey % 4 as int) as n_pts",
    )
    geometry = F.expr(
        "transform(sequence(0, n_pts - 1), k -> named_struct('lat', ((project_id*4-50)*10000 + 3*(gy + vertical*k)) / 10000D, 'lng', ((project_id*10-120)*10000 + 3*(gx + (1-vertical)*k)) / 10000D))"
    )
    return base.withColumn("geometry", geometry).drop("gx", "gy", "vertical", "n_pts")


def drawn_sidewalks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of kind sidewalk with a path of two points, from click events."""
    e = dealt(table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id"), "event_id").selectExpr("user_id % 25 as project_id", "event_id")
    start = "((project_id*4-50)*100000 + 30*((event_id*13)%48) + event_id%19)", "((project_id*10-120)*100000 + 30*((event_id*7)%46) + event_id%23)"
    path = f"array(named_struct('lat', {start[0]}/100000D, 'lng', {start[1]}/100000D), named_struct('lat', ({start[0]} + 5*(event_id%7))/100000D, 'lng', ({start[1]} + 60)/100000D))"
    return e.selectExpr("project_id", "event_id as edit_seq", "concat('e', event_id) as id", "'sidewalk' as type", f"{path} as path")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that look for streets: project_id, point_id, p, zoom."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_nationkey as bigint) as project_id", "c_custkey as point_id",
        "named_struct('lat', ((c_nationkey*4-50)*100000 + 30*((c_custkey*13)%48) + c_custkey%29)/100000D, 'lng', ((c_nationkey*10-120)*100000 + 30*((c_custkey*7)%48) + c_custkey%31)/100000D) as p",
        "cast(15 + c_custkey % 4 as double) as zoom",
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of every tool, drawn from a pin."""
    tools = "array('road','bike','sidewalk','crossing','roundabout','signal')"
    return pins(spark, sf_dir).selectExpr(
        "project_id", "point_id as draft_id", f"element_at({tools}, cast(point_id % 6 as int) + 1) as tool", "p as start",
        "named_struct('lat', p.lat + (point_id % 5) * 0.0003D, 'lng', p.lng + (point_id % 3) * 0.0002D) as end", "zoom",
    )


def roundabouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of kind roundabout, beside the pins of customers in machinery, so that no pin is equally far from all ring points."""
    makers = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("point_id"))
    return dealt(pins(spark, sf_dir).join(makers, "point_id", "left_semi"), "point_id").selectExpr("project_id", "point_id as edit_seq", "concat('r', point_id) as id", "'roundabout' as type", "named_struct('lat', p.lat + 0.00003D, 'lng', p.lng + 0.00007D) as center", "cast(12 + point_id % 20 as double) as pixel_radius", "zoom")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements with mixed tags: project_id, element_seq, type, id, tags, geometry with lon."""
    r = roads(spark, sf_dir).withColumn("m", F.expr("feature_id % 8"))
    tags = """case m when 0 then map('building', 'yes') when 1 then map('building', '', 'highway', kind) when 2 then map('building', 'house', 'highway', kind)
     when 3 then map('landuse', 'grass') when 4 then map('landuse', '', 'leisure', 'park') when 5 then map('name', 'x') when 6 then map('highway', kind) else map('leisure', 'pitch', 'highway', '') end"""
    return r.selectExpr("project_id", "feature_seq as element_seq", "case when feature_id % 31 = 0 then 'node' else 'way' end as type", "feature_id as id", f"{tags} as tags", "transform(geometry, g -> named_struct('lat', g.lat, 'lon', g.lng)) as geometry")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response body for each hundred orders of an area; some with a remark or an empty one, some broken, followed by text, of another kind, or with an element without a number."""
    e = elements(spark, sf_dir).withColumn("chunk", F.expr("element_seq div 400"))
    body = F.struct(F.array_sort(F.collect_list(F.struct("id", "type", F.map_entries("tags").alias("t"), "geometry"))).alias("all"), F.max(F.expr("case when chunk % 5 = 3 then 'timed out' when chunk % 13 = 4 then '' end")).alias("remark"))
    grouped = e.groupBy("project_id", "chunk").agg(body.alias("b"))
    listed = F.transform("b.all", lambda x: F.struct(x["type"].alias("type"), x["id"].alias("id"), F.map_from_entries(x["t"]).alias("tags"), x["geometry"].alias("geometry")))
    text = F.to_json(F.struct(listed.alias("elements"), F.col("b.remark").alias("remark")))
    start = '{"elements":['
    text = F.when(F.expr("chunk % 19 = 2"), F.concat(F.lit(start + '{"type":"way","id":"x"},'), F.substring(text, len(start) + 1, 1 << 30))).otherwise(text)
    odd = F.when(F.expr("chunk % 7 = 5"), F.lit("{not json")).when(F.expr("chunk % 11 = 7"), F.concat(text, F.lit(" trailing"))).when(F.expr("chunk % 17 = 9"), F.lit("[1]"))
    return grouped.select("project_id", "chunk", F.coalesce(odd, text).alias("value"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around each area's streets, every fifth broken in its own way."""
    base = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as area_id", "(n_nationkey*4-50)/1D as lat", "(n_nationkey*10-120)/1D as lng")
    return base.selectExpr(
        "area_id", "case area_id % 5 when 1 then lat - 0.01D when 2 then 95D when 3 then lat + 1D else lat + 0.009D end as north", "lat as south",
        "case when area_id % 5 = 4 then cast(null as double) else lng + 0.009D end as east", "lng as west",
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of many kinds, some kinds missing in some projects, some unknown."""
    kind = "element_at(array('road','bike','sidewalk','crossing','roundabout','signal','note'), cast(event_id % 7 as int) + 1)"
    # Some kinds are missing in some projects: notes stand in their place.
    kind = f"case when (user_id % 25 + event_id % 7) % 3 = 0 or user_id % 25 = 11 then 'note' else {kind} end"
    return table(spark, sf_dir, "events").selectExpr("user_id % 25 as project_id", "event_id as edit_seq", "concat('e', event_id) as id", f"{kind} as type")


def projects_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects as the analysis takes them: project_id, name, bbox."""
    return areas(spark, sf_dir).selectExpr("area_id as project_id", "case when area_id % 4 = 0 then ' \t\n' else concat('\n Area ', area_id, ' \u00a0') end as name", "named_struct('north', coalesce(north, south), 'south', south, 'east', coalesce(east, west), 'west', west) as bbox")


def store_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    box = f"cast(named_struct('north', c_custkey/10D, 'south', 0D, 'east', 1D, 'west', 0D) as {BBOX})"
    return c.selectExpr("concat('p', c_custkey) as id", "concat('u', c_custkey % 50) as user_id", "concat('Old ', c_custkey) as name", f"{box} as bbox", "timestamp'2024-01-01 00:00:00' as created_at", "timestampadd(MINUTE, cast(c_custkey % 1000 as int), timestamp'2024-01-01 00:00:00') as updated_at")


def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_projects(spark, sf_dir).selectExpr("id as project_id", "'{}' as osm_data", "'[]' as user_edits")


def save_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    box = f"cast(named_struct('north', case when o_orderkey % 17 = 0 then null else o_orderkey/10D end, 'south', 0D, 'east', 1D, 'west', 0D) as {BBOX})"
    return o.selectExpr(
        "o_orderkey as seq", "concat('u', (case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey - o_custkey % 3 end) % 50) as user_id",
        "case when o_orderkey % 3 = 0 then '' else concat('p', o_custkey - o_custkey % 3) end as id",
        "case when o_orderkey % 13 = 0 then ' \t\u3000\n' else concat('\t Plan ', o_orderkey, '\u00a0\n') end as name", f"{box} as bbox",
        "case when o_orderkey % 19 = 0 then null else '\n {\"roads\":[]}' end as osm_data", "concat('[', o_orderkey, ']') as user_edits",
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user: errors undo, signups redo, views remove what came before."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    action = F.expr("case event_type when 'error' then 'undo' when 'signup' then 'redo' when 'view' then 'remove' else 'add' end")
    edit = F.concat(F.lit("e"), F.when(F.col("event_type") == "view", before).otherwise(F.col("event_id")).cast("string"))
    return e.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), edit.alias("id"), F.lit("{}").alias("object"))
