"""Registered queries: each applies operators to streets and edits derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import edits as log
from ..operators import features, graph, increments, projects, proximity, routing, rules, saves, snapping, validate
from ..sources import chunks, layout, osm, schemas, store, versions
from ..sources.scratch import fresh_path
from ..sources.scratch import written as shared_table
from . import fixtures as fx

NOW = "2024-06-01 12:00:00"
D = 6  # decimals of compared coordinates


def _r(c: Column | str, digits: int = D) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def network_report(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.network_report(fx.roads(spark, sf))
    return out.select(F.col("project_id").alias("area_id"), "nodes", "edges", "dead_ends", "segments", "dead_end_segments", "with_sidewalk", "score", _r("total_length_m", 2).alias("length_m"))


def network_report_drawn(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.network_report(fx.roads(spark, sf), fx.drawn_sidewalks(spark, sf))
    return out.select(F.col("project_id").alias("area_id"), "segments", "with_sidewalk", "score")


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.graph_nodes(graph.road_segments(fx.roads(spark, sf)))
    return out.select(F.col("project_id").alias("area_id"), "node.lat_e6", "node.lng_e6", _r("point.lat").alias("lat"), _r("point.lng").alias("lng"))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.graph_edges(graph.road_segments(fx.roads(spark, sf)))
    return out.select(F.col("project_id").alias("area_id"), F.col("u.lat_e6").alias("u_lat"), F.col("u.lng_e6").alias("u_lng"), F.col("v.lat_e6").alias("v_lat"), F.col("v.lng_e6").alias("v_lng"), "feature_id", F.col("segment_index").cast("bigint").alias("segment_index"), "kind", "has_sidewalk", _r("length_m", 4).alias("length_m"))


def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.node_degrees(graph.road_segments(fx.roads(spark, sf)))
    return out.select(F.col("project_id").alias("area_id"), "node.lat_e6", "node.lng_e6", "degree")


def dead_end_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = graph.road_segments(fx.roads(spark, sf))
    out = graph.dead_end_segments(s, graph.dead_end_nodes(graph.node_degrees(s)))
    return out.select(F.col("project_id").alias("area_id"), "feature_id", F.col("segment_index").cast("bigint").alias("segment_index"))


def sidewalk_proximity(spark: SparkSession, sf: str) -> DataFrame:
    points = fx.roads(spark, sf).select("project_id", "feature_id", geo.point(F.col("geometry")[0]["lat"], F.col("geometry")[0]["lng"] + 0.0001).alias("p"))
    drawn = graph.explode_segments(fx.drawn_sidewalks(spark, sf).select("project_id", F.col("path").alias("geometry")))
    return proximity.within_distance(points, drawn).select(F.col("project_id").alias("area_id"), "feature_id").distinct()


def nearest_segment(spark: SparkSession, sf: str) -> DataFrame:
    out = proximity.nearest_segment(fx.pins(spark, sf), snapping.snap_segments(fx.roads(spark, sf)))
    return out.select("point_id", "feature_id", F.col("segment_index").cast("bigint").alias("segment_index"), _r("distance", 4).alias("distance"), _r("map_point.lat").alias("lat"), _r("map_point.lng").alias("lng"))


def nearest_vertex(spark: SparkSession, sf: str) -> DataFrame:
    out = proximity.nearest_vertex(fx.pins(spark, sf), fx.roads(spark, sf))
    return out.select("point_id", "feature_id", F.col("vertex_index").cast("bigint").alias("vertex_index"), _r("distance", 4).alias("distance"))


def nearest_node(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph.graph_nodes(graph.road_segments(fx.roads(spark, sf)))
    out = proximity.nearest_node(fx.pins(spark, sf), nodes)
    return out.select("point_id", "node.lat_e6", "node.lng_e6", _r("distance", 4).alias("distance"))


def nearest_ring_point(spark: SparkSession, sf: str) -> DataFrame:
    out = proximity.nearest_ring_point(fx.pins(spark, sf).withColumn("zoom", F.lit(16.0)), snapping.roundabout_ring(fx.roundabouts(spark, sf)))
    return out.select("point_id", "roundabout_id", F.col("ring_index").cast("bigint").alias("ring_index"), _r("distance", 3).alias("distance"))


def snap_drafts(spark: SparkSession, sf: str) -> DataFrame:
    out = snapping.snap_all(fx.drafts(spark, sf), fx.roads(spark, sf), fx.roundabouts(spark, sf))
    at = lambda c: [_r(f"{c}.lat").alias(f"{c}_lat"), _r(f"{c}.lng").alias(f"{c}_lng")]
    return out.select("draft_id", "type", F.size("path").alias("path_points"), "snapped", *at("anchor"), *at("center"), *at("point"), _r("pixel_vector.x", 3).alias("dx"), _r("pixel_vector.y", 3).alias("dy"), _r("pixel_radius", 3).alias("radius"))


def snap_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every point of every line that was drafted, in order."""
    out = snapping.snap_lines(fx.drafts(spark, sf), fx.roads(spark, sf), snapping.roundabout_ring(fx.roundabouts(spark, sf)))
    rows = out.select("draft_id", "snapped", F.posexplode("path").alias("position", "p"))
    return rows.select("draft_id", "snapped", F.col("position").cast("bigint").alias("position"), _r("p.lat").alias("lat"), _r("p.lng").alias("lng"))


def route_distances(spark: SparkSession, sf: str) -> DataFrame:
    s = graph.road_segments(fx.roads(spark, sf))
    sources = graph.graph_nodes(s).groupBy("project_id").agg(F.min("node").alias("node")).withColumn("route_id", F.col("project_id"))
    out = routing.shortest_distances(graph.adjacency(graph.graph_edges(s)), sources)
    return out.select(F.col("project_id").alias("area_id"), "node.lat_e6", "node.lng_e6", _r("distance_m", 3).alias("distance_m"))


def _route_asked(spark: SparkSession, sf: str) -> DataFrame:
    return fx.pins(spark, sf).withColumn("zoom", F.lit(16.0)).select(F.col("point_id").alias("route_id"), "project_id", F.col("p").alias("origin"), geo.point(F.col("p.lat") + 0.0009, F.col("p.lng") + 0.0006).alias("destination"), "zoom")


def route_request_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of every way that is asked for, with its point."""
    _, out = routing.route_with_ways(_route_asked(spark, sf), graph.build_graph(fx.roads(spark, sf)))
    return out.select("route_id", F.col("position").cast("bigint").alias("position"), "node.lat_e6", "node.lng_e6", _r("point.lat").alias("lat"), _r("point.lng").alias("lng"))


def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.route(_route_asked(spark, sf), graph.build_graph(fx.roads(spark, sf)))
    return out.select("route_id", "status", _r("distance_m", 3).alias("distance_m"), text.format_distance(F.col("distance_m")).alias("shown"))


def classify_elements(spark: SparkSession, sf: str) -> DataFrame:
    out = features.classify(fx.elements(spark, sf))
    return out.select(F.col("project_id").alias("area_id"), "feature_id", "feature_class", "kind", F.size("geometry").cast("bigint").alias("points"))


def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = osm.parse_responses(fx.responses(spark, sf))
    return validate.flag_no_roads(features.count_classes(features.classify(good), "project_id")).withColumnRenamed("project_id", "area_id")


def ingest_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = osm.parse_responses(fx.responses(spark, sf))
    return bad.select(F.col("project_id").alias("area_id"), "chunk", "reason", "remark", "element_seq")


def select_area(spark: SparkSession, sf: str) -> DataFrame:
    boxes = fx.areas(spark, sf).selectExpr("area_id", "south + 0.0061D as north", "south + 0.003D as south", "west + 0.0062D as east", "west + 0.004D as west")
    path = fresh_path(spark, "elements")
    layout.write_elements(fx.elements(spark, sf), path)
    return osm.select_stored(spark, path, boxes).select("area_id", F.col("id").alias("feature_id"))


def area_documents(spark: SparkSession, sf: str) -> DataFrame:
    feats = features.classify(fx.elements(spark, sf)).withColumnRenamed("project_id", "area_id")
    docs = osm.area_document(feats, fx.areas(spark, sf))
    count = lambda k: F.get_json_object("document", f"$.counts.{k}").cast("bigint")
    return docs.select("area_id", count("buildings").alias("buildings"), count("roads").alias("roads"), count("openLand").alias("open_land"))


def bbox_validation(spark: SparkSession, sf: str) -> DataFrame:
    b = F.struct("north", "south", "east", "west")
    return fx.areas(spark, sf).select("area_id", validate.bbox_reject_reason(b).alias("reason"), _r(geo.bbox_area_km2(b), 4).alias("area_km2"))


def bounds_geojson(spark: SparkSession, sf: str) -> DataFrame:
    b = F.when(F.col("east").isNotNull(), F.struct("north", "south", "east", "west"))
    doc = osm.bounds_geojson(b)
    return fx.areas(spark, sf).select("area_id", F.get_json_object(doc, "$.features[0].geometry.type").alias("shape"), _r(F.get_json_object(doc, "$.features[0].geometry.coordinates[0][2][1]").cast("double"), 4).alias("third_lat"), _r(F.get_json_object(doc, "$.features[0].geometry.coordinates[0][4][0]").cast("double"), 4).alias("last_lng"))


def geometry_functions(spark: SparkSession, sf: str) -> DataFrame:
    p, q = F.col("p"), geo.point(F.col("p.lat") + 0.001, F.col("p.lng") - 0.002)
    z = F.col("zoom")
    px, qx = geo.to_pixel(p, z), geo.to_pixel(q, z)
    box = geo.fit_canvas(p, F.struct((p["lat"] + 0.003).alias("north"), (p["lat"] - 0.001).alias("south"), (p["lng"] + 0.004).alias("east"), (p["lng"] - 0.002).alias("west")))
    m = geo.segment_metrics(px, qx)
    back = geo.from_pixel(px, z)
    mid = geo.lerp(p, q, F.lit(0.25))
    return fx.pins(spark, sf).select(
        "point_id", _r(geo.haversine_m(p, q), 3).alias("haversine_m"), _r(px["x"], 3).alias("px"), _r(px["y"], 3).alias("py"), _r(back["lat"]).alias("back_lat"), _r(back["lng"]).alias("back_lng"),
        _r(box["x"], 4).alias("canvas_x"), _r(box["y"], 4).alias("canvas_y"), _r(m["angle"], 4).alias("angle"), _r(m["length"], 3).alias("length"), _r(mid["lat"]).alias("mid_lat"),
        _r(geo.point_segment_m(p, q, geo.point(q["lat"], q["lng"] + 0.01)), 3).alias("segment_m"), text.format_distance(F.floor(geo.haversine_m(p, q) * F.col("point_id") % 300) * 10).alias("shown"), text.format_fixed(F.col("zoom"), 2).alias("zoom_2"),
    )


def canvas_points(spark: SparkSession, sf: str) -> DataFrame:
    feats = fx.roads(spark, sf).withColumnRenamed("project_id", "area_id")
    boxes = fx.areas(spark, sf).selectExpr("area_id", "south + 0.02D as north", "south", "west + 0.02D as east", "west")
    out = features.with_road_style(features.project_features(feats, boxes))
    return out.select("feature_id", "road_width", "road_colour", F.size("points").cast("bigint").alias("n"), _r(F.aggregate("points", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


def edit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.count_edits(fx.edits(spark, sf), fx.projects_in(spark, sf).select("project_id"))


def change_analysis(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.analyze(fx.projects_in(spark, sf), fx.edits(spark, sf), fx.roads(spark, sf))
    return out.select("project_id", "summary", *[F.concat_ws(",", c).alias(c) for c in ("safety", "pedestrian", "suggestions")])


def _saved(spark: SparkSession, sf: str):
    return projects.save_projects(fx.store_projects(spark, sf), fx.save_requests(spark, sf), F.lit(NOW))


def save_projects(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _saved(spark, sf)[0].select("id", "user_id", "name", _r("bbox.north", 2).alias("north"), stamp("created_at"), stamp("updated_at"))


def save_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf)[1].select("seq", "reject_reason")


def save_state(spark: SparkSession, sf: str) -> DataFrame:
    return projects.upsert_state(fx.store_state(spark, sf), _saved(spark, sf)[2])


def open_projects(spark: SparkSession, sf: str) -> DataFrame:
    asked = fx.table(spark, sf, "customer").selectExpr("concat('p', c_custkey) as id", "concat('u', c_custkey % 40) as user_id")
    return projects.open_projects(fx.store_projects(spark, sf), fx.store_state(spark, sf), asked).select("id", "user_id", "name", "osm_data")


def latest_projects(spark: SparkSession, sf: str) -> DataFrame:
    out = projects.latest_per_key(fx.store_projects(spark, sf).withColumn("at", F.struct("updated_at", "id")), ["user_id"], "at")
    return out.select("user_id", "id", "name")


def users_and_cascade(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.store_projects(spark, sf)
    # Users as they stood on the first morning; the requests bring others.
    users = p.where("updated_at < timestamp'2024-01-01 00:30:00'").selectExpr("user_id as id", "user_id as clerk_id", "cast(null as string) as email", "created_at").distinct()
    users = projects.ensure_users(users, fx.save_requests(spark, sf).select("user_id"), F.lit(NOW))
    gone = users.where("id like 'u1%'").selectExpr("id as user_id")
    left = projects.delete_users({"users": users, "projects": p, "state": fx.store_state(spark, sf)}, gone)
    return left["users"].select(F.lit("user").alias("what"), "id").unionByName(left["projects"].select(F.lit("project").alias("what"), "id")).unionByName(left["state"].select(F.lit("state").alias("what"), F.col("project_id").alias("id")))


def edit_replay(spark: SparkSession, sf: str) -> DataFrame:
    out = log.replay(fx.edit_log(spark, sf))
    ids = lambda c: F.concat_ws(",", F.transform(c, lambda e: e["id"])).alias(c)
    return out.select("project_id", ids("current"), ids("undone"))


def autosave_sessions(spark: SparkSession, sf: str) -> DataFrame:
    changes = fx.table(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("state"))
    out = log.autosave_points(changes)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("project_id", stamp("saved_at"), stamp("last_change"), "changes")


def changed_since_last(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("project_id"), "event_id", "event_type")
    return log.changed_since_last(e, "project_id", "event_type", "event_id").select("event_id", "changed")


def affected_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Areas whose graph grows when service roads are mapped too; one by one area has none yet."""
    now = fx.roads(spark, sf)
    return log.affected_projects(graph.network_report(now.where("kind <> 'service'")), graph.network_report(now))


def affected_by_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of every area after a batch of changes: service roads come, footways go, or roads come that are there already."""
    root = fresh_path(spark, "sizes")
    increments.create(spark, root)
    now = fx.roads(spark, sf)
    increments.apply_changes(now.where("kind <> 'service'").withColumn("action", F.lit("add")), root, 0)
    action = "case when project_id % 3 = 0 and kind = 'service' or project_id % 3 = 2 and kind = 'primary' then 'add' when project_id % 3 = 1 and kind = 'footway' then 'remove' end"
    out = increments.apply_changes(now.selectExpr("*", f"{action} as action").where("action is not null"), root, 1)
    return out.withColumnRenamed("project_id", "area_id")


def raw_drafts(spark: SparkSession, sf: str) -> DataFrame:
    out = geo.render_edits(snapping.raw_geometry(fx.drafts(spark, sf)))
    xy = lambda c: [_r(f"{c}.x", 2).alias(f"{c}_x"), _r(f"{c}.y", 2).alias(f"{c}_y")]
    return out.select("draft_id", "type", F.size("points").alias("numbers"), _r(F.get("points", F.lit(2)), 2).alias("last_x"), *xy("start"), *xy("end"), *xy("centre"), _r("radius", 3).alias("radius"), *xy("at"))


def analyze_rejects(spark: SparkSession, sf: str) -> DataFrame:
    full = '{"counts":{"roads":1},"roads":[],"buildings":[],"openLand":[]}'
    data = F.when(F.col("seq") % 5 == 0, '{"counts":{}}').when(F.col("seq") % 7 == 0, '{"roads":[],"buildings":[],"openLand":[]}').when(F.col("seq") % 11 == 0, "[]").otherwise(full)
    sent = F.when(F.col("seq") % 4 == 0, "{}").otherwise("[]")
    asked = fx.save_requests(spark, sf).withColumns({"osm_data": data, "user_edits": sent})
    return validate.analyze_reject_reason(asked).select("seq", "reject_reason")


def document_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature through its area's document in pieces of 64 KB and back."""
    feats = features.classify(fx.elements(spark, sf)).withColumnRenamed("project_id", "area_id")
    pieces = shared_table(chunks.document_chunks(feats, fx.areas(spark, sf), 64 << 10), "documents")
    return chunks.chunk_features(pieces).select("area_id", "feature_id", "feature_class", "kind", F.size("geometry").cast("bigint").alias("points"))


def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The store after a batch of saves, written as a snapshot and read back."""
    saved, _, accepted = _saved(spark, sf)
    root = fresh_path(spark, "store")
    users = projects.ensure_users(spark.createDataFrame([], schemas.USERS), saved.select("user_id"), F.lit(NOW))
    store.write_store({"users": users, "projects": saved.select("id", "user_id", "name", "bbox", "created_at", "updated_at"), "state": projects.upsert_state(fx.store_state(spark, sf), accepted)}, root)
    back = store.read_store(spark, root)
    own = back["projects"].join(back["users"].select(F.col("id").alias("user_id")), "user_id")
    return own.join(back["state"], own["id"] == back["state"]["project_id"]).select("id", "user_id", "name", "user_edits")


def store_commits(spark: SparkSession, sf: str) -> DataFrame:
    """The store of versions after two batches of saves, the removal of a fifth of the users and compaction."""
    root = fresh_path(spark, "versions")
    saves.create(spark, root, 32)
    old = fx.store_projects(spark, sf)
    users = projects.ensure_users(spark.createDataFrame([], schemas.USERS), old.select("user_id"), F.lit(NOW))
    versions.commit(spark, root, 0, {"users": users, "projects": old, "state": fx.store_state(spark, sf)})
    asked = fx.save_requests(spark, sf)
    middle = asked.agg(F.max("seq")).first()[0] // 2
    for batch in (asked.where(F.col("seq") <= middle), asked.where(F.col("seq") > middle)):
        saves.save_batch(spark, root, batch, F.lit(NOW))
    saves.remove_users(spark, root, versions.read(spark, root, "users").where("id like 'u1%'").selectExpr("id as user_id"))
    last = versions.compact(spark, root, 2)
    own = versions.read(spark, root, "projects", last).join(versions.read(spark, root, "users", last).select(F.col("id").alias("user_id")), "user_id")
    state = versions.read(spark, root, "state", last)
    return own.join(state, own["id"] == state["project_id"]).select("id", "user_id", "name", _r("bbox.north", 2).alias("north"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "user_edits")


def analysis_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = osm.analysis_document(rules.analyze(fx.projects_in(spark, sf), fx.edits(spark, sf), fx.roads(spark, sf)))
    of = lambda path: F.get_json_object("document", f"$.analysis.{path}")
    listed = lambda c: F.concat_ws(",", F.from_json(of(c), "array<string>")).alias(c)
    return docs.select("project_id", of("summary").alias("summary"), *[listed(c) for c in ("safety", "pedestrian", "suggestions")])


def document_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A document of features for every order, sound or broken in a way that follows from its priority."""
    feature = """concat('{"id":', case when o_orderpriority = '1-URGENT' then concat('"', o_orderkey, '"') else cast(o_orderkey as string) end, case when o_orderpriority = '2-HIGH' then ',"kind":7' else ',"kind":"house"' end,
     case when o_orderpriority = '3-MEDIUM' then ',"geometry":{}' else ',"geometry":[{"lat":1.5,"lng":2}]' end, '}')"""
    counts = """case when o_orderstatus = 'P' then '' else ',"counts":{"roads":1}' end"""
    doc = f"""concat('{{"bbox":{{"north":1}}', {counts}, ',"buildings":[', {feature}, '],"roads":[],"openLand":[]}}')"""
    out = fx.table(spark, sf, "orders").selectExpr("o_orderkey", f"{doc} as document")
    return out.select("o_orderkey", validate.json_document_is_valid(F.col("document")).alias("valid"))


def gestures(spark: SparkSession, sf: str) -> DataFrame:
    return validate.keep_gestures(fx.drafts(spark, sf)).select("draft_id")


def drawn_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes dragged from every pin: those that may be asked for, with their bounds and those bounds' box."""
    p = geo.to_pixel(F.col("p"), F.col("zoom"))
    boxes = fx.pins(spark, sf).withColumn("side", F.expr("cast(point_id % 600 as double)")).select("point_id", "zoom", p.alias("p"), geo.pixel(p["x"] - F.col("side"), p["y"] + F.col("side") / 2).alias("q"))
    out = validate.keep_boxes(boxes).withColumn("again", geo.box_from_bounds(F.col("bounds"), F.col("zoom")))
    return out.select("point_id", *[_r(f"bounds.{s}").alias(s) for s in ("north", "south", "east", "west")], _r("again.width", 2).alias("width"), _r("again.height", 2).alias("height"))


def event_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", text.format_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


def near_own_path(spark: SparkSession, sf: str) -> DataFrame:
    """Is a place beside each draft within 18 m of the draft's own line?"""
    d = fx.drafts(spark, sf)
    beside = geo.point(F.col("start.lat") + 0.0001, F.col("start.lng") + F.col("draft_id") % 7 * 0.00005)
    corner = geo.point(F.col("start.lat"), F.col("end.lng"))
    return d.select("draft_id", geo.any_within(beside, F.array("start", corner, "end"), proximity.SIDEWALK_M).alias("near"))


def user_projects(spark: SparkSession, sf: str) -> DataFrame:
    return projects.list_projects(fx.store_projects(spark, sf), "u7").select("id", "name", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def one_project(spark: SparkSession, sf: str) -> DataFrame:
    return projects.get_project(fx.store_projects(spark, sf), fx.store_state(spark, sf), "p7", "u7").select("id", "user_id", "name", "osm_data")


def last_edits(spark: SparkSession, sf: str) -> DataFrame:
    return log.last_edit(log.replay(fx.edit_log(spark, sf))).select("project_id", F.col("last.id").alias("last_id"))


def provider_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Who shall analyse: asked for by every event, in its own spelling."""
    provider = F.expr("case event_type when 'click' then 'rules' when 'view' then 'RULES' when 'error' then null else event_type end")
    return fx.table(spark, sf, "events").select("event_id", rules.provider_reject_reason(provider).alias("reject_reason"))


def route_ways(spark: SparkSession, sf: str) -> DataFrame:
    """The way from each area's first node to every node in reach: its nodes and the length of its edges."""
    s = graph.road_segments(fx.roads(spark, sf))
    edges = shared_table(graph.graph_edges(s), "way-edges")
    sources = graph.graph_nodes(s).groupBy("project_id").agg(F.min("node").alias("node")).withColumn("route_id", F.col("project_id"))
    labels = shared_table(routing.shortest_distances(graph.adjacency(edges), sources), "way-labels")
    # The farthest node of each area is its target; the larger node of equally far ones.
    target = labels.groupBy("route_id", "project_id").agg(F.max_by("node", F.struct(F.round("distance_m", 3), "node")).alias("node"))
    out = routing.path_lengths(routing.route_paths(labels, target), edges)
    return out.select(F.col("route_id").alias("area_id"), _r("length_m", 2).alias("length_m"))


QUERIES = {
    f.__name__: f
    for f in (
        network_report, network_report_drawn, graph_nodes, graph_edges, node_degrees, dead_end_segments, sidewalk_proximity, nearest_segment, nearest_vertex, nearest_node, nearest_ring_point,
        snap_drafts, snap_paths, route_distances, route_requests, route_request_ways, classify_elements, ingest_counts, ingest_quarantine, select_area, area_documents, bbox_validation, bounds_geojson, geometry_functions,
        canvas_points, edit_counts, change_analysis, save_projects, save_rejects, save_state, open_projects, latest_projects, users_and_cascade, edit_replay, autosave_sessions,
        changed_since_last, affected_projects, affected_by_changes, raw_drafts, analyze_rejects, document_round_trip, store_round_trip, store_commits, analysis_documents, document_checks,
        gestures, drawn_boxes, event_stamps, near_own_path, user_projects, one_project, last_edits, provider_rejects, route_ways,
    )
}
