"""SQL with the same results as the registered queries, for an engine that only has the given tables.

Distances are compared by brute force there: every point against every street
of its area.
"""

from __future__ import annotations

from .fixtures import KIND, SIDEWALK

_ROADS = f"""roads as (select cast(c_nationkey as bigint) as area_id, o_orderkey as feature_id, {KIND} as kind, {SIDEWALK} as sidewalk,
 (o_orderkey*31) % 48 as gx, (o_orderkey*17 + o_custkey) % 48 as gy, o_orderkey % 2 as vertical, cast(2 + o_orderkey % 4 as int) as n_pts
 from orders join customer on o_custkey = c_custkey)"""


def _lat(k: str) -> str:
    return f"((area_id*4-50)*10000 + 3*(gy + vertical*({k}))) / 10000.0::double"


def _lng(k: str) -> str:
    return f"((area_id*10-120)*10000 + 3*(gx + (1-vertical)*({k}))) / 10000.0::double"


def _e6(c: str) -> str:
    return f"cast(cast({c} as decimal(20,6))*1000000 as bigint)"


def _haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c}-({a}))/2), 2) + cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2), 2))"
    return f"6371000*2*atan2(sqrt({h}), sqrt(1-{h}))"


#: All consecutive pairs of points, of every road.
_PAIRS = f"""pairs as (select *, {_lat('k')} as a_lat, {_lng('k')} as a_lng, {_lat('k+1')} as b_lat, {_lng('k+1')} as b_lng
 from (select *, unnest(range(0, n_pts - 1)) as k from roads))"""
_SEGMENTS = f"""{_ROADS}, {_PAIRS}, segs as (select *, {_e6('a_lat')} as ka, {_e6('a_lng')} as kb, {_e6('b_lat')} as kc, {_e6('b_lng')} as kd,
 {_haversine('a_lat', 'a_lng', 'b_lat', 'b_lng')} as len, (kind in ('footway','path','pedestrian','steps','living_street') or coalesce(sidewalk,'') not in ('','no','none','separate')) as sw
 from pairs where kind not in ('construction','proposed','abandoned','raceway')),
 nbr as (select distinct area_id, ka as u, kb as v, kc as w, kd as x from segs union select distinct area_id, kc, kd, ka, kb from segs),
 deg as (select area_id, u as lat_e6, v as lng_e6, count(*) as degree from nbr group by all)"""
_EDGES = """edges as (select area_id, least((ka,kb),(kc,kd)) as lo, greatest((ka,kb),(kc,kd)) as hi, arg_max(struct_pack(f := feature_id, k := k, kind := kind, len := len, sw := sw), (feature_id, k)) as last
 from segs group by area_id, least((ka,kb),(kc,kd)), greatest((ka,kb),(kc,kd)))"""

_EDITS_AT = "((user_id % 25)*4-50)*100000 + 30*((event_id*13)%48) + event_id%19", "((user_id % 25)*10-120)*100000 + 30*((event_id*7)%46) + event_id%23"
_DRAWN = f"""drawn as (select user_id % 25 as area_id, ({_EDITS_AT[0]})/100000.0::double as s_lat, ({_EDITS_AT[1]})/100000.0::double as s_lng,
 ({_EDITS_AT[0]} + 5*(event_id%7))/100000.0::double as e_lat, ({_EDITS_AT[1]} + 60)/100000.0::double as e_lng from events where event_type = 'click')"""


def _segment_m(plat: str, plng: str) -> str:
    """Metres from a point to the drawn segment d."""
    ref = f"cos(radians(({plat} + d.s_lat + d.e_lat)/3))"
    px, py, ax, ay, bx, by = f"({plng}*111320*{ref})", f"({plat}*111320)", f"(d.s_lng*111320*{ref})", "(d.s_lat*111320)", f"(d.e_lng*111320*{ref})", "(d.e_lat*111320)"
    dx, dy = f"({bx}-{ax})", f"({by}-{ay})"
    t = f"greatest(0.0, least(1.0, coalesce((({px}-{ax})*{dx} + ({py}-{ay})*{dy}) / nullif({dx}*{dx}+{dy}*{dy}, 0), 0.0)))"
    return f"sqrt(pow({ax}+{dx}*{t}-{px}, 2) + pow({ay}+{dy}*{t}-{py}, 2))"


_PINS = """pins as (select cast(c_nationkey as bigint) as area_id, c_custkey as point_id, ((c_nationkey*4-50)*100000 + 30*((c_custkey*13)%48) + c_custkey%29)/100000.0::double as lat,
 ((c_nationkey*10-120)*100000 + 30*((c_custkey*7)%48) + c_custkey%31)/100000.0::double as lng, cast(15 + c_custkey % 4 as double) as zoom from customer)"""


def _px(lng: str, zoom: str) -> str:
    return f"(pow(2.0, {zoom})*512*({lng} + 180)/360)"


def _py(lat: str, zoom: str) -> str:
    return f"(pow(2.0, {zoom})*512*(0.5 - ln(tan(pi()/4 + radians({lat})/2))/(2*pi())))"


def _nearest(places: str, px: float, order: str, zoom: str = "p.zoom") -> str:
    """Nearest row of ``places`` (area_id, lat, lng and more) for every pin."""
    d = f"sqrt(pow({_px('c.lng', zoom)}-{_px('p.lng', zoom)}, 2) + pow({_py('c.lat', zoom)}-{_py('p.lat', zoom)}, 2))"
    return f"""near as (select * from (select p.point_id, c.*, {d} as distance, row_number() over (partition by p.point_id order by {d}, {order}) as rn
 from pins p join {places} c on p.area_id = c.area_id where {d} <= {px}) where rn = 1)"""


_KINDS = "['road','bike','sidewalk','crossing','roundabout','signal','note']"
_EDITS = f"""edits as (select user_id % 25 as project_id, event_id, case when (user_id % 25 + event_id % 7) % 3 = 0 or user_id % 25 = 11 then 'note' else {_KINDS}[event_id % 7 + 1] end as type from events)"""
_AREAS = """areas as (select area_id, case area_id % 5 when 1 then lat - 0.01 when 2 then 95 when 3 then lat + 1 else lat + 0.009 end::double as north, lat as south,
 case when area_id % 5 = 4 then null else lng + 0.009 end::double as east, lng as west
 from (select cast(n_nationkey as bigint) as area_id, (n_nationkey*4-50)::double as lat, (n_nationkey*10-120)::double as lng from nation))"""
_AREA_KM2 = "abs(east-west)*111.32*cos(radians((north+south)/2))*abs(north-south)*111.32"
_COUNTS = ", ".join(f"count(*) filter (type = '{k}') as {k}_edits" for k in ("sidewalk", "bike", "crossing", "signal", "roundabout", "road"))
_EDIT_COUNTS = f"""counted as (select n.n_nationkey::bigint as project_id, {_COUNTS}, count(type) as total_edits from nation n left join edits e on e.project_id = n.n_nationkey group by 1)"""

_ELEMENTS = f"""{_ROADS}, elements as (select area_id, feature_id, feature_id % 8 as m, kind as hw, n_pts from roads where feature_id % 31 <> 0),
 feats as (select area_id, feature_id, n_pts, case when m in (0, 2) then 'building' when m in (1, 6) then 'road' else 'open_land' end as feature_class,
 case m when 0 then 'yes' when 2 then 'house' when 1 then hw when 6 then hw when 3 then 'grass' when 4 then '' else 'pitch' end as kind from elements where m <> 5)"""

_STORE = "store as (select 'p' || c_custkey as id, 'u' || c_custkey % 50 as user_id, 'Old ' || c_custkey as name, c_custkey/10.0::double as north, timestamp '2024-01-01 00:00:00' as created_at, timestamp '2024-01-01 00:00:00' + to_minutes(c_custkey % 1000) as updated_at from customer)"
_REQUESTS = """requests as (select o_orderkey as seq, 'u' || (case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey - o_custkey % 3 end) % 50 as user_id,
 case when o_orderkey % 3 = 0 then null else 'p' || (o_custkey - o_custkey % 3) end as id, case when o_orderkey % 13 = 0 then '' else 'Plan ' || o_orderkey end as name,
 case when o_orderkey % 17 = 0 then null else o_orderkey/10.0::double end as north, case when o_orderkey % 19 = 0 then null else chr(10) || ' {"roads":[]}' end as osm_data, '[' || o_orderkey || ']' as user_edits from orders),
 checked as (select r.*, case when r.name = '' then 'NO_NAME' when r.north is null then 'BAD_BBOX' when r.osm_data is null then 'NO_OSM_DATA' when r.id is not null and s.id is null then 'NOT_FOUND' end as reason
 from requests r left join store s on s.id = r.id and s.user_id = r.user_id),
 accepted as (select * from (select *, coalesce(id, substring(sha256(user_id || '|' || seq), 1, 32)) as pid, row_number() over (partition by coalesce(id, substring(sha256(user_id || '|' || seq), 1, 32)) order by seq desc) as rn from checked where reason is null) where rn = 1)"""

_ROUTES = f"""with recursive {_SEGMENTS}, {_EDGES},
 adj as (select area_id, lo[1] as u, lo[2] as v, hi[1] as w, hi[2] as x, last.len as len from edges union all select area_id, hi[1], hi[2], lo[1], lo[2], last.len from edges),
 src as (select area_id, lat_e6, lng_e6 from (select *, row_number() over (partition by area_id order by lat_e6, lng_e6) as rn from deg) where rn = 1),
 reach(area_id, lat_e6, lng_e6, d) using key (area_id, lat_e6, lng_e6) as (
 select area_id, lat_e6, lng_e6, 0.0::double from src union
 select n.area_id, n.w, n.x, n.d from (select a.area_id, a.w, a.x, min(r.d + a.len) as d from reach r join adj a on a.area_id = r.area_id and a.u = r.lat_e6 and a.v = r.lng_e6 group by all) n
 left join recurring.reach o on o.area_id = n.area_id and o.lat_e6 = n.w and o.lng_e6 = n.x where o.d is null or n.d < o.d)"""

def _lat_of(y: str, zoom: str) -> str:
    return f"degrees(atan(sinh(pi()*(1 - 2*({y})/(pow(2.0, {zoom})*512)))))"


def _lng_of(x: str, zoom: str) -> str:
    return f"(({x})*360/(pow(2.0, {zoom})*512) - 180)"


_RING = f"""ring as (select area_id, point_id as seq, k, {_lat_of(f"{_py('lat', 'zoom')} + sin(k*pi()/4)*(12 + point_id % 20)", 'zoom')} as lat, {_lng_of(f"{_px('lng', 'zoom')} + cos(k*pi()/4)*(12 + point_id % 20)", 'zoom')} as lng
 from (select p.area_id, p.point_id, p.zoom, p.lat + 0.00003 as lat, p.lng + 0.00007 as lng, unnest(range(0, 8)) as k from pins p semi join (select c_custkey as point_id from customer where c_mktsegment = 'MACHINERY') m on m.point_id = p.point_id))"""
_DRAFTS = f"""drafts as (select *, ['road','bike','sidewalk','crossing','roundabout','signal'][point_id % 6 + 1] as type, lat + (point_id % 5)*0.0003 as lat2, lng + (point_id % 3)*0.0002 as lng2 from pins),
 drawn as (select *, {_px('lng', 'zoom')} as x, {_py('lat', 'zoom')} as y, {_px('lng2', 'zoom')} as x2, {_py('lat2', 'zoom')} as y2 from drafts),
 asks as (select point_id, area_id, zoom, 0 as side, x, y from drawn where type in ('road','bike','sidewalk') union all select point_id, area_id, zoom, 1, x2, y2 from drawn where type in ('road','bike','sidewalk')
 union all select point_id, area_id, zoom, 2, (x+x2)/2, (y+y2)/2 from drawn where type = 'crossing'),
 lines as (select a.*, c.feature_id, c.k, c.a_lat, c.a_lng, c.b_lat, c.b_lng, {_px('a_lng', 'a.zoom')} as ax, {_py('a_lat', 'a.zoom')} as ay, {_px('b_lng', 'a.zoom')} as bx, {_py('b_lat', 'a.zoom')} as by_ from asks a join pairs c on a.area_id = c.area_id),
 ts as (select *, greatest(0.0, least(1.0, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/(pow(bx-ax,2)+pow(by_-ay,2)))) as t from lines),
 ds as (select *, sqrt(pow(ax+(bx-ax)*t-x,2)+pow(ay+(by_-ay)*t-y,2)) as d from ts),
 roadsnap as (select * from (select *, row_number() over (partition by point_id, side order by d, feature_id, k) as rn from ds where d <= 34) where rn = 1),
 ringsnap as (select * from (select a.point_id, a.side, r.lat, r.lng, row_number() over (partition by a.point_id, a.side order by sqrt(pow({_px('r.lng', 'a.zoom')}-a.x, 2)+pow({_py('r.lat', 'a.zoom')}-a.y, 2)), r.seq, r.k) as rn
 from asks a join ring r on r.area_id = a.area_id where a.side < 2 and sqrt(pow({_px('r.lng', 'a.zoom')}-a.x, 2)+pow({_py('r.lat', 'a.zoom')}-a.y, 2)) <= 46) where rn = 1),
 both_ends as (select d.*, r0.lat as r0_lat, r0.lng as r0_lng, r1.lat as r1_lat, r1.lng as r1_lng, s0.feature_id as f0, s1.feature_id as f1, s0.k as i, s1.k as j, s0.a_lat+(s0.b_lat-s0.a_lat)*s0.t as s0_lat, s0.a_lng+(s0.b_lng-s0.a_lng)*s0.t as s0_lng,
 s1.a_lat+(s1.b_lat-s1.a_lat)*s1.t as s1_lat, s1.a_lng+(s1.b_lng-s1.a_lng)*s1.t as s1_lng from drawn d left join ringsnap r0 on r0.point_id = d.point_id and r0.side = 0 left join ringsnap r1 on r1.point_id = d.point_id and r1.side = 1
 left join roadsnap s0 on s0.point_id = d.point_id and s0.side = 0 left join roadsnap s1 on s1.point_id = d.point_id and s1.side = 1 where d.type in ('road','bike','sidewalk')),
 kinds as (select *, case when r0_lat is not null or r1_lat is not null then 'ring' when f0 = f1 then 'road' else 'raw' end as how from both_ends),
 path as (select point_id, how, 0 as position, case how when 'ring' then coalesce(r0_lat, s0_lat, lat) when 'road' then s0_lat else lat end as lat, case how when 'ring' then coalesce(r0_lng, s0_lng, lng) when 'road' then s0_lng else lng end as lng from kinds
 union all select point_id, how, case when how = 'road' then abs(i-j) else 0 end + 1, case how when 'ring' then coalesce(r1_lat, s1_lat, lat2) when 'road' then s1_lat else lat2 end, case how when 'ring' then coalesce(r1_lng, s1_lng, lng2) when 'road' then s1_lng else lng2 end from kinds
 union all select q.point_id, q.how, case when q.i <= q.j then v.k - q.i else q.i - v.k + 1 end, v.lat, v.lng from kinds q join vertices v on v.feature_id = q.f0 and v.k between least(q.i, q.j) + 1 and greatest(q.i, q.j) where q.how = 'road')"""
_VERTICES = f"vertices as (select area_id, feature_id, k, {_lat('k')} as lat, {_lng('k')} as lng from (select *, unnest(range(0, n_pts)) as k from roads))"
_SNAPS = f"with {_ROADS}, {_PAIRS}, {_PINS}, {_VERTICES}, {_RING}, {_DRAFTS}"

#: Requests with the nodes nearest to both ends, and all distances from both: by brute force, over whole areas.
_ASKED = f"""{_SEGMENTS}, {_EDGES}, {_PINS}, ends as (select area_id, ka, kb, a_lat as lat, a_lng as lng, feature_id, k, 0 as e from segs union all select area_id, kc, kd, b_lat, b_lng, feature_id, k, 1 from segs),
 places as (select area_id, (ka, kb) as node, arg_max(lat, (feature_id, k, e)) as lat, arg_max(lng, (feature_id, k, e)) as lng, min((feature_id, k, e)) as seq from ends group by all),
 asked as (select area_id, point_id as route_id, 0 as side, lat, lng from pins union all select area_id, point_id, 1, lat + 0.0009, lng + 0.0006 from pins),
 far as (select a.route_id, a.side, a.area_id, c.node, c.seq, sqrt(pow({_px('c.lng', '16.0')}-{_px('a.lng', '16.0')}, 2) + pow({_py('c.lat', '16.0')}-{_py('a.lat', '16.0')}, 2)) as px from asked a join places c on c.area_id = a.area_id and abs(c.lat - a.lat) < 0.002 and abs(c.lng - a.lng) < 0.002),
 picked as (select route_id, any_value(area_id) as area_id, arg_min(node, (px, seq)) filter (side = 0) as source, arg_min(node, (px, seq)) filter (side = 1) as target from far where px <= 42 group by route_id),
 adj as (select area_id, (lo[1], lo[2]) as u, (hi[1], hi[2]) as v, last.len as len from edges union all select area_id, (hi[1], hi[2]), (lo[1], lo[2]), last.len from edges),
 tree as (select distinct area_id, source as root from picked where source <> target union select distinct area_id, target from picked where source <> target),
 reach(area_id, root, node, d) using key (area_id, root, node) as (
 select area_id, root, root, 0.0::double from tree union
 select n.area_id, n.root, n.v, n.d from (select a.area_id, r.root, a.v, min(r.d + a.len) as d from reach r join adj a on a.area_id = r.area_id and a.u = r.node group by all) n
 left join recurring.reach o on o.area_id = n.area_id and o.root = n.root and o.node = n.v where o.d is null or n.d < o.d),
 answers as (select p.route_id, p.area_id, p.source, p.target, r.d as distance_m from picked p left join reach r on r.area_id = p.area_id and r.root = p.source and r.node = p.target and p.source <> p.target)"""
_ROUTE_ANSWERS = f"""with recursive {_ASKED} select p.point_id as route_id, case when source is null or target is null then 'NO_NODE' when source = target then 'SAME_NODE' when distance_m is null then 'NO_ROUTE' else 'OK' end as status,
 round(distance_m, 3) as distance_m, case when distance_m >= 1000 then printf('%.2f km', distance_m/1000) else cast(floor(distance_m + 0.5) as bigint) || ' m' end as shown from pins p left join answers a on a.route_id = p.point_id"""
_ROUTE_WAYS = f"""with recursive {_ASKED}, ok as (select * from answers where distance_m is not null),
 middle as (select route_id, any_value(area_id) as area_id, any_value(source) as source, any_value(target) as target, arg_min(node, (-round(d0, 3), node)) as node from
 (select o.*, a.node, a.d as d0 from ok o join reach a on a.area_id = o.area_id and a.root = o.source join reach b on b.area_id = o.area_id and b.root = o.target and b.node = a.node where a.d + b.d <= o.distance_m + 1e-4 and 2*a.d <= o.distance_m + 1e-4) group by route_id),
 pred as (select v.area_id, v.root, v.node, min(a.v) as pred from (select r.* from reach r semi join (select area_id, source as root from ok union select area_id, target from ok) t on t.area_id = r.area_id and t.root = r.root) v join adj a on a.area_id = v.area_id and a.u = v.node join reach w on w.area_id = v.area_id and w.root = v.root and w.node = a.v where w.d + a.len <= v.d + 1e-4 group by all),
 walk as (select route_id, area_id, 0 as side, source as root, node, 0 as hops from middle union all select route_id, area_id, 1, target, node, 0 from middle union all
 select w.route_id, w.area_id, w.side, w.root, p.pred, w.hops + 1 from walk w join pred p on p.area_id = w.area_id and p.root = w.root and p.node = w.node),
 tops as (select route_id, max(hops) as top from walk where side = 0 group by 1)
 select w.route_id, case when side = 0 then top - hops else top + hops end::bigint as position, w.node[1] as lat_e6, w.node[2] as lng_e6, round(lat, 6) as lat, round(lng, 6) as lng
 from walk w join tops using (route_id) join places c on c.area_id = w.area_id and c.node = w.node where side = 0 or hops > 0"""

_REPLAY = """with recursive log as (select user_id as project_id, row_number() over w as n, case event_type when 'error' then 'undo' when 'signup' then 'redo' when 'view' then 'remove' else 'add' end as action,
 'e' || case when event_type = 'view' then lag(event_id) over w else event_id end as id from events window w as (partition by user_id order by event_id)),
 state as (select project_id, 0::bigint as n, []::varchar[] as current, []::varchar[] as undone from (select distinct project_id from log) union all
 select s.project_id, l.n, case when action = 'add' then list_append(current, l.id) when action = 'remove' then list_filter(current, lambda x: x is distinct from l.id) when action = 'undo' and len(current) > 0 then current[:-2]
 when action = 'redo' and len(undone) > 0 then list_append(current, undone[-1]) else current end,
 case when action in ('add', 'remove') then []::varchar[] when action = 'undo' and len(current) > 0 then list_append(undone, current[-1]) when action = 'redo' and len(undone) > 0 then undone[:-2] else undone end
 from state s join log l on l.project_id = s.project_id and l.n = s.n + 1),
 done as (select * from state qualify row_number() over (partition by project_id order by n desc) = 1)"""

ORACLES: dict[str, str] = {
    "network_report": f"""with {_SEGMENTS},
 dead as (select s.area_id, count(*) as n from segs s join deg a on a.area_id = s.area_id and a.lat_e6 = ka and a.lng_e6 = kb join deg b on b.area_id = s.area_id and b.lat_e6 = kc and b.lng_e6 = kd where a.degree <= 1 or b.degree <= 1 group by 1),
 shape as (select area_id, count(*) as nodes, cast(sum(degree)/2 as bigint) as edges, count(*) filter (degree <= 1) as dead_ends from deg group by 1)
 select s.area_id, nodes, edges, dead_ends, count(*) as segments, coalesce(any_value(dead.n), 0) as dead_end_segments, count(*) filter (sw) as with_sidewalk, cast(round(count(*) filter (sw)/count(*)*100) as int) as score, round(sum(len), 2) as length_m
 from segs s join shape using (area_id) left join dead using (area_id) group by all""",
    "network_report_drawn": f"""with {_SEGMENTS}, {_DRAWN}, flagged as (select s.*, sw or exists (select 1 from drawn d where d.area_id = s.area_id and {_segment_m('((s.a_lat+s.b_lat)/2)', '((s.a_lng+s.b_lng)/2)')} <= 18) as near from segs s)
 select area_id, count(*) as segments, count(*) filter (near) as with_sidewalk, cast(round(count(*) filter (near)/count(*)*100) as int) as score from flagged group by 1""",
    "graph_nodes": f"""with {_SEGMENTS}, ends as (select area_id, ka, kb, a_lat as lat, a_lng as lng, feature_id, k, 0 as e from segs union all select area_id, kc, kd, b_lat, b_lng, feature_id, k, 1 from segs)
 select area_id, ka as lat_e6, kb as lng_e6, round(arg_max(lat, (feature_id, k, e)), 6) as lat, round(arg_max(lng, (feature_id, k, e)), 6) as lng from ends group by all""",
    "graph_edges": f"""with {_SEGMENTS}, {_EDGES} select area_id, lo[1] as u_lat, lo[2] as u_lng, hi[1] as v_lat, hi[2] as v_lng, last.f as feature_id, last.k as segment_index, last.kind as kind, last.sw as has_sidewalk, round(last.len, 4) as length_m from edges""",
    "node_degrees": f"with {_SEGMENTS} select * from deg",
    "dead_end_segments": f"""with {_SEGMENTS} select s.area_id, s.feature_id, s.k as segment_index from segs s join deg a on a.area_id = s.area_id and a.lat_e6 = ka and a.lng_e6 = kb join deg b on b.area_id = s.area_id and b.lat_e6 = kc and b.lng_e6 = kd where a.degree <= 1 or b.degree <= 1""",
    "sidewalk_proximity": f"""with {_ROADS}, {_DRAWN} select distinct r.area_id, r.feature_id from (select area_id, feature_id, {_lat('0')} as lat, {_lng('0')} + 0.0001 as lng from roads) r join drawn d on d.area_id = r.area_id where {_segment_m('r.lat', 'r.lng')} <= 18""",
    "nearest_segment": f"""with {_ROADS}, {_PAIRS}, {_PINS}, xy as (select p.point_id, c.feature_id, c.k, c.a_lat, c.a_lng, c.b_lat, c.b_lng, {_px('p.lng', 'p.zoom')} as x, {_py('p.lat', 'p.zoom')} as y,
 {_px('a_lng', 'p.zoom')} as ax, {_py('a_lat', 'p.zoom')} as ay, {_px('b_lng', 'p.zoom')} as bx, {_py('b_lat', 'p.zoom')} as by_ from pins p join pairs c on p.area_id = c.area_id),
 ts as (select *, greatest(0.0, least(1.0, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/(pow(bx-ax,2)+pow(by_-ay,2)))) as t from xy),
 ds as (select *, sqrt(pow(ax+(bx-ax)*t-x,2)+pow(ay+(by_-ay)*t-y,2)) as d from ts), best as (select * from (select *, row_number() over (partition by point_id order by d, feature_id, k) as rn from ds where d <= 34) where rn = 1)
 select p.point_id, feature_id, k as segment_index, round(d, 4) as distance, round(a_lat+(b_lat-a_lat)*t, 6) as lat, round(a_lng+(b_lng-a_lng)*t, 6) as lng from pins p left join best using (point_id)""",
    "nearest_vertex": f"""with {_ROADS}, {_PINS}, vertices as (select area_id, feature_id, k, {_lat('k')} as lat, {_lng('k')} as lng from (select *, unnest(range(0, n_pts)) as k from roads)), {_nearest('vertices', 44, 'c.feature_id, c.k')}
 select p.point_id, feature_id, k as vertex_index, round(distance, 4) as distance from pins p left join near using (point_id)""",
    "nearest_node": f"""with {_SEGMENTS}, {_PINS}, ends as (select area_id, ka, kb, a_lat as lat, a_lng as lng, feature_id, k, 0 as e from segs union all select area_id, kc, kd, b_lat, b_lng, feature_id, k, 1 from segs),
 places as (select area_id, ka as lat_e6, kb as lng_e6, arg_max(lat, (feature_id, k, e)) as lat, arg_max(lng, (feature_id, k, e)) as lng, min((feature_id, k, e)) as seq from ends group by all), {_nearest('places', 42, 'c.seq')}
 select p.point_id, lat_e6, lng_e6, round(distance, 4) as distance from pins p left join near using (point_id)""",
    "route_distances": f"{_ROUTES} select area_id, lat_e6, lng_e6, round(d, 3) as distance_m from reach",
    "classify_elements": f"with {_ELEMENTS} select area_id, feature_id, feature_class, kind, cast(n_pts as bigint) as points from feats",
    "ingest_counts": f"""with {_ELEMENTS} select area_id, count(*) filter (feature_class = 'building') as building_count, count(*) filter (feature_class = 'road') as road_count, count(*) filter (feature_class = 'open_land') as open_land_count,
 count(*) filter (feature_class = 'road') = 0 as no_roads from feats where (feature_id // 400) % 5 <> 3 and (feature_id // 400) % 7 <> 5 and (feature_id // 400) % 11 <> 7 and (feature_id // 400) % 17 <> 9 group by 1""",
    "ingest_quarantine": f"""with {_ROADS}, chunks as (select distinct area_id, feature_id // 400 as chunk from roads),
 told as (select *, case when chunk % 7 = 5 or chunk % 11 = 7 then 'BAD_JSON' when chunk % 17 = 9 then 'NOT_OBJECT' when chunk % 5 = 3 then 'REMARK' when chunk % 19 = 2 then 'BAD_ELEMENT' end as reason from chunks)
 select area_id, chunk, reason, case when reason = 'REMARK' then 'timed out' end as remark, case when reason = 'BAD_ELEMENT' then 0 end::int as element_seq from told where reason is not null""",
    "area_documents": f"""with {_ELEMENTS} select n_nationkey::bigint as area_id, count(*) filter (feature_class = 'building') as buildings, count(*) filter (feature_class = 'road') as roads, count(*) filter (feature_class = 'open_land') as open_land
 from nation left join feats on n_nationkey = area_id group by 1""",
    "bbox_validation": f"""with {_AREAS} select area_id, case when east is null then 'BAD_SHAPE' when south >= north or west >= east then 'BAD_ORDER' when north > 90 or south < -90 or east > 180 or west < -180 then 'OUT_OF_RANGE' when {_AREA_KM2} > 5 then 'TOO_LARGE' end as reason, round({_AREA_KM2}, 4) as area_km2 from areas""",
    "bounds_geojson": f"""with {_AREAS} select area_id, case when east is not null then 'Polygon' end as shape, case when east is not null then round(south, 4) end as third_lat, case when east is not null then round(west, 4) end as last_lng from areas""",
    "select_area": f"""with {_ROADS}, pts as (select area_id, feature_id, {_lat('0')} as lat, {_lng('0')} as lng, {_lat('n_pts-1')} as lat2, {_lng('n_pts-1')} as lng2 from roads where feature_id % 31 <> 0 and feature_id % 8 <> 5)
 select area_id, feature_id from pts where lat <= (area_id*4-50) + 0.0061 and lat2 >= (area_id*4-50) + 0.003 and lng <= (area_id*10-120) + 0.0062 and lng2 >= (area_id*10-120) + 0.004""",
    "canvas_points": f"""with {_ROADS}, xy as (select feature_id, kind, n_pts, least(1088/0.02, 708/0.02) as sc, {_lat('k')} as lat, {_lng('k')} as lng, (area_id*4-50)::double as south, (area_id*10-120)::double as west from (select *, unnest(range(0, n_pts)) as k from roads))
 select feature_id, case when kind in ('motorway','trunk','primary') then 8.0 when kind in ('secondary','tertiary') then 5.0 when kind in ('residential','unclassified','service') then 3.0 else 1.6 end::double as road_width,
 case when kind in ('footway','path','pedestrian','cycleway') then '#5f6866' else '#2d3332' end as road_colour, cast(2*any_value(n_pts) as bigint) as n,
 round(sum((1200 - 0.02*sc)/2 + (lng - west)*sc + (820 - 0.02*sc)/2 + (south + 0.02 - lat)*sc), 3) as total from xy group by feature_id, kind""",
    "edit_counts": f"with {_EDITS}, {_EDIT_COUNTS} select * from counted",
    "change_analysis": f"""with {_EDITS}, {_EDIT_COUNTS}, {_ROADS}, {_AREAS}, n as (select area_id, count(*) as r from roads group by 1),
 x as (select c.*, coalesce(n.r, 0) as r, case when c.project_id % 4 = 0 then 'This project' else 'Area ' || c.project_id end as name,
 abs(coalesce(east,west)-west)*111.32*cos(radians((coalesce(north,south)+south)/2))*abs(coalesce(north,south)-south)*111.32 as km2 from counted c left join n on n.area_id = c.project_id join areas a on a.area_id = c.project_id),
 y as (select *, list_filter([
 case when sidewalk_edits > 0 then sidewalk_edits || ' sidewalk' || case when sidewalk_edits = 1 then '' else 's' end end, case when bike_edits > 0 then bike_edits || ' bike lane' || case when bike_edits = 1 then '' else 's' end end,
 case when crossing_edits > 0 then crossing_edits || ' crossing' || case when crossing_edits = 1 then '' else 's' end end, case when signal_edits > 0 then signal_edits || ' traffic signal' || case when signal_edits = 1 then '' else 's' end end,
 case when roundabout_edits > 0 then roundabout_edits || ' roundabout' || case when roundabout_edits = 1 then '' else 's' end end, case when road_edits > 0 then road_edits || ' road or lane' || case when road_edits = 1 then '' else 's' end end], lambda z: z is not null) as parts from x)
 select project_id, case when total_edits = 0 then name || ': nothing drawn yet, ' || r || ' mapped roads' else name || ': adds ' || coalesce(array_to_string(parts, ', '), '') || ' among ' || r || ' mapped roads' end as summary,
 coalesce(nullif(array_to_string(list_filter([case when crossing_edits > 0 then 'SAFE_CROSSING' end, case when signal_edits > 0 then 'SAFE_SIGNAL' end, case when roundabout_edits > 0 then 'SAFE_ROUNDABOUT' end, case when bike_edits > 0 then 'SAFE_BIKE' end,
 case when crossing_edits = 0 and (sidewalk_edits > 0 or bike_edits > 0) and r > 10 then 'SAFE_NO_CROSSING' end], lambda z: z is not null), ','), ''), 'SAFE_DEFAULT') as safety,
 coalesce(array_to_string(list_filter([case when sidewalk_edits > 0 then 'PED_SIDEWALK' end, case when crossing_edits > 0 then 'PED_CROSSING' end, case when signal_edits > 0 then 'PED_SIGNAL' end,
 case when sidewalk_edits = 0 and crossing_edits = 0 and r > 0 then 'PED_LIMITED' end], lambda z: z is not null), ','), '') as pedestrian,
 coalesce(nullif(array_to_string(list_filter([case when sidewalk_edits > 0 and crossing_edits = 0 then 'SUG_CROSS_AT_ENDS' end, case when bike_edits > 0 and signal_edits = 0 and crossing_edits = 0 then 'SUG_BIKE_CONFLICT' end, case when roundabout_edits > 0 then 'SUG_RB_SETBACK' end,
 case when r > 40 and sidewalk_edits < 2 then 'SUG_MORE_SIDEWALK' end, case when km2 > 2 then 'SUG_SMALLER_AREA' end], lambda z: z is not null), ','), ''), 'SUG_DEFAULT') as suggestions from y""",
    "save_projects": f"""with {_STORE}, {_REQUESTS} select coalesce(s.id, a.pid) as id, coalesce(s.user_id, a.user_id) as user_id, coalesce(a.name, s.name) as name, round(coalesce(a.north, s.north), 2) as north,
 strftime(coalesce(s.created_at, timestamp '2024-06-01 12:00:00'), '%Y-%m-%d %H:%M:%S') as created_at, strftime(case when a.pid is not null then timestamp '2024-06-01 12:00:00' else s.updated_at end, '%Y-%m-%d %H:%M:%S') as updated_at
 from store s full join accepted a on a.pid = s.id""",
    "save_rejects": f"with {_STORE}, {_REQUESTS} select seq, reason as reject_reason from checked where reason is not null",
    "save_state": f"""with {_STORE}, {_REQUESTS} select coalesce(s.id, a.pid) as project_id, coalesce(a.osm_data, '{{}}') as osm_data, coalesce(a.user_edits, '[]') as user_edits from store s full join accepted a on a.pid = s.id""",
    "open_projects": f"with {_STORE} select 'p' || c_custkey as id, 'u' || c_custkey % 40 as user_id, s.name, case when s.id is not null then '{{}}' end as osm_data from customer left join store s on s.id = 'p' || c_custkey and s.user_id = 'u' || c_custkey % 40",
    "latest_projects": f"with {_STORE} select user_id, id, name from (select *, row_number() over (partition by user_id order by updated_at desc, id desc) as rn from store) where rn = 1",
    "users_and_cascade": f"""with {_STORE}, {_REQUESTS}, users as (select user_id as id from store where updated_at < timestamp '2024-01-01 00:30:00' union select user_id from requests)
 select 'user' as what, id from users where id not like 'u1%' union all select 'project', id from store where user_id not in (select id from users where id like 'u1%') union all select 'state', id from store where user_id not in (select id from users where id like 'u1%')""",
    "autosave_sessions": """with g as (select user_id, ts, event_id, case when ts - lag(ts) over w < interval 120 second then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
 s as (select *, sum(new) over (partition by user_id order by ts, event_id) as n from g)
 select user_id as project_id, strftime(max(ts) + interval 120 second, '%Y-%m-%d %H:%M:%S') as saved_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_change, count(*) as changes from s group by user_id, n""",
    "changed_since_last": "select event_id, event_type is distinct from lag(event_type) over (partition by user_id order by event_id) as changed from events",
    "affected_projects": f"""with {_SEGMENTS}, size as (select area_id, s, count(distinct n) as nodes, count(distinct e) as edges from (
 select area_id, s, unnest([(ka, kb), (kc, kd)]) as n, least((ka,kb),(kc,kd)) as lo, greatest((ka,kb),(kc,kd)) as hi, (lo, hi) as e from segs, (values (0), (1)) t(s) where s = 1 or kind <> 'service') group by 1, 2)
 select coalesce(a.area_id, b.area_id) as project_id from (from size where s = 0) b full join (from size where s = 1) a on a.area_id = b.area_id where (a.nodes, a.edges) is distinct from (b.nodes, b.edges)""",
    "affected_by_changes": f"""with {_SEGMENTS}, chosen as (select area_id, s, (ka, kb) as p, (kc, kd) as q from segs, (values (0), (1)) t(s)
 where case when s = 0 or area_id % 3 = 2 then kind <> 'service' when area_id % 3 = 0 then true else kind not in ('service', 'footway') end),
 ends as (select distinct area_id, s, p as node, q as other from chosen union select distinct area_id, s, q, p from chosen),
 size as (select area_id, s, count(*) as nodes, cast(sum(degree) / 2 as bigint) as edges, count(*) filter (where degree <= 1) as dead_ends from (select area_id, s, node, count(*) as degree from ends group by 1, 2, 3) group by 1, 2)
 select area_id, b.nodes as nodes_before, b.edges as edges_before, a.nodes, a.edges, a.dead_ends, a.nodes <> b.nodes or a.edges <> b.edges as affected from (from size where s = 0) b join (from size where s = 1) a using (area_id)""",
    "geometry_functions": f"""with {_PINS}, q as (select *, lat + 0.001 as qlat, lng - 0.002 as qlng from pins), g as (select *, {_px('lng', 'zoom')} as px, {_py('lat', 'zoom')} as py, {_px('qlng', 'zoom')} as qx, {_py('qlat', 'zoom')} as qy, {_haversine('lat', 'lng', 'qlat', 'qlng')} as hav,
 least(1088/((lng+0.004)-(lng-0.002)), 708/((lat+0.003)-(lat-0.001))) as sc from q)
 select point_id, round(hav, 3) as haversine_m, round(px, 3) as px, round(py, 3) as py, round(lat, 6) as back_lat, round(lng, 6) as back_lng,
 round((1200-((lng+0.004)-(lng-0.002))*sc)/2 + (lng-(lng-0.002))*sc, 4) as canvas_x, round((820-((lat+0.003)-(lat-0.001))*sc)/2 + ((lat+0.003)-lat)*sc, 4) as canvas_y,
 round(degrees(atan2(qy-py, qx-px)), 4) as angle, round(greatest(26.0, sqrt(pow(qx-px,2)+pow(qy-py,2))), 3) as length, round(lat + (qlat-lat)*0.25, 6) as mid_lat,
 round(sqrt(pow(0.001*111320, 2) + pow(greatest(0.0, 0.0 - 0.002)*111320, 2)), 3) as segment_m,
 case when floor(hav*point_id % 300)*10 >= 1000 then printf('%.2f km', floor(hav*point_id % 300)/100) else cast(floor(hav*point_id % 300)*10 as bigint) || ' m' end as shown, printf('%.2f', zoom) as zoom_2 from g""",
    "raw_drafts": f"""with {_PINS}, d as (select *, ['road','bike','sidewalk','crossing','roundabout','signal'][point_id % 6 + 1] as type, lat + (point_id % 5)*0.0003 as lat2, lng + (point_id % 3)*0.0002 as lng2 from pins),
 g as (select *, {_px('lng', 'zoom')} as x, {_py('lat', 'zoom')} as y, {_px('lng2', 'zoom')} as x2, {_py('lat2', 'zoom')} as y2 from d)
 select point_id as draft_id, type, case when type in ('road','bike','sidewalk') then 4 end::int as numbers, case when type in ('road','bike','sidewalk') then round(x2, 2) end as last_x,
 case when type = 'crossing' then round(x, 2) end as start_x, case when type = 'crossing' then round(y, 2) end as start_y, case when type = 'crossing' then round(x2, 2) end as end_x, case when type = 'crossing' then round(y2, 2) end as end_y,
 case when type = 'roundabout' then round(x, 2) end as centre_x, case when type = 'roundabout' then round(y, 2) end as centre_y, case when type = 'roundabout' then round(greatest(12.0, sqrt(pow(x2-x, 2)+pow(y2-y, 2))), 3) end as radius,
 case when type = 'signal' then round(x, 2) end as at_x, case when type = 'signal' then round(y, 2) end as at_y from g""",
    "analyze_rejects": f"""with {_STORE}, {_REQUESTS} select seq, case when north is null then 'BAD_BBOX' when seq % 5 = 0 or seq % 7 = 0 or seq % 11 = 0 then 'NO_OSM_DATA' when seq % 4 = 0 then 'BAD_EDITS' end as reject_reason from requests""",
    "store_round_trip": f"""with {_STORE}, {_REQUESTS} select coalesce(s.id, a.pid) as id, coalesce(s.user_id, a.user_id) as user_id, coalesce(a.name, s.name) as name, coalesce(a.user_edits, '[]') as user_edits from store s full join accepted a on a.pid = s.id""",
    "store_commits": f"""with {_STORE}, {_REQUESTS} select coalesce(s.id, a.pid) as id, coalesce(s.user_id, a.user_id) as user_id, coalesce(a.name, s.name) as name, round(coalesce(a.north, s.north), 2) as north,
 strftime(coalesce(s.created_at, timestamp '2024-06-01 12:00:00'), '%Y-%m-%d %H:%M:%S') as created_at, coalesce(a.user_edits, '[]') as user_edits from store s full join accepted a on a.pid = s.id where coalesce(s.user_id, a.user_id) not like 'u1%'""",
    "document_checks": "select o_orderkey, o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') and o_orderstatus <> 'P' as valid from orders",
    "gestures": f"""with {_PINS}, g as (select *, {_px('lng', 'zoom')} as x, {_py('lat', 'zoom')} as y, {_px('(lng + (point_id % 3)*0.0002)', 'zoom')} as x2, {_py('(lat + (point_id % 5)*0.0003)', 'zoom')} as y2 from pins)
 select point_id as draft_id from g where sqrt(pow(x2-x, 2) + pow(y2-y, 2)) >= 6""",
    "drawn_boxes": f"""with {_PINS}, g as (select *, {_px('lng', 'zoom')} as x, {_py('lat', 'zoom')} as y, (point_id % 600)::double as side, pow(2.0, zoom)*512 as world from pins where point_id % 600 >= 16),
 b as (select *, lat as north, lng as east, (x - side)*360/world - 180 as west, degrees(atan(sinh(pi()*(1 - 2*(y + side/2)/world)))) as south from g)
 select point_id, round(north, 6) as north, round(south, 6) as south, round(east, 6) as east, round(west, 6) as west, round(side, 2) as width, round(side/2, 2) as height from b where {_AREA_KM2} <= 5""",
    "event_stamps": "select event_id, strftime(ts, '%b %-d, %Y, %-I:%M %p') as stamp from events",
    "near_own_path": f"""with {_PINS}, g as (select point_id, lat + 0.0001 as blat, lng + (point_id % 7)*0.00005 as blng, lat as lat1, lng as lng1, lat + (point_id % 5)*0.0003 as lat2, lng + (point_id % 3)*0.0002 as lng2 from pins),
 d as (select point_id, blat, blng, unnest([{{'s_lat': lat1, 's_lng': lng1, 'e_lat': lat1, 'e_lng': lng2}}, {{'s_lat': lat1, 's_lng': lng2, 'e_lat': lat2, 'e_lng': lng2}}]) as d from g)
 select point_id as draft_id, bool_or({_segment_m('blat', 'blng')} <= 18) as near from d group by 1""",
    "user_projects": f"with {_STORE} select id, name, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated_at from store where user_id = 'u7'",
    "one_project": f"with {_STORE} select id, user_id, name, '{{}}' as osm_data from store where id = 'p7' and user_id = 'u7'",
    "edit_replay": f"{_REPLAY} select project_id, array_to_string(current, ',') as current, array_to_string(undone, ',') as undone from done",
    "last_edits": f"{_REPLAY} select project_id, current[-1] as last_id from done",
    "provider_rejects": "select event_id, case when event_type not in ('click', 'view', 'error') then 'UNKNOWN_PROVIDER' end as reject_reason from events",
    "nearest_ring_point": f"""with {_PINS}, {_RING}, {_nearest('(select *, seq as ring_seq from ring)', 46, 'c.seq, c.k', '16.0')} select p.point_id, 'r' || near.seq as roundabout_id, near.k as ring_index, round(distance, 3) as distance from pins p left join near using (point_id)""",
    "snap_paths": f"{_SNAPS} select point_id as draft_id, how <> 'raw' as snapped, position::bigint as position, round(lat, 6) as lat, round(lng, 6) as lng from path",
    "snap_drafts": f"""{_SNAPS}, {_nearest('vertices', 44, 'c.feature_id, c.k')}, sizes as (select point_id, count(*)::int as n, bool_or(how <> 'raw') as snapped from path group by 1),
 crossed as (select d.point_id, d.zoom, case when s.point_id is null then d.x else ax+(bx-ax)*t + (by_-ay)/len*half end as fx, case when s.point_id is null then d.y else ay+(by_-ay)*t - (bx-ax)/len*half end as fy,
 case when s.point_id is null then d.x2 else ax+(bx-ax)*t - (by_-ay)/len*half end as tx, case when s.point_id is null then d.y2 else ay+(by_-ay)*t + (bx-ax)/len*half end as ty
 from (select *, greatest(30.0, sqrt(pow(x2-x, 2)+pow(y2-y, 2)))/2 as half from drawn where type = 'crossing') d left join (select point_id, ax, ay, bx, by_, t, sqrt(pow(bx-ax, 2)+pow(by_-ay, 2)) as len from roadsnap where side = 2) s using (point_id))
 select d.point_id as draft_id, d.type, n as path_points, snapped, round({_lat_of('fy', 'c.zoom')}, 6) as anchor_lat, round({_lng_of('fx', 'c.zoom')}, 6) as anchor_lng,
 case when d.type = 'roundabout' then round(coalesce(near.lat, d.lat), 6) end as center_lat, case when d.type = 'roundabout' then round(coalesce(near.lng, d.lng), 6) end as center_lng,
 case when d.type = 'signal' then round(d.lat, 6) end as point_lat, case when d.type = 'signal' then round(d.lng, 6) end as point_lng, round(tx - fx, 3) as dx, round(ty - fy, 3) as dy,
 case when d.type = 'roundabout' then round(greatest(12.0, sqrt(pow(x2-x, 2)+pow(y2-y, 2))), 3) end as radius
 from drawn d left join sizes using (point_id) left join crossed c using (point_id) left join near on near.point_id = d.point_id""",
    "route_requests": _ROUTE_ANSWERS,
    "route_request_ways": _ROUTE_WAYS,
    "route_ways": f"{_ROUTES} select area_id, round(max(d), 2) as length_m from reach group by 1",
    "document_round_trip": f"with {_ELEMENTS} select area_id, feature_id, feature_class, kind, cast(n_pts as bigint) as points from feats",
}

ORACLES["analysis_documents"] = ORACLES["change_analysis"]
