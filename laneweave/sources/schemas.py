"""Schemas of the tables that the operators take and give."""

POINT = "struct<lat:double,lng:double>"
PIXEL = "struct<x:double,y:double>"
BBOX = "struct<north:double,south:double,east:double,west:double>"

ELEMENT = "type string, id bigint, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"

FEATURES = f"area_id bigint, feature_seq int, feature_class string, feature_id bigint, kind string, tags map<string,string>, geometry array<{POINT}>"
AREAS = "area_id bigint, north double, south double, east double, west double"
EDIT = f"id string, type string, path array<{POINT}>, snapped boolean, anchor {POINT}, pixel_vector {PIXEL}, center {POINT}, pixel_radius double, point {POINT}, zoom double"
EDITS = f"project_id bigint, edit_seq int, {EDIT}"
DRAFTS = f"project_id bigint, draft_id bigint, tool string, start {POINT}, end {POINT}, zoom double"
USERS = "id string, clerk_id string, email string, created_at timestamp"
PROJECTS = f"id string, user_id string, name string, bbox {BBOX}, created_at timestamp, updated_at timestamp"
STATE = "project_id string, osm_data string, user_edits string"
SAVE_REQUESTS = f"seq bigint, user_id string, id string, name string, bbox {BBOX}, osm_data string, user_edits string"
EDIT_LOG = "project_id bigint, seq bigint, ts timestamp, action string, id string, object string"
