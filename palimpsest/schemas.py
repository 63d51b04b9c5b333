"""Row schemas, enumerations and the constants that define the comparison's semantics."""

from __future__ import annotations

ADDED, DELETED, MODIFIED, UNCHANGED = "added", "deleted", "modified", "unchanged"
STATES = (ADDED, DELETED, MODIFIED, UNCHANGED)
VECTOR, RASTER, XKT, MIXED, UNAVAILABLE = "vector", "raster", "xkt", "mixed", "unavailable"
READY, FAILED, PENDING = "ready", "failed", "pending"
TIER_STABLE, TIER_GEOMETRY, TIER_NONE = "stable-id", "geometry", "none"
GEOMETRY, PROPERTY = "geometry", "property"
OUTCOMES = ("computed", "cached", "unsupported", "no_predecessor", "too_large", "failed", "error")

# Other settings give other results.
POSITION_GRID = 0.5
SIZE_GRID = 0.5
LINE_WIDTH_GRID = 0.1
VOTE_GRID = 1.0
MOVE_TOLERANCE = 0.75
RELOCATE_DISTANCE = 72.0
LEAST_CONFIDENCE = 0.6
MOST_LCS_CELLS = 4_000_000
VERTEX_GRID = 1e-4
NEARNESS = 0.02
MASK_THRESHOLD = 16
MOST_TEXT_LINES = 2000
SNIFF_BYTES = 8192
MOST_SOURCE_BYTES = 256 << 20
KEY_CHARS = 32
DEDUPE_EVENTS = 4096
PERMISSION_SECONDS = 300
MOST_TREE_DEPTH = 64
MOST_PENDING = 64

HANDLED_EVENTS = ("file.updated", "file.deleted")
GOVERNANCE_EVENTS = ("acl.changed", "role.assigned", "role.member_removed", "role.deleted")

VERSION = "file_uid string, version string, ord int, name string, mime string, content binary"
POINTS = "array<struct<x:double,y:double>>"
PAGE_OBJECT = f"kind string, signature string, x double, y double, style string, text string, size double, points {POINTS}, ops array<string>, idx int"
PAGE = "page int, width double, height double, has_raster boolean, unknown_ops array<string>"
ELEMENT = "stable_id string, local_id string, name string, type_name string, verts array<double>, faces array<int>, properties map<string,string>, idx int"
EVENT = "type string, event_id string, tenant string, file_uid string, version string, is_rendition boolean, is_folder boolean, member string"
UNITS = "array<struct<index:int,kind:string,mode:string>>"
FAILURE = "struct<reason:string,stage:string,tiers_attempted:array<string>>"
MANIFEST = f"base_version string, expected array<string>, failure {FAILURE}, file_uid string, key string, mode string, plugin string, plugin_version int, schema int, status string, target_version string, units {UNITS}"
