"""Schemas of the engine's tables."""

NODES = "id string, name string, type string, lang string, path string, folder string, start_line int, end_line int, is_exported boolean, indexed_at long"
EDGES = "source_id string, target_id string, type_relation string, source_line int"
FILE_EDGES = "source_path string, target_path string, type string, line int, module string"
SIGNATURE_PARAMS = "file_path string, version string, name string, position int, param string, type string, is_optional boolean"
CHANGE_EVENTS = "path string, event_type string, ts timestamp"

NODE_TYPES = ("function", "class", "method", "interface", "type", "variable")
RELATIONS = ("CALLS", "INHERITS", "IMPLEMENTS", "USES")
STUB = "@@external:"
