"""Tables of the index, as DDL strings, and their enumerations."""

FILES = "path string, language string, size_bytes long, line_count int, content_hash string, parse_state string, parse_error string, indexed_at long, mtime_ms double, token_estimate int"
ENTITIES = (
    "id string, type string, name string, qualified_name string, language string, file_path string, parent_id string, start_line int, end_line int, start_byte int, end_byte int, "
    "signature string, documentation string, exported boolean, fingerprint string, token_estimate int, literals string, metadata string"
)
RELATIONS = "source_id string, target_id string, target_hint string, type string, resolution string, confidence double, file_path string, line int, metadata string"
RELATION_KEY = ["source_id", "type", "target_hint", "line", "file_path"]
META = "key string, value string"
RELATION_METADATA = "names array<string>, expression string, cjs boolean"

SCHEMA_VERSION = 1
PARSE_STATES = ("OK", "PARSE_ERROR", "UNSUPPORTED_LANGUAGE", "SKIPPED_BINARY", "SKIPPED_TOO_LARGE", "SKIPPED_SECRET", "SKIPPED_IGNORED")
ANALYSED = ("OK", "PARSE_ERROR")
RESOLUTIONS = ("EXACT", "SCOPED", "AMBIGUOUS", "UNRESOLVED")
