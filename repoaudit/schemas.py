"""Schemas of the tables that come in and go out."""

# ``content`` is binary as read from disk, or text that was decoded before.
SOURCE_FILES = "repo string, path string, content binary"
REPOSITORIES = "repo string, root string, found boolean"

REGISTRY_DOCS = (
    "registry string, name string, doc string, lookup_status string, lookup_error string"
)

SIMILAR = "array<struct<name:string,distance:int>>"
DEPENDENCY_FINDINGS = (
    "repo string, file_ord int, pos bigint, package string, source_file string, "
    "registry string, exists boolean, version string, typosquat_risk string, "
    f"typosquat_similar_to {SIMILAR}, age_days int"
)
SECURITY_FINDINGS = (
    "repo string, file string, line_number int, category string, category_ord int, "
    "severity string, code_snippet string, description string"
)
API_FINDINGS = (
    "repo string, file string, line_number int, walk_ord int, module string, "
    "called_function string, exists_in_api boolean, suggestion string"
)
