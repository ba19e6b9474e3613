"""Record schemas, the edge bitmask and the constants of the selection rules."""

from __future__ import annotations

# Edge kinds, as bits.
REFERENCE = 1
INTERFACE_TO_IMPLEMENTATION = 2
VIRTUAL_TO_OVERRIDE = 4
DERIVED = 8
FIXTURE = 16
CONTAINMENT = 32
ATTRIBUTE = 64
DISPATCH_BY_REQUEST = 128
IMPLEMENTATION_TO_INTERFACE = 256
OVERRIDE_TO_VIRTUAL = 512
DISPATCH_BY_ROUTE = 1024

UPWARD = IMPLEMENTATION_TO_INTERFACE | OVERRIDE_TO_VIRTUAL
DOWNWARD = INTERFACE_TO_IMPLEMENTATION | VIRTUAL_TO_OVERRIDE
DISPATCH = DISPATCH_BY_REQUEST | DISPATCH_BY_ROUTE
#: A type does not flow along edges that hold only these bits.
NOT_FLOW = DOWNWARD | DISPATCH

# Limits of the selection rules.
GENERALISE_ROUNDS = 8
SATURATION = 96
COVERAGE_LIMIT = 0.6
FILTER_LENGTH_LIMIT = 200_000
FILTER_LENGTH_LIMIT_WINDOWS = 24_000
WAVE_FRACTION = 0.25
WAVE_LEAST_TESTS = 8
LEDGER_ROWS = 100
LEDGER_LEAST_RUNS = 3
EXTRA_INVOCATION_SECONDS = 1.5
SPLIT_MARGIN = 3.0
QUIET = "300 milliseconds"
REDIRECTS = 16
WHOLE_FILE = (1, 2_147_483_647)
# Folders of derived output.
OUTPUT_FOLDERS = ("bin", "obj", ".tidemark")

NODES = "key string, display string, kind string, project string, containing_type string, file string, ord int"
EDGES = "src string, dst string, kind int"
SITES = "project string, file string, start_line int, end_line int, key string, is_type boolean, is_inlined boolean"
PROJECTS = (
    "name string, assembly string, file string, dir string, output string, is_test boolean, framework string, "
    "runner string, props_evaluated boolean, declared_tfms array<string>"
)
DECLARED_TYPES = "type string, is_interface boolean, is_abstract boolean"
BASES = "type string, base string, args array<string>"
MEMBERS = (
    "member string, type string, name string, params array<string>, is_override boolean, is_overridable boolean, "
    "is_public boolean, explicit_of string, is_accessor boolean"
)
PROJECT_REFS = "project string, references string"
TESTS = (
    "symbol_key string, class_key string, namespace string, class_name string, method_name string, project string, "
    "framework string, is_parameterized boolean"
)
CHANGED_FILES = "path string, old_path string, kind string"
HUNKS = "path string, side string, start_line int, end_line int"
OLD_DECLS = (
    "project string, file string, start_line int, end_line int, is_type boolean, type_path string, member_name string"
)
REFLECTIONS = "project string, file string, description string, owner string, ord int"
ROUTES = "template string, owner string, is_endpoint boolean, project string, file string, line int"
TYPE_FACTS = "member string, obtained array<string>, is_unknown boolean"
FRAGMENTS = "project string, fingerprint string, content_hash string, surface_hash string, compile_error string"
GENERATED = "project string, hint string, base_text string, head_text string, in_compilation boolean"
OUTCOMES = "project string, test string, result string"
RUNS = (
    "at string, headCommit string, fullRun boolean, analysisSeconds double, suiteSeconds double, selectedTests int, "
    "totalTests int"
)
REPLAY = "commit string, subject string, selected int, total int, full_run boolean, widenings int, seconds double"
SAMPLES = (
    "index int, outcome string, misses array<string>, failing int, selected int, total int, first_failure int, "
    "ordered int, skip_reason string"
)
FILE_EVENTS = "path string, ts timestamp, lost boolean"
