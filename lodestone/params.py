"""Rule tables and limits.  Small and bounded, so they go into plans as literals."""

from __future__ import annotations

# File extensions and special names to languages.
LANGUAGE_BY_NAME = {"go.mod": "go", "package.json": "json"}
LANGUAGE_BY_EXTENSION = {
    ".go": "go", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".rs": "rust", ".swift": "swift", ".rb": "ruby", ".cs": "csharp",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".py": "python", ".php": "php",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
BUILD_FILES = ("go.mod", "package.json", "composer.json", "pom.xml", "build.gradle", "settings.gradle")

# Ranks of confidence and coverage.
CONFIDENCE_RANK = {"EXACT": 9, "RESOLVED": 8, "MATCHED": 7, "EXTRACTED": 6, "NORMALIZED": 5, "INFERRED": 4, "WEAK": 3, "UNKNOWN": 2}
COVERAGE_RANK = {"COMPLETE": 4, "PARTIAL": 3, "UNAVAILABLE": 2, "FAILED": 1}
RESOLUTIONS = ("MATCHED", "PARTIAL", "UNRESOLVED", "OUT_OF_SCOPE")
SEVERITIES = ("INFO", "WARNING", "ERROR")
CAPABILITIES = ("symbols", "relations", "calls", "routes", "api_clients", "tests", "persistence", "messaging", "data_flow")

# Prefixes that gateways add, and base segments that services are mounted under.
GATEWAY_PREFIXES = ("api", "rest", "backend", "proxy", "gateway")
TYPE_LITERALS = ("new", "changed", "guidance")

# Limits.
MAX_FILE_BYTES = 512 * 1024
REACH_CAP = 100
FACTS_PER_NODE = 24
CONSUMERS_PER_SERVICE = 5
TOP = 10
