"""Word lists, maps and limits that results depend on.

Everything in this module is data, not logic. Each value can be replaced by the
caller through the keyword arguments of the functions that use it.
"""

# Extension -> language of files that are indexed (case-sensitive).
INDEX_LANGUAGES = {
    ".go": "go",
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".java": "java",
    ".swift": "swift",
}

# Lower-cased extension -> display language.
DISPLAY_LANGUAGES = {
    ".go": "go",
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".rs": "rust",
    ".java": "java",
    ".swift": "swift",
    ".ml": "ocaml",
    ".mli": "ocaml",
    ".c": "c",
    ".cpp": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".sql": "sql",
}

# Lower-cased extension -> symbol-parser group.
PARSER_LANGUAGES = {
    ".go": "go",
    ".py": "python",
    ".ts": "typescript/javascript",
    ".tsx": "typescript/javascript",
    ".js": "typescript/javascript",
    ".jsx": "typescript/javascript",
    ".rs": "rust",
    ".java": "java",
    ".swift": "swift",
    ".ml": "ocaml",
    ".mli": "ocaml",
}

# Directory names that are never descended into; names starting with "." are skipped as well.
SKIP_DIRS = (
    ".", "..", ".git", ".github", "vendor",
    "__pycache__", ".pytest_cache", "venv", "env", ".venv",
    "node_modules", ".next", "dist", "build", ".vscode",
    "target", ".gradle",
    "bin", "pkg",
    ".build", "Pods", ".xcodeproj", ".xcworkspace",
)

# Per-language ignore patterns ("dir/", "*.ext" or a plain suffix).
IGNORE_PATTERNS = {
    "go": [
        "bin/", "vendor/", "*.o", "*.a", "*.so", "*.exe", "*.dll", "*.dylib",
        "*.test", "dist/", "build/", "coverage/", "*.out", ".env", ".env.local",
    ],
    "python": [
        "__pycache__/", "*.pyc", "*.pyo", ".pyc", ".pyo",
        "venv/", ".venv/", "env/", ".env/", "ENV/",
        "*.egg-info/", "dist/", "build/", ".pytest_cache/", ".tox/",
        "htmlcov/", ".coverage", "*.egg",
    ],
    "javascript": [
        "node_modules/", "dist/", "build/", ".next/", ".nuxt/",
        "coverage/", "npm-debug.log", "yarn-error.log", ".env.local",
        "*.min.js", "*.min.css", ".parcel-cache/", ".cache/",
    ],
    "typescript": [
        "node_modules/", "dist/", "build/", ".next/", ".nuxt/",
        "coverage/", "npm-debug.log", "yarn-error.log", ".env.local",
        "*.min.js", "*.min.css", ".parcel-cache/", ".cache/",
    ],
    "java": [
        "target/", ".gradle/", ".settings/", "bin/", "out/",
        "*.class", "*.jar", ".classpath", ".project", ".vscode/",
        "*.swp", "build/", ".idea/",
    ],
    "swift": [
        ".build/", "Pods/", ".xcodeproj/", ".xcworkspace/",
        "Carthage/", "DerivedData/", "*.xcarchive", ".swiftpm/",
        "build/", "dist/",
    ],
}

# Symbol kind number -> name (1-based, in protocol order).
SYMBOL_KINDS = (
    "file", "module", "namespace", "package", "class", "method", "property", "field",
    "constructor", "enum", "interface", "function", "variable", "constant", "string",
    "number", "boolean", "array", "object", "key", "null", "enum_member", "struct",
    "event", "operator", "type_parameter",
)

# Nested symbols of these kinds get a chunk of their own.
SIGNIFICANT_KINDS = (
    "function", "method", "class", "struct", "interface", "enum", "constructor", "module", "namespace",
)

# Chunk sizes.
TARGET_TOKENS = 300
OVERLAP_TOKENS = 50
CHARS_PER_TOKEN = 4.0
SPLIT_OVERLAP_LINES = 3
MAX_TOKENS = 300
MIN_RESPLIT_WINDOW = 50
RESPLIT_FILL = 0.9

# Query defaults and limits.
DEFAULT_TOP_K = 10
MAX_TOP_K = 1000
DEFAULT_PAGE = 1
DEFAULT_PAGE_SIZE = 20

# Lower bounds of the similarity bands, best first; below the last one a match is "weak".
SIMILARITY_BANDS = ((0.90, "excellent"), (0.75, "good"), (0.60, "moderate"))
WEAK_BAND = "weak"

# Audit operations and rate limits.
AUDIT_OPS = (
    "INDEX", "QUERY", "CLEANUP", "DELETE", "CLEAR", "AUTH_FAIL", "ADMIN_ADD", "ADMIN_REMOVE", "BOOTSTRAP",
    "AUTH_ALERT",
)
AUDIT_RETENTION_DAYS = 30
QUERY_TEXT_LIMIT = 50
FAILURE_LIMIT = 5
FAILURE_WINDOW_SECONDS = 60
ALERT_THRESHOLD = 10

# Storage overhead (percent) above which a cleanup is advised.
CLEANUP_ADVICE_PERCENT = 15.0
