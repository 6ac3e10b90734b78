"""Names, tables, constants and patterns that define results.

Nothing here is logic. Results only agree with the search tool this engine
replaces when these values are exactly these, so they are kept together and
in plain form.
"""

from __future__ import annotations

# --- chunk types: the closed set, in declaration order -----------------------
CHUNK_TYPES = [
    "function", "class", "method", "interface", "type", "namespace", "const",
    "variable", "import", "export", "jsx", "component", "block", "template",
    "script", "css", "data", "computed", "lifecycle", "watch", "unknown",
]

# --- re-rank: weight of each signal and bonus per chunk type ------------------
RERANK_WEIGHTS = {"similarity": 0.5, "tokens": 0.3, "path": 0.1, "type": 0.1}
TYPE_BONUS = {
    "function": 1.0, "method": 0.95, "class": 0.8, "component": 0.85,
    "interface": 0.75, "const": 0.6, "variable": 0.5, "import": 0.2,
    "export": 0.2, "unknown": 0.4, "block": 0.3, "type": 0.7,
    "namespace": 0.7, "jsx": 0.75, "template": 0.7, "script": 0.6,
    "css": 0.5, "data": 0.7, "computed": 0.7, "lifecycle": 0.8, "watch": 0.7,
}
DEFAULT_TYPE_BONUS = 0.5

# --- labels per chunk type: embedding input, filter list, icon ----------------
TYPE_LABELS = {
    "function": "Function", "method": "Method", "class": "Class",
    "interface": "Interface", "component": "Component", "const": "Constant",
    "variable": "Variable", "import": "Import", "export": "Export",
    "type": "Type", "namespace": "Namespace", "jsx": "JSX Element",
    "template": "Template", "script": "Script", "css": "CSS",
    "data": "Data Property", "computed": "Computed Property",
    "lifecycle": "Lifecycle Method", "watch": "Watcher", "block": "Block",
    "unknown": "Code Block",
}
TYPE_PLURALS = {
    "function": "Functions", "method": "Methods", "class": "Classes",
    "interface": "Interfaces", "type": "Types", "namespace": "Namespaces",
    "const": "Constants", "variable": "Variables", "import": "Imports",
    "export": "Exports", "jsx": "JSX Elements", "component": "Components",
    "block": "Blocks", "template": "Templates", "script": "Scripts",
    "css": "CSS", "data": "Data Properties", "computed": "Computed Properties",
    "lifecycle": "Lifecycle Methods", "watch": "Watchers", "unknown": "Unknown",
}
TYPE_ICONS = {
    "function": "symbol-method", "method": "symbol-method",
    "class": "symbol-class", "interface": "symbol-interface",
    "type": "symbol-variable", "namespace": "symbol-namespace",
    "const": "symbol-constant", "variable": "symbol-variable",
    "css": "symbol-color", "data": "symbol-property",
    "computed": "symbol-property", "lifecycle": "symbol-event",
    "watch": "symbol-event",
}
DEFAULT_ICON = "symbol-misc"

# --- syntax labels -> chunk types ---------------------------------------------
SYNTAX_TYPES = {
    "Function": "function", "Class": "class", "Abstract Class": "class",
    "Interface": "interface", "Type Alias": "type", "Enum": "type",
    "Import": "import", "Export": "export", "Variable": "variable",
    "JSX": "jsx", "Template": "template", "Script": "script", "Style": "css",
    "Rule": "css", "Media Query": "css", "Keyframes": "css",
    "Lifecycle Hook": "lifecycle", "Data Function": "data",
    "Vue Methods Method": "method", "Vue Computed Method": "computed",
    "Vue Watch Method": "watch", "Props Definition": "const",
    "Emits Definition": "const",
}
UNMAPPED_SYNTAX_TYPE = "block"

# --- Vue component option names ------------------------------------------------
LIFECYCLE_HOOKS = [
    "beforeCreate", "created", "beforeMount", "mounted", "beforeUpdate",
    "updated", "beforeDestroy", "destroyed", "beforeUnmount", "unmounted",
    "activated", "deactivated", "errorCaptured",
]
NESTED_OPTIONS = {
    "methods": "Vue Methods Method",
    "computed": "Vue Computed Method",
    "watch": "Vue Watch Method",
}
OPTION_PAIRS = {"props": "Props Definition", "emits": "Emits Definition"}

# --- sizes and limits ------------------------------------------------------------
MAX_CHUNK_LINES = 300
MIN_CHUNK_LINES = 15
OVERLAP_LINES = 10
SPLIT_LOOK_BACK = 50
VARIABLE_MERGE_GAP = 2
JSX_MIN_LINES = 3
RRF_K = 60
OVER_FETCH = 2
LOW_RELEVANCE_BELOW = 0.4
CHARS_PER_TOKEN = 3.5
TOKENS_PER_NEWLINE = 0.3
CHARS_PER_TOKEN_SIMPLE = 4
PREVIEW_WEB = 100
PREVIEW_TREE = 60
SECONDS_PER_BATCH = 2
HISTOGRAM_CELL = 5
BATCH_SIZE_RANGE = (1, 100)
BATCH_GROWTH = 1.25
HOSTED_BATCH = 100
HOSTED_EMBED_PER_MINUTE = 500
HOSTED_EXPAND_PER_MINUTE = 200
RETRY_SECONDS = [1, 2, 4]
PAUSE_BETWEEN_BATCHES = 0.1
PAUSE_BETWEEN_ITEMS = 0.05
EXPANSION_CACHE_SIZE = 100
EXPANSION_SYNONYMS = 3
EXPANSION_RELATED = 2
EXPANSION_TEMPERATURE = 0.3
EXPANSION_TOKEN_CAP = 150

# --- scan defaults ----------------------------------------------------------------
EXCLUDE_GLOBS = [
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**",
    "**/.git/**", "**/coverage/**", "**/.next/**", "**/.vscode/**",
]
SCAN_EXTENSIONS = [
    "ts", "tsx", "js", "jsx", "py", "java", "go", "rust", "vue", "c", "cpp",
    "cs", "rb", "php",
]
SAMPLE_FILES = 100
SAMPLE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "vue"]
SAMPLE_EXCLUDE_GLOBS = [
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/.git/**", "**/coverage/**", "**/.next/**",
    "**/.nuxt/**", "**/.cache/**", "**/vendor/**", "**/venv/**", "**/.venv/**", "**/env/**", "**/.vscode/**",
    "**/.idea/**", "**/.vs/**", "**/*.min.js", "**/*.bundle.js", "**/webpack.config.*", "**/vite.config.*",
    "**/rollup.config.*", "**/next.config.*", "**/tailwind.config.*", "**/*config.js", "**/*config.ts",
    "**/package.json", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/tsconfig.json",
]
CHUNKABLE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "css", "vue"]
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

# --- embedding models: dimensions, max tokens, prefixes, unit length ---------------
# (provider, model) -> dimensions, max tokens, query prefix, document prefix, normalise
EMBEDDING_MODELS = {
    ("ollama", "nomic-embed-text"): (768, 8192, "search_query:", "search_document:", True),
    ("ollama", "mxbai-embed-large"): (1024, 512, None, None, True),
    ("openai", "text-embedding-3-small"): (1536, 8191, None, None, False),
    ("openai", "text-embedding-3-large"): (3072, 8191, None, None, False),
}
INDEX_QUERY_PREFIX = "search_query:"
INDEX_DOCUMENT_PREFIX = "search_document:"

# --- progress bands of an index run: phase -> (start %, width %) ---------------------
PROGRESS_BANDS = {
    "scanning": (0, 0), "chunking": (10, 20), "embedding": (30, 50),
    "storing": (80, 0), "complete": (100, 0),
}

# --- patterns -------------------------------------------------------------------------
# White space as ECMAScript's \s defines it; the \x{...} form is understood by
# both java.util.regex and RE2.
WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
LOWER_UPPER = "([a-z])([A-Z])"
ACRONYM_WORD = "([A-Z]+)([A-Z][a-z])"
TOKEN_DELIMITERS = r"[_\-./\\]"

IDENTIFIER_NAME = {
    "function": r"(?:function|const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    "class": r"class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    "method": r"([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(",
    "const": r"const\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    "variable": r"(?:let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    "interface": r"interface\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    "type": r"type\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    "component": r"(?:const|function|export\s+(?:default\s+)?(?:function)?)\s+([A-Z][a-zA-Z0-9_$]*)",
}

# Content fallback: (extensions, chunk type, line patterns) in priority order.
CONTENT_RULES = [
    (("tsx", "jsx"), "component", [
        r"^(?:export\s+(?:default\s+)?)?(?:function\s+|const\s+|let\s+)([A-Z]\w+)",
    ]),
    (("tsx", "jsx"), "jsx", [r"<[a-z]+[\s>]", r"<>", r"return\s*\(?\s*<"]),
    (("ts", "tsx", "js", "jsx"), "function", [
        r"^\s*(export\s+)?(async\s+)?function\s+\w+",
        r"^\s*(export\s+)?const\s+\w+\s*=\s*(async\s+)?\(",
        r"^\s*(export\s+)?const\s+\w+\s*:\s*\([^)]*\)\s*=>",
    ]),
    (("ts", "tsx", "js", "jsx"), "class", [r"^\s*(export\s+)?(abstract\s+)?class\s+\w+"]),
    (("ts", "tsx", "js", "jsx"), "interface", [r"^\s*(export\s+)?interface\s+\w+"]),
    (("ts", "tsx", "js", "jsx"), "type", [
        r"^\s*(export\s+)?type\s+\w+", r"^\s*(export\s+)?enum\s+\w+",
    ]),
    (("ts", "tsx", "js", "jsx"), "export", [r"^\s*export\s+default\s+", r"^\s*export\s+\{"]),
    (("ts", "tsx", "js", "jsx"), "import", [r"^\s*import\s+"]),
    (("ts", "tsx", "js", "jsx"), "variable", [r"^\s*(export\s+)?(const|let|var)\s+\w+"]),
    (("vue",), "script", [r"<script"]),
    (("vue",), "template", [r"<template"]),
    (("vue",), "css", [r"<style"]),
]

# --- node kinds by syntax label, for diagnosis -------------------------------------
TOP_KINDS = {
    "Import": "import_statement", "Export": "export_statement", "Function": "function_declaration",
    "Class": "class_declaration", "Abstract Class": "abstract_class_declaration",
    "Interface": "interface_declaration", "Type Alias": "type_alias_declaration", "Enum": "enum_declaration",
    "Variable": "lexical_declaration", "Module": "module", "Ambient": "ambient_declaration",
    "Function Signature": "function_signature", "Rule": "rule_set", "Media Query": "media_statement",
    "Keyframes": "keyframes_statement", "Script": "script_element", "Template": "template_element",
    "Style": "style_element",
}

# --- texts that users see when a service fails, by code or status ------------------
LOCAL_SERVICE_TEXTS = {
    "ECONNREFUSED": "Cannot connect to Ollama. Is it running?",
    "ETIMEDOUT": "Request to Ollama timed out",
}
LOCAL_SERVICE_ERROR = "Ollama error: {}"
HOSTED_SERVICE_TEXTS = {
    401: "Invalid OpenAI API key. Please check your configuration.",
    429: "OpenAI rate limit exceeded. Please try again later.",
    500: "OpenAI server error. Please try again later.",
    "ETIMEDOUT": "Request to OpenAI timed out",
}
HOSTED_SERVICE_ERROR = "OpenAI error: {}"
