"""Parameters and fixed values.

Everything a caller may tune lives in :class:`CheckConfig`. The block marked
FIXED VALUES holds the lists, limits and patterns whose exact contents decide
the results (they must stay equal to the behaviour being reproduced).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay exactly as written for matching results)
# ---------------------------------------------------------------------------

# language -> extensions, in registry order; the first language listing an
# extension wins (".h" is c, not cpp).
LANGUAGE_EXTENSIONS = [
    ("python", [".py", ".pyw"]),
    ("javascript", [".js", ".jsx"]),
    ("typescript", [".ts", ".tsx"]),
    ("java", [".java"]),
    ("c", [".c", ".h"]),
    ("cpp", [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".h"]),
    ("csharp", [".cs"]),
    ("ruby", [".rb"]),
    ("php", [".php"]),
    ("go", [".go"]),
    ("rust", [".rs"]),
    ("swift", [".swift"]),
    ("kotlin", [".kt"]),
    ("html", [".html", ".htm"]),
    ("css", [".css"]),
    ("scala", [".scala"]),
    ("shell", [".sh", ".bash"]),
    ("r", [".r"]),
    ("perl", [".pl", ".pm"]),
    ("haskell", [".hs"]),
    ("lua", [".lua"]),
]

# languages the code corpus can be searched in (all 21)
SEARCHABLE_LANGUAGES = [
    "python", "javascript", "java", "c", "cpp", "csharp", "ruby",
    "php", "go", "rust", "swift", "kotlin", "typescript", "html", "css",
    "scala", "shell", "r", "perl", "haskell", "lua",
]

ARCHIVE_EXTENSION = ".zip"

MAX_UPLOAD_BYTES = 3 * 1024 * 1024          # strict ">" blocks the submission
MAX_CONTENT_CHARS = 16 * 1024 * 1024        # validate_content: whole text
MAX_LINE_CHARS = 100000                     # validate_content: any one line

# informational tags, case-insensitive, never blocking
SUSPICIOUS_PATTERNS = [
    ("dunder_import", r"__import__\s*\("),
    ("eval", r"eval\s*\("),
    ("exec", r"exec\s*\("),
    ("system", r"system\s*\("),
    ("os_popen", r"os\.popen"),
    ("subprocess_call", r"subprocess\.call"),
]

# search-term stop words (31)
COMMON_WORDS = [
    "main", "test", "init", "get", "set", "var", "function", "class", "def", "return",
    "true", "false", "null", "none", "this", "self", "super", "len", "str", "int", "list",
    "dict", "args", "kwargs", "name", "value", "data", "item", "result", "error", "message",
]

CODE_MATCH_FLOOR = 0.08     # code corpus: similarity >= floor is reported
WEB_MATCH_FLOOR = 0.08      # web: similarity > floor is reported
RISK_THRESHOLD = 0.30       # potential issues at >= 0.30 on either source

MAX_BLOCKS_PER_FILE = 5
MAX_TERMS_PER_BLOCK = 2
MAX_LOOKUPS_PER_FILE = 4
HITS_PER_TERM = 3
HITS_PER_TERM_FALLBACK = 5
TERMS_PER_TEXT = 5
TOP_CODE_MATCHES = 10
TOP_WEB_MATCHES = 5
HITS_PER_LINE_QUERY = 2
LINE_QUERIES_PER_TEXT = 4
FALLBACK_LINE_QUERIES = 3
SUMMARY_BLOCKS = 3
SUMMARY_LINES_PER_BLOCK = 3
SUMMARY_MAX_LINES = 10
PAGE_PIECES = 8
PAGE_TEXT_CHARS = 5000
CLIP_CHARS = 300
CACHE_TTL_SECONDS = 3600

# request quotas per client: (window, limit)
QUOTAS = [("1 day", 200), ("1 hour", 50), ("1 minute", 10)]

# pages: urls containing any of these are never fetched
URL_BLOCKLIST = [".pdf", ".zip", "youtube.com", "facebook.com"]

# page elements removed before text extraction
CHROME_TAGS = ["script", "style", "nav", "footer", "header", "aside", "iframe", "noscript"]

# div classes that mark code
CODE_CLASS_PATTERN = r"code|highlight|snippet|example|program|source"
# main-content classes
MAIN_CLASS_PATTERN = r"content|main|body"

# text-scorer weights of the hybrid web score
TEXT_WEIGHT = 0.7
STRUCTURE_WEIGHT = 0.3

# structure patterns: python, then every other language
STRUCTURE_PATTERNS_PYTHON = [
    r"def\s+\w+",
    r"class\s+\w+",
    r"for\s+\w+\s+in",
    r"if\s+\w+",
    r"return\s+",
    r"import\s+\w+",
    r"\w+\s*=\s*\w+",
]
STRUCTURE_PATTERNS_OTHER = [
    r"function\s+\w+",
    r"class\s+\w+",
    r"for\s*\(",
    r"if\s*\(",
    r"return\s+",
    r"\w+\s*=\s*\w+",
]

# control words counted by complexity
COMPLEXITY_WORDS = ["if", "for", "while", "catch", "switch"]

# java class names treated as boilerplate
JAVA_BOILERPLATE_CLASSES = ["Main", "Test", "Example", "Demo"]
# java / c# method-name prefixes treated as boilerplate (regex, anchored at start)
JAVA_BOILERPLATE_NAME = r"^(get[A-Z]|set[A-Z]|toString|equals|hashCode)"
CSHARP_BOILERPLATE_NAME = r"^(get_[A-Z]|set_[A-Z]|ToString|Equals|GetHashCode)"
# c function names skipped
C_SKIP_NAMES = ["main", "printf", "scanf"]

# line prefixes dropped by the fallback extractor
FALLBACK_SKIP_PREFIXES = ["#", "//", "/*", "*", "import ", "from ", "using ", "#include"]
# line prefixes dropped from the core summary
SUMMARY_SKIP_PREFIXES = ["*", "//", "#", "import", "from", "using"]
# line prefixes dropped from web line queries, and the keywords that mark a line
QUERY_SKIP_PREFIXES = ["#", "//", "import", "from", "include", "using", "package"]
QUERY_KEYWORDS = ["def ", "function ", "class ", "=", "return", "if ", "for ", "while "]

# generic search-term patterns (group 1 is the term)
GENERIC_TERM_PATTERNS = [
    r"\bfunction\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\bdef\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\bfunc\s+(?:\([^)]*\)\s+)?([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\bfn\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\bfun\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\bsub\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s*<-\s*function",
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s*::\s*[a-zA-Z_]",
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(\)\s*\{",
    r"\b(?:int|void|char|bool|double|float|long|unsigned|string|auto|size_t|const|var|let)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{",
    r"\bclass\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\bstruct\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"\binterface\s+([a-zA-Z_][a-zA-Z0-9_]*)",
]

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------


def language_rows():
    """(ext, language, priority, searchable) rows of the language registry."""
    rows = []
    for prio, (lang, exts) in enumerate(LANGUAGE_EXTENSIONS):
        for ext in exts:
            rows.append((ext, lang, prio, lang in SEARCHABLE_LANGUAGES))
    return rows


def allowed_extensions():
    exts = []
    for _, e in LANGUAGE_EXTENSIONS:
        for x in e:
            if x not in exts:
                exts.append(x)
    return exts + [ARCHIVE_EXTENSION]


@dataclass(frozen=True)
class CheckConfig:
    """Tunable knobs of a check job. ``None`` means unlimited."""

    code_floor: float = CODE_MATCH_FLOOR
    top_code: int = TOP_CODE_MATCHES
    gram_k: int = 5                      # word k-grams for text passages
    terms_per_text: int | None = None    # search terms of a block or file, rarest first
    hits_per_term: int | None = None     # newest corpus files of a term
    max_blocks_per_file: int | None = None
    max_terms_per_block: int | None = None
    broadcast_max_rows: int = 2_000_000  # size-checked broadcast bound
    candidates: str = "grams"            # R9: "grams" (every similar block) or "hits" (blocks of files the terms find)
    extra: dict = field(default_factory=dict)


# What the reference's search service allows: the newest hits of a few terms.
REFERENCE_BUDGET = CheckConfig(terms_per_text=TERMS_PER_TEXT, hits_per_term=HITS_PER_TERM, candidates="hits")
FALLBACK_BUDGET = CheckConfig(terms_per_text=TERMS_PER_TEXT, hits_per_term=HITS_PER_TERM_FALLBACK, candidates="hits")
