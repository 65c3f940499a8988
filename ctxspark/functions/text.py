"""Column functions on text and paths. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the word embedding, and those that the keyword matcher adds.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are",
    "with", "this", "that", "it", "as", "by", "at", "be", "was", "were",
]
KEYWORD_STOP_WORDS = [*STOP_WORDS, "fix", "bug", "add", "update"]

# Fence languages by extension.
FENCE_LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".py": "python",
    ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".md": "markdown", ".json": "json",
    ".yml": "yaml", ".yaml": "yaml", ".sh": "bash",
}

# Extensions never read as text, and names never entered.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".bmp", ".tiff", ".avif", ".heic",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".zip", ".tar", ".gz", ".7z", ".dmg", ".iso",
    ".pdf", ".mp4", ".mp3", ".mov", ".wav",
    ".exe", ".dll", ".so", ".dylib", ".wasm", ".class", ".jar", ".o", ".a", ".pyc", ".pyo", ".node",
    ".db", ".sqlite", ".sqlite3", ".bin", ".dat",
    ".lock",
]
SKIPPED_NAMES = [".git", "node_modules", ".DS_Store"]
MAX_FILE_BYTES, SNIFFED_BYTES = 512 * 1024, 8000

# The suffixes an import may leave out, in order of preference.
IMPORT_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js"]

FNV_OFFSET, FNV_PRIME, EMBEDDING_BUCKETS = 2166136261, 16777619, 1024


def lines_of(text: Column) -> Column:
    """Lines split at ``\\n`` alone; one empty element after a final newline is dropped; ``""`` is one empty line."""
    parts = F.split(text, "\n", -1)
    return F.when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a dot file is its own extension; ``""`` without one."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def name_extension(path: Column) -> Column:
    """As :func:`extension`, but a dot file has none."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]*)$", 1)


def fence_language(path: Column) -> Column:
    """Fence language of a path, ``""`` for an unknown extension or a null path."""
    table = F.create_map(*[F.lit(x) for kv in FENCE_LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit(""))


def is_blank(text: Column) -> Column:
    """Only Unicode white space or byte order marks, or null."""
    return F.coalesce(~text.rlike(r"(?U)[^\s\x{FEFF}]"), F.lit(True))


def words_of(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case words of ``[a-z0-9_]`` without stop words, repeats kept."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(stop))


def keywords_of(text: Column) -> Column:
    """Distinct lower-case words of a task or text, camel-case parts included, without stop words."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+"), lambda w: w != "")
    parts = F.flatten(F.transform(tokens, lambda w: F.concat(
        F.array(F.lower(w)), F.split(F.lower(F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2")), " "))))
    return F.array_except(F.array_distinct(parts), F.array(*[F.lit(w) for w in KEYWORD_STOP_WORDS]))


def bucket_of(word: Column) -> Column:
    """Bucket of an ASCII word: 32-bit FNV-1a, absolute value of the signed hash, modulo 1024."""
    h = F.aggregate(
        F.transform(F.split(word, ""), lambda c: F.ascii(c).cast("bigint")), F.lit(FNV_OFFSET).cast("bigint"),
        lambda a, c: (a.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(4294967295)))
    return (F.when(h >= 2**31, F.lit(2**32) - h).otherwise(h) % EMBEDDING_BUCKETS).cast("int")


def surrogate_tokens(text: Column) -> Column:
    """A token count in SQL: a quarter of the characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("bigint")


def candidate_id(path: Column, start: Column, end: Column) -> Column:
    """Id of a rerank candidate."""
    return F.format_string("%s:%d-%d", path, start, end)
