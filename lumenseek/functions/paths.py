"""Languages, file predicates and keys derived from paths, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of languages by extension; extensions of text files; extensions and segments of the strict
# code index; patterns that scans ignore.
DISPLAY_LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TSX", ".js": "JavaScript", ".jsx": "JSX", ".py": "Python", ".java": "Java", ".go": "Go", ".rs": "Rust",
    ".c": "C", ".cpp": "C++", ".cs": "C#", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".md": "Markdown", ".json": "JSON",
    ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".sql": "SQL", ".sh": "Shell", ".bash": "Bash",
}
TEXT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".xml", ".sql", ".sh", ".bash", ".zsh", ".fish", ".dockerfile", ".gitignore", ".env", ".config")
TEXT_NAMES = ("dockerfile", "makefile", ".gitignore")
INDEX_EXTENSIONS = (".ts", ".tsx", ".js", ".rs", ".md")
SKIPPED_SEGMENTS = ("node_modules", "dist", "target", ".git")
IGNORE_PATTERNS = ("node_modules", ".git", ".svn", ".hg", ".DS_Store", ".idea", ".vscode", "*.suo", "*.ntvs*", "*.njsproj", "*.sln", "*.swp", ".cache", "dist", "build", "coverage", ".nyc_output", "*.log", "tmp", "temp", ".lumenseek")
MAX_FILE_BYTES = 1 << 20


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot and in lower case; empty for none, and for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def display_language(path: Column) -> Column:
    return F.try_element_at(_map(DISPLAY_LANGUAGES), extension(path))


def is_text_file(path: Column) -> Column:
    name = F.lower(basename(path))
    return extension(path).isin(*TEXT_EXTENSIONS) | name.isin(*TEXT_NAMES) | name.startswith(".env")


def is_indexable(path: Column) -> Column:
    """Case-sensitive suffixes of the strict code index."""
    out = F.lit(False)
    for x in INDEX_EXTENSIONS:
        out = out | path.endswith(x)
    return out


def has_skipped_segment(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_SEGMENTS)))


def path_words(path: Column) -> Column:
    return F.translate(path, "/.-", "   ")


def path_matches(path: Column, *, extensions: list[str] | None = None, contains: str | None = None, excludes: list[str] | None = None) -> Column:
    """Any of the suffixes, the substring, and none of the excluded substrings; what is empty or None does not filter."""
    out = F.lit(True)
    if extensions:
        some = F.lit(False)
        for x in extensions:
            some = some | path.endswith(x)
        out = out & some
    if contains:
        out = out & path.contains(contains)
    for x in excludes or ():
        out = out & ~path.contains(x)
    return out


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("chunk://%s:%d-%d", path, start, end)


def parse_chunk_id(key: Column) -> Column:
    """struct path, start_line, end_line of a chunk id; of other ids the path without a scheme, and null lines."""
    pattern = r"^chunk://(.+):(\d+)-(\d+)$"
    is_chunk = key.rlike(pattern)
    return F.struct(
        F.when(is_chunk, F.regexp_extract(key, pattern, 1)).otherwise(F.regexp_replace(key, r"^[a-z]+://", "")).alias("path"),
        F.when(is_chunk, F.regexp_extract(key, pattern, 2).cast("int")).alias("start_line"),
        F.when(is_chunk, F.regexp_extract(key, pattern, 3).cast("int")).alias("end_line"),
    )


def result_key(path: Column, start: Column, end: Column) -> Column:
    """path:start:end, a missing line counting as 0."""
    return F.concat_ws(":", path, F.coalesce(start, F.lit(0)).cast("string"), F.coalesce(end, F.lit(0)).cast("string"))


def merge_key(path: Column, start: Column, end: Column) -> Column:
    """path:start-end where both lines are above 0, otherwise the path."""
    return F.when((start > 0) & (end > 0), F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(path)
