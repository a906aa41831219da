"""Chunkers: character windows, lines, and symbols found by line patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenseek.functions.paths import path_words
from lumenseek.functions.tokenize import plain_tokens


def text_windows(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Array of overlapping windows of `size` characters; the last ends with the text, and an empty text has none."""
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    step = size - overlap if overlap < size else size
    count = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step)))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(text, i * step + 1, size))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def chunk_text(docs: DataFrame, keys: list[str], text_col: str = "text", size: int = 1000, overlap: int = 100) -> DataFrame:
    """keys, chunk_index int, chunk string."""
    return docs.select(*keys, F.posexplode(text_windows(F.coalesce(F.col(text_col), F.lit("")), size, overlap)).alias("chunk_index", "chunk"))


def numbered(lines: Column, first: Column) -> Column:
    """Lines joined, each after its number."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def strip_fence(code: Column) -> Column:
    """What stands between the fences of a fenced block; other texts as they are."""
    pattern = r"(?s)^```\w*\n(.*?)\n```$"
    return F.when(code.rlike(pattern), F.regexp_extract(code, pattern, 1)).otherwise(code)


# What the first line of a symbol looks like, in the order in which they are looked for.
SYMBOLS = (
    (r"^export\s+(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)", "function"),
    (r"^export\s+class\s+([A-Za-z_][A-Za-z0-9_]*)", "class"),
    (r"^export\s+const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=", "const"),
    (r"^(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)", "function"),
    (r"^def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", "function"),
    (r"^class\s+([A-Za-z_][A-Za-z0-9_]*)", "class"),
)


def _lines(content: Column) -> Column:
    """Lines without their ends; a last empty one does not count."""
    lines = F.split(content, "\r?\n")
    return F.when((F.size(lines) > 0) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def symbol_spans(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, start_line, symbol_name, chunk_type of the symbols that start on a line."""
    lines = files.select(F.col(path_col).alias("path"), _lines(F.coalesce(F.col(content_col), F.lit(""))).alias("lines"))
    # inline() would bring a filter on the size of spans, which is pushed below them and works them out for each symbol again
    return _with_spans(lines).select("path", F.inline_outer("spans")).where("start_line IS NOT NULL").drop("following")


def _with_spans(files: DataFrame) -> DataFrame:
    """files with spans, from `lines`: start_line, symbol_name, chunk_type, pattern and the line of the next symbol, in the
    order of lines and patterns. A file is a row, so nothing is shuffled."""
    # one anchor before all patterns: with one in each, every place of a line is tried with every pattern
    any_symbol = "^(?:" + "|".join(p.removeprefix("^") for p, _ in SYMBOLS) + ")"
    marked = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(any_symbol), F.struct((i + 1).alias("at"), line.alias("line")))), lambda x: x.isNotNull())
    named = lambda x: F.array(*(F.struct(x.at.alias("start_line"), F.regexp_extract(x.line, p, 1).alias("symbol_name"), F.lit(kind).alias("chunk_type"), F.lit(i).alias("pattern")) for i, (p, kind) in enumerate(SYMBOLS)))
    files = files.withColumn("marked", marked)
    files = files.withColumn("found", F.filter(F.flatten(F.transform("marked", named)), lambda x: x.symbol_name != "")).drop("marked")
    before = lambda i: F.get("found", i - 1)
    again = lambda x, i: F.coalesce((before(i).start_line == x.start_line) & (before(i).symbol_name == x.symbol_name), F.lit(False))
    files = files.withColumn("once", F.filter("found", lambda x, i: ~again(x, i))).drop("found")
    following = lambda x, i: F.struct(x.start_line.alias("start_line"), x.symbol_name.alias("symbol_name"), x.chunk_type.alias("chunk_type"), x.pattern.alias("pattern"), F.get("once", i + 1).start_line.alias("following"))
    return files.withColumn("spans", F.transform("once", following)).drop("once")


def chunk_symbols(files: DataFrame, path_col: str = "path", content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, start_line, end_line, symbol_name, chunk_type, text, tokens and columns of keep: a chunk from each symbol's
    line to the line before the next, after the lines above the first symbol; a file without symbols is one chunk."""
    files = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col), F.lit("")).alias("content"), *keep)
    files = files.withColumn("lines", _lines(F.col("content"))).withColumn("n", F.greatest(F.size("lines"), F.lit(1)))
    files = _with_spans(files).withColumn("top", F.get("spans", F.lit(0)).start_line)
    joined = files.select("path", "content", "lines", "n", "top", *keep, F.inline_outer("spans"))
    is_file = F.col("start_line").isNull()
    start = F.coalesce("start_line", F.lit(1))
    end = F.when(is_file, F.col("n")).otherwise(F.greatest(F.coalesce(F.col("following") - 1, F.col("n")), F.col("start_line")))
    body = F.array_join(F.slice("lines", start, end - start + 1), "\n")
    above = F.array_join(F.slice("lines", F.lit(1), F.greatest(F.col("top") - 1, F.lit(0))), "\n")
    text = F.when(is_file, F.col("content")).when(above == "", body).otherwise(F.concat_ws("\n", above, body))
    out = joined.select("path", start.alias("start_line"), end.alias("end_line"), "symbol_name", F.coalesce("chunk_type", F.lit("file")).alias("chunk_type"), text.alias("text"), *keep)
    return out.withColumn("tokens", plain_tokens(F.concat_ws(" ", path_words(F.col("path")), "symbol_name", "text")))
