"""Structural chunks: code cut at the definitions of its language.

Python is parsed; Markdown, markup and other languages are cut by their own line structure, which needs no parser. The
registry says which parts are boundaries and which are context (imports and types) that precedes every chunk. Runs in a
Python table function or mapInPandas, a file at a time.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    extensions: tuple[str, ...]
    boundaries: frozenset[str]
    context: frozenset[str] = frozenset()
    embedded: dict[str, str] = field(default_factory=dict)


def _language(extensions: str, boundaries: str, context: str = "", embedded: dict[str, str] | None = None) -> Language:
    return Language(tuple(extensions.split()), frozenset(boundaries.split()), frozenset(context.split()), embedded or {})


# Kinds are this module's own: what _units() reports for a language.
REGISTRY: dict[str, Language] = {
    "javascript": _language(".js .mjs .cjs", "function class const export", "import"),
    "typescript": _language(".ts .mts .cts", "function class interface type enum const export", "import type interface"),
    "jsx": _language(".jsx", "function class const export", "import"),
    "tsx": _language(".tsx", "function class interface type const export", "import type interface"),
    "python": _language(".py .pyw .pyi", "function class", "import"),
    "go": _language(".go", "function type const var", "import package"),
    "java": _language(".java", "class interface enum method", "import package"),
    "c": _language(".c .h", "function struct enum typedef", "include define"),
    "rust": _language(".rs", "function impl struct enum trait mod macro", "use"),
    "markdown": _language(".md .markdown .mdx", "heading paragraph code quote list", embedded={"code": ""}),
    "html": _language(".html .htm", "element comment script style", embedded={"script": "javascript", "style": "css"}),
    "xml": _language(".xml .xsl .xslt .xsd .svg", "element comment"),
    "json": _language(".json .jsonc .json5", "entry"),
    "yaml": _language(".yaml .yml", "entry"),
    "toml": _language(".toml", "section"),
    "ini": _language(".ini .cfg .conf .gitconfig .editorconfig", "section"),
    "protobuf": _language(".proto", "message service enum", "import package"),
}
BY_EXTENSION = {x: name for name, spec in REGISTRY.items() for x in spec.extensions}
ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "md": "markdown", "yml": "yaml", "rs": "rust"}

# First line of a unit by its keyword, for languages with braces; every line is tried from its start.
_WORDS = {
    "import": r"import\b|export\s+\*\s+from\b",
    "function": r"(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:function\b|fn\b|func\b)",
    "class": r"(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\b",
    "interface": r"(?:export\s+)?(?:public\s+)?interface\b",
    "type": r"(?:export\s+)?type\b",
    "enum": r"(?:export\s+)?(?:pub\s+)?(?:public\s+)?enum\b",
    "const": r"(?:export\s+)?(?:const|let|var)\b",
    "export": r"export\b",
    "var": r"var\b",
    "struct": r"(?:pub\s+)?struct\b",
    "impl": r"impl\b",
    "trait": r"(?:pub\s+)?trait\b",
    "mod": r"(?:pub\s+)?mod\b",
    "macro": r"macro_rules!",
    "use": r"(?:pub\s+)?use\b",
    "package": r"package\b",
    "include": r"#\s*include\b",
    "define": r"#\s*define\b",
    "typedef": r"typedef\b",
    "message": r"message\b",
    "service": r"service\b",
}


@dataclass
class Unit:
    kind: str
    start: int  # lines from 1, both included
    end: int
    text: str


def language_of(path: str) -> str | None:
    dot = path.rfind(".")
    return BY_EXTENSION.get(path[dot:].lower()) if dot >= 0 else None


def _by_heads(lines: list[str], heads: list[tuple[int, str]]) -> list[Unit]:
    """Units from each head to the line before the next."""
    out = []
    for (at, kind), (following, _) in zip(heads, [*heads[1:], (len(lines), "")], strict=True):
        end = following
        while end > at + 1 and not lines[end - 1].strip():
            end -= 1
        out.append(Unit(kind, at + 1, end, "\n".join(lines[at:end])))
    return out


def _python_units(code: str, lines: list[str]) -> list[Unit]:
    out = []
    for node in ast.parse(code).body:
        kind = "import" if isinstance(node, ast.Import | ast.ImportFrom) else "class" if isinstance(node, ast.ClassDef) else "function" if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) else "statement"
        start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        out.append(Unit(kind, start, node.end_lineno or start, "\n".join(lines[start - 1 : node.end_lineno])))
    return out


def _markdown_units(lines: list[str]) -> list[Unit]:
    heads, fence, blank = [], None, True
    for i, line in enumerate(lines):
        mark = re.match(r"(```+|~~~+)(\w*)", line)
        if fence:
            if mark and line.strip() == fence:
                fence, blank = None, True
            continue
        if mark:
            fence = mark[1]
            heads.append((i, "code"))
            blank = False
        elif re.match(r"#{1,6}\s", line):
            heads.append((i, "heading"))
            blank = True
        elif not line.strip():
            blank = True
        elif blank:
            heads.append((i, "quote" if line.startswith(">") else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else "paragraph"))
            blank = False
    return _by_heads(lines, heads)


def _markup_units(code: str) -> list[Unit]:
    out = []
    for m in re.finditer(r"<!--.*?-->|<(script|style)\b[^>]*>(.*?)</\1\s*>|[^<]+|<[^>]*>", code, re.S | re.I):
        if m[1]:
            kind = m[1].lower()
        elif m[0].startswith("<!--"):
            kind = "comment"
        elif m[0].strip():
            kind = "element"
        else:
            continue
        start = code.count("\n", 0, m.start()) + 1
        out.append(Unit(kind, start, start + m[0].count("\n"), m[0]))
    merged: list[Unit] = []
    for u in out:
        # neighbouring pieces of markup on the same lines are one element
        if merged and u.kind == merged[-1].kind == "element" and u.start <= merged[-1].end:
            merged[-1] = Unit("element", merged[-1].start, u.end, merged[-1].text + u.text)
        else:
            merged.append(u)
    return merged


def units(code: str, language: str) -> list[Unit]:
    """A file's top-level parts, in order; a SyntaxError if it cannot be parsed."""
    lines = code.split("\n")
    spec = REGISTRY[language]
    if language == "python":
        return _python_units(code, lines)
    if language == "markdown":
        return _markdown_units(lines)
    if language in ("html", "xml"):
        return _markup_units(code)
    if language in ("toml", "ini"):
        heads = [(i, "section") for i, x in enumerate(lines) if re.match(r"\[", x)]
    elif language in ("yaml", "json"):
        inner = r"[^\s#\-\]}]" if language == "yaml" else r"(?:  |\t)?\""
        heads = [(i, "entry") for i, x in enumerate(lines) if re.match(inner, x)]
    else:
        kinds = sorted(spec.boundaries | spec.context, key=lambda k: (k == "export", k == "const"))
        tests = [(k, re.compile(_WORDS[k])) for k in kinds if k in _WORDS]
        heads = []
        for i, line in enumerate(lines):
            if kind := next((k for k, t in tests if t.match(line)), None):
                heads.append((i, kind))
            elif language in ("c", "java") and re.match(r"[A-Za-z_][\w\s*<>,\[\]]*\([^;]*$", line.strip()) and not line.startswith(("}", " " * 8)):
                heads.append((i, "function" if language == "c" else "method"))
    return _by_heads(lines, heads)


def _windows(unit: Unit, size: int, first_index: int = 0) -> list[dict]:
    parts = []
    lines, at, index = unit.text.split("\n"), 0, first_index
    held: list[str] = []

    def close(end: int) -> None:
        nonlocal index
        if held:
            parts.append({"content": "\n".join(held), "type": f"{unit.kind}[{index}]", "start_line": unit.start + at, "end_line": unit.start + end - 1, "split": True})
            index += 1

    for i, line in enumerate(lines):
        for piece in [line[k : k + size] for k in range(0, len(line), size)] or [""]:
            if held and sum(map(len, held)) + len(held) + len(piece) > size:
                close(max(i, at + 1))
                held, at = [], i
            held.append(piece)
    close(len(lines))
    return parts


def merge_small(chunks: list[dict], least: int) -> list[dict]:
    """Neighbours that come from divided units and are both shorter than least become one."""
    out: list[dict] = []
    for c in chunks:
        last = out[-1] if out else None
        if last and last.get("split") and c.get("split") and len(last["content"]) < least and len(c["content"]) < least:
            out[-1] = last | {"content": f"{last['content']}\n\n{c['content']}", "type": f"{last['type']}+{c['type']}", "end_line": c["end_line"]}
        else:
            out.append(c)
    return out


def structural_chunks(code: str, path: str, *, max_size: int = 1000, min_size: int = 100, with_context: bool = True, kinds: frozenset[str] | None = None, embedded: bool = True) -> list[dict]:
    """Chunks (content, type, start_line, end_line, language, embedded_in) of one file. Lines count from 1; what has no
    known language, cannot be parsed or has no boundaries is one chunk of type unknown, or windows if it is too long."""
    language = language_of(path)
    spec = REGISTRY.get(language or "")
    n_lines = code.count("\n") + 1
    try:
        parts = units(code, language) if spec else []
    except (SyntaxError, ValueError, RecursionError):
        parts = []
    chosen = [u for u in parts if u.kind in (kinds or (spec.boundaries if spec else frozenset()))]
    if not chosen:
        whole = {"content": code, "type": "unknown", "start_line": 1, "end_line": n_lines}
        found = [whole] if code and len(code) <= max_size else _windows(Unit("text", 1, n_lines, code), max_size) if code else []
        return [{"language": language, "embedded_in": None} | c for c in found]
    context = "\n".join(u.text for u in parts if spec and u.kind in spec.context) if with_context else ""
    out: list[dict] = []
    for u in chosen:
        body = f"{context}\n\n{u.text}" if context and u.kind not in spec.context else u.text
        if len(body) <= max_size:
            out.append({"content": body, "type": u.kind, "start_line": u.start, "end_line": u.end})
        else:
            out += _windows(u, max_size)
        if embedded and u.kind in spec.embedded:
            out += _embedded(u, language, spec.embedded[u.kind], max_size, min_size)
    return [{"language": language, "embedded_in": None} | {k: v for k, v in c.items() if k != "split"} for c in merge_small(out, min_size)]


def _embedded(unit: Unit, outer: str, default: str, max_size: int, min_size: int) -> list[dict]:
    if outer == "markdown":
        m = re.match(r"(?:```+|~~~+)(\w*)\n(.*?)\n?(?:```+|~~~+)\s*$", unit.text, re.S)
        name, body, skip = (m[1].lower(), m[2], 1) if m else ("", "", 0)
    else:
        m = re.match(r"<\w+[^>]*>(.*)</\w+\s*>$", unit.text, re.S)
        name, body, skip = default, m[1] if m else "", 0
    name = ALIASES.get(name, name)
    if name not in REGISTRY or not body.strip():
        return []
    inner = structural_chunks(body, f"x{REGISTRY[name].extensions[0]}", max_size=max_size, min_size=min_size, embedded=False)
    return [c | {"start_line": c["start_line"] + unit.start - 1 + skip, "end_line": c["end_line"] + unit.start - 1 + skip, "language": name, "embedded_in": outer} for c in inner]


SCHEMA = "path string, chunk_index int, content string, type string, start_line int, end_line int, language string, embedded_in string"


def chunk_structure(files: DataFrame, path_col: str = "path", content_col: str = "content", **options) -> DataFrame:
    """structural_chunks() of every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [{"path": p, "chunk_index": i} | c for p, code in zip(batch["path"], batch["content"], strict=True) for i, c in enumerate(structural_chunks(code or "", p, **options))]
            yield pd.DataFrame(rows, columns=columns)

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, SCHEMA)
