"""The pattern language of ignore files, as regular expressions over relative paths."""

from __future__ import annotations

import re

from lumenseek.functions.paths import IGNORE_PATTERNS


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
        elif c == "*":
            i += 2 if pattern.startswith("**", i) else 1
            out += ".*" if pattern.startswith("**", i - 2) and i >= 2 else "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Ignore:
    """Rules in order; the last that fits a path, or a folder above it, decides."""

    def __init__(self, lines: list[str] | None = None):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in [*IGNORE_PATTERNS, *(lines or [])]:
            self.add(line)

    def add(self, line: str) -> None:
        line = line.rstrip("\r\n")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            return
        keep = line.startswith("!")
        line = line[1:] if keep else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        self.rules.append((re.compile(f"^{'' if anchored else '(?:.*/)?'}{body}$"), keep, folder))

    def __call__(self, path: str) -> bool:
        """Whether path (relative, with slashes) is ignored; an empty path is."""
        parts = path.split("/")
        if not path:
            return True
        for n in range(1, len(parts) + 1):
            head, gone = "/".join(parts[:n]), False
            for rule, keep, folder in self.rules:
                if rule.match(head) and (not folder or n < len(parts)):
                    gone = not keep
            if gone:
                return True
        return False
