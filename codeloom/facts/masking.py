"""Masking of comments and strings without changing lengths (C15, C16), and content classes (C17)."""

from __future__ import annotations

import re

C_LIKE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
HASH_LIKE = re.compile(r'''#[^\n]*|"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\'''', re.S)
HASH_EXTENSIONS = frozenset("py rb ex exs yml yaml sh toml tf".split())


def pattern_for(ext: str) -> re.Pattern:
    return HASH_LIKE if ext in HASH_EXTENSIONS else C_LIKE


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def strip_comments(source: str, ext: str = "ts") -> str:
    """Comments as blanks; strings stay."""
    return pattern_for(ext).sub(lambda m: blank(m[0]) if m[0][0] in "/#" else m[0], source)


def mask_strings(source: str, ext: str = "ts") -> str:
    """The inside of strings as blanks; quotes stay."""
    return pattern_for(ext).sub(lambda m: blank(m[0]) if m[0][0] in "/#" else m[0][0] + blank(m[0][1:-1]) + m[0][-1:] if len(m[0]) > 1 else m[0], source)


def classify(source: str, ext: str) -> str:
    """empty, comments-only or content."""
    if not source.strip():
        return "empty"
    return "content" if strip_comments(source, ext).strip() else "comments-only"


def line_at(source: str, offset: int) -> int:
    return source.count("\n", 0, offset) + 1
