"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """A statement that can't be read, with the place where reading stopped."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, fstring, number, time, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_PATTERNS = [
    ("space", r"\s+|--[^\n]*"),
    ("time", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("width", r"\d+(?:ms|[smhd])\b"),
    ("number", r"(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?"),
    ("fstring", r"[fF]'(?:[^']|'')*'"),
    ("string", r"'(?:[^']|'')*'"),
    ("quoted", r'"(?:[^"]|"")*"|`[^`]*`'),
    ("word", r"[^\W\d]\w*(?:\$\w*)*"),
    ("op", r"::|:=|<>|!=|<=|>=|\|\||->|\.\.|[-+*/%=<>()\[\]{},.:;]"),
]
_TOKEN = re.compile("|".join(f"(?P<{name}>{p})" for name, p in _PATTERNS))


def tokenize(text: str) -> list[Token]:
    """Tokens, without white space and comments (block comments nest)."""
    out, at = [], 0
    while at < len(text):
        if text.startswith("/*", at):
            depth, k = 1, at + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, k)
                if not m:
                    raise SqlError(f"comment at {at} has no end")
                depth += 1 if m[0] == "/*" else -1
                k = m.end()
            at = k
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def unquote(token: Token) -> str:
    body = token.text[1:-1]
    return body.replace(token.text[0] * 2, token.text[0])


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
