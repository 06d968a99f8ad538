"""Tokens of the dialect."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, quoted, string, blob, number, op, param, end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<blob>[xX]'[0-9A-Fa-f]*')
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])
    |(?P<number>0[xX][0-9A-Fa-f]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?)
    |(?P<name>[^\W\d]\w*)
    |(?P<op>->>|->|\|\||<<|>>|<=|>=|<>|!=|==|[-+*/%&|~<>=(),.;])""",
    re.S | re.X,
)


def lex(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SyntaxError(f"unrecognized token: {sql[at : at + 10]!r}")
        kind, text = m.lastgroup or "", m[0]
        if kind == "quoted":
            mark = text[-1]
            text = text[1:-1].replace(mark * 2, mark) if mark != "]" else text[1:-1]
        elif kind == "string":
            text = text[1:-1].replace("''", "'")
        elif kind == "blob":
            text = text[2:-1]
        elif kind == "number":
            text = text.replace("_", "")
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    out.append(Token("end", "", at))
    return out
