"""Python ``re`` patterns for Spark's Java regex functions.

Rules come as Python patterns. Python matches Unicode text by default and counts
U+001C..U+001F as whitespace; Java does neither. The prefix ``(?Ud)`` switches Java to
Unicode classes and to ``\\n`` as the only line end; the escapes below cover the rest.
"""

from __future__ import annotations

import re

PREFIX = "(?Ud)"
SPACE = r"\s\x1c-\x1f"  # what Python's \s matches, as the inside of a class
WORD = r"\p{L}\p{N}_"  # likewise \w

_OUTSIDE = {
    r"\s": f"[{SPACE}]",
    r"\S": f"[^{SPACE}]",
    r"\w": f"[{WORD}]",
    r"\W": f"[^{WORD}]",
    r"\b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    r"\B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
    r"\Z": r"\z",
}
_INSIDE = {r"\s": SPACE, r"\w": WORD, r"\b": r"\x08"}
_PIECE = re.compile(
    r"(?P<esc>\\.)|(?P<open>\[\^?\]?)|(?P<close>\])|(?P<amp>&&)"
    r"|\(\?P<(?P<group>\w+)>|\(\?P=(?P<back>\w+)\)|.",
    re.DOTALL,
)


def to_java(pattern: str) -> str:
    """The Java form of a Python pattern, with the Unicode prefix."""
    inside = False

    def swap(m: re.Match) -> str:
        nonlocal inside
        piece = m.group()
        if m["esc"]:
            if not inside:
                return _OUTSIDE.get(piece, piece)
            if piece in (r"\S", r"\W"):
                raise ValueError(f"{piece} inside a character class is not supported: {pattern}")
            return _INSIDE.get(piece, piece)
        if inside:
            if m["close"]:
                inside = False
            elif m["open"] or m["amp"]:  # plain characters in a Python class
                closes = piece.endswith("]")
                inside = not closes
                return re.sub(r"([\[^&])", r"\\\1", piece)
            return piece
        if m["open"]:
            inside = True
            return piece.replace("]", r"\]")
        if m["group"]:
            return f"(?<{m['group']}>"
        if m["back"]:
            return rf"\k<{m['back']}>"
        return piece

    return PREFIX + _PIECE.sub(swap, pattern)
