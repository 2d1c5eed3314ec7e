"""Splitting of texts into pre-tokens, as tokenizer libraries of Unicode 16 do it."""

from __future__ import annotations

import re

import regex

#: Letters and numbers that Unicode assigned after version 16. The pattern module
#: knows them; for the tokenizer libraries they are neither letter nor number.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f "
    "12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 "
    "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 "
    "3d000-3fc3f"
)
_RANGES = [[int(x, 16) for x in f"{r}-{r}".split("-")[:2]] for r in LATER.split()]
_LATER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES) + "]")

#: Letters, numbers and white space below U+0100.
_LATIN = {
    r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff",
    r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe",
    r"\s": "\t-\r \x85\xa0",
}


def latin_pattern(pattern: str) -> re.Pattern | None:
    """A plain pattern that agrees with the given one on texts below U+0100.

    None where the pattern holds classes other than letters, numbers and white space.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        step = next((n for n in (5, 2) if pattern[i : i + n] in _LATIN), 0)
        if step:
            body = _LATIN[pattern[i : i + step]]
            out.append(body if inside else f"[{body}]")
        elif pattern[i : i + 2] == r"\S" and not inside:
            step = 2
            out.append(f"[^{_LATIN[chr(92) + 's']}]")
        elif pattern[i] == "\\":
            return None
        else:
            step = 1
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
        i += step
    return re.compile("".join(out))


class Splitter:
    """All matches of a pattern in a text, in order."""

    def __init__(self, pattern: str):
        self.general = regex.compile(pattern)
        latin = latin_pattern(pattern)
        self.latin = latin.findall if latin else None

    def __call__(self, text: str) -> list[str]:
        if self.latin:
            try:
                text.encode("latin-1")
                return self.latin(text)
            except UnicodeEncodeError:
                pass
        if not _LATER.search(text):
            return self.general.findall(text)
        # A private-use character is neither letter, number nor white space in any version.
        known = _LATER.sub("\ue000", text)
        return [text[m.start() : m.end()] for m in self.general.finditer(known)]
