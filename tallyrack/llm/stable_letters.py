"""Code points of which every Unicode version says the same.

Python, the tokenizers library and regular-expression modules each bring tables of another Unicode
version.  A code point that was assigned in version 3.2, as its small letter was, and has kept its
category since is the same to all of them; a text with any other one is given to the library
instead of being cut here.
"""

from __future__ import annotations

import unicodedata
from functools import cache


def _ranges(points: list[int]) -> str:
    """The body of a character class."""
    out, start = [], None
    for p, after in zip(points, [*points[1:], None], strict=True):
        start = p if start is None else start
        if after != p + 1:
            out.append(f"\\U{start:08x}-\\U{p:08x}")
            start = None
    return "".join(out)


@cache
def classes() -> dict[str, str]:
    """Bodies of the character classes ``all``, ``letter``, ``number`` and ``space``."""
    found: dict[str, list[int]] = {"all": [], "letter": [], "number": [], "space": []}
    now, then = unicodedata.category, unicodedata.ucd_3_2_0.category
    for p in range(0x110000):
        c = chr(p)
        kind = now(c)
        # information separators are white space to some and not to others
        if kind in ("Cn", "Cs") or kind != then(c) or 0x1C <= p <= 0x1F or any(then(x) == "Cn" for x in c.lower()):
            continue
        found["all"].append(p)
        if kind[0] in "LN":
            found["letter" if kind[0] == "L" else "number"].append(p)
        elif c.isspace():
            found["space"].append(p)
    return {name: _ranges(points) for name, points in found.items()}


def outside() -> str:
    """A pattern of what only the library may cut."""
    return f"[^{classes()['all']}]"


def word_pattern(published: str) -> str:
    r"""A published word pattern in terms of these classes: ``\p{L}``, ``\p{N}`` and ``\s`` alone or
    inside a class, ``\S``."""
    known = classes()
    inside = {"\\s": known["space"], "\\p{L}": known["letter"], "\\p{N}": known["number"]}
    out, at, deep = [], 0, False
    while at < len(published):
        name = next((n for n in (*inside, "\\S") if published.startswith(n, at)), published[at])
        at += len(name)
        deep = (deep or name == "[") and name != "]"
        out.append(inside[name] if deep and name in inside else f"[{inside[name]}]" if name in inside else f"[^{known['space']}]" if name == "\\S" else name)
    return "".join(out)
