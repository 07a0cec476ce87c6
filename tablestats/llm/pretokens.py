"""Pre-tokens: the matches of the byte-level BPE split pattern, found without a regex engine.

``starts`` marks every pre-token start of many texts at once with numpy; the
rules below restate the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\s L N]+|\\s+(?!\\S)|\\s+

over runs of character classes. Texts that hold a code point unassigned in this
Python's Unicode tables are left to the tokenizer library (``uncertain``), whose
tables may be newer.

Pre-token boundaries have no memory: matching from a true boundary gives the
same tokens whatever came before. ``safe_cut`` finds positions that are
boundaries in every tokenisation, so texts of any length are cut there and
worked on piece by piece.
"""

from __future__ import annotations

import bisect
import functools
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 4

#: White space of the pattern: Unicode's White_Space property (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# A letter or other symbol before white space, or a letter before a symbol,
# always ends a pre-token.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}\p{N}])")


#: Code points from here on are looked up by the library (rare scripts, private use).
TABLE = 0x33480


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    kinds = [unicodedata.category(c) for c in map(chr, range(TABLE))]
    out = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
    out[:TABLE] = [UNKNOWN if k == "Cn" else of.get(k[0], OTHER) for k in kinds]
    out[WHITE_SPACE] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def uncertain(points: np.ndarray) -> bool:
    return bool(len(points)) and int(points.max()) >= 0x378 and bool((classes()[points] == UNKNOWN).any())


def starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. ``firsts``: where each (non-empty) text begins, ascending."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:n]
    # White space before something else of the same text: its last character
    # stands alone, or goes with what follows if it is a space.
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[last] = True
    start[last + 1] = points[last] != 0x20
    # Contractions, where an apostrophe starts a pre-token.
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    if len(at):
        one = points[at + 1]
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        two[first[np.minimum(at + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((short, 2), (long, 3)):
            p = at[hit]
            start[p + 1] = False
            start[p[p + size < n] + size] = True
    return start


def pretoken_ends(text: str) -> list[int]:
    """End of every pre-token of one text, as character positions."""
    points = code_points(text)
    if uncertain(points):
        import public_tokenizers

        return [m.end() for m in regex.compile(public_tokenizers.PATTERN).finditer(text)]
    return [*np.flatnonzero(starts(points, np.zeros(1, np.int64)))[1:].tolist(), len(text)] if text else []


def safe_cut(text: str, at: int) -> int:
    """The first position from ``at`` on that every tokenisation has as a boundary, else the end."""
    m = _SAFE.search(text, at) if at < len(text) else None
    return m.start() if m else len(text)


def safe_pieces(text: str, size: int, uncut: Sequence[str] = ()) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at safe boundaries and never inside one of the literals ``uncut`` (longest first)."""
    held = [m.span() for m in regex.finditer("|".join(map(regex.escape, uncut)), text)] if len(text) > size and any(x in text for x in uncut) else []
    at = 0
    while len(text) - at > size:
        end = safe_cut(text, at + size)
        k = bisect.bisect_left(held, (end,)) - 1  # the last literal that begins before the cut
        while k >= 0 and end < held[k][1]:
            end = safe_cut(text, held[k][1])
            k = bisect.bisect_left(held, (end,)) - 1
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]
