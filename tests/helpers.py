"""Brute-force references used by the tests (plain Python, one process)."""

from __future__ import annotations

import re

_BLANK = "".join(chr(c) for c in range(0x21))


def java_trim(s: str) -> str:
    return s.strip(_BLANK)


def _parse_long(s: str):
    if not re.fullmatch(r"[+-]?[0-9]+", s):
        raise ValueError(s)
    return int(s)


def _parse_double(s: str):
    t = java_trim(s)
    if not t or any(ch in _BLANK for ch in t):
        raise ValueError(s)
    return float(t)


def java_split(s: str, sep: str = ",") -> list[str]:
    parts = s.split(sep)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def _parsed(line: str):
    try:
        parts = java_split(line)
        return _parse_long(parts[0]), _parse_double(parts[1]), _parse_double(parts[2])
    except (ValueError, IndexError):
        return None


def sequential_blocks(files: list[list[str]]) -> list[tuple]:
    """Block rows of whole files: cut the lines at every marker and keep the
    pieces that follow a header."""
    out = []
    for lines in files:
        text = [java_trim(x) for x in lines]
        cuts = [i for i, x in enumerate(text) if x.startswith(("[", "timestamp"))]
        for start, end in zip(cuts, [*cuts[1:], len(text)]):
            if text[start].startswith("timestamp"):
                out += [r for r in map(_parsed, text[start + 1:end]) if r is not None]
    return out


def rows(df, cols=None):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
