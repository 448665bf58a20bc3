"""Spans of text: (start, end, kind) in code points, end exclusive; kinds are numbered in the order of a list of names."""

from __future__ import annotations

from bisect import bisect_left

Span = tuple[int, int, int]


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def masked(text: str, spans: list[Span], names: list[str]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first span's kind."""
    out, at, end = [], 0, -1
    for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], names[k]]
        end = b
    return "".join(out) + text[end if end >= 0 else 0 :]


class Covered:
    """Whether a stretch of text meets any of some spans, in the time of a binary search."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a
