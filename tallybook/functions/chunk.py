"""Recursive character splitting (D3).

The rule: a text is marked at the first of the separators (blank line, line
feed, blank, every character) that it holds, each mark before its separator.  Neighbouring
pieces form windows of at most ``size`` characters; the next window
starts at the first mark that keeps at most ``overlap`` characters of the last
one and leaves room for the following piece.  A piece of ``size`` or more is marked again
by the later separators.  Outer blanks of a chunk go, and so do empty chunks.

Everything is a span (start, end) of the text, found one after the other: of the marks only those of the
open window are held, so a text of any length takes little more than itself.  Spark applies this
helper per document in Arrow batches (:func:`tallybook.operators.docs.chunk_text`).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

# Fixed values of the reference's splitter.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", " ", "")


Span = tuple[int, int]


def marks(text: str, span: Span, sep: str) -> Iterator[int]:
    """Both ends of the span and the place of each ``sep`` inside it (every place for an empty one), in order."""
    lo, hi = span
    if not sep:
        yield from range(lo, hi + 1)
        return
    yield lo
    at = text.find(sep, lo, hi)
    while at >= 0:
        if at > lo:
            yield at
        at = text.find(sep, at + len(sep), hi)
    yield hi


class Run:
    """Windows over marks, given one by one, whose gaps are all below ``size``; holds the open window's marks."""

    def __init__(self, first: int, size: int, overlap: int):
        self.at, self.size, self.overlap = [first], size, overlap

    def add(self, mark: int) -> Iterator[Span]:
        """The windows that this mark closes."""
        at = self.at
        at.append(mark)
        while mark - at[0] > self.size:
            end = bisect_right(at, at[0] + self.size) - 1
            yield at[0], at[end]
            # the earliest start that neither repeats too much nor crowds out the next piece
            del at[:min(end, max(bisect_left(at, at[end] - self.overlap), bisect_left(at, at[end + 1] - self.size)))]

    def close(self) -> Iterator[Span]:
        """The last window, where there is a piece."""
        if len(self.at) > 1:
            yield self.at[0], self.at[-1]


def even_windows(span: Span, size: int, overlap: int) -> Iterator[Span]:
    """The windows of a :class:`Run` over a mark at every place."""
    lo, hi = span
    while hi - lo > size:
        yield lo, lo + size
        lo = min(lo + size, max(lo + size - overlap, lo + 1))
    if hi > lo:
        yield lo, hi


def spans(text: str, span: Span, separators: tuple[str, ...], size: int, overlap: int) -> Iterator[Span]:
    held = [k for k, s in enumerate(separators) if not s or text.find(s, *span) >= 0]
    level = held[0] if held else len(separators) - 1
    if not separators[level] and size > 1:
        yield from even_windows(span, size, overlap)
        return
    finer = separators[level + 1:]
    run = Run(span[0], size, overlap)
    for left, right in pairwise(marks(text, span, separators[level])):
        if right - left < size:
            yield from run.add(right)
            continue
        yield from run.close()
        yield from spans(text, (left, right), finer, size, overlap) if held and finer else [(left, right)]
        run = Run(right, size, overlap)
    yield from run.close()


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, str]]:
    """``(start, chunk)``, one by one: each chunk without outer blanks, and its place in the text."""
    if overlap > size:
        raise ValueError("overlap larger than chunk size")
    for a, b in spans(text, (0, len(text)), tuple(separators), size, overlap):
        piece = text[a:b].lstrip()
        if piece:
            yield b - len(piece), piece.rstrip()


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    return [chunk for _, chunk in chunk_spans(text or "", size, overlap, separators)]
