"""Lines of one text as columns: masks, islands, groups in order of first sight.

What the line operators do with windows over a table of lines, here over the lines of one text that lies in one row:
a mask says which lines are of a kind, an island is a run that a marked line opens, a group is what shares a key.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass
from itertools import compress


@dataclass(frozen=True)
class Lines:
    """The lines of a text."""

    rows: list[str]

    @classmethod
    def of(cls, text: str) -> Lines:
        return cls(text.split("\n"))

    def __len__(self) -> int:
        return len(self.rows)

    def mask(self, test: Callable[[str], object]) -> list[bool]:
        """Which lines pass ``test``."""
        return [bool(test(row)) for row in self.rows]

    def at(self, keep: Iterable[int]) -> list[str]:
        return [self.rows[k] for k in keep]


def where(mask: list[bool]) -> list[int]:
    """Numbers of the lines that a mask names."""
    return list(compress(range(len(mask)), mask))


def islands(opens: list[bool], goes_on: list[bool]) -> list[range]:
    """Runs that begin at a line of ``opens`` and last while lines are of ``goes_on``."""
    out, start = [], None
    for k, (opening, going) in enumerate(zip(opens, goes_on)):
        if opening or not going:
            if start is not None:
                out.append(range(start, k))
            start = k if opening else None
    return out if start is None else [*out, range(start, min(len(opens), len(goes_on)))]


def grouped(items: Iterable, key: Callable[[object], Hashable]) -> dict:
    """Items by key, both in order of first sight."""
    out: dict = {}
    for item in items:
        out.setdefault(key(item), []).append(item)
    return out


def with_gaps(lines: Lines, keep: list[int], mark: Callable[[int], str]) -> list[str]:
    """The kept lines in order, with a mark that says how many were left out between two of them."""
    before = [None, *keep]
    gaps = [0 if b is None else k - b - 1 for b, k in zip(before, keep)]
    return [piece for k, gap in zip(keep, gaps) for piece in ([mark(gap)] if gap else []) + [lines.rows[k]]]
