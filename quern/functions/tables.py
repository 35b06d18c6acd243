"""Tables drawn with box characters in official texts, as cells with spans.

A table is read only where every line of it is certain: each side of each cell is drawn
in full or not at all. Anything else (tabs, other box characters, text beside the table,
a broken border) leaves the table unread; nothing is repaired or guessed.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Which ways each box character leads (left, right, up, down); tables of more cells are left as text.
LEADS = {"─": "lr", "│": "ud", "┌": "rd", "┐": "ld", "└": "ru", "┘": "lu", "├": "urd", "┤": "uld", "┬": "lrd", "┴": "lru", "┼": "lrud"}
MOST_CELLS = 20_000
#: Columns that a box character takes.
DRAWN = 2

CELLS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("row", "col", "rowspan", "colspan")] + [T.StructField("text", T.StringType())]))


def char_width(c: str) -> int:
    """Columns of a character: one for ASCII and the no-break space, none for a mark, four for a tab, else two, box characters included."""
    if c == "\t":
        return 4
    if ord(c) < 0x7F or c == "\xa0":
        return 1
    return 0 if unicodedata.category(c).startswith("M") else 2


def is_box(c: str) -> bool:
    return "─" <= c <= "╿"


def placed(line: str) -> dict[int, str]:
    """The characters of a line by the column that each begins in, marks with the one that they stand on."""
    out: dict[int, str] = {}
    x = last = 0
    for c in line:
        if w := char_width(c):
            out[x], last = c, x
            x += w
        elif out:
            out[last] += c
    return out


def border(ends: list[bool], between: list[bool], boxes: bool) -> bool | None:
    """Whether a border is there (its ends and all between), absent (neither end, nor any box character between), or broken (None)."""
    if between and all(ends) and all(between):
        return True
    return None if any(ends) or boxes else False


class Groups:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Grid:
    """Lines of a drawn table with the columns and lines at which cells may end."""

    def __init__(self, text: str) -> None:
        raw = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
        self.lines = [placed(x) for x in raw]
        ends = [x for line in self.lines for x, c in line.items() if set(LEADS.get(c, "")) & {"u", "d"}]
        self.xs = sorted(set(ends))
        self.ys = [y for y, line in enumerate(self.lines) if "─" in line.values()]
        whole = len(raw) >= 3 and len(self.xs) >= 2 and len(self.ys) >= 2 and self.ys[0] == 0 and self.ys[-1] == len(raw) - 1
        known = not any("\t" in x or any(is_box(c) and c not in LEADS for c in x) for x in raw)
        self.certain = whole and known and all(self.xs[0] <= x <= self.xs[-1] or not c.strip() for line in self.lines for x, c in line.items())

    def leads(self, y: int, x: int, way: str) -> bool:
        return way in LEADS.get(self.lines[y].get(x, ""), "")

    def above(self, r: int, c: int) -> bool | None:
        """The border over cell (r, c)."""
        y, a, b = self.ys[r], self.xs[c], self.xs[c + 1]
        inner = [x for x in self.lines[y] if a < x < b]
        closed = bool(inner) and min(inner) == a + DRAWN and max(inner) + DRAWN == b
        level = [self.leads(y, x, "l") and self.leads(y, x, "r") for x in inner]
        return border([self.leads(y, a, "r"), self.leads(y, b, "l")], [closed, *level], any(is_box(self.lines[y][x]) for x in inner))

    def before(self, r: int, c: int) -> bool | None:
        """The border to the left of cell (r, c)."""
        x, a, b = self.xs[c], self.ys[r], self.ys[r + 1]
        inner = [self.lines[y].get(x, "") for y in range(a + 1, b)]
        if not inner:
            return None
        return border([self.leads(a, x, "d"), self.leads(b, x, "u")], [v == "│" for v in inner], any(v and is_box(v) for v in inner))

    def inside(self, top: int, bottom: int, left: int, right: int) -> str | None:
        """What stands in the cells from (top, left) to before (bottom, right), a line for each of theirs; None if it crosses a border."""
        out = []
        for y in range(self.ys[top] + 1, self.ys[bottom]):
            part = {x: c for x, c in self.lines[y].items() if self.xs[left] + DRAWN <= x < self.xs[right]}
            if any(is_box(c) or x + char_width(c[0]) > self.xs[right] for x, c in part.items()):
                return None
            if part:
                out.append("".join(c for _, c in sorted(part.items())))
        return "\n".join(out)


def cells_of(text: str) -> list[tuple[int, int, int, int, str]] | None:
    """(row, column, rows, columns, text) of every cell; None if the table is not certain."""
    grid = Grid(text)
    across, down = len(grid.xs) - 1, len(grid.ys) - 1
    if not grid.certain or across * down > MOST_CELLS:
        return None
    groups = Groups(across * down)
    walls = [(grid.above(r, c), 0 < r < down, (r - 1) * across + c, r * across + c) for r in range(down + 1) for c in range(across)]
    walls += [(grid.before(r, c), 0 < c < across, r * across + c - 1, r * across + c) for r in range(down) for c in range(across + 1)]
    for there, inner, one, other in walls:
        if there is None or not (there or inner):
            return None
        if not there:
            groups.join(one, other)
    members: dict[int, list[int]] = {}
    for k in range(across * down):
        members.setdefault(groups.find(k), []).append(k)
    out = []
    for ks in members.values():
        (top, left), (bottom, right) = divmod(min(ks), across), (max(ks) // across + 1, max(k % across for k in ks) + 1)
        words = grid.inside(top, bottom, left, right)
        if words is None or min(k % across for k in ks) < left or (bottom - top) * (right - left) != len(ks):
            return None
        out.append((top, left, bottom - top, right - left, words))
    return sorted(out)


@F.pandas_udf(CELLS)
def table_cells(texts: pd.Series) -> pd.Series:
    """Cells of a drawn table, null where it can't be read safely."""
    return texts.map(lambda t: cells_of(t) if t else None)


@F.pandas_udf(T.LongType())
def text_width(texts: pd.Series) -> pd.Series:
    """Columns that a text takes in a drawn table."""
    return texts.map(lambda t: None if t is None else sum(map(char_width, t))).astype("Int64")
