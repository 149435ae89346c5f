"""What stands to the right of boxes of the same page, in arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Questions that are asked at once.
ASKED = 1 << 20


@dataclass
class Boxes:
    """Boxes with the number of the page each is on."""

    page: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def take(self, at: np.ndarray) -> Boxes:
        return Boxes(self.page[at], self.x0[at], self.y0[at], self.x1[at], self.y1[at])


def expanded(begin: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, begin[i] + k) for each i and each k under n[i], some ``ASKED`` at once."""
    ends = np.cumsum(n)
    at, done = 0, 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, done + ASKED, "right")))
        i = np.repeat(np.arange(at, to), n[at:to])
        k = np.arange(len(i)) - np.repeat(ends[at:to] - n[at:to] - done, n[at:to])
        for part in range(0, len(i), ASKED):
            x = i[part : part + ASKED]
            yield x, begin[x] + k[part : part + ASKED]
        done, at = int(ends[to - 1]), to


class Rows:
    """Boxes of one page and height are a row. Rows stand by page and upper side; ``order``: boxes by row and left side; those of row r begin at ``begin[r]`` there."""

    def __init__(self, boxes: Boxes):
        by = np.lexsort((boxes.x1, boxes.x0, boxes.y1, boxes.y0, boxes.page))
        b = boxes.take(by)
        new = np.ones(len(by), bool)
        new[1:] = (b.page[1:] != b.page[:-1]) | (b.y0[1:] != b.y0[:-1]) | (b.y1[1:] != b.y1[:-1])
        self.order, self.boxes, self.begin = by, b, np.flatnonzero(new)
        self.row = np.cumsum(new) - 1
        self.n = np.diff(np.append(self.begin, len(by)))
        self.page, self.y0, self.y1 = b.page[self.begin], b.y0[self.begin], b.y1[self.begin]

    def meeting(self, page: np.ndarray, y1: np.ndarray) -> np.ndarray:
        """For each of some boxes where the rows of its page that begin at or above its lower side end."""
        at = np.lexsort((np.concatenate([np.zeros(len(self.y0)), np.ones(len(y1))]), np.concatenate([self.y0, y1]), np.concatenate([self.page, page])))
        mine = at >= len(self.y0)
        out = np.zeros(len(y1), np.int64)
        out[at[mine] - len(self.y0)] = np.cumsum(~mine)[mine]
        return out


def first_above(values: np.ndarray, begin: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each of some places the first one from there on whose value is above a bound; the end where there is none. Halved, not walked."""
    levels = [values]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        step, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.maximum(last[:-step], last[step:]))
    at = begin.copy()
    for k in range(len(levels) - 1, -1, -1):
        top = levels[k]
        fits = at < len(top)
        fits[fits] = top[at[fits]] <= bound[fits]
        at[fits] += 1 << k
    return at


def text_walls(spans: Boxes, level: np.ndarray, touch: float) -> np.ndarray:
    """For each level span the least left side of text ahead of it; infinite where there is none, and for others.

    Text is ahead if it begins at or after the span's end (``touch`` aside), or is kerned into it: it begins and ends further right, in a row of the same line. Only rows that overlap are paired, and a row answers
    by two searches for each span: where is the first text after its end, and, in a row of the same line, the first one that begins and ends further right.
    """
    wall = np.full(len(spans.x0), np.inf)
    r = Rows(spans)
    b, level = r.boxes, level[r.order]
    values = np.unique(b.x0)
    key = r.row * (len(values) + 1) + np.searchsorted(values, b.x0)
    after_end, after_begin = np.searchsorted(values, b.x1 - touch), np.searchsorted(values, b.x0, "right")
    found = np.full(len(b.x0), np.inf)
    ends = r.begin + r.n

    def ask(a: np.ndarray, other: np.ndarray, kern: np.ndarray) -> None:
        """Boxes ``a`` ask the rows ``other``."""
        at = np.searchsorted(key, other * (len(values) + 1) + after_end[a])
        at += (at < ends[other]) & (at == a)  # itself
        ok = at < ends[other]
        np.minimum.at(found, a[ok], b.x0[at[ok]])
        a, other = a[kern], other[kern]
        at = np.searchsorted(key, other * (len(values) + 1) + after_begin[a])
        # text that begins at the span's end has been told
        near = at < ends[other]
        near[near] = b.x0[at[near]] < b.x1[a[near]] - touch
        a, other, at = a[near], other[near], at[near]
        if len(a):
            at = first_above(b.x1, at, b.x1[a])
            ok = at < ends[other]
            np.minimum.at(found, a[ok], b.x0[at[ok]])

    height = r.y1 - r.y0
    until = r.meeting(r.page, r.y1)
    mine = np.arange(len(r.n))
    for i, j in expanded(mine, np.maximum(until - mine, 0)):
        shared = np.minimum(r.y1[i], r.y1[j]) - np.maximum(r.y0[i], r.y0[j])
        met = shared > touch
        i, j, kern = i[met], j[met], (shared > np.minimum(height[i], height[j]) / 2)[met]
        apart = i != j
        rows, others, kern = np.concatenate([i, j[apart]]), np.concatenate([j, i[apart]]), np.concatenate([kern, kern[apart]])
        for pair, a in expanded(r.begin[rows], r.n[rows]):
            asks = level[a]
            ask(a[asks], others[pair[asks]], kern[pair[asks]])
    wall[r.order] = found
    return wall


def art_walls(spans: Boxes, level: np.ndarray, art: Boxes, touch: float) -> np.ndarray:
    """For each level span the least side of art beside it that is not behind it: the near side of art ahead, the far side of art it stands in; infinite where there is none, and for others."""
    wall = np.full(len(spans.x0), np.inf)
    at = np.flatnonzero(level)
    r = Rows(spans.take(at))
    b, found = r.boxes, np.full(len(at), np.inf)
    until = r.meeting(art.page, art.y1)
    begin = np.searchsorted(r.page, art.page)
    for t, row in expanded(begin, np.maximum(until - begin, 0)):
        met = np.minimum(art.y1[t], r.y1[row]) - np.maximum(art.y0[t], r.y0[row]) > touch
        t, row = t[met], row[met]
        for pair, a in expanded(r.begin[row], r.n[row]):
            of, end = t[pair], b.x1[a] - touch
            beside = art.x1[of] >= end
            np.minimum.at(found, a[beside], np.where(art.x0[of] >= end, art.x0[of], art.x1[of])[beside])
    wall[at[r.order]] = found
    return wall


def rooms(spans: Boxes, level: np.ndarray, art: Boxes, touch: float) -> np.ndarray:
    """How far each span can run right before text or art ahead of it, and never past the page's rightmost text. One that is not level has 0."""
    if not len(spans.x0):
        return np.zeros(0)
    pages, of = np.unique(spans.page, return_inverse=True)
    margin = np.full(len(pages), -np.inf)
    np.maximum.at(margin, of, spans.x1)
    wall = np.minimum(np.minimum(text_walls(spans, level, touch), art_walls(spans, level, art, touch)), margin[of])
    return np.where(level, np.maximum(wall - spans.x1, 0.0), 0.0)


def near_text(spans: Boxes, level: np.ndarray, art: Boxes, touch: float, lines: float) -> tuple[np.ndarray, np.ndarray]:
    """For each piece of art whether its height overlaps some level span's of its page, and whether it is taller than ``lines`` of the page's tallest level spans."""
    r = Rows(spans.take(np.flatnonzero(level)))
    near, tallest = np.zeros(len(art.x0), bool), np.full(len(art.x0), -np.inf)
    begin = np.searchsorted(r.page, art.page)
    for t, row in expanded(begin, np.searchsorted(r.page, art.page, "right") - begin):
        np.maximum.at(tallest, t, r.y1[row] - r.y0[row])
        near[t[np.minimum(art.y1[t], r.y1[row]) - np.maximum(art.y0[t], r.y0[row]) > touch]] = True
    return near, art.y1 - art.y0 > lines * tallest
