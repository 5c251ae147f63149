"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles. Shingles that only one document has
can't be common to two passages, so they come last in every order, and only
stretches of a passage's width that hold enough others are looked at. Under each of
``HASHES`` orders of the shingles, a Cartesian tree over their hashes gives compact
windows (left, centre, right): every stretch within left..right that holds the
centre has the centre as its least shingle. Only windows at least a passage wide are
kept, O(n / width) of them. Passages of similarity s share a centre's shingle in each
order with probability s at least, so windows are grouped by (order, shingle). Within
a group, windows that have the same shared shingles around the centre are one class,
met through its first member; the classes' intervals are joined: each class with all
earlier ones, by marks of the shared shingles around the centre. What passes is verified on the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from . import graph
from .common import ROLL, Words, collect_garbage, cut, mix, shuffles, sliding_min, trim

WORDS = 5
#: A passage has so many words at least.
PASSAGE = 50
PERCENT = 75
#: Orders. A passage pair of similarity 0.75 shares a centre's shingle in none of 3 with probability 0.016 at one place,
#: and never where the shingles that differ are in no other text, as those come last.
HASHES = 3
#: Shifts between two texts that count as one diagonal, in shingles.
SLACK = 8
#: Replies of at most so many bytes are broadcast: the driver holds them several times while it does so.
BROADCAST_BYTES = 24 << 20

_LOW = np.uint64((1 << 30) - 1)
_LAST = np.uint64((1 << 64) - 1)


def compact_windows(values: np.ndarray, doc: np.ndarray, first: np.ndarray, stop: np.ndarray, width: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right, all inclusive) of the compact windows at least ``width`` wide, over texts in a row.

    With ``among``, a mark for each start of a stretch of that width, only windows
    whose centre is the least of a marked stretch are returned.

    Nodes that wide are the leftmost least values of windows of that width; so are
    their ancestors in the Cartesian tree, and a node's bounds are ancestors. So the
    tree is built, with a stack, over those nodes alone. first and stop are each
    text's bounds.
    """
    n = len(values) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    if len(values) > _LOW:
        raise ValueError("a text of more than a billion shingles")
    tagged = (values & ~_LOW) | np.arange(len(values), dtype=np.uint64)
    at = (sliding_min(tagged, width) & _LOW).astype(np.int64)
    least = np.zeros(len(values), bool)
    least[at[doc[:n] == doc[width - 1 :]]] = True
    # A value that comes last bounds no other window.
    centre = np.flatnonzero(least & (values != _LAST))
    if not len(centre):
        return (np.empty(0, np.int64),) * 3
    key = tagged[centre].tolist()
    place, own = centre.tolist(), doc[centre].tolist()
    lo, hi = first.tolist(), (stop - 1).tolist()
    left, right = [0] * len(place), [0] * len(place)
    stack: list[int] = []
    here = -1
    for i, k in enumerate(key):
        if own[i] != here:
            for j in stack:
                right[j] = hi[here]
            stack, here = [], own[i]
        while stack and key[stack[-1]] > k:
            right[stack.pop()] = place[i] - 1
        left[i] = place[stack[-1]] + 1 if stack else lo[here]
        stack.append(i)
    for j in stack:
        right[j] = hi[here]
    left, right = np.array(left), np.array(right)
    wide = right - left + 1 >= width
    if among is not None:
        marked = np.zeros(len(values), bool)
        marked[at[among]] = True
        wide &= marked[centre]
    return left[wide], centre[wide], right[wide]


class Shingled:
    """The shingles of a chunk's texts, in order."""

    def __init__(self, texts: list[bytes]):
        w = Words([t.lower() for t in texts])
        self.hash, at = w.grams(WORDS)
        self.doc = w.doc[at]
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.stop = np.searchsorted(self.doc, np.arange(len(texts)), side="right")

    def windows(self, width: int):
        """(left, centre, right, key of order and shingle) of each order."""
        for f in range(HASHES):
            values = mix(self.hash ^ np.uint64((f + 1) * ROLL % (1 << 64)))
            left, centre, right = compact_windows(values, self.doc, self.first, self.stop, width)
            yield left, centre, right, values[centre]

    def shared_windows(self, width: int, shared: np.ndarray, least: int):
        """As ``windows``, of stretches with at least so many shared shingles; shingles of one document come last."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return
        sums = np.concatenate([[0], np.cumsum(shared)])
        dense = (self.doc[:n] == self.doc[width - 1 :]) & (sums[width:] - sums[:-width] >= least)
        if not dense.any():
            return
        for f in range(HASHES):
            values = mix(self.hash ^ np.uint64((f + 1) * ROLL % (1 << 64)))
            order = np.where(shared, values >> np.uint64(1), _LAST)
            left, centre, right = compact_windows(order, self.doc, self.first, self.stop, width, dense)
            yield left, centre, right, values[centre]


#: Shingles more than a passage from the centre are not looked at. The others are kept as marks of so many bits,
#: and as coarser sketches that are compared first. _NONE is a place outside the window, _OWN one of a shingle that is in no other document.
MARK, SKETCH = 12, 1024
_NONE, _OWN = np.uint16(1 << MARK), np.uint16((1 << MARK) + 1)


def _marks(hashes: np.ndarray, shared: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int) -> np.ndarray:
    """A row of marks for each window: of the shared shingles from low to high, by place; _OWN for others there, _NONE elsewhere."""
    at = c[:, None] + np.arange(-reach, reach + 1)[None, :]
    inside = (at >= low[:, None]) & (at <= high[:, None])
    at = np.clip(at, 0, len(hashes) - 1)
    return np.where(inside, np.where(shared[at], (hashes >> np.uint64(64 - MARK)).astype(np.uint16)[at], _OWN), _NONE)


def _bitmaps(marks: np.ndarray, bits: int) -> np.ndarray:
    """The marks of each row as a set, in bytes."""
    n = len(marks)
    out = np.zeros((n, (1 << bits) // 8), np.uint8)
    rows = np.arange(n)
    for j in range(marks.shape[1]):
        inside = marks[:, j] < _NONE
        m = marks[inside, j].astype(np.int64) >> (MARK - bits)
        out[rows[inside], m >> 3] |= (1 << (m & 7)).astype(np.uint8)
    return out


_MARK_VALUE = mix(np.arange(1, (1 << MARK) + 2, dtype=np.uint64) * np.uint64(ROLL))


def _surroundings(marks: np.ndarray, width: int, common: int) -> np.ndarray:
    """Hash of the set of each row's marks, and of whether a stretch of a passage's width has as many as a link takes."""
    own = np.sort(np.minimum(marks, _NONE), axis=1)
    value = _MARK_VALUE[own]
    value[:, 1:][own[:, 1:] == own[:, :-1]] = 0
    able = ((_stretches(marks < _NONE, width) >= common) & (_stretches(marks != _NONE, width) == width)).any(axis=1)
    return mix(value.sum(axis=1, dtype=np.uint64) + able)


def _changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Is (a, b) another than the one before?"""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def _bits(sketch: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketch).sum(axis=1, dtype=np.int64)


#: Class pairs compared at once.
BLOCK = 1 << 13


def class_pairs(start: np.ndarray, row: np.ndarray, marks: np.ndarray, width: int, common: int, cover: bool = False, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(x, y, low, high, firm) of classes of one group, y before x, that have a passage in common by their marks; classes are ordered, start is the place of each one's group.

    low and high are the shingles of x in common, counted from the centre; firm says
    that the shingles of y are in x as well, in one stretch.

    A stretch of x of a passage's width around the centre is linked with y if ``common``
    of its shingles are in y. All pairs of classes with a linked stretch are returned. With
    ``cover`` a pair is left out where each of its linked stretches has an earlier partner
    that shares all that any can share, or clearly enough: a class is done when all its
    stretches have one, so a group of near copies meets in a few steps.

    A stretch that repeats itself has many places and few shingles, so a pair is also held
    against its sets (``_alike``): similarity is that of sets.
    """
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
    size = np.bincount(start, minlength=len(start))[start]
    several = np.flatnonzero(size > 1)
    n = len(several)
    if not n:
        return tuple(x[0] for x in out)
    rank, size, row, marks = (several - start[several]), size[several], row[several], marks[several]
    start = np.arange(n) - rank
    sketch = _bitmaps(marks, 10).view(np.uint64)
    fine = _bitmaps(marks, MARK)
    held = marks < _NONE
    whole, own = _bits(sketch), held.sum(axis=1)
    can = _stretches(held, width)
    # Of the shingles a class has, so many marks at least are in a partner: all but those outside a passage, and those missing in it.
    need = whole - (own - common)
    enough = np.minimum(can, common + 1)
    left = can >= common
    fewest, most = _fewest(marks, width)
    open_ = np.arange(n)
    for j in range(int(size.max()) - 1):
        open_ = open_[(rank[open_] > j) & left[open_].any(axis=1)]
        if not len(open_):
            break
        for at in range(0, len(open_), BLOCK):
            x = open_[at : at + BLOCK]
            y = start[x] + j
            fits = row[x] != row[y]
            x, y = x[fits], y[fits]
            both = _bits(sketch[x] & sketch[y])
            # What _alike asks, as far as sketches tell.
            shared = np.minimum(most[x], most[y])
            own = np.maximum(fewest[x] - both, 0) + np.maximum(fewest[y] - both, 0)
            ok = (both >= need[x]) & (percent * own <= (100 - percent) * (shared + shared // 16))
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            m = np.minimum(marks[x], _NONE - 1).astype(np.int64)
            hit = held[x] & ((fine[y[:, None], m >> 3] >> (m & 7).astype(np.uint8)) & 1).astype(bool)
            got = _stretches(hit, width)
            linked = got >= common
            new = (linked & left[x]).any(axis=1)
            x, y, got, linked = x[new], y[new], got[new], linked[new]
            # A partner with a long insert there has few of its own shingles in x.
            m = np.minimum(marks[y], _NONE - 1).astype(np.int64)
            back = held[y] & ((fine[x[:, None], m >> 3] >> (m & 7).astype(np.uint8)) & 1).astype(bool)
            near = _alike(marks[x], hit[new], linked, marks[y], back, width, percent)
            x, y, got, linked, back = x[near], y[near], got[near], linked[near], back[near]
            if not len(x):
                continue
            alike = _stretches(back, width).max(axis=1, initial=0) >= common
            if cover:
                left[x[alike]] &= (got < enough[x])[alike]
            low, high, one = _reach(linked, width)
            for held_, v in zip(out, (several[x], several[y], low, high, (alike & one).astype(np.int64)), strict=True):
                held_.append(v)
    return tuple(np.concatenate(v) for v in out)


def _alike(x: np.ndarray, hit: np.ndarray, linked: np.ndarray, y: np.ndarray, back: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Can passages around the centres of x and y be similar as sets? x and y are marks, hit and back say which are in the other's.

    Of all different shingles of two passages ``percent`` are shared, so what a linked stretch of x
    and a stretch of y have of their own is bounded by what is shared. All shared marks in
    reach count, and some more, as marks can clash.
    """
    before = _before(x)
    shared = (hit & (before < 0)).sum(axis=1)
    own = _own(~hit, before, linked & (_stretches(x != _NONE, width) == width), width) + _own(~back, _before(y), _stretches(y != _NONE, width) == width, width)
    return percent * own <= (100 - percent) * (shared + shared // 16)


def _fewest(marks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least number of bits that a stretch of each row within its window has in the sketch, and the number of different marks of the row."""
    fewest, most = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64)
    for at in range(0, len(marks), BLOCK):
        m = marks[at : at + BLOCK]
        inside = _stretches(m != _NONE, width) == width
        fewest[at : at + BLOCK] = _own(m < _NONE, _before(m >> (MARK - 10)), inside, width)
        most[at : at + BLOCK] = ((m < _NONE) & (_before(m) < 0)).sum(axis=1)
    return fewest, most


def _before(marks: np.ndarray) -> np.ndarray:
    """The place of the last equal mark before each, -1 if there is none."""
    order = np.argsort(marks, axis=1, kind="stable").astype(np.int16)
    ranked = np.take_along_axis(marks, order, axis=1)
    last = np.full(marks.shape, -1, np.int16)
    last[:, 1:] = np.where(ranked[:, 1:] == ranked[:, :-1], order[:, :-1], -1)
    out = np.empty_like(last)
    np.put_along_axis(out, order, last, axis=1)
    return out


def _own(lost: np.ndarray, before: np.ndarray, among: np.ndarray, width: int) -> np.ndarray:
    """The least number of different marks that are lost in one of the stretches of that width that hold the centre."""
    row, at = np.nonzero(lost)
    # A lost mark counts in the stretches that hold its place and no equal mark before it.
    low, high = np.maximum(np.maximum(before[row, at] + 1, at - width + 1), 1), np.minimum(at, width)
    some = low <= high
    row, low, high = row[some], low[some], high[some]
    size = len(lost) * (width + 2)
    steps = np.bincount(row * (width + 2) + low, minlength=size) - np.bincount(row * (width + 2) + high + 1, minlength=size)
    n = np.cumsum(steps.reshape(-1, width + 2), axis=1)[:, 1 : width + 1]
    return np.where(among, n, width + 1).min(axis=1, initial=width + 1)


def _reach(linked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place of each row's linked stretches, counted from the centre, and whether they are without a gap."""
    first, last = linked.argmax(axis=1), linked.shape[1] - 1 - linked[:, ::-1].argmax(axis=1)
    return first + 1 - width, last, linked.sum(axis=1) == last - first + 1


def _stretches(hit: np.ndarray, width: int) -> np.ndarray:
    """How many marks are set in each stretch of that width that holds the centre; rows are 2 * width + 1 wide."""
    sums = np.zeros((len(hit), hit.shape[1] + 1), np.int16)
    np.cumsum(hit, axis=1, dtype=np.int16, out=sums[:, 1:])
    return sums[:, width + 1 : 2 * width + 1] - sums[:, 1 : width + 1]


SENT = "bucket int, body binary, marks binary"
MATCH = "x long, y long, shift int, low int, high int, firm int"
KEPT = f"{MATCH}, bucket int, body binary, marks binary"


class Places:
    """Where the shingles of x are in y, for any diagonal."""

    def __init__(self, hx: np.ndarray, hy: np.ndarray, known: tuple | None = None):
        self.hx, self.hy = hx, hy
        distinct, self.places = known or self.ordered(hy)
        k = np.minimum(np.searchsorted(distinct, hx), max(len(distinct) - 1, 0))
        #: The shingles of x that are in y, with the index of each among y's distinct ones.
        self.at = np.flatnonzero(distinct[k] == hx) if len(hy) else np.empty(0, np.int64)
        self.kind = k[self.at]

    @staticmethod
    def ordered(hy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of y, and (shingle, place) of all in order."""
        order = np.argsort(hy, kind="stable")
        ids = hy[order]
        new = np.ones(len(hy), bool)
        new[1:] = ids[1:] != ids[:-1]
        return ids[new], (np.cumsum(new) - 1) * len(hy) + order

    def partners(self, shift: int) -> np.ndarray:
        """For each shingle of x the equal one of y nearest to the diagonal, -1 if none is near."""
        n, out = len(self.hy), np.full(len(self.hx), -1)
        if not len(self.at):
            return out
        wanted = np.clip(self.at - shift, 0, n - 1)
        right = np.searchsorted(self.places, self.kind * n + wanted)
        best, gap = np.full(len(self.at), -1), np.full(len(self.at), SLACK + 1)
        for near in (np.minimum(right, n - 1), np.maximum(right - 1, 0)):
            q = self.places[near]
            far = np.where(q // n == self.kind, np.abs(self.at - q % n - shift), SLACK + 1)
            best, gap = np.where(far < gap, q % n, best), np.minimum(far, gap)
        out[self.at] = best
        return out


def matched_runs(places: Places, shift: int, width: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Stretches (a, b, c, d; inclusive, in shingles) of x and y near the diagonal, at least width long, that are linked; they meet every linked window."""
    if len(places.hx) < width or (100 + percent) * len(places.at) < 2 * percent * width:
        return []
    n = len(places.hy)
    partner = places.partners(shift)
    good = partner >= 0
    sums = np.concatenate([[0], np.cumsum(good)])
    shared = sums[width:] - sums[:-width]
    # shared / (2 * width - shared) >= percent / 100
    ok = (100 + percent) * shared >= 2 * percent * width
    out = []
    starts = np.flatnonzero(ok)
    while len(starts):
        # The longest stretch from the first linked window that is linked as a whole and ends with a linked window.
        s = int(starts[0])
        ends = starts + width
        whole = np.flatnonzero((100 + percent) * (sums[ends] - sums[s]) >= 2 * percent * (ends - s))
        end = int(ends[whole[-1]]) - 1
        inside = np.flatnonzero(good[s : end + 1]) + s
        a, b = int(inside[0]), int(inside[-1])
        q = partner[inside]
        # Ends without a partner are left off, but not below a passage's width.
        right = min(max(b, a + width - 1), end)
        left = min(a, right - width + 1)
        out.append((left, right, max(0, int(q.min()) - (a - left)), min(n - 1, int(q.max()) + right - b)))
        starts = starts[starts > end - width + 1]
    return out


#: Text compared at once.
CHECK_BYTES = 1 << 20
#: Pairs of one cell, about.
CELL_PAIRS = 8192


def _checked(texts: list[bytes], pairs: list, width: int, percent: int) -> list[list[tuple]]:
    """(start, end, other start, other end, similarity; ends exclusive, in words) of the stretches in common, for each pair (place of x in texts, place of y, shifts)."""
    out: list[list[tuple]] = []
    sh = Shingled(texts)
    hashes = [sh.hash[a:b] for a, b in zip(sh.first, sh.stop, strict=True)]
    ordered: dict[int, tuple] = {}
    for i, j, shifts in pairs:
        if texts[i] == texts[j]:  # copies are one stretch
            m = len(texts[i].split())
            out.append([(0, m, 0, m, 1.0)])
            continue
        hx, hy = hashes[i], hashes[j]
        if j not in ordered:
            ordered[j] = Places.ordered(hy)
        found, places = {}, Places(hx, hy, ordered[j])
        for s in shifts:
            for a, b, c, d in matched_runs(places, int(s), width, percent):
                c, d, similarity = _widened(hx[a : b + 1], hy, c, d, width)
                if (a, b, c, d) in found:
                    continue
                if 100 * similarity >= percent:  # less only where a text repeats itself, as the sets then hold less than the places
                    found[a, b, c, d] = similarity
        # Stretches inside another one found with the same text say nothing more.
        reach, kept = -1, []
        for (a, b, c, d), similarity in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1], x[0])):
            if b > reach:
                reach = b
                kept.append((a, b + WORDS, c, d + WORDS, round(similarity, 6)))
        out.append(kept)
    return out


def _widened(x: np.ndarray, hy: np.ndarray, c: int, d: int, width: int) -> tuple[int, int, float]:
    """The stretch of y that holds c..d, is a passage wide at least and most similar to x, and its similarity; 0 if y is shorter.

    Where x repeats itself, all its places may have partners in a few places of y.
    """
    spare = width - (d - c + 1)
    if spare <= 0:
        return c, d, _similarity(x, hy[c : d + 1])
    wide = [(_similarity(x, hy[i : i + width]), -i) for i in range(max(0, c - spare), min(c, len(hy) - width) + 1)]
    similarity, i = max(wide, default=(0.0, -c))
    return -i, -i + width - 1, similarity


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = np.sort(np.concatenate([a, b]))
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return inter / (len(both) - inter)


NEAR = "x long, y long, id_x long, a int, b int, id_y long, c int, d int, s double"


def _check(width: int, percent: int):
    """What the pairs of a cell have in common; each text of the cell is there once."""

    def check(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        rows = texts.column("row").to_pylist()
        place = {r: i for i, r in enumerate(rows)}
        ids, bodies = texts.column("id").to_pylist(), texts.column("body")
        names = [c.split()[0] for c in NEAR.split(", ")]
        out: list[list] = [[] for _ in names]
        held: dict[int, int] = {}
        here: list[bytes] = []
        some: list[tuple] = []

        def flush() -> None:
            for (i, j, _, x, y), stretches in zip(some, _checked(here, [p[:3] for p in some], width, percent), strict=True):
                for a, b, c, d, s in stretches:
                    for column, v in zip(out, (rows[x], rows[y], ids[x], a, b, ids[y], c, d, s), strict=True):
                        column.append(v)
            held.clear(), here.clear(), some.clear()

        size = 0
        # A group's pairs share texts.
        for root, x, y, shifts in sorted(zip(*[pairs.column(c).to_pylist() for c in ("root", "x", "y", "shifts")], strict=True)):
            at = []
            for r in (place[x], place[y]):
                if r not in held:
                    held[r] = len(here)
                    here.append(C.unsqueeze(bodies[r].as_py()))
                    size += len(here[-1])
                at.append(held[r])
            some.append((*at, shifts, place[x], place[y]))
            if size >= CHECK_BYTES:
                flush()
                size = 0
        flush()
        trim()
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        return pa.table([pa.array(v, kinds[c.split()[1]]) for v, c in zip(out, NEAR.split(", "), strict=True)], names=names)

    return check


def _places(shifts: list[int]) -> list[int]:
    """The median of each run of shifts that count as one diagonal."""
    out: list[int] = []
    shifts = sorted(set(shifts))
    i = 0
    while i < len(shifts):
        j = i
        while j < len(shifts) and shifts[j] - shifts[i] <= SLACK:
            j += 1
        out.append(int(np.median(shifts[i:j])))
        i = j
    return sorted(set(out))


def chosen(y: np.ndarray, low: np.ndarray, high: np.ndarray, firm: np.ndarray) -> set[int]:
    """Of one text's partners those that are compared with it.

    As many of those whose common stretches are firm as it takes to cover all these
    stretches, but for SLACK shingles; those that cover most first, then the earliest.
    Of the others, which may turn out not to be near, all that reach beyond what the
    firm ones cover.
    """
    out: set[int] = set()
    covered = np.zeros(int(high.max(initial=-1)) + 1, bool)
    names, own = np.unique(y, return_inverse=True)
    for sure in (True, False):
        some = np.flatnonzero(firm == sure)
        order = some[np.argsort(own[some], kind="stable")]
        edges = np.searchsorted(own[order], np.arange(len(names) + 1))
        sums = np.bincount(own[order], weights=high[order] - low[order] + 1, minlength=len(names))
        for i in np.lexsort((names, -sums)):
            spots = [(int(low[k]), int(high[k]) + 1) for k in order[edges[i] : edges[i + 1]]]
            if any(b - a - int(np.count_nonzero(covered[a:b])) > SLACK for a, b in spots):
                out.add(int(names[i]))
                if sure:
                    for a, b in spots:
                        covered[a:b] = True
    return out


def _partners(cover: bool):
    """Each partner of a text with its diagonals; with ``cover`` the chosen ones only."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("y", T.LongType()), T.StructField("shifts", T.ArrayType(T.IntegerType()))])))
    def partners(matches: pd.Series) -> pd.Series:
        out = []
        for m in matches:
            y, shift, low, high, firm = (np.fromiter((r[n] for r in m), np.int64, len(m)) for n in ("y", "shift", "low", "high", "firm"))
            stay = chosen(y, low, high, firm.astype(bool)) if cover else set(y.tolist())
            shifts: dict[int, list[int]] = {}
            for a, b in zip(y.tolist(), shift.tolist(), strict=True):
                if a in stay:
                    shifts.setdefault(a, []).append(b)
            out.append([{"y": a, "shifts": _places(b)} for a, b in sorted(shifts.items())])
        return pd.Series(out, dtype=object)

    return partners


def dealt(pairs: DataFrame) -> DataFrame:
    """The written pairs (root, x, y, ...) with the cell in which they are compared.

    A root with many pairs has several cells, its x and y dealt to parts of them; roots with
    few share cells. So a text goes to few cells, and not once for each of its pairs.
    """
    counted = pairs.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_PAIRS)
    large = F.broadcast(counted.select("root", F.ceil(F.sqrt(F.col("n") / CELL_PAIRS)).alias("parts")))
    few = max(shuffles(pairs.sparkSession), -(-pairs.count() // CELL_PAIRS))
    part = lambda c: F.pmod(F.xxhash64(c), "parts")
    # Two cells of one name are only compared together.
    cell = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("root"), F.lit(few))).otherwise(F.xxhash64("root", part("x"), part("y")))
    return pairs.join(large, "root", "left").withColumn("cell", cell).drop("parts")


def _replies(rows: DataFrame, value: str) -> DataFrame:
    """The values (row, value) for each chunk, as its replies."""
    place = F.concat_ws(":", F.col("row").bitwiseAND((1 << C.DOC_BITS) - 1), value)
    wanted = rows.groupBy(F.shiftright("row", C.DOC_BITS).alias("chunk")).agg(F.array_join(F.collect_list(place), ",").cast("binary").alias("reply"))
    return cut(wanted.withColumn("bucket", F.lit(0)))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int = PASSAGE, percent: int = PERCENT, chunk_bytes: int = C.CHUNK_BYTES, cover: bool = False) -> DataFrame:
    """(key, start_word, end_word, other_<key>, other_start, other_end, similarity): each passage of a document with one of an earlier document that is near it.

    Passages have ``passage`` words or more, ends are exclusive, similarity is the
    Jaccard index of the two stretches' shingles. A document is earlier by key, then
    by place in the input; null keys come last. A group of copies gives each member
    a few earlier ones (the group's representatives), never all pairs; classes that differ
    meet in all pairs, but with ``cover`` only until each stretch has a partner. Passages that
    repeat within one document only are not looked for. Repeated rows are documents of
    their own. Texts of fewer words, null and empty texts have no passages; an empty
    table gives none. Keys are integers; columns other than key and text are ignored.
    """
    _, links, verified, _ = _finder(docs, key, text, passage, percent, chunk_bytes)
    both = verified(links(cover), cover)
    known = lambda c: F.when(F.col(c) != C.NO_ID, F.col(c))
    return both.select(known("id_x").alias(key), F.col("a").alias("start_word"), F.col("b").alias("end_word"), known("id_y").alias(f"other_{key}"), F.col("c").alias("other_start"), F.col("d").alias("other_end"), F.col("s").alias("similarity"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int = PASSAGE, percent: int = PERCENT, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """(key, component_id, n_passages): for each document the least key reachable by the links of ``find``, itself included, and how many of its stretches were found in the links that were verified.

    The components are those of all pairs of ``find``. First pairs are verified until each
    stretch has a partner; then, of all pairs of classes, those of different components.
    Pairs within a component would change nothing. A document without a partner, or without text, is
    its own component; null keys come last, as in ``find``.
    """
    packed, links, verified, again = _finder(docs, key, text, passage, percent, chunk_bytes)
    held = links(True, kept=True)
    matches = held.filter("x <> y").select(*[c.split()[0] for c in MATCH.split(", ")])
    near = cut(verified(matches, True).select("x", "y", "a", "b"))
    ends = lambda df: df.select(F.col("x").alias("a"), F.col("y").alias("b"))
    # The broadcast replies and shuffles of the first pass go only when the JVM collects what refers to them.
    collect_garbage(docs.sparkSession)
    comp = cut(graph.components(ends(near)).withColumnRenamed("node", "row"))
    collect_garbage(docs.sparkSession)
    labels = held.filter("x = y").select("bucket", F.col("x").alias("row")).join(comp, "row", "left").select("bucket", "row", F.coalesce("comp", "row").alias("label"))
    groups = held.filter("body is not null").select(F.col("bucket").alias("own"), "body", "marks")
    rest = groups.groupBy("own").cogroup(labels.groupBy("bucket")).applyInArrow(again, MATCH)
    label = lambda c: comp.select(F.col("row").alias(c), F.col("comp").alias(f"_{c}"))
    apart = matches.join(label("x"), "x", "left").join(label("y"), "y", "left").filter(F.coalesce("_x", "x") != F.coalesce("_y", "y"))
    more = verified(cut(apart.select(*matches.columns).unionByName(rest).distinct()), False)
    more = cut(more.select("x", "y", "a", "b"))
    every = near.unionByName(more)
    # The links of components; the rows of one go where it goes.
    between = more.join(label("x"), "x", "left").join(label("y"), "y", "left").select(F.coalesce("_x", "x").alias("a"), F.coalesce("_y", "y").alias("b"))
    further = graph.components(between.distinct())
    alone = further.join(comp, further["node"] == comp["row"], "left_anti").select(F.col("node").alias("row"), "comp")
    reached = comp.withColumnRenamed("comp", "node").join(further, "node", "left").select("row", F.coalesce("comp", "node").alias("comp")).unionByName(alone)

    def named(chunk, at, _):
        row = (at << C.DOC_BITS) | np.arange(len(chunk.ids))
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(chunk.ids, pa.int64())], ["row", "id"])

    docs = C.per_chunk(packed, [], named, "row long, id long").join(reached, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    known = F.when(F.col("id") != C.NO_ID, F.col("id"))
    least = docs.groupBy("comp").agg(F.min(known).alias("component_id"))
    counted = every.select("x", "a", "b").distinct().groupBy(F.col("x").alias("row")).agg(F.count("*").alias("n_passages"))
    out = docs.join(least, "comp").join(counted, "row", "left")
    return out.select(known.alias(key), "component_id", F.coalesce("n_passages", F.lit(0)).alias("n_passages"))


def _finder(docs: DataFrame, key: str, text: str, passage: int, percent: int, chunk_bytes: int):
    """The packed texts, and what gives their verified links."""
    width = passage - WORDS + 1
    # So many shingles of a passage's width must be in both passages, and may be without a partner.
    common = -(-2 * percent * width // (100 + percent))
    missing = width - common
    packed = C.pack(docs, key, text, chunk_bytes)
    buckets = C.buckets(packed)

    def ask(chunk, at, _):
        sh = Shingled(chunk.texts())
        if len(sh.hash):
            yield C.ask(at, *C.distinct(sh.hash, sh.doc), buckets)

    shares = C.answer(C.per_chunk(packed, [], ask, C.ASK), bits=True)

    names = [c.split()[0] for c in MATCH.split(", ")]

    def met(a: np.ndarray, marks: np.ndarray, label: np.ndarray, cover: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(x, y, low, high, firm) of windows in order whose classes are linked by marks, their labels being different; and which classes are of a group of three or more that has such a pair."""
        k, ids, row, c, around = a
        begin = np.flatnonzero(_changes(k, around))
        member = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(k))))
        first = begin[member]
        # Classes of a group in the order of their first members.
        rank = np.lexsort((c[begin], row[begin], ids[begin], k[begin]))
        head = begin[rank]
        start = np.maximum.accumulate(np.where(_changes(k[head], k[head]), np.arange(len(head)), 0))
        cx, cy, clow, chigh, cfirm = class_pairs(start, label[head], marks[rank], width, common, cover, percent)
        # What the first member of a class meets, its own text's other members meet too.
        mates = np.flatnonzero(row == row[first])
        mates = mates[np.argsort(member[mates], kind="stable")]
        lo, hi = np.searchsorted(member[mates], rank[cx]), np.searchsorted(member[mates], rank[cx], side="right")
        n = hi - lo
        mine = mates[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        hit = np.zeros(len(start), bool)
        hit[start[cx]] = True
        some_groups = np.zeros(len(begin), bool)
        some_groups[rank] = hit[start] & (np.bincount(start, minlength=len(start))[start] > 2)
        return (mine, np.repeat(head[cy], n), *[np.repeat(v, n) for v in (clow, chigh, cfirm)]), some_groups

    def answered(row, c, x, y, low, high, firm) -> list[pa.Array]:
        found = np.unique(np.stack([row[x], row[y], c[x] - c[y], c[x] + low, c[x] + high, firm]), axis=1)
        return [pa.array(v, pa.int64() if i < 2 else pa.int32()) for i, v in enumerate(found)]

    def again(groups: pa.Table, labels: pa.Table) -> pa.Table:
        """All linked pairs of different labels of a bucket's kept groups."""
        of = dict(zip(labels.column("row").to_pylist(), labels.column("label").to_pylist(), strict=True))
        out = []
        for body, marks in zip(groups.column("body"), groups.column("marks"), strict=True):
            a = np.frombuffer(C.unsqueeze(body.as_py()), np.int64).reshape(5, -1)
            marks = np.frombuffer(C.unsqueeze(marks.as_py()), np.uint16).reshape(-1, 2 * width + 1)
            if a.shape[1]:
                pairs, _ = met(a, marks, np.array([of[r] for r in a[2].tolist()]), False)
                out.append(pa.table(answered(a[2], a[3], *pairs), names=names))
        trim()
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64() if i < 2 else pa.int32()) for i in range(6)], names=names)

    def links(cover: bool, kept: bool = False) -> DataFrame:
        """Matched pairs (MATCH). With ``kept`` they are written, and for each bucket the groups in which cover left out pairs and their texts (x = y)."""

        def send(chunk, at, got):
            sh = Shingled(chunk.texts())
            if not len(sh.hash):
                return
            shared = C.several(sh.hash, got[0], buckets)
            # The longer of two passages may have twice as many shingles of its own in a stretch of this width.
            found = list(sh.shared_windows(width, shared, width - 2 * missing))
            if not found:
                return
            left, c, right, k = (np.concatenate([x[i] for x in found]) for i in range(4))
            low, high = np.maximum(left, c - width), np.minimum(right, c + width)
            sums = np.concatenate([[0], np.cumsum(shared)])
            keep = shared[c] & (sums[high + 1] - sums[low] >= common)
            if not keep.any():
                return
            k, c, low, high = k[keep], c[keep], low[keep], high[keep]
            d = sh.doc[c]
            marks = _marks(sh.hash, shared, c, low, high, width)
            around = _surroundings(marks, width, common).view(np.int64)
            order = np.lexsort((c, around, k))
            # Of a text that repeats itself, windows that differ by less than half a passage only are one.
            near = c[order] // (width // 2)
            order = order[_changes(k[order], around[order]) | _changes(d[order], near)]
            k, around, c, d = k[order], around[order], c[order], d[order]
            new = _changes(k, around)
            all_ = np.stack([k.view(np.int64), chunk.ids[d], (at << C.DOC_BITS) | d, c - sh.first[d], around])
            marks = marks[order][new]
            where = C.bucket_of(k, buckets)
            own = np.unique(where)
            bodies = [np.ascontiguousarray(all_[:, where == b]) for b in own]
            marked = [marks[where[new] == b] for b in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[pa.array([C.squeeze(x.tobytes()) for x in xs], pa.binary()) for xs in (bodies, marked)]], ["bucket", "body", "marks"])

        def meet(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(C.unsqueeze(x.as_py()), np.int64).reshape(5, -1) for x in table.column("body")]
            # In the order of their chunks, so that a class has the same marks in every run.
            turn = sorted(range(len(parts)), key=lambda i: int(parts[i][2, 0]))
            parts = [parts[i] for i in turn]
            held = np.concatenate([_changes(p[0], p[4]) for p in parts])
            bodies = table.column("marks")
            marks = np.concatenate([np.frombuffer(C.unsqueeze(bodies[i].as_py()), np.uint16).reshape(-1, 2 * width + 1) for i in turn])
            a = np.concatenate(parts, axis=1)
            # The marks of each window that has its own; others have those of their class.
            own = np.where(held, np.cumsum(held) - 1, -1)
            order = np.lexsort((a[3], a[2], a[1], a[4], a[0]))
            k, ids, row, c, around = a = a[:, order]
            begin = np.flatnonzero(_changes(k, around))
            marks = marks[np.maximum.reduceat(own[order], begin)]
            member = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(k))))
            first = begin[member]
            x = np.flatnonzero(row != row[first])
            y = first[x]
            (cx, cy, clow, chigh, cfirm), some_groups = met(a, marks, row, cover)
            # Members of a class have the class's shared stretches in common.
            linked = _stretches(marks < _NONE, width) >= common
            low, high, one = (v[member[x]] for v in _reach(linked, width))
            some = linked.any(axis=1)[member[x]]
            x, y = np.concatenate([x[some], cx]), np.concatenate([y[some], cy])
            low, high, firm = (np.concatenate([p[some], q]) for p, q in ((low, clow), (high, chigh), (one, cfirm)))
            found = answered(row, c, x, y, low, high, firm)
            if not kept:
                trim()
                return pa.table(found, names=names)
            # Of groups of three classes or more cover may leave out pairs where it found others: their first members are kept.
            stay = some_groups[member] & (row == row[first])
            bodies = [C.squeeze(np.ascontiguousarray(v).tobytes()) for v in (a[:, stay], marks[some_groups])]
            texts = np.unique(row[stay])
            trim()
            none = [pa.nulls(len(found[0]) + len(texts), pa.binary())] * 2
            own_bucket = pa.array(np.full(len(found[0]) + len(texts) + 1, table.column("bucket")[0].as_py()), pa.int32())
            zero = np.zeros(len(texts), np.int64)
            columns = [pa.concat_arrays([f, pa.array(t, f.type), pa.nulls(1, f.type)]) for f, t in zip(found, (texts, texts, zero, zero, zero, zero), strict=True)]
            return pa.table([*columns, own_bucket, *[pa.concat_arrays([n, pa.array([b], pa.binary())]) for n, b in zip(none, bodies, strict=True)]], names=[*names, "bucket", "body", "marks"])

        matches = C.per_chunk(packed, [shares], send, SENT, most=BROADCAST_BYTES).groupBy("bucket").applyInArrow(meet, KEPT if kept else MATCH)
        if kept:
            matches = cut(matches)
        return matches

    def verified(matches: DataFrame, cover: bool) -> DataFrame:
        """The links (NEAR) of matched pairs."""
        partners = matches.groupBy("x").agg(F.collect_list(F.struct("y", "shift", "low", "high", "firm")).alias("m"))
        listed = partners.select("x", _partners(cover)("m").alias("p"))
        # A text's pairs meet at its least partner, so texts that are near each other meet in one place.
        root = F.least("x", F.array_min(F.transform("p", lambda r: r["y"])))
        pairs = dealt(cut(listed.select("x", root.alias("root"), F.explode("p").alias("p")).select("root", "x", "p.y", "p.shifts")))

        def fetch(chunk, at, got):
            own = [[int(v) for v in d.split(b":")] for d in got[0].get(0, b"").split(b",") if d]
            if own:
                texts = chunk.texts()
                squeezed = {d: C.squeeze(texts[d]) for d in sorted({d for d, _ in own})}
                yield pa.RecordBatch.from_arrays([pa.array([g for _, g in own], pa.int64()), pa.array([(at << C.DOC_BITS) | d for d, _ in own], pa.int64()), pa.array([int(chunk.ids[d]) for d, _ in own], pa.int64()), pa.array([squeezed[d] for d, _ in own], pa.binary())], ["cell", "row", "id", "body"])

        # Only texts that are in a pair are taken out of their chunks, once for each cell they are in.
        needed = pairs.select("cell", F.col("x").alias("row")).union(pairs.select("cell", "y")).distinct()
        texts = C.per_chunk(packed, [_replies(needed, "cell")], fetch, "cell long, row long, id long, body binary", most=BROADCAST_BYTES)
        both = pairs.groupBy("cell").cogroup(texts.groupBy("cell")).applyInArrow(_check(width, percent), NEAR)
        return both

    return packed, links, verified, again
