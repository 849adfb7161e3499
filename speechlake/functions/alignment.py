"""Word alignment by edit distance over the rows of an Arrow batch.

Ties prefer a substitution or match, then a deletion, then an insertion. A column of the table is two bit vectors, a bit for
each word of the reference, so a step takes a few operations on whole columns. Only cells near the straight line are looked
at, so many that no cheaper way leaves them. Rows of about one length take each step together, as NumPy arrays of 64-bit
words; where too few are alike they are Python integers, row by row, so texts may have any length. The way back reads the
columns; of long rows only some are kept and the ones between are computed again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the columns of one row that are held for its way back.
_BITS = 1 << 28
#: Items of a reference from which a row alone is aligned near the straight line, 64-bit words that a table's columns or places may take, and rows of a table.
WIDE, _CELLS, _ROWS = 1024, 1 << 22, 4096
#: Words that a step works on, about; rows that make a table, at least, and items of a hypothesis up to which fewer do.
_STEP, _FEW, _SHORT = 3072, 8, 64
#: Width of a first way's band on either side, edits from which it is sought, and steps between two looks at which words are left.
_ASIDE, _NEAR, _LATER = 64, 256, 32
#: Items of both sides that are worked on at a time, about.
_ITEMS = 1 << 22
#: Classes of items, and columns at a time, in which is counted what is left.
_CLASSES, _GRAIN = 32, 16
#: Most distinct words of a row whose distance is found inside the JVM.
_LETTERS = 20_000
_U, _ONE = np.uint64, np.uint64(1)
COUNTS = "struct<sub:bigint,ins:bigint,del:bigint,correct:bigint,n_ref:bigint,n_hyp:bigint>"
OPS = "array<struct<op:string,ref:string,hyp:string>>"


def _encode(ref: pa.Array, hyp: pa.Array):
    """(codes, offsets) of both sides under one numbering of words, and the words."""
    flat = [x.flatten() for x in (ref, hyp)]
    both = pa.concat_arrays([f.cast(pa.large_string()) for f in flat]).dictionary_encode()
    index, n = both.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(flat[0])
    sides = []
    for column, part in ((ref, index[:n]), (hyp, index[n:])):
        lens = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        sides.append((part, np.concatenate([[0], np.cumsum(lens)])))
    return sides[0], sides[1], both.dictionary


def _places(ref) -> dict:
    """Of each item of the reference the bits where it stands."""
    found: dict = {}
    for i, w in enumerate(ref):
        found.setdefault(w, []).append(i)
    size, out = len(ref) // 8 + 1, {}
    for w, at in found.items():
        if len(at) < 16:
            out[w] = sum(1 << i for i in at)
        else:
            bits = np.zeros(size * 8, np.uint8)
            bits[at] = 1
            out[w] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _columns(bits: dict, n: int, hyp, up: int, down: int, keep: list | None = None) -> tuple[int, int]:
    """The last column's (up, down): where a cell is one more or one less than the cell above; keep gets each column's (diagonal, up), diagonal: where a cell is as the one diagonally above."""
    mask = (1 << n) - 1
    for w in hyp:
        here = bits.get(w, 0)
        diagonal = ((((here & up) + up) ^ up) | here | down) & mask
        more, less = ((down | (mask & ~(diagonal | up))) << 1) | 1, (diagonal & up) << 1
        up, down = (less | ~(diagonal | more)) & mask, more & diagonal
        if keep is not None:
            keep.append((diagonal, up))
    return up, down


def _band(bits: dict, n: int, hyp, most: int, keep: bool = False):
    """(cost of a way through the cells near the straight line, the windows): the edit distance if that is no more than ``most``, as no cheaper way leaves those cells, else a bound of it.

    Cells go by blocks of columns with one range of rows each; a row above the range and one that the range gains are
    reached by insertions and deletions alone, which are ways too. windows: (columns of one, [(first row, kept columns)]).
    """
    m = len(hyp)
    aside = max(0, most - abs(n - m)) // 2 + 1
    low_side, high_side = aside + max(0, n - m), aside + max(0, m - n)  # how far a row may lie below its column's and above
    step = max(64, (low_side + high_side) // 8)
    first, height, up, down, base, windows = 0, 0, 0, 0, 0, []
    for at in range(0, m, step):
        to = min(m, at + step)
        low, high = max(first, min(n, at - high_side)), min(n, to + low_side)
        gone = (1 << (low - first)) - 1
        base += (up & gone).bit_count() - (down & gone).bit_count()
        up, down = up >> (low - first), down >> (low - first)
        up |= ((1 << (high - low)) - 1) ^ ((1 << max(0, first + height - low)) - 1)
        first, height = low, high - low
        mask, part = (1 << height) - 1, hyp[at:to]
        here = {w: bits[w] >> first & mask for w in set(part) if w in bits}
        kept: list | None = [] if keep else None
        up, down = _columns(here, height, part, up, down, kept)
        base += to - at
        windows.append((first, kept))
    return base + up.bit_count() - down.bit_count() + n - first - height, (step, windows)


def _bound(bits: dict, n: int, hyp) -> int:
    """The edit distance: bands are widened until one is as wide as the cost found in it."""
    m = len(hyp)
    most = abs(n - m) + max(64, max(n, m) // 8)
    while True:
        found = _band(bits, n, hyp, most)[0]
        if found <= most:
            return found
        most = min(found, 4 * most)


def distance(ref, hyp) -> int:
    if ref == hyp:
        return 0
    return _bound(_places(ref), len(ref), hyp) if ref and hyp else len(ref) + len(hyp)


def _edits(ref: list, hyp: list) -> list[tuple[int, int, int]]:
    """(0 substitution 1 deletion 2 insertion, ref place, hyp place) from the last to the first."""
    if ref == hyp:
        return []
    n, m, bits, out = len(ref), len(hyp), _places(ref), []
    if n > WIDE and m:
        most = _bound(bits, n, hyp)
        if 3 * most * m <= _BITS:  # no cell of a cheapest way lies outside the band
            step, windows = _band(bits, n, hyp, most, True)[1]
            i, j = n, m
            while i and j:
                if ref[i - 1] == hyp[j - 1]:
                    i, j = i - 1, j - 1
                    continue
                first, kept = windows[(j - 1) // step]
                diagonal, up = kept[(j - 1) % step]
                if not diagonal >> (i - 1 - first) & 1:
                    i, j = i - 1, j - 1
                    out.append((0, i, j))
                elif up >> (i - 1 - first) & 1:
                    i -= 1
                    out.append((1, i, j))
                else:
                    j -= 1
                    out.append((2, i, j))
            return out + [(1, k, 0) for k in range(i - 1, -1, -1)] + [(2, 0, k) for k in range(j - 1, -1, -1)]
    span = m if 2 * n * m <= _BITS else max(1, min(int(m**0.5) + 1, _BITS // (2 * n)))
    starts, state = [], ((1 << n) - 1, 0)
    for at in range(0, m, max(1, span)):
        starts.append(state)
        if at + span < m:
            state = _columns(bits, n, hyp[at : at + span], *state)
    i, j, low, kept = n, m, m, []
    while i and j:
        if j - 1 < low:
            low, kept = (j - 1) // span * span, []
            _columns(bits, n, hyp[low:j], *starts[low // span], kept)
        if ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            continue
        diagonal, up = kept[j - 1 - low]
        if not diagonal >> (i - 1) & 1:
            i, j = i - 1, j - 1
            out.append((0, i, j))
        elif up >> (i - 1) & 1:
            i -= 1
            out.append((1, i, j))
        else:
            j -= 1
            out.append((2, i, j))
    return out + [(1, k, 0) for k in range(i - 1, -1, -1)] + [(2, 0, k) for k in range(j - 1, -1, -1)]


class _Slots:
    """The items of a batch numbered row by row: ref and hyp hold a number for each item, -1 where the row's reference lacks it; a row's numbers are border[row] to border[row + 1]."""

    def __init__(self, a, b, kinds: int):
        self.at, rows = (a[1], b[1]), len(a[1]) - 1
        self.n, self.m = np.diff(a[1]), np.diff(b[1])
        ref, hyp = (np.repeat(np.arange(rows), lens) * kinds + side[0] for side, lens in ((a, self.n), (b, self.m)))
        if rows * kinds <= len(ref):
            self.ref, self.hyp, self.border = ref, hyp, np.arange(rows + 1) * kinds
        else:
            keys, self.ref = np.unique(ref, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, hyp), max(0, len(keys) - 1))
            self.hyp = np.where(keys[at] == hyp, at, -1) if len(keys) else np.full(len(hyp), -1)
            self.border = np.searchsorted(keys, np.arange(rows + 1) * kinds)

    def guess(self) -> np.ndarray:
        """About the edit distance of each row, by how often its texts have each item; no bound."""
        size, rows = int(self.border[-1]), np.arange(len(self.n))
        more = np.bincount(self.ref, minlength=size) - np.bincount(self.hyp[self.hyp >= 0], minlength=size)
        lacks = np.bincount(np.repeat(rows, self.m)[self.hyp < 0], minlength=len(rows))
        sums = np.concatenate([[0], np.cumsum(np.abs(more))])
        apart = sums[self.border[1:]] - sums[self.border[:-1]] + lacks
        return np.minimum(apart * 5 // 4 + 16, np.maximum(self.n, self.m))

    def tables(self, rows: np.ndarray, most: np.ndarray, keep: bool):
        """(rows that make a table together, alike in length and in the width of their bands; the rows that are too few or too long for one)."""
        most, n, m = most[rows], self.n[rows], self.m[rows]
        width = (np.maximum(most, np.abs(n - m)) + 2) // 64 + 2
        cells = np.maximum((-(-(n + 64) // 64) + 1) * (np.diff(self.border)[rows] + 2), np.maximum(n, m) * 2 + 64)
        cells = np.maximum(cells, 2 * (m + n // 64 + 2) * width) if keep else cells
        order = np.argsort(-m, kind="stable")
        groups, few, at = [], [], 0
        while at < len(order):
            to = int(np.searchsorted(-m[order], -(m[order[at]] * 0.8 - 16), side="right"))
            near = order[at:to]
            near = near[np.argsort((n - m)[near], kind="stable")]
            for like in _alike((n - m)[near]):
                some = near[like]
                parts = max(1, round(int(width[some].sum()) / _STEP), -(-int(cells[some].max()) * len(some) // _CELLS), -(-len(some) // _ROWS))
                for part in np.array_split(some, min(parts, len(some))):
                    (groups if len(part) >= _FEW or int(m[part].max()) <= _SHORT and _FEW * int(cells[part].max()) <= _CELLS else few).append(rows[part])
            at = to
        return groups, np.concatenate(few) if few else np.zeros(0, np.int64)


def _alike(longer: np.ndarray) -> list[slice]:
    """Parts of rows, in the order of how much longer one side is, such that splitting one more would cost more than the narrower bands save."""
    done, open_ = [], [(0, len(longer))]
    while open_:
        low, high = open_.pop()
        x = longer[low:high]
        k = np.arange(_FEW, len(x) - _FEW + 1)
        if len(k):
            both = k * (x[k - 1] - x[0]) + (len(x) - k) * (x[-1] - x[np.minimum(k, len(x) - 1)])
            at = int(both.argmin())
            if len(x) * int(x[-1] - x[0]) - int(both[at]) > 64 * _STEP // 6:
                open_ += [(low, low + int(k[at])), (low + int(k[at]), high)]
                continue
        done.append(slice(low, high))
    return done


class _Table:
    """The tables of rows that take each step together.

    Both sides of each row end in as many items of a kind of their own as bring all hypotheses to one length, which changes no
    distance. Word w of a column is worked on one step after word w - 1, from which it takes whether the cell above is one
    more or less than the one left of it; so a step takes the same operations on all words of all rows' bands.
    """

    def __init__(self, s: _Slots, rows: np.ndarray):
        self.rows, self.n, self.m = rows, s.n[rows], s.m[rows]
        k, self.wide = len(rows), int(self.m.max())
        self.end = self.n + self.wide - self.m
        self.words = -(-int(self.end.max()) // 64)
        sizes = np.diff(s.border)[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        none, size = int(first[-1]), int(first[-1]) + 1 + k
        (left, ref_row, ref_at), (right, hyp_row, hyp_at) = (_flat((items, at), rows, lens) for items, at, lens in ((s.ref, s.at[0], self.n), (s.hyp, s.at[1], self.m)))
        moved, own = first[:-1] - s.border[rows], none + 1 + np.arange(k)
        self.items, self.begin = left + moved[ref_row], np.cumsum(self.n) - self.n
        self.held = (left - s.border[rows][ref_row], ref_row, ref_at), (np.where(right < 0, -1, right - s.border[rows][hyp_row]), hyp_row, hyp_at)
        self.turned = np.repeat(own[None, :], self.wide, 0)  # the last column first
        self.turned[self.wide - 1 - hyp_at, hyp_row] = np.where(right < 0, none, right + moved[hyp_row])
        self.base = np.arange(self.words)[:, None] * size
        self.places = np.zeros(self.words * size, _U)
        more = self.wide - self.m
        row = np.repeat(np.arange(k), more)
        at = np.arange(len(row)) - np.repeat(np.cumsum(more) - more - self.n, more)
        for item, place in ((self.items, ref_at), (own[row], at)):
            np.add.at(self.places, (place >> 6) * size + item, _ONE << (place & 63).astype(_U))

    def straight(self) -> np.ndarray:
        """A bound of each row's edit distance: the cheapest way close to the straight line."""
        tall, low = int(self.end.max()), int(self.end.min())
        aside = _ASIDE + tall - low
        line = lambda i: i * self.wide // max(1, (tall + low) // 2)
        return self._fill([max(0, line(64 * w - aside)) for w in range(self.words)], [min(self.wide, line(64 * (w + 1) + aside) + 1) for w in range(self.words)])

    def fill(self, most: np.ndarray, keep: bool = False) -> np.ndarray:
        """What the cheapest way through the cells costs that ways of up to ``most`` edits reach, for each row: the edit distance if that is no more than ``most``. keep: ``diagonal`` and ``up`` of every step stay in self.kept, of words from self.first on."""
        aside = np.maximum(0, most - np.abs(self.n - self.m)) // 2 + 1
        above, below = int((aside + np.maximum(0, self.m - self.n)).max()), int((aside + np.maximum(0, self.n - self.m)).max())
        wide = above + below > _NEAR
        if wide:
            self._count_left()
        return self._fill([max(0, 64 * w - below - 1) for w in range(self.words)], [min(self.wide, 64 * (w + 1) + above + 1) for w in range(self.words)], most if wide else None, keep)

    def _fill(self, start: list, stop: list, most: np.ndarray | None = None, keep: bool = False) -> np.ndarray:
        """start, stop: the columns between which a word is looked at, at most; with most, words are left earlier and begun later where no way of so many edits goes there."""
        k, wide, words, turned, top = len(self.rows), self.wide, self.words, self.turned, _U(63)
        up, down = np.full((words, k), ~_U(0)), np.zeros((words, k), _U)
        # whether the cell above a word is one more or less than the one left of it: what a step reads, and what it writes for the next
        more, less = np.ones((2, words + 1, k), _U), np.zeros((2, words + 1, k), _U)
        high, at = 1, 0  # most words at a time
        for w in range(words):
            while stop[at] + at <= start[w] + w:
                at += 1
            high = max(high, w - at + 1)
        x, y, z, here = (np.empty((high, k), _U) for _ in range(4))
        index = np.empty((high, k), np.int64)
        if keep:
            self.high, self.first, self.kept = high, np.zeros(wide + words, np.int64), np.empty((2, wide + words, high, k), _U)
        cost, first, last, t, due = np.full(k, wide, np.int64), 0, 0, 0, 0
        while True:
            if most is not None and last - first > 2 and t >= due:
                self._narrow(start, stop, most, t, first, last, up, down, more[t & 1], less[t & 1], cost - wide + t - first)
                due = t + _LATER
            if first < last and t - first == stop[first]:
                full = np.clip(self.end - 64 * first, 0, 64)
                mask = np.where(full == 64, ~_U(0), (_ONE << (full % 64).astype(_U)) - _ONE)
                cost += np.bitwise_count(up[first] & mask).astype(np.int64) - np.bitwise_count(down[first] & mask)
                first += 1
                if first == words:
                    return cost
            if last < words and t - last == start[last]:
                last += 1
                if last < words:
                    start[last] = max(start[last], start[last - 1])
            until = min(stop[first] + first, start[last] + last if last < words else wide + words)
            n, u, d, base = last - first, up[first:last], down[first:last], self.base[first:last]
            i, e, p, q, r = index[:n], here[:n], x[:n], y[:n], z[:n]
            sides = [(more[o, first:last], less[o, first:last], more[1 - o, first + 1 : last + 1], less[1 - o, first + 1 : last + 1]) for o in (0, 1)]
            for at in range(t, until):
                was_more, was_less, one_more, one_less = sides[at & 1]
                np.add(turned[wide - 1 - at + first : wide - 1 - at + last], base, i)
                self.places.take(i, None, e, "clip")
                np.bitwise_or(e, was_less, e)
                np.bitwise_and(e, u, q)
                np.add(q, u, q)
                np.bitwise_xor(q, u, q)
                np.bitwise_or(q, e, q)
                np.bitwise_or(q, d, p)  # diagonal
                np.bitwise_or(p, u, r)
                np.invert(r, r)
                np.bitwise_or(r, d, r)
                np.bitwise_and(q, u, q)
                np.right_shift(r, top, one_more)
                np.right_shift(q, top, one_less)
                np.left_shift(r, _ONE, r)
                np.bitwise_or(r, was_more, r)
                np.left_shift(q, _ONE, q)
                np.bitwise_or(q, was_less, q)
                np.bitwise_or(p, r, u)
                np.invert(u, u)
                np.bitwise_or(u, q, u)
                np.bitwise_and(r, p, d)
                if keep:
                    self.first[at], self.kept[0, at, :n], self.kept[1, at, :n] = first, p, u
                if at == t:
                    more[:, first], less[:, first] = 1, 0  # above what is looked at each cell is one more than the one left of it
            t = until

    def _narrow(self, start, stop, most, t, first, last, up, down, more, less, above) -> None:
        """Bring stop forward for the highest words and put start off for the next one, where all rows' ways would cost over ``most``. above: the cost over the first word in its last column.

        A way through a cell costs at least what the cell holds and what is left to go; from a cell to the one below or beside
        it this sum changes by two at most.
        """
        grown = np.bitwise_count(up[first:last]).astype(np.int64) - np.bitwise_count(down[first:last])
        grown[1:] -= more[first + 1 : last].astype(np.int64) - less[first + 1 : last].astype(np.int64)
        held = np.concatenate([above[None, :], above + np.cumsum(grown, 0)])
        w = np.arange(first, last)
        whole = held + self._left(np.arange(first, last + 1), np.concatenate([[t - first], t - w]))
        dead = ((whole[:-1] + whole[1:]) // 2 - 67 > most).all(1)
        for w in range(first, last - 2):
            if not dead[w - first]:
                break
            stop[w] = min(stop[w], t - first)
        if last < len(stop) and (whole[-1] - 2 * _LATER - 4 > most).all():
            start[last] = max(start[last], min(t + _LATER - last, stop[last - 1] - 1))

    def _left(self, words: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """What a way from the upper end of each word, in a column of its own, costs at least: the items that one side has left and the other hasn't."""
        apart = np.abs(np.take(self.ref_left, words, 1) - np.take(self.hyp_left, columns // _GRAIN, 1)).sum(0)
        longer = np.abs(self.end - self.wide - (64 * words - columns // _GRAIN * _GRAIN)[:, None])
        return (apart + longer) // 2 - (columns % _GRAIN)[:, None]

    def _count_left(self) -> None:
        """How many items of each class are left from each word of the reference on, and from every so many columns of the hypothesis."""
        k, left = len(self.rows), []
        # an item's number in its row tells its class; one class each for what the reference lacks and for what ends both sides
        for item, row, at, grain, total in ((*self.held[0], 64, self.words), (*self.held[1], _GRAIN, self.wide // _GRAIN + 1)):
            kind = np.where(item < 0, _CLASSES, item % _CLASSES)
            counts = np.zeros((_CLASSES + 2, total + 1, k), np.int32)
            counts[:-1, :-1] = np.bincount((kind * total + at // grain) * k + row, minlength=(_CLASSES + 1) * total * k).reshape(-1, total, k)
            filled = np.clip(np.minimum(self.end if grain == 64 else self.wide, (np.arange(total + 1) * grain)[:, None]) - (self.n if grain == 64 else self.m), 0, None)
            counts[:-1] = counts[:-1, ::-1].cumsum(1)[:, ::-1]
            counts[-1] = self.wide - self.m - filled
            left.append(counts)
        self.ref_left, self.hyp_left = left

    def steps(self, rows: np.ndarray):
        """The way back of some rows at once: for each step (rows' places, op, ref place, hyp place); ops as in _edits, 3 for a match."""
        k, wide = len(self.rows), self.wide
        diagonals, ups = self.kept.reshape(2, -1)
        ref, hyp = self.items, self.turned.ravel()
        who, i, j = rows, self.n[rows], self.m[rows]
        while True:
            on = i + j > 0
            if not on.all():
                who, i, j = who[on], i[on], j[on]
            if not len(who):
                return
            p, q = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            same = ref[self.begin[who] + p] == hyp[(wide - 1 - q) * k + who]
            same &= (i > 0) & (j > 0)
            op = np.full(len(who), 3)
            apart = np.flatnonzero(~same)
            if len(apart):
                x, y = p[apart], q[apart]
                w = x >> 6
                t = y + w
                cell = (t * self.high + np.clip(w - self.first[t], 0, self.high - 1)) * k + who[apart]
                bit = (x & 63).astype(_U)
                found = np.where(diagonals[cell] >> bit & _ONE == 0, 0, np.where(ups[cell] >> bit & _ONE == 1, 1, 2))
                op[apart] = np.where(i[apart] == 0, 2, np.where(j[apart] == 0, 1, found))
            i, j = i - (op != 2), j - (op != 1)
            yield who, op, i, j


def _flat(side, rows: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, row's place, place in the row) of all items of some rows."""
    row = np.repeat(np.arange(len(rows)), lens)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    return side[0][side[1][rows][row] + at], row, at


def _filled(a, b, kinds: int, keep: bool):
    """(table, its rows' places, their edit distances) of rows that go together, all rows but the second result's; bands that are too narrow for some rows are widened for these."""
    s = _Slots(a, b, kinds)
    most, todo = s.guess(), np.flatnonzero((s.n > 0) & (s.m > 0))
    alone = []

    def run(todo):
        while len(todo):
            groups, few = s.tables(todo, most, keep)
            alone.extend(few.tolist())
            again = []
            for rows in groups:
                table = _Table(s, rows)
                if int(most[rows].max()) > _NEAR:
                    most[rows] = np.minimum(table.straight(), 2 * most[rows])
                cost = table.fill(most[rows], keep)
                right = cost <= most[rows]
                yield table, np.flatnonzero(right), cost[right]
                most[rows[~right]] = np.minimum(cost[~right], 4 * most[rows[~right]])
                again.append(rows[~right])
            todo = np.concatenate(again) if again else np.zeros(0, np.int64)

    return run(todo), alone


def _row(side, k: int) -> list:
    return side[0][side[1][k] : side[1][k + 1]].tolist()


def _slices(lens: np.ndarray):
    """Rows by length, the longest first, in parts of up to _ITEMS items or of one row, so that a part's arrays take little memory whatever the batch holds."""
    order = np.argsort(-lens, kind="stable")
    part = np.concatenate([[0], np.cumsum(lens[order])])[:-1] // _ITEMS
    return np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []


def _lens(lists: pa.Array) -> np.ndarray:
    return np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)


def count_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """COUNTS of each row; a null list is empty."""
    n, m = _lens(ref), _lens(hyp)
    totals = np.zeros((len(n), 4), np.int64)
    totals[:, 1], totals[:, 2] = np.where(m == 0, n, 0), np.where(n == 0, m, 0)
    for rows in _slices(n + m):
        a, b, words = _encode(ref.take(pa.array(rows)), hyp.take(pa.array(rows)))
        tables, alone = _filled(a, b, len(words), True)
        for table, right, _ in tables:
            for who, op, _, _ in table.steps(right):
                totals[rows[table.rows[who]], op] += 1
        for k in alone:
            for op, _, _ in _edits(_row(a, k), _row(b, k)):
                totals[rows[k], op] += 1
    sub, dele, ins = totals[:, :3].T
    return pa.StructArray.from_arrays([pa.array(x) for x in (sub, ins, dele, n - sub - dele, n, m)], ["sub", "ins", "del", "correct", "n_ref", "n_hyp"])


def align_ops(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """OPS of each row, in order."""
    a, b, words = _encode(ref, hyp)
    parts = []  # (row, step from the end, op, place of the ref word, place of the hyp word)
    n, m = np.diff(a[1]), np.diff(b[1])
    tables, alone = _filled(a, b, len(words), True)
    for table, right, _ in tables:
        for k, (who, op, i, j) in enumerate(table.steps(right)):
            parts.append((table.rows[who], np.full(len(who), k), op, a[1][table.rows[who]] + i, b[1][table.rows[who]] + j))
    for k in [*alone, *np.flatnonzero((n == 0) ^ (m == 0)).tolist()]:
        left, right, found, i = _row(a, k), _row(b, k), [], 0
        j = 0
        for op, p, q in reversed(_edits(left, right)):
            found += [(3, i + x, j + x) for x in range(p - i)] + [(op, p, q)]
            i, j = p + (op != 2), q + (op != 1)
        found += [(3, i + x, j + x) for x in range(len(left) - i)]
        o, p, q = np.array(found, np.int64).reshape(-1, 3).T
        parts.append((np.full(len(o), k), np.arange(len(o), 0, -1), o, a[1][k] + p, b[1][k] + q))
    row, step, op, i, j = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
    order = np.lexsort((-step, row))
    row, op, i, j = row[order], op[order], i[order], j[order]
    side = lambda codes, at, none: words.take(pa.array(codes[np.where(none, 0, at)] if len(codes) else np.zeros(len(at), np.int64), mask=none)).cast(pa.string())
    names = pa.array(["sub", "del", "ins", "correct"]).take(pa.array(op))
    each = pa.StructArray.from_arrays([names, side(a[0], i, op == 2), side(b[0], j, op == 1)], ["op", "ref", "hyp"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ref)))]).astype(np.int32)), each)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    held = texts.fill_null("").to_pylist()
    return np.frombuffer("".join(held).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))])


def count_chars(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The edit distance of each row's two texts in characters; null where one is null."""
    n, m = (np.array(pc.utf8_length(x).fill_null(0), np.int64) for x in (ref, hyp))
    out = np.where((n == 0) | (m == 0), n + m, 0)
    for rows in _slices(n + m):
        a, b = _letters(ref.take(pa.array(rows))), _letters(hyp.take(pa.array(rows)))
        codes = np.zeros(0x110000, np.int64)
        codes[a[0]] = codes[b[0]] = 1
        kinds, codes = int(codes.sum()), np.cumsum(codes) - 1
        a, b = (codes[a[0]], a[1]), (codes[b[0]], b[1])
        tables, alone = _filled(a, b, kinds, False)
        for table, right, found in tables:
            out[rows[table.rows[right]]] = found
        for k in alone:
            out[rows[k]] = distance(_row(a, k), _row(b, k))
    return pa.array(out, mask=np.array(ref.is_null()) | np.array(hyp.is_null()))


def char_distance(ref: Column, hyp: Column) -> Column:
    """The edit distance of two texts in characters."""

    @F.arrow_udf("bigint")
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        return count_chars(r, h)

    return run(ref, hyp)


def edit_counts(ref: Column, hyp: Column) -> Column:
    """COUNTS of two arrays of words."""

    @F.arrow_udf(COUNTS)
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        return count_edits(r, h)

    return run(ref, hyp)


def edit_ops(ref: Column, hyp: Column) -> Column:
    """OPS of two arrays of words."""

    @F.arrow_udf(OPS)
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        return align_ops(r, h)

    return run(ref, hyp)


def substitutions(ops: Column) -> Column:
    """The substituted pairs."""
    return F.transform(F.filter(ops, lambda o: (o["op"] == "sub") & o["ref"].isNotNull() & o["hyp"].isNotNull()), lambda o: F.struct(o["ref"].alias("ref"), o["hyp"].alias("hyp")))


def _alphabet() -> Column:
    """_LETTERS different characters, folded to a constant once a query."""
    return F.split(F.decode(F.unhex(F.lit("".join(f"{k:04X}" for k in range(19968, 19968 + _LETTERS)))), "UTF-16BE"), "(?!$)")


def native_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two arrays of words inside the JVM: each distinct word of a row is one character; null where a row has more distinct words than there are letters in a block of them."""

    def word(x: Column, letters: Column) -> Column:
        return F.array_join(F.transform(x, lambda t: F.element_at(letters, t)), "")

    def found(p: Column) -> Column:
        fits = F.when(F.size(p["book"]) <= _LETTERS, F.array(F.map_from_arrays(p["book"], F.slice(_alphabet(), 1, F.size(p["book"])))))
        return F.get(F.transform(fits, lambda letters: F.levenshtein(word(p["r"], letters), word(p["h"], letters))), F.lit(0))

    # lists of one, so that words, book and letters are made once a row, however often they are named
    sides = F.transform(F.array(F.struct(ref.alias("r"), hyp.alias("h"))), lambda p: F.struct(p["r"].alias("r"), p["h"].alias("h"), F.array_distinct(F.concat(p["r"], p["h"])).alias("book")))
    return F.get(F.transform(sides, lambda p: F.when(p["r"] == p["h"], F.lit(0)).otherwise(found(p))), F.lit(0)).cast("long")
