"""Order-preserving alignment: one group per unit, each side as a sequence of signatures.

A longest common subsequence depends on order all through, so it runs in a kernel over
Arrow batches, one unit at a time; rows of the table of lengths are bits of whole numbers.
Where the reference of the comparison refuses a unit by its number of cells,
``align`` says so; without a limit, rows of a table that would be too large are computed
again from kept ones when the walk reaches them, so memory grows with the sides' lengths times
the root of one of them, an eighth of a byte for each cell.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ADDED, DELETED, MODIFIED, MOST_LCS_CELLS, UNCHANGED
from .groups import by_group


def lcs(a: list, b: list, most_cells: int | None = MOST_LCS_CELLS) -> tuple[list[tuple[int, int]], bool]:
    """(index pairs, refused). Equal heads match at once; on ties the old side advances. No limit: None.

    A row of the table of lengths is a whole number with a bit for each new element: 0 where the length grows by
    one there, so a row follows from the one below by an addition with its carries, a machine word of cells at a
    time. The last bit is the first element; ``rows_at`` keeps every step-th row and makes those between again.
    """
    n, m = len(a), len(b)
    if most_cells is not None and n * m > most_cells:
        return [], True
    if not n or not m:
        return [], False
    places: dict = {}
    for j, s in enumerate(b):
        places.setdefault(s, []).append(m - 1 - j)
    whole, masks = (1 << m) - 1, {}

    def mask(s) -> int:
        """The bits of the elements equal to s; rare ones are made when asked for, so they take no room."""
        at = places.get(s, ())
        if len(at) < 8:
            return sum(1 << k for k in at)
        if s not in masks:
            bits = np.zeros(m, np.uint8)
            bits[at] = 1
            made = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(masks) * m > 1 << 29:
                masks.clear()
            masks[s] = made
        return masks[s]

    def row_above(i: int, below: int) -> int:
        same = below & mask(a[i])
        return ((below + same) | (below - same)) & whole if same else below

    step = n if n * m <= 1 << 26 else max(1, int(n**0.5))
    kept = {n: whole}
    row = whole
    for i in range(n - 1, -1, -1):
        row = row_above(i, row)
        if i % step == 0:
            kept[i] = row
    band: dict[int, int] = {}
    at_hand: list = [-1, b"", -1, b""]

    def rows_at(i: int) -> tuple[bytes, bytes]:
        """Rows i and i + 1 as bytes."""
        if at_hand[0] != i:
            if i not in band or i + 1 not in band:
                top = min(n, (i // step + 1) * step)
                band.clear()
                band[top] = kept[top]
                for k in range(top - 1, i // step * step - 1, -1):
                    band[k] = row_above(k, band[k + 1])
            size = m // 8 + 1
            here = at_hand[3] if at_hand[2] == i else band[i].to_bytes(size, "little")
            at_hand[:] = [i, here, i + 1, band[i + 1].to_bytes(size, "little")]
        return at_hand[1], at_hand[3]

    def length(row: bytes, bits: int) -> int:
        """Zeros among the last bits: the length of the table from there on."""
        low = int.from_bytes(row[: (bits + 7) // 8], "little") & ((1 << bits) - 1)
        return bits - low.bit_count()

    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        here, below = rows_at(i)
        k = m - 1 - j
        # where the row grows here, only the old side's next element keeps the length
        if not here[k >> 3] >> (k & 7) & 1 or length(below, k + 1) >= length(here, k):
            i += 1
        else:
            j += 1
    return out, False


class Stretches:
    """A suffix automaton of a sequence: states are sets of its substrings' ends, with the first of them."""

    def __init__(self, b: list):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for j, s in enumerate(b):
            now = self._state({}, self.size[last] + 1, j)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][s]
                if self.size[p] + 1 == self.size[q]:
                    self.link[now] = q
                else:
                    copy = self._state(dict(self.next[q]), self.size[p] + 1, self.first[q])
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def _state(self, edges: dict, size: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def longest(self, a: list) -> tuple[int, int, int]:
        """(i, j, length) of the longest stretch of ``a`` in the sequence; the first in a, then the first in the sequence."""
        best, at, size = (0, 0, 0), 0, 0
        for i, s in enumerate(a):
            while at and s not in self.next[at]:
                at = self.link[at]
                size = self.size[at]
            if s in self.next[at]:
                at, size = self.next[at][s], size + 1
            if size > best[2]:
                best = (i + 1 - size, self.first[at] + 1 - size, size)
        return best

    def named(self, a: list, most: int) -> list[int]:
        """For each place of ``a`` where ``most`` more elements are: a number that equal stretches of that length share, -1 for one that isn't in the sequence."""
        out, at, size = [], 0, 0
        for i, s in enumerate(a):
            while at and s not in self.next[at]:
                at = self.link[at]
                size = self.size[at]
            if s in self.next[at]:
                at, size = self.next[at][s], size + 1
            while at and self.size[self.link[at]] >= most:
                at = self.link[at]
            size = min(size, most)
            if i + 1 >= most:
                out.append(at if size == most else -1)
        return out


def matching_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """(i, j, length): the longest common stretch, and so on left and right of it, in order; touching ones are one.

    What is right of a longest stretch has none longer, so all of one length are found in one walk; what lies between
    them has shorter ones only, so nothing is walked more often than there are lengths.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        if i1 >= i2 or j1 >= j2:
            continue
        known = Stretches(b[j1:j2])
        size = known.longest(a[i1:i2])[2]
        if not size:
            continue
        places: dict[int, list[int]] = {}
        for j, s in enumerate(known.named(b[j1:j2], size), j1):
            places.setdefault(s, []).append(j)
        i, j = i1, j1
        for x, s in enumerate(known.named(a[i1:i2], size), i1):
            at = places.get(s, ()) if x >= i else ()
            k = bisect_left(at, j)
            if k < len(at):
                found.append((x, at[k], size))
                todo.append((i, x, j, at[k]))
                i, j = x + size, at[k] + size
        todo.append((i, i2, j, j2))
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return out


def sides(old: DataFrame, new: DataFrame, keys: list[str], idx: str, *values: str) -> DataFrame:
    """Both sides in one table: keys, side 0/1, idx and the values."""
    pick = lambda d, s: d.select(*keys, F.lit(s).alias("side"), F.col(idx).cast("int").alias("idx"), *values)
    return pick(old, 0).unionByName(pick(new, 1))


def align(old: DataFrame, new: DataFrame, keys: list[str], idx: str = "idx", signature: str = "signature", most_cells: int | None = MOST_LCS_CELLS) -> DataFrame:
    """(keys, old_idx, new_idx, lcs_refused); a refused unit gives one row without indices."""
    both = sides(old, new, keys, idx, F.col(signature).alias("signature"))

    def kernel(key: tuple, g: dict[str, list]) -> list[tuple]:
        n = g["side"].count(0)
        pairs, refused = lcs(g["signature"][:n], g["signature"][n:], most_cells)
        if refused:
            return [(*key, None, None, True)]
        return [(*key, g["idx"][i], g["idx"][n + j], False) for i, j in pairs]

    return by_group(both, keys, ["side", "idx"], kernel, "old_idx int, new_idx int, lcs_refused boolean")


def unmatched(side: DataFrame, pairs: DataFrame, keys: list[str], idx: str, pair_idx: str) -> DataFrame:
    return side.join(pairs.where(F.col(pair_idx).isNotNull()).select(*keys, F.col(pair_idx).alias(idx)), [*keys, idx], "left_anti")


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_idx, new_idx): leftovers of both sides paired in order; the longer side's rest stands alone."""
    w = lambda c: Window.partitionBy(*keys).orderBy(c)
    a = left.select(*keys, F.col("idx").alias("old_idx")).withColumn("k", F.row_number().over(w("old_idx")))
    b = right.select(*keys, F.col("idx").alias("new_idx")).withColumn("k", F.row_number().over(w("new_idx")))
    return a.join(b, [*keys, "k"], "full_outer").drop("k")


def multiset(signature: Column | str) -> Column:
    """An aggregate that is equal for equal contents whatever their order: how many, and sums of two 64-bit hashes of each.

    Sums combine before the shuffle, so a page of any size is a few numbers.
    """
    s = F.col(signature) if isinstance(signature, str) else signature
    sums = [F.sum(F.when(s.isNotNull(), F.xxhash64(*(F.lit(x) for x in salt), s)).cast("decimal(20)")) for salt in ((), ("again",))]
    return F.concat_ws("|", F.count(s), *(F.coalesce(x, F.lit(0)).cast("string") for x in sums))


def pair_pages(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, signature) pages to (keys, old_idx, new_idx, seq): same content first, leftovers in order, the rest one-sided."""
    same = align(old, new, keys, most_cells=None).select(*keys, "old_idx", "new_idx")
    rest = zipped(unmatched(old, same, keys, "idx", "old_idx"), unmatched(new, same, keys, "idx", "new_idx"), keys)
    w = Window.partitionBy(*keys).orderBy(F.col("new_idx").asc_nulls_last(), F.col("old_idx").asc_nulls_last())
    return same.unionByName(rest).withColumn("seq", (F.row_number().over(w) - 1).cast("int"))


def line_states(old: DataFrame, new: DataFrame, keys: list[str], idx: str = "idx", line: str = "line") -> DataFrame:
    """Matching-block comparison of lines: (keys, layer, row, idx, line, state), a replacement shown as modified in the changes.

    Its blocks come from the longest matching stretch, recursively, which isn't the alignment above.
    """
    return line_states_of(sides(old, new, keys, idx, F.col(line).alias("line")), keys)


def line_states_of(both: DataFrame, keys: list[str]) -> DataFrame:
    """``line_states`` of one table of both sides: keys, side 0/1, idx and line."""

    def kernel(key: tuple, g: dict[str, list]) -> list[tuple]:
        n = g["side"].count(0)
        a, b = g["line"][:n], g["line"][n:]
        out: dict[str, list] = {"diff-old": [], "diff-new": [], "diff-changes": []}
        i = j = 0
        for i2, j2, size in [*matching_blocks(a, b), (len(a), len(b), 0)]:
            gone, come = a[i:i2], b[j:j2]
            out["diff-old"] += [(x, DELETED) for x in gone] + [(x, UNCHANGED) for x in a[i2 : i2 + size]]
            out["diff-new"] += [(x, ADDED) for x in come] + [(x, UNCHANGED) for x in b[j2 : j2 + size]]
            replaced = bool(gone and come)
            out["diff-changes"] += [(x, MODIFIED if replaced else DELETED) for x in gone] + [(x, MODIFIED if replaced else ADDED) for x in come]
            i, j = i2 + size, j2 + size
        return [(*key, layer, k, x, state) for layer, xs in out.items() for k, (x, state) in enumerate(xs)]

    return by_group(both, keys, ["side", "idx"], kernel, "layer string, row int, line string, state string")
