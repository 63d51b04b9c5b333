"""Alignment by place: dominant shift, leftover neighbours, nearest pairs; and page comparison."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import centroid, cells, distance, shape_signature
from ..schemas import ADDED, DELETED, MODIFIED, MOVE_TOLERANCE, NEARNESS, RELOCATE_DISTANCE, UNCHANGED, VOTE_GRID
from ..session import ensure_checkpoints
from .groups import by_group
from .sequence import lcs, sides


def dominant_offset(old: DataFrame, new: DataFrame, keys: list[str], signature: str = "signature") -> DataFrame:
    """(keys, dx, dy) of every unit on either side: the shift that more than half the voters share, else none.

    Signatures vote if they occur once on each side. All of it is grouping and one equi-join.
    """
    def once(d: DataFrame, s: str) -> DataFrame:
        return d.groupBy(*keys, signature).agg(F.count("*").alias("n"), F.min("x").alias(f"{s}x"), F.min("y").alias(f"{s}y")).where("n = 1").drop("n")

    votes = once(old, "o").join(once(new, "n"), [*keys, signature])
    votes = votes.groupBy(*keys, cells(F.col("nx") - F.col("ox"), VOTE_GRID).alias("dx"), cells(F.col("ny") - F.col("oy"), VOTE_GRID).alias("dy")).agg(F.count("*").alias("n"))
    top = votes.groupBy(*keys).agg(F.max_by(F.struct("dx", "dy"), "n").alias("d"), F.max("n").alias("top"), F.sum("n").alias("total"))
    clear = F.col("top") * 2 > F.col("total")
    units = old.select(*keys).union(new.select(*keys)).distinct()
    found = top.select(*keys, F.when(clear, F.col("d.dx") * VOTE_GRID).alias("dx"), F.when(clear, F.col("d.dy") * VOTE_GRID).alias("dy"))
    return units.join(found, keys, "left").select(*keys, F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy"))


def residual_nearest(old: DataFrame, new: DataFrame, keys: list[str], most: float = RELOCATE_DISTANCE) -> DataFrame:
    """Leftover objects (keys, signature, idx, x, y) paired within one signature: each old one in order takes its nearest free new one.

    Old coordinates must have the page's shift added already. Candidates never leave (unit, signature),
    so that is the group of the kernel.
    """
    both = old.select(*keys, "signature", F.lit(0).alias("side"), "idx", "x", "y").unionByName(new.select(*keys, "signature", F.lit(1).alias("side"), "idx", "x", "y"))

    def kernel(key: tuple, g: dict[str, list]) -> list[tuple]:
        n, at = g["side"].count(0), np.array([g["x"], g["y"]], float).T
        return [(*key[:-1], g["idx"][i], g["idx"][n + j]) for i, j in in_turn(at[:n], at[n:], most)]

    return by_group(both, [*keys, "signature"], ["side", "idx"], kernel, "old_idx int, new_idx int", keep=keys)


def moved_verdict(old: Column, new: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """(state, reason) of a matched page object; ``relocated`` ones are split by the caller."""
    d = F.hypot(new["x"] - (old["x"] + dx), new["y"] - (old["y"] + dy))
    reasons = F.concat_ws("+", F.when(d > MOVE_TOLERANCE, F.format_string("moved %.1f", d)), F.when(~old["style"].eqNullSafe(new["style"]), F.lit("style")))
    reason = F.when(d > RELOCATE_DISTANCE, F.lit("relocated")).otherwise(reasons)
    return F.when(reason == "", UNCHANGED).otherwise(MODIFIED), reason


def compare_pages(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Page objects of both sides (keys, PAGE_OBJECT) to deltas (keys, state, reason, old, new, matched).

    Shift, alignment in drawing order, leftovers by place, verdicts; a pair farther apart than
    reads as a move becomes a deletion and an addition, both matched.
    """
    body = [c for c in old.columns if c not in keys]
    pairs = page_pairs(old, new, keys)
    o = old.select(*keys, F.col("idx").alias("old_idx"), F.struct(*body).alias("old"))
    n = new.select(*keys, F.col("idx").alias("new_idx"), F.struct(*body).alias("new"))
    # the pairs meet either side once: what stays null is an addition or a deletion
    m = o.join(pairs, [*keys, "old_idx"], "left").join(n, [*keys, "new_idx"], "full_outer")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    state, reason = moved_verdict(F.col("old"), F.col("new"), F.col("dx"), F.col("dy"))
    none_new, none_old = F.lit(None).cast(m.schema["new"].dataType), F.lit(None).cast(m.schema["old"].dataType)

    def row(state: Column, reason: Column, old: Column, new: Column, matched: bool) -> Column:
        return F.struct(state.alias("state"), reason.alias("reason"), old.alias("old"), new.alias("new"), F.lit(matched).alias("matched"))

    gone, come = F.lit(DELETED), F.lit(ADDED)
    rows = (
        F.when(both & (reason == "relocated"), F.array(row(gone, reason, F.col("old"), none_new, True), row(come, reason, none_old, F.col("new"), False)))
        .when(both, F.array(row(state, reason, F.col("old"), F.col("new"), True)))
        .when(F.col("old").isNotNull(), F.array(row(gone, F.lit(""), F.col("old"), none_new, False)))
        .otherwise(F.array(row(come, F.lit(""), none_old, F.col("new"), False)))
    )
    return m.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def page_pairs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_idx, new_idx, dx, dy): drawing order first, then leftovers by place, in one pass over each unit.

    The alignment in drawing order needs no table of all cells, so no unit is refused.
    """
    shift = dominant_offset(old, new, keys)
    both = sides(old, new, keys, "idx", "signature", "x", "y").join(shift, keys)

    def kernel(key: tuple, g: dict[str, list]) -> list[tuple]:
        n, sig, idx, dx, dy = g["side"].count(0), g["signature"], g["idx"], g["dx"][0], g["dy"][0]
        pairs, _ = lcs(sig[:n], sig[n:], None)
        used = {i for i, _ in pairs}, {j for _, j in pairs}
        free: dict[str, tuple[list[int], list[int]]] = {}
        for k in range(len(sig)):
            side = int(k >= n)
            if k - side * n not in used[side]:
                free.setdefault(sig[k], ([], []))[side].append(k)
        for here, there in free.values():
            if here and there:
                place = lambda ks, x, y: np.array([(g["x"][k] + x, g["y"][k] + y) for k in ks])
                pairs += [(here[i], there[j] - n) for i, j in in_turn(place(here, dx, dy), place(there, 0.0, 0.0), RELOCATE_DISTANCE)]
        return [(*key, idx[i], idx[n + j], dx, dy) for i, j in pairs]

    return by_group(both, keys, ["side", "idx"], kernel, "old_idx int, new_idx int, dx double, dy double")


def bbox_diagonal(elements: DataFrame, keys: list[str], verts: str = "verts") -> DataFrame:
    """(keys, diagonal) of the box around all vertices; 0 without any. Each element folds its own box first."""
    def bounds(k: int) -> tuple[Column, Column]:
        axis = F.filter(F.transform(F.col(verts), lambda v: v.cast("double")), lambda v, i: F.pmod(i, F.lit(3)) == k)
        return F.min(F.array_min(axis)), F.max(F.array_max(axis))

    sides = [b for k in range(3) for b in bounds(k)]
    box = elements.groupBy(*keys).agg(*[s.alias(f"b{i}") for i, s in enumerate(sides)])
    square = sum(((F.col(f"b{2 * k + 1}") - F.col(f"b{2 * k}")) ** 2 for k in (1, 2)), (F.col("b1") - F.col("b0")) ** 2)
    return box.select(*keys, F.coalesce(F.sqrt(square), F.lit(0.0)).alias("diagonal"))


def shaped(elements: DataFrame) -> DataFrame:
    """Centroid and shape signature as columns, computed once for each element."""
    return elements.withColumn("center", centroid("verts")).withColumn("shape", shape_signature("verts", "faces", F.col("center")))


class FreePoints:
    """A box tree over points from which the closest free one is asked for and taken; of equal distances the smaller number counts."""

    def __init__(self, q: np.ndarray, leaf: int = 64):
        self.q, self.leaf = q, leaf
        self.order, self.nodes = np.arange(len(q)), []
        self.free = np.ones(len(q), bool)
        if len(q):
            self._grow(0, len(q))
        self.home = np.zeros(len(q), int)
        for k, node in enumerate(self.nodes):
            if node[4] is None:
                self.order[node[2] : node[3]].sort()
                self.home[self.order[node[2] : node[3]]] = k

    def _grow(self, a: int, b: int) -> int:
        """Over q[order[a:b]]: [low, high, begin, end, children or None, free points, parent, smallest number]."""
        some = self.q[self.order[a:b]]
        low, high = some.min(0), some.max(0)
        at = len(self.nodes)
        self.nodes.append([low, high, a, b, None, b - a, -1, int(self.order[a:b].min())])
        # equal points are parted by their numbers, so that a leaf is small whatever the points
        if b - a > self.leaf:
            if (high > low).any():
                by = np.argsort(some[:, int((high - low).argmax())], kind="stable")
                self.order[a:b] = self.order[a:b][by]
            else:
                self.order[a:b].sort()
            half = (a + b) // 2
            self.nodes[at][4] = (self._grow(a, half), self._grow(half, b))
            for c in self.nodes[at][4]:
                self.nodes[c][6] = at
        return at

    def closest(self, x: np.ndarray, most: float = np.inf) -> tuple[float, int]:
        """(distance, number) of the closest free point nearer than ``most``; (most, -1) without one."""
        best, todo = (most, -1), [(0.0, -1, 0)] if self.nodes else []
        nodes = self.nodes
        while todo:
            least, first, k = heapq.heappop(todo)
            if (least, first) > best:
                break
            _, _, a, b, children, _, _, _ = nodes[k]
            if children is None:
                here = self.order[a:b][self.free[self.order[a:b]]]
                d = self._lengths(self.q[here] - x)
                j = int(d.argmin()) if len(d) else -1
                if j >= 0 and (d[j] < best[0] or (d[j], here[j]) < best):
                    best = (float(d[j]), int(here[j]))
                continue
            for c in children:
                low, high, _, _, _, left, _, first = nodes[c]
                if left:
                    gap = np.maximum(0, np.maximum(low - x, x - high))
                    bound = float(self._lengths(gap[None])[0])
                    if (low != high).any():
                        bound *= 1 - 1e-12
                    if (bound, first) < best:
                        heapq.heappush(todo, (bound, first, c))
        return best

    @staticmethod
    def _lengths(gap: np.ndarray) -> np.ndarray:
        return np.hypot(gap[:, 0], gap[:, 1]) if gap.shape[1] == 2 else np.sqrt((gap**2).sum(1))

    def take(self, j: int) -> None:
        self.free[j] = False
        k = self.home[j]
        while k >= 0:
            self.nodes[k][5] -= 1
            k = self.nodes[k][6]


def closest_pairs(p: np.ndarray, q: np.ndarray, leaf: int = 64) -> list[tuple[int, int, float]]:
    """One-to-one pairs (i, j, distance) of points, accepted by (distance, i, j).

    Each point of p asks the tree over q for its closest free partner and waits in a heap under the
    answer; if the partner is gone when its turn comes it asks again. Memory grows with the points, not with the pairs.
    """
    if not len(p) or not len(q):
        return []
    points = FreePoints(q, leaf)
    heap = [(d, i, j) for i, (d, j) in enumerate(map(points.closest, p))]
    heapq.heapify(heap)
    out: list[tuple[int, int, float]] = []
    while heap and len(out) < min(len(p), len(q)):
        d, i, j = heapq.heappop(heap)
        if not points.free[j]:
            d, j = points.closest(p[i])
            heapq.heappush(heap, (d, i, j))
            continue
        points.take(j)
        out.append((i, j, d))
    return out


def in_turn(p: np.ndarray, q: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs (i, j): each point of p in order takes its closest free point of q nearer than ``most``."""
    points, out = FreePoints(q), []
    for i in range(len(p) if len(q) else 0):
        _, j = points.closest(p[i], most)
        if j >= 0:
            points.take(j)
            out.append((i, j))
    return out


#: Elements of one shape beyond which its pairs are looked for on many tasks first.
MANY = 20_000


def same_place(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """(group, old_idx, new_idx): elements at equal centres, the first with the first. Distance zero comes before all others, so these pairs stand."""
    at = [*group, "x", "y", "z"]
    numbered = lambda d, s: d.withColumn("k", F.row_number().over(Window.partitionBy(*at).orderBy("idx"))).select(*at, "k", F.col("idx").alias(f"{s}_idx"))
    return numbered(old, "old").join(numbered(new, "new"), [*at, "k"]).select(*group, "old_idx", "new_idx")


def mutual_pairs(edges: DataFrame, group: list[str]) -> Iterator[DataFrame]:
    """Rounds of (group, old_idx, new_idx, distance): of the candidates those that are the best (distance, old, new) of both their ends.

    No other candidate of either end comes before such a pair, so it is one of the sequential order;
    its ends' other candidates go, and the rest is asked again.
    """
    order = F.struct("distance", "old_idx", "new_idx")
    while True:
        best = {s: edges.groupBy(*group, f"{s}_idx").agg(F.min(order).alias(f"{s}_best")) for s in ("old", "new")}
        both = edges.join(best["old"], [*group, "old_idx"]).join(best["new"], [*group, "new_idx"])
        taken = both.where((F.col("old_best") == order) & (F.col("new_best") == order)).select(*group, "old_idx", "new_idx", "distance").checkpoint()
        if taken.isEmpty():
            return
        yield taken
        for s in ("old", "new"):
            edges = edges.join(taken.select(*group, f"{s}_idx"), [*group, f"{s}_idx"], "left_anti")
        edges = edges.checkpoint()


def near_candidates(old: DataFrame, new: DataFrame, group: list[str], crowd: int = 4) -> DataFrame:
    """(group, old_idx, new_idx, distance): all pairs no farther apart than the group's reach.

    The reach is the largest of the box's width / 4^k at which the squares of the cells' counts sum to ``crowd`` times the
    elements at most. A cell and its 26 neighbours then hold 13.5 times as many pairs at most: counts decide, and
    pairs are never written out before they are known to be few. A group that is dense at every width has no candidates.
    """
    sides = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    box = sides.groupBy(*group).agg(*(f(c).alias(f"_{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("_n"))
    wide = F.greatest(*(F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in "xyz"))
    tried = box.select(*group, wide.alias("_wide"), "_n").where("_wide > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("_r", F.col("_wide") / F.pow(F.lit(4.0), "_k")).drop("_wide")
    cell = lambda d: d.withColumns({f"_c{c}": F.floor(F.col(c) / F.col("_r")).cast("long") for c in "xyz"})
    where = [*group, "_k", "_cx", "_cy", "_cz"]
    counts = cell(sides.join(tried, group)).groupBy(*where, "_side").agg(F.count("*").alias("_m"), F.first("_n").alias("_n"))
    few = counts.groupBy(*group, "_k").agg(F.sum(F.col("_m") * F.col("_m")).alias("_squares"), F.first("_n").alias("_n")).where(F.col("_squares") <= crowd * F.col("_n"))
    chosen = tried.join(few.groupBy(*group).agg(F.min("_k").alias("_k")), [*group, "_k"]).select(*group, "_k", "_r")
    placed = [cell(d.join(chosen, group)).withColumnsRenamed({"idx": f"{s}_idx", **{c: f"_{s}_{c}" for c in "xyz"}}) for s, d in (("old", old), ("new", new))]
    around = F.explode(F.array(*[F.struct(*(F.lit(v).alias(f"d{c}") for c, v in zip("xyz", at, strict=True))) for at in itertools.product((-1, 0, 1), repeat=3)]))
    beside = placed[0].withColumn("_a", around).withColumns({f"_c{c}": F.col(f"_c{c}") + F.col(f"_a.d{c}") for c in "xyz"}).drop("_a")
    gap = {c: F.col(f"_old_{c}") - F.col(f"_new_{c}") for c in "xyz"}
    square = gap["x"] * gap["x"] + gap["y"] * gap["y"] + gap["z"] * gap["z"]
    met = beside.join(placed[1].drop("_r"), where).withColumn("distance", F.sqrt(square))
    # within the reach by more than a cell's bound can be rounded
    return met.where(F.col("distance") <= F.col("_r") * (1 - 1e-9)).select(*group, "old_idx", "new_idx", "distance")


def nearest_first(old: DataFrame, new: DataFrame, keys: list[str], many: int = MANY) -> DataFrame:
    """Elements with (keys, shape, idx, center) paired one to one, closest pairs first: (keys, old_idx, new_idx, distance).

    Pairs compete only within one shape, so accepting by (distance, old, new) inside each
    (keys, shape) group gives the same pairs as one list over everything. Shapes with more than ``many`` elements
    are taken on by joins first, whatever their tasks: elements in the same place, then mutual bests within
    a short reach, round by round. What they leave, far fewer as a rule, goes through the kernel as smaller shapes do.
    """
    group = [*keys, "shape"]
    pick = lambda d: d.select(*group, F.col("idx").cast("int").alias("idx"), *(F.col(f"center.{c}").cast("double").alias(c) for c in "xyz"))
    old, new = pick(old), pick(new)
    sizes = old.select(*group).unionByName(new.select(*group)).groupBy(*group).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > many).select(*group)
    found: list[DataFrame] = []
    if not large.isEmpty():
        ensure_checkpoints(old.sparkSession)
        large = large.checkpoint()
        hot = [d.join(large, group, "left_semi").checkpoint() for d in (old, new)]
        rest = [d.join(large, group, "left_anti") for d in (old, new)]

        def without(sides: list[DataFrame], pairs: DataFrame) -> list[DataFrame]:
            return [d.join(pairs.select(*group, F.col(f"{s}_idx").alias("idx")), [*group, "idx"], "left_anti").checkpoint() for s, d in zip(("old", "new"), sides, strict=True)]

        found.append(same_place(*hot, group).withColumn("distance", F.lit(0.0)).checkpoint())
        hot = without(hot, found[0])
        rounds = list(mutual_pairs(near_candidates(*hot, group).checkpoint(), group))
        if rounds:
            taken = functools.reduce(DataFrame.unionByName, rounds)
            found.append(taken)
            hot = without(hot, taken)
        old, new = (a.unionByName(b) for a, b in zip(rest, hot, strict=True))
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))

    def kernel(key: tuple, g: dict[str, list]) -> list[tuple]:
        n = g["side"].count(0)
        place = np.array([g["x"], g["y"], g["z"]], float).T
        idx = g["idx"]
        return [(*key[:-1], idx[i], idx[n + j], d) for i, j, d in closest_pairs(place[:n], place[n:])]

    pairs = by_group(both, group, ["side", "idx"], kernel, "old_idx int, new_idx int, distance double", keep=keys)
    for f in found:
        pairs = pairs.unionByName(f.select(*keys, "old_idx", "new_idx", "distance"))
    return pairs


def compare_shapes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Models without ids: (keys, state, old_idx, new_idx, matched). The same shape within 2 % of the larger
    model's diagonal is unchanged; farther away it is a deletion and an addition."""
    o, n = shaped(old), shaped(new)
    pairs = nearest_first(o, n, keys)
    size = bbox_diagonal(old, keys).unionByName(bbox_diagonal(new, keys)).groupBy(*keys).agg(F.max("diagonal").alias("d"))
    near = F.col("distance") <= F.when(F.col("d") > 0, F.col("d")).otherwise(1.0) * NEARNESS
    o_idx, n_idx = old.select(*keys, F.col("idx").alias("old_idx")), new.select(*keys, F.col("idx").alias("new_idx"))
    m = o_idx.join(pairs, [*keys, "old_idx"], "left").join(n_idx.withColumn("there", F.lit(True)), [*keys, "new_idx"], "full_outer").join(size, keys)
    none = F.lit(None).cast("int")

    def row(state: str, a: Column, b: Column, matched: bool) -> Column:
        return F.struct(F.lit(state).alias("state"), a.alias("old_idx"), b.alias("new_idx"), F.lit(matched).alias("matched"))

    a, b = F.col("old_idx"), F.col("new_idx")
    rows = (
        F.when(near, F.array(row(UNCHANGED, a, b, True)))
        .when(F.col("distance").isNotNull(), F.array(row(DELETED, a, none, True), row(ADDED, none, b, False)))
        .when(a.isNotNull(), F.array(row(DELETED, a, none, False)))
        .otherwise(F.array(row(ADDED, none, b, False)))
    )
    return m.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


__all__ = ["bbox_diagonal", "compare_pages", "compare_shapes", "distance", "dominant_offset", "moved_verdict", "nearest_first", "page_pairs", "residual_nearest", "shaped"]
