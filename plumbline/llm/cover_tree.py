"""Embedding near-dedup by dual traversal of cover trees; exact threshold pairs.

Vectors are scaled to unit length, where cosine >= c is distance <= sqrt(2 - 2c).

* Equal vectors are one vector with a weight.
* Upper levels: centres of a farthest-first traversal of a bounded sample (its
  prefixes are nested nets of falling radii).  Every vector goes to its nearest
  centre; each cell has an exact covering radius over all its vectors.  A cell
  of more than a block is split the same way, level by level.
* Cells are packed into groups of a block.  A cell that stays larger (the bound
  on cells is reached, or its sample holds one vector) is split into blocks by
  hash, unless all its vectors link with each other: those are only counted.
* Lower levels: each block builds nested nets with radii that halve from 2 down
  to half the link distance.
* Dual traversal: a vector goes to a group only where a covering radius plus the
  link distance reaches it; then node pairs, level by level, are dropped when
  centre distance exceeds both covering radii plus the link distance, and linked
  as a whole when the distance plus both radii is within it.  Only undecided
  pairs reach single vectors, compared in double precision.

Tasks return per vector its number of links and a forest root, never pairs.
In data without structure (independent directions in many dimensions) bounds
prune little and the work is that of all pairs of net centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Roots, components
from .storage import materialise

SLACK = 1e-9


@dataclass(frozen=True)
class CoverParams:
    """cosine: least cosine of a link; sample: vectors on the driver for the
    centres of a level; centres: children of a cell; most_cells: bound of the
    upper levels, which the driver and every task hold; block: most vectors of a
    block."""

    cosine: float = 0.9
    sample: int = 4096
    centres: int = 64
    most_cells: int = 4096
    block: int = 4096

    @property
    def reach(self) -> float:
        """Link distance between unit vectors."""
        return math.sqrt(max(0.0, 2 - 2 * self.cosine))

    def radii(self) -> list[float]:
        """Halving radii of the nets inside a block, from the diameter of the sphere."""
        found = [2.0]
        while found[-1] > self.reach / 2:
            found.append(found[-1] / 2)
        return found


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows and their positions; others (null, zero, other length, null or non-finite parts) are left out."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null part becomes NaN
    sizes = np.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
    rows = np.flatnonzero(sizes == dim)
    x = values[starts[rows, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    # scaled first, so that the norm neither overflows nor vanishes
    top = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(x).all(axis=1) & (top > 0)
    x, rows = x[good] / top[good, None], rows[good]
    return x / np.linalg.norm(x, axis=1, keepdims=True), rows


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of up to k centres; each is the point farthest from those before."""
    chosen, gap = [0], 2 - 2 * (x @ x[0])
    while len(chosen) < min(k, len(x)):
        far = int(np.argmax(gap))
        if gap[far] <= SLACK:
            break
        chosen.append(far)
        gap = np.minimum(gap, 2 - 2 * (x @ x[far]))
    return np.array(chosen)


def distance(dot: np.ndarray) -> np.ndarray:
    """Distance of unit vectors from their dot product."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * dot))


def net(x: np.ndarray, radius: float, chunk: int = 512) -> np.ndarray:
    """Greedy net in row order: index of the first centre within ``radius`` of each row; centres are over ``radius`` apart."""
    owner, centres = np.full(len(x), -1), np.zeros(0, np.int64)
    least = 1 - radius * radius / 2
    for a in range(0, len(x), chunk):
        part = x[a : a + chunk]
        if len(centres):
            near = part @ x[centres].T >= least
            hit = near.any(axis=1)
            owner[a : a + len(part)][hit] = centres[near[hit].argmax(axis=1)]
        left = a + np.flatnonzero(owner[a : a + len(part)] < 0)
        if not len(left):
            continue
        near = x[left] @ x[left].T >= least
        added = []
        for k in range(len(left)):
            if owner[left[k]] < 0:
                added.append(left[k])
                take = near[k] & (owner[left] < 0)
                take[k] = True
                owner[left[take]] = left[k]
        centres = np.concatenate((centres, added)).astype(np.int64)
    return owner


def _scattered(x: np.ndarray, radius: float, probe: int = 512) -> bool:
    """Whether a net would hardly join vectors, by a probe of many; then each vector is a node of its own, which costs pruning but no link."""
    if len(x) <= 2 * probe:
        return False
    some = x[:: len(x) // probe]
    return len(np.unique(net(some, radius))) > 0.95 * len(some)


class Tree:
    """Nested nets over a block's vectors, which are reordered so that nodes are ranges."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, radii: list[float]):
        order = np.argsort(ids, kind="stable")
        paths = np.zeros((0, len(ids)), np.int64)
        x, ids, copies = x[order], ids[order], copies[order]
        groups = [np.arange(len(ids))]
        for radius in radii:
            path, below = np.zeros(len(ids), np.int64), []
            for rows in groups:
                owner = net(x[rows], radius) if len(rows) > 1 and not _scattered(x[rows], radius) else np.arange(len(rows))
                path[rows] = rows[owner]
                if len(rows) > 1:
                    by = np.argsort(owner, kind="stable")
                    below += [rows[g] for g in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(g) > 1]
            # a row outside every group of two or more is its own node from here on
            lone = np.ones(len(ids), bool)
            for rows in groups:
                lone[rows] = False
            path[lone] = np.flatnonzero(lone)
            paths, groups = np.vstack((paths, path)), below
        sort = np.lexsort(paths[::-1])
        self.ids, self.x, self.copies = ids[sort], x[sort], copies[sort]
        where = np.argsort(sort)
        self.levels = []
        edge = np.zeros(len(ids), bool)
        for path in paths[:, sort]:
            edge = edge | np.concatenate(([True], path[1:] != path[:-1]))
            start = np.flatnonzero(edge)
            centre = self.x[where[path[start]]]
            size = np.diff(np.append(start, len(ids)))
            away = distance(np.einsum("ij,ij->i", self.x, np.repeat(centre, size, axis=0)))
            radius = np.maximum.reduceat(away, start)
            radius[size == 1] = 0
            self.levels.append((start, start + size, centre, radius))


def _crossed(a0, a1, b0, b1):
    """All (i, j) with i in [a0, a1) and j in [b0, b1) for each row of ranges, and the row."""
    na, nb = a1 - a0, b1 - b0
    many = na * nb
    row = np.repeat(np.arange(len(many)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return a0[row] + k // nb[row], b0[row] + k % nb[row], row


class Links:
    """Weighted link counts per row, and components, between two trees or of one with itself.

    The rows themselves are a last level of nodes without extent.
    """

    def __init__(self, left: Tree, right: Tree | None, reach: float):
        self.left, self.right, self.reach = left, right or left, reach
        self.alone = right is None
        ids = left.ids if self.alone else np.concatenate((left.ids, right.ids))
        self.ids = ids
        self.by_id = np.argsort(ids, kind="stable")
        self.back = np.argsort(self.by_id)
        self.shift = 0 if self.alone else len(left.ids)
        self.repeated = len(np.unique(ids)) < len(ids)  # rows of one id don't link with each other
        self.count = np.zeros(len(ids) + 1, np.int64)
        self.ranges = np.zeros(len(ids) + 1, np.int64)
        self.before = [np.concatenate(([0], np.cumsum(t.copies))) for t in (left, self.right)]
        self.roots = Roots(len(ids))
        self.most = max(1024, (4 << 20) // (8 * left.x.shape[1]))

    def _nodes(self, level: int) -> tuple:
        """(start, end, centre, radius) on both sides."""
        if level < len(self.left.levels):
            return self.left.levels[level], self.right.levels[level]
        return tuple((np.arange(len(t.ids)), np.arange(1, len(t.ids) + 1), t.x, np.zeros(len(t.ids))) for t in (self.left, self.right))

    def run(self) -> None:
        """Traverse from the top nodes down where undecided."""
        left, right = self._nodes(0)
        self._meet(0, np.array([0]), np.array([len(left[0])]), np.array([0]), np.array([len(right[0])]))

    def _meet(self, level: int, a0, a1, b0, b1) -> None:
        """Decide all pairs of the nodes [a0, a1) and [b0, b1) of a level, for each row of ranges."""
        left, right = self._nodes(level)
        many = (a1 - a0) * (b1 - b0)
        for k in np.flatnonzero(many > 4096):  # large ranges as matrix products
            for s in range(int(a0[k]), int(a1[k]), 256):
                for t in range(int(b0[k]), int(b1[k]), 2048):
                    i, j = slice(s, min(s + 256, int(a1[k]))), slice(t, min(t + 2048, int(b1[k])))
                    dots = left[2][i] @ right[2][j].T
                    if left[3][i].any() or right[3][j].any():
                        cut = left[3][i, None] + right[3][None, j] + self.reach + SLACK
                        x, y = np.nonzero(dots >= 1 - cut * cut / 2)
                    else:
                        x, y = np.nonzero(dots >= 1 - (self.reach + SLACK) ** 2 / 2)
                    self._decide(level, x + s, y + t, dots[x, y])
        small = np.flatnonzero(many <= 4096)
        total = np.cumsum(many[small])
        at = 0
        while at < len(small):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.most, "right")))
            k = small[at:to]
            i, j, _ = _crossed(a0[k], a1[k], b0[k], b1[k])
            self._decide(level, i, j, np.einsum("ij,ij->i", left[2][i], right[2][j]))
            at = to

    def _decide(self, level: int, i: np.ndarray, j: np.ndarray, dots: np.ndarray) -> None:
        """Node pairs of a level: none, all or one level down."""
        if self.alone:
            half = i <= j
            i, j, dots = i[half], j[half], dots[half]
        (s, e, _, r), (t, f, _, q) = self._nodes(level)
        if level == len(self.left.levels):
            self._link(i, j, dots)
            return
        gap = distance(dots)
        whole = gap + r[i] + q[j] <= self.reach - SLACK
        if self.alone:
            whole &= (i != j) | (2 * r[i] <= self.reach - SLACK)
        if self.repeated:
            whole[:] = False
        self._link_ranges(s[i[whole]], e[i[whole]], t[j[whole]], f[j[whole]])
        open_ = ~whole & (gap <= r[i] + q[j] + self.reach + SLACK)
        if open_.any():
            i, j = i[open_], j[open_]
            below = self._nodes(level + 1)
            self._meet(level + 1, *(np.searchsorted(below[side][0], x) for side, x in ((0, s[i]), (0, e[i]), (1, t[j]), (1, f[j]))))

    def _link(self, i: np.ndarray, j: np.ndarray, dots: np.ndarray) -> None:
        """Link rows whose dot product reaches."""
        hit = (dots >= 1 - self.reach * self.reach / 2) & (self.left.ids[i] != self.right.ids[j])
        i, j = i[hit], j[hit]
        np.add.at(self.count, i, self.right.copies[j])
        np.add.at(self.count, j + self.shift, self.left.copies[i])
        self.roots.join(self.back[i], self.back[j + self.shift])

    def _link_ranges(self, a0, a1, b0, b1) -> None:
        """Link every row of [a0, a1) with every row of [b0, b1), for each row of ranges."""
        if not len(a0):
            return
        there, here = self.before[1][b1] - self.before[1][b0], self.before[0][a1] - self.before[0][a0]
        own = (a0 == b0) & self.alone
        np.add.at(self.ranges, a0, there)
        np.add.at(self.ranges, a1, -there)
        np.add.at(self.ranges, b0[~own] + self.shift, here[~own])
        np.add.at(self.ranges, b1[~own] + self.shift, -here[~own])
        for p, q in zip(a0[own].tolist(), a1[own].tolist(), strict=True):
            self.count[p:q] -= self.left.copies[p:q]  # a row is no partner of its own
        self.roots.join(self.back[a0], self.back[b0 + self.shift])
        width = len(self.ids) + 1
        start, end = np.divmod(np.unique(np.concatenate((a0 * width + a1, (b0 + self.shift) * width + b1 + self.shift))), width)
        size = end - start
        first = np.repeat(start, size)
        self.roots.join(self.back[first], self.back[first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)])

    def result(self) -> tuple[list, list, list]:
        """(vector, forest root, links) of the rows that have a link."""
        count = (self.count + np.cumsum(self.ranges))[:-1]
        hit = np.flatnonzero(count)
        return self.ids[hit].tolist(), self.ids[self.by_id[self.roots.root[self.back[hit]]]].tolist(), count[hit].tolist()


PLACED = "vec_id long, copies long, cell int, away double, unit array<double>"


def _place(ids: pa.Array, copies: pa.Array, x: np.ndarray, cell: np.ndarray, away: np.ndarray) -> pa.RecordBatch:
    unit = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([ids, copies, pa.array(cell.astype(np.int32)), pa.array(away), unit], [c.split()[0] for c in PLACED.split(", ")])


def _units(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assigner(centres: np.ndarray):
    """First placement: unit vectors at their nearest centre, whose number is the cell."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = unit_rows(batch.column("embedding"), centres.shape[1])
            if len(rows):
                dots = x @ centres.T
                cell = dots.argmax(axis=1)
                yield _place(*(batch.column(c).take(pa.array(rows)) for c in ("vec_id", "copies")), x, cell, distance(dots[np.arange(len(x)), cell]))

    return assign


def _refiner(finer: dict[int, tuple[int, np.ndarray]]):
    """Placement one level down: (number of the first new cell, centres) for each cell that is split."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, old = _units(batch.column("unit")), batch.column("cell").to_numpy()
            cell, away = old.copy(), np.zeros(len(old))
            for k in np.unique(old).tolist():
                rows = np.flatnonzero(old == k)
                dots = x[rows] @ finer[k][1].T
                best = dots.argmax(axis=1)
                cell[rows], away[rows] = finer[k][0] + best, distance(dots[np.arange(len(rows)), best])
            if len(old):
                yield _place(batch.column("vec_id"), batch.column("copies"), x, cell, away)

    return refine


def _walk(centres: np.ndarray) -> list[int]:
    """Depth-first order of centres, where a centre's parent is its nearest earlier one."""
    gap = distance(centres @ centres.T)
    children: dict[int, list[int]] = {}
    for k in range(1, len(centres)):
        children.setdefault(int(np.argmin(gap[k, :k])), []).append(k)
    walk, stack = [], [0]
    while stack:
        walk.append(k := stack.pop())
        stack += reversed(children.get(k, []))
    return walk


@dataclass
class Cells:
    """Centres, vectors, covering radii and groups of the cells; blocks per group."""

    centre: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    group: np.ndarray
    blocks: np.ndarray

    def solid(self, p: CoverParams) -> np.ndarray:
        """Groups of more than one block whose vectors all link with each other: they never meet themselves."""
        ball = np.zeros(len(self.blocks))
        np.maximum.at(ball, self.group, 2 * self.radius)
        alone = np.bincount(self.group, minlength=len(self.blocks)) == 1
        return (self.blocks > 1) & alone & (ball <= p.reach - SLACK)


def _grouped(centre: list[np.ndarray], rows: list[int], radius: list[float], order: list[int], p: CoverParams) -> Cells:
    """Cells packed in their order into groups of at most a block; a larger cell is a group of several blocks."""
    group, total = np.zeros(len(order), np.int64), [0]
    for at, k in enumerate(order):
        if total[-1] and total[-1] + rows[k] > p.block:
            total.append(0)
        group[at] = len(total) - 1
        total[-1] += rows[k]
    pick = np.array(order)
    return Cells(np.array(centre)[pick], np.array(rows)[pick], np.array(radius)[pick], group, np.maximum(1, -(-np.array(total) // p.block)))


def _meeter(cells: Cells, number: dict[int, int], p: CoverParams):
    """Each vector's group and block, and the groups that may hold a partner by the covering bounds."""
    order = np.argsort(cells.group, kind="stable")
    first = np.searchsorted(cells.group[order], np.arange(len(cells.blocks)))
    solid = cells.solid(p)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column("unit"))
            place = np.array([number[c] for c in batch.column("cell").to_pylist()])
            g = cells.group[place]
            cut = cells.radius + p.reach + SLACK
            near = np.logical_or.reduceat((x @ cells.centre.T >= 1 - cut * cut / 2)[:, order], first, axis=1)
            near[np.arange(len(g)), g] = ~solid[g]
            rows, others = np.nonzero(near)
            offsets = pa.array(np.searchsorted(rows, np.arange(len(g) + 1)).astype(np.int32))
            partners = pa.ListArray.from_arrays(offsets, pa.array(others.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("copies"), pa.array(g.astype(np.int32)), batch.column("unit"), partners], ["vec_id", "copies", "g", "unit", "partners"]
            )

    return meet


def _traverser(p: CoverParams):
    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close():
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, copies = (table.column(c).to_numpy() for c in ("vec_id", "copies"))
            x = table.column("unit").chunk(0).flatten().to_numpy().reshape(len(ids), -1)
            own = (table.column("g").to_numpy() == key[0]) & (table.column("b").to_numpy() == key[1])
            if key[:2] != key[2:] and own.all() | ~own.any():
                return None
            trees = [Tree(ids[s], copies[s], x[s], p.radii()) for s in (own, ~own) if s.any()]
            links = Links(trees[0], trees[1] if len(trees) > 1 else None, p.reach)
            links.run()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links.result()], ["vec_id", "root", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("g1", "b1", "g2", "b2")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(keys[a].tolist())
                if here != key:
                    if parts and (done := close()) is not None:
                        yield done
                    key, parts = here, []
                parts.append(batch.slice(a, b - a))
        if parts and (done := close()) is not None:
            yield done

    return traverse


def near_vectors(vectors: DataFrame, params: CoverParams | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero, of another length than a partner's or
    hold null or non-finite components link with nothing.  A null vec_id links
    with nothing and its component is null.  Rows with equal vec_id and vector
    are one vector; different vectors of one vec_id don't link with each other,
    count one by one for others, and add up to one n_links and one component.
    More columns are ignored; an empty table gives no rows.
    """
    p = params or CoverParams()
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = slim.filter("vec_id IS NOT NULL AND size(embedding) > 0").withColumns({f"k{k}": F.xxhash64(F.lit(k), "embedding") for k in (1, 2)})
    # equal vectors are one with a weight; counts combine before the shuffle, so copies never meet as rows
    several = usable.select("vec_id", "k1", "k2").distinct().groupBy("vec_id").count().filter("count > 1").select("vec_id", F.col("vec_id").alias("own"))
    several = materialise(several, "cover-repeated")  # ids with several vectors, which stay apart from equal ones of other ids
    usable = usable.withColumn("own", F.lit(None).cast("long")) if several.isEmpty() else usable.join(several, "vec_id", "left")
    same = usable.groupBy("k1", "k2", "own").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"))
    same = materialise(same, "cover-vectors")
    links = None
    for (dim,) in sorted(same.select(F.size("embedding")).distinct().collect()):  # lengths of vectors: one, as a rule
        part = _links_of(same.filter(F.size("embedding") == dim), dim, p)
        if part is not None:
            links = part if links is None else links.unionByName(part)
    if links is None:
        links = slim.sparkSession.createDataFrame([], "vec_id long, root long, links long")
    links = materialise(links, "cover-links")
    # each vector's stand-in, and the copies among different ids
    members = usable.filter("own IS NULL").select("vec_id", "k1", "k2").distinct().join(same.filter("own IS NULL").select(F.col("vec_id").alias("rep"), "copies", "k1", "k2"), ["k1", "k2"])
    members = members.unionByName(several.select("vec_id", F.lit(1).cast("long").alias("k1"), F.lit(1).cast("long").alias("k2"), F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies")))
    members = materialise(members.select("vec_id", "rep", "copies"), "cover-members")
    near = components(
        links.select(F.col("vec_id").alias("u"), F.col("root").alias("v")).unionByName(members.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    )
    by_rep = links.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("n"))
    counted = (
        members.filter("copies > 1").withColumn("m", F.col("copies") - 1).select("vec_id", "m")
        .unionByName(members.join(by_rep, "rep").select("vec_id", F.col("n").alias("m")))
        .groupBy("vec_id").agg(F.sum("m").alias("n"))
    )
    return (
        slim.select("vec_id")
        .join(counted, "vec_id", "left")
        .join(near.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
        )
    )


def _sampled(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    return unit_rows(column.cast(pa.list_(pa.float64())), dim)[0] if len(column) else np.zeros((0, dim))


def _links_of(vectors: DataFrame, dim: int, p: CoverParams) -> DataFrame | None:
    """(vec_id, root, links) per task among different vectors of one length; links are weighted by copies."""
    # at most ``sample`` rows on the driver: those of the smallest hashed ids
    x = _sampled(vectors.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(p.sample).select("embedding").toArrow().column("embedding"), dim)
    centre = list(x[farthest_first(x, p.centres)] if len(x) else np.eye(1, dim))
    placed = materialise(vectors.select("vec_id", "copies", "embedding").mapInArrow(_assigner(np.array(centre)), PLACED), "cover-cells")
    rows, radius, order = [0] * len(centre), [0.0] * len(centre), _walk(np.array(centre))

    def measure(table: DataFrame) -> None:
        for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # at most ``most_cells`` rows
            rows[r.cell], radius[r.cell] = r.n, r.radius

    measure(placed)
    if not any(rows):
        return None
    tried: set[int] = set()
    while large := [k for k in order if rows[k] > p.block and 2 * radius[k] > p.reach - SLACK and k not in tried][: (p.most_cells - len(order)) // p.centres]:
        tried |= set(large)
        inside = placed.filter(F.col("cell").isin(large))
        share = int(min(1.0, 0.9 * p.sample / sum(rows[k] for k in large)) * (1 << 20))
        picked = inside.filter(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 20)) <= share).limit(p.sample).select("cell", "unit").toArrow()
        cell_of, finer = picked.column("cell").to_numpy(), {}
        units = _sampled(picked.column("unit"), dim)
        for k in large:
            mine = units[cell_of == k]
            if len(mine) > 1 and len(chosen := farthest_first(mine, p.centres)) > 1:
                finer[k] = (len(centre), mine[chosen])
                order[order.index(k) : order.index(k) + 1] = [len(centre) + c for c in _walk(mine[chosen])]
                centre += list(mine[chosen])
                rows += [0] * len(chosen)
                radius += [0.0] * len(chosen)
        if finer:
            split = list(finer)
            below = materialise(placed.filter(F.col("cell").isin(split)).mapInArrow(_refiner(finer), PLACED), "cover-cells")
            measure(below)
            placed = placed.filter(~F.col("cell").isin(split)).unionByName(below)
    order = [k for k in order if rows[k]]
    cells = _grouped(centre, rows, radius, order, p)
    met = placed.mapInArrow(_meeter(cells, {k: at for at, k in enumerate(order)}, p), "vec_id long, copies long, g int, unit array<double>, partners array<int>")
    # a pair of groups meets if either has vectors that may reach the other: at most the square of ``most_cells`` rows, a few for data with structure
    pairs = materialise(met.select("g", F.explode("partners").alias("h")).distinct(), "cover-pairs")
    both = pairs.join(pairs.select(F.col("g").alias("h"), F.col("h").alias("g")), ["g", "h"]).groupBy("g").agg(F.collect_set("h").alias("meets"))
    spark = vectors.sparkSession
    sizes = spark.createDataFrame([(g, int(n)) for g, n in enumerate(cells.blocks)], "g int, n_blocks int")
    block = F.pmod(F.xxhash64(F.lit(6), "vec_id"), F.col("n_blocks")).cast("int")
    tasks = (
        met.join(F.broadcast(sizes), "g").join(both, "g")  # at most ``most_cells`` rows each
        .select("vec_id", "copies", "g", block.alias("b"), "unit", F.explode(F.array_intersect("partners", "meets")).alias("h"))
        .join(F.broadcast(sizes.select(F.col("g").alias("h"), F.col("n_blocks").alias("m"))), "h")
        .select("vec_id", "copies", "g", "b", "unit", "h", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    )
    first = (F.col("g") < F.col("h")) | ((F.col("g") == F.col("h")) & (F.col("b") <= F.col("o")))
    keys = ["g1", "b1", "g2", "b2"]
    tasks = tasks.select(
        "vec_id", "copies", "g", "b", "unit",
        F.when(first, F.col("g")).otherwise(F.col("h")).alias("g1"), F.when(first, F.col("b")).otherwise(F.col("o")).alias("b1"),
        F.when(first, F.col("h")).otherwise(F.col("g")).alias("g2"), F.when(first, F.col("o")).otherwise(F.col("b")).alias("b2"),
    )
    links = tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_traverser(p), "vec_id long, root long, links long")
    solid = np.flatnonzero(cells.solid(p)[cells.group])
    if len(solid):  # balls in which all link with all: counted, not compared
        numbers = [order[k] for k in solid]
        inside = placed.filter(F.col("cell").isin(numbers))
        balls = inside.groupBy("cell").agg(F.min("vec_id").alias("root"), F.sum("copies").alias("n"))
        mine = inside.groupBy("cell", "vec_id").agg(F.sum("copies").alias("own"), F.count(F.lit(1)).alias("vectors"))
        links = links.unionByName(mine.join(F.broadcast(balls), "cell").select("vec_id", "root", (F.col("vectors") * (F.col("n") - F.col("own"))).alias("links")))
    return links


def op1_cover_tree(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of all of ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (
  SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, least(u, min(w)) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""
