"""Filling numeric columns from the k nearest rows, exactly and without comparing all pairs.

The distance is Euclidean over the columns two rows both have, scaled up for those they do not share:
sqrt(columns / shared * sum of squares). A row's pattern is the set of columns it has.

1. Donors with equal values in all columns weigh no more than k rows, the first by key; receivers with equal values are looked up once.
2. The donors of a pattern are dealt to the cells of a k-d tree over its columns, built from a bounded sample, so cells hold about equally many
   donors however they are spread. Every donor is in one cell, whatever patterns ask for it.
3. A receiver is first sent to a few cells near it for each column it lacks (``PROBES``); what is found there bounds the k-th distance. Then it is sent to
   all other cells whose nearest corner lies within that bound; corners count in the columns that receiver and box share. Runs of boxes have a box
   around them, so most boxes are not looked at one by one.
4. Inside a cell the same tree and boxes are used again before distances are computed, and only donors within the bound are given. Cells with many
   receivers or many donors are split over tasks; the best of all tasks are ranked at the end.

The sample decides how even the cells are, never what is found. The donors of patterns with few rows (``CELL_ROWS`` / 4), or beyond the
``MOST_PATTERNS`` commonest, have no boxes: every receiver is compared with all of them at once, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.joins import once
from ..session import cut_lineage, ship_package
from .impute import numeric_columns

CELL_ROWS = 2_000           # donors a cell should hold
MOST_CELLS = 2_048          # cells of all trees together, beside one for each pattern
MOST_PATTERNS = 2_048       # patterns with a tree
SAMPLE_ROWS = 200_000       # donors that shape all trees together
TASK_RECEIVERS, TASK_DONORS = 20_000, 200_000
RUN = 16                    # boxes with one box around them
PROBES = 2                  # cells searched for a bound on the k-th distance of each column


class Tree:
    """A k-d tree: inner nodes split the widest column of their points in the middle of the sorted values."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.dim, self.cut, self.child = [-1], [0.0], [0]
        todo = [(0, np.arange(len(points)), max(1, leaves))]
        while todo:
            node, rows, share = todo.pop()
            own = points[rows]
            width = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(1)
            j = int(np.argmax(width))
            if share < 2 or len(rows) < 2 or not width[j] > 0:
                continue
            values = np.sort(own[:, j])
            cut = values[len(values) // 2]
            if cut == values[0]:
                cut = values[np.searchsorted(values, cut, "right")]
            left = own[:, j] < cut
            self.dim[node], self.cut[node], self.child[node] = j, float(cut), len(self.dim)
            for part, n in ((rows[left], share // 2), (rows[~left], share - share // 2)):
                todo.append((len(self.dim), part, n))
                self.dim.append(-1)
                self.cut.append(0.0)
                self.child.append(0)
        self.dim, self.cut, self.child = np.array(self.dim), np.array(self.cut), np.array(self.child)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            open_ = np.flatnonzero(self.dim[node] >= 0)
            if not len(open_):
                return node
            at = node[open_]
            node[open_] = self.child[at] + (points[open_, self.dim[at]] >= self.cut[at])


def visits(points: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, box) pairs in which a point's k nearest rows within its limit can lie; boxes have corners ``low`` and ``high``."""
    step = max(1, 2_000_000 // max(1, low.size))
    who, where = [], []
    for a in range(0, len(points), step):
        p = points[a:a + step, None, :]
        below, above = low[None] - p, p - high[None]
        near = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        bound = limit[a:a + step, None]
        if count.sum() >= k and not np.isfinite(bound).all():
            far = (np.maximum(-below, -above) ** 2).sum(axis=2)
            order = np.argsort(far, axis=1)
            enough = (np.cumsum(count[order], axis=1) >= k).argmax(axis=1)
            bound = np.minimum(bound, np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1))
        i, j = np.nonzero(~(near > bound * (1 + 1e-9)))
        who.append(i + a)
        where.append(j)
    return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of squared differences of all pairs, added in column order."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return out


def first_of_each(point: np.ndarray, distance: np.ndarray, donor: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k rows of each point by distance, ties by donor."""
    order = np.lexsort((donor, distance, point))
    p = point[order]
    head = np.flatnonzero(np.concatenate([[True], np.diff(p) > 0])) if len(p) else np.zeros(0, np.int64)
    return order[np.arange(len(p)) - np.repeat(head, np.diff(np.append(head, len(p)))) < k]


def nearest_in(points: np.ndarray, donors: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, donor, sum of squares) of each point's k nearest donors within its limit, ties by donor position (donors come in key order)."""
    out = []

    def search(p_rows: np.ndarray, d_rows: np.ndarray) -> None:
        step = max(1, 2_000_000 // len(d_rows))
        for a in range(0, len(p_rows), step):
            rows = p_rows[a:a + step]
            d = squares(points[rows], donors[d_rows])
            last = limit[rows, None] * (1 + 1e-9)
            if len(d_rows) > k and not np.isfinite(last).all():
                last = np.minimum(last, np.partition(d, k - 1, axis=1)[:, k - 1:k])
            i, j = np.nonzero(~(d > last))
            s, j = d[i, j], d_rows[j]
            best = first_of_each(i, s, j, k)
            out.append((rows[i[best]], j[best], s[best]))

    if len(donors) <= 256:
        search(np.arange(len(points)), np.arange(len(donors)))
    else:
        cell = Tree(donors, len(donors) // 64).cell(donors)
        order = np.argsort(cell, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) > 0]))
        parts = np.split(order, heads[1:])
        low, high = (f.reduceat(donors[order], heads, axis=0) for f in (np.minimum, np.maximum))
        for a in range(0, len(points), 4096):
            who, where = visits(points[a:a + 4096], low, high, np.array([len(p) for p in parts]), k, limit[a:a + 4096])
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(where[by]) > 0])) if len(by) else []
            for own in np.split(by, cuts[1:]) if len(by) else []:
                search(who[own] + a, parts[where[own[0]]])
    p, d, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    best = first_of_each(p, s, d, k)
    return p[best], d[best], s[best]


def nearest_of_all(points: np.ndarray, own: np.ndarray, donors: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, donor, distance) of the k nearest donors within its limit for each column that the points (of one pattern) lack, donors of any patterns; ties by donor position."""
    has = ~np.isnan(donors)
    shared = has[:, own].sum(axis=1)
    ratio = np.where(shared > 0, len(own) / np.maximum(shared, 1), np.inf)
    filled = np.where(has, donors, 0.0)
    lacks = [at for c in np.flatnonzero(~own) if len(at := np.flatnonzero(has[:, c] & (shared > 0)))]
    lacks = list({at.tobytes(): at for at in lacks}.values())
    out = []
    step = max(1, 1_000_000 // max(1, len(donors)))
    for a in range(0, len(points), step):
        p = points[a:a + step]
        d = np.zeros((len(p), len(donors)))
        for j in np.flatnonzero(own):
            gap = p[:, j, None] - filled[None, :, j]
            d += np.where(has[None, :, j], gap * gap, 0.0)
        d[:, shared > 0] *= ratio[shared > 0]
        for at in lacks:
            near = d[:, at]
            last = limit[a:a + step, None] * (1 + 1e-9)
            if near.shape[1] > k and not np.isfinite(last).all():  # ties at the k-th place stay until donors are put in order
                last = np.minimum(last, np.partition(near, k - 1, axis=1)[:, k - 1:k])
            i, j = np.nonzero(~(near > last))
            best = first_of_each(i, near[i, j], j, k)
            out.append(np.stack([i[best] + a, at[j[best]]]))
        if out and a + step < len(points):
            out = [np.unique(np.concatenate(out, axis=1), axis=1)]
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    who, which = np.unique(np.concatenate(out, axis=1), axis=1)
    total = np.zeros(len(who))
    for j in np.flatnonzero(own):
        gap = points[who, j] - filled[which, j]
        total += np.where(has[which, j], gap * gap, 0.0)
    return who, which, total * ratio[which]


def impute_knn(df: DataFrame, columns: list[str] | None = None, key: list[str] = ["incident_id"], k: int = 5) -> DataFrame:
    """Mean of the k nearest rows that have the value; the column mean when no row shares a column.

    Any number of columns; NaN counts as missing. Ties go to the smaller key. A column without any value stays missing.
    Work grows with the rows and with the cells they visit, not with the pairs of patterns (sets of present columns).
    """
    columns = [c for c in numeric_columns(df) if c not in key] if columns is None else columns
    if not columns:
        return df
    n = len(columns)
    given = [F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns]
    pattern = F.concat(*[F.when(x.isNotNull(), "1").otherwise("0") for x in given])
    # behind a generator: filters on patterns of many columns would be pushed into their expressions and take the optimizer minutes
    rows = df.select(F.inline(F.array(F.struct(F.struct(*[F.col(f"`{c}`") for c in key]).alias("k"), F.array(*given).alias("v"), pattern.alias("m")))))
    means = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(given)]).first()
    keyed = once(df, {"_m": pattern, "_v": F.when(pattern.contains("0"), F.array(*given))})
    near = _nearest(rows, n, k).select(F.col("m").alias("_m"), F.col("v").alias("_v"), "near")
    # complete rows have no vector and need no lookup: they go round the join, so they meet in no task
    holes = keyed.filter("_v is not null").join(near, ["_m", "_v"], "left")
    keyed = holes.unionByName(keyed.filter("_v is null").withColumn("near", F.lit(None).cast(near.schema["near"].dataType)))
    return keyed.withColumns({c: F.coalesce(x, F.try_element_at("near", F.lit(i)), F.lit(means[i]).cast("double"))
                              for i, (c, x) in enumerate(zip(columns, given, strict=True))}).select(*[F.col(f"`{c}`") for c in df.columns])


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """Rows of n numbers, NaN where they are null."""
    return column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, n)


def pattern_bits(m: str) -> np.ndarray:
    return np.frombuffer(m.encode(), np.uint8) == ord("1")


class Boxes:
    """The cells' boxes: which columns they have, corners (NaN where they have none), how many donors they hold; runs of boxes of one tree have a box around them."""

    def __init__(self, cell: np.ndarray, has: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray):
        self.cell, self.has, self.low, self.high, self.count = cell, has, low, high, count
        change = np.flatnonzero((has[1:] != has[:-1]).any(axis=1)) + 1
        trees = zip([0, *change], [*change, len(cell)], strict=True)
        self.runs = [np.arange(i, min(i + RUN, b)) for a, b in trees for i in range(a, b, RUN)]
        head = [r[0] for r in self.runs]
        self.run_has = has[head]
        self.run_low, self.run_high = (f.reduceat(x, head, axis=0) if head else x for f, x in ((np.minimum, low), (np.maximum, high)))

    def likely(self, own: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell): for each column that the points lack the ``PROBES`` cells, of k donors at least, that promise the least k-th distance."""
        who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        full = [r[self.count[r] >= k] for r in self.runs]
        usable = np.array([len(r) > 0 for r in full], bool)

        def promise(rows: np.ndarray, has: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """The nearest corner first, then the smallest box."""
            near, far = corners(own, points[rows], has, low, high)
            return near + far * 1e-3

        all_ = np.arange(len(points))
        for c in np.flatnonzero(~own):
            at = np.flatnonzero(usable & self.run_has[:, c] & (self.run_has & own).any(axis=1))
            if not len(at):
                continue
            score = promise(all_, self.run_has[at], self.run_low[at], self.run_high[at])
            tried = at[np.argsort(score, axis=1)[:, :8 * PROBES]]
            best, cell = np.full((len(points), tried.shape[1] * PROBES), np.inf), np.full((len(points), tried.shape[1] * PROBES), -1)
            for run in np.unique(tried):
                i, turn = np.nonzero(tried == run)
                boxes = full[run]
                score = promise(i, self.has[boxes], self.low[boxes], self.high[boxes])
                first = np.argsort(score, axis=1)[:, :PROBES]
                to = turn[:, None] * PROBES + np.arange(first.shape[1])
                best[i[:, None], to], cell[i[:, None], to] = np.take_along_axis(score, first, 1), self.cell[boxes[first]]
            first = np.argsort(best, axis=1)[:, :PROBES]
            cell = np.take_along_axis(cell, first, 1)
            i, j = np.nonzero(cell >= 0)
            who.append(i)
            where.append(cell[i, j])
        pairs = np.unique(np.stack([np.concatenate(who), np.concatenate(where)]), axis=1)
        return pairs[0], pairs[1]

    def within(self, own: np.ndarray, points: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, limit): the cells whose nearest corner is within a point's limit for one of the columns that it lacks and the cell has; the greatest such limit."""
        who, where, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        at = np.flatnonzero((self.run_has & own).any(axis=1) & (self.run_has & ~own).any(axis=1))
        if not len(at):
            return who[0], where[0], most[0]
        limit = np.stack([limits[:, np.flatnonzero(self.run_has[r] & ~own)].max(axis=1) for r in at], axis=1)
        near, _ = corners(own, points, self.run_has[at], self.run_low[at], self.run_high[at], False)
        open_ = ~(near > limit * (1 + 1e-9))
        for j in np.flatnonzero(open_.any(axis=0)):
            i, boxes = np.flatnonzero(open_[:, j]), self.runs[at[j]]
            near, _ = corners(own, points[i], self.has[boxes], self.low[boxes], self.high[boxes], False)
            row, box = np.nonzero(~(near > limit[i, j, None] * (1 + 1e-9)))
            who.append(i[row])
            where.append(self.cell[boxes[box]])
            most.append(limit[i[row], j])
        return np.concatenate(who), np.concatenate(where), np.concatenate(most)


def corners(own: np.ndarray, points: np.ndarray, has: np.ndarray, low: np.ndarray, high: np.ndarray, farthest: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Distances of points of one pattern to the nearest and, if asked for, to the farthest corners of boxes that share a column with them."""
    shared = has & own
    near = np.zeros((len(points), len(has)))
    far = np.zeros_like(near) if farthest else None
    for c in np.flatnonzero(shared.any(axis=0)):
        at = np.flatnonzero(shared[:, c])
        at = slice(None) if len(at) == len(has) else at
        below, above = low[at, c] - points[:, c, None], points[:, c, None] - high[at, c]
        near[:, at] += np.maximum(np.maximum(below, above), 0) ** 2
        if farthest:
            far[:, at] += np.minimum(below, above) ** 2
    ratio = len(own) / shared.sum(axis=1)
    return near * ratio, far * ratio if farthest else None


def limits_of(found: pa.ListArray, lacking: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the k-th distance for each lacking column among the (c, d, cell) found, infinite where there are fewer; (row, cell) of what was searched."""
    row = pc.list_parent_indices(found).to_numpy(zero_copy_only=False)
    c, d, cell = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
    out = np.where(lacking, np.inf, -1.0)
    order = np.lexsort((d, c, row))
    key = (row * np.int64(lacking.shape[1]) + c)[order]
    head = np.flatnonzero(np.concatenate([[True], np.diff(key) > 0])) if len(key) else np.zeros(0, np.int64)
    last = order[np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key)))) == k - 1]
    out[row[last], c[last]] = d[last]
    return out, row, cell


def _nearest(rows: DataFrame, n: int, k: int) -> DataFrame:
    """(m, v, near): per incomplete vector the mean of the nearest values per missing column."""
    spark = rows.sparkSession
    ship_package(spark)
    same = W.partitionBy("m", "v").orderBy("k")
    donors = rows.filter(F.col("m").contains("1")).withColumn("_rn", F.row_number().over(same)).filter(F.col("_rn") <= k).select("m", "v", "k")
    donors = cut_lineage(donors)
    common = donors.groupBy("m").count().filter(F.col("count") >= max(1, CELL_ROWS // 4)).orderBy(F.col("count").desc(), "m").limit(MOST_PATTERNS).collect()
    sizes, total = {r["m"]: r["count"] for r in common}, max(1, sum(r["count"] for r in common))
    each = max(64, SAMPLE_ROWS // max(1, len(sizes)))
    pick = W.partitionBy("m").orderBy(F.xxhash64("k"), "k")
    known = donors.join(F.broadcast(spark.createDataFrame([(m,) for m in sizes], "m string")), "m", "left_semi")
    points: dict[str, list] = {}
    for r in known.withColumn("_rn", F.row_number().over(pick)).filter(F.col("_rn") <= each).select("m", "v").collect():
        points.setdefault(r["m"], []).append([x for x in r["v"] if x is not None])
    trees, first = {}, 0
    for m, p in sorted(points.items()):      # cells are numbered through; those of a tree lie in a row
        trees[m] = (first, Tree(np.array(p, float), min(-(-sizes[m] // CELL_ROWS), 1 + MOST_CELLS * sizes[m] // total)))
        first += len(trees[m][1].dim)

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, values = np.array(batch.column(0).to_pylist(), object), matrix(batch.column(1), n)
            cell = np.full(len(pattern), -1)
            for m in set(pattern) & set(trees):
                own = np.flatnonzero(pattern == m)
                base, tree = trees[m]
                cell[own] = base + tree.cell(values[own][:, pattern_bits(m)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    placed = cut_lineage(donors.mapInArrow(in_cells, T.StructType([*donors.schema.fields, T.StructField("cell", T.LongType())])))
    filled = placed.groupBy("cell").agg(F.count("*").alias("donors"))
    corners = placed.filter("cell >= 0").select("cell", "m", F.posexplode("v").alias("i", "x")).filter("x is not null")
    corners = corners.groupBy("cell", "m", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).orderBy("cell", "i").collect()      # n rows for each cell at most
    cells: dict[int, tuple] = {}
    for r in corners:
        has, low, high, _ = cells.setdefault(r["cell"], (pattern_bits(r["m"]), np.full(n, np.nan), np.full(n, np.nan), r["n"]))
        low[r["i"]], high[r["i"]] = r["lo"], r["hi"]
    shape = [np.array(list(x)).reshape(-1, n) for x in zip(*[c[:3] for c in cells.values()], strict=True)] if cells else [np.zeros((0, n), bool)] * 3
    boxes = Boxes(np.array(list(cells), np.int64), shape[0].astype(bool), shape[1].astype(float), shape[2].astype(float), np.array([c[3] for c in cells.values()], np.int64))
    unboxed = placed.filter("cell < 0").limit(1).count() > 0

    def by_pattern(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        has = ~np.isnan(values)
        for rows_of in alike(has):
            for own in np.array_split(rows_of, 1 + len(rows_of) // 2000):
                yield has[own[0]], own

    def to_likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(1), n)
            for has, own in by_pattern(values):
                who, where = boxes.likely(has, values[own], k)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(own[who])) for c in batch.columns[:2]], pa.array(where), pa.array(np.full(len(who), np.inf))], ["id", "v", "cell", "most"])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(1), n)
            limits, row, cell = limits_of(batch.column(2), np.isnan(values), k)
            done = np.unique(row * np.int64(first + 1) + cell)
            for has, own in by_pattern(values):
                who, where, most = boxes.within(has, values[own], limits[own])
                new = ~np.isin(own[who] * np.int64(first + 1) + where, done)
                who, where, most = who[new], where[new], most[new]
                if unboxed:
                    who, where, most = np.concatenate([who, np.arange(len(own))]), np.concatenate([where, np.full(len(own), -1)]), np.concatenate([most, limits[own].max(axis=1)])
                for a in range(0, len(who), 50_000):
                    at = pa.array(own[who[a:a + 50_000]])
                    yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:2]], pa.array(where[a:a + 50_000]), pa.array(most[a:a + 50_000])], ["id", "v", "cell", "most"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        own, donor, out = np.zeros((0, n)), np.zeros((0, n)), []
        if left.num_rows and right.num_rows:
            right = right.take(key_order(right.column("k").combine_chunks()))
            own, donor = (matrix(t.column("v").combine_chunks(), n) for t in (left, right))
            most = left.column("most").to_numpy()
            gives = alike(~np.isnan(donor))
            for i in alike(~np.isnan(own)):
                one, other = ~np.isnan(own[i[0]]), ~np.isnan(donor[gives[0][0]])
                both = one & other
                if len(gives) > 1:  # donors without boxes
                    p, d, s = nearest_of_all(own[i], one, donor, k, most[i])
                    out.append((i[p], d, s))
                elif both.any() and (other & ~one).any():
                    ratio = float(n) / both.sum()
                    p, d, s = nearest_in(own[i][:, both], donor[:, both], k, most[i] / ratio)
                    out.append((i[p], d, s * ratio))
        p, d, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at, c = np.nonzero(np.isnan(own[p]) & ~np.isnan(donor[d]))
        p, d, s = p[at], d[at], s[at]
        return pa.table([left.column("id").take(pa.array(p)), pa.array(c.astype(np.int32)), pa.array(s, pa.float64()), left.column("cell").take(pa.array(p)),
                         right.column("k").take(pa.array(d)), pa.array(donor[d, c], pa.float64())], ["id", "c", "d", "cell", "k", "value"])

    fields = T.StructType([*T.StructType.fromDDL("id long, c int, d double, cell long").fields, rows.schema["k"], *T.StructType.fromDDL("value double").fields])

    def searched(asking: DataFrame, route) -> DataFrame:
        """(id, c, d, cell, k, value): the nearest donors of each receiver, for each column it lacks, in each cell that it is sent to."""
        sent = cut_lineage(asking.mapInArrow(route, "id long, v array<double>, cell long, most double"))
        tasks = sent.groupBy("cell").agg(F.count("*").alias("asking")).join(filled, "cell").select(
            "cell", F.ceil(F.col("asking") / TASK_RECEIVERS).alias("a"), F.ceil(F.col("donors") / TASK_DONORS).alias("b"))
        asked = sent.join(tasks, "cell").select("id", "v", "cell", "most", F.pmod(F.xxhash64("id"), F.col("a")).alias("ta"), F.explode(F.expr("sequence(0L, b - 1)")).alias("tb"))
        dealt = placed.join(tasks, "cell").select("v", "k", "cell", F.explode(F.expr("sequence(0L, a - 1)")).alias("ta"), F.pmod(F.xxhash64("k"), F.col("b")).alias("tb"))
        cell = ["cell", "ta", "tb"]
        return asked.groupBy(*cell).cogroup(dealt.groupBy(*cell)).applyInArrow(search, fields)

    receivers = rows.filter(F.col("m").contains("0") & F.col("m").contains("1")).select("m", "v").distinct()
    receivers = cut_lineage(receivers.withColumn("id", F.monotonically_increasing_id()))
    likely = cut_lineage(searched(receivers.select("id", "v"), to_likely))
    found = likely.groupBy("id").agg(F.collect_list(F.struct("c", "d", "cell")).alias("found"))      # k for each column and cell at most
    others = searched(receivers.join(found, "id", "left").select("id", "v", "found"), to_others)
    near = likely.unionByName(others)
    best = near.withColumn("rn", F.row_number().over(W.partitionBy("id", "c").orderBy("d", "k"))).filter(F.col("rn") <= k)
    means = best.groupBy("id", "c").agg(F.avg("value").alias("mean"))
    named = means.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "mean"))).alias("near"))      # at most n entries
    return receivers.join(named, "id").select("m", "v", "near")


def alike(has: np.ndarray) -> list[np.ndarray]:
    """The rows of each pattern of present columns."""
    if not len(has):
        return []
    _, pattern = np.unique(np.packbits(has, axis=1), axis=0, return_inverse=True)
    order = np.argsort(pattern.ravel(), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(pattern.ravel()[order])) + 1)


def key_order(keys: pa.StructArray) -> pa.Array:
    """Positions in key order, nulls first, as Spark orders structs."""
    names = [f.name for f in keys.type]
    flat = pa.table(keys.flatten(), [f"f{i}" for i in range(len(names))])
    return pc.sort_indices(flat, [(f"f{i}", "ascending") for i in range(len(names))], null_placement="at_start")
