"""Duplicate removal."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cells
from ..functions.columns import column
from ..functions.geo import rounded_key
from ..session import cut_lineage, ship_package
from .groups import components

EVENT_KEY = ["datetime", "crime_type"]


def drop_exact(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; combined before the shuffle."""
    return df.dropDuplicates()


def drop_near(df: DataFrame, order_by: list[str], keys: list[str] = EVENT_KEY, lat: str = "latitude",
              lon: str = "longitude", digits: int = 4) -> DataFrame:
    """The first row per (keys, rounded coordinates); nulls equal each other.

    Equal rows share the key, so this also removes exact copies. The ranking
    filter keeps one row per key and task before the shuffle, so a key held by a
    third of all rows arrives as one row per task.
    """
    key = W.partitionBy(*keys, rounded_key(F.col(lat), digits), rounded_key(F.col(lon), digits))
    return df.withColumn("_rn", F.row_number().over(key.orderBy(*order_by))).filter("_rn = 1").drop("_rn")


def first_per_id(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """The first row of every id."""
    at = W.partitionBy(key).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(at)).filter("_rn = 1").drop("_rn")


# salts that meet in one group of the next level
FAN_IN = 64


def first_k_per(df: DataFrame, key: str, k: int, order_by: list[str]) -> DataFrame:
    """At most ``k`` rows per key, in order.

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark's ranking filter prunes each task's rows before the shuffle. For larger
    ``k`` the rows of a key are first ranked within salts, four for each core of the application, and the salts
    then meet by ``FAN_IN``: the first k of a key are among the first k of each part, so no task
    sorts more than its share of a key or FAN_IN * k rows.
    """
    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        at = W.partitionBy(*by).orderBy(*order_by)
        return rows.withColumn("_rn", F.row_number().over(at)).filter(F.col("_rn") <= k).drop("_rn")

    spark = df.sparkSession
    if k > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salts = 4 * spark.sparkContext.defaultParallelism
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(salts)))
        while salts > 1:
            df = ranked(df, key, "_salt").withColumn("_salt", F.floor(F.col("_salt") / FAN_IN))
            salts = -(-salts // FAN_IN)
        df = df.drop("_salt")
    return ranked(df, key)


BOX = ["south", "north", "west", "east", "first", "last"]


def _boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """Bounds and number of the different points of each block."""
    return points.groupBy(*by).agg(F.min("y").alias("south"), F.max("y").alias("north"), F.min("x").alias("west"), F.max("x").alias("east"),
                                   F.min("s").alias("first"), F.max("s").alias("last"), F.count(F.lit(1)).alias("n"))


def _gaps(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> tuple[Column, Column]:
    """Least and greatest difference of two numbers from two ranges."""
    return F.greatest(low_b - high_a, low_a - high_b, F.lit(0.0)), F.greatest(high_b - low_a, high_a - low_b)


def _verdict(km: float, seconds: float) -> Column:
    """Whether boxes a and b are linked (true: every two of their points are), apart (false: no two are), or open (null).

    Differences are intervals; the distance grows with the differences of both coordinates and with both cosines.
    """
    def ends(side: str) -> list[Column]:
        return [F.col(f"{side}.{c}") for c in BOX]

    (s1, n1, w1, e1, f1, l1), (s2, n2, w2, e2, f2, l2) = ends("a"), ends("b")
    dy, dx, dt = _gaps(s1, n1, s2, n2), _gaps(w1, e1, w2, e2), _gaps(f1, l1, f2, l2)
    short = [F.least(d, 360 - d) for d in dx]  # the way round the date line
    most = F.when((dx[0] <= 180) & (dx[1] >= 180), F.lit(180.0)).otherwise(F.greatest(*short))

    def cosine(south: Column, north: Column, largest: bool) -> Column:
        ends_ = F.cos(F.radians(south)), F.cos(F.radians(north))
        return F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(*ends_)) if largest else F.least(*ends_)

    limit = math.sin(km / cells.EARTH_KM / 2) ** 2
    near = cells.haversine(dy[0], F.least(*short), cosine(s1, n1, False), cosine(s2, n2, False)) <= limit
    far = cells.haversine(dy[1], most, cosine(s1, n1, True), cosine(s2, n2, True)) <= limit
    return F.when(far & (dt[1] <= seconds), True).when(~near | (dt[0] > seconds), False)


ENDS = [f"at_{c}" for c in BOX]
#: Cells of a block: bands, places of a band and spans of time, as powers of two.
BANDS, PLACES, SPANS = 3, 3, 4
#: Cell to root in the cell's own block, cell to root in another block, open pair of cells.
HOME, OUTSIDE, OPEN = 0, 1, 2
#: Pairs of cells that a task compares at once.
MOST_PAIRS = 1 << 19


def _in_blocks(own: DataFrame, km: float, h: float) -> DataFrame:
    """Each cell, with the points at its ends, in its own block and in those of higher number that hold cells within its reach, so that near cells meet once at least."""
    def block(place: Column, time: Column) -> list[Column]:
        band, at = F.shiftright(F.shiftright(place, 32), BANDS), F.shiftright(place.bitwiseAND(F.lit((1 << 32) - 1)), PLACES)
        return [(band * F.lit(1 << 32) + at).alias("p"), F.shiftright(time, SPANS).alias("t")]

    around = cells.cover(F.col("south"), F.col("north"), F.col("west"), F.col("east"), F.lit(float(km)), h)
    places = F.array_distinct(F.transform(around, lambda place: block(place, F.lit(0).cast("long"))[0]))
    spans = F.array_distinct(F.transform(F.array(*[F.col("cell.time") + d for d in (-1, 0, 1)]), lambda time: F.shiftright(time, SPANS)))
    home = F.struct(*block(F.col("cell.place"), F.col("cell.time")))
    each = own.withColumn("home", home).withColumn("p", F.explode(places)).withColumn("t", F.explode(spans)).withColumn("at", F.struct("p", "t"))
    return each.filter("at >= home").select(F.xxhash64("cell.key", "p", "t").alias("block"), F.xxhash64(F.lit(1), "cell.key").alias("mark"), F.col("cell.time").alias("time"),
                                            "id", (F.col("at") == F.col("home")).alias("home"), *BOX, *[F.col(end)[c].alias(f"{end}_{c}") for end in ENDS for c in "yxs"])


def _cells(points: DataFrame) -> DataFrame:
    """(cell, id, box, n) of cells that hold points, with the six points that bound the box."""
    ends = [f(F.struct(*by)).alias(end) for end, f, by in zip(ENDS, [F.min, F.max] * 3, ["yxs", "yxs", "xys", "xys", "syx", "syx"], strict=True)]
    each = points.groupBy("cell").agg(*ends, F.count(F.lit(1)).alias("n"))
    return each.select("cell", "n", F.monotonically_increasing_id().alias("id"), *ENDS, *[F.col(end)[by].alias(c) for end, by, c in zip(ENDS, "yyxxss", BOX, strict=True)])


def _tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each node reaches by the links and by its root so far."""
    root = root.copy()
    while len(a):
        u, v = root[a], root[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _judge(box: np.ndarray, i: np.ndarray, j: np.ndarray, km: float, seconds: float) -> tuple[np.ndarray, np.ndarray]:
    """``_verdict`` of pairs of boxes: linked, and open; a distance that rounding could decide is open."""
    (s1, n1, w1, e1, f1, l1), (s2, n2, w2, e2, f2, l2) = box[:, i], box[:, j]

    def gaps(low_a, high_a, low_b, high_b):
        return np.maximum(np.maximum(low_b - high_a, low_a - high_b), 0.0), np.maximum(high_b - low_a, high_a - low_b)

    def cosine(south, north, largest):
        ends = np.cos(np.radians(south)), np.cos(np.radians(north))
        return np.where((south <= 0) & (north >= 0), 1.0, np.maximum(*ends)) if largest else np.minimum(*ends)

    def haversine(dlat, dlon, largest):
        return np.sin(np.radians(dlat) / 2) ** 2 + cosine(s1, n1, largest) * cosine(s2, n2, largest) * np.sin(np.radians(dlon) / 2) ** 2

    dy, dx, dt = gaps(s1, n1, s2, n2), gaps(w1, e1, w2, e2), gaps(f1, l1, f2, l2)
    short = [np.minimum(d, 360 - d) for d in dx]
    most = np.where((dx[0] <= 180) & (dx[1] >= 180), 180.0, np.maximum(*short))
    limit, slack = math.sin(km / cells.EARTH_KM / 2) ** 2, cells.SLACK - 1
    linked = (haversine(dy[1], most, True) <= limit * (1 - slack)) & (dt[1] <= seconds)
    apart = (haversine(dy[0], np.minimum(*short), False) > limit * (1 + slack)) | (dt[0] > seconds)
    return linked, ~linked & ~apart


def _near_ends(ends: np.ndarray, i: np.ndarray, j: np.ndarray, km: float, seconds: float) -> np.ndarray:
    """Whether points ``ends[0, :, i]`` and ``ends[1, :, j]`` are linked, beyond what rounding could decide."""
    (y1, x1, s1), (y2, x2, s2) = ends[0][:, i], ends[1][:, j]
    dx = np.abs(x1 - x2)
    h = np.sin(np.radians(y1 - y2) / 2) ** 2 + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.sin(np.radians(np.minimum(dx, 360 - dx)) / 2) ** 2
    return (h <= math.sin(km / cells.EARTH_KM / 2) ** 2 * (2 - cells.SLACK)) & (np.abs(s1 - s2) <= seconds)


def _meet(km: float, seconds: float):
    """Arrow function over cells sorted by block and time: (kind, u, v), the roots of the cells in their blocks and the open pairs between different roots.

    An open pair is linked if two of the points at the ends of its cells are.
    """
    def whole(block, mark, time, cell, home, box, ends) -> Iterator[pa.RecordBatch]:
        n = len(block)
        new = np.concatenate([[True], block[1:] != block[:-1]])
        number = np.cumsum(new) - 1
        order = np.cumsum(np.where(new, 2, np.minimum(np.diff(time, prepend=time[0]), 2)))  # one more for the next span, two for any other
        many = np.searchsorted(order, order + 1, "right") - np.arange(n) - 1
        before = np.concatenate([[0], np.cumsum(many)])
        joined, doubtful, first = [], [], 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(before, before[first] + MOST_PAIRS, "right")) - 1)
            i = np.repeat(np.arange(first, last), many[first:last])
            j = np.arange(before[first], before[last]) - before[i] + i + 1
            near = (mark[i] == mark[j]) & (number[i] == number[j])
            near &= np.maximum(box[0, i] - box[1, j], box[0, j] - box[1, i]) <= math.degrees(km / cells.EARTH_KM) * cells.SLACK
            i, j = i[near], j[near]
            linked, open_ = _judge(box, i, j, km, seconds)
            joined.append((i[linked], j[linked]))
            doubtful.append((i[open_], j[open_]))
            first = last
        root = _tie(np.arange(n), *(np.concatenate(x) for x in zip(*joined, strict=True)))
        u, v = (np.concatenate(x) for x in zip(*doubtful, strict=True))
        for a, b in sorted(itertools.product(range(6), repeat=2), key=lambda ab: ab[0] ^ ab[1] != 1):  # facing ends first
            apart = root[u] != root[v]
            u, v = u[apart], v[apart]
            if len(u):
                near = _near_ends(ends[[a, b]], u, v, km, seconds)
                root = _tie(root, u[near], v[near])
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
        away = root != np.arange(n)
        tied = away.copy()
        tied[root[away]] = True  # all cells of groups of two and more
        at_home, outside = np.flatnonzero(home & away), np.flatnonzero(~home & tied)
        # an own cell that is the root, or is alone, is its own root; a root that is not at home is told to its own block
        kinds = np.repeat(np.array([HOME, OUTSIDE, OPEN], np.int32), [len(at_home), len(outside), len(u)])
        left = np.concatenate([cell[at_home], cell[outside], np.minimum(cell[u], cell[v])])
        right = np.concatenate([cell[root[at_home]], cell[root[outside]], np.maximum(cell[u], cell[v])])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(left), pa.array(right)], ["kind", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = [*columns[:5], np.stack(columns[5:11]), np.stack(columns[11:]).reshape(6, 3, -1)]
            now = now if rest is None else [np.concatenate(x, axis=-1) for x in zip(rest, now, strict=True)]
            last = int(np.flatnonzero(now[0] != now[0][-1])[-1] + 1) if now[0][0] != now[0][-1] else 0
            if last:
                yield from whole(*(x[..., :last] for x in now))
            rest = [x[..., last:] for x in now]
        if rest is not None:
            yield from whole(*rest)

    return run


def near_groups(df: DataFrame, km: float, seconds: float, keys: list[str] = ["crime_type"], at: str = "datetime", lat: str = "latitude", lon: str = "longitude",
                small: int = 1_024) -> DataFrame:
    """(keys, latitude, longitude, seconds, group) of the different places and times: ``group`` is equal where steps of at most ``km`` and ``seconds`` lead from one to the other.

    Space and time are cut into cells so small that any two points of one cell are linked; so the nodes are cells. Cells meet in blocks of neighbouring cells, where
    their boxes and the points that bound them decide most pairs. A block gives one link a cell, not one a pair, and its groups are joined over the cells at the edges.
    Only pairs left open whose cells no other link joins are divided into eighths, whose boxes decide again, down to single points. Pairs of at
    most ``small`` point pairs are compared point by point. So a cell that holds a third of all rows is never compared point with point.
    """
    if not 0 < km <= 500 or seconds < 0:
        raise ValueError("km must be above 0 and at most 500, seconds not negative")
    h, span = cells.height(km) / math.sqrt(2.0) * 0.999, max(float(seconds), 1e-6)
    y, x, s = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double"), F.unix_micros(F.col(f"`{at}`").cast("timestamp")) / 1e6
    points = df.filter(cells.on_globe(y, x) & s.isNotNull()).select(F.struct(*[column(k) for k in keys]).alias("key"), y.alias("y"), x.alias("x"), s.alias("s")).distinct()
    parts = [F.col("key"), cells.cell_of(F.col("y"), F.col("x"), h).alias("place"), F.floor(F.col("s") / span).alias("time")]
    points = cut_lineage(points.select(F.struct(*parts).alias("cell"), "y", "x", "s"))
    own = cut_lineage(_cells(points))
    ship_package(df.sparkSession)
    dealt = _in_blocks(own, km, h).repartition("block").sortWithinPartitions("block", "time")
    met = cut_lineage(dealt.mapInArrow(_meet(km, seconds), "kind int, u long, v long"))
    at_home, outside = (met.filter(F.col("kind") == kind).select(F.col("u").alias("id"), "v") for kind in (HOME, OUTSIDE))
    across = outside.join(at_home.withColumnRenamed("v", "own"), "id", "left").select(F.col("v").alias("u"), F.coalesce("own", "id").alias("v"))
    over = components(across).withColumnRenamed("node", "v").withColumnRenamed("root", "top")
    named = own.select("cell", "id", "n").join(at_home, "id", "left").withColumn("v", F.coalesce("v", "id")).join(over, "v", "left")
    named = cut_lineage(named.select("cell", "id", "n", F.coalesce("top", "v").alias("group")))
    # pairs that the boxes leave open, of cells that nothing else joins
    left, right = (named.select(F.col("id").alias(c), F.struct("n").alias(c_), F.col("group").alias(f"group_{c}")) for c, c_ in (("u", "a"), ("v", "b")))
    deeper = met.filter(F.col("kind") == OPEN).select("u", "v").distinct().join(left, "u").join(right, "v").filter("group_u <> group_v")
    deeper = cut_lineage(deeper.select("u", "v", F.lit(0).alias("a_block"), F.lit(0).alias("b_block"), "a", "b"))
    links = deeper.select("u", "v").limit(0)
    doubtful = deeper.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    parts_of = points.join(named.join(doubtful, "id", "left_semi").select("cell", "id"), "cell").select(F.col("id").alias("cell"), "y", "x", "s", F.lit(0).alias("block"))
    while not deeper.isEmpty():
        few = deeper.filter(F.col("a.n") * F.col("b.n") <= small).select("u", "v", "a_block", "b_block")
        left, right = (parts_of.select(F.col("cell").alias(c), F.col("block").alias(f"{side}_block"), F.struct(*[F.col(p).alias(p) for p in "yxs"]).alias(side)) for c, side in (("u", "a"), ("v", "b")))
        both = few.join(left, ["u", "a_block"]).join(right, ["v", "b_block"])
        exact = both.filter((cells.distance_km(F.col("a.y"), F.col("a.x"), F.col("b.y"), F.col("b.x")) <= km) & (F.abs(F.col("a.s") - F.col("b.s")) <= seconds)).select("u", "v")
        links = cut_lineage(links.unionByName(exact).distinct())
        many = deeper.filter(F.col("a.n") * F.col("b.n") > small).join(links, ["u", "v"], "left_anti")
        many = cut_lineage(many.select("u", "v", "a_block", "b_block"))
        if many.isEmpty():
            break
        # each block goes into eighths at the middle of its box; a box that is one point is never open
        wanted = many.select(F.explode(F.array(F.struct(F.col("u").alias("cell"), F.col("a_block").alias("block")), F.struct(F.col("v").alias("cell"), F.col("b_block").alias("block")))).alias("w")).select("w.*").distinct()
        left_over = parts_of.join(wanted, ["cell", "block"], "left_semi")
        middle = _boxes(left_over, ["cell", "block"]).select("cell", "block", *[((F.col(a) + F.col(b)) / 2).alias(m) for a, b, m in (("south", "north", "my"), ("west", "east", "mx"), ("first", "last", "ms"))])
        eighth = sum((F.when(F.col(p) > F.col(f"m{p}"), 1 << k).otherwise(0) for k, p in enumerate("yxs")), F.lit(0))
        halved = left_over.join(middle, ["cell", "block"]).select("cell", F.col("block").alias("parent"), F.xxhash64("block", eighth).alias("block"), "y", "x", "s")
        halved = cut_lineage(halved)
        boxes = cut_lineage(_boxes(halved, ["cell", "parent", "block"]))
        box = F.struct(*BOX, "n")
        left, right = (boxes.select(F.col("cell").alias(c), F.col("parent").alias(f"{side}_block"), F.col("block").alias(f"{side}_new"), box.alias(side)) for c, side in (("u", "a"), ("v", "b")))
        judged = many.join(left, ["u", "a_block"]).join(right, ["v", "b_block"]).withColumn("linked", _verdict(km, seconds))
        judged = cut_lineage(judged.select("u", "v", F.col("a_new").alias("a_block"), F.col("b_new").alias("b_block"), "a", "b", "linked"))
        links = links.unionByName(judged.filter("linked").select("u", "v")).distinct()
        deeper, parts_of = judged.filter("linked is null").join(links, ["u", "v"], "left_anti"), halved.drop("parent")
    group = named.select("id", "group")
    tied = links.join(group.withColumnRenamed("group", "gu"), F.col("u") == F.col("id")).drop("id").join(group.withColumnRenamed("group", "gv"), F.col("v") == F.col("id"))
    roots = components(tied.select(F.col("gu").alias("u"), F.col("gv").alias("v"))).withColumnRenamed("node", "group")
    final = named.join(roots, "group", "left").select("cell", F.coalesce("root", "group").alias("group"))
    return points.join(final, "cell").select(F.col("cell.key").alias("key"), "y", "x", "s", "group")


def drop_within(df: DataFrame, km: float, seconds: float, order_by: list[str], keys: list[str] = ["crime_type"], at: str = "datetime", lat: str = "latitude",
                lon: str = "longitude") -> DataFrame:
    """The first row by ``order_by`` of each group of rows with equal ``keys`` (nulls are equal) joined by steps of at most ``km`` and ``seconds``.

    Unlike rounding, this does not part neighbours at the edge of a cell. Rows without a place on the globe or a time stay as they are. Rows equal in ``order_by``
    must be told apart by it, or one of them is taken.
    """
    groups = near_groups(df, km, seconds, keys, at, lat, lon)
    y, x, s = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double"), F.unix_micros(F.col(f"`{at}`").cast("timestamp")) / 1e6
    rows = df.select(F.struct(*[column(c) for c in df.columns]).alias("row"), F.struct(*[column(k) for k in keys]).alias("key"), y.alias("y"), x.alias("x"), s.alias("s"))
    known = cells.on_globe(F.col("y"), F.col("x")) & F.col("s").isNotNull()
    placed = rows.filter(known).join(groups.withColumnRenamed("key", "k").withColumn("kh", F.xxhash64("k")).withColumnRenamed("group", "g"),
                                     (F.xxhash64("key") == F.col("kh")) & F.col("key").eqNullSafe(F.col("k")) & (rows["y"] == groups["y"]) & (rows["x"] == groups["x"]) & (rows["s"] == groups["s"]))
    first = placed.select("row", "g").withColumn("_rn", F.row_number().over(W.partitionBy("g").orderBy(*[F.col(f"row.{c}") for c in order_by]))).filter("_rn = 1")
    return first.select("row.*").unionByName(rows.filter(~known).select("row.*"))
