"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are turned into integers, and equal vectors become one point, so a
vector that repeats a million times is searched once; only the ``k + 1``
smallest ids of a point can ever be reported.

Queries and data are indexed alike. The points of a set are cut into cells by
the nearest of a few separated centres, large cells again by centres of their
own, until a cell is a block of bounded size. The centres of the first cut
come from a bounded sample on the driver, those of the others from a bounded
sample per cell. Blocks and the cells above them are the nodes of the upper
tree, each with a centre and a covering radius; a block is one row that holds
its points and is a cover tree of its own.

Pairs of nodes (query side, data side) go down both trees at once, level by
level, by joins with the nodes' children. A pair goes on if its bound

    <cq, cx> + Rq |cx| + Rx |cq| + Rq Rx

(centres c, covering radii R) reaches the worst k-th score among the queries
below it. These scores come from a first round, in which every query block
meets the few data blocks that promise most. The pairs of blocks that are left
are dealt in tiles, some query blocks by some data blocks, so that a block is
shipped once a tile and not once a pair. In a tile, data blocks come in order
of their bounds, and the same bound prunes pairs of nodes of the blocks' own
trees against k-th scores that rise as the tile goes on. The result is exact
whatever is pruned. ``pairs_met`` tells how many pairs were.

Vectors without clusters in many dimensions can't be pruned by any such bound;
then all pairs of blocks meet, as products of matrices.

Defined cases: null vectors, and vectors holding null or non-finite
components or of a length other than the most frequent, take no part; nor do
those with a component so large that a score need not be a long (beyond
sqrt(2^63 / length) after scaling); scores of the others are exact. Ties go to
the smaller id; rows with equal ids are separate candidates; a query without
candidates has no rows; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.spread import join_spread
from folioframe.session import materialize, table

K = 20
SCALE = 64
EVERY = 20
#: Centres of a cut at most, and points of the samples they are taken from.
PIVOTS, SAMPLE, CELL_SAMPLE = 64, 4096, 2048
#: Points of a block, points of a group while a cell is cut, and cuts at most.
BLOCK, QUERY_BLOCK, GROUP, DEPTH = 4096, 1024, 1 << 16, 8
LEAF = 128
#: Data nodes that each query node goes on with in the first round.
FIRST = 2
#: Blocks of either side in a tile.
TILE = 8
LOWEST = np.iinfo(np.int64).min
EXACT = float(1 << 53)


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null unless all are finite and scores fit.

    Scores are longs: a vector takes part if its product with itself is one, so
    that its product with any other that takes part is one too.
    """
    x = lambda v: v.cast("double") * scale
    whole = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float(2**62)))
    square = F.aggregate(embedding, F.lit(0.0), lambda s, v: s + F.pow(F.floor(x(v)).cast("double"), 2.0))
    return F.when(whole & (square < float(2**63 - 2**32)) & (F.size(embedding) > 0), F.transform(embedding, lambda v: F.floor(x(v)).cast("long")))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if q.shape[1] * most(q) * most(x) < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def net(x: np.ndarray, most: int, radius: float = 0.0) -> np.ndarray:
    """Rows that are centres: farthest first, more than ``radius`` apart, ``most`` at most; the first row is one."""
    chosen = [0]
    away = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max(initial=0.0) > radius * radius:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


class CoverTree:
    """A cover tree over the rows of a matrix, as flat lists.

    A node's centre is one of its rows, and its radius covers them. Its
    children's centres are a net of half its radius that begins with its own
    centre (nesting): they are more than half the radius apart (separation), and
    every row is within it of the nearest, whose child it joins (covering). A
    node is a leaf if it is small, or if its net would not be much smaller than
    itself, as in many dimensions.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.leaf = x, leaf
        self.order: list[np.ndarray] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self._node(np.arange(len(x)))
        todo = [0]
        while todo:
            todo += self._split(todo.pop())

    def _node(self, rows: np.ndarray) -> int:
        """A node over ``rows``, the first of which is its centre."""
        at = self.x[rows]
        self.order.append(rows)
        self.centre.append(at[0])
        self.radius.append(float(np.sqrt(((at - at[0]) ** 2).sum(axis=1)).max(initial=0.0)))
        self.children.append([])
        return len(self.radius) - 1

    def _split(self, node: int) -> list[int]:
        rows, half = self.order[node], self.radius[node] / 2
        if len(rows) <= self.leaf or half == 0:
            return []
        at = self.x[rows]
        most = max(2, len(rows) // self.leaf * 2)
        centres = net(at, most + 1, half)
        if len(centres) > most:
            return []
        owner = nearest(at, at[centres])
        owner[centres] = np.arange(len(centres))
        for c, first in enumerate(centres):
            mine = np.flatnonzero(owner == c)
            self.children[node].append(self._node(rows[np.concatenate([[first], mine[mine != first]])]))
        return self.children[node]


def bound(cq: np.ndarray, rq: float, cx: np.ndarray, rx: float) -> float:
    """The highest inner product between two balls, rounding included."""
    dot, nq, nx = float(cq @ cx), float(np.sqrt(cq @ cq)), float(np.sqrt(cx @ cx))
    most = dot + rq * nx + rx * nq + rq * rx
    return most + 1e-9 * (nq + rq) * (nx + rx) + 1e-6


class Best:
    """The ``k`` best (score, id, name) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.score, self.id, self.name = np.full((n, k), LOWEST), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1, np.int64)
        self.worst = floor.copy()

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, names: np.ndarray) -> None:
        """Scores of the queries ``rows`` with the data ``ids``."""
        hopeful = score >= self.worst[rows, None]
        if score.shape[1] > self.k and hopeful.sum() > 4 * self.k * len(rows):  # no more than the k best and their ties
            hopeful &= score >= np.partition(score, -self.k, axis=1)[:, -self.k, None]
        r, c = np.nonzero(hopeful)
        if not len(r):
            return
        touched = np.unique(r)
        mine = rows[touched]
        who = np.concatenate([np.repeat(mine, self.k), rows[r]])
        value = np.concatenate([self.score[mine].ravel(), score[r, c]])
        key = np.concatenate([self.id[mine].ravel(), ids[c]])
        name = np.concatenate([self.name[mine].ravel(), names[c]])
        order = np.lexsort((key, -value.astype(np.float64) if abs(value[value > LOWEST]).max(initial=0) < EXACT else np.where(value == LOWEST, np.iinfo(np.int64).max, -value), who))
        who, value, key, name = who[order], value[order], key[order], name[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        at = who[keep], place[keep]
        self.score[at], self.id[at], self.name[at] = value[keep], key[keep], name[keep]
        self.worst[mine] = np.maximum(self.worst[mine], self.score[mine, -1])


def dual_search(tq: CoverTree, tx: CoverTree, q: np.ndarray, x: np.ndarray, ids: np.ndarray, names: np.ndarray, best: Best) -> int:
    """Offers ``best`` whatever may still count; the number of scores that were computed."""
    met = 0
    limit = lambda a, b: bound(tq.centre[a], tq.radius[a], tx.centre[b], tx.radius[b])
    todo = [(limit(0, 0), 0, 0)]
    while todo:
        most, a, b = todo.pop()
        rows = tq.order[a]
        if most < best.worst[rows].min():
            continue
        qa, xb = tq.children[a], tx.children[b]
        if qa or xb:
            pairs = [(limit(c, d), c, d) for c in (qa or [a]) for d in (xb or [b])]
            todo += sorted(pairs, key=lambda p: p[0])  # the most promising pair is taken next
            continue
        other = tx.order[b]
        met += len(rows) * len(other)
        best.offer(rows, scores(q[rows], x[other]), ids[other], names[other])
    return met


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


POINT = "point long, first long, v array<long>, path array<int>"


def cells(points: DataFrame, size: int) -> DataFrame:
    """``points`` (``point``, ``first``, ``v``) with ``path`` and ``block``, of about ``size`` points at most."""
    n = points.count()
    #: the centres of the first cut: SAMPLE rows at most
    sample = np.array([r["v"] for r in points.orderBy(F.xxhash64("point")).limit(SAMPLE).select("v").collect()], np.float64)
    centres = sample[net(sample, _centres(n, size))] if len(sample) else sample

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = nearest(_matrix(batch.column(2), batch.num_rows).astype(np.float64), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at[:, None].astype(np.int32)), pa.list_(pa.int32()))], ["point", "first", "v", "path"])

    placed = materialize(points.select("point", "first", "v").mapInArrow(first, POINT), "topk-cells")
    for depth in range(1, DEPTH + 1):
        large = placed.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)
        if large.isEmpty():
            break
        if depth == DEPTH:  # points that no centres part: any cut is right
            counted = join_spread(placed, large, ["path"], "point", how="left")
            part = F.pmod(F.xxhash64("point"), F.ceil(F.col("_n") / size)).cast("int")
            placed = counted.withColumn("path", F.when(F.col("_n").isNotNull(), F.concat("path", F.array(part))).otherwise(F.col("path"))).drop("_n")
            break
        counted = materialize(join_spread(placed, large, ["path"], "point", how="left"), "topk-counted")
        placed = materialize(counted.filter("_n is null").drop("_n").unionByName(_cut(counted.filter("_n is not null"), large, size, depth)), "topk-cells")
    return placed.withColumn("block", F.array_join(F.col("path").cast("array<string>"), "."))


def _centres(n: int, size: int) -> int:
    return min(PIVOTS, max(2, -(-4 * n // size)))


def _cut(points: DataFrame, large: DataFrame, size: int, depth: int) -> DataFrame:
    """Every cell of ``points`` cut by centres of its own sample; paths grow by one."""
    drawn = points.filter(F.pmod(F.xxhash64("point", F.lit(depth)), F.ceil(F.col("_n") / CELL_SAMPLE)) == 0)

    def choose(rows: pa.Table) -> pa.Table:
        x = _matrix(rows.column("v"), rows.num_rows).astype(np.float64)
        found = x[net(x, _centres(int(rows.column("_n")[0].as_py()), size))]
        return pa.table({"path": pa.array([rows.column("path")[0].as_py()], pa.list_(pa.int32())), "centres": pa.array([found.tobytes()], pa.binary())})

    centres = drawn.select("path", "_n", "v").groupBy("path").applyInArrow(choose, "path array<int>, centres binary")
    n_salts = F.ceil(F.col("_n") / GROUP).cast("int")
    salted = points.withColumn("_salt", F.pmod(F.xxhash64("point"), n_salts).cast("int")).drop("_n")
    spread = large.select("path", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("_salt")).join(centres, "path")

    def place(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        paths = rows.column("path").to_pylist()
        at = [0] * len(paths)
        if chosen.num_rows and rows.num_rows:
            x = _matrix(rows.column("v"), rows.num_rows).astype(np.float64)
            at = nearest(x, np.frombuffer(chosen.column("centres")[0].as_py(), np.float64).reshape(-1, x.shape[1])).tolist()
        longer = pa.array([[*p, a] for p, a in zip(paths, at, strict=True)], pa.list_(pa.int32()))
        return pa.Table.from_arrays([rows.column("point"), rows.column("first"), rows.column("v"), longer], ["point", "first", "v", "path"])

    return salted.groupBy("path", "_salt").cogroup(spread.groupBy("path", "_salt")).applyInArrow(place, POINT)


BLOCKS = "block string, path array<int>, n int, centre array<double>, radius double, points binary, firsts binary, kind string, v binary"


def blocks_of(placed: DataFrame) -> DataFrame:
    """One row per block: its points in order of their numbers, its centre and radius."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("point")
        x = _matrix(rows.column("v"), rows.num_rows)
        kind = next(k for k in ("int16", "int32", "int64") if np.abs(x).max(initial=0) <= np.iinfo(k).max)
        centre = x.mean(axis=0)
        values = [
            rows.column("block")[0].as_py(), rows.column("path")[0].as_py(), rows.num_rows, centre.tolist(), float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()),
            rows.column("point").to_numpy().tobytes(), rows.column("first").to_numpy().tobytes(), kind, x.astype(kind).tobytes(),
        ]
        types = [pa.string(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["block", "path", "n", "centre", "radius", "points", "firsts", "kind", "v"])

    return placed.select("block", "path", "point", "first", "v").groupBy("block").applyInArrow(pack, BLOCKS)


def _levels(blocks: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes of each level, (``parent``, ``node``, ``centre``, ``radius``); the last level is the blocks.

    A cell's centre is that of its largest block, its radius covers its blocks' balls.
    """
    name = lambda k: F.array_join(F.slice("path", 1, k).cast("array<string>"), ".")
    away = F.sqrt(F.aggregate(F.zip_with("centre", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, d: a + d))
    found = []
    for k in range(1, depth):
        named = blocks.select(name(k).alias("node"), name(k - 1).alias("parent"), "centre", "radius", "n")
        lead = named.groupBy("node").agg(F.max_by("centre", "n").alias("_c"))
        found.append(materialize(named.join(lead, "node").groupBy("node").agg(F.first("parent").alias("parent"), F.first("_c").alias("centre"), F.max(away + F.col("radius")).alias("radius")), "topk-level"))
    found.append(blocks.select(F.col("block").alias("node"), name(depth - 1).alias("parent"), "centre", "radius"))
    return found


def _go_down(q: list[DataFrame], x: list[DataFrame], floors: list[DataFrame] | None) -> DataFrame:
    """Pairs of blocks (``qb``, ``xb``, ``most``): the ``FIRST`` most promising of each query node, or all whose bound reaches its floor."""
    pairs = None
    for level in range(len(q)):
        a = q[level].select(F.col("parent").alias("_qp"), F.col("node").alias("qb"), F.col("centre").alias("qc"), F.col("radius").alias("qr"))
        b = x[level].select(F.col("parent").alias("_xp"), F.col("node").alias("xb"), F.col("centre").alias("xc"), F.col("radius").alias("xr"))
        #: the nodes of the first level have one parent; they are PIVOTS at most
        met = a.join(b, F.col("_qp") == F.col("_xp")) if pairs is None else pairs.join(a, "_qp").join(b, "_xp")
        dot = F.aggregate(F.zip_with("qc", "xc", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, t: s + t * t))
        slack = 1e-9 * (norm("qc") + F.col("qr")) * (norm("xc") + F.col("xr")) + 1e-6
        met = met.select("qb", "xb", dot.alias("middle"), (dot + F.col("qr") * norm("xc") + F.col("xr") * norm("qc") + F.col("qr") * F.col("xr") + slack).alias("most"))
        if floors is None:
            promise = Window.partitionBy("qb").orderBy(F.desc("middle"), "xb")
            met = met.withColumn("_r", F.row_number().over(promise)).filter(F.col("_r") <= FIRST).drop("_r")
        else:
            met = met.join(floors[level], "qb").filter("most >= floor")
        met = materialize(met.select("qb", "xb", "most"), "topk-pairs")
        pairs = met.select(F.col("qb").alias("_qp"), F.col("xb").alias("_xp"))
    return met


FOUND = "point long, other long, first long, score long, met long"


def _search(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int, tiles: tuple[int, int]) -> DataFrame:
    """Best ``k`` of each query in each tile: (``point``, ``other``, ``first``, ``score``, ``met``).

    ``queries`` has ``f_points`` and ``f_worst``, scores that queries are known to reach, or nulls.
    ``met``, in one row of a pair of blocks with results, counts the scores computed.
    """
    dealt = pairs.withColumns({"ti": F.pmod(F.xxhash64("qb"), F.lit(tiles[0])), "tj": F.pmod(F.xxhash64("xb"), F.lit(tiles[1]))})
    x = dealt.groupBy("ti", "tj", "xb").agg(F.collect_list(F.struct("qb", "most")).alias("asks")).join(data.select(F.col("block").alias("xb"), "points", "firsts", "kind", "v"), "xb")
    q = dealt.select(F.col("ti").alias("qi"), F.col("tj").alias("qj"), "qb").distinct().join(queries.select(F.col("block").alias("qb"), "points", "kind", "v", "f_points", "f_worst"), "qb")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        block = lambda r: np.frombuffer(r["v"], r["kind"]).astype(np.int64).reshape(len(r["points"]) // 8, -1)
        found = [(np.frombuffer(r["points"], np.int64), np.frombuffer(r["firsts"], np.int64), block(r), {a["qb"]: a["most"] for a in r["asks"]}) for r in right.to_pylist()]
        trees = [CoverTree(m.astype(np.float64)) for _, _, m, _ in found]
        for r in left.to_pylist():
            points, m = np.frombuffer(r["points"], np.int64), block(r)
            floor = np.full(len(points), LOWEST)
            if r["f_points"] is not None:
                floor[np.searchsorted(points, np.frombuffer(r["f_points"], np.int64))] = np.frombuffer(r["f_worst"], np.int64)
            best, tree, met = Best(len(points), k, floor), CoverTree(m.astype(np.float64)), 0
            asked = [(-asks[r["qb"]], i) for i, (_, _, _, asks) in enumerate(found) if r["qb"] in asks]
            for most, i in sorted(asked):
                if -most < best.worst.min():
                    break
                names, firsts, x_, _ = found[i]
                met += dual_search(tree, trees[i], m, x_, firsts, names, best)
            a, b = np.nonzero((best.name >= 0) & (best.score >= floor[:, None]))
            counted = np.zeros(len(a), np.int64)
            counted[:1] = met
            for column, values in zip(out, (points[a], best.name[a, b], best.id[a, b], best.score[a, b], counted), strict=True):
                column.append(values)
        arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
        return pa.Table.from_arrays(arrays, ["point", "other", "first", "score", "met"])

    return q.groupBy("qi", "qj").cogroup(x.groupBy("ti", "tj")).applyInArrow(meet, FOUND)


def _floors(kth: DataFrame, placed: DataFrame) -> DataFrame:
    """Per query block ``f_points`` and ``f_worst``, packed, and ``known``, their number, and ``floor``, the least."""

    def pack(rows: pa.Table) -> pa.Table:
        worst = rows.column("worst").to_numpy()
        values = [rows.column("block")[0].as_py(), rows.column("point").to_numpy().tobytes(), worst.tobytes(), len(worst), float(worst.min())]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.float64()], strict=True)], ["block", "f_points", "f_worst", "known", "floor"])

    return kth.join(placed.select("point", "block"), "point").groupBy("block").applyInArrow(pack, "block string, f_points binary, f_worst binary, known int, floor double")


def search_points(points: DataFrame, k: int) -> DataFrame:
    """The ``k`` best points of each point that asks, its own included: (``point``, ``other``, ``first``, ``score``, ``met``).

    ``points`` has ``point``, ``first``, ``v`` and ``ask``.
    """
    lowest = F.lit(float("-inf"))
    data, asking = materialize(blocks_of(cells(points, BLOCK)), "topk-data"), materialize(cells(points.filter("ask"), QUERY_BLOCK), "topk-asking")
    queries = materialize(blocks_of(asking), "topk-queries")
    size = {n: d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path")).alias("depth")).first() for n, d in (("q", queries), ("x", data))}
    depth = max(size["q"]["depth"] or 1, size["x"]["depth"] or 1)
    q, x = _levels(queries, depth), _levels(data, depth)
    #: enough tiles for every core, of TILE blocks by TILE blocks at most
    cores = points.sparkSession.sparkContext.defaultParallelism
    ti = -(-size["q"]["n"] // TILE)
    tj = max(-(-size["x"]["n"] // TILE), min(size["x"]["n"], -(-2 * cores // max(1, ti))), 1)
    tiles = (max(1, ti), tj)
    chosen = _go_down(q, x, None)
    plain = queries.withColumns({"f_points": F.lit(None).cast("binary"), "f_worst": F.lit(None).cast("binary")})
    found = materialize(_search(chosen, plain, data, k, tiles), "topk-first")
    #: a query's k-th score so far, its own vector left out; a point counts once
    place = Window.partitionBy("point").orderBy(F.desc("score"), "first")
    kth = found.filter("point <> other").withColumn("r", F.row_number().over(place)).filter(F.col("r") == k - 1).select("point", F.col("score").alias("worst"))
    floors = _floors(kth, asking)
    armed = materialize(queries.join(floors, "block", "left").withColumn("floor", F.when(F.col("known") == F.col("n"), F.col("floor")).otherwise(lowest)), "topk-armed")
    name = lambda level: F.col("block") if level == depth - 1 else F.array_join(F.slice("path", 1, level + 1).cast("array<string>"), ".")
    least = [armed.groupBy(name(level).alias("qb")).agg(F.min("floor").alias("floor")) for level in range(depth)]
    rest = _go_down(q, x, least).join(chosen.select("qb", "xb"), ["qb", "xb"], "left_anti")
    return found.unionByName(_search(rest, armed, data, k, tiles))


def pairs_met(vectors: DataFrame, **options: object) -> tuple[int, int]:
    """Scores that the search computes, and those of all pairs of asking and data points."""
    points = _points(_rows(vectors, **options))
    n = points.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ask").cast("long")).alias("q")).first()
    return int(search_points(points, K + 1).agg(F.sum("met").alias("m")).first()["m"]), n["n"] * n["q"]


def _rows(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", is_query: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(``id``, ``ask``, ``v``, ``h``, ``g``) of the usable rows; two digests tell vectors apart."""
    is_query = F.col(vec_id) % EVERY == 0 if is_query is None else is_query
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("ask"), quantised(F.col(embedding), scale).alias("v")).filter("id is not null and v is not null")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    rows = rows.join(F.broadcast(length.select("d")), F.size("v") == F.col("d"), "left_semi")
    return materialize(rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(7), "v")}), "topk-rows")


def _points(rows: DataFrame) -> DataFrame:
    points = rows.groupBy("h", "g").agg(F.first("v").alias("v"), F.max("ask").alias("ask"), F.min("id").alias("first"))
    return materialize(points.withColumn("point", F.monotonically_increasing_id()), "topk-points")


def top_k(vectors: DataFrame, *, k: int = K, **options: object) -> DataFrame:
    """Rows (``query_id``, ``rank``, ``vec_id``, ``score``) for the rows where ``is_query``.

    Options: ``vec_id``, ``embedding``, ``is_query`` (a condition) and ``scale``.
    """
    rows = _rows(vectors, **options)
    points = _points(rows)
    named = points.select("h", "g", "point")
    #: the ids that a point can report: the k + 1 smallest; ranks are limited before and after the shuffle
    near = Window.partitionBy("h", "g", "salt").orderBy("id")
    every = Window.partitionBy("h", "g").orderBy("id")
    ids = rows.select("h", "g", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    ids = ids.withColumn("r", F.row_number().over(every)).filter(F.col("r") <= k + 1).join(named, ["h", "g"]).select(F.col("point").alias("other"), "id")
    #: the best k + 1 points hold the best k rows other than the query's own
    place = Window.partitionBy("point").orderBy(F.desc("score"), "first")
    best = search_points(points, k + 1).withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k + 1).select("point", "other", "score")
    reported = join_spread(materialize(best, "topk-best"), ids, ["other"], "point").select("point", "id", "score")
    ranked = reported.withColumn("r", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    lists = ranked.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best")).join(named, "point").drop("point")
    asked = join_spread(rows.filter("ask").select("h", "g", F.col("id").alias("query_id")), lists, ["h", "g"], "query_id")
    #: a query's own row goes; among rows of equal id only one does
    own = F.array_position(F.transform("best", lambda b: b["id"]), F.col("query_id")).cast("int")
    others = F.slice(F.when(own > 0, F.concat(F.slice("best", F.lit(1), own - 1), F.slice("best", own + 1, F.lit(k + 1)))).otherwise(F.col("best")), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def op2_top_k(spark, sf_dir):
    """The 20 best partners of every 20th vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
