"""Exact top-k search by inner product, with multi-resolution segment statistics.

Vectors are turned so that their first axes carry most of the energy of a sample, and dealt to cells
around pivots, of which each is cut into blocks. For a vector cut into segments of width w, the inner
product of two vectors is at most the sum of w * (mean * mean + deviation * deviation) over the
segments (the lower bound on their distance that segment means and deviations give, turned round).
Four steps, coarse to fine:

1. Each query is scored exactly against its own block, which gives a threshold: its k-th best score
   so far.
2. For each cell the least and greatest means and the greatest deviations of its vectors bound the
   scores that a query can have there. A query goes on only to cells whose bound reaches its threshold.
3. In a block, pairs are bounded by their own segments, at one resolution after the other.
4. What survives is scored exactly. The best rows of each query are merged over all blocks.

How much is passed over depends on the data: on clustered vectors nearly everything, on vectors
without any structure nothing, as then no bound that is cheaper than the score tells them apart.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import pick, sized, stored

if TYPE_CHECKING:
    import numpy as np

#: Most rows of a block of candidates and of queries that meet, and queries that a task takes at a time.
CANDIDATES, QUERIES, TILE = 8_192, 4_096, 128
#: Numbers of segments, coarse to fine.
RESOLUTIONS = (4, 16, 32)
#: Share of a tile's pairs up to which survivors are worked out one by one.
FEW = 0.1
#: Vectors from which axes and pivots are taken (any give the same results), most pivots, widest vectors whose axes are turned.
SAMPLE, MOST_CELLS, MOST_WIDTH = 4_096, 1_024, 1_024
LONG = (1 << 63) - 1
_FOUND = "query_id long, row long, vec_id long, score long"


def _clean(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """The rows whose vectors are complete and finite, with components floor(scale * x)."""
    import numpy as np

    for b in batches:
        keys, kept, vectors = b.column(0).to_pylist(), [], []
        for key, v in zip(keys, b.column(1), strict=True):
            if key is None or not v.is_valid or v.values is None or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
            if np.isfinite(x).all():
                kept.append(key)
                vectors.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["vec_id", "v"])


def _matrix(vectors, width: int) -> np.ndarray:
    import numpy as np

    out = np.zeros((len(vectors), width))
    if len(vectors) and all(len(v) == width for v in vectors):
        out[:] = np.stack(vectors) if width else out
        return out
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _segments(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of each row, both times the root of the segment's width."""
    import numpy as np

    parts = [p for p in np.array_split(x, min(segments, max(x.shape[1], 1)), axis=1) if p.shape[1]]
    if not parts:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    root = np.sqrt([p.shape[1] for p in parts])
    return np.stack([p.mean(axis=1) for p in parts], axis=1) * root, np.stack([p.std(axis=1) for p in parts], axis=1) * root


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows f(x) with f(x) . f(y) at least x . y."""
    import numpy as np

    return np.concatenate(_segments(x, segments), axis=1)


@dataclass
class Space:
    """Axes and pivots, and how large the numbers are by which vectors are divided before they are bounded."""

    width: int
    large: float
    turn: np.ndarray | None  # orthonormal, width x width
    pivots: np.ndarray  # turned and divided

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x / self.large if self.turn is None else (x / self.large) @ self.turn

    @property
    def slack(self) -> float:
        """More than the rounding errors of a bound."""
        return 1e-9 * max(self.width, 1)


def make_space(sample: np.ndarray, width: int, large: float, cells: int) -> Space:
    """Axes by the energy of the sample, the greatest first, and evenly drawn pivots."""
    import numpy as np

    turn = None
    if 1 < width <= MOST_WIDTH and len(sample):
        turn = np.ascontiguousarray(np.linalg.eigh((sample / large).T @ (sample / large))[1][:, ::-1])
    space = Space(width, large, turn, np.zeros((1, width)))
    if len(sample):
        space.pivots = np.unique(space.turned(sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]), axis=0)
    return space


def _dealt(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows with the cell of the nearest pivot."""
    import numpy as np

    space = shared.value
    half = (space.pivots**2).sum(axis=1) / 2
    for b in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
        x = space.turned(_matrix([v.values.to_numpy() for v in b.column(1)], space.width))
        cell = np.argmax(x @ space.pivots.T - half, axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], names=["vec_id", "v", "cell"])


def _surveyed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """For each cell of a partition: number of rows, least and greatest means, greatest deviations, of the finest segments."""
    import numpy as np

    space, out = shared.value, {}
    for b in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
        mean, dev = _segments(space.turned(_matrix([v.values.to_numpy() for v in b.column(1)], space.width)), RESOLUTIONS[-1])
        cells = b.column(2).to_numpy()
        for c in np.unique(cells).tolist():
            own = cells == c
            now = (int(own.sum()), mean[own].min(axis=0), mean[own].max(axis=0), dev[own].max(axis=0))
            old = out.get(c, now)
            out[c] = (now[0] + (old[0] if c in out else 0), np.minimum(old[1], now[1]), np.maximum(old[2], now[2]), np.maximum(old[3], now[3]))
    if out:
        columns = [pa.array([x[k].tolist() for x in out.values()], pa.list_(pa.float64())) for k in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x[0] for x in out.values()], pa.int64()), *columns], names=["cell", "n", "low", "high", "dev"])


def cell_bounds(mean: np.ndarray, dev: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """query x cell: no vector of the cell has a greater inner product with the query."""
    import numpy as np

    return np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T + dev @ most.T


def _aimed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Queries with the cells that can hold one of their k best."""
    space, cells, low, high, most = shared.value
    for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
        mean, dev = _segments(space.turned(_matrix([v.values.to_numpy() for v in b.column(2)], space.width)), RESOLUTIONS[-1])
        least = _scaled(b.column(4).to_pylist(), space.large**2)
        near = cell_bounds(mean, dev, low, high, most) >= (least - space.slack)[:, None]
        aims = pa.array([cells[row].tolist() for row in near], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*b.columns, aims], names=["query_id", "row", "v", "home", "least", "cells"])


def _scaled(scores: list, large: float) -> np.ndarray:
    """Thresholds (None: there is none) as the bounds are; what is clamped to a long is no threshold."""
    import numpy as np

    return np.array([-np.inf if x is None or abs(x) >= LONG else float(x) / large for x in scores], dtype=np.float64)


def block_top_k(query_ids, queries, ids, vectors, k: int, space: Space, least=None) -> tuple[list[tuple[int, int, int]], int]:
    """(position of the query, of the candidate, score) of each query's k best candidates in the block, and how many pairs were scored.

    ``least`` are scores below which nothing need be found (None: there is none).
    """
    import numpy as np

    q, x = _matrix(queries, space.width), _matrix(vectors, space.width)
    ids, query_ids = np.asarray(ids), np.asarray(query_ids)
    # Up to here doubles are exact; beyond, Python's integers score the survivors.
    plain = max(np.abs(q).max(initial=0), 1.0) * max(np.abs(x).max(initial=0), 1.0) * max(space.width, 1) < 2**53
    unit, scored = space.large**2, 0
    tq, tx = space.turned(q), space.turned(x)
    levels = [(segment_features(tq, s), segment_features(tx, s)) for s in RESOLUTIONS]
    floor = _scaled([None] * len(q) if least is None else list(least), unit)

    def exact(i, j):
        nonlocal scored
        scored += len(i)
        if plain:
            return np.einsum("ij,ij->i", q[i], x[j]) if len(i) else np.zeros(0)
        return np.array([max(-LONG, min(LONG, sum(int(a) * int(b) for a, b in zip(q[m], x[n], strict=True)))) for m, n in zip(i, j, strict=True)], dtype=object)

    out: list[tuple[int, int, int]] = []
    for a in range(0, len(q) if len(x) else 0, TILE):
        tile = np.arange(a, min(a + TILE, len(q)))
        bound = levels[0][0][tile] @ levels[0][1].T
        own = query_ids[tile][:, None] == ids[None, :]
        bound[own] = -np.inf
        known = floor[tile]
        if len(x) > k and (blind := np.flatnonzero(np.isneginf(known))).size:
            # No threshold yet: the most promising candidates, by the finest bound, are scored for one.
            seeds = min(4 * k, len(x))
            likely = np.where(own[blind], np.inf, -(levels[-1][0][tile[blind]] @ levels[-1][1].T))
            first = np.argpartition(likely, seeds - 1, axis=1)[:, :seeds]
            score = exact(np.repeat(tile[blind], seeds), first.ravel())
            if plain:
                score = score.reshape(len(blind), seeds)
                score[np.take_along_axis(own[blind], first, 1)] = -np.inf
                known[blind] = [-np.inf if np.isneginf(s) else _scaled([s], unit)[0] for s in np.sort(score, axis=1)[:, -k]]
        alive = (bound >= known[:, None] - space.slack) & ~own
        for fine_q, fine_x in levels[1:]:
            if (share := alive.mean()) > FEW:
                alive &= fine_q[tile] @ fine_x.T >= known[:, None] - space.slack
            elif share:
                i, j = np.nonzero(alive)
                keep = np.einsum("ij,ij->i", fine_q[tile[i]], fine_x[j]) >= known[i] - space.slack
                alive = np.zeros_like(alive)
                alive[i[keep], j[keep]] = True
        if plain and alive.mean() > FEW:
            scored += int(alive.sum())
            score = np.where(alive, q[tile] @ x.T, -np.inf)
            if len(x) > k:
                alive &= score >= np.maximum(np.partition(score, -k, axis=1)[:, -k], known * unit - space.slack * unit)[:, None]
            i, j = np.nonzero(alive)
            score = score[i, j]
        else:
            i, j = np.nonzero(alive)
            score = exact(tile[i], j)
        order = np.lexsort((ids[j], -(score if plain else score.astype(np.int64)), i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left") if len(i) else np.zeros(0, dtype=int)
        best = place < k
        out += [(int(tile[m]), int(n), int(s)) for m, n, s in zip(i[best], j[best], score[best], strict=True)]
    return out, scored


def _meet(k: int, shared):
    def meet(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "row", "vec_id", "score")})
        least = None if "least" not in left else [None if x is None or x != x else int(x) for x in left["least"].astype(object)]
        found, _ = block_top_k(left["query_id"].to_numpy(), left["v"].to_list(), right["vec_id"].to_numpy(), right["v"].to_list(), k, shared.value, least)
        ids, rows, others = left["query_id"].to_numpy(), left["row"].to_numpy(), right["vec_id"].to_numpy()
        return pd.DataFrame([(ids[i], rows[i], others[j], s) for i, j, s in found], columns=["query_id", "row", "vec_id", "score"]).astype("int64")

    return meet


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all other rows.

    Vectors are taken as floor(scale * x). ``is_query`` is a condition on ``vec_id``. Rows with the
    query's own id are not its candidates. Ties go to the smaller vec_id. Rows with a null id, a null
    vector, or a null or non-finite component take no part; where lengths differ, the shorter vector
    is filled up with zeros, an empty one with zeros alone, and a very long one is held whole. Scores
    beyond a long are clamped. Rows that repeat are candidates each, and queries each once if they
    repeat exactly. An empty table, and one without queries, gives an empty result. Columns are found by
    exact name; others, whatever their names, are not looked at.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=id_col, v=vector_col).select("vec_id", F.col("v").cast("array<double>"))
    clean = stored(rows.mapInArrow(functools.partial(_clean, scale=scale), "vec_id long, v array<double>"), "vectors")
    greatest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    count, asked, width, large = clean.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size("v")), greatest).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [np.array(r["v"]) for r in clean.sample(min(1.0, SAMPLE / count), 5).limit(2 * SAMPLE).collect()]
    cells = min(MOST_CELLS, max(1, math.isqrt(count) // 4))
    shared = spark.sparkContext.broadcast(make_space(_matrix(sample, width), width, max(large or 0.0, 1.0), cells))
    dealt = clean.mapInArrow(functools.partial(_dealt, shared=shared), "vec_id long, v array<double>, cell int")
    dealt = stored(dealt, "cells")

    # Statistics of each cell, at most MOST_CELLS of RESOLUTIONS[-1] segments, and its blocks, which have numbers in a row.
    partial = stored(dealt.mapInArrow(functools.partial(_surveyed, shared=shared), "cell int, n long, low array<double>, high array<double>, dev array<double>"), "cell-statistics")
    of = lambda fn, name: F.array(*[fn(F.get(name, F.lit(i))) for i in range(max(1, min(RESOLUTIONS[-1], width)))]).alias(name)
    known = partial.groupBy("cell").agg(F.sum("n").alias("n"), of(F.min, "low"), of(F.max, "high"), of(F.max, "dev")).orderBy("cell").collect()
    target = min(CANDIDATES, max(256, count // (3 * spark.sparkContext.defaultParallelism)))
    parts = [-(-r["n"] // target) for r in known]
    listed = [(r["cell"], sum(parts[:i]), parts[i]) for i, r in enumerate(known)]
    blocks = F.broadcast(spark.createDataFrame(listed, "cell int, first long, parts long"))
    placed = dealt.join(blocks, "cell").select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))).alias("block"))
    placed = stored(placed, "blocks")
    queries = placed.where(is_query).groupBy("vec_id", "v").agg(F.min("block").alias("home")).select(F.col("vec_id").alias("query_id"), "v", "home")
    queries = stored(queries.withColumn("row", F.monotonically_increasing_id()), "queries")

    # The block of the query itself.
    home = queries.groupBy("home").cogroup(placed.groupBy("block")).applyInPandas(_meet(k, shared), _FOUND)
    home = stored(home, "home")
    least = home.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    limits = queries.join(least, "row", "left").select("query_id", "row", "v", "home", "least")

    # The blocks of the cells that can hold better ones.
    stats = spark.sparkContext.broadcast((shared.value, np.array([r["cell"] for r in known], dtype=np.int32), *(np.array([r[c] for r in known], dtype=float) for c in ("low", "high", "dev"))))
    aimed = limits.mapInArrow(functools.partial(_aimed, shared=stats), "query_id long, row long, v array<double>, home long, least long, cells array<int>")
    aimed = stored(aimed, "aimed")
    each = aimed.select("query_id", "row", "home", "least", F.explode("cells").alias("cell")).join(blocks, "cell")
    each = each.withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))).where("block <> home")
    met = each.select("query_id", "row", "least", "block")
    groups = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("groups"))
    groups = sized(stored(groups, "query-groups"))
    left = met.join(groups, "block").withColumn("g", F.pmod(F.xxhash64("row"), F.col("groups"))).join(queries.select("row", "v"), "row")
    right = placed.select("vec_id", "v", "block").join(groups, "block").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    away = left.select("query_id", "row", "v", "least", "block", "g").groupBy("block", "g").cogroup(right.select("vec_id", "v", "block", "g").groupBy("block", "g"))
    found = home.unionByName(away.applyInPandas(_meet(k, shared), _FOUND))
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
