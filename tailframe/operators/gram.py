"""Covariance of many members by tiles, and minimum variance without inverting.

Making every pair of a day's members costs days x N^2 rows. Here members are numbered and cut into tiles; a tile
of members over a chunk of days is one dense block (members x days, less each member's mean). Tiles are gathered into
bands, and what is shuffled is each block once for each band it meets: about MOST_BANDS copies of the panel at most,
however many members there are, unless that makes bands too large for a task. A job multiplies two bands and hands out
its pairs: pairs are never shuffled. Results are the same rows as those of portfolio.covariance_pairs().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tailframe.plans import settings as S
from tailframe.plans.shipping import ship
from tailframe.plans.storage import stored

P, SID = "portfolio_id", "series_id"

#: Members of a tile; days of a chunk, about.
TILE, CHUNK_DAYS = 128, 2048
#: Members of a band over several chunks, whose products with another band (8 bytes a pair) are in one task's memory; with
#: a single chunk products are made by the batch, and a band holds at most as many values as so many members over a chunk.
BAND = 2048
#: Bands that a portfolio is cut into at least, if it has so many tiles, and beyond which they grow up to the limit above
#: instead of becoming more; pairs of a batch that leaves a task; partitions of the jobs.
FEWEST_BANDS, MOST_BANDS, BATCH_PAIRS, JOB_PARTITIONS = 8, 16, 1 << 16, 2000
#: Portfolios of more members are covered by tiles (below, pairs are made inside Spark's own expressions), and a
#: portfolio of more members is iterated on over the whole cluster and not inside one task.
FEW_MEMBERS, ONE_TASK = 32, 2000
#: Conjugate gradients stop at this relative gradient, or after so many steps a member.
TOLERANCE, STEPS_A_MEMBER = 1e-13, 10


def covariance_tiles(panel: DataFrame, time: str = "d", tile: int = TILE, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """portfolio_id, i, j (i <= j), wi, wj, n, cov, corr of an aligned panel: every member has every day."""
    ship(panel.sparkSession)
    panel = stored(panel.select(P, SID, time, "s", "w"), "panel")
    members = panel.groupBy(P, SID).agg(F.first("w").alias("w"), F.avg("s").alias("mean"), F.count("*").alias("n"))
    at = F.row_number().over(W.partitionBy(P).orderBy(SID)) - 1  # a row a member
    members = members.withColumn("at", at).withColumn("tile", F.floor(F.col("at") / tile).cast("int")).withColumn("tiles", F.max("tile").over(W.partitionBy(P)) + 1)
    members = stored(members, "members")
    longest = members.agg(F.max("n")).first()[0] or 1
    chunks = -(-longest // chunk_days)
    usual = max(1, BAND // tile)  # tiles of a band
    widest = usual if chunks > 1 else max(usual, BAND * chunk_days // longest // tile)
    wanted = F.greatest(F.least(F.lit(usual), F.floor(F.col("tiles") / FEWEST_BANDS)), F.ceil(F.col("tiles") / MOST_BANDS))
    width = F.greatest(F.lit(1), F.least(F.lit(widest), wanted)).cast("int")
    n_bands = F.ceil(F.col("tiles") / width)
    sizes = members.groupBy(P).agg(F.max(n_bands * (n_bands + 1) / 2).alias("jobs"), F.max(width).alias("width")).agg(F.sum("jobs"), F.max("width")).first()
    # Long jobs get partitions to spare, so that few of them fall into one.
    partitions = int(sizes[0] or 1) * math.ceil((sizes[1] or 1) / usual) ** 2
    chunk = F.pmod(F.xxhash64(time), F.lit(chunks)).cast("int")
    cells = panel.select(P, SID, F.col(time).alias("day"), "s", chunk.alias("chunk")).join(members, [P, SID])
    cells = cells.select(P, "tile", "tiles", "chunk", "at", SID, "w", "n", "day", (F.col("s") - F.col("mean")).alias("x"))
    name, key = panel.schema[SID].dataType.simpleString(), panel.schema[P].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("day", "ascending")])
        where = table.column("at").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        one = table.take(pa.array(first))
        lists = lambda c: pa.array([one.column(c).to_pylist()], pa.list_(table.schema.field(c).type))
        head = [table.column(c).slice(0, 1).combine_chunks() for c in (P, "tile", "tiles", "chunk", "n")]
        block = np.ascontiguousarray(table.column("x").to_numpy()).tobytes()
        return pa.table([*head, lists(SID), lists("w"), pa.array([block], pa.binary())], names=[P, "tile", "tiles", "chunk", "n", "ids", "ws", "block"])

    blocks = stored(cells.groupBy(P, "tile", "chunk").applyInArrow(pack, f"{P} {key}, tile int, tiles int, chunk int, n long, ids array<{name}>, ws array<double>, block binary"), "blocks")
    # Job (a, b), a <= b: band a with band b.
    bands = blocks.withColumn("band", F.floor(F.col("tile") / width).cast("int")).withColumn("bands", n_bands.cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda o: F.struct(F.least(o, F.col("band")).alias("a"), F.greatest(o, F.col("band")).alias("b")))
    jobs = bands.withColumn("job", F.explode(meet)).select(P, "chunk", "job.a", "job.b", "band", "tile", "n", "ids", "ws", "block")
    jobs = jobs.repartition(min(partitions, JOB_PARTITIONS), P, "a", "b").sortWithinPartitions(P, "a", "b", "chunk", "tile")
    types = {"p": panel.schema[P].dataType, "i": panel.schema[SID].dataType}

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_type, i_type = to_arrow_type(types["p"]), to_arrow_type(types["i"])
        rows = (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())
        for (p, a, b), job in groupby(rows, key=lambda r: (r[P], r["a"], r["b"])):
            xy = None
            for _, chunk in groupby(job, key=lambda r: r["chunk"]):
                sides: dict[int, list[dict]] = {}
                for r in chunk:
                    sides.setdefault(r["band"], []).append(r)
                x, y = (np.vstack([np.frombuffer(r["block"]).reshape(len(r["ids"]), -1) for r in sides[side]]) for side in (a, b))
                if xy is None:
                    n = sides[a][0]["n"]
                    ids, ws = ([[v for r in sides[side] for v in r[c]] for side in (a, b)] for c in ("ids", "ws"))
                    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
                    xy = x @ y.T if chunks > 1 else ()
                else:
                    xy += x @ y.T
                    xx += (x * x).sum(axis=1)
                    yy += (y * y).sum(axis=1)
            names, weights = [pa.array(v, i_type) for v in ids], [pa.array(v, pa.float64()) for v in ws]
            step = max(1, BATCH_PAIRS // len(yy))
            for start in range(0, len(xx), step):
                part = xy[start : start + step] if chunks > 1 else x[start : start + step] @ y.T
                k, m = (g.ravel() for g in np.indices(part.shape))
                if a == b:
                    above = k + start <= m
                    k, m = k[above], m[above]
                products = part[k, m]
                k += start
                left, right = pa.array(k), pa.array(m)
                columns = [pa.array([p], p_type).take(pa.array(np.zeros(len(k), "int64"))), names[0].take(left), names[1].take(right), weights[0].take(left), weights[1].take(right)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (np.full(len(k), n), products, xx[k], yy[m]))], names=[P, "i", "j", "wi", "wj", "n", "xy", "xx", "yy"])

    total = jobs.mapInArrow(multiply, f"{P} {key}, i {name}, j {name}, wi double, wj double, n long, xy double, xx double, yy double")
    cov = F.col("xy") / F.nullif(F.col("n") - 1, F.lit(0)) * S.TRADING_DAYS
    corr = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return total.select(P, "i", "j", "wi", "wj", "n", cov.alias("cov"), corr.alias("corr"))


def least_squares_cg(multiply: Callable[[np.ndarray], np.ndarray], size: int, tolerance: float = TOLERANCE, steps: int | None = None) -> tuple[np.ndarray, bool]:
    """The solution of least norm of min |S x - 1| for a symmetric S, which is the pseudo-inverse times ones, and
    whether it was reached. S is only multiplied with. The iterates stay in the range of S, so singular matrices
    need nothing of their own."""
    x, r = np.zeros(size), np.ones(size)
    s = multiply(r)
    p, gamma = s.copy(), s @ s
    goal = gamma * tolerance**2
    scale = 0.0
    for _ in range(steps or STEPS_A_MEMBER * size + 10):
        if gamma <= goal or gamma == 0:
            return x, True
        q = multiply(p)
        length = q @ q
        scale = max(scale, length / max(p @ p, 1e-300))
        if length <= 1e-30 * scale * (p @ p):
            return x, True  # what is left lies where S is nothing but rounding
        step = gamma / length
        x += step * p
        r -= step * q
        s = multiply(r)
        gamma, before = s @ s, gamma
        p = s + gamma / before * p
    return x, False


def _weights(x: np.ndarray, reached: bool) -> tuple[np.ndarray | None, str | None]:
    """Weights that add up to 1, or the reason why there are none."""
    if not reached:
        return None, "no convergence"
    total = x.sum()
    if not np.isfinite(total) or abs(total) <= 1e-8 * max(np.abs(x).sum(), 1e-300):
        return None, "the covariance matrix is degenerate"
    return x / total, None


def minimum_variance(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """portfolio_id, series_id, w, reason: weights of least variance, shorts allowed. A portfolio whose matrix is
    degenerate (no variance, or the solution adds up to nothing), or holds missing values, has NULL weights and a
    reason. Matrices of up to one_task members are iterated on inside a task each, larger ones over the
    stored pairs: a step is then one pass, and only vectors, which are the root of a matrix's size, pass the driver."""
    spark = pairs.sparkSession
    ship(spark)
    kind, key = pairs.schema["i"].dataType.simpleString(), pairs.schema[P].dataType.simpleString()
    sized = pairs.where("i = j").groupBy(P).agg(F.count("*").alias("_members"))
    large = [r[P] for r in sized.where(F.col("_members") > one_task).select(P).collect()] if one_task else [r[P] for r in sized.select(P).collect()]

    def solve(table: pa.Table) -> pa.Table:
        names = sorted(set(table.column("i").to_pylist()) | set(table.column("j").to_pylist()))
        at = {n: k for k, n in enumerate(names)}
        i, j = (np.array([at[n] for n in table.column(c).to_pylist()]) for c in ("i", "j"))
        cov = table.column("cov").to_numpy()
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = np.where(np.isnan(cov), np.nan, cov)
        w, why = (None, "missing covariances") if np.isnan(m).any() else _weights(*least_squares_cg(lambda v: m @ v, len(names)))
        return pa.table([pa.array([table.column(P)[0].as_py()] * len(names), table.schema.field(P).type), pa.array(names, table.schema.field("i").type), pa.array(w if w is not None else [None] * len(names), pa.float64()), pa.array([why] * len(names), pa.string())], names=[P, SID, "w", "reason"])

    schema = f"{P} {key}, {SID} {kind}, w double, reason string"
    small = pairs.where(~F.col(P).isin(large)) if large else pairs
    out = small.select(P, "i", "j", "cov").groupBy(P).applyInArrow(solve, schema)
    for portfolio in large:
        out = out.unionByName(_solve_large(pairs.where(F.col(P) == F.lit(portfolio)), portfolio, schema))
    return out


def _solve_large(pairs: DataFrame, portfolio, schema: str) -> DataFrame:
    """One portfolio over the cluster. The pairs are stored with numbers for names; each step multiplies them with
    the broadcast vector, row by row of the matrix, in as many tasks as the table has."""
    spark = pairs.sparkSession
    names = [r.i for r in pairs.where("i = j").select("i").orderBy("i").collect()]  # members, not days or pairs
    numbered = spark.createDataFrame(list(enumerate(names)), "at int, name string").withColumn("name", F.col("name").cast(pairs.schema["i"].dataType))
    of = lambda c, new: numbered.select(F.col("name").alias(c), F.col("at").alias(new))
    cells = stored(pairs.select("i", "j", "cov").join(F.broadcast(of("i", "a")), "i").join(F.broadcast(of("j", "b")), "j").select("a", "b", "cov"), "cells")
    if cells.where(F.col("cov").isNull() | F.isnan("cov")).limit(1).count():
        return spark.createDataFrame([(portfolio, n, None, "missing covariances") for n in names], schema)
    size = len(names)

    def multiply(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(v)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y = shared.value, np.zeros(size)
            for batch in batches:
                a, b, c = (batch.column(k).to_numpy() for k in range(3))
                y += np.bincount(a, c * x[b], size)
                off = a != b
                y += np.bincount(b[off], c[off] * x[a[off]], size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(y)], names=["at", "y"])

        out = np.zeros(size)
        for r in cells.mapInArrow(run, "at long, y double").groupBy("at").agg(F.sum("y").alias("y")).collect():
            out[r["at"]] = r["y"]
        shared.unpersist()
        return out

    w, why = _weights(*least_squares_cg(multiply, size))
    return spark.createDataFrame([(portfolio, n, None if w is None else float(w[k]), why) for k, n in enumerate(names)], schema)
