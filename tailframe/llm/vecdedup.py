"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample; every vector is then placed. It is at home in the
cell of the centroid with the largest cosine, and is also compared in each further cell that
could be the home of a vector within the threshold. Let x be a unit vector, a its home centroid
and b another. A vector at angle t from x can lie on b's side only if

    cos(t) <x, a - b>  <=  sin(t) |part of a - b orthogonal to x|,

so cells outside this bound are skipped without losing a link: for any centroids, the links
found are the links of a full comparison. Cells are cut into blocks of bounded size and pairs
of blocks are matrix products; a pair of blocks emits sums and a spanning forest, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, ship, stored
from .graph import components, merge_labels

#: Vectors on which centroids are fitted: so many for each cell, and so many at least (about), within SAMPLE_BYTES
#: in double precision on the driver.
SAMPLE_A_CELL, SAMPLE_ROWS, SAMPLE_BYTES = 16, 20_000, 128 << 20
#: Cells grow with the largest label: one for each CELL_ROWS of its vectors, but no more than twice the
#: root of their number, where placing costs as much as comparing does, and MOST_CELLS.
CELL_ROWS, MOST_CELLS = 512, 8192
#: Vectors in a block, at most about.
BLOCK_ROWS = 2048
#: Slack on the bound, far above rounding errors.
EPS = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit rows of x, fewer if x has fewer distinct rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def places(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row of x, and (as a mask) the later cells where it has to be
    compared too. A link between two cells is found in the later one."""
    dots = x @ c.T
    home = np.argmax(dots, axis=1)
    gap = dots[np.arange(len(x)), home][:, None] - dots  # <x, a - b>
    apart = np.maximum(2 - 2 * (c @ c.T), 0)[home]  # |a - b| squared
    sine = np.sqrt(max(0.0, 1 - threshold * threshold))
    reach = threshold * gap <= sine * np.sqrt(np.maximum(apart - gap * gap, 0)) + EPS
    return home, reach & (np.arange(len(c))[None, :] > home[:, None])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows in double precision, each scaled by a power of two (which changes no digit) so that its
    largest component is near 1: squares neither overflow nor vanish, and cosines stay the same."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) if dim else x


def _compare(left: np.ndarray, right: np.ndarray | None, threshold: float) -> np.ndarray:
    """Whether cosines reach the threshold; right None: left with itself, without the diagonal."""
    other = left if right is None else right
    near = (left @ other.T) / np.outer(np.linalg.norm(left, axis=1), np.linalg.norm(other, axis=1)) >= threshold
    if right is None:
        np.fill_diagonal(near, False)
    return near


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row for each row of df: id_col, n_links (other rows linked directly), component_id
    (smallest id that links reach, its own included) and kept (the id is its component's).

    Rows are linked if their labels are equal and not null and the cosine of their vectors,
    in double precision, is at least the threshold. A vector that is null, empty, zero or
    holds null or non-finite components links with nothing, and neither do vectors of
    unequal length. Repeated rows are rows of their own, linked with each other. Ids may
    repeat; null ids are ignored by the minimum. Components of any size are compared without
    overflow. Vectors of any length are read whole. Other columns aren't read, so their names
    can't clash. An empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    v = F.col("v")
    # Single precision travels as it is, half as wide; products are always double.
    narrow = df.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")
    finite = F.size(v).cast("boolean") & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("v"))
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False)))

    # Equal vectors of a label are one vector that counts several times. Rows and vectors know each other by 128
    # bits of hashes, so that no later join carries whole vectors as keys.
    known = F.concat_ws(":", F.xxhash64("label", "v").cast("string"), F.xxhash64(F.lit(1), "v", "label").cast("string"))
    rows = rows.withColumn("known", F.when(F.col("valid"), known))
    distinct = rows.where("valid").groupBy("known").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("least"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")

    largest = distinct.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    dims = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = dims["dim"] if dims else 0
    cells = int(min(MOST_CELLS, max(1, -(-largest // CELL_ROWS)), 1 + 2 * int(largest**0.5)))
    if cells > 1:
        # A slice of the hash's range: as good as random, the same in every run, and no top-k of
        # vectors that one task would have to merge.
        wanted = min(max(SAMPLE_ROWS, SAMPLE_A_CELL * cells), SAMPLE_BYTES // (8 * max(dim, 1)))
        share = min(1 << 20, (wanted << 20) // dims["count"] + 1)
        sample = distinct.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("label", "v"), F.lit(1 << 20)) < share)).select("v").toArrow()
        x = _matrix(sample.column("v"), dim)
        centroids = spherical_kmeans(x / np.linalg.norm(x, axis=1)[:, None], cells)
    else:
        centroids = None
    shared = spark.sparkContext.broadcast(centroids)  # MOST_CELLS x dim numbers at most

    def place(batches):
        c = shared.value
        for batch in batches:
            n = batch.num_rows
            home, more = np.zeros(n, dtype=np.int64), (np.empty(0, dtype=np.int64),) * 2
            of = np.flatnonzero(batch.column(1).to_numpy() == dim)
            if c is not None and len(of):
                x = _matrix(batch.column(2).take(pa.array(of)), dim)
                home[of], mask = places(x / np.linalg.norm(x, axis=1)[:, None], c, threshold)
                i, cell = np.nonzero(mask)
                more = of[i], cell
            pick = np.concatenate([np.arange(n), more[0]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pick)), pa.array(np.concatenate([home, more[1]])), pa.array(np.arange(len(pick)) < n)],
                names=["node", "cell", "home"],
            )

    placed = stored(distinct.select("node", "dim", "v").mapInArrow(place, "node long, cell long, home boolean"), "places")
    member = placed.join(distinct.select("node", "label", "dim", "v", "copies"), "node")
    at = ["label", "dim", "cell"]
    sizes = member.groupBy(*at).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(BLOCK_ROWS))).cast("int")
    sizes = sizes.where("homes > 0").select(*at, blocks("homes").alias("hb"), blocks("guests").alias("gb"), F.col("guests") > 0)
    sizes = sizes.select(*at, "hb", "gb")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("gb"))).cast("int")
    seated = member.join(sizes, at).withColumn("block", own)
    # A task is (i, j): home block j with home block i <= j, or with guest block -1 - i.
    job = lambda i, j, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(right).alias("right"))
    b, hb, gb = F.col("block"), F.col("hb"), F.col("gb")
    as_home = F.concat(
        F.transform(F.sequence(F.lit(0), b), lambda i: job(i, b, True)),
        F.transform(F.filter(F.sequence(F.lit(0), hb - 1), lambda j: j > b), lambda j: job(b, j, False)),
        F.transform(F.sequence(F.lit(0), gb - 1), lambda g: job(-1 - g, b, True)),
    )
    as_guest = F.transform(F.sequence(F.lit(0), hb - 1), lambda j: job(-1 - b, j, False))
    tasks = seated.withColumn("job", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)))
    tasks = tasks.select(*at, "job.i", "job.j", "job.right", "node", "copies", "v")

    def compare(table: pa.Table) -> pa.Table:
        d = table.column("dim")[0].as_py()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        right = table.column("right").to_numpy()
        node, copies, x = table.column("node").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("v"), d)
        l, r = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        near = _compare(x[l], None if same else x[r], threshold) if len(l) and len(r) else np.zeros((len(l), len(r)), dtype=bool)
        links = np.zeros(len(node), dtype=np.int64)
        links[l] += near @ copies[r]
        if not same:
            links[r] += near.T @ copies[l]
        i, j = np.nonzero(near)
        root = merge_labels(np.arange(len(node)), [np.stack([l[i], r[j]])] if len(i) else [])
        some = np.flatnonzero(links)
        return pa.table([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], names=["a", "b", "links"])

    found = stored(tasks.groupBy(*at, "i", "j").applyInArrow(compare, "a long, b long, links long"), "links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b").select("a", "b"))
    each = distinct.join(counts, distinct.node == counts.a, "left").join(roots, "node", "left")
    each = stored(each.select("node", "known", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "nodes")
    # One component may hold most vectors, and one vector most rows.
    smallest = each.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    total = each.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    sizes = each.select("known", F.col("copies").alias("n"))
    each = hot_join(each, smallest.select("root", "component"), "root", smallest.select("root", "n"), total.nodes, "node")
    each = each.select("known", (F.col("links") + F.col("copies") - 1).alias("links"), "component")
    numbered = rows.where("valid").select("id", "known", F.monotonically_increasing_id().alias("_row"))
    valid = hot_join(numbered, each, "known", sizes, total.rows, "_row").select("id", "links", "component")
    invalid = rows.where("not valid").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = valid.unionByName(invalid)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def oracle(threshold: float = 0.98) -> str:
    return f"""
WITH RECURSIVE ok AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS k FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM ok),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
d AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN d ON vec_id = d.a LEFT JOIN c ON vec_id = c.a
"""
