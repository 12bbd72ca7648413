"""Spectral clustering of points: affinity, normalised Laplacian, leading eigenvectors, k-means, and a kernel-width sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.session import materialize

#: Points of a block; a task computes the distances between two blocks.
BLOCK = 512
#: Points up to which the eigenvectors are computed by the driver on a dense matrix (at most 32 MB).
LOCAL_POINTS = 2048
#: Entries of the affinity that a task holds at once; rows of a task; vectors beyond the wanted ones, blocks of vectors kept and products taken at most.
ENTRIES, ROWS, SPARE, KEPT, PRODUCTS = 1_000_000, 2_048, 4, 8, 60


def distances(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, d2): squared Euclidean distances of all ordered pairs of different points of (id, features).

    The result is quadratic by its nature. Points are packed into blocks; every pair of blocks is one row, whose
    distances are computed vectorised in whichever task takes it. Null features are left out.
    """
    plain = points.filter("id is not null and features is not null").select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    count = max(1, -(-plain.count() // block))
    packed = plain.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count))).groupBy("block")
    packed = materialize(packed.agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("features")).alias("x")), "blocks")
    a = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).toDF("block_a", "ids_a", "x_a", "block_b")
    grid = a.join(packed.toDF("block_b", "ids_b", "x_b"), "block_b").repartition(F.col("block_a"), F.col("block_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids_a, x_a, ids_b, x_b = (np.asarray(batch.column(batch.schema.get_field_index(c))[row].values.to_numpy(zero_copy_only=False)) for c in ("ids_a", "x_a", "ids_b", "x_b"))
                x_a, x_b = x_a.reshape(len(ids_a), -1), x_b.reshape(len(ids_b), -1)
                for at in range(0, len(ids_a), 64):
                    d2 = ((x_a[at : at + 64, None, :] - x_b[None, :, :]) ** 2).sum(axis=2)
                    i, j = np.meshgrid(ids_a[at : at + 64], ids_b, indexing="ij")
                    keep = i != j
                    yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(d2[keep])], names=["i", "j", "d2"])

    return grid.mapInArrow(run, "i long, j long, d2 double")


def affinity(pairs: DataFrame, sigma: float = 1.5) -> DataFrame:
    """(i, j, w): the Gaussian kernel of each distance; the diagonal is 0 and has no row."""
    return pairs.select("i", "j", F.exp(-F.col("d2") / (2.0 * sigma * sigma)).alias("w"))


def affinity_degrees(weights: DataFrame) -> DataFrame:
    """(i, degree): the row sums of the affinity."""
    return weights.groupBy("i").agg(F.sum("w").alias("degree"))


def laplacian(weights: DataFrame) -> DataFrame:
    """(i, j, w): each affinity divided by the roots of both degrees; 0 where a degree is 0."""
    degree = affinity_degrees(weights)
    both = weights.join(degree, "i").join(degree.toDF("j", "degree_j"), "j")
    scaled = F.coalesce(F.try_divide(F.col("w"), F.sqrt(F.col("degree")) * F.sqrt(F.col("degree_j"))), F.lit(0.0))
    return both.select("i", "j", scaled.alias("w"))


def leading_vectors(matrix: DataFrame, ids: list[int], k: int) -> np.ndarray:
    """The ``k`` eigenvectors of the largest eigenvalues of a symmetric (i, j, w), one row for each id, largest first.

    Up to LOCAL_POINTS ids by a dense solver in the driver; more by a distributed decomposition of the matrix plus the
    identity, whose singular values lie in the order of the eigenvalues.
    """
    place = {v: at for at, v in enumerate(ids)}
    if len(ids) <= LOCAL_POINTS:
        table = matrix.toArrow()
        dense = np.zeros((len(ids), len(ids)))
        row, col = (np.searchsorted(ids, table.column(c).to_numpy()) for c in ("i", "j"))
        dense[row, col] = table.column("w").to_numpy()
        values, vectors = np.linalg.eigh((dense + dense.T) / 2)
        return vectors[:, np.argsort(-values, kind="stable")[:k]]
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    shared = matrix.sparkSession.sparkContext.broadcast(place)
    n = len(ids)
    rows = matrix.groupBy("i").agg(F.collect_list(F.struct("j", "w")).alias("row")).rdd.map(
        lambda r: IndexedRow(shared.value[r["i"]], Vectors.sparse(n, {**{shared.value[e["j"]]: e["w"] for e in r["row"]}, shared.value[r["i"]]: 1.0}))
    )
    found = IndexedRowMatrix(rows).computeSVD(k, computeU=False)
    return np.asarray(found.V.toArray())


def embed(weights: DataFrame, k: int) -> tuple[DataFrame, list[int]]:
    """((id, features), ids): the rows of the k leading vectors of the Laplacian, scaled to length 1; a zero row stays zero."""
    spark = weights.sparkSession
    ids = sorted(r[0] for r in weights.select("i").distinct().collect())
    k = min(k, len(ids))
    if not ids:
        return spark.createDataFrame([], "id long, features array<double>"), ids
    return _unit_rows(spark, ids, leading_vectors(laplacian(weights), ids, k)), ids


def _unit_rows(spark: SparkSession, ids: list[int], vectors: np.ndarray) -> DataFrame:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 1e-12)
    return spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, unit)], "id long, features array<double>")


def _affinity_products(spark: SparkSession, x: np.ndarray, sigma: float):
    """A function of (vectors, one row for each point) to the affinity of the points ``x`` times them, computed in the cluster.

    The affinity itself is never stored: a task computes some of its rows at a time from the points and multiplies them.
    """
    points = spark.sparkContext.broadcast(x)
    entries, rows = ENTRIES, ROWS

    def product(vectors: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(vectors)

        def run(start: int) -> np.ndarray:
            x, q = points.value, shared.value
            out, step = [], max(1, entries // len(x))
            for at in range(start, min(start + rows, len(x)), step):
                own = x[at : min(at + step, start + rows)]
                d2 = np.zeros((len(own), len(x)))
                for c in range(x.shape[1]):
                    d2 += (own[:, c, None] - x[None, :, c]) ** 2
                w = np.exp(d2 / (-2.0 * sigma * sigma))
                w[np.arange(len(own)), np.arange(at, at + len(own))] = 0
                out.append(w @ q)
            return np.concatenate(out)

        starts = list(range(0, len(x), rows))
        made = spark.sparkContext.parallelize(starts, len(starts)).map(run).collect()
        shared.destroy()
        return np.concatenate(made)

    return product, points


def point_vectors(spark: SparkSession, x: np.ndarray, k: int, sigma: float, seed: int = 1) -> np.ndarray:
    """The ``k`` leading vectors of the Laplacian of the points ``x``, by block Lanczos steps on products computed in the cluster."""
    product, points = _affinity_products(spark, x, sigma)
    degree = product(np.ones((len(x), 1)))[:, 0]
    scale = np.divide(1.0, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 0)[:, None]
    width = min(len(x), k + SPARE)
    fresh = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(x), width)))[0]
    basis = image = np.zeros((len(x), 0))
    for _ in range(PRODUCTS):
        basis, image = np.hstack([basis, fresh]), np.hstack([image, scale * product(scale * fresh)])
        inner = basis.T @ image
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        values, turned = values[::-1][:width], turned[:, ::-1][:, :width]
        found, moved = basis @ turned, image @ turned
        rest = moved - found * values
        if np.linalg.norm(rest[:, :k], axis=0).max() <= 1e-8:
            break
        if basis.shape[1] >= KEPT * width:
            basis, image = found, moved
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        u, size, _ = np.linalg.svd(rest, full_matrices=False)
        fresh = u[:, size > 1e-12]
        if not fresh.shape[1] or basis.shape[1] + fresh.shape[1] > len(x):
            break
    points.destroy()
    return found[:, :k]


def _k_means(embedded: DataFrame, k: int, seed: int) -> tuple[DataFrame, float]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = materialize(embedded, "embedded").withColumn("vector", array_to_vector("features"))
    model = KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(data)
    return model.transform(data).select("id", "cluster"), float(model.summary.trainingCost)


def spectral_cluster(points: DataFrame, k: int = 4, sigma: float = 1.5, seed: int = 1) -> DataFrame:
    """(id, cluster): clusters 0 .. k-1 of the points of (id, features).

    Beyond LOCAL_POINTS points the affinity is not stored: points and vectors (n x k numbers) come to the driver, its products
    with vectors are computed in the cluster.
    """
    plain = points.filter("id is not null and features is not null").select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    if plain.count() > max(1, LOCAL_POINTS):
        rows = plain.orderBy("id").toArrow()
        ids, x = rows.column("id").to_pylist(), rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        return _k_means(_unit_rows(points.sparkSession, ids, point_vectors(points.sparkSession, x, min(k, len(ids)), sigma, seed)), k, seed)[0]
    embedded, _ = embed(materialize(affinity(distances(points), sigma), "affinity"), k)
    return embedded.select("id", F.lit(0).alias("cluster")) if embedded.isEmpty() else _k_means(embedded, k, seed)[0]


def optimal_sigma(points: DataFrame, k: int = 4, sigmas: list[float] | None = None, seed: int = 1) -> DataFrame:
    """(sigma, cost, best): the k-means cost for each kernel width; ``best`` marks the first of the lowest cost.

    Distances are computed once and shared by all widths.
    """
    sigmas = sigmas or [0.5 * i for i in range(1, 21)]
    pairs = materialize(distances(points), "distances")
    costs = [_k_means(embed(affinity(pairs, sigma), k)[0], k, seed)[1] for sigma in sigmas]
    best = int(np.argmin(costs))
    return points.sparkSession.createDataFrame([(s, c, i == best) for i, (s, c) in enumerate(zip(sigmas, costs))], "sigma double, cost double, best boolean")
