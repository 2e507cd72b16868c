"""Exact k-means on integers by weighted deduplication.

Vectors are turned into integers; equal ones are one row with a multiplicity. Lloyd's rounds run on these distinct rows
with weighted integer sums, of which each task gives one row for each centroid, and the assignments are joined back to the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitas.llm.common import finite, staged, tune
from civitas.llm.dedup import HOT, hot_join

#: Components of a vector, steps of a unit, centroids, rounds, and what the ids are hashed with.
SIZE, STEPS, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: A component's integer is less than this, so that a squared distance is a long.
MOST = 1 << 27


def quantised(embedding) -> F.Column:
    """Each component x as floor(``STEPS`` * x); one too large for distances to be longs is an error."""
    whole = lambda x: F.floor(x.cast("double") * STEPS)
    fits = F.forall(embedding, lambda x: F.abs(x.cast("double") * STEPS) < MOST)
    said = F.raise_error(F.lit(f"a component of {MOST // STEPS} or more: squared distances are no longs"))
    return F.when(fits, F.transform(embedding, lambda x: whole(x).cast("int"))).otherwise(said)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest centroids of each row, and the squared distance; exactly."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # floating point is exact
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        far = ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    else:
        far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def weighted(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` times their weights, whatever their size."""
    if float(np.abs(values).max()) * float(weights.max()) * len(values) >= 1 << 62:
        values, weights = values.astype(object), weights.astype(object)
    return weights @ values


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> list:
    """Rows (cluster, rows, sums, inertia) of the non-empty clusters: counts, sums of each component and of the distances."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = shared.value.shape
        sums, counts, inertia = [[0] * size for _ in range(k)], [0] * k, [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            x, weight = matrix(batch.column(0)), batch.column(1).to_numpy()
            at, far = nearest(x, shared.value)
            for c in np.unique(at):
                own, w = at == c, weight[at == c]
                sums[c] = [int(a) + int(b) for a, b in zip(sums[c], weighted(x[own], w))]
                counts[c] += int(w.sum())
                inertia[c] += int(weighted(far[own], w))
        some = [c for c in range(k) if counts[c]]
        text = lambda v: pa.array([str(x) for x in v], pa.string())
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([counts[c] for c in some], pa.int64()), pa.array([[str(s) for s in sums[c]] for c in some], pa.list_(pa.string())), text(inertia[c] for c in some)], ["cluster", "rows", "sums", "inertia"])

    parts = distinct.select("q", "rows").mapInArrow(add, "cluster int, rows long, sums array<string>, inertia string")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    found = parts.groupBy("cluster").agg(F.sum("rows").alias("rows"), exact(F.col("inertia")).alias("inertia"), F.array(*(exact(F.col("sums")[i]) for i in range(centroids.shape[1]))).alias("sums")).collect()
    shared.unpersist()
    return found


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of the rows of ``vectors`` (vec_id, embedding)
    with exactly ``size`` components, none null or non-finite; other rows give none.

    The first centroids are the ``k`` rows of least sha256 of ``seed:vec_id``, ties in order of the vectors; rows with a null
    id count like others but come last there. With fewer rows there are fewer centroids. Repeated rows count and are returned each.
    Distance ties go to the smaller number; an empty centroid stays as it is. Components of 2**19 or more are an error, as squared distances
    would be no longs. Other columns are ignored; no kept row gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)
    kept = vectors.where((F.size("embedding") == size) & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("q"))
    kept = staged(kept, "quantised")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.withColumn("by", by).orderBy(F.col("by").asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.q for r in first], np.int64)
    distinct = staged(kept.groupBy("q").agg(F.count("*").alias("rows")), "distinct")
    for _ in range(rounds):
        for r in weighted_sums(distinct, centroids):
            centroids[r.cluster] = [int(s) // r.rows for s in r.sums]
    inertia = {r.cluster: int(r.inertia) for r in weighted_sums(distinct, centroids)}
    told = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = nearest(matrix(batch.column(0)), shared.value)
                yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], ["q", "rows", "cluster", "distance"])

    assigned = staged(distinct.select("q", "rows").mapInArrow(assign, "q array<int>, rows long, cluster int, distance long"), "assigned")
    rows = hot_join(kept, assigned.select("q", "cluster", "distance"), "q", assigned.where(F.col("rows") > HOT).select("q"))
    of = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clusters`` of all embeddings: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _oracle() -> str:
    def assign(k: int) -> str:
        far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"a{k} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.id, c.c, CAST({far} AS HUGEINT) AS d FROM v CROSS JOIN c{k} c) GROUP BY id)"

    def move(k: int) -> str:
        floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        sums = f"SELECT a.c, i, sum(CAST(v.q[i] AS HUGEINT)) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{k} a JOIN v USING (id) CROSS JOIN range(1, {SIZE + 1}) t(i) GROUP BY a.c, i"
        return f"m{k} AS (SELECT c, list({floor} ORDER BY i) AS q FROM ({sums}) GROUP BY c), c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, o.q) AS q FROM c{k} o LEFT JOIN m{k} m USING (c))"

    steps = ",\n".join(f"{assign(k)}, {move(k)}" for k in range(ROUNDS))
    kept = f"len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({STEPS} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {kept}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < {CENTROIDS}),
{steps},
{assign(ROUNDS)},
i AS (SELECT c, sum(d) AS s FROM a{ROUNDS} GROUP BY c)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(i.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (id) JOIN i ON i.c = a.c JOIN c{ROUNDS} c ON c.c = a.c"""


ORACLE = _oracle()
