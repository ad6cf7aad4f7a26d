"""Principal coordinates of a distance table, and the comparison of ordinations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.session import materialise

#: Up to this many samples the centred matrix is built on the driver (and nowhere else above it).
DRIVER_SAMPLES = 2000


@dataclass
class Ordination:
    ids: list[str]
    coordinates: np.ndarray
    eigenvalues: np.ndarray
    proportion: np.ndarray
    negative: int = 0


def both_halves(distances: DataFrame) -> DataFrame:
    return distances.select("sample_i", "sample_j", "distance").unionByName(distances.select(F.col("sample_j").alias("sample_i"), F.col("sample_i").alias("sample_j"), "distance"))


def gower(distances: DataFrame, n: int) -> DataFrame:
    """``sample_i, sample_j, value`` of the double-centred matrix for pairs, and of its diagonal.

    Means are taken over all n samples; the diagonal of the distances is zero.
    """
    square = both_halves(distances).withColumn("d2", F.col("distance") * F.col("distance"))
    means = square.groupBy("sample_i").agg((F.sum("d2") / n).alias("mean"))
    grand = means.agg((F.sum("mean") / n).alias("grand"))
    mi, mj = means.withColumnRenamed("mean", "mi"), means.select(F.col("sample_i").alias("sample_j"), F.col("mean").alias("mj"))
    diagonal = means.select("sample_i", F.col("sample_i").alias("sample_j"), F.lit(0.0).alias("d2"))
    upper = distances.select("sample_i", "sample_j", (F.col("distance") * F.col("distance")).alias("d2")).unionByName(diagonal)
    rows = upper.join(mi, "sample_i").join(mj, "sample_j").crossJoin(F.broadcast(grand))  # one row
    return rows.select("sample_i", "sample_j", (-0.5 * (F.col("d2") - F.col("mi") - F.col("mj") + F.col("grand"))).alias("value"))


def explained_total(distances: DataFrame, n: int) -> float:
    """The sum of all eigenvalues: the trace of the centred matrix."""
    return (distances.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0] or 0.0) / n


def _order(samples: DataFrame) -> list[str]:
    return [r[0] for r in samples.select("sample_id", "sample_ordinal").orderBy("sample_ordinal").collect()]


def _signs(vectors: np.ndarray) -> np.ndarray:
    """The entry of largest magnitude of each axis is positive."""
    if not vectors.size:
        return vectors
    top = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def square_array(distances: DataFrame, ids: list[str]) -> np.ndarray:
    at = {s: i for i, s in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    table = distances.select("sample_i", "sample_j", F.col("distance").cast("double").alias("distance")).toArrow()
    i = np.array([at[s] for s in table["sample_i"].to_pylist()], int)
    j = np.array([at[s] for s in table["sample_j"].to_pylist()], int)
    out[i, j] = out[j, i] = table["distance"].to_numpy()
    return out


def centred(d: np.ndarray) -> np.ndarray:
    b = -0.5 * d * d
    b -= b.mean(axis=0, keepdims=True)
    return b - b.mean(axis=1, keepdims=True)


def exact(d: np.ndarray, ids: list[str], axes: int = 10) -> Ordination:
    values, vectors = np.linalg.eigh(centred(d))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    total = values.sum()
    values_k, k = np.maximum(values[:axes], 0), min(axes, len(ids))
    return Ordination(ids, _signs(vectors[:, :k]) * np.sqrt(values_k), values[:k], values_k / total if total else values_k, int((values < -1e-12 * max(abs(values[0]), 1e-300)).sum()))


def pcoa(distances: DataFrame, samples: DataFrame, axes: int = 10, seed: int = 42, oversample: int = 8, rounds: int = 2, method: str = "exact") -> Ordination:
    """``exact`` on the driver, an error above ``DRIVER_SAMPLES`` samples; ``randomized`` leaves the matrix on the executors."""
    if method == "randomized":
        return randomized(distances, samples, axes, seed, oversample, rounds)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    if (n := samples.count()) > DRIVER_SAMPLES:
        raise ValueError(f"{n} samples are too many for exact coordinates; the randomized method takes any number")
    return exact(square_array(distances, ids := _order(samples)), ids, axes)


def randomized(distances: DataFrame, samples: DataFrame, axes: int = 10, seed: int = 42, oversample: int = 8, rounds: int = 2) -> Ordination:
    """Randomised subspace iteration. Only n x (axes + oversample) numbers meet on the driver; the matrix never does."""
    ids = _order(samples)
    n, width = len(ids), min(axes + oversample, len(ids))
    number = samples.select("sample_id", F.col("sample_ordinal").cast("long").alias("o"))
    rows = (
        both_halves(distances)
        .join(number.select(F.col("sample_id").alias("sample_j"), F.col("o").alias("j")), "sample_j")
        .join(number.select(F.col("sample_id").alias("sample_i"), F.col("o").alias("i")), "sample_i")
        .groupBy("i").agg(F.collect_list(F.struct("j", (-0.5 * F.col("distance") * F.col("distance")).alias("v"))).alias("r"))
        .select("i", F.col("r.j").alias("j"), F.col("r.v").alias("v"))
    )
    rows = materialise(rows, "rows")

    def times(x: np.ndarray) -> np.ndarray:
        """The matrix of -d*d/2 times x."""
        w = x.shape[1]

        def multiply(batches):
            for batch in batches:
                out = np.stack([np.asarray(batch.column("v")[a].values) @ x[np.asarray(batch.column("j")[a].values)] for a in range(batch.num_rows)]) if batch.num_rows else np.zeros((0, w))
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(list(out), pa.list_(pa.float64()))], ["i", "y"])

        table = rows.mapInArrow(multiply, "i long, y array<double>").toArrow()
        y = np.zeros((n, w))
        if table.num_rows:
            y[table["i"].to_numpy()] = table["y"].combine_chunks().flatten().to_numpy().reshape(-1, w)
        return y

    def apply(x: np.ndarray) -> np.ndarray:  # the centred matrix: centre, multiply, centre
        y = times(x - x.mean(axis=0, keepdims=True))
        return y - y.mean(axis=0, keepdims=True)

    q, _ = np.linalg.qr(apply(np.random.default_rng(seed).standard_normal((n, width))))
    for _ in range(rounds):
        q, _ = np.linalg.qr(apply(q))
    small = q.T @ apply(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:axes]
    values, vectors = values[order], q @ vectors[:, order]
    kept, total = np.maximum(values, 0), explained_total(distances, n)
    return Ordination(ids, _signs(vectors) * np.sqrt(kept), values, kept / total if total else kept, int((values < 0).sum()))


def coordinates_frame(spark, o: Ordination) -> DataFrame:
    rows = [(s, a, float(o.coordinates[i, a])) for i, s in enumerate(o.ids) for a in range(o.coordinates.shape[1])]
    return spark.createDataFrame(rows, "sample_id string, axis int, value double")


def eigen_frame(spark, o: Ordination) -> DataFrame:
    return spark.createDataFrame([(a, float(v), float(p)) for a, (v, p) in enumerate(zip(o.eigenvalues, o.proportion, strict=True))], "axis int, eigenvalue double, proportion double")


@dataclass
class Fit:
    disparity: float
    rotation: np.ndarray
    scale: float
    mean_x: np.ndarray
    mean_y: np.ndarray
    residuals: np.ndarray
    p_value: float | None = None

    @property
    def r_squared(self) -> float:
        return 1 - self.disparity


def shared_axes(x: Ordination, y: Ordination, axes: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Coordinates of the ids that both have, in the first one's order."""
    at = {s: i for i, s in enumerate(y.ids)}
    ids = [s for s in x.ids if s in at]
    if len(ids) < 3:
        raise ValueError(f"{len(ids)} ids are shared; at least 3 are needed")
    k = min(axes, x.coordinates.shape[1], y.coordinates.shape[1])
    mine = {s: i for i, s in enumerate(x.ids)}
    return ids, x.coordinates[[mine[s] for s in ids], :k], y.coordinates[[at[s] for s in ids], :k]


def _disparity(x: np.ndarray, y: np.ndarray) -> float:
    return 1 - np.linalg.svd(x.T @ y, compute_uv=False).sum() ** 2


def procrustes(x: np.ndarray, y: np.ndarray) -> Fit:
    """Both centred and scaled to norm one; ``y`` turned (or mirrored) and scaled onto ``x``."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    a, b = x - mx, y - my
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if not na or not nb:
        raise ValueError("all points of an ordination coincide")
    a, b = a / na, b / nb
    u, s, vt = np.linalg.svd(a.T @ b)
    rotation = vt.T @ u.T
    return Fit(1 - s.sum() ** 2, rotation, s.sum() * na / nb, mx, my, np.linalg.norm(a - b @ rotation * s.sum(), axis=1))


def procrustes_test(spark, x: np.ndarray, y: np.ndarray, permutations: int = 999, seed: int = 42) -> Fit:
    """With a permutation p-value; permutations are numbered and run on the executors."""
    fit = procrustes(x, y)
    a, b = x - fit.mean_x, y - fit.mean_y
    a, b, d0 = a / np.linalg.norm(a), b / np.linalg.norm(b), fit.disparity

    def run(batches):
        for batch in batches:
            low = [_disparity(a, b[np.random.default_rng([seed, i]).permutation(len(b))]) <= d0 + 1e-15 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(low)], ["low"])

    hits = spark.range(permutations).mapInArrow(run, "low boolean").filter("low").count()
    fit.p_value = (hits + 1) / (permutations + 1)
    return fit
