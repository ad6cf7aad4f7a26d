"""Statistics over distance tables: matrix comparison, Mantel, PERMANOVA, neighbours and replicate summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.ordination import both_halves
from cladeframe.session import materialise


def aligned(first: DataFrame, second: DataFrame, least: int = 3) -> DataFrame:
    """``sample_i, sample_j, x, y`` for pairs that both have in whichever order; an error below ``least`` shared ids."""
    a = first.select(F.least("sample_i", "sample_j").alias("sample_i"), F.greatest("sample_i", "sample_j").alias("sample_j"), F.col("distance").alias("x"))
    b = second.select(F.least("sample_i", "sample_j").alias("sample_i"), F.greatest("sample_i", "sample_j").alias("sample_j"), F.col("distance").alias("y"))
    rows = a.join(b, ["sample_i", "sample_j"])
    if (n := rows.limit(least * (least - 1) // 2).count()) < least * (least - 1) // 2:
        raise ValueError(f"{n} pairs are shared; those of {least} ids are needed")
    return rows


def rank_by_counts(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Average ranks by distinct values: ties collapse, ranges of values are ranked side by side.

    Each range adds the count of those before it, a number for each partition.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(value)
    counts = materialise(counts.withColumn("part", F.spark_partition_id()), "counts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = counts.groupBy("part").agg(F.sum("n").alias("in_part")).select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.join(F.broadcast(parts), "part").select(F.col(value).alias("__v"), (F.col("offset") + inside + (F.col("n") + 1) / 2.0).alias(out))
    return rows.join(ranks, rows[value] == ranks["__v"]).drop("__v")


def compare(rows: DataFrame) -> DataFrame:
    """Of ``x`` (truth) and ``y`` in one row: rmse, mae, max_abs_error, bias, pearson, spearman (null without variance)."""
    ranked = rank_by_counts(rank_by_counts(rows.select("x", "y"), "x", "rx"), "y", "ry")
    e = F.col("y") - F.col("x")
    pearson = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return ranked.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_abs_error"), F.avg(e).alias("bias"),
        pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("pairs"),
    )


#: Bytes of one strip of a matrix: a task of Mantel's test holds two, and as much again while it permutes.
STRIP_BYTES = 64 << 20


def _strips(rows: DataFrame, n: int, strip: int) -> DataFrame:
    """``s, i, j, x, y``: rows of both matrices as lists over the other samples, by number, and the strip each is in."""
    from cladeframe.sources.matrices import ordinals

    names = rows.select(F.explode(F.array("sample_i", "sample_j")).alias("sample_id")).distinct()
    number = materialise(ordinals(names), "numbers")
    side = lambda c, k: number.select(F.col("sample_id").alias(c), F.col("sample_ordinal").cast("int").alias(k))
    numbered = rows.join(side("sample_i", "i"), "sample_i").join(side("sample_j", "j"), "sample_j").select("i", "j", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    halves = numbered.unionByName(numbered.select(F.col("j").alias("i"), F.col("i").alias("j"), "x", "y"))
    lists = halves.groupBy("i").agg(F.collect_list(F.struct("j", "x", "y")).alias("v"))  # one list of n for each sample
    return materialise(lists.select((F.col("i") / strip).cast("int").alias("s"), "i", "v.j", "v.x", "v.y"), "strips")


def mantel(rows: DataFrame, permutations: int = 999, seed: int = 42, strip: int | None = None) -> tuple[float, float]:
    """Pearson's r over pairs and its two-sided p-value; ids of ``y`` are permuted.

    Of a permutation only the sum of products changes. Both matrices are cut into strips of rows; a task gets a strip of
    ``x`` and one of ``y``, and adds up, for every permutation, the products of those rows of ``x`` whose row of ``y`` is in
    its strip. So strips meet once, however many permutations there are, and only a sum for each comes back. A pair that
    ``rows`` lacks counts as 0. Without variance r and p are NaN.
    """
    n = rows.select(F.explode(F.array("sample_i", "sample_j")).alias("s")).distinct().count()
    strip = strip or max(1, STRIP_BYTES // (8 * max(n, 1)))
    parts = -(-n // strip)
    whole = rows.agg(*(F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a, b in ("xx", "yy", "xy")), F.sum("x"), F.sum("y")).first()
    xx, yy, xy, x1, y1 = (float(v or 0.0) for v in whole)
    pairs = n * (n - 1) / 2
    spread = float(np.sqrt(max(xx - x1 * x1 / pairs, 0.0) * max(yy - y1 * y1 / pairs, 0.0))) if pairs else 0.0
    if not spread:
        return float("nan"), float("nan")
    lists = _strips(rows, n, strip)
    others = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    as_x = lists.select(F.col("s").alias("sx"), others.alias("sy"), F.lit(True).alias("of_x"), "i", "j", F.col("x").alias("v"))
    as_y = lists.select(others.alias("sx"), F.col("s").alias("sy"), F.lit(False).alias("of_x"), "i", "j", F.col("y").alias("v"))

    def dense(table: pa.Table, first: int) -> np.ndarray:
        out = np.zeros((min(strip, n - first), n))
        for i, j, v in zip(table["i"].to_pylist(), table["j"], table["v"], strict=True):
            out[i - first, j.values.to_numpy()] = v.values.to_numpy()
        return out

    def kernel(table: pa.Table) -> pa.Table:
        sx, sy = table["sx"][0].as_py(), table["sy"][0].as_py()
        x = dense(table.filter(table["of_x"]), sx * strip)
        y = dense(table.filter(pc.invert(table["of_x"])), sy * strip)
        sums = np.zeros(permutations)
        for k in range(permutations):
            p = np.random.default_rng([seed, k]).permutation(n)
            to = p[sx * strip : sx * strip + len(x)] - sy * strip
            mine = np.flatnonzero((to >= 0) & (to < len(y)))
            if len(mine):
                sums[k] = np.einsum("ij,ij->", x[mine], y[to[mine]][:, p])
        return pa.table({"k": pa.array(np.arange(permutations), pa.int64()), "products": pa.array(sums)})

    products = as_x.unionByName(as_y).groupBy("sx", "sy").applyInArrow(kernel, "k long, products double")
    found = products.groupBy("k").agg((F.sum("products") / 2).alias("products")).select("products").toArrow()["products"].to_numpy()  # one for each permutation
    r = (xy - x1 * y1 / pairs) / spread
    hits = int((np.abs((found - x1 * y1 / pairs) / spread) >= abs(r) - 1e-10).sum())
    return r, (hits + 1) / (permutations + 1)


def _ids(distances: DataFrame) -> DataFrame:
    one = lambda c: distances.select(F.col(c).alias("sample_id")).distinct()
    return one("sample_i").unionByName(one("sample_j")).distinct()


def with_groups(distances: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds both samples' groups; an error if a sample has none, or a null one."""
    metadata = metadata.filter(F.col("group").isNotNull())
    names = _ids(distances)
    lost = names.join(metadata, "sample_id", "left_anti").limit(10).collect()
    if lost:
        raise ValueError(f"samples without metadata, such as {[r[0] for r in lost]}")
    i = metadata.select(F.col("sample_id").alias("sample_i"), F.col("group").alias("group_i"))
    j = metadata.select(F.col("sample_id").alias("sample_j"), F.col("group").alias("group_j"))
    return distances.join(i, "sample_i").join(j, "sample_j")


def permanova(distances: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: n, groups, ss_total, ss_within, pseudo_f, r_squared."""
    named = with_groups(distances, metadata)
    members = _ids(distances).join(metadata, "sample_id").groupBy("group").agg(F.count(F.lit(1)).alias("n_g"))
    d2 = F.col("distance") * F.col("distance")
    within = named.filter("group_i = group_j").groupBy(F.col("group_i").alias("group")).agg(F.sum(d2).alias("w"))
    parts = members.join(within, "group", "left").agg(F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("w") / F.col("n_g")), F.lit(0.0)).alias("ss_within"))
    whole = distances.agg(F.sum(d2).alias("all"))
    one = parts.crossJoin(F.broadcast(whole)).withColumn("ss_total", F.col("all") / F.col("n"))  # a row each
    between, dfb, dfw = F.col("ss_total") - F.col("ss_within"), F.col("groups") - 1, F.col("n") - F.col("groups")
    f = (between / dfb) / (F.col("ss_within") / dfw)
    return one.select("n", "groups", "ss_total", "ss_within", f.alias("pseudo_f"), (f * dfb / (f * dfb + dfw)).alias("r_squared"))


def permanova_p(distances: DataFrame, metadata: DataFrame, permutations: int = 999, seed: int = 42) -> tuple[float, float]:
    """Pseudo-F and its permutation p-value.

    Pairs stay where they are: every task draws each permutation of the groups anew and returns one sum for it.
    """
    with_groups(distances, metadata)  # every sample has a group
    samples = metadata.join(_ids(distances), "sample_id", "left_semi").select(F.col("sample_id").alias("s"), F.col("group").alias("g")).orderBy("s").collect()  # one row for each sample
    _, code = np.unique([str(r["g"]) for r in samples], return_inverse=True)
    size, n = np.bincount(code), len(code)
    at = distances.sparkSession.createDataFrame([(r["s"], k) for k, r in enumerate(samples)], "s string, k long")
    pairs = distances.join(at.select(F.col("s").alias("sample_i"), F.col("k").alias("i")), "sample_i").join(at.select(F.col("s").alias("sample_j"), F.col("k").alias("j")), "sample_j")
    pairs = materialise(pairs.select("i", "j", (F.col("distance") * F.col("distance")).cast("double").alias("d2")), "pairs")

    def run(batches):
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if held:
            i, j, d2 = (np.concatenate(c) for c in zip(*held, strict=True))
            sums = []
            for k in range(permutations + 1):
                c = code if k == 0 else np.random.default_rng([seed, k - 1]).permutation(code)
                same = c[i] == c[j]
                sums.append(float((np.bincount(c[i[same]], d2[same], len(size)) / size).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(range(permutations + 1), pa.int64()), pa.array(sums, pa.float64())], ["k", "inner"])

    parts = pairs.mapInArrow(run, "k long, inner double").groupBy("k").agg(F.sum("inner").alias("inner")).orderBy("k").collect()  # one row for each permutation
    total = pairs.agg(F.sum("d2")).first()[0] / n
    inner = np.array([r["inner"] for r in parts])
    f = ((total - inner) / (len(size) - 1)) / (inner / (n - len(size)))
    hits = int((f[1:] >= f[0] * (1 - 1e-9)).sum())
    return float(f[0]), (hits + 1) / (permutations + 1)


def query_split(samples: DataFrame, share: float = 0.05, seed: int = 1337) -> DataFrame:
    """``sample_id, is_query``: the first by a hash of seed and id, at least one and not all."""
    n = samples.count()
    take = min(max(round(n * share), 1), n - 1)
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id"))), "sample_id")
    return samples.select("sample_id", (F.row_number().over(order) <= take).alias("is_query"))


def neighbours(distances: DataFrame, samples: DataFrame, split: DataFrame, k: int = 10) -> DataFrame:
    """``query, neighbour, rank``: the k nearest database samples of each query, ties in sample order."""
    own = both_halves(distances)
    q = split.filter("is_query").select(F.col("sample_id").alias("sample_i"))
    d = split.filter("not is_query").join(samples, "sample_id").select(F.col("sample_id").alias("sample_j"), "sample_ordinal")
    near = own.join(q, "sample_i", "left_semi").join(d, "sample_j")
    rank = F.row_number().over(Window.partitionBy("sample_i").orderBy("distance", "sample_ordinal"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("sample_i").alias("query"), F.col("sample_j").alias("neighbour"), "rank")


def recall(truth: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """``query, recall`` of the true neighbours."""
    hits = truth.select("query", "neighbour").join(found.select("query", "neighbour"), ["query", "neighbour"]).groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    every = truth.groupBy("query").agg(F.count(F.lit(1)).alias("k"))
    return every.join(hits, "query", "left").select("query", (F.coalesce("hits", F.lit(0)) / F.least("k", F.lit(k))).alias("recall"))


def summary(rows: DataFrame, by: list[str], value: str, order: str | None = None) -> DataFrame:
    """Replicates by group: n, mean, sd (one replicate: 0), se, min, max, median, cv and the first by ``order``."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    mean = F.avg(value)
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), mean.alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("se"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.median(value).alias("median"), F.when(mean != 0, sd / mean).alias("cv"),
        F.min_by(value, order or value).alias("first"),
    )


def with_truth(summaries: DataFrame, truth: DataFrame, first: bool = True) -> DataFrame:
    """Summaries with the truth's row, named columns matched, others null."""
    return truth.unionByName(summaries, allowMissingColumns=True) if first else summaries.unionByName(truth, allowMissingColumns=True)


def mean_distances(replicates: DataFrame) -> DataFrame:
    """Over replicates of ``sample_i, sample_j, distance``."""
    return replicates.groupBy("sample_i", "sample_j").agg(F.avg("distance").alias("distance"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, low, high, n`` of equal widths over the values' range."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["lo"] is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, width = float(ends["lo"]), (float(ends["hi"]) - float(ends["lo"])) / bins or 1.0
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("bin") * width + lo).alias("low"), ((F.col("bin") + 1) * width + lo).alias("high"), "n")


def density(rows: DataFrame, value: str, points: int = 200, cells: int = 16384) -> DataFrame:
    """``point, x, density``: Gaussian kernel density at even points over the values' range, by Scott's bandwidth.

    Each value is shared between the two nearest of ``cells + 1`` places, by its distance from them, and the kernel goes over
    the places. So values are read once and combined on the map side, whatever their number; the error is that of moving
    a value by less than a cell. Nulls and what is no number are left out; without spread or values the result is empty.
    """
    v = F.col(value).cast("double")
    known = rows.select(v.alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ends = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n")).first()
    spark = rows.sparkSession
    if not ends["sd"] or not ends["hi"] > ends["lo"]:
        return spark.createDataFrame([], "point int, x double, density double")
    lo, n, h = float(ends["lo"]), int(ends["n"]), float(ends["sd"]) * int(ends["n"]) ** -0.2
    cell, step = (float(ends["hi"]) - lo) / cells, (float(ends["hi"]) - lo) / (points - 1)
    at = (F.col("v") - lo) / cell
    low = F.least(F.floor(at), F.lit(cells - 1))
    share = F.explode(F.array(F.struct(low.alias("place"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("place"), (at - low).alias("w"))))
    places = known.select(share.alias("s")).groupBy(F.col("s.place").alias("place")).agg(F.sum("s.w").alias("w"))
    places = places.select((F.col("place") * cell + lo).alias("g"), "w")  # cells + 1 rows at most
    x = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    z = (F.col("point") * step + lo - F.col("g")) / h
    curve = places.select("g", "w", x).groupBy("point").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("sum"))
    return curve.select("point", (F.col("point") * step + lo).alias("x"), (F.col("sum") / (n * h * float(np.sqrt(2 * np.pi)))).alias("density"))


def estimator_errors(rows: DataFrame, slots: int, slack: float = 0.0) -> DataFrame:
    """One row: whether estimates ``y`` of shares ``x`` (``seed, x, y``) err as equal slots do, of which each counts for itself.

    ``bias_in_bound``: the mean error of a seed, averaged over seeds, lies within three of its standard errors of 0 (and
    ``slack``). ``rmse_in_bound``: the mean square error is between half and one and a half of what theory has, x(1 - x) /
    slots; too small is wrong too. Pairs share samples, so their errors go together: only seeds are independent.
    """
    e = F.col("y") - F.col("x")
    seeds = rows.groupBy("seed").agg(F.avg(e).alias("b"), F.sum(e * e).alias("e2"), F.sum(F.col("x") * (1 - F.col("x")) / slots).alias("v"), F.count(F.lit(1)).alias("pairs"))
    whole = seeds.agg(F.count(F.lit(1)).alias("seeds"), F.max("pairs").alias("pairs"), F.avg("b").alias("bias"), (F.stddev_samp("b") / F.sqrt(F.count(F.lit(1)))).alias("error"), (F.sum("e2") / F.sum("v")).alias("ratio"))
    return whole.select("seeds", "pairs", "bias", "error", "ratio", F.col("ratio").between(0.5, 1.5).alias("rmse_in_bound"), (F.abs("bias") <= 3 * F.col("error") + slack).alias("bias_in_bound"))


def by_depth(totals: DataFrame) -> DataFrame:
    """``place, sample_id, total``, from the least total on; ties by id. Ranges are sorted side by side and count on."""
    spread = totals.select("sample_id", "total").repartitionByRange("total", "sample_id").withColumn("part", F.spark_partition_id())
    spread = materialise(spread, "depths")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("total", "sample_id"))
    return spread.withColumn("own", own).join(parts, "part").select((F.col("offset") + F.col("own")).alias("place"), "sample_id", "total")
