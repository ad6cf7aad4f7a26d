"""Registered queries of the community engine, each with the SQL that gives the same rows.

The SQL spells definitions out (every pair against every branch); the queries take the engine's own way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.operators import branches as B
from cladeframe.operators import clustering as C
from cladeframe.operators import distances as D
from cladeframe.operators import ordination as O
from cladeframe.operators import rarefaction as R
from cladeframe.operators import sketches as H
from cladeframe.operators import statistics as S
from cladeframe.operators import trees as T
from cladeframe.plans import adapters as A
from cladeframe.plans import engines as E
from cladeframe.session import materialise
from cladeframe.sources import matrices, newick, tables
from cladeframe.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PATHS = """paths AS (
  SELECT p_partkey::VARCHAR AS feature_id, -1 - ('0x' || substr(md5(p_brand), 1, 8))::BIGINT AS edge_id, 0.1::DOUBLE AS length FROM part
  UNION ALL SELECT p_partkey::VARCHAR, -8589934592 - ('0x' || substr(md5(p_brand || '|' || p_type), 1, 8))::BIGINT, 0.05::DOUBLE FROM part
  UNION ALL SELECT p_partkey::VARCHAR, p_partkey, p_retailprice / 10000 FROM part)"""
SUPPLIERS = f"""WITH {PATHS},
tab AS (SELECT l_suppkey::VARCHAR AS sample_id, l_partkey::VARCHAR AS feature_id, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
samples AS (SELECT s_suppkey::VARCHAR AS sample_id, row_number() OVER (ORDER BY s_suppkey::VARCHAR) - 1 AS o FROM supplier)"""
NATIONS = f"""WITH {PATHS},
tab AS (SELECT n_name AS sample_id, l_partkey::VARCHAR AS feature_id, sum(l_quantity) AS v FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
samples AS (SELECT n_name AS sample_id, row_number() OVER (ORDER BY n_name) - 1 AS o FROM nation)"""
USERS = """WITH tab AS (SELECT user_id::VARCHAR AS sample_id, event_type AS feature_id, count(*)::DOUBLE AS v FROM events GROUP BY ALL),
paths AS (SELECT DISTINCT event_type AS feature_id, ('0x' || substr(md5(event_type), 1, 8))::BIGINT AS edge_id, 1.0::DOUBLE AS length FROM events),
samples AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS o FROM (SELECT DISTINCT sample_id FROM tab))"""
MARKETS = """WITH tab AS (SELECT o_orderpriority || '|' || year(o_orderdate)::VARCHAR AS sample_id, o_custkey::VARCHAR AS feature_id, count(*)::DOUBLE AS v FROM orders GROUP BY ALL),
paths AS (SELECT c_custkey::VARCHAR AS feature_id, -1 - n_regionkey::BIGINT AS edge_id, 0.5::DOUBLE AS length FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT c_custkey::VARCHAR, -1000 - c_nationkey::BIGINT, 0.3::DOUBLE FROM customer
  UNION ALL SELECT c_custkey::VARCHAR, c_custkey, 0.2::DOUBLE FROM customer),
samples AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS o FROM (SELECT DISTINCT sample_id FROM tab))"""
CORPUS = r"""WITH w AS (SELECT source AS sample_id, unnest(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')) AS feature_id FROM documents),
tab AS (SELECT sample_id, feature_id, count(*)::DOUBLE AS v FROM w WHERE feature_id <> '' GROUP BY ALL),
paths AS (SELECT DISTINCT feature_id, ('0x' || substr(md5(feature_id), 1, 15))::BIGINT AS edge_id, 1.0::DOUBLE AS length FROM tab),
samples AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS o FROM (SELECT DISTINCT sample_id FROM tab))"""

TOTALS = "totals AS (SELECT sample_id, sum(v) AS total FROM tab GROUP BY sample_id)"
REL = "rel AS (SELECT sample_id, feature_id, v / sum(v) OVER (PARTITION BY sample_id) AS value FROM tab)"
MASS = f"{REL}, mass AS (SELECT sample_id, edge_id, max(length) AS length, sum(value) AS mass FROM rel JOIN paths USING (feature_id) GROUP BY ALL)"
RAW = "mass AS (SELECT sample_id, edge_id, max(length) AS length, sum(v) AS mass FROM tab JOIN paths USING (feature_id) GROUP BY ALL)"
PRESENCE = "mass AS (SELECT DISTINCT sample_id, edge_id, length, 1.0::DOUBLE AS mass FROM tab JOIN paths USING (feature_id) WHERE v > 0)"
EVEN = "rel AS (SELECT sample_id, feature_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id) AS value FROM tab), mass AS (SELECT sample_id, edge_id, max(length) AS length, sum(value) AS mass FROM rel JOIN paths USING (feature_id) GROUP BY ALL)"
PAIRS = "pairs AS (SELECT a.sample_id AS sample_i, b.sample_id AS sample_j FROM samples a JOIN samples b ON a.o < b.o)"
EDGES = "edges AS (SELECT DISTINCT edge_id, length FROM paths)"
X = f"""{PAIRS}, {EDGES}, x AS (SELECT sample_i, sample_j, e.length AS l, coalesce(a.mass, 0) AS a, coalesce(b.mass, 0) AS b FROM pairs CROSS JOIN edges e
  LEFT JOIN mass a ON a.sample_id = sample_i AND a.edge_id = e.edge_id LEFT JOIN mass b ON b.sample_id = sample_j AND b.edge_id = e.edge_id)"""
UNWEIGHTED = "d AS (SELECT sample_i, sample_j, coalesce(1 - sum(l * least(a, b)) / nullif(sum(l * greatest(a, b)), 0), 0) AS distance FROM x GROUP BY ALL)"
WEIGHTED = "d AS (SELECT sample_i, sample_j, coalesce(sum(l * abs(a - b)) / nullif(sum(l * (a + b)), 0), 0) AS distance FROM x GROUP BY ALL)"
OUT = "SELECT sample_i, sample_j, round(distance, 6) AS distance FROM d"


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Rounded to six places, so that the order of a sum does not show."""
    return df.withColumns({n: F.round(F.col(n), 6) for n in names or ("distance",)})


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# --- tables, totals, branches -------------------------------------------------------------------------------------


@query(f"{SUPPLIERS} SELECT sample_id, sum(v) AS total FROM tab GROUP BY sample_id")
def a1_sample_totals(spark, d):
    return B.totals(A.suppliers(spark, d).table)


@query(f"{SUPPLIERS}, {REL} SELECT sample_id, feature_id, round(value, 6) AS value FROM rel")
def a2_relative_abundance(spark, d):
    return _six(B.relative(A.suppliers(spark, d).table), "value")


@query(f"{NATIONS}, {PRESENCE} SELECT sample_id, edge_id, round(length, 6) AS length FROM mass")
def a3_branch_presence(spark, d):
    return _six(E.masses(A.nations(spark, d), False).select("sample_id", "edge_id", "length"), "length")


@query(f"{NATIONS}, {MASS} SELECT sample_id, edge_id, round(mass, 6) AS mass, round(mass * length, 6) AS weight FROM mass")
def a4_branch_mass_and_weight(spark, d):
    w = B.branch_weights(E.masses(A.nations(spark, d), True))
    return _six(w.select("sample_id", "edge_id", "mass", "weight"), "mass", "weight")


@query(f"{SUPPLIERS}, {MASS} SELECT sample_id, round(sum(mass * length), 6) AS total_weight FROM mass GROUP BY sample_id")
def a6_baselines(spark, d):
    return _six(B.baselines(B.branch_weights(E.masses(A.suppliers(spark, d), True))), "total_weight")


@query(f"{NATIONS}, {MASS}, {PAIRS} SELECT sample_i, sample_j, round(sum(a.length * least(a.mass, b.mass)), 6) AS shared FROM pairs JOIN mass a ON a.sample_id = sample_i JOIN mass b ON b.sample_id = sample_j AND a.edge_id = b.edge_id GROUP BY ALL")
def a7_shared_minima(spark, d):
    c = A.nations(spark, d)
    return _six(D.shared_minima(B.branch_weights(E.masses(c, True)), c.samples), "shared")


@query(f"{SUPPLIERS}, {PRESENCE} SELECT sample_id, count(*) AS branches, round(count(*) / (SELECT count(DISTINCT edge_id) FROM paths), 6) AS share FROM mass GROUP BY sample_id")
def a8_relevant_branches(spark, d):
    c = A.suppliers(spark, d)
    return _six(B.relevant_counts(E.masses(c, False), c.paths.select("edge_id").distinct().count()), "share")


@query(f"{NATIONS}, {MASS} SELECT edge_id, round(max(mass * length), 6) AS cap FROM mass GROUP BY edge_id")
def a9_caps(spark, d):
    return _six(B.caps(B.branch_weights(E.masses(A.nations(spark, d), True))), "cap")


DEPTH = "depth AS (SELECT feature_id, sum(length) AS depth FROM paths GROUP BY feature_id)"


def _depth(c: E.Community) -> DataFrame:
    return c.paths.groupBy("feature_id").agg(F.sum("length").alias("depth"))


@query(f"{SUPPLIERS}, {REL}, {DEPTH} SELECT sample_id, round(coalesce(sum(depth * value), 0), 6) AS normalization_factor FROM samples LEFT JOIN rel USING (sample_id) LEFT JOIN depth USING (feature_id) GROUP BY sample_id")
def a10_normalization_factors(spark, d):
    c = A.suppliers(spark, d)
    return _six(E.emd_factors(c, _depth(c), True), "normalization_factor")


@query(f"WITH {PATHS} SELECT round(sum(length), 6) AS total FROM (SELECT DISTINCT edge_id, length FROM paths)")
def a11_total_length(spark, d):
    edges = A.catalogue_paths(spark, d).select("edge_id", "length").distinct()
    return _six(edges.agg(F.sum("length").alias("total")), "total")


@query("SELECT event_type AS key, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(coalesce(stddev_samp(value), 0) / sqrt(count(value)), 6) AS se, min(value) AS min, max(value) AS max, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0) / avg(value), 6) AS cv, arg_min(value, event_id) AS first FROM events GROUP BY event_type")
def a12_replicate_summary(spark, d):
    rows = A.read(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", "value")
    return _six(S.summary(rows, ["key"], "value", "event_id"), "mean", "sd", "se", "median", "cv")


@query("SELECT 'truth' AS key, count(value) AS n, round(avg(value), 6) AS mean FROM events UNION ALL SELECT event_type, count(value), round(avg(value), 6) FROM events GROUP BY event_type")
def a13_truth_row(spark, d):
    e = A.read(spark, d, "events")
    truth = e.agg(F.lit("truth").alias("key"), F.count("value").alias("n"), F.avg("value").alias("mean"))
    return _six(S.with_truth(S.summary(e.withColumnRenamed("event_type", "key"), ["key"], "value").select("key", "n", "mean"), truth), "mean")


@query(f"{NATIONS} SELECT sample_id, feature_id, 1.0::DOUBLE AS value FROM tab WHERE v > 0")
def p1_presence(spark, d):
    return B.presence(A.nations(spark, d).table)


@query(f"{NATIONS}, {PRESENCE} SELECT sample_id, o::INT AS sample_ordinal FROM samples WHERE sample_id IN (SELECT sample_id FROM mass)")
def p5_non_empty_samples(spark, d):
    c = A.nations(spark, d)
    return B.non_empty(c.samples, E.masses(c, False))


@query("SELECT event_id, event_id & 65535 AS low16 FROM (SELECT event_id * 7919 AS event_id FROM events)")
def p8_truncated_ids(spark, d):
    from cladeframe.functions import low_bits

    e = A.read(spark, d, "events").select((F.col("event_id") * 7919).alias("event_id"))
    return e.select("event_id", low_bits("event_id", 16).alias("low16"))


@query(f"WITH {PATHS} SELECT edge_id, row_number() OVER (ORDER BY edge_id) - 1 AS dense_id FROM (SELECT DISTINCT edge_id FROM paths)")
def p9_dense_ids(spark, d):
    return B.dense_ids(A.catalogue_paths(spark, d)).withColumn("dense_id", F.col("dense_id").cast("long"))


@query(f"{NATIONS} SELECT DISTINCT feature_id FROM tab WHERE feature_id NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size <= 25)")
def j3_unmatched_taxa(spark, d):
    small = A.read(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").cast("string").alias("feature_id"))
    c = A.nations(spark, d)
    return B.unmatched(c.table, c.paths.join(small, "feature_id", "left_semi"))


@query(f"{SUPPLIERS}, {PAIRS} SELECT sample_i, sample_j FROM pairs")
def j5_sample_pairs(spark, d):
    return D.sample_pairs(A.suppliers(spark, d).samples).select("sample_i", "sample_j")


@query(f"{NATIONS} SELECT feature_id, count(*) AS edges, round(sum(length), 6) AS depth FROM paths WHERE feature_id IN (SELECT feature_id FROM tab WHERE sample_id = 'NATION_1') GROUP BY feature_id")
def j2_observed_subtree(spark, d):
    c = A.nations(spark, d)
    seen = B.observed_paths(c.paths, c.table.filter("sample_id = 'NATION_1'"))
    return _six(seen.groupBy("feature_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("length").alias("depth")), "depth")


# --- distances ------------------------------------------------------------------------------------------------------


@query(f"{SUPPLIERS}, {PRESENCE}, {X}, {UNWEIGHTED} {OUT}")
def m1_unweighted(spark, d):
    return _six(E.exact(A.suppliers(spark, d)))


@query(f"{NATIONS}, {PRESENCE}, {X}, {UNWEIGHTED} {OUT}")
def m1_unweighted_joined(spark, d):
    return _six(E.exact(A.nations(spark, d), method="joined"))


@query(f"{SUPPLIERS}, {MASS}, {X}, {WEIGHTED} {OUT}")
def m2_weighted(spark, d):
    return _six(E.exact(A.suppliers(spark, d), "weighted"))


@query(f"{NATIONS}, {MASS}, {X}, {WEIGHTED} {OUT}")
def m2_weighted_joined(spark, d):
    return _six(E.exact(A.nations(spark, d), "weighted", method="joined"))


@query(f"{MARKETS}, {MASS}, {X}, {WEIGHTED} {OUT}")
def m2_weighted_markets(spark, d):
    return _six(E.exact(A.markets(spark, d), "weighted"))


@query(f"{NATIONS}, {RAW}, {X}, {WEIGHTED} {OUT}")
def m3_raw_counts(spark, d):
    return _six(E.exact(A.nations(spark, d), "weighted", raw_counts=True))


@query(f"{NATIONS}, {MASS}, {X}, d AS (SELECT sample_i, sample_j, coalesce(sum(l * abs(a - b) / sqrt(a + b)) FILTER (a + b > 0) / sum(l * sqrt(a + b)), 0) AS distance FROM x GROUP BY ALL) {OUT}")
def m4_generalized(spark, d):
    return _six(E.exact(A.nations(spark, d), "generalized"))


@query(f"{NATIONS}, {MASS}, {X}, d AS (SELECT sample_i, sample_j, coalesce(sum(l * abs(a - b) / (a + b)) FILTER (a + b > 0), 0) / (SELECT sum(length) FROM edges) AS distance FROM x GROUP BY ALL) {OUT}")
def m4_generalized_zero(spark, d):
    return _six(E.exact(A.nations(spark, d), "generalized", alpha=0.0))


@query(f"""{NATIONS}, {TOTALS}, {MASS}, {X}, y AS (SELECT sample_i, sample_j, l, a, b, ti.total + tj.total AS mt, a * ti.total + b * tj.total AS m FROM x
  JOIN totals ti ON ti.sample_id = sample_i JOIN totals tj ON tj.sample_id = sample_j),
z AS (SELECT *, sqrt(m * (mt - m)) AS r FROM y WHERE a + b > 0 AND m > 0 AND mt - m > 1e-12 * mt),
d AS (SELECT sample_i, sample_j, sum(l * abs(a - b) / r) / sum(l * (a + b) / r) AS distance FROM z GROUP BY ALL) {OUT}""")
def m5_variance_adjusted(spark, d):
    return _six(E.exact(A.nations(spark, d), "variance_adjusted"))


EMD = "d AS (SELECT sample_i, sample_j, sum(l * abs(a - b)) AS distance FROM x GROUP BY ALL)"


@query(f"{NATIONS}, {MASS}, {X}, {EMD} {OUT}")
def m6_emd_weighted(spark, d):
    return _six(E.emd(A.nations(spark, d), True))


@query(f"{NATIONS}, {EVEN}, {X}, {EMD} {OUT}")
def m6_emd_unweighted(spark, d):
    return _six(E.emd(A.nations(spark, d), False, method="joined"))


@query(f"""{USERS}, {REL}, {PAIRS}, s AS (SELECT sample_i, sample_j, feature_id, value AS v FROM pairs JOIN rel ON sample_id = sample_i
  UNION ALL SELECT sample_i, sample_j, feature_id, -value FROM pairs JOIN rel ON sample_id = sample_j),
g AS (SELECT sample_i, sample_j, feature_id AS taxon, sum(v) AS diff FROM s GROUP BY ALL)
SELECT sample_i, sample_j, taxon, 1.0::DOUBLE AS edge_length, round(diff, 6) AS signed_mass_difference, round(abs(diff), 6) AS contribution FROM g WHERE abs(diff) > 1e-14""")
def m7_contributions(spark, d):
    c = A.users(spark, d)
    return _six(E.emd_contributions(c, c.paths.select("feature_id", "length"), True), "signed_mass_difference", "contribution")


@query(f"{NATIONS}, {MASS}, {X}, {EMD}, {DEPTH}, f AS (SELECT sample_id, sum(depth * value) AS f FROM rel JOIN depth USING (feature_id) GROUP BY sample_id) SELECT sample_i, sample_j, round(distance / (i.f + j.f), 6) AS distance FROM d JOIN f i ON i.sample_id = sample_i JOIN f j ON j.sample_id = sample_j")
def m8_emd_normalized(spark, d):
    c = A.nations(spark, d)
    return _six(D.normalized_emd(E.emd(c, True), E.emd_factors(c, _depth(c), True)))


@query(f"{USERS}, {MASS}, {X}, {WEIGHTED} {OUT}")
def m2_star_is_bray_curtis(spark, d):
    return _six(E.exact(A.users(spark, d), "weighted"))


@query(f"{CORPUS}, {PRESENCE}, {PAIRS}, base AS (SELECT sample_id, count(*) AS w FROM mass GROUP BY sample_id), m AS (SELECT sample_i, sample_j, count(*) AS m FROM pairs JOIN mass a ON a.sample_id = sample_i JOIN mass b ON b.sample_id = sample_j AND a.edge_id = b.edge_id GROUP BY ALL) SELECT sample_i, sample_j, round(1 - coalesce(m, 0) / (i.w + j.w - coalesce(m, 0)), 6) AS distance FROM pairs LEFT JOIN m USING (sample_i, sample_j) JOIN base i ON i.sample_id = sample_i JOIN base j ON j.sample_id = sample_j")
def m1_star_is_jaccard(spark, d):
    return _six(E.exact(A.corpus(spark, d)))


# --- sketches -------------------------------------------------------------------------------------------------------

SLOTS = 32
RACE = f"""slots AS (SELECT edge_id, length, slot, -ln((('0x' || substr(md5(edge_id::VARCHAR || ':' || slot::VARCHAR), 1, 12))::BIGINT::DOUBLE + 1.0) / 281474976710657.0::DOUBLE) / length AS t
  FROM (SELECT DISTINCT edge_id, length FROM paths) CROSS JOIN range({SLOTS}) r(slot)),
race AS (SELECT sample_id, slot, arg_min(s.edge_id, t) AS edge_id FROM mass m JOIN slots s ON s.edge_id = m.edge_id GROUP BY ALL)"""


@query(f"{NATIONS}, {PRESENCE}, {RACE} SELECT sample_id, slot, edge_id FROM race")
def h1_exponential_race(spark, d):
    w = B.branch_weights(E.masses(A.nations(spark, d), False))
    return H.race(w, SLOTS).withColumn("slot", F.col("slot").cast("long"))


@query(f"{NATIONS}, {PRESENCE}, {RACE}, {PAIRS} SELECT sample_i, sample_j, round(1 - count(*) FILTER (a.edge_id = b.edge_id) / {SLOTS}, 6) AS distance FROM pairs JOIN race a ON a.sample_id = sample_i JOIN race b ON b.sample_id = sample_j AND a.slot = b.slot GROUP BY ALL")
def m9_unweighted_by_sketch(spark, d):
    c = A.nations(spark, d)
    w = B.branch_weights(E.masses(c, False))
    return _six(H.race_distances(materialise(H.race(w, SLOTS), "race"), c.samples, SLOTS))


@query(f"{NATIONS}, {PRESENCE}, {RACE}, {PAIRS}, q AS (SELECT sample_i, sample_j, count(*) FILTER (a.edge_id <> b.edge_id) / {SLOTS} AS q FROM pairs JOIN race a ON a.sample_id = sample_i JOIN race b ON b.sample_id = sample_j AND a.slot = b.slot GROUP BY ALL) SELECT sample_i, sample_j, round(q, 6) AS hamming, round(q / (2 - q), 6) AS distance FROM q")
def h5_hamming_and_m10(spark, d):
    from cladeframe.functions import hamming, jaccard_to_weighted

    c = A.nations(spark, d)
    sig = H.race(B.branch_weights(E.masses(c, False)), SLOTS).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("slot", "edge_id"))).alias("z")).select("sample_id", F.col("z.edge_id").alias("sig"))
    sig = materialise(sig, "sig")
    i, j = sig.select(F.col("sample_id").alias("sample_i"), F.col("sig").alias("x")), sig.select(F.col("sample_id").alias("sample_j"), F.col("sig").alias("y"))
    q = D.sample_pairs(c.samples).join(i, "sample_i").join(j, "sample_j").withColumn("hamming", hamming("x", "y"))
    return _six(q.select("sample_i", "sample_j", "hamming", jaccard_to_weighted(F.col("hamming")).alias("distance")), "hamming", "distance")


SKETCH_SLOTS = 512


SKETCH_SEEDS = 8


def _sketch_error(spark, d, method: str, weighted: bool) -> DataFrame:
    """Whether sketches are unbiased over seeds and vary as theory has it: by J(1 - J) / k, of the share J of equal slots.

    Rejection sampling may be off by half a hundredth for its borrowed slots.
    """
    c = A.nations(spark, d)
    w = materialise(B.branch_weights(E.masses(c, weighted)), "weights")
    kept = materialise(B.non_empty(c.samples, w), "kept")
    share = (lambda x: (1 - F.col(x)) / (1 + F.col(x))) if weighted else (lambda x: 1 - F.col(x))
    exact = materialise(E.exact(c, "weighted" if weighted else "unweighted"), "exact")
    rows = None
    for seed in range(1, SKETCH_SEEDS + 1):
        found = H.mismatch_distances(H.sketches(w, kept, SKETCH_SLOTS, method, seed, 16, 2048, None if method == "ers" else False), weighted)
        one = S.aligned(exact, found).select(F.lit(seed).alias("seed"), share("x").alias("x"), share("y").alias("y"))
        rows = one if rows is None else rows.unionByName(one)
    checked = S.estimator_errors(rows, SKETCH_SLOTS, 0.005 if method == "ers" else 0.0)
    return checked.select(F.lit(method).alias("method"), F.lit(weighted).alias("weighted"), "pairs", "rmse_in_bound", "bias_in_bound")


for _method in ("dmh", "tmh", "ers"):
    for _weighted in (False, True):
        _name = f"h_{_method}_{'weighted' if _weighted else 'unweighted'}_error"
        QUERIES[_name] = lambda spark, d, m=_method, w=_weighted: _sketch_error(spark, d, m, w)
        ORACLES[_name] = f"{NATIONS}, {PAIRS} SELECT '{_method}' AS method, {str(_weighted).lower()} AS weighted, count(*) AS pairs, true AS rmse_in_bound, true AS bias_in_bound FROM pairs"


# --- statistics -----------------------------------------------------------------------------------------------------

BOTH = f"{NATIONS}, {PRESENCE.replace('mass AS', 'mass_u AS')}, {MASS}, {X}, y AS (SELECT sample_i, sample_j, e.length AS l, coalesce(a.mass, 0) AS a, coalesce(b.mass, 0) AS b FROM pairs CROSS JOIN edges e LEFT JOIN mass_u a ON a.sample_id = sample_i AND a.edge_id = e.edge_id LEFT JOIN mass_u b ON b.sample_id = sample_j AND b.edge_id = e.edge_id), {WEIGHTED}, u AS (SELECT sample_i, sample_j, 1 - sum(l * least(a, b)) / sum(l * greatest(a, b)) AS distance FROM y GROUP BY ALL)"


def _both(spark, d) -> tuple[E.Community, DataFrame, DataFrame]:
    c = A.nations(spark, d)
    return c, materialise(E.exact(c), "u"), materialise(E.exact(c, "weighted"), "w")


@query(f"""{BOTH}, r AS (SELECT u.distance AS x, d.distance AS y FROM u JOIN d USING (sample_i, sample_j)),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM r)
SELECT round(sqrt(avg((y - x) ** 2)), 6) AS rmse, round(avg(abs(y - x)), 6) AS mae, round(max(abs(y - x)), 6) AS max_abs_error, round(avg(y - x), 6) AS bias, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 4) AS spearman, count(*) AS pairs FROM k""")
def o8_matrix_comparison(spark, d):
    _, u, w = _both(spark, d)
    # near ties differ in the last bit between engines; ranks are compared to four places
    return _six(S.compare(S.aligned(u, w)), "rmse", "mae", "max_abs_error", "bias", "pearson").withColumn("spearman", F.round("spearman", 4))


@query(f"{BOTH} SELECT round(corr(u.distance, d.distance), 6) AS r FROM u JOIN d USING (sample_i, sample_j)")
def o6_mantel_statistic(spark, d):
    _, u, w = _both(spark, d)
    r, _ = S.mantel(S.aligned(u, w))
    return _six(spark.createDataFrame([(r,)], "r double"), "r")


@query(f"""{NATIONS}, {MASS}, {X}, {WEIGHTED}, meta AS (SELECT n_name AS sample_id, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT grp, count(*) AS k FROM meta GROUP BY grp),
w AS (SELECT sum(q / k) AS ssw FROM (SELECT a.grp, sum(distance ** 2) AS q FROM d JOIN meta a ON a.sample_id = sample_i JOIN meta b ON b.sample_id = sample_j WHERE a.grp = b.grp GROUP BY a.grp) JOIN n USING (grp)),
t AS (SELECT sum(distance ** 2) / 25 AS sst FROM d)
SELECT 25 AS n, 5 AS groups, round(sst, 6) AS ss_total, round(ssw, 6) AS ss_within, round(((sst - ssw) / 4) / (ssw / 20), 6) AS pseudo_f, round((sst - ssw) / sst, 6) AS r_squared FROM t, w""")
def o7_permanova(spark, d):
    nation, region = A.read(spark, d, "nation"), A.read(spark, d, "region")
    meta = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sample_id"), F.col("r_name").alias("group"))
    w = materialise(E.exact(A.nations(spark, d), "weighted"), "w")
    out = _six(S.permanova(w, meta), "ss_total", "ss_within", "pseudo_f", "r_squared")
    return out.withColumn("n", F.col("n").cast("int")).withColumn("groups", F.col("groups").cast("int"))


def o7_permanova_test(spark, d):
    nation = A.read(spark, d, "nation").select(F.col("n_name").alias("sample_id"), F.col("n_regionkey").cast("string").alias("group"))
    f, p = S.permanova_p(materialise(E.exact(A.nations(spark, d), "weighted"), "w"), nation, 199)
    return spark.createDataFrame([(f, p)], "pseudo_f double, p_value double")


QUERIES["o7_permanova_test"] = o7_permanova_test

SPLIT = "split AS (SELECT sample_id, o, row_number() OVER (ORDER BY md5('1337:' || sample_id), sample_id) <= 5 AS is_query FROM samples)"
HALVES = "h AS (SELECT sample_i, sample_j, distance FROM {0} UNION ALL SELECT sample_j, sample_i, distance FROM {0})"
NEAR = "k AS (SELECT h.sample_i AS query, h.sample_j AS neighbour, row_number() OVER (PARTITION BY h.sample_i ORDER BY round(distance, 9), b.o) AS rank FROM h JOIN split a ON a.sample_id = h.sample_i AND a.is_query JOIN split b ON b.sample_id = h.sample_j AND NOT b.is_query QUALIFY rank <= 5)"


@query(f"{NATIONS} , {SPLIT} SELECT sample_id, is_query FROM split")
def o9_query_split(spark, d):
    return S.query_split(A.nations(spark, d).samples, 0.2)


@query(f"{NATIONS}, {MASS}, {X}, {WEIGHTED}, {SPLIT}, {HALVES.format('d')}, {NEAR} SELECT query, neighbour, rank FROM k")
def t1_nearest_neighbours(spark, d):
    c = A.nations(spark, d)
    near = E.nearest(c, S.query_split(c.samples, 0.2), 5, "weighted", digits=9)
    return near.select("query", "neighbour", F.col("rank").cast("long").alias("rank"))


@query(f"{BOTH}, {SPLIT}, {HALVES.format('d')}, {NEAR}, h2 AS (SELECT sample_i, sample_j, distance FROM u UNION ALL SELECT sample_j, sample_i, distance FROM u), {NEAR.replace('k AS', 'k2 AS').replace('h.', 'h2.').replace('FROM h ', 'FROM h2 ')} SELECT k2.query, count(k.query) / 5 AS recall FROM k2 LEFT JOIN k USING (query, neighbour) GROUP BY k2.query")
def o10_recall(spark, d):
    c = A.nations(spark, d)
    split = S.query_split(c.samples, 0.2)
    return S.recall(*(E.nearest(c, split, 5, metric, digits=9) for metric in ("unweighted", "weighted")), 5)


@query(f"{SUPPLIERS} SELECT row_number() OVER (ORDER BY sum(v), sample_id) AS place, sample_id, sum(v) AS total FROM tab GROUP BY sample_id")
def t2_depths(spark, d):
    return S.by_depth(B.totals(A.suppliers(spark, d).table))


@query("""WITH e AS (SELECT p_retailprice / 10000 AS v FROM part), s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 40 AS step, stddev_samp(v) * count(*) ** -0.2 AS h, count(*) AS n FROM e)
SELECT i::INT AS point, round(lo + i * step, 6) AS x, round(sum(exp(-(((lo + i * step - v) / h) ** 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density FROM e, s, range(41) r(i) GROUP BY i, lo, step""")
def o20_density(spark, d):
    """Of the leaves' branch lengths; the SQL adds a kernel for every value."""
    return _six(S.density(A.catalogue_paths(spark, d).filter("edge_id >= 0"), "length", 41), "x").withColumn("density", F.round("density", 4))


@query(f"{NATIONS}, {PRESENCE}, {X}, {UNWEIGHTED} {OUT}")
def o2_pcoa_rebuilt_distances(spark, d):
    """Roots of the unweighted distances lie in a Euclidean space: all axes together give the distances back."""
    c = A.nations(spark, d)
    root = materialise(E.exact(c), "u").withColumn("distance", F.sqrt("distance"))
    at = materialise(O.coordinates_frame(spark, O.pcoa(root, c.samples, c.samples.count())), "at")
    i, j = at.select(F.col("sample_id").alias("sample_i"), "axis", F.col("value").alias("x")), at.select(F.col("sample_id").alias("sample_j"), "axis", F.col("value").alias("y"))
    apart = F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("distance")
    return _six(D.sample_pairs(c.samples).join(i, "sample_i").join(j, ["sample_j", "axis"]).groupBy("sample_i", "sample_j").agg(apart))


@query(f"""{NATIONS}, {MASS}, {X}, {WEIGHTED}, {HALVES.format('d')}, m AS (SELECT sample_i AS s, sum(distance ** 2) / 25 AS m FROM h GROUP BY sample_i), g AS (SELECT sum(m) / 25 AS g FROM m),
r AS (SELECT sample_i, sample_j, distance ** 2 AS q FROM d UNION ALL SELECT s, s, 0 FROM m)
SELECT sample_i, sample_j, round(-0.5 * (q - i.m - j.m + g), 6) + 0.0 AS value FROM r JOIN m i ON i.s = sample_i JOIN m j ON j.s = sample_j, g""")
def o1_gower_centred(spark, d):
    return _six(O.gower(materialise(E.exact(A.nations(spark, d), "weighted"), "w"), 25), "value").withColumn("value", F.col("value") + 0.0)


def o1_pcoa(spark, d):
    c, _, w = _both(spark, d)
    return O.coordinates_frame(spark, O.pcoa(w, c.samples, 5))


def o1_pcoa_randomized(spark, d):
    c, _, w = _both(spark, d)
    return O.eigen_frame(spark, O.pcoa(w, c.samples, 5, method="randomized"))


def o4_procrustes(spark, d):
    c, u, w = _both(spark, d)
    _, x, y = O.shared_axes(O.pcoa(u, c.samples), O.pcoa(w, c.samples))
    fit = O.procrustes_test(spark, x, y, 99)
    return spark.createDataFrame([(float(fit.disparity), float(fit.r_squared), float(fit.scale), float(fit.p_value))], "disparity double, r_squared double, scale double, p_value double")


#: Clustering by the rule, one merge after the other: the nearest clusters (of equal distances those of the least leaves) of
#: every tree ``g`` in ``dist(g, sample_i, sample_j, distance)``. ``merges`` has the clade's leaves and its name.
CLUSTERED = """
lab AS (SELECT sample_id, {'id': o, 'n': 1::BIGINT, 'a': ('0x' || substr(md5(sample_id), 1, 15))::BIGINT, 'b': ('0x' || substr(md5(sample_id), 16, 15))::BIGINT, 'l': [o]} AS c FROM samples),
p AS (SELECT g, 0 AS step, least(i.c, j.c) AS x, greatest(i.c, j.c) AS y, round(distance * 10000000000)::HUGEINT AS s FROM dist JOIN lab i ON i.sample_id = sample_i JOIN lab j ON j.sample_id = sample_j
  UNION ALL
  SELECT g, step + 1, least(x2, y2), greatest(x2, y2), sum(s)::HUGEINT FROM (
    SELECT g, step, s, CASE WHEN x.id IN (m.i, m.j) THEN m.c ELSE x END AS x2, CASE WHEN y.id IN (m.i, m.j) THEN m.c ELSE y END AS y2 FROM (
      SELECT *, first_value({'i': x.id, 'j': y.id, 'c': {'id': x.id, 'n': x.n + y.n, 'a': xor(x.a, y.a), 'b': xor(x.b, y.b), 'l': list_concat(x.l, y.l)}})
        OVER (PARTITION BY g ORDER BY s::DOUBLE / (x.n * y.n), x.id, y.id) AS m FROM p))
  WHERE x2.id <> y2.id GROUP BY g, step, least(x2, y2), greatest(x2, y2)),
merges AS (SELECT g, step, m.x.id AS i, m.y.id AS j, m.x.n + m.y.n AS n, m.h / 1e10 AS height, xor(m.x.a, m.y.a) AS a, xor(m.x.b, m.y.b) AS b, m.x.l AS li, m.y.l AS lj FROM (
  SELECT g, step, arg_min({'x': x, 'y': y, 'h': s::DOUBLE / (x.n * y.n)}, {'h': s::DOUBLE / (x.n * y.n), 'i': x.id, 'j': y.id}) AS m FROM p GROUP BY g, step)),
every AS (SELECT count(*) AS total, bit_xor(c.a) AS ta, bit_xor(c.b) AS tb FROM lab),
unrooted AS (SELECT DISTINCT g, CASE WHEN n * 2 < total THEN {'a': a, 'b': b} WHEN n * 2 > total THEN {'a': xor(a, ta), 'b': xor(b, tb)}
    ELSE least({'a': a, 'b': b}, {'a': xor(a, ta), 'b': xor(b, tb)}) END AS split, least(n, total - n) AS size FROM merges, every WHERE least(n, total - n) > 1)"""
BOTH_TREES = f"{BOTH.replace('WITH paths', 'WITH RECURSIVE paths')}, dist AS (SELECT 'u' AS g, * FROM u UNION ALL SELECT 'w', * FROM d), {CLUSTERED}"


@query(f"""{BOTH_TREES}, m AS (SELECT * FROM merges WHERE g = 'w')
SELECT step, least(l, r) AS left, greatest(l, r) AS right, round(height, 6) AS height, n AS size FROM (SELECT step, height, n,
  coalesce((SELECT max(p.step) FROM m p WHERE p.i = m.i AND p.step < m.step) + (SELECT total FROM every), m.i) AS l,
  coalesce((SELECT max(p.step) FROM m p WHERE p.i = m.j AND p.step < m.step) + (SELECT total FROM every), m.j) AS r FROM m)""")
def o11_linkage(spark, d):
    c, _, w = _both(spark, d)
    return _six(T.linkage(w, c.samples).select("step", "left", "right", "height", "size"), "height")


def _cophenetic(spark, d) -> DataFrame:
    """``sample_i, sample_j, x, y``: cophenetic distances of the unweighted and of the weighted tree."""
    c, u, w = _both(spark, d)
    return S.aligned(*(T.cophenetic(T.linkage(table, c.samples), c.samples) for table in (u, w)))


COPHENETIC = f"""{BOTH_TREES}, h AS (SELECT g, p, unnest(lj) AS q, height FROM (SELECT g, unnest(li) AS p, lj, height FROM merges)),
r AS (SELECT i.sample_id AS sample_i, j.sample_id AS sample_j, u.height AS x, w.height AS y FROM h u JOIN h w ON least(u.p, u.q) = least(w.p, w.q) AND greatest(u.p, u.q) = greatest(w.p, w.q)
  JOIN samples i ON i.o = least(u.p, u.q) JOIN samples j ON j.o = greatest(u.p, u.q) WHERE u.g = 'u' AND w.g = 'w')"""


@query(f"{COPHENETIC} SELECT least(sample_i, sample_j) AS sample_i, greatest(sample_i, sample_j) AS sample_j, round(x, 6) AS x, round(y, 6) AS y FROM r")
def o12_cophenetic(spark, d):
    return _six(_cophenetic(spark, d), "x", "y")


@query(f"""{COPHENETIC},
k AS (SELECT x, y, rank() OVER (ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY round(x, 9)) - 1) / 2 AS rx, rank() OVER (ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY round(y, 9)) - 1) / 2 AS ry FROM r)
SELECT round(sqrt(avg((y - x) ** 2)), 6) AS rmse, round(avg(abs(y - x)), 6) AS mae, round(max(abs(y - x)), 6) AS max_abs_error, round(avg(y - x), 6) AS bias, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 4) AS spearman, count(*) AS pairs FROM k""")
def o12_cophenetic_comparison(spark, d):
    rows = _cophenetic(spark, d).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
    return _six(S.compare(rows), "rmse", "mae", "max_abs_error", "bias", "pearson").withColumn("spearman", F.round("spearman", 4))


@query(f"""{BOTH_TREES}, s AS (SELECT 'rooted' AS kind, g, {{'a': a, 'b': b}} AS split FROM merges, every WHERE n > 1 AND n < total UNION ALL SELECT 'unrooted', g, split FROM unrooted),
c AS (SELECT kind, split, count(DISTINCT g) AS trees FROM s GROUP BY ALL)
SELECT kind, count(*) FILTER (trees = 1) AS rf, round(count(*) FILTER (trees = 1) / sum(trees), 6) AS normalized_rf, count(*) FILTER (trees = 2) AS shared FROM c GROUP BY kind""")
def o14_robinson_foulds(spark, d):
    c, u, w = _both(spark, d)
    n = c.samples.count()
    a, b = (T.linkage(table, c.samples) for table in (u, w))
    kinds = {"rooted": T.rooted_clades, "unrooted": T.unrooted_splits}
    both = [[f(z, n).select(F.lit(kind).alias("kind"), "split") for kind, f in kinds.items()] for z in (a, b)]
    return _six(T.robinson_foulds(*(x.unionByName(y) for x, y in both), by=["kind"]), "normalized_rf")


def o16_neighbour_joining(spark, d):
    c, _, w = _both(spark, d)
    ids = [r[0] for r in c.samples.orderBy("sample_ordinal").select("sample_id").collect()]
    return newick.tree_nodes(spark, newick.write(C.neighbour_joining(O.square_array(w, ids), ids))).drop("path")


def o19_sketch_sweep(spark, d):
    from cladeframe.plans import sweeps

    c = A.nations(spark, d)
    return sweeps.summarise(sweeps.sweep(c, E.exact(c, "weighted"), True, sizes=(64, 256), seeds=(1, 2), portable=True))


for _f in (o19_sketch_sweep, o1_pcoa, o1_pcoa_randomized, o4_procrustes, o16_neighbour_joining):
    QUERIES[_f.__name__] = _f

RAREFIED = """e AS (SELECT sample_id, feature_id, unnest(range(1, v::BIGINT + 1)) AS k FROM tab WHERE sample_id IN (SELECT sample_id FROM tab GROUP BY sample_id HAVING sum(v) >= {0})),
rr AS (SELECT sample_id, feature_id FROM e QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY md5('42:{1}:' || sample_id || ':' || feature_id || ':' || k::VARCHAR), feature_id, k) <= {0}),
rare AS (SELECT sample_id, feature_id, count(*)::DOUBLE AS value FROM rr GROUP BY ALL)"""


@query(f"{USERS}, {RAREFIED.format(20, 0)} SELECT 0 AS replicate, sample_id, feature_id, value FROM rare")
def o15_rarefaction(spark, d):
    return R.rarefied(A.users(spark, d).table, 20)


def o15_rarefaction_drawn(spark, d):
    return R.drawn(A.users(spark, d).table, 20)


QUERIES["o15_rarefaction_drawn"] = o15_rarefaction_drawn

REPLICATES = 50
#: Unweighted distances of every replicate's rarefied table, by a join on branches.
REPLICATED = f"""{MARKETS.replace('WITH tab', 'WITH RECURSIVE tab')},
e AS (SELECT g, sample_id, feature_id, unnest(range(1, v::BIGINT + 1)) AS k FROM tab, range({REPLICATES}) t(g) WHERE sample_id IN (SELECT sample_id FROM tab GROUP BY sample_id HAVING sum(v) >= 30)),
rr AS (SELECT g, sample_id, feature_id FROM e QUALIFY row_number() OVER (PARTITION BY g, sample_id ORDER BY md5('42:' || g::VARCHAR || ':' || sample_id || ':' || feature_id || ':' || k::VARCHAR), feature_id, k) <= 30),
mass AS (SELECT DISTINCT g, sample_id, edge_id, length FROM (SELECT DISTINCT * FROM rr) JOIN paths USING (feature_id)),
whole AS (SELECT g, sample_id, sum(length) AS w FROM mass GROUP BY ALL), {PAIRS},
shared AS (SELECT a.g, a.sample_id AS sample_i, b.sample_id AS sample_j, sum(a.length) AS s FROM mass a JOIN mass b ON a.g = b.g AND a.edge_id = b.edge_id AND a.sample_id <> b.sample_id GROUP BY ALL),
dist AS (SELECT g, sample_i, sample_j, coalesce(1 - coalesce(s, 0) / nullif(coalesce(i.w, 0) + coalesce(j.w, 0) - coalesce(s, 0), 0), 0) AS distance FROM pairs CROSS JOIN range({REPLICATES}) t(g)
  LEFT JOIN shared USING (g, sample_i, sample_j) LEFT JOIN whole i ON i.g = t.g AND i.sample_id = sample_i LEFT JOIN whole j ON j.g = t.g AND j.sample_id = sample_j)"""


def _replicates(spark, d):
    c = A.markets(spark, d)
    return c, lambda table, samples: E.exact(E.Community(table, samples, c.paths))


@query(f"{REPLICATED}, {CLUSTERED} SELECT split.a AS a, split.b AS b, size, round(count(*) / {REPLICATES}, 6) AS support FROM unrooted GROUP BY ALL")
def o18_jackknife_support(spark, d):
    """Support of every split that any replicate's tree has."""
    c, distance = _replicates(spark, d)
    _, _, supports = R.jackknife(c.table, c.samples, distance, depth=30, iterations=REPLICATES)
    return _six(supports.select("split.a", "split.b", "size", "support"), "support")


@query(f"{REPLICATED}, m AS (SELECT sample_i, sample_j, avg(distance) AS distance FROM dist GROUP BY ALL), {CLUSTERED.replace('FROM dist', 'FROM (SELECT 0 AS g, * FROM m)')}, {'one AS (SELECT split, size FROM unrooted)'} SELECT split.a AS a, split.b AS b, size FROM one")
def o18_consensus_splits(spark, d):
    """The splits of the tree of mean distances."""
    c, distance = _replicates(spark, d)
    mean = S.mean_distances(distance(R.rarefied(c.table, 30, replicates=REPLICATES), c.samples))
    return T.unrooted_splits(T.linkage(materialise(mean, "mean"), c.samples), c.samples.count()).select("split.a", "split.b", "size")


@query(f"{REPLICATED} SELECT sample_i, sample_j, round(avg(distance), 6) AS distance FROM dist GROUP BY ALL")
def a14_jackknife_mean(spark, d):
    c, distance = _replicates(spark, d)
    return _six(S.mean_distances(distance(R.rarefied(c.table, 30, replicates=REPLICATES), c.samples)))


@query("WITH e AS (SELECT value, min(value) OVER () AS lo, (max(value) OVER () - min(value) OVER ()) / 20 AS w FROM events) SELECT least(floor((value - lo) / w), 19)::INT AS bin, count(*) AS n FROM e GROUP BY bin")
def o20_histogram(spark, d):
    return S.histogram(A.read(spark, d, "events"), "value", 20).select("bin", "n")


# --- sources, sinks, streams ----------------------------------------------------------------------------------------


@query(f"{MARKETS} SELECT sample_id, feature_id, v AS value FROM tab")
def s4_dense_table(spark, d):
    """Written wide, one column for each sample, and read back."""
    c = A.markets(spark, d)
    names = [r[0] for r in c.samples.orderBy("sample_ordinal").select("sample_id").collect()]
    wide = c.table.groupBy("feature_id").pivot("sample_id", names).agg(F.first("value")).fillna(0)
    lines = wide.select(F.lit(1).alias("i"), F.concat_ws("\t", "feature_id", *(F.col(f"`{n}`").cast("string") for n in names)).alias("line"))
    head = spark.createDataFrame([(0, "\t".join(["#", *names]))], "i int, line string")
    from cladeframe.session import shared_folder
    import uuid

    path = f"{shared_folder(spark)}/dense-{uuid.uuid4().hex[:12]}"
    head.unionByName(lines).repartition(1).sortWithinPartitions("i").select("line").write.text(path)
    return tables.read_dense(spark, path)[0]


@query(f"{MARKETS} SELECT sample_id, feature_id, 1.0::DOUBLE AS value FROM tab")
def s3_presence_from_wide(spark, d):
    c = A.markets(spark, d)
    return tables.from_wide(c.table.groupBy("feature_id").pivot("sample_id").agg(F.first("value").cast("string")), "feature_id", presence=True)


@query(f"{USERS} SELECT sample_id, feature_id, v AS value FROM tab")
def s6_sparse_rows(spark, d):
    """The table as compressed sparse rows, checked, and as a table again."""
    c = A.users(spark, d)
    rows = c.table.join(c.samples, "sample_id").groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("sample_ordinal", "value"))).alias("e")).orderBy("feature_id").collect()
    samples = [r[0] for r in c.samples.orderBy("sample_ordinal").select("sample_id").collect()]
    indptr, indices, values = [0], [], []
    for r in rows:
        indices += [x["sample_ordinal"] for x in r["e"]]
        values += [x["value"] for x in r["e"]]
        indptr.append(len(indices))
    return tables.from_csr(spark, [r["feature_id"] for r in rows], samples, indptr, indices, values)


@query(f"{USERS} SELECT sample_id, array_to_string(list(feature_id ORDER BY feature_id), ',') AS features, sum(v) AS total FROM tab GROUP BY sample_id")
def s11_sample_columns(spark, d):
    return tables.to_csc(A.users(spark, d).table).select("sample_id", F.array_join("features", ",").alias("features"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query(f"{SUPPLIERS} SELECT sample_id, count(*) AS features FROM tab WHERE sample_id IN (SELECT sample_id FROM tab GROUP BY sample_id HAVING sum(v) >= 15000) GROUP BY sample_id")
def s15_depth_filter(spark, d):
    return tables.deep_enough(A.suppliers(spark, d).table, 15000).groupBy("sample_id").agg(F.count(F.lit(1)).alias("features"))


@query(f"{NATIONS}, {MASS}, {X}, {WEIGHTED} {OUT}")
def s12_matrix_round_trip(spark, d):
    from cladeframe.session import shared_folder
    import uuid

    c = A.nations(spark, d)
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex[:12]}"
    matrices.write_matrix(E.exact(c, "weighted"), c.samples, path)
    return _six(matrices.read_matrix(spark, path)[0])


@query(f"""{NATIONS}, {MASS}, {X}, {WEIGHTED}, h AS (SELECT sample_i, sample_j, distance FROM d UNION ALL SELECT sample_j, sample_i, distance FROM d UNION ALL SELECT sample_id, sample_id, 0 FROM samples)
SELECT 'Sample' || chr(9) || string_agg(sample_id, chr(9) ORDER BY o) AS line FROM samples UNION ALL
SELECT sample_i || chr(9) || string_agg(printf('%.4f', distance), chr(9) ORDER BY o) FROM h JOIN samples ON sample_j = sample_id GROUP BY sample_i""")
def k1_matrix_in_one_file(spark, d):
    """The matrix as one plain file, written by many tasks and read again."""
    import uuid

    from cladeframe.session import shared_folder

    c = A.nations(spark, d)
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex[:12]}.tsv"
    matrices.write_matrix_file(E.exact(c, "weighted"), c.samples, path, digits=4, label="Sample")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"""{NATIONS}, {MASS}, {X}, {WEIGHTED}, h AS (SELECT sample_i, sample_j, distance FROM d UNION ALL SELECT sample_j, sample_i, distance FROM d UNION ALL SELECT sample_id, sample_id, 0 FROM samples)
SELECT 'Sample' || chr(9) || string_agg(sample_id, chr(9) ORDER BY o) AS line FROM samples UNION ALL
SELECT sample_i || chr(9) || string_agg(printf('%.4f', distance), chr(9) ORDER BY o) FROM h JOIN samples ON sample_j = sample_id GROUP BY sample_i""")
def k5_matrix_lines(spark, d):
    c = A.nations(spark, d)
    return matrices.matrix_lines(E.exact(c, "weighted"), c.samples, digits=4, label="Sample").select("line")


@query("SELECT user_id, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS seconds FROM events GROUP BY user_id")
def s16_log_seconds(spark, d):
    e = A.read(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    lines = e.select("user_id", F.concat(F.lit("["), stamp, F.lit("Z INFO] nodes = 1, pairwise distances")).alias("value"))
    return matrices.log_seconds(lines, by="user_id")


@query("""WITH RECURSIVE t AS (SELECT r_regionkey + 1 AS node, 0 AS parent, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey + 1, n_name FROM nation),
up AS (SELECT node, parent, name, 1 AS steps FROM t UNION ALL SELECT up.node, t.parent, up.name, steps + 1 FROM up JOIN t ON up.parent = t.node)
SELECT name, max(steps) AS above FROM up WHERE node >= 100 GROUP BY name""")
def s1_newick_tree(spark, d):
    """Regions and nations as Newick text, parsed; the number of branches above each leaf."""
    rows = A.read(spark, d, "nation").join(A.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("n")).orderBy("r_name").collect()
    text = "(" + ",".join("(" + ",".join(f"{n}:1" for n in r["n"]) + f")0.9[{r['r_name']}]:0.5" for r in rows) + ");"
    paths = newick.tree_paths(newick.tree_nodes(spark, text))
    return paths.groupBy(F.col("feature_id").alias("name")).agg(F.count(F.lit(1)).cast("int").alias("above"))


@query("SELECT 100 + n_nationkey AS node_id, count(*) AS edges FROM (SELECT n_nationkey, unnest([0, 1, 2]) FROM nation) GROUP BY n_nationkey")
def j4_ancestor_closure(spark, d):
    """Ancestors from a table of parents alone."""
    nation = A.read(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("node_id"), (F.col("n_regionkey") + 1).alias("parent_id"))
    region = A.read(spark, d, "region").select((F.col("r_regionkey") + 1).alias("node_id"), F.lit(0).alias("parent_id"))
    root = spark.createDataFrame([(0, None)], "node_id int, parent_id int")
    reach = newick.closure(spark, nation.unionByName(region).unionByName(root))
    return reach.filter("node_id >= 100").groupBy("node_id").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT user_id::VARCHAR AS sample_id, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY user_id")
def x1_streaming_totals(spark, d):
    events = materialise(A.read(spark, d, "events").select("user_id", "value").repartition(3), "events")
    return _six(incremental.running_totals(spark, events.inputFiles()[0].rsplit("/", 1)[0], "user_id", "value"), "total")


@query("SELECT date_trunc('day', ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def x2_streaming_windows(spark, d):
    # naive times as UTC, whatever the session's zone
    utc = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    events = materialise(A.read(spark, d, "events").select(utc.alias("ts"), "event_type", "value").repartition(3), "events")
    out = incremental.windowed_totals(spark, events.inputFiles()[0].rsplit("/", 1)[0], "ts", "event_type", "value", late="36500 days")
    naive = F.expr("timestampadd(MICROSECOND, unix_micros(window_start), timestamp_ntz'1970-01-01 00:00:00')")
    return _six(out.withColumn("window_start", naive), "total")


@query("""WITH e AS (SELECT *, CASE WHEN event_id % 10 < 2 THEN 7 - event_id % 10 ELSE date_diff('day', lo, ts) * 6 // (date_diff('day', lo, hi) + 1) END AS batch FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events)),
m AS (SELECT b.batch, max(ts) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT batch FROM e) b JOIN e ON e.batch <= b.batch - 2 GROUP BY b.batch)
SELECT date_trunc('day', ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 6) AS total FROM e LEFT JOIN m USING (batch)
WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY ALL""")
def x2_streaming_late_rows(spark, d):
    """Events in order of time, but for a fifth that come last: those whose day is closed by then are dropped."""
    from cladeframe.session import shared_folder
    import uuid

    events = A.read(spark, d, "events")
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    day = lambda c: F.datediff(F.col(c), F.col("lo"))
    batch = F.when(F.col("event_id") % 10 < 2, 7 - F.col("event_id") % 10).otherwise(F.floor(day("ts") * 6 / (day("hi") + 1)))
    utc = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    rows = materialise(events.crossJoin(F.broadcast(ends)).select(utc.alias("ts"), "event_type", "value", batch.cast("int").alias("batch")), "events")
    path = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex[:12]}"
    for k in range(8):  # a file for each, older ones first
        rows.filter(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(path)
    out = incremental.windowed_totals(spark, path, "ts", "event_type", "value", files_per_batch=1)
    naive = F.expr("timestampadd(MICROSECOND, unix_micros(window_start), timestamp_ntz'1970-01-01 00:00:00')")
    return _six(out.withColumn("window_start", naive), "total")


@query(f"{NATIONS}, {PRESENCE}, {RACE} SELECT sample_id, slot, edge_id FROM race")
def x3_streamed_sketches(spark, d):
    """Every nation's rows are spread over three batches; merged minima are the sketch of the whole."""
    c = A.nations(spark, d)
    rows = materialise(c.table.repartition(3, "feature_id"), "rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    return incremental.raced_stream(stream, c.paths, SLOTS).withColumn("slot", F.col("slot").cast("long"))
