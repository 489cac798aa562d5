"""Queries over the test tables, one for each operator, and their SQL twins.

Every query takes whole tables. In the joins the queries are the vectors whose id is
divisible by ten, unless the name says otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simjoin.functions import hashing, hilbert, zorder
from simjoin.functions.metric import L2, l2_sparse
from simjoin.operators import curve, evaluate, kmeans, lsh, pivots, profile
from simjoin.operators.naive import knn_naive
from simjoin.operators.pivot_index import PivotIndex
from simjoin.operators.pivot_join import PivotJoin
from simjoin.operators.topk import best
from simjoin.plans.config import CurveConfig, LshConfig, PivotConfig
from simjoin.plans.knn import knn_join
from simjoin.plans.sweep import SweepConfig, sweep
from simjoin.sources import features, results
from simjoin.sources.shared import shared_folder

K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("key.client_id") % 10 == 0)


def flat(found: DataFrame) -> DataFrame:
    """Plain columns, with distances to five places."""
    return found.select(F.col("query_key.client_id").cast("long").alias("query_id"), F.col("query_class").alias("query_class"), "rank", F.col("db_key.client_id").cast("long").alias("db_id"), F.round(F.col("distance").cast("double"), 5).alias("distance"), "db_class")


def fixed_pivots(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 25 = 0 and vec_id < 500").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], np.float32)


# --- vectors with structure: four measures of lineitem, brought to one scale ---------------
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are order, line and price in cents, which no two rows share."""
    rows = table(spark, sf_dir, "lineitem")
    key = F.struct(F.col("l_orderkey").cast("int").alias("five_minute_id"), F.col("l_linenumber").cast("int").alias("client_id"), F.round(F.col("l_extendedprice") * 100).cast("int").alias("server_id"))
    vector = F.array(*[x.cast("float") for x in (F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 12.5)])
    return rows.select(key.alias("key"), F.col("l_linenumber").cast("int").alias("classification"), vector.alias("vector"))


def asked_items(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("key.five_minute_id") % 20 == 0)


def item_pivots(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = items(spark, sf_dir).where("key.five_minute_id < 300 and key.client_id = 1").orderBy("key").select("vector").collect()
    return np.array([r.vector for r in rows], np.float32)


def flat_items(found: DataFrame) -> DataFrame:
    ids = [F.col(f"{side}_key.{part}").alias(f"{side}_{name}") for side in ("query", "db") for part, name in (("five_minute_id", "order"), ("client_id", "line"), ("server_id", "cents"))]
    return found.select(*ids, "rank", F.round(F.col("distance").cast("double"), 5).alias("distance"))


def item_join(spark: SparkSession, sf_dir: str, **options) -> PivotJoin:
    s = items(spark, sf_dir)
    config = {"pivot_count": 150, "static_count": 4, "groups": 8} | options
    return PivotJoin(asked_items(s), s, K, PivotConfig(**config), item_pivots(spark, sf_dir))


def _items(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat_items(item_join(spark, sf_dir, **options).result())


def item_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects each group of the exact join gets by the lower bound, and how many of these the cut regions leave."""
    of = lambda cut, name: item_join(spark, sf_dir, groups=4, group_objects=None, cut_copies=cut).replicated()[1].groupBy(F.col("g").cast("int").alias("group_id")).agg(F.count("*").alias(name))
    return of(False, "by_bound").join(of(True, "by_region"), "group_id")


def item_cells_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each query's bound excludes, by differences of distances and by planes."""
    found = item_join(spark, sf_dir).exclusions()
    return found.select(F.col("query_key.five_minute_id").alias("query_order"), F.col("query_key.client_id").alias("query_line"), F.col("query_key.server_id").alias("query_cents"), "cells", "by_difference", "by_plane")


def items_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact join over an index that was made of two thirds of the objects and got the others later."""
    s, path = items(spark, sf_dir), f"{shared_folder(spark)}/pivot-index-{uuid.uuid4().hex}"
    late = F.col("key.five_minute_id") % 3 == 0
    PivotIndex.create(s.where(~late), path, 20, static_count=4, pivots=item_pivots(spark, sf_dir)).append(s.where(late))
    return flat_items(PivotJoin(asked_items(s), PivotIndex.open(spark, path), K, PivotConfig(groups=8)).result())


# --- fixed parameters that the SQL twins share -------------------------------------------
# The vectors have hardly nearer neighbours than others, so that an approximate search that
# finds nine tenths of them has to look at most objects; the parameters are chosen for that.
SCALE, RANGE, REACH, SHIFTS = 1000.0, 500, 16, zorder.shifts(64, 10, 500, 937)
CURVE = CurveConfig(shifts=10, range=RANGE, scale=SCALE, entire_buckets=False, partitions=4, reach=REACH)
#: Vectors whose places cut the curves into ranges, in ``knn_curve_buckets``.
CUTS = (120, 240, 360)
_RNG = np.random.default_rng(100)
TABLES = hashing.Tables(_RNG.standard_normal((4, 3, 64)).round(3), _RNG.uniform(0, 12, (4, 3)).round(3), 34.0, _RNG.uniform(-0.01, 0.01, 64).round(4), _RNG.uniform(0.11, 0.14, 64).round(4))
FITTED = LshConfig(tables=6, functions=3, w=26.0, multiplier=1)
#: The same number of functions, those of twice as many that spread half of the vectors most.
SELECTED = LshConfig(tables=6, functions=3, w=34.0, multiplier=2)
CENTROIDS = _RNG.uniform([1, 1000, 0, 0], [50, 90000, 0.1, 0.08], (6, 4)).round(3)


def _joined(method: str, all_queries: bool = False, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = objects(spark, sf_dir)
        return flat(knn_join(s if all_queries else asked(s), s, K, method, **options))

    return run


def _pivot(**parameters) -> Callable[[SparkSession, str], DataFrame]:
    config = PivotConfig(**({"pivot_count": 40, "static_count": 5, "groups": 8} | parameters))
    return _joined("pivot", config=config)


def knn_curve_window(spark: SparkSession, sf_dir: str, only: bool = False) -> DataFrame:
    s = objects(spark, sf_dir)
    config = CurveConfig(**(CURVE.__dict__ | {"only_zorder": only}))
    return flat(curve.knn_curve(asked(s), s, K, config, SHIFTS))


def knn_curve_z_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_curve_window(spark, sf_dir, True)


def knn_curve_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges between the places of given vectors on three curves; a query meets its own range and the ones beside it."""
    s = objects(spark, sf_dir)
    low, _, dim = curve.bounds_of(s)
    shifts = SHIFTS[:3]
    rows = curve.on_curves(s.where(F.col("key.client_id").isin(*CUTS)), shifts, SCALE, low).select("shift", "z").collect()
    after = lambda z: (int.from_bytes(z, "big") + 1).to_bytes(len(z), "big")
    edges = {}
    for shift in range(len(shifts)):
        ends = [*sorted({bytes(r.z) for r in rows if r["shift"] == shift}), zorder.greatest(dim)]
        starts = [zorder.least(dim), *map(after, ends[:-1])]
        edges[shift] = [(starts[i], ends[i], starts[max(0, i - 1)], ends[min(len(ends) - 1, i + 1)]) for i in range(len(ends))]
    config = CurveConfig(shifts=len(shifts), range=RANGE, scale=SCALE)
    return flat(curve.knn_curve(asked(s), s, K, config, shifts, edges))


def knn_curve_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from sketches of both sides, as wide as it takes to hold k objects beyond either end and what a sketch may err."""
    s = objects(spark, sf_dir)
    return flat(curve.knn_curve(asked(s), s, K, CurveConfig(shifts=10, range=RANGE, scale=SCALE, partitions=3), SHIFTS))


def knn_curve_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window search along Hilbert curves."""
    s = objects(spark, sf_dir)
    return flat(curve.knn_curve(asked(s), s, K, CurveConfig(**(CURVE.__dict__ | {"curve": "hilbert"})), SHIFTS))


def hilbert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the Hilbert curve, and the coordinates that they lead back to."""
    s = objects(spark, sf_dir)
    low, _, dim = curve.bounds_of(s)
    rows = curve.on_curves(s, SHIFTS[:2], SCALE, low, "hilbert")

    @F.pandas_udf("array<long>")
    def back(index: pd.Series) -> pd.Series:
        return pd.Series(list(hilbert.decode([bytes(z) for z in index], dim)) if len(index) else [])

    told = F.concat_ws(",", F.transform(back("z"), lambda c: c.cast("string")))
    return rows.select(F.col("key.client_id").cast("long").alias("vec_id"), "shift", F.md5(F.lower(F.hex("z")).cast("binary")).alias("index_md5"), F.md5(told.cast("binary")).alias("coords_md5"))


def knn_curve_one_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects(spark, sf_dir)
    return flat(curve.knn_curve(asked(s), s, K, CurveConfig(**(CURVE.__dict__ | {"entire_buckets": True, "partitions": 1})), SHIFTS))


def zorder_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects(spark, sf_dir)
    low, _, _ = curve.bounds_of(s)
    rows = curve.on_curves(s, SHIFTS, SCALE, low)
    back = F.concat_ws(",", zorder.coordinates("z"))
    return rows.select(F.col("key.client_id").cast("long").alias("vec_id"), "shift", F.md5(zorder.zstring(F.col("coords"))).alias("z_md5"), F.md5(F.lower(F.hex("z")).cast("binary")).alias("z_hex_md5"), F.md5(back.cast("binary")).alias("coords_md5"))


def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects(spark, sf_dir)
    return flat(lsh.knn_lsh(asked(s), s, 5, tables=TABLES))


def lsh_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lsh.bucketed(objects(spark, sf_dir), TABLES)
    return rows.select(F.col("key.client_id").cast("long").alias("vec_id"), F.substring_index("g", ":", 1).cast("int").alias("table_id"), F.substring_index("g", ":", -1).alias("signature"))


def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.dimension_stats(objects(spark, sf_dir)).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def _fixed(spark: SparkSession, sf_dir: str, depth: int = 3) -> PivotJoin:
    s = objects(spark, sf_dir)
    return PivotJoin(asked(s), s, K, PivotConfig(max_rec_depth=depth, static_count=4, groups=4, group_objects=None, method="EXACT_BOUNDS"), fixed_pivots(spark, sf_dir))


def nearest_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixed(spark, sf_dir).database.select(F.col("key.client_id").cast("long").alias("vec_id"), F.posexplode(F.arrays_zip("nearest_pivots", "nearest_dists")).alias("i", "n"))
    return rows.select("vec_id", (F.col("i") + 1).alias("rank"), F.col("n.nearest_pivots").alias("pivot"), F.round(F.col("n.nearest_dists").cast("double"), 5).alias("dist"))


def voronoi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r5 = lambda c: F.round(F.col(c).cast("double"), 5).alias(c)
    kth = F.round(F.element_at("smallest", -1).cast("double"), 5)
    return _fixed(spark, sf_dir).cells().select("pivot_id", "is_database", r5("min_dist"), r5("max_dist"), "n", "size", F.size("smallest").alias("held"), kth.alias("last_held"))


def cut_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _fixed(spark, sf_dir)
    r5 = lambda c: F.round(F.col(c).cast("double"), 5).alias(c)
    names = F.array(*[F.lit(int(i)) for i in plan.static])
    return plan.regions().select("pivot_id", "is_database", F.get(names, F.col("static")).alias("static_pivot"), r5("min_dist"), r5("max_dist"))


def reverse_nearest_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, x) for p, xs in enumerate(pivots.reverse_nearest(fixed_pivots(spark, sf_dir), 3)) for x in xs]
    return spark.createDataFrame(rows, "pivot int, has_it_near int")


def query_upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).upper_bounds().select(F.col("query_key.client_id").cast("long").alias("query_id"), F.round("upper_bound", 4).alias("upper_bound"))


def static_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).static_frame()


def eps_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each neighbour within epsilon: whether it is as near as promised, at the same rank as the exact one."""
    s, epsilon = objects(spark, sf_dir), 1.2
    config = PivotConfig(pivot_count=40, static_count=5, groups=8, method="EPSILON_GUARANTEED", epsilon=epsilon)
    of = lambda df, name: df.select("query_key", "rank", F.col("distance").cast("double").alias(name))
    both = of(knn_join(asked(s), s, K, "pivot", config=config), "got").join(of(knn_naive(asked(s), s, K), "best"), ["query_key", "rank"])
    return both.select(F.col("query_key.client_id").cast("long").alias("query_id"), "rank", (F.col("got") <= epsilon * F.col("best") + 1e-6).alias("holds"))


def approx_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects(spark, sf_dir)
    config = PivotConfig(pivot_count=40, static_count=5, groups=8, max_rec_depth=4, filter_ratio=0.2, method="APPROX_BOUNDS")
    return knn_join(asked(s), s, K, "pivot", config).select(F.col("query_key.client_id").cast("long").alias("query_id"), "upper_bound")


def cell_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_fixed(spark, sf_dir).groups.tolist())), "pivot int, group_id int")


def pivot_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects each group of the exact join gets by the lower bound alone."""
    s = objects(spark, sf_dir)
    plan = PivotJoin(asked(s), s, K, PivotConfig(max_rec_depth=3, static_count=4, groups=4, group_objects=None, cut_copies=False), fixed_pivots(spark, sf_dir))
    return plan.replicated()[1].groupBy(F.col("g").cast("int").alias("group_id")).agg(F.count("*").alias("n"))


def precision_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects(spark, sf_dir)
    q = asked(s)
    found = evaluate.precision_eval(knn_naive(q, s, 5), lsh.knn_lsh(q, s, 5, tables=TABLES), "ge")
    return found.select("k", *[F.round(c, 4).alias(c) for c in found.columns if c != "k"])


def eval_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects(spark, sf_dir)
    base, compare = knn_naive(asked(s), s, 3), knn_naive(s.where("key.client_id % 15 = 0"), s, 3)
    return evaluate.set_relations(base, compare, "eq").select(F.col("query_key.client_id").cast("long").alias("query_id"), "missing_in")


def kth_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects(spark, sf_dir)
    return evaluate.kth_distance_stats(knn_naive(asked(s), s, K), K).select(F.round("avg_dist", 4).alias("avg_dist"), F.round("max_dist", 4).alias("max_dist"))


def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distance_histogram(objects(spark, sf_dir), 1.0, bins=20).select(F.round(F.col("step").cast("double"), 4).alias("step"), "count")


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", 7).select("bin", F.round("start", 4).alias("start"), "count")


def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.min_max(objects(spark, sf_dir)).select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("min_value", "max_value")])


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of small whole numbers, whose text is the same in every engine; most bins are 0."""
    s = objects(spark, sf_dir)
    whole = F.transform("vector", lambda v: F.round(v.cast("double") * 10).cast("float"))
    return features.sparse(s.select("key", "classification", whole.alias("vector")))


def sub_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.sub_dimensions(_scaled(spark, sf_dir), 16)
    return rows.select(F.col("key.client_id").cast("long").alias("vec_id"), F.array_join(F.transform("bin_keys", lambda b: b.cast("string")), ",").alias("bins"), F.array_join(F.transform("bin_values", lambda v: v.cast("int").cast("string")), ",").alias("bin_values"))


def feature_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = features.parse(features.to_lines(_scaled(spark, sf_dir)))
    total = F.aggregate("bin_values", F.lit(0.0), lambda a, v: a + v)
    return back.select(features.format_key(F.col("key")).alias("id"), "classification", F.size("bin_keys").alias("n_bins"), F.element_at("bin_keys", -1).alias("last_bin"), total.cast("int").alias("total"), F.col("other").cast("int").alias("other"))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.dense(_scaled(spark, sf_dir))
    return rows.select(F.col("key.client_id").cast("long").alias("vec_id"), F.array_join(F.transform("vector", lambda v: v.cast("int").cast("string")), ",").alias("vector"))


def sparse_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each record to record 0, in closed form over named bins."""
    rows = _scaled(spark, sf_dir).select("key", F.struct("other", "bin_keys", "bin_values").alias("r"))
    one = rows.where("key.client_id = 0").select(F.col("r").alias("o"))
    joined = rows.join(F.broadcast(one))  # a single row
    return joined.select(F.col("key.client_id").cast("long").alias("vec_id"), F.round(l2_sparse(F.col("r"), F.col("o")).cast("double"), 5).alias("distance"))


def knn_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are, of two defaults: the queries' unnamed bins are 1, the database's 0, on values one higher."""
    s = objects(spark, sf_dir)
    whole = F.transform("vector", lambda v: (F.round(v.cast("double") * 10) + 1).cast("float"))
    rows = s.select("key", "classification", whole.alias("vector"))
    return flat(knn_join(features.sparse(asked(rows), 1.0), features.sparse(rows, 0.0), K, "sparse"))


def knn_text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour lists of whole-number distances, written as lines and read again."""
    s = objects(spark, sf_dir)
    found = knn_naive(asked(s), s, 4).withColumn("distance", F.col("rank").cast("float"))
    lines = results.to_lines(found)
    return flat(results.parse(lines)).select("query_id", "query_class", "rank", "db_id", "distance", "db_class")


def duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("vector"))
    return profile.duplicate_vectors(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("vector"))


def assign_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign_centroid(_suppliers(spark, sf_dir), CENTROIDS).groupBy("cluster").agg(F.count("*").alias("n"))


def bow_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmeans.bow_histogram(kmeans.assign_centroid(_suppliers(spark, sf_dir), CENTROIDS), len(CENTROIDS))
    return rows.select(F.col("id").cast("long").alias("id"), F.array_join(F.transform("histogram", lambda h: h.cast("int").cast("string")), ";").alias("histogram"))


def kmeans_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of squared errors for given centroids, in millions per vector."""
    return kmeans.cost(_suppliers(spark, sf_dir), CENTROIDS).select(F.round(F.col("cost") / F.col("n") / 1e6, 6).alias("mean_error"), "n")


def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.train(objects(spark, sf_dir), 8, 10)
    return spark.createDataFrame([(i, found.cost, c) for i, c in enumerate(found.centroids.tolist())], "cluster int, cost double, centroid array<double>")


def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the times. The approximate methods may visit all cells here, so that they are exact."""
    s = objects(spark, sf_dir)
    found = sweep(asked(s), s, SweepConfig((30,), (5, 8), (4,), (30,), (1.0,), ("EXACT", "APPROX", "QUERY_REP")))
    return found.drop("seconds").withColumn("value", F.round("value", 4))


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths and ratios at which the approximate methods are approximate; without the times."""
    s = objects(spark, sf_dir)
    return sweep(asked(s), s, SweepConfig((30,), (5,), (4,), (1, 3), (0.2, 0.5), ("EXACT", "APPROX", "QUERY_REP"))).drop("seconds")


def replications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of one exact and one heuristic run."""
    s, rows = objects(spark, sf_dir), []
    for method in ("EXACT", "APPROX"):
        plan = PivotJoin(asked(s), s, K, PivotConfig(pivot_count=40, static_count=5, groups=8, max_rec_depth=3, method=method))
        plan.result().count()
        rows += [(method, name, o.get["n"] or 0) for name, o in plan.observed.items()]
    return spark.createDataFrame(rows, "method string, counter string, n long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_naive": _joined("naive"),
    "knn_self_join": _joined("naive", True),
    "knn_pivot_exact": _pivot(),
    "knn_pivot_eps_1": _pivot(method="EPSILON_GUARANTEED"),
    "knn_pivot_approx_full": _pivot(method="APPROX", max_rec_depth=40, filter_ratio=1.0),
    "knn_query_rep_full": _pivot(method="QUERY_REP", max_rec_depth=40, filter_ratio=1.0),
    "knn_pivot_approx": _pivot(method="APPROX", max_rec_depth=16, filter_ratio=0.75),
    "knn_query_rep": _pivot(method="QUERY_REP", max_rec_depth=16, filter_ratio=0.75),
    "knn_eps_guaranteed": _pivot(method="EPSILON_GUARANTEED", epsilon=1.2),
    "knn_eps_approx": _pivot(method="EPSILON_APPROX", epsilon=1.1, max_rec_depth=30),
    "knn_curve_window": knn_curve_window,
    "knn_curve_z_only": knn_curve_z_only,
    "knn_curve_one_bucket": knn_curve_one_bucket,
    "knn_curve_buckets": knn_curve_buckets,
    "knn_curve_sketched": knn_curve_sketched,
    "knn_curve_hilbert": knn_curve_hilbert,
    "hilbert_values": hilbert_values,
    "items_exact": _items(),
    "items_index": items_index,
    "items_approx": _items(method="APPROX", max_rec_depth=8, filter_ratio=0.06),
    "items_query_rep": _items(method="QUERY_REP", max_rec_depth=8, filter_ratio=0.06),
    "items_eps_guaranteed": _items(method="EPSILON_GUARANTEED", epsilon=1.2),
    "items_eps_approx": _items(method="EPSILON_APPROX", epsilon=1.2, max_rec_depth=8),
    "item_copies": item_copies,
    "item_cells_excluded": item_cells_excluded,
    "knn_lsh": knn_lsh,
    "knn_lsh_fitted": _joined("lsh", config=FITTED),
    "knn_lsh_selected": _joined("lsh", config=SELECTED),
}
QUERIES |= {f.__name__: f for f in (zorder_values, lsh_signatures, dimension_stats, nearest_pivots, voronoi_stats, cut_regions, reverse_nearest_pivots, query_upper_bounds, static_pivots, eps_guarantee, approx_bounds, cell_groups, pivot_copies, precision_eval, eval_set_relations, kth_distance_stats, distance_histogram, value_histogram, min_max, sub_dimensions, feature_text_roundtrip, dense_vectors, sparse_distances, knn_sparse, knn_text_format, duplicate_vectors, assign_centroid, bow_histogram, kmeans_cost, kmeans_train, parameter_sweep, sweep_grid, replications)}
