"""Per-type k-means with k = n / 5 (CLU-1..CLU-4) and the cluster report (AGG-8).

k grows with n, so global Lloyd iterations cost O(n * k) per pass.  Each
type is cut into buckets of at most ``max_bucket_rows`` distinct points: a
small type is one bucket; a larger one is halved again and again at the mean
of its widest dimension, one distributed pass a level.  Every bucket is
clustered by a numpy k-means in ``applyInPandas``; the buckets' shares of k
are apportioned so that they add up to k = n // 5 at every size.

For a type of several buckets that is the start: distributed Lloyd passes
over the whole type follow, in which every point moves to its nearest centre
wherever that lies (`nearest.assign_nearest`, pruned by the triangle
inequality), until the cost falls by less than a tolerance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators.nearest import assign_nearest
from wordloom.operators.vectors import as_double
from wordloom.session import checked_broadcast, ensure_checkpoint_dir


def cluster_count(n, per_cluster: int = fixed.MEMBERS_PER_CLUSTER) -> Column:
    """CLU-1: k = n // 5, at least 1."""
    return F.greatest(F.floor(T._c(n) / per_cluster), F.lit(1)).cast("int")


def cluster_sizes(df: DataFrame, type_col: str = "type", per_cluster: int = fixed.MEMBERS_PER_CLUSTER) -> DataFrame:
    return df.groupBy(type_col).agg(F.count(F.lit(1)).alias("n")).withColumn("k", cluster_count("n", per_cluster))


def nearest_centroid(points: DataFrame, vec_col: str, centroids: list[tuple[int, list[float]]],
                     out: str = "cluster") -> DataFrame:
    """CLU-4: index of the nearest centroid (squared Euclidean; ties to the smaller id).

    ``centroids`` is a short driver-side list; it becomes one literal array,
    so assignment is a projection with no join.  For more centroids than fit
    in a plan see `nearest.assign_nearest`.
    """
    lit = F.array(*[F.struct(F.lit(int(c)).alias("id"), F.array(*[F.lit(float(x)) for x in v]).alias("c"))
                    for c, v in centroids])
    v = as_double(vec_col)

    def best(pv):
        d = F.transform(lit, lambda cen: F.struct(
            F.aggregate(F.zip_with(pv, cen["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                        lambda acc, x: acc + x).alias("d"), cen["id"].alias("id")))
        return F.array_min(d)["id"]

    return points.withColumn(out, T.let(v, best))


def _nearest(x: np.ndarray, centers: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point and the squared distance, a block of points at a time."""
    label, dist = np.empty(len(x), np.int64), np.empty(len(x))
    norm = (centers ** 2).sum(1)
    for at in range(0, len(x), block):
        part = x[at:at + block]
        d = norm - 2 * part @ centers.T
        label[at:at + block] = d.argmin(1)
        dist[at:at + block] = d.min(1) + (part ** 2).sum(1)
    return label, np.maximum(dist, 0)


def _kmeans_np(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ seeding and Lloyd iterations until no label changes, on one bucket of distinct points.

    Every one of the min(k, n) clusters keeps at least one point: an empty
    one takes the point farthest from its centre among clusters of two and more.
    """
    n = len(x)
    k = max(1, min(k, n))
    rng = np.random.default_rng(seed)
    picks = [int(rng.choice(n, p=weight / weight.sum()))]
    d2 = ((x - x[picks[0]]) ** 2).sum(1)
    d2[picks[0]] = 0
    while len(picks) < k:
        p = weight * d2
        free = np.setdiff1d(np.arange(n), picks) if p.sum() <= 0 else None
        j = int(free[0]) if free is not None else int(rng.choice(n, p=p / p.sum()))
        picks.append(j)
        d2 = np.minimum(d2, ((x - x[j]) ** 2).sum(1))
        d2[picks] = 0
    centers = x[picks].copy()
    labels, before = None, np.inf
    while True:
        new, dist = _nearest(x, centers)
        count = np.bincount(new, minlength=k)
        for j in np.flatnonzero(count == 0):
            far = int(np.where(count[new] > 1, dist, -1).argmax())
            count[new[far]] -= 1
            new[far], dist[far], count[j] = j, 0, 1
        cost = float((weight * dist).sum())
        if labels is not None and ((new == labels).all() or cost >= before):
            return labels
        labels, before = new, cost
        centers = np.zeros((k, x.shape[1]))
        np.add.at(centers, labels, x * weight[:, None])
        centers /= np.bincount(labels, weight, minlength=k)[:, None]


def kmeans_by_type(df: DataFrame, type_col: str = "type", id_col: str = "entity", vec_col: str = "vec",
                   per_cluster: int = fixed.MEMBERS_PER_CLUSTER, types: list[str] | None = None,
                   seed: int = 7, max_bucket_rows: int = 4096, tolerance: float = 1e-3, costs: list | None = None) -> DataFrame:
    """CLU-2/CLU-3: ``(type, id, cluster)`` with k = n // 5 per type (ORD-3 ``types`` filter, [] = all).

    Identical vectors are one weighted point and always share a cluster; a
    type with fewer distinct vectors than k gets one cluster for each.  Types
    of several buckets are refined until a pass lowers their cost by less than
    ``tolerance`` of it; ``costs``, when given, gets the cost of every pass.
    """
    src = df
    if types:
        src = src.where(F.col(type_col).isin(*types))
    src = src.where(F.col(vec_col).isNotNull()).select(
        F.col(type_col).alias("_type"), F.col(id_col).alias("_id"), as_double(vec_col).alias("_a"))
    ensure_checkpoint_dir(df.sparkSession)
    points = src.groupBy("_type", "_a").agg(F.count(F.lit(1)).alias("_w")) \
        .withColumn("_bucket", F.lit("0")).withColumn("_p", F.monotonically_increasing_id()).checkpoint()
    points = _split_buckets(points, max_bucket_rows)
    counts = points.groupBy("_type", "_bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("_w").alias("w"))
    by_type = Window.partitionBy("_type")  # one row a bucket
    # Largest remainders: every bucket has at least one cluster and no more than its points, the sum is k as far as that allows.
    k = F.least(F.greatest(F.floor(F.sum("w").over(by_type) / per_cluster), F.count(F.lit(1)).over(by_type)), F.sum("m").over(by_type))
    share = counts.withColumn("k", k).withColumn("exact", F.col("w") * F.col("k") / F.sum("w").over(by_type))
    share = share.withColumn("_kb", F.least(F.greatest(F.floor("exact"), F.lit(1)), F.col("m")))
    share = share.withColumn("open", F.col("k") - F.sum("_kb").over(by_type))
    # Clusters still to give go where room is left, largest remainder first; if buckets of one took too many, the largest give back.
    room = F.col("m") - F.col("_kb")
    order = by_type.orderBy((F.floor("exact") - F.col("exact")), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    back = by_type.orderBy(F.desc("_kb"), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    one = F.when(room > 0, F.lit(1)).otherwise(F.lit(0))
    share = share.withColumn("_first", F.when((F.col("open") > 0) & (one == 1) & (F.coalesce(F.sum(one).over(order), F.lit(0)) < F.col("open")), 1).otherwise(0)) \
                 .withColumn("_kb", F.col("_kb") + F.col("_first")).withColumn("open", F.col("k") - F.sum("_kb").over(by_type))
    share = share.withColumn("_more", F.greatest(F.lit(0), F.least(room, F.col("open") - F.coalesce(F.sum(room).over(order), F.lit(0))))) \
                 .withColumn("_less", F.greatest(F.lit(0), F.least(F.col("_kb") - 1, -F.col("open") - F.coalesce(F.sum(F.col("_kb") - 1).over(back), F.lit(0))))) \
                 .withColumn("_kb", F.col("_kb") + F.col("_more") - F.col("_less"))
    run = by_type.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    share = share.withColumn("_off", F.coalesce(F.sum("_kb").over(run), F.lit(0)))
    b = points.join(checked_broadcast(share.select("_type", "_bucket", "_kb", "_off")), ["_type", "_bucket"])

    def per_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["_a"].to_numpy())
        order = np.lexsort(x.T[::-1])  # the same order of points in every run
        lab = np.empty(len(x), np.int64)
        lab[order] = _kmeans_np(x[order], pdf["_w"].to_numpy(float)[order], int(pdf["_kb"].iloc[0]), seed)
        return pd.DataFrame({"_type": pdf["_type"], "_p": pdf["_p"], "cluster": (lab + int(pdf["_off"].iloc[0])).astype("int32")})

    schema = f"_type {src.schema['_type'].dataType.simpleString()}, _p long, cluster int"
    out = b.select("_type", "_a", "_p", "_w", "_kb", "_off", "_bucket").groupBy("_type", "_bucket").applyInPandas(per_bucket, schema)
    cut = [r["_type"] for r in counts.groupBy("_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_type").collect()]  # one row a type
    if cut:
        out = out.checkpoint()
        large = F.col("_type").isin(*cut)
        out = out.where(~large).unionByName(_refined(points.where(large).select("_type", "_p", "_a", "_w"), out.where(large), tolerance, costs))
    named = points.select("_type", "_p", "_a").join(out, ["_type", "_p"])
    return src.join(named, ["_type", "_a"]).select(F.col("_type").alias(type_col), F.col("_id").alias(id_col), "cluster")


def _refined(points: DataFrame, labels: DataFrame, tolerance: float, costs: list | None) -> DataFrame:
    """(_type, _p, cluster) after Lloyd passes over whole types, starting from ``labels``.

    The point nearest to its own cluster's centre stays there, so no cluster
    empties; every other point goes to the nearest centre of its type.
    """
    square = F.aggregate(F.zip_with("_a", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    before = None
    while True:
        state = points.join(labels, ["_type", "_p"]).checkpoint()
        centres = state.groupBy("_type", "cluster").agg(Summarizer.mean(array_to_vector("_a"), F.col("_w").cast("double")).alias("m")) \
            .select("_type", "cluster", vector_to_array("m").alias("_c")).checkpoint()
        own = state.join(centres, ["_type", "cluster"]).select("_type", "_p", "_w", "cluster", square.alias("d"))
        keeps = own.groupBy("_type", "cluster").agg(F.min(F.struct("d", "_p")).alias("k")).select("_type", F.col("k._p").alias("_p"), F.lit(True).alias("keeps"))
        found = assign_nearest(points, centres.withColumnRenamed("_c", "_a"), "_type", "_p", "_a").withColumnRenamed("cluster", "new")
        moved = own.join(found, ["_type", "_p"]).join(keeps, ["_type", "_p"], "left")
        stays = F.coalesce("keeps", F.lit(False)) | (F.col("d") <= F.col("distance") * F.col("distance"))
        moved = moved.select("_type", "_p", F.when(stays, F.col("cluster")).otherwise(F.col("new")).cast("int").alias("cluster"),
                             (F.col("_w") * F.when(stays, F.col("d")).otherwise(F.col("distance") * F.col("distance"))).alias("cost")).checkpoint()
        cost = moved.agg(F.sum("cost")).first()[0]
        if costs is not None:
            costs.append(cost)
        labels = moved.drop("cost")
        if before is not None and before - cost <= tolerance * before:
            return labels
        before = cost


def _split_buckets(points: DataFrame, max_bucket_rows: int) -> DataFrame:
    """Halve every bucket of more than ``max_bucket_rows`` distinct points at the mean of its widest dimension, until none is left.

    Distinct points always separate, so the loop ends; sizes and cuts stay in
    a table with one row a large bucket.
    """
    while True:
        big = points.groupBy("_type", "_bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max_bucket_rows).select("_type", "_bucket")
        if big.isEmpty():
            return points
        stats = points.join(big, ["_type", "_bucket"]).groupBy("_type", "_bucket").agg(
            Summarizer.metrics("mean", "variance").summary(array_to_vector("_a")).alias("s"))
        var, mean = vector_to_array("s.variance"), vector_to_array("s.mean")
        cut = stats.select("_type", "_bucket", (F.array_position(var, F.array_max(var)) - 1).cast("int").alias("_dim"), mean.alias("_m")) \
                   .select("_type", "_bucket", "_dim", F.get("_m", F.col("_dim")).alias("_at"))
        side = F.when(F.col("_dim").isNull(), F.col("_bucket")).otherwise(
            F.concat("_bucket", F.when(F.get("_a", F.col("_dim")) <= F.col("_at"), "0").otherwise("1")))
        points = points.join(cut, ["_type", "_bucket"], "left").withColumn("_bucket", side).drop("_dim", "_at").checkpoint()


def cluster_members(assign: DataFrame, type_col: str = "type", cluster_col: str = "cluster",
                    member_col: str = "entity", include_singletons: bool = False) -> DataFrame:
    """AGG-8 in long form: ``(type, cluster, member, n_members)`` for clusters with more than one member.

    Sizes come from a partially aggregated count joined back, so no cluster
    is ever collected into one row.
    """
    sizes = assign.groupBy(type_col, cluster_col).agg(F.count(F.lit(1)).alias("n_members"))
    if not include_singletons:
        sizes = sizes.where(F.col("n_members") > 1)
    return assign.join(sizes, [type_col, cluster_col]).select(type_col, cluster_col, member_col, "n_members")
