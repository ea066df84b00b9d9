"""Registered queries: cluster counts, nearest centroid, cluster members, k-means per type.

``embeddings`` stands in for entity vectors: ``label`` is the entity type
(for k-means) or a given cluster id (for the report), ``vec_id`` the entity.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.operators import cluster as C
from wordloom.operators import nearest as N
from wordloom.operators import vectors as V
from wordloom.plans.common import load


def _emb(spark, sf):
    return load(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("type"), "vec_id", F.col("embedding").alias("vec"))


def q_cluster_sizes_k(spark, sf):
    """CLU-1: k = n // 5 per type."""
    return C.cluster_sizes(_emb(spark, sf)).select("type", F.col("n").cast("bigint").alias("n"), "k")


def q_nearest_centroid(spark, sf):
    """CLU-4: each vector's nearest type centroid (centroid = mean vector of the type)."""
    e = _emb(spark, sf)
    cent = V.mean_vectors(e, "type", "vec").orderBy("type").collect()  # one row per type
    cents = [(int(r["type"]), list(r["vec"])) for r in cent]
    a = C.nearest_centroid(e, "vec", cents, "nearest")
    return a.select("vec_id", "type", F.col("nearest").cast("int").alias("nearest"))


def q_nearest_of_many(spark, sf):
    """CLU-4 with k = n // 5 centroids a type (means of up to five vectors, by a running number of the type's vectors), as a join of cells."""
    e = _emb(spark, sf).where("type is not null")
    order = Window.partitionBy("type").orderBy("vec_id")  # a stand-in's numbering of centroids, not the assignment
    groups = e.join(C.cluster_sizes(e, "type"), "type").withColumn("cluster", F.pmod(F.row_number().over(order) - 1, F.col("k")))
    cents = V.mean_vectors(groups, ["type", "cluster"], "vec").select("type", "cluster", "vec")
    a = N.assign_nearest(e, cents, "type", "vec_id", "vec")
    return a.select("vec_id", "type", F.col("cluster").cast("int").alias("nearest"), F.round("distance", 6).alias("distance"))


def q_cluster_members(spark, sf):
    """AGG-8: members of every cluster with more than one member (cluster = given label)."""
    e = _emb(spark, sf).select(F.lit("embedding").alias("type"), F.col("type").cast("int").alias("cluster"),
                               F.col("vec_id").alias("entity"))
    m = C.cluster_members(e, "type", "cluster", "entity")
    return m.select("type", "cluster", "entity", F.col("n_members").cast("bigint").alias("n_members"))


def q_kmeans_by_type(spark, sf):
    """CLU-2 / CLU-3: k-means with k = n // 5 inside every type."""
    e = _emb(spark, sf)
    return C.kmeans_by_type(e, "type", "vec_id", "vec").select("type", "vec_id", "cluster")


QUERIES = {
    "cluster_sizes_k": q_cluster_sizes_k,
    "nearest_centroid": q_nearest_centroid,
    "nearest_of_many": q_nearest_of_many,
    "cluster_members": q_cluster_members,
    "kmeans_by_type": q_kmeans_by_type,
}


def sql() -> dict[str, str]:
    return {
        "cluster_sizes_k": """
SELECT CAST(label AS VARCHAR) AS type, CAST(count(*) AS BIGINT) AS n,
       CAST(greatest(count(*) // 5, 1) AS INT) AS k FROM embeddings GROUP BY label""",
        "nearest_centroid": """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
comp AS (
  SELECT label, i, avg(v[i]) AS c FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, i
),
cent AS (SELECT label, list(c ORDER BY i) AS c FROM comp GROUP BY label),
d AS (
  SELECT e.vec_id, e.label, cent.label AS cid,
         list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (e.v[i] - cent.c[i]) * (e.v[i] - cent.c[i]))) AS d
  FROM e, cent
)
SELECT vec_id, CAST(label AS VARCHAR) AS type, CAST(arg_min(cid, (d, cid)) AS INT) AS nearest
FROM d GROUP BY vec_id, label""",
        "nearest_of_many": """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn,
                  greatest(count(*) OVER (PARTITION BY label) // 5, 1) AS k FROM embeddings WHERE label IS NOT NULL),
comp AS (SELECT label, rn % k AS cid, i, avg(v[i]) AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, rn % k, i),
cent AS (SELECT label, cid, list(c ORDER BY i) AS c FROM comp GROUP BY label, cid),
d AS (SELECT e.vec_id, e.label, cent.cid, list_distance(e.v, cent.c) AS d FROM e JOIN cent ON e.label = cent.label)
SELECT vec_id, CAST(label AS VARCHAR) AS type, CAST(arg_min(cid, (d, cid)) AS INT) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY vec_id, label""",
        "cluster_members": """
WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1)
SELECT 'embedding' AS type, CAST(e.label AS INT) AS cluster, e.vec_id AS entity, CAST(s.n AS BIGINT) AS n_members
FROM embeddings e JOIN s ON e.label = s.label""",
    }
