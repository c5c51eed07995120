"""Queries of the llm problems over the given tables, and their SQL where it is quick enough."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.clusters import Clusters
from pointloom.llm.leaks import leaked_items
from pointloom.llm.mix import Mix, sized_records
from pointloom.llm.nearest_time import nearest_in_time
from pointloom.llm.nngraph import point_neighbours, vector_neighbours
from pointloom.llm.pii import find_personal, redact
from pointloom.session import read_table, spread

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
CAM_TOLERANCE_US, IMU_TOLERANCE_US = 12_000, 4_000


def _documents(spark: SparkSession, d: str, *also: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text", *also))


def _micros(column: str) -> F.Column:
    c = F.col(column)
    return F.when(~F.isnan(c) & (F.abs(c) < 9e12), F.round(c * 1_000_000).cast("bigint"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    side = lambda name, i, t: read_table(spark, d, name).select("session_id", F.col(i).alias("id"), _micros(t).alias("t"))
    lidar = side("lidar_signals", "lidar_id", "lidar_t")
    out = None
    for name, i, t, tolerance in (("cam_signals", "cam_id", "cam_t", CAM_TOLERANCE_US), ("imu_signals", "imu_id", "imu_t", IMU_TOLERANCE_US)):
        one = nearest_in_time(lidar, side(name, i, t), left_id="id", right_id="id", left_t="t", right_t="t", entity="session_id", tolerance_us=tolerance)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("left_id").alias("lidar_id"), F.col("right_id").alias("match_id"))


def _clusters(spark: SparkSession, d: str) -> Clusters:
    return Clusters(read_table(spark, d, "pointcloud_points"), group="frame_id", id="point_id", eps=0.25, least=15)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).members()


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster with its size, number of communities and three most typical points."""
    return _clusters(spark, d).described().withColumnRenamed("grp", "frame_id")


def p3_communities(spark: SparkSession, d: str) -> DataFrame:
    """The communities inside the clusters with size and most typical points."""
    return _clusters(spark, d).described(by="community").withColumnRenamed("grp", "frame_id")


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """How many joins of communities the exact check added to those of the graph's edges."""
    return _clusters(spark, d).repaired()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nn = point_neighbours(read_table(spark, d, "pointcloud_points"), read_table(spark, d, "knn_probes"), group="session_id", id="point_id", k=5, check=True)
    pairs = nn.select("qid", F.explode("nn.id").alias("id"))
    return pairs.select(F.least("qid", "id").alias("low_id"), F.greatest("qid", "id").alias("high_id")).distinct()


def p4_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar embeddings for every one whose id is divisible by 20, against all."""
    nn = vector_neighbours(read_table(spark, d, "embeddings"), id="vec_id", vec="embedding", k=10, asked=F.col("vec_id") % 20 == 0)
    return nn.select(F.col("qid").alias("vec_id"), F.posexplode("nn")).select("vec_id", (F.col("pos") + 1).cast("bigint").alias("place"), F.col("col.id").alias("near_id"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked passages with their length in words and number of differences."""
    return leaked_items(_documents(spark, d), read_table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", item_text="item_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("item_id", "doc_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the longest passage."""
    return p6_leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


def _mix(spark: SparkSession, d: str) -> Mix:
    sizes = sized_records(_documents(spark, d, "source"), id="doc_id", source="source", text="text", tokenizer=f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return Mix(sizes, read_table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares().where(~F.col("reachable")).select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).records()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "kind", "surface").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every place with its score."""
    return find_personal(_documents(spark, d), read_table(spark, d, "members"), id="doc_id", text="text", known_name="full_name").withColumnRenamed("id", "doc_id")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All texts with placeholders."""
    return redact(_documents(spark, d), read_table(spark, d, "members"), id="doc_id", text="text", known_name="full_name").withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p3_communities": p3_communities,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_vectors": p4_vectors,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p6_items": p6_items,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_mix": p7_mix,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_redacted": p8_redacted,
}


def _p1_side(table: str, i: str, t: str, tolerance: int) -> str:
    return f"""
  SELECT l.lidar_id, arg_min(r.{i}, abs(l.t - r.t)) AS match_id
  FROM (SELECT DISTINCT lidar_id, session_id, CAST(round(lidar_t * 1000000) AS BIGINT) AS t FROM lidar_signals WHERE lidar_t IS NOT NULL AND isfinite(lidar_t)) l
  JOIN (SELECT DISTINCT {i}, session_id, CAST(round({t} * 1000000) AS BIGINT) AS t FROM {table} WHERE {t} IS NOT NULL AND isfinite({t})) r
    ON l.session_id = r.session_id AND r.t BETWEEN l.t - {tolerance} AND l.t + {tolerance}
  GROUP BY l.lidar_id"""


ORACLES = {
    "p1_found": _p1_side("cam_signals", "cam_id", "cam_t", CAM_TOLERANCE_US) + " UNION ALL " + _p1_side("imu_signals", "imu_id", "imu_t", IMU_TOLERANCE_US),
    "p3_found": """
WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT point_id AS id, frame_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM pointcloud_points
  WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND NOT (x = 0 AND y = 0 AND z = 0)),
c AS (SELECT *, floor(x / 0.25) AS cx, floor(y / 0.25) AS cy, floor(z / 0.25) AS cz FROM p),
o AS (SELECT id, frame_id, x, y, z, cx + dx AS cx, cy + dy AS cy, cz + dz AS cz FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dz)),
e AS MATERIALIZED (SELECT c.id AS a, o.id AS b FROM c JOIN o USING (frame_id, cx, cy, cz) WHERE c.id <> o.id AND (c.x-o.x)*(c.x-o.x) + (c.y-o.y)*(c.y-o.y) + (c.z-o.z)*(c.z-o.z) <= 0.0625),
lab(id, cl) USING KEY (id) AS (SELECT id, id FROM p UNION SELECT e.b, min(lab.cl) FROM lab JOIN e ON e.a = lab.id JOIN recurring.lab AS r ON r.id = e.b WHERE lab.cl < r.cl GROUP BY e.b),
n AS (SELECT cl FROM lab GROUP BY cl HAVING count(*) >= 15)
SELECT cl AS cluster_id, id AS point_id FROM lab JOIN n USING (cl)""",
    "p4_found": """
WITH p AS (SELECT DISTINCT point_id, session_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM pointcloud_points
           WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND NOT (x = 0 AND y = 0 AND z = 0)),
q AS (SELECT p.* FROM p JOIN knn_probes USING (point_id, session_id)),
r AS (SELECT q.point_id AS a, p.point_id AS b,
        row_number() OVER (PARTITION BY q.point_id ORDER BY (p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z), p.point_id) AS k
      FROM q JOIN p ON q.session_id = p.session_id AND q.point_id <> p.point_id)
SELECT DISTINCT least(a, b) AS low_id, greatest(a, b) AS high_id FROM r WHERE k <= 5""",
    "p7_found": """
WITH s AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
k AS (SELECT m.source, m.target_share, m.max_copies, coalesce(s.n, 0) AS n FROM mix_targets m LEFT JOIN s USING (source))
SELECT source FROM k WHERE target_share * (SELECT sum(n) FROM k) > max_copies * n""",
}
