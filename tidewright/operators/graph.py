"""Object graphs: reachability and pointer chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "customer"
COMPACTED = 6


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) reachable from ``roots`` (id) over ``edges`` (src, dst), cycles allowed.

    A frontier loop: each round joins only the new nodes with the edges and drops known ones by an
    anti-join.  What is known stays in the parts that the rounds wrote, which are put together once in
    COMPACTED rounds; nothing known is written again each round.  Lineage is cut by checkpoint(), so a lost
    executor costs a re-read."""
    frontier = roots.select("id").distinct().checkpoint()
    parts = [frontier]
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        for known in parts:
            step = step.join(known, "id", "left_anti")
        frontier = step.checkpoint()
        parts.append(frontier)
        if len(parts) > COMPACTED:
            parts = [reduce(DataFrame.unionByName, parts).checkpoint()]
    return reduce(DataFrame.unionByName, parts)


def resolved(pointers: DataFrame, hops: int = 16) -> DataFrame:
    """(id, target) after following (id, next) for at most ``hops`` hops (a power of two); null if it has not
    ended.  Pointers are doubled: each round follows what the round before had found, so that is four joins."""
    known = pointers.select("id", F.col("next").alias("at"), F.lit(False).alias("ended"))
    ends = pointers.select(F.col("id").alias("at"), F.lit(True).alias("more"))
    known = known.join(ends, "at", "left").select("id", "at", F.col("more").isNull().alias("ended"))
    for _ in range(hops.bit_length() - 1):
        known = known.checkpoint()
        further = known.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("ended").alias("far_ended"))
        known = known.join(further, "at", "left").select("id", F.coalesce("far", "at").alias("at"), (F.col("ended") | F.coalesce("far_ended", F.lit(False))).alias("ended"))
    return known.select("id", F.when(F.col("ended"), F.col("at")).alias("target"))


def _checkpoints(spark: SparkSession) -> None:
    import tempfile

    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewright-"))


def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    objects = spark.read.parquet(f"{sf_dir}/{NODES}.parquet").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("n"))
    edges = objects.select("src", (F.col("src") * 2).alias("dst")).union(objects.select("src", (F.col("src") - F.col("n")).alias("dst"))).where("dst > 0").join(objects.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    roots = objects.where("src % 97 = 0").select(F.col("src").alias("id"))
    return reachable(roots, edges)


REACHABLE_SQL = """
WITH RECURSIVE e AS (
  SELECT src, dst FROM (SELECT c_custkey AS src, c_custkey * 2 AS dst FROM customer UNION ALL SELECT c_custkey, c_custkey - c_nationkey FROM customer) t
  WHERE dst > 0 AND dst IN (SELECT c_custkey FROM customer)),
r(id) AS (SELECT c_custkey FROM customer WHERE c_custkey % 97 = 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)
SELECT id FROM r
"""


def resolved_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    objects = spark.read.parquet(f"{sf_dir}/{NODES}.parquet").select(F.col("c_custkey").alias("id"))
    return resolved(objects.where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.col("id")).otherwise((F.col("id") / 2).cast("long")).alias("next")))


RESOLVED_SQL = """
WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey ELSE c_custkey // 2 END AS next FROM customer WHERE c_custkey % 5 <> 0),
s(id, cur, k) AS (SELECT id, next, 0 FROM p UNION ALL SELECT s.id, p.next, k + 1 FROM s JOIN p ON s.cur = p.id WHERE k < 17)
SELECT p.id, t.cur AS target FROM p LEFT JOIN (SELECT s.id, s.cur FROM s WHERE s.cur NOT IN (SELECT id FROM p) AND s.k < 16) t ON p.id = t.id
"""

QUERIES = {"reachable_objects": reachable_objects, "resolved_pointers": resolved_pointers}
ORACLE_SQL = {"reachable_objects": REACHABLE_SQL, "resolved_pointers": RESOLVED_SQL}
