"""The claim fact table derived from lineitem, once for Spark and once as SQL.

image = order, claim = line item (ordinal in a total order of its columns),
detector = quantity / 51, similarity = 1 - 20 * discount, label from the return
flag (R hallucinated, A supported, N unknown), category = brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.session import table

BASE_EPS, CONFLICT_EPS, COUPLING = 0.2, 0.5, 0.3


def claims_base(spark: SparkSession, base: str, category: bool = False) -> DataFrame:
    """image_id, ordinal, det, sim, y (1 hallucinated, 0 supported, null unknown), theta, eps, p, lower, upper."""
    li = table(spark, base, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    det, sim = F.col("l_quantity") / 51, F.least(F.greatest(1 - 20 * F.col("l_discount"), F.lit(-1.0)), F.lit(1.0))
    d = li.select(
        F.col("l_orderkey").alias("image_id"), F.row_number().over(w).alias("ordinal"), "l_partkey", F.col("l_shipdate").alias("shipped"), det.alias("det"), sim.alias("sim"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("y"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y_b"),
    )
    d = d.withColumn("theta", S.unary_theta(F.col("det"), F.col("sim"))).withColumn("eps", S.evidence_epsilon(F.col("det"), F.col("sim"), BASE_EPS, 1.0, CONFLICT_EPS))
    d = d.withColumn("p", S.theta_to_probability(F.col("theta"))).withColumn("lower", S.theta_to_probability(F.col("theta") - F.col("eps"))).withColumn("upper", S.theta_to_probability(F.col("theta") + F.col("eps")))
    if category:
        part = table(spark, base, "part").select("p_partkey", F.col("p_brand").alias("category"))
        d = d.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    return d.drop("l_partkey") if not category else d.drop("l_partkey")


CLAIMS_SQL = f"""
WITH c0 AS (
  SELECT l_orderkey AS image_id, l_partkey, l_shipdate AS shipped,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS ordinal,
         l_quantity / 51 AS det, least(greatest(1 - 20 * l_discount, -1.0), 1.0) AS sim,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS y, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS y_b
  FROM lineitem
), c1 AS (
  SELECT *, least(greatest(0.6 * det + 0.4 * ((sim + 1) / 2), 0.0001), 0.9999) AS v, {BASE_EPS} + {CONFLICT_EPS} * abs(det - (sim + 1) / 2) AS eps FROM c0
), c2 AS (
  SELECT *, least(greatest(0.5 * ln((1 - v) / v), -5.0), 5.0) AS theta FROM c1
), c3 AS (
  SELECT *, 1 / (1 + exp(-2 * theta)) AS p, 1 / (1 + exp(-2 * (theta - eps))) AS lower, 1 / (1 + exp(-2 * (theta + eps))) AS upper FROM c2
), claims AS (
  SELECT c3.*, p_brand AS category FROM c3 LEFT JOIN part ON l_partkey = p_partkey
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
