"""Run-cost rollups (CST-01..05) over a run log joined to the instance price
table. The price table is six fixed rows, so its broadcast is bounded by
construction; the run log can be any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: instance type, GPUs, GPU type, vCPUs, memory GB, on-demand $/h, spot $/h,
# estimated training hours, scaling efficiency without / with the sharding library
INSTANCES = [
    ("ml.g5.2xlarge", 1, "A10G", 8, 32, 1.52, 0.46, 60.0, 1.0, 1.0),
    ("ml.g5.4xlarge", 1, "A10G", 16, 64, 2.88, 0.86, 40.0, 1.0, 1.0),
    ("ml.g5.8xlarge", 2, "A10G", 32, 128, 5.76, 1.73, 25.0, 0.95, 0.98),
    ("ml.g5.12xlarge", 4, "A10G", 48, 192, 8.64, 2.59, 18.0, 0.9, 0.95),
    ("ml.g5.16xlarge", 4, "A10G", 64, 256, 11.52, 3.46, 15.0, 0.85, 0.92),
    ("ml.g5.48xlarge", 8, "A10G", 192, 768, 34.56, 10.37, 8.0, 0.8, 0.9),
]
PRICE_SCHEMA = ("instance_type string, gpus int, gpu_type string, vcpus int, memory_gb int, on_demand double, "
                "spot double, hours double, efficiency double, improved_efficiency double")


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTANCES, PRICE_SCHEMA)


def run_costs(runs: DataFrame, prices: DataFrame, type_col: str = "instance_type",
              hours_col: str = "hours") -> DataFrame:
    """CST-01..04 per run: on-demand and spot cost, price per GPU-hour,
    adjusted hours = hours × efficiency / improved efficiency, adjusted
    costs, savings and savings %."""
    p = prices.select(F.col("instance_type").alias(type_col), "gpus", "on_demand", "spot", "efficiency",
                      "improved_efficiency")
    j = runs.join(F.broadcast(p), type_col)  # 6 fixed rows
    h = F.col(hours_col)
    adj = h * (F.col("efficiency") / F.col("improved_efficiency"))
    j = (j.withColumn("on_demand_cost", F.col("on_demand") * h).withColumn("spot_cost", F.col("spot") * h)
         .withColumn("price_per_gpu_hour", F.col("on_demand") / F.col("gpus"))
         .withColumn("adjusted_hours", adj)
         .withColumn("on_demand_cost_adjusted", F.col("on_demand") * adj)
         .withColumn("spot_cost_adjusted", F.col("spot") * adj))
    return (j.withColumn("on_demand_savings", F.col("on_demand_cost") - F.col("on_demand_cost_adjusted"))
            .withColumn("spot_savings", F.col("spot_cost") - F.col("spot_cost_adjusted"))
            .withColumn("on_demand_savings_pct", F.col("on_demand_savings") / F.col("on_demand_cost") * 100)
            .withColumn("spot_savings_pct", F.col("spot_savings") / F.col("spot_cost") * 100)
            .withColumn("spot_vs_on_demand_pct", (1 - F.col("spot_cost") / F.col("on_demand_cost")) * 100))


def cost_summary(costs: DataFrame, type_col: str = "instance_type") -> DataFrame:
    """Totals per instance type."""
    return costs.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("hours").alias("hours"),
        F.sum("on_demand_cost").alias("on_demand_cost"), F.sum("spot_cost").alias("spot_cost"),
        F.sum("adjusted_hours").alias("adjusted_hours"), F.sum("spot_cost_adjusted").alias("spot_cost_adjusted"))


def cheapest(costs: DataFrame, cost_col: str = "spot_cost", type_col: str = "instance_type") -> DataFrame:
    """CST-05: the configuration with the lowest cost (ties → name)."""
    return costs.orderBy(F.col(cost_col).asc(), F.col(type_col).asc()).limit(1)
