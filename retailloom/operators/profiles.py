"""What a group of customers looks like, and what to call it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailloom.operators.quantiles import exact_medians
from retailloom.operators.rfm import METRICS
from retailloom.schema import AT_RISK, CHAMPIONS, DORMANT, NEW_LOW


def persona(recency: Column, frequency: Column, monetary: Column, overall: Column) -> Column:
    """Name a group by its medians against the medians of all customers.

    ``overall`` is a struct with the three overall medians. Lower recency is better; both
    comparisons include equality.
    """
    recent = recency <= overall["recency_days"]
    valuable = (frequency >= overall["frequency"]) & (monetary >= overall["monetary"])
    return (
        F.when(recent & valuable, CHAMPIONS)
        .when(recent, NEW_LOW)
        .when(valuable, AT_RISK)
        .otherwise(DORMANT)
    )


def name_personas(profile: DataFrame, overall: DataFrame) -> DataFrame:
    """Add ``persona`` to a profile. ``overall`` is one row with the overall medians."""
    medians = overall.select(F.struct(*METRICS).alias("overall")).scalar()
    return (
        profile.withColumn("overall", medians)
        .withColumn("persona", persona(*[F.col(m) for m in METRICS], F.col("overall")))
        .drop("overall")
    )


def segment_profile(labelled: DataFrame) -> DataFrame:
    """Size, medians, revenue, shares and persona of each ``cluster``.

    ``labelled`` has one row per customer. The window at the end spans the clusters, of
    which there are a handful.
    """
    medians = exact_medians(labelled, METRICS, by=["cluster"])
    sizes = labelled.groupBy("cluster").agg(
        F.count("customer_id").alias("customers"), F.sum("monetary").alias("total_revenue")
    )
    everything = Window.partitionBy()

    def share(amount: str) -> Column:
        value = F.col(amount).cast("double")
        return F.bround(value / F.sum(value).over(everything) * 100, 1)

    profile = sizes.join(medians, "cluster").select(
        "cluster",
        "customers",
        *METRICS,
        "total_revenue",
        share("customers").alias("pct_of_customers"),
        share("total_revenue").alias("pct_of_revenue"),
    )
    return name_personas(profile, exact_medians(labelled, METRICS)).orderBy("cluster")
