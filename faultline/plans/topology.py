"""The deployment: services, their pods, and who calls whom. Tables of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The services, their downstream services, and the database's components.
CALLS = {
    "frontend": ("checkoutservice", "recommendationservice", "productcatalogservice", "shippingservice", "adservice", "cartservice", "currencyservice"),
    "checkoutservice": ("shippingservice", "paymentservice", "currencyservice", "emailservice", "cartservice"),
    "recommendationservice": ("productcatalogservice",),
    "adservice": ("tidb",),
    "productcatalogservice": ("tidb",),
    "cartservice": ("redis-cart",),
    "shippingservice": (),
    "currencyservice": (),
    "paymentservice": (),
    "emailservice": (),
}
DATABASE = ("tidb-tidb", "tidb-pd", "tidb-tikv")
NODES = tuple(f"aiops-k8s-{i:02d}" for i in range(1, 9))
REPLICAS, SINGLE = 3, ("redis-cart",)


def pods_of(service: str) -> list[str]:
    return list(DATABASE) if service == "tidb" else [f"{service}-{i}" for i in range(1 if service in SINGLE else REPLICAS)]


def pods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, p) for s in (*CALLS, *SINGLE, "tidb") for p in pods_of(s)], "service string, pod string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, out in CALLS.items() for b in out], "src string, dst string")


def known_components() -> list[str]:
    return [*CALLS, *SINGLE, "tidb", *(p for s in (*CALLS, *SINGLE, "tidb") for p in pods_of(s)), *NODES]


def standard_components(found: DataFrame, name: str, known: DataFrame, known_name: str = "known") -> DataFrame:
    """found with `standard`: the known component of that name, whatever the case; an exact match first; else the name itself."""
    table = known.select(F.col(known_name).alias("__k")).distinct()
    exact = table.select(F.col("__k").alias("__exact"))
    loose = table.groupBy(F.lower("__k").alias("__low")).agg(F.min("__k").alias("__loose"))
    met = found.join(F.broadcast(exact), F.col(name) == F.col("__exact"), "left").join(F.broadcast(loose), F.lower(name) == F.col("__low"), "left")
    return met.withColumn("standard", F.coalesce("__exact", "__loose", F.col(name))).drop("__exact", "__low", "__loose")


def expanded(found: DataFrame, service: str, topology: DataFrame) -> DataFrame:
    """A row for each pod of each service."""
    return found.join(F.broadcast(topology.withColumnRenamed("service", service)), service)
