"""External cluster quality from one contingency table.

Only the contingency count touches the data; everything else works on at most
(classes x clusters) rows, and without joins or windows: the three levels of
grouping sets (cells, class totals, cluster totals) hold all that purity, ARI and
NMI need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

# grouping_id over (label, cluster): bit set = column rolled up
_CELL, _CLASS, _CLUSTER = 0, 1, 2
# Mutual information below the rounding error of its entropy terms counts as zero.
_NO_INFORMATION = 1e-12


def contingency(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """``(label, cluster, n bigint)``; labels and clusters must be integers or strings, not null."""
    for name in (label, cluster):
        kind = df.schema[name].dataType
        if not isinstance(kind, (IntegralType, StringType)):
            raise ValueError(f"column {name} must hold integers or strings, not {kind.simpleString()}")
    cells = df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n")
    )
    missing = F.col("label").isNull() | F.col("cluster").isNull()
    return cells.withColumn(
        "n", F.when(missing, F.raise_error(F.lit("null label or cluster")).cast("bigint")).otherwise(F.col("n"))
    )


def _levels(cells: DataFrame) -> DataFrame:
    return cells.groupingSets([["label", "cluster"], ["label"], ["cluster"]], "label", "cluster").agg(
        F.sum("n").alias("n"), F.max("n").alias("top"), F.grouping_id().alias("level")
    )


def _total(level: int, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("level") == level, value)), F.lit(0))


def quality_row(cells: DataFrame) -> DataFrame:
    """One row ``ari, nmi, purity, num_records, num_classes, num_clusters`` of a contingency table."""
    n = F.col("n").cast("double")
    entropy_term = n * F.ln(n)
    pairs = n * (n - 1.0) / 2.0
    totals = _levels(cells).agg(
        _total(_CELL, F.col("n")).alias("records"),
        _total(_CLASS, F.lit(1)).alias("classes"),
        _total(_CLUSTER, F.lit(1)).alias("clusters"),
        _total(_CLUSTER, F.col("top")).alias("dominant"),
        *[
            _total(level, value).cast("double").alias(f"{name}_{part}")
            for level, part in ((_CELL, "cell"), (_CLASS, "class"), (_CLUSTER, "cluster"))
            for name, value in (("log", entropy_term), ("pairs", pairs))
        ],
    )
    # Part of every output column, so that column pruning cannot drop the check.
    checked = F.when(F.col("records") > 0, F.col("records")).otherwise(
        F.raise_error(F.lit("labels must not be empty")).cast("bigint")
    )
    records = checked.cast("double")

    expected = F.try_divide(F.col("pairs_class") * F.col("pairs_cluster"), records * (records - 1.0) / 2.0)
    ceiling = (F.col("pairs_class") + F.col("pairs_cluster")) / 2.0
    # Identical partitions into singletons or into one block leave 0/0, which means agreement.
    ari = F.coalesce(F.try_divide(F.col("pairs_cell") - expected, ceiling - expected), F.lit(1.0))

    def entropy(part: str) -> Column:
        return F.ln(records) - F.try_divide(F.col(f"log_{part}"), records)

    information = entropy("class") + entropy("cluster") - entropy("cell")
    trivial = (F.col("classes") == 1) & (F.col("clusters") == 1)
    nmi = (
        F.when(trivial, F.lit(1.0))
        .when(information <= _NO_INFORMATION, F.lit(0.0))
        .otherwise(F.try_divide(information, (entropy("class") + entropy("cluster")) / 2.0))
    )
    return totals.select(
        ari.alias("ari"),
        nmi.alias("nmi"),
        F.try_divide(F.col("dominant").cast("double"), records).alias("purity"),
        checked.alias("num_records"),
        F.col("classes").cast("bigint").alias("num_classes"),
        F.col("clusters").cast("bigint").alias("num_clusters"),
    )


def evaluate_quality(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Quality row of a table that carries a true label and a predicted cluster."""
    return quality_row(contingency(df, label, cluster))


def purity(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    return evaluate_quality(df, label, cluster).select("purity")


def adjusted_rand_index(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    return evaluate_quality(df, label, cluster).select("ari")


def normalized_mutual_information(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    return evaluate_quality(df, label, cluster).select("nmi")


def cardinalities(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    return evaluate_quality(df, label, cluster).select("num_records", "num_classes", "num_clusters")


def run_fingerprint(assignments: DataFrame, k: int, features: str = "features") -> DataFrame:
    """One row ``records, features, clusters, cluster_counts, sse`` of an assigned table.

    ``clusters`` is k, and ``cluster_counts`` has the size of every cluster 0..k-1, also 0.
    """
    per_cluster = assignments.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance_sq").alias("sse"), F.max(F.size(features)).alias("features")
    )
    sizes = F.map_from_entries(F.collect_list(F.struct(F.col("cluster").cast("int"), "n")))  # one entry per cluster
    every = F.sequence(F.lit(0), F.lit(k - 1))
    return per_cluster.agg(
        F.sum("n").alias("records"),
        F.max("features").alias("features"),
        F.lit(k).cast("bigint").alias("clusters"),
        F.transform(every, lambda c: F.coalesce(F.element_at(sizes, c), F.lit(0)).cast("bigint")).alias("cluster_counts"),
        F.sum("sse").alias("sse"),
    )


def cross_check(left: DataFrame, right: DataFrame, rel: float = 1e-7, abs_: float = 1e-6) -> DataFrame:
    """One row: do two independent fingerprints agree, field by field and as a whole?"""
    exact = ("records", "features", "clusters", "cluster_counts")
    a = left.select(F.lit(1).alias("one"), F.struct(*exact, "sse").alias("a"))
    b = right.select(F.lit(1).alias("one"), F.struct(*exact, "sse").alias("b"))
    scale = F.greatest(F.abs("a.sse"), F.abs("b.sse"))
    sse_equal = F.abs(F.col("a.sse") - F.col("b.sse")) <= F.greatest(scale * rel, F.lit(abs_))
    checks = {f"same_{name}": F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")) for name in exact}
    checks["same_sse"] = F.coalesce(sse_equal, F.lit(False))
    agree = F.lit(True)
    for check in checks.values():
        agree = agree & check
    return a.join(b, "one").select(*[c.alias(n) for n, c in checks.items()], agree.alias("agree"))
