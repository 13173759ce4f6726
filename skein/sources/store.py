"""Tables at rest: a graph store partitioned by graph, JSON, text and database sinks, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.retrieval import first_wins

# The node and edge tables of a graph, with their keys.
TABLES = {
    "entity": ("id",), "chunk": ("id",), "document": ("id",), "community": ("id",),
    "part_of": ("chunk_id", "document_id"), "has_entity": ("chunk_id", "entity_id"), "related": ("id",), "in_community": ("entity_id", "community_id"),
}


def last_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row for each key: that of the highest sequence number, as repeated upserts leave it."""
    return first_wins(rows, keys, [-F.col(sequence)])


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of the keys that stand more than once; an empty result means that the constraint holds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def issues(rows: DataFrame | None, required: list[str]) -> list[str]:
    """What keeps a table from being imported: none, missing or empty columns, no rows, lists of lists. One pass."""
    if rows is None:
        return ["no table"]
    found = [f"missing column {c}" for c in required if c not in rows.columns]
    there = [c for c in required if c in rows.columns]
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in there)).first()
    if counts["_n"] == 0:
        found.append("no rows")
    else:
        found += [f"column {c} is null throughout" for c in there if counts[c] == 0]
    nested = (T.ArrayType, T.MapType, T.StructType)
    found += [f"column {f.name} is nested deeply" for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, nested)]
    return found


def as_json_text(rows: DataFrame) -> DataFrame:
    """Structs, maps and lists of structs as JSON text; other columns stay."""
    deep = lambda t: isinstance(t, (T.StructType, T.MapType)) or isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.MapType, T.ArrayType))
    return rows.select(*(F.to_json(f.name).alias(f.name) if deep(f.dataType) else F.col(f.name) for f in rows.schema.fields))


@dataclass(frozen=True)
class GraphStore:
    """Parquet tables under one folder, each partitioned by ``graph_prefix``, so that a graph is replaced or read alone."""

    spark: SparkSession
    folder: str

    def write(self, prefix: str, tables: dict[str, DataFrame], sequence: str = "_sequence") -> dict[str, list[str]]:
        """Write the tables of one graph, nodes before edges; returns the issues of those that were not written.

        A row without its key is left out; of several with one key the one of highest ``sequence`` stays.
        """
        refused = {}
        for name in TABLES:
            if name not in tables:
                continue
            found = issues(tables[name], list(TABLES[name]))
            if found:
                refused[name] = found
                continue
            keys = list(TABLES[name])
            good = tables[name].where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
            # As repeated upserts leave it: the last row of a key, or any of equal ones where no order is given.
            keyed = last_wins(good, keys, sequence).drop(sequence) if sequence in good.columns else first_wins(good, keys, [F.to_json(F.struct(*good.columns))])
            rows = keyed.withColumn("graph_prefix", F.lit(prefix))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_prefix").parquet(f"{self.folder}/{name}")
        return refused

    def read(self, prefix: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").where(F.col("graph_prefix") == prefix).drop("graph_prefix")

    def prefixes(self, name: str = "entity") -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").select("graph_prefix").distinct()

    def clear(self, prefix: str) -> None:
        """Remove one graph: its partitions are overwritten with nothing."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in TABLES:
            path = hadoop.Path(f"{self.folder}/{name}/graph_prefix={prefix}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def label_prefixes(labels: DataFrame, column: str = "label") -> DataFrame:
    """Distinct prefixes of labels of the form ``PREFIX__Kind__``."""
    return labels.where(F.contains(column, F.lit("__"))).select(F.element_at(F.split(column, "__"), 1).alias("graph_prefix")).distinct()


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_corpus(rows: DataFrame, text: str, path: str) -> None:
    """One text file item per row, each followed by a blank line."""
    rows.where(F.col(text).isNotNull()).select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_database(rows: DataFrame, url: str, name: str, properties: dict[str, str] | None = None, mode: str = "append") -> None:
    """Metric or statistics rows into a table over JDBC; the driver's jar comes with the cluster."""
    as_json_text(rows).write.jdbc(url, name, mode=mode, properties=properties or {})


def write_metrics(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Metric records by strategy, with their level."""
    rows.write.mode(mode).partitionBy("search_type").parquet(folder)


# The columns of a row of graph statistics, in order.
STATISTICS = (
    "graph_type", "number_of_nodes", "number_of_relationships", "mean_distance", "diameter", "radius", "num_wcc", "largest_wcc_size", "num_scc", "largest_scc_size",
    "communities_level_1", "communities_level_2", "communities_level_3",
)


def write_statistics(rows: DataFrame, path: str) -> None:
    """One JSON row for each graph; columns that a graph lacks are null."""
    kept = [F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in STATISTICS]
    rows.select(*kept).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_all(metrics: DataFrame, statistics: DataFrame, url: str, properties: dict[str, str] | None = None) -> list[str]:
    """Every strategy's metric records into a table of its own, and the statistics into one; the names of the tables."""
    names = sorted(r[0] for r in metrics.select("search_type").where("search_type IS NOT NULL").distinct().collect())  # nine strategies
    for name in names:
        write_database(metrics.where(F.col("search_type") == name), url, f"{name}_metrics", properties)
    write_database(statistics, url, "graph_statistics", properties, "overwrite")
    return [*(f"{n}_metrics" for n in names), "graph_statistics"]


def metric_views(metrics: DataFrame, scores: list[str]) -> dict[str, DataFrame]:
    """What a dashboard asks for, also registered as temporary views: means by strategy, by level, over time, and fallbacks."""
    means = [F.count(F.lit(1)).alias("records"), *(F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(c) for c in scores)]
    by_time = metrics.groupBy("search_type", F.date_trunc("day", "created_at").alias("day")).agg(*means)
    flags = [F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in metrics.columns if c.startswith(("fallback_used", "final_state_failed"))]
    views = {"metrics_by_strategy": metrics.groupBy("search_type").agg(*means), "metrics_by_level": metrics.groupBy("search_type", "qa_level").agg(*means), "metrics_by_day": by_time, "metric_fallbacks": metrics.groupBy("search_type").agg(*flags)}
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return views
