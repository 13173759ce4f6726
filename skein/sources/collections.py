"""Vector collections as Parquet tables: dense vectors, sparse term weights, and both."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from skein.operators import retrieval
from skein.providers import Embedder, Timer, embed_rows

# The names of the collections and their columns.
COLLECTIONS = {
    "dense": "doc_id bigint, title string, text string, embedding array<double>",
    "sparse": "doc_id bigint, title string, text string, weights map<string,double>",
    "hybrid": "doc_id bigint, title string, text string, embedding array<double>, weights map<string,double>",
}
RESULT = "query_id bigint, doc_id bigint, score double, rank int"


def sparse_weights(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, weights: the map of term to weight of each text, as the sparse search weighs them; empty for null texts."""
    schema = ST.StructType([*rows.select(key).schema, ST.StructField("weights", ST.MapType(ST.StringType(), ST.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile("[a-z0-9]+").findall
        for batch in batches:
            maps = [list(retrieval.term_weights(split((t or "").lower())).items()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    return rows.select(key, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Collections:
    """The collections under one folder."""

    spark: SparkSession
    folder: str

    def create(self) -> None:
        """Empty collections in place of all that were there."""
        for name, schema in COLLECTIONS.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def upload(self, rows: DataFrame, embedder: Embedder) -> None:
        """Add doc_id, title, text rows to the three collections; a row that cannot be embedded is left out of all."""
        vectors = embed_rows(rows, "doc_id", "text", embedder, skip_failed=True)
        full = rows.select("doc_id", "title", "text").join(vectors, "doc_id").where("embedding IS NOT NULL").join(sparse_weights(rows), "doc_id")
        for name, schema in COLLECTIONS.items():
            columns = [part.split()[0] for part in schema.replace("map<string,double>", "map").split(", ")]
            full.select(*columns).write.mode("append").parquet(f"{self.folder}/{name}")

    def search(self, name: str, questions: DataFrame, embedder: Embedder, n: int = 4) -> DataFrame:
        """query_id, doc_id, score, rank of doc_id, text questions; nothing for a collection that is not known."""
        if name not in COLLECTIONS:
            return self.spark.createDataFrame([], RESULT)
        rows = self.spark.read.schema(COLLECTIONS[name]).parquet(f"{self.folder}/{name}")
        texts = questions.select("doc_id", "text")
        if name == "sparse":
            return retrieval.sparse_search(rows, texts, n)
        vectors = embed_rows(texts, "doc_id", "text", embedder)
        if name == "dense":
            return retrieval.nearest(rows, vectors, n, "doc_id")
        return retrieval.hybrid_search(rows, rows, vectors, texts, n)

    def search_all(self, questions: DataFrame, embedder: Embedder, n: int = 4) -> DataFrame:
        """strategy, query_id, doc_id, score, rank, time_taken: every collection, each run and timed on its own."""
        from skein.session import written

        out = None
        for name in COLLECTIONS:
            with Timer() as timer:
                found = written(self.search(name, questions, embedder, n).select("query_id", "doc_id", "score", "rank"))
            part = found.select(F.lit(name).alias("strategy"), "*", F.lit(timer.seconds).alias("time_taken"))
            out = part if out is None else out.unionByName(part)
        return out
