"""Fetching pages: URLs as rows, a bounded number of requests at once in each task, successes and failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fetcher(Protocol):
    """Gives the text of a page; it raises where it fails."""

    def fetch(self, url: str) -> str: ...


class FileFetcher:
    """The offline stand-in: ``file:`` URLs and plain paths, read as UTF-8."""

    def fetch(self, url: str) -> str:
        from pathlib import Path

        return Path(url.removeprefix("file://")).read_text("utf-8")


def fetch_pages(urls: DataFrame, maker: Callable[[], Fetcher], url: str = "url", concurrent: int = 5) -> DataFrame:
    """url, chunk, error: each distinct URL fetched once, ``concurrent`` at a time in a task; null URLs are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        fetcher = maker()

        def one(address: str) -> tuple[str, str | None, str | None]:
            try:
                return address, fetcher.fetch(address), None
            except Exception as failed:  # whatever a fetcher raises is a failed page
                return address, None, f"{type(failed).__name__}: {failed}"

        with ThreadPoolExecutor(concurrent) as pool:
            for batch in batches:
                rows = list(pool.map(one, batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["url", "chunk", "error"])

    return urls.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().mapInArrow(run, "url string, chunk string, error string")


def store_pages(found: DataFrame, path: str) -> None:
    """Add the pages that were fetched to a folder of JSON rows."""
    found.where("chunk IS NOT NULL").select("chunk", "url", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")).write.mode("append").json(path)
