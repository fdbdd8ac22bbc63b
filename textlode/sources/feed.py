"""Change feeds: pages of changes behind a token, read as a stream, and the manifest that they keep.

A feed is a row of pages; a page holds changes (id, version, deleted, name, size), and the token of the next one.
``ChangeFeed`` is a stream source whose offset is that token: a restart from a checkpoint reads on where
the last finished batch ended, so nothing is lost or read twice. ``FolderFeed`` finds its pages in a folder
that all workers see; other feeds give their own ``newest`` and ``page``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

SCHEMA = "id string, version long, deleted boolean, name string, size long, page long, place int"
#: Versions of a manifest that stay: a reader of the last one may still be at work when the next is there.
KEPT_VERSIONS = 2


class FolderPages:
    """Pages ``page-<number>.json`` (a list of changes) of a folder, numbered from 0 without gaps."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def newest(self) -> int:
        """Number of pages that are there: the token of the page to come."""
        n = 0
        while os.path.exists(f"{self.folder}/page-{n:09d}.json"):
            n += 1
        return n

    def page(self, number: int) -> list[dict]:
        with open(f"{self.folder}/page-{number:09d}.json", encoding="utf-8") as f:
            return json.load(f)


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class FeedReader(DataSourceStreamReader):
    """The offset is the token of the next page; a batch takes at most ``pages`` of them, a task each."""

    def __init__(self, pages: FolderPages, most: int):
        self.pages, self.most, self.at = pages, most, None

    def initialOffset(self) -> dict:
        return {"token": 0}

    def latestOffset(self) -> dict:
        newest = self.pages.newest()
        # without a bound, or before the first batch is known, all that is there
        self.at = newest if self.at is None or not self.most else min(newest, self.at + self.most)
        return {"token": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Page(n) for n in range(start["token"], end["token"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        for place, c in enumerate(self.pages.page(partition.number)):
            yield str(c["id"]), int(c.get("version", 0)), bool(c.get("deleted", False)), c.get("name"), c.get("size"), partition.number, place

    def commit(self, end: dict) -> None:
        """Pages stay with the feed."""


class ChangeFeed(DataSource):
    """``spark.readStream.format("change_feed").option("path", ...)``; a subclass with other ``pages`` reads another service."""

    pages = FolderPages

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.pages(self.options), int(self.options.get("pages", 0)))


def applied(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """id, version, name, size after the changes: of each id the last one (by page and place) counts, and removed ones go.

    An older version than the manifest's changes nothing: pages may be sent again. Ids that were never there may be removed.
    """
    last = Window.partitionBy("id").orderBy(F.desc("page"), F.desc("place"))
    new = changes.withColumn("n", F.row_number().over(last)).filter("n = 1").select("id", *(F.col(c).alias(f"new_{c}") for c in ("version", "deleted", "name", "size")))
    both = manifest.join(new, "id", "full")
    known = F.col("version").isNotNull()
    fresh = F.col("new_version").isNotNull() & (~known | F.col("new_deleted") | (F.col("new_version") >= F.col("version")))
    kept = both.withColumn("fresh", F.coalesce(fresh, F.lit(False))).filter(~(F.col("fresh") & F.coalesce("new_deleted", F.lit(False))) & (known | F.col("fresh")))
    return kept.select("id", *(F.when(F.col("fresh"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("version", "name", "size")))


def versions(spark, path: str) -> list[int]:
    """Numbers of the finished manifests of a folder, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    done = [n for n in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(map(int, done))


def current(spark, path: str) -> DataFrame:
    """The last finished manifest."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], "id string, version long, name string, size long")
    return spark.read.parquet(f"{path}/{found[-1]}")


def keep(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a manifest in step with a feed: a folder a batch, of which the last ones stay.

    A batch that is run again starts from the manifest before it, and writes the same once more.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        old = spark.read.parquet(f"{path}/{before[-1]}") if before else current(spark, f"{path}/none")
        applied(old, rows).write.mode("overwrite").parquet(f"{path}/{number}")
        for version in [v for v in versions(spark, path) if v <= number][:-KEPT_VERSIONS]:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
