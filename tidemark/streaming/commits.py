"""Resumable commits: several tables behind one manifest, and a stream sink that writes each batch once.

A commit writes the new rows of its tables to folders of their own and then publishes one numbered manifest, which names the folder of
every table and the last batch of every writer. Publishing is a rename that fails if the number is taken, so a version is seen
whole or not at all, two writers can't both publish it, and a batch that runs again after a crash finds itself in the ledger or starts
afresh. Folders that no manifest names are swept by :meth:`Store.sweep`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkpoints

EMPTY = {"version": 0, "tables": {}, "batches": {}}


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Store:
    """Tables in a folder that all executors share. Reading takes the newest manifest, so a reader never sees half a commit."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or an older one by number."""
        known = self.versions()
        if not known:
            return EMPTY
        number = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{number:012d}.json", wholetext=True).first()[0])

    def table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """A table as of a version; empty if it was never written."""
        path = self.manifest(version)["tables"].get(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}") if path else self.spark.createDataFrame([], schema)

    def committed(self, writer: str, batch: int) -> bool:
        return self.manifest()["batches"].get(writer, -1) >= batch

    def commit(self, tables: dict[str, DataFrame], *, writer: str, batch: int) -> bool:
        """Write and publish; False if the ledger has the batch already. Tables that aren't named stay as they are."""
        before = self.manifest()
        if before["batches"].get(writer, -1) >= batch:
            return False
        paths = {}
        for name, rows in tables.items():
            paths[name] = f"tables/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{paths[name]}")
        after = {"version": before["version"] + 1, "tables": before["tables"] | paths, "batches": before["batches"] | {writer: batch}}
        self._publish(after)
        return True

    def _publish(self, manifest: dict) -> None:
        draft = self._path(f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(f"{self.root}/manifests/{manifest['version']:012d}.json"), options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                raise Conflict(f"version {manifest['version']} is published") from e
            raise

    def sweep(self, keep: int = 1) -> int:
        """Delete manifests but the newest ``keep``, and the folders that none of those names; how many folders went. No writer may be at work."""
        known = self.versions()
        for number in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{number:012d}.json"), False)
        named = {p for n in known[-keep:] for p in self.manifest(n)["tables"].values()}
        gone = 0
        top = self._path(f"{self.root}/tables")
        for name in self._fs.listStatus(top) if self._fs.exists(top) else ():
            for folder in self._fs.listStatus(name.getPath()):
                if f"tables/{name.getPath().getName()}/{folder.getPath().getName()}" not in named:
                    gone += self._fs.delete(folder.getPath(), True)
        return gone


RESULTS = "record_id string, sequence bigint, state string, digest string"
IDS = "record_id string"


def flush_results(store: Store, fresh: DataFrame, *, writer: str, batch: int) -> bool:
    """One batch of a run into the stores of a run, all in one commit: ``results`` (a good result outlives a failed re-read), ``seen`` and ``awaiting``.

    ``fresh``: ``record_id, sequence, state, digest``; of several rows of an id the last counts.
    """
    if store.committed(writer, batch):
        return False
    newest = checkpoints.last_write_wins(fresh, "record_id", "sequence").select("record_id", "sequence", "state", "digest")
    done = newest.select("record_id", "state")
    seen, awaiting = store.table("seen", IDS), store.table("awaiting", IDS)
    completed = done.filter("state = 'completed'").select("record_id")
    owed = awaiting.union(done.filter("state = 'review_required'").select("record_id")).distinct().join(completed, "record_id", "left_anti")
    tables = {"results": checkpoints.merged_results(store.table("results", RESULTS), newest), "seen": seen.union(completed).distinct(), "awaiting": owed}
    return store.commit(tables, writer=writer, batch=batch)


def resumable(stream: DataFrame, store: Store, *, writer: str, checkpoint: str, flush: Callable = flush_results):
    """A stream writer that passes every micro-batch to ``flush(store, rows, writer=, batch=)``; start it with a trigger of choice.

    Spark repeats a batch that did not end, under the same number; the ledger makes that repeat harmless whether the crash came before or after
    the manifest was published.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: flush(store, rows, writer=writer, batch=batch) and None)


def job_batches(jobs: DataFrame, store: Store, *, current: list[str]) -> DataFrame:
    """Jobs that a run still has to do: those without a saved result of the same digest that can be used again.

    ``jobs``: ``record_id`` and ``current`` (columns that make up the digest).
    """
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in current]), 256)
    saved = store.table("results", RESULTS).filter(F.col("state").isin(checkpoints.REUSABLE)).select("record_id", "digest")
    return jobs.withColumn("digest", digest).join(saved, ["record_id", "digest"], "left_anti")
