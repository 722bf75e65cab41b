"""Keyed state on streams and resumable commits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import pinned
from tidemark.streaming import commits, keyed

BASE = dt.datetime(2026, 10, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in keyed.STATE_STORE}
    for k, v in keyed.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def drop_files(spark, folder, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={n:03}")


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_settling_over_restarts(rocks, tmp_path):
    schema = "record_id string, sequence long, state string"
    rng = random.Random(5)
    batches, n = [], 0
    for _ in range(4):
        rows = []
        for _ in range(40):
            n += 1
            rows.append((f"r{rng.randrange(25)}", n, rng.choice(["completed", "review_required", "failed", "deferred"])))
        batches.append(rows)
    batches[1] += [(None, 999, "completed"), ("", 998, "completed")]
    want, seen, owed = [], set(), set()
    for record, _, state in sorted((r for b in batches for r in b if r[0]), key=lambda r: r[1]):
        if state == "completed":
            if record in owed:
                owed.discard(record)
                want.append((record, "released"))
            if record not in seen:
                seen.add(record)
                want.append((record, "seen"))
        elif state == "review_required" and record not in owed:
            owed.add(record)
            want.append((record, "awaiting"))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for stop in (2, 4):  # the second run starts from the first one's checkpoint
        drop_files(rocks, source, batches[:stop], schema) if stop == 2 else [rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part={n:03}") for n, rows in list(enumerate(batches))[2:]]
        stream = rocks.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).parquet(source).drop("part")
        run(keyed.settling(stream), out, checkpoint)
    assert sorted(map(tuple, rocks.read.parquet(out).collect())) == sorted(want)


def test_job_ends(rocks, tmp_path):
    schema = "job_id string, status string, polled_at timestamp"
    at = lambda s: BASE + dt.timedelta(seconds=s)
    batches = [
        [("a", "IN_PROGRESS", at(0)), ("b", "IN_PROGRESS", at(5)), ("c", "FAILED", at(6))],
        [("a", "IN_PROGRESS", at(60)), ("a", "SUCCEEDED", at(90)), ("a", "FAILED", at(91)), ("c", "SUCCEEDED", at(95))],
        [("d", "IN_PROGRESS", at(700))],  # moves the watermark past b's patience
        [("b", "SUCCEEDED", at(1400)), ("d", "PARTIAL_SUCCESS", at(1401))],
        [("e", "IN_PROGRESS", at(5000))],
        [("e", "IN_PROGRESS", at(5001))],
    ]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for n, rows in enumerate(batches):
        rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/part={n:03}")
        stream = rocks.readStream.schema(f"{schema}, part int").parquet(source).drop("part")
        run(keyed.job_ends(stream, patience_seconds=600), out, checkpoint)
    got = {r.job_id: (r.status, r.polls) for r in rocks.read.parquet(out).collect()}
    assert rocks.read.parquet(out).count() == len(got)
    assert got == {"a": ("SUCCEEDED", 3), "b": ("TIMED_OUT", 1), "c": ("FAILED", 1), "d": ("PARTIAL_SUCCESS", 2)}


RESULTS = "record_id string, sequence long, state string, digest string"


def result_batches():
    rng, n, out = random.Random(9), 0, []
    for _ in range(4):
        rows = []
        for _ in range(30):
            n += 1
            rows.append((f"r{rng.randrange(20)}", n, rng.choice(["completed", "review_required", "failed", "deferred"]), f"d{n}"))
        out.append(rows)
    return out


def contents(store):
    return {name: sorted(map(tuple, store.table(name, schema).collect())) for name, schema in (("results", commits.RESULTS), ("seen", commits.IDS), ("awaiting", commits.IDS))}


def flushed(spark, tmp_path, name, break_at):
    """Runs the sink over the batches; the run breaks once before or after the manifest of batch 2 is published, and starts again."""
    source = str(tmp_path / "source")
    store = commits.Store(spark, str(tmp_path / name))
    publish, broken = store._publish, []

    def torn(manifest):
        if manifest["version"] == 3 and not broken:
            broken.append(manifest)
            if break_at == "after":
                publish(manifest)
            raise RuntimeError("the run was killed here")
        publish(manifest)

    if break_at:
        store._publish = torn
    seen_versions = []
    for _ in range(2 if break_at else 1):
        stream = spark.readStream.schema(f"{RESULTS}, part int").option("maxFilesPerTrigger", 1).parquet(source).drop("part")
        writer = commits.resumable(stream, store, writer="reader", checkpoint=str(tmp_path / f"{name}-checkpoint"))
        query = writer.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            assert "killed here" in str(e)
        seen_versions.append(store.manifest()["version"])
    return store, seen_versions


@pytest.mark.parametrize("break_at", ["before", "after"])
def test_killed_run_gives_the_rows_of_an_undisturbed_one(spark, tmp_path, break_at):
    drop_files(spark, str(tmp_path / "source"), result_batches(), RESULTS)
    whole, versions = flushed(spark, tmp_path, "whole", None)
    assert versions == [4]
    torn, versions = flushed(spark, tmp_path, "torn", break_at)
    assert versions == [2 if break_at == "before" else 3, 4]
    assert contents(torn) == contents(whole)
    newest = {}
    for rows in result_batches():
        for record, sequence, state, digest in {r[0]: r for r in rows}.values():
            old = newest.get(record)
            if not (old and old[2] in ("completed", "review_required") and state in ("failed", "deferred")):
                newest[record] = (record, sequence, state, digest)
    assert contents(torn)["results"] == sorted(newest.values())
    older = torn.table("results", commits.RESULTS, version=2).count()
    assert 0 < older <= len(newest)
    assert torn.sweep() == 3 * 3 + (3 if break_at == "before" else 0) and contents(torn) == contents(whole)


def test_commits_conflict_and_ledger(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"))
    assert store.manifest() == commits.EMPTY and store.table("seen", commits.IDS).count() == 0
    rows = spark.createDataFrame([("a",)], commits.IDS)
    assert store.commit({"seen": rows}, writer="w", batch=0) and not store.commit({"seen": rows.union(rows)}, writer="w", batch=0)
    with pytest.raises(commits.Conflict):
        store._publish({"version": 1, "tables": {}, "batches": {}})
    assert store.commit({"awaiting": rows}, writer="v", batch=0)
    assert store.manifest()["batches"] == {"w": 0, "v": 0} and store.table("seen", commits.IDS).count() == 1
    jobs = spark.createDataFrame([("a", "x"), ("b", "y")], "record_id string, body string")
    first = commits.job_batches(jobs, store, current=["body"])
    assert first.count() == 2
    done = first.select("record_id", F.lit(1).cast("long").alias("sequence"), F.when(F.col("record_id") == "a", "completed").otherwise("failed").alias("state"), "digest")
    assert commits.flush_results(store, done, writer="w", batch=1)
    assert [r.record_id for r in commits.job_batches(jobs, store, current=["body"]).collect()] == ["b"]
    changed = jobs.withColumn("body", F.lit("z"))
    assert commits.job_batches(changed, store, current=["body"]).count() == 2


def test_pinned_views(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "pinned"))
    view = pinned.Pinned(store)
    with pytest.raises(pinned.Unavailable):
        view.table("seen", commits.IDS)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], commits.IDS)
    store.commit({"seen": rows("a")}, writer="w", batch=0)
    assert [r.record_id for r in view.table("seen", commits.IDS).collect()] == ["a"] and not view.stale()
    store.commit({"seen": rows("a", "b")}, writer="w", batch=1)
    assert view.table("seen", commits.IDS).count() == 1 and view.stale()
    assert view.reload() == 2 and view.table("seen", commits.IDS).count() == 2 and not view.stale()
