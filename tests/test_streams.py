"""Streams over several micro-batches, against the same rules on the whole."""

import datetime as dt

from pyspark.sql import functions as F

from docwarp.operators.scratch import scratch_path
from docwarp.operators.sinks import scan_folder
from docwarp.streaming import intake, timers

AT = dt.datetime(2024, 1, 1)


def parts(spark, batches, schema):
    """A stream that takes one file a micro-batch."""
    path = scratch_path(spark, "stream")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/n={i}")
    return spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(path)


def test_timers(spark):
    minute = lambda m: AT + dt.timedelta(minutes=m)
    batches = [
        [("a", minute(0), True), ("b", minute(0), True), ("c", minute(1), True)],
        [("a", minute(5), False), ("c", minute(3), True)],
        [("b", minute(14), True), ("d", minute(15), True), ("d", minute(40), False)],
        [("e", minute(100), True)],
    ]
    events = parts(spark, batches, "key string, ts timestamp, starts boolean").drop("n")
    out = timers.run(timers.expirations(events, 600, "1 minute"), scratch_path(spark, "out"), scratch_path(spark, "check"))
    got = {(r.key, r.started_at): r.expired_at for r in out.collect()}
    assert got == {("b", minute(0)): minute(10), ("c", minute(1)): minute(11), ("d", minute(15)): minute(25)}


def test_timers_go_on_after_a_restart(spark):
    minute = lambda m: AT + dt.timedelta(minutes=m)
    schema = "key string, ts timestamp, starts boolean"
    path, out, check = (scratch_path(spark, n) for n in ("stream", "out", "check"))

    def go(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/n={n}")
        events = spark.readStream.schema(schema).parquet(f"{path}/n=*")
        return {(r.key, r.started_at) for r in timers.run(timers.expirations(events, 600, "1 minute"), out, check).collect()}

    assert go(0, [("a", minute(0), True), ("b", minute(2), True), ("x", minute(3), False)]) == set()
    assert go(1, [("a", minute(6), False), ("y", minute(8), False)]) == set()
    assert go(2, [("z", minute(20), False)]) == {("b", minute(2))}
    assert go(3, [("b", minute(30), True), ("z", minute(60), False)]) == {("b", minute(2))}  # it rests until it is ended


SEEN = "source_path string, hash string, seen_at timestamp"


def test_intake_is_idempotent(spark):
    seen = lambda s: AT + dt.timedelta(seconds=s)
    batches = [[("a", "h1", seen(0)), ("b", "h1", seen(0))], [("a", "h1", seen(5))], [("a", "h2", seen(6)), ("a", "h3", seen(7)), ("c", "h9", seen(7))], [(None, "h", seen(8)), ("b", None, seen(8))]]
    path = scratch_path(spark, "catalogue")
    intake.take_in(parts(spark, batches, SEEN).drop("n"), path, scratch_path(spark, "check"))
    now = intake.catalogue(spark, path)
    want = {("a", "h3", 2), ("b", "h1", 1), ("c", "h9", 1)}
    assert {(r.source_path, r.hash, r.revision_no) for r in now.collect()} == want
    again = intake.merged(now, spark.createDataFrame(batches[2], SEEN))
    assert {(r.source_path, r.hash, r.revision_no) for r in again.collect()} == want


def test_intake_writes_what_a_batch_changes(spark):
    log = intake.Log(spark, scratch_path(spark, "catalogue"), fold=2)
    state, sizes = {}, []
    for n in range(5):
        paths = range(2000) if n == 0 else range(n, n + 3)
        rows = [(f"p{i}", f"h{n if i % 2 else 0}", AT + dt.timedelta(seconds=n)) for i in paths]
        for p, h, _ in rows:
            old = state.get(p, (None, 0))
            state[p] = old if old[0] == h else (h, old[1] + 1)
        for _ in range(2 if n == 3 else 1):  # an attempt that failed after its writes comes again
            log.append(spark.createDataFrame(rows, SEEN), n)
        sizes.append(log.read([(0, n)]).count())
        assert {r.source_path: (r.hash, r.revision_no) for r in intake.catalogue(spark, log.path, 2).collect()} == state
    assert sizes[0] == 2000 and max(sizes[1:]) <= 3
    assert log.cover(5) == [(0, 4), (2, 3)]
    assert not log.whole(0, 0) and not log.whole(1, 1)


def test_scan_folder(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, size in (("a.HWP", 3), ("deep/b.pdf", 5), ("deep/er/c.docx", 1), ("deep/d.txt", 1), ("noext", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {(r.path.rsplit("/", 1)[1], r.length) for r in scan_folder(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.HWP", 3), ("b.pdf", 5), ("c.docx", 1)}
    assert scan_folder(spark, f"file://{tmp_path}").where(F.col("length") > 100).count() == 0
