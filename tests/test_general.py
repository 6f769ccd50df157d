"""The general training-data operators on small cases: nulls, ties, repeats, empty tables, clashing names, hot keys."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quarrylake.operators.delivery import admit, best_first, kept_deliveries, message_key, surplus_deliveries
from quarrylake.operators.history import file_versions
from quarrylake.operators.snapshots import snapshot_changes

T0 = dt.datetime(2025, 1, 1)
JOBS = "delivery_id long, job_id string, attempts int, lease_until timestamp, `__delivery_key` string"


def jobs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], JOBS)


def surplus(df):
    return sorted(r[0] for r in surplus_deliveries(df, message_key(F.col("job_id")), best_first(), ["delivery_id"]).select("delivery_id").collect())


def test_surplus_order_nulls_and_spelling(spark):
    rows = [
        (1, "a", 1, T0), (2, " A\t", 2, None), (3, "a\r\n", 2, T0), (4, "a", None, T0), (5, None, 9, T0), (6, "", 9, T0), (7, " ", 9, T0),
        (8, "a-x", 1, T0), (9, "b", None, None), (10, "b", None, None), (11, "c", 3, T0), (12, "C", 3, T0),
    ]
    assert surplus(jobs(spark, rows)) == [1, 2, 4, 10, 12]
    kept = kept_deliveries(jobs(spark, rows), message_key(F.col("job_id")), best_first(), ["delivery_id"])
    assert sorted(r.delivery_id for r in kept.collect()) == [3, 5, 6, 7, 8, 9, 11]


def test_surplus_empty_and_hot(spark):
    assert surplus(jobs(spark, [])) == []
    hot = [(i, "hot" if i % 3 == 0 else f"j{i}", i % 5, T0) for i in range(3000)]
    out = surplus(jobs(spark, hot))
    best = min((i for i in range(0, 3000, 3) if i % 5 == 4))
    assert out == [i for i in range(0, 3000, 3) if i != best]


def test_admit(spark):
    stored = jobs(spark, [(1, "a", 1, T0), (2, None, 1, T0), (3, "a", 1, T0)])
    batch = jobs(spark, [(4, "A ", 9, T0), (5, "n", 1, T0), (6, "N", 2, T0), (7, None, 1, T0), (8, "", 1, T0)])
    got = admit(batch, stored, "job_id", best_first(), ["delivery_id"])
    assert sorted(r.delivery_id for r in got.collect()) == [6, 7, 8]
    assert admit(batch.limit(0), stored, "job_id", best_first(), ["delivery_id"]).count() == 0
    assert admit(batch, stored.limit(0), "job_id", best_first(), ["delivery_id"]).count() == 4


LOG = "row_no long, op string, written_at timestamp, root_id string, file_path string, file_hash string, valid_from_generation_seq long, valid_to_generation_seq long"


def brute_versions(rows):
    files = {}
    for no, op, at, root, path, h, start, end in rows:
        ev = files.setdefault((root, path), {})
        h = h.strip().lower().removeprefix("sha256:") if h else None
        if op == "upsert" and h and start is not None:
            old = ev.get(start)
            if old is None or old[2] is None or (at is not None and (old[0] is None or (at, no) >= (old[0], old[1]))) or (at is None and old[0] is None and no >= old[1]):
                ev[start] = (at, no, h)
        if end and (op == "close" or (start is not None and end > start)):
            ev.setdefault(end, (None, -1, None))
    out = []
    for (root, path), ev in files.items():
        cur = None
        for seq in sorted(ev):
            h = ev[seq][2]
            if cur and cur[0] != h:
                out.append((root, path, cur[1], seq))
                cur = None
            if h and not cur:
                cur = (h, seq)
        if cur:
            out.append((root, path, cur[1], 0))
    return sorted(out)


def test_versions_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for no in range(3000):
        path = "hot" if no % 3 == 0 else f"f{rnd.randrange(60)}"
        op = "close" if rnd.random() < 0.15 else "upsert"
        start = rnd.choice([None, *range(5)]) if rnd.random() < 0.02 else rnd.randrange(1, 2500)
        h = rnd.choice([None, "", "aa", "AA", "sha256:aa", "SHA256:BB", "bb", "cc"])
        end = rnd.choice([0, 0, None, rnd.randrange(1, 2500)])
        rows.append((no, op, rnd.choice([None, T0 + dt.timedelta(minutes=rnd.randrange(50))]), "r", path, None if op == "close" else h, None if op == "close" else start, end))
    want = brute_versions(rows)
    got = file_versions(spark.createDataFrame(rows, LOG)).drop("file_hash")
    assert sorted(map(tuple, got.collect())) == want


def test_versions_small(spark):
    assert file_versions(spark.createDataFrame([], LOG)).count() == 0
    rows = [(1, "upsert", T0, "r", "p", "a", 5, 0), (2, "close", T0, "r", "p", None, None, 9), (3, "upsert", T0, "r", "p", "a", 9, 0), (4, "upsert", T0, "r", "p", "a", 12, 3)]
    got = sorted(map(tuple, file_versions(spark.createDataFrame(rows, LOG)).drop("file_hash").collect()))
    assert got == [("r", "p", 5, 0)]


STATES = "root_id string, generation_seq long, received_at timestamp, path string, size long, content_hash string, mtime long, i int, h string, pi int"


def test_snapshot_changes(spark):
    rows = [
        ("r", 1, T0, "a", 1, "X", 1), ("r", 1, T0, "./b", 1, "y", 1), ("r", 1, T0, "n", 1, None, 1),
        ("r", 4, T0, "a", 1, "sha256:x", 9), ("r", 4, T0, "b", 1, "z", 2), ("r", 4, T0, "b", 1, "old", 1), ("r", 4, T0, "n", 1, "q", 1), ("r", 4, T0, "n", 1, "q", 1),
        ("r", 9, T0, "c", 1, "c", 1), ("r", 9, T0, None, 1, "c", 1), ("r", 11, T0, "a", 2, "x", 1), ("s", 2, T0, "only", 1, "x", 1),
    ]
    df = spark.createDataFrame([(*r, 7, "clash", 7) for r in rows], STATES)
    got = sorted(tuple(x) for x in snapshot_changes(df).collect())
    assert got == sorted([
        ("r", 4, "b", "CHANGED"), ("r", 9, "a", "REMOVED"), ("r", 9, "b", "REMOVED"), ("r", 9, "n", "REMOVED"), ("r", 9, "c", "ADDED"), ("r", 11, "c", "REMOVED"), ("r", 11, "a", "ADDED"),
    ])
    assert snapshot_changes(df.limit(0)).count() == 0


def test_queue_outcomes_and_barrier(spark):
    from quarrylake.operators import queues

    rows = [(1, "chunk", 2, "failed"), (2, "chunk", 3, "failed"), (3, "commit", 29, "failed"), (4, "commit", 30, "failed"), (5, "chunk", None, "failed"), (6, "chunk", 9, "done"), (7, "commit", 50, "late"), (8, None, 3, None)]
    df = spark.createDataFrame(rows, "i int, stage string, attempts int, status string")
    got = {r.i: (r.action, r.delay) for r in queues.outcomes(df, F.col("status") == "failed", F.col("status") == "late").collect()}
    assert got == {1: ("retry", 40), 2: ("fail", None), 3: ("retry", 8410), 4: ("fail", None), 5: ("retry", 1), 6: ("ack", None), 7: ("wait", 5), 8: ("ack", None)}
    shards = [("a", 0, 2, "done"), ("a", 1, 2, "failed"), ("a", 1, 2, "done"), ("b", 0, 2, "done"), ("b", 2, 2, "done"), ("c", None, None, "done"), ("d", 0, 1, None)]
    df = spark.createDataFrame(shards, "k string, shard_index int, total_shards int, status string")
    got = {r.k: (r.done, r.failed, r.open, r.ready) for r in queues.barrier(df, ["k"], F.col("status")).collect()}
    assert got == {"a": (2, 0, 0, True), "b": (2, 0, 0, False), "c": (0, 0, 0, False), "d": (0, 0, 1, False)}


def test_namespaces(spark):
    from quarrylake.functions.hashes import path_shard
    from quarrylake.operators import namespaces

    import datetime as dt

    old = dt.datetime(2025, 1, 1)
    rows = [("ok", 0, 2, "o0", None), ("ok", 1, 2, "o1", None), ("ok", 1, 2, "gone", old), ("gap", 0, 2, "g0", None), ("mix", 0, 2, "m0", None), ("mix", 1, 3, "m1", None), ("out", 0, 1, "x0", None), ("out", 1, 1, "x1", None), ("none", 0, 1, "n0", old), ("zero", 0, 0, "z0", None)]
    ns = spark.createDataFrame(rows, "root_id string, shard_index int, shard_count int, namespace string, retired_at timestamp")
    assert {r.root_id: r.error for r in namespaces.shard_errors(ns).collect()} == {"gap": "missing shards", "mix": "shard count mismatch", "out": "invalid shard index", "none": "no active namespaces"}
    assert [r.namespace for r in namespaces.active_shards(ns.where("root_id = 'ok'")).collect()] == ["o0", "o1"]
    paths = spark.createDataFrame([("ok", "docs/readme.md"), ("ok", "queued/architecture.md"), ("gap", "a"), ("zero", "a"), ("nowhere", "a"), ("ok", None)], "root_id string, path string")
    got = {(r.root_id, r.path): r.namespace for r in namespaces.path_namespaces(paths, ns).collect()}
    assert got == {("ok", "docs/readme.md"): "o1", ("ok", "queued/architecture.md"): "o0", ("gap", "a"): None, ("zero", "a"): "z0", ("nowhere", "a"): None, ("ok", None): None}
    assert spark.range(1).select(path_shard(F.lit("ops/runbooks/deploy/rollback.txt"), 4)).first()[0] == 2


def test_policies(spark):
    from quarrylake.functions.paths import ignored_by_patterns
    from quarrylake.operators.diff import policy_violations

    changes = spark.createDataFrame([("r", "a.pdf", "ADDED"), ("r", "b.pdf", "REMOVED"), ("r", "keep/c.md", "MOVED"), ("r", "tmp/d.md", "MOVED"), ("r", " ", "ADDED"), ("r", None, "ADDED")], "root_id string, path string, status string")
    assert sorted(r.path for r in policy_violations(changes, ["*.pdf"], ["tmp/"]).collect()) == ["a.pdf", "tmp/d.md"]
    assert policy_violations(changes, ["", "# none"]).count() == 0
    lines = spark.createDataFrame([("", f"never{i}") for i in range(2500)] + [("", "*.pdf"), ("keep", "c.md"), (None, None)], "folder string, line string")
    assert sorted(r.path for r in ignored_by_patterns(changes.where("path is not null"), lines).collect()) == [" ", "tmp/d.md"]


def test_closes_of_a_hot_path(spark):
    from quarrylake.operators.visibility import with_closes

    rows = [("r", "f", i) for i in range(1, 60)] + [("r", "g", 5), (None, "h", 1)]
    closes = [("r", "f", i, i + 1) for i in range(10, 50, 3)] + [("r", "f", 99, 30), ("r", "g", 4, 9)]
    a = spark.createDataFrame(rows, "root_id string, file_path string, valid_from_generation_seq long")
    b = spark.createDataFrame(closes, "root_id string, file_path string, base_seq long, gen_seq long")
    got = {(r.file_path, r.valid_from_generation_seq): r.valid_to_generation_seq for r in with_closes(a, b).collect()}
    want = {(p, s): min((g for _, q, base, g in closes if q == p and s <= base and g > s), default=0) for _, p, s in rows}
    assert got == want
