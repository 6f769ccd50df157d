"""Chunkers, diffs, packing, reads, access, streams and the versioned store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarrylake.operators import access, chunking, diff, merkle, packing, ranking, reads, visibility
from quarrylake.plans.ingest import sync
from quarrylake.plans.search import candidates, chosen_roots, search
from quarrylake.plans.store import CLOSES, ROWS, Conflict, Generation, InProgress, Store
from quarrylake.sources.artifacts import read_jsonl, table_or_empty, write_jsonl
from quarrylake.sources.files import listing, read_ranges, scan
from quarrylake.streaming.follow import Streak, debounced, deduplicated, failure_streaks, file_stream, into_table

STATE = "root_id string, path string, size long, content_hash string"


def state(spark, files):
    return spark.createDataFrame([("r", p, len(h or ""), h) for p, h in files.items()], STATE)


def test_code_windows():
    assert chunking.code_windows("line 1\nline 2\nline 3\n") == [("line 1\nline 2\nline 3\n", 1, 3)]
    text = "".join(f"func f{i}() {{ return {i} }}\n" for i in range(220))
    out = chunking.code_windows(text)
    assert len(out) >= 2 and out[0][0].endswith("\n") and out[0][0].splitlines()[-1] in out[1][0]
    assert all(len(c.encode()) <= chunking.CODE_BYTES for c, *_ in out)
    assert chunking.code_windows("") == [] and chunking.code_windows("x" * 9000)[0][0] == "x" * 9000


def test_text_windows():
    assert [(a, b) for _, a, b in chunking.text_windows("# Intro\nline 2\n\n# Next\nline 5\n")] == [(1, 3), (4, 5)]
    text = " ".join(f"This is sentence number {i} of the paragraph." for i in range(80))
    out = chunking.text_windows(text)
    assert len(out) >= 2 and len(out[0][0].encode()) <= 2400 and out[0][0][-120:] in out[1][0]
    long = chunking.text_windows("ä" * 5000)
    assert "".join(c for c, *_ in long).count("�") == 0
    assert chunking.text_windows(" \n ") == []


def test_structured_chunks():
    mail = b"Subject: Budget\r\nFrom: a@b\r\n\r\n" + b"The budget is fine today. " * 300
    got = chunking.mail_chunks(mail)
    assert len(got) > 1 and all("Subject: Budget" in c for c, *_ in got)
    cards = "".join(f"BEGIN:VCARD\nFN:Person {i}\nORG:Acme;Unit\nEMAIL:p{i}@x.example\nNOTE:long note text here\nEND:VCARD\n" for i in range(80)).encode()
    got = chunking.record_chunks(cards, ["VCARD"], chunking.CONTACT_FIELDS, "Contact")
    assert len(got) > 1 and all(c.startswith("Contact ") and "BEGIN:VCARD" not in c for c, *_ in got) and "Organization: Acme Unit" in got[0][0]
    cal = b"BEGIN:VEVENT\nSUMMARY:Team\n  meeting\nLOCATION:Room\\, 2\nEND:VEVENT"
    assert chunking.record_chunks(cal, ["VEVENT", "VTODO"], chunking.EVENT_FIELDS, "Calendar item")[0][0] == "Calendar item 1\nTitle: Team meeting\nLocation: Room, 2"
    assert chunking.structured_value("a=20b\\n;c") == "a b c"


def test_media(spark):
    row = spark.range(1).select(chunking.media_ranges(F.lit(900)).alias("v"), chunking.media_ranges(F.lit(0)).alias("z")).first()
    assert [tuple(x) for x in row.v] == [(0, 0.0, 360.0), (1, 300.0, 660.0), (2, 600.0, 900.0)] and [tuple(x) for x in row.z] == [(0, 0.0, 360.0)]


def test_diff_roundtrip(spark):
    rnd = random.Random(2)
    a = {f"d{rnd.randrange(4)}/f{i}": rnd.choice(["h1", "h2", "h3", f"u{i}", None]) for i in range(60)}
    b = {p: (h if rnd.random() < 0.6 else f"n{p}") for p, h in a.items() if rnd.random() < 0.7} | {f"m/{p}": h for p, h in list(a.items())[:20]}
    old, new = state(spark, a), state(spark, b)
    moves = diff.with_moves(diff.diff_states(old, new))
    assert {r.path: r.content_hash for r in diff.apply_changes(old, diff.changed(moves)).collect()} == b
    pruned = {(r.path, r.status) for r in merkle.changed_files(merkle.tree(old.na.fill("")), merkle.tree(new.na.fill(""))).collect()}
    flat = {(r.path, r.status) for r in diff.changed(diff.diff_states(old.na.fill(""), new.na.fill(""))).collect()}
    assert pruned == flat
    assert diff.diff_states(old.limit(0), new.limit(0)).count() == 0


def test_moves_one_to_one(spark):
    old, new = state(spark, {f"a/{i}": "same" for i in range(300)}), state(spark, {f"b/{i}": "same" for i in range(200)})
    got = diff.with_moves(diff.diff_states(old, new))
    c = {r.status: r["count"] for r in got.groupBy("status").count().collect()}
    assert c == {"MOVED": 200, "REMOVED": 100} and got.select("old_path").where("old_path is not null").distinct().count() == 200


def test_packing(spark):
    rows = [("r", p, s, w, 80) for p, s, w in [("a", "ADDED", 80), ("b", "UNCHANGED", 1), ("c", "MODIFIED", 80), ("d", "REMOVED", 10)]]
    df = spark.createDataFrame(rows, "root_id string, path string, status string, size long, x int")
    by = lambda **k: [sorted(g) for g in {i: [r.path for r in packing.pack(df.where("status <> 'UNCHANGED'"), "root_id", "path", "size", **k).collect() if r.shard == i] for i in range(3)}.values() if g]
    assert by(most=2) == [["a", "c"], ["d"]] and by(limit=100) == [["a"], ["c", "d"]]
    assert sorted(sum(by(most=2, slice_rows=1), [])) == ["a", "c", "d"]


def test_packing_in_slices(spark):
    rows = [(f"r{g}", f"p{i:04}", (i * 7919 + g) % 50 if i % 9 else None) for g in range(3) for i in range(400 * g + 1)]
    df = spark.createDataFrame(rows, "root_id string, path string, size long")
    got = lambda n: {(r.root_id, r.path): r.shard for r in packing.pack(df, "root_id", "path", "size", most=23, limit=300, slice_rows=n).collect()}
    want, state = {}, {}
    for g, p, w in rows:
        shard, count, size = state.get(g, (0, 0, 0))
        if count and (count >= 23 or size + (w or 0) > 300):
            shard, count, size = shard + 1, 0, 0
        want[g, p], state[g] = shard, (shard, count + 1, size + (w or 0))
    assert got(50_000) == want and got(100) == want and got(37) == want


def test_visibility(spark):
    cases = [(1, 1, 0, True), (5, 1, 0, True), (2, 3, 0, False), (3, 1, 4, True), (4, 1, 4, False), (5, 1, 4, False), (0, 1, 0, False)]
    for seq, a, b, want in cases:
        df = spark.createDataFrame([(a, b)], "valid_from_generation_seq long, valid_to_generation_seq long")
        assert (df.where(visibility.visible(seq)).count() == 1) is want


def test_reads(spark):
    rows = [("r", "f", 0, "a\nb\nc\n", 1, 3), ("r", "f", 1, "c2\nd\n", 3, 4), ("r", "f", 2, None, 5, 6)]
    df = spark.createDataFrame(rows, "root_id string, file_path string, chunk_index int, content string, line_start int, line_end int")
    assert [(r.line, r.content) for r in reads.read_lines(df, 2, 9).collect()] == [(2, "b\n"), (3, "c\n"), (4, "d\n")]
    assert reads.parse_range("3:9") == (3, 9) and reads.parse_range("4") == (4, 4)
    for bad in ["0", "5:4", "1:2000"]:
        with pytest.raises(ValueError):
            reads.parse_range(bad)


def test_access(spark):
    rows = spark.createDataFrame([("r", p, "h") for p in ["allowed/a.md", "private/b.md", "private/nested/c.md", "top.md"]], "root_id string, file_path string, file_hash string")
    denies = spark.createDataFrame([("r", "/private/")], "root_id string, path_prefix string")
    assert sorted(r.file_path for r in access.without_denied(rows, denies).collect()) == ["allowed/a.md", "top.md"]
    assert access.without_denied(rows, spark.createDataFrame([("r", "/")], denies.schema)).count() == 0
    assert access.proven(rows, spark.createDataFrame([], "root_id string, path string, hash string")).count() == 0


def test_ranking(spark):
    d = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "none here")], "id long, t string")
    got = ranking.top(ranking.bm25(d, "t", "red FOX"), 5, ["id"]).collect()
    assert [r.id for r in got] == [1, 2] and ranking.bm25(d, "t", "?!").count() == 0
    assert ranking.overfetch(1) == 50 and ranking.overfetch(20) == 200 and ranking.overfetch(500) == 1000
    assert chosen_roots(root_ids=["a", "b", "a"]) == ["a", "b"]
    with pytest.raises(ValueError):
        chosen_roots("a", all_roots=True)


def test_streak():
    s = Streak()
    delays = []
    for i in range(8):
        s.failed("net", float(i))
        delays.append(s.delay)
    assert delays == [1, 2, 4, 8, 16, 32, 60, 60] and s.exhausted(7.0)
    s.failed("disk", 8.0)
    assert s.times == 1 and not s.exhausted(9.0) and s.exhausted(700.0)


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("k", t0 + dt.timedelta(seconds=s), e) for s, e in [(0, None), (1, "x"), (1.5, "x"), (60, "y")]] + [("z", t0 + dt.timedelta(days=2), None)]
    spark.createDataFrame(rows, "k string, ts timestamp, e string").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = lambda: file_stream(spark, f"{tmp_path}/in", "k string, ts timestamp, e string")
    into_table(deduplicated(s(), "k", "ts"), f"{tmp_path}/d", f"{tmp_path}/dc").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/d").collect()) == ["k", "z"]
    into_table(debounced(s(), "k", "ts"), f"{tmp_path}/b", f"{tmp_path}/bc").awaitTermination()
    assert sorted(r.events for r in spark.read.parquet(f"{tmp_path}/b").collect()) == [1, 3]
    into_table(failure_streaks(s(), "k", "ts", "e"), f"{tmp_path}/f", f"{tmp_path}/fc").awaitTermination()
    assert [(r.times, r.delay) for r in spark.read.parquet(f"{tmp_path}/f").orderBy("at").collect()] == [(1, 1.0), (2, 2.0), (1, 1.0)]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    write_jsonl(df, f"{tmp_path}/j", per_file=1, gzip=True)
    assert read_jsonl(spark, f"{tmp_path}/j", "i int, s string").count() == 2
    assert table_or_empty(spark, f"{tmp_path}/none", "i int").count() == 0


def test_sync_lifecycle(spark, tmp_path):
    src = tmp_path / "src"
    (src / "docs").mkdir(parents=True)
    (src / "docs/a.md").write_text("# A\nalpha text\n")
    (src / "docs/b.txt").write_text("beta text\n")
    (src / ".env").write_text("secret")
    (src / "x.log").write_text("ignored")
    store = Store(spark, str(tmp_path / "store"))
    files = lambda: listing(spark, str(src), "r", ["*.log"])
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    one = sync(store, "r", files(), embed=embed)
    rows = store.visible_rows("r").collect()
    assert sorted(r.file_path for r in rows) == ["docs/a.md", "docs/b.txt"] and all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in rows)
    (src / "docs/a.md").write_text("# A\ngamma\n")
    (src / "docs/b.txt").rename(src / "docs/c.txt")
    two = sync(store, "r", files(), embed=embed)
    now = {r.file_path: r for r in store.visible_rows("r").collect()}
    assert sorted(now) == ["docs/a.md", "docs/c.txt"] and "gamma" in now["docs/a.md"].content and now["docs/c.txt"].vector
    assert sorted(r.file_path for r in store.visible_rows("r", one).collect()) == ["docs/a.md", "docs/b.txt"]
    with pytest.raises(Conflict):
        store.begin("r", one)
    assert (one, two) == (1, 2)
    (src / "docs/a.md").unlink()
    (src / "docs/c.txt").write_text("new")
    sync(store, "r", files(), embed=embed, include=["docs/a.md"])
    assert [r.file_path for r in store.visible_rows("r").collect()] == ["docs/c.txt"] and "beta" in store.visible_rows("r").first().content
    assert store.abandoned("r") == []
    readable = spark.createDataFrame([("r",)], "root_id string")
    found = search(candidates(store.rows("r"), store.visible_seq("r"), readable, glob="docs/**"), "beta", "hybrid", 3, embed(["beta"])[0])
    assert [r.file_path for r in found.collect()] == ["docs/c.txt"]
    ranged = read_ranges(spark.createDataFrame([("k", bytearray(b"abcdef"))], "path string, content binary"), spark.createDataFrame([("k", 2, 3), ("k", 0, 0)], "key string, offset long, length long"))
    assert sorted(bytes(r.content) for r in ranged.collect()) == [b"abcdef", b"cde"]
    st = scan(files())
    assert scan(files(), st).orderBy("path").collect() == st.orderBy("path").collect()


def generation(spark, store, g, names):
    rows = spark.createDataFrame([(n, "r", n, g.seq) for n in names], "id string, root_id string, file_path string, valid_from_generation_seq long")
    full = rows.select(*(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in ROWS.split(", "))))
    store.write(g, full, spark.createDataFrame([], CLOSES), rows.select("root_id", F.col("file_path").alias("path"), F.lit(1).cast("long").alias("size"), F.lit("h").alias("content_hash"), F.lit(0).cast("long").alias("mtime")))


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    names = lambda: sorted(r.id for r in store.visible_rows("r").collect())
    a = store.begin("r")
    with pytest.raises(InProgress):
        store.begin("r")
    b = store.begin("r", timeout=0)  # a took too long
    assert (a.base, b.base) == (0, 0) and a.seq != b.seq and store.status("r") == {1: "failed", 2: "building"}
    generation(spark, store, b, ["b"])
    store.commit(b)
    generation(spark, store, a, ["a"])
    with pytest.raises(Conflict):
        store.commit(a)
    store.commit(b)  # again: nothing happens
    assert names() == ["b"]
    with pytest.raises(ValueError):
        store.drop(b)
    store.drop(a)
    assert store.abandoned("r") == [] and names() == ["b"]
    # both hold the same base and seq, as if both had been begun at once
    c = store.begin("r")
    d = Generation("r", c.seq, c.base, "twin")
    generation(spark, store, c, ["c"])
    generation(spark, store, d, ["d"])
    store.commit(c)
    with pytest.raises(Conflict):
        store.commit(d)
    assert names() == ["b", "c"] and store.status("r") == {1: "failed", 2: "visible", 3: "visible"}
    e = store.begin("r", base=c.seq)
    generation(spark, store, e, ["d"])
    store.commit(e)
    assert names() == ["b", "c", "d"] and {r.id: r.valid_from_generation_seq for r in store.rows("r").collect()} == {"b": 2, "c": 3, "d": 4}
    store.drop("r")
    assert store.visible_seq("r") == 0 and names() == []


def test_sync_retries_on_conflict(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.md").write_text("alpha")
    store = Store(spark, str(tmp_path / "store"))
    commit, times = Store.commit, []

    def late(self, g):
        if not times:
            times.append(g.seq)
            other = Generation("r", 50, g.base, "other")
            generation(spark, store, other, ["z.md"])
            commit(self, other)
        commit(self, g)

    monkeypatch.setattr(Store, "commit", late)
    seq = sync(store, "r", listing(spark, str(tmp_path / "src"), "r"))
    assert times == [1] and seq > 50 and store.visible_seq("r") == seq and [r.file_path for r in store.visible_rows("r").collect()] == ["a.md"]
    assert sorted(r.file_path for r in store.visible_rows("r", 50).collect()) == ["z.md"] and store.abandoned("r") == []


def test_events_and_reports(spark):
    from quarrylake.operators.events import dry_run, enriched

    df = spark.createDataFrame([(1, {"a": "x", "b": None}), (2, None)], "i int, m map<string,string>")
    got = {r.i: r.props for r in enriched(df, F.col("m"), {"a": "shared", "c": "y"}).collect()}
    assert got == {1: {"a": "x", "c": "y"}, 2: {"a": "shared", "c": "y"}}
    stats = diff.diff_stats(diff.with_moves(diff.diff_states(state(spark, {"a": "h", "b": "k"}), state(spark, {"a": "g", "c": "k"}))))
    assert dry_run(stats).first().report == "1 modified, 1 renamed; 1 uploads, 1 B"
