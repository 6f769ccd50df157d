"""The llm operators on Spark: nulls, empty and long texts, ties, repeats, empty tables, clashing names; queries against SQL."""

import base64
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import leaks, queries
from quarrylake.llm.leaks import leaked_items
from quarrylake.llm.mojibake import garbled_texts
from quarrylake.llm.neardup import similar_rows
from quarrylake.llm.neighbours import nearest_neighbours
from quarrylake.llm.scans import repaired_pages, scan_traces
from quarrylake.llm.splitting import split_oversized
from quarrylake.llm.tokens import BYTE_BPE_PATTERN, encode_corpus
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, data, name):
    if "p8" in name and not os.path.exists(queries.TOKENIZERS):
        pytest.skip("no vocabularies")
    if name in queries.ORACLE:
        same(spark, con, data, queries.QUERIES[name], queries.ORACLE[name])
    else:
        assert queries.QUERIES[name](spark, data).count() > 0


def pairs(df):
    return sorted(tuple(r) for r in similar_rows(df, "k").collect())


def test_similar_rows(spark):
    base = " ".join(f"word{i}" for i in range(40))
    texts = [base, base, base + " tail", base.upper(), None, "", "two words", "two words", "one two three", "one, two: three!", "x " * 3000, "x " * 2999]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "k long, content string, id string, tok int")
    assert pairs(df) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (8, 9), (10, 11)]
    assert pairs(df.limit(0)) == [] and pairs(df.where("content is null")) == []


def test_similar_rows_hot_copies(spark):
    df = spark.range(90).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "one two three four five").otherwise(F.concat(F.lit("a b c d e f g "), F.col("id").cast("string"), F.lit(" x y "), (F.col("id") * 7).cast("string"))).alias("content"))
    assert len([p for p in pairs(df) if p[0] % 3 == 0 and p[1] % 3 == 0]) == 30 * 29 // 2


def test_similar_rows_in_buckets_and_with_a_full_sketch(spark):
    """The same pairs whatever the size of buckets and sketch."""
    from quarrylake.llm import neardup

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 50 + i % 3])) for i in range(40)] + [(100 + i, " ".join(words[i : i + 30])) for i in range(25)] + [(200 + i, f"{i} a {i} b {i} c") for i in range(20)]
    df = spark.createDataFrame(rows, "k long, content string")
    shingles = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in rows}
    want = sorted((a, b) for a in shingles for b in shingles if a < b and 10 * len(shingles[a] & shingles[b]) >= 7 * len(shingles[a] | shingles[b]))
    for bucket, bits in ((512, 20), (3, 16), (7, 18)):
        got = neardup.expanded_pairs(*neardup.similar_classes(df, "k", sketch_bits=bits), bucket)
        assert sorted(tuple(r) for r in got.collect()) == want
    full = np.full(1 << 16, 20, np.uint8)  # every counter far above 2**GROUP_BITS: none stands out
    assert neardup.hot_class(full) > 20 and neardup.hot_class(np.zeros(4, np.uint8)) == neardup.GROUP_BITS


def page_table(spark, pages, clean=()):
    rows = [(i, f"f{f}", n, n, t, "clash", 5) for i, (f, n, t) in enumerate(pages)] + [(1000 + i, "c", i, None, t, "clash", 5) for i, t in enumerate(clean)]
    return spark.createDataFrame(rows, "chunk_key long, file_path string, chunk_index int, page_number int, content string, form string, n int")


CLEAN = ["The footnote was reviewed by the committee before the follow-up meeting and every member signed the western tower report"] * 30
PAGES = [
    (1, 0, "Annual Report Of Tower\nThe foot-\nnote was reviewed by the com­\nmittee.\n\nEvery member signed.\n  - 12 -"),
    (1, 1, "ANNUAL REPOR+ OF TOWER\nThe follow-\nup meeting was reviewed by every rnember.\n305\nThe report.\n13 / 20"),
    (1, 2, "The western tower report.\nThe meeting was reviewed."),
    (2, 0, "Annual Report Of Tower\nThe meeting was signed."),
    (2, 1, None),
    (2, 2, ""),
]


def test_scan_traces(spark):
    df = page_table(spark, PAGES, CLEAN)
    page = F.col("page_number").isNotNull()
    got = {}
    for k, kind in scan_traces(df, page).collect():
        got.setdefault(k, set()).add(kind)
    assert got == {0: {"header", "page_number", "hyphen"}, 1: {"header", "page_number", "misread"}}
    assert scan_traces(df.limit(0), page).count() == 0
    texts = {r.chunk_key: r.text for r in repaired_pages(df, page).collect()}
    assert texts[0] == "The footnote was reviewed by the committee.\n\nEvery member signed."
    assert texts[1] == "The follow-up meeting was reviewed by every member. 305 The report."
    assert texts[5] == "" and 4 not in texts


def test_headers(spark):
    """A line that heads or foots another page of its file is a header, whatever number or sign ends it."""
    pages = [(1, 0, "Annual Report 12\nThe meeting"), (1, 1, "13 Annua1 Report\nEvery member"), (1, 2, "Western Inc.\nThe report"), (1, 3, "Western lnc.\nThe tower\npa9e 7 0f 9"), (2, 0, "Annual Report 12\nThe tower"), (2, 1, "Tower 5 report\nThe meeting\nparty 7"), (2, 2, "Tower 6 report\nEvery member")]
    df = page_table(spark, pages, CLEAN)
    got = sorted(tuple(r) for r in scan_traces(df, F.col("page_number").isNotNull()).where("kind <> 'misread'").collect())
    assert got == [(0, "header"), (1, "header"), (2, "header"), (3, "header"), (3, "page_number"), (5, "header"), (6, "header")]


def test_split(spark):
    text = "".join(f"line {i} of the text\n" for i in range(400))
    df = spark.createDataFrame([(1, text, "z"), (2, None, "z"), (3, "", "z"), (4, "short", "z"), (5, text, "z"), (6, "x" * 100_000, "z")], "k long, content string, raw string")
    rows = split_oversized(df, "k").collect()
    by = lambda k: [(r.first_line, r.last_line) for r in sorted(rows, key=lambda r: r.chunk_index) if r.k == k]
    assert {r.k for r in rows} == {1, 5, 6} and by(1) == by(5) and by(1)[0][0] == 1 and by(1)[-1][1] == 400
    assert all(len(r.content.encode()) <= 2400 for r in rows) and not any(r.whole_lines for r in rows if r.k == 6)
    assert split_oversized(df.limit(0), "k").count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 64))
    x = np.round(centre[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 64)), 3)
    x[:200] = x[0]  # a third are copies
    rows = [(f"v{i:04d}", x[i].tolist(), 1) for i in range(600)]
    rows += [("v0300", x[300].tolist(), 1), ("bad1", [0.0] * 64, 1), ("bad2", [1.0] * 63, 1), ("bad3", None, 1), ("bad4", [float("nan")] * 64, 1), ("bad5", [None] * 64, 1), (None, x[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, list int")
    got = {}
    for r in nearest_neighbours(df, "id", "vector").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == {f"v{i:04d}" for i in range(600)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    hits = sum(len({f"v{j:04d}" for j in np.argsort(-s[i], kind="stable")[:5]} & set(got[f"v{i:04d}"])) for i in range(600))
    assert hits / 3000 >= 0.95 and got["v0007"] == ["v0000", "v0001", "v0002", "v0003", "v0004"] and got["v0000"][0] == "v0001"
    assert nearest_neighbours(df.where("id like 'bad%'"), "id", "vector").count() == 0


def test_neighbours_of_equal_directions(spark):
    """Proportional vectors are equally similar: the smaller ids rank first."""
    rng = np.random.default_rng(3)
    x, others = rng.normal(size=64), rng.normal(size=(300, 64))
    rows = [(i * 7 % 41, (x * (1 + i)).tolist()) for i in range(41)] + [(100 + i, v.tolist()) for i, v in enumerate(others)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, round(r.cosine, 9)))
    assert all(got[i] == [(j, 1.0) for j in [n for n in range(7) if n != i][:5]] for i in range(41)) and len(got) == 341


def test_tokens(spark, tmp_path):
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabularies")
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", None, " \n\n  x", "<|endoftext|>", "naïve 日本語 👍🏽 ", "a" * 30_000, "don't 12345 ..!!", "Hello world"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").drop("ids")
    rows = {r.doc_id: r.ids for r in encode_corpus(df, "text", path, BYTE_BPE_PATTERN).collect()}
    assert rows == {i: want.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "text", path, BYTE_BPE_PATTERN).count() == 0


def test_leaks(spark):
    item = "seven quiet wizards mix old potions in the tall western tower every cold winter night together"
    docs = spark.createDataFrame([(1, f"Then {item.upper()}!", 0), (2, None, 0), (3, "", 0), (4, "nothing here", 0), (5, f"Then {item}!", 0), (6, "word " * 50_000 + item, 0)], "id long, text string, item int")
    items = spark.createDataFrame([(9, item), (8, None), (7, ""), (6, "short"), (5, item)], "id long, text string")
    got = leaked_items(docs.withColumnRenamed("id", "d"), items.withColumnRenamed("id", "i"), "d", "i")
    assert sorted((r.d, r.i) for r in got.where("exact").collect()) == [(d, i) for d in (1, 5, 6) for i in (5, 9)]
    assert leaked_items(docs, items.limit(0), "id", "id").count() == 0
    assert leaked_items(docs.limit(0), items, "id", "id").count() == 0


def test_texts_without_blanks(spark):
    """A long text of one word takes no longer than its length asks."""
    long = "xyz1" * 250_000
    df = spark.createDataFrame([(1, long, "f", 0, "é"), (2, long, "f", 1, "é"), (3, "-" * 500_000, "f", 2, "é")], "chunk_key long, content string, file_path string, chunk_index int, x string")
    assert similar_rows(df, "chunk_key").count() == 0
    assert sorted(tuple(r) for r in scan_traces(df, F.lit(True)).collect()) == [(1, "header"), (2, "header")]  # one line heads both
    assert garbled_texts(df.withColumn("content", F.concat("content", F.lit(" "), "x")), "chunk_key", "content").count() == 0
    assert split_oversized(df, "chunk_key").count() > 800


def test_garbled(spark):
    clean = ["Der Händler prüft die größere Lösung", "Señor Muñoz añadió la línea", "La théorie n’est pas prête", "Отчёт о школе передан в среду"]
    rows = [(i, clean[i % 4], "x") for i in range(200)] + [(900, "Der HÃ¤ndler prÃ¼ft", "x"), (901, None, "x"), (902, "", "x"), (903, "ascii only", "x"), (904, "théorie �", "x"), (905, "ÎÒ×¸Ò".encode("cp1252").decode("cp1252") + " " + "Отчёт о школе".encode("cp1251").decode("cp1252"), "x")]
    df = spark.createDataFrame(rows, "k long, text string, key string")
    got = {r.k: (r.restored, r.complete) for r in garbled_texts(df, "k").collect()}
    assert set(got) == {900, 904, 905} and got[900] == ("Der Händler prüft", True) and not got[904][1]
    assert garbled_texts(df.limit(0), "k").count() == 0


def test_scans_by_context(spark):
    clean = [f"she will ask if the {w} door opens and then it was said that it was {w}" for w in "red old new low big far hot dry wet sad".split() for _ in range(2)]
    clean += [f"they ask if {w} men stay and {v} {w} if the rest" for w in "tall short young rich poor quick slow loud".split() for v in "we you".split()]
    clean += [f"every {w} modern house" for w in "red old new low big far hot dry wet sad tall short young rich poor quick".split() for _ in range(5)]
    clean += [f"the cable modem {w}" for w in "works failed broke".split()]
    pages = [(1, 0, "we ask it the big man"), (1, 1, "she will ask lf the door and it was lf the"), (1, 2, "it was sad"), (2, 0, "the cable modem fell"), (2, 1, "a modem house"), (2, 2, "far rnodern house")]
    df = page_table(spark, pages, clean)
    page = F.col("page_number").isNotNull()
    assert {r.chunk_key for r in scan_traces(df, page).collect() if r.kind == "misread"} == {0, 1, 4, 5}
    texts = {r.chunk_key: r.text for r in repaired_pages(df, page).collect()}
    assert texts[0] == "we ask if the big man" and texts[2] == pages[2][2] and texts[3] == pages[3][2] and texts[4] == "a modern house"
    assert texts[1].startswith("she will ask if the door and it was ")


def test_leaks_tables_are_told_apart(spark, monkeypatch):
    marks = []
    monkeypatch.setattr(leaks, "id", lambda _: 1, raising=False)  # as when a freed object's address is given out again
    monkeypatch.setattr(leaks, "_finder", lambda shared, mark: marks.append(mark) or (lambda batches: iter(())))
    df = spark.createDataFrame([(1, "x")], "k long, text string")
    for _ in range(2):
        leaked_items(df, df, "k", "k")
    assert marks[0] != marks[1]
