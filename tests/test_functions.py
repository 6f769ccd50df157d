import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylake.functions import access, filetypes, paths, text, vectors
from quarrylake.functions.hashes import path_shard


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


@pytest.mark.parametrize(("path", "n", "shard"), [("docs/readme.md", 2, 1), ("queued/architecture.md", 2, 0), ("ops/runbooks/deploy/rollback.txt", 4, 2)])
def test_path_shard(spark, path, n, shard):
    assert one(spark, path_shard(F.lit(path), n)) == shard


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("docs/**", ["docs/a", "docs/a/b.md", "docs"], ["doc/a", "xdocs/a"]), ("**/*.md", ["a.md", "x/y/a.md"], ["a.txt"]), ("a/*/c", ["a/b/c"], ["a/b/b/c", "a/c"]),
    ("a/**/c", ["a/c", "a/b/b/c"], ["a/b"]), ("[!a]x?", ["bx1"], ["ax1", "bx"]), ("README.md", ["README.md"], ["READMEXmd"]),
])
def test_globs(glob, yes, no):
    r = re.compile(paths.glob_regex(glob))
    assert all(r.search(p) for p in yes) and not any(r.search(p) for p in no)


def test_clean_paths(spark):
    assert paths.clean_path(" a\\b/./c ") == "a/b/c"
    for bad in ["", "/a", "../a", "a/../..", "a\0b", "."]:
        with pytest.raises(ValueError):
            paths.clean_path(bad)
    assert [paths.clean_prefix(p) for p in ["", "private", "/a/../b", "/"]] == ["/", "/private/", "/b/", "/"]
    with pytest.raises(ValueError):
        paths.clean_prefix("/../x")
    assert one(spark, paths.cleaned(F.lit("./a//b/"))) == "a/b"
    assert one(spark, paths.cleaned(F.lit("../a"))) is None


@pytest.mark.parametrize(("line", "folder", "yes", "no"), [
    ("*.log", "", ["a.log", "x/a.log", "a.log/b"], ["a.logx"]), ("/build", "", ["build", "build/x"], ["x/build"]), ("tmp/", "", ["tmp/a", "x/tmp/a"], ["tmp"]), ("*.md", "docs", ["docs/x/a.md"], ["a.md"]), ("a/b", "", ["a/b/c"], ["x/a/b"]),
])
def test_ignore_lines(line, folder, yes, no):
    r = re.compile(paths.ignore_regex(line, folder))
    assert all(r.search(p) for p in yes) and not any(r.search(p) for p in no)


def test_ignore_never_takes_back(spark):
    assert paths.ignore_regex("!keep.log") is None and paths.ignore_regex("# x") is None
    assert one(spark, paths.ignored(F.lit("keep.log"), ["*.log", "!keep.log"])) is True
    assert one(spark, paths.secret(F.lit("x/.env.local"))) and not one(spark, paths.secret(F.lit("x/env")))


def test_types(spark):
    got = {p: (one(spark, filetypes.file_type(F.lit(p))), one(spark, filetypes.file_type(F.lit(p), "remote"))) for p in ["a.PDF", "x.svg", "Dockerfile", "a.tsx", "n.txt", "z", "m.eml"]}
    assert got == {"a.PDF": ("pdf", "pdf"), "x.svg": ("svg", "image"), "Dockerfile": ("dockerfile", "shell"), "a.tsx": ("markdown", "typescript"), "n.txt": ("markdown", "text"), "z": ("markdown", "text"), "m.eml": ("eml", "eml")}
    assert [one(spark, filetypes.local_chunkable(F.lit(p))) for p in ["a.md", "a.go", "a.svg", "a.pdf", "a.eml", "a.wav"]] == [True, True, True, False, False, False]


def test_text(spark):
    assert one(spark, text.slug(F.lit("  My  Root_v1.2! "))) == "my-root-v1-2"
    assert one(spark, text.clock(F.lit(75.0))) == "01:15" and one(spark, text.clock(F.lit(3670.0))) == "01:01:10"
    assert one(spark, text.byte_size(F.lit(1536))) == "1.5 KB" and one(spark, text.byte_size(F.lit(12))) == "12 B"
    assert text.flat_pairs("c", '{"b": [1, {"a": null}], "a": "x"}') == [("c.a", "x"), ("c.b[0]", "1"), ("c.b[1].a", "null")]
    assert text.flat_pairs("c", "no") is None and text.flat_pairs("c", "{}") == [("c", "{}")]
    assert text.plain_html("<p> a </p><b>c</b>") == "a\nc"


def test_vectors_and_access(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1.0
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, access.has_scope(F.array().cast("array<string>"), "read")) and one(spark, access.has_scope(F.array(F.lit("*")), "read"))
    assert not one(spark, access.has_scope(F.array(F.lit("write")), "read"))
    assert one(spark, access.may_manage(F.lit("admin"), F.lit("editor"))) and not one(spark, access.may_manage(F.lit("admin"), F.lit("owner")))


@given(st.text(alphabet="ab/.*?", max_size=12))
def test_any_glob_compiles(glob):
    re.compile(paths.glob_regex(glob or "a"))
