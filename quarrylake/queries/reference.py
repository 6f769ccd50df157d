"""One query per operator of the engine on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions import access as A
from quarrylake.functions import filetypes, paths, text, vectors
from quarrylake.functions.hashes import bare_hash, chunk_id, file_hash, path_shard, shard_namespace
from quarrylake.operators import access, chunking, diff, events, jobs, merkle, namespaces, packing, queues, ranking, reads, visibility
from quarrylake.plans.search import candidates, search
from quarrylake.plans.store import CLOSES, ROWS, STATE, Conflict, Store
from quarrylake.session import shared_folder, table
from quarrylake.streaming import follow

SEQ, BASE = 1500, 1300
QUERY = "scanned invoice harbour"
GLOB = "legal/**"
INCLUDE, EXCLUDE = ["legal/**", "*/specs/**", "hr/handbook/*.pdf"], ["**/*.docx"]
VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
DENIED = ["/hr/", "/legal/contracts/", "/src/tools/"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# ---- states and their differences -------------------------------------------------------------


def _states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each root's first and last snapshot."""
    s = table(spark, folder, "root_states")
    ends = s.groupBy("root_id").agg(F.min("generation_seq").alias("a"), F.max("generation_seq").alias("b"))
    x = F.max(F.struct("mtime", "received_at", "size", bare_hash(F.col("content_hash")).alias("h"))).alias("x")

    def of(which: str) -> DataFrame:
        at = s.join(ends.select("root_id", F.col(which).alias("generation_seq")), ["root_id", "generation_seq"])
        return at.groupBy("root_id", F.regexp_replace("path", r"^(\./)+", "").alias("path")).agg(x).select("root_id", "path", "x.size", F.col("x.h").alias("content_hash"), "x.mtime")

    return of("a"), of("b")


_STATES = r"""WITH ends AS (SELECT root_id, min(generation_seq) AS a, max(generation_seq) AS b FROM root_states GROUP BY 1),
n AS (SELECT root_id, generation_seq, regexp_replace(path, '^(\./)+', '') AS path, size, mtime, received_at, nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') AS h FROM root_states),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id, generation_seq, path ORDER BY mtime DESC, received_at DESC NULLS LAST, size DESC NULLS LAST, h DESC NULLS LAST) AS rn FROM n) WHERE rn = 1),
o AS (SELECT root_id, path, size, h AS content_hash FROM d JOIN ends USING (root_id) WHERE generation_seq = a),
c AS (SELECT root_id, path, size, h AS content_hash FROM d JOIN ends USING (root_id) WHERE generation_seq = b),
j AS (SELECT coalesce(o.root_id, c.root_id) AS root_id, coalesce(o.path, c.path) AS path, CASE WHEN c.path IS NULL THEN o.content_hash ELSE c.content_hash END AS content_hash, CASE WHEN c.path IS NULL THEN o.size ELSE c.size END AS size,
  CASE WHEN o.path IS NULL THEN 'ADDED' WHEN c.path IS NULL THEN 'REMOVED' WHEN o.content_hash IS NOT DISTINCT FROM c.content_hash THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status
  FROM o FULL JOIN c ON o.root_id = c.root_id AND o.path = c.path),
g AS (SELECT root_id, content_hash, path, size, row_number() OVER (PARTITION BY root_id, content_hash ORDER BY sha256(path), path) AS rn FROM j WHERE status = 'REMOVED' AND content_hash IS NOT NULL),
a AS (SELECT root_id, content_hash, path, size, row_number() OVER (PARTITION BY root_id, content_hash ORDER BY sha256(path), path) AS rn FROM j WHERE status = 'ADDED' AND content_hash IS NOT NULL),
m AS (SELECT a.root_id, a.path, g.path AS old_path, a.content_hash, a.size,
  CASE WHEN regexp_replace(a.path, '/?[^/]*$', '') = regexp_replace(g.path, '/?[^/]*$', '') AND regexp_extract(a.path, '[^/]*$') <> regexp_extract(g.path, '[^/]*$') THEN 'RENAMED' ELSE 'MOVED' END AS status
  FROM a JOIN g USING (root_id, content_hash, rn)),
w AS (SELECT root_id, path, status, content_hash, size, NULL AS old_path FROM j
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.root_id = j.root_id AND ((j.status = 'ADDED' AND m.path = j.path) OR (j.status = 'REMOVED' AND m.old_path = j.path)))
  UNION ALL SELECT root_id, path, status, content_hash, size, old_path FROM m)
"""


def _selected_sql(path: str) -> str:
    inc, exc = "|".join(map(paths.glob_regex, INCLUDE)), "|".join(map(paths.glob_regex, EXCLUDE))
    return f"(regexp_matches({path}, '{inc}') AND NOT regexp_matches({path}, '{exc}'))"


@query(_STATES + "SELECT root_id, path, status, content_hash, size FROM j")
def snapshot_diff(spark, folder):
    return diff.diff_states(*_states(spark, folder))


@query(_STATES + "SELECT root_id, path, CASE WHEN status = 'UNCHANGED' THEN 'MODIFIED' ELSE status END AS status, content_hash, size FROM j")
def forced_diff(spark, folder):
    return diff.forced_diff(*_states(spark, folder))


@query(_STATES + "SELECT * FROM w WHERE status <> 'UNCHANGED'")
def move_detection(spark, folder):
    return diff.changed(diff.with_moves(diff.diff_states(*_states(spark, folder))))


@query(_STATES + """SELECT root_id, count(*) FILTER (status = 'ADDED') AS added, count(*) FILTER (status = 'MODIFIED') AS modified, count(*) FILTER (status = 'REMOVED') AS removed,
count(*) FILTER (status = 'MOVED') AS moved, count(*) FILTER (status = 'RENAMED') AS renamed, count(*) FILTER (status = 'UNCHANGED') AS unchanged,
count(*) FILTER (status IN ('ADDED', 'MODIFIED')) AS uploads, coalesce(sum(size) FILTER (status IN ('ADDED', 'MODIFIED')), 0)::bigint AS upload_bytes FROM w GROUP BY 1""")
def diff_stats(spark, folder):
    return diff.diff_stats(diff.with_moves(diff.diff_states(*_states(spark, folder))))


@query(_STATES + f"SELECT root_id, path, status, content_hash, size FROM j WHERE {_selected_sql('path')}")
def subset_diff(spark, folder):
    return diff.subset_diff(*_states(spark, folder), INCLUDE, EXCLUDE)


@query(_STATES + f"SELECT root_id, path, size, content_hash FROM o WHERE NOT {_selected_sql('path')} UNION ALL SELECT root_id, path, size, content_hash FROM c WHERE {_selected_sql('path')}")
def subset_merge(spark, folder):
    return diff.merged_state(*_states(spark, folder), INCLUDE, EXCLUDE)


@query(_STATES + "SELECT c.root_id, c.path, CASE WHEN o.path IS NULL THEN 'missing' WHEN o.content_hash IS NOT DISTINCT FROM c.content_hash THEN 'matched' ELSE 'stale' END AS status FROM c LEFT JOIN o ON o.root_id = c.root_id AND o.path = c.path")
def selection_compare(spark, folder):
    old, new = _states(spark, folder)
    return diff.selection_status(new, old)


@query(_STATES + "SELECT root_id, path, size, content_hash FROM c")
def apply_changes(spark, folder):
    old, new = _states(spark, folder)
    return diff.apply_changes(old, diff.changed(diff.with_moves(diff.diff_states(old, new))))


@query(_STATES + ", e AS (SELECT d.root_id, d.path, d.size, d.mtime, d.h FROM d JOIN ends USING (root_id) WHERE generation_seq = a), f AS (SELECT d.root_id, d.path, d.size, d.mtime FROM d JOIN ends USING (root_id) WHERE generation_seq = b) SELECT f.root_id, f.path, f.size, f.mtime, CASE WHEN e.size = f.size AND e.mtime = f.mtime THEN e.h END AS content_hash FROM f LEFT JOIN e ON e.root_id = f.root_id AND e.path = f.path")
def hash_reuse(spark, folder):
    old, new = _states(spark, folder)
    return diff.reused_hashes(new.drop("content_hash"), old)


@query("SELECT root_id, path, count(*) AS times FROM (SELECT root_id || '@' || generation_seq AS root_id, path FROM root_states) GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_paths(spark, folder):
    """In every snapshot of every root."""
    s = table(spark, folder, "root_states")
    return diff.repeated_paths(s.select(F.concat_ws("@", "root_id", "generation_seq").alias("root_id"), "path"))


# ---- Merkle trees -----------------------------------------------------------------------------

_TREE = """, f{n} AS (SELECT root_id, path, 'sha256:' || coalesce(content_hash, '') AS hash, len(string_split(path, '/')) AS depth FROM {n}),
l4{n} AS (SELECT root_id, regexp_replace(path, '/?[^/]*$', '') AS path, 'sha256:' || sha256(string_agg(regexp_extract(path, '[^/]*$') || ':' || hash || chr(10), '' ORDER BY regexp_extract(path, '[^/]*$'))) AS hash FROM f{n} WHERE depth = 4 GROUP BY 1, 2),
l3{n} AS (SELECT root_id, regexp_replace(path, '/?[^/]*$', '') AS path, 'sha256:' || sha256(string_agg(regexp_extract(path, '[^/]*$') || ':' || hash || chr(10), '' ORDER BY regexp_extract(path, '[^/]*$'))) AS hash FROM (SELECT root_id, path, hash FROM f{n} WHERE depth = 3 UNION ALL FROM l4{n}) GROUP BY 1, 2),
l2{n} AS (SELECT root_id, regexp_replace(path, '/?[^/]*$', '') AS path, 'sha256:' || sha256(string_agg(regexp_extract(path, '[^/]*$') || ':' || hash || chr(10), '' ORDER BY regexp_extract(path, '[^/]*$'))) AS hash FROM (SELECT root_id, path, hash FROM f{n} WHERE depth = 2 UNION ALL FROM l3{n}) GROUP BY 1, 2),
l1{n} AS (SELECT root_id, '' AS path, 'sha256:' || sha256(string_agg(path || ':' || hash || chr(10), '' ORDER BY path)) AS hash FROM (SELECT root_id, path, hash FROM f{n} WHERE depth = 1 UNION ALL FROM l2{n}) GROUP BY 1),
t{n} AS (SELECT root_id, 'file' AS kind, path, hash FROM f{n} UNION ALL SELECT root_id, 'dir', path, hash FROM l4{n} UNION ALL SELECT root_id, 'dir', path, hash FROM l3{n} UNION ALL SELECT root_id, 'dir', path, hash FROM l2{n} UNION ALL SELECT root_id, 'root', path, hash FROM l1{n})
"""


@query(_STATES + _TREE.format(n="c") + "SELECT root_id, path, hash FROM tc WHERE kind <> 'file'")
def merkle_dirs(spark, folder):
    return merkle.tree(_states(spark, folder)[1]).where("is_dir").select("root_id", "path", "hash")


@query(_STATES + _TREE.format(n="c") + "SELECT * FROM tc")
def content_proof(spark, folder):
    return merkle.content_proof(merkle.tree(_states(spark, folder)[1]))


@query(_STATES + "SELECT root_id, path, status FROM j WHERE status <> 'UNCHANGED'")
def merkle_pruned_diff(spark, folder):
    old, new = _states(spark, folder)
    return merkle.changed_files(merkle.tree(old), merkle.tree(new))


@query(_STATES + """, v AS (SELECT root_id, i, sum(CASE WHEN ((strpos('0123456789abcdef', substr(content_hash, i // 4 + 1, 1)) - 1) >> (3 - i % 4)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit
  FROM c, range(256) AS t(i) WHERE length(content_hash) = 64 GROUP BY 1, 2),
x AS (SELECT root_id, i // 4 AS place, sum(CASE WHEN bit THEN 1 << (3 - i % 4) ELSE 0 END)::int AS d FROM v GROUP BY 1, 2)
SELECT root_id, string_agg(substr('0123456789abcdef', d + 1, 1), '' ORDER BY place) AS simhash FROM x GROUP BY 1""")
def simhash_root(spark, folder):
    return merkle.simhash(_states(spark, folder)[1])


@query(_STATES + """, h AS (SELECT 'o' AS w, root_id, content_hash FROM o UNION ALL SELECT 'c', root_id, content_hash FROM c),
v AS (SELECT w, root_id, i, sum(CASE WHEN ((strpos('0123456789abcdef', substr(content_hash, i // 4 + 1, 1)) - 1) >> (3 - i % 4)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS bit
  FROM h, range(256) AS t(i) WHERE length(content_hash) = 64 GROUP BY 1, 2, 3)
SELECT a.root_id, round(1 - count(*) FILTER (a.bit <> b.bit) / 256.0, 6) AS similarity FROM v a JOIN v b ON a.root_id = b.root_id AND a.i = b.i AND a.w = 'o' AND b.w = 'c' GROUP BY 1""")
def simhash_similarity(spark, folder):
    old, new = (merkle.simhash(s) for s in _states(spark, folder))
    return old.withColumnRenamed("simhash", "before").join(new.withColumnRenamed("simhash", "after"), "root_id").select("root_id", _r(merkle.simhash_similarity(F.col("before"), F.col("after"))).alias("similarity"))


# ---- validity ---------------------------------------------------------------------------------


def _rows(spark, folder) -> DataFrame:
    return table(spark, folder, "indexed_chunks").where("op = 'upsert'")


_VIS = "valid_from_generation_seq <= {s} AND (valid_to_generation_seq = 0 OR valid_to_generation_seq > {s})"


@query(f"SELECT row_no FROM indexed_chunks WHERE op = 'upsert' AND {_VIS.format(s=SEQ)}")
def visibility_window(spark, folder):
    return _rows(spark, folder).where(visibility.visible(SEQ)).select("row_no")


@query(f"SELECT root_id, count(*) AS n FROM indexed_chunks WHERE op = 'upsert' AND {_VIS.format(s=BASE)} GROUP BY 1")
def time_travel(spark, folder):
    return _rows(spark, folder).where(visibility.visible(BASE)).groupBy("root_id").agg(F.count("*").alias("n"))


@query("""SELECT r.row_no, coalesce(min(c.valid_to_generation_seq), 0) AS valid_to_generation_seq FROM indexed_chunks r
LEFT JOIN indexed_chunks c ON c.op = 'close' AND c.root_id = r.root_id AND c.file_path = r.file_path AND c.valid_to_generation_seq > r.valid_from_generation_seq AND r.valid_from_generation_seq <= c.valid_to_generation_seq - 1
WHERE r.op = 'upsert' GROUP BY 1""")
def closes_log(spark, folder):
    t = table(spark, folder, "indexed_chunks")
    closes = t.where("op = 'close' and valid_to_generation_seq > 0").select("root_id", "file_path", (F.col("valid_to_generation_seq") - 1).alias("base_seq"), F.col("valid_to_generation_seq").alias("gen_seq"))
    return visibility.with_closes(_rows(spark, folder), closes).select("row_no", "valid_to_generation_seq")


@query(f"SELECT row_no, CASE WHEN valid_to_generation_seq = {SEQ + 1} THEN 0 ELSE valid_to_generation_seq END AS valid_to_generation_seq FROM indexed_chunks WHERE op = 'upsert' AND valid_from_generation_seq <> {SEQ + 1}")
def rollback_generation(spark, folder):
    return visibility.rolled_back(_rows(spark, folder), SEQ + 1).select("row_no", "valid_to_generation_seq")


@query(f"SELECT row_no FROM indexed_chunks WHERE op = 'upsert' AND (valid_to_generation_seq = 0 OR valid_to_generation_seq > {SEQ})")
def vacuum(spark, folder):
    return visibility.vacuumed(_rows(spark, folder), SEQ).select("row_no")


@query(f"""SELECT row_no, substr(sha256(root_id || ':g9:archive/' || file_path), 1, 16) || ':' || coalesce(chunk_index, 0) AS id, 'archive/' || file_path AS file_path
FROM indexed_chunks WHERE op = 'upsert' AND {_VIS.format(s=SEQ)} AND file_path LIKE 'legal/%'""")
def carried_over(spark, folder):
    rows = _rows(spark, folder)
    moves = rows.where(F.col("file_path").startswith("legal/")).select("root_id", F.col("file_path").alias("old_path"), F.concat(F.lit("archive/"), "file_path").alias("path")).distinct()
    return visibility.carried_over(rows, moves, SEQ, "g9", 1999).select("row_no", "id", "file_path")


@query("""SELECT r.doc_id, coalesce(p.lang, r.lang) AS lang FROM documents r LEFT JOIN (SELECT doc_id, arg_max(lang, o) AS lang FROM (
SELECT doc_id, 'xx' AS lang, 1 AS o FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'yy', 2 FROM documents WHERE doc_id % 6 = 0) GROUP BY 1) p USING (doc_id)""")
def patch_by_key(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "lang")
    patches = d.where("doc_id % 3 = 0").select("doc_id", F.lit("xx").alias("lang"), F.lit(1).alias("o")).unionByName(d.where("doc_id % 6 = 0").select("doc_id", F.lit("yy").alias("lang"), F.lit(2).alias("o")))
    return visibility.patched(d, patches, "doc_id", "o")


@query("SELECT row_no, CASE WHEN file_path LIKE 'hr/%' THEN 1234 ELSE valid_to_generation_seq END AS valid_to_generation_seq FROM indexed_chunks")
def patch_by_predicate(spark, folder):
    return visibility.patched_where(table(spark, folder, "indexed_chunks"), F.col("file_path").startswith("hr/"), valid_to_generation_seq=1234).select("row_no", "valid_to_generation_seq")


# ---- ranking ----------------------------------------------------------------------------------

_TERMS = ranking.terms_of(QUERY)


def _bm25_sql(source: str, key: str, by: str | None = None) -> str:
    """CTEs ending in `scored` (key, by, score)."""
    n = len(_TERMS)
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(n))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(n))
    b = f", {by}" if by else ""
    return f"""WITH src AS ({source}), tk AS (SELECT {key}{b}, coalesce(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> ''), []) AS ts FROM src),
cn AS (SELECT {key}{b}, len(ts) AS dl, {tf} FROM tk), st AS (SELECT {by + ', ' if by else ''}count(*) AS n, avg(dl) AS av, {df} FROM cn {'GROUP BY 1' if by else ''}),
scored AS (SELECT {key}{b}, {part} AS score FROM cn {f'JOIN st USING ({by})' if by else ', st'} WHERE {' + '.join(f'tf{i}' for i in range(n))} > 0)
"""


_DOCS = "SELECT doc_id, source, file_path, root_id, text AS body FROM documents"


@query(_bm25_sql(_DOCS, "doc_id") + "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10")
def fts_bm25_topk(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return ranking.top(ranking.bm25(d, "text", QUERY).select("doc_id", "score"), 10, ["doc_id"]).select("doc_id", _r(F.col("score")).alias("score"))


@query(_bm25_sql(_DOCS + f" WHERE regexp_matches(file_path, '{paths.glob_regex(GLOB)}')", "doc_id") + "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10")
def fts_glob_filtered(spark, folder):
    d = table(spark, folder, "documents").where(paths.glob_filter(F.col("file_path"), GLOB)).select("doc_id", "text")
    return ranking.top(ranking.bm25(d, "text", QUERY).select("doc_id", "score"), 10, ["doc_id"]).select("doc_id", _r(F.col("score")).alias("score"))


@query(_bm25_sql(_DOCS, "doc_id", "source") + ", k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM scored) SELECT doc_id, source, round(score, 6) AS score FROM k WHERE r <= 5 ORDER BY k.score DESC, doc_id LIMIT 5")
def multi_root_merge(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", "text")
    best = ranking.merged_roots(ranking.bm25(d, "text", QUERY, by="source").select("doc_id", "source", "score"), "source", 5, ["doc_id"])
    return best.select("doc_id", "source", _r(F.col("score")).alias("score"))


@query(_bm25_sql(_DOCS, "doc_id") + ", k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY score DESC, doc_id) AS r FROM scored) SELECT doc_id, round(1 / (60.0 + r), 6) AS score FROM k WHERE r <= 100 ORDER BY r, doc_id LIMIT 10")
def shard_rrf_merge(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    s = ranking.bm25(d, "text", QUERY).select("doc_id", "score")
    return ranking.merged_shards(s, "doc_id", F.col("doc_id") % 4, 4, 10, ranking.overfetch(10)).select("doc_id", _r(F.col("score")).alias("score"))


_PROBE = [((i * 53) % 23 - 11) / 7 for i in range(2048)]


@query(f"WITH q AS (SELECT vec_id, embedding::double[] AS e, {_PROBE}::double[] AS p FROM embeddings), s AS (SELECT vec_id, list_cosine_similarity(e, p[1:len(e)]) AS score FROM q) SELECT vec_id, round(score, 6) AS score, round(1 - score, 6) AS distance FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_exact_topk(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    dim = len(e.select("embedding").first()[0])
    best = ranking.top(ranking.by_vector(e, "embedding", _PROBE[:dim]).drop("embedding"), 10, ["vec_id"])
    return best.select("vec_id", _r(F.col("score")).alias("score"), _r(F.col("distance")).alias("distance"))


_USABLE = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_HYBRID = _bm25_sql(f"SELECT row_no, content AS body, vector FROM indexed_chunks WHERE op = 'upsert' AND {_VIS.format(s=SEQ)}", "row_no") + f""",
u AS (SELECT row_no, CASE WHEN {_USABLE} THEN vector END AS vector FROM src),
v AS (SELECT row_no, list_cosine_similarity(list_transform(vector, lambda x: coalesce(x, 0.0)), {VECTOR}::double[]) AS score FROM u WHERE vector IS NOT NULL),
ra AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, row_no) AS r FROM scored), rb AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, row_no) AS r FROM v),
f AS (SELECT row_no, sum(1 / (60.0 + r)) AS score FROM (SELECT * FROM ra WHERE r <= 100 UNION ALL SELECT * FROM rb WHERE r <= 100) GROUP BY 1)
"""


def _usable_vector(c: str = "vector") -> Column:
    v = F.col(c)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) == 64)
    return F.when(fine, v)


@query(_HYBRID + "SELECT row_no, round(score, 6) AS score FROM f ORDER BY f.score DESC, row_no LIMIT 10")
def hybrid_rrf(spark, folder):
    rows = _rows(spark, folder).where(visibility.visible(SEQ)).select("row_no", "content", _usable_vector().alias("vector"))
    return ranking.hybrid(rows, "row_no", "content", "vector", QUERY, VECTOR, 10).select("row_no", _r(F.col("score")).alias("score"))


def _denies(spark, folder) -> DataFrame:
    return table(spark, folder, "roots").select("root_id", F.explode(F.array(*map(F.lit, DENIED))).alias("path_prefix"))


_DENIED_SQL = " OR ".join(f"starts_with('/' || file_path, '{d}')" for d in DENIED)


@query(_bm25_sql(_DOCS, "doc_id") + f"SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 100) s JOIN documents USING (doc_id) WHERE NOT ({_DENIED_SQL}) OR root_id IS NULL ORDER BY s.score DESC, doc_id LIMIT 10")
def overfetch_postfilter(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "root_id", "file_path", "text")
    found = ranking.top(ranking.bm25(d, "text", QUERY).drop("text"), ranking.overfetch(10), ["doc_id"])
    return ranking.top(access.without_denied(found, _denies(spark, folder)), 10, ["doc_id"]).select("doc_id", _r(F.col("score")).alias("score"))


@query(_bm25_sql(f"SELECT row_no, content AS body FROM indexed_chunks WHERE op = 'upsert' AND {_VIS.format(s=SEQ)} AND root_id IN (SELECT root_id FROM roots WHERE scope = 'org') AND NOT ({_DENIED_SQL})", "row_no") + "SELECT row_no AS id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, row_no LIMIT 10")
def search_with_access(spark, folder):
    rows = _rows(spark, folder).withColumn("id", F.col("row_no"))
    readable = table(spark, folder, "roots").where("scope = 'org'").select("root_id")
    ok = candidates(rows, SEQ, readable, denies=_denies(spark, folder))
    return search(ok, QUERY, "fts", 10).select("id", _r(F.col("score")).alias("score"))


# ---- access -----------------------------------------------------------------------------------


@query(f"SELECT row_no FROM indexed_chunks WHERE NOT ({_DENIED_SQL})")
def acl_deny_prefix(spark, folder):
    rows = table(spark, folder, "indexed_chunks").select("row_no", "root_id", "file_path")
    return access.without_denied(rows, _denies(spark, folder)).select("row_no")


@query("SELECT row_no FROM indexed_chunks r WHERE EXISTS (SELECT 1 FROM indexed_chunks p WHERE p.row_no % 2 = 0 AND p.root_id = r.root_id AND p.file_path = r.file_path AND p.file_hash = r.file_hash)")
def proof_filter(spark, folder):
    t = table(spark, folder, "indexed_chunks").select("row_no", "root_id", "file_path", "file_hash")
    proof = t.where("row_no % 2 = 0 and file_hash is not null").select("root_id", F.col("file_path").alias("path"), F.col("file_hash").alias("hash"))
    return access.proven(t, proof).select("row_no")


def _people(spark, folder):
    roots = table(spark, folder, "roots").select("root_id", "org_id", "scope", "vector_enabled", F.length("root_name").cast("string").alias("owner_user_id"))
    orgs = roots.select("org_id").distinct().withColumn("i", F.row_number().over(Window.orderBy("org_id")) - 1)
    n = orgs.count()
    c = table(spark, folder, "customer").select("c_custkey")
    role = F.element_at(F.array(*map(F.lit, ["owner", "admin", "editor", "viewer"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    members = c.withColumn("i", F.col("c_custkey") % n).join(orgs, "i").select("org_id", F.col("c_custkey").cast("string").alias("user_id"), role.alias("role"))
    groups = members.where("user_id % 10 = 0").select("org_id", F.lit("g1").alias("group_id"), "user_id")
    g = lambda kind, who, *p: roots.select("org_id", "root_id", F.lit(kind).alias("principal_type"), who.alias("principal_id"), F.array(*map(F.lit, p)).alias("permissions"))
    grants = g("user", (F.col("owner_user_id").cast("int") + 1).cast("string"), "sync").unionByName(g("group", F.lit("g1"), "delete")).unionByName(roots.where("vector_enabled").select("org_id", "root_id", F.lit("org").alias("principal_type"), F.col("org_id").alias("principal_id"), F.array(F.lit("read")).alias("permissions")))
    return roots, members, grants, groups


_PERM = """WITH o AS (SELECT org_id, row_number() OVER (ORDER BY org_id) - 1 AS i FROM (SELECT DISTINCT org_id FROM roots)),
m AS (SELECT org_id, c_custkey::varchar AS user_id, (['owner', 'admin', 'editor', 'viewer'])[c_custkey % 4 + 1] AS role, c_custkey FROM customer JOIN o ON o.i = c_custkey % (SELECT count(*) FROM o)),
r AS (SELECT root_id, org_id, scope, vector_enabled, length(root_name) AS own FROM roots),
b AS (SELECT r.root_id, m.user_id, unnest(
  CASE WHEN scope IS NULL OR scope IN ('', 'org') THEN list_concat(['read'], CASE WHEN role <> 'viewer' THEN ['sync'] ELSE [] END, CASE WHEN role IN ('owner', 'admin') THEN ['admin'] ELSE [] END)
       WHEN scope = 'user' AND (own = c_custkey OR role IN ('owner', 'admin')) THEN ['admin'] WHEN scope = 'restricted' AND role IN ('owner', 'admin') THEN ['admin'] ELSE ['none'] END) AS p
  FROM r JOIN m USING (org_id)
  UNION ALL SELECT root_id, user_id, 'sync' FROM r JOIN m USING (org_id) WHERE c_custkey = own + 1
  UNION ALL SELECT root_id, user_id, 'delete' FROM r JOIN m USING (org_id) WHERE c_custkey % 10 = 0
  UNION ALL SELECT root_id, user_id, 'read' FROM r JOIN m USING (org_id) WHERE vector_enabled),
k AS (SELECT root_id, user_id, bool_or(p = 'admin') AS a, bool_or(p IN ('admin', 'delete')) AS d, bool_or(p IN ('admin', 'sync')) AS s, bool_or(p IN ('admin', 'sync', 'delete', 'read')) AS rd FROM b GROUP BY 1, 2)
"""


@query(_PERM + "SELECT root_id, user_id, concat_ws(',', CASE WHEN rd THEN 'read' END, CASE WHEN s THEN 'sync' END, CASE WHEN d THEN 'delete' END, CASE WHEN a THEN 'admin' END) AS permissions FROM k")
def root_permissions(spark, folder):
    return access.root_permissions(*_people(spark, folder)).withColumn("permissions", F.array_join("permissions", ","))


@query(_PERM + "SELECT root_id FROM k WHERE user_id = '8' AND rd")
def accessible_roots(spark, folder):
    return access.accessible_roots(access.root_permissions(*_people(spark, folder)), "8")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS level, c_custkey % 5 <= 1 AS admin FROM customer")
def role_levels(spark, folder):
    role = F.element_at(F.array(*map(F.lit, ["owner", "admin", "editor", "viewer", "guest"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", A.role_level(role).alias("level"), A.has_role(role, "admin").alias("admin"))


# ---- paths, types, text -----------------------------------------------------------------------


@query(f"SELECT doc_id FROM documents WHERE {_selected_sql('file_path')}")
def glob_include_exclude(spark, folder):
    return table(spark, folder, "documents").where(paths.selected(F.col("file_path"), INCLUDE, EXCLUDE)).select("doc_id")


_LINES = ["*.csv", "/hr/", "notes/*.md", "# comment", "!keep.csv"]


@query("SELECT doc_id FROM documents WHERE NOT (regexp_matches(file_path, '(^|/)(\\.git|node_modules|dist|build|venv)(/|$)') OR regexp_matches(file_path, '\\.(csv|pyc|pyo|o|so|dylib|class)(/|$)') OR starts_with(file_path, 'hr/') OR regexp_matches(file_path, '^notes/[^/]*\\.md(/|$)'))")
def ignore_filter(spark, folder):
    return table(spark, folder, "documents").where(~paths.ignored(F.col("file_path"), _LINES)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(regexp_extract(file_path || CASE WHEN doc_id % 7 = 0 THEN '.pem' ELSE '' END, '[^/]*$'), '^(\\.env(\\..*)?|.*\\.(pem|key|p12|pfx)|.*_rsa|id_(rsa|ed25519|ecdsa)|credentials\\.json|service-account.*\\.json|\\.npmrc|\\.pypirc)$')")
def secret_filter(spark, folder):
    p = F.concat("file_path", F.when(F.col("doc_id") % 7 == 0, ".pem").otherwise(""))
    return table(spark, folder, "documents").where(paths.secret(p)).select("doc_id")


def _types_sql(table_: dict[str, str], default: str) -> str:
    return f"coalesce(map {json.dumps(table_).replace(chr(34), chr(39))}[lower(regexp_extract(file_path, '\\.[^.]*$'))], '{default}')"


@query(f"SELECT doc_id, {_types_sql(filetypes.DOCUMENTS | dict.fromkeys(filetypes.IMAGES, 'image') | {'.svg': 'svg'} | filetypes.CODE, 'markdown')} AS file_type, {_types_sql(filetypes.DOCUMENTS | dict.fromkeys([*filetypes.IMAGES, '.svg'], 'image'), 'auto')} = 'auto' OR file_path ILIKE '%.svg' AS local FROM documents")
def file_types(spark, folder):
    p = F.col("file_path")
    return table(spark, folder, "documents").select("doc_id", filetypes.file_type(p).alias("file_type"), filetypes.local_chunkable(p).alias("local"))


@query("SELECT chunk_key, substr(sha256(root_id || ':' || file_path), 1, 16) || ':' || chunk_index AS id, sha256(content) AS content_hash FROM chunks")
def chunk_ids(spark, folder):
    return table(spark, folder, "chunks").select("chunk_key", chunk_id(F.col("root_id"), F.col("file_path"), F.col("chunk_index")).alias("id"), F.sha2("content", 256).alias("content_hash"))


@query("SELECT doc_id, (('0x' || substr(sha256(file_path), 1, 16))::ubigint % 8)::int AS shard, 'pfs_' || substr(sha256(source), 1, 10) || '_' || substr(sha256(source), 1, 10) || '_s' || lpad((('0x' || substr(sha256(file_path), 1, 16))::ubigint % 8)::varchar, 3, '0') AS namespace FROM documents")
def path_shards(spark, folder):
    s = path_shard(F.col("file_path"), 8)
    return table(spark, folder, "documents").select("doc_id", s.alias("shard"), shard_namespace(F.col("source"), F.col("source"), s).alias("namespace"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || '.' || p_brand)), '[^a-z0-9\\-_ .]', '', 'g'), '[\\-_ .]+', '-', 'g'), '-') AS slug, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9\\-_.]', '', 'g') AS name FROM part")
def slugs(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit("."), "p_brand")).alias("slug"), text.safe_object_name(F.concat("p_name", F.lit("/"), "p_type")).alias("name"))


@query("""SELECT size, CASE WHEN b IS NULL THEN NULL WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE b || ' B' END AS text
FROM (SELECT DISTINCT size, size * 997 AS b FROM root_states)""")
def byte_sizes(spark, folder):
    return table(spark, folder, "root_states").select("size").distinct().select("size", text.byte_size(F.col("size") * 997).alias("text"))


@query("SELECT delivery_id, payload_ref FROM queue_jobs WHERE regexp_matches(payload_ref, '^(syncs|files|bundles)/')")
def cleanup_keys(spark, folder):
    j = table(spark, folder, "queue_jobs")
    return j.join(jobs.deletable_keys(j, "payload_ref"), "payload_ref", "left_semi").select("delivery_id", "payload_ref")


@query()
def json_flatten(spark, folder):
    return text.flatten_json(table(spark, folder, "events").select("event_id", "props"), "event_id", "props", "props")


@query()
def html_to_text(spark, folder):
    html = F.concat(F.lit("<html><body><h1>"), "p_name", F.lit("</h1><p> "), "p_type", F.lit(" </p></body></html>"))
    return table(spark, folder, "part").select("p_partkey", text.html_to_text(html).alias("text"))


# ---- chunks -----------------------------------------------------------------------------------


@query("""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::int AS chunk_index, content FROM (
SELECT doc_id, s, substr(text, (s + 1)::bigint, 2000) AS content FROM documents, range(0, 10000000, 1800) AS t(s) WHERE s <= greatest(length(text) - 1, 0) AND (s = 0 OR s + 200 < length(text))) WHERE trim(content) <> ''""".replace("range(0, 10000000, 1800)", "range(0, 200000, 1800)"))
def chunk_markdown_fixed(spark, folder):
    d = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.inline(chunking.fixed_windows(F.col("text"), chunking.SECTION_CHARS, chunking.SECTION_OVERLAP)))


@query("""WITH l AS (SELECT chunk_key, string_split(content, chr(10)) AS p FROM chunks WHERE content IS NOT NULL),
n AS (SELECT chunk_key, list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS p FROM l)
SELECT chunk_key, (s + 1)::int AS line_start, least(s + 8, len(p))::int AS line_end, array_to_string(p[s + 1:s + 8], '') AS content FROM n, range(0, 20000, 6) AS t(s) WHERE s <= greatest(len(p) - 1, 0) AND (s = 0 OR s + 2 < len(p)) AND trim(array_to_string(p[s + 1:s + 8], '')) <> ''""")
def chunk_code_lines(spark, folder):
    c = table(spark, folder, "chunks").where(F.col("content").isNotNull())
    return c.select("chunk_key", F.inline(chunking.line_windows(F.col("content"), 8, 2)))


def _files(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select(F.coalesce("root_id", F.lit("")).alias("root_id"), F.col("file_path").alias("path"), F.col("text").alias("content"))


@query()
def chunk_local(spark, folder):
    return chunking.chunk_files(_files(spark, folder), "local")


@query()
def chunk_remote(spark, folder):
    return chunking.chunk_files(_files(spark, folder), "remote")


@query("""WITH e AS (SELECT event_id, (event_id * 37) % 2000 - 50 AS d FROM events)
SELECT event_id, i::int AS "index", (i * 300)::double AS "start", CASE WHEN d <= 0 THEN 360.0 ELSE least(i * 300 + 360, d)::double END AS "end" FROM e, range(0, 10) AS t(i) WHERE i = 0 OR i * 300 + 60 < d""")
def media_windows(spark, folder):
    e = table(spark, folder, "events").select("event_id", ((F.col("event_id") * 37) % 2000 - 50).alias("d"))
    return e.select("event_id", F.inline(chunking.media_ranges(F.col("d"))))


# ---- packing ----------------------------------------------------------------------------------


@query("WITH RECURSIVE " + _STATES.removeprefix("WITH ") + """, f AS (SELECT root_id, path, coalesce(size, 0) AS size, row_number() OVER (PARTITION BY root_id ORDER BY path) AS i FROM j WHERE status IN ('ADDED', 'MODIFIED', 'REMOVED')),
p AS (SELECT root_id, i, size, sum(size) OVER (PARTITION BY root_id ORDER BY i) AS b, max(i) OVER (PARTITION BY root_id) AS last FROM f),
r AS (SELECT root_id, 0 AS shard, 1::bigint AS first, 0::hugeint AS before FROM p WHERE i = 1
  UNION ALL SELECT r.root_id, r.shard + 1, max(p.i) + 1, max(p.b) FROM r JOIN p ON p.root_id = r.root_id AND p.i >= r.first AND (p.i = r.first OR (p.i < r.first + 5000 AND p.b - r.before <= 268435456)) GROUP BY r.root_id, r.shard, p.last HAVING max(p.i) < p.last),
s AS (SELECT root_id, shard, first, coalesce(lead(first) OVER (PARTITION BY root_id ORDER BY shard), 1099511627776) AS next FROM r)
SELECT s.root_id, s.shard::int AS shard, count(*) AS files, sum(f.size)::bigint AS bytes FROM s JOIN f ON f.root_id = s.root_id AND f.i >= s.first AND f.i < s.next GROUP BY 1, 2""")
def shard_packing(spark, folder):
    return packing.change_shards(diff.diff_states(*_states(spark, folder))).groupBy("root_id", "shard").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query()
def bundle_offsets(spark, folder):
    return packing.bundles(_states(spark, folder)[1].select("root_id", "path", "size"))


# ---- caches, reads ----------------------------------------------------------------------------


@query("""WITH c AS (SELECT content_hash, count(*) AS n FROM chunks WHERE content_hash IS NOT NULL AND chunk_key % 3 = 0 GROUP BY 1)
SELECT chunk_key, c.content_hash IS NOT NULL AS cached FROM chunks LEFT JOIN c USING (content_hash)""")
def embedding_cache_join(spark, folder):
    c = table(spark, folder, "chunks").select("chunk_key", F.lit("o").alias("org_id"), "content_hash", "content")
    cache = c.where("chunk_key % 3 = 0 and content_hash is not null").select("org_id", F.lit("m1").alias("model_version"), "content_hash", F.array(F.lit(1.0)).alias("vector"))
    return jobs.cached_embeddings(c, cache, "m1")[0].select("chunk_key", F.col("vector").isNotNull().alias("cached"))


@query("SELECT chunk_key, page_number FROM chunks WHERE page_number BETWEEN 1 AND 3")
def read_pages(spark, folder):
    return reads.read_pages(table(spark, folder, "chunks"), 2, 4).select("chunk_key", "page_number")


@query("""WITH l AS (SELECT root_id, file_path, line_start, line_end, chunk_index, chunk_key, string_split(content, chr(10)) AS p FROM indexed WHERE line_end >= 2 AND line_start <= 9 AND content IS NOT NULL),
x AS (SELECT root_id, file_path, line_start, chunk_index, line_end, line_start + i - 1 AS line, CASE WHEN i < len(p) THEN p[i] || chr(10) ELSE p[i] END AS content FROM l, range(1, 10000) AS t(i) WHERE i <= len(p))
SELECT root_id, file_path, line::int AS line, content FROM (SELECT *, row_number() OVER (PARTITION BY root_id, file_path, line ORDER BY line_start, chunk_index, content) AS r FROM x WHERE content <> '' AND line <= line_end AND line BETWEEN 2 AND 9) WHERE r = 1""".replace("FROM indexed WHERE", "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id, file_path, chunk_index ORDER BY chunk_key) AS first FROM chunks) WHERE first = 1) WHERE"))
def read_lines(spark, folder):
    c = table(spark, folder, "chunks")
    one = c.withColumn("r", F.row_number().over(Window.partitionBy("root_id", "file_path", "chunk_index").orderBy("chunk_key"))).where("r = 1")
    return reads.read_lines(one, 2, 9)


@query("SELECT root_id, file_path, (min(page_number) + 1)::int AS first_page, (max(page_number) + 1)::int AS last_page, min(line_start) AS first_line, max(line_end) AS last_line FROM chunks GROUP BY 1, 2")
def range_summary(spark, folder):
    return reads.ranges(table(spark, folder, "chunks")).drop("file_type")


@query("SELECT file_path, chunk_index FROM chunks WHERE starts_with(file_path, 'legal/') ORDER BY file_path, chunk_index LIMIT 50")
def path_scan(spark, folder):
    return reads.path_scan(table(spark, folder, "chunks"), 50, "legal/").select("file_path", "chunk_index")


# ---- jobs and generations ---------------------------------------------------------------------


@query("SELECT sync_id, coalesce(sum(CASE WHEN status = 'done' THEN files_in_shard ELSE 0 END), 0)::bigint AS done, coalesce(sum(files_in_shard), 0)::bigint AS total FROM queue_jobs GROUP BY 1")
def job_progress(spark, folder):
    j = table(spark, folder, "queue_jobs").withColumn("d", F.when(F.col("status") == "done", F.col("files_in_shard")).otherwise(0))
    return jobs.job_progress(j, "sync_id", "d", "files_in_shard")


@query("SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY sync_id, stage ORDER BY updated_at DESC, delivery_id DESC) AS r FROM queue_jobs) WHERE r = 1")
def latest_job(spark, folder):
    j = table(spark, folder, "queue_jobs").select("delivery_id", "sync_id", "stage", "updated_at")
    return jobs.latest(j, ["sync_id", "stage"], ["updated_at", "delivery_id"]).select("delivery_id")


@query("SELECT stage, status, count(*) AS n FROM queue_jobs GROUP BY 1, 2")
def queue_summary(spark, folder):
    return jobs.status_counts(table(spark, folder, "queue_jobs"), ["stage"], "status")


@query("SELECT sync_id FROM queue_jobs WHERE status = 'running' UNION SELECT sync_id FROM queue_jobs WHERE status = 'queued'")
def active_sync_exists(spark, folder):
    j = table(spark, folder, "queue_jobs")
    return jobs.active_exists([j.where("status = 'running'"), j.where("status = 'queued'")], "sync_id")


@query("SELECT delivery_id, created_at FROM queue_jobs ORDER BY created_at DESC, delivery_id LIMIT 20")
def recent_jobs(spark, folder):
    return jobs.recent(table(spark, folder, "queue_jobs"), "created_at", tie="delivery_id").select("delivery_id", "created_at")


@query("SELECT r.root_id, coalesce(g.generation_seq, 0) AS visible_generation_seq FROM roots r LEFT JOIN generations g ON g.generation_id = r.visible_generation_id")
def roots_with_generation(spark, folder):
    return jobs.roots_with_generation(table(spark, folder, "roots"), table(spark, folder, "generations")).select("root_id", "visible_generation_seq")


@query("SELECT delivery_id FROM queue_jobs j WHERE status IN ('running', 'queued') AND (updated_at < TIMESTAMPTZ '2025-05-01 00:00:00+00' - INTERVAL 30 MINUTES OR EXISTS (SELECT 1 FROM generations g WHERE g.generation_id = j.generation_id AND g.status = 'failed'))")
def stale_jobs(spark, folder):
    now = F.timestamp_micros(F.lit(1746057600000000))
    return jobs.stale_jobs(table(spark, folder, "queue_jobs"), table(spark, folder, "generations"), now).select("delivery_id")


@query("SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY sync_id ORDER BY delivery_id) AS r FROM queue_jobs WHERE status <> 'done') WHERE r <= 32")
def in_flight(spark, folder):
    return jobs.in_flight(table(spark, folder, "queue_jobs"), "sync_id", "delivery_id").select("delivery_id")


@query("SELECT count(DISTINCT file_path) AS files FROM indexed_chunks")
def distinct_files(spark, folder):
    t = table(spark, folder, "indexed_chunks")
    return jobs.distinct_files(t.where("op = 'upsert'"), t.where("op = 'close'"))


@query("SELECT generation_id, CASE WHEN generation_seq % 5 = 0 THEN 'failed' ELSE status END AS status FROM generations")
def keyed_upsert(spark, folder):
    g = table(spark, folder, "generations").select("generation_id", "generation_seq", "status")
    return jobs.upserted(g, g.where("generation_seq % 5 = 0").withColumn("status", F.lit("failed")), ["generation_id"]).select("generation_id", "status")


# ---- streams ----------------------------------------------------------------------------------


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM events WHERE user_id IS NOT NULL),
i AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM b)
SELECT user_id, min(ts) AS "first", max(ts) AS "last", count(*) AS events FROM i GROUP BY user_id, g""")
def debounced_sessions(spark, folder):
    return jobs.gaps_and_islands(table(spark, folder, "events").where("user_id is not null"), "user_id", "ts", 6 * 3600)


def _work(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at = _work(spark)
    follow.into_table(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


def _event_stream(spark, folder) -> DataFrame:
    events = follow.file_stream(spark, folder, table(spark, folder, "events").schema, name="events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dedupe(spark, folder):
    s = _event_stream(spark, folder).withColumn("k", F.concat_ws("|", F.coalesce(F.col("user_id").cast("string"), F.lit("-")), "event_type"))
    return _run(spark, follow.deduplicated(s, "k", "ts", "3650 days").select("event_type", "user_id"))


@query("SELECT event_id, event_type, round(value * 2, 6) AS twice FROM events WHERE value > 10")
def stream_incremental_index(spark, folder):
    return _run(spark, _event_stream(spark, folder).where("value > 10").select("event_id", "event_type", F.round(F.col("value") * 2, 6).alias("twice")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS length FROM (SELECT vec_id, embedding::double[] AS e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) AS n FROM embeddings)")
def vector_unit(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", _r(vectors.norm(vectors.unit(F.col("embedding")))).alias("length"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL")
def file_hashes(spark, folder):
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", file_hash(F.col("text")).alias("file_hash"))


# ---- events and reports -----------------------------------------------------------------------


@query("SELECT event_id, (1 + (user_id IS NOT NULL)::int + (value IS NOT NULL)::int + 1)::int AS n, event_type AS kind, 'web' AS source FROM events WHERE event_type IS NOT NULL")
def event_enrichment(spark, folder):
    e = table(spark, folder, "events").where("event_type is not null")
    own = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("string"))
    got = events.enriched(e, own, {"source": "web", "kind": "unused"}, "p")
    return got.select("event_id", F.size("p").alias("n"), F.col("p")["kind"].alias("kind"), F.col("p")["source"].alias("source"))


@query()
def dry_run_report(spark, folder):
    return events.dry_run(diff_stats(spark, folder))


@query(_bm25_sql(_DOCS, "doc_id") + "SELECT printf('%.4f', s.score) || '  ' || file_path || '#0' AS line FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 10) s JOIN documents USING (doc_id)")
def result_lines(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "file_path", F.lit(0).alias("chunk_index"), "text")
    best = ranking.top(ranking.bm25(d, "text", QUERY), 10, ["doc_id"])
    return events.result_lines(best, False)


# ---- queues, shards, policies -------------------------------------------------------------------


@query("""WITH d AS (SELECT *, coalesce(attempts, 0) AS n, coalesce(status = 'failed', false) AS bad, stage = 'commit' AND shard_index % 4 = 1 AS late FROM queue_jobs),
a AS (SELECT *, CASE WHEN late THEN 'wait' WHEN bad AND n >= CASE WHEN stage IN ('commit', 'cleanup') THEN 30 ELSE 3 END THEN 'fail' WHEN bad THEN 'retry' ELSE 'ack' END AS action FROM d)
SELECT delivery_id, action, CASE action WHEN 'wait' THEN 5 WHEN 'retry' THEN greatest(n * n * 10, 1) END AS delay FROM a""")
def delivery_outcomes(spark, folder):
    j = table(spark, folder, "queue_jobs")
    return queues.outcomes(j, F.col("status") == "failed", (F.col("stage") == "commit") & (F.col("shard_index") % 4 == 1)).select("delivery_id", "action", "delay")


@query("""WITH o AS (SELECT sync_id, stage, shard_index, max(CASE status WHEN 'done' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END) AS r, max(total_shards) AS t FROM queue_jobs GROUP BY 1, 2, 3),
k AS (SELECT *, coalesce(shard_index >= 0, false) AS ok FROM o),
c AS (SELECT sync_id, stage, count(*) FILTER (ok AND r = 3) AS done, coalesce(max(t), 0)::bigint AS total, count(*) FILTER (ok AND r = 2) AS failed, count(*) FILTER (ok AND r = 1) AS "open", count(*) FILTER (ok AND r = 3 AND shard_index < t) AS inside FROM k GROUP BY 1, 2)
SELECT sync_id, stage, done, total, failed, "open", total > 0 AND inside >= total AS ready FROM c""")
def commit_barrier(spark, folder):
    return queues.barrier(table(spark, folder, "queue_jobs"), ["sync_id", "stage"], F.col("status"))


@query("""WITH a AS (SELECT sync_id, shard_index, max(row_files) AS f FROM (SELECT sync_id, shard_index, count(*) AS row_files FROM queue_jobs WHERE result_ref IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2)
SELECT delivery_id, CASE WHEN files_in_shard > 0 THEN files_in_shard::bigint ELSE coalesce(a.f, 0) END AS files FROM queue_jobs j LEFT JOIN a ON a.sync_id = j.sync_id AND a.shard_index = j.shard_index""")
def progress_files(spark, folder):
    j = table(spark, folder, "queue_jobs")
    known = j.where("result_ref is not null").groupBy("sync_id", "shard_index").agg(F.count("*").alias("files"))
    return queues.progress_files(j, ["sync_id", "shard_index"], known).select("delivery_id", "files")


@query("""WITH r AS (SELECT generation_id, root_id, (generation_seq % 4)::int AS n FROM generations),
k AS (SELECT generation_id, 'syncs/' || generation_id || '/request.json' AS key FROM r
  UNION ALL SELECT generation_id, 'syncs/' || generation_id || '/done/shard-' || lpad(i::varchar, 6, '0') || '.done' FROM r, range(4) AS t(i) WHERE i < n
  UNION ALL SELECT generation_id, 'files/' || s.root_id || '/' || path FROM root_states s JOIN (SELECT DISTINCT generation_id FROM r) USING (generation_id) WHERE size % 2 = 0 AND path <> '')
SELECT DISTINCT generation_id, key FROM k""")
def cleanup_objects(spark, folder):
    g = table(spark, folder, "generations")
    none = F.lit(None).cast("string")
    requests = g.select("generation_id", "root_id", (F.col("generation_seq") % 4).cast("int").alias("total_shards"), none.alias("manifest_ref"), F.lit("states/kept.json").alias("proof_ref"), F.array().cast("array<string>").alias("change_refs"))
    changes = table(spark, folder, "root_states").select("generation_id", F.when(F.col("size") % 2 == 0, "ADDED").otherwise("REMOVED").alias("status"), "path", none.alias("source_key"))
    return queues.cleanup_objects(requests, changes)


_NAMES = """WITH x AS (SELECT root_id, row_number() OVER (ORDER BY root_id) AS i FROM roots),
ns AS (SELECT root_id, i, s, 4 AS n, i % 5 = 0 AND s = 2 AS retired FROM x, range(4) AS t(s) WHERE NOT (i % 7 = 0 AND s = 3))
"""


def _namespaces(spark, folder) -> DataFrame:
    x = table(spark, folder, "roots").select("root_id", F.row_number().over(Window.orderBy("root_id")).alias("i"))
    ns = x.select("root_id", "i", F.explode(F.array(*map(F.lit, range(4)))).alias("shard_index")).where("not (i % 7 = 0 and shard_index = 3)")
    retired = F.when((F.col("i") % 5 == 0) & (F.col("shard_index") == 2), F.timestamp_micros(F.lit(0)))
    return ns.select("root_id", "shard_index", F.lit(4).alias("shard_count"), F.concat_ws("_", "root_id", "shard_index").alias("namespace"), retired.alias("retired_at"))


@query(_NAMES + "SELECT DISTINCT root_id, 'missing shards' AS error FROM ns WHERE i % 5 = 0 OR i % 7 = 0")
def shard_errors(spark, folder):
    return namespaces.shard_errors(_namespaces(spark, folder))


@query(_NAMES + """, d AS (SELECT row_no, root_id, (('0x' || substr(sha256(file_path), 1, 16))::ubigint % 4)::int AS s FROM indexed_chunks)
SELECT row_no, CASE WHEN i % 5 <> 0 AND i % 7 <> 0 THEN d.root_id || '_' || s END AS namespace FROM d LEFT JOIN x ON x.root_id = d.root_id""")
def path_namespaces(spark, folder):
    rows = table(spark, folder, "indexed_chunks").select("row_no", "root_id", F.col("file_path").alias("path"))
    return namespaces.path_namespaces(rows, _namespaces(spark, folder)).select("row_no", "namespace")


@query(_STATES + r"""SELECT root_id, path, status FROM w WHERE status NOT IN ('REMOVED', 'UNCHANGED') AND trim(path) <> '' AND (regexp_matches(path, '(^|/)[^/]*\.pdf(/|$)') OR starts_with(path, 'hr/') OR regexp_matches(path, '(^|/)specs/.'))""")
def policy_violations(spark, folder):
    changes = diff.changed(diff.with_moves(diff.diff_states(*_states(spark, folder))))
    return diff.policy_violations(changes, ["*.pdf", "# note", "!keep.pdf"], ["/hr/", "specs/"]).select("root_id", "path", "status")


@query("SELECT row_no::varchar AS id, CASE WHEN row_no % 2 = 0 THEN 2 ELSE 3 END::bigint AS seq FROM indexed_chunks WHERE op = 'upsert'")
def commit_conflict(spark, folder):
    """Two writers on one base: the first to commit stays, the other's rows come with its second try."""
    rows = _rows(spark, folder)
    at = Store(spark, f"{_work(spark)}/store")

    def write(g, mine: Column) -> None:
        own = rows.where(mine).withColumns({"id": F.col("row_no").cast("string"), "root_id": F.lit("r"), "valid_from_generation_seq": F.lit(g.seq).cast("long")})
        full = own.select(*(F.col(c) if c in own.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in ROWS.split(", "))))
        at.write(g, full, spark.createDataFrame([], CLOSES), spark.createDataFrame([], STATE))

    late = at.begin("r")
    first = at.begin("r", timeout=0)
    write(late, F.col("row_no") % 2 == 1)
    write(first, F.col("row_no") % 2 == 0)
    at.commit(first)
    try:
        at.commit(late)
    except Conflict:
        again = at.begin("r")
        write(again, F.col("row_no") % 2 == 1)
        at.commit(again)
    return at.rows("r").select("id", F.col("valid_from_generation_seq").alias("seq"))
