"""The k most similar vectors of every vector: inverted file with product-quantised residuals.

1. Vectors of one direction are one entry of the index, however many ids share it; entries are numbered in
   the order of their smallest ids, so that equal similarities are ranked by number everywhere.
2. Centroids in two levels (cells, and lists within each) and the codebooks of the residuals are fitted on a
   bounded sample. The number of lists grows with the root of the number of entries, about LISTS_A_CELL to a
   cell, until the sample bounds it.
3. Every entry is filed in the list of its nearest centroid and coded. It asks the `probes` nearest lists; its
   vector goes once to each cell that holds some of them, with the numbers of those lists.
4. In a cell, asymmetric distance tables (the query's inner products with every codeword, part by part) rank
   the members of each list asked, and the best `rerank` are compared exactly on the true vectors. The k best
   of a cell go on, by similarity and number.

Cells that hold more than CELL_ROWS members by the sample's share are split by entry; queries visit each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.wordhash import mix
from quarrylake.session import written

SAMPLE, MOST_SAMPLE = 20_000, 1 << 18  # vectors that centroids are fitted on: 16 a list within these bounds
BOOK_SAMPLE = 6_000  # of these, residuals that the codebooks are fitted on
LISTS_A_CELL = 16
NEAR_CELLS = 32  # cells whose lists are looked at for the nearest ones
CELL_ROWS = 1 << 17
PARTS = 32
CODES = 256
SEED = 7
ASKED = 2048  # queries of a cell handled together


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), 1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.concatenate((c, np.zeros((k - len(c), x.shape[1]), x.dtype)))
    for _ in range(rounds):
        at = np.concatenate([_nearest(x[i : i + 8192], c) for i in range(0, len(x), 8192)])
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


class Model:
    """Centroids of cells and lists, codebooks of residuals, and the parts of each cell."""

    def __init__(self, sample: np.ndarray, lists: int, entries: int):
        rng = np.random.default_rng(SEED)
        dim = sample.shape[1]
        self.parts = next(p for p in range(min(PARTS, dim), 0, -1) if dim % p == 0)
        self.top = kmeans(sample, max(1, round(lists / LISTS_A_CELL)), 8, rng)
        at = np.concatenate([_nearest(sample[i : i + 8192], self.top) for i in range(0, len(sample), 8192)])
        kept, lower = [], []
        for cell in range(len(self.top)):
            own = sample[at == cell]
            if len(own):
                kept.append(cell)
                lower.append(kmeans(own, max(1, min(len(own), round(lists * len(own) / len(sample)))), 6, rng))
        self.top = self.top[kept]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in lower])))  # first list of each cell
        self.lists = np.concatenate(lower)
        self.cell = np.repeat(np.arange(len(lower)), np.diff(self.first))
        own = np.concatenate([self.near(sample[i : i + 2048], 1)[:, 0] for i in range(0, len(sample), 2048)])
        step = dim // self.parts
        r = (sample - self.lists[own])[rng.permutation(len(sample))[:BOOK_SAMPLE]]
        self.books = np.stack([kmeans(r[:, p * step : (p + 1) * step], CODES, 6, rng) for p in range(self.parts)])
        share = np.bincount(self.cell[own], minlength=len(self.top)) / len(sample)
        self.split = np.maximum(1, np.ceil(share * entries / CELL_ROWS)).astype(np.int64)

    def near(self, u: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lists of each vector among those of its NEAR_CELLS nearest cells, the nearest first; -1 where there are fewer."""
        k, cells = min(k, len(self.lists)), len(self.top)
        far = (self.lists * self.lists).sum(1) - 2 * (u @ self.lists.T) if cells <= NEAR_CELLS else None
        if far is None:
            close = np.argpartition((self.top * self.top).sum(1) - 2 * (u @ self.top.T), NEAR_CELLS - 1, 1)[:, :NEAR_CELLS]
            far = np.full((len(u), len(self.lists)), np.inf, np.float32)
            for cell in np.unique(close):
                rows = np.flatnonzero((close == cell).any(1))
                a, b = self.first[cell], self.first[cell + 1]
                far[rows, a:b] = (self.lists[a:b] * self.lists[a:b]).sum(1) - 2 * (u[rows] @ self.lists[a:b].T)
        got = np.argpartition(far, k - 1, 1)[:, :k] if k < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(u), 1))
        value = np.take_along_axis(far, got, 1)
        order = np.argsort(value, 1, kind="stable")
        return np.where(np.isfinite(np.take_along_axis(value, order, 1)), np.take_along_axis(got, order, 1), -1)

    def encode(self, u: np.ndarray, own: np.ndarray) -> np.ndarray:
        r, step = u - self.lists[own], u.shape[1] // self.parts
        return np.stack([_nearest(r[:, p * step : (p + 1) * step], self.books[p]) for p in range(self.parts)], 1).astype(np.uint8)

    def scores(self, u: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the members of one list, as coded, from the queries' distance tables."""
        step = u.shape[1] // self.parts
        out = np.repeat((u @ self.lists[which])[:, None], len(codes), 1)
        for p in range(self.parts):
            out += np.take(u[:, p * step : (p + 1) * step] @ self.books[p].T, codes[:, p], axis=1)
        return out


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def pack(v: np.ndarray) -> list[bytes]:
    """Two or four bytes a number where that loses nothing, else eight."""
    with np.errstate(over="ignore"):
        kinds = [v.astype(t) for t in (np.float16, np.float32)]
    half, short = ((x == v).all(1) for x in kinds)
    return [(kinds[0][i] if half[i] else kinds[1][i] if short[i] else v[i]).tobytes() for i in range(len(v))]


def unpack(b: list[bytes], dim: int) -> np.ndarray:
    if b and all(len(x) == 2 * dim for x in b):
        return np.frombuffer(b"".join(b), np.float16).reshape(-1, dim).astype(np.float64)
    kind = {2 * dim: np.float16, 4 * dim: np.float32, 8 * dim: np.float64}
    return np.stack([np.frombuffer(x, kind[len(x)]) for x in b]).astype(np.float64) if b else np.empty((0, dim))


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each vector's direction, to 11 digits."""
    x = np.round(v / np.abs(v).max(1, keepdims=True), 11) + 0.0
    bits = x.view(np.uint64).reshape(x.shape)
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, (2, x.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    spread = mix(bits.copy())
    return tuple(mix((spread * o).sum(1, dtype=np.uint64)).view(np.int64) for o in odd)


def usable_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors) of those with `dim` finite numbers that aren't all zero."""
    size = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero((size == dim) & ~np.asarray(column.is_null()))
    flat, starts = column.values, column.offsets.to_numpy()
    at = (starts[rows][:, None] + np.arange(dim)).ravel()
    v = flat.take(pa.array(at)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null becomes NaN
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    return rows[good], v[good]


def index_entries(df: DataFrame, key: str, vector: str, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(one row of an id: id, h1, h2, salt; entries: num, h1, h2, v, the k + 1 smallest ids, the salts of all ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = usable_vectors(b.column(1), dim)
            h1, h2 = directions(v) if len(v) else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(h1), pa.array(h2), pa.array(pack(v), pa.binary())], ["id", "h1", "h2", "v"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(read, f"id {kind}, h1 long, h2 long, v binary")
    salt = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("salt")
    one = rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2", salt)
    # the limit is applied within each task before the shuffle, so a direction of any number of ids sends few
    r = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    ids = one.select("id", "h1", "h2").withColumn("r", r).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    v = rows.groupBy("h1", "h2").agg(F.min("v").alias("v"))
    salts = one.groupBy("h1", "h2").agg(F.collect_set("salt").alias("salts"))
    whole = ids.join(v, ["h1", "h2"]).join(salts, ["h1", "h2"])
    return one, whole.orderBy(F.col("ids")[0]).select(F.monotonically_increasing_id().alias("num"), "h1", "h2", "v", "ids", "salts")


def search_cell(model: Model, k: int, rerank: int, m: np.ndarray, num: np.ndarray, own: np.ndarray, codes: np.ndarray, q: np.ndarray, qnum: np.ndarray, asked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member number, cosine) of the k best members of a cell for each query. Members are sorted by list."""
    u, qn = unit(q), np.sqrt((q * q).sum(1))
    mn = np.sqrt((m * m).sum(1))
    who, what = np.repeat(np.arange(len(q)), [len(a) for a in asked]), np.concatenate(asked)
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    rows, members, values = [], [], []
    for which in np.unique(what):
        a, b = np.searchsorted(own, [which, which + 1])
        if a == b:
            continue
        x = who[slice(*np.searchsorted(what, [which, which + 1]))]
        best = np.tile(np.arange(a, b), (len(x), 1))
        if b - a > rerank:
            s = model.scores(u[x], which, codes[a:b])
            s[qnum[x][:, None] == num[a:b]] = -np.inf
            best = a + np.argpartition(-s, rerank - 1, 1)[:, :rerank]
        dot = np.matmul(m[best], q[x][:, :, None])[:, :, 0]
        cos = np.round(dot / qn[x][:, None] / mn[best], 12)
        cos[qnum[x][:, None] == num[best]] = -np.inf
        if best.shape[1] > k:
            top = np.lexsort((num[best], -cos), axis=1)[:, :k]
            best, cos = np.take_along_axis(best, top, 1), np.take_along_axis(cos, top, 1)
        rows.append(np.repeat(x, best.shape[1]))
        members.append(num[best].ravel())
        values.append(cos.ravel())
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    rows, members, values = map(np.concatenate, (rows, members, values))
    order = np.lexsort((members, -values, rows))
    rows, members, values = rows[order], members[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    good = (place < k) & np.isfinite(values)
    return rows[good], members[good], values[good]


def nearest_neighbours(df: DataFrame, key: str, vector: str, dim: int = 64, k: int = 5, probes: int = 20, rerank: int = 24) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar other ids of every id with a usable vector.

    Rows of one id count once (they have one vector). Null, short, zero or non-finite vectors take no
    part. Equal similarities rank the smaller id first. An index of up to k ids gives fewer neighbours.
    """
    spark = df.sparkSession
    one, whole = index_entries(df, key, vector, dim, k)
    entries = written(whole)
    total = entries.count()
    kind = df.schema[key].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, cosine double, rank int")
    size = int(min(MOST_SAMPLE, max(SAMPLE, 32 * np.sqrt(total))))
    fitted = entries.select("v", F.xxhash64("num").alias("h"), "num").orderBy("h", "num").limit(size).toArrow()["v"].to_pylist()
    lists = int(max(1, min(2 * np.sqrt(total), len(fitted) / 8)))
    shared = spark.sparkContext.broadcast(Model(unit(unpack(fitted, dim)), lists, total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                num, raw = part.column(0).to_numpy(), part.column(1)
                u = unit(unpack(raw.to_pylist(), dim))
                near = model.near(u, probes)
                own = near[:, 0]
                code = model.encode(u, own)
                # one row for each query and cell: its lists there, in the order of lists
                row, lists_ = np.repeat(np.arange(len(u)), near.shape[1]), near.ravel()
                row, lists_ = row[lists_ >= 0], lists_[lists_ >= 0]
                order = np.lexsort((lists_, row))
                row, lists_ = row[order], lists_[order]
                cell = model.cell[lists_]
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))))
                asked = [x.astype(np.int32).tobytes() for x in np.split(lists_, first[1:])]
                q, to = row[first], cell[first]
                more = np.repeat(np.arange(len(q)), model.split[to])
                sub = np.arange(len(more)) - np.searchsorted(more, more)
                home = (num.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % model.split[model.cell[own]]
                take = np.concatenate((np.arange(len(u)), q[more]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((model.cell[own], to[more])).astype(np.int32)), pa.array(np.concatenate((home, sub)).astype(np.int32)),
                        pa.array(np.concatenate((own, np.full(len(more), -1))).astype(np.int32)), pa.array(num[take]), raw.take(pa.array(take)),
                        pa.array([x.tobytes() for x in code] + [asked[i] for i in more], pa.binary()),
                    ],
                    ["cell", "sub", "list", "num", "v", "x"],
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of cell and part, queries (list -1) before nothing: members come first, by list."""
        model: Model = shared.value
        cell, held, members = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = (batch.column(0).to_numpy().astype(np.int64) << 32) | batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))).tolist() + [len(at)]
            for s, e in zip(cuts, cuts[1:]):
                if at[s] != cell:
                    cell, held, members = at[s], [], None
                part = batch.slice(s, e - s)
                own = part.column(2).to_numpy()
                mid = int((own >= 0).sum())
                if mid:
                    held.append(part.slice(0, mid))
                if mid == len(own) or not held:
                    continue
                if members is None:
                    t = pa.Table.from_batches(held)
                    members = (unpack(t["v"].to_pylist(), dim), t["num"].to_numpy(), t["list"].to_numpy(), np.frombuffer(b"".join(t["x"].to_pylist()), np.uint8).reshape(-1, model.parts))
                for i in range(mid, len(own), ASKED):
                    some = part.slice(i, ASKED)
                    q, qnum = unpack(some.column(4).to_pylist(), dim), some.column(3).to_numpy()
                    row, num, cos = search_cell(model, k, rerank, *members, q, qnum, [np.frombuffer(x, np.int32) for x in some.column(5).to_pylist()])
                    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.empty(0, np.int64)
                    best = pa.StructArray.from_arrays([pa.array(-cos), pa.array(num)], ["far", "num"])
                    yield pa.RecordBatch.from_arrays([pa.array(qnum[row[begin]]), pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), best)], ["q", "best"])

    placed = entries.select("num", "v").mapInArrow(place, "cell int, sub int, list int, num long, v binary, x binary")
    found = placed.repartition("cell", "sub").sortWithinPartitions("cell", "sub", F.col("list") < 0, "list").mapInArrow(ask, "q long, best array<struct<far: double, num: long>>")
    near = found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("n")).select("q", F.inline("n"))
    near = near.unionByName(entries.select(F.col("num").alias("q"), F.lit(-1.0).alias("far"), "num"))  # ids of the entry itself
    # at most k + 1 entries with k + 1 ids each
    offers = near.join(entries.select("num", "ids"), "num").select("q", "far", F.explode("ids").alias("neighbour"))
    best = offers.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "neighbour"))), 1, k + 1).alias("n"))
    best = best.join(entries.select(F.col("num").alias("q"), "h1", "h2", F.explode("salts").alias("salt")), "q").select("h1", "h2", "salt", "n")
    asked = one.join(best, ["h1", "h2", "salt"])
    others = F.slice(F.filter("n", lambda s: s["neighbour"] != F.col("id")), 1, k)
    return asked.select("id", F.posexplode(others).alias("i", "s")).select("id", "s.neighbour", (-F.col("s.far")).alias("cosine"), (F.col("i") + 1).alias("rank"))
