"""Near-duplicate records: a similarity self-join of word-shingle sets by prefix trees.

Every record is the set of its runs of k words. Sets are kept in one global order (rare shingles
first), so two sets with |A & B| / |A | B| >= t must share one of their first n - ceil(t n) + 1
shingles. Records meet in the group of such a shared shingle; there the continuations of the indexed
records form a trie, and each probing record walks it: a node's overlap is computed once for all
records below, and a subtree is left as soon as its overlap plus what can still follow on either side
falls short of what its lengths require. Survivors are compared exactly.

Stages and what moves between them:

1. corpus sketch: document frequency of shingles in 2**bits counters, summed over all records; only
   this table of fixed size reaches the driver. It sets the order, and nothing else: any order gives
   the same result. A shingle whose counter is 1 stands in one record only and is not sent at all.
2. copies: equal contents become one record (map-side first), so a group of copies of any size
   costs one record from here on.
3. prefixes: (group, length and position, the next shingles of the prefix). The continuation is sent
   in 13 bits a shingle, which keep the order, as differences of mostly one byte.
4. trie walk in each group. A shingle whose counter exceeds 2**GROUP_BITS, and eight times the mean of all
   counters, is split in blocks by record; its probing rows visit each block and are streamed, never held.
5. exact check on the contents of the surviving pairs. The result is pairs of contents and the rows of each
   content; who wants pairs of rows expands them, groups of copies in buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.sketch import counter_classes
from quarrylake.llm.wordhash import blocks, shingles

SKETCH_BITS = 25  # counters: 2**25, one byte each (32 MB at any corpus size, packed when broadcast)
GROUP_BITS = 15  # rows of one trie
DEPTH = 32  # most shingles of a prefix sent along for the walk
SHORT = 39  # bits of a 52-bit shingle left out there
FRONTIER = 1 << 20  # states of a walk held at once
HELD = 1 << 18  # rows of a partition handled at once
AHEAD = 10  # shingles sent beyond those that a record may lack
ID_BYTES = 10
BUCKET = 512  # copies of a content expanded together


@lru_cache(maxsize=1)
def _opened(sketch: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sketch), np.uint8)


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def corpus_sketch(df: DataFrame, content: str, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Class of the document frequency of the shingles of each counter."""

    def count(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h = [shingles(texts, k)[0] for _, texts in blocks(b.column(0).to_pylist())]
        return _buckets(np.concatenate(h) if h else np.empty(0, np.uint64), bits), np.uint32(1)

    return counter_classes(df.select(content).where(F.col(content).isNotNull()), count, bits)


def hot_class(sketch: np.ndarray) -> int:
    """The class of counters from which a shingle is taken for a frequent one: above GROUP_BITS, and well above what
    unrelated shingles of one counter come to."""
    mean = np.exp2(sketch[sketch > 0] - 0.5).sum() / len(sketch)
    return max(GROUP_BITS, int(np.ceil(np.log2(max(8 * mean, 1)))))


def ordered_sets(texts: list[str], k: int, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in 52 bits: frequency class, then hash; start of each text). Sorted and distinct per text."""
    h, doc = shingles(texts, k)
    bits = int(len(sketch)).bit_length() - 1
    token = (sketch[_buckets(h, bits)].astype(np.uint64) << np.uint64(47)) | (h & np.uint64((1 << 47) - 1))
    token |= doc.astype(np.uint64) << np.uint64(52)
    token.sort()
    if len(token):
        token = token[np.concatenate(([True], token[1:] != token[:-1]))]
    starts = np.searchsorted(token, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(52))
    return token & np.uint64((1 << 52) - 1), starts


def ceil_div(a, b):
    return -(-a // b)


def prefix_rows(ids: list, texts: list[str], k: int, num: int, den: int, sketch: np.ndarray, hot_from: int = GROUP_BITS) -> pa.RecordBatch:
    """The rows of stage 3 for a block of records."""
    token, starts = ordered_sets(texts, k, sketch)
    n = np.diff(starts)
    p = np.where(n > 0, n - ceil_div(n * num, den) + 1, 0)
    rec = np.repeat(np.arange(len(n)), p)
    i = np.arange(len(rec)) - np.repeat(np.cumsum(p) - p, p)
    at = starts[:-1][rec] + i
    level = (token[at] >> np.uint64(47)).astype(np.int64)
    sent = level > 1
    rec, i, at, level = rec[sent], i[sent], at[sent], level[sent]
    spare = n[rec] - ceil_div(2 * num * n[rec], num + den)  # shingles that a record of equal length may lack
    tail = np.minimum(p[rec] - 1 - i, np.minimum(DEPTH, np.maximum(spare - i, 0) + AHEAD))
    index = i < spare + 1
    # a shingle of a high class is split: indexed rows in one block, probing rows in every block
    split = np.left_shift(1, np.maximum(level - hot_from, 0))
    hot = split > 1
    role = np.full(len(rec), 2, np.int8)
    block = np.zeros(len(rec), np.int64)
    pick = np.arange(len(rec))
    if hot.any():
        own = np.array([int.from_bytes(x[:8], "little") for x in ids], np.uint64)[rec]
        cold, hi, hp = np.flatnonzero(~hot), np.flatnonzero(hot & index), np.flatnonzero(hot)
        probes = np.repeat(hp, split[hp])
        each = np.arange(len(probes)) - np.repeat(np.cumsum(split[hp]) - split[hp], split[hp])
        pick = np.concatenate((cold, hi, probes))
        role = np.concatenate((np.full(len(cold), 2), np.zeros(len(hi)), np.ones(len(probes)))).astype(np.int8)
        block = np.concatenate((np.zeros(len(cold), np.int64), (own[hi] % split[hi].astype(np.uint64)).astype(np.int64), each))
    rec, i, at, tail = rec[pick], i[pick], at[pick], tail[pick]
    flat = np.repeat(at + 1, tail) + np.arange(int(tail.sum())) - np.repeat(np.cumsum(tail) - tail, tail)
    short = (token >> np.uint64(SHORT)).astype(np.int64)
    sizes, data = packed(short[flat] - short[flat - 1], tail)
    seq = pa.Array.from_buffers(pa.binary(), len(rec), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(data)])
    head = ((block << 2) | role).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(token[at].astype(np.int64)), pa.array(head), pa.array((n[rec] << 32) | i), pa.array(ids, pa.binary()).take(pa.array(rec)), seq], ["tok", "head", "meta", "id", "seq"])


def packed(steps: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each run, all bytes): a step is as many 255s as it holds, then the rest."""
    wide = steps // 255
    ends = np.cumsum(wide + 1)
    data = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    data[ends - 1] = steps % 255
    total = np.concatenate(([0], ends))
    cut = np.cumsum(runs)
    return total[cut] - total[cut - runs], data


def unpacked(base: np.ndarray, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, padded to DEPTH with 0; their number) of each run off[j]..off[j+1]-1 of bytes."""
    ends = data != 255
    before = np.concatenate(([0], np.cumsum(ends)))
    length = before[off[1:]] - before[off[:-1]]
    total = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    rows = np.zeros((len(base), DEPTH), np.int64)
    rows[np.arange(DEPTH) < length[:, None]] = total[1:][ends]
    rows += np.where(np.arange(DEPTH) < length[:, None], (base - total[off[:-1]])[:, None], 0)
    return rows.astype(np.uint16), length


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, element) for runs start..start+size-1."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def trie_walk(group: np.ndarray, n: np.ndarray, i: np.ndarray, role: np.ndarray, ident: np.ndarray, seqs: np.ndarray, length: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probing row, indexed row) of each group that the trie can't rule out.

    seqs: the 13-bit continuations, rows padded to DEPTH with 0 and sorted; length: their true lengths.
    The indexed rows, sorted by group and continuation, are the trie: a node of depth d is a run of
    rows with the same first d shingles. The walk goes down level by level for all probes at once.
    """
    need = lambda a, b: ceil_div(num * (a + b), num + den)
    indexed = np.flatnonzero((role != 1) & (i < n - ceil_div(2 * num * n, num + den) + 1))
    probes = np.flatnonzero(role != 0)
    if not len(indexed) or not len(probes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = np.empty((len(indexed), DEPTH + 1), ">u4")
    keys[:, 0] = group[indexed]
    keys[:, 1:] = seqs[indexed]
    keys[:, 1:][np.arange(DEPTH) < length[indexed][:, None]] += 1  # 0: the sequence has ended
    indexed = indexed[np.argsort(np.ascontiguousarray(keys).view(f"S{4 * DEPTH + 4}").ravel(), kind="stable")]
    m, rest, size = length[indexed], n[indexed] - i[indexed] - 1, n[indexed]
    g = group[indexed]
    node = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
    roots = g[np.concatenate(([True], g[1:] != g[:-1]))]
    at = np.searchsorted(roots, group[probes])
    hit = (at < len(roots)) & (roots[np.minimum(at, len(roots) - 1)] == group[probes])
    probes, at = probes[hit], at[hit]
    flat = (np.repeat(np.arange(len(n)), length) << 17) | seqs[np.arange(DEPTH) < length[:, None]]  # sorted: row, then shingle
    base = np.cumsum(length) - length
    # levels of the trie: first row of each node, first child of each node, shingle on the way to it
    levels, d = [], 0
    live = np.ones(len(indexed), bool)
    while live.any() and d <= DEPTH:
        key = np.where(m > d, seqs[indexed, min(d, DEPTH - 1)].astype(np.int64), -1)
        change = np.concatenate(([True], (node[1:] != node[:-1]) | (key[1:] != key[:-1])))
        child = np.cumsum(change) - 1
        first = np.flatnonzero(change)
        parents = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        low = np.concatenate((child[parents], [len(first)]))
        levels.append((np.append(first, len(indexed)), low, key[first], np.maximum.reduceat(rest, first), np.minimum.reduceat(size, first), np.maximum.reduceat(size, first)))
        node, live, d = child, m > d, d + 1
    out_x, out_y = [], []

    def keep(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, o: np.ndarray, left: np.ndarray, depth: int) -> None:
        """All rows lo..hi-1 below a node against probe x, each by its own length."""
        owner, y = _spread(lo, hi - lo)
        px, ny = x[owner], size[y]
        nx = n[px]
        row = indexed[y]
        ok = (o[owner] + np.minimum(left[owner], rest[y] - depth) >= need(nx, ny)) & ((ny < nx) | ((ny == nx) & (ident[row] < ident[px]))) & (ny * den >= nx * num)
        out_x.append(px[ok])
        out_y.append(row[ok])

    stack = [(0, probes, at, np.ones(len(probes), np.int64), np.zeros(len(probes), np.int64))]
    while stack:
        d, x, v, o, a = stack.pop()
        first, low, key, most, least, longest = levels[d]
        sizes = low[v + 1] - low[v]
        if len(x) > 1 and sizes.sum() > FRONTIER:
            h = max(1, min(len(x) - 1, int(np.searchsorted(np.cumsum(sizes), sizes.sum() // 2))))
            stack += [(d, x[h:], v[h:], o[h:], a[h:]), (d, x[:h], v[:h], o[:h], a[:h])]
            continue
        owner, c = _spread(low[v], sizes)
        x, o, a = x[owner], o[owner], a[owner]
        nx, k = n[x], key[c]
        total = nx - i[x] - 1
        good = (least[c] <= nx) & (longest[c] * den >= nx * num) & (o + np.minimum(total - a, most[c] - d) >= need(nx, least[c]))
        x, o, a, c, k, total = x[good], o[good], a[good], c[good], k[good], total[good]
        place = np.searchsorted(flat, (x << 17) | np.maximum(k, 0)) - base[x]
        a1 = np.where(k >= 0, np.maximum(a, place), a)
        stop = (k < 0) | (a1 >= length[x])  # either sequence has ended here: what follows isn't known
        if stop.any():
            s = np.flatnonzero(stop)
            keep(x[s], first[c[s]], first[c[s] + 1], o[s], np.where(k[s] < 0, total[s] - a[s], total[s] - length[x[s]]), d)
            go = ~stop
            x, o, a1, c, k, total = x[go], o[go], a1[go], c[go], k[go], total[go]
        match = seqs[x, np.minimum(a1, DEPTH - 1)] == k
        o, a = o + match, a1 + match
        good = o + np.minimum(total - a, most[c] - d - 1) >= need(n[x], least[c])
        if good.any():
            stack.append((d + 1, x[good], c[good], o[good], a[good]))
    return (np.concatenate(out_x), np.concatenate(out_y)) if out_x else (np.empty(0, np.int64), np.empty(0, np.int64))


def _unpack(t: pa.Table) -> dict[str, np.ndarray]:
    seq = t["seq"].combine_chunks()
    if isinstance(seq, pa.ChunkedArray):
        seq = pa.concat_arrays(seq.chunks) if seq.num_chunks else pa.array([], pa.binary())
    off = np.frombuffer(seq.buffers()[1], np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
    data = np.frombuffer(seq.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    tok, head, meta = t["tok"].to_numpy(), t["head"].to_numpy(), t["meta"].to_numpy()
    rows, length = unpacked(tok >> SHORT, off - off[0], data)
    ids = np.frombuffer(b"".join(t["id"].to_pylist()), np.dtype((np.void, ID_BYTES)))
    return {"tok": tok, "block": head >> 2, "role": head & 3, "n": meta >> 32, "i": meta & 0xFFFFFFFF, "id": ids, "seq": rows, "len": length}


def _walk_rows(parts: dict[str, np.ndarray], num: int, den: int) -> pa.RecordBatch | None:
    change = np.concatenate(([True], (parts["tok"][1:] != parts["tok"][:-1]) | (parts["block"][1:] != parts["block"][:-1])))
    group = np.cumsum(change) - 1
    many = np.bincount(group)[group] > 1
    p = {k: v[many] for k, v in parts.items()}
    if not many.any():
        return None
    ident = np.unique(p["id"], return_inverse=True)[1]
    x, y = trie_walk(group[many], p["n"], p["i"], p["role"], ident, p["seq"], p["len"], num, den)
    if not len(x):
        return None
    pair = np.unique(np.stack((ident[x], ident[y]), 1), axis=0, return_index=True)[1]
    name = lambda rows: pa.array([r.tobytes() for r in p["id"][rows]], pa.binary())
    return pa.RecordBatch.from_arrays([name(x[pair]), name(y[pair])], ["x", "y"])


def walk_partition(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of tok, block, role: whole groups are walked together; of a group that doesn't
    end, only the indexed rows (which come first, and are bounded) are held while probes stream by."""
    held: dict[str, np.ndarray] | None = None
    join = lambda a, b: {k: np.concatenate((a[k], b[k])) for k in b} if a is not None else b
    for b in batches:
        if not b.num_rows:
            continue
        held = join(held, _unpack(pa.Table.from_batches([b])))
        if len(held["tok"]) < HELD:
            continue
        last = (held["tok"] == held["tok"][-1]) & (held["block"] == held["block"][-1])
        if not last.all():
            if (out := _walk_rows({k: v[~last] for k, v in held.items()}, num, den)) is not None:
                yield out
            held = {k: v[last] for k, v in held.items()}
        elif (held["role"] == 1).any():
            if (out := _walk_rows(held, num, den)) is not None:
                yield out
            held = {k: v[held["role"] != 1] for k, v in held.items()}
    if held is not None and (out := _walk_rows(held, num, den)) is not None:
        yield out


def identity(content: str) -> Column:
    """The first 80 bits of a content's md5."""
    return F.unhex(F.substring(F.md5(content), 1, 2 * ID_BYTES))


def similar_contents(df: DataFrame, content: str = "content", num: int = 7, den: int = 10, k: int = 3, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(x, y): identities of each two different contents with Jaccard similarity >= num/den of their k-word sets."""
    spark = df.sparkSession
    sketch = corpus_sketch(df, content, k, sketch_bits)
    shared, hot_from = spark.sparkContext.broadcast(zlib.compress(sketch.tobytes(), 1)), hot_class(sketch)
    whole = df.select(identity(content).alias("id"), F.col(content).alias("content")).where(F.col("content").isNotNull() & F.col("id").isNotNull())  # as the joins below ask, so that all share one exchange
    whole = whole.groupBy("id").agg(F.first("content").alias("content"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for start, texts in blocks(b.column(1).to_pylist()):
                yield prefix_rows(ids[start : start + len(texts)], texts, k, num, den, _opened(shared.value), hot_from)

    rows = whole.mapInArrow(emit, "tok long, head int, meta long, id binary, seq binary")
    rows = rows.repartition("tok", F.shiftright("head", 2)).sortWithinPartitions("tok", "head", "meta")  # head: block, role; meta: length, position
    pairs = rows.mapInArrow(lambda batches: walk_partition(batches, num, den), "x binary, y binary").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, a, c = (b.column(j).to_pylist() for j in range(4))
            good = []
            for start, texts in blocks([t for two in zip(a, c) for t in two]):
                # blocks hold whole pairs: one that would be cut is compared by itself below
                h, doc = shingles(texts, k)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                for j in range(start % 2, len(texts) - 1, 2):
                    s, t = np.unique(h[cut[j] : cut[j + 1]]), np.unique(h[cut[j + 1] : cut[j + 2]])
                    o = len(np.intersect1d(s, t, assume_unique=True))
                    if o and (num + den) * o >= num * (len(s) + len(t)):
                        good.append((start + j) // 2)
                if start % 2:
                    j = start // 2
                    s, t = (np.unique(shingles([z], k)[0]) for z in (a[j], c[j]))
                    o = len(np.intersect1d(s, t, assume_unique=True))
                    if o and (num + den) * o >= num * (len(s) + len(t)):
                        good.append(j)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for j in good], pa.binary()), pa.array([y[j] for j in good], pa.binary())], ["x", "y"])

    left = pairs.join(whole.select(F.col("id").alias("x"), F.col("content").alias("cx")), "x")
    both = left.join(whole.select(F.col("id").alias("y"), F.col("content").alias("cy")), "y")
    return both.select("x", "y", "cx", "cy").mapInArrow(verify, "x binary, y binary")


def has_shingle(content: str, k: int) -> Column:
    """Whether a text has k words, as the JVM sees them; possessive, so that it takes one pass over any text."""
    word = r"\p{L}\p{N}"
    return F.col(content).rlike(f"^[^{word}]*+" + f"[{word}]++[^{word}]++" * (k - 1) + f"[{word}]")


def similar_classes(df: DataFrame, key: str, content: str = "content", num: int = 7, den: int = 10, k: int = 3, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(x, y): each two different contents that are similar; (id, key): the content of each row.

    Rows without a row here (null keys and contents, contents of fewer than k words) are similar to none.
    Repeated rows of one key are rows of equal content.
    """
    pairs = similar_contents(df, content, num, den, k, sketch_bits)
    rows = df.where(F.col(content).isNotNull() & has_shingle(content, k)).select(identity(content).alias("id"), F.col(key).alias("key"))
    return pairs, rows.where("id is not null and key is not null")


def expanded_pairs(pairs: DataFrame, members: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: keys of every two rows of similar or of equal content.

    Copies of a content are dealt into buckets of about `bucket` rows, and each two buckets meet by themselves, so that
    no group of copies is in one task whole.
    """
    salt = F.pmod(F.xxhash64("key"), F.lit(16))
    sizes = members.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").withColumn("n", F.ceil(F.col("c") / bucket).cast("int"))
    salted = sizes.select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    dealt = members.withColumn("salt", salt.cast("int")).join(salted, ["id", "salt"], "left").select("id", "key", "n", F.coalesce(F.pmod(F.xxhash64("key", F.lit(1)), F.col("n")).cast("int"), F.lit(0)).alias("own"))
    cells = dealt.where("n is not null").select("id", "key", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    cells = cells.select("id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key")
    left = cells.where("own = low").select("id", "low", "high", F.col("key").alias("p"))
    right = cells.where("own = high").select("id", "low", "high", F.col("key").alias("q"))
    same = left.join(right, ["id", "low", "high"]).where("p <> q and (low < high or p < q)").select("p", "q")
    buckets = lambda side: sizes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"))
    every = lambda side: F.explode(F.sequence(F.lit(0), F.coalesce(f"n{side}", F.lit(1)) - 1)).alias(f"b{side}")
    wide = pairs.join(buckets("x"), "x", "left").join(buckets("y"), "y", "left").select("x", "y", "ny", every("x")).select("x", "y", "bx", every("y"))
    member = lambda side, name: dealt.select(F.col("id").alias(side), F.col("own").alias(f"b{side}"), F.col("key").alias(name))
    apart = wide.join(member("x", "p"), ["x", "bx"]).join(member("y", "q"), ["y", "by"]).select("p", "q")
    return apart.unionByName(same).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def similar_rows(df: DataFrame, key: str, content: str = "content", num: int = 7, den: int = 10, k: int = 3) -> DataFrame:
    """(a, b), a < b: keys of every two rows whose contents are similar, equal contents included, a row per pair."""
    return expanded_pairs(*similar_classes(df, key, content, num, den, k))
