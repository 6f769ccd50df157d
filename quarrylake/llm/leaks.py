"""Evaluation texts leaking into a corpus, wholly or in part, verbatim or with small edits.

Texts are brought to one form (words in lower case, one blank between). By the q-gram lemma, a stretch of
L characters that equals another but for e edits shares at least L + 1 - q (e + 1) character q-grams with
it, all within e diagonals (place in the document less place in the item). Shared q-grams are counted in
overlapping bands of diagonals; regions of a band that reach the bound for the item's shortest passage of
13 words are aligned within the band. The alignment gives the least edits and the longest run of whole words
without one: a run of 13 words, or so many characters with an edit, is a leak.

Items are the stated query set: their q-gram table goes to every task in blocks of about BLOCK characters
(some 13,000 items of 300), and each block reads the corpus once, so the table's size is bounded whatever
their number. Documents stay where they are, whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.wordhash import TOP, blocks, mix, tables

Q = 12
BLOCK = 4_000_000  # characters of the items of a block: its table takes 16 bytes a character
EDITS = 1  # edits that a passage may hold
EDITED = 40  # characters from which it may
WORDS = 13
FILTER_BITS = 22
HITS = 2_000_000  # shared q-grams looked at together


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, words in lower case parted by single 0s; start of each text). Each text ends with 0."""
    is_word, lower = tables()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.where(raw < TOP, raw, 0)
    codes = np.where(is_word[raw], lower[raw], 0).astype(np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    last = np.zeros(len(codes), bool)
    last[ends - 1] = True
    keep = (codes != 0) | np.concatenate(([True], codes[:-1] != 0)) | last
    keep[:-1] &= ~((codes[:-1] == 0) & last[1:] & ~last[:-1] & (codes[1:] == 0))  # the end's own 0 is enough
    at = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], np.concatenate(([0], at[ends]))


def qgrams(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = np.uint64(0x9E3779B97F4A7C15)
    one = codes.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * b + one[1:]
    four = two[:-2] * b**2 + two[2:]
    eight = four[:-4] * b**4 + four[4:]
    h = eight[:n] * b**4 + four[8 : 8 + n]  # Q = 12 = 8 + 4
    return mix(h)


class Items:
    """The q-gram table of a block of items."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        self.codes, self.starts = plain(texts)
        h = qgrams(self.codes)
        item = np.searchsorted(self.starts, np.arange(len(h)), side="right") - 1
        inside = np.arange(len(h)) + Q <= self.starts[item + 1] if len(h) else np.empty(0, bool)
        h, self.where = h[inside], np.flatnonzero(inside)
        order = np.argsort(h, kind="stable")
        self.hash, self.where = h[order], self.where[order]
        self.least, self.longest, self.edits = self._runs()
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True


    def _runs(self) -> tuple[np.ndarray, int, np.ndarray]:
        """(characters of each item's shortest run of WORDS words, of the longest of all, edits allowed); items of fewer words have no run."""
        least, longest = np.full(len(self.ids), 1 << 40, np.int64), 0
        for t in range(len(self.ids)):
            own = np.append(0, self.codes[self.starts[t] : self.starts[t + 1]])
            parts = np.flatnonzero(own == 0)
            if len(parts) > WORDS:
                sizes = parts[WORDS:] - parts[:-WORDS]
                least[t], longest = sizes.min() - 1, max(longest, int(sizes.max()))
        return least, longest, np.where(least >= EDITED, EDITS, 0)


def regions(items: Items, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (document, item, band, first, last place in the document, shared q-grams) that meet the bound."""
    h = qgrams(codes)
    at = np.flatnonzero(items.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    lo, hi = np.searchsorted(items.hash, h[at], "left"), np.searchsorted(items.hash, h[at], "right")
    hit = hi > lo
    at, lo, hi = at[hit], lo[hit], hi[hit]
    # windows of the text with a bounded number of hits; they overlap by more than a passage, so that each lies wholly in one
    overlap, total, out, s = items.longest + 2 * Q, np.cumsum(hi - lo), [], 0
    while s < len(at):
        e = int(np.searchsorted(total, (total[s - 1] if s else 0) + HITS, side="right"))
        e = max(e, int(np.searchsorted(at, at[s] + 2 * overlap)))
        out.append(_regions(items, starts, at[s:e], lo[s:e], hi[s:e]))
        if e >= len(at):
            break
        s = int(np.searchsorted(at, at[e] - overlap))  # a passage that is not whole here holds at[e] or begins after it
    return np.concatenate(out) if out else np.empty((0, 6), np.int64)


def _regions(items: Items, starts: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    place = np.repeat(at, hi - lo)
    where = items.where[np.repeat(lo, hi - lo) + np.arange(len(place)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    doc = np.searchsorted(starts, place, side="right") - 1
    inside = place + Q <= starts[doc + 1]
    place, where, doc = place[inside], where[inside], doc[inside]
    item = np.searchsorted(items.starts, where, side="right") - 1
    diagonal = place - where
    bound = np.maximum(items.least + 1 - Q * (items.edits + 1), 1)
    width = 2 * (EDITS + 1)
    out = []
    for shift in (0, EDITS + 1):  # two sets of bands, each half over the other, so that any EDITS diagonals share one
        band = (diagonal + shift) // width
        order = np.lexsort((place, band, item, doc))
        d, t, b, p = doc[order], item[order], band[order], place[order]
        if not len(d):
            continue
        # a region is a run of hits of one document, item and band without a gap longer than an edit leaves
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (p[1:] - p[:-1] > Q + EDITS)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1
        distinct = np.add.reduceat(np.concatenate(([True], new[1:] | (p[1:] != p[:-1]))).astype(np.int64), first)
        good = distinct >= bound[t[first]]
        f, e = first[good], last[good]
        out.append(np.stack((d[f], t[f], b[f] * width - shift, p[f], p[e] + Q, distinct[good]), 1))
    return np.concatenate(out) if out else np.empty((0, 6), np.int64)


def banded(text: np.ndarray, first: np.ndarray, size: np.ndarray, other: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Alignment of text[first:first+size] with the best-placed stretch of other[start:start+count], for each region:
    (least edits, most consecutive whole words that it matches without an edit).

    The first and the last character of a region are what stands beside it: they end words, but cost nothing.
    Only the diagonals offset..offset+width-1 (place in the other less place in the text) are filled in; a run of
    words lies on one of them. All regions advance together, a character a step, the longer ones longer.
    """
    order = np.argsort(-size, kind="stable")
    first, start, count, offset, size = first[order], start[order], count[order], offset[order], size[order]
    running = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # regions longer than i
    row = np.zeros((len(order), width), np.int64)
    run, most = np.zeros((len(order), width), np.int32), np.zeros((len(order), width), np.int32)
    state = np.zeros((len(order), width), np.int8)  # of the current word: 1 begins here, 2 has matched so far, 0 has not
    step = np.arange(width)
    far = int(size.max(initial=0)) + 1
    for i, k in enumerate(running.tolist()):
        j = i + offset[:k, None] + step
        inside = (j >= 0) & (j < count[:k, None])
        char = text[first[:k] + i][:, None]
        same = inside & (other[np.where(inside, start[:k, None] + j, 0)] == char)
        between, own = same & (char == 0), state[:k]
        run[:k] = np.where(same, run[:k] + (between & (own == 2)), 0) * ((own > 0) | ~between)
        state[:k] = np.where(between, 1, np.where(same & (own > 0), 2, 0))
        np.maximum(most[:k], run[:k], out=most[:k])
        if i == 0:
            continue
        old = row[:k]
        skip = np.full_like(old, far)
        skip[:, :-1] = old[:, 1:] + 1
        cost = np.minimum(np.where(inside, old + ~same, far), skip)
        cost = np.minimum.accumulate(cost - step, axis=1) + step  # a character of the other left out
        row[:k] = np.where((i < size[:k] - 1)[:, None], cost, old)
    out, words = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    out[order], words[order] = row.min(1), most.max(1)
    return out, words


def leaks_in(items: Items, texts: list[str]) -> list[tuple[int, int, bool, int, int]]:
    """(document, item, whether WORDS words in a row are the same, characters, edits) of each leak."""
    codes, starts = plain(texts)
    width = 2 * (EDITS + 1)
    found = regions(items, codes, starts)
    if not len(found):
        return []
    doc, item, band, first, last, _ = found.T
    # with a separator before everything, so that each region has a neighbour on its left
    text, other = np.append(np.uint32(0), codes), np.append(np.uint32(0), items.codes)
    a, b = first, np.minimum(last + 1, starts[doc + 1]) + 1  # in text: the region and what stands beside it
    low, high = np.maximum(items.starts[item], a - band - width), np.minimum(items.starts[item + 1] + 1, b - band + width)
    edits, words = banded(text, a, b - a, other, low, np.maximum(high - low, 0), a - band - (width - 1) - low, width)
    exact = words >= WORDS
    near = (edits <= EDITS * np.maximum(1, (last - first) // items.least[item])) & (last - first >= items.least[item] - Q)
    # to whole words on either side
    gaps = np.flatnonzero(codes == 0)
    at = np.searchsorted(gaps, first, side="right") - 1
    begin = np.maximum(starts[doc], np.where(at >= 0, gaps[at], 0))
    end = np.minimum(starts[doc + 1], gaps[np.searchsorted(gaps, last - 1)] + 1)
    rows = np.flatnonzero(exact | near)
    rows = rows[np.lexsort((-edits[rows], (end - begin)[rows], exact[rows], item[rows], doc[rows]))]
    best = rows[np.append((doc[rows][1:] != doc[rows][:-1]) | (item[rows][1:] != item[rows][:-1]), True)] if len(rows) else rows
    return list(zip(doc[best].tolist(), item[best].tolist(), exact[best].tolist(), (end - begin)[best].tolist(), edits[best].tolist()))


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc_key, item_key, exact, characters, edits) of every document and the items that leaked into it.

    exact: some 13 consecutive words of the item stand in the document as they are; rows without are
    regions with edits. Null and empty texts leak nothing; repeated items or documents report each row.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(text).alias("text"))
    dk, ik = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc {dk}, item {ik}, exact boolean, characters int, edits int"
    query = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("t"))
    parts = max(1, -(-(query.agg(F.sum(F.length("t"))).first()[0] or 0) // BLOCK))
    found = None
    for k in range(parts):
        block = query.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).toArrow() if parts > 1 else query.toArrow()
        shared = spark.sparkContext.broadcast((block["item"].to_pylist(), block["t"].to_pylist()))
        one = rows.mapInArrow(_finder(shared, uuid.uuid4().hex), schema)
        found = one if found is None else found.unionByName(one)
    return found.withColumnsRenamed({"doc": doc_key, "item": item_key})


_tables: dict = {}


def _finder(shared, mark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        if _tables.get("mark") != mark:
            _tables.update(mark=mark, items=Items(ids, texts))
        items = _tables["items"]
        for b in batches:
            keys = b.column(0).to_pylist()
            for start, block in blocks(b.column(1).to_pylist()):
                got = leaks_in(items, block)
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[start + d] for d, *_ in got], b.column(0).type), pa.array([items.ids[t] for _, t, *_ in got]), pa.array([g[2] for g in got]), pa.array([g[3] for g in got], pa.int32()), pa.array([g[4] for g in got], pa.int32())],
                        ["doc", "item", "exact", "characters", "edits"],
                    )

    return run
