"""Noise in the text of scanned pages: found and repaired.

Four traces are told apart. A word cut at a line end by a dividing mark is put together where the
corpus knows the whole word better than the compound. Misread characters are found through glyph
skeletons: every word is rewritten into strokes that look alike (rn = m, cl = d, 0 = o ...), words of
one skeleton form a group, and a form that is rare beside its group's frequent form is a misreading of
it. Where several forms of a group are known words, the neighbouring words choose among them at each
place, and a rare form that stands often enough beside words of its own is a word. Running headers are edge
lines whose skeleton, digits masked, recurs at the edge of another page of the file. Page numbers are edge
lines that hold a number and nothing else. Word statistics cover every chunk of the corpus, pages or not.

Word counts are combined map-side, the vocabulary is joined by skeleton, headers by file and skeleton. No
group is held whole; a page's lines are the largest unit. Texts are cut into words in numpy arrays, a block
of texts at a time. Which forms and which pairs of neighbours matter is known from the vocabulary and the
pages; bit tables of a fixed size, all that reaches the driver, spare all other places of the corpus the
shuffle (a full table would only let more through to the exact joins). The vocabulary
and the pages' bodies are written to the shared folder once, as several parts of the plan read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm.wordhash import TOP, blocks, mix, run_hashes, tables
from quarrylake.session import written

# Glyphs that scanners confuse, as strokes. Letters on the left read alike.
ALIKE = [("l1!|", "i"), ("c", "e"), ("a0", "o"), ("v", "y"), ("5$", "s"), ("q9", "g"), ("f+", "t"), ("2", "z")]
STROKES = [("m", "rn"), ("n", "ri"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("h", "li"), ("b", "li"), ("8", "li"), ("6", "li")]
DIVIDERS = "-­‐‑¬"  # hyphen-minus, soft hyphen, hyphen, no-break hyphen, not sign
OUTER = ".,;:\"'()?!…“”‘’[]«»¿¡–—*"  # stripped from words, but for a final ! inside a skeleton

#: A form is misread if its group's best form is at least so many times as frequent; the second figure
#: holds for forms with a digit or sign among their letters.
RATIO, MIXED_RATIO = 12, 2
SEEN = 3  # chunks from which a form may be a word of its own
BITS = 21  # a bit table has 2**BITS, whatever the corpus
BREAK = "¶"  # stands between paragraphs, where no neighbour is
BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)
OUTER_CODES = np.array([ord(c) for c in OUTER], np.uint32)
EDGE = 3  # lines from the top and from the bottom that may be header or page number

_PART = r"[\p{L}\p{N}][\p{L}\p{N}'’!|+$\-]{0,63}"  # bounded, so that a text without blanks takes one pass
CUT = rf"({_PART})[{DIVIDERS}][ \t]*\r?\n[ \t]*({_PART})"
JOINT = rf"[{DIVIDERS}](?<=[\p{{L}}\p{{N}}][!|+$'’\-]{{0,8}}[{DIVIDERS}])[ \t]*\r?\n[ \t]*(?=[\p{{L}}\p{{N}}])"  # the same without the words beside it
MIXED = r"\p{L}[0-9!|+$]|[0-9!|+$]\p{L}"
# Words before and within printed page numbers, compared by skeleton.
PAGE_WORDS, OF_WORDS = ["page", "p", "pg", "seite", "página", "strona", "стр"], ["of", "von", "de", "sur", "z", "из"]
# Styles of printed page numbers; a digit may be misread as a letter.
NUMBER = (
    r"(?i)^\W*(?:(\p{L}[\p{L}\d!|+$]{0,7})\W{0,3})??(?:\d[\dOolI!]{0,5}|[OolI!]{1,2}\d{1,5}|[ivxl]{1,7})"
    r"(?:\s*(/|[\p{L}\d+]{1,4})\s*[\dOolI!]{1,6})?\W*$"
)
DIGITS = r"(?<![\p{L}\p{N}])[OolI!]{0,4}\d[\dOolI!]*(?![\p{L}\p{N}])"


def skeleton(word: Column) -> Column:
    """A word's strokes: equal for words that a scanner may take for each other."""
    x = F.lower(word)
    for a, b in STROKES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.translate(x, "".join(a for a, _ in ALIKE), "".join(b * len(a) for a, b in ALIKE))


def is_number(line: Column) -> Column:
    """Whether a line holds a page number and nothing else."""
    like = lambda word, known: skeleton(word).isin([stroked(w) for w in known])
    pre, mid = F.regexp_extract(line, NUMBER, 1), F.regexp_extract(line, NUMBER, 2)
    return line.rlike(NUMBER) & ((pre == "") | like(pre, PAGE_WORDS)) & (mid.isin("", "/") | like(mid, OF_WORDS))


def stroked(word: str) -> str:
    """skeleton() of a word known here."""
    x = word.lower()
    for a, b in STROKES:
        x = x.replace(a, b)
    return x.translate({ord(c): b for a, b in ALIKE for c in a})


def masked(line: Column) -> Column:
    """A line without the numbers at either end, other numbers as #."""
    return F.regexp_replace(F.regexp_replace(line, DIGITS, "#"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def bare(word: Column) -> Column:
    return F.btrim(word, F.lit(OUTER))


def pages_of(chunks: DataFrame, page: Column) -> DataFrame:
    """Pages with their lines: those between the edges, and the edges themselves with their place."""
    lines = F.split("content", r"\r\n|\n|\r")
    return chunks.where(page & F.col("content").isNotNull()).select("chunk_key", "file_path", "chunk_index", "content", lines.alias("lines"))


def edges(pages: DataFrame) -> DataFrame:
    """(chunk_key, file_path, chunk_index, pos, bottom, depth, line): the EDGE outermost lines of each page."""
    filled = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda s: F.trim(s["line"]) != "")
    at = pages.select("chunk_key", "file_path", "chunk_index", filled.alias("f"))
    side = lambda bottom, a: F.transform(F.slice(a, 1, EDGE), lambda s, i: F.struct(F.lit(bottom).alias("bottom"), i.alias("depth"), s["pos"].alias("pos"), s["line"].alias("line")))
    both = F.concat(side(False, F.col("f")), side(True, F.reverse("f")))
    return at.select("chunk_key", "file_path", "chunk_index", F.inline(both))


def edge_kinds(pages: DataFrame) -> DataFrame:
    """(chunk_key, marks): each page's edge lines that are header or page number, as (pos, kind, line).

    From either side lines count as long as they are one or the other; the first that is neither ends it.
    """
    line = F.trim("line")
    title = masked(line)
    e = edges(pages).select("*", is_number(line).alias("number"), F.when(title.rlike(r"\p{L}{2}"), skeleton(title)).alias("key"))
    seen = e.where("key is not null and not number").groupBy("file_path", "key").agg(F.min("chunk_index").alias("a"), F.max("chunk_index").alias("b")).where("a < b")
    found = e.join(seen.select("file_path", "key", F.lit(True).alias("again")), ["file_path", "key"], "left")
    kind = F.when(F.col("number"), "page_number").when(F.col("again"), "header")
    side = F.sort_array(F.collect_set(F.struct("bottom", "depth", "pos", kind.alias("kind"), "line")))
    whole = found.groupBy("chunk_key").agg(side.alias("e"))

    def outer(bottom: bool) -> Column:
        own = F.filter("e", lambda s: s["bottom"] == F.lit(bottom))
        stop = F.array_min(F.transform(F.filter(own, lambda s: s["kind"].isNull()), lambda s: s["depth"]))
        return F.filter(own, lambda s: s["depth"] < F.coalesce(stop, F.lit(EDGE)))

    marks = F.array_distinct(F.transform(F.concat(outer(False), outer(True)), lambda s: F.struct(s["pos"].alias("pos"), s["kind"].alias("kind"), s["line"].alias("line"))))
    return whole.select("chunk_key", marks.alias("marks"))


def bodies(pages: DataFrame) -> DataFrame:
    """(chunk_key, marks, body, headers): text without edge marks, and the header lines without numbers."""
    marked = pages.join(edge_kinds(pages), "chunk_key", "left").select("chunk_key", "lines", F.coalesce("marks", F.array()).alias("marks"))
    out = F.transform("marks", lambda m: m["pos"])
    body = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains(out, i)), "\n")
    heads = F.transform(F.filter("marks", lambda m: m["kind"] == "header"), lambda m: F.regexp_replace(m["line"], DIGITS, ""))
    return marked.select("chunk_key", "marks", body.alias("body"), F.array_join(heads, "\n").alias("heads"))


class Words:
    """The words of many texts: runs without blanks, in lower case, without OUTER signs at either end."""

    def __init__(self, texts: list[str]):
        _, lower = tables()
        raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.where(raw < len(lower), lower[np.minimum(raw, len(lower) - 1)], raw)
        blank = np.isin(raw, BLANKS)
        edge = np.diff((~blank).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        solid = np.flatnonzero(~blank & ~np.isin(raw, OUTER_CODES))
        of = np.searchsorted(begin, solid, side="right") - 1
        self.first, self.last = begin.copy(), begin.copy()  # a word of signs alone is empty
        self.last[of] = solid + 1
        self.first[of[::-1]] = solid[::-1]
        self.text = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), begin, side="right")
        self.hash = run_hashes(np.minimum(self.codes, TOP - 1), np.arange(TOP, dtype=np.uint32), self.first, self.last)

    def strings(self, words: np.ndarray) -> list[str]:
        a, b, c = self.first[words].tolist(), self.last[words].tolist(), self.codes
        return [c[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in zip(a, b)]

    def beside(self, words: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(the next or previous word of each, whether there is one in the same text)."""
        at = words + step
        near = np.clip(at, 0, len(self.first) - 1)
        return near, (at == near) & (self.text[near] == self.text[words])


def _hash_of(words: list[str]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return run_hashes(np.minimum(codes, TOP - 1), np.arange(TOP, dtype=np.uint32), ends - [len(w) for w in words], ends)


def _pair(side: int, word: np.ndarray, other: np.ndarray) -> np.ndarray:
    return mix(word * np.uint64(0xF1357AEA2E62A9C5) + other * np.uint64(0x9FB21C651E98DF25) + np.uint64(side))


NO_WORD = _hash_of([BREAK])[0]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def counted_words(texts: DataFrame) -> DataFrame:
    """(form, n): words of the only column, and the number of its rows in which they stand; in parts to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, block in blocks(b.column(0).to_pylist()):
                w = Words(block)
                if not len(w.hash):
                    continue
                own = (w.hash >> np.uint64(12) << np.uint64(12)) | w.text.astype(np.uint64)  # at most 4096 texts
                each, at = np.unique(own, return_index=True)
                cut = np.flatnonzero(np.concatenate(([True], each[1:] >> np.uint64(12) != each[:-1] >> np.uint64(12))))
                yield pa.RecordBatch.from_arrays([pa.array(w.strings(at[cut]), pa.string()), pa.array(np.diff(np.append(cut, len(each))).astype(np.int64))], ["form", "n"])

    return texts.mapInArrow(run, "form string, n long")


def forms_of(chunks: DataFrame, page: Column) -> DataFrame:
    """(s, form, n, most, good, several, doubtful): every form of the corpus beside its skeleton's most frequent.

    A word counts once per chunk. On pages, words cut at a line end count as put together. good: not rare
    beside the most frequent. several: two or more good forms of the skeleton, without digits and signs, stand in
    SEEN chunks or more. doubtful: a rare form that does so beside only one such.
    """
    counts = counted_words(chunks.where(F.col("content").isNotNull()).select(joined(page).alias("t")))
    forms = counts.groupBy("form").agg(F.sum("n").alias("n")).where(F.col("form").rlike(r"\p{L}"))
    w = Window.partitionBy("s")
    of = forms.select(skeleton(F.col("form")).alias("s"), "form", "n").withColumn("most", F.max("n").over(w))
    of = of.withColumns({"good": F.col("n") * ratio() > F.col("most"), "word": (F.col("n") >= SEEN) & ~F.col("form").rlike(MIXED)})
    several = F.sum((F.col("good") & F.col("word")).cast("int")).over(w) > 1
    return of.withColumn("several", several).withColumn("doubtful", ~F.col("good") & F.col("word") & ~F.col("several")).drop("word")


def joined(page: Column) -> Column:
    return F.when(page, F.regexp_replace("content", JOINT, "")).otherwise(F.col("content"))


def ratio() -> Column:
    return F.when(F.col("form").rlike(MIXED), MIXED_RATIO).otherwise(RATIO)


def vocabulary(forms: DataFrame) -> DataFrame:
    """(s, best, n): each skeleton's most frequent form."""
    return forms.groupBy("s").agg(F.max(F.struct("n", "form")).alias("b")).select("s", F.col("b.form").alias("best"), F.col("b.n").alias("n"))


def bit_table(words: DataFrame) -> np.ndarray:
    """Which slots of 2**BITS are taken: by the words of a column, or with two columns by (word, word to its left)
    and with three by (word, word to its left) and (word, word to its right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for b in batches:
            if b.num_rows:
                h = [_hash_of(c.to_pylist()) for c in b.columns]
                for x in h if len(h) == 1 else [_pair(side, h[0], h[side + 1]) for side in range(len(h) - 1)]:
                    bits[_slot(x)] = True
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    got = words.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.int64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def places(df: DataFrame, text: Column, forms: np.ndarray, pairs: np.ndarray | None = None, key: str | None = None) -> DataFrame:
    """(key, form, l, r): different places of the words in the bit table `forms`, with the words beside them; with
    a second table, of those that hold a pair in it. Places repeated in other tasks are for the caller to unite."""
    shared = df.sparkSession.sparkContext.broadcast((np.packbits(forms), None if pairs is None else np.packbits(pairs)))
    own = "" if key is None else f"{key} {df.schema[key].dataType.simpleString()}, "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, paired = (None if x is None else np.unpackbits(x).view(bool) for x in shared.value)
        for b in batches:
            keys = None if key is None else b.column(1)
            for start, block in blocks(b.column(0).to_pylist()):
                w = Words(block)
                at = np.flatnonzero(wanted[_slot(w.hash)])
                (l, has_l), (r, has_r) = w.beside(at, -1), w.beside(at, 1)
                hl, hr = np.where(has_l, w.hash[l], NO_WORD), np.where(has_r, w.hash[r], NO_WORD)
                if paired is not None:
                    hit = paired[_slot(_pair(0, w.hash[at], hl))] | paired[_slot(_pair(1, w.hash[at], hr))]
                    at, l, r, has_l, has_r, hl, hr = (x[hit] for x in (at, l, r, has_l, has_r, hl, hr))
                h = _pair(1, _pair(0, w.hash[at], hl), hr)
                if keys is not None:
                    h = _pair(2, h, w.text[at].astype(np.uint64))
                one = np.unique(h, return_index=True)[1]
                at, l, r, has_l, has_r = (x[one] for x in (at, l, r, has_l, has_r))
                side = lambda x, has: pa.array([s if ok else BREAK for s, ok in zip(w.strings(x), has.tolist())], pa.string())  # noqa: B023, E731
                cols = [pa.array(w.strings(at), pa.string()), side(l, has_l), side(r, has_r)]
                named = ["form", "l", "r"]
                if keys is not None:
                    cols, named = [keys.take(pa.array(start + w.text[at])), *cols], [key, *named]
                yield pa.RecordBatch.from_arrays(cols, named)

    return df.select(text.alias("__text"), *([] if key is None else [key])).mapInArrow(run, own + "form string, l string, r string")


def told_by_context(chunks: DataFrame, page: Column, found: DataFrame, forms: DataFrame) -> DataFrame:
    """(chunk_key, form, l, r, best): places of `found` that are misread where context decides, with the form that belongs there.

    It decides for all forms of a group with several good ones, and for doubtful forms. A form is supported at a
    place by the number of different places in the corpus where it follows the same word, and of those where it
    precedes the same word, the place itself left out, and by its share of the group's chunks. A misread place
    takes the good form of most support. A rare form is a word of its own where SEEN - 1 other places support it and
    none a good form, or on one side it outweighs the good forms as RATIO says; else it is misread. A good form is misread if another
    good form outweighs it so on either side.
    """
    asked = forms.where("several or doubtful")
    choices = forms.where("good").groupBy("s").agg(F.collect_list(F.struct("form", "n")).alias("choices"))
    group = asked.join(choices, "s").select("form", "good", "most", "n", "choices", "several", ratio().alias("ratio"))
    here = found.join(asked.select("form"), "form", "left_semi").select("chunk_key", "form", "l", "r").distinct()
    tried = written(here.select("form", "l", "r").distinct().join(group, "form"))
    # of the other forms of the groups, only the places beside the same words are needed
    other = tried.select(F.explode("choices.form").alias("g"), "l", "r")
    wanted = bit_table(asked.select("form")) | bit_table(other.select("g"))
    pairs = bit_table(other.select("g", "l", "r").unionByName(tried.select(F.col("form").alias("g"), "l", "r")))
    seen = places(chunks.where(F.col("content").isNotNull()), joined(page), wanted, pairs).distinct()
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("w")), F.struct(F.lit(1).alias("side"), F.col("r").alias("w")))
    beside = seen.select(F.col("form").alias("g"), F.inline(sides)).groupBy("g", "side", "w").agg(F.count("*").alias("n"))
    own = F.struct("form", "n")
    tried = tried.select("form", "l", "r", "good", "ratio", F.explode(F.array_union("choices", F.array(own))).alias("x"), "most").select("*", F.col("x.form").alias("g"), (F.col("x.n") / F.col("most")).alias("share")).drop("x")
    both = tried.select("*", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("w")), F.struct(F.lit(1).alias("side"), F.col("r").alias("w")))))
    counted = both.join(beside.withColumnRenamed("n", "places"), ["g", "side", "w"], "left")
    of = lambda k: F.coalesce(F.max(F.when(F.col("side") == k, F.col("places"))), F.lit(0))
    counted = counted.groupBy("form", "l", "r", "g").agg(F.first("good").alias("good"), F.first("ratio").alias("ratio"), F.first("share").alias("share"), of(0).alias("a"), of(1).alias("b"))
    mine = F.col("g") == F.col("form")
    less = lambda c: F.when(mine, F.greatest(F.col(c) - 1, F.lit(0))).otherwise(F.col(c))
    known = counted.withColumns({"a": less("a"), "b": less("b")}).withColumn("support", F.col("a") + F.col("b") + F.col("share"))
    side = F.struct("support", "a", "b", "share", "g")
    two = known.groupBy("form", "l", "r").agg(F.first("good").alias("good"), F.first("ratio").alias("ratio"), F.max(F.when(mine, side)).alias("f"), F.max(F.when(~mine, side)).alias("o")).where("o is not null")
    both = (F.col("o.a") > F.col("ratio") * (F.col("f.a") + F.col("f.share"))) & (F.col("o.b") > F.col("ratio") * (F.col("f.b") + F.col("f.share")))
    alone = lambda f, o: (f >= SEEN - 1) & (o * F.col("ratio") <= f)
    word = alone(F.col("f.a"), F.col("o.a")) | alone(F.col("f.b"), F.col("o.b")) | ((F.col("f.a") + F.col("f.b") >= SEEN - 1) & (F.col("o.a") + F.col("o.b") == 0))
    wrong = two.where(F.when(F.col("good"), both).otherwise(~word)).select("form", "l", "r", F.col("o.g").alias("best"))
    return here.join(wrong, ["form", "l", "r"]).select("chunk_key", "form", "l", "r", "best")


def cuts(body: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_key, left, right, whole): words cut at a line end; whole = they are one undivided word.

    The undivided word is taken unless the corpus has the compound more often. Where it has neither,
    the mark divides.
    """
    two = F.arrays_zip(F.regexp_extract_all("body", F.lit(CUT), F.lit(1)).alias("left"), F.regexp_extract_all("body", F.lit(CUT), F.lit(2)).alias("right"))
    c = body.where(F.col("body").rlike(JOINT)).select("chunk_key", F.explode(F.array_distinct(two)).alias("x")).select("chunk_key", F.lower("x.left").alias("left"), F.lower("x.right").alias("right"))
    tail = bare(F.col("right"))
    tries = c.select("*", F.explode(F.array(F.struct(F.lit(0).alias("how"), F.concat("left", tail).alias("form")), F.struct(F.lit(1).alias("how"), F.concat("left", F.lit("-"), tail).alias("form")))).alias("t"))
    tries = tries.select("chunk_key", "left", "right", "t.how", skeleton(F.regexp_replace("t.form", r"['’]s$", "")).alias("s"), F.col("t.form").alias("form"))
    n = tries.join(known.select("s", "n"), "s", "left").groupBy("chunk_key", "left", "right").agg(F.max(F.when(F.col("how") == 0, F.col("n"))).alias("one"), F.max(F.when(F.col("how") == 1, F.col("n"))).alias("two"))
    return n.select("chunk_key", "left", "right", (F.coalesce("one", F.lit(0)) >= F.coalesce("two", F.lit(0))).alias("whole"))


def misread(chunks: DataFrame, page: Column, body: DataFrame, forms: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk_key, form, best, l, r): words of body and header that are misread; l and r are null where a form is so at every place."""
    rare = forms.where("not good and not several and not doubtful")
    text = F.concat_ws(f"\n{BREAK}\n", F.regexp_replace(F.regexp_replace("body", JOINT, ""), r"\n[ \t\r]*(?=\n)", f"\n{BREAK}"), "heads")
    found = written(places(body, text, bit_table(forms.where("not good or several").select("form")), key="chunk_key"))
    none = F.lit(None).cast("string")
    plain = found.select("chunk_key", "form").distinct().join(rare.join(known.select("s", "best"), "s").select("form", "best"), "form").select("chunk_key", "form", "best", none.alias("l"), none.alias("r"))
    return plain.unionByName(told_by_context(chunks, page, found, forms))


def scan_traces(chunks: DataFrame, page: Column) -> DataFrame:
    """(chunk_key, kind): hyphen, misread, header, page_number, once for each page that has it.

    chunks needs chunk_key, file_path, chunk_index and content; `page` tells which rows are pages.
    Null and empty contents have no trace; a header needs another page (another chunk_index) of the
    same file_path, so repeated rows of one page aren't enough.
    """
    body = written(bodies(pages_of(chunks, page)))
    forms = written(forms_of(chunks, page))
    known = vocabulary(forms)
    kinds = F.array_distinct(F.transform("marks", lambda m: m["kind"]))
    return (
        body.select("chunk_key", F.explode(kinds).alias("kind"))
        .unionByName(cuts(body, known).where("whole").select("chunk_key", F.lit("hyphen").alias("kind")).distinct())
        .unionByName(misread(chunks, page, body, forms, known).select("chunk_key", F.lit("misread").alias("kind")).distinct())
    )


def repaired_pages(chunks: DataFrame, page: Column) -> DataFrame:
    """(chunk_key, text): each page's body as paragraphs, one line each, a blank line between them.

    Edge marks are gone, cut words are whole (compounds keep their hyphen), misread words are replaced
    by their group's best form in their own letter case. Lines are numbered into paragraphs by a running
    window over each page; blank lines part them. A page without body gives an empty text.
    """
    body = written(bodies(pages_of(chunks, page)))
    forms = written(forms_of(chunks, page))
    known = vocabulary(forms)
    w = Window.partitionBy("chunk_key").orderBy("pos")
    lines = body.select("chunk_key", F.posexplode(F.split("body", "\n")).alias("pos", "line")).select("chunk_key", "pos", F.rtrim("line").alias("line"))
    lines = lines.select(
        "*", F.sum((F.trim("line") == "").cast("int")).over(w).alias("para"),
        F.lower(F.regexp_extract("line", rf"({_PART})[{DIVIDERS}]$", 1)).alias("left"),
        F.lower(F.regexp_extract(F.lead("line").over(w), rf"^\s*({_PART})", 1)).alias("right"),
    ).where(F.trim("line") != "")
    decided = lines.join(cuts(body, known), ["chunk_key", "left", "right"], "left")
    cut = F.col("whole").isNotNull()
    bare_line = F.regexp_replace(F.trim("line"), rf"[{DIVIDERS}]$", "")
    part = F.when(cut & F.col("whole"), bare_line).when(cut, F.concat(bare_line, F.lit("-"))).otherwise(F.concat(F.trim("line"), F.lit(" ")))
    paras = decided.groupBy("chunk_key", "para").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda s: s["t"]), "").alias("t"))
    place = lambda form, left, right: F.concat_ws("\n", form, left, right)
    found = misread(chunks, page, body, forms, known).select("chunk_key", place(F.col("form"), F.col("l"), F.col("r")).alias("at"), "best")
    fixes = found.groupBy("chunk_key").agg(F.map_from_entries(F.collect_set(F.struct("at", "best"))).alias("fix"))

    def fix(words: Column, i: Column) -> Column:
        b = bare(F.rtrim(words[i]))
        beside = lambda k: F.coalesce(F.lower(bare(F.rtrim(F.get(words, k)))), F.lit(BREAK))
        best = F.coalesce(F.element_at("fix", place(F.lower(b), beside(i - 1), beside(i + 1))), F.element_at("fix", F.lower(b)))
        cased = F.when(b == F.upper(b), F.upper(best)).when(F.substring(b, 1, 1) != F.lower(F.substring(b, 1, 1)), F.concat(F.upper(F.substring(best, 1, 1)), F.substring(best, 2, 1 << 20))).otherwise(best)
        return F.coalesce(F.replace(words[i], b, cased), words[i])

    words = F.split(F.rtrim("t"), r"(?<=\s)(?=\S)")  # each with the blanks behind it
    text = F.array_join(F.transform(words, lambda _, i: fix(words, i)), "")
    done = paras.join(fixes, "chunk_key", "left").select("chunk_key", "para", text.alias("t"))
    whole = done.groupBy("chunk_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para", "t"))), lambda s: s["t"]), "\n\n").alias("text"))
    return body.select("chunk_key").join(whole, "chunk_key", "left").select("chunk_key", F.coalesce("text", F.lit("")).alias("text"))
