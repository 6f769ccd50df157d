"""Text decoded with the wrong encoding: found and, where possible, restored.

A multinomial classifier over hashed byte bigrams tells for every word with characters beyond ASCII by which
chain (written in one encoding, read in another, once or twice, with or without loss) it came about, if by any.
It is trained on a bounded sample of the corpus' words, as they stand for the class "clean" and garbled by every
chain for the others. The likeliest chain is inverted; where that doesn't decode strictly, or doesn't read as
clean, the next one is, as long as it is likelier than "clean"; of chains about as likely as the first that
does, the one whose text reads best is taken. A word that no chain restores counts only if it
holds what a wrong decoding leaves and a chain is likelier than "clean". Words of one chain in a row add up
their evidence.

How often words stand in the corpus, and bytes follow each other in them, is counted over all documents: the
words are combined map-side and written to the shared folder once; tables of a fixed size go to the tasks. The
sample serves the classifier alone. Training and counting run in tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.sketch import counter_classes
from quarrylake.session import written

SAMPLE = 12_000  # different words the classifier is trained on, drawn by frequency, whatever the size of the corpus
LONGEST = 200  # characters of a sample word; longer ones are judged and counted all the same
TASKS = 8  # of the training
BUCKETS = 1 << 15
SMOOTH = 0.05
COUNTER_BITS = 22  # counters of known words, one byte each
#: Nats (restored against given, both as clean text) that a run of words must gain.
ENOUGH = 4.0
TRIED = 24  # likeliest chains that are inverted
MARGIN = 8.0  # nats below the likeliest chain that decodes, down to which the classifier's choice is open to how the text reads
KNOWN = 3  # occurrences in the corpus from which a word is known
FIRM = 5.5  # gain from which a known word counts as garbled, unless it decodes as UTF-8 or as a commoner word of four letters or more
OUTER = ".,;:!?\"'()[]{}<>*#-/|`~"
REMEMBERED = 300_000

# Encodings that texts are written in and read in.
UTF8_READERS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "iso8859-2", "iso8859-15"]
LATIN = ["cp1252", "cp1250", "mac_roman", "cp437", "cp850", "cp852", "iso8859-2", "latin-1"]
CYRILLIC = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"]
TWICE = ["latin-1", "cp1252", "cp1250", "cp437", "cp850", "mac_roman", "cp1251"]

WORD = re.compile(r"(?<![^ \t\r\n])[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")  # tried at the start of a word only
NUMBERS = re.compile(r"\d+")
LOST = re.compile("[�\x80-\x9f]")  # characters that only a wrong decoding leaves


def chains() -> list[tuple[tuple[str, str], ...]]:
    """Each a sequence of (written, read)."""
    out = [(("utf-8", r),) for r in UTF8_READERS]
    out += [(("utf-8", a), ("utf-8", b)) for a in TWICE for b in TWICE if a == b or {a, b} == {"latin-1", "cp1252"}]
    out += [((w, r),) for w in LATIN for r in [*LATIN, "cp1251", "cp866", "koi8-r"] if w != r]
    out += [((w, r),) for w in CYRILLIC for r in [*CYRILLIC, *LATIN] if w != r]
    return out


def lossy_chains() -> list[tuple[tuple[str, str], ...]]:
    """Bytes that the reader doesn't know became U+FFFD."""
    return [((w, "utf-8"),) for w in ["cp1252", "cp1250", "mac_roman", "cp437", "cp1251", "koi8-r", "cp866"]] + [(("utf-8", r),) for r in ["cp1252", "cp1250", "cp1251"]]


STRICT = chains()
CHAINS = STRICT + lossy_chains()


def _to_bytes(text: str, encoding: str) -> bytes:
    """Strict, but that a C1 control stands for its byte where a reader let undefined bytes through."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding == "utf-8":
            raise
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(encoding) for c in text)


def _to_text(raw: bytes, encoding: str) -> str:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        if encoding == "utf-8":
            raise
        return "".join(bytes([b]).decode(encoding, "replace").replace("�", chr(b)) for b in raw)


def garble(text: str, chain: int) -> str | None:
    try:
        for written_, read in CHAINS[chain]:
            raw = text.encode(written_)
            text = _to_text(raw, read) if chain < len(STRICT) else raw.decode(read, "replace")
    except UnicodeError:
        return None
    return text


def restore(text: str, chain: int) -> str | None:
    """The inverse of garble; null unless every step decodes strictly, and for a chain that loses."""
    if chain >= len(STRICT):
        return None
    try:
        for written_, read in reversed(CHAINS[chain]):
            text = _to_bytes(text, read).decode(written_)
    except UnicodeError:
        return None
    return text


def features(word: str) -> np.ndarray:
    """Buckets of the byte bigrams with a byte beyond ASCII, blanks around the word included."""
    b = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    pair = (b[:-1] << 8) | b[1:]
    pair = pair[(pair & 0x8080) > 0]
    return ((pair * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _bigrams(word: str) -> np.ndarray:
    b = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.int64)
    return (b[:-1] << 8) | b[1:]


def core(word: str) -> str:
    return word.strip(OUTER).casefold()


def slot(word: str) -> int:
    """The counter of a word's core, whatever its numbers."""
    return zlib.crc32(NUMBERS.sub("0", core(word)).encode("utf-8", "surrogatepass")) >> (32 - COUNTER_BITS)


def trained_table(words: list[str], counts: list[int]) -> np.ndarray:
    """Occurrences by class (0 clean, 1 + c chain c) and bucket."""
    n = np.zeros((1 + len(CHAINS), BUCKETS), np.float32)
    for w, count in zip(words, counts):
        np.add.at(n[0], features(w), count)
        for c in range(len(CHAINS)):
            if (g := garble(w, c)) is not None and g != w and (c < len(STRICT) or LOST.search(g)):
                np.add.at(n[1 + c], features(g), count)
    return n


class Classifier:
    def __init__(self, table: np.ndarray, step: np.ndarray, classes: np.ndarray):
        n = np.maximum(table, 0) + SMOOTH
        self.table = np.ascontiguousarray(np.log(n / n.sum(1, keepdims=True)).astype(np.float32).T)  # by bucket: [0] clean, [1 + c] chain c
        follow = step.reshape(256, 256) + 0.02
        self.step = np.log(follow / follow.sum(1, keepdims=True)).astype(np.float32).ravel()  # of a byte after a byte in clean words
        self.classes = classes  # of counters: c for 2**(c-1) <= occurrences < 2**c
        self.total = float(np.exp2(classes[classes > 0] - 0.5).sum()) or 1.0
        self.known: dict[str, tuple[float, int, str] | None] = {}

    def __getstate__(self) -> tuple[bytes, np.ndarray, bytes, float]:
        return zlib.compress(self.table.astype(np.float16).tobytes(), 1), self.step, zlib.compress(self.classes.tobytes(), 1), self.total

    def __setstate__(self, state: tuple[bytes, np.ndarray, bytes, float]) -> None:
        table, self.step, classes, self.total = state
        self.table = np.frombuffer(zlib.decompress(table), np.float16).reshape(BUCKETS, -1).astype(np.float32)
        self.classes, self.known = np.frombuffer(zlib.decompress(classes), np.uint8), {}

    def count(self, word: str) -> float:
        """About how often the corpus holds a word, 0 if less than KNOWN times."""
        c = int(self.classes[slot(word)])
        return float(2 ** (c - 0.5)) if c >= KNOWN.bit_length() else 0.0

    def clean(self, word: str) -> float:
        """Log probability as clean text; hard blanks part words."""
        parts = word.split("\xa0")
        total = -3.0 * (len(parts) - 1)
        for part in parts:
            spelt = float(self.step[_bigrams(part)].sum()) - 1.0
            known = self.count(part)
            total += max(spelt, float(np.log(known / self.total)) - 1.0) if known else spelt
        return total

    def _judge(self, word: str) -> tuple[float, int, str] | None:
        """The likeliest chain whose inverse decodes strictly and reads as clean."""
        score = self.table[features(word)].sum(0)
        own, known = self.clean(word), self.count(word)
        blanks = word.replace("\xa0", "").isascii()
        order = np.argpartition(-score, TRIED)[:TRIED]
        order = order[np.argsort(-score[order], kind="stable")]
        best, least = None, -np.inf
        for c in order.tolist():
            if c == 0 or score[c] <= score[0] or score[c] < least:
                break
            back = restore(word, c - 1)
            if back is None or back == word or LOST.search(back):
                continue
            legacy, common = CHAINS[c - 1][0][0] != "utf-8", self.count(back)
            if common <= 4 * max(known, KNOWN) if blanks else not common and legacy and len(core(back)) < 3:
                continue  # hard blanks are no evidence but of a much commoner word, a sign or two none of an unknown one
            doubtful = known and legacy and (len(core(word)) < 4 or common <= known)
            gain = self.clean(back) - own
            if gain > (FIRM if doubtful else 1.0):
                least = max(least, float(score[c]) - MARGIN)
                if best is None or gain > best[0]:
                    best = (gain, c - 1, back)
        if best is not None:
            return best
        best = int(order[0])
        return (ENOUGH, best - 1, word) if best and LOST.search(word) else None

    def __call__(self, word: str) -> tuple[float, int, str] | None:
        """(evidence, chain, restored word), or None for a clean word."""
        if len(word) > 200:
            return self._judge(word)
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = self._judge(word)
        return self.known[word]

    def text(self, text: str) -> tuple[bool, str | None, str, bool]:
        """(found, chain, text with every garbled run restored, whether nothing was lost)."""
        spots = [(m.start(), m.end(), self(m[0])) for m in WORD.finditer(text)]
        lost = any(x is not None and x[2] == text[s:e] for s, e, x in spots)
        out, at, names, found = [], 0, Counter(), False
        whole = Counter()
        for _, _, x in spots:
            if x is not None:
                whole[x[1]] += x[0]
        usual = [c for c, _ in whole.most_common(1)]
        for order in (range(1, len(spots)), range(len(spots) - 2, -1, -1)) if usual else ():
            for i in order:  # beside a garbled word it is enough that one reads better so
                if spots[i][2] is None and spots[i - 1 if order.step > 0 else i + 1][2] is not None:
                    s, e, _ = spots[i]
                    back = restore(text[s:e], usual[0])
                    if back is not None and back != text[s:e] and not LOST.search(back) and self.clean(back) > self.clean(text[s:e]):
                        spots[i] = (s, e, (0.0, usual[0], back))
        i = 0
        while i < len(spots):
            if spots[i][2] is None:
                i += 1
                continue
            j, total, votes = i, 0.0, Counter()
            while j < len(spots) and spots[j][2] is not None:
                total += spots[j][2][0]
                votes[spots[j][2][1]] += spots[j][2][0]
                j += 1
            if total >= ENOUGH or lost:
                found = True
                chain = votes.most_common(1)[0][0]
                names[chain] += j - i
                for s, e, (_, _, back) in spots[i:j]:
                    for c in [*usual, chain]:  # one chain for the text, or at least for the run, where it reads about as well
                        common = restore(text[s:e], c)
                        if common is not None and common != text[s:e] and not LOST.search(common) and self.clean(common) > self.clean(back) - 3:
                            back = common
                            break
                    out += [text[at:s], back]
                    at = e
            i = j
        new = "".join(out) + text[at:]
        name = "; ".join(f"{w}>{r}" for w, r in CHAINS[names.most_common(1)[0][0]]) if names else None
        return found, name, new, not LOST.search(new)


def corpus_words(texts: DataFrame) -> DataFrame:
    """(word, n): every word beyond ASCII of the only column and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter(m[0] for t in b.column(0).to_pylist() for m in WORD.finditer(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fitted(words: DataFrame, sample: int) -> Classifier:
    """Two rounds: the second leaves out words that the first finds garbled."""
    spark = words.sparkSession
    # drawn without replacement, each word with a chance by its occurrences
    chance = F.log((F.pmod(F.xxhash64("word"), F.lit(1 << 40)) + 1) / float(1 << 40)) / F.col("n")
    drawn = words.where(F.length("word") <= LONGEST).orderBy(chance.desc(), "word").limit(sample).toArrow()
    drawn = spark.createDataFrame(drawn).repartition(TASKS, "word")
    model, table = None, np.zeros((1 + len(CHAINS), BUCKETS), np.float32)
    for _ in range(2):
        shared = spark.sparkContext.broadcast(model)

        def unspoilt(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            judge = shared.value
            for b in batches:
                yield b.filter(pa.array([not LOST.search(w) and not (judge and judge(w)) for w in b.column(0).to_pylist()], pa.bool_()))

        def spoilt(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            judge = shared.value
            for b in batches:
                yield b.filter(pa.array([not LOST.search(w) and judge(w) is not None for w in b.column(0).to_pylist()], pa.bool_()))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((1 + len(CHAINS), BUCKETS), np.float32)
            for b in batches:
                n += trained_table(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(n.tobytes(), 1)])], ["n"])

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(1 << 16)
            for b in batches:
                for w, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    np.add.at(n, _bigrams(w), count)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

        def count(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            return np.fromiter(map(slot, b.column(0).to_pylist()), np.int64, b.num_rows), b.column(1).to_numpy().astype(np.uint32)

        # the second time only what is left out is garbled again, and taken off
        for r in drawn.mapInArrow(spoilt if model else unspoilt, drawn.schema).mapInArrow(train, "n binary").collect():
            table += np.frombuffer(zlib.decompress(r["n"]), np.float32).reshape(-1, BUCKETS) * (-1 if model else 1)
        clean = written(words.mapInArrow(unspoilt, words.schema))
        got = clean.mapInArrow(follow, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        step = np.zeros(1 << 16)
        step[got["at"].to_numpy()] = got["n"].to_numpy()
        model = Classifier(table, step, counter_classes(clean, count, COUNTER_BITS))
    return model


def garbled_texts(df: DataFrame, key: str, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, chain, restored, complete) of every row whose text is garbled, wholly or in a stretch.

    chain: the one of most words. complete: nothing that a wrong decoding leaves stands in the restored
    text. Null, empty and ASCII texts are clean.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    trained = fitted(written(corpus_words(rows.select("text"))), sample)
    shared = spark.sparkContext.broadcast(trained)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [(k, *model.text(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            got = [g for g in got if g[1]]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], b.column(0).type), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.string()), pa.array([g[4] for g in got], pa.bool_())], ["key", "chain", "restored", "complete"])

    return rows.mapInArrow(run, f"key {kind}, chain string, restored string, complete boolean").withColumnRenamed("key", key)
