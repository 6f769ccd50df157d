"""Kernels of the llm operators against plain versions."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylake.llm import leaks, mojibake, neardup, neighbours, splitting, tokens, wordhash


def plain_words(text):
    return ["".join(g) for g in re.findall(r"[^\W_]+", text) for g in [[c.lower() for c in g]]] if all(unicodedata.category(c)[0] in "LN" or not c.isalnum() for c in text) else None


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="abÄßéЖя1２ \n-_.,'’​🙂", max_size=30), max_size=6))
def test_words(texts):
    h, doc = wordhash.words(texts)
    want = [(i, w) for i, t in enumerate(texts) for w in plain_words(t)]
    assert doc.tolist() == [i for i, _ in want]
    names = {}
    for x, (_, w) in zip(h.tolist(), want):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_words_do_not_depend_on_their_stretch(monkeypatch):
    texts = ["some words in a row, some more words", "words in a row"]
    whole = wordhash.words(texts)[0].tolist()
    monkeypatch.setattr(wordhash, "STRETCH", 7)
    assert wordhash.words(texts)[0].tolist() == whole and whole[0] == whole[5] and whole[1:5] == whole[8:12]


def brute_pairs(texts, num=7, den=10):
    sets = []
    for t in texts:
        w = plain_words(t or "")
        sets.append(frozenset(zip(w, w[1:], w[2:])))
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


def edited_texts(rnd, n, vocabulary):
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.4:
            w = rnd.choice(out).split()
            for _ in range(rnd.randrange(4)):
                k = rnd.randrange(len(w) + 1)
                w[k : k + rnd.randrange(2)] = [rnd.choice(vocabulary)] * rnd.randrange(2)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 60))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("group_bits", "held"), [(15, 1 << 18), (1, 1 << 18), (1, 64)])
def test_trie_join(monkeypatch, group_bits, held):
    """Every pair survives the walk, whether groups are whole, split, or streamed in small batches."""
    monkeypatch.setattr(neardup, "GROUP_BITS", group_bits)
    monkeypatch.setattr(neardup, "HELD", held)
    rnd = random.Random(group_bits + held)
    texts = list(dict.fromkeys(edited_texts(rnd, 250, [f"w{i}" for i in range(40)])))
    sketch = np.zeros(1 << 16, np.uint8)
    n = np.bincount(neardup._buckets(wordhash.shingles(texts)[0], 16), minlength=1 << 16)
    sketch[:] = np.frexp(n.astype(float))[1]
    ids = [i.to_bytes(10, "big") for i in range(len(texts))]
    rows = pa.Table.from_batches([neardup.prefix_rows(ids, texts, 3, 7, 10, sketch, group_bits)]).sort_by([("tok", "ascending"), ("head", "ascending"), ("meta", "ascending")])
    batches = rows.to_batches(max_chunksize=50)
    got = set()
    for b in neardup.walk_partition(iter(batches), 7, 10):
        got |= {tuple(sorted((int.from_bytes(x, "big"), int.from_bytes(y, "big")))) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert brute_pairs(texts) <= got


def test_packed_steps():
    rnd = np.random.default_rng(1)
    runs = rnd.integers(0, 20, 50)
    steps = rnd.integers(0, 700, runs.sum())
    sizes, data = neardup.packed(steps, runs)
    base = rnd.integers(0, 100, 50)
    rows, length = neardup.unpacked(base, np.concatenate(([0], np.cumsum(sizes))), data)
    at = np.cumsum(runs) - runs
    for k in range(50):
        assert length[k] == runs[k] and rows[k, : runs[k]].tolist() == (base[k] + np.cumsum(steps[at[k] : at[k] + runs[k]])).tolist()


def plain_cuts(sizes, limit, overlap):
    out, i = [], 0
    while True:
        e = i
        while e < len(sizes) and sum(sizes[i : e + 1]) <= limit:
            e += 1
        out.append((i, e))
        if e == len(sizes):
            return out
        j = i + 1
        while sum(sizes[j:e]) > overlap:
            j += 1
        i = j


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=60), min_size=1, max_size=4))
def test_pointer_doubling(docs):
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    first, after = splitting.greedy_cuts(np.array(sum(docs, [])), starts, 60, 20)
    want = [(starts[k] + a, starts[k] + b) for k, d in enumerate(docs) for a, b in plain_cuts(d, 60, 20)]
    assert list(zip(first.tolist(), after.tolist())) == want


def test_long_lines_are_cut_between_characters():
    text = (" ".join(f"Sentence number {i} stands here." for i in range(150)) + "".join(chr(0x4E00 + i) for i in range(3000))) + "\nshort\n"
    out = splitting._cut_batch([1], [text], 2400, 400, 1000).to_pydict()
    assert all(len(c.encode()) <= 2400 for c in out["content"]) and out["chunk_index"] == list(range(len(out["content"]))) and not any(out["whole_lines"])
    assert out["first_line"][0] == 1 and out["last_line"][-1] == 2
    rebuilt, raw = out["content"][0], text
    for c in out["content"][1:]:
        k = next(n for n in range(min(len(rebuilt), len(c)), -1, -1) if rebuilt.endswith(c[:n]) and raw.startswith(rebuilt + c[n:]))
        rebuilt += c[k:]
    assert rebuilt == text


def test_list_search_is_exact_within_a_list():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64))
    u = neighbours.unit(x)
    model = neighbours.Model(u, 1, 200)
    own = model.near(u, 1)[:, 0]
    q, m, cos = neighbours.search_cell(model, 5, 200, x, np.arange(200), own, model.encode(u, own), x, np.arange(200), [np.zeros(1, int)] * 200)
    s = neighbours.unit(x).astype(float) @ neighbours.unit(x).astype(float).T
    np.fill_diagonal(s, -9)
    assert (m.reshape(200, 5) == np.argsort(-s, 1, kind="stable")[:, :5]).mean() > 0.999


RANKS = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 301, b"abc": 302, b"aa": 303, b"aaaa": 304, b"ca": 305, b"cab": 306}


def plain_bpe(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((RANKS[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in RANKS), default=None)
        if best is None:
            return [RANKS[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abcé", min_size=1, max_size=40))
def test_segment_tree_merges(text):
    piece = text.encode()
    assert tokens.encode_piece(piece, RANKS) == ([RANKS[piece]] if piece in RANKS else plain_bpe(piece))


def test_long_piece():
    assert sum({300: 2, 302: 3, 306: 3, 305: 2, 301: 2}.get(i, 1) for i in tokens.encode_piece(b"abc" * 20_000, RANKS)) == 60_000


def brute_leaks(docs, items, n=13):
    runs = lambda t: {tuple(w[i : i + n]) for w in [plain_words(t)] for i in range(len(w) - n + 1)}
    r = [runs(t) for t in items]
    return {(d, i) for d, t in enumerate(docs) for i in range(len(items)) if runs(t) & r[i]}


@pytest.mark.parametrize("hits", [2_000_000, 50])
def test_leaks_against_brute_force(monkeypatch, hits):
    monkeypatch.setattr(leaks, "HITS", hits)
    rnd = random.Random(6)
    vocab = [f"{a}{b}" for a in "a bc def ghij" .split() for b in ["", "x", "yz", "long"]] + list("abcde")
    items = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 13, 14, 40]))) for _ in range(30)] + ["a " * 13, "", "one two"]
    docs = []
    for _ in range(120):
        w = [rnd.choice(vocab) for _ in range(60)]
        p = rnd.choice(items).split()
        k = rnd.randrange(max(1, len(p) - 14))
        cut = p[k : k + rnd.choice([8, 12, 13, 20])]
        docs.append(" ".join(w[:20]) + "  " + rnd.choice([" ", ", ", " / ", "\n"]).join(cut).upper() + "! " + " ".join(w[20:]))
    docs += ["", "a", items[0]]
    table = leaks.Items(list(range(len(items))), items)
    got = leaks.leaks_in(table, docs)
    assert {(d, i) for d, i, exact, *_ in got if exact} == brute_leaks(docs, items)
    assert leaks.leaks_in(leaks.Items([], []), docs) == [] and leaks.leaks_in(table, [""]) == []


def test_leak_in_a_monotonous_text():
    item = "to be or not to be " * 20
    got = leaks.leaks_in(leaks.Items([1, 2], [item, item + "that"]), ["to be or not " * 20_000, "be " * 200_000])
    assert sorted((d, i) for d, i, exact, *_ in got if exact) == sorted(brute_leaks(["to be or not " * 50, "be " * 99], [item, item + "that"]))


def test_leak_with_an_edit():
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old tower tonight"
    doc = "before it " + item.replace("wizards", "wizrds") + " and after"
    (got,) = leaks.leaks_in(leaks.Items([7], [item]), [doc])
    assert got[:3] == (0, 0, False) and got[4] == 1


def test_banded():
    code = lambda s: np.array([0 if c == " " else ord(c) for c in s], np.uint32)
    text, other = code(" abc def gh x "), code("  abXc def gh y ")
    got = leaks.banded(text, np.array([0, 4]), np.array([14, 8]), other, np.array([1, 6]), np.array([15, 8]), np.array([-1, -1]), 4)
    assert [x.tolist() for x in got] == [[2, 0], [2, 2]]
    none = leaks.banded(code(""), *[np.empty(0, np.int64)] * 2, code(""), *[np.empty(0, np.int64)] * 3, 4)
    assert [x.tolist() for x in none] == [[], []]


def test_leaks_are_told_by_whole_words():
    """Brute force: some 13 consecutive words of the item stand in the document; parts of words don't count."""
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(6)]
    item = " ".join(rng.choice(names, 30))
    words = item.split()
    docs = [" ".join([*rng.choice(names, 9), *words[i : i + n], *rng.choice(names, 9)]) for i in range(0, 17, 4) for n in (11, 12, 13, 14)]
    docs += [f"x{' '.join(words[:13])}", f"{' '.join(words[:13])}x", " ".join(words[:13]), "--" + " ".join(words[5:18]) + "!"]
    runs = {tuple(words[i : i + 13]) for i in range(18)}
    has = [any(tuple(d[i : i + 13]) in runs for i in range(len(d))) for d in ("".join(c if c.isalnum() else " " for c in t).split() for t in docs)]
    got = {d for d, _, exact, *_ in leaks.leaks_in(leaks.Items([1], [item]), docs) if exact}
    assert got == {i for i, x in enumerate(has) if x} and 8 < len(got) < len(docs)


CLEAN = "São Müller größer déjà naïve Ångström señor Žirovec “quoted” – don’t café ñandú Привет мир заявку таблицу".split()


def test_garble_and_restore_are_inverse():
    for w in CLEAN:
        for chain in range(len(mojibake.CHAINS)):
            g = mojibake.garble(w, chain)
            if g is not None:
                assert mojibake.restore(g, chain) == w or "\x80" <= min((c for c in g if c > "\x7f"), default="\x80") <= "\x9f" or mojibake.restore(g, chain) is None


def classifier(words):
    step, classes = np.zeros(1 << 16), np.zeros(1 << mojibake.COUNTER_BITS, np.int64)
    for w, n in words.items():
        np.add.at(step, mojibake._bigrams(w), n)
        classes[mojibake.slot(w)] += n
    return mojibake.Classifier(mojibake.trained_table(list(words), list(words.values())), step, np.frexp(classes.astype(float))[1].astype(np.uint8))


def test_classifier():
    model = classifier(Counter({w: 20 for w in CLEAN} | {w: 3 for w in "𝔏𝔢 Ⅷ ½ 日本語".split()}))
    for w in CLEAN:
        assert model(w) is None
    for chain in [(("utf-8", "cp1252"),), (("utf-8", "latin-1"), ("utf-8", "latin-1"))]:
        text = " ".join(["plain words", mojibake.garble("größer señor", mojibake.CHAINS.index(chain)), "déjà"])
        assert model.text(text)[0] and model.text(text)[2] == "plain words größer señor déjà"
    assert model.text("lost � here")[0] and not model.text("lost � here")[3]
    lost = mojibake.garble("größer señor", mojibake.CHAINS.index((("cp1252", "utf-8"),)))
    assert "�" in lost and model.text(lost)[:2] == (True, "cp1252>utf-8")
    assert not model.text("rare 𝔏𝔢 Ⅷ ½ 日本語 words")[0] and not model.text("")[0]


def test_classifier_on_held_out_words():
    """Words that neither the classifier nor the counts have seen, garbled by every strict chain, and as they stand."""
    rng = np.random.default_rng(8)
    stems = "gr{}nd f{}hren m{}del tr{}me sch{}n w{}rter k{}nnen l{}nder b{}cher h{}user s{}tze v{}gel z{}ge r{}ume gl{}ck br{}der n{}chste t{}chter p{}nktlich d{}rfen".split()
    seen = Counter({st.format(v) + end: int(rng.integers(3, 40)) for st in stems[:14] for v in "äöü" for end in ("", "s", "en")})
    model = classifier(seen)
    held = [st.format(v) + end for st in stems[14:] for v in "äöü" for end in ("", "e")]
    assert sum(bool(model.text(f"das {w} und {v} war")[0]) for w, v in zip(held, held[1:])) == 0
    tried = found = right = 0
    for c in range(len(mojibake.STRICT)):
        for w, v in zip(held[::5], held[1::5]):
            text = f"{w} {v}"
            g = mojibake.garble(text, c)
            if g is None or g == text or mojibake.restore(g, c) != text:
                continue
            tried += 1
            got = model.text(g)
            found += got[0]
            right += got[2] == text
    assert tried > 500 and found / tried > 0.99 and right / tried > 0.95
