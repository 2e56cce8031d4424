"""Spelling variants, the Jaccard join and source divergence against brute force and awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import divergence, jaccard_join, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, row string, value long"


def documents(spark, rows):
    """``rows`` of (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "clash", "clash", 7) for r in rows], SCHEMA)


def made_words(seed, n):
    draw = random.Random(seed)
    base = ["".join(draw.choice("aeinrstÀéÿß") for _ in range(draw.randint(5, 9))) for _ in range(n)]
    words = list(base)
    for w in base:
        at = draw.randrange(len(w))
        words += [w[:at] + draw.choice("aexé") + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + "n" + w[at:], w.upper()]
    return words


def spelling_by_hand(rows, drop_every, min_letters, min_count, times):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if drop_every and h % drop_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}
    near = defaultdict(set)
    for a in words:
        for b in words:
            same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
            longer = len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
            if same or longer:
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("block_words", [2048, 3])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block_words)
    draw = random.Random(3)
    words = made_words(1, 60)
    rows = [(i, " ".join(draw.choices(words, weights=range(1, len(words) + 1), k=60)) + ".7_", "en", None) for i in range(40)]
    rows += [(40, None, "en", None), (41, "", None, None), (None, " ".join(words), "en", "a"), (5, words[0], "en", "a")]
    rows += [(42, "x" * 3000 + " " + "x" * 2999 + "y", "en", "a")] * 2
    counted = spelling.word_counts(documents(spark, rows), drop_every=7, min_letters=4)
    got = {r.word: r[1:] for r in spelling.spelling_variants(counted, 2, 2).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = spelling_by_hand(rows, 7, 4, 2, 2)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and max(map(len, want)) >= 2999
    assert spelling.spelling_variants(spelling.word_counts(documents(spark, []))).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    counts = [("abcdef", 1), ("abcdeg", 10), ("abcdhg", 100), ("abcihg", 1000), ("abjihg", 10000), ("zzzzzzz", 10), ("zzzzzza", 50), ("zzzzzzb", 50)]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(spark.createDataFrame(counts, "word string, n long"), 1).collect()}
    assert all(got[w][1] == "abjihg" for w in ("abcdef", "abcdeg", "abcdhg", "abcihg"))
    assert got["zzzzzzz"] == ("zzzzzza", "zzzzzza") and got["zzzzzzb"] == (None, "zzzzzzb")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def joined_by_hand(rows, size, percent):
    sets = [shingles(r[1], size) if r[0] is not None else frozenset() for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            linked = a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j])
            if linked or a and sets[j] and rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(i)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)]]
        out.append((r[0], len(shingles(r[1], size)), min(ids) if r[0] is not None else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "percent", "block_sets"), [(4, 85, 256), (2, 60, 2), (5, 80, 3)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, size, percent, block_sets):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block_sets)
    draw = random.Random(size)
    texts = [None, "", " \n", "one", "Two words", "two WORDS", "a b c d", "a b c d e f g h i j", "Ü " * 3000, "x" * 20000]
    for seed in range(14):
        vocabulary = [f"w{draw.randrange(30 if seed % 2 else 5000)}" for _ in range(draw.choice([4, 6, 9, 15, 40, 120, 700]))]
        for _ in range(9):
            copy = list(vocabulary)
            for _ in range(draw.randint(0, 1 + len(copy) // 12)):
                copy[draw.randrange(len(copy))] = f"v{draw.randrange(10**6)}"
            texts.append(" ".join(copy[: draw.randint(len(copy) - 2, len(copy))]))
    rows = [(i, t, "en", None) for i, t in enumerate(texts)]
    rows += [(None, texts[20], "en", None), (3, texts[30], "en", None), (3, texts[31], "en", None), (-5, texts[40], "en", None)]
    draw.shuffle(rows)
    got = jaccard_join.jaccard_join(documents(spark, rows), size, percent).collect()
    want = joined_by_hand(rows, size, percent)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert len({w[2] for w in want}) < len(want) - 30
    assert jaccard_join.jaccard_join(documents(spark, []), size, percent).count() == 0


def test_sets_at_the_threshold_share_a_tile():
    """Pairs that differ as much as they may meet in a tile, whatever their size."""
    draw = np.random.default_rng(1)
    bands = jaccard_join.Bands(85)
    for n in [6, 7, 9, 13, 20, 33, 60, 120, 250, 600, 2000]:
        for _ in range(60 if n < 600 else 10):
            m = int(draw.integers(n, 100 * n // 85 + 1))
            common = -(-85 * (n + m) // 185)
            if common > n:
                continue
            universe = np.unique(draw.integers(0, 2**63, n + m, dtype=np.uint64) * np.uint64(2))
            draw.shuffle(universe)
            a, b = np.sort(universe[:n]), np.sort(np.append(universe[:common], universe[n : n + m - common]))
            assert 100 * common >= 85 * (len(a) + len(b) - common)
            assert len(np.intersect1d(jaccard_join.tile_keys(a, bands), jaccard_join.tile_keys(b, bands)))


def test_bitmaps_never_reject_a_link():
    draw = np.random.default_rng(2)
    for n in (3, 50, 4000):
        a = draw.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 13], draw.integers(0, 2**63, n // 13, dtype=np.uint64)])
        words = [np.frombuffer(jaccard_join.parities(x), dtype=np.uint64) for x in (a, b)]
        differing = np.bitwise_count(words[0] ^ words[1]).sum()
        assert differing <= 2 * (n // 13)


def divergence_by_hand(rows, min_docs, top):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        sources = sorted({d[1] for d in own}, key=str.encode)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= min_docs) for s in sources}
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        shares, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, shares[s][t] - q[t]) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence_equals_brute_force(spark, monkeypatch, small):
    """The small settings cut the vocabulary into many shards and slices, and the sources into many tiles."""
    if small:
        for name, value in (("SHARD_TERMS", 7), ("BROADCAST_BYTES", 600), ("PAGE", 8), ("MAX_PAGES", 3), ("BLOCK_SOURCES", 2)):
            monkeypatch.setattr(divergence, name, value)
    draw = random.Random(4)
    words = ["the", "Über", "été", "日本", "a-b", "x1y", "don't", "×", "É"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for i in range(120):
        lang, source = draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "Ö", None])
        text = " ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randint(0, 40)))
        rows.append((i % 50, text, lang, source))
    rows += [(1, None, "en", "none"), (2, "", "fr", "s1"), (3, "rare", "fr", "s2"), (None, "the " * 2000, "en", "hot"), (4, "the", "fr", "s3")]
    got = divergence.source_divergence(documents(spark, rows), min_docs=4, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergence_by_hand(rows, 4, 5)
    assert divergence.source_divergence(documents(spark, [])).count() == 0


def test_perfect_hash_gives_every_term_its_own_slot_and_knows_strangers():
    terms = pa.array(sorted({f"t{k}é" for k in range(3000)} | {"", "x" * 5000}))
    variant, levels, order = divergence.perfect_hash(terms)

    class Shard:
        pass

    shard = Shard()
    shard.lang, shard.shard, shard.shards, shard.variant = "en", 0, 1, variant
    shard.sizes, shard.bits = [len(x) for x in levels], np.packbits(np.concatenate(levels)).tobytes()
    shard.terms = terms.take(pa.array(order)).to_pylist()
    slots = divergence.Slots([shard], 0)
    found = slots.find("en", terms)
    assert sorted(found) == list(range(len(terms))) and [shard.terms[k] for k in found] == terms.to_pylist()
    strangers = pa.array([f"u{k}" for k in range(5000)])
    assert (slots.find("en", strangers) == -1).all() and (slots.find("de", terms) == -1).all()
