r"""Byte-pair encoding by speculation: propose tokens greedily, check every adjacent pair, repair the rest.

A sequence of tokens is the encoding of a word exactly if no merge ever crosses the border of two
neighbours, and whether one does depends on those two tokens alone. So: (1) greedy longest match
proposes tokens for each new word; (2) one vectorised pass walks the merge trees of all adjacent
pairs of all proposals, latest merge first, and looks up whether the two pieces that touch at that
time would have merged before either grew; (3) only words with a failing pair are merged exactly.

Texts are cut at the special tokens, normalised (NFC, per-character lower case) and split by the
vocabulary file's pattern; white space is dropped. A word's encoding is kept in two tables of about
``CACHE_WORDS`` words per Python worker: a full one becomes the older, whose words return when
they are met again, so frequent words stay and memory is bounded.

Defined results: null and empty texts have no tokens and decode to the empty string; equal texts
encode alike; characters outside the vocabulary cannot occur, as every byte is a token.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.text import per_document

CACHE_WORDS = 200_000
_NEVER = np.iinfo(np.int64).max
# Unicode white space, as the vocabulary file's pattern excludes it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_SPACES = regex.compile(f"[{_SPACE}]+")
# Separators to Python that are no white space to the pattern.
_INFORMATION = regex.compile(r"[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges, merge trees and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.id_texts = {i: str(i) for i in self.names}
        self.letters = byte_letters()
        size = max(self.names) + 1
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.rank = np.full(size, -1, dtype=np.int64)
        self.merges: dict[tuple[str, str], int] = {}
        keys = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[a, b] = rank
            token, x, y = self.ids[a + b], self.ids[a], self.ids[b]
            self.left[token], self.right[token], self.rank[token] = x, y, rank
            keys.append(x * size + y)
        self.size = size
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.pair_keys, self.pair_ranks = np.array(keys, dtype=np.int64)[order], order.astype(np.int64)
        self.pair_tokens = np.empty(len(order), dtype=np.int64)
        self.pair_tokens[:] = [self.ids["".join(m)] for m in self.merges]
        self.pair_tokens = self.pair_tokens[order]
        # Symbols are the bytes, plain and at a word's end.
        self.symbol = np.array([[self.ids[c], self.ids[c + self.suffix]] for c in self.letters], dtype=np.int64)
        self._grow_trie(self._reachable())
        self.splitter = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
        # Letters and digits newer than the interpreter's Unicode tables are symbols to the vocabulary file.
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        found = regex.findall(r"[\p{L}\p{N}]", every)
        self.newer = {ord(c): 0xFFFD for c in found if unicodedata.category(c)[0] not in "LN"}
        self.constant = {t: (str(i), t) for t, i in self.specials.items()}
        self.cache: dict[str, tuple[str, str]] = dict(self.constant)
        self.older: dict[str, tuple[str, str]] = {}

    def _reachable(self) -> list[int]:
        """Tokens that their own letters encode to; others must never be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(self.size, dtype=bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for token in made[np.argsort(self.rank[made])]:
            fine[token] &= fine[self.left[token]] and fine[self.right[token]]
        return [i for i in self.ids.values() if fine[i]]

    def merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of each pair (before the merge of rank ``until``)."""
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        # Ranks at which the touching pieces x and y were absorbed into their parents.
        end_x = np.full(len(a), _NEVER) if until is None else until.copy()
        end_y = end_x - 1
        while len(live):
            m = self.merge_rank(x, y)
            # Of equal merges the left one goes first: a merge equal to x's own comes later than it.
            bad = (m < end_x) & (m <= end_y)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            keep = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, end_x, end_y, rx, ry = (v[keep] for v in (live, x, y, end_x, end_y, rx, ry))
            undo_x = rx > ry
            end_x, end_y = np.where(undo_x, rx, end_x), np.where(undo_x, end_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def _grow_trie(self, tokens: list[int]) -> None:
        """Sorted (node, symbol) keys with the node each leads to, and the token that ends at each node."""
        spelled: dict[int, tuple[int, ...]] = {int(i): (int(i),) for i in self.symbol.ravel()}
        for token in np.argsort(self.rank, kind="stable"):
            if self.rank[token] >= 0:
                spelled[int(token)] = spelled[int(self.left[token])] + spelled[int(self.right[token])]
        child: dict[int, int] = {}
        ends = {}
        for token in tokens:
            node = 0
            for symbol in spelled[token]:
                node = child.setdefault(node * self.size + symbol, len(child) + 1)
            ends[node] = token
        keys = np.fromiter(child, dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        self.trie_keys = keys[order]
        self.trie_nodes = np.fromiter(child.values(), dtype=np.int64, count=len(child))[order]
        self.trie_token = np.full(len(child) + 1, -1, dtype=np.int64)
        self.trie_token[list(ends)] = list(ends.values())

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words in one array, and the number of each word's symbols."""
        encoded = [w.encode() for w in words]
        lengths = np.array([len(e) for e in encoded], dtype=np.int64)
        raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        last = np.zeros(len(raw), dtype=np.int64)
        last[np.cumsum(lengths) - 1] = 1
        return self.symbol[raw, last], lengths

    def propose(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in step: (owner, token) pairs in reading order."""
        stop = np.cumsum(lengths)
        word = np.arange(len(lengths))
        at = stop - lengths  # where the token being matched starts
        cur, node = at.copy(), np.zeros(len(word), dtype=np.int64)
        best_end, best_token = at.copy(), np.full(len(word), -1, dtype=np.int64)
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            inside = cur < stop[word]
            key = node * self.size + symbols[np.minimum(cur, len(symbols) - 1)]
            found = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            go = inside & (self.trie_keys[found] == key)
            node = np.where(go, self.trie_nodes[found], 0)
            cur = np.where(go, cur + 1, cur)
            token = self.trie_token[node]
            better = go & (token >= 0)
            best_token = np.where(better, token, best_token)
            best_end = np.where(better, cur, best_end)
            done = ~go
            if done.any():
                made.append((word[done], at[done], best_token[done]))
                at = np.where(done, best_end, at)
                cur = np.where(done, best_end, cur)
                keep = ~done | (at < stop[word])
                word, at, cur, node, best_end, best_token = (v[keep] for v in (word, at, cur, node, best_end, best_token))
        owner, places, tokens = (np.concatenate(x) for x in zip(*made))
        order = np.argsort(places, kind="stable")
        return owner[order], tokens[order]

    def merge_exactly(self, parts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words merged together: in each step every word applies its lowest-ranked merge everywhere."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(parts):
            rank = np.full(len(parts), _NEVER)
            key = parts[:-1] * self.size + parts[1:]
            found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            fits = (owner[:-1] == owner[1:]) & (self.pair_keys[found] == key)
            rank[:-1][fits] = self.pair_ranks[found[fits]]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(first, len(parts)))
            best = np.repeat(np.minimum.reduceat(rank, first), counts)
            over = best == _NEVER
            done.append((owner[over], parts[over]))
            hits = np.flatnonzero((rank == best) & ~over)
            # Of overlapping equal pairs the left ones merge.
            run = np.append(True, np.diff(hits) != 1)
            start = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0)) if len(hits) else hits
            hits = hits[(np.arange(len(hits)) - start) % 2 == 0]
            parts = parts.copy()
            parts[hits] = self.pair_tokens[found[hits]]
            keep = ~over
            keep[hits + 1] = False
            parts, owner = parts[keep], owner[keep]
        owners, tokens = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owners, kind="stable")
        return owners[order], tokens[order]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Speculate, verify all adjacent pairs at once, and merge only the failing words exactly."""
        symbols, lengths = self.symbols(words)
        owner, tokens = self.propose(symbols, lengths)
        inner = owner[:-1] == owner[1:]
        pairs, place = np.unique((tokens[:-1] * self.size + tokens[1:])[inner], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[place]
        failing = np.zeros(len(words), dtype=bool)
        failing[owner[:-1][inner][~good]] = True
        if failing.any():
            letters = np.repeat(np.arange(len(words)), lengths)
            chosen = failing[letters]
            again = self.merge_exactly(symbols[chosen], letters[chosen])
            right = ~failing[owner]
            owner, tokens = np.append(owner[right], again[0]), np.append(tokens[right], again[1])
            order = np.argsort(owner, kind="stable")
            owner, tokens = owner[order], tokens[order]
        flat, ends = tokens.tolist(), np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def chunks(self, text: str) -> list[str]:
        """White-space separated chunks, normalised; no word reaches over white space."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("\u03a3", "\u03c3").lower()
        if _INFORMATION.search(text):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def pieces(self, chunk: str) -> list[str]:
        if chunk.isascii() or not self.newer.keys() & set(map(ord, chunk)):
            return self.pattern.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(chunk.translate(self.newer))]

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token's string stands for itself."""
        out: list[str] = []
        at = 0
        for m in self.splitter.finditer(text) if self.splitter and "<" in text else ():
            out += self._words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._words(text[at:]) if at else self._words(text)

    def _words(self, text: str) -> list[str]:
        out: list[str] = []
        add = out.append
        for chunk in self.chunks(text):
            if chunk.isalpha():
                add(chunk)
            elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                add(chunk[:-1])
                add(chunk[-1])
            else:
                out += self.pieces(chunk)
        return out

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids and its token strings, both joined by spaces."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = dict(self.constant), self.cache
        cache, older = self.cache, self.older
        parted = [self.words(t) for t in texts]
        new = set().union(*parted).difference(cache)
        for word in new & older.keys():
            cache[word] = older[word]
        fresh = list(new.difference(older))
        names, numbers = self.names, self.id_texts
        for word, ids in zip(fresh, self.encode_words(fresh) if fresh else ()):
            cache[word] = " ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids])
        out = []
        for words in parted:
            found = [cache[w] for w in words]
            out.append((" ".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The token strings joined by spaces, as a vocabulary without a decoder reads."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def bpe(docs: DataFrame, carry, path: str | None = None, text: str = "text") -> DataFrame:
    """``row`` (the carried columns) with the token ids of each whole text and their decoded text."""
    where = path or default_vocabulary()

    def run(texts: list[str]):
        known = vocabulary(where)
        ids = [[int(i) for i in joined.split()] for joined, _ in known.encode_texts(texts)]
        return [pa.array(ids, type=pa.list_(pa.int32())), [known.decode(i) for i in ids]]

    return per_document(docs, run, "ids array<int>, decoded string", carry, text)


def bpe_digests(docs: DataFrame, carry, path: str | None = None, text: str = "text") -> DataFrame:
    """``row`` with the number of tokens and sha256 of the ids and of the decoded text."""
    where = path or default_vocabulary()

    def run(texts: list[str]):
        known, out = vocabulary(where), []
        for joined, names in known.encode_texts(texts):
            out.append((
                joined.count(" ") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(),
                hashlib.sha256(names.encode()).hexdigest(),
            ))
        return list(zip(*out))

    return per_document(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", carry, text)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(docs, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256"
    )
