"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word's leaves are its adjacent pairs, keyed by (merge rank, place); the root is therefore the leftmost pair of lowest
rank. A merge changes three leaves, each updated up its path, until the root holds no mergeable pair. Many words go
through the same steps at once, as rows of arrays; the words of a batch of texts are encoded once each.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, with_column

_NONE = np.iinfo(np.int64).max
#: Words kept encoded between batches of a task, leaves of the trees that are built together, and leaves from which a
#: word's tree is worked alone: few words are that long, and each takes very many steps.
KEPT_WORDS, LEAVES_AT_ONCE, LONG_TREE = 200_000, 1 << 18, 1 << 10
#: White space as Unicode defines it; Python's own classes also hold the four separators from U+001C.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class _Numbers(dict):
    """Words, numbered as they are first asked for; fresh holds those that are not encoded yet."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if printable, else one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in out:
            out[b], more = chr(256 + more), more + 1
    return [out[b] for b in range(256)]


class WordBPE:
    """A BPE whose words end in a suffix, from a tokenizers file with NFC, lower case and a word pattern."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [""] * self.size
        for t, i in vocab.items():
            self.tokens[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t
        self.gaps = not all(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        low = max([*self.inner.tolist(), *self.final.tolist()]) + 1  # ranks of pairs of bytes, where words begin
        left, right = np.divmod(np.arange(low * low), low)
        self.first_ranks, self.low = self.rank(left, right), low
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.any_words = None
        self.rank_of: dict[int, int] | None = None
        # The same pattern for texts below U+0100, where the letters can be listed.
        letter = "".join(f"\\x{i:02x}" for i in range(256) if chr(i).isalpha())
        number = "".join(f"\\x{i:02x}" for i in range(256) if unicodedata.category(chr(i))[0] == "N")
        self.latin_words = re.compile(rf"[{letter}]+|'(?:[stmd]|re|ve|ll)|[{number}]|[^{_SPACE}{letter}{number}]+").findall
        self.forget()

    @classmethod
    def load(cls, spec: str) -> WordBPE:
        return cls(json.loads(spec))

    def forget(self) -> None:
        self.code = _Numbers()
        self.code.update((w, k) for k, w in enumerate(self.special))
        self.pool, self.count = np.array([*self.special.values()], np.int64), np.ones(len(self.special), np.int64)
        self.start = np.arange(len(self.special))

    def words(self, text: str) -> list[str]:
        """The words of a text that holds no special token."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        try:
            text.encode("latin-1")
            return self.latin_words(text)
        except UnicodeEncodeError:
            pass
        if self.any_words is None:
            import regex

            self.any_words = regex.compile(rf"[\p{{L}}]+|'(?:[stmd]|re|ve|ll)|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+").findall
        return self.any_words(text)

    def pieces(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        if "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.words(part)
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; a number beyond all ranks if it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        counts = np.empty(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        width = 1 << np.ceil(np.log2(np.maximum(size - 1, 1))).astype(np.int64)
        for leaves in np.unique(width).tolist():
            mine = np.flatnonzero(width == leaves)
            if leaves >= LONG_TREE:
                for i in mine.tolist():
                    ids = self._merge_long(symbols[ends[i] - size[i] : ends[i]].tolist(), leaves)
                    counts[i] = len(ids)
                    parts.append((np.array([i]), np.array(ids, np.int64)))
                continue
            step = max(1, LEAVES_AT_ONCE // leaves)
            for i in range(0, len(mine), step):
                some = mine[i : i + step]
                ids, n = self._merge(symbols, ends[some] - size[some], size[some], leaves)
                counts[some] = n
                parts.append((some, ids))
        out = np.empty(counts.sum(), np.int64)
        at = np.cumsum(counts) - counts
        for some, ids in parts:
            n = counts[some]
            out[np.repeat(at[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, counts

    def _merge(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        n, wide, top = len(start), leaves + 2, len(self.keys)
        place = np.arange(wide)
        held = place < size[:, None]
        sym = np.zeros((n, wide), np.int64)
        sym[held] = symbols[(start[:, None] + place)[held]]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * leaves), _NONE)
        bits = leaves.bit_length() - 1 if leaves > 1 else 1
        pair = place[:leaves] < size[:, None] - 1
        r = self.first_ranks[sym[:, :leaves][pair] * self.low + sym[:, 1 : leaves + 1][pair]]
        leaf = np.full((n, leaves), _NONE)
        leaf[pair] = np.where(r < top, (r << bits) | np.broadcast_to(place[:leaves], (n, leaves))[pair], _NONE)
        tree[:, leaves:] = leaf
        for level in (1 << k for k in range(leaves.bit_length() - 2, -1, -1)):
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        tree, sym, after, before, alive = tree.ravel(), sym.ravel(), after.ravel(), before.ravel(), held.ravel()
        live = np.arange(n)
        root = tree[live * 2 * leaves + 1] if leaves > 1 else tree[live * 2 + 1]
        while True:
            live = live[root < _NONE]
            if not len(live):
                break
            root = root[root < _NONE]
            row, node, last = live * wide, live * 2 * leaves, size[live]
            at, new = root & ((1 << bits) - 1), self.merged[root >> bits]
            gone = after[row + at]
            then = after[row + gone]
            sym[row + at], after[row + at], before[row + then] = new, then, at
            alive[row + gone] = False
            prior = before[row + at]
            right = self.rank(new, sym[row + then])
            right = np.where((then < last) & (right < top), (right << bits) | at, _NONE)
            has = prior >= 0
            left = self.rank(sym[row + np.maximum(prior, 0)], new)
            left = np.where(left < top, (left << bits) | np.maximum(prior, 0), _NONE)
            a = node + leaves + at
            b = np.where(gone < leaves, node + leaves + gone, a)
            c = np.where(has, node + leaves + prior, a)
            tree[b] = _NONE
            tree[c] = left
            tree[a] = right
            paths = [x - node for x in (a, b, c)]
            for _ in range(leaves.bit_length() - 1):
                for k, x in enumerate(paths):
                    paths[k] = x = x >> 1
                    two = node + 2 * x
                    tree[node + x] = np.minimum(tree[two], tree[two + 1])
            root = tree[node + 1]
        alive = alive.reshape(n, wide)
        return sym.reshape(n, wide)[alive], alive.sum(1)

    def _merge_long(self, sym: list[int], leaves: int) -> list[int]:
        """The same for one long word, step by step: a merge costs three paths of the tree and no arrays."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank_of, merged, size, n = self.rank_of, self.merged, self.size, len(sym)
        none = _NONE
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = rank_of.get(sym[i] * size + sym[i + 1])
            if r is not None:
                tree[leaves + i] = r * leaves + i
        for node in range(leaves - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = leaves + place
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                if b < a:
                    a = b
                if tree[node] == a:
                    return  # nothing changes above
                tree[node] = a
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone, new = after[at], int(merged[rank])
            then = after[gone]
            sym[at], sym[gone], after[at] = new, -1, then
            if gone < n - 1:  # the last symbol begins no pair
                put(gone, none)
            right = None
            if then < n:
                before[then] = at
                right = rank_of.get(new * size + sym[then])
            put(at, none if right is None else right * leaves + at)
            prior = before[at]
            if prior >= 0:
                left = rank_of.get(sym[prior] * size + new)
                put(prior, none if left is None else left * leaves + prior)
        return [x for x in sym if x >= 0]

    def learn(self) -> None:
        """Encode the words that were met for the first time."""
        fresh = self.code.fresh
        if fresh:
            ids, counts = self.encode_words(fresh)
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(counts) - counts))
            self.pool, self.count = np.concatenate((self.pool, ids)), np.concatenate((self.count, counts))
            fresh.clear()

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words among the words kept."""
        if len(self.code) > KEPT_WORDS:
            self.forget()
        number = self.code.__getitem__
        out = [np.array([*map(number, self.pieces(t))], np.int64) for t in texts]
        self.learn()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for c in self.codes(texts):
            n = self.count[c]
            out.append(self.pool[np.repeat(self.start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return [int(self.count[c].sum()) for c in self.codes(texts)]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces: the vocabulary names no decoder. Ids without a token are skipped."""
        if self.gaps or (ids and (min(ids) < 0 or max(ids) >= self.size)):
            return " ".join(self.tokens[i] for i in ids if 0 <= i < self.size and self.tokens[i])
        return " ".join(map(self.tokens.__getitem__, ids))


def read_spec(spark: SparkSession, path: str) -> str:
    """A tokenizer file, read on the driver (some MB, whatever the corpus) and handed to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _texts_at_once(texts: list[str], chars: int = 1 << 22) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > chars:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def with_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids (array of int) of its text column; a null or empty text has none.

    Texts of any length are encoded whole; repeated rows alike. Where a column is named as out is, out gets underscores
    behind it. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(docs.sparkSession, path))

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBPE.load(spec.value)
        for s in batches:
            yield pd.Series([ids.astype(np.int32) for some in _texts_at_once([t or "" for t in s.tolist()]) for ids in bpe.encode(some)], dtype=object)

    return with_column(docs, out, encoded(F.col(text)))


def with_token_count(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of token ids of its text column, as with_tokens() would give them."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(docs.sparkSession, path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBPE.load(spec.value)
        for s in batches:
            yield pd.Series([n for some in _texts_at_once([t or "" for t in s.tolist()]) for n in bpe.lengths(some)], dtype="int64")
        del bpe  # with the words that it keeps
        give_back()

    return with_column(docs, out, counted.asNondeterministic()(F.col(text)))  # so that a filter on it does not run it again


def with_decoded(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the text that its ids stand for; null ids stand for an empty text. A taken name gets underscores."""
    spec = tokens.sparkSession.sparkContext.broadcast(read_spec(tokens.sparkSession, path))

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBPE.load(spec.value)
        for s in batches:
            yield pd.Series([bpe.decode([] if x is None else list(x)) for x in s.tolist()], dtype=object)

    return with_column(tokens, out, decoded(F.col(ids)))


def token_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded, both digested at once.

    A null text counts as empty; repeated rows give repeated rows; texts of any length are encoded whole; no other
    column is read. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(docs.sparkSession, path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = WordBPE.load(spec.value)
        for s in batches:
            rows = []
            for some in _texts_at_once([t or "" for t in s.tolist()]):
                for ids in bpe.encode(some):
                    back = bpe.decode(ids.tolist())
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.col(text)).alias("_d")).select("doc_id", "_d.*")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
