"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens by the tokenizer's pattern. The distinct
pre-tokens of a batch that have not been met before become one ragged numpy
array of symbols; in each round every sequence merges all occurrences of its
own lowest-rank pair at once, until no sequence has a pair with a rank. What
remains of each sequence is its number of tokens. Counts of pre-tokens are
remembered in a store of bounded size, so a frequent word is merged once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cells, map_batches, texts_of

#: Pre-tokens whose counts a worker remembers; beyond it the store starts anew.
REMEMBERED = 600_000
#: Longest pre-token, in code points, that is remembered.
REMEMBERED_CHARS = 64
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


#: Settings of a file that the arrays and the pattern below stand for; absent ones have the library's defaults.
PLAIN = {
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def check_settings(spec: dict) -> None:
    """Raises for a tokenizer file whose settings this counter does not follow, rather than counting otherwise than the library."""
    wrong = [] if spec.get("normalizer") is None else ["normalizer"]
    defaults = {"type": "BPE", "add_prefix_space": True, "use_regex": True, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    for part in ("pre_tokenizer", "model"):
        own = spec.get(part) or {}
        wrong += [f"{part}.{k}" for k, v in PLAIN[part].items() if (own.get(k, defaults.get(k)) or None) != (v or None)]
    wrong += [f"added token {t['content']}" for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class ByteBpe:
    """A byte-level BPE vocabulary as arrays. The file is that of the tokenizers library; one with other settings is refused."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        first = np.array([vocab[a] for a, _ in pairs], np.int64)
        second = np.array([vocab[b] for _, b in pairs], np.int64)
        self.base = max(vocab.values()) + 1
        keys = first * self.base + second
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # a hash table over the keys; the few that share a slot are searched for
        slot = self.slot(self.keys)
        self.table = np.full(1 << 20, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        self.shared = np.bincount(slot, minlength=1 << 20) > 1
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # below U+0530 the pattern's classes are listed, for the faster library; beyond, its tables of Unicode differ in places, and the tokenizer itself splits
        few = {k: "".join(re.escape(chr(c)) for c in range(0x530) if regex.match(k, chr(c))) for k in (r"\s", r"\p{L}", r"\p{N}")}
        space, letter, number = few.values()
        self.pattern = re.compile(f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.beyond = re.compile("[\u0530-\U0010ffff]")
        self.library = Tokenizer.from_file(path)

    def pre_tokens(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """The texts between special tokens, and the number of these."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text], 0
        found = self.split_special.split(text)
        return found, len(found) - 1

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        slot = self.slot(key)
        at = self.table[slot]
        if len(more := np.flatnonzero(self.shared[slot])):
            at[more] = np.minimum(np.searchsorted(self.keys, key[more]), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of all words, one word after the other, and each word's number of them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        counts = np.array([len(b) for b in raw], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        out: list[tuple[np.ndarray, np.ndarray]] = []  # finished: word, symbol
        word = np.repeat(np.arange(len(words)), counts)
        while len(symbols):
            last = np.empty(len(symbols), bool)
            last[-1], last[:-1] = True, word[1:] != word[:-1]
            if not out:
                ranks = np.full(len(symbols), NONE, np.int32)
                inner = np.flatnonzero(~last)
                ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(symbols))))
            done = lowest == NONE
            out.append((word[done], symbols[done]))
            hit = np.flatnonzero((ranks == lowest) & ~done)
            # a run of one letter: its pairs overlap, and every other one is merged, from the left
            run = np.concatenate(([True], (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]]))) if len(hit) else np.empty(0, bool)
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0] if len(hit) else hit
            symbols = symbols.copy()
            symbols[hit] = self.merged[ranks[hit]]
            keep = ~done
            keep[hit + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[hit] = True
            before = hit[hit > 0] - 1
            # the neighbour to the left of a merged symbol, past a symbol that has just gone
            before = np.where(keep[before], before, before - 1)
            touched[before[before >= 0]] = True
            symbols, word, ranks, touched = symbols[keep], word[keep], ranks[keep], np.flatnonzero(touched[keep])
            if len(symbols):
                ranks = ranks.copy()
                end = touched + 1 >= len(symbols)
                nxt = np.minimum(touched + 1, len(symbols) - 1)
                apart = end | (word[nxt] != word[touched])
                ranks[touched] = np.where(apart, NONE, self.rank(symbols[touched], symbols[nxt]))
        if not out:
            return np.empty(0, np.int32), counts
        word, symbols = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))


def load(path: str) -> ByteBpe:
    store = cells("bpe")
    if path not in store:
        store[path] = ByteBpe(path)
    return store[path]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that gives the number of tokens of each text."""
    bpe, known = load(path), cells("bpe-counts").setdefault(path, {})

    def count(texts: list[str]) -> list[int]:
        found, extra = [], []
        for text in texts:
            parts, special = bpe.parts(text)
            extra.append(special)
            found.append(bpe.pre_tokens(parts[0]) if len(parts) == 1 else [w for p in parts for w in bpe.pre_tokens(p)])
        new = list(set().union(*found) - known.keys())
        here = known
        if new:
            counts = bpe.merge(new)[1].tolist()
            fresh = dict(zip(new, counts))
            if len(known) + len(new) > REMEMBERED:
                here = {**{w: known[w] for w in set().union(*found) if w in known}, **fresh}
                known.clear()
                known.update((w, n) for w, n in here.items() if len(w) <= REMEMBERED_CHARS)
            else:
                known.update((w, n) for w, n in fresh.items() if len(w) <= REMEMBERED_CHARS)
                if any(len(w) > REMEMBERED_CHARS for w in new):
                    here = {**known, **{w: n for w, n in fresh.items() if len(w) > REMEMBERED_CHARS}} if len(known) < 2000 else _Both(known, fresh)
        get = here.__getitem__
        return [sum(map(get, words)) + more for words, more in zip(found, extra)]

    return count


class _Both:
    """Two dictionaries as one."""

    def __init__(self, a: dict, b: dict):
        self.a, self.b = a, b

    def __getitem__(self, key: str) -> int:
        n = self.a.get(key)
        return self.b[key] if n is None else n


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of df.

    Whole texts are counted; the count is that of the tokenizers library without
    added tokens, a special token's string inside a text being that one token.
    A null or empty text has 0 bytes and 0 tokens. Rows are independent:
    repeated rows and null ids are returned as they come, an empty table gives
    an empty one, and other columns, whatever their names, are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, text_col)
        n = counter(tokenizer)(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), pa.array([len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", rows=500)
