"""Language-model scores: an interpolated modified Kneser-Ney model of order 3.

Counting runs in Spark. Every partition counts its own words or word triples with
numpy and cuts the sorted result into ranges; one shuffle brings a range's
pieces to one task, which merges them and writes the sum as sorted arrays, one
file for each range, into the shared folder:

1. words: 64-bit hashes and counts. A word's number is its rank in that order.
2. triples, by their middle word v, so that both what follows (u, v) and what
   stands before (v, w) is in one place: for each v the words u before it; for
   each (u, v) the words w after it, in order, with counts; and for each (v, w)
   how many different u were seen. The triples of a middle word with more than
   its share of all words are spread over all ranges by u.
3. continuations: for each w, before it how many different v were seen, and the
   sums of (v, w) whose v is spread.

Counts take one byte, the few larger ones stand in lists of their own. Pieces are
packed (differences, bytes by place, zstd) before they are shuffled. Workers map
the files into memory and look up each distinct word, pair and triple of a batch
by binary search; nothing of the model is loaded, sent or broadcast but its sizes
and the frequent words (FREQUENT times the ranges at most). Ranges are as many as
the session's shuffle partitions, however the input is split.

P(w | u v) = max(c(uvw) - D(c(uvw)), 0) / c(uv) + L(uv) * P(w | v), L the
discounted mass over c(uv), with P(w | v) the same from the numbers of different
words before (v, w), P(w) from those before w, and below that 1 / (V + 1) for
each of V words and an unknown one. D for counts of one, two, and three or more
comes from the counts of counts. A text begins with two marks that are no words.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, publish, scratch

#: The hash that stands for the end of a text, and the bytes from which a word is hashed by itself.
END, LONG = 0, 256
#: Words or triples that a task holds before it sorts and sends them.
HELD = 4_000_000
#: A word is frequent if it has more than 1 / FREQUENT of a range's words.
FREQUENT = 4
#: Texts of a batch, and followers from which a pair's sums are stored.
ROWS, MANY = 500, 16
BLOCK = "part int, data binary"


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays; it appears under its name once it is whole."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
    about, at = {}, 0
    for k, v in arrays.items():
        about[k] = (v.dtype.str, len(v), at)
        at += -(-v.nbytes // 8) * 8
    head = json.dumps(about).encode()
    head += b" " * (-len(head) % 8)
    with store.open_output_stream(temp) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 8))
    publish(store, temp, f"{base}/{name}")


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory. A file of a store that is no folder here is copied to a nameless temporary file first."""
    if folder.startswith(("file:", "/")):
        raw = np.memmap(f"{folder.removeprefix('file://').removeprefix('file:')}/{name}", np.uint8, "r")
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{base}/{name}") as f, tempfile.TemporaryFile(dir=os.environ.get("TMPDIR")) as own:
            while piece := f.read(1 << 24):
                own.write(piece)
            own.flush()
            raw = np.memmap(own, np.uint8, "r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    about = json.loads(raw[8 : 8 + n].tobytes())
    return {k: np.frombuffer(raw, np.dtype(d), size, 8 + n + at) for k, (d, size, at) in about.items()}


SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The low bytes of eight that belong to a word of so many.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x, others for each x."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of texts in order, END (0) after each text, and the number of each text's.

    Bytes of a batch are looked at together: words are what stands between white
    space, and are hashed eight bytes at a time, all words at once.
    """
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
    whole = b" ".join([b"", *raw, bytes(8)]).lower()  # bytes know letters of ASCII only
    # the last eight bytes are there to be read past a word's end, and are no word
    bytes_of = np.frombuffer(whole, np.uint8)
    gap = SPACES[bytes_of]
    edge = np.flatnonzero(gap[1:-8] != gap[:-9]) + 1
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
    out = stirred(lengths.astype(np.uint64) + np.uint64(1)) ^ (eight[starts] & LOW_BYTES[np.minimum(lengths, 8)])
    out = stirred(out)
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more) and at < LONG:
        out[more] = stirred(out[more] ^ (eight[starts[more] + at] & LOW_BYTES[np.minimum(lengths[more] - at, 8)]))
        at += 8
        more = more[lengths[more] > at]
    if len(more):
        from xxhash import xxh64_intdigest

        out[more] = [xxh64_intdigest(whole[k : k + n]) for k, n in zip(starts[more].tolist(), lengths[more].tolist())]
    ends = np.cumsum([1 + len(x) for x in raw])
    words = np.searchsorted(starts, ends)  # words before each text's end
    sizes = np.diff(words, prepend=0) + 1
    tokens = np.full(len(out) + len(raw), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = np.where(out == END, np.uint64(1), out)
    return tokens, sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def summed_pairs(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low) in order, with the sums of their counts. low has 32 bits."""
    if not len(high):
        return high, low, counts
    order = np.lexsort((low, high)) if len(high) < 2 else _order(high, low)
    high, low, counts = high[order], low[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    return high[first], low[first], np.add.reduceat(counts, first)


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of (high, low); by one sort where what differs in them fits 64 bits."""
    v, u, w = high >> np.uint64(32), high & np.uint64(0xFFFFFFFF), low.astype(np.uint64)
    v = v - v.min()
    bits = [int(x.max()).bit_length() for x in (v, u, w)]
    if sum(bits) > 64:
        return np.lexsort((low, high))
    return np.argsort((v << np.uint64(bits[1] + bits[2])) | (u << np.uint64(bits[2])) | w)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: the first, sorted one by differences; bytes of a place stand together."""
    import zstandard

    planes = []
    for k, x in enumerate(arrays):
        x = np.diff(x, prepend=x.dtype.type(0)) if k == 0 else x
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(raw) // width, 0, []
    for j, kind in enumerate(kinds):
        size = np.dtype(kind).itemsize
        x = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n)
        out.append(np.cumsum(x, dtype=kind) if j == 0 else x)
        at += n * size
    return out


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash; ranges follow the order of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def number_range(numbers: np.ndarray, ranges: int, words: int) -> np.ndarray:
    """The range of a word's number; ranges follow the order of numbers."""
    return np.minimum(numbers.astype(np.int64) * ranges // (words + 1), ranges - 1)


def blocks(part: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each range that has entries; arrays are in the order of the first."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    for p, own in zip(parts.tolist(), np.split(order, first[1:])):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed(*(x[own] for x in arrays))], pa.binary())], names=["part", "data"])


def counted(docs: DataFrame, text: str, find: Callable, add: Callable, split: Callable) -> DataFrame:
    """Blocks of the sums, by add(), of what find(texts) gives for each batch of texts, cut by split()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(find(batch.column(0).slice(at, ROWS)))
                size += len(held[-1][0])
                if size >= HELD:
                    held = [add(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield from blocks(split(*held[0]), *held[0])
                        held, size = [], 0
        if held:
            found = add(*(np.concatenate(x) for x in zip(*held)))
            yield from blocks(split(*found), *found)

    return docs.select(text).mapInArrow(run, BLOCK)


def merged(found: DataFrame, ranges: int, kinds: tuple, add: Callable, write: Callable, schema: str) -> DataFrame:
    """What write(part, sums) gives, as batches, for the sums of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0

        def total() -> tuple[np.ndarray, ...]:
            return add(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                if part != current:
                    if held:
                        yield from write(current, *total())
                    current, held, size = part, [], 0
                *keys, counts = unpacked(data.as_buffer(), *kinds)
                held.append((*keys, counts.astype(np.int64)))
                size += len(counts)
                if size >= HELD:
                    held = [total()]
                    size = len(held[0][0]) // 2
        if held:
            yield from write(current, *total())

    return found.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def one_byte(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts up to 254 as bytes, and the places and values of the others."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.uint64)


def count_at(f: dict[str, np.ndarray], name: str, place: np.ndarray) -> np.ndarray:
    c = f[name][place].astype(np.int64)
    big = np.flatnonzero(c == 255)
    if len(big):
        c[big] = f[f"{name}_large"][np.searchsorted(f[f"{name}_large_at"], place[big])]
    return c


def among(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted value in its own stretch [low, high) of sorted values, and whether it is there."""
    place, hit = low.copy(), np.zeros(len(low), bool)
    todo = np.flatnonzero(low < high)
    low, high, wanted = low[todo], high[todo] - 1, wanted[todo]
    while len(todo):  # what is wanted lies in [low, high], if it is there
        done = low >= high
        if 4 * np.count_nonzero(done) >= len(done):
            some = todo[done]
            place[some] = low[done]
            hit[some] = values[low[done]] == wanted[done]
            left = ~done
            todo, low, high, wanted = todo[left], low[left], high[left], wanted[left]
        middle = (low + high) >> 1
        less = values[middle] < wanted
        low = np.where(less, np.minimum(middle + 1, high), low)
        high = np.where(less, high, middle)
    return place, hit


class Words:
    """The numbers and counts of words."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.ranges = folder, len(sizes)
        self.bases = np.concatenate(([0], np.cumsum(sizes)))
        self.files: dict[int, dict[str, np.ndarray]] = {}

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and counts of the distinct tokens of texts, the tokens as places in these, and the number of each text's."""
        tokens, sizes = hashed(texts)
        kinds, tokens = np.unique(tokens, return_inverse=True)
        return *self.find(kinds), tokens, sizes

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 for unknown words) and counts of hashes in order."""
        part = range_of(hashes, self.ranges)
        numbers, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        parts, first = np.unique(part, return_index=True)
        for p, a, b in zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(hashes)]):
            if self.bases[p] == self.bases[p + 1]:
                continue
            if p not in self.files:
                self.files[p] = map_arrays(self.folder, f"words-{p}")
            f = self.files[p]
            at = np.minimum(np.searchsorted(f["hashes"], hashes[a:b]), len(f["hashes"]) - 1)
            known = f["hashes"][at] == hashes[a:b]
            numbers[a:b] = np.where(known, at + self.bases[p], -1)
            counts[a:b] = np.where(known, f["counts"][at], 0)
        return numbers, counts


def before(w: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the word two before it and the one before it, `begin` where the text begins."""
    starts = np.cumsum(sizes) - sizes
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[starts] = begin
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[starts] = begin
    return u, v


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two numbers of 32 bits as one."""
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def parted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def triple_range(vu: np.ndarray, ranges: int, words: int, frequent: np.ndarray) -> np.ndarray:
    """The range of a triple by (v, u): that of v, or of u where v is frequent."""
    v, u = parted(vu)
    return number_range(np.where(np.isin(v, frequent), u, v), ranges, words)


def discounts(counts: list[int]) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and 3 or more, from how many things were counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(int(x), 0) for x in counts)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    out = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.0), k - 0.05) if k else 0.0 for k, d in enumerate(out)])


def count_kinds(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, and how many there are."""
    return [*(int((counts == k + 1).sum()) for k in range(4)), len(counts)]


class Model:
    """A model whose arrays lie in a folder; only its sizes are held."""

    def __init__(self, folder: str, about: dict):
        self.folder, self.about = folder, about
        self.words = Words(folder, about["sizes"])
        self.n, self.v, self.ranges = about["tokens"], sum(about["sizes"]), len(about["sizes"])
        self.frequent = np.array(sorted(int(k) for k in about["frequent"]), np.int64)
        #: Of each frequent word: different pairs (u, w) around it, and (v, w) with 1, 2, and more u.
        self.sums = np.array([about["frequent"][str(k)] for k in self.frequent.tolist()], np.float64).reshape(-1, 4)
        self.d3, self.d2, self.d1 = (discounts(about[k][:4]) for k in ("triples", "pairs", "follows"))
        self.types = max(about["pairs"][4], 1)
        f = about["follows"]
        # with nothing to learn from, all is left to the one unknown word
        self.rest = float((self.d1[1] * f[0] + self.d1[2] * f[1] + self.d1[3] * (f[4] - f[0] - f[1])) / self.types) if about["pairs"][4] else 1.0
        self.there = {k: set(x) for k, x in about["there"].items()}
        self.files: dict[tuple[str, int], dict[str, np.ndarray]] = {}

    def by_range(self, kind: str, part: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """Each range's file, with the places whose range it is; ranges without a file are left out."""
        order = np.argsort(part, kind="stable")
        parts, starts = np.unique(part[order], return_index=True)
        for p, own in zip(parts.tolist(), np.split(order, starts[1:])):
            if p in self.there[kind]:
                if (kind, p) not in self.files:
                    self.files[kind, p] = map_arrays(self.folder, f"{kind}-{p}")
                yield self.files[kind, p], own

    def single(self, number: np.ndarray) -> np.ndarray:
        """P(w); for -1 that of an unknown word."""
        follows = np.zeros(len(number), np.int64)
        for f, own in self.by_range("follows", np.where(number < 0, -1, number_range(number, self.ranges, self.v))):
            place = np.minimum(np.searchsorted(f["words"], number[own].astype(np.uint32)), len(f["words"]) - 1)
            follows[own] = np.where(f["words"][place] == number[own], f["counts"][place], 0)
        return np.maximum(follows - self.d1[np.minimum(follows, 3)], 0) / self.types + self.rest / (self.v + 1)

    def pairs(self, vw: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P(w | v) of distinct pairs in order; low: their P(w). Neither word is unknown, or only w (all ones)."""
        v, w = parted(vw)
        count, mass, total = (np.zeros(len(vw)) for _ in range(3))
        spread = np.isin(v, self.frequent)
        for f, own in self.by_range("triples", np.where(spread, -1, number_range(v, self.ranges, self.v))):
            at = np.minimum(np.searchsorted(f["v"], v[own].astype(np.uint32)), len(f["v"]) - 1)
            known = f["v"][at] == v[own]
            lo, hi = f["v_pairs"][at].astype(np.int64), f["v_pairs"][at + 1].astype(np.int64)
            place, hit = among(f["w2"], lo, np.where(known, hi, lo), w[own].astype(np.uint32))
            hit &= known
            count[own[hit]] = count_at(f, "c2", place[hit])
            one, two = f["one"][at].astype(np.int64), f["two"][at].astype(np.int64)
            mass[own] = np.where(known, self.d2[1] * one + self.d2[2] * two + self.d2[3] * (hi - lo - one - two), 0)
            total[own] = np.where(known, f["total"][at], 0)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, v), len(self.frequent) - 1)
            total = np.where(spread, self.sums[at, 0], total)
            mass = np.where(spread, self.sums[at, 1:] @ self.d2[1:], mass)
            for f, own in self.by_range("spread", np.where(spread & (w != 0xFFFFFFFF), number_range(w, self.ranges, self.v), -1)):
                place = np.minimum(np.searchsorted(f["keys"], vw[own]), len(f["keys"]) - 1)
                hit = f["keys"][place] == vw[own]
                count[own[hit]] = f["counts"][place[hit]]
        some = total > 0
        p = low.copy()
        kinds = np.minimum(count[some], 3).astype(np.int64)
        p[some] = (np.maximum(count[some] - self.d2[kinds], 0) + mass[some] * low[some]) / total[some]
        return p

    def triples(self, vu: np.ndarray, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of triples, in order, with the total of (u, v) and its discounted mass; first: the place of each (v, u)'s first triple."""
        own_vu = vu[first]
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(vu))))
        v, u = parted(own_vu)
        count, total, mass = np.zeros(len(vu), np.int64), np.zeros(len(first)), np.zeros(len(first))
        where = np.append(first, len(vu))
        for f, own in self.by_range("triples", triple_range(own_vu, self.ranges, self.v, self.frequent)):
            at = np.minimum(np.searchsorted(f["v"], v[own].astype(np.uint32)), len(f["v"]) - 1)
            known = f["v"][at] == v[own]
            lo = f["v_before"][at].astype(np.int64)
            place, hit = among(f["u"], lo, np.where(known, f["v_before"][at + 1].astype(np.int64), lo), u[own].astype(np.uint32))
            own, place = own[hit & known], place[hit & known]
            begin, end = f["after"][place].astype(np.int64), f["after"][place + 1].astype(np.int64)
            total[own], mass[own] = self.sums_of(f, place, begin, end)
            size = where[own + 1] - where[own]
            mine = np.repeat(where[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(own) else np.empty(0, np.int64)
            at3, hit3 = among(f["w3"], np.repeat(begin, size), np.repeat(end, size), w[mine].astype(np.uint32))
            count[mine[hit3]] = count_at(f, "c3", at3[hit3])
        return count, total[group], mass[group]

    def sums_of(self, f: dict[str, np.ndarray], place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The total and the discounted mass of what follows pairs: stored for those with many followers, else added up."""
        total, one, two = (np.zeros(len(place), np.int64) for _ in range(3))
        n = end - begin
        for j in range(MANY):
            some = np.flatnonzero((n > j) & (n < MANY))
            if not len(some):
                break
            c = count_at(f, "c3", begin[some] + j)
            total[some] += c
            one[some] += c == 1
            two[some] += c == 2
        many = np.flatnonzero(n >= MANY)
        if len(many):
            at = np.searchsorted(f["many"], place[many].astype(np.uint32))
            total[many], one[many], two[many] = (f[k][at] for k in ("many_total", "many_one", "many_two"))
        return total.astype(np.float64), self.d3[1] * one + self.d3[2] * two + self.d3[3] * (n - one - two)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        numbers, counts, tokens, sizes = self.words.read(texts)
        of = np.repeat(np.arange(len(sizes)), sizes)
        single = self.single(numbers)
        w = numbers[tokens]
        u, v = before(w, sizes, self.v)
        w = np.where(w < 0, 0xFFFFFFFF, w)
        p = single[tokens]
        ask = np.flatnonzero(v >= 0)
        vw, first, back = np.unique(joined(v[ask], w[ask]), return_index=True, return_inverse=True)
        p[ask] = self.pairs(vw, p[ask][first])[back]
        ask = np.flatnonzero((v >= 0) & (u >= 0))
        order = ask[_order(joined(v[ask], u[ask]), w[ask])] if len(ask) else ask
        vu, ww = joined(v[order], u[order]), w[order]
        new = np.concatenate(([True], vu[1:] != vu[:-1])) if len(vu) else np.empty(0, bool)
        count, total, mass = self.triples(vu, ww, np.flatnonzero(new))
        some = total > 0
        order, count = order[some], count[some]
        p[order] = (np.maximum(count - self.d3[np.minimum(count, 3)], 0) + mass[some] * p[order]) / total[some]
        add = lambda x: np.bincount(of, x, minlength=len(texts))
        base = np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))
        return sizes, add((counts > 0)[tokens]).astype(np.int64), add(base[tokens]), add(np.log10(p))


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it has ended, as nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def train(docs: DataFrame, text: str = "text") -> tuple[str, dict]:
    """Learns from all rows of docs; gives the model's folder and what a Model needs to know of it."""
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = scratch(spark, "lm")

    def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kinds, counts = np.unique(hashed(texts)[0], return_counts=True)
        return kinds, counts.astype(np.uint32)

    def write_words(part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        write_arrays(folder, f"words-{part}", {"hashes": keys, "counts": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64)})
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["part", "n", "tokens"])

    def narrow(*found: np.ndarray) -> tuple[np.ndarray, ...]:
        return (*found[:-1], found[-1].astype(np.uint32))

    with shuffles_cleaned(spark):
        pieces = counted(docs, text, words, lambda *x: narrow(*summed(*x)), lambda keys, _: range_of(keys, ranges))
        found = merged(pieces, ranges, (np.uint64, np.uint32), summed, write_words, "part int, n bigint, tokens bigint").collect()  # a row for each range
    sizes = [0] * ranges
    for r in found:
        sizes[r["part"]] = r["n"]
    bases = np.concatenate(([0], np.cumsum(sizes)))
    v, n = int(bases[-1]), sum(r["tokens"] for r in found)
    if v >= (1 << 32) - 2:
        raise OverflowError("the model numbers words with 32 bits")

    def find_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if sizes[part]:
                    counts = map_arrays(folder, f"words-{part}")["counts"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts * float(FREQUENT * ranges) > n) + bases[part], pa.int64())], names=["word"])

    # of all words together, FREQUENT times the ranges at most can have such a share
    large = spark.range(0, ranges, 1, ranges).mapInArrow(find_frequent, "word bigint").collect()
    frequent = np.array(sorted(r["word"] for r in large), np.int64)

    def triples(texts: pa.Array) -> tuple[np.ndarray, ...]:
        store = cells("lm")
        if folder not in store:
            store.clear()
            store[folder] = Words(folder, sizes)
        numbers, _, tokens, own = store[folder].read(texts)
        w = numbers[tokens]
        u, m = before(w, own, v)
        return joined(m, u), w.astype(np.uint32), np.ones(len(w), np.uint32)

    def write_triples(part: int, vu: np.ndarray, w: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], vu[1:] != vu[:-1])))
        middle, u = parted(vu[first])
        v_first = np.flatnonzero(np.concatenate(([True], middle[1:] != middle[:-1])))
        after = np.append(first, len(vu))
        out = {"v": middle[v_first].astype(np.uint32), "v_before": np.append(v_first, len(middle)).astype(np.uint32), "u": u.astype(np.uint32), "after": after.astype(np.uint32), "w3": w.astype(np.uint32)}
        out |= dict(zip(("c3", "c3_large_at", "c3_large"), one_byte(counts)))
        n_after = np.diff(after)
        many = np.flatnonzero(n_after >= MANY)
        out["many"] = many.astype(np.uint32)
        for k, x in (("many_total", counts), ("many_one", counts == 1), ("many_two", counts == 2)):
            out[k] = np.add.reduceat(x.astype(np.int64), first)[many].astype(np.uint64)
        # (v, w), with the number of different u
        vw, before_vw = summed(joined(np.repeat(middle, n_after), w), np.ones(len(vu), np.int64))
        second = parted(vw)[0]
        spread = np.isin(second, frequent)
        mine, mine_n, second = vw[~spread], before_vw[~spread], second[~spread]
        # a frequent v has no pairs here: its stretch is empty
        v_pairs = np.append(np.searchsorted(second, middle[v_first]), len(second))
        out |= {"v_pairs": v_pairs.astype(np.uint32), "w2": parted(mine)[1].astype(np.uint32)}
        out |= dict(zip(("c2", "c2_large_at", "c2_large"), one_byte(mine_n)))
        running = lambda x: np.concatenate(([0], np.cumsum(x)))
        for k, x in (("total", mine_n), ("one", mine_n == 1), ("two", mine_n == 2)):
            sums = running(x)
            out[k] = (sums[v_pairs[1:]] - sums[v_pairs[:-1]]).astype(np.uint64 if k == "total" else np.uint32)
        write_arrays(folder, f"triples-{part}", out)
        # to the ranges of w: how many different v, of those that are not spread, were seen before it; and the pairs of the others
        follower, n_before = np.unique(parted(mine)[1], return_counts=True)
        keys = np.concatenate((joined(np.full(len(follower), 0xFFFFFFFF), follower), vw[spread]))
        sums = np.concatenate((n_before, before_vw[spread])).astype(np.uint32)
        order = np.argsort(keys)
        yield from blocks(number_range(parted(keys[order])[1], ranges, v), keys[order], sums[order])
        about = np.array([*count_kinds(counts), *count_kinds(mine_n)], np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([packed(np.arange(len(about), dtype=np.uint64), about)], pa.binary())], names=["part", "data"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([packed(np.array([1 << 40 | part], np.uint64), np.array([1], np.uint32))], pa.binary())], names=["part", "data"])

    def write_follows(part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if part < 0:
            rows = [("about", keys.tolist(), counts.tolist())]
        else:
            second, w = parted(keys)
            spread = second != 0xFFFFFFFF
            if spread.any():
                write_arrays(folder, f"spread-{part}", {"keys": keys[spread], "counts": counts[spread].astype(np.uint64)})
            follower, follows = summed(np.concatenate((w[~spread], w[spread])), np.concatenate((counts[~spread], np.ones(int(spread.sum()), np.int64))))
            write_arrays(folder, f"follows-{part}", {"words": follower.astype(np.uint32), "counts": follows.astype(np.uint64)})
            rows = [("follows", [part], [0]), ("follow_counts", [*range(5)], count_kinds(follows))]
            if spread.any():
                own, c = second[spread], counts[spread]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                rows += [("spread", [part], [0]), ("pair_counts", [*range(5)], count_kinds(c))]
                rows += [(f"sum{k}", own[first].tolist(), np.add.reduceat(x.astype(np.int64), first).tolist()) for k, x in enumerate((c, c == 1, c == 2, c > 2))]
        kinds, a, b = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *(pa.array(x, pa.list_(pa.int64())) for x in (a, b))], names=["kind", "keys", "counts"])

    with shuffles_cleaned(spark):
        pieces = counted(docs, text, triples, lambda *x: narrow(*summed_pairs(*x)), lambda vu, *_: triple_range(vu, ranges, v, frequent))
        made = merged(pieces, ranges, (np.uint64, np.uint32, np.uint32), summed_pairs, write_triples, BLOCK)
        ended = merged(made, ranges, (np.uint64, np.uint32), summed, write_follows, "kind string, keys array<bigint>, counts array<bigint>")
        # sums over the ranges, so what comes here are the sums of the frequent words and the numbers of the ranges
        rows = ended.select("kind", F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy("kind", "x.keys").agg(F.sum("x.counts").alias("n")).collect()
    about: dict = {"sizes": sizes, "tokens": n, "triples": [0] * 5, "pairs": [0] * 5, "follows": [0] * 5, "frequent": {str(k): [0] * 4 for k in frequent.tolist()}, "there": {"triples": [], "follows": [], "spread": []}}
    for kind, key, x in rows:
        if kind == "about":
            if key >= 1 << 40:
                about["there"]["triples"].append(key - (1 << 40))
            else:
                about[("triples", "pairs")[key // 5]][key % 5] += x
        elif kind in about["there"]:
            about["there"][kind].append(key)
        elif kind in ("follow_counts", "pair_counts"):
            about[kind.split("_")[0] + "s"][key] += x
        else:
            about["frequent"][str(key)][int(kind[3:])] += x
    return folder, about


def score(docs: DataFrame, model: tuple[str, dict], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, base_score and score of each row of docs; see score_documents."""
    folder, about = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = cells("lm-models")
        if folder not in store:
            store.clear()
            store[folder] = Model(folder, about)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                few = batch.slice(at, ROWS)
                got = store[folder].score(few.column(1))
                yield pa.RecordBatch.from_arrays([few.column(0), *(pa.array(x) for x in got)], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, n_known bigint, base_score double, score double")


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """Scores of all rows by a model of those for which `learn` holds, and the model's sizes.

    Tokens are a text's words, A-Z lower-cased, and one end. score is the model's
    log10 probability of these tokens, base_score that of an add-0.1 unigram
    model, n_known the tokens that occur in the texts learned from. Perplexity is
    10 ** (-score / n_tokens). A null or empty text is an end alone. With nothing
    to learn from, every token has probability 1 (one unknown word). Repeated
    rows are learned from and returned as often as they come; other columns are
    not read.
    """
    model = train(docs.filter(learn).select(text), text)
    return score(docs, model, id_col, text), model[1]
