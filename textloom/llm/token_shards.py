"""Token ids as fixed-stride binary shards in a keyed random training order.

Each partition joins its documents' tokens, an end token after each, and cuts
them into sequences of equal length; the last one is filled up with end tokens.
A sequence's number is its place in its partition and that partition's number.
A Feistel network with a key permutes all numbers below a bound: an even number
of bits is mixed in rounds, and a result that is not below the bound is mixed
again until it is (cycle-walking). The result is the sequence's place in the
training order, no two are equal, and nothing but the key is needed to know it.

Ranges of places are the shards. One shuffle brings a range's sequences to one
task, which sorts them by place and writes them one after the other, so its
sequences stand at multiples of the stride. Numbers of sequences of earlier
shards make the places a global slot without gaps: slot s is in the shard with
the largest first slot <= s, at byte (s - first slot) * stride.

Files appear under their name by a rename once they are whole; a task that runs
again after a lost executor writes the same bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, cut, publish, scratch
from .token_count import load

#: Tokens of a sequence.
LENGTH = 1024
#: Sequences of a partition are numbered below this bound.
PER_PARTITION = 1 << 32
REMEMBERED = 250_000
MASK = (1 << 64) - 1


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: 64 bits that depend on all bits of x and the key."""
    x = (x + np.uint64(key & MASK)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def permuted(numbers: np.ndarray, bound: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of the numbers below the bound (up to 2**62), one for each key."""
    half = max(1, ((bound - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & low
        for r in range(rounds):
            left, right = right, left ^ (mixed(right, key * 0x100000001B3 + r) & low)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= bound]
    return out.astype(np.int64)


class Encoder:
    """Token ids of texts as bytes; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.end = next(iter(self.bpe.special_ids.values()), 0)
        #: Bytes of a token id: two as long as all ids of the vocabulary fit.
        self.width = 2 if max(self.bpe.base - 1, *self.bpe.special_ids.values(), 0) < 1 << 16 else 4
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.bpe.pre_tokens(t) for t in texts]
        new = list(set().union(*found) - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            new = list(set().union(*found))
            self.known.clear()
        if new:
            symbols, counts = self.bpe.merge(new)
            raw, ends = symbols.astype(f"<u{self.width}").tobytes(), np.cumsum(counts) * self.width
            self.known.update((w, raw[a:b]) for w, a, b in zip(new, [0, *ends[:-1].tolist()], ends.tolist()))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in found]


def encoder(path: str) -> Encoder:
    store = cells("encoders")
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def sequences(docs: DataFrame, tokenizer: str, key: int, partitions: int, id_col: str, text: str, length: int) -> DataFrame:
    """place, n_tokens (without filling), docs (doc_id, tokens of it) and tokens of each sequence."""
    bound = partitions * PER_PARTITION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        if part >= partitions:
            raise ValueError("the input has more partitions than were counted")
        width = enc.width
        stride, end = length * width, int(enc.end).to_bytes(width, "little")
        rest, own, number = bytearray(), [], 0  # own: [doc, tokens of it in rest]

        def cut_off(last: bool) -> pa.RecordBatch | None:
            nonlocal number, rest, own
            made, at, here = [], 0, []
            queue = iter(own)
            doc = next(queue, None)
            while len(rest) - at >= stride or last and len(rest) > at:
                piece = bytes(rest[at : at + stride])
                left, mine = len(piece) // width, []
                n = left
                while left and doc is not None:
                    take = min(left, doc[1])
                    mine.append({"doc_id": doc[0], "n": take})
                    left -= take
                    doc = [doc[0], doc[1] - take] if doc[1] > take else next(queue, None)
                made.append((n, mine, piece + end * ((stride - len(piece)) // width)))
                at += stride
            own = [] if doc is None else [doc, *queue]
            rest = rest[at:]
            if not made:
                return None
            numbers = np.arange(number, number + len(made), dtype=np.int64) * partitions + part
            number += len(made)
            if number >= PER_PARTITION:
                raise OverflowError(f"a partition has more than {PER_PARTITION} sequences; repartition the input")
            n, mine, raw = zip(*made)
            return pa.RecordBatch.from_arrays(
                [pa.array(permuted(numbers, bound, key), pa.int64()), pa.array(n, pa.int32()), pa.array(mine, pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int32())]))), pa.array(raw, pa.binary())],
                names=["place", "n_tokens", "docs", "tokens"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                few = batch.slice(at, 200)
                ids, texts = few.column(0).to_pylist(), [x or "" for x in few.column(1).to_pylist()]
                for i, raw in zip(ids, enc.encode(texts)):
                    rest += raw
                    rest += end
                    own.append([i, len(raw) // width + 1])
                if (out := cut_off(False)) is not None:
                    yield out
        if (out := cut_off(True)) is not None:
            yield out

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "place bigint, n_tokens int, docs array<struct<doc_id:bigint,n:int>>, tokens binary")


def write_shards(docs: DataFrame, tokenizer: str, out: str | None = None, key: int = 42, shards: int | None = None, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, str]:
    """Writes the shards into the folder `out` of the shared store (a new one by default); gives the table of sequences and the folder.

    Columns: slot (global, from 0, without gaps), shard, file, byte_offset,
    n_tokens (without filling), tokens_hash (of the stride's bytes) and docs, the
    documents in it in order with their numbers of tokens, an end token included.

    Null and empty texts are an end token alone. Repeated rows and ids are
    written as often as they come; a null id stays null in docs. An empty table
    writes nothing. The order of documents inside a partition is that of the
    input; with the same input files, partitions, key and shards, all bytes are
    the same again. Token ids take two bytes, or four where the vocabulary has
    more than 65,536. Other columns are not read.
    """
    spark = docs.sparkSession
    partitions = max(1, docs.rdd.getNumPartitions())
    shards = shards or partitions
    bound = partitions * PER_PARTITION
    folder = out or scratch(spark, "shards")
    made = sequences(docs, tokenizer, key, partitions, id_col, text, length)
    places = -(-bound // shards)
    made = made.withColumn("shard", F.expr(f"cast(place div {places} as int)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        open_shard, sink, temp, at = None, None, "", 0

        def name(shard: int) -> str:
            return f"shard-{shard:08d}.bin"

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                publish(store, temp, f"{base}/{name(open_shard)}")
                sink = None

        for batch in batches:
            rows = [(c.as_py(), r.as_py()) for c, r in zip(batch.column("shard"), batch.column("tokens"))]
            offsets, hashes, files = [], [], []
            for shard, raw in rows:
                if shard != open_shard:
                    close()
                    open_shard, at, temp = shard, 0, f"{base}/.{name(shard)}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp)
                sink.write(raw)
                offsets.append(at)
                hashes.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                files.append(name(shard))
                at += len(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), batch.column("n_tokens"), pa.array(hashes, pa.int64()), batch.column("docs")],
                names=["shard", "file", "byte_offset", "n_tokens", "tokens_hash", "docs"],
            )
        close()

    # each range of places is one task's
    ordered = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place").select("shard", "tokens", "n_tokens", "docs")
    rows = cut(ordered.mapInArrow(run, "shard int, file string, byte_offset bigint, n_tokens int, tokens_hash bigint, docs array<struct<doc_id:bigint,n:int>>"))
    # one row for each shard
    first = rows.groupBy("shard").agg(F.count("*").alias("n")).withColumn("first_slot", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stride = length * encoder(tokenizer).width
    placed = rows.join(F.broadcast(first.select("shard", "first_slot")) if shards <= 100_000 else first.select("shard", "first_slot"), "shard")
    return placed.select((F.col("first_slot") + F.expr(f"byte_offset div {stride}")).alias("slot"), "shard", "file", "byte_offset", "n_tokens", "tokens_hash", "docs"), folder


def write_manifest(table: DataFrame, folder: str, tokenizer: str, length: int = LENGTH) -> None:
    """Writes manifest.json beside the shards: stride, bytes of a token id and, for each shard, its file, first slot and number of sequences. Without sequences there are no shards."""
    from pyarrow import fs

    rows = table.groupBy("shard", "file").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n")).orderBy("shard").collect()  # a row for each shard
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    width = encoder(tokenizer).width
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"stride": length * width, "width": width, "length": length, "shards": [r.asDict() for r in rows]}).encode())


def read_sequences(folder: str, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Slots and token ids from a slot on, in training order: a reader that stopped goes on from its next slot."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        about = json.loads(f.read())
    for shard in about["shards"]:
        skip = max(0, start - shard["first_slot"])
        if skip < shard["n"]:
            with store.open_input_file(f"{base}/{shard['file']}") as f:
                f.seek(skip * about["stride"])
                for k in range(skip, shard["n"]):
                    yield shard["first_slot"] + k, np.frombuffer(f.read(about["stride"]), f"<u{about['width']}")
