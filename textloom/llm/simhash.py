"""SimHash near-duplicates with vantage-point trees over Hamming distance.

Fingerprints: the 64-bit hashes of a text's word shingles vote on each bit.

Search: a 64-bit fingerprint is cut into six blocks of bits, and each of the 15
pairs of blocks gives a tree whose distance is the Hamming distance on these
bits only. That is a lower bound of the full distance, and distances on disjoint
blocks add up to it; so two fingerprints with at most four differing bits are at
distance 0 in at least one tree. The shard of a vantage point there is its ball
of radius 0, and the 15 overlapping shards of a fingerprint cover all its
possible partners, wherever a boundary runs. Shards are dealt out by a shuffle;
its size is 15 small rows for each distinct fingerprint.

Inside a shard a vantage point orders the others by their full distance to it;
a search looks only at those whose distance differs by at most four (the
triangle bound). What is found leaves the search, so a shard of near copies
costs about as much as its size, and each shard gives at most one link for each
member, not all pairs. A shard beyond MOST is searched by trees on its remaining
bits instead. Links of all shards are joined into components by passing on the
smallest id, with a jump along labels in each round.

Only distinct fingerprints take part, so exact copies are one row here.

near_duplicates links by that search alone. keep_one and wide_duplicates take
copies with more edits too: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 at least. They begin with the same fingerprints (of five-word
shingles) and the same trees; each fingerprint is compared with the nearest one
that the trees link it to, by the whole sets, and those that are similar make the
first groups. Fingerprints only estimate the similarity, so what they leave apart
goes through the wide search, which looks at pairs of different groups and works
on the sets: a set of n shingles sorted by one order of all
shingles (rare ones first) shares one of its first n - ceil(0.8 n) + 1 with each
set that is so similar. These shingles are the shards; what meets in one and can
be similar by size and place is a candidate. Candidates whose odd sketches
differ in more bits than similar sets can differ in members are dropped, and the
sets of the others are compared whole. No similar pair is missed and no other is
linked. A shard with too many pairs is first joined by pivots and by neighbours
in size, and only pairs of different groups are looked at after that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, quoted, stored, texts_of, unused

WORDS = 4
RADIUS = 4
#: Fingerprints of a shard that are searched at once (8 bytes each); a larger shard goes a level deeper.
MOST = 200_000
LEVELS = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    from xxhash import xxh64_intdigest

    found = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())
    if not found:
        return []
    raw = " ".join(found).encode("utf-8", "surrogatepass")
    if len(found) <= words:
        return [xxh64_intdigest(raw, 42)]
    gaps = [-1, *np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist(), len(raw)]
    return [xxh64_intdigest(raw[a + 1 : b], 42) for a, b in zip(gaps, gaps[words:])]


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 if there are none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(texts: list[str], words: int = WORDS, mixes: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each mix, a signed 64-bit number for each text; 0 for one without words. Another mix gives other bits from the same hashes."""
    out = [np.zeros(len(texts), np.uint64) for _ in mixes]
    for k, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, words), np.uint64)
        for own, mix in zip(out, mixes):
            other = hashes
            if mix:
                other = (hashes ^ hashes >> np.uint64(29)) * np.uint64(mix)
                other ^= other >> np.uint64(32)
            own[k] = majority(other)
    return [x.view(np.int64) for x in out]


def blocks_of(bits: list[int], n: int) -> list[list[int]]:
    return [bits[k * len(bits) // n : (k + 1) * len(bits) // n] for k in range(n)]


def masks(level: int, radius: int = RADIUS) -> list[tuple[str, int]]:
    """Name and bits of each tree of a level; below the first, name is that of the tree above, a dot and a number."""
    found = [("", 0)]
    for _ in range(level):
        deeper = []
        for name, mask in found:
            blocks = blocks_of([b for b in range(64) if not mask >> b & 1], radius + 2)
            for k, (a, b) in enumerate(combinations(blocks, 2)):
                deeper.append((f"{name}.{k}", sum(1 << x for x in a + b)))
        found = deeper
    return found


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def component_links(own: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the distinct fingerprints of a shard as all pairs within the radius would."""
    own = own.view(np.uint64)
    if len(own) == 2:
        near = np.bitwise_count(own[:1] ^ own[1:]) <= radius
        return own[1:][near].view(np.int64), own[:1][near].view(np.int64)
    if len(own) <= 64:  # small enough to look at all pairs; each member is linked to the first it reaches
        near = np.bitwise_count(own[:, None] ^ own) <= radius
        if np.count_nonzero(near) == len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        root = np.arange(len(own))
        while True:
            lower = np.where(near, root, len(own)).min(axis=1)
            if (lower == root).all():
                break
            root = lower
        other = np.flatnonzero(root != np.arange(len(own)))
        return own[other].view(np.int64), own[root[other]].view(np.int64)
    far = np.bitwise_count(own ^ own[0])
    rings = [own[far == d] for d in range(65)]  # by distance to the vantage point
    froms, tos = [], []
    for ring in range(65):
        while len(rings[ring]):
            root = rings[ring][0]
            rings[ring] = rings[ring][1:]
            queue = [(root, ring)]
            while queue:
                point, at = queue.pop()
                for r in range(max(0, at - radius), min(64, at + radius) + 1):
                    if len(rings[r]):
                        near = np.bitwise_count(rings[r] ^ point) <= radius
                        if near.any():
                            found = rings[r][near]
                            rings[r] = rings[r][~near]
                            froms.append(found)
                            tos.append(np.full(len(found), root))
                            queue.extend((x, r) for x in found)
    if not froms:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(froms).view(np.int64), np.concatenate(tos).view(np.int64)


def searched(shards: DataFrame, last: bool, radius: int) -> DataFrame:
    """a, b (a link; or b null and a a member of a shard that is too large) and shard of rows sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, current, large = 0, None, False
        out: list[tuple] = []
        some = 0

        def ended() -> None:
            nonlocal size, large, some
            if held and not large and size > 1:
                a, b = component_links(np.unique(np.concatenate(held)), radius)
                if len(a):
                    out.append((a, b, None))
                    some += len(a)
            held.clear()
            size, large = 0, False

        def batch_of() -> pa.RecordBatch:
            nonlocal some
            a = pa.array(np.concatenate([x for x, _, _ in out]), pa.int64())
            b = pa.concat_arrays([pa.nulls(len(x), pa.int64()) if y is None else pa.array(y, pa.int64()) for x, y, _ in out])
            s = pa.concat_arrays([pa.nulls(len(x), pa.string()) if n is None else pa.array([n] * len(x), pa.string()) for x, _, n in out])
            out.clear()
            some = 0
            return pa.RecordBatch.from_arrays([a, b, s], names=["a", "b", "shard"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            fp = batch.column("fp").to_numpy()
            tree = batch.column("tree")
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
            ends = np.append(edges[1:], len(key))
            # a shard of one row has no pairs; only the first and last of a batch may go on elsewhere
            more = ends - edges > 1
            more[:1] = more[-1:] = True
            for a, b in zip(edges[more].tolist(), ends[more].tolist()):
                if key[a] != current:
                    ended()
                    current = key[a]
                held.append(fp[a:b])
                size += b - a
                if not last and (large or size > MOST):
                    out.extend((x, None, tree[a].as_py()) for x in held)
                    some += sum(map(len, held))
                    held.clear()
                    large = True
            if held:  # a slice would keep the whole batch
                held[:] = [np.concatenate(held)]
            if some >= 10_000:
                yield batch_of()
        ended()
        if out:
            yield batch_of()

    return shards.mapInArrow(run, "a bigint, b bigint, shard string")


def sharded(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """fp, tree and key (the hash of tree and masked bits) of each fingerprint in each tree of its level, sorted by key within partitions."""
    if level == 1:
        trees = F.array(*[F.struct(F.lit(n).alias("tree"), F.lit(signed(m)).alias("mask")) for n, m in masks(1, radius)])
        each = rows.select("fp", F.explode(trees).alias("t"))
        each = each.select("fp", "t.tree", F.xxhash64("t.tree", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("key"))
    else:
        table = [(n, n.rpartition(".")[0], signed(m)) for n, m in masks(level, radius)]
        trees = rows.sparkSession.createDataFrame(table, "tree string, above string, mask bigint")
        each = rows.join(F.broadcast(trees), rows["shard"] == trees["above"])  # 15 ** level rows
        each = each.select("fp", "tree", F.xxhash64("key", "tree", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    return each.repartition("key").sortWithinPartitions("key")


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b of distinct fingerprints (column fp), that join them as all pairs within the radius would."""
    links, rows = None, fps.select("fp")
    for level in range(1, LEVELS + 1):
        shards = sharded(rows, level, radius)
        found = cut(searched(shards, level == LEVELS, radius))
        here = found.filter(F.col("b").isNotNull()).select("a", "b")
        links = here if links is None else links.unionByName(here)
        deeper = found.filter(F.col("b").isNull())
        if level == LEVELS or deeper.isEmpty():
            break
        # members of a too large shard stay apart from those of another by its key
        above = dict(masks(level, radius))
        pick = F.create_map(*[F.lit(x) for n, m in above.items() for x in (n, signed(m))])
        rows = deeper.select(F.col("a").alias("fp"), "shard").withColumn("key", F.xxhash64("shard", F.col("fp").bitwiseAND(F.try_element_at(pick, F.col("shard")))))
    return links.distinct()


def labels(links: DataFrame) -> DataFrame:
    """fp and label (the same node for all that are joined) of the nodes that have links (a, b).

    In each round every node goes to the least of itself and its neighbours, by
    an order that is new in each round, and on to where that one goes; links
    inside a label go. So rounds grow with the logarithm of a component's size
    and each has less to do; at last the rounds' steps are put together.
    """
    edges, steps = cut(links.select("a", "b").filter("a <> b")), []
    while not edges.isEmpty():
        place = lambda c, turn=len(steps): F.struct(F.xxhash64(F.lit(turn), c).alias("at"), F.col(c).alias("fp"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("fp")).agg(F.min(place("b")).alias("near"))
        up = cut(near.select("fp", F.least(place("fp"), "near")["fp"].alias("to")))
        up = cut(up.join(up.select(F.col("fp").alias("to"), F.col("to").alias("further")), "to").select("fp", F.col("further").alias("to")))
        ends = edges.join(up.select(F.col("fp").alias("a"), F.col("to").alias("x")), "a").join(up.select(F.col("fp").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        steps.append(up)
    if not steps:
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("label"))
    found = steps.pop().withColumnRenamed("to", "label")
    while steps:
        found = cut(steps.pop().join(found.select(F.col("fp").alias("to"), "label"), "to", "left").select("fp", F.coalesce("label", "to").alias("label")))
    return found


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """fp and component (the smallest id of all that are joined) of the nodes (distinct fp, id) that have links (a, b) of their fps. Ids may recur or be null."""
    of = nodes.join(labels(links), "fp")
    return of.join(of.groupBy("label").agg(F.min("id").alias("component")), "label").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """id_col, fp (signed) and component_id of each row of docs.

    Fingerprints with at most `radius` differing bits are linked; component_id is
    the smallest id reachable. A text without words, null included, has the
    fingerprint 0 and is linked like any other; a text of fewer words than a
    shingle is one shingle. Rows are told apart by their fingerprints, not by
    their ids: rows that share an id are returned one by one, each with its own
    component. A null id stays null and is nobody's component_id unless its group
    has no other. An empty table gives an empty one; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(texts_of(batch, text), words)[0], pa.int64())], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    fps = cut(map_batches(docs.select(F.col(id_col).alias("id"), text), run, f"id {kind}, fp bigint", rows=500))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(nodes, near_links(nodes, radius))
    # written, so that the join with the rows stands alone and a fingerprint that many rows have can be split
    of = cut(nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    return fps.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Wide search: words of a shingle, the similarity of shingle sets from which texts are copies (as a fraction), and the
#: documents sampled (these at least, and at least one of EVERY) and the shingles listed for the order of shingles, which bears on cost only, not on what is found.
WIDE_WORDS, SIMILAR, SAMPLE, EVERY, COMMON = 5, (4, 5), 10_000, 5, 100_000
#: A shard with more pairs than this for each member is searched by pivots first, in so many turns at most, by so many pivots; FIRST
#: pairs in the first turn, which has no sketches to drop pairs by: a shard that grows with the input is left to those that have.
PAIRS, FIRST, TURNS, PIVOTS = 16, 4, 4, 8
#: Ids of candidates that are broadcast at most; beyond, their texts are found by a shuffled join.
NEEDED = 500_000
#: Links that are joined in one task at most; more are joined in rounds.
LINKS = 500_000


def shingle_set(text: str, words: int = WIDE_WORDS) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def set_and_fingerprint(text: str, words: int) -> tuple[np.ndarray, int]:
    hashes = np.array(shingle_hashes(text, words), np.uint64)
    return np.unique(hashes), majority(hashes)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of SIMILAR at least; in whole numbers."""
    top, of = SIMILAR
    common = len(np.intersect1d(a, b, assume_unique=True))
    return (top + of) * common >= top * (len(a) + len(b))


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set's shingles, the rarest first: two similar sets share one of them."""
    top, of = SIMILAR
    rank = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[: len(own) + (-top * len(own) // of) + 1]] if len(own) else own


def common_shingles(source: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that recur in a sample of the texts, and how often; COMMON at most."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(x, words) for x in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64), pa.int64())], names=["token"])

    # not a fixed number: what recurs n times would leave the list as the input grows, and the shards of such shingles have n * n pairs
    every = min(max(1, source.count() // SAMPLE), EVERY)
    part = source.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
    counted = map_batches(part, run, "token bigint", rows=500).groupBy("token").agg(F.count("*").alias("n"))
    found = counted.filter("n > 2").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens, counts = (found.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], counts[order]


def possible(n: np.ndarray, pos: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of the others that by size and by what is left behind this shingle can be similar to member i, if it is their first common one."""
    top, of = SIMILAR
    low, high = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    room = np.minimum(n[i] - pos[i], n[others] - pos[others])
    return others[(of * low >= top * high) & ((top + of) * room >= top * (n[i] + n[others]))]


def sketch(own: np.ndarray) -> bytes:
    """Odd sketch of a set: a bit for each class of its hashes by their low bits, set if an odd number is in it.

    There are two bits or more for each hash. Sketches of two sets differ in no
    more bits than the sets do in members, also after folding the longer one.
    """
    bits = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(found: np.ndarray, words: int) -> np.ndarray:
    """A sketch's 64-bit words, folded to so many."""
    while len(found) > words:
        found = found[: len(found) // 2] ^ found[len(found) // 2 :]
    return found


def plausible(n: np.ndarray, sketches: list[np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Those of the others whose sketches leave it open that they are similar to member i."""
    top, of = SIMILAR
    keep = np.zeros(len(others), bool)
    mine = sketches[i]
    sizes = np.array([len(sketches[j]) for j in others.tolist()], np.int64)
    for size in np.unique(sizes):
        here = np.flatnonzero(sizes == size)
        words = min(int(size), len(mine))
        for at in range(0, len(here), 4096):
            some = here[at : at + 4096]
            apart = np.bitwise_count(np.stack([folded(sketches[j], words) for j in others[some].tolist()]) ^ folded(mine, words)).sum(axis=1, dtype=np.int64)
            keep[some] = (top + of) * apart <= (of - top) * (n[i] + n[others[some]])
    return others[keep]


def shard_pairs(part: dict, turn: int) -> tuple[Iterator[tuple[int, np.ndarray]], bool]:
    """Pairs of a shard's members (one of them and others) in different groups that can be similar, and whether these are all of them.

    Where there are too many, members are compared with a few pivots and, from
    the second turn on, with their neighbours by size: a large group of copies is joined by these, and
    what is left between groups is looked at in a later turn. From the second
    turn on members have sketches, and only plausible pairs come out.
    """
    ids, n, pos, group, sketches = part["id"], part["at"] >> 32, part["at"] & 0xFFFFFFFF, part.get("comp", part["id"]), part.get("sketch")
    _, own, sizes = np.unique(group, return_inverse=True, return_counts=True)
    m = len(ids)
    most = min(PAIRS, FIRST) if turn == 0 else PAIRS
    whole = turn == TURNS - 1 or m * m - int((sizes.astype(np.int64) ** 2).sum()) <= 2 * most * m
    if sketches is not None and len(sizes) > 1:
        sketches = [np.frombuffer(x, np.uint64) for x in sketches.tolist()]

    def near(i: int, others: np.ndarray) -> tuple[int, np.ndarray]:
        others = possible(n, pos, i, others[own[others] != own[i]])
        return i, others if sketches is None else plausible(n, sketches, i, others)

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        if len(sizes) == 1:
            return
        if whole:
            # all but the largest group against those after them and against the largest one
            order = np.argsort(own == np.argmax(sizes), kind="stable")
            for k in range(m - int(sizes.max())):
                yield near(int(order[k]), order[k + 1 :])
        elif turn == 0:
            yield near(int(np.argmin(ids)), np.arange(m))
        else:
            mixed = (ids.view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            for i in np.argsort(mixed ^ mixed >> np.uint64(32), kind="stable")[:PIVOTS].tolist():
                yield near(i, np.arange(m))
            order = np.lexsort((ids, n))
            for i, j in zip(order[1:].tolist(), order[:-1]):
                yield near(i, np.array([j]))

    return pairs(), whole


def wide_searched(shards: DataFrame, turn: int) -> DataFrame:
    """a, b (a pair to compare; or b null and a a member of a shard that needs another turn, with its token and at) of rows sorted by token."""
    kinds = {"a": pa.int64(), "b": pa.int64(), "token": pa.int64(), "at": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def batch_of(columns: dict, rows: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], names=list(kinds))

        def paired(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            x, y = (np.concatenate(z) for z in zip(*found))
            x, y = x[x != y], y[x != y]
            both = np.unique(np.stack((np.maximum(x, y), np.minimum(x, y))), axis=1)
            return batch_of({"a": both[0], "b": both[1]}, both.shape[1])

        def searched(part: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            token = part["token"]
            edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            ends = np.append(edges[1:], len(token))
            more = ends - edges > 1
            found, some = [], 0
            for p, q in zip(edges[more].tolist(), ends[more].tolist()):
                shard = {c: v[p:q] for c, v in part.items()}
                pairs, whole = shard_pairs(shard, turn)
                for i, others in pairs:
                    if len(others):
                        found.append((np.full(len(others), shard["id"][i]), shard["id"][others]))
                        some += len(others) + 1
                        if some >= 10_000:
                            yield paired(found)
                            found, some = [], 0
                if not whole:
                    yield batch_of({"a": shard["id"], **{c: shard[c] for c in ("token", "at")}}, q - p)
            if found:
                yield paired(found)

        for batch in batches:
            part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if rest is not None:
                part = {c: np.concatenate((rest[c], part[c])) for c in part}
            if len(part["token"]) == 0:
                continue
            last = int(np.searchsorted(part["token"], part["token"][-1]))  # this shard may go on in the next batch
            rest = {c: v[last:].copy() for c, v in part.items()}
            if last:
                yield from searched({c: v[:last] for c, v in part.items()})
        if rest is not None:
            yield from searched(rest)

    return shards.mapInArrow(run, "a bigint, b bigint, token bigint, at bigint")


def among(df: DataFrame, ids: DataFrame, many: int) -> DataFrame:
    """The rows of df whose id is one of the distinct ids, of which there are so many."""
    return df.join(F.broadcast(ids) if many <= NEEDED else ids, "id", "left_semi")


def ends_of(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def both_ends(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both ends, named p_... and q_..."""
    for end, name in (("a", "p"), ("b", "q")):
        pairs = pairs.join(of.select(F.col("id").alias(end), *(F.col(c).alias(f"{name}_{c}") for c in columns)), end)
    return pairs.select("a", "b", *(f"{name}_{c}" for name in "pq" for c in columns))


def sifted(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs whose sketches leave it open that they are similar."""
    ids = ends_of(pairs)
    few = cut(among(nodes.select("id", "n", "sketch"), ids, ids.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy().astype(np.int64) for c in ("p_n", "q_n")]
            both = zip(*(batch.column(c).to_pylist() for c in ("p_sketch", "q_sketch")))
            keep = [len(plausible(np.array([x, y]), [np.frombuffer(z, np.uint64) for z in pq], 0, np.array([1]))) == 1 for x, y, pq in zip(*n, both)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both_ends(pairs, few, ["n", "sketch"]).mapInArrow(run, "a bigint, b bigint")


def verified(source: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts have similar shingle sets, which are compared whole."""
    pairs = cut(pairs)
    ids = ends_of(pairs)

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, words).tobytes() for x in texts_of(batch)], pa.binary())], names=["id", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("p_own"), batch.column("q_own"))
            yield batch.select(["a", "b"]).filter(pa.array([similar(*(np.frombuffer(x.as_py(), np.uint64) for x in pq)) for pq in both], pa.bool_()))

    # rows that share an id have one text
    sets = cut(map_batches(among(source, ids, ids.count()).select("id", "text"), sets_of, "id bigint, own binary", rows=500).dropDuplicates(["id"]))
    return cut(both_ends(pairs, sets, ["own"]).mapInArrow(run, "a bigint, b bigint").distinct())


def joined(links: DataFrame) -> DataFrame:
    """labels() of the links. A bounded number of links is joined in one task, which spares the driver the rounds."""
    if links.count() > LINKS:
        return labels(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(i: int) -> int:
            while (above := up.setdefault(i, i)) != i:
                up[i] = up[above]
                i = up[i]
            return i

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        of = [top(i) for i in list(up)]
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(of, pa.int64())], names=["fp", "label"])

    return cut(links.select("a", "b").coalesce(1).mapInArrow(run, "fp bigint, label bigint"))


def tree_links(source: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Links a, b of similar nodes (id, fp) that the vantage-point trees find.

    Each node is compared with the first of its fingerprint, and that one with
    the nearest fingerprint it is linked to: two comparisons a node at most, also
    in large groups.
    """
    firsts = cut(nodes.groupBy("fp").agg(F.min("id").alias("id")))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    nearest = near_links(firsts).groupBy("a").agg(F.min(F.struct(apart.alias("apart"), "b"))["b"].alias("b"))
    for end in "ab":
        nearest = nearest.join(firsts.select(F.col("fp").alias(end), F.col("id").alias(f"{end}_id")), end)
    same = nodes.select("fp", F.col("id").alias("a")).join(firsts.withColumnRenamed("id", "b"), "fp").filter("a <> b").select("a", "b")
    return verified(source, same.unionByName(nearest.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))), words)


def wide_links(source: DataFrame, nodes: DataFrame, words: int, links: DataFrame) -> DataFrame:
    """The links a, b with more that join the nodes (id, n, prefix, sketch) as all pairs of similar sets would."""
    of = joined(links)
    few = F.broadcast(of) if of.count() <= NEEDED else of
    grouped = nodes.join(few, nodes["id"] == few["fp"], "left").select("id", "n", "prefix", F.coalesce("label", "id").alias("comp"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
        many = np.array([len(x) for x in found], np.int64)
        ids, n, comp = (np.repeat(batch.column(c).to_numpy(), many) for c in ("id", "n", "comp"))
        pos = np.concatenate([np.empty(0, np.int64), *(np.arange(k) for k in many)])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.concatenate([np.empty(0, np.int64), *found]), ids, n.astype(np.int64) << 32 | pos, comp)], names=["token", "id", "at", "comp"])

    # at: the size of the set and the place of the token in it; short rows, as there are many
    rows = map_batches(grouped, run, "token bigint, id bigint, at bigint, comp bigint", rows=500)
    for turn in range(TURNS):
        found = cut(wide_searched(rows.repartition("token").sortWithinPartitions("token"), turn))
        pairs = cut(found.filter(F.col("b").isNotNull()).select("a", "b").distinct())
        new = verified(source, pairs if turn else sifted(nodes, pairs), words)
        links = links.unionByName(new)
        later = found.filter(F.col("b").isNull()).select("token", F.col("a").alias("id"), "at")
        if turn == TURNS - 1 or later.isEmpty():
            return links
        of = joined(links)
        later = later.join(of, later["id"] == of["fp"], "left").select("token", "id", "at", F.coalesce("label", "id").alias("comp"))
        ids = cut(later.select("id").distinct())
        rows = later.join(among(nodes.select("id", "sketch"), ids, ids.count()), "id").select("token", "id", "at", "comp", "sketch")


def row_key(df: DataFrame, id_col: str, text: str) -> Column:
    """What tells rows apart: a hash of id and text. Rows that agree in it and in their id are taken for repeated ones."""
    return F.xxhash64(quoted(id_col), quoted(id_col).isNull(), quoted(text))


def wide_groups(docs: DataFrame, id_col: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """own (id), x and y (digest of its set) of each row; x, y and first (none, own and id) of the set's group: its row with the smallest id, a null id being last."""
    source = docs.select(row_key(docs, id_col, text).alias("id"), quoted(id_col).cast("bigint").alias("own"), quoted(text).alias("text"))
    common, counts = common_shingles(source.select("id", "text"), words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        sets, fps = zip(*(set_and_fingerprint(x, words) for x in texts_of(batch))) if batch.num_rows else ((), ())
        digests = np.frombuffer(b"".join(xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
        prefixes = [prefix(x, common, counts).tobytes() for x in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(digests[:, k], pa.int64()) for k in (0, 1)), pa.array([len(x) for x in sets], pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(prefixes, pa.binary()), pa.array(map(sketch, sets), pa.binary())],
            names=["id", "own", "x", "y", "n", "fp", "prefix", "sketch"],
        )

    fps = map_batches(source, run, "id bigint, own bigint, x bigint, y bigint, n int, fp bigint, prefix binary, sketch binary", rows=500)
    first = F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id")).alias("first")
    # texts of one set can have several fingerprints, as these count repeats; one will do, as the set is one node
    nodes = fps.groupBy("x", "y").agg(first, F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "prefix", "sketch"))).withColumn("id", F.col("first.id"))
    # a table, as most readers need few of its columns
    nodes = stored(nodes, "nodes")
    texts = source.select("id", "text")
    of = joined(wide_links(texts, nodes, words, tree_links(texts, nodes, words)))
    nodes = nodes.join(of, nodes["id"] == of["fp"], "left").select("x", "y", "first", F.coalesce("label", "id").alias("label"))
    return fps.select("own", "x", "y"), nodes.join(nodes.groupBy("label").agg(F.min("first").alias("best")), "label").select("x", "y", F.col("best").alias("first"))


def wide_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WIDE_WORDS) -> DataFrame:
    """id_col and component_id of each row of docs, by the trees and the wide search.

    Links join texts whose sets of word shingles have a similarity of SIMILAR at
    least, all of these and no others. Cases are those of near_duplicates; ids
    are integers.
    """
    rows, of = wide_groups(docs, id_col, text, words)
    return rows.join(of, ["x", "y"]).select(F.col("own").alias(id_col), F.col("first.own").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group that the trees and the wide search join, that with the smallest id; all columns are kept.

    Rows that share an id are told apart by their text, so two different texts of
    one id both stay; of rows that agree in both, one is kept. A row without an
    id stays where no row of its group has one. Texts without words are copies of
    each other. Columns of docs may have any name.
    """
    _, of = wide_groups(docs, id_col, text, WIDE_WORDS)
    kept = cut(of.select("first.own", "first.id").distinct())
    key, own, other = (unused(docs, x) for x in ("_key", "_own", "_id"))
    out = docs.withColumn(key, row_key(docs, id_col, text)).join(kept.select(F.col("id").alias(own), F.col("own").alias(other)), (F.col(key) == F.col(own)) & quoted(id_col).eqNullSafe(F.col(other)))
    nth = unused(out, "_nth")
    out = out.withColumn(nth, F.row_number().over(Window.partitionBy(key, quoted(id_col)).orderBy(key))).filter(F.col(nth) == 1)
    return out.select(*map(quoted, docs.columns))
