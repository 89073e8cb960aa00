"""Exact Jaccard self-join of documents on word shingles, by universe partition and the pigeonhole principle.

A document's set holds its distinct shingles, as 64-bit hashes. Sizes fall into bands; in
a band the universe of hashes is partitioned into segments. Two sets of sizes a <= b with
Jaccard similarity t differ in at most (a + b)(1 - t)/(1 + t) <= a(1 - t)/t shingles, so
if the segments that both index can stand more differences than that, one of them meets:
a segment stands 1 if only its subset is indexed (the subsets must be equal), 2 if the
subset's one-deletion neighbourhood is indexed as well (they may differ by one). How many
segments a band has, how many of them get the neighbourhood and how many of them a set of
a given size indexes is chosen by expected cost, with a reserve beyond the differences. A
set is indexed in the band of its own size and in the lower ones in which a partner of 3/4
of its size may be at home.

Empty subsets are never indexed, and signatures that more than FREQUENT sets share make no
pairs. Each set knows how many differences its signatures stand beyond need (its slack).
The smaller set of a linked pair that shares no rarer signature shares frequent ones of
more than its slack with the other: such a set may forget its most frequent signatures up
to the slack, which for most sets are all its frequent ones, and asks for the others. Sets
that ask, and those that share as much with one that does, are the dense ones. They meet
by single shingles, taken from the rarest: two linked sets agree on one of the first
a - 6a/7 + 1 shingles of the smaller and the first b - 3b/4 + 1 of the larger, in an order
that all share, so a passage that most documents hold makes pairs only of sets that hold
little else. If even a set's non-empty subsets are too few (about one set in a million),
it is compared with all sets in the size range.

Candidates are verified exactly, first as stars (each group's smallest set with the
others; among dense sets the one with the most frequent shingles, which stands in the
middle of its near copies), then all pairs of a group that are still in different
components, unless bit maps rule them out for certain. So a large group of near copies
costs a few comparisons each, and no link between different components is ever skipped.
Equal sets are one node throughout.

A signature that more than FREQUENT sets of one task's portion share is known to be
frequent there and then: its sharers travel by portion, not by signature, so that no task
gets all of a passage's sets however many documents hold it.

Null and empty texts have an empty set and are linked with nothing. A text with fewer
words than a shingle is one shingle. Texts are read whole. Sets are compared, not ids:
rows with equal doc_ids keep a row and a component each, and a text that only rows
without a doc_id hold still links others. component_id is the smallest doc_id of the
component, null if it has none. Extra columns are ignored. Two different sets count as
equal if their 64-bit digests agree (one chance in 2**64 a pair).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop, give_back, saved, text_blocks, thrifty
from tidemark.llm.graph import components
from tidemark.llm.words import block_words, mix

SHINGLE, PER_CENT = 5, 75
#: Ratio of the sizes at home in a band; sets that share a signature before it counts as frequent; signatures a bucket holds, about.
RATIO, FREQUENT, BUCKET = 1.8, 16, 500_000
#: Sets of so few shingles have one segment with its neighbourhood; up to the second, as many segments as make shared ones rare.
TINY, SMALL, SPREAD = 5, 66, 1 << 12
#: Share of a set's shingles that may lie in frequent signatures before it has to ask for them; also the reserve for empty subsets.
LOSS = 0.3
#: Cells of the counts by which dense sets order their shingles, whatever the input; shingles that one numpy pass orders.
CELLS, ORDERED = 1 << 20, 500_000
#: Rows of a dense shingle's group that one task compares with each other, at most twice as many.
BLOCK = 1024
#: Places of the bit maps that travel with a dense set's shingles, 64 bytes whatever its size.
MAP_BITS = 512
#: Shared shingles before one's own that travel with a dense set, so that a pair is made at its first one.
EARLIER = 16
#: Leaders of signatures, and of shingles, with which a set is compared before the pairs across components.
LEADERS = 4
#: Text bytes that one numpy pass works on.
PIECE = 700_000
#: Size classes within the ratio of linked sizes.
STEPS = 4
#: Partners of a set that one part verifies.
MEMBERS = 256
#: Bits of the filter that picks the documents whose sets are needed again, whatever the input.
FILTER_BITS = 1 << 26

_COEFFICIENTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Sets(NamedTuple):
    """Of a block: distinct shingle hashes, sorted within a text; each text's first (one entry more than texts)."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def digests(self) -> np.ndarray:
        """A 64-bit hash of each set."""
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(mix(self.hashes ^ np.uint64(0x5E75)), out=sums[1:])
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Sets:
    w = block_words(texts)
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(w.hashes)) - w.first[:-1][owner]
    n = len(w.hashes)
    whole = np.zeros(n, np.uint64)
    for k in range(min(width, max(int(counts.max(initial=0)), 1))):
        upto = n - k
        inside = place[:upto] + k < counts[owner[:upto]]
        whole[:upto] += np.where(inside, w.hashes[k:] * _COEFFICIENTS[k], np.uint64(0))
    starts = (place + width <= counts[owner]) | (place == 0)
    hashes, owner = mix(whole[starts]), owner[starts]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return Sets(hashes[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1)))


class Band(NamedTuple):
    """Sizes low <= n < high at home; segments, of which the first `near` have neighbourhoods; indexed[n - low] segments of a set at home."""

    number: int
    low: int
    high: int
    segments: int
    near: int
    indexed: np.ndarray


def differences(size: int | np.ndarray, per_cent: int = PER_CENT) -> int | np.ndarray:
    """Most differences between a set of this size and a linked set of no smaller one."""
    return size * (100 - per_cent) // per_cent


def _stands(share: np.ndarray, near_share: float) -> np.ndarray:
    """Mean of the differences that a segment of share expected shingles stands."""
    none, one = np.exp(-share), share * np.exp(-share)
    return 1 - none + near_share * (1 - none - one)


def _needed(sizes: np.ndarray, segments: float, near_share: float, per_cent: int) -> np.ndarray:
    """Segments that sets must index to stand the differences and keep the reserve."""
    need = differences(sizes, per_cent) + 1.0 + LOSS * sizes
    return np.maximum.accumulate(np.ceil(need / _stands(sizes / segments, near_share)))


@cache
def band(number: int, per_cent: int = PER_CENT) -> Band:
    """The band in which sizes from RATIO**number are at home, with its segments chosen by cost.

    The cost of a choice is the number of signatures of a set at home, a signature of a
    single shingle counting two, since it meets any set with that shingle alone in the segment.
    """
    low, high = _low(number), _low(number + 1)
    if high <= TINY + 1:
        return Band(number, low, high, 1, 1, np.ones(max(high - low, 0), np.int64))
    sizes = np.arange(low, high, dtype=float)
    if high <= SMALL:
        return Band(number, low, high, SPREAD, 0, np.full(high - low, SPREAD))
    best = None
    for near_share in (0.0, 0.1, 0.25, 0.5, 1.0):
        segments = (differences(high, per_cent) + LOSS * high) / (1 + near_share) + 1.0
        for _ in range(60):
            segments = max(2.0, 0.5 * segments + 0.5 * _needed(sizes, segments, near_share, per_cent)[-1])
        m = int(math.ceil(segments))
        indexed = np.minimum(m, _needed(sizes, m, near_share, per_cent))
        share = sizes / m
        none, one = np.exp(-share), share * np.exp(-share)
        cost = float((indexed * ((1 - none) + one + near_share * (share - one))).mean())
        if best is None or cost < best[0]:
            best = cost, Band(number, low, high, m, int(math.ceil(near_share * m)), indexed.astype(np.int64))
    return best[1]


def _low(number: int) -> int:
    """First size of a band; the first bands are single sizes up to TINY."""
    if number <= TINY:
        return number
    return max(TINY + 1, int(round((TINY + 1) * RATIO ** (number - TINY - 1))))


def size_class(sizes: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Sizes that may be linked have classes at most STEPS apart, the smaller one the lower class or the same."""
    return np.floor(STEPS * np.log(np.maximum(sizes, 1)) / math.log(100 / per_cent) + 1e-9).astype(np.uint8)


def home(sizes: np.ndarray) -> np.ndarray:
    lows = np.array([_low(k) for k in range(64)])
    return np.searchsorted(lows, sizes, side="right") - 1


class Signatures(NamedTuple):
    """Signatures, the text of each, how many differences it stands, and for each text what its own band's signatures stand beyond need."""

    values: np.ndarray
    owners: np.ndarray
    weights: np.ndarray
    own_band: np.ndarray
    slack: np.ndarray


def signatures(sets: Sets, per_cent: int = PER_CENT) -> Signatures:
    sizes = sets.sizes
    bands = home(sizes)
    slack = np.full(len(sizes), -1, np.int64)
    out: list[tuple] = []
    mixed = mix(sets.hashes ^ np.uint64(0x51617))
    high = sets.hashes >> np.uint64(32)
    for number in np.unique(bands[sizes > 0]).tolist():
        for at in range(number, 0, -1):
            b = band(at, per_cent)
            # a set of this band visits the lower one if a set at home there may be linked with it
            here = (bands == number) & (sizes > 0)
            if at != number:
                here &= sizes * per_cent <= 100 * (b.high - 1)
            if not here.any():
                break
            _of_band(sets, here, b, at == number, mixed, high, slack, out, per_cent)
    if not out:
        return Signatures(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, bool), slack)
    return Signatures(*(np.concatenate([x[k] for x in out]) for k in range(4)), slack)


def _of_band(sets: Sets, here: np.ndarray, b: Band, at_home: bool, mixed: np.ndarray, high: np.ndarray, slack: np.ndarray, out: list, per_cent: int) -> None:
    texts = np.flatnonzero(here)
    sizes = sets.sizes[texts]
    upto = b.indexed[sizes - b.low] if at_home else np.full(len(texts), b.segments)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.repeat(sets.first[texts] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    source = np.arange(len(owner)) + start
    # hashes are sorted within a text, so their segments are in order too
    segment = ((high[source] * np.uint64(b.segments)) >> np.uint64(32)).astype(np.int64)
    taken = segment < upto[owner]
    owner, source, segment = owner[taken], source[taken], segment[taken]
    begins = np.ones(len(owner), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    runs = np.flatnonzero(begins)
    if not len(runs):
        return
    length = np.diff(np.append(runs, len(owner)))
    sums = np.add.reduceat(mixed[source], runs)
    salt = mix(np.uint64(b.number << 40) + segment[runs].astype(np.uint64))
    near = segment[runs] < b.near
    stands = 1 + (near & (length > 1)).astype(np.int8)
    own = np.full(len(runs), at_home)
    out.append((mix(sums ^ salt), texts[owner[runs]], stands, own))
    if at_home:
        slack[texts] = np.bincount(owner[runs], weights=stands, minlength=len(texts)).astype(np.int64) - differences(sizes, per_cent) - 1
    if b.near:
        run = np.cumsum(begins) - 1
        some = (near & (length > 1))[run]
        run = run[some]
        out.append((mix((sums[run] - mixed[source[some]]) ^ salt[run]), texts[owner[runs[run]]], np.ones(len(run), np.int8), np.full(len(run), at_home)))


def bit_maps(sets: Sets) -> list[bytes]:
    """Of each set a bit for every shingle, at its hash modulo the map's length, the power of two from 2 to 4 bits a shingle (64 at least)."""
    bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * sets.sizes, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(first[:-1], sets.sizes) + (sets.hashes & (np.repeat(bits, sets.sizes) - 1).astype(np.uint64)).astype(np.int64)
    marks = np.zeros(int(first[-1]), np.uint8)
    marks[at] = 1
    packed = np.packbits(marks, bitorder="little").tobytes()
    edges = (first // 8).tolist()
    return [packed[i:j] if n else None for i, j, n in zip(edges, edges[1:], sets.sizes.tolist(), strict=False)]


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, node (hash of the set; null if it is empty), n_shingles, bits (see bit_maps()). docs: doc_id, text, row_key."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=PIECE):
            s = shingle_sets(block.column(1))
            out = [block.column(0), block.column(2), pa.array(s.digests().view(np.int64), mask=s.sizes == 0), pa.array(s.sizes.astype(np.int64)), pa.array(bit_maps(s), pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row_key", "node", "n_shingles", "bits"])

    return docs.select("doc_id", "text", "row_key").mapInArrow(run, "doc_id long, row_key long, node long, n_shingles long, bits binary")


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bit maps (a row each) at a shorter width in bytes: a hash modulo the shorter length is marked if any of its longer places is."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, width), axis=1)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bit maps don't rule out.

    Every place marked in one map only stands for at least one shingle that the other set
    lacks, so the bound on the intersection is certain: no linked pair is lost.
    """
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            one, two = (batch.column(i).to_pylist() for i in (4, 5))
            lengths = np.array([(len(x), len(y)) for x, y in zip(one, two, strict=True)]).reshape(-1, 2)
            keep = np.zeros(len(n), bool)
            for la, lb in np.unique(lengths, axis=0).tolist():
                rows = np.flatnonzero((lengths[:, 0] == la) & (lengths[:, 1] == lb))
                x = _folded(np.frombuffer(b"".join(one[i] for i in rows), np.uint8).reshape(len(rows), la), min(la, lb))
                y = _folded(np.frombuffer(b"".join(two[i] for i in rows), np.uint8).reshape(len(rows), lb), min(la, lb))
                only_x, only_y = (np.bitwise_count(d).sum(axis=1, dtype=np.int64) for d in (x & ~y, y & ~x))
                most = np.minimum(n[rows] - only_x, m[rows] - only_y)
                keep[rows] = (100 + PER_CENT) * most >= PER_CENT * (n[rows] + m[rows])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


#: What a task gathers before it gives its signatures out.
GATHER = 400_000


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Signatures by bucket: each row holds those of one bucket from one portion of a task, as packed arrays, and the sets they are of.

    Signatures that are frequent within the portion go to one of as many buckets again, all of a
    portion's to the same; the bucket of such a signature is only told so.
    """

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Signatures] = []
        nodes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        seen: set[int] = set()
        count = at = 0

        def row(b: int, **packed: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([packed[c].tobytes() if c in packed else b""], pa.binary()) for c in PACKED[1:])], names=PACKED)

        def out() -> Iterator[pa.RecordBatch]:
            values, owners, weights, own = (np.concatenate([x[k] for x in held]) for k in range(4))
            node, size, slack = np.concatenate(nodes), np.concatenate(sizes), np.concatenate([x.slack for x in held])
            bucket = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            key = (bucket.astype(np.int64) << 32) | (values & np.uint64(0xFFFFFFFF)).astype(np.int64)

            def signed(mine: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
                # bits and byte planes, as they compress; only values and node numbers cost their length
                kinds, runs = np.unique(owners[mine], return_counts=True)
                return {"values": of[mine], "runs": _planes(runs), "own": np.packbits(own[mine]), "twice": np.packbits(weights[mine] > 1), "nodes": node[kinds], "classes": size_class(size[kinds])}

            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
            length = np.diff(np.append(starts, len(order)))
            often, times = key[order[starts[length > FREQUENT]]], length[length > FREQUENT]
            hot = order[np.repeat(length > FREQUENT, length)]
            if len(hot):
                yield row(buckets + int(node[0] % buckets), **signed(hot[np.argsort(owners[hot], kind="stable")], key), counts=_planes(np.repeat(times, times)[np.argsort(owners[hot], kind="stable")]))
            rest = order[np.repeat(length <= FREQUENT, length)]
            rest = rest[np.lexsort((owners[rest], bucket[rest]))]
            edges, often_edges = np.searchsorted(bucket[rest], np.arange(buckets + 1)), np.searchsorted(often >> 32, np.arange(buckets + 1))
            told = (node.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            by_told = np.argsort(told, kind="stable")
            told_edges = np.searchsorted(told[by_told], np.arange(buckets + 1))
            low = values.astype(np.uint32)
            for b in range(buckets):
                mine = rest[edges[b] : edges[b + 1]]
                tell = by_told[told_edges[b] : told_edges[b + 1]]
                known = often[often_edges[b] : often_edges[b + 1]]
                if len(mine) or len(tell) or len(known):
                    yield row(b, **signed(mine, low), told=node[tell], slack=_planes(slack[tell]), often=known.astype(np.uint32))

        for block in text_blocks(batches, most=PIECE):
            s = shingle_sets(block.column(0))
            node = s.digests().view(np.int64)
            new = [i for i, (x, n) in enumerate(zip(node.tolist(), s.sizes.tolist(), strict=True)) if n and x not in seen and not seen.add(x)]  # equal sets once
            keep = np.zeros(len(node), bool)
            keep[new] = True
            s = Sets(s.hashes[np.repeat(keep, s.sizes)], np.concatenate([[0], np.cumsum(s.sizes[keep])]))
            g = signatures(s)
            held.append(g._replace(owners=g.owners + at))
            nodes.append(node[keep])
            sizes.append(s.sizes)
            at += len(new)
            count += len(g.values)
            if count > GATHER:
                yield from out()
                held, nodes, sizes, seen, count, at = [], [], [], set(), 0, 0
        if count:
            yield from out()

    return docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in PACKED[1:]))


#: What a row of _bucketed() packs. values: the low half of signatures; for frequent ones whole keys, with the sharers in the portion in counts. often: frequent ones of the bucket.
PACKED = ["bucket", "values", "runs", "own", "twice", "nodes", "classes", "told", "slack", "often", "counts"]


def _planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all 32-bit integers, then the second ones and so on."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _unplaned(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()

#: kind 0: a group of sets that share a signature (key: hash of its members); 1: one set's share in a frequent signature (key, with the sets that share it); 2: a set's slack.
GROUPS = "kind int, key long, nodes array<long>, classes array<int>, weight int, own boolean, sharers long"


def _groups(bucketed: DataFrame, buckets: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        first_bucket = group.column("bucket")[0].as_py()
        hot = first_bucket >= buckets
        parts = {c: [x.as_py() for x in group.column(c)] for c in PACKED[1:]}
        kinds = ("i8" if hot else "u4", "u1", "u1", "u1", "i8", "u1", "i8", "u1", "u4", "u1")
        arrays = {c: [np.frombuffer(x, t) for x in parts[c]] for c, t in zip(PACKED[1:], kinds, strict=True)}
        del parts
        values, nodes, classes = (np.concatenate(arrays[c]) for c in ("values", "nodes", "classes"))
        owners = np.repeat(np.arange(len(nodes)), np.concatenate([_unplaned(x) for x in arrays["runs"]]))
        own, twice = (np.concatenate([np.unpackbits(x, count=len(v)) for x, v in zip(arrays[c], arrays["values"], strict=True)]) for c in ("own", "twice"))
        told, slack, counts = np.concatenate(arrays["told"]), np.concatenate([_unplaned(x) for x in arrays["slack"]]), np.concatenate([_unplaned(x) for x in arrays["counts"]])
        known = np.unique(np.concatenate(arrays["often"]))
        del arrays
        marks = (1 + twice) * 2 + own
        node, size = nodes[owners], classes[owners].astype(np.int32)
        if hot:
            names, x, m, n, sharers = values, node, marks, size, counts.astype(np.int64) << 10  # more than any count of the rest
            first, offsets, member, digest = np.empty(0, int), np.zeros(1, np.int32), np.empty(0, int), np.empty(0, np.uint64)
            often = np.ones(len(x), bool)
        else:
            order = np.argsort(values, kind="stable")
            v = values[order]
            same = v[1:] == v[:-1]
            shared = known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v if len(known) else np.zeros(len(v), bool)
            shared[1:] |= same
            shared[:-1] |= same
            order = order[shared]
            order = order[np.lexsort((node[order], values[order]))]
            v, x, m, n = values[order], node[order], marks[order], size[order]
            fresh = np.ones(len(v), bool)
            fresh[1:] = (v[1:] != v[:-1]) | (x[1:] != x[:-1])  # one set's copies from several tasks
            v, x, m, n = v[fresh], x[fresh], m[fresh], n[fresh]
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.empty(0, int)
            length = np.diff(np.append(starts, len(v)))
            frequent = (length > FREQUENT) | np.isin(v[starts], known)
            digest = np.add.reduceat(mix(x.view(np.uint64)), starts) if len(v) else np.empty(0, np.uint64)
            first = np.flatnonzero((length > 1) & ~frequent)
            first = first[np.unique(digest[first], return_index=True)[1]] if len(first) else first
            member = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[first], length[first], strict=True)]) if len(first) else np.empty(0, int)
            offsets = np.concatenate([[0], np.cumsum(length[first])]).astype(np.int32)
            often = np.repeat(frequent, length)
            sharers = np.repeat(length, length)
            names = v.astype(np.int64) | (first_bucket << 32)
        k, f, s = len(first), int(often.sum()), len(told)
        one = np.arange(f + s + 1, dtype=np.int32)
        members = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[member])), pa.ListArray.from_arrays(pa.array(one), pa.array(np.concatenate([x[often], told])))])
        sizes = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(n[member])), pa.ListArray.from_arrays(pa.array(one), pa.array(np.concatenate([n[often], np.zeros(s, "i4")])))])
        out = pa.table(
            {
                "kind": pa.array(np.repeat([0, 1, 2], [k, f, s]).astype(np.int32)),
                "key": pa.array(np.concatenate([digest[first].view(np.int64), names[often], np.zeros(s, np.int64)])),
                "nodes": members,
                "classes": sizes,
                "weight": pa.array(np.concatenate([np.zeros(k, np.int32), (m[often] >> 1).astype(np.int32), slack.astype(np.int32)])),
                "own": pa.array(np.concatenate([np.zeros(k, bool), (m[often] & 1).astype(bool), np.zeros(s, bool)])),
                "sharers": pa.array(np.concatenate([np.zeros(k, np.int64), sharers[often].astype(np.int64), np.zeros(s, np.int64)])),
            }
        )
        give_back()
        return out

    return bucketed.groupBy("bucket").applyInArrow(run, GROUPS)


def _near_in_size(a: str, b: str) -> str:
    """Of size classes; the exact sizes are compared later."""
    return f"abs({a} - {b}) <= {STEPS}"


def _spot() -> Column:
    return F.pmod(F.xxhash64("row_key"), F.lit(FILTER_BITS)) + 1


def _spotted(docs: DataFrame, wanted: DataFrame, sets: bool = False) -> DataFrame:
    """row_key, text of the documents wanted (row_key) and few others, or with sets row_key, node, hashes; a filter of fixed size keeps most of the rest out of shuffles."""
    marked = wanted.select(_spot().alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    filter_ = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marked.toLocalIterator():  # FILTER_BITS bits in all
        raw = np.frombuffer(bytes(r["bits"]), np.uint8)
        filter_[(r["b"] - 1) * len(raw) : r["b"] * len(raw)] = raw
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy() - 1
            yield batch.filter(pa.array((sent.value[s >> 3] >> (s & 7)) & 1 == 1)).select([0, 1])

    @thrifty
    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(found(batches), most=PIECE):
            own = shingle_sets(block.column(1))
            hashes = pa.ListArray.from_arrays(pa.array(own.first.astype(np.int32)), pa.array(own.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(own.digests().view(np.int64)), hashes], names=["row_key", "node", "hashes"])

    marked_docs = docs.where("text IS NOT NULL").select("row_key", "text", _spot().alias("s"))
    return marked_docs.mapInArrow(as_sets, "row_key long, node long, hashes array<long>") if sets else marked_docs.mapInArrow(thrifty(found), "row_key long, text string")


def _needed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes of the documents wanted (row_key, node); a document of several equal rows comes as often."""
    return _spotted(docs, wanted, sets=True).join(wanted, ["row_key", "node"], "left_semi").select("node", "hashes")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) that are linked, from their documents' whole texts.

    Texts travel, as they are smaller than sets of hashes and compress. A part holds one set a
    and up to about MEMBERS partners, so that a set with many partners is spread.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    placed = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    roles = placed.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("role")).union(placed.select("a", "part", F.col("a").alias("node"), F.lit(0).alias("role")).distinct())
    asked = roles.join(nodes.select("node", "row_key"), "node")
    found = _spotted(docs, asked.select("row_key").distinct()).join(asked, "row_key").select("a", "part", "role", "node", "text")

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, np.empty(0, np.uint64)
        for block in text_blocks(batches, most=PIECE):
            s = shingle_sets(block.column(4))
            a, part, role, node = (block.column(i).to_numpy() for i in range(4))
            right = s.digests().view(np.int64) == node  # another text may have the same hash
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(right).tolist():
                own = s.hashes[s.first[i] : s.first[i + 1]]
                if role[i] == 0:
                    key, one = (a[i], part[i]), own
                elif key == (a[i], part[i]) and len(own):
                    at = np.searchsorted(one, own)
                    met = int((one[np.minimum(at, len(one) - 1)] == own).sum())
                    if 100 * met >= PER_CENT * (len(one) + len(own) - met):
                        out.append((a[i], node[i]))
            got = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return found.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long")


def _set_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Sets]]:
    """Nodes and sets of batches of node, hashes, cut to about ORDERED shingles."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + ORDERED, side="right")))
            some = batch.slice(at, to - at)
            yield some.column(0).to_numpy(), Sets(some.column(1).flatten().to_numpy().view(np.uint64), np.concatenate([[0], ends[at:to] - before]))
            at = to


def _cell_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets (node, hashes) fall into each of CELLS cells."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for _, s in _set_blocks(batches):
            total += np.bincount((s.hashes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    got = sets.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def _prefixes(sets: DataFrame) -> DataFrame:
    """key (a shingle), node, rank (from 0), n (size), central, asks, map: of each set (node, hashes) the first shingles in the shared order, and whether it asks for them as a pair's smaller set.

    central: the higher, the more frequent the set's shingles are on average, as those of the middle of a group of near copies.
    map: a bit map of MAP_BITS places, of which a set's shingles mark those of their hashes.
    """
    sent = sets.sparkSession.sparkContext.broadcast(_cell_counts(sets))

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, s in _set_blocks(batches):
            size = s.sizes
            owner = np.repeat(np.arange(len(node)), size)
            times = sent.value[(s.hashes & np.uint64(CELLS - 1)).astype(np.int64)]
            central = 1000 * np.bincount(owner, np.log(times), len(node)) / np.maximum(size, 1)
            order = np.lexsort((s.hashes, times, owner))
            rank = np.arange(len(owner)) - s.first[:-1][owner]  # owners come in turn
            as_larger, as_smaller = size - -(-PER_CENT * size // 100) + 1, size - -(-2 * PER_CENT * size // (100 + PER_CENT)) + 1
            some = np.flatnonzero(rank < as_larger[owner])
            of = owner[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.hashes[order[some]].view(np.int64)), pa.array(node[of]), pa.array(rank[some].astype(np.int32)), pa.array(size[of].astype(np.int32)), pa.array(central[of].astype(np.int32)), pa.array(rank[some] < as_smaller[of]), pa.array(_marked(owner, s.hashes, len(node)), pa.binary()).take(pa.array(of))],
                names=["key", "node", "rank", "n", "central", "asks", "map"],
            )

    return sets.mapInArrow(run, "key long, node long, rank int, n int, central int, asks boolean, map binary")


def _marked(owner: np.ndarray, hashes: np.ndarray, count: int) -> list[bytes]:
    marks = np.zeros((count, MAP_BITS), np.uint8)
    for at in range(0, len(owner), ORDERED):
        marks[owner[at : at + ORDERED], (hashes[at : at + ORDERED] & np.uint64(MAP_BITS - 1)).astype(np.int64)] = 1
    return [x.tobytes() for x in np.packbits(marks, axis=1)]


def _cross_pairs(shares: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that share a shingle for which the smaller one asks, less those that sizes and bit maps rule out for certain.

    shares: key, node, rank, n (size), asks, map, component. Shingles of the same sets count
    once; a group over BLOCK rows is cut into blocks whose pairs are tasks of their own. A pair
    with one of the last EARLIER shingles in common comes from there, so a pair's first common
    shingle always gives it and few others do: who asks for a shingle asks for all before it.
    """
    digests = shares.groupBy("key").agg(F.sum(F.xxhash64("node", "asks").cast("decimal(38,0)")).alias("d"), F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    once = digests.where("low != high").groupBy("d", "size").agg(F.min("key").alias("key"))
    placed = shares.join(once.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key")
    before = Window.partitionBy("node").orderBy("rank").rowsBetween(-EARLIER, -1)
    placed = placed.withColumn("earlier", F.collect_list("key").over(before))
    own = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = own.select("key", "node", "n", "asks", "map", "component", "earlier", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        node, n, component, asks, block = (group.column(c).to_numpy() for c in ("node", "n", "component", "asks", "own"))
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        n = n.astype(np.int64)
        maps = np.frombuffer(b"".join(group.column("map").to_pylist()), np.uint64).reshape(len(node), -1)
        lists = group.column("earlier").combine_chunks()
        count = pc.list_value_length(lists).to_numpy()
        earlier, listed = np.zeros((len(node), EARLIER), np.int64), np.arange(EARLIER) < count[:, None]
        earlier[listed] = lists.flatten().to_numpy()
        kinds, sizes = np.unique(component, return_counts=True)
        rest = np.flatnonzero(component != kinds[sizes.argmax()])  # every pair across components has one outside the largest
        found = []
        for k in rest:
            near = (component != component[k]) & ((n <= n[k]) & asks | (n >= n[k]) & asks[k]) & (100 * np.minimum(n, n[k]) >= PER_CENT * np.maximum(n, n[k]))
            if across:
                near &= block != block[k]
            at = np.flatnonzero(near)
            only, lacking = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (maps[at] & ~maps[k], maps[k] & ~maps[at]))
            most = np.minimum(n[at] - only, n[k] - lacking)
            at = at[(100 + PER_CENT) * most >= PER_CENT * (n[at] + n[k])]
            met = (earlier[at][:, :, None] == earlier[k, : count[k]]) & listed[at][:, :, None]
            other = node[at[~met.any(axis=(1, 2))]]
            found.append(np.stack([np.minimum(other, node[k]), np.maximum(other, node[k])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0].astype(np.int64)), "b": pa.array(pairs[:, 1].astype(np.int64))})

    return grouped.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


#: Shingles of the sets that one pass compares with all documents.
PASS = 2_000_000


def _compared_with_all(docs: DataFrame, few: DataFrame) -> list[DataFrame]:
    """Links (a, b) of a few sets (node, hashes) with all documents' sets, one scan of docs for each PASS of their shingles."""
    out: list[DataFrame] = []
    held: list[tuple[int, np.ndarray]] = []

    def scan() -> DataFrame:
        names = np.array([x[0] for x in held])
        sizes = np.array([len(x[1]) for x in held])
        hashes = np.concatenate([x[1] for x in held]).view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        sent = docs.sparkSession.sparkContext.broadcast((names, sizes, hashes[order], np.repeat(np.arange(len(held)), sizes)[order]))

        @thrifty
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, sizes, hashes, owner = sent.value
            for block in text_blocks(batches, most=PIECE):
                s = shingle_sets(block.column(0))
                node, text = s.digests().view(np.int64), np.repeat(np.arange(len(s.sizes)), s.sizes)
                low, high = np.searchsorted(hashes, s.hashes), np.searchsorted(hashes, s.hashes, side="right")
                count = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                met, i = np.unique(np.repeat(text, count) * len(names) + owner[at], return_counts=True)
                t, o = met // len(names), met % len(names)
                linked = (100 * i >= PER_CENT * (s.sizes[t] + sizes[o] - i)) & (node[t] != names[o])
                yield pa.RecordBatch.from_arrays([pa.array(names[o[linked]]), pa.array(node[t[linked]])], names=["a", "b"])

        return docs.where("text IS NOT NULL").select("text").mapInArrow(run, "a long, b long")

    for r in few.toLocalIterator():
        held.append((r["node"], np.array(r["hashes"], np.int64)))
        if sum(len(x[1]) for x in held) > PASS:
            out.append(saved(scan().distinct()))
            held = []
    if held:
        out.append(saved(scan().distinct()))
    return out


def _led(asked: DataFrame) -> DataFrame:
    """a, b: each node (b) with LEADERS of its leaders, those that most others have as well. asked: node, leader, sharers.

    What they don't join comes with the pairs across components, so none is lost.
    """
    once = asked.groupBy("node", "leader").agg(F.max("sharers").alias("sharers"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sharers"), "leader")))
    return ranked.where(f"rank <= {LEADERS}").select(F.col("leader").alias("a"), F.col("node").alias("b"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of both, by which a row is found again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs: doc_id, text."""
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (see _keyed()), n_shingles, class (equal for the rows of a component, null for empty sets), component_id; one row per row of docs."""
    spark = docs.sparkSession
    docs = _keyed(docs)
    rows = saved(documents(docs))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, math.ceil(0.65 * total / BUCKET))
    nodes = saved(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("row_key", "doc_id"), F.min("row_key")).alias("row_key"), F.max("n_shingles").alias("n"), F.first("bits", ignorenulls=True).alias("bits")))
    groups = saved(_groups(_bucketed(docs.where("text IS NOT NULL"), buckets), buckets))

    # a set's copies may have come with several portions
    shares = groups.where("kind = 1").groupBy("key", F.col("nodes")[0].alias("node")).agg(*(F.max(c).alias(a) for c, a in ((F.col("classes")[0], "n"), (F.col("weight"), "weight"), (F.col("own"), "own"), (F.col("sharers"), "sharers"))))
    slack = groups.where("kind = 2").groupBy(F.col("nodes")[0].alias("node")).agg(F.max("weight").alias("slack"))
    short = slack.where("slack < 0")
    # A linked pair that shares no rarer signature shares frequent ones of more than the smaller set's slack. So that set may
    # forget its most frequent signatures up to its slack, and its partner must have more than that in frequent ones itself.
    of_set = Window.partitionBy("node", "own")
    mine = shares.withColumns({"upto": F.sum("weight").over(of_set.orderBy(F.desc("sharers"), "key")), "reach": F.sum("weight").over(of_set)})
    met = mine.join(slack.where("slack >= 0"), "node", "left").withColumn("need", F.when(F.col("own") & (F.col("upto") > F.col("slack")), F.col("slack") + 1))
    told = saved(met.select("key", "node", "reach", "need"))
    asked = told.where("need IS NOT NULL").groupBy("key").agg(F.min("need").alias("least"))
    dense = told.join(asked, "key").where("need IS NOT NULL OR reach >= least").select("node").distinct()
    sets = saved(_needed_sets(docs, nodes.join(dense, "node").select("row_key", "node")))
    shingles = saved(_prefixes(sets))
    drop(sets)
    drop(told)
    # the most central set of a shingle leads, so that a group of near copies is a component before pairs are made
    ends = (F.min("node").alias("first"), F.max("node").alias("last"), F.max("asks").alias("asked"), F.count("*").alias("sharers"))
    met_in = shingles.groupBy("key").agg(F.max(F.struct("central", "node"))["node"].alias("leader"), *ends).where("first != last AND asked").select("key", "leader", "sharers")
    of_asked = saved(shingles.join(met_in, "key"))
    drop(shingles)
    led = _led(of_asked.where("asks AND leader != node").select("node", "leader", "sharers"))

    runs = saved(groups.where("kind = 0").select("key", "nodes", "classes").dropDuplicates(["key"]))
    star = runs.select(F.col("nodes")[0].alias("a"), F.col("classes")[0].alias("m"), F.explode(F.arrays_zip("nodes", "classes")).alias("x"), F.size("nodes").alias("sharers")).select("a", F.col("x.nodes").alias("b"), "m", F.col("x.classes").alias("n"), "sharers").where(f"a != b AND {_near_in_size('m', 'n')}")
    pairs = saved(_led(star.select(F.col("b").alias("node"), F.col("a").alias("leader"), "sharers")).union(led).distinct())
    likely = saved(_plausible(pairs, nodes))
    first = saved(_verified(docs, nodes, likely))
    drop(likely)
    stars = saved(components(spark, first))

    member = runs.select("key", F.explode(F.arrays_zip("nodes", "classes")).alias("x")).select("key", F.col("x.nodes").alias("node"), F.col("x.classes").alias("n"))
    placed = member.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.collect_list(F.struct("component", "node", "n")).alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    across = mixed.select(
        F.explode(F.expr(f"flatten(transform(m, x -> transform(filter(m, y -> y.node > x.node AND y.component != x.component AND {_near_in_size('x.n', 'y.n')}), y -> named_struct('a', x.node, 'b', y.node))))")).alias("p")
    ).select("p.a", "p.b")
    often = of_asked.join(stars, "node", "left").select("key", "node", "rank", "n", "asks", "map", F.coalesce("component", "node").alias("component"))
    more = saved(_plausible(across.union(_cross_pairs(often)).distinct().join(pairs, ["a", "b"], "left_anti"), nodes))
    second = saved(_verified(docs, nodes, more))
    few = short.join(nodes, "node").select("row_key", "node")
    for found in _compared_with_all(docs, saved(_needed_sets(docs, few).dropDuplicates(["node"]))):
        second = second.union(found)
    for done in (pairs, more, runs, of_asked):
        drop(done)

    # components of the stars' components
    ends = second.join(stars.toDF("a", "x"), "a", "left").join(stars.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    whole = saved(components(spark, ends))
    placed = nodes.select(F.col("node").alias("n")).join(stars, F.col("n") == F.col("node"), "left").select("n", F.coalesce("component", "n").alias("part"))
    labels = placed.join(whole.toDF("w", "root"), F.col("part") == F.col("w"), "left").select(F.col("n").alias("node"), F.coalesce("root", "part").alias("component"))
    of_node = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("class"))
    named = of_node.join(of_node.groupBy("class").agg(F.min("rep").alias("component_id")), "class").select("node", "class", "component_id")
    return rows.join(named, "node", "left").select("doc_id", "row_key", "n_shingles", "class", F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("doc_id"))).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null ones last), of several rows of that document one; rows with empty sets all stay."""
    found = saved(classes(docs).where("class IS NOT NULL").select("doc_id", "row_key", "class"))
    kept = saved(found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("row_key")))
    times = found.groupBy(F.col("row_key").alias("found_row_key")).agg(F.count("*").alias("found_times"))
    gone = times.join(kept, F.col("found_row_key") == F.col("row_key"), "left").select("found_row_key", "found_times", F.col("row_key").isNotNull().alias("found_kept"))
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    out = docs.join(gone.where("NOT found_kept OR found_times > 1"), key == F.col("found_row_key"), "left_anti")
    again = gone.where("found_kept AND found_times > 1").select("found_row_key")
    if again.isEmpty():
        return out
    rows = docs.join(again, key == F.col("found_row_key")).groupBy("found_row_key").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return out.union(rows.select("row.*"))
