"""SimHash near-duplicates: byte-position inverted index, count filter, exact verification, components.

Fingerprints: 64 bits over the XXH64 hashes of a text's word 3-grams. Two fingerprints that differ in at most 3 bits
differ in at most 3 of their 8 bytes, so they share at least 5 positional bytes. Tallying single positional bytes
would meet a list of n / 256 fingerprints for each byte and a pair count that grows with n * n. The index therefore
lists fingerprints by 5 positional bytes at once (56 choices): a list holds exactly the pairs whose tally reaches the
guaranteed minimum in those places, no pair that reaches it is missed, and none that doesn't is met. Pairs of a list
are verified by their differing bits.

Scale: equal fingerprints are one entry, so copies cost nothing beyond the fingerprint pass. The entries of a list
differ in 3 bytes, so a list has 2^24 of them at most, whatever the input. Up to LONG entries it is worked on in blocks of
BLOCK x BLOCK in memory; beyond, each entry's up to 3 flips of the 24 bits are looked up, which is linear in its
length. Both find the same pairs. From a list only a spanning forest of the links is emitted, at most one edge an
entry, never its pairs. Components are then found by distributed star rounds. Nothing is capped.

Defined cases: a null or empty text has fingerprint zero and is linked like any other. Rows without doc_id take part;
a component's id is the smallest id in it, null if it has none. Repeated rows are all returned. Other columns are not
read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import text as tx
from ferrule.llm.components import components
from ferrule.session import broadcast_if_small, stage

SHINGLE, SEED, MAX_BITS = 3, 42, 3
SHARED = 8 - MAX_BITS  # positional bytes that a linked pair shares at least
BLOCK, LONG = 1024, 4096
#: Fingerprints that a task turns into entries of lists.
FINGERPRINTS = 20_000
#: Ids of removed documents that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def fingerprints_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A uint64 for each row."""
    raw = tx.LOWER[raw]
    start, end, bounds = tx.words(raw, off, tx.SPACE_WORDS)
    n = len(off) - 1
    if not len(start):
        return np.zeros(n, np.uint64)
    # All words joined by one space: word i lies at at[i] .. at[i] + size[i].
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)
    joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = raw[np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
    count = np.diff(bounds)
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(n), shingles)
    first = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles) + bounds[row]
    last = np.minimum(first + SHINGLE, bounds[row + 1]) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist())), np.uint64, len(first))
    out, some = np.zeros(n, np.uint64), np.flatnonzero(shingles)
    sets = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(sets * 2 > shingles[some][:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (long, the fingerprint's bits) of each row of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.utf8(batch.column(1))
            parts = [fingerprints_of(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in tx.slices(off)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _roots(n: int, edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index of each index's component, by repeated minima over blocks of edges."""
    root = np.arange(n)
    for a, b in edges:
        while True:
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            if (ra == low).all() and (rb == low).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), low)
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _links(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a list (distinct, sorted, sharing SHARED positional bytes) that differ in at most MAX_BITS bits, in
    blocks."""
    n = len(fps)
    if n <= LONG:
        for i in range(0, n, BLOCK):
            for j in range(i, n, BLOCK):
                a, b = np.nonzero(np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, j : j + BLOCK]) <= MAX_BITS)
                yield a + i, b + j
        return
    varying = [1 << k for k in range(64) if int(np.bitwise_or.reduce(fps ^ fps[0])) >> k & 1]
    for flips in range(1, MAX_BITS + 1):
        for bits in itertools.combinations(varying, flips):
            other = fps ^ np.uint64(sum(bits))
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            a = np.flatnonzero((fps[at] == other) & (at > np.arange(n)))
            if len(a):
                yield a, at[a]


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): a spanning forest, list by list, of the links between distinct fingerprints fp."""
    choices = list(itertools.combinations(range(8), SHARED))
    keys = F.array(
        *(
            F.struct(
                F.lit(k).cast("byte").alias("k"),
                F.col("fp").bitwiseAND(F.lit(int(np.array(sum(0xFF << 8 * p for p in chosen), np.uint64).view(np.int64)))).alias("bytes"),
            )
            for k, chosen in enumerate(choices)
        )
    )
    lists = distinct.select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for fps in batch.column(0):
                own = np.sort(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))
                root = _roots(len(own), _links(own))
                moved = np.flatnonzero(root != np.arange(len(own)))
                us.append(own[moved])
                vs.append(own[root[moved]])
            u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return lists.select("fps").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of each row."""
    prints = stage(fingerprints(documents), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # Few bytes hold many fingerprints, and each becomes an entry of 56 lists: spread them over tasks first.
    tasks = max(1, -(-distinct.count() // FINGERPRINTS))
    found = components(links(distinct.select("fp").repartition(tasks, "fp")))
    roots = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = stage(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all columns: of each group of near-duplicates the one with the smallest id.

    Rows that share an id are one document and stay or go together. Rows without id can't be named and all stay.
    """
    named = near_duplicates(documents).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = broadcast_if_small(named.where("not stays").select(F.col("doc_id").alias("_gone")), MAX_BROADCAST_ROWS)
    return documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
