"""Substring deduplication by seed and extend over winnowed anchors.

A repeat is a run of at least `size` words that also stands in a document with a smaller id. Every window of `size`
words has an anchor: of its `size - SEED + 1` word SEED-grams the one with the least hash (the leftmost of equals).
The anchor depends on the window's words alone, so two equal windows have equal anchors at equal places, and about
two anchors in `size - SEED + 2` places serve all windows. Documents are joined on anchors (the seeds): an occurrence
brings its span, the words of all windows that it serves. Each occurrence is paired with the smallest document that
holds one of its windows, the match is extended from the seed word by word to the left and to the right as far as both
spans go, its words are compared byte by byte, and matches of `size` words and more are repeats. Longer repeats have
more anchors; the union of their matches is the maximal repeat, and it is removed.

Scale: occurrences are packed by bucket of anchors, so there is no row for each word or window. Within a map task's
slice, occurrences with the same span are settled against the smallest id of the slice, so a passage held by a third of
all rows sends a row for each slice and not for each document. An occurrence is paired with one document for each of
its windows at most, so a group of k copies costs k. Buckets and tasks follow the input's size. One anchor's occurrences
with different words around them meet in one task, at some 50 bytes each. Results return as (document, runs) and meet
the compressed text in one join on doc_id. Texts are read twice.

Windows are judged on the input, not on what is left. Hashes only bring words together: what is removed was compared.

Defined cases: null text has no words. A row without doc_id is neither source nor changed. Rows that share an id don't
remove each other's words; rows alike in id and text get the same result and are all returned. Fewer words than a
window: nothing is removed. kept_sha256 of no words is that of the empty string. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import text as tx
from ferrule.session import plan_bytes

SIZE, SEED = 13, 5
#: Input bytes for each bucket of anchors, the fewest and most buckets, and the most tasks that share them.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 4 << 20, 12, 1 << 24
MOST_TASKS = 1 << 17
LEVEL = 4  # of compression
_U = np.uint64


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(a: np.ndarray) -> bytes:
    return _squeeze(np.ascontiguousarray(a).tobytes())


def _planes(a: np.ndarray) -> bytes:
    """Small or slowly growing integers: differences, byte plane by byte plane."""
    d = np.diff(a.astype(np.int64), prepend=np.int64(0))
    return _pack(((d << 1) ^ (d >> 63)).view(np.uint8).reshape(-1, 8).T)


def _unplanes(data: bytes) -> np.ndarray:
    z = np.ascontiguousarray(np.frombuffer(_expand(data), np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)
    return np.cumsum((z >> 1) ^ -(z & 1))


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices of ranges start .. start + n, one after the other."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def anchors(raw: np.ndarray, off: np.ndarray, size: int = SIZE) -> dict[str, np.ndarray]:
    """Occurrences, each a run of windows with one anchor: row, first (window's word in its row), n, back (the anchor's
    place in the first window), anchor hash, around (a hash of the span and these), begin and length of the span in
    text, all words joined by a space."""
    start, end, bounds = tx.words(raw, off, tx.SPACE_WORDS)
    h = tx.word_hashes(raw, start, end)
    wide, m = size - SEED + 1, max(0, len(h) - size + 1)
    grams = tx.ngram_hashes(h, SEED)
    least, back = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, wide):
        less = grams[j : j + m] < least
        least[less], back[less] = grams[j : j + m][less], j
    row = tx.rows_of(bounds)[:m]
    at = np.flatnonzero(np.arange(m) + size <= bounds[row + 1])
    place, row = at + back[at], row[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    word, row = at[first], row[first]
    wide = end - start
    joined = np.concatenate([[0], np.cumsum(wide + 1)])
    text = np.full(joined[-1], 0x20, np.uint8)
    text[_ranges(joined[:-1], wide)] = raw[_ranges(start, wide)]
    last = word + n + size - 2
    out = {"row": row, "first": word - bounds[row], "n": n, "back": back[word], "anchor": least[word], "begin": joined[word], "text": text}
    out["length"] = joined[last] + wide[last] - joined[word]
    key = tx.mix(out["anchor"] + out["back"].astype(np.uint64)) + n.astype(np.uint64)
    if len(n):
        words = n + size - 1
        ends = np.cumsum(words)
        step = np.arange(ends[-1]) - np.repeat(ends - words, words)
        key += np.add.reduceat(h[_ranges(word, words)] * tx.mix(step.astype(np.uint64) + _U(1)), ends - words)
    out["around"] = tx.mix(key)
    return out


def _settle(runs: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences to send, occurrences whose whole span stands in a smaller document of this slice)."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = runs["around"]
    order = np.lexsort((ids, key))
    group = np.ones(len(order), bool)
    group[1:] = key[order][1:] != key[order][:-1]
    least = order[np.flatnonzero(group)][np.cumsum(group) - 1]
    at = np.flatnonzero(ids[order] > ids[least])
    later, least = order[at], least[at]
    data, begin, length = runs["text"].tobytes(), runs["begin"].tolist(), runs["length"].tolist()
    shape = (runs["n"] * 16 + runs["back"]).tolist()
    same = [shape[a] == shape[b] and data[begin[a] : begin[a] + length[a]] == data[begin[b] : begin[b] + length[b]] for a, b in zip(later.tolist(), least.tolist())]
    later = later[np.array(same, bool)] if len(later) else later
    sent = np.ones(len(order), bool)
    sent[later] = False
    return np.flatnonzero(sent), np.sort(later)


def _hits(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows (doc_id, tag, runs) of window ranges; runs: little-endian int32 pairs first, n."""
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["doc_id", "tag", "runs"])
    order = np.lexsort((first, tag, doc))
    doc, tag = doc[order], tag[order]
    pairs = np.stack([first[order], n[order]], axis=1).astype("<i4")
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    at = np.flatnonzero(new)
    offsets = np.append(at, len(doc)).astype(np.int32) * 8
    runs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at].astype(np.int64)), runs], ["doc_id", "tag", "runs"])


def _tags(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) for t in texts), np.int64, len(texts))


def _texts(raw: np.ndarray, off: np.ndarray) -> list[bytes]:
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _seeds(buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            raw_all, off_all = tx.utf8(batch.column(1))
            ids_all = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tx.slices(off_all, 2 * tx.SLICE):  # the longer, the smaller the packets together
                raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
                tags = _tags(_texts(raw, off))
                runs = anchors(raw, off, size)
                ids = ids_all[i:j][runs["row"]]
                sent, settled = _settle(runs, ids)
                hit = _hits(ids[settled], tags[runs["row"][settled]], runs["first"][settled], runs["n"][settled])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), -1, np.int32)), hit.column(0), hit.column(1), hit.column(2)], ["bucket", "doc_id", "tag", "data"])
                bucket = (runs["anchor"][sent] % _U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                sent, bucket = sent[order], bucket[order]
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for a, b in zip(cut, np.append(cut[1:], len(sent))):
                    own = sent[a:b]
                    docs, local = np.unique(runs["row"][own], return_inverse=True)
                    length = runs["length"][own]
                    parts = [_planes(ids_all[i:j][docs]), tags[docs].astype("<u4").tobytes(), _planes(local), _planes(runs["first"][own]), _pack((runs["n"][own] * 16 + runs["back"][own]).astype(np.uint16)), _planes(length), _pack(runs["text"][_ranges(runs["begin"][own], length)])]
                    rows.append(np.array([len(p) for p in parts], "<i4").tobytes() + b"".join(parts))
                none = pa.array([0] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), none, none, pa.array(rows, pa.binary())], ["bucket", "doc_id", "tag", "data"])

    return run


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """doc, tag, first, n, back, length and text of a packet."""
    sizes = np.frombuffer(data[:28], "<i4")
    cuts = np.cumsum(np.concatenate([[28], sizes]))
    ids, tags, local, first, shape, length, text = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
    local, shape = _unplanes(local), np.frombuffer(_expand(shape), np.uint16).astype(np.int64)
    return _unplanes(ids)[local], np.frombuffer(tags, "<u4").astype(np.int64)[local], _unplanes(first), shape // 16, shape % 16, _unplanes(length), np.frombuffer(_expand(text), np.uint8)


def _hashed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tx.words and tx.word_hashes of many texts, a slice at a time."""
    starts, ends, bounds, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], 0
    for i, j in tx.slices(off):
        own = raw[off[i] : off[j]]
        start, end, rows = tx.words(own, off[i : j + 1] - off[i], tx.SPACE_WORDS)
        hashes.append(tx.word_hashes(own, start, end))
        starts.append(start + off[i])
        ends.append(end + off[i])
        bounds.append(rows[1:] + at)
        at += len(start)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(bounds), np.concatenate(hashes)


def _reach(h: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words from places a and b on, in one direction, are equal, up to limit."""
    far, alive = np.zeros(len(a), np.int64), limit > 0
    while alive.any():
        at = np.flatnonzero(alive)
        same = h[a[at] + way * far[at]] == h[b[at] + way * far[at]]
        far[at[same]] += 1
        alive[at[~same]] = False
        alive &= far < limit
    return far


def _extend(table: pa.Table, size: int) -> pa.Table:
    """Of one bucket: the matches with smaller documents, as runs of windows by document."""
    doc, tag, first, n, back, length, raw = (np.concatenate(x) for x in zip(*(_unpack(d.as_py()) for d in table.column("data"))))
    start, end, bounds, h = _hashed(raw, np.concatenate([[0], np.cumsum(length)]))
    seed = bounds[:-1] + back
    _, group = np.unique(tx.ngram_hashes(h, SEED)[seed], return_inverse=True)
    low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    met = np.flatnonzero(low[group] < high[group])  # seeds found in two documents or more
    run, window = np.repeat(met, n[met]), _ranges(bounds[met], n[met])
    key = tx.ngram_hashes(h, size)[window]
    order = np.lexsort((doc[run], key))
    run, window, key = run[order], window[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    least = run[np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = np.flatnonzero(doc[run] > doc[least])
    # Each occurrence meets each of its windows' smallest documents once, and the match is extended from the seed.
    pairs, own = np.unique(run[hit] * len(doc) + least[hit], return_inverse=True)
    a, b = pairs // max(len(doc), 1), pairs % max(len(doc), 1)
    words = n + size - 1
    left = _reach(h, seed[a] - 1, seed[b] - 1, np.minimum(back[a], back[b]), -1)
    right = _reach(h, seed[a], seed[b], np.minimum((words - back)[a], (words - back)[b]), 1)
    sure = left + right >= size
    data = raw.tobytes()
    begin, over = seed[a] - left, seed[a] + right - 1
    for k in np.flatnonzero(sure).tolist():
        x, y, shift = begin[k], over[k], seed[b[k]] - seed[a[k]]
        sure[k] = data[start[x] : end[y]] == data[start[x + shift] : end[y + shift]]
    good = np.flatnonzero(sure)
    doc_of, tag_of = doc[a[good]], tag[a[good]]
    first_of, n_of = first[a[good]] + back[a[good]] - left[good], (left + right)[good] - size + 1
    if len(good) < len(pairs):  # different words with one hash: their windows are told apart by their bytes
        odd = np.flatnonzero(np.isin(key, key[hit[~sure[own]]]))
        smallest: dict[bytes, int] = {}
        cut = [data[start[w] : end[w + size - 1]] for w in window[odd].tolist()]
        for w, d in zip(cut, doc[run[odd]].tolist()):
            smallest[w] = min(smallest.get(w, d), d)
        more = odd[np.array([smallest[w] < d for w, d in zip(cut, doc[run[odd]].tolist())], bool)]
        doc_of, tag_of = np.append(doc_of, doc[run[more]]), np.append(tag_of, tag[run[more]])
        first_of, n_of = np.append(first_of, first[run[more]] + window[more] - bounds[run[more]]), np.append(n_of, np.ones(len(more), np.int64))
    return pa.Table.from_batches([_hits(doc_of, tag_of, first_of, n_of)])


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, tag and the compressed text. A row without doc_id has a key of its own and a tag that none has."""
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(1)]
        ids, tags = batch.column(0), _tags(texts)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        spread = tx.mix(tags.astype(np.uint64) + (np.arange(len(tags), dtype=np.uint64) << _U(32))).view(np.int64)
        keys = np.where(null, spread, ids.fill_null(0).to_numpy(zero_copy_only=False))
        packed = pa.array([_squeeze(t) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(np.where(null, -1, tags)), packed], ["doc_id", "key", "tag", "packed"])


def _cut(size: int, texts: bool):
    def kept(data: bytes, runs: list[bytes]) -> tuple:
        raw = np.frombuffer(data, np.uint8)
        start, end, _ = tx.words(raw, np.array([0, len(raw)]), tx.SPACE_WORDS)
        change = np.zeros(len(start) + 1, np.int32)
        for part in runs:
            pairs = np.frombuffer(part, "<i4").reshape(-1, 2)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 0] + pairs[:, 1] + size - 1, -1)
        left = np.flatnonzero(np.cumsum(change)[:-1] == 0)
        text = b" ".join([data[s:e] for s, e in zip(start[left].tolist(), end[left].tolist())])
        return len(start), len(start) - len(left), hashlib.sha256(text).hexdigest(), text.decode() if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            begin, size_, out = 0, 0, []
            for r in range(len(batch)):
                data = _expand(batch.column(1)[r].as_py())
                out.append(kept(data, batch.column(2)[r].as_py() or []))
                size_ += len(data)
                if size_ > tx.SLICE or r == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, r + 1 - begin), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
                    begin, size_, out = r + 1, 0, []

    return run


def dedup(documents: DataFrame, size: int = SIZE, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text that is left, words joined by a space; NULL without
    texts) of each row."""
    if not SEED <= size <= SEED + 15:
        raise ValueError(f"windows of {SEED} to {SEED + 15} words")
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size_known = plan_bytes(documents)
    if size_known >= 1 << 60:  # Spark's word for unknown
        size_known = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKET_BYTES
    buckets = min(max(LEAST_BUCKETS, -(-size_known // BUCKET_BYTES)), MOST_BUCKETS)
    seeds = docs.mapInArrow(_seeds(buckets, size), "bucket int, doc_id long, tag long, data binary")
    hits = "doc_id long, tag long, runs binary"
    # Slices' own results pass through the same exchange, spread by document.
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.col("doc_id"), F.lit(4 * buckets))).otherwise(F.col("bucket")).cast("int")

    def extend(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["doc_id", "tag", "data"]).rename_columns(["doc_id", "tag", "runs"])
        return _extend(table, size)

    found = seeds.withColumn("bucket", spread).repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(extend, hits)
    by_doc = found.groupBy(F.col("doc_id").alias("key"), "tag").agg(F.collect_list("runs").alias("runs"))
    packed = docs.mapInArrow(_shrunk, "doc_id long, key long, tag long, packed binary")
    joined = packed.join(by_doc, ["key", "tag"], "left")
    return joined.select("doc_id", "packed", "runs").mapInArrow(_cut(size, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
