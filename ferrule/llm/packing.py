"""Best-fit packing of token sequences, bulk-synchronous.

Documents become pieces of at most `capacity` tokens. Pieces, and the gaps of open sequences, are range-sorted by size
into classes, each half as large as the one before. A round sweeps all classes at once: within its class a sweep gives
each piece, from long to short, the smallest gap that holds it (its successor among the gaps); pieces that want gaps of
one size are served by rank, and used gaps shrink at once. Between rounds gaps move: shrunk ones to their own class, those
that no piece of a class took to the next one with pieces. The class of the longest pieces left, and no other, may open
sequences, once no gap of a longer class is under way. Rounds repeat until no piece is left.

Pieces of one size, and gaps of one size with one history, differ in their rank only, so a sweep moves whole runs of
ranks, and the rounds' state is runs (size, first rank or sequence, count), some thousands whatever the input. Nothing
but counts by class reaches the driver. The placements are runs too; every piece then finds its own by size and rank.

Ranks come from counts by (size, salt) and row numbers within (size, salt), so a size that a third of all rows share
is spread over as many tasks as its count asks for; salts come from row numbers, so equal rows have different ones.
Tokenising is a narrow step whose result (a few numbers a piece) is staged once.

Defined cases: a null or empty text is one piece that holds the end id alone. Repeated rows and rows without doc_id
are packed like any others. No documents: no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import broadcast_if_small, stage

CAPACITY, END = 1024, 2
#: Pieces of one (size, salt) group, and the most runs of placements that may be broadcast.
GROUP, MAX_BROADCAST_RUNS = 1_000, 500_000
PIECE, GAP, PLACED, OPENED = range(4)  # kinds of rows in a round
_encoders: dict[tuple[str, bool], Callable[[str], list[int]]] = {}


def encoder(path: str, added: bool = False) -> Callable[[str], list[int]]:
    """Text to ids of a byte-level BPE; made once in each process.

    path: a tokenizers JSON file. If the same vocabulary lies beside it as a rank file (.tiktoken), ids are computed
    from that, seven times as fast; what it can't take (it refuses some huge texts) goes to tokenizers. added: added
    tokens such as <|endoftext|> that stand in a text get their own ids, as in tokenizers by default; else they are
    encoded like any other text. Texts that hold one go to tokenizers.
    """
    if (path, added) not in _encoders:
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        tokens = [t.content for t in whole.get_added_tokens_decoder().values()] if added else []
        if not added:
            whole.encode_special_tokens = True
        slow = lambda t: whole.encode(t, add_special_tokens=False).ids
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

            def encode(t: str) -> list[int]:
                if any(x in t for x in tokens):
                    return slow(t)
                try:
                    return quick(t)
                except BaseException as e:
                    if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                        raise
                    return slow(t)

            _encoders[path, added] = encode
        else:
            _encoders[path, added] = slow
    return _encoders[path, added]


def cut(ids: Sequence[int], capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only a longer one is cut, and its first piece is the short one."""
    first = len(ids) % capacity or min(capacity, len(ids))
    return [(0, first), *((at, capacity) for at in range(first, len(ids), capacity))]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces; the ids themselves are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for n, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                rows.extend((n, k, at, size, zlib.crc32(ids[at : at + size].tobytes())) for k, (at, size) in enumerate(cut(ids, capacity)))
            at, *cols = zip(*rows) if rows else ((), (), (), (), ())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def class_of(size: int, capacity: int) -> int:
    """0 for sizes above half the capacity, 1 for those above a quarter, and so on."""
    return (capacity // size).bit_length() - 1


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], opens: bool, base: int, capacity: int) -> tuple[list, list, list, int]:
    """One class's best-fit: (pieces left, gaps left, placements, sequences opened).

    pieces: runs (size, first rank, count). gaps: runs (size, first sequence, count). base: the first number for new
    sequences. Placements: (size, first rank, count, first sequence, sequences, offset); of so many ranks each run
    through the sequences takes the next place in them.
    """
    room: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    sizes: list[int] = []  # the sizes with gaps, sorted
    left, placed, opened = [], [], 0

    def put(size: int, first: int, count: int) -> None:
        if size and not room[size]:
            bisect.insort(sizes, size)
        if size:
            room[size].append((first, count))

    for gap in sorted(gaps):
        put(*gap)
    for size, rank, n in sorted(pieces, reverse=True):
        while n:
            at = bisect.bisect_left(sizes, size)
            if at == len(sizes):
                if not opens:
                    left.append((size, rank, n))
                    break
                new = -(-n // (capacity // size))
                put(capacity, base + opened, new)
                opened += new
                continue
            gap = sizes[at]
            first, count = room[gap].popleft()
            # As many pieces as fit into each gap of the run; the last gap takes what there is.
            per = gap // size
            width, per = (min(count, n // per), per) if n >= per else (1, n)
            if width < count:
                room[gap].appendleft((first + width, count - width))
            elif not room[gap]:
                sizes.pop(at)
            placed.append((size, rank, width * per, first, width, capacity - gap))
            put(gap - per * size, first, width)
            rank, n = rank + width * per, n - width * per
    return left, [(g, first, count) for g in sizes for first, count in room[g]], placed, opened


_STATE = "cls int, kind int, size long, first long, n long, sequence long, width long, offset long"


def _round(wanted: list[int], top: int, opens: bool, base: int, capacity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A round's work on one class. wanted: the classes with pieces; top: the one with the longest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py()
        runs = [tuple(r[c] for c in ("size", "first", "n")) for r in table.to_pylist() if r["kind"] == PIECE]
        gaps = [tuple(r[c] for c in ("size", "first", "n")) for r in table.to_pylist() if r["kind"] == GAP]
        left, free, placed, opened = sweep(runs, gaps, opens and own == top, base, capacity)
        out = [(own, PIECE, *r, 0, 0, 0) for r in left] + [(own, PLACED, *r) for r in placed] + [(own, OPENED, 0, 0, opened, 0, 0, 0)]
        for size, first, n in free:
            least = max(class_of(size, capacity), own + 1)
            to = next((c for c in wanted if c >= least), None)
            if to is not None:  # else no piece is short enough for it
                out.append((to, GAP, size, first, n, 0, 0, 0))
        names = [c.split()[0] for c in _STATE.split(", ")]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def placements(histogram: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(length, at, n, sequence, width, offset): where ranks at .. at + n of a size go. histogram: (length, n)."""
    cls = (F.length(F.bin(F.floor(F.lit(capacity) / F.col("length")))) - 1).cast("int")
    zero = F.lit(0).cast("long")
    state = histogram.select(cls.alias("cls"), F.lit(PIECE).alias("kind"), F.col("length").cast("long").alias("size"), zero.alias("first"), "n", zero.alias("sequence"), zero.alias("width"), zero.alias("offset"))
    rounds, opened = [], 0
    state = stage(state, "packing")
    while True:
        totals = {(r["kind"], r["cls"]): r["n"] for r in state.groupBy("kind", "cls").agg(F.sum("n").alias("n")).collect()}  # a few rows a class
        opened += sum(n for (kind, _), n in totals.items() if kind == OPENED)
        wanted = sorted(c for kind, c in totals if kind == PIECE)
        if not wanted:
            break
        opens = all(c >= wanted[0] for kind, c in totals if kind == GAP)
        state = stage(state.where(F.col("kind").isin(PIECE, GAP)).groupBy("cls").applyInArrow(_round(wanted, wanted[0], opens, opened, capacity), _STATE), "packing")
        rounds.append(state.where(F.col("kind") == PLACED))
    out = rounds[0] if rounds else state.limit(0)
    for r in rounds[1:]:
        out = out.union(r)
    return out.select(F.col("size").alias("length"), F.col("first").alias("at"), "n", "sequence", "width", "offset")


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    names = found.columns
    found = stage(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = stage(found.groupBy("length").agg(F.count("*").alias("n")), "histogram")  # capacity rows at most
    # Salts by size: groups of about GROUP pieces.
    salts = histogram.select("length", F.ceil(F.col("n") / GROUP).alias("salts"))
    salted = found.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("_row"), F.col("salts")))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "salt", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("_row")) - 1
    ranked = salted.withColumn("own", own).join(bases, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("base"))
    plan = broadcast_if_small(placements(histogram, capacity), MAX_BROADCAST_RUNS)
    within = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["at"]) & (ranked["rank"] < plan["at"] + plan["n"])
    placed = ranked.join(plan, within).withColumn("_k", ranked["rank"] - plan["at"])
    sequence, offset = plan["sequence"] + F.col("_k") % plan["width"], plan["offset"] + F.floor(F.col("_k") / plan["width"]) * ranked["length"]
    return placed.select(*(ranked[c] for c in names), sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of documents (doc_id, text)."""
    return place(pieces(documents, path, capacity, end, added), capacity)
