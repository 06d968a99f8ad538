"""Substring deduplication, SimHash, decontamination and packing against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from ferrule.llm import components, decontaminate, packing, sharding, simhash, substring
from ferrule.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, frame, long_text

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def copies(seed=1, n=40):
    """Documents that share passages, with exact and near copies and many of one kind."""
    r = random.Random(seed)
    passages = [long_text(r.randint(10, 40), seed * 100 + k) for k in range(6)]
    rows = []
    for d in range(n):
        parts = [long_text(r.randint(0, 30), 1000 + d)]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        rows.append((d * 3, "\n".join(parts)))
    return rows + [(200 + k, passages[0] + f" tail{k % 3}") for k in range(30)] + AWKWARD


def substring_reference(rows, size):
    least = {}
    for d, t in rows:
        if d is not None:
            w = SPACES.findall(t or "")
            for i in range(len(w) - size + 1):
                g = tuple(w[i : i + size])
                least[g] = min(least.get(g, d), d)
    out = []
    for d, t in rows:
        w = SPACES.findall(t or "")
        gone = set()
        if d is not None:
            for i in range(len(w) - size + 1):
                if least[tuple(w[i : i + size])] < d:
                    gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [6, 13])
def test_substring(spark, size):
    rows = copies()
    got = substring.dedup(frame(spark, rows), size).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == substring_reference(rows, size)


def test_substring_with_weak_hashes(monkeypatch):
    """Words decide: with hashes of 4 bits the matches are the same."""
    import pyarrow as pa

    r = random.Random(8)
    passages = [long_text(r.randint(13, 30), k).encode() for k in range(4)]
    texts = [b" ".join(r.sample([*passages, long_text(12, 50 + d).encode()], 3)) for d in range(12)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    least, want = {}, set()
    words = [t.split() for t in texts]
    grams = [(d, i, tuple(w[i : i + 13])) for d, w in enumerate(words) for i in range(len(w) - 12)]
    for d, _, g in grams:
        least.setdefault(g, d)
    want = {(d, i) for d, i, g in grams if least[g] < d}
    strong = substring.tx.ngram_hashes
    runs = substring.anchors(raw, off)
    rows = pa.table({"data": [_packet(runs)]})
    monkeypatch.setattr(substring.tx, "ngram_hashes", lambda h, n: strong(h, n) & np.uint64(15) if n == 13 else strong(h, n))
    out = substring._extend(rows, 13)
    got = set()
    for d, data in zip(out["doc_id"].to_pylist(), out["runs"].to_pylist()):
        for a, n in np.frombuffer(data, "<i4").reshape(-1, 2).tolist():
            got.update((d, a + k) for k in range(n))
    assert got == want and want


def _packet(runs):
    own, docs = np.arange(len(runs["row"])), np.unique(runs["row"])
    length = runs["length"]
    parts = [substring._planes(docs), docs.astype("<u4").tobytes(), substring._planes(np.searchsorted(docs, runs["row"])), substring._planes(runs["first"]), substring._pack((runs["n"] * 16 + runs["back"]).astype(np.uint16)), substring._planes(length), substring._pack(runs["text"][substring._ranges(runs["begin"][own], length)])]
    return np.array([len(p) for p in parts], "<i4").tobytes() + b"".join(parts)


def test_substring_one_anchor_in_many_contexts(spark):
    """A phrase of six words that everyone uses, with other words around it, and one real repeat among them."""
    rows = [(k, long_text(10, 3000 + k) + " as a matter of fact indeed " + long_text(10, 5000 + k)) for k in range(400)]
    rows += [(1000, rows[7][1]), (None, rows[8][1]), (1001, "x " + rows[9][1][:-9])] + [(None, None)] * 50
    got = substring.dedup(frame(spark, rows)).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == substring_reference(rows, 13)


def test_substring_empty(spark):
    assert substring.dedup(frame(spark, [])).count() == 0


def fingerprint(t):
    w = SPACES.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_reference(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def near_copies():
    base = long_text(400, 5).split()
    rows = []
    for k in range(40):
        w = list(base)
        w[k * 7 % len(w)] = f"edit{k}"
        rows.append((500 + k, " ".join(w)))
    return rows + AWKWARD + [(900 + k, long_text(50, 70 + k)) for k in range(20)]


def test_simhash(spark):
    rows = near_copies()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == simhash_reference(rows)


def test_simhash_links_are_complete():
    """Random balls of fingerprints: both ways of working on a list find exactly the pairs within 3 bits."""
    r = np.random.default_rng(3)
    fps = np.unique(np.uint64(r.integers(0, 2**63)) ^ r.integers(0, 2**9, 300).astype(np.uint64))
    want = {(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    for limit in (10**6, 5):
        old, simhash.LONG = simhash.LONG, limit
        try:
            got = {(int(max(x, y)), int(min(x, y))) for a, b in simhash._links(fps) for x, y in zip(a, b) if x != y}
        finally:
            simhash.LONG = old
        assert got == want


def test_keep_one_keeps_first_of_each_group(spark):
    rows = near_copies()
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert kept == {c for d, _, c in simhash_reference(rows) if d is not None} | {None}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def contamination_reference(rows, items, size=13):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    out = []
    for d, t in rows:
        w, hit, ids = ALNUM.findall(lower(t)), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark):
    passage = long_text(30, 9)
    items = [(10, passage), (2, passage.upper()), (2, "only three words"), (3, None), (4, "?!"), (None, long_text(14, 11)), (5, "word")]
    rows = AWKWARD + [(20, long_text(20, 3) + " " + passage + "! x"), (21, "Only, three-words. only three words"), (22, passage + " " + long_text(2000, 4)), (23, "Word " + long_text(14, 11)), (24, passage), (24, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(frame(spark, rows), bench).drop("text_hash").collect()
    want = contamination_reference(rows, items)
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = decontaminate.clean(frame(spark, rows), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in want if not r[-1]), key=str)
    empty = decontaminate.judge(frame(spark, rows), bench.limit(0)).collect()
    assert len(empty) == len(rows) and not any(r.contaminated for r in empty)
    assert decontaminate.judge(frame(spark, []), bench).count() == 0


def test_decontamination_by_shuffle_is_the_same(spark, monkeypatch):
    """Without broadcasts, with a document of 20,000 words and windows of very frequent words."""
    common = "of the and to in a of the and to in a of the"
    rows = [(1, long_text(40, 1)), (2, long_text(40, 2)), (3, long_text(20000, 5) + " " + common), (3, "x " * 3000 + common + " of the"), (4, " ".join([common] * 400)), (None, long_text(40, 1))]
    items = [(1, long_text(40, 1)), (2, common + " and"), (3, "two words"), (4, common)]
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontaminate.judge(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("text_hash").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((tuple(r) for r in got), key=str) == contamination_reference(rows, items)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    rows = AWKWARD + [(30, "<|endoftext|> x"), (31, long_text(900, 8)), (32, "a" * 5000), (33, "  \n" * 400)]
    got = packing.pack(frame(spark, rows), TOKENIZER).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = packing.cut(ids, 1024)
        assert sum(n for _, n in cuts) == len(ids) and all(n == 1024 for _, n in cuts[1:])
        want.update((d, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(cuts))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= best_fit([r.length for r in got])
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


def test_packing_query_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "a < |endoftext|> b"), (4, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = set()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.add((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert want >= {(1, 5, zlib.crc32(np.array([64, 220, 50256, 275, 2], "<u4").tobytes()))}
    for got in (QUERIES["op3_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, frame(spark, rows), "")):
        assert {(r.doc_id, r.length, r.ids_crc32) for r in got.collect()} == want


def best_fit(sizes, capacity=1024):
    gaps = []
    for n in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_one_sweep_is_best_fit_decreasing():
    for seed in range(5):
        r = random.Random(seed)
        sizes = [r.randint(1, r.choice([50, 300, 1024])) for _ in range(700)]
        left, gaps, placed, opened = packing.sweep([(n, 0, k) for n, k in collections.Counter(sizes).items()], [], True, 5, 1024)
        assert not left and opened == best_fit(sizes)
        assert sum(g * k for g, _, k in gaps) + sum(sizes) == 1024 * opened


@pytest.mark.parametrize("kind", ["uniform", "short", "ones", "middle", "few"])
def test_rounds_need_no_more_sequences_than_best_fit(spark, kind):
    r = random.Random(kind)
    draw = {"uniform": lambda: r.randint(1, 1024), "short": lambda: r.randint(1, 50), "ones": lambda: 1 if r.random() < 0.4 else r.randint(1, 1024), "middle": lambda: r.randint(200, 500), "few": lambda: r.randint(1, 500)}[kind]
    sizes = [draw() for _ in range(60 if kind == "few" else 3000)]
    found = spark.createDataFrame([(k, 0, 0, n, 7) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    by = collections.defaultdict(list)
    for row in packing.place(found).collect():
        by[row.sequence_id].append((row.offset, row.length))
    assert sorted(n for parts in by.values() for _, n in parts) == sorted(sizes)
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= best_fit(sizes) * 1.002 + 1


def test_ranks_with_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    found = spark.createDataFrame([(i % 5, 0, 0, 100 + i % 3, 7) for i in range(200)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert found.count() == 200
    rows = packing.place(found).collect()
    assert len(rows) == 200 and len({(r.sequence_id, r.offset) for r in rows}) == 200


def test_sharding(spark):
    table = sharding.lookup_table(spark, ["a", "b", "c"], 101)
    got = {r.slot: r.shard for r in table.collect()}
    h60 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    walks = {s: [(h60(f"{s}#offset") + k * (h60(f"{s}#skip") % 100 + 1)) % 101 for k in range(101)] for s in "abc"}
    want = {}
    while len(want) < 101:
        for s in "abc":
            if len(want) < 101:
                want[next(x for x in walks[s] if x not in want)] = s
    assert got == want
    placed = sharding.shard(frame(spark, AWKWARD), "doc_id", table, 101).collect()
    assert len(placed) == len(AWKWARD)
    for r in placed:
        assert r.shard == want[h60("" if r.doc_id is None else str(r.doc_id)) % 101] and r.slot == h60("" if r.doc_id is None else str(r.doc_id)) % 101
    assert sharding.shard(frame(spark, []), "doc_id", table, 101).count() == 0


def test_sharding_weights_and_moves(spark):
    two = collections.Counter(r.shard for r in sharding.lookup_table(spark, ["a", "b"], 101, [3, 1]).collect())
    assert abs(two["a"] - 76) <= 3
    before = {r.slot: r.shard for r in sharding.lookup_table(spark, ["a", "b", "c", "d"], 211).collect()}
    after = {r.slot: r.shard for r in sharding.lookup_table(spark, ["a", "b", "c"], 211).collect()}
    assert sum(before[s] != after[s] for s in before if before[s] != "d") < 40
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, ["a"], 100)


def test_write_shards(spark, tmp_path):
    table = sharding.lookup_table(spark, ["a", "b"], 11)
    sharding.write_shards(sharding.shard(frame(spark, AWKWARD), "doc_id", table, 11), f"file://{tmp_path}/out", 2)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(AWKWARD)
