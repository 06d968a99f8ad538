"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions only.

A window is `size` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Windows
and documents are sets of shingles of SHINGLE words (a shorter window is one shingle). A document contains a window
exactly when it holds its words in order, so all of its shingles: the filter of set joins then needs one prefix token,
and the shingles are ordered by how rare they are over all documents. Documents meet windows at occurrences of their
rarest shingle only. Its place in the window fixes where the window would start (positional bound) and whether it fits
(length bound). What is left is verified word by word over slices as long as the window.

Scale: one plan at all sizes. The text is read to count the benchmark's shingles, to join their hashes with (id, text
hash, place), and, for the documents that met a window, to verify; no word row carries its document. The benchmark's
sides and the keys of the documents to verify are broadcast if their measured rows and bytes allow it, else Spark joins
by shuffle; the texts to verify are shuffled to their windows.
Word counts and hits are pre-aggregated where they arise; a shingle that a third of the documents hold is no prefix
unless all shingles of its window are as frequent.

Defined cases: null text has no words (n_words 0, not contaminated). Rows alike in doc_id (null included) and text
are judged alike and all returned. An item without id counts as ''; items sharing an id are one item. A null item
has no windows. An empty benchmark hits nothing. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.session import broadcast_if_small, stage

#: Fixed values of the contract: window length, separators, and a document is contaminated from 1 word in 20.
SIZE = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARE = 20
#: Words of a shingle.
SHINGLE = 3
#: Rows of the benchmark's tables, and of (doc_id, text hash), that may be broadcast.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_ROWS = 200_000, 1_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def shingles(w: str, lengths: list[int]) -> Column:
    """All shingles of the word column w with so many words: an array of (pos, w1, w2, w3), unused words null."""
    n, none = F.size(w), F.lit(None).cast("string")
    parts = []
    for k in lengths:
        rest = [F.slice(w, i + 1, F.greatest(n - i, F.lit(0))) if i < k else F.array_repeat(none, n) for i in range(SHINGLE)]
        zipped = F.arrays_zip(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), *rest)
        named = zipped.cast("array<struct<pos:int,w1:string,w2:string,w3:string>>")
        parts.append(F.slice(named, 1, F.greatest(n - k + 1, F.lit(0))))
    return F.concat(*parts)


def _token(s: str) -> Column:
    return F.xxhash64(f"{s}.w1", f"{s}.w2", f"{s}.w3")


def windows(items: DataFrame, documents: DataFrame, size: int = SIZE) -> tuple[DataFrame, list[int]]:
    """The benchmark's distinct windows that can occur: (token, at, win, items), with the rarest shingle's hash and its
    place in win; and the lengths of shingles that are in use.

    items: item_id, text. documents: text; all of it is counted.
    """
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    win = own.where(n > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    win = stage(win.groupBy("win").agg(F.collect_set("item_id").alias("items")), "windows")
    lengths = sorted(r[0] for r in win.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect())  # SHINGLE rows at most
    parts = [win.where(F.least(F.size("win"), F.lit(SHINGLE)) == k).select("win", "items", F.explode(shingles("win", [k])).alias("s")) for k in lengths]
    cells = parts[0] if parts else win.select("win", "items", F.explode(shingles("win", [SHINGLE])).alias("s"))
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = cells.select("win", "items", F.col("s.pos").alias("at"), _token("s").alias("token"))
    vocabulary = broadcast_if_small(cells.select("token").distinct(), MAX_BROADCAST_WINDOWS * SIZE)
    said = documents.select(words(F.col("text")).alias("w")).select(F.explode(shingles("w", lengths or [SHINGLE])).alias("s")).select(_token("s").alias("token"))
    counts = said.join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # Rarest shingle first; ties by hash, then by place. A window with a shingle that no document has is out.
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at"))
    picked = cells.join(counts, "token", "left").groupBy("win").agg(rarest.alias("r"), F.first("items").alias("items"))
    return picked.where("r.n > 0").select("r.token", "r.at", "win", "items"), lengths or [SHINGLE]


def candidates(documents: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, copies, met): a row for each document, with the windows (s, win, items) that its
    rarest shingles, the positional and the length bound allow."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    # The null shingle at the end stands for the document itself.
    none = F.lit(None).cast("struct<pos:int,w1:string,w2:string,w3:string>")
    placed = docs.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.explode(F.array_append(shingles("w", lengths), none)).alias("s"))
    own = F.col("s").isNull()
    placed = placed.select("doc_id", "text_hash", "n_words", own.alias("own"), F.col("s.pos").alias("pos"), F.when(~own, _token("s")).alias("token"))
    start = F.col("pos") - F.col("at")
    fits = (placed["token"] == table["token"]) & (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    found = placed.join(table, fits, "left").where(F.col("own") | F.col("win").isNotNull())
    return found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(F.col("own"), 1)).cast("int").alias("copies"),
        F.collect_set(F.when(F.col("win").isNotNull(), F.struct(start.alias("s"), "win", "items"))).alias("met"),
    )


def judge(documents: DataFrame, items: DataFrame, size: int = SIZE, share: int = SHARE) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    documents: doc_id, text. n_hit: words inside any occurrence of a window; n_items: items with such windows.
    """
    table, lengths = windows(items, documents, size)
    found = stage(candidates(documents, broadcast_if_small(table, MAX_BROADCAST_WINDOWS), lengths), "met")
    met = found.where(F.size("met") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "met")
    # Only keys are broadcast: windows grow with the documents that met some. The texts of these documents, and of no
    # other, are shuffled to their windows.
    keys = broadcast_if_small(met.select("_id", "_h"), MAX_BROADCAST_ROWS)
    own = documents.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"), F.xxhash64("text").alias("_x"))
    own = own.join(keys, own["_d"].eqNullSafe(keys["_id"]) & (own["_x"] == keys["_h"]), "left_semi")
    texts = own.join(met.hint("merge"), own["_d"].eqNullSafe(met["_id"]) & (own["_x"] == met["_h"]))
    # In a lambda's own variable, so that a text is cut into words once and not for each of its windows.
    both = F.array(F.struct(words(F.col("_t")).alias("w"), F.col("met").alias("met")))
    exact = F.transform(both, lambda x: F.filter(x["met"], lambda m: F.slice(x["w"], m["s"] + 1, F.size(m["win"])) == m["win"]))[0]
    hits = F.array_sort(F.transform("hits", lambda m: F.struct(m["s"].alias("s"), (m["s"] + F.size(m["win"])).alias("e"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    grown = F.aggregate(
        hits,
        zero,
        lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], h["e"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda m: m["items"]))))
    sure = texts.select("_id", "_h", exact.alias("hits")).select("_id", "_h", grown.alias("n_hit"), ids.alias("ids"))
    sure = broadcast_if_small(sure.groupBy("_id", "_h").agg(F.max("n_hit").alias("n_hit"), F.max("ids").alias("ids")), MAX_BROADCAST_ROWS)
    out = found.drop("met").join(sure, found["doc_id"].eqNullSafe(sure["_id"]) & found["text_hash"].eqNullSafe(sure["_h"]), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copies"),
    ).drop("copies")


def clean(documents: DataFrame, items: DataFrame, **kw: int) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    bad = judge(documents, items, **kw).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    bad = broadcast_if_small(bad, MAX_BROADCAST_ROWS)
    same = documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_h"])
    return documents.join(bad, same, "left_anti")
