"""Personal data by bootstrapped contextual extraction.

Base entities (email, ip, card, phone, by fixed patterns) are the seeds. Every seed and every identifier-like string
that no base pattern accepts is an instance, and stands in lexical patterns: the word before it, the two words before
it, the word after it, and the words on both sides, each with the instance's form (around an @, dotted, so many
digits). Spark scores the bipartite graph of patterns and instances by rounds: a pattern's confidence for a kind is the
smoothed mean score of its instances, an instance's score the noisy-or of its trusted patterns' confidence; seeds and
instances found before stay at 1. Patterns with a confidence of MIN_CONFIDENCE that stand on MIN_SEEDS different known
instances are trusted. Instances they find become known and lend weight to further patterns, until a round finds none.
All spans of the unknown instances in trusted patterns are added. Base spans always stay.

Scale: one pass over the text gives base spans and occurrences, staged without the text. Graph edges are pre-aggregated
to (pattern, instance), so a frequent pattern sends a row for each instance and task; scores are joined by key and no
group is ever collected. Each round finds one instance at least, and only few follow the first. Only discovered spans
meet the documents again. Words and instances are taken whole, however long.

Defined cases: null text is empty and has no spans. Rows alike in doc_id (null included) and text are judged alike and
all returned. Offsets are code points, ends exclusive. Other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.session import broadcast_if_small, stage

#: Fixed values of the contract, in its order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Numbers with their usual punctuation; those of LEAST_DIGITS digits and more are identifier-like, and so are words
#: around an @.
NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
LEAST_DIGITS = 7
HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
_WORD = re.compile(r"[^\W\d_]+")
MIN_CONFIDENCE, MIN_SEEDS = 0.9, 20
#: A pattern starts with this many unknown instances against it, so that rare ones can't be sure.
DOUBT = 1.0
MAX_BROADCAST_ROWS = 500_000


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans (kind, start, end), by start, then kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:  # the pattern's matches are those around an @: its local part runs back to the first other character
        m, start = DOMAIN.match(text, at + 1), at
        if m:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
        if m and start < at:
            found.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _form(instance: str) -> str:
    """What an instance looks like, roughly: words around an @, numbers with dots, or a number by its digits."""
    if "@" in instance:
        return "@"
    if instance.count(".") == 3:
        return "dots"
    digits = sum(c in "0123456789" for c in instance)
    return f"digits{next((n for n in (8, 11, 15, 16) if digits <= n), 'more')}"


def candidates(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Identifier-like strings of a stretch of text that holds no base span, by start."""
    free, at = begin, text.find("@", begin, end)
    while at >= 0:
        a = b = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        while b + 1 < end and text[b + 1] in HOST:
            b += 1
        if a < at < b:
            yield from _numbers(text, free, a)
            yield a, b + 1
            free = b + 1
        at = text.find("@", max(at, b) + 1, end)
    yield from _numbers(text, free, end)


def _numbers(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    for m in NUMBER.finditer(text, begin, end):
        if sum(c in "0123456789" for c in m[0]) >= LEAST_DIGITS:
            yield m.span()


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, list[str]]]:
    """(kind of a seed or None, start, end, instance, patterns)."""
    found: list[tuple[str | None, int, int]] = list(spans)
    free = 0
    for a, b in sorted((a, b) for _, a, b in spans):
        found.extend((None, *c) for c in candidates(text, free, a))
        free = max(free, b)
    found.extend((None, *c) for c in candidates(text, free, len(text)))
    if not found:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out = []
    for kind, a, b in found:
        form, before, after = _form(text[a:b]), bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        left = [text[x:y].lower() for x, y in words[max(0, before - 2) : before]]
        right = text[slice(*words[after])].lower() if after < len(words) else ""
        near = left[-1] if left else ""
        patterns = [f"{near}<{form}", f"{form}>{right}", f"{near}<{form}>{right}", f"{' '.join(left)}<<{form}"]
        out.append((kind, a, b, text[a:b], patterns))
    return out


_OCC = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans as text) and occurrences of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of, occ = [], []
            for t in batch.column(2):
                text = t.as_py() or ""
                spans = base(text)
                spans_of.append([f"{k}:{a}:{b}" for k, a, b in spans])
                occ.append([dict(zip(("kind", "start", "end", "instance", "patterns"), o)) for o in occurrences(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans_of, pa.list_(pa.string())), pa.array(occ, pa.list_(_OCC))], ["doc_id", "text_hash", "base", "occ"])

    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    schema = "doc_id long, text_hash long, base array<string>, occ array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>>"
    return docs.mapInArrow(run, schema)


def _confidence(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Patterns by kind: (pattern, kind, confidence, seeds). edges: (pattern, instance); known: (instance, kind)."""
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    sums = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    return sums.join(sizes, "pattern").select("pattern", "kind", (F.col("seeds") / (F.col("n") + DOUBT)).alias("confidence"), "seeds")


def patterns(scanned: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the trusted patterns, at the end of all rounds."""
    occ = scanned.select(F.explode("occ").alias("o")).select("o.*")
    known = stage(occ.where("kind is not null").select("instance", "kind").distinct(), "known")
    edges = stage(occ.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "graph")
    while True:
        trusted = stage(_confidence(edges, known).where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("seeds") >= MIN_SEEDS)), "patterns")
        # The noisy-or of patterns that are each sure enough is sure enough: the best kind of an instance wins.
        score = 1 - F.exp(F.sum(F.log(1.000001 - F.col("confidence"))))
        unknown = edges.join(trusted, "pattern").groupBy("instance", "kind").agg(score.alias("score")).join(known.select("instance"), "instance", "left_anti")
        gained = stage(unknown.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")).select("instance", "kind"), "gained")
        if gained.isEmpty():
            break
        known = stage(known.union(gained), "known")
    best = F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind"))
    return trusted.groupBy("pattern").agg(best.alias("b")).select("pattern", "b.kind", "b.confidence")


def discovered(scanned: DataFrame) -> DataFrame:
    """(doc_id, text_hash, found): the spans that patterns add, as an array of kind:start:end."""
    unknown = scanned.select("doc_id", "text_hash", F.explode("occ").alias("o")).where("o.kind is null")
    unknown = unknown.select("doc_id", "text_hash", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    best = F.max_by("kind", F.struct("confidence", "kind"))
    spans = unknown.join(patterns(scanned), "pattern").groupBy("doc_id", "text_hash", "start", "end").agg(best.alias("kind"))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.concat_ws(":", "kind", "start", "end")).alias("found"))


def _with(left: DataFrame, found: DataFrame) -> DataFrame:
    right = broadcast_if_small(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "found"), MAX_BROADCAST_ROWS)
    return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["text_hash"] == right["_h"]), "left").drop("_id", "_h")


def _ordered(spans: Column) -> Column:
    """Spans by start, then kind in the contract's order."""
    order = F.map_from_arrays(F.array(*(F.lit(k) for k in KINDS)), F.array(*(F.lit(i) for i in range(len(KINDS)))))
    keyed = F.transform(spans, lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"), F.element_at(order, F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def _starts(prefix: str) -> Callable[[Column], Column]:
    return lambda s: s.startswith(prefix)


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row. The counts are those of base spans."""
    scanned = stage(scan(documents), "scan")
    all_spans = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    counts = [F.size(F.filter("base", _starts(f"{k}:"))).cast("long").alias(f"n_{k}") for k in KINDS]
    out = _with(scanned.drop("occ"), discovered(scanned))
    return out.select("doc_id", *counts, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join(_ordered(all_spans), ",").alias("spans"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by the first one's kind: <EMAIL>."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """documents with personal data masked in text, and n_chars, where there is such a column, counted anew.

    Masked text is looked at again until no base pattern matches, since what is left and right of a mask may join up.
    """
    names = documents.columns
    found = discovered(stage(scan(documents), "scan"))
    joined = _with(documents.withColumn("text_hash", F.xxhash64("text")), found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, f in zip(batch.column("text"), batch.column("found")):
                text = t.as_py()
                if text is not None:
                    extra = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in f.as_py() or ())]
                    spans = base(text) + extra
                    while spans:
                        text = mask(text, spans)
                        spans = base(text)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    out = joined.select(*names, "found").mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out
