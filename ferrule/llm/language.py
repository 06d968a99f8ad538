"""Language identification by fusing evidence with Bayes' rule.

Evidence: the text's likelihood (hashed byte trigrams, multinomial), the declared language (of the markup, or of a
column), the suffix of the address, and a prior of the host that is smoothed towards its domain's, that towards its
suffix's and that towards the whole corpus's. All counts behind priors and declarations are grouped aggregations over
all rows; only the trigram table is fitted on a bounded sample (MAX_SAMPLE rows, chosen by hash of the row).

Scale: the text is read once for likelihoods; what follows is a table of numbers, staged. Hosts and suffixes are joined by key,
those in a table no larger than MAX_BROADCAST_HOSTS by broadcast, so a value with a third of all rows is no hot task; a
larger one is joined by shuffle, where Spark splits the skewed side (which has no text).

Unknown languages: one more class, "und", whose trigrams are FAR nats less likely than those of the median row whose
text and declaration agree (over all rows). It has the prior UNKNOWN and tells nothing of declaration and suffix.

Defined cases: a null or empty text, or one without letters, has no likelihood evidence: the rest decides. A row
without any letter in its text is rejected ("und"). Null host, address or declaration: no such evidence. Rows alike in
key (null included) and text are judged alike and all returned. No rows, or no row with a known declaration: all "und".
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm import text as tx
from ferrule.session import broadcast_if_small, stage

LANGUAGES = ("de", "en", "es", "fr")
TABLE = 1 << 15
#: The largest sample for the trigram table, and the rows of the host table that may be broadcast.
MAX_SAMPLE, MAX_BROADCAST_HOSTS = 4_000, 500_000
#: Pseudo-counts: of a trigram, of a parent in the host hierarchy, of a declaration; the share of a text's trigrams
#: that count as independent; and the posterior from which a row is kept.
SMOOTH, PARENT, DECLARE, INDEPENDENT, KEEP = 0.5, 10.0, 5.0, 0.25, 0.5
#: How much less likely a trigram of an unknown language is than one of the median row, in nats (a factor of 55), and the
#: prior of an unknown language.
FAR, UNKNOWN = 4.0, 0.001


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all trigrams within words, row bounds). A word counts with a space on both sides; A-Z as a-z."""
    letter = tx.ALNUM_WORDS.copy()
    letter[0x30:0x3A] = False  # digits tell no language
    low = tx.LOWER[raw]
    start, end, bounds = tx.words(low, off, letter)
    n = end - start
    width = n + 2
    at = np.concatenate([[0], np.cumsum(width)])
    spaced = np.full(at[-1] + 2, 0x20, np.uint32)
    spaced[np.arange(n.sum()) + np.repeat(at[:-1] + 1 - (np.cumsum(n) - n), n)] = low[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)]
    code = spaced[:-2] << np.uint32(16) | spaced[1:-1] << np.uint32(8) | spaced[2:]
    bucket = (code * np.uint32(2654435761) >> np.uint32(32 - 15)).astype(np.int64)
    inside = np.arange(n.sum()) + np.repeat(at[:-1] - (np.cumsum(n) - n), n)  # a trigram for each letter
    return bucket[inside], np.concatenate([[0], np.cumsum(n)])[bounds]


def fit(sample: DataFrame) -> np.ndarray:
    """log P(trigram | language), (languages, TABLE), from rows (text, declared). Counts are summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(LANGUAGES) * TABLE, np.int64)
        for batch in batches:
            raw, off = tx.utf8(batch.column(0))
            lang = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tx.slices(off):
                buckets, bounds = trigrams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                counts += np.bincount(np.repeat(lang[i:j] * TABLE, np.diff(bounds)) + buckets, minlength=len(counts))
        counts = counts.reshape(len(LANGUAGES), TABLE)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], ["lang", "bucket", "n"])

    place = F.array_position(F.array(*(F.lit(x) for x in LANGUAGES)), F.col("declared")).cast("int") - 1
    rows = sample.select("text", place.alias("lang")).mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(LANGUAGES), TABLE), SMOOTH)
    counts[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def likelihoods(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows with ll (an array of log-likelihoods by language, less their largest), near (the largest, for a letter) and
    letters, without text."""
    names = [c for c in rows.columns if c != "text"]
    sent = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32).T.copy())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = sent.value
        for batch in batches:
            raw, off = tx.utf8(batch.column("text"))
            out, near, sizes = [], [], []
            for i, j in tx.slices(off):
                buckets, bounds = trigrams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                sums = np.zeros((len(buckets) + 1, len(LANGUAGES)))
                np.cumsum(by_bucket[buckets], axis=0, out=sums[1:])
                ll = (sums[bounds[1:]] - sums[bounds[:-1]]) * INDEPENDENT
                out.append(ll - ll.max(axis=1, keepdims=True))
                sizes.append(np.diff(bounds))
                near.append(ll.max(axis=1) / INDEPENDENT / np.maximum(sizes[-1], 1))
            ll = np.concatenate(out) if out else np.zeros((0, len(LANGUAGES)))
            cells = pa.FixedSizeListArray.from_arrays(pa.array(ll.reshape(-1)), len(LANGUAGES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), cells, pa.array(np.concatenate(near) if near else np.zeros(0)), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))], [*names, "ll", "near", "letters"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(run, f"{schema}, ll array<double>, near double, letters long")


def _best(score: Column) -> Column:
    """The place of the largest value, from 0; the first of equals."""
    return F.array_position(score, F.array_max(score)).cast("int") - 1


def _logs(counts: list[Column], parent: list[Column], weight: float) -> list[Column]:
    total = sum(counts, F.lit(0.0)) + weight
    return [(c + weight * p) / total for c, p in zip(counts, parent)]


def _prior(votes: DataFrame, level: str, parent: DataFrame | None, up: str | None) -> DataFrame:
    """(level, prior) for each value of a level, smoothed towards its parent's prior."""
    n = len(LANGUAGES)
    counts = votes.groupBy(*([level] if up is None else [level, up])).agg(*(F.sum((F.col("vote") == k).cast("double")).alias(f"c{k}") for k in range(n)))
    if parent is None:
        mean = [F.lit(1.0 / n)] * n
        return counts.select(level, F.array(*_logs([F.col(f"c{k}") for k in range(n)], mean, PARENT)).alias("prior"))
    joined = counts.join(parent.withColumnRenamed("prior", "above"), up)
    return joined.select(level, F.array(*_logs([F.col(f"c{k}") for k in range(n)], [F.col("above")[k] for k in range(n)], PARENT)).alias("prior"))


def host_priors(votes: DataFrame) -> DataFrame:
    """(host, prior) from rows (host, vote): whole corpus, suffix, domain (last two labels), host."""
    labels = F.split("host", r"\.")
    levels = votes.where("host is not null").select(
        "vote", F.lit(0).alias("all"), F.element_at(labels, -1).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), "host"
    )
    whole = _prior(levels, "all", None, None)
    suffix = _prior(levels, "suffix", whole, "all")
    domain = _prior(levels, "domain", suffix, "suffix")
    return _prior(levels, "host", domain, "domain")


def identify(rows: DataFrame) -> DataFrame:
    """rows (key..., text, declared, host, address_suffix) judged: key..., lang, posterior, text_lang, declared, kept.

    lang: the likeliest of LANGUAGES, "und" if an unknown language is likelier or the text has no letter. text_lang: by
    the text alone, null where lang would be "und". kept: lang is not "und" and its posterior is KEEP or more.
    """
    n = len(LANGUAGES)
    names = F.array(*(F.lit(x) for x in LANGUAGES))
    known = rows.where(F.col("declared").isin(*LANGUAGES) & F.col("text").isNotNull())
    keys = [c for c in rows.columns if c not in ("text", "declared", "host", "address_suffix")]
    order = F.xxhash64(*keys, F.col("text"))
    count = known.count()
    # About MAX_SAMPLE rows pass the hash, so that the sort that makes the bound exact is a small one.
    passing = known.where(F.pmod(order, F.lit(1_000_000)) < max(1, 1_100_000 * MAX_SAMPLE // max(count, 1)))
    sample = passing.withColumn("_o", order).orderBy("_o").limit(MAX_SAMPLE).select("text", "declared")
    scored = stage(likelihoods(rows, fit(sample)), "likelihoods")
    place = F.when(F.col("declared").isin(*LANGUAGES), F.array_position(names, F.col("declared")).cast("int") - 1)
    scored = scored.withColumn("said", place).withColumn("own", F.when(F.col("letters") > 0, _best(F.col("ll"))))
    median = scored.where("said = own").agg(F.percentile_approx("near", 0.5)).first()[0]
    # The text's log-likelihood in an unknown language, less its largest in a known one.
    strange = F.lit(float("-inf")) if median is None else (F.lit(median - FAR) - F.col("near")) * F.col("letters") * INDEPENDENT + float(np.log(UNKNOWN))
    scored = scored.withColumn("strange", strange).withColumn("own", F.when(F.col("strange") <= 0, F.col("own")))
    # How far declarations can be trusted: P(declared | language told by the text), over all rows; at the end P(declared),
    # for an unknown language.
    cells = {(r[0], r[1]): r[2] for r in scored.where("said is not null and own is not null").groupBy("said", "own").agg(F.count("*")).collect()}
    values = {v for v, _ in cells}
    total = [sum(c for (_, own), c in cells.items() if own == k) for k in range(n)]
    trust = {v: [float(np.log((cells.get((v, k), 0) + DECLARE / len(values)) / (total[k] + DECLARE))) for k in range(n)] for v in values}
    for v, logs in trust.items():
        logs.append(float(np.log((sum(cells.get((v, k), 0) for k in range(n)) + DECLARE / len(values)) / (sum(total) + DECLARE))))
    votes = scored.select("host", F.when(F.col("letters") > 0, F.col("own")).otherwise(F.col("said")).alias("vote")).where("vote is not null")
    fused = scored.join(broadcast_if_small(host_priors(votes), MAX_BROADCAST_HOSTS), "host", "left")
    fused = fused.join(broadcast_if_small(_suffix_logs(scored), MAX_BROADCAST_HOSTS), "address_suffix", "left")

    def evidence(k: int) -> Column:
        logs = F.lit(0.0)
        for v, values in sorted(trust.items()):
            logs = F.when(F.col("said") == F.lit(v), F.lit(values[k])).otherwise(logs)
        return logs + F.coalesce(F.col("suffix_logs")[k], F.lit(0.0))

    total = [F.col("ll")[k] + F.coalesce(F.log(F.col("prior")[k]), F.lit(0.0)) + evidence(k) for k in range(n)]
    total.append(F.when(F.col("letters") > 0, F.col("strange") + evidence(n)).otherwise(float("-inf")))
    judged = fused.withColumn("total", F.array(*total))
    top = F.array_max("total")
    odds = F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    judged = judged.withColumn("posterior", 1 / odds)
    lang = F.when(F.col("letters") > 0, F.element_at(F.array_append(names, F.lit("und")), _best(F.col("total")) + 1)).otherwise("und")
    text_lang = F.when(F.col("own").isNotNull(), F.element_at(names, F.col("own") + 1))  # of a null place Spark takes the last
    kept = (F.col("letters") > 0) & (_best(F.col("total")) < n) & (F.col("posterior") >= KEEP)
    return judged.select(*keys, lang.alias("lang"), F.round("posterior", 6).alias("posterior"), text_lang.alias("text_lang"), "declared", kept.alias("kept"))


def _suffix_logs(scored: DataFrame) -> DataFrame:
    """(address_suffix, suffix_logs) of all suffixes: log P(suffix | language told by the text) and, at the end, log P(suffix)."""
    n = len(LANGUAGES)
    counts = scored.where("address_suffix is not null and own is not null").groupBy("address_suffix").agg(*(F.sum((F.col("own") == k).cast("double")).alias(f"c{k}") for k in range(n)))
    counts = stage(counts.withColumn(f"c{n}", sum((F.col(f"c{k}") for k in range(n)), F.lit(0.0))), "suffixes")
    *total, size = counts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) for k in range(n + 1)), F.count("*")).first()
    logs = [F.log((F.col(f"c{k}") + DECLARE / max(size, 1)) / (total[k] + DECLARE)) for k in range(n + 1)]
    return counts.select("address_suffix", F.array(*logs).alias("suffix_logs"))


def of_documents(documents: DataFrame) -> DataFrame:
    """documents judged by text, declared lang and source as host: doc_id, text_hash and identify()'s columns."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", F.lower("lang").alias("declared"), F.lower("source").alias("host"), F.lit(None).cast("string").alias("address_suffix"))
    return identify(rows)


def of_pages(pages: DataFrame) -> DataFrame:
    """pages judged by the text between tags, the markup's lang attribute, the host and the host's suffix: page_id and
    identify()'s columns."""
    host = F.lower(F.nullif(F.regexp_extract("url", "://([^/?#:]*)", 1), F.lit("")))
    declared = F.lower(F.nullif(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})", 1), F.lit("")))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&\w+;", " ")
    rows = pages.select("page_id", text.alias("text"), declared.alias("declared"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("address_suffix"))
    return identify(rows)


def keep(documents: DataFrame) -> DataFrame:
    """The documents, with all columns, that are in a known language."""
    out = of_documents(documents).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    out = broadcast_if_small(out, MAX_BROADCAST_HOSTS)
    return documents.join(out, documents["doc_id"].eqNullSafe(out["_id"]) & (F.xxhash64(documents["text"]) == out["_h"]), "left_anti")
