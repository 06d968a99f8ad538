"""Toxicity by a convolutional text classifier in numpy.

Words are hashed into rows of an embedding table, each as the sum of the rows of the word and of its beginnings, so
that unseen forms of a stem are known; filters of several widths slide over them, each is max-pooled over
the whole text, and a logistic layer scores the pooled values. A filter of width w is a sum of w lookups (embedding
times one slice of the filter, multiplied out once for all rows of the table), so scoring is gathers and maxima.
Training is Adam on the driver over a bounded sample; the threshold of each language, told from the text's own
function words, is fitted on labelled rows held back from training and moved to 0.5 by shifting the logit.

Scale: the sample is bounded by MAX_SAMPLE labelled rows and MAX_SAMPLE_BYTES of text a class, chosen by hash from the
labels alone, so its ids are few enough to broadcast; the model has a fixed size. Scoring is a narrow step over whole texts.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0. labels, lang, source and doc_id are never
inputs of a score.

Defined cases: null text is empty, which has a score like any other. A row without doc_id has the text '' for its id
(held out). Labels that are null are no labels; if an id is labelled more than once, toxic wins. Without labels of both
classes every score is the share of toxic labels (0 if there is none). Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm import text as tx
from ferrule.session import stage

FOLDS = 5
#: The largest sample, of each class: rows, and bytes of text (a row that passes them is the last).
MAX_SAMPLE, MAX_SAMPLE_BYTES = 4000, 24 << 20
TABLE, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
#: Bytes of a word that are hashed besides the whole word.
PREFIXES = (4, 6)
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-4
PAD = max(WIDTHS) - 1
#: Function words that tell a text's language, with "" for none of them.
LANGUAGES = {
    "de": "der die das und ist nicht ein eine zu den mit von sich auf für im dem".split(),
    "en": "the of and to in is that it was for on are with as be this by".split(),
    "es": "el la los las que en un una por con para del se su al es y".split(),
    "fr": "le la les des et est une du que dans qui par pour sur pas au".split(),
}


def ids_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows of all words, (words, 1 + prefixes); row bounds; 64-bit word hashes) of texts."""
    raw = tx.LOWER[raw]
    start, end, bounds = tx.words(raw, off, tx.ALNUM_WORDS)
    h = tx.word_hashes(raw, start, end)
    keys = [h, *(tx.mix(tx.word_hashes(raw, start, np.minimum(end, start + n)) + np.uint64(n)) for n in PREFIXES)]
    return np.stack([(k % np.uint64(TABLE - 1)).astype(np.int32) + 1 for k in keys], axis=1), bounds, h


def _hash(words: list[str]) -> np.ndarray:
    raw, off = tx.utf8(pa.array(words))
    return tx.word_hashes(raw, off[:-1], off[1:])


def languages_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the place of its language in LANGUAGES, or their number if no function word stands in it."""
    counts = np.zeros((len(bounds) - 1, len(LANGUAGES)), np.int64)
    for k, words in enumerate(LANGUAGES.values()):
        sums = np.concatenate([[0], np.cumsum(np.isin(h, _hash(words)))])
        counts[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(LANGUAGES))


def _padded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with PAD zeros after each text (and one for the start of an empty one), and where each text begins."""
    n = np.diff(bounds)
    room = np.maximum(n, 1) + PAD
    begins = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros((begins[-1], ids.shape[1]), np.int32)
    out[np.arange(len(ids)) + np.repeat(begins[:-1] - bounds[:-1], n)] = ids
    return out, begins


def _summed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    acc = table[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        acc += table[ids[:, k]]
    return acc


class Model:
    """Embeddings, filters by width and place, and the logistic layer."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.1, (TABLE, DIM)).astype(np.float32), "o": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.5 / w**0.5, (w, DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.shift = np.zeros(len(LANGUAGES) + 1, np.float32)
        self.constant: float | None = None

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.p["e"] @ self.p[f"w{w}"][j] for j in range(w)] for w in WIDTHS]

    def pooled(self, ids: np.ndarray, begins: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Before the ramp: (texts, widths x filters). The zeros after a text close its last words' filters."""
        cols = []
        for w, places in zip(WIDTHS, tables):
            acc = _summed(places[0], ids)
            for j in range(1, w):
                acc[:-j] += _summed(places[j], ids[j:])
            ends = np.repeat(begins[1:] - PAD, np.diff(begins))
            acc[np.arange(len(ids)) >= ends] = -np.inf
            cols.append(np.maximum.reduceat(acc, begins[:-1], axis=0) + self.p[f"b{w}"])
        return np.concatenate(cols, axis=1)

    def logits(self, ids: np.ndarray, bounds: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        padded, begins = _padded(ids, bounds)
        if len(begins) == 1:
            return np.zeros(0, np.float32)
        return np.maximum(self.pooled(padded, begins, tables or self.tables()), 0) @ self.p["o"] + self.p["c"]

    def step(self, ids: np.ndarray, begins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, tuple[np.ndarray | None, np.ndarray]]:
        """Gradients, as (rows, values) for the embeddings and (None, values) for the rest."""
        n, best = len(y), []
        emb = _summed(self.p["e"], ids)
        for w in WIDTHS:
            acc = emb @ self.p[f"w{w}"][0]
            for j in range(1, w):
                acc[:-j] += emb[j:] @ self.p[f"w{w}"][j]
            at = np.empty((n, FILTERS), np.int64)
            for d in range(n):
                a, b = begins[d], begins[d + 1] - PAD
                at[d] = acc[a:b].argmax(axis=0) + a
            best.append((at, np.take_along_axis(acc, at, axis=0) + self.p[f"b{w}"]))
        z = np.concatenate([v for _, v in best], axis=1)
        g = (1 / (1 + np.exp(-(np.maximum(z, 0) @ self.p["o"] + self.p["c"]))) - y) * weight / weight.sum()
        grads: dict = {"o": (None, np.maximum(z, 0).T @ g), "c": (None, g.sum(keepdims=True))}
        dz = g[:, None] * self.p["o"] * (z > 0)
        rows, values = [], []
        for k, w in enumerate(WIDTHS):
            d = dz[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
            at = best[k][0]
            grads[f"b{w}"] = (None, d.sum(axis=0))
            gw = np.empty_like(self.p[f"w{w}"])
            for j in range(w):
                x = emb[at + j]  # texts, filters, dim
                gw[j] = np.einsum("tfd,tf->df", x, d)
                value = (d[:, :, None] * self.p[f"w{w}"][j].T[None]).reshape(-1, DIM)
                for column in ids.T:
                    rows.append(column[at + j].ravel())
                    values.append(value)
            grads[f"w{w}"] = (None, gw)
        rows, values = np.concatenate(rows), np.concatenate(values)
        live = np.abs(values).sum(axis=1) > 0
        own, at = np.unique(rows[live], return_inverse=True)
        summed = np.zeros((len(own), DIM), np.float32)
        np.add.at(summed, at, values[live])
        grads["e"] = (own, summed)
        return grads


def train(ids: np.ndarray, bounds: np.ndarray, langs: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """A model for texts given as table rows. One text in six is held back for the thresholds."""
    model = Model(seed)
    if len(np.unique(y)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, use = order[: len(y) // 6], order[len(y) // 6 :]
    weight = np.where(y == 1, 0.5 / max(1, y[use].sum()), 0.5 / max(1, (1 - y[use]).sum())).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        use = rng.permutation(use)
        for k in range(0, len(use), BATCH):
            own, t = use[k : k + BATCH], t + 1
            parts = [ids[bounds[d] : bounds[d + 1]] for d in own]
            padded, begins = _padded(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            for name, (rows, g) in model.step(padded, begins, y[own], weight[own]).items():
                at = slice(None) if rows is None else rows
                p, m, v = model.p[name], first[name], second[name]
                g = g + DECAY * p[at]
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.99 * v[at] + 0.01 * g * g
                p[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-7)
    # A language's threshold: the middle of the widest stretch of logits with the fewest errors, classes weighed alike.
    parts = [ids[bounds[d] : bounds[d + 1]] for d in held]
    z = model.logits(np.concatenate(parts) if parts else ids[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
    whole = _threshold(z, y[held], 0.0)
    model.shift[:] = whole
    for k in range(len(LANGUAGES)):
        model.shift[k] = _threshold(z[langs[held] == k], y[held][langs[held] == k], whole)
    return model


def _threshold(z: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    if min((y == 1).sum(), (y == 0).sum()) < 10:
        return otherwise
    order = np.argsort(z)
    z, y = z[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / y.sum()  # toxic ones below the cut
    false = ((1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])) / (1 - y).sum()
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gaps = np.concatenate([[1], z[1:] - z[:-1], [1]])
    cost = missed + false
    near = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float(cuts[near[gaps[near].argmax()]])


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(documents: DataFrame, labels: DataFrame, bound: int = MAX_SAMPLE, size: int = MAX_SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bounds, languages, labels) of at most bound labelled rows and size bytes of text a class, none of them held
    out. Rows alike in doc_id and text count once."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(_fold(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id"))
    picked = known.where("toxic = 1").orderBy("h", "doc_id").limit(bound).union(known.where("toxic = 0").orderBy("h", "doc_id").limit(bound)).select("doc_id", "h", F.col("toxic").cast("int").alias("toxic"))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("th"))
    texts = docs.join(F.broadcast(picked), "doc_id").groupBy("toxic", "h", "doc_id", "th").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n"))
    # Texts by class in order of hash: their number is bounded by the picked ids and their different texts.
    before = F.sum("n").over(Window.partitionBy("toxic").orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    chosen = stage(texts.withColumn("before", before).where(F.col("before") < size).select("doc_id", "th", "toxic"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.utf8(batch.column(1))
            for i, j in tx.slices(off):
                ids, bounds, h = ids_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                packed = [ids[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(packed, pa.binary()), pa.array(languages_of(h, bounds)), own.column(3)], ["doc_id", "th", "ids", "lang", "toxic"])

    width = 1 + len(PREFIXES)
    same = docs["th"].eqNullSafe(chosen["th"]) & (docs["doc_id"] == chosen["doc_id"])
    found = docs.join(F.broadcast(chosen), same).select(docs["doc_id"], "text", docs["th"], "toxic")
    rows = found.mapInArrow(run, "doc_id long, th long, ids binary, lang long, toxic int").dropDuplicates(["doc_id", "th"]).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("th", "ascending")])
    parts = [np.frombuffer(b.as_py(), "<i4").reshape(-1, width) for b in rows["ids"]]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int32), bounds, rows["lang"].to_numpy(), rows["toxic"].to_numpy().astype(np.float32)


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for batch in batches:
            raw, off = tx.utf8(batch.column(1))
            scores = []
            for i, j in tx.slices(off):
                ids, bounds, h = ids_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                z = own.logits(ids, bounds, tables) - own.shift[languages_of(h, bounds)]
                scores.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500))) if own.constant is None else np.full(j - i, own.constant))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled sample, then classify every row of documents."""
    return classify(documents, train(*sample(documents, labels)))
