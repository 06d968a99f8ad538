"""URL filter, media, language, toxicity, personal data and the pipeline against brute force and exact round trips."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferrule.llm import language, matroska, pii, toxicity, urls
from ferrule.llm.queries import QUERIES
from ferrule.session import load
from tests.llm.helpers import AWKWARD, frame, long_text
from tests.llm.test_pairs import TOKENIZER, contamination_reference, fingerprint


# URLs ------------------------------------------------------------------------------------------------------------

URLS = [
    (1, "http://www.example.com/en/1"), (2, "https://blog.example.com/en/x?y"), (3, "http://a.net/es/1"), (4, "http://a.net/es"), (5, None), (6, "no scheme adult"), (7, "https://EXAMPLE.com"), (8, "x://h.org/free-pills"), (81, "x://h.org/pills"), (82, "x://h.org/win/cheap"), (83, "x://h.org/win/cheap?click"), (84, "x://loan.org/bets"),
    (9, "x://h.org/free"), (10, "x://h.org/freepills/spammy"), (11, "x://h.org/free?free#free"), (12, "http://notexample.com/en/"), (None, "http://c.org/casino"), (12, "http://notexample.com/en/"), (13, ""), (14, "://"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, rule string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}

    def want(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        has = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", (u or "").lower())
        bad = any(map(has, urls.STRICT)) or sum(w for t, w in urls.SOFT.items() if has(t)) >= urls.SOFT_LIMIT
        return host, path, None, "block" if bad else "allow"

    assert got == {(i, *want(u)) for i, u in URLS}
    assert urls.judge(pages.limit(0)).count() == 0


# Media -----------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    rows = AWKWARD + [(40, "x" * 575), (41, "x" * 576), (42, "x" * 577), (43, long_text(20000, 2))]
    got = sorted((tuple(r) for r in matroska.media_digests(frame(spark, rows)).collect()), key=str)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        media = matroska.write(payload)
        packets, cues = matroska.read(media)
        assert b"".join(media[p.start : p.start + p.size] for p in packets) == payload
        assert [p.timestamp for p in packets] == [72 * k for k in range(len(packets))]
        assert all(media[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big") for _, _, at in cues)
        samples = np.frombuffer(payload, np.uint8)
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), matroska.feature(samples, packets, cues)))
    assert got == sorted(want, key=str)
    table = matroska.packet_table(matroska.media_column(frame(spark, rows)))
    assert table.count() == sum(w[2] // 576 for w in want)
    assert table.where("error is not null").count() == 0
    assert matroska.media_digests(frame(spark, [])).count() == 0


def test_broken_media_have_a_reason(spark):
    media = matroska.write(b"x" * 576 * 40)
    files = [media, media[:-7], b"", b"\x00\x01", media[:9], None, b"\x1f\x43\xb6\x75\xff" + b"\xa3\xff", ebml(matroska.SEGMENT, b"\x1f\x43\xb6\x75\xff\xa3\xff"), ebml(matroska.SEGMENT, ebml(matroska.CLUSTER, ebml(matroska.SIMPLE_BLOCK, b"\x81")))]
    rows = matroska.packet_table(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")).collect()
    assert collections.Counter(r.doc_id for r in rows if r.error is None) == {0: 40}
    broken = {r.doc_id for r in rows if r.error is not None}
    assert broken == {1, 3, 4, 6, 7, 8} and all(r.n is None for r in rows if r.error is not None)


def ebml(kind, body):
    return matroska._element(kind, body)


def test_all_lacings_and_block_groups():
    frames = [bytes([k]) * n for k, n in enumerate((300, 20, 255, 510, 7))]
    head = b"\x81" + struct.pack(">h", 5)
    xiph = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    sizes = [len(f) for f in frames]
    deltas = b"".join((d + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") for d in np.diff(sizes[:-1]).tolist())
    ebml_sizes = (sizes[0] | 1 << 14).to_bytes(2, "big") + deltas
    same = [b"ab", b"cd", b"ef"]
    blocks = [
        ebml(matroska.SIMPLE_BLOCK, head + b"\x00" + frames[0]),
        ebml(matroska.SIMPLE_BLOCK, head + b"\x02" + bytes([4]) + xiph + b"".join(frames)),
        ebml(matroska.BLOCK_GROUP, ebml(matroska.BLOCK, head + b"\x06" + bytes([4]) + ebml_sizes + b"".join(frames))),
        ebml(matroska.SIMPLE_BLOCK, head + b"\x04" + bytes([2]) + b"".join(same)),
    ]
    cluster = ebml(matroska.TIMESTAMP, b"\x64") + b"".join(blocks)
    unknown = b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + cluster
    data = ebml(matroska.SEGMENT, unknown + ebml(matroska.CLUSTER, ebml(matroska.TIMESTAMP, b"\xc8") + blocks[0]))
    packets, _ = matroska.read(data)
    assert [data[p.start : p.start + p.size] for p in packets] == [frames[0], *frames, *frames, *same, frames[0]]
    assert [p.timestamp for p in packets] == [105] * 14 + [205]


# Language --------------------------------------------------------------------------------------------------------


def test_language_of_documents(spark, sf):
    docs = load(spark, sf, "documents")
    got = language.of_documents(docs).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert len(got) == docs.count() and all(r.kept for r in got)
    assert sum(r.lang == r.true for r in got) >= 0.99 * len(got)


def test_language_text_overrules_a_wrong_declaration(spark, sf):
    docs = load(spark, sf, "documents").withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "es").otherwise(F.col("lang")))
    true = load(spark, sf, "documents").where("doc_id % 10 = 0 and length(text) > 300").select("doc_id", F.col("lang").alias("true"))
    got = language.of_documents(docs).join(true, "doc_id").collect()
    assert sum(r.lang == r.true for r in got) >= 0.9 * len(got)


def test_language_of_pages(spark, sf):
    pages = load(spark, sf, "pages")
    got = language.of_pages(pages).collect()
    assert len(got) == pages.count() and sum(r.lang == r.declared for r in got) >= 0.95 * len(got)


def test_language_awkward(spark):
    rows = AWKWARD + [(50, "12 34 !!"), (51, "the cat and the dog are in the house")]
    got = collections.Counter((r.doc_id, r.kept) for r in language.of_documents(frame(spark, rows)).collect())
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert got == collections.Counter((d, letters(t)) for d, t in rows)
    kept = language.keep(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(letters(t) for _, t in rows)
    assert language.of_documents(frame(spark, [])).count() == 0


FOREIGN = [
    "Il governo ha approvato ieri una nuova legge sulla scuola che cambia le regole per gli insegnanti. " * 3,
    "Правительство вчера одобрило новый закон о школах, который меняет правила для учителей. " * 3,
    "Rząd przyjął wczoraj nową ustawę o szkołach, która zmienia zasady dla nauczycieli. " * 3,
    "政府昨天通过了一项新的学校法律，改变了教师的规则。" * 3,
]


@pytest.mark.parametrize("declared", [None, "it", "es"])
def test_language_outside_the_set_is_rejected(spark, declared):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    rows = spark.createDataFrame([(-1 - k, t, declared, "src0") for k, t in enumerate(FOREIGN)], "doc_id long, text string, lang string, source string")
    got = language.of_documents(docs.unionByName(rows)).collect()
    assert {(r.doc_id, r.lang, r.text_lang, r.kept) for r in got if r.doc_id < 0} == {(-1 - k, "und", None, False) for k in range(len(FOREIGN))}
    assert all(r.kept for r in got if r.doc_id >= 0 and r.text_lang)
    assert language.keep(docs.unionByName(rows)).where("doc_id < 0").count() == 0


def test_language_query_judges_all_documents_and_pages(spark, sf):
    got = QUERIES["op7_language"](spark, sf).collect()
    for table, key in (("documents", "doc_id"), ("pages", "page_id")):
        want = collections.Counter(r[0] for r in load(spark, sf, table).select(key).collect())
        assert collections.Counter(r[key] for r in got if r[key] is not None) == want
    pages = {tuple(r) for r in language.of_pages(load(spark, sf, "pages")).collect()}
    assert {(r.page_id, r.lang, r.posterior, r.text_lang, r.declared, r.kept) for r in got if r.page_id is not None} == pages


def language_reference(rows):
    """Bayes' rule in plain loops over (key, text, declared, host, suffix): {key: (lang, posterior, text_lang, kept)}."""
    names, n = language.LANGUAGES, len(language.LANGUAGES)

    def grams(t):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        words = [b" " + w + b" " for w in re.findall(rb"[a-z\x80-\xff]+", low)]
        return [((w[i] << 16 | w[i + 1] << 8 | w[i + 2]) * 2654435761 % 2**32) >> 17 for w in words for i in range(len(w) - 2)]

    table = np.full((n, language.TABLE), language.SMOOTH)
    for _, t, said, _, _ in rows:
        if said in names and t is not None:
            for b in grams(t):
                table[names.index(said), b] += 1
    table = np.log(table / table.sum(axis=1, keepdims=True))
    seen = []
    for key, t, said, host, suffix in rows:
        own = grams(t)
        ll = np.array([sum(table[k, b] for b in own) for k in range(n)]) * language.INDEPENDENT
        near = ll.max() / language.INDEPENDENT / max(len(own), 1)
        place = names.index(said) if said in names else None
        seen.append({"key": key, "ll": ll - ll.max(), "near": near, "letters": len(own), "said": place, "own": int(ll.argmax()) if own else None, "host": host, "suffix": suffix, "declared": said})
    agreed = sorted(r["near"] for r in seen if r["said"] is not None and r["said"] == r["own"])
    for r in seen:
        r["strange"] = (agreed[-(-len(agreed) // 2) - 1] - language.FAR - r["near"]) * r["letters"] * language.INDEPENDENT + np.log(language.UNKNOWN) if agreed else -np.inf
        if r["strange"] > 0:
            r["own"] = None
    said = collections.Counter((r["said"], r["own"]) for r in seen if r["said"] is not None and r["own"] is not None)
    values = {v for v, _ in said}
    share = lambda part, whole, kinds: np.log((part + language.DECLARE / kinds) / (whole + language.DECLARE))
    total = [sum(c for (_, o), c in said.items() if o == k) for k in range(n)]
    trust = {v: [share(said[v, k], total[k], len(values)) for k in range(n)] + [share(sum(said[v, k] for k in range(n)), sum(total), len(values))] for v in values}
    ends = collections.Counter((r["suffix"], r["own"]) for r in seen if r["suffix"] is not None and r["own"] is not None)
    kinds = {v for v, _ in ends}
    by = [sum(c for (_, o), c in ends.items() if o == k) for k in range(n)]
    suffixes = {v: [share(ends[v, k], by[k], len(kinds)) for k in range(n)] + [share(sum(ends[v, k] for k in range(n)), sum(by), len(kinds))] for v in kinds}
    votes = [(r["host"], r["own"] if r["letters"] else r["said"]) for r in seen if r["host"] is not None]
    votes = [(h, v) for h, v in votes if v is not None]
    levels = [lambda h: "", lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h]

    def prior(host, level):
        above = np.full(n, 1 / n) if level == 0 else prior(host, level - 1)
        own = [v for h, v in votes if levels[level](h) == levels[level](host)]
        return (np.array([own.count(k) for k in range(n)]) + language.PARENT * above) / (len(own) + language.PARENT)

    out = {}
    for r in seen:
        score = list(r["ll"]) + [r["strange"] if r["letters"] else -np.inf]
        for k in range(n + 1):
            score[k] += trust[r["said"]][k] if r["said"] in trust else 0
            score[k] += suffixes[r["suffix"]][k] if r["suffix"] in suffixes else 0
            if k < n and r["host"] in {h for h, _ in votes}:
                score[k] += np.log(prior(r["host"], 3)[k])
        best = int(np.argmax(score))
        posterior = 1 / sum(np.exp(x - score[best]) for x in score)
        lang = (*names, "und")[best] if r["letters"] else "und"
        out[r["key"]] = (lang, posterior, None if r["own"] is None else names[r["own"]], bool(r["letters"] and best < n and posterior >= language.KEEP))
    return out


def test_language_against_plain_loops(spark):
    r = random.Random(9)
    said = {"de": "das haus und der hund sind nicht hier aber dort", "en": "the house and the dog are not here but there", "es": "la casa y el perro no son de aqui pero si", "fr": "la maison et le chien ne sont pas ici mais la"}
    hosts = ["a.de", "b.a.de", "x.org", "y.x.org", "z.fr", None]
    rows = []
    for k in range(120):
        lang = r.choice(list(said))
        words = said[lang].split()
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 9)))
        host = r.choice(hosts)
        rows.append((k, text, r.choice([lang, lang, lang, "it", None, r.choice(list(said))]), host, host.split(".")[-1] if host else None))
    rows += [(900, None, "de", "a.de", "de"), (901, "12 !!", "fr", None, None), (902, "", None, "new.net", "net"), (903, "qqxz wvvk zzkq xxyy jjqq kkvv" * 3, "en", "x.org", "org"), (904, "la", None, "z.fr", "fr")]
    got = {x.id: x for x in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, address_suffix string")).collect()}
    want = language_reference(rows)
    assert len(got) == len(rows)
    for key, (lang, posterior, text_lang, kept) in want.items():
        x = got[key]
        assert (x.lang, x.text_lang, x.kept) == (lang, text_lang, kept) and x.posterior == pytest.approx(posterior, abs=1e-4), key


def test_language_without_declarations(spark):
    """Rows whose declaration is hidden are told by text and host."""
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    got = language.of_documents(hidden).join(docs.select("doc_id", F.col("lang").alias("true"), F.length("text").alias("n")), "doc_id").where("doc_id % 5 = 0").collect()
    assert len(got) == docs.where("doc_id % 5 = 0").count() and sum(r.lang == r.true for r in got) >= 0.98 * len(got)


def test_language_rare_suffixes_are_evidence(spark):
    suffix = lambda k: f"s{k:04d}"
    texts = {"de": "das haus und der hund sind nicht hier", "fr": "la maison et le chien ne sont pas ici"}
    rows = [(k, texts["de"], "de", f"h.{suffix(k % 1001)}", suffix(k % 1001)) for k in range(2002)] + [(9001, texts["fr"], "fr", "h.zz", "zz"), (9002, None, None, "h.zz", "zz")]
    scored = spark.createDataFrame([(s, 3 if s == "zz" else 0) for _, _, _, _, s in rows[:-1]], "address_suffix string, own int")
    logs = {r.address_suffix: r.suffix_logs for r in language._suffix_logs(scored).collect()}
    assert len(logs) == 1002 and logs["zz"][3] > max(logs["zz"][:3])
    assert language.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, address_suffix string")).count() == len(rows)


# Toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    out = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    y, p = np.array([r.toxic for r in out]), np.array([r.predicted for r in out])
    assert (p[y == 1] == 1).mean() > 0.85 and (p[y == 0] == 1).mean() < 0.03


def test_toxicity_awkward(spark):
    rows = AWKWARD + [(60 + k, "you idiot moron" if k % 2 else "good day friend") for k in range(60)]
    labels = spark.createDataFrame([(60 + k, k % 2, None) for k in range(60)] + [(None, 1, None), (1, None, None), (60, 0, None)], "doc_id long, toxic int, score string")
    got = toxicity.score(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    texts = collections.defaultdict(set)
    for r in got:
        texts[r.doc_id].add(r.score)
    assert len(texts[3]) == 1
    flipped = toxicity.sample(frame(spark, rows), labels)
    assert len(flipped[3]) == sum(zlib.crc32(str(60 + k).encode()) % 5 != 0 for k in range(60))
    assert toxicity.score(frame(spark, rows), labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.score(frame(spark, []), labels).count() == 0


def test_forward_pass_by_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "TABLE", 97)
    model = toxicity.Model(2)
    texts = ["", None, "one", "Some words, and some more words", long_text(40, 3), "é É x1 x2"]
    raw, off = toxicity.tx.utf8(toxicity.pa.array(texts, toxicity.pa.string()))
    ids, bounds, _ = toxicity.ids_of(raw, off)
    got = model.logits(ids, bounds)
    hashed = lambda b: int(toxicity.tx.word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    for t, z in zip(texts, got):
        words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        rows = []
        for w in words:
            keys = [hashed(w)] + [int(toxicity.tx.mix(np.array([hashed(w[:n])], np.uint64) + np.uint64(n))[0]) for n in toxicity.PREFIXES]
            rows.append(sum(model.p["e"][k % 96 + 1].astype(float) for k in keys))
        zero = 3 * model.p["e"][0].astype(float)  # the row that stands for no word
        padded = (rows or [zero]) + [zero] * toxicity.PAD
        pooled = []
        for w in toxicity.WIDTHS:
            sums = [sum(padded[i + j] @ model.p[f"w{w}"][j] for j in range(w)) for i in range(max(len(rows), 1))]
            pooled.extend(np.max(sums, axis=0) + model.p[f"b{w}"])
        assert z == pytest.approx(float(np.maximum(pooled, 0) @ model.p["o"] + model.p["c"][0]), rel=1e-4, abs=1e-5)


def test_toxicity_sample_is_bounded_in_bytes(spark):
    texts = [(k, long_text(200, k)) for k in range(40)] * 2
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    whole = toxicity.sample(frame(spark, texts), labels)
    assert len(whole[3]) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(40))
    some = toxicity.sample(frame(spark, texts), labels, size=4000)
    assert 2 <= len(some[3]) < len(whole[3]) and len(set(some[3])) == 2


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "TABLE", 50)
    model = toxicity.Model(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    ids, bounds = r.integers(1, 50, (30, 3)).astype(np.int32), np.array([0, 0, 12, 13, 30])
    padded, begins = toxicity._padded(ids, bounds)
    y, w = np.array([0, 1, 0, 1.0]), np.ones(4)

    def loss():
        z = model.logits(ids, bounds)
        return (w * (np.log1p(np.exp(z)) - y * z)).sum() / w.sum()

    grads = model.step(padded, begins, y, w)
    for name in ("o", "c", "w1", "w2", "w3", "b2", "e"):
        rows, g = grads[name]
        at = (0,) * g.ndim if rows is None else (0, 1)
        place = at if rows is None else (rows[0], 1)
        old, model.p[name][place] = model.p[name][place], model.p[name][place] + 1e-6
        up = loss()
        model.p[name][place] = old - 1e-6
        down = loss()
        model.p[name][place] = old
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-6)


# Personal data ---------------------------------------------------------------------------------------------------

TEXTS = [
    "mail a.b+c@x-y.example.com, b@c.d@e.f x@@a.b a.b@c @a.b q@-1.w. tail", "ip 1.2.3.4.5 001.02.3.255 256.1.1.1 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111",
    "call +1 (017) 555-7713. or +49 30 123 45 67 8 or +1 2", "É é +44 20 7946 0958 x@y.zz", "", None, "4111111111111111@1.2.3.4", "+1.2.3.4", "a@b.c" * 30, "1 " * 300, "@" * 200,
]


def base_reference(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_on_random_texts():
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("a@.@.-+ 1234567890()%é") for _ in range(r.randint(0, 40)))
        assert pii.base(t) == base_reference(t), t


def test_pii(spark):
    rows = list(enumerate(TEXTS)) + AWKWARD
    got = pii.find(frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        spans = base_reference(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((d, *(sum(k == x for k, _, _ in spans) for x in pii.KINDS), hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert pii.find(frame(spark, [])).count() == 0


def test_pii_discovers_by_context(spark):
    r = random.Random(4)
    number = lambda: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    rows = [(k, f"please telephone +1 {number()} today") for k in range(40)]
    rows += [(100, "please telephone +1 (20) 1234-5678-12345678 today"), (101, "invoice 1234567 paid")]
    rows += [(200 + k, f"ring us: mailto {chr(97 + k % 26)}{k}@h{k}.org now") for k in range(40)] + [(300, "ring us: mailto someone@localhost now"), (301, "weird someone@localhost alone")]
    spans = {x.doc_id: x.spans for x in pii.find(frame(spark, rows)).collect()}
    assert spans[300] == "email:16:33"
    assert spans[101] == "" and spans[301] == ""
    clean = {x.doc_id: x.text for x in pii.redact(frame(spark, rows)).collect()}
    assert clean[300] == "ring us: mailto <EMAIL> now" and clean[101] == rows[41][1] and clean[0] == "please telephone <PHONE> today"


def discovery_reference(rows):
    """Graph, rounds and spans of discovery by plain loops: {row: added spans}."""
    occ = [(d, o) for d, t in rows for o in pii.occurrences(t or "", pii.base(t or ""))]
    known = {(o[3], o[0]) for _, o in occ if o[0]}
    edges = {(p, o[3]) for _, o in occ for p in o[4]}
    while True:
        inside = collections.defaultdict(set)
        for p, i in edges:
            inside[p].add(i)
        trusted = {}
        for p, members in inside.items():
            for kind in pii.KINDS:
                seeds = sum((i, kind) in known for i in members)
                if seeds >= pii.MIN_SEEDS and seeds / (len(members) + pii.DOUBT) >= pii.MIN_CONFIDENCE:
                    trusted[p, kind] = seeds / (len(members) + pii.DOUBT)
        doubt = collections.defaultdict(lambda: 1.0)
        for (p, kind), c in trusted.items():
            for i in inside[p] - {i for i, _ in known}:
                doubt[i, kind] *= 1.000001 - c
        if not doubt:
            break
        known |= {(i, max((1 - v, k) for (j, k), v in doubt.items() if j == i)[1]) for i, _ in doubt}
    best = {}
    for (p, kind), c in trusted.items():
        best[p] = max(best.get(p, (0, "")), (c, kind))
    out = collections.defaultdict(set)
    for d, (kind, a, b, _, patterns) in occ:
        if kind is None and (met := [best[p] for p in patterns if p in best]):
            out[d].add(f"{max(met)[1]}:{a}:{b}")
    return out


def planted(seed=5):
    """Texts with identifiers that no base pattern takes, in contexts that seeds teach, some only in a second round."""
    r = random.Random(seed)
    number = lambda: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    rows, secret = [], {}
    for k in range(600):
        filler = long_text(r.randint(1, 6), 900 + k)
        rows.append((k, f"{filler} telephone +1 {number()} office {filler}"))
    unknown = lambda: f"({r.randint(200, 999)}) {r.randint(100, 999)}-{r.randint(10000, 99999)}"
    for k in range(600, 643):
        secret[k] = unknown()
        taught = f"my telephone {secret[k]} office or " if k < 640 else ""  # the last ones only where those before taught
        rows.append((k, f"{taught}reach fax {secret[k]} desk"))
    for k in range(700, 760):
        rows.append((k, f"order {r.randint(10**7, 10**9)} paid in {long_text(2, k)}"))
    return rows, secret


def test_pii_bootstrap_against_plain_loops(spark):
    rows, secret = planted()
    got = {x.doc_id: x.spans for x in pii.find(frame(spark, rows)).collect()}
    extra = {d: {s for s in got[d].split(",") if s} - {f"{k}:{a}:{b}" for k, a, b in pii.base(t)} for d, t in rows}
    want = discovery_reference(rows)
    assert extra == {d: want.get(d, set()) for d, _ in rows}
    found = {d for d, n in secret.items() if any(dict(rows)[d][int(s.split(":")[1]) : int(s.split(":")[2])] == n for s in extra[d])}
    assert len(found) >= 0.9 * len(secret) and not any(extra[d] for d in extra if d not in secret)


def test_pii_takes_long_identifiers_whole(spark):
    rows = [(k, f"contact mailto a{k}@h{k}.org now") for k in range(40)]
    rows += [(100, f"contact mailto {'x' * 3000}@{'y' * 2000} now"), (101, "97.51.17.173 4845168114407329 next")]
    got = {x.doc_id: x.spans for x in pii.find(frame(spark, rows)).collect()}
    assert got[100] == "email:15:5016"
    assert [o[1:3] for o in pii.occurrences(rows[-1][1], pii.base(rows[-1][1])) if o[0] is None] == [(13, 29)]


def test_redaction_leaves_nothing(spark):
    rows = list(enumerate(TEXTS)) + AWKWARD
    out = pii.redact(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    got = out.collect()
    assert len(got) == len(rows) and all(not base_reference(r.text) for r in got)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert sum(r.text is None for r in got) == sum(t is None for _, t in rows)


# Pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf):
    from collections import defaultdict

    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, sf).collect()
    table = load(spark, sf, "documents").collect()
    docs = {r.doc_id: r.text for r in table}
    known = language_reference([(r.doc_id, r.text, r.lang and r.lang.lower(), r.source and r.source.lower(), None) for r in table])
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    left = {d: t for d, t in docs.items() if known[d][3]}
    fps = {d: fingerprint(t) for d, t in left.items()}
    root = {d: d for d in left}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(left)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {d: t for d, t in left.items() if find(d) == d}
    bad = {r[0] for r in contamination_reference(list(left.items()), items) if r[-1]}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = defaultdict(int)
    for d, t in left.items():
        if d not in bad:
            spans = pii.base(t)
            while spans:
                t = pii.mask(t, spans)
                spans = pii.base(t)
            want[d] = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    lengths = defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
    assert lengths == want


def test_stages_keep_columns(spark, sf):
    docs = load(spark, sf, "documents")
    for _, work in corpus_pipeline.STAGES[:-1]:
        assert work(spark, docs, sf).columns == docs.columns


def test_stages_on_awkward_rows(spark, sf):
    docs = frame(spark, AWKWARD)
    for _, work in corpus_pipeline.STAGES[:-1]:
        docs = work(spark, docs, sf)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, frame(spark, []), sf).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))
