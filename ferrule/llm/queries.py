"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import decontaminate, language, matroska, packing, pii, sharding, simhash, substring, toxicity, urls
from ferrule.session import load


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sharding.lookup_table(spark)
    return sharding.shard(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", table)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(load(spark, sf_dir, "documents"), texts=False).drop("kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages")).drop("terms")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(load(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (page_id null) and all pages (doc_id null)."""
    docs, pages = (load(spark, sf_dir, t) for t in ("documents", "pages"))
    return language.of_documents(docs).drop("text_hash").unionByName(language.of_pages(pages), allowMissingColumns=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (load(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.judge(docs, items).drop("text_hash")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_substring": op2_substring,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_urls": op5_urls,
    "op6_matroska": op6_matroska,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
}


def _owners() -> list[str]:
    """The slots' shards, by plain turns: an independent statement of the table for the oracle."""
    h60 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    size, owners, n = sharding.SIZE, {}, 0
    walks = [(s, h60(f"{s}#offset") % size, h60(f"{s}#skip") % (size - 1) + 1) for s in sharding.SHARDS]
    looks = {s: (slot % size for slot in range(at, at + skip * size, skip)) for s, at, skip in walks}
    while len(owners) < size:
        s = sharding.SHARDS[n % len(sharding.SHARDS)]
        owners[next(slot for slot in looks[s] if slot not in owners)] = s
        n += 1
    return [owners[i] for i in range(size)]


OP1_SQL = f"""
WITH keyed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SIZE} AS slot FROM documents),
     turns AS (SELECT [{", ".join(s[-2:].lstrip("0") or "0" for s in _owners())}] AS owners)
SELECT slot::INTEGER AS slot, doc_id, 'shard-' || lpad(owners[slot + 1]::VARCHAR, 2, '0') AS shard FROM keyed, turns
"""

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM win),
grams AS (SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, sizes)),
hits AS (SELECT doc_id, i, size, item_id FROM grams JOIN win USING (win)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(w) AS contaminated
FROM w LEFT JOIN n_hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, hash(list_slice(w, i, i + 12)) AS h, md5_number(array_to_string(list_slice(w, i, i + 12), ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
least AS (SELECT h, m, min(doc_id) AS least FROM g GROUP BY h, m),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN least USING (h, m) WHERE least < doc_id) GROUP BY doc_id),
gone_at AS (SELECT doc_id, unnest(p) AS p, true AS gone FROM gone),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM one LEFT JOIN gone_at USING (doc_id, p) WHERE gone IS NULL GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_TERMS = {**urls.SOFT, **dict.fromkeys(urls.STRICT, urls.SOFT_LIMIT)}
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
OP5_SQL = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(v, h, p) AS (VALUES {_RULES}),
best AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN {" + ".join(f"{w} * regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t, w in _TERMS.items())} >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN best USING (n)
"""

ORACLES = {"op5_urls": OP5_SQL, "op2_substring": OP2_SQL, "op1_sharding": OP1_SQL, "op9_decontamination": OP9_SQL}
