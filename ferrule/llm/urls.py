"""URL filter: host and path rules first, then a weighted vocabulary counted by Aho-Corasick.

Rules: a rule fits its host and all subdomains if the url's path starts with the rule's path; of the fitting rules the
longest (host and path together) decides. Where none fits, the url's terms do: an automaton finds all strict and soft
terms in one pass, a hit counts only between boundaries (no letter or digit of ASCII on either side), and the url is
blocked on one strict term or on distinct soft terms whose weights reach `soft_limit`.

Scale: a narrow step; the automaton is made once in each Python process from the vocabulary, a parameter.

Defined cases: a null url or one without "://" has host and path "", no rule fits and its terms still count (null: none,
allowed). Rows are judged one by one, so repeated rows and rows without id give a row each. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Our vocabulary. Strict terms block alone.
STRICT = tuple(
    """
    adult casino casinos escort escorts hentai malware nsfw phishing porn porno poker ransomware sex sexcam slots
    spam spyware torrent torrents viagra warez xxx
    """.split()
)
#: Soft terms by weight: how much each says on its own. They add up, and no single one reaches SOFT_LIMIT.
SOFT = {
    **dict.fromkeys("ads bet bets betting bitcoin cialis crack cracked dating erotic forex gambling hacked jackpot keygen loan loans lottery lotto nude nudes payday pharmacy pills serial stripper wager weed".split(), 2),
    **dict.fromkeys(
        """
        bonus buy cash cheap click clickbait coupon coupons credit crypto deals diet discount download earn fast free
        gift girls hot income instant invest keto mobi money offer offers online order popup prize profit promo quick
        redirect rich sale secret singles snap spin survey track tracker trial usd vip wholesale win winner winners
        """.split(),
        1,
    ),
}
SOFT_LIMIT = 3

_UPPER = {i: i + 32 for i in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def split(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    m = _PARTS.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def rule_of(host: str, path: str, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest fitting rule."""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def automaton(strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> ahocorasick.Automaton:
    """Terms with their weights; a strict term weighs the whole limit."""
    a = ahocorasick.Automaton()
    for term, weight in {**soft, **dict.fromkeys(strict, soft_limit)}.items():
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def terms(url: str, a: ahocorasick.Automaton) -> dict[str, int]:
    """The distinct terms between boundaries, with weights."""
    s, inside, found = url.translate(_UPPER), "abcdefghijklmnopqrstuvwxyz0123456789", {}
    for end, (term, weight) in a.iter(s) if len(a) else ():
        begin = end - len(term) + 1
        if (begin == 0 or s[begin - 1] not in inside) and (end + 1 == len(s) or s[end + 1] not in inside):
            found[term] = weight
    return found


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, terms (the distinct terms found, comma-joined) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft, soft_limit)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split(url)
                rule = rule_of(host, path, rules)
                hits = terms(url or "", a)
                verdict = rule[1] if rule else "block" if sum(hits.values()) >= soft_limit else "allow"
                rows.append((host, path, rule and rule[0], verdict, ",".join(sorted(hits))))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict", "terms"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, terms string")
