"""URL filtering: explicit host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in a URL's host and path. A hit counts
only between boundaries. One strict term rejects, and so do several distinct soft ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from cloudloom.llm.shared import map_batches, renamed

# Terms of unwanted pages and their weights, a short list of our own by kind of page. Strict stems alone
# reject; soft terms count by how rarely harmless URLs have them. Plurals and the compounds below are made by rule.
_STRICT_STEMS = (
    "casino", "porn", "porno", "pornstar", "xxx", "milf", "hentai", "escort", "sexcam", "camgirl", "striptease", "viagra", "cialis", "levitra", "tramadol",
    "warez", "keygen", "phishing", "malware", "ransomware", "jackpot",
)
#: What is written in one word with a strict stem: freeporn, pornhub.
_BEFORE, _AFTER = ("free", "live", "hot", "online", "best", "real"), ("hub", "tube", "video", "site", "online", "club")
_SOFT_STEMS = {
    2: ("ad", "advert", "adult", "bet", "betting", "gambling", "poker", "roulette", "slot", "sex", "sexy", "nude", "erotic", "fetish", "pill", "replica",
        "rolex", "torrent", "crack", "spam", "popup", "clickbait", "payday", "lottery"),
    1: ("banner", "bonus", "cheap", "click", "coupon", "crypto", "dating", "deal", "discount", "farm", "free", "giveaway", "hot", "loan", "pharmacy", "prize",
        "promo", "rated", "track", "tracker", "tracking", "traffic", "webcam", "win", "winner", "x"),
}


def plurals(stem: str) -> tuple[str, ...]:
    return (stem,) if stem.endswith(("x", "y", "ing", "s")) else (stem, stem + "s")


STRICT = tuple(sorted({t for stem in _STRICT_STEMS for s in plurals(stem) for t in (s, *[b + s for b in _BEFORE], *[s + a for a in _AFTER])}))
#: Term -> weight.
SOFT = {t: weight for weight, stems in _SOFT_STEMS.items() for stem in stems for t in plurals(stem)}
#: Soft terms reject if there are so many distinct stems with such a weight together.
SOFT_TERMS, SOFT_WEIGHT = 2, 3
#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """The lower-cased host and the path of a URL; both empty for null or without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class Rules:
    """Host and path rules: a rule fits its host and all subdomains if the path starts with its path; the longest wins.

    Length counts host and path together; of equally long ones the longer host wins, then the later rule.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[int, int, str, str] | None = None
        suffix, dot = host, "."
        while dot:
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    size = (len(suffix) + len(start), len(suffix))
                    if best is None or size >= best[:2]:
                        best = (*size, suffix + start, verdict)
            _, dot, suffix = suffix.partition(".")
        return best and best[2:]


class Vocabulary:
    """Strict and weighted soft terms. One strict term rejects, and so do SOFT_TERMS distinct soft ones that weigh SOFT_WEIGHT together.

    A term and its plural are one term. Each counts once, however often it stands in the text.
    """

    def __init__(self, strict: Iterable[str] = STRICT, soft: Mapping[str, int] = SOFT) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in soft.items():
            self.automaton.add_word(term, (term, weight))
        for term in strict:
            self.automaton.add_word(term, (term, 0))
        self.automaton.make_automaton()

    def hits(self, text: str) -> dict[str, int]:
        """The weights of the distinct terms that stand between boundaries: no ASCII letter or digit beside them. Strict ones have 0."""
        found = {}
        for end, (term, weight) in self.automaton.iter(text):
            before, after = end - len(term), end + 1
            if (before < 0 or text[before] not in _WORD) and (after == len(text) or text[after] not in _WORD):
                found[term.removesuffix("s")] = weight
        return found

    def rejects(self, host: str, path: str) -> bool:
        weights = self.hits(f"{host} {path.translate(_LOWER)}").values()
        return 0 in weights or (len(weights) >= SOFT_TERMS and sum(weights) >= SOFT_WEIGHT)


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, strict: Iterable[str] = STRICT, soft: Mapping[str, int] = SOFT,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; verdict is the longest fitting rule's, else the vocabulary's.

    A null or malformed URL has an empty host and path, fits no rule and is allowed. URLs of any length are
    searched whole, but for their query and fragment. Rules that fit equally well go by host, then by
    their order. Repeated rows and null ids each come back; an empty table gives an empty result; other
    columns are not read.
    """
    rules, strict, soft = tuple(rules), tuple(strict), dict(soft)
    built: list = []

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.extend((Rules(rules), Vocabulary(strict, soft)))
        table, vocabulary = built
        out = []
        for url in batch.column(1).to_pylist():
            host, path = host_and_path(url)
            rule, verdict = table.find(host, path) or (None, "block" if vocabulary.rejects(host, path) else "allow")
            out.append((host, path, rule, verdict))
        columns = [pa.array(c, type=pa.string()) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "host", "path", "rule", "verdict"])

    rows = renamed(pages, id=id_col, url=url_col).selectExpr("cast(id as long) id", "url")
    return map_batches(rows, per_batch, "id long, host string, path string, rule string, verdict string")
