"""Verdicts on URLs: rules by host and path, else a weighted vocabulary found by one Aho-Corasick pass.

A term counts only at boundaries: the characters before and after it are not letters or digits of ASCII. Case of ASCII
letters does not matter; the whole URL is searched, scheme left out. One strict term rejects; soft terms reject when the
weights of the distinct ones found reach ``threshold``, to which one alone never suffices (``MIN_SOFT`` distinct ones).

The automaton is built once per task from the vocabulary, which is a parameter of the driver's size; URLs are read in
Arrow batches, nothing is shuffled and no other column is read. A null URL has an empty host and path, no hit and is
allowed; a URL without ``://`` has an empty host and path and is searched as a whole. Every row keeps its own verdict, so
repeated ids and ties need no care; an empty table gives no row; further columns of the input are passed on unless they
bear the name of a result, which then replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import let, lower_ascii


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# One of these rejects.
STRICT = ("camgirls", "casino", "escort", "hentai", "keygen", "porn", "porno", "sexcam", "viagra", "warez", "xxx")
# Weights of terms that are harmless alone.
SOFT = {
    "ads": 1, "adult": 2, "bet": 1, "bets": 1, "betting": 2, "bonus": 1, "cam": 1, "cheap": 1, "click": 1, "crack": 2,
    "dating": 1, "download": 1, "drugs": 2, "farm": 1, "free": 1, "gambling": 2, "girls": 1, "hack": 1, "hot": 1, "loan": 1,
    "nude": 2, "payday": 1, "pharmacy": 1, "pills": 1, "poker": 2, "replica": 1, "sex": 2, "slots": 2, "spam": 2,
    "torrent": 1, "track": 1, "tracker": 1, "win": 1, "x": 1,
}
THRESHOLD = 2
MIN_SOFT = 2
WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case; then the path up to ``?`` or ``#``."""
    there = url.isNotNull() & url.contains("://")
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, lower_ascii(host)).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of name and verdict of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains where the path starts with its own. The rules are literals of the
    expression, the longest first; of equally long ones the last by name.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def automaton(strict: Sequence[str], soft: Mapping[str, int]) -> ahocorasick.Automaton:
    """Terms in lower case with (number, length, weight); weight None is strict, which wins over soft."""
    found = ahocorasick.Automaton()
    terms = {t.lower(): w for t, w in soft.items()} | {t.lower(): None for t in strict}
    for number, (term, weight) in enumerate(sorted(terms.items())):
        if not term:
            raise ValueError("an empty term would match everywhere")
        found.add_word(term, (number, len(term), weight))
    if terms:
        found.make_automaton()
    return found


def count_hits(text: str, terms: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Strict hits, distinct soft terms and the sum of their weights in lower-case ``text``."""
    strict, soft = 0, {}
    if len(terms):
        for end, (number, length, weight) in terms.iter(text):
            start = end - length
            if (start >= 0 and text[start] in WORD) or (end + 1 < len(text) and text[end + 1] in WORD):
                continue
            if weight is None:
                strict += 1
            else:
                soft[number] = weight
    return strict, len(soft), sum(soft.values())


def hits(url: Column, strict: Sequence[str] = STRICT, soft: Mapping[str, int] = SOFT) -> Column:
    """Struct n_strict, n_soft (distinct), weight of the terms in ``url``; scheme left out, null counts as empty."""
    strict, soft = tuple(strict), dict(soft)
    upper = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    @F.pandas_udf("n_strict int, n_soft int, weight int")
    def found(urls: pd.Series) -> pd.DataFrame:
        terms = automaton(strict, soft)  # once a batch, which costs less than a batch's search
        scheme = re.compile(r"^.*?://", re.DOTALL)
        counts = [count_hits(scheme.sub("", (u or "").translate(upper), count=1), terms) for u in urls]
        return pd.DataFrame(counts, columns=["n_strict", "n_soft", "weight"])

    return found(url)


def judge(pages: DataFrame, rules: Sequence[Rule] = (), url: str = "url", strict: Sequence[str] = STRICT,
          soft: Mapping[str, int] = SOFT, threshold: int = THRESHOLD, min_soft: int = MIN_SOFT) -> DataFrame:
    """``pages`` with host, path, rule, n_strict, n_soft, weight and verdict (allow or block): the rule's, else the vocabulary's."""
    made = ("host", "path", "rule", "n_strict", "n_soft", "weight", "verdict")
    host, path = host_and_path(pages[url])
    kept = [pages[c] for c in pages.columns if c.lower() not in made]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"), hits(pages[url], strict, soft).alias("_hits"))
    judged = parts.withColumn("_rule", let(F.struct("host", "path"), lambda p: rule_of(p["host"], p["path"], rules)))
    rejected = (F.col("_hits.n_strict") > 0) | (
        (F.col("_hits.n_soft") >= min_soft) & (F.col("_hits.weight") >= threshold))
    return judged.select(
        *[c for c in parts.columns if c != "_hits"], F.col("_rule.rule").alias("rule"), "_hits.n_strict", "_hits.n_soft",
        "_hits.weight", F.coalesce(F.col("_rule.verdict"), F.when(rejected, "block").otherwise("allow")).alias("verdict"))
