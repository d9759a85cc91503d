"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds a ratio of counts (mean word length, symbols, exclamation marks, stop words, repeated lines). The
counts and the verdict are columns of a single projection over the rows; there is no shuffle and no user function.

Nulls and empty texts have no words and fail. Very long texts cost n log n in their words (one sort of the 3-word
windows). Repeated rows are judged alike, an empty table stays empty, and further columns are carried along by
``keep`` and left out by ``measure``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BLANKS, let, pick, words

SYMBOLS = "#*$%&|<>"

# Fixed value: common function words of English, German, French and Spanish, lower case.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "das dem den der des die ein eine für ist mit nicht sich und von zu "
    "ce dans de du en est et la le les pas pour que sur un une "
    "con del el las lo los no para por se y"
).split()


class Rule(NamedTuple):
    """``low <= top / bottom <= high``; a missing bound does not limit."""

    name: str
    top: str
    bottom: str
    low: float | None
    high: float | None


# Ratios of typical prose stay far inside; pipes, ornaments, shouting and repeated lines do not.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("exclamations", "n_bangs", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)


# Places fit into the low bits of a sort key up to this many words; longer texts sort (window, place) pairs.
_PLACE_BITS = 20


def _count_chars(text: Column, chars: str) -> Column:
    bare = text
    for c in chars:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.length(text) - F.length(bare)


def _repeated(windows: Column) -> Column:
    """Places, ascending, of those {g: window, i: place} whose window occurs twice or more."""

    def neighbours(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["g"] == F.get(s, k + 1)["g"]) | (x["g"] == F.get(s, k - 1)["g"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    return let(F.sort_array(windows), neighbours)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in ``w``.

    Hashes of the windows, with the places in their low bits, are sorted as plain numbers; equal neighbours are the
    candidates, and only these are compared as text. Each repeated window adds the words up to the next one, three at
    most.
    """
    places = F.sequence(F.lit(0), F.size(w) - 3)

    def texts(at: Column) -> Column:
        return F.transform(at, lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))

    mask = (1 << _PLACE_BITS) - 1
    keys = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
                       .bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))

    def likely(s: Column) -> Column:
        high = lambda x: F.shiftright(x, _PLACE_BITS)
        again = F.filter(s, lambda x, k: (high(x) == high(F.get(s, k + 1))) | (high(x) == high(F.get(s, k - 1))))
        return F.transform(again, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    short = F.size(w) <= mask
    again = F.when(short, _repeated(texts(let(F.sort_array(keys), likely)))).otherwise(_repeated(texts(places)))
    return F.when(F.size(w) < 4, 0).otherwise(let(again, covered))


def with_counts(df: DataFrame, text_col: str = "text", prefix: str = "__q_") -> DataFrame:
    """``df`` and the counts of its texts, each under its name with ``prefix``; a null counts as empty."""
    text, w, lines = prefix + "text", prefix + "w", prefix + "lines"
    # Arrays are columns of a projection of their own, so that each is made once for all counts.
    df = df.withColumn(text, F.coalesce(df[text_col], F.lit("")))
    df = df.withColumns({w: words(F.col(text)), lines: F.filter(
        F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": _count_chars(F.col(text), SYMBOLS),
        "n_bangs": _count_chars(F.col(text), "!"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": let(F.col(w), _repeat_words),
    }
    return df.withColumns({prefix + n: c.cast("long") for n, c in found.items()}).drop(text, w, lines)


def passes(rules=RULES, prefix: str = "__q_") -> Column:
    """The threshold table as one condition on the count columns."""
    verdict = F.lit(True)
    for r in rules:
        top, bottom = F.col(prefix + r.top), F.col(prefix + r.bottom)
        if r.low is not None:
            verdict = verdict & (top >= r.low * bottom)
        if r.high is not None:
            verdict = verdict & (top <= r.high * bottom)
    return verdict


def base_failed(prefix: str = "__q_") -> Column:
    """Fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Id, counts, ``base_failed`` and ``kept`` (not base_failed and every rule holds) of each row."""
    counted = with_counts(pick(df, id_col, text_col), text_col, "").drop(text_col)
    return counted.withColumn("base_failed", base_failed("")).withColumn(
        "kept", ~F.col("base_failed") & passes(rules, ""))


def keep(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df``, with its columns, that ``measure`` keeps."""
    return with_counts(df, text_col).filter(~base_failed() & passes(rules)).select(*df.columns)
