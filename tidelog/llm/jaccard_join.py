"""Similarity join on word n-grams by Jaccard, with groups of linked documents.

Documents with equal sets of n-grams form a class; classes are compared. Tokens (64-bit hashes of n-grams) have one
order: rarest first. Two sets can only be similar if they share one of their first tokens (the prefix), so classes are
candidates if they meet in a prefix token's list and pass three filters: length, position of the shared token, and a
suffix filter, which bounds the overlap by counts of tokens in ranges of the hash (sets too large for the counts' type
skip this one). Each candidate pair is verified once,
by intersecting the whole sets.

Which classes need that order at all is told by a part of their tokens, those of the lowest hashes: of these no more may
be in no other class than a similar set may lack. Of the classes that are left all tokens are counted, and those in no
other class come first and are not stored. Both counts are over classes, so copies do not make a token common. The few
tokens with a share of all tokens over 1 / ``COMMON`` meet their counts by broadcast, so that no task gets one of them
whole. Lists are also cut by size of the set: a pair meets only in the same or the next bucket of sizes.

A list shared by many near copies is not expanded into all pairs: in each round a few of its members (four times as many from
round to round; all of them in short lists) are compared with the others that are not yet in the same group, links are
merged into groups, and members that have been compared with all others leave. A list ends when its members are one
group or all have been compared. No link between different groups is lost; pairs within a group need not be verified.

Texts without words, and null texts, have an empty set and are linked with nothing. Rows may share an id or have none:
the component is the smallest id of the linked rows, null if they have none. Repeated rows are one class. An empty table
gives an empty result. Columns other than id and text are carried along by ``keep_one`` and left out by ``components``.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, materialize, pick

N_WORDS = 5
PERCENT = 80
# Lists up to this length are compared whole at once.
SHORT = 16
# Ranges of the suffix filter.
RANGES = 64
# Tokens with more than this part of all, fewer than so many, are joined by broadcast.
COMMON = 1 << 16
# Parts of the tokens that are counted and joined one after the other.
SLICES = 4
# Up to this many candidate classes their ids are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
# Words whose hashes a task keeps.
CACHE = 500_000
_TOP = 1 << 63


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = found
        return found


def tokens(text: str | None, n_words: int, known: dict) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the n-grams of lower-cased words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.int64)
    h = np.array([known[w] for w in found], dtype=np.uint64)
    n = min(n_words, len(h))
    with np.errstate(over="ignore"):
        x = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            x = (x ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.unique(x >> np.uint64(1)).astype(np.int64)


def _ranges(s: np.ndarray) -> np.ndarray | None:
    """Counts by range of the hash; None where one does not fit, which bounds nothing."""
    counts = np.bincount(s >> 57, minlength=RANGES)
    return counts.astype(np.int16) if counts.max() < 1 << 15 else None


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _part(n_words: int, percent: int) -> int:
    """Hashes below this are kept to tell which documents may have a similar one.

    More than a similar set may lack; the shorter the n-grams, the more of them are shared by chance, so the more are kept.
    """
    return min(_TOP - 1, int(_TOP * (1 + 12 / 2 ** n_words) * (100 - percent) / 100))


def _shingle(docs: DataFrame, n_words: int, percent: int, whole: bool) -> DataFrame:
    """(id, n, cls, tokens, ranges): class by hash of the set; all tokens and their ranges, or only the lowest tokens."""
    kind = docs.schema["id"].dataType.simpleString()
    low = _part(n_words, percent)
    if "row_key" not in docs.columns:
        docs = docs.withColumn("row_key", F.lit(0).cast("bigint"))

    def batches(parts):
        known = _Hashes()
        for part in parts:
            sets = [tokens(t, n_words, known) for t in part.column("text").to_pylist()]
            kept = sets if whole else [s[:max(int(np.searchsorted(s, low)), _prefix(len(s), percent))] for s in sets]
            ranges = [_ranges(s) if whole else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("row_key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                          pa.binary()),
                 pa.array(kept, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int16()))],
                names=["id", "row_key", "n", "cls", "tokens", "ranges"])

    return docs.select("id", "text", "row_key").mapInArrow(
        batches, f"id {kind}, row_key bigint, n bigint, cls binary, tokens array<bigint>, ranges array<smallint>")


def _room(percent: int) -> Column:
    """So many tokens of a set may be missing from a similar one."""
    return F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)


def _counted(of: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, df) of the tokens of more than one of the classes."""
    return scratch.put(of.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "counts")


def _met(of: DataFrame, counts: DataFrame) -> DataFrame:
    """(c, h, df): ``of`` (c, h) where h has a count. No more than ``COMMON`` tokens can have such a share of all."""
    total = counts.agg(F.sum("df")).first()[0] or 0
    common = F.broadcast(counts.filter(F.col("df") > total / COMMON))
    others = of.join(common.select("h"), "h", "left_anti").join(counts.filter(F.col("df") <= total / COMMON), "h")
    return of.join(common, "h").select("c", "h", "df").unionByName(others.select("c", "h", "df"))


def _candidates(rows: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(c) of the classes that may have a similar one, judged by their lowest tokens."""
    side = F.broadcast if classes.count() <= BROADCAST_IDS else (lambda df: df)
    first = rows.join(side(classes.select("c")), "c", "left_semi").select("c", "n", "tokens")
    of = first.select("c", F.explode("tokens").alias("h"))
    met = _met(of, _counted(of, scratch)).groupBy("c").agg(F.count("*").alias("met"))
    found = first.select("c", "n", F.size("tokens").alias("kept")).join(met, "c")
    found = scratch.put(found.filter(F.col("kept") - F.col("met") <= _room(percent)).select("c"), "candidates")
    scratch.drop("counts")
    return found


def _index(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(h, c, n, pos, ranges, order, bucket): tokens of the prefix of each class that other classes have too."""
    of = sets.select("c", F.explode("tokens").alias("h"))
    # Written slice by slice before it is grouped, so that only one slice of the tokens is being shuffled at a time.
    parts = []
    for k in range(SLICES):
        part = of.filter(F.pmod("h", F.lit(SLICES)) == k)
        parts.append(scratch.put(_met(part, _counted(part, scratch)), "met"))
        scratch.drop("counts")
    met = reduce(DataFrame.unionByName, parts)
    own = met.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    own = own.join(sets.select("c", "n", "ranges"), "c")
    # Tokens of this class alone come first of all.
    alone = F.col("n") - F.size("shared")
    short = F.slice("shared", 1, F.greatest(F.lit(0), _room(percent) + 1 - alone).cast("int"))
    # Sets of similar size are in one bucket or in two that follow each other.
    step = max(math.log(100 / percent), 0.01) * 1.000001
    return own.select("c", "n", "ranges", alone.alias("alone"), F.posexplode(short).alias("i", "p")).select(
        "p.h", "c", "n", (F.col("alone") + F.col("i")).alias("pos"), "ranges",
        (F.pmod(F.xxhash64("c"), F.lit(1 << 30)) / float(1 << 30)).alias("order"),
        F.floor(F.log("n") / step).cast("int").alias("bucket"))


def _may_be_similar(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filters on two prefix entries of one token.

    Similar sets pass at the first token that they share; nothing before it counts there.
    """
    na, nb, ia, ib = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    # Overlap needed for the union: 100 x >= percent (na + nb - x).
    def enough(most: Column) -> Column:
        return (100 + percent) * most >= percent * (na + nb)

    position = F.least(na - ia, nb - ib)
    both = F.zip_with(F.col(f"{a}.ranges"), F.col(f"{b}.ranges"), lambda s, x: F.least(s, x))
    suffix = F.aggregate(both, F.lit(0), lambda s, x: s + x.cast("int"))
    return length & enough(position) & F.coalesce(enough(suffix), F.lit(True))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left, right = sets.toDF("a", "ta"), sets.toDF("b", "tb")
    both = pairs.join(left, "a").join(right, "b")
    x = F.size(F.array_intersect("ta", "tb"))
    return both.filter(100 * x >= percent * (F.size("ta") + F.size("tb") - x)).select("a", "b")


def merge_groups(groups: DataFrame, links: DataFrame, put=materialize) -> DataFrame:
    """``groups`` (c, comp) after links (a, b): comp is the smallest of the linked ones. ``put`` writes the steps.

    Links become edges between groups; each group takes the smallest label of its neighbours, then the label of that
    label, until nothing changes.
    """
    a, b = groups.toDF("a", "ga"), groups.toDF("b", "gb")
    edges = links.join(a, "a").join(b, "b").filter("ga <> gb").select(
        F.explode(F.array(F.struct("ga", "gb"), F.struct(F.col("gb").alias("ga"), F.col("ga").alias("gb")))).alias("e")
    ).select("e.ga", "e.gb").distinct()
    edges = put(edges, "edges")
    if edges.isEmpty():
        return groups
    labels = put(edges.groupBy("ga").agg(F.min("gb").alias("low")).select(
        F.col("ga").alias("g"), F.least("ga", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels.toDF("gb", "other"), "gb").groupBy("ga").agg(F.min("other").alias("other"))
        new = labels.join(near.withColumnRenamed("ga", "g"), "g").select(
            "g", F.least("label", "other").alias("low"), F.col("label").alias("old"))
        jump = new.select(F.col("g").alias("low"), F.col("low").alias("lower"))
        new = put(new.join(jump, "low").select("g", F.least("low", "lower").alias("label"), "old"), "labels")
        if new.filter("label <> old").isEmpty():
            break
        labels = new.select("g", "label")
    return put(groups.join(labels.toDF("comp", "label"), "comp", "left").select(
        "c", F.coalesce("label", "comp").alias("comp")), "groups")


def _groups(docs: DataFrame, rows: DataFrame, classes: DataFrame, n_words: int, percent: int,
            scratch: Scratch) -> DataFrame:
    """(c, comp) of the classes that are candidates."""
    found = _candidates(rows, classes, percent, scratch)
    scratch.drop("rows")
    # Whole sets of the candidates, made anew from their texts.
    wanted = scratch.put(classes.join(found, "c").select("c", "cls", F.col("id").alias("rep")), "reps")
    side = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda df: df)
    ids = side(wanted.select("rep").distinct())
    texts = docs.join(ids, docs["id"].eqNullSafe(ids["rep"]), "left_semi")
    sets = _shingle(texts, n_words, percent, whole=True).select("cls", "n", "tokens", "ranges")
    sets = sets.join(side(wanted.select("c", "cls")), "cls").dropDuplicates(["c"])
    sets = scratch.put(sets.select("c", "n", "tokens", "ranges"), "sets")
    entries = scratch.put(_index(sets, percent, scratch), "index")
    scratch.drop("met")
    lists = entries.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    entries = scratch.put(entries.join(lists, "h"), "entries")
    scratch.drop("index")
    groups = scratch.put(entries.select("c", F.col("c").alias("comp")).distinct(), "groups")
    sets = sets.select("c", "tokens")
    checked, turn = None, 0
    while True:
        open_ = entries.join(groups, "c")
        lists = open_.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"),
                                       F.min("order").alias("first")).filter("low <> high")
        lead = (F.col("m") <= SHORT) | (F.col("order") <= F.col("first")) | (F.col("order") * F.col("m") < 4 ** turn)
        open_ = scratch.put(open_.join(lists.drop("low", "high"), "h").withColumn("lead", lead).drop("m", "first"),
                            f"open-{turn}")
        scratch.drop(f"open-{turn - 1}" if turn else "entries")
        if open_.isEmpty():
            return groups
        near = F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)]))
        leads = open_.filter("lead").withColumn("near", near).alias("x")
        pairs = leads.join(open_.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("near") == F.col("y.bucket"))).filter(
            (~F.col("y.lead") | (F.col("x.c") < F.col("y.c"))) & (F.col("x.comp") != F.col("y.comp"))
            & _may_be_similar("x", "y", percent)).select(
            F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = scratch.put(pairs, "pairs")
        links = scratch.put(_verified(pairs, sets, percent), "links")
        groups = merge_groups(groups, links, scratch.put)
        checked = pairs if checked is None else checked.unionByName(pairs)
        entries = open_.filter("not lead").drop("comp", "lead")
        turn += 1


def _components(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(id, row_key, n, comp, component): comp numbers the group of rows with words, component is its smallest id."""
    scratch = Scratch(docs.sparkSession, "join")
    rows = _shingle(docs, n_words, percent, whole=False).withColumn("c", F.monotonically_increasing_id())
    rows = scratch.put(rows, "rows")
    names = scratch.put(rows.select("id", "row_key", "n", "cls"), "names")  # outlives the tokens
    # A class goes by the number of its first row.
    classes = scratch.put(rows.filter("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.min("c").alias("c")),
                          "classes")
    groups = _groups(docs, rows.filter("n > 0"), classes, n_words, percent, scratch)
    of_class = classes.select("cls", "c", "id").join(groups, "c", "left").select(
        "cls", "id", F.coalesce("comp", "c").alias("comp"))
    smallest = of_class.groupBy("comp").agg(F.min("id").alias("component"))
    of_class = of_class.select("cls", "comp").join(smallest, "comp")
    found = names.join(of_class, "cls", "left").select(
        "id", "row_key", "n", "comp", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    found = materialize(found, "join-found")
    scratch.close()
    return found


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS,
               percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of each row."""
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    return _components(docs, n_words, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS,
             percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id. Rows without words all stay."""
    key = F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit("")))
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), key.alias("row_key"))
    found = _components(slim, n_words, percent).filter("n > 0")
    # A row's key is its id and text: equal rows share one, and of those that stay only one row may.
    first = found.groupBy("comp").agg(F.min_by("row_key", F.struct(F.col("id").isNull(), "id", "row_key")).alias("stay"))
    drop = found.groupBy("row_key", "comp").agg(F.count("*").alias("copies")).join(first, "comp").select(
        F.col("row_key").alias("__key"), (F.col("row_key") == F.col("stay")).alias("stays"), "copies").filter(
        "not stays or copies > 1")
    drop = materialize(drop, "join-drop")
    side = F.broadcast if drop.count() <= BROADCAST_IDS else (lambda df: df)
    keyed = docs.withColumn("__key", key)
    kept = keyed.join(side(drop.select("__key")), "__key", "left_anti")
    again = keyed.join(side(drop.filter("stays").select("__key")), "__key", "left_semi").dropDuplicates(["__key"])
    return kept.unionByName(again).select(*docs.columns)
