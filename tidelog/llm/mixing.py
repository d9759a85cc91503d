"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its weight's share of all words, at most ``max_copies`` times what it has,
the excess shared again by weight. A document is certain of ``floor(target / source_size)`` whole copies. For the
rest of the target a document has the inclusion probability p = min(1, scale * m), where m = 1 + ln(1 + size) and scale
is such that the expected words, sum of p * size, are the rest; documents that reach 1 are certain, and the others share
what these leave. Documents are ranked by (U / (1 - U)) / (p / (1 - p)), U a uniform hash of the document, and the lowest
ranks are taken until their words come nearest to the rest: the size of the sample is fixed in words.

The scale of a source comes from its words by length of document, a table of one row per distinct length.

The place of the cut in the ranking is found in sums per bucket of the rank, refined twice; no source is ever ordered
whole, so one that holds a third of all rows is no harder than the others. The table of sources has one row per source
and is the only thing a single task sees whole.

Nulls: a null source is a source of its own, ordered last; a null text has no words and is taken zero times in words.
Rows equal in id and text share one rank and are taken together. An empty table gives an empty result. Reruns agree,
since U depends on seed, id and text only. Columns other than id, text and source play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, pick, words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = "mix-1"
# Buckets of the rank at each of two levels.
BUCKETS = 4096
# Up to this many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``, ``whole`` and ``rest`` of each source.

    In order of cap per weight the sources at their cap come first, and the level of the others is the largest of
    (words left / weight left) over all splits of that order.
    """
    alone = W.partitionBy()
    place = (F.row_number().over(alone.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    by_cap = alone.orderBy(F.col("cap") / F.col("weight"), "source")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    out = (sizes.withColumn("weight", weight).withColumn("cap", max_copies * F.col("source_size").cast("double"))
           .withColumn("level", (F.sum("source_size").over(alone) - before) / from_here)
           .withColumn("level", F.max("level").over(alone))
           .withColumn("target", F.least("cap", F.col("level") * F.col("weight"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return out.withColumn("whole", whole.cast("long")).select(
        "source", "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def scales(lengths: DataFrame, plan: DataFrame) -> DataFrame:
    """(skey, scale) of inclusion probabilities, from (skey, size, n) and the ``rest`` of each source.

    With the longest documents certain, down to some length, the others need the scale (rest - words of the certain) /
    (sum of m * size of the others); no such split needs more than the right one, so the scale is the largest of them.
    """
    order = W.partitionBy("skey").orderBy(F.col("size").desc())
    certain = F.coalesce(F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(_measure(F.col("size")) * F.col("size") * F.col("n")).over(order.rowsBetween(0, W.unboundedFollowing))
    split = lengths.filter(F.col("size") > 0).join(plan.select("skey", "rest"), "skey").withColumn(
        "scale", (F.col("rest") - certain) / others)
    return split.groupBy("skey").agg(F.max("scale").alias("scale"))


def _measure(size: Column) -> Column:
    return 1 + F.log(1.0 + size)


def _rank(u: Column, size: Column, scale: Column) -> Column:
    """Random odds divided by the odds of inclusion, mapped to 0 (certain) up to 1 (never)."""
    p = F.least(F.lit(1.0), scale * _measure(size))
    q = (u / (1 - u)) * (1 - p) / p
    return F.when(p > 0, q / (1 + q)).otherwise(F.lit(1.0))


def _crossing(sums: DataFrame, key: str) -> DataFrame:
    """Of each source, the first ``key`` at which the words reach ``rest``; ``rest`` becomes what is left before it."""
    order = W.partitionBy("skey").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    reached = sums.withColumn("sum", F.sum("words").over(order)).filter(F.col("sum") >= F.col("rest"))
    first = F.row_number().over(W.partitionBy("skey").orderBy(key)) == 1
    return reached.withColumn("first", first).filter("first").select(
        "skey", key, "words", (F.col("rest") - (F.col("sum") - F.col("words"))).alias("rest"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    """Of each row: its ``size``, uniform ``u``, and a source key ``skey`` that is never null."""
    doc_id, text, source = docs[id_col], docs[text_col], docs[source_col]
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")),
                               F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    skey = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))
    return [F.size(words(text)).cast("long").alias("size"), u.alias("u"), skey.alias("skey")]


def _decide(sized: DataFrame, weights, max_copies: int) -> DataFrame:
    """Per source: skey, source_size, target, whole, rest, scale, cut, with_cut; a row for each source."""
    lengths = materialize(sized.groupBy("skey", "size").agg(F.count("*").alias("n")), "mix-lengths")
    by_key = lengths.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    source = F.when(F.col("skey") != "n", F.substr("skey", F.lit(2)))
    plan = targets(by_key.select(source.alias("source"), "source_size"), weights, max_copies)
    plan = materialize(plan.withColumn(
        "skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).drop("source"),
        "mix-plan")
    plan = materialize(plan.join(scales(lengths, plan), "skey", "left").withColumn(
        "scale", F.coalesce("scale", F.lit(0.0))), "mix-scale")
    side = _side(plan)
    ranked = sized.join(side(plan.select("skey", "rest", "scale")), "skey").withColumn(
        "v", _rank(F.col("u"), F.col("size"), F.col("scale")))
    # Bucket numbers of the rank at both levels.
    b1 = F.floor(F.col("v") * BUCKETS)
    b2 = F.floor(F.col("v") * BUCKETS * BUCKETS) - b1 * BUCKETS
    ranked = ranked.select("skey", "size", "v", "rest", b1.alias("b1"), b2.alias("b2"))
    sums = ranked.groupBy("skey", "b1", "rest").agg(F.sum("size").alias("words"))
    cut1 = materialize(_crossing(sums, "b1"), "mix-cut")
    ranked = ranked.drop("rest")
    inside = ranked.join(side(cut1.select("skey", "b1", "rest")), ["skey", "b1"])
    cut2 = _crossing(inside.groupBy("skey", "b1", "b2", "rest").agg(F.sum("size").alias("words")), "b2")
    cut2 = materialize(cut2.join(cut1.select("skey", "b1"), "skey"), "mix-cut")
    inside = ranked.join(side(cut2.select("skey", "b1", "b2", "rest")), ["skey", "b1", "b2"])
    cut3 = _crossing(inside.groupBy("skey", "v", "rest").agg(F.sum("size").alias("words")), "v")
    # The row at the cut is taken if that comes nearer to the target.
    cut = cut3.select("skey", F.col("v").alias("cut"), (F.col("words") - F.col("rest") <= F.col("rest")).alias("with_cut"))
    return materialize(plan.join(cut, "skey", "left"), "mix-plan")


def _side(plan: DataFrame):
    return F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda df: df)


def _copies() -> Column:
    v = _rank(F.col("u"), F.col("size"), F.col("scale"))
    more = F.when(F.col("cut").isNull(), F.col("rest") > 0).otherwise(
        (v < F.col("cut")) | ((v == F.col("cut")) & F.col("with_cut")))
    return F.col("whole") + more.cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each row."""
    docs = pick(docs, id_col, text_col, source_col)
    sized = materialize(docs.select(
        docs[id_col].alias("id"), docs[source_col].alias("source"), *_drawn(docs, id_col, text_col, source_col, seed)),
        "mix-sizes")
    plan = _decide(sized, weights, max_copies)
    taken = sized.join(_side(plan)(plan), "skey").withColumn("copies", _copies())
    return taken.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                        "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, with its columns, each as often as the mix takes it."""
    drawn = _drawn(docs, id_col, text_col, source_col, seed)
    plan = _decide(materialize(docs.select(*drawn), "mix-sizes"), weights, max_copies)
    # The documents' columns stay within one, so that none clashes with a column of the plan.
    out = docs.select(F.struct("*").alias("row"), *drawn).join(_side(plan)(plan), "skey").withColumn(
        "copies", _copies().cast("int")).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
