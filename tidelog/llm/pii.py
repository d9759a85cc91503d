"""Personal data: base patterns, and bootstrapped contexts that find identifiers the base patterns miss.

The base patterns give spans of four kinds. They are the seeds. Every token with a digit or @ is a candidate, and so are
short groups of digits with single blanks between, as one. A candidate has two lexical patterns: the last word before
it that belongs to no candidate, with the candidate's shape (letters and digits collapsed); and, for words too rare to
tell, the shape of that word with the candidate's shape and numbers of digits. Patterns and candidates form a graph,
scored in rounds: a pattern's confidence in a kind is the share of its distinct candidates believed to be of the kind,
once it has enough of them; for a pattern, a candidate that is no seed is believed as far as its other confident patterns,
taken together, say, so that no pattern confirms itself. After the last round, candidates of highly confident patterns
become spans of the kind.

All of it is built-in functions: spans are found by cutting the text at its matches and summing lengths, the rounds are
joins and sums over the graph's edges, written to scratch after each round.

Nulls and empty texts have no spans. Texts of any length are read whole; patterns are possessive or anchored so that
long runs cost linear time. Rows equal in id and text get the same spans. An empty table gives an empty result. Columns
other than id and text are carried along by ``redact`` and left out by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, let, materialize, pick

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Where a match may only begin at the start of a run, or right after the match before, this is said
# by a look-behind, which spares trying each place of a long run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Short groups of digits, up to eight of them, or else a token with a digit or @.
_GROUP = r"\(?[0-9]{1,8}+\)?(?:-[0-9]{1,8}+)*+"
CANDIDATE = (r"(?<![^\x20\x09-\x0D])(?:\+?" + _GROUP + r"(?:\x20" + _GROUP + r"){1,7}+"
             r"""(?![^\x20\x09-\x0D"')\]>}.,;:!?])[^\x20\x09-\x0D]*+"""
             r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)")
LAST_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++(?=[\x20\x09-\x0D]*+$)"
EDGE = r"""["'()\[\]<>{}.,;:!?]"""

ROUNDS = 3
# Sum of beliefs a pattern needs, confidence that counts in a round, and confidence that makes spans.
SUPPORT = 3.0
CONFIDENT = 0.7
CERTAIN = 0.8
_SPAN = "struct<start:int,stop:int,value:string,word:string>"


def _matches(text: Column, pattern: str, words: bool = False) -> Column:
    """Array of {start, stop, value, word} of all matches, in code points; ``word``: the last one before, outside matches."""

    def place(found: Column, between: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("word"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            begin = s["at"] + F.length(between[i])
            stop = begin + F.length(found[i])
            fresh = F.regexp_extract(between[i], LAST_WORD, 0)
            word = F.when(fresh != "", fresh).otherwise(s["word"]) if words else F.lit("")
            span = F.struct(begin.alias("start"), stop.alias("stop"), found[i].alias("value"), word.alias("word"))
            return F.struct(stop.alias("at"), word.alias("word"), F.concat(s["out"], F.array(span)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return let(found, lambda f: F.when(F.size(f) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(
        let(F.split(text, pattern, -1), lambda b: place(f, b))))


def _luhn(digits: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        d = F.when(s["odd"], c.cast("int")).otherwise(c.cast("int") * 2)
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~s["odd"]).alias("odd"))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), zero, step, lambda s: s["sum"] % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (
            F.when(part(p) == "", 0).otherwise(F.substring(part(p), 1, 3).cast("int")) <= 255))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of {kind, start, stop}: kinds in order, then by start."""
    found = []
    for kind in KINDS:
        spans = F.transform(
            F.filter(_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])),
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
        likely = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        found.append(F.when(likely, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,stop:int>>")))
    return F.concat(*found)


def _candidates(text: Column) -> Column:
    """Array of {start, stop, instance, patterns} of candidates, stripped of punctuation at the edges."""

    def trimmed(m: Column) -> Column:
        bare = F.regexp_replace(m["value"], f"^{EDGE}++", "")
        start = m["start"] + F.length(m["value"]) - F.length(bare)
        core = F.regexp_replace(bare, f"{EDGE}++$", "")
        letters = lambda c: F.regexp_replace(c, r"[\p{L}\p{M}]+", "a")
        close = letters(F.regexp_replace(core, "[0-9]", "9"))
        wide = letters(F.regexp_replace(core, "[0-9]+", "9"))
        return F.struct(start.alias("start"), (start + F.length(core)).alias("stop"), core.alias("instance"), F.array(
            F.concat_ws(" ", F.lit("word"), F.lower(m["word"]), wide),
            F.concat_ws(" ", F.lit("kind of word"), letters(F.regexp_replace(m["word"], "[0-9]+", "9")), close),
        ).alias("patterns"))

    return F.filter(F.transform(_matches(text, CANDIDATE, words=True), trimmed), lambda c: c["instance"] != "")


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, base, open): base spans, and candidates with their seed kind where a span begins in them."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], text).alias("row_key"),
                       base_spans(text).alias("base"), _candidates(text).alias("open"))

    def seed(c: Column, b: Column) -> Column:
        return (b["start"] >= c["start"]) & (b["start"] < c["stop"])

    kinds = F.transform("open", lambda c: F.struct(
        c["start"].alias("start"), c["stop"].alias("stop"), c["instance"].alias("instance"),
        c["patterns"].alias("patterns"), F.get(F.filter("base", lambda b: seed(c, b)), F.lit(0))["kind"].alias("kind")))
    # What lies within a span but does not begin it is neither seed nor candidate.
    free = F.filter(kinds, lambda c: c["kind"].isNotNull() | ~F.exists(
        "base", lambda b: (b["start"] < c["stop"]) & (b["stop"] > c["start"])))
    return rows.select("id", "row_key", "base", free.alias("open"))


def learn(scanned: DataFrame, rounds: int = ROUNDS, put=materialize) -> DataFrame:
    """(pattern, best) of highly confident patterns, best: {confidence, kind}. ``put`` writes the steps."""
    edges = put(scanned.select(F.explode("open").alias("c")).select(
        F.explode("c.patterns").alias("pattern"), "c.instance", "c.kind").groupBy("pattern", "instance").agg(
        F.max("kind").alias("seed")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    open_edges = edges.filter("seed is null").select("pattern", "instance")
    believed = seeds = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(
        F.count("*").cast("double").alias("sum"))
    for turn in range(rounds):
        patterns = put(believed.filter(F.col("sum") >= SUPPORT).join(sizes, "pattern").select(
            "pattern", "kind", (F.col("sum") / F.col("n")).alias("confidence")).filter(
            F.col("confidence") >= CONFIDENT), "pii-patterns")
        if turn + 1 < rounds:
            # A candidate is believed as 1 - product of the doubts of its patterns, of all but the one that asks.
            doubts = patterns.select("pattern", "kind", F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))).alias("doubt"))
            told = open_edges.join(doubts, "pattern").groupBy("instance", "kind").agg(F.sum("doubt").alias("all"))
            others = open_edges.join(told, "instance").join(doubts, ["pattern", "kind"], "left").groupBy(
                "pattern", "kind").agg(F.sum(1 - F.exp(F.col("all") - F.coalesce("doubt", F.lit(0.0)))).alias("sum"))
            believed = seeds.unionByName(others).groupBy("pattern", "kind").agg(F.sum("sum").alias("sum"))
    return patterns.filter(F.col("confidence") >= CERTAIN).groupBy("pattern").agg(
        F.max(F.struct("confidence", "kind")).alias("best"))


def _found(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(row_key, more): spans of candidates that no base pattern covers, each of the kind its best pattern says."""
    loose = scanned.select("row_key", F.explode(F.filter("open", lambda c: c["kind"].isNull())).alias("c"))
    hits = loose.select("row_key", "c.start", "c.stop", F.explode("c.patterns").alias("pattern")).join(patterns, "pattern")
    spans = hits.groupBy("row_key", "start", "stop").agg(F.max("best").alias("best"))
    return spans.groupBy("row_key").agg(F.collect_set(F.struct("best.kind", "start", "stop")).alias("more"))


def _ordered(spans: Column) -> Column:
    """Kinds in their order, then by start."""
    return F.flatten(F.array(*[F.array_sort(_of(spans, kind)) for kind in KINDS]))


def _of(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, base, spans): arrays of {kind, start, stop} of the base patterns, and of these and the learned ones."""
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.put(_scan(pick(docs, id_col, text_col), id_col, text_col), "pii-scan")
    more = _found(scanned, learn(scanned, rounds, scratch.put))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    found = materialize(scanned.select("id", "row_key", "base").join(more, "row_key", "left").select(
        F.col("id").alias(id_col), "base", _ordered(F.concat("base", F.coalesce("more", none))).alias("spans")),
        "pii-found")
    scratch.close()
    return found


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, hash of the base spans, and all spans as text."""
    counts = [F.size(_of(F.col("base"), kind)).cast("long").alias(f"n_{kind}")
              for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
                        _text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in brackets; texts without spans stay as they are.

    Spans that overlap are replaced together, by the kind of the first.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.put(_scan(pick(docs, id_col, text_col), id_col, text_col), "pii-scan")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    more = _found(scanned, learn(scanned, rounds, scratch.put))
    spans = scanned.select("row_key", "base").distinct().join(more, "row_key", "left").select(
        "row_key", F.concat("base", F.coalesce("more", none)).alias("spans")).filter(F.size("spans") > 0)
    spans = materialize(spans, "pii-spans")
    scratch.close()
    # The documents' columns stay within one, so that none clashes with a column of the spans.
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
                        F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit(""))).alias("row_key"))
    text, whole = F.col("text"), F.col("row").getField(text_col)
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.array(
            F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), x["kind"], F.lit("]"))))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"),
                        F.when(x["start"] < s["at"], s["out"]).otherwise(fresh).alias("out"))

    def end(s: Column) -> Column:
        return F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))

    clean = F.when(F.col("spans").isNull(), whole).otherwise(F.aggregate(by_place, start, step, end))
    out = keyed.join(spans, "row_key", "left").select("row", clean.alias("clean"))
    return out.select(*[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
