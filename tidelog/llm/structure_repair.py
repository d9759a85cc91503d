"""Cheapest repair of the turn structure of conversations, by Knuth's lightest-derivation agenda.

A conversation should read ``(s?(ua)+)?`` in role initials. Edits keep a row (K), give it another role (R), delete it (D)
or insert an empty one (I); the audit is their initials in order. Weights are (cost, audit) in that order of comparison.

Deductions. An item is a place in the rows with the role that the grammar saw last. A row's edit leads from the item
before it to one behind it and adds its cost and letter; an insertion stays at its place. Both are superior functions: the
result is never lighter than the item it comes from, and a lighter item gives a lighter result (two audits of one item with
equal cost differ in a letter, neither begins the other, since more insertions cost more). So an item popped from the
agenda, lightest first, is final, and work ends when the goal is popped.

Long conversations are cut in blocks of ``BLOCK`` rows. Within a block the agenda finds the lightest derivation from each
role state to each other, which are the hyperedges of a second agenda over the conversation's blocks: an item and a block
together give the next item. Blocks of one conversation are worked on in parallel; per block 16 audits are kept. Ranks and
duplicates come from range partitions and aggregates, and texts pass one running hash, so that no conversation is held as a
whole; its audit alone is one text, as long as the conversation has rows.

Nulls: a null id is a conversation of its own, a null role or text is one space. Turns come in ascending order, null
first, equal turns by role, then digest of the text. A row with a role that is empty or begins with another letter than
s, u, a cannot be kept as it is. Repeated rows are duplicates. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import Scratch, materialize, parted, pick, ranked

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

# What the grammar saw last: nothing, system, user, assistant. Where a role leads from there.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
# Roles that an edit can give.
GIVEN = {"u": "user", "a": "assistant"}
# First fault of a row.
SOUND, BLANK, DUPLICATE, CUT = "-bdt"

Weight = tuple[int, str]


def lightest(start, goals: set, edges: Callable[[object], Iterable[tuple[int, str, object]]]) -> dict:
    """Lightest (cost, audit) of each goal: Knuth's agenda over ``edges`` (cost, letters, item it leads to) of an item."""
    agenda: list[tuple[int, str, object]] = [(0, "", start)]
    final: dict = {}
    left = set(goals)
    while agenda and left:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        left.discard(item)
        for more, letters, then in edges(item):
            if then not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, then))
    return {g: final[g] for g in goals if g in final}


def row_edges(initials: str, faults: str) -> Callable:
    """Edits that lead on from an item (rows done, role seen last)."""

    def edges(item):
        place, state = item
        for role, then in NEXT[state].items():
            if role in GIVEN:
                yield INSERT, "I", (place, then)
        if place == len(faults):
            return
        fault = faults[place]
        yield DELETE, "D", (place + 1, state)
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED if fault == CUT else 0
        for role, then in NEXT[state].items():
            if initials[place] == role:
                yield KEEP + extra, "K", (place + 1, then)
            if role in GIVEN:
                yield REROLE + extra, "R", (place + 1, then)

    return edges


def block_weights(initials: str, faults: str, starts: Iterable[int]) -> list[tuple[int, int, int, str]]:
    """Lightest (from, to, cost, audit) of a block for the role states that it may begin and end in."""
    n, edges = len(faults), row_edges(initials, faults)
    return [(a, b, *w) for a in starts for (_, b), w in lightest((0, a), {(n, b) for b in NEXT}, edges).items()]


def conversation_weight(blocks: list[list[tuple[int, int, int, str]]]) -> Weight:
    """Lightest (cost, audit) of a whole conversation from those of its blocks."""
    goal = (len(blocks) + 1, START)

    def edges(item):
        place, state = item
        if place < len(blocks):
            return [(cost, audit, (place + 1, b)) for a, b, cost, audit in blocks[place] if a == state]
        return [(0, "", goal)] if state in ENDS else []

    return lightest((0, START), {goal}, edges)[goal]


def count_illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows broken on purpose, by crc32 of ``conv_id:turn`` modulo 20; nulls of role, text and key are one space.

    0: gone, 1: text empty, 2: text without ``.!?``, 3: twice, 4: role user.
    """
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % 20
    rows = pick(conversations, "conv_id", "turn", "role", "text").withColumn("_kind", kind).filter(F.col("_kind") != 0)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(known("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``ids`` names conversations that may have no row at all; they come with zeros, an empty audit and the hash of no text.
    Runs jobs before it returns.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_key")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_digest").asc()]
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        key, "turn", role.alias("role"), text.alias("text")).withColumn(
        "_digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    parts = parted(scratch, rows, "_key", order, "parts")
    seen = scratch.put(_faults(ranked(parts.select(
        "_key", "_part", "_tie", "turn", "role", "_digest",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("_blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_cut")), "_key", order)), "seen")
    repaired = scratch.put(_weights(seen), "weights")
    facts = seen.groupBy("_key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.count_if(F.col("_fault") == f).alias(n) for n, f in (
            ("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))])
    named = (conversations if ids is None else ids).groupBy(key).agg(F.max("conv_id").alias("conv_id"))
    none = F.lit(0).cast("long")
    out = named.join(facts, "_key", "left").join(repaired, "_key", "left").join(
        _hashes(parts, repaired, order), "_key", "left").select(
        "conv_id", *[F.coalesce(n, none).alias(n) for n in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
    result = materialize(out, "repaired")
    scratch.close()
    return result


def _faults(rows: DataFrame) -> DataFrame:
    """Ranked rows with the role's initial and the first fault; a duplicate is any but the first of its digest."""
    first = rows.groupBy("_key", "_digest").agg(F.min("_rank").alias("_first"))
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_rank") > F.col("_first"), DUPLICATE).when(
        F.col("_cut"), CUT).otherwise(SOUND)
    initial = F.when(F.col("role") == "", "\0").otherwise(F.substring("role", 1, 1))
    return rows.join(first, ["_key", "_digest"]).select(
        "_key", "_rank", "turn", initial.alias("_initial"), fault.alias("_fault"))


def _weights(seen: DataFrame) -> DataFrame:
    """_key, illegal, cost, audit of each conversation with rows."""
    blocks = seen.groupBy("_key", F.floor((F.col("_rank") - 1) / BLOCK).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_rank", "_initial", "_fault"))).alias("_rows"))
    letters = blocks.select("_key", "_block", *[
        F.array_join(F.col("_rows")[n], "").alias(n) for n in ("_initial", "_fault")])
    solved = letters.select("_key", "_block", "_initial", _solve_blocks("_block", "_initial", "_fault").alias("_solved"))
    whole = solved.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(
        "_block", F.substring("_initial", 1, 1).alias("first"), F.substring("_initial", -1, 1).alias("last"), "_solved"))).alias("_b"))
    return whole.select("_key", _solve_conversation(F.to_json(F.transform("_b", lambda b: F.struct(
        b["first"].alias("first"), b["last"].alias("last"), b["_solved"].alias("solved"))))).alias("_w")).select("_key", "_w.*")


@F.pandas_udf(T.StringType())
def _solve_blocks(block: pd.Series, initials: pd.Series, faults: pd.Series) -> pd.Series:
    """As JSON: inner illegal pairs and the weights of a block; the first block begins at the start only."""
    return pd.Series([json.dumps([count_illegal(i), block_weights(i, f, (START,) if b == 0 else tuple(NEXT))])
                      for b, i, f in zip(block, initials, faults)])


@F.pandas_udf(T.StructType().add("illegal", "long").add("cost", "long").add("audit", "string"))
def _solve_conversation(blocks: pd.Series) -> pd.DataFrame:
    out = []
    for text in blocks:
        parts = json.loads(text)
        solved = [json.loads(p["solved"]) for p in parts]
        borders = sum(count_illegal(a["last"] + b["first"]) for a, b in zip(parts, parts[1:]))
        out.append((borders + sum(n for n, _ in solved), *conversation_weight([w for _, w in solved])))
    return pd.DataFrame(out, columns=["illegal", "cost", "audit"])


def _hashes(parts: DataFrame, repaired: DataFrame, order: list) -> DataFrame:
    """_key and SHA-256 of the repaired text: the audit goes first, then the rows in order, through one running hash."""
    rows = parts.select("_key", "_part", "_tie", "turn", "role", "_digest", "text", F.lit(None).cast("string").alias("audit"))
    audits = repaired.select("_key", "audit").withColumns({
        n: F.lit(None).cast(t) for n, t in rows.dtypes if n not in ("_key", "audit", "_part")}).withColumn("_part", F.lit(-1))
    return rows.unionByName(audits).repartition("_key").sortWithinPartitions(
        "_key", "_part", *order, "_tie").select("_key", "role", "text", "audit").mapInArrow(_hash_rows, "_key string, sha string")


class _Repaired:
    """Running hash of one conversation's repaired lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, START, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def given(self, text: str) -> None:
        """A line with the role that must come next, user unless the last was one."""
        role = "a" if self.state == USER else "u"
        self.line(GIVEN[role], text)
        self.state = NEXT[self.state][role]

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.given("")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text)
            self.state = NEXT[self.state][role[0]]
        elif edit == "R":
            self.given(text)

    def end(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def _hash_rows(batches):
    key, now, out = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["_key", "sha"])

    for batch in batches:
        for k, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if now:
                    out.append((key, now.end()))
                key, now = k, _Repaired(audit)
            else:
                now.row(role, text)
        if len(out) >= 10_000:
            yield rows()
            out = []
    if now:
        out.append((key, now.end()))
    if out:
        yield rows()
