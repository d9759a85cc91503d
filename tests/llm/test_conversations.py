"""Prefix trie, URL filter and structure repair against plain code, on small tables with nulls, ties and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.compare import connect, rows_of
from tidelog.llm import prefix_trie, queries, structure_repair, url_filter
from tidelog.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
ROLES = ["system", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "no", "", " \n", None, "What?", "What?\n", "é!", "x" * 3000 + "."]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = []
    for conv in [*range(40), None, -7, -6]:
        turn = 0
        for _ in range(draw.randint(1, 9)):
            out.append((conv, draw.choice([turn, turn, turn, None, 10**12]), draw.choice(ROLES[:3] if draw.random() < 0.8 else ROLES),
                        draw.choice(TEXTS)))
            turn += draw.choice([0, 1, 1, 1, 2])
    # One conversation many times, and one with many rows, some of them equal.
    for conv in range(100, 130):
        out += [(conv, 0, "user", "Hello?"), (conv, 1, "assistant", "Good."), (conv, 2, "user", "Thanks.")]
    out += [(200, i // 2, ("user", "assistant")[i % 2], f"Line {i % 700}.") for i in range(900)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    extra = [(*r, 1, "k", "p", 2) for r in rows]
    return spark.createDataFrame(
        extra, "conv_id long, turn long, role string, text string, _part int, _key string, audit string, depth int")


def in_order(rows, tie):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    for turns in convs.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, tie(*t[1:])))
    return convs


def brute_trie(rows, group, most):
    def digest(role, text):
        return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()

    convs = {c: [(r or "", t or "") for _, r, t in turns] for c, turns in in_order(rows, digest).items() if c is not None}
    rebuilt = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % most if most else 0
        base = conv - (abs(conv) % group) * (1 if conv >= 0 else -1)
        rebuilt[conv] = convs.get(base, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for conv, turns in rebuilt.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    below = collections.defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = sum(saved[x] for x in below[node]) + (
            (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie(table, rows):
    got = [tuple(r) for r in prefix_trie.trie(table, prefix_trie.share_heads).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_trie(rows, 5, 9)))
    assert any(r[3] >= 30 for r in got if r[1] == 3)


def test_trie_as_it_is_and_long_chains(spark):
    # One chain far deeper than wide, a second that leaves it half way, and a turnless table.
    chain = [(1, i, "user", f"t{i}") for i in range(300)] + [(2, i, "user", f"t{i}" if i < 150 else f"u{i}") for i in range(300)]
    table = spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in prefix_trie.trie(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_trie(chain, 1, 0)))
    assert prefix_trie.trie(table.limit(0), prefix_trie.share_heads).collect() == []


def test_ids_of_a_node_in_several_blocks(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(prefix_trie, "BLOCK_CHARS", 20)
    ids = [(1, 2, i) for i in range(50)] + [(3, 0, 7)]
    batches = [pa.RecordBatch.from_pydict(dict(zip("abc", map(list, zip(*ids[i:i + 9]))))) for i in range(0, len(ids), 9)]
    blocks = list(prefix_trie._join_ids(batches))
    assert sum(b.num_rows for b in blocks) > 5
    out = [r for b in prefix_trie._hash_blocks(blocks) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert out == [(1, 2, hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest()),
                   (3, 0, hashlib.sha256(b"7").hexdigest())]


def test_trie_of_the_query(spark):
    got = queries.op11_prefix_trie(spark, SF)
    want = brute_trie(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect(), 5, 9)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))


GRAMMAR = re.compile("(s?(ua)+)?")


def brute_edits(initials, faults, most_inserts):
    """Cheapest (cost, audit, roles) over all edit sequences with few inserts; roles: initial, or None for a kept row."""
    best = None

    def extend(place, cost, audit, roles, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if place == len(faults) and GRAMMAR.fullmatch("".join(roles)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, tuple(roles))
        if inserts < most_inserts:
            for role in "ua":
                extend(place, cost + 3, audit + "I", roles + [role], inserts + 1)
        if place < len(faults):
            extend(place + 1, cost + 4, audit + "D", roles, inserts)
            if faults[place] not in "bd":
                more = 3 if faults[place] == "t" else 0
                extend(place + 1, cost + more, audit + "K", roles + [initials[place]], inserts)
                for role in "ua":
                    extend(place + 1, cost + more + 3, audit + "R", roles + [role], inserts)

    extend(0, 0, "", [], 0)
    return best[:2]


def test_lightest_edits_against_all_edits():
    draw = random.Random(9)
    for _ in range(150):
        n = draw.randint(0, 4)
        initials = "".join(draw.choice("sua?") for _ in range(n))
        faults = "".join(draw.choice("---bdt") for _ in range(n))
        whole = structure_repair.conversation_weight([structure_repair.block_weights(initials, faults, (structure_repair.START,))])
        assert whole == brute_edits(initials, faults, 3), (initials, faults)


def test_blocks_change_nothing():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.randint(5, 30)
        initials, faults = "".join(draw.choice("suaua") for _ in range(n)), "".join(draw.choice("----bdt") for _ in range(n))
        whole = structure_repair.conversation_weight([structure_repair.block_weights(initials, faults, (structure_repair.START,))])
        cuts = [0, *sorted(draw.sample(range(1, n), 3)), n]
        parts = [structure_repair.block_weights(initials[a:b], faults[a:b], tuple(structure_repair.NEXT))
                 for a, b in itertools.pairwise(cuts)]
        assert structure_repair.conversation_weight(parts) == whole


def brute_repair(rows, damaged):
    out = []
    for conv, turns in in_order(rows, lambda r, t: (r, hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest())).items():
        seen, faults = set(), ""
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\f\r")
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in turns]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}
        best = {"": (0, "", ())}  # by the initial seen last
        for place in range(len(turns) + 1):
            for _ in range(3):  # inserts
                for last, (cost, audit, lines) in list(best.items()):
                    for r in follow[last].replace("s", ""):
                        new = (cost + 3, audit + "I", (*lines, ("user:" if r == "u" else "assistant:")))
                        if r not in best or new[:2] < best[r][:2]:
                            best[r] = new
            if place == len(turns):
                break
            _, role, text = turns[place]
            after = {}
            for last, (cost, audit, lines) in best.items():
                options = [(last, (cost + 4, audit + "D", lines))]
                if faults[place] not in "bd":
                    more = 3 * (faults[place] == "t")
                    for r in follow[last]:
                        if r == initials[place]:
                            options.append((r, (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                        if r != "s":
                            options.append((r, (cost + more + 3, audit + "R", (*lines, f"{'user' if r == 'u' else 'assistant'}:{text}"))))
                for r, new in options:
                    if r not in after or new[:2] < after[r][:2]:
                        after[r] = new
            best = after
        cost, audit, lines = min(best[r] for r in ("", "a") if r in best)
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    there = {r[0] for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    return out + [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in damaged if c not in there]


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_repair(table, rows, monkeypatch, block):
    monkeypatch.setattr(structure_repair, "BLOCK", block)
    damaged = structure_repair.damage(table)
    want = brute_damage(rows)
    assert sorted(repr(tuple(r)) for r in damaged.collect()) == sorted(map(repr, want))
    got = [tuple(r) for r in structure_repair.repair(damaged, table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_repair(want, dict.fromkeys(r[0] for r in rows))))


def test_repair_of_nothing(spark, table):
    assert structure_repair.repair(table.limit(0)).collect() == []
    gone = structure_repair.repair(table.limit(0), table.filter("conv_id = 3")).collect()
    assert [tuple(r) for r in gone] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = brute_repair(brute_damage(rows), dict.fromkeys(r[0] for r in rows))
    got = queries.op13_structure_repair(spark, SF).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


URLS = [
    None, "", "no scheme casino", "://", "http://", "HTTP://WWW.Example.COM/de/x?casino", "https://example.net/en/free-bets",
    "https://example.net.org/fr/", "https://badexample.net/en/", "http://a.example.com/de/", "http://xxx.com", "http://xxxx.com",
    "http://free.com/win", "http://free.com/free/free", "http://poker.com/", "http://adult-x.com", "http://a.com/sex_tape?free=1",
    "http://net", "http://net/", "http://a.org/fr/#porn", "http://b.org/#porn", "http://b.org/éxxxé", "http://x://casino/",
    "http://b.com/porn-porno/PORN", "http://h.com/" + "a/" * 20000 + "viagra",
]


def test_urls(spark):
    table = spark.createDataFrame(
        [(i, u, "h", "v", 3, 1) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, Verdict string, n_soft int, extra int")
    got = url_filter.judge(table, queries.URL_RULES)
    assert set(got.columns) == {"page_id", "url", "extra", "host", "path", "rule", "n_strict", "n_soft", "weight", "verdict"}

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest or "", re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), rest if rest is not None else url or "")
        found = {t: len(re.findall(rf"(?<![0-9a-z])(?={re.escape(t)}(?![0-9a-z]))", text)) for t in (*url_filter.STRICT, *url_filter.SOFT)}
        strict = sum(found[t] for t in url_filter.STRICT)
        soft = [w for t, w in url_filter.SOFT.items() if found[t]]
        bad = strict or (len(soft) >= 2 and sum(soft) >= 2)
        return (host, path, max(fits)[1] if fits else None, strict, len(soft), sum(soft),
                max(fits)[2] if fits else ("block" if bad else "allow"))

    rows = got.select("page_id", "host", "path", "rule", "n_strict", "n_soft", "weight", "verdict").collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {i: plain(u) for i, u in enumerate([*URLS, *URLS])}
    assert url_filter.judge(table.limit(0), queries.URL_RULES).collect() == []
    bare = url_filter.judge(table, strict=(), soft={})
    assert {r.verdict for r in bare.collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.automaton([""], {})


def test_urls_like_sql(spark):
    con = connect("/root/testdata/sf0.01")
    got = queries.op12_url_filter(spark, "/root/testdata/sf0.01")
    result = con.execute(ORACLES["op12_url_filter"])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    assert {r[-1] for r in want[1]} and sum(r[want[0].index("n_soft")] >= 2 for r in want[1]) > 3
