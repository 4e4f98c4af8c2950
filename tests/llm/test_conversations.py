import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillwright.llm import conversation_repair as cr
from tillwright.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\f\r"


def table() -> list[tuple]:
    """Hot first turns, copies, families of 20, nulls everywhere, ties, repeated rows, a long text, a long conversation."""
    rng, out = random.Random(5), []
    for c in [*range(0, 64), 80, 81, 99, -7, -20, 1000, 1001]:
        n = rng.choice([1, 2, 3, 5, 8])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "user", "assistant", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            text = rng.choice(["Hello there.", "Fine", "What is it?", "", " \t", None, "Same words here!", f"own {c} {t}."])
            out.append((c, t if rng.random() < 0.9 else rng.choice([None, t + 3, 0]), role, text))
    out += [(50, 1, "user", "tie."), (50, 1, "user", "tie."), (50, 1, "assistant", "tie."), (61, None, None, None), (62, None, "user", "x")]
    out += [(None, 0, "user", "Hello there."), (None, None, "assistant", "no id"), (200, 0, "user", "w " * 30000 + "end.")]
    out += [(300, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)] + [(301, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(650)]
    return out


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("k", "lost", "same", "depth", "digest", "owner", "t", "own", "h", "words", "last", "node", "n"):
            df = df.withColumn(c, F.lit("clash"))
    return df


# ---- repair -----------------------------------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(turns: list[tuple]) -> tuple[int, str]:
    """All edits of a short conversation with up to two insertions at each place. Turn: (role, must_go, cut)."""
    fills = ["", "u", "a", "ua", "au"]
    best = None
    choices = [["D"] if gone else ["D", "K", "Ru", "Ra"] for _, gone, _ in turns]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(fills, repeat=len(turns) + 1):
            cost, audit, seen, legal = 3 * sum(map(len, gaps)), "I" * len(gaps[0]), gaps[0], True
            for (role, _, cut), e, gap in zip(turns, edits, gaps[1:]):
                audit += e[0] + "I" * len(gap)
                if e == "D":
                    cost += 4
                else:
                    legal = legal and (e != "K" or role != "")
                    cost += (3 if cut else 0) + (0 if e == "K" else 3)
                    seen += role[:1] if e == "K" else e[1]
                seen += gap
            if legal and GRAMMAR.fullmatch(seen) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_pass_against_all_edits(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
    r = cr.Repair()
    for role, gone, cut in turns:
        r.turn(role, "x", gone, cut)
    assert r.result()[:2] == cheapest(turns)


def test_long_conversations_are_settled(monkeypatch):
    rng = random.Random(2)
    turns = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.random() < 0.1, rng.random() < 0.2) for i in range(5000)]

    def run(settle):
        monkeypatch.setattr(cr, "SETTLE", settle)
        r = cr.Repair()
        for t in turns:
            r.turn(*t)
        return r, r.result()

    a, got = run(16)
    b, want = run(10**9)
    assert got == want and max(len(h[1]) for h in a.layer if h) < 200 and len(want[1].replace("I", "")) == 5000


def plain_damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[c] += []
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def test_repair_of_a_table(spark):
    rows = table()
    got = {r.conv_id: r for r in cr.repair(cr.damage(frame(spark, rows, True).repartition(5)), with_turns=True).collect()}
    want = plain_damage(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        r, seen, n, flagged = got[c], set(), Counter(), []
        for _, role, text in turns:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            flagged.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {t for t, *_ in turns if t is not None}
        assert (r.blank, r.duplicate, r.truncated) == (n["blank"], n["duplicate"], n["truncated"])
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(flagged, flagged[1:]))
        if len(flagged) <= 3:
            assert (r.cost, r.audit) == cheapest(flagged)
        # the audit, applied to the turns, gives what is returned, in order and at that cost
        at, state, cost, kept = 0, cr.START, 0, []
        for letter in r.audit:
            role, text = ("", "") if letter == "I" else turns[at][1:]
            cut = letter != "I" and flagged[at][2]
            at += letter != "I"
            if letter == "D":
                cost += 4
                continue
            role = role if letter == "K" else cr.OTHER[state][0]
            state = cr.NEXT[role[:1], state]
            cost += {"K": 0, "R": 3, "I": 3}[letter] + 3 * cut
            kept.append((role, text))
        assert at == len(turns) and cost == r.cost and state in (cr.START, cr.ASSISTANT) and [tuple(x) for x in r.turns] == kept
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
    assert cr.repair(cr.damage(frame(spark, []))).count() == 0
    plain = cr.repair(frame(spark, [(1, 0, "user", "Hi."), (1, 1, None, None)])).collect()[0]
    assert (plain.cost, plain.audit, plain.blank) == (7, "KDI", 1)
    assert cr.repair(frame(spark, [(7, 3, "user", "x")]).withColumn("lost", F.lit(True))).collect()[0][:9] == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


# ---- trie -------------------------------------------------------------------------------------------


def plain_trie(rows) -> list[tuple]:
    convs = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role or "", text or ""
        mark = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()
        convs[c].append((t is not None, t or 0, mark, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own if c is None else convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    name = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        value = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += not children[p]
    ends = {p: ",".join(str(c) for c in sorted(c for c in m if c is not None and len(rebuilt[c]) == len(p))) for p, m in members.items()}
    return [(name[p], len(p), name[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()]


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("block", [4096, 4])
def test_trie_against_a_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK", block)  # several blocks for a node
    hot = [(c, t, "user" if t % 2 == 0 else "assistant", f"common {t}") for c in range(400, 520) for t in range(2 + c % 3)]
    rows = [r for r in table() if r[0] not in (300, 301)] + hot + [(300, t, "user", f"turn {t}.") for t in range(60)] + [(301, t, "user", f"turn {t}.") for t in range(50)]
    got = pt.trie(frame(spark, rows, True).repartition(3))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == sorted(plain_trie(rows), key=repr)


def test_trie_of_one_and_of_none(spark):
    assert pt.trie(frame(spark, [])).count() == 0
    for rows in ([(None, None, None, None)], [(4, 0, None, "a b"), (4, 0, None, "a b")]):
        got = pt.trie(frame(spark, rows)).collect()
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(plain_trie(rows), key=repr)


def test_rows_of_subtree_sums_grow_with_the_turns(spark):
    """A chain of prefixes of each other: one row per change of owner, where nodes by ancestors would be the square."""
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(1, 13) for t in range(10 * c)]
    got = {(r.conv_id, r.depth): r for r in pt.trie(frame(spark, rows)).collect()}
    assert len(got) == 121 and got[20, 0].n_leaves == 1 and got[240, 120].n_convs == 1
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.values() if r.depth) == sorted(x for x in plain_trie(rows) if x[1])
