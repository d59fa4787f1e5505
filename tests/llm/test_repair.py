"""Operator 13 against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from funnelkit.llm import repair as R
from funnelkit.llm.repair import repair, repair_conversations, shortened, symbol

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, k string, conv string, audit string, `first` int, h int"
LEGAL = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """All edits of a few ``(kind, fault)`` rows, tried one by one: cost, audit, roles."""
    slots = []
    for kind, fault in rows:
        own = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            own += [(more, "K", kind), (3 + more, "R", "u"), (3 + more, "R", "a")]
        slots += [[(3 * len(x), "I" * len(x), x) for x in ("", "u", "a", "ua", "au")], own]
    slots.append(slots[0] if slots else [(0, "", "")])
    return min((sum(c for c, _, _ in way), "".join(a for _, a, _ in way)) for way in itertools.product(*slots)
               if LEGAL.fullmatch("".join(x for _, _, x in way)))


def test_agenda_finds_the_cheapest_edits():
    rnd = random.Random(1)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3):
        rows = [(rnd.choice("ssuuaax"), rnd.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]
        assert repair("".join(symbol(*r) for r in rows)) == cheapest(rows)


def table(rows):
    """The same by a table over rows and states, filled row by row."""
    best = {"": (0, "")}

    def grown(items):
        for _ in range(3):
            for state, (cost, audit) in list(items.items()):
                for c in "ua":
                    if (state, c) in R.NEXT:
                        after, one = R.NEXT[state, c], (cost + 3, audit + "I")
                        items[after] = min(items.get(after, one), one)
        return items
    best = grown(best)
    for kind, fault in rows:
        out = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways += [(R.NEXT[state, kind], cost + more, "K")] if (state, kind) in R.NEXT else []
                ways += [(R.NEXT[state, c], cost + more + 3, "R") for c in "ua" if (state, c) in R.NEXT]
            for after, total, letter in ways:
                out[after] = min(out.get(after, (total, audit + letter)), (total, audit + letter))
        best = grown(out)
    return min(best[s] for s in ("", "a") if s in best)


@pytest.mark.parametrize("kinds", ["suax", "uuuua", "xu", "aaas", "x"])
def test_windows_change_nothing(kinds):
    rnd = random.Random(len(kinds))
    for n in (1, 2, 7, 30, 200):
        rows = [(rnd.choice(kinds), rnd.choice(["", "", "", "", "duplicate", "truncated"])) for _ in range(n)]
        letters = "".join(symbol(*r) for r in rows)
        want = table(rows)
        for window in (1, 2, 5, 64, 256):
            assert repair(letters, window) == want
    rows = [(c, "") for c in "xu" * 3000]                       # long, with ties all along
    assert repair("".join(symbol(*r) for r in rows)) == table(rows)


def test_shortened_audits_compare_alike():
    audits = {"": "KDDDDD", "s": "KDRKKKKKKKKK", "u": "KDRKKKKKKKKD", "a": "KDRKKKKKKKKDI"}
    short = shortened(audits)
    assert max(map(len, short.values())) <= 4
    for p, q in itertools.permutations(audits, 2):
        for x, y in itertools.product(("", "D", "I", "K", "IK", "ID"), repeat=2):
            assert (audits[p] + x < audits[q] + y) == (short[p] + x < short[q] + y)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, kind = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    found = []
    after = damage(rows)
    import xxhash
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), signed(xxhash.xxh64_intdigest(r[3].encode(), 42))))
        seen, kinds = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            kinds.append((role[0] if role[:1] in list("sua") else "x", fault))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit = table(kinds) if kinds else (0, "")
        lines, at, last = [], 0, ""
        for edit in audit:
            role, text = own[at][2:] if edit != "I" else (None, "")
            if edit in "RI":
                role = "assistant" if last == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
            at += edit != "I"
        faults = [f for _, f in kinds]
        found.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
                      sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(kinds)), cost, audit,
                      hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], SCHEMA)


def odd(seed=3):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "a.", "b!", "c", "d? \n", "e\xa0", "é.", "x\ny.", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", None, "", "User", "ua", "tool", "s"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rnd.randrange(0, 14)):
            rows.append((conv, rnd.choice([None, *range(12)]), rnd.choice(roles + ["user", "assistant"] * 4), rnd.choice(texts)))
    rows += rows[5:30]
    rows += [(70, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(20)]       # clean
    rows += [(71, 5, "user", "same.")] * 40 + [(72, -(1 << 40), "user", "a."), (72, 1 << 40, "assistant", "b.")]
    return rows


def test_equals_brute_force(spark):
    for rows in (odd(), [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]):
        got = repair_conversations(frame(spark, rows))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(1, t // 2, rnd.choice(["user", "assistant"]), rnd.choice(["all the same.", f"own {t}.", f"cut {t}"])) for t in range(900)]
    rows += [(c, 0, "user", "all the same.") for c in range(2, 200)]
    monkeypatch.setattr(R, "PIECE", 50)
    assert sorted(map(tuple, repair_conversations(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_nothing(spark):
    assert repair_conversations(frame(spark, []).limit(0)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair_conversations(frame(spark, [(dropped, 0, "user", "a.")])).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
