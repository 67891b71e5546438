import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from corpusloom.llm import dialogues
from corpusloom.llm.queries import damaged

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Least (cost, audit) by trying edits from the front, cheapest first; rows are (role, text, fault)."""
    waiting, done = [(0, "", 0, "", ())], set()
    while waiting:
        cost, audit, i, initials, kept = heapq.heappop(waiting)
        if (i, initials) in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add((i, initials))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, kept
        if len(initials) < len(rows) + 4:
            for name in ("user", "assistant"):
                heapq.heappush(waiting, (cost + 3, audit + "I", i, initials + name[0], kept + (name + ":",)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(waiting, (cost + 4, audit + "D", i + 1, initials, kept))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1]:
                    heapq.heappush(waiting, (cost + more, audit + "K", i + 1, initials + role[0], kept + (f"{role}:{text}",)))
                for name in ("user", "assistant"):
                    heapq.heappush(waiting, (cost + 3 + more, audit + "R", i + 1, initials + name[0], kept + (f"{name}:{text}",)))


def plain(rows):
    """Reports by conversation from (conv_id, turn, role, text)."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or (" " if role is None else ""), " " if text is None else text) for k, t, role, text in rows if k == key))
        seen, faulty = set(), []
        for _, _, role, text in own:
            letters = WORD.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for known, t, _, _ in own if known}
        cost, audit, kept = cheapest(faulty)
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[key] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn", "role", "text", "1 as mark", "2 as key", "'x' as h1")


def some_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        key = None if c == 3 else c
        for _ in range(rng.randrange(1, most)):
            text = rng.choice(("Yes.", "No!", "Why?\n ", "cut off", "", " \t", None, "é.", "ok… ", f"{rng.random()}."))
            rows.append((key, rng.choice((None, 1, 2, 3, 4, 5, 9)), rng.choice(("user", "user", "assistant", "assistant", "system", "tool", "", None, "umpire")), text))
    return rows + rows[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_cheapest_first_search(spark, seed):
    rows = some_rows(seed, 70, 9)
    got = dialogues.conversation_reports(table(spark, rows).repartition(5)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain(rows) and len(got) == 70


def test_long_conversations_go_through_the_spill_folder(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(("user", "assistant", "system")), rng.choice(("Same.", f"{i}.", f"{i}", ""))) for i in range(3000)] + [(2, 1, "user", "Hi.")]
    small = dialogues.conversation_reports(table(spark, rows), block=7, spool=100).collect()
    assert sorted(small) == sorted(dialogues.conversation_reports(table(spark, rows)).collect())
    report = {r.conv_id: r for r in small}
    letters = report[1].audit
    assert sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in letters) <= report[1].cost and len(letters.replace("I", "")) == 3000
    assert report[1].duplicate == sum(1 for i, r in enumerate(rows[:-1]) if r[3] == "Same." and any(q[2:] == r[2:] for q in rows[:i]))
    assert (report[2].audit, report[2].cost) == ("KI", 3)


def test_dynamic_program_on_longer_random_codes():
    """Cost and audit against the table of the best (cost, audit) by row and state."""
    rng = random.Random(4)
    for _ in range(300):
        faulty = [(rng.choice(("user", "assistant", "system", "tool")), "x", rng.choice((None, None, None, "blank", "truncated"))) for _ in range(rng.randrange(0, 60))]
        c = dialogues.Conversation(1, 5, 1 << 20)
        for role, text, fault in faulty:
            c.add(None, role, text, fault)
        out = list(c.repaired())
        best = {0: (0, "")}

        def inserted(best):
            for p, t in ((0, 2), (1, 2), (3, 2), (2, 3), (3, 2)):
                if p in best:
                    best[t] = min(best.get(t, (1 << 30, "")), (best[p][0] + 3, best[p][1] + "I"))
            return best

        best = inserted(best)
        for role, _, fault in faulty:
            after = {s: (n + 4, a + "D") for s, (n, a) in best.items()}
            if fault != "blank":
                for p, t in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)):
                    if p in best and (t != 1 or role[0] == "s"):
                        keep = role[0] == " sua"[t]
                        option = (best[p][0] + (0 if keep else 3) + (3 if fault == "truncated" else 0), best[p][1] + ("K" if keep else "R"))
                        after[t] = min(after.get(t, (1 << 30, "")), option)
            best = inserted(after)
        want = min(best.get(s, (1 << 30, "")) for s in (0, 3))
        if faulty:
            assert ((out[0][-1] if out else 0), "".join(r[2] for r in out)) == want


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi again."), (1, 2, "assistant", "Yes."), (2, 5, "system", "Be kind."), (2, 6, "user", "So?"), (2, 8, "assistant", "")]
    got = [tuple(r) for r in dialogues.repaired_turns(table(spark, rows).coalesce(1)).orderBy("conv_id").collect()]
    assert [r[:7] for r in got if r[0] == 1] == [
        (1, 0, "K", None, "user", "user", "Hi."),
        (1, None, "I", None, None, "assistant", ""),
        (1, 1, "K", None, "user", "user", "Hi again."),
        (1, 2, "K", None, "assistant", "assistant", "Yes."),
    ]
    assert [(r[2], r[5]) for r in got if r[0] == 2] == [("K", "system"), ("K", "user"), ("D", "assistant"), ("I", "assistant")]


def test_keys_of_strings_and_empty_tables(spark):
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes.")], "conv_id string, turn long, role string, text string")
    assert [(r.conv_id, r.audit, r.cost) for r in dialogues.conversation_reports(named).collect()] == [("a", "KK", 0)]
    assert dialogues.conversation_reports(table(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "w " * 3_000_000 + "."), (1, 1, "assistant", "é" * 100_000)]
    report = dialogues.conversation_reports(table(spark, rows)).first()
    assert (report.truncated, report.cost, report.audit) == (1, 3, "KK")
    assert report.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()


def test_damage(spark):
    rows = [(c, t, "assistant", f"A{t}. B! C?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(str, map(tuple, damaged(table(spark, rows)).collect())))
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        want += [str((c, t, "user" if harm == 4 else role, text))] * (0 if harm == 0 else 2 if harm == 3 else 1)
    assert got == sorted(want)
