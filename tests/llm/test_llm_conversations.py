"""Conversation repair beside an exhaustive search and plain Python."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from tallyworth.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost long, letter string, n int, fate string"


def initials_allowed(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def searched(rows):
    """Cheapest edits by uniform-cost search over (rows taken, role initials so far), ties by audit; no grammar states."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and initials_allowed(initials):
            return cost, audit, out
        if (at, audit, initials) in done or len(initials) > len(rows) + 3:
            continue
        done.add((at, audit, initials))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, initials + name[0], (*out, f"{name}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, initials, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + (role[:1] or "?"), (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, initials + name[0], (*out, f"{name}:{text}")))


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)


def plain_repair(rows, ids):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, text))
    for conv in ids:
        found = sorted(groups[conv])
        faulty = plain_faults([r[2:] for r in found])
        cost, audit, out = searched(faulty)
        turns = [t for known, t, _, _ in found if known]
        names = Counter(f for _, _, f in faulty)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faulty, faulty[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        yield conv, gaps, names["blank"], names["duplicate"], names["truncated"], illegal, cost, audit, digest


def random_rows(seed, conversations_, most):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "three", "", " \n", None, "Why? ", "end.\x0b", "caf\xe9.", " ", "x" * 50 + "."]
    rows = []
    for conv in [*range(conversations_), None]:
        for _ in range(rng.randint(0, most)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["system", "user", "assistant", "tool", None, "", "user"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repairs_equal_exhaustive_search(spark, seed):
    rows = random_rows(seed, 60, 5)
    df = spark.createDataFrame([(*r, 1, "a", 2, "z") for r in rows], SCHEMA).repartition(4)
    found = [tuple(r) for r in conversations.repaired(df).collect()]
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert Counter(found) == Counter(plain_repair(plain, {r[0] for r in rows}))


def test_damage_and_repair_of_given_conversations(spark):
    rows = random_rows(7, 150, 4)
    df = spark.createDataFrame([(*r, 1, "a", 2, "z") for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in conversations.damaged_and_repaired(df).collect()]
    assert Counter(found) == Counter(plain_repair(list(plain_damage(rows)), {r[0] for r in rows}))


def test_endings_are_built_once_and_give_the_least_audit():
    rng = random.Random(5)
    found = {"".join(rng.choice(conversations.LETTERS) for _ in range(rng.randint(0, 7))) for _ in range(400)}
    built = []
    result = list(conversations.repairs(sorted(found, key=lambda s: s[::-1]), built))
    endings = {s[k:] for s in found for k in range(len(s))}
    assert len(built) == len(set(built)) == len(endings)
    faults = ["none", "blank", "duplicate", "truncated"]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for signature, cost, audit in result:
        rows = [(names[conversations.ROLES[i]], "t", faults[i % 4]) for i in map(conversations.LETTERS.index, signature)]
        assert (cost, audit) == searched(rows)[:2]


def test_long_conversation_common_row_and_empty_table(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(3000)] + [(2, 5, "user", "again.")] * 2000 + [(3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = {r["conv_id"]: r for r in conversations.repaired(df).collect()}
    assert (found[1]["cost"], found[1]["audit"], found[1]["gaps"]) == (6, "I" + "K" * 3000 + "I", 0)
    assert (found[2]["duplicate"], found[2]["cost"], found[2]["audit"]) == (1999, 4 * 1999 + 3, "K" + "D" * 1999 + "I")
    assert (found[3]["blank"], found[3]["cost"], found[3]["audit"], found[3]["gaps"]) == (1, 4, "D", 0)
    assert found[3]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert conversations.damaged_and_repaired(df.limit(0)).collect() == []
