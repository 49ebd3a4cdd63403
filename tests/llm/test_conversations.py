import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, key string, g long, block long, cost double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 0.5) for r in rows], SCHEMA).repartition(3)


def cheapest(rows):
    """Least cost and ASCII-least audit by trying every edit; rows: (initial, fault)."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        give = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        follow = {"s": 1, "u": 2, "a": 3}
        if i == len(rows) and state in (0, 3):
            ways.append((0, ""))
        if inserted < 3:
            c, a = best(i, follow[give], inserted + 1)
            ways.append((c + 5, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if initial == give or (initial == "s" and state == 0):
                    c, a = best(i + 1, follow[initial], 0)
                    ways.append((c + extra, "K" + a))
                c, a = best(i + 1, follow[give], 0)
                ways.append((c + 1 + extra, "R" + a))
        return min(ways, default=(10 ** 9, ""))

    return best(0, 0, 0)


def brute(rows):
    say = lambda v: " " if v is None else str(v)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        at = convs[conv]
        fault = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        at += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, have in convs.items():
        have.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        turns = [r[0] for r in have if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in have:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in have]
        cost, audit = cheapest(tuple(zip(initials, faults)))
        kept, state, at = [], "", 0
        for edit in audit:
            give = "assistant" if state == "u" else "user"
            if edit == "I":
                kept.append(f"{give}:")
            else:
                _, role, text = have[at]
                at += 1
                if edit == "D":
                    continue
                give = role if edit == "K" else give
                kept.append(f"{give}:{text}")
            state = give[0]
        assert at == len(have) and re.fullmatch("(s?(ua)+)?", "".join(k[0] for k in kept))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def awkward(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ustedes"]
    texts = ["Fine.", "What?  \n", "cut", "", " \t\n", None, "é ünï.", "Fine.", "no end\x0b\x0c", "...", "日本!", "line\nline."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(roles[:3] if rng.random() < 0.7 else roles),
                         rng.choice(texts) if rng.random() < 0.4 else f"said {rng.random()}."))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(60)]  # a long one
    rows += [(501, 0, "user", "again.")] * 40 + [(None, t % 4, "user", "lost.") for t in range(9)] + [(502, None, None, None)] * 3
    rows += [(503, t, "assistant", "long " * 30_000 + f"{t}.") for t in range(3)]
    rows += [(600 + i, i, "user", "alone.") for i in range(60)]  # some are dropped whole
    return rows + rows[:30]


@pytest.mark.parametrize("block", [C.BLOCK, 3])
def test_matches_brute_force(spark, block):
    rows = awkward(1)
    got = {r[0]: tuple(r)[1:] for r in C.repair(table(spark, rows), block).collect()}
    assert got == brute(rows)
    # at these prices a row that is deleted always beats one that is inserted
    assert all("I" not in v[6] for v in got.values()) and any("R" in v[6] for v in got.values()) and any(v[6] == "" for v in got.values())


def test_inserts_where_deletes_are_dear(monkeypatch):
    monkeypatch.setattr(C, "DELETE", 30)
    monkeypatch.setattr(C.Automaton, "_steps", {})
    a = C.Automaton(C.ACCEPT)
    for signature, audit, cost in (("u", "KI", 5), ("s", "IR", 6), ("ua", "KK", 0), ("uu", "KR", 1), ("suau", "RRRR", 4), ("suauauau", "KKKKKKKKI", 5), ("d", "D", 30), ("", "", 0)):
        a.read(signature)
        assert (a.audit(0)[0], a.cost(0)) == (audit, cost)


def test_documents_table(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = brute([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])
    assert {r[0]: tuple(r)[1:] for r in C.repair(conv).collect()} == want


def test_repaired_rows_make_the_digest(spark):
    made = C.Repair(table(spark, awkward(2)), 5)
    texts = defaultdict(list)
    for r in made.rows().orderBy("key", "block", "place").collect():
        texts[r.key].append(f"{r.role}:{r.text}")
    for r in made.report().collect():
        key = " " if r.conv_id is None else str(r.conv_id)
        assert hashlib.sha256("\n".join(texts[key]).encode()).hexdigest() == r.repaired_sha256


def test_shared_suffixes_are_kept():
    a, b = C.Automaton(C.ACCEPT), C.Automaton(C.ACCEPT)
    a.read("suaua")
    shared = a.path[3]
    a.read("Uduaua")
    b.read("Uduaua")
    assert a.path[3] is shared and a.audit(0) == b.audit(0) and a.cost(0) == b.cost(0) == cheapest(
        (("u", "truncated"), ("u", "blank"), *((c, "") for c in "uaua")))[0]


def test_no_rows(spark):
    none = table(spark, awkward(1)[:1]).where(F.lit(False))
    assert C.repair(none).count() == 0
