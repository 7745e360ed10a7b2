"""Structure repair against a plain search over whole conversations, also where a conversation is cut into many segments."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import queries, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, fault string"
ENDS = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        kind = "blank" if not WORDY.search(text) else "duplicate" if (role, text) in seen else None if ENDS.search(text) else "truncated"
        seen.add((role, text))
        found.append(kind)
    return found


def cheapest(rows, kinds):
    """(cost, audit) from row k on, by state: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a."""
    ahead = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, ""), 3: (0, "")}

    def inserted(best):
        for _ in range(4):
            for (q, initial), to in ahead.items():
                if initial != "s" and to in best:
                    best[q] = min(best.get(q, (10**9, "")), (best[to][0] + 2, "I" + best[to][1]))
        return best

    best = inserted(best)
    for (_, role, _), kind in zip(reversed(rows), reversed(kinds)):
        now = {}
        for q in range(4):
            ways = [(best[q][0] + 3, "D" + best[q][1])] if q in best else []
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                for (p, initial), to in ahead.items():
                    if p == q and role[:1] == initial:
                        ways.append((best[to][0] + late, "K" + best[to][1]))
                    if p == q and initial != "s":
                        ways.append((best[to][0] + 2 + late, "R" + best[to][1]))
            if ways:
                now[q] = min(ways)
        best = inserted(now)
    return best[0]


def applied(rows, audit):
    k, told = 0, []
    for edit in audit:
        last = told[-1][0][:1] if told else "s"
        role = "assistant" if last == "u" else "user"
        if edit == "I":
            told.append((role, ""))
            continue
        if edit != "D":
            told.append((rows[k][1] if edit == "K" else role, rows[k][2]))
        k += 1
    assert k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in told))
    return "\n".join(f"{role}:{text}" for role, text in told)


def brute(table):
    found = {}
    for conv_id in {r[0] for r in table}:
        rows = sorted(((t, " " if role is None else role, " " if text is None else text) for c, t, role, text in table if c == conv_id), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds = faults(rows)
        cost, audit = cheapest(rows, kinds)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256(applied(rows, audit).encode()).hexdigest()
        found[conv_id] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def found(spark, table):
    rows = spark.createDataFrame([(*r, "p", "f") for r in table], SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:] for r in structure_repair.repair(rows)[0].collect()}


def talk(rng, conv_id, n):
    text = lambda: rng.choice(["", " \n", "Yes.", "no", "a b? ", "So\n!", None, "x ", f"t{rng.randrange(99)}.", f"u{rng.randrange(99)}"])
    role = lambda: rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "ústav", "User"])
    return [(conv_id, rng.choice([k, k, k, k // 2, None]), role(), text()) for k in range(n)]


def test_repair_equals_a_plain_search(spark):
    rng = random.Random(1)
    table = [r for c in range(300) for r in talk(rng, c, rng.randint(1, 12))] + talk(rng, None, 7)
    assert found(spark, table) == brute(table)


def test_long_conversations_are_repaired_by_segments(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "BLOCK_ROWS", 40)
    rng = random.Random(2)
    table = talk(rng, 5, 900) + [r for c in range(6, 30) for r in talk(rng, c, rng.randint(1, 60))]
    table += [(40, k, "user", f"only the user, {k}.") for k in range(200)] + [(41, k, "system", "") for k in range(200)]
    assert found(spark, table) == brute(table)


def test_states_far_apart_in_cost_stay_out(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "BLOCK_ROWS", 30)
    table = [(1, k, "system", f"s{k}.") for k in range(120)] + [(1, 200 + k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(9)]
    table += [(2, k, "user", " ") for k in range(150)] + [(2, 151, "system", "At last."), (2, 152, "user", "a."), (2, 153, "assistant", "b.")]
    got = found(spark, table)
    assert got == brute(table)
    assert got[2][6] == "D" * 150 + "KKK"


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "tool", "c."), (2, 0, "assistant", " ")], "conv_id long, turn long, role string, text string")
    _, repaired = structure_repair.repair(rows)
    told = [(r.conv_id, r.role, r.text) for r in repaired.orderBy("conv_id", "place", "at").collect()]
    assert told == [(1, "user", "a."), (1, "assistant", ""), (1, "user", "b."), (1, "assistant", "c.")]


def test_empty_tables_and_dropped_conversations(spark, tmp_path):
    assert found(spark, []) == {}
    for name, table in (("none", []), ("some", [(None, None, None, None), (-1, 3, "user", "Hi."), (0, None, "user", "x")])):
        spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        rows = queries.QUERIES["op11_tight_arcs"](spark, f"{tmp_path}/{name}").collect()
        assert {r.conv_id for r in rows} == {r[0] for r in table}
    # 3:11 is dropped by its checksum, and with it the whole conversation.
    key = next(k for k in range(1000) if __import__("zlib").crc32(f"3:{k}".encode()) % 20 == 0)
    spark.createDataFrame([(3, key, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/dropped/conversations.parquet")
    row = queries.QUERIES["op11_tight_arcs"](spark, f"{tmp_path}/dropped").first()
    assert tuple(row) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = spark.createDataFrame([(c, t, r, x) for c in range(40) for t, r, x in ((0, "system", "a. b!"), (1, None, None))], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, queries.damaged(rows).collect()))
    crc = __import__("zlib").crc32
    wanted = []
    for c in range(40):
        for t, r, x in ((0, "system", "a. b!"), (1, " ", " ")):
            kind = crc(f"{c}:{t}".encode()) % 20
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            wanted += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(wanted)
    assert queries.damaged(rows).where(F.col("text").isNull() | F.col("role").isNull()).count() == 0
