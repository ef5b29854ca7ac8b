"""State replay and the ledger against plain versions, with awkward rows."""

import random

from ledgerloom.operators.ledger import closest_parties
from ledgerloom.operators.replay import replayed

EVENT = "entity_id long, trace_index long, op string, key int, value int, focus struct<depth:int,candidates:array<int>>, note string"


def test_states_equal_a_plain_replay(spark):
    rng = random.Random(3)
    rows = []
    for entity, n in ((1, 400), (2, 1), (3, 33), (None, 5)):
        for i in range(n):
            op = rng.choice(["place", "place", "backtrack", "focus", "other", None])
            rows.append((entity, i, op, rng.choice([0, 1, 2, 3, None, 9]), rng.choice([1, 2, None]), (i, [i]) if op == "focus" else None, "x"))
    want = {}
    for entity in (1, 2, 3):
        state, focus = [0] * 4, None
        for e, i, op, key, value, new, _ in (r for r in rows if r[0] == entity):
            want[e, i] = (list(state), sum(v != 0 for v in state), focus)
            if op in ("place", "backtrack") and key is not None and key < 4:
                state[key] = (value or 0) if op == "place" else 0
            focus = new if op == "focus" else focus
    rng.shuffle(rows)
    found = replayed(spark.createDataFrame(rows, EVENT).repartition(3), keys=4, block=16).collect()
    assert len(found) == len(rows) and {r["note"] for r in found} == {"x"}
    got = {(r["entity_id"], r["trace_index"]): (r["state"], r["filled"], tuple(r["focus_before"]) if r["focus_before"] else None) for r in found if r["entity_id"]}
    assert got == want


def test_replay_of_nothing(spark):
    assert replayed(spark.createDataFrame([], EVENT), keys=3).collect() == []


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


ENTRY = "key long, ledger_name string, alias string, mailing_name string, name string"


def test_closest_entries_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    entries = [(i, rng.choice([word(), None, " "]), rng.choice([word(), None]), word() + " ", "clash") for i in range(40)] + [(3, "abca", "abca", None, "clash")] * 3
    names = [(i, rng.choice([word() + rng.choice(["", "xx", "xyz", " "]), None, "  ", "ABCA", "q" * 3000])) for i in range(150)]
    want = {}
    for i, name in names:
        text = (name or "").strip().upper()
        forms = [(edits(text, f.strip().upper()), f.strip().upper(), key if edits(text, f.strip().upper()) else None, kind, key) for key, *fs in entries for kind, f in enumerate(fs[:3]) if f and f.strip()] if text and len(text) < 99 else []
        near = [f for f in forms if f[0] <= 2]
        if not near:
            want[i] = (None, None, None, None, "Party not found in ledgers" if text else None)
        elif min(near)[0] == 0:
            kind, key = min((f[3], f[4]) for f in near if f[0] == 0)
            want[i] = (key, ["ledger_name", "alias", "mailing_name"][kind], text, 0, None)
        else:
            least = min(near)[:2]
            want[i] = (None, None, least[1], least[0], f"No exact match; closest: {least[1]}")
    table = spark.createDataFrame([(*n, "own", "old") for n in names], "id long, name string, alias string, warning string")
    found = closest_parties(table, spark.createDataFrame(entries, ENTRY)).collect()
    assert {r["alias"] for r in found} == {"own"}
    got = {r["id"]: (r["key"], r["matched_by"], r["closest"], r["distance"], r["warning"]) for r in found}
    assert got == want and len(found) == len(names)


def test_long_names_meet_by_parts(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (38, 40, 41, 42, 43, 60, 3000)]
    worn = []
    for i, b in enumerate(base):
        for j in range(40):
            s = list(b)
            for _ in range(rng.choice([0, 1, 2, 2, 4])):
                at = rng.randrange(len(s))
                s[at : at + rng.choice([0, 1])] = rng.choice([[], ["z"]])
            worn.append((i * 100 + j, "".join(s)))
    names = spark.createDataFrame(worn, "id long, name string")
    entries = spark.createDataFrame([(i, b, None, None, None) for i, b in enumerate(base)], ENTRY)
    got = {r["id"]: r["distance"] for r in closest_parties(names, entries).collect()}
    for i, name in worn:
        if i < 600:  # A plain table of 3,000 by 3,000 is slow; those are checked by how they were worn.
            d = edits(name, base[i // 100])
            assert got[i] == (d if d <= 2 else None)
        else:
            assert got[i] is not None or edits(name[:40], base[6][:40]) + edits(name[40:], base[6][40:]) > 2


def test_empty_ledger_and_no_names(spark):
    names, entries = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"), spark.createDataFrame([], ENTRY)
    assert [(r["id"], r["warning"]) for r in closest_parties(names, entries).orderBy("id").collect()] == [(1, "Party not found in ledgers"), (2, None)]
    assert closest_parties(names.limit(0), entries).collect() == []
