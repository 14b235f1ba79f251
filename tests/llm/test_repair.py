"""Conversation repair against a shortest-path search over every conversation."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from tallyframe.llm import repair

GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLE = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, turns) by uniform-cost search over (rows used, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        for x, name in ROLE.items():
            to = GRAMMAR.get((state, x))
            if to:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, out + ((name, ""),)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = GRAMMAR.get((state, role[:1]))
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, out + ((role, text),)))
                for x, name in ROLE.items():
                    to = GRAMMAR.get((state, x))
                    if to:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, out + ((name, text),)))


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    out = {}
    for conv, got in by.items():
        got.sort(key=lambda r: r[:4])
        seen, marked, turns = set(), [], [r[4] for r in got if r[4] is not None]
        for _, _, role, text, _ in got:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, turns_out = cheapest(marked)
        said = "\n".join(f"{r}:{t}" for r, t in turns_out)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def talk(seed, convs=150):
    g = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for t in range(int(g.integers(0, 9))):
            role = g.choice(["user", "assistant", "system", "tool", "", "User"], p=[.4, .4, .1, .04, .03, .03])
            text = g.choice(["Yes.", "No", "a b?", " ", "", "x. ", "é!", "c%d." % g.integers(50), "d%d" % g.integers(9)])
            rows.append((c, t + (t > 4) * int(g.integers(0, 3)), str(role), str(text)))
    rows += [(900, None, "user", "Hi."), (900, None, "assistant", None), (900, 4, None, "So."), (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."),
             (901, None, None, None), (902, 0, "user", "Q?"), (902, 0, "user", "Q?"), (903, -5, "assistant", "A."), (903, 9, "user", "B")]
    rows += [(904, t, "user" if t % 3 else "assistant", f"t{t % 40}" + ".?  x"[t % 5]) for t in range(1300)]  # one long conversation
    return rows


FORM = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("bits", [repair.SEGMENT_BITS, 2])
def test_equals_shortest_path(spark, bits):
    rows = talk(1)
    d = spark.createDataFrame(rows, FORM).selectExpr("*", "'x' as id", "'y' as conv", "1 as sid").repartition(5)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(d, d, segment_bits=bits).collect()}
    assert got == plain(rows)


def test_damage_and_lost_conversations(spark):
    rows = talk(2)
    d = spark.createDataFrame(rows, FORM)
    hurt = damaged(rows)
    assert sorted(map(tuple, repair.damaged(d).collect()), key=str) == sorted(hurt, key=str)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(d, repair.damaged(d)).collect()}
    want = plain(hurt)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}


def test_turns_and_empty_table(spark):
    d = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", " "), (1, 2, "user", "Q")], FORM)
    got = [tuple(r) for r in repair.Repair(d).turns.orderBy("id", "k").select("edit", "role", "text").collect()]
    assert [g[0] for g in got] == list(repair.Repair(d).report().first().audit)
    assert [g[1:] for g in got if g[0] != "D"] == [("user", ""), ("assistant", "Hi.")]
    none = d.limit(0)
    assert repair.repair_report(none, none).count() == 0 and repair.repair_report(d, none).first().cost == 0


def test_nodes_are_shared():
    """Signatures sorted by reversed text: every suffix is stepped once."""
    import pyarrow as pa
    sigs = sorted({"uaua", "sua", "ua", "xua", "Uaua", "aua"}, key=lambda s: s[::-1])
    steps, real = [], repair._step
    repair._step = lambda letter, rest: steps.append(letter) or real(letter, rest)
    try:
        list(repair._automaton([pa.RecordBatch.from_arrays([pa.array(sigs), pa.array([True] * len(sigs))], ["signature", "last"])]))
    finally:
        repair._step = real
    assert len(steps) == len({s[i:] for s in sigs for i in range(len(s))})
