"""Op 13. Conversation structure repair by a suffix-shared automaton.

The turns of a conversation, by turn number, are checked and repaired. A turn's first fault
counts: blank (no visible character), duplicate (role and text seen earlier in it), truncated
(the last visible character is none of ``.!?``). Edits: Keep (0), Rerole to user or assistant
(3), Delete (4, the only edit of blank and duplicate turns), Insert an empty turn of user or
assistant (3); a truncated turn that stays costs 3 more. The cheapest edits whose role
initials read ``(s?(ua)+)?`` are taken, among equals those whose initials D, I, K, R are
ASCII-least.

1. Signatures. A turn is one letter: its role initial (capital if truncated), or ``x`` if it
   must go. Turns are sorted once over all tasks and numbered; a conversation is cut into
   segments of at most ``SEGMENT`` turns, so none, however long, is gathered in one row.
2. Automaton. The distinct signatures of all conversations are sorted by their reversed text:
   neighbours share the longest suffixes, so a stack of nodes (one for each suffix of the
   current signature) visits every node of the suffix-shared automaton once. A node holds for
   each grammar state the cost to go and the least audit of the rest of the segment: for the
   last segment of a conversation up to acceptance, for others up to each grammar state.
3. Path. Conversations of one segment read their audit off the node; those of several fold
   their segments from the end (cost and the head of the best audit per state), then walk
   forward. Given the state, an audit letter names the role, so edits follow per segment.

Only the digest of a repaired conversation passes through one task, as a stream of its turns.
Defined results: null roles and texts count as one space, null turns come first, turns with
one number go by role and text; a null conversation id is a conversation; repeated rows are
duplicates; conversations without rows do not appear; empty tables give an empty result; only
the named columns are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

#: log2 of the most turns of a segment.
SEGMENT_BITS = 9
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant (accepting: 0 and 3).
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that an insertion or a new role gives in each state, and the state after it.
GIVEN, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
VISIBLE = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of ``conv:turn`` modulo 20: 0 drops the
    row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    d = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text"),
                    F.pmod(F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")), F.lit(20)).alias("__h")).where("__h != 0")
    d = d.withColumn("__n", F.explode(F.when(F.col("__h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return d.select("conv_id", "turn", F.when(F.col("__h") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("__h") == 1, "").when(F.col("__h") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"))


def numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, id): ids rise with (conversation, turn, role, text) over all tasks."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    d = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    d = d.repartitionByRange("conv", "turn", "role").sortWithinPartitions("conv", "turn", "role", "text")
    return stored(d.withColumn("id", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(conv, id, initial, fault, letter) of numbered turns."""
    last = F.regexp_extract("text", f"({VISIBLE})[\\x20\\x09-\\x0D]*$", 1)
    blank = ~F.col("text").rlike(VISIBLE)
    firsts = turns.where(~blank).groupBy("conv", "role", F.md5(F.col("text").cast("binary")).alias("__text")) \
        .agg(F.min("id").alias("first")).select("first")
    d = turns.select("conv", "id", F.substring("role", 1, 1).alias("initial"), blank.alias("__blank"), (~last.isin(".", "!", "?")).alias("__cut"))
    d = d.join(firsts, d["id"] == firsts["first"], "left")
    fault = F.when(F.col("__blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("__cut"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return d.withColumn("fault", fault).select(
        "conv", "id", "initial", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter).alias("letter"))


def segments(marked: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """(sid, conv, ids, signature, last, single, counts): a row per segment; sid is its first id."""
    d = marked.groupBy("conv", F.shiftright("id", bits).alias("__seg")).agg(
        F.array_sort(F.collect_list(F.struct("id", "letter", "initial"))).alias("t"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    d = d.select("conv", "blank", "duplicate", "truncated", F.col("t")[0]["id"].alias("sid"), F.transform("t", lambda x: x["id"]).alias("ids"),
                 F.array_join(F.transform("t", lambda x: x["letter"]), "").alias("signature"), F.transform("t", lambda x: x["initial"]).alias("initials"))
    order = Window.partitionBy("conv").orderBy("sid")  # a row for 2 ** bits turns
    d = d.withColumn("__prev", F.lag(F.element_at("initials", -1)).over(order)).withColumn("last", F.lead("sid").over(order).isNull()) \
        .withColumn("single", F.col("last") & F.lag("sid").over(order).isNull())
    chain = F.when(F.col("__prev").isNull(), F.col("initials")).otherwise(F.concat(F.array("__prev"), F.col("initials")))
    n = F.size(chain)
    pairs = F.zip_with(F.slice(chain, 1, n - 1), F.slice(chain, 2, n - 1), lambda a, b: F.concat(a, b))
    return d.withColumn("illegal", F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).drop("initials", "__prev")


def _step(letter: str, rest: list) -> list:
    """The node before ``letter``: [state][target] = (cost, audit) or None, from the node after it."""
    kind, extra = letter.lower(), CUT * letter.isupper()
    must_go = letter == "x"
    out = []
    for s in range(4):
        ways = [(DELETE, "D", rest[s])]
        if not must_go:
            to = NEXT.get(kind, (None,) * 4)[s]
            if to is not None:
                ways.append((KEEP + extra, "K", rest[to]))
            ways.append((REROLE + extra, "R", rest[AFTER[s]]))
        out.append([min(((c + r[t][0], x + r[t][1]) for c, x, r in ways if r[t] is not None), default=None) for t in range(len(rest[0]))])
    return _inserted(out)


def _inserted(node: list) -> list:
    """Insertions in front, as many as help (a state repeats after two)."""
    for _ in range(3):
        for s in range(4):
            for t, r in enumerate(node[AFTER[s]]):
                if r is not None:
                    way = (INSERT + r[0], "I" + r[1])
                    if node[s][t] is None or way < node[s][t]:
                        node[s][t] = way
    return node


def end_node(last: bool) -> list:
    """The node of the empty suffix: acceptance after the last segment, else one target per state."""
    if last:
        return _inserted([[(0, "")], [None], [None], [(0, "")]])
    return [[(0, "") if s == t else None for t in range(4)] for s in range(4)]


def _automaton(batches):
    """Nodes of signatures that come sorted by (last, reversed signature)."""
    stack, word, kind = [], "", None
    for batch in batches:
        out = []
        for sig, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            back = sig[::-1]
            if last != kind:
                stack, word, kind = [end_node(last)], "", last
            n = 0
            while n < min(len(word), len(back)) and word[n] == back[n]:
                n += 1
            del stack[n + 1:]  # nodes of other suffixes never come again
            for letter in back[n:]:
                stack.append(_step(letter, stack[-1]))
            word = back
            flat = [x for row in stack[-1] for x in row]
            out.append((sig, last, [x and x[0] for x in flat], [x and x[1] for x in flat]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string())))], ["signature", "last", "costs", "audits"])


def solved(segs: DataFrame) -> DataFrame:
    """(signature, last, costs, audits) of every distinct signature, by state and target."""
    d = segs.select("signature", "last").distinct().withColumn("__back", F.reverse("signature"))
    d = d.repartitionByRange("last", "__back").sortWithinPartitions("last", "__back").select("signature", "last")
    return d.mapInArrow(_automaton, "signature string, last boolean, costs array<bigint>, audits array<string>")


def _fold(batches):
    """(sid, state, place) of segments that come sorted by conversation, last segment first:
    the state each begins in and the place of its costs and audits."""
    def walk():
        s, out = 0, []
        for sid, to in reversed(choice):
            out.append((sid, s, 4 * s + to[s] if to is not None else s))
            s = to[s] if to is not None else s
        return out

    choice, rest = [], None  # rest: (cost, first letters of the audit) from each state
    for batch in batches:
        out = []
        for sid, last, costs, audits in zip(*(c.to_pylist() for c in batch.columns)):
            if last:
                out += walk()
                choice, rest = [(sid, None)], list(zip(costs, (a[:8] for a in audits)))
                continue
            to, new = [], []
            for s in range(4):
                # two audits of one cost differ within the segment, or one goes on with a few insertions
                way, t = min(((costs[4 * s + t] + rest[t][0], audits[4 * s + t] + rest[t][1]), t) for t in range(4) if costs[4 * s + t] is not None)
                to.append(t)
                new.append((way[0], way[1][:8]))
            choice.append((sid, bytes(to)))
            rest = new
        if out:
            yield _path(out)
    if choice:
        yield _path(walk())


def _path(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], ["sid", "state", "place"])


def plan(segs: DataFrame) -> DataFrame:
    """(sid, conv, ids, state, cost, audit, fault counts) of the segments."""
    d = stored(segs.join(solved(segs), ["signature", "last"]), "segments")
    many = d.where(~F.col("single")).select("conv", "sid", "last", "costs", "audits").repartition("conv").sortWithinPartitions("conv", F.desc("sid"))
    path = many.select("sid", "last", "costs", "audits").mapInArrow(_fold, "sid bigint, state int, place int")
    d = d.join(path, "sid", "left").withColumn("state", F.coalesce("state", F.lit(0))).withColumn("place", F.coalesce("place", F.lit(0)))
    return d.select("sid", "conv", "ids", "state", F.get("costs", "place").alias("cost"), F.get("audits", "place").alias("audit"),
                    "blank", "duplicate", "truncated", "illegal")


def _edits(batches):
    """(id, k, edit, role): the edits of every turn, insertions before it first (after it for
    those that end a conversation); role where the edit gives one."""
    for batch in batches:
        out = []
        for ids, audit, s, letters in zip(*(c.to_pylist() for c in batch.columns)):
            at, k = 0, 0
            for x in audit:
                role = None
                if x in "IR":
                    role, s = GIVEN[s], AFTER[s]
                elif x == "K":
                    s = NEXT[letters[at].lower()][s]
                out.append((ids[min(at, len(ids) - 1)], k, x, role))
                k += 1
                if x != "I":
                    at += 1
                    k = k if at == len(ids) else 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.string()))],
                                             ["id", "k", "edit", "role"])


class Repair:
    """The repair of a table of conversations: ``turns`` (conv, id, k, edit, role, text), a row
    per edit, deletions included, and ``report``, a row per conversation."""

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 segment_bits: int = SEGMENT_BITS):
        self.rows = numbered(rows, conv, turn, role, text)
        segs = stored(segments(faults(self.rows), segment_bits), "signatures")
        self.segments = stored(plan(segs), "audits")
        letters = segs.select("sid", "signature")
        edits = self.segments.join(letters, "sid").select("ids", "audit", "state", "signature") \
            .mapInArrow(_edits, "id bigint, k int, edit string, role string")
        own = self.rows.select("id", "conv", F.col("role").alias("__role"), F.col("text").alias("__text"))
        self.turns = edits.join(own, "id").select(
            "conv", "id", "k", "edit", F.coalesce("role", "__role").alias("role"),
            F.when(F.col("edit") == "I", "").otherwise(F.col("__text")).alias("text"))

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256) of ``role:text`` of the repaired turns, joined by newlines; a
        conversation passes as a stream of turns. None for conversations without turns left."""
        def run(batches):
            key, h = None, None
            for batch in batches:
                done = []
                for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if h is None or conv != key:
                        if h is not None:
                            done.append((key, h.hexdigest()))
                        key, h = conv, hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(f"{role}:{text}".encode())
                if done:
                    yield out(done)
            if h is not None:
                yield out([(key, h.hexdigest())])

        kind = self.turns.schema["conv"].dataType
        from pyspark.sql.pandas.types import to_arrow_type
        arrow = to_arrow_type(kind)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow), pa.array([r[1] for r in rows])], ["conv", "repaired_sha256"])
        left = self.turns.where("edit != 'D'").repartition("conv").sortWithinPartitions("conv", "id", "k").select("conv", "role", "text")
        return left.mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string")

    def report(self) -> DataFrame:
        """(conv, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        by_turn = self.rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        a = by_turn.groupBy("conv").agg(F.sum("n").alias("n_turns"), gaps)
        parts = F.array_sort(F.collect_list(F.struct("sid", "audit")))
        b = self.segments.groupBy("conv").agg(
            *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
            F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit")).withColumnRenamed("conv", "__b")
        c = self.digests().withColumnRenamed("conv", "__c")
        d = a.join(b, a["conv"].eqNullSafe(b["__b"])).join(c, F.col("conv").eqNullSafe(F.col("__c")), "left")
        empty = hashlib.sha256(b"").hexdigest()
        return d.select("conv", "n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def repair_report(all_rows: DataFrame, rows: DataFrame, conv: str = "conv_id", **how) -> DataFrame:
    """``Repair(rows).report()`` for every conversation of ``all_rows``; those without rows get
    zeros, an empty audit and the digest of the empty string."""
    ids = all_rows.select(F.col(f"`{conv}`").alias("conv_id")).distinct()
    r = Repair(rows, conv, **how).report()
    d = ids.join(r, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
