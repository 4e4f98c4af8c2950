"""Conversation structure repair by a forward Viterbi pass over four grammar states.

A conversation is in order if its role initials read ``(s?(ua)+)?``. The states are: nothing yet, after
the system turn, after a user turn, after an assistant turn; the first and the last one may end it. Each
turn's layer carries, per state, the least (cost, audit string) and what was kept so far; after
each turn, and before the first, the layer is closed by insertions, two at most, as a third would come back
to a state it has been in. Edits: K keep (0), R change the role to user or assistant (3), D delete (4, the
only choice for blank and duplicate turns), I insert an empty turn (3); a truncated turn that stays costs 3 more.

The letters of a path determine its states and no two paths to a state with equal costs have one audit
beginning with the other, so the ASCII-least audit of a prefix is that of the whole. A hash of what was
kept travels with each state, so no text is held: memory is four audits, whatever a conversation's length.
Rows are dealt by conversation once and read as a sorted stream.

Defined cases: null conv_id, turn, role and text count as one space where a row is damaged; null
conversation ids are one conversation, null turns come first; turns of one number are taken by role, then text; a role whose
initial is none of s, u, a (an empty one too) is never kept as it is; repeated rows are duplicates; a very long text
is hashed, not copied; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

#: Costs, blanks, ends of a sentence, pairs of initials that may stand side by side.
RETAG, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\x0b\f\r"
ENDS = [".", "!", "?"]
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn with such an initial leads; what an empty or changed turn may be in a state.
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
OTHER = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Turns after which the common beginning of all audits is set aside.
SETTLE = 256
_FIRST = itemgetter(0, 1)


class TurnHash:
    """SHA-256 of the turns as ``role:text`` lines; ``add`` leaves the old one usable."""

    def __init__(self, state=None, empty: bool = True):
        self.state, self.empty = state or hashlib.sha256(), empty

    def add(self, role: str, text: str) -> TurnHash:
        state = self.state.copy()
        state.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "replace"))
        return TurnHash(state, False)

    def result(self) -> str:
        return self.state.hexdigest()


class TurnList:
    """The turns themselves, as a list that shares its beginning with others."""

    def __init__(self, before: TurnList | None = None, turn: tuple[str, str] | None = None):
        self.before, self.turn = before, turn

    def add(self, role: str, text: str) -> TurnList:
        return TurnList(self, (role, text))

    def result(self) -> list[tuple[str, str]]:
        out, at = [], self
        while at.turn is not None:
            out.append(at.turn)
            at = at.before
        return out[::-1]


class Repair:
    """The pass over one conversation: ``turn`` for each row in order, then ``result``."""

    def __init__(self, sink=TurnHash):
        self.layer: list[tuple | None] = [(0, "", sink()), None, None, None]
        self.settled: list[str] = []
        self.n = 0
        self._close()

    def _close(self) -> None:
        layer = self.layer
        for states, target in (((START, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
            for s in states:
                if layer[s] is not None:
                    cost, audit, sink = layer[s]
                    new = (cost + INSERT, audit + "I")
                    if layer[target] is None or new < _FIRST(layer[target]):
                        layer[target] = (*new, sink.add(OTHER[s][0], ""))

    def turn(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        best: list[tuple | None] = [None] * 4
        more = CUT if cut else 0
        for s, held in enumerate(self.layer):
            if held is None:
                continue
            cost, audit, _ = held
            ways = [(s, cost + DELETE, audit + "D", s, None)]
            if not must_go:
                t = NEXT.get((role[:1], s))
                if t is not None:
                    ways.append((t, cost + more, audit + "K", s, role))
                other, t = OTHER[s]
                ways.append((t, cost + RETAG + more, audit + "R", s, other))
            for t, *way in ways:
                if best[t] is None or way[:2] < best[t][:2]:
                    best[t] = way
        self.layer = [w and (w[0], w[1], self.layer[w[2]][2] if w[3] is None else self.layer[w[2]][2].add(w[3], text)) for w in best]
        self._close()
        # what these states can still do, the last one can do for less
        done = self.layer[ASSISTANT][0]
        for s, lead in ((START, DELETE), (SYSTEM, 0)):
            if self.layer[s] is not None and self.layer[s][0] > done + lead:
                self.layer[s] = None
        self.n += 1
        if self.n % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        audits = [h[1] for h in self.layer if h is not None]
        low, high = min(audits), max(audits)
        k = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        self.settled.append(low[:k])
        self.layer = [h and (h[0], h[1][k:], h[2]) for h in self.layer]

    def result(self) -> tuple[int, str, object]:
        cost, audit, sink = min((h for h in (self.layer[START], self.layer[ASSISTANT]) if h is not None), key=_FIRST)
        return cost, "".join(self.settled) + audit, sink.result()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost (a dropped row: it only tells that the conversation exists), the faults
    decided by crc32 of ``conv_id:turn`` modulo 20."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.encode(F.concat_ws(":", one("conv_id"), one("turn")), "utf-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), one("role").alias("role"), one("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("lost"), "k")
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("k") == 3).cast("int")))).drop("k")


def _faults(rows: DataFrame) -> DataFrame:
    """blank, again (role and text seen earlier in the conversation) and cut, dealt by conversation and in order."""
    bare = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select("conv_id", "turn", "role", "text", "lost", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(ENDS)).alias("cut"))
    rows = rows.withColumn("same", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))).repartition("conv_id")
    # the same dealing serves the window, which sorts again inside the partitions
    nth = F.row_number().over(Window.partitionBy("conv_id", "lost", "same").orderBy(F.asc_nulls_first("turn")))
    rows = rows.withColumn("again", nth > 1).drop("same")
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")


def repair(rows: DataFrame, with_turns: bool = False) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text; optionally lost): gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256; with_turns also the repaired turns."""
    bounded_batches(rows.sparkSession)
    if "lost" not in rows.columns:
        rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("lost"))
    kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))] * with_turns
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "turns"][: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = None

        def close() -> None:
            cost, audit, kept = state["repair"].result()
            if with_turns:
                whole = TurnHash()
                for role, text in kept:
                    whole = whole.add(role, text)
                kept = (whole.result(), [{"role": r, "text": t} for r, t in kept])
            gaps = 0 if state["high"] is None else state["high"] - state["low"] + 1 - state["distinct"]
            out.append((state["id"], gaps, *state["counts"], state["illegal"], cost, audit, *(kept if with_turns else (kept,))))

        for b in batches:
            for conv, turn, role, text, lost, blank, cut, again in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state["id"] != conv:
                    if state is not None:
                        close()
                    state = {"id": conv, "low": None, "high": None, "distinct": 0, "counts": [0, 0, 0], "illegal": 0, "initial": None, "repair": Repair(TurnList if with_turns else TurnHash)}
                if lost:
                    continue
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"], state["distinct"] = turn, state["distinct"] + 1
                fault = 0 if blank else 1 if again else 2 if cut else None
                if fault is not None:
                    state["counts"][fault] += 1
                if state["initial"] is not None and state["initial"] + role[:1] not in LEGAL:
                    state["illegal"] += 1
                state["initial"] = role[:1]
                state["repair"].turn(role, text, fault in (0, 1), fault == 2)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out.clear()
        if state is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _faults(rows).mapInArrow(run, schema + ", turns array<struct<role string, text string>>" * with_turns)
