"""Conversation structure: faults of rows, and the cheapest edits to ``(s?(ua)+)?`` (an optional system turn, then user and assistant in turn).

Edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2; a blank or duplicate row must be deleted); Insert (5) puts an empty
user or assistant row anywhere; a truncated row that is not deleted costs 5 more. Of the cheapest edits those with the least
string of initials are taken.

Four Russians: a row is one of ten symbols, and what the rest of a conversation costs is a vector over the four states (nothing yet, after
system, after user, after assistant). Less its least entry a vector is one of few; for every such vector and every block of
``BLOCK`` symbols the vector before the block and what it adds are computed once. A conversation is gone through from its end, one lookup
a block. Then blocks are expanded one after the other, each backward from the vector after it, and traced: in every state an edit leads
to one next state, so the first initial in ASCII order that lies on a cheapest path is the right one.

How it runs: rows are narrowed to symbols and dealt out by conversation, sorted; the audit of a conversation and the hash of its
repaired text are one value each, so one task streams a conversation and holds one byte per row. Texts go once to the task that hashes
them, row by row, behind the audit of their conversation; no conversation is collected.

Defined results: null role or text is one space; rows without turn come first; rows of one turn come by role, then by a hash of the text; a
null conversation id is one conversation; repeated rows are duplicates; a role other than system, user and assistant is told by its
first character; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, stage

BLOCK = 4
SYMBOLS = 10  # 0 nothing, 1 must go, 2.. role (s, u, a, other) and 4 more when truncated
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
NEXT = (2, 2, 3, 2)  # state after the row that may come next: user, but assistant after user
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def _step(after: np.ndarray, symbol: int) -> np.ndarray:
    """Costs before a row from the costs after it, inserts before it included."""
    if symbol == 0:
        return after
    best = after + DELETE
    if symbol >= 2:
        role, extra = (symbol - 2) % 4, CUT * (symbol >= 6)
        for state in range(4):
            best[state] = min(best[state], REROLE + extra + after[NEXT[state]])
            if role == 0 and state == 0:
                best[state] = min(best[state], extra + after[1])
            if role in (1, 2) and NEXT[state] == role + 1:
                best[state] = min(best[state], extra + after[NEXT[state]])
    for _ in range(3):  # inserts lead from state to state at most three times
        best = np.minimum(best, INSERT + best[list(NEXT)])
    return best


class Tables:
    """Vectors, and for (vector, block) the vector before the block and the cost it adds. Blocks are numbers in base ``SYMBOLS``, first symbol first."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        least = int(END.min())
        number = {tuple(END - least): 0}
        self.vectors = [tuple(int(x) for x in END - least)]
        step, add = [], []
        for v in self.vectors:  # grows while new vectors are met
            rows = [_step(np.array(v, np.int64), s) for s in range(SYMBOLS)]
            lows = [int(r.min()) for r in rows]
            for r, lo in zip(rows, lows):
                key = tuple(int(x) for x in r - lo)
                if key not in number:
                    number[key] = len(self.vectors)
                    self.vectors.append(key)
            step.append([number[tuple(int(x) for x in r - lo)] for r, lo in zip(rows, lows)])
            add.append(lows)
        self.step, self.add = np.array(step), np.array(add)
        to, cost = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(block):  # one more symbol in front
            to, cost = self.step[to].transpose(0, 2, 1), cost[:, None, :] + self.add[to].transpose(0, 2, 1)
            to, cost = to.reshape(len(self.vectors), -1), cost.reshape(len(self.vectors), -1)
        self.to, self.cost = to.tolist(), cost.tolist()
        self.step, self.add = self.step.tolist(), self.add.tolist()

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Cost and initials of the cheapest edits."""
        body = bytes(-len(symbols) % self.block) + symbols
        blocks = []
        for i in range(0, len(body), self.block):
            n = 0
            for x in body[i:i + self.block]:
                n = n * SYMBOLS + x
            blocks.append(n)
        at, total, after = 0, 0, [0] * len(blocks)
        for i in range(len(blocks) - 1, -1, -1):
            after[i] = at
            total += self.cost[at][blocks[i]]
            at = self.to[at][blocks[i]]
        out: list[str] = []
        state = 0
        total += self.vectors[at][0]
        for i, v in enumerate(after):
            part = body[i * self.block:(i + 1) * self.block]
            path = [v]
            for x in reversed(part):  # the block is expanded backward from the vector after it
                path.append(self.step[path[-1]][x])
            path.reverse()
            for x, here, then in zip(part, path, path[1:]):
                if x:
                    state = self._edit(x, here, then, state, out)
        while END[state]:
            out.append("I")
            state = NEXT[state]
        return total, "".join(out)

    def _edit(self, symbol: int, here: int, then: int, state: int, out: list[str]) -> int:
        """Edits up to and with one row, appended; the state after it."""
        now, after, add = self.vectors[here], self.vectors[then], self.add[then][symbol]
        role, extra = (symbol - 2) % 4, CUT * (symbol >= 6)
        while True:
            cost = now[state] + add
            if DELETE + after[state] == cost:
                out.append("D")
                return state
            if INSERT + now[NEXT[state]] + add == cost:
                out.append("I")
                state = NEXT[state]
                continue
            kept = 1 if role == 0 and state == 0 else NEXT[state] if role in (1, 2) and NEXT[state] == role + 1 else None
            if symbol >= 2 and kept is not None and extra + after[kept] == cost:
                out.append("K")
                return kept
            out.append("R")
            return NEXT[state]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults planted by crc32(`conv:turn`) mod 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away,
    3 repeats it, 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", space(conv), space(turn)).cast("binary")) % 20
    d = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), code.alias("_b_code")).filter("_b_code != 0")
    body = F.when(F.col("_b_code") == 1, "").when(F.col("_b_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.withColumn("text", body).withColumn("role", F.when(F.col("_b_code") == 4, "user").otherwise(F.col("role")))
    return d.withColumn("_b_copy", F.explode(F.when(F.col("_b_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text")


def _key(c: Column) -> Column:
    """A string that stands for a conversation id, null included."""
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string")))


ORDER = ["key", "kind", "has_turn", "turn", "role", "k1", "k2"]
AUDIT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, gaps long"


def _rows(rows: DataFrame) -> DataFrame:
    t = F.col("text")
    return rows.select(
        _key(F.col("conv")).alias("key"), F.col("turn").isNotNull().cast("int").alias("has_turn"), F.col("turn").cast("long").alias("turn"), F.col("role"), t.alias("text"),
        F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Conversation key, counts of faults, cost and initials of the edits, missing turns."""
    tables = rows.sparkSession.sparkContext.broadcast(Tables(block))  # some vectors x 10 ** block entries
    n = rows.withColumn("blank", ~F.col("text").rlike(f"[^{SPACE}]")).withColumn("ended", F.col("text").rlike(f"[.!?][{SPACE}]*+\\z")).drop("text")
    # a row is a duplicate when role and text stand in an earlier turn; copies within a turn follow each other and are seen in passing
    who = ["key", "role", "k1", "k2"]
    at = F.struct("has_turn", "turn")
    again = n.groupBy(*who).agg(F.min(at).alias("f"), F.max(at).alias("l")).filter("f != l").select(*who, "f")
    n = n.join(again, who, "left").select(
        "key", F.lit(0).alias("kind"), "has_turn", "turn", "role", "k1", "k2", "blank", "ended", (F.col("f").isNotNull() & ~F.col("f").eqNullSafe(at)).alias("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = tables.value.solve
        key, symbols, counts, turns, before, initial = None, bytearray(), [0, 0, 0, 0], [None, None, 0], None, ""
        out: list[tuple] = []

        def close() -> None:
            cost, audit = solve(bytes(symbols))
            lo, hi, different = turns
            out.append((key, *counts, cost, audit, hi - lo + 1 - different if different else 0))

        def given() -> pa.RecordBatch:
            types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], [c.split(" ")[0] for c in AUDIT.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        close()
                    key, symbols, counts, turns, before, initial = r["key"], bytearray(), [0, 0, 0, 0], [None, None, 0], None, None
                same = (r["has_turn"], r["turn"], r["role"], r["k1"], r["k2"])
                duplicate = r["later"] or same == before
                if r["turn"] is not None:
                    if turns[2] == 0:
                        turns[0] = r["turn"]
                    if turns[2] == 0 or r["turn"] != turns[1]:
                        turns[2] += 1
                    turns[1] = r["turn"]
                fault = 0 if r["blank"] else 1 if duplicate else 2 if not r["ended"] else None
                if fault is not None:
                    counts[fault] += 1
                own = r["role"][:1]
                if initial is not None and initial + own not in ("su", "ua", "au"):
                    counts[3] += 1
                symbols.append(1 if fault in (0, 1) else 2 + {"s": 0, "u": 1, "a": 2}.get(own, 3) + 4 * (fault == 2))
                before, initial = same, own
            if len(out) > 4096:
                yield given()
                out.clear()
        if key is not None:
            close()
        if out:
            yield given()

    return n.repartition("key").sortWithinPartitions(*ORDER).mapInArrow(run, AUDIT)


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, sha): hash of the repaired rows `role:text`, joined by line feeds; each conversation's audit comes before its rows, which are hashed in passing."""
    null = lambda t: F.lit(None).cast(t)
    lead = found.select("key", F.lit(0).alias("kind"), F.lit(0).alias("has_turn"), null("long").alias("turn"), null("string").alias("role"), null("long").alias("k1"), null("long").alias("k2"), F.col("audit").alias("text"))
    every = lead.unionByName(rows.withColumn("kind", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, digest, first = None, "", 0, 0, hashlib.sha256(), True
        out: list[tuple] = []

        def line(role: str, text: str) -> None:
            nonlocal first
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                line("user" if state == 2 else "assistant", "")
                at += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if key is not None:
                        inserts()
                        out.append((key, digest.hexdigest()))
                    key, audit, at, state, digest, first = r["key"], r["text"], 0, 0, hashlib.sha256(), True
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "K":
                    state = 1 if r["role"][:1] == "s" else NEXT[state]
                    line(r["role"], r["text"])
                else:
                    state = NEXT[state]
                    line("user" if state == 2 else "assistant", r["text"])
        if key is not None:
            inserts()
            out.append((key, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], ["key", "sha"])

    return every.repartition("key").sortWithinPartitions(*ORDER).select("key", "kind", "role", "text").mapInArrow(run, "key string, sha string")


def repair(rows: DataFrame, every: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Faults and repair of each conversation of ``rows`` (conv, turn, role, text); ``every`` names the conversations to report, also those without rows."""
    r = _rows(rows)
    found = stage(audits(r), "audits")
    hashed = repaired_hashes(r, found)
    all_ids = every.select(F.col(conv).alias("conv_id")).distinct().withColumn("key", _key(F.col("conv_id")))
    out = all_ids.join(found, "key", "left").join(hashed, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
