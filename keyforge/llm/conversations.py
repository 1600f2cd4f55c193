"""Conversation structure repair by secondary-sorted streaming (operator 13).

Rows are dealt by conversation and sorted by turn; ``mapInPandas`` carries the
state of a dynamic program over the rows across Arrow batches.  The program's
states are what a valid conversation may have said last: nothing, a system
message, a user, an assistant.  From each state only one role can be inserted
or given to a row, so the letters of the edits (Delete, Insert, Keep, Rerole)
fix the result.  Per state only the cheapest and then ASCII-least way is kept:
its cost, its place in the order of the four ways, a digest of the repaired
text so far, and one byte per row that says where it came from.  These bytes
spill to an unnamed file for giant conversations; texts are never held.

Rules of order: rows by turn (nulls first), then role, then text, then copy.  A
row is a duplicate if a row before it has its role and text; equal rows of one
turn follow each other, so that a comparison with the row before finds these,
and a small table of first turns finds the others.  A null id is one
conversation of its own.  Null roles and texts count as one space.  An empty
table gives an empty result.  Other columns do not take part, whatever their
names.  Ids and turns are integers.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyforge.llm.common import SPACE_CHARS, ship, small_batches

ship(__name__)

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: States of the program: last role said.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be inserted or given in each state, and the state behind it.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
#: The state behind a kept row, by state and initial.
KEPT = {(START, "s"): SYSTEM} | {(s, NEXT_ROLE[s][0]): NEXT_STATE[s] for s in range(4)}
LEGAL = {"su", "ua", "au"}
#: Inserts before a row that can differ in their result: a third leads back to the state behind the first.
MOST_INSERTS = 2
#: Bytes of back pointers held in memory per conversation.
SPILL_BYTES = 8 << 20
_LETTERS = [("I" * n + letter) for n in range(MOST_INSERTS + 1) for letter in "DKR"]


def sentence_end(text: Column) -> Column:
    """Whether the last character that is not white space ends a sentence."""
    return F.rtrim(text, F.lit(SPACE_CHARS)).rlike(r"[.!?]\z")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the damage that the hash of id and turn
    names.  Dropped rows stay with ``dropped`` set, so that no conversation is lost."""
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    harm = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20
    clean = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm").isin(0, 1), "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return clean.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), F.explode(copies).alias("copy"))


def with_seen(rows: DataFrame) -> DataFrame:
    """Rows with ``seen``: the same role and text stand in an earlier turn."""
    key = [F.col("conv_id"), F.col("role"), F.sha2("text", 256).alias("digest")]
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = rows.where(~F.col("dropped")).select(*key, turn.alias("at")).groupBy("conv_id", "role", "digest") \
        .agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    left = rows.withColumn("digest", F.sha2("text", 256)).alias("l")
    firsts = firsts.alias("f")
    same = F.expr("l.conv_id <=> f.conv_id and l.role = f.role and l.digest = f.digest")
    return left.join(firsts, same, "left").select("l.conv_id", "l.turn", "l.role", "l.text", "l.dropped", "l.copy", F.coalesce(
        F.struct(F.col("l.turn").isNotNull().alias("known"), F.col("l.turn").alias("turn")) > F.col("f.first"), F.lit(False)).alias("seen"))


class Repair:
    """The program over the rows of one conversation."""

    def __init__(self) -> None:
        #: Per state: cost, place in the order of the ways, digest; None if it cannot be reached.
        self.ways: list = [(0, 0, None), None, None, None]
        self.pointers = tempfile.SpooledTemporaryFile(max_size=SPILL_BYTES)  # noqa: SIM115 - closed by ``audit``
        self.n = 0

    @staticmethod
    def said(digest, lines: list[bytes]):
        """The digest of a repaired text with lines added."""
        if not lines:
            return digest
        if digest is None:
            new = hashlib.sha256(b"\n".join(lines))
        else:
            new = digest.copy()
            new.update(b"\n" + b"\n".join(lines))
        return new

    def inserted(self) -> list[tuple[int, int, int, str, int]]:
        """From each way, with 0, 1 or 2 inserts: cost, place, state, letters, state before."""
        out = []
        for s, way in enumerate(self.ways):
            if way is not None:
                at = s
                for n in range(MOST_INSERTS + 1):
                    out.append((way[0] + n * INSERT_COST, way[1], at, "I" * n, s))
                    at = NEXT_STATE[at]
        return out

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: list = [None] * 4
        more = TRUNCATED_COST if truncated else 0
        for cost, place, at, letters, before in self.inserted():
            choices = [("D", DELETE_COST, at)]
            if not must_go:
                kept = KEPT.get((at, role[:1]))
                if kept is not None:
                    choices.append(("K", KEEP_COST + more, kept))
                choices.append(("R", REROLE_COST + more, NEXT_STATE[at]))
            for letter, price, to in choices:
                way = (cost + price, place, letters + letter, before)
                if best[to] is None or way < best[to]:
                    best[to] = way
        order = sorted((w[1], w[2]) for w in best if w is not None)
        ways, pointer = [], bytearray(4)
        for s, way in enumerate(best):
            if way is None:
                ways.append(None)
                continue
            cost, place, letters, before = way
            pointer[s] = before << 4 | _LETTERS.index(letters)
            at, lines = before, []
            for _ in letters[:-1]:
                lines.append(NEXT_ROLE[at].encode() + b":")
                at = NEXT_STATE[at]
            if letters[-1] != "D":
                lines.append(f"{role if letters[-1] == 'K' else NEXT_ROLE[at]}:{text}".encode())
            ways.append((cost, order.index((place, letters)), self.said(self.ways[before][2], lines)))
        self.ways = ways
        self.pointers.write(pointer)
        self.n += 1

    def audit(self) -> tuple[int, str, str]:
        """Cost, letters, and digest of the repaired text of the best way."""
        cost, _, letters, before, at = min((cost, place, letters, before, at) for cost, place, at, letters, before in self.inserted() if at in (START, ASSISTANT))
        lines, state = [], before
        for _ in letters:
            lines.append(NEXT_ROLE[state].encode() + b":")
            state = NEXT_STATE[state]
        digest = self.said(self.ways[before][2], lines)
        parts, step = [letters], 1 << 16
        for end in range(self.n, 0, -step):  # back through the pointers, a stretch at a time
            begin = max(0, end - step)
            self.pointers.seek(begin * 4)
            stretch, found = self.pointers.read((end - begin) * 4), []
            for k in range(end - begin - 1, -1, -1):
                pointer = stretch[4 * k + before]
                found.append(_LETTERS[pointer & 15])
                before = pointer >> 4
            parts.append("".join(reversed(found)))
        self.pointers.close()
        return cost, "".join(reversed(parts)), (digest or hashlib.sha256()).hexdigest()


class Conversation:
    """Counts and repair of the rows of one conversation, in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.turns, self.initial = 0, None

    def add(self, turn, role: str, text: str, blank: bool, seen: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        twice = seen or self.last == (turn, role, text)
        self.last = (turn, role, text)
        self.blank += blank
        self.duplicate += twice and not blank
        short = cut and not (blank or twice)
        self.truncated += short
        self.repair.row(role, text, blank or twice, short)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.audit())


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_SCHEMA = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in RESULT)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current: Conversation | None = None
    for batch in batches:
        done = []
        ids = [None if pd.isna(x) else int(x) for x in batch["conv_id"]]
        turns = [None if pd.isna(x) else int(x) for x in batch["turn"]]
        rest = (batch[c].tolist() for c in ("role", "text", "blank", "seen", "cut", "dropped"))
        for conv_id, turn, role, text, blank, seen, cut, dropped in zip(ids, turns, *rest, strict=True):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    done.append(current.result())
                current = Conversation(conv_id)
            if not dropped:
                current.add(turn, role, text, blank, seen, cut)
        if done:
            yield pd.DataFrame(done, columns=RESULT).astype({"conv_id": "Int64"})
    if current is not None:
        yield pd.DataFrame([current.result()], columns=RESULT).astype({"conv_id": "Int64"})


def in_order(rows: DataFrame) -> DataFrame:
    """Damaged rows dealt by conversation and sorted within it, with their faults."""
    blank = F.trim(F.col("text"), F.lit(SPACE_CHARS)) == ""
    typed = rows.withColumn("conv_id", F.col("conv_id").cast("bigint")).withColumn("turn", F.col("turn").cast("bigint"))
    marked = with_seen(typed).select("conv_id", "turn", "role", "text", "copy", "dropped", "seen", blank.alias("blank"), (~sentence_end(F.col("text"))).alias("cut"))
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: counts of faults, cost and letters of the cheapest edits
    and the digest of the repaired text.  ``rows`` come from ``damaged``, or have
    ``conv_id, turn, role, text, dropped, copy`` of their own."""
    small_batches(rows.sparkSession)
    return in_order(rows).mapInPandas(_stream, _SCHEMA)


def repaired_rows(rows: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``, inserted
    rows with empty text.  Edits are read from the audit: row ``k`` of a
    conversation has its ``k``-th letter other than I with the inserts before it."""
    repairs = repair(rows) if repairs is None else repairs
    steps = repairs.select("conv_id", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0))).alias("k", "letters"))
    window = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    numbered = in_order(rows).where(~F.col("dropped")).withColumn("k", F.row_number().over(window) - 1).select("conv_id", "k", "role", "text")
    both = steps.alias("s").join(numbered.alias("r"), F.expr("s.conv_id <=> r.conv_id and s.k = r.k"), "left").select("s.conv_id", "s.k", "letters", "role", "text")
    said = both.select("conv_id", "k", F.posexplode(F.split(F.regexp_replace("letters", "(.)(?=.)", "$1,"), ",")).alias("j", "edit"), "role", "text").where("edit <> 'D'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("k", "j")) - 1
    # a kept system row comes first; behind it users and assistants take turns
    system = F.max(F.when((F.col("edit") == "K") & (F.substring("role", 1, 1) == "s"), 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    said = said.withColumn("place", place).withColumn("due", F.when((F.col("place") - system) % 2 == 0, "user").otherwise("assistant"))
    return said.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("due")).alias("role"),
                       F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
