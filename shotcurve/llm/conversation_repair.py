"""Repair of conversations whose rows are lost, blank, repeated, cut short or under the wrong role.

A repaired conversation has roles s?(ua)+ or no rows. Rows are kept, given another
role or deleted, empty rows inserted, at the least cost; of equal costs the edits
whose initials (K, R, D, I, in order) are ASCII-least.

The repair grammar in Chomsky normal form has a nonterminal for each way a span of
rows may be repaired: by its first and last role, which alternate between (XY -> XZ Z'Y
with Z' following Z), or by no row at all (N). A cell holds the least (cost, edits)
of a nonterminal over a span; its insertion closure adds rows before and after.
A chart is filled bottom-up by span length, with every cut of every span of up to
BLOCK rows. Charts are remembered by the span's faults and initials, which few spans
do not share. The nonterminals tell all that a neighbour needs to know, so every cut
of a span gives the same cell; blocks are therefore joined two by two, then spans of
tasks, so a conversation of any length is parsed by many tasks.

Steps: rows without texts, equal ones counted and not repeated, are sorted over all
partitions by conversation and turn; each task parses its part of a conversation, and
the parts, one row per task and conversation, are joined. Only then are texts read,
in the order of rows next to their edits, and hashed as they pass: a SHA-256 has to
read its text in order, so this one pass takes a conversation in one task, without
holding more than a batch of it besides its edits.

Defined results: null roles, texts, ids and turns of rows are damaged like one space;
a null conv_id is a conversation of its own; null turns come first; rows of one turn
are ordered by role and digest of the text, equal ones count as copies; a role with
other initials can be changed or deleted only; empty texts are blank; a conversation
without rows has no faults, no edits and the hash of the empty text; an empty table
gives no rows. Only the four columns are read, others may have any name.
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotcurve.scratch import stored

# rows of a span whose chart has every cut
BLOCK = 8
CHANGE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
NOT_SPACE = r"[^\x20\x09-\x0D]"
FOLLOWS = {"s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}

# nonterminals: no rows, or first and last initial
EMPTY = ""
KINDS = [EMPTY, "uu", "ua", "au", "aa", "ss", "su", "sa"]
RULES = [(x, y, x + y if not x or not y else x[0] + y[1]) for x in KINDS for y in KINDS
         if not x or not y or FOLLOWS[x[1]] == y[0]]
ACCEPTED = (EMPTY, "ua", "sa")


# cells: {nonterminal: (cost, edits)}

def offer(cell: dict, kind: str, cost: int, edits: str) -> bool:
    if kind in cell and cell[kind] <= (cost, edits):
        return False
    cell[kind] = cost, edits
    return True


def closed(cell: dict) -> dict:
    """With empty rows inserted before and after, as long as that makes anything cheaper."""
    todo = list(cell)
    while todo:
        kind = todo.pop()
        cost, edits = cell[kind]
        for role in "ua":
            if not kind or FOLLOWS[role] == kind[0]:
                if offer(cell, role + (kind[1:] or role), cost + INSERT, "I" + edits):
                    todo.append(role + (kind[1:] or role))
            if not kind or FOLLOWS[kind[1]] == role:
                if offer(cell, (kind[:1] or role) + role, cost + INSERT, edits + "I"):
                    todo.append((kind[:1] or role) + role)
    return cell


def join(left: dict, right: dict, into: dict | None = None) -> dict:
    """All rules with two nonterminals, over a span and the next one."""
    cell = {} if into is None else into
    for x, y, z in RULES:
        if x in left and y in right:
            offer(cell, z, left[x][0] + right[y][0], left[x][1] + right[y][1])
    return cell


def leaf(symbol: str, count: int = 1) -> dict:
    """A row by its symbol: d must be deleted (count such rows); else the role's initial,
    a capital one if the row is cut short, x or X for roles that cannot stay."""
    cell = {EMPTY: (DELETE * count, "D" * count)}
    if symbol != "d":
        more = CUT_SHORT if symbol.isupper() else 0
        initial = symbol.lower()
        for role in "ua":
            offer(cell, 2 * role, CHANGE + more, "R")
        if initial in FOLLOWS:
            offer(cell, 2 * initial, more, "K")
    return closed(cell)


class Charts:
    """Cells of spans of up to BLOCK rows, by the symbols of the rows."""

    def __init__(self, remembered: int = 200_000):
        self.cells, self.remembered = {}, remembered

    def parse(self, symbols: str) -> dict:
        cell = self.cells.get(symbols)
        if cell is None:
            if len(self.cells) > self.remembered:
                self.cells.clear()
            for length in range(1, len(symbols) + 1):
                for start in range(len(symbols) - length + 1):
                    span = symbols[start:start + length]
                    if span not in self.cells:
                        if length == 1:
                            self.cells[span] = leaf(span)
                        else:
                            made = {}
                            for cut in range(1, length):
                                join(self.cells[span[:cut]], self.cells[span[cut:]], made)
                            self.cells[span] = closed(made)
            cell = self.cells[symbols]
        return cell


def joined(cells: list) -> dict:
    """The cell of neighbouring spans, joined two by two."""
    while len(cells) > 1:
        cells = [closed(join(*cells[i:i + 2])) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: dict) -> tuple[int, str]:
    return min(cell[kind] for kind in ACCEPTED if kind in cell)


# rows

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows by crc32 of "conv_id:turn" modulo 20 lost (0 copies),
    emptied, without sentence ends, repeated (2 copies) or under the role user."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    draw = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", draw.alias("draw"), spaced["role"].alias("role"), spaced["text"].alias("text")).select(
        "conv_id", "turn",
        F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).alias("copies"))


def equal_rows() -> list[Column]:
    """What rows of one turn are ordered by, and what makes them equal."""
    return [F.col("role"), F.unhex(F.sha2("text", 256)).alias("digest")]


def marked_rows(rows: DataFrame) -> DataFrame:
    """One row per (conv_id, turn, role, digest) with its symbol, the role's initial and the
    number of copies."""
    last = F.regexp_extract("text", rf"({NOT_SPACE})[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    keep = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(last == "", "d").when(last.isin(".", "!", "?"), keep).otherwise(F.upper(keep))
    marked = rows.select("conv_id", "turn", *equal_rows(), symbol.alias("symbol"), initial.alias("initial"), "copies")
    return marked.groupBy("conv_id", "turn", "role", "digest", "symbol", "initial").agg(F.sum("copies").alias("copies"))


def with_repeats(marked: DataFrame) -> DataFrame:
    """Adds later: whether an earlier turn has the role and text. Only those that stand in several
    turns are looked up; their table is stored, so that its size decides how it is joined."""
    key = ["conv_id", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeats = marked.filter("copies > 0 and symbol <> 'd'").groupBy(*key).agg(
        F.min(place).alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    repeats = stored(repeats.select("earliest", *[F.col(c).alias(f"of_{c}") for c in key]), "repeats")
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return marked.join(repeats, same, "left").select(
        *[F.col(c) for c in marked.columns], F.coalesce(F.col("earliest") < place, F.lit(False)).alias("later"))


COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
SPAN = (", ".join(f"{c} bigint" for c in [*COUNTS, "first_turn", "last_turn"])
        + ", first string, last string, cells map<string, struct<cost: bigint, edits: string>>")


class Span:
    """The rows of a conversation that one task sees, parsed as they come."""

    def __init__(self, charts: Charts):
        self.charts, self.block, self.cells = charts, [], []
        self.facts = dict.fromkeys(COUNTS, 0) | dict.fromkeys(["first_turn", "last_turn", "first", "last"])

    def add(self, turn, initial: str, symbol: str, copies: int, later: bool) -> None:
        facts = self.facts
        if turn is not None and turn != facts["last_turn"]:
            facts["turns"] += 1
            facts["last_turn"] = turn
            if facts["first_turn"] is None:
                facts["first_turn"] = turn
        if facts["last"] is None:
            facts["first"] = initial
        elif FOLLOWS.get(facts["last"]) != initial:
            facts["illegal"] += 1
        facts["last"] = initial
        facts["illegal"] += copies - 1
        # of equal rows the first may stay, unless an earlier turn has it
        deleted = copies if symbol == "d" or later else copies - 1
        facts["blank" if symbol == "d" else "duplicate"] += deleted
        if deleted < copies:
            facts["truncated"] += symbol.isupper()
            self.push(symbol)
        if deleted > BLOCK:
            self.flush()
            self.cells.append(leaf("d", deleted))
        else:
            for _ in range(deleted):
                self.push("d")

    def push(self, symbol: str) -> None:
        self.block.append(symbol)
        if len(self.block) == BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.cells.append(self.charts.parse("".join(self.block)))
            self.block = []

    def row(self) -> dict:
        self.flush()
        cell = joined(self.cells) if self.cells else {}
        return {**self.facts, "cells": [(k, {"cost": c, "edits": e}) for k, (c, e) in cell.items()]}


def _parse_parts():
    """mapInArrow function: sorted rows -> one span per conversation of the task."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, charts = TaskContext.get().partitionId(), Charts()
        whole = pa.int64()
        schema = pa.schema([
            ("conv_id", whole), ("part", pa.int32()), *[(c, whole) for c in [*COUNTS, "first_turn", "last_turn"]],
            ("first", pa.string()), ("last", pa.string()),
            ("cells", pa.map_(pa.string(), pa.struct([("cost", whole), ("edits", pa.string())])))])
        current, span, out = None, None, []
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if span is None or conv_id != current:
                    if span is not None:
                        out.append({"conv_id": current, "part": part, **span.row()})
                    current, span = conv_id, Span(charts)
                if row[3]:
                    span.add(*row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if span is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "part": part, **span.row()}], schema=schema)

    return run


def parse(marked: DataFrame) -> DataFrame:
    """conv_id, part, span: the spans of all conversations, one per task that has rows of it."""
    order = ["conv_id", "turn", "role", "digest"]
    rows = with_repeats(marked).repartitionByRange(*order).sortWithinPartitions(*order)
    spans = rows.select("conv_id", "turn", "initial", "symbol", "copies", "later").mapInArrow(
        _parse_parts(), f"conv_id bigint, part int, {SPAN}")
    return spans.select("conv_id", "part", F.struct(*[c for c in spans.columns[2:]]).alias("span"))


class Repair:
    """A conversation's spans joined, and its rows hashed as they pass."""

    def __init__(self):
        self.spans, self.edits, self.hash, self.role, self.empty = [], None, hashlib.sha256(), "u", True

    def decide(self) -> None:
        spans = [s for s in self.spans if s["cells"]]
        self.facts = {c: sum(s[c] for s in spans) for c in COUNTS}
        self.facts["illegal"] += sum(FOLLOWS.get(a["last"]) != b["first"] for a, b in zip(spans, spans[1:]))
        timed = [s for s in spans if s["turns"]]
        shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        turns = self.facts.pop("turns") - shared
        self.facts["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
        cells = [{k: (c["cost"], c["edits"]) for k, c in s["cells"]} for s in spans]
        self.cost, self.edits = cheapest(joined(cells)) if cells else (0, "")
        self.spans, self.at = [], 0

    def write(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + role.encode() + b":" + text.encode())
        self.empty = False
        self.role = FOLLOWS[role[0]]

    def insert(self) -> None:
        while self.edits[self.at:self.at + 1] == "I":
            self.write(ROLES[self.role], "")
            self.at += 1

    def add(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.insert()
            edit = self.edits[self.at]
            self.at += 1
            if edit != "D":
                self.write(role if edit == "K" else ROLES[self.role], text)

    def row(self) -> dict:
        if self.edits is None:
            self.decide()
        self.insert()
        return {**self.facts, "cost": self.cost, "audit": self.edits, "repaired_sha256": self.hash.hexdigest()}


def _apply():
    """mapInArrow function: each conversation's spans, then its rows -> its facts, edits and hash."""

    def run(batches):
        import pyarrow as pa

        whole = pa.int64()
        schema = pa.schema([("conv_id", whole), *[(c, whole) for c in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            ("audit", pa.string()), ("repaired_sha256", pa.string())])
        current, repair, out = None, None, []
        for batch in batches:
            for conv_id, span, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if repair is None or conv_id != current:
                    if repair is not None:
                        out.append({"conv_id": current, **repair.row()})
                    current, repair = conv_id, Repair()
                if span is not None:
                    repair.spans.append(span)
                else:
                    if repair.edits is None:
                        repair.decide()
                    repair.add(role, text, copies)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if repair is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, **repair.row()}], schema=schema)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """Facts, edits and hash of every conversation of rows (conv_id, turn, role, text, copies).

    Output: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spans = parse(stored(marked_rows(rows), "conversation-rows"))
    texts = rows.filter("copies > 0").select("conv_id", "turn", "text", "copies", *equal_rows())
    both = spans.unionByName(texts, allowMissingColumns=True)
    order = ["conv_id", F.col("span").isNull(), "part", "turn", "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "span", "role", "text", "copies").mapInArrow(
        _apply(), "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                  "cost bigint, audit string, repaired_sha256 string")
