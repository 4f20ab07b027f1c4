"""Repair of conversation structure: the cheapest edits that make the roles of a conversation an optional system turn and then user and assistant in turn.

A conversation is a string of signatures, one letter a row for the initial of its role and its fault. What a row costs depends only on what
comes after it, so conversations share their ends: they are sorted by their reversed strings, and a task keeps the nodes of one string's
suffixes, of which the next string keeps those that they have in common. Each node of this suffix-sharing automaton is computed
once, with the cost to go and the first edit of the best rest for each state of the role grammar; an audit is read along the nodes.

Rows are put in order by a range partitioning over conversation and turn, so a conversation may be cut over many tasks;
only its string, a letter a row like its audit, comes together. The last pass streams each conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.llm.scratch import save

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of role initials and of faults; a row's symbol is the letter at 4 * fault + initial.
INITIALS = "sua"
FINE, BLANK, DUPLICATE, CUT = range(4)
SYMBOLS = "ABCDEFGHIJKLMNOP"
#: For the automaton all rows that must go are alike.
MERGED = "ABCDEEEEEEEEMNOP"
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn. The role that comes next, other than system, and the state then.
EXPECTED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
#: The state after a kept row by its initial; -1 where it doesn't fit.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: Costs to go and first edits at the end of a conversation.
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and present: rows damaged by a hash of conversation and turn. Nulls of role and text are one space."""
    c = F.col
    k = F.crc32(F.concat_ws(":", *(F.coalesce(c(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))) % 20
    text = F.coalesce("text", F.lit(" "))
    made = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), k.alias("k"))
    return made.select("conv_id", "turn", F.when(c("k") == 4, "user").otherwise(c("role")).alias("role"),
                       F.when(c("k") == 1, "").when(c("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(c("text")).alias("text"), (c("k") != 0).alias("present"),
                       F.explode(F.sequence(F.lit(1), F.when(c("k") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _clean(rows: DataFrame, present: Column | None) -> DataFrame:
    """The columns that count, with the order of rows within a turn: (h, g), two hashes of role and text."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       F.coalesce(present, F.lit(False)).alias("present") if present is not None else F.lit(True).alias("present"))
    return rows.withColumns({"h": F.xxhash64(F.lit(1), "role", "text"), "g": F.xxhash64(F.lit(2), "text", "role")})


def _signed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, h, g, symbol (null for absent rows), before duplicates within one turn are seen."""
    c = F.col
    blank = ~c("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~c("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.expr(f"locate(substring(role, 1, 1), '{INITIALS}')")
    narrow = rows.select("conv_id", "turn", "h", "g", "present", F.when((c("role") == "") | (initial == 0), 3).otherwise(initial - 1).alias("initial"), F.when(blank, BLANK).when(cut, CUT).otherwise(FINE).alias("fault"))
    narrow = save(narrow, "turns")
    # of rows of equal role and text, those of later turns than the first repeat it
    same = (narrow.where("present").groupBy("conv_id", "h", "g").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where("first < last")
            .select(c("conv_id").alias("_conv"), c("h").alias("_h"), c("g").alias("_g"), "first"))
    on = c("conv_id").eqNullSafe(c("_conv")) & (c("h") == c("_h")) & (c("g") == c("_g"))
    later = F.coalesce(F.struct("turn") > c("first"), F.lit(False))
    fault = F.when((c("fault") != BLANK) & later, DUPLICATE).otherwise(c("fault"))
    joined = narrow.join(same, on, "left")
    return joined.select("conv_id", "turn", "h", "g", F.when(c("present"), 4 * fault + c("initial")).cast("int").alias("symbol"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows as strings of symbols: a piece for each conversation of a batch, with its turns counted."""
    task, seq = TaskContext.get().partitionId(), 0
    before = None
    for b in batches:
        conv, turn, h, g, symbol = (x.to_pylist() for x in b.columns)
        found: list[list] = []
        for row in zip(conv, turn, h, g, symbol, strict=True):
            if not found or found[-1][0] != row[0]:
                found.append([row[0], task, seq, [], None, None, 0])
                seq += 1
            s = row[4]
            if s is None:
                continue
            piece = found[-1]
            if row[:4] == before and s // 4 in (FINE, CUT):
                s = 4 * DUPLICATE + s % 4
            before = row[:4]
            piece[3].append(SYMBOLS[s])
            if row[1] is not None and row[1] != piece[5]:
                piece[4] = row[1] if piece[4] is None else piece[4]
                piece[5] = row[1]
                piece[6] += 1
        for p in found:
            p[3] = "".join(p[3])
        if found:
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["conv_id", "task", "seq", "symbols", "first", "last", "turns"])


def _node(symbol: str, after: tuple) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs to go and first edits by grammar state of a suffix, from its first symbol and the rest's node. On ties the edit whose letter is least."""
    cost, _ = after
    fault, initial = divmod(SYMBOLS.index(symbol), 4)
    base, edit = [DELETE + x for x in cost], ["D"] * 4
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for s in range(4):
            options = [(base[s], "D"), (REROLE + more + cost[AFTER[s]], "R")]
            if KEPT[s][initial] >= 0:
                options.append((KEEP + more + cost[KEPT[s][initial]], "K"))
            base[s], edit[s] = min(options)
    # two turns at most are worth inserting in one place
    final = [min(base[s], INSERT + base[AFTER[s]], 2 * INSERT + base[AFTER[AFTER[s]]]) for s in range(4)]
    for s in range(4):
        if INSERT + final[AFTER[s]] == final[s] and (base[s] > final[s] or edit[s] > "I"):
            edit[s] = "I"
    return tuple(final), tuple(edit)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in the order of their reversed strings; nodes[i] is that of the last i symbols."""
    nodes: list[tuple] = [END]
    known, audit = "", ""
    for b in batches:
        out = []
        for conv, back, pieces in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if back != known or not back:
                shared = len(commonprefix([back, known]))
                del nodes[shared + 1 :]
                for symbol in back[shared:]:
                    nodes.append(_node(symbol, nodes[-1]))
                known = back
                edits, state, at = [], 0, len(back)
                while e := nodes[at][1][state]:
                    edits.append(e)
                    if e == "K":
                        state = KEPT[state][SYMBOLS.index(back[at - 1]) % 4]
                    elif e in "IR":
                        state = AFTER[state]
                    at -= e != "I"
                audit = "".join(edits)
            raw = np.frombuffer("".join(p["symbols"] for p in pieces).encode(), np.uint8) - ord("A")
            fault = np.bincount(raw // 4, minlength=4)
            pair = raw[:-1] % 4 * 4 + raw[1:] % 4
            legal = (pair == 1) | (pair == 6) | (pair == 9)
            timed = [p for p in pieces if p["turns"]]
            turns = sum(p["turns"] for p in timed) - sum(p["last"] == q["first"] for p, q in zip(timed, timed[1:], strict=False))
            gaps = timed[-1]["last"] - timed[0]["first"] + 1 - turns if timed else 0
            out.append((conv, gaps, int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[CUT]), int((~legal).sum()), nodes[len(back)][0][0], audit))
        if out:
            kinds = (b.schema.field(0).type, *[pa.int64()] * 6, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _find(rows: DataFrame) -> DataFrame:
    order = ["conv_id", "turn", "h", "g"]
    signed = save(_signed(rows), "signed_turns")
    pieces = signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, f"conv_id {_kind(rows)}, task int, seq int, symbols string, first long, last long, turns long")
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("task", "seq", "symbols", "first", "last", "turns"))).alias("pieces"))
    text = F.translate(F.array_join(F.col("pieces.symbols"), ""), SYMBOLS, MERGED)
    strings = save(whole.select("conv_id", F.reverse(text).alias("back"), "pieces"), "strings")
    return strings.repartitionByRange("back", "conv_id").sortWithinPartitions("back").mapInArrow(_audits, f"conv_id {_kind(rows)}, {_REPORT}")


def find_edits(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows has conv_id, turn, role and text; other columns are ignored. ``present``: false for rows that are gone, whose conversations are still
    reported. Rows are ordered by turn, nulls first; those of one turn by a hash of role and text. Null roles and texts are one space; rows without a conv_id are
    one conversation. A role is known by its first letter; any other, or none, is illegal. An empty table gives an empty result, a conversation
    without present rows zeros and an empty audit. Texts of any length are judged as they are read; repeated rows are duplicates.
    """
    return _find(_clean(rows, present))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From each conversation's report and then its rows: ("report", row), then ("row", role, text) for those that stay or are put in, then ("end",)."""
    report, at, state, audit = None, 0, 0, ""

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            yield "row", EXPECTED[state], ""
            at, state = at + 1, AFTER[state]

    for b in batches:
        for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if not r[1]:
                if report is not None:
                    yield from inserted()
                    yield ("end",)
                report, at, state, audit = r, 0, 0, r[-1]
                yield "report", r
                continue
            yield from inserted()
            edit, at, role = audit[at], at + 1, r[2]
            if edit == "K":
                yield "row", role, r[3]
                state = KEPT[state][INITIALS.index(role[0])]
            elif edit == "R":
                yield "row", EXPECTED[state], r[3]
                state = AFTER[state]
    if report is not None:
        yield from inserted()
        yield ("end",)


def _met(rows: DataFrame) -> DataFrame:
    """Each conversation's report ahead of its present rows in order, texts shuffled once. A conversation is one task's, which streams it."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    found = _find(rows)
    empty = {x: F.lit(None).cast("string" if x == "audit" else "long") for x in names}
    body = rows.where("present").select("conv_id", F.lit(1).alias("kind"), "role", "text", "turn", "h", "g", *(v.alias(k) for k, v in empty.items()))
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), *(F.lit(None).cast("long").alias(x) for x in ("turn", "h", "g")), *names)
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "h", "g").drop("turn", "h", "g")


def report(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """What ``find_edits`` gives, and repaired_sha256 of the repaired ``role:text`` lines joined by newlines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, sha, first = None, [], None, True

        def pack():
            types = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return made

        def seen():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for what in _walk(seen()):
            if what[0] == "report":
                current, sha, first = what[1], hashlib.sha256(), True
            elif what[0] == "row":
                sha.update(f"{'' if first else chr(10)}{what[1]}:{what[2]}".encode())
                first = False
            else:
                out.append((current[0], *current[4:], sha.hexdigest()))
                if len(out) == 1000:
                    yield pack()
        if out:
            yield pack()

    rows = _clean(rows, present)
    return _met(rows).mapInArrow(run, f"conv_id {_kind(rows)}, {_REPORT}, repaired_sha256 string")


def repaired(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (0 up), role, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, size, conv, place = None, [], 0, None, 0

        def pack():
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])
            out.clear()
            return made

        def seen():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for what in _walk(seen()):
            if what[0] == "report":
                conv, place = what[1][0], 0
            elif what[0] == "row":
                out.append((conv, place, what[1], what[2]))
                place, size = place + 1, size + len(what[2]) + 64
                if size > 1 << 22:
                    yield pack()
                    size = 0
        if out:
            yield pack()

    rows = _clean(rows, present)
    return _met(rows).mapInArrow(run, f"conv_id {_kind(rows)}, place long, role string, text string")
