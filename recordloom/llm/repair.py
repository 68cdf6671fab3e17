"""Conversation structure repair: the cheapest edits that leave `(s?(ua)+)?`, found while rows stream by in order of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut_lineage

#: Costs of the edits, of an undeleted truncated row, and the edits' letters in ASCII order.
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
LETTERS = "DIKR"
_D, _I, _K, _R = range(4)
#: What is said so far: nothing, a system turn only, up to a user turn, up to an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a reroled or inserted turn; from any state only one role can follow by these.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: State after a kept turn, by state and the role that its initial stands for.
_KEPT = {(START, SYSTEM): SYSTEM, **{(q, USER): USER for q in (START, SYSTEM, ASSISTANT)}, (USER, ASSISTANT): ASSISTANT}
#: Costs that are left at the end of a conversation, by state: what is open is closed by insertion.
_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Rows and characters of one conversation that a task holds; a longer one hands its rows on with their back pointers.
HELD_ROWS, HELD_CHARS = 4096, 4 << 20
#: Rows and characters of a batch that leaves.
_OUT_ROWS, _OUT_CHARS = 1000, 4 << 20

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
NO_ROWS = {**dict.fromkeys(_COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


@lru_cache(maxsize=None)
def _step(after: tuple[int, ...], said: int, fault: int) -> tuple[tuple[int, ...], int, int]:
    """Costs to the end by state before a row, given those after it, less their minimum; that minimum; and the back pointers of the row.

    A back pointer is the ASCII-least letter of a cheapest edit, two bits a state. Costs differ by a few units only, so there are few
    distinct arguments.
    """
    by_edit = []
    for state in range(4):
        costs = {_D: DELETE_COST + after[state]}
        if fault in (FINE, TRUNCATED):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            costs[_R] = REROLE_COST + extra + after[_NEXT[state]]
            if (state, said) in _KEPT:
                costs[_K] = extra + after[_KEPT[state, said]]
        by_edit.append(costs)
    least = [min(c.values()) for c in by_edit]
    for _ in range(3):
        least = [min(least[q], INSERT_COST + least[_NEXT[q]]) for q in range(4)]
    packed = 0
    for state, costs in enumerate(by_edit):
        costs[_I] = INSERT_COST + least[_NEXT[state]]
        packed |= min(e for e, c in costs.items() if c == least[state]) << 2 * state
    low = min(least)
    return tuple(c - low for c in least), low, packed


class _Backward:
    """One conversation from its last row to its first: costs to the end by state, and the counts of its rows."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.rows, self.chars = conv_id, 0, 0
        self.costs, self.base = _END, 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.high = self.low = self.next = None
        self.held: list[tuple[int, int, int, str | None, str | None]] = []
        self.giant = False

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.rows and role[:1] + self.next not in ("su", "ua", "au"):
            self.illegal += 1
        self.next = role[:1]
        if turn is not None:
            self.high = turn if self.high is None else self.high
            self.turns += turn != self.low
            self.low = turn
        self.faults[fault] += 1
        said = _INITIAL.get(self.next, START)
        self.costs, shift, pointers = _step(self.costs, said, fault)
        self.base += shift
        # A row that must go needs no text any more.
        gone = fault in (BLANK, DUPLICATE)
        self.held.append((self.rows, pointers, said, None if gone else role, None if gone else text))
        self.rows += 1
        self.chars += 0 if gone else len(text)

    def counts(self) -> dict[str, int]:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
            "illegal": self.illegal, "cost": self.base + self.costs[START],
        }


class _Forward:
    """Follows the back pointers from the first row on; `put` gets the letter, role and text of every edit (a deleted row: no role)."""

    def __init__(self, put) -> None:
        self.state, self.put = START, put

    def _insert(self) -> None:
        self.state = _NEXT[self.state]
        self.put("I", _ROLE[self.state], "")

    def row(self, pointers: int, said: int, role: str | None, text: str | None) -> None:
        while (edit := pointers >> 2 * self.state & 3) == _I:
            self._insert()
        if edit == _D:
            self.put("D", None, None)
        elif edit == _K:
            self.state = _KEPT[self.state, said]
            self.put("K", role, text)
        else:
            self.state = _NEXT[self.state]
            self.put("R", _ROLE[self.state], text)

    def end(self) -> None:
        while _END[self.state]:
            self._insert()


class _Report:
    """One row a conversation: its counts, the letters of its edits, and the digest of the repaired turns."""

    names = [*_COUNTS, "audit", "repaired_sha256"]
    kinds = ["long"] * 6 + ["string"] * 2

    def __init__(self, conv_id: object, counts: dict[str, int], out: _Out) -> None:
        self.conv_id, self.counts, self.out = conv_id, counts, out
        self.letters: list[str] = []
        self.digest, self.some = hashlib.sha256(), False

    def put(self, letter: str, role: str | None, text: str | None) -> None:
        self.letters.append(letter)
        if role is not None:
            self.digest.update((("\n" if self.some else "") + role + ":" + text).encode())
            self.some = True

    def end(self) -> None:
        self.out.add(conv_id=self.conv_id, **self.counts, audit="".join(self.letters), repaired_sha256=self.digest.hexdigest())


class _Turns:
    """One row a repaired turn: its number from 0, role, text and the edit that made it."""

    names = ["seq", "edit", "new_role", "new_text"]
    kinds = ["long", "string", "string", "string"]

    def __init__(self, conv_id: object, counts: dict[str, int], out: _Out) -> None:
        self.conv_id, self.out, self.seq = conv_id, out, 0

    def put(self, letter: str, role: str | None, text: str | None) -> None:
        if role is not None:
            self.out.add(conv_id=self.conv_id, seq=self.seq, edit=letter, new_role=role, new_text=text)
            self.seq += 1

    def end(self) -> None:
        pass


class _Out:
    """Rows that wait until they make a batch; a field that a row does not name is null."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, **row: object) -> None:
        self.rows.append(row)
        self.chars += len(row.get("text") or row.get("new_text") or row.get("audit") or "")

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) >= _OUT_ROWS or self.chars >= _OUT_CHARS):
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.chars = [], 0


_SPILLED = ["place", "pointers", "said", "role", "text"]
_SPILLED_KINDS = ["long", "int", "int", "string", "string"]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schemas(kind: str, sink: type, spilled: bool) -> tuple[str, pa.Schema]:
    """The Spark and the Arrow schema; conv_id comes as text there and is cast back."""
    names = [*(_SPILLED if spilled else []), *([*_COUNTS] if spilled and sink is _Turns else []), *sink.names]
    kinds = [*(_SPILLED_KINDS if spilled else []), *(["long"] * 6 if spilled and sink is _Turns else []), *sink.kinds]
    return (
        f"conv_id {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)),
        pa.schema([("conv_id", pa.string() if kind == "string" else pa.int64()), *[(n, _ARROW[k]) for n, k in zip(names, kinds, strict=True)]]),
    )


def _backward(sink: type, schema: pa.Schema, held_rows: int):
    """Rows of whole conversations, each from its last row to its first; the state is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Out(schema), None

        def spill() -> None:
            now.giant = True
            for place, pointers, said, role, text in now.held:
                out.add(conv_id=now.conv_id, place=place, pointers=pointers, said=said, role=role, text=text)
            now.held, now.chars = [], 0

        def end() -> None:
            if now is None:
                return
            if now.giant:
                spill()
                # In descending order of places this row comes first, and brings the counts.
                out.add(conv_id=now.conv_id, place=now.rows, **now.counts())
                return
            result = sink(now.conv_id, now.counts(), out)
            walk = _Forward(result.put)
            for _, *row in reversed(now.held):
                walk.row(*row)
            walk.end()
            result.end()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            for conv_id, turn, role, text, fault in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    end()
                    now = _Backward(conv_id)
                now.add(turn, role, text, fault)
                if len(now.held) >= held_rows or now.chars >= HELD_CHARS:
                    spill()
                yield from out.batches()
        end()
        yield from out.batches(last=True)

    return run


def _forward(sink: type, schema: pa.Schema):
    """Handed-on rows of whole conversations, each from its header and first row to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, result, walk = _Out(schema), None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "pointers", "said", "role", "text", *_COUNTS)]
            for conv_id, pointers, said, role, text, *counts in zip(*columns, strict=True):
                if pointers is None:
                    if result is not None:
                        walk.end()
                        result.end()
                    result = sink(conv_id, dict(zip(_COUNTS, counts, strict=True)), out)
                    walk = _Forward(result.put)
                else:
                    walk.row(pointers, said, role, text)
                yield from out.batches()
        if result is not None:
            walk.end()
            result.end()
        yield from out.batches(last=True)

    return run


def faults_of(rows: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, text, fault, id)`: each row's first fault; `id` orders rows that agree in all else.

    Blank: no character but white space. Duplicate: role and text come earlier in the conversation. Truncated: the last character that is no white space
    is not one of `.!?`. The first of equal rows is a minimum that tasks take before the shuffle; only texts that repeat are joined back.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\x01"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    marked = cut_lineage(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("id")))
    marked = marked.withColumns({"blank": blank, "cut": cut, "same": F.unhex(F.sha2(F.concat(F.col("conv_id").isNull().cast("string"), said), 256))})
    first = marked.filter("NOT blank").groupBy("same").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")).alias("first")
    )
    first = first.filter("times > 1").select("same", F.col("first.id").alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") != F.col("id"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    return marked.join(first, "same", "left").select("conv_id", "turn", "role", "text", fault.alias("fault"), "id")


def _streamed(rows: DataFrame, sink: type, held_rows: int) -> DataFrame:
    given = rows.schema["conv_id"].dataType.simpleString()
    kind = "string" if given == "string" else "bigint"
    named = rows.withColumns({"conv_id": F.col("conv_id").cast(kind), "turn": F.col("turn").cast("long")})
    filled = named.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    down = [F.col("conv_id"), F.col("turn").desc_nulls_last(), *[F.col(c).desc() for c in ("role", "text", "id")]]
    ordered = faults_of(filled).repartition("conv_id").sortWithinPartitions(*down)
    shape, schema = _schemas(kind, sink, spilled=True)
    # What is kept here: a row for each finished conversation (or turn), and the rows of the giant ones.
    out = cut_lineage(ordered.drop("id").mapInArrow(_backward(sink, schema, held_rows), shape))
    done = out.filter("place IS NULL").select("conv_id", *sink.names)
    shape, schema = _schemas(kind, sink, spilled=False)
    rest = out.filter("place IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").desc())
    finished = done.unionByName(rest.mapInArrow(_forward(sink, schema), shape))
    return finished.withColumn("conv_id", F.col("conv_id").cast(given))


def repair_report(rows: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """`(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`, one row per conv_id of `rows(conv_id, turn, role, text)`.

    Rows are taken by turn (nulls first), then role and text in order of code points; a null conv_id is a conversation too; a null role or
    text is one space. The counts are of each row's first fault, of turns that are missing between the least and the greatest, and of
    neighbours whose initials are not su, ua or au. The edits of least cost give initials `(s?(ua)+)?`; of several, the audit that comes first in ASCII.

    Rows of a conversation meet in one task, sorted, and stream by from the last to the first: the state is four costs, and a back pointer of
    one byte a row says which edit is best in each state. Short conversations end there. A conversation beyond `held_rows` rows or 4 million
    characters hands its rows on with their bytes, and a second stream walks them from the first row; no task holds more than that
    bound, but for the audit.
    """
    return _streamed(rows, _Report, held_rows)


def repaired_turns(rows: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """`(conv_id, seq, edit, new_role, new_text)`: the turns that the edits of `repair_report` leave, numbered from 0."""
    return _streamed(rows, _Turns, held_rows)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to conversations, by crc32(`conv_id:turn`) % 20; nulls are one space there."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code: Column = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", part[2].alias("role"), part[3].alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Reports of the damaged conversations; one whose rows are all dropped has zeros, an empty audit and the digest of no text."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    report = repair_report(damaged(conversations))
    found = ids.join(report, F.expr("_id <=> conv_id"), "left")
    return found.select(F.col("_id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in NO_ROWS.items()])
