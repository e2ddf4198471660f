"""Repair of conversations whose turns don't follow the role grammar, by generalised LR parsing with edits.

Grammar over the first letters of roles: nothing, or an optional system turn and one or more pairs of user and
assistant turns. Tables of an SLR parser are made from the rules. The parser reads the rows of a conversation in
order; its stacks share their lower parts (a graph-structured stack). For each row every live stack may keep it
(cost 0), give it the role user or assistant (2) or delete it (3; blank and repeated rows must be deleted), and
before any row and at the end an empty turn may be inserted (2); a truncated row that stays costs 1 more. Stacks
with equal tops are merged by the minimum of (cost, audit), where the audit is the edits' initials. Equal tops take
the same continuations in this grammar (a test goes through all of them), and of two audits of one cost none begins
the other, so the minimum of the parts is part of the minimum of the whole.

Jobs: rows are sorted by ranges of (conversation, turn, role, text hash) and parsed as they stream by, one row at a
time, with a running hash per stack; a conversation that lies within one range is done then. The first and last
conversation of a range may go on in another; those that do (a long one may fill many ranges) are parsed
in segments, from each possible top on, in many tasks; a fold over the segments (one row each) picks the path, the
segments are rewritten in parallel, and only the hash, which is sequential by nature, reads a conversation in one
task, a chunk at a time. Repeated rows of such conversations are found by their first place per (conversation,
role, text), combined before the shuffle.

Defined results: null roles and texts count as one blank; rows without a turn come first; equal turns are ordered
by role and text hash; repeated rows are duplicates; a null conversation is one of its own; texts of any length
are read whole; rows marked ``gone`` only keep their conversation in the result, so one without other rows has zeros, an
empty audit and the hash of nothing; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os.path
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import crc32_of, in_order, stored

#: The role grammar; lower-case letters are first letters of roles.
RULES = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Roles that edits may give.
NAMES = {"u": "user", "a": "assistant"}
#: From the cheapest stack every other one's continuation is reached for less than this: two insertions and a deletion.
DOMINATED = 2 * INSERT + DELETE
#: Rows of a segment of a conversation that spans ranges.
RUN = 65_536
#: Rows after which what all audits begin with is set aside; bytes of repaired text in a chunk.
COMMIT, CHUNK = 256, 1 << 20

#: Characters that leave a text blank.
BLANK = " \t\n\v\f\r"


# -- parser ------------------------------------------------------------------------


class Tables:
    """SLR tables of a small grammar, and moves on whole stacks (tuples of states), remembered."""

    def __init__(self, rules=RULES):
        self.rules = (("", rules[0][0]), *rules)
        heads = {h for h, _ in self.rules}
        self.states: list[frozenset] = [self._close({(0, 0)}, heads)]
        self.goto: dict[tuple[int, str], int] = {}
        for i, state in enumerate(self.states):
            for x in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                moved = self._close({(r, d + 1) for r, d in state if self.rules[r][1][d : d + 1] == x}, heads)
                if moved not in self.states:
                    self.states.append(moved)
                self.goto[i, x] = self.states.index(moved)
        first = {h: set() for h in heads}
        empty: set[str] = set()
        follow = {h: {"$"} if h in ("", rules[0][0]) else set() for h in heads}
        for _ in range(len(self.rules) ** 2):
            for h, body in self.rules:
                for x in body:
                    first[h] |= first.get(x, {x})
                    if x not in empty:
                        break
                else:
                    empty.add(h)
                for k, x in enumerate(body):
                    if x in heads:
                        for y in body[k + 1 :]:
                            follow[x] |= first.get(y, {y})
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[h]
        self.reduce: dict[tuple[int, str], int] = {}
        for i, state in enumerate(self.states):
            for r, d in state:
                if r and d == len(self.rules[r][1]):
                    for x in follow[self.rules[r][0]]:
                        if (i, x) in self.reduce or (i, x) in self.goto:
                            raise ValueError("the grammar is not SLR(1)")
                        self.reduce[i, x] = r
        self._memory: dict[tuple[tuple[int, ...], str], tuple[int, ...] | None] = {}
        self.alphabet = sorted({x for _, body in rules for x in body} - heads)

    def _close(self, items: set, heads: set) -> frozenset:
        while more := {(r, 0) for i, d in items for x in self.rules[i][1][d : d + 1] if x in heads for r, (h, _) in enumerate(self.rules) if h == x} - items:
            items = items | more
        return frozenset(items)

    def _reduced(self, stack: tuple[int, ...], ahead: str) -> tuple[int, ...]:
        while (rule := self.reduce.get((stack[-1], ahead))) is not None:
            head, body = self.rules[rule]
            stack = stack[: len(stack) - len(body)]
            stack = (*stack, self.goto[stack[-1], head])
        return stack

    def shift(self, stack: tuple[int, ...], letter: str) -> tuple[int, ...] | None:
        """The stack after ``letter``, or None where it cannot stand."""
        key = (stack, letter)
        if key not in self._memory:
            done = self._reduced(stack, letter)
            state = self.goto.get((done[-1], letter))
            self._memory[key] = None if state is None else (*done, state)
        return self._memory[key]

    def accepts(self, stack: tuple[int, ...]) -> bool:
        return self._reduced(stack, "$") == (0, self.goto[0, self.rules[1][0]])

    def stacks(self) -> list[tuple[int, ...]]:
        """All stacks of letters that lead somewhere, one for each top."""
        found, at = {0: (0,)}, [(0,)]
        for stack in at:
            for x in self.alphabet:
                nxt = self.shift(stack, x)
                if nxt is not None and nxt[-1] not in found:
                    found[nxt[-1]] = nxt
                    at.append(nxt)
        return list(found.values())


class Parse:
    """The live stacks after some rows, each with its cheapest (cost, audit, hash of the repaired text)."""

    def __init__(self, tables: Tables, start: tuple[int, ...] = (0,), hashing: bool = True):
        self.tables, self.rows = tables, 0
        self.committed = bytearray()
        self.live: dict[int, tuple] = {start[-1]: (0, b"", start, Text() if hashing else None)}
        self._insert()

    def _insert(self) -> None:
        """Insertions from all live stacks, as long as one gets a cheaper stack."""
        queue = list(self.live.values())
        for cost, audit, stack, text in queue:
            for letter in NAMES:
                nxt = self.tables.shift(stack, letter)
                if nxt is not None:
                    have = self.live.get(nxt[-1])
                    if have is None or (cost + INSERT, audit + b"I") < have[:2]:
                        self.live[nxt[-1]] = entry = (cost + INSERT, audit + b"I", nxt, text and text.with_turn(NAMES[letter], ""))
                        queue.append(entry)

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}

        def offer(cost: int, audit: bytes, stack: tuple[int, ...], made: tuple) -> None:
            have = best.get(stack[-1])
            if have is None or (cost, audit) < have[:2]:
                best[stack[-1]] = (cost, audit, stack, made)

        shift, letter, more = self.tables.shift, role[:1], TRUNCATED * truncated
        for cost, audit, stack, so_far in self.live.values():
            offer(cost + DELETE, audit + b"D", stack, (so_far, None))
            if must_go:
                continue
            nxt = shift(stack, letter)
            if nxt is not None:
                offer(cost + more, audit + b"K", nxt, (so_far, role))
            for given, name in NAMES.items():
                nxt = shift(stack, given)
                if nxt is not None:
                    offer(cost + REROLE + more, audit + b"R", nxt, (so_far, name))
        limit = min(e[0] for e in best.values()) + DOMINATED
        self.live = {
            top: (cost, audit, stack, so_far.with_turn(name, text) if so_far and name is not None else so_far)
            for top, (cost, audit, stack, (so_far, name)) in best.items() if cost <= limit
        }
        self._insert()
        self.rows += 1
        if self.rows % COMMIT == 0:
            self._commit()

    def _commit(self) -> None:
        common = os.path.commonprefix([e[1] for e in self.live.values()])
        if common:
            self.committed += common
            self.live = {top: (cost, audit[len(common) :], *rest) for top, (cost, audit, *rest) in self.live.items()}

    def exits(self) -> list[tuple[int, int, bytes]]:
        """(top, cost, audit) of every live stack."""
        return [(top, cost, bytes(self.committed) + audit) for top, (cost, audit, _, _) in self.live.items()]

    def best(self) -> tuple[int, bytes, Text | None]:
        cost, audit, _, text = min((e for e in self.live.values() if self.tables.accepts(e[2])), key=lambda e: e[:2])
        return cost, bytes(self.committed) + audit, text


class Text:
    """Running hash of repaired turns; branches copy it."""

    __slots__ = ("digest", "any")

    def __init__(self):
        self.digest, self.any = hashlib.sha256(), False

    def with_turn(self, role: str, text: str) -> Text:
        new = Text.__new__(Text)
        new.digest, new.any = self.digest.copy(), True
        new.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        return new


def repaired_turns(tables: Tables, start: tuple[int, ...], audit: bytes, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns that ``audit`` makes of ``rows`` (role, text), from a stack on. Roles given follow from the grammar."""
    stack = start
    for edit in audit:
        role, text = ("", "") if edit == 73 else next(rows)
        if edit == 68:
            continue
        if edit != 75:
            letter = next(x for x in NAMES if tables.shift(stack, x) is not None)
            role = NAMES[letter]
        stack = tables.shift(stack, role[:1])
        yield role, text


# -- rows --------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of ``conv_id:turn`` modulo 20: 0 marks it as gone, 1 empties the text, 2 takes its
    sentence ends, 3 repeats the row, 4 makes the user speak. Null roles and texts become one blank, nulls in the checked name, too."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = crc32_of(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("code") == 0).alias("gone"), F.explode(copies).alias("copy"),
    ).select("conv_id", "turn", "role", F.when(~F.col("gone"), F.col("text")).otherwise("").alias("text"), "gone", "copy")


def _ready(rows: DataFrame) -> DataFrame:
    """Rows with what the parser asks: the order of ties, and whether the text is blank or truncated."""
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    return rows.withColumns({
        "sha": F.sha2("text", 256), "blank": last == "", "truncated": ~last.isin(".", "!", "?"),
        "row": F.monotonically_increasing_id(),
    })


ORDER = ["conv_id", "turn", "role", "sha", "row"]
COUNTS = "first_letter string, last_letter string, n_rows bigint, low bigint, high bigint, low_turn bigint, high_turn bigint, distinct_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
COUNT_NAMES = [part.split()[0] for part in COUNTS.split(", ")]
FOLLOWS = {"su", "ua", "au"}


class Counts:
    """Running counts of a run of rows."""

    def __init__(self):
        self.first = self.last = None
        self.low = self.high = None
        self.n = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def row(self, turn: int | None, role: str, fault: str) -> None:
        letter = role[:1]
        if self.n:
            self.illegal += self.last + letter not in FOLLOWS
        else:
            self.first = letter
        self.last, self.n = letter, self.n + 1
        if turn is not None:
            if self.high != turn:
                self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _streamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in names], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(schema: str, conv: pa.DataType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.schema([("conv_id", conv), *[(n, kinds[k]) for n, k in fields]])


def _fault(blank: bool, repeated: bool, truncated: bool) -> str:
    return "blank" if blank else "duplicate" if repeated else "truncated" if truncated else ""


def _whole(rows: DataFrame) -> DataFrame:
    """Every conversation parsed as if it lay in one range; ``edge`` marks the first and last one of each range."""
    conv = rows.schema["conv_id"].dataType
    schema = ", ".join([f"{n} bigint" for n in RESULT]) + ", audit string, repaired_sha256 string, edge boolean"
    arrow = _arrow(schema, to_arrow_type(conv))

    def parsed(rows: Iterator[tuple]) -> Iterator[tuple]:
        tables, done, first = Tables(), None, True
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            if done is not None:
                yield (*done, first)
                first = False
            counts, parse, seen = Counts(), Parse(tables), set()
            for _, turn, role, text, gone, blank, truncated, sha in group:
                if gone:
                    continue
                key = (role, bytes.fromhex(sha))
                fault = _fault(blank, key in seen, truncated)
                seen.add(key)
                counts.row(turn, role, fault)
                parse.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
            cost, audit, text = parse.best()
            done = (conv_id, counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit.decode(), text.digest.hexdigest())
        if done is not None:
            yield (*done, True)

    names = ["conv_id", "turn", "role", "text", "gone", "blank", "truncated", "sha"]
    ranged = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*names)
    return stored(ranged.mapInArrow(lambda batches: _batches(parsed(_streamed(batches, names)), arrow), f"conv_id {conv.simpleString()}, {schema}"), "parsed")


# -- conversations that lie in several ranges ----------------------------------------


def _segments(rows: DataFrame) -> DataFrame:
    """Per segment (conv_id, part): its counts and, for every top it may be entered with, the exits.

    Segments are runs of rows of one conversation in one task; ``moves`` lists (enter, leave, cost, audit).
    """
    conv = rows.schema["conv_id"].dataType
    moves = "array<struct<enter:int,leave:int,cost:bigint,audit:string>>"
    arrow = _arrow(f"part int, {COUNTS}", to_arrow_type(conv)).append(
        pa.field("moves", pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))
    )

    def parsed(rows: Iterator[tuple]) -> Iterator[tuple]:
        tables = Tables()
        for (conv_id, part), group in groupby(rows, key=lambda r: r[:2]):
            counts, parses = Counts(), {s[-1]: Parse(tables, s, hashing=False) for s in tables.stacks()}
            for _, _, _, turn, role, fault in group:
                counts.row(turn, role, fault)
                for parse in parses.values():
                    parse.row(role, "", fault in ("blank", "duplicate"), fault == "truncated")
            c = counts
            exits = [{"enter": e, "leave": t, "cost": cost, "audit": audit.decode()} for e, p in parses.items() for t, cost, audit in p.exits()]
            yield (conv_id, part, c.first, c.last, c.n, None, None, c.low, c.high, c.turns, c.blank, c.duplicate, c.truncated, c.illegal, exits)

    names = ["conv_id", "part", "at", "turn", "role", "fault"]
    ordered = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at").select(*names)
    return ordered.mapInArrow(lambda batches: _batches(parsed(_streamed(batches, names)), arrow, 1), f"conv_id {conv.simpleString()}, part int, {COUNTS}, moves {moves}")


def _fold(segments: DataFrame) -> DataFrame:
    """Per segment of the chosen path: enter, audit; and the results of its conversation."""
    conv = segments.schema["conv_id"].dataType
    schema = "part int, enter int, piece string, " + ", ".join(f"{n} bigint" for n in RESULT)
    arrow = _arrow(schema, to_arrow_type(conv))

    def fold(table: pa.Table) -> pa.Table:
        tables = Tables()
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        stack_of = {s[-1]: s for s in tables.stacks()}
        best: dict[int, tuple] = {0: (0, "", ())}
        total, gaps_low, gaps_high, turns, last = defaultdict(int), None, None, 0, None
        for r in rows:
            onward: dict[int, tuple] = {}
            for m in r["moves"]:
                if m["enter"] in best:
                    cost, audit, path = best[m["enter"]]
                    new = (cost + m["cost"], audit + m["audit"], (*path, (m["enter"], m["audit"])))
                    if m["leave"] not in onward or new[:2] < onward[m["leave"]][:2]:
                        onward[m["leave"]] = new
            best = onward
            for name in ("blank", "duplicate", "truncated", "illegal"):
                total[name] += r[name]
            if last is not None:
                total["illegal"] += last + r["first_letter"] not in FOLLOWS
            last = r["last_letter"]
            if r["low_turn"] is not None:
                turns += r["distinct_turns"] - (gaps_high == r["low_turn"])
                gaps_low = r["low_turn"] if gaps_low is None else gaps_low
                gaps_high = r["high_turn"]
        cost, _, path = min((b for top, b in best.items() if tables.accepts(stack_of[top])), key=lambda b: b[:2])
        gaps = 0 if gaps_low is None else gaps_high - gaps_low + 1 - turns
        out = [
            (r["conv_id"], r["part"], enter, piece, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost)
            for r, (enter, piece) in zip(rows, path, strict=True)
        ]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return segments.groupBy("conv_id").applyInArrow(fold, f"conv_id {conv.simpleString()}, {schema}")


def _hashes(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): segments are rewritten in parallel, their chunks hashed in order."""
    conv = rows.schema["conv_id"].dataType
    chunk_schema = "part int, number bigint, piece string, chunk binary"
    chunk_arrow = _arrow(chunk_schema, to_arrow_type(conv))

    def rewritten(rows: Iterator[tuple]) -> Iterator[tuple]:
        tables = Tables()
        stack_of = {s[-1]: s for s in tables.stacks()}
        for (conv_id, part), group in groupby(rows, key=lambda r: r[:2]):
            _, _, _, _, audit, enter = next(group)  # stands at -1
            number, held, size = 0, [], 0
            for role, text in repaired_turns(tables, stack_of[enter], audit.encode(), ((r[3], r[4]) for r in group)):
                held.append(f"\n{role}:{text}".encode())
                size += len(held[-1])
                if size >= CHUNK:
                    yield conv_id, part, number, None, b"".join(held)
                    number, held, size = number + 1, [], 0
            yield conv_id, part, number, audit, b"".join(held)

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            digest, begun, audit = hashlib.sha256(), False, []
            for _, piece, chunk in group:
                digest.update(chunk if begun else chunk[1:])
                begun = begun or bool(chunk)
                audit.append(piece or "")
            yield conv_id, "".join(audit), digest.hexdigest()

    names = ["conv_id", "part", "at", "role", "text", "enter"]
    plans = chosen.select("conv_id", "part", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("piece").alias("text"), "enter")
    both = rows.select("conv_id", "part", "at", "role", "text", F.lit(0).alias("enter")).unionByName(plans)
    chunks = both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at").mapInArrow(
        lambda batches: _batches(rewritten(_streamed(batches, names)), chunk_arrow, 8), f"conv_id {conv.simpleString()}, {chunk_schema}"
    )
    kept = ["conv_id", "piece", "chunk"]
    schema = "audit string, repaired_sha256 string"
    arrow = _arrow(schema, to_arrow_type(conv))
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").select(*kept).mapInArrow(
        lambda batches: _batches(hashed(_streamed(batches, kept)), arrow), f"conv_id {conv.simpleString()}, {schema}"
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Results of conversations whose rows lie in several ranges."""
    ordered = in_order(rows.where("NOT gone").select(*ORDER, "text", "blank", "truncated"), ORDER, "spread").withColumn("part", F.floor(F.col("at") / RUN).cast("int"))
    firsts = ordered.groupBy("conv_id", "role", "sha").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    marked = ordered.select("conv_id", "part", "at", "turn", "role", "blank", "truncated").join(firsts, "at", "left").withColumn("fault", fault)
    chosen = stored(_fold(stored(_segments(marked), "segments")), "chosen")
    hashes = _hashes(ordered, chosen)
    counts = chosen.groupBy("conv_id").agg(*[F.first(n).alias(n) for n in RESULT])
    return counts.join(hashes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text and gone (true: counts for nothing but keeps its conversation).
    """
    ready = _ready(rows)
    parsed = _whole(ready)
    columns = ["conv_id", *RESULT, "audit", "repaired_sha256"]
    # at most two rows per range are edges: the conversations that stand in several are few
    split = stored(parsed.where("edge").groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_conv"), F.lit(True).alias("split")), "split")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    within = parsed.join(F.broadcast(split), same, "left_anti").select(*columns)
    rest = ready.join(F.broadcast(split), same, "left_semi")
    spread = _spread(rest).select(*columns)
    nothing = {**{n: F.lit(0).cast("long") for n in RESULT}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    found = spread.select(F.col("conv_id").alias("_found"))
    bare = split.join(found, F.col("_conv").eqNullSafe(F.col("_found")), "left_anti").select(F.col("_conv").alias("conv_id"), *[v.alias(k) for k, v in nothing.items()])
    return within.unionByName(spread).unionByName(bare)
