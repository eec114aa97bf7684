"""Conversation structure repair by weighted interval parsing.

Legal conversations are role initials of (s?(ua)+)?. The repair grammar is in Chomsky normal form: a symbol (p, q) stands for
rows that, once repaired, lead from place p of a legal conversation to place q; (p, q) -> (p, r) (r, q) are its rules and the
edits of one row its terminals. A cell holds for each symbol over a span of rows the cheapest (cost, audit) of all its
parses, with insertions before and after. A parse of a span passes some place between its halves, so that the cells of
two halves give the cell of the span; spans grow from single rows by doubling, and join over the borders of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barlake.llm import common
from barlake.llm.common import small_batches, spool

#: Places of a legal conversation: its start, after the system's row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: (place before, initial, place after).
MOVES = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER))
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
Cell = dict[tuple[int, int], tuple[int, str]]
#: Rows of a span whose cells a worker remembers by their kinds.
SHORT = 8


def joined(a: Cell, b: Cell) -> Cell:
    """The cell of a span from those of its two parts: of each symbol's parses the cheapest, of equal ones the least audit.
    (Equal audits of equal cost are one parse, and none is a prefix of another of the same cost, so parts' best parses
    give the best of the whole.)"""
    out: Cell = {}
    for (p, r), (x, s) in a.items():
        for (r2, q), (y, t) in b.items():
            if r == r2:
                cost = x + y
                old = out.get((p, q))
                if old is None or cost < old[0] or (cost == old[0] and s + t < old[1]):
                    out[p, q] = (cost, s + t)
    return out


def insertions() -> Cell:
    """The closed cell of no rows: what insertions alone lead from place to place."""
    one = {(p, p): (0, "") for p in range(4)} | {(p, q): (INSERT, "I") for p, i, q in MOVES if i != "s"}
    while True:
        more = joined(one, one)
        if more == one:
            return one
        one = more


NOTHING = insertions()


@lru_cache(None)
def row_cell(initial: str, fault: str) -> Cell:
    """The closed cell of one row with role ``initial`` (another letter than s, u, a fits nowhere) and first ``fault``."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        for p, i, q in MOVES:
            if i == initial:
                cell[p, q] = (extra, "K")
            elif i != "s":
                cell[p, q] = (REROLE + extra, "R")
    return joined(joined(NOTHING, cell), NOTHING)


#: A row's kind as one letter: its role's initial and fault.
FAULTS = ("", "blank", "duplicate", "truncated")
KINDS = [(i, f) for i in "sua-" for f in FAULTS]
LETTER = {k: chr(65 + n) for n, k in enumerate(KINDS)}


@lru_cache(100_000)
def short_cell(kinds: str) -> Cell:
    """The cell of a span of up to SHORT rows."""
    if len(kinds) < 2:
        return row_cell(*KINDS[ord(kinds) - 65]) if kinds else NOTHING
    return joined(short_cell(kinds[: len(kinds) // 2]), short_cell(kinds[len(kinds) // 2 :]))


class Spans:
    """Cells of rows in order, joined by doubling: at any time one span for each power of two."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Cell]] = []
        self.short: list[str] = []

    def add(self, kind: str) -> None:
        self.short.append(kind)
        if len(self.short) == SHORT:
            self.put(SHORT, short_cell("".join(self.short)))
            self.short = []

    def put(self, n: int, cell: Cell) -> None:
        while self.stack and self.stack[-1][0] <= n:
            m, left = self.stack.pop()
            n, cell = n + m, joined(left, cell)
        self.stack.append((n, cell))

    def cell(self) -> Cell:
        out = short_cell("".join(self.short))
        for _, left in reversed(self.stack):
            out = joined(left, out)
        return out


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[START, q] for q in ENDS if (START, q) in cell)


def repaired(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[str]:
    """``role:text`` of the repaired rows (role, text), one after the other."""
    place, it = START, iter(rows)
    for edit in audit:
        role, text = next(it) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            place = SYSTEM
        else:
            place = ASSISTANT if place == USER else USER
            role = role if edit == "K" else "assistant" if place == ASSISTANT else "user"
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the CRC-32 of ``conv_id:turn`` deals to each row; nulls are one space."""
    space = F.lit(" ")
    name = lambda c: F.coalesce(F.col(c).cast("string"), space)
    d = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    d = d.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy"))
    return d.drop("copy")


#: A row's place in its conversation: by turn, nulls first, then by role, hash of the text and place in the table.
ORDER = ("turned", "turn", "role", "same", "row")


def _listed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with row, a number of their own, and what their order and faults are told by."""
    gap = r"[ \t\n\x0B\f\r]*"
    fault = F.when(F.col("text").rlike(rf"\A{gap}\z"), 1).when(~F.col("text").rlike(rf"[.!?]{gap}\z"), 3).otherwise(0)
    return rows.select("conv_id", "turn", F.col("turn").isNotNull().alias("turned"), "role", "text", F.unhex(F.sha2("text", 256)).alias("same"), fault.alias("fault"), F.monotonically_increasing_id().alias("row"))


FACTS = "conv_id {kind}, part long, n_rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, least_turn long, most_turn long, turns long, symbols array<int>, costs array<long>, audits array<string>"


class Stretch:
    """What is known of adjacent rows of one conversation: counts, ends and the cell of their span."""

    def __init__(self) -> None:
        self.n = self.illegal = self.turns = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = None
        self.least = self.most = None
        self.spans = Spans()

    def _border(self, initial: str) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1

    def _turn(self, least: int | None, most: int | None, turns: int) -> None:
        if least is not None:
            self.turns += turns - (self.most == least)
            self.least, self.most = least if self.least is None else self.least, most

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        self._border(initial)
        self.last = initial
        self.n += 1
        self.faults[fault] += 1
        self._turn(turn, turn, 1)
        self.spans.add(LETTER[initial if initial in ("s", "u", "a") else "-", FAULTS[fault]])

    def join(self, r: dict) -> None:
        """Add the stretch after this one, as a row of FACTS."""
        self._border(r["first_role"])
        self.last = r["last_role"]
        self.n += r["n_rows"]
        self.illegal += r["illegal"]
        for k in (1, 2, 3):
            self.faults[k] += r[FAULTS[k]]
        self._turn(r["least_turn"], r["most_turn"], r["turns"])
        self.spans.put(r["n_rows"], {divmod(s, 4): (c, a) for s, c, a in zip(r["symbols"], r["costs"], r["audits"])})

    def facts(self) -> list:
        cell = self.spans.cell()
        return [self.n, *self.faults[1:], self.illegal, self.first, self.last, self.least, self.most, self.turns, [4 * p + q for p, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()]]

    def report(self) -> list:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [gaps, *self.faults[1:], self.illegal, *cheapest(self.spans.cell())]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows of sorted batches, each with whether its conversation begins there."""
    last: object = batches  # nobody's id
    for b in batches:
        for r in b.to_pylist():
            yield last is batches or r["conv_id"] != last, r
            last = r["conv_id"]


def _batches(rows: Iterator[list], schema: pa.Schema, size: int = 200) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _stretches(listed: DataFrame, kind: str) -> DataFrame:
    """FACTS of each conversation's rows in each task, over rows sorted by range: a long conversation spreads over tasks.

    Of rows with the same role and text the first in order is no duplicate; firsts are found by counts that combine before
    they are shuffled, and meet the rows by row number, so neither a conversation nor a text is one task's."""
    place = F.struct(*[c for c in ORDER if c not in ("role", "same")])
    first = listed.where("fault <> 1").groupBy("conv_id", "role", "same").agg(F.min(place).alias("at")).select(F.col("at.row").alias("row"), F.lit(True).alias("is_first"))
    thin = listed.select("conv_id", *ORDER, F.left("role", F.lit(1)).alias("initial"), "fault").join(first, "row", "left")
    fault = F.when((F.col("fault") != 1) & F.col("is_first").isNull(), 2).otherwise(F.col("fault"))
    key = ["conv_id", *ORDER]
    rows = thin.select(*key, "initial", fault.alias("fault")).repartitionByRange(*key).sortWithinPartitions(*key)
    ddl = FACTS.format(kind=kind)
    schema = _arrow(ddl)

    def run(batches):
        part = TaskContext.get().partitionId()

        def facts():
            now, conv = None, None
            for begins, r in _runs(batches):
                if begins:
                    if now:
                        yield [conv, part, *now.facts()]
                    now, conv = Stretch(), r["conv_id"]
                now.add(r["initial"], r["fault"], r["turn"])
            if now:
                yield [conv, part, *now.facts()]

        yield from _batches(facts(), schema)

    return rows.select("conv_id", "turn", "initial", "fault").mapInArrow(run, ddl)


def _reports(stretches: DataFrame, kind: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation's stretches in order."""
    ddl = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    schema = _arrow(ddl)

    def run(batches):
        def reports():
            now, conv = None, None
            for begins, r in _runs(batches):
                if begins:
                    if now:
                        yield [conv, *now.report()]
                    now, conv = Stretch(), r["conv_id"]
                now.join(r)
            if now:
                yield [conv, *now.report()]

        yield from _batches(reports(), schema)

    return stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, ddl)


def _hashed(listed: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` with repaired_sha256: each conversation's report comes before its rows, which are hashed as they pass."""
    null = lambda t: F.lit(None).cast(t)
    names = reports.columns[1:]
    head = F.struct(*names)
    as_head = dict(reports.select(head.alias("head")).dtypes)["head"]
    rows = listed.select("conv_id", F.lit(1).alias("is_row"), *ORDER, "text", null(as_head).alias("head"))
    kinds = dict(listed.dtypes)
    heads = reports.select("conv_id", F.lit(0).alias("is_row"), *[null(kinds[c]).alias(c) for c in (*ORDER, "text")], head.alias("head"))
    every = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER)
    ddl = ", ".join(f"{n} {t}" for n, t in reports.dtypes) + ", repaired_sha256 string"
    schema = _arrow(ddl)

    def run(batches):
        def hashed():
            it = _runs(batches)
            first = next(it, (False, None))[1]
            while first:
                after = []

                def own():
                    for begins, r in it:
                        if begins:
                            after.append(r)
                            return
                        yield r["role"], r["text"]

                mine, h, some, report = own(), hashlib.sha256(), False, first["head"]
                for line in repaired(mine, report["audit"]):
                    h.update(b"\n" * some + line.encode("utf-8"))
                    some = True
                for _ in mine:  # to the next conversation
                    pass
                yield [first["conv_id"], *[report[n] for n in names], h.hexdigest()]
                first = after[0] if after else None

        yield from _batches(hashed(), schema)

    return every.select("conv_id", "role", "text", "head").mapInArrow(run, ddl)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations in ``rows`` (conv_id,
    turn, role, text; roles and texts aren't null).

    A null conv_id is a conversation too. Rows of one turn go by role, then by their text's SHA-256; equal rows are copies,
    which count as duplicates but for the first. Roles but system, user and assistant, told by initials (an empty one has
    none), must be changed or deleted. Long conversations are parsed in parts; their texts are hashed as a stream, one
    task's work for each conversation, as SHA-256 reads from front to end. An empty table gives no rows; columns of other
    names aren't looked at. Writes ``rows`` to the shared folder once."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    small_batches(rows.sparkSession)
    listed = spool(_listed(rows))
    reports = spool(_reports(_stretches(listed, kind), kind))
    return _hashed(listed, reports)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair() of damaged(): every original conv_id, those that lost all rows with zeros and no audit."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "c_id")
    ids = conversations.select("conv_id").distinct()
    zero, none = F.lit(0).cast("long"), {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c_id")), "left").select("conv_id", *[F.coalesce(c, none.get(c, zero)).alias(c) for c in found.columns if c != "c_id"])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
