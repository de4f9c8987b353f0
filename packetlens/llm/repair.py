"""Repair of conversation structure by lightest derivations.

A conversation's rows are to become role initials ``(s?(ua)+)?`` by the cheapest edits. The items of the
deduction are "the first i rows are mended and the roles so far end in state q"; every edit of the next
row, and every insertion, is a hyperedge from one item to another. Its function appends the edit's
letter and adds its cost, so a derivation weighs ``(cost, audit)`` and no edge makes it lighter: the
functions are superior, and they keep the order of two derivations of one item, since these mend the same
rows and neither audit begins with the other. So Knuth's agenda applies: items are popped lightest
first, a popped item is final, and the first goal popped is the answer.

Long conversations are cut into runs of bounded length that Spark sorts and deals by range, a run
each to its own derivations from every state; a second pass composes the runs' tables from state to
state, which hold costs and the order of audits, not rows. Equal rows are counted before anything moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .frames import byte_blocks

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
# Rows of a conversation that one agenda mends.
RUN_ROWS = 512
SPACES = " \t\n\x0b\x0c\r"
# Bytes of texts that a task holds as Python objects.
TEXT_BYTES = 8_000_000

# States: nothing yet, after s, after u, after a. Rows: the state after each initial; none if it can't follow.
_FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# The state after a user or assistant row that fits.
_FITTING = (2, 2, 3, 2)
_GOALS = (0, 3)
# Cost and letters that end a conversation from each state.
_CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = ("su", "ua", "au")


def _edges(row: tuple, state: int) -> Iterator[tuple[int, int, str]]:
    """Edits of a row and its copies: next state, cost, letters."""
    initial, must_go, truncated, copies = row
    more, rest = DELETE * (copies - 1), "D" * (copies - 1)
    yield state, DELETE * copies, "D" * copies
    if not must_go:
        late = TRUNCATED if truncated else 0
        if initial in _FOLLOW[state]:
            yield _FOLLOW[state][initial], late + more, "K" + rest
        yield _FITTING[state], REROLE + late + more, "R" + rest


def derive(rows: tuple, state: int = 0, closed: bool = True) -> dict[int, tuple[int, str]]:
    """Lightest derivations of ``rows`` from ``state``: final state to (cost, audit).

    Closed: of the goal alone. Else of every state in which the last row's edit can end, for a run
    that others follow: insertions after its last row are left to these.
    """
    agenda, final, found = [(0, "", 0, state)], set(), {}
    while agenda:
        cost, audit, at, state = heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(rows):
            if closed and state in _GOALS:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
            if not closed:
                continue
        else:
            for to, more, letters in _edges(rows[at], state):
                if (at + 1, to) not in final:
                    heappush(agenda, (cost + more, audit + letters, at + 1, to))
        if (at, _FITTING[state]) not in final:
            heappush(agenda, (cost + INSERT, audit + "I", at, _FITTING[state]))
    return found


@lru_cache(maxsize=20_000)
def _known(rows: tuple, state: int = 0, closed: bool = True) -> dict[int, tuple[int, str]]:
    """``derive``, remembered: most conversations are short and have one of few shapes."""
    return derive(rows, state, closed)


def _illegal(rows: tuple) -> int:
    """Adjacent rows whose initials don't alternate; copies of a row never do."""
    pairs = sum(a[0] + b[0] not in _LEGAL for a, b in zip(rows[:-1], rows[1:]))
    return pairs + sum(r[3] - 1 for r in rows)


def _keyed(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with their number of copies; no texts."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    return rows.groupBy(
        "conv",
        "turn",
        "role",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    ).agg(F.count("*").alias("copies"))


def _flagged(keyed: DataFrame) -> DataFrame:
    """With ``seen``: the same role and text have an earlier turn. Nulls are the earliest."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = keyed.groupBy("conv", "role", "digest").agg(F.min(at).alias("first"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return keyed.join(first, same).select(*keyed.columns, (~at.eqNullSafe(F.col("first"))).alias("seen"))


_TABLE = "array<struct<start:int,stop:int,cost:bigint,audit:string>>"


def _runs(flagged: DataFrame) -> DataFrame:
    """Conversations in runs of at most ``RUN_ROWS`` distinct rows, in order, with their derivations.

    A run that surely is the whole conversation has its cost and audit; another has a table of all
    ways through it. ``seq`` orders the runs of a conversation.
    """
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    initial = F.left("role", F.lit(1))
    inputs = (
        flagged.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv",
            F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
            (F.col("blank") | F.col("seen")).alias("must_go"),
            "truncated",
            "copies",
        )
    )
    kind = dict(flagged.dtypes)["conv"]
    schema = (
        f"conv {kind}, seq bigint, head string, tail string, illegal bigint, whole boolean,"
        f" cost bigint, audit string, ways {_TABLE}"
    )

    def solved(conv, number: int, rows: list, whole: bool) -> dict:
        rows = tuple(rows)
        search = _known if len(rows) <= 16 and max(r[3] for r in rows) <= 4 else derive
        one = {"conv": conv, "seq": number, "head": rows[0][0], "tail": rows[-1][0]}
        one |= {"illegal": _illegal(rows), "whole": whole, "cost": None, "audit": None, "ways": None}
        if whole:
            ((one["cost"], one["audit"]),) = search(rows).values()
        else:
            one["ways"] = [
                {"start": a, "stop": b, "cost": cost, "audit": audit}
                for a in range(4)
                for b, (cost, audit) in sorted(search(rows, a, False).items())
            ]
        return one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        # The first and the last conversation may go on in other partitions.
        current, rows, whole, out, arrow = None, [], False, [], None
        for batch in batches:
            arrow = batch.schema.field("conv").type
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            for conv, *row in zip(*columns):
                same = rows and conv == current
                if rows and (not same or len(rows) == RUN_ROWS):
                    out.append(solved(current, number, rows, whole and not same))
                    number += 1
                    whole, rows = not same, []
                current = conv
                rows.append(tuple(row))
            if out:
                yield _batch(out, arrow)
                out = []
        if rows:
            yield _batch([solved(current, number, rows, False)], arrow)

    return inputs.mapInArrow(run, schema)


def _batch(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    way = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = {"conv": conv, "seq": pa.int64(), "head": pa.string(), "tail": pa.string(), "illegal": pa.int64()}
    kinds |= {"whole": pa.bool_(), "cost": pa.int64(), "audit": pa.string(), "ways": pa.list_(way)}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def choose(parts: list[list[tuple]]) -> tuple[int, str, list[tuple[int, int]]]:
    """The lightest way through runs: cost, closing letters, and start and stop state of each run.

    ``parts`` has for each run its ways ``(start, stop, cost, rank)``; ``rank`` orders the run's audits.
    All audits up to a run mend the same rows, so none begins with another: the order of two is
    that of their parts before it, then that of the run's own parts.
    """
    cost, rank, back = {0: 0}, {0: 0}, []
    for ways in parts:
        best = {}
        for start, stop, more, place in ways:
            if start in cost:
                weight = (cost[start] + more, rank[start], place, start)
                best[stop] = min(best.get(stop, weight), weight)
        order = sorted({w[1:3] for w in best.values()})
        cost = {q: w[0] for q, w in best.items()}
        rank = {q: order.index(w[1:3]) for q, w in best.items()}
        back.append(bytes(best[q][3] if q in best else 9 for q in range(4)))
    total, _, letters, state = min((cost[q] + _CLOSING[q][0], rank[q], _CLOSING[q][1], q) for q in cost)
    path = []
    for starts in reversed(back):
        path.append((starts[state], state))
        state = starts[state]
    return total, letters, path[::-1]


def _composed(parts: DataFrame) -> DataFrame:
    """Conversations of several runs: conv, cost, audit, illegal."""
    ranked = F.array_sort(F.array_distinct("ways.audit"))
    ways = F.transform(
        "ways",
        lambda w: F.array(
            w["start"].cast("bigint"), w["stop"].cast("bigint"), w["cost"], F.array_position(ranked, w["audit"])
        ),
    )
    small = parts.select("conv", "seq", "head", "tail", ways.alias("ways"))
    kind = dict(parts.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, runs, seqs, border, tail = None, [], [], [], ""

        def ended() -> pa.RecordBatch:
            total, letters, path = choose(runs)
            last = len(path) - 1
            rows = [
                {
                    "seq": seq,
                    "start": a,
                    "stop": b,
                    "border": bad,
                    "cost": total if i == last else None,
                    "closing": letters if i == last else "",
                }
                for i, (seq, (a, b), bad) in enumerate(zip(seqs, path, border))
            ]
            kinds = [("seq", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("border", pa.int64())]
            return pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([*kinds, ("cost", pa.int64()), ("closing", pa.string())])
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "seq", "head", "tail", "ways")]
            for conv, seq, head, end, table in zip(*columns):
                if runs and conv != current:
                    yield ended()
                    runs, seqs, border = [], [], []
                border.append(int(bool(runs) and tail + head not in _LEGAL))
                runs.append(np.array(table, dtype=np.int64).tolist())
                seqs.append(seq)
                current, tail = conv, end
        if runs:
            yield ended()

    chosen = (
        small.repartition("conv")
        .sortWithinPartitions("conv", "seq")
        .mapInArrow(run, "seq bigint, start int, stop int, border bigint, cost bigint, closing string")
    )
    taken = F.filter("ways", lambda w: (w["start"] == F.col("s")) & (w["stop"] == F.col("e")))
    pieces = (
        parts.select("conv", "seq", "illegal", "ways")
        .join(chosen.select("seq", F.col("start").alias("s"), F.col("stop").alias("e"), "border", F.col("cost").alias("total"), "closing"), "seq")
        .select("conv", "seq", "total", F.expr("illegal + border").alias("illegal"), F.concat(F.get(taken, F.lit(0))["audit"], "closing").alias("piece"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return pieces.groupBy("conv").agg(
        F.max("total").alias("cost"),
        F.array_join(F.transform(in_order, lambda p: p["piece"]), "").alias("audit"),
        F.sum("illegal").alias("illegal"),
    )


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    def known(column: str) -> Column:
        return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))

    return rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        known(role).alias("role"),
        known(text).alias("text"),
    )


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def report(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    ids: DataFrame | None = None,
) -> DataFrame:
    """One row per conversation: its id, ``FACTS``, of which ``audit`` has the letters of its edits.

    Rows go by turn, null turns first; those of one turn by role, then by sha256 of the text. Each
    row's first fault counts: blank, duplicate (role and text of an earlier row), truncated (its last
    character that isn't white space is none of ``.!?``). ``illegal`` counts neighbours whose roles
    don't alternate, ``gaps`` the whole turns missing between the least and the greatest. Null
    roles and texts count as one space, so the texts are blank. Rows of a null id are one conversation.
    ``ids`` has conversations to report even without rows: zeros and an empty audit. Other columns are
    ignored.
    """
    plain = _rows(rows, conv, turn, role, text)
    flagged = materialize(_flagged(materialize(_keyed(plain), "repair-rows")), "repair-flags")
    runs = materialize(_runs(flagged), "repair-runs")
    solved = runs.filter("whole").select("conv", "cost", "audit", "illegal")
    solved = solved.unionByName(_composed(runs.filter("not whole")))
    again = F.when(F.col("blank"), 0).when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1)
    by_turn = flagged.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("n_blank"),
        F.sum(again).alias("n_duplicate"),
        F.sum((F.col("truncated") & ~F.col("blank") & ~F.col("seen")).cast("bigint")).alias("n_truncated"),
    )
    every = by_turn.unionByName(solved, allowMissingColumns=True)
    if ids is not None:
        every = every.unionByName(ids.select(F.col(f"`{conv}`").alias("conv")).distinct(), allowMissingColumns=True)
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    return every.groupBy(F.col("conv").alias(conv)).agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        total("n_blank").alias("blank"),
        total("n_duplicate").alias("duplicate"),
        total("n_truncated").alias("truncated"),
        total("illegal").alias("illegal"),
        total("cost").alias("cost"),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
    )


def _in_order(rows: DataFrame, facts: DataFrame, conv: str) -> DataFrame:
    """Each conversation's facts, then its rows, all in one partition and in order."""
    head = facts.select(F.col(f"`{conv}`").alias("conv"), F.lit(True).alias("head"), F.struct(*FACTS).alias("facts"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    both = head.unionByName(rows.select("*", digest, F.lit(False).alias("head")), allowMissingColumns=True)
    return (
        both.repartition("conv")
        .sortWithinPartitions("conv", F.desc("head"), F.asc_nulls_first("turn"), "role", "digest")
        .select("conv", "head", "facts", "turn", "role", "text")
    )


class _Walk:
    """Walks rows beside their conversation's audit, from batch to batch."""

    def __init__(self):
        self.audit, self.at, self.state = "", 0, 0

    def _inserted(self) -> Iterator[str]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _FITTING[self.state]
            yield _ROLE[self.state]

    def lines(self, batch: pa.RecordBatch) -> Iterator[tuple[int, str, str]]:
        """Row of the batch, letter and role of each repaired row; a conversation begins with letter ""."""
        facts, heads = batch.column("facts"), batch.column("head").to_pylist()
        audits, roles = facts.field("audit").to_pylist(), batch.column("role").to_pylist()
        for i, head in enumerate(heads):
            if head:
                self.audit, self.at, self.state = audits[i], 0, 0
                yield i, "", ""
            else:
                letter = self.audit[self.at]
                self.at += 1
                if letter == "K":
                    self.state = _FOLLOW[self.state][roles[i][:1]]
                    yield i, "K", roles[i]
                elif letter == "R":
                    self.state = _FITTING[self.state]
                    yield i, "R", _ROLE[self.state]
            for role in self._inserted():
                yield i, "I", role


def repaired(
    rows: DataFrame,
    facts: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The repaired rows: id, ``place`` from 0, ``edit`` (K, R or I), turn, role and text.

    ``facts`` is the report of ``rows``. Inserted rows have no turn and an empty text.
    """
    inputs = _in_order(_rows(rows, conv, turn, role, text), facts, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, place = _Walk(), 0
        for batch in batches:
            for block in byte_blocks(batch, "text", TEXT_BYTES):
                taken, places, letters, roles = [], [], [], []
                for i, letter, name in walk.lines(block):
                    if not letter:
                        place = 0
                        continue
                    taken.append(i)
                    places.append(place)
                    letters.append(letter)
                    roles.append(name)
                    place += 1
                at = pa.array(taken, pa.int64())
                own = pa.array([None if x == "I" else i for i, x in zip(taken, letters)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("conv").take(at),
                        pa.array(places, pa.int64()),
                        pa.array(letters, pa.string()),
                        block.column("turn").take(own),
                        pa.array(roles, pa.string()),
                        block.column("text").take(own).fill_null(""),
                    ],
                    names=["conv", "place", "edit", "turn", "role", "text"],
                )

    kind = dict(inputs.dtypes)["conv"]
    schema = f"conv {kind}, place bigint, edit string, turn bigint, role string, text string"
    return inputs.mapInArrow(run, schema).withColumnsRenamed({"conv": conv, "turn": turn, "role": role, "text": text})


def with_digest(
    rows: DataFrame,
    facts: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``facts``, the report of ``rows``, with ``repaired_sha256`` of the repaired conversation.

    It is that of the lines ``role:text``, joined by line breaks; of nothing if no row is left. A
    conversation's rows pass one task, as a digest needs them in turn, but never together.
    """
    inputs = _in_order(_rows(rows, conv, turn, role, text), facts, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, current, digest, empty = _Walk(), None, None, True
        for batch in batches:
            out = []
            schema = pa.schema(
                [batch.schema.field("conv"), *batch.schema.field("facts").type, ("repaired_sha256", pa.string())]
            )
            for block in byte_blocks(batch, "text", TEXT_BYTES):
                texts = block.column("text").cast(pa.binary()).to_pylist()
                for i, letter, name in walk.lines(block):
                    if not letter:
                        if current is not None:
                            out.append(current | {"repaired_sha256": digest.hexdigest()})
                        current = {"conv": block.column("conv")[i].as_py()} | block.column("facts")[i].as_py()
                        digest, empty = hashlib.sha256(), True
                        continue
                    digest.update(b"" if empty else b"\n")
                    digest.update(name.encode() + b":" + (b"" if letter == "I" else texts[i]))
                    empty = False
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if current is not None:
            last = [current | {"repaired_sha256": digest.hexdigest()}]
            yield pa.RecordBatch.from_pylist(last, schema=schema)

    kind = dict(inputs.dtypes)["conv"]
    schema = f"conv {kind}, " + ", ".join(f"{f} {'string' if f == 'audit' else 'bigint'}" for f in FACTS)
    return inputs.mapInArrow(run, f"{schema}, repaired_sha256 string").withColumnRenamed("conv", conv)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20; nulls in the key, roles and texts are a space.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return (
        conversations.withColumn("_kind", kind)
        .filter("_kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(F.col("_kind") == 1, "")
            .when(F.col("_kind") == 2, F.translate(text, ".!?", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("col")
    )
