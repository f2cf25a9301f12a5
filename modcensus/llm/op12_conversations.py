"""Repair of a conversation's structure at least cost, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows passed, state): nothing yet, after a system row, after a user row, after an
assistant row. Edges are the edits: Keep a row, Rerole it to the role that is due, Delete it, Insert an empty
row of the role that is due. A forward and a reverse heap settle nodes by cost until no cheaper
path can cross between them and all crossings of the least cost are known; of these the one with the
least concatenated audit (the edits' initials) wins. At one node, two cheapest audits of different
length cannot begin alike, since insertions cost; so least parts make the least whole. The audit also says
which role each edit gives: only one is due in each state.

Conversations of at most ``ROWS`` rows are solved one after the other in their sorted partition. Longer
ones, which may hold any share of all rows, are counted by equal rows and cut into segments of at most
``ROWS`` rows, spread over tasks. A segment gives the cheapest edits from each state at its start to each at
its end, by the same search. These ways are chained by their costs from the end and their audits from the
start, and each segment is repaired where it lies. Only the audit and the hash, single values of a
conversation, are put together in sequence, in a pass that holds one segment at a time besides the audit.
Duplicates in long conversations are found by an aggregate of digests that combines before its shuffle.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are in
the order of role and text; a null conv_id is a conversation of its own; conversations without rows
have zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modcensus.llm.common import land
from modcensus.operators.joins import join_single

ROWS = 512  # of a segment, and of a conversation that one search solves
BYTES = 1 << 22  # of the text that a segment or a batch of results starts to hold no more of
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
CUT_OFF = 3  # added for a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
#: the states that a role's initial leads to
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DUE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
_SPACE = " \t\n\x0b\x0c\r"

Edge = tuple[tuple[int, int], int, str]
Edges = Callable[[tuple[int, int]], list[Edge]]


def fault(text: str) -> str:
    """A row's own fault, without regard to rows before it."""
    bare = text.rstrip(_SPACE)
    return BLANK if not bare else SOUND if bare[-1] in ".!?" else TRUNCATED


def edit_edges(rows: list[tuple[str, str, int]]) -> tuple[Edges, Edges]:
    """Edges out of and into a node of the lattice of (initial, fault, further copies) rows.

    A row's further copies are deleted with it or right after it: a deletion's initial is the least.
    """

    def passing(i: int, state: int) -> list[tuple[int, int, str]]:
        """(next state, cost, letters) of the edits that pass row i."""
        initial, wrong, copies = rows[i]
        after, less = COST[DELETE] * copies, DELETE * copies
        found = [(state, COST[DELETE] + after, DELETE + less)]
        if wrong not in (BLANK, DUPLICATE):
            more = CUT_OFF * (wrong == TRUNCATED) + after
            if (state, initial) in STEPS:
                found.append((STEPS[state, initial], COST[KEEP] + more, KEEP + less))
            found.append((STEPS[state, DUE[state]], COST[REROLE] + more, REROLE + less))
        return found

    def out(node: tuple[int, int]) -> list[Edge]:
        i, state = node
        found = [((i, STEPS[state, DUE[state]]), COST[INSERT], INSERT)]
        if i < len(rows):
            found += [((i + 1, to), cost, letter) for to, cost, letter in passing(i, state)]
        return found

    def into(node: tuple[int, int]) -> list[Edge]:
        i, state = node
        found = [((i, before), COST[INSERT], INSERT) for before in STATES if STEPS[before, DUE[before]] == state]
        if i:
            found += [((i - 1, before), cost, letter) for before in STATES for to, cost, letter in passing(i - 1, before) if to == state]
        return found

    return out, into


def cheapest(out: Edges, into: Edges, starts: list[tuple[int, int]], goals: list[tuple[int, int]]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way, the least audit among equals.

    Nodes are settled in the order of cost, then of rows passed (towards the other side), so edges without
    cost find their end unsettled.
    """
    sides = (_Side(out, starts, 1), _Side(into, goals, -1))
    best = None
    while all(side.heap for side in sides):
        if best is not None and sides[0].heap[0][0] + sides[1].heap[0][0] > best:
            break
        side = min(sides, key=lambda one: one.heap[0][0])
        other = sides[1] if side is sides[0] else sides[0]
        node = side.settle()
        if node is None:
            continue
        cost = side.settled[node][0]
        if node in other.settled:
            total = cost + other.settled[node][0]
            best = total if best is None else min(best, total)
        for near, more, _ in side.edges(node):
            if near in other.settled:
                total = cost + more + other.settled[near][0]
                best = total if best is None else min(best, total)
    # one side may have settled all it can reach: every crossing is an edge or a node that both know
    forward, reverse = sides
    found = []
    for node, (cost, audit) in forward.settled.items():
        if node in reverse.settled:
            found.append((cost + reverse.settled[node][0], audit + reverse.settled[node][1]))
        for near, more, letters in out(node):
            if near in reverse.settled:
                found.append((cost + more + reverse.settled[near][0], audit + letters + reverse.settled[near][1]))
    return min(found, default=None)


class _Side:
    def __init__(self, edges: Edges, roots: list[tuple[int, int]], direction: int):
        self.edges, self.direction = edges, direction
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}
        self.open = {root: (0, "") for root in roots}
        self.heap = [(0, direction * root[0], root[1]) for root in roots]
        heapq.heapify(self.heap)

    def settle(self) -> tuple[int, int] | None:
        """Settle the next node and tell its neighbours; None if it was settled before."""
        cost, place, state = heapq.heappop(self.heap)
        node = (self.direction * place, state)
        if node in self.settled:
            return None
        self.settled[node] = cost, audit = self.open.pop(node)
        for near, more, letters in self.edges(node):
            if near in self.settled:
                continue
            way = (cost + more, audit + letters if self.direction > 0 else letters + audit)
            known = self.open.get(near)
            if known is None or way < known:
                self.open[near] = way
                if known is None or way[0] < known[0]:
                    heapq.heappush(self.heap, (way[0], self.direction * near[0], near[1]))
        return node


def segment_ways(rows: list[tuple[str, str, int]]) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, audit) over all rows of a segment."""
    out, into = edit_edges(rows)
    found = []
    for start in STATES:
        for goal in STATES:
            way = cheapest(out, into, [(0, start)], [(len(rows), goal)])
            if way:
                found.append((start, goal, *way))
    return found


def chained(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The whole cost, and each segment's state at its start and audit, of the cheapest way with the least audit.

    Of the audits of ways that still compete only what they do not share is kept.
    """
    left = [dict.fromkeys(FINAL, 0)]
    for ways in reversed(segments):
        costs: dict[int, int] = {}
        for start, to, cost, _ in ways:
            if to in left[-1]:
                costs[start] = min(costs.get(start, cost + left[-1][to]), cost + left[-1][to])
        left.append(costs)
    left.reverse()
    rivals: dict[int, tuple[str, tuple | None]] = {START: ("", None)}
    for ways, here, then in zip(segments, left[:-1], left[1:], strict=True):
        found: dict[int, tuple[str, tuple | None]] = {}
        for start, to, cost, audit in ways:
            if start in rivals and to in then and cost + then[to] == here[start]:
                own = (rivals[start][0] + audit, (rivals[start][1], start, audit))
                if to not in found or own[0] < found[to][0]:
                    found[to] = own
        shared = len(commonprefix([text for text, _ in found.values()]))
        rivals = {state: (text[shared:], way) for state, (text, way) in found.items()}
    _, way = min(rivals.values(), key=lambda one: one[0])
    parts = []
    while way:
        way, start, audit = way
        parts.append((start, audit))
    return left[0][START], parts[::-1]


def repaired(audit: str, rows: list[tuple[str, str, int]], state: int = START) -> list[tuple[str, str]]:
    """(role, text) rows after the edits of (role, text, further copies) rows."""
    found, row, at = [], 0, 0
    while at < len(audit):
        letter = audit[at]
        at += 1
        if letter == INSERT:
            role, text = NAMES[DUE[state]], ""
        else:
            role, text, copies = rows[row]
            row += 1
            at += copies
            if letter == DELETE:
                continue
            if letter == REROLE:
                role = NAMES[DUE[state]]
        state = STEPS[state, role[:1]]
        found.append((role, text))
    return found


class _Tally:
    """Counters of rows in their order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, initial: str, wrong: str, copies: int) -> None:
        # copies of a blank row are blank, those of others duplicates
        self.blank += (1 + copies) * (wrong == BLANK)
        self.duplicate += (wrong == DUPLICATE) + copies * (wrong != BLANK)
        self.truncated += wrong == TRUNCATED
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + copies
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def values(self) -> dict:
        return dict(self.__dict__)

    @staticmethod
    def total(parts: list[dict]) -> dict:
        """Of parts that follow each other."""
        illegal, turns, low, high, last = 0, 0, None, None, None
        for part in parts:
            illegal += part["illegal"] + (last is not None and last + part["first"] not in LEGAL)
            last = part["last"]
            if part["low"] is not None:
                turns += part["turns"] - (part["low"] == high)
                low = part["low"] if low is None else low
                high = part["high"]
        sums = {name: sum(part[name] for part in parts) for name in (BLANK, DUPLICATE, TRUNCATED)}
        return {"gaps": 0 if low is None else high - low + 1 - turns, **sums, "illegal": illegal}


COUNTERS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _solve(out: pa.Schema):
    """Whole conversations from rows in their order."""

    def solved(rows: list[dict]) -> dict:
        seen, tally, lattice = set(), _Tally(), []
        for row in rows:
            wrong = fault(row["text"])
            said = (row["role"], row["text"])
            if wrong != BLANK and said in seen:
                wrong = DUPLICATE
            seen.add(said)
            lattice.append((row["role"][:1], wrong, 0))
            tally.add(row["turn"], row["role"][:1], wrong, 0)
        cost, audit = cheapest(*edit_edges(lattice), [(0, START)], [(len(lattice), state) for state in FINAL])
        result = repaired(audit, [(row["role"], row["text"], 0) for row in rows])
        return {
            "conv_id": rows[0]["conv_id"],
            "found": _Tally.total([tally.values()]) | {"cost": cost},
            "audit": audit,
            "repaired": [{"role": role, "text": text} for role, text in result],
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        made: list[dict] = []
        size = 0
        for row in _runs(batches):
            if held and row["_key_"] != held[0]["_key_"]:
                made.append(solved(held))
                held = []
                if len(made) >= 500 or size > BYTES:
                    yield pa.RecordBatch.from_pylist(made, schema=out)
                    made, size = [], 0
            held.append(row)
            size += len(row["text"])
        if held:
            made.append(solved(held))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=out)

    return read


def _cut(out: pa.Schema, most: int):
    """Segments of long conversations from rows in their order."""

    def segment(rows: list[dict], place: int) -> dict:
        tally, lattice = _Tally(), []
        for row in rows:
            wrong = fault(row["text"])
            if wrong != BLANK and row["_seen_"]:
                wrong = DUPLICATE
            lattice.append((row["role"][:1], wrong, row["copies"] - 1))
            tally.add(row["turn"], row["role"][:1], wrong, row["copies"] - 1)
        ways = [dict(zip(("start", "to", "cost", "audit"), way, strict=True)) for way in segment_ways(lattice)]
        kept = [{name: row[name] for name in ("role", "text", "copies")} for row in rows]
        return {"_key_": rows[0]["_key_"], "conv_id": rows[0]["conv_id"], "segment": place, "tally": tally.values(), "ways": ways, "rows": kept}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        size = 0
        for row in _runs(batches):
            if held and (row["_key_"] != held[0]["_key_"] or len(held) >= most or size > BYTES):
                yield pa.RecordBatch.from_pylist([segment(held, place)], schema=out)
                held, size, place = [], 0, place + 1
            held.append(row)
            size += len(row["text"])
        if held:
            yield pa.RecordBatch.from_pylist([segment(held, place)], schema=out)

    return read


def _chain(segments: pd.DataFrame) -> pd.DataFrame:
    """Start state and audit of each segment of a conversation; counters at its first."""
    rows = segments.sort_values("segment").to_dict("records")
    cost, parts = chained([[(way["start"], way["to"], way["cost"], way["audit"]) for way in row["ways"]] for row in rows])
    found = _Tally.total([row["tally"] for row in rows]) | {"cost": cost}
    return pd.DataFrame(
        {
            "_key_": [row["_key_"] for row in rows],
            "segment": [row["segment"] for row in rows],
            "start": [start for start, _ in parts],
            "audit": [audit for _, audit in parts],
            "found": [found, *[None] * (len(rows) - 1)],
        }
    )


def _mended(out: pa.Schema):
    """Repaired rows of segments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _runs(batches):
            result = repaired(row["audit"], [(one["role"], one["text"], one["copies"] - 1) for one in row["rows"]], row["start"])
            made = {name: row[name] for name in ("_key_", "conv_id", "segment", "found", "audit")}
            made["repaired"] = [{"role": role, "text": text} for role, text in result]
            yield pa.RecordBatch.from_pylist([made], schema=out)

    return read


def _hashed(out: pa.Schema):
    """One row of each conversation from its segments in their order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None
        for row in _runs(batches):
            if first is None or row["_key_"] != key:
                if first is not None:
                    yield finished(first, audit, digest)
                key, first, audit, digest, mark = row["_key_"], row, [], hashlib.sha256(), ""
            audit.append(row["audit"])
            for one in row["repaired"]:
                digest.update(f"{mark}{one['role']}:{one['text']}".encode())
                mark = "\n"
        if first is not None:
            yield finished(first, audit, digest)

    def finished(first: dict, audit: list[str], digest) -> pa.RecordBatch:
        made = {"conv_id": first["conv_id"], "found": first["found"], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([made], schema=out)

    return read


def _schemas(conv_id: T.StructField) -> dict[str, T.StructType]:
    found = T._parse_datatype_string("found STRUCT<" + ", ".join(f"{name}: LONG" for name in [*COUNTERS, "cost"]) + ">, audit STRING")
    tally = "tally STRUCT<" + ", ".join(f"{name}: LONG" for name in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")) + ", first: STRING, last: STRING>"
    ways = "ways ARRAY<STRUCT<start: INT, to: INT, cost: LONG, audit: STRING>>"
    key = T.StructField("_key_", T.StringType())
    result = T._parse_datatype_string("repaired ARRAY<STRUCT<role: STRING, text: STRING>>").fields
    segment = T._parse_datatype_string(f"segment LONG, {tally}, {ways}, rows ARRAY<STRUCT<role: STRING, text: STRING, copies: LONG>>").fields
    return {
        "solved": T.StructType([conv_id, *found.fields, *result]),
        "cut": T.StructType([key, conv_id, *segment]),
        "mended": T.StructType([key, conv_id, segment[0], *found.fields, *result]),
        "hashed": T.StructType([conv_id, *found.fields, T.StructField("repaired_sha256", T.StringType())]),
    }


def _prepared(conversations: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of short and of long conversations, as columns _key_, conv_id, turn, role, text."""
    name = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    filled = [F.coalesce(F.col(column).cast("string"), F.lit(" ")).alias(column) for column in ("role", "text")]
    rows = conversations.select(name.alias("_key_"), "conv_id", F.col("turn").cast("long").alias("turn"), *filled)
    long = rows.groupBy("_key_").agg(F.count(F.lit(1)).alias("_rows_")).where(F.col("_rows_") > most)
    sized = join_single(rows, long, ["_key_"], "left", spread=["turn", "text"])
    return sized.where("_rows_ IS NULL").drop("_rows_"), sized.where("_rows_ IS NOT NULL").drop("_rows_")


_ORDER = ["_key_", "turn", "role", "text"]  # nulls first, as ascending orders are


def _long_parts(rows: DataFrame, schemas: dict[str, T.StructType], most: int) -> DataFrame:
    """Repaired segments of long conversations."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.withColumn("_said_", F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = counted.groupBy("_key_", "_said_").agg(F.min(when).alias("_first_"), F.count(F.lit(1)).alias("_times_")).where("_times_ > 1")
    flagged = join_single(counted, firsts.drop("_times_"), ["_key_", "_said_"], "left", spread=["turn"])
    flagged = flagged.withColumn("_seen_", F.coalesce(when > F.col("_first_"), F.lit(False))).drop("_said_", "_first_")
    # a text's beginning is in the order of texts, and bounds what the range's sample brings to the driver
    ordered = flagged.repartitionByRange(*_ORDER[:-1], F.left("text", F.lit(64))).sortWithinPartitions(*_ORDER)
    segments = land(ordered.mapInArrow(_cut(to_arrow_schema(schemas["cut"]), most), schemas["cut"]), "segments")
    fields = "_key_ STRING, segment LONG, start INT, audit STRING, found " + schemas["hashed"]["found"].dataType.simpleString()
    chain = segments.select("_key_", "segment", "tally", "ways").groupBy("_key_").applyInPandas(_chain, fields)
    whole = segments.select("_key_", "conv_id", "segment", "rows").join(chain, ["_key_", "segment"])
    return whole.mapInArrow(_mended(to_arrow_schema(schemas["mended"])), schemas["mended"])


def repaired_parts(conversations: DataFrame, most: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations: whole ones, and long ones in segments.

    Whole: conv_id, found (counters and cost), audit, repaired (role and text of its rows). Segments have
    ``segment`` besides, in whose order they follow each other, and ``found`` at the first only.
    """
    schemas = _schemas(conversations.schema["conv_id"])
    short, long = _prepared(conversations, most)
    ordered = short.repartition("_key_").sortWithinPartitions(*_ORDER)
    return ordered.mapInArrow(_solve(to_arrow_schema(schemas["solved"])), schemas["solved"]), _long_parts(long, schemas, most)


def repair_report(conversations: DataFrame, most: int = ROWS) -> DataFrame:
    """conv_id, the counters, cost, audit and repaired_sha256 of each conversation that has rows."""
    whole, segments = repaired_parts(conversations, most)
    lines = F.transform("repaired", lambda row: F.concat(row["role"], F.lit(":"), row["text"]))
    whole = whole.select("conv_id", "found", "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    schema = _schemas(conversations.schema["conv_id"])["hashed"]
    # one key's segments stream through one task: its hash is one value
    joined = segments.repartition("_key_").sortWithinPartitions("_key_", "segment").mapInArrow(_hashed(to_arrow_schema(schema)), schema)
    return whole.unionByName(joined).select("conv_id", "found.*", "audit", "repaired_sha256")
