"""Conversation structure repair: the cheapest edits that give a conversation the role order (system? (user assistant)+)?.

A conversation's rows are taken by turn (nulls first), then role and text. A row's first fault counts: blank, duplicate
(role and text seen earlier) or truncated (it does not end in . ! ?). Edits: Keep costs 0, Rerole to user or assistant 2,
Delete 3, Insert of an empty user or assistant row, anywhere, 2. Blank and duplicate rows have to go; a truncated row that
stays costs 1 more. Of the cheapest edits those are taken whose initials, in order, come first.

1. Order. Rows are sorted over all tasks into blocks, each of which holds a stretch of conversations; a conversation of any
   length is a run of segments, one a block. Duplicates are told by the least place of a role and text.
2. Costs. A node is a row and a state of the role order (nothing yet, behind system, user or assistant). A segment is
   told by the least costs from each state ahead of it to each state behind it. By conversation these give the forward
   costs at a segment's beginning and the backward costs at its end.
3. Tight arcs. With both costs, an arc lies on a cheapest path where forward, own and backward cost add up to the least.
   From the set of nodes that all edits chosen so far may have led to (the frontier) the least letter of a tight arc is
   chosen, step by step. A row is used up by each letter but I, so that the frontier stands ahead of one row, always. Where
   a conversation has several segments, each first tells where any frontier ahead of it leads.

Costs are kept relative to the least one, so that there are few different steps; each is worked out once a task.

Result: edits by row and by conversation. Texts go by once, to be put into the repaired turns. The digest of a conversation
is that of its turns in order, read as a stream by one task without being held; so is its audit one string.

Defined results: null roles and texts are one space here, so that a null text is blank and a null role fits nowhere; a null
conversation id is a conversation of its own. Without rows there is no conversation. Repeated rows are duplicates. Other
columns are not read. Roles count by their first character, as it is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, cut_lineage

SPACE = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows of a block, about: a segment's faults and edits are held by one task.
BLOCK_ROWS = 50_000
#: States: nothing yet, behind system, behind user, behind assistant. What a state goes to by the initial of a kept row.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What it goes to by a row that is made user or assistant.
MADE = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
#: Beyond any difference that a cheapest path can make up for: states are at most two inserts and a row apart.
FAR = 64
NEVER = 1 << 60
#: What the end costs by state: inserts that are still needed.
ENDING = (0, 2 * INSERT, INSERT, 0)
#: A row as a letter: its initial, or x for any other one; upper case if it is truncated; d if it has to go.
MUST_GO = "d"


def fault(text: Column) -> Column:
    """blank, truncated or null, by the row alone."""
    stripped = F.rtrim(text, F.lit(SPACE))
    return F.when(stripped == "", "blank").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated")


def _arcs(letter: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) of a row."""
    found = [("D", q, q, DELETE) for q in range(4)]
    if letter != MUST_GO:
        more = TRUNCATED if letter.isupper() else 0
        found += [("K", q, to, more) for (q, initial), to in KEPT.items() if initial == letter.lower()]
        found += [("R", q, to, REROLE + more) for q, to in MADE.items()]
    return found


def _closed(costs: list[int], backward: bool) -> tuple[int, ...]:
    """With inserts allowed; relative to the least, and no more than FAR."""
    for _ in range(2):
        for q, to in MADE.items():
            if backward:
                costs[q] = min(costs[q], costs[to] + INSERT)
            else:
                costs[to] = min(costs[to], costs[q] + INSERT)
    return tuple(costs)


def _relative(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(min(c - least, FAR) for c in costs), least


@functools.cache
def forward(costs: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], int]:
    """Costs ahead of the next row, from those ahead of this one (inserts included), and what was taken off them."""
    after = [NEVER] * 4
    for _, q, to, cost in _arcs(letter):
        after[to] = min(after[to], costs[q] + cost)
    return _relative(_closed(after, False))


@functools.cache
def backward(costs: tuple[int, ...], letter: str) -> tuple[int, ...]:
    """Costs from ahead of this row (inserts included) to the end, from those ahead of the next one."""
    ahead = [NEVER] * 4
    for _, q, to, cost in _arcs(letter):
        ahead[q] = min(ahead[q], costs[to] + cost)
    return _relative(_closed(ahead, True))[0]


@functools.cache
def step(ahead: tuple[int, ...], behind: tuple[int, ...], after: tuple[int, ...], letter: str, frontier: frozenset[int]) -> tuple[str, tuple[int, ...], frozenset[int]]:
    """(edits, states that inserts led to, next frontier) over one row: `ahead` are forward and `behind` backward costs here, `after` backward costs ahead of the next row."""
    inserts = min(a + b for a, b in zip(ahead, behind))
    arcs = [(ahead[q] + cost + after[to], edit, q, to) for edit, q, to, cost in _arcs(letter)]
    least = min(arcs)[0]
    edits, made = "", []
    while True:
        open_arcs = [(edit, to) for cost, edit, q, to in arcs if cost == least and q in frontier]
        open_arcs += [("I", MADE[q]) for q in frontier if ahead[q] + INSERT + behind[MADE[q]] == inserts]
        edit = min(open_arcs)[0]
        frontier = frozenset(to for e, to in open_arcs if e == edit)
        edits += edit
        if edit != "I":
            return edits, tuple(made), frontier
        made += frontier  # by inserts all go on to user, or all to assistant


@functools.cache
def finish(frontier: frozenset[int]) -> tuple[int, ...]:
    """The states that the last inserts lead to."""
    made: list[int] = []
    while not frontier & {0, 3}:
        frontier = frozenset(MADE[q] for q in frontier)
        made += frontier
    return tuple(made)


def ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, text, fault, place): place is the row's in the order of all rows, and its high bits are its block."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("tie", F.monotonically_increasing_id())
    blocks = max(1, -(-rows.count() // BLOCK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "tie")]
    rows = scratch.write(rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).drop("tie").withColumn("place", F.monotonically_increasing_id()))
    rows = rows.withColumn("fault", fault(F.col("text")))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    first = rows.where("fault is null or fault != 'blank'").groupBy("conv_id", said.alias("said")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    seen = (F.col("fault") != "blank") & F.col("first").isNull() | F.col("fault").isNull() & F.col("first").isNull()
    return rows.join(first, "place", "left").withColumn("fault", F.when(seen, "duplicate").otherwise(F.col("fault"))).drop("first")


def lettered(rows: DataFrame) -> DataFrame:
    """(block, place, conv_id, initial, letter) of `ordered` rows."""
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.select(F.shiftright("place", 33).alias("block"), "place", "conv_id", known.alias("initial"), letter.alias("letter"))


class _Segment:
    """Rows of one conversation in one block, and what is told of it ahead of them."""

    def __init__(self, conv_id: object, told: dict | None):
        self.conv_id, self.told = conv_id, told
        self.places: list[int] = []
        self.initials: list[str] = []
        self.letters: list[str] = []


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[_Segment]:
    """Of rows in order (block, place, is_row, conv_id, initial, letter, told): a row that is none tells of the segment that begins there."""
    own, last = None, None
    for batch in batches:
        for block, place, is_row, conv_id, initial, letter, told in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "is_row", "conv_id", "initial", "letter", "told"))):
            if own is None or (block, conv_id) != last or not is_row:
                if own is not None and own.places:
                    yield own
                own, last = _Segment(conv_id, None), (block, conv_id)
            if is_row:
                own.places.append(place)
                own.initials.append(initial)
                own.letters.append(letter)
            else:
                own.told = told
    if own is not None and own.places:
        yield own


TOLD = "struct<ahead:array<int>,behind:array<int>,frontier:array<int>,ends:boolean>"


def _by_block(letters: DataFrame, told: DataFrame | None) -> DataFrame:
    """Rows of each block in order, with what is told of segments (block, place, conv_id, told) ahead of each."""
    rows = letters.select("block", "place", F.lit(1).alias("is_row"), "conv_id", "initial", "letter", F.lit(None).cast(TOLD).alias("told"))
    if told is not None:
        rows = rows.unionByName(told.select("block", "place", F.lit(0).alias("is_row"), "conv_id", F.lit("").alias("initial"), F.lit("").alias("letter"), "told"))
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(partitions, "block").sortWithinPartitions("block", "place", "is_row")


def _sum_of(pairs: str) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(pairs, pairs[1:]))


def _costs_of(segments: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for s in _segments(segments):
        matrix: list[int] = []
        for q in range(4):
            costs, total = _relative(_closed([0 if k == q else NEVER for k in range(4)], False))
            for letter in s.letters:
                costs, least = forward(costs, letter)
                total += least
            matrix += [c + total if c < FAR else -1 for c in costs]
        yield {"place": s.places[0], "conv_id": s.conv_id, "matrix": matrix, "ends": s.initials[0] + s.initials[-1], "illegal": _sum_of("".join(s.initials))}


def _walk(s: _Segment, frontiers: list[frozenset[int]]) -> Iterator[tuple[frozenset[int], list[tuple[str, tuple[int, ...], frozenset[int]]]]]:
    """For each frontier ahead of the segment, the steps over its rows."""
    ahead = [tuple(s.told["ahead"])]
    for letter in s.letters:
        ahead.append(forward(ahead[-1], letter)[0])
    behind = [tuple(s.told["behind"])]
    for letter in reversed(s.letters):
        behind.append(backward(behind[-1], letter))
    behind.reverse()
    for frontier in frontiers:
        steps = []
        for k, letter in enumerate(s.letters):
            steps.append(step(ahead[k], behind[k], behind[k + 1], letter, steps[-1][2] if steps else frontier))
        yield frontier, steps


def _leads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of segments that are told of: where each set of states on cheapest paths leads."""
    for s in _segments(batches):
        if s.told is None:
            continue
        ahead = s.told["ahead"]
        behind = tuple(s.told["behind"])
        for letter in reversed(s.letters):
            behind = backward(behind, letter)
        least = min(a + b for a, b in zip(ahead, behind))
        alive = [q for q in range(4) if ahead[q] + behind[q] == least]
        sets = [frozenset(q for k, q in enumerate(alive) if mask >> k & 1) for mask in range(1, 1 << len(alive))]
        # States of a frontier have been reached at one cost.
        sets = [f for f in sets if len({ahead[q] for q in f}) == 1]
        for frontier, steps in _walk(s, sets):
            yield {"place": s.places[0], "conv_id": s.conv_id, "came": sum(1 << q for q in frontier), "went": sum(1 << q for q in steps[-1][2])}


def _edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for s in _segments(batches):
        (_, steps), = _walk(s, [frozenset(s.told["frontier"])])
        last = finish(steps[-1][2]) if s.told["ends"] else ()
        audit = "".join(edits for edits, _, _ in steps) + "I" * len(last)
        for k, (edits, made, frontier) in enumerate(steps):
            roles: list[str | None] = [ROLE[q] for q in made]
            own = None if edits[-1] == "D" else len(roles)
            if own is not None:
                roles.append(None if edits[-1] == "K" else ROLE[min(frontier)])
            if k + 1 == len(steps):
                roles += [ROLE[q] for q in last]
            yield {"place": s.places[k], "conv_id": s.conv_id, "roles": roles, "own": own, "audit": audit if k == 0 else None}


def _told(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in found:
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(rows: DataFrame, work, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """`rows` through `work`, which yields place, conv_id and `fields` (name, Arrow type, Spark type)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([("place", pa.int64()), ("conv_id", first.schema.field("conv_id").type), *((n, t) for n, t, _ in fields)])
            yield from _told(work(b for part in ([first], batches) for b in part), schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"place long, conv_id {kind}, " + ", ".join(f"{n} {t}" for n, _, t in fields))


def _ahead_and_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of the segments of each conversation, together and in order: forward and backward costs, the least cost, and their number."""
    held: list[dict] = []

    def told() -> Iterator[dict]:
        costs = [(0, NEVER, NEVER, NEVER)]
        for s in held:
            m = [c if c >= 0 else NEVER for c in s["matrix"]]
            costs.append(tuple(min(costs[-1][q] + m[4 * q + to] for q in range(4)) for to in range(4)))
        after = [ENDING]
        for s in reversed(held):
            m = [c if c >= 0 else NEVER for c in s["matrix"]]
            after.append(tuple(min(m[4 * q + to] + after[-1][to] for to in range(4)) for q in range(4)))
        after.reverse()
        illegal = sum(s["illegal"] for s in held) + sum(_sum_of(a["ends"][1] + b["ends"][0]) for a, b in zip(held, held[1:]))
        for k, s in enumerate(held):
            ahead = _relative(_closed(list(costs[k]), False))[0]
            frontier = [0] if k == 0 else None
            yield {"place": s["place"], "conv_id": s["conv_id"], "told": {"ahead": list(ahead), "behind": list(_relative(after[k + 1])[0]), "frontier": frontier, "ends": k + 1 == len(held)}, "cost": after[0][0], "segments": len(held), "illegal": illegal}

    last = None
    for batch in batches:
        for s in batch.to_pylist():
            if held and s["conv_id"] != last:
                yield from told()
                held = []
            held.append(s)
            last = s["conv_id"]
    if held:
        yield from told()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of (place, conv_id, came, went) together and in order by conversation: the frontier ahead of each segment."""
    last, place, now, leads = None, None, 1, {}
    for batch in batches:
        for row in batch.to_pylist():
            if (row["conv_id"], row["place"]) != (last, place):
                now = leads[now] if place is not None and row["conv_id"] == last else 1
                last, place, leads = row["conv_id"], row["place"], {}
                yield {"place": place, "conv_id": last, "frontier": [q for q in range(4) if now >> q & 1]}
            leads[row["came"]] = row["went"]


_INTS = pa.list_(pa.int32())
_TOLD = pa.struct([("ahead", _INTS), ("behind", _INTS), ("frontier", _INTS), ("ends", pa.bool_())])


def _by_conversation(rows: DataFrame) -> DataFrame:
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "place")


def edits(letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `lettered` rows: (place, conv_id, roles array<string>, own int, audit) by row, and (place, conv_id, cost, illegal, segments) by segment.

    roles are those of the turns that stand for the row: null for its own role, and own is the place of the row's own text
    among them. A segment's first row has the segment's audit.
    """
    costs = _mapped(_by_block(letters, None), _costs_of, [("matrix", pa.list_(pa.int64()), "array<long>"), ("ends", pa.string(), "string"), ("illegal", pa.int64(), "long")])
    told = _mapped(_by_conversation(costs), _ahead_and_behind, [("told", _TOLD, TOLD), ("cost", pa.int64(), "long"), ("segments", pa.int64(), "long"), ("illegal", pa.int64(), "long")])
    told = cut_lineage(told.withColumn("block", F.shiftright("place", 33)))
    several = told.where("segments > 1").drop("segments")
    chosen = told.select("block", "place", "conv_id", "told")
    if not several.isEmpty():
        leads = _mapped(_by_block(letters, several), _leads_of, [("came", pa.int32(), "int"), ("went", pa.int32(), "int")])
        known = _mapped(_by_conversation(leads), _chained, [("frontier", _INTS, "array<int>")]).select(F.col("place"), F.col("frontier").alias("known"))
        chosen = chosen.join(cut_lineage(known), "place", "left").withColumn("told", F.col("told").withField("frontier", F.coalesce("known", "told.frontier"))).drop("known")
    found = _mapped(_by_block(letters, chosen), _edits_of, [("roles", pa.list_(pa.string()), "array<string>"), ("own", pa.int32(), "int"), ("audit", pa.string(), "string")])
    return found, told.select("place", "conv_id", "cost", "illegal", "segments")


def turns(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(conv_id, place, at, role, text): the repaired conversations, in the order of place and at."""
    joined = rows.select("place", "conv_id", F.col("role").alias("_role"), F.col("text").alias("_text")).join(made.select("place", "roles", "own"), "place")
    found = joined.select("conv_id", "place", "_role", "_text", "own", F.posexplode("roles").alias("at", "role"))
    return found.select("conv_id", "place", "at", F.coalesce("role", "_role").alias("role"), F.when(F.col("at") == F.col("own"), F.col("_text")).otherwise("").alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's `role:text`, joined by newlines; a conversation passes through a task as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, last, seen = hashlib.sha256(), None, False
        for batch in batches:
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if seen and conv_id != last:
                    yield {"place": 0, "conv_id": last, "sha256": own.hexdigest()}
                    own, seen = hashlib.sha256(), False
                own.update(("\n" * seen + line).encode())
                last, seen = conv_id, True
        if seen:
            yield {"place": 0, "conv_id": last, "sha256": own.hexdigest()}

    partitions = max(int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    lines = repaired.select("conv_id", "place", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "place", "at")
    return _mapped(lines, run, [("sha256", pa.string(), "string")]).drop("place")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (conv_id, turn, role, text): the summary of each conversation, and the repaired turns as `turns` gives them.

    Summary: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).
    """
    scratch = Scratch(rows.sparkSession)
    rows = scratch.write(ordered(rows, scratch))
    letters = lettered(rows)
    made, segments = edits(letters)
    made = scratch.write(made)
    repaired = turns(rows, made)
    faults = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    # Counted by turn first, so that a long conversation's rows do not meet.
    by_turn = rows.groupBy("conv_id", "turn").agg(*faults)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = by_turn.groupBy("conv_id").agg(gaps, *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    whole = segments.groupBy("conv_id").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "audit"))), lambda p: p["audit"])
    audits = made.where("audit is not null").groupBy("conv_id").agg(F.array_join(parts, "").alias("audit"))
    found = counts
    for more in (whole, audits, digests(repaired).withColumnRenamed("sha256", "repaired_sha256")):
        more = more.withColumnRenamed("conv_id", "_id")
        found = found.join(more, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))), repaired
