"""Conversation repair: cheapest edits to a legal order of roles, by iterative-deepening A*."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.llm.common import ship, written

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows that are searched at once; a longer conversation is a chain of such segments.
SEGMENT_ROWS = 64
#: A conversation of more segments in one partition is handed on in pieces, like one cut by a partition's end.
LOCAL_SEGMENTS = 64
#: Segments that one task composes; longer chains become a tree.
FAN = 256

#: What has been written so far: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that keeping a row of this initial leads to.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state that an inserted or renamed row leads to.
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost and edits that end a chain in each state.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LEGAL = {"su", "ua", "au"}
KEEP_INITIALS = frozenset("sua")

#: forced (must be deleted), initial of the role, truncated.
Row = tuple[bool, str, bool]


def floors(rows: list[Row]) -> list[int]:
    """A lower bound of the cost of the rows from each one on: the heuristic of the search.

    Each row costs what its cheapest edit costs. Two neighbours that cannot both stay as they are
    cost more, by the cheapest way out; such pairs are chosen without common rows.
    """
    n = len(rows)
    base = []
    for forced, initial, truncated in rows:
        stay = TRUNCATED * truncated + (0 if initial in "sua" and initial else REROLE)
        base.append(DELETE if forced else min(stay, DELETE))
    out = [0] * (n + 1)
    after = None  # the next row that need not be deleted
    for i in range(n - 1, -1, -1):
        out[i] = base[i] + out[i + 1]
        if rows[i][0]:
            continue
        if after is not None:
            first, second = rows[i][1], rows[after][1]
            if first in KEEP_INITIALS and second in KEEP_INITIALS and first + second not in LEGAL:
                extra = min(INSERT, REROLE, DELETE - base[i], DELETE - base[after])
                between = DELETE * (after - i - 1)
                out[i] = max(out[i], base[i] + between + base[after] + extra + out[after + 1])
        after = i
    return out


def least_edits(rows: list[Row], entry: int = START, leave: int | None = None, floor: list[int] | None = None) -> tuple[int, str] | None:
    """Least cost and its ASCII-least edits from state ``entry`` over all rows, or None if there are none.

    With ``leave`` the search ends right after the last row, in that state; without, it ends where
    the whole order is legal. Depth first in the order D, I, K, R under a bound, which starts at the
    heuristic and rises to the least cost that broke it. The table holds, for each state whose
    search failed, the least cost that it may still have; the first path to the end is the answer.
    """
    n = len(rows)
    live = [r for r in rows if not r[0]]
    if leave == START and entry != START:
        return None
    if leave == SYSTEM and not (entry == SYSTEM or (entry == START and any(r[1] == "s" for r in live))):
        return None
    if leave is not None and n == 0:
        return (0, "") if entry == leave else None
    floor = floors(rows) if floor is None else floor
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def moves(i: int, state: int):
        if i < n:
            forced, initial, truncated = rows[i]
            yield "D", i + 1, state, DELETE
            yield "I", i, WANTED[state], INSERT
            if not forced:
                kept = KEEP[state].get(initial)
                if kept is not None:
                    yield "K", i + 1, kept, TRUNCATED * truncated
                yield "R", i + 1, WANTED[state], REROLE + TRUNCATED * truncated
        elif leave is None:
            yield "I", i, WANTED[state], INSERT

    def reach(i: int, state: int, budget: int) -> bool:
        if i == n and (state == leave if leave is not None else state in (START, ASSISTANT)):
            return True
        least = math.inf
        for letter, row, to, cost in moves(i, state):
            rest = failed.get((row, to), floor[row])
            if cost + rest <= budget:
                path.append(letter)
                if reach(row, to, budget - cost):
                    return True
                path.pop()
                rest = failed[row, to]
            least = min(least, cost + rest)
        failed[i, state] = max(least, failed.get((i, state), 0))
        return False

    bound = floor[0]
    while not reach(0, entry, bound):
        bound = failed[0, entry]
        if bound == math.inf:
            return None
    return bound, "".join(path)


def applied(audit: str, entry: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as role:text."""
    lines, state, i = [], entry, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            state = KEEP[state][roles[i][:1]]
            lines.append(f"{roles[i]}:{texts[i]}")
        else:
            state = WANTED[state]
            lines.append(f"{ROLE[state]}:{texts[i] if letter == 'R' else ''}")
        i += letter != "I"
    return lines


class Segment:
    """Consecutive rows of one conversation, and the counts of their faults."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, role: str, text: str, fault: str) -> None:
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        forced = fault in ("blank", "duplicate")
        self.rows.append((forced, role[:1], fault == "truncated"))
        self.roles.append(role)
        self.texts.append("" if forced else text)

    def table(self) -> tuple[list[int], list[int], list[str | None]]:
        """For every entry and exit state: the least cost (-1: no way), the rank of its edits among the entry's, the edits.

        No edits of one entry are the beginning of others of it, as all end with the edit of the
        last row; so ranks decide between chains as their whole edits would.
        """
        floor = floors(self.rows)
        found = [least_edits(self.rows, s, e, floor) for s in STATES for e in STATES]
        ranks = []
        for s in STATES:
            own = [f[1] for f in found[4 * s : 4 * s + 4] if f]
            ranks += [sorted(own).index(f[1]) if f else -1 for f in found[4 * s : 4 * s + 4]]
        return [f[0] if f else -1 for f in found], ranks, [f[1] if f else None for f in found]


Table = tuple[list[int], list[int]]


def _best(left: Table, right: Table, s: int, e: int) -> tuple[int, int, int] | None:
    """Cost, rank of the left part, and middle state of the best way from s to e over two neighbours."""
    ways = [
        (left[0][4 * s + m] + right[0][4 * m + e], left[1][4 * s + m], m)
        for m in STATES
        if left[0][4 * s + m] >= 0 and right[0][4 * m + e] >= 0
    ]
    return min(ways, default=None)


def composed(left: Table, right: Table) -> Table:
    """The table of two neighbours as one."""
    costs, ranks = [-1] * 16, [-1] * 16
    for s in STATES:
        own = {e: way for e in STATES if (way := _best(left, right, s, e))}
        for rank, e in enumerate(sorted(own, key=lambda e: (own[e][1], right[1][4 * own[e][2] + e]))):
            costs[4 * s + e], ranks[4 * s + e] = own[e][0], rank
    return costs, ranks


def exit_state(whole: Table) -> int:
    """The state in which a chain from the start is left, before its closing edits."""
    return min((whole[0][e] + CLOSING[e][0], whole[1][e], e) for e in STATES if whole[0][e] >= 0)[2]


def walked(tables: list[Table], entry: int, leave: int) -> list[tuple[int, int]]:
    """Entry and exit state of every part of a chain on its best way from ``entry`` to ``leave``."""
    rest = [tables[-1]]
    for own in reversed(tables[:-1]):
        rest.append(composed(own, rest[-1]))
    rest.reverse()
    out, state = [], entry
    for i, own in enumerate(tables):
        to = leave if i == len(tables) - 1 else _best(own, rest[i + 1], state, leave)[2]
        out.append((state, to))
        state = to
    return out


def repaired_chain(segments: list[Segment]) -> tuple[int, str, str]:
    """Cost, audit and digest of a whole conversation."""
    if len(segments) == 1:
        cost, audit = least_edits(segments[0].rows)
        lines = applied(audit, START, segments[0].roles, segments[0].texts)
    else:
        tables = [s.table() for s in segments]
        whole = reduce(composed, [t[:2] for t in tables])
        last = exit_state(whole)
        cost, audit, lines = whole[0][last] + CLOSING[last][0], "", []
        for segment, table, (s, e) in zip(segments, tables, walked([t[:2] for t in tables], START, last), strict=True):
            audit += table[2][4 * s + e]
            lines += applied(table[2][4 * s + e], s, segment.roles, segment.texts)
        audit += CLOSING[last][1]
        lines += applied(CLOSING[last][1], last, [], [])
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage that crc32(conv_id:turn) mod 20 decides; nulls become a blank.

    0 drops the row (copies 0), 1 empties its text, 2 removes the text's stops, 3 repeats the row,
    4 gives it to the user. A null conv_id or turn stays null but counts as a blank in the sum.
    """
    key = [F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *key)) % 20
    text = F.coalesce(rows["text"], F.lit(" "))
    return rows.select(
        rows["conv_id"].alias("conv_id"),
        rows["turn"].cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(rows["role"], F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("copies"),
    )


def _fault(text: Column) -> Column:
    bare = F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(bare == "", F.lit("blank")).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))


def _is(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, local_segments: int = LOCAL_SEGMENTS, fan: int = FAN) -> DataFrame:
    """Per conv_id with rows: blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text and copies (how often the row stands there). The rows of
    a conversation are taken by turn, nulls first, then by role and text in code-point order; copies
    stand side by side. A null role or text counts as a blank. All rows with a null conv_id are one
    conversation. Repeated rows are duplicates of the first. An empty table gives an empty result.
    Other columns are not read. Faults, edits and the legal order are those of ``least_edits``; a
    role whose initial is none of s, u, a can only be renamed or deleted.

    Equal rows are counted before they travel, so copies are one row up to the search. The rows are
    then range-partitioned in order and read as a stream, a conversation at a time. The first and
    last conversation of a partition may be cut by its ends, and a very long one is not gathered:
    their segments of ``segment_rows`` rows carry the cost and the edits between every two states,
    are composed as a tree of ``fan`` children a node, and then learn their states from above. Only
    the digest of a repaired conversation is made in one stream, as it must be.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    counted = (
        rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], "copies")
        .where("copies > 0")
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    )
    counted = written(counted, "conversation-rows")
    first = counted.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(F.struct("turn")).alias("first"))
    own = _fault(F.col("text"))
    judged = counted.join(first, _is(F.col("conv_id"), F.col("c")) & (F.col("said") == F.col("s"))).select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        F.when(own == "blank", own).when(~_is(F.col("turn"), F.col("first.turn")), F.lit("duplicate")).otherwise(own).alias("fault"),
    )
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    ordered = judged.repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")

    counts = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    done_schema = T.StructType(
        [T.StructField("conv_id", kind)]
        + T._parse_datatype_string(
            f"{counts}, cost bigint, audit string, repaired_sha256 string, part int, seq bigint, first string, last string, "
            "costs array<bigint>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>"
        ).fields
    )
    names = done_schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        now, is_first, whole, seq = None, True, [], 0
        conv_type = None

        def tally(parts: list[Segment]) -> list[int]:
            joints = sum(a.roles[-1][:1] + b.roles[0][:1] not in LEGAL for a, b in zip(parts[:-1], parts[1:], strict=True))
            return [sum(getattr(s, c) for s in parts) for c in ("blank", "duplicate", "truncated")] + [
                sum(s.illegal for s in parts) + joints
            ]

        def hand_on() -> None:
            nonlocal whole, seq
            for s in whole:
                costs, ranks, audits = s.table()
                out.append((now, s.blank, s.duplicate, s.truncated, s.illegal, None, None, None, part, seq, s.roles[0][:1],
                            s.roles[-1][:1], costs, ranks, audits, s.roles, s.texts))
                seq += 1
            whole = []

        def end(cut: bool) -> None:
            nonlocal whole, seq
            if cut or seq:
                hand_on()
            elif whole:
                out.append((now, *tally(whole), *repaired_chain(whole), *[None] * 9))
            whole, seq = [], 0

        def flushed() -> pa.RecordBatch:
            arrays = [
                pa.array([row[k] for row in out], conv_type if k == 0 else kinds[k]) for k in range(len(names))
            ]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        whole_list, long, text = pa.list_(pa.int64()), pa.int64(), pa.string()
        kinds = [None, long, long, long, long, long, text, text, pa.int32(), long, text, text,
                 whole_list, pa.list_(pa.int32()), pa.list_(text), pa.list_(text), pa.list_(text)]
        size = 0
        begun = False
        for batch in batches:
            conv_type = batch.column("conv_id").type
            for conv, role, said, copies, fault in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "fault")), strict=True
            ):
                if not begun or conv != now:
                    if begun:
                        end(cut=is_first)
                        is_first = False
                    now, begun = conv, True
                for copy in range(copies):
                    if not whole or len(whole[-1].rows) >= segment_rows:
                        if len(whole) >= local_segments:
                            hand_on()
                        whole.append(Segment())
                    again = fault if fault == "blank" or copy == 0 else "duplicate"
                    whole[-1].add(role, said, again)
                    if len(out) >= 256:
                        yield flushed()
                size += len(said)
                if size > 4_000_000 or len(out) >= 256:
                    size = 0
                    if out:
                        yield flushed()
        if begun:
            end(cut=True)
            yield flushed()

    read_rows = written(ordered.mapInArrow(read, done_schema), "conversations")
    closed = read_rows.where("part IS NULL").select("conv_id", *COUNTS, "cost", "audit", "repaired_sha256")
    return closed.unionByName(_joined(read_rows.where("part IS NOT NULL"), kind, fan))


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _joined(pieces: DataFrame, kind: T.DataType, fan: int) -> DataFrame:
    """Conversations whose segments came from more than one place, or too many from one."""
    spark = pieces.sparkSession
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        pieces.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("c", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    )
    placed = pieces.join(begins, _is(F.col("conv_id"), F.col("c")) & (F.col("part") == F.col("p"))).withColumn(
        "idx", F.col("begin") + F.col("seq")
    )
    placed = written(placed.drop("c", "p", "begin", "n"), "conversation-segments")

    def schema(columns: str) -> T.StructType:
        return T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(columns).fields])

    def up(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("idx")
        costs, ranks = reduce(composed, [(list(c), list(r)) for c, r in zip(own["costs"], own["ranks"], strict=True)])
        return pd.DataFrame({"conv_id": own["conv_id"].iloc[:1], "idx": own["idx"].iloc[:1] // fan, "costs": [costs], "ranks": [ranks]})

    def down(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("idx")
        tables = [(list(c), list(r)) for c, r in zip(own["costs"], own["ranks"], strict=True)]
        ways = walked(tables, int(own["entry"].iloc[0]), int(own["leave"].iloc[0]))
        return pd.DataFrame({"conv_id": own["conv_id"], "idx": own["idx"], "entry": [w[0] for w in ways], "leave": [w[1] for w in ways]})

    levels = [placed.select("conv_id", "idx", "costs", "ranks")]
    while (top := levels[-1].agg(F.max("idx")).first()[0]) is not None and top > 0:
        above = levels[-1].groupBy("conv_id", F.floor(F.col("idx") / fan).alias("g")).applyInPandas(
            up, schema("idx bigint, costs array<bigint>, ranks array<int>")
        )
        levels.append(written(above, "conversation-level"))

    def leave(costs: Column, ranks: Column) -> Column:
        ends = F.array(*[F.lit(c) for c, _ in CLOSING])
        ways = F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(3)), lambda e: F.struct((costs[e] + ends[e]).alias("cost"), ranks[e].alias("rank"), e.alias("e"), (costs[e] >= 0).alias("open"))),
            lambda w: w["open"],
        )
        return F.array_min(ways)

    root = levels[-1].withColumn("best", leave(F.col("costs"), F.col("ranks")))
    ways = root.select("conv_id", "idx", F.lit(START).alias("entry"), F.col("best.e").alias("leave"))
    for own in reversed(levels[:-1]):
        above = ways.select(F.col("conv_id").alias("c"), F.col("idx").alias("g"), "entry", "leave")
        met = own.join(above, _is(F.col("conv_id"), F.col("c")) & (F.floor(F.col("idx") / fan) == F.col("g")))
        ways = written(
            met.groupBy("conv_id", "g").applyInPandas(down, schema("idx bigint, entry int, leave int")), "conversation-ways"
        )
    cost = root.select(F.col("conv_id").alias("c"), F.col("best.cost").alias("cost"), F.col("best.e").alias("end"))
    chosen = (
        placed.join(ways.withColumnsRenamed({"conv_id": "c", "idx": "i"}), _is(F.col("conv_id"), F.col("c")) & (F.col("idx") == F.col("i")))
        .withColumn("edits", F.expr("audits[4 * entry + leave]"))
        .select("conv_id", "idx", "entry", "edits", "roles", "texts")
    )
    out_schema = schema("audit string, repaired_sha256 string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, state = None, False, START
        audit, digest, lines = [], hashlib.sha256(), 0
        ended: list[tuple] = []

        def write(own: list[str]) -> None:
            nonlocal lines
            for line in own:
                digest.update((("\n" if lines else "") + line).encode())
                lines += 1

        def end() -> None:
            closing = CLOSING[state][1]
            write(applied(closing, state, [], []))
            ended.append((now, "".join([*audit, closing]), digest.hexdigest()))

        def flushed(conv_type: pa.DataType) -> pa.RecordBatch:
            columns = zip(zip(*ended, strict=True), (conv_type, pa.string(), pa.string()), strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=out_schema.names)
            ended.clear()
            return batch

        for batch in batches:
            for conv, entry, edits, roles, texts in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "entry", "edits", "roles", "texts")), strict=True
            ):
                if not begun or conv != now:
                    if begun:
                        end()
                    now, begun, audit, digest, lines = conv, True, [], hashlib.sha256(), 0
                audit.append(edits)
                write(applied(edits, entry, roles, texts))
                state = _left_in(edits, entry, roles)
            conv_type = batch.column("conv_id").type
            if ended:
                yield flushed(conv_type)
        if begun:
            end()
            yield flushed(conv_type)

    texts = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "idx").mapInArrow(stream, out_schema)
    ends = placed.select(F.col("conv_id").alias("c3"), (F.col("idx") + 1).alias("i3"), F.col("last").alias("previous"))
    joints = placed.join(ends, _is(F.col("conv_id"), F.col("c3")) & (F.col("idx") == F.col("i3")), "left").select(
        "conv_id", *COUNTS, F.concat("previous", "first").alias("joint")
    )
    sums = joints.groupBy(F.col("conv_id").alias("c2")).agg(
        *[F.sum(c).alias(c) for c in COUNTS[:3]],
        F.sum(F.col("illegal") + (F.col("joint").isNotNull() & ~F.col("joint").isin(*LEGAL)).cast("bigint")).alias("illegal"),
    )
    return (
        texts.join(cost, _is(F.col("conv_id"), F.col("c")))
        .join(sums, _is(F.col("conv_id"), F.col("c2")))
        .select("conv_id", *COUNTS, F.col("cost").cast("bigint").alias("cost"), "audit", "repaired_sha256")
    )


def _left_in(edits: str, entry: int, roles: list[str]) -> int:
    state, i = entry, 0
    for letter in edits:
        if letter == "K":
            state = KEEP[state][roles[i][:1]]
        elif letter in "IR":
            state = WANTED[state]
        i += letter != "I"
    return state
