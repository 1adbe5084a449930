"""Repair the turn structure of conversations by their cheapest edits.

Every row becomes one letter for its role and its first fault, and every conversation a signature of such letters.
Conversations with one signature need one repair. Signatures are sorted from their ends, so that those that share an
ending stand together; an automaton whose nodes are endings is then built along the sort, each node once, and holds for
each state of the role grammar the least cost of repairing the rest and the edit that this repair starts with. The edits
that may start a repair in one state have different initials, so the first one already decides between repairs of equal
cost, and the best audit of a node is its edit followed by the audit of the node and state that it leads to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworth.llm.common import shuffle_partitions, written

# One letter for each role (system, user, assistant, any other) and fault (none, blank, duplicate,
# truncated), the role of each letter, and the costs of edits.
LETTERS = "abcdefghijklmnop"
ROLES = "ssssuuuuaaaaxxxx"
BLANK, DUPLICATE, TRUNCATED = "bfjn", "cgko", "dhlp"
REROLE, DELETE, INSERT, UNDELETED = 3, 4, 3, 3

# States of the grammar (s?(ua)+)?: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 40

Node = tuple[int, tuple[int, ...], tuple[str, ...]]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the fixed damage, by crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes its role user. Nulls count as
    one space, in the key as well as in role and text; conv_id and turn stay null.
    """
    key = F.concat(_space(F.col("conv_id").cast("string")), F.lit(":"), _space(F.col("turn").cast("string")))
    fate = (F.crc32(key) % 20).alias("fate")
    found = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text"), fate)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    left = found.where(F.col("fate") != 0)
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _space(column: Column) -> Column:
    return F.coalesce(column, F.lit(" "))


def runs(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, letter: equal rows of a conversation's turn as one, with the fault of the first.

    All rows of a run after its first are duplicates. Equal rows are counted before the shuffle, and the earliest turn
    of a role and text is joined to its runs, so that neither a long conversation nor a common turn fills one task.
    """
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    held = written(same, "conversation-runs")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = held.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"))
    a, b = held.alias("a"), first.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "role", "digest")]
    both = a.join(b, on).select("a.conv_id", "a.turn", "a.role", "a.text", "a.n", F.col("b.first.turn").alias("first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 1).when(~F.col("turn").eqNullSafe(F.col("first")), 2).when(~ended, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return both.select("conv_id", "turn", "role", "text", "n", F.substr(F.lit(LETTERS), role * 4 + fault + 1, F.lit(1)).alias("letter"))


def run_letters(letter: str, count: int) -> str:
    """The letters of a run: a blank row repeats as blank, any other as its duplicate."""
    again = letter if letter in BLANK else DUPLICATE[LETTERS.index(letter) // 4]
    return letter + again * (count - 1)


def signatures(turns: DataFrame) -> DataFrame:
    """conv_id, signature of all conversations that have rows; rows in the order of turn (nulls first), role and text.

    The rows are dealt in ranges of that order, so a long conversation spreads over tasks; each task gives the letters
    of its part of a conversation, and the parts are put together, one byte a row.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    parts = shuffle_partitions(turns.sparkSession)
    head = F.substring("text", 1, 64)
    dealt = turns.repartitionByRange(parts, "conv_id", F.col("turn").asc_nulls_first(), "role", head)
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "letter", "n")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, letters = TaskContext.get().partitionId(), None, []
        for batch in batches:
            ids, done = [], []
            for conv, letter, count in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if letters and conv != current:
                    ids.append(current)
                    done.append("".join(letters))
                    letters = []
                current = conv
                letters.append(run_letters(letter, count))
            yield _batch(batch.schema.field(0).type, ids, part, done)
        if letters:
            yield _batch(batch.schema.field(0).type, [current], part, ["".join(letters)])

    def _batch(kind: pa.DataType, ids: list, part: int, done: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, type=kind), pa.array([part] * len(ids), type=pa.int32()), pa.array(done, type=pa.string())], ["conv_id", "part", "piece"])

    pieces = ordered.mapInArrow(joined, f"conv_id {kind}, part int, piece string")
    whole = F.array_sort(F.collect_list(F.struct("part", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda x: x["piece"]), "").alias("signature"))


def _settled(costs: list[int], edits: list[str]) -> Node:
    """A node after insertions before its rest; costs are kept above the least of them."""
    changed = True
    while changed:
        changed = False
        for state in range(4):
            other = (INSERT + costs[NEXT[state]], "I")
            if other < (costs[state], edits[state]):
                costs[state], edits[state] = other
                changed = True
    least = min(costs)
    return least, tuple(c - least for c in costs), tuple(edits)


END = _settled([0, _NEVER, _NEVER, 0], ["", "I", "I", ""])


@lru_cache(maxsize=100_000)
def _before(letter: str, rest: tuple[int, ...]) -> Node:
    """The node of an ending that starts with `letter`, from the costs of the ending after it."""
    costs, edits = [], []
    for state in range(4):
        ways = [(DELETE + rest[state], "D")]
        if letter not in BLANK and letter not in DUPLICATE:
            more = UNDELETED if letter in TRUNCATED else 0
            ways.append((REROLE + more + rest[NEXT[state]], "R"))
            kept = KEPT[ROLES[LETTERS.index(letter)]].get(state)
            if kept is not None:
                ways.append((more + rest[kept], "K"))
        cost, edit = min(ways)
        costs.append(cost)
        edits.append(edit)
    return _settled(costs, edits)


def audit_of(signature: str, edits: list[tuple[str, ...]]) -> str:
    """The edits from the start of a signature; `edits[k]` belongs to its ending of k letters."""
    out, state, left = [], START, len(signature)
    while edit := edits[left][state]:
        out.append(edit)
        if edit == "K":
            state = KEPT[ROLES[LETTERS.index(signature[len(signature) - left])]][state]
        elif edit != "D":
            state = NEXT[state]
        left -= edit != "I"
    return "".join(out)


def repairs(sorted_signatures: Iterable[str], built: list | None = None) -> Iterator[tuple[str, int, str]]:
    """signature, cost and audit of signatures that come sorted from their ends.

    The nodes on the way to the last signature are at hand; those of the ending that the next one shares with it are
    used again. `built`, if given, gets the ending of every node that was built.
    """
    before, costs, edits = "", [END[0]], [END[2]]
    rest = [END[1]]
    for signature in sorted_signatures:
        size, shared = len(signature), 0
        for x, y in zip(reversed(before), reversed(signature)):
            if x != y:
                break
            shared += 1
        for held in (costs, edits, rest):
            del held[shared + 1 :]
        for k in range(shared, size):
            more, above, edit = _before(signature[size - 1 - k], rest[k])
            costs.append(costs[k] + more)
            rest.append(above)
            edits.append(edit)
            if built is not None:
                built.append(signature[size - 1 - k :])
        before = signature
        yield signature, costs[size] + rest[size][START], audit_of(signature, edits)


def signature_repairs(found: DataFrame) -> DataFrame:
    """signature, cost, audit of every distinct signature."""
    parts = shuffle_partitions(found.sparkSession)
    distinct = found.select("signature").distinct()
    ordered = distinct.repartitionByRange(parts, F.reverse("signature")).sortWithinPartitions(F.reverse("signature"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = repairs(s for batch in batches for s in batch.column(0).to_pylist())
        while block := [row for row, _ in zip(done, range(2000))]:
            a, b, c = zip(*block)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.string()), pa.array(b, type=pa.int64()), pa.array(c, type=pa.string())], ["signature", "cost", "audit"])

    return ordered.mapInArrow(each, "signature string, cost long, audit string")


class _Edited:
    """The digest of a repaired conversation, fed with its rows in order."""

    def __init__(self, header: tuple, audit: str):
        self.header, self.audit, self.at, self.state = header, audit, 0, START
        self.digest, self.started = hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.started else "") + role + ":").encode())
        self.digest.update(text.encode())
        self.started = True

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._add(NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[0]][self.state]
            self._add(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._add(NAMES[self.state], text)

    def end(self) -> tuple:
        self._insertions()
        return (*self.header, self.audit, self.digest.hexdigest())


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(headers: DataFrame, turns: DataFrame) -> DataFrame:
    """The header columns, audit and repaired_sha256: each header is sorted before the rows of its conversation.

    The hash of a conversation is one sequence by definition, so its rows pass through one task; they stream from
    Spark's external sort, and only the audit, one letter a row, is held.
    """
    kind = headers.schema["conv_id"].dataType.simpleString()
    numbers = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    nothing = F.lit(None).cast("string")
    top = headers.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), F.lit(1).cast("long").alias("n"), *_COUNTS, "audit")
    rows = turns.select("conv_id", F.lit(1).alias("place"), "turn", "role", "text", "n", *numbers, nothing.alias("audit"))
    dealt = top.unionByName(rows).repartition(shuffle_partitions(headers.sparkSession), "conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "place", F.col("turn").asc_nulls_first(), "role", "text")

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, field = None, None
        for batch in batches:
            field, done = batch.schema.field("conv_id").type, []
            places, roles, texts, counts = (batch.column(c).to_pylist() for c in ("place", "role", "text", "n"))
            for i, place in enumerate(places):
                if place == 0:
                    if current:
                        done.append(current.end())
                    current = _Edited(tuple(batch.column(c)[i].as_py() for c in ("conv_id", *_COUNTS)), batch.column("audit")[i].as_py())
                    continue
                for _ in range(counts[i]):
                    current.row(roles[i], texts[i])
            yield _rows(field, done)
        if current:
            yield _rows(field, [current.end()])

    def _rows(kind: pa.DataType, done: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        columns = list(zip(*done)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    return ordered.mapInArrow(streamed, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")


def _holding(letters: str) -> Column:
    """How many letters of the signature are among `letters`."""
    kept = "".join(c for c in LETTERS if c not in letters)
    return F.length(F.translate("signature", kept, "")).cast("long")


def repaired(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    `ids` names the conversations to report, where some may have no rows; without it, those of the rows. Nulls in role
    and text count as one space; rows without conv_id form one conversation; rows without turn come first; rows of
    one turn are ordered by role and text. A role counts by its first character (none of s, u, a: never kept). Equal rows
    are duplicates of the first. An empty or blank conversation costs only its deletions and has the hash of an empty
    string. Other columns are left out; no rows give no rows.
    """
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _space(F.col("role")).alias("role"), _space(F.col("text")).alias("text"))
    turns = written(runs(plain), "conversation-turns")
    spans = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"), F.count_distinct("turn").alias("turns"))
    found = written(signatures(turns), "conversation-signatures")
    fixed = signature_repairs(found)
    every = (ids if ids is not None else rows).select("conv_id").distinct()
    by_sign = found.join(fixed, "signature").alias("f")
    base = every.alias("e").join(by_sign, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left").join(spans.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
    roles = F.translate("signature", LETTERS, ROLES)
    legal = sum(((F.length(roles) - F.length(F.replace(roles, F.lit(pair), F.lit("")))) / 2).cast("long") for pair in ("su", "ua", "au"))
    counts = [
        (F.col("last") - F.col("first") + 1 - F.col("turns")).alias("gaps"),
        _holding(BLANK).alias("blank"),
        _holding(DUPLICATE).alias("duplicate"),
        _holding(TRUNCATED).alias("truncated"),
        (F.length("signature") - 1 - legal).cast("long").alias("illegal"),
        F.col("cost"),
    ]
    headers = base.select("e.conv_id", *counts, _or_empty("audit")).na.fill(0, list(_COUNTS))
    return _digests(written(headers, "conversation-headers"), turns)


def _or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """`repaired` of the rows after their fixed damage, with a row for every conversation that had rows before it."""
    return repaired(damaged(rows), rows)
