"""Cheapest repair of the turns of conversations, by dynamic programming over runs.

A row is a symbol: the class of its role (system, user, assistant or another, by
its initial) and of its fault (none, truncated, or one that has to go).  Four
states say what a repaired prefix ends with (nothing, s, u, a); a symbol is a
min-plus matrix over them.  Equal consecutive symbols make a run, and a run is
advanced through binary powers of its matrix, which workers cache.  Costs go from
the last run to the first; then the choices of each run are unrolled forwards,
halving it with the same powers.  Of equally cheap repairs the one whose audit
string is least in ASCII order is taken; as a letter fixes the next state, picking
the least letter that keeps the cost does that.

On Spark: equal rows of a conversation are counted first, so a row repeated many
times is one row.  Narrow rows (symbols, no texts) are sorted by range, so a
conversation of any length lies in several tasks; each task collapses its stretch
to runs, and only runs meet in one task.  A letter for each row, the audit, is the
least that a conversation's result holds.  Texts are then streamed past the audit
in order; none is gathered.

Definitions.  Null conv_id is a conversation of its own; null role or text counts as
one space.  Order: turn (null first), then role, then MD5 of the text; rows equal
in all are told apart by their number.  A role's initial is its first character;
the empty role has none, so it can't be kept.  Blank: no character but ``\\x20\\x09-\\x0D``;
such rows and later copies of a role and text go.  Empty input: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew
from .storage import drop_tables, materialize

SOUND, TRUNCATED, GONE = 0, 1, 2
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ENDS = (START, AFTER_ASSISTANT)
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: The one role that may be put in after each state, and the state that follows a kept initial.
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
KEPT = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
ROLE_OF = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
INITIALS = "sua"
LEGAL = frozenset({"su", "ua", "au"})
FAR = 1 << 60
Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def times(m: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in m)  # type: ignore[return-value]


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(x + y for x, y in zip(row, c, strict=True)) for c in columns) for row in a)  # type: ignore[return-value]


def _inserts() -> Matrix:
    """Costs of getting from a state to another by insertions alone."""
    out = [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        at, cost = i, 0
        while out[i][at] == FAR:
            out[i][at] = cost
            at, cost = NEXT[at], cost + INSERT
    return tuple(map(tuple, out))  # type: ignore[return-value]


INSERTS = _inserts()
END: Vector = times(INSERTS, tuple(0 if j in ENDS else FAR for j in range(4)))  # type: ignore[arg-type]


def choices(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of a row's own edits, letters ascending."""
    initial, fault = INITIALS[symbol // 3 : symbol // 3 + 1], symbol % 3
    yield "D", DELETE, state
    if fault != GONE:
        more = CUT if fault == TRUNCATED else 0
        if (after := KEPT.get((state, initial))) is not None:
            yield "K", more, after
        yield "R", REROLE + more, NEXT[state]


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2**k rows of one symbol, insertions before each included (12 symbols, k up to the bits of a run's length)."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    own = [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, j in choices(symbol, i):
            own[i][j] = min(own[i][j], cost)
    return product(INSERTS, tuple(map(tuple, own)))  # type: ignore[arg-type]


def before(symbol: int, length: int, after: Vector) -> Vector:
    """Least costs from before a run to the end, from those after it."""
    k = 0
    while length:
        if length & 1:
            after = times(power(symbol, k), after)
        length, k = length >> 1, k + 1
    return after


@lru_cache(maxsize=1 << 16)
def _unrolled(symbol: int, length: int, state: int, after: Vector) -> tuple[str, int]:
    if length > 1:
        k = (length - 1).bit_length() - 1
        first, state = unroll(symbol, length - (1 << k), state, times(power(symbol, k), after))
        rest, state = unroll(symbol, 1 << k, state, after)
        return first + rest, state
    costs, letters = times(power(symbol, 0), after), ""
    while True:
        own = {letter: j for letter, cost, j in choices(symbol, state) if cost + after[j] == costs[state]}
        if "D" in own:
            return letters + "D", state
        if costs[NEXT[state]] + INSERT == costs[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        letter = min(own)
        return letters + letter, own[letter]


def unroll(symbol: int, length: int, state: int, after: Vector) -> tuple[str, int]:
    """The letters of a run and the state after it."""
    if length > 4096:  # too long to keep
        return _unrolled.__wrapped__(symbol, length, state, after)
    low = min(after)
    return _unrolled(symbol, length, state, tuple(v - low for v in after))  # type: ignore[arg-type]


def cheapest(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and audit of a sequence of (symbol, length)."""
    costs = [END]
    for symbol, length in reversed(runs):
        costs.append(before(symbol, length, costs[-1]))
    costs.reverse()
    state, parts = START, []
    for (symbol, length), after in zip(runs, costs[1:], strict=True):
        letters, state = unroll(symbol, length, state, after)
        parts.append(letters)
    while state not in ENDS:
        parts.append("I")
        state = NEXT[state]
    return costs[0][START], "".join(parts)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows of sorted batches, each with whether it begins a conversation."""
    last = object()
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True):
            found = dict(zip(names, row, strict=True))
            yield found["conv_id"] != last, found
            last = found["conv_id"]


STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECE = "long, part int, first_initial string, last_initial string, first_turn long, last_turn long, low long, high long, blank long, duplicate long, truncated long, illegal long, turns long, symbols array<int>, lengths array<long>"


def _add(runs: list[list[int]], symbol: int, length: int) -> None:
    if length and runs and runs[-1][0] == symbol:
        runs[-1][1] += length
    elif length:
        runs.append([symbol, length])


def _stretches(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted narrow rows of one task to one row for each of its conversations: runs and counts."""
    out: list[dict] = []
    one: dict = {}
    for new, r in _grouped(batches):
        if new:
            if one:
                out.append(one)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist([_closed(x) for x in out], schema)
                out = []
            one = {"conv_id": r["conv_id"], "part": r["part"], "first_initial": r["initial"], "last_initial": None, "first_turn": r["turn"], "last_turn": None, "low": None, "high": None, "runs": []} | dict.fromkeys(STATS, 0)
        n, kind = r["n"], INITIALS.find(r["initial"]) % 4 if r["initial"] else 3
        first = GONE if r["blank"] or r["seen"] else TRUNCATED if r["cut"] else SOUND
        one["blank"] += n * r["blank"]
        one["duplicate"] += 0 if r["blank"] else n - 1 + r["seen"]
        one["truncated"] += first == TRUNCATED
        one["illegal"] += n - 1 + (one["last_initial"] is not None and one["last_initial"] + r["initial"] not in LEGAL)
        if r["turn"] is not None and r["turn"] != one["last_turn"]:
            one["turns"] += 1
            one["low"] = r["turn"] if one["low"] is None else one["low"]
            one["high"] = r["turn"]
        one["last_initial"], one["last_turn"] = r["initial"], r["turn"]
        _add(one["runs"], 3 * kind + first, 1)
        _add(one["runs"], 3 * kind + GONE, n - 1)
    if one:
        out.append(one)
    if out:
        yield pa.RecordBatch.from_pylist([_closed(x) for x in out], schema)


def _closed(one: dict) -> dict:
    runs = one.pop("runs")
    return one | {"symbols": [s for s, _ in runs], "lengths": [n for _, n in runs]}


def _reports(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Stretches of each conversation in order to its report."""

    def finished(one: dict) -> dict:
        cost, audit = cheapest([(s, n) for s, n in one["runs"]])
        gaps = 0 if one["low"] is None else one["high"] - one["low"] + 1 - one["turns"]
        return {k: one[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit}

    out: list[dict] = []
    one: dict = {}
    for new, r in _grouped(batches):
        if new:
            if one:
                out.append(finished(one))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
            one = {**r, "runs": []}
        else:
            for c in STATS:
                one[c] += r[c]
            one["illegal"] += one["last_initial"] + r["first_initial"] not in LEGAL
            one["turns"] -= r["first_turn"] is not None and r["first_turn"] == one["last_turn"]
            one["low"] = r["low"] if one["low"] is None else one["low"]
            one["high"] = one["high"] if r["high"] is None else r["high"]
            one["last_initial"], one["last_turn"] = r["last_initial"], r["last_turn"]
        for s, n in zip(r["symbols"], r["lengths"], strict=True):
            _add(one["runs"], s, n)
    if one:
        out.append(finished(one))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Repair:
    """The rows of a repaired conversation, as its texts go past its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", ROLE_OF[self.state], ""

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(n):
            yield from self._inserted()
            letter, self.at = self.audit[self.at], self.at + 1
            if letter == "R":
                self.state = NEXT[self.state]
                yield letter, ROLE_OF[self.state], text
            elif letter == "K":
                self.state = KEPT[self.state, role[0]]
                yield letter, role, text

    rest = _inserted


def _digests(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A conversation's mark, report and texts, in this order, to its row with the hash of the repaired rows."""
    out: list[dict] = []
    one: dict = {}
    repair, sha, some = _Repair(""), hashlib.sha256(), False

    def put(rows: Iterable[tuple[str, str, str]]) -> None:
        nonlocal some
        for _, role, text in rows:
            sha.update(("\n" * some + f"{role}:{text}").encode())
            some = True

    def finished() -> dict:
        put(repair.rest())
        return one | {"repaired_sha256": sha.hexdigest()}

    for new, r in _grouped(batches):
        if new:
            if one:
                out.append(finished())
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
            one = {"conv_id": r["conv_id"], "audit": ""} | dict.fromkeys(REPORT, 0)
            repair, sha, some = _Repair(""), hashlib.sha256(), False
        if r["kind"] == 1:
            one |= {c: r[c] for c in (*REPORT, "audit")}
            repair = _Repair(r["audit"])
        elif r["kind"] == 2:
            put(repair.row(r["role"], r["text"], r["n"]))
    if one:
        out.append(finished())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _repaired(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The same to repaired rows."""
    out: list[tuple] = []
    conv, place, repair = None, 0, _Repair("")

    def put(rows: Iterable[tuple[str, str, str]]) -> None:
        nonlocal place
        for edit, role, text in rows:
            out.append((conv, place, edit, role, text))
            place += 1

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for new, r in _grouped(batches):
        if new:
            put(repair.rest())
            conv, place, repair = r["conv_id"], 0, _Repair("")
        if r["kind"] == 1:
            repair = _Repair(r["audit"])
        elif r["kind"] == 2:
            put(repair.row(r["role"], r["text"], r["n"]))
        if len(out) >= 2000:
            yield batch()
    put(repair.rest())
    if out:
        yield batch()


def _arrow(rows_schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(rows_schema))


def _map(df: DataFrame, run, schema: str) -> DataFrame:
    arrow = _arrow(schema)
    return df.mapInArrow(lambda it: run(it, arrow), schema)


def turns(rows: DataFrame) -> DataFrame:
    """Distinct rows of conversations with their number ``n``, the hash of the text and what can be told from the row alone."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return counted.withColumns({"digest": F.md5("text"), "initial": F.substring("role", 1, 1), "blank": end == "", "cut": ~F.substring(end, -1, 1).isin(".", "!", "?")})


def _with_seen(found: DataFrame) -> DataFrame:
    """``seen``: whether an earlier turn of the conversation has the same role and text."""
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    narrow = found.select("conv_id", "turn", "role", "digest", "initial", "blank", "cut", "n", F.struct("conv_id", "role", "digest").alias("key"), when.alias("when"))
    first = narrow.groupBy("key").agg(F.min("when").alias("first"), F.count("*").alias("count")).where("count > 1")
    first = materialize(first, "first-turns")
    hot = skew.hot_keys(first.select("key", "count"), ["key"], found.count())
    left = skew.dealt(narrow, hot, ["key"], ["turn"])  # rows of a key differ in turn
    joined = left.join(skew.copied(first.drop("count"), hot, ["key"]), ["key", skew.SALT], "left")
    out = materialize(joined.select("conv_id", "turn", "role", "digest", "initial", "blank", "cut", "n", F.coalesce(F.col("when") > F.col("first"), F.lit(False)).alias("seen")), "turn-symbols")
    drop_tables(first)
    return out


def _reported(found: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    narrow = _with_seen(found)
    stretches = _map(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("digest", "role"), _stretches, "conv_id " + PIECE)
    pieces = stretches.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part")
    out = materialize(_map(pieces, _reports, "conv_id long, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string"), "repair-reports")
    drop_tables(narrow)
    return out


def _streamed(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Marks (kind 0), reports (1) and texts (2) of each conversation, together and in order."""
    found = materialize(turns(rows), "turns")
    texts = found.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "digest", "text", "n")
    all_rows = _reported(found).withColumn("kind", F.lit(1)).unionByName(texts, allowMissingColumns=True)
    if conv_ids is not None:
        all_rows = all_rows.unionByName(conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "kind", "turn", "role", "digest"]
    return all_rows.repartition(parts, "conv_id").sortWithinPartitions(*order).select(*order, "text", "n", *REPORT, "audit")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role, text of the repaired conversations."""
    return _map(_streamed(rows), _repaired, "conv_id long, place long, edit string, role string, text string")


def repair_report(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """A row for each of ``conv_ids``: counts of faults, cost, audit and the hash of the repaired rows."""
    return _map(_streamed(rows, conv_ids), _digests, "conv_id long, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the query asks for, by the checksum of ``conv_id:turn`` (nulls: one space)."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
