"""Repair of the turns of conversations at the least cost, and of what it did an audit.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Each row is kept
(K, 0), given the role that comes next (R, 1) or deleted (D, 2; a blank row and a repeated one
have to be); rows without text may be inserted (I, 5) anywhere; a row without a last stop that
stays costs 5 more. Of the cheapest repairs, that with the least string of initials is taken.

What happens to one row, with the inserts before it, is one macro edit: its code is the run
of I and the row's own letter. No code is the beginning of another, so strings compare as the
sequences of their codes do. The states are what the pattern has read: nothing, s, u or a
whole pair. The initials fix the states, so repairs that end in different states differ as
strings. A layer (the rows up to one) holds for each state the least cost and, in place of the
string, its rank among the layer's states, from the rank of the state before and the code;
parent pointers give the edits back.

At scale: rows are numbered by conversation, those of a hot one (more than ``HOT`` rows) within
chunks of turns. Texts are shuffled twice, for the numbers and for the digest, and never stored;
what lies between reads narrow rows. Runs of ``CHUNK`` rows are solved by themselves, from every state to every state; a conversation is
then one small row a run, read in order, and each run is solved again between the two states
that it turned out to have. Repeated rows are first told apart inside their runs, so a hot row
is one key a run. The digest has to see a conversation in order: its edits come first, a byte a
row, then its rows, sorted anew, which are hashed one after another and never held.

Defined results: a null role or text is one space, and so is a null id or turn in the key of
the damage; null turns come first and are no gap; the null id is a conversation of its own. Rows
with the same turn go by role, then text; repeated rows are rows of their own. A role is told
by its first character, and an empty one is never kept. A conversation without rows after the
damage has zeros and an empty repair. An empty table gives an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.ordering import quantile_chunks
from textloom.functions.runtime import materialize, small_enough
from textloom.llm.pieces import tidy
from textloom.llm.text import SPACES

#: Costs of the edits, and what a row without its last stop costs if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing read, s, u, a whole pair; the state after the initial that comes next.
NOTHING, SYSTEM, USER, PAIR = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: PAIR, PAIR: USER}
ROLE_INTO = {USER: "user", PAIR: "assistant"}
#: Macro edits in order of their codes; more than two inserts lead back to where they began.
MACROS = sorted("I" * n + own for n, own in product(range(3), "DKR"))
#: Rows solved together, and rows of a conversation above which it is numbered in chunks.
CHUNK, HOT = 1024, 50_000
#: Rows about hot conversations and their chunks that are broadcast.
FEW_RUNS = 20_000
BIG = 1 << 60


def after(state: int, inserts: int) -> int:
    for _ in range(inserts):
        state = NEXT[state]
    return state


def _moves() -> dict[tuple[str, bool, bool], list[list[tuple[int, int, int]]]]:
    """For each kind of row (initial, must go, truncated) and each state the
    (state after, cost, number of the macro edit) that can follow."""
    out = {}
    for initial, gone, cut in product("sua?", (False, True), (False, True)):
        table = []
        for state in range(4):
            found = []
            for number, code in enumerate(MACROS):
                inserts, own = len(code) - 1, code[-1]
                mid, cost = after(state, inserts), INSERT * inserts
                if own == "D":
                    found.append((mid, cost + DELETE, number))
                elif gone:
                    continue
                elif own == "R":
                    found.append((NEXT[mid], cost + REROLE + TRUNCATED * cut, number))
                elif initial == "s" and mid == NOTHING:
                    found.append((SYSTEM, cost + TRUNCATED * cut, number))
                elif initial in "ua" and NEXT[mid] == {"u": USER, "a": PAIR}[initial]:
                    found.append((NEXT[mid], cost + TRUNCATED * cut, number))
            table.append(found)
        out[initial, gone, cut] = table
    return out


MOVES = _moves()


def layers(rows: list[tuple[str, bool, bool]], start: int) -> tuple[list[int], list[int], list[list]]:
    """Costs and ranks by state after ``rows`` from ``start``, and (parent, macro) by layer and state."""
    costs, ranks = [BIG] * 4, [0] * 4
    costs[start] = 0
    pointers = []
    for row in rows:
        best: list = [None] * 4
        for state, moves in enumerate(MOVES[row]):
            if costs[state] < BIG:
                for to, cost, macro in moves:
                    way = (costs[state] + cost, ranks[state], macro, state)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        reached = sorted((way[1], way[2], to) for to, way in enumerate(best) if way)
        for rank, (_, _, to) in enumerate(reached):
            ranks[to] = rank
        costs = [way[0] if way else BIG for way in best]
        pointers.append([(way[3], way[2]) if way else None for way in best])
    return costs, ranks, pointers


def ending(state: int) -> int:
    """Inserts after the last row."""
    return {NOTHING: 0, SYSTEM: 2, USER: 1, PAIR: 0}[state]


def best_end(costs: list[int], ranks: list[int]) -> int:
    """The state in which the cheapest repair, and of such the least, leaves the last row."""
    return min((c + INSERT * ending(s), r, s) for s, (c, r) in enumerate(zip(costs, ranks)) if c < BIG)[2]


def edits(rows: list[tuple[str, bool, bool]], start: int, end: int) -> bytes:
    """One byte a row on the way from ``start`` to ``end``: 33 + 4 * macro + state before."""
    _, _, pointers = layers(rows, start)
    out = bytearray()
    for layer in reversed(pointers):
        end, macro = layer[end]
        out.append(33 + 4 * macro + end)
    return bytes(reversed(out))


def audit_of(codes: bytes) -> str:
    return "".join(MACROS[(c - 33) // 4] for c in codes)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` with faults put in by crc32 of ``conv_id:turn``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("*", F.explode(copies).alias("_copy")).drop("fault", "_copy")


def _key() -> Column:
    """The id as a string that is never null: concat_ws leaves a null out."""
    return F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"))


def _order() -> list[Column]:
    """The order of a conversation's rows."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _numbered(rows: DataFrame) -> DataFrame:
    """key, turn, initial, blank, stopless, same, pos: rows with their place in the conversation."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    columns = [
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("stopless"),
        # Lengths keep (role, text) apart however they are cut.
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("same"),
    ]
    keyed = rows.select(_key().alias("key"), "turn", "role", "text")
    hot = small_enough(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), FEW_RUNS)
    number = lambda *by: (F.row_number().over(Window.partitionBy(*by).orderBy(*_order())) - 1).cast("long").alias("pos")
    if hot.isEmpty():
        return keyed.select("key", "turn", "role", "text", number("key")).select("key", *columns, "pos")
    few = keyed.join(hot, "key", "left_anti").withColumn("chunk", F.lit(0))
    many = keyed.join(hot, "key", "left_semi")
    many = many.withColumn("chunk", F.coalesce(quantile_chunks(many, "turn"), F.lit(0)))
    held = many.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("n")
    starts = small_enough(held.select("key", "chunk", before.alias("start")), FEW_RUNS)
    inside = few.unionByName(many).select("key", "turn", "role", "text", "chunk", number("key", "chunk")).select("key", "chunk", *columns, "pos")
    return inside.join(starts, ["key", "chunk"], "left").select(
        "key", *[F.col(c) for c in ("turn", "initial", "blank", "stopless", "same")],
        (F.col("pos") + F.coalesce("start", F.lit(0))).cast("long").alias("pos"),
    )


def _faults(numbered: DataFrame) -> DataFrame:
    """key, run, pos, turn, initial, blank, duplicate, truncated of every row."""
    narrow = numbered.withColumn("run", F.expr(f"pos div {CHUNK}"))
    narrow = materialize(narrow)
    runs = narrow.groupBy("key", "same", "run").agg(F.min("pos").alias("first"))
    # Of each (key, same) only one row a run is left.
    least = runs.groupBy("key", "same").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    first = least.where("n > 1").select("key", "same", F.col("first").alias("before"))
    known = runs.join(first, ["key", "same"], "left").select("key", "same", "run", F.coalesce("before", "first").alias("before"))
    told = narrow.join(known, ["key", "same", "run"])
    again = F.col("pos") > F.col("before")
    return told.select(
        "key", "run", "pos", "turn", "initial", "blank",
        (~F.col("blank") & again).alias("duplicate"),
        (~F.col("blank") & ~again & F.col("stopless")).alias("truncated"),
    )


def _kinds(batch: pa.RecordBatch) -> list[tuple[str, bool, bool]]:
    initial, gone, cut = (batch.column(i).to_pylist() for i in (3, 4, 5))
    return [(x if x and x in "sua" else "?", g, c) for x, g, c in zip(initial, gone, cut)]


def _by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list, tuple]]:
    """(key, run, kinds of its rows, other columns) from rows sorted by (key, run, pos)."""
    now, held, rest = None, [], ()
    for batch in batches:
        keys, runs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        others = [c.to_pylist() for c in batch.columns[6:]]
        for i, kind in enumerate(_kinds(batch)):
            if (keys[i], runs[i]) != now:
                if held:
                    yield *now, held, rest
                now, held, rest = (keys[i], runs[i]), [], tuple(o[i] for o in others)
            held.append(kind)
    if held:
        yield *now, held, rest


def _handed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    with tidy():
        for row in rows:
            held.append(row)
            if len(held) == 2000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema)


_MATRIX = pa.schema([("key", pa.string()), ("run", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
_ENDS = pa.schema([(n, pa.string() if n == "key" else pa.int64()) for n in ("key", "run", "start", "end", "tail", "cost")])
_EDITS = pa.schema([("key", pa.string()), ("run", pa.int64()), ("codes", pa.string()), ("audit", pa.string())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and ranks of a run from each state to each state."""

    def rows():
        for key, run, kinds, _ in _by_run(batches):
            # Only the first run begins with nothing read; others may, after deletions.
            solved = [layers(kinds, s)[:2] for s in (range(4) if run else (NOTHING,))]
            yield key, run, sum((c for c, _ in solved), []), sum((r for _, r in solved), [])

    yield from _handed(rows(), _MATRIX)


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between the runs of a conversation, from rows sorted by (key, run)."""

    def ended(key, costs, ranks, parents):
        end = best_end(costs, ranks)
        cost, tail = costs[end] + INSERT * ending(end), ending(end)
        states = [end]
        for layer in reversed(parents):
            states.append(layer[states[-1]])
        states.reverse()
        last = len(parents) - 1
        for run in range(len(parents)):
            yield key, run, states[run], states[run + 1], tail if run == last else 0, cost if run == last else 0

    def rows():
        key, costs, ranks, parents = None, [], [], []
        for batch in batches:
            for k, _, c, r in zip(*(col.to_pylist() for col in batch.columns)):
                if k != key:
                    if key is not None:
                        yield from ended(key, costs, ranks, parents)
                    key, costs, ranks, parents = k, [0, BIG, BIG, BIG], [0] * 4, []
                best: list = [None] * 4
                for start in range(len(c) // 4):
                    for to in range(4):
                        step = c[4 * start + to]
                        if costs[start] < BIG and step < BIG:
                            way = (costs[start] + step, ranks[start], r[4 * start + to], start)
                            if best[to] is None or way < best[to]:
                                best[to] = way
                order = sorted((w[1], w[2], to) for to, w in enumerate(best) if w)
                ranks = [0] * 4
                for rank, (_, _, to) in enumerate(order):
                    ranks[to] = rank
                costs = [w[0] if w else BIG for w in best]
                parents.append(bytes(w[3] if w else 0 for w in best))
        if key is not None:
            yield from ended(key, costs, ranks, parents)

    yield from _handed(rows(), _ENDS)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a run between its two states."""

    def rows():
        for key, run, kinds, (start, end, tail) in _by_run(batches):
            codes = edits(kinds, start, end)
            yield key, run, codes.decode("ascii"), audit_of(codes) + "I" * tail

    yield from _handed(rows(), _EDITS)


def _in_order(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*partition).sortWithinPartitions(*order)


#: By macro edit and state before: the roles inserted before the row, and the role of a rerole.
_BEFORE = [[ROLE_INTO[after(s, i)] for i in range(1, len(m))] for m in MACROS for s in range(4)]
_RENAMED = [ROLE_INTO[NEXT[after(s, len(m) - 1)]] if m[-1] == "R" else None for m in MACROS for s in range(4)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, digest of the repaired turns, from rows (key, role, text, codes, tail, end) in order.

    The runs of a conversation come first, with their codes; then its rows, with role and text.
    """
    schema = pa.schema([("key", pa.string()), ("digest", pa.string())])

    def rows():
        key, hashed, any_line = None, None, False
        edited, at, last = bytearray(), 0, (0, 0)

        def line(role: str, text: bytes):
            nonlocal any_line
            hashed.update((b"\n" if any_line else b"") + role.encode() + b":")
            hashed.update(text)
            any_line = True

        def ended() -> str:
            tail, end = last
            for i in range(1, tail + 1):
                line(ROLE_INTO[after(end, i)], b"")
            return hashed.hexdigest()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for (k, role, codes, tail, end), text in zip(zip(*columns), texts):
                if k != key:
                    if key is not None:
                        yield key, ended()
                    key, hashed, any_line = k, hashlib.sha256(), False
                    edited, at = bytearray(), 0
                if codes is not None:
                    edited += codes.encode("ascii")
                    last = tail, end
                    continue
                code, at = edited[at] - 33, at + 1
                for name in _BEFORE[code]:
                    line(name, b"")
                if MACROS[code // 4][-1] != "D":
                    line(_RENAMED[code] or role, text.as_py())
        if key is not None:
            yield key, ended()

    yield from _handed(rows(), schema)


def repair_plan(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their faults, and the runs' edits: key, run, codes, audit, end, tail, cost."""
    faults = materialize(_faults(numbered))
    # A run's task reads the rows' kinds alone.
    kinds = faults.select("key", "run", "pos", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    matrix = _in_order(kinds, ["key", "run"], ["key", "run", "pos"]).mapInArrow(_solve, "key string, run long, costs array<long>, ranks array<long>")
    ends = _in_order(matrix, ["key"], ["key", "run"]).mapInArrow(_join_runs, "key string, run long, start long, end long, tail long, cost long")
    ends = materialize(ends)
    met = kinds.join(ends.drop("cost"), ["key", "run"]).select("key", "run", "pos", "initial", "gone", "truncated", "start", "end", "tail")
    made = _in_order(met, ["key", "run"], ["key", "run", "pos"]).mapInArrow(_again, "key string, run long, codes string, audit string")
    return faults, materialize(made.join(ends.select("key", "run", "end", "tail", "cost"), ["key", "run"]))


def _with_edits(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """key, role, text, codes, tail, end in order: a conversation's runs, then its rows."""
    own = rows.select(_key().alias("key"), "turn", "role", "text")
    edited = runs.select("key", "run", "codes", "tail", "end")
    both = own.unionByName(edited, allowMissingColumns=True)
    held = both.repartition("key").sortWithinPartitions("key", F.col("run").asc_nulls_last(), *_order())
    return held.select("key", "role", "text", "codes", "tail", "end")


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Repair ``rows`` (conv_id, turn, role, text without nulls in role and text).

    One row for each id of ``ids``: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.
    """
    faults, runs = repair_plan(_numbered(rows))
    # A row's neighbour is in its run, or the first of the next one.
    pairs = faults.select("key", "run", "pos", "initial").unionByName(
        faults.where((F.col("pos") % CHUNK == 0) & (F.col("pos") > 0)).select("key", (F.col("run") - 1).alias("run"), "pos", "initial")
    )
    follows = F.lead("initial").over(Window.partitionBy("key", "run").orderBy("pos"))
    bad = pairs.withColumn("next", follows).where("next is not null and initial || next not in ('su', 'ua', 'au')")
    illegal = bad.groupBy("key").agg(F.count(F.lit(1)).alias("illegal"))
    turns = faults.select("key", "turn").where("turn is not null").distinct()
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    counts = faults.groupBy("key").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    audits = runs.groupBy("key").agg(
        F.sum("cost").alias("cost"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("run", "audit"))), lambda x: x["audit"])).alias("audit"),
    )
    digests = _with_edits(rows, runs).mapInArrow(_digest, "key string, digest string")
    out = ids.select("conv_id").distinct().withColumn("key", _key())
    for part in (gaps, counts, illegal, audits, digests):
        out = out.join(part, "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", none).alias("repaired_sha256"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of ``damaged`` conversations, for every id that they had before."""
    return repair(damaged(conversations), conversations)
