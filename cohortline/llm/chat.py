"""Chat formatting in budgeted windows.

A conversation's turns are written one after the other as

    <s>[role]text</s>

with ``\\``, ``<`` and ``[`` inside role and text escaped by a backslash (and ``]`` in a role), so no text can
hold a control string of this or a like template, and reading back is exact.

A conversation that is longer than ``BUDGET`` is cut into windows of whole turns.  Each window begins with the
conversation's system turn (its first turn, if its role is ``system``), repeats the last turns before it up to
``HISTORY``, and goes on with new turns while the budget lasts; at least one new turn is taken, so a
turn longer than the budget has a window of its own.  Costs are characters of the formatted turn.
The loss mask covers the text of assistant turns, without those a window only repeats: over all
windows every assistant text is a target once.

Scale: rows are range partitioned by conversation and turn, so a conversation with a third of all
rows spreads over many tasks.  A running cost in each task, plus what the tasks before hold of
the same conversation, gives every turn its offset; turns are grouped by conversation and cell of ``CELL``
characters of that offset, and a window never crosses a cell.  A cell also gets the system turn
and the turns within ``HISTORY`` before it.

Null text is empty, a null role is an empty role, a null conversation is one conversation of its own.  Turns with one number are
ordered by role and a hash of their text; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import keep, pieces

BUDGET = 4096
HISTORY = 1024
CELL = 16 * BUDGET
TARGET = "assistant"


def escape(text: str, also: str = "") -> str:
    for mark in "\\<[" + also:
        text = text.replace(mark, "\\" + mark)
    return text


def unescape(text: str) -> str:
    out, at = [], 0
    while (next_ := text.find("\\", at)) >= 0:
        out.append(text[at:next_])
        out.append(text[next_ + 1 : next_ + 2])
        at = next_ + 2
    return "".join(out) + text[at:]


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text begins and ends."""
    head, body = f"<s>[{escape(role, ']')}]", escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, int, int]]:
    """Role and text bounds of every turn of a formatted text."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith("<s>[", at):
            raise ValueError(f"no turn begins at {at}")
        end = _find(text, "]", at + 4)
        stop = _find(text, "</s>", end + 1)
        turns.append((unescape(text[at + 4 : end]), end + 1, stop))
        at = stop + 4
    return turns


def _find(text: str, mark: str, at: int) -> int:
    """The next place of a control string that no backslash escapes."""
    while True:
        at = text.index(mark, at)
        back = at
        while back and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1


TURN = "conv_id long, turn long, role string, text string, tie long"


def offsets(batches):
    """Adds each turn's cost and the running cost of its conversation within this task."""
    part, conv, begun, total = TaskContext.get().partitionId(), None, False, 0
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        cost = [len(format_turn(r, t)[0]) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        local = []
        for i, c in zip(ids, cost, strict=True):
            if not begun or i != conv:
                conv, begun, total = i, True, 0
            local.append(total)
            total += c
        new = [pa.array([part] * len(ids), pa.int32()), pa.array(cost, pa.int64()), pa.array(local, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "part", "cost", "local"])


def pack(conv: int | None, number: int, rows: list[tuple], budget: int, history: int) -> list[tuple]:
    """The windows of one cell: new turns in order, with system turn and history before each."""
    system = next(((o, c, r, t) for o, c, r, t, k in rows if k == 0), None)
    turns = [(o, c, r, t, k == 2) for o, c, r, t, k in rows if k > 0]
    out, at, window = [], next((i for i, x in enumerate(turns) if x[4]), len(turns)), 0
    while at < len(turns):
        first = turns[at]
        head = [] if system is None or system[0] == first[0] else [system]
        back = at
        while back and first[0] - turns[back - 1][0] <= history and not (system and turns[back - 1][0] == system[0]):
            back -= 1
        head += [x[:4] for x in turns[back:at]]
        used, upto = sum(x[1] for x in head), at
        while upto < len(turns) and (upto == at or used + turns[upto][1] <= budget):
            used += turns[upto][1]
            upto += 1
        text, starts, ends, size = [], [], [], 0
        for i, (_, _, role, body) in enumerate(head + [x[:4] for x in turns[at:upto]]):
            piece, low, high = format_turn(role, body)
            if i >= len(head) and role == TARGET:
                starts.append(size + low)
                ends.append(size + high)
            text.append(piece)
            size += len(piece)
        out.append((conv, number, window, len(head), "".join(text), starts, ends))
        at, window = upto, window + 1
    return out


def packed_rows(budget: int, history: int):
    """Windows of cells that come in order, turns in order within each; one cell is held at a time."""
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["conv_id", "cell", "window", "n_repeated", "formatted", "loss_start", "loss_end"]

    def record(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    def run(batches):
        key, held = None, []
        for batch in pieces(batches, "text"):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "cell", "offset", "cost", "role", "text", "kind")]
            for conv, number, *row in zip(*columns, strict=True):
                if held and (conv, number) != key:
                    out += pack(*key, held, budget, history)
                    held = []
                key = conv, number
                held.append(tuple(row))
            if out:
                yield record(out)
        if held and (out := pack(*key, held, budget, history)):
            yield record(out)

    return run


WINDOWS = "conv_id long, cell long, window long, n_repeated long, formatted string, loss_start array<long>, loss_end array<long>"


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, cell: int = CELL) -> DataFrame:
    """One row per window: conv_id, cell, window, how many turns it only repeats, the text, and the bounds of its targets."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    order = ["conv_id", "turn", "role", "tie"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(sorted_.mapInArrow(offsets, f"{TURN}, part int, cost long, local long"), "turns")
    # what earlier tasks hold of a conversation: only conversations that lie in several tasks have a carry
    sums = placed.groupBy("conv_id", "part").agg(F.sum("cost").alias("cost"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("carry", F.sum("cost").over(before)).where("carry IS NOT NULL")
    carry = carry.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "carry")
    carried = placed.join(F.broadcast(carry), placed["conv_id"].eqNullSafe(F.col("_conv")) & (placed["part"] == F.col("_part")), "left")
    carried = carried.withColumn("offset", F.col("local") + F.coalesce("carry", F.lit(0))).withColumn("cell", F.floor(F.col("offset") / cell))
    carried = carried.select("conv_id", "turn", "role", "text", "tie", "cost", "offset", "cell")
    extent = sums.groupBy("conv_id").agg(F.floor((F.sum("cost") - 1) / cell).alias("last")).where("last > 0")
    extent = extent.select(F.col("conv_id").alias("_conv"), "last")  # conversations of several cells
    long = carried.where((F.col("offset") == 0) | ((F.col("cell") + 1) * cell - F.col("offset") <= history))
    long = long.join(extent, long["conv_id"].eqNullSafe(F.col("_conv")))
    heads = long.where((F.col("offset") == 0) & (F.col("role") == "system"))
    heads = heads.withColumn("cell", F.explode(F.sequence(F.lit(1).cast("long"), "last"))).withColumn("kind", F.lit(0))
    tails = long.where((F.col("cell") + 1) * cell - F.col("offset") <= history).withColumn("cell", F.col("cell") + 1).withColumn("kind", F.lit(1))
    names = carried.columns
    everything = carried.withColumn("kind", F.lit(2))
    everything = everything.unionByName(heads.select(*names, "kind")).unionByName(tails.select(*names, "kind"))
    first = (F.col("kind") == 2) & (F.col("offset") == 0) & (F.col("role") == "system")
    everything = everything.unionByName(everything.where(first).withColumn("kind", F.lit(0)))
    dealt = everything.repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "offset", "turn", "role", "tie")
    return dealt.mapInArrow(packed_rows(budget, history), WINDOWS)


def digests(batches):
    """Reads formatted windows back: per conversation, in order, its new turns and the text under the loss mask."""
    open_, conv = None, None
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row():
        return (conv, open_["n"], open_["turns"].hexdigest(), open_["chars"], open_["loss"].hexdigest(), open_["size"])

    def record(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    for batch in pieces(batches, "formatted"):
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "formatted", "loss_start", "loss_end")]
        for i, repeated, text, starts, ends in zip(*columns, strict=True):
            if open_ is None or i != conv:
                if open_ is not None:
                    out.append(row())
                conv, open_ = i, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            for role, low, high in read_turns(text)[repeated:]:
                open_["n"] += 1
                open_["turns"].update(f"{role}\n{unescape(text[low:high])}\n".encode())
            for low, high in zip(starts, ends, strict=True):
                target = unescape(text[low:high])
                open_["chars"] += len(target)
                open_["loss"].update(target.encode())
            open_["size"] += len(text)
        if out:
            yield record(out)
    if open_ is not None:
        yield record([row()])


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, made from the formatted windows alone, streamed in order."""
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "cell", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(digests, schema)
