"""Chat formatting with minimum-cost repair of the roles.

A conversation is legal if it is an optional system turn and then user and assistant turns in
alternation, ending with the assistant. Each turn may keep its role, take another, be merged into
the turn before it, or have an empty turn put in front; an empty turn may be added at the end. A
dynamic program over the automaton of legal sequences picks the changes with the least summed
cost; among equal ones it prefers, from the last turn backwards, the action that comes first in
ACTIONS and then the earlier state.

A long conversation is split into blocks of turns by their bytes: each block's costs from state to state are a
small matrix, the matrices of a conversation combine in (min, +), which gives the states at the
blocks' edges, and the blocks are then repaired and rendered by themselves.

The rendered pieces of a conversation, in order, are its text: each piece is a header, the text
and, once the next turn or the end comes, a footer.

Defined results: null texts count as empty, roles other than the three (null, too) fit none and
must be relabelled or merged; turns with equal numbers, repeated rows included, are ordered by
role and text; a turn of any length is rendered whole, by one task; rows without a conv_id are left
out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.common import batch, bounded

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"system": SYSTEM, "user": USER}, SYSTEM: {"user": USER}, USER: {"assistant": ASSISTANT}, ASSISTANT: {"user": USER}}
ACTIONS = ("keep", "merge", "relabel", "insert")
MERGE, MERGE_OTHER, RELABEL, INSERT = 1, 3, 2, 3
HEADER, FOOTER = "<|im_start|>{role}\n", "<|im_end|>\n"
#: Bytes of text in a block, about, and those that a turn counts besides its text.
BLOCK_BYTES, TURN_BYTES = 1 << 20, 256
FAR = 1 << 40


def steps(role: str | None) -> dict[tuple[int, int], tuple[int, int, tuple[str, ...]]]:
    """The cheapest way from state to state with a turn of this role: cost, action, roles of the turns made (none: merged)."""
    found: dict[tuple[int, int], tuple[int, int, tuple[str, ...]]] = {}

    def offer(a, b, *way):
        if (a, b) not in found or way < found[a, b]:
            found[a, b] = way

    for a in range(4):
        if a != START:
            offer(a, a, MERGE if role == ROLES[a - 1] else MERGE_OTHER, 1, ())
        for first, b in NEXT[a].items():
            offer(a, b, 0 if first == role else RELABEL, 0 if first == role else 2, (first,))
            for second, c in NEXT[b].items():
                offer(a, c, INSERT + (0 if second == role else RELABEL), 3, (first, second))
    return found


STEPS = {role: steps(role) for role in (*ROLES, None)}
#: What it takes to end: cost and roles of the empty turns added.
ENDING = {ASSISTANT: (0, ()), USER: (INSERT, ("assistant",)), SYSTEM: (2 * INSERT, ("user", "assistant"))}


def _forward(costs: list[int], role: str | None) -> tuple[list[int], list[int]]:
    """Costs after a turn, and the state before it on the way to each state."""
    best = [(FAR, 0, 0)] * 4
    for (a, b), (cost, action, _) in STEPS[role if role in ROLES else None].items():
        best[b] = min(best[b], (costs[a] + cost, action, a))
    return [min(c, FAR) for c, _, _ in best], [a for _, _, a in best]


def block_matrix(roles: list[str | None]) -> list[int]:
    """Costs from each state before a block to each state after it, row by row."""
    rows = []
    for a in range(4):
        costs = [FAR] * 4
        costs[a] = 0
        for role in roles:
            costs, _ = _forward(costs, role)
        rows += costs
    return rows


def edges(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """States before and after each block of a conversation on its cheapest repair."""
    costs, before = [0, FAR, FAR, FAR], []
    for m in matrices:
        best = [min((costs[a] + m[4 * a + b], a) for a in range(4)) for b in range(4)]
        costs = [min(c, FAR) for c, _ in best]
        before.append([a for _, a in best])
    state = min(ENDING, key=lambda s: (costs[s] + ENDING[s][0], s))
    out = []
    for came in reversed(before):
        out.append((came[state], state))
        state = came[state]
    return out[::-1]


def least_cost(matrices: list[list[int]]) -> int:
    """Of all ways to repair a conversation."""
    costs = [0, FAR, FAR, FAR]
    for m in matrices:
        costs = [min(costs[a] + m[4 * a + b] for a in range(4)) for b in range(4)]
    return min(costs[s] + ENDING[s][0] for s in ENDING)


def repair(roles: list[str | None], entry: int, exit_: int) -> list[tuple[str, tuple[str, ...]]]:
    """The action and the roles of the turns made, for each turn of a block."""
    costs, back = [FAR] * 4, []
    costs[entry] = 0
    for role in roles:
        costs, came = _forward(costs, role)
        back.append(came)
    state, out = exit_, []
    for role, came in zip(reversed(roles), reversed(back)):
        _, action, made = STEPS[role if role in ROLES else None][came[state], state]
        out.append((ACTIONS[action], made))
        state = came[state]
    return out[::-1]


def format_conversations(conversations: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, position, part, turn, source_role, role, action, rendered, cost: the pieces of every conversation.

    position counts a conversation's turns from 1; part is 0 for the turn itself, below it for an
    empty turn in front, above it for turns added at the end. cost is the least cost of the
    conversation's repair, the same at each of its pieces.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.octet_length("text") + TURN_BYTES).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.filter("conv_id IS NOT NULL").withColumn("position", F.row_number().over(order)).withColumn("block", F.floor(before / F.lit(block_bytes)))
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("position", "turn", "role", "text"))).alias("turns"))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
        for b in batches:
            yield batch(schema, conv_id=b["conv_id"], block=b["block"], costs=[block_matrix(r) for r in b["roles"].to_pylist()])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())])
        for b in batches:
            out = []
            for c, ms in zip(b["conv_id"].to_pylist(), b["matrices"].to_pylist()):
                costs = [m["costs"] for m in ms]
                cost = least_cost(costs)
                out += [(c, m["block"], *ends, k == len(ms) - 1, cost) for k, (m, ends) in enumerate(zip(ms, edges(costs)))]
            yield batch(schema, **{n: [r[i] for r in out] for i, n in enumerate(schema.names)})

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("part", pa.int32()), ("turn", pa.int64()), ("source_role", pa.string()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string()), ("cost", pa.int64())])
        for b in batches:
            out = []
            for conv, rows, entry, exit_, last, cost in zip(*(b[n].to_pylist() for n in ("conv_id", "turns", "entry", "exit", "last", "cost"))):
                begin = len(out)
                opened, role = entry != START, ROLES[entry - 1] if entry != START else None
                for row, (action, made) in zip(rows, repair([r["role"] for r in rows], entry, exit_)):
                    place = (conv, row["position"])
                    for k, role in enumerate(made):
                        text = row["text"] if k == len(made) - 1 else ""
                        piece = FOOTER * opened + HEADER.format(role=role) + text
                        own = k == len(made) - 1
                        did = "insert" if not own else "keep" if role == row["role"] else "relabel"
                        out.append((*place, k - len(made) + 1, row["turn"], row["role"] if own else None, role, did, piece))
                        opened = True
                    if not made:
                        out.append((*place, 0, row["turn"], row["role"], role, action, "\n" + row["text"]))
                if last:
                    added = ENDING[exit_][1]
                    for k, role in enumerate(added):
                        out.append((conv, rows[-1]["position"], k + 1, None, None, role, "insert", FOOTER + HEADER.format(role=role)))
                    out[-1] = (*out[-1][:-1], out[-1][-1] + FOOTER)
                out[begin:] = [(*piece, cost) for piece in out[begin:]]
            yield batch(schema, **{n: [r[i] for r in out] for i, n in enumerate(schema.names)})

    matrices = bounded(blocks.select("conv_id", "block", F.col("turns.role").alias("roles"))).mapInArrow(costs, "conv_id long, block long, costs array<long>")
    settled = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("matrices")).mapInArrow(settle, "conv_id long, block long, entry int, exit int, last boolean, cost long")
    return bounded(blocks.join(settled, ["conv_id", "block"]).select("conv_id", "turns", "entry", "exit", "last", "cost")).mapInArrow(render, "conv_id long, position long, part int, turn long, source_role string, role string, action string, rendered string, cost long")
