"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. For each
input turn dynamic programming over the automaton's states (start, system, user, assistant) chooses what is cheapest:
keep its role, relabel it, merge it into the turn before, or insert empty turns before it; at the end what is missing is
appended. Ties go to the first of keep or relabel, then merge, and to the earlier state in the order above.

Turns are ordered by turn, then role, then a hash of the text. A conversation is cut into chunks of ``CHUNK_TURNS`` turns by a range
partitioning over (conversation, turn), so one of any length is spread over tasks. A chunk is one min-plus matrix of
costs from entry to exit state; only the matrices of conversations with several chunks meet in one place, which gives
every chunk its entry and exit state; then each chunk is solved and rendered for itself.

Null, unknown or empty roles can be relabelled at less cost; null text counts as empty. Null turns come first. Rows
with a null conv_id form one conversation. Repeated rows are turns like any other. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_type, map_batches, struct, table, written

CHUNK_TURNS = 256
STATES = ("start", "system", "user", "assistant")
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN, NEVER = 1, 2, 3, 1, 10**9
HEAD, FOOT, JOINT = "<|{role}|>\n", "\n<|end|>\n", "\n\n"

#: Roles inserted on the way from a state to a role; what is not listed is illegal.
BRIDGES: dict[tuple[int, int], tuple[int, ...]] = {
    (0, 1): (), (0, 2): (), (0, 3): (2,),
    (1, 2): (), (1, 3): (2,),
    (2, 3): (), (2, 2): (3,),
    (3, 2): (), (3, 3): (2,),
}
#: Roles appended after a last state.
ENDINGS = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def _label(role: str | None, state: int) -> int:
    if role == STATES[state]:
        return 0
    return RELABEL if role in STATES[1:] else RELABEL_UNKNOWN


def moves(role: str | None) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) a turn of this role allows, in order of preference."""
    found = [(s, t, _label(role, t) + INSERT * len(b), "keep" if role == STATES[t] else "relabel") for (s, t), b in BRIDGES.items()]
    return found + [(s, s, MERGE + _label(role, s), "merge") for s in (1, 2, 3)]


_moves: dict[str | None, list] = {}


def _of(role: str | None) -> list:
    key = role if role in STATES[1:] else None
    if key not in _moves:
        _moves[key] = moves(key)
    return _moves[key]


def _forward(roles: list, cost: list[int]) -> tuple[list[int], list[list]]:
    """Costs after the turns from costs before them, and each turn's best move into each state."""
    back = []
    for role in roles:
        new, best = [NEVER] * 4, [None] * 4
        for move in _of(role):
            c = cost[move[0]] + move[2]
            if c < new[move[1]]:
                new[move[1]], best[move[1]] = c, move
        cost = new
        back.append(best)
    return cost, back


def matrix(roles: list) -> list[int]:
    """Cheapest costs from each entry to each exit state, row by row."""
    return [c for s in range(4) for c in _forward(roles, [0 if i == s else NEVER for i in range(4)])[0]]


def solve(roles: list, entry: int, exit_: int | None) -> tuple[list[tuple], int]:
    """The cheapest moves from ``entry`` to ``exit_`` (None: to the best end of a conversation), and the exit state."""
    cost, back = _forward(roles, [0 if i == entry else NEVER for i in range(4)])
    if exit_ is None:
        exit_ = min(range(4), key=lambda s: (cost[s] + INSERT * len(ENDINGS[s]), s))
    path, state = [], exit_
    for best in reversed(back):
        path.append(best[state])
        state = best[state][0]
    return path[::-1], exit_


_TURN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
CHUNKS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("turns", T.ArrayType(_TURN)), T.StructField("costs", T.ArrayType(T.LongType()))])
BOUNDS = "part int, seq long, entry int, exit int, start long, last boolean"


def _chunked(rows: DataFrame, size: int) -> DataFrame:
    names, types = CHUNKS.names, [arrow_type(f.dataType) for f in CHUNKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, part, seq = None, [], 0, 0

        def chunk() -> tuple:
            return conv, part, seq, turns, matrix([t["role"] for t in turns])

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if turns and (row["conv_id"] != conv or len(turns) >= size):
                    done.append(chunk())
                    turns, seq = [], seq + 1
                conv, part = row["conv_id"], row["part"]
                turns.append({"turn": row["turn"], "role": row["role"], "text": row["text"]})
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*done)), types)], names=names)
        if turns:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(chunk(), types)], names=names)

    return rows.mapInArrow(run, CHUNKS)


def _bounds(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state of each chunk of one conversation, from the chunks' matrices."""
    pdf = pdf.sort_values(["part", "seq"])
    ms = [np.array(list(c), np.int64).reshape(4, 4) for c in pdf.costs]
    reach = [np.array([0, NEVER, NEVER, NEVER], np.int64)]
    for m in ms:
        reach.append(np.minimum((reach[-1][:, None] + m).min(axis=0), NEVER))
    state = int(np.argmin(reach[-1] + INSERT * np.array([len(ENDINGS[s]) for s in range(4)])))
    states = [state]
    for m, before in zip(reversed(ms), reversed(reach[:-1])):
        states.append(int(np.argmin(before + m[:, states[-1]])))
    states = states[::-1]
    n = pdf.n.to_numpy()
    last = np.zeros(len(n), bool)
    last[-1] = True
    return pd.DataFrame({"part": pdf.part.to_numpy(), "seq": pdf.seq.to_numpy(), "entry": states[:-1], "exit": states[1:], "start": np.cumsum(n) - n, "last": last})


REPAIRED = struct(conv_id="long", pos="long", turn="long", source_role="string", role="string", action="string", inserted="string", appended="string", cost="long", fragment="string")


def render(turns: list[dict], entry: int, exit_: int | None, start: int, last: bool) -> list[tuple]:
    path, state = solve([t["role"] for t in turns], entry, exit_)
    out = []
    for i, (turn, (a, b, cost, action)) in enumerate(zip(turns, path)):
        text, first = turn["text"] or "", start + i == 0
        if action == "merge":
            inserted, fragment = (), JOINT + text
        else:
            inserted = BRIDGES[a, b]
            heads = "".join(HEAD.format(role=STATES[s]) + FOOT for s in inserted)
            fragment = ("" if first else FOOT) + heads + HEAD.format(role=STATES[b]) + text
        appended = ENDINGS[state] if last and i == len(turns) - 1 else ()
        if last and i == len(turns) - 1:
            fragment += FOOT + "".join(HEAD.format(role=STATES[s]) + FOOT for s in appended)
        out.append((start + i, turn["turn"], turn["role"], STATES[b], action, ",".join(STATES[s] for s in inserted), ",".join(STATES[s] for s in appended), cost + INSERT * len(appended), fragment))
    return out


def repair(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per input turn: its place, its role now, what was done at what cost, the
    roles of empty turns inserted before it (or appended after the last), and its piece of the rendered text; a
    conversation's pieces in order of ``pos`` are its rendering."""
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")]
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("nth", F.monotonically_increasing_id())
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "conv_id", "turn", "role", F.xxhash64("text"), "nth").sortWithinPartitions(*keys[:3], F.xxhash64("text"), "nth")
    chunks = written(_chunked(ordered.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part")), chunk_turns), "chunks")
    slim = chunks.select("conv_id", "part", "seq", "costs", F.size("turns").alias("n"))
    several = slim.groupBy("conv_id").agg(F.count("*").alias("chunks")).filter("chunks > 1").select(F.col("conv_id").alias("id"))
    bounds = slim.join(several, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi").groupBy("conv_id").applyInPandas(_bounds, BOUNDS)
    placed = chunks.select("conv_id", "part", "seq", "turns").join(bounds, ["part", "seq"], "left")

    def fn(batch: pa.RecordBatch) -> dict:
        out = []
        for r in batch.to_pylist():
            alone = r["entry"] is None
            solved = render(r["turns"], 0 if alone else r["entry"], None if alone else r["exit"], 0 if alone else r["start"], alone or r["last"])
            out += [(r["conv_id"], *x) for x in solved]
        return dict(zip(REPAIRED.names, map(list, zip(*out))))

    return map_batches(placed.select("conv_id", "turns", "entry", "exit", "start", "last"), fn, REPAIRED)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
