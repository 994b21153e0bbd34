"""Dependency trees of a build, parsed in parallel inside a tree.

A line's place in the tree hangs on the lines before it: on the nodes still open (one a level), on how many children they
have, on whether inline code is being read. What a block of ``BLOCK`` lines does to that state is small: it closes the
open nodes from some level on, gives the one below some children, and leaves a few new ones open. So a long tree is
parsed in three steps: every block's effect, by tasks side by side; the effects of a tree combined in order, a row a
block, which gives every block the state it starts from and the ends of the nodes that it leaves open; then every block
from its state. A tree of one block needs the last step only.

A node's level is the number of nodes above it. A line that is indented by more than one level beyond the line before it
hangs on that line; if that happens at a block's begin, the block's effect is taken again, its level known by then.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from copy import deepcopy

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import child_type
from ..storage import settled as written

BLOCK = 1 << 16
_node = re.compile(r"(.*?)\+-(.*)")
_TREE = "tree_id string, pos long, depth int, name string, pruned boolean, type string, parent_pos long, parent_name string, parent_type string, child_ordinal int, end_pos long, inlineCode string"
_NAMES = [c.split()[0] for c in _TREE.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in _TREE.split(", ")])
_POS, _END, _CODE = (_NAMES.index(c) for c in ("pos", "end_pos", "inlineCode"))
_BEFORE, _INSIDE, _DONE = 0, 1, 2


def _start() -> dict:
    """A state: how far the tree is, the open nodes (pos, name, type, children), the line at which inline code begins, the last node."""
    return {"phase": _BEFORE, "open": [], "blank": None, "last": None}


def parse_block(tree_id: str, lines: list[tuple[int, str]], state: dict, ends: list[int] | None = None) -> tuple[list[list], list[tuple]]:
    """The nodes of a block that starts from ``state`` (changed to what holds after it), and the runs of inline code
    (pos of the node, line of its begin, lines). ``ends``: the last lines of the nodes left open, by level."""
    rows: list[list] = []
    runs: list[tuple] = []
    stack = [[*x, None] for x in state["open"]]
    phase, blank, last, code = state["phase"], state["blank"], state["last"], []

    def close(level: int) -> None:
        for x in stack[level:]:
            if x[4]:
                x[4][_END] = last
        del stack[level:]

    def add(pos: int, depth: int, name: str, pruned: bool, parent: list | None) -> None:
        kind = child_type(parent[2], parent[3], name) if parent else "target"
        rows.append([tree_id, pos, depth, name, pruned, kind, *(parent[:3] if parent else [None] * 3), parent[3] if parent else None, pos, None])
        stack.append([pos, name, kind, 0, rows[-1]])

    for pos, line in lines:
        if phase == _DONE:
            break
        if phase == _BEFORE:
            if line == "+-all":
                add(pos, 0, "all", False, None)
                phase, last = _INSIDE, pos
            continue
        m = _node.match(line)
        if not m and blank is not None:
            code.append(line)
            continue
        if blank is not None:
            runs.append((stack[-1][0], blank, code))
            blank, code = None, []
        depth = len(m[1]) // 2 if m else 0
        if m and not m[2].strip(" "):
            blank = pos
            continue
        if depth < 1:
            phase = _DONE
            break
        close(depth)
        stack[-1][3] += 1
        pruned = m[2].startswith("[") and m[2].endswith("]")
        add(pos, depth, m[2][1:-1] if pruned else m[2], pruned, stack[-1])
        last = pos
    if blank is not None:
        runs.append((stack[-1][0], blank, code))
    if phase == _DONE:
        close(0)
    for level, x in enumerate(stack):
        if x[4]:
            x[4][_END] = last if ends is None else ends[level]
    state |= {"phase": phase, "open": [x[:4] for x in stack], "blank": blank, "last": last}
    return rows, runs


def tree_rows(tree_id: str, lines: list[tuple[int, str]]) -> list[list]:
    """The nodes of a tree in one go."""
    rows, runs = parse_block(tree_id, lines, _start())
    code = {pos: "\n".join(x) for pos, _, x in runs}
    for r in rows:
        r[_CODE] = code.get(r[_POS])
    return rows


def effect(lines: list[tuple[int, str]], level: int | None = None) -> dict:
    """What a block does to any state. ``begun``: the state after it if the tree had not begun before. Else: ``text``, lines
    before any node, which end the tree unless they are inline code; ``first`` and ``level``, the first node's depth and
    the last one's level; ``low``, the lowest level that got nodes, ``children`` so many; ``left``, the nodes left open
    (pos, name, place among its siblings, children); ``closed``, levels closed and the last node before; ``blank``.

    ``level`` is that of the last node before the block, if it matters.
    """
    out: dict = {"begun": None, "text": False, "met": False, "first": None, "low": None, "children": 0, "closed": [], "blank": None, "last": None, "n": 0, "done": False}
    if any(line == "+-all" for _, line in lines):
        parse_block("", lines, begun := _start())
        out["begun"] = begun
    left: list[list] = []
    low, children = None, 0
    for pos, line in lines:
        m = _node.match(line)
        if not m:
            if out["blank"] is None and out["met"]:
                out["done"] = True
                break
            out["text"] |= not out["met"]
            continue
        out["met"], out["blank"] = True, None
        if not m[2].strip(" "):
            out["blank"] = pos
            continue
        depth = len(m[1]) // 2
        if depth < 1:
            out["done"] = True
            break
        if out["first"] is None:
            out["first"] = depth
        level = depth if level is None else min(depth, level + 1)
        if low is None or level < low:
            out["closed"].append((level, out["last"]))
            low, children, left = level, 0, []
        if level == low:
            children += 1
        else:
            left[level - 1 - low][3] += 1
        place = children if level == low else left[level - 1 - low][3]
        name = m[2][1:-1] if m[2].startswith("[") and m[2].endswith("]") else m[2]
        left[level - low :] = [[pos, name, place, 0]]
        out["last"], out["n"] = pos, out["n"] + 1
    if out["done"]:
        out["closed"].append((0, out["last"]))
    return out | {"low": low, "children": children, "left": left, "level": level}


def combine(effects: list[dict], exact: dict[int, dict]) -> tuple[list[dict], list[list[int]], dict[int, int]]:
    """The states that a tree's blocks start from, the ends of the nodes that they leave open, and the blocks whose effect
    must be taken anew, with the level of the node before them. ``exact``: effects taken so."""
    state, states, anew, closed, depths, lasts = _start(), [], {}, [], [], []
    for i, e in enumerate(effects):
        states.append(deepcopy(state))
        shut: list = []
        stack = state["open"]
        if state["phase"] == _BEFORE and e["begun"]:
            state = deepcopy(e["begun"])
        elif state["phase"] == _INSIDE and e["text"] and state["blank"] is None:
            state |= {"phase": _DONE, "open": []}
            shut = [(0, None)]
        elif state["phase"] == _INSIDE:
            level = len(stack) - 1
            wrong = e["first"] is not None and e["first"] > level + 1
            if wrong and i in exact:
                e, wrong = exact[i], False
            if wrong:
                anew[i] = level
                size = min(e["level"], level + e["n"]) + 1
                stack = [(stack[j] if j < len(stack) else [0, "", "", 0]) for j in range(size)]
            elif e["low"] is not None:
                stack = stack[: e["low"]]
                before = stack[-1][3]
                stack[-1][3] += e["children"]
                for j, (pos, name, place, kids) in enumerate(e["left"]):
                    stack.append([pos, name, child_type(stack[-1][2], place if j else before + place, name), kids])
            shut = e["closed"]
            state = {"phase": _DONE if e["done"] else _INSIDE, "open": [] if e["done"] else stack, "blank": e["blank"] if e["met"] else state["blank"], "last": state["last"] if e["last"] is None else e["last"]}
        closed.append(shut)
        depths.append(len(state["open"]))
        lasts.append(state["last"])
    ends: list[list[int]] = [[]] * len(effects)
    after = [lasts[-1]] * depths[-1]
    for i in reversed(range(len(effects))):
        ends[i] = after
        if i:
            found = lambda level: next((lasts[i - 1] if last is None else last for low, last in closed[i] if low <= level), None)  # noqa: E731, B023
            after = [last if (last := found(level)) is not None else after[level] for level in range(depths[i - 1])]
    return states, ends, anew


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("depth", "parent_pos", "child_ordinal", "end_pos", "blank") if c in names})


def _pairs(pdf: pd.DataFrame) -> list[tuple[int, str]]:
    pdf = pdf.sort_values("pos")
    return list(zip(pdf.pos.tolist(), pdf.line.tolist()))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees one after another, each in one go, from lines in order."""
    tree_id, lines = None, []

    def made(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for batch in batches:
        rows: list[list] = []
        for t, pos, line in zip(*[batch.column(c).to_pylist() for c in ("tree_id", "pos", "line")]):
            if t != tree_id:
                rows += tree_rows(tree_id, lines)
                tree_id, lines = t, []
            lines.append((pos, line))
        if rows:
            yield made(rows)
    if rows := tree_rows(tree_id, lines):
        yield made(rows)


def _effect(pdf: pd.DataFrame) -> pd.DataFrame:
    level = int(pdf.level.iloc[0]) if "level" in pdf else None
    return pd.DataFrame({"tree_id": [pdf.tree_id.iloc[0]], "block": [pdf.block.iloc[0]], "exact": [level is not None], "effect": [json.dumps(effect(_pairs(pdf), level))]})


def _combined(pdf: pd.DataFrame) -> pd.DataFrame:
    every = pdf[~pdf.exact].sort_values("block")
    place = {b: i for i, b in enumerate(every.block)}
    exact = {place[b]: json.loads(e) for b, e in zip(pdf.block[pdf.exact], pdf.effect[pdf.exact])}
    states, ends, anew = combine([json.loads(e) for e in every.effect], exact)
    level = pd.array([anew.get(i) for i in range(len(states))], "Int64")
    return pd.DataFrame({"tree_id": every.tree_id.values, "block": every.block.values, "state": [json.dumps(x) for x in states], "ends": [json.dumps(x) for x in ends], "level": level})


def _resumed(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    names = [*_NAMES, "block", "blank", "code"]
    if pdf.empty:
        return _frame([], names)
    tree_id, block = pdf.tree_id.iloc[0], int(pdf.block.iloc[0])
    rows, runs = parse_block(tree_id, _pairs(pdf), json.loads(start.state.iloc[0]), json.loads(start.ends.iloc[0]))
    rows = [[*r, block, None, None] for r in rows]
    rows += [[tree_id, pos, None, None, None, None, None, None, None, None, None, None, block, blank, code] for pos, blank, code in runs]
    return _frame(rows, names)


def parse_build_tree(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tree_id, pos, line) -> one row per node with its parent, type, place among its siblings and last line. ``pos``
    numbers the lines of a tree; ``block`` of them are parsed at once."""
    lines = written(lines.select("tree_id", "pos", "line"), "tree-lines").withColumn("block", F.floor(F.col("pos") / block))
    long = written(lines.filter("block > 0").select("tree_id").distinct(), "long-trees")
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = lambda rows: rows.select("tree_id", "pos", "line").repartition(n, "tree_id").sortWithinPartitions("tree_id", "pos").mapInArrow(_whole, _TREE)
    if long.isEmpty():
        return whole(lines)
    short = whole(lines.join(long, "tree_id", "left_anti"))
    key, at = ["tree_id", "block"], "tree_id string, block long"
    parts = lines.join(long, "tree_id", "left_semi")
    effects = written(parts.groupBy(*key).applyInPandas(_effect, f"{at}, exact boolean, effect string"), "effects")
    combined = lambda e: written(e.groupBy("tree_id").applyInPandas(_combined, f"{at}, state string, ends string, level long"), "states")
    states = combined(effects)
    anew = states.filter("level is not null").select(*key, "level")
    if not anew.isEmpty():
        states = combined(effects.unionByName(parts.join(anew, key).groupBy(*key).applyInPandas(_effect, f"{at}, exact boolean, effect string")))
    schema = f"{_TREE}, block long, blank long, code array<string>"
    parsed = written(parts.groupBy(*key).cogroup(states.groupBy(*key)).applyInPandas(_resumed, schema), "parsed-trees")
    # of a node's runs of inline code the last counts; one run may lie in several blocks
    run = F.array_sort(F.collect_list(F.struct("blank", "block", "code")))
    runs = parsed.filter("code is not null").groupBy("tree_id", "pos").agg(run.alias("r"))
    last = F.filter("r", lambda x: x["blank"] == F.array_max(F.transform("r", lambda y: y["blank"])))
    runs = runs.select("tree_id", "pos", F.array_join(F.flatten(F.transform(last, lambda x: x["code"])), "\n").alias("inlineCode"))
    nodes = parsed.filter("name is not null").drop("inlineCode", "block", "blank", "code")
    return short.unionByName(nodes.join(runs, ["tree_id", "pos"], "left").select(*_NAMES))
