"""Trees parsed block by block against the parse in one go."""

import random

from graphs import rows

from depquarry.sources import build_text, build_tree


def random_tree(rng, n):
    """Lines of a tree with pruned nodes, inline code, jumps in depth, and lines before and after it."""
    out = ["noise"] * rng.randrange(3) + ["+-all"] * rng.choice([0, 1, 1, 1])
    depth = 0
    for i in range(n):
        x = rng.random()
        if x < 0.06:
            out += ["  +-" + " " * rng.randrange(3), *[f"code {k}" for k in range(rng.randrange(4))]]
        elif x < 0.07:
            out.append(rng.choice(["the end", "+-all", "+-prog"]))
        else:
            depth = rng.randrange(1, depth + 2) if rng.random() < 0.93 else rng.randrange(1, 9)
            name = rng.choice(["a.o", "b.a", "c.h", "d.js", "/usr/x", "prog", "x.cpp"])
            out.append("  " * depth + "+-" + (f"[{name}]" if rng.random() < 0.1 else name))
    return out


def in_blocks(tree_id, lines, cuts):
    blocks = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)])]
    effects = [build_tree.effect(b) for b in blocks]
    _, _, anew = build_tree.combine(effects, {})
    states, ends, again = build_tree.combine(effects, {i: build_tree.effect(blocks[i], level) for i, level in anew.items()})
    assert not again
    got, runs = [], {}
    for block, state, end in zip(blocks, states, ends):
        nodes, code = build_tree.parse_block(tree_id, block, state, end)
        got += nodes
        for pos, blank, text in code:
            at, before = runs.get(pos, (blank, []))
            runs[pos] = (blank, before + text if at == blank else text)
    for r in got:
        r[-1] = "\n".join(runs[r[1]][1]) if r[1] in runs else None
    return got, bool(anew)


def test_blocks_of_random_trees_cut_anywhere():
    rng = random.Random(4)
    anew = 0
    for _ in range(3000):
        lines = list(enumerate(random_tree(rng, rng.randrange(30))))
        cuts = sorted(rng.sample(range(1, max(2, len(lines))), min(rng.randrange(6), max(0, len(lines) - 1))))
        got, odd = in_blocks("t", lines, cuts)
        anew += odd
        assert got == build_tree.tree_rows("t", lines), (lines, cuts)
    assert anew > 50  # jumps in depth at the begin of a block occur


def test_long_trees_over_many_tasks(spark):
    rng = random.Random(6)
    trees = {f"t{i}": random_tree(rng, n) for i, n in enumerate([0, 3, 40, 300, 1500])}
    trees["deep"] = ["+-all", *["  " * d + "+-n.o" for d in range(1, 40)], *["  " * d + "+-m.a" for d in range(40, 0, -1)]]
    table = [(t, i, x) for t, lines in trees.items() for i, x in enumerate(lines)]
    rng.shuffle(table)
    lines = spark.createDataFrame(table, "tree_id string, pos long, line string")
    want = sorted(tuple(r) for t, x in trees.items() for r in build_tree.tree_rows(t, list(enumerate(x))))
    for block in (7, 64, build_tree.BLOCK):
        got = sorted(tuple(r) for r in build_tree.parse_build_tree(lines, block).collect())
        assert got == want


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {"a.log": [f"line {i} é" for i in range(2000)], "b.log": ["one", "", "three"], "c.log": []}
    for name, x in texts.items():
        (tmp_path / name).write_text("".join(f"{y}\n" for y in x))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [(r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in build_text.read_lines(spark, str(tmp_path)).collect()]
            assert sorted(got) == sorted((name, i, y) for name, x in texts.items() for i, y in enumerate(x))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_short_symbol_dump(spark):
    dump = spark.createDataFrame([("a.o", " f(int) ", "used"), ("a.o", "", "used"), ("a.o", " .Lx", "defined"), ("a.o", "g", "defined")], "object_file string, line string, kind string")
    assert rows(build_text.parse_symbol_dump(dump, "short"), "object_file", "symbol", "kind") == [("a.o", "f(int)", "used"), ("a.o", "g", "defined")]
