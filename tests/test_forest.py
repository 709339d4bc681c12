"""Process forests: deep chains, cycles, pid reuse, several machines, root rules."""

import random

from pyspark.sql import functions as F

from traceframe.functions import exprs as X
from traceframe.functions import forest
from traceframe.operators import family as FM
from traceframe.operators import process as P


def edges(spark, rows):
    return spark.createDataFrame(rows, "pid long, ppid long")


def test_chain_of_ten_thousand_levels(spark):
    chain = edges(spark, [(i, i - 1 if i else None) for i in range(10_000)]).repartition(4)
    got = P.process_lineage(chain).agg(F.max("depth"), F.min("root_pid"), F.max("root_pid"), F.count("*")).first()
    assert tuple(got) == (9_999, 0, 0, 10_000)
    kept = forest.with_ancestors(chain, "pid", "ppid", F.col("pid") == 7_000)
    assert kept.agg(F.count("*"), F.max("node")).first()[:] == (7_001, 7_000)


def test_nearest_stop_roots_cycles_and_repeats(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (4, 3), (5, 50), (None, 1), (6, 6), (10, 11), (11, 12), (12, 10), (13, 12), (14, 13)]
    got = {r.node: (r.root, r.depth, r.stopped) for r in forest.nearest(edges(spark, rows), "pid", "ppid", F.col("pid").isin(2, 14)).collect()}
    assert got == {1: (1, 0, False), 2: (2, 0, True), 3: (2, 1, True), 4: (2, 2, True), 5: (50, 1, False), 50: (50, 0, False),
                   6: (6, 0, False), 10: (10, 0, False), 12: (10, 1, False), 11: (10, 2, False), 13: (10, 2, False), 14: (14, 0, True)}
    marked = forest.with_ancestors(edges(spark, rows), "pid", "ppid", F.col("pid").isin(4, 14)).collect()
    assert {r.node for r in marked} == {1, 2, 3, 4, 10, 11, 12, 13, 14}
    empty = edges(spark, rows).where("pid < 0")
    assert forest.nearest(empty, "pid", "ppid").count() == forest.above(empty, "pid", "ppid", F.array(F.lit("x"))).count() == 0


def test_forest_against_brute_force(spark):
    rng = random.Random(4)
    up = {(s, i): (None if rng.random() < .1 else rng.randrange(i) if i else None) for s in "ab" for i in range(120)}
    label = {k: rng.choice([None, None, "x", "y"]) for k in up}
    df = spark.createDataFrame([(s, i, p, label[s, i]) for (s, i), p in up.items()], "machine string, pid long, ppid long, label string")

    def path(s, i):
        while (i := up[s, i]) is not None:
            yield i

    got = {(r.machine, r.node): set(r.tags) for r in forest.above(df, "pid", "ppid", F.when(F.col("label").isNotNull(), F.array("label")), ["machine"]).collect()}
    assert got == {(s, i): {label[s, j] for j in path(s, i)} - {None} for s, i in up}
    roots = FM.agent_roots(df, F.col("label"), scope=["machine"])
    want = {(s, i) for s, i in up if label[s, i] and label[s, i] not in {label[s, j] for j in path(s, i)}}
    assert {(r.machine, r.pid) for r in roots.collect()} == want
    family = {}
    for s, i in up:
        for d, j in enumerate([i, *path(s, i)]):
            if (s, j) in want:
                family[s, i] = (j, d)
                break
    assert {(r.machine, r.pid): (r.root_pid, r.depth) for r in FM.process_family(df, roots, ["machine"]).collect()} == family


def test_related_of_nested_targets(spark):
    rng = random.Random(6)
    up = {i: rng.randrange(i) if i else None for i in range(60)}
    targets = [0, 3, 7, 20, 41, 77]

    def path(i):
        while (i := up.get(i)) is not None:
            yield i

    want = set()
    for t in targets:
        kin = {t: "self"}
        if up.get(t) is not None:
            kin.setdefault(up[t], "parent")
        for i in up:
            if t in path(i):
                kin.setdefault(i, "descendant")
        for i in up:
            if i != t and up.get(t) is not None and up[i] == up[t]:
                kin.setdefault(i, "sibling")
        want |= {(t, i, r) for i, r in kin.items()}
    got = FM.related_pids(edges(spark, list(up.items())), spark.createDataFrame([(t,) for t in targets], "pid long"))
    assert {tuple(r) for r in got.collect()} == want


def test_reused_pids_on_two_machines_never_parent_each_other(spark):
    rows = [("r", m, f"p{pid}-{s}", pid, ppid, s, e) for m in ("m1", "m2") for pid, ppid, s, e in
            [(1, 2, 0, None), (2, 1, 0, None), (5, 1, 10, 20), (5, 2, 30, None), (6, 5, 15, None), (7, 5, 40, None), (8, 5, 25, None)]]
    nodes = spark.createDataFrame(rows, "run_id string, machine string, id string, pid long, ppid long, start_timestamp_ms long, end_timestamp_ms long")
    got = {(r.machine, r.child_id): r.parent_id for r in P.process_parents(nodes, scope=P.SCOPE).collect()}
    want = {"p1-0": None, "p2-0": "p1-0", "p5-10": "p1-0", "p5-30": "p2-0", "p6-15": "p5-10", "p7-40": "p5-30", "p8-25": None}
    assert got == {(m, c): p for m in ("m1", "m2") for c, p in want.items()}
    trees = P.process_lineage(P.process_forest(nodes, P.SCOPE), P.SCOPE, "id", "parent_id").collect()
    assert {(r.id, r.root_id, r.depth) for r in trees if r.machine == "m2"} >= {("p7-40", "p1-0", 3), ("p8-25", "p8-25", 0)}


def agent_ids(spark, rows):
    df = spark.createDataFrame(rows, "pid long, ppid long, comm string, command string")
    return sorted(r.pid for r in FM.agent_roots(df, X.known_agent_label(F.col("comm"), F.col("command")), FM.is_exec_invocation(F.col("command"))).collect())


def test_agent_roots_by_label_and_nested_exec(spark):
    assert agent_ids(spark, [(1, 0, "node", "node /opt/npm/bin/codex"), (2, 1, "codex", ""), (3, 0, "claude", "")]) == [1, 3]
    assert agent_ids(spark, [(1, 0, "node", "node /opt/node/bin/codex app-server --listen sock"),
                             (2, 1, "node", "node /opt/node/bin/codex exec -C /work hello"),
                             (3, 2, "codex", "/opt/node_modules/@openai/codex-linux-x64/bin/codex exec -C /work hello")]) == [1, 2]
    assert agent_ids(spark, [(1, 0, "claude", None), (2, 1, "bash", "bash -c x"), (3, 2, "codex", "codex"), (4, 3, "claude", "claude")]) == [1, 3]
    plain = edges(spark, [(1, 0), (2, 1), (3, 2), (4, 0)])
    assert sorted(r.pid for r in FM.root_processes(plain, F.col("pid").isin(1, 3, 4)).collect()) == [1, 4]
