"""Work that grows with the answer or the input, not with the square of a group."""

import itertools

from pyspark.sql import functions as F


def plan_nodes(plan):
    """The nodes of an executed plan, those of its query stages included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from plan_nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from plan_nodes(plan.plan())
    else:
        yield plan
        for k in range(plan.children().size()):
            yield from plan_nodes(plan.children().apply(k))


def most_rows(df):
    """The most rows that a step of the plan of ``df`` made, when it ran."""
    df.collect()
    rows = [n.metrics().get("numOutputRows") for n in plan_nodes(df._jdf.queryExecution().executedPlan())]
    return max(m.get().value() for m in rows if m.isDefined())


INTER = "interaction_id bigint, pid bigint, response_ts bigint, refs array<string>"
ACTS = "action_id bigint, pid bigint, timestamp_ms bigint, args array<string>, score_args array<string>"


def test_correlate_makes_no_pairs_that_are_not_related(spark):
    from traceframe.operators.correlate import correlate
    # '/api' occurs in every argument, which is one of four references: 0.25, not related.
    inter = [(i, 1, i * 10_000, ["/api", f"x{i}.py", f"y{i}.py", f"z{i}.py"]) for i in range(300)]
    acts = [(a, 2, a * 10_000 + 100, ["/api/v1"], ["/api/v1", "sh"]) for a in range(300)]
    related = spark.createDataFrame([(1, 1), (9, 9)], "target bigint, related_pid bigint")
    out = correlate(spark.createDataFrame(inter, INTER), spark.createDataFrame(acts, ACTS), related)
    assert sorted((r.interaction_id, r.action_id, r.in_window, r.in_tree, r.arg_match, r.arg_halves) for r in out.collect()) == \
        [(i, i, True, False, False, 2) for i in range(300)]
    assert most_rows(out) < 10_000


def test_correlate_against_all_pairs(spark):
    from traceframe.operators.correlate import argument_halves, argument_score, correlate
    texts = [None, [], ["/repo/a.py", "cat"], ["/repo/a.py"], ["a b", "/re"], ["b"], ["main.py", "/api", "git"]]
    args = [[], ["/repo/a.py"], ["xa", "bx"], ["/api/main.py", ""], ["b", None], ["git"]]
    inter = [(k // 2 if k % 9 else None, k % 4 if k % 5 else None, 400 * k if k % 8 else None, t) for k, t in enumerate(texts * 3)]
    acts = [(k if k % 7 else 3, k % 5 if k % 6 else None, 300 * k if k % 8 else None, a, a + ["sh"]) for k, a in enumerate(args * 4)]
    rel = [(0, 0), (0, 1), (1, 3), (2, 2), (3, 4)]
    i, a = spark.createDataFrame(inter, INTER), spark.createDataFrame(acts, ACTS)
    out = correlate(i, a, spark.createDataFrame(rel, "target bigint, related_pid bigint"))
    got = sorted(map(repr, ((r.interaction_id, r.action_id, r.in_window, r.in_tree, r.arg_match, r.arg_halves, r.n_refs, r.argument_score) for r in out.collect())))
    lists = spark.createDataFrame([(x, y, t, g) for (x, t), (y, g) in itertools.product(enumerate(texts), enumerate(args))],
                                  "x int, y int, refs array<string>, args array<string>")
    both = F.concat("args", F.array(F.lit("sh")))
    scores = {(r.x, r.y): (r.m, r.h, r.n, r.s) for r in lists.select(
        "x", "y", (argument_score(F.col("refs"), F.col("args")) > 0.3).alias("m"), argument_halves(F.col("refs"), both).alias("h"),
        F.size("refs").cast("bigint").alias("n"), F.round(argument_score(F.col("refs"), both), 6).alias("s")).collect()}
    want = []
    for (n, (iid, ipid, rts, refs)), (m, (aid, apid, ats, given, _)) in itertools.product(enumerate(inter), enumerate(acts)):
        if iid is None or aid is None:
            continue
        match, halves, size, score = scores[n % len(texts), m % len(args)]
        shared = any(r in g and len(r) > 2 or g in r for r in refs or [] for g in given if g)
        window = None if rts is None or ats is None else rts <= ats <= rts + 500
        tree = (ipid, apid) in rel
        if window or tree or (match and shared):
            want.append(repr((iid, aid, window, tree, match, halves, size, score)))
    assert got == sorted(want)


def test_correlations_are_scored_without_their_pairs(spark):
    from traceframe.operators.correlate import correlate, score_correlations
    texts = [None, [], ["/repo/a.py", "cat"], ["/repo/a.py"], ["a b", "/re"], ["b"], ["main.py", "/api", "git"]]
    args = [[], ["/repo/a.py"], ["xa", "bx"], ["/api/main.py", ""], ["b", None], ["git"]]
    inter = [(k // 2 if k % 9 else None, k % 4 if k % 5 else None, 400 * k if k % 8 else None, t) for k, t in enumerate(texts * 4)]
    acts = [(k if k % 7 else 3, k % 5 if k % 6 else None, 300 * k if k % 8 else None, a, a + ["sh"]) for k, a in enumerate(args * 6)]
    rel = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 3), (2, 2), (3, 4), (None, 1), (1, None)], "target bigint, related_pid bigint")
    i, a = spark.createDataFrame(inter, INTER), spark.createDataFrame(acts, ACTS)
    score = lambda totals: sorted(map(repr, score_correlations(correlate(i, a, rel, totals=totals)).collect()))
    assert score(True) == score(False) != []
    # 400 interactions and 400 actions of one pid and two lists: 160 000 pairs, far apart in time
    i = spark.createDataFrame([(k, 1, 10_000 * k, ["/repo/a.py"]) for k in range(400)], INTER)
    a = spark.createDataFrame([(k, 1, 10_000 * k + 100, [f"/repo/a.py{k % 2}"], ["sh"]) for k in range(400)], ACTS)
    out = score_correlations(correlate(i, a, spark.createDataFrame([(1, 1)], rel.schema), totals=True))
    assert {(r.related_actions, r.process_matches, r.temporal_matches, r.argument_matches) for r in out.collect()} == {(400, 400, 1, 400)}
    assert most_rows(out) < 10_000


def test_log_lines_are_parsed_once_and_counted_over_blocks(spark):
    from traceframe.sources import trace as TR
    rows = [(k, "f", "{" if k % 2 else '{"timestamp": 1, "pid": 2, "comm": "c"}') for k in (0, 1, 3, 70_001, 70_003, 140_000, 200_001)]
    lines = spark.createDataFrame(rows, "line_order bigint, file string, line string").withColumn("v", F.expr("try_parse_json(line)"))
    events, diag = TR.split_valid(lines)
    assert events._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 1
    assert sorted((r.line_order, r.parse_error_count) for r in diag.collect()) == [(1, 1), (3, 2), (70_001, 3), (70_003, 4), (200_001, 5)]
    assert events.count() == 2


def test_the_chosen_clusters_are_not_fitted_again(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    from traceframe.operators import tagging as TG
    tried, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, *a: (tried.append(self.getK()), fit(self, *a))[1])
    texts = [(f"{a} {b} {a} report",) for a in ("tiger", "lemon", "piano", "river") for b in ("fast", "slow", "blue")]
    assert TG.tag_cluster(spark.createDataFrame(texts, "text string"), k_min=2, k_max=4).count() == 12
    assert sorted(tried) == [2, 3, 4]
