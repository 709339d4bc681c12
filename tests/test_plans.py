"""Plan-shape checks over every registered query: no cartesian products or
nested-loop joins (every join has an equi key), and scans of the driver's
tables read only the columns they need."""

SF = "/root/testdata/sf0.001"


def test_no_cartesian_or_nested_loop_joins(checked):
    bad = {}
    for name, plan in checked[1].items():
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_filters_reach_the_scan(spark):
    from traceframe.sources import fixtures as FX
    plan = FX.llm_calls(spark, SF).select("id", "session_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
