"""Nothing is cut: deep process chains, cycles, long messages, large counts, long paths."""

from pyspark.sql import functions as F


def test_closure_of_long_chains_cycles_and_shared_children(spark):
    from traceframe.functions.closure import ancestor_closure
    chain = [(i, i - 1) for i in range(1, 101)]
    edges = chain + [(201, 202), (202, 203), (203, 201), (300, 300), (None, 1), (5, None), (7, 0)] + chain[:10]
    got = {(r.node, r.ancestor): r.depth for r in ancestor_closure(spark.createDataFrame(edges, "c long, p long"), "c", "p").collect()}
    want = {(i, j): i - j for i in range(1, 101) for j in range(i)}
    for i in range(7, 101):
        want[i, 0] = i - 7 + 1
    want |= {(201, 202): 1, (202, 203): 1, (203, 201): 1, (201, 203): 2, (202, 201): 2, (203, 202): 2}
    assert got == want


def test_lineage_and_family_below_64_levels(spark):
    from traceframe.operators import family as FM
    from traceframe.operators import process as P
    edges = spark.createDataFrame([(i, i - 1) for i in range(2, 102)] + [(1, None)], "pid long, ppid long")
    last = P.process_lineage(edges).where("pid = 101").first()
    assert (last.root_pid, last.depth) == (1, 100)
    family = FM.process_family(edges, spark.createDataFrame([(1,)], "pid long"))
    assert family.count() == 101 and family.agg(F.max("depth")).first()[0] == 100


def test_long_sse_message_and_large_token_counts(spark):
    from traceframe.operators import sse as SSE
    from traceframe.operators.profiles import token_components
    part = "x" * 1000
    blocks = ['event: message_start\ndata: {"message":{"id":"m1"}}']
    blocks += [f'event: content_block_delta\ndata: {{"delta":{{"type":"text_delta","text":"{part}"}}}}'] * 200
    blocks += ["event: message_stop\ndata: {}"]
    body = spark.createDataFrame([(1, 1, 1, 5, "\n\n".join(blocks))], "pid long, tid long, seq long, timestamp_ms long, body string")
    row = SSE.reassemble_sse(SSE.sse_events(body)).first()
    assert row.text_len == 200_000 and row.complete
    tokens = spark.createDataFrame([(20_000_000, None, None, 20_000_000), (None, None, None, 5_000_000)], "i long, o long, c long, t long")
    got = [[(c.kind, c.value) for c in r[0]] for r in tokens.select(token_components(F.col("i"), F.col("o"), F.col("c"), F.col("t"))).collect()]
    assert got == [[("input", 20_000_000)], [("estimate", 5_000_000)]]


def test_long_paths_and_directories(spark):
    from traceframe.functions.exprs import file_directory
    from traceframe.operators.sessionlog import path_groups
    deep = "src/" + "d" * 60 + "/" + "e" * 300 + ".py"
    df = spark.createDataFrame([("bash", None, f"cat {deep}", "/r")], "n string, p string, c string, r string")
    assert df.select(path_groups(F.col("n"), F.col("p"), F.col("c"), F.col("r"))).first()[0] == ["src/" + "d" * 60]
    paths = {"/x": "/", "a": ".", "a/b": "a", "/a/b/": "/a", "/": ".", "": "."}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", file_directory(F.col("p")).alias("d")).collect()
    assert {r.p: r.d for r in got} == paths


def test_cluster_without_shared_folder_is_an_error():
    import pytest
    from traceframe.session import ensure_checkpoint_dir

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
