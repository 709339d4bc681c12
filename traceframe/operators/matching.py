"""Session ↔ process matching.

Both passes take pairs of a session and a process greedily in a total order. A
pair that is the first of its session and the first of its process among all
that are left is taken by the greedy choice whatever else happens, so each
round takes all such pairs at once; rounds repeat until no pair is left. No
table of all pairs arises:

* Path evidence, in order of session, then process: of the sessions that share
  a path only the first takes part in a round, so a round's pairs are at most
  the rows of evidence.
* Same working directory, in order of distance between the session's end and
  the process's start, later end, session, process: the nearest partners of a
  row are its neighbours in time, found by running scans
  (``functions/scan.py``), so a directory may hold any share of the rows.

Everything is keyed by ``scope`` (machine and sample, say) and agent. Evidence
confidences: eBPF-observed session file 0.95, open fd 0.90, sticky binding
0.70, same cwd 0.55.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import running_last
from ..session import discard, stored

START_SKEW_MS = 30_000
CONFIDENCE = {"ebpf_file": 0.95, "proc_fd": 0.90, "sticky_binding": 0.70, "recent_cwd": 0.55}
BUCKET_MS = 3_600_000


def _confidence(trace: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), trace)


def match_sessions(sessions: DataFrame, processes: DataFrame, evidence: DataFrame,
                   bindings: DataFrame | None = None, scope: list[str] = ()) -> DataFrame:
    """One process per session and session per process.

    ``sessions``: session_id, agent, path, end_ms, cwd, ord;
    ``processes``: root_pid, starttime_ticks, agent, start_ms, cwd, ord;
    ``evidence``: root_pid, path, trace ('ebpf_file' | 'proc_fd'), the
    session-log paths seen for the process (eBPF beats fd on the same path);
    ``bindings`` (J11): root_pid, starttime_ticks, bound_path from earlier
    samples. All have the ``scope`` columns; within scope and agent, ids and
    ``ord`` of sessions and of processes are unique. A process with evidence
    only goes with the paths of its evidence, one that is bound only with its
    path. Rows without agent match nothing."""
    scope = list(scope)
    keys = [*scope, "agent"]
    s = stored(sessions.where("agent is not null").select(*keys, "session_id", "path", "end_ms", F.nullif("cwd", F.lit("")).alias("cwd"), F.col("ord").alias("s_ord")))
    p = processes.where("agent is not null").select(*keys, "root_pid", "starttime_ticks", "start_ms", F.nullif("cwd", F.lit("")).alias("cwd"), F.col("ord").alias("p_ord"))
    if bindings is not None:
        p = p.join(bindings.select(*scope, "root_pid", "starttime_ticks", "bound_path"), [*scope, "root_pid", "starttime_ticks"], "left")
    else:
        p = p.withColumn("bound_path", F.lit(None).cast("string"))
    seen = evidence.groupBy(*scope, "root_pid", "path").agg(F.max(F.col("trace") == "ebpf_file").alias("_ebpf"))
    p = stored(p.join(seen.select(*scope, "root_pid", F.lit(True).alias("seen")).distinct(), [*scope, "root_pid"], "left"))
    mine = p.drop("cwd", "seen", "bound_path")
    by_file = mine.join(seen, [*scope, "root_pid"]).withColumn("evidence", F.when(F.col("_ebpf"), "ebpf_file").otherwise("proc_fd")).drop("_ebpf")
    bound = p.where("seen is null and bound_path is not null").withColumnRenamed("bound_path", "path").withColumn("evidence", F.lit("sticky_binding"))
    paths = by_file.unionByName(bound.select(*by_file.columns)).where("path is not null")
    first = _by_path(s, stored(paths), keys)
    free_s = s.join(first, [*keys, "session_id"], "left_anti").where("cwd is not null")
    free_p = p.where("seen is null and bound_path is null and start_ms is not null and cwd is not null").join(first, [*keys, "root_pid"], "left_anti")
    second = _by_time(free_s, free_p, [*keys, "cwd"])
    return (first.unionByName(second).select(*scope, "session_id", "agent", "root_pid", "starttime_ticks", "evidence",
                                             _confidence(F.col("evidence")).alias("confidence")))


def _by_path(sessions: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with evidence of the session's path, in order of (session, process)."""
    left = stored(sessions.join(paths.select(*keys, "path").distinct(), [*keys, "path"], "left_semi").drop("cwd"))
    taken = None
    while not left.isEmpty():
        heads = left.groupBy(*keys, "path").agg(F.min_by(F.struct("session_id", "end_ms", "s_ord"), "s_ord").alias("s")).select(*keys, "path", "s.*")
        at = stored(paths.join(heads, [*keys, "path"]))
        fits = at.where(F.col("start_ms").isNull() | (F.col("end_ms") + START_SKEW_MS >= F.col("start_ms")))
        choice = (fits.groupBy(*keys, "session_id").agg(F.min_by(F.struct("root_pid", "starttime_ticks", "evidence", "s_ord"), "p_ord").alias("c"))
                  .select(*keys, "session_id", "c.*"))
        # The first session on any path of the process; if it is the chooser, no other pair of the process comes before.
        wanted = at.groupBy(*keys, "root_pid").agg(F.min("s_ord").alias("s_ord"))
        found = stored(choice.join(wanted, [*keys, "root_pid", "s_ord"]).select(*keys, "session_id", "root_pid", "starttime_ticks", "evidence"))
        hopeless = heads.join(fits, [*keys, "session_id"], "left_anti").select(*keys, "session_id")
        done = found.select(*keys, "session_id").unionByName(hopeless)
        rest = stored(left.join(done, [*keys, "session_id"], "left_anti"))
        fewer = stored(paths.join(found, [*keys, "root_pid"], "left_anti"))
        discard(left, at, paths)
        taken = found if taken is None else taken.unionByName(found)
        left, paths = rest, fewer
    empty = paths.select(*keys, F.lit(None).cast(sessions.schema["session_id"].dataType).alias("session_id"), "root_pid", "starttime_ticks", "evidence").limit(0)
    return empty if taken is None else taken


def _by_time(sessions: DataFrame, processes: DataFrame, line: list[str]) -> DataFrame:
    """Pairs of one ``line`` (scope, agent, directory) by nearness of end and
    start, each the other's first choice in a round. A process that starts more
    than the skew after a session's end does not go with it."""
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = (sessions.select(*line, F.col("end_ms").cast("bigint").alias("t"), F.lit(0).alias("side"), F.col("s_ord").cast("bigint").alias("place"),
                            "session_id", none("root_pid", processes), none("starttime_ticks", processes))
            .unionByName(processes.select(*line, F.col("start_ms").cast("bigint").alias("t"), F.lit(1).alias("side"), F.col("p_ord").cast("bigint").alias("place"),
                                          none("session_id", sessions), "root_pid", "starttime_ticks")))
    rows = stored(rows.where("t is not null"))
    taken = None
    while True:
        near = rows
        for name, sign, sides in (("before", 1, 1), ("after", -1, -1)):
            # Rows of the other side at the same time come first on one of the two ways; of equal times the first place is met last.
            order = {"_o1": F.col("t") * sign, "_o2": F.col("side") * sides, "_o3": -F.col("place")}
            for c, o in order.items():
                near = near.withColumn(c, o)
            bucket = F.floor(F.col("_o1") / BUCKET_MS)
            for side in (0, 1):
                value = F.when(F.col("side") == side, F.struct("t", "place", "session_id", "root_pid"))
                near = running_last(near, line, bucket, list(order), value, f"{name}_{side}")
        def options(side: int) -> Column:
            both = F.filter(F.array(f"before_{side}", f"after_{side}"), lambda o: o.isNotNull())
            if side == 0:  # sessions for a process: it starts at most the skew after their end
                both = F.filter(both, lambda o: o["t"] + START_SKEW_MS >= F.col("t"))
                ranked = F.transform(both, lambda o: F.struct(F.abs(o["t"] - F.col("t")).alias("far"), (-o["t"]).alias("late"), o["place"].alias("place"), o["session_id"].alias("session_id")))
            else:
                both = F.filter(both, lambda o: F.col("t") + START_SKEW_MS >= o["t"])
                ranked = F.transform(both, lambda o: F.struct(F.abs(o["t"] - F.col("t")).alias("far"), o["place"].alias("place"), o["root_pid"].alias("root_pid")))
            return F.array_min(ranked)
        near = stored(near.select(*line, "side", "session_id", "root_pid", "starttime_ticks", options(0)["session_id"].alias("their_s"), options(1)["root_pid"].alias("their_p")))
        by_process = near.where("side = 1 and their_s is not null").select(*line, F.col("their_s").alias("session_id"), "root_pid", "starttime_ticks")
        by_session = near.where("side = 0 and their_p is not null").select(*line, "session_id", F.col("their_p").alias("root_pid"))
        found = stored(by_process.join(by_session, [*line, "session_id", "root_pid"]).select(*line[:-1], "session_id", "root_pid", "starttime_ticks", F.lit("recent_cwd").alias("evidence")))
        discard(near)
        taken = found if taken is None else taken.unionByName(found)
        if found.isEmpty():
            return taken
        rest = rows.join(found.select(*line[:-1], "session_id"), [*line[:-1], "session_id"], "left_anti") \
            .join(found.select(*line[:-1], "root_pid"), [*line[:-1], "root_pid"], "left_anti")
        after = stored(rest)
        discard(rows)
        rows = after


def sticky_bindings(samples: DataFrame, block_ms: int = 3_600_000) -> DataFrame:
    """Per process instance (pid, starttime) and sample, the last
    session path evidenced at or before the sample (carried forward until new
    evidence appears) — a two-level running ``last`` per instance."""
    x = running_last(samples, ["pid", "starttime_ticks"], F.expr(f"sample_ts div {block_ms}"),
                     ["sample_ts"], F.col("evidence_path"), "bound_path")
    return x


def _top(counts: DataFrame, keys: list[str], name: str, n: int, out: str) -> DataFrame:
    """The ``n`` most counted names of each key as 'name(count)' text (count desc, name asc)."""
    w = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col(name).asc())
    return (counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(*keys)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", name, "count"))),
                                          lambda s: F.format_string("%s(%d)", s[name], s["count"])), ", ").alias(out)))


def live_agent_rows(matches: DataFrame, sessions: DataFrame, processes: DataFrame, tool_counts: DataFrame,
                    file_counts: DataFrame | None = None, n_top: int = 10, scope: list[str] = ()) -> DataFrame:
    """T4: one row per session with its matched process (J10), its top
    ``n_top`` tools and files, then one row per live process no session
    matched; all processes where there is no session at all. ``processes``
    carry cpu and rss metrics; ``tool_counts``: session_id, tool_name, count;
    ``file_counts``: session_id, path, count."""
    scope = list(scope)
    keys = [*scope, "session_id"]
    m = matches.select(*keys, "root_pid", "evidence", "confidence")
    p = processes.select(*scope, "root_pid", "cpu_percent", "rss_mb")
    rows = (sessions.select(*keys, "agent").join(m, keys, "left").join(p, [*scope, "root_pid"], "left")
            .join(_top(tool_counts, keys, "tool_name", n_top, "tools"), keys, "left"))
    rows = (rows.join(_top(file_counts, keys, "path", n_top, "files"), keys, "left") if file_counts is not None
            else rows.withColumn("files", F.lit(None).cast("string")))
    rows = rows.withColumn("row_kind", F.lit("session"))
    none = lambda t: F.lit(None).cast(t)
    unmatched = (processes.join(m.select(*scope, "root_pid"), [*scope, "root_pid"], "left_anti")
                 .select(*scope, none("string").alias("session_id"), "agent", "root_pid", none("string").alias("evidence"),
                         none("double").alias("confidence"), "cpu_percent", "rss_mb", none("string").alias("tools"),
                         none("string").alias("files"), F.lit("process").alias("row_kind")))
    return rows.unionByName(unmatched)
