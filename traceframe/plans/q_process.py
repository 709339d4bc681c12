"""Process, audit and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import process as P
from ..sources import fixtures as FX
from .registry import register
from .sql_common import AUDIT, PROCESS_CTES, parent_ctes, process_ctes

W = FX.with_fixtures


@register("w2_process_instances", W(
    ["canon"], "SELECT seq, pid, event, timestamp_ms, island, instance_id FROM inst", PROCESS_CTES[:3]))
def w2_process_instances(spark, sf):
    return P.process_instances(FX.canonical_events(spark, sf)).select(
        "seq", "pid", "event", "timestamp_ms", "island", "instance_id")


@register("s8_process_nodes", W(["canon"], "SELECT * FROM nodes", PROCESS_CTES))
def s8_process_nodes(spark, sf):
    return P.process_nodes(FX.canonical_events(spark, sf))


@register("f9_audit_events", W(["canon"], "SELECT * FROM audit", [("audit", AUDIT)]))
def f9_audit_events(spark, sf):
    return P.audit_from_events(FX.canonical_events(spark, sf))


@register("j5_attach_process", W(["canon"], """
    SELECT a.*, b.process_id FROM audit a LEFT JOIN (
        SELECT id, process_id FROM cand
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, hs DESC, process_id DESC) = 1) b
    ON a.id = b.id""", [("audit", AUDIT)] + PROCESS_CTES + [
    ("cand", "SELECT a.id, n.id AS process_id, coalesce(n.start_timestamp_ms, 0) AS s, "
             "n.start_timestamp_ms IS NOT NULL AS hs FROM audit a JOIN nodes n ON a.pid = n.pid "
             "AND coalesce(n.start_timestamp_ms, 0) <= a.timestamp_ms "
             "AND (n.end_timestamp_ms IS NULL OR a.timestamp_ms <= n.end_timestamp_ms)")]))
def j5_attach_process(spark, sf):
    canon = FX.canonical_events(spark, sf)
    return P.attach_process(P.audit_from_events(canon), P.process_nodes(canon))


@register("j6_process_parents", W(["canon"], """
    SELECT c.child_id, b.parent_id FROM child c LEFT JOIN pedges b ON c.child_id = b.child_id""", PROCESS_CTES + parent_ctes()))
def j6_process_parents(spark, sf):
    return P.process_parents(P.process_nodes(FX.canonical_events(spark, sf)))


@register("j6_process_lineage", W(["canon"], """
    SELECT pid, arg_max(anc, depth) AS root_pid, max(depth) AS depth FROM up GROUP BY pid""", [
    ("edges", "SELECT DISTINCT pid, ppid FROM canon WHERE pid IS NOT NULL"),
    ("up", "SELECT pid, pid AS anc, 0 AS depth FROM edges UNION ALL "
           "SELECT up.pid, e.ppid, up.depth + 1 FROM up JOIN edges e ON up.anc = e.pid "
           "WHERE e.ppid <> e.pid AND e.ppid IS NOT NULL")], recursive=True))
def j6_process_lineage(spark, sf):
    return P.process_lineage(P.process_edges(FX.canonical_events(spark, sf)))


# ---- families, roots, related pids, attribution -----------------------------

from ..operators import audit as A  # noqa: E402
from ..operators import family as FM  # noqa: E402

AGENT_COMMS = ["claude", "codex"]


def _procs(spark, sf):
    return FX.proc_samples(spark, sf).select("pid", "ppid", "comm").distinct()


def _roots(spark, sf):
    p = _procs(spark, sf)
    return FM.root_processes(p, F.col("comm").isin(*AGENT_COMMS))


_FAM_SQL = [
    ("procs", "SELECT DISTINCT pid, ppid, comm FROM proc_samples"),
    ("edges", "SELECT DISTINCT pid, ppid FROM procs WHERE ppid IS NOT NULL AND ppid <> pid"),
    ("up", "SELECT pid, ppid AS anc, 1 AS depth FROM edges UNION ALL "
           "SELECT up.pid, e.ppid, up.depth + 1 FROM up JOIN edges e ON up.anc = e.pid"),
    ("m", "SELECT DISTINCT pid FROM procs WHERE comm IN ('claude', 'codex')"),
    ("roots", "SELECT pid FROM m WHERE pid NOT IN (SELECT up.pid FROM up JOIN m ON up.anc = m.pid)"),
    ("edges_nr", "SELECT * FROM edges WHERE pid NOT IN (SELECT pid FROM roots)"),
    ("fam", "SELECT pid AS root_pid, pid, 0 AS depth FROM roots UNION ALL "
            "SELECT fam.root_pid, e.pid, fam.depth + 1 FROM fam JOIN edges_nr e ON e.ppid = fam.pid"),
]


@register("j9_root_processes", W(["proc_samples"], "SELECT pid FROM roots", _FAM_SQL, recursive=True))
def j9_root_processes(spark, sf):
    return _roots(spark, sf)


@register("j8_process_family", W(["proc_samples"], "SELECT root_pid, pid, min(depth) AS depth FROM fam "
                                                    "GROUP BY root_pid, pid", _FAM_SQL, recursive=True))
def j8_process_family(spark, sf):
    return FM.process_family(_procs(spark, sf), _roots(spark, sf)).withColumn("depth", F.col("depth").cast("int"))


@register("j7_related_pids", W(["proc_samples", "canon"], """
    SELECT target, related_pid, ['self', 'parent', 'descendant', 'sibling'][min(o) + 1] AS relation FROM (
        SELECT pid AS target, pid AS related_pid, 0 AS o FROM targets
        UNION ALL SELECT t.pid, e.ppid, 1 FROM targets t JOIN edges e ON t.pid = e.pid
        UNION ALL SELECT t.pid, up.pid, 2 FROM targets t JOIN up ON up.anc = t.pid
        UNION ALL SELECT t.pid, s.pid, 3 FROM targets t JOIN edges p ON t.pid = p.pid
            JOIN edges s ON s.ppid = p.ppid WHERE s.pid <> t.pid)
    GROUP BY target, related_pid""", _FAM_SQL + [
    ("targets", "SELECT DISTINCT pid FROM canon WHERE event = 'EXIT' AND exit_code = 2")],
    recursive=True))
def j7_related_pids(spark, sf):
    c = FX.canonical_events(spark, sf)
    targets = c.where((F.col("event") == "EXIT") & (F.col("exit_code") == 2)).select("pid")
    return FM.related_pids(_procs(spark, sf), targets)


@register("j16_attribute_counters", W(["proc_samples", "canon"], """
    SELECT CAST(root_pid AS VARCHAR) AS root_pid, CAST(sum(process_execs) AS BIGINT) AS process_execs,
        CAST(sum(file_events) AS BIGINT) AS file_events, CAST(sum(network_events) AS BIGINT) AS network_events,
        count(DISTINCT c.pid) AS pids
    FROM counters c JOIN fam f ON c.pid = f.pid GROUP BY root_pid
    UNION ALL
    SELECT 'unattributed', CAST(coalesce(sum(process_execs), 0) AS BIGINT), CAST(coalesce(sum(file_events), 0) AS BIGINT),
        CAST(coalesce(sum(network_events), 0) AS BIGINT), count(DISTINCT pid)
    FROM counters WHERE pid NOT IN (SELECT pid FROM fam)""", [("audit", AUDIT)] + _FAM_SQL + [
    ("counters", "SELECT pid, count(*) FILTER (WHERE audit_type = 'process' AND action = 'exec') AS process_execs, "
                 "count(*) FILTER (WHERE audit_type = 'file') AS file_events, "
                 "count(*) FILTER (WHERE audit_type = 'network') AS network_events "
                 "FROM audit GROUP BY pid")], recursive=True))
def j16_attribute_counters(spark, sf):
    counters = A.audit_counters(P.audit_from_events(FX.canonical_events(spark, sf)), by_pid=True)
    fam = FM.process_family(_procs(spark, sf), _roots(spark, sf))
    return FM.attribute_counters(fam, counters, ["process_execs", "file_events", "network_events"])


# ---- F17: tree filter keeping ancestors of hits ------------------------------------

from ..functions import exprs as X  # noqa: E402
from .sql_common import AUDIT as _AUDIT  # noqa: E402


@register("f17_filter_process_tree", W(["canon"], """
    SELECT k.process_id, CAST(coalesce(h.n, 0) AS BIGINT) AS matching_events FROM up k
    LEFT JOIN hits h ON k.process_id = h.process_id""", [("audit", _AUDIT)] + PROCESS_CTES + [
    ("cand", "SELECT a.id, n.id AS process_id, coalesce(n.start_timestamp_ms, 0) AS s, "
             "n.start_timestamp_ms IS NOT NULL AS hs FROM audit a JOIN nodes n ON a.pid = n.pid "
             "AND coalesce(n.start_timestamp_ms, 0) <= a.timestamp_ms "
             "AND (n.end_timestamp_ms IS NULL OR a.timestamp_ms <= n.end_timestamp_ms)"),
    ("att", "SELECT a.*, b.process_id FROM audit a JOIN (SELECT id, process_id FROM cand QUALIFY row_number() OVER "
            "(PARTITION BY id ORDER BY s DESC, hs DESC, process_id DESC) = 1) b ON a.id = b.id"),
    ("hits", "SELECT process_id, count(*) AS n FROM att WHERE audit_type = 'file' "
             "AND contains(lower(concat_ws(' ', id, audit_type, action, status, comm, target)), '/repo/d3') GROUP BY process_id")] + parent_ctes() + [
    ("up", "SELECT process_id FROM hits UNION SELECT e.parent_id FROM up JOIN pedges e ON e.child_id = up.process_id")],
    recursive=True))
def f17_filter_process_tree(spark, sf):
    canon = FX.canonical_events(spark, sf)
    nodes = P.process_nodes(canon)
    att = P.attach_process(P.audit_from_events(canon), nodes)
    pred = (X.tree_event_type(F.col("audit_type"), F.col("action")) == "file") & X.event_search_text(
        F.col("id"), F.col("audit_type"), F.col("action"), F.col("status"), F.col("comm"), F.col("target")
    ).contains("/repo/d3")
    return P.filter_process_tree(att, P.process_parents(nodes), pred)


@register("f13_observed_processes", W(["canon", "http"], """
    SELECT 'observed-' || pid AS id, pid, arg_max(comm, start_timestamp_ms) AS comm, min(start_timestamp_ms) AS start_timestamp_ms,
        count(*) AS calls, 'observed' AS status, 'llm_call' AS view_source
    FROM (SELECT 200 + page_id % 23 AS pid, 'agent-' || (page_id % 3) AS comm, timestamp_ms AS start_timestamp_ms
          FROM http WHERE message_type = 'request')
    WHERE pid NOT IN (SELECT DISTINCT pid FROM nodes)
    GROUP BY pid""", PROCESS_CTES))
def f13_observed_processes(spark, sf):
    """Calls seen on the HTTP side (pids 200..222) against process nodes from
    the process events (pids of the event users)."""
    h = FX.http_messages(spark, sf).where(F.col("message_type") == "request")
    calls = h.select((F.col("page_id") % 23 + 200).alias("pid"),
                     F.format_string("agent-%d", F.col("page_id") % 3).alias("comm"),
                     F.col("timestamp_ms").alias("start_timestamp_ms"))
    return P.observed_processes(calls, P.process_nodes(FX.canonical_events(spark, sf)))


# ---- Process instances of several runs and machines ---------------------------------

_SC = "run_id, machine, "
_FLEET = process_ctes("fleet", _SC) + parent_ctes(_SC) + [
    ("forest", "SELECT n.run_id, n.machine, n.id, e.parent_id, n.pid, n.comm FROM nodes n LEFT JOIN pedges e "
               "ON e.run_id = n.run_id AND e.machine = n.machine AND e.child_id = n.id"),
    ("agents", f"SELECT {_SC}id, parent_id, CASE WHEN comm IN ('claude', 'codex', 'gemini') THEN comm END AS label, "
               "comm = 'codex' AND pid % 3 = 0 AS nested FROM forest"),
    ("up", f"SELECT {_SC}id, parent_id AS anc FROM forest WHERE parent_id IS NOT NULL UNION "
           "SELECT u.run_id, u.machine, u.id, f.parent_id FROM up u JOIN forest f "
           "ON f.run_id = u.run_id AND f.machine = u.machine AND f.id = u.anc WHERE f.parent_id IS NOT NULL"),
    ("roots", f"SELECT {_SC}id, label FROM agents a WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM up JOIN agents b "
              "ON b.run_id = up.run_id AND b.machine = up.machine AND b.id = up.anc "
              "WHERE up.run_id = a.run_id AND up.machine = a.machine AND up.id = a.id AND b.label = a.label AND (NOT a.nested OR b.nested))"),
    ("fam", f"SELECT {_SC}id AS root_id, id, 0 AS depth FROM roots UNION ALL "
            "SELECT fam.run_id, fam.machine, fam.root_id, f.id, fam.depth + 1 FROM fam JOIN forest f "
            "ON f.run_id = fam.run_id AND f.machine = fam.machine AND f.parent_id = fam.id "
            "WHERE (f.run_id, f.machine, f.id) NOT IN (SELECT (run_id, machine, id) FROM roots)"),
]


def _fleet(spark, sf):
    """Process instances with their parents; every third codex process is an ``exec`` invocation."""
    nodes = P.process_forest(P.process_nodes(FX.fleet_events(spark, sf), P.SCOPE), P.SCOPE)
    task = (F.col("comm") == "codex") & (F.col("pid") % 3 == 0)
    command = F.concat(F.lit("/usr/bin/"), F.col("comm"))
    return nodes.withColumn("command", F.when(task, F.concat(command, F.lit(" exec task"))).otherwise(command))


def _fleet_roots(nodes):
    return FM.agent_roots(nodes, X.known_agent_label(F.col("comm"), F.col("command")), FM.is_exec_invocation(F.col("command")),
                          P.SCOPE, "id", "parent_id")


@register("j6_instance_lineage", W(["fleet"], f"""
    SELECT {_SC}id, parent_id, coalesce(root_id, id) AS root_id, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM forest LEFT JOIN
        (SELECT {_SC}id, count(*) AS depth FROM up GROUP BY ALL) USING (run_id, machine, id) LEFT JOIN
        (SELECT u.run_id, u.machine, u.id, u.anc AS root_id FROM up u JOIN forest f ON f.run_id = u.run_id AND f.machine = u.machine
         AND f.id = u.anc WHERE f.parent_id IS NULL) USING (run_id, machine, id)""",
    _FLEET[:11], recursive=True))
def j6_instance_lineage(spark, sf):
    """J6 over process instances: pids are reused, and two runs on two machines share them."""
    nodes = _fleet(spark, sf)
    up = P.process_lineage(nodes, P.SCOPE, "id", "parent_id")
    return nodes.select(*P.SCOPE, "id", "parent_id").join(up, [*P.SCOPE, "id"])


@register("j9_agent_roots", W(["fleet"], f"SELECT {_SC}id, label FROM roots", _FLEET[:12], recursive=True))
def j9_agent_roots(spark, sf):
    return _fleet_roots(_fleet(spark, sf))


@register("j8_instance_family", W(["fleet"], f"SELECT {_SC}root_id, id, depth FROM fam", _FLEET, recursive=True))
def j8_instance_family(spark, sf):
    nodes = _fleet(spark, sf)
    return FM.process_family(nodes, _fleet_roots(nodes), P.SCOPE, "id", "parent_id")
