"""Oracle SQL building blocks (DuckDB dialect) shared by several queries.

These are brute-force formulations of the same semantics the Spark operators
implement (e.g. the prefix match is a direct ``starts_with`` join here, an
exploded equi join in Spark), so agreement is a real check.
"""

PRIO = ("CASE source WHEN 'response_usage' THEN 0 WHEN 'orphan_response_usage' THEN 1 "
        "WHEN 'gemini_cli_stdout_stats' THEN 2 WHEN 'claude_telemetry' THEN 3 "
        "WHEN 'agent_native_session' THEN 4 ELSE 5 END")

EFF = ("SELECT * EXCLUDE (rn) FROM (SELECT coalesce(nullif(llm_call_id, ''), id) AS token_key, *, "
       "row_number() OVER (PARTITION BY coalesce(nullif(llm_call_id, ''), id) "
       f"ORDER BY {PRIO}, coalesce(confidence, 0) DESC, id) AS rn FROM token_usage) WHERE rn = 1")

CALLS_LATEST = ("SELECT * FROM llm_calls QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")

TK = ("SELECT e.*, nullif(c.session_id, '') AS call_session FROM eff e "
      "LEFT JOIN calls_latest c ON e.llm_call_id = c.id")
PREF = ("SELECT tk.id AS tid, min(s.id) AS prefix_session FROM tk JOIN sessions s "
        "ON (tk.llm_call_id = s.id OR starts_with(tk.llm_call_id, s.id || '-')) "
        "WHERE tk.call_session IS NULL AND tk.llm_call_id <> '' GROUP BY tk.id")
TKS = ("SELECT tk.* EXCLUDE (call_session), coalesce(call_session, prefix_session) AS session_key "
       "FROM tk LEFT JOIN pref ON tk.id = pref.tid")

TOKEN_SESSION_CTES = [("eff", EFF), ("calls_latest", CALLS_LATEST), ("tk", TK), ("pref", PREF),
                      ("tks", TKS)]

# W2 + S8 over canonical events.
def process_ctes(source: str = "canon", scope: str = "") -> list[tuple[str, str]]:
    """``scope``: the columns of run and machine, each with a comma behind it."""
    return [
        ("pe", f"SELECT * FROM {source} WHERE event IN ('EXEC', 'EXIT')"),
        ("isl", "SELECT *, CAST(coalesce(sum(CASE WHEN event = 'EXIT' THEN 1 ELSE 0 END) OVER "
                f"(PARTITION BY {scope}pid ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "
                "AS island FROM pe"),
        ("inst", "SELECT *, 'process-' || pid || '-' || coalesce(min(CASE WHEN event = 'EXEC' THEN timestamp_ms END) "
                 f"OVER (PARTITION BY {scope}pid, island), timestamp_ms) AS instance_id FROM isl"),
        ("noderows", f"SELECT {scope}instance_id AS id, seq, pid, ppid, "
                     "CASE WHEN event = 'EXEC' THEN timestamp_ms END AS start_timestamp_ms, "
                     "CASE WHEN event = 'EXIT' THEN timestamp_ms END AS end_timestamp_ms, comm, "
                     "filename AS command, cwd, CAST(CASE WHEN event = 'EXIT' THEN exit_code END AS INTEGER) AS exit_code, "
                     "CASE WHEN event <> 'EXIT' THEN 'observed' WHEN exit_code = 0 THEN 'success' "
                     "WHEN exit_code IS NOT NULL THEN 'failure' ELSE 'observed' END AS status FROM inst"),
        ("nodes", f"SELECT {scope}id, any_value(pid) AS pid, "
                  "arg_max(ppid, seq) FILTER (WHERE ppid IS NOT NULL) AS ppid, "
                  "min(start_timestamp_ms) AS start_timestamp_ms, max(end_timestamp_ms) AS end_timestamp_ms, "
                  "arg_max(comm, seq) FILTER (WHERE comm IS NOT NULL) AS comm, "
                  "arg_max(command, seq) FILTER (WHERE command IS NOT NULL) AS command, "
                  "arg_max(cwd, seq) FILTER (WHERE cwd IS NOT NULL) AS cwd, "
                  "arg_max(exit_code, seq) FILTER (WHERE exit_code IS NOT NULL) AS exit_code, "
                  "arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status "
                  f"FROM noderows GROUP BY {scope}id"),
    ]


PROCESS_CTES = process_ctes()

AUDIT = """SELECT 'audit-' || seq AS id, seq, timestamp_ms, 'process' AS audit_type, pid, comm,
        CASE WHEN event = 'EXEC' THEN 'exec' ELSE 'exit' END AS action, filename AS target,
        CASE WHEN event = 'EXEC' THEN 'observed' WHEN exit_code = 0 THEN 'success'
             WHEN exit_code IS NOT NULL THEN 'failure' ELSE 'observed' END AS status
    FROM canon WHERE event IN ('EXEC', 'EXIT')
    UNION ALL
    SELECT 'audit-' || seq, seq, timestamp_ms, 'file', pid, comm, 'write', path, 'observed'
    FROM canon WHERE event = 'FILE_OPEN'
      AND ((coalesce(flags, 0) & 3) <> 0 OR (coalesce(flags, 0) & (64 | 512 | 1024)) <> 0)
    UNION ALL
    SELECT 'audit-' || seq, seq, timestamp_ms, 'network', pid, comm, event, host, 'observed'
    FROM canon WHERE starts_with(event, 'NET_')"""


# J6 over process nodes: the latest-starting candidate that lies before the child in (start, id).
def parent_ctes(scope: str = "") -> list[tuple[str, str]]:
    same = "".join(f" AND n.{c.strip()} = c.{c.strip()}" for c in scope.split(",") if c.strip())
    mine = "".join(f"c.{c.strip()}, " for c in scope.split(",") if c.strip())
    return [
        ("child", f"SELECT {scope}id AS child_id, ppid AS pid, coalesce(start_timestamp_ms, 0) AS ts FROM nodes WHERE ppid IS NOT NULL"),
        ("pc", f"SELECT {mine}c.child_id, n.id AS parent_id, coalesce(n.start_timestamp_ms, 0) AS s, "
               f"n.start_timestamp_ms IS NOT NULL AS hs FROM child c JOIN nodes n ON n.pid = c.pid{same} "
               "AND (coalesce(n.start_timestamp_ms, 0), n.id) < (c.ts, c.child_id) "
               "AND (n.end_timestamp_ms IS NULL OR c.ts <= n.end_timestamp_ms)"),
        ("pedges", f"SELECT {scope}child_id, parent_id FROM pc QUALIFY row_number() OVER "
                   f"(PARTITION BY {scope}child_id ORDER BY s DESC, hs DESC, parent_id DESC) = 1"),
    ]
