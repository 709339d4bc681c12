"""Correlation and findings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as C
from ..operators import process as P
from ..operators import tokens as T
from ..sources import fixtures as FX
from .registry import register
from .sql_common import AUDIT, EFF, PROCESS_CTES

W = FX.with_fixtures


def _prompt_sides(spark, sf):
    """Local transcript prompts and their TLS-captured copies (a third of the
    user turns, ASCII-uppercased on even turns, shifted -5..+14 s, pid missing
    for every fifth conversation)."""
    log = FX.session_log(spark, sf).where(F.col("kind") == "prompt")
    model = F.format_string("model-%d", F.col("conv_id") % 3)
    local = log.select(F.format_string("local-%d-%d", "conv_id", "position").alias("id"),
                       "conv_id", "position", "timestamp_ms", model.alias("model"),
                       F.when(F.col("conv_id") % 6 == 1, (F.col("conv_id") + 1) % 7)
                        .otherwise(F.col("conv_id") % 7).alias("pid"), "text")
    ssl = (log.where((F.col("conv_id") + F.col("position")) % 3 == 0)
           .select(model.alias("model"),
                   F.when(F.col("conv_id") % 5 == 0, F.lit(None).cast("bigint"))
                    .otherwise(F.col("conv_id") % 7).alias("pid"),
                   (F.col("timestamp_ms") + (F.char_length("text") % 20) * 1000 - 5000).alias("timestamp_ms"),
                   F.when(F.col("position") % 2 == 0, F.translate("text", C.LOWER, C.UPPER))
                    .otherwise(F.col("text")).alias("text")))
    return ssl, local


def _clean_sql(x):
    t = f"regexp_replace(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'), '^ | $', '', 'g')"
    t = (f"(CASE WHEN starts_with({t}, '<session>') AND ends_with({t}, '</session>') AND length({t}) >= 19 "
         f"THEN regexp_extract({t}, '^<session>(.*)</session>$', 1) ELSE {t} END)")
    t = f"regexp_replace({t}, '^ +| +$', '', 'g')"
    return f"nullif({t}, '')"


_KEY = lambda x: f"translate({_clean_sql(x)}, '{C.UPPER}', '{C.LOWER}')"


@register("j13_dedup_prompts", W(["session_log"], f"""
    SELECT l.id, l.conv_id, l.position, l.timestamp_ms, l.model, l.pid, l.text FROM loc l
    WHERE NOT EXISTS (SELECT 1 FROM ssl s WHERE s.model = l.model AND {_KEY('s.text')} = {_KEY('l.text')}
        AND abs(l.timestamp_ms - s.timestamp_ms) <= 10000
        AND (l.pid IS NULL OR s.pid IS NULL OR l.pid = s.pid))""", [
    ("loc", "SELECT 'local-' || conv_id || '-' || position AS id, conv_id, position, timestamp_ms, "
            "'model-' || (conv_id % 3) AS model, CASE WHEN conv_id % 6 = 1 THEN (conv_id + 1) % 7 ELSE conv_id % 7 END AS pid, "
            "text FROM session_log WHERE kind = 'prompt'"),
    ("ssl", f"SELECT 'model-' || (conv_id % 3) AS model, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 7 END AS pid, "
            "timestamp_ms + (length(text) % 20) * 1000 - 5000 AS timestamp_ms, "
            f"CASE WHEN position % 2 = 0 THEN translate(text, '{C.LOWER}', '{C.UPPER}') ELSE text END AS text "
            "FROM session_log WHERE kind = 'prompt' AND (conv_id + position) % 3 = 0")]))
def j13_dedup_prompts(spark, sf):
    ssl, local = _prompt_sides(spark, sf)
    return C.dedup_prompts(ssl, local)


_SENS = " OR ".join(f"contains(coalesce(path, ''), '{p}')" for p in C.SENSITIVE_PATHS)


@register("j15_detect_exfiltration", W(["canon"], f"""
    SELECT l.session_id, l.last_sensitive_ms, l.sensitive_accesses, count(*) AS network_after,
        min(n.timestamp_ms) AS first_network_after_ms
    FROM (SELECT 's-' || pid AS session_id, max(timestamp_ms) AS last_sensitive_ms, count(*) AS sensitive_accesses
          FROM canon WHERE event = 'FILE_OPEN' AND ({_SENS}) GROUP BY 1) l
    JOIN (SELECT 's-' || pid AS session_id, timestamp_ms FROM canon WHERE event = 'NET_CONNECT') n
      ON l.session_id = n.session_id AND n.timestamp_ms > l.last_sensitive_ms
    GROUP BY 1, 2, 3"""))
def j15_detect_exfiltration(spark, sf):
    c = FX.canonical_events(spark, sf).withColumn("session_id", F.format_string("s-%d", "pid"))
    return C.detect_exfiltration(c.where(F.col("event") == "FILE_OPEN"), c.where(F.col("event") == "NET_CONNECT"))


def _calls_with_response(spark, sf):
    c = FX.llm_calls(spark, sf)
    return c.select("session_id", "seq", "start_timestamp_ms",
                    F.when(F.col("status_code") >= 400, F.format_string("Error: HTTP %d", "status_code"))
                     .otherwise(F.lit("ok")).alias("response"),
                    F.expr("(end_timestamp_ms - start_timestamp_ms) div 10").alias("total_tokens"))


_LOOPS_SQL = """SELECT session_id, count(*) FILTER (WHERE e) AS loop_count,
        CAST(sum(CASE WHEN e THEN total_tokens ELSE 0 END) AS BIGINT) AS total_tokens_wasted
    FROM (SELECT *, contains(lower(coalesce(response, '')), 'error') AS e FROM (
        SELECT session_id, seq, start_timestamp_ms,
            CASE WHEN status_code >= 400 THEN 'Error: HTTP ' || status_code ELSE 'ok' END AS response,
            (end_timestamp_ms - start_timestamp_ms) // 10 AS total_tokens
        FROM llm_calls QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY start_timestamp_ms DESC, seq DESC) <= 10))
    GROUP BY session_id
    HAVING count(*) >= 3 AND count(*) FILTER (WHERE e) >= 3 AND count(DISTINCT CASE WHEN e THEN response END) = 1"""


@register("a28_reasoning_loops", W(["llm_calls"], _LOOPS_SQL))
def a28_reasoning_loops(spark, sf):
    return C.detect_reasoning_loops(_calls_with_response(spark, sf), window=10, min_errors=3)


@register("a29_risk_score", W(["token_usage", "llm_calls", "canon"], f"""
    SELECT s.session_id, l.session_id IS NOT NULL AS reasoning_loop, x.session_id IS NOT NULL AS data_exfiltration,
        CAST(coalesce(t.tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(a.actions, 0) AS BIGINT) AS actions,
        (CASE WHEN l.session_id IS NOT NULL THEN 3 ELSE 0 END) + (CASE WHEN x.session_id IS NOT NULL THEN 5 ELSE 0 END)
        + (CASE WHEN coalesce(t.tokens, 0) > 10000 THEN 2 ELSE 0 END)
        + (CASE WHEN coalesce(a.actions, 0) > 1000 THEN 1 ELSE 0 END) AS risk_score
    FROM (SELECT DISTINCT 's-' || pid AS session_id FROM canon) s
    LEFT JOIN loops l ON s.session_id = l.session_id
    LEFT JOIN (SELECT DISTINCT l2.session_id FROM
        (SELECT 's-' || pid AS session_id, max(timestamp_ms) AS m FROM canon WHERE event = 'FILE_OPEN' AND ({_SENS}) GROUP BY 1) l2
        JOIN (SELECT 's-' || pid AS session_id, timestamp_ms FROM canon WHERE event = 'NET_CONNECT') n
        ON l2.session_id = n.session_id AND n.timestamp_ms > l2.m) x ON s.session_id = x.session_id
    LEFT JOIN (SELECT 's-' || pid AS session_id, sum(total_tokens) AS tokens FROM eff GROUP BY 1) t
        ON s.session_id = t.session_id
    LEFT JOIN (SELECT 's-' || pid AS session_id, count(*) AS actions FROM audit GROUP BY 1) a
        ON s.session_id = a.session_id""", [("eff", EFF), ("audit", AUDIT), ("loops", _LOOPS_SQL)]))
def a29_risk_score(spark, sf):
    canon = FX.canonical_events(spark, sf).withColumn("session_id", F.format_string("s-%d", "pid"))
    loops = C.detect_reasoning_loops(_calls_with_response(spark, sf))
    exfil = C.detect_exfiltration(canon.where(F.col("event") == "FILE_OPEN"),
                                  canon.where(F.col("event") == "NET_CONNECT"))
    tokens = (T.effective_tokens(FX.token_usage(spark, sf))
              .groupBy(F.format_string("s-%d", "pid").alias("session_id"))
              .agg(F.sum("total_tokens").alias("tokens")))
    audit = P.audit_from_events(FX.canonical_events(spark, sf))
    actions = (audit.groupBy(F.format_string("s-%d", "pid").alias("session_id"))
               .agg(F.count(F.lit(1)).alias("actions")))
    return C.risk_score(canon, loops, exfil, tokens, actions)


@register("a34_friction_findings", W(["canon", "resource_samples"], """
    SELECT 'process_failure' AS finding, 'medium' AS severity, pid, count(*) AS evidence_count, 'non-zero exits' AS detail
    FROM audit WHERE audit_type = 'process' AND status = 'failure' GROUP BY pid HAVING count(*) >= 1
    UNION ALL
    SELECT 'long_running_process', 'low', pid, count(*), 'max ' || max(end_timestamp_ms - start_timestamp_ms) || ' ms'
    FROM nodes WHERE end_timestamp_ms - start_timestamp_ms > 604800000 GROUP BY pid
    UNION ALL
    SELECT 'file_scope_risk', 'high', pid, count(*), min(target)
    FROM audit WHERE audit_type = 'file' AND NOT starts_with(target, '/repo/') GROUP BY pid
    UNION ALL
    SELECT 'network_scope_risk', 'medium', pid, count(DISTINCT target), 'distinct hosts'
    FROM audit WHERE audit_type = 'network' GROUP BY pid HAVING count(DISTINCT target) > 15
    UNION ALL
    SELECT 'resource_waste', 'low', pid, count(*), printf('peak cpu %.2f', max(cpu_percent))
    FROM resource_samples WHERE cpu_percent > 400.0 GROUP BY pid""", [("audit", AUDIT)] + PROCESS_CTES))
def a34_friction_findings(spark, sf):
    canon = FX.canonical_events(spark, sf)
    return C.friction_findings(P.audit_from_events(canon), P.process_nodes(canon), FX.resource_samples(spark, sf))


# ---- J14 / A27 / X21 / X22 -----------------------------------------------------

from ..operators import family as FM  # noqa: E402


def _interactions(spark, sf):
    c = FX.canonical_events(spark, sf)
    k = F.col("k")
    text = F.format_string("I will run `cat /repo/d%d/f%d.py` and check h%d.example.com/api",
                           k % 10, (k * 7) % 100, k % 20)
    return c.where(F.col("event") == "LLM_REQUEST").select(
        F.col("seq").alias("interaction_id"), "pid", (F.col("timestamp_ms") + k * 10).alias("response_ts"),
        C.extract_references(text).alias("refs"))


def _actions(spark, sf):
    c = FX.canonical_events(spark, sf).where(F.col("kind").isin("process", "file", "network"))
    args = F.filter(F.array("filename", "path"), lambda a: a.isNotNull())
    return c.select(F.col("seq").alias("action_id"), "pid", "timestamp_ms", args.alias("args"),
                    F.concat(args, F.array("comm")).alias("score_args"))


def _correlate(spark, sf, totals=False):
    inter = _interactions(spark, sf)
    procs = FX.proc_samples(spark, sf).select("pid", "ppid").distinct()
    related = FM.related_pids(procs, inter.select("pid"))
    return C.correlate(inter, _actions(spark, sf), related, 500, totals)


def _refs_sql(text):
    pats = C.FILE_PATTERNS + C.COMMAND_PATTERNS + C.URL_PATTERNS
    found = " || ".join("regexp_extract_all(" + text + ", '" + p.replace("'", "''") + "', 1)" for p in pats)
    cls = "[" + C.STRIP_CHARS.replace("'", "''") + "]"
    return (f"list_sort(list_distinct(list_filter(list_transform({found}, "
            f"lambda r: regexp_replace(r, '^{cls}+|{cls}+$', '', 'g')), lambda r: length(r) > 2)))")


def _halves_sql(refs, args):
    t = f"array_to_string({args}, ' ')"
    per = (f"list_transform({refs}, lambda r: CASE WHEN contains({t}, r) THEN 2 "
           f"WHEN len(list_filter({args}, lambda a: contains(a, r) OR contains(r, a))) > 0 THEN 1 ELSE 0 END)")
    return f"(CASE WHEN len({args}) > 0 THEN coalesce(list_sum({per}), 0) ELSE 0 END)"


def _score_sql(refs, args):
    t = f"array_to_string({args}, ' ')"
    per = (f"list_transform({refs}, lambda r: CASE WHEN contains({t}, r) THEN 1.0 "
           f"WHEN len(list_filter({args}, lambda a: contains(a, r) OR contains(r, a))) > 0 THEN 0.5 ELSE 0.0 END)")
    return f"(CASE WHEN len({refs}) > 0 AND len({args}) > 0 THEN list_sum({per}) / len({refs}) ELSE 0.0 END)"


_J14_SQL = [
    ("procs", "SELECT DISTINCT pid, ppid FROM proc_samples"),
    ("edges", "SELECT DISTINCT pid, ppid FROM procs WHERE ppid IS NOT NULL AND ppid <> pid"),
    ("up", "SELECT pid, ppid AS anc, 1 AS depth FROM edges UNION ALL "
           "SELECT up.pid, e.ppid, up.depth + 1 FROM up JOIN edges e ON up.anc = e.pid"),
    ("inter", f"""SELECT seq AS interaction_id, pid, timestamp_ms + k * 10 AS response_ts,
        {_refs_sql("'I will run `cat /repo/d' || (k % 10) || '/f' || ((k * 7) % 100) || '.py` and check h' || (k % 20) || '.example.com/api'")} AS refs
        FROM canon WHERE event = 'LLM_REQUEST'"""),
    ("targets", "SELECT DISTINCT pid FROM inter"),
    ("related", """SELECT DISTINCT target, related_pid FROM (
        SELECT pid AS target, pid AS related_pid FROM targets
        UNION ALL SELECT t.pid, e.ppid FROM targets t JOIN edges e ON t.pid = e.pid
        UNION ALL SELECT t.pid, up.pid FROM targets t JOIN up ON up.anc = t.pid
        UNION ALL SELECT t.pid, s.pid FROM targets t JOIN edges p ON t.pid = p.pid JOIN edges s ON s.ppid = p.ppid
            WHERE s.pid <> t.pid)"""),
    ("acts", """SELECT seq AS action_id, pid, timestamp_ms, list_filter([filename, path], lambda a: a IS NOT NULL) AS args,
        list_concat(list_filter([filename, path], lambda a: a IS NOT NULL), [comm]) AS score_args
        FROM canon WHERE kind IN ('process', 'file', 'network')"""),
    # brute force over distinct strings: every (ref, arg) with containment either way
    ("dref", "SELECT DISTINCT unnest(refs) AS ref FROM inter"),
    ("darg", "SELECT DISTINCT unnest(args) AS arg FROM acts"),
    ("cp", "SELECT ref, arg FROM dref, darg WHERE length(arg) > 0 AND (contains(arg, ref) OR contains(ref, arg))"),
    ("cand", """SELECT DISTINCT i.interaction_id, a.action_id FROM (SELECT interaction_id, unnest(refs) AS ref FROM inter) i
        JOIN cp ON i.ref = cp.ref JOIN (SELECT action_id, unnest(args) AS arg FROM acts) a ON a.arg = cp.arg
        UNION SELECT i.interaction_id, a.action_id FROM inter i JOIN acts a
            ON a.timestamp_ms >= i.response_ts AND a.timestamp_ms <= i.response_ts + 500
        UNION SELECT i.interaction_id, a.action_id FROM inter i JOIN related r ON r.target = i.pid
            JOIN acts a ON a.pid = r.related_pid"""),
    ("pairs", f"""SELECT * FROM (
        SELECT c.interaction_id, c.action_id,
            a.timestamp_ms >= i.response_ts AND a.timestamp_ms <= i.response_ts + 500 AS in_window,
            EXISTS (SELECT 1 FROM related r WHERE r.target = i.pid AND r.related_pid = a.pid) AS in_tree,
            {_score_sql('i.refs', 'a.args')} > 0.3 AS arg_match,
            CAST(greatest(0, 500 - abs(a.timestamp_ms - i.response_ts)) AS BIGINT) AS temporal_num,
            CAST({_halves_sql('i.refs', 'a.score_args')} AS BIGINT) AS arg_halves, CAST(len(i.refs) AS BIGINT) AS n_refs,
            round(greatest(0, 500 - abs(a.timestamp_ms - i.response_ts)) / 500, 6) AS temporal_score,
            round({_score_sql('i.refs', 'a.score_args')}, 6) AS argument_score
        FROM cand c JOIN inter i ON c.interaction_id = i.interaction_id JOIN acts a ON c.action_id = a.action_id)
        WHERE in_window OR in_tree OR arg_match"""),
]


@register("x21_extract_references", W(["canon"], "SELECT interaction_id, pid, response_ts, refs FROM inter",
                                      _J14_SQL[3:4]))
def x21_extract_references(spark, sf):
    return _interactions(spark, sf)


@register("j14_correlate", W(["canon", "proc_samples"], "SELECT * FROM pairs", _J14_SQL, recursive=True))
def j14_correlate(spark, sf):
    return _correlate(spark, sf)


@register("a27_score_correlations", W(["canon", "proc_samples"], """
    SELECT interaction_id, count(*) AS related_actions,
        round((0.3 * (sum(temporal_num) / 500) + 0.3 * count(*) FILTER (WHERE in_tree)
               + 0.4 * (CASE WHEN max(n_refs) > 0 THEN sum(arg_halves) / (2 * max(n_refs)) ELSE 0.0 END)) / count(*), 6)
            AS correlation_score,
        count(*) FILTER (WHERE in_tree) AS process_matches, count(*) FILTER (WHERE in_window) AS temporal_matches,
        count(*) FILTER (WHERE arg_match) AS argument_matches,
        CASE WHEN count(*) FILTER (WHERE arg_match) > 0 THEN 'argument_matching'
             WHEN count(*) FILTER (WHERE in_window) > count(*) FILTER (WHERE in_tree) THEN 'temporal_proximity'
             ELSE 'process_lineage' END AS correlation_type
    FROM pairs GROUP BY interaction_id""", _J14_SQL, recursive=True))
def a27_score_correlations(spark, sf):
    return C.score_correlations(_correlate(spark, sf, totals=True))


# ---- F14: prompts from codex exec command lines ---------------------------------------

def _exec_audit(spark, sf):
    c = FX.read_table(spark, sf, "conversations").where(F.col("role") == "user")
    conv, t = F.col("conv_id"), F.col("turn")
    target = F.when(conv % 9 == 0, F.lit("/opt/node_modules/codex")).when(conv % 3 == 0, F.lit("/usr/local/bin/codex")) \
        .otherwise(F.lit("/usr/bin/claude"))
    opts = F.when(t % 4 == 0, F.lit("--json -m gpt-5 ")).when(t % 4 == 1, F.lit("--skip-git-repo-check ")) \
        .when(t % 4 == 2, F.lit("-C /repo --ephemeral ")).otherwise(F.lit("--unknown "))
    full = F.concat(F.lit("codex exec "), opts, F.lit("\""), F.col("text"), F.lit("\""))
    return c.select((F.lit(FX.EPOCH_2024_MS) + conv * 3600000 + t * 60000).alias("timestamp_ms"),
                    F.lit("process").alias("audit_type"), F.lit("exec").alias("action"), (conv % 7).alias("pid"),
                    F.lit("codex").alias("comm"), target.alias("target"), full.alias("full_command"))


@register("f14_exec_prompts", W([], f"""
    SELECT 'audit-codex-exec-prompt-' || timestamp_ms || '-' || pid AS id, timestamp_ms, 'llm' AS audit_type, pid, comm,
        'request' AS action, target, 'observed' AS status, text_content, 'local' AS prompt_source FROM (
        SELECT *, CASE WHEN NOT starts_with(args, '-') THEN {_clean_sql("regexp_replace(args, '^[''\\\"]+|[''\\\"]+$', '', 'g')")} END AS text_content
        FROM (SELECT *, regexp_replace(ltrim(regexp_replace(trim(after), '{C._OPTS_RE}', '')), '^\\s+', '') AS args
              FROM (SELECT *, CASE WHEN strpos(full_command, ' exec ') > 0 THEN substr(full_command, strpos(full_command, ' exec ') + 6) END AS after
                    FROM (SELECT {FX.EPOCH_2024_MS} + conv_id * 3600000 + turn * 60000 AS timestamp_ms, conv_id % 7 AS pid, 'codex' AS comm,
                            CASE WHEN conv_id % 9 = 0 THEN '/opt/node_modules/codex' WHEN conv_id % 3 = 0 THEN '/usr/local/bin/codex'
                                 ELSE '/usr/bin/claude' END AS target,
                            'codex exec ' || CASE turn % 4 WHEN 0 THEN '--json -m gpt-5 ' WHEN 1 THEN '--skip-git-repo-check '
                                 WHEN 2 THEN '-C /repo --ephemeral ' ELSE '--unknown ' END || '"' || text || '"' AS full_command
                          FROM conversations WHERE role = 'user')
                    WHERE string_split(target, '/')[-1] = 'codex' AND NOT contains(target, '/node_modules/'))))
    WHERE text_content IS NOT NULL"""))
def f14_exec_prompts(spark, sf):
    return C.exec_prompts(_exec_audit(spark, sf))
