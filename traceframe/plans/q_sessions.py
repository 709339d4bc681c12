"""Session-log and profile queries over the conversation transcripts
(W4, W3, P8, A9, A10, A15, A16, P4, P7, A12–A14, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as PR
from ..operators import sessions as S
from ..sources import fixtures as FX
from .registry import register

W = FX.with_fixtures

# Custom tag rules of the demo queries (KIND:TAG=REGEX), applied before presets.
RULES = ["prompt:question=\\?$", "all:greeting=(?i)^(bonjour|hallo|hola|hello)[ ,!]", "llm:numeric=[0-9]{3}"]


def _log(spark, sf):
    return S.assign_prompt_index(FX.session_log(spark, sf))


def _tagged(spark, sf):
    idx = _log(spark, sf)
    sess, ptag, llm = S.tag_log(idx, RULES, True)
    conv = F.substring_index("session_id", "-", -1).cast("bigint")
    sess = sess.select("session_id", "session_tag",
                       F.element_at(F.array(*[F.lit(c) for c in FX.COMMS]), (conv % 5 + 1).cast("int")).alias("agent"))
    llm = (llm.withColumn("model", F.format_string("vendor/model-%d", conv % 3))
           .withColumn("input_tokens", F.col("position") * 10)
           .withColumn("output_tokens", F.expr("char_length(text) div 4"))
           .withColumn("cache_tokens", F.lit(0).cast("bigint"))
           .withColumn("total_tokens", F.col("position") * 10 + F.expr("char_length(text) div 4")))
    return idx, sess, ptag, llm


# ---- oracle SQL -----------------------------------------------------------

def _clean(x):
    return f"regexp_replace(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'), '^ | $', '', 'g')"


def _sql_lit(s):
    return "'" + s.replace("'", "''") + "'"


def _tag_sql(kind, text):
    parts = []
    for rk, tag, pat in S.parse_rules(RULES):
        if rk in (kind, "all"):
            parts.append(f"WHEN regexp_matches({text}, {_sql_lit(pat)}) THEN {_sql_lit(tag)}")
    low = f"translate({text}, '{S.UPPER}', '{S.LOWER}')"
    for tag, needles in S.PRESETS:
        cond = " OR ".join(f"contains({low}, {_sql_lit(n)})" for n in needles)
        parts.append(f"WHEN {cond} THEN {_sql_lit(tag)}")
    return "CASE " + " ".join(parts) + " ELSE 'unmatched' END"


def _sf(x):
    v = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9._:/+-]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(CASE WHEN {v} = '' THEN 'unknown' ELSE {v} END)"


_COMMS = "[" + ", ".join(f"'{c}'" for c in FX.COMMS) + "]"

IDX_CTES = [
    ("firsts", "SELECT session_id, text_hash, min(position) AS first_pos FROM session_log WHERE kind = 'prompt' GROUP BY 1, 2"),
    ("pidx", "SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY first_pos) - 1 AS BIGINT) AS pi FROM firsts"),
    ("l2", "SELECT l.*, i.pi AS own FROM session_log l LEFT JOIN pidx i ON l.session_id = i.session_id "
           "AND l.text_hash = i.text_hash AND l.kind = 'prompt'"),
    ("idx", "SELECT * EXCLUDE (own), coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY position "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS prompt_index FROM l2"),
]
TAG_CTES = IDX_CTES + [
    ("dp", "SELECT session_id, prompt_index, arg_min(timestamp_ms, position) AS timestamp_ms, "
           "arg_min(text, position) AS text, arg_min(text_hash, position) AS text_hash, min(position) AS position "
           "FROM idx WHERE kind = 'prompt' GROUP BY 1, 2"),
    ("sess0", f"SELECT session_id, {_clean('string_agg(' + _clean('text') + ", ' ' ORDER BY prompt_index)")} AS st "
              "FROM dp WHERE prompt_index < 8 GROUP BY session_id"),
    ("sess", f"SELECT session_id, {_tag_sql('session', 'st')} AS session_tag, "
             f"{_COMMS}[CAST(split_part(session_id, '-', 2) AS BIGINT) % 5 + 1] AS agent FROM sess0"),
    ("ptag", f"SELECT session_id, prompt_index, position, timestamp_ms, text_hash, {_tag_sql('prompt', _clean('text'))} AS tag FROM dp"),
    ("llm", f"SELECT session_id, position, prompt_index, timestamp_ms, text, text_hash, "
            f"{_tag_sql('llm', _clean('text'))} AS tag, "
            "'vendor/model-' || (CAST(split_part(session_id, '-', 2) AS BIGINT) % 3) AS model, "
            "position * 10 AS input_tokens, length(text) // 4 AS output_tokens, CAST(0 AS BIGINT) AS cache_tokens, "
            "position * 10 + length(text) // 4 AS total_tokens FROM idx WHERE kind = 'llm'"),
]


@register("w4_prompt_index", W(["session_log"], "SELECT session_id, position, kind, text_hash, prompt_index FROM idx",
                               IDX_CTES))
def w4_prompt_index(spark, sf):
    return _log(spark, sf).select("session_id", "position", "kind", "text_hash", "prompt_index")


@register("p8_tag_prompts", W(["session_log"], "SELECT session_id, prompt_index, text_hash, tag FROM ptag", TAG_CTES))
def p8_tag_prompts(spark, sf):
    _, _, ptag, _ = _tagged(spark, sf)
    return ptag.select("session_id", "prompt_index", "text_hash", "tag")


@register("p8_tag_sessions", W(["session_log"], "SELECT session_id, session_tag, agent FROM sess", TAG_CTES))
def p8_tag_sessions(spark, sf):
    _, sess, _, _ = _tagged(spark, sf)
    return sess


_COUNTS = ("SELECT 'prompt:' || tag AS tag, count(*) AS count FROM ptag GROUP BY 1 UNION ALL "
           "SELECT 'llm:' || tag, count(*) FROM llm WHERE tag <> 'unmatched' GROUP BY 1")


@register("a15_tag_counts", W(["session_log"], _COUNTS, TAG_CTES))
def a15_tag_counts(spark, sf):
    _, _, ptag, llm = _tagged(spark, sf)
    return S.tag_counts(ptag, llm)


@register("a15_tag_totals", W(["session_log"], """
    SELECT *, round(matched_sessions * 100 / total_sessions, 4) AS sessions_coverage_pct, round(matched_prompts * 100 / total_prompts, 4) AS prompts_coverage_pct,
        round(matched_llm_calls * 100 / total_llm_calls, 4) AS llm_calls_coverage_pct FROM (
    SELECT (SELECT count(*) FROM sess) AS total_sessions,
        (SELECT count(*) FROM sess WHERE session_tag <> 'unmatched') AS matched_sessions,
        (SELECT count(*) FROM ptag) AS total_prompts,
        (SELECT count(*) FROM ptag WHERE tag <> 'unmatched') AS matched_prompts,
        (SELECT count(*) FROM llm) AS total_llm_calls,
        (SELECT count(*) FROM llm WHERE tag <> 'unmatched') AS matched_llm_calls)""", TAG_CTES))
def a15_tag_totals(spark, sf):
    _, sess, ptag, llm = _tagged(spark, sf)
    return S.tag_totals(sess, ptag, llm)


@register("a15_unmatched_samples", W(["session_log"], """
    SELECT session_id, kind, position FROM (
        SELECT session_id, 0 AS r, 'session' AS kind, NULL AS position FROM sess WHERE session_tag = 'unmatched'
        UNION ALL SELECT session_id, 1, 'prompt', position FROM ptag WHERE tag = 'unmatched'
        UNION ALL SELECT session_id, 2, 'llm', position FROM llm WHERE tag = 'unmatched')
    ORDER BY session_id, r, position LIMIT 30""", TAG_CTES))
def a15_unmatched_samples(spark, sf):
    _, sess, ptag, llm = _tagged(spark, sf)
    return S.unmatched_samples(sess, ptag, llm)


@register("a16_tag_distribution", W(["session_log"], """
    SELECT kind, count(*) AS num_tags, CAST(sum(count) AS BIGINT) AS total,
        round(sum(count) FILTER (WHERE r <= 1) / sum(count) * 100, 4) AS top1_pct,
        round(sum(count) FILTER (WHERE r <= 3) / sum(count) * 100, 4) AS top3_pct,
        round(sum(count) FILTER (WHERE r <= 5) / sum(count) * 100, 4) AS top5_pct,
        round(CASE WHEN count(*) > 1 THEN sum(-(count / t) * ln(count / t)) / ln(count(*)) ELSE 0.0 END, 6)
            AS normalized_entropy,
        concat_ws(',', CASE WHEN top1_pct > 40 THEN 'dominant' END, CASE WHEN top3_pct > 80 AND num_tags > 3 THEN 'top3' END,
            CASE WHEN num_tags < 5 THEN 'few' END, CASE WHEN num_tags > 25 THEN 'fragmented' END,
            CASE WHEN normalized_entropy < 0.5 AND num_tags > 3 THEN 'uneven' END) AS warnings
    FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, tag) AS r,
                 sum(count) OVER (PARTITION BY kind) AS t
          FROM (SELECT tag, count, split_part(tag, ':', 1) AS kind FROM counts WHERE NOT ends_with(tag, ':unmatched')))
    GROUP BY kind""", TAG_CTES + [("counts", _COUNTS)]))
def a16_tag_distribution(spark, sf):
    _, _, ptag, llm = _tagged(spark, sf)
    return S.tag_distribution(S.tag_counts(ptag, llm))


_EV = [
    ("ev", """SELECT session_id, position, timestamp_ms, 0 AS kind_rank, prompt_index, 'prompt' AS k,
                     NULL AS tag, NULL AS model FROM ptag
              UNION ALL SELECT session_id, position, timestamp_ms, 2, prompt_index, 'llm', tag, model FROM llm"""),
    ("evd", """SELECT *, CASE WHEN nxt IS NULL THEN 1 ELSE greatest((nxt - timestamp_ms) // 1000, 1) END AS duration_s
               FROM (SELECT *, lead(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms, kind_rank, position)
                     AS nxt FROM ev)"""),
]


@register("w3_event_durations", W(["session_log"], "SELECT session_id, position, kind_rank, timestamp_ms, "
                                                   "CAST(duration_s AS BIGINT) AS duration_s FROM evd",
                                  TAG_CTES + _EV))
def w3_event_durations(spark, sf):
    _, _, ptag, llm = _tagged(spark, sf)
    pe = ptag.select("session_id", "position", "timestamp_ms", F.lit(0).alias("kind_rank"))
    le = llm.select("session_id", "position", "timestamp_ms", F.lit(2).alias("kind_rank"))
    return S.event_durations(pe.unionByName(le)).select("session_id", "position", "kind_rank", "timestamp_ms",
                                                         "duration_s")


def _stack_sql(detail):
    base = (f"'project:demo;agent:' || {_sf('s.agent')} || ';session:' || {_sf('s.session_tag')} "
            f"|| ';prompt:' || {_sf('p.tag')}")
    return f"{base} || {detail}"


_TIME_STACKS = TAG_CTES + _EV + [
    ("tstacks", f"""SELECT stack, CAST(sum(greatest(duration_s, 1)) AS BIGINT) AS weight FROM (
        SELECT {_stack_sql("CASE WHEN e.k = 'prompt' THEN ';kind:prompt' ELSE ';kind:llm;call:' || " + _sf("'llm/' || e.tag") + " || ';model:' || " + _sf("string_split(e.model, '/')[-1]") + " END")} AS stack,
               e.duration_s
        FROM evd e LEFT JOIN ptag p ON e.session_id = p.session_id AND e.prompt_index = p.prompt_index
        LEFT JOIN sess s ON e.session_id = s.session_id) GROUP BY stack"""),
]

_TOKEN_STACKS = TAG_CTES + [
    ("tc", """SELECT *, CASE WHEN len(comps) > 0 THEN comps
                   WHEN total_tokens >= 1 THEN [{'kind': 'estimate', 'value': total_tokens}]
                   ELSE [{'kind': 'unknown', 'value': CAST(1 AS BIGINT)}] END AS cs
              FROM (SELECT *, list_filter([{'kind': 'input', 'value': CAST(input_tokens AS BIGINT)},
                                           {'kind': 'output', 'value': CAST(output_tokens AS BIGINT)},
                                           {'kind': 'cache', 'value': CAST(cache_tokens AS BIGINT)}],
                                          lambda c: c.value >= 1) AS comps FROM llm)"""),
    ("kstacks", f"""SELECT stack, CAST(sum(greatest(w, 1)) AS BIGINT) AS weight FROM (
        SELECT {_stack_sql("';call:' || " + _sf("'llm/' || e.tag") + " || ';model:' || " + _sf("string_split(e.model, '/')[-1]") + " || ';kind:' || " + _sf("c.kind"))} AS stack,
               c.value AS w
        FROM (SELECT *, unnest(cs) AS c FROM tc) e
        LEFT JOIN ptag p ON e.session_id = p.session_id AND e.prompt_index = p.prompt_index
        LEFT JOIN sess s ON e.session_id = s.session_id) WHERE w <> 0 GROUP BY stack"""),
]


def _time_stacks(spark, sf):
    _, sess, ptag, llm = _tagged(spark, sf)
    return PR.fold_stacks(PR.time_profile_samples(sess, ptag, llm))


def _token_stacks(spark, sf):
    _, sess, ptag, llm = _tagged(spark, sf)
    return PR.fold_stacks(PR.token_profile_samples(sess, ptag, llm))


register("a12_time_stacks", W(["session_log"], "SELECT * FROM tstacks", _TIME_STACKS))(_time_stacks)
register("a12_token_stacks", W(["session_log"], "SELECT * FROM kstacks", _TOKEN_STACKS))(_token_stacks)


@register("a13_stack_summary", W(["session_log"], """
    SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) AS total_weight, count(*) AS unique_stacks,
        coalesce(round(sum(weight) / count(*), 3), 0.0) AS compression_ratio,
        CAST(coalesce(max(weight), 0) AS BIGINT) AS max_stack_reuse FROM tstacks""", _TIME_STACKS))
def a13_stack_summary(spark, sf):
    return PR.stack_summary(_time_stacks(spark, sf))


@register("a13_top_stacks", W(["session_log"], "SELECT * FROM kstacks ORDER BY weight DESC, stack LIMIT 10",
                              _TOKEN_STACKS))
def a13_top_stacks(spark, sf):
    return PR.top_stacks(_token_stacks(spark, sf), 10)


@register("a14_flame_tree", W(["session_log"], """
    SELECT node, any_value(depth) AS depth, CAST(sum(weight) AS BIGINT) AS value FROM (
        SELECT array_to_string(f[1:i], ';') AS node, i AS depth, weight
        FROM (SELECT list_filter(string_split(stack, ';'), lambda x: x <> '') AS f, weight FROM tstacks WHERE weight <> 0),
             LATERAL (SELECT unnest(range(1, len(f) + 1)) AS i))
    GROUP BY node""", _TIME_STACKS))
def a14_flame_tree(spark, sf):
    return PR.flame_tree(_time_stacks(spark, sf)).select("node", F.col("depth").cast("bigint").alias("depth"), "value")


@register("s14_folded_lines", W(["session_log"], "SELECT stack || ' ' || weight AS line FROM kstacks ORDER BY line",
                                _TOKEN_STACKS))
def s14_folded_lines(spark, sf):
    return PR.folded_lines(_token_stacks(spark, sf))


@register("a10_dedup_usage", W(["session_log"], """
    SELECT session_id, text_hash, position, prompt_index, total_tokens FROM llm
    QUALIFY row_number() OVER (PARTITION BY session_id, text_hash ORDER BY position) = 1""", TAG_CTES))
def a10_dedup_usage(spark, sf):
    _, _, _, llm = _tagged(spark, sf)
    return S.dedup_usage(llm.select("session_id", "text_hash", "position", "prompt_index", "total_tokens"))


@register("a9_session_rollup", W(["session_log"], """
    SELECT session_id, min(timestamp_ms) AS start_timestamp_ms, max(timestamp_ms) AS end_timestamp_ms,
        count(*) FILTER (WHERE kind = 'prompt') AS prompts, count(*) FILTER (WHERE kind = 'llm') AS responses,
        count(DISTINCT CASE WHEN kind = 'prompt' THEN text_hash END) AS distinct_prompts,
        arg_min(text_hash, position) FILTER (WHERE kind = 'prompt') AS first_prompt_hash,
        arg_max(text_hash, position) AS last_message_hash
    FROM idx GROUP BY session_id
    HAVING count(*) FILTER (WHERE kind = 'prompt') + count(*) FILTER (WHERE kind = 'llm') > 0""", IDX_CTES))
def a9_session_rollup(spark, sf):
    return S.session_rollup(_log(spark, sf))


# ---- P1: transcripts (JSONL) → prompts, tools, responses --------------------

from ..operators import sessionlog as SL  # noqa: E402
from .q_correlate import _clean_sql  # noqa: E402


def _p1(spark, sf):
    return SL.session_events(FX.session_jsonl(spark, sf))


_WRAP = "[" + ", ".join(f"'{w}'" for w in SL.WRAPPERS) + "]"


def _words(xs):
    return "[" + ", ".join(f"'{w}'" for w in xs) + "]"


_BASENAME = f"""coalesce(nullif(CASE WHEN len(parts) = 0 THEN NULL ELSE base[
        [i FOR i IN range(1, len(parts) + 1) IF NOT list_contains({_WRAP}, base[i])
            AND NOT (starts_with(parts[i], '-') AND i > 1 AND list_contains({_WRAP}, base[greatest(i - 1, 1)]))][1]] END, ''), 'none')"""

_P1_SQL = [
    ("p", """SELECT file, line_no, line, line->>'$.type' AS type, coalesce(line->>'$.sessionId', file) AS session_id,
            epoch_ms(CAST(line->>'$.timestamp' AS TIMESTAMPTZ)) AS timestamp_ms,
            json_type(line, '$.message.content') AS ct FROM session_jsonl WHERE json_valid(line)"""),
    ("blocks", """SELECT *, json_extract(line, '$.message.content[' || block_no || ']') AS b FROM (
            SELECT *, unnest(range(CAST(json_array_length(line, '$.message.content') AS BIGINT))) AS block_no
            FROM p WHERE ct = 'ARRAY')"""),
    ("prompt_raw", """SELECT session_id, line_no, timestamp_ms, line->>'$.message.content' AS raw_text FROM p
            WHERE type = 'user' AND ct = 'VARCHAR'
            UNION ALL
            SELECT session_id, line_no, timestamp_ms, string_agg(b->>'$.text', chr(10) ORDER BY block_no)
            FROM blocks WHERE type = 'user' AND b->>'$.type' = 'text' GROUP BY session_id, line_no, timestamp_ms"""),
    ("prompts", f"""SELECT session_id, line_no AS position, timestamp_ms, text, left(sha256(text), 12) AS text_hash
            FROM (SELECT *, {_clean_sql('raw_text')} AS text FROM prompt_raw) WHERE text IS NOT NULL"""),
    ("results", """SELECT session_id, call_id, arg_max(is_error, result_line) AS is_error FROM (
            SELECT session_id, line_no AS result_line, b->>'$.tool_use_id' AS call_id,
                coalesce(TRY_CAST(line->>'$.toolUseResult.is_error' AS BOOLEAN), TRY_CAST(b->>'$.is_error' AS BOOLEAN), false) AS is_error
            FROM blocks WHERE type = 'user' AND b->>'$.type' = 'tool_result') GROUP BY session_id, call_id"""),
    ("tools0", """SELECT session_id, line_no AS position, timestamp_ms, b->>'$.name' AS tool_name, b->>'$.id' AS call_id,
            coalesce(nullif(b->>'$.input.cmd', ''), nullif(b->>'$.input.command', ''), 'search ' || nullif(b->>'$.input.pattern', ''),
                     nullif(b->>'$.input.file_path', ''), nullif(b->>'$.input.path', ''), nullif(b->>'$.input.text', ''),
                     (b->'$.input')::VARCHAR, '') AS command
            FROM blocks WHERE type = 'assistant' AND b->>'$.type' = 'tool_use'"""),
    ("tools1", f"""SELECT t.*, CASE WHEN r.is_error IS NULL THEN 'observed' WHEN r.is_error THEN 'fail' ELSE 'ok' END AS status,
            translate(coalesce(tool_name, ''), '{S.UPPER}', '{S.LOWER}') AS n,
            translate(command, '{S.UPPER}', '{S.LOWER}') AS lt,
            list_filter(string_split_regex(command, '\\s+'), lambda y: y <> '') AS parts
            FROM tools0 t LEFT JOIN results r ON t.session_id = r.session_id AND t.call_id = r.call_id"""),
    ("tools2", f"""SELECT *, list_transform(parts, lambda q: string_split(q, '/')[-1]) AS base FROM tools1"""),
    ("tools3", f"""SELECT *, {_BASENAME} AS cmd_name,
            CASE WHEN ends_with(n, 'exec_command') OR n IN ('bash') THEN 'shell'
                 WHEN n IN {tuple(SL.EDIT_TOOLS)} THEN 'edit' WHEN n IN {tuple(SL.READ_TOOLS)} THEN 'read'
                 WHEN contains(n, 'web') OR contains(n, 'browser') OR contains(n, 'search') OR contains(command, 'http') THEN 'network'
                 WHEN contains(n, 'plan') OR contains(n, 'todo') THEN 'plan'
                 WHEN contains(n, 'task') OR contains(n, 'agent') THEN 'subagent' ELSE 'tool' END AS category
            FROM tools2"""),
    ("tools3b", f"""SELECT *, list_sort(list_distinct(list_concat(
            list_filter(list_transform(list_filter(string_split_regex(command, '[\\s"''()]+'),
                lambda p: starts_with(p, 'https://') OR starts_with(p, 'http://')),
                lambda p: translate(split_part(regexp_replace(p, '^https?://', ''), '/', 1), '{S.UPPER}', '{S.LOWER}')),
                lambda h: h <> ''),
            list_filter(['github.com', 'crates.io', 'huggingface.co', 'hf.co', 'openai.com', 'anthropic.com'], lambda k: len(list_filter(string_split_regex(command, '[\\s"''()]+'),
                lambda p: contains(p, k))) > 0)))) AS domains FROM tools3"""),
    ("tools", f"""SELECT session_id, position, timestamp_ms, tool_name, call_id, command, status, category,
            array_to_string(domains, ',') AS domains,
            CASE WHEN category = 'shell' THEN cmd_name
                 WHEN category = 'network' AND len(domains) > 0 THEN split_part(domains[1], ':', 1)
                 ELSE coalesce(nullif(regexp_extract(translate(coalesce(tool_name, ''), '{S.UPPER}', '{S.LOWER}'), '[a-z0-9]{{2,}}', 0), ''), 'tool') END
                 AS command_name,
            CASE WHEN tool_name = 'apply_patch' OR contains(command, '*** ') THEN 'write'
                 WHEN cmd_name IN {tuple(SL.TEST_CMDS)} AND list_has_any(string_split_regex(lt, '[^a-z0-9_]+'), {_words(SL.TEST_WORDS)}) THEN 'test'
                 WHEN cmd_name = 'git' AND list_has_any(string_split_regex(lt, '[^a-z0-9_]+'), {_words(SL.REPO_WORDS)}) THEN 'repo'
                 WHEN cmd_name IN {tuple(SL.NET_CMDS)} AND (list_has_any(string_split_regex(lt, '[^a-z0-9_]+'), {_words(SL.NET_WORDS)})
                      OR contains(lt, 'http://') OR contains(lt, 'https://')) THEN 'network'
                 WHEN cmd_name IN {tuple(SL.WRITE_CMDS)} AND ({' OR '.join(f"contains(lt, '{m}')" for m in SL.WRITE_MARKS)}) THEN 'write'
                 WHEN cmd_name IN {tuple(SL.READ_CMDS)} THEN 'read'
                 WHEN contains(lt, 'http://') OR contains(lt, 'https://') OR contains(lt, 'crates.io') OR contains(lt, 'github.com') THEN 'network'
                 ELSE 'process' END AS effect FROM tools3b"""),
    ("atext", """SELECT session_id, line_no, string_agg(b->>'$.text', chr(10) ORDER BY block_no) AS text
            FROM blocks WHERE type = 'assistant' AND b->>'$.type' = 'text' GROUP BY session_id, line_no"""),
    ("a", """SELECT p.session_id, coalesce(line->>'$.message.id', line->>'$.requestId', p.session_id || ':' || p.line_no) AS message_id,
            p.line_no, timestamp_ms, coalesce(line->>'$.message.model', 'unknown') AS model,
            coalesce(TRY_CAST(line->>'$.message.usage.input_tokens' AS BIGINT), 0) AS input_tokens,
            coalesce(TRY_CAST(line->>'$.message.usage.output_tokens' AS BIGINT), 0) AS output_tokens,
            coalesce(TRY_CAST(line->>'$.message.usage.cache_creation_input_tokens' AS BIGINT), 0)
              + coalesce(TRY_CAST(line->>'$.message.usage.cache_read_input_tokens' AS BIGINT), 0) AS cache_tokens,
            coalesce(x.text, '') AS text
            FROM p LEFT JOIN atext x ON p.session_id = x.session_id AND p.line_no = x.line_no WHERE p.type = 'assistant'"""),
    ("llm", """SELECT session_id, message_id, min(line_no) AS position, arg_min(timestamp_ms, line_no) AS timestamp_ms,
            arg_min(model, line_no) AS model, arg_min(input_tokens, line_no) AS input_tokens,
            arg_min(output_tokens, line_no) AS output_tokens, arg_min(cache_tokens, line_no) AS cache_tokens,
            left(sha256(string_agg(text, '' ORDER BY line_no)), 12) AS text_hash
            FROM a GROUP BY session_id, message_id"""),
]


@register("p1_prompts", W(["session_jsonl"], "SELECT * FROM prompts", _P1_SQL))
def p1_prompts(spark, sf):
    return _p1(spark, sf)[0]


@register("p1_tools", W(["session_jsonl"], "SELECT * FROM tools", _P1_SQL))
def p1_tools(spark, sf):
    return _p1(spark, sf)[1].select("session_id", "position", "timestamp_ms", "tool_name", "call_id", "command",
                                    "status", "category", "command_name", "effect",
                                    F.array_join("domains", ",").alias("domains"))


@register("p1_llm_responses", W(["session_jsonl"], "SELECT * FROM llm", _P1_SQL))
def p1_llm_responses(spark, sf):
    return _p1(spark, sf)[2]


@register("w12_tool_status", W(["session_jsonl"], "SELECT status, count(*) AS tools FROM tools GROUP BY status",
                               _P1_SQL))
def w12_tool_status(spark, sf):
    return _p1(spark, sf)[1].groupBy("status").agg(F.count(F.lit(1)).alias("tools"))


# ---- P1: rollout and document dialects; the oracles skip JSON and read the conversations -----

from ..operators import dialects as DI  # noqa: E402

_TOOL_SQL = [(n, q) for n, q in _P1_SQL if n in ("tools1", "tools2", "tools3", "tools3b", "tools")]
_AT = f"{FX.EPOCH_2024_MS} + conv_id * 3600000 + turn * 60000"
_RSID = ("CASE WHEN conv_id % 4 <> 3 AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user') "
         "THEN 'sess-' || conv_id ELSE 'r-' || conv_id END")
_COUNTER = "CASE WHEN turn >= 5 THEN turn * 2 ELSE turn * (turn + 1) END"
_RUSAGE = f"""'{{"input_tokens":' || ({_COUNTER}) || ',"output_tokens":' || turn || ',"total_tokens":' || (({_COUNTER}) + turn) || '}}'"""
_RLAST = ("""'{"cached_input_tokens":' || (turn % 4) || ',"input_tokens":' || (turn * 3) || ',"output_tokens":' || (conv_id % 11) """
          """|| ',"total_tokens":' || (turn * 3 + conv_id % 11) || '}'""")
_ROLLOUT_SQL = [
    ("context", "SELECT conv_id, turn * 10 AS position, 'model-' || ((conv_id + turn) % 4) AS model FROM conversations WHERE turn % 3 = 0"),
    ("said", f"""SELECT conv_id, turn * 10 + 1 AS position, {_AT} AS timestamp_ms, {_clean_sql('text')} AS text FROM conversations
            WHERE role = 'assistant' AND {_clean_sql('text')} IS NOT NULL"""),
    ("reports", f"""SELECT conv_id, turn * 10 + 4 AS position, {_AT} AS timestamp_ms, left(sha256({_RLAST}), 12) AS text_hash,
            turn * 3 AS input_tokens, conv_id % 11 AS output_tokens, turn % 4 AS cache_tokens, turn * 3 + conv_id % 11 AS total_tokens
            FROM conversations WHERE role = 'assistant' AND turn % 5 <> 4
            UNION ALL SELECT conv_id, turn * 10 + 5, {_AT}, left(sha256({_RUSAGE}), 12), {_COUNTER}, turn, 0, ({_COUNTER}) + turn
            FROM conversations WHERE role = 'assistant' AND turn % 3 = 0"""),
    ("counted", "SELECT * FROM reports WHERE total_tokens > 0"),
    ("fills", """SELECT conv_id, position, (SELECT max(s.position) FROM said s WHERE s.conv_id = r.conv_id AND s.position < r.position) AS target,
            r.* EXCLUDE (conv_id, position) FROM counted r"""),
    ("filling", "SELECT * FROM fills WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, target ORDER BY position) = 1"),
    ("answers", """SELECT s.conv_id, s.position, s.timestamp_ms, left(sha256(s.text), 12) AS text_hash,
            coalesce(f.input_tokens, 0) AS input_tokens, coalesce(f.output_tokens, 0) AS output_tokens,
            coalesce(f.cache_tokens, 0) AS cache_tokens, coalesce(f.total_tokens, 0) AS total_tokens
            FROM said s LEFT JOIN filling f ON s.conv_id = f.conv_id AND s.position = f.target
            UNION ALL SELECT conv_id, position, timestamp_ms, text_hash, input_tokens, output_tokens, cache_tokens, total_tokens FROM counted c
            WHERE NOT EXISTS (SELECT 1 FROM filling f WHERE f.conv_id = c.conv_id AND f.position = c.position)"""),
    ("ran", f"""SELECT {_RSID} AS session_id, turn * 10 + 2 AS position, {_AT} AS timestamp_ms, 'call-' || conv_id || '-' || turn AS call_id,
            CASE WHEN conv_id % 5 = 0 THEN 'plain words ' || turn
                 ELSE ['cargo test --all', 'ls -la /repo', 'git commit -m fix'][(conv_id + turn) % 3 + 1] END AS command, conv_id, turn
            FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 3 = 1"""),
    ("tools0", "SELECT session_id, position, timestamp_ms, 'exec_command' AS tool_name, call_id, command FROM ran"),
    ("results", "SELECT session_id, call_id, conv_id % 3 = 1 AS is_error FROM ran WHERE (conv_id + turn) % 7 <> 0 AND conv_id % 3 <> 2"),
    *_TOOL_SQL,
]
_TOOL_COLS = ["session_id", "position", "timestamp_ms", "tool_name", "call_id", "command", "status", "category", "command_name", "effect"]


@register("p1_rollout_prompts", f"""SELECT {_RSID} AS session_id, turn * 10 + 1 AS position, {_AT} AS timestamp_ms, {_clean_sql('text')} AS text,
    left(sha256({_clean_sql('text')}), 12) AS text_hash FROM conversations WHERE role = 'user' AND {_clean_sql('text')} IS NOT NULL""")
def p1_rollout_prompts(spark, sf):
    return DI.rollout_events(FX.rollout_jsonl(spark, sf))[0]


@register("p1_rollout_tools", W([], "SELECT * FROM tools", _ROLLOUT_SQL))
def p1_rollout_tools(spark, sf):
    return DI.rollout_events(FX.rollout_jsonl(spark, sf))[1].select(*_TOOL_COLS, F.array_join("domains", ",").alias("domains"))


@register("p1_rollout_responses", W([], f"""SELECT {_RSID} AS session_id, {_RSID} || ':' || position AS message_id, position, timestamp_ms,
    coalesce((SELECT arg_max(x.model, x.position) FROM context x WHERE x.conv_id = a.conv_id AND x.position <= a.position), 'codex') AS model,
    input_tokens, output_tokens, cache_tokens, total_tokens, text_hash FROM answers a""", _ROLLOUT_SQL))
def p1_rollout_responses(spark, sf):
    return DI.rollout_events(FX.rollout_jsonl(spark, sf))[2]


@register("p1_rollout_usage", W([], f"""
    SELECT {_RSID} AS session_id, model, arg_max(i, position) AS input_tokens, arg_max(o, position) AS output_tokens, arg_max(i + o, position) AS total_tokens,
        CAST(sum(CASE WHEN i >= bi THEN i - bi ELSE i END) AS BIGINT) AS added_input_tokens,
        CAST(sum(CASE WHEN o >= bo THEN o - bo ELSE o END) AS BIGINT) AS added_output_tokens,
        CAST(sum(CASE WHEN i + o >= bi + bo THEN i + o - bi - bo ELSE i + o END) AS BIGINT) AS added_total_tokens
    FROM (SELECT *, coalesce(lag(i) OVER w, 0) AS bi, coalesce(lag(o) OVER w, 0) AS bo FROM (
        SELECT r.conv_id, r.position, turn AS o, {_COUNTER} AS i,
            coalesce((SELECT arg_max(x.model, x.position) FROM context x WHERE x.conv_id = r.conv_id AND x.position <= r.position), 'unknown') AS model
        FROM (SELECT *, position // 10 AS turn FROM reports) r) WINDOW w AS (PARTITION BY conv_id ORDER BY position))
    GROUP BY conv_id, model""", _ROLLOUT_SQL))
def p1_rollout_usage(spark, sf):
    return DI.rollout_usage(FX.rollout_jsonl(spark, sf))


_DOC = f"""SELECT *, CASE WHEN conv_id % 5 <> 0 THEN 'doc-' || conv_id ELSE 'session-' || conv_id END AS session_id, {_AT} AS timestamp_ms,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations"""


@register("p1_document_prompts", W([], f"""SELECT session_id, position, timestamp_ms, {_clean_sql('text')} AS text,
    left(sha256({_clean_sql('text')}), 12) AS text_hash FROM d WHERE role = 'user' AND {_clean_sql('text')} IS NOT NULL""", [("d", _DOC)]))
def p1_document_prompts(spark, sf):
    return DI.document_events(FX.session_documents(spark, sf))[0]


@register("p1_document_tools", W([], "SELECT * FROM tools", [
    ("d", _DOC), ("tools0", "SELECT session_id, position, timestamp_ms, 'Read' AS tool_name, 'tc-' || conv_id || '-' || turn AS call_id, "
                  "'/repo/f' || turn || '.py' AS command FROM d WHERE role = 'assistant' AND (conv_id + turn) % 4 = 1"),
    ("results", "SELECT '' AS session_id, '' AS call_id, false AS is_error WHERE false"), *_TOOL_SQL]))
def p1_document_tools(spark, sf):
    return DI.document_events(FX.session_documents(spark, sf))[1].select(*_TOOL_COLS, F.array_join("domains", ",").alias("domains"))


@register("p1_document_responses", W([], """SELECT session_id, session_id || ':' || position AS message_id, position, timestamp_ms,
    CASE WHEN turn % 4 <> 3 THEN 'flash-' || (conv_id % 3) ELSE 'gemini' END AS model,
    CASE WHEN turn % 3 <> 2 THEN turn * 7 ELSE 0 END AS input_tokens, CASE WHEN turn % 3 <> 2 THEN conv_id % 9 ELSE 0 END AS output_tokens,
    CASE WHEN turn % 3 <> 2 THEN turn % 2 ELSE 0 END AS cache_tokens, CASE WHEN turn % 3 <> 2 THEN turn * 7 + conv_id % 9 ELSE 0 END AS total_tokens,
    left(sha256(text), 12) AS text_hash FROM d WHERE role = 'assistant' AND (trim(text) <> '' OR turn % 3 <> 2)""", [("d", _DOC)]))
def p1_document_responses(spark, sf):
    return DI.document_events(FX.session_documents(spark, sf))[2]


# ---- P7: time profile with tool calls --------------------------------------------

_P7_COMMANDS = ["sudo bash -c 'cargo test'", "ls -la"]
_P7_CHAINS = [["bash", "cargo"], ["ls"]]


def _p7_tools(llm):
    """A tool call 400 ms after each second response: shell commands, edits."""
    p = F.col("position")
    shell = p % 4 == 1
    command = F.element_at(F.array(*[F.lit(c) for c in _P7_COMMANDS]), (p % 3 % 2 + 1).cast("int"))
    return llm.where(p % 2 == 1).select(
        "session_id", "position", (F.col("timestamp_ms") + 400).alias("timestamp_ms"), "prompt_index",
        F.when(shell, "Bash").otherwise("Edit").alias("tool_name"), F.when(shell, "shell").otherwise("edit").alias("category"),
        SL.command_basename(command).alias("command_name"), SL.process_chain(command).alias("process_chain"))


_P7_FRAMES = " ".join(f"WHEN {k} THEN ';cmd:{c[0]};' || '{';'.join('proc:' + x for x in c)}'" for k, c in enumerate(_P7_CHAINS))


@register("p7_time_profile", W(["session_log"], f"""
    SELECT stack, CAST(sum(greatest(duration_s, 1)) AS BIGINT) AS weight FROM (
        SELECT {_stack_sql("CASE e.k WHEN 'prompt' THEN ';kind:prompt' WHEN 'tool' THEN e.tool ELSE ';kind:llm;call:' || "
                           + _sf("'llm/' || e.tag") + " || ';model:' || " + _sf("string_split(e.model, '/')[-1]") + " END")} AS stack, duration_s
        FROM (SELECT *, CASE WHEN nxt IS NULL THEN 1 ELSE greatest((nxt - timestamp_ms) // 1000, 1) END AS duration_s
              FROM (SELECT *, lead(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms, kind_rank, position) AS nxt FROM (
                    SELECT *, NULL AS tool FROM ev
                    UNION ALL SELECT session_id, position, timestamp_ms + 400, 1, prompt_index, 'tool', NULL, NULL,
                        CASE WHEN position % 4 = 1 THEN ';kind:tool;tool:bash' || CASE position % 3 % 2 {_P7_FRAMES} END
                             ELSE ';kind:tool;tool:edit' END FROM llm WHERE position % 2 = 1))) e
        LEFT JOIN ptag p ON e.session_id = p.session_id AND e.prompt_index = p.prompt_index
        LEFT JOIN sess s ON e.session_id = s.session_id) GROUP BY stack""", TAG_CTES + _EV))
def p7_time_profile(spark, sf):
    _, sess, ptag, llm = _tagged(spark, sf)
    return PR.fold_stacks(PR.time_profile_samples(sess, ptag, llm, tools=_p7_tools(llm)))


# ---- P9 / P10: cached and clustered tags ---------------------------------------

from ..operators import tagging as TG  # noqa: E402


@register("p9_tag_from_cache", W(["session_log"], """
    SELECT d.session_id, d.prompt_index, d.text_hash, c.tag AS cached_tag
    FROM dp d LEFT JOIN (SELECT DISTINCT ON (hash) hash, tag FROM (
        SELECT left(sha256(p.text), 12) AS hash, t.tag FROM dp p JOIN ptag t
          ON p.session_id = t.session_id AND p.prompt_index = t.prompt_index
        WHERE CAST(split_part(p.session_id, '-', 2) AS BIGINT) % 2 = 0) ORDER BY hash, tag) c
      ON left(sha256(d.text), 12) = c.hash""", TAG_CTES))
def p9_tag_from_cache(spark, sf):
    idx = _log(spark, sf)
    prompts = S.distinct_prompts(idx)
    _, _, ptag, _ = _tagged(spark, sf)
    conv = F.substring_index("session_id", "-", -1).cast("bigint")
    cache = (prompts.where(conv % 2 == 0).join(ptag.select("session_id", "prompt_index", "tag"),
                                               ["session_id", "prompt_index"])
             .select(F.substring(F.sha2("text", 256), 1, 12).alias("hash"), "tag")
             .groupBy("hash").agg(F.min("tag").alias("tag")))
    return TG.tag_from_cache(prompts, cache).select("session_id", "prompt_index", "text_hash", "cached_tag")


@register("p10_cluster_tags")
def p10_cluster_tags(spark, sf):
    prompts = S.distinct_prompts(_log(spark, sf)).select("text")
    return TG.tag_cluster(prompts, "text")


@register("w5_prompt_diffs")
def w5_prompt_diffs(spark, sf):
    """Prompts with a word a line."""
    prompts = FX.session_log(spark, sf).where(F.col("kind") == "prompt")
    return S.prompt_diffs(prompts.select("session_id", "position", F.translate("text", " ", "\n").alias("text")))


# ---- A11 / S5 over transcript sessions -----------------------------------------

def _tool_maps(spark, sf):
    tools = _p1(spark, sf)[1]
    counts = tools.groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    # one (name → count) map per session; bounded by the distinct tool names of a session
    return counts.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("tool_name", "n"))).alias("tools"))


@register("a11_session_tool_rows", W(["session_jsonl"], """
    SELECT session_id, tool_name, unnest(range(1, n + 1)) AS call_no FROM (
        SELECT session_id, tool_name, count(*) AS n FROM tools GROUP BY 1, 2)""", _P1_SQL))
def a11_session_tool_rows(spark, sf):
    return S.session_tool_rows(_tool_maps(spark, sf)).withColumn("call_no", F.col("call_no").cast("bigint"))


@register("s5_latest_sessions", W(["session_log"], """
    SELECT display_id, session_id, updated_ms, prompts FROM (
        SELECT *, row_number() OVER (PARTITION BY display_id ORDER BY updated_ms DESC, session_id DESC, prompts DESC) AS r
        FROM (SELECT 'd' || (conv_id % 40) AS display_id, session_id, max(timestamp_ms) AS updated_ms,
                     count(*) FILTER (WHERE kind = 'prompt') AS prompts FROM session_log GROUP BY conv_id, session_id))
    WHERE r = 1 ORDER BY updated_ms DESC, display_id LIMIT 25"""))
def s5_latest_sessions(spark, sf):
    log = FX.session_log(spark, sf)
    sess = (log.groupBy("conv_id", "session_id")
            .agg(F.max("timestamp_ms").alias("updated_ms"), F.count_if(F.col("kind") == "prompt").alias("prompts"))
            .select(F.format_string("d%d", F.col("conv_id") % 40).alias("display_id"), "session_id",
                    "updated_ms", "prompts"))
    return S.latest_sessions(sess, "display_id", "updated_ms", 25)


# ---- P3 / F24 --------------------------------------------------------------------

@register("f24_filter_by_prompt_tag", W(["session_log"], """
    SELECT 'llm' AS kind, l.session_id, l.position, l.prompt_index AS old_index, k.new_index
    FROM llm l JOIN (SELECT session_id, prompt_index,
            CAST(row_number() OVER (PARTITION BY session_id ORDER BY prompt_index) - 1 AS BIGINT) AS new_index
         FROM ptag WHERE tag = 'unmatched') k ON l.session_id = k.session_id AND l.prompt_index = k.prompt_index
    UNION ALL
    SELECT 'prompt', session_id, position, prompt_index, CAST(row_number() OVER (PARTITION BY session_id ORDER BY prompt_index) - 1 AS BIGINT)
    FROM ptag WHERE tag = 'unmatched'""", TAG_CTES))
def f24_filter_by_prompt_tag(spark, sf):
    _, _, ptag, llm = _tagged(spark, sf)
    kept, ch = S.filter_by_prompt_tag(ptag, llm, "unmatched")
    a = ch.select(F.lit("llm").alias("kind"), "session_id", "position", F.col("prompt_index").alias("old_index"),
                  "new_index")
    b = kept.select(F.lit("prompt").alias("kind"), "session_id", "position", F.col("prompt_index").alias("old_index"),
                    "new_index")
    return a.unionByName(b)


@register("p3_join_prompt", W(["session_log"], """
    SELECT l.session_id, l.position, l.prompt_index, coalesce(p.tag, lastp.tag) AS prompt_tag
    FROM llm l LEFT JOIN ptag p ON l.session_id = p.session_id AND l.prompt_index = p.prompt_index
    LEFT JOIN (SELECT session_id, arg_max(tag, prompt_index) AS tag FROM ptag GROUP BY session_id) lastp
      ON l.session_id = lastp.session_id""", TAG_CTES))
def p3_join_prompt(spark, sf):
    _, _, ptag, llm = _tagged(spark, sf)
    j = S.join_prompt(llm.select("session_id", "position", "prompt_index"), ptag.select("session_id", "prompt_index", "tag"))
    return j.select("session_id", "position", "prompt_index", "prompt_tag")


# ---- J10 / J11: session ↔ process matching -------------------------------------------

from ..operators import matching as MT  # noqa: E402


def _match_inputs(spark, sf):
    log = FX.session_log(spark, sf)
    c = F.col("conv_id")
    agent = F.when(c % 2 == 0, "claude").otherwise("codex")
    sess = (log.groupBy("conv_id").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))
            .select(F.format_string("c-%d", c).alias("session_id"), agent.alias("agent"),
                    F.format_string("/sessions/c-%d.jsonl", c).alias("path"), "end_ms", "start_ms",
                    F.format_string("/work/c%d", c % 5).alias("cwd"), c.alias("ord"), "conv_id"))
    procs = sess.where(F.col("conv_id") % 5 != 4).select(
        (F.col("conv_id") + 1000).alias("root_pid"), (F.col("conv_id") * 10).alias("starttime_ticks"),
        F.when(F.col("conv_id") % 7 == 3, F.when(F.col("agent") == "claude", "codex").otherwise("claude"))
         .otherwise(F.col("agent")).alias("agent"),
        (F.col("start_ms") - 1000).alias("start_ms"), F.col("cwd").alias("cwd"),
        ((F.col("conv_id") * 37) % 101 * 1000000 + F.col("conv_id")).alias("ord"))
    ev = sess.where(F.col("conv_id") % 3 != 2).select(
        (F.col("conv_id") + 1000).alias("root_pid"),
        F.when((F.col("conv_id") % 3 == 1) & (F.col("conv_id") % 2 == 1),
               F.format_string("/sessions/c-%d.jsonl", F.col("conv_id") + 1)).otherwise(F.col("path")).alias("path"),
        F.when(F.col("conv_id") % 3 == 0, "ebpf_file").otherwise("proc_fd").alias("trace"))
    return sess, procs, ev


# Greedy choice as a recursion over the ordered pairs of an agent, one at a step.
_MATCH_SQL = [
    ("sess", """SELECT conv_id, 'c-' || conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS agent,
        '/sessions/c-' || conv_id || '.jsonl' AS path, max(timestamp_ms) AS end_ms, min(timestamp_ms) AS start_ms, '/work/c' || (conv_id % 5) AS cwd
        FROM session_log GROUP BY conv_id"""),
    ("procs", """SELECT conv_id + 1000 AS root_pid, conv_id * 10 AS starttime_ticks, CASE WHEN (conv_id % 7 = 3) = (agent = 'claude') THEN 'codex' ELSE 'claude' END AS agent,
        start_ms - 1000 AS start_ms, cwd, (conv_id * 37) % 101 * 1000000 + conv_id AS p_ord FROM sess WHERE conv_id % 5 <> 4"""),
    ("evidence", """SELECT conv_id + 1000 AS root_pid, CASE WHEN conv_id % 3 = 1 AND conv_id % 2 = 1 THEN '/sessions/c-' || (conv_id + 1) || '.jsonl' ELSE path END AS path,
        CASE WHEN conv_id % 3 = 0 THEN 'ebpf_file' ELSE 'proc_fd' END AS trace FROM sess WHERE conv_id % 3 <> 2"""),
    ("pairs1", """SELECT s.agent, s.session_id, p.root_pid, p.starttime_ticks, e.trace AS evidence,
        row_number() OVER (PARTITION BY s.agent ORDER BY s.conv_id, p.p_ord) AS rn
        FROM sess s JOIN evidence e ON e.path = s.path JOIN procs p ON p.root_pid = e.root_pid AND p.agent = s.agent AND s.end_ms + 30000 >= p.start_ms"""),
    ("greedy1", """SELECT agent, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS used_s, CAST([] AS BIGINT[]) AS used_p, false AS taken FROM pairs1 WHERE rn = 1
        UNION ALL SELECT agent, rn, CASE WHEN ok THEN list_append(used_s, session_id) ELSE used_s END, CASE WHEN ok THEN list_append(used_p, root_pid) ELSE used_p END, ok
        FROM (SELECT p.*, g.used_s, g.used_p, NOT list_contains(g.used_s, p.session_id) AND NOT list_contains(g.used_p, p.root_pid) AS ok
              FROM greedy1 g JOIN pairs1 p ON p.agent = g.agent AND p.rn = g.rn + 1)"""),
    ("first", "SELECT p.* FROM pairs1 p JOIN greedy1 g ON g.agent = p.agent AND g.rn = p.rn WHERE g.taken"),
    ("pairs2", """SELECT s.agent, s.session_id, p.root_pid, p.starttime_ticks, 'recent_cwd' AS evidence,
        row_number() OVER (PARTITION BY s.agent ORDER BY abs(s.end_ms - p.start_ms), s.end_ms DESC, s.conv_id, p.p_ord) AS rn
        FROM sess s JOIN procs p ON p.agent = s.agent AND p.cwd = s.cwd AND s.end_ms + 30000 >= p.start_ms
        WHERE s.session_id NOT IN (SELECT session_id FROM first) AND p.root_pid NOT IN (SELECT root_pid FROM evidence)"""),
    ("greedy2", """SELECT agent, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS used_s, CAST([] AS BIGINT[]) AS used_p, false AS taken FROM pairs2 WHERE rn = 1
        UNION ALL SELECT agent, rn, CASE WHEN ok THEN list_append(used_s, session_id) ELSE used_s END, CASE WHEN ok THEN list_append(used_p, root_pid) ELSE used_p END, ok
        FROM (SELECT p.*, g.used_s, g.used_p, NOT list_contains(g.used_s, p.session_id) AND NOT list_contains(g.used_p, p.root_pid) AS ok
              FROM greedy2 g JOIN pairs2 p ON p.agent = g.agent AND p.rn = g.rn + 1)"""),
    ("matches", """SELECT session_id, agent, root_pid, starttime_ticks, evidence,
        CAST(CASE evidence WHEN 'ebpf_file' THEN 0.95 WHEN 'proc_fd' THEN 0.9 ELSE 0.55 END AS DOUBLE) AS confidence
        FROM (SELECT * FROM first UNION ALL SELECT p.* FROM pairs2 p JOIN greedy2 g ON g.agent = p.agent AND g.rn = p.rn WHERE g.taken)"""),
]


@register("j10_match_sessions", W(["session_log"], "SELECT * FROM matches", _MATCH_SQL, recursive=True))
def j10_match_sessions(spark, sf):
    sess, procs, ev = _match_inputs(spark, sf)
    return MT.match_sessions(sess, procs, ev)


@register("j11_sticky_bindings", W(["session_log"], """
    SELECT pid, starttime_ticks, sample_ts, evidence_path,
        last_value(evidence_path IGNORE NULLS) OVER (PARTITION BY pid, starttime_ticks ORDER BY sample_ts
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bound_path
    FROM (SELECT conv_id % 9 AS pid, (conv_id % 9) * 10 AS starttime_ticks, timestamp_ms AS sample_ts,
            CASE WHEN position % 4 = 0 THEN '/sessions/c-' || conv_id || '.jsonl' END AS evidence_path
          FROM session_log)"""))
def j11_sticky_bindings(spark, sf):
    log = FX.session_log(spark, sf)
    samples = log.select((F.col("conv_id") % 9).alias("pid"), ((F.col("conv_id") % 9) * 10).alias("starttime_ticks"),
                         F.col("timestamp_ms").alias("sample_ts"),
                         F.when(F.col("position") % 4 == 0, F.format_string("/sessions/c-%d.jsonl", "conv_id"))
                         .alias("evidence_path"))
    return MT.sticky_bindings(samples).select("pid", "starttime_ticks", "sample_ts", "evidence_path", "bound_path")


# ---- P5 / P6: file and network profiles of transcript tool events -------------------

def _tool_profile_base(spark, sf, root="/repo"):
    prompts, tools, _ = _p1(spark, sf)
    log = (prompts.select("session_id", "position", F.lit("prompt").alias("kind"), "text", "text_hash", "timestamp_ms")
           .unionByName(tools.select("session_id", "position", F.lit("tool").alias("kind"),
                                     F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("text_hash"),
                                     "timestamp_ms")))
    idx = S.assign_prompt_index(log)
    sess, ptag, _ = S.tag_log(idx.where(F.col("kind") != "tool"), RULES, True)
    t = tools.join(idx.where(F.col("kind") == "tool").select("session_id", "position", "prompt_index"),
                   ["session_id", "position"])
    t = S.join_prompt(t, ptag.select("session_id", "prompt_index", "tag")).join(sess, "session_id", "left")
    chain = F.when(F.col("category") == "shell", SL.process_chain(F.col("command")))
    return t.select(F.lit("claude").alias("agent"), F.coalesce("session_tag", F.lit("unmatched")).alias("session_tag"),
                    F.col("prompt_tag"), SL.path_groups(F.col("tool_name"), F.col("input_path"), F.col("command"),
                                                        F.lit(root)).alias("path_groups"),
                    "domains", "effect", "status", chain.alias("process_chain"))


@register("p5_file_profile_stacks")
def p5_file_profile_stacks(spark, sf):
    return PR.fold_stacks(PR.profile_files(_tool_profile_base(spark, sf)))


@register("p6_network_profile_stacks")
def p6_network_profile_stacks(spark, sf):
    return PR.fold_stacks(PR.profile_network(_tool_profile_base(spark, sf)))


# ---- S15: profile report --------------------------------------------------------------

@register("s15_profile_report", W(["session_log"], """
    SELECT json_object('view', 'time', 'unit', 'seconds',
        'summary', json_object('total_weight', (SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) FROM tstacks),
                               'unique_stacks', (SELECT count(*) FROM tstacks),
                               'compression_ratio', (SELECT coalesce(round(sum(weight) / count(*), 3), 0.0) FROM tstacks),
                               'max_stack_reuse', (SELECT CAST(coalesce(max(weight), 0) AS BIGINT) FROM tstacks)),
        'top', (SELECT list(json_object('stack', stack, 'weight', weight) ORDER BY weight DESC, stack)
                FROM (SELECT * FROM tstacks ORDER BY weight DESC, stack LIMIT 10)))::VARCHAR AS report""", _TIME_STACKS))
def s15_profile_report(spark, sf):
    return PR.profile_report(_time_stacks(spark, sf), "time", "seconds", 10)


# ---- W13: late token reports --------------------------------------------------------

def _codex_log(spark, sf):
    c = FX.read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    t, conv = F.col("turn"), F.col("conv_id")
    resp = c.select(F.format_string("c-%d", conv).alias("session_id"), (t * 10).alias("position"),
                    F.lit("response").alias("kind"), *[F.lit(0).cast("bigint").alias(x) for x in
                                                       ("input_tokens", "output_tokens", "cache_tokens", "total_tokens")])
    rep = c.select(F.format_string("c-%d", conv).alias("session_id"), F.explode(F.sequence(F.lit(1), (t % 3) + 1)).alias("j"),
                   t, conv)
    rep = rep.select("session_id", (F.col("turn") * 10 + F.col("j")).alias("position"), F.lit("report").alias("kind"),
                     (F.col("turn") * 10).cast("bigint").alias("input_tokens"), F.col("j").cast("bigint").alias("output_tokens"),
                     (F.col("conv_id") % 3).cast("bigint").alias("cache_tokens"),
                     F.when((F.col("conv_id") + F.col("j")) % 4 == 0, F.lit(0))
                      .otherwise(F.col("turn") * 10 + F.col("j") + F.col("conv_id") % 3).cast("bigint").alias("total_tokens"))
    return resp.unionByName(rep)


@register("w13_attach_token_reports", W([], """
    WITH log AS (
        SELECT 'c-' || conv_id AS session_id, turn * 10 AS position, 'response' AS kind,
            CAST(0 AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_tokens,
            CAST(0 AS BIGINT) AS total_tokens FROM conversations WHERE role = 'assistant'
        UNION ALL
        SELECT 'c-' || conv_id, turn * 10 + j, 'report', CAST(turn * 10 AS BIGINT), CAST(j AS BIGINT), CAST(conv_id % 3 AS BIGINT),
            CAST(CASE WHEN (conv_id + j) % 4 = 0 THEN 0 ELSE turn * 10 + j + conv_id % 3 END AS BIGINT)
        FROM (SELECT *, unnest(range(1, turn % 3 + 2)) AS j FROM conversations WHERE role = 'assistant')),
    x AS (SELECT *, sum(CASE WHEN kind = 'response' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY position
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM log WHERE kind = 'response' OR total_tokens > 0),
    firsts AS (SELECT * FROM x WHERE kind = 'report' AND island > 0
               QUALIFY row_number() OVER (PARTITION BY session_id, island ORDER BY position) = 1)
    SELECT r.session_id, r.position, 'response' AS source,
        CASE WHEN r.total_tokens = 0 AND f.position IS NOT NULL THEN f.input_tokens ELSE r.input_tokens END AS input_tokens,
        CASE WHEN r.total_tokens = 0 AND f.position IS NOT NULL THEN f.output_tokens ELSE r.output_tokens END AS output_tokens,
        CASE WHEN r.total_tokens = 0 AND f.position IS NOT NULL THEN f.cache_tokens ELSE r.cache_tokens END AS cache_tokens,
        CASE WHEN r.total_tokens = 0 AND f.position IS NOT NULL THEN f.total_tokens ELSE r.total_tokens END AS total_tokens
    FROM x r LEFT JOIN firsts f ON r.session_id = f.session_id AND r.island = f.island WHERE r.kind = 'response'
    UNION ALL
    SELECT x.session_id, x.position, 'token_report', x.input_tokens, x.output_tokens, x.cache_tokens, x.total_tokens
    FROM x LEFT JOIN firsts f ON x.session_id = f.session_id AND x.island = f.island
    WHERE x.kind = 'report' AND (f.position IS NULL OR x.position <> f.position)"""))
def w13_attach_token_reports(spark, sf):
    return S.attach_token_reports(_codex_log(spark, sf))


# ---- P2: fallback child rows -------------------------------------------------------------

def _fallback_sessions(spark, sf):
    conv = FX.read_table(spark, sf, "conversations")
    c = F.col("conv_id")
    g = conv.groupBy("conv_id").agg(F.min("turn").alias("t0"))
    return g.select(F.format_string("c-%d", c).alias("session_id"),
                    (F.lit(FX.EPOCH_2024_MS) + c * 3600000).alias("start_ms"),
                    F.format_string("resume session %d", c).alias("prompt_preview"),
                    F.create_map(F.lit("Bash"), (c % 3).cast("bigint"), F.lit("Read"), F.lit(1).cast("bigint")).alias("tools"),
                    F.create_map(F.format_string("claude-%d", c % 2), F.struct(
                        (c * 10).cast("bigint").alias("input_tokens"), (c % 5).cast("bigint").alias("output_tokens"),
                        (c * 10 + c % 5).cast("bigint").alias("total_tokens"))).alias("model_usage"))


@register("p2_fallback_tools", W(["session_jsonl"], f"""
    SELECT 'c-' || conv_id AS session_id, {FX.EPOCH_2024_MS} + conv_id * 3600000 AS timestamp_ms, CAST(0 AS BIGINT) AS prompt_index,
        tool_name, call_no, CASE WHEN tool_name = 'Bash' THEN 'shell' ELSE 'read' END AS category, '' AS command,
        'none' AS command_name, 'process' AS effect, 'observed' AS status
    FROM (SELECT conv_id, 'Bash' AS tool_name, unnest(range(1, conv_id % 3 + 1)) AS call_no
          FROM (SELECT DISTINCT conv_id FROM conversations)
          UNION ALL SELECT DISTINCT conv_id, 'Read', 1 FROM conversations)
    WHERE 'c-' || conv_id NOT IN (SELECT DISTINCT session_id FROM tools)""", _P1_SQL))
def p2_fallback_tools(spark, sf):
    _, tools, _ = _p1(spark, sf)
    prompts = _p1(spark, sf)[0]
    llm = _p1(spark, sf)[2]
    return SL.apply_fallbacks(_fallback_sessions(spark, sf), prompts, tools, llm)[1].withColumn(
        "call_no", F.col("call_no").cast("bigint"))


# ---- A9 / A11 over transcript sessions: whole rows -----------------------------------

def _sessions(spark, sf):
    return S.agent_sessions(*_p1(spark, sf), "claude")


def _map_text(col, value):
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat_ws("=", e["key"], value(e["value"]))), ",")


_SHORT = "CASE WHEN length(session_id) <= 12 THEN session_id ELSE left(session_id, 6) || '.' || right(session_id, 5) END"
_A9_SQL = _P1_SQL + [
    ("usage", """SELECT session_id, model, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(cache_tokens) AS BIGINT) AS c,
        max(position) AS last FROM llm GROUP BY 1, 2"""),
    ("children", "SELECT session_id, timestamp_ms FROM prompts UNION ALL SELECT session_id, timestamp_ms FROM tools UNION ALL SELECT session_id, timestamp_ms FROM llm"),
    ("names", """SELECT session_id, 'tools' AS kind, tool_name AS name, count(*) AS n FROM tools GROUP BY ALL
        UNION ALL SELECT session_id, 'files', coalesce(b->>'$.input.file_path', b->>'$.input.path') AS name, count(*) FROM blocks
            WHERE type = 'assistant' AND b->>'$.type' = 'tool_use' AND coalesce(b->>'$.input.file_path', b->>'$.input.path') IS NOT NULL GROUP BY ALL"""),
    ("agent_sessions", f"""SELECT s.session_id, 'claude' AS agent_type, 'claude:' || {_SHORT.replace('session_id', 's.session_id')} AS display_id, start_timestamp_ms, end_timestamp_ms, model,
            coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens, coalesce(c, 0) AS cache_tokens, coalesce(i + o + c, 0) AS total_tokens,
            model_usage, t.text AS tools, f.text AS files, first_prompt
        FROM (SELECT session_id, min(timestamp_ms) AS start_timestamp_ms, max(timestamp_ms) AS end_timestamp_ms FROM children GROUP BY 1) s
        LEFT JOIN (SELECT session_id, arg_max(model, last) AS model, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o, CAST(sum(c) AS BIGINT) AS c,
                string_agg(model || '=' || i || '/' || o || '/' || c || '/' || (i + o + c), ',' ORDER BY model) AS model_usage FROM usage GROUP BY 1) u USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg(name || '=' || n, ',' ORDER BY name) AS text FROM names WHERE kind = 'tools' GROUP BY 1) t USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg(name || '=' || n, ',' ORDER BY name) AS text FROM names WHERE kind = 'files' GROUP BY 1) f USING (session_id)
        LEFT JOIN (SELECT session_id, arg_min(text, position) AS first_prompt FROM prompts GROUP BY 1) p USING (session_id)"""),
]
_NATIVE_SQL = "'agent_native_session' AS view_source, CAST(0.95 AS DOUBLE) AS confidence"


@register("a9_agent_sessions", W(["session_jsonl"], "SELECT * FROM agent_sessions", _A9_SQL))
def a9_agent_sessions(spark, sf):
    """Session rows of transcripts; maps as sorted text."""
    count = lambda v: v.cast("string")
    usage = lambda v: F.concat_ws("/", v["input_tokens"], v["output_tokens"], v["cache_tokens"], v["total_tokens"])
    return (_sessions(spark, sf).withColumn("model_usage", _map_text(F.col("model_usage"), usage))
            .withColumn("tools", _map_text(F.col("tools"), count)).withColumn("files", _map_text(F.col("files"), count)))


@register("a11_session_rows", W(["session_jsonl"], f"""
    SELECT 'local:claude:' || display_id AS id, agent_type, start_timestamp_ms, end_timestamp_ms, 'observed' AS status, model, input_tokens,
        output_tokens, total_tokens, session_id, first_prompt, {_NATIVE_SQL} FROM agent_sessions""", _A9_SQL))
def a11_session_rows(spark, sf):
    return S.session_tables(_sessions(spark, sf))[0]


@register("a11_token_rows", W(["session_jsonl"], f"""
    SELECT 'token-local:claude:' || display_id || '-' || regexp_replace(u.model, '[^A-Za-z0-9]', '-', 'g') AS id,
        'local:claude:' || display_id || '-' || u.model AS llm_call_id, end_timestamp_ms AS timestamp_ms, 'claude' AS comm, u.model, i AS input_tokens,
        o AS output_tokens, c AS cache_tokens, i + o + c AS total_tokens, 'agent_native_session' AS source, {_NATIVE_SQL}
    FROM agent_sessions s JOIN usage u USING (session_id) WHERE i + o + c > 0""", _A9_SQL))
def a11_token_rows(spark, sf):
    return S.session_tables(_sessions(spark, sf))[1]


@register("a11_tool_call_rows", W(["session_jsonl"], f"""
    SELECT 'tool-local:claude:' || display_id || '-' || regexp_replace(name, '[^A-Za-z0-9]', '-', 'g') || '-' || k AS id,
        'local:claude:' || display_id AS session_id, end_timestamp_ms AS timestamp_ms, name AS tool_name, 'observed' AS status, {_NATIVE_SQL}
    FROM (SELECT session_id, name, unnest(range(0, n)) AS k FROM names WHERE kind = 'tools') JOIN agent_sessions USING (session_id)""", _A9_SQL))
def a11_tool_call_rows(spark, sf):
    return S.session_tables(_sessions(spark, sf))[2]


def _top_sql(table, name):
    return (f"SELECT session_id, string_agg(name || '(' || n || ')', ', ' ORDER BY n DESC, name) AS top FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY session_id ORDER BY n DESC, name) AS r FROM (SELECT session_id, {name} AS name, count(*) AS n "
            f"FROM {table} WHERE {name} IS NOT NULL GROUP BY 1, 2)) WHERE r <= 10 GROUP BY session_id")


@register("t4_live_agent_rows", W(["session_log", "session_jsonl"], """
    SELECT s.session_id, s.agent, m.root_pid, m.evidence, m.confidence, m.root_pid % 97 / 10 AS cpu_percent, m.root_pid % 13 * 64 AS rss_mb,
        t.top AS tools, f.top AS files, 'session' AS row_kind
    FROM sess s LEFT JOIN matches m ON m.session_id = s.session_id LEFT JOIN top_tools t ON t.session_id = s.session_id
        LEFT JOIN top_files f ON f.session_id = s.session_id
    UNION ALL SELECT NULL, agent, root_pid, NULL, NULL, root_pid % 97 / 10, root_pid % 13 * 64, NULL, NULL, 'process'
    FROM procs WHERE root_pid NOT IN (SELECT root_pid FROM matches)""", [*_P1_SQL, *_MATCH_SQL,
    ("tool_paths", """SELECT session_id, coalesce(b->>'$.input.file_path', b->>'$.input.path') AS path
        FROM blocks WHERE type = 'assistant' AND b->>'$.type' = 'tool_use'"""),
    ("top_tools", _top_sql("tools", "tool_name")), ("top_files", _top_sql("tool_paths", "path"))], recursive=True))
def t4_live_agent_rows(spark, sf):
    sess, procs, ev = _match_inputs(spark, sf)
    matches = MT.match_sessions(sess, procs, ev)
    _, tools, _ = _p1(spark, sf)
    counts = tools.groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("count"))
    files = tools.where("input_path IS NOT NULL").groupBy("session_id", F.col("input_path").alias("path")).agg(F.count(F.lit(1)).alias("count"))
    metrics = procs.select("root_pid", "agent", (F.col("root_pid") % 97 / 10).alias("cpu_percent"),
                           (F.col("root_pid") % 13 * 64).alias("rss_mb"))
    return MT.live_agent_rows(matches, sess, metrics, counts, files)
