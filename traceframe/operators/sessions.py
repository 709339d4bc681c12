"""Session-log jobs: prompt indexing, durations, tagging and tag statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import sanitize_identifier, short_session_id
from ..functions.scan import next_value, running_last, running_sum

UNMATCHED = "unmatched"

# Keyword presets of the regex tagger, in priority order. A text
# gets the first tag one of whose needles is a substring of its ASCII-lowercased
# form.
PRESETS = [
    ("profile", ["pprof", "flamegraph", "trace", "otel", "span", "observability", "火焰图"]),
    ("research", ["paper", "osdi", "novelty", "evaluation", "literature", "论文", "调研"]),
    ("design", ["design", "architecture", "visualization", "schema", "projection", "设计", "可视化"]),
    ("debug", ["debug", "failing", "failed", "error", "panic", "bug", "fix"]),
    ("test", ["test", "cargo test", "pytest", "unit test", "coverage"]),
    ("review", ["review", "audit", "pr", "diff", "regression"]),
    ("release", ["release", "publish", "crates.io", "version", "tag"]),
    ("build", ["build", "compile", "cargo check", "npm run build"]),
    ("docs", ["readme", "docs", "documentation", "latex", "markdown"]),
    ("git", ["branch", "commit", "push", "rebase", "merge"]),
    ("network", ["network", "github.com", "curl", "wget", "fetch"]),
    ("frontend", ["frontend", "react", "css", "html", "svg"]),
    ("parser", ["parse", "parser", "jsonl", "session"]),
    ("cli", ["cli", "argument", "option", "subcommand", "flag"]),
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def clean_text(c: Column) -> Column:
    """Whitespace runs → one space, trimmed (whole text, no truncation)."""
    return F.regexp_replace(F.regexp_replace(c, "[ \t\n\r\f]+", " "), "^ | $", "")


def parse_rules(specs: list[str]) -> list[tuple[str, str, str]]:
    """``KIND:TAG=REGEX`` → (kind, tag, regex); kind ``all`` matches every kind."""
    out = []
    for spec in specs:
        left, _, pattern = spec.partition("=")
        kind, _, tag = left.partition(":")
        if not pattern or not tag:
            raise ValueError(f"invalid tag rule {spec!r}; expected KIND:TAG=REGEX")
        out.append((kind.strip(), tag.strip(), pattern))
    return out


def tag_expr(kind: str, text: Column, rules: list[tuple[str, str, str]], preset: bool) -> Column:
    """First matching custom rule for ``kind``, else the first preset whose
    needle occurs in the ASCII-lowercased text, else 'unmatched'."""
    e = None
    for rk, tag, pat in rules:
        if rk not in (kind, "all"):
            continue
        cond = text.rlike(pat)
        e = F.when(cond, F.lit(tag)) if e is None else e.when(cond, F.lit(tag))
    if preset:
        low = ascii_lower(text)
        for tag, needles in PRESETS:
            # one literal-alternation regex per tag: substring semantics, small codegen
            cond = low.rlike("|".join("\\Q" + n + "\\E" for n in needles))
            e = F.when(cond, F.lit(tag)) if e is None else e.when(cond, F.lit(tag))
    return F.lit(UNMATCHED) if e is None else e.otherwise(F.lit(UNMATCHED))


def assign_prompt_index(log: DataFrame, block: int = 1024) -> DataFrame:
    """Prompt index by first occurrence of the text hash within a session;
    every row carries the index active at its position (a repeated prompt
    re-activates its old index; rows before any prompt get 0).

    Both the index numbering and the carry-forward are two-level scans, so a
    session holding most rows is not one task.
    """
    p = log.where(F.col("kind") == "prompt")
    firsts = p.groupBy("session_id", "text_hash").agg(F.min("position").alias("first_pos"))
    firsts = running_sum(firsts, ["session_id"], F.expr(f"first_pos div {block}"), ["first_pos"],
                         F.lit(1).cast("bigint"), "_pidx", inclusive=False)
    idx = firsts.select(F.col("session_id").alias("_s"), F.col("text_hash").alias("_h"), "_pidx")
    x = log.join(idx, (log["session_id"] == idx["_s"]) & (log["text_hash"] == idx["_h"])
                 & (log["kind"] == "prompt"), "left").drop("_s", "_h")
    x = running_last(x, ["session_id"], F.expr(f"position div {block}"), ["position"],
                     F.col("_pidx"), "prompt_index")
    return x.withColumn("prompt_index", F.coalesce("prompt_index", F.lit(0).cast("bigint"))).drop("_pidx")


def distinct_prompts(indexed: DataFrame) -> DataFrame:
    """One row per (session, prompt index): first occurrence time and text."""
    return (indexed.where(F.col("kind") == "prompt")
            .groupBy("session_id", "prompt_index")
            .agg(F.min_by(F.struct("timestamp_ms", "text", "text_hash", "position"), "position").alias("_f"))
            .select("session_id", "prompt_index", "_f.*"))


def tag_log(indexed: DataFrame, rules: list[str] | None = None, preset: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P8 over a session log: returns (session_tags, prompt_tags, llm_tags).

    Session text = its first 8 distinct prompts (index order) joined by spaces;
    prompts and responses are tagged on their whole cleaned text.
    """
    r = parse_rules(rules or [])
    prompts = distinct_prompts(indexed)
    first8 = (prompts.where(F.col("prompt_index") < 8)
              .groupBy("session_id")
              .agg(F.array_sort(F.collect_list(F.struct("prompt_index", clean_text(F.col("text")).alias("t"))))
                   .alias("_ps")))
    sess = first8.select("session_id", clean_text(F.array_join(F.col("_ps.t"), " ")).alias("session_text"))
    sess = sess.select("session_id", tag_expr("session", F.col("session_text"), r, preset).alias("session_tag"))
    ptag = prompts.select("session_id", "prompt_index", "position", "timestamp_ms", "text_hash",
                          tag_expr("prompt", clean_text(F.col("text")), r, preset).alias("tag"))
    llm = indexed.where(F.col("kind") == "llm").select(
        "session_id", "position", "prompt_index", "timestamp_ms", "text", "text_hash",
        tag_expr("llm", clean_text(F.col("text")), r, preset).alias("tag"))
    return sess, ptag, llm


def tag_counts(ptag: DataFrame, llm: DataFrame) -> DataFrame:
    """A15: 'prompt:{tag}' counts (unmatched included) and 'llm:{tag}' counts
    (unmatched excluded)."""
    p = ptag.groupBy(F.concat(F.lit("prompt:"), F.col("tag")).alias("tag")).agg(F.count(F.lit(1)).alias("count"))
    c = (llm.where(F.col("tag") != UNMATCHED)
         .groupBy(F.concat(F.lit("llm:"), F.col("tag")).alias("tag")).agg(F.count(F.lit(1)).alias("count")))
    return p.unionByName(c)


def tag_totals(sess: DataFrame, ptag: DataFrame, llm: DataFrame) -> DataFrame:
    """Totals, matched counts and coverage per kind (one row)."""
    s = sess.agg(F.count(F.lit(1)).alias("total_sessions"),
                 F.count_if(F.col("session_tag") != UNMATCHED).alias("matched_sessions"))
    p = ptag.agg(F.count(F.lit(1)).alias("total_prompts"),
                 F.count_if(F.col("tag") != UNMATCHED).alias("matched_prompts"))
    c = llm.agg(F.count(F.lit(1)).alias("total_llm_calls"),
                F.count_if(F.col("tag") != UNMATCHED).alias("matched_llm_calls"))
    parts = s.unionByName(p, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    cols = ["total_sessions", "matched_sessions", "total_prompts", "matched_prompts",
            "total_llm_calls", "matched_llm_calls"]
    row = parts.agg(*[F.max(x).alias(x) for x in cols])
    share = [F.round(F.try_divide(F.col(f"matched_{k}") * 100, F.col(f"total_{k}")), 4).alias(f"{k}_coverage_pct")
             for k in ("sessions", "prompts", "llm_calls")]
    return row.select("*", *share)


def unmatched_samples(sess: DataFrame, ptag: DataFrame, llm: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` untagged sessions, prompts and responses, by
    session, kind (session, prompt, llm) and position (a report's top-n)."""
    rows = (sess.where(F.col("session_tag") == UNMATCHED).select("session_id", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("position"))
            .unionByName(ptag.where(F.col("tag") == UNMATCHED).select("session_id", F.lit(1).alias("rank"), F.col("position").cast("bigint").alias("position")))
            .unionByName(llm.where(F.col("tag") == UNMATCHED).select("session_id", F.lit(2).alias("rank"), F.col("position").cast("bigint").alias("position"))))
    kind = F.element_at(F.array(F.lit("session"), F.lit("prompt"), F.lit("llm")), F.col("rank") + 1)
    return rows.orderBy("session_id", "rank", "position").limit(n).select("session_id", kind.alias("kind"), "position")


def tag_distribution(counts: DataFrame) -> DataFrame:
    """Per kind, over matched tags: tag count, total, top1/3/5 share (%),
    normalised entropy, and the quality warnings that apply: dominant (top1
    over 40 %), top3 (over 80 % of more than three tags), few (under 5 tags)
    or fragmented (over 25), uneven (entropy under 0.5 of more than three)."""
    c = (counts.where(~F.col("tag").endswith(":" + UNMATCHED))
         .withColumn("kind", F.substring_index("tag", ":", 1)))
    w = Window.partitionBy("kind").orderBy(F.col("count").desc(), F.col("tag").asc())
    c = c.withColumn("_r", F.row_number().over(w))
    g = c.groupBy("kind").agg(
        F.count(F.lit(1)).alias("num_tags"),
        F.sum("count").cast("bigint").alias("total"),
        F.sum(F.when(F.col("_r") <= 1, F.col("count"))).alias("_t1"),
        F.sum(F.when(F.col("_r") <= 3, F.col("count"))).alias("_t3"),
        F.sum(F.when(F.col("_r") <= 5, F.col("count"))).alias("_t5"),
        F.collect_list("count").alias("_counts"))
    # entropy from the per-kind count list (bounded by the number of tags)
    ent = F.aggregate(F.col("_counts"), F.lit(0.0),
                      lambda acc, v: acc - (v / F.col("total")) * F.log(v / F.col("total")))
    top = [F.round(F.col(f"_t{k}") / F.col("total") * 100, 4).alias(f"top{k}_pct") for k in (1, 3, 5)]
    even = F.when(F.col("num_tags") > 1, ent / F.log(F.col("num_tags").cast("double"))).otherwise(F.lit(0.0))
    many = F.col("num_tags") > 3
    rules = {"dominant": F.col("_t1") / F.col("total") > 0.4, "top3": (F.col("_t3") / F.col("total") > 0.8) & many, "few": F.col("num_tags") < 5,
             "fragmented": F.col("num_tags") > 25, "uneven": (even < 0.5) & many}
    warnings = F.concat_ws(",", *[F.when(c, name) for name, c in rules.items()])
    return g.select("kind", "num_tags", "total", *top, F.round(even, 6).alias("normalized_entropy"), warnings.alias("warnings"))


def event_durations(events: DataFrame, keys=("session_id",), block_ms: int = 3_600_000) -> DataFrame:
    """Seconds to the next event of the session, at least 1; last = 1.
    Events are ordered by (timestamp, kind_rank, position)."""
    order = ["timestamp_ms", "kind_rank", "position"]
    x = next_value(events, list(keys), F.expr(f"timestamp_ms div {block_ms}"), order, "timestamp_ms", "_next")
    return x.withColumn("duration_s", F.when(F.col("_next").isNull(), F.lit(1).cast("bigint"))
                        .otherwise(F.greatest(F.expr("(_next - timestamp_ms) div 1000"), F.lit(1)).cast("bigint"))
                        ).drop("_next")


def dedup_usage(llm: DataFrame, key: str = "text_hash") -> DataFrame:
    """A10: one usage row per message id within a session, the first one kept."""
    return (llm.groupBy("session_id", key)
            .agg(F.min_by(F.struct(*llm.columns), "position").alias("_r")).select("_r.*"))


def session_rollup(indexed: DataFrame) -> DataFrame:
    """Per session: start/end, prompt and response counts, distinct
    prompts, first prompt and last message text; sessions without prompts or
    responses are dropped."""
    g = indexed.groupBy("session_id").agg(
        F.min("timestamp_ms").alias("start_timestamp_ms"),
        F.max("timestamp_ms").alias("end_timestamp_ms"),
        F.count_if(F.col("kind") == "prompt").alias("prompts"),
        F.count_if(F.col("kind") == "llm").alias("responses"),
        F.count_distinct(F.when(F.col("kind") == "prompt", F.col("text_hash"))).alias("distinct_prompts"),
        F.min_by(F.when(F.col("kind") == "prompt", F.col("text_hash")),
                 F.when(F.col("kind") == "prompt", F.col("position"))).alias("first_prompt_hash"),
        F.max_by("text_hash", "position").alias("last_message_hash"))
    return g.where((F.col("prompts") + F.col("responses")) > 0)


def line_diff_counts(old: str | None, new: str | None) -> tuple[int, int] | None:
    """(added, removed) lines of a minimal diff of the non-empty lines; None
    when a side is missing (the prompts cannot be compared)."""
    if not old or not new:
        return None
    a, b = ([x for x in text.split("\n") if x] for text in (old, new))
    kept = common_lines(a, b)
    return len(b) - kept, len(a) - kept


def common_lines(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, in memory proportional to the
    lines. Equal ends are cut and lines of one side only dropped; then one
    bit of a number stands for each line of ``a``, and a line of ``b`` updates
    all of them by an addition (the bit-parallel recurrence of the table's
    row differences), so the cost is lines x lines / word size."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low:len(a) - high], b[low:len(b) - high]
    shared = set(a) & set(b)
    a, b = [x for x in a if x in shared], [x for x in b if x in shared]
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, list[int]] = {}
    for i, line in enumerate(a):
        places.setdefault(line, []).append(i)
    every = (1 << len(a)) - 1
    row = every  # a zero bit: the common subsequence grows at this line of a
    for line in b:
        at = 0
        for i in places[line]:
            at |= 1 << i
        hit = row & at
        row = ((row + hit) | (row - hit)) & every
    return low + high + len(a) - row.bit_count()


def prompt_diffs(prompts: DataFrame, key: str = "session_id", order: str = "position",
                 text_col: str = "text", block: int = 1024) -> DataFrame:
    """Each prompt against the previous prompt of the same process or
    session — added and removed line counts of a minimal diff of the
    non-empty lines.

    The previous prompt comes from a two-level lag (no single-partition
    window); only the paired rows reach the Arrow-batched pandas UDF that
    counts common lines in memory proportional to the texts. Equal prompts
    are settled without it."""
    from pyspark.sql.functions import pandas_udf

    from ..functions.scan import prev_value

    @pandas_udf("struct<added:int,removed:int,has_changes:boolean>")
    def diff_udf(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for o, n in zip(old, new):
            r = line_diff_counts(None if pd.isna(o) else o, None if pd.isna(n) else n)
            rows.append((None, None, False) if r is None else (r[0], r[1], (r[0] + r[1]) > 0))
        return pd.DataFrame(rows, columns=["added", "removed", "has_changes"])

    x = prev_value(prompts, [key], F.expr(f"{order} div {block}"), [order], text_col, "_prev_text")
    x = prev_value(x, [key], F.expr(f"{order} div {block}"), [order], order, "previous_position")
    x = x.where(F.col("previous_position").isNotNull())
    d = diff_udf(F.col("_prev_text"), F.col(text_col))
    return x.select(key, order, "previous_position", d["added"].alias("added_lines"),
                    d["removed"].alias("removed_lines"), d["has_changes"].alias("has_changes"))


def read_session_logs(spark, root: str, pattern: str = "*.jsonl", newest: int | None = None) -> DataFrame:
    """Transcript files under ``root`` (recursive, name pattern), newest
    first; with ``newest`` only that many files are read. The file choice is a
    metadata-only listing (``binaryFile`` without content) ordered by
    modification time; lines keep their in-file order (``line_no``)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(root).select("path", "modificationTime"))
    if newest is not None:
        files = files.orderBy(F.col("modificationTime").desc(), F.col("path").asc()).limit(newest)
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
             .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_modification_time").alias("modified"))
             .withColumn("line_no", F.monotonically_increasing_id()))
    return lines.join(files.select(F.col("path").alias("file")), "file", "left_semi")


def latest_sessions(sessions: DataFrame, key: str = "display_id", updated: str = "updated_ms",
                    limit: int = 25) -> DataFrame:
    """The newest parsed copy per display id (``max_by``, a partial
    aggregate), then the ``limit`` most recently updated."""
    cols = sessions.columns
    best = (sessions.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(updated, *[c for c in cols if c != updated]))
                                      .alias("_r")).select("_r.*"))
    return best.orderBy(F.col(updated).desc(), F.col(key).asc()).limit(limit)


def _counts_map(rows: DataFrame, name: str, out: str) -> DataFrame:
    """session_id → map of name → count; the map has one entry a name, counted before it is built."""
    counts = rows.where(F.col(name).isNotNull()).groupBy("session_id", name).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_n")))).alias(out))


def agent_sessions(prompts: DataFrame, tools: DataFrame, llm: DataFrame, agent: str) -> DataFrame:
    """A9 over the child tables of a transcript (``sessionlog.session_events``):
    one row a session with start, end, model of the last response, tokens,
    ``model_usage`` (model → input, output, cache, total), ``tools`` and
    ``files`` (name → count), first prompt and time of the last message.
    Sessions without tokens, tools, prompt and model do not occur here."""
    parts = ["input_tokens", "output_tokens", "cache_tokens"]
    usage = (llm.groupBy("session_id", "model").agg(*[F.sum(c).cast("bigint").alias(c) for c in parts], F.max(F.struct("position", "timestamp_ms")).alias("_last"))
             .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_tokens")))
    sums = [F.sum(c).cast("bigint").alias(c) for c in [*parts, "total_tokens"]]
    models = usage.groupBy("session_id").agg(
        *sums, F.max_by("model", F.struct("_last", "model")).alias("model"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct(*parts, "total_tokens").alias("usage"))))).alias("model_usage"))
    times = None
    for child in (prompts, tools, llm):
        rows = child.select("session_id", "timestamp_ms")
        times = rows if times is None else times.unionByName(rows)
    span = times.groupBy("session_id").agg(F.min("timestamp_ms").alias("start_timestamp_ms"), F.max("timestamp_ms").alias("end_timestamp_ms"))
    said = prompts.groupBy("session_id").agg(F.min_by("text", "position").alias("first_prompt"))
    out = span.join(models, "session_id", "left").join(_counts_map(tools, "tool_name", "tools"), "session_id", "left") \
        .join(_counts_map(tools, "input_path", "files"), "session_id", "left").join(said, "session_id", "left")
    display = F.concat(F.lit(f"{agent}:"), short_session_id(F.col("session_id")))
    return out.select("session_id", F.lit(agent).alias("agent_type"), display.alias("display_id"), "start_timestamp_ms", "end_timestamp_ms", "model",
                      *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in [*parts, "total_tokens"]], "model_usage", "tools", "files", "first_prompt")


def session_tables(sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The session, token and tool rows of ``agent_sessions``: one token
    row for each model with tokens, one tool row for each call."""
    view = F.concat(F.lit("local:"), F.col("agent_type"), F.lit(":"), F.col("display_id"))
    x = sessions.withColumn("view_id", view)
    fixed = [F.lit("agent_native_session").alias("view_source"), F.lit(0.95).cast("double").alias("confidence")]
    rows = x.select(F.col("view_id").alias("id"), "agent_type", "start_timestamp_ms", "end_timestamp_ms", F.lit("observed").alias("status"), "model",
                    "input_tokens", "output_tokens", "total_tokens", "session_id", "first_prompt", *fixed)
    u = x.select("view_id", "agent_type", F.col("end_timestamp_ms").alias("timestamp_ms"), F.explode("model_usage").alias("model", "u")).where("u.total_tokens > 0")
    tokens = u.select(F.concat(F.lit("token-"), F.col("view_id"), F.lit("-"), sanitize_identifier(F.col("model"))).alias("id"),
                      F.concat_ws("-", "view_id", "model").alias("llm_call_id"), "timestamp_ms", F.col("agent_type").alias("comm"), "model", "u.*",
                      F.lit("agent_native_session").alias("source"), *fixed)
    calls = session_tool_rows(x.select(F.col("view_id").alias("session_id"), "tools")).join(
        x.select(F.col("view_id").alias("session_id"), F.col("end_timestamp_ms").alias("timestamp_ms")), "session_id")
    tools = calls.select(F.format_string("tool-%s-%s-%d", "session_id", sanitize_identifier(F.col("tool_name")), F.col("call_no") - 1).alias("id"),
                         "session_id", "timestamp_ms", "tool_name", F.lit("observed").alias("status"), *fixed)
    return rows, tokens, tools


def session_tool_rows(sessions: DataFrame, tools_col: str = "tools") -> DataFrame:
    """A session's ``tools`` map (name → count) as one tool-call row per
    call (explode of the map, then of ``sequence(1, count)``)."""
    x = sessions.select("session_id", F.explode(tools_col).alias("tool_name", "_n")).where(F.col("_n") > 0)
    return x.select("session_id", "tool_name",
                    F.explode(F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(0)).cast("int")))
                    .alias("call_no"))


def join_prompt(events: DataFrame, prompts: DataFrame, index_col: str = "prompt_index") -> DataFrame:
    """The prompt row of each event by its ordinal, else the session's
    last prompt. ``prompts``: session_id, prompt_index, tag (+ any columns,
    returned with a ``prompt_`` prefix). Both lookups are equi joins; the
    fallback is a per-session ``max_by`` (partial aggregate)."""
    pcols = [c for c in prompts.columns if c not in ("session_id", "prompt_index")]
    exact = prompts.select("session_id", F.col("prompt_index").alias("_pi"),
                           *[F.col(c).alias(f"_e_{c}") for c in pcols])
    last = (prompts.groupBy("session_id")
            .agg(F.max_by(F.struct(*pcols), "prompt_index").alias("_last")))
    x = (events.join(exact, (events["session_id"] == exact["session_id"]) & (events[index_col] == exact["_pi"]), "left")
         .drop(exact["session_id"]).drop("_pi")
         .join(last, "session_id", "left"))
    for c in pcols:
        x = x.withColumn(f"prompt_{c}", F.when(F.col(f"_e_{c}").isNotNull() | F.col("_last").isNull(), F.col(f"_e_{c}"))
                         .otherwise(F.col(f"_last.{c}")))
    return x.drop(*[f"_e_{c}" for c in pcols], "_last")


def filter_by_prompt_tag(prompts: DataFrame, children: DataFrame, tag: str, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """F24 (prompt tag): keep the prompts carrying ``tag``, renumber them
    0..n-1 per session in their old order, keep child rows (tools, LLM
    calls) of kept prompts with the new ordinal, drop the rest. The new
    ordinal is a two-level running count per session."""
    kept = prompts.where(F.col("tag") == tag)
    kept = running_sum(kept, ["session_id"], F.expr(f"prompt_index div {block}"), ["prompt_index"],
                       F.lit(1).cast("bigint"), "new_index", inclusive=False)
    remap = kept.select("session_id", F.col("prompt_index").alias("_old"), "new_index")
    ch = (children.join(remap, (children["session_id"] == remap["session_id"]) & (children["prompt_index"] == remap["_old"]))
          .drop(remap["session_id"]).drop("_old"))
    return kept, ch


def filter_sessions(sessions: DataFrame, agent_prefix: str | None = None, id_contains: str | None = None,
                    session_tag: str | None = None) -> DataFrame:
    """agent prefix and session-id substring (before tagging), session
    tag equality (after tagging)."""
    c = F.lit(True)
    if agent_prefix:
        c = c & F.col("agent").startswith(agent_prefix)
    if id_contains:
        c = c & F.col("session_id").contains(id_contains)
    if session_tag:
        c = c & (F.col("session_tag") == session_tag)
    return sessions.where(c)


def attach_token_reports(log: DataFrame, block: int = 1024) -> DataFrame:
    """Late token reports. In each session's order, a report with a
    positive total fills the latest response when that response has no
    tokens yet; otherwise (a second report, or no response before it) it is
    added as a response row of its own.

    ``log``: session_id, position, kind ('response' | 'report'),
    input_tokens, output_tokens, cache_tokens, total_tokens. The island of a
    row is the running count of responses (two-level scan); the first
    positive report of an island fills its response."""
    x = log.where((F.col("kind") == "response") | (F.col("total_tokens") > 0))
    x = running_sum(x, ["session_id"], F.expr(f"position div {block}"), ["position"],
                    (F.col("kind") == "response").cast("bigint"), "island")
    reports = x.where(F.col("kind") == "report")
    firsts = (reports.where(F.col("island") > 0).groupBy("session_id", "island")
              .agg(F.min_by(F.struct("position", "input_tokens", "output_tokens", "cache_tokens", "total_tokens"),
                            "position").alias("_f")))
    resp = x.where(F.col("kind") == "response").join(firsts, ["session_id", "island"], "left")
    filled = F.coalesce(F.col("total_tokens"), F.lit(0)) == 0
    resp = resp.select("session_id", "position", F.lit("response").alias("source"),
                       *[F.when(filled & F.col("_f").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c)
                         for c in ("input_tokens", "output_tokens", "cache_tokens", "total_tokens")])
    used = firsts.select("session_id", "island", F.col("_f.position").alias("_used"))
    extra = (reports.join(used, ["session_id", "island"], "left")
             .where(F.col("_used").isNull() | (F.col("position") != F.col("_used")))
             .select("session_id", "position", F.lit("token_report").alias("source"),
                     "input_tokens", "output_tokens", "cache_tokens", "total_tokens"))
    return resp.unionByName(extra)
