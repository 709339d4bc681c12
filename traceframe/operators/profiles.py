"""Weighted-stack profiles: frames, folding, summaries and flame trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sessions import event_durations


def safe_frame_value(text: Column) -> Column:
    """Lower-case; characters outside ``[a-z0-9._:/+-]`` become '_' (runs
    collapse); '_' trimmed at both ends; empty → 'unknown'."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9._:/+-]+", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.when(t == "", F.lit("unknown")).otherwise(t)


def frame(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))


def fold_stacks(samples: DataFrame, frames_col: str = "frames", weight_col: str = "weight") -> DataFrame:
    """``kind:safe(name)`` per frame, joined with ';', weights summed
    (each sample counts at least 1). Partial aggregation per stack."""
    stack = F.array_join(F.transform(F.col(frames_col), lambda f: F.concat(
        f["kind"], F.lit(":"), safe_frame_value(f["name"]))), ";")
    return (samples.where(F.col(weight_col) != 0)
            .select(stack.alias("stack"), F.greatest(F.col(weight_col), F.lit(1)).cast("bigint").alias("w"))
            .groupBy("stack").agg(F.sum("w").cast("bigint").alias("weight")))


def stack_summary(stacks: DataFrame) -> DataFrame:
    """Total weight, unique stacks, compression ratio (3 dp), max reuse."""
    return stacks.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("total_weight"),
        F.count(F.lit(1)).alias("unique_stacks"),
        F.coalesce(F.round(F.sum("weight") / F.count(F.lit(1)), 3), F.lit(0.0)).alias("compression_ratio"),
        F.coalesce(F.max("weight"), F.lit(0)).cast("bigint").alias("max_stack_reuse"))


def top_stacks(stacks: DataFrame, n: int = 10) -> DataFrame:
    """Heaviest stacks (weight desc, stack asc)."""
    return stacks.orderBy(F.col("weight").desc(), F.col("stack").asc()).limit(n)


def flame_tree(stacks: DataFrame) -> DataFrame:
    """Inclusive value of every stack prefix (node), with its depth.
    Node values at depth 1 sum to the total weight."""
    frames = F.filter(F.split("stack", ";"), lambda f: f != "")
    x = stacks.where(F.col("weight") != 0).select(frames.alias("_f"), "weight").where(F.size("_f") > 0)
    x = x.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_f")),
                                          lambda i: F.array_join(F.slice("_f", 1, i), ";"))).alias("_p", "node"),
                 "weight")
    return (x.groupBy("node").agg((F.first("_p") + 1).alias("depth"),
                                  F.sum("weight").cast("bigint").alias("value")))


def folded_lines(stacks: DataFrame) -> DataFrame:
    """``stack weight`` text lines, sorted by stack."""
    return stacks.select(F.concat_ws(" ", "stack", F.col("weight").cast("string")).alias("line")).orderBy("line")


def write_folded(stacks: DataFrame, path: str) -> None:
    """S14 sink: one folded-stack text file set (sorted lines)."""
    folded_lines(stacks).write.mode("overwrite").text(path)


def last_model_segment(model: Column) -> Column:
    return F.element_at(F.split(model, "/"), -1)


def _tool_frames() -> Column:
    """Frames of a tool call: its name, and of a shell command the program and the chain of programs it starts."""
    shell = F.col("category") == "shell"
    none = F.array().cast("array<struct<kind:string,name:string>>")
    return F.concat(F.array(frame("kind", F.lit("tool")), frame("tool", F.col("tool_name"))),
                    F.when(shell & (F.col("command_name") != ""), F.array(frame("cmd", F.col("command_name")))).otherwise(none),
                    F.when(shell & F.col("process_chain").isNotNull(), F.transform("process_chain", lambda p: frame("proc", p))).otherwise(none))


def time_profile_samples(sessions: DataFrame, prompts: DataFrame, llm: DataFrame,
                         project: str = "demo", tools: DataFrame | None = None) -> DataFrame:
    """Prompts, tool calls and LLM responses of each session in time order;
    the weight of an event is the seconds to the next one (W3). Events without
    a time are left out.

    ``sessions``: session_id, agent, session_tag; ``prompts``: session_id,
    prompt_index, timestamp_ms, tag; ``llm``: session_id, position,
    prompt_index, timestamp_ms, tag, model; ``tools``: session_id, position,
    prompt_index, timestamp_ms, tool_name, category, command_name, process_chain.
    """
    ptags = prompts.select("session_id", "prompt_index", F.col("tag").alias("prompt_tag"))
    pe = prompts.select("session_id", "position", "timestamp_ms",
                        F.lit(0).alias("kind_rank"), "prompt_index",
                        F.array(frame("kind", F.lit("prompt"))).alias("detail"))
    le = llm.select("session_id", "position", "timestamp_ms", F.lit(2).alias("kind_rank"), "prompt_index",
                    F.array(frame("kind", F.lit("llm")),
                            frame("call", F.concat(F.lit("llm/"), F.col("tag"))),
                            frame("model", last_model_segment(F.col("model")))).alias("detail"))
    ev = pe.unionByName(le)
    if tools is not None:
        ev = ev.unionByName(tools.select("session_id", "position", "timestamp_ms", F.lit(1).alias("kind_rank"), "prompt_index",
                                         _tool_frames().alias("detail")))
    ev = event_durations(ev.where(F.col("timestamp_ms").isNotNull()))
    ev = ev.join(ptags, ["session_id", "prompt_index"], "left").join(sessions, "session_id", "left")
    base = F.array(frame("project", F.lit(project)), frame("agent", F.col("agent")),
                   frame("session", F.col("session_tag")), frame("prompt", F.col("prompt_tag")))
    return ev.select(F.concat(base, F.col("detail")).alias("frames"), F.col("duration_s").alias("weight"))


def token_components(inp: Column, out: Column, cache: Column, total: Column) -> Column:
    """Reported components of at least 1; else the total as an estimate;
    else ``unknown`` = 1. However large a count is, it is kept."""
    comps = F.filter(F.array(
        F.struct(F.lit("input").alias("kind"), inp.cast("bigint").alias("value")),
        F.struct(F.lit("output").alias("kind"), out.cast("bigint").alias("value")),
        F.struct(F.lit("cache").alias("kind"), cache.cast("bigint").alias("value"))),
        lambda c: c["value"] >= 1)
    est = F.when(total >= 1,
                 F.array(F.struct(F.lit("estimate").alias("kind"), total.cast("bigint").alias("value")))) \
        .otherwise(F.array(F.struct(F.lit("unknown").alias("kind"), F.lit(1).cast("bigint").alias("value"))))
    return F.when(F.size(comps) > 0, comps).otherwise(est)


def token_profile_samples(sessions: DataFrame, prompts: DataFrame, llm: DataFrame,
                          project: str = "demo") -> DataFrame:
    """One sample per token component of each LLM response."""
    ptags = prompts.select("session_id", "prompt_index", F.col("tag").alias("prompt_tag"))
    x = llm.join(ptags, ["session_id", "prompt_index"], "left").join(sessions, "session_id", "left")
    x = x.select("*", F.explode(token_components(F.col("input_tokens"), F.col("output_tokens"),
                                                 F.col("cache_tokens"), F.col("total_tokens"))).alias("_c"))
    frames = F.array(frame("project", F.lit(project)), frame("agent", F.col("agent")),
                     frame("session", F.col("session_tag")), frame("prompt", F.col("prompt_tag")),
                     frame("call", F.concat(F.lit("llm/"), F.col("tag"))),
                     frame("model", last_model_segment(F.col("model"))),
                     frame("kind", F.col("_c.kind")))
    return x.select(frames.alias("frames"), F.col("_c.value").alias("weight"))


def profile_files(base: DataFrame, project: str = "demo") -> DataFrame:
    """P5: one sample (weight 1) per path group of each tool event: prompt
    frames + path group + effect + status. ``base``: agent, session_tag,
    prompt_tag, path_groups (array), effect, status."""
    x = base.where(F.size("path_groups") > 0).select("*", F.explode("path_groups").alias("_g"))
    frames = F.array(frame("project", F.lit(project)), frame("agent", F.col("agent")),
                     frame("session", F.col("session_tag")), frame("prompt", F.col("prompt_tag")),
                     frame("path", F.col("_g")), frame("effect", F.col("effect")), frame("status", F.col("status")))
    return x.select(frames.alias("frames"), F.lit(1).cast("bigint").alias("weight"))


def profile_network(base: DataFrame, project: str = "demo") -> DataFrame:
    """Tool events with a network effect or domains: one sample per
    domain ('unknown' when none) with the process chain frames and status.
    ``base``: agent, session_tag, prompt_tag, domains, effect, status,
    process_chain (array)."""
    x = base.where((F.col("effect") == "network") | (F.size("domains") > 0))
    doms = F.when(F.size("domains") > 0, F.col("domains")).otherwise(F.array(F.lit("unknown")))
    x = x.select("*", F.explode(doms).alias("_d"))
    frames = F.concat(
        F.array(frame("project", F.lit(project)), frame("agent", F.col("agent")),
                frame("session", F.col("session_tag")), frame("prompt", F.col("prompt_tag")),
                frame("domain", F.col("_d"))),
        F.transform(F.coalesce(F.col("process_chain"), F.array().cast("array<string>")), lambda p: frame("process", p)),
        F.array(frame("status", F.col("status"))))
    return x.select(frames.alias("frames"), F.lit(1).cast("bigint").alias("weight"))


def profile_report(stacks: DataFrame, view: str, unit: str, n: int = 10) -> DataFrame:
    """One JSON document: view, unit, stack summary (A13) and the top
    ``n`` stacks (bounded by n, ordered by weight desc, stack asc)."""
    summ = stack_summary(stacks)
    top = (top_stacks(stacks, n)
           .agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "stack", "weight"))).alias("_t"))
           .select(F.transform("_t", lambda s: F.struct(s["stack"].alias("stack"), s["weight"].alias("weight")))
                   .alias("top")))
    row = summ.unionByName(top, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in summ.columns], F.max("top").alias("top"))
    return row.select(F.to_json(F.struct(F.lit(view).alias("view"), F.lit(unit).alias("unit"),
                                         F.struct(*summ.columns).alias("summary"), F.col("top"))).alias("report"))


def prompt_keys(prompts: DataFrame) -> DataFrame:
    """``{index}:{hash}`` prompt keys and whether the index repeats in
    its session ('duplicate_non_keyed') or not ('unique'); the repeat count
    is a grouped count joined back (no window over a session)."""
    counts = prompts.groupBy("session_id", "prompt_index").agg(F.count(F.lit(1)).alias("_n"))
    return (prompts.join(counts, ["session_id", "prompt_index"])
            .select("session_id", "prompt_index", "text_hash",
                    F.format_string("%d:%s", "prompt_index", "text_hash").alias("prompt_key"),
                    F.when(F.col("_n") > 1, "duplicate_non_keyed").otherwise("unique").alias("key_kind")))
