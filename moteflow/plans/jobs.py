"""Lists of remote runs: the texts of a row, the day it stands under, and whether anything can still change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import duration_text

#: States that are over, the tint of each state (any other is failed), and what error codes say.
TERMINAL = ("done", "failed", "cancelled")
TINTS = {"running": "running", "uploading": "running", "created": "queued", "uploaded": "queued", "queued": "queued", "launching": "queued", "done": "done", "cancelled": "cancelled"}
ERRORS = {
    "pod_lost": "the GPU host dropped out — not billed",
    "no_capacity": "no GPU was available — not billed",
    "launch_timeout": "the GPU never came up — not billed",
    "gpu_unavailable": "the host gave the job no GPU — not billed",
    "wall_limit": "hit its wall-clock cap",
    "cancelled": "cancelled",
    "no_results": "finished but produced no results file",
    "lammps_error": "LAMMPS stopped with an error — see the log",
    "runner_error": "the runner failed before LAMMPS started",
}

FIELDS = {"state": "string", "gpu": "string", "created": "timestamp", "started": "timestamp", "cost_usd": "double", "billed_s": "long", "error": "string", "exitcode": "int", "attempt": "int", "thermo_tail": "array<string>", "billing": "string", "atom_steps": "long"}


def lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.element_at(pairs, key), otherwise)


def elapsed(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%ds", seconds.cast("long"))).otherwise(duration_text(seconds))


def day_title(created: Column, now: Column) -> Column:
    day, today = F.to_date(created), F.to_date(now)
    dated = F.when(F.year(day) == F.year(today), F.date_format(day, "MMM d")).otherwise(F.date_format(day, "MMM d, yyyy"))
    return F.when(created.isNull(), "Undated").when(day == today, "Today").when(F.date_add(day, 1) == today, "Yesterday").otherwise(dated)


def job_rows(jobs: DataFrame, now: Column) -> DataFrame:
    """id, created, state, tint, gpu, cost, elapsed, detail, title, terminal and summary of each job; fields it lacks are null.

    Sort by created, newest first and nulls last, to list them.
    """
    have = jobs.select("id", *[(F.col(c) if c in jobs.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
    over, charged = F.col("state").isin(*TERMINAL), F.col("cost_usd") > 0
    cost = F.when(charged & (F.col("cost_usd") < 0.01), F.format_string("$%.4f", "cost_usd")).when(charged, F.format_string("$%.2f", "cost_usd")).otherwise("$0")
    waiting = F.timestamp_diff("SECOND", F.coalesce("started", "created"), now)
    took = F.when(F.col("billed_s") > 0, elapsed(F.col("billed_s"))).when(waiting.isNotNull(), elapsed(F.greatest(waiting, F.lit(0)))).otherwise("—")
    last = F.trim(F.try_element_at("thermo_tail", F.lit(-1)))
    detail = F.when(F.col("error").isNotNull(), lookup(F.col("error"), ERRORS, F.col("error"))).when((F.col("state") == "running") & (last != ""), last).when(F.col("attempt") > 1, F.format_string("relaunched (attempt %d)", "attempt"))
    parts = [
        F.concat(F.col("id").cast("string"), F.lit(": "), "state"),
        F.when(~F.col("state").isin("created", "uploaded"), F.concat(F.lit(" on "), "gpu")),
        F.when(charged, F.format_string("  $%.4f", "cost_usd")),
        F.when((F.col("billing") == "job") & F.col("atom_steps").isNotNull(), F.format_string(" (%d atom-steps, priced by work)", "atom_steps")).when(F.col("billed_s") > 0, F.format_string(" (%d s billed)", "billed_s")),
        F.concat(F.lit("  error: "), "error"),
        F.when(over, F.concat(F.lit("  exit "), F.col("exitcode").cast("string"))),
    ]
    return have.select("id", "created", "state", lookup(F.col("state"), TINTS, F.lit("failed")).alias("tint"), F.coalesce("gpu", F.lit("—")).alias("gpu"), cost.alias("cost"), took.alias("elapsed"), detail.alias("detail"), day_title(F.col("created"), now).alias("title"), F.coalesce(over, F.lit(False)).alias("terminal"), F.concat_ws("", *parts).alias("summary"))


def should_poll(rows: DataFrame) -> bool:
    """Whether any of job_rows' jobs can still change."""
    return not rows.where(~F.col("terminal")).isEmpty()
