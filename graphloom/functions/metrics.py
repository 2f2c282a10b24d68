"""Named metric expressions over node columns. The same idea has several definitions on purpose; they are never merged."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

def meta(path: str, kind: str = "double", column: str = "metadata") -> Column:
    """A typed value from a JSON column, null where missing or of another shape."""
    return F.expr(f"try_variant_get(try_parse_json({column}), '$.{path}', '{kind}')")


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def clamped(value: Column) -> Column:
    """Never under 0, and null where null (``greatest`` alone would skip nulls)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def _commands(clamp: bool) -> Column:
    """Sum over commands of their durations, else of finish minus start where that isn't negative."""

    def one(c: Column) -> Column:
        span = F.unix_millis(F.try_to_timestamp(c["finished_at"])) - F.unix_millis(F.try_to_timestamp(c["started_at"]))
        span = F.when(span >= 0, span.cast("double"))
        own = clamped(c["duration_ms"]) if clamp else c["duration_ms"]
        return F.coalesce(own, span, F.lit(0.0))

    return F.aggregate(F.coalesce("commands", F.expr("array()").cast("array<struct<id:string,argv:array<string>,exit_code:int,duration_ms:double,started_at:string,finished_at:string,stderr:string>>")), F.lit(0.0), lambda a, c: a + one(c))


def _provenance() -> Column:
    return F.aggregate(F.col("provenance"), F.lit(0.0), lambda a, e: a + F.coalesce(e["duration_ms"], F.lit(0.0)))


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


# The status a badge's variant stands for, and words in metadata.status that stand for one.
BADGE_STATUS = {"success": "success", "error": "error", "amber": "warning", "info": "pending", "gray": "skipped"}
STATUSES = ("success", "error", "warning", "running", "skipped", "cached", "pending")


@functools.lru_cache
def _columns() -> dict:
    """All expressions of this module; made on first use, as Columns need a session."""
    m = F.col("metrics")
    _meta_ms, _meta_tb, _meta_t = meta("durationMs"), meta("timingBreakdown.wallDurationMs"), meta("timing.wallDurationMs")
    _tb, _t, _own = m["timing_breakdown"]["wall"], m["timing"]["wall"], m["duration_ms"]
    _zero = F.lit(0.0)
    DURATIONS = {
        "dur_anomaly": F.coalesce(positive(_own), positive(_tb), positive(_t), positive(_meta_ms), positive(_commands(False)), _zero),
        "dur_analytics": F.coalesce(clamped(_own), clamped(_meta_ms), clamped(F.coalesce(_tb, _meta_tb, _t, _meta_t)), positive(_commands(True)), _zero),
        "dur_heatmap": F.coalesce(positive(_own), positive(_tb), positive(_t), positive(_meta_ms), positive(_commands(False)), positive(_provenance()), _zero),
        "dur_report": F.coalesce(positive(F.coalesce(_own, _meta_ms)), _zero),
        "dur_diff": F.coalesce(_own, _t, _tb, _meta_tb, _meta_t, _meta_ms, _zero),
        "dur_compare": F.coalesce(_own, _meta_ms, _t, _tb, _meta_tb, _zero),
        "dur_search": F.coalesce(_own, _meta_ms, _t, _tb),
        "dur_recorded": F.coalesce(_own, _meta_ms, _meta_t, _meta_tb),
        "dur_lock": F.coalesce(_own, _meta_ms, _tb, _zero),
    }
    _k = m["tokens"]
    _in, _out = m["tokens_in"], m["tokens_out"]
    _prompt = F.greatest(F.coalesce(_k["prompt"], _in, meta("tokensIn"), _zero), _zero)
    _completion = F.greatest(F.coalesce(_k["completion"], _out, meta("tokensOut"), _zero), _zero)
    _reasoning = F.greatest(_z(_k["reasoning"]), _zero)
    _creation = F.greatest(_z(_k["cache_creation"]), _zero)
    _parts = _z(_in) + _z(_out)
    _recorded = F.array_compact(F.array(F.coalesce(_k["prompt"], _in), F.coalesce(_k["completion"], _out), _k["reasoning"], _k["cache_creation"], _k["cache_read"]))
    _report_in, _report_out = F.coalesce(_in, _k["prompt"], _zero), F.coalesce(_out, _k["completion"], _zero)
    TOKENS = {
        "tok_anomaly": F.coalesce(positive(_k["total"]), positive(_parts), _z(_k["prompt"]) + _z(_k["completion"])),
        "tok_analytics": F.greatest(_prompt + _completion + _reasoning + _creation, _k["total"]),
        "tok_report_kpi": _report_in + _report_out + _z(_k["reasoning"]),
        "tok_report_attr": F.greatest(_k["total"], _report_in + _report_out + _z(_k["reasoning"])),
        "tok_lens": F.coalesce(_k["total"], F.when(F.size(_recorded) > 0, F.aggregate(_recorded, _zero, lambda a, x: a + x))),
        "tok_diff": F.coalesce(F.nullif(F.coalesce(_k["total"], _parts), _zero), _z(_k["prompt"]) + _z(_k["completion"]) + _z(_k["reasoning"])),
        "tok_compare": F.coalesce(_k["total"], _z(_k["prompt"]) + _z(_k["completion"]) + _z(_k["reasoning"]) + _z(_k["cache_read"]) + _z(_k["cache_creation"])),
        "tok_search": F.coalesce(_k["total"], positive(_parts)),
        "tok_subgraph": _parts + _z(_k["total"]),
        "tok_schema": F.when(F.coalesce(F.col("telemetry.tokens_in.value"), F.col("telemetry.tokens_out.value")).isNotNull(), _z(F.col("telemetry.tokens_in.value")) + _z(F.col("telemetry.tokens_out.value"))),
        "tok_sql": _parts,
        "tok_drawer": F.coalesce(_k["total"], _parts + _z(_k["reasoning"])),
    }
    PROMPT, COMPLETION, REASONING, CREATION, CACHE_READ = _prompt, _completion, _reasoning, _creation, F.greatest(_z(_k["cache_read"]), _zero)
    COST = clamped(F.coalesce(m["cost_usd"], meta("costUsd")))
    _findings = F.coalesce(F.size("findings"), F.lit(0))
    REPAIRS = F.floor(
        F.coalesce(
            clamped(m["repair_rounds"]), clamped(meta("repairRounds")), clamped(m["retries"]),
            F.when(meta("attempt") > 1, meta("attempt") - 1), F.when(meta("round") > 1, meta("round") - 1), F.greatest(_findings, F.lit(0)).cast("double"),
        )
    )
    REPAIRS_RISK = _z(m["retries"]) + _z(m["repair_rounds"])
    MODEL = F.coalesce(_filled(F.col("telemetry.model.value")), _filled(F.col("model")), _filled(F.col("harness_model")), _filled(F.col("host_agent.model")), _filled(meta("model", "string")), F.lit("Unspecified Model"))
    MODEL_REPORT = F.coalesce(_filled(F.col("model")), _filled(F.col("harness_model")), _filled(F.col("host_agent.model")), F.lit("unknown"))
    MODEL_DIFF = F.coalesce(_filled(F.col("model")), _filled(F.col("harness_model")), _filled(F.col("host_agent.model")))
    _known_tier = lambda c: F.when(F.lower(c).isin("xs", "s", "m", "l"), F.lower(c))
    TIER = F.coalesce(_known_tier(F.col("telemetry.model_tier.value")), _known_tier(F.col("tier")), _known_tier(F.col("host_agent.tier")), F.lit("unspecified"))
    _badge = F.try_element_at(F.filter("badges", lambda b: b["variant"].isin(*BADGE_STATUS)), F.lit(1))["variant"]
    _badge_status = F.coalesce(*[F.when(_badge == k, F.lit(v)) for k, v in BADGE_STATUS.items()])
    _said = F.lower(meta("status", "string"))
    STATUS = F.coalesce(_filled(F.col("status")), _badge_status, *[F.when(F.contains(_said, F.lit(s)), F.lit(s)) for s in STATUSES], F.lit("pending"))
    KIND = F.coalesce(_filled(F.col("kind")), F.lit("agent"))
    return {"m": m, "DURATIONS": DURATIONS, "TOKENS": TOKENS, "PROMPT": PROMPT, "COMPLETION": COMPLETION, "REASONING": REASONING, "CREATION": CREATION, "CACHE_READ": CACHE_READ, "COST": COST, "REPAIRS": REPAIRS, "REPAIRS_RISK": REPAIRS_RISK, "MODEL": MODEL, "MODEL_REPORT": MODEL_REPORT, "MODEL_DIFF": MODEL_DIFF, "TIER": TIER, "STATUS": STATUS, "KIND": KIND}


def __getattr__(name: str):
    if name.startswith("__") or name not in NAMES:
        raise AttributeError(name)
    return _columns()[name]


NAMES = {"DURATIONS", "TOKENS", "COST", "CACHE_READ", "STATUS", "REASONING", "CREATION", "REPAIRS", "REPAIRS_RISK", "MODEL_DIFF", "KIND", "PROMPT", "TIER", "COMPLETION", "MODEL", "MODEL_REPORT", "m"}


def label(member: Column) -> Column:
    """A vocabulary member as words in capitals: camel case and separators split."""
    spaced = F.regexp_replace(F.regexp_replace(member, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.trim(F.regexp_replace(spaced, r"[\s_\-.:/]+", " "))
    return F.when(words == "", member).otherwise(F.upper(words))


# Evidence classes from strongest to weakest.
EVIDENCE = ("harness", "host", "agent", "derived", "unknown")


def weakest(*classes: Column) -> Column:
    """The weakest of evidence classes; a missing or unknown member counts as unknown."""
    rank = [F.coalesce(*[F.when(c == e, F.lit(i)) for i, e in enumerate(EVIDENCE)], F.lit(4)) for c in classes]
    return F.element_at(F.array(*map(F.lit, EVIDENCE)), (F.greatest(*rank) if len(rank) > 1 else rank[0]) + 1)
