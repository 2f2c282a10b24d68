"""Event logs as JSON lines: reading with recovery of records that span lines, and normalisation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import prepare_python


def recover(lines: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, str, str]]]:
    """Records (first line, text) and issues (line, text, error): a record may go on over lines until it parses."""
    records, issues, held, first = [], [], "", 0
    for i, line in enumerate(lines):
        if not held and not line.strip():
            continue
        if held and line.startswith("{"):
            try:
                json.loads(line)
                issues.append((first, held, "record never ends"))
                held = ""
            except ValueError:
                pass
        first = i if not held else first
        held = held + "\n" + line if held else line
        try:
            x = json.loads(held)
        except ValueError:
            if not held.lstrip().startswith("{"):
                issues.append((first, held, "not a JSON object"))
                held = ""
            continue
        records.append((first, held)) if isinstance(x, dict) else issues.append((first, held, "not a JSON object"))
        held = ""
    if held:
        issues.append((first, held, "record never ends"))
    return records, issues


def read_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Normalised events and issues of all log files; one file is one log and one task."""
    prepare_python(spark)
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.jsonl)?$", 1).alias("log_id"), F.col("value").alias("text"))

    def f(batches):
        for b in batches:
            for log, text in zip(b["log_id"], b["text"]):
                records, issues = recover(text.split("\n"))
                rows = [(log, i, at, r, None) for i, (at, r) in enumerate(records)] + [(log, None, at, r, e) for at, r, e in issues]
                yield pd.DataFrame(rows, columns=["log_id", "event_index", "line", "text", "error"])

    got = files.mapInPandas(f, "log_id string, event_index long, line long, text string, error string")
    return normalise(got.filter("error is null").select("log_id", "event_index", "text")), got.filter("error is not null").select("log_id", F.col("line").alias("line_index"), F.col("text").alias("raw_text"), "error")


def normalise(records: DataFrame) -> DataFrame:
    """Events from records (log_id, event_index, text): fallbacks for sequence, id, time, kind and actor; flags; summary."""
    g = lambda p: F.get_json_object("text", f"$.{p}")
    kind = F.lower(F.coalesce(g("kind"), g("type"), g("event"), F.lit("unknown")))
    e = records.select(
        "log_id", "event_index", F.coalesce(g("sequence").try_cast("bigint"), g("seq").try_cast("bigint"), F.col("event_index")).alias("sequence"),
        F.coalesce(g("id"), F.concat(F.lit("event-"), F.col("event_index").cast("string"))).alias("id"), F.try_to_timestamp(F.coalesce(g("timestamp"), g("ts"), g("at"))).alias("ts"),
        kind.alias("kind"), F.coalesce(g("actor"), g("agent"), g("payload.agent"), F.lit("system")).alias("actor"), F.coalesce(g("payload"), F.lit("{}")).alias("payload"), g("projection").alias("projection"),
    )
    e = e.withColumns({"is_failure": F.col("kind").rlike("fail|reject|error"), "is_critic": F.col("kind").rlike("critic|review"), "is_milestone": F.col("kind").rlike("compiled|finished|milestone|completed")})
    task = F.coalesce(F.get_json_object("payload", "$.task_id"), F.get_json_object("payload", "$.id"))
    tags = F.array_compact(F.array(F.when(F.col("is_failure"), "failure"), F.when(F.col("is_critic"), "critic"), F.when(F.col("is_milestone"), "milestone")))
    return e.withColumn("summary", F.concat_ws(" ", "kind", task)).withColumn("tags", tags)
