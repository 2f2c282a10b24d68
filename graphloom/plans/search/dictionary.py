"""Value suggestions from a dictionary that is built once: each field's distinct values with how often they occur.

Dictionaries are tables sorted by field and lower-cased value, so a prefix is a range of keys that reaches the scan as a
filter; those of several graphs or days merge by adding counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.runtime import scratch_path
from graphloom.schema import GraphFrames

# Names of the fields that have values to suggest, and where these are kept.
FIELDS = {
    "model": "models", "llm": "models", "harnessmodel": "models", "tool": "tools", "tools": "tools", "scope": "scopes", "writescope": "scopes", "files": "scopes",
    "file": "scopes", "path": "scopes", "actor": "actors", "actorid": "actors", "agent": "actors", "leaseagent": "actors", "section": "sections", "sectionid": "sections",
    "group": "sections", "type": "types", "kind": "types", "archetype": "types", "status": "statuses", "state": "statuses",
}


def _pairs(sources: dict[str, list[Column]]) -> Column:
    """(field, value) structs of single texts and of arrays of texts."""

    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))

    return F.explode(F.concat(*[named(name, c) for name, columns in sources.items() for c in columns]))


def _one(c: Column) -> Column:
    return F.array(c.cast("string"))


def value_counts(g: GraphFrames) -> DataFrame:
    """(field, value, n): every distinct value of the suggested fields and the number of its occurrences, in one pass."""
    none = F.array().cast("array<string>")
    of = lambda array, name: F.coalesce(F.transform(array, lambda x: x[name]), none)
    scope = F.coalesce(F.expr("try_variant_get(try_parse_json(metadata), '$.writeScope', 'array<string>')"), none)
    nodes = g.nodes.select(_pairs({
        "models": [_one(F.col("model")), _one(F.col("harness_model")), _one(F.col("host_agent.model"))], "tools": [of("tools", "name")],
        "scopes": [scope, of("files", "path"), _one(M.meta("repoPath", "string", "context"))],
        "actors": [_one(M.meta("leaseAgent", "string")), _one(F.col("host_agent.name")), _one(M.meta("actorId", "string"))],
        "sections": [_one(F.col("section_id")), _one(F.col("group"))], "types": [_one(F.col("kind")), _one(F.col("type"))], "statuses": [_one(F.col("status"))],
    }).alias("p"))
    edges = g.edges.select(_pairs({"types": [_one(F.col("kind"))], "statuses": [_one(F.col("traffic.status"))]}).alias("p"))
    every = nodes.unionByName(edges).select("p.field", "p.value").filter("value is not null and value <> ''")
    return every.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def merge(*dictionaries: DataFrame) -> DataFrame:
    """One dictionary of several."""
    whole = dictionaries[0]
    for d in dictionaries[1:]:
        whole = whole.unionByName(d)
    return whole.groupBy("field", "value").agg(F.sum("n").alias("n"))


def store(counts: DataFrame, path: str | None = None) -> DataFrame:
    """Write a dictionary sorted by field and key, the lower-cased value, and read it back."""
    spark = counts.sparkSession
    path = path or scratch_path(spark, "dictionary")
    keyed = counts.withColumn("key", F.lower("value"))
    keyed.repartitionByRange("field", "key").sortWithinPartitions("field", "key").write.parquet(path)
    return spark.read.schema(keyed.schema).parquet(path)


def completions(dictionary: DataFrame, field: str, begun: str = "", limit: int = 10) -> DataFrame:
    """The values of a field (by any of its names) that begin with a text, whatever its case: the most frequent first."""
    kept = FIELDS.get(field.lower().replace("-", "").replace("_", ""))
    low = begun.lower()
    d = dictionary.filter((F.col("field") == kept) if kept else F.lit(False))
    if low:
        d = d.filter(F.col("key").startswith(low) & (F.col("key") >= low))
    return d.orderBy(F.desc("n"), "value").limit(limit).select("value", "n")
