"""The graph data model: many directed property graphs as a bundle of DataFrames keyed by ``graph_id``.

``ord`` is the input position; ties in every operator resolve by it. Absent values are null and stay null: sums of
recorded costs are null until one value is there. Open-ended parts (metadata, context, extras) are JSON strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EVIDENCED = "STRUCT<value:{0},evidence_class:STRING,is_estimated:BOOLEAN>"
_TIMING = "STRUCT<wall:DOUBLE,tool:DOUBLE,active_command:DOUBLE,think:DOUBLE,cognitive:DOUBLE>"

NODES = f"""graph_id STRING, ord BIGINT, id STRING, name STRING, description STRING, type STRING, kind STRING, status STRING,
    step DOUBLE, step_label STRING, rank DOUBLE, `group` STRING, section_id STRING, model STRING, harness_model STRING, tier STRING,
    host_agent STRUCT<name:STRING,model:STRING,tier:STRING,reasoning_effort:STRING,thinking_level:STRING>,
    telemetry STRUCT<agent_id:STRING,role:STRING,model:{_EVIDENCED.format("STRING")},model_tier:{_EVIDENCED.format("STRING")},
        tokens_in:{_EVIDENCED.format("DOUBLE")},tokens_out:{_EVIDENCED.format("DOUBLE")}>,
    metrics STRUCT<duration_ms:DOUBLE,tokens_in:DOUBLE,tokens_out:DOUBLE,cost_usd:DOUBLE,retries:DOUBLE,repair_rounds:DOUBLE,
        tokens:STRUCT<prompt:DOUBLE,completion:DOUBLE,reasoning:DOUBLE,cache_creation:DOUBLE,cache_read:DOUBLE,total:DOUBLE>,
        timing:{_TIMING},timing_breakdown:{_TIMING}>,
    badge_text STRING, badges ARRAY<STRUCT<label:STRING,variant:STRING>>, tools ARRAY<STRUCT<name:STRING,category:STRING>>,
    files ARRAY<STRUCT<path:STRING,mode:STRING,additions:BIGINT,deletions:BIGINT>>,
    findings ARRAY<STRUCT<id:STRING,requirement_id:STRING,severity:STRING,`class`:STRING,observation:STRING,remediation:STRING,status:STRING>>,
    commands ARRAY<STRUCT<id:STRING,argv:ARRAY<STRING>,exit_code:INT,duration_ms:DOUBLE,started_at:STRING,finished_at:STRING,stderr:STRING>>,
    provenance ARRAY<STRUCT<id:STRING,type:STRING,status:STRING,actor:STRING,attempt:INT,duration_ms:DOUBLE,ts:STRING>>,
    prompt STRING, output STRING, logs STRING, metadata STRING, context STRING, extras STRING"""

EDGES = """graph_id STRING, ord BIGINT, id STRING, source STRING, target STRING, label STRING, description STRING, kind STRING,
    condition STRING, is_cycle BOOLEAN, weight DOUBLE, min_len INT, step_number STRING, tokens DOUBLE, traffic_volume DOUBLE,
    container STRUCT<title:STRING,variant:STRING>,
    traffic STRUCT<volume:DOUBLE,tokens:DOUBLE,bytes:DOUBLE,messages_count:DOUBLE,avg_latency_ms:DOUBLE,status:STRING>,
    exchanges ARRAY<STRUCT<id:STRING,type:STRING,status:STRING,verdict:STRING,tokens:DOUBLE,duration_ms:DOUBLE,summary:STRING,severity:STRING>>,
    extras STRING"""

SECTIONS = "graph_id STRING, ord BIGINT, id STRING, title STRING, description STRING, type STRING, parent_node_id STRING, status STRING, node_ids ARRAY<STRING>"
SPANS = """graph_id STRING, ord BIGINT, id STRING, parent_id STRING, name STRING, agent_id STRING, tier STRING, status STRING,
    category STRING, start_ms DOUBLE, end_ms DOUBLE, tokens DOUBLE, cost_usd DOUBLE"""


def fields(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of a schema: cast where there, null where not; structs are filled field by field."""
    return df.select(*[_conformed(F.col(f"`{f.name}`") if f.name in df.columns else None, f.dataType, df.schema[f.name].dataType if f.name in df.columns else None).alias(f.name) for f in fields(ddl)])


def _conformed(value: Column | None, want: T.DataType, have: T.DataType | None) -> Column:
    if value is None or have is None or isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name: f.dataType for f in have}
        parts = [_conformed(value.getField(f.name) if f.name in own else None, f.dataType, own.get(f.name)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType) and isinstance(want.elementType, T.StructType):
        return F.transform(value, lambda x: _conformed(x, want.elementType, have.elementType))
    return value.cast(want)


@dataclass(frozen=True)
class GraphFrames:
    """Graphs as lazily built tables; operators take this and return DataFrames."""

    nodes: DataFrame
    edges: DataFrame
    sections: DataFrame | None = None

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, sections: DataFrame | None = None) -> GraphFrames:
        return GraphFrames(conform(nodes, NODES), conform(edges, EDGES), None if sections is None else conform(sections, SECTIONS))

    @staticmethod
    def empty(spark: SparkSession) -> GraphFrames:
        return GraphFrames(*(spark.createDataFrame([], d) for d in (NODES, EDGES, SECTIONS)))

    def valid_edges(self) -> DataFrame:
        """Edges whose ends are both nodes of their graph."""
        ids = self.nodes.select("graph_id", "id")
        for end in ("source", "target"):
            self_ids = ids.withColumnRenamed("id", end)
            edges = (self.edges if end == "source" else edges).join(self_ids, ["graph_id", end], "left_semi")  # noqa: F821
        return edges
