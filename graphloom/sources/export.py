"""Sinks: relational tables with DDL and INSERT text, relational JSON, diagram texts, reports, a layout cache."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.functions.scalars import safe_identifier, sql_literal
from graphloom.schema import GraphFrames


def relational(g: GraphFrames) -> dict[str, DataFrame]:
    """The normalised tables of a bundle of graphs."""
    n, e = g.nodes, g.edges
    sections = g.sections if g.sections is not None else n.sparkSession.createDataFrame([], "graph_id string, id string, title string, type string, ord bigint, node_ids array<string>")
    out = {
        "graphs": n.groupBy("graph_id").agg(F.count(F.lit(1)).alias("node_count")).join(e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count")), "graph_id", "left").fillna(0),
        "nodes": n.select("graph_id", "id", "name", "kind", M.STATUS.alias("status"), "step", "section_id", "model", "tier"),
        "edges": e.select("graph_id", "id", "source", "target", F.coalesce("kind", F.lit("sequence")).alias("kind"), "label", "condition", F.coalesce("is_cycle", F.lit(False)).alias("is_cycle")),
        "sections": sections.select("graph_id", "id", "title", "type"),
        "section_nodes": sections.select("graph_id", F.col("id").alias("section_id"), F.posexplode("node_ids").alias("pos", "node_id")),
        "node_metrics": n.select("graph_id", F.col("id").alias("node_id"), M.DURATIONS["dur_recorded"].alias("duration_ms"), M.TOKENS["tok_sql"].alias("tokens"), M.m["cost_usd"].alias("cost_usd"), M.m["retries"].alias("retries")),
        "node_tools": n.select("graph_id", F.col("id").alias("node_id"), F.posexplode("tools").alias("pos", "t")).select("graph_id", "node_id", "pos", "t.name", "t.category"),
        "node_files": n.select("graph_id", F.col("id").alias("node_id"), F.posexplode("files").alias("pos", "f")).select("graph_id", "node_id", "pos", "f.path", "f.mode"),
        "annotations": n.select("graph_id", F.col("id").alias("node_id"), F.posexplode("findings").alias("pos", "f")).select("graph_id", "node_id", "pos", F.col("f.severity").alias("severity"), F.col("f.observation").alias("text")),
        "provenance_events": n.select("graph_id", F.col("id").alias("node_id"), F.posexplode("provenance").alias("pos", "p")).select("graph_id", "node_id", "pos", F.col("p.type").alias("type"), F.col("p.actor").alias("actor"), F.col("p.ts").alias("ts")),
    }
    return out


# SQL types of the dialects.
DIALECTS = {
    "sqlite": {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"},
    "postgres": {"string": "TEXT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN"},
    "mysql": {"string": "TEXT", "bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "boolean": "TINYINT(1)"},
}


def ddl(tables: dict[str, DataFrame], dialect: str = "sqlite", prefix: str = "", drop: bool = False) -> str:
    quote = "`" if dialect == "mysql" else '"'
    out = []
    for name, df in tables.items():
        cols = ",\n".join(f"  {quote}{f.name}{quote} {DIALECTS[dialect].get(f.dataType.simpleString(), 'TEXT')}" for f in df.schema)
        out += [f"DROP TABLE IF EXISTS {quote}{prefix}{name}{quote};"] * drop + [f"CREATE TABLE {quote}{prefix}{name}{quote} (\n{cols}\n);"]
    return "\n".join(out)


def inserts(df: DataFrame, name: str) -> DataFrame:
    """An INSERT statement a row, made on the executors."""
    values = F.concat_ws(", ", *[sql_literal(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema])
    names = ", ".join(f'"{c}"' for c in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{name}" ({names}) VALUES ('), values, F.lit(");")).alias("statement"))


def relational_json(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tables as (table_name, row) JSON."""
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(t).alias("table_name"), F.to_json(F.struct("*")).alias("row")) for t, df in tables.items()])


def _lines(parts: DataFrame, head: str, tail: str) -> DataFrame:
    """One text a graph from (graph_id, part, ord, line)."""
    t = parts.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("x"))
    return t.select("graph_id", F.concat_ws("\n", F.lit(head), F.array_join("x.line", "\n"), F.lit(tail) if tail else F.lit(None)).alias("text"))


def mermaid(g: GraphFrames, direction: str = "TD") -> DataFrame:
    name = lambda c: safe_identifier(F.col(c))
    label = F.replace(F.coalesce("name", "id"), F.lit('"'), F.lit("'"))
    n = g.nodes.select("graph_id", F.lit(0).alias("part"), "ord", F.concat(F.lit("  "), name("id"), F.lit('["'), label, F.lit('"]')).alias("line"))
    arrow = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" -->|"), F.col("label"), F.lit("| "))).otherwise(F.lit(" --> "))
    e = g.edges.select("graph_id", F.lit(1).alias("part"), "ord", F.concat(F.lit("  "), name("source"), arrow, name("target")).alias("line"))
    return _lines(n.unionByName(e), f"flowchart {direction}", "")


def mermaid_sections(g: GraphFrames, direction: str = "TD") -> DataFrame:
    """The form of extracted subgraphs: sections as boxes in order of their first node, other nodes, then edges by kind.

    Spawns and dispatches are dotted, pushbacks and critics thick; a label is an edge's label, else its condition.
    """
    name = lambda c: safe_identifier(F.col(c))
    plain = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    n = g.nodes.select("graph_id", "ord", F.col("section_id").alias("section"), F.concat(name("id"), F.lit('["'), plain(F.coalesce("name", "id")), F.lit('"]')).alias("node"))
    first = n.filter("section is not null").groupBy("graph_id", "section").agg(F.min("ord").alias("begin"))
    line = lambda df, part, ord_, text: df.select("graph_id", F.lit(part).alias("part"), *ord_, text.alias("line"))
    place = lambda a, b, c: (a.alias("a"), F.lit(b).alias("b"), c.alias("c"))
    boxed = n.join(first, ["graph_id", "section"])
    rows = [
        line(first, 0, place(F.col("begin"), 0, F.lit(0).cast("long")), F.concat(F.lit("  subgraph "), name("section"), F.lit(' ["'), plain(F.col("section")), F.lit('"]'))),
        line(boxed, 0, place(F.col("begin"), 1, F.col("ord")), F.concat(F.lit("    "), F.col("node"))),
        line(first, 0, place(F.col("begin"), 2, F.lit(0).cast("long")), F.lit("  end")),
        line(n.filter("section is null"), 1, place(F.col("ord"), 0, F.lit(0).cast("long")), F.concat(F.lit("  "), F.col("node"))),
    ]
    arrow = F.when(F.col("kind").isin("spawn", "dispatch"), " -.->").when(F.col("kind").isin("pushback", "critic"), " ==>").otherwise(" -->")
    said = F.coalesce(F.nullif("label", F.lit("")), F.nullif("condition", F.lit("")))
    label = F.when(said.isNotNull(), F.concat(F.lit('|"'), plain(said), F.lit('"|'))).otherwise("")
    rows.append(line(g.edges, 2, place(F.col("ord"), 0, F.lit(0).cast("long")), F.concat(F.lit("  "), name("source"), arrow, label, F.lit(" "), name("target"))))
    t = reduce(DataFrame.unionByName, rows).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "c", "line"))).alias("x"))
    return t.select("graph_id", F.concat_ws("\n", F.lit(f"flowchart {direction}"), F.array_join("x.line", "\n")).alias("text"))


def dot(g: GraphFrames) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = g.nodes.select("graph_id", F.lit(0).alias("part"), "ord", F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), quoted(F.coalesce("name", "id")), F.lit("];")).alias("line"))
    e = g.edges.select("graph_id", F.lit(1).alias("part"), "ord", F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(";")).alias("line"))
    return _lines(n.unionByName(e), "digraph {", "}")


def documents(g: GraphFrames) -> DataFrame:
    """Each graph as a JSON document again."""
    n = g.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in g.nodes.columns if c not in ("graph_id", "ord")]).alias("x")))).alias("n"))
    e = g.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in g.edges.columns if c not in ("graph_id", "ord")]).alias("x")))).alias("e"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct(F.col("graph_id").alias("id"), F.col("n.x").alias("nodes"), F.coalesce(F.col("e.x"), F.array()).alias("edges"))).alias("text"))


def markdown_report(scores: DataFrame, limit: int = 20) -> str:
    """A Markdown table of a small result; a report, so the first rows alone reach the driver."""
    rows = scores.limit(limit).collect()
    head = "| " + " | ".join(scores.columns) + " |\n|" + "---|" * len(scores.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])


def html_report(scores: DataFrame, title: str, limit: int = 20) -> str:
    rows = scores.limit(limit).collect()
    cells = lambda xs, tag: "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in xs)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><table><tr>{cells(scores.columns, 'th')}</tr>{body}</table>"


class LayoutCache:
    """Layouts as Parquet keyed by a document's signature; an entry is its own partition, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, signature: str, positions: DataFrame) -> None:
        positions.write.mode("overwrite").parquet(f"{self.path}/signature={signature}")

    def get(self, signature: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/signature={signature}/_SUCCESS")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.path}/signature={signature}") if fs.exists(path) else None
