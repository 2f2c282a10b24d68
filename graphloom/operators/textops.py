"""Shell-style text operators over tables of lines (ord, line), and pipelines of them."""

from __future__ import annotations

import re
import shlex

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import numbered, stage, with_offsets


def _numbered(df: DataFrame) -> DataFrame:
    return numbered(df.withColumnRenamed("ord", "_ord"), [F.col("_ord")], "ord").drop("_ord").select(*df.columns)


def grep(df: DataFrame, pattern: str, i: bool = False, v: bool = False, n: bool = False, c: bool = False) -> DataFrame:
    hit = F.col("line").rlike(("(?i)" if i else "") + pattern)
    out = df.filter(~hit if v else hit)
    if c:
        return out.agg(F.lit(0).cast("bigint").alias("ord"), F.count(F.lit(1)).cast("string").alias("line"))
    return out.select("ord", F.concat((F.col("ord") + 1).cast("string"), F.lit(":"), F.col("line")).alias("line")) if n else out


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy("ord").limit(n)


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("ord")).limit(n)


def wc(df: DataFrame, l: bool = False, w: bool = False, c: bool = False) -> DataFrame:  # noqa: E741
    words = F.size(F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    sums = df.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes"))
    cols = [x for x, on in (("lines", l), ("words", w), ("bytes", c)) if on] or ["lines", "words", "bytes"]
    return sums.select(F.lit(0).cast("bigint").alias("ord"), F.concat_ws(" ", *[F.col(x).cast("string") for x in cols]).alias("line"))


def sort(df: DataFrame, r: bool = False, n: bool = False, u: bool = False) -> DataFrame:
    key = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*(-?\d+\.?\d*)", 1), F.lit("")).try_cast("double"), F.lit(0.0)) if n else F.col("line")
    df = df.groupBy("line").agg(F.min("ord").alias("ord")) if u else df
    by = [F.desc(key) if r else F.asc(key), F.desc("line") if r else F.asc("line"), F.asc("_ord")]
    return numbered(df.withColumnRenamed("ord", "_ord"), by, "ord").select("ord", "line")


def uniq(df: DataFrame, c: bool = False, d: bool = False, u: bool = False) -> DataFrame:
    """Runs of adjoining equal lines: one each, with counts (c), only repeated (d) or only single ones (u)."""
    lines = stage(numbered(df, [F.col("ord")], "_nth"), "lines")
    before = lines.select((F.col("_nth") + 1).alias("_nth"), F.col("line").alias("_before"))
    lines = lines.join(before, "_nth", "left").withColumn("new", F.when(F.col("_before") == F.col("line"), 0).otherwise(1)).withColumn("_bucket", F.shiftright("_nth", 12))
    lines = with_offsets(lines, [], "_bucket", F.col("new"), "_runs")
    within = Window.partitionBy("_bucket").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("run", F.col("_runs") + F.sum("new").over(within)).groupBy("run").agg(F.min("ord").alias("ord"), F.first("line").alias("line"), F.count(F.lit(1)).alias("k"))
    runs = runs.filter("k > 1") if d else runs.filter("k = 1") if u else runs
    return runs.select("ord", F.format_string("%7d %s", "k", "line").alias("line") if c else F.col("line"))


def _command(df: DataFrame | None, words: list[str], files: dict[str, DataFrame]) -> DataFrame:
    name, rest = words[0], words[1:]
    flags = "".join(x[1:] for x in rest if re.fullmatch(r"-[a-z]+", x))
    numbers = [int(m[1]) for x in rest if (m := re.fullmatch(r"-?n?(\d+)", x))]
    plain = [x for x in rest if not x.startswith("-") and not x.isdigit()]
    if name == "cat":
        out = None
        for f in plain:
            out = files[f] if out is None else out.unionByName(files[f].withColumn("ord", F.col("ord") + (1 << 40)))
        return out if out is not None else df
    pattern = plain.pop(0) if name == "grep" else ""
    df = files[plain[0]] if plain else df
    if name == "grep":
        return grep(df, pattern, **{k: k in flags for k in "ivnc"})
    if name in ("head", "tail"):
        return {"head": head, "tail": tail}[name](df, numbers[0] if numbers else 10)
    if name == "wc":
        return wc(df, **{k: k in flags for k in "lwc"})
    if name == "sort":
        return sort(df, **{k: k in flags for k in "rnu"})
    if name == "uniq":
        return uniq(df, **{k: k in flags for k in "cdu"})
    raise ValueError(f"{name}: command not found")


def split_unquoted(line: str, marks: tuple[str, ...]) -> list[tuple[str, str]]:
    """Parts of a command line with the mark before each, quotes respected."""
    out, mark, begin, quote, i = [], "", 0, "", 0
    while i < len(line):
        if quote:
            quote = "" if line[i] == quote else quote
        elif line[i] in "'\"":
            quote = line[i]
        elif hit := next((m for m in marks if line.startswith(m, i)), None):
            out.append((mark, line[begin:i].strip()))
            mark, begin = hit, i + len(hit)
            i = begin
            continue
        i += 1
    return [*out, (mark, line[begin:].strip())]


def shell(line: str, files: dict[str, DataFrame], variables: dict[str, str] | None = None) -> DataFrame | None:
    """Run pipelines joined by ;, && and ||, with > and >> into ``files``; the last one's output."""
    for k, v in sorted((variables or {}).items(), key=lambda x: -len(x[0])):
        line = line.replace("${" + k + "}", v).replace("$" + k, v)
    ok, out = True, None
    for mark, part in split_unquoted(line, ("&&", "||", ";")):
        if not part or mark == "&&" and not ok or mark == "||" and ok:
            continue
        try:
            pipe, target, more = part, None, False
            for m, redirected in split_unquoted(part, (">>", ">")):
                if m:
                    target, more = redirected, m == ">>"
                else:
                    pipe = redirected
            out = None
            for _, command in split_unquoted(pipe, ("|",)):
                out = _command(out, shlex.split(command), files)
            if target:
                old = files.get(target)
                files[target] = old.unionByName(out.withColumn("ord", F.col("ord") + (1 << 41))) if more and old is not None else out
            ok = True
        except (ValueError, KeyError):
            ok = False
    return out
