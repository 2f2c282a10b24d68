"""Quality rules: per-document heuristics and cross-document line frequency.

Lines are normalised and hashed. A line that stands in too many distinct documents of a host is boilerplate and is
removed; documents left with too little are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import join_decisions, or_empty, words
from graphloom.runtime import broadcast_if_few, let, stage

#: A line is boilerplate if more than MAX_DOCS distinct documents of its host have it ...
MAX_DOCS = 20
#: ... and these are more than this percentage of the host's documents.
MAX_PERCENT = 1
#: A document is depleted if fewer words remain, or a smaller percentage of its words. (Short texts fail the base rules.)
MIN_WORDS = 10
MIN_PERCENT = 30

_LINE_SPACE = r"[\x20\x09\x0B-\x0D]+"


def _hashes(w: Column, step: int) -> Column:
    """From hashes of n-word windows those of windows of n + step words; the last ``step`` of them are void."""
    return F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + step)))


def _repeated(w: Column, n: Column) -> Column:
    """Words inside 8-word windows whose hash stands twice or more in ``w``, an array of window hashes with n valid."""
    at = F.transform(F.slice(w, 1, n), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    twice = let(
        F.array_sort(at),
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    covered = let(
        twice,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(p, i + 1) - x, F.lit(8)))),
            F.lit(0),
            lambda a, b: a + b,
        ),
    )
    return covered


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row the base statistics, and its lines as (hash, words): all that later steps need, without the text."""
    t = or_empty(text)
    d = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), t.alias("t"))
    d = d.withColumn("_hash", F.xxhash64("t"))
    d = d.withColumn("w", words(F.col("t")))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("word_chars", F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"))
    real = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    d = d.withColumn("real", real)
    d = d.withColumn("n_dup_lines", (F.size("real") - F.size(F.array_distinct("real"))).cast("long")).drop("real")
    d = d.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x))).drop("w")
    d = d.withColumn("h2", _hashes(F.col("h1"), 1)).drop("h1")
    d = d.withColumn("h4", _hashes(F.col("h2"), 2)).drop("h2")
    # A repeated 8-word window repeats its 4-word windows too: where none does, as in most texts, nothing else is done.
    four = F.slice("h4", 1, F.greatest(F.col("n_words").cast("int") - 3, F.lit(0)))
    some = F.size(F.array_distinct(four)) < F.size(four)
    n = F.greatest(F.col("n_words").cast("int") - 7, F.lit(0))
    d = d.withColumn("h8", F.when(some, _hashes(F.col("h4"), 4))).drop("h4")
    d = d.withColumn("n_repeat_words", F.when(F.col("h8").isNull(), 0).otherwise(_repeated(F.col("h8"), n)).cast("long")).drop("h8")
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    flat = F.lower(F.regexp_replace("t", _LINE_SPACE, " "))
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(x))
    d = d.withColumn("norm", F.filter(lines, lambda x: x != "")).drop("t")
    lines = F.transform(
        F.col("norm"),
        lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("n")),
    )
    return d.withColumn("lines", lines).drop("norm")


def frequent_lines(stats: DataFrame, max_docs: int = MAX_DOCS, max_percent: float = MAX_PERCENT) -> DataFrame:
    """``(host, h, n_docs)`` of lines that too many distinct documents of a host have.

    Rows of one whole text are one document, so exact copies count once: in the line's count and in the host's total, of
    which ``max_percent`` is taken. Documents whose texts differ count each, near copies too.
    """
    s = stats.select("host", "_hash", F.array_distinct(F.col("lines.h")).alias("hs")).dropDuplicates(["host", "_hash"])
    per = s.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
    per = per.filter(F.col("n_docs") > max_docs)
    hosts = s.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    a, b = per.alias("a"), broadcast_if_few(hosts).alias("b")
    hot = a.join(b, F.col("a.host").eqNullSafe(F.col("b.host"))).filter(F.col("n_docs") * 100 > F.col("total") * max_percent)
    return hot.select("a.host", "h", "n_docs")


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS,
    max_percent: float = MAX_PERCENT, min_words: int = MIN_WORDS, min_percent: float = MIN_PERCENT,
) -> DataFrame:
    """One row per input row: ``key``, base statistics, base_failed, removed_words, kept, bad_lines, ``_hash`` of the text.

    ``kept`` is false if the base rules fail or the document is depleted: after removal of the frequent lines under
    ``min_words`` words or ``min_percent`` percent of its words are left. Null text is empty and fails; null is a host
    of its own. Repeated rows and rows of one id are judged each by its own text, and count as one document of their host
    where the texts are equal. An empty table gives no rows. A text of any length is one row of arrays of its words and
    lines, some tens of times its size. Other columns of ``docs`` are not read.
    """
    stats = document_statistics(docs, key, text, host).withColumn("_row", F.monotonically_increasing_id())
    stats = stage(stats, "statistics")
    hot = broadcast_if_few(stage(frequent_lines(stats, max_docs, max_percent), "frequent"))
    lines = stats.select("_row", "host", F.explode("lines").alias("line")).select("_row", "host", "line.h", "line.n")
    a, b = lines.alias("a"), hot.alias("b")
    cut = a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.h") == F.col("b.h")))
    cut = cut.groupBy("a._row").agg(F.sum("n").alias("removed_words"), F.collect_set("a.h").alias("bad_lines"))
    out = stats.drop("lines", "host").join(cut, "_row", "left").drop("_row")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & (left >= min_words) & (100 * left >= min_percent * F.col("n_words"))
    return out.withColumn("kept", kept).withColumnRenamed("id", key)


def apply_quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` that are kept, without their frequent lines, in their own columns; ``n_chars``, if there, follows the text.

    Null and empty texts fail the base rules and go. Rows of one id and text that stand in several hosts share the
    smallest verdict and lose the frequent lines of all these hosts. An empty table stays empty.
    """
    verdicts = stage(quality_rules(docs, key, text, host), "verdicts")
    changes = verdicts.filter(~F.col("kept") | F.col("bad_lines").isNotNull())
    # Equal texts of one id may differ in host; a row each is kept for every host, and the smallest verdict holds.
    changes = changes.groupBy(*content_key_of(key)).agg(F.min("kept").alias("_kept"), F.array_distinct(F.flatten(F.collect_list("bad_lines"))).alias("_bad"))
    d = join_decisions(docs, changes, "left", key, text).filter(F.coalesce(F.col("x._kept"), F.lit(True)))
    line_hash = lambda x: F.xxhash64(F.trim(F.lower(F.regexp_replace(x, _LINE_SPACE, " "))))
    old = F.col(f"d.`{text}`")
    new = F.array_join(F.filter(F.split(old, "\n"), lambda x: ~F.array_contains(F.col("x._bad"), line_hash(x))), "\n")
    changed = F.col("x._bad").isNotNull() & (F.size("x._bad") > 0)
    new = F.when(changed, new).otherwise(old)
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(new.alias(c))
        elif c == n_chars:
            cols.append(F.when(changed, F.length(new)).otherwise(F.col(f"d.`{c}`")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"d.`{c}`"))
    return d.select(*cols)


def content_key_of(key: str) -> list[Column]:
    return [F.col(key).alias("_id"), F.col("_hash")]
