"""Scalar functions: text similarity, classification, normalisation, formatting, geometry, hashing. All are Columns."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up towards positive infinity, unlike SQL's half away from zero."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def leading_number(text: Column) -> Column:
    """The number a text begins with, as a lenient parser reads it; else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")


def sanitised(x: Column, fallback: float, low: float | None = None, high: float | None = None) -> Column:
    """``fallback`` for null, NaN and infinities; else clamped."""
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float(fallback))).otherwise(x)
    x = F.greatest(x, F.lit(float(low))) if low is not None else x
    return F.least(x, F.lit(float(high))) if high is not None else x


# Error classes in the order of their tests, each with the words that mark it.
ERROR_WORDS = {
    "rate_limit_quota": ("rate limit", "429", "quota exceeded", "throttled", "too many requests"),
    "timeout_deadlock": ("timed out", "timeout", "deadline exceeded", "lease expired", "deadlock"),
    "validation_rejection": ("validation reject", "validation gate", "validator reject", "validation failure", "gate rejection", "audit finding", "proof missing", "rejection", "validator", "revalidation"),
    "test_assertion": ("assertion failed", "expect(", "vitest", "bun test", "failed test", "tests failed", "assertion error", "assert", "jest"),
    "lint_format": ("oxlint", "eslint", "prettier", "linter", "lint violation", "style violation", "format error", "lint"),
    "command_failure": ("exit code", "command failed", "spawn error", "sh:", "bash:", "shell error", "process exited"),
    "syntax_type": ("typescript", "type error", "typeerror", "syntax error", "cannot find name", "parse error"),
}
SYNTAX_PATTERN = r"\b(ts\d{4}|syntax|typescript|type)\b"


def error_class(message: Column) -> Column:
    low, out = F.lower(message), None
    for name, words in ERROR_WORDS.items():
        hit = None
        for w in words:
            hit = F.contains(low, F.lit(w)) if hit is None else hit | F.contains(low, F.lit(w))
        if name == "syntax_type":
            hit = hit | low.rlike(SYNTAX_PATTERN)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("runtime_unhandled"))


def normalised(x: Column, low: Column, high: Column, scale: str = "linear", ecdf: Column | None = None) -> Column:
    """To [0, 1] by a linear, log10, sqrt or quantile scale; 0.5 where there is no range."""
    if scale == "quantile":
        return F.when(high <= low, F.lit(0.5)).otherwise(ecdf)
    part = F.least(F.greatest(x, low), high) - low
    span = high - low
    f = {"linear": lambda v: v, "log": lambda v: F.log10(v + 1), "sqrt": F.sqrt}[scale]
    return F.when(span <= 0, F.lit(0.5)).otherwise(f(part) / f(F.when(span > 0, span).otherwise(F.lit(1.0))))


def metric_delta(base: Column, comp: Column, digits: int = 2) -> Column:
    """Struct of absolute and percentage change; from 0 the percentage is 100 with the change's sign, or 0."""
    change = comp - base
    percent = F.when(base == 0, F.when(change == 0, F.lit(0.0)).otherwise(F.signum(change) * 100.0)).otherwise(change / F.abs(F.nullif(base, F.lit(0.0))) * 100)
    return F.struct(js_round(change, digits).alias("delta"), js_round(percent, digits).alias("percent"))


def format_duration(ms: Column) -> Column:
    """Milliseconds below a second, then seconds with one decimal, then minutes and seconds, then hours and minutes."""
    s = ms / 1000
    return (
        F.when(ms.isNull(), F.lit(None))
        .when(ms < 1000, F.concat(F.format_string("%d", js_round(ms).cast("long")), F.lit("ms")))
        .when(s < 60, F.concat(F.format_string("%.1f", s), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), js_round(s % 60).cast("long").cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))
    )


def format_tokens(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k")))
        .otherwise(n.cast("long").cast("string"))
    )


def format_cost(usd: Column) -> Column:
    return F.when(usd < 0.01, F.concat(F.lit("$"), F.format_string("%.4f", usd))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", usd)))


def safe_identifier(text: Column) -> Column:
    """For diagram languages: letters, digits and underscores, never beginning with a digit."""
    clean = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("n_"), clean)).otherwise(clean)


def sql_literal(value: Column, kind: str) -> Column:
    """A value as a SQL literal: NULL, numbers (not finite: NULL), 1 or 0, or a quoted string."""
    if kind in ("double", "float"):
        return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit("NULL")).otherwise(value.cast("string"))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.coalesce(value.cast("string"), F.lit("NULL"))
    if kind == "boolean":
        return F.when(value.isNull(), F.lit("NULL")).otherwise(F.when(value, F.lit("1")).otherwise(F.lit("0")))
    text = value if kind == "string" else F.to_json(value)
    return F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def rolling_hash(text: Column, modulus: int = 1 << 32) -> Column:
    """h * 31 + code over the characters, kept below ``modulus``: stable accents and hues."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % modulus)


def backoff_delay(attempt: Column, initial: float = 1000, factor: float = 2, most: float = 30_000, jitter: Column | None = None, mode: str = "none") -> Column:
    """Reconnect delays: exponential up to ``most``, with no, full or equal jitter from a uniform column."""
    raw = F.least(F.lit(float(most)), initial * F.pow(F.lit(float(factor)), attempt))
    if mode == "full":
        return raw * jitter
    return raw / 2 + raw / 2 * jitter if mode == "equal" else raw


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[0-9;?]*[ -/]*[@-~]", "")


# Parts of agent ids by the role they tell, in the order of their tests; severities of event types.
ROLE_PARTS = {
    "orchestrator": ("orchestrator", "meta", "coord", "root"), "critic": ("critic", "review", "eval"), "validator": ("validator", "val-", "-val", "val_", "audit", "check"),
    "system": ("system", "engine", "harness"), "user": ("user",), "implementer": ("impl", "worker", "dev", "coder"),
}
SEVERITY_OF = {"validation_rejected": "reject", "error": "reject", "validation_approved": "approve", "critic_approved": "approve", "warn": "warn"}


def inferred_role(agent_id: Column) -> Column:
    """The role that an agent's id tells, implementer if none."""
    low, out = F.lower(agent_id), None
    for role, parts in ROLE_PARTS.items():
        hit = low.rlike("|".join(parts))
        out = F.when(hit, F.lit(role)) if out is None else out.when(hit, F.lit(role))
    return out.otherwise(F.lit("implementer"))


def inferred_severity(event_type: Column) -> Column:
    return F.coalesce(*[F.when(event_type == k, F.lit(v)) for k, v in SEVERITY_OF.items()], F.lit("info"))


def transition_kind(verdict: Column, finding_class: Column, to: Column) -> Column:
    """Whether a state change is a probe (it demands proof), a pushback (it asserts a defect), or plain."""
    said, kind = F.lower(F.coalesce(verdict, F.lit(""))), F.lower(F.coalesce(finding_class, F.lit("")))
    probe = (said == "probe") | (kind == "probe_demand")
    push = said.isin("reject", "fail") | (kind == "defect") | F.coalesce(to == "rejected", F.lit(False))
    return F.when(probe, F.lit("probe")).when(push, F.lit("pushback")).otherwise(F.lit("plain"))


# ---- geometry


def in_rect(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    """Point in rectangle, border included."""
    return x.between(F.lit(x0), F.lit(x1)) & y.between(F.lit(y0), F.lit(y1))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule; points on the border are inside."""
    odd, border = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        border = border | ((F.abs(cross) < 1e-9) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            odd = odd != hit
    return border | odd


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments a-b and c-d properly cross."""
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    return (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0)


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull by two chains over sorted points, counter-clockwise, without points on its sides."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


# ---- sequential text functions, as Arrow-batched UDFs


# Bases, bonuses and penalties of the palette's five tiers.
EXACT, EXACT_SHORT = 1000, 100
PREFIX, PREFIX_REST, PREFIX_MOST = 800, 2, 200
WORD, WORD_PLACE, WORD_REST, WORD_MOST = 650, 20, 2, 100
INITIALS, INITIALS_SHORT = 550, 50
LETTERS, LETTERS_SHORT, LETTERS_LEAST = 100, 100, 10
START_BONUS, RUN_BONUS = 35, 20
GAP_COST, GAP_MOST, FIRST_COST, FIRST_MOST = 2, 30, 3, 40
_BREAK = r"[\s\-_/.]"


def fuzzy_score(query: str, text: Column) -> Column:
    """Command-palette score of a text, 0 if none, null for null: the first tier that fits of exact, prefix, prefix of a
    word, initials, letters in order. All tiers are built-in expressions; the query is a constant.

    For the last tier a pattern with a lazy gap before each letter finds the leftmost places; the score follows from the gaps.
    """
    q = query.strip().lower()
    if not q:
        return F.when(text.isNotNull(), F.lit(0.0))
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    low, n, m = F.lower(t), F.length(t), len(q)
    prefix = PREFIX - F.least(F.lit(PREFIX_MOST), PREFIX_REST * (n - m))
    words = F.transform(F.split(low, f"{_BREAK}+"), lambda w, i: F.when(F.startswith(w, F.lit(q)), WORD - WORD_PLACE * i - F.least(F.lit(WORD_MOST), WORD_REST * (F.length(w) - m))))
    word = F.get(F.filter(words, lambda x: x.isNotNull()), F.lit(0))
    initials = F.lower(F.array_join(F.regexp_extract_all(t, F.lit(f"(?:^|(?<={_BREAK})|(?<=[a-z])(?=[A-Z]))([a-zA-Z0-9])"), F.lit(1)), ""))
    spelt = initials.rlike("(?s)" + ".*".join(map(re.escape, q))) if m > 1 else F.lit(False)
    gaps_of = "(?s)^" + "".join(f"(.*?){re.escape(c)}" for c in q)
    gaps = F.array(*[F.length(F.regexp_extract(low, gaps_of, k + 1)) for k in range(m)])
    places = F.transform(gaps, lambda g, k: F.aggregate(F.slice(gaps, 1, k + 1), k, lambda a, x: a + x))
    starts = lambda p: (p == 0) | F.substr(t, p, F.lit(1)).rlike(_BREAK) | (F.substr(t, p, F.lit(1)).rlike("[a-z]") & F.substr(t, p + 1, F.lit(1)).rlike("[A-Z]"))
    runs = F.aggregate(
        F.slice(gaps, 2, m), F.struct(F.lit(0).alias("run"), F.lit(0).alias("sum")),
        lambda a, g: F.when(g == 0, F.struct((a["run"] + 1).alias("run"), (a["sum"] + RUN_BONUS * (a["run"] + 1)).alias("sum"))).otherwise(
            F.struct(F.lit(0).alias("run"), (a["sum"] - F.least(F.lit(GAP_MOST), GAP_COST * g)).alias("sum"))),
        lambda a: a["sum"],
    )
    first = F.least(F.lit(FIRST_MOST), FIRST_COST * F.get(gaps, F.lit(0)))
    letters = LETTERS + START_BONUS * F.size(F.filter(places, starts)) + runs - first + F.greatest(F.lit(0), LETTERS_SHORT - n)
    score = (
        F.when(low == q, EXACT + F.greatest(F.lit(0), EXACT_SHORT - n))
        .when(F.startswith(low, F.lit(q)), prefix)
        .when(word.isNotNull(), word)
        .when(spelt, INITIALS + F.greatest(F.lit(0), INITIALS_SHORT - (n - m)))
        .when(low.rlike(gaps_of), F.greatest(F.lit(LETTERS_LEAST), letters))
        .otherwise(0)
    )
    return F.when(text.isNotNull(), score.cast("double"))


# Weights of the fields of a palette entry.
DESCRIPTION_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.85


def fuzzy_search(items: DataFrame, query: str, title: str = "title", description: str = "description", keywords: str = "keywords") -> DataFrame:
    """``items`` that match in title, description or one of the keywords (an array), best first, then by title; with ``score``.

    A blank query keeps every item with score 0. Null fields match nothing.
    """
    if not query.strip():
        return items.withColumn("score", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own = zero(fuzzy_score(query, F.col(title)))
    about = F.floor(zero(fuzzy_score(query, F.col(description))) * DESCRIPTION_WEIGHT).cast("double")
    each = F.transform(F.col(keywords), lambda k: F.floor(zero(fuzzy_score(query, k)) * KEYWORD_WEIGHT).cast("double"))
    best = F.greatest(own, about, zero(F.array_max(each)))
    return items.withColumn("score", best).filter("score > 0").orderBy(F.desc("score"), title)


def lcs_length(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def lcs_similarity(a: Column, b: Column) -> Column:
    """2 * longest common subsequence / total length; 1 for two empty strings."""

    @F.pandas_udf("double")
    def f(xs: pd.Series, ys: pd.Series) -> pd.Series:
        one = lambda x, y: None if x is None or y is None else (2 * lcs_length(list(x), list(y)) / (len(x) + len(y)) if x or y else 1.0)
        return pd.Series([one(x, y) for x, y in zip(xs, ys)])

    return f(a, b)


def line_diff(old: str, new: str) -> list[dict]:
    """Line operations (op, line) that turn ``old`` into ``new``, deletions before insertions."""
    a, b = old.split("\n"), new.split("\n")
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append({"op": "same", "line": a[i]})
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or table[i + 1][j] >= table[i][j + 1]):
            out.append({"op": "delete", "line": a[i]})
            i += 1
        else:
            out.append({"op": "insert", "line": b[j]})
            j += 1
    return out


def degrees(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx) * (180 / math.pi)
