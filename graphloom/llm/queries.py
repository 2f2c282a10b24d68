"""Queries that apply the corpus operators to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import encode_documents
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.mil_classifier import classify, fit_sample, fold
from graphloom.llm.hard_negatives import hard_negatives
from graphloom.llm.merkle import manifest, verify
from graphloom.llm.mixing import BLOCK, GOLDEN, mix
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.positional_index import decontaminate
from graphloom.llm.quality_rules import MAX_DOCS, MAX_PERCENT, MIN_PERCENT, MIN_WORDS, quality_rules
from graphloom.llm.sharding import shard_documents
from graphloom.llm.suffix_dedup import remove_repeats
from graphloom.llm.suffix_tree_lm import lm_scores
from graphloom.llm.text import table
from graphloom.llm.wacz import archive_round_trip


def op1_line_frequency(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op2_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op3_wacz(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_hash")


def op5_mil(spark, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = fit_sample(docs, table(spark, sf_dir, "labels"), ~held_out)
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_suffix_tree(spark, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    out = lm_scores(table(spark, sf_dir, "documents"), held_out).withColumn("held_out", held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("_hash", "slots")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents")).drop("_hash")
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).drop("_hash", "_label")


def op11_positional_index(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verify(manifest(table(spark, sf_dir, "documents"), check={"text": tampered}))


def op13_distance_keys(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_bpe, op3_wacz, op4_exact_dedup, op5_mil, op6_suffix_tree, op7_mixing, op8_sharding, op9_suffix_dedup, op10_near_dedup,
        op11_positional_index, op12_merkle, op13_distance_keys,
    )
}

_SPACE = r"[\x20\x09-\x0D]+"


def _leaf(text: str) -> str:
    """DuckDB's digest of a row of documents with this text."""
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", f"({text})")]
    return f"sha256({' || '.join(parts)})"


#: crc32 of the decimal id by its defining shift register, a bit a step; then the text without line ends where that is even.
_CRC = """(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
    lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, v: CASE WHEN xor(a, v) & 1 = 1 THEN xor(xor(a, v) >> 1, 3988292384) ELSE xor(a, v) >> 1 END))"""
_TAMPERED = f"CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"

SQL = {
    "op1_line_frequency": rf"""
        WITH d AS (
            SELECT doc_id, source, coalesce(text, '') AS t,
                   list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
        lines AS (SELECT doc_id, source, md5(t) AS x, unnest(string_split(t, chr(10))) AS raw FROM d),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines
                WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY 1),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        rep AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM (
                    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM twice) GROUP BY 1),
        base AS (
            SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
        norm AS (SELECT doc_id, source, line, x FROM (
                    SELECT doc_id, source, x, trim(regexp_replace(lower(raw), '{_SPACE}', ' ', 'g')) AS line FROM lines) WHERE line <> ''),
        hosts AS (SELECT source, count(DISTINCT t) AS total FROM d GROUP BY 1),
        hot AS (SELECT n.source, line FROM norm n JOIN hosts h ON h.source IS NOT DISTINCT FROM n.source
                GROUP BY n.source, line, total HAVING count(DISTINCT x) > {MAX_DOCS} AND count(DISTINCT x) * 100 > total * {MAX_PERCENT}),
        cut AS (SELECT doc_id, sum(len(string_split(n.line, ' ')))::BIGINT AS removed_words
                FROM norm n JOIN hot h ON h.source IS NOT DISTINCT FROM n.source AND h.line = n.line GROUP BY 1),
        out AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
        SELECT out.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND n_words - coalesce(removed_words, 0) >= {MIN_WORDS}
               AND 100 * (n_words - coalesce(removed_words, 0)) >= {MIN_PERCENT} * n_words AS kept,
               coalesce(removed_words, 0)::BIGINT AS removed_words
        FROM out LEFT JOIN cut USING (doc_id)""",
    "op4_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_mixing": rf"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
                   len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> ''))::BIGINT AS size
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
        l AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS level,
                     1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights FROM w),
        f AS (SELECT *, (SELECT sum(cap) FROM l b WHERE b.level <= a.level)
                        + level * (weights - (SELECT sum(weight) FROM l b WHERE b.level <= a.level)) <= budget AS is_full FROM l a),
        t AS (SELECT source, source_size,
                     CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0.0))
                          / sum(weight) FILTER (NOT is_full) OVER () * weight END AS target FROM f),
        i AS (SELECT source, floor(target + 0.5)::BIGINT AS words, sum(floor(target + 0.5)::BIGINT) OVER (ORDER BY source NULLS LAST)::BIGINT AS hi, sum(floor(target + 0.5)::BIGINT) OVER ()::BIGINT AS words_ FROM t),
        x AS (SELECT unnest(range(1, (SELECT ceil(max(words_) / {BLOCK}::DOUBLE)::BIGINT FROM i) + 1)) AS k),
        u AS (SELECT (k >> 20) * CAST('{GOLDEN[0]!r}' AS DOUBLE) + (k & 1048575) * CAST('{GOLDEN[1]!r}' AS DOUBLE) AS y FROM x),
        c AS (SELECT source, count(*) AS got FROM u JOIN i ON y - floor(y) >= (hi - words)::DOUBLE / words_ AND y - floor(y) < hi::DOUBLE / words_ GROUP BY 1),
        p AS (SELECT d.*, t.source_size, t.target, coalesce(c.got, 0) * {BLOCK} AS words,
                     (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) - size)::BIGINT AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (greatest(least(start + size, words) - start, 0)
                + greatest(least(start + source_size + size, words) - start - source_size, 0))::BIGINT AS taken
        FROM p""",
    "op3_wacz": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k:
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(x, 5 * i + 1, 5))::BIGINT >> (15 - 5 * k)) & 31) + 1]), '')), '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM q""",
    "op10_near_dedup": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, k FROM (
                SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
                UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3) GROUP BY 1, 2),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r(id, far) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, link.b FROM r JOIN link ON link.a = r.far),
        c AS (SELECT id, min(far) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)""",
    "op12_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(_TAMPERED)} AS checked FROM documents),
        t(lvl, source, idx, n, h) AS (
            SELECT 0, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, checked) - 1, count(*) OVER (PARTITION BY source), leaf FROM d
            UNION ALL
            SELECT lvl + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lvl, source, idx // 3, n),
        s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
        u(lvl, idx, n, h) AS (
            SELECT 0, place, n, subroot FROM s
            UNION ALL
            SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 3, n),
        own AS (
            SELECT d.*, row_number() OVER (PARTITION BY d.source ORDER BY doc_id NULLS FIRST, leaf, checked) - 1 AS idx, place, subroot
            FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
        step AS (
            SELECT source, idx AS leaf_idx, lvl, idx // (3 ** lvl)::BIGINT AS at_, false AS is_top FROM (SELECT source, idx, unnest(range(0, 64)) AS lvl FROM own)
            WHERE lvl < 40),
        low AS (
            SELECT p.source, leaf_idx, p.lvl, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < at_), '') AS l, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > at_), '') AS r
            FROM step p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.lvl = p.lvl AND t.idx // 3 = at_ // 3 AND t.n > 1 GROUP BY 1, 2, 3),
        high AS (
            SELECT source, 100 + u.lvl AS lvl, coalesce(string_agg(u.h, '' ORDER BY idx) FILTER (idx < at_), '') AS l, coalesce(string_agg(u.h, '' ORDER BY idx) FILTER (idx > at_), '') AS r
            FROM (SELECT source, lvl, place // (3 ** lvl)::BIGINT AS at_ FROM s, (SELECT unnest(range(0, 40)) AS lvl)) p
            JOIN u ON u.lvl = p.lvl AND u.idx // 3 = at_ // 3 AND u.n > 1 GROUP BY 1, 2),
        both_ AS (
            SELECT own.source, own.idx, lvl, l, r FROM own JOIN low ON low.source IS NOT DISTINCT FROM own.source AND leaf_idx = own.idx
            UNION ALL SELECT own.source, own.idx, lvl, l, r FROM own JOIN high ON high.source IS NOT DISTINCT FROM own.source),
        proof AS (SELECT source, idx, list(l || '|' || r ORDER BY lvl) AS steps, string_agg(l || r, '' ORDER BY lvl) AS siblings FROM both_ GROUP BY 1, 2),
        folded AS (
            SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
                   list_reduce(list_prepend(checked, coalesce(steps, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
            FROM own LEFT JOIN proof ON proof.source IS NOT DISTINCT FROM own.source AND proof.idx = own.idx)
        SELECT *, folded_root = root AS verified FROM folded""",
    "op11_positional_index": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (
            SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_distance_keys": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER w <= 10""",
}
