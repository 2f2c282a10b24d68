"""Language-model scoring with a probabilistic suffix tree.

The tree grows from the root, whose distribution is the add-one unigram. A context of one token or more is a candidate if
it was seen SUPPORT times, its suffix is retained and its prefix was a candidate; it is retained if the distribution of
its next token diverges from that of its suffix state. A retained context keeps the next tokens seen SUPPORT times after
it, discounted; others get its suffix's probabilities, scaled to the mass that is left. A token is scored in the longest
retained suffix of what precedes it.

Both limits are counts, so the tree grows with the corpus: contexts and their next tokens are distributed tables, made
and tested by joins. For scoring, the logarithm of a token's probability is written as a sum of the root's and of a
weight for each n-gram met: its scale as a retained context, and its part as a context with a kept next token, if it is
either; both are looked up at once. So scores are sums over n-grams, whatever their order. Weights of n-grams with OFTEN_GRAMS of all tokens (at most 1/OFTEN_GRAMS of a length)
are broadcast; a bounded filter tells which of the others may have a weight, and those, none of them hot, meet the tables by
a shuffle. The filter only saves work: what it lets through wrongly finds no weight. A context is looked up only where its
suffix was let through, as it can't be retained otherwise. In counting, an n-gram is sent only if a filter knows its suffix
(all tokens but the first) as seen SUPPORT times, as it can't be seen more often.

What is shuffled is parted by ranges of the keys and packed in sorted lists: of keys the differences, of all numbers only
the bytes that the list's largest one needs, compressed by byte place. A task asks once for a key, whatever the number
of its documents that wait for the answer. Nothing is rounded or shortened.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm import rolling
from graphloom.llm.text import or_empty
from graphloom.runtime import prepare_python, stage

#: Times that a context, and a next token after it, must be seen; longest context.
SUPPORT, DEPTH = 8, 3
#: Least divergence (nats) from the suffix state, and the count by which kept tokens are discounted.
DIVERGENCE, DISCOUNT = 0.05, 1.0
#: Share of all tokens from which a token's count is broadcast, an n-gram's weight is, and an n-gram's successors are spread.
OFTEN, OFTEN_GRAMS, HOT = 1e-6, 1e-6, 1e-4
#: Bits a key of a filter, and bits of a filter at most.
KEY_BITS, MOST_BITS = 12, 1 << 28
END = 0x5DEECE66D1234567
_STEP, _STATE = np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)
#: Counts or questions that a task holds before it passes them on, and parts a shuffle partition of counts is merged in.
HELD, PARTS = 1_500_000, 4


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by END, and where each text ends."""
    toks, sizes = [], []
    for i, j in rolling.buffers(texts):  # of the size whose powers are remembered
        words, firsts = rolling.word_hashes(texts[i:j])
        toks.append(np.insert(words, firsts[1:], np.uint64(END)))
        sizes.append(np.diff(firsts) + 1)
    return np.concatenate(toks), np.cumsum(np.concatenate(sizes))


def longer(key: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their prefixes and their last tokens."""
    return rolling.mixed(key * _STEP + token)


def places(ends: np.ndarray) -> np.ndarray:
    """How many tokens of its text stand up to each token, itself included."""
    sizes = np.diff(np.concatenate(([0], ends)))
    return np.arange(1, int(sizes.sum()) + 1) - np.repeat(ends - sizes, sizes)


def gram(toks: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at the places; of none for n = 0."""
    key = np.zeros(len(at), "uint64")
    for k in range(n - 1, -1, -1):
        key = longer(key, toks[at - k])
    return key


def state(key: np.ndarray) -> np.ndarray:
    """Key of the weight of a context, apart from the n-gram's own."""
    return key ^ _STATE


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of keys, equal in width; keys are hashes, so they hold about as many each."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype("int64")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as the bytes that the largest one needs, ordered by byte place; each place is compressed if that helps."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    own = np.ascontiguousarray(x, "<u8").view("uint8").reshape(-1, 8)
    raw = [own[:, k].tobytes() for k in range(width)]
    small = [min(r, pa.compress(r, codec="zstd", asbytes=True), key=len) for r in raw]
    return b"".join([struct.pack(f"<IB{width}I", len(x), width, *map(len, small)), *small])


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, "uint64")
    n, width = struct.unpack_from("<IB", data)
    out, at = np.zeros((n, 8), "uint8"), 5 + 4 * width
    for k, size in enumerate(struct.unpack_from(f"<{width}I", data, 5)):
        own = data[at : at + size]
        out[:, k] = np.frombuffer(own if size == n else pa.decompress(own, n, codec="zstd"), "uint8")
        at += size
    return out.view("<u8").ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype="uint64")


def whole(lists: list[tuple]) -> list[np.ndarray]:
    """The columns of some lists, which are emptied."""
    out = [np.concatenate(c) for c in zip(*lists)]
    lists.clear()
    return out


def find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), "int64"), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class Lookup:
    """Sorted hashes, found from where those with the same leading bits begin."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, (2 * len(keys)).bit_length())
        self.keys, self.shift = np.append(keys, np.uint64((1 << 64) - 1)), np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype="uint64") << self.shift).astype("int32")

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``x``, and whether it is there; without it, the place may be one behind the last."""
        at = self.first[x >> self.shift]
        behind = np.flatnonzero(self.keys[at] < x)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < x[behind]]
        return at, (self.keys[at] == x) & (at < len(self.keys) - 1)


class Filter:
    """A Bloom filter of 64-bit keys, of MOST_BITS bits at most: it knows all keys put in, and few others."""

    def __init__(self, bits: int):
        self.bits = np.zeros(bits // 8, "uint8")

    def _places(self, x: np.ndarray) -> list[np.ndarray]:
        n, h = np.uint64(len(self.bits) * 8 - 1), rolling.mixed(x)
        return [(h + np.uint64(k) * (h >> np.uint64(32) | np.uint64(1))) & n for k in range(3)]

    def add(self, x: np.ndarray) -> Filter:
        for p in self._places(x):
            np.bitwise_or.at(self.bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype("uint8"))
        return self

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p in self._places(x):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype("uint8")) & 1 == 1
        return out


def key_filter(keys: DataFrame, column: str) -> Filter:
    """The filter of a table's keys. Few tasks fill filters of their own; the driver holds two of them."""
    n = keys.count()
    bits = min(max(1 << 10, 1 << max(KEY_BITS * n - 1, 1).bit_length()), MOST_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view("uint64"))
        yield pa.RecordBatch.from_arrays([pa.array([own.bits.tobytes()], "binary")], ["bits"])

    out = Filter(bits)
    for row in keys.select(F.col(column).cast("long").alias("key")).coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        out.bits |= np.frombuffer(row["bits"], "uint8")
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view("int64"))


def summed_up(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of some lists, sorted, and the sums of their values."""
    x, v = np.concatenate([np.zeros(0, "uint64"), *keys]), np.concatenate(values) if values else np.zeros(0)
    o = np.argsort(x)
    x, v = x[o], v[o]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[new], np.add.reduceat(v, new) if len(new) else v


def _token_counts(docs: DataFrame, text: str) -> DataFrame:
    """(key, token, n, is_end) of all distinct tokens."""

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, most = PARTS * tasks, HELD

    def sent(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = part_of(keys, parts)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
        ranges = list(zip(first, np.append(first[1:], len(part))))
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype("int32")), pa.array([packed_sorted(keys[i:j]) for i, j in ranges], "binary"), pa.array([packed(n[i:j]) for i, j in ranges], "binary")], ["part", "tokens", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows = 0

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for i, j in rolling.buffers(texts, 4 << 20):
                keys, n = np.unique(tokens(texts[i:j])[0], return_counts=True)
                held.append(keys)
                counts.append(n)
                rows += len(keys)
                if rows > most:
                    keys, n = summed_up(held, counts)
                    held, counts, rows = [keys], [n], len(keys)
                    if rows > most // 2:
                        yield sent(keys, n)
                        held, counts, rows = [], [], 0
        if held:
            yield sent(*summed_up(held, counts))

    def merged(held: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = summed_up(held, counts)
        return pa.RecordBatch.from_arrays([_signed(longer(np.zeros(len(keys), "uint64"), keys)), _signed(keys), pa.array(n), pa.array(keys == END)], ["key", "token", "n", "is_end"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, counts = None, [], []
        for batch in batches:
            for k, own in enumerate(batch.column(0).to_pylist()):
                if held and own != part:
                    yield merged(held, counts)
                    held, counts = [], []
                part = own
                held.append(unpacked_sorted(batch.column(1)[k].as_py()))
                counts.append(unpacked(batch.column(2)[k].as_py()).astype("int64"))
        if held:
            yield merged(held, counts)

    some = docs.select(or_empty(text).alias("t")).mapInArrow(count, "part int, tokens binary, n binary")
    return some.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(merge, "key long, token long, n long, is_end boolean")


def _successors(docs: DataFrame, text: str, depth: int, often: Filter, context: Filter, hot: np.ndarray, frequent: tuple[Lookup, np.ndarray]) -> DataFrame:
    """(key, ctx, token, n, is_end) of n-grams seen SUPPORT times after contexts of ``depth`` tokens that the filter knows.

    An n-gram is seen no more often than its last ``depth`` tokens, so only those that ``often`` knows are counted at all.
    ``key`` is that of context and next token. Tasks send their counts in packed lists, by context, or for ``hot`` contexts by
    n-gram, so that none is held by one task; ``frequent`` tokens (sorted, and the ranks by count) go as their ranks.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((often, context, hot, frequent))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, most = PARTS * tasks, HELD
    names = ["part", "ctx", "runs", "code", "token", "n"]

    def sent(key, ctx, token, n) -> pa.RecordBatch:
        part = part_of(np.where(find(shared.value[2], ctx)[1], key, ctx), parts)
        o = np.argsort(ctx)
        o = o[np.argsort(part[o].astype("uint16" if parts <= 1 << 16 else "int64"), kind="stable")]
        part, ctx, token, n = part[o], ctx[o], token[o], n[o]
        run = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (part[1:] != part[:-1]))))
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        frequent, ranks = shared.value[3]
        at, coded = frequent.find(token)
        code = np.zeros(len(token), "int64")
        code[coded] = ranks[at[coded]] + 1
        length, ctx, rest = np.diff(np.append(run, len(ctx))), ctx[run], np.flatnonzero(~coded)
        ends = [[*at, size] for at, size in ((first, len(n)), (np.searchsorted(run, first), len(run)), (np.searchsorted(rest, first), len(rest)))]
        lists = lambda at, x, pack=packed: pa.array([pack(x[i:j]) for i, j in zip(at, at[1:])], "binary")
        return pa.RecordBatch.from_arrays([
            pa.array(part[first].astype("int32")), lists(ends[1], ctx, packed_sorted), lists(ends[1], length), lists(ends[0], code),
            lists(ends[2], token[rest]), lists(ends[0], n),
        ], names)

    def grouped(ctx, token, n=None):
        key = longer(ctx, token)
        o = np.argsort(key)
        key, n = key[o], np.ones(len(o), "int64") if n is None else n[o]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        o = o[new]
        return key[new], ctx[o], token[o], np.add.reduceat(n, new)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, context, _, _ = shared.value
        held, rows = [], 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for i, j in rolling.buffers(texts, 4 << 20):
                toks, ends = tokens(texts[i:j])
                at = np.flatnonzero(places(ends) > depth)
                ctx = gram(toks, at - 1, depth)
                some = context.has(ctx)
                at, ctx = at[some], ctx[some]
                some = often.has(gram(toks, at, depth))
                at, ctx = at[some], ctx[some]
                held.append((ctx, toks[at]))
                rows += len(at)
                if rows > most:
                    yield sent(*grouped(*whole(held)))
                    rows = 0
        if rows:
            yield sent(*grouped(*whole(held)))

    def merged(rows: list[tuple], by_rank: np.ndarray) -> pa.RecordBatch:
        ctx, runs, code, rest, n = (np.concatenate(c) for c in zip(*rows))
        ctx, token = np.repeat(ctx, runs.astype("int64")), np.zeros(len(code), "uint64")
        token[code > 0], token[code == 0] = by_rank[code[code > 0].astype("int64") - 1], rest
        key, ctx, token, n = grouped(ctx, token, n.astype("int64"))
        keep = n >= SUPPORT
        key, ctx, token, n = key[keep], ctx[keep], token[keep], n[keep]
        return pa.RecordBatch.from_arrays([_signed(key), _signed(ctx), _signed(token), pa.array(n), pa.array(token == END)], ["key", "ctx", "token", "n", "is_end"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        frequent, ranks = shared.value[3]
        by_rank = frequent.keys[np.argsort(ranks)]
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py()
                if rows and own != part:
                    yield merged(rows, by_rank)
                    rows = []
                part = own
                rows.append(tuple((unpacked_sorted if c == 1 else unpacked)(batch.column(c)[k].as_py()) for c in range(1, 6)))
        if rows:
            yield merged(rows, by_rank)

    some = docs.select(or_empty(text).alias("t")).mapInArrow(count, "part int, ctx binary, runs binary, code binary, token binary, n binary")
    return some.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(merge, "key long, ctx long, token long, n long, is_end boolean")


class Model:
    """Counts of all training tokens (key, n, is_end), and weights (key, n, w: log10, is_context) of n-grams, as next tokens and as contexts."""

    def __init__(self, counts: DataFrame, total: int, distinct: int):
        self.counts, self.total, self.distinct = counts, total, distinct
        self.weights: list[DataFrame] = []
        self.contexts: list[DataFrame] = []


def train(docs: DataFrame, text: str = "text", depth: int = DEPTH, divergence: float = DIVERGENCE) -> Model:
    """The model of ``docs``: level by level, successors of candidates are counted, and contexts tested and retained."""
    prepare_python(docs.sparkSession)
    counts = stage(_token_counts(docs, text), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = Model(counts, total, distinct)
    often = counts.filter(F.col("n") >= SUPPORT)
    seen = often
    common = counts.filter(F.col("n") >= max(1.0, OFTEN * total)).select("token", "n").toPandas()
    frequent, n = common["token"].to_numpy("int64").view("uint64"), common["n"].to_numpy("int64")
    order = np.lexsort((frequent, -n))
    frequent, ranks = frequent[order], np.argsort(frequent[order])
    frequent = Lookup(frequent[ranks]), ranks
    candidates = often.filter(~F.col("is_end")).select(F.col("key").alias("ctx"), F.col("n").alias("c"), F.lit(0).cast("long").alias("suf"))
    before = often.select(F.col("key").alias("suffix"), F.lit(0).cast("long").alias("suf"), "token", ((F.col("n") + 1) / F.lit(float(total + distinct + 1))).alias("q"))
    for d in range(1, depth + 1):
        if candidates.isEmpty():
            break
        hot = candidates.filter(F.col("c") >= HOT * total).select("ctx").toPandas()["ctx"].to_numpy("int64").view("uint64")
        found = _successors(docs, text, d, key_filter(seen, "key"), key_filter(candidates, "ctx"), np.sort(hot), frequent)
        after = found.join(candidates, "ctx").join(before, ["suf", "token"])
        after = stage(after.select("key", "ctx", "suffix", "token", "n", "is_end", "c", "q", (F.col("n") / (F.col("c") + DISCOUNT)).alias("p")), "after")
        rest = lambda x: F.greatest(1 - F.sum(x), F.lit(1e-12))
        tested = after.groupBy("ctx").agg(F.first("c").alias("c"), rest("p").alias("rest_p"), rest("q").alias("rest_q"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))
        gain = F.col("kl") + F.col("rest_p") * F.log(F.col("rest_p") / F.col("rest_q"))
        retained = tested.filter(gain >= divergence).select("ctx", F.col("c").alias("n"), F.log10(F.col("rest_p") / F.col("rest_q")).alias("scale"))
        retained = stage(retained, "retained")
        model.contexts.append(retained)
        kept = after.join(retained.select("ctx", "scale"), "ctx")
        edges = kept.select("key", "n", (F.log10(F.col("p") / F.col("q")) - F.col("scale")).alias("w"), F.lit(False).alias("is_context"))
        states = retained.select(F.col("ctx").alias("key"), "n", F.col("scale").alias("w"), F.lit(True).alias("is_context"))
        model.weights += [edges, states]
        candidates = after.filter(~F.col("is_end")).join(retained.select(F.col("ctx").alias("suffix")), "suffix", "left_semi")
        candidates = stage(candidates.select(F.col("key").alias("ctx"), F.col("n").alias("c"), F.col("suffix").alias("suf")), "candidates")
        seen = after
        before = after.select(F.col("key").alias("suffix"), F.col("ctx").alias("suf"), "token", F.col("p").alias("q"))
    return model


#: Kinds of rows that meet in a part, in their order: two tables, questions to them, documents.
_COUNTS, _WEIGHTS, _OF_TOKENS, _OF_GRAMS, _DOCUMENTS = range(5)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per input row: ``key``, n_tokens, n_known, base_score and score (log10)."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "key long, n long, w double, is_context boolean")
    weights = stage(reduce(DataFrame.unionByName, model.weights, none), "weights")
    least, least_gram = max(1.0, OFTEN * model.total), max(1.0, OFTEN_GRAMS * model.total)

    def known_here(table: DataFrame, value: str) -> tuple[Lookup, np.ndarray]:
        own = table.select("key", value).toPandas()
        keys, values = summed_up([own["key"].to_numpy("int64").view("uint64")], [own[value].to_numpy("float64")])
        return Lookup(keys), values

    common, n = known_here(model.counts.filter(F.col("n") >= least), "n")
    heavy, w = known_here(weights.filter(F.col("n") >= least_gram), "w")
    of_context = F.when(F.col("is_context"), F.col("key").bitwiseXOR(F.lit(int(_STATE.astype("int64"))))).otherwise(F.col("key"))
    shared = spark.sparkContext.broadcast((common, np.log10(n + 1), heavy, w, key_filter(weights.select(of_context.alias("key")), "key")))
    scale = math.log10(model.total + model.distinct + 1)
    kind = docs.schema[key].dataType.simpleString()
    levels = min(depth, len(model.weights) // 2)
    # Answers are sums for each document and part, so that parts of twice the size give fewer.
    parts, most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2), HELD
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), or_empty(text).alias("t"))
    names = ["part", "kind", "chunk", "keys", "vals", "own", "runs", "docs"]
    document = pa.struct([("id", to_arrow_type(d.schema["id"].dataType)), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bonus", pa.float64())])
    of_docs = f"docs array<struct<id {kind}, n long, known long, base double, bonus double>>"
    schema = f"part int, kind int, chunk long, keys binary, vals array<double>, own binary, runs binary, {of_docs}"

    def by_part(what: int, keys: np.ndarray, vals=None, own=None, chunk: int = 0) -> pa.RecordBatch:
        """Rows of a table, with ``vals`` or counts; or questions for ``own``, of which each key goes once, with how many more ask for it."""
        asked = what in (_OF_TOKENS, _OF_GRAMS)
        o = np.argsort(keys)
        keys = keys[o]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))) if asked else np.arange(len(keys))
        runs, keys = np.diff(np.append(new, len(keys))), keys[new]
        part = part_of(keys, parts)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
        at, n = np.append(first, len(part)), len(first)
        lists = lambda at, x, pack=packed: pa.array([pack(x[i:j]) for i, j in zip(at, at[1:])], "binary")
        values = pa.nulls(n, pa.list_(pa.float64())) if vals is None else pa.ListArray.from_arrays(pa.array(at.astype("int32")), pa.array(vals[o]))
        owners = pa.nulls(n, pa.binary()) if own is None else lists(np.append(new, len(o))[at], own[o])
        runs = lists(at, runs - 1) if asked else pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype("int32")), pa.array(np.full(n, what, "int32")), pa.array(np.full(n, chunk, "int64")), lists(at, keys, packed_sorted), values, owners, runs, pa.nulls(n, pa.list_(document))], names)

    def told_of(chunk: int, docs_: list[pa.StructArray], rare: list[tuple], lone: list[tuple]) -> Iterator[pa.RecordBatch]:
        for what, asked in ((_OF_TOKENS, rare), (_OF_GRAMS, lone)):
            keys, own = whole(asked)
            yield by_part(what, keys, own=own, chunk=chunk)
        head = [pa.array([chunk % parts], "int32"), pa.array([_DOCUMENTS], "int32"), pa.array([chunk], "int64")]
        docs_ = pa.concat_arrays(docs_)
        blank = (pa.nulls(1, t) for t in (pa.binary(), pa.list_(pa.float64()), pa.binary(), pa.binary()))
        yield pa.RecordBatch.from_arrays([*head, *blank, pa.ListArray.from_arrays(pa.array([0, len(docs_)], "int32"), docs_)], names)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, log_n, heavy, weight, any_weight = shared.value
        chunk, docs_, rare, lone, size, asked = 0, [], [], [], 0, 0
        for batch in batches:
            texts = batch.column("t").cast(pa.binary()).to_pylist()
            for i, j in rolling.buffers(texts, 4 << 20):
                if not docs_:
                    chunk = batch.column("row")[i].as_py()
                toks, ends = tokens(texts[i:j])
                owner = np.repeat(np.arange(j - i, dtype="int32"), np.diff(np.concatenate(([0], ends))))
                place = places(ends)
                at, known = frequent.find(gram(toks, np.arange(len(toks)), 1))
                base, bonus = np.full(len(toks), -scale), np.zeros(j - i)
                base[known] += log_n[at[known]]
                some = np.flatnonzero(~known)
                rare.append((gram(toks, some, 1), owner[some] + size))
                lone.append((toks[:0], owner[:0]))
                inside, last, edge = np.arange(len(toks)), np.zeros(0, "int64"), toks[:0]
                for k in range(1, levels + 2):  # n-grams of k tokens: next tokens by what the level before found, and contexts
                    key, wanted = np.zeros(len(toks), "uint64"), np.zeros(len(toks), bool)
                    key[last], wanted[last] = edge, True
                    if k <= levels:
                        inside = inside[place[inside] > k]
                        ctx = gram(toks, inside - 1, k)
                        some = any_weight.has(state(ctx))
                        inside, ctx = inside[some], ctx[some]
                        key[inside - 1], wanted[inside - 1] = ctx, True
                        edge = longer(ctx, toks[inside])
                        some = any_weight.has(edge)
                        last, edge = inside[some], edge[some]
                    own, key = owner[wanted], key[wanted]
                    at, hit = heavy.find(key)
                    bonus += np.bincount(own[hit], weight[at[hit]], j - i)
                    lone.append((key[~hit], own[~hit] + size))
                    asked += len(lone[-1][0])
                asked += len(rare[-1][0])
                sums = [np.bincount(owner, x, j - i) for x in (np.ones(len(toks)), known, base)]
                docs_.append(pa.StructArray.from_arrays([batch.column("id")[i:j], pa.array(sums[0].astype("int64")), pa.array(sums[1].astype("int64")), pa.array(sums[2]), pa.array(bonus)], fields=list(document)))
                size += j - i
                if asked > most or size > most // 16:
                    yield from told_of(chunk, docs_, rare, lone)
                    docs_, size, asked = [], 0, 0
        if docs_:
            yield from told_of(chunk, docs_, rare, lone)

    def table(what: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield by_part(what, b.column(0).to_numpy().view("uint64"), **{"own" if what == _COUNTS else "vals": b.column(1).to_numpy()})

        return pack

    def answered(what: int, chunk: int, told: list[tuple]) -> pa.RecordBatch:
        who, n, sums = whole(told)
        who, back = np.unique(who, return_inverse=True)
        n, sums = (np.bincount(back, x, len(who)).astype(kind) for x, kind in ((n, "int64"), (sums, "float64")))  # of none it makes whole numbers
        hits, sums = packed(n if what == _OF_TOKENS else n[:0]), pa.ListArray.from_arrays(pa.array([0, len(who)], "int32"), pa.array(sums))
        return pa.RecordBatch.from_arrays([pa.array([chunk], "int64"), pa.array([what], "int32"), pa.array([packed_sorted(who)], "binary"), pa.array([hits], "binary"), sums, pa.nulls(1, pa.list_(document))], answers)

    def looked_up(keys: np.ndarray, own: np.ndarray, runs: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        at, hit = (np.repeat(x, runs) for x in find(table[0], keys))
        who, back = np.unique(own[hit], return_inverse=True)
        return who, np.bincount(back, minlength=len(who)), np.bincount(back, table[1][at[hit]], len(who))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tables, held = None, {}, {}
        told, size = {}, 0  # of all parts that meet here, so that each document has one sum of them
        for batch in batches:
            own_part, own_kind, chunks = (batch.column(c).to_pylist() for c in range(3))
            for k in range(batch.num_rows):
                if own_part[k] != part:
                    part, tables, held = own_part[k], {}, {_COUNTS: [], _WEIGHTS: []}
                what = own_kind[k]
                if what == _DOCUMENTS:
                    blank = [pa.nulls(1, t) for t in (pa.binary(), pa.binary(), pa.list_(pa.float64()))]
                    docs_ = batch.column(7)[k].values
                    again = pa.StructArray.from_arrays(docs_.flatten(), fields=list(document))
                    yield pa.RecordBatch.from_arrays([pa.array([chunks[k]], "int64"), pa.array([what], "int32"), *blank, pa.ListArray.from_arrays(pa.array([0, len(again)], "int32"), again)], answers)
                    continue
                keys = unpacked_sorted(batch.column(3)[k].as_py())
                if what in held:
                    held[what].append((keys, np.log10(unpacked(batch.column(5)[k].as_py()) + 1.0) if what == _COUNTS else batch.column(4)[k].values.to_numpy()))
                    continue
                of = _COUNTS if what == _OF_TOKENS else _WEIGHTS
                if of not in tables:
                    tables[of] = summed_up(*zip(*held[of])) if held[of] else summed_up([], [])
                own, runs = unpacked(batch.column(5)[k].as_py()), unpacked(batch.column(6)[k].as_py()).astype("int64") + 1
                found = looked_up(keys, own, runs, tables[of])
                told.setdefault((what, chunks[k]), []).append(found)
                size += len(found[0])
                if size > most:
                    yield from (answered(*about, x) for about, x in told.items())
                    told, size = {}, 0
        yield from (answered(*about, x) for about, x in told.items())

    def summed(docs_: pa.StructArray, told: list[tuple]) -> pa.RecordBatch:
        ids, n, known, base, bonus = docs_.flatten()
        known, base, bonus = known.to_numpy().copy(), base.to_numpy().copy(), bonus.to_numpy().copy()
        for what, own, hits, sums in told:
            if what == _OF_TOKENS:
                known[own] += hits
                base[own] += sums
            else:
                bonus[own] += sums
        return pa.RecordBatch.from_arrays([ids, n, pa.array(known), pa.array(base), pa.array(base + bonus)], ["id", "n_tokens", "n_known", "base_score", "score"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, docs_, told = None, None, []
        for batch in batches:
            for k, own in enumerate(batch.column(0).to_pylist()):
                if own != chunk:
                    if docs_ is not None:
                        yield summed(docs_, told)
                    chunk, docs_, told = own, None, []
                what = batch.column(1)[k].as_py()
                if what == _DOCUMENTS:
                    docs_ = batch.column(5)[k].values
                else:
                    own_rows, hits = unpacked_sorted(batch.column(2)[k].as_py()), unpacked(batch.column(3)[k].as_py())
                    told.append((what, own_rows.astype("int64"), hits.astype("int64"), batch.column(4)[k].values.to_numpy()))
        if docs_ is not None:
            yield summed(docs_, told)

    answers = ["chunk", "kind", "own", "hits", "sums", "docs"]
    asked = d.mapInArrow(measure, schema)
    asked = asked.unionByName(model.counts.filter(F.col("n") < least).select("key", "n").mapInArrow(table(_COUNTS), schema))
    asked = asked.unionByName(weights.filter(F.col("n") < least_gram).select("key", F.col("w").alias("v")).mapInArrow(table(_WEIGHTS), schema))
    met = asked.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(answer, f"chunk long, kind int, own binary, hits binary, sums array<double>, {of_docs}")
    # Each chunk's documents and the answers about them, which its rows' order alone would not bring together, meet again.
    out = met.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(gather, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumnRenamed("id", key)


def lm_scores(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, n_tokens, n_known, train_tokens, base_score, score; trained where not ``held_out``.

    Null text counts as empty; an empty text is one END token. Repeated rows count each, in training too. A text of any
    length is hashed whole, in one task with some tens of times its size. An empty table gives no rows; with nothing to
    train on all tokens are unknown and score is base_score. Other columns of ``docs`` are not read.
    """
    model = train(docs.filter(~held_out), text)
    return score(docs, model, key, text).withColumn("train_tokens", F.lit(model.total).cast("long"))
