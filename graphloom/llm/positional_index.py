"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments, each over some 1 MB of whole texts (a longer text goes on in the next segments, with an
overlap): the segment's words, and for each word the places where it stands, compressed. Segments are made and searched where
they are, so nothing shuffles but a short row a document, no word is hot, and a lost executor costs its own segments. Test
phrases come in blocks of bounded size, each sent to all segments. Within a segment a phrase starts from the places of its
rarest word, less the word's offset; the lists of the other words, from rare to frequent, are intersected with these one after
the other. What is left is exact: words are compared as bytes, not as hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.rolling import mixed, prefix_hash, range_hash
from graphloom.runtime import prepare_python, stage

#: Bytes of text in a segment (within what ``rolling`` remembers powers for), and words by which the pieces of a longer text overlap: no phrase may be longer than that and one.
SEGMENT, OVERLAP = 1_000_000, 63
#: Bytes of test texts that are sent to the segments at once, and candidate places that are intersected at once.
BLOCK, CANDIDATES = 2 << 20, 1 << 19

_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of lower-cased bytes: runs of digits, a to z and whatever is not ASCII."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], _IS_WORD[data], [False])).view("int8")))
    return edges[::2], edges[1::2]


def lowered(text: bytes) -> np.ndarray:
    return _LOWER[np.frombuffer(text, "uint8")]


def words_of(text: bytes) -> list[bytes]:
    data = lowered(text)
    low = data.tobytes()
    return [low[a:b] for a, b in zip(*(x.tolist() for x in word_bounds(data)))]


def _group(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' places sorted by word and place, and how often each word stands there.

    Words are told by a hash that shares 64 bits with the place; equal hashes are then compared byte by byte.
    """
    n, bits = len(begins), np.uint64(max(int(len(begins)).bit_length(), 1))
    lengths = ends - begins
    hashes = mixed(range_hash(prefix_hash(data), begins, ends) + lengths.astype("uint64"))
    keys = np.sort((hashes >> bits << bits) | np.arange(n, dtype="uint64"))
    places = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype("int64")
    first = np.concatenate(([True], keys[1:] >> bits != keys[:-1] >> bits)) if n else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    like = places[starts][np.cumsum(first) - 1]
    same = bool((lengths[places] == lengths[like]).all())
    if same:
        size = lengths[places]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = bool((data[np.repeat(begins[places], size) + within] == data[np.repeat(begins[like], size) + within]).all())
    if not same:  # two words of one hash: tell this segment's words by their bytes
        low, numbers = data.tobytes(), {}
        number = np.fromiter((numbers.setdefault(low[a:b], len(numbers)) for a, b in zip(begins.tolist(), ends.tolist())), "int64", n)
        places = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.diff(number[places], prepend=-1))
    return places, np.diff(np.append(starts, n))


def _pack(values: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes by significance, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view("uint8").reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed, 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, "uint8").reshape(4, n).T).view("<u4").ravel().astype("int64")


def make_segment(pieces: list[tuple], texts: list[np.ndarray]) -> dict:
    """A segment over lower-cased texts; ``pieces`` has the row, the key and the number of words before each."""
    data = np.concatenate([x for t in texts for x in (t, np.zeros(1, "uint8"))])
    begins, ends = word_bounds(data)
    bounds = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))
    places, counts = _group(data, begins, ends)
    low, at = data.tobytes(), np.cumsum(counts) - counts
    terms = b"\0".join(low[begins[p] : ends[p]] for p in places[at]) if len(counts) else b""
    gaps = np.diff(places, prepend=0)
    gaps[at] = places[at]
    return {"row": [p[0] for p in pieces], "key": [p[1] for p in pieces], "first": [p[2] for p in pieces], "until": bounds.tolist(), "terms": terms, "counts": _pack(counts), "places": _pack(gaps)}


def _cut(text: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a long text that end between words, and the number of words before each; neighbours share ``overlap`` words."""
    begins, ends = word_bounds(text)
    first = 0
    while True:
        last = max(int(np.searchsorted(ends, begins[first] + size, "right")), first + overlap + 1)
        yield first, text[begins[first] : ends[min(last, len(ends)) - 1]]
        if last >= len(ends):
            return
        first = last - overlap


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment: int = SEGMENT, overlap: int = OVERLAP) -> DataFrame:
    """The index of all rows' whole texts, written to the shared folder: a row a segment.

    Null texts have no words. Every row is indexed, repeated ones and those without a key too; an empty table has no
    segments. Other columns of ``docs`` are not read, whatever their names.
    """
    prepare_python(docs.sparkSession, 8)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, texts, size = None, [], [], 0
        for batch in batches:
            schema = pa.schema([
                ("row", pa.list_(pa.int64())), ("key", pa.list_(batch.schema.field(1).type)), ("first", pa.list_(pa.int64())),
                ("until", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()),
            ])
            for row, name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = lowered(t.as_buffer())
                for first, part in [(0, data)] if len(data) <= segment else _cut(data, segment, overlap) if _IS_WORD[data].any() else [(0, data[:0])]:
                    if size and size + len(part) > segment:
                        yield pa.RecordBatch.from_pylist([make_segment(held, texts)], schema=schema)
                        held, texts, size = [], [], 0
                    held.append((row, name, first))
                    texts.append(part)
                    size += len(part) + 1
        if held:
            yield pa.RecordBatch.from_pylist([make_segment(held, texts)], schema=schema)

    columns = f"row array<long>, key array<{kind}>, first array<long>, until array<long>, terms binary, counts binary, places binary"
    return stage(slim.mapInArrow(index, columns), "positional_index")


class Segment:
    """A segment's lists, unpacked: ``counts`` by term, and the sorted numbers term * words + place."""

    def __init__(self, row: dict):
        self.until = np.asarray(row["until"], "int64")
        self.words = int(self.until[-1]) if len(self.until) else 0
        self.terms = row["terms"].split(b"\0") if row["terms"] else []
        self.counts = _unpack(row["counts"], len(self.terms))
        self.at = np.cumsum(self.counts) - self.counts
        gaps = np.cumsum(_unpack(row["places"], self.words))
        # Every list starts from its own first place: take off the sum before it.
        before = np.where(self.at > 0, gaps[self.at - 1], 0) if len(self.at) else self.at
        self.places = gaps - np.repeat(before, self.counts)
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * max(self.words, 1) + self.places

    def numbers(self, vocabulary: dict[bytes, int], size: int) -> np.ndarray:
        """For each word of the vocabulary its term here, or -1."""
        out = np.full(size, -1, "int64")
        for k, t in enumerate(self.terms):
            i = vocabulary.get(t)
            if i is not None:
                out[i] = k
        return out

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the terms stand at the places."""
        want = term * self.words + place
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (place >= 0) & (place < self.words)

    def following(self, term: int, place: np.ndarray) -> np.ndarray:
        """The first places of a term at or after the given ones; beyond the end where there is none."""
        own = self.places[self.at[term] : self.at[term] + self.counts[term]]
        return np.append(own, 1 << 40)[np.searchsorted(own, place)]

    def within_text(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ranges of places lie in one text, and its number."""
        text = np.searchsorted(self.until, start, "right")
        return end <= self.until[np.minimum(text, len(self.until) - 1)], text

    def phrases(self, terms: np.ndarray, most: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of one length stand (a row of ``terms`` each; -1: no such word here): their numbers and first places."""
        alive = np.flatnonzero((terms >= 0).all(1))
        found = [(alive[:0], alive[:0])]
        if len(alive):
            terms = terms[alive]
            order = np.argsort(self.counts[terms], axis=1, kind="stable")
            rarest = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
            blocks = np.cumsum(self.counts[rarest]) // most
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(alive)))):
                size = self.counts[rarest[lo:hi]]
                phrase = np.repeat(np.arange(lo, hi), size)
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = self.places[np.repeat(self.at[rarest[lo:hi]], size) + within] - order[phrase, 0]
                for k in range(1, terms.shape[1]):
                    offset = order[phrase, k]
                    stays = self.has(terms[phrase, offset], start + offset)
                    phrase, start = phrase[stays], start[stays]
                found.append((alive[phrase], start))
        phrase, start = (np.concatenate(x) for x in zip(*found))
        whole, _ = self.within_text(start, start + terms.shape[1])
        stays = whole & (start >= 0)
        return phrase[stays], start[stays]

    def near(self, terms: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest runs of places, of ``span`` words at most, that hold all the terms (-1: not here): begins and ends."""
        if (terms < 0).any() or not len(terms):
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        terms = terms[np.argsort(self.counts[terms], kind="stable")]
        own = self.places[self.at[terms[0]] : self.at[terms[0]] + self.counts[terms[0]]]
        start = np.unique((own[:, None] - np.arange(min(span, self.words))).ravel())
        start = start[start >= 0]
        low, high = np.full(len(start), 1 << 40), np.zeros(len(start), "int64")
        for t in terms:
            place = self.following(t, start)
            stays = place - start < span
            start, place = start[stays], place[stays]
            low, high = np.minimum(low[stays], place), np.maximum(high[stays], place)
        tight = low == start
        start, end = start[tight], high[tight] + 1
        tight = np.append(end[1:] != end[:-1], True) if len(end) else np.zeros(0, bool)
        start, end = start[tight], end[tight]
        whole, _ = self.within_text(start, end)
        return start[whole], end[whole]


def _blocks(items: DataFrame, key: str, text: str, size: int) -> Iterator[list]:
    """All test rows in blocks of about ``size`` bytes, dealt by a hash; an empty table is one empty block."""
    slim = items.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    slim = slim.withColumn("_bytes", F.octet_length("text"))
    blocks = max(-(-(slim.agg(F.sum("_bytes").cast("long")).first()[0] or 0) // size), 1)
    for b in range(blocks):
        yield slim.filter(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == b).select("key", "text").collect()


def _search(index: DataFrame, items: DataFrame, key: str, text: str, block: int, prepare: Callable, find: Callable) -> DataFrame:
    """A row for each piece of a document: row, key, words (up to its end in the document), spans and items that matched.

    ``prepare`` makes of a block's rows, on the driver, what ``find`` takes with a segment and its vocabulary's numbers;
    that gives arrays of item numbers, begins and ends.
    """
    spark = index.sparkSession
    kind, item_kind = index.schema["key"].dataType.elementType.simpleString(), items.schema[key].dataType.simpleString()
    out = []
    for rows in _blocks(items, key, text, block):
        vocabulary: dict[bytes, int] = {}
        tokens = [np.asarray([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(r["text"].encode())], "int64") for r in rows]
        sent = spark.sparkContext.broadcast((vocabulary, prepare(tokens), [r["key"] for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, query, names = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    segment = Segment(row)
                    item, begin, end = find(segment, query, segment.numbers(words, len(words)))
                    _, where = segment.within_text(begin, end)
                    origin = np.concatenate(([0], segment.until[:-1]))
                    got: dict[int, tuple[set, set]] = {}
                    for t, i, a, b in zip(where.tolist(), item.tolist(), begin.tolist(), end.tolist()):
                        spans, matched = got.setdefault(t, (set(), set()))
                        spans.add((a, b))
                        matched.add(i)
                    shift = np.asarray(row["first"]) - origin
                    rows = []
                    for t in range(len(row["row"])):
                        spans, matched = got.get(t, ((), ()))
                        rows.append({
                            "row": row["row"][t], "key": row["key"][t], "words": int(segment.until[t] + shift[t]),
                            "spans": [{"begin": a, "until": b} for a, b in joined(spans, int(shift[t]))],
                            "items": [names[i] for i in matched if names[i] is not None],
                        })
                    kinds = pa.schema([
                        ("row", pa.int64()), ("key", batch.schema.field("key").type.value_type), ("words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("until", pa.int64())]))), ("items", pa.list_(arrow_kind)),
                    ])
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

        from pyspark.sql.pandas.types import to_arrow_type

        arrow_kind = to_arrow_type(items.schema[key].dataType)
        columns = f"row long, key {kind}, words long, spans array<struct<begin:long,until:long>>, items array<{item_kind}>"
        out.append(stage(index.mapInArrow(search, columns), "index_matches"))
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d)
    return whole


def joined(spans, shift: int) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one, shifted."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a + shift <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + shift)
        else:
            out.append([a + shift, b + shift])
    return [(a, b) for a, b in out]


def covered(spans: Column) -> Column:
    """How many places the ranges cover together."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("until"))

    def add(acc: Column, s: Column) -> Column:
        more = F.greatest(s["until"] - F.greatest(s["begin"], acc["until"]), F.lit(0))
        return F.struct((acc["total"] + more).alias("total"), F.greatest(acc["until"], s["until"]).alias("until"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["total"])


def _by_document(pieces: DataFrame) -> DataFrame:
    """Pieces of a text, and answers to several blocks, as one row: key, n_words, spans, items."""
    return pieces.groupBy("row").agg(
        F.first("key").alias("key"), F.max("words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    ).drop("row")


def phrase_matches(index: DataFrame, items: DataFrame, window: int, key: str = "item_id", text: str = "text", block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """One row per indexed row: key, n_words, spans (words inside an occurrence), items (ids whose windows occur).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Items
    without words match nothing, repeated ones count once, one without an id marks words but isn't listed.
    """
    if window > overlap + 1:
        raise ValueError(f"texts are indexed in pieces that share {overlap} words; build the index with a larger overlap")

    def prepare(tokens: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        by: dict[int, list] = {}
        for i, t in enumerate(tokens):
            if len(t):
                size = min(window, len(t))
                by.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(t, size), np.full(len(t) - size + 1, i)))
        return [tuple(np.concatenate(x) for x in zip(*parts)) for parts in by.values()]

    def find(segment: Segment, query: list, numbers: np.ndarray) -> tuple:
        out = [(np.zeros(0, "int64"),) * 3]
        for windows, item in query if segment.words else []:
            for lo in range(0, len(windows), 1 << 16):
                phrase, start = segment.phrases(numbers[windows[lo : lo + (1 << 16)]])
                out.append((item[lo + phrase], start, start + windows.shape[1]))
        return tuple(np.concatenate(x) for x in zip(*out))

    return _by_document(_search(index, items, key, text, block, prepare, find))


def proximity_matches(index: DataFrame, items: DataFrame, span: int, key: str = "item_id", text: str = "text", block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """As ``phrase_matches``, for runs of ``span`` words at most that hold all the words of an item, in any order.

    Spans are the runs that have no smaller such run within; an item with more distinct words than ``span`` has none.
    """
    if span > overlap + 1:
        raise ValueError(f"texts are indexed in pieces that share {overlap} words; build the index with a larger overlap")

    def find(segment: Segment, query: list, numbers: np.ndarray) -> tuple:
        out = [(np.zeros(0, "int64"),) * 3]
        for i, words in enumerate(query):
            if segment.words and len(words) <= span:
                begin, end = segment.near(numbers[words], span)
                out.append((np.full(len(begin), i), begin, end))
        return tuple(np.concatenate(x) for x in zip(*out))

    return _by_document(_search(index, items, key, text, block, lambda tokens: [np.unique(t) for t in tokens], find))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word is hit if it stands inside an occurrence of an item's window. Null texts have no words and match nothing;
    repeated rows give a row each; without items nothing is hit; an empty table gives no rows.
    """
    found = phrase_matches(build_index(docs, key, text), items, window, item)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("key").alias(key), "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )
