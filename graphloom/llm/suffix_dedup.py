"""Removal of repeated byte strings with a hash-compared suffix sort.

Every window of ``size`` bytes has an anchor: the place of its smallest k-gram hash. Equal windows have equal anchors
at equal distance, so only suffixes of one anchor and distance are compared. Starts that share an anchor form a
segment. Segments equal as a whole, by a 128-bit cryptographic digest of their bytes, are repeated as a whole; of the
others, one per content goes to the suffix sort of its anchor's group.

There, prefix polynomial hashes and binary search give the common extension of two suffixes, so that a comparison takes
logarithmic time; mergesort runs over all groups of a batch at once; neighbours with a common extension of a whole window
are verified byte by byte.

A group too large for one task is split by what equal windows always share: windows whose distances fall in one run of
STEP share a core of bytes, so segments are cut into such runs, and (anchor, run, core) takes the anchor's place. Parts
equal as a whole are repeated, the rest is sorted per core. A core that too many different parts share (the rim of a
common passage) is resolved by digests of its single windows. So no group is held by one task, and only parts of large
groups take the extra steps.

All joins shuffle both sides, as all tables here grow with the text; so every size runs by one plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import rolling
from graphloom.llm.text import join_decisions, or_empty
from graphloom.runtime import prepare_python, stage

SIZE = 200
GRAM = 32
#: Different segments of an anchor, or parts with one core, that are sorted in one task; larger groups are split.
BLOCK = 3000
#: Distances that are grouped together.
STEP = 16
#: Bytes of a text that are hashed at once, and low bits of an ordering value that hold the place.
PIECE, PLACE_BITS = 2 << 20, 24
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of ``w`` values, from prefix and suffix minima of blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def segments(texts: list[bytes], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all windows of texts in one buffer: text index, first start, distance to the anchor, starts, anchor and two digest halves."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, "uint8")
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < size:
        return tuple(np.zeros(0, "int64") for _ in range(7))
    prefix = rolling.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = rolling.mixed(rolling.range_hash(prefix, at, at + gram))
    order = (grams & ~_PLACE) | at.astype("uint64")
    anchor = (sliding_min(order, size - gram + 1) & _PLACE).astype("int64")
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    valid = start + size <= ends[text]
    new = valid & np.concatenate(([True], ~valid[:-1] | (anchor[1:] != anchor[:-1])))
    first = np.flatnonzero(new)
    stop = valid & np.concatenate((~valid[1:] | (anchor[1:] != anchor[:-1]), [True]))
    count = np.flatnonzero(stop) - first + 1
    a = anchor[first]
    whole = digests([raw[i:j] for i, j in zip(first.tolist(), (first + count + size - 1).tolist())])
    begin = np.concatenate(([0], ends[:-1]))[text[first]]
    return text[first], first - begin, a - first, count, grams[a].view("int64"), whole[:, 0], whole[:, 1]


def digests(strings: list[bytes]) -> np.ndarray:
    """BLAKE2b digests of 128 bits, as rows of two longs."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(x, digest_size=16).digest() for x in strings]), "int64").reshape(-1, 2)


def parts(anchor: int, rel: int, n: int, raw: bytes, size: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A segment's runs of distances: anchor of the run and its core, first start, distance there, starts, bytes."""
    for run in range((rel - n + 1) // STEP, rel // STEP + 1):
        far, near = min(rel, STEP * run + STEP - 1), max(rel - n + 1, STEP * run)
        at, k = rel - far, far - near + 1
        core = raw[rel - STEP * run : rel - STEP * run + size - STEP + 1]
        name = hashlib.blake2b(b"%d %d " % (anchor, run) + core, digest_size=8).digest()
        yield int.from_bytes(name, "little", signed=True), at, far, k, raw[at : at + k + size - 1]


class _Suffixes:
    """Suffixes of a buffer compared over ``size`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, size: int):
        self.data, self.size, self.prefix = data, size, rolling.prefix_hash(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes, by binary search over hash equality."""
        low, high = np.zeros(len(x), "int64"), np.full(len(x), self.size)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = rolling.range_hash(self.prefix, x, x + mid) == rolling.range_hash(self.prefix, y, y + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x sorts before, with or after y."""
        e = self.extension(x, y)
        short = e < self.size
        i = np.where(short, e, 0)
        return np.where(short, np.sign(self.data[x + i].astype("int16") - self.data[y + i].astype("int16")), 0)

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes ``at`` within their groups (ascending runs of equal numbers): mergesort, all groups at once."""
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((first, [len(group)])))
        inside = np.arange(len(group)) - np.repeat(first, sizes)
        size_of, base = np.repeat(sizes, sizes), np.repeat(first, sizes)
        order, width = np.arange(len(group)), 1
        while width < sizes.max(initial=0):
            run = inside // width
            partner = base + (run ^ 1) * width
            length = np.clip(base + size_of - partner, 0, width)
            low, high, left = np.zeros(len(order), "int64"), length.copy(), run % 2 == 0
            me = at[order]
            while len(todo := np.flatnonzero(low < high)):
                mid = (low[todo] + high[todo]) // 2
                c = self.before(at[order[partner[todo] + mid]], me[todo])
                smaller = np.where(left[todo], c < 0, c <= 0)  # of equals the left run's come first
                low[todo], high[todo] = np.where(smaller, mid + 1, low[todo]), np.where(smaller, high[todo], mid)
            pair = base + run // 2 * 2 * width
            place = pair + inside - run * width + low
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, width * 2
        return order

    def equal_neighbours(self, order: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each sorted suffix whether it equals the one before it in its group, verified by its bytes."""
        x, y = at[order[:-1]], at[order[1:]]
        same = (group[order[:-1]] == group[order[1:]]) & (self.extension(x, y) == self.size)
        hit = np.flatnonzero(same)
        for lo in range(0, len(hit), 4096):
            some, span = hit[lo : lo + 4096], np.arange(self.size)
            if not (self.data[x[some][:, None] + span] == self.data[y[some][:, None] + span]).all():
                raise ArithmeticError("two different windows have one hash; choose another base")
        return np.concatenate(([False], same))


def _sorted_windows(rows: dict[str, np.ndarray], bytes_of: list[bytes], size: int):
    """All windows of segments by (group, distance): segment, offset in it, and how many windows are equal to it, itself included."""
    data = np.frombuffer(b"".join(bytes_of), "uint8")
    lengths = np.array([len(b) for b in bytes_of])
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    count = lengths - size + 1
    seg = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    distance = rows["rel"][seg] - offset
    key = rows["group"][seg] * (2 * size) + distance
    at = begin[seg] + offset
    s = _Suffixes(data, size)
    # Windows whose distances fall in one run of STEP share the bytes between the run's ends: only where these are
    # equal too can windows be, so suffixes meet in small groups.
    core = at + distance % STEP
    inner = rolling.range_hash(s.prefix, core, core + size - (STEP - 1))
    pre = np.lexsort((inner, key))
    seg, offset, key, at, inner = seg[pre], offset[pre], key[pre], at[pre], inner[pre]
    key = np.cumsum(np.concatenate((np.zeros(min(1, len(key)), bool), (key[1:] != key[:-1]) | (inner[1:] != inner[:-1]))))
    many = np.bincount(key)[key] > 1 if len(key) else np.zeros(0, bool)
    some = np.flatnonzero(many)  # a window alone in its group has no equal
    if not len(some):
        return seg[:0], offset[:0], offset[:0]
    order = s.sort(at[some], key[some])
    cls = np.cumsum(~s.equal_neighbours(order, at[some], key[some])) - 1
    return seg[some[order]], offset[some[order]], np.bincount(cls)[cls]


def _runs(seg: np.ndarray, offset: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments and byte spans [lo, hi) in the text of runs of adjoining starts."""
    o = np.lexsort((offset, seg))
    seg, offset = seg[o], offset[o]
    new = np.concatenate(([True], (seg[1:] != seg[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(seg) else np.zeros(0, bool)
    last = np.concatenate((new[1:], [True])) if len(seg) else new
    return seg[new], first[seg[new]] + offset[new], first[seg[last]] + offset[last] + size


def _matched(segs: DataFrame, label: str, windows: int) -> tuple[DataFrame, DataFrame]:
    """Spans (row, lo, hi, long) of segments whose bytes stand elsewhere too, and what is left to sort.

    ``segs``: row, anchor, whole, check, lo, rel, n. Left are the contents (row, lo, anchor, rel, n, c: how many have it,
    m: contents of the anchor) of anchors with two contents or more, one of them lone.
    """
    shared = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    segs = stage(segs.join(stage(shared, f"{label}_anchors", windows), "anchor"), f"{label}_shared", windows)
    content = ["anchor", "whole", "check", "rel", "n"]
    contents = segs.groupBy(*content).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "lo")).alias("one"))
    contents = stage(contents, f"{label}_contents", windows)
    return segs.join(contents.filter("c > 1").select(*content), content), contents


def _left(contents: DataFrame) -> DataFrame:
    per = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("fewest")).filter("m > 1 and fewest = 1")
    return contents.join(per.select("anchor", "m"), "anchor").select("one.row", "one.lo", "anchor", "rel", "n", "c", "m")


_KINDS = {"anchor": pa.int64(), "m": pa.int64(), "rel": pa.int32(), "n": pa.int32(), "c": pa.int64(), "lo": pa.int32(), "row": pa.int64()}
_CUT = "anchor long, m long, rel int, n int, c long, lo int, row long, bytes binary"


def repeated_spans(docs: DataFrame, slim: DataFrame, key: str, text: str, size: int, gram: int) -> DataFrame:
    """Spans (row, lo, hi) of bytes under repeated windows; they may overlap. ``slim``: row, id, _hash, segs."""
    windows = slim.agg(F.coalesce(F.sum(F.size("segs")), F.lit(0))).first()[0]
    spans = lambda x: x.select("row", F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("n") + (size - 1)).cast("long").alias("hi"))
    full, contents = _matched(slim.select("row", F.explode("segs").alias("s")).select("row", "s.*"), "segments", windows)
    wanted = _left(contents).groupBy("row").agg(F.collect_list(F.struct(*[c for c in _KINDS if c != "row"])).alias("parts"))
    wanted = wanted.select("row", F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in _KINDS if c != "row"], F.col("row").alias("row"))).alias("parts"))
    names = slim.select("row", F.col("id").alias("_id"), "_hash")
    wanted = stage(wanted.join(names, "row").groupBy("_id", "_hash").agg(F.flatten(F.collect_list("parts")).alias("parts")), "wanted")
    held = join_decisions(docs.dropDuplicates([key, text]) if not _unique(slim) else docs, wanted, "inner", key, text, measure=False)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (r for lo in range(0, batch.num_rows, 64) for r in batch.slice(lo, 64).to_pylist()):
                raw, some = r["text"].encode(), r["parts"]
                cols = {c: pa.array([p[c] for p in some], t) for c, t in _KINDS.items()}
                yield pa.RecordBatch.from_pydict(cols | {"bytes": pa.array([raw[p["lo"] : p["lo"] + p["n"] + size - 1] for p in some], "binary")})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            rows = [(r["row"], r["lo"] + at, *rest) for r in batch.to_pylist() for at, *rest in (
                (at, anchor, rel, n, raw) for anchor, at, rel, n, raw in parts(r["anchor"], r["rel"], r["n"], r["bytes"], size))]
            row, lo, anchor, rel, n, raw = zip(*rows)
            d = digests(list(raw))
            cols = [pa.array(row), pa.array(anchor), pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(x, "int32") for x in (lo, rel, n)), pa.array(raw, "binary")]
            yield pa.RecordBatch.from_arrays(cols, ["row", "anchor", "whole", "check", "lo", "rel", "n", "bytes"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            rows = [(r["row"], r["lo"] + i, r["anchor"], r["bytes"][i : i + size]) for r in batch.to_pylist() for i in range(r["n"])]
            row, lo, anchor, raw = zip(*rows)
            d = digests(list(raw))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(lo, "int32"), pa.array(anchor), pa.array(d[:, 0]), pa.array(d[:, 1])], ["row", "lo", "anchor", "whole", "check"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            rows = {c: t.column(c).to_numpy() for c in ("anchor", "rel", "c", "lo", "row")}
            rows["group"] = np.cumsum(np.concatenate(([True], np.diff(rows["anchor"]) != 0))) - 1
            rows["rel"] = rows["rel"].astype("int64")
            seg, offset, n = _sorted_windows(rows, t.column("bytes").to_pylist(), size)
            hit = (n > 1) & (rows["c"][seg] == 1)
            g, lo, hi = _runs(seg[hit], offset[hit], rows["lo"].astype("int64"), size)
            yield pa.RecordBatch.from_arrays([pa.array(rows["row"][g]), pa.array(lo), pa.array(hi)], ["row", "lo", "hi"])

    cut = held.select(or_empty(f"d.`{text}`").alias("text"), "x.parts").mapInArrow(slices, _CUT)
    cut = stage(cut, "cut")
    found, small, large = [spans(full)], cut.filter(F.col("m") <= BLOCK), cut.filter(F.col("m") > BLOCK)
    if not large.isEmpty():
        runs = stage(large.mapInArrow(split, "row long, anchor long, whole long, check long, lo int, rel int, n int, bytes binary"), "runs")
        full, contents = _matched(runs.drop("bytes"), "runs", 12 * windows)
        cut = stage(_left(contents).join(runs.select("row", "lo", "anchor", "bytes"), ["row", "lo", "anchor"]).select(*small.columns), "run_bytes")
        small, large = small.unionByName(cut.filter(F.col("m") <= BLOCK)), cut.filter(F.col("m") > BLOCK)
        each = large.mapInArrow(single, "row long, lo int, anchor long, whole long, check long")
        same = ["anchor", "whole", "check"]
        each = stage(each, "single")
        twice = each.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*same)
        found += [spans(full), spans(each.join(twice, same).withColumn("n", F.lit(1)))]
    dealt = small.repartition("anchor").sortWithinPartitions("anchor")
    found.append(stage(dealt.mapInArrow(sort, "row long, lo long, hi long"), "found"))
    return reduce(DataFrame.unionByName, found)


def _unique(slim: DataFrame) -> bool:
    return slim.groupBy("id", "_hash").count().filter("count > 1").isEmpty()


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 3000) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows that end where an anchor does."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            held.append(batch.slice(lo, most))
            rows += held[-1].num_rows
            if rows >= most:
                t = pa.Table.from_batches(held).combine_chunks()
                a = t.column("anchor").to_numpy()
                other = np.flatnonzero(a != a[-1])
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield t.slice(0, whole)
                held, rows = t.slice(whole).to_batches(), t.num_rows - whole
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _pieces(raw: bytes, size: int) -> list[tuple[int, bytes]]:
    """Overlapping pieces of a text, such that each window lies in one of them, from its start in the text."""
    return [(b, raw[b : b + PIECE + size - 1]) for b in range(0, max(len(raw) - size + 1, 1), PIECE)]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, want_text: bool = False) -> DataFrame:
    """One row per input row: ``key``, n_bytes, n_removed, n_spans, kept_sha256; ``want_text`` adds kept_text.

    A byte goes if a string of ``size`` bytes that covers it also starts anywhere else, in the same text or another;
    strings are judged on the input. Null text counts as empty. Repeated rows repeat each other's strings, so texts of
    ``size`` bytes or more go whole. An empty table gives no rows. Other columns of ``docs`` are not read.
    A kept text may begin or end inside a character; kept_text replaces such bytes. A text of any length is hashed in
    overlapping pieces of PIECE bytes, in one task.
    """
    prepare_python(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.xxhash64(or_empty(text)).alias("_hash"), or_empty(text).alias("text"))
    seg = pa.struct([("anchor", pa.int64()), ("whole", pa.int64()), ("check", pa.int64()), ("lo", pa.int32()), ("rel", pa.int32()), ("n", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            pieces = [(i, b, p) for i, t in enumerate(texts) for b, p in _pieces(t, size)]
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i, j in rolling.buffers([p for _, _, p in pieces]):
                piece, lo, rel, n, anchor, whole, check = segments([p for _, _, p in pieces[i:j]], size, gram)
                base = np.array([b for _, b, _ in pieces[i:j]])
                owner = np.array([k for k, _, _ in pieces[i:j]])
                for c, x in zip(cols, (owner[piece], lo + base[piece], rel, n, anchor, whole, check)):
                    c.append(x)
            owner, lo, rel, n, anchor, whole, check = (np.concatenate(c) if c else np.zeros(0, "int64") for c in cols)
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype("int32")
            values = pa.StructArray.from_arrays([pa.array(anchor), pa.array(whole), pa.array(check), *(pa.array(x.astype("int32")) for x in (lo, rel, n))], fields=list(seg))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("id"), batch.column("_hash"), pa.array([len(t) for t in texts], "int64"),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(pa.array(offsets), values),
            ], ["row", "id", "_hash", "n_bytes", "sha256", "segs"])

    slim = d.mapInArrow(scan, f"row long, id {kind}, _hash long, n_bytes long, sha256 string, segs array<struct<anchor long, whole long, check long, lo int, rel int, n int>>")
    slim = stage(slim, "segments")
    spans = repeated_spans(docs, slim, key, text, size, gram)
    spans = spans.groupBy("row").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                lo, hi = np.array(lo), np.array(hi)
                o = np.argsort(lo)
                lo, reach = lo[o], np.maximum.accumulate(hi[o])
                new = np.concatenate(([True], lo[1:] > reach[:-1]))
                rows.append((lo[new].tolist(), reach[np.concatenate((new[1:], [True]))].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (0, 1))], ["row", "lo", "hi"])

    spans = spans.mapInArrow(merge, "row long, lo array<long>, hi array<long>")
    names = slim.select("row", F.col("id").alias("_id"), "_hash")
    spans = stage(spans.join(names, "row").groupBy("_id", "_hash").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi")), "spans")
    touched = join_decisions(docs, spans, "inner", key, text, measure=False)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            rows = []
            for r in batch.select(["text", "lo", "hi"]).to_pylist():
                raw = r["text"].encode()
                kept = b"".join(raw[a:b] for a, b in zip([0, *r["hi"]], [*r["lo"], len(raw)]))
                rows.append((len(raw) - len(kept), len(r["lo"]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            cols = [pa.array(list(c)) for c in zip(*rows)][: 4 if want_text else 3]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), *cols], ["_id", "_hash", "n_removed", "n_spans", "kept", "text"][: 2 + len(cols)])

    fields = f"_id {kind}, _hash long, n_removed long, n_spans long, kept string" + ", text string" * want_text
    done = touched.select("x._id", "x._hash", or_empty(f"d.`{text}`").alias("text"), "x.lo", "x.hi").mapInArrow(keep, fields)
    done = stage(done, "done")
    if not _unique(slim):
        done = done.groupBy("_id", "_hash").agg(*[F.first(c).alias(c) for c in done.columns[2:]])
    s, x = slim.drop("segs").alias("s"), done.alias("x")
    out = s.join(x, F.col("s.id").eqNullSafe(F.col("x._id")) & (F.col("s._hash") == F.col("x._hash")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    cols = [F.col("s.id").alias(key), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256")]
    return out.select(*cols, *([F.col("x.text").alias("kept_text")] if want_text else []))
