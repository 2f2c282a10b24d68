"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks that overlap. Chunks are pre-tokenised, in parallel if they are many, each from its own start. A pre-token
is found from its start onwards alone, so once two neighbours share a boundary they agree from there on: the chunks are
stitched at the first boundary that both have in their overlap, where the right one has resynchronised. Then the pieces
are encoded. Where an overlap has no shared boundary (it is one long run of letters, say) the two chunks are joined and
pre-tokenised anew. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import or_empty
from graphloom.runtime import prepare_python

#: Characters of a chunk, and of its overlap with the next; texts of up to SPREAD characters are chunked within one task.
CHUNK, OVERLAP = 4_096, 256
SPREAD = 32_768
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 200_000


@functools.lru_cache(4)
def _codec(path: str, pattern: str):
    """A tiktoken encoding for a rank file, the compiled pattern, decimal strings of the ids, remembered pieces, and tokens' bytes."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    most = max(ranks.values()) + 1
    tokens = dict(zip(ranks.values(), ranks))
    return encoding, regex.compile(pattern), [str(i) for i in range(most)], {}, [tokens.get(i, b"") for i in range(most)]


def decoded(ids: list[int], codec) -> bytes:
    """The ids' bytes, one after the other."""
    tokens = codec[4]
    return b"".join([tokens[i] for i in ids])


def digests(ids: list[int], codec) -> tuple[int, str, str]:
    """Count of the ids, SHA-256 of their decimals joined by commas, and of the bytes they decode to."""
    names = codec[2]
    joined = ",".join([names[i] for i in ids]).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded(ids, codec)).hexdigest()


def pretokenise(text: str, codec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the text's pre-tokens, for each the index of its first id, and all ids."""
    encode, known = codec[0]._core_bpe.encode_single_piece, codec[3]
    pieces = codec[1].findall(text) if not codec[1].groups else [m[0] for m in codec[1].finditer(text)]
    sizes = np.fromiter(map(len, pieces), "int64", len(pieces))
    starts = np.cumsum(sizes) - sizes
    if sizes.sum() != len(text):  # the pattern passes over some characters
        starts = np.fromiter((m.start() for m in codec[1].finditer(text)), "int64", len(pieces))
    got = [known.get(p) for p in pieces]
    for k, ids in enumerate(got):
        if ids is None:
            got[k] = ids = encode(pieces[k].encode())
            if len(pieces[k]) <= 64:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[pieces[k]] = ids
    counts = np.fromiter(map(len, got), "int64", len(got))
    return starts, np.cumsum(counts) - counts, np.fromiter(itertools.chain.from_iterable(got), "int32", int(counts.sum()))


def cut(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, text) of the overlapping chunks, one at least; all but the last have full length."""
    return [(b, text[b : b + chunk + overlap]) for b in range(0, max(len(text) - overlap, 1), chunk)]


def _resyncs(text: str) -> bool:
    """Whether a non-space is followed by white space, which is always a pre-token boundary."""
    return any(not a.isspace() and b.isspace() for a, b in zip(text, text[1:]))


def encode_chunk(start: int, text: str, last: bool, codec, overlap: int = OVERLAP) -> dict:
    """A chunk's ids, with the boundaries in its overlaps; its text where an overlap may not resynchronise."""
    s, f, ids = pretokenise(text, codec)
    head = s < overlap
    tail = (s >= len(text) - overlap) & (s < len(text)) & (not last)
    sure = (start == 0 or _resyncs(text[:overlap])) and (last or _resyncs(text[-overlap:]))
    return {
        "start": start, "last": last, "ids": ids, "text": None if sure else text,
        "head": np.stack([s[head] + start, f[head]]), "tail": np.stack([s[tail] + start, f[tail]]),
    }


def stitch(chunks: list[dict], codec, overlap: int = OVERLAP) -> list[int]:
    """The whole text's ids from its chunks in order."""
    out: list[int] = []
    here, begin = chunks[0], 0
    for right in chunks[1:]:
        common, i, j = np.intersect1d(here["tail"][0], right["head"][0], return_indices=True)
        if len(common):
            out += here["ids"][begin : here["tail"][1][i[0]]].tolist()
            here, begin = right, int(right["head"][1][j[0]])
        else:  # joined from where the left one is right, or from its own start if nothing of it is out yet
            merged = here["text"] + right["text"][overlap:]
            whole = encode_chunk(here["start"], merged, right["last"], codec, overlap)
            whole["text"] = merged
            if begin:  # boundaries up to there are as before, so its first pre-token to keep is found again by place
                at = here["head"][0][list(here["head"][1]).index(begin)]
                begin = int(whole["head"][1][list(whole["head"][0]).index(at)])
            here = whole
    return out + here["ids"][begin:].tolist()


def encode_text(text: str, codec, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """A text's ids by its chunks."""
    parts = cut(text, chunk, overlap)
    return stitch([encode_chunk(b, t, b == parts[-1][0], codec, overlap) for b, t in parts], codec, overlap)


def _results(schema: str, want_ids: bool):
    return schema + (", ids array<int>" if want_ids else ", n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", want_ids: bool = False,
    chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD,
) -> DataFrame:
    """One row per input row: ``key`` and either the token ids or n_tokens, ids_sha256 and decoded_sha256.

    ``vocabulary`` is the path of a tiktoken rank file, at the same place on every machine. Null text counts as empty;
    an empty text has no tokens, and digests of nothing. Repeated rows, and rows of equal or null ids, each give a row.
    An empty table gives no rows. Other columns of ``docs`` are not read. All texts are encoded by chunks; those of a text of more
    than ``spread`` characters go to several tasks, and only its ids meet again.
    """
    prepare_python(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("key"), or_empty(text).alias("text"))
    kinds = _results(f"key {kind}", want_ids)

    def result(key, ids: list[int], codec) -> tuple:
        return (key, ids) if want_ids else (key, *digests(ids, codec))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [
                    result(k, encode_text(t, codec, chunk, overlap), codec)
                    for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                ]
                yield _batch(rows, want_ids, part.schema.field(0).type)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = cut(row["text"], chunk, overlap)
                for lo in range(0, len(parts), 64):
                    some = parts[lo : lo + 64]
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row["row"]] * len(some), "int64"),
                        "key": pa.array([row["key"]] * len(some), batch.schema.field("key").type),
                        "start": pa.array([b for b, _ in some], "int64"),
                        "last": pa.array([b == parts[-1][0] for b, _ in some]),
                        "text": pa.array([t for _, t in some], "string"),
                    })

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                done = [encode_chunk(r["start"], r["text"], r["last"], codec, overlap) for r in part.to_pylist()]
                arrays = {c: part.column(c) for c in ("row", "key", "start", "last")}
                for c in ("ids", "head", "tail"):
                    arrays[c] = pa.array([x[c].tobytes() for x in done], "binary")
                arrays["text"] = pa.array([x["text"] for x in done], "string")
                yield pa.RecordBatch.from_pydict(arrays)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(vocabulary, pattern)
        chunks = []
        for r in rows.sort_values("start").itertuples():
            pair = {c: np.frombuffer(getattr(r, c), "int64").reshape(2, -1) for c in ("head", "tail")}
            chunks.append({"start": r.start, "last": r.last, "ids": np.frombuffer(r.ids, "int32"), "text": r.text, **pair})
        row = result(rows["key"].iloc[0], stitch(chunks, codec, overlap), codec)
        return pd.DataFrame([row], columns=[c.split()[0] for c in kinds.split(", ")])

    is_long = F.char_length("text") > spread
    long = d.filter(is_long).withColumn("row", F.monotonically_increasing_id())
    long = long.mapInArrow(pieces, f"row long, key {kind}, start long, last boolean, text string").repartition("row", "start")
    long = long.mapInArrow(encode, f"row long, key {kind}, start long, last boolean, ids binary, head binary, tail binary, text string")
    out = d.filter(~is_long).mapInArrow(short, kinds).unionByName(long.groupBy("row").applyInPandas(join, kinds))
    return out.withColumnRenamed("key", key)


def _batch(rows: list[tuple], want_ids: bool, kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    if want_ids:
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.list_(pa.int32()))], ["key", "ids"])
    arrays = [pa.array(cols[0], kind), pa.array(cols[1], "int64"), pa.array(cols[2], "string"), pa.array(cols[3], "string")]
    return pa.RecordBatch.from_arrays(arrays, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``, the concatenated bytes of its token ids; null ids give null, no ids give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            got = [None if x is None else decoded(x, codec) for x in column]
            yield batch.append_column("bytes", pa.array(got, "binary"))

    from pyspark.sql import types as T

    schema = T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())])
    return encoded.mapInArrow(decode, schema)
