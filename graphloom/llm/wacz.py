"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extraction.

The reader finds the end-of-central-directory record (or its ZIP64 form), parses the central directory, and takes from it
the WARC members under ``archive/`` and the CDX or CDXJ members under ``indexes/``, whatever their names; local headers
say where stored members begin. Index lines name a record's member, place and length; ranges that adjoin are read together.
WARC members that no index covers are walked record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import few, prepare_python, scratch_path, stage

#: Fixed values of the ZIP format: signatures, and the mark of a field kept in the ZIP64 extra field.
EOCD, EOCD64_LOCATOR, EOCD64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
IN_EXTRA = 0xFFFFFFFF
#: Bytes of WARC data in an archive, and of a range that a task reads at once.
ARCHIVE = 64 << 20
RANGE = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Members of a package that hold records, and those that index them.
_WARC, _INDEX = re.compile(r"archive/.*\.warc(\.gz)?"), re.compile(r"indexes/.*\.cdxj?(\.gz)?")


def _file(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


# ---- records


def target_of(url: str | None) -> str:
    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")


def sort_key(url: str) -> str:
    """The host's labels from the last to the first, then the rest of the address, in lower case."""
    parts = urlsplit(url)
    host = ",".join(reversed((parts.hostname or "").split(".")))
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower().replace(" ", "%20")


def index_line(url: str, date: str, kind: str, digest: str, at: int, n: int) -> str:
    """A CDXJ line: sort key, 14-digit date, and a JSON object."""
    fields = {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(n), "offset": str(at), "filename": DATA.rpartition("/")[2]}
    return f"{sort_key(url)} {re.sub(r'[^0-9]', '', date)[:14]} {json.dumps(fields)}"


def parse_index(raw: bytes) -> list[tuple[str | None, int, int | None]]:
    """(file name, place, length) of each line: CDXJ, or CDX by the letters of its head line (S, V and g: length, place, file)."""
    out, letters = [], []
    for line in raw.decode("utf-8", "replace").splitlines():
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif "{" in line:
            fields = json.loads(line[line.index("{") :])
            if "offset" in fields:
                out.append((fields.get("filename"), int(fields["offset"]), int(fields["length"]) if "length" in fields else None))
        elif letters and len(cells := line.split()) == len(letters):
            named = dict(zip(letters, cells))
            out.append((named.get("g"), int(named["V"]), int(named["S"]) if named.get("S", "-").isdigit() else None))
    return out


def record(kind: str, page_id, url: str | None, payload: bytes, length: int, digest: str, refers_to, date: str) -> bytes:
    """A WARC record as a gzip member. A revisit has the HTTP header of the response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    target = target_of(url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(member: bytes) -> dict:
    """A record's fields; raises ValueError if it is cut short or a response's payload differs from its digest."""
    raw = member if member.startswith(b"WARC/") else zlib.decompress(member, 31)
    head, sep, rest = raw.partition(b"\r\n\r\n")
    fields = _headers(head)
    size = int(fields.get("content-length", -1))
    if not sep or not head.startswith(b"WARC/") or size < 0 or len(rest) < size:
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    digest, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload differs from its digest")
    ident = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    length = len(payload) if kind == "response" else int(_headers(http).get("content-length", 0))
    return {
        "page_id": ident(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length,
        "payload_digest": digest, "record_type": kind, "refers_to": ident(fields.get("warc-refers-to", "")),
        "payload": payload if kind == "response" else None,
    }


# ---- ZIP directories


def read_directory(read, size: int) -> dict[str, dict]:
    """Members by name: method, packed and plain size, place of the local header. ``read(offset, n)`` gives bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(EOCD)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or IN_EXTRA in (length, start):
        place = at - 20
        locator = tail[place : place + 20] if place >= 0 else read(tail_at + place, 20)
        if locator[:4] != EOCD64_LOCATOR:
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end[:4] != EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    raw, at, members = read(start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
        packed, plain, n, x, c = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        local = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = raw[at + 46 + n : at + 46 + n + x], 0
        while k + 4 <= len(extra):
            tag, m = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{m // 8}Q", extra[k + 4 : k + 4 + m // 8 * 8]))
                plain = next(wide) if plain == IN_EXTRA else plain
                packed = next(wide) if packed == IN_EXTRA else packed
                local = next(wide) if local == IN_EXTRA else local
            k += 4 + m
        members[name] = {"method": method, "packed": packed, "plain": plain, "local": local}
        at += 46 + n + x + c
    return members


def data_start(read, member: dict, stored: bool = True) -> int:
    """Where a member's bytes begin; it must be stored, not packed, if ``stored``."""
    head = read(member["local"], 30)
    if head[:4] != LOCAL or stored and member["method"] != 0:
        raise ValueError("not a stored member")
    n, x = struct.unpack("<HH", head[26:30])
    return member["local"] + 30 + n + x


# ---- writing


class _Archive:
    """An archive being written; records stream into the stored WARC member, the index follows."""

    def __init__(self, uri: str, date: str):
        self.uri, self.lines, self.at, self.date = uri, [], 0, date
        fs, path = _file(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Unseekable(self.sink), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, member: bytes, url: str | None, kind: str, digest: str) -> None:
        self.data.write(member)
        self.lines.append(index_line(target_of(url), self.date, kind, digest, self.at, len(member)))
        self.at += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in sorted(self.lines)))
        resources = [{"path": DATA, "bytes": self.at}, {"path": INDEX, "records": len(self.lines)}]
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": resources}))
        self.zip.close()
        self.sink.close()
        return self.uri, len(self.lines), self.at


class _Unseekable(io.RawIOBase):
    def __init__(self, sink):
        self.sink = sink

    def writable(self):
        return True

    def write(self, data):
        self.sink.write(bytes(data))
        return len(data)


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0,
    archive: int = ARCHIVE, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per page into archives under ``folder``; their manifest (uri, records, bytes).

    Of pages with equal payloads of ``min_revisit`` bytes or more, the largest id is the response, others revisit it;
    rows repeated with that id are responses too, and null ids revisit it (where all ids are null, all are responses).
    Null html is an empty payload, null url about:blank. A payload of any length is one record, held whole by its task. An
    empty table gives an empty manifest. The manifest has only archives of attempts that succeeded.
    """
    prepare_python(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    digest = F.unhex(F.sha1(payload))
    slim = pages.select(digest.alias("digest"), F.col(key).alias("id"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_revisit)
    repeated = slim.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 and keep is not null")
    repeated = stage(repeated.select("digest", "keep", "rows"), "repeated")
    all_pages = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), digest.alias("digest"))
    if few(repeated):
        marked = all_pages.join(F.broadcast(repeated), "digest", "left")
    else:
        # Pages of frequent payloads (1,000 digests at most) are marked where they are; only the others meet by digest.
        total = repeated.agg(F.sum("rows")).first()[0]
        often = F.broadcast(repeated.filter(F.col("rows") * 1000 >= total))
        marked = all_pages.join(often, "digest").unionByName(all_pages.join(often, "digest", "left_anti").join(repeated, "digest", "left"))
    marked = marked.select("id", "url", "payload", "digest", "keep")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for r in (r for lo in range(0, batch.num_rows, 256) for r in batch.slice(lo, 256).to_pylist()):
                out = out or _Archive(f"{folder}/{uuid.uuid4().hex}.wacz", date)
                revisit = r["keep"] is not None and r["keep"] != r["id"]
                digest = base64.b32encode(r["digest"]).decode()
                body, n = b"" if revisit else r["payload"], len(r["payload"])
                kind = "revisit" if revisit else "response"
                out.add(record(kind, r["id"], r["url"], body, n, digest, r["keep"], date), r["url"], kind, digest)
                if out.at >= archive:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("uri", "records", "bytes"), map(pa.array, zip(*done)))))

    return stage(marked.mapInArrow(write, "uri string, records long, bytes long"), "manifest")


# ---- reading


def record_spans(read, size: int) -> list[tuple[str, int, int]]:
    """(member, place in the package, length) of all records of a package of ``size`` bytes; ``read(offset, n)`` gives bytes."""
    members = read_directory(read, size)
    data = {name: data_start(read, m) for name, m in members.items() if _WARC.fullmatch(name)}
    by_file = {name.rpartition("/")[2]: name for name in data}
    lines: dict[str, dict[int, int | None]] = {}
    for name, m in members.items():
        if _INDEX.fullmatch(name):
            for file, at, n in parse_index(_content(read, name, m)):
                owner = by_file.get((file or "").rpartition("/")[2], next(iter(data)) if len(data) == 1 else None)
                if owner is None:
                    raise ValueError(f"{name} names {file}, which is no WARC member")
                lines.setdefault(owner, {})[at] = n
    out = []
    for name, start in data.items():
        end = members[name]["packed"]
        spans = sorted(lines[name].items()) if name in lines else _walk(lambda at, n, start=start: read(start + at, n), end)
        for k, (at, n) in enumerate(spans):
            n = n if n is not None else (spans[k + 1][0] if k + 1 < len(spans) else end) - at
            if at + n > end:
                raise ValueError(f"an index line of {name} points past its end")
            out.append((name, start + at, n))
    return out


def _content(read, name: str, member: dict) -> bytes:
    """An index member whole, inflated where it is packed; records never go this way."""
    at = data_start(read, member, stored=False)
    raw = read(at, member["packed"])
    raw = zlib.decompress(raw, -15) if member["method"] == 8 else raw
    return gzip.decompress(raw) if name.endswith(".gz") else raw


def _walk(read, size: int) -> list[tuple[int, int]]:
    """Places and lengths of a WARC member's records, gzip members or plain, met one after the other."""
    out, at = [], 0
    while at < size:
        if read(at, 2) == b"\x1f\x8b":
            packer, n = zlib.decompressobj(31), 0
            while not packer.eof:
                raw = read(at + n, min(RANGE, size - at - n))
                if not raw:
                    raise ValueError("a record is cut short")
                packer.decompress(raw)
                n += len(raw) - len(packer.unused_data)
        else:
            head = read(at, min(1 << 16, size - at))
            begin = head.index(b"\r\n\r\n") + 4
            n = begin + int(_headers(head[:begin])["content-length"]) + 4
        out.append((at, n))
        at += n
    return out


def read_archives(manifest: DataFrame, want_payload: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` names by ``uri``, each from its range in a stored WARC member.

    Responses and revisits are returned; other kinds of record are passed over. Ids are those of records written here,
    else null. An empty manifest gives no rows.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = _file(uri)
                with fs.open_input_file(path) as f:
                    spans = record_spans(lambda at, n, f=f: f.read_at(n, at), f.size())
                some: list[tuple[str, int, int]] = []
                for k, span in enumerate(spans):
                    some.append(span)
                    following = spans[k + 1] if k + 1 < len(spans) else (None, 0, 0)
                    if span[1] + span[2] - some[0][1] >= RANGE or following[:2] != (span[0], span[1] + span[2]):
                        yield pa.RecordBatch.from_pydict({
                            "uri": [uri], "at": [some[0][1]], "n": [span[1] + span[2] - some[0][1]],
                            "lengths": pa.array([[x[2] for x in some]], pa.list_(pa.int64())),
                        })
                        some = []

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _file(r["uri"])
                with fs.open_input_file(path) as f:
                    data = f.read_at(r["n"], r["at"])
                got, at = [], 0
                for n in r["lengths"]:
                    one = parse_record(data[at : at + n])
                    got += [one] if one["record_type"] in ("response", "revisit") else []
                    at += n
                cols = {c: pa.array([x[c] for x in got], t) for c, t in kinds.items()}
                yield pa.RecordBatch.from_pydict(cols)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if want_payload:
        kinds["payload"], schema = pa.binary(), schema + ", payload binary"
    found = manifest.select("uri").repartition("uri").mapInArrow(ranges, "uri string, at long, n long, lengths array<long>")
    return found.repartition("uri", "at").mapInArrow(records, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and read their records back."""
    return read_archives(write_archives(pages, scratch_path(spark, "archives")))
