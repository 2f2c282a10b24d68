"""Each corpus operator against brute force on a table of edge cases, and on empty tables."""

import base64
import hashlib
import io
import json
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, mil_classifier, mixing, near_dedup, queries, rolling, suffix_dedup, suffix_tree_lm, wacz
from graphloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from graphloom.llm.mil_classifier import fold
from graphloom.llm.mixing import mix, mixed_documents, schedule
from graphloom.llm.near_dedup import drop_near_copies, near_duplicates
from graphloom.llm.quality_rules import apply_quality_rules, quality_rules
from graphloom.llm.sharding import lpt_plan, shard_documents
from graphloom.llm.suffix_dedup import remove_repeats

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (".\n" if r.random() < 0.1 else "") for _ in range(n))


LONG = prose(9000, 1)
BASE = prose(120, 2)
NEAR = BASE.split(" ")
NEAR[50] = "changed"
PASSAGE = prose(60, 3)
#: Extra columns have names that operators use within; ids and sources may be null, rows repeat.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _hash string, size string, id string, row string"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE.replace(" ", "  "), "en", "b"), (3, " ".join(NEAR), "en", "a"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n", "en", None),
    (7, "two words", "en", "a"), (7, "two words", "en", "a"), (8, LONG, "en", "b"), (9, PASSAGE + " " + prose(80, 4), "en", "c"), (10, prose(70, 5) + " " + PASSAGE, "en", "c"),
    (None, prose(90, 6), "en", "a"), (None, prose(90, 7), "en", "a"), (11, "x " * 400, "en", "b"), (12, "UPPER " + BASE.upper(), "en", "c"), (13, "日本語のテキスト" * 60, "ja", "d"), (14, "#$% && <> ** ||\n" * 30, "en", "a"),
    (15, BASE, "en", "a"), (16, "é" * 300 + " x", "fr", "d"), (17, prose(200, 8), "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), "k", "h", "s", "i", "r") for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_empty_tables(spark, none):
    voc, pat = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = mil_classifier.fit_sample(none, labels, F.lit(True))
    for df in (
        quality_rules(none), apply_quality_rules(none), bpe.encode_documents(none, voc, pat), wacz.archive_round_trip(spark, pages), exact_dedup(none), drop_exact_copies(none),
        mil_classifier.classify(none, model), suffix_tree_lm.lm_scores(none, fold(F.col("doc_id"), 7) == 2), mix(none), mixed_documents(none), shard_documents(none), remove_repeats(none), near_duplicates(none), drop_near_copies(none),
    ):
        assert df.count() == 0


def test_quality_rules(docs):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = Counter((r.doc_id, *(r[c] for c in cols)) for r in quality_rules(docs).collect())
    want = Counter()
    for i, text, *_ in ROWS:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {k for k, n in Counter(win).items() if n > 1}
        hit = len({j for k, x in enumerate(win) if x in twice for j in range(k, k + 8)})
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), hit, len(w) < 20 or 100 * hit > 30 * len(w)] += 1
    assert got == want


def test_quality_removes_frequent_lines(spark):
    """A line of 30 unlike documents goes, also where its digest is the smallest; a document of little else is rejected.

    30 exact copies are one document and keep their lines; 30 texts that differ in one line are 30 documents.
    """
    shared = next(x for x in (f"shared boilerplate line number {k}" for k in range(10**6)) if hashlib.md5(x.encode()).hexdigest() < "0001")
    own = [(i, f"{prose(60, 100 + i)}\n{shared.replace(' ', '   ').upper()}\n{prose(30, 200 + i)}", "en", "h", 1) for i in range(30)]
    poor = [(50, f"{shared.title()}\nshort tail", "en", "h", 1), (51, f"{shared}\n{' '.join(['w'] * 9)}\n{shared}\n{shared}\n{shared}", "en", "h", 1)]
    lines = [prose(12, 300 + i).replace("\n", "") for i in range(12)]
    copies = [(100 + i, "\n".join(lines), "en", "h", 1) for i in range(30)]
    near = [(200 + i, "\n".join([prose(8, 500).replace("\n", ""), prose(40, 600 + i).replace("\n", "")]), "en", "g", 1) for i in range(30)]
    d = spark.createDataFrame(own + poor + copies + near, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in apply_quality_rules(d).collect()}
    assert set(out) == {r[0] for r in own + copies + near}
    assert all(shared not in squeezed(out[r[0]].text).lower() and out[r[0]].text.count("\n") == r[1].count("\n") - 1 for r in own)
    assert all(out[r[0]].n_chars == len(out[r[0]].text) for r in own) and all(out[r[0]].text == r[1] for r in copies)
    assert all(out[r[0]].text == r[1].split("\n")[1] for r in near)


@pytest.mark.parametrize("percent", [1, 20])
def test_quality_verdicts_against_brute_force(spark, percent):
    """Distinct texts of each host and line, counted one by one, with hosts of few and many copies."""
    r = random.Random(12)
    pool = [prose(6, 700 + k).replace("\n", "") for k in range(8)]
    texts = ["\n".join([r.choice(pool), prose(r.randint(4, 40), 800 + k).replace("\n", " "), r.choice(pool)]) for k in range(60)]
    rows = [(i, r.choice(texts), r.choice(["a", "b", None])) for i in range(300)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=5, max_percent=percent).collect()
    norm = lambda t: [x for x in (squeezed(y).strip().lower() for y in t.split("\n")) if x]
    held: dict = {}
    for _, t, s in rows:
        for x in norm(t):
            held.setdefault((s, x), set()).add(t)
    total = {s: len({t for _, t, z in rows if z == s}) for s in ("a", "b", None)}
    hot = {k for k, v in held.items() if len(v) > 5 and 100 * len(v) > percent * total[k[0]]}
    cut = {i: sum(len(x.split(" ")) for x in norm(t) if (s, x) in hot) for i, t, s in rows}
    assert hot and {x.doc_id: x.removed_words for x in got} == cut
    assert all(x.kept == (not x.base_failed and x.n_words - cut[x.doc_id] >= 10 and 100 * (x.n_words - cut[x.doc_id]) >= 30 * x.n_words) for x in got)


def test_bpe(docs):
    voc, pat = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    codec = bpe._codec(voc, pat)
    want = Counter((i, *bpe.digests(codec[0].encode_ordinary(t or ""), codec)) for i, t, *_ in ROWS)
    for chunk, overlap, spread in ((4_096, 256, 32_768), (100, 20, 100), (40, 5, 40), (40, 5, 32_768), (100, 20, 5_000)):
        assert Counter(map(tuple, bpe.encode_documents(docs, voc, pat, chunk=chunk, overlap=overlap, spread=spread).collect())) == want
    back = bpe.decode_documents(bpe.encode_documents(docs, voc, pat, want_ids=True), voc, pat)
    assert Counter(bytes(r.bytes) for r in back.collect()) == Counter((t or "").encode() for _, t, *_ in ROWS)


def test_bpe_stitching_random():
    codec = bpe._codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice(["a", "b", " ", "  ", "\n", "'s", "é", "日", "1", "!", "'", "\t", "abc "]) for _ in range(r.randint(0, 200)))
        parts = bpe.cut(t, 20, 8)
        got = bpe.stitch([bpe.encode_chunk(b, x, k == len(parts) - 1, codec, 8) for k, (b, x) in enumerate(parts)], codec, 8)
        assert got == codec[0].encode_ordinary(t) == bpe.encode_text(t, codec, 20, 8)
        assert bpe.decoded(got, codec) == t.encode()


@pytest.mark.parametrize("broadcast", [True, False])
def test_wacz(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(wacz, "few", lambda df: False)
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/ü\r\nX: y", "other"), (4, "http://d", None), (5, "", ""), (None, "http://e", "same"), (2, "http://f", "same"), (None, "http://g", "lone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in wacz.archive_round_trip(spark, pages).collect())
    keep = {"same": 2, "other": 3, "": 5, "lone": None}
    want = Counter()
    for i, _, h in rows:
        raw, k = (h or "").encode(), keep[h or ""]
        lone = k is None or k == i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if lone else "revisit", None if lone else k] += 1
    assert got == want


def foreign_package(index: str, plain: bool) -> tuple[bytes, list[int]]:
    """A package of other names: two WARC members with other kinds of record, and an index of the given kind or none."""
    raw, members = io.BytesIO(), {"archive/crawl-7.warc" + "" * plain: b"", "archive/sub/b.warc.gz": b""}
    pack = lambda x: zlib.decompress(x, 31) if plain else x
    lines, ids = [], []
    for k, name in enumerate(members):
        plain_here = plain and k == 0
        for i in range(5):
            digest = base64.b32encode(hashlib.sha1(b"page%d" % i).digest()).decode()
            one = wacz.record("response", 10 * k + i, f"http://h{k}.example.org/{i}?q", b"page%d" % i, 5, digest, None, "2024-01-02T03:04:05Z")
            info = wacz.record("warcinfo", None, None, b"about", 5, digest, None, "2024-01-02T03:04:05Z")
            one, info = (pack(one), pack(info)) if plain_here else (one if k else one, info)
            members[name] += info
            at = len(members[name])
            members[name] += one
            ids.append(10 * k + i)
            fields = {"offset": str(at), "length": str(len(one)), "filename": name.rpartition("/")[2]}
            lines.append(f"org,example,h{k})/{i} 20240102030405 {json.dumps(fields)}" if index == "cdxj" else f"org,example,h{k})/{i} 20240102030405 {len(one)} {at} {name}")
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/pages.jsonl", "{}")
        for name, data in members.items():
            z.writestr(name, data)
        body = "\n".join(([" CDX N b S V g"] if index == "cdx" else []) + sorted(lines, reverse=True))
        if index == "cdxj":
            z.writestr(zipfile.ZipInfo("indexes/all.cdxj"), body, compress_type=zipfile.ZIP_DEFLATED)
        elif index == "cdx":
            import gzip

            z.writestr("indexes/old.cdx.gz", gzip.compress(body.encode()))
    return raw.getvalue(), ids


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("index", ["cdxj", "cdx", ""])
def test_wacz_reads_packages_of_others(spark, tmp_path, index, plain):
    data, ids = foreign_package(index, plain)
    (tmp_path / "p.wacz").write_bytes(data)
    out = wacz.read_archives(spark.createDataFrame([(f"file://{tmp_path}/p.wacz",)], "uri string"), want_payload=True).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in out) == [(i, b"page%d" % (i % 10)) for i in sorted(ids)]


def test_wacz_writes_sorted_cdxj(spark, tmp_path):
    """A package by the standard library's reader: the index lines, sorted, give each record; many equal payloads in shuffles too."""
    rows = [(i, f"http://{'ba'[i % 2]}.org/{i}", "x" * (i % 3)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    manifest = wacz.write_archives(pages, f"file://{tmp_path}/out").collect()
    z = zipfile.ZipFile(manifest[0].uri.removeprefix("file:").replace("//", "/"))
    data, lines = z.read(wacz.DATA), z.read(wacz.INDEX).decode().splitlines()
    assert lines == sorted(lines) and len(lines) == 40 and lines[0].startswith("org,a)/")
    for x in lines:
        f = json.loads(x[x.index("{") :])
        one = wacz.parse_record(data[int(f["offset"]) :][: int(f["length"])])
        assert one["url"] == f["url"] and f["digest"] == "sha1:" + one["payload_digest"] and f["filename"] == "data.warc.gz"


def test_zip_directories():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"é{i}", b"")
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"payload")
        z.comment = b"a comment"
    data = raw.getvalue()
    read = lambda at, n: data[at : at + n]
    members = wacz.read_directory(read, len(data))
    at = wacz.data_start(read, members["big"])
    assert len(members) == 66_001 and "é3" in members and read(at, 7) == b"payload"
    for bad in (b"", data[:-30], b"x" * 500):
        with pytest.raises(ValueError, match=r"no |broken"):
            wacz.read_directory(lambda at, n: bad[at : at + n], len(bad))
    with pytest.raises(ValueError, match="payload"):
        wacz.parse_record(wacz.record("response", 1, "u", b"abc", 3, "WRONG", None, "d"))


@pytest.mark.parametrize("share", [1000, 3])
def test_exact_dedup(docs, share):
    got = exact_dedup(docs, share=share).collect()
    groups: dict = {}
    for i, t, *_ in ROWS:
        groups.setdefault(squeezed(t), []).append(i)
    want = Counter()
    for i, t, *_ in ROWS:
        g = groups[squeezed(t)]
        k = min((x for x in g if x is not None), default=None)
        want[i, k, len(g), i == k, hashlib.sha256(squeezed(t).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def brute_mix(rows, block, all_blocks=False):
    """(id, size, target, taken) of rows (id, text, source); ``all_blocks`` takes every block up to the target instead of the schedule's."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total, weights = sum(sizes.values()) * 1.5, dict(zip(names, [3, 1, 2] * len(names)))
    target, open_ = {}, set(sizes)
    while open_:
        left, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / w for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    need = {s: math.floor(target[s] + 0.5) for s in names}
    ends = [sum(need[x] for x in names[: k + 1]) / sum(need.values()) for k in range(len(names))]
    got = Counter()
    for k in range(1, -(-sum(need.values()) // block) + 1):
        u = k * (math.sqrt(5) - 1) / 2 % 1
        got[next(s for s, e in zip(names, ends) if u < e)] += 1
    if all_blocks:
        got = {s: -(-need[s] // block) for s in names}
    out = []
    for s in names:
        at, own = 0, []
        for i, t in sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest(), r[0] is not None, len(WORD.findall(r[1] or "")))):
            own.append((i, at, n := len(WORD.findall(t or ""))))
            at += n
        stop = got[s] * block
        out += [(i, n, round(target[s], 6), sum(max(0, min(a + n + lap * at, stop) - a - lap * at) for lap in (0, 1))) for i, a, n in own]
    return out


def test_mixing(docs):
    got = mix(docs, block=16).collect()
    rows = [(i, t, s) for i, t, _, s in ROWS]
    plain = Counter((r.doc_id, r["size"], round(r.target, 6), r.taken) for r in got)
    assert {k: v for k, v in plain.items() if k[0]} == {k: v for k, v in Counter(brute_mix(rows, 16)).items() if k[0]}
    assert plain != Counter(brute_mix(rows, 16, all_blocks=True))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = mix(docs.repartition(5), block=16).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    assert mixed_documents(docs).columns == docs.columns


def test_mix_is_decided_by_the_schedule(spark, monkeypatch):
    """Words taken are those of the golden-ratio slots, near the targets; every slot is one whole block, in order."""
    rows = [(i, prose(20 + i * 7 % 90, 40 + i), f"s{i % 7}" if i % 3 else "s0") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r["size"], round(r.target, 6), r.taken) for r in mix(d, block=32).collect()]
    assert Counter(got) == Counter(brute_mix(rows, 32)) != Counter(brute_mix(rows, 32, all_blocks=True))
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for i, _, t, n in got:
        taken[source[i]] += n
        target[source[i]] = t
    assert all(abs(taken[s] - target[s]) <= 4 * 32 for s in target)
    seq = mixing.mixed_sequence(d, block=32).collect()
    assert sum(r.n for r in seq) == sum(taken.values()) and len(set(range(max(r.slot for r in seq) + 1)) - {r.slot for r in seq}) <= 2
    assert all(len({source[r.id] for r in g}) == 1 and sum(r.n for r in g) == 32 for g in ([r for r in seq if r.slot == k] for k in range(0, 40)))
    monkeypatch.setattr(mixing, "_golden", lambda t: F.pmod(t * F.lit(0.0) + F.lit(0.001), F.lit(1.0)))
    assert {r.doc_id for r in mix(d, block=32).collect() if r.taken} == {i for i, s in source.items() if s == "s0"}


def test_mixed_documents_stand_in_mixing_order(spark):
    rows = [(i, prose(30, 40 + i), f"s{i % 4}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = {r.doc_id: list(r.slots) for r in mix(d).collect()}
    times = {r.doc_id: math.floor(r.taken / r["size"] + 0.5) for r in mix(d).collect()}
    out = [r.doc_id for r in mixed_documents(d).collect()]
    assert Counter(out) == Counter({i: n for i, n in times.items() if n})
    left, placed = {i: list(v) for i, v in slots.items()}, []
    for i in out:
        placed.append(left[i].pop(0))
    assert placed == sorted(placed)


def test_schedule_is_even(spark):
    s = spark.createDataFrame([("a", 9000), ("b", 1000), ("c", 0)], "s string, words long")
    rows = sorted((r.slot, r.s, r.block) for r in schedule(s, 10).collect())
    got = Counter(x for _, x, _ in rows)
    assert [t for t, _, _ in rows] == list(range(1000)) and abs(got["b"] - 100) <= 3 and sorted(b for _, x, b in rows if x == "b") == list(range(got["b"]))
    place = [i for i, (_, x, _) in enumerate(rows) if x == "b"]
    assert max(b - a for a, b in zip(place, place[1:])) < 30


def test_sharding(docs):
    got = shard_documents(docs, shards=4).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t or "" for i, t, *_ in ROWS if i == r.doc_id and len((t or "").encode()) + 16 == r["size"])
        assert r.text_crc32 == zlib.crc32(text.encode())
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert len({r.shard for r in got if r.doc_id in (1, 15)}) == 1 and len({r.shard for r in got if r.doc_id == 7}) == 1


def test_lpt_batches_equal_single_pops():
    import heapq

    r = random.Random(4)
    for _ in range(50):
        classes = [(s, r.choice([1, 3, 100])) for s in r.sample(range(1, 60), 6)]
        heap = [(0, s) for s in range(5)]
        want = {}
        for size, n in sorted(classes, reverse=True):
            got = Counter()
            for _ in range(n):
                load, s = heapq.heappop(heap)
                got[s] += 1
                heapq.heappush(heap, (load + size, s))
            want[size] = got
        plan = {z: Counter({s: e - b for s, b, e in zip(shards, [0, *upto], upto)}) for z, shards, upto in lpt_plan(classes, 5)}
        assert plan == want


def test_sharding_against_single_pops(spark):
    """The query's placement: groups of equal texts by true size, each to the least-loaded shard, whatever their length."""
    import heapq

    r = random.Random(31)
    texts = [prose(r.choice([1, 2, 3, 3, 40, 200, 2500]), 60 + k) for k in range(150)] + ["x" * 9001, "y" * 9002, "z" * 9003]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(r.choice([1, 1, 1, 2, 30])))]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    bytes_of = Counter()
    for _, t in rows:
        bytes_of[t] += len(t.encode()) + 16
    heap = [(0, s) for s in range(7)]
    want = Counter()
    for n in sorted(bytes_of.values(), reverse=True):
        load, s = heapq.heappop(heap)
        want[n, s] += 1
        heapq.heappush(heap, (load + n, s))
    text_of = dict(rows)
    placed = {text_of[x.doc_id]: x.shard for x in got}
    assert all(placed[text_of[x.doc_id]] == x.shard for x in got) and Counter((bytes_of[t], s) for t, s in placed.items()) == want
    loads = Counter()
    for x in got:
        loads[x.shard] += x["size"]
    assert sorted((loads[s], s) for s in range(7)) == sorted(heap)


def test_suffix_sort_random():
    r = np.random.default_rng(1)
    for _ in range(30):
        data = r.integers(97, 99, 300).astype("uint8")
        s = suffix_dedup._Suffixes(data, 20)
        at, group = np.sort(r.choice(280, 100, replace=False)), np.sort(r.integers(0, 5, 100))
        order = s.sort(at, group)
        keys = [(group[i], data[at[i] : at[i] + 20].tobytes()) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(100))
        same = s.equal_neighbours(order, at, group)
        assert list(same[1:]) == [a == b for a, b in zip(keys, keys[1:])]


def brute_repeats(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    want = Counter()
    for (i, _), b in zip(rows, raw):
        m = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                m[p : p + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, m) if not y)
        want[i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()] += 1
    return want


@pytest.mark.parametrize(("size", "gram", "block"), [(200, 32, 3000), (40, 8, 2), (40, 8, 1)])
def test_remove_repeats(docs, monkeypatch, size, gram, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    want = brute_repeats([(i, t) for i, t, *_ in ROWS], size)
    assert Counter(map(tuple, remove_repeats(docs, size=size, gram=gram).collect())) == want


@pytest.mark.parametrize("block", [6, 40])
def test_remove_repeats_in_large_groups(spark, monkeypatch, block):
    """Near copies that differ in a letter, and a passage of many surroundings: anchors and cores of more than a block."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r, base, passage = random.Random(8), prose(60, 21), prose(14, 22)
    rows = [(i, base[:k] + r.choice("xyz") + base[k + 1 :]) for i, k in enumerate(r.randrange(len(base)) for _ in range(50))]
    rows += [(100 + i, prose(6, 900 + i) + passage + prose(6, 950 + i)) for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, remove_repeats(d, size=48, gram=8).collect())) == brute_repeats(rows, 48)


def shingles(t, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(rows))], sets


@pytest.mark.parametrize(("limit", "block"), [(32, 512), (2, 2)])
def test_near_duplicates(spark, docs, monkeypatch, limit, block):
    monkeypatch.setattr(near_dedup, "LIST", limit)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [(i, t) for i, t, *_ in ROWS]
    comp, sets = brute_components(rows, 4)
    want = Counter((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, comp))
    assert Counter(tuple(r)[:4] for r in near_duplicates(docs, words=4).collect()) == want
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns


def test_near_duplicates_large_groups(spark, monkeypatch):
    """Groups around base texts, chained and spread, larger than a list may be."""
    monkeypatch.setattr(near_dedup, "LIST", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r, rows = random.Random(9), []
    for g in range(3):
        words = prose(100, 900 + g).split(" ")
        for i in range(60):
            w = list(words)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), PASSAGE.lower() + " " + " ".join(w) if g == 2 else " ".join(w)))
    rows += [(len(rows) + k, PASSAGE + " " + prose(r.randint(3, 90), 5000 + k)) for k in range(40)]
    comp, _ = brute_components(rows, 4)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).orderBy("doc_id").collect()
    assert [x.component_id for x in got] == comp


def test_drop_near_copies_leaves_one_row_of_each_component(spark):
    """Rows repeated with id and text, components of null ids only, and blank texts, with columns that clash."""
    b = prose(80, 71)
    rows = [(1, b, "p"), (1, b, "q"), (2, b + " tail", "r"), (None, prose(60, 72), "a"), (None, prose(60, 72) + " more", "b"), (None, b, "c"), (5, "", "x"), (5, "", "y"), (6, None, "z"), (7, prose(50, 73), "u"), (7, prose(50, 74), "v")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _label string").repartition(3)
    out = drop_near_copies(d)
    assert out.columns == d.columns
    got = Counter((r.doc_id, squeezed(r.text)[:20]) for r in out.collect())
    assert got == Counter((i, squeezed(t)[:20]) for i, t, _ in (rows[0], rows[3], *rows[6:]))


def test_near_duplicate_recall_in_hard_groups(spark):
    """Links kept among documents of frequent passages and large groups, of those that brute force finds: at least 0.99."""
    r, rows = random.Random(77), []
    common = [" ".join(f"c{g}w{k}" for k in range(45)) for g in range(3)]
    for g in range(90):
        size, passage = r.choice([8, 20, 40]), f"{common[g % 3]} " * (r.random() < 0.8)
        for _ in range(4):
            own = [f"d{g}x{k}" for k in range(size)]
            own[r.randrange(size)] = f"e{len(rows)}"
            rows.append((len(rows), passage + " ".join(own)))
    sets = [shingles(t, 4) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert len(links) > 300 and sum(got[i] == got[j] for i, j in links) / len(links) > 0.99


def test_near_duplicates_around_a_frequent_passage(spark):
    """Pairs at 0.8125 that share a passage of 200 other pairs: 40 frequent shingles, and 24 and 12 of their own."""
    passage, rows = " ".join(f"common{k}" for k in range(43)), []
    for i in range(200):
        own = [f"own{i}x{k}" for k in range(24)]
        rows += [(2 * i, f"{passage} {' '.join(own)}"), (2 * i + 1, f"{passage} {' '.join(own[:12])}")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i, _ in rows}


def test_shingle_hashes_tell_apart():
    texts = [b"", b" ", b"a", b"a b", b"a b c", b"a b c d", b"b a c d", b"A B c D", b"ab c d", "é b c d".encode()]
    sets = [tuple(s) for s in rolling.shingle_sets(texts, 4)]
    assert sets[0] == sets[1] == () and sets[5] == sets[7] and len(set(sets)) == 8
    assert rolling.INVERSE * rolling.BASE % 2**64 == 1


def test_classifier_held_out(spark):
    out = queries.op5_mil(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.85
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_classifier_scores_long_texts_in_pieces(monkeypatch):
    m, texts = mil_classifier.Attention(), [LONG.encode(), b"", b"ab", PASSAGE.encode(), LONG.encode()[:1024]]
    whole = m.forward(*mil_classifier.passages(texts))["y"]
    monkeypatch.setattr(mil_classifier, "PIECE", 2 * mil_classifier.PASSAGE)
    assert np.allclose(m.scores(texts), whole, atol=1e-5) and len(m.scores([])) == 0


def test_classifier_sample_skips_what_does_not_fit(spark, monkeypatch):
    """A text over the bound that comes first leaves out itself only; if nothing fits, that is an error."""
    ids = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    texts = {i: f"text {i}" if n else "long " * 2000 for n, i in enumerate(ids)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil_classifier.Attention, "fit", lambda self, t, y: seen.extend(t) or self)
    monkeypatch.setattr(mil_classifier, "SAMPLE_BYTES", 5000)
    mil_classifier.fit_sample(d, labels, F.lit(True))
    assert sorted(seen) == sorted(t.encode() for i, t in texts.items() if i != ids[0])
    monkeypatch.setattr(mil_classifier, "SAMPLE_BYTES", 1)
    with pytest.raises(ValueError, match="labelled"):
        mil_classifier.fit_sample(d, labels, F.lit(True))


def test_classifier_gradients_and_edges(spark, docs):
    m = mil_classifier.Attention()
    x, counts = mil_classifier.passages([LONG.encode()[:3000], b"", b"ab"])
    y, w = np.array([1, 0, 1]), np.ones(3)
    loss = lambda: float(-(y * np.log(f := m.forward(x.astype("float64"), counts)["y"]) + (1 - y) * np.log(1 - f)).mean())
    for k in m.p:
        m.p[k] = m.p[k].astype("float64")
    grads = m.gradients(x.astype("float64"), counts, y, w)
    for k, at in (("W", (5, 3)), ("V", (2, 1)), ("U", (4, 2)), ("w", (1, 0)), ("c", (3, 0)), ("d", (0,))):
        was = m.p[k][at]
        m.p[k][at] = was + 1e-5
        up = loss()
        m.p[k][at] = was - 1e-5
        down = loss()
        m.p[k][at] = was
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-4
    rows = mil_classifier.classify(docs, mil_classifier.Attention()).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)


def test_language_model(spark, docs):
    held = fold(F.col("doc_id"), 7) == 2
    got = suffix_tree_lm.lm_scores(docs, held).collect()
    is_held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = [(i, [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]) for i, t, *_ in ROWS]
    c = Counter(x for i, t in toks if not is_held(i) for x in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for i, t in toks)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


class BruteTree:
    """The model by its definition: nested dictionaries of counts, contexts tested from short to long."""

    def __init__(self, texts, support, depth, divergence):
        toks = [[*WORD.findall(t.lower()), None] for t in texts]
        self.uni = Counter(x for t in toks for x in t)
        self.norm = sum(self.uni.values()) + len(self.uni) + 1
        self.kept, self.scale = {}, {}
        candidates = {(w,): n for w, n in self.uni.items() if n >= support and w is not None}
        for d in range(1, depth + 1):
            after = {}
            for t in toks:
                for i in range(d, len(t)):
                    if (c := tuple(t[i - d : i])) in candidates:
                        after.setdefault(c, Counter())[t[i]] += 1
            longer = {}
            for c, nexts in after.items():
                often = {x: n for x, n in nexts.items() if n >= support}
                if not often:
                    continue
                p = {x: n / (candidates[c] + 1) for x, n in often.items()}
                q = {x: self.probability(c[1:], x) for x in often}
                rest_p, rest_q = 1 - sum(p.values()), 1 - sum(q.values())
                kl = sum(p[x] * math.log(p[x] / q[x]) for x in p) + rest_p * math.log(rest_p / rest_q)
                if kl >= divergence:
                    self.kept[c], self.scale[c] = p, rest_p / rest_q
                longer |= {(*c, x): n for x, n in often.items() if x is not None}
            candidates = {c: n for c, n in longer.items() if c[1:] in self.kept}

    def probability(self, c, x):
        while c and c not in self.kept:
            c = c[1:]
        if not c:
            return (self.uni[x] + 1) / self.norm
        return self.kept[c].get(x) or self.scale[c] * self.probability(c[1:], x)


@pytest.mark.parametrize(("often", "hot", "held"), [(1e-6, 1e-4, 2_000_000), (2e-2, 1e-2, 500), (10, 10, 500)])
def test_suffix_tree_against_brute_force(spark, monkeypatch, often, hot, held):
    """Scores of the distributed model against a tree walked token by token, whether weights are broadcast or shuffled."""
    for k, v in {"OFTEN": often, "OFTEN_GRAMS": often, "HOT": hot, "HELD": held}.items():
        monkeypatch.setattr(suffix_tree_lm, k, v)
    r = random.Random(6)
    words = WORDS[:40]
    follow = {(a, b): r.sample(words, 2) for a in words[:8] for b in words[:8]} | {w: r.sample(words[:10], 3) for w in words}
    texts = []
    for k in range(250):
        w = [r.choice(words)]
        for _ in range(60):
            w.append(r.choice(follow.get((w[-2], w[-1]) if len(w) > 1 else 0, follow[w[-1]])) if r.random() < 0.8 else r.choice(words))
        texts.append((k, " ".join(w)))
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    tree = BruteTree([t for _, t in texts[:200]], suffix_tree_lm.SUPPORT, suffix_tree_lm.DEPTH, suffix_tree_lm.DIVERGENCE)
    lengths = Counter(map(len, tree.kept))
    assert lengths[1] > 5 and lengths[2] > 5 and lengths[3] > 0
    assert all(abs(sum(tree.probability(c, x) for x in tree.uni) + 1 / tree.norm - 1) < 1e-2 for c in list(tree.kept)[:30])
    model = suffix_tree_lm.train(d.filter("doc_id < 200"))
    assert [x.count() for x in model.contexts] == [lengths[k] for k in (1, 2, 3)]
    got = {x.doc_id: x for x in suffix_tree_lm.score(d, model).collect()}
    for k, t in texts:
        toks = [*WORD.findall(t.lower()), None]
        want = sum(math.log10(tree.probability(tuple(toks[max(0, i - 3) : i]), x)) for i, x in enumerate(toks))
        assert abs(got[k].score - want) < 1e-6 * abs(want)
    held_out = [got[k] for k in range(200, 250)]
    assert sum(x.score for x in held_out) > 0.85 * sum(x.base_score for x in held_out)


@pytest.mark.parametrize("n", [0, 1, 7, 10_000])
def test_packed_lists_keep_every_bit(n):
    """Packed numbers come back whole, and sorted keys of a part, counts and owners take fewer bytes than as they are."""
    r = np.random.default_rng(n)
    for most in (1, 2, 255, 256, 70_000, 1 << 63):
        x = r.integers(0, most, n, dtype="uint64", endpoint=True)
        assert (suffix_tree_lm.unpacked(suffix_tree_lm.packed(x)) == x).all()
        assert (suffix_tree_lm.unpacked_sorted(suffix_tree_lm.packed_sorted(np.sort(x))) == np.sort(x)).all()
    keys = np.sort(r.integers(0, 1 << 64, n * 50, dtype="uint64"))
    part = suffix_tree_lm.part_of(keys, 50)
    assert (np.diff(part) >= 0).all() and (not n or (part.min(), part.max()) >= (0, 0) and part.max() < 50)
    if n == 10_000:
        assert len(suffix_tree_lm.packed_sorted(keys[part == 7])) < 6 * (part == 7).sum()
        assert len(suffix_tree_lm.packed(r.integers(0, 2000, n))) < 1.5 * n and len(suffix_tree_lm.packed(np.ones(n, "int64"))) < 100


def test_tokens_are_hashed_in_buffers_of_remembered_powers(monkeypatch):
    """Texts of 3 MB need no powers beyond those that are remembered, and have the tokens of each text alone."""
    texts = [b"", *(b"w%d x " % k * 70_000 for k in range(6)), b" last"]
    alone = [suffix_tree_lm.tokens([t])[0] for t in texts]
    asked, powers = [], rolling.powers
    monkeypatch.setattr(rolling, "powers", lambda n: asked.append(n) or powers(n))
    toks, ends = suffix_tree_lm.tokens(texts)
    assert sum(map(len, texts)) > 2 << 20 and max(asked) <= rolling.BUFFER + 1
    assert (toks == np.concatenate(alone)).all() and list(ends) == list(np.cumsum([len(t) for t in alone]))


@pytest.mark.parametrize("n", [0, 1, 5, 20_000])
def test_look_ups_find_what_is_there(n):
    most = (1 << 64) - 1
    keys = np.unique(np.random.default_rng(n).integers(0, most, n, dtype="uint64", endpoint=True))
    x = np.concatenate((keys, keys + np.uint64(1), np.array([0, 1, most], "uint64")))
    for own in (keys, np.union1d(keys, np.array([0, most], "uint64")), keys >> np.uint64(20)):
        at, hit = suffix_tree_lm.Lookup(np.unique(own)).find(x)
        assert (hit == np.isin(x, own)).all() and (np.unique(own)[at[hit]] == x[hit]).all()


def test_suffix_tree_shuffles_no_hopeless_or_repeated_keys(spark, monkeypatch):
    """An n-gram goes to be counted only if its suffix is frequent; tokens go in packed lists, and each question once."""
    sent, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "repartition", lambda self, *a, was=kind.repartition: sent.append(self) or was(self, *a))
    often = [f"c{k}" for k in range(10)]
    texts = [f"p q {often[k % 10]}" for k in range(20)] + ["x q z"] * 20 + [" ".join(often)] * 10
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = suffix_tree_lm.train(d)
    counted = [f for f in sent if "ctx" in f.columns]
    p_q, x_q = (suffix_tree_lm.gram(suffix_tree_lm.tokens([t])[0], np.array([1]), 2)[0] for t in (b"p q", b"x q"))
    contexts = [{int(c) for r in f.collect() for c in suffix_tree_lm.unpacked_sorted(bytes(r.ctx))} for f in counted]
    assert int(x_q) in contexts[1] and int(p_q) not in contexts[1]  # z follows q 20 times, each c twice
    [tokens] = [f for f in sent if "tokens" in f.columns]
    assert sum(int(suffix_tree_lm.unpacked(bytes(r.n)).sum()) for r in tokens.collect()) == model.total
    copies = spark.createDataFrame([(k, "p q z new") for k in range(30)], "doc_id long, text string").coalesce(1)
    got = suffix_tree_lm.score(copies, model).collect()
    assert len(got) == 30 and {(r.n_tokens, r.n_known) for r in got} == {(5, 4)} and len({r.score for r in got}) == 1
    [asked] = [f for f in sent if "runs" in f.columns and "kind" in f.columns]
    new = [r for r in asked.filter(F.col("kind") == suffix_tree_lm._OF_TOKENS).collect()]
    assert sum(len(suffix_tree_lm.unpacked_sorted(bytes(r["keys"]))) for r in new) == 1
    assert sum(int(suffix_tree_lm.unpacked(bytes(r.runs)).sum()) for r in new) == 29


def test_filters_know_all_their_keys(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 5000)
    f = suffix_tree_lm.key_filter(spark.createDataFrame([(int(k),) for k in keys[:2500]], "k long"), "k")
    assert f.has(keys[:2500].view("uint64")).all() and f.has(keys[2500:].view("uint64")).mean() < 0.05


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "tokens"]
    out = corpus_pipeline.run(spark, SF).collect()
    cleaned = apply_quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    first: dict = {}
    for r in sorted(cleaned, key=lambda r: r.doc_id):
        first.setdefault(squeezed(r.text), r)
    rows = [(r.doc_id, r.text) for r in first.values()]
    comp, _ = brute_components(rows, 5)
    kept = {i: t for (i, t), c in zip(rows, comp) if i == c}
    assert {r.doc_id for r in out} <= set(kept) and max(Counter(r.doc_id for r in out).values()) <= 2
    codec = bpe._codec(corpus_pipeline.VOCABULARY, public_tokenizers.PATTERN)
    assert all(list(r.ids) == codec[0].encode_ordinary(kept[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)
    d = [(i, t, s.source) for (i, t) in kept.items() for s in cleaned if s.doc_id == i]
    times = {i: math.floor(taken / size + 0.5) for i, size, _, taken in brute_mix(d, mixing.BLOCK)}
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in times.items() if n})


def test_pipeline_stages_on_edge_cases(spark, docs, none):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns and an empty table, stage by stage."""
    import corpus_pipeline

    for start, left in ((docs, True), (none, False)):
        d = start
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, d, SF)
            rows = out.collect()
            assert bool(rows) == left, name
            if name != "tokens":
                assert out.columns == docs.columns, name
                d = spark.createDataFrame(rows, docs.schema)
        if left:
            assert {r.doc_id for r in rows} <= {i for i, *_ in ROWS} and all(r.n_tokens == len(r.ids) for r in rows)
    kept = corpus_pipeline.quality(spark, docs, SF).collect()
    assert all(r.text for r in kept) and len({r.text for r in kept if r.doc_id == 15}) == 1


def test_pipeline_first_stage_against_brute_force(spark):
    """Lines of over 20 distinct texts and 1 % of a source's go, and documents that fail the base rules or are depleted."""
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").collect()
    norm = lambda x: squeezed(x).strip().lower()
    held, total = {}, {}
    for r in docs_:
        total.setdefault(r.source, set()).add(r.text or "")
        for x in {norm(y) for y in (r.text or "").split("\n")} - {""}:
            held.setdefault((r.source, x), set()).add(r.text or "")
    hot = {k for k, v in held.items() if len(v) > 20 and 100 * len(v) > len(total[k[0]])}
    want = {}
    for r in docs_:
        text = r.text or ""
        w = WORD.findall(text)
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {k for k, n in Counter(win).items() if n > 1}
        hit = len({j for k, x in enumerate(win) if x in twice for j in range(k, k + 8)})
        cut = sum(len(norm(y).split(" ")) for y in text.split("\n") if (r.source, norm(y)) in hot)
        if len(w) >= 20 and 100 * hit <= 30 * len(w) and len(w) - cut >= 10 and 100 * (len(w) - cut) >= 30 * len(w):
            want[r.doc_id] = "\n".join(y for y in text.split("\n") if (r.source, norm(y)) not in hot)
    got = {r.doc_id: r.text for r in apply_quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == want


def test_queries_have_stable_names():
    names = [n for n in queries.QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)
    assert json.dumps(sorted(names))
