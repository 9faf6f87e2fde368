"""Operators 11 to 13 against plain Python, and their edge cases."""

import base64
import gzip
import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidemesh.llm import fill_middle, lexical_search, warc

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "日本語 ünï ſ \x85 🙂 x"), (6, "ab <S> cd"), (7, "<P"), (8, "a" * 30000), (9, "line\n\nline\r\nend\n")]
CLASHES = ("n", "form", "output", "h1", "digest", "q", "row", "data", "sha1", "type", "rank", "score", "item_id")


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def plain_fim(doc, text):
    """The contract, in Python characters."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_is_the_plain_one(spark):
    rng = random.Random(2)
    rows = EDGE + [(k, "".join(rng.choice("aé漢🙂 \n<PSM>") for _ in range(rng.randint(0, 60)))) for k in range(100, 600)]
    done = fill_middle.restore(fill_middle.transform(table(spark, rows, "doc_id long, text string"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in done), key=key) == sorted(((d, *plain_fim(d, t)) for d, t in rows), key=key)
    assert Counter(r.restored for r in done) == Counter(t or "" for _, t in rows) and {r.form for r in done} == {"plain", "psm", "spm"}
    assert fill_middle.digests(fill_middle.restore(fill_middle.transform(table(spark, [], "doc_id long, text string")))).count() == 0


@pytest.mark.parametrize("unit,cut", [("words", r"\A\s+|\S+\s*"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_fill_middle_units(unit, cut):
    rng = random.Random(3)
    s = fill_middle.Settings(unit=unit)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\t") for _ in range(rng.randint(1, 40)))
        parts, marks = re.findall(cut, text), fill_middle.ends(text.encode(), unit)
        assert "".join(parts) == text and marks.bit_count() == len(parts)
        assert [fill_middle.cut_at(marks, k, len(text)) for k in range(len(parts) + 1)] == [len("".join(parts[:k])) for k in range(len(parts) + 1)]
        n, form, a, b, out = fill_middle.rearranged(text.encode(), (rng.randrange(1 << 32), rng.randrange(1 << 32), 0, rng.randrange(100)), s)
        assert fill_middle.rebuilt(out, form, s).decode() == text and 0 <= a <= a + b <= n


def test_fill_middle_knows_its_units(spark):
    with pytest.raises(ValueError):
        fill_middle.transform(table(spark, EDGE, "doc_id long, text string"), fill_middle.Settings(unit="tokens"))


def test_fill_middle_takes_any_bytes_and_long_texts():
    rng = random.Random(4)
    for size in (1, 7, 1000, 300_000):
        data = bytes(rng.randrange(256) for _ in range(size))
        marks = fill_middle.ends(data, "chars")
        assert fill_middle.cut_at(marks, marks.bit_count(), size) == size
        n, form, a, b, out = fill_middle.rearranged(data, (5, 2**31, 1, 1), fill_middle.Settings())
        assert fill_middle.rebuilt(out, form, fill_middle.Settings()) == data


PAGES = [
    (5, "http://a.example/x?q=1#f", "<p>same</p>"), (3, "https://b.example", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://n.example/", "<p>same</p>"), (1, "no scheme", None), (2, "http://e.example/ü ü\r\nX: 1", ""),
    (7, "http://c.example/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (8, "http://d.example/", "ü漢🙂\n"), (3, "https://b.example", "<p>same</p>"), (None, None, "<p>only null ids</p>"), (None, None, "<p>only null ids</p>"), (10, "http://l.example/", "x" * 200_000),
]


def plain_warc(rows, least=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for html, pages in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        pages = sorted(pages, key=lambda x: (x is None, x or 0))
        for k, page in enumerate(pages):
            first = not k or len(data) < least
            out.append((page, len(data), digest, "response" if first else "revisit", None if first else pages[0]))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_warc_round_trip(spark, least):
    done = warc.round_trip(table(spark, PAGES, "page_id long, url string, html string"), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, done.collect())) == plain_warc(PAGES, least)
    assert warc.round_trip(table(spark, [], "page_id long, url string, html string")).count() == 0


def test_warc_hot_payload_and_small_files(spark, tmp_path):
    rows = [(k, f"http://h{k}.example/", "copy" if k % 3 == 0 else f"text {k}" * (k % 50)) for k in range(3000)]
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), path, file_bytes=20_000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 20
    done = warc.resolve(warc.assemble(warc.read(spark, path, suffixes="part-*"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, done.collect())) == plain_warc(rows)


def test_warc_nested_rows(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(table(spark, PAGES, "page_id long, url string, html string"), path)
    found = warc.assemble(warc.read(spark, path)).collect()
    assert len(found) == len(PAGES) and all(len(r.requests) == 1 and len(r.metadata) == 1 and not r.others for r in found)
    assert sorted(bytes(r.main.payload).decode() for r in found if r.main.type == "response") == sorted({h or "" for _, _, h in PAGES})
    revisits = [r for r in found if r.main.type == "revisit"]
    ids = {r.capture_id for r in found if r.main.type == "response"}
    assert len(revisits) == 6 and all(r.main.payload is None and r.main.refers_to in ids and r.main.fields["content-length"] for r in revisits)
    data = gzip.decompress(next(f for f in sorted((tmp_path / "w").glob("part-*")) if f.stat().st_size > 40).read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and data.endswith(b"\r\n\r\n")
    assert {r.main.target_uri for r in found} == {"http://e.example/ü%20ü%0D%0AX:%201", "no%20scheme", None, *(u for _, u, _ in PAGES if u and " " not in u)}


def record(headers, block=b"", version=b"WARC/1.0"):
    lines = [version, *[f"{k}: {v}".encode() for k, v in headers], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


FOREIGN = [
    record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x\r\n"),
    # the response names its request, and metadata names the request only
    record([("warc-type", "Response"), ("WARC-Record-ID", "<r1>"), ("WARC-Concurrent-To", "<q1>"), ("Content-Type", "application/http;msgtype=response"), ("X-Long", "one\r\n\ttwo")], b"HTTP/1.1 200 OK\nServer: y\n\npay\r\n\r\nload"),
    record([("WARC-Type", "request"), ("WARC-Record-ID", "<q1>"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.0\r\n\r\n"),
    record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m1>"), ("WARC-Concurrent-To", "<q1>"), ("Content-Type", "application/warc-fields")], b"a: 1\r\nb: 2\r\n"),
    record([("WARC-Type", "resource"), ("WARC-Record-ID", "<r2>"), ("Content-Type", "image/png")], bytes(range(256))),
    record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m2>"), ("WARC-Concurrent-To", "<r2>"), ("WARC-Concurrent-To", "<gone>")], b""),
    record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m2>"), ("WARC-Concurrent-To", "<r2>")], b""),
    record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<v>"), ("WARC-Refers-To", "<elsewhere>"), ("WARC-Payload-Digest", "sha1:abc")], b""),
    record([("WARC-Type", "request"), ("WARC-Record-ID", "<q9>"), ("WARC-Concurrent-To", "<nowhere>")], b""),
]


@pytest.mark.parametrize("packed", ["plain", "whole", "each"])
def test_warc_of_other_writers(spark, tmp_path, packed):
    data = {"plain": b"".join(FOREIGN), "whole": gzip.compress(b"".join(FOREIGN)), "each": b"".join(map(gzip.compress, FOREIGN))}[packed]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.warc").write_bytes(data)
    found = {r.capture_id: r for r in warc.assemble(warc.read(spark, f"file://{tmp_path}")).collect()}
    assert set(found) == {"<r1>", "<r2>", "<v>", "<i>", "<q9>"}
    one = found["<r1>"]
    assert bytes(one.main.payload) == b"pay\r\n\r\nload" and one.main.fields == {"server": "y"} and [r.record_id for r in one.requests] == ["<q1>"] and [r.record_id for r in one.metadata] == ["<m1>"]
    assert {e["key"]: e["value"] for e in one.metadata[0].fields} == {"a": "1", "b": "2"}
    assert bytes(found["<r2>"].main.payload) == bytes(range(256)) and [r.record_id for r in found["<r2>"].metadata] == ["<m2>"]
    assert found["<i>"].main is None and [r.record_id for r in found["<i>"].others] == ["<i>"] and [r.record_id for r in found["<q9>"].requests] == ["<q9>"]
    facts = {r.record_type: r for r in warc.resolve(warc.assemble(warc.read(spark, f"file://{tmp_path}", payload=False))).collect()}
    assert facts["revisit"].payload_digest == "ABC" and facts["revisit"].payload_bytes is None and facts["resource"].payload_bytes == 256


@pytest.mark.parametrize("data", [b"".join(FOREIGN)[:-60], gzip.compress(b"".join(FOREIGN))[:-40], b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.0\r\nWARC-Type: request\r\n\r\n", b"WARC/1.0\r\nContent-Length: 3\r\n"])
def test_warc_damage_is_told(data):
    with pytest.raises(ValueError, match="^name: "):
        list(warc.records_of(data, "name"))


def test_warc_small_pieces():
    data = gzip.compress(b"".join(FOREIGN))
    stream = warc._Stream(data, "", step=3)
    assert stream.take(8) == b"WARC/1.0" and stream.line() == b"" and stream.line() == b"WARC-Type: warcinfo"


def plain_search(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n, size = sum(x[2] > 0 for x in held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, length in held:
            if length:
                m = 25 + 75 * length * n // size
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
                if score > 0:
                    found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block,group,batch", [(64, 256, 4096), (3, 4, 4096), (1, 2, 7)])
def test_search_is_brute_force(spark, block, group, batch):
    rng = random.Random(block)
    vocabulary = [f"w{k}" for k in range(200)] + ["Zürich", "STRASSE", "漢字", "ſ"]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 50, 204])]) + rng.choice(["", ".", "\x7f", "\x85"]) for _ in range(n))
    docs = [(d, t) for d, t in EDGE] + [(k, say(rng.choice([0, 1, 3, 20, 200]))) for k in range(100, 400)]
    docs += [(500 + k, docs[40][1]) for k in range(60)] + [(None, docs[41][1])] * 3  # many ties, also beyond the k-th place
    items = [(k, say(rng.choice([1, 4, 12]))) for k in range(20)] + [(20, None), (21, ""), (22, " .,"), (23, "unknown"), (24, "w1 w1 W1 w2"), (24, "w1 w1 W1 w2"), (None, "w3"), (25, docs[40][1])]
    s = lexical_search.Settings(block=block, group=group, batch=batch)
    found = lexical_search.ranked(table(spark, docs, "doc_id long, text string").repartition(5), table(spark, items, "item_id long, text string"), s=s)
    assert Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == plain_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = table(spark, EDGE, "doc_id long, text string"), table(spark, [(1, "word")], "item_id long, text string")
    assert lexical_search.ranked(docs.limit(0), items).count() == 0 and lexical_search.ranked(docs, items.limit(0)).count() == 0
    assert lexical_search.ranked(docs, items, k=1).select("doc_id", "rank").collect() == [(4, 1)]


def test_search_prunes(spark):
    """Blocks without a chance are not scored: where one block holds a query's rare words, its others stay below."""
    docs = spark.createDataFrame([(k, f"common{k % 7} " * 5 + (f"rare{k}" if k < 20 else "")) for k in range(2000)], "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    index = lexical_search.build(docs, [b"common1"] + [f"rare{k}".encode() for k in range(20)], lexical_search.Settings(block=10))
    texts = [f"common1 {' '.join(f'rare{k}' for k in range(10))}"]
    queries = lexical_search._Queries([t.encode() for t in texts], index)
    blocks = [(r.docs, *(lexical_search.np.array(r[c]) for c in ("starts", "terms", "gains", "top_terms", "top_gains"))) for r in index.blocks.collect()]
    bounds = [int(queries.bounds(b)[0]) for b in blocks]
    weight = lexical_search.np.zeros(queries.size, lexical_search.np.int64)
    tops = [int(queries.scores(0, b, weight).max()) for b in blocks]
    assert all(b >= t for b, t in zip(bounds, tops)) and not weight.any()
    least = sorted((int(x) for b in blocks for x in queries.scores(0, b, weight)), reverse=True)[9]
    assert sum(b >= least for b in bounds) < len(blocks) / 2


def test_search_numbers_stay_in_64_bits():
    gains = lexical_search.gains_of([10_000_000], lexical_search.np.array([10_000_000]), lexical_search.np.array([0, 1]), 50_000_000_000, 10**14)
    assert gains.dtype.itemsize == 8 and struct.pack("q", int(gains[0]))
