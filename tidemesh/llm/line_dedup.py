"""Operator 3: line dedup with content-defined chunks.

A rolling hash over the hashes of a document's lines chooses where chunks end, so an insertion moves no boundary but those
beside it.  Chunks of two lines and more that occur more than once over all documents are found by hash, compared by
bytes, and taken out as a whole.  A repeat that is shorter than a chunk, or that begins or ends inside one, has no chunk of
its own: it is found by growing outwards over overlapping passages of two lines (the blank lines between them included)
and single lines of more than `words` words.  Such a passage is only looked at where it is in no repeated chunk, or occurs
more often than the chunk around it.  A longer repeat is the union of the chunks and passages in it.

What repeats stays in the document with the smallest id, at its first place there, and is taken out everywhere else.  So a
line that goes has an equal line at an earlier place (id, then position) that stays.  Blank lines go with the line they
follow.

Defined results: null and empty texts stay as they are; a text of which all is repeated becomes empty; rows with the
same id count as one document (a passage is not removed from one because the other has it); rows with a null id keep
their text; a passage that overlaps its own first place (a line three times in a row) is no second one; texts of any
length are taken whole, and a document is at most one row at a time; all other columns are kept, whatever their names; an
empty table gives an empty table.  removed_chunks counts the stretches of text taken out, removed_lines their lines with
blank ones.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrow, saved, texts_of


@dataclass(frozen=True)
class Settings:
    #: A line ends a chunk with a chance of one in so many.
    spread: int = 3
    #: Passages of so many lines, blank ones not counted, are compared.
    lines: int = 2
    #: A single line of more than so many words is a passage of its own.
    words: int = 50
    #: A chunk ends here at the latest, counted from its beginning.
    most_lines: int = 64


def units(text: str) -> list[tuple[bytes, int, int]]:
    """(bytes with the blank lines that follow, length without them and without a line end, number of lines) of each
    line that is not blank; blank lines at the beginning go with the first.  Joined they are the text, if it has one."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    full = [k for k, line in enumerate(lines) if line.strip()]
    out = []
    for n, k in enumerate(full):
        end = full[n + 1] if n + 1 < len(full) else len(lines)
        begin = k if n else 0
        out.append((b"".join(lines[begin:end]), sum(map(len, lines[begin:k])) + len(lines[k].removesuffix(b"\n")), end - begin))
    return out


def boundaries(found: list[tuple[bytes, int, int]], s: Settings) -> list[tuple[int, int]]:
    """(first unit, number of units) of the content-defined chunks: one ends where the rolling hash of a line and the one
    before it says so, whatever else the document holds, and after `most_lines` units at the latest."""
    out, begin, before = [], 0, 0
    for k, (data, _, _) in enumerate(found):
        now = xxhash.xxh3_64_intdigest(data.strip())
        rolling = (now * 0x9E3779B97F4A7C15 + before * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
        before = now
        if (rolling >> 33) % s.spread == 0 or k - begin + 1 == s.most_lines:
            out.append((begin, k - begin + 1))
            begin = k + 1
    if begin < len(found):
        out.append((begin, len(found) - begin))
    return out


def _key(found: list[tuple[bytes, int, int]], at: int, width: int) -> bytes:
    """The bytes of units without the blank lines at their ends and the line end that the last line may have or, at a
    text's end, lack."""
    data, size, _ = found[at]
    first = data if at else data[len(data) - len(data.lstrip(b"\n")) :]
    if width == 1:
        return first[: size - len(data) + len(first)]
    last = found[at + width - 1]
    return first + b"".join(u[0] for u in found[at + 1 : at + width - 1]) + last[0][: last[1]]


def passages(found: list[tuple[bytes, int, int]], s: Settings) -> list[tuple[int, int, bytes, bytes | None]]:
    """(first unit, number of units, bytes compared, bytes of the chunk around it) of each chunk and passage, by first unit;
    a chunk has none around it, and one of two lines is the passage that it is."""
    around: list[bytes | None] = [None] * len(found)
    inside: list[int] = [0] * len(found)
    out: list[tuple[int, int, bytes, bytes | None]] = []
    if s.lines > 1:
        for at, width in boundaries(found, s):
            if width > s.lines:
                key = _key(found, at, width)
                out.append((at, width, key, None))
                around[at : at + width] = [key] * width
                inside[at : at + width] = range(width, 0, -1)
    for k in range(len(found)):
        line = _key(found, k, 1)
        if len(line.split()) > s.words:
            out.append((k, 1, line, around[k]))
        if s.lines > 1 and k + s.lines <= len(found):
            # equal lines overlap their own repeats, so their number says nothing about the chunk's
            lone = len({u[0].strip() for u in found[k : k + s.lines]}) == s.lines
            out.append((k, s.lines, _key(found, k, s.lines), around[k] if lone and inside[k] >= s.lines else None))
    out.sort(key=lambda p: p[:2])
    return out


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def places(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, hash, times) of every distinct passage of a row with an id."""

    def run(batches):
        for batch in batches:
            ids, hashes, times = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                for h, n in Counter(_hash(key) for key, _ in apart(passages(units(text or ""), s))).items():
                    ids.append(doc), hashes.append(h), times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hashes, times)], ["doc_id", "hash", "times"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, hash long, times long")


def apart(found: list[tuple[int, int, bytes, bytes | None]]) -> list[tuple[bytes, bytes | None]]:
    """(bytes, bytes of the chunk around) of the passages but those that overlap an equal one before them."""
    ends: dict[bytes, int] = {}
    out = []
    for at, width, key, chunk in found:
        if at >= ends.get(key, 0):
            ends[key] = at + width
            out.append((key, chunk))
    return out


def repeated(docs: DataFrame, at: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(hash, chunk, keeper, n): the passages that occur more than once, and the smallest id they occur in.

    docs: doc_id and text; at: what `places` returns.  Only the bytes of chunks and passages whose hash occurs more than
    once are moved, and of those in a repeated chunk only what occurs more often than it.  They are grouped by hash and
    bytes, with map-side combine, so one in a third of all documents is a few rows.
    """
    often = at.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1")
    marked = at.join(often, "hash").groupBy("doc_id").agg(F.collect_set(F.struct("hash", "n")).alias("marked"))

    def run(batches):
        for batch in batches:
            ids, hashes, keys = [], [], []
            for doc, text, some in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
                often = {m["hash"]: m["n"] for m in some}
                for key, chunk in apart(passages(units(text or ""), s)):
                    h = _hash(key)
                    if often.get(h, 0) > (often.get(_hash(chunk), 1) if chunk else 1):
                        ids.append(doc), hashes.append(h), keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "hash", "chunk"])

    rows = docs.join(marked, "doc_id").select("doc_id", "text", "marked").mapInArrow(run, "doc_id long, hash long, chunk binary")
    return rows.groupBy("hash", "chunk").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")


def cut(text: str | None, doc: int | None, found: list[tuple[bytes, int]], s: Settings) -> tuple[str | None, int, int]:
    """The text without its repeated passages, and the stretches and lines taken out."""
    if not text or not found:
        return text, 0, 0
    keepers = dict(found)
    parts = units(text)
    gone = [False] * len(parts)
    ends: dict[bytes, int] = {}  # where the first place of a passage ends, which its own document keeps
    for at, width, key, _ in passages(parts, s):
        if key not in keepers:
            continue
        if keepers[key] != doc or at >= ends.setdefault(key, at + width):
            gone[at : at + width] = [True] * width
    if not any(gone):
        return text, 0, 0
    n_chunks = sum(g and not before for g, before in zip(gone, [False, *gone]))
    kept = b"".join(p[0] for p, g in zip(parts, gone) if not g)
    return kept.decode("utf-8", "surrogatepass"), n_chunks, sum(p[2] for p, g in zip(parts, gone) if g)


def dedup(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", counts: bool | tuple[str, str] = False) -> DataFrame:
    """The rows of `docs` with their texts cut; with `counts` also removed_chunks and removed_lines (long), or two other names.

    What a document must compare comes to it by its id: at most its own passages, each with its bytes.
    """
    texts = narrow(docs, id_col, text_col)
    at_ids = saved(places(texts, s))
    rows = saved(repeated(texts, at_ids, s))
    # the hot side of this join is split by adaptive execution: it feeds an aggregation with another key
    needed = at_ids.join(rows.select("hash", "chunk", "keeper"), "hash").where("keeper <> doc_id or times > 1")
    found = needed.groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "keeper")).alias("found"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    both = packed.join(found, "doc_id", "left").select("doc_id", "row", "found")
    at = docs.columns.index(text_col)
    fields = [T.StructField(f.name, T.StringType() if k == at else f.dataType) for k, f in enumerate(docs.schema.fields)]
    if counts:
        fields += [T.StructField(name, T.LongType()) for name in (("removed_chunks", "removed_lines") if counts is True else counts)]

    def run(batches):
        for batch in batches:
            columns = [c for c in batch.column(1).flatten()]
            texts = columns[at].cast(pa.string()).to_pylist()
            found = [[(x["chunk"], x["keeper"]) for x in f or ()] for f in batch.column(2).to_pylist()]
            out = [cut(t, d, f, s) for t, d, f in zip(texts, batch.column(0).to_pylist(), found)]
            columns[at] = pa.array([o[0] for o in out], pa.string())
            if counts:
                columns += [pa.array([o[k] for o in out], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return both.mapInArrow(run, T.StructType(fields))
