"""Operator 11: fill-in-middle transformation by big-integer bit-parallelism.

A text's UTF-8 bytes become big integers, bit i for byte i: `bytes.translate` marks the bytes of a class, shifts and
boolean operations turn classes into the last bytes of units, `bit_count` is their number, and the byte where the first
k units end is found by halving the integer around the k-th bit.  A text is never split into Python characters.

Units are code points (`chars`), runs of non-blank bytes with the blanks after them (`words`; blanks before the first run
are one too) or lines (`lines`).

Defined results: a null text is empty, an empty text has no units and stays plain; a text that holds a marker stays
plain; a null id is written as nothing in the hashed name, so such rows share their cuts; rows with one id are each
transformed; a byte that belongs to no code point joins the one before it; texts of any length are taken whole; an
empty table gives an empty table; columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

BLANK = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Settings:
    unit: str = "chars"
    #: The cuts of a document follow from the hash of this name and its id.
    name: str = "1:"
    #: Of 100 texts, so many stay as they are from this number on; of the others so many put the suffix first.
    plain_from: int = 90
    spm_below: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _class(members) -> bytes:
    chosen = set(members)
    return bytes(49 if b in chosen else 48 for b in range(256))  # "1" or "0"


HEADS, INK, FEEDS = _class([*range(0x80), *range(0xC0, 0x100)]), _class(set(range(256)) - set(BLANK)), _class(b"\n")


def mask(data: bytes, members: bytes) -> int:
    """Bit i is set where byte i is of the class."""
    return int(data.translate(members)[::-1], 2)


def ends(data: bytes, unit: str) -> int:
    """Bit i is set where byte i is the last one of a unit; 0 for no bytes."""
    if unit not in ("chars", "words", "lines"):
        raise ValueError(f"no unit is called {unit!r}")
    if not data:
        return 0
    if unit == "chars":
        starts = mask(data, HEADS)
    elif unit == "words":
        ink = mask(data, INK)
        starts = ink & ~(ink << 1)
    else:
        starts = mask(data, FEEDS) << 1
    last = 1 << len(data) - 1
    # the first byte always begins the first unit, and a start right behind the text begins none
    return (starts & (last | last - 1)) >> 1 | last


def selected(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set bits below it: each step keeps one half of the integer."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - below, at + half
    return at


def cut_at(marks: int, units: int, width: int) -> int:
    """The number of bytes in the first `units` units."""
    return selected(marks, units - 1, width) + 1 if units else 0


def rearranged(data: bytes, h: tuple[int, int, int, int], s: Settings) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, units of the middle, output)."""
    marks = ends(data, s.unit)
    n = marks.bit_count()
    p, q, m = (x.encode() for x in (s.prefix, s.suffix, s.middle))
    if not data or p in data or q in data or m in data or h[2] % 100 >= s.plain_from:
        return n, "plain", None, None, data
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (cut_at(marks, k, len(data)) for k in (first, second))
    if h[3] % 100 < s.spm_below:
        return n, "spm", first, second - first, b"".join((q, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", first, second - first, b"".join((p, data[:a], q, data[b:], m, data[a:b]))


def rebuilt(output: bytes, form: str, s: Settings) -> bytes:
    """The text that `rearranged` had: no part of it holds a marker, so each marker's first place is its only one."""
    if form == "plain":
        return output
    p, q, m = (x.encode() for x in (s.prefix, s.suffix, s.middle))
    one, two = (q, p) if form == "spm" else (p, q)
    head, middle = output[len(one) :].split(m, 1)
    x, y = head.split(two, 1)
    return y + middle + x if form == "spm" else x + middle + y


def _texts(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary()).view(pa.string())  # also bytes that are no UTF-8 pass unchanged


def transform(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output): one pass without a shuffle."""
    ends(b"", s.unit)  # raises here where the unit is unknown, not in a task
    digest = F.sha2(F.concat(F.lit(s.name), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    words = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), digest.alias("digest")).select("doc_id", "text", *words)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = zip(*(part.column(k).to_pylist() for k in range(2, 6)))
                n, form, first, second, output = zip(*(rearranged(t, h, s) for t, h in zip(part.column(1).to_pylist(), hashes)))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _texts(output)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restore(done: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The columns of `transform` and `restored`, the text rebuilt from output and form."""
    rows = done.select("doc_id", "n", "form", "prefix_units", "middle_units", F.col("output").cast("binary").alias("output"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [rebuilt(o, f, s) for o, f in zip(part.column(5).to_pylist(), part.column(2).to_pylist())]
                columns = [*part.columns[:5], part.column(5).view(pa.string()), _texts(texts)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "restored"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string, restored string")


def digests(restored: DataFrame) -> DataFrame:
    """The digest columns of op11 from the operator's texts; computed by Spark."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restored.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha("output"), sha("restored"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, substring(t, 1, least(x, y)) AS p, substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substring(t, greatest(x, y) + 1) AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
