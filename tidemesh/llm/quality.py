"""Operator 4: quality rules by compression bands.

A text is compressed as a whole and in fixed chunks; a ratio below its band means repetition, one above it
means noise.  The band depends on the length, because a short text has nothing to refer back to.  Chunks cover the
whole text: what is left after the full ones is a shorter chunk, and texts below a chunk have smaller chunks.

Defined results: a null or empty text has no words, all counts 0, ratio null, base_failed true and kept false;
every input row gives one output row; extra columns are ignored; an empty table gives an empty table.
Whole texts are read, whatever their length; memory is a few times the longest text of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import narrow, texts_of


@dataclass(frozen=True)
class Bands:
    """(smallest length in bytes, lowest ratio, highest ratio), by rising length; the last that fits holds."""

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.30, 1.80), (256, 0.28, 1.00), (512, 0.25, 0.88), (2048, 0.20, 0.78), (16384, 0.15, 0.72))
    chunk: int = 4096
    #: Full chunks; a shorter one has the band of a whole of its length.
    chunk_band: tuple[float, float] = (0.17, 0.76)
    #: A text shorter than `chunk` is halved at least, into chunks of a power of two and of so many bytes at least.
    least_chunk: int = 256
    #: A text fails when chunks outside their band hold more than this share of its bytes.
    bad_chunks: float = 0.2
    level: int = 3


COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)
_SPACES, _SYMBOLS = " \t\n\v\f\r", b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pairs = ids[:-1] * len(number) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)  # small numbers again, so that a product cannot overflow
    _, at, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[at] > 1)
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[starts + k] = True
    return int(inside.sum())


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def chunk_size(n: int, bands: Bands) -> int:
    """Bytes of a chunk of a text of n bytes."""
    return bands.chunk if n >= bands.chunk else max(bands.least_chunk, 1 << max(0, (n // 2).bit_length() - 1))


def band(n: int, bands: Bands) -> tuple[float, float]:
    """Lowest and highest ratio of a text of n bytes."""
    return next((lo, hi) for size, lo, hi in reversed(bands.whole) if n >= size)


def verdict(data: bytes, bands: Bands, compress) -> tuple[float, int, int, bool]:
    """Ratio of the whole, chunks, chunks out of their band, accepted."""
    ratio = len(compress(data)) / len(data)
    low, high = band(len(data), bands)
    size = chunk_size(len(data), bands)
    starts = range(0, len(data), size) if len(data) > size or len(data) == bands.chunk else ()
    bad = []
    for k in starts:
        c = data[max(0, min(k, len(data) - bands.least_chunk)) : k + size]  # a last chunk of a few bytes begins earlier
        lowest, highest = bands.chunk_band if len(c) == bands.chunk else band(len(c), bands)
        if not lowest <= len(compress(c)) / len(c) <= highest:
            bad.append(min(size, len(data) - k))
    return ratio, len(starts), len(bad), low <= ratio <= high and sum(bad) <= bands.bad_chunks * len(data)


def judged(text: str | None, bands: Bands, compress) -> tuple:
    if not text:
        return 0, 0, 0, 0, 0, True, False, None, 0, 0
    data = text.encode()
    words = data.split()  # the six ASCII white-space bytes
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    ratio, chunks, bad, good = verdict(data, bands, compress)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(data.count(s) for s in _SYMBOLS)
    return len(words), chars, symbols, duplicate_lines(data), repeats, failed, good and not failed, ratio, chunks, bad


def quality(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rule and compression verdict of each document, in one pass without a shuffle."""
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(COLUMNS).fields]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def run(batches):
        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            rows = [judged(t, bands, compress) for t in texts_of(batch)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return narrow(docs, id_col, text_col).mapInArrow(run, COLUMNS)
