"""Operator 1: byte-pair encoding and decoding with a given vocabulary file.

A piece of text (one match of the vocabulary's pattern) starts as one symbol per byte.  A segment tree over
its adjacent pairs holds rank * width + position, so the root is the leftmost pair of lowest rank; a merge
changes three leaves and their ancestors, until the root says that nothing can be merged.

Defined results: a null or empty text has no tokens and decodes to the empty string; every input row gives one
output row (repeated rows and null ids too); very long texts and pieces are encoded whole; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, texts_of

#: Bytes of pieces remembered by one Python worker, by an estimate; the memory is emptied when full, so it stays bounded.
MEMO = 80 << 20
#: Longer pieces, such as base64 or minified code, are encoded anew each time.
LONGEST = 256
_NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merge_all(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merges until no pair is mergeable: always the pair of lowest rank, the leftmost of equal ones.

    ranks: (left << 20 | right) -> rank; merged: rank -> the new symbol.  The tree has 16 children a node, so
    the pieces of ordinary words are one node, and a piece of n symbols has log16(n) levels.
    """
    width = len(symbols) - 1
    if width < 1:
        return symbols
    rank = ranks.get
    leaves = []
    left = symbols[0]
    for at in range(width):
        right = symbols[at + 1]
        found = rank(left << 20 | right)
        leaves.append(_NONE if found is None else found * width + at)
        left = right
    levels = [leaves]
    while len(levels[-1]) > 16:
        below = levels[-1]
        levels.append([min(below[k : k + 16]) for k in range(0, len(below), 16)])
    top, deep = levels[-1], len(levels) > 1
    after = list(range(1, width + 2))
    before = list(range(-1, width + 1))
    while (root := min(top)) != _NONE:
        found, at = divmod(root, width)
        gone = after[at]
        new = symbols[at] = merged[found]
        symbols[gone] = -1
        following = after[at] = after[gone]
        leaves[at] = _NONE
        if following <= width:
            before[following] = at
            leaves[gone] = _NONE
            found = rank(new << 20 | symbols[following])
            if found is not None:
                leaves[at] = found * width + at
        previous = before[at]
        if previous >= 0:
            found = rank(symbols[previous] << 20 | new)
            leaves[previous] = _NONE if found is None else found * width + previous
        if deep:
            nodes = {max(previous, 0) >> 4, at >> 4, min(gone, width - 1) >> 4}
            for k in range(1, len(levels)):
                below, level = levels[k - 1], levels[k]
                for node in nodes:
                    level[node] = min(below[node << 4 : (node << 4) + 16])
                nodes = {node >> 4 for node in nodes}
    return [s for s in symbols if s >= 0]


#: Below U+0250 Python's own pattern engine has the same classes but for these characters.
_OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]").search


def _plain(pattern: str) -> str:
    """The pattern in the classes of Python's own, faster engine; right for texts without a character of _OTHER."""
    for name, own in ((r"[^\s\p{L}\p{N}]", r"(?:[^\w\s]|_)"), (r"[\p{L}]", r"[^\W\d_]"), (r"\p{L}", r"[^\W\d_]"), (r"[\p{N}]", r"\d"), (r"\p{N}", r"\d")):
        pattern = pattern.replace(name, own)
    return pattern


class _Memo(dict):
    def __init__(self, make):
        self.make = make
        self.held = 0

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) > LONGEST:
            return value
        cost = 200 + 4 * len(piece) + 8 * len(value)  # the entry, the text, references to ids
        if self.held + cost > MEMO:
            self.clear()
            self.held = 0
        self.held += cost
        self[piece] = value
        return value


class Vocabulary:
    """Reads a vocabulary file with merges (`model.type` BPE, byte-level symbols) and encodes with it."""

    #: Pattern of byte-level vocabularies whose file names none (a fixed value of that format).
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        ids = model["vocab"]
        self.tokens = [""] * (1 + max(max(ids.values()), *(t["id"] for t in spec["added_tokens"]), 0))
        for token, i in ids.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + suffix] for s in symbols]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[one] << 20 | ids[two], rank)
            self.merged.append(ids[one + two])
        steps = [spec["normalizer"] or {"type": ""}]
        steps = steps[0].get("normalizers", steps)
        self.nfc = any(s["type"] == "NFC" for s in steps)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        named = [c["pattern"]["Regex"] for c in cuts if c["type"] == "Split"]
        self.pattern = named[0] if named else self.BYTE_LEVEL
        self.pieces, self.plain_pieces = regex.compile(self.pattern).findall, re.compile(_plain(self.pattern)).findall
        self.memo = _Memo(self.encode_piece)
        self.text_of = pa.array(self.tokens, pa.string())
        # A file without a decoder joins its tokens with a space; a byte-level one turns symbols back into bytes.
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.byte_of = {s: b for b, s in enumerate(symbols)}

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.final[data[-1]])
        return tuple(merge_all(symbols, self.ranks, self.merged))

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens.  White space only separates pieces where the pattern leaves it out."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # capital sigma has one lower-case form here, wherever it stands in a word
            text = text.replace("Σ", "σ").lower() if not text.isascii() else text.lower()
        return self.pieces(text) if _OTHER(text) else self.plain_pieces(text)

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        known = self.memo.__getitem__
        for k, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(known, self.split(part))))
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token ids to text, a whole column at once."""
        flat = self.text_of.take(ids.flatten())
        lists = pa.ListArray.from_arrays(ids.offsets, flat)
        if not self.byte_level:
            return pc.binary_join(lists, " ")
        table = self.byte_of
        return pa.array([bytes(table[c] for c in text).decode("utf-8", "replace") for text in pc.binary_join(lists, "").to_pylist()], pa.string())


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(encoded: list[array]) -> pa.ListArray:
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) for e in encoded], out=offsets[1:])
    flat = np.concatenate([np.frombuffer(e, np.int32) for e in encoded if e] or [np.empty(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): each whole text's tokens, and the text they decode to."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = _lists([vocab.encode(t) for t in texts_of(part)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids, vocab.decode(ids)], ["doc_id", "ids", "decoded"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded string) from token ids; null ids decode to the empty string."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            ids = pa.array([v or [] for v in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vocab.decode(ids)], ["doc_id", "decoded"])

    ids = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return ids.mapInArrow(run, "doc_id long, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """The digest columns of op1 from the operator's real outputs; computed by Spark."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more
    )
