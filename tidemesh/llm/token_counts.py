"""Operator 8: edit-aware token counts.

A document's pre-tokens lie in blocks, the leaves of a segment tree that sums characters and tokens.  An edit finds its
first pre-token by a descent over the character sums, cuts the touched pre-tokens and a few of context again, stops
where the new cuts meet an old one beyond the edit, and updates the sums above the changed blocks.  Only new
pre-tokens are encoded, however often one place is edited.  A block that has grown to twice its size is split, and only
then the tree above the blocks, which is a 64th of the text's pre-tokens, is built anew.

Defined results: a null text counts as empty; edits of a document apply in the order of `seq` (ties by start, then
text), each to the text as it is then; start and end are held to the text's bounds, and an end before the start means
an insertion; a null replacement is empty; edits of unknown documents are ignored; rows that repeat an id each get all
edits of the id; a null id has no edits in `count`; very long texts are read whole; strings of special tokens count as
ordinary text; extra columns are ignored; an empty table gives an empty table.  A vocabulary that changes the text or
drops white space has no places to edit and is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary

#: Pre-tokens of context before an edit, and characters the pattern may look ahead.
BEFORE, AHEAD = 3, 3
#: Pre-tokens of a block.
BLOCK = 64


def checked(vocab: Vocabulary) -> Vocabulary:
    if vocab.nfc or vocab.lower or not vocab.byte_level:
        raise ValueError("this vocabulary changes texts before it cuts them; places in a text mean nothing in its pre-tokens")
    return vocab


class TokenTree:
    """Sums of characters and tokens over the pre-tokens of one text.  With `lengths` and `counts` of all pre-tokens, as
    `state` returns them, nothing is encoded."""

    def __init__(self, text: str, vocab: Vocabulary, lengths=None, counts=None):
        self.vocab = checked(vocab)
        if lengths is None:
            pieces = vocab.split(text)
            self.encoded = len(text)
            counts = np.fromiter(map(len, map(vocab.memo.__getitem__, pieces)), np.int64, len(pieces))
        else:
            ends = np.cumsum(lengths)
            if len(lengths) != len(counts) or (int(ends[-1]) if len(ends) else 0) != len(text):
                raise ValueError("lengths and counts are not those of the text")
            pieces = [text[e - n : e] for e, n in zip(ends.tolist(), lengths)]
            self.encoded, counts = 0, np.asarray(counts, np.int64)
        # a block is the range of first pre-tokens it still has, or its own lists once it has been edited
        self.pieces, self.counts = pieces, counts
        self.blocks: list = [range(k, min(k + BLOCK, len(pieces))) for k in range(0, len(pieces), BLOCK)] or [range(0)]
        starts = np.arange(0, max(1, len(pieces)), BLOCK)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        empty = np.zeros(1, np.int64)
        self._build(np.add.reduceat(sizes, starts) if pieces else empty, np.add.reduceat(counts, starts) if pieces else empty)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        n = len(chars)
        self.size = 1 << max(0, n - 1).bit_length()
        # node k has children 2k and 2k + 1; node 1 is the root
        self.chars, self.tokens = np.zeros((2, 2 * self.size), np.int64)
        self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n] = chars, tokens
        for tree in (self.chars, self.tokens):
            width = self.size // 2
            while width:
                tree[width : 2 * width] = tree[2 * width : 4 * width : 2] + tree[2 * width + 1 : 4 * width : 2]
                width //= 2

    def _block(self, k: int) -> tuple[list[str], list[int]]:
        """Pre-tokens and their token counts."""
        block = self.blocks[k]
        if isinstance(block, range):
            return self.pieces[block.start : block.stop], self.counts[block.start : block.stop].tolist()
        return block

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(p for k in range(len(self.blocks)) for p in self._block(k)[0])

    def state(self) -> tuple[list[int], list[int]]:
        """Length and token count of every pre-token."""
        blocks = [self._block(k) for k in range(len(self.blocks))]
        return [len(p) for b in blocks for p in b[0]], [c for b in blocks for c in b[1]]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, pre-token in it, its first character) of the character at a place; the last one at the end."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        block = node - self.size
        pieces = self._block(block)[0]
        for k, piece in enumerate(pieces):
            if at < begin + len(piece) or k == len(pieces) - 1:
                return block, k, begin
            begin += len(piece)
        return block, 0, begin

    def _set(self, k: int, block: tuple[list[str], list[int]]) -> None:
        self.blocks[k] = block
        node = k + self.size
        more, many = sum(map(len, block[0])) - int(self.chars[node]), sum(block[1]) - int(self.tokens[node])
        while node:
            self.chars[node] += more
            self.tokens[node] += many
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        block, at, begin = self._find(start)
        head = self._block(block)
        back = BEFORE
        while back and (at or block):
            if at == 0:
                block -= 1
                head = self._block(block)
                at = len(head[0])
                continue  # a block may be empty
            at -= 1
            begin -= len(head[0][at])
            back -= 1
        # old: pre-tokens from there; seen: (block, pre-token behind) of each
        old, seen, ends, total = [], [], [], begin
        last, k, more = block, at, 4
        pieces = head[0]
        while True:
            wanted = len(old) + more
            while total < end or len(old) < wanted:
                while k == len(pieces) and last + 1 < len(self.blocks):
                    last, k = last + 1, 0
                    pieces = self._block(last)[0]
                if k == len(pieces):
                    break
                old.append(pieces[k])
                k += 1
                total += len(old[-1])
                seen.append((last, k))
                ends.append(total - begin)
            text = "".join(old)
            changed = text[: start - begin] + new + text[end - begin :]
            shift = len(changed) - len(text)
            cuts = self.vocab.split(changed)
            if begin + len(text) >= self.n_chars:
                used = len(old)
                break
            places = {place + shift: n for n, place in enumerate(ends)}
            here, used = 0, None
            for n, piece in enumerate(cuts):
                here += len(piece)
                if here >= end - begin + shift and here in places and here + AHEAD <= len(changed):
                    used, cuts = places[here] + 1, cuts[: n + 1]
                    break
            if used is not None:
                break
            more *= 2
        self.encoded += sum(map(len, cuts))
        counts = [len(self.vocab.memo[p]) for p in cuts]
        tail_block, tail = seen[used - 1] if used else (block, at)
        rest = self._block(tail_block)
        joined = head[0][:at] + cuts + rest[0][tail:], head[1][:at] + counts + rest[1][tail:]
        for k in range(block + 1, tail_block + 1):
            self._set(k, ([], []))
        if len(joined[0]) <= 2 * BLOCK:
            self._set(block, joined)
            return
        parts = [(joined[0][k : k + BLOCK], joined[1][k : k + BLOCK]) for k in range(0, len(joined[0]), BLOCK)]
        sums = [self.chars[self.size : self.size + len(self.blocks)], self.tokens[self.size : self.size + len(self.blocks)]]
        own = [[sum(map(len, p[0])) for p in parts], [sum(p[1]) for p in parts]]
        sums = [np.concatenate([s[:block], o, s[block + 1 :]]) for s, o in zip(sums, own)]
        self.blocks[block : block + 1] = parts
        full = [k for k, b in enumerate(self.blocks) if (b if isinstance(b, range) else b[0])]
        self.blocks = [self.blocks[k] for k in full]
        self._build(*(s[full] for s in sums))


def count(docs: DataFrame, edits: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens_before, n_edits, tokens_after, counts, chars_encoded, chars_after): `counts` after each edit.

    edits: (doc_id, seq, start, end, replacement).  A document meets its edits by a join on the id, so no task holds
    more than one document's edits beside it.
    """
    item = F.struct("seq", "start", "end", F.coalesce("replacement", F.lit("")).alias("replacement"))
    lists = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(item)).alias("edits"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return applied(own.join(lists, "doc_id", "left"), path)


def applied(rows: DataFrame, path: str, trees: bool = False) -> DataFrame:
    """As `count`, from rows (doc_id, text, edits) that hold their own edits in order.

    With `trees` each row also has the text after the edits and its tree: piece_lengths and piece_tokens.  Rows that
    have these two columns start from them: a later batch of edits encodes nothing but what it touches.
    """
    known = {"piece_lengths", "piece_tokens"} <= set(rows.columns)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            out, after = [], []
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for text, edits, *state in zip(*columns):
                tree = TokenTree(text or "", vocab, *(state if known and state[0] is not None else ()))
                before, counts, read = tree.n_tokens, [], tree.encoded
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                    counts.append(tree.n_tokens)
                out.append((before, len(counts), tree.n_tokens, counts, tree.encoded - read, tree.n_chars))
                if trees:
                    after.append((tree.text(), *tree.state()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            made = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            if trees:
                made += [pa.array([a[k] for a in after], t) for k, t in enumerate([pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    schema = "doc_id long, tokens_before long, n_edits long, tokens_after long, counts array<long>, chars_encoded long, chars_after long"
    if trees:
        schema += ", text string, piece_lengths array<int>, piece_tokens array<int>"
    names = [c.split()[0] for c in schema.split(", ")]
    checked(vocabulary(path))
    return rows.select("doc_id", "text", "edits", *(["piece_lengths", "piece_tokens"] if known else [])).mapInArrow(run, schema)
