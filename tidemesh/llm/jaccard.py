"""Operator 10: n-gram Jaccard join, size-aware: light sets enumerate fixed-size subsets, heavy sets scan inverted lists.

A document's set holds its distinct word shingles (as 64-bit hashes).  Two sets of a and b shingles with Jaccard
similarity of at least t share at least o(a, b) = ceil(t / (1 + t) * (a + b)) of them, so:

* light sets (at most x shingles) enumerate their subsets of every size o that a light partner can require.  Two
  light sets with a common subset of size o >= o(a, b) are compared;
* heavy sets, and light ones that a heavy one can match, post a prefix of n - ceil(t n) + 1 shingles to inverted
  lists, rarest first.  Two linked sets share a posted shingle, whatever the order.  The order is by exact counts over
  all documents: hashes meet by bucket, packed as arrays; those that several sets have go back to their documents, and
  all others need not be posted.  Shingles that more than one in 256 documents has are found by a sketch of fixed size
  before; they come last in the order, so no bucket holds them.  A pair is only made where it can be its first common
  shingle: at places i and j of the order, both a - i and b - j must still reach o(a, b);
* x has the lowest cost: subset rows below it against posted rows and expected comparisons above it, from the
  counts of set sizes and the mean list length of all texts.

Lists need not be expanded into pairs.  In a list sorted by size, each set is compared with the first and with
those just before it; the texts of compared pairs are then verified exactly, on the words themselves.  In lists
longer than that, documents that are still in different components are compared with a few pivots of the list, and
those that are then still apart in full, so no link between components is lost.  Before any text is moved, pairs are
held against a parity bitmap of each set: two bitmaps differ in no more bits than the sets differ in elements, so too
many differing bits exclude a link.  Identical sets are joined to one of them before any posting, inside each task.

Defined results: null and empty texts, and texts without words, have no shingles and no links; fewer words than a
shingle make one shingle of them all; rows with the same id are one node of the graph and each keeps its own row and
set; a null id is its own row without a component; very long texts are read whole; ties go to the smaller id; extra
columns are ignored by `join` and kept by `dedup`, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, narrow, saved, scratch, texts_of


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Similarity as a fraction: 75 / 100.
    above: int = 75
    below: int = 100
    #: The largest size that the cost may choose as light.
    most_light: int = 14
    #: Counters of the sketch that finds very frequent shingles: 2**bits.
    bits: int = 18
    #: A shingle is very frequent when more than one in `hot_share` sets has it, and more than `least_hot` have.
    hot_share: int = 256
    least_hot: int = 4096
    #: Shingles are counted in buckets of about so many, and documents post in groups of about so many.
    bucket_rows: int = 1 << 19
    #: So many shingles are packed at a time.
    packed_rows: int = 1 << 18
    group_docs: int = 4096
    #: A list is compared in full up to this many sets; longer ones against the first and the previous set.
    full: int = 6
    #: A posted shingle expected in more documents than this is dealt over several tasks.
    rows_a_task: int = 4096
    #: Rounds in which long lists are compared with pivots only, each with other ones, and the pivots of a list.
    rounds: int = 3
    pivots: int = 3
    #: Sets that a verifying task keeps hold so many shingles together, besides those of the pair at hand.
    kept_shingles: int = 1 << 17

    def overlap(self, both: int) -> int:
        """Smallest common size of two sets with `both` elements together."""
        return -(-self.above * both // (self.above + self.below))

    def first_common(self, m, i, n, j):
        """Whether sets of m and n elements can be similar if their first common element is at places i and j of the
        order; for numbers and columns."""
        least = self.above * (m + n)
        both = self.above + self.below
        return (both * (m - i) >= least) & (both * (n - j) >= least)

    def may_link(self, a: str, b: str):
        """Whether two documents' sizes and bitmaps (columns n_a, sig_a, n_b, sig_b) leave a link possible."""
        differ = sum((F.bit_count(F.col("sig_" + a)[i].bitwiseXOR(F.col("sig_" + b)[i])) for i in range(_BITS // 64)), F.lit(0))
        near = differ * (self.above + self.below) <= (F.col("n_" + a) + F.col("n_" + b)) * (self.below - self.above)
        return F.coalesce(near, F.lit(True))

    def prefix(self, n: int) -> int:
        return n - -(-self.above * n // self.below) + 1

    def subset_sizes(self, n: int, light: int) -> range:
        least = -(-self.above * n // self.below)
        most = min(light, self.below * n // self.above)
        return range(self.overlap(n + least), min(n, self.overlap(n + most)) + 1)


_MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, k: int = 5) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def hashed(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = h[i : i + n] * np.uint64(_MULTIPLY[i % 8])
        out = (out ^ (mixed ^ (mixed >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(i)
    return np.unique(out ^ (out >> np.uint64(32)))


_BLOCKS = 64

#: Bits of a set's bitmap.
_BITS = 512

#: Bytes of a key besides the bits that its bucket tells.
_REST = 5


def bitmap(hashes: np.ndarray) -> bytes:
    """Bit i says whether an odd number of the set's hashes fall on i."""
    falls = np.bincount((hashes % np.uint64(_BITS)).astype(np.int64), minlength=_BITS)
    return np.packbits(falls & 1).tobytes()


def _sketch(docs: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(counter of each slot, number of sets of each size up to most_light, of larger ones, and of all shingles): fixed
    sizes, whatever the input.  Equal sets of one task count once.  Tasks are added up in two steps."""
    width = (1 << s.bits) // _BLOCKS

    def count(batches):
        slots, sizes, seen = np.zeros(1 << s.bits, np.int64), np.zeros(s.most_light + 3, np.int64), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [hashed(t, s.words) for t in texts_of(batch.slice(at, 512))]
                sets = [x for x in sets if (d := xxhash.xxh3_128_digest(x.tobytes())) not in seen and not seen.add(d)]
                if sets:
                    np.add.at(sizes, np.minimum([len(x) for x in sets], s.most_light + 1), 1)
                    slots += np.bincount((np.concatenate(sets) >> np.uint64(64 - s.bits)).astype(np.int64), minlength=1 << s.bits)
        if sizes.any():
            sizes[-1] = slots.sum()
            blocks = slots.reshape(_BLOCKS, width)
            data = [b.tobytes() for b in blocks] + [sizes.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS + 1), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = 0, 0
        for batch in batches:
            block = batch.column("block")[0].as_py()
            for data in batch.column("data"):
                total = total + np.frombuffer(data.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    parts = docs.select("text").mapInArrow(count, "block int, data binary").withColumn("lane", F.spark_partition_id() % 64)
    lanes = parts.groupBy("block", "lane").applyInArrow(add, "block int, data binary")
    rows = lanes.groupBy("block").applyInArrow(add, "block int, data binary").collect()
    found = {r.block: np.frombuffer(r.data, np.int64) for r in rows}
    if not found:
        return np.zeros(1 << s.bits, np.int64), np.zeros(s.most_light + 3, np.int64)
    return np.concatenate([found[k] for k in range(_BLOCKS)]), found[_BLOCKS]


@dataclass
class Order:
    """What every task knows: the slots of very frequent shingles with their counts, the light boundary, and how many
    buckets keys and groups documents are dealt into.  Its size is fixed."""

    hot: np.ndarray
    light: int
    key_bits: int
    groups: int
    settings: Settings

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The leading bits of the hashes.  Shingles may share a key: then they count as one, and both stay in the set."""
        return hashes >> np.uint64(64 - 8 * _REST - self.key_bits)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.settings.bits)).astype(np.int64)


def _order(docs: DataFrame, s: Settings) -> Order:
    slots, sizes = _sketch(docs, s)
    sets, total = int(sizes[:-1].sum()), int(sizes[-1])
    above = np.maximum(0, slots - slots.mean()).astype(np.int64)
    # Sets share at most `rare` of a slot's shingles, or it is hot: then its shingles are not counted one by one.
    rare = max(s.least_hot, sets // s.hot_share)
    # Expected length of a posted list: what a slot has above chance, averaged over the shingles.
    mean_list = float((slots * (1 + np.maximum(0, above - 4 * np.sqrt(slots.mean())))).sum() / max(1, slots.sum()))
    best, light, saved_cost = 0.0, 0, 0.0
    for n in range(1, s.most_light + 1):
        subsets = sum(_choose(n, o) for o in s.subset_sizes(n, n))
        saved_cost += float(sizes[n]) * (s.prefix(n) * (1 + mean_list) - subsets)
        if saved_cost > best:
            best, light = saved_cost, n
    key_bits = min(64 - 8 * _REST, max(0, (total // s.bucket_rows).bit_length()))
    return Order(np.where(above > rare, above, 0), light, key_bits, 1 + sets // s.group_docs, s)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


#: Kinds of rows: a document with its twin (an earlier one of its task with the same set, or itself); keys with the
#: documents that have them; frequent keys of documents.  Kind 0 is a posted key, o > 0 the hash of a subset of size o.
_DOCUMENT, _KEYS, _COUNTED = -2, -3, -4
_ROWS = "place int, kind int, key long, doc_id long, size long, data binary, docs binary, counts binary"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _spot(docs, groups: int) -> np.ndarray:
    """The group of each document id."""
    mixed = np.asarray(docs, np.int64).view(np.uint64) * np.uint64(_MULTIPLY[0])
    return ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _dealt(docs: DataFrame, order: Order) -> DataFrame:
    """Pass 1.  Every document as one row, with its size, bitmap and very frequent keys; its other keys, packed with those
    of other documents by bucket; and the subsets of light sets."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def packed(docs: list[int], sets: list[np.ndarray], order: Order):
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        place = (keys >> np.uint64(8 * _REST)).astype(np.uint16 if order.key_bits <= 16 else np.uint32)
        at = np.argsort(place, kind="stable")
        keys, owner, place = keys[at], owner[at], place[at].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ids = np.array(docs, np.int64)
        for a, b in zip(begin, [*begin[1:], len(keys)]):
            first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
            counts = np.diff(np.append(first, b - a)).astype(np.uint32)
            rest = keys[a:b].view(np.uint8).reshape(-1, 8)[:, :_REST]
            yield int(place[a]), _KEYS, 0, 0, 0, rest.tobytes(), ids[owner[a:b][first]].tobytes(), counts.tobytes()

    def run(batches):
        order = sent.value
        s = order.settings
        seen: dict[bytes, int] = {}
        ids, sets, waiting = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part)):
                    hashes = hashed(text, s.words)
                    n, digest = len(hashes), xxhash.xxh3_128_digest(hashes.tobytes())
                    new = n > 0 and digest not in seen
                    twin = seen.setdefault(digest, doc) if n else doc
                    spot = int(_spot([doc], order.groups)[0])
                    heavy, n_hot, tail = new and s.below * n >= s.above * (order.light + 1), 0, b""
                    if new:
                        if n <= order.light:
                            for o in s.subset_sizes(n, order.light):
                                for c in combinations(hashes.tolist(), o):
                                    key = xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes(), seed=o) - (1 << 63)
                                    out.append((spot, o, key, doc, n << 32, None, None, None))
                        if heavy:
                            heat, keys = order.hot[order.slots(hashes)], order.keys(hashes)
                            rare, hot = keys[heat == 0], keys[heat > 0]
                            n_hot = len(hot)
                            if len(rare):
                                ids.append(doc), sets.append(rare)
                                waiting += len(rare)
                            # the least frequent of the hot ones, as many as the prefix reaches
                            heat = heat[heat > 0]
                            first = np.lexsort((hot, heat))[: max(0, s.prefix(n) - len(rare))]
                            tail = np.stack([hot[first], heat[first].astype(np.uint64)]).tobytes()
                    out.append((spot, _DOCUMENT, twin, doc, n, bitmap(hashes), tail, np.array([n_hot, heavy], np.int64).tobytes() + digest))
                    if waiting >= s.packed_rows:
                        yield _batch([*packed(ids, sets, order)])
                        ids, sets, waiting = [], [], 0
                if out:
                    yield _batch(out)
        if ids:
            yield _batch([*packed(ids, sets, order)])

    return docs.mapInArrow(run, _ROWS)


def _by_place(rows: DataFrame) -> DataFrame:
    return rows.repartition("place").sortWithinPartitions("place", "kind")


def _groups(batches: Iterator[pa.RecordBatch], kinds: set[int]):
    """(place, rows of the kinds) for each place of sorted rows, and (None, batch) for all others as they come."""
    now, held = None, []
    for batch in batches:
        place, kind = (batch.column(k).to_numpy() for k in (0, 1))
        own = np.isin(kind, list(kinds))
        if not own.all():
            yield None, batch.filter(pa.array(~own))
        if own.any():
            batch, place = batch.filter(pa.array(own)), place[own]
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(place)]):
                if held and place[a] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(place[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _joined_bytes(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _counted(dealt: DataFrame, order: Order) -> DataFrame:
    """Pass 2, by bucket of keys: exact counts.  Keys that several sets have go back to their documents, packed by group
    of documents; keys of one set alone are not needed any more."""
    groups = order.groups

    def run(batches):
        for place, rows in _groups(batches, {_KEYS}):
            if place is None:
                yield rows
                continue
            rest = _joined_bytes(rows["data"], np.uint8).reshape(-1, _REST)
            keys = np.zeros((len(rest), 8), np.uint8)
            keys[:, :_REST] = rest
            keys = keys.view(np.uint64)[:, 0] | np.uint64(place << (8 * _REST))
            docs = np.repeat(_joined_bytes(rows["docs"], np.int64), _joined_bytes(rows["counts"], np.uint32))
            at = np.argsort(keys)
            keys, docs = keys[at], docs[at]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.repeat(length := np.diff(np.append(begin, len(keys))), length).astype(np.uint32)
            some = np.flatnonzero(counts > 1)
            if not len(some):
                continue
            spot = _spot(docs[some], groups)
            at = np.argsort(spot, kind="stable")
            some, spot = some[at], spot[at]
            cuts = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
            for k in range(0, len(cuts), 256):
                ends = [*cuts[k + 1 : k + 256], cuts[k + 256] if k + 256 < len(cuts) else len(some)]
                yield _batch([(int(spot[a]), _COUNTED, 0, 0, 0, keys[some[a:b]].tobytes(), docs[some[a:b]].tobytes(), counts[some[a:b]].tobytes()) for a, b in zip(cuts[k : k + 256], ends)])

    return _by_place(dealt).mapInArrow(run, _ROWS)


_POSTS = "kind int, key long, deal int, size long, doc_id long, sig binary"


def _posted(counted: DataFrame, order: Order) -> DataFrame:
    """Pass 3, by group of documents: what each document posts, the rarest keys first.

    (kind, key, deal, size, doc_id, sig): size is the set's size << 32 and the key's place in the order; deal is 0, or a
    part of a list that is dealt out.  In rows of kind _DOCUMENT key is the twin, size the set's size and sig its bitmap.
    An id of several different sets posts all it has, at the first place: then places exclude nothing.
    """

    def posts(rows: pa.Table, order: Order):
        s = order.settings
        told = rows.filter(pc.equal(rows["kind"], _DOCUMENT))
        yield [np.full(len(told), _DOCUMENT), told["key"].to_numpy(), np.zeros(len(told), np.int64), told["size"].to_numpy(), told["doc_id"].to_numpy(), told["data"].to_pylist()]
        more = rows.filter(pc.equal(rows["kind"], _COUNTED))
        keys, docs, counts = (_joined_bytes(more[c], t) for c, t in (("data", np.uint64), ("docs", np.int64), ("counts", np.uint32)))
        at = np.lexsort((keys, counts, docs))
        keys, docs, counts = keys[at], docs[at], counts[at]
        by_id: dict[int, list] = {}
        for doc, n, tail, end in zip(told["doc_id"].to_pylist(), told["size"].to_pylist(), told["docs"].to_pylist(), told["counts"].to_pylist()):
            n_hot, heavy = np.frombuffer(end[:16], np.int64).tolist()
            if heavy:
                by_id.setdefault(doc, []).append((n, n_hot, np.frombuffer(tail, np.uint64).reshape(2, -1)))
        for doc, sets in by_id.items():
            a, b = np.searchsorted(docs, doc), np.searchsorted(docs, doc, "right")
            for n, n_hot, hot in sets:
                own, often = np.concatenate([keys[a:b], hot[0]]), np.concatenate([counts[a:b], hot[1]]).astype(np.int64)
                places = np.zeros(len(own), np.int64)
                if len(sets) == 1:
                    alone = n - n_hot - (b - a)  # keys that no other set has come first
                    at = np.arange(min(len(own), max(0, s.prefix(n) - alone)))
                    own, often = own[: len(at)], often[: len(at)]
                    at[1:][own[1:] == own[:-1]] = 0  # a key that stands twice is at its first place
                    places = alone + np.maximum.accumulate(at)
                if len(own):
                    parts = (1 + often // s.rows_a_task).astype(np.uint64)
                    deal = np.where(parts > 1, 1 + np.uint64(xxhash.xxh3_64_intdigest(str(doc))) % parts, 0).astype(np.int64)
                    yield [np.zeros(len(own), np.int64), own.view(np.int64), deal, (n << 32) + places, np.full(len(own), doc), [None] * len(own)]

    def run(batches):
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _POSTS.split(", ")]

        def out(parts):
            columns = [pa.array(np.concatenate(c), k) for c, k in zip(list(zip(*parts))[:5], kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x for p in parts for x in p[5]], pa.binary())], names)

        for place, rows in _groups(batches, {_DOCUMENT, _COUNTED}):
            if place is None:
                yield out([[rows.column(1).to_numpy(), rows.column(2).to_numpy(), np.zeros(len(rows), np.int64), rows.column(4).to_numpy(), rows.column(3).to_numpy(), [None] * len(rows)]])
            else:
                yield out([*posts(rows, order)])

    return _by_place(counted).mapInArrow(run, _POSTS)


_PAIRS = "key long, a long, b long, size long, kind int"


def _scan_lists(postings: DataFrame, s: Settings) -> DataFrame:
    """From postings sorted by (kind, key, deal, size, doc_id): pairs to compare (kind 0) and the members of lists too long
    to be compared in full (kind -1).  A task remembers one list's first and latest sets."""

    def run(batches):
        now, members, names = None, [], ["key", "a", "b", "size", "kind"]
        for batch in batches:
            out: list[tuple] = []
            table = [batch.column(k).to_numpy() for k in range(5)]
            same = np.ones(len(table[0]), bool)
            if len(same) > 1:
                # rows alone in their list are passed over at once
                joined = (table[0][1:] == table[0][:-1]) & (table[1][1:] == table[1][:-1]) & (table[2][1:] == table[2][:-1])
                same[1:-1] = joined[:-1] | joined[1:] | (table[2][1:-1] > 0)  # but in a dealt list others are elsewhere
            for kind, key, deal, size, doc in zip(*(c[same].tolist() for c in table)):
                if (kind, key, deal) != now:
                    now, members, count = (kind, key, deal), [], 0
                count += 1
                if kind:
                    # all have one subset of size `kind`; a set too large beside the smallest is so beside all others
                    if members and (s.above + s.below) * kind >= s.above * ((members[0][0] >> 32) + (size >> 32)) and doc != members[0][1]:
                        out.append((0, members[0][1], doc, 0, 0))
                    members = members or [(size, doc)]
                    continue
                n, j = size >> 32, size & 0xFFFFFFFF
                short = count <= s.full and not deal  # a dealt list is long, whatever this part of it
                for m, d in members if short else {*members[:1], *members[-1:]}:
                    if d != doc and s.first_common(m >> 32, m & 0xFFFFFFFF, n, j):
                        out.append((0, d, doc, 0, 0))
                if not short:
                    if count == s.full + 1 and not deal:
                        out += [(key, d, d, m, -1) for m, d in members]
                    out.append((key, doc, doc, size, -1))
                if short or not members:
                    members.append((size, doc))
                else:
                    members[1:] = [(size, doc)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out))], names)

    return postings.mapInArrow(run, _PAIRS)


def _packed(texts: DataFrame) -> DataFrame:
    """Texts as compressed bytes: they cross the network up to three times."""

    def run(batches):
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = [compress((t or "").encode()) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "packed"])

    return texts.mapInArrow(run, "doc_id long, packed binary")


def _verified(pairs: DataFrame, packed: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose texts are similar, compared shingle by shingle."""
    one, two = (packed.select(F.col("doc_id").alias(x), F.col("packed").alias("text_" + x)) for x in "ab")

    def run(batches):
        known: OrderedDict = OrderedDict()
        held = 0
        unpack = zstandard.ZstdDecompressor().decompress

        def of(data):
            nonlocal held
            if data not in known:
                known[data] = shingles(unpack(data).decode(), s.words)
                held += len(known[data])
                while held > s.kept_shingles and len(known) > 1:
                    held -= len(known.popitem(last=False)[1])
            return known[data]

        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 256):
                for x, y in zip(*(map(of, batch.column(k).slice(at, 256).to_pylist()) for k in (2, 3))):
                    common = len(x & y)
                    good.append(common > 0 and s.below * common >= s.above * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _still_apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(parts.select(F.col("node").alias(x), F.col("label").alias("of_" + x)), x, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _sets(told: DataFrame) -> DataFrame:
    """(doc_id, n, sig) of each document; no bitmap where rows of one id have different sets."""
    one = F.min("sig") == F.max("sig")
    return told.groupBy("doc_id").agg(F.max("size").alias("n"), F.when(one, F.min("sig")).alias("sig"))


def _possible(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sizes and bitmaps leave a link possible."""
    columns = pairs.columns
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(x), F.col("n").alias("n_" + x), F.col("sig").alias("sig_" + x)), x)
    return pairs.where(s.may_link("a", "b")).select(columns)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _words(sig: Column) -> Column:
    """A bitmap as 64-bit numbers."""
    return F.array(*[F.conv(F.hex(F.substring(sig, 1 + 8 * k, 8)), 16, -10).cast("long") for k in range(_BITS // 64)])


def join(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the components of the graph of similar documents, one row a document."""
    every = narrow(docs, id_col, text_col)
    texts = every.where("doc_id is not null")
    with scratch() as tables:
        order = _order(texts, s)
        posted = saved(_posted(_counted(_dealt(texts, order), order), order))
        lists = posted.where(F.col("kind") >= 0).drop("sig").repartition("key", "deal").sortWithinPartitions("kind", "key", "deal", "size", "doc_id")
        found = saved(_scan_lists(lists, s))
        told = posted.where(F.col("kind") == _DOCUMENT).select("doc_id", F.col("key").alias("twin"), "size", _words(F.col("sig")).alias("sig"))
        twins = told.where("twin <> doc_id").select(F.col("twin").alias("a"), F.col("doc_id").alias("b"))
        sets = saved(_sets(told))
        compare = _ordered(found.where("kind = 0")).groupBy("a", "b").agg(F.count("*").alias("votes"))
        compare = saved(_possible(compare, sets, s))
        members = found.where("kind = -1").select("key", F.col("a").alias("doc_id"), F.col("size").bitwiseAND(0xFFFFFFFF).alias("at"))
        needed = compare.select(F.explode(F.array("a", "b")).alias("doc_id")).union(members.select("doc_id")).distinct()
        packed = saved(_packed(texts).join(needed, "doc_id", "left_semi"))
        # First each document against the one it shares most posted shingles with; then the pairs that are still apart.
        likely = compare.groupBy("b").agg(F.max(F.struct("votes", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
        likely = saved(likely)
        parts = saved(components(saved(_verified(likely, packed, s).unionByName(twins))))
        rest = saved(_still_apart(compare.join(likely, ["a", "b"], "left_anti"), parts))
        parts = _joined(parts, _verified(rest, packed, s))
        # Long lists: sets that are still apart are compared with pivots, then in full.
        members = members.distinct()
        for step in range(s.rounds + 1):
            apart = _mixed(members, parts)
            if apart.isEmpty():
                break
            pairs = _across(apart.join(sets, "doc_id"), s, None if step == s.rounds else step)
            pairs = saved(_ordered(pairs).distinct().join(compare, ["a", "b"], "left_anti"))
            parts = _joined(parts, _verified(pairs, packed, s))
            members = apart.drop("label")
        rows = told.select("doc_id", F.col("size").alias("n_shingles")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        rows = tables.keep(saved(rows.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))))
    return rows.unionByName(_without_id(every, s))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """`parts` (node, label) with further links: only the labels that these join meet in rounds, not all nodes again."""
    for x in "ab":
        links = links.join(parts.select(F.col("node").alias(x), F.col("label").alias("of_" + x)), x, "left").withColumn("of_" + x, F.coalesce("of_" + x, x))
    links = saved(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
    if links.isEmpty():
        return parts
    tied = saved(components(links))
    moved = parts.join(tied.select(F.col("node").alias("label"), F.col("label").alias("low")), "label", "left").select("node", F.coalesce("low", "label").alias("label"))
    return saved(moved.unionByName(tied.join(parts, "node", "left_anti")))


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of lists that hold several components, with their labels."""
    members = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    members = saved(members)
    mixed = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return saved(members.join(mixed, "key"))


def _across(apart: DataFrame, s: Settings, step: int | None) -> DataFrame:
    """Pairs (a, b) of lists that may link two components: of each member and the list's pivots of a step, or all.
    A pivot is the smallest member by a hash, found with map-side combine."""
    of = lambda rows, x, at: rows.select("key", F.col("label").alias("label_" + x), F.col("doc_id").alias(x), F.col("n").alias("n_" + x), F.col("at").alias(at), F.col("sig").alias("sig_" + x))
    other, differ = apart, F.col("label_a") < F.col("label_b")
    if step is not None:
        hashed = apart.withColumns({f"h{k}": F.xxhash64("doc_id", F.lit(step * s.pivots + k)) for k in range(s.pivots)})
        least = hashed.groupBy("key").agg(*[F.min(F.struct(f"h{k}", "doc_id", "at", "label", "n", "sig")).alias(f"p{k}") for k in range(s.pivots)])
        other = least.select("key", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"p{k}")[c].alias(c) for c in ("doc_id", "at", "label", "n", "sig")]) for k in range(s.pivots)]))).alias("p")).select("key", "p.*")
        differ = F.col("label_a") != F.col("label_b")
    pairs = of(apart, "a", "i").join(of(other, "b", "j"), "key").where(differ)
    return pairs.where(s.first_common(F.col("n_a"), F.col("i"), F.col("n_b"), F.col("j")) & s.may_link("a", "b")).select("a", "b")


def _without_id(texts: DataFrame, s: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes = [len(hashed(t, s.words)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(0)], ["doc_id", "n_shingles", "component_id"])

    return texts.where("doc_id is null").mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def dedup(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of the document with the smallest id in each group.  Rows alike in id and text are
    copies too: the first by all columns stays.  Rows without an id stay."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    groups = join(docs, s, id_col, text_col).where("doc_id is not null")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"), text.alias("text"))
    kept = own.join(gone, F.col("id") == F.col("doc_id"), "left_anti")
    many = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not many.isEmpty():  # only rows that repeat an id are grouped
        again = kept.join(many, F.col("id") == F.col("doc_id"), "left_semi").groupBy("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
        single = kept.join(many, F.col("id") == F.col("doc_id"), "left_anti").select("row")
        kept = single.unionByName(again.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return kept.select("row.*")
