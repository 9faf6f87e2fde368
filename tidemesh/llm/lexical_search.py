"""Operator 13: ranked lexical search with block-max pruning.

`build` turns every document into a row of a forward index (its terms that are asked for, with their counts), packs
neighbouring rows into document-range blocks, and keeps beside each block the largest gain of every term in it.
`search` bounds a query's score in a block by these maxima, takes the blocks in the order of their bounds, and scores
the forward rows of a block until the bound drops below the threshold.  A first pass scores only the best block of each
group and gives every query a threshold: the k-th best score found anywhere.  The second pass starts from it, raises it
as it finds better documents, and returns at most k documents a query and task, which Spark ranks.  A block is left out
only if its bound is below the threshold, so ties are never lost.

All scores are 64-bit integers: the gain of a term in a document is (1000000000 tf) div (1000 tf + 8 m), with
m = 25 + (75 n N) div L, and its weight floor(1000 ln((2N + 2) / (2 df + 1))).

Documents never move: blocks are stretches of a scan, so no key can be hot.  What is broadcast is a batch of at most
`batch` distinct query texts with their terms, whatever the documents hold.  A larger query set is asked batch by batch.

Defined results: null and empty texts have no terms and are never found, but every row counts as given; a null or empty
query has no rows; rows with one doc_id are documents of their own, a null doc_id ranks behind all ids of its score;
repeated queries each get their rows; texts of any length are taken whole; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, saved, scratch


@dataclass(frozen=True)
class Settings:
    #: Documents in a block, and blocks whose bounds are sorted together.
    block: int = 64
    group: int = 256
    #: Distinct query texts that are asked in one go.
    batch: int = 4096


def _fold() -> bytes:
    """Letters in lower case, bytes of no term as blanks, all others as they are."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


FOLD = _fold()


def terms_of(data: bytes) -> list[bytes]:
    # after folding, the blank is the only ASCII white space left
    return data.translate(FOLD).split()


@dataclass
class Index:
    blocks: DataFrame
    terms: dict[bytes, int]
    #: By term number, for the terms that a document has; 0 for others.
    weights: np.ndarray
    documents: int


_ROWS = "docs array<long>, lengths array<long>, starts array<int>, terms array<int>, counts array<long>"
_BLOCKS = "docs array<long>, starts array<int>, terms array<int>, gains array<long>, top_terms array<int>, top_gains array<long>"


def _list(values, kind) -> pa.Array:
    """A column of one row."""
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def forward(docs: DataFrame, terms: dict[bytes, int], s: Settings = Settings()) -> DataFrame:
    """Blocks of up to `block` documents in the order of the scan: ids, lengths, where each one's terms start, terms, counts.
    Documents without any term are not in it."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number = known.value

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        if text and (found := terms_of(text)):
                            yield doc, len(found), Counter(filter(number.__contains__, found))

        stream = rows()
        while some := list(islice(stream, s.block)):
            starts, flat, counts = [0], [], []
            for _, _, found in some:
                flat += map(number.__getitem__, found)
                counts += found.values()
                starts.append(len(flat))
            columns = [_list([r[0] for r in some], pa.int64()), _list([r[1] for r in some], pa.int64()), _list(starts, pa.int32()), _list(flat, pa.int32()), _list(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["docs", "lengths", "starts", "terms", "counts"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _ROWS)


def _numpy(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The lists of a column as arrays, without copies."""
    lists = batch.column(k)
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def gains_of(lengths: list[int], counts: np.ndarray, starts: np.ndarray, documents: int, size: int) -> np.ndarray:
    m = np.array([25 + 75 * n * documents // size for n in map(int, lengths)], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, np.diff(starts)))


def build(docs: DataFrame, terms: list[bytes], s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents for the given terms; N, L and df are counted over all of them."""
    number = {t: k for k, t in enumerate(terms)}
    rows = saved(forward(narrow(docs, id_col, text_col), number, s))
    n, size = rows.select(F.explode("lengths").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # one row a query term
        df[r.t] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)

    def run(batches):
        for batch in batches:
            for k, (lengths, starts, flat, counts) in enumerate(zip(*(_numpy(batch, c) for c in range(1, 5)))):
                gains = gains_of(lengths, counts, starts, n, size)
                order = np.lexsort((gains, flat))
                last = np.flatnonzero(np.diff(flat[order], append=-1))
                one = batch.slice(k, 1)
                columns = [one.column(0), one.column(2), one.column(3), _list(gains, pa.int64()), _list(flat[order][last], pa.int32()), _list(gains[order][last], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["docs", "starts", "terms", "gains", "top_terms", "top_gains"])

    blocks = saved(rows.mapInArrow(run, _BLOCKS)) if n else rows.sparkSession.createDataFrame([], _BLOCKS)
    return Index(blocks, number, weights, n)


class _Queries:
    """A batch of queries: for each its terms' numbers and weights, repeats counted into the weights."""

    def __init__(self, texts: list[bytes], index: Index):
        self.starts, flat, weights = [0], [], []
        for text in texts:
            for t, times in Counter(terms_of(text)).items():
                flat.append(index.terms[t])
                weights.append(times * int(index.weights[flat[-1]]))
            self.starts.append(len(flat))
        self.terms, self.weights, self.size = np.array(flat, np.int64), np.array(weights, np.int64), len(index.terms)

    def bounds(self, block) -> np.ndarray:
        best = np.zeros(self.size, np.int64)
        best[block[4]] = block[5]
        sums = np.concatenate([[0], np.cumsum(self.weights * best[self.terms])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def scores(self, q: int, block, weight: np.ndarray) -> np.ndarray:
        """Of all documents of a block; `weight` is an array of zeros and is one again afterwards."""
        own = slice(self.starts[q], self.starts[q + 1])
        weight[self.terms[own]] = self.weights[own]
        sums = np.concatenate([[0], np.cumsum(weight[block[2]] * block[3])])
        weight[self.terms[own]] = 0
        return sums[block[1][1:]] - sums[block[1][:-1]]


def _best(found: list[tuple], k: int) -> list[tuple]:
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def scan(index: Index, asked, k: int, floors: list[int] | None, s: Settings) -> DataFrame:
    """(q, doc_id, score): up to k of the best documents of every query in each task.  Without floors only the best block
    of a group is scored.  asked: a broadcast _Queries."""

    def run(batches):
        queries = asked.value
        weight = np.zeros(queries.size, np.int64)
        best: dict[int, list[tuple]] = {}

        def blocks():
            for batch in batches:
                docs = batch.column(0).to_pylist()
                yield from zip(docs, *(_numpy(batch, c) for c in range(1, 6)))

        stream = blocks()
        while held := list(islice(stream, s.group)):
            bounds = np.stack([queries.bounds(b) for b in held])
            order = np.argsort(-bounds, axis=0, kind="stable")
            for q in range(bounds.shape[1]):
                mine = best.get(q, [])
                for j in order[: None if floors else 1, q]:
                    least = max(1, floors[q] if floors else 0, mine[-1][0] if len(mine) == k else 0)
                    if bounds[j, q] < least:
                        break
                    scores = queries.scores(q, held[j], weight)
                    hits = np.flatnonzero(scores >= least)
                    if len(hits):
                        mine = _best([*mine, *((int(scores[i]), held[j][0][i]) for i in hits)], k)
                if mine:
                    best[q] = mine
        rows = [(q, doc, score) for q, found in best.items() for score, doc in found]
        for at in range(0, len(rows), 10000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10000]), (pa.int32(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])

    return index.blocks.mapInArrow(run, "q int, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, texts: list[str], k: int = 10, s: Settings = Settings()) -> DataFrame:
    """(q, rank, doc_id, score): the k best documents of each text, q being its place in the list."""
    spark = index.blocks.sparkSession
    asked = spark.sparkContext.broadcast(_Queries([t.encode() for t in texts], index))
    first = _ranked(scan(index, asked, k, None, s), k).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = [0] * len(texts)
    for q, least in first.where(F.col("n") == k).select("q", "least").collect():  # one row a query of this batch
        floors[q] = least
    return _ranked(scan(index, asked, k, floors, s), k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, s: Settings = Settings(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of `items` its k best documents with a score above 0."""
    items = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    texts = items.select("text").distinct()
    groups = -(-texts.count() // s.batch)
    out = []
    with scratch() as tables:
        for g in range(groups):
            some = texts.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g)
            some = sorted(r.text for r in some.collect())  # about `batch` of them
            index = build(docs, sorted({t for x in some for t in terms_of(x.encode())}), s)
            names = items.sparkSession.createDataFrame(list(enumerate(some)), "q int, text string")
            out.append(tables.keep(saved(search(index, some, k, s).join(names, "q").select("text", "rank", "doc_id", "score"))))
    found = items.sparkSession.createDataFrame([], "text string, rank int, doc_id long, score long")
    for rows in out:
        found = found.unionByName(rows)
    return items.join(found, "text").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
q AS (
  SELECT row_number() OVER () AS k, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
asked AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(words) AS term FROM q) GROUP BY ALL),
size AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_words FROM d WHERE len(words) > 0),
held AS (
  SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), size),
gains AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words)) AS g FROM held, size),
scored AS (
  SELECT k, item_id, r, doc_id, sum(times * w * g)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN gains USING (term) GROUP BY k, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST, r))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
