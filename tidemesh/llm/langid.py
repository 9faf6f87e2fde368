"""Operator 7: language ID by multilingual mixture inference.

Training counts hashed character 1- to 3-grams of every labelled text.  A document is taken as a mixture of the
learned languages: expectation-maximisation estimates the proportions from n-gram likelihoods, and languages
are left out while that raises the likelihood less a penalty of half a logarithm of the n-gram count for each.

Defined results: `und` with score 0 and no languages where the text is null or has no letter, or where nothing was
learned; ties go to the first language by code point; every input row gives one output row, repeated ones and null ids
too; very long texts are counted whole, a piece at a time; extra columns are ignored; an empty table gives an empty
table; more languages than the settings allow are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrow, saved, scratch, texts_of


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    smoothing: float = 0.5
    rounds: int = 30
    tolerance: float = 1e-3
    #: The model has 2**bits numbers a language; more languages than this are an error, so its size is bounded.
    most_languages: int = 500
    #: Characters counted at a time; long texts take several turns and count whole.
    piece: int = 1 << 16


COLUMNS = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>, per_gram double"


def gram_counts(text: str, s: Settings) -> np.ndarray:
    """Counts of the hashed n-grams of the whole lower-cased text, letters only; others count as one space."""
    total = np.zeros(1 << s.bits, np.int64)
    before = np.empty(0, np.uint64)
    for at in range(0, len(text), s.piece):
        codes = np.frombuffer(text[at : at + s.piece].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        letters = (codes >= 128) | ((codes >= 97) & (codes <= 122))
        codes = np.concatenate([before, np.where(letters, codes, 32)])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])] if len(codes) else codes
        one = codes * np.uint64(0x9E3779B97F4A7C15)
        old, before = len(before), codes[-2:]  # the last two begin the next piece's n-grams, and are counted here alone
        grams = [one[old:][codes[old:] != 32]]
        if len(codes) > 1:
            two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
            grams.append(two[max(0, old - 1) :])
            if len(codes) > 2:
                grams.append(((two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:])[max(0, old - 2) :])
        for g in grams:
            total += np.bincount(((g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - s.bits)).astype(np.int64), minlength=1 << s.bits)
    return total


@dataclass
class Model:
    languages: list[str]
    #: likelihood[language, n-gram]
    likelihood: np.ndarray
    settings: Settings

    def shares(self, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of all languages (0 for those left out) and the mean log-likelihood of an n-gram."""
        seen = np.flatnonzero(counts)
        weights, table = counts[seen].astype(float), self.likelihood[:, seen]
        n = weights.sum()
        chosen = np.arange(len(table))
        share, fit = self._em(table, weights, np.full(len(table), 1 / len(table)))
        chosen = chosen[share > 1e-3]
        share, fit = self._em(table[chosen], weights, share[chosen] / share[chosen].sum())
        penalty = 0.5 * np.log(n)
        while len(chosen) > 1:
            out = int(np.argmin(share))
            rest = np.delete(chosen, out)
            begin = np.delete(share, out)
            fewer, less = self._em(table[rest], weights, begin / begin.sum() if begin.sum() > 0 else np.full(len(rest), 1 / len(rest)))
            if fit - less > penalty:
                break
            chosen, share, fit = rest, fewer, less
        full = np.zeros(len(table))
        full[chosen] = share
        return full, fit / n

    def _em(self, table: np.ndarray, weights: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        total = weights.sum()
        if len(share) == 1:
            return np.ones(1), float(weights @ np.log(table[0]))
        for _ in range(self.settings.rounds):
            mixed = share @ table
            new = share * (table @ (weights / mixed)) / total
            done = np.abs(new - share).max() < self.settings.tolerance
            share = new
            if done:
                break
        return share, float(weights @ np.log(share @ table))


def train(docs: DataFrame, lang: Column | str = "lang", id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> Model:
    """Counts all labelled texts, in one pass with map-side sums; the model (languages x 2**bits) comes to the driver."""
    label = F.col(lang) if isinstance(lang, str) else lang
    rows = docs.select(label.cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang_ not in sums:
                    if len(sums) >= s.most_languages:  # before a task holds more arrays than the model may have
                        raise ValueError(f"more than {s.most_languages} languages")
                    sums[lang_] = np.zeros(1 << s.bits, np.int64)
                sums[lang_] += gram_counts(text, s)
        for lang_, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "gram", "n"])

    with scratch():
        counted = saved(rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
        languages = counted.select("lang").distinct().limit(s.most_languages + 1).count()
        if languages > s.most_languages:
            raise ValueError(f"more than {s.most_languages} languages")
        # one row a language and block of n-grams, so that the driver gets few rows
        blocks = counted.groupBy("lang", F.expr("gram div 1024").alias("block")).agg(F.collect_list(F.struct("gram", "n")).alias("grams")).collect()
        languages = sorted({r.lang for r in blocks}, key=lambda x: x.encode())
    table = np.zeros((len(languages), 1 << s.bits))
    for r in blocks:
        row = table[languages.index(r.lang)]
        for gram, n in r.grams:
            row[gram] += n
    table += s.smoothing
    return Model(languages, table / table.sum(axis=1, keepdims=True), s)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's language set with shares, its main language and that one's share; no shuffle."""
    return _predicted(narrow(docs, id_col, text_col), model, T.StructType.fromDDL(COLUMNS), texts_of)


def spoken(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language, so whose lang_pred is not `und`.  Rows are not joined
    by an id, so repeated and null ids do not matter."""
    at = docs.columns.index(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL(COLUMNS).fields[1:]])
    found = _predicted(packed, model, schema, lambda batch: batch.column(0).field(at).cast(pa.string()).to_pylist())
    return found.where("lang_pred <> 'und'").select("row.*")


def _predicted(rows: DataFrame, model: Model, schema: T.StructType, texts) -> DataFrame:
    """The first column of `rows` with the prediction for the texts of each batch."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        names = known.languages
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            lang, score, sets, fits = [], [], [], []
            for text in texts(batch):
                if not names or not text or not any(map(str.isalpha, text)):
                    lang.append("und"), score.append(0.0), sets.append([]), fits.append(None)
                    continue
                share, fit = known.shares(gram_counts(text, known.settings))
                best = int(np.argmax(share))
                lang.append(names[best]), score.append(min(1.0, float(share[best]))), fits.append(float(fit))
                sets.append([{"lang": names[k], "share": float(share[k])} for k in np.argsort(-share, kind="stable") if share[k] > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind), pa.array(fits, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
