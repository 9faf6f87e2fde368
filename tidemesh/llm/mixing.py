"""Operator 5: mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets the key -ln(u) / w, where u comes from a hash of its id and text and w is its quality weight; taking
documents by rising key is weighted sampling without replacement.  A source whose target holds k complete
epochs is taken k times whole; the rest of its target is filled by rising key, up to the document whose middle
still lies inside.  So the words taken differ from the target by at most half of one document.

The prefix sums are made in three steps: keys fall into buckets of a fraction of an octave, which hold at most 0.4 % of
a source whatever its weights, bucket sums are added up per source, the one bucket in which a source's target ends is
cut again in the same way, and only one of its parts is sorted by row.  A source that holds a third of all rows is so
spread over all tasks.

Defined results: a null or empty text has size 0; very long texts are read whole; a null source is a source of its own,
the last; a null weight, or one not above 0, comes after all others, by its hash; a null id is an id like others; rows
alike in source, id and text are numbered, so that the target may end between them; extra columns are kept by `mix`,
whatever their names, and ignored by `decide`; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, scratch


@dataclass(frozen=True)
class Settings:
    #: Weights of the sources in code-point order, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: No target is above this many times its source's size.
    most_epochs: int = 3
    #: Buckets an octave of the key, and parts of a bucket.
    buckets: int = 64
    parts: int = 1024
    seed: str = "mix-1"


WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of characters that are no markup symbols, at least 0.05; 1 for empty texts."""
    n = F.length(text)
    share = F.when(n > 0, (n - F.length(F.translate(text, "#*$%&|<>", ""))) / n)
    return F.when(share.isNull(), 1.0).otherwise(F.greatest(1 - share, F.lit(0.05)))


def _digest(text: Column) -> Column:
    """60 bits of the text's MD5 hash."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _uniform(doc_id: Column, digest: Column, seed: str) -> Column:
    """In (0, 1): 52 bits of an MD5 hash of seed, id and text."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), digest.cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def measured(docs: DataFrame, weight: Column | None = None, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, src, size, digest, key, bucket, part): what the sampling needs of each document, without its text."""
    return _keyed(docs.select(*_base(weight, id_col, text_col, source_col)), s)


def _base(weight: Column | None, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`").cast("string")
    weight = quality_weight(text) if weight is None else weight
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size_of(text).alias("size"), _digest(text).alias("digest"), weight.cast("double").alias("w")]


def _keyed(base: DataFrame, s: Settings) -> DataFrame:
    base = base.withColumn("u", _uniform(F.col("doc_id"), F.col("digest"), s.seed)).withColumn("key", F.when(F.col("w") > 0, -F.log("u") / F.col("w")).otherwise(F.lit(float("inf"))))
    # 's' and the name for a source, 'z' for none: sorts by code point with none last
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z"))
    last = F.col("key") == float("inf")
    place = F.when(last, F.lit(1e6) + F.col("u")).otherwise(F.log2("key") * s.buckets)
    base = base.withColumns({"src": src, "place": place, "key": F.when(last, F.lit(1e300) + F.col("u") * 1e299).otherwise(F.col("key"))})
    part = F.floor((F.col("place") - F.floor("place")) * s.parts).cast("int")
    return base.withColumns({"bucket": F.floor("place").cast("int"), "part": part}).drop("w", "u", "place")


def _ending(sums: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """The first row of each source, by `by`, whose prefix sum reaches the rest; `offset` is the sum before it."""
    until = F.col("offset") + F.sum("words").over(Window.partitionBy("src").orderBy(by))
    prefix = sums.join(ends, "src").withColumn("until", until)
    first = prefix.where(F.col("until") >= F.col("rest")).groupBy("src").agg(F.min(F.struct(by, (F.col("until") - F.col("words")).alias("offset"), "rest")).alias("end"))
    return first.select("src", F.col(f"end.{by}").alias(by), F.col("end.offset").alias("offset"), F.col("end.rest").alias("rest"))


def plan(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row a source: src, source_size, target, epochs, the last group of rows alike that the fractional epoch takes,
    how many of them it takes and how many there are.

    rows: what `measured` returns; it is read several times, so pass a written table.
    """
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    sources = sums.groupBy("src").agg(F.sum("words").alias("source_size"))
    # From here to the targets there is one row a source.
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("src")) - 1)
    weights = F.element_at(F.array(*map(F.lit, s.weights)), (F.col("rank") % len(s.weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weights).withColumn("cap", F.col("source_size") * s.most_epochs)
    # Shares by weight, stopped at the caps: sources stop in the order cap / weight, and the level after k stops is
    # (all words - their caps) / (weights of the rest).  The first level that stops no other source holds.
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "over": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    level = level.withColumn("stops", F.col("cap") * F.col("over") < F.col("left") * F.col("weight"))
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("src"), F.col("left"), F.col("over")))).over(everything)
    level = level.withColumn("at", first)
    share = (F.col("at.left") * F.col("weight")).cast("double") / F.col("at.over")
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = level.withColumn("target", target).withColumn("epochs", epochs)
    targets = targets.select("src", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    ends = _ending(sums, targets.select("src", "rest", F.lit(0).cast("long").alias("offset")), "bucket")
    inside = rows.join(ends, ["src", "bucket"])
    parts = inside.groupBy("src", "part").agg(F.sum("size").alias("words"))
    within = _ending(parts, ends.drop("bucket"), "part").join(ends.select("src", "bucket"), "src")
    alike = rows.join(within, ["src", "bucket", "part"]).groupBy("src", "key", "doc_id", "digest", "size", "offset", "rest").agg(F.count("*").alias("copies"))
    before = F.col("offset") + F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("src").orderBy("key", "doc_id", "digest")) - F.col("size") * F.col("copies")
    fits = F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)
    fits = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("rest"), F.col("copies")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("copies"), fits)))
    taken = alike.withColumn("before", before).withColumn("fits", fits.cast("long")).where("fits > 0")
    last = taken.groupBy("src").agg(F.max(F.struct("key", "doc_id", "digest", "fits", "copies")).alias("last"))
    last = last.select("src", F.struct("last.key", "last.doc_id", "last.digest").alias("last"), F.col("last.fits").alias("fits"), F.col("last.copies").alias("copies"))
    out = targets.join(within.select("src", "bucket", "part"), "src", "left").join(last, "src", "left")
    return out.select("src", "source_size", "target", "epochs", F.struct("bucket", "part").alias("end"), "last", "fits", "copies")


def _times(rows: DataFrame, chosen: DataFrame, s: Settings) -> DataFrame:
    """The rows beside their source's plan, with `times`: how often each is taken."""
    rows = rows.join(chosen, "src")
    at, own = F.struct("bucket", "part"), F.struct("key", "doc_id", "digest")
    within = (at < F.col("end")) | ((at == F.col("end")) & F.coalesce(own <= F.col("last"), F.lit(False)))
    extra = F.coalesce(within, F.lit(False)) & (F.col("epochs") < s.most_epochs)
    times = lambda c: (F.col("epochs") + F.when(c, 1).otherwise(0)).cast("long")
    if chosen.where("fits < copies").isEmpty():
        return rows.withColumn("times", times(extra))
    # The target of some source ends between rows alike: these are numbered, by task.
    cut = F.coalesce(own.eqNullSafe(F.col("last")) & (F.col("fits") < F.col("copies")), F.lit(False))
    some = rows.where(cut).withColumn("lane", F.spark_partition_id())
    lanes = some.groupBy("src", "lane").agg(F.count("*").alias("n"))
    lanes = lanes.withColumn("before", F.sum("n").over(Window.partitionBy("src").orderBy("lane")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("src", "lane").orderBy("key"))
    some = some.withColumn("number", number).join(lanes, ["src", "lane"]).withColumn("times", times(extra & (F.col("before") + F.col("number") <= F.col("fits"))))
    return rows.where(~cut).withColumn("times", times(extra)).unionByName(some.drop("lane", "number", "before"))


def decide(docs: DataFrame, weight: Column | None = None, s: Settings = Settings()) -> DataFrame:
    """(doc_id, size, source_size, target, times, taken) of every document.

    The narrow rows are written once.  The plan has one row a source, so Spark broadcasts it where it is under the
    session's threshold; otherwise the join is by source and the hot source is split by adaptive execution.
    """
    rows = saved(measured(docs, weight, s))
    chosen = _times(rows, saved(plan(rows, s)), s)
    return chosen.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weight: Column | None = None, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: each row of `docs`, all its columns, as often as the mix takes it.  The texts are not shuffled."""
    with scratch() as tables:
        chosen = tables.keep(saved(plan(saved(measured(docs, weight, s, id_col, text_col, source_col)), s)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_base(weight, id_col, text_col, source_col))
    kept = _times(_keyed(packed, s), chosen, s).where("times > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, COALESCE('s' || source, 'z') AS src,
    CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CASE WHEN COALESCE(length(text), 0) = 0 THEN 1.0
      ELSE greatest(1 - CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS DOUBLE) / length(text), 0.05) END AS w,
    CAST('0x' || substr(md5(COALESCE(text, '')), 1, 15) AS BIGINT) AS digest
  FROM documents),
keyed AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(digest AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / w AS k
  FROM base),
sources AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM base GROUP BY src),
levels AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - COALESCE(sum(3 * source_size) OVER o, 0) AS rest_words,
    sum(weight) OVER () - COALESCE(sum(weight) OVER o, 0) AS rest_weight,
    row_number() OVER (ORDER BY 3.0 * source_size / weight, src) AS nth
  FROM sources WINDOW o AS (ORDER BY 3.0 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT rest_words, rest_weight FROM levels WHERE NOT cap * rest_weight < rest_words * weight ORDER BY nth LIMIT 1),
targets AS (
  SELECT src, source_size,
    least(CAST(cap AS DOUBLE), CAST(held.rest_words * weight AS DOUBLE) / CAST(held.rest_weight AS DOUBLE)) AS target
  FROM levels, held),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
summed AS (
  SELECT keyed.*, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY keyed.src ORDER BY k, doc_id, digest ROWS UNBOUNDED PRECEDING) AS until
  FROM keyed JOIN epochs ON keyed.src = epochs.src)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN epochs < 3 AND until - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM summed
"""
