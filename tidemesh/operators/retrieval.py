"""Routing, retrieval of evidence edges, and the guardrail over claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved

# The words that route a query and that block an answer.
PREDICT = ["predict", "likely", "will", "전이", "예측"]
INTERVENE = ["intervene", "change", "what if", "개입", "바꾸"]
BLOCKED = ["personality", "성격", "motivation", "동기", "가치관"]
#: Evidence edges of an answer.
EVIDENCE = 8
# Fixed value: the uncertainty of a description.
DESCRIBED = 0.2


def has_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def route(text: Column, query_type: Column | None = None) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    by_text = F.when(has_any(low, PREDICT), "predict").when(has_any(low, INTERVENE), "intervene").otherwise("describe")
    return by_text if query_type is None else F.when(F.coalesce(query_type, F.lit("")) != "", query_type).otherwise(by_text)


def blocked_by(text: Column) -> Column:
    """The first blocked word of the list that the text contains, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.contains(w), w) for w in BLOCKED])


def local(edges: DataFrame, query: str, limit: int = EVIDENCE) -> DataFrame:
    """Edges by the number of query terms that their words contain; edges without any are left out."""
    terms = list(dict.fromkeys(query.lower().split()))
    words = F.lower(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), "layer", F.lit("{}")))
    score = sum((words.contains(t).cast("int") for t in terms), F.lit(0))
    scored = edges.withColumn("score", score)
    return (scored.where("score > 0") if terms else scored).orderBy(F.desc("score"), "ord").limit(limit)


def answer(claims: DataFrame) -> DataFrame:
    """Answers (id, claim, uncertainty) after the guardrail: a blocked one loses its claim and is wholly uncertain."""
    reason = blocked_by(F.col("claim"))
    return claims.select("id", F.when(reason.isNull(), F.col("claim")).otherwise("").alias("claim"), F.when(reason.isNull(), F.col("uncertainty")).otherwise(1.0).alias("uncertainty"), reason.alias("reason"))


def described(edges: DataFrame, query: str, limit: int = EVIDENCE) -> DataFrame:
    """`local`, or where no edge has a term of the query, the edges by the degrees of their ends (`score` is then the key).
    edges: ord, src, dst, layer, weight.  A self-loop counts twice."""
    found = saved(local(edges, query, limit))  # a few rows, so that the search runs once
    if not found.isEmpty():
        return found.orderBy(F.desc("score"), "ord")
    simple = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = simple.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    a, b = (deg.select(F.col("n").alias(x), F.col("d").alias("d_" + x)) for x in ("src", "dst"))
    key = (F.col("d_src") + F.col("d_dst") + F.col("weight").cast("long")).alias("score")
    return edges.join(a, "src").join(b, "dst").withColumn("score", key).drop("d_src", "d_dst").orderBy(F.desc("score"), "ord").limit(limit)


def description(found: DataFrame, edge_id: str = "ord") -> DataFrame:
    """One row (evidence, edges, layers, uncertainty) of what `described` found: its edges in their order, how many they are
    and of how many layers; no edges give an empty list and zeros."""
    first = F.struct((-F.col("score")).alias("s"), "ord", F.col(edge_id).alias("id"))
    row = found.agg(F.sort_array(F.collect_list(first)).alias("e"), F.count("*").alias("edges"), F.countDistinct("layer").alias("layers"))
    return row.select(F.transform("e", lambda x: x["id"]).alias("evidence"), "edges", "layers", F.lit(DESCRIBED).alias("uncertainty"))


def top_k(rows: DataFrame, value: str, order: list[str], k: int = 3, absolute: bool = False) -> DataFrame:
    """The k (1 at least) largest rows by value or absolute value, to six decimals."""
    by = F.abs(value) if absolute else F.col(value)
    return rows.orderBy(F.desc(by), *order).limit(max(1, k)).withColumn(value, F.round(value, 6))


def degrees(adjacency: DataFrame) -> DataFrame:
    """Distinct neighbours, summed weight and edge rows of each node, in one aggregation."""
    return adjacency.groupBy("node").agg(F.countDistinct("nbr").alias("simple"), F.sum("weight").alias("weighted"), F.count("*").alias("rows"))


def by_degree(pairs: DataFrame, adjacency: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """Edges by the degrees of their ends in the simple graph and the whole part of their weight."""
    deg = adjacency.select("node", "nbr").distinct().groupBy("node").agg(F.count("*").alias("degree"))
    u, v = (deg.select(F.col("node").alias(x), F.col("degree").alias("d_" + x)) for x in "uv")
    key = (F.col("d_u") + F.col("d_v") + F.col("weight").cast("long")).alias("key")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "weight", key).orderBy(F.desc("key"), "u", "v").limit(limit)


def edge_delta(before: DataFrame, after: DataFrame, limit: int = EVIDENCE, weight: str = "weight") -> DataFrame:
    """Largest changes of summed weight between two edge tables, by unordered pair; sums up to 1e-9 count as none.  Weights
    may be numbers of any type: sums of whole or decimal ones are exact, whatever the order of rows."""
    total = lambda e, name: e.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum(weight).alias(name))
    both = total(before, "old").join(total(after, "new"), ["u", "v"], "full_outer").fillna(0, ["old", "new"])
    kind = F.when(F.col("old") <= 1e-9, "added").when(F.col("new") <= 1e-9, "removed").otherwise("weight")
    both = both.withColumn("delta", F.col("new") - F.col("old")).where(F.abs("delta") > 1e-9)
    return both.select("u", "v", "old", "new", "delta", kind.alias("kind")).orderBy(F.desc(F.abs("delta")), "u", "v").limit(limit)
