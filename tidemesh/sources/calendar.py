"""Meetings as a layered graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(meetings: DataFrame) -> DataFrame:
    """(event, src, dst, layer, weight, ts) from (event, organiser, attendees, location, start, hours).

    Social edges run from the organiser to every other attendee, as often as it is named; temporal ones join each two
    people of a meeting, the smaller first; a spatial one leads to the place.  They weigh 0.8, 0.45 and 0.5 an hour, with
    0.1 hours at least (also where none are given).  Everything comes from the meeting's own row, without a shuffle; null
    attendees, no attendees and a null or empty place add nothing.
    """
    hours = F.greatest(F.lit(0.1), F.coalesce("hours", F.lit(0.1)))
    others = F.filter(F.coalesce("attendees", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != F.col("organiser")))
    rows = meetings.select("event", "organiser", "location", F.col("start").alias("ts"), hours.alias("hours"), others.alias("others"))
    people = rows.withColumn("people", F.sort_array(F.array_distinct(F.concat(F.array("organiser"), "others"))))
    social = rows.select("event", F.col("organiser").alias("src"), F.explode("others").alias("dst"), F.lit("social").alias("layer"), F.lit(0.8).alias("rate"), "hours", "ts")
    first = people.select("event", "hours", "ts", "people", F.posexplode("people").alias("at", "src"))
    temporal = first.select("event", "src", F.explode(F.slice("people", F.col("at") + 2, F.size("people"))).alias("dst"), F.lit("temporal").alias("layer"), F.lit(0.45).alias("rate"), "hours", "ts")
    spatial = rows.where("location <> ''").select("event", F.col("organiser").alias("src"), F.col("location").alias("dst"), F.lit("spatial").alias("layer"), F.lit(0.5).alias("rate"), "hours", "ts")
    every = social.unionByName(temporal).unionByName(spatial)
    return every.select("event", "src", "dst", "layer", F.round(F.col("rate") * F.col("hours"), 6).alias("weight"), "ts")


def nodes(meetings: DataFrame) -> DataFrame:
    """(id, kind): persons and places; an id that is both has the kind of the first event that names it, a person before a place."""
    people = F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("organiser").alias("id"), F.lit("person").alias("kind"))), F.transform(F.coalesce("attendees", F.array().cast("array<string>")), lambda a: F.struct(F.lit(0).alias("k"), a.alias("id"), F.lit("person").alias("kind"))))
    place = F.array(F.struct(F.lit(1).alias("k"), F.nullif("location", F.lit("")).alias("id"), F.lit("place").alias("kind")))
    rows = meetings.select("event", F.explode(F.concat(people, place)).alias("n")).where("n.id is not null")
    # the first event of each id and kind is a plain minimum, which needs no sorted rows; of these an id has two at most
    first = rows.groupBy("n.id", "n.k", "n.kind").agg(F.min("event").alias("event"))
    return first.groupBy("id").agg(F.min_by("kind", F.struct("event", "k")).alias("kind"))
