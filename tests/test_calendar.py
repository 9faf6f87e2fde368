"""Meetings and the Markdown report by hand."""

from tidemesh.sources import calendar, sinks


def test_meetings_without_people_or_place(spark):
    rows = [(1, "a", ["c", "b", "c", "a", None], "room", None, 2.0), (2, "a", None, "", None, None), (3, "b", [], "b", None, 0.0)]
    table = spark.createDataFrame(rows, "event int, organiser string, attendees array<string>, location string, start timestamp, hours double")
    got = sorted((r.event, r.layer, r.src, r.dst, r.weight) for r in calendar.edges(table).collect())
    assert got == [
        (1, "social", "a", "b", 1.6), (1, "social", "a", "c", 1.6), (1, "social", "a", "c", 1.6), (1, "spatial", "a", "room", 1.0),
        (1, "temporal", "a", "b", 0.9), (1, "temporal", "a", "c", 0.9), (1, "temporal", "b", "c", 0.9), (3, "spatial", "b", "b", 0.05),
    ]
    assert {r.id: r.kind for r in calendar.nodes(table).collect()} == {"a": "person", "b": "person", "c": "person", "room": "place"}
    assert calendar.edges(table.limit(0)).count() == calendar.nodes(table.limit(0)).count() == 0


def test_markdown_report(spark):
    rows = spark.createDataFrame([("x", 0.5), ("y", 0.25)], "name string, score double")
    assert sinks.markdown_report(rows, ["name"], "score", 0) == "| name | score |\n| --- | --- |\n| y | 0.250000 |\n"
