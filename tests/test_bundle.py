"""Bundles become visible whole or not at all."""

import os

import pytest

from orrery.sources.bundle import Refused, differences, facts, newest, publish, read


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, name string")


def none(tables):
    return tables["a"].limit(0)


def test_one_failing_audit_publishes_nothing(spark, tmp_path):
    folder, asked = str(tmp_path), []
    publish(spark, folder, {"a": frame(spark, [(1, "x")]), "b": frame(spark, [])}, {"fine": none})

    def bad(tables):
        asked.append(sorted(tables))
        return tables["b"].filter("k > 1")

    with pytest.raises(Refused) as stop:
        publish(spark, folder, {"a": frame(spark, [(2, "y")]), "b": frame(spark, [(2, "y"), (3, None)])}, {"fine": none, "bad": bad, "later": none})
    assert stop.value.findings == {"fine": 0, "bad": 2, "later": 0} and asked == [["a", "b"]]
    assert {k: sorted(map(tuple, t.collect())) for k, t in read(spark, folder).items()} == {"a": [(1, "x")], "b": []}
    assert len(os.listdir(f"{folder}/tables")) == 1  # what was written aside is gone


def test_the_newest_bundle_is_read(spark, tmp_path):
    folder = str(tmp_path)
    for k in (1, 2):
        publish(spark, folder, {"a": frame(spark, [(k, "x")] * k)}, {"fine": none})
    assert read(spark, folder)["a"].count() == 2 and newest(spark, folder).count() == 1 and differences(spark, folder).count() == 0


def test_what_changed_after_publishing_is_found(spark, tmp_path):
    folder = str(tmp_path)
    publish(spark, folder, {"a": frame(spark, [(1, "x"), (2, None)]), "b": frame(spark, [(5, "")])}, {})
    path = {r.name: r.path for r in newest(spark, folder).collect()}
    frame(spark, [(9, "more")]).write.mode("append").parquet(path["a"])
    assert [(r.name, r.n_rows, r.found_rows) for r in differences(spark, folder).collect()] == [("a", 2, 3)]


def test_digests(spark):
    one = lambda rows: tuple(facts(frame(spark, rows).repartition(3)).first())
    rows = [(i, f"n{i}") for i in range(50)]
    assert one(rows) == one(rows[::-1]) and one(rows) != one(rows[:-1] + [(49, "n")]) and one([(1, None)]) != one([(1, "")]) and one([]) == (0, 0)
