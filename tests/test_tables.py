"""Numbered lines, tables in buckets, files that are replaced in one step."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources import readers
from lodestone.sources import sinks as K


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_lines_are_numbered_over_blocks(spark, tmp_path, small_blocks):
    for name, n in (("a.jsonl", 900), ("b.jsonl", 1), ("c.jsonl", 400)):
        (tmp_path / name).write_text("﻿" + "".join(f'{{"doc_id": "{name}{i}", "text": "﻿{"x" * (i % 40)}"}}\n' if i % 7 else "\n" for i in range(1, n + 1)), encoding="utf-8")
    lines = readers.numbered_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    got = {}
    for r in lines.collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], {})[r.line] = r.value
    assert {k: sorted(v) for k, v in got.items()} == {"a.jsonl": [*range(1, 901)], "b.jsonl": [1], "c.jsonl": [*range(1, 401)]}
    for name, values in got.items():
        assert all((v == "") == (i % 7 == 0) and (f"{name}{i}\"" in v) == (i % 7 > 0) for i, v in values.items())
        assert values[1].startswith("{") and "﻿" in values[1]  # only the mark at the start goes
    assert readers.json_lines(spark, str(tmp_path), "doc_id string").where("number % 7 = 0 or bad").isEmpty()


def test_errors_name_file_and_line(spark, tmp_path, small_blocks):
    at = tmp_path / "kb.jsonl"
    good = "".join(f'{{"doc_id": "d{i}", "text": "some text {i}"}}\n' for i in range(300))
    at.write_text(good + "\n{broken\n" + good)
    with pytest.raises(Exception, match=r"kb.jsonl:302: the line isn't a JSON object"):
        readers.read_documents(spark, str(at)).collect()
    at.write_text(good + '{"doc_id": "x", "text": " "}\n')
    with pytest.raises(Exception, match=r"kb.jsonl:301: the document has no"):
        readers.read_documents(spark, str(at)).collect()
    at.write_text('{"question_id": "a", "frage": "b"}\n' * 2)
    with pytest.raises(Exception, match=r"kb.jsonl:1: the question id is repeated"):
        readers.read_questions(spark, str(at)).collect()
    at.write_text("\n")
    with pytest.raises(ValueError, match="nothing"):
        readers.require_rows(readers.read_documents(spark, str(at)), "nothing there")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_takes_the_last_of_each_key(spark, tmp_path):
    at = str(tmp_path / "t")
    K.write_buckets(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, seq int"), at, "id", 4)
    before = K.read_buckets(spark, at)
    K.upsert(at, spark.createDataFrame([(2, "new", 5), (2, "old", 3), (3, "c", 1), (3, "d", 1)], "id long, v string, seq int").repartition(3), "id", "seq")
    got = rows(K.read_buckets(spark, at).select("id", "v"))
    assert got[:2] == [(1, "a"), (2, "new")] and len(got) == 3 and got[2][1] in "cd"
    assert rows(before.select("id", "v")) == [(1, "a"), (2, "b")]  # whoever has the table keeps it
    K.upsert(at, spark.createDataFrame([(9, "x", 0), (9, "y", 0)], "id long, v string, seq int").coalesce(1), "id")
    assert (9, "y", 0) in rows(K.read_buckets(spark, at))  # the later one of the input
    K.upsert(at, spark.createDataFrame([(10, "z", 0, 1.5)], "id long, v string, seq int, more double"), "id")
    assert (10, "z", 0, 1.5) in rows(K.read_buckets(spark, at)) and (1, "a", 0, None) in rows(K.read_buckets(spark, at))
    with pytest.raises(Exception, match="null"):
        K.upsert(at, spark.createDataFrame([(None, "x", 0)], "id long, v string, seq int"), "id")
    kept = rows(K.read_buckets(spark, at))
    assert K.vacuum(spark, at) > 0 and rows(K.read_buckets(spark, at)) == kept
    with pytest.raises(ValueError):
        K.read_buckets(spark, str(tmp_path / "none"))


def test_one_of_two_writers_wins(spark, tmp_path):
    at = str(tmp_path / "t")
    K.write_buckets(spark.range(3), at, "id", 2)
    state = K._state(spark, at)
    K.upsert(at, spark.createDataFrame([(7,)], "id long"), "id")
    with pytest.raises(Exception):  # noqa: B017 (Java's error)
        K._commit(spark, at, state | {"version": state["version"] + 1})
    assert K.read_buckets(spark, at).count() == 4


def test_only_changed_buckets_are_built_again(spark, tmp_path):
    at, built = str(tmp_path / "index"), []

    def build(rows):
        built.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.upper("text").alias("term"))

    texts = {i: f"text {i}" for i in range(200)}
    frame = lambda: spark.createDataFrame(list(texts.items()), "id long, text string")
    index = lambda: dict(rows(K.read_buckets(spark, at)))
    assert len(K.refresh(frame(), at, "id", ["id", "text"], build, 16)) == 16
    assert index() == {i: t.upper() for i, t in texts.items()}
    assert K.refresh(frame().repartition(7), at, "id", ["id", "text"], build, 16) == [] and len(built) == 1
    texts[5] = "changed"
    assert len(K.refresh(frame(), at, "id", ["id", "text"], build, 16)) == 1
    assert 5 in built[-1] and len(built[-1]) < 40 and index() == {i: t.upper() for i, t in texts.items()}
    del texts[7]
    texts[1000] = "new"
    assert 1 <= len(K.refresh(frame(), at, "id", ["id", "text"], build, 16)) <= 2
    assert index() == {i: t.upper() for i, t in texts.items()}
    assert len(K.refresh(frame(), at, "id", ["id", "text"], build, 16, settings="other model")) == 16
    texts.clear()
    texts[3] = "alone"
    K.refresh(frame(), at, "id", ["id", "text"], build, 16, settings="other model")
    assert index() == {3: "ALONE"}
    assert K.refresh(frame(), at, "id", ["id", "text"], build, 4) != []  # another number of buckets: all anew
    assert index() == {3: "ALONE"}


def test_files_are_replaced_in_one_step(spark, tmp_path):
    at = str(tmp_path / "report.csv")
    K.write_csv(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string").orderBy("n"), at, ["s", "n", "none"])
    assert (tmp_path / "report.csv").read_text() == "s,n,none\na,1,\nb,2,\n"
    K.write_csv(spark.createDataFrame([], "n int, s string"), at, ["s", "n"])
    assert (tmp_path / "report.csv").read_text() == "s,n\n"
    K.publish(spark, str(tmp_path / "alias"), "x")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.range(3).write.parquet(one)
    K.write_buckets(spark.range(5), two, "id", 2)
    for path, n in ((one, 3), (two, 5), (one, 3)):
        K.publish(spark, str(tmp_path / "alias"), path)
        assert K.published(spark, str(tmp_path / "alias")).count() == n
    K.write_manifest(spark, str(tmp_path / "manifest.json"), {"b": 1, "a": [2]})
    assert (tmp_path / "manifest.json").read_text() == '{"a": [2], "b": 1}\n'
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["alias", "manifest.json", "one", "report.csv", "two"]
