"""Parallel loads of CSV with line breaks, and published versions."""

import csv
import io
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stayline.sources import published as PB
from stayline.sources.quoted import load_quoted_csv
from stayline.sources.tables import ingest_table, load_table


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 40 bytes, so that nearly every record crosses some."""
    settings = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_across_ranges(spark, tmp_path, small_ranges, ending):
    random.seed(len(ending))
    cells = ["a", 'b"q', "c\n\nd", "", 'x,y\n"z"\r\n', '"\n"\n"', "long " * 30, " \n "]
    wanted = []
    for file in range(2):
        rows = [(100 * file + i, random.choice(cells) * random.randint(1, 3), random.choice([None, 3])) for i in range(9 + 6 * file)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=ending)
        writer.writerow(["id", "text\nof two lines", "n"])
        writer.writerows(rows)
        with open(tmp_path / f"{file}.csv", "w", newline="") as f:
            f.write(out.getvalue() + ending * file)
        wanted += [(i, text or None, n) for i, text, n in rows]
    read = load_quoted_csv(spark, str(tmp_path), "id int, text string, n int")
    assert read.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, read.collect()), key=str) == sorted(wanted, key=str)


def test_header_only_and_one_range(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n")
    assert load_quoted_csv(spark, str(tmp_path / "a.csv"), "id int, text string").count() == 0
    (tmp_path / "b.csv").write_text('id,text\n1,"x\ny"')
    assert [tuple(r) for r in load_quoted_csv(spark, str(tmp_path / "b.csv"), "id int, text string").collect()] == [(1, "x\ny")]


def test_malformed_files_raise(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="quotes"):
        load_quoted_csv(spark, str(tmp_path / "open.csv"), "a int, b string")
    for name, line in (("number", 'z,"y"'), ("many", '1,"x\n",5'), ("few", "1")):
        (tmp_path / f"{name}.csv").write_text(f'a,b\n1,"x\n"\n{line}\n')
        with pytest.raises((PySparkException, Py4JJavaError)):
            load_quoted_csv(spark, str(tmp_path / f"{name}.csv"), "a int, b string").collect()


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    head = "row_id,subject_id,hadm_id,chartdate,charttime,storetime,category,description,cgid,iserror,text\n"
    body = "".join(f'{i},1,2,,,,note,"a ""quoted"" word",,,"line one of {i}\n\nline ""two"", the end"\n' for i in range(20_000))
    (tmp_path / "notes.csv").write_text(head + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        notes = load_table(spark, str(tmp_path / "notes.csv"), "noteevents")
        tasks = notes.select(F.spark_partition_id().alias("p"), "row_id").filter("row_id is not null").select("p").distinct().count()
        assert tasks > 8
        stored = ingest_table(spark, str(tmp_path / "notes.csv"), "noteevents", str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert stored.count() == 20_000 and stored.select("row_id").distinct().count() == 20_000
    assert stored.filter(F.col("text") == F.concat(F.lit("line one of "), "row_id", F.lit('\n\nline "two", the end'))).count() == 20_000


def test_a_failed_load_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, x string")
    assert PB.read_published(spark, path, "id int, x string").count() == 0
    PB.publish_table(rows((1, "a"), (2, "b")), path, ["id"], ["x"])
    for wrong in (rows((1, "a"), (1, "b")), rows((None, "a")), rows((3, None))):
        with pytest.raises(PB.LoadError, match="id="):
            PB.publish_table(wrong, path, ["id"], ["x"])
    with pytest.raises((PySparkException, Py4JJavaError)):
        PB.publish_table(rows((1, "a")).withColumn("x", F.raise_error(F.lit("broken"))), path, ["id"])
    assert sorted(map(tuple, PB.read_published(spark, path).collect())) == [(1, "a"), (2, "b")]
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("version-")]) == 1


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "table")
    first = PB.publish_table(spark.range(5), path, ["id"])
    old = PB.read_published(spark, path)
    PB.publish_table(spark.range(7), path, ["id"])
    assert (old.count(), first.count(), PB.read_published(spark, path).count()) == (5, 5, 7)
    # A table may be made from its own published version.
    PB.publish_table(PB.read_published(spark, path).union(spark.range(7, 9)), path, ["id"])
    assert PB.read_published(spark, path).count() == 9
    assert PB.drop_old_versions(spark, path) == 2 and PB.drop_old_versions(spark, path) == 0
    assert PB.read_published(spark, path).count() == 9
    with pytest.raises(ValueError):
        PB.drop_old_versions(spark, path, 0)


def test_of_two_loads_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    PB.publish_table(spark.range(1), path)
    seen = PB._pointers(spark, path)
    PB.publish_table(spark.range(2), path)
    monkeypatch.setattr(PB, "_pointers", lambda *_: seen)
    with pytest.raises(PB.LoadError, match="meanwhile"):
        PB.publish_table(spark.range(3), path)
    monkeypatch.undo()
    assert PB.read_published(spark, path).count() == 2


def test_published_base_table(spark, tmp_path):
    (tmp_path / "d.csv").write_text("row_id,subject_id,hadm_id,seq_num,icd9_code\n1,5,6,1,x\n2,5,6,2,y\n")
    path = str(tmp_path / "diagnoses")
    assert PB.publish_csv(spark, str(tmp_path / "d.csv"), "diagnoses_icd", path).count() == 2
    (tmp_path / "e.csv").write_text("row_id,subject_id,hadm_id,seq_num,icd9_code\n1,5,,1,x\n")
    with pytest.raises(PB.LoadError):
        PB.publish_csv(spark, str(tmp_path / "e.csv"), "diagnoses_icd", path)
    assert PB.read_published(spark, path).count() == 2


def test_base_schemas_counts_columns_apart(spark, tmp_path):
    """No row is spread out into one row a column; a table without rows has its columns with zeros, as in the SQL."""
    from stayline.plans.queries import REGISTRY

    for name in ("customer", "orders", "part", "events", "nation", "documents", "region"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (rows.limit(0) if name == "region" else rows).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    counts = REGISTRY["base_schemas"](spark, str(tmp_path))
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.table_name, r.column_name): (r.n_filled, r.n_distinct) for r in counts.collect()}
    assert len(found) == 43 and found["d_labitems", "label"] == (0, 0)
    assert found["d_items", "row_id"] == (25, 25)
