from datetime import datetime
from pathlib import Path

import pytest
from pyspark.ml.feature import Binarizer

from stayline.session import WORK_DIR_SETTING, work_dir
from stayline.sources import schemas, tables as T


def test_every_schema_has_a_key(spark):
    assert len(schemas.TABLES) == 10
    for name in schemas.TABLES:
        assert schemas.schema_of(name).fieldNames()[0] == "row_id"


def test_csv_keeps_codes_reads_times_and_turns_empty_to_null(spark, tmp_path):
    file = tmp_path / "d.csv"
    file.write_text('ROW_ID,SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE\n1,2,3,,"0389"\n')
    row = T.load_table(spark, str(file), "diagnoses_icd").first()
    assert (row.seq_num, row.icd9_code) == (None, "0389")
    labs = tmp_path / "labs.csv"
    labs.write_text("H\n1,2,3,4,2150-01-01 10:00:00,x,NaN,mg,\n2,2,3,4,2150-01-01,x,1.5,mg,abnormal\n")
    rows = T.load_table(spark, str(labs), "labevents").orderBy("row_id").collect()
    assert rows[0].charttime == datetime(2150, 1, 1, 10) and rows[1].charttime == datetime(2150, 1, 1)
    assert (rows[0].valuenum, rows[0].flag, rows[1].valuenum) == (None, None, 1.5)


def test_notes_may_span_lines(spark, tmp_path):
    file = tmp_path / "n.csv"
    file.write_text('H\n1,2,3,2150-01-01,,,Nursing,Report,,,"first ""line""\nsecond, line"\n')
    rows = T.load_table(spark, str(file), "noteevents").collect()
    assert [r.text for r in rows] == ['first "line"\nsecond, line']


def test_malformed_csv_fails(spark, tmp_path):
    file = tmp_path / "bad.csv"
    file.write_text("H\nx,2,3,1,0389\n")
    with pytest.raises(Exception, match="Malformed"):
        T.load_table(spark, str(file), "diagnoses_icd").collect()


def test_ingest_spreads_a_hot_stay_over_files(spark, tmp_path):
    file = tmp_path / "c.csv"
    lines = [f"{i},1,1,{7 if i % 3 else i},1,2150-01-01 {i % 24:02}:00:00,,,v,1.0,u,,,," for i in range(600)]
    file.write_text("H\n" + "\n".join(lines) + "\n")
    stored = T.ingest_table(spark, str(file), "chartevents", str(tmp_path / "out"), files=6)
    assert stored.count() == 600
    files = stored.filter("icustay_id = 7").select("_metadata.file_name").distinct().count()
    assert files >= 3


def test_parquet_round_trip_and_missing_path(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i INT, s STRING")
    path = str(tmp_path / "new" / "folder")
    T.save_dataset(df, path)
    T.save_dataset(df, path)
    assert sorted(T.read_or_empty(spark, path).collect()) == sorted(df.collect())
    assert T.read_or_empty(spark, str(tmp_path / "gone"), df.schema).isEmpty()
    assert T.read_or_empty(spark, str(tmp_path / "gone")).columns == []


def test_materialize_uses_the_session_folder(spark):
    df = T.materialize(spark.range(5))
    assert sorted(r.id for r in df.collect()) == list(range(5))
    assert work_dir(spark) == spark.conf.get(WORK_DIR_SETTING).rstrip("/")
    assert all(work_dir(spark).removeprefix("file:") in f for f in df.inputFiles())


class Unset:
    """A session without the setting; remembers the checkpoint folder it is given."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.sparkContext = self.conf = self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_own_folder_only_in_local_mode():
    local = Unset("local[2]")
    assert work_dir(local) == local.folder == work_dir(local)
    with pytest.raises(ValueError, match=WORK_DIR_SETTING):
        work_dir(Unset("spark://host:7077"))


def test_key_violations(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None), (None, 1), (3, 3)], "row_id INT, subject_id INT")
    got = {r.row_id: (r.n_rows, r.n_null_rows) for r in T.key_violations(df, ["row_id"], ["subject_id"]).collect()}
    assert got == {1: (2, 0), 2: (1, 1), None: (1, 1)}


def test_table_violations_follow_the_declaration(spark):
    df = spark.createDataFrame([(1, None, 3, 1, "a"), (2, 2, 3, 1, "a")], schemas.schema_of("diagnoses_icd"))
    assert [r.row_id for r in T.table_violations(df, "diagnoses_icd").collect()] == [1]


def test_sql_over_named_frames(spark):
    df = spark.createDataFrame([(1,), (2,)], "i INT")
    assert T.run_sql(spark, "SELECT sum(i) AS s FROM {t}", {"t": df}).first().s == 3


def test_names_and_model_round_trip(spark, tmp_path):
    names = ["mean_mchc", "min_heart_rate", "slope_chloride"]
    T.save_names(spark, names, str(tmp_path / "names"))
    assert T.load_names(spark, str(tmp_path / "names")) == names
    T.save_model(Binarizer(threshold=0.5, inputCol="a", outputCol="b"), str(tmp_path / "model"))
    assert T.load_model(Binarizer, str(tmp_path / "model")).getThreshold() == 0.5
    with pytest.raises(Exception):
        T.load_model(Binarizer, str(tmp_path / "none"))


def test_load_inputs(spark, tmp_path):
    for name in ("labs", "vitals", "cohort"):
        T.save_dataset(spark.range(3), str(tmp_path / name))
    loaded = T.load_inputs(spark, str(tmp_path))
    assert sorted(loaded) == ["cohort", "labs", "vitals"] and loaded["labs"].count() == 3


class Recorder:
    """Stands in for a session: records how the reader is set up, without any database."""

    def __init__(self):
        self.set = {}
        self.read = self

    def format(self, name):
        self.set["format"] = name
        return self

    def option(self, key, value):
        self.set[key] = value
        return self

    def options(self, **values):
        self.set.update(values)
        return self

    def load(self):
        return self.set


def test_jdbc_reader_settings():
    plain = T.read_jdbc(Recorder(), "jdbc:x", query="SELECT 1", one_connection=True)
    assert plain == {"format": "jdbc", "url": "jdbc:x", "query": "SELECT 1"}
    split = T.read_jdbc(Recorder(), "jdbc:x", table="t", partition_column="id", lower=0, upper=9, partitions=4)
    assert split["dbtable"] == "t" and split["numPartitions"] == 4 and split["upperBound"] == 9
    assert T.read_jdbc(Recorder(), "jdbc:x", query="SELECT 1", partition_column="id")["dbtable"] == "(SELECT 1) q"
    with pytest.raises(ValueError, match="partition column"):
        T.read_jdbc(Recorder(), "jdbc:x", table="t")
    with pytest.raises(ValueError):
        T.read_jdbc(Recorder(), "jdbc:x")


def test_a_malformed_field_fails_the_load(spark, tmp_path):
    rows = ["row_id,subject_id,hadm_id,seq_num,icd9_code", "1,2,3,4,410", "2,two,3,4,411"]
    (tmp_path / "dx.csv").write_text("\n".join(rows))
    with pytest.raises(Exception, match="MALFORMED|malformed|CANNOT_PARSE"):
        T.ingest_table(spark, str(tmp_path / "dx.csv"), "diagnoses_icd", str(tmp_path / "out"))


def test_a_scope_removes_what_was_stored_by_the_way(spark, tmp_path):
    from stayline.session import work_path, work_scope

    with work_scope(spark) as folder:
        stored = T.materialize(spark.range(5))
        assert work_path(spark, "x").startswith(folder)
        T.save_dataset(stored.filter("id > 1"), str(tmp_path / "result"))
    local = folder.removeprefix("file:")
    assert not Path(local).exists()
    assert spark.read.parquet(str(tmp_path / "result")).count() == 3
    assert not work_path(spark, "x").startswith(folder)
