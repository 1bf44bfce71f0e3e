import json
import os

import pytest

from tidemill import Adapter, Column, FileSource, LocalFiles, ObjectStore, Project
from tidemill.errors import RunFailed, SpecError
from tidemill.plans.project import Runner
from tidemill.streaming import incremental
from tidemill.streaming.incremental import incremental_ingest, ingest_new, size_in_bytes


def test_only_new_files_are_taken(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    columns = [Column("id", "BIGINT"), Column("v", "STRING")]
    take = lambda: incremental_ingest(
        spark, str(inbox), FileSource("", "csv", max_batch_size="1KB"), columns, str(tmp_path / "t"), str(tmp_path / "p")
    )
    for i in range(3):
        (inbox / f"{i}.csv").write_text(f"id,v\n{i},{'x' * 700}\n")
    assert sorted(r.id for r in take().collect()) == [0, 1, 2]
    assert sorted(r.id for r in take().collect()) == [0, 1, 2]
    (inbox / "9.csv").write_text("id,v\n9,y\n")
    assert sorted(r.id for r in take().collect()) == [0, 1, 2, 9]


def test_sizes():
    assert size_in_bytes("100MB") == 100 * 1024**2 and size_in_bytes("5") == 5 and size_in_bytes("2 gb") == 2 * 1024**3
    with pytest.raises(SpecError):
        size_in_bytes("much")


COLUMNS = (Column("id", "BIGINT"), Column("v", "STRING"))


def take(spark, tmp_path, name, content, source, columns=COLUMNS):
    (tmp_path / "in").mkdir(parents=True, exist_ok=True)
    (tmp_path / "in" / name).write_text(content)
    adapter = Adapter("t", "files", source, columns)
    return ingest_new(spark, adapter, LocalFiles(str(tmp_path)), str(tmp_path / "t"), str(tmp_path / "p"))


def test_streams_read_what_batches_read(spark, tmp_path):
    rows = take(spark, tmp_path, "a.csv", "id;v\n1;x\n", FileSource("in/*.csv", delimiter="auto"))
    assert rows.collect() == [(1, "x")]
    arrays = FileSource("in/*.json", "json", layout="array", max_batch_size="10B")
    array = json.dumps([{"id": 2, "v": "y"}, {"id": 3, "v": None}], indent=1)
    assert sorted(map(tuple, take(spark, tmp_path / "j", "a.json", array, arrays).collect())) == [(2, "y"), (3, None)]


@pytest.mark.parametrize("name, content", [("a.csv", "id,v\nbad,x\n"), ("a.csv", "id;v\n1;x\n"), ("a.csv", "v,id\nx,1\n")])
def test_rows_that_do_not_fit_end_the_job(spark, tmp_path, name, content):
    with pytest.raises(Exception):
        take(spark, tmp_path, name, content, FileSource("in/*.csv")).collect()


def test_layout_must_be_declared(spark, tmp_path):
    with pytest.raises(SpecError):
        take(spark, tmp_path, "a.json", "{}", FileSource("in/*.json", "json"))


def runner_of(spark, tmp_path, source, columns=COLUMNS, connection=None, name="loaded_by_and_by"):
    project = Project().connect("files", connection or LocalFiles(str(tmp_path))).add(Adapter(name, "files", source, columns))
    return Runner(spark, project, location=str(tmp_path / "tables"), state=f"{name}_state")


def deliver(tmp_path, name, content):
    target = tmp_path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content)


def ids(spark, name="loaded_by_and_by"):
    return sorted(r.id for r in spark.table(name).collect())


def test_an_adapter_with_a_batch_size_reads_each_file_once(spark, tmp_path):
    source = FileSource("in/{YYYY}/*.csv", max_batch_size="10B")
    runner = runner_of(spark, tmp_path, source)
    assert runner.run()[0]["phase"] == "no_data"
    for i in range(3):
        deliver(tmp_path, f"in/2024/{i}.csv", f"id,v\n{i},x\n")
    assert runner.run()[0]["phase"] == "completed" and ids(spark) == [0, 1, 2]
    (tmp_path / "in/2024/0.csv").unlink()  # taken files are not needed any more
    deliver(tmp_path, "in/2025/7.csv", "id,v\n7,x\n")
    runner.run()
    runner.run()
    assert ids(spark) == [0, 1, 2, 7]
    # another declaration starts anew
    runner = runner_of(spark, tmp_path, FileSource("in/2025/*.csv", max_batch_size="10B"))
    runner.run()
    assert ids(spark) == [7] and len(list((tmp_path / "tables/_loads/loaded_by_and_by").iterdir())) == 1
    runner.remove("loaded_by_and_by")
    assert not (tmp_path / "tables/_loads/loaded_by_and_by").exists()


def test_a_failed_run_and_its_repetition_neither_lose_nor_repeat_rows(spark, tmp_path):
    runner = runner_of(spark, tmp_path, FileSource("in/*.csv", max_batch_size="1B"), name="interrupted")
    for i in range(4):
        deliver(tmp_path, f"in/{i}.csv", "id,v\nbad,x\n" if i == 2 else f"id,v\n{i},x\n")
        os.utime(tmp_path / f"in/{i}.csv", (1_700_000_000 + i, 1_700_000_000 + i))
    with pytest.raises(RunFailed):
        runner.run()
    deliver(tmp_path, "in/2.csv", "id,v\n2,x\n")
    os.utime(tmp_path / "in/2.csv", (1_700_000_002, 1_700_000_002))
    runner.run()
    assert ids(spark, "interrupted") == [0, 1, 2, 3]


def test_rows_written_by_a_batch_that_did_not_end_are_not_seen(spark, tmp_path):
    runner = runner_of(spark, tmp_path, FileSource("in/*.csv", max_batch_size="1KB"), name="half_written")
    deliver(tmp_path, "in/0.csv", "id,v\n0,x\n")
    runner.run()
    rows = next((tmp_path / "tables/_loads/half_written").glob("*/rows"))
    spark.createDataFrame([(99, "left over")], "id bigint, v string").write.mode("append").parquet(str(rows))
    spark.catalog.refreshTable("half_written")
    assert ids(spark, "half_written") == [0]


def test_columns_delimiter_and_layout_are_found_once(spark, tmp_path):
    runner = runner_of(spark, tmp_path, FileSource("in/*.csv", delimiter="auto", max_batch_size="1KB"), (), name="found_columns")
    deliver(tmp_path, "in/0.csv", "id;when\n1;2024-05-01 10:00:00\n")
    runner.run()
    deliver(tmp_path, "in/1.csv", "id;when\n2;2024-05-02 10:00:00\n")
    runner.run()
    assert ids(spark, "found_columns") == [1, 2] and [f.dataType.simpleString() for f in spark.table("found_columns").schema] == ["int", "timestamp_ntz"]
    arrays = runner_of(spark, tmp_path, FileSource("js/*.json", "json", max_batch_size="1KB"), (), name="found_layout")
    deliver(tmp_path, "js/0.json", '[{"id": 1},\n {"id": 2}]')
    arrays.run()
    assert ids(spark, "found_layout") == [1, 2]


def test_object_stores_are_watched_across_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "bucket_root", lambda store: f"file://{tmp_path}/bucket")
    deliver(tmp_path, "bucket/logs/a b/x/part-1.csv", "id,v\n1,x\n")
    deliver(tmp_path, "bucket/logs/other/part-2.csv", "id,v\n2,x\n")
    deliver(tmp_path, "bucket/logs/a b/readme.txt", "nothing")
    store = ObjectStore("bucket")
    runner = runner_of(spark, tmp_path, FileSource("logs/a*/part-?.csv", max_batch_size="1KB"), connection=store, name="in_store")
    runner.run()
    deliver(tmp_path, "bucket/logs/a3/part-3.csv", "id,v\n3,x\n")
    runner.run()
    assert ids(spark, "in_store") == [1, 3]
