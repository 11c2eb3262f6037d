"""Tables in buckets, exports, and places in an order: what they hold, read and write, and what dying writers leave."""

import random
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passbook.operators import order, review, summaries, vouchers
from passbook.plans import bindings
from passbook.sources import versions, xml


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("value"), F.lit("s").alias("session_id"), F.lit(None).cast("timestamp").alias("created_at"))
    assert versions.create(rows, path, buckets=256) == 1
    return path


def test_a_change_touches_its_buckets_alone(spark, table, tmp_path):
    changes = spark.createDataFrame([("k7", -1, "x", None), ("k8", -2, "x", None), ("new", -3, "y", None)], "id string, value long, session_id string, created_at timestamp")
    assert versions.change(changes, table) == 2
    _, first = versions.manifest(spark, table, 1)
    _, now = versions.manifest(spark, table)
    moved = [b for b, name in now["buckets"].items() if first["buckets"].get(b) != name]
    assert 1 <= len(moved) <= 3
    # what was written is a matching share of the first version's bytes
    size = lambda name: sum(f.stat().st_size for f in Path(f"{tmp_path}/t/data/{name}").rglob("*.parquet"))
    (old,) = set(first["buckets"].values())
    (new,) = {now["buckets"][b] for b in moved}
    assert size(new) <= 4 / 256 * size(old)
    # and the merge has seen these buckets' rows only
    seen = []
    versions.change(changes.withColumn("value", F.lit(-9).cast("long")), table, lambda cur, ch: (seen.append(cur.count()), review.upsert(cur, ch))[1])
    assert seen[0] < 5000 * 3 * 3 / 256
    got = {r.id: (r.value, r.session_id) for r in versions.read(spark, table).collect()}
    assert len(got) == 5001 and got["k7"] == (-9, "s") and got["new"] == (-9, "y") and got["k9"] == (9, "s")
    assert rows_of(versions.lookup(spark.createDataFrame([("k7",), ("none",)], "id string"), table).select("id", "value")) == [("k7", -9)]


def test_readers_stay_on_their_version(spark, table):
    before = versions.read(spark, table)
    versions.delete(spark.createDataFrame([("k1",), ("k1",), ("absent",)], "id string"), table)
    assert before.count() == 5000 and versions.read(spark, table).count() == 4999 and versions.read(spark, table, 1).count() == 5000
    versions.change(versions.read(spark, table).limit(0), table)
    assert versions.versions(spark, table) == [1, 2]


def test_a_writer_that_dies_leaves_the_old_version(spark, table, tmp_path):
    def dies(cur, ch):
        raise RuntimeError("lost")

    change = spark.createDataFrame([("k1", 1, "x", None)], "id string, value long, session_id string, created_at timestamp")
    with pytest.raises(RuntimeError):
        versions.change(change, table, dies)
    # data without a manifest, and a manifest that was cut off
    versions._put(change.withColumn("bucket", F.lit(0)), table, "bucket")
    Path(f"{tmp_path}/t/manifests/000000000002.json").write_text('{"schema": "')
    assert versions.versions(spark, table) == [1] and versions.read(spark, table).count() == 5000
    assert versions.change(change.withColumn("value", F.lit(77).cast("long")), table) == 3
    assert versions.read(spark, table).where("id = 'k1'").first().value == 77
    gone = versions.vacuum(spark, table, keep=1)
    assert len(gone) == 1 and versions.versions(spark, table) == [3] and versions.read(spark, table).count() == 5000


def test_two_writers_from_one_version_collide(spark, table):
    n, content = versions.manifest(spark, table)
    assert versions.commit(spark, table, n, content) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark, table, n, content)
    with pytest.raises(versions.Conflict):
        versions.create(spark.createDataFrame([("a",)], "id string"), table)


def test_odd_changes(spark, table, tmp_path):
    bad = spark.createDataFrame([("k1", 1, "x", None), ("k1", 2, "x", None)], "id string, value long, session_id string, created_at timestamp")
    with pytest.raises(ValueError):
        versions.change(bad, table)
    with pytest.raises(ValueError):
        versions.change(bad.limit(1).withColumn("id", F.lit(None).cast("string")), table)
    empty = f"file://{tmp_path}/empty"
    versions.create(spark.createDataFrame([], "id string, bucket int"), empty)
    assert versions.read(spark, empty).collect() == []
    versions.change(spark.createDataFrame([("a", 5)], "id string, bucket int"), empty)
    assert rows_of(versions.read(spark, empty)) == [("a", 5)]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"file://{tmp_path}/none")


def test_places_and_pages(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3]), "s", 0) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, v int, part string, at int").repartition(7)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    placed = order.ranged(df, F.col("v").asc_nulls_last(), F.col("id"))
    assert [r.id for r in placed.numbered("n").orderBy("n").collect()] == want
    assert [r.n for r in placed.numbered("n").orderBy("n").collect()] == list(range(1, 701))
    assert placed.numbered("n").columns == ["id", "v", "part", "at", "n"]
    for page, size in ((0, 10), (3, 97), (7, 97), (8, 97), (69, 10)):
        assert [r.id for r in placed.page(page, size).collect()] == want[page * size : (page + 1) * size]
    # a page's scan reads the ranges that hold it
    plan = placed.page(30, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part_" in plan and "(part_" in plan.split("PartitionFilters")[1].split("]")[0]
    none = order.ranged(df.limit(0), F.col("id"))
    assert none.page(0, 5).collect() == [] and none.numbered("n").collect() == [] and none.total == 0


def test_a_far_page_equals_a_near_one(spark, monkeypatch):
    rows = spark.range(300).selectExpr("string(id % 7) as session_id", "cast(id as int) as row_number", "timestamp'2024-01-01' as created_at", "string(id) as id", "nullif(id % 5, 0) as v")
    near = review.sorted_page(rows, "v", 5, 20).collect()
    monkeypatch.setattr(review, "NEAR_ROWS", 50)
    assert review.sorted_page(rows, "v", 5, 20).collect() == near


def test_messages_of_large_batches_are_rows(spark):
    rows = [("big", i, f"m{i:04}") for i in range(900)] + [("small", 2, "b"), ("small", 1, "a"), ("small", 3, None), ("none", 1, "")]
    random.Random(2).shuffle(rows)
    got = summaries.import_messages(spark.createDataFrame(rows, "batch_id string, position int, message string")).orderBy("batch_id", "n").collect()
    assert [tuple(r) for r in got] == [*(("big", i + 1, f"m{i:04}") for i in range(900)), ("small", 1, "a"), ("small", 2, "b")]


def _messages(spark, n, size=80):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "2024-01").otherwise("2024-02").alias("group_key"), F.concat(F.lit("<TALLYMESSAGE>"), F.format_string("%05d", "id"), F.repeat(F.lit("x"), (F.col("id") % size).cast("int")), F.lit("</TALLYMESSAGE>")).alias("xml"), F.col("id").alias("at"))


def test_export_files_are_whole_and_small(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert xml.write_vouchers(_messages(spark, 1500), "A & B", path, 8192) == 1
    files = list(Path(f"{tmp_path}/out").rglob("part-*"))
    assert len(files) > 12 and max(f.stat().st_size for f in files) <= 8192
    seen = {}
    for f in files:
        root = ET.fromstring(f.read_text())
        assert root.find(".//SVCURRENTCOMPANY").text == "A & B"
        group = f.parent.parent.name.removeprefix("group_key=")
        seen.setdefault(group, {})[int(f.parent.name.removeprefix("file="))] = [int(x.text[:5]) for x in root.iter("TALLYMESSAGE")]
    # in order over a group's files, none empty
    for group, parts in seen.items():
        flat = [i for k in sorted(parts) for i in parts[k]]
        assert flat == [i for i in range(1500) if (i % 3 == 0) == (group == "2024-01")] and all(parts.values())


def test_an_export_that_dies_leaves_the_one_before(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    xml.write_vouchers(_messages(spark, 50), "A", path)
    before = rows_of(xml.exported(spark, path))
    fails = _messages(spark, 60).withColumn("xml", F.when(F.col("at") == 55, F.raise_error(F.lit("dead"))).otherwise(F.col("xml")))
    with pytest.raises(Exception, match="dead"):
        xml.write_vouchers(fails, "A", path)
    # files that were written but not made the export
    Path(f"{tmp_path}/out/data/half/group_key=2024-01/file=0").mkdir(parents=True)
    assert rows_of(xml.exported(spark, path)) == before
    assert xml.write_vouchers(_messages(spark, 60), "A", path) == 2
    assert xml.exported(spark, path).where("value like '<TALLYMESSAGE%'").count() == 60
    assert xml.write_vouchers(_messages(spark, 0), "A", path) == 3 and xml.exported(spark, path).collect() == []


def test_one_message_larger_than_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("g", "<TALLYMESSAGE>" + "y" * 5000 + "</TALLYMESSAGE>"), ("g", "<TALLYMESSAGE>z</TALLYMESSAGE>")], "group_key string, xml string")
    xml.write_vouchers(rows, "A", f"file://{tmp_path}/out", 1000)
    files = list(Path(f"{tmp_path}/out").rglob("part-*"))
    assert sorted(len(list(ET.fromstring(f.read_text()).iter("TALLYMESSAGE"))) for f in files) == [1, 1]


def _contents(root):
    """(group's folder, file's folder, bytes) of an export's files."""
    return sorted((f.parent.parent.name, f.parent.name, f.read_bytes()) for f in Path(root).rglob("part-*"))


def test_files_of_a_mounted_folder_equal_those_of_sparks_writer(spark, tmp_path):
    keys = ["2024-01", "a/b=c", "50% \"x\" #1?", "[é]{^}:\\*'", "tab\there", "", None]
    rows = spark.createDataFrame([(keys[i % 7], f"<TALLYMESSAGE>é{i:04}{'x' * (i % 50)}</TALLYMESSAGE>", i) for i in range(700)], "group_key string, xml string, at long")
    xml.write_vouchers(rows, "A", f"file://{tmp_path}/here/out", 2048)
    # another file system over the same disk, which gets Spark's writer
    hadoop = spark._jsc.hadoopConfiguration()
    (tmp_path / "there").mkdir()
    hadoop.set("fs.viewfs.mounttable.t.link./m", f"file://{tmp_path}/there")
    xml.write_vouchers(rows, "A", "viewfs://t/m/out", 2048)
    assert _contents(f"{tmp_path}/here") == _contents(f"{tmp_path}/there") and len(_contents(f"{tmp_path}/here")) > 14
    got = xml.exported(spark, f"file://{tmp_path}/here/out").where("value like '<TALLYMESSAGE%'")
    assert rows_of(got.select("value")) == rows_of(rows.select("xml"))
    assert {r[0] for r in got.select("group_key").distinct().collect()} == {k or None for k in keys}
    # a process for each file and for its checksum is what took the time; only the manifest, of which there is one, has a checksum
    assert len(list(Path(f"{tmp_path}/here").rglob(".*.crc"))) == 1


def test_an_export_is_listed_by_few_tasks_and_passes_over_partial_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    xml.write_vouchers(_messages(spark, 3000), "A", path, 2048)
    folders = list(Path(f"{tmp_path}/out").rglob("file=*"))
    (folders[0] / ".partial").write_text("<TALLYMESSAGE>cut")
    spark.sparkContext.setJobGroup("listing", "listing")
    lines = xml.exported(spark, path)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(folders) > 100 and stages and max(s.numTasks for s in stages) <= 2 * spark.sparkContext.defaultParallelism
    assert lines.where("value like '<TALLYMESSAGE%'").count() == 3000
    # no columns are found out from the folders, which takes the square of their number
    assert "file_path" in lines._jdf.queryExecution().optimizedPlan().toString()


def test_messages_are_made_where_they_are_written(spark, tmp_path):
    made = _messages(spark, 500).withColumnsRenamed({"xml": "first", "at": "file"}).withColumn("at", F.col("file"))
    xml.write_vouchers(made, "A", f"file://{tmp_path}/made", 4096, F.concat("first", F.lit("")))
    xml.write_vouchers(_messages(spark, 500), "A", f"file://{tmp_path}/given", 4096)
    assert _contents(f"{tmp_path}/made") == _contents(f"{tmp_path}/given") and len(_contents(f"{tmp_path}/made")) > 4
    # rows go to their files without a join of messages by id, which moved them twice
    t = bindings.statements(spark, "/root/testdata/sf0.001").where("transaction_date is not null")
    dated = vouchers.grouped(t, "month").select("group_key", F.col("row_number").alias("at"), *vouchers.MESSAGE_COLUMNS)
    assert rows_of(dated.select("id", vouchers.message())) == rows_of(vouchers.voucher_xml(t))
