"""Tables replaced while they are read, by writers that fail, and their old versions."""

import glob
import threading

import pytest
from pyspark.sql import functions as F

from slotwise.sources import staging
from slotwise.sources import tables as tb
from slotwise.sources.versions import VersionedTable


def rows_of_round(spark, n):
    return spark.range(0, 200 + n, 1, 3).select("id", F.lit(n).alias("round"))


def test_readers_meet_one_whole_version(spark, tmp_path):
    name, path = "slotwise_moving", str(tmp_path / "moving")
    tb.replace_table(rows_of_round(spark, 0), name, path)
    seen, failed, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                r = spark.table(name).agg(F.count("*").alias("n"), F.min("round").alias("a"), F.max("round").alias("b")).first()
                seen.append((r.n, r.a, r.b))
            except Exception as e:
                failed.append(e)

    readers = [threading.Thread(target=read) for _ in range(2)]
    for t in readers:
        t.start()
    for n in range(1, 7):
        tb.replace_table(rows_of_round(spark, n), name, path)
    done.set()
    for t in readers:
        t.join()
    assert not failed and len(seen) > 2
    assert all(a == b and n == 200 + a for n, a, b in seen)
    assert [a for _, a, _ in seen[-1:]] and spark.table(name).first()["round"] == 6


def test_a_frame_keeps_its_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "kept"))
    first = table.replace(spark.range(3))
    before = table.read()
    table.replace(spark.range(5).selectExpr("id AS other", "id * 2 AS more"))
    assert before.count() == 3 and table.read(first).columns == ["id"]
    assert table.read().columns == ["other", "more"] and table.read().count() == 5
    # A version may be made from the one before it.
    table.replace(table.read().where("other > 1"))
    assert table.read().count() == 3


def test_a_failed_or_unfinished_writer_is_not_seen(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "failing"))
    with pytest.raises(ValueError):
        table.read()
    table.replace(spark.range(4))
    broken = spark.range(0, 1000, 1, 8).select(F.expr("IF(id = 700, raise_error('stop'), id)").alias("id"))
    with pytest.raises(Exception, match="stop"):
        table.replace(broken)
    assert table.read().count() == 4 and len(table.versions()) == 1
    assert len(glob.glob(str(tmp_path / "failing" / "version=*"))) == 1
    written = table.write(spark.range(9))
    assert table.read().count() == 4
    with pytest.raises(ValueError):
        table.read(written)
    table.commit(written)
    assert table.read().count() == 9


def test_old_versions_are_dropped_on_request(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "old"))
    names = [table.replace(spark.range(n)) for n in (1, 2, 3, 4)]
    assert table.versions() == names
    assert table.drop_old(keep=2) == 2 and table.versions() == names[2:]
    assert table.read().count() == 4 and table.read(names[2]).count() == 3
    assert len(glob.glob(str(tmp_path / "old" / "version=*"))) == 2
    with pytest.raises(ValueError):
        table.read(names[0])
    with pytest.raises(ValueError):
        table.drop_old(0)
    assert table.drop_old() == 1 and table.drop_old() == 0


def test_a_plain_table_of_the_name_gives_way(spark, tmp_path):
    spark.range(2).write.saveAsTable("slotwise_plain")
    assert tb.replace_table(spark.range(7), "slotwise_plain", str(tmp_path / "plain")).count() == 7
    assert tb.replace_table(spark.range(0), "slotwise_plain", str(tmp_path / "plain")).count() == 0


def test_a_scope_removes_what_was_staged_in_it(spark):
    root = staging.staging_root(spark)
    outside = staging.stage(spark.range(2), "outside")
    with staging.staging_scope(spark):
        staged = staging.stage(spark.range(3), "inside")
        with staging.staging_scope(spark):
            inner = staging.stage(spark.range(4), "inner")
            assert inner.count() == 4
        assert staged.count() == 3 and not glob.glob(f"{root}/inner-*")
    assert not glob.glob(f"{root}/inside-*") and outside.count() == 2
