import glob

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from slotwise.sources import staging
from slotwise.sources import tables as tb


def test_csv_gzip_infers_numbers_and_times(spark, tmp_path):
    df = spark.sql("""SELECT 1L AS n, 1.5D AS x, timestamp_ntz'2023-01-01 00:48:04.5' AS t, 'say "hi", you' AS s
                      UNION ALL SELECT 2, NULL, timestamp_ntz'2023-01-02 00:00:00', NULL""")
    path = str(tmp_path / "csv")
    df.write.options(header=True, compression="gzip", **tb.CSV_OPTIONS).csv(path)
    back = tb.read_csv_gzip(spark, path, partitions=3)
    assert dict(back.dtypes)["x"] == "double" and dict(back.dtypes)["t"].startswith("timestamp")
    assert rows_of(back.selectExpr("CAST(n AS BIGINT) AS n", "x", "CAST(t AS TIMESTAMP_NTZ) AS t", "s")) == rows_of(df)
    assert back.rdd.getNumPartitions() == 3


def test_datetime_columns_are_all_or_nothing(spark):
    df = spark.createDataFrame(pa.table({
        "good": ["2023-01-01", None, "2023-01-02 03:04:05"], "mixed": ["2023-01-01", "x", None],
        "empty": pa.array([None, None, None], pa.string()), "n": [1, 2, 3]}))
    got = dict(tb.infer_datetime_columns(df).dtypes)
    assert got == {"good": "timestamp_ntz", "mixed": "string", "empty": "string", "n": "bigint"}


def test_replacing_a_table_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 3, 3):
        out = tb.replace_table(spark.range(n).toDF("a"), "replace_me", path)
    assert out.count() == 3
    assert tb.replace_table(spark.range(4).selectExpr("id AS b", "id AS c"), "replace_me", path).columns == ["b", "c"]


def test_results_schema_is_enforced(spark, tmp_path):
    df = spark.sql("""SELECT 'tot' AS kpi_type, 's' AS anova_sig, CAST(0.25 AS DECIMAL(5, 4)) AS anova_pval, 'k' AS kpi,
                      7 AS exp_length, 2 AS num_variants, 3 AS sb_window_size, 'zg' AS zone_group, 'r' AS sim_run_id, 1 AS more""")
    out = tb.write_results(df, "results_here", str(tmp_path / "r"))
    assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in tb.RESULT_SCHEMA.fields]


def test_report_is_one_file_only_on_request(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).toDF("a")
    tb.write_report_csv(df, str(tmp_path / "more"))
    assert len(glob.glob(str(tmp_path / "more" / "*.csv"))) == 4
    tb.write_report_csv(df, str(tmp_path / "one"), one_file=True)
    assert len(glob.glob(str(tmp_path / "one" / "*.csv"))) == 1


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert tb.replace_table(spark.range(3), "slotwise_kept", path).count() == 3
    with pytest.raises(Exception):
        tb.replace_table(spark.range(2).selectExpr("raise_error('stop') AS id"), "slotwise_kept", path)
    assert spark.table("slotwise_kept").count() == 3
    assert tb.replace_table(spark.range(5), "slotwise_kept", path).count() == 5


def test_staging_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging.staging_path(spark, "x").startswith(f"{root}/{spark.sparkContext.applicationId}/x-")
    staged = staging.stage(spark.range(3), "numbers")
    assert staged.count() == 3 and staged.inputFiles()[0].startswith("file://" + root)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        staging.staging_root(Session())


def test_order_of_an_export_is_checked(spark, tmp_path):
    times = [f"2023-01-01T00:{m:02d}:00Z" for m in range(40)]
    df = spark.createDataFrame([(f"o{i}", 1, t) for i, t in enumerate(times)], "code string, zone_id bigint, at string")
    tb.write_allocation_input(df.repartitionByRange(3, "at").sortWithinPartitions("at"), str(tmp_path / "sorted"))
    got = tb.allocation_input_order(spark, str(tmp_path / "sorted")).first()
    assert (got.orders, got.first_time, got.last_time, got.out_of_order) == (40, times[0], times[-1], 0)
    assert len(glob.glob(str(tmp_path / "sorted" / "*.csv"))) > 1
    turned = df.coalesce(1).orderBy(F.desc("at")).coalesce(1)
    tb.write_allocation_input(turned, str(tmp_path / "turned"))
    assert tb.allocation_input_order(spark, str(tmp_path / "turned")).first().out_of_order == 39
    by_file = df.repartitionByRange(3, F.desc("at")).sortWithinPartitions("at")
    tb.write_allocation_input(by_file, str(tmp_path / "files"))
    assert tb.allocation_input_order(spark, str(tmp_path / "files")).first().out_of_order == 2
    tb.write_allocation_input(df.limit(0), str(tmp_path / "none"))
    assert tb.allocation_input_order(spark, str(tmp_path / "none")).first().orders == 0
