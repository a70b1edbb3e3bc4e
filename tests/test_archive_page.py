"""Pages of the archive against the whole archive in order."""

import os

import pytest
from pyspark.sql import functions as F

from parley import fixtures as fx
from parley.operators import meetings
from parley.operators.ordering import positioned

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "by-day")
    m = fx.meetings_json(spark, SF)
    untimed = m.limit(3).withColumns({"meeting_ts": F.lit(None).cast("timestamp_ntz"), "id": F.concat(F.lit("x"), "id")})
    all_ = m.unionByName(untimed).persist()
    meetings.write_by_day(all_, path)
    whole = positioned(meetings.archive(all_), meetings.NEWEST_FIRST).orderBy("position").collect()
    return path, [tuple(r) for r in whole]


@pytest.mark.parametrize("page,size", [(1, 10), (4, 37), (9, 50), (1, 1000), (11, 40)])
def test_a_page_is_that_part_of_the_archive(spark, store, page, size):
    path, whole = store
    got = meetings.archive_page(spark, path, page, size).orderBy("position").collect()
    assert [tuple(r) for r in got] == whole[(page - 1) * size:page * size]


def test_pages_past_the_end_and_short_ones(spark, store, tmpdir_path):
    path, whole = store
    assert meetings.archive_page(spark, path, len(whole) + 1, 1).collect() == []
    other = os.path.join(tmpdir_path, "other")
    meetings.write_by_day(fx.meetings_json(spark, SF), other)
    assert len(meetings.archive_page(spark, other, 1, 5).collect()) == 5


def test_a_page_reads_the_files_of_its_days_only(spark, store):
    path, _ = store
    every = {f.rsplit("day=", 1)[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()}
    page = meetings.archive_page(spark, path, 2, 20)
    read = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read and read.count("day#") and len(every) > 20
    scans = [s for s in page._jdf.queryExecution().sparkPlan().collectLeaves().mkString("|").split("|") if "PartitionFilters" in s]
    listed = {p for p in every if p in scans[0].split("PartitionFilters")[1].split("PushedFilters")[0]}
    assert 1 <= len(listed) <= 3
