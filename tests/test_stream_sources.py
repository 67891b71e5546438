"""Streams over tables that are one file or a folder of part files."""

import catalog

SF = "/root/testdata/sf0.001"


def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path):
    catalog.load_all()
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in ("stream_ingest", "stream_latest"):
        parts = {tuple(r) for r in catalog.QUERIES[query](spark, str(tmp_path)).collect()}
        assert parts and parts == {tuple(r) for r in catalog.QUERIES[query](spark, SF).collect()}
