import datetime as dt

from spotloom.operators import demux
from spotloom.plans import domain
from spotloom.streaming import demux as stream


def test_stream_of_reads_gives_the_batch_result(spark, sf, tmp_path):
    r, c = domain.reads(spark, sf), domain.codes(spark, sf)
    r.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.demux_stream(src, c, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("TXUID", "probe_name")
    want = demux.demultiplex(r, c).select("TXUID", "probe_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counts_in_event_time_drop_what_is_too_late(spark, tmp_path):
    t0 = dt.datetime(2024, 3, 1)
    schema = "TXUID string, sample_id string, gene_name string, recorded_at timestamp_ntz, loaded_at timestamp_ntz"
    for i, hours in enumerate([[0, 0, 1], [9], [10], [0, 9, 30]]):
        rows = [(f"t{i}{k}", "s", "g", t0 + dt.timedelta(hours=h), t0) for k, h in enumerate(hours)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream.gene_counts_stream(src).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["start"]: r["counts"] for r in spark.table("counts").collect()}
    assert got == {t0: 2, t0 + dt.timedelta(hours=1): 1, t0 + dt.timedelta(hours=9): 2, t0 + dt.timedelta(hours=10): 1}


def test_redelivered_rows_come_once(spark, tmp_path):
    t0 = dt.datetime(2024, 3, 1)
    schema = "TXUID string, loaded_at timestamp_ntz"
    spark.createDataFrame([("a", t0), ("a", t0), ("b", t0)], schema).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.deduplicated_stream(src).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["TXUID"] for r in spark.table("once").collect()) == ["a", "b"]
