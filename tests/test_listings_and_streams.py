"""Text listings, and windows over a stream of files."""

from __future__ import annotations

from orogena.sources import listings
from orogena.streaming import windows


def test_areas(spark, tmp_path):
    (tmp_path / "areas.list").write_text("# x\n63240001: 2144256,-3411968 to 2162688,-3397632\n#       : 1,2 to 3,4\n\n")
    assert [tuple(r) for r in listings.read_areas(spark, f"file://{tmp_path}/areas.list").collect()] == [(63240001, 2144256, -3411968, 2162688, -3397632)]


def test_tile_list(spark, tmp_path):
    (tmp_path / "t.txt").write_text("X_10_N44_00_E033_00_DEM/\nX_10_S34_00_W071_00_DEM\nX_10_N44_00_E033_00_DEM\n")
    assert sorted(tuple(r) for r in listings.read_tile_list(spark, f"file://{tmp_path}/t.txt").collect()) == [(-34, -71), (44, 33)]


def test_coverage(spark):
    html = "<AREA href=\"a.zip\" title='A'><area href=b.zip title=\"B\"><area shape=rect><a href='c'>"
    got = listings.coverage(spark.createDataFrame([(html,)], "html string"))
    assert [tuple(r) for r in got.collect()] == [("a.zip", "A"), ("b.zip", "B")]


def test_rules(spark, tmp_path):
    (tmp_path / "lines").write_text("# c\nhighway=track &\n  surface=* {name 'x'} [0x0f resolution 22 continue]\nnatural=cliff [0x10a level 3]\n<finalize>\nx=y [0x01 resolution 1]\n")
    got = [tuple(r)[1:] for r in listings.read_rules(spark, f"file://{tmp_path}/lines").orderBy("ord").collect()]
    assert got == [(0, "highway=track & surface=*", 15, 22, True), (1, "natural=cliff", 266, 3, False)]


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = windows.windowed_counts(stream, "event_type", late="40 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(spark.table("counts").collect()) == key(windows.windowed_counts(events, "event_type").collect())
    assert sum(r.n for r in windows.sessions(events, "user_id").collect()) == events.count()
