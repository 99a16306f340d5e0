from pyspark.sql import functions as F

from vesper import streaming
from vesper.operators import index, recognise
from vesper.sources import records


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def test_append_and_learn(spark, tmp_path):
    path, source, members = (str(tmp_path / p) for p in ("table", "source", "members"))
    records.write(records.filled(spark, 10), path)
    records.filled(spark, 5).write.parquet(source)
    stream = spark.readStream.schema(records.SCHEMA).parquet(source)
    run(streaming.append_records(stream, path, str(tmp_path / "c1")))
    assert [r.row_id for r in records.read(spark, path).orderBy("row_id").collect()] == list(range(15))
    rows = spark.createDataFrame([(i, *[[i * 7919 % 1024]] * 4) for i in range(20)], "row_id long, meta array<bigint>, cam array<bigint>, btree array<bigint>, embed array<bigint>")
    clusters, _ = index.build(rows, 5)
    source2 = str(tmp_path / "source2")
    rows.where("row_id < 6").write.parquet(source2)
    radii = str(tmp_path / "radii")
    run(streaming.learn_records(spark.readStream.schema(rows.schema).parquet(source2), clusters, members, radii, str(tmp_path / "c2")))
    got = spark.read.parquet(members)
    assert {(r.channel, r.n) for r in got.groupBy("channel").agg(F.count("*").alias("n")).collect()} == {("cam", 6), ("btree", 6), ("embed", 6)}


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:01:00", "b"), ("2024-01-01 00:01:30", "c"), ("2024-01-01 01:00:00", "a")], "ts string, item string").withColumn("ts", F.to_timestamp("ts"))
    windows = streaming.windowed_cooccurrence(events, "ts", "item", "5 minutes")
    assert sorted((r.i, r.j) for r in streaming.pairs_of(windows).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_running_means(spark, tmp_path):
    classes = spark.createDataFrame([(0, 1, [10, -10]), (1, 2, [0, 0])], "class_idx int, class_id long, template array<int>")
    examples = spark.createDataFrame([(0, [20, -20]), (1, [3, 4])], "class_idx int, vec array<int>")
    source, sums = str(tmp_path / "examples"), str(tmp_path / "sums")
    examples.write.parquet(source)
    run(streaming.learn_classes(spark.readStream.schema(examples.schema).parquet(source), classes, sums, str(tmp_path / "c")))
    got = {r.class_idx: r.template for r in streaming.learnt_classes(classes, spark.read.parquet(sums)).collect()}
    assert got == {r.class_idx: r.template for r in recognise.learn(classes, examples).collect()} == {0: [15, -15], 1: [2, 2]}


def test_learnt_rows_beyond_the_old_radius_are_found(spark, tmp_path):
    schema = "row_id long, meta array<bigint>, cam array<bigint>, btree array<bigint>, embed array<bigint>"
    rows = spark.createDataFrame([(i, *[[i]] * 4) for i in (0, 1, 2, 1 << 40, (1 << 40) + 1)], schema)
    clusters, members = index.build(rows, 2)
    far = spark.createDataFrame([(100, *[[(1 << 20) - 1]] * 4)], schema)
    source, held, radii = (str(tmp_path / p) for p in ("source", "members", "radii"))
    far.write.parquet(source)
    writer = streaming.learn_records(spark.readStream.schema(rows.schema).parquet(source), clusters, held, radii, str(tmp_path / "c"), update_meta=True)
    run(writer)
    asked = far.withColumnRenamed("row_id", "query_id")
    every = rows.unionByName(far)
    now = streaming.grown(clusters, radii)
    found = index.search_many(every, now, streaming.with_members(members, held), asked, "meta", 2)
    assert [(r.row_id, r.dist) for r in found.collect()] == [(100, 0)]
    assert index.search_set(every, now, streaming.with_members(members, held), asked, (2, 2, 2, 2))[0].count() == 1
    # the old radii would have lost it
    assert now.agg(F.max("radius")).first()[0] > clusters.agg(F.max("radius")).first()[0]


def test_retried_batches_count_once(spark, tmp_path):
    path, source, sums = (str(tmp_path / p) for p in ("table", "source", "sums"))
    records.write(records.filled(spark, 3), path)
    records.filled(spark, 2).write.parquet(source)
    examples = spark.createDataFrame([(0, [1, 2])], "class_idx int, vec array<int>")
    examples.write.parquet(str(tmp_path / "examples"))
    for name, make in (("c1", lambda c: streaming.append_records(spark.readStream.schema(records.SCHEMA).parquet(source), path, c)), ("c2", lambda c: streaming.learn_classes(spark.readStream.schema(examples.schema).parquet(str(tmp_path / "examples")), examples, sums, c))):
        checkpoint = tmp_path / name
        run(make(str(checkpoint)))
        # the stream's commit is lost, and the batch comes again
        for f in (checkpoint / "commits").iterdir():
            f.unlink()
        run(make(str(checkpoint)))
    assert records.read(spark, path).count() == 5
    assert spark.read.parquet(sums).agg(F.sum("n")).first()[0] == 2
