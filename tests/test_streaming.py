from pyspark.sql import functions as F

from sylva import model as M
from sylva.functions.vectors import from_blob, to_blob
from sylva.store import Store
from sylva.streaming.ingest import ingest


def test_epochs_commit_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        rows = [(f"n{k}-{j}", None, "kind", "name", "", "{}") for j in range(4)]
        spark.createDataFrame(rows, M.NODE_IN).coalesce(1).write.mode("append").parquet(source)
    with Store.open(spark, str(tmp_path / "s"), 4) as store:

        def run(checkpoint):
            stream = spark.readStream.schema(M.NODE_IN).option("maxFilesPerTrigger", 1).parquet(source)
            query = ingest(stream, store, "nodes", "files", str(tmp_path / checkpoint), availableNow=True)
            query.awaitTermination()
            assert query.exception() is None

        run("one")
        assert store.node_count() == 12 and store.generation() == 3 and store.stream_position("files") == 2
        run("two")  # all epochs are delivered again
        assert store.node_count() == 12 and store.generation() == 3


def test_blobs(spark):
    df = spark.createDataFrame([([1.0, -2.5],), ([],), (None,)], "v array<float>").withColumn("b", to_blob("v"))
    assert [r.w for r in df.select(from_blob("b").alias("w")).collect()] == [[1.0, -2.5], [], None]
    assert spark.createDataFrame([(b"abc",)], "b binary").select(from_blob("b")).first()[0] is None
