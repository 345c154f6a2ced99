import numpy as np

from corpusloom.operators.moments import dense_rows, moments
from corpusloom.streaming.statistics import follow, total


def test_streamed_moments_equal_those_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    schema = "doc_id long, v array<double>"
    for k in range(3):
        part = spark.createDataFrame([(10 * k + i, [float(x) for x in rng.normal(size=3)]) for i in range(10)], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = dense_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "v")
    follow(stream, 3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    whole = moments(dense_rows(spark.read.parquet(str(tmp_path / "in")), "v"), 3, [], bias=True)
    got = total(spark, str(tmp_path / "out"), 3)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    assert np.allclose(got.S, whole.S) and np.allclose(got.s, whole.s) and np.allclose(got.n, whole.n)
