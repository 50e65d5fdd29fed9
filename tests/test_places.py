"""Places in a total order against a window over all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.places import with_places


def test_places_equal_a_window_and_need_none(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 31 % 11).alias("key")).repartition(5)
    order = [F.col("key").desc_nulls_last(), F.col("id").asc()]

    def keep(df):
        df.write.parquet(str(tmp_path / "kept"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / "kept"))

    placed = with_places(rows, order, keep, ranges=6)
    assert "Window" not in placed._jdf.queryExecution().toString()
    want = rows.select("*", (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"))
    assert sorted(placed.collect()) == sorted(want.collect())


def test_places_of_no_rows_and_of_one_hot_key(spark, tmp_path):
    def keep_in(name):
        def keep(df):
            df.write.parquet(str(tmp_path / name))
            return spark.read.schema(df.schema).parquet(str(tmp_path / name))

        return keep

    assert with_places(spark.range(0), [F.col("id")], keep_in("none")).count() == 0
    hot = spark.range(3000).select(F.lit(1).alias("key"), "id").repartition(3)
    placed = with_places(hot, [F.col("key"), F.col("id")], keep_in("hot"), ranges=5)
    assert placed.where("place = id").count() == 3000
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "hot")).groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 1200  # the hot key is split by the rest of the order
