import datetime

from pyspark.sql import functions as F

from loomset.functions import scalars


def test_scalars(spark):
    row = spark.createDataFrame([("Žlutý Ñandú ß е́", "2024-02-30", "03/04/2021", [3.0, 4.0], [1, 5, 5], [("a", 2)])], "t string, bad string, day string, v array<double>, w array<int>, b array<struct<key:string,doc_count:bigint>>")
    found = row.select(
        scalars.strip_accents(F.col("t")).alias("t"), scalars.parse_date(F.col("bad")).alias("bad"), scalars.parse_date(F.col("day"), "yyyy-MM-dd", "MM/dd/yyyy").alias("day"), scalars.unit(F.col("v")).alias("v"),
        scalars.arg_max(F.col("w")).alias("w"), scalars.bucket_count(F.col("b"), "a").alias("a"), scalars.bucket_count(F.col("b"), "z").alias("z"), scalars.ratio(F.lit(1), F.lit(0)).alias("r"), scalars.filled(F.lit(None).cast("int"), -1).alias("f"),
    ).first()
    assert found.asDict() == {"t": "Zluty Nandu ß е", "bad": None, "day": datetime.date(2021, 3, 4), "v": [0.6, 0.8], "w": 1, "a": 2, "z": 0, "r": None, "f": -1}
