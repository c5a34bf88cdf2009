import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerloom.operators import star


def test_running_before_equals_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), dt.datetime(2024, 1, rng.randint(1, 4), rng.randint(0, 23)), rng.choice([None, *range(9)])) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, u string, ts timestamp, v int")
    for how in ("max", "sum", "last"):
        got = {r.id: r.o for r in star.running_before(df, "u", ["ts", "id"], F.col("v"), how, "o").collect()}
        for user in "ab":
            seen = []
            for k, _, _, v in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
                there = [x for x in seen if x is not None]
                want = {"max": max(there, default=None), "sum": sum(there), "last": there[-1] if there else None}[how]
                assert got[k] == want
                seen.append(v)
    assert star.running_before(df.where("false"), "u", ["ts", "id"], F.col("v"), "max", "o").count() == 0
