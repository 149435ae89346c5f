"""Array functions against plain Python."""

import random
import re

from pyspark.sql import functions as F

from foliomill.functions.arrays import matches_of, sums_before


def test_sums_before(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(9) for _ in range(n)]) for i, n in enumerate([0, 1, 63, 64, 65, 128, 129, 1000, 5000])] + [(99, None)]
    for x in spark.createDataFrame(rows, "i int, a array<int>").select("a", sums_before(F.col("a")).alias("b")).collect():
        assert x.b == (None if x.a is None else [sum(x.a[:k]) for k in range(len(x.a))])


def test_matches(spark):
    texts = ["ab1c22é333", "", "xyz", "1", "\U0001f6001 2", " ".join(map(str, range(500)))]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(matches_of(F.col("t"), "[0-9]+").alias("m")).collect()
    for t, row in zip(texts, got, strict=False):
        want = [(x.start(), x.end(), x[0]) for x in re.finditer("[0-9]+", t)]
        assert [(m.s, m.e, m.m) for m in row.m or []] == want
        assert all(t[: m.s].endswith(m.left) and t[m.e :].startswith(m.right) for m in row.m or [])
    assert got[-1].m is None
