"""Validity on many days, against every pair compared."""

import datetime
import random

from codicil.operators import reader as R

FIRST = datetime.date(2019, 12, 20)


def _tables(spark):
    rng = random.Random(3)
    day = lambda n: FIRST + datetime.timedelta(n)
    end = lambda: None if rng.random() < 0.1 else day(rng.randrange(300))
    rows = [(i, i % 3, end(), end()) for i in range(200)] + [(200, 1, day(7), day(7)), (200, 1, day(7), day(7)), (201, 0, datetime.date(1, 1, 1), datetime.date(9999, 12, 31)), (202, None, None, None)]
    days = [(i % 3, day(n)) for i, n in enumerate(range(-5, 305))] + [(1, day(7)), (0, datetime.date(1, 1, 1)), (2, datetime.date(9999, 12, 31)), (2, None), (None, day(3))]
    schema = "id int, p int, effective_from date, effective_to date"
    return rows, days, spark.createDataFrame(rows, schema), spark.createDataFrame(days, "p int, day date")


def _valid(a, b, day):
    return day is not None and (a is None or a <= day) and (b is None or day <= b)


def test_every_pair_once(spark):
    rows, days, r, d = _tables(spark)
    want = sorted((p, str(day), i) for i, q, a, b in rows for p, day in days if p is not None and p == q and _valid(a, b, day))
    found = R.valid_on_days(r, d, "day", ["p"])
    assert found.columns == ["p", "day", "id", "effective_from", "effective_to"]
    assert sorted((x.p, str(x.day), x.id) for x in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_one_day_agrees_with_valid_on(spark):
    import pyspark.sql.functions as F

    _, _, r, _ = _tables(spark)
    day = FIRST + datetime.timedelta(30)
    one = spark.createDataFrame([(day,)], "day date")
    assert sorted(x.id for x in R.valid_on_days(r, one, "day", []).collect()) == sorted(x.id for x in R.valid_on(r, F.lit(day)).collect())


def test_counts(spark):
    rows, days, r, d = _tables(spark)
    want = sorted((str(p), str(day), sum(p is not None and p == q and _valid(a, b, day) for _, q, a, b in rows)) for p, day in days)
    assert sorted((str(x.p), str(x.day), x.n) for x in R.valid_counts(r, d, "day", ["p"]).collect()) == want
    assert R.valid_counts(r.limit(0), d, "day", ["p"]).agg({"n": "sum"}).first()[0] == 0
    assert R.valid_on_days(r, d.limit(0), "day", ["p"]).count() == 0
