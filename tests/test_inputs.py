import math

import pytest
from tidemark.operators import inputs as i

NAMES = ["rbp__a", "conn__a", "rbp__b", "x_rbp"]


def test_features_and_extras(spark):
    epochs = spark.createDataFrame([(1, 0, 10, [1.0, 2.0, 3.0, 4.0]), (2, 1, 11, [5.0, None, 7.0, 8.0]), (3, 1, 12, None)], "subject long, label int, epoch long, x array<double>")
    extras = spark.createDataFrame([(1, 70, 1.0), (3, None, 0.0)], "subject long, age int, sex double")
    got, names = i.assembled(epochs, NAMES, "^rbp", extras)
    assert names == ["rbp__a", "rbp__b", "age", "sex"] and got.columns == epochs.columns
    rows = {r.subject: r.x for r in got.collect()}
    assert rows[1] == [1.0, 3.0, 70.0, 1.0] and rows[2][:2] == [5.0, 7.0] and all(map(math.isnan, rows[2][2:])) and rows[3] is None
    got, names = i.assembled(epochs, NAMES, "__")
    assert names == NAMES[:3] and {r.subject: r.x for r in got.collect()}[2] == [5.0, None, 7.0]
    assert i.matching(NAMES, "rbp$") == [3] and i.assembled(epochs.limit(0), NAMES, "a", extras)[0].count() == 0


def test_errors(spark):
    epochs = spark.createDataFrame([(1, 0, 10, [1.0, 2.0])], "subject long, label int, epoch long, x array<double>")
    with pytest.raises(ValueError, match="no feature matches"):
        i.assembled(epochs, NAMES, "zzz")
    with pytest.raises(Exception, match="has not 4 features"):
        i.assembled(epochs, NAMES, "rbp")[0].collect()
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "subject long, age double")
    with pytest.raises(Exception, match="two rows of extras"):
        i.assembled(epochs, NAMES[:2], "rbp", twice)[0].collect()
