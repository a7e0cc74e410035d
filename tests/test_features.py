import pytest

from plumbline.operators.features import (
    category_values,
    class_counts,
    make_features,
    make_target,
    with_class_weights,
)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        [(1, "M", 1551, 42.8, 0), (2, "L", 1408, 46.3, 1), (3, None, 1500, 40.0, 0), (4, "H", 1, 2.0, 0)],
        "udi long, type string, rpm int, torque double, machine_failure int",
    )


def test_exact_columns_and_one_hot(raw):
    features = make_features(raw, "udi", ["rpm", "torque"], "type")
    assert features.columns == ["udi", "rpm", "torque", "type_H", "type_L", "type_M"]
    assert {t for n, t in features.dtypes if n != "udi"} == {"double"}
    rows = {r["udi"]: r for r in features.collect()}
    assert rows[1]["type_M"] == 1.0 and rows[1]["rpm"] == 1551.0
    for udi, r in rows.items():
        assert r["type_H"] + r["type_L"] + r["type_M"] == (0.0 if udi == 3 else 1.0)


def test_given_categories_need_no_job_and_unlisted_ones_are_zero(raw):
    features = make_features(raw, "udi", [], "type", categories=["L", "Z"])
    assert features.columns == ["udi", "type_L", "type_Z"]
    assert sum(r["type_L"] + r["type_Z"] for r in features.collect()) == 1.0


def test_too_many_categories_are_refused(spark):
    with pytest.raises(ValueError):
        category_values(spark.range(2000).selectExpr("cast(id as string) t"), "t")


def test_target_is_int_and_missing_values_fail(spark, raw):
    assert dict(make_target(raw, "machine_failure").dtypes)["machine_failure"] == "int"
    bad = spark.createDataFrame([(1.0,), (None,)], "y double")
    with pytest.raises(Exception, match="missing values"):
        make_target(bad, "y").collect()


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "y int")
    assert {r["y"]: r["n"] for r in class_counts(df, "y").collect()} == {0: 90, 1: 10}
    rows = with_class_weights(df, "y").collect()
    weights = {r["y"]: r["weight"] for r in rows}
    assert weights == {0: 100 / 180, 1: 100 / 20}
    assert sum(r["weight"] for r in rows if r["y"]) == pytest.approx(
        sum(r["weight"] for r in rows if not r["y"])
    )


def test_one_class_keeps_the_factor_two(spark):
    df = spark.createDataFrame([(0,)] * 4, "y int")
    assert {r["weight"] for r in with_class_weights(df, "y").collect()} == {0.5}
