"""Annual metrics: null keys, orphans, duplicates, missing tables, extrapolation."""

import datetime as dt

import pytest

from dailycast.operators import annual
from dailycast.sources.tables import Facts

D = dt.date


def orders(spark, rows):
    return spark.createDataFrame(rows, "order_id string, customer_id string, order_date date")


def items(spark, rows):
    return spark.createDataFrame(
        rows, "order_id string, quantity double, unit_price double, discount_amount double"
    )


@pytest.fixture(scope="module")
def facts(spark):
    return Facts(
        orders=orders(
            spark,
            [
                ("o1", "c1", D(2020, 1, 1)),
                ("o2", "c1", D(2021, 1, 1)),
                ("o3", "c2", D(2021, 5, 1)),
                ("o4", None, D(2021, 6, 1)),
                ("o5", "c3", None),
                ("o6", "c1", D(2021, 7, 1)),
            ],
        ),
        order_items=items(
            spark,
            [
                ("o1", 2.0, 10.0, 1.0),
                ("o2", 1.0, 30.0, 3.0),
                ("o2", 1.0, 5.0, None),
                ("o9", 9.0, 99.0, 9.0),  # no such order
                ("o5", 9.0, 99.0, 9.0),  # order without a date
            ],
        ),
        returns=spark.createDataFrame([("o2",), ("o2",), ("o3",), ("o9",)], "order_id string"),
        web_traffic=spark.createDataFrame(
            [(D(2019, 1, 1), 50), (D(2020, 1, 1), 100), (D(2020, 2, 1), 100), (D(2021, 1, 1), 150)],
            "date date, sessions long",
        ),
    )


def by_year(df):
    return {r["year"]: r.asDict() for r in df.collect()}


def test_metrics_by_hand(facts):
    got = by_year(annual.annual_metrics(facts))
    assert set(got) == {2020, 2021}  # the years of the orders
    assert got[2020] == {
        "year": 2020, "annual_unique_customers": 1.0, "annual_total_orders": 1.0,
        "annual_new_customer_rate": 1.0, "annual_aov": 20.0, "annual_discount_intensity": 0.05,
        "annual_return_rate": None, "annual_sessions": 200.0, "annual_sessions_growth": 3.0,
    }
    assert got[2021] == {
        "year": 2021, "annual_unique_customers": 2.0, "annual_total_orders": 4.0,
        "annual_new_customer_rate": 0.25, "annual_aov": 35.0 / 4,
        "annual_discount_intensity": 3.0 / 35.0, "annual_return_rate": 0.5,
        "annual_sessions": 150.0, "annual_sessions_growth": -0.25,
    }


def test_optional_tables(facts):
    full = set(annual.ORDER_METRICS)
    bare = annual.annual_metrics(Facts(orders=facts.orders))
    assert set(bare.columns) == {"year"} | full
    assert by_year(bare)[2021]["annual_aov"] is None
    no_orders = annual.annual_metrics(
        Facts(order_items=facts.order_items, returns=facts.returns, web_traffic=facts.web_traffic)
    )
    assert no_orders.columns == ["year", *annual.TRAFFIC_METRICS]
    assert set(by_year(no_orders)) == {2019, 2020, 2021}
    assert annual.annual_metrics(Facts(order_items=facts.order_items)) is None


def test_duplicate_order_headers_do_not_multiply_lines(spark, facts):
    twice = orders(spark, [("o1", "c1", D(2020, 1, 1)), ("o1", "c1", D(2020, 3, 1))])
    got = annual.order_values(twice, facts.order_items).collect()
    assert [tuple(r) for r in got] == [(2020, 20.0, 1.0)]
    across = orders(spark, [("o1", "c1", D(2020, 1, 1)), ("o1", "c1", D(2021, 3, 1))])
    got = annual.order_values(across, facts.order_items).collect()
    assert sorted(tuple(r) for r in got) == [(2020, 20.0, 1.0), (2021, 20.0, 1.0)]


def test_zero_value_year(spark):
    o = orders(spark, [("o1", "c1", D(2020, 1, 1))])
    got = annual.annual_metrics(Facts(o, items(spark, [("o1", 0.0, 0.0, 0.0)]))).first()
    assert got["annual_aov"] == 0.0 and got["annual_discount_intensity"] is None


def test_hot_customer_and_order(spark):
    """A third of all orders from one customer, a third of all lines in one order."""
    rows = [(f"h{i}", "hot", D(2020 + i % 2, 1, 1)) for i in range(300)]
    rows += [(f"o{i}", f"c{i}", D(2020 + i % 2, 1, 1)) for i in range(600)]
    lines = [("h0", 1.0, 1.0, 0.0)] * 300 + [(f"o{i}", 1.0, 1.0, 0.0) for i in range(600)]
    got = by_year(annual.annual_metrics(Facts(orders(spark, rows), items(spark, lines))))
    assert got[2020]["annual_unique_customers"] == 301.0
    assert got[2020]["annual_aov"] == (300 + 300) / 450
    assert got[2021]["annual_new_customer_rate"] == 300 / 450


def test_extrapolation_repeats_the_tail_mean(spark):
    m = spark.createDataFrame(
        [(2015, 1.0, None), (2016, 2.0, 5.0), (2018, 4.0, None), (2019, 6.0, None)],
        "year int, a double, b double",
    )
    years = spark.createDataFrame([(2019,), (2020,), (2021,)], "year int")
    got = by_year(annual.extrapolate(m, years))
    assert got[2020] == {"year": 2020, "a": 4.0, "b": 5.0}
    assert got[2021] == {"year": 2021, "a": 4.0, "b": 5.0}
    assert got[2019]["a"] == 6.0 and len(got) == 6


def test_tail_of_two_years(spark):
    m = spark.createDataFrame([(2019, 1.0), (2020, 2.0)], "year int, a double")
    assert annual.tail_means(m).first()["a"] == 1.5
