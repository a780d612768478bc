import datetime as dt

import pytest
from pyspark.sql import functions as F

from areaweek.operators import panel as p
from areaweek.operators.pointprocess import HawkesParameters
from areaweek.plans.features import build_panel

WEEKS = p.WeekRange("2024-01-01", "2024-02-05")
PAR = HawkesParameters(0.7, 0.5, 0.8, 0.1)


def series(spark, values):
    rows = [("A", i, float(v)) for i, v in enumerate(values)]
    return p.prior_sums(spark.createDataFrame(rows, "lga_code string, week_index int, events double"), ["events"])


def column(df, expression):
    return [r[1] for r in sorted(df.select("week_index", expression.alias("v")).collect())]


def test_windows_leave_out_the_current_week(spark):
    df = series(spark, [0, 1, 0, 0, 2, 0])
    assert column(df, p.lag_sum("events", 1)) == [0, 0, 1, 0, 0, 2]
    assert column(df, p.lag_sum("events", 4)) == [0, 0, 1, 1, 1, 3]


def test_gap_counts_from_the_last_earlier_event(spark):
    df = series(spark, [0, 1, 0, 0, 1, 0])
    assert column(df, p.weeks_since("events", 10)) == [10, 10, 1, 2, 3, 1]


def test_rate_divides_by_weeks_including_this_one(spark):
    assert column(series(spark, [2, 0, 1]), p.historical_rate()) == [0, 1, pytest.approx(2 / 3)]


@pytest.fixture(scope="module")
def toy(spark):
    registry = spark.createDataFrame(
        [("A", "Aville", "S1", "Alpha", "Z", None, 10.0, 1.0, 1.0), ("B", "Bville", "S1", "Alpha", "Z", None, 20.0, 1.0, 2.0)],
        "lga_code string, lga_name string, state_code string, state_name string, zone string, senatorial_district string, area_sqkm double, centre_lat double, centre_lon double",
    )
    adjacency = spark.createDataFrame([("A", "B", 1.0), ("B", "A", 1.0)], "lga_code string, neighbour_code string, weight double")
    return registry, adjacency


def events(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", dt.date.fromisoformat(d), c, u, "Alpha", f, "X", a) for i, (d, c, u, f, a) in enumerate(rows)],
        "event_id string, event_date date, event_class string, lga_code string, state_name string, fatalities int, actor_primary string, actor_secondary string",
    )


T, O = "banditry_kidnapping", "state_operation"
ROWS = [("2024-01-02", T, "A", 3, "g1"), ("2024-01-03", T, "A", None, "g2"), ("2024-01-10", T, "B", 1, None), ("2024-01-20", T, "A", 2, "g1"), ("2024-01-23", O, "B", 0, "g1")]


def test_toy_panel(spark, toy):
    registry, adjacency = toy
    frame = build_panel(events(spark, ROWS + [("2024-01-05", T, "nowhere", 9, "g")]), registry, adjacency, WEEKS)
    rows = {(r.lga_code, r.week_index): r for r in frame.collect()}
    assert len(rows) == 2 * 6
    a, b = rows["A", 1], rows["B", 2]
    assert (a.own_events_1w, a.own_fatalities_4w, a.label, a.weeks_since_event) == (2, 3, 0, 1)
    assert (b.own_events_1w, b.nb_events_4w, b.label, b.state_events_4w) == (1, 2, 0, 3)
    assert rows["A", 0].label == 1 and rows["A", 0].own_events_52w == 0
    assert rows["A", 4].nb_ops_4w == 1 and rows["B", 4].own_ops_4w == 1
    # Two distinct actors at A, and the neighbour's one at B.
    assert rows["A", 2].actors_26w == 3
    assert rows["A", 0].n_neighbours == 1


def test_later_events_never_change_a_feature(spark, toy):
    registry, adjacency = toy
    kwargs = dict(hawkes=PAR, fit_end="2024-01-14")
    base = build_panel(events(spark, ROWS), registry, adjacency, WEEKS, **kwargs)
    more = build_panel(events(spark, ROWS + [("2024-01-22", T, "A", 5, "g9"), ("2024-02-01", T, "B", 5, "g9")]), registry, adjacency, WEEKS, **kwargs)
    pick = lambda df: sorted(map(tuple, df.where("week_start <= '2024-01-22'").drop("label").select(*sorted(df.drop("label").columns)).collect()))
    assert pick(base) == pick(more)


def test_full_history_baseline_is_kept_as_an_option(spark, toy):
    registry, adjacency = toy
    frame = build_panel(events(spark, ROWS), registry, adjacency, WEEKS, hawkes=PAR, fit_end="2024-01-14", baseline="full")
    row = frame.where("lga_code = 'A' and week_index = 0").first()
    assert row.hawkes_background == pytest.approx(0.7 * 3.5 / 35)


def test_distinct_actors_count_once_over_the_window(spark, toy):
    registry, _ = toy
    out = p.true_distinct_actors(events(spark, ROWS), registry, WEEKS, 2)
    got = {(r.lga_code, r.week_index): r.distinct_actors_2w for r in out.collect()}
    assert [got["A", i] for i in range(6)] == [0, 2, 2, 1, 1, 0]


def test_duplicate_edges_and_zero_weights(spark):
    adjacency = spark.createDataFrame([("A", "B", 1.0), ("A", "B", 1.0), ("A", "C", 0.0)], "lga_code string, neighbour_code string, weight double")
    assert [tuple(r) for r in p.degree(adjacency).collect()] == [("A", 1)]


def test_dense_rows_are_not_shuffled(spark, toy):
    registry, _ = toy
    dense = p.dense_facts([p.weekly_events(events(spark, ROWS))], registry, ("events",), WEEKS).select("lga_code", p.lag_sum("events", 4).alias("x"))
    plan = dense._jdf.queryExecution().executedPlan().toString()
    after_generate = plan[: plan.index("Generate explode(sequence")]
    assert "Exchange" not in after_generate


def test_week_filter_is_a_plain_date_range(spark):
    days = spark.createDataFrame([(dt.date(2023, 12, 31),), (dt.date(2024, 1, 1),), (dt.date(2024, 2, 11),), (dt.date(2024, 2, 12),)], "d date")
    assert days.where(WEEKS.contains(F.col("d"))).count() == 2
