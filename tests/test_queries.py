"""Every registered query with SQL gives a second engine's rows; the others run."""

import decimal
import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from curvelake.operators import metrics
from curvelake.plans import registry, sql_text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(sql_text.SQL))
def test_against_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    rel = con.sql(sql_text.SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(x) for x in r) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["gc_spline_fit", "gc_model_fit", "gc_boot", "curve_payload", "lowess_smooth", "dr_fit", "dr_boot"])
def test_fits_are_dealt_to_tasks(spark, sf, name):
    """Small shuffles aren't put together: as many tasks take part as there are curves or tests, two a core at most."""
    rows = registry.queries()[name](spark, sf)
    tasks = rows.groupBy(F.spark_partition_id()).count().count() if name != "dr_boot" else rows.rdd.getNumPartitions()
    keys = registry._obs(spark, sf).select("curve_key" if not name.startswith("dr") else "test_id").distinct().count()
    assert tasks >= min(keys, spark.sparkContext.defaultParallelism) // 3


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(sql_text.SQL)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_train_predict_is_whole(spark, sf, monkeypatch):
    """The registered query trains on all 900 synthetic curves with the ensemble's own sizes."""
    from curvelake.ml import classifier

    class Seen(Exception):
        pass

    def boosting(*args, rounds, **options):
        raise Seen(rounds)

    curves, sizes = [], []
    train = classifier.train
    monkeypatch.setattr(classifier, "train", lambda table, **options: (curves.append(table.select("base_curve_id").distinct().count()), train(table, **options)))
    monkeypatch.setattr(classifier.T, "fit_forest", lambda *args, trees, **options: sizes.append(trees))
    monkeypatch.setattr(classifier.T, "fit_boosting", boosting)
    with pytest.raises(Seen) as found:
        registry.queries()["train_predict"](spark, sf)
    assert curves == [900] and sizes == [600] and found.value.args == (100,)


def rows_by_both(spark, d, name):
    """Rows of the query and of its SQL over the events in a folder."""
    df = registry.queries()[name](spark, str(d))
    columns = sorted(df.columns)
    found = duckdb.connect()
    found.sql(f"create view events as select * from '{d}/events.parquet'")
    want = found.sql(sql_text.SQL[name]).select(*(f'"{c}"' for c in columns)).fetchall()
    return tuple(sorted((tuple(plain(x) for x in r) for r in rows), key=repr) for rows in (df.select(*columns).collect(), want))


def write_events(d, users, values):
    """Made-up events: users in turn at random times of 30 days."""
    n, r = len(users), np.random.default_rng(5)
    ts = np.datetime64("2024-01-01", "us") + np.sort(r.integers(0, 30 * 86_400_000_000, n)).astype("timedelta64[us]")
    pq.write_table(pa.table({"event_id": np.arange(n), "ts": pa.array(ts), "user_id": users, "event_type": ["view"] * n, "value": values, "props": ["{}"] * n}), f"{d}/events.parquet")


def test_straight_stretches_tie_as_in_sql(spark, tmp_path):
    """Few events a curve: many grid steps lie on one line, and last bits decide where the slope is largest."""
    r = np.random.default_rng(6)
    write_events(tmp_path, r.integers(0, 300, 2400), r.exponential(50, 2400).round(2))
    got, want = rows_by_both(spark, tmp_path, "truncated_features")
    assert got == want


def test_numbers_below_a_half_round_as_in_sql(spark):
    values = [0.11562499999999999, 0.115625, -0.11562499999999999, 0.115624, 2.0, None]
    got = [r.v for r in registry._rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1), 5).orderBy("i").collect()]
    assert got == [r[0] for r in duckdb.sql("select round(unnest(?)::DOUBLE, 5)", params=[values]).fetchall()] == [0.11563, 0.11563, -0.11563, 0.11562, 2.0, None]


def test_bootstrap_draws_stay_beside_their_curve(spark, sf):
    """Fifty draws a point are neither joined nor broadcast: the driver would hold them all."""
    df = registry.queries()["bootstrap_mean_ci"](spark, sf)
    df.collect()
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_resampled_means_equal_loops(spark):
    curves = {"a": [2.5], "b": [1.0, None, 3.0, 10.0, 4.5], "c": [None]}
    points = spark.createDataFrame([(k, i, v) for k, values in curves.items() for i, v in enumerate(values)][::-1], "k string, ix int, v double")
    got = {(r.k, r.replicate): r.m for r in metrics.resampled_means(points, "k", "ix", "v", 4).collect()}
    for k, values in curves.items():
        for r in range(4):
            drawn = [values[int(hashlib.md5(f"42|{k}|{r}|{d}".encode()).hexdigest()[:8], 16) % len(values)] for d in range(len(values))]
            drawn = [v for v in drawn if v is not None]
            assert got.pop((k, r)) == (pytest.approx(sum(drawn) / len(drawn)) if drawn else None)
    assert not got
