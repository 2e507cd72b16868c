"""Every registered query against its SQL, and the driver's contract."""

import pytest

from civitas.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, same_as_sql, name):
    same_as_sql(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name])


def test_entry_and_registration(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_model_scores_are_probabilities(spark, sf):
    rows = registry.QUERIES["gbt_train_predict"](spark, sf).collect()
    assert rows and all(0 <= r.prediction_value <= 1 and 0 <= r.confidence_score <= 1 for r in rows)


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = registry.QUERIES["recent_window_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan
    plan = registry.QUERIES["venue_by_id"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,42)" in plan


def test_band_joins_have_no_nested_loop(spark, sf):
    for name in ("nearest_demographic", "master_events", "master_venues"):
        assert "NestedLoop" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_map_layers_round_prices_between_two_steps_like_their_sql(spark, sf, same_as_sql, tmp_path):
    import duckdb

    for name in ("customer", "nation", "events"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    # every price whose share of 500,000 lies halfway between two thousandths
    duckdb.sql(f"COPY (SELECT o.* REPLACE (250.0 + 500 * i AS o_totalprice, i AS o_orderkey, 1 AS o_custkey) FROM (SELECT * FROM '{sf}/orders.parquet' LIMIT 1) o, range(1000) r(i)) TO '{tmp_path}/orders.parquet'")
    base = duckdb.connect()
    for name in ("customer", "nation", "events", "orders"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    base.execute(f"CREATE VIEW supplier AS SELECT * FROM '{sf}/supplier.parquet'")
    expected = dict(base.execute(f"SELECT id, tooltip FROM ({registry.ORACLE_SQL['map_layers']}) WHERE layer = 'prediction'").fetchall())
    got = {r.id: r.tooltip for r in registry.QUERIES["map_layers"](spark, str(tmp_path)).where("layer = 'prediction'").collect()}
    assert len(got) == 1000 and got == expected
