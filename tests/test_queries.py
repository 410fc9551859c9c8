"""Every named query against its SQL, and the plans of the core queries."""

import duckdb
import pytest

from floodsift.plans.catalog import QUERIES
from floodsift.plans.oracles import ORACLES

TABLES = ("events", "supplier")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    found = sql.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    places = [names.index(c) for c in columns]
    assert got == sorted((tuple(row[p] for p in places) for row in found.fetchall()), key=repr)


NARROW = [n for n in QUERIES if n.startswith("decode_")] + ["feature_vectors", "class_counts", "residues"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_decoding_needs_no_python_and_no_shuffle_before_aggregation(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Python" not in plan and "InPandas" not in plan and "Window" not in plan
    assert plan.count("Exchange") == (1 if name == "class_counts" else 0)


def test_feature_decoding_prunes_unused_fields(spark, sf_dir):
    plan = plan_of(QUERIES["feature_vectors"](spark, sf_dir))
    assert "udp_checksum" not in plan and "eth_dst_mac" not in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


@pytest.mark.parametrize("name", ["verdicts", "filtered_packets"])
def test_small_lookups_are_broadcast_and_packets_not_shuffled(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["packet_ordinals", "frames_to_words", "hashtab_replay"])
def test_running_values_never_use_one_window_for_a_whole_stream(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "SinglePartition" not in plan
    assert "_slice1" in plan
