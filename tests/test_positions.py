"""Blocks of more than 1024 transactions and transactions of more than 1024 operations.

The registered SQL packs a place into one number; here it's given wide numbers, so that it's right for these blocks too.
"""

import duckdb
import pytest
from pyspark.errors import PySparkException

from ledgerlens.plans import catalogue

NARROW, WIDE = "block * 1048576 + tx_index * 1024 + op_index", "(block::HUGEINT * 1073741824 + tx_index) * 1073741824 + op_index"


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Block 0: sender 0 has 1,100 operations, then 1,200 senders a create and an extend each. Block 1: the last of them come first."""
    at = tmp_path_factory.mktemp("crowded")
    c = duckdb.connect()
    c.execute(
        f"""COPY (
          WITH rows AS (
            SELECT 0 AS block, i AS second_us, 0 AS user_id, CASE WHEN i = 0 THEN 'signup' WHEN i % 3 = 0 THEN 'view' WHEN i % 3 = 1 THEN 'click' ELSE 'purchase' END AS event_type FROM range(1100) t(i)
            UNION ALL SELECT 0, 2000 + 10 * u + k, u, CASE k WHEN 0 THEN 'signup' ELSE 'view' END FROM range(1, 1201) t(u), range(2) r(k)
            UNION ALL SELECT 1, 10 * (1200 - u) + k, u, CASE k WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END FROM range(600, 1201) t(u), range(3) r(k))
          SELECT row_number() OVER (ORDER BY block, second_us)::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_microseconds((block * 600000000 + second_us)::BIGINT) AS ts,
            user_id::BIGINT AS user_id, event_type, ((user_id * 7 + second_us * 13 + block) % 50)::DOUBLE AS value, '' AS props FROM rows) TO '{at}/events.parquet' (FORMAT parquet)"""
    )
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    return str(at), c


EXACT = [
    "entity_latest", "state_as_of", "stream_commit", "commit_split", "revert_tail", "chain_verify", "chain_head_hash", "block_headers", "batch_refs", "extend_monotonicity", "history_depth", "tracked_entities", "state_digest",
    "entity_history_places", "event_pair_places",
]


@pytest.mark.parametrize("name", EXACT)
def test_order_is_right_in_crowded_blocks(spark, crowded, name):
    at, oracle = crowded
    sql = catalogue.ORACLE_SQL[name].replace(NARROW, WIDE).replace("position // 1024", "position // 1073741824")
    df = catalogue.QUERIES[name](spark, at)
    names = sorted(df.columns)
    want = oracle.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["entity_history_scd2", "event_pair_quarantine"])
def test_a_place_that_one_number_does_not_hold_is_an_error(spark, crowded, name):
    with pytest.raises(PySparkException, match="1024 or more"):
        catalogue.QUERIES[name](spark, crowded[0]).collect()
