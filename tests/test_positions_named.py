"""Queries whose registered SQL orders by one number, on blocks of more than 1024 transactions, against SQL with wide numbers.

test_positions has the others; here blocks lie around the block that as-of queries ask for, and creates come twice.
"""

import duckdb
import pytest

from ledgerlens.plans import catalogue
from tests.test_positions import NARROW, WIDE


@pytest.fixture(scope="module")
def around(tmp_path_factory):
    """Block 1999: 1,200 senders with a create and an extend each. Block 2000: the last of them come first, some create again."""
    at = tmp_path_factory.mktemp("around")
    c = duckdb.connect()
    c.execute(
        f"""COPY (
          WITH rows AS (
            SELECT 1999 AS block, 10 * u + k AS second_us, u AS user_id, CASE k WHEN 0 THEN 'signup' ELSE 'view' END AS event_type FROM range(1200) t(u), range(2) r(k)
            UNION ALL SELECT 2000, 10 * (1200 - u) + k, u, CASE k WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' ELSE 'signup' END FROM range(600, 1200) t(u), range(4) r(k) WHERE k < 3 OR u % 5 = 0)
          SELECT row_number() OVER (ORDER BY block, second_us)::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(block::BIGINT * 600000000 + second_us) AS ts,
            user_id::BIGINT AS user_id, event_type, ((user_id * 7 + second_us * 13 + block) % 50)::DOUBLE AS value, '' AS props FROM rows) TO '{at}/events.parquet' (FORMAT parquet)"""
    )
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    return str(at), c


NAMED = ["camel_names", "create_nonces", "entity_count_by_owner", "expirable", "expiry_by_block", "feasibility", "q_at_block", "reorg_tail"]


@pytest.mark.parametrize("name", NAMED)
def test_order_is_right_around_the_block_asked_for(spark, around, name):
    at, oracle = around
    sql = catalogue.ORACLE_SQL[name].replace(NARROW, WIDE)
    df = catalogue.QUERIES[name](spark, at)
    names = sorted(df.columns)
    want = oracle.execute(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({sql})").fetchall()
    assert want and sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(map(str, want))
