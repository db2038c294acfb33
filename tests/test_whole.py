"""Queries that give all of their rows."""

from ledgerlens.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_commitments_of_all_entities(spark):
    got = catalogue.QUERIES["commitment"](spark, DIR).collect()
    want = catalogue.QUERIES["entity_latest"](spark, DIR).collect()
    assert sorted(r.entity_key for r in got) == sorted(r.entity_key for r in want)
    assert {r.creator % 7 for r in got} == set(range(7))


def test_status_of_all_operations(spark):
    got = catalogue.QUERIES["status_report"](spark, DIR).collect()
    assert sum(r.sent for r in got) == spark.read.parquet(f"{DIR}/events.parquet").count()
    known = catalogue.QUERIES["state_counters"](spark, DIR).first()
    assert {r.alive + r.expired_queue for r in got} == {known.alive} and all(r.in_flight > 0 for r in got)
