"""Messages are made once and read a fixed number of times, however often a sink needs its tables."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import chain
from ledgerlens.plans import catalogue, catalogue_wire
from ledgerlens.sources.paths import Files
from ledgerlens.streaming import runner
from ledgerlens.streaming.store import LedgerStore

DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class Plans:
    """A sink that keeps the plans of its tables and where they are read from."""

    def commit(self, headers, ops, batch=None):
        self.plans, self.files, self.rows = [plan_of(headers), plan_of(ops)], [*headers.inputFiles(), *ops.inputFiles()], (headers.count(), ops.count())


def messages(spark, *values):
    return spark.createDataFrame([(json.dumps(v) if isinstance(v, dict) else v,) for v in values], "value string")


def test_a_sink_reads_tables_and_no_json(spark):
    sink, ops = Plans(), catalogue.valid_ops(spark, DIR)
    made = catalogue_wire.messages_of(ops)
    assert "Window" not in plan_of(made)  # what operations are made of isn't read again
    runner.apply_message(sink, made.select("value"))
    assert all("from_json" not in p and "jsontostructs" not in p.lower() for p in sink.plans)
    assert sink.rows == (ops.agg(F.max("block")).first()[0] + 1, ops.count())
    assert sink.files and not any(Files(spark).names(f.rsplit("/", 1)[0]) for f in sink.files)  # deleted after the answer


def test_every_block_has_one_message(spark):
    ops = catalogue.valid_ops(spark, DIR)
    got = {r.block: json.loads(r.value)["blocks"] for r in catalogue_wire.messages_of(ops).collect()}
    want = {r.block: r.n for r in ops.groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert sorted(got) == list(range(max(want) + 1)) and all(len(b) == 1 for b in got.values())
    assert {k: sum(len(t["operations"]) for t in b[0]["transactions"]) for k, b in got.items()} == {k: want.get(k, 0) for k in got}
    assert all(int(b[0]["header"]["number"], 16) == k for k, b in got.items())


def test_an_unreadable_message_leaves_nothing_behind(spark):
    before = Files(spark).names(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(chain.ChainError):
        runner.apply_message(Plans(), messages(spark, "no object"))
    assert Files(spark).names(spark.conf.get("spark.checkpoint.dir")) == before


def test_a_first_commit_reads_operations_for_what_is_stored_no_second_time(spark, tmp_path, monkeypatch):
    store, seen = LedgerStore(spark, str(tmp_path / "store")), []
    ops = catalogue.valid_ops(spark, DIR).withColumn("block_hash", F.lit("00"))
    headers = spark.createDataFrame([], "number long, hash string, parent_hash string, changeset_hash string, timestamp long")
    stored = store.ops()
    monkeypatch.setattr(type(stored), "join", lambda self, other, *a, _join=type(stored).join, **k: seen.append(self is stored) or _join(self, other, *a, **k))
    store._check_ops(headers, ops, stored, None, {"segments": []})
    assert seen and not any(seen)


def test_hex_text_without_its_mark(spark):
    from ledgerlens.sources import wire

    rows = spark.createDataFrame([("0xAB",), ("ab",), ("0x",), ("",), ("0x0xAB",), ("0XAB",), (None,)], "t string")
    want = rows.select(F.lower(F.regexp_replace("t", "^0x", ""))).collect()
    assert rows.select(wire.plain(F.col("t"))).collect() == want
