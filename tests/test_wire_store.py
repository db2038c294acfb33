"""Stores and other sinks that messages fill, with entities and hashes checked."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_ledger import ATTRIBUTES, KEY, LINK, OWNER, block, messages, op

from ledgerlens.functions.digest import keccak_many
from ledgerlens.operators import chain, state
from ledgerlens.plans import api
from ledgerlens.sources import blocks, wire
from ledgerlens.sources.paths import Files
from ledgerlens.streaming import runner, settings, sinks
from ledgerlens.streaming.store import LedgerStore

OTHER = "cd" * 20


def hashed(found, start=chain.ZERO):
    """Blocks with the rolling hashes that their operations give, by Keccak-256."""
    h = bytes.fromhex(start)
    for b in found:
        for t in b["transactions"]:
            for o in t["operations"]:
                h = keccak_many([h + bytes.fromhex(o["entityKey"][2:]) + bytes.fromhex(o["entityHash"][2:])])[0]
                o["changesetHash"] = "0x" + h.hex()
        b["header"]["changesetHash"] = "0x" + h.hex()
    return found


def test_what_messages_carry_is_kept(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    create = op("create", 0, expiresAt="0x64", payload="0x00ff", contentType="text/plain", attributes=ATTRIBUTES)
    other = op("create", 0, key=LINK, owner="0x" + OTHER, expiresAt="0x65", payload="0x")
    runner.apply_message(store, messages(spark, {"blocks": [block(5, [[create, op("transfer", 1, owner="0x" + OTHER)], [other]]), block(6, [])]}))
    runner.apply_message(store, messages(spark, {"blocks": [block(7, [[op("update", 0, key=LINK, payload="0xab", contentType="image/png", attributes=ATTRIBUTES[1:2])]])]}))
    reads = api.Ledger(store.ops(), store.headers())
    rows = {r.key: r for r in reads.query("$all", api.Options(fields=("key", "owner", "contentType", "payload", "attributes", "expiresAt"))).collect()}
    assert rows[KEY].owner == OTHER and rows[KEY].payload == b"\x00\xff" and rows[KEY].expiresAt == 100
    assert [tuple(a) for a in rows[KEY].attributes] == [("linked.to", "entityKey", LINK), ("priority", "uint", "7"), ("title", "string", "hé")]
    assert (rows[LINK].contentType, rows[LINK].payload, rows[LINK].expiresAt) == ("image/png", b"\xab", 101)
    of = lambda text, at=None: sorted(r.key for r in reads.query(text, api.Options(at_block=at)).collect())
    assert of(f"$owner = 0x{OTHER}") == sorted([KEY, LINK]) and of('title = "hé"') == [KEY] and of('$contentType = "image/png"', 6) == []
    assert state.latest(store.ops()).filter(F.col("creator") == OWNER.lower()).count() == 2
    before = sorted(map(str, store.ops().collect()))
    assert store.compact() == 3 and len(store._manifest()["segments"]) == 1 and sorted(map(str, store.ops().collect())) == before
    assert store.head()["number"] == 7 and store.used().first().asDict() == {"operations": 4, "blocks": 3}


def test_unknown_entities_are_refused(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))

    def code(*txs, number=1, tag="a", parent=None, **more):
        with pytest.raises(chain.ChainError) as e:
            runner.apply_message(store, messages(spark, {"blocks": [block(number, txs, tag, parent)]} | more))
        return e.value.code, e.value.data.get("entity_key")

    assert code([op("delete", 0)]) == (chain.UNKNOWN_ENTITY, KEY)
    assert code([op("create", 0), op("delete", 1)], [op("extend", 0, expiresAt="0x9")]) == (chain.UNKNOWN_ENTITY, KEY)
    assert code([op("update", 0)], [op("create", 0)]) == (chain.UNKNOWN_ENTITY, KEY)
    assert store.head() is None
    runner.apply_message(store, messages(spark, {"blocks": [block(1, [[op("create", 0, expiresAt="0x9")]])]}))
    assert code([op("delete", 0, key=LINK)], number=2) == (chain.UNKNOWN_ENTITY, LINK)
    runner.apply_message(store, messages(spark, {"blocks": [block(2, [[op("delete", 0)]])]}))
    assert code([op("expire", 0)], number=3) == (chain.UNKNOWN_ENTITY, KEY)
    gone = {"revertedBlocks": [{"number": "0x2", "hash": block(2, [])["header"]["hash"]}], "newBlocks": [block(2, [[op("extend", 0, expiresAt="0xa")]], "b", "a")]}
    runner.apply_message(store, messages(spark, gone))  # the delete went with its block
    assert state.latest(store.ops()).first().expires_at == 10
    with pytest.raises(chain.ChainError) as e:
        runner.apply_message(store, messages(spark, "no object"))
    assert e.value.code == chain.INTERNAL


def test_hashes_are_checked_with_keccak(spark, tmp_path):
    made = lambda: hashed([block(1, [[op("create", 0), op("extend", 1)], [op("update", 0)]]), block(2, []), block(3, [[op("delete", 0)]])])
    store = LedgerStore(spark, str(tmp_path / "good"), digest=chain.keccak_hex)
    first, rest = made()[:2], made()[2:]
    runner.apply_message(store, messages(spark, {"blocks": first}))
    runner.apply_message(store, messages(spark, {"blocks": rest}))
    assert store.head()["changeset_hash"] == rest[0]["header"]["changesetHash"][2:]
    for k, spoil in enumerate(
        (
            lambda b: b[0]["transactions"][0]["operations"][1].update(changesetHash="0x" + "00" * 32),
            lambda b: b[0]["transactions"][1]["operations"][0].update(entityHash="0x" + "00" * 32),
            lambda b: b[1]["header"].update(changesetHash="0x" + "00" * 32),
            lambda b: b[2]["header"].update(changesetHash=None),
        )
    ):
        bad = made()
        spoil(bad)
        with pytest.raises(chain.ChainError) as e:
            runner.apply_message(LedgerStore(spark, str(tmp_path / f"bad{k}"), digest=chain.keccak_hex), messages(spark, {"blocks": bad}))
        assert e.value.code == chain.CHANGESET_MISMATCH


def test_rolling_keccak_is_a_fold(spark):
    r = random.Random(4)
    rows = [(b, p, f"{r.getrandbits(256):064x}", f"{r.getrandbits(256):064x}") for b in range(40) for p in range(r.choice([1, 2, 30]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = spark.createDataFrame(rows, "block long, position long, entity_key string, entity_hash string")
        got = {(x.block, x.position): (x.previous, x.claimed) for x in chain.rolling(df, F.sha2(F.col("block").cast("string").cast("binary"), 256), keccak_many).collect()}
        assert df.count() == len(got) and chain.broken_links(chain.rolling(df, F.lit(chain.ZERO), keccak_many), F.lit(chain.ZERO), chain.keccak_hex).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import hashlib

    h = {}
    for b, p, key, value in rows:
        before = h.get(b) or hashlib.sha256(str(b).encode()).digest()
        h[b] = keccak_many([before + bytes.fromhex(key + value)])[0]
        assert got[b, p] == (before.hex(), h[b].hex())


def test_sinks(spark, tmp_path):
    echo, log, heights = sinks.EchoSink(), sinks.LogSink(str(tmp_path / "log")), []
    sent = {"blocks": [block(5, [[op("create", 0, expiresAt="0x64", payload="0x00ff", attributes=ATTRIBUTES)], [op("delete", 0)]]), block(6, [])]}
    gone = {"blocks": [], "revertedBlocks": [{"number": "0x6", "hash": sent["blocks"][1]["header"]["hash"]}]}
    for sink in (echo, log):
        for message in (sent, gone, gone | {"newBlocks": [block(6, [[op("extend", 0, expiresAt="0x9")]], "b", "a")]}):
            runner.apply_message(sink, messages(spark, {k: v for k, v in message.items() if v}))
    assert echo.calls == [("commit", {"headers": 2, "ops": 2}), ("revert", {"references": 1}), ("reorg", {"references": 1, "headers": 1, "ops": 1})]
    lines = sorted(r.value.split(" ")[0] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert lines == ["BLOCK", "BLOCK", "CREATE", "DELETE", "EXTEND", "REVERT", "REVERT", "TX", "TX", "TX"]
    submit = sinks.Submitter(spark, str(tmp_path / "in"))
    assert submit.execute([block(1, [[op("create", 0, expiresAt="0x64")]])]) == {"id": 1, "status": True, "blocks": 1, "operations": 1}
    assert sinks.Submitter(spark, str(tmp_path / "in")).execute([block(2, [])])["id"] == 2  # numbers that are taken are left out
    store = LedgerStore(spark, str(tmp_path / "store"))
    runner.run_messages(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint"), heights.append, 300)
    assert heights == [1, 2] and store.head()["number"] == 2
    (tmp_path / "in" / "000000000003.json").write_text(json.dumps({"revertedBlocks": [{"number": "0x2", "hash": block(2, [])["header"]["hash"]}]}))
    runner.run_messages(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint"), heights.append)
    assert heights == [1, 2] and store.head()["number"] == 1  # a revert isn't acknowledged
    for text in ({"a": [1]}, {"b": 2}):
        sinks.write_pretty(spark, text, str(tmp_path / "pretty.json"))
    assert (tmp_path / "pretty.json").read_text() == '{\n  "b": 2\n}\n' and blocks.read_genesis(spark, str(tmp_path / "pretty.json")) == {"b": 2}
    assert Files(spark).names(str(tmp_path / "none")) == []


def test_settings_choose_the_sink(spark, tmp_path):
    at = str(tmp_path / "x")
    assert settings.Settings(False).sink(spark) is None and settings.Settings(True, store=at, arguments=" a  b ").argument_list == ["a", "b"]
    assert isinstance(settings.Settings(True, store=at).sink(spark), LedgerStore) and isinstance(settings.Settings(True, debug=True, log=at).sink(spark), sinks.LogSink)
    for bad in (settings.Settings(True), settings.Settings(False, store=at), settings.Settings(True, store=at, debug=True), settings.Settings(True, debug=True)):
        with pytest.raises(ValueError):
            bad.sink(spark)


def test_raw_blocks_must_fit_together(spark):
    tx, receipt = ("h", "0xAA", "0x"), (True, [("0xaa", "entity", "k"), ("0xbb", "entity", "k"), (None, "hash", "k")])
    rows = [(1, "x", [tx, ("g", "0xbb", "0x"), tx], [receipt] * 3, ["s1", "s2", "s3"]), (2, "y", [], [], []), (3, "z", None, None, None)]
    got = blocks.registry_transactions(spark.createDataFrame(rows, blocks.RAW), "0xaa").orderBy("tx_index").collect()
    assert [(r.number, r.tx_index, r.sender, len(r.logs)) for r in got] == [(1, 0, "s1", 1), (1, 2, "s3", 1)]
    with pytest.raises(Exception, match="differ in block 9"):
        blocks.registry_transactions(spark.createDataFrame([(9, "x", [tx], [], ["s"])], blocks.RAW), "0xaa").collect()
    signers = spark.createDataFrame([(0, "a")], "index long, address string")
    with pytest.raises(Exception, match="no signer 4"):
        blocks.owner_addresses(spark.createDataFrame([(4,)], "receiver long"), signers).collect()


def test_numbers_of_any_size(spark):
    value = "0x" + "ff" * 32
    wide = [{"valueType": "uint", "name": "big", "value": value}, {"valueType": "uint", "name": "max", "value": "0x" + f"{2**63 - 1:064x}"}]
    ops = wire.operation_rows(wire.block_rows(wire.parse(messages(spark, {"blocks": [block(1, [[op("create", 0, attributes=wide)]])]}))))
    assert {r.name: r.value for r in wire.attribute_rows(ops).collect()} == {"big": value, "max": str(2**63 - 1)}
