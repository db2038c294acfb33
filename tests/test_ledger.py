import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import chain, decode, generate, running, state
from ledgerlens.plans import api
from ledgerlens.sources import batch, wire
from ledgerlens.streaming import runner
from ledgerlens.streaming.store import HEADERS, OPS, LedgerStore

KEY, LINK, OWNER = "11" * 32, "22" * 32, "Ab" * 20


def op(kind, index, key=KEY, **more):
    return {"type": kind, "opIndex": index, "entityKey": "0x" + key, "owner": "0x" + OWNER, "entityHash": "0x" + "33" * 32, "changesetHash": "0x" + "44" * 32} | more


def block(number, txs, tag="a", parent=None):
    name = lambda n, t: "0x" + f"{n:062x}" + {"a": "0a", "b": "0b"}[t]
    return {"header": {"number": hex(number), "hash": name(number, tag), "parentHash": name(number - 1, parent or tag), "changesetHash": "0x" + "44" * 32}, "transactions": [{"hash": "0x" + "55" * 32, "index": 3 * k, "sender": "0x" + OWNER, "operations": ops} for k, ops in enumerate(txs)]}


ATTRIBUTES = [
    {"valueType": "entityKey", "name": "linked.to", "value": "0x" + LINK},
    {"valueType": "uint", "name": "priority", "value": "0x" + f"{7:064x}"},
    {"valueType": "string", "name": "title", "value": "0x" + "hé".encode().hex().ljust(256, "0")},
]


def messages(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "value string")


def test_wire_commit_with_empty_block_and_all_attribute_types(spark):
    create = op("create", 0, expiresAt="0x64", payload="0x00ff", contentType="text/plain", attributes=ATTRIBUTES)
    sent = {"blocks": [block(5, [[create, op("extend", 1, expiresAt="0x65")], [op("delete", 0)]]), block(6, [])]}
    blocks = wire.block_rows(wire.parse(messages(spark, sent)))
    assert [(r.number, r.tx_count) for r in blocks.orderBy("number").collect()] == [(5, 2), (6, 0)]
    ops = wire.operation_rows(blocks)
    got = [(r.tx_index, r.op_index, r.op, r.expires_at, r.payload, r.content_type) for r in ops.orderBy("tx_index", "op_index").collect()]
    assert got == [(0, 0, "create", 100, "00ff", "text/plain"), (0, 1, "extend", 101, None, None), (3, 0, "delete", None, None, None)]
    assert ops.first().owner == OWNER.lower()
    values = {r.name: (r.valueType, r.value) for r in wire.attribute_rows(ops).collect()}
    assert values == {"linked.to": ("entityKey", LINK), "priority": ("uint", "7"), "title": ("string", "hé")}


def test_bad_transactions_are_set_aside_as_a_whole(spark):
    bad = [
        [op("create", 0), op("mint", 1)],
        [op("create", 0, attributes=[{"valueType": "float", "name": "a", "value": "0x00"}])],
        [op("create", 0, attributes=ATTRIBUTES[::-1])],
        [op("create", 0, contentType="nonsense")],
        [op("create", 0, attributes=[{"valueType": "uint", "name": "Bad", "value": "0x00"}])],
    ]
    blocks = wire.block_rows(wire.parse(messages(spark, {"blocks": [block(1, [*bad, [op("create", 0)]])]})))
    good, aside = wire.quarantined(blocks)
    assert wire.operation_rows(good).count() == 1
    assert sorted(r.error for r in aside.collect()) == ["attributes out of order", "bad attribute name", "bad content type", "unknown operation", "unknown value type"]
    parsed = wire.parse(spark.createDataFrame([("not json",), (json.dumps({"blocks": []}),)], "value string"))
    assert sorted(r.malformed for r in parsed.collect()) == [False, True]


def test_pairs(spark):
    calls = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "a")], "tx int, log_index int, entity_key string")
    events = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 0, "x"), (3, 0, "a")], "tx int, log_index int, entity_key string")
    hashes = spark.createDataFrame([(1, 3, "a"), (1, 6, "b"), (2, 1, "a")], "tx int, log_index int, entity_key string")
    got = {r.tx: r.error for r in decode.quarantine(decode.paired(calls, events, hashes)).collect()}
    assert got == {1: None, 2: "key mismatch", 3: "count mismatch"}


def header_rows(spark, numbers, tag="a", parent=None):
    name = lambda n, t: f"{t}{n}"
    rows = [(n, name(n, tag), name(n - 1, parent if parent and n == numbers[0] else tag), chain.ZERO, 1000 + 2 * n) for n in numbers]
    return spark.createDataFrame(rows, HEADERS)


def op_rows(spark, rows):
    return spark.createDataFrame([(b, f"{t}{b}", b * 1048576 + k, kind, key, 1, b + 10, 1, 100 * b + k) for b, t, k, kind, key in rows], OPS)


def test_store_commit_revert_reorg_and_errors(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    store.commit(header_rows(spark, [1, 2, 3]), op_rows(spark, [(1, "a", 0, "create", "k"), (3, "a", 0, "delete", "k")]), "one")
    assert store.commit(header_rows(spark, [9]), op_rows(spark, []), "one") == 1  # replayed
    for numbers, tag, code in (([5], "a", chain.OUT_OF_ORDER), ([4], "b", chain.PARENT_MISMATCH), ([4, 6], "a", chain.OUT_OF_ORDER)):
        with pytest.raises(chain.ChainError) as e:
            store.commit(header_rows(spark, numbers, tag), op_rows(spark, []))
        assert e.value.code == code
    gone = spark.createDataFrame([(3, "a3")], "number long, hash string")
    with pytest.raises(chain.ChainError) as e:
        store.revert(spark.createDataFrame([(3, "zz")], "number long, hash string"))
    assert e.value.code == chain.BLOCK_NOT_FOUND
    assert not state.latest(store.ops()).first().alive
    store.reorg(gone, header_rows(spark, [3, 4], "b", "a"), op_rows(spark, [(4, "b", 0, "create", "m")]))
    assert store.head()["hash"] == "b4" and {r.entity_key: r.alive for r in state.latest(store.ops()).collect()} == {"k": True, "m": True}
    other = LedgerStore(spark, str(tmp_path / "other"))
    other.commit(header_rows(spark, [1, 2, 3]), op_rows(spark, [(1, "a", 0, "create", "k"), (3, "a", 0, "delete", "k")]))
    other.revert(gone)
    other.commit(header_rows(spark, [3, 4], "b", "a"), op_rows(spark, [(4, "b", 0, "create", "m")]))
    assert sorted(map(str, other.ops().collect())) == sorted(map(str, store.ops().collect()))
    other.revert(spark.createDataFrame([(4, "b4"), (3, "b3")], "number long, hash string"))
    other.commit(header_rows(spark, [3]), op_rows(spark, [(3, "a", 0, "delete", "k")]))  # the block that was reverted first is back
    assert other.head()["hash"] == "a3" and not state.latest(other.ops()).filter("entity_key = 'k'").first().alive


def test_messages_as_a_stream(spark, tmp_path):
    source, store = tmp_path / "in", LedgerStore(spark, str(tmp_path / "store"))
    source.mkdir()
    first = {"blocks": [block(1, [[op("create", 0, expiresAt="0x64")]]), block(2, [])]}
    second = {"revertedBlocks": [{"number": "0x2", "hash": first["blocks"][1]["header"]["hash"]}], "newBlocks": [block(2, [[op("delete", 0)]], "b", "a")]}
    for k, message in enumerate((first, second)):
        (source / f"{k}.json").write_text(json.dumps(message))
        runner.run_messages(spark, str(source), store, str(tmp_path / "checkpoint"))
        assert [r.alive for r in state.latest(store.ops()).collect()] == [k == 0]
    assert store.headers().count() == 2 and store._manifest()["version"] == 2


def test_batch_file(spark, tmp_path):
    path = tmp_path / "batch.json"
    ops = [
        {"type": "create", "btl": 1800, "contentType": "application/json", "payload": "{}", "attributes": [{"name": "title", "string": "x"}, {"name": "linked.to", "entityKey": "$0"}, {"name": "priority", "uint": "5"}]},
        {"type": "update", "entityKey": "$0", "payload": "0x00"},
        {"type": "extend", "entityKey": "0x" + KEY, "btl": 5},
        {"type": "transfer", "entityKey": "$0"}, {"type": "delete", "entityKey": "$1"}, {"type": "create"}, {"type": "create", "btl": 1, "payload": "a", "size": 2}, {"type": "create", "btl": 1, "attributes": [{"name": "a"}]},
    ]
    path.write_text(json.dumps(ops))
    rows = batch.resolved(batch.with_nonces(batch.read_batch(spark, str(path)), 7, "me"), 100).orderBy("position").collect()
    assert [r.error for r in rows] == [None, None, None, "missing newOwner", "bad entityKey", "missing btl", "payload and size", "attribute needs one value"]
    assert rows[1].entity_key == rows[0].entity_key and rows[2].entity_key == KEY and rows[0].expires_at == 1900
    assert [a.name for a in rows[0].attributes] == ["linked.to", "priority", "title"] and rows[1].content_type == "application/octet-stream"
    path.write_text("[]")
    with pytest.raises(batch.BatchError):
        batch.read_batch(spark, str(path))
    assert list(batch.merge_genesis({"config": {"chainId": 1}, "alloc": {"b": 1}}, {"a": 2, "b": 3})["alloc"].items()) == [("a", 2), ("b", 3)]
    with pytest.raises(batch.BatchError):
        batch.merge_genesis({"config": {"chainId": 0}}, {})


def test_demo_scenario(spark):
    kinds = ["application/json"] * 3 + ["text/plain"] * 2
    rows = [(f"k{k}", "aa", kind, 100 + k, []) for k, kind in enumerate(kinds)]
    schema = "key string, owner string, contentType string, expiresAt long, attributes array<struct<name:string,valueType:string,value:string>>"
    count = lambda df, text: api.query(df, text).count()
    df = spark.createDataFrame(rows, schema)
    assert (count(df, "*"), count(df, '$contentType = "application/json"'), count(df, '$contentType = "text/plain"')) == (5, 3, 2)
    df = df.withColumn("contentType", F.when(F.col("key") == "k0", "text/markdown").otherwise(F.col("contentType"))).withColumn("owner", F.when(F.col("key") == "k1", "bb").otherwise(F.col("owner")))
    assert (count(df, '$contentType = "application/json"'), count(df, '$contentType = "text/markdown"'), count(df, "$owner = 0xBB")) == (2, 1, 1)
    df = df.filter("key <> 'k2'")
    assert count(df, "$all") == 4 and count(df, "$expiration < 101") == 1
    first = api.query(df, "*", api.Options(resultsPerPage="0x3")).collect()
    rest = api.query(df, "*", api.Options(resultsPerPage=3, cursor=first[-1].key)).collect()
    assert [r.key for r in first + rest] == ["k0", "k1", "k3", "k4"]


def test_running_is_a_window_over_the_key(spark):
    rows = spark.range(500).selectExpr("id % 3 as k", "id as t", "id div 17 as bucket", "if(id % 5 = 0, id, null) as v", "id % 7 as n")
    got = running.running(rows, "k", "bucket", ["t"], {"s": F.col("n")}, {"l": F.col("v")})
    want = rows.selectExpr("t", "sum(n) over (partition by k order by t) as s", "last(v) ignore nulls over (partition by k order by t rows between unbounded preceding and 1 preceding) as l")
    assert sorted(map(str, got.select("t", "s", "l").collect())) == sorted(map(str, want.collect()))
    got = running.carry_forward(rows.select("t", "v"), "t", "v", 7)
    assert sorted(map(str, got.select("t", "carried").collect())) == sorted(map(str, rows.selectExpr("t", "last(v) ignore nulls over (order by t) as carried").collect()))


def test_workload_is_a_function_of_its_seed(spark):
    one, two = (generate.batches(spark.newSession() if k else spark, 300, 7) for k in (0, 1))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.repartition(5).collect()))
    rows = one.collect()
    assert {r.op for r in rows} == {"create", "update", "extend", "transfer", "delete"} and all(r.receiver != r.signer for r in rows if r.op == "transfer")
    assert all(30 <= r.btl < 300 for r in rows if r.op == "create") and all(64 <= r["size"] < 512 for r in rows if r.op == "update")
    with pytest.raises(generate.WorkloadError):
        generate.batches(spark, 1, 1, signers=101)
