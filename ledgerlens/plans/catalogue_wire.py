"""Queries of the catalogue over raw blocks, stores that messages fill, reads by name, sinks and the simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import chain, decode, simulate, state
from ..sources import adapters, blocks, wire
from ..sources.adapters import ENTITIES_SQL, OPLOG_SQL, document_entities, oplog, table
from ..sources.paths import shared_path, written
from . import api
from .catalogue import AT_BLOCK, BLOCKS_SQL, REORG_SQL, STATE_SQL, _reorged, _seed, hashed_ops, ledger, query, valid_ops

#: The contract whose calls count, and another one.
REGISTRY, OTHER = "0x" + "Aa" * 20, "0x" + "bb" * 20


def address(n) -> F.Column:
    """A number as 40 hex digits."""
    return F.lower(F.lpad(F.hex(n), 40, "0"))


# --- Raw blocks


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations as blocks of a node: a sender's in a block are one transaction, to the registry if the sender is even.

    Each operation leaves two events, entity and hash; the registry's come from its address, but every third operation's
    come from another.
    """
    ops = oplog(spark, sf_dir)
    place = F.when(F.col("event_id") % 3 == 0, F.lit(OTHER)).otherwise(F.lit(REGISTRY.lower()))
    logs = F.array(*[F.struct(place.alias("address"), F.lit(kind).alias("event"), F.col("entity_key").alias("entityKey")) for kind in ("entity", "hash")])
    txs = ops.groupBy("block", "tx_index").agg(F.min("sender").alias("sender"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("op_index", logs.alias("l")))), lambda x: x["l"])).alias("logs"), F.bool_and("valid").alias("status"))
    one = F.struct(
        "tx_index",
        F.struct(F.sha2(F.concat_ws(":", "block", "tx_index").cast("binary"), 256).alias("hash"), F.when(F.col("sender") % 2 == 0, F.lit(REGISTRY)).otherwise(F.lit(OTHER)).alias("to"), F.lit("0x").alias("input")).alias("t"),
        F.struct("status", "logs").alias("r"),
        address(F.col("sender")).alias("s"),
    )
    rows = txs.groupBy("block").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select(F.col("block").alias("number"), F.lit(None).cast("string").alias("hash"), F.col("all.t").alias("transactions"), F.col("all.r").alias("receipts"), F.col("all.s").alias("senders"))


@query(f"WITH {OPLOG_SQL} SELECT block AS number, tx_index::INT AS tx_index, lower(lpad(hex(min(sender)), 40, '0')) AS sender, bool_and(valid) AS status, 2 * count(*) FILTER (event_id % 3 <> 0) AS logs FROM oplog GROUP BY block, tx_index HAVING min(sender) % 2 = 0")
def registry_transactions(spark, sf_dir):
    """Calls of the registry, with their place among all transactions and the registry's own logs counted."""
    rows = blocks.registry_transactions(raw_blocks(spark, sf_dir), REGISTRY)
    return rows.select("number", "tx_index", "sender", "status", F.size("logs").cast("long").alias("logs"))


@query(
    f"""WITH {OPLOG_SQL} SELECT block AS number, tx_index::INT AS tx_index, count(*) AS operations, CASE WHEN bool_or(event_id % 3 = 0) THEN 'count mismatch' END AS error
    FROM oplog GROUP BY block, tx_index HAVING min(sender) % 2 = 0"""
)
def registry_quarantine(spark, sf_dir):
    """Transactions whose logs from the registry don't match their operations one by one."""
    txs = written(blocks.registry_transactions(raw_blocks(spark, sf_dir), REGISTRY), "registry")
    known = txs.select(F.struct("number", "tx_index").alias("tx"))
    calls = oplog(spark, sf_dir).select(F.struct(F.col("block").alias("number"), F.col("tx_index").cast("int").alias("tx_index")).alias("tx"), F.col("op_index").alias("log_index"), "entity_key").join(known, "tx", "left_semi")
    found = decode.quarantine(decode.paired(calls, blocks.events_of(txs, "entity"), blocks.events_of(txs, "hash")))
    return found.select("tx.number", "tx.tx_index", "operations", "error")


@query(
    f"""WITH {OPLOG_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY block, tx_index ORDER BY op_index) AS nth FROM oplog WHERE op = 'create'),
    m AS (SELECT *, row_number() OVER (PARTITION BY block, tx_index ORDER BY op_index) AS made_nth FROM c WHERE event_id % 97 <> 0)
    SELECT c.block, c.tx_index, c.nth::INT AS ordinal, c.op_index AS planned, m.entity_key AS made FROM c LEFT JOIN m ON m.block = c.block AND m.tx_index = c.tx_index AND m.made_nth = c.nth"""
)
def planned_creates(spark, sf_dir):
    """Creates of a batch beside the create events of its receipt, in order; some events are lost here."""
    ops = written(oplog(spark, sf_dir).filter("op = 'create'").select(F.struct("block", "tx_index").alias("tx"), "op_index", "entity_key", "event_id"), "creates")
    made = ops.filter("event_id % 97 <> 0").select("tx", F.col("op_index").alias("log_index"), "entity_key")
    return blocks.planned_and_made(ops, made).select("tx.block", "tx.tx_index", "ordinal", "planned", "made")


@query(f"WITH {OPLOG_SQL} SELECT event_id, new_owner % 10 AS receiver, lower(lpad(hex(1000 + new_owner % 10), 40, '0')) AS address FROM oplog WHERE op = 'transfer'")
def transfer_addresses(spark, sf_dir):
    """Receivers of transfers, named by the signers' table."""
    signers = spark.range(10).select(F.col("id").alias("index"), address(F.col("id") + 1000).alias("address"))
    rows = oplog(spark, sf_dir).filter("op = 'transfer'").select("event_id", (F.col("new_owner") % 10).alias("receiver"))
    return blocks.owner_addresses(rows, signers)


@query("SELECT c_custkey, c_custkey % 4 = 1 AS expected FROM customer")
def contract_code(spark, sf_dir):
    """Whether an account is the contract that is expected: its code's hash too, not its address alone."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 1, F.lit(REGISTRY)).otherwise(F.lit(OTHER)).alias("address"), F.when(F.col("c_custkey") % 4 == 1, F.lit("AB")).when(F.col("c_custkey") % 4 == 3, F.lit("cd")).alias("code_hash"))
    return rows.select("c_custkey", blocks.has_code(rows, REGISTRY, "ab").alias("expected"))


@query("SELECT count(*) - 1 AS injected FROM supplier")
def injected_accounts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") == F.lit(1), F.lit(REGISTRY)).otherwise(address(F.col("s_suppkey"))).alias("address"))
    return blocks.injected(rows, REGISTRY)


@query(f"WITH {OPLOG_SQL} SELECT (SELECT max(block) FROM oplog) AS block_number, (SELECT count(DISTINCT (block, tx_index)) FROM oplog WHERE sender = (SELECT min(sender) FROM oplog)) AS transaction_count")
def node_reads(spark, sf_dir):
    ops = written(oplog(spark, sf_dir).select("block", "tx_index", "sender"), "reads")
    first = ops.agg(F.min("sender")).first()[0] or 0
    txs = ops.distinct().select("block", "tx_index", address(F.col("sender")).alias("sender"))
    return blocks.node_reads(txs, ops.select(F.col("block").alias("number")), f"{first:040x}")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS parts FROM documents")
def argument_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(blocks.arguments(F.coalesce("text", F.lit("")))).cast("long").alias("parts"))


@query("SELECT event_id, (sha256('7:' || event_id || ':1') || sha256('7:' || event_id || ':2'))[1:(2 * (event_id % 60))::INT] AS payload FROM events")
def random_payloads(spark, sf_dir):
    """Payloads of 0 to 59 bytes that a seed and a number give."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.lower(F.hex(blocks.random_payload(F.col("event_id") % 60, F.col("event_id"), 7))).alias("payload"))


PAYLOADS = ("'text'", "'0xab'", "'0x'", "'0xa'", "NULL")


@query(f"SELECT event_id, [[NULL, NULL, 'bad hex payload', 'bad hex payload', 'text or size'], ['text and size', 'text and size', 'text and size', 'text and size', NULL]][(event_id // 5 % 2 + 1)::INT][(event_id % 5 + 1)::INT] AS error FROM events")
def payload_choice(spark, sf_dir):
    """A payload is a text or a size, one of them."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(f"element_at(array({', '.join(PAYLOADS)}), cast(event_id % 5 as int) + 1)").alias("text"), F.expr("if(event_id div 5 % 2 = 1, 8, null)").alias("size"))
    return rows.select("event_id", blocks.payload_choice(F.col("text"), F.col("size")).alias("error"))


@query("SELECT event_id, '0x' || lower(hex((event_id::UBIGINT + 18446744073608551616::UBIGINT))) AS text, (event_id::HUGEINT + 18446744073608551616)::DECIMAL(20, 0) AS back, lpad(lower(hex((event_id::UBIGINT + 18446744073608551616::UBIGINT))), 64, '0') AS word FROM events")
def wide_numbers(spark, sf_dir):
    """Numbers above what a long holds, as hex text and 32-byte words and back."""
    n = (F.col("event_id").cast("decimal(20,0)") + F.lit("18446744073608551616").cast("decimal(20,0)")).cast("decimal(20,0)")
    text = codecs.hex_u64_decimal(n)
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"), codecs.parse_u64_decimal(text).alias("back"), F.lower(F.hex(codecs.hex_word(text))).alias("word"))


@query("SELECT range AS tick, range / 4.0::DOUBLE AS at FROM range(0, 400)")
def rate_ticks(spark, sf_dir):
    from ..streaming import runner

    return runner.ticks(spark, 4.0, 100)


# --- A store that messages fill


def messages_of(ops: DataFrame) -> DataFrame:
    """block and value: a commit message for each block from 0 to the last, empty ones too, as a node sends them.

    Messages of blocks with operations are written, so operations are read once only.
    """
    hexed = lambda c: F.concat(F.lit("0x"), c)
    writes = F.col("op").isin("create", "update")
    attribute = lambda name, kind, raw: F.struct(F.lit(kind).alias("valueType"), F.lit(name).alias("name"), hexed(F.lower(F.hex(raw))).alias("value"))
    op = F.struct(
        F.upper("op").alias("type"), F.col("op_index").cast("int").alias("opIndex"), hexed(F.col("entity_key")).alias("entityKey"),
        hexed(address(F.coalesce("new_owner", "sender"))).alias("owner"), hexed(F.col("entity_hash")).alias("entityHash"), codecs.hex_u64(F.col("expires_at")).alias("expiresAt"),
        F.when(writes, hexed(F.lower(F.hex(F.concat(F.lit("event:"), F.col("event_id").cast("string")).cast("binary"))))).alias("payload"),
        F.when(writes, F.element_at(F.array(*map(F.lit, codecs.CONTENT_TYPES)), (F.col("event_id") % 5 + 1).cast("int"))).alias("contentType"),
        F.when(writes, F.array(attribute("amount", "uint", codecs.uint_word(F.col("amount"))), attribute("kind", "string", codecs.string_container(F.col("op"))))).alias("attributes"),
    )
    ops = ops.repartition("block")  # for both groups
    txs = ops.groupBy("block", "tx_index").agg(F.min("sender").alias("sender"), F.array_sort(F.collect_list(F.struct("op_index", op.alias("o")))).alias("ops"))
    tx = F.struct(F.col("tx_index").cast("int").alias("index"), hexed(address(F.col("sender"))).alias("sender"), F.col("ops.o").alias("operations"))
    made = txs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("tx_index", tx.alias("t")))).alias("txs"))
    name = lambda n: hexed(F.sha2(F.concat(F.lit("block:"), n.cast("string")).cast("binary"), 256))
    header = F.struct(codecs.hex_u64(F.col("block")).alias("number"), name(F.col("block")).alias("hash"), name(F.col("block") - 1).alias("parentHash"))
    message = lambda txs: F.to_json(F.struct(F.array(F.struct(header.alias("header"), txs.alias("transactions"))).alias("blocks"))).alias("value")
    made = written(made.select("block", message(F.col("txs.t"))), "messages")
    every = made.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("block"))).alias("block"))
    return made.unionByName(every.join(made.select("block"), "block", "left_anti").select("block", message(F.array().cast(f"array<{wire.TRANSACTION}>"))))


def filled_store(spark: SparkSession, sf_dir: str):
    """A store that two commits of messages have filled."""
    from ..streaming import runner
    from ..streaming.store import LedgerStore

    messages = messages_of(valid_ops(spark, sf_dir))
    store = LedgerStore(spark, shared_path(spark, "wire-store"))
    for part in (f"block < {AT_BLOCK}", f"block >= {AT_BLOCK}"):
        rows = messages.filter(part)
        if not rows.isEmpty():
            runner.apply_message(store, rows.select("value"))
    return store


WIRE_STATE_SQL = f"""{STATE_SQL}, types AS (SELECT [{', '.join(repr(c) for c in codecs.CONTENT_TYPES)}] AS names),
kept AS (SELECT s.entity_key AS key, lower(lpad(hex(s.owner), 40, '0')) AS owner, names[(payload_event % 5 + 1)::INT] AS "contentType", s.expires_at AS "expiresAt", 'event:' || payload_event AS payload, 'amount=' || o.amount || ',kind=' || o.op AS attributes, o.op AS kind
  FROM state s JOIN oplog o ON o.event_id = payload_event, types WHERE s.alive)"""


def _shown(rows: DataFrame) -> DataFrame:
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ",")
    return rows.select("key", "owner", "contentType", "expiresAt", F.decode("payload", "UTF-8").alias("payload"), attributes.alias("attributes"))


FIELDS = ("key", "owner", "contentType", "expiresAt", "payload", "attributes")


@query(f'WITH {WIRE_STATE_SQL} SELECT key, owner, "contentType", "expiresAt", payload, attributes FROM kept')
def wire_store_state(spark, sf_dir):
    """All entities of a store that messages filled, with what only messages carry."""
    return _shown(api.state_entities(filled_store(spark, sf_dir).ops()))


@query(f'WITH {WIRE_STATE_SQL} SELECT key, owner, "contentType", "expiresAt", payload, attributes FROM kept WHERE owner = (SELECT min(owner) FROM kept)')
def wire_store_owner(spark, sf_dir):
    """The entities of the first owner."""
    ops = filled_store(spark, sf_dir).ops()
    first = api.state_entities(ops).agg(F.min("owner")).first()[0] or "0" * 40
    return _shown(api.Ledger(ops, None).query(f"$owner = 0x{first}", api.Options(fields=FIELDS)))


@query(f"WITH {WIRE_STATE_SQL} SELECT key, owner, \"contentType\", \"expiresAt\", payload, attributes FROM kept WHERE kind = 'update'")
def wire_store_attribute(spark, sf_dir):
    """The entities with an attribute that says that they were updated last."""
    return _shown(api.Ledger(filled_store(spark, sf_dir).ops(), None).query('kind = "update"', api.Options(fields=FIELDS)))


@query(f"WITH {OPLOG_SQL} SELECT {chain.UNKNOWN_ENTITY}::INT AS code, block, entity_key FROM oplog WHERE NOT valid ORDER BY block, tx_index, op_index LIMIT 1")
def commit_refused(spark, sf_dir):
    """What a commit of all operations is refused for: the first one on an entity that isn't there."""
    from ..streaming import runner
    from ..streaming.store import LedgerStore

    store = LedgerStore(spark, shared_path(spark, "refused"))
    try:
        runner.apply_message(store, messages_of(oplog(spark, sf_dir)).select("value"))
        rows = []
    except chain.ChainError as e:
        rows = [(e.code, e.data.get("block"), e.data.get("entity_key"))]
    return spark.createDataFrame(rows, "code int, block long, entity_key string")


@query(f"WITH {REORG_SQL} SELECT * FROM state")
def store_reorg(spark, sf_dir):
    """State of a store after the last blocks were reverted and others committed, as two versions."""
    return state.latest(_replaced(spark, sf_dir, False))


@query(f"WITH {REORG_SQL} SELECT * FROM state")
def store_reorg_at_once(spark, sf_dir):
    """The same in one version, and compacted after that."""
    return state.latest(_replaced(spark, sf_dir, True))


def _replaced(spark: SparkSession, sf_dir: str, at_once: bool) -> DataFrame:
    from ..streaming.store import LedgerStore

    ops, references, again = _reorged(spark, sf_dir)
    store = LedgerStore(spark, shared_path(spark, "replaced"), known_only=False)  # what comes again lacks creates of odd senders
    old, new = ops.withColumn("block_hash", F.col("hash")), again.withColumn("block_hash", F.col("hash"))
    refs = written(references.select("number", "hash"), "references")
    first, end = refs.agg(F.min("number"), F.max("number")).first()
    last = end if end is not None else ops.agg(F.max("block")).first()[0] or 0
    name = lambda n, fork: F.sha2(F.concat(F.lit("fork:"), F.sha2(F.concat(F.lit("block:"), n.cast("string")).cast("binary"), 256)).cast("binary"), 256) if fork else F.sha2(F.concat(F.lit("block:"), n.cast("string")).cast("binary"), 256)

    def headers(first: int, fork: bool) -> DataFrame:
        n = F.col("id")
        parent = name(n - 1, False) if not fork else F.when(n == first, name(n - 1, False)).otherwise(name(n - 1, True))
        return spark.range(first, last + 1).select(n.alias("number"), name(n, fork).alias("hash"), parent.alias("parent_hash"), F.lit(chain.ZERO).alias("changeset_hash"), F.lit(None).cast("long").alias("timestamp"))

    store.commit(headers(0, False), old)
    if first is not None:
        if at_once:
            store.reorg(refs, headers(first, True), new)
        else:
            store.revert(refs)
            store.commit(headers(first, True), new)
    if at_once:
        store.compact()
    return store.ops()


# --- Hashes and reads

PREFIX_SQL = f"""{OPLOG_SQL}, hashed AS (
  SELECT event_id, block, tx_index, op_index, position, list_reduce(list_prepend(sha256('seed:' || block), list(entity_key || entity_hash) OVER (PARTITION BY block ORDER BY position ROWS UNBOUNDED PRECEDING)), lambda a, b: sha256(from_hex(a || b))) AS claimed FROM oplog WHERE valid)"""


@query(f"WITH {PREFIX_SQL} SELECT event_id, claimed FROM hashed")
def rolling_hashes(spark, sf_dir):
    """The rolling hash after every operation."""
    return hashed_ops(spark, sf_dir).select("event_id", "claimed")


@query(
    f"""WITH {PREFIX_SQL}, first AS (SELECT * FROM hashed ORDER BY block, position LIMIT 40)
    SELECT block, dense_rank() OVER (PARTITION BY block ORDER BY tx_index) - 1 AS tx, row_number() OVER (PARTITION BY block, tx_index ORDER BY position) - 1 AS op, claimed FROM first"""
)
def hash_history(spark, sf_dir):
    """The oldest operations' hashes, with the number of each transaction among those of its block."""
    return api.Ledger(hashed_ops(spark, sf_dir), None).hash_history(40)


@query(f"WITH {BLOCKS_SQL} SELECT arg_max(changeset_hash, number) AS changeset_hash FROM blocks WHERE number <= {AT_BLOCK}")
def hash_at_block(spark, sf_dir):
    return ledger(spark, sf_dir).head_hash(AT_BLOCK)


@query(f"WITH {BLOCKS_SQL} SELECT min(number) AS number, arg_min(hash, number) AS hash FROM blocks")
def first_block(spark, sf_dir):
    return ledger(spark, sf_dir).first_block()


@query(f'WITH {STATE_SQL} SELECT entity_key AS "entityKey", owner, payload_event AS "payloadEvent", expires_at AS "expiresAt", created_block AS "createdBlock" FROM state')
def camel_names(spark, sf_dir):
    """State with names as they are on the wire."""
    from ..operators import report

    return report.camel(state.latest(valid_ops(spark, sf_dir)).select("entity_key", "owner", "payload_event", "expires_at", "created_block"))


@query(f"WITH {OPLOG_SQL} SELECT sender, count(*) FILTER (op = 'create') AS nonce FROM oplog WHERE valid GROUP BY sender")
def sender_nonces(spark, sf_dir):
    return api.Ledger(valid_ops(spark, sf_dir), None).nonces()


@query(
    f"""WITH {STATE_SQL}, {BLOCKS_SQL.removeprefix(OPLOG_SQL + ',')}
    SELECT 'getEntityCount' AS method, (SELECT count(*) FROM state WHERE alive)::VARCHAR AS result, NULL::INT AS code
    UNION ALL SELECT 'changeSetHash', (SELECT arg_max(changeset_hash, number) FROM blocks), NULL
    UNION ALL SELECT 'getBlockTiming', (SELECT max(number) || ' ' || max(timestamp) || ' {adapters.BLOCK_SECONDS}' FROM blocks), NULL
    UNION ALL SELECT 'query', (SELECT string_agg(entity_key, ' ' ORDER BY entity_key) FROM (SELECT entity_key FROM state WHERE alive ORDER BY entity_key LIMIT 5)), NULL
    UNION ALL SELECT 'ping', 'pong', NULL UNION ALL SELECT 'other', NULL, {chain.READ_ERROR} UNION ALL SELECT 'badQuery', NULL, {chain.READ_ERROR}"""
)
def calls_by_name(spark, sf_dir):
    """Reads as a client asks for them: by a method's name, with positional parameters."""
    reads = ledger(spark, sf_dir)
    asked = {"getEntityCount": [], "changeSetHash": [], "getBlockTiming": [], "query": ["*", {"resultsPerPage": "0x5"}], "ping": [], "other": [], "badQuery": ["("]}
    show = {"getBlockTiming": lambda r: f"{r['current_block']} {r['current_block_time']} {r['duration']}", "query": lambda r: " ".join(e["key"] for e in r["data"])}
    rows = []
    for method, params in asked.items():
        got = reads.call("db_" + ("query" if method == "badQuery" else method), params)
        rows.append((method, show.get(method, str)(got["result"]) if "result" in got else None, got.get("error", {}).get("code")))
    return spark.createDataFrame(rows, "method string, result string, code int")


@query(f"WITH {ENTITIES_SQL}, page AS (SELECT * FROM docs WHERE \"contentType\" = 'text/plain' ORDER BY key LIMIT 20) SELECT count(*) AS count, {AT_BLOCK}::BIGINT AS block, string_agg(key || ' ' || \"contentType\" || ' ' || \"expiresAt\" || ' ' || owner, ',' ORDER BY key) AS entities FROM page")
def page_report(spark, sf_dir):
    """A page of a query with its count, block and entities."""
    from ..operators import report

    options = api.Options(resultsPerPage="0x14")
    made = report.result_report(api.query(document_entities(spark, sf_dir), '$contentType = "text/plain"', options), AT_BLOCK, options.fields, whole=True)
    text = F.array_join(F.transform("entities", lambda e: F.concat_ws(" ", e["key"], e["contentType"], e["expiresAt"].cast("string"), e["owner"])), ",")
    return made.select("count", "block", text.alias("entities"))


# --- Sinks and the simulator


@query(f"WITH {OPLOG_SQL} SELECT event_id, concat_ws(chr(10), '---', '  op: ' || upper(op), '  entity_key: ' || entity_key, '  owner: ' || sender, '  expires_at: ' || coalesce(expires_at::VARCHAR, '-'), '  entity_hash: ' || entity_hash) AS text FROM oplog WHERE valid")
def event_lines(spark, sf_dir):
    from ..streaming import sinks

    rows = valid_ops(spark, sf_dir).withColumn("owner", F.col("sender"))
    return sinks.event_lines(rows).join(rows.select("block", "position", "event_id"), ["block", "position"]).select("event_id", "text")


@query(
    f"""WITH {OPLOG_SQL}, v AS (SELECT *, lower(lpad(hex(sender), 40, '0')) AS s FROM oplog WHERE valid)
    SELECT 'BLOCK number=' || block || ' txs=' || count(DISTINCT tx_index) || ' ops=' || count(*) AS value FROM v GROUP BY block
    UNION ALL SELECT 'TX index=' || tx_index || ' hash=- sender=' || min(s) || ' ops=' || count(*) FROM v GROUP BY block, tx_index
    UNION ALL SELECT upper(op) || ' key=' || entity_key || ' owner=' || coalesce(CASE WHEN op IN ('create', 'transfer') THEN lower(lpad(hex(new_owner), 40, '0')) END, s) || CASE op WHEN 'create' THEN ' expires=' || expires_at || ' payload=' || strlen('event:' || event_id) || ' hash=' || entity_hash || ' attributes=2'
      WHEN 'update' THEN ' payload=' || strlen('event:' || event_id) || ' hash=' || entity_hash WHEN 'extend' THEN ' expires=' || expires_at ELSE '' END FROM v"""
)
def log_sink(spark, sf_dir):
    """What a log has after a commit of all blocks: blocks, transactions and operations, a line each."""
    from ..streaming import runner, sinks

    path = shared_path(spark, "log")
    runner.apply_message(sinks.LogSink(path), messages_of(valid_ops(spark, sf_dir)).select("value"))
    return spark.read.text(path)


def _simulated(confirmed: bool = True) -> tuple[simulate.Simulator, list[tuple]]:
    made = simulate.Simulator(seed=42)
    names = [f"{k + 1:040x}" for k in range(made.signers)]
    return made, simulate.run(made, names, 600, 2.0, lambda batch: (batch.block * 7 + batch.signer) % 10 != 0)


@query(None)
def simulated(spark, sf_dir):
    """Operations of a simulated load, a tenth of whose transactions fail."""
    return simulate.table(spark, _simulated()[1])


@query(None)
def simulated_status(spark, sf_dir):
    """The simulator's own report, which tests compare with counts over its operations."""
    found = _simulated()[0].status()
    return spark.createDataFrame([(*k, found["alive"], found["expired"]) for k in found["kinds"]], "op string, sent long, confirmed long, failed long, alive long, expired long")
