"""The catalogue of queries: each is a DataFrame of the engine's operators, most with SQL that must give the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, digest
from ..operators import chain, decode, generate, report, state
from ..sources import adapters, batch
from ..sources.adapters import ENTITIES_SQL, OPLOG_SQL, document_entities, oplog, table
from ..sources.paths import shared_path, written
from . import api

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The block that as-of queries ask for, and from which reverts take blocks away.
AT_BLOCK, TAIL_FROM = 2000, 4000


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def valid_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog(spark, sf_dir).filter("valid")


# --- Operations and blocks


@query(f"WITH {OPLOG_SQL} SELECT event_id, block, tx_index, op_index, sender, op, entity_key, expires_at, valid FROM oplog")
def oplog_decode(spark, sf_dir):
    return oplog(spark, sf_dir).select("event_id", "block", "tx_index", "op_index", "sender", "op", "entity_key", "expires_at", "valid")


@query(f"WITH {OPLOG_SQL} SELECT block, tx_index, min(sender) AS sender, count(*) AS op_count, sum(CASE WHEN valid THEN 1 ELSE 0 END)::BIGINT AS valid_count FROM oplog GROUP BY block, tx_index")
def tx_grouping(spark, sf_dir):
    return oplog(spark, sf_dir).groupBy("block", "tx_index").agg(F.min("sender").alias("sender"), F.count("*").alias("op_count"), F.count_if("valid").alias("valid_count"))


def _seed(block: str = "block"):
    return F.sha2(F.concat(F.lit("seed:"), F.col(block).cast("string")).cast("binary"), 256)


def hashed_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid operations with previous and claimed; each block's rolling hash begins with a seed of its own."""
    return chain.rolling(valid_ops(spark, sf_dir), _seed())


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every block up to the last, empty ones too, with counts, and the rolling hash carried forward."""
    ops = written(hashed_ops(spark, sf_dir).select("block", "tx_index", "position", "claimed"), "hashed")
    counts = ops.groupBy("block").agg(F.count("*").alias("op_count"), F.countDistinct("tx_index").alias("tx_count"), F.max_by("claimed", "position").alias("last_hash"))
    every = adapters.events(spark, sf_dir).agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("block"))).alias("number"))
    rows = every.join(counts, F.col("number") == F.col("block"), "left").drop("block")
    rows = chain.headers(rows).withColumns({"op_count": F.coalesce("op_count", F.lit(0)), "tx_count": F.coalesce("tx_count", F.lit(0))})
    name = lambda n: F.sha2(F.concat(F.lit("block:"), n.cast("string")).cast("binary"), 256)
    return rows.select(
        "number", (F.col("number") * adapters.BLOCK_SECONDS + adapters.GENESIS_TIME).alias("timestamp"), "tx_count", "op_count",
        name(F.col("number")).alias("hash"), name(F.col("number") - 1).alias("parent_hash"), "changeset_hash",
    )


BLOCKS_SQL = f"""{OPLOG_SQL},
ordered AS (SELECT block, list(entity_key || entity_hash ORDER BY position) AS all_ops, count(*) AS op_count, count(DISTINCT tx_index) AS tx_count FROM oplog WHERE valid GROUP BY block),
folded AS (SELECT *, list_reduce(list_prepend(sha256('seed:' || block), all_ops), lambda a, b: sha256(from_hex(a || b))) AS last_hash FROM ordered),
numbers AS (SELECT unnest(range(0, (SELECT max(block) + 1 FROM oplog))) AS number),
blocks AS (
  SELECT number, number * {adapters.BLOCK_SECONDS} + {adapters.GENESIS_TIME} AS timestamp, coalesce(tx_count, 0) AS tx_count, coalesce(op_count, 0) AS op_count, sha256('block:' || number) AS hash, sha256('block:' || (number - 1)) AS parent_hash,
    coalesce(last_value(last_hash IGNORE NULLS) OVER (ORDER BY number), '{chain.ZERO}') AS changeset_hash
  FROM numbers LEFT JOIN folded ON number = block)"""


@query(f"WITH {BLOCKS_SQL} SELECT * FROM blocks")
def block_headers(spark, sf_dir):
    return block_table(spark, sf_dir)


@query(f"WITH {BLOCKS_SQL} SELECT number, hash, row_number() OVER (ORDER BY number DESC) AS place FROM blocks WHERE number >= {TAIL_FROM}")
def block_refs_desc(spark, sf_dir):
    """References of the blocks that a revert names, the newest first."""
    last = adapters.events(spark, sf_dir).agg(F.max("block").alias("last"))
    rows = last.select(F.explode(F.when(F.col("last") >= TAIL_FROM, F.sequence(F.lit(TAIL_FROM).cast("long"), F.col("last")))).alias("number"), "last")
    return rows.select("number", F.sha2(F.concat(F.lit("block:"), F.col("number").cast("string")).cast("binary"), 256).alias("hash"), (F.col("last") - F.col("number") + 1).alias("place"))


@query(f"WITH {OPLOG_SQL}, filled AS (SELECT block AS number, count(DISTINCT tx_index) AS tx_count FROM oplog WHERE valid GROUP BY block) SELECT number, tx_count, lag(number) OVER (ORDER BY number) AS previous FROM filled")
def block_linked_list(spark, sf_dir):
    """Blocks with transactions, each with the one before."""
    filled = valid_ops(spark, sf_dir).groupBy(F.col("block").alias("number")).agg(F.countDistinct("tx_index").alias("tx_count"))
    return chain.links(written(filled.withColumn("hash", F.lit("")), "filled")).select("number", "tx_count", F.col("before_number").alias("previous"))


@query(f"WITH {OPLOG_SQL} SELECT op, count(*) AS sent, count(*) FILTER (valid) AS confirmed, count(*) FILTER (NOT valid) AS failed FROM oplog GROUP BY op")
def op_counts(spark, sf_dir):
    return generate.status(oplog(spark, sf_dir).withColumnRenamed("valid", "confirmed")).drop("place")


@query(f"WITH {OPLOG_SQL} SELECT event_id, block, op, entity_key, {chain.UNKNOWN_ENTITY} AS code FROM oplog WHERE NOT valid")
def unknown_entity_errors(spark, sf_dir):
    return oplog(spark, sf_dir).filter("not valid").select("event_id", "block", "op", "entity_key", F.lit(chain.UNKNOWN_ENTITY).alias("code"))


# --- State

STATE = """SELECT entity_key, arg_min(sender, position) FILTER (op = 'create') AS creator, arg_max(new_owner, position) FILTER (op IN ('create', 'transfer')) AS owner,
    arg_max(event_id, position) FILTER (op IN ('create', 'update')) AS payload_event, arg_max(expires_at, position) FILTER (op IN ('create', 'extend')) AS expires_at,
    min(block) FILTER (op = 'create') AS created_block, max(block) AS updated_block, NOT bool_or(op = 'delete') AS alive
  FROM oplog WHERE valid"""
STATE_SQL = f"{OPLOG_SQL}, state AS ({STATE} GROUP BY entity_key)"
AS_OF_SQL = f"{OPLOG_SQL}, state AS ({STATE} AND block <= {AT_BLOCK} GROUP BY entity_key)"


@query(f"WITH {STATE_SQL} SELECT * FROM state")
def entity_latest(spark, sf_dir):
    return state.latest(valid_ops(spark, sf_dir))


@query(f"WITH {STATE_SQL} SELECT count(*) AS entity_count FROM state WHERE alive")
def entity_count(spark, sf_dir):
    return state.latest(valid_ops(spark, sf_dir)).filter("alive").agg(F.count("*").alias("entity_count"))


@query(f"WITH {STATE_SQL} SELECT owner, count(*) AS entity_count, min(expires_at) AS first_expiry FROM state WHERE alive GROUP BY owner")
def entity_count_by_owner(spark, sf_dir):
    return state.latest(valid_ops(spark, sf_dir)).filter("alive").groupBy("owner").agg(F.count("*").alias("entity_count"), F.min("expires_at").alias("first_expiry"))


@query(
    f"""WITH {OPLOG_SQL} SELECT entity_key, min(sender) AS creator, arg_max(new_owner, (block, tx_index, op_index)) FILTER (op IN ('create', 'transfer')) AS owner, min(block) AS created_block, max(block) AS updated_block,
    arg_max(expires_at, (block, tx_index, op_index)) FILTER (op IN ('create', 'extend')) AS expires_at FROM oplog WHERE valid GROUP BY entity_key"""
)
def commitment(spark, sf_dir):
    """What the chain commits to, for every entity."""
    return state.latest(valid_ops(spark, sf_dir)).select("entity_key", "creator", "owner", "created_block", "updated_block", "expires_at")


@query(f"WITH {AS_OF_SQL} SELECT * FROM state")
def state_as_of(spark, sf_dir):
    return state.as_of(valid_ops(spark, sf_dir), AT_BLOCK)


@query(
    f"""WITH {OPLOG_SQL} SELECT entity_key, op, position AS valid_from, lead(position) OVER w AS valid_to, last_value(CASE WHEN op IN ('create', 'transfer') THEN new_owner END IGNORE NULLS) OVER w AS owner,
    last_value(CASE WHEN op IN ('create', 'extend') THEN expires_at END IGNORE NULLS) OVER w AS expires_at, last_value(CASE WHEN op IN ('create', 'update') THEN event_id END IGNORE NULLS) OVER w AS payload_event, op <> 'delete' AS alive
    FROM oplog WHERE valid WINDOW w AS (PARTITION BY entity_key ORDER BY position)"""
)
def entity_history_scd2(spark, sf_dir):
    rows = state.versions(valid_ops(spark, sf_dir))
    return rows.withColumns({c: adapters.packed(F.col(c)["block"], *adapters.indices(F.col(c)["position"])) for c in ("valid_from", "valid_to")})


@query(
    f"""WITH {OPLOG_SQL} SELECT entity_key, op, block AS from_block, tx_index AS from_tx, op_index AS from_op, lead(block) OVER w AS to_block, lead(tx_index) OVER w AS to_tx, lead(op_index) OVER w AS to_op,
    last_value(CASE WHEN op IN ('create', 'transfer') THEN new_owner END IGNORE NULLS) OVER w AS owner, last_value(CASE WHEN op IN ('create', 'extend') THEN expires_at END IGNORE NULLS) OVER w AS expires_at,
    last_value(CASE WHEN op IN ('create', 'update') THEN event_id END IGNORE NULLS) OVER w AS payload_event, op <> 'delete' AS alive
    FROM oplog WHERE valid WINDOW w AS (PARTITION BY entity_key ORDER BY block, tx_index, op_index)"""
)
def entity_history_places(spark, sf_dir):
    """Versions with the block, transaction and operation of their ends, for blocks and transactions of any size."""
    rows = state.versions(valid_ops(spark, sf_dir))
    ends = {}
    for name in ("from", "to"):
        at = F.col(f"valid_{name}")
        ends |= dict(zip((f"{name}_block", f"{name}_tx", f"{name}_op"), (at["block"], *adapters.indices(at["position"])), strict=True))
    return rows.withColumns(ends).drop("valid_from", "valid_to")


@query(f"WITH {STATE_SQL} SELECT entity_key, owner, expires_at FROM state WHERE alive AND expires_at <= {AT_BLOCK}")
def expirable(spark, sf_dir):
    return state.expirable(state.latest(valid_ops(spark, sf_dir)), AT_BLOCK).select("entity_key", "owner", "expires_at")


@query(f"WITH {STATE_SQL} SELECT expires_at, count(*) AS entity_count FROM state WHERE alive GROUP BY expires_at")
def expiry_by_block(spark, sf_dir):
    return state.latest(valid_ops(spark, sf_dir)).filter("alive").groupBy("expires_at").agg(F.count("*").alias("entity_count"))


@query(f"WITH {STATE_SQL} SELECT count(*) FILTER (alive) AS alive, count(*) FILTER (alive AND expires_at <= {AT_BLOCK}) AS queued, count(*) FILTER (NOT alive) AS gone FROM state")
def state_counters(spark, sf_dir):
    rows = state.latest(valid_ops(spark, sf_dir))
    return rows.agg(F.count_if("alive").alias("alive"), F.count_if(F.col("alive") & (F.col("expires_at") <= AT_BLOCK)).alias("queued"), F.count_if(~F.col("alive")).alias("gone"))


@query(
    f"""WITH {OPLOG_SQL}, b AS (SELECT *, last_value(CASE WHEN op IN ('create', 'extend') THEN expires_at END IGNORE NULLS) OVER (PARTITION BY entity_key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM oplog WHERE valid)
    SELECT event_id, entity_key, before, expires_at FROM b WHERE op = 'extend' AND expires_at <= before"""
)
def extend_monotonicity(spark, sf_dir):
    return state.monotonicity(valid_ops(spark, sf_dir)).select("event_id", "entity_key", "before", "expires_at")


# --- Reads


def ledger(spark: SparkSession, sf_dir: str) -> api.Ledger:
    return api.Ledger(valid_ops(spark, sf_dir), written(block_table(spark, sf_dir), "blocks"))


@query(f"WITH {BLOCKS_SQL} SELECT max(number) AS current_block, max(timestamp) AS current_block_time, {adapters.BLOCK_SECONDS}::BIGINT AS duration FROM blocks")
def block_timing(spark, sf_dir):
    return ledger(spark, sf_dir).block_timing()


@query("WITH t AS (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events), d AS (SELECT s // 600 AS number, min(s) AS first_second FROM t GROUP BY ALL) SELECT number, greatest(first_second - lag(first_second) OVER (ORDER BY number), 0) AS duration FROM d")
def block_timing_series(spark, sf_dir):
    """Seconds from each block's first event to the next one's."""
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000000")
    rows = table(spark, sf_dir, "events").select(at.alias("s")).groupBy(F.expr("s div 600").alias("number")).agg(F.min("s").alias("first"))
    linked = chain.links(written(rows.withColumn("hash", F.col("first")), "timing"))
    return linked.select("number", codecs.saturating_difference(F.col("first"), F.col("before_hash")).alias("duration"))


@query(f"WITH {OPLOG_SQL} SELECT block, tx_index, op_index, op, entity_key, sender FROM oplog WHERE valid ORDER BY position LIMIT 25")
def history_depth(spark, sf_dir):
    return api.Ledger(valid_ops(spark, sf_dir), None).history(25)


@query(f"WITH {BLOCKS_SQL} SELECT arg_max(changeset_hash, number) AS changeset_hash FROM blocks")
def chain_head_hash(spark, sf_dir):
    return ledger(spark, sf_dir).head_hash()


@query(f"WITH {BLOCKS_SQL} SELECT parent.number AS parent, child.number AS number, child.timestamp - parent.timestamp AS seconds FROM blocks child JOIN blocks parent ON child.parent_hash = parent.hash")
def parent_lookup(spark, sf_dir):
    """Every block with its parent, found by hash."""
    blocks = written(block_table(spark, sf_dir), "blocks")
    parent = blocks.select(F.col("hash").alias("parent_hash"), F.col("number").alias("parent"), F.col("timestamp").alias("before"))
    return blocks.join(parent, "parent_hash").select("parent", "number", (F.col("timestamp") - F.col("before")).alias("seconds"))


# --- Hash chain


@query(
    f"""WITH {OPLOG_SQL}, l AS (SELECT list(entity_key || entity_hash) OVER (PARTITION BY block ORDER BY position ROWS UNBOUNDED PRECEDING) AS so_far, block FROM oplog WHERE valid),
    h AS (SELECT list_reduce(list_prepend(sha256('seed:' || block), so_far), lambda a, b: sha256(from_hex(a || b))) AS claimed FROM l)
    SELECT count(*) AS operations, 0::BIGINT AS broken, sum(('0x' || claimed[1:8])::BIGINT)::BIGINT AS first_digits FROM h"""
)
def chain_verify(spark, sf_dir):
    """How many links there are and how many are broken, and a sum of the hashes' first digits, which tells them from other hashes."""
    checked = chain.checked_links(hashed_ops(spark, sf_dir), _seed())
    digits = F.sum(F.conv(F.substring("expected", 1, 8), 16, 10).cast("long"))
    return checked.agg(F.count("*").alias("operations"), F.count_if(F.col("expected") != F.col("claimed")).alias("broken"), digits.alias("first_digits"))


@query(
    f"""WITH {OPLOG_SQL}, p AS (SELECT *, lead(event_id) OVER (PARTITION BY block ORDER BY position) AS next_event FROM oplog WHERE valid)
    SELECT event_id FROM p WHERE event_id % 997 = 0 UNION SELECT next_event FROM p WHERE event_id % 997 = 0 AND next_event IS NOT NULL"""
)
def chain_verify_corrupt(spark, sf_dir):
    """Where some claimed hashes are wrong, those links break and the ones behind them."""
    ops = hashed_ops(spark, sf_dir)
    bad = ops.withColumn("claimed", F.when(F.col("event_id") % 997 == 0, F.lit(chain.ZERO)).otherwise(F.col("claimed")))
    return chain.broken_links(written(bad, "corrupt"), _seed()).select("event_id")


# --- Commit, revert, reorg


@query(f"WITH {STATE_SQL} SELECT * FROM state")
def commit_split(spark, sf_dir):
    """State after two commits is state after one."""
    ops = valid_ops(spark, sf_dir)
    return state.latest(chain.commit(ops.filter(F.col("block") < AT_BLOCK), ops.filter(F.col("block") >= AT_BLOCK)))


TAIL_SQL = f"{OPLOG_SQL}, state AS ({STATE} AND block < {TAIL_FROM} GROUP BY entity_key)"


@query(f"WITH {TAIL_SQL} SELECT * FROM state")
def revert_tail(spark, sf_dir):
    """State after the last blocks were reverted by number and hash."""
    ops = valid_ops(spark, sf_dir).withColumns({"number": F.col("block"), "hash": F.sha2(F.concat(F.lit("block:"), F.col("block").cast("string")).cast("binary"), 256)})
    return state.latest(chain.revert(ops, block_refs_desc(spark, sf_dir)).drop("number", "hash"))


REORG_SQL = f"{OPLOG_SQL}, state AS ({STATE} AND (block < {TAIL_FROM} OR sender % 2 = 0) GROUP BY entity_key)"


def _reorged(spark, sf_dir):
    ops = valid_ops(spark, sf_dir).withColumns({"number": F.col("block"), "hash": F.sha2(F.concat(F.lit("block:"), F.col("block").cast("string")).cast("binary"), 256)})
    again = ops.filter((F.col("block") >= TAIL_FROM) & (F.col("sender") % 2 == 0)).withColumn("hash", F.sha2(F.concat(F.lit("fork:"), F.col("hash")).cast("binary"), 256))
    return ops, block_refs_desc(spark, sf_dir), again


@query(f"WITH {REORG_SQL} SELECT * FROM state")
def reorg_tail(spark, sf_dir):
    """State after the last blocks gave way to others, which have the operations of even senders only."""
    return state.latest(chain.reorg(*_reorged(spark, sf_dir)).drop("number", "hash"))


@query(f"WITH {BLOCKS_SQL} SELECT number, {chain.PARENT_MISMATCH} AS code FROM blocks WHERE number % 500 = 0 AND number > 0")
def continuity_errors(spark, sf_dir):
    blocks = block_table(spark, sf_dir).withColumn("parent_hash", F.when(F.col("number") % 500 == 0, F.lit(chain.ZERO)).otherwise(F.col("parent_hash")))
    return chain.continuity_errors(written(blocks, "blocks")).select("number", "code")


@query(f"WITH {BLOCKS_SQL} SELECT number, {chain.OUT_OF_ORDER} AS code FROM blocks WHERE (number - 1) % 700 = 0 AND number > 1")
def out_of_order_errors(spark, sf_dir):
    """Blocks behind those that were left out."""
    blocks = block_table(spark, sf_dir).filter((F.col("number") % 700 != 0) | (F.col("number") == 0))
    return chain.continuity_errors(written(blocks, "blocks")).select("number", "code")


@query(f"WITH {BLOCKS_SQL} SELECT number + 1000000 AS number, {chain.BLOCK_NOT_FOUND} AS code FROM blocks WHERE number % 300 = 0")
def revert_not_found(spark, sf_dir):
    blocks = written(block_table(spark, sf_dir), "blocks")
    names = blocks.select(F.when(F.col("number") % 300 == 0, F.col("number") + 1_000_000).otherwise(F.col("number")).alias("number"), "hash")
    return chain.missing(names, blocks).select("number", F.lit(chain.BLOCK_NOT_FOUND).alias("code"))


@query(
    f"""WITH {OPLOG_SQL}, calls AS (SELECT position // 1024 AS tx, count(*) AS operations, bool_or(event_id % 41 = 0) AS lost, bool_or(event_id % 37 = 0) AS changed FROM oplog GROUP BY 1)
    SELECT tx, operations, CASE WHEN lost THEN 'count mismatch' WHEN changed THEN 'key mismatch' END AS error FROM calls"""
)
def event_pair_quarantine(spark, sf_dir):
    """Transactions in which an event is lost, or names another entity, are set aside."""
    return _quarantined(spark, sf_dir).withColumn("tx", adapters.packed(F.col("tx")["block"], F.col("tx")["tx_index"]))


@query(
    f"""WITH {OPLOG_SQL}, calls AS (SELECT block, tx_index, count(*) AS operations, bool_or(event_id % 41 = 0) AS lost, bool_or(event_id % 37 = 0) AS changed FROM oplog GROUP BY block, tx_index)
    SELECT block, tx_index, operations, CASE WHEN lost THEN 'count mismatch' WHEN changed THEN 'key mismatch' END AS error FROM calls"""
)
def event_pair_places(spark, sf_dir):
    """The same with block and index of the transaction, for blocks and transactions of any size."""
    return _quarantined(spark, sf_dir).select("tx.*", "operations", "error")


def _quarantined(spark, sf_dir):
    calls = written(oplog(spark, sf_dir).select(F.struct("block", "tx_index").alias("tx"), F.col("op_index").alias("log_index"), "entity_key", "event_id"), "calls")
    entity = calls.withColumn("entity_key", F.when(F.col("event_id") % 37 == 0, F.reverse("entity_key")).otherwise(F.col("entity_key")))
    return decode.quarantine(decode.paired(calls, entity, calls.filter(F.col("event_id") % 41 != 0)))


# --- Entity queries

RESULT_SQL = 'key, "contentType", "expiresAt", owner'


def entity_query(name: str, text: str, where: str, options: api.Options = api.Options(), tail: str = "", columns: str = RESULT_SQL) -> None:
    def run(spark, sf_dir):
        return api.query(document_entities(spark, sf_dir), text, options)

    run.__name__, run.__doc__ = name, text
    query(f"WITH {ENTITIES_SQL} SELECT {columns} FROM docs WHERE {where} {tail}")(run)


_has = lambda test: f"key IN (SELECT key FROM attributes WHERE {test})"
entity_query("q_all", "$all", "true")
entity_query("q_star", "*", "true")
entity_query("q_content_type", '$contentType = "application/json"', "\"contentType\" = 'application/json'")
OWNER = hashlib.sha256(b"src3").hexdigest()[:40]
entity_query("q_owner", f"$owner = 0x{OWNER}", f"owner = '{OWNER}'")
entity_query("q_expiration_lt", "$expiration < 1500", '"expiresAt" < 1500')
entity_query("q_attr_string", 'lang = "en"', _has("name = 'lang' AND \"valueType\" = 'string' AND value = 'en'"))
entity_query("q_attr_uint", "quality = 1", _has("name = 'quality' AND \"valueType\" = 'uint' AND value::BIGINT = 1"))
entity_query("q_attr_range", "n_chars >= 2000 && n_chars < 3000", _has("name = 'n_chars' AND value::BIGINT >= 2000") + " AND " + _has("name = 'n_chars' AND value::BIGINT < 3000"))
entity_query(
    "q_and_or_not",
    '(lang = "en" and quality = 0) or not $expiration < 9000',
    "(" + _has("name = 'lang' AND value = 'en'") + " AND " + _has("name = 'quality' AND value::BIGINT = 0") + ') OR NOT "expiresAt" < 9000',
)
entity_query("q_page1", "$all", "true", api.Options(resultsPerPage="0xa"), "ORDER BY key LIMIT 10")
entity_query("q_page2", "$all", "key > '0'", api.Options(resultsPerPage=10, cursor="8"), "AND key > '8' ORDER BY key LIMIT 10")
entity_query("q_projection", "$expiration < 3000", '"expiresAt" < 3000', api.Options(fields=("key", "owner")), columns="key, owner")


@query(f"WITH {AS_OF_SQL} SELECT entity_key AS key, '{codecs.DEFAULT_CONTENT_TYPE}' AS \"contentType\", expires_at AS \"expiresAt\", lower(hex(owner)) AS owner FROM state WHERE alive AND expires_at > {AT_BLOCK}")
def q_at_block(spark, sf_dir):
    """Entities as they were at a block, without the expirable ones."""
    return api.Ledger(valid_ops(spark, sf_dir), None).query("$all", api.Options(at_block=AT_BLOCK, live_only=True))


@query(f"WITH {ENTITIES_SQL} SELECT key, owner FROM docs WHERE key = sha256('doc:7')")
def q_key(spark, sf_dir):
    return api.query(document_entities(spark, sf_dir), f"$key = 0x{hashlib.sha256(b'doc:7').hexdigest()}", api.Options(fields=("key", "owner")))


@query(f"WITH {ENTITIES_SQL} SELECT key, name, \"valueType\", value FROM attributes")
def attr_explode(spark, sf_dir):
    return document_entities(spark, sf_dir).select("key", F.inline("attributes"))


@query(f"WITH {ENTITIES_SQL} SELECT key, string_agg(name, ',' ORDER BY name) AS names FROM attributes GROUP BY key")
def attr_sort(spark, sf_dir):
    """Attributes in the order that a transaction needs, whatever order they came in."""
    rows = document_entities(spark, sf_dir).select("key", codecs.sorted_attributes(F.reverse("attributes")).alias("a"))
    return rows.select("key", F.array_join("a.name", ",").alias("names"))


@query(f"WITH {ENTITIES_SQL} SELECT key, count(*) FILTER (name = 'lang') > 0 AND (doc_id % 3 = 0) AS duplicate FROM attributes JOIN docs USING (key) GROUP BY key, doc_id")
def attr_duplicates(spark, sf_dir):
    """Whether an attribute list breaks the strict order, when every third entity's first attribute is given twice."""
    rows = document_entities(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").select(F.sha2(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).cast("binary"), 256).alias("key"), (F.col("doc_id") % 3 == 0).alias("twice"))
    rows = rows.join(ids, "key").withColumn("a", F.when(F.col("twice"), F.concat(F.slice("attributes", 1, 1), F.col("attributes"))).otherwise(F.col("attributes")))
    return rows.select("key", (~codecs.strictly_sorted(F.col("a"))).alias("duplicate"))


@query(f"WITH {ENTITIES_SQL} SELECT a.key, a.value AS linked, d.owner AS linked_owner FROM attributes a JOIN docs d ON a.value = d.key WHERE a.name = 'linked.to'")
def attr_links(spark, sf_dir):
    entities = document_entities(spark, sf_dir)
    links = entities.select("key", F.inline("attributes")).filter("name = 'linked.to' and valueType = 'entityKey'").select("key", F.col("value").alias("linked"))
    return links.join(entities.select(F.col("key").alias("linked"), F.col("owner").alias("linked_owner")), "linked").select("key", "linked", "linked_owner")


@query(f"WITH {ENTITIES_SQL} SELECT \"contentType\", count(*) AS entities, sum(strlen(payload))::BIGINT AS bytes, sum((SELECT count(*) FROM attributes a WHERE a.key = docs.key))::BIGINT AS attributes FROM docs GROUP BY ALL")
def payload_report(spark, sf_dir):
    rows = document_entities(spark, sf_dir)
    return rows.groupBy("contentType").agg(F.count("*").alias("entities"), F.sum(F.octet_length("payload")).alias("bytes"), F.sum(F.size("attributes")).cast("long").alias("attributes"))


# --- Values


@query("SELECT event_id, lpad(lower(hex(event_id * 1000003)), 64, '0') AS word, '0x' || lower(hex(event_id * 1000003)) AS text, event_id * 1000003 AS back FROM events")
def enc_uint(spark, sf_dir):
    n = F.col("event_id") * 1_000_003
    rows = table(spark, sf_dir, "events").select("event_id", codecs.uint_word(n).alias("w"), codecs.hex_u64(n).alias("text"))
    return rows.select("event_id", F.lower(F.hex("w")).alias("word"), "text", codecs.word_uint(F.col("w")).alias("back"))


@query("SELECT doc_id, rpad(lower(hex(encode(source || ':' || lang))), 256, '0') AS container, source || ':' || lang AS back FROM documents")
def enc_string128(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", codecs.string_container(F.concat_ws(":", "source", "lang")).alias("c"))
    return rows.select("doc_id", F.lower(F.hex("c")).alias("container"), codecs.container_string(F.col("c")).alias("back"))


@query("SELECT o_orderkey, '0x' || lower(hex(o_orderkey)) AS text, o_orderkey AS back FROM orders")
def hex_u64(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", codecs.hex_u64(F.col("o_orderkey")).alias("text"))
    return rows.withColumn("back", codecs.parse_u64(F.col("text")))


PAYLOADS = ("hello", "0x00ff", "0x", "0xabc", "0xzz", "0X00")


@query(
    f"""WITH p AS (SELECT doc_id, [{', '.join(map(repr, PAYLOADS))}][(doc_id % {len(PAYLOADS)} + 1)::INT] AS text FROM documents)
    SELECT doc_id, CASE WHEN text LIKE '0x%' THEN CASE WHEN regexp_full_match(text, '0x([0-9a-fA-F]{{2}})+') THEN lower(text[3:]) END ELSE lower(hex(encode(text))) END AS cli,
      CASE WHEN text LIKE '0x%' THEN CASE WHEN regexp_full_match(text, '0x([0-9a-fA-F]{{2}})*') THEN lower(text[3:]) END ELSE lower(hex(encode(text))) END AS batch FROM p"""
)
def payload_rules(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, PAYLOADS)), F.pmod("doc_id", F.lit(len(PAYLOADS))).cast("int") + 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.lower(F.hex(codecs.cli_payload(F.col("text"))["payload"])).alias("cli"), F.lower(F.hex(codecs.batch_payload(F.col("text"), F.lit(None).cast("int"))["payload"])).alias("batch"))


SHORTHANDS = ("12", "'a b'", "0x" + "ab" * 32, "0xab", "hello", "'", '"q"')


@query(
    "WITH s AS (SELECT doc_id, ["
    + ", ".join("'" + s.replace("'", "''") + "'" for s in SHORTHANDS)
    + f"][(doc_id % {len(SHORTHANDS)} + 1)::INT] AS value FROM documents) "
    + """SELECT doc_id, CASE WHEN length(value) >= 2 AND (value LIKE '''%''' OR value LIKE '"%"') THEN 'string' WHEN regexp_full_match(value, '0x[0-9a-fA-F]{64}') THEN 'entityKey' WHEN regexp_full_match(value, '[0-9]+') THEN 'uint' END AS kind FROM s"""
)
def shorthand_parse(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, SHORTHANDS)), F.pmod("doc_id", F.lit(len(SHORTHANDS))).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", codecs.shorthand_type(value).alias("kind"))


@query("SELECT o_orderkey, count(*) AS n, (sum(round(o_totalprice * 100)::HUGEINT) * 10000000000000 // 1000000000000000000)::VARCHAR || '.' || lpad((sum(round(o_totalprice * 100)::HUGEINT) * 10000000000000 % 1000000000000000000)::VARCHAR, 18, '0') || ' ETH' AS balance FROM orders GROUP BY o_orderkey")
def wei_format(spark, sf_dir):
    wei = F.sum(F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)")).cast("decimal(24,0)") * F.lit(10_000_000_000_000).cast("decimal(14,0)")
    return table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n"), codecs.wei_text(wei).alias("balance"))


DURATIONS = ("0", "inf", "5m", "90s", "2h", "abc", "infinity", "1d", "7")


@query(f"SELECT doc_id, [0, 0, 300, 90, 7200, NULL, 0, 86400, NULL][(doc_id % {len(DURATIONS)} + 1)::INT]::BIGINT AS seconds FROM documents")
def duration_parse(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, DURATIONS)), F.pmod("doc_id", F.lit(len(DURATIONS))).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", codecs.seconds_of(text).alias("seconds"))


NAMES = ("title", "Title", "linked.to", "a" * 33, "", "9x", "a_b-c")
TYPES = ("text/plain", "application/json; charset=utf-8", "text", "a b/c", "image/png", "x/" + "y" * 127)


@query(f"SELECT doc_id, [true, false, true, false, false, false, true][(doc_id % {len(NAMES)} + 1)::INT] AS name_ok, [true, true, false, false, true, false][(doc_id % {len(TYPES)} + 1)::INT] AS type_ok FROM documents")
def validators(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.pmod("doc_id", F.lit(len(values))).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", codecs.valid_name(pick(NAMES)).alias("name_ok"), codecs.valid_content_type(pick(TYPES)).alias("type_ok"))


# --- Batches and workload


@query(f"WITH {OPLOG_SQL} SELECT event_id, sender, row_number() OVER (PARTITION BY sender ORDER BY position) - 1 AS nonce, entity_key FROM oplog WHERE op = 'create'")
def create_nonces(spark, sf_dir):
    """The nonce that each create uses, and the key that follows from it."""
    return oplog(spark, sf_dir).filter("op = 'create'").select("event_id", "sender", (F.col("generation") - 1).alias("nonce"), "entity_key")


@query(
    f"""WITH {OPLOG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY position // 1024 ORDER BY op_index) - 1 AS place, first_value(op) OVER (PARTITION BY position // 1024 ORDER BY op_index) AS first_op, first_value(entity_key) OVER (PARTITION BY position // 1024 ORDER BY op_index) AS first_key FROM oplog)
    SELECT event_id, CASE WHEN first_op = 'create' THEN first_key END AS resolved FROM n WHERE place > 0"""
)
def batch_refs(spark, sf_dir):
    """$0 in later operations of a transaction: the key that its first operation makes, null where that is no create."""
    ops = written(oplog(spark, sf_dir).select(F.struct("block", "tx_index").alias("tx"), "op_index", "op", "entity_key", "event_id"), "refs")
    makes = ops.filter("op_index = 0 and op = 'create'").select("tx", F.col("entity_key").alias("resolved"))
    return ops.filter("op_index > 0").join(makes, "tx", "left").select("event_id", "resolved")


@query("SELECT event_id, CASE WHEN event_id * 7 % 11 < 4 THEN 'create' WHEN event_id * 7 % 11 < 7 THEN 'update' WHEN event_id * 7 % 11 < 9 THEN 'extend' WHEN event_id * 7 % 11 < 10 THEN 'transfer' ELSE 'delete' END AS op FROM events")
def weighted_pick(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", generate.picked(F.col("event_id") * 7 % 11).alias("op"))


@query(f"WITH {STATE_SQL}, owned AS (SELECT owner, count(*) FILTER (alive) AS owned, count(*) FILTER (alive AND expires_at <= {AT_BLOCK}) AS expired FROM state GROUP BY owner) SELECT owner, kind, CASE kind WHEN 'create' THEN owned < 10 WHEN 'expire' THEN expired > 0 ELSE owned > 0 END AS feasible FROM owned, (SELECT unnest(['create', 'update', 'extend', 'transfer', 'delete', 'expire']) AS kind)")
def feasibility(spark, sf_dir):
    rows = state.latest(valid_ops(spark, sf_dir)).groupBy("owner").agg(F.count_if("alive").alias("owned"), F.count_if(F.col("alive") & (F.col("expires_at") <= AT_BLOCK)).alias("expired"))
    rows = rows.withColumn("kind", F.explode(F.array(*map(F.lit, codecs.OPERATIONS))))
    return rows.select("owner", "kind", generate.feasible(F.col("kind"), F.col("owned"), F.col("owned"), F.col("expired"), cap=10).alias("feasible"))


@query(
    f"""WITH {OPLOG_SQL}, t AS (
      SELECT entity_key, arg_max(new_owner, (block, tx_index, op_index)) FILTER (op IN ('create', 'transfer')) AS owner, arg_max(expires_at, (block, tx_index, op_index)) FILTER (op IN ('create', 'extend')) AS expires_at, NOT bool_or(op = 'delete') AS alive
      FROM oplog WHERE valid GROUP BY entity_key),
    q AS (SELECT alive, alive AND expires_at <= {AT_BLOCK} AND owner % 11 <> 0 AS queued FROM t)
    SELECT list_position(['create', 'update', 'extend', 'transfer', 'delete', 'expire'], op) - 1 AS place, op, count(*) AS sent, count(*) FILTER (valid) AS confirmed, count(*) FILTER (NOT valid) AS failed,
      (SELECT count(*) FROM q WHERE alive AND NOT queued) AS alive, (SELECT count(*) FROM q WHERE queued) AS expired_queue, (SELECT count(DISTINCT sender) FROM oplog WHERE sender % 11 = 0) AS in_flight
    FROM oplog GROUP BY op"""
)
def status_report(spark, sf_dir):
    """The report over all operations, with how many entities are alive and queued to expire, and senders in flight."""
    ops = written(oplog(spark, sf_dir), "status")
    named = ops.withColumnsRenamed({"entity_key": "entity", "sender": "signer", "new_owner": "receiver"})
    entities = generate.promoted(generate.tracked(named, F.col("valid")), AT_BLOCK, F.col("owner") % PENDING == 0)
    counts = entities.agg(F.count_if(F.col("alive") & ~F.col("queued")).alias("alive"), F.count_if("queued").alias("expired_queue"))
    busy = ops.filter(F.col("sender") % PENDING == 0).agg(F.countDistinct("sender").alias("in_flight"))
    return generate.status(ops.withColumnRenamed("valid", "confirmed")).crossJoin(counts).crossJoin(busy)


@query("SELECT c_custkey AS address, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS account, c_custkey IS NOT NULL AND s_suppkey IS NOT NULL AS replaced FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT s_suppkey, s_name, false FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def alloc_merge(spark, sf_dir):
    """Accounts of customers, with those of suppliers put over them by number."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"), F.col("c_name").alias("account"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("address"), F.col("s_name").alias("account"))
    return batch.alloc_merge(old, new)


@query("WITH n AS (SELECT event_id, event_id % 2 = 1 AS p, event_id // 2 % 2 = 1 AS u, event_id // 4 % 2 = 1 AS d FROM events) SELECT event_id, CASE WHEN NOT (p OR u OR d) THEN 'disabled' WHEN p AND u AND NOT d THEN 'database' WHEN p AND d AND NOT u THEN 'logging' ELSE 'error' END AS mode FROM n")
def mode_table(spark, sf_dir):
    from ..streaming.settings import MODES

    modes = spark.createDataFrame(MODES, "p boolean, u boolean, d boolean, mode string")
    bit = lambda k: F.expr(f"event_id div {1 << k}") % 2 == 1
    rows = table(spark, sf_dir, "events").select("event_id", bit(0).alias("p"), bit(1).alias("u"), bit(2).alias("d"))
    return rows.join(F.broadcast(modes), ["p", "u", "d"]).select("event_id", "mode")


@query(None)
def workload(spark, sf_dir):
    """A generated workload, the same for every partitioning."""
    return generate.batches(spark, 2000, 42)


@query(None)
def keccak_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("event:"), F.col("event_id").cast("string")).cast("binary").alias("raw"))
    return rows.select("event_id", F.lower(F.hex(digest.keccak256("raw"))).alias("keccak"))


@query(None)
def checksum_address(spark, sf_dir):
    owners = table(spark, sf_dir, "documents").select("source").distinct()
    return owners.select("source", digest.checksum_address(F.unhex(F.sha2(F.col("source").cast("binary"), 256).substr(1, 40))).alias("address"))


@query(f"WITH {OPLOG_SQL} SELECT block, tx_index, op_index, op, entity_key, expires_at FROM oplog WHERE valid")
def wire_roundtrip(spark, sf_dir):
    """Operations written as wire messages, one for each block, and read back from them."""
    from ..sources import wire

    op = F.struct(F.upper("op").alias("type"), F.col("op_index").cast("int").alias("opIndex"), F.concat(F.lit("0x"), "entity_key").alias("entityKey"), codecs.hex_u64(F.col("expires_at")).alias("expiresAt"), F.concat(F.lit("0x"), "entity_hash").alias("entityHash"))
    txs = valid_ops(spark, sf_dir).groupBy("block", "tx_index").agg(F.array_sort(F.collect_list(F.struct("op_index", op.alias("o")))).alias("ops"))
    blocks = txs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("tx_index", F.struct(F.col("tx_index").cast("int").alias("index"), F.col("ops.o").alias("operations")).alias("t")))).alias("txs"))
    block = F.struct(F.struct(codecs.hex_u64(F.col("block")).alias("number")).alias("header"), F.col("txs.t").alias("transactions"))
    messages = blocks.select(F.to_json(F.struct(F.array(block).alias("blocks"))).alias("value"))
    rows = wire.operation_rows(wire.block_rows(wire.parse(messages)))
    return rows.select("block", F.col("tx_index").cast("long"), F.col("op_index").cast("long"), "op", "entity_key", "expires_at")


@query(f"WITH {STATE_SQL} SELECT * FROM state")
def stream_commit(spark, sf_dir):
    """State of a store that a stream filled, file by file."""
    from ..streaming import runner
    from ..streaming.store import OPS, LedgerStore

    names = [x.split()[0] for x in OPS.split(", ")]
    name = F.sha2(F.concat(F.lit("block:"), F.col("block").cast("string")).cast("binary"), 256)
    ops = valid_ops(spark, sf_dir).withColumn("block_hash", name).select(*names)
    source, store = shared_path(spark, "stream"), LedgerStore(spark, shared_path(spark, "store"))
    last = ops.agg(F.max("block")).first()[0] or 0
    for k in range(4):  # as they would come: older blocks in earlier files
        ops.filter((F.col("block") > last * k // 4 - (k == 0)) & (F.col("block") <= last * (k + 1) // 4)).coalesce(1).write.mode("append").parquet(source)

    def headers_of(part: DataFrame) -> DataFrame:
        span = part.agg(F.min("block").alias("a"), F.max("block").alias("b"))
        head = store.head()
        low = F.lit(head["number"] + 1 if head else 0).cast("long")
        block = lambda n: F.sha2(F.concat(F.lit("block:"), n.cast("string")).cast("binary"), 256)
        rows = span.select(F.explode(F.sequence(low, F.col("b"))).alias("number"))
        return rows.select("number", block(F.col("number")).alias("hash"), block(F.col("number") - 1).alias("parent_hash"), F.lit(chain.ZERO).alias("changeset_hash"), F.lit(None).cast("long").alias("timestamp"))

    runner.commit_segments(spark, source, ops.schema, store, headers_of, shared_path(spark, "stream-checkpoint"))
    return state.latest(store.ops())


# --- Sinks and the load generator's state


@query(
    f"""WITH {OPLOG_SQL} SELECT event_id, upper(op) || ' key=' || entity_key || ' owner=' || sender || CASE op WHEN 'create' THEN ' expires=' || expires_at || ' payload=' || amount || ' hash=' || entity_hash || ' attributes=0'
      WHEN 'update' THEN ' payload=' || amount || ' hash=' || entity_hash WHEN 'extend' THEN ' expires=' || expires_at ELSE '' END AS line FROM oplog WHERE valid"""
)
def log_projection(spark, sf_dir):
    rows = valid_ops(spark, sf_dir)
    line = report.log_line(*[F.col(c) for c in ("op", "entity_key", "sender", "expires_at", "entity_hash", "amount")], F.lit(0))
    return rows.select("event_id", line.alias("line"))


@query(f"WITH {OPLOG_SQL} SELECT block, count(DISTINCT tx_index) AS tx_count, count(*) AS op_count FROM oplog WHERE valid GROUP BY block")
def log_blocks(spark, sf_dir):
    return report.block_lines(valid_ops(spark, sf_dir))


@query(f"WITH {ENTITIES_SQL} SELECT count(*) AS count, {AT_BLOCK}::BIGINT AS block FROM docs WHERE \"contentType\" = 'text/plain'")
def query_report(spark, sf_dir):
    return report.result_report(api.query(document_entities(spark, sf_dir), '$contentType = "text/plain"'), AT_BLOCK)


@query(f"WITH {STATE_SQL} SELECT (sum(('0x' || sha256(entity_key || '|' || owner || '|' || coalesce(expires_at::VARCHAR, '') || '|' || alive)[1:15])::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT AS digest FROM state")
def state_digest(spark, sf_dir):
    return report.order_free_digest(state.latest(valid_ops(spark, sf_dir)), "entity_key", "owner", "expires_at", "alive")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'ok' END AS result, CASE event_id % 3 WHEN 1 THEN '-32001: parent' WHEN 2 THEN 'no result' END AS error FROM events")
def response_unwrap(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.lit(',"result":"ok"')).when(F.col("event_id") % 3 == 1, F.lit(',"result":"ok","error":{"code":-32001,"message":"parent"}')).otherwise(F.lit(""))
    return report.unwrapped(table(spark, sf_dir, "events").select(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), text, F.lit("}")).alias("value")))


#: Every so many-th event's transaction fails, and is in flight.
FAILED, PENDING = 5, 11


@query(
    f"""WITH {OPLOG_SQL}, good AS (SELECT *, CASE WHEN op = 'create' THEN sender ELSE new_owner END AS holder FROM oplog WHERE valid AND event_id % {FAILED} <> 0),
    t AS (SELECT entity_key AS entity, arg_max(holder, position) FILTER (op IN ('create', 'transfer')) AS owner, arg_max(expires_at, position) FILTER (op IN ('create', 'extend')) AS expires_at, NOT bool_or(op = 'delete') AS alive FROM good GROUP BY entity_key)
    SELECT *, alive AND expires_at <= {AT_BLOCK} AND coalesce(owner % {PENDING} <> 0, true) AS queued FROM t"""
)
def tracked_entities(spark, sf_dir):
    """Entities as a load generator sees them once failed transactions are left out, with what it would expire next."""
    ops = valid_ops(spark, sf_dir).withColumnsRenamed({"entity_key": "entity", "sender": "signer", "new_owner": "receiver"})
    rows = generate.tracked(ops, F.col("event_id") % FAILED != 0)
    return generate.promoted(rows, AT_BLOCK, F.coalesce(F.col("owner") % PENDING == 0, F.lit(False)))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'expire' WHEN event_id % 11 < 4 THEN 'create' WHEN event_id % 11 < 7 THEN 'update' WHEN event_id % 11 < 9 THEN 'extend' WHEN event_id % 11 < 10 THEN 'transfer' ELSE 'delete' END AS op FROM events")
def kind_choice(spark, sf_dir):
    queued = F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", generate.chosen_kind(queued, F.col("event_id") % 11).alias("op"))


@query("SELECT 100 + unnest(range(0, 500)) AS nonce, 'create' AS op, 256 AS size")
def spam_creates(spark, sf_dir):
    return generate.spam(spark, 500, 100)


from . import catalogue_wire  # noqa: E402,F401 - registers its queries
