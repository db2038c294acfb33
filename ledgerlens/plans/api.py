"""Reads of a ledger: queries with paging and projection, counts, timing, commitments, hashes and history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import chain, report, state
from ..sources.wire import TYPED
from .expression import compile_query

#: Columns of a result that a projection chooses from.
RESULT = ("key", "contentType", "expiresAt", "owner")


@dataclass(frozen=True)
class Options:
    """resultsPerPage: a number or 0x hex text. cursor: the last key of the page before. fields: columns of the result.
    at_block: the block whose state is asked; entities not created by then, or gone, aren't there. live_only: leave out what is expirable."""

    resultsPerPage: int | str | None = None
    cursor: str | None = None
    fields: tuple[str, ...] = RESULT
    at_block: int | None = None
    live_only: bool = False

    @property
    def size(self) -> int | None:
        n = self.resultsPerPage
        return int(n, 16) if isinstance(n, str) else n


def query(entities: DataFrame, text: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The entities for which the text holds; a page is in the order of keys, behind the cursor.

    The filter and the columns reach the scan; a page is the least keys of each task, then of all.
    """
    rows = entities.filter(compile_query(text))
    if options.live_only and options.at_block is not None:
        rows = rows.filter(F.col("expiresAt") > options.at_block)
    if options.cursor is not None:
        rows = rows.filter(F.col("key") > options.cursor)
    rows = rows.select(*options.fields)
    return rows if options.size is None else rows.orderBy("key").limit(options.size)


def state_entities(ops: DataFrame, at_block: int | None = None) -> DataFrame:
    """State of operations in the columns that queries use. Owners that are numbers are given as hex; of operations that
    messages brought, payload, type and attributes are there too."""
    if "payload" in ops.columns:
        rows = state.entities(ops if at_block is None else ops.filter(F.col("block") <= at_block)).filter("alive")
        return rows.select(F.col("entity_key").alias("key"), F.lower("owner").alias("owner"), F.coalesce("content_type", F.lit(codecs.DEFAULT_CONTENT_TYPE)).alias("contentType"), F.col("expires_at").alias("expiresAt"), "payload", F.coalesce("attributes", F.array().cast(TYPED)).alias("attributes"))
    rows = state.latest(ops) if at_block is None else state.as_of(ops, at_block)
    return rows.filter("alive").select(F.col("entity_key").alias("key"), F.lower(F.hex("owner")).alias("owner"), F.lit(codecs.DEFAULT_CONTENT_TYPE).alias("contentType"), F.col("expires_at").alias("expiresAt"), F.array().cast(TYPED).alias("attributes"))


class Ledger:
    """Reads over operations (see state.py) and headers (number, timestamp, hash, parent_hash, changeset_hash)."""

    def __init__(self, ops: DataFrame, headers: DataFrame):
        self.ops, self.headers = ops, headers

    def query(self, text: str, options: Options = Options()) -> DataFrame:  # noqa: B008
        return query(state_entities(self.ops, options.at_block), text, options)

    def entity_count(self) -> DataFrame:
        return state.latest(self.ops).filter("alive").agg(F.count("*").alias("entity_count"))

    def block_timing(self) -> DataFrame:
        """current_block, current_block_time and duration since the block before, never below 0."""
        last = self.headers.orderBy(F.desc("number")).limit(2)
        return last.agg(F.max("number").alias("current_block"), F.max_by("timestamp", "number").alias("current_block_time"), codecs.saturating_difference(F.max_by("timestamp", "number"), F.min_by("timestamp", "number")).alias("duration"))

    def first_block(self) -> DataFrame:
        """number and hash of the chain's first block."""
        return self.headers.agg(F.min("number").alias("number"), F.min_by("hash", "number").alias("hash"))

    def commitment(self, key: str) -> DataFrame:
        return state.latest(self.ops.filter(F.col("entity_key") == key))

    def head_hash(self, at_block: int | None = None) -> DataFrame:
        """The rolling hash at the head, or as it was at a block."""
        rows = self.headers if at_block is None else self.headers.filter(F.col("number") <= at_block)
        return rows.agg(F.coalesce(F.max_by("changeset_hash", "number"), F.lit(chain.ZERO)).alias("changeset_hash"))

    def history(self, depth: int) -> DataFrame:
        """The oldest `depth` operations, with a number of the transaction among those of its block."""
        return self.ops.orderBy("block", "position").limit(depth).select("block", "tx_index", "op_index", "op", "entity_key", "sender")

    def hash_history(self, depth: int) -> DataFrame:
        """block, tx, op and claimed of the oldest `depth` operations: tx and op count from 0 in their block and transaction.

        The number of a transaction is its place among those with operations here, not its index in the block.
        """
        first = self.ops.orderBy("block", "position").limit(depth)  # a page, so windows over a block are small
        tx = F.dense_rank().over(Window.partitionBy("block").orderBy("tx_index")) - 1
        op = F.row_number().over(Window.partitionBy("block", "tx_index").orderBy("position")) - 1
        return first.select("block", tx.cast("long").alias("tx"), op.cast("long").alias("op"), "claimed")

    def hash_at(self, block: int, tx: int, op: int) -> DataFrame:
        """claimed of one operation, named as hash_history names it; no row if there is none."""
        here = self.ops.filter(F.col("block") == block)
        return Ledger(here, self.headers).hash_history(1 << 30).filter((F.col("tx") == tx) & (F.col("op") == op)).select("claimed")

    def nonces(self) -> DataFrame:
        """sender and nonce: how many creates each sender has made, which is the number of the next one."""
        return self.ops.groupBy("sender").agg(F.count_if(F.col("op") == "create").alias("nonce"))

    def call(self, method: str, params: list | None = None) -> dict:
        """A read by its name and positional parameters, as a JSON-RPC result or error object. The name may have a prefix.

        query(text, options), getEntityCount(), getBlockTiming(), changeSetHash() and ping(). A page of a query comes to
        the driver, so a query without resultsPerPage is an error here: use query().
        """
        try:
            return {"result": self._reads()[method.rpartition("_")[2]](*(params or []))}
        except KeyError:
            return {"error": {"code": chain.READ_ERROR, "message": f"unknown method {method}"}}
        except chain.ChainError as e:
            return {"error": {"code": e.code, "message": str(e), "data": e.data}}
        except Exception as e:  # noqa: BLE001 - whatever goes wrong in a read is one kind of error to the caller
            return {"error": {"code": chain.READ_ERROR, "message": str(e)}}

    def _reads(self) -> dict:
        def page(text: str, options: dict | None = None) -> dict:
            found = options or {}
            known = {"resultsPerPage": found.get("resultsPerPage"), "cursor": found.get("cursor"), "at_block": found.get("atBlock")}
            if known["resultsPerPage"] is None:
                raise ValueError("resultsPerPage is missing")
            asked = Options(**known)
            rows = [r.asDict() for r in self.query(text, asked).collect()]
            last = rows[-1]["key"] if rows and len(rows) == asked.size else None
            head = asked.at_block if asked.at_block is not None else self.headers.agg(F.max("number")).first()[0]
            return {"data": rows, "blockNumber": head} | ({"cursor": last} if last else {})

        one = lambda df: df.first().asDict()
        return {
            "query": page,
            "getEntityCount": lambda: one(self.entity_count())["entity_count"],
            "getBlockTiming": lambda: one(self.block_timing()),
            "changeSetHash": lambda: one(self.head_hash())["changeset_hash"],
            "ping": lambda: "pong",
        }

    def report(self, text: str, options: Options) -> DataFrame:
        """One row: count, block and entities (an array of the chosen fields) of a page of a query."""
        block = options.at_block if options.at_block is not None else self.headers.agg(F.max("number")).first()[0]
        return report.result_report(self.query(text, options), block, options.fields, whole=True)
