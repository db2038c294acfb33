"""Blocks as a node has them: transactions, receipts and senders side by side, of which the registry's are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from .paths import Files

LOG = "struct<address:string,event:string,entityKey:string>"
TRANSACTION = "struct<hash:string,to:string,input:string>"
RECEIPT = f"struct<status:boolean,logs:array<{LOG}>>"
#: A block's columns: what stands at one place in the three arrays belongs together.
RAW = f"number long, hash string, transactions array<{TRANSACTION}>, receipts array<{RECEIPT}>, senders array<string>"


class BlockError(ValueError):
    pass


def registry_transactions(blocks: DataFrame, registry: str) -> DataFrame:
    """number, tx_index, tx_hash, sender, input, status and logs (the registry's only) of calls of the registry itself.

    tx_index is the place among all transactions of the block, so there are gaps. Addresses compare without regard to
    case. A block in which the three arrays differ in length is an error. Blocks without such calls give no row here.
    """
    n = F.size(F.coalesce("transactions", F.array().cast(f"array<{TRANSACTION}>")))
    whole = (n == F.size(F.coalesce("receipts", F.array().cast(f"array<{RECEIPT}>")))) & (n == F.size(F.coalesce("senders", F.array().cast("array<string>"))))
    zipped = F.when(whole, F.arrays_zip("transactions", "receipts", "senders")).otherwise(F.raise_error(F.concat(F.lit("transactions, receipts and senders differ in block "), F.col("number").cast("string"))))
    rows = blocks.select("number", F.posexplode(zipped).alias("tx_index", "x"))
    same = lambda address: F.lower(address) == registry.lower()
    rows = rows.filter(same(F.col("x.transactions.to")))
    logs = F.filter(F.coalesce("x.receipts.logs", F.array().cast(f"array<{LOG}>")), lambda x: F.coalesce(same(x["address"]), F.lit(False)))
    return rows.select("number", "tx_index", F.col("x.transactions.hash").alias("tx_hash"), F.col("x.senders").alias("sender"), F.col("x.transactions.input").alias("input"), F.col("x.receipts.status").alias("status"), logs.alias("logs"))


def events_of(transactions: DataFrame, event: str) -> DataFrame:
    """tx, log_index and entity_key of one kind of event, for decode.paired; tx is (number, tx_index)."""
    rows = transactions.select(F.struct("number", "tx_index").alias("tx"), F.posexplode("logs").alias("log_index", "x"))
    return rows.filter(F.col("x.event") == event).select("tx", "log_index", F.col("x.entityKey").alias("entity_key"))


def with_operations(transactions: DataFrame) -> DataFrame:
    """Transactions that have an operation: those without are left out, not set aside."""
    return transactions.filter(F.size("operations") > 0)


def planned_and_made(planned: DataFrame, made: DataFrame) -> DataFrame:
    """tx, ordinal, planned and made: the creates of a batch and the create events of its receipt, in order; null where one is missing."""
    from ..operators.decode import ordinals

    left = ordinals(planned, "op_index").select("tx", "ordinal", F.col("op_index").alias("planned"))
    right = ordinals(made, "log_index").select("tx", "ordinal", F.col("entity_key").alias("made"))
    return left.join(right, ["tx", "ordinal"], "full_outer")


def owner_addresses(rows: DataFrame, signers: DataFrame, index: str = "receiver") -> DataFrame:
    """rows with `address` of the signer that `index` names. signers: index, address; at most a hundred, so broadcast.

    An index that no signer has is an error.
    """
    named = signers.select(F.col("index").alias("_index"), F.col("address").alias("_address")).limit(101)
    if named.count() > 100:
        raise BlockError("more than 100 signers")
    out = rows.join(F.broadcast(named), F.col(index) == F.col("_index"), "left")
    wrong = F.raise_error(F.concat(F.lit("no signer "), F.col(index).cast("string"))).cast("string")
    return out.withColumn("address", F.when(F.col(index).isNotNull(), F.coalesce("_address", wrong))).drop("_index", "_address")


def has_code(accounts: DataFrame, address: str, code_hash: str) -> Column:
    """Whether an account of a table (address, code_hash) is the expected one: its address and its code's hash."""
    return (F.lower(accounts["address"]) == address.lower()) & F.coalesce(F.lower(accounts["code_hash"]) == code_hash.lower(), F.lit(False))


def injected(accounts: DataFrame, predeploy: str) -> DataFrame:
    """One row: how many accounts were put in besides the predeploy."""
    return accounts.agg(F.count_if(F.lower("address") != predeploy.lower()).alias("injected"))


def node_reads(transactions: DataFrame, blocks: DataFrame, address: str) -> DataFrame:
    """One row: the head's number, and how many transactions an address has sent. Balances are not kept."""
    sent = transactions.agg(F.count_if(F.lower("sender") == address.lower()).alias("transaction_count"))
    return blocks.agg(F.max("number").alias("block_number")).crossJoin(sent)  # a row each


def arguments(text: Column) -> Column:
    """The parts of a text between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def read_genesis(spark: SparkSession, path: str) -> dict:
    """A genesis file's object."""
    import json

    found = json.loads(Files(spark).read(path))
    if not isinstance(found, dict):
        raise BlockError("a genesis file is one object")
    return found


def random_payload(size: Column, number: Column, seed: int) -> Column:
    """So many bytes, a function of the seed and the number; null where size is."""
    most = F.ceil(size / 32).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: F.sha2(F.concat_ws(":", F.lit(str(seed)), number.cast("string"), k.cast("string")).cast("binary"), 256))
    return F.when(size.isNotNull(), F.unhex(F.substring(F.array_join(parts, ""), F.lit(1), (2 * size).cast("int"))))


def payload_choice(text: Column, size: Column) -> Column:
    """The error of a payload that is given as text or as a size, exactly one of them; null where it is right."""
    return F.when(text.isNotNull() & size.isNotNull(), F.lit("text and size")).when(text.isNull() & size.isNull(), F.lit("text or size")).when(text.isNotNull(), codecs.cli_payload(text)["error"])
