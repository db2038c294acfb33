"""Values of the wire format and of the command line, as Columns.

Fixed-width numbers are big-endian binary, so that binary order is numeric order. Hex text is lower case with 0x.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types that generated operations use. Fixed values.
CONTENT_TYPES = ("application/json", "application/octet-stream", "text/plain", "image/png", "image/jpeg")
DEFAULT_CONTENT_TYPE = "application/octet-stream"
#: Operation names in the order of reports. Fixed values.
OPERATIONS = ("create", "update", "extend", "transfer", "delete", "expire")
WORD_BYTES, STRING_BYTES = 32, 128


def hex_u64(n: Column) -> Column:
    """0x hex without leading zeros."""
    return F.concat(F.lit("0x"), F.lower(F.hex(n.cast("long"))))


def parse_u64(text: Column) -> Column:
    """The number of a 0x hex text of up to 16 digits; null if it isn't one, or above what a long holds."""
    digits = F.regexp_extract(text, "^0x([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)")).try_cast("long")


def uint_word(n: Column) -> Column:
    """A 32-byte big-endian word."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * WORD_BYTES, "0"))


def word_uint(word: Column) -> Column:
    """The number of a 32-byte word; null above what a long holds."""
    high, low = F.substring(F.hex(word), 1, 48), F.substring(F.hex(word), 49, 16)
    return F.when((high == "0" * 48) & (F.substring(low, 1, 1) < "8"), F.conv(low, 16, 10).cast("long"))


def word_text(word: Column) -> Column:
    """The number of a 32-byte word as text: decimal where a long holds it, else 0x hex without leading zeros."""
    return F.coalesce(word_uint(word).cast("string"), F.concat(F.lit("0x"), F.lower(F.ltrim(F.hex(word), F.lit("0")))))


def hex_word(text: Column) -> Column:
    """The 32-byte word of a 0x hex text of up to 64 digits, so of any 256-bit number; null if it isn't one."""
    digits = F.regexp_extract(text, "^0x([0-9a-fA-F]{1,64})$", 1)
    return F.when(digits != "", F.unhex(F.lpad(digits, 2 * WORD_BYTES, "0")))


def parse_u64_decimal(text: Column) -> Column:
    """The number of a 0x hex text of up to 16 digits, as a decimal that holds all of them; null if it isn't one."""
    digits = F.regexp_extract(text, "^0x([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)"))


def hex_u64_decimal(n: Column) -> Column:
    """0x hex without leading zeros of a decimal from 0 up to, but not including, 2 to the 64; null for others."""
    d = n.cast("decimal(20,0)")
    return F.when((d >= 0) & (d < F.lit("18446744073709551616").cast("decimal(20,0)")), F.concat(F.lit("0x"), F.lower(F.conv(d.cast("string"), 10, 16))))


def string_container(text: Column) -> Column:
    """UTF-8 bytes, padded with NULs to 128; null if there are more."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.length(raw) <= STRING_BYTES, F.unhex(F.rpad(F.hex(raw), 2 * STRING_BYTES, "0")))


def container_string(raw: Column) -> Column:
    """The text in a container, without the NULs behind it, for display; bytes that are no UTF-8 become U+FFFD."""
    return F.decode(F.unhex(F.regexp_replace(F.hex(raw), "(00)+$", "")), "UTF-8")


def hex_bytes(text: Column, empty: bool) -> Column:
    """The bytes of 0x text; null where it isn't whole bytes of hex (unhex itself takes more). empty: whether 0x alone is one."""
    return F.when(text.rlike("^0x([0-9a-fA-F]{2})" + ("*$" if empty else "+$")), F.unhex(F.substring(text, 3, 1 << 30)))


def cli_payload(text: Column) -> Column:
    """Struct(payload, error): 0x text is hex and must not be empty, all other text is itself."""
    is_hex = text.startswith("0x")
    payload = F.when(is_hex, hex_bytes(text, False)).otherwise(F.encode(text, "UTF-8"))
    return F.struct(payload.alias("payload"), F.when(is_hex & payload.isNull(), F.lit("bad hex payload")).alias("error"))


def batch_payload(text: Column, size: Column) -> Column:
    """Struct(payload, error): text or size or neither, never both; 0x alone is empty; a size gives zero bytes here."""
    both = text.isNotNull() & size.isNotNull()
    is_hex = text.startswith("0x")
    payload = F.when(both, F.lit(None)).when(size.isNotNull(), F.unhex(F.repeat(F.lit("00"), size.cast("int")))).when(text.isNull(), F.lit(b"")).when(is_hex, hex_bytes(text, True)).otherwise(F.encode(text, "UTF-8"))
    error = F.when(both, F.lit("payload and size")).when(is_hex & payload.isNull(), F.lit("bad hex payload"))
    return F.struct(payload.alias("payload"), error.alias("error"))


def wei_text(wei: Column) -> Column:
    """Whole and 18 decimal digits, with the unit."""
    unit = F.lit("1000000000000000000").cast("decimal(38,0)")
    d = wei.cast("decimal(38,0)")
    return F.concat(F.call_function("div", d, unit).cast("string"), F.lit("."), F.lpad((d % unit).cast("decimal(38,0)").cast("string"), 18, "0"), F.lit(" ETH"))


def seconds_of(text: Column) -> Column:
    """Seconds of a duration such as 90s, 5m, 2h, 1d; 0, inf and infinity are 0, which is unbounded; null for others."""
    amount, unit = F.regexp_extract(text, "^([0-9]{1,9})(s|m|h|d)$", 1), F.regexp_extract(text, "^([0-9]{1,9})(s|m|h|d)$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(text.isin("0", "inf", "infinity"), F.lit(0).cast("long")).when(amount != "", amount.try_cast("long") * factor)


def shorthand_type(value: Column) -> Column:
    """What an attribute value without a type is: a quoted string, an entity key (0x and 64 hex digits), a number, or nothing."""
    quoted = value.rlike("^'(.|\\n)*'$") | value.rlike('^"(.|\\n)*"$')
    return F.when(quoted & (F.length(value) >= 2), F.lit("string")).when(value.rlike("^0x[0-9a-fA-F]{64}$"), F.lit("entityKey")).when(value.rlike("^[0-9]+$"), F.lit("uint"))


def valid_name(name: Column) -> Column:
    """An attribute's name: lower-case ASCII, 32 bytes at most, beginning with a letter."""
    return F.coalesce(name.rlike("^[a-z][a-z0-9._-]*$") & (F.octet_length(name) <= 32), F.lit(False))


def valid_content_type(name: Column) -> Column:
    """type/subtype of RFC 2045 tokens, with parameters perhaps, 128 bytes at most."""
    token = r"[A-Za-z0-9!#$%&'*+.^_`{|}~-]+"
    return F.coalesce(name.rlike(f"^{token}/{token}( *; *{token}={token})*$") & (F.octet_length(name) <= 128), F.lit(False))


def sorted_attributes(attributes: Column) -> Column:
    """Attributes (structs with name first) ascending by name."""
    return F.array_sort(attributes, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))


def strictly_sorted(attributes: Column) -> Column:
    """Whether names ascend without a repetition."""
    names = F.transform(attributes, lambda a: a["name"])
    return F.coalesce((names == F.array_sort(names)) & (F.size(F.array_distinct(names)) == F.size(names)), F.lit(False))


def saturating_difference(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))
