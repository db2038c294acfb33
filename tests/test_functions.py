import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import codecs, digest, shorthand
from ledgerlens.plans import expression


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_keccak_known_answers(spark):
    got = digest.keccak_many([b"", b"abc", b"", b"x" * 135, b"x" * 136, b"x" * 1000])
    assert got[0].hex() == got[2].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert got[1].hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert len({g for g in got}) == 5
    rows = spark.createDataFrame([(b"abc",), (None,)], "b binary").select(digest.keccak256("b").alias("k")).collect()
    assert bytes(rows[0].k) == got[1] and rows[1].k is None


@pytest.mark.parametrize("address", ["5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "fB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", "dbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB"])
def test_checksum_address(spark, address):
    assert one(spark, digest.checksum_address(F.unhex(F.lit(address.lower())))) == "0x" + address


def test_numbers_and_containers(spark):
    assert one(spark, codecs.parse_u64(F.lit("0x1f"))) == 31
    for bad in ("1f", "0x", "0xzz", "0xffffffffffffffff", "0x11111111111111111"):
        assert one(spark, codecs.parse_u64(F.lit(bad))) is None
    assert one(spark, codecs.word_uint(codecs.uint_word(F.lit(258)))) == 258
    assert one(spark, codecs.word_uint(F.unhex(F.lit("ff" * 32)))) is None
    assert one(spark, codecs.container_string(codecs.string_container(F.lit("é漢")))) == "é漢"
    assert one(spark, codecs.string_container(F.lit("x" * 129))) is None
    assert one(spark, codecs.wei_text(F.lit("1500000000000000000").cast("decimal(38,0)"))) == "1.500000000000000000 ETH"


@pytest.mark.parametrize(
    ("text", "cli", "batch"),
    [("hello", b"hello", b"hello"), ("0x00ff", b"\x00\xff", b"\x00\xff"), ("0x", None, b""), ("0xabc", None, None), ("0xzz", None, None), (None, None, b"")],
)
def test_payloads(spark, text, cli, batch):
    got = one(spark, codecs.batch_payload(F.lit(text).cast("string"), F.lit(None).cast("int")))
    assert (None if got.payload is None else bytes(got.payload)) == batch and (got.error is None) == (batch is not None)
    if text is not None:
        got = one(spark, codecs.cli_payload(F.lit(text)))
        assert (None if got.payload is None else bytes(got.payload)) == cli
    assert one(spark, codecs.batch_payload(F.lit("a"), F.lit(1))).error == "payload and size"
    assert len(one(spark, codecs.batch_payload(F.lit(None).cast("string"), F.lit(3))).payload) == 3


def test_attribute_lists():
    key = "0x" + "ab" * 32
    got = shorthand.parse_attributes(rf"b='x,y\n\'',a=1,c:string=z,d:key={key},e={key},f:u256=7")
    assert [(a.name, a.value_type, a.value) for a in got] == [("a", "uint", "1"), ("b", "string", "x,y\n'"), ("c", "string", "z"), ("d", "entityKey", key), ("e", "entityKey", key), ("f", "uint", "7")]
    assert shorthand.parse_attributes("") == []
    for bad in ("a", "=1", "a=", "a=1,", "a='x", "a:foo=1", "a=hello", "a='", "a=1,a=2", "A=1", r"a='\q'", "a:uint=x", "a:key=0x1"):
        with pytest.raises(shorthand.ShorthandError):
            shorthand.parse_attributes(bad)


def test_weights_and_references():
    assert shorthand.parse_weights("create=4,update=3") == [("create", 4), ("update", 3)]
    for bad in ("expire=1", "create", "create=x", "create=0", ""):
        with pytest.raises(shorthand.ShorthandError):
            shorthand.parse_weights(bad)
    assert shorthand.parse_reference("$12") == 12 and shorthand.parse_reference("0x" + "0a" * 32) == b"\x0a" * 32
    with pytest.raises(shorthand.ShorthandError):
        shorthand.parse_reference("$x")


def test_query_language():
    assert expression.parse("*") == expression.All() == expression.parse(" $all ")
    assert expression.parse('type = "n\\"ft"') == expression.Compare("type", "=", "string", 'n"ft')
    tree = expression.parse("not a = 1 or b < 2 and (c = 0xAB)")
    assert tree == expression.Join("||", expression.Not(expression.Compare("a", "=", "number", "1")), expression.Join("&&", expression.Compare("b", "<", "number", "2"), expression.Compare("c", "=", "hex", "ab")))
    for bad in ("", "a", "a =", 'a = "', "$owner = 1", "$nothing = 1", "a = 1 b = 2", "(a = 1", "a ~ 1", "= 1", "'; drop table x"):
        with pytest.raises(expression.QueryError):
            expression.parse(bad)
