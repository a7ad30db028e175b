"""Binary records: bytes written by hand, whole and damaged."""

import base64

from pyspark.sql import functions as F

from loomwright.functions.records import decoded, parse

LAYOUT = [
    (None, "u8"), ("owner", ("bytes", 4)), ("name", "text"), ("symbol", "text"), ("fee", "u16"), ("parents", ("optional", ("many", [("key", ("bytes", 2)), ("checked", "bool"), ("share", "u8")]))), ("supply", ("optional", "u64")), ("when", "i64"),
]
SCHEMA = "owner string, name string, symbol string, fee int, parents array<struct<key:string,checked:boolean,share:int>>, supply long, `when` long"
WHOLE = (
    b"\x04" b"\xde\xad\xbe\xef" b"\x08\x00\x00\x00Nut\xc3\xa9\0\0\0" b"\x03\x00\x00\x00NUT" b"\xf4\x01"
    b"\x01\x02\x00\x00\x00" b"\x0a\x0b\x01\x50" b"\x0c\x0d\x00\x14" b"\x01\x15\xcd\x5b\x07\x00\x00\x00\x00" b"\xff\xff\xff\xff\xff\xff\xff\xff"
)
FIELDS = {"owner": "deadbeef", "name": "Nuté", "symbol": "NUT", "fee": 500, "parents": [{"key": "0a0b", "checked": True, "share": 80}, {"key": "0c0d", "checked": False, "share": 20}], "supply": 123456789, "when": -1}
BARE = b"\x04" b"\x00\x00\x00\x00" b"\x00\x00\x00\x00" b"\x00\x00\x00\x00" b"\x00\x00" b"\x00" b"\x00" b"\x01\x00\x00\x00\x00\x00\x00\x00"


def test_by_hand():
    assert parse(WHOLE, LAYOUT) == FIELDS
    assert parse(WHOLE + b"\0" * 50, LAYOUT) == FIELDS  # accounts are longer than what they hold
    assert parse(BARE, LAYOUT) == {"owner": "00000000", "name": "", "symbol": "", "fee": 0, "parents": None, "supply": None, "when": 1}
    assert parse(None, LAYOUT) is None and parse(b"", LAYOUT) is None


def test_damaged_bytes_are_null():
    assert all(parse(WHOLE[:n], LAYOUT) is None for n in range(len(WHOLE)))
    assert parse(WHOLE.replace(b"\x08\x00\x00\x00N", b"\xff\xff\xff\xffN"), LAYOUT) is None  # a length beyond the end
    assert parse(WHOLE.replace(b"\x01\x02\x00\x00\x00", b"\x01\x02\x00\x00\xf0"), LAYOUT) is None  # a count beyond the end
    assert parse(WHOLE.replace(b"\x01\x02\x00\x00\x00", b"\x07\x02\x00\x00\x00"), LAYOUT) is None  # no flag
    assert parse(WHOLE.replace(b"\xc3\xa9", b"\xc3\x28"), LAYOUT) is None  # no UTF-8


def test_columns(spark):
    rows = [(1, WHOLE), (2, WHOLE[:-1]), (3, None), (4, BARE), (5, base64.b64decode("AAAA"))]
    found = {r["k"]: r["r"] for r in spark.createDataFrame(rows, "k int, data binary").select("k", decoded(F.col("data"), LAYOUT, SCHEMA).alias("r")).collect()}
    assert found[1].asDict(recursive=True) == FIELDS and found[4]["when"] == 1 and found[4]["parents"] is None
    assert found[2] is found[3] is found[5] is None
