"""Binary records with length-prefixed, optional and repeated fields."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Little-endian numbers by name.
NUMBERS = {"u8": "<B", "u16": "<H", "u32": "<I", "u64": "<Q", "i64": "<q"}


class Damaged(ValueError):
    """The bytes end too early, a length runs over their end, or a text is not UTF-8."""


class Cursor:
    """Bytes with a place up to which they have been read."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Damaged
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, kind):
        """A value: a number's name, ``bool``, ``text`` (length in 32 bits, zero bytes at the end don't count), ``("bytes", n)`` as hex, ``("optional", kind)`` behind a flag byte,
        ``("many", kind)`` behind a count in 32 bits, or a list of (name, kind); a name of None is passed over."""
        if isinstance(kind, list):
            values = {}
            for name, inner in kind:
                value = self.read(inner)
                if name is not None:
                    values[name] = value
            return values
        if isinstance(kind, tuple):
            what, inner = kind
            if what == "bytes":
                return self.take(inner).hex()
            if what == "optional":
                flag = self.take(1)[0]
                if flag > 1:
                    raise Damaged
                return self.read(inner) if flag else None
            count = self.read("u32")
            if count > len(self.data) - self.at:  # each takes a byte at least
                raise Damaged
            return [self.read(inner) for _ in range(count)]
        if kind == "text":
            try:
                return self.take(self.read("u32")).decode().rstrip("\0")
            except UnicodeDecodeError as error:
                raise Damaged from error
        if kind == "bool":
            return self.take(1) != b"\0"
        return struct.unpack(NUMBERS[kind], self.take(struct.calcsize(NUMBERS[kind])))[0]


def parse(data: bytes | None, layout: list) -> dict | None:
    """A record's fields; None for null or damaged bytes. Bytes after the record are left unread, as accounts are often longer than what they hold."""
    if data is None:
        return None
    try:
        return Cursor(bytes(data)).read(layout)
    except Damaged:
        return None


def decoded(data: Column, layout: list, schema: str) -> Column:
    """A binary column as a struct of ``schema``, whose fields are those of the layout; null where the bytes are damaged. Parsed in Arrow batches."""

    @F.pandas_udf(StringType())
    def read(column: pd.Series) -> pd.Series:
        records = (parse(x, layout) for x in column)
        return pd.Series([None if r is None else json.dumps(r) for r in records], dtype=object)

    return F.from_json(read(data), schema)
