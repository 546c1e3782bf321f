"""Typed values in byte cells, and arithmetic on byte keys.

Everything that runs over rows is a built-in expression; floating point, variable
length integers and printable escapes have no built-in form and are Arrow UDFs.
"""

from __future__ import annotations

import re
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDTH = {"short": 2, "int": 4, "long": 8}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_string(x: Column | str) -> Column:
    return _c(x).cast("string").cast("binary")


def decode_string(x: Column | str) -> Column:
    return _c(x).cast("string")


def encode_number(x: Column | str, kind: str = "long") -> Column:
    """Big-endian two's complement of 2, 4 or 8 bytes."""
    n = _WIDTH[kind]
    return F.unhex(F.right(F.lpad(F.hex(_c(x).cast("long")), 16, "0"), F.lit(2 * n)))


def decode_number(x: Column | str, kind: str = "long") -> Column:
    """The number in the first bytes of its width; null if there are fewer."""
    n = _WIDTH[kind]
    raw = F.when(F.octet_length(_c(x)) >= n, F.conv(F.hex(F.substring(_c(x), 1, n)), 16, -10).cast("decimal(20,0)"))
    if n < 8:
        half, full = 1 << (8 * n - 1), 1 << (8 * n)
        raw = F.when(raw >= half, raw - full).otherwise(raw)
    return raw.cast("long")


def encode_boolean(x: Column | str) -> Column:
    return F.when(_c(x), F.lit(b"\xff")).when(~_c(x), F.lit(b"\x00"))


def decode_boolean(x: Column | str) -> Column:
    return _c(x) != F.lit(b"\x00")


def _pandas(kind: T.DataType, one):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return run


def encode_double(x: Column | str) -> Column:
    return _pandas(T.BinaryType(), lambda v: struct.pack(">d", v))(_c(x).cast("double"))


def decode_double(x: Column | str) -> Column:
    return _pandas(T.DoubleType(), lambda v: struct.unpack(">d", bytes(v[:8]))[0])(_c(x))


def encode_float(x: Column | str) -> Column:
    return _pandas(T.BinaryType(), lambda v: struct.pack(">f", v))(_c(x).cast("double"))


def decode_float(x: Column | str) -> Column:
    return _pandas(T.DoubleType(), lambda v: struct.unpack(">f", bytes(v[:4]))[0])(_c(x))


def vint(n: int) -> bytes:
    """Variable length integer: one byte in -112..127, else a length mark and the bytes."""
    if -112 <= n <= 127:
        return struct.pack("b", n)
    mark, n = (-112, n) if n >= 0 else (-120, ~n)
    body = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return struct.pack("b", mark - len(body)) + body


def read_vint(data: bytes) -> int:
    (mark,) = struct.unpack("b", data[:1])
    if mark >= -112:
        return mark
    size = -112 - mark if mark >= -120 else -120 - mark
    n = int.from_bytes(data[1 : 1 + size], "big")
    return n if mark >= -120 else ~n


def encode_vint(x: Column | str) -> Column:
    return _pandas(T.BinaryType(), lambda v: vint(int(v)))(_c(x).cast("long"))


def decode_vint(x: Column | str) -> Column:
    return _pandas(T.LongType(), lambda v: read_vint(bytes(v)))(_c(x))


#: Characters that the printable form shows as they are, beside letters and digits.
PLAIN = " `~!@#$%^&*()-_=+[]{}|;:'\",.<>/?"


def printable(data: bytes) -> str:
    return "".join(chr(b) if chr(b) in PLAIN or (b < 128 and chr(b).isalnum()) else f"\\x{b:02X}" for b in data)


def from_printable(text: str) -> bytes:
    return b"".join(bytes([int(m[1], 16)]) if m[1] else m[0].encode() for m in re.finditer(r"\\x([0-9A-Fa-f]{2})|.", text, re.S))


def to_printable(x: Column | str) -> Column:
    return _pandas(T.StringType(), lambda v: printable(bytes(v)))(_c(x))


def head(x: Column | str, n: int) -> Column:
    return F.when(F.octet_length(_c(x)) >= n, F.substring(_c(x), 1, n))


def tail(x: Column | str, n: int) -> Column:
    return F.when(F.octet_length(_c(x)) >= n, F.substring(_c(x), -n, n) if n else F.lit(b""))


def pad_head(x: Column | str, n: int) -> Column:
    return F.concat(F.lit(bytes(n)), _c(x))


def pad_tail(x: Column | str, n: int) -> Column:
    return F.concat(_c(x), F.lit(bytes(n)))


def format_row(x: Column | str, width: int = 10) -> Column:
    """A number as a zero-padded row key."""
    return F.lpad(_c(x).cast("string"), width, "0").cast("binary")


def increment_bytes(x: Column | str, amount: Column | int) -> Column:
    """Big-endian addition to a value of up to 8 bytes, carried, overflow wrapping."""
    wide = F.concat(F.lit(bytes(8)), _c(x))
    by = F.lit(amount) if isinstance(amount, int) else amount
    total = decode_number(F.substring(wide, -8, 8)).cast("decimal(38,0)") + by.cast("decimal(38,0)")
    half, full = (F.lit(Decimal(1 << n)).cast("decimal(38,0)") for n in (63, 64))
    wrapped = F.pmod(total + half, full) - half
    return F.substring(encode_number(wrapped), F.lit(9) - F.octet_length(_c(x)), F.octet_length(_c(x)))


def succ(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with this prefix; None if there is none."""
    stripped = prefix.rstrip(b"\xff")
    return stripped[:-1] + bytes([stripped[-1] + 1]) if stripped else None


def split_keys(a: bytes, b: bytes, n: int) -> list[bytes]:
    """``a``, n evenly spaced keys, ``b``; raises if they don't fit between."""
    width = max(len(a), len(b))
    lo, hi = (int.from_bytes(x.ljust(width, b"\0"), "big") for x in (a, b))
    if lo >= hi:
        raise ValueError("the first key must be below the second")
    while hi - lo < n + 1:
        width, lo, hi = width + 1, lo << 8, hi << 8
    return [a, *((lo + (hi - lo) * i // (n + 1)).to_bytes(width, "big") for i in range(1, n + 1)), b]


def hex_splits(regions: int, width: int = 8) -> list[bytes]:
    """Borders of ``regions`` even parts of the space of lower-case hex keys."""
    top = 16**width
    return [f"{top * i // regions:0{width}x}".encode() for i in range(1, regions)]


def parse_column(spec: str) -> tuple[str, bytes | None]:
    """``family`` or ``family:`` is the whole family, ``family:qualifier`` one column."""
    family, mark, qualifier = spec.partition(":")
    return family, qualifier.encode() if mark and qualifier else None


def parse_columns(specs: str | list[str]) -> list[tuple[str, bytes | None]]:
    return [parse_column(s) for s in (specs.split() if isinstance(specs, str) else specs)]


def url_key(url: Column | str) -> Column:
    """Reversed-domain row key: scheme, host parts from the right, then the rest."""
    u = _c(url)
    scheme, host = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)", 1), F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]+)", 1)
    rest = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^:/?#]+(.*)$", 1)
    return F.when(host == "", u).otherwise(F.concat(F.lit("r:"), scheme, F.array_join(F.reverse(F.split(host, r"\.")), "."), rest))


def url_of_key(key: Column | str) -> Column:
    k = F.regexp_extract(_c(key), r"^r:(.*)$", 1)
    scheme, host, rest = (F.regexp_extract(k, r"^([^:]+://)([^:/?#]+)(.*)$", i) for i in (1, 2, 3))
    return F.when(~_c(key).startswith("r:"), _c(key)).otherwise(F.concat(scheme, F.array_join(F.reverse(F.split(host, r"\.")), "."), rest))


def md5_hex(x: Column | str) -> Column:
    return F.md5(_c(x))
