"""ASCII form of host names: Punycode for labels in other letters, dotted decimals for numeric addresses."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Other full stops, letters that host names ignore, and characters that they must not hold.
_STOPS = dict.fromkeys(map(ord, "。．｡"), ".")
_IGNORED = dict.fromkeys(map(ord, "­​⁠﻿️"))
_FORBIDDEN = re.compile(r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]")
_NUMBER = re.compile(r"[0-9]+|0[xX][0-9A-Fa-f]*")
_AUTHORITY = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?)([^\[:/?#][^:/?#]*)(.*)$", re.S)

# Addresses whose host is to be converted: it holds something else than ASCII, an escape, or ends with a number.
_CONVERTED = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:[^:/?#]*[^\x00-\x24\x26-\x7F][^:/?#]*|(?:[^:/?#]*\.)?(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?)(?:[:/?#]|$)"


def _number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return int(part, 8 if part[0] == "0" and len(part) > 1 else 10)
    except (ValueError, IndexError):
        return None


def dotted(labels: list[str]) -> str | None:
    """The four decimals of a numeric address; None if it is none.  Numbers may be decimal, octal or hexadecimal, and the last one fills the bytes that are left."""
    numbers = [_number(x) for x in labels]
    if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))


def ascii_host(host: str) -> str | None:
    """The one spelling of a host name; None if it can be none."""
    plain = unicodedata.normalize("NFKC", unquote(host).translate(_IGNORED).translate(_STOPS)).lower()
    labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode("ascii") for x in unicodedata.normalize("NFC", plain).split(".")]
    if _FORBIDDEN.search("".join(labels)) or not any(labels):
        return None
    ends = labels[:-1] if len(labels) > 1 and not labels[-1] else labels
    return dotted(ends) if _NUMBER.fullmatch(ends[-1]) else ".".join(labels)


def _spell(url: str) -> str | None:
    m = _AUTHORITY.match(url)
    host = ascii_host(m[2]) if m else None
    return None if host is None else m[1] + host + m[3]


@F.pandas_udf(T.StringType())
def _with_ascii_host(urls: pd.Series) -> pd.Series:
    known = {u: _spell(u) for u in urls.dropna().unique()}
    return pd.Series([known.get(u) for u in urls], dtype=object)


def with_ascii_host(url: Column) -> Column:
    """The address with its host in ASCII form; null if the host can be none.  Only addresses that need it go through Arrow, the others send a null."""
    needed = url.rlike(_CONVERTED)
    return F.when(needed, _with_ascii_host(F.when(needed, url))).otherwise(url)
