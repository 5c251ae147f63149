"""Stable keys and fingerprints."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\u001f"


def tie_key(name: Column, address: Column, country: Column) -> Column:
    """Hex digest of the raw content; ties are resolved by it, never by ids."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws(SEPARATOR, blank(name), blank(address), blank(country)), 256)


@F.pandas_udf(T.StringType())
def blake_tie_key(name: pd.Series, address: pd.Series, country: pd.Series) -> pd.Series:
    """The same content under a 96-bit BLAKE2b digest."""
    return pd.Series([hashlib.blake2b(SEPARATOR.join(x or "" for x in r).encode(), digest_size=12).hexdigest() for r in zip(name, address, country, strict=True)])


def bucket(hex_digest: Column, n: int) -> Column:
    """A digest's first 32 bits modulo n."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long") % n


def seeded(seed: int | str, *parts: Column) -> Column:
    """Order key of a seed and some parts, spelled as a JSON list."""
    inner = [F.lit(json.dumps(seed)), *[_inside(F.to_json(F.array(p))) for p in parts]]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *inner), F.lit("]")), 256)


def _inside(json_list: Column) -> Column:
    return F.regexp_replace(json_list, r"^\[|\]$", "")


def redacted(*parts: Column) -> Column:
    """Sixteen hex digits that stand for the parts."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 16)


def fingerprint(value) -> str:
    """Digest of a configuration in canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def file_digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()
