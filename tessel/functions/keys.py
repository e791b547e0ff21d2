"""Keys, times and signatures."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(path: Column, chunk_type: Column, *names: Column, line: Column) -> Column:
    """The content address of a chunk: md5 of path, type, first non-empty name and line, joined by ``::``.

    A missing part is empty but keeps its separators, so ``concat_ws`` on nulls would not do.
    """
    blank = F.lit("")
    name = F.coalesce(*(F.nullif(n, blank) for n in names), blank)
    part = [F.coalesce(path, blank), F.coalesce(chunk_type, blank), name, F.coalesce(line.cast("string"), blank)]
    return F.md5(F.concat(part[0], F.lit("::"), part[1], F.lit("::"), part[2], F.lit("::"), part[3]))


def iso_utc(time: Column) -> Column:
    """A time as ISO 8601 with microseconds and ``Z``, in any session time zone."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def random_id() -> Column:
    """32 hexadecimal digits; not deterministic."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def sign(body: bytes, secret: str) -> str:
    """The HMAC-SHA256 signature header of a webhook body (driver side)."""
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
