"""Options of Spark's JDBC source from the address of a database."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

DRIVERS = {"postgres": "postgresql", "postgresql": "postgresql"}


def jdbc_options(address: str, connections: int = 20) -> dict[str, str]:
    """``spark.read.format("jdbc").options(...)`` for ``scheme://user:password@host:port/database?options``.

    The old scheme name, a driver after a plus sign and missing ports are accepted. ``connections`` is the most that Spark
    opens at once, its ``numPartitions``; Spark closes them itself, so there is no pool to look after.
    """
    parts = urlsplit(address)
    scheme = DRIVERS.get(parts.scheme.split("+", 1)[0])
    if scheme is None or not parts.hostname or not parts.path.strip("/"):
        raise ValueError("not the address of a database")
    place = f"{parts.hostname}:{parts.port or 5432}{parts.path}" + (f"?{parts.query}" if parts.query else "")
    out = {"url": f"jdbc:{scheme}://{place}", "numPartitions": str(max(1, connections))}
    if parts.username is not None:
        out["user"] = unquote(parts.username)
    if parts.password is not None:
        out["password"] = unquote(parts.password)
    return out
