"""Row filters by namespace and by an entity's access list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_namespaces(namespace: Column, allowed: list[str]) -> Column:
    """Whether a caller with these namespaces may see a row: ``*``, the namespace or a prefix of it.

    Literal prefixes reach the scan.  Without namespaces nothing is seen; a null namespace only by ``*``.
    """
    if "*" in allowed:
        return F.lit(True)
    seen = F.lit(False)
    for prefix in dict.fromkeys(allowed):
        seen = seen | namespace.startswith(prefix)
    return F.coalesce(seen, F.lit(False))


def may(caller: str, permission: str, owner: str = "owner", writers: str = "writers", readers: str = "readers", public: str = "public") -> Column:
    """Whether ``caller`` may read or write, by the columns of an access list; null lists are empty."""
    has = lambda c: F.coalesce(F.array_contains(c, caller), F.lit(False))
    writes = F.coalesce(F.col(owner) == caller, F.lit(False)) | has(writers)
    if permission == "write":
        return writes
    if permission != "read":
        raise ValueError(f"unknown permission {permission!r}")
    return writes | has(readers) | F.coalesce(F.col(public), F.lit(False))


def visible(df: DataFrame, acl: DataFrame, key: str, caller: str, permission: str = "read") -> DataFrame:
    """Rows of ``df`` whose entity's list lets ``caller``; an entity without a list is not restricted."""
    denied = acl.filter(~may(caller, permission)).select(key)
    return df.join(denied, key, "left_anti")
