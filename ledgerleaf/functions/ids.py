"""Deterministic identifiers, so that a second run finds the rows of the first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions.text import as_col


def company_id(name: Column | str) -> Column:
    """First 16 hexadecimal digits of the name's md5."""
    return F.substring(F.md5(as_col(name)), 1, 16)


def document_id(company: Column | str, relative_path: Column | str, version: Column | str) -> Column:
    """Id of one version of one file.

    ``version`` is a hash of the bytes, or size and modification time where reading
    all bytes for a manifest would be too dear.
    """
    return F.substring(F.sha2(F.concat_ws("|", as_col(company), as_col(relative_path), as_col(version)), 256), 1, 32)


def chunk_id(document: Column | str, index: Column | str) -> Column:
    return F.concat_ws("_", as_col(document), as_col(index).cast("string"))


def joined_id(*parts: Column | str) -> Column:
    return F.concat_ws("_", *[as_col(part).cast("string") for part in parts])
