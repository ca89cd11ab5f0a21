"""The queries of this subpackage by name, and their SQL where SQL can state them."""

from __future__ import annotations

from . import chat_tree, fingerprint, licenses, line_quality, mixing, near_dedup, near_dedup_sql, pieces, private_data, sharding, warc

#: Modules with QUERIES (and maybe ORACLE_SQL). A package that one of them lacks shows when this module is imported.
MODULES = (chat_tree, licenses, line_quality, mixing, near_dedup, near_dedup_sql, sharding, fingerprint, pieces, private_data, warc)


def _merged(attribute: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(module, attribute, {})
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
