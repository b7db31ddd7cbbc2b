"""Operators for preparing training corpora. Nothing outside this folder imports it.

`QUERIES` and `SQL` gather the registered queries of all modules.
"""

from importlib import import_module

MODULES = ("mixing", "quality", "simhash", "lines", "packing", "substrings", "suffixes", "fingerprints", "licenses", "warc")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def sql() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"{__name__}.{m}").SQL.items()}
