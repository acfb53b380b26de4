"""Training-data operators. Nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` list what the entry module registers.
"""

from importlib import import_module

MODULES = ("topk", "warc", "tokencount", "licenses", "neardup", "chat", "bpe", "quality", "sitetree", "tiling",)


def _built():
    return [import_module(f"{__name__}.{m}") for m in MODULES]


def queries():
    return {m.NAME: m.query for m in _built()}


def oracle_sql():
    return {m.NAME: m.ORACLE for m in _built() if getattr(m, "ORACLE", None)}
