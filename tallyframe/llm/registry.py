"""Queries of the subpackage; `tallyframe.llm.queries` fills them in."""

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add
