"""The one exception of the library."""

from __future__ import annotations


class SearchError(ValueError):
    """op: add, parse or regexp; msg: what went wrong."""

    def __init__(self, op: str, msg: str):
        super().__init__(f"sparrowtext: {op}: {msg}")
        self.op, self.msg = op, msg
