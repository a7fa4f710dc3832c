"""Small helpers shared by the operators of this folder."""

import math
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_remembered: dict[Hashable, object] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What tasks leave in their worker process for the next task; asking for something else drops it.

    Workers outlive a stage, so what the operators of a pipeline remember would add up in their memory.
    """
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; an id that is null counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor, F.lit(0))


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def pieces_for(amount: float, per_piece: float) -> int:
    """How many pieces of at most ``per_piece`` hold ``amount``; at least one."""
    return max(1, math.ceil(amount / per_piece))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def dealt_evenly(docs: DataFrame, per_task_bytes: int) -> DataFrame:
    """Rows dealt to tasks by a hash of their content, as many as the bytes of text ask for."""
    return docs.repartition(pieces_for(text_bytes(docs), per_task_bytes), F.xxhash64(*docs.columns))
