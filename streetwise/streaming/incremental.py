"""Matching of a stream of inputs, batch by batch, with the cache as its memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import release
from ..sources.store import AddressStore


def match_stream(inputs: DataFrame, store: AddressStore, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """``inputs`` is a stream of input_id, input_raw. Each micro-batch is matched and
    handed to ``sink`` with its number. A batch that is run again after a failure may find
    its good matches in the cache, where the first run has put them, and then gives one row
    for each of these: a sink that replaces what it has of a batch number holds one run's
    results as a whole, but which run's is not certain."""

    def one(batch: DataFrame, number: int) -> None:
        out = store.match(batch, **options)
        sink(out, number)
        release(out)

    return inputs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).start()
