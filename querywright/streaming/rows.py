"""Rows one at a time: a lazy cursor over a batch query.  Partitions are computed as they are reached."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row

#: What makes the order of rows within a partition differ from one run to the next.
_MOVES = re.compile(r"Exchange|Python|Arrow|Pandas|rand\(|randn\(|uuid\(|shuffle\(", re.IGNORECASE)


def repeatable(df: DataFrame) -> bool:
    """Whether each run gives the rows in the same order: nothing is shuffled, drawn or left to Python."""
    return not _MOVES.search(df._jdf.queryExecution().executedPlan().toString())


def lazy_rows(df: DataFrame, prefetch: bool = False, head: int = 1000) -> Iterator[Row]:
    """At most one partition (two with ``prefetch``) is held; stopping early leaves the rest unread.

    Where the order of rows is the same in each run, the first ``head`` rows come by a limit, which stops reading
    within the first partition; a consumer that goes on gets the rest, in the same order, from whole partitions."""
    done = 0
    if head and repeatable(df):
        first = df.limit(head).collect()
        yield from first
        done = len(first)
        if done < head:
            return
    yield from islice(df.toLocalIterator(prefetchPartitions=prefetch), done, None)
