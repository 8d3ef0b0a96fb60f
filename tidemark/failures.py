"""A stage's failure: how a task says it, and how the driver reads it."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


class StreamProcessingError(Exception):
    """A stage failed; ``original`` is what it raised (or its type and text, where it was raised on an executor).  Never wrapped twice."""

    def __init__(self, stage: str, original: BaseException | str):
        super().__init__(f"{stage}: {original}")
        self.stage, self.original = stage, original


MARK = re.compile(r"tidemark stage \[(\w+)\] (.*?) \[end of error\]", re.DOTALL)


def marked(stage: str, error: Column) -> Column:
    """The message with which a task stops the job, so that :func:`told` finds stage and error again."""
    return F.concat(F.lit(f"tidemark stage [{stage}] "), error, F.lit(" [end of error]"))


def told(error: BaseException) -> BaseException:
    """The stage's error behind what Spark raised, or the error itself."""
    if isinstance(error, StreamProcessingError):
        return error
    found = MARK.search(str(error))
    return StreamProcessingError(found[1], found[2]) if found else error
