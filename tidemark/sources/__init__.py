"""Where records come from: collections, files of lines, partitioned logs, bounded queues, HTTP."""

from .base import FileSource, Source, from_source
from .files import read_lines
from .log import LogConsumer, PartitionedLog
from .queues import FullQueue, QueueSource
from .tail import TailDataSource, tail
from .webhook import WebhookSource

__all__ = ["FileSource", "FullQueue", "LogConsumer", "PartitionedLog", "QueueSource", "Source", "TailDataSource", "WebhookSource", "from_source", "read_lines", "tail"]
