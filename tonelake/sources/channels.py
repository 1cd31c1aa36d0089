"""Messages of channels as a stream whose offset is the mark of each channel: the last message id that has been read.

What reaches the network is a client of the caller's: a function without arguments gives an object with

- ``newest(chat_id)``: the id of the channel's last message, 0 where there is none;
- ``before(chat_id, day)``: the id of the last message before a day (``yyyy-MM-dd``), 0 where there is none;
- ``messages(chat_id, after, upto)``: rows of ``MESSAGES`` with ids above ``after`` and up to ``upto``.

    spark.dataSource.register(channel_messages(connect))
    spark.readStream.format("channel_messages").options(channels="1,2,3").load()

The stream's checkpoint keeps the marks, so a run after a failure reads each message once. Options: ``marks``, a JSON object of ids to begin behind, by channel, for a stream without a checkpoint; channels
that it lacks go back ``backfill_days`` (30) from ``today``. A channel that is named only in a later run begins in the same way.
"""

from __future__ import annotations

import datetime
import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tonelake.streaming.incremental import MESSAGES

BACKFILL_DAYS = 30


@dataclass
class Span(InputPartition):
    """Messages of one channel: a task."""

    chat_id: int
    after: int
    upto: int


class ChannelReader(DataSourceStreamReader):
    def __init__(self, connect: Callable, options: dict[str, str]):
        self.client = connect
        self.channels = [int(c) for c in options["channels"].split(",") if c.strip()]
        self.marks = {str(k): int(v) for k, v in json.loads(options.get("marks", "{}")).items()}
        self.days = int(options.get("backfill_days", BACKFILL_DAYS))
        self.today = options.get("today")

    def start_of(self, chat_id: int) -> int:
        """Where a channel without a mark begins."""
        if str(chat_id) in self.marks:
            return self.marks[str(chat_id)]
        today = datetime.date.fromisoformat(self.today) if self.today else datetime.datetime.now(datetime.UTC).date()
        return int(self.client().before(chat_id, str(today - datetime.timedelta(self.days))))

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {str(c): self.start_of(c) for c in self.channels}

    def latestOffset(self) -> dict:  # noqa: N802
        client = self.client()
        return {str(c): int(client.newest(c)) for c in self.channels}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = [Span(int(c), int(start[c]) if c in start else self.start_of(int(c)), int(upto)) for c, upto in sorted(end.items())]
        return [s for s in spans if s.upto > s.after]

    def read(self, partition: Span) -> Iterator[tuple]:
        for row in self.client().messages(partition.chat_id, partition.after, partition.upto):
            yield tuple(row)


def channel_messages(connect: Callable) -> type[DataSource]:
    """The source with a client; the client's function goes to the workers with it."""
    module = inspect.getmodule(connect)
    if module is not None and module.__name__ != "__main__":
        cloudpickle.register_pickle_by_value(module)

    class ChannelMessages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "channel_messages"

        def schema(self) -> str:
            return MESSAGES

        def streamReader(self, schema) -> ChannelReader:  # noqa: N802
            return ChannelReader(connect, dict(self.options))

    return ChannelMessages
