"""Streaming forms: narrow operators run on a stream as they are; cookies keep session state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagegrain.operators.markup import derive
from pagegrain.operators.navigation import parse_cookie
from pagegrain.operators.views import impressions


def read_page_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 64) -> DataFrame:
    """A stream of Parquet page files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_impressions(pages: DataFrame, view: str, key: str = "page_id") -> DataFrame:
    """Envelopes of a stream of responses: narrow, stateless, append mode."""
    return impressions(pages, view, key)


def stream_text(pages: DataFrame) -> DataFrame:
    return derive(pages, ["text"])


_OUT = "session long, name string, domain string, path string, value string, seq long, deleted boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = 1 << 62


class _Jar(StatefulProcessor):
    """The cookies of one session: a map entry each, with the second from which it need not be kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jar = handle.getMapState("jar", "name string, domain string, path string", "value string, seq long, until long, gone boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed: dict[tuple, list] = {}
        for part in rows:
            for r in part.itertuples():
                now = r.ts.timestamp()
                c = parse_cookie(r.line, r.url, now, bool(r.from_script))
                if c is None:
                    continue
                identity = (c[0], c[2], c[4])
                held = self.jar.getValue(identity) if self.jar.containsKey(identity) else None
                if held is not None and held[1] >= r.seq:
                    continue
                gone = c[8] is not None and c[8] <= int(now)
                # A deletion is kept until no earlier write can come any more; then it says nothing that absence does not.
                until = int(now) if gone else _NEVER if c[8] is None else int(c[8])
                self.jar.updateValue(identity, (c[1], int(r.seq), until, gone))
                if until < _NEVER:
                    self.handle.registerTimer(until * 1000)
                changed[identity] = [key[0], *identity, c[1], int(r.seq), gone]
        yield self._told(changed.values())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, over = expiredTimerInfo.getExpiryTimeInMs(), []
        for identity, (value, seq, until, gone) in list(self.jar.iterator()):
            if until * 1000 <= at:
                self.jar.removeKey(identity)
                if not gone:
                    over.append([key[0], *identity, value, int(seq), True])
        yield self._told(over)

    @staticmethod
    def _told(rows) -> pd.DataFrame:
        out = pd.DataFrame(list(rows), columns=["session", "name", "domain", "path", "value", "seq", "deleted"])
        return out.astype({"session": "int64", "seq": "int64", "deleted": bool})

    def close(self) -> None:
        pass


def stream_cookie_jar(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Changes to each session's cookies as set-cookie events arrive (update mode): the last write of each identity in a batch, and
    the deletion of what expires.

    A cookie is one entry of a map state, so an event touches one entry and not the session's jar, and goes by a timer when the watermark
    (``ts`` less ``delay``) passes its expiry; a deletion goes once no earlier write can come. Cookies without an expiry stay with their session.
    Events of a session may come in any order within the delay: an older write never takes a younger one's place. Needs the RocksDB state store,
    which is chosen here unless the session names one.
    """
    spark = events.sparkSession
    if spark.conf.get(_PROVIDER, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKSDB)
    keyed = events.select("session", "seq", "ts", "url", "line", "from_script").withWatermark("ts", delay).groupBy("session")
    return keyed.transformWithStateInPandas(_Jar(), _OUT, "Update", "EventTime")
