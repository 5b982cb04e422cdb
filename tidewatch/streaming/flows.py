"""Flows from a packet stream, capture by capture.

``FlowStream`` logs each micro-batch of packets and runs the two stateful queries of
:mod:`tidewatch.streaming.state` over what is new: packets to pieces, pieces to flows.
Order, late packets, open flows, time-outs and repeated batches are Spark's: watermarks,
state stores, timers, and one checkpoint per query and capture.  Both sinks
are file sinks, whose logs make a repeated batch count once.

A flush writes two rows far in the future into the log: the first one's window closes by
the second, and carries the watermark on to the pieces, so all windows and flows come out.
The next batch begins a new capture with checkpoints of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import flows as fl
from tidewatch.operators import hot_flows as hf
from tidewatch.schemas import FLOWS
from tidewatch.session import delete_path, path_exists, prepare, staging_area
from tidewatch.sources.tables import AppendTable
from tidewatch.streaming import state as st

PROGRESS = T.StructType(
    [
        T.StructField("capture", T.LongType()),
        T.StructField("batch", T.LongType()),
        T.StructField("watermark", T.LongType()),  # of the packets, after this batch
        T.StructField("newest", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("late", T.LongType()),
        T.StructField("flows", T.LongType()),
        T.StructField("open_flows", T.LongType()),
        T.StructField("flushed", T.BooleanType()),
    ]
)
SPAN = "1 second"
ROWS_PER_TASK = 1_000_000  # of a file of the log
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_FIRST = -(2**62)
_ENDS = (7258118400000000, 7289654400000000)  # 2200-01-01 and 2201-01-01, in microseconds


class FlowStream:
    """Builds flows from micro-batches of packets under one folder.

    ``delay`` is the watermark: how much older than the newest packet one may be.  Packets
    come out window by window of ``span``, so a late one is dropped only if its window is
    closed.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        timeout: str = fl.TIMEOUT,
        delay: str = "2 seconds",
        idle: str = fl.IDLE,
        on_flows: Callable[[DataFrame, str], object] | None = None,
        rows_per_task: int = ROWS_PER_TASK,
        window: str | None = None,
        span: str = SPAN,
    ):
        self.spark, self.root = prepare(spark), root
        self.timeout, self.idle = fl.micros(timeout), fl.micros(idle)
        self.delay, self.span, self.on_flows, self.window = delay, span, on_flows, window
        self.rows_per_task = rows_per_task
        self.progress = AppendTable(spark, f"{root}/progress", PROGRESS)
        capture = [T.StructField("capture_time", T.TimestampType())] if window else []
        self._schema = T.StructType([*capture, *FLOWS.fields, T.StructField("step", T.StringType())])

    def start(self, packets: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a streaming DataFrame of packets; ``trigger`` as in ``writeStream.trigger``."""
        writer = packets.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def flows(self) -> DataFrame:
        """All flows that came out so far."""
        last = self._last()
        found = [self._stored(c) for c in range(last.capture + 1)] if last else []
        out = self.spark.createDataFrame([], self._schema).drop("step")
        for df in found:
            out = out if df is None else out.unionByName(df)
        return out

    def _last(self) -> T.Row | None:
        """The report of the newest step; tokens are in order, only names are listed."""
        done = self.progress.tokens()
        return self.progress.read(done[-1]).first() if done else None

    @property
    def open_flows(self) -> int:
        last = self._last()
        return last.open_flows if last else 0

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch."""
        last = self._last()
        if last and last.batch >= batch_id:
            return
        new = last is None or last.flushed
        capture = 0 if last is None else last.capture + last.flushed
        closed, newest = (_FIRST, _FIRST) if new else (last.watermark, last.newest)
        keyed = st.key_text(fl.keyed(batch, self.window)[0], "capture" if self.window else None)
        logged = self._log(keyed, capture, f"t{batch_id:012d}")
        end = F.unix_micros(F.window(F.timestamp_micros("t"), self.span)["end"])
        count, late, top = logged.agg(F.count(F.lit(1)), F.count_if(end <= closed), F.coalesce(F.max("t"), F.lit(_FIRST))).first()
        step = f"{capture:06d}-{batch_id:012d}"
        watermark, open_ = self._advance(capture, step, closed, 0 if new else last.open_flows)
        self._report(capture, step, batch_id, watermark, max(newest, top), count, late, open_)

    def flush(self) -> None:
        """End of capture: all waiting packets and open flows come out."""
        last = self._last()
        if last is None or last.flushed:
            return
        ends = [(st.END_OF_CAPTURE, t, 0, False, 0, 0, 0, False, False) for t in _ENDS]
        self._log(self.spark.createDataFrame(ends, st.KEYED).coalesce(1), last.capture, "x")
        step = f"{last.capture:06d}-{last.batch:012d}x"
        watermark, _ = self._advance(last.capture, step, last.watermark, last.open_flows, last.newest)
        self._report(last.capture, step, last.batch, watermark, last.newest, 0, 0, 0)
        delete_path(self.spark, self._folder(last.capture, ""))

    def _folder(self, capture: int, name: str) -> str:
        return f"{self.root}/captures/c{capture:06d}/{name}"

    def _log(self, rows: DataFrame, capture: int, name: str) -> DataFrame:
        """Write rows once; a repeated step finds them and reads what it read before."""
        path = self._folder(capture, f"log/{name}")
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            rows.write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_task).parquet(path)
        return self.spark.read.schema(st.KEYED).parquet(path)

    def _advance(self, capture: int, step: str, closed: int, open_before: int, newest: int | None = None) -> tuple[int, int]:
        """Run both queries over what is new: (watermark, flows still open).

        ``closed`` and ``open_before`` are the last step's; ``newest`` is the time of the
        capture's last packet, if it ends here.
        """
        spark, pieces = self.spark, self._folder(capture, "pieces")
        log = spark.readStream.schema(st.KEYED).option("recursiveFileLookup", True).parquet(self._folder(capture, "log"))
        cut = st.window_pieces(st.packet_windows(log, self.delay, self.span), self.timeout, self.idle)
        cuts = self._run(cut, pieces, self._folder(capture, "cuts"))
        ended = st.as_flows(st.flow_states(spark.readStream.schema(st.PIECES).parquet(pieces), self.timeout, self.idle))
        if not self.window:
            ended = ended.drop("capture")
        # A flow is open if it was not silent for a timeout when the capture, or its window, ended.
        end = fl.capture_end(
            F.lit(_ENDS[0] if newest is None else newest), self.timeout,
            fl.micros(self.window) if self.window else None,
        )
        flows = hf.merged_features(ended, end).withColumn("step", F.lit(step))
        folds = self._run(flows, f"{self.root}/flows/c{capture:06d}", self._folder(capture, "folds"))
        # A last batch without data follows each that moved the watermark: it reports the new one.
        marks = [p["eventTime"]["watermark"] for p in cuts.recentProgress if "watermark" in p["eventTime"]]
        mark = datetime.fromisoformat(marks[-1]) - _EPOCH if marks else None
        opened = sum(p["observedMetrics"][st.OPENED]["flows"] for p in folds.recentProgress if st.OPENED in p["observedMetrics"])
        return (mark // timedelta(microseconds=1) if mark else closed), open_before + opened

    def _run(self, df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
        writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def _stored(self, capture: int, step: str | None = None) -> DataFrame | None:
        """The flows of a capture, or of one step; the sink's own log tells which files count."""
        path = f"{self.root}/flows/c{capture:06d}"
        if not path_exists(self.spark, path):
            return None
        df = self.spark.read.schema(self._schema).parquet(path)
        return df.drop("step") if step is None else df.filter(F.col("step") == step).drop("step")

    def _report(self, capture: int, step: str, batch: int, watermark: int, newest: int, packets: int, late: int, open_: int) -> None:
        """Hand the step's flows on and close it."""
        flushed = step.endswith("x")
        found = self._stored(capture, step)
        count = found.count() if found is not None else 0
        if self.on_flows is not None and count:
            with staging_area(self.spark):
                self.on_flows(found, step)
        row = (capture, batch, watermark, newest, packets, late, count, open_, flushed)
        self.progress.append(self.spark.createDataFrame([row], PROGRESS).coalesce(1), token=step)
