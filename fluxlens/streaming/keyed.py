"""Windows in keyed state: the flow cap on a live stream, and windows that close when their input falls silent.

Spark's own window aggregation keeps every flow of an open window, and it cannot rank them. Here a window is dealt over
shares of its 5-tuples, and each share is one keyed state, so a scan or flood fills at most shares * (cap + flows younger
than the watermark) entries. Rows are summed up by 5-tuple in every Arrow batch before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxlens.model import DEFAULT_MAX_FLOWS, DEFAULT_WINDOW
from fluxlens.operators.observations import CAP_SALTS, FIVE_TUPLE, admit_first_flows, packets_represented, windows_to_flows
from fluxlens.sources.tables import append_stored, stored_form, write_batch
from fluxlens.streaming.ingest import check_identity, start
from fluxlens.streaming.windows import DEFAULT_LATENESS

#: Times count as late by the start of their tenth of a second, which lets rows of that time be summed up first.
INSTANT_US = 100_000
#: Keyed states over which open windows are dealt where no cap is kept, however many windows are open.
SILENT_SHARES = 256
_TUPLE = list(FIVE_TUPLE)
_WINDOW = ["start_us", "end_us"]
_LEAST, _MOST, _SUM = ["first_us", "vlan_at"], ["last_us"], ["packets", "bytes", "observations"]
_MEASURES = [*_LEAST, *_MOST, *_SUM, "tcp_flags"]
_FLOW = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"
_SUMS = f"{_FLOW}, first_us long, vlan_at long, last_us long, packets long, bytes long, observations long, tcp_flags int"
_PARTIALS = f"instant timestamp, start_us long, end_us long, {_SUMS}"
_SURVIVORS = f"start_us long, {_SUMS}, refused long"


def summed(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """One row for each key, measures combined; partial results combine to the same as single rows."""
    if len(rows) < 2:
        return rows[[*keys, *_MEASURES]]
    numbers = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(numbers, kind="stable")
    begins = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    ordered = rows.iloc[order]
    out = ordered.iloc[begins][keys].reset_index(drop=True)
    for names, how in ((_LEAST, np.minimum), (_MOST, np.maximum), (_SUM, np.add), (["tcp_flags"], np.bitwise_or)):
        for name in names:
            out[name] = how.reduceat(ordered[name].to_numpy(), begins)
    return out


def _partials(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield summed(rows, ["instant", "start_us", "end_us", *_TUPLE])


def _shares(obs: DataFrame, window: str, lateness: str) -> DataFrame:
    """Partial sums of a stream of observations, with watermark, window bounds and share."""
    us, slot = F.unix_micros("ts"), F.window("ts", window)
    begin = F.unix_micros(slot.getField("start"))
    numbers = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in _TUPLE[2:]]
    rows = obs.select(
        F.timestamp_micros(us - F.pmod(us, F.lit(INSTANT_US))).alias("instant"),
        begin.alias("start_us"),
        F.unix_micros(slot.getField("end")).alias("end_us"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _TUPLE[:2]],
        *numbers,
        us.alias("first_us"),
        ((us - begin) * 65536 + F.coalesce(F.col("vlan").cast("long"), F.lit(0))).alias("vlan_at"),
        us.alias("last_us"),
        packets_represented(F.col("packets")).alias("packets"),
        F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("bytes"),
        F.lit(1).cast("long").alias("observations"),
        F.coalesce(F.col("tcp_flags").cast("int"), F.lit(0)).alias("tcp_flags"),
    ).where(F.col("instant").isNotNull())
    partial = rows.mapInPandas(_partials, _PARTIALS).withWatermark("instant", lateness)
    return partial.withColumn("share", F.pmod(F.xxhash64(*_TUPLE), F.lit(CAP_SALTS)))


def _packed(flows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(flows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _earliest(flows: pd.DataFrame, count: int) -> pd.DataFrame:
    return flows if len(flows) <= count else flows.sort_values(["first_us", *_TUPLE]).head(count)


def settled_flows(flows: pd.DataFrame, max_flows: int, watermark_us: int) -> pd.DataFrame:
    """The flows that may still be among the first `max_flows` of their share.

    Rows to come are younger than the watermark. Once `max_flows` flows began before it, their order is final and no
    other flow can come before them.
    """
    final = flows[flows["first_us"] <= watermark_us]
    return flows if len(final) < max_flows else _earliest(final, max_flows)


def _merged(held: pd.DataFrame | None, batches: Iterable[pd.DataFrame], keys: list[str]) -> pd.DataFrame:
    """Flows with new rows. Chunks wait until they are as many rows as the flows, so each row is summed a few times only."""
    waiting, size = [], 0
    for rows in batches:
        waiting.append(rows[[*keys, *_MEASURES]])
        size += len(rows)
        if held is None or size >= len(held):
            held, waiting, size = summed(pd.concat([held, *waiting] if held is not None else waiting), keys), [], 0
    return summed(pd.concat([held, *waiting]), keys) if waiting else held


def _take(state: GroupState, batches: Iterable[pd.DataFrame]) -> tuple[pd.DataFrame, int]:
    """The share's flows with the new rows, chunk by chunk, and its refused observations."""
    held, refused = (_unpacked(state.get[0]), state.get[1]) if state.exists else (None, 0)
    return _merged(held, batches, _TUPLE), refused


def _survivors(start_us: int, flows: pd.DataFrame, refused: int) -> pd.DataFrame:
    out = flows.reset_index(drop=True)
    out.insert(0, "start_us", start_us)
    out["refused"] = 0
    out.loc[0, "refused"] = refused
    return out


def _capped(max_flows: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start_us, end_us, _ = (int(k) for k in key)
        watermark_ms = state.getCurrentWatermarkMs()
        flows, refused = _take(state, () if state.hasTimedOut else batches)
        closing = state.hasTimedOut or end_us < watermark_ms * 1000
        kept = _earliest(flows, max_flows) if closing else settled_flows(flows, max_flows, watermark_ms * 1000)
        refused += int(flows["observations"].sum() - kept["observations"].sum())
        if closing:
            state.remove()
            yield _survivors(start_us, kept, refused)
        else:
            state.update((_packed(kept), refused))
            state.setTimeoutTimestamp(end_us // 1000)

    return update


def stream_capped_shares(
    obs: DataFrame, window: str = DEFAULT_WINDOW, lateness: str = DEFAULT_LATENESS, max_flows: int = DEFAULT_MAX_FLOWS
) -> DataFrame:
    """Of each share of a window its first ``max_flows`` flows, emitted when the watermark has passed the window.

    All shares of a window leave in one micro-batch, because the watermark is the same for all. ``refused`` (on one row
    of a share) counts observations of flows that were let go. An observation whose tenth of a second began before the
    watermark is late and dropped by Spark; NULL addresses and numbers count as empty and 0.
    """
    grouped = _shares(obs, window, lateness).groupBy("start_us", "end_us", "share")
    return grouped.applyInPandasWithState(_capped(max_flows), _SURVIVORS, "flows binary, refused long", "append", GroupStateTimeout.EventTimeTimeout)


def _windows(rows: DataFrame) -> DataFrame:
    """Rows in the shape of ``aggregate_windows``."""
    return rows.select(
        F.timestamp_micros("start_us").alias("window_start"),
        *FIVE_TUPLE,
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        "packets",
        "bytes",
        "tcp_flags",
        F.pmod(F.col("vlan_at"), F.lit(65536)).cast("int").alias("vlan"),
        "observations",
    )


def merge_shares(shares: DataFrame, max_flows: int = DEFAULT_MAX_FLOWS) -> tuple[DataFrame, DataFrame]:
    """The admitted flows of closed windows, and for each window how many flows it has and how many observations it refused."""
    admitted = admit_first_flows(_windows(shares), max_flows)
    seen = shares.select(
        F.timestamp_micros("start_us").alias("window_start"),
        F.lit(0).alias("flows"),
        (F.col("observations") + F.col("refused")).alias("dropped"),
    )
    kept = admitted.select("window_start", F.lit(1).alias("flows"), (-F.col("observations")).alias("dropped"))
    report = seen.unionByName(kept).groupBy("window_start").agg(F.sum("flows").alias("flows"), F.sum("dropped").alias("dropped"))
    return admitted, report


def start_capped_ingest(
    obs: DataFrame,
    path: str,
    report_path: str,
    checkpoint: str,
    *,
    stream: str,
    window: str = DEFAULT_WINDOW,
    lateness: str = DEFAULT_LATENESS,
    max_flows: int = DEFAULT_MAX_FLOWS,
    sampling_rate: int = 1,
    available_now: bool = False,
) -> StreamingQuery:
    """Observations to capped flows in the detail table, and a report of each closed window next to it.

    Both writes belong to the micro-batch and overwrite themselves when it is repeated.
    """
    check_identity(obs.sparkSession, path, checkpoint, stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        shares = batch.persist()
        try:
            admitted, report = merge_shares(shares, max_flows)
            append_stored(stored_form(windows_to_flows(admitted, sampling_rate)), path, stream, batch_id)
            write_batch(report, report_path, stream, batch_id)
        finally:
            shares.unpersist()

    return start(stream_capped_shares(obs, window, lateness, max_flows), write, checkpoint, stream, available_now)


def _until_silent(idle_ms: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held, heard = None, {}
        if state.exists:
            held = _unpacked(state.get[0])
            heard = dict(zip(held["start_us"], held.pop("heard_ms"), strict=True))

        def arriving() -> Iterator[pd.DataFrame]:
            for rows in batches:
                heard.update(dict.fromkeys(rows["start_us"], now))
                yield rows

        flows = _merged(held, () if state.hasTimedOut else arriving(), [*_WINDOW, *_TUPLE])
        flows["heard_ms"] = flows["start_us"].map(heard)
        closing = (flows["end_us"] < state.getCurrentWatermarkMs() * 1000) | (flows["heard_ms"] + idle_ms <= now)
        kept = flows[~closing]
        if len(kept):
            state.update((_packed(kept),))
            state.setTimeoutDuration(max(1, int(kept["heard_ms"].min()) + idle_ms - now))
        elif state.exists:
            state.remove()
        if closing.any():
            yield flows[closing].drop(columns=["end_us", "heard_ms"]).assign(refused=0)

    return update


def stream_windows_until_silent(
    obs: DataFrame, window: str = DEFAULT_WINDOW, lateness: str = DEFAULT_LATENESS, idle_seconds: float = 30.0
) -> DataFrame:
    """Window rows of a stream, as ``stream_windows``, that need no later data to be emitted.

    A share of a window leaves ``idle_seconds`` of processing time after its last rows have arrived, or when its keyed
    state is called after the watermark has passed it. Observations after that, if not late, make a further row of their
    flow, so sums stay right; choose ``idle_seconds`` longer than inputs pause within a window. A keyed state holds its
    share of all open windows: in a sparse stream nearly every row has a window of its own, and a state (and a call) for
    each of them costs far more than the rows.
    """
    share = F.pmod(F.xxhash64("start_us", *_TUPLE), F.lit(SILENT_SHARES))
    grouped = _shares(obs, window, lateness).withColumn("share", share).groupBy("share")
    timed = grouped.applyInPandasWithState(
        _until_silent(int(idle_seconds * 1000)), _SURVIVORS, "flows binary", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return _windows(timed)
