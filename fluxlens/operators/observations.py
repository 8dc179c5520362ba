"""From single (sampled) packets to flows.

Observations follow ``OBSERVATION_SCHEMA``. Everything here is a hash aggregation with map-side partial results, so a
busy pair of hosts costs its task one row per upstream partition, not one per packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlens.functions.time import duration_ms
from fluxlens.model import DEFAULT_MAX_FLOWS, DEFAULT_WINDOW, FLOW_SCHEMA, conform

FIVE_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
LOCAL_SOURCE = "LOCAL_XDP"
CAP_SALTS = 64


def sample_one_in_n(obs: DataFrame, n: int) -> DataFrame:
    """Keep about one observation in ``n`` (all when ``n`` <= 1), chosen by packet content and time.

    Unlike ``DataFrame.sample`` the choice survives a re-run or a lost executor, and needs no coordination. It is made
    by the first 32 bits of an MD5 sum, which other systems compute alike.
    """
    if n <= 1:
        return obs
    content = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIVE_TUPLE), F.unix_micros("ts").cast("string"))
    return obs.where(F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("long") % n == 0)


def packets_represented(packets: Column) -> Column:
    """Packets on the wire that one observation stands for; unset or below one counts as one."""
    return F.greatest(F.coalesce(packets.cast("long"), F.lit(1)), F.lit(1))


def apply_sampling(flows: DataFrame) -> DataFrame:
    """Keep the measured counters as ``observed_*`` and scale ``packets`` and ``bytes`` by the sampling rate."""
    rate = F.greatest(F.coalesce(F.col("sampling_rate").cast("long"), F.lit(1)), F.lit(1))
    return flows.withColumns(
        {
            "observed_packets": F.col("packets").cast("long"),
            "observed_bytes": F.col("bytes").cast("long"),
            "packets": F.col("packets").cast("long") * rate,
            "bytes": F.col("bytes").cast("long") * rate,
        }
    )


def with_duration(flows: DataFrame) -> DataFrame:
    return flows.withColumn("duration_ms", duration_ms(F.col("timestamp"), F.col("timestamp_end")))


def aggregate_windows(obs: DataFrame, window: str = DEFAULT_WINDOW) -> DataFrame:
    """One row per tumbling window and 5-tuple, batch or streaming.

    Flags are OR-ed, because SYN and FIN sit on different packets. The VLAN is that of the earliest packet: time and
    tag are packed into one long, so the minimum stays a plain numeric aggregate (and is the same on every run).
    """
    slot = F.window("ts", window)
    with_slot = obs.withColumn("slot", slot)
    since_start = F.unix_micros("ts") - F.unix_micros(F.col("slot.start"))
    vlan = F.coalesce(F.col("vlan").cast("long"), F.lit(0))
    return (
        with_slot.withColumn("vlan_at", since_start * 65536 + vlan)
        .groupBy("slot", *FIVE_TUPLE)
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.sum(packets_represented(F.col("packets"))).alias("packets"),
            F.sum(F.col("length").cast("long")).alias("bytes"),
            F.bit_or(F.coalesce(F.col("tcp_flags").cast("int"), F.lit(0))).alias("tcp_flags"),
            F.min("vlan_at").alias("vlan_at"),
            F.count(F.lit(1)).alias("observations"),
        )
        .select(
            F.col("slot.start").alias("window_start"),
            *FIVE_TUPLE,
            "first_seen",
            "last_seen",
            "packets",
            "bytes",
            "tcp_flags",
            F.pmod(F.col("vlan_at"), F.lit(65536)).cast("int").alias("vlan"),
            "observations",
        )
    )


def admit_first_flows(windows: DataFrame, max_flows: int = DEFAULT_MAX_FLOWS) -> DataFrame:
    """The ``max_flows`` earliest flows of each window, complete with all their packets.

    A window is ranked in two steps: within salted shares, then among the survivors. The first ``max_flows`` of the
    window are among the first ``max_flows`` of their share, so the result is exact while no task ever ranks more than
    ``CAP_SALTS * max_flows`` rows of a window, however many flows a scan or flood put into it.
    """
    order = ["first_seen", *FIVE_TUPLE]
    share = W.partitionBy("window_start", "salt").orderBy(*order)
    whole = W.partitionBy("window_start").orderBy(*order)
    return (
        windows.withColumn("salt", F.pmod(F.xxhash64(*FIVE_TUPLE), F.lit(CAP_SALTS)))
        .withColumn("position", F.row_number().over(share))
        .where(F.col("position") <= max_flows)
        .withColumn("position", F.row_number().over(whole))
        .where(F.col("position") <= max_flows)
        .drop("salt", "position")
    )


def dropped_observations(windows: DataFrame, max_flows: int = DEFAULT_MAX_FLOWS) -> DataFrame:
    """Per window: flows admitted, and observations refused because the window was full.

    Refused = all minus admitted, so rows beyond the cap are never ranked.
    """
    seen = windows.select("window_start", "observations", F.lit(0).alias("admitted"), F.lit(0).alias("admitted_flows"))
    kept = admit_first_flows(windows, max_flows).select(
        "window_start",
        F.lit(0).cast("long").alias("observations"),
        F.col("observations").alias("admitted"),
        F.lit(1).alias("admitted_flows"),
    )
    return (
        seen.unionByName(kept)
        .groupBy("window_start")
        .agg(
            F.sum("admitted_flows").alias("flows"),
            (F.sum("observations") - F.sum("admitted")).alias("dropped"),
        )
    )


def windows_to_flows(windows: DataFrame, sampling_rate: int = 1, source_type: str = LOCAL_SOURCE) -> DataFrame:
    """Window rows as canonical flows with scaled counters."""
    flows = windows.select(
        F.col("first_seen").alias("timestamp"),
        F.col("last_seen").alias("timestamp_end"),
        *FIVE_TUPLE,
        "packets",
        "bytes",
        F.lit(max(int(sampling_rate), 0)).cast("long").alias("sampling_rate"),
        "tcp_flags",
        "vlan",
        F.lit(source_type).alias("source_type"),
    )
    return conform(with_duration(apply_sampling(flows)), FLOW_SCHEMA)


def aggregate_flows(
    obs: DataFrame,
    window: str = DEFAULT_WINDOW,
    sampling_rate: int = 1,
    max_flows: int | None = None,
) -> DataFrame:
    """Observations to flows; ``max_flows`` (batch only) keeps the earliest flows of each window."""
    windows = aggregate_windows(obs, window)
    if max_flows is not None:
        windows = admit_first_flows(windows, max_flows)
    return windows_to_flows(windows, sampling_rate)
