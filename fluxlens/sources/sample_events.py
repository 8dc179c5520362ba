"""Fixed 20-byte sample records written by a packet sampler on little-endian machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.functions.binary import u8, u16_little, u32
from fluxlens.functions.ip import ipv4_text

EVENT_BYTES = 20
EGRESS = 1


def decode_sample_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Append the observation columns and ``egress``; records shorter than 20 bytes are left out.

    Addresses are in network order, ports and counts little-endian. A record of zero segments stands for one packet.
    """
    raw = F.col(payload)
    kept = [c for c in df.columns if c != payload]
    return df.where(F.octet_length(raw) >= EVENT_BYTES).select(
        *kept,
        ipv4_text(u32(raw, 0)).alias("src_ip"),
        ipv4_text(u32(raw, 4)).alias("dst_ip"),
        u16_little(raw, 8).cast("int").alias("src_port"),
        u16_little(raw, 10).cast("int").alias("dst_port"),
        u16_little(raw, 12).alias("length"),
        u8(raw, 14).cast("int").alias("protocol"),
        (u8(raw, 15) == EGRESS).alias("egress"),
        F.greatest(u16_little(raw, 16), F.lit(1)).alias("packets"),
        F.lit(0).alias("tcp_flags"),
        F.lit(0).alias("vlan"),
    )
