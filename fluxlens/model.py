"""The canonical flow record, the minute rollup and the closed field lists.

Every input is turned into ``FLOW_SCHEMA`` and every question is asked of it (or of the rollup derived from it).
No stored column is ever NULL: unknown is ``''`` or ``0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TS, _STR, _INT, _LONG = T.TimestampType(), T.StringType(), T.IntegerType(), T.LongType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FLOW_SCHEMA = _schema(
    ("timestamp", _TS),
    ("timestamp_end", _TS),
    ("src_ip", _STR),
    ("dst_ip", _STR),
    ("src_port", _INT),
    ("dst_port", _INT),
    ("protocol", _INT),
    ("packets", _LONG),
    ("bytes", _LONG),
    ("observed_packets", _LONG),
    ("observed_bytes", _LONG),
    ("sampling_rate", _LONG),
    ("tcp_flags", _INT),
    ("src_mac", _STR),
    ("dst_mac", _STR),
    ("input_interface", _LONG),
    ("output_interface", _LONG),
    ("vlan", _INT),
    ("inner_vlan", _INT),
    ("duration_ms", _LONG),
    ("source_type", _STR),
    ("sensor_id", _LONG),
    ("device_id", _LONG),
    ("site_id", _LONG),
    ("application", _STR),
    ("src_country", _STR),
    ("dst_country", _STR),
    ("src_region", _STR),
    ("dst_region", _STR),
    ("src_city", _STR),
    ("dst_city", _STR),
    ("src_asn", _LONG),
    ("dst_asn", _LONG),
    ("src_org", _STR),
    ("dst_org", _STR),
)

# What the detail table adds on disk: 16-byte address keys (range predicates that Parquet statistics can answer) and
# the partition column.
STORED_SCHEMA = T.StructType(
    FLOW_SCHEMA.fields
    + [
        T.StructField("src_ip_key", T.BinaryType(), True),
        T.StructField("dst_ip_key", T.BinaryType(), True),
        T.StructField("flow_date", T.DateType(), True),
    ]
)

ROLLUP_SCHEMA = _schema(
    ("ts_minute", _TS),
    ("src_ip", _STR),
    ("dst_ip", _STR),
    ("protocol", _INT),
    ("application", _STR),
    ("source_type", _STR),
    ("device_id", _LONG),
    ("input_interface", _LONG),
    ("src_country", _STR),
    ("dst_country", _STR),
    ("src_asn", _LONG),
    ("dst_asn", _LONG),
    ("bytes", _LONG),
    ("packets", _LONG),
    ("flows", _LONG),
)
ROLLUP_METRICS = ("bytes", "packets", "flows")
ROLLUP_KEYS = tuple(f.name for f in ROLLUP_SCHEMA if f.name not in ROLLUP_METRICS)
ROLLUP_DIMENSIONS = frozenset(ROLLUP_KEYS) - {"ts_minute"}

OBSERVATION_SCHEMA = _schema(
    ("ts", _TS),
    ("src_ip", _STR),
    ("dst_ip", _STR),
    ("src_port", _INT),
    ("dst_port", _INT),
    ("protocol", _INT),
    ("length", _LONG),
    ("packets", _LONG),
    ("tcp_flags", _INT),
    ("vlan", _INT),
)

# What may be filtered, by kind of value.
IP_FIELDS = ("src_ip", "dst_ip")
INT_FIELDS = (
    "src_port",
    "dst_port",
    "protocol",
    "bytes",
    "packets",
    "src_asn",
    "dst_asn",
    "device_id",
    "sensor_id",
    "site_id",
    "input_interface",
    "output_interface",
    "vlan",
    "tcp_flags",
)
STRING_FIELDS = (
    "src_country",
    "dst_country",
    "src_region",
    "dst_region",
    "src_city",
    "dst_city",
    "src_org",
    "dst_org",
    "application",
    "source_type",
)
CITY_FIELDS = ("src_region", "dst_region", "src_city", "dst_city")
FIELD_KINDS = (
    {name: "ip" for name in IP_FIELDS}
    | {name: "int" for name in INT_FIELDS}
    | {name: "string" for name in STRING_FIELDS}
)
# Amounts and flag words can be filtered but are no dimensions.
DIMENSIONS = tuple(name for name in FIELD_KINDS if name not in ("bytes", "packets", "tcp_flags"))

OPERATORS_BY_KIND = {
    "ip": ("eq", "ne", "in", "not_in", "cidr"),
    "int": ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in"),
    "string": ("eq", "ne", "in", "not_in", "like", "contains", "prefix"),
}

METRICS = (
    "bytes",
    "packets",
    "flows",
    "observed_bytes",
    "observed_packets",
    "uniq_src_ip",
    "uniq_dst_ip",
    "uniq_dst_port",
)
DEFAULT_METRICS = ("bytes", "packets", "flows")
INTERVAL_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}

DEFAULT_LIMIT = 100
MAX_LIMIT = 10_000
MAX_SPAN_DAYS = 366
MAX_IN_LIST = 1000
MAX_FILTER_DEPTH = 8
ROLLUP_SPAN_DAYS = 3
DEFAULT_WINDOW = "10 seconds"
DEFAULT_MAX_FLOWS = 20_000
DETAIL_RETENTION_DAYS = 90
ROLLUP_RETENTION_DAYS = 365


def available_fields(city_available: bool = True) -> dict:
    """Which fields, dimensions, metrics and intervals a question may use; city fields need a city table."""
    hidden = () if city_available else CITY_FIELDS
    return {
        "filterable": [
            {"name": name, "kind": kind, "operators": sorted(OPERATORS_BY_KIND[kind])}
            for name, kind in sorted(FIELD_KINDS.items())
            if name not in hidden
        ],
        "groupable": sorted(name for name in DIMENSIONS if name not in hidden),
        "metrics": sorted(METRICS),
        "intervals": list(INTERVAL_SECONDS),
    }


def unknown_value(kind: T.DataType) -> str:
    """SQL literal that stands for "unknown" in one column type."""
    if isinstance(kind, T.StringType):
        return "''"
    if isinstance(kind, T.BinaryType):
        return f"X'{'00' * 16}'"
    return f"cast(0 as {kind.simpleString()})"


def conform(df: DataFrame, schema: T.StructType = FLOW_SCHEMA) -> DataFrame:
    """Select exactly ``schema``: cast what is there, add what is missing, replace NULL by the unknown value.

    Timestamps are kept as they are: a flow without a time is an error to surface, not a row at the epoch.
    """
    present = set(df.columns)
    columns = []
    for field in schema:
        name, kind, unknown = field.name, field.dataType.simpleString(), unknown_value(field.dataType)
        if name not in present:
            columns.append(f"{unknown} as {name}")
        elif isinstance(field.dataType, T.TimestampType):
            columns.append(f"cast({name} as {kind}) as {name}")
        else:
            columns.append(f"coalesce(cast({name} as {kind}), {unknown}) as {name}")
    return df.selectExpr(*columns)
