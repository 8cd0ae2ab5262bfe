"""Names for enums, and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Connection types, and network numbers from 0.
CONN_TYPES = ["inbound", "outbound-full-relay", "block-relay-only", "feeler", "unknown"]
NETWORKS = ["unroutable", "ipv4", "ipv6", "onion", "i2p", "cjdns", "internal"]


def conn_type_name(label: Column) -> Column:
    """A connection type label, with anything not known read as unknown; NULL stays NULL."""
    return F.when(label.isNull() | label.isin(*CONN_TYPES), label).otherwise("unknown")


def network_name(number: Column) -> Column:
    pairs = [F.lit(x) for pair in enumerate(NETWORKS) for x in pair]
    return F.when(number.isNotNull(), F.coalesce(F.create_map(*pairs)[number], F.lit("unknown")))


def share(part: Column, total: Column) -> Column:
    """Percent of a total; 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        part.cast("double") * F.lit(100.0) / total.cast("double")
    )


def ratio(part: Column, whole: Column) -> Column:
    """A quotient, NULL where it is not defined."""
    return F.when(whole > 0, F.try_divide(part.cast("double"), whole.cast("double")))
