"""The tables the library works on."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("hash", T.BinaryType())]
)
TRANSACTION = T.StructType(
    [
        T.StructField("txid", T.BinaryType()),
        T.StructField("wtxid", T.BinaryType()),
        T.StructField("raw", T.BinaryType()),
    ]
)
PEER_INFO = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("subversion", T.StringType())]
)

# One row per captured event, as decoded tables hold it.
WIRE_EVENTS = T.StructType(
    [
        T.StructField("record_no", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("arm", T.StringType()),
        T.StructField("sub", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("peer_id", T.LongType()),
        T.StructField("addr", T.StringType()),
        T.StructField("conn_type", T.StringType()),
        T.StructField("network", T.IntegerType()),
        T.StructField("command", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("items", T.ArrayType(ITEM)),
        T.StructField("txid", T.BinaryType()),
        T.StructField("wtxid", T.BinaryType()),
        T.StructField("block_hash", T.BinaryType()),
        T.StructField("nonce", T.BinaryType()),
        T.StructField("n_addresses", T.IntegerType()),
        T.StructField("n_headers", T.IntegerType()),
        T.StructField("n_short_ids", T.IntegerType()),
        T.StructField("n_txs", T.IntegerType()),
        T.StructField("n_indexes", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("established_s", T.LongType()),
        T.StructField("existing_connections", T.LongType()),
        T.StructField("misbehaviour", T.StringType()),
        T.StructField("peer_infos", T.ArrayType(PEER_INFO)),
        T.StructField("raw", T.BinaryType()),
        T.StructField("txs", T.ArrayType(TRANSACTION)),
        T.StructField("payload", T.BinaryType()),
        # Set in the header record of a file only.
        T.StructField("created_s", T.LongType()),
        T.StructField("low_data", T.BooleanType()),
    ]
)

# One row per archive file.
ARCHIVE_FILES = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("created_s", T.LongType()),
        T.StructField("low_data", T.BooleanType()),
        T.StructField("size_bytes", T.LongType()),
    ]
)

PREFIX_ASN = T.StructType(
    [T.StructField("prefix", T.StringType()), T.StructField("asn", T.LongType())]
)
AS_NAMES = T.StructType(
    [
        T.StructField("asn", T.LongType()),
        T.StructField("handle", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)
