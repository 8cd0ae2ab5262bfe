"""Small hand-made archives."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywire.functions.taxonomy import classify
from tallywire.schema import WIRE_EVENTS

WITH_POS = T.StructType([*WIRE_EVENTS.fields, T.StructField("pos", T.LongType())])


def hash32(seed):
    return bytes([seed]) * 32


def message(ts, peer, command, inbound, size=40, **more):
    addr = f"10.0.0.{peer % 251}:8333"
    return dict(
        ts_ms=ts, arm="ebpf.message", peer_id=peer, addr=addr, conn_type="inbound",
        command=command, inbound=inbound, size=size, **more,
    )


def naming(ts, peer, command, inbound, size, seeds):
    """A message with a body that names something."""
    if command in ("inv", "getdata", "notfound"):
        body = {"items": [{"type": "wtx", "hash": hash32(s)} for s in seeds]}
    elif command == "tx":
        body = {"txid": hash32(seeds[0]), "wtxid": hash32(seeds[0] ^ 0x80)}
    else:
        body = {"nonce": seeds[0].to_bytes(8, "little")}
    return message(ts, peer, command, inbound, size, **body)


def inv(ts, peer, seeds, inbound=True):
    items = [{"type": "wtx", "hash": hash32(s)} for s in seeds]
    return message(ts, peer, "inv", inbound, 37 * len(seeds), items=items)


def tx(ts, peer, seed, size, wtxid=None):
    return message(
        ts, peer, "tx", True, size, txid=hash32(seed),
        wtxid=hash32(seed if wtxid is None else wtxid),
    )


def opened(ts, peer, sub="inbound"):
    return dict(
        ts_ms=ts, arm="ebpf.connection", sub=sub, peer_id=peer, addr=f"10.0.0.{peer % 251}:8333",
        conn_type="inbound", network=1, existing_connections=peer,
    )


def ended(ts, peer, conn_type, established_s, evicted=False):
    return dict(
        ts_ms=ts, arm="ebpf.connection", sub="inbound_evicted" if evicted else "closed",
        peer_id=peer, addr=f"10.0.0.{peer % 251}:8333", conn_type=conn_type, network=1,
        established_s=established_s,
    )


def misbehaving(ts, peer, text):
    return dict(ts_ms=ts, arm="ebpf.connection", sub="misbehaving", peer_id=peer, misbehaviour=text)


def version(ts, peer, agent, inbound=True):
    return message(ts, peer, "version", inbound, 102, user_agent=agent)


def poll(ts, infos):
    return dict(
        ts_ms=ts, arm="rpc", sub="peer_infos",
        peer_infos=[{"id": i, "subversion": s} for i, s in infos],
    )


def armless(ts):
    return dict(ts_ms=ts)


def archive(spark, rows, start=0):
    """Rows as classified events in the given order."""
    full = [
        tuple(dict(r, record_no=i, pos=i).get(f.name) for f in WITH_POS.fields)
        for i, r in enumerate(rows, start)
    ]
    return classify(spark.createDataFrame(full, WITH_POS))


def rows(df, *names, order=None):
    names = names or df.columns
    found = [tuple(r) for r in df.select(*[F.col(n) for n in names]).collect()]
    return found if order == "kept" else sorted(found, key=repr)


def one(df):
    found = df.collect()
    assert len(found) == 1, found
    return found[0]
