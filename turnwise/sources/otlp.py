"""OTLP trace exports to span rows: JSON text, gzip or protobuf bytes in, one row per span out."""

from __future__ import annotations

import gzip
import io
import json
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 256 << 20

#: AnyValue: nested values are kept as JSON text; 64-bit numbers arrive as text
_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_EVENT = f"struct<name:string,timeUnixNano:string,attributes:{_ATTRS}>"
_SPAN = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{_ATTRS},status:struct<code:string>,events:array<{_EVENT}>>"
)
PAYLOAD = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>>"


def text_of(v: Column) -> Column:
    return F.coalesce(v.stringValue, v.boolValue.cast("string"), v.intValue, v.doubleValue.cast("string"), v.arrayValue, v.kvlistValue)


def attr_map(attrs: Column) -> Column:
    """name -> text of an attribute list; of equal names the last counts, empty values are null."""
    some = F.coalesce(attrs, F.from_json(F.lit("[]"), _ATTRS))
    last = F.filter(some, lambda x, i: ~F.exists(F.slice(some, i + 2, F.size(some)), lambda y: y.key == x.key))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x.key, text_of(x.value))))


def nanos(c: Column) -> Column:
    return c.try_cast("bigint")


def spans_of(payloads: DataFrame, column: str = "payload", *keep: str) -> DataFrame:
    """One row per span of each JSON payload, in source order (``ord``), with resource and span attributes and events.

    A payload that is no JSON object gives no rows.
    """
    found = payloads.select(*keep, F.from_json(column, PAYLOAD).alias("p"))
    r = found.select(*keep, F.posexplode("p.resourceSpans").alias("r_at", "r"))
    s = r.select(*keep, "r_at", F.col("r.resource.attributes").alias("resource"), F.posexplode("r.scopeSpans").alias("s_at", "s"))
    x = s.select(*keep, "r_at", "s_at", "resource", F.posexplode("s.spans").alias("at", "x"))
    events = F.transform(F.coalesce("x.events", F.array()), lambda e: F.struct(e["name"].alias("name"), nanos(e.timeUnixNano).alias("ns"), attr_map(e.attributes).alias("attrs")))
    return x.select(
        *keep,
        F.struct("r_at", "s_at", "at").alias("ord"),
        attr_map(F.col("resource")).alias("resource"),
        F.lower("x.traceId").alias("trace_id"),
        F.lower("x.spanId").alias("span_id"),
        F.lower(F.nullif("x.parentSpanId", F.lit(""))).alias("parent_span_id"),
        F.col("x.name").alias("name"),
        nanos(F.col("x.startTimeUnixNano")).alias("start_ns"),
        nanos(F.nullif("x.endTimeUnixNano", F.lit("0"))).alias("end_ns"),
        attr_map(F.col("x.attributes")).alias("attrs"),
        F.col("x.status.code").alias("status"),
        events.alias("events"),
    )


def fields(body: bytes):
    """(number, wire type, value) of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = body[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(body):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = body[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = body[at : at + n], at + n
        yield key >> 3, kind, value


def proto_value(body: bytes):
    for n, _, v in fields(body):
        if n == 1:
            return {"stringValue": v.decode("utf-8", "replace")}
        if n == 2:
            return {"boolValue": bool(v)}
        if n == 3:
            return {"intValue": str(v - (1 << 64) if v >> 63 else v)}
        if n == 4:
            return {"doubleValue": struct.unpack("<d", v)[0]}
        if n == 5:
            return {"arrayValue": {"values": [proto_value(x) for k, _, x in fields(v) if k == 1]}}
        if n == 6:
            return {"kvlistValue": {"values": [proto_pair(x) for k, _, x in fields(v) if k == 1]}}
    return {}


def proto_pair(body: bytes):
    got = {n: v for n, _, v in fields(body)}
    return {"key": got.get(1, b"").decode(), "value": proto_value(got.get(2, b""))}


def proto_span(body: bytes):
    out = {"attributes": [], "events": []}
    for n, _, v in fields(body):
        if n in (1, 2, 4):
            out[{1: "traceId", 2: "spanId", 4: "parentSpanId"}[n]] = v.hex()
        elif n == 5:
            out["name"] = v.decode()
        elif n in (7, 8):
            out[{7: "startTimeUnixNano", 8: "endTimeUnixNano"}[n]] = str(struct.unpack("<Q", v)[0])
        elif n == 9:
            out["attributes"].append(proto_pair(v))
        elif n == 11:
            got = list(fields(v))
            out["events"].append(
                {
                    "timeUnixNano": str(next((struct.unpack("<Q", x)[0] for k, _, x in got if k == 1), 0)),
                    "name": next((x.decode() for k, _, x in got if k == 2), ""),
                    "attributes": [proto_pair(x) for k, _, x in got if k == 3],
                }
            )
        elif n == 15:
            out["status"] = {"code": ["STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR"][next((x for k, _, x in fields(v) if k == 3), 0)]}
    return out


def proto_payload(body: bytes):
    """An export request as the JSON form has it."""
    out = []
    for n, _, r in fields(body):
        if n == 1:
            parts = list(fields(r))
            resource = [proto_pair(x) for k, _, v in parts if k == 1 for j, _, x in fields(v) if j == 1]
            scopes = [{"spans": [proto_span(x) for j, _, x in fields(v) if j == 2]} for k, _, v in parts if k == 2]
            out.append({"resource": {"attributes": resource}, "scopeSpans": scopes})
    return {"resourceSpans": out}


def gunzipped(raw: bytes, most: int = MOST_BYTES) -> bytes:
    """Plain bytes of gzip or plain input; more than ``most`` is an error, found without inflating all of it."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(most + 1)
    if len(out) > most:
        raise ValueError("payload is larger than allowed")
    return out


def payload_text(raw: bytes, name: str) -> str | None:
    """JSON text of a stored export: by file name, else JSON and then protobuf; None if it is neither."""
    try:
        body = gunzipped(raw)
        kind = name.removesuffix(".gz").rpartition(".")[2].lower()
        if kind not in ("pb", "protobuf", "bin"):
            try:
                return json.dumps(json.loads(body)) if body else "{}"
            except ValueError:
                if kind == "json":
                    return None
        return json.dumps(proto_payload(body))
    except (ValueError, OSError, EOFError, IndexError, struct.error):
        return None


def decoded(files: DataFrame) -> DataFrame:
    """(path, payload) of path and content; payload is null where a file cannot be read."""

    def run(batches):
        for batch in batches:
            paths, raw = batch.column(0), batch.column(1)
            text = [payload_text(c.as_py() or b"", p.as_py()) for p, c in zip(paths, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([paths, pa.array(text, pa.large_string())], names=["path", "payload"])

    return files.select("path", "content").mapInArrow(run, "path string, payload string")


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))


def hex_of(c: Column) -> Column:
    """An id in base64, as some exporters write it, in hex."""
    return F.lower(F.hex(F.unbase64(c)))


