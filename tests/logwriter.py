"""Writes small logs of both kinds."""

from __future__ import annotations

import struct


def declare(msg_type: int, name: str, form: str, labels: str) -> bytes:
    return b"\xa3\x95\x80" + struct.pack("<BB4s16s64s", msg_type, 0, name.encode(), form.encode(), labels.encode())


def record(msg_type: int, layout: str, *values) -> bytes:
    return b"\xa3\x95" + bytes([msg_type]) + struct.pack("<" + layout, *values)


GPS = declare(130, "GPS", "QLLf", "TimeUS,Lat,Lng,Alt")
STAT = declare(131, "STAT", "f", "Val")


def gps(t: int, lat: float, lon: float, alt: float) -> bytes:
    return record(130, "Qiif", t, round(lat * 1e7), round(lon * 1e7), alt)


def frame2(ts: int, msg_id: int, payload: bytes, signed: bool = False) -> bytes:
    head = bytes([0xFD, len(payload), 1 if signed else 0, 0, 0, 1, 1]) + msg_id.to_bytes(3, "little")
    return ts.to_bytes(8, "big") + head + payload + b"\0\0" + (b"\0" * 13 if signed else b"")


def frame1(ts: int, msg_id: int, payload: bytes) -> bytes:
    return ts.to_bytes(8, "big") + bytes([0xFE, len(payload), 0, 1, 1, msg_id]) + payload + b"\0\0"
