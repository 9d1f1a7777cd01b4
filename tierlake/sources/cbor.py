"""The part of CBOR (RFC 8949) that holds JSON values."""

from __future__ import annotations

import struct
from typing import Any

from tierlake.errors import FormatError


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise FormatError(f"{n} is too large")


def dumps(x: Any) -> bytes:
    """One value as bytes."""
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[x]
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _head(3, len(raw)) + raw
    if isinstance(x, (list, tuple)):
        return _head(4, len(x)) + b"".join(map(dumps, x))
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(dumps(k) + dumps(v) for k, v in x.items())
    raise FormatError(f"{type(x).__name__} can't be written")


def _item(data: bytes, at: int) -> tuple[Any, int]:
    major, low = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if low in (20, 21, 22, 23):
            return {20: False, 21: True, 22: None, 23: None}[low], at
        kind, size = {25: (">e", 2), 26: (">f", 4), 27: (">d", 8)}[low]
        return struct.unpack(kind, data[at : at + size])[0], at + size
    if low == 31:  # of unknown length, up to a break
        parts: list[Any] = []
        while data[at] != 0xFF:
            x, at = _item(data, at)
            parts.append(x)
        at += 1
        if major == 3:
            return "".join(parts), at
        return (parts, at) if major == 4 else (dict(zip(parts[::2], parts[1::2])), at)
    size = {24: 1, 25: 2, 26: 4, 27: 8}.get(low, 0)
    n = int.from_bytes(data[at : at + size], "big") if size else low
    at += size
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        raw = data[at : at + n]
        return (raw.decode() if major == 3 else raw), at + n
    out = []
    for _ in range(n * (2 if major == 5 else 1)):
        x, at = _item(data, at)
        out.append(x)
    return (out, at) if major == 4 else (dict(zip(out[::2], out[1::2])), at)


def loads(data: bytes) -> Any:
    """The value of bytes; FormatError if they hold none."""
    try:
        return _item(data, 0)[0]
    except (IndexError, KeyError, UnicodeDecodeError, struct.error, TypeError) as e:
        raise FormatError(f"no CBOR: {e!r}") from None
