"""Ruby's Marshal format 4.8 for plain data: None, booleans, whole numbers, floats, texts and mappings of these.

The format is public: a version, then one object; small numbers take one byte, symbols and objects that come again are
written as references. Texts are written as UTF-8 strings; symbols are read as texts.
"""

from __future__ import annotations

import math

VERSION = b"\x04\x08"


def _long(n: int) -> bytes:
    if n == 0:
        return b"\0"
    if 0 < n < 123:
        return bytes([n + 5])
    if -124 < n < 0:
        return bytes([(n - 5) & 255])
    size = next(k for k in range(1, 5) if -(1 << 8 * k) <= n < 1 << 8 * k)
    return bytes([size if n > 0 else 256 - size]) + (n & ((1 << 8 * size) - 1)).to_bytes(size, "little")


def _sized(data: bytes) -> bytes:
    return _long(len(data)) + data


def dumps(value: object) -> bytes:
    encoding_known = False

    def write(x: object) -> bytes:
        nonlocal encoding_known
        if x is None or x is True or x is False:
            return {None: b"0", True: b"T", False: b"F"}[x]
        if isinstance(x, int):
            if -(1 << 30) <= x < 1 << 30:
                return b"i" + _long(x)
            shorts = (abs(x).bit_length() + 15) // 16
            return b"l" + (b"+" if x > 0 else b"-") + _long(shorts) + abs(x).to_bytes(2 * shorts, "little")
        if isinstance(x, float):
            text = "nan" if math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else repr(x)
            return b"f" + _sized(text.encode())
        if isinstance(x, str):
            body = b'I"' + _sized(x.encode()) + _long(1) + (b";\0" if encoding_known else b":" + _sized(b"E")) + b"T"
            encoding_known = True
            return body
        if isinstance(x, dict):
            return b"{" + _long(len(x)) + b"".join(write(k) + write(v) for k, v in x.items())
        raise TypeError(f"no plain data: {type(x).__name__}")

    return VERSION + write(value)


def loads(data: bytes) -> object:
    if data[:2] != VERSION:
        raise ValueError("not of version 4.8")
    at = 2
    symbols: list[str] = []
    objects: list[object] = []

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(data):
            raise ValueError("ends too early")
        return data[at - n : at]

    def long() -> int:
        n = int.from_bytes(take(1), "little", signed=True)
        if abs(n) > 4:
            return n - 5 if n > 0 else n + 5
        if n >= 0:
            return int.from_bytes(take(n), "little")
        return int.from_bytes(take(-n), "little") - (1 << -8 * n)

    def text() -> str:
        return take(long()).decode("utf-8", "replace")

    def kept(x: object) -> object:
        objects.append(x)
        return x

    def read() -> object:
        kind = take(1)
        if kind in b"0TF":
            return {b"0": None, b"T": True, b"F": False}[kind]
        if kind == b"i":
            return long()
        if kind == b"l":
            sign = take(1)
            n = int.from_bytes(take(2 * long()), "little")
            return kept(n if sign == b"+" else -n)
        if kind == b"f":
            return kept(float(text()))
        if kind == b'"':
            return kept(text())
        if kind == b"I":
            x = read()
            for _ in range(long()):
                read(), read()
            return x
        if kind == b":":
            symbols.append(text())
            return symbols[-1]
        if kind == b";":
            return symbols[long()]
        if kind == b"@":
            return objects[long()]
        if kind in b"{}":
            out: dict = {}
            objects.append(out)
            for _ in range(long()):
                k = read()
                out[k] = read()
            if kind == b"}":
                read()
            return out
        raise ValueError(f"no plain data: {kind!r}")

    return read()
