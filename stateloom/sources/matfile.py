"""MAT files of level 5: arrays, characters, cells and structures, plain or deflated, of either byte order.

What a file holds comes as a dict: numeric arrays as NumPy arrays of their own shape, characters as str (a list of them for
several rows), cells as object arrays, a single structure as a dict, an array of them as an object array of dicts.
Files of level 7.3 are another format (HDF5) and raise, as do objects and function handles."""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np

# Fixed values of the format: data types with their NumPy code, and array classes.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
_MATRIX, _COMPRESSED = 14, 15
_CELL, _STRUCT, _CHAR, _SPARSE = 1, 2, 4, 5
_NUMERIC = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
_COMPLEX, _LOGICAL = 0x08, 0x02


class _Reader:
    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = memoryview(data), order, 0

    def tag(self) -> tuple[int, memoryview]:
        """Type and bytes of the next element; small ones stand inside their tag."""
        if self.at + 8 > len(self.data):
            raise ValueError("the MAT file ends inside an element")
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if kind >> 16:
            kind, size, start = kind & 0xFFFF, kind >> 16, self.at + 4
            self.at += 8
        else:
            start = self.at + 8
            self.at = start + (size if kind == _COMPRESSED else -(-size // 8) * 8)
        if start + size > len(self.data):
            raise ValueError("the MAT file ends inside an element")
        return kind, self.data[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.tag()
        if kind not in _TYPES:
            raise ValueError(f"data type {kind} is not supported")
        return np.frombuffer(data, self.order + _TYPES[kind])

    def text(self) -> str:
        return bytes(self.tag()[1]).rstrip(b"\0").decode("latin-1")


def _matrix(data: memoryview, order: str) -> tuple[str, Any]:
    """(name, value) of a matrix element."""
    if not len(data):
        return "", np.zeros((0, 0))
    r = _Reader(data, order)
    flags = int(r.numbers()[0])
    kind, flags = flags & 0xFF, flags >> 8 & 0xFF
    shape = tuple(int(n) for n in r.numbers())
    name = r.text()
    if kind == _CELL:
        return name, _filled([_inner(r) for _ in range(int(np.prod(shape)))], shape)
    if kind == _STRUCT:
        width = int(r.numbers()[0])
        names = bytes(r.tag()[1])
        fields = [names[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)]
        items = [{f: _inner(r) for f in fields} for _ in range(int(np.prod(shape)))]
        return name, items[0] if len(items) == 1 else _filled(items, shape)
    if kind == _CHAR:
        code, data = r.tag()
        if code == 16:
            letters = list(bytes(data).decode("utf-8"))
        else:
            letters = [chr(c) for c in np.frombuffer(data, r.order + _TYPES[code])]
        rows = ["".join(row) for row in _filled(letters, shape)] if letters else []
        return name, rows[0] if len(rows) == 1 else rows if rows else ""
    if kind == _SPARSE:
        ir, jc = r.numbers().astype(np.int64), r.numbers().astype(np.int64)
        values = r.numbers().astype(float)
        if flags & _COMPLEX:
            values = values + 1j * r.numbers()
        out = np.zeros(shape, values.dtype)
        n = int(jc[-1])
        out[ir[:n], np.repeat(np.arange(shape[1]), np.diff(jc))] = values[:n]
        return name, out
    if kind not in _NUMERIC:
        raise ValueError(f"array class {kind} is not supported")
    values = r.numbers().astype(_NUMERIC[kind])
    if flags & _COMPLEX:
        values = values + 1j * r.numbers()
    if flags & _LOGICAL:
        values = values.astype(bool)
    return name, values.reshape(shape, order="F")


def _inner(r: _Reader) -> Any:
    kind, data = r.tag()
    if kind != _MATRIX:
        raise ValueError(f"element type {kind} stands where an array should")
    return _matrix(data, r.order)[1]


def _filled(items: list, shape: tuple[int, ...]) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out.reshape(shape, order="F")


def read(data: bytes) -> dict[str, Any]:
    """The variables of a file."""
    if data[:4] == b"\x89HDF" or b"MATLAB 7.3" in data[:116]:
        raise ValueError("MAT files of level 7.3 are not supported; save them as -v7")
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order = "<" if data[126:128] == b"IM" else ">"
    r, out = _Reader(data[128:], order), {}
    while r.at < len(r.data):
        kind, part = r.tag()
        if kind == _COMPRESSED:
            kind, part = _Reader(zlib.decompress(part), order).tag()
        if kind == _MATRIX:
            name, value = _matrix(part, order)
            out[name] = value
    return out


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _array(name: str, value: Any) -> bytes:
    head = lambda kind, shape, flags=0: _element(6, struct.pack("<II", kind | flags << 8, 0)) + _element(5, np.array(shape, "<i4").tobytes()) + _element(1, name.encode("latin-1"))
    if isinstance(value, dict):
        value = _filled([value], (1, 1))
    if isinstance(value, str):
        body = head(_CHAR, (min(1, len(value)), len(value))) + _element(16, value.encode())
    else:
        a = np.asarray(value)
        a = a.reshape(1, 1) if a.ndim == 0 else a.reshape(1, -1) if a.ndim == 1 else a
        flat = a.ravel(order="F")
        if a.dtype == object and len(flat) and all(isinstance(v, dict) for v in flat):
            fields = list(flat[0])
            width = 1 + max(map(len, fields), default=0)
            body = head(_STRUCT, a.shape) + _element(5, struct.pack("<i", width)) + _element(1, b"".join(f.encode("latin-1").ljust(width, b"\0") for f in fields))
            body += b"".join(_array("", v[f]) for v in flat for f in fields)
        elif a.dtype == object:
            body = head(_CELL, a.shape) + b"".join(_array("", v) for v in flat)
        else:
            logical, cplx = a.dtype == bool, np.iscomplexobj(a)
            real = flat.astype("u1") if logical else flat.real if cplx else flat
            code = real.dtype.str[1:]
            kind = next(k for k, c in _NUMERIC.items() if c == code)
            data = lambda v: _element(next(k for k, c in _TYPES.items() if c == code), np.ascontiguousarray(v, "<" + code).tobytes())
            body = head(kind, a.shape, (_LOGICAL if logical else 0) | (_COMPLEX if cplx else 0)) + data(real) + (data(flat.imag) if cplx else b"")
    return _element(_MATRIX, body)


def write(variables: dict[str, Any], compress: bool = True) -> bytes:
    """A file of the variables; numbers, arrays, str, dicts and object arrays of such."""
    out = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack("<H", 0x0100) + b"IM"
    for name, value in variables.items():
        part = _array(name, value)
        if compress:
            part = zlib.compress(part)
            part = struct.pack("<II", _COMPRESSED, len(part)) + part
        out += part
    return out
