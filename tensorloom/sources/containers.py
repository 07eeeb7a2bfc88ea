"""File containers of dense tensors: where the entries of a file begin, and in which shape and type."""

from __future__ import annotations

import ast
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from math import prod

import numpy as np

#: Fixed values of the formats.
NPY_MAGIC = b"\x93NUMPY"
LIME_MAGIC = b"\x45\x67\x89\xab\x00\x01"
MAP_MAGIC = "XXXXQDPLazyDiskMapObjFileXXXX"
ReadAt = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Block:
    """A dense C-order array in a file; key: leading index values that the block stands for."""

    offset: int
    shape: tuple[int, ...]
    dtype: str
    key: tuple[int, ...] = ()

    @property
    def itemsize(self) -> int:
        return np.dtype(self.dtype).itemsize

    def checked(self, size: int | None) -> Block:
        if size is not None and self.offset + prod(self.shape) * self.itemsize > size:
            raise ValueError(f"file of {size} bytes is too short for {self.shape} {self.dtype} at {self.offset}")
        return self


def npy(read: ReadAt) -> list[Block]:
    head = read(0, 12)
    if head[:6] != NPY_MAGIC:
        raise ValueError("not an npy file")
    if head[6] == 1:
        n, at = struct.unpack("<H", head[8:10])[0], 10
    elif head[6] == 2:
        n, at = struct.unpack("<I", head[8:12])[0], 12
    else:
        raise ValueError(f"npy version {head[6]} is not known")
    meta = ast.literal_eval(read(at, n).decode("latin-1"))
    if meta["fortran_order"]:
        raise ValueError("only C order is read")
    return [Block(at + n, tuple(meta["shape"]), meta["descr"])]


def raw(shape: tuple[int, ...], dtype: str) -> list[Block]:
    if not re.fullmatch(r"[<>=]?[iufc]\d+", dtype):
        raise ValueError(f"dtype {dtype} is not a number type")
    return [Block(0, shape, dtype)]


def lime(read: ReadAt, shape: tuple[int, ...] | None = None, dtype: str | None = None) -> list[Block]:
    """A LIME container with ildg-format and ildg-binary-data records; numbers are big-endian."""
    records, at = {}, 0
    while True:
        head = read(at, 144)
        if len(head) < 144:
            break
        if not head.startswith(LIME_MAGIC):
            raise ValueError("not a LIME record")
        n = struct.unpack(">Q", head[8:16])[0]
        records.setdefault(head[16:144].rstrip(b"\0").decode(), (at + 144, n))
        at += 144 + (n + 7) // 8 * 8
    start, n = records["ildg-format"]
    root = ET.fromstring(read(start, n).rstrip(b"\0").decode())
    tag = re.match(r"\{.*\}", root.tag)
    ns = tag[0] if tag else ""
    lx, ly, lz, lt = (int(root.find(f"{ns}{x}").text) for x in ("lx", "ly", "lz", "lt"))
    precision = int(root.find(f"{ns}precision").text)
    offset, n = records["ildg-binary-data"]
    shape = shape or (lt, lz, ly, lx, 4, 3, 3)
    dtype = dtype or f">c{precision // 8 * 2}"
    if np.dtype(dtype).itemsize != precision // 8 * 2 or prod(shape) * np.dtype(dtype).itemsize != n:
        raise ValueError("the record's length does not fit shape and precision")
    return [Block(offset, shape, dtype)]


def disk_map(read: ReadAt, shape: tuple[int, ...], dtype: str, keys: int) -> list[Block]:
    """A key -> offset map file; the first `keys` axes of shape are the key."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        out = read(at, n)
        at += n
        return out

    def text() -> str:
        return take(struct.unpack(">i", take(4))[0]).decode()

    if text() != MAP_MAGIC:
        raise ValueError("not a map file")
    take(4)
    root = ET.fromstring(text())
    if int(root.find("decay_dir").text) != 3:
        raise ValueError("the map's time direction must be 3")
    at = struct.unpack(">q", take(8))[0]
    if at < 0:
        raise ValueError("negative position")
    out = []
    for _ in range(struct.unpack(">I", take(4))[0]):
        n = struct.unpack(">i", take(4))[0] // 4
        key = struct.unpack(f">{n}i", take(4 * n))
        out.append(Block(struct.unpack(">q", take(8))[0], shape[keys:], dtype, tuple(key)))
    return out


def blocks(container: str, read: ReadAt, shape: tuple[int, ...] | None, dtype: str | None, keys: int = 0) -> list[Block]:
    if container == "npy":
        return npy(read)
    if container == "raw":
        return raw(shape, dtype or "<c16")
    if container == "lime":
        return lime(read, shape, dtype)
    if container == "map":
        return disk_map(read, shape, dtype or "<c8", keys)
    raise ValueError(f"unknown container {container}")


def npy_head(shape: tuple[int, ...], dtype: str) -> bytes:
    """Magic, version 1.0 and the array's description, padded to a multiple of 64 bytes."""
    text = f"{{'descr': '{dtype}', 'fortran_order': False, 'shape': {tuple(shape)!r}, }}".encode()
    text += b" " * (-(len(NPY_MAGIC) + 4 + len(text) + 1) % 64) + b"\n"
    return NPY_MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text


def lime_record(name: str, size: int) -> bytes:
    return LIME_MAGIC + b"\0\0" + struct.pack(">Q", size) + name.encode().ljust(128, b"\0")


def lime_head(size: tuple[int, int, int, int], dtype: str, length: int) -> bytes:
    lx, ly, lz, lt = size
    xml = f"<f><lx>{lx}</lx><ly>{ly}</ly><lz>{lz}</lz><lt>{lt}</lt><precision>{np.dtype(dtype).itemsize * 4}</precision></f>".encode()
    return lime_record("ildg-format", len(xml)) + xml + bytes(-len(xml) % 8) + lime_record("ildg-binary-data", length)


def map_head(size: tuple[int, ...]) -> bytes:
    def text(s: str) -> bytes:
        return struct.pack(">i", len(s)) + s.encode()

    return text(MAP_MAGIC) + struct.pack(">i", 1) + text(f"<m><lattSize>{' '.join(map(str, size))}</lattSize><decay_dir>3</decay_dir></m>")


@dataclass(frozen=True)
class Layout:
    """Where the segments of dense files lie: a segment holds the entries of one index of the `lead` leading axes.

    container: npy, raw, lime (axes t, z, y, x, ...), map (axes t, e, z, y, x, c), or slices, npy files of
    a segment each.
    """

    container: str
    shape: tuple[int, ...]
    type_: str
    lead: int = 1

    @property
    def dtype(self) -> str:
        return f">c{np.dtype(self.type_).itemsize}" if self.container == "lime" else self.type_

    @property
    def segment(self) -> tuple[int, ...]:
        return self.shape[self.lead :]

    @property
    def bytes_(self) -> int:
        return prod(self.segment) * np.dtype(self.dtype).itemsize

    def name(self, cfg: str, lead: tuple[int, ...], suffix: str) -> str:
        return cfg + "".join(f".t{i:03d}" for i in lead) + suffix if self.container == "slices" else cfg + suffix

    def head(self) -> bytes:
        if self.container == "raw":
            return b""
        if self.container == "npy":
            return npy_head(self.shape, self.dtype)
        if self.container == "slices":
            return npy_head(self.segment, self.dtype)
        if self.container == "lime":
            t, z, y, x = self.shape[:4]
            return lime_head((x, y, z, t), self.dtype, prod(self.shape) * np.dtype(self.dtype).itemsize)
        if self.container == "map":
            t, _, z, y, x = self.shape[:5]
            head = map_head((x, y, z, t))
            return head + struct.pack(">q", len(head) + 8 + prod(self.shape[: self.lead]) * self.bytes_)
        raise ValueError(f"unknown container {self.container}")

    def number(self, lead: tuple[int, ...]) -> int:
        out = 0
        for i, n in zip(lead, self.shape[: self.lead], strict=True):
            out = out * n + i
        return out

    def place(self, lead: tuple[int, ...]) -> int:
        return len(self.head()) + (0 if self.container == "slices" else self.number(lead) * self.bytes_)

    def frame(self, cfg: str, suffix: str, leads: list[tuple[int, ...]]) -> list[tuple[str, bytes, int, bytes, int]]:
        """(file name, what stands before the data, where and what stands after it, size without that) of a configuration's files."""
        head, many = self.head(), prod(self.shape[: self.lead])
        if self.container == "slices":
            return [(self.name(cfg, x, suffix), head, len(head) + self.bytes_, b"", len(head) + self.bytes_) for x in leads]
        end = len(head) + many * self.bytes_
        after = b""
        if self.container == "map":
            keys = [x for x in np.ndindex(*self.shape[: self.lead])]
            after = struct.pack(">I", many) + b"".join(struct.pack(f">i{self.lead}i", 4 * self.lead, *x) + struct.pack(">q", self.place(x)) for x in keys)
        return [(cfg + suffix, head, end, after, end)]


def map_file(entries: dict[tuple[int, ...], np.ndarray], size: tuple[int, ...]) -> bytes:
    """The bytes of a map file, for tests and export."""

    def text(s: str) -> bytes:
        return struct.pack(">i", len(s)) + s.encode()

    head = text(MAP_MAGIC) + struct.pack(">i", 1) + text(f"<m><lattSize>{' '.join(map(str, size))}</lattSize><decay_dir>3</decay_dir></m>")
    at, body, table = len(head) + 8, b"", b""
    for key, x in entries.items():
        table += struct.pack(f">i{len(key)}i", 4 * len(key), *key) + struct.pack(">q", at + len(body))
        body += np.ascontiguousarray(x).tobytes()
    return head + struct.pack(">q", at + len(body)) + body + struct.pack(">I", len(entries)) + table


def lime_file(x: np.ndarray, size: tuple[int, int, int, int]) -> bytes:
    """A LIME container with one big-endian complex field, for tests and export."""
    lx, ly, lz, lt = size
    xml = f"<f><lx>{lx}</lx><ly>{ly}</ly><lz>{lz}</lz><lt>{lt}</lt><precision>{x.dtype.itemsize * 4}</precision></f>".encode()

    def record(name: str, body: bytes) -> bytes:
        return LIME_MAGIC + b"\0\0" + struct.pack(">Q", len(body)) + name.encode().ljust(128, b"\0") + body + bytes(-len(body) % 8)

    return record("ildg-format", xml) + record("ildg-binary-data", x.astype(x.dtype.newbyteorder(">")).tobytes())
