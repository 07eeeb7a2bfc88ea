"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds all magic byte strings of a blob in one pass.
For each hit a validator of that format checks structure and lengths; only what
holds is believed, so the declared type is corrected by evidence, and media that
lie inside other bytes are carved out with their exact extent.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.staging import ship_code

RATE = 8000
BLOCK = 64


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    end: int


def _wav(b: memoryview, at: int) -> int | None:
    """End of a RIFF/WAVE file: form size, a fmt chunk of a known layout, then a data chunk, all inside."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    p, fmt = at + 12, None
    while p + 8 <= end:
        name, n = bytes(b[p : p + 4]), int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, p + 8)
        if name == b"data":
            good = fmt and fmt[4] == fmt[1] * fmt[5] // 8 and fmt[3] == fmt[2] * fmt[4] and fmt[4] and n % fmt[4] == 0
            return end if good else None
        p += 8 + n + n % 2
    return None


def _png(b: memoryview, at: int) -> int | None:
    """End of a PNG: a chain of chunks with right CRCs from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if first and (name != b"IHDR" or n != 13) or p + 12 + n > len(b):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p
    return None


def _gif(b: memoryview, at: int) -> int | None:
    """End of a GIF: the screen descriptor, then blocks up to the trailer."""
    if len(b) < at + 13:
        return None
    flags, p = b[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 128 else 0
    images = 0
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 if images else None
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            own = b[p + 9]
            p += 10 + (3 << ((own & 7) + 1) if own & 128 else 0) + 1
            images += 1
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _bmp(b: memoryview, at: int) -> int | None:
    """End of a BMP: sizes of file, header and pixels must agree."""
    if len(b) < at + 54:
        return None
    size, zero, start, header, w, h, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    rows = ((w * depth + 31) // 32 * 4) * abs(h)
    good = zero == 0 and header == 40 and planes == 1 and depth in (1, 4, 8, 24, 32) and packed == 0 and w > 0 and h
    return at + size if good and start >= 54 and start + rows <= size and at + size <= len(b) else None


def _jpeg(b: memoryview, at: int) -> int | None:
    """End of a JPEG: marker segments with lengths inside, a frame before the scan, EOI after it."""
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b) or kind in (0x00, 0xD8, 0xD9):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            end = bytes(b[p:]).find(b"\xff\xd9")
            return p + end + 2 if frame and end >= 0 else None
    return None


#: Magic bytes of each format, with the validator that must agree.
MAGIC: tuple[tuple[bytes, str, Callable[[memoryview, int], int | None]], ...] = (
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
)
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(MAGIC):
            a.add_word(magic.decode("latin-1"), i)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(blob: bytes) -> list[Found]:
    """All media in blob that validate, by start; what lies inside an earlier one's extent is listed too."""
    view, out = memoryview(blob), []
    for last, i in automaton().iter(blob.decode("latin-1")):
        magic, kind, check = MAGIC[i]
        start = last - len(magic) + 1
        end = check(view, start)
        if end is not None:
            out.append(Found(kind, start, end))
    return sorted(out, key=lambda f: (f.start, -f.end))


def corrected_type(blob: bytes, declared: str | None) -> tuple[str | None, list[Found]]:
    """The type that the bytes prove (at place 0), else the declared one; and everything carved after place 0."""
    found = sniff(blob)
    top = next((f for f in found if f.start == 0), None)
    return (top.kind if top else declared), [f for f in found if f is not top]


def wav_pack(payload: bytes) -> bytes:
    """payload as mono samples of 8 bits."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(blob: bytes) -> bytes:
    """The data chunk, found by walking the chunks."""
    p = 12
    while p + 8 <= len(blob):
        n = int.from_bytes(blob[p + 4 : p + 8], "little")
        if blob[p : p + 4] == b"data":
            return blob[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def pad(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def describe(blob: bytes, declared: str = "application/octet-stream") -> tuple[bytes, str]:
    """The samples read back, and a feature string: proven type, carved media, loudness and level crossings."""
    kind, carved = corrected_type(blob, declared)
    back = wav_samples(blob)
    x = np.frombuffer(back, np.uint8)
    hist = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(hist @ values) / len(x)
    power = float(hist @ (values - 128.0) ** 2) / len(x)
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    inside = ",".join(f"{f.kind}@{f.start}-{f.end}" for f in carved)
    return back, f"{kind};rate={RATE};samples={len(x)};mean={mean:.4f};rms={power**0.5:.4f};crossings={crossings};peak={int(x.max())};carved=[{inside}]"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(keep_media: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = wav_pack(pad(raw))
                back, feature = describe(media)
                row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                out.append((*row, media) if keep_media else row)
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * keep_media
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as 8-bit samples, read back, sniffed and described; no shuffle.

    Null and empty texts are 64 bytes 0. Repeated rows give repeated rows, equal
    texts equal values, null ids stay null; extra columns are not read. A task
    holds one batch of texts and one blob. keep_media adds the stored bytes.
    """
    ship_code(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInPandas(_rows(keep_media), SCHEMA + (", media binary" if keep_media else ""))


SNIFFED = "id long, declared_type string, corrected_type string, proven boolean, carved array<struct<kind: string, start: long, end: long, bytes: binary>>"


def _sniffed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for row, blob, declared in zip(b["id"], b["media"], b["declared_type"], strict=True):
            blob, declared = bytes(blob) if isinstance(blob, (bytes, bytearray)) else b"", declared if isinstance(declared, str) else None
            found = sniff(blob)
            kind, carved = corrected_type(blob, declared)
            out.append((row, declared, kind, any(f.start == 0 for f in found), [{"kind": f.kind, "start": f.start, "end": f.end, "bytes": blob[f.start : f.end]} for f in carved]))
        frame = pd.DataFrame(out, columns=["id", "declared_type", "corrected_type", "proven", "carved"])
        frame["id"] = frame["id"].astype("Int64")
        yield frame


def sniff_media(df: DataFrame, id_col: str, media_col: str, type_col: str) -> DataFrame:
    """One row per row of a media column: id, declared_type, corrected_type, proven, carved (kind, start, end, bytes); no shuffle.

    corrected_type is what the bytes at place 0 prove (proven), else the declared
    type. carved: every valid medium that starts later, its bytes too. Null and
    empty media prove nothing; repeated rows give repeated rows; null ids and
    types stay null; extra columns are not read; no rows give no rows. Known are
    PNG, GIF, BMP with a 40-byte header, WAV and JPEG.
    """
    ship_code(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"), F.col(type_col).alias("declared_type")).mapInPandas(_sniffed, SNIFFED)
