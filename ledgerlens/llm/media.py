"""Media columns: bytes kept in baseline JPEG and read back as DC-only luminance thumbnails."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the 64 coefficients in a quantisation table does not matter here, all are QUANT.
QUANT = 8
BLOCK_COLS = 64
MAX_ROWS = 65535 // 8
PART = BLOCK_COLS * MAX_ROWS
BATCH_BYTES = 4 << 20


class JpegError(ValueError):
    """The bytes are not a baseline JPEG that can be read."""


def canonical_codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as a DHT segment gives it."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # (id, h, v, quantisation table)
    quant: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)  # (class, id) -> codes
    restart: int = 0
    scans: list = field(default_factory=list)  # ([(component, dc, ac)], start, end, restart)


def parse_frames(data: bytes) -> list[Frame]:
    """The images that stand one after another in data."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise JpegError(f"no image begins at {at}")
        frame, at = Frame(), at + 2
        while True:
            if data[at : at + 1] != b"\xff" or at + 2 > len(data):
                raise JpegError(f"no marker at {at}")
            marker, at = data[at + 1], at + 2
            if marker == 0xFF:
                at -= 1
                continue
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 2 or at + size > len(data):
                raise JpegError("a segment is cut off")
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                _quant(frame, body)
            elif marker in (0xC0, 0xC1):
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise JpegError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    frame.huffman[body[0] >> 4, body[0] & 15] = canonical_codes(counts, list(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                used = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                end = at
                while True:  # to the next marker that is neither stuffing nor a restart
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise JpegError("a scan is cut off")
                    if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                        break
                    end += 2
                frame.scans.append((used, at, end, frame.restart))
                at = end
        frames.append(frame)
    return frames


def _quant(frame: Frame, body: bytes) -> None:
    while body:
        wide = body[0] >> 4
        first = int.from_bytes(body[1 : 2 + wide], "big")
        frame.quant[body[0] & 15] = first
        body = body[1 + 64 * (1 + wide) :]


def _even_lookup(dc: list, ac: list) -> np.ndarray | None:
    """word -> DC difference, if every block takes 16 bits: code and magnitude of equal length in sum, then end of block."""
    if len(ac) != 1 or ac[0][0] != 0 or any(length + size + ac[0][2] != 16 for size, _, length in dc):
        return None
    lookup = np.full(1 << 16, -32768, dtype=np.int16)
    for size, code, _ in dc:
        bits = np.arange(1 << size)
        value = np.where(bits >> max(size - 1, 0) == 1, bits, bits - (1 << size) + 1) if size else bits
        lookup[((code << size | bits) << ac[0][2]) | ac[0][1]] = value
    return lookup


_LOOKUPS: dict = {}


def _scan_values(frame: Frame, data: bytes, scan) -> dict[int, np.ndarray]:
    """DC values of each component, blocks in raster order."""
    used, start, end, restart = scan
    parts = {p[0]: p for p in frame.parts}
    tables = [(parts[c], frame.huffman[0, dc], frame.huffman[1, ac]) for c, dc, ac in used]
    h_max, v_max = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    if len(used) == 1:
        part, dc, ac = tables[0]
        cols = -(-(-(-frame.width * part[1] // h_max)) // 8)
        rows = -(-(-(-frame.height * part[2] // v_max)) // 8)
        if not restart:
            key = (tuple(dc), tuple(ac))
            if key not in _LOOKUPS:
                _LOOKUPS[key] = _even_lookup(dc, ac)
            raw = data[start:end]
            if _LOOKUPS[key] is not None:
                raw = raw.replace(b"\xff\x00", b"\xff")
                if len(raw) < 2 * cols * rows:
                    raise JpegError("a scan is cut off")
                steps = _LOOKUPS[key][np.frombuffer(raw, dtype=">u2", count=cols * rows)]
                if steps.size and steps.min() == -32768:
                    raise JpegError("a code is in no table")
                return {part[0]: np.cumsum(steps, dtype=np.int32).reshape(rows, cols)}
        order = [(part, dc, ac, [(0, 0)])]
        grid = {part[0]: (rows, cols, 1, 1)}
        mcus = rows * cols
        across = cols
    else:
        across, down = -(-frame.width // (8 * h_max)), -(-frame.height // (8 * v_max))
        order = [(p, dc, ac, [(y, x) for y in range(p[2]) for x in range(p[1])]) for p, dc, ac in tables]
        grid = {p[0]: (down * p[2], across * p[1], p[2], p[1]) for p, _, _ in tables}
        mcus = across * down
    out = {c: np.zeros(g[:2], dtype=np.int32) for c, g in grid.items()}
    codes = {id(t): {(length, code): symbol for symbol, code, length in t} for _, dc, ac, _ in order for t in (dc, ac)}
    at, segments = start, []
    while at < end:  # cut at restart markers
        cut = at
        while (cut := data.find(b"\xff", cut, end)) >= 0 and not 0xD0 <= data[cut + 1] <= 0xD7:
            cut += 2
        cut = end if cut < 0 else cut
        segments.append(data[at:cut].replace(b"\xff\x00", b"\xff"))
        at = cut + 2
    done = 0
    for segment in segments:
        bits, n_bits, pos = int.from_bytes(segment, "big"), 8 * len(segment), 0
        window, base = 0, -1

        def take(n: int) -> int:
            nonlocal pos, window, base
            if pos + n > n_bits:
                raise JpegError("a scan is cut off")
            if base < 0 or pos + n > base + 4096:  # shifts of a short window, not of the whole segment
                base = pos
                left = max(0, n_bits - base - 4096)
                window = (bits >> left) & ((1 << min(4096, n_bits - base)) - 1)
                if n_bits - base < 4096:
                    window <<= 4096 - (n_bits - base)
            value = (window >> (4096 - (pos - base) - n)) & ((1 << n) - 1)
            pos += n
            return value

        def symbol(table: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise JpegError("a code is in no table")

        before = dict.fromkeys(out, 0)
        for _ in range(min(restart or mcus, mcus - done)):
            for part, dc, ac, places in order:
                dc_codes, ac_codes = codes[id(dc)], codes[id(ac)]
                for y, x in places:
                    size = symbol(dc_codes)
                    step = take(size) if size else 0
                    if size and not step >> (size - 1):
                        step -= (1 << size) - 1
                    before[part[0]] += step
                    k = 1
                    while k < 64:
                        rs = symbol(ac_codes)
                        if rs == 0:
                            break
                        if rs & 15:
                            take(rs & 15)
                            k += (rs >> 4) + 1
                        else:
                            k += 16
                    _, _, v, h = grid[part[0]]
                    out[part[0]][done // across * v + y, done % across * h + x] = before[part[0]]
            done += 1
    if done < mcus:
        raise JpegError("blocks are missing")
    return out


def thumbnails(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, luminance of each 8 x 8 block as uint8) of each image; JpegError if one can't be read."""
    out = []
    for frame in parse_frames(data):
        luma = frame.parts[0] if frame.parts else None
        for scan in frame.scans:
            if luma and any(u[0] == luma[0] for u in scan[0]):
                values = _scan_values(frame, data, scan)[luma[0]]
                level = (values * frame.quant[luma[3]] + 4) // 8 + 128
                out.append((frame.width, frame.height, np.clip(level, 0, 255).astype(np.uint8)))
                break
        else:
            raise JpegError("no luminance scan")
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: Sizes 8 to 0 get codes of 7 to 15 bits: with the magnitude and a 1-bit end of block, each block has 16 bits.
_DC = canonical_codes([0] * 6 + [1] * 9 + [0], list(range(8, -1, -1)))
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0] + [QUANT] * 64))
_TABLES = _segment(0xC4, bytes([0x00] + [0] * 6 + [1] * 9 + [0] + list(range(8, -1, -1)))) + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0])) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _words() -> np.ndarray:
    """difference + 255 -> the 16 bits of a block."""
    out = np.zeros(511, dtype=np.uint16)
    for size, code, _ in _DC:
        for d in [0] if size == 0 else [s * m for m in range(1 << (size - 1), 1 << size) for s in (1, -1)]:
            if abs(d) <= 255:
                out[d + 255] = ((code << size) | (d if d > 0 else d + (1 << size) - 1 if d else 0)) << 1
    return out


_WORDS = _words().astype(">u2")


def encode_payload(payload: np.ndarray) -> bytes:
    """A multiple of 64 bytes as grey images 64 blocks wide, one byte in the DC value of each block, one after another."""
    out = []
    for at in range(0, len(payload), PART):
        part = payload[at : at + PART]
        value = part.astype(np.int16) - 128
        step = np.diff(value, prepend=np.int16(0))
        height = len(part) // BLOCK_COLS * 8
        size = _segment(0xC0, bytes([8, *height.to_bytes(2, "big"), *(8 * BLOCK_COLS).to_bytes(2, "big"), 1, 1, 0x11, 0]))
        out += [_HEAD, size, _TABLES, _WORDS[step + 255].tobytes(), b"\xff\xd9"]
    return b"".join(out)


def decode_payload(media: bytes) -> np.ndarray:
    """The payload, from the stored bytes alone."""
    return np.concatenate([t.ravel() for _, _, t in thumbnails(media)])


def feature_of(thumbs: list[tuple[int, int, np.ndarray]]) -> str:
    """Width x height, average hash and difference hash of the thumbnails, one below another."""
    grey = np.concatenate([t for _, _, t in thumbs]) if len(thumbs) > 1 else thumbs[0][2]
    rows, cols = grey.shape
    if rows < 8 or cols < 8:
        grey = np.repeat(np.repeat(grey, -(-8 // rows), 0), -(-8 // cols), 1)
        rows, cols = grey.shape
    y, x = np.arange(9) * rows // 8, np.arange(9) * cols // 8
    cells = np.add.reduceat(np.add.reduceat(grey, y[:-1], 0, dtype=np.int64), x[:-1], 1) * 1000
    cells = cells // (np.diff(y)[:, None] * np.diff(x)[None, :])
    average = np.packbits(cells.ravel() * 64 > cells.sum()).tobytes().hex()
    difference = np.packbits(np.roll(cells, -1, 1).ravel() > cells.ravel()).tobytes().hex()
    return f"{thumbs[0][0]}x{sum(h for _, h, _ in thumbs)}:{average}:{difference}"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text in zip(batch["doc_id"], batch["text"], strict=True):
            raw = text.encode()
            payload = np.frombuffer(raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw)), dtype=np.uint8)
            media = encode_payload(payload)
            thumbs = thumbnails(media)
            back = b"".join(t.tobytes() for _, _, t in thumbs)
            out.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(thumbs)))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": batch["doc_id"].dtype})


COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
REPORT = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: what its whole text gives when it is kept as JPEG and read back.

    The text's UTF-8 with bytes 0 up to a positive multiple of 64 is the payload; each byte is the DC value
    of a block of a grey baseline JPEG (images of up to 8,191 rows of 64 blocks, one after another for longer texts), which is lossless since
    no other coefficient is set and the quantiser divides 8. The reader parses markers, Huffman-decodes the scans and takes the DC-only luminance
    thumbnails, which are the payload. Equal texts give equal values.

    Cases: a null text is an empty one (64 bytes 0); a null identifier stays null; repeated rows each get their row; an
    empty table gives no rows; other columns are ignored.
    """
    kind = dict(documents.dtypes)[id_col]
    text = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.mapInPandas(_store, "doc_id string, " + REPORT).withColumn("doc_id", F.col("doc_id").cast(kind))


def _read_images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, data in zip(batch["key"], batch["image"], strict=True):
            try:
                thumbs = thumbnails(bytes(data))
                out.append((key, thumbs[0][0], sum(t[1] for t in thumbs), feature_of(thumbs), None))
            except (JpegError, IndexError, KeyError) as e:
                out.append((key, None, None, None, str(e)))
        frame = pd.DataFrame(out, columns=["key", "width", "height", "feature", "error"])
        yield frame.astype({"width": "Int32", "height": "Int32"})


def image_features(images: DataFrame, key_col: str, image_col: str) -> DataFrame:
    """key, width, height, feature, error for a column of JPEG files; a file that can't be read gets its error, null an error too."""
    rows = images.select(F.col(key_col).cast("string").alias("key"), F.coalesce(F.col(image_col), F.lit(b"")).alias("image"))
    return rows.mapInPandas(_read_images, "key string, width int, height int, feature string, error string")
