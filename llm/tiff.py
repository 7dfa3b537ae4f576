"""Media columns: TIFF files as rows of pages.

The reader walks the image directories of a file (classic or big, either byte order),
decodes stored, PackBits, LZW and deflate strips or tiles, undoes the predictors and
gives one row for each page.  The writer makes plain 8-bit grey pages; with it any bytes
can be kept as an image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table

#: Sizes in bytes of the field types 1 to 18 (fixed values of the format).
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
#: Struct codes of the whole-number types.
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
STORED, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


#: Each byte with its bits in the other order, for files with FillOrder 2.
MIRROR = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


class TiffError(ValueError):
    """The bytes are no TIFF file that this reader knows."""


def unpack_bits(data: bytes) -> bytes:
    """PackBits: runs and literals behind a signed count."""
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, one code early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, before = list(base), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            words, before, width = list(base), b"", 9
            continue
        if not before:
            if code >= 256:
                raise TiffError("LZW data starts with a code that has no meaning yet")
            before = words[code]
            out.append(before)
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words):
            word = before + before[:1]
        else:
            raise TiffError("LZW code beyond the table")
        out.append(word)
        words.append(before + word[:1])
        before = word
        if len(words) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def _expand(data: bytes, compression: int) -> bytes:
    if compression == STORED:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    raise TiffError(f"compression {compression} is not known")


class Reader:
    """The pages of one file."""

    def __init__(self, data: bytes):
        self.data = data
        mark = data[:2]
        if mark not in (b"II", b"MM"):
            raise TiffError("no byte order mark")
        self.order = "<" if mark == b"II" else ">"
        (magic,) = self._get("H", 2, 1)
        if magic == 42:
            self.big, (self.first,) = False, self._get("I", 4, 1)
        elif magic == 43:
            self.big, (self.first,) = True, self._get("Q", 8, 1)
        else:
            raise TiffError(f"version {magic}")

    def _get(self, code: str, at: int, n: int) -> tuple:
        try:
            return struct.unpack_from(f"{self.order}{n}{code}", self.data, at)
        except struct.error:
            raise TiffError("a field lies beyond the end") from None

    def directories(self):
        """Fields by tag of each image directory, following the chain once."""
        at, seen = self.first, set()
        while at and at not in seen:
            seen.add(at)
            (count,) = self._get("Q" if self.big else "H", at, 1)
            at += 8 if self.big else 2
            fields = {}
            for k in range(count):
                e = at + k * (20 if self.big else 12)
                tag, kind = self._get("H", e, 2)
                (n,) = self._get("Q" if self.big else "I", e + 4, 1)
                room, spot = (8, e + 12) if self.big else (4, e + 8)
                size = TYPE_SIZE.get(kind, 0) * n
                if size > room:
                    (spot,) = self._get("Q" if self.big else "I", spot, 1)
                if kind in TYPE_CODE:
                    fields[tag] = self._get(TYPE_CODE[kind], spot, n)
            yield fields
            (at,) = self._get("Q" if self.big else "I", at + count * (20 if self.big else 12), 1)

    def page(self, fields: dict) -> dict:
        """Size, form and samples of a page, samples in page order."""
        one = lambda tag, default=None: fields.get(tag, (default,))[0]
        width, height = one(256), one(257)
        if not width or not height:
            raise TiffError("a page without size")
        per, bits = one(277, 1), one(258, 1)
        compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
        if bits not in (1, 2, 4, 8, 16, 32, 64):
            raise TiffError(f"{bits} bits a sample")
        if any(b != bits for b in fields.get(258, ())):
            raise TiffError("samples of different depth")
        turned = one(266, 1) == 2
        deep, planes = (per, 1) if planar == 1 else (1, per)
        tiled = 322 in fields
        bw, bh = (one(322), one(323)) if tiled else (width, min(one(278, height) or height, height))
        at, sizes = (fields.get(324), fields.get(325)) if tiled else (fields.get(273), fields.get(279))
        if not at or not sizes or not bw or not bh:
            raise TiffError("a page without data")
        across, down = -(-width // bw), -(-height // bh)
        if len(at) < across * down * planes or len(sizes) < len(at):
            raise TiffError("too few strips or tiles")
        line = -(-width * deep * bits // 8)
        block_line = -(-bw * deep * bits // 8)
        parts = []
        for p in range(planes):
            plane = np.zeros((height, line), np.uint8)
            for k in range(across * down):
                i = p * across * down + k
                raw = self.data[at[i] : at[i] + sizes[i]]
                raw = _expand(raw.translate(MIRROR) if turned else raw, compression)
                y, x = k // across * bh, k % across * bw
                rows = bh if tiled else min(bh, height - y)
                if len(raw) < rows * block_line:
                    raise TiffError("a strip or tile is too short")
                block = self._undo(np.frombuffer(raw, np.uint8, rows * block_line).reshape(rows, block_line), predictor, bits, deep)
                left = x * deep * bits // 8
                take = min(block_line, line - left)
                plane[y : y + rows, left : left + take] = block[: height - y, :take]
            parts.append(plane.tobytes())
        return {"width": width, "height": height, "samples": per, "bits": bits, "compression": compression, "predictor": predictor, "pixels": b"".join(parts)}

    def _undo(self, rows: np.ndarray, predictor: int, bits: int, deep: int) -> np.ndarray:
        """Rows without the predictor; samples of several bytes in little-endian order."""
        size = bits // 8
        if predictor == 3:
            if size not in (2, 4, 8):
                raise TiffError("a float predictor on whole samples")
            sums = np.add.accumulate(rows.reshape(len(rows), -1, deep), axis=1, dtype=np.uint8).reshape(len(rows), size, -1)
            return np.ascontiguousarray(sums[:, ::-1, :].transpose(0, 2, 1)).reshape(len(rows), -1)
        if size > 1:
            rows = rows.view(np.dtype(f"{self.order}u{size}")).astype(f"<u{size}")
        if predictor == 2:
            if not size:
                raise TiffError("a predictor on samples below a byte")
            rows = np.add.accumulate(rows.reshape(len(rows), -1, deep), axis=1, dtype=rows.dtype).reshape(len(rows), -1)
        elif predictor != 1:
            raise TiffError(f"predictor {predictor} is not known")
        return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)


def read_pages(data: bytes) -> list[dict]:
    """All pages of a file; one that is broken is an error."""
    reader = Reader(data)
    return [reader.page(f) for f in reader.directories()]


_BROKEN = (TiffError, zlib.error, ValueError, OverflowError, MemoryError)


def told_pages(data: bytes) -> list[dict]:
    """Pages with page_no and error: a broken page tells its own, a broken file or directory ends the list."""
    out: list[dict] = []
    try:
        reader = Reader(data)
        for k, fields in enumerate(reader.directories()):
            try:
                out.append(reader.page(fields) | {"page_no": k, "error": None})
            except _BROKEN as e:
                out.append({"page_no": k, "error": str(e) or type(e).__name__})
    except _BROKEN as e:
        out.append({"page_no": None, "error": str(e) or type(e).__name__})
    return out or [{"page_no": None, "error": "no page"}]


def write_page(pixels: bytes, width: int, strip_rows: int = 1024, level: int = 1) -> bytes:
    """A one-page file of 8-bit grey samples: deflate strips, horizontal predictor."""
    rows = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    height = len(rows)
    steps = rows.copy()
    steps[:, 1:] -= rows[:, :-1]
    strips = [zlib.compress(steps[y : y + strip_rows].tobytes(), level) for y in range(0, height, strip_rows)]
    n = len(strips)
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [DEFLATE]), (262, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 4, [strip_rows]), (279, 4, [len(s) for s in strips]), (317, 3, [2])]
    at = 8 + 2 + 12 * len(fields) + 4
    tables = 4 * n if n > 1 else 0
    spots = np.cumsum([at + 2 * tables, *map(len, strips)])[:-1].tolist()
    head, rest = b"II*\0" + struct.pack("<IH", 8, len(fields)), b""
    for tag, kind, values in fields:
        values = spots if values is None else values
        body = struct.pack(f"<{len(values)}{TYPE_CODE[kind]}", *values)
        if len(body) > 4:
            head += struct.pack("<HHII", tag, kind, len(values), at + len(rest))
            rest += body
        else:
            head += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + rest + b"".join(strips)


PAGE_FIELDS = [("page_no", T.IntegerType()), ("width", T.LongType()), ("height", T.LongType()), ("samples", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.IntegerType()), ("predictor", T.IntegerType()), ("pixels", T.BinaryType()), ("error", T.StringType())]


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each page of each file: the other columns and the page's own.

    A broken page is a row with its page_no and the error; a null, empty or broken file,
    or one whose chain of directories breaks off, has a row with page_no null and the
    error.  Repeated rows are read alike; an empty table is fine; a very large file is
    held by one worker.  Own columns with a page column's name are replaced.
    """
    bound_batches(df.sparkSession)
    names = [n for n, _ in PAGE_FIELDS]
    kept = [c for c in df.columns if c not in names]
    source = df.select(*kept)
    schema = T.StructType([f for f in source.schema.fields if f.name != media_col] + [T.StructField(n, t) for n, t in PAGE_FIELDS])

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(media_col).to_pylist()):
                pages = told_pages(data or b"")
                own = [c.slice(i, 1).take(pa.array([0] * len(pages))) for c, n in zip(batch.columns, batch.schema.names) if n != media_col]
                cols = [pa.array([p.get(n) for p in pages], pa.binary() if n == "pixels" else pa.string() if n == "error" else pa.int64() if n in ("width", "height") else pa.int32()) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *cols], schema.names)

    return source.mapInArrow(run, schema)


#: Width of the pages that keep texts.
PAGE_WIDTH = 64


def _store(batches):
    for batch in batches:
        n, media = [], []
        for text in batch.column("text").to_pylist():
            raw = text or b""
            n.append(len(raw))
            whole = max(1, -(-len(raw) // PAGE_WIDTH)) * PAGE_WIDTH
            media.append(write_page(raw.ljust(whole, b"\0"), PAGE_WIDTH))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled up with zeros, as a page."""
    bound_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_store, f"doc_id {id_type}, n_bytes long, media binary")


def _digest(batches):
    for batch in batches:
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in batch.column("media").to_pylist():
            pages = read_pages(data)
            payload = b"".join(p["pixels"] for p in pages)
            values = np.frombuffer(payload, np.uint8)
            first = pages[0]
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(f"pages={len(pages)};size={first['width']}x{first['height']};compression={first['compression']};predictor={first['predictor']};sum={int(values.sum(dtype=np.int64))};zeros={int((values == 0).sum())};levels={len(np.flatnonzero(np.bincount(values, minlength=256)))}")
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(v, t) for v, t in zip(out.values(), types)]], ["doc_id", "n_bytes", *out])


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as TIFF pages, read back and described."""
    stored = store_texts(table(spark, sf_dir, "documents"))
    id_type = dict(stored.dtypes)["doc_id"]
    return stored.mapInArrow(_digest, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
