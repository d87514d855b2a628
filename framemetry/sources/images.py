"""Picture folders to frames.

Gray files of 8 and 16 bits are read by ``binaryFile`` with a small decoder, other kinds by Spark's ``image``
source, which would cut 16 bits to 8. Unreadable files land in the rejects with a reason instead of
failing the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from framemetry.functions.scalars import first_folder, relative_path
from framemetry.operators.checks import assert_nonempty
from framemetry.schemas import FRAMES
from framemetry.session import pickled_by_value, written

pickled_by_value(__name__)

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # PNG colour type -> samples per pixel


def scan_frames(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, rel_path, content) of all PNG files below ``root``; an empty folder is an error.

    A path-sorted list is not produced: order is a property of output, see ``ordered_paths``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.png")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    assert_nonempty(files.select("path"), f"PNG files under {root}")
    return files.select("path", relative_path("path", resolved(spark, root)).alias("rel_path"), "content")


def resolved(spark: SparkSession, root: str) -> str:
    """``root`` as the file system names it: relative folders become absolute."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_files(files: DataFrame, root: str) -> int:
    """(rel_path, content) as files below ``root``; returns how many. Names are given, so a repeated task writes the
    same files again."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{base}/{name}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("rel_path", "content").mapInArrow(store, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_frame_files(frames: DataFrame, root: str, depth: int = 8) -> int:
    """Frames (rel_path, h, w, pixels in [0, 1]) as PNG files below ``root``; returns how many."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 2**depth - 1
        for batch in batches:
            content = []
            for h, w, pixels in zip(*[batch.column(i).to_pylist() for i in (1, 2)], batch.column(3)):
                samples = np.rint(pixels.values.to_numpy() * top).reshape(h, w)
                content.append(encode_gray_png(samples, depth))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["rel_path", "content"])

    rows = frames.select("rel_path", "h", "w", "pixels")
    return write_files(rows.mapInArrow(encode, "rel_path string, content binary"), root)


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row prediction of a stack of pictures of one size; bytes wrap around at 256.

    A sample depends on those to its left, above and above left, so all samples of an anti-diagonal are
    known at once, over all rows and pictures; rows of simple prediction only need no diagonals.
    """
    n, rows, stride = lines.shape[0], lines.shape[1], lines.shape[2] - 1
    kinds, width = lines[:, :, 0], stride // bpp
    if kinds.size and kinds.max() > 4:
        raise ValueError(f"unknown row filter {kinds.max()}")
    samples = lines[:, :, 1:].reshape(n, rows, width, bpp)
    out = np.zeros((n, rows + 1, width + 1, bpp), np.int16)
    if not kinds.size or kinds.max() <= 2:
        for y in range(rows):
            kind = kinds[:, y, None, None]
            left = np.cumsum(samples[:, y], axis=1, dtype=np.uint8)
            line = np.where(kind == 1, left, samples[:, y]).astype(np.int16)
            out[:, y + 1, 1:] = (line + np.where(kind == 2, out[:, y, 1:], 0)) & 255
        return out[:, 1:, 1:].astype(np.uint8).reshape(n, rows, stride)
    for t in range(rows + width - 1):
        y = np.arange(max(0, t - width + 1), min(rows, t + 1))
        x = t - y
        kind = kinds[:, y, None]
        left, up, corner = out[:, y + 1, x], out[:, y, x + 1], out[:, y, x]
        p = left + up - corner
        to_left, to_up, to_corner = abs(p - left), abs(p - up), abs(p - corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[:, y + 1, x + 1] = (samples[:, y, x] + guess) & 255
    return out[:, 1:, 1:].astype(np.uint8).reshape(n, rows, stride)


def png_header(content: bytes) -> tuple[int, int, int, int]:
    """(height, width, bit depth, colour type) of a picture this module decodes, from its first 29 bytes."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    if len(content) < 29 or content[12:16] != b"IHDR":
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", content[16:29])
    if interlace or colour not in CHANNELS or depth not in (8, 16):
        raise ValueError(f"unsupported: depth {depth}, colour type {colour}, interlace {interlace}")
    if depth == 16 and colour != 0:
        raise ValueError("unsupported: 16-bit colour")
    return h, w, depth, colour


def _png_lines(content: bytes) -> tuple[tuple[int, int, int, int], np.ndarray]:
    """The header and the predicted rows."""
    header = h, w, depth, colour = png_header(content)
    at, data = 8, []
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IDAT":
            data.append(content[at + 8 : at + 8 + size])
        elif kind == b"IEND":
            break
        at += 12 + size
    wanted = h * (1 + w * CHANNELS[colour] * depth // 8)
    raw = zlib.decompressobj().decompress(b"".join(data), wanted + 1)
    if len(raw) != wanted:
        raise ValueError("wrong amount of data")
    return header, np.frombuffer(raw, np.uint8).reshape(h, -1)


def decode_pngs(contents: list[bytes]) -> list[tuple[int, int, int, np.ndarray] | str]:
    """(height, width, bit depth, integer samples) of each picture, or why it is rejected. Colour is reduced to
    8-bit luminance. Pictures of one size and kind are decoded as a stack."""
    out: list = [None] * len(contents)
    stacks: dict[tuple, list[tuple[int, np.ndarray]]] = {}
    for i, content in enumerate(contents):
        try:
            header, lines = _png_lines(content)
            if lines.shape[0] and lines[:, 0].max() > 4:
                raise ValueError(f"unknown row filter {lines[:, 0].max()}")
            stacks.setdefault(header, []).append((i, lines))
        except (ValueError, zlib.error, struct.error) as problem:
            out[i] = str(problem)
    for (h, w, depth, colour), members in stacks.items():
        channels = CHANNELS[colour]
        flat = _unfilter(np.stack([m for _, m in members]), channels * depth // 8)
        for (i, _), rows in zip(members, flat):
            if depth == 16:
                out[i] = h, w, 16, rows.reshape(-1).view(">u2").astype(np.int64)
                continue
            px = rows.reshape(h * w, channels).astype(np.int64)
            if channels > 2:
                # luminance weights in 16-bit fixed point (fixed values)
                px = ((px[:, 0] * 19595 + px[:, 1] * 38470 + px[:, 2] * 7471 + 32768) >> 16)[:, None]
            out[i] = h, w, 8, px[:, 0]
    return out


def decode_png(content: bytes) -> tuple[int, int, int, np.ndarray]:
    """One picture of ``decode_pngs``; one that is rejected fails."""
    found = decode_pngs([content])[0]
    if isinstance(found, str):
        raise ValueError(found)
    return found


def unit_pixels(samples: np.ndarray, depth: int) -> np.ndarray:
    """Samples clipped to [0, 1]: of 16 bits over 65535, of 8 over 255."""
    return np.clip(samples / (65535.0 if depth == 16 else 255.0), 0.0, 1.0).astype(np.float32)


def encode_gray_png(samples: np.ndarray, depth: int = 8) -> bytes:
    """A gray PNG without row prediction, for fixtures and round trips."""
    h, w = samples.shape
    body = samples.astype(">u2" if depth == 16 else np.uint8).reshape(h, -1).view(np.uint8)
    lines = np.hstack([np.zeros((h, 1), np.uint8), body.reshape(h, -1)]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        crc = zlib.crc32(kind + data)
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc)

    head = struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


DECODED = "rel_path STRING, h INT, w INT, bit_depth INT, pixels ARRAY<FLOAT>, reason STRING"


def _framed(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        F.xxhash64("rel_path").alias("frame_id"), "rel_path",
        first_folder("rel_path").alias("grp"), "h", "w", "bit_depth", "pixels", "reason",
    )


def ingest_frames(files: DataFrame) -> DataFrame:
    """(rel_path, content) to frames plus ``reason``, NULL for decoded files.

    Pixels are clipped to [0, 1]: 16-bit samples over 65535, all others over 255. ``frame_id`` is a
    hash of the path for sorting and seeding; ``rel_path`` is the key. For folders of any kind of PNG
    use ``ingest_folder``.
    """

    return _framed(files.select("rel_path", "content").mapInPandas(_decode, DECODED))


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(rel_path, content, ...) to the columns of DECODED and the further ones."""
    for batch in batches:
        rows = []
        for path, found in zip(batch["rel_path"], decode_pngs([bytes(c) for c in batch["content"]])):
            if isinstance(found, str):
                rows.append((path, None, None, None, None, found))
            else:
                h, w, depth, samples = found
                rows.append((path, h, w, depth, unit_pixels(samples, depth), None))
        out = pd.DataFrame(
            rows, columns=["rel_path", "h", "w", "bit_depth", "pixels", "reason"]
        )
        for c in ("h", "w", "bit_depth"):
            out[c] = out[c].astype("Int32")
        for c in batch.columns[2:]:
            out[c] = batch[c].to_numpy()
        yield out


def ingest_folder(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """All PNG files below ``root`` as frames, in the columns of ``ingest_frames``.

    Gray files of 8 and 16 bits, known by their headers, are decoded here from the ``binaryFile`` scan, each opened
    once. Other kinds (palette, interlaced, fewer bits, colour, transparent or with a colour profile), and 8-bit files that
    cannot be decoded here, are left to Spark's ``image`` source, which gives 8-bit samples that are reduced to luminance
    and would cut 16-bit gray to 8 bits. It reads a folder whole, so it is asked only if there are such files. Unreadable
    files are rejects.
    """
    files = scan_frames(spark, root, recursive)
    # bytes 25, 26 and 29 of a PNG: bit depth, colour type 0 for gray, interlaced or not
    depth, colour, interlace = (F.hex(F.substring("content", at, 1)) for at in (25, 26, 29))
    marked = F.contains("content", F.lit(b"tRNS")) | F.contains("content", F.lit(b"iCCP"))
    deep = (depth == "10") & (colour == "00")
    here = deep | ((depth == "08") & (colour == "00") & (interlace == "00") & ~marked)
    content = F.when(here, F.col("content")).otherwise(F.lit(b""))
    # decoded once and written, so that their names need no second read
    seen = written(files.select("rel_path", content.alias("content"), deep.alias("deep")).mapInPandas(_decode, f"{DECODED}, deep BOOLEAN"), "gray")
    done = seen.where("reason IS NULL OR deep").drop("deep")
    if seen.where("reason IS NOT NULL AND NOT deep").isEmpty():
        return _framed(done)
    pictures = (
        spark.read.format("image")
        .option("pathGlobFilter", "*.png")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("dropInvalid", "false")
        .load(root)
        .select(relative_path("image.origin", resolved(spark, root)).alias("rel_path"), "image.*")
    )
    rest = pictures.join(done.select("rel_path"), "rel_path", "left_anti")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, h, w, n, data in zip(*[batch[c] for c in ("rel_path", "height", "width", "nChannels", "data")]):
                if h <= 0:
                    rows.append((path, None, None, None, None, "not a readable picture"))
                    continue
                px = np.frombuffer(data, np.uint8).reshape(-1, n).astype(np.int64)
                if n > 1:  # blue, green, red; luminance weights as in decode_png
                    px = (px[:, 2] * 19595 + px[:, 1] * 38470 + px[:, 0] * 7471 + 32768) >> 16
                rows.append((path, h, w, 8, (px.ravel() / 255.0).astype(np.float32), None))
            out = pd.DataFrame(rows, columns=["rel_path", "h", "w", "bit_depth", "pixels", "reason"])
            for c in ("h", "w", "bit_depth"):
                out[c] = out[c].astype("Int32")
            yield out

    slim = rest.select("rel_path", "height", "width", "nChannels", "data")
    return _framed(done.unionByName(slim.mapInPandas(reduce, DECODED)))


def decoded_frames(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNull()).drop("reason")


def rejected_files(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull()).select("rel_path", "reason")


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as Parquet, one folder per group, so that holding a folder out prunes files.

    ``rebalance`` evens out file sizes: a folder with most of the frames is split over many tasks
    instead of being written by one.
    """
    frames.hint("rebalance", "grp").write.mode("overwrite").partitionBy("grp").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)
