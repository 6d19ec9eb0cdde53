"""Image work: decoded images to tensors, and training-only augmentation.

Decoding is the JVM's (the `image` source: bmp, gif, jpeg, png, tiff, wbmp), the
rest numpy on Arrow batches.  Images are turned as their Exif marks ask.  WebP
files count as readable if their container is sound, but nothing here decodes
their pixels, so they give no tensors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.containers import HEAD, jpeg_turn, webp_size
from ..functions.paths import has_suffix

SIZE = (224, 224)
#: Rows of so many floats fill Arrow batches fast.
ROWS_AT_ONCE = 64


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width, channels, data of every image; undecodable ones have height -1."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    # a plus sign is itself in a path
    return found.select(F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B"))).alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def turns(contents: DataFrame) -> DataFrame:
    """path and turn, the Exif orientation, of rows of path and content, where it is not 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            turn = np.array([jpeg_turn(c) for c in pdf["head"]], np.int32)
            yield pd.DataFrame({"path": pdf["path"].to_numpy(), "turn": turn})[turn != 1]

    heads = contents.where(has_suffix(F.col("path"), (".jpg", ".jpeg"))).select("path", F.substring("content", 1, HEAD).alias("head"))
    return heads.mapInPandas(run, "path string, turn int")


def sound_webp(contents: DataFrame) -> DataFrame:
    """path of the .webp files, of rows of path and content, whose container is sound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[min(webp_size(c) or (0,)) > 0 for c in pdf["content"]], ["path"]]

    return contents.where(has_suffix(F.col("path"), (".webp",))).select("path", "content").mapInPandas(run, "path string")


def readable(height, width):
    """At least one pixel; what could not be decoded has none."""
    return F.coalesce((height > 0) & (width > 0), F.lit(False))


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """float32 (height, width, 3), 0 to 255, from interleaved BGR, BGRA or grey bytes."""
    if height < 1 or width < 1:
        raise ValueError(f"an image of {width} x {height}")
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return (np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]).astype(np.float32)


def turned(x: np.ndarray, turn: int) -> np.ndarray:
    """The image as an orientation of 1 to 8 wants it shown."""
    if turn in (5, 6, 7, 8):
        x = x.transpose(1, 0, 2)
    if turn in (2, 3, 6, 7):
        x = x[:, ::-1]
    if turn in (3, 4, 7, 8):
        x = x[::-1]
    return x


def rescaled(x: np.ndarray) -> np.ndarray:
    """0 to 255 becomes 0 to 1."""
    return np.asarray(x, np.float32) * np.float32(1 / 255)


def centred(x: np.ndarray) -> np.ndarray:
    """0 to 255 becomes -1 to 1."""
    return np.asarray(x, np.float32) / np.float32(127.5) - np.float32(1)


def decode(spark: SparkSession, content: bytes) -> np.ndarray:
    """One image as RGB, turned; ValueError if the JVM cannot decode it."""
    schema = getattr(getattr(spark._jvm.org.apache.spark.ml.image, "ImageSchema$"), "MODULE$")
    row = schema.decode("image", bytearray(content))
    if row.isEmpty():
        raise ValueError("not an image that can be decoded")
    image = row.get().getStruct(0)
    height, width, channels = (image.getInt(k) for k in (1, 2, 3))
    return turned(to_rgb(bytes(image.getAs(5)), height, width, channels), jpeg_turn(content))


def resized(x: np.ndarray, size: tuple[int, int] = SIZE) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    def places(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    a, b, v = places(x.shape[0], size[0])
    c, d, h = places(x.shape[1], size[1])
    rows = x[a] * (1 - v)[:, None, None] + x[b] * v[:, None, None]
    return rows[:, c] * (1 - h)[:, None] + rows[:, d] * h[:, None]


def tensors(pictures: DataFrame, size: tuple[int, int] = SIZE) -> DataFrame:
    """path and pixels (float array of height * width * 3) of the readable images, turned where pictures have a column turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[k : k + ROWS_AT_ONCE]
                pixels = [resized(turned(to_rgb(d, h, w, c), t), size).ravel() for d, h, w, c, t in zip(part["data"], part["height"], part["width"], part["nChannels"], part["turn"], strict=True)]
                yield pd.DataFrame({"path": part["path"].to_numpy(), "pixels": pixels})

    turn = F.coalesce("turn", F.lit(1)) if "turn" in pictures.columns else F.lit(1)
    return pictures.where(readable(F.col("height"), F.col("width"))).select("path", "height", "width", "nChannels", "data", turn.alias("turn")).mapInPandas(run, "path string, pixels array<float>")


@dataclass(frozen=True)
class Augmentation:
    """Random mirror, turn (share of a full turn either way), zoom (share either way) and contrast."""

    flip: bool = True
    rotation: float = 0.05
    zoom: float = 0.10
    contrast: float = 0.0


# The two settings in use.
NOTEBOOK, TRAINER = Augmentation(), Augmentation(rotation=0.08, contrast=0.10)


def augmented(x: np.ndarray, how: Augmentation, rng: np.random.Generator) -> np.ndarray:
    """One image, changed; nearest pixels, edges repeated by reflection."""
    height, width = x.shape[:2]
    angle = rng.uniform(-how.rotation, how.rotation) * 2 * np.pi
    scale = 1 + rng.uniform(-how.zoom, how.zoom)
    r, c = np.mgrid[:height, :width].astype(float)
    r, c = (r - (height - 1) / 2) * scale, (c - (width - 1) / 2) * scale
    rows = np.rint(np.cos(angle) * r - np.sin(angle) * c + (height - 1) / 2).astype(int)
    cols = np.rint(np.sin(angle) * r + np.cos(angle) * c + (width - 1) / 2).astype(int)
    reflect = lambda v, n: np.where((v := v % (2 * n)) < n, v, 2 * n - 1 - v)
    out = x[reflect(rows, height), reflect(cols, width)]
    if how.flip and rng.random() < 0.5:
        out = out[:, ::-1]
    if how.contrast:
        mean = out.mean((0, 1), keepdims=True)
        out = np.clip((out - mean) * (1 + rng.uniform(-how.contrast, how.contrast)) + mean, 0, 255)
    return np.ascontiguousarray(out, np.float32)


def augment(rows: DataFrame, how: Augmentation = NOTEBOOK, size: tuple[int, int] = SIZE, seed: int = 42) -> DataFrame:
    """rows (path, split, pixels) with the train split changed at random and all others as they are.

    What happens to an image depends on seed and path alone, so a task that runs
    again does the same, and scoring never sees a changed image.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pixels = []
            for path, v in zip(pdf["path"], pdf["pixels"], strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(path.encode())])
                pixels.append(augmented(np.asarray(v, np.float32).reshape(*size, 3), how, rng).ravel())
            yield pdf.assign(pixels=pixels)

    train = rows.where("split = 'train'").select("path", "split", "pixels").mapInPandas(run, "path string, split string, pixels array<float>")
    return train.unionByName(rows.where("split <> 'train'").select("path", "split", "pixels"))
