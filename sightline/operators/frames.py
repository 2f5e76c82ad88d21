"""Pictures as rows of pixel bytes: put together from pixel rows, resampled to a frame's size, normalised for a model.

A picture is a row (picture_id, width, height, pixels), pixels being 8-bit red, green and blue, row by row. Pictures of one
size in a batch are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def assemble(px: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Pictures of pixel rows (key, px_x, px_y, r, g, b); a pixel that is missing is black, of several the greatest counts, and
    those beyond the size are left out. A picture is one group of width * height pixels at most."""
    inside = px.where(F.col("px_x").between(0, width - 1) & F.col("px_y").between(0, height - 1))
    one = inside.groupBy(key, (F.col("px_y") * width + F.col("px_x")).alias("at")).agg(F.max(F.struct("r", "g", "b")).alias("c"))
    cells = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("cells"))
    channel = lambda c: F.lpad(F.hex(F.coalesce(c, F.lit(0)).cast("long")), 2, "0")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.concat(*(channel(F.try_element_at("cells", i)[k]) for k in "rgb"))), "")
    return cells.select(F.col(key).alias("picture_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.unhex(text).alias("pixels"))


def _weights(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every new place the two old ones and the second one's share; places are the middles of pixels."""
    at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, size - 1), at - low


def bilinear(pictures: np.ndarray, width: int, height: int) -> np.ndarray:
    """(n, h, w, 3) bytes as (n, height, width, 3) bytes; halves are rounded up."""
    x0, x1, fx = _weights(pictures.shape[2], width)
    y0, y1, fy = _weights(pictures.shape[1], height)
    fx, fy = fx[None, None, :, None], fy[None, :, None, None]
    p = pictures.astype(np.float64)
    top = p[:, y0][:, :, x0] * (1 - fx) + p[:, y0][:, :, x1] * fx
    low = p[:, y1][:, :, x0] * (1 - fx) + p[:, y1][:, :, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def cover(pictures: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled until they cover the frame, cut around the middle, black where a rounded size falls short."""
    h, w = pictures.shape[1:3]
    scale = max(width / w, height / h)
    new_w, new_h = max(1, int(w * scale)), max(1, int(h * scale))
    made = bilinear(pictures, new_w, new_h)
    x, y = max(0, (new_w - width) // 2), max(0, (new_h - height) // 2)
    cut = made[:, y : y + height, x : x + width]
    out = np.zeros((len(pictures), height, width, 3), np.uint8)
    dx, dy = (width - cut.shape[2]) // 2, (height - cut.shape[1]) // 2
    out[:, dy : dy + cut.shape[1], dx : dx + cut.shape[2]] = cut
    return out


def resample(pictures: DataFrame, width: int, height: int, mean: tuple[float, ...] | None = None, std: tuple[float, ...] | None = None, divide_all: bool = False) -> DataFrame:
    """picture_id, width, height, pixels of the pictures as frames of one size; with mean and std also values, floats for a model:
    the channel's share of 255 less mean / std (as existing models were fed; with divide_all the difference is divided).

    A null, an empty picture and one whose bytes don't fit its size give a black frame."""
    schema = T.StructType([pictures.schema["picture_id"], *T.StructType.fromDDL("width int, height int, pixels binary").fields])
    if mean is not None:
        schema.add("values", T.ArrayType(T.FloatType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = list(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True))
            raw = batch.column("pixels").to_pylist()
            out = np.zeros((batch.num_rows, height, width, 3), np.uint8)
            groups: dict[tuple[int, int], list[int]] = {}
            for i, (size, b) in enumerate(zip(sizes, raw, strict=True)):
                if b and None not in size and len(b) == 3 * size[0] * size[1]:
                    groups.setdefault(size, []).append(i)
            for (w, h), which in groups.items():
                stack = np.frombuffer(b"".join(raw[i] for i in which), np.uint8).reshape(-1, h, w, 3)
                out[which] = cover(stack, width, height)
            n = batch.num_rows
            columns = [batch.column("picture_id"), pa.array(np.full(n, width), pa.int32()), pa.array(np.full(n, height), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())]
            if mean is not None:
                share, m, s = out / 255.0, np.array(mean), np.array(std)
                values = (share - m) / s if divide_all else share - m / s
                columns.append(pa.array(list(values.reshape(n, -1).astype(np.float32)), pa.list_(pa.float32())).cast(arrow.field("values").type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pictures.select("picture_id", "width", "height", "pixels").mapInArrow(run, schema)
