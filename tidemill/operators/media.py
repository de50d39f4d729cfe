"""Frames: bilinear resizing as expressions, composed transforms and their shapes, a hook for decoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _samples(old: int, new: int) -> list[tuple[int, int, float]]:
    """(left, right, weight of the right one) of each new place along one side, by the centres of pixels."""
    out = []
    for i in range(new):
        x = min(max((i + 0.5) * old / new - 0.5, 0.0), old - 1.0)
        left = int(x)
        out.append((left, min(left + 1, old - 1), x - left))
    return out


@dataclass(frozen=True)
class Resize:
    """Bilinear resizing of one channel in row order; frames that have the size already stay as they are."""

    height: int
    width: int

    def shape(self, old: tuple[int, int]) -> tuple[int, int]:
        return self.height, self.width

    def apply(self, pixels: Column, old: tuple[int, int]) -> Column:
        if old == (self.height, self.width):
            return pixels
        rows, cols = _samples(old[0], self.height), _samples(old[1], self.width)
        corners = [[(r * old[1] + c, w * v) for r, w in ((a, 1 - p), (b, p)) for c, v in ((x, 1 - q), (y, q))] for a, b, p in rows for x, y, q in cols]
        cells = F.array(*[F.struct(*[F.struct(F.lit(i).alias("at"), F.lit(float(w)).alias("w")).alias(f"c{k}") for k, (i, w) in enumerate(cell)]) for cell in corners])
        one = lambda s, k: F.get(pixels, s[f"c{k}"]["at"]).cast("double") * s[f"c{k}"]["w"]
        return F.transform(cells, lambda s: one(s, 0) + one(s, 1) + one(s, 2) + one(s, 3))


@dataclass(frozen=True)
class Compose:
    """Transforms one after another."""

    steps: tuple

    def __post_init__(self) -> None:
        if not self.steps:
            raise ValueError("nothing to compose")

    def shape(self, old: tuple[int, int]) -> tuple[int, int]:
        for s in self.steps:
            old = s.shape(old)
        return old

    def apply(self, pixels: Column, old: tuple[int, int]) -> Column:
        for s in self.steps:
            pixels, old = s.apply(pixels, old), s.shape(old)
        return pixels


def decoded(files: DataFrame, decoder: Callable[[bytes], tuple[Sequence[int], bytes]], most_failures: int = 50) -> DataFrame:
    """(path, shape, pixels, error) of binary files (path, content), by a decoder of one's own; it returns a shape and the bytes of uint8 pixels.

    A file that it fails on has an error instead; more than `most_failures` of them one after another in a task fail the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in batches:
            shapes, pixels, errors = [], [], []
            for content in b.column(1).to_pylist():
                try:
                    shape, data = decoder(content)
                    shapes.append(list(shape)), pixels.append(bytes(data)), errors.append(None)
                    row = 0
                except Exception as e:
                    row += 1
                    if row > most_failures:
                        raise RuntimeError(f"{row} files in a row can't be decoded") from e
                    shapes.append(None), pixels.append(None), errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shapes, pa.list_(pa.int32())), pa.array(pixels, pa.binary()), pa.array(errors, pa.string())], ["path", "shape", "pixels", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, shape array<int>, pixels binary, error string")
