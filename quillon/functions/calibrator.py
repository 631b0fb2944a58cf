"""Binary calibration: thresholds from medians, and their sidecar file."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.kernels import BITS, binary_words
from quillon.operators import quantiles
from quillon.sources import files


@dataclass(frozen=True)
class Calibrator:
    """48 thresholds, and a 48 x 48 rotation that token rows are multiplied by first, or None."""

    thresholds: tuple[float, ...]
    rotation: tuple[tuple[float, ...], ...] | None = None

    def __post_init__(self) -> None:
        if len(self.thresholds) != BITS:
            raise ValueError(f"expected {BITS}-dim token vectors, got {len(self.thresholds)}")
        if self.rotation is not None and (len(self.rotation) != BITS or any(len(r) != BITS for r in self.rotation)):
            raise ValueError(f"rotation matrix shape mismatch: expected {(BITS, BITS)}")

    def words(self, tokens: Column | str) -> Column:
        return binary_words(tokens, self.thresholds, self.rotation)

    def encode(self, vectors: list[list[float]]) -> list[int]:
        """The words of a query on the driver."""
        rows = np.zeros((len(vectors), BITS), np.float32)
        for k, v in enumerate(vectors):
            if len(v) > BITS:
                raise ValueError(f"token vectors must have at most {BITS} dimensions")
            rows[k, : len(v)] = v
        if self.rotation is not None:
            rows = rows @ np.array(self.rotation, np.float32)
        bits = rows > np.array(self.thresholds, np.float32)
        return [int(sum(1 << i for i in np.flatnonzero(b).tolist())) for b in bits]

    def checksum(self, encoder_id: str) -> str:
        digest = hashlib.sha256(encoder_id.encode())
        for part in (self.thresholds, self.rotation):
            if part is not None:
                digest.update(np.array(part, np.float32).tobytes())
        return digest.hexdigest()

    def save(self, path: str | Path, *, encoder_id: str) -> None:
        """A JSON sidecar with a checksum over encoder and values."""
        files.write_text(path, json.dumps({"encoder_id": encoder_id, "thresholds": self.thresholds, "rotation": self.rotation, "checksum": self.checksum(encoder_id)}))

    @classmethod
    def load(cls, path: str | Path, *, encoder_id: str | None = None) -> Calibrator:
        """Read a sidecar; another encoder than the one asked for and changed values raise."""
        found = json.loads(files.read_text(path))
        rotation = tuple(map(tuple, found["rotation"])) if found.get("rotation") else None
        own = cls(tuple(found["thresholds"]), rotation)
        if encoder_id is not None and found["encoder_id"] != encoder_id:
            raise ValueError(f"encoder_id mismatch: stored={found['encoder_id']!r} expected={encoder_id!r}")
        if found["checksum"] != (wanted := own.checksum(found["encoder_id"])):
            raise ValueError(f"calibrator checksum mismatch: stored={found['checksum']!r} expected={wanted!r}")
        return own


def thresholds(vectors: DataFrame, column: str) -> DataFrame:
    """(dim, threshold): the exact median of each of the first 48 dimensions, as FLOAT. One vector a row."""
    each = vectors.select(F.posexplode(F.slice(column, 1, BITS)).alias("dim", "x"))
    found = quantiles.exact(each, "dim", "x", (0.5,))
    return vectors.sparkSession.createDataFrame([(dim, float(np.float32(x))) for (dim, _), x in sorted(found.items())], "dim int, threshold float")


def fit(vectors: DataFrame, column: str) -> Calibrator:
    """Medians of each dimension over all vectors; vectors of fewer dimensions are padded with zeros."""
    rows = thresholds(vectors.select(F.concat(F.col(column).cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(BITS) - F.size(column), F.lit(0)))).alias("v")), "v").collect()
    if len(rows) != BITS:
        raise ValueError(f"expected {BITS}-dim token vectors, got {len(rows)}")
    return Calibrator(tuple(r["threshold"] for r in sorted(rows)))
