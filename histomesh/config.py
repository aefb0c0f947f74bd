"""Settings of a dataset, with their checks."""

from __future__ import annotations

from dataclasses import dataclass

#: Parquet codecs that stand for the array codecs of the settings.
CODECS = {"zstd": "zstd", "lz4": "lz4", "blosclz": "snappy"}


@dataclass(frozen=True)
class DatasetConfig:
    root: str
    tile_size: float = 512.0
    tile_overlap: float = 50.0
    rows_per_file: int = 2_000_000
    compression: str = "zstd"

    def __post_init__(self):
        if self.tile_size <= 0 or not 0 <= self.tile_overlap < self.tile_size:
            raise ValueError("tile_size must be positive, tile_overlap at least 0 and below it")
        if self.rows_per_file <= 0:
            raise ValueError("rows_per_file must be positive")
        if self.compression not in CODECS:
            raise ValueError(f"compression must be one of {sorted(CODECS)}")

    @property
    def codec(self) -> str:
        return CODECS[self.compression]
