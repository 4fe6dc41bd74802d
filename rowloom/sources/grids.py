"""Run grids: which configurations a sweep tries, and the published grids."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

CONFIG_SCHEMA = "replicate int, batch_size int, learning_rate double, latent_dim int, method string"


@dataclass(frozen=True)
class RunGrid:
    batch_sizes: tuple[int, ...]
    learning_rates: tuple[float, ...]
    latent_dims: tuple[int, ...]
    methods: tuple[str, ...]
    replicates: int = 5
    epochs: int = 100
    hidden: int = 128
    phi: tuple[int, ...] = (128, 128)

    def configurations(self) -> list[tuple]:
        """Every (replicate, batch size, learning rate, latent width, method)."""
        return list(itertools.product(range(self.replicates), self.batch_sizes, self.learning_rates, self.latent_dims, self.methods))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.configurations(), CONFIG_SCHEMA)

    def __len__(self) -> int:
        return len(self.configurations())


# The published grids.
ALL_METHODS = ("CONTROL", "SCARF", "SUBTAB", "CLIP", "GMC", "MCN", "ANCHOR")
WIDE_METHODS = ("CONTROL", "SCARF", "SUBTAB", "GMC", "ANCHOR")
ELEVEN_RATES = (0.0001, 0.0002, 0.0003, 0.0005, 0.0007, 0.001, 0.002, 0.003, 0.005, 0.007, 0.01)
NINE_RATES = (
    0.0001, 0.0001778279410038, 0.0003162277660168, 0.0005623413251903, 0.001, 0.0017782794100389, 0.0031622776601683,
    0.0056234132519034, 0.01,
)
ALLSTATE_RATES = (0.0001, 0.00017783, 0.00031623, 0.00056234, 0.001, 0.00177828, 0.00316228, 0.00562341, 0.01)
SIX_RATES = (0.00025, 0.0005, 0.00075, 0.001, 0.0025, 0.005)
IMAGE_RATES = (0.0001, *SIX_RATES, 0.0075, 0.01)

STANDARD = RunGrid((1024,), ELEVEN_RATES, (32, 64, 128), ALL_METHODS)
WIDE = replace(STANDARD, methods=WIDE_METHODS)
LARGE = replace(STANDARD, batch_sizes=(4096,))
LARGEST = replace(LARGE, learning_rates=NINE_RATES, latent_dims=(128, 64, 32))
BLOBS = RunGrid((16, 32, 64), (0.001, 0.002, 0.003, 0.005, 0.01, 0.02, 0.03, 0.05), (2, 3, 4), ("CLIP", "GMC", "MCN", "ANCHOR"), 5, 20, 4, (4, 4))
TEXT = RunGrid((256,), NINE_RATES, (512, 256, 128), ALL_METHODS, 3, 10, 512, (512, 512))

SPECIAL = {
    "xor_blobs": BLOBS,
    "road_safety": replace(WIDE, batch_sizes=(4096,), latent_dims=(16, 32, 64)),
    "superconduct": replace(WIDE, latent_dims=(16, 32)),
    "medical_charges": LARGE,
    "jannis": replace(WIDE, latent_dims=(16, 32, 64)),
    "bioresponse": replace(WIDE, latent_dims=(16, 32)),
    "mercedes": replace(WIDE, latent_dims=(32, 64)),
    "sgemm": LARGE,
    "topo": replace(WIDE, latent_dims=(32, 64)),
    "miniboone": replace(WIDE, latent_dims=(16, 32, 64)),
    "yprop": replace(WIDE, latent_dims=(16, 32, 64)),
    "ukair": LARGE,
    "allstate": replace(LARGEST, batch_sizes=(2048,), learning_rates=ALLSTATE_RATES, methods=WIDE_METHODS),
    "albert": replace(LARGEST, batch_sizes=(2048,), methods=WIDE_METHODS),
    "airlines": LARGEST,
    "covertype": LARGEST,
    "higgs": replace(LARGEST, methods=WIDE_METHODS),
    "nyc_taxi": LARGEST,
    "soil": replace(LARGEST, batch_sizes=(1024,)),
    "kickstarter": TEXT,
    "clothing": replace(TEXT, batch_sizes=(128,), learning_rates=SIX_RATES, latent_dims=(256, 128), epochs=20),
    "streetview": replace(TEXT, batch_sizes=(512,), learning_rates=IMAGE_RATES, epochs=50),
    "skin_cancer": replace(TEXT, batch_sizes=(512,), learning_rates=IMAGE_RATES, epochs=50),
}


def grid_of(name: str) -> RunGrid:
    """The published grid of a dataset."""
    return SPECIAL.get(name, STANDARD)
