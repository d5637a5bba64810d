"""PCM WAV files as a Spark data source: one row for each window of a file, read by its own task."""

from __future__ import annotations

import glob
import wave
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class WindowPartition(InputPartition):
    def __init__(self, path: str, first: int, windows: int):
        self.path, self.first, self.windows = path, first, windows


class WaveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.seconds = options["path"], float(options.get("seconds", 20))
        self.each = int(options.get("windowsPerTask", 16))

    def partitions(self) -> list[WindowPartition]:
        found = []
        for path in sorted(glob.glob(self.path)):
            with wave.open(path) as w:
                n = -(-w.getnframes() // max(1, int(self.seconds * w.getframerate())))
            found += [WindowPartition(path, k, min(self.each, n - k)) for k in range(0, n, self.each)]
        return found

    def read(self, part: WindowPartition) -> Iterator[tuple]:
        with wave.open(part.path) as w:
            rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
            size = max(1, int(self.seconds * rate))
            for k in range(part.first, part.first + part.windows):
                w.setpos(min(k * size, w.getnframes()))
                raw = np.frombuffer(w.readframes(size), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
                raw = (raw - 128) / 128 if width == 1 else raw / float(1 << 8 * width - 1)
                mono = raw.reshape(-1, channels).mean(axis=1)  # channels are averaged, frame by frame
                yield part.path, k, rate, mono.astype(np.float32).tolist()


class WaveDataSource(DataSource):
    """spark.read.format("wave_windows").option("seconds", 20).load(glob) gives (path, segment_index, sample_rate, samples)."""

    @classmethod
    def name(cls) -> str:
        return "wave_windows"

    def schema(self) -> str:
        return "path string, segment_index int, sample_rate int, samples array<float>"

    def reader(self, schema) -> WaveReader:  # noqa: ANN001
        return WaveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WaveDataSource)
