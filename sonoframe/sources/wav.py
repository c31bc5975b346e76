"""WAV recordings as DataFrames: discovery, header probe, block scan to per-frame features, ranged reads.

Tasks read files by range under their path: a header costs some bytes, a clip its own samples. Local paths and those of Arrow's file
systems work so. With content=True Spark reads whole files instead (of less than 2 GB), for stores that only Spark can open.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import kernels
from sonoframe.functions.bands import AUDIBLE
from sonoframe.functions.text import recorder_datetime
from sonoframe.operators import spectrogram
from sonoframe.session import ship


#: format and bits of what samples() decodes: integers (1) and floats (3)
READABLE = {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}


class Source:
    """A file's bytes by range, from its path or from bytes that are at hand."""

    def __init__(self, path: str, raw: bytes | None = None):
        self.raw, self.file = raw, None
        if raw is not None:
            self.size = len(raw)
        elif re.match(r"file:|/", path):
            self.file = open(re.sub(r"^file:(//)?", "", path), "rb")  # noqa: SIM115
            self.size = self.file.seek(0, 2)
        else:
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(path)
            self.file = system.open_input_file(name)
            self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        if self.file is None:
            return self.raw[start : start + n]
        self.file.seek(start)
        return self.file.read(n)

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()


class Wave:
    """Header and samples of a RIFF file."""

    def __init__(self, source: Source):
        self.source, self.comment, fmt = source, "", None
        head = source.read(0, 12)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            raise ValueError("not a RIFF WAVE file")
        at = 12
        while at + 8 <= source.size:
            name, size = struct.unpack("<4sI", source.read(at, 8))
            if name == b"fmt ":
                own = source.read(at + 8, min(size, 40))
                kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", own)
                fmt = (struct.unpack_from("<H", own, 24)[0] if kind == 0xFFFE and len(own) >= 26 else kind, channels, rate, bits)
            elif name == b"LIST" and size < 1 << 16:
                self.comment = _comment(source.read(at + 8, size)) or self.comment
            elif name == b"data" and fmt:
                self.kind, self.channels, self.rate, self.bits = fmt
                if (self.kind, self.bits) not in READABLE or not self.channels or not self.rate:
                    raise ValueError(f"no linear PCM that can be read: format {self.kind}, {self.bits} bits, {self.channels} channels, {self.rate} Hz")
                self.width = self.channels * self.bits // 8
                self.first, self.frames = at + 8, min(size, source.size - at - 8) // self.width
                return
            at += 8 + size + size % 2
        raise ValueError("no audio data")

    def samples(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """Samples from frame `start` on, as doubles in -1 to 1, channels averaged."""
        n = max(0, min(self.frames - start, self.frames if n is None else n))
        own = self.source.read(self.first + start * self.width, n * self.width)
        if self.kind == 3:
            x = np.frombuffer(own, f"<f{self.bits // 8}").astype(np.float64)
        elif self.bits == 8:
            x = (np.frombuffer(own, np.uint8).astype(np.float64) - 128) / 128
        elif self.bits == 24:
            b = np.frombuffer(own, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
        else:
            x = np.frombuffer(own, f"<i{self.bits // 8}").astype(np.float64) / float(1 << self.bits - 1)
        return x if self.channels == 1 else x.reshape(-1, self.channels).mean(axis=1)

    def seconds(self, start: float, end: float) -> np.ndarray:
        first = int(start * self.rate)
        return self.samples(first, max(0, int(end * self.rate) - first))


def _comment(chunk: bytes) -> str:
    """The comment of an INFO list."""
    at = 4
    while chunk[:4] == b"INFO" and at + 8 <= len(chunk):
        name, size = struct.unpack_from("<4sI", chunk, at)
        if name == b"ICMT":
            return chunk[at + 8 : at + 8 + size].split(b"\0")[0].decode("utf-8", "replace").strip()
        at += 8 + size + size % 2
    return ""


def decode(raw: bytes, start: int = 0, frames: int | None = None) -> tuple[np.ndarray, int]:
    """Samples of WAV bytes, and their rate."""
    wave = Wave(Source("", raw))
    return wave.samples(start, frames), wave.rate


def encode(audio: np.ndarray, rate: int, comment: str = "") -> bytes:
    """16-bit mono WAV bytes."""
    data = np.clip(np.round(audio * 32767), -32768, 32767).astype("<i2").tobytes()
    text = comment.encode() + b"\0" * (1 + (len(comment.encode()) + 1) % 2)
    info = b"LIST" + struct.pack("<I", 12 + len(text)) + b"INFOICMT" + struct.pack("<I", len(text)) + text if comment else b""
    return b"RIFF" + struct.pack("<I", 36 + len(info) + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + info + b"data" + struct.pack("<I", len(data)) + data


def recordings(spark: SparkSession, *paths: str, distinct: bool = True) -> DataFrame:
    """binaryFile rows of all WAV files at or below the paths. Empty files are not listed by Spark.

    Only inputs that may overlap are made distinct, so a single folder is scanned without moving its contents.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(list(paths))
    return found.dropDuplicates(["path"]) if distinct and len(paths) > 1 else found


def listing(files: DataFrame) -> DataFrame:
    """Paths and lengths in path order, without contents."""
    return files.select("path", "length", "modificationTime").orderBy("path")


def _tasks(spark: SparkSession) -> int:
    """How many tasks thin rows go to that are much work each: a number, so they are not coalesced by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _by_file(files: DataFrame, kernel: Callable[[str, Wave], Iterator[pd.DataFrame]], schema: str, content: bool) -> DataFrame:
    """kernel's frames of every file, one file open at a time."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"] if content else [None] * len(pdf), strict=True):
                with Source(path, raw) as source:
                    yield from kernel(path, Wave(source))

    # without contents a file is a thin row, so rows are dealt out by path: the scan's own splits hold many files each
    rows = files.select("path", "content") if content else files.select("path").repartition(_tasks(files.sparkSession), "path")
    return rows.mapInPandas(run, schema)


def probe(files: DataFrame, content: bool = False) -> DataFrame:
    """path, samplerate_hz, duration_s, comment, recorded_at, error: what header and name say, or why they can't be read."""
    ship(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"] if content else [None] * len(pdf), strict=True):
                try:
                    with Source(path, raw) as source:
                        wave = Wave(source)
                    rows.append((path, wave.rate, wave.frames / wave.rate, wave.comment, None))
                except (ValueError, OSError, struct.error, ZeroDivisionError) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "samplerate_hz", "duration_s", "comment", "error"]).astype({"samplerate_hz": "Int64"})

    stem = F.regexp_extract("path", "([^/]+)\\.[^./]+$", 1)
    rows = files.select("path", "content") if content else files.select("path")
    return rows.mapInPandas(read, "path string, samplerate_hz long, duration_s double, comment string, error string").withColumn("recorded_at", recorder_datetime(stem))


def _frames(wave: Wave, frame: int, hop: int, target_rate: int) -> int:
    """How many frames a recording has."""
    return max(0, (kernels.resampled_length(wave.frames, wave.rate, target_rate) - frame) // hop + 1)


def frame_ranges(files: DataFrame, frame: int, hop: int, target_rate: int, span: int) -> DataFrame:
    """path, first, n: the frames of every file in ranges of at most `span`, from headers alone."""
    ship(files.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = []
            for path in pdf["path"]:
                with Source(path) as source:
                    frames.append(_frames(Wave(source), frame, hop, target_rate))
            yield pd.DataFrame({"path": pdf["path"], "frames": frames})

    counted = files.select("path").mapInPandas(count, "path string, frames long").filter("frames > 0")
    ranged = counted.select("path", "frames", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(span).cast("long"))).alias("first"))
    return ranged.select("path", "first", F.least(F.lit(span).cast("long"), F.col("frames") - F.col("first")).alias("n"))


#: frames that are transformed at once: their arrays stay in a processor's cache
AT_ONCE = 64


def _frame_series(path: str, wave: Wave, ranges: Iterable[tuple[int, int]], bands: dict, frame: int, hop: int, target_rate: int, block: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The path, numbers and series (t_s, flux, centroid, flatness and the bands, a column each) of the frames of ranges (first, n) of a recording.

    Each range reads its own samples and those of the frame before it, in blocks of at most `block` frames. Blocks of one length are transformed
    together, so ranges of a frame or two don't cost a pass through NumPy each.
    """
    rate = target_rate if 0 < target_rate < wave.rate else wave.rate
    freqs = kernels.frequency_axis(rate, frame)
    most = min(block, AT_ONCE)
    blocks = ((at, min(most, first + n - at)) for first, n in ranges for at in range(first, first + n, most))
    for (n, lead), own in itertools.groupby(blocks, lambda b: (b[1], int(b[0] > 0))):  # the frame before, in the same read
        while held := list(itertools.islice(own, max(1, most // n))):
            starts = np.array([at for at, _ in held])
            read = [kernels.resample_range(wave.samples, wave.frames, wave.rate, rate, (at - lead) * hop, (n + lead - 1) * hop + frame) for at, _ in held]
            mag = kernels.magnitudes(np.stack(read) if len(read) > 1 else read[0][None, :], frame, hop)
            before = mag[:, :-1].reshape(-1, mag.shape[-1]) if lead else None
            series = kernels.frame_series(mag[:, lead:].reshape(-1, mag.shape[-1]), freqs, bands, before)
            at = (starts[:, None] + np.arange(n)).ravel()
            yield path, at, np.stack([at * hop / rate, *series.values()], axis=1)


def _frame_rows(parts: list[tuple[str, np.ndarray, np.ndarray]], bands: dict) -> pa.RecordBatch:
    at, values = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    energies = pa.MapArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * len(bands), pa.array(list(bands) * len(at), pa.string()), values[:, 4:].ravel())
    paths = pa.array([p[0] for p in parts]).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
    return pa.RecordBatch.from_pydict({"path": paths, "frame_idx": at} | {n: values[:, i] for i, n in enumerate(("t_s", "flux", "centroid", "flatness"))} | {"band_energies": energies})


def frame_features(files: DataFrame, bands: dict = AUDIBLE, frame: int = 2048, hop: int = 512, target_rate: int = 48000, block: int = 4096, content: bool = False, span: int = 1 << 14) -> DataFrame:
    """path, frame_idx, t_s, flux, centroid, flatness, band_energies of each frame.

    A recording is dealt by ranges of `span` frames (three minutes at the defaults) over all tasks; a range reads its own samples and the frame before
    it, whose magnitude flux needs, so nothing is carried from one to the next. Rows go out in batches of some `block` frames: memory follows the
    block. With content=True a file is one task, as Spark hands it over whole.
    """

    def gathered(found: Iterator[tuple[str, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in found:  # short ranges go on together
            held.append(part)
            n += len(part[1])
            if n >= block:
                yield _frame_rows(held, bands)
                held, n = [], 0
        if held:
            yield _frame_rows(held, bands)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                with Source(path.as_py(), raw.as_py()) as source:
                    wave = Wave(source)
                    yield from _frame_series(path.as_py(), wave, [(0, _frames(wave, frame, hop, target_rate))], bands, frame, hop, target_rate, block)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, own in batch.to_pandas().groupby("path", sort=False):
                with Source(path) as source:
                    ranges = own.sort_values("first")[["first", "n"]].to_numpy().tolist()
                    yield from _frame_series(path, Wave(source), ranges, bands, frame, hop, target_rate, block)

    schema = "path string, frame_idx long, t_s double, flux double, centroid double, flatness double, band_energies map<string,double>"
    if content:
        ship(files.sparkSession)
        return files.select("path", "content").mapInArrow(lambda batches: gathered(whole(batches)), schema)
    dealt = frame_ranges(files, frame, hop, target_rate, span).repartition(_tasks(files.sparkSession), "path", F.floor(F.col("first") / max(span, block)))  # short ranges of a file go to one task, which opens it once
    return dealt.mapInArrow(lambda batches: gathered(ranged(batches)), schema)


def detect_baseline(frames: DataFrame, seconds: float = 60.0) -> DataFrame:
    """frames with the causal median and mad of their recording; the window is at most half the recording.

    frame_idx numbers the frames of a recording, so they are dealt by ranges of it (see spectrogram.anchored).
    """
    own = frames.select("path", F.col("frame_idx").alias("_i"), "t_s", "flux")
    step = F.max(F.when(F.col("_i") == 1, F.col("t_s"))) - F.max(F.when(F.col("_i") == 0, F.col("t_s")))
    counts = own.groupBy(F.col("path").alias("_key")).agg((F.max("_i") + 1).alias("_n"), step.alias("_dt"))
    window = F.least(F.greatest(F.lit(1), F.floor(seconds / F.coalesce("_dt", F.lit(1.0)))), F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    return spectrogram.anchored(own, counts.select("_key", "_n", window.alias("_window")), "path", "flux").select("path", F.col("_i").alias("frame_idx"), "t_s", "flux", "median", "mad")


def measure_clips(clips: DataFrame, frame: int = 2048, hop: int = 512) -> DataFrame:
    """Indices and band features of clips, each read by range. clips: path, event_index, onset_s, offset_s, clip_start_s, clip_end_s, lo_hz, hi_hz."""
    ship(clips.sparkSession)
    names = ["aci", "bio", "ndsi", "adi", "aei", "band_crest", "band_entropy", "band_centroid", "periodicity", "pulse_rate_hz", "context_periodicity", "context_rate_hz"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, own in pdf.groupby("path", sort=False):
                with Source(path) as source:
                    wave = Wave(source)
                    freqs, fps = kernels.frequency_axis(wave.rate, frame), wave.rate / hop
                    for c in own.itertuples():
                        mag = kernels.magnitudes(wave.seconds(c.clip_start_s, c.clip_end_s), frame, hop)
                        f0 = min(max(int((c.onset_s - c.clip_start_s) * fps), 0), max(len(mag) - 1, 0))
                        f1 = max(int(min(len(mag), (c.offset_s - c.clip_start_s) * fps) + 1), f0 + 1)
                        rows.append({"path": path, "event_index": c.event_index} | kernels.indices(mag, freqs) | kernels.band_features(mag[f0:f1], freqs, c.lo_hz, c.hi_hz, fps, mag))
            yield pd.DataFrame(rows, columns=["path", "event_index", *names])

    own = clips.select("path", "event_index", "onset_s", "offset_s", "clip_start_s", "clip_end_s", "lo_hz", "hi_hz")
    return own.mapInPandas(measure, f"path string, event_index long, {', '.join(f'{n} double' for n in names)}")


def event_bands(events: DataFrame, bands: dict = AUDIBLE, longest: int = 8) -> DataFrame:
    """path, event_index, band_energies of events' own samples. events: path, event_index, onset_s, offset_s.

    Frames are too short to tell tones at the edge of a band apart: a bin of them is some hertz wide and a tone falls into several. Here an event is one
    transform, in pieces of `longest` seconds where it lasts longer. It is padded to whole seconds, so whole hertz are bins and an edge lies on one.
    """
    ship(events.sparkSession)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, own in pdf.groupby("path", sort=False):
                with Source(path) as source:
                    wave = Wave(source)
                    for e in own.itertuples():
                        first, end = int(e.onset_s * wave.rate), min(int(e.offset_s * wave.rate), wave.frames)
                        energies = dict.fromkeys(bands, 0.0)
                        for at in range(first, end, longest * wave.rate):
                            x = wave.samples(at, min(longest * wave.rate, end - at))
                            size = -(-len(x) // wave.rate) * wave.rate
                            spectrum = np.abs(np.fft.rfft(x, size)) ** 2 / size
                            freqs = np.arange(len(spectrum)) * wave.rate / size
                            for name, (lo, hi) in bands.items():
                                energies[name] += float(spectrum[(freqs >= lo) & (freqs < hi)].sum())
                        rows.append((path, e.event_index, energies))
            yield pd.DataFrame(rows, columns=["path", "event_index", "band_energies"])

    return events.select("path", "event_index", "onset_s", "offset_s").mapInPandas(measure, f"path string, event_index {events.schema['event_index'].dataType.simpleString()}, band_energies map<string,double>")


def file_indices(files: DataFrame, longest: float = 60.0, slices: int = 6, frame: int = 2048, hop: int = 512, content: bool = False) -> DataFrame:
    """Indices of each file and the seconds that they are of: all of it up to `longest` seconds, else evenly spaced slices joined together."""

    def read(path: str, wave: Wave) -> Iterator[pd.DataFrame]:
        want = int(longest * wave.rate)
        if wave.frames <= want:
            audio = wave.samples()
        else:
            each = want // slices
            step = (wave.frames - each) // max(1, slices - 1)
            audio = np.concatenate([wave.samples(i * step, each) for i in range(slices)])
        found = kernels.indices(kernels.magnitudes(audio, frame, hop), kernels.frequency_axis(wave.rate, frame))
        yield pd.DataFrame([{"path": path} | found | {"estimated_from_s": round(len(audio) / wave.rate, 1)}])

    return _by_file(files, read, "path string, aci double, bio double, ndsi double, adi double, aei double, estimated_from_s double", content)
