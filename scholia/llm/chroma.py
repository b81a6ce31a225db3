"""Media columns: chroma fingerprints of audio, and the alignment of recordings by them.

A recording (WAV bytes, PCM of 8, 16 or 32 bits) is cut into overlapping frames; a frame's power spectrum is folded into twelve
pitch classes. Filters compare sums over rectangles of this image (pitch classes by frames), read from its integral image;
each gives two bits by three thresholds, and sixteen of them a packed 32-bit integer for each frame. Two recordings are
aligned by the histogram of offsets at which their integers agree, and judged by the share of differing bits there.

Equal fingerprints are aligned once, however many recordings have them. Runs of one integer (silence, a held note) are
matched as runs, so that a pair's histogram costs what its runs cost, and memory has a bound whatever the lengths.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import blocks
from scholia.llm.common import map_arrow, table
from scholia.sources.stored import stored

FRAME, HOP, LOW_HZ, HIGH_HZ = 1024, 512, 110.0, 3520.0
#: Thresholds of a filter's log ratio, bits that must agree for a hit, hits at an offset that make a candidate, and the
#: share of differing bits up to which recordings align over at least half of the shorter one.
LEVELS, HIT_BITS, HITS, MOST_ERRORS = (-0.35, 0.0, 0.35), 24, 3, 0.2
#: Fingerprints in a block of rows and of queries at most, and their bytes, beyond which a block ends.
ROWS, QUERIES, BLOCK_BYTES = 4096, 512, 16 << 20
#: Cells of offset histograms that are held at a time; offsets of a pair from which all are judged together.
CELLS, MANY = 1 << 22, 64
#: Filters (shape, first pitch class, height, width in frames), by rule: six shapes in turn over all pitch classes.
FILTERS = [(i % 6, (5 * i) % 9, 3 + i % 2, (4, 8, 12, 16)[i // 4]) for i in range(16)]
WIDTH = max(w for *_, w in FILTERS)


def decode(audio: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate. What isn't such a recording raises ValueError."""
    try:
        with wave.open(io.BytesIO(audio)) as w:
            width, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, struct.error) as e:
        raise ValueError(f"no WAV recording: {e}") from None
    if width not in (1, 2, 4) or not channels or not rate:
        raise ValueError("only PCM of 8, 16 or 32 bits is read")
    x = np.frombuffer(data[: len(data) // (width * channels) * width * channels], {1: "u1", 2: "<i2", 4: "<i4"}[width]).reshape(-1, channels).mean(1)
    return (x - 128) / 128 if width == 1 else x / (1 << 8 * width - 1), rate


def encode(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_FOLD: dict[int, np.ndarray] = {}


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes, each frame with sum 1 (or 0 where it is silent)."""
    if rate not in _FOLD:
        hz = np.fft.rfftfreq(FRAME, 1 / rate)
        fold = np.zeros((len(hz), 12))
        use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
        fold[use, np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
        _FOLD[rate] = fold
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ _FOLD[rate]
    total = power.sum(1, keepdims=True)
    return np.where(total > 1e-9, power / np.maximum(total, 1e-9), 0)


def fingerprint(audio: bytes | None) -> np.ndarray:
    """Packed integers of a recording, one for each frame that WIDTH frames begin at; none for null, broken or too short
    audio."""
    try:
        image = chroma(*decode(audio)) if audio else np.zeros((0, 12))
    except ValueError:
        image = np.zeros((0, 12))
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    table_ = np.zeros((len(image) + 1, 13))
    table_[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return table_[at + x1, y1] - table_[at + x0, y1] - table_[at + x1, y0] + table_[at + x0, y0]

    out = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        x, m, v, third, layer = w // 2, h // 2, y + h, w // 3, max(1, h // 3)
        whole = area(0, w, y, v)
        if shape == 0:
            part = whole, area(0, w, 0, 12) - whole
        elif shape == 1:
            part = area(0, w, y + m, v), area(0, w, y, y + m)
        elif shape == 2:
            part = area(0, x, y, v), area(x, w, y, v)
        elif shape == 3:
            inner = area(0, x, y, y + m) + area(x, w, y + m, v)
            part = inner, whole - inner
        elif shape == 4:
            inner = area(0, w, y + layer, v - layer)
            part = inner, whole - inner
        else:
            inner = area(third, w - third, y, v)
            part = inner, whole - inner
        ratio = np.log((part[0] + 0.05) / (part[1] + 0.05))
        level = np.searchsorted(LEVELS, ratio)
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)  # neighbouring levels differ in one bit
    return out


def fingerprints(recordings: DataFrame, key: str = "id", audio: str = "audio", make: Callable[[], Callable] | None = None) -> DataFrame:
    """(id, fp binary) for each row of recordings (key, audio); fp holds the integers, little-endian.

    audio is a column of WAV bytes, or whatever `make()`, which runs once a task, gives a function to make WAV bytes of;
    recordings that are made so never stand in a column all at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_audio = make() if make else lambda x: x
        for batch in batches:
            found = [fingerprint(to_audio(x.as_py())).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.binary())], names=["id", "fp"])

    return map_arrow(recordings.select(key, audio), run, "id long, fp binary")


def in_blocks(fps: DataFrame, most: int) -> DataFrame:
    """(payload): ids, starts and integers of fingerprints (id, fp), up to `most` and about BLOCK_BYTES in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fp, size = [], [], 0

        def flush() -> pa.RecordBatch:
            payload = blocks.dump(ids=np.array(ids, np.int64), starts=np.cumsum([0, *(len(x) // 4 for x in fp)]),
                fp=np.frombuffer(b"".join(fp), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["payload"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + len(x) > BLOCK_BYTES:
                    yield flush()
                    ids, fp, size = [], [], 0
                ids.append(i)
                fp.append(x)
                size += len(x)
                if len(ids) >= most:
                    yield flush()
                    ids, fp, size = [], [], 0
        if ids:
            yield flush()

    return map_arrow(fps.select("id", "fp"), run, "payload binary")


def _runs(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys of one recording begin, and how long they are."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(key)))


class Block:
    """Fingerprints of a block, with the runs of their keys in the order of these."""

    def __init__(self, data: dict[str, np.ndarray]):
        self.ids, self.starts, self.fp = data["ids"], data["starts"], data["fp"]
        self.size = np.diff(self.starts)
        of = np.repeat(np.arange(len(self.ids)), self.size)
        start, length = _runs(self.fp >> np.uint32(32 - HIT_BITS), of)
        key = self.fp[start] >> np.uint32(32 - HIT_BITS)
        order = np.argsort(key, kind="stable")
        self.key, self.length, self.of = key[order], length[order], of[start][order]
        self.at = (start - self.starts[of[start]])[order] if len(start) else start

    def of_id(self, i: int) -> np.ndarray:
        return self.fp[self.starts[i] : self.starts[i + 1]]


def candidates(fp: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(query, offset) with enough hits in the pair's offset histogram, for one fingerprint and all of a block.

    A run of l equal keys and one of m in the other recording agree at l + m - 1 offsets, one to min(l, m) times: four
    changes of slope say so, and two running sums over a pair's offsets give its histogram.
    """
    start, length = _runs(fp >> np.uint32(32 - HIT_BITS), np.zeros(len(fp), np.int8))
    key = fp[start] >> np.uint32(32 - HIT_BITS)
    lo, hi = np.searchsorted(block.key, key, "left"), np.searchsorted(block.key, key, "right")
    n = hi - lo
    j = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    mine = np.repeat(np.arange(len(start)), n)
    asked = np.unique(block.of[j])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(asked):
        end, width = at, len(fp) + 2
        while end < len(asked) and (end == at or (end + 1 - at) * (max(width, len(fp) + 2 + int(block.size[asked[end]]))) <= CELLS):
            width = max(width, len(fp) + 2 + int(block.size[asked[end]]))
            end += 1
        here = np.flatnonzero((block.of[j] >= asked[at]) & (block.of[j] <= asked[end - 1]))
        q, m, l = block.of[j[here]], block.length[j[here]], length[mine[here]]  # noqa: E741
        size = block.size[q]
        first = start[mine[here]] - block.at[j[here]] - m + size  # the lowest offset that agrees, from -size + 1 on
        line = np.searchsorted(asked[at:end], q) * width
        change = np.zeros((end - at) * width, np.int32)
        for where, what in ((first, 1), (first + m, -1), (first + l, -1), (first + l + m, 1)):
            np.add.at(change, line + where, what)
        hits = change.reshape(end - at, width).cumsum(1).cumsum(1)
        need = np.minimum(HITS, np.minimum(block.size[asked[at:end]], len(fp)))
        row, col = np.nonzero(hits >= need[:, None])
        found.append((asked[at + row], col - block.size[asked[at + row]] + 1))
        at = end
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _errors_at_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of two fingerprints at every offset from -len(b) + 1 to len(a) - 1, by the correlation of their bits."""
    size = 1 << (len(a) + len(b) - 1).bit_length()
    total = np.zeros(size // 2 + 1, complex)
    for bit in range(32):
        x, y = (1.0 - 2.0 * (v >> np.uint32(bit) & np.uint32(1)) for v in (a, b))
        total += np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size))
    agree = np.fft.irfft(total, size)
    offsets = np.arange(-len(b) + 1, len(a))
    overlap = np.minimum(len(a), offsets + len(b)) - np.maximum(0, offsets)
    return np.rint((32 * overlap - agree[offsets % size]) / 2)


def judged(fp: np.ndarray, block: Block, q: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The share of differing bits of a fingerprint and queries of a block at offsets; 1 where less than half of the shorter
    one overlaps."""
    errors = np.ones(len(q))
    size = block.size[q]
    overlap = np.minimum(len(fp), off + size) - np.maximum(0, off)
    fits = overlap >= 0.5 * np.minimum(size, len(fp))
    many = np.bincount(q[fits], minlength=len(block.ids)) > MANY
    for i in np.flatnonzero(many).tolist():
        some = np.flatnonzero(fits & (q == i))
        errors[some] = _errors_at_all(fp, block.of_id(i))[off[some] + block.size[i] - 1] / (32 * overlap[some])
    rest = np.flatnonzero(fits & ~many[q])
    order = rest[np.lexsort((size[rest], off[rest]))]
    groups = np.flatnonzero(np.diff(off[order]) | np.diff(size[order])) + 1 if len(order) else []
    for some in np.split(order, groups) if len(order) else []:  # queries of one length at one offset are compared together
        o, n = int(off[some[0]]), int(size[some[0]])
        a, b = max(0, o), min(len(fp), o + n)
        at = block.starts[q[some]][:, None] + np.arange(a - o, b - o)
        errors[some] = np.bitwise_count(block.fp[at] ^ fp[a:b]).sum(1) / (32 * (b - a))
    return errors


def align_block(rows: dict, queries: dict) -> tuple[list[int], list[int], list[int], list[float], list[int], list[list[int]]]:
    """For each row with an aligned query in the block: id, the query with the fewest errors (then the smallest id), the
    offset (frames by which the row is later), the share of differing bits, how many queries align, and which."""
    own, block = Block(rows), Block(queries)
    out: tuple = ([], [], [], [], [], [])
    for i, row_id in enumerate(own.ids.tolist()):
        fp = own.of_id(i)
        q, off = candidates(fp, block)
        if not len(q):
            continue
        errors = judged(fp, block, q, off)
        good = errors <= MOST_ERRORS
        if good.any():
            j = np.lexsort((off, block.ids[q], errors))[0]
            which = np.unique(block.ids[q[good]]).tolist()
            for col, v in zip(out, (row_id, int(block.ids[q[j]]), int(off[j]), float(errors[j]), len(which), which), strict=True):
                col.append(v)
    return out


def align(fps: DataFrame, queries: DataFrame) -> DataFrame:
    """(fp, query, offset, errors, n_queries) for each fingerprint of fps (fp) that a recording of queries (id, fp) aligns
    with: the best one, and how many ids align. Queries without an id are passed over; those of equal fingerprints are
    compared once, under the least of their ids, and each counts."""
    classes = stored(fps.select("fp").filter(F.octet_length("fp") > 0).distinct().withColumn("id", F.monotonically_increasing_id()))
    asked = stored(queries.filter("id is not null").filter(F.octet_length("fp") > 0).groupBy("fp").agg(F.min("id").alias("id"),
        F.countDistinct("id").alias("n")))
    names = ["id", "query", "offset", "errors", "n", "which"]

    def run(rows: dict, q: dict) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(align_block(rows, q), kinds, strict=True)], names=names)

    few = asked.coalesce(max(1, asked.count() // QUERIES))
    found = stored(blocks.pairs(in_blocks(classes.select("id", "fp"), ROWS), stored(in_blocks(few, QUERIES)), run,
         "id long, query long, offset long, errors double, n long, which array<long>"))
    best = found.groupBy("id").agg(F.min(F.struct("errors", "query", "offset")).alias("best"))
    weights = asked.filter("n > 1").select(F.col("id").alias("q"), "n")  # an id of several fingerprints may count for each
    count = found.select("id", F.explode("which").alias("q")).join(weights, "q", "left").groupBy("id").agg(F.sum(F.coalesce("n",
        F.lit(1))).alias("n_queries"))
    return classes.join(best.join(count, "id"), "id").select("fp", "best.query", "best.offset", "best.errors", "n_queries")


def sonify(note: int = 512, rate: int = 8000) -> Callable[[dict | None], bytes | None]:
    """What plays a vector as notes of three octaves, a component each, as WAV bytes, after `late` notes' rest and with noise
    of the given loudness (from the seed `id`). The test tables have no audio; this makes recordings of which copies and
    near copies sound alike. Null vectors give null, null components rests."""
    tones = 261.63 * 2 ** (np.arange(36) / 12)
    waves = np.concatenate([0.8 * np.sin(2 * np.pi * tones[:, None] * np.arange(note) / rate) * np.hanning(note) ** 0.25, np.zeros((1, note))])

    def play(what: dict | None) -> bytes | None:
        if what is None or what["vector"] is None:
            return None
        x = np.array([np.nan] * what["late"] + [np.nan if c is None else c for c in what["vector"]], float)
        finite = np.isfinite(x)
        sound = waves[np.where(finite, np.floor(18 + 60 * np.where(finite, x, 0)).astype(int) % 36, 36)].ravel()
        if what["noise"]:
            sound = sound + np.random.default_rng(abs(what["id"] or 0)).normal(0, what["noise"], len(sound))
        return encode(sound, rate)

    return play


def recordings(vectors: DataFrame) -> DataFrame:
    """(vec_id, sound {id, vector, late, noise}) of vectors (vec_id, embedding): what is played of each."""
    i = F.col("vec_id")
    return vectors.select("vec_id", F.struct(i.alias("id"), F.col("embedding").alias("vector"), F.lit(0).alias("late"),
        F.lit(0.0).alias("noise")).alias("sound"))


def heard(vectors: DataFrame) -> DataFrame:
    """The same as somebody records it who starts too early, in a noisy room: by the hundreds of the id up to eleven notes
    early, and with noise of up to 4 % of full loudness."""
    i = F.col("vec_id")
    hundreds = F.floor(F.abs(i) / 100)
    return vectors.select("vec_id", F.struct(i.alias("id"), F.col("embedding").alias("vector"),
        (hundreds % 12).cast("int").alias("late"), (hundreds % 5 * 0.01).alias("noise")).alias("sound"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of `embeddings`, played: vec_id, n_frames, fingerprint (hex of the integers), and how it aligns with the
    queries, which are the rows whose id is divisible by 100, as `heard` records them: the best one, its offset and share
    of differing bits, and how many align (null and 0 where none, as for null and too short vectors). Rows without an id
    are aligned, but aren't queries; repeated rows are each reported, and a query's count once for each id. Long
    recordings are taken whole. An empty table gives no rows; further columns aren't read."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fps = stored(fingerprints(recordings(vectors), "vec_id", "sound", sonify))
    found = align(fps, fingerprints(heard(vectors.filter("vec_id % 100 = 0")), "vec_id", "sound", sonify))
    size: Column = (F.octet_length("fp") / 4).cast("long")
    return fps.join(found, "fp", "left").select(F.col("id").alias("vec_id"), size.alias("n_frames"),
        F.lower(F.hex("fp")).alias("fingerprint"), F.col("query").alias("aligned_id"), "offset", F.round("errors",
        6).alias("bit_error_rate"), F.coalesce("n_queries", F.lit(0)).alias("n_aligned"))
