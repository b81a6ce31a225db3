"""Language ID by hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram's vector binds (multiplies) its letters' vectors, rotated by their
place; a text's vector bundles (adds) those of its trigrams, words being set off by a space that counts as a letter. A
language's prototype bundles the unit vectors of its training texts, less the mean of all prototypes, which is what all
languages share: sums of many texts point much the same way without that. The language with the greatest cosine wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import map_arrow, map_rows, table

DIM, SEED, GRAM = 1024, 17, 3
#: Training texts of a language, about; the fit reads no more than these, in the few tasks given here.
PER_LANGUAGE, TASKS = 4000, 8
_SPACE = 32


class Encoder:
    """Texts to vectors. Trigrams seen so far keep their vectors, as many as `keep`."""

    def __init__(self, dim: int = DIM, seed: int = SEED, keep: int = 1 << 14):
        self.dim, self.seed, self.keep = dim, seed, keep
        self.letters: dict[int, np.ndarray] = {}
        self.kind = np.full(0x110000, -1, np.int32)  # code point: its lower case, a space if no letter, -1 not yet known
        self.grams: dict[int, int] = {}
        self.table, self.used = np.empty((1024, dim), np.float32), 0

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = (np.random.default_rng([self.seed, c]).integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters as code points, with one space for what stands between words, and at both ends."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        if (kind < 0).any():
            for p in np.unique(points[kind < 0]).tolist():
                c = chr(p)
                self.kind[p] = ord(c.lower()[0]) if c.isalpha() else _SPACE
            kind = self.kind[points]
        kind = np.concatenate([[_SPACE], kind, [_SPACE]])
        return kind[np.concatenate([[True], (kind[1:] != _SPACE) | (kind[:-1] != _SPACE)])]

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """Where the table has each of the distinct trigrams."""
        new = [g for g in grams.tolist() if g not in self.grams]
        if new:
            if self.used + len(new) > self.keep:
                self.grams, self.used, new = {}, 0, grams.tolist()
            while len(self.table) < self.used + len(new):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            for g in new:
                self.table[self.used] = np.roll(self.letter(g >> 42), 2) * np.roll(self.letter(g >> 21 & 0x1FFFFF), 1) * self.letter(g & 0x1FFFFF)
                self.grams[g] = self.used
                self.used += 1
        return np.array([self.grams[g] for g in grams.tolist()])

    def vector(self, text: str | None) -> np.ndarray | None:
        """The text's unit vector, or None without a letter."""
        c = self.codes(text or "").astype(np.int64)
        if len(c) < GRAM:
            return None
        total = np.zeros(self.dim, np.float32)
        grams, n = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)
        for at in range(0, len(grams), 4096):  # distinct trigrams of very long texts in blocks
            rows = self._rows(grams[at : at + 4096])
            total += n[at : at + 4096].astype(np.float32) @ self.table[rows]
        norm = float(np.linalg.norm(total))
        return total / norm if norm else None


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from docs (doc_id, text, lang).

    About per_language texts of each language are chosen by a hash of the id; their vectors are summed in TASKS tasks,
    so the driver gets a vector for each task and language. Nulls in text or lang are passed over.
    """
    docs = docs.filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, DIM), np.float32)
    places = 1_000_003
    within = F.lit(False)
    for lang, n in sizes.items():
        within = within | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(places)) < max(1,
            int(places * min(1.0, per_language / n)) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = Encoder(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (v := enc.vector(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()])], names=["lang", "v"])

    parts = map_arrow(docs.filter(within).select("lang", "text").repartition(TASKS), run, "lang string, v array<double>").collect()
    langs = sorted({r.lang for r in parts})
    if not langs:
        return [], np.zeros((0, DIM), np.float32)
    sums = np.array([np.sum([r.v for r in sorted(parts, key=lambda r: r.v[:4]) if r.lang == x], axis=0) for x in langs])
    unit = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    if len(langs) > 1:
        unit -= unit.mean(0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return langs, unit.astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (the greatest cosine, mapped to 0..1) for docs (doc_id, text); `und` and 0 for texts
    that are null or have no letter, and where no language was learned. Of equal cosines the first language wins."""

    def make():
        enc = Encoder()

        def step(batch: pa.RecordBatch) -> dict:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                v = enc.vector(text) if langs else None
                if v is None:
                    names.append("und")
                    scores.append(0.0)
                else:
                    cosines = prototypes @ v
                    best = int(cosines.argmax())
                    names.append(langs[best])
                    scores.append(float(min(1.0, max(0.0, (1 + cosines[best]) / 2))))
            return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3; a null id's is false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def held_out_reference(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, however long. Further columns aren't read. Rows without an id count as not held out and aren't learned from; repeated
    rows are each predicted; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict(docs, *model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
