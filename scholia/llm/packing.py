"""Packing documents into sequences by minimum bin slack.

A document's ids fill whole sequences as far as they go; what remains of it (less than one sequence) waits in its task's
window. A bounded subset-sum over the multiset of waiting lengths, as bits of an integer, finds the lengths that come
closest to filling a sequence beside the longest one; walking back gives how many of each length. The pattern is used as
often as the multiset allows. A full window is packed down to its reserve, whether patterns fill sequences or not: pieces
of those that don't are chained and cut where a sequence is full. So a task never holds more than the window and one
sequence, whatever the lengths. Tasks pack what they read: no row is shuffled.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from scholia.llm.common import map_arrow, table

SEQUENCE, END = 1024, 0
#: Remainders that a window gathers before it is packed, and those that wait for the next one.
WINDOW, RESERVE = 16_384, 512
#: White-space characters in a row from which a text is encoded by the tokenizers library.
LONG = 256
BLANK = re.compile(rf"\s{{{LONG}}}")


def encoder(file: str) -> Callable[[str], np.ndarray]:
    """Text to ids, as the tokenizers library gives them for `file` without added special tokens.

    Where the same vocabulary lies beside it as ranks, those are used, as they give the same ids faster; but texts that
    hold a special token's string go through the library itself, which makes it that token, and so do texts with a run of
    LONG white-space characters, over which the faster one takes quadratic time, and its whole stack from about a million on.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(file)
    special = [x.content for x in slow.get_added_tokens_decoder().values()]
    try:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file.removesuffix(".json") + ".tiktoken", "rb"))}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, FileNotFoundError):
        fast = None

    def encode(text: str) -> np.ndarray:
        if fast is None or any(x in text for x in special) or BLANK.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset within counts, holding its largest length, whose sum is nearest to capacity: (length, how many)."""
    first = max(counts)
    room, reach, steps = capacity - first, 1, []
    top, mask = 1 << room, (2 << room) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, times = min(counts[length] - (length == first), room // length), 1
        while left > 0 and not reach & top:
            k = min(times, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left, times = left - k, times * 2
        if reach & top:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    taken[first] = 1
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            taken[length] += k
    return list(taken.items())


def patterns(counts: dict[int, int], capacity: int, leave: int = 0) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Minimum bin slack: patterns (length, how many) and how often each is used, until at most `leave` pieces are left,
    which counts then holds."""
    total = sum(counts.values())
    while total > leave:
        found = fill(counts, capacity)
        times = min(min(counts[x] // k for x, k in found), -(-(total - leave) // sum(k for _, k in found)))
        for x, k in found:
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        total -= times * sum(k for _, k in found)
        yield found, times


class Packer:
    """One task's packing. A piece is (doc_id, start, doc_tokens, ids). At most `window` pieces wait, and less than a sequence
    of cut ones."""

    def __init__(self, task: int, size: int = SEQUENCE, window: int = WINDOW):
        self.size, self.next, self.waiting, self.n, self.window = size, task << 33, defaultdict(list), 0, window
        self.rest: list[tuple] = []  # pieces of patterns that don't fill a sequence
        self.more = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, total, ids in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.size
        for at in range(0, whole, self.size):
            yield from self._emit([(doc, at, len(ids), ids[at : at + self.size])])
        if whole < len(ids):
            self.waiting[len(ids) - whole].append((doc, whole, len(ids), ids[whole:].copy()))
            self.n += 1
            if self.n >= self.window:
                yield from self.pack(self.window * RESERVE // WINDOW)

    def pack(self, leave: int = 0) -> Iterator[tuple]:
        for found, times in patterns({k: len(v) for k, v in self.waiting.items() if v}, self.size, leave):
            for _ in range(times):
                pieces = [self.waiting[x].pop() for x, k in found for _ in range(k)]
                self.n -= len(pieces)
                if sum(len(p[3]) for p in pieces) == self.size:
                    yield from self._emit(pieces)
                else:
                    yield from self._cut(pieces)

    def _cut(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Pieces that no pattern fills a sequence with follow each other and are cut where a sequence is full."""
        for doc, start, of, ids in pieces:
            while len(ids):
                part, ids = ids[: self.size - self.more], ids[self.size - self.more :]
                self.rest.append((doc, start, of, part))
                self.more, start = self.more + len(part), start + len(part)
                if self.more == self.size:
                    yield from self._emit(self.rest)
                    self.rest, self.more = [], 0

    def end(self) -> Iterator[tuple]:
        """All that still waits; the last sequence is cut into powers of two, which need no padding."""
        yield from self.pack()
        pieces, self.rest, whole = self.rest, [], self.size
        while self.more:
            self.size, self.more, left = 1 << self.more.bit_length() - 1, 0, self.more
            for k, (doc, start, of, ids) in enumerate(pieces):
                room = self.size - self.more
                yield from self._cut([(doc, start, of, ids[:room])])
                if len(ids) >= room:
                    pieces = [(doc, start + room, of, ids[room:])] * (len(ids) > room) + pieces[k + 1 :]
                    break
            self.more = left - self.size
        self.size = whole


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """The pieces of docs (doc_id, text) in sequences of at most `size` ids, a power of two.

    Null text counts as empty and gives the end id alone; repeated rows are packed each; an empty table gives no rows.
    A sequence is either full or has the length of a smaller power of two, so none needs padding. Its id is the task's
    number and a counter: a task that runs again gives the same. Texts are tokenized whole, however long, one at a time;
    other columns of docs, whatever their names, are never read.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = encoder(tokenizer), Packer(TaskContext.get().partitionId(), size), []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.extend(packer.add(doc, np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4", copy=False)))
                if len(rows) >= 10_000:
                    yield flush()
                    rows = []
        rows.extend(packer.end())
        if rows:
            yield flush()

    return map_arrow(docs.select("doc_id", "text"), run, ", ".join(f"{n} long" for n in names))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids, or of a smaller power of two at a task's end. Nulls, empty and
    long texts, repeated rows, empty tables and further columns are as `pack_documents` defines them."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
