"""Packing (operator 3): sum-of-squares online packing into fixed windows.

Each scan task tokenises its documents one after the other and packs them online;
there is no shuffle, and what a task holds is its partly filled windows only.

* A document is its token ids and one end id 0.  Full windows are cut off its front;
  the rest (fewer ids than a window) is one item.
* A level array ``counts[h]`` has the number of open windows filled to level h.  An
  item of size s goes to the level h (or to a new window, h = 0) for which the sum of
  the squared counts of the open levels 1..window-1 becomes smallest; among equals to
  the fullest level.  A window that reaches the last level is complete.
* At the end of a task's rows its open windows run into each other, fullest first:
  their pieces are cut where a sequence is full, so a task pads one sequence at most.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; a null id is kept; an empty table gives no rows; other columns of
the input are not read.

Ids are those of the ``tokenizers`` library.  Its byte-level pre-tokenizer is slow,
so texts of plain Latin characters go through ``tiktoken`` with the same
vocabulary and pattern (equal ids; tested), all others through ``tokenizers``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from textlytics.llm.common import documents

WINDOW = 1024
END_ID = 0
#: sequence ids of a task start at its number times this
SEQUENCES_PER_TASK = 1 << 36
#: texts of these characters only have the same ids in both tokenizer libraries
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_encoders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a text, as ``tokenizers`` gives them for the vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        specials = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        # the file spells bytes as printable characters: those that are printable as themselves
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelt = {chr(b): b for b in own}
        spelt.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
        ranks = {bytes(spelt[c] for c in token): i
                 for token, i in self.slow.get_vocab(with_added_tokens=False).items() if token not in specials}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) or self.special and self.special.search(text):
            got = self.slow.encode(text, add_special_tokens=False).ids
        else:
            got = self.fast.encode_ordinary(text)
        out = np.empty(len(got) + 1, "<u4")
        out[:-1] = got
        out[-1] = END_ID
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class SumOfSquares:
    """Open windows by fill level; pieces are (id, start, doc_tokens, ids)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        # the last entry is no open level: it adds nothing to the sum of squares
        self.counts = np.zeros(window + 1)
        self.counts[window] = -0.5
        self.open: list[list[list]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """The level an item of this size goes to; 0 is a new window."""
        c, b = self.counts, self.window
        change = 2 * (c[size:b + 1] + 1) - 1       # what level h + size gains, for h = 0..b-size
        change[-1] -= 2 * (c[b] + 1) - 1           # ... nothing when the window is complete
        change[1:] -= 2 * c[1:b - size + 1] - 1    # what level h loses
        change[1:][c[1:b - size + 1] < 1] = np.inf
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put a piece into a window; the window's pieces if that completes it."""
        size = len(piece[3])
        h = self.level(size)
        if h:
            pieces = self.open[h].pop()
            self.counts[h] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + size == self.window:
            return pieces
        self.open[h + size].append(pieces)
        self.counts[h + size] += 1
        return None

    def rest(self) -> Iterator[list]:
        """The open windows run together, fullest first, cut into sequences."""
        out, room = [], self.window
        for h in range(self.window - 1, 0, -1):
            for key, start, total, ids in (p for w in self.open[h] for p in w):
                while len(ids):
                    out.append((key, start, total, ids[:room]))
                    start, ids, room = start + len(out[-1][3]), ids[room:], room - len(out[-1][3])
                    if not room:
                        yield out
                        out, room = [], self.window
        if out:
            yield out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, with ``with_ids``).  See the module for the cases."""
    path = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([rows.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in names[1:]])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        cols: list[list] = [[] for _ in schema.names]
        kinds: list = []

        def emit(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for key, start, total, ids in pieces:
                values = (key, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)
                for col, v in zip(cols, values):
                    col.append(v)
                if with_ids:
                    cols[-1].append(ids.astype(np.int32))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=schema.names)
            for c in cols:
                c.clear()
            return got

        for batch in batches:
            kinds = [batch.schema.field("doc_id").type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = enc.ids(text.as_py() or "")
                full = len(ids) // window * window
                for at in range(0, full, window):
                    emit([(key, at, len(ids), ids[at:at + window])])
                if full < len(ids):
                    done = packer.place((key, full, len(ids), ids[full:].copy()))
                    if done:
                        emit(done)
                if len(cols[0]) >= 4096:
                    yield flush()
        for pieces in packer.rest():
            emit(pieces)
            if len(cols[0]) >= 4096:
                yield flush()
        if cols[0]:
            yield flush()

    return rows.mapInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(documents(spark, sf_dir), with_ids=False)
