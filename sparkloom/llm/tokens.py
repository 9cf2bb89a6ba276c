"""Exact tokenisation at the speed of distinct pieces.

A text is cut, on its bytes, at places where no pre-token of the public patterns
can cross: before a single blank between two ordinary characters, around a lone
newline, and before a full stop or comma that follows a letter or digit. Pieces
between cuts encode alone to the same ids as inside the text, so each distinct
piece of a slice is encoded once and the rest is array work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import text_slices

#: Pieces a Python worker remembers across slices and tasks; at the limit it starts anew.
REMEMBERED = 450_000
#: Bytes of text that are encoded at once: the library's results are large objects.
TOKEN_SLICE = 2 << 20
#: New pieces that are encoded at once, for the same reason.
LEARNED = 16_384
#: Marks of pieces seen so far, one place for a hash (a power of two); a piece marked by chance is only remembered early.
MARKS = 1 << 23


def cut_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of every text, flat (they tile the texts), and the number in each text."""
    texts = column.to_pylist()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    joined = b"".join(raw)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(sizes)
    firsts = (ends - sizes)[sizes > 0]
    n = len(data)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    graph = (data > 0x20) & (data < 0x7F)
    # two-byte characters from U+00C0 on; other lead bytes can begin blanks or marks of other kinds
    lead = (data >= 0xC3) & (data <= 0xDF)
    tail = np.zeros(n, bool)
    tail[1:] = lead[:-1]
    starts_ok = graph | lead
    ends_ok = graph | tail
    before = np.zeros(n, bool)
    before[1:] = ends_ok[:-1]
    after = np.zeros(n, bool)
    after[:-1] = starts_ok[1:]
    blank = (data == 0x20) & before & after
    line = (data == 0x0A) & before & after
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    word = letter | ((data >= 0x30) & (data <= 0x39)) | (tail & (np.r_[np.uint8(0), data[:-1]] == 0xC3) & (data != 0x97) & (data != 0xB7))
    stop = (data == 0x2E) | (data == 0x2C)
    stop[1:] &= word[:-1]
    stop[0] = False
    start = blank | line | stop
    start[1:] |= line[:-1]
    start[firsts] = True
    at = np.flatnonzero(start)
    owner = np.searchsorted(ends, at, side="right")
    offsets = np.r_[at, n].astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined))
    return pieces, np.bincount(owner, minlength=len(texts))


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i]+1, ... (lengths[i] of them), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PieceEncoder:
    """Ids of texts. Pieces that come in more than one slice are remembered; most pieces come once and would only cost memory."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.seen = np.zeros(MARKS, bool)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 17, np.int64)
        self.lengths = np.zeros(1 << 17, np.int32)

    def add(self, pieces: list[str], first: int) -> None:
        """Encode pieces to the places first, first + 1, ..."""
        found = self.encode(pieces)
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        n = len(pieces)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
            self.lengths = np.concatenate([self.lengths, np.zeros(len(self.lengths), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.used += len(flat)

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Places of new pieces. Those marked in an earlier slice are remembered; the places of the others hold until the next call."""
        marks = np.fromiter(map(hash, pieces), np.int64, len(pieces)) & (MARKS - 1)
        again = self.seen[marks]
        self.seen[marks] = True
        order = np.argsort(~again, kind="stable")
        kept, first = int(again.sum()), len(self.known)
        for a, b in ((0, kept), (kept, len(pieces))):
            used = self.used
            for i in range(a, b, LEARNED):
                self.add([pieces[j] for j in order[i : min(b, i + LEARNED)].tolist()], first + i)
        self.used = used
        self.known.update(zip((pieces[j] for j in order[:kept].tolist()), range(first, first + kept)))
        at = np.empty(len(pieces), np.int64)
        at[order] = np.arange(first, first + len(pieces))
        return at

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, flat, and the number of each."""
        pieces, counts = cut_pieces(column)
        if not len(pieces):
            return np.zeros(0, np.uint32), counts
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.clear()
        known = self.known
        index = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(index < 0)
        if len(new):
            index[new] = self.learn([words[i] for i in new.tolist()])
        at = index[coded.indices.to_numpy()]
        lengths = self.lengths[at].astype(np.int64)
        ids = self.ids[spread(lengths, self.starts[at])]
        ends = np.cumsum(counts)
        sums = np.r_[0, np.cumsum(lengths)]
        return ids, sums[ends] - sums[ends - counts]


_encoders: dict[str, PieceEncoder] = {}


def tokenizers_encoder(path: str) -> PieceEncoder:
    """The piece encoder of a tokenizers file, one per Python worker."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        # the plain library call: the strings of added tokens in a text are those tokens, and no cut of a piece lies inside one
        _encoders[path] = PieceEncoder(lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)])
    return _encoders[path]


def encoded_slices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' ids and the number of each."""
    encoder = tokenizers_encoder(path)
    for batch in text_slices(batches, most=TOKEN_SLICE):
        yield batch, *encoder(batch.column("text"))
