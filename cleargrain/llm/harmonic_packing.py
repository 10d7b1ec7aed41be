"""Harmonic packing of tokenised documents.

A sequence holds `capacity` tokens. Class k takes pieces of more than capacity // (k + 1) and at most capacity // k
tokens, and k of them fill a sequence. A document is cut so that its pieces are exactly as long as their class allows:
whole sequences first, then the longest class length that fits the rest, and so on; a rest of fewer than `least` tokens
goes to its class uncut. Every worker fills the bins of its classes on its own, a fixed number of pieces each, and needs
no word from another. Pieces of bins that stay open at the end of a worker's input are laid end to end and cut at the
capacity, so a worker pads one sequence at most besides what short pieces leave.

Defined results: a null or empty text is the end token alone. Repeated rows are packed once each; their pieces have the
same id. An empty table gives no pieces. Only the id and text columns are read. Sequence numbers hang on how the input is
split into partitions; a task that runs again gives the same ones.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.bytescan import LOWER, pieces, text_buffer
from cleargrain.llm.shared import read_table, taken

CAPACITY = 2048
#: Shorter rests are not cut further.
LEAST = 96
#: Words whose ids a worker remembers before it forgets old ones.
REMEMBERED = 600_000
END = 1
PIECE_BYTES = 1 << 21
OUT_ROWS = 20_000


_ALNUM, _DIGIT, _OTHER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
_OTHER[33:127] = True
_OTHER[[39, *range(48, 58), *range(65, 91), *range(97, 123)]] = False
_SIGMA = "\u03a3".encode()


def parted(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space at every ASCII boundary that the tokenizer's first split has anyway.

    That split makes tokens of runs of letters, of single digits, and of runs of other marks (with an apostrophe it may
    differ). So far fewer distinct words remain to be encoded. A capital sigma's small form hangs on its neighbours;
    such texts are left as they are.
    """
    data = LOWER[data]
    if len(data) < 2 or _SIGMA in data.tobytes():
        return data, at
    letter = _ALNUM[data]
    tail = (data[1:] & 0xC0) == 0x80
    latin = tail & (data[:-1] >= 0xC3) & (data[:-1] <= 0xC8) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    ends = letter.copy()
    ends[1:] |= latin
    other, digit = _OTHER[data], _DIGIT[data]
    cut = (ends[:-1] & other[1:]) | (other[:-1] & letter[1:]) | (digit[:-1] & letter[1:]) | (letter[:-1] & digit[1:])
    inner = at[(at > 0) & (at < len(data))]
    cut[inner - 1] = False
    shift = np.zeros(len(data) + 1, np.int64)
    np.cumsum(cut, out=shift[1:-1])
    shift[-1] = shift[-2]
    out = np.full(len(data) + int(shift[-1]), 0x20, np.uint8)
    out[np.arange(len(data)) + shift[:-1]] = data
    return out, at + shift[at]


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. Each word is
    encoded once and remembered; when `remembered` words are, those not met since then are forgotten. The tokenizer finds the
    strings of its special tokens in a text before all else, in exactly their letters; so a text is cut at them, and words,
    which are small-lettered by then, are encoded as ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True  # of a word; `encode` has cut the text at special strings
        self.special = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.found = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.ids: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.remembered = remembered

    def learn(self, found: set[bytes]) -> None:
        if len(self.ids) > self.remembered:
            self.before, self.ids = self.ids, {}
        new = []
        for w in found:
            if (known := self.before.get(w)) is not None:
                self.ids[w] = known
            else:
                new.append(w)
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            got = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            raw = np.fromiter(chain.from_iterable(got), "<u4").tobytes()
            at = 0
            for word, ids in zip(part, got, strict=True):
                self.ids[word] = raw[at : (at := at + 4 * len(ids))]

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of the texts in a buffer with offsets."""
        was = gc.isenabled()
        gc.disable()  # millions of words are made and none is in a cycle
        try:
            own = self._specials(data, at)
            return self._cut(data, at, own) if own else self._encoded(*parted(data, at))
        finally:
            if was:
                gc.enable()

    def _specials(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(from, to, id) of special tokens' strings within rows."""
        raw = data.tobytes()
        met = np.array([m.span() for m in self.found.finditer(raw)], np.int64).reshape(-1, 2)
        rows = np.unique(np.searchsorted(at, np.concatenate([met[:, 0], met[:, 1] - 1]), "right") - 1)
        return [(int(at[i]) + m.start(), int(at[i]) + m.end(), self.special[m.group()]) for i in rows for m in self.found.finditer(raw[at[i] : at[i + 1]])]

    def _cut(self, data: np.ndarray, at: np.ndarray, own: list[tuple[int, int, bytes]]) -> list[bytes]:
        """Ids of texts with special tokens: what lies between is encoded on its own."""
        keep = np.ones(len(data), bool)
        for a, b, _ in own:
            keep[a:b] = False
        running = np.concatenate([[0], np.cumsum(keep)])
        edges, between, k = [0], [], 0
        for end in at[1:].tolist():
            between.append([])
            while k < len(own) and own[k][0] < end:
                edges.append(int(running[own[k][0]]))
                between[-1].append(own[k][2])
                k += 1
            edges.append(int(running[end]))
        parts = iter(self._encoded(*parted(data[keep], np.array(edges, np.int64))))
        return [next(parts) + b"".join(x + next(parts) for x in ids) for ids in between]

    def _encoded(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        texts = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        found = list(map(self.ids.get, chain.from_iterable(texts)))
        flat, unknown, i = None, [], -1
        with suppress(ValueError):  # index() ends so
            while True:
                i = found.index(None, i + 1)
                unknown.append(i)
        if unknown:
            flat = list(chain.from_iterable(texts))
            self.learn({flat[i] for i in unknown})
            for i in unknown:
                w = flat[i]
                found[i] = self.ids[w]
        ends = list(accumulate(map(len, texts), initial=0))
        return [b"".join(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@cache
def encoder_at(path: str) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    return WordEncoder(path)


def class_of(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def cuts(length: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = -(-capacity // rest)  # the largest class whose pieces are no longer than the rest
        fits = capacity // k
        if rest < least or fits >= rest or rest - fits == 0:
            out.append(rest)
            break
        out.append(fits)
        rest -= fits
    return out


def _piece_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def filled(documents: Iterator[tuple[object, bytes]], first_sequence: int, capacity: int = CAPACITY, least: int = LEAST) -> Iterator[tuple]:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of every piece of one worker's documents."""
    bins: dict[int, tuple[list, int, int]] = {}  # class -> pieces so far, sequence, used
    next_sequence = first_sequence
    for id, ids in documents:
        total, start = len(ids) // 4, 0
        for length in cuts(total, capacity, least):
            part = ids[4 * start : 4 * (start + length)]
            k = class_of(length, capacity)
            held, used = bins.pop(k, ([], 0))
            held.append((id, start, length, part, total, used))
            used += length
            if len(held) == k:
                for *piece, at in held:
                    yield (*piece, next_sequence, at)
                next_sequence += 1
            else:
                bins[k] = (held, used)
            start += length
    used = 0
    for k in sorted(bins):
        for id, start, length, part, total, _ in bins[k][0]:
            while length:
                take = min(length, capacity - used)
                yield (id, start, take, part[: 4 * take], total, next_sequence, used)
                start, length, part, used = start + take, length - take, part[4 * take :], used + take
                if used == capacity:
                    next_sequence, used = next_sequence + 1, 0


def packed(docs: DataFrame, encoder: Callable[[], WordEncoder], id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """id, start, length, ids (bytes of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset per piece."""
    part = taken(docs, id=id, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        end = np.array([END], "<u4").tobytes()
        types: list[pa.DataType] = []

        def documents():
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                for piece in pieces(batch, "text", PIECE_BYTES):
                    for key, ids in zip(piece.column(0).to_pylist(), encode.encode(*text_buffer(piece.column(1))), strict=True):
                        yield key, ids + end

        rows: list[tuple] = []
        for row in filled(documents(), TaskContext.get().partitionId() << 40, capacity, least):
            rows.append(row)
            if len(rows) >= OUT_ROWS:
                yield _piece_batch(rows, types[0])
                rows = []
        if rows:
            yield _piece_batch(rows, types[0])

    return part.mapInArrow(work, f"id {part.schema['id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def word_bpe(path: str | None = None) -> Callable[[], WordEncoder]:
    def make() -> WordEncoder:
        if path is not None:
            return encoder_at(path)
        import public_tokenizers

        return encoder_at(public_tokenizers.path("word_bpe_49k.json"))

    return make


def op6_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return digests(packed(read_table(spark, sf_dir, "documents"), word_bpe()))


def digests(pieces_: DataFrame) -> DataFrame:
    return pieces_.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
