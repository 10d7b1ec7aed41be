"""A gated recurrent language model over words, in numpy.

The vocabulary is the VOCABULARY most frequent training words, the end of a text, and BINS bins of other words by their
last two bytes. A word of a bin has the bin's probability times its share of the bin's smoothed corpus counts, so
every text has a probability. The output softmax is factored: a word's class first, then the word within the class.
Training is truncated backpropagation through STEPS steps of STREAMS texts side by side, with Adagrad. Trainers work on
parts of the training texts, TRAINER_TOKENS tokens each, so there are as many as the input asks for, and every training text
gives gradients; their parameters are averaged in a tree, weighted by tokens. Texts are turned into symbols once, for training and scoring.
A text is scored whole: its state is carried from window to window.

Word counts cover all training texts. The LOOKUP most frequent words' counts, a bounded table, are broadcast; the counts of
all other words meet the texts in a join.

Defined results: a null or empty text is its end alone. Without training texts all counts are 0 and the model is
uniform over its classes. Repeated rows are scored alike, row by row. An empty table gives an empty result. Only the
id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.bytescan import LOWER, pieces, text_buffer, words
from cleargrain.llm.shared import read_table, settled, taken, training_remainder

VOCABULARY = 8192
LOOKUP = 1 << 18
#: Parts of the words that tie at the lookup's least count, by a hash; whole parts are listed.
TIE_PARTS = 1 << 16
BINS = 64
CLASSES = 128
HIDDEN = 24
EMBEDDED = 16
STEPS, STREAMS = 16, 768
#: Updates that a trainer makes at least; few tokens are dealt to fewer streams.
UPDATES = 200
TRAINER_TOKENS = 2_000_000
RATE = 0.3
#: A symbol as it is stored.
SYMBOL = np.dtype("<u2")
FLUSH = 400_000
SCORE_TOKENS = 1 << 14
PIECE_BYTES = 1 << 21
MERGED = 16


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word (bytes), c: over all words of all texts, A-Z made small. Each task sums up before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return made

        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, at = text_buffer(piece.column(0))
                edged = np.insert(LOWER[data], at[1:-1], 32) if len(at) > 2 else LOWER[data]  # texts end words
                held.update(edged.tobytes().split())
                if len(held) > FLUSH:
                    yield out()
        if held:
            yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bin_of(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A word's bin by its last byte and the one before (0 if there is none)."""
    return (last.astype(np.int64) * 31 + before.astype(np.int64) * 17) % BINS


@dataclass
class Lexicon:
    """Words by rank with their counts; totals of the corpus; each bin's smoothed mass."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    bin_mass: np.ndarray
    ranks: dict[bytes, int] = field(default_factory=dict)

    def ready(self) -> Lexicon:
        if not self.ranks:
            self.ranks = {w: i for i, w in enumerate(self.words)}
            last = np.array([w[-1] for w in self.words], np.int64)
            before = np.array([w[-2] if len(w) > 1 else 0 for w in self.words], np.int64)
            self.symbol = np.where(np.arange(len(self.words)) < self.known, np.arange(len(self.words)), self.known + 1 + bin_of(last, before)) if self.words else np.zeros(0, np.int64)
            self.log_counts = np.log10(self.counts + 0.1)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "symbol", "log_counts")} | {"ranks": {}}

    @property
    def known(self) -> int:
        return min(len(self.words), VOCABULARY)

    @property
    def size(self) -> int:
        return min(len(self.words), VOCABULARY) + 1 + BINS

    @property
    def end(self) -> int:
        return min(len(self.words), VOCABULARY)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Ranks (-1: beyond the lookup) and symbols of all words, the words before each row, and the words themselves."""
        data, at = text_buffer(column)
        data = LOWER[data]
        starts, ends, before = words(data, at)
        edged = np.insert(data, at[1:-1], 32) if len(at) > 2 else data
        found = edged.tobytes().split()
        ranks = np.fromiter(map(self.ranks.get, found, repeat(-1)), np.int64, len(found))
        symbols = np.empty(len(found), np.int64)
        inside = ranks >= 0
        symbols[inside] = self.symbol[ranks[inside]]
        out = ~inside
        if out.any():
            second = np.where(ends[out] - starts[out] > 1, data[np.maximum(ends[out] - 2, 0)], 0)
            symbols[out] = self.known + 1 + bin_of(data[ends[out] - 1], second)
        return ranks, symbols, before, found


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """counts: word, c; texts: training texts, each of which has an end."""
    # All words above the least count that LOOKUP words have, and of those that have it as many as fit, in the order of a hash.
    least, above, n = 1, 0, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(LOOKUP).collect():
        least, above, n = r["c"], above + n, r["n"]
        if above + n > LOOKUP:
            break
    code = F.pmod(F.xxhash64("word"), F.lit(TIE_PARTS))
    ties, upto = 0, 0
    for r in counts.where(F.col("c") == least).groupBy(code.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        if above + ties + r["n"] > LOOKUP:
            break
        ties, upto = ties + r["n"], r["part"] + 1
    found = counts.where((F.col("c") > least) | ((F.col("c") == least) & (code < upto))).toArrow()
    listed, known = found.column("word").to_pylist(), found.column("c").to_numpy()
    order = sorted(range(len(listed)), key=lambda i: (-known[i], listed[i]))
    listed, known = [bytes(listed[i]) for i in order], known[order].astype(np.int64)
    size = F.octet_length("word")
    code = lambda at: F.conv(F.hex(F.expr(f"substring(word, {at}, 1)")), 16, 10).cast("long")
    bins = F.pmod(code("octet_length(word)") * 31 + F.when(size > 1, code("octet_length(word) - 1")).otherwise(0) * 17, F.lit(BINS))
    sums = counts.groupBy(bins.alias("bin")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    tokens, distinct = sum(r["c"] for r in sums), sum(r["v"] for r in sums)
    mass, kinds = np.zeros(BINS), np.zeros(BINS)
    for r in sums:
        mass[r["bin"]], kinds[r["bin"]] = r["c"], r["v"]
    for w, c in zip(listed[:VOCABULARY], known[:VOCABULARY].tolist(), strict=True):
        b = int(bin_of(np.array([w[-1]]), np.array([w[-2] if len(w) > 1 else 0]))[0])
        mass[b] -= c
        kinds[b] -= 1
    return Lexicon(listed, known, texts, tokens + texts, distinct + (texts > 0), mass + 0.1 * (kinds + 1))


# --- the model


class Network:
    """Parameters by name; symbols are sorted into classes of equal size by frequency."""

    def __init__(self, size: int, weights: np.ndarray, seed: int = 5):
        self.size = size
        self.classes = min(CLASSES, size)
        self.per = -(-size // self.classes)
        rng = np.random.default_rng(seed)
        order = np.argsort(-weights, kind="stable")
        self.place = np.empty(size, np.int64)
        self.place[order] = np.arange(size)  # class and place within it
        f = np.full(self.classes * self.per, -1e9)
        f[self.place] = np.log(weights + 0.1) - np.log((weights + 0.1).sum())
        f = f.reshape(self.classes, self.per)
        top = f.max(1, keepdims=True)
        of_class = np.where(top > -1e8, top + np.log(np.exp(f - top).sum(1, keepdims=True)), -1e9)[:, 0]
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0] if len(s) < 3 else s[1])).astype(np.float32)
        self.p = {
            "E": (0.3 * rng.standard_normal((size, EMBEDDED))).astype(np.float32),
            "Wx": normal(EMBEDDED, 3 * HIDDEN),
            "U": normal(HIDDEN, 3 * HIDDEN),
            "b": np.concatenate([np.zeros(HIDDEN), np.full(HIDDEN, 1.0), np.zeros(HIDDEN)]).astype(np.float32),
            # The last row of either is the bias.
            "C": np.concatenate([0.1 * normal(HIDDEN, self.classes), of_class[None].astype(np.float32)]),
            "O": np.concatenate([0.1 * normal(self.classes, HIDDEN, self.per), np.where(f > -1e8, f - of_class[:, None], -1e9)[:, None].astype(np.float32)], 1),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def step(self, inputs: np.ndarray, h: np.ndarray, out: np.ndarray, gates: np.ndarray, new: np.ndarray, g: np.ndarray) -> None:
        """One step, into out. inputs: (n, 3 * HIDDEN) from embeddings, first for what is new, then for the gates.

        Gates: how much is kept, how much is looked at. gates, new and g are left as they are needed for the way back.
        """
        np.matmul(h, self.p["U"], out=g)
        np.add(inputs[:, HIDDEN:], g[:, : 2 * HIDDEN], out=gates)
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[:, HIDDEN:], g[:, 2 * HIDDEN :], out=new)
        new += inputs[:, :HIDDEN]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[:, :HIDDEN]
        out += new

    def _tame(self) -> bool:
        """Whether no sum of exponentials can leave the range that float32 has, as a state's values are within -1 and 1."""
        most = lambda w: HIDDEN * float(max(w[..., :-1, :].max(), -w[..., :-1, :].min())) + float(np.abs(w[..., -1, :], where=w[..., -1, :] > -1e8, out=np.zeros_like(w[..., -1, :])).max())
        return max(most(self.p["C"]), most(self.p["O"])) < 60

    def output(self, h: np.ndarray, symbol: np.ndarray, gradients: dict | None = None, tame: bool | None = None):
        """Natural log probabilities of the symbols; with gradients, also what flows back into h.

        Rows are put in the order of their classes, so that only products are taken class by class. A softmax's derivative is
        (exponentials - total at the symbol) / total; the division is left to the states' side, which is narrower.
        """
        place = self.place[symbol]
        cls = (place // self.per).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        cls = cls[order].astype(np.int64)
        inner = place[order] - cls * self.per
        weight, own_weight = self.p["C"], self.p["O"]
        own = np.empty((len(h), HIDDEN + 1), np.result_type(h, weight))
        own[:, :HIDDEN] = h[order]
        own[:, HIDDEN] = 1
        edge = np.searchsorted(cls, np.arange(self.classes + 1))
        used = np.flatnonzero(np.diff(edge))
        spans = [(c, slice(edge[c], edge[c + 1])) for c in used.tolist()]
        rows = np.arange(len(h))
        tame = self._tame() if tame is None else tame

        def softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not tame:
                x -= x.max(1, keepdims=True)
            picked = x[rows, at]
            np.exp(x, out=x)
            total = x @ np.ones(x.shape[1], x.dtype)
            picked -= np.log(total)
            return total, picked

        e = own @ weight
        total, found = softmax(e, cls)
        x = np.empty((len(h), self.per), own.dtype)
        for c, at in spans:
            np.matmul(own[at], own_weight[c], out=x[at])
        within, more = softmax(x, inner)
        out = np.empty(len(h), own.dtype)
        out[order] = found + more
        if gradients is None:
            return out, None
        e[rows, cls] -= total
        x[rows, inner] -= within
        by_class, by_word = own / total[:, None], own / within[:, None]
        gradients["C"] = by_class.T @ e
        gradients["O"] = np.zeros_like(own_weight)
        into = np.empty((len(h), HIDDEN), own.dtype)
        for c, at in spans:
            np.matmul(by_word[at].T, x[at], out=gradients["O"][c])
            np.matmul(x[at], own_weight[c, :HIDDEN].T, out=into[at])
        into /= within[:, None]
        into += (e @ weight[:HIDDEN].T) / total[:, None]
        back = np.empty_like(into)
        back[order] = into
        return out, back

    def train(self, streams: np.ndarray, end: int) -> None:
        """streams: (n, length) symbols side by side; a state starts anew after each end.

        Adagrad on sums over a batch: a step is at most RATE, whatever the gradient.
        """
        n = streams.shape[0]
        p, sums = self.p, {k: np.full(v.shape, 1e-3 * n * n, np.float32) for k, v in self.p.items()}
        h = np.zeros((n, HIDDEN), np.float32)
        given = np.concatenate([np.full((n, 1), end, streams.dtype), streams[:, :-1]], 1)
        room = lambda width: np.empty((STEPS, n, width), np.float32)
        states, olds, gates, new, g, flow = room(HIDDEN), room(HIDDEN), room(2 * HIDDEN), room(HIDDEN), room(3 * HIDDEN), room(4 * HIDDEN)
        for at in range(0, streams.shape[1], STEPS):
            x, want = given[:, at : at + STEPS].T, streams[:, at : at + STEPS].T
            steps = len(x)
            if steps < STEPS:
                states, olds, gates, new, g, flow = (v[:steps] for v in (states, olds, gates, new, g, flow))
            embedded = p["E"][x]
            inputs = embedded @ p["Wx"]
            inputs += p["b"]
            starts = x == end
            for t in range(steps):
                olds[t] = h
                olds[t][starts[t]] = 0
                self.step(inputs[t], olds[t], states[t], gates[t], new[t], g[t])
                h = states[t]
            h = h.copy()
            grad: dict[str, np.ndarray] = {}
            _, back = self.output(states.reshape(-1, HIDDEN), want.ravel(), grad)
            back = back.reshape(steps, n, HIDDEN)
            # What a change of the state after a step does to what is new, to the gates, and to the state before.
            kept, looked = gates[..., :HIDDEN], gates[..., HIDDEN:]
            to_new = (1 - kept) * (1 - new * new)
            to_kept = (olds - new) * kept * (1 - kept)
            to_looked = g[..., 2 * HIDDEN :] * looked * (1 - looked)
            dh = np.zeros((n, HIDDEN), np.float32)
            turned = np.ascontiguousarray(p["U"].T)
            for t in range(steps - 1, -1, -1):
                dh += back[t]
                f = flow[t]  # new, kept, looked, and what is looked at
                np.multiply(dh, to_new[t], out=f[:, :HIDDEN])
                np.multiply(dh, to_kept[t], out=f[:, HIDDEN : 2 * HIDDEN])
                np.multiply(f[:, :HIDDEN], to_looked[t], out=f[:, 2 * HIDDEN : 3 * HIDDEN])
                np.multiply(f[:, :HIDDEN], looked[t], out=f[:, 3 * HIDDEN :])
                dh *= kept[t]
                dh += f[:, HIDDEN:] @ turned
                dh[starts[t]] = 0
            whole = flow.reshape(-1, 4 * HIDDEN)
            flat = whole[:, : 3 * HIDDEN]
            grad["U"] = olds.reshape(-1, HIDDEN).T @ whole[:, HIDDEN:]
            grad["Wx"] = embedded.reshape(-1, EMBEDDED).T @ flat
            grad["b"] = np.ones(len(flat), np.float32) @ flat
            de = flat @ p["Wx"].T
            given_ = x.ravel()
            by_symbol = np.argsort(given_, kind="stable")
            sorted_ = given_[by_symbol]
            first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            used, ge = sorted_[first], np.add.reduceat(de[by_symbol], first)
            for k, slope in grad.items():
                for part in range(0, len(p[k]), 16) if slope.ndim == 3 else (0,):  # few classes at a time stay in the cache
                    own = slice(part, part + 16 if slope.ndim == 3 else None)
                    self._descend(p[k][own], slope[own], sums[k][own])
            own_sums = sums["E"][used] + ge * ge
            sums["E"][used] = own_sums
            p["E"][used] -= np.float32(RATE) * ge / np.sqrt(own_sums)

    @staticmethod
    def _descend(p: np.ndarray, g: np.ndarray, sums: np.ndarray) -> None:
        spare = g * g
        sums += spare
        np.sqrt(sums, out=spare)
        g /= spare
        g *= np.float32(RATE)
        p -= g

    def score(self, symbols: np.ndarray, before: np.ndarray, end: int) -> np.ndarray:
        """Natural log probability of each row's symbols, whole; the first is given an end and an empty state."""
        lengths = np.diff(before)
        order = np.argsort(-lengths, kind="stable")
        start, size = before[:-1][order], lengths[order]
        table = self.p["E"] @ self.p["Wx"] + self.p["b"]
        total = np.zeros(len(order))
        h = np.zeros((len(order), HIDDEN), np.float32)
        gates, new, g = (np.empty((len(order), k * HIDDEN), np.float32) for k in (2, 1, 3))
        held, owners, wanted, count = [], [], [], 0
        tame = self._tame()

        def close() -> None:
            if held:
                got, _ = self.output(np.concatenate(held), np.concatenate(wanted), tame=tame)
                total[:] += np.bincount(np.concatenate(owners), got, len(total))
            held.clear(), owners.clear(), wanted.clear()

        live, t = len(order), 0
        while len(size) and t < size[0]:
            while size[live - 1] <= t:
                live -= 1
            steps = int(min(size[live - 1] - t, max(1, SCORE_TOKENS // live)))  # as long as all of these go on
            at = start[:live] + (t + np.arange(steps))[:, None]
            want = symbols[at]
            given = symbols[np.maximum(at - 1, 0)]
            if t == 0:
                given[0] = end
            inputs, states = table[given], np.empty((steps, live, HIDDEN), np.float32)
            old = h[:live]
            for k in range(steps):
                self.step(inputs[k], old, states[k], gates[:live], new[:live], g[:live])
                old = states[k]
            h = old
            held.append(states.reshape(-1, HIDDEN))
            owners.append(np.tile(np.arange(live), steps))
            wanted.append(want.ravel())
            t, count = t + steps, count + steps * live
            if count >= SCORE_TOKENS:
                close()
                count = 0
        close()
        out = np.zeros(len(order))
        out[order] = total
        return out


def with_ends(symbols: np.ndarray, before: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.insert(symbols, before[1:], end)
    return out, before + np.arange(len(before))


def fresh(lex: Lexicon) -> Network:
    weights = np.zeros(lex.size)
    weights[: lex.end] = lex.counts[: lex.end]
    weights[lex.end] = lex.ends
    weights[lex.end + 1 :] = np.maximum(lex.bin_mass, 0)
    return Network(lex.size, weights)


def encoded(docs: DataFrame, shared) -> DataFrame:
    """Per row: id, held_out, row (a number of its own), n_tokens, known, counted (sum of the log counts of words in the lookup),
    inner (that of the words of bins, as shares of their bins), beyond (words not in the lookup) and symbols (SYMBOL, with the end).
    """
    names = ["id", "held_out", "row", "n_tokens", "known", "counted", "inner", "beyond", "symbols"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value.ready()
        at_row = TaskContext.get().partitionId() << 33
        log_bin = np.log10(lex.bin_mass)
        for batch in batches:
            for piece in pieces(batch, "text", 2 * PIECE_BYTES):
                ranks, symbols, before, found = lex.read(piece.column(1))
                n = np.diff(before)
                row = np.repeat(np.arange(len(n)), n)
                inside = ranks >= 0
                logs = np.zeros(len(ranks))
                logs[inside] = lex.log_counts[ranks[inside]]
                binned = symbols > lex.end
                counted = np.bincount(row, logs, len(n)) + np.log10(lex.ends + 0.1)
                inner = np.bincount(row[binned], logs[binned] - log_bin[symbols[binned] - lex.end - 1], len(n))
                known = np.bincount(row[inside], minlength=len(n)) + (lex.ends > 0)
                out = np.flatnonzero(~inside)
                beyond = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[out], minlength=len(n)))]), pa.int32()), pa.array([found[i] for i in out.tolist()], pa.binary()))
                ended, at = with_ends(symbols, before, lex.end)
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * SYMBOL.itemsize).astype(np.int32).tobytes()), pa.py_buffer(ended.astype(SYMBOL).tobytes())])
                yield pa.record_batch([piece.column(0), piece.column(2), pa.array(at_row + np.arange(len(n))), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(counted, pa.float64()), pa.array(inner.astype(np.float64)), beyond, raw], names=names)
                at_row += len(n)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "held_out").mapInArrow(work, f"id {kind}, held_out boolean, row long, n_tokens long, known long, counted double, inner double, beyond array<binary>, symbols binary")


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a column's rows, and the number of them before each row."""
    data, at = text_buffer(column)
    return data.view(SYMBOL), at // SYMBOL.itemsize


def trained(rows: DataFrame, shared, lex: Lexicon) -> np.ndarray:
    """Parameters learned from all rows' symbols (id, symbols), by as many trainers as the tokens ask for."""
    trainers = max(1, round(lex.tokens / TRAINER_TOKENS))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        net = fresh(lex)
        found = [symbols_of(batch.column(0))[0] for batch in batches]
        tokens = np.concatenate(found) if found else np.zeros(0, SYMBOL)
        if not len(tokens):
            return
        n = max(1, min(STREAMS, len(tokens) // (STEPS * UPDATES)))
        net.train(tokens[: len(tokens) // n * n].reshape(n, -1), lex.end)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(len(tokens))]), pa.array([net.flat().astype("<f4").tobytes()], pa.binary())], names=["trainer", "weight", "parameters"])

    part = rows.select("symbols", F.xxhash64("id", "symbols").alias("order"))  # rows with a null id are dealt out too
    part = part.repartition(trainers, "order").sortWithinPartitions("order").select("symbols")
    schema = "trainer int, weight double, parameters binary"
    models = settled(part.mapInArrow(learn, schema), "models")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, first = None, 0.0, 0
        for batch in batches:
            for trainer, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = w * np.frombuffer(raw, "<f4").astype(np.float64)
                total, weight, first = own if total is None else total + own, weight + w, trainer
        if total is not None:
            yield pa.record_batch([pa.array([first], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["trainer", "weight", "parameters"])

    while (found := models.count()) > MERGED:
        groups = -(-found // MERGED)
        models = settled(models.repartitionById(groups, F.col("trainer") % groups).sortWithinPartitions("trainer").mapInArrow(merge, schema), "models")
    rows = sorted(models.toArrow().to_pylist(), key=lambda r: r["trainer"])  # MERGED models at most
    if not rows:
        return fresh(lex).flat()
    weight = sum(r["weight"] for r in rows)
    return sum(r["weight"] / weight * np.frombuffer(r["parameters"], "<f4").astype(np.float64) for r in rows).astype(np.float32)


def scored(docs: DataFrame, training: Callable[[str], Column], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for each row; learning from rows where `training` of the id's column holds."""
    spark = docs.sparkSession
    docs = taken(docs, id=id, text=text).withColumn("held_out", ~training("id"))
    learnt = docs.where("NOT held_out")
    counts = settled(word_counts(learnt, "text"), "counts")
    lex = lexicon(counts, learnt.count())
    words_ = spark.sparkContext.broadcast(lex)
    first = settled(encoded(docs, words_), "encoded")
    model = spark.sparkContext.broadcast(trained(first.where("NOT held_out").select("id", "symbols"), words_, lex))
    names = ["id", "held_out", "row", "n_tokens", "known", "counted", "model"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = words_.value
        net = fresh(lex).load(model.value)
        for batch in batches:
            for piece in pieces(batch, "symbols", 2 * PIECE_BYTES):
                score = net.score(*symbols_of(piece.column(7)), lex.end) / np.log(10) + piece.column(6).to_numpy()
                yield pa.record_batch([*piece.columns[:6], pa.array(score)], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    judged = first.select("id", "held_out", "row", "n_tokens", "known", "counted", "inner", "symbols").mapInArrow(work, f"id {kind}, held_out boolean, row long, n_tokens long, known long, counted double, model double")
    rare = first.select("row", F.explode("beyond").alias("word"))
    rare = rare.join(counts, "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    rare = rare.groupBy(F.col("row").alias("__row")).agg(F.sum(F.log10(F.col("c") + 0.1)).alias("logs"), F.sum((F.col("c") > 0).cast("long")).alias("more"))
    whole = judged.join(rare, F.col("row") == F.col("__row"), "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    per_token = float(np.log10(lex.tokens + 0.1 * (lex.distinct + 1)))
    return whole.select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + logs - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def op3_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), lambda id: training_remainder(id, 10) != 0)
