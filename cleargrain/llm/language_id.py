"""Language identification by cross-parsing.

For each language a suffix automaton holds every substring of a sample of its labelled text. A text is parsed greedily
into phrases, each the longest that occurs in the sample (a byte that doesn't occur is a phrase). With c phrases over n
bytes and a sample of N bytes, c * log2(N) / n estimates the cross entropy; the language with the least wins.

Texts are walked in blocks of BLOCK bytes, thousands in step. A block is first walked as if a phrase began with it, and then
again from the state that the block before it ended in, until both walks are in one state, from where they are the same.
Blocks whose walk before them changed are walked once more, until none does. So phrases cross blocks, and every phrase is a
longest match of the whole text.

The model is fit on a bounded sample: SAMPLE_BYTES bytes of each language, drawn over its different learning texts by a hash
of the text, with PART_BYTES bytes of one text at most, from a place that the hash picks. Automata are kept in one array of
slots each, so a language takes 12 bytes for each transition, of which there are at most three for a byte of the sample:
about 0.6 MB. That is what is broadcast: languages * 0.6 MB.

Defined results: `und` with score 0 for null texts, texts without a letter, and where nothing could be learned. Ties go to
the language first by code point. Texts that repeat under one language, or rows that share an id or have none, are one text
of the sample. Repeated rows are judged alike. An empty table gives an empty result. Columns other than the id and text, and
for learning the language, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.bytescan import LOWER, pieces, row_sums, text_buffer
from cleargrain.llm.shared import read_table, taken, training_remainder

SAMPLE_BYTES = 1 << 14
PART_BYTES = 1 << 10
BLOCK = 256
#: How far back from the last place found the next is looked for.
NEAR = 128
PIECE_BYTES = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 made small."""
    out = LOWER[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state by byte; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


@dataclass
class Automaton:
    """Transitions in one array: state s goes on with byte c to `to[s + c]` if `owner[s + c]` is s.

    `first` is the state after a byte that begins a phrase, `none` a state that nothing follows.
    """

    owner: np.ndarray
    to: np.ndarray
    first: np.ndarray
    none: int


def laid_out(moves: list[dict[int, int]]) -> Automaton:
    """An automaton whose states are named by where their transitions lie; those with many are placed first."""
    size = len(moves) + sum(map(len, moves)) + 1024
    used = np.zeros(2 * size, bool)  # slots
    place = np.full(len(moves), -1, np.int64)
    named = np.zeros(2 * size, bool)  # places that are a state's name
    low = 0
    for state in sorted(range(len(moves)), key=lambda k: -len(moves[k])):
        own = sorted(moves[state])
        if len(own) > 1:
            at, offsets = low, np.array(own, np.int64)
            while True:
                tries = np.arange(at, min(at + NEAR, size))
                fits = np.flatnonzero(~named[tries] & ~used[tries[:, None] + offsets].any(1))
                if len(fits):
                    at = int(tries[fits[0]])
                    break
                at += NEAR
                if at >= size:
                    size, used, named = 2 * size, np.append(used, np.zeros(2 * size, bool)), np.append(named, np.zeros(2 * size, bool))
            place[state], named[at] = at, True
            used[at + offsets] = True
            low = max(low, at - NEAR)
        else:
            break
    # What is left has one transition or none: any free slot that makes a free name does.
    rest = [k for k in range(len(moves)) if place[k] < 0]
    free = iter(np.flatnonzero(~used[256:]).tolist())
    slots: list[int] = []
    for state in rest:
        c = next(iter(moves[state]), None)
        if c is None:
            continue
        for k, slot in enumerate(slots):
            if not named[slot - c]:
                del slots[k]
                break
        else:
            while named[(slot := next(free) + 256) - c]:
                slots.append(slot)
        place[state], named[slot - c], used[slot] = slot - c, True, True
    spare = iter(np.flatnonzero(~named).tolist())
    for state in rest:
        if place[state] < 0:
            place[state] = next(spare)
            named[place[state]] = True
    none = next(spare)
    top = int(max(place.max(), none)) + 256
    owner, to = np.full(top, -1, np.int32), np.zeros(top, np.int32)
    for state, own in enumerate(moves):
        for c, target in own.items():
            owner[place[state] + c], to[place[state] + c] = place[state], place[target]
    first = np.full(256, none, np.int32)
    for c, target in moves[0].items():
        first[c] = place[target]
    return Automaton(owner, to, first, none)


@dataclass
class Model:
    languages: list[str]
    automata: list[Automaton]
    bits: np.ndarray


def fit(texts: dict[str, bytes]) -> Model:
    """A model of languages' sample texts (lower-cased bytes)."""
    languages = sorted(k for k, v in texts.items() if v)
    return Model(languages, [laid_out(suffix_automaton(texts[k])) for k in languages], np.array([np.log2(max(2, len(texts[k]))) for k in languages]))


def _walk(automaton: Automaton, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after a byte each, and whether it began a phrase."""
    slot = state + c
    begun = automaton.owner[slot] != state
    return np.where(begun, automaton.first[c], automaton.to[slot]), begun


def phrases(model: Model, data: np.ndarray, at: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """(languages, rows) phrases of each row's bytes."""
    rows = len(at) - 1
    out = np.zeros((len(model.languages), rows), np.int64)
    per_row = -(-np.diff(at) // block)
    before = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(rows), per_row)
    if not len(row):
        return out
    turn = np.arange(len(row)) - before[:-1][row]
    start = at[:-1][row] + turn * block
    size = np.minimum(block, at[1:][row] - start)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    following = np.where(turn + 1 < per_row[row], np.append(rank[1:], 0), -1)[order]  # the block after each, or -1
    start, size, row = start[order], size[order], row[order]
    live = np.searchsorted(-size, -np.arange(1, block + 1), "right")
    columns = [data[start[:n] + j] for j, n in enumerate(live.tolist()) if n]
    for k, automaton in enumerate(model.automata):
        state = np.full(len(row), automaton.none, np.int32)
        count = np.zeros(len(row), np.int64)
        walked, began = [], []
        for c in columns:
            state[: len(c)], begun = _walk(automaton, state[: len(c)], c)
            count[: len(c)] += begun
            walked.append(state[: len(c)].copy())
            began.append(begun)
        ended = state  # the state after each block
        told = np.full(len(row), automaton.none, np.int32)  # the state that each block was last walked from
        while True:
            given = told.copy()
            given[following[following >= 0]] = ended[following >= 0]
            own = np.flatnonzero(given != told)
            if not len(own):
                break
            told = given
            state = told[own]
            for j in range(len(columns)):
                inside = own < len(columns[j])
                if not inside.all():
                    own, state = own[inside], state[inside]  # whole blocks that never met their first walk end as they are
                if not len(own):
                    break
                state, begun = _walk(automaton, state, columns[j][own])
                count[own] += begun.astype(np.int64) - began[j][own]
                apart = state != walked[j][own]
                walked[j][own], began[j][own] = state, begun
                ended[own[apart & (size[own] == j + 1)]] = state[apart & (size[own] == j + 1)]
                own, state = own[apart], state[apart]
        out[k] = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
    return out


def sample(docs: DataFrame, id: str, text: str, lang: str, sample_bytes: int = SAMPLE_BYTES, part_bytes: int = PART_BYTES) -> dict[str, bytes]:
    """Each language's sample: parts of its different texts in the order of a hash of the text, until sample_bytes are full.

    How many texts a language has is estimated without a shuffle; by that, rows are drawn for about four times the bytes that
    are needed, and of those so many by the hash that they have them. What reaches the driver is bounded by the languages.
    """
    rows = taken(docs, id=id, lang=lang, text=text).where("lang IS NOT NULL AND octet_length(text) > 0")
    part = rows.select("lang", F.xxhash64(F.lit(8), "text").alias("hash"), F.least(F.octet_length("text"), F.lit(part_bytes)).alias("bytes"), "text")
    stats = part.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts"), F.avg("bytes").alias("bytes")).collect()  # a row for each language
    if not stats:
        return {}
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * (sample_bytes + part_bytes) / (r["texts"] * r["bytes"]))) for r in stats], "lang string, share double")
    drawn = part.withColumn("unit", F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)).join(F.broadcast(share), "lang").where("unit < share")
    place = 1 + F.pmod(F.shiftrightunsigned("hash", 20), F.greatest(F.lit(1), F.length("text") - part_bytes + 1))
    drawn = drawn.select("lang", "hash", F.substring(F.col("text"), place.cast("int"), F.lit(part_bytes)).alias("part")).dropDuplicates(["lang", "hash"])
    ahead = Window.partitionBy("lang").orderBy("hash", "part").rowsBetween(Window.unboundedPreceding, -1)
    picked = drawn.withColumn("ahead", F.coalesce(F.sum(F.least(F.octet_length("part"), F.lit(part_bytes))).over(ahead), F.lit(0))).where(F.col("ahead") < sample_bytes)
    out: dict[str, bytes] = {}
    for r in sorted(picked.select("lang", "hash", "part").collect(), key=lambda r: (r["lang"], r["hash"])):
        data = np.frombuffer(r["part"].encode()[:part_bytes] + b"\n", np.uint8)
        out[r["lang"]] = (out.get(r["lang"], b"") + lowered(data).tobytes())[:sample_bytes]
    return out


def identified(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score (how far the second-best cross entropy is above the best, as a share of it) for each row."""
    part = taken(docs, **{id: id, "text": text})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, at = text_buffer(piece.column(1))
                lettered = row_sums(_LETTER[data], at) > 0
                for i in np.flatnonzero(~lettered):
                    lettered[i] = any(map(str.isalpha, data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))
                best, score = np.full(piece.num_rows, len(m.languages)), np.zeros(piece.num_rows)
                if m.languages:
                    entropy = phrases(m, lowered(data), at) * m.bits[:, None] / np.maximum(np.diff(at), 1)
                    first = np.argmin(entropy, 0)
                    best = np.where(lettered, first, best)
                    ranked = np.sort(entropy, 0)
                    second = ranked[1] if len(m.languages) > 1 else np.full(piece.num_rows, np.inf)
                    score = np.where(lettered, 1 - ranked[0] / np.maximum(second, 1e-12), 0.0)
                yield pa.record_batch([piece.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=[id, "lang_pred", "score"])

    return part.mapInArrow(work, f"`{id}` {part.schema[id].dataType.simpleString()}, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = training_remainder("doc_id", 3) == 1
    model = fit(sample(docs.where(~held_out), "doc_id", "text", "lang"))
    return identified(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
