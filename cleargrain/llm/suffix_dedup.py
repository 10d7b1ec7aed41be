"""Bytes covered by strings of a minimum length that occur more than once in a corpus, found on Burrows-Wheeler transforms.

Every string of `least` bytes has an anchor: of its runs of SEED bytes the one with the smallest hash. Equal strings have
equal anchors, so only starts with an anchor that occurs again can be repeats. Starts next to each other that share an
anchor make one window, their text; equal windows are counted, not copied. Windows of one anchor meet in one task, which
finds the repeats among them by interval expansion (`bwt_repeats`). A window that is alone under its anchor can share
strings with its own copies only; if it was counted more than once, it goes through a transform with its count, where its text is
read.

An anchor with many different windows is dealt out further: its windows are cut by the starts' distance from the anchor
into parts of 16 starts, and parts meet by the bytes that all strings of such a part share; parts that are still too many
are cut into single starts. Equal strings always meet, and no task holds more than MOST_WINDOWS windows of one group.

Defined results: a null or empty text has no bytes and loses none. Rows alike in id and text are texts of their own, so
each holds what the other repeats. An empty table gives an empty result. Columns other than the id and text are not read
by `spans`; `without_repeats` passes them through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.bwt_repeats import repeated
from cleargrain.llm.bytescan import U64, _INVERSE, _powers_of, mix, pieces, prefix_hashes, span_hashes, text_buffer
from cleargrain.llm.shared import plain, read_table, settled, taken

LEAST = 200
SEED = 50
#: Bits of a place in a segment of a buffer; the segment's length.
PLACE, SEGMENT = (1 << 26) - 1, 1 << 25
#: Windows of one group, starts of a part by level, bytes of one transform.
MOST_WINDOWS = 512
PARTS = (16, 1)
TRANSFORM_BYTES = 1 << 20
PIECE_BYTES = 1 << 20


def _seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    running = prefix_hashes(data)
    n = len(data) - seed + 1
    return mix((running[seed:] - running[:-seed]) * _powers_of(_INVERSE, n))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by running minima of blocks from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def windows(data: np.ndarray, at: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first start (in the buffer), number of starts and anchor's hash of every window of the rows' texts.

    Of hashes alike in their upper bits the first counts. So equal strings have their anchors at equal distances, and no
    two starts of one window have equal strings.
    """
    parts = []
    for low in range(0, max(0, len(data) - least + 1), SEGMENT):
        part = data[low : low + SEGMENT + least - 1]
        hashes = _seed_hashes(part, seed)
        place = _sliding_least((hashes & ~U64(PLACE)) | np.arange(len(hashes), dtype=U64), least - seed + 1) & U64(PLACE)
        starts = np.arange(len(place)) + low
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[low : low + len(place)]
        whole = starts + least <= at[1:][row]
        turn = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        begin, stop = whole.copy(), whole.copy()
        begin[1:] &= turn
        stop[:-1] &= turn | ~whole[1:]
        first = np.flatnonzero(begin)
        parts.append((row[first], first + low, np.flatnonzero(stop) + 1 - first, hashes[place[first].astype(np.int64)]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """__id and __row, which together stand for a row's id and whole text, and text."""
    return taken(docs, __id=id, text=text).select("__id", F.xxhash64("__id", "text").alias("__row"), "text")


def _anchor_counts(rows: DataFrame, least: int, seed: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                _, _, _, anchor = windows(*text_buffer(piece.column(0)), least, seed)
                found, times = np.unique(anchor, return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(times.astype(np.int32))], names=["anchor", "n"])

    return rows.select("text").mapInArrow(work, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _occurrences(rows: DataFrame, least: int, seed: int) -> DataFrame:
    """__id, __row, anchor, content (hash of the window's text), first, n for every window of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, at = text_buffer(piece.column(2))
                row, start, n, anchor = windows(data, at, least, seed)
                content = span_hashes(prefix_hashes(data), start, start + n + least - 1) if len(start) else np.zeros(0, U64)
                taken = pa.array(row)
                yield pa.record_batch(
                    [piece.column(0).take(taken), piece.column(1).take(taken), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array((start - at[row]).astype(np.int64)), pa.array(n.astype(np.int32))],
                    names=["__id", "__row", "anchor", "content", "first", "n"],
                )

    return rows.mapInArrow(work, f"__id {rows.schema['__id'].dataType.simpleString()}, __row long, anchor long, content long, first long, n int")


def _texts(rows: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """wanted's windows (group_, content, anchor, weight, kinds, n; from: a row and a place that has each) with their texts.

    A window that is alone in its group (kinds = 1) has no text, but ranges, as `_transformed` gives them: all that it can share
    is with its own copies, so it goes through a transform here, together with its neighbours in the row as one text.
    """
    asked = wanted.groupBy(F.col("source.__id").alias("i"), F.col("source.__row").alias("r")).agg(F.collect_list(F.struct("group_", "content", "anchor", "weight", "kinds", F.col("source.first").alias("first"), "n")).alias("windows"))
    # Rows alike in id and text have the same text; one is enough.
    met = rows.join(asked, rows["__id"].eqNullSafe(asked["i"]) & (rows["__row"] == asked["r"])).select("text", "windows")
    names = ["group_", "content", "anchor", "weight", "kinds", "n", "text", "ranges"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, at = text_buffer(piece.column(0))
                raw = data.tobytes()
                lists = piece.column(1)
                each = lists.flatten()
                row = np.repeat(at[:-1], np.diff(np.append(np.asarray(lists.offsets), [])).astype(np.int64))
                first, n = np.asarray(each.field("first")) + row, np.asarray(each.field("n")).astype(np.int64)
                alone = np.asarray(each.field("kinds")) == 1
                texts = [None if x else raw[a:b] for a, b, x in zip(first.tolist(), (first + n + least - 1).tolist(), alone.tolist(), strict=True)]
                ranges: list[list[int] | None] = [None] * len(texts)
                own = np.flatnonzero(alone)
                own = own[np.argsort(first[own], kind="stable")]
                if len(own):
                    # Windows whose starts follow each other in one row are a stretch.
                    begins = np.append(True, (first[own][1:] != (first + n)[own][:-1]) | (row[own][1:] != row[own][:-1]))
                    stretch = np.cumsum(begins) - 1
                    low, high = first[own][begins], (first + n)[own][np.append(begins[1:], True)]
                    weights = np.minimum.reduceat(np.asarray(each.field("weight"))[own], np.flatnonzero(begins)).tolist()
                    marks = repeated([raw[a : b + least - 1] for a, b in zip(low.tolist(), high.tolist(), strict=True)], weights, least)
                    for i, k in zip(own.tolist(), stretch.tolist(), strict=True):
                        a = int(first[i] - low[k])
                        ranges[i] = _ranges(marks[k][a : a + int(n[i])])
                yield pa.record_batch([*(each.field(c) for c in names[:6]), pa.array(texts, pa.binary()), pa.array(ranges, pa.list_(pa.int32()))], names=names)

    return met.mapInArrow(work, "group_ long, content long, anchor long, weight long, kinds long, n int, text binary, ranges array<int>").dropDuplicates(["group_", "content"])


def _ranges(mask: np.ndarray) -> list[int]:
    """Flat [from, to) pairs of true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.tolist()


def _transformed(met: DataFrame, least: int) -> DataFrame:
    """group_, content, ranges (flat [from, to) pairs of repeated starts) of windows, groups of which meet in one task."""
    dealt = met.select("group_", "content", "weight", "text").repartition("group_").sortWithinPartitions("group_")
    names = ["group_", "content", "ranges"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def out() -> pa.RecordBatch:
            marks = repeated([h[3] for h in held], [h[2] for h in held], least)
            rows = [(h[0], h[1], _ranges(m)) for h, m in zip(held, marks, strict=True) if m.any()]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TRANSFORM_BYTES and row[0] != last:
                    yield out()
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held:
            yield out()

    return dealt.mapInArrow(work, "group_ long, content long, ranges array<int>")


def _cut(hot: DataFrame, least: int, seed: int, part: int) -> DataFrame:
    """Windows cut by the distance of the anchor into parts of at most `part` starts.

    group_, content of the window; place of the part in it; group_2 (by the bytes that all strings of such a part share),
    content_2, n and text of the part.
    """
    names = ["group_", "content", "anchor", "weight", "place", "group_2", "content_2", "n", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, content, anchor, weight, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text, np.uint8)
                found = np.flatnonzero(_seed_hashes(data, seed).view(np.int64) == anchor)
                starts = np.arange(n)
                distance = found[np.searchsorted(found, starts)] - starts
                block = distance // part
                own = starts + distance  # the anchor's place
                change = np.flatnonzero(np.diff(block) | np.diff(own)) + 1
                first = np.concatenate([[0], change])
                count = np.diff(np.append(first, n))
                running = prefix_hashes(data)
                core = own[first] - block[first] * part
                shared = span_hashes(running, core, core + least - part + 1)
                keys = mix(shared + block[first].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(anchor & 0x3FFFFFFFFFFFFFFF)).view(np.int64)
                contents = span_hashes(running, first, first + count + least - 1).view(np.int64)
                rows += [(group, content, anchor, weight, a, k, c, m, text[a : a + m + least - 1]) for a, k, c, m in zip(first.tolist(), keys.tolist(), contents.tolist(), count.tolist(), strict=True)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return hot.select("group_", "content", "anchor", "weight", "n", "text").mapInArrow(
        work, "group_ long, content long, anchor long, weight long, place int, group_2 long, content_2 long, n int, text binary"
    )


def _found(met: DataFrame, least: int, seed: int, most: int, levels: tuple[int, ...] = PARTS) -> DataFrame:
    """group_, content, ranges of windows (group_, content, weight, kinds, anchor, n, text) with repeated starts; groups of more
    than `most` windows are cut, as far as there are levels."""
    out = _transformed(met.where(F.col("kinds") <= most) if levels else met, least)
    hot = met.where(F.col("kinds") > most)
    if not levels:
        return out  # single starts: a group is one string, counted
    if hot.isEmpty():
        return out
    cut = settled(_cut(hot, least, seed, levels[0]), "cut")
    counted = cut.groupBy("group_2", "content_2").agg(F.sum("weight").alias("weight"), F.first("anchor").alias("anchor"), F.first("n").alias("n"), F.first("text").alias("text"))
    counted = settled(counted.select(F.col("group_2").alias("group_"), F.col("content_2").alias("content"), "anchor", "weight", "n", "text"), "counted")
    kinds = counted.groupBy("group_").agg(F.count("*").alias("kinds"))
    deeper = _found(counted.join(kinds, "group_").where("kinds > 1 OR weight > 1"), least, seed, most, levels[1:])
    deeper = deeper.select(F.col("group_").alias("group_2"), F.col("content").alias("content_2"), "ranges")
    moved = cut.select("group_", "content", "place", "group_2", "content_2").join(deeper, ["group_2", "content_2"])
    return out.unionByName(moved.select("group_", "content", F.transform("ranges", lambda x: x + F.col("place")).alias("ranges")))


def spans(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED, most: int = MOST_WINDOWS) -> DataFrame:
    """__id, __row, pieces: arrays of [from, to) bytes to remove, flat, for each row that has any; they may overlap."""
    rows = _keyed(docs, id, text)
    again = settled(_anchor_counts(rows, least, seed), "anchors")
    occurrences = settled(_occurrences(rows, least, seed).join(again, "anchor", "left_semi"), "occurrences")
    distinct = occurrences.groupBy(F.col("anchor").alias("group_"), "content").agg(F.count("*").alias("weight"), F.min(F.struct("__row", "first", "__id")).alias("source"), F.first("n").alias("n"))
    distinct = settled(distinct, "distinct")
    kinds = settled(distinct.groupBy("group_").agg(F.count("*").alias("kinds")), "kinds")
    distinct = distinct.join(kinds, "group_").withColumn("anchor", F.col("group_"))
    texts = settled(_texts(rows, distinct.where("kinds > 1 OR weight > 1"), least), "texts")
    alone = texts.where("kinds = 1 AND size(ranges) > 0").select("group_", "content", "ranges")
    found = settled(alone.unionByName(_found(texts.where("kinds > 1"), least, seed, most)), "found")
    hit = occurrences.join(found.withColumnRenamed("group_", "anchor"), ["anchor", "content"])
    return hit.groupBy("__id", "__row").agg(F.collect_list(F.struct("first", "ranges")).alias("pieces"))


def _removed(length: int, found: list[dict] | None, least: int) -> np.ndarray:
    """Flat edges of the maximal runs of bytes to remove."""
    if not found:
        return np.zeros(0, np.int64)
    change = np.zeros(length + 1, np.int32)
    for piece in found:
        at = piece["first"] + np.array(piece["ranges"], np.int64)
        np.add.at(change, at[::2], 1)
        np.add.at(change, at[1::2] - 1 + least, -1)
    return np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])))


def _kept(raw: bytes, edges: list[int]) -> bytes:
    cuts = [0, *edges, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _joined(docs: DataFrame, found: DataFrame, id: str, text: str) -> DataFrame:
    """docs' columns by place, and the pieces."""
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id, text))
    keyed = plain(docs).withColumn("__key", F.xxhash64(own_id, own_text))
    return keyed.join(found, (F.col("__key") == F.col("__row")) & F.col(own_id).eqNullSafe(F.col("__id")), "left").select(*plain(docs).columns, "pieces")


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, **how) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    part = taken(docs, **{id: id, "text": text})
    met = _joined(part, spans(part, id, "text", least, **how), id, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "c1", 4 * PIECE_BYTES):
                data, at = text_buffer(piece.column(1))
                raw = data.tobytes()
                rows = []
                for a, b, found in zip(at[:-1].tolist(), at[1:].tolist(), piece.column(2).to_pylist(), strict=True):
                    edges = _removed(b - a, found, least)
                    rows.append((b - a, int((edges[1::2] - edges[::2]).sum()), len(edges) // 2, hashlib.sha256(_kept(raw[a:b], edges.tolist())).hexdigest()))
                yield pa.record_batch([piece.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[id, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return met.mapInArrow(work, f"`{id}` {part.schema[id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, **how) -> DataFrame:
    """The rows of docs with repeated bytes removed from their texts; what is left of a cut character goes too."""
    met = _joined(docs, spans(docs, id, text, least, **how), id, text)
    place, names = docs.columns.index(text), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()
            for i, f in enumerate(found):
                if f:
                    raw = texts[i].encode()
                    texts[i] = _kept(raw, _removed(len(raw), f, least).tolist()).decode("utf-8", "ignore")
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.record_batch(columns, names=names)

    return met.mapInArrow(work, docs.schema)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), s AS (
  SELECT rid, i, md5(b[i:i + 199]) AS h FROM d, unnest(range(1, octet_length(b) - 198)) AS t(i) WHERE octet_length(b) >= 200
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1
), g AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k
  FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r)
), p AS (
  SELECT rid, min(i) AS lo, max(i) + 199 AS hi FROM g GROUP BY rid, k
), q AS (
  SELECT rid, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS before FROM p
), x AS (
  SELECT rid, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(CASE WHEN lo - 1 > before THEN hex(b[before + 1:lo - 1]) ELSE '' END, '' ORDER BY lo) AS front
  FROM q JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || CASE WHEN coalesce(last, 0) < octet_length(b) THEN hex(b[coalesce(last, 0) + 1:octet_length(b)]) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN x USING (rid)
"""
