"""Mixing sources to target weights by fixed-length blocks.

The words of each source, document after document, form one stream that is cut into blocks of a fixed number of words.
A source's target is its share of the mix by weight, at most `most` times its size. The mix is a number of slots, cut
into output shards. Each shard draws multinomial counts of its slots over the sources, with odds in proportion to what
each source still has to give; so the shards together take exactly a source's number of slots. The j-th slot of a source
takes block p(j), where p runs through one pseudorandom permutation of the source's blocks after another (a Feistel
network that walks its cycle into range): a block is taken as often as any other of its source, give or take one.
Blocks and slots meet by index.

Defined results: the null source is a source of its own, the last in order. Null, empty and word-less texts have size 0
and are never taken. An empty table gives an empty result. Repeated rows each take their place in the stream; rows that
are alike in id, source and text may change places. The same input gives the same mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.bytescan import U64, mix, pieces, text_buffer, words
from cleargrain.llm.shared import plain, read_table, settled, taken

BLOCK = 512
#: Slots of one output shard: at least SHARD_SLOTS, and so many that there are MOST_SHARDS shards and MOST_COUNTS counts of
#: sources in shards at most. The driver holds these counts and a row for each source.
SHARD_SLOTS, MOST_SHARDS, MOST_COUNTS = 4096, 4096, 1 << 22
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
PIECE_BYTES = 1 << 20


def identity(id: Column, source: Column, text: Column) -> list[Column]:
    """Two hashes, 128 bits, that stand for a row's id, source and text."""
    return [F.xxhash64(F.lit(seed), id.isNull(), source.isNull(), id, source, text).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]


def sizes(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """id, source, size (words of the whole text), k1 and k2 (the identity) for each row."""
    part = taken(docs, id=id, source=source, text=text).select("id", "source", "text", *identity(F.col("id"), F.col("source"), F.col("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                data, at = text_buffer(piece.column(2))
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array(np.diff(words(data, at)[2])), piece.column(3), piece.column(4)], names=["id", "source", "size", "k1", "k2"])

    kinds = {x: part.schema[x].dataType.simpleString() for x in ("id", "source")}
    return part.mapInArrow(work, f"id {kinds['id']}, source {kinds['source']}, size long, k1 long, k2 long")


def targets(size: np.ndarray, weight: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Weighted shares of `share` times all sizes; what is above `most` times a source's size goes to the others by weight."""
    cap = most * size
    out = np.zeros(len(size))
    free = size > 0
    left = share * float(size.sum())
    while free.any() and left > 0:
        want = left * weight / weight[free].sum()
        over = free & (want > cap)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = cap[over]
        left -= float(cap[over].sum())
        free &= ~over
    return out


def shard_counts(need: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """(shards, sources) slots; every column sums to the source's need."""
    rng = np.random.default_rng(seed)
    left, rows = need.astype(np.int64).copy(), []
    while left.sum():
        open_, row = min(shard_slots, int(left.sum())), np.zeros(len(left), np.int64)
        while open_:
            odds = (left - row) / (left - row).sum()
            drawn = np.minimum(rng.multinomial(open_, odds), left - row)
            if not drawn.any():
                drawn[np.argmax(left - row)] = 1
            row += drawn
            open_ -= int(drawn.sum())
        rows.append(row)
        left -= row
    return np.array(rows, np.int64) if rows else np.zeros((0, len(need)), np.int64)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each index under a pseudorandom permutation of range(n) that the key picks."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(U64)
    mask = (U64(1) << half) - U64(1)
    out = index.astype(U64)
    todo = np.arange(len(out))
    limit = n.astype(U64)
    while len(todo):
        h, m, k, x = half[todo], mask[todo], key[todo], out[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + k + U64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def plan(stats: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 11) -> dict:
    """Targets, blocks and slots of sources that come as (source, size), and the shards' counts."""
    stats = sorted(stats, key=lambda x: (x[0] is None, x[0] or ""))  # str compares by code point
    size = np.array([x[1] for x in stats], np.int64)
    target = targets(size, np.resize(np.array(weights), len(stats)), share, most)
    blocks = -(-size // block)
    with np.errstate(invalid="ignore", divide="ignore"):
        need = np.where(size > 0, np.minimum(np.rint(np.where(size > 0, target * blocks / np.maximum(size, 1), 0)), np.floor(most) * blocks), 0).astype(np.int64)
    shards = min(MOST_SHARDS, max(1, MOST_COUNTS // max(1, len(stats))))
    per_shard = max(SHARD_SLOTS, -(-int(need.sum()) // shards))
    counts = shard_counts(need, per_shard, seed)
    return {"sources": [x[0] for x in stats], "size": size, "target": target, "blocks": blocks, "need": need, "counts": counts}


def slots(spark, planned: dict, seed: int = 11) -> DataFrame:
    """shard, slot, source_no, block for every slot of the mix."""
    counts, blocks = planned["counts"], planned["blocks"]
    before = np.cumsum(counts, axis=0) - counts
    shard_no, source_no = np.nonzero(counts)
    runs = pa.table([pa.array(shard_no.astype(np.int32)), pa.array(source_no.astype(np.int32)), pa.array(before[shard_no, source_no]), pa.array(counts[shard_no, source_no])], names=["shard", "source_no", "first", "n"])
    table = spark.createDataFrame(runs)  # whole columns, no object for each of its rows
    n_blocks = blocks.copy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, first, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for a in range(0, n, 1 << 16):
                    j = first + np.arange(a, min(n, a + (1 << 16)))
                    size = np.full(len(j), n_blocks[s])
                    key = mix(U64((seed + s * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) + (j // n_blocks[s]).astype(U64))
                    yield pa.record_batch([pa.array(np.full(len(j), shard, np.int32)), pa.array(j), pa.array(np.full(len(j), s, np.int32)), pa.array(permuted(j % n_blocks[s], size, key))], names=["shard", "slot", "source_no", "block"])

    return table.repartition(max(1, min(len(shard_no), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(work, "shard int, slot long, source_no int, block long")


def streams(sized: DataFrame, planned: dict) -> DataFrame:
    """sized with source_no and first: the number of the source's words before the row's.

    Rows alike in id, source and text are counted first and follow each other. A source is dealt into buckets by the identity's
    hash, as many as the square root of the largest source's rows; words are summed by bucket, the buckets in turn, and the
    rows within each. So no task orders more than about that many.
    """
    names = sized.sparkSession.createDataFrame([(s, i) for i, s in enumerate(planned["sources"])], f"source_name {sized.schema['source'].dataType.simpleString()}, source_no int")
    numbered = sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    alike = numbered.groupBy("source_no", "source", "id", "size", "k1", "k2").agg(F.count("*").alias("rows"))
    spread = math.isqrt(max(planned["rows"], default=0)) + 1
    alike = alike.withColumn("bucket", F.pmod("k2", F.lit(spread))).withColumn("words", F.col("size") * F.col("rows"))
    sums = alike.groupBy("source_no", "bucket").agg(F.sum("words").alias("all"))
    ahead = sums.withColumn("ahead", F.sum("all").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("all")).drop("all")
    within = Window.partitionBy("source_no", "bucket").orderBy("id", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = alike.withColumn("upto", F.sum("words").over(within)).join(F.broadcast(ahead) if spread * len(planned["sources"]) <= 1 << 16 else ahead, ["source_no", "bucket"])
    begin = F.col("ahead") + F.col("upto") - F.col("words")
    each = placed.select("source_no", "id", "source", "size", "k1", "k2", begin.alias("begin"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    return each.withColumn("first", F.col("begin") + F.col("copy") * F.col("size")).drop("begin", "copy")


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 11) -> tuple[DataFrame, DataFrame, dict]:
    """The rows' places in their streams, the times each block is taken (source_no, block, times), and the plan."""
    sized = settled(sizes(docs, id, text, source), "sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # a row for each source
    planned = plan([(r["source"], r["size"]) for r in stats], weights, share, most, block, seed)
    planned["rows"] = [r["rows"] for r in stats]
    drawn = slots(docs.sparkSession, planned, seed)
    # Spark takes the slots for as few as the runs that they are made from, and would broadcast them at any size.
    times = drawn.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
    return streams(sized, planned), times, planned


def taken_spans(placed: DataFrame, times: DataFrame, block: int = BLOCK) -> DataFrame:
    """source_no, id, first, size and the words [lo, hi) of the row that lie in a block taken `times` times."""
    reach = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))))
    met = reach.join(times, ["source_no", "block"])
    return met.withColumn("lo", F.greatest(F.lit(0), F.col("block") * block - F.col("first"))).withColumn("hi", F.least("size", (F.col("block") + 1) * block - F.col("first")))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    placed, times, planned = mixed(read_table(spark, sf_dir, "documents"))
    reach = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + size - 1) div {BLOCK}"))))
    overlap = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("first", F.col("block") * BLOCK)
    rows = reach.join(times, ["source_no", "block"], "left").groupBy("source_no", "id", "first", "size").agg(F.sum(overlap * F.coalesce("times", F.lit(0))).alias("taken"))
    rows = rows.drop("first").unionByName(placed.where("size = 0").select("source_no", "id", "size", F.lit(0).cast("long").alias("taken")))
    figures = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(planned["size"], planned["target"], strict=True))], "source_no int, source_size long, target double")
    return rows.join(F.broadcast(figures), "source_no").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Rows of docs as the mix takes them: a text holds the words taken from it, in order, with the white space
    between them; a gap is one space.

    Words that are taken a second time are in a second row of the same id, and so on. Other columns repeat.
    """
    block = how.get("block", BLOCK)
    placed, times, _ = mixed(docs, id, text, source, **how)
    spans = taken_spans(placed, times, block).groupBy("k1", "k2", "first", "size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("__spans"))
    own = plain(docs)
    own_id, own_source, own_text = (F.col(f"c{docs.columns.index(c)}") for c in (id, source, text))
    whole = F.xxhash64(*[c for c in own.columns if "map<" not in own.schema[c].dataType.simpleString()])  # orders rows that differ in other columns only
    rows = own.select("*", *identity(own_id, own_source, own_text), F.lit(1).alias("__kind"), whole.alias("__order"))
    places = spans.select("k1", "k2", F.lit(0).alias("__kind"), F.col("first").alias("__order"), F.col("size").alias("__size"), "__spans")
    # The n-th place and the n-th row of an identity meet side by side, so texts are shuffled once and none is repeated.
    both = rows.unionByName(places, allowMissingColumns=True).repartition("k1", "k2")
    both = both.withColumn("__turn", F.row_number().over(Window.partitionBy("k1", "k2", "__kind").orderBy("__order")))
    pair = Window.partitionBy("k1", "k2", "__turn").orderBy("__kind")
    both = both.withColumn("__lost", (F.col("__kind") == 0) & F.lead("__kind").over(pair).isNull())
    both = both.withColumn("__size", F.when(F.col("__kind") == 1, F.lag("__size").over(pair)).otherwise(F.col("__size")))
    both = both.withColumn("__spans", F.when(F.col("__kind") == 1, F.lag("__spans").over(pair)).otherwise(F.col("__spans")))
    met = both.where("__lost OR (__kind = 1 AND __size IS NOT NULL)").select(*own.columns, "__spans", "__size", "__lost")
    place = docs.columns.index(text)
    names = docs.columns
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pc.any(batch.column("__lost")).as_py():
                raise ValueError("a place of the mix has no row")
            own = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
            spans_, counted = batch.column("__spans").to_pylist(), batch.column("__size").to_pylist()
            rows, texts = [], []
            for i, (whole, found, n) in enumerate(zip(own.column(place).to_pylist(), spans_, counted, strict=True)):
                data, at = text_buffer(pa.array([whole], pa.string()))
                start, end, _ = words(data, at)
                if len(start) != n:
                    raise ValueError(f"a row of {len(start)} words met a place of {n}")
                raw = data.tobytes()
                for turn in range(max(x["times"] for x in found)):
                    part: list[list[int]] = []
                    for x in (x for x in found if x["times"] > turn):
                        if part and part[-1][1] == x["lo"]:
                            part[-1][1] = x["hi"]
                        else:
                            part.append([x["lo"], x["hi"]])
                    rows.append(i)
                    texts.append(b" ".join(raw[start[lo] : end[hi - 1]] for lo, hi in part).decode())
            if rows:
                out = own.take(pa.array(rows))
                columns = list(out.columns)
                columns[place] = pa.array(texts, own.schema.field(place).type)
                yield pa.record_batch(columns, names=names)

    return met.mapInArrow(work, schema)
