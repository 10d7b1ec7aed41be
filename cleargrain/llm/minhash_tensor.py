"""Near duplicates by MinHash with tensored banding.

A table key is a pair of half keys, one of each of two collections. With m half keys of r minhashes in either collection
there are m * m tables, but only 2 * m * r minhashes to compute: the square root of what as many independent bands need.
Texts of similarity s meet in some table with probability (1 - (1 - s**r)**m)**2; m is the least number for which that is
RECALL at the threshold: for r = 2, 7 at 0.85 (0.9997) and 9 at 0.8 (0.9998). Only the weakest single link of a group is
subject to it.

Candidates are compared on whole shingle sets. Within a bucket every member is compared with the bucket's leader, the
member that meets most others. Then only pairs of members of different components remain. Two bounds that never strike
out a similar pair thin them within the join: the triangle inequality of the Jaccard distance, with the leader as the
third corner, and a parity sketch. The sketch has one bit for each of 2048 cells, flipped by each shingle of the cell, so
two sketches differ in no more bits than the sets differ in shingles. What passes is compared on whole sets; no link that
a bucket holds is lost.

Defined results: null or empty texts and texts without words have empty sets and no links. Texts with equal sets are one
class and linked. Rows that share an id count as one document, linked through any of its texts. Rows with a null id are
never linked. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.bytescan import LOWER, U64, mix, pieces, prefix_hashes, span_hashes, text_buffer, window_hashes, words
from cleargrain.llm.components import connected
from cleargrain.llm.shared import plain, read_table, settled, taken

RECALL = 0.9997
ROWS = 2
PIECE_BYTES = 1 << 20
#: 64-bit words of the parity sketch.
SKETCH = 32
#: Words of the sketch folded onto itself, which is looked at first; it too differs in no more bits than the sets.
FOLDED = 4
#: Ids of dropped documents that are broadcast, at most.
BROADCAST_IDS = 1 << 17


def halves_for(percent: int, rows: int = ROWS) -> int:
    """The least number of half keys with which a link right at the threshold shares a table with probability RECALL."""
    if not percent:
        raise ValueError("texts of similarity 0 share no minhash")
    m = 1
    while (1 - (1 - (percent / 100) ** rows) ** m) ** 2 < RECALL:
        m += 1
    return m


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, sorted within the row, and the number of them before each row."""
    data, at = text_buffer(column)
    data = LOWER[data]
    starts, ends, before = words(data, at)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    each = span_hashes(prefix_hashes(data), starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(before))
    windows = window_hashes(each, size)
    whole = row[: len(windows)] == row[size - 1 :] if len(windows) else np.zeros(0, bool)
    rows, found = row[: len(windows)][whole], windows[whole]
    few = np.flatnonzero((np.diff(before) > 0) & (np.diff(before) < size))
    if len(few):  # the whole sequence, told apart from any shingle by its length
        short = np.array([window_hashes(each[before[i] : before[i + 1]], before[i + 1] - before[i])[0] for i in few], U64)
        rows, found = np.concatenate([rows, few]), np.concatenate([found, mix(short + (np.diff(before)[few]).astype(U64))])
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    rows, found = rows[fresh], found[fresh]
    return found, np.searchsorted(rows, np.arange(len(at)))


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def half_keys(found: np.ndarray, before: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """(row, 2 * halves) half keys of `rows` minhashes each; rows without shingles get zeros."""
    n = len(before) - 1
    out = np.zeros((n, 2 * halves), U64)
    filled = np.flatnonzero(np.diff(before) > 0)
    if not len(filled):
        return out
    at = before[:-1][filled]
    seeds = _seeds(2 * halves * rows)
    for k in range(2 * halves):
        key = np.full(len(filled), U64(k))
        for j in range(rows):
            s = seeds[k * rows + j]
            x = found ^ s
            x *= s | U64(1)
            x ^= x >> U64(29)
            x *= U64(0xBF58476D1CE4E5B9)
            key = mix(key * U64(0x2545F4914F6CDD1D) + np.minimum.reduceat(x, at))
        out[filled, k] = key
    return out


def parities(found: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(row, SKETCH) words; bit c is the parity of the number of shingles in cell c."""
    n, cells = len(before) - 1, 64 * SKETCH
    out = np.empty((n, SKETCH), np.int64)
    cell = (mix(found ^ U64(0x8CB92BA72F3D8DD7)) % U64(cells)).astype(np.int64)
    for a in range(0, n, 512):  # short texts are many to a piece
        b = min(n, a + 512)
        row = np.repeat(np.arange(b - a), np.diff(before[a : b + 1]))
        flips = np.bincount(row * cells + cell[before[a] : before[b]], minlength=(b - a) * cells) & 1
        out[a:b] = np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(b - a, SKETCH)
    return out


def signatures(docs: DataFrame, id: str, text: str, size: int, halves: int, rows: int = ROWS) -> DataFrame:
    """id, n (size of the shingle set), s1 and s2 (128 bits that stand for the set), halves (the half keys), parity (the sketch)."""
    part = taken(docs, id=id, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                found, before = shingles(piece.column(1), size)
                n = np.diff(before)
                running = np.zeros(len(found) + 1, U64)
                sums = []
                for seed in (U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)):
                    np.cumsum(mix(found ^ seed), out=running[1:])
                    sums.append(mix(running[before[1:]] - running[before[:-1]]).view(np.int64))
                keys = half_keys(found, before, halves, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2 * halves, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * SKETCH, pa.int32()), pa.array(parities(found, before).ravel()))
                yield pa.record_batch([piece.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), lists, sketch], names=["id", "n", "s1", "s2", "halves", "parity"])

    return part.mapInArrow(work, f"id {part.schema['id'].dataType.simpleString()}, n long, s1 long, s2 long, halves array<bigint>, parity array<bigint>")


def shingle_sets(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """id and the whole set of shingle hashes."""
    part = taken(docs, id=id, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                found, before = shingles(piece.column(1), size)
                yield pa.record_batch([piece.column(0), pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(found.view(np.int64)))], names=["id", "set"])

    return part.mapInArrow(work, f"id {part.schema['id'].dataType.simpleString()}, set array<bigint>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, shared (size of the intersection), joined (size of the union) for each pair x, y."""
    left, right = sets.select(F.col("id").alias("x"), F.col("set").alias("sx")), sets.select(F.col("id").alias("y"), F.col("set").alias("sy"))
    return (
        pairs.join(left, "x")
        .join(right, "y")
        .select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("shared"), (F.size("sx") + F.size("sy")).alias("total"))
        .select("x", "y", "shared", (F.col("total") - F.col("shared")).alias("joined"))
    )


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, halves: int | None = None, rows: int = ROWS) -> DataFrame:
    """Per row of docs: id, n_shingles, component (smallest id that links of at least `percent` reach, itself included)."""
    halves = halves or halves_for(percent, rows)
    docs = taken(docs, id=id, text=text)
    signed = settled(signatures(docs, "id", "text", size, halves, rows), "signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("halves").alias("halves"), F.first("parity").alias("parity"))
    tables = F.array(*[F.xxhash64(F.lit(i * halves + j), F.col("halves")[i], F.col("halves")[halves + j]) for i in range(halves) for j in range(halves)])
    keyed = classes.select("id", "n", F.posexplode(tables).alias("table", "key"))
    many = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("key", "members")
    shared = settled(keyed.join(many, "key"), "shared")
    central = shared.groupBy("id").agg(F.sum("members").alias("score"))
    led = shared.join(central, "id").groupBy("key").agg(F.max(F.struct("score", "id"))["id"].alias("leader"))
    met = settled(shared.select("id", "n", "table", "key").join(led, "key"), "met")
    wanted = met.select("id").distinct()
    sets = settled(shingle_sets(docs.join(wanted.withColumnRenamed("id", "wanted"), F.col("id") == F.col("wanted"), "left_semi"), "id", "text", size), "sets")
    stars = met.where("id <> leader").select(F.col("leader").alias("x"), F.col("id").alias("y")).distinct()
    near = settled(compared(stars, sets).groupBy("x", "y").agg(F.max(F.struct(F.col("shared") / F.col("joined"), "shared", "joined")).alias("m")).select("x", "y", "m.shared", "m.joined"), "stars")
    similar = 100 * F.col("shared") >= percent * F.col("joined")
    links = near.where(similar).select("x", "y")
    found = connected(links, "x", "y")

    # Members of a bucket that the leader did not bring into one component.
    with_component = met.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = with_component.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    far = near.select(F.col("x").alias("leader"), F.col("y").alias("id"), (1 - F.col("shared") / F.col("joined")).alias("d"))
    open_ = with_component.where("id <> leader").join(apart, "key", "left_semi").join(far, ["leader", "id"])
    folded = [reduce(Column.bitwiseXOR, [F.col("parity")[i] for i in range(k, SKETCH, FOLDED)]).alias(f"f{k}") for k in range(FOLDED)]
    own = [F.col("halves")[k].alias(f"h{k}") for k in range(2 * halves)]
    open_ = settled(open_.join(classes.select("id", "parity", *folded, *own), "id"), "open")
    a, b = (open_.select("key", *(["table"] if x == "x" else []), F.col("id").alias(x), F.col("parity").alias(f"p{x}"), *(F.col(f"h{k}").alias(f"h{k}{x}") for k in range(2 * halves)), *(F.col(f"f{k}").alias(f"f{k}{x}") for k in range(FOLDED)), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("d").alias(f"d{x}")) for x in "xy")
    bits = lambda pairs: reduce(Column.__add__, [F.bit_count(p.bitwiseXOR(q)) for p, q in pairs])
    near_enough = lambda differ: differ * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    # A pair is looked at in the first table that it shares, and in none of the others.
    earlier = lambda part, first: reduce(Column.__or__, [(part > k) & (F.col(f"h{first + k}x") == F.col(f"h{first + k}y")) for k in range(halves)])
    seen = earlier(F.expr(f"table div {halves}"), 0) | earlier(F.col("table") % halves, halves)
    rest = (
        a.join(b, "key")
        .where("x < y AND cx <> cy")
        .where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        .where(~seen)
        .where(F.abs(F.col("dx") - F.col("dy")) <= 1 - percent / 100 + 1e-9)
        .where(near_enough(bits((F.col(f"f{k}x"), F.col(f"f{k}y")) for k in range(FOLDED))))
        .where(near_enough(bits((F.col("px")[i], F.col("py")[i]) for i in range(SKETCH))))
        .select("x", "y")
        .distinct()
    )
    more = settled(compared(rest, sets).where(similar).select("x", "y"), "links")
    if not more.isEmpty():
        found = connected(links.unionByName(more), "x", "y")

    named = classes.select("s1", "s2", "n", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    named = settled(named, "named")  # a side of its own, so that a class with many copies can be split in the join
    out = signed.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of their component; rows with a null id stay."""
    gone = near_components(docs, id, text, size, percent).where("id <> component").select(F.col("id").alias("gone")).distinct()
    gone = settled(gone, "gone")
    if gone.count() <= BROADCAST_IDS:  # else texts are shuffled, and the join is a sort-merge join
        gone = F.broadcast(gone)
    return plain(docs).join(gone, F.col(f"c{docs.columns.index(id)}") == F.col("gone"), "left_anti").toDF(*docs.columns)


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_components(read_table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reached
), c AS (
  SELECT node, min(reached) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
