"""Quality rules as a short-circuit cascade.

Each rule reads features: scans of the texts, and figures of each row that are made from them. On a sample the features' CPU time
and the rows that each set of rules rejects are measured; then the rule with the most rejections for its cost goes first, and
so on, where what an earlier rule has rejected counts no more and what it has made costs nothing. A row that one rule
rejects is not looked at by the next; features of the others are carried on. The rules are a conjunction, so the order
changes the work and never a verdict. `judged` gives the base figures of every row, so there only the other rules are in
the cascade; in `kept_rows` all are.

Defined results: a null or empty text has no words and fails the base rules. Repeated rows are judged alike, row by row.
An empty table gives an empty result. Columns other than id and text are not read by `judged` and pass through `kept_rows`
unchanged, whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.bytescan import SPACE, mix, pieces, prefix_hashes, row_of, row_sums, span_hashes, text_buffer, window_hashes, words
from cleargrain.llm.shared import taken

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
PIECE_BYTES = 1 << 20
#: Rows on which the order of the rules is settled.
SAMPLE_ROWS = 2000

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SMALL = np.zeros(256, bool)
SMALL[97:123] = True
CONTROL = np.zeros(256, bool)
CONTROL[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = True


class Texts:
    """The texts of one piece, and their features, each made once at most and carried over to the rows that are left."""

    def __init__(self, column: pa.Array):
        self.data, self.at = text_buffer(column)
        self.rows = len(column)
        self.had: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.had:
            self.had[name] = FEATURES[name].make(self)
        return self.had[name]

    def taken(self, mask: np.ndarray) -> Texts:
        """The texts of some rows, with what is known of them."""
        out = object.__new__(Texts)
        size = np.diff(self.at)
        out.data, out.rows, out.had = self.data[np.repeat(mask, size)], int(mask.sum()), {}
        out.at = np.concatenate([[0], np.cumsum(size[mask])])
        for name, value in self.had.items():
            if (carry := FEATURES[name].carry) is not None:
                out.had[name] = carry(self, value, mask, out)
        return out


def _carry_rows(t: Texts, value: np.ndarray, mask: np.ndarray, out: Texts) -> np.ndarray:
    return value[mask]


def _carry_words(t: Texts, value: tuple, mask: np.ndarray, out: Texts) -> tuple:
    starts, ends, before = value
    n = np.diff(before)
    own = np.repeat(mask, n)
    shift = np.repeat(t.at[:-1][mask] - out.at[:-1], n[mask])
    return starts[own] - shift, ends[own] - shift, np.concatenate([[0], np.cumsum(n[mask])])


def _carry_word_hashes(t: Texts, value: np.ndarray, mask: np.ndarray, out: Texts) -> np.ndarray:
    return value[np.repeat(mask, np.diff(t["words"][2]))]


def _carry_lines(t: Texts, value: tuple, mask: np.ndarray, out: Texts) -> tuple:
    row, line = value
    own = mask[row]
    return (np.cumsum(mask) - 1)[row[own]], line[own]


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each line that has a word: its row and its hash."""
    if not len(t.data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word_starts = t["words"][0]
    breaks = np.flatnonzero(t.data == 10)
    starts = np.unique(np.concatenate([t.at[:-1], breaks + 1]))
    starts = starts[starts < len(t.data)]
    row = np.searchsorted(t.at, starts, "right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(t.data)]]), t.at[row + 1])
    ends -= (ends > starts) & (t.data[ends - 1] == 10)
    first_word = np.searchsorted(word_starts, starts)
    has = (first_word < len(word_starts)) & (np.append(word_starts, len(t.data) + 1)[first_word] < ends)
    return row[has], span_hashes(t["running"], starts[has], ends[has])


def _dup_lines(t: Texts) -> np.ndarray:
    row, line = t["lines"]
    order = np.lexsort((line, row))
    r, h = row[order], line[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    return np.bincount(r[again], minlength=t.rows)


def _repeat_words(t: Texts) -> np.ndarray:
    """Words that stand in a window of eight words which occurs again in the same text."""
    starts, _, before = t["words"]
    if len(starts) < WINDOW:
        return np.zeros(t.rows, np.int64)
    row = row_of(before)
    windows = window_hashes(t["word_hashes"], WINDOW)
    whole = row[: len(windows)] == row[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    key = mix(windows[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # two rows' windows never count as one
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] = same
    twice[:-1] |= same
    change = np.zeros(len(starts) + 1, np.int32)
    found = at[order[twice]]
    change[found] += 1
    np.subtract.at(change, found + WINDOW, 1)
    return row_sums(np.cumsum(change[:-1]) > 0, before)


def _letter_words(t: Texts) -> np.ndarray:
    """Words that hold a letter (ASCII, or any code point from U+00C0 on by its lead byte)."""
    starts, ends, before = t["words"]
    running = np.concatenate([[0], np.cumsum(LETTER[t.data])])
    return row_sums(running[ends] > running[starts], before)


@dataclass(frozen=True)
class Feature:
    """A scan of the texts or a figure of each row; the features that it is made from; how it is carried to some rows (None: made anew)."""

    make: Callable[[Texts], object]
    needs: tuple[str, ...] = ()
    carry: Callable | None = _carry_rows


#: Each after what it needs.
FEATURES = {
    "words": Feature(lambda t: words(t.data, t.at), carry=_carry_words),
    "running": Feature(lambda t: prefix_hashes(t.data), carry=None),
    "lines": Feature(_lines, ("words", "running"), _carry_lines),
    "word_hashes": Feature(lambda t: span_hashes(t["running"], *t["words"][:2]), ("words", "running"), _carry_word_hashes),
    "n_words": Feature(lambda t: np.diff(t["words"][2]), ("words",)),
    "word_chars": Feature(lambda t: row_sums(~SPACE[t.data] & ((t.data & 0xC0) != 0x80), t.at)),
    "n_symbols": Feature(lambda t: row_sums(SYMBOLS[t.data], t.at)),
    "n_dup_lines": Feature(_dup_lines, ("lines",)),
    "n_lines": Feature(lambda t: np.bincount(t["lines"][0], minlength=t.rows), ("lines",)),
    "n_repeat_words": Feature(_repeat_words, ("words", "word_hashes")),
    "letter_words": Feature(_letter_words, ("words",)),
    "controls": Feature(lambda t: row_sums(CONTROL[t.data], t.at)),
    "capitals": Feature(lambda t: row_sums(CAPITAL[t.data], t.at)),
    "ascii_letters": Feature(lambda t: row_sums(CAPITAL[t.data] | SMALL[t.data], t.at)),
}


def all_needs(names: tuple[str, ...]) -> set[str]:
    """The features, what they are made from, and so on."""
    return set(names).union(*(all_needs(FEATURES[n].needs) for n in names))


@dataclass(frozen=True)
class Rule:
    """Rejects rows where `rejects` is true of the texts; `needs` are the features that it reads."""

    name: str
    rejects: Callable[[Texts], np.ndarray]
    needs: tuple[str, ...] = ()


#: What the base verdict rejects.
BASE = (
    Rule("few_words", lambda t: t["n_words"] < 20, ("n_words",)),
    Rule("repeats", lambda t: 100 * t["n_repeat_words"] > 30 * t["n_words"], ("n_words", "n_repeat_words")),
)
#: Wide limits: what any of them rejects is no prose in any language.
RULES = (
    Rule("mean_word", lambda t: (t["word_chars"] > 40 * t["n_words"]) | (2 * t["word_chars"] < 3 * t["n_words"]), ("word_chars", "n_words")),
    Rule("symbols", lambda t: 4 * t["n_symbols"] > t["n_words"], ("n_symbols", "n_words")),
    Rule("letters", lambda t: 2 * t["letter_words"] < t["n_words"], ("letter_words", "n_words")),
    Rule("same_lines", lambda t: (t["n_dup_lines"] >= 3) & (2 * t["n_dup_lines"] > t["n_lines"]), ("n_dup_lines", "n_lines")),
    Rule("capitals", lambda t: 2 * t["capitals"] > t["ascii_letters"], ("capitals", "ascii_letters")),
    Rule("controls", lambda t: 20 * t["controls"] > t["word_chars"], ("controls", "word_chars")),
)
#: The figures that `judged` gives of every row.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(t: Texts, alive: np.ndarray, rules: tuple[Rule, ...]) -> np.ndarray:
    """Index of the rule that rejects each row, -1 for none; a row that is not alive, or rejected, is looked at no more."""
    verdict = np.full(t.rows, -1)
    rows = np.flatnonzero(alive)
    part = t if len(rows) == t.rows else t.taken(alive)
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        bad = rule.rejects(part)
        if bad.any():
            verdict[rows[bad]] = k
            rows = rows[~bad]
            part = part.taken(~bad) if k + 1 < len(rules) else part
    return verdict


def best_order(rules: tuple[Rule, ...], spent: dict[str, float], together: dict[int, int], known: set[str]) -> tuple[Rule, ...]:
    """Rules by rejections per cost, one after another, from figures of a sample.

    spent: seconds by feature, without those that it is made from, and by rule, without its features; together: the number of rows
    by the set of rules that reject them, as bits. A rule's rejections are those of rows that no earlier rule has rejected,
    its cost that of features which no earlier rule has made. Ties and rules that reject nothing go by cost.
    """
    left, made, todo, out = dict(together), set(known), list(range(len(rules))), []
    while todo:

        def worth(k: int) -> tuple[float, float, int]:
            cost = spent.get(rules[k].name, 0.0) + sum(spent.get(f, 0.0) for f in all_needs(rules[k].needs) - made) + 1e-9
            hits = sum(n for bits, n in left.items() if bits >> k & 1)
            return -hits / cost, cost, k

        k = min(todo, key=worth)
        todo.remove(k)
        out.append(rules[k])
        made |= all_needs(rules[k].needs)
        left = {bits: n for bits, n in left.items() if not bits >> k & 1}
    return tuple(out)


def ordered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = (), first: tuple[Rule, ...] = (), sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> tuple[Rule, ...]:
    """The rules as `best_order` has them, by costs and rejections measured on about `sample_rows` rows drawn from the whole table.

    Features in `known` are made anyway and cost nothing; rows that a rule of `first` rejects don't reach these rules.
    """
    total = docs.count()
    if not total:
        return rules
    names = [*FEATURES, *(r.name for r in rules)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, together = np.zeros(len(names)), Counter()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                t = Texts(piece.column(0))
                if first and (bad := np.any([r.rejects(t) for r in first], 0)).any():
                    t = t.taken(~bad)
                t.had.clear()
                bits = np.zeros(t.rows, np.int64)
                for k, name in enumerate(names):  # features come after what they need, rules after their features
                    began = time.thread_time()
                    if k < len(FEATURES):
                        t[name]
                    else:
                        bits |= rules[k - len(FEATURES)].rejects(t).astype(np.int64) << (k - len(FEATURES))
                    spent[k] += time.thread_time() - began
                together.update(bits.tolist())
        keys = [*range(len(names)), *together.keys()]
        yield pa.record_batch([pa.array([True] * len(names) + [False] * len(together)), pa.array(keys, pa.int64()), pa.array([*spent.tolist(), *map(float, together.values())], pa.float64())], names=["cost", "key", "value"])

    found = taken(docs, text=text).sample(False, min(1.0, sample_rows / total), seed).mapInArrow(measure, "cost boolean, key long, value double").groupBy("cost", "key").agg(F.sum("value").alias("value")).collect()
    spent = {names[r["key"]]: r["value"] for r in found if r["cost"]}
    return best_order(rules, spent, {r["key"]: int(r["value"]) for r in found if not r["cost"]}, all_needs(known))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: its id, the base figures, whether it is kept, and the rule that rejected it (base, a rule's name, or null).

    Rows may fail several rules; failed_rule then is the first in the order that `ordered` settled.
    """
    plan = ordered(docs, text, rules, FIGURES, BASE)
    rows = taken(docs, **{id: id, "text": text})
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                t = Texts(piece.column(1))
                figures = [t[name] for name in FIGURES]
                failed = np.any([r.rejects(t) for r in BASE], 0)
                by = cascade(t, ~failed, plan)
                kept = ~failed & (by < 0)
                why = [None if k else ("base" if b else plan[j].name) for k, b, j in zip(kept, failed, by, strict=True)]
                yield pa.record_batch([piece.column(0), *map(pa.array, figures), pa.array(failed), pa.array(kept), pa.array(why, pa.string())], names=[id, *names])

    return rows.mapInArrow(work, f"`{id}` {rows.schema[id].dataType.simpleString()}, {COLUMNS}")


def kept_rows(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the base rules and all rules keep, with docs' own columns; the base rules are part of the cascade."""
    plan = ordered(docs, text, (*BASE, *rules))
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, batch.schema.names[place], PIECE_BYTES):
                yield piece.filter(pa.array(cascade(Texts(piece.column(place)), np.ones(piece.num_rows, bool), plan) < 0))

    return docs.mapInArrow(work, docs.schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("failed_rule")  # which of several it is hangs on timings


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), l AS (
  SELECT rid, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lw FROM w
), win AS (
  SELECT rid, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS t(i) WHERE len(ws) >= 8
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM dup, unnest(range(0, 8)) AS t(k) GROUP BY rid
), f AS (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lw) - len(list_distinct(lw)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lw) AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x{BF}]'))) AS letter_words,
    len(regexp_extract_all(text, '[\x00-\x08\x0E-\x1F\x7F]')) AS controls,
    len(regexp_extract_all(text, '[A-Z]')) AS capitals, len(regexp_extract_all(text, '[A-Za-z]')) AS ascii_letters
  FROM w JOIN l USING (rid) LEFT JOIN cover USING (rid)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    (word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words) AS r1, (4 * n_symbols > n_words) AS r2, (2 * letter_words < n_words) AS r3,
    (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) AS r4, (20 * controls > word_chars) AS r5, (2 * capitals > ascii_letters) AS r6
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept FROM b
"""
