"""Operators do the whole job."""

import numpy as np
from pyspark.sql import functions as F

from cleargrain.llm import minhash_tensor, mixing, recurrent_lm


def test_every_training_text_gives_gradients(spark):
    docs = spark.createDataFrame([(i, f"p{i} q{i} r{i} " * 2000) for i in range(8)], "doc_id long, text string")
    rows = recurrent_lm.scored(docs, lambda id: F.lit(True)).collect()
    assert len(rows) == 8 and all(r["score"] > 0.8 * r["base_score"] for r in rows)


def test_8192_words_have_an_output_of_their_own():
    words = [f"w{i}".encode() for i in range(9000)]
    lex = recurrent_lm.Lexicon(words, np.arange(9000, 0, -1), 10, 9010, 9000, np.full(recurrent_lm.BINS, 0.1)).ready()
    net = recurrent_lm.fresh(lex)
    assert lex.known == 8192 and lex.symbol[:8192].tolist() == list(range(8192)) and net.classes == 128


def test_rows_that_share_an_id_keep_their_words(spark):
    text = lambda mark, n: " ".join(f"{mark}_{i}" for i in range(n))
    rows = [(None, text(f"n{k}", n), "a", k) for k, n in enumerate((50, 50, 7, 120, 300))] + [(1, text(f"d{k}", n), "b", k) for k, n in enumerate((90, 90, 31))]
    rows += [(2, text("same", 40), "b", k) for k in range(3)] + [(None, text("nowhere", 60), None, 0), (3, None, "b", 0), (None, "", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    how = {"weights": (1.0, 1.0, 1.0), "share": 2.0, "block": 16}  # every block is taken twice
    out = mixing.mixed_rows(docs, **how).collect()
    whole = sorted(((x[0], x[1], x[2], x[3]) for x in rows if x[1]), key=repr)
    assert sorted(map(tuple, out), key=repr) == sorted(whole * 2, key=repr)


def test_tables_follow_the_threshold():
    assert minhash_tensor.halves_for(85) == 7 and minhash_tensor.halves_for(80) == 9
    assert all((1 - (1 - (p / 100) ** 2) ** minhash_tensor.halves_for(p)) ** 2 >= 0.9997 for p in range(50, 101))


def test_near_copies_at_the_pipelines_threshold(spark):
    base = [f"w{i}" for i in range(204)]  # 200 five-word shingles; 18 of the copy's are others: 182 of 218 shared
    copy = base[:-18] + [f"x{i}" for i in range(18)]
    docs = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(copy)), (2, "some other text of its own")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash_tensor.one_of_each(docs).collect()) == [0, 2]


def test_words_that_tie_fill_the_lookup(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "LOOKUP", 50)
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 7) for i in range(60)] + [(bytearray(b"top"), 9), (bytearray(b"low"), 1)], "word binary, c long")
    lex = recurrent_lm.lexicon(counts, 3)
    assert len(lex.words) == 50 and lex.words[0] == b"top" and b"low" not in lex.words
    assert len(recurrent_lm.lexicon(counts.where("c < 9 AND word < X'773130'"), 3).words) == 3


def test_the_mix_against_brute_force(spark):
    """Words are taken as the slots say, block by block of each source's stream, also where ids are null or repeat."""
    import random

    r = random.Random(4)
    rows = [(r.choice([None, 1, 2, k]), " ".join(f"{k}.{j}" for j in range(r.choice([0, 3, 40, 200]))), r.choice(["a", "b", None])) for k in range(60)] + [(9, "same words here", "a")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, times, planned = mixing.mixed(docs, block=16)
    streams = {}
    for x in sorted(placed.where("size > 0").collect(), key=lambda x: (x["source_no"], x["first"])):
        assert x["first"] == streams.get(x["source_no"], 0)
        streams[x["source_no"]] = x["first"] + x["size"]
    size = {s: sum(len(t.split()) for _, t, source in rows if source == s) for s in ("a", "b", None)}
    assert planned["sources"] == ["a", "b", None] and [streams[i] for i in range(3)] == [size[s] for s in ("a", "b", None)]
    drawn = {(x["source_no"], x["block"]): x["times"] for x in times.collect()}
    want = [sum(n * min(16, streams[s] - 16 * b) for (k, b), n in drawn.items() if k == s) for s in range(3)]
    got = [0, 0, 0]
    for x in mixing.mixed_rows(docs, block=16).collect():
        got[planned["sources"].index(x["source"])] += len(x["text"].split())
    assert got == want and all(abs(g - t) <= 16 for g, t in zip(got, planned["target"], strict=True))
