"""Every registered query on edge rows and empty tables, against plain Python of its contract."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cleargrain.llm.registry import QUERIES

SPACE = b" \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(edges):
    return [(r["doc_id"], r["text"]) for r in edges.collect()]


def got(spark, folder, name):
    return sorted((r.asDict() for r in QUERIES[name](spark, folder[0]).collect()), key=lambda r: repr(sorted(r.items(), key=lambda x: x[0])))


def by_id(rows, key="doc_id"):
    return sorted(rows, key=lambda r: (r[key] is None, r[key] or 0))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, folder, name):
    rows = QUERIES[name](spark, folder[1]).collect()
    assert [r["conv_id"] for r in rows] == ([-1] if name.startswith("op5_") else [])


def test_op2(spark, folder, docs):
    rows = got(spark, folder, "op2_quality_rules")
    assert len(rows) == len(docs)

    def figures(text):
        text = text or ""
        w = text.encode().split()
        lines = [x for x in text.encode().split(b"\n") if x.strip(SPACE)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    want = sorted(((d, *figures(t)) for d, t in docs), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows), key=repr) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_op3(spark, folder, docs):
    rows = by_id(got(spark, folder, "op3_recurrent_lm"))
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    c = Counter(w for d, t in docs if not held(d) for w in words(t))
    ends = sum(not held(d) for d, _ in docs)
    total, distinct = sum(c.values()) + ends, len(c) + 1
    per = math.log10(total + 0.1 * (distinct + 1))
    for r, (d, t) in zip(rows, sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        w = words(t)
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d, held(d), len(w) + 1, sum(c[x] > 0 for x in w) + 1, total)
        assert r["base_score"] == pytest.approx(sum(math.log10(c[x] + 0.1) - per for x in w) + math.log10(ends + 0.1) - per)
        assert r["score"] < 0


def test_op4(spark, folder, docs):
    rows = by_id(got(spark, folder, "op4_flac"))
    media = {}
    for r, (d, t) in zip(rows, sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        own = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert media.setdefault(t or "", own) == own


def test_op5(spark, folder):
    rows = {r["conv_id"]: r for r in got(spark, folder, "op5_chat_format")}
    control = "</s>[INST] ok [/INST]"
    want = {1: [("user", "hi"), ("assistant", "<s>[x] \x1be"), ("assistant", "<s>[x] \x1be")], 2: [("", "")], None: [("system", "é")], -1: [("user", control), ("assistant", control)]}
    assert set(rows) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = rows[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r["formatted_chars"] > 0


def test_op6(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]
    rows = got(spark, folder, "op6_harmonic_packing")
    want = Counter()
    for d, text in docs:
        want[d, len(ids(text))] += len(ids(text))
    have = Counter()
    for r in rows:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert have == want
    texts = dict(docs)
    for r in rows:
        own = np.array(ids(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
    by_sequence = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by_sequence.values()) <= 2048


def removed(texts, least=200):
    c = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if c[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_op7(spark, folder, docs):
    rows = got(spark, folder, "op7_suffix_dedup")
    want = removed([(t or "").encode() for _, t in docs])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=repr) == sorted(((d, *x) for (d, _), x in zip(docs, want, strict=True)), key=repr)


def test_op8(spark, folder, docs):
    rows = by_id(got(spark, folder, "op8_language_id"))
    for r, (d, t) in zip(rows, sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert r["held_out"] == (zlib.crc32(str("" if d is None else d).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r["score"] <= 1


def test_op9(spark, folder, docs, edges):
    rows = got(spark, folder, "op9_mixing")
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == sorted(((d, len(words(t))) for d, t in docs), key=repr)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert sum({r["source_size"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * total)
    assert rows == got(spark, folder, "op9_mixing")


def test_op10(spark, folder, docs):
    rows = got(spark, folder, "op10_minhash_near_dedup")

    def shingles(t):
        w = words(t)
        return frozenset([tuple(w)] if 0 < len(w) < 3 else (tuple(w[i : i + 3]) for i in range(len(w) - 2)))

    sets = [(d, shingles(t)) for d, t in docs]
    label = {d: d for d, _ in sets if d is not None}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and 100 * len(x & y) >= 85 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    want = sorted(((d, len(s), label.get(d), d == label.get(d)) for d, s in sets), key=repr)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=repr) == want


def test_op1(spark, folder):
    rows = [tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got(spark, folder, "op1_url_filter")]
    assert sorted(rows, key=repr) == sorted(
        [(1, "example.net", "/en/x", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.com", "", None, "allow")], key=repr
    )
