"""The methods themselves, on small inputs whose results can be worked out."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cleargrain.llm import chat_format, flac, harmonic_packing, language_id, minhash_tensor, mixing, quality_rules, recurrent_lm, suffix_dedup, url_filter
from cleargrain.llm.bwt_repeats import repeated
from cleargrain.llm.chat_template import TemplateError, compile_template, folded_block, parse
from cleargrain.llm.components import connected


def shown(source, **values):
    return "".join(t for t, _ in compile_template(source, {"up": str.upper})(values))


def test_templates():
    assert shown("{{ a ~ 1 + 2 }}{# no #}", a="x") == "x3"
    assert shown("{% for m in ms %}{{ loop.index }}{{ m.k }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"k": "a"}, {"k": "b"}]) == "1a,2b"
    assert shown("{% if a == 'x' and b %}1{% elif b %}2{% else %}3{% endif %}", a="y", b=True) == "2"
    assert shown("{% set x = [1, 2][1] %}{{ x }} {{ 'b' if 2 in [x] else 'c' }} {{ 'q' | up }}") == "2 b Q"
    assert shown("a  {%- if true -%}  b  {%- endif -%}  c") == "abc"
    assert folded_block(parse("x{{ 'a' ~ 'b' }}{% if 1 > 2 %}never{{ y }}{% endif %}z")) == folded_block(parse("xabz"))
    assert list(compile_template("a{% generation %}{{ t }}{% endgeneration %}b")({"t": "x"})) == [("a", False), ("x", True), ("b", False)]


@pytest.mark.parametrize("source", ["{{ a.__class__ }}", "{{ ''.join }}", "{{ f() }}", "{% import os %}", "{{ a[ }}", "{% for x in y %}", "{{ 1 + 'a' }}", "{{ x | nothing }}", "{{ [1] }}"])
def test_templates_reach_nothing_else(source):
    with pytest.raises(TemplateError):
        shown(source, a={"k": 1}, y=[], x="x")


@given(st.text(alphabet="<>[]\x1belbd/s INST", max_size=40))
def test_escapes_come_back(text):
    coded = chat_format.escape(text)
    assert chat_format.unescape(coded) == text and not set(coded) & set("<[]")


def test_a_template_renders_whole_conversations(spark):
    template = "{{ 'BOS ' }}{% for m in messages %}{% if loop.first %}^{% endif %}[{{ m.text | escape }}]{% if loop.last %} END{% endif %}{% endfor %}"
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "<b"), (1, 2, "user", None), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = chat_format.rendered(rows, template).collect()
    assert {r["conv_id"]: r["text"] for r in got} == {1: "BOS ^[a][\x1blb][] END", 2: "BOS ^[x] END"}
    with pytest.raises(Exception, match="read once"):
        chat_format.rendered(rows, template + template).collect()


def test_long_conversations_come_in_parts(spark):
    r = random.Random(3)
    turns = [(k % 3, k, ("user", "assistant")[k // 3 % 2], "".join(r.choice("ab<[]\x1b/s>é ") for _ in range(r.randint(0, 60)))) for k in range(300)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {x["conv_id"]: x for x in chat_format.read_back(chat_format.rendered(rows)).collect()}
    parts = chat_format.rendered(rows, part_chars=7)
    assert parts.count() > 300
    assert {x["conv_id"]: x for x in chat_format.read_back(parts).collect()} == whole
    joined = {c: "".join(x["text"] for x in sorted(g, key=lambda x: x["part_no"])) for c in range(3) if (g := [x for x in parts.collect() if x["conv_id"] == c])}
    assert joined == {x["conv_id"]: x["text"] for x in chat_format.rendered(rows).collect()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=3).flatmap(lambda seed: st.integers(0, 3).map(lambda n: (seed * 576)[: 576 * n])), min_size=1, max_size=4))
def test_flac_round_trip(payloads):
    payloads = [p[: len(p) // 576 * 576] for p in payloads]
    assert [x[0] for x in flac.decode(flac.encode(payloads))] == payloads


def test_flac_signals_and_damage():
    t = np.arange(576 * 140)
    wave = (np.sin(t / 9) * 90 + np.sin(t / 31) * 20 + 128).astype(np.uint8).tobytes()
    (media,) = flac.encode([wave])
    pcm, samples, frames = flac.decode([media])[0]
    assert pcm == wave and len(media) < 0.7 * len(wave)
    assert samples.tolist() == [576 * i for i in range(140)]
    k = 77  # any frame can be read by its offset alone
    assert media[frames[k] : frames[k] + 2] == b"\xff\xf8"
    for at in (30, int(frames[3]) + 2, int(frames[3]) + 60, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([media[:-3]])


def bits(*fields):
    s = "".join(f"{v:0{w}b}" for v, w in fields)
    return int(s + "0" * (-len(s) % 8), 2).to_bytes(-(-len(s) // 8), "big")


def test_flac_partitions_escapes_and_fixed_predictors():
    """A frame written by hand: order 1, two partitions, the second escaped to three raw bits."""
    samples = [5, 6, 8, 7, 7, 9, 8, 5] * 24  # 192
    rest = [b - a for a, b in zip(samples, samples[1:], strict=False)]
    rice = [(u >> 1, u & 1) for u in ((r << 1) ^ (r >> 31) for r in rest[:95])]
    fields = [(0b00010010, 8), (5, 8), (0, 2), (1, 4), (1, 4)]
    for q, low in rice:
        fields += [(1, q + 1), (low, 1)]
    fields += [(15, 4), (4, 5)] + [(r & 15, 4) for r in rest[95:]]
    head = b"\xff\xf8\x14\x02\x00"
    crc = lambda x, w: int(flac.crcs(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), w)[0])
    body = head + bytes([crc(head, 8)]) + bits(*fields)
    frame = body + crc(body, 16).to_bytes(2, "big")
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | 192).to_bytes(8, "big") + bytes(16)
    pcm, _, _ = flac.decode([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame])[0]
    assert [x - 128 for x in pcm] == samples


def test_flac_tables(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a" * 1000)), (2, None), (3, bytearray(b""))], "id long, raw binary")
    media = flac.encoded(rows, "id", "raw")
    blocks = flac.pcm_blocks(media, "id", "media").orderBy("id", "block").collect()
    assert [(r["id"], r["block"], r["sample_offset"], len(r["pcm"])) for r in blocks] == [(1, 0, 0, 576), (1, 1, 576, 576)]
    assert (blocks[0]["pcm"] + blocks[1]["pcm"])[:1000] == b"a" * 1000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=30), min_size=1, max_size=6), st.integers(1, 12), st.data())
def test_interval_expansion(texts, least, data):
    weights = [data.draw(st.integers(1, 2)) for _ in texts]
    texts = [t.encode() for t in texts]
    c = Counter()
    for t, w in zip(texts, weights, strict=True):
        for i in range(len(t) - least + 1):
            c[t[i : i + least]] += w
    found = repeated(texts, weights, least)
    assert [x.tolist() for x in found] == [[c[t[i : i + least]] > 1 for i in range(len(t) - least + 1)] for t in texts]


@pytest.mark.parametrize("most", [512, 2, 1])
def test_repeats_at_any_split(spark, most):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(5))
    shared = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(r.randint(5, 60))) + shared[r.randint(0, 40) :] + word() for _ in range(30)] + ["ab" * 400, "x" * 450, "x" * 199, None, shared]
    from test_contracts import removed

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.digests(df, most=most).collect()
    assert sorted(tuple(x) for x in got) == [(i, *x) for i, x in enumerate(removed([(t or "").encode() for t in texts]))]
    kept = {x["doc_id"]: x["text"] for x in suffix_dedup.without_repeats(df, most=most).collect()}
    assert kept[31] == "" and kept[32] == "x" * 199 and kept[33] is None


def test_near_groups_against_all_pairs(spark):
    r = random.Random(9)
    base = [f"w{r.randint(0, 300)}" for _ in range(150)]
    texts = []
    for _ in range(120):  # copies with between none and a quarter of the shingles changed: many pairs near the limit
        t = list(base)
        for _ in range(r.randint(0, 9)):
            t[r.randrange(len(t))] = f"n{r.randint(0, 10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"z{r.randint(0, 10**6)}" for _ in range(r.randint(1, 80))) for _ in range(60)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["id"]: x["component"] for x in minhash_tensor.near_components(df, size=3, percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert {x["doc_id"] for x in minhash_tensor.one_of_each(df, size=3, percent=85).collect()} == set(label)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = (np.unique(rng.integers(0, 5000, rng.integers(1, 3000)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        p = minhash_tensor.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        assert int(np.bitwise_count(p[0] ^ p[1]).sum()) <= len(np.setxor1d(a, b))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["component"] for x in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == label


def test_packing_fills_classes():
    for n in (1, 95, 96, 500, 2047, 2048, 2049, 10_000):
        parts = harmonic_packing.cuts(n)
        assert sum(parts) == n and max(parts) <= 2048
    docs = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(np.random.default_rng(1).integers(1, 5000, 2000).tolist())]
    rows = list(harmonic_packing.filled(iter(docs), 7 << 40))
    used = Counter()
    for _, _, length, ids, _, sequence, offset in rows:
        assert offset == used[sequence] and len(ids) == 4 * length
        used[sequence] += length
    assert sum(used.values()) == sum(len(x) // 4 for _, x in docs) and sum(used.values()) / (2048 * len(used)) > 0.99
    assert len({r[5] for r in rows}) == len(used) and min(used) == 7 << 40


def test_words_encode_alone_as_in_the_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    marks = [*"abZ09.,'!s tdre\n()<|>-éÉ×÷ßŉ̸̀\u00a0\u2003\x85\x1cΑΣσ가😀²…"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "|>"]
    texts = ["".join(r.choice(marks if k % 3 else marks[:12] + special) for _ in range(r.randint(0, 16))) for k in range(6000)]
    encoder = harmonic_packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), remembered=500)
    for i in range(0, len(texts), 10):
        from cleargrain.llm.bytescan import text_buffer

        got = encoder.encode(*text_buffer(pa.array(texts[i : i + 10])))
        assert got == [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts[i : i + 10], add_special_tokens=False)]


def test_targets_are_reshared():
    assert mixing.targets(np.array([10, 1000, 1000]), np.array([3.0, 1.0, 2.0])).tolist() == pytest.approx([20, 2995 / 3, 5990 / 3])
    assert mixing.targets(np.array([0, 5]), np.array([3.0, 1.0])).tolist() == pytest.approx([0, 7.5])


def test_permutations_and_shards():
    for n in (1, 2, 3, 17, 1000):
        index = np.arange(n)
        got = mixing.permuted(index, np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(n))
    counts = mixing.shard_counts(np.array([1000, 0, 37, 4000]), 512, 3)
    assert counts.sum(0).tolist() == [1000, 0, 37, 4000] and counts.sum(1)[:-1].tolist() == [512] * (len(counts) - 1)


def test_the_mix_meets_its_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 400))), f"s{r.randint(0, 3)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, times, plan = mixing.mixed(docs)
    out = mixing.mixed_rows(docs).collect()
    by = Counter()
    for x in out:
        by[x["source"]] += len(x["text"].split())
    for name, target in zip(plan["sources"], plan["target"], strict=True):
        assert abs(by[name] - target) <= 2 * mixing.BLOCK
    assert max(Counter(x["doc_id"] for x in out).values()) <= 2


def test_rules_short_circuit_and_never_change_a_verdict(spark):
    looked = []
    bad = lambda word: lambda t: looked.append((word.decode(), t.rows)) or np.array([word in bytes(t.data[a:b]) for a, b in zip(t.at, t.at[1:], strict=False)])
    rules = (quality_rules.Rule("x", bad(b"x")), quality_rules.Rule("y", bad(b"y")))
    t = quality_rules.Texts(pa.array(["a x", "b y", "x y", "c"]))
    assert quality_rules.cascade(t, np.ones(4, bool), rules).tolist() == [0, 1, 0, -1] and looked == [("x", 4), ("y", 2)]
    assert quality_rules.cascade(t, np.array([True, False, True, True]), rules[::-1]).tolist() == [1, -1, 0, -1]
    docs = spark.createDataFrame([(i, "### $$$ a") for i in range(50)] + [(99, "plain words " * 30)], "doc_id long, text string")
    assert {r.name for r in quality_rules.ordered(docs)} == {r.name for r in quality_rules.RULES}


def test_rules_are_ordered_by_rejections_for_their_own_cost():
    none = lambda t: None
    a, b, c = (quality_rules.Rule(n, none, needs) for n, needs in (("a", ("n_symbols",)), ("b", ("n_lines",)), ("c", ("n_dup_lines",))))
    spent = {"n_symbols": 1.0, "words": 2.0, "running": 2.0, "lines": 5.0, "n_lines": 1.0, "n_dup_lines": 1.5}
    together = {0b000: 50, 0b001: 3, 0b010: 20, 0b110: 20, 0b100: 1}
    order = lambda *known: [r.name for r in quality_rules.best_order((a, b, c), spent, together, quality_rules.all_needs(known))]
    assert order() == ["b", "a", "c"]  # b rejects 40 for 10, a 3 for 1; after b, c rejects 1 only
    assert order("lines") == ["b", "a", "c"] and order("n_dup_lines") == ["c", "b", "a"]
    assert [r.name for r in quality_rules.best_order((a, b, c), spent, {0b100: 9}, set())] == ["c", "a", "b"]


@pytest.mark.parametrize("seed", range(6))
def test_features_are_carried_to_the_rows_that_are_left(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("ab AB#1é\n\x01 ") for _ in range(r.randint(0, 90))) for _ in range(40)] + [None, "", "x y\nx y\nx y\n" * 9]
    mask = np.array([r.random() < 0.5 for _ in texts])
    whole = quality_rules.Texts(pa.array(texts))
    for name in quality_rules.FEATURES:
        whole[name]
    part, fresh = whole.taken(mask), quality_rules.Texts(pa.array([t for t, m in zip(texts, mask, strict=True) if m], pa.string()))
    for name in quality_rules.FEATURES:
        for x, y in zip(np.atleast_2d(part[name]) if name not in ("words", "lines") else part[name], np.atleast_2d(fresh[name]) if name not in ("words", "lines") else fresh[name], strict=True):
            assert np.array_equal(x, y), name
    rules = (*quality_rules.BASE, *quality_rules.RULES)
    want = quality_rules.cascade(whole, np.ones(len(texts), bool), rules) < 0
    for _ in range(4):
        r.shuffle(order := list(rules))
        assert np.array_equal(quality_rules.cascade(quality_rules.Texts(pa.array(texts)), np.ones(len(texts), bool), tuple(order)) < 0, want)


def test_automata_hold_all_substrings():
    text = b"abcbcabxyabc"
    automaton = language_id.fit({"t": text}).automata[0]

    def holds(s):
        state = automaton.first[s[0]]
        for c in s[1:]:
            if state == automaton.none or automaton.owner[state + c] != state:
                return False
            state = automaton.to[state + c]
        return state != automaton.none

    r = random.Random(0)
    for _ in range(500):
        s = bytes(r.choice(b"abcxyq") for _ in range(r.randint(1, 5)))
        assert holds(s) == (s in text)


def parsed(text, s):
    """Phrases of s, each the longest that occurs in text."""
    n, i = 0, 0
    while i < len(s):
        k = 1
        while i + k < len(s) and s[i : i + k + 1] in text:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_are_longest_matches():
    text = b"the cat sat on the mat"
    model = language_id.fit({"t": text})
    for s in (b"the mat sat", b"zzz", b"on the cat qq the", b"t"):
        assert language_id.phrases(model, np.frombuffer(s, np.uint8), np.array([0, len(s)]))[0, 0] == parsed(text, s)


@pytest.mark.parametrize("block", [1, 2, 7, 64, 512])
def test_phrases_cross_blocks(block):
    r = random.Random(block)
    samples = {"a": bytes(r.choice(b"abc ") for _ in range(700)), "b": bytes(range(256)) * 2 + b"abcabc" * 30}
    model = language_id.fit(samples)
    texts = [samples[r.choice("ab")][a : a + r.randint(0, 300)] + bytes(r.choice(b"abcd ") for _ in range(r.randint(0, 90))) + samples["a"][:a] for a in range(0, 600, 40)] + [b""]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language_id.phrases(model, np.frombuffer(b"".join(texts), np.uint8), at, block)
    assert got.tolist() == [[parsed(samples[k], t) for t in texts] for k in "ab"]


@pytest.mark.parametrize("ids", ["none", "one", "own"])
def test_languages_by_brute_force_whatever_the_ids(spark, ids):
    r = random.Random(6)
    lexicon = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 6))) for _ in range(60)] for k, v in {"xx": "abcdeé", "yy": "acegi", "zz": "日本語a"}.items()}
    write = lambda k, n: " ".join(r.choice(lexicon[k]) for _ in range(n))
    rows = [({"none": None, "one": 7, "own": i}[ids], write(k, r.randint(1, 700)), k) for i, k in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [rows[0]] * 300  # one text that most rows hold
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, "doc_id", "text", "lang")
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(lexicon, language_id.SAMPLE_BYTES)
    small = language_id.sample(docs, "doc_id", "text", "lang", 2000, 100)
    assert {k: len(v) for k, v in small.items()} == dict.fromkeys(lexicon, 2000)
    model = language_id.fit(small)
    tests = [write(k, r.randint(1, 400)) for k in lexicon for _ in range(8)] + ["", "12 3", None, "É"]
    out = language_id.identified(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()
    for x in out:
        raw = language_id.lowered(np.frombuffer((tests[x["doc_id"]] or "").encode(), np.uint8)).tobytes()
        entropy = {k: parsed(small[k], raw) * b / max(1, len(raw)) for k, b in zip(model.languages, model.bits, strict=True)}
        best, second = sorted(entropy.values())[:2]
        want = min(entropy, key=lambda k: (entropy[k], k)) if any(map(str.isalpha, tests[x["doc_id"]] or "")) else "und"
        assert x["lang_pred"] == want and x["score"] == pytest.approx(1 - best / second if want != "und" else 0)


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from cleargrain.llm.registry import QUERIES

    rows = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.95 * len(rows)


def network(words=(b"the", b"cat", b"sat")):
    lex = recurrent_lm.Lexicon(list(words), np.array([50, 30, 20][: len(words)]), 10, 110, 4, np.full(recurrent_lm.BINS, 0.1)).ready()
    return lex, recurrent_lm.fresh(lex)


def test_the_factored_softmax_sums_to_one():
    lex, net = network()
    h = np.random.default_rng(1).uniform(-1, 1, (5, recurrent_lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.output(h, np.full(5, s))[0].astype(float)) for s in range(lex.size))
    assert total == pytest.approx(1, abs=1e-4)


def test_gradients_of_the_output():
    lex, net = network()
    rng = np.random.default_rng(2)
    net.p["C"] += rng.normal(0, 0.3, net.p["C"].shape).astype(np.float32)
    h, y = rng.uniform(-1, 1, (6, recurrent_lm.HIDDEN)), rng.integers(0, lex.size, 6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, back = net.output(h, y, grad := {})
    for at in ((0, 0), (3, 5)):
        e = np.zeros_like(h)
        e[at] = 1e-5
        numeric = -(net.output(h + e, y)[0].sum() - net.output(h - e, y)[0].sum()) / 2e-5
        assert back[at] == pytest.approx(numeric, abs=1e-4)
    assert grad["C"].shape == net.p["C"].shape


def test_training_lowers_the_loss_and_state_is_carried():
    lex, net = network()
    r = random.Random(1)
    text = [x for _ in range(3000) for x in ((0, 1, 2) if r.random() < 0.95 else (2, 1, 0))]
    symbols, before = np.array(text[:900]), np.array([0, 900])
    untrained = net.score(symbols, before, lex.end)[0]
    net.train(np.array(text).reshape(20, -1), lex.end)
    trained = net.score(symbols, before, lex.end)[0]
    assert trained > 0.5 * untrained
    parts = net.score(symbols, np.array([0, 450, 900]), lex.end).sum()
    assert trained != pytest.approx(parts, abs=1e-6)  # the second half alone starts without the first's state


def test_held_out_scores_beat_the_counts(spark):
    from cleargrain.llm.registry import QUERIES

    rows = QUERIES["op3_recurrent_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_trust_and_distrust_follow_links(spark):
    """Trusted t links to a; b links to blocked s; c is linked by nobody."""
    link = lambda h: f'<a href="https://{h}/x">'
    pages = [(1, "http://t.good/", link("a.com") + link("a.com")), (2, "http://a.com/", link("a.com")), (3, "http://b.com/", link("s.bad") + "<a href='/in'>"), (4, "http://s.bad/", ""), (5, "http://c.com/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = (("good", "/", "allow"), ("bad", "/", "block"))
    got = {r["host"]: r for r in url_filter.judged(df, rules).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == {"t.good": "allow", "a.com": "allow", "b.com": "block", "s.bad": "block", "c.com": "allow"}
    assert got["a.com"]["trust"] == pytest.approx(1) and got["b.com"]["distrust"] == pytest.approx(1) and got["c.com"]["trust"] == 0
    assert {(r["source"], r["target"], r["weight"]) for r in url_filter.host_edges(df.withColumn("host", url_filter.host_of(df["url"]))).collect()} == {("t.good", "a.com", 2), ("b.com", "s.bad", 1)}


def test_distrust_hangs_on_what_a_host_links_to(spark):
    """Ten hosts that link only to a blocked host, and back; one with a link of many there; one trusted besides."""
    link = lambda h: f'<a href="https://{h}/x">'
    pages = [(f"http://farm{k}.com/", link("s.bad")) for k in range(10)]
    pages += [("http://s.bad/", "".join(link(f"farm{k}.com") for k in range(10))), ("http://one.com/", link("s.bad") + "".join(link(f"x{k}.com") for k in range(9)))]
    pages += [("http://t.good/", link("both.com")), ("http://both.com/", link("q.bad"))]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["host"]: r for r in url_filter.judged(df, (("good", "/", "allow"), ("bad", "/", "block"))).collect()}
    assert {h for h, r in got.items() if r["verdict"] == "block"} == {"s.bad", *(f"farm{k}.com" for k in range(10))}
    assert got["farm3.com"]["distrust"] == pytest.approx(1 / 1.85, abs=1e-3) and got["one.com"]["distrust"] < 0.3


@pytest.mark.parametrize("seed", range(2))
def test_linked_pages_against_the_sql(spark, tmp_path, seed):
    import duckdb

    r = random.Random(seed)
    hosts = [f"h{k}.{r.choice(['net', 'net', 'example.net', 'org', 'com', 'example.com', 'io'])}" for k in range(60)]
    link = lambda: f"<a href='//{r.choice(hosts)}/'>"
    rows = [(k, f"http://{r.choice(hosts)}{r.choice(['/en/', '/fr/', '/de/', '/'])}x", "".join(link() for _ in range(r.randint(0, 3)))) for k in range(240)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.sql(url_filter.SQL)
    got = url_filter.op1_url_filter(spark, str(tmp_path)).select(*want.columns).collect()
    found = sorted(want.fetchall(), key=repr)
    assert sorted(map(tuple, got), key=repr) == found
    assert {v for *_, rule, v in found if rule is None} == {"allow", "block"}


@pytest.mark.parametrize(("url", "host", "path"), [("HTTPS://A.B:80/x/y?z#q", "a.b:80", "/x/y"), ("x://?a", "", ""), ("no", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"), ("//x/y", "", ""), ("h://É.com#/a", "É.com", "")])
def test_hosts_and_paths(spark, url, host, path):
    r = spark.createDataFrame([(url,)], "u string").select(url_filter.host_of(url_filter.F.col("u")), url_filter.path_of(url_filter.F.col("u"))).first()
    assert tuple(r) == (host, path)
