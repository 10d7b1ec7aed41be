"""The corpus pipeline's stages, each on what the one before kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], "/root/testdata/sf0.001").persist()
        out.append(made)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_filters_keep_rows_as_they_are(stages):
    rows = [{tuple(r) for r in s.collect()} for s in stages[:3]]
    assert rows[2] < rows[1] < rows[0]


def test_near_duplicates_against_all_pairs(stages):
    docs = [(r["doc_id"], r["text"].lower().split()) for r in stages[1].collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in docs}
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"] for r in stages[2].collect()} == set(label.values())


def test_repeats_are_gone_and_the_rest_stays(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) <= len(before[d]) for d, r in after.items())
    from test_contracts import removed

    ids = sorted(before)
    for d, (n, gone, *_) in zip(ids, removed([before[d].encode() for d in ids]), strict=True):
        assert abs(len(after[d]["text"].encode()) - (n - gone)) <= 8


def test_the_mix_takes_each_document_twice_at_most(stages):
    words = {r["doc_id"]: r["text"].split() for r in stages[3].collect()}
    taken = {}
    for r in stages[4].collect():
        taken.setdefault(r["doc_id"], []).append(r["text"].split())
    assert all(len(v) <= 2 and all(len(x) <= len(words[d]) for x in v) for d, v in taken.items())
    total = sum(map(len, words.values()))
    assert sum(len(x) for v in taken.values() for x in v) == pytest.approx(1.5 * total, rel=0.25)


def test_packed_tokens_are_those_of_the_mix(stages):
    rows = stages[5].collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[4].collect()}


def test_edge_rows_go_through(spark, edges):
    """Null, empty, word-less, short, long and repeated rows, a null id, a null source, clashing columns: what each stage leaves."""
    out, docs = [], edges
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").persist()
        out.append(docs.collect())
    quality, near, repeats, mix, packed = out
    by = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    kept = {None, 4, 5, 6, 8, 9}  # 7 is all capitals, the rest has fewer than 20 words
    assert by(quality) == sorted([(d is None, d or 0) for d in kept] + [(False, 5)])
    assert by(near) == sorted((d is None, d or 0) for d in (None, 4, 5, 5, 9))  # 6 and 8 are like 5, which is there twice
    assert by(repeats) == by(near) and {r["text"] for r in repeats if r["doc_id"] == 5} == {""}  # each row of 5 repeats the other
    assert all(r["n_chars"] == len(r["text"]) and r["group_"] == "group_" for r in repeats)
    assert {r["doc_id"] for r in mix} == {None, 4, 9} and {r["doc_id"] for r in packed} == {None, 4, 9}
    assert sum(len(r["text"].split()) for r in mix) == pytest.approx(1.5 * sum(len(r["text"].split()) for r in repeats), abs=1024)


def test_empty_tables_go_through(spark, edges):
    docs = edges.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
        assert docs.columns == edges.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
