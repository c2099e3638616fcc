"""The pipeline's stages, each on its own input, against brute force."""

import random
from fractions import Fraction

import corpus_pipeline
from tests.llm.test_operators import EDGES, LETTERS, brute_components, edited


def test_stages(spark, tmp_path):
    r = random.Random(4)
    text = lambda k: " ".join(f"w{min(int(random.Random(k * 1000 + i).expovariate(0.05)), 200)}" for i in range(80)).translate(LETTERS)
    texts = [text(k) for k in range(120)]
    texts += [texts[3], texts[3], edited(texts[5], r, 1), "mail me at a.b@example.com " + text(500), None]
    texts += [" ".join("".join(r.choice("#$%&*") for _ in range(7)) for _ in range(50)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({x["doc_id"]: x for x in docs.collect()})
    good, single, apart, clean, packed = seen
    assert len(set(good) & set(range(120))) >= 118 and not set(good) & set(range(124, 130))
    expected = {max(j for j in good if texts[j] == texts[i]) for i in good}
    assert set(single) == expected
    order = sorted(single)
    _, component = brute_components([texts[i] for i in order], 5, Fraction(4, 5))
    assert set(apart) == {order[c] for c in component.values()}
    assert set(clean) == set(apart)
    if 123 in clean:
        assert "<EMAIL>" in clean[123]["text"] and clean[123]["n_chars"] == len(clean[123]["text"])
    assert set(packed) == set(clean)


def test_edges(spark, tmp_path):
    """No rows, no labels, nulls in every column, repeated rows and columns whose names clash with the operators' own."""
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, key int, n int, text_sha256 string, _digest string"
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(i, t, None, None, None, "x", None, 2, "y", None) for i, t in enumerate(EDGES)] + [(4, "a", None, None, None, "x", None, 2, "y", None), (None,) * 10]
    for name, given in (("empty", []), ("edges", rows)):
        docs = spark.createDataFrame(given, shape)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = {x["doc_id"] for x in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()}
        with_words = {i for i, t in enumerate(EDGES) if t and t.split()} if given else set()
        assert found <= with_words
        # of the two equal texts the later one stays
        assert not given or {4, 5, 6, 7, 11} <= found and 10 not in found
