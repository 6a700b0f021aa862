"""User columns of any name in the pipeline's stages, and keys that stand for several vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strictpast.llm import embedding_dedup, minhash_dedup, sentencepiece_codec

NAMES = ("lines", "starts", "key", "_key", "score", "lang_pred", "shares", "explained", "n_lines", "n_removed", "leaks", "_leak", "rest", "pad", "node", "a", "b")


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_user_columns(spark, tmp_path, stage):
    r = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(r.choice(words, 40)) for _ in range(12)] + ["same first line here\nand the second one\n" + " ".join(r.choice(words, 30)) for _ in range(4)]
    texts += [texts[0], "item with a leak of several words in a row that nobody else has", None, "12 34"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    extra = docs.select("*", *(F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in NAMES))
    spark.createDataFrame([(1, texts[-3])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    function = corpus_pipeline.STAGES[stage][1]
    plain, rich = function(spark, docs, str(tmp_path)), function(spark, extra, str(tmp_path))
    assert plain.columns == docs.columns and rich.columns == extra.columns
    got = rich.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, (tuple(r) for r in plain.collect())))
    assert 0 < len(got) < len(rows) + (stage == 1) and all(r[n] == f"{n}-{r.doc_id}" for r in got for n in NAMES)


def test_repeated_keys_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.99, 0.01, 0.0]), (3, [0.0, 0.0, 1.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_all_batches_together_keep_the_miss_probability(threshold):
    """The chance that a pair at the threshold is pruned by any batch, step by step."""
    from math import comb

    alive, missed = {0: 1.0}, 0.0
    for least in minhash_dedup.least_matches(threshold):
        after = {}
        for m, p in alive.items():
            for k in range(minhash_dedup.BATCH + 1):
                after[m + k] = after.get(m + k, 0.0) + p * comb(minhash_dedup.BATCH, k) * threshold**k * (1 - threshold) ** (minhash_dedup.BATCH - k)
        missed += sum(p for m, p in after.items() if m < least)
        alive = {m: p for m, p in after.items() if m >= least}
    assert 0 < missed <= minhash_dedup.MISS


def test_ties_connect_all_plausible_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 60000, (5, minhash_dedup.SKETCH)).astype(np.uint16)
    sketch = base[r.integers(0, 5, 60)]
    sketch = np.where(r.random(sketch.shape) < 0.05, r.integers(0, 60000, sketch.shape), sketch).astype(np.uint16)
    node, component = np.arange(100, 160), np.arange(60) // 2
    main = component == 0
    found = list(minhash_dedup._forest(0.8)(node[~main], component[~main], sketch[~main], node, component, sketch))
    label = {int(n): int(c) for n, c in zip(node, component)}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    parent = {c: c for c in set(label.values())}
    for a, b in found:
        parent[root(label[int(a)])] = root(label[int(b)])
    bounds = minhash_dedup.least_matches(0.8)
    for i in range(60):
        for j in range(60):
            if all((sketch[i, : 16 * (s + 1)] == sketch[j, : 16 * (s + 1)]).sum() >= m for s, m in enumerate(bounds)):
                assert root(label[100 + i]) == root(label[100 + j])
    assert len(found) < 3 * 60


def test_matrix_agenda_equals_the_heap():
    import public_tokenizers

    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyzäé漢字▁.,😀\x00")
    segments = ["▁" + "".join(r.choice(letters[:26], r.integers(1, 47))) for _ in range(800)] + ["▁" + "".join(r.choice(letters, r.integers(1, 30))).replace("▁", "") for _ in range(300)] + ["▁", "▁a", "aaaaaaaa", "▁" + "lo" * 20]
    for segment, ids in zip(segments, codec.encode_short(segments)):
        assert ids is None or ids == codec.encode_segment(segment)
    assert sum(i is None for i in codec.encode_short(segments)) < 300
    texts = [" ".join(s[1:] for s in segments[i : i + 9]) for i in range(0, 1100, 9)] + ["", " ", "  a  b", "a▁b", "x" * 300]
    assert [t for t, _ in codec(texts)] == [",".join(map(str, codec.library.encode(t))) for t in texts]
    codec.check()
