"""Line, passage and near-duplicate operators, leaks and vectors against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictpast.llm import decontaminate, embedding_dedup, graph, line_dedup, minhash_dedup, suffix_dedup
from strictpast.llm.arrays import PLAIN, WHITE, blocks, pieces, range_hashes
from strictpast.llm.graph import components, in_parts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def union(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def random_text(r, n, vocabulary=4000):
    return [f"w{x}" for x in r.integers(0, vocabulary, n)]


def families(seed=1):
    """Originals with edited copies, short texts, long ones and exact copies."""
    r = np.random.default_rng(seed)
    texts = [None, "", "  \n", "one", "One", "two words", "TWO words", "a b c", "A B C", "x" * 5000]
    for size in (4, 12, 40, 150, 400):
        for _ in range(4):
            base = random_text(r, size)
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(r.integers(0, max(2, size // 25))):
                    copy[r.integers(0, len(copy))] = f"e{r.integers(0, 10**6)}"
                texts.append(("\n" if r.random() < 0.3 else " ").join(copy))
    base = random_text(r, 60)  # a large group in which not every pair is similar
    for _ in range(80):
        copy = list(base)
        for _ in range(r.integers(0, 4)):
            copy[r.integers(0, len(copy))] = f"f{r.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 30 + [" ".join(random_text(r, 8000))]
    order = r.permutation(len(texts))
    return [texts[i] for i in order]


def frame(spark, texts):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, component int").repartition(3)


def shingles(text, n, short=True):
    w = words((text or "").translate(LOWER))
    if len(w) < n:
        return {tuple(w)} if w and short else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_hashes_do_not_depend_on_blocks():
    import pyarrow as pa

    texts = ["a bc  d", None, "", "é\n" * 9, "long" * 700_000, "x y"]
    column = pa.array(["skipped", *texts]).slice(1)
    out = []
    for limit in (1, 1 << 21):
        found = []
        for _, data, offsets in blocks(column, limit):
            first, starts, ends = pieces(data, offsets, WHITE)
            hashes = range_hashes(data, starts, ends, PLAIN).tolist()
            found += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        out.append(found)
    assert out[0] == out[1]
    assert [len(f) for f in out[0]] == [len(words(t)) for t in texts]
    assert out[0][3] == [out[0][3][0]] * 9


def test_near_duplicates_equal_brute_force(spark):
    texts = families()
    sets = [shingles(t, 3) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    roots = union(len(sets), links)
    got = minhash_dedup.near_duplicates(frame(spark, texts), 3, 85).collect()
    assert sorted(tuple(r) for r in got) == [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, roots))]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, "q r s t u"), (3, "a b c d e"), (4, "q r s t u"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, 3, 85).collect()
    want = {None: (None, True), 1: (1, True), 2: (1, False), 3: (1, False), 4: (1, False), 5: (5, True), 6: (6, True)}
    assert len(got) == len(rows) and all((r.component_id, r.kept) == want[r.doc_id] for r in got)
    kept = minhash_dedup.one_of_each_group(docs.unionByName(docs.where("doc_id = 1")), 3, 85)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "6", "None"]
    assert minhash_dedup.near_duplicates(docs.limit(0), 3, 85).count() == 0


def test_few_dropped_documents_do_not_shuffle_the_texts(spark):
    """The stored table of all documents is above the limit for a broadcast, the keys that are dropped or repeated are not."""
    rows = [(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(6000)] + [(7000, "Alpha1 beta1 gamma1 delta1"), (2, "alpha2 beta2 gamma2 delta2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "24k")
    try:
        kept = minhash_dedup.one_of_each_group(docs, 3, 85)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(6000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pruning_keeps_the_miss_probability():
    from math import comb

    for n, least in zip(range(16, 97, 16), minhash_dedup.least_matches(0.85)):
        missed = sum(comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least))
        assert missed < 2e-6
    assert least > 0.5 * n  # the last bound, after all hashes


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000, 1000 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    roots = union(2100, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in components(df).collect()} == {x: roots[x] for x in nodes}
    assert components(df.limit(0)).count() == 0


def test_facts_repeated_for_parts_are_not_broadcast(spark):
    """The planner's size of exploded facts leaves out the copies, which the driver would hold."""
    rows = spark.range(3000).selectExpr("id node", "if(id < 1000, 0, id % 90) key")
    facts = spark.range(100).selectExpr("id key", "id * 7 fact")
    met = in_parts(rows, facts, "key", "node", 32)
    got = {(r.node, r.key, r.fact) for r in met.collect()}
    assert got == {(i, k, 7 * k) for i in range(3000) for k in [0 if i < 1000 else i % 90]}
    assert met.columns == ["key", "node", "fact"]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_stage_broadcasts_no_repeated_facts(spark, monkeypatch):
    """Every table that the pipeline's MinHash stage stores, as it is planned; facts are repeated by a column part."""
    plans, write = [], graph.stage

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(graph, "stage", kept)
    monkeypatch.setattr(minhash_dedup, "stage", kept)
    texts = families()
    assert 0 < minhash_dedup.one_of_each_group(frame(spark, texts), 5, 80).count() < len(texts)
    repeats = 0
    for plan in plans:
        above = []  # the broadcasts that a line of the plan stands under
        for line in plan.split("\n"):
            depth = len(re.match(r"[\s:+-]*", line).group())
            above = [d for d in above if d < depth] + [depth] * ("BroadcastExchange" in line)
            if re.search(r"Generate explode.*\[part#", line):
                repeats += 1
                assert not above, plan
    assert repeats


def brute_lines(texts, run, alone=None):
    seen, out = set(), []
    for text in texts:
        lines = [] if text is None else text.split("\n")
        bare = [x.strip(" \t\r\x0b\x0c") for x in lines]
        solid = [i for i, b in enumerate(bare) if b]
        gone = set()
        for k in range(len(solid) - run + 1):
            window = tuple(bare[i] for i in solid[k : k + run])
            if window in seen:
                gone.update(solid[k : k + run])
            seen.add(window)
        for i in solid:
            if alone is not None and len(words(lines[i])) >= alone:
                gone |= {i} if bare[i] in seen else set()
                seen.add(bare[i])
        out.append((None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(solid), len(gone)))
    return out


@pytest.mark.parametrize("run", [2, 4])
def test_lines_equal_brute_force(spark, run):
    r = np.random.default_rng(4)
    texts = [None, "", "\n\n", "a\na\na\na\na\na\na", " a \n\n a\n\tb", "a\nb" * 3]
    for _ in range(150):
        texts.append("\n".join(("  " if r.random() < 0.1 else "") + f"line {min(r.geometric(0.08), 40)}" for _ in range(r.integers(1, 15))))
    docs = frame(spark, texts).withColumn("n_removed", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_lines(docs, run).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, run)
    assert line_dedup.drop_repeated_lines(docs.limit(0), run).count() == 0


def test_long_single_lines_equal_brute_force(spark):
    """Lines of some words go where they stood earlier, also alone between other neighbours."""
    r = np.random.default_rng(14)
    long = [" ".join(random_text(r, n)) for n in (4, 5, 6, 50, 432)]
    texts = [None, "", *long, *long]
    for i in range(80):
        lines = [long[r.integers(0, len(long))] if r.random() < 0.2 else f"own {i} {k}" if r.random() < 0.6 else "all share" for k in range(r.integers(1, 9))]
        texts.append("\n".join(lines))
    seen, want = set(), []
    for text, (_, n, _) in zip(texts, brute_lines(texts, 2)):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for k, line in enumerate(lines):
            if k + 1 < len(lines):
                gone |= {k, k + 1} if (line, lines[k + 1]) in seen else set()
                seen.add((line, lines[k + 1]))
            if len(words(line)) >= 5:
                gone |= {k} if line in seen else set()
                seen.add(line)
        want.append((None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), n, len(gone)))
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.drop_repeated_lines(frame(spark, texts), alone=5).collect()}
    assert [got[i] for i in range(len(texts))] == want
    stage = {x.doc_id: x.text for x in line_dedup.deduplicated_lines(frame(spark, texts), alone=5).collect()}
    assert stage == {i: t for i, (t, n, gone) in enumerate(want) if not gone or gone < n}


def test_selected_positions_are_sparse_and_match_everywhere(spark):
    """A run of many lines is one chain of matches, each written once with the lines around it."""
    r = np.random.default_rng(24)
    shared = [f"shared {i}" for i in range(200)]
    texts = ["\n".join([f"own {i} {k}" for k in range(r.integers(0, 30))] + shared + [f"tail {i}"]) for i in range(12)]
    texts += ["\n".join(["again"] * 300), "\n".join(["again"] * 301), "\n".join(shared[:5]), "\n".join(shared[:3])]
    for run in (2, 4):
        docs = frame(spark, texts)
        got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.drop_repeated_lines(docs, run).collect()}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, run)
        prints = line_dedup.fingerprints(docs, run, "doc_id", "text").where("doc_id < 12").select("doc_id", "at", F.size("picks").alias("n"), F.greatest(F.size("before"), F.size("after")).alias("reach")).collect()
        assert len({(x.doc_id, x.at) for x in prints}) == len(prints)
        windows = sum(len(t.split("\n")) - run + 1 for t in texts[:12])
        assert sum(x.n for x in prints) == windows and len(prints) < windows * 0.8
        assert max(x.reach for x in prints) == line_dedup.REACH * run


def test_line_stage_keeps_the_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5), (2, "x\na\nb", 5), (3, "a\nb", 3), (4, None, None), (None, "a\nb", 3)], "doc_id long, text string, n_chars int")
    got = line_dedup.deduplicated_lines(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "a\nb\nc", 5), (2, "x", 1), (4, None, None), (None, "a\nb", 3)]))


def covered(texts, n):
    """Words of each text in runs of ``n`` that another text holds."""
    held = defaultdict(set)
    split = [words(t) for t in texts]
    for i, w in enumerate(split):
        for k in range(len(w) - n + 1):
            held[tuple(w[k : k + n])].add(i)
    return [{k + j for k in range(len(w) - n + 1) if len(held[tuple(w[k : k + n])]) > 1 for j in range(n)} for w in split]


def test_passages_are_sound_and_complete(spark):
    r = np.random.default_rng(6)
    shared = [random_text(r, n) for n in (49, 50, 51, 57, 80, 300)]
    texts = [None, "", "few words", " ".join(["again"] * 400), " ".join(random_text(r, 20_000))]
    for _ in range(120):
        parts = random_text(r, r.integers(0, 60))
        for _ in range(r.integers(0, 3)):
            passage = shared[r.integers(0, len(shared))]
            cut = r.integers(0, 12) if r.random() < 0.4 else 0
            parts += passage[cut:] + random_text(r, r.integers(0, 40))
        texts.append(" ".join(parts))
    texts += [texts[-1]] * 25 + [" ".join(shared[3])] * 40
    got = suffix_dedup.repeated_passages(frame(spark, texts)).collect()
    found = defaultdict(set)
    for s in got:
        assert s.n_words >= 50 and (s.earlier is None or s.earlier < s.doc_id)
        found[s.doc_id].update(range(s.first_word, s.first_word + s.n_words))
        body = texts[s.doc_id].encode()[s.first_byte : s.end_byte].decode()
        assert words(body) == words(texts[s.doc_id])[s.first_word : s.first_word + s.n_words]
    for i, (must, may) in enumerate(zip(covered(texts, 50), covered(texts, suffix_dedup.LENGTH - suffix_dedup.SPAN + 1))):
        assert must <= found[i] <= may
    assert suffix_dedup.repeated_passages(frame(spark, texts).limit(0)).count() == 0
    once = spark.createDataFrame([(1, " ".join(["again"] * 400)), (None, " ".join(shared[5])), (2, " ".join(shared[5]))], "doc_id long, text string")
    assert suffix_dedup.repeated_passages(once).count() == 0


@pytest.mark.parametrize("partitions", [1, 40])
def test_passages_between_copies_of_one_document(spark, partitions):
    """A document's own copies of a passage may lie between those of two documents in any number."""
    r = np.random.default_rng(16)
    texts = []
    for n in (50, 53, 60, 74, 90):
        passage = random_text(r, n)
        for copies in (10, 1, 45):
            texts.append(" ".join(w for _ in range(copies) for w in [*random_text(r, 15), *passage]) + " " + " ".join(random_text(r, 15)))
    texts += [" ".join(random_text(r, 30)), None]
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = suffix_dedup.repeated_passages(frame(spark, texts)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    found = defaultdict(set)
    for s in got:
        assert s.earlier is None or s.earlier < s.doc_id
        found[s.doc_id].update(range(s.first_word, s.first_word + s.n_words))
    for i, (must, may) in enumerate(zip(covered(texts, 50), covered(texts, suffix_dedup.LENGTH - suffix_dedup.SPAN + 1))):
        assert must <= found[i] <= may


def test_leaks_equal_brute_force(spark):
    r = np.random.default_rng(7)
    items = [random_text(r, n) for n in (5, 6, 9, 14, 20, 33, 59, 120, 3)]
    texts = [None, "", "short one"]
    for _ in range(150):
        parts = random_text(r, r.integers(0, 900))
        for _ in range(r.integers(0, 3)):
            item = list(items[r.integers(0, len(items))])
            if r.random() < 0.5:
                item[r.integers(0, len(item))] = "EDIT"
            at = r.integers(0, len(parts) + 1)
            parts = parts[:at] + [w.upper() for w in item] + parts[at:]
        texts.append(" ".join(parts))
    bench = spark.createDataFrame([(i, " ".join(x), "z") for i, x in enumerate(items)] + [(None, None, None), (90, "", "")], "item_id long, text string, leaks string")
    want = Counter()
    for i, t in enumerate(texts):
        mine = shingles(t, 5, short=False)
        for k, item in enumerate(items):
            q = shingles(" ".join(item), 5, short=False)
            if q and 100 * len(q & mine) >= 80 * len(q):
                want[i, k, len(q), len(q & mine)] += 1
    docs = frame(spark, texts).withColumn("leaks", F.lit(1))
    got = Counter(tuple(x) for x in decontaminate.contaminations(docs, bench).collect())
    assert got == want and len(want) > 50
    several = decontaminate.contaminations(docs, bench, limit=300)
    assert Counter(tuple(x) for x in several.collect()) == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {k[0] for k in want}
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminations(docs.limit(0), bench).count() == 0


def test_short_items_are_found_whole(spark):
    r = np.random.default_rng(17)
    items = [["Ab"], ["ab"], ["b", "c"], ["c", "b"], ["w1", "w2", "w3"], ["w1", "w1", "w1", "w1"], random_text(r, 5), [], random_text(r, 20)]
    texts = [None, "", "ab", "AB b\nC", "c", "w1 w2", "w1 w2 w3 w1 w2 w3", "w1 " * 5, "abc", "b", "c b", " ".join(items[8]) + " w1 w2  w3"]
    texts += [" ".join(r.choice(["ab", "b", "c", "w1", "w2", "w3"], r.integers(0, 12))) for _ in range(60)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None)], "item_id long, text string")
    want = Counter()
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            n = min(len(item), 5)
            q, mine = shingles(" ".join(item), 5), shingles(t, n, short=False) if n else set()
            if q and 100 * len(q & mine) >= 80 * len(q):
                want[i, k, len(q), len(q & mine)] += 1
    for limit in (decontaminate.ITEM_BYTES, 20):
        got = decontaminate.contaminations(frame(spark, texts), bench, limit=limit, short=True)
        assert Counter(tuple(x) for x in got.collect()) == want
    clean = decontaminate.clean_documents(frame(spark, texts), bench, short=True)
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {k[0] for k in want}
    assert {k[1] for k in want} == {0, 1, 2, 3, 4, 5, 8}


def test_items_of_one_text_are_indexed_once(spark):
    """A text that most items hold makes one row of one block, and each of its items is told."""
    r = np.random.default_rng(27)
    hot, other = (" ".join(random_text(r, 30)) for _ in range(2))
    rows = [(i, hot) for i in range(500)] + [(500, other), (501, None), (502, "")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, "text", 100))
    assert sorted(x.text for block in blocks for x in block) == sorted([hot, other, ""])
    docs = frame(spark, [f"before {hot} after", other, "nothing of it", None])
    for limit in (100, decontaminate.ITEM_BYTES):
        got = decontaminate.contaminations(docs, bench, limit=limit, short=True).collect()
        assert sorted((x.doc_id, x.item_id) for x in got) == [*((0, i) for i in range(500)), (1, 500)]
    renamed = decontaminate.contaminations(docs.select("doc_id", "text").toDF("class", "n_item"), bench.toDF("key", "leaks"), key="class", item_key="key", text="n_item", item_text="leaks")
    assert renamed.columns == ["class", "key", "n_item", "n_shared"] and renamed.count() == 501


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 60)
    r = np.random.default_rng(8)
    vectors = [r.normal(size=24) for _ in range(150)]
    for i in range(0, 150, 5):
        vectors += [vectors[i] + r.normal(size=24) * s for s in (0.02, 0.1, 0.15, 0.2)] + [vectors[i] * 3, vectors[i]]
    vectors += [vectors[0] + r.normal(size=24) * 0.05 for _ in range(100)]
    vectors = [v.astype(np.float32) for v in vectors]
    odd = [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(None, [float(x) for x in vectors[0]], 1)]
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    roots = union(len(x), zip(*np.nonzero(near)))
    want = {(i, int(near[i].sum()), c, i == c) for i, c in enumerate(roots)}
    want |= {(1000 + i, 0, 1000 + i, True) for i in range(6)} | {(1006, 1, 1006, True), (1007, 1, 1006, False), (None, 0, None, True)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, weight int").repartition(3)
    assert {tuple(g) for g in embedding_dedup.near_vectors(table).collect()} == want
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(9)
    turn = embedding_dedup.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    a = r.normal(size=(2000, 64))
    b = a * 0.5 + r.normal(size=(2000, 64))
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    signs = np.sign(a @ turn.T) / 8
    factor = np.abs(a @ turn.T).sum(axis=1) / 8
    estimate = (signs * (b @ turn.T)).sum(axis=1) / factor
    error = estimate - (a * b).sum(axis=1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= embedding_dedup.DEVIATIONS * np.sqrt((1 - factor**2) / 63) / factor).all()


def test_cells_out_of_reach_are_not_compared():
    pivots = {2: np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])}
    cells = [(2, 0, 10, 0.1), (2, 1, 10, 1.2), (2, 2, 10, 0.1)]
    near = {c: set(n) for _, c, _, n in embedding_dedup.block_lists(cells, pivots, np.arccos(0.9))}
    assert near == {0: {0, 1}, 1: {0, 1, 2}, 2: {1, 2}}
