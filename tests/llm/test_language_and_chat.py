"""Language mixtures by held-out accuracy, chat snapshots against brute force and SQL."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictpast.llm import chat_snapshots, language_mixture
from strictpast.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SYLLABLES = {"aa": "ba be bi lo la".split(), "bb": "kru tsk gro vru mzo".split(), "cc": "éa ùo îe çà ôi".split()}


def text_of(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang], 3)) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(1)
    rows = [(i, text_of(r, lang := r.choice(list(SYLLABLES)), r.integers(3, 60)), str(lang) if r.random() < 0.9 else None, str(lang)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy(labelled):
    held = {r.doc_id for r in labelled.where(language_mixture.held_out()).collect()}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    model = language_mixture.fit(labelled.where(~language_mixture.held_out()))
    got = language_mixture.identify(labelled.drop("lang"), model).where(language_mixture.held_out()).collect()
    assert np.mean([r.lang_pred == r.truth for r in got]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_are_recovered(spark, labelled):
    model = language_mixture.fit(labelled)
    r = np.random.default_rng(2)
    mixed = text_of(r, "aa", 300) + " " + text_of(r, "bb", 100)
    docs = spark.createDataFrame([(1, mixed), (2, text_of(r, "cc", 30_000))], "doc_id long, text string")
    one, two = language_mixture.identify(docs, model).orderBy("doc_id").collect()
    assert one.lang_pred == "aa" and set(one.shares) == {"aa", "bb"}
    assert abs(one.shares["aa"] - 0.72) < 0.1  # by n-grams; words of bb are longer
    assert set(two.shares) == {"cc"} and two.score == 1.0


def test_undetermined_and_odd_rows(spark, labelled):
    model = language_mixture.fit(labelled)
    rows = [(1, None), (2, ""), (3, " 12 ... \n"), (4, "b"), (None, "balolo bebi"), (4, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = language_mixture.identify(docs, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "aa"), ("4", "aa"), ("None", "aa")])
    assert language_mixture.identify(docs.limit(0), model).count() == 0
    assert language_mixture.fit(labelled.limit(0)) is None
    assert {r.lang_pred for r in language_mixture.identify(docs, None).collect()} == {"und"}


def test_stage_rejects_only_what_is_no_language(spark, labelled):
    docs = labelled.select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(9000, "9 9 9", "aa"), (9001, None, None)], docs.schema)
    kept = language_mixture.kept_languages(docs.unionByName(junk))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(600))


def test_any_number_of_labels_is_learned(spark, monkeypatch):
    rows = [(i, " ".join(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}" for _ in range(20)), f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mixture.fit(docs)
    assert len(model.languages) == 300
    got = language_mixture.identify(docs.drop("lang"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}
    monkeypatch.setattr(language_mixture, "LANGUAGES", 7)
    again = language_mixture.fit(docs)  # tasks hold seven languages at once
    assert again.languages == model.languages and all((getattr(again, n) == getattr(model, n)).all() for n in ("first", "which", "counts", "totals"))
    text = np.frombuffer(f" {rows[5][1]} ".encode(), np.uint8)
    kept, table = model.likelihoods(*np.unique(language_mixture.grams(text), return_counts=True))
    assert len(kept) == table.shape[1] == 7 and 5 in kept
    assert model.mixture(text)[0].argmax() == 5


def plain_mixture(counts, total, names, text):
    """Mixture of one text by dictionaries and loops: proportions by name and likelihood."""
    held = Counter()
    data = b" " + text.lower().encode() + b" "
    for i in range(len(data) - 2):
        code = (data[i] * 257 + data[i + 1]) * 257 + data[i + 2]
        held[(code * 0x9E3779B97F4A7C15 % 2**64) >> 50] += 1
    n = sum(held.values())
    chance = {b: {g: (counts[g][b] + 0.1) / total[g] for g in names} for b in held}

    def maximise(shares):
        before = -math.inf
        for _ in range(50):
            mixed = {b: sum(s * chance[b][g] for g, s in shares.items()) for b in held}
            fit = sum(c * math.log(mixed[b]) for b, c in held.items())
            if fit - before < 1e-4 * max(1.0, n**0.5) or len(shares) == 1:
                break
            before = fit
            shares = {g: s * sum(c * chance[b][g] / mixed[b] for b, c in held.items()) / n for g, s in shares.items()}
        return shares, fit

    shares, fit = maximise({g: 1 / len(names) for g in names})
    while len(shares) > 1:
        weakest = min(shares, key=shares.get)
        fewer = {g: s + 1e-9 for g, s in shares.items() if g != weakest}
        fewer, less = maximise({g: s / sum(fewer.values()) for g, s in fewer.items()})
        if less < fit - 0.5 * math.log(n):
            break
        shares, fit = fewer, less
    return shares


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")
def test_query_equals_a_plain_mixture(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, total = defaultdict(Counter), {}
    for d in docs:
        if d.text is not None and d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            data = b" " + d.text.lower().encode() + b" "
            counts[d.lang].update((((data[i] * 257 + data[i + 1]) * 257 + data[i + 2]) * 0x9E3779B97F4A7C15 % 2**64) >> 50 for i in range(len(data) - 2))
    names = sorted(counts)
    total = {g: sum(counts[g].values()) + 0.1 * 2**14 for g in names}
    got = {r.doc_id: r for r in QUERIES["op6_language_mixture"](spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for d in docs:
        mine = got[d.doc_id]
        assert mine.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        if not d.text or not any(map(str.isalpha, d.text)):
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
        else:
            shares = plain_mixture(counts, total, names, d.text)
            assert mine.lang_pred == max(shares, key=shares.get) and abs(mine.score - max(shares.values())) < 1e-6


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"),  # a copy of 2
    (4, 0, "user", "hi"), (4, 5, "assistant", "no"),  # gaps do not matter
    (5, 7, "user", "hi"),
    (6, 0, "user", None), (7, 0, "user", ""), (8, 0, None, "hi"),
    (9, 0, "user", "hi"), (9, 0, "user", "hi"), (9, None, "system", "be short"),
    (None, 0, "user", "lost"), (None, 1, "user", "and found"),
]


def brute_chats(turns):
    talks = {}
    for conv, turn, role, text in turns:
        talks.setdefault(conv, []).append(((turn is not None, turn or 0), role, text))
    talks = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in talks.items()}
    out = []
    for c, mine in talks.items():
        if any(len(o) > len(mine) and o[: len(mine)] == mine for o in talks.values()):
            continue
        alike = [k for k, o in talks.items() if o == mine]
        least = min((k for k in alike if k is not None), default=None)
        if c == least or (least is None and c is None):
            chat = "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in mine)
            out.append((c, len(mine), len(alike), chat))
    return sorted(out, key=str)


def collapsed(turns):
    return sorted(map(tuple, chat_snapshots.render(turns, chat_snapshots.collapse_snapshots(turns)).collect()), key=str)


def test_snapshots_equal_brute_force(spark):
    schema = "conv_id long, turn int, role string, text string"
    small = spark.createDataFrame(TURNS, schema)
    assert collapsed(small.withColumn("chat", F.lit("clash")).repartition(3)) == brute_chats(TURNS)
    assert collapsed(small.limit(0)) == []
    r = np.random.default_rng(3)
    many = [(int(c), t, "user", f"t{x}") for c in range(200) for t, x in enumerate(r.integers(0, 2, r.integers(1, 7)))]
    many += [(1000 + c, t, "user", "same") for c in range(60) for t in range(c % 4 + 1)]
    many += [(5000, t, "user", str(t)) for t in range(3000)]
    assert collapsed(spark.createDataFrame(many, schema)) == brute_chats(many)


def test_no_python_in_the_plan(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    plan = chat_snapshots.render(turns, chat_snapshots.collapse_snapshots(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
