"""Operator 11: accuracy on documents that were not learned from, planted mixtures, a plain estimation."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from costdocs.llm import language_mixture as mix
from costdocs.llm.common import table
from tests.llm.conftest import MESSY, as_docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def counts(documents):
    return mix.learn(documents.where(~mix.held_out(documents.doc_id)))


@pytest.fixture(scope="module")
def model(counts):
    return mix._model(counts, mix.Mixture().even)


def plain_trigrams(text):
    """Counters of a text's trigrams, one letter after the other."""
    letters = [0]
    for symbol in mix._symbols(text).tolist() + [0]:
        if symbol or letters[-1]:
            letters.append(symbol)
    triples = np.array([letters[i : i + 3] for i in range(len(letters) - 2) if letters[i + 1]], np.uint32).reshape(-1, 3)
    return Counter(int(mix._slots(t)[0]) for t in triples)


def plain_mixture(found, shares, how):
    """The same search, a text and a language at a time, with estimation run to its end."""

    def likelihood(parts):
        return sum(n * math.log(sum(p * shares[s, i] for i, p in parts.items())) for s, n in found.items())

    total = sum(found.values())
    best = max(range(shares.shape[1]), key=lambda i: likelihood({i: 1.0}))
    parts, known = {best: 1.0}, likelihood({best: 1.0})
    while len(parts) < shares.shape[1]:
        weight = {s: n / sum(p * shares[s, i] for i, p in parts.items()) for s, n in found.items()}
        slope = {i: sum(w * shares[s, i] for s, w in weight.items()) for i in range(shares.shape[1]) if i not in parts}
        new = {**{i: 0.9 * p for i, p in parts.items()}, max(slope, key=slope.get): 0.1}
        for _ in range(how.rounds):
            after = dict.fromkeys(new, 0.0)
            for s, n in found.items():
                whole = sum(p * shares[s, i] for i, p in new.items())
                for i, p in new.items():
                    after[i] += n * p * shares[s, i] / whole / total
            new = after
        if likelihood(new) - known <= how.penalty * math.log(total):
            break
        parts, known = new, likelihood(new)
    return parts


def test_trigrams_are_those_of_the_letters(monkeypatch):
    texts = [t for _, t, _ in MESSY] + ["Éa b", "a", "..", "áb", "ÄÖ ß\n\nx", "日本語 テキスト", "नमस्ते"]
    for window in (mix.WINDOW, 7):
        monkeypatch.setattr(mix, "WINDOW", window)
        rows, slots, n = mix.trigrams(texts)
        for i, text in enumerate(texts):
            own = rows == i
            wanted = plain_trigrams(text) if text and mix.has_letter(text) else {}
            assert dict(zip(slots[own].tolist(), n[own].tolist())) == dict(wanted)


def test_mixtures_are_those_of_plain_estimation(documents, model):
    langs, shares = model
    how = mix.Mixture(rounds=25, enough=0.0)
    by_lang = {r["lang"]: r["text"] for r in documents.where("length(text) between 700 and 1500").orderBy("doc_id").collect()}
    texts = [by_lang["en"], by_lang["fr"] + " " + by_lang["de"], " ".join(by_lang[k][:600] for k in langs), "abc", ""]
    rows, slots, n = mix.trigrams(texts)
    got = mix.mixtures(rows, slots, n, len(texts), shares, how)
    for i, text in enumerate(texts):
        wanted = plain_mixture(plain_trigrams(text), shares, how) if text else {}
        assert got[i] == pytest.approx([wanted.get(j, 0.0) for j in range(len(langs))], abs=1e-9)


def test_languages_of_documents_that_taught_nothing(documents, counts):
    got = mix.languages(documents, counts).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r["held_out"] and len(r["text"]) > 100]
    assert len(unseen) > 200 and sum(r["lang_pred"] == r["lang"] for r in unseen) >= 0.98 * len(unseen)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["parts"] == sorted(r["parts"], reverse=True)
        assert not r["langs"] or (r["langs"][0] == r["lang_pred"] and r["parts"][0] == pytest.approx(r["score"]) and sum(r["parts"]) == pytest.approx(1))


def test_planted_mixtures(documents, model):
    langs, shares = model
    rng, by_lang = random.Random(3), {}
    for r in documents.where("length(text) between 1500 and 8000").orderBy("doc_id").collect():
        by_lang.setdefault(r["lang"], []).append(r["text"])
    chosen = [rng.sample(langs, rng.choice([1, 2, 3])) for _ in range(150)]
    cut = [[rng.choice(by_lang[k])[: rng.choice([700, 1500])] for k in some] for some in chosen]
    rows, slots, n = mix.trigrams([" ".join(parts) for parts in cut])
    got = mix.mixtures(rows, slots, n, len(cut), shares, mix.Mixture())
    right = [set(np.array(langs)[got[i] > 0].tolist()) == set(chosen[i]) for i in range(len(cut))]
    assert sum(right) >= 0.9 * len(right)
    for i, (some, parts) in enumerate(zip(chosen, cut)):
        if right[i]:
            for k, part in zip(some, parts):
                assert got[i][langs.index(k)] == pytest.approx(len(part) / sum(map(len, parts)), abs=0.12)


def test_messy_documents(spark, messy, no_docs):
    got = {r["doc_id"]: r for r in mix.predicted_languages(messy).where("doc_id is not null").collect()}
    assert mix.predicted_languages(messy).count() == len(MESSY)
    for i in (1, 2, 3):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["n_trigrams"]) == ("und", 0.0, 0)
    assert got[7]["lang_pred"] == "en" and got[7]["score"] == 1
    assert mix.predicted_languages(no_docs).collect() == []
    digits = as_docs(spark, [(1, "12 || 34", "s"), (2, "\u0301\u0302", "s"), *((i, "ẍ", "s") for i in range(3, 20))])
    assert {r["doc_id"]: r["lang_pred"] for r in mix.predicted_languages(digits).collect()} == {1: "und", 2: "und", **dict.fromkeys(range(3, 20), "en")}


def test_without_labels_nothing_is_learned(messy):
    from pyspark.sql import functions as F

    got = mix.predicted_languages(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == len(MESSY) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_inputs_of_a_prediction(documents, counts):
    from pyspark.sql import functions as F

    other = documents.withColumns({"lang": F.lit("xx"), "source": F.lit("fr"), "n_chars": F.lit(0)})
    columns = ["doc_id", "lang_pred", "score"]
    assert sorted(mix.languages(other, counts).select(columns).collect()) == sorted(mix.languages(documents, counts).select(columns).collect())


def test_company_does_not_matter(documents, counts):
    whole = sorted(map(str, mix.languages(documents, counts).collect()))
    assert sorted(map(str, mix.languages(documents.repartition(7), counts).collect())) == whole
