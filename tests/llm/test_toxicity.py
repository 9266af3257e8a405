"""Scoring remembers what it has looked up, and counts by arrays: the same as word by word."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from frameops.llm import deobfuscate, toxicity
from frameops.llm.deobfuscate import WORD, Channel, LetterModel, Restorer, text_trigrams, trigram_counts

WORDS = "you are an idiot and a stupid loser the clown is trash worthless all of it was so good été straße"


@pytest.fixture(scope="module")
def model():
    letters = LetterModel(trigram_counts(Counter(WORDS.split() * 50)))
    weights = {"idiot": 2.0, "idi*": 0.5, "stup*": 1.0, "loser": 1.5, "trash*": 0.3, "été": 0.7, "all": 0.2, "wor*": 0.1}
    return toxicity.Model(letters, Channel(), weights, -3.0)


def noisy(rng: random.Random) -> str:
    word = "".join(c * rng.choice([1, 1, 1, 1, 2, 3]) for c in rng.choice([*WORDS.split(), "idiotic", "stupidly", "trashy"]))
    if rng.random() < 0.2:
        word = word.replace("i", "1").replace("o", "0").replace("s", "$")
    return rng.choice(["", "", '"', "("]) + word.title() + rng.choice(["", "", ".", "!", ",x", "-idiot", "_", "2"])


def test_scores_are_those_of_all_features(model):
    rng, score = random.Random(4), model.scorer()
    restorer = Restorer(model.letters, model.channel)
    for _ in range(300):
        text = " ".join(noisy(rng) for _ in range(rng.randint(0, 6))) + rng.choice(["", " i d i o t ", " s.t.u.p.i.d"])
        found = {f for group in restorer.words(text) for word in group for f in toxicity.features_of(word)}
        assert toxicity.features_in(restorer, text) == found
        z = model.bias + sum(model.weights[f] for f in sorted(found) if f in model.weights)
        assert score(text) == score(text) == float(1 / (1 + np.exp(-z)))


def test_scoring_forgets_within_a_bound(model, monkeypatch):
    rng, whole = random.Random(5), model.scorer()
    texts = [" ".join(noisy(rng) for _ in range(5)) for _ in range(100)]
    expected = [whole(text) for text in texts]
    monkeypatch.setattr(toxicity, "MOST_KEPT", 3)
    some = model.scorer()
    assert [some(text) for text in texts] == expected


def test_runs_seen_before_are_not_looked_up_again(model, monkeypatch):
    calls, looked_up = [], toxicity.features_of
    monkeypatch.setattr(toxicity, "features_of", lambda word: calls.append(word) or looked_up(word))
    score, text = model.scorer(), "You idiot, all is stupidly worthless"
    first = score(text)
    assert calls
    calls.clear()
    assert score(text + " ") == first and not calls


def test_words_that_only_begin_like_a_feature_are_not_looked_up(model, monkeypatch):
    monkeypatch.setattr(toxicity, "features_of", lambda word: pytest.fail(word))
    assert model.scorer()("trace losing allow ideal students") == float(1 / (1 + np.exp(3.0)))


@pytest.mark.parametrize("block", [1, 2, 5, 1 << 20])
def test_trigrams_of_texts_are_those_of_their_words(block):
    rng = random.Random(6)
    alphabet = "aabcdzßéÿ÷ÉÞ xX.\n\0-'0İΣςKÅ日😀\ud800"
    for n in (0, 1, 7, 40):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]
        words = Counter(word for text in texts for word in WORD.findall(text.lower()))
        expected = trigram_counts(words) if words else np.zeros(deobfuscate.SIZE**3, dtype=np.int64)
        assert (text_trigrams(texts, block) == expected).all()
