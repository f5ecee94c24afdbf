"""Decontamination against exact scores and planted items."""

import random

import numpy as np
import pytest

from tidemark.llm import decontaminate as D
from tidemark.llm._shared import fresh


def material(seed=2):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)] + ["the", "of", "and"] * 60
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{say(rng.randint(8, 25))}. {say(rng.randint(6, 12))}.") for i in range(30)] + [(30, f"What is {say(9)}? It is {say(6)}."), (31, ""), (32, "two words")]
    return rng, say, items


def made(items):
    """The index of some items by themselves."""
    words = [w for _, t in items if len(w := D.words_of(t))]
    terms, frequency = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    lengths = [len(w) for w in words]
    return D.Index(items, D.Statistics(len(words), float(np.mean(lengths)), max(lengths)), terms, frequency)


def plain_scores(items, words):
    """BM25 by the book: position of an item among those with words -> its score, 1 against itself."""
    texts = [w.tolist() for _, t in items if len(w := D.words_of(t))]
    mean = sum(map(len, texts)) / len(texts)
    frequency = {t: sum(t in x for x in texts) for x in texts for t in x}

    def score(query, x):
        return sum(np.log1p((len(texts) - frequency[t] + 0.5) / (frequency[t] + 0.5)) * x.count(t) * (D.K1 + 1) / (x.count(t) + D.K1 * (1 - D.B + D.B * len(x) / mean)) for t in set(x) & query)

    query = set(words.tolist())
    return [score(query, x) / score(set(x), x) for x in texts]


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.4, 0.9])
def test_candidates_equal_exhaustive_scores(threshold):
    rng, say, items = material()
    index = made(items)
    text = D.words_of(say(700) + " " + items[4][1] + " " + say(90) + " other " * 200 + items[9][1])
    found = {(at, k): s for at, k, s in index.candidates(text, threshold)}
    expected = {}
    for at in range(0, len(text), index.stride):
        for k, s in enumerate(plain_scores(items, text[at : at + index.width])):
            if s >= threshold:
                expected[at, k] = s
    assert expected and found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-5 for k in found)


def test_the_pivot_leaves_blocks_out():
    _, _, items = material()
    index = made(items)
    term = np.unique(np.searchsorted(index.terms, D.words_of(items[4][1])))
    assert [x.tolist() for x in index.opened(np.full(len(term), 3), term, 0.9)] == [[3], [0]]
    assert not len(index.opened(np.zeros(2, np.int64), term[:2], 0.9)[0])


def test_thresholds_are_positive():
    _, _, items = material()
    with pytest.raises(ValueError):
        list(made(items).candidates(D.words_of("a b"), 0))


def test_item_scores_one_against_itself():
    _, _, items = material()
    index = made(items)
    for k, (_, text) in enumerate(x for x in items if x[1]):
        terms = np.flatnonzero(np.isin(index.terms, D.words_of(text)))
        assert abs(index.scores(terms, k // D.BLOCK_ITEMS)[k % D.BLOCK_ITEMS] - 1) < 1e-5


def test_planted_items_are_found_and_nothing_else(spark, docs):
    rng, say, items = material()
    planted = {i: rng.choice([32, *range(31)]) if i else 32 for i in range(0, 60, 3)}
    rows = [(i, f"{say(rng.randint(0, 400))} {items[planted[i]][1].upper() if i % 2 else items[planted[i]][1]} {say(rng.randint(0, 400))}" if i in planted else say(rng.randint(1, 500))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, say(100_000) + " " + items[7][1]), (0, rows[0][1])]
    benchmark = spark.createDataFrame(items + [(33, None)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in D.leaked_items(docs(rows), benchmark).collect())
    assert found == sorted([*planted.items(), (102, 7), (0, planted[0])])
    kept = D.remove_leaked(docs(rows), benchmark)
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in planted and i != 102)


def test_question_without_answer_is_no_leak(spark, docs):
    _, say, items = material()
    question = items[30][1].split("?")[0]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert D.leaked_items(docs([(1, f"{say(40)} {question} {say(40)}")]), benchmark).count() == 0


def test_short_items_are_found_word_for_word(spark, docs):
    benchmark = spark.createDataFrame([(1, "xylophone"), (2, "zebra crossing"), (3, "three short words"), (4, "why? because"), (None, "no id here at all")], "item_id long, text string")
    rows = [(1, "he plays the Xylophone, badly"), (2, "a zebra crossing ahead"), (3, "crossing zebra and nothing else"), (4, "these three short words"), (5, "why? because"), (6, "because why not"), (7, "zebra crossing"), (8, "there is no id here at all"), (None, "xylophone")]
    found = sorted(((r.doc_id, r.item_id) for r in D.leaked_items(docs(rows), benchmark).collect()), key=str)
    assert found == sorted([(1, 1), (2, 2), (4, 3), (5, 4), (7, 2), (8, None), (None, 1)], key=str)


def test_any_number_of_shards_gives_the_same_rows(spark, docs, monkeypatch):
    rng, say, items = material()
    items = items + [(7, items[8][1]), (40, items[3][1])]
    rows = [(i, f"{say(30)} {items[i][1]} {' '.join(items[i + 5][1].split()[:14])} {say(30)}") for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(D.leaked_items(docs(rows), benchmark).collect())
    assert {(i, i) for i in range(20)} <= {(r.doc_id, r.item_id) for r in one}
    for n in (7, 3):
        monkeypatch.setattr(D, "PASS_SHARDS", n - 1)
        many = sorted(D.leaked_items(docs(rows), benchmark, n).collect())
        assert [(r.doc_id, r.item_id, r.first_word, r.question_overlap, r.answer_overlap) for r in many] == [(r.doc_id, r.item_id, r.first_word, r.question_overlap, r.answer_overlap) for r in one]
        assert np.allclose([r.score for r in many], [r.score for r in one], atol=1e-6)
    assert [r.doc_id for r in D.remove_leaked(docs([*rows, (77, say(50))]), benchmark, 7).collect()] == [77]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaked_items(docs([(1, "a b")]), none).count() == 0
    assert D.remove_leaked(docs([(1, "a b")]), none).count() == 1
    assert D.remove_leaked(docs([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert fresh("leaks", ["Leaks", "leaks_"]) == "leaks__"
