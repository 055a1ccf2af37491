"""The parts that operators are made of, against definitions."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dataroute.llm import blocks, hashing, toxicity
from dataroute.llm.components import components
from dataroute.llm.suffix_array import suffix_array


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=400, deadline=None)
def test_suffix_array(symbols):
    text = [*symbols, 0]
    expected = sorted(range(len(text)), key=lambda k: text[k:])
    assert suffix_array(np.array(text)).tolist() == expected


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1500, "abaab" * 400, "".join(map(str, range(900)))])
def test_suffix_array_of_long_texts(text):
    data = np.r_[np.frombuffer(text.encode(), np.uint8).astype(int), 0]
    whole = bytes(data.astype(np.uint8))
    assert suffix_array(data).tolist() == sorted(range(len(data)), key=lambda k: whole[k:])


@given(st.lists(st.text(alphabet="aB é\n\t ", max_size=12), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    encoded = [x.encode() for x in texts]
    (found,), first = hashing.words_of(encoded)
    assert np.diff(first).tolist() == [len(x.split()) for x in encoded]
    words = [w for x in encoded for w in x.split()]
    same = {}
    for word, value in zip(words, found.tolist(), strict=True):
        assert same.setdefault(word, value) == value
    assert len(set(same.values())) == len(same)


def test_word_hashes_across_segments(monkeypatch):
    words = [b"w%d" % (k % 50) for k in range(4000)] + [b"x" * 5000]
    (whole,), _ = hashing.words_of([b" ".join(words)])
    monkeypatch.setattr(hashing, "SEGMENT", 100)
    (cut,), _ = hashing.words_of([b" ".join(words)])
    assert (whole == cut).all()


def test_cover():
    from dataroute.llm.substring_dedup import COVER, PERIOD

    for i, j in itertools.product(range(PERIOD), repeat=2):
        assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))


def test_shared_keys():
    chosen = np.random.default_rng(1)
    n = 5
    asked = [np.unique(chosen.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)) for _ in range(4)]
    asked[1] = np.unique(np.r_[asked[1], asked[0][::3]])
    marks = [np.arange(len(x)) % 7 == 0 for x in asked]
    sent = [dict(blocks.ask_shared(x, m, n)) for x, m in zip(asked, marks, strict=True)]
    answers = [{} for _ in asked]
    for bucket in range(n):
        holders = [k for k, x in enumerate(sent) if bucket in x]
        for k, reply in zip(holders, blocks.reply_shared([sent[k][bucket] for k in holders]), strict=True):
            answers[k][bucket] = reply
    for k, keys in enumerate(asked):
        others = np.concatenate([x for j, x in enumerate(asked) if j != k])
        expected = np.isin(keys, others) | marks[k]
        for j, other in enumerate(asked):
            expected |= np.isin(keys, other[marks[j]])
        assert (blocks.read_shared(answers[k], keys, n) == expected).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    chosen = random.Random(seed)
    edges = [(chosen.randrange(80), chosen.randrange(80)) for _ in range(60)]
    edges += [(k, k + 1) for k in range(100, 160)] + [(200, 300 + k) for k in range(40)] + [(5, 5), (None, 3)]
    reach = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        joined = reach.get(a, {a}) | reach.get(b, {b})
        for x in joined:
            reach[x] = joined
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(x["node"], x["component"]) for x in found} == {(x, min(own)) for x, own in reach.items()}
    assert len(found) == len(reach)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_marginals():
    """Forward-backward with skipped runs against the sum over all taggings."""
    model = toxicity.Model(
        {"=bad": 2.5, "4wors": 1.0}, -1.3, np.array([[0.7, -0.9], [-0.2, 0.4]]), np.array([0.5, -0.5])
    )
    tagger = toxicity.Tagger(model)
    for words in (["bad"], "a b bad c".split(), "bad bad x worse y z q bad".split(), "x y worst".split()):
        at = tagger.informative(words)
        score = [model.bias + tagger.weight(w) for w in words]
        total, marked = 0.0, [0.0] * len(words)
        for tags in itertools.product((0, 1), repeat=len(words)):
            value = model.start[tags[0]] + sum(s for s, t in zip(score, tags, strict=True) if t)
            value += sum(model.transitions[a, b] for a, b in zip(tags, tags[1:]))
            total += math.exp(value)
            for k, t in enumerate(tags):
                marked[k] += t * math.exp(value)
        assert np.allclose(tagger.marginals(words, at), [marked[k] / total for k in at])


@pytest.mark.parametrize("seed", range(20))
def test_runs_tie_what_may_be_similar(seed):
    """Postings joined per block first and then over blocks tie all pairs of similar sizes."""
    from dataroute.llm.jaccard_join import _runs

    chosen = random.Random(seed)
    postings = [(chosen.randrange(4), node, chosen.choice([5, 6, 10, 12, 40, 41, 90])) for node in range(25)]
    percent, parent = 85, list(range(25))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sent, pairs = [], []
    for block in (postings[:8], postings[8:9], postings[9:], []):
        key, node, size = (np.array([x[k] for x in block], np.int64) for k in range(3))
        runs, tied = _runs(key, node, size, size, percent)
        assert len(runs[0]) <= len(block)
        sent.append(np.stack(runs))
        pairs.append(tied)
    pairs.append(_runs(*np.concatenate(sent, axis=1), percent)[1])
    for a, b in np.concatenate(pairs, axis=1).T.tolist():
        parent[root(a)] = root(b)
    for (k, a, m), (j, b, n) in itertools.combinations(postings, 2):
        if k == j and 100 * min(m, n) >= percent * max(m, n):
            assert root(a) == root(b)
        if k != j:
            assert root(a) != root(b)


def test_hot_keys_are_not_shuffled(spark, monkeypatch):
    from dataroute.llm import tables

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS x")
    facts = tables.written(rows.groupBy("k").count().withColumnRenamed("count", "n"), "facts")
    expected = sorted(map(tuple, rows.join(facts, "k").collect()))
    for least in (1, 500, 5000):
        monkeypatch.setattr(tables, "LEAST_HOT", least)
        joined = tables.join_facts(rows, facts, "k", "n", 3000)
        assert sorted(map(tuple, joined.select("k", "x", "n").collect())) == expected
    assert tables.join_facts(rows.limit(0), facts.limit(0), "k", "n", 0).collect() == []
