"""Importance resampling, quality trees and ranked search against brute-force versions, and on hard rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical, resampling, trees

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


@pytest.fixture(scope="session")
def items(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "item_id long, text string, term string, doc_id int, score int")

    return make


ODD = "Él était 12 fois; naïve—Straße\x00x\x7fy ΑΒΓ ab_cd  STOP"


# ---------------------------------------------------------------- 11


def _features(text, longest):
    w = words(text)
    return [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def _resampled(docs, target, percent, least, longest, buckets):
    bucket = lambda f: zlib.crc32(f) % buckets
    s = Counter(bucket(f) for _, t in docs for f in _features(t, longest))
    t = Counter(bucket(f) for x in target for f in _features(x, longest))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    out = []
    for i, text in docs:
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, _features(text, longest))]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        out.append([i, len(gain), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((k for k, (_, text) in enumerate(docs) if len(words(text)) >= least), key=lambda k: (-out[k][3], math.inf if out[k][0] is None else out[k][0]))
    rank = {k: place for place, k in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*row, rank.get(k)) for k, row in enumerate(out)]


@pytest.mark.parametrize("longest, percent, buckets", [(1, 10, 10_000), (3, 50, 64), (2, 100, 1000), (1, 0, 10)])
def test_resampling_equals_brute_force(documents, items, prose, hard, longest, percent, buckets):
    docs = [(i, prose(i, 15 + i % 20)) for i in range(100, 220)] + [(7000, ODD * 3)] + hard[:5]
    target = [prose(100, 30), ODD, None, ""]
    got = resampling.resample(documents(docs), items(enumerate(target)), percent=percent, longest=longest, buckets=buckets).collect()
    assert {tuple(r) for r in got} == set(_resampled(docs, target, percent, 20, longest, buckets))


def test_resampling_of_repeated_rows_and_empty_tables(documents, items, hard, prose):
    docs = hard + [(8, prose(8, 30))] * 40
    got = [tuple(r) for r in resampling.resample(documents(docs), items([(1, prose(6, 50))]), percent=50).collect()]
    want = _resampled(docs, [prose(6, 50)], 50, 20, 1, 10_000)
    assert len(got) == len(docs) and {r[:4] for r in got} == {r[:4] for r in want}
    by_rank = sorted((r for r in got if r[4]), key=lambda r: r[4])
    assert [(r[4], r[3]) for r in by_rank] == sorted((r[4], r[3]) for r in want if r[4])
    assert resampling.resample(documents([]), items([(1, "a")])).collect() == []
    assert {r["weight"] for r in resampling.resample(documents([(1, "a b")]), items([])).collect()} == {-693}
    drawn = resampling.draw(documents(docs), items([(1, prose(6, 50))]), percent=50)
    assert drawn.columns == documents([]).columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in got if r[4]} - {None}


# ---------------------------------------------------------------- 12


def _walk(forest, row):
    """One row down all trees, node by node."""
    total = forest.bias
    for node in forest.roots:
        while np.isfinite(forest.cut[node]):
            node = forest.left[node] + (1 if row[forest.feature[node]] > forest.cut[node] else 0)
        total += forest.value[node]
    return total


def _stump(x, y):
    """The best split by trying every column and every cut."""
    p = np.full(len(y), (y.sum() + 0.5) / (len(y) + 1))
    g, h = p - y, p * (1 - p)
    best = (0.0,)
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            low = x[:, f] <= cut
            if min(h[low].sum(), h[~low].sum()) >= trees.LEAST:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + trees.RIDGE) for m in (low, ~low)) - g.sum() ** 2 / (h.sum() + trees.RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best[1:]


def test_trees_walk_and_split_like_brute_force():
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((900, 5)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.5) ^ (rng.random(900) < 0.05)).astype(float)
    forest = trees.boost(x, y, trees=30, depth=3)
    assert np.allclose(forest.margins(x), [_walk(forest, r) for r in x])
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.93
    one = trees.boost(x[:, :4], y, trees=1, depth=1, bins=200)
    assert (one.feature[0], one.cut[0]) == _stump(x[:, :4], y)
    none = trees.boost(x, np.ones(900))
    assert len(set(none.scores(x))) == 1 and none.scores(x)[0] > 0.99
    assert trees.boost(x[:0], y[:0]).scores(x)[0] == 0.5


def test_statistics_by_plain_counting():
    got = dict(zip(trees.STATISTICS, trees.statistics("Ab AB!! ab, ab, 12\n\nAb AB!! ab, ab, 12\nél"), strict=True))
    assert got["log_words"] == math.log1p(11) and got["log_lines"] == math.log1p(3)
    assert got["distinct_words"] == 5 / 11 and got["most_frequent_word"] == 4 / 11 and got["echoed_words"] == 2 / 11
    assert got["words_upper"] == 2 / 11 and got["words_signed"] == 6 / 11 and got["words_doubly_signed"] == 2 / 11
    assert math.isclose(got["repeated_lines"], 1 / 3)
    assert all(math.isfinite(v) for v in trees.statistics("\x00" * 10) + trees.statistics(None) + trees.statistics(" \n"))


def test_quality_is_learned_and_held_out(spark, documents, prose):
    junk = lambda k: " ".join(w + "###" for w in prose(k, 40).split()) if k % 4 else " ".join(w.upper() + "!!" for w in prose(k, 30).split())
    rows = [(i, prose(i, 20 + i % 60) if i % 3 else junk(i)) for i in range(700)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "t") for i in range(700)] + [(None, 1, 1, "t"), (3, 7, 0, "t"), (5, None, 0, "t")], "doc_id long, quality int, toxic int, text string")
    table = documents(rows)
    model = trees.train(table, labels)
    got = trees.score(table, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.98
    kept = trees.keep(table, model)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}
    # The labels of the held-out fold have no part in it.
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality")
    again = trees.train(table, turned)
    assert np.array_equal(again.value, model.value) and np.array_equal(again.cut, model.cut)


def test_quality_on_hard_rows(spark, documents, hard):
    labels = spark.createDataFrame([(3, 0), (4, 1), (6, 1), (6, 0)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        got = trees.score(documents(hard), trees.train(documents(hard), given)).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in hard)
    assert trees.score(documents([]), trees.train(documents([]), labels)).collect() == []


# ---------------------------------------------------------------- 13


def _ranked(docs, items, top):
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, math.inf if i is None else i, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=lambda s: s[:2])[:top], 1)]
    return out


def test_treap_finds_what_all_columns_give():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        grid = rng.integers(1, 6 if seed % 2 else 1000, (int(rng.integers(1, 40)), int(rng.integers(1, 700))))
        grid *= rng.random(grid.shape) < rng.choice([0.02, 0.3, 0.9])
        r, c = np.nonzero(grid)
        made = lexical.Treap.build(r, c, grid[r, c])
        treap = lexical.Treap.loads(made.dumps())
        assert (treap.maxima == made.maxima).all() and (treap.masks == made.masks).all() and treap.height == made.height
        rows = rng.permutation(len(grid))[: int(rng.integers(1, len(grid) + 1))]
        weights = rng.integers(0, 5, len(rows))
        sums = weights @ grid[rows]
        floor, before = (int(rng.integers(0, sums.max() + 1)), int(rng.integers(0, len(sums)))) if seed % 3 == 0 else (0, 0)
        want = sorted((-int(s), k) for k, s in enumerate(sums) if s > 0 and (s > floor or (s == floor and k < before)))[:20]
        assert treap.search(rows, weights, len(sums), 20, floor, before) == [(-s, k) for s, k in want]


@pytest.mark.parametrize("top, rows_of_a_block, most_terms", [(5, 64, 1 << 20), (50, 8192, 30), (3, 7, 10)])
def test_search_equals_brute_force(spark, monkeypatch, documents, items, prose, hard, top, rows_of_a_block, most_terms):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", rows_of_a_block)
    docs = [(3 * i % 307, prose(i % 90, 5 + i % 40)) for i in range(300)] + [(900, ODD), (901, ODD + " fois fois")] + hard
    asked = [(k, prose(k, 12)) for k in range(12)] + [(50, ODD), (51, ODD), (52, None), (53, ""), (54, "unheard of"), (50, "stop " + prose(3, 4)), (None, prose(6, 9))]
    table = documents(docs).repartition(3)
    n_docs, n_terms = lexical.totals(table)
    blocks = lexical.index(table, n_docs, n_terms)
    assert sum(len(r["doc_ids"]) for r in blocks.collect()) == len(docs)
    path = lexical.fresh_path(spark, "blocks")
    blocks.write.parquet(path)
    got = lexical.search(spark.read.parquet(path), items(asked), n_docs, top, most_terms).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, _ranked(docs, asked, top)))


def test_search_of_copies_and_empty_tables(documents, items, prose):
    docs = [(9000 - k, prose(1, 30)) for k in range(400)] + [(k, prose(k, 30)) for k in range(40, 60)]
    asked = [(1, prose(1, 10)), (2, prose(45, 10))]
    got = [tuple(r) for r in lexical.rank(documents(docs), items(asked), 50).collect()]
    assert sorted(got) == sorted(_ranked(docs, asked, 50))
    assert lexical.rank(documents([]), items(asked)).collect() == []
    assert lexical.rank(documents(docs), items([])).collect() == []
    assert lexical.rank(documents([(1, None), (2, "...")]), items(asked)).collect() == []
