"""Every operator on hard rows, on an empty table, and beside columns of clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import licenses, mixing, packing, pages, pii, quality, simhash, tokens, toxicity, vectors

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 8)] + [(None, 1, 1), (900, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _domains(labels):
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "b").otherwise("a").alias("domain"))


def _row_operators(labels):
    """Operators that give one row for each row of documents."""
    return {
        "mixing": lambda d: mixing.mix(d, _domains(labels), {"a": 0.7, "b": 0.3}),
        "simhash": simhash.dedup,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "pii": pii.find,
        "tokens": lambda d: tokens.counts(d, RANKS),
        "quality": quality.assess,
    }


@pytest.mark.parametrize("name", ["mixing", "simhash", "toxicity", "pii", "tokens", "quality"])
def test_hard_rows_and_empty_tables(spark, documents, hard, labels, name):
    run = _row_operators(labels)[name]
    got = run(documents(hard)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in hard)
    twice = [r for r in got if r["doc_id"] == 6]
    assert len(twice) == 3 and len({tuple(r) for r in twice}) <= 2  # equal rows, equal results
    assert run(documents([])).collect() == []


def test_licenses_and_packing_on_hard_rows(documents, hard):
    assert licenses.scan(documents(hard)).collect() == []
    assert licenses.scan(documents([])).collect() == []
    pieces = packing.pack(documents(hard), BPE).collect()
    assert sorted({str(r["doc_id"]) for r in pieces}) == sorted({str(i) for i, _ in hard})
    assert packing.pack(documents([]), BPE).collect() == []


def test_filtering_forms_keep_the_columns(documents, hard, labels):
    table = documents(hard)
    for kept in (quality.keep(table), simhash.keep(table), pii.redact(table), mixing.apply(table, _domains(labels), {"a": 0.7, "b": 0.3})):
        assert kept.schema.names == table.schema.names
    empty = documents([])
    for kept in (quality.keep(empty), simhash.keep(empty), pii.redact(empty), mixing.apply(empty, _domains(labels), {"a": 0.7, "b": 0.3})):
        assert kept.collect() == []


def test_pages_on_hard_rows(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", "<p>one two", 5), (2, None, "", 5), (4, "u", "<" * 50_000, 5), (5, "u", "<div>" * 30_000 + "a b", 5)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["text"][:10], r["n_chars"]) for r in pages.texts(table).collect()}
    assert {(1, "", 0), (2, "", 0), (None, "one two", 7)} <= got
    assert pages.texts(table.limit(0)).collect() == []


ARTICLE = "<article><h1>Sorting numbers</h1><p>One way to sort many numbers is to split them first.</p></article>"
WORDS = "Sorting numbers|One way to sort many numbers is to split them first."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body class='page no-sidebar'>{ARTICLE}</body>", WORDS),
        (f"<html class='nav'><body class='sidebar' id='search'>{ARTICLE}</body></html>", WORDS),
        (ARTICLE.replace("<article>", "<article class='post has-comments'>"), WORDS),
        (ARTICLE.replace("<article>", "<article class='related' id='search'>"), WORDS),
        (ARTICLE.replace("</article>", "<h2 id='related-work' class='header'>Earlier work</h2><p>There is much.</p></article>"), WORDS + "|Earlier work|There is much."),
        (ARTICLE.replace("<p>", "<section id='search-algorithms'><p>").replace("</p>", "</p></section>"), WORDS),
        (ARTICLE.replace("<p>", "<section id='search'><p>").replace("</p>", "</p></section>"), WORDS),
        (ARTICLE.replace("<h1>", "<div class='entry-header'><h1>").replace("</h1>", "</h1></div>"), WORDS),
        # What such words take out still goes.
        (ARTICLE.replace("</article>", "<div class='box ad'>Buy now</div><div id='comments'>Me too</div><section class='related'>More</section></article>"), WORDS),
        (ARTICLE.replace("</article>", "<h2 hidden>Not seen</h2><p>The end.</p></article>"), WORDS + "|The end."),
    ],
)
def test_names_of_elements_do_not_take_the_article_out(page, want):
    score = pages.weights(pages.count(ARTICLE) + pages.count("<div><ul><li>a</li></ul></div>"))
    score |= dict.fromkeys(("section", "/section", "h2", "/h2"), 0.0)
    assert pages.extract(page, score) == want.replace("|", "\n\n")


SECOND = ARTICLE.replace("Sorting numbers", "Merging").replace("One way", "Another way")
AROUND = "<nav><ul><li><a href='/'>Home</a></li><li>All of the topics</li></ul></nav>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"{ARTICLE}<div class='comments-area'><div class='comment-body'><p>{'so true ' * 40}</p></div></div>", WORDS),
        (ARTICLE.replace("</article>", "<div class='comments-area'><p>So true</p></div></article>"), WORDS),
        (f"{ARTICLE}<div class='site-footer'>{'all rights ' * 40}</div><div class='footer-links'>About us</div>", WORDS),
        (ARTICLE.replace("</article>", "<p class='notice'>Mind the order.</p></article>"), WORDS + "|Mind the order."),
        (ARTICLE.replace("</article>", "<div class='widget'>A table.</div></article>"), WORDS + "|A table."),
        (f"<div class='notice'>We have moved.</div><div class='widget'>Weather</div>{ARTICLE}", WORDS),
        (ARTICLE.replace("many", "<math><mi>n</mi></math>"), WORDS.replace("many", "n")),
        (f"{ARTICLE}{AROUND}{SECOND}<footer>x</footer>", WORDS + "|" + WORDS.replace("Sorting numbers", "Merging").replace("One way", "Another way")),
        (f"<main>{AROUND}{ARTICLE}<aside>{SECOND}</aside></main>", WORDS),
        (f"<main><h1>Sorting</h1>{'<p>Many words of one text.</p>' * 9}<article><p>Teaser</p></article></main>", "Sorting" + "|Many words of one text." * 9),
        (f"<div class='sidebar'><main>{ARTICLE}</main></div>", WORDS),
        (f"<article><p>{'word ' * 60}</p><article class='comment'>{'so true ' * 90}</article></article>", ("word " * 60).strip()),
        ("<article></article>", ""),
        (f"<body>{AROUND}<p>Plain page without any article in its markup.<footer>{'x ' * 90}</footer></body>", "Plain page without any article in its markup."),
    ],
)
def test_learned_names_decide_what_belongs_to_the_article(page, want):
    learned = pages.weights(pages.count(AROUND + ARTICLE + "<footer>x</footer>"))
    for score in (learned, pages.weights({})):
        assert pages.extract(page, score) == want.replace("|", "\n\n")


def test_labelled_pages_teach_names():
    page = f"<body><div class='zq'>{'z ' * 30}</div><div class='box'>aside</div><article><p>{'word ' * 9}</p><div class='box'>part</div></article></body>"
    score = pages.weights(sum((pages.count(page) for _ in range(20)), pages.Counter()))
    assert pages.extract(page, score) == ("word " * 9).strip() + "\n\npart"
    assert pages.extract(page, pages.weights({})) != pages.extract(page, score)
    assert score["zq"] < -pages.MOST / 2 and score["box"] == score["p"] == 0


def test_the_scores_decide_on_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20).select("html").collect()
    score = pages.weights(sum((pages.count(r["html"]) for r in rows), pages.Counter()))
    whole = dict.fromkeys(score, 0.0)
    assert all(pages.extract(r["html"], score) != pages.extract(r["html"], whole) for r in rows)


def test_vectors_on_hard_rows(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = [1.0, 0.1, 0.0, 0.0]
    rows = [(5, a), (3, a), (3, a), (7, near), (8, b), (9, None), (10, []), (11, [0.0] * 4), (12, [1.0, None, 0.0, 0.0]), (13, [float("nan"), 1.0, 0.0, 0.0]), (14, [float("inf"), 0.0, 0.0, 0.0]), (15, [1.0, 0.0]), (16, [3.0, 0.1]), (17, [2.0]), (18, [-1.0]), (None, a)]
    table = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rid string")
    got = sorted(tuple(r)[:3] for r in vectors.dedup(table).collect() if r["vec_id"] is not None)
    assert got == [(3, 3, 3), (3, 3, 3), (5, 3, 3), (7, 3, 3), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 0, 11), (12, 0, 12), (13, 0, 13), (14, 0, 14), (15, 1, 15), (16, 1, 15), (17, 0, 17), (18, 0, 18)]
    assert vectors.dedup(table.limit(0)).collect() == []
    assert vectors.dedup(table.where("vec_id = 9")).count() == 1


def test_vectors_of_a_length_that_the_sample_lacks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(300)] + [(1000 + k, [float(k % 3 + 1), k % 3 / 10, 0.0]) for k in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = sorted(tuple(r) for r in vectors.dedup(table).collect())
    monkeypatch.setattr(vectors, "SAMPLE", 20)
    monkeypatch.setattr(vectors, "bounded_ids", lambda df, key, n: df.where("rid < 300").select(key).orderBy(key).limit(n))
    assert sorted(tuple(r) for r in vectors.dedup(table).collect()) == want
    assert [r[1] for r in want[-9:]] == [8] * 9


def test_the_pipeline_runs_its_stages_in_order(spark, tmp_path, documents, hard, labels, prose):
    rows = [(i, prose(i, 60)) for i in range(20, 60)] + [(70, prose(21, 60)), (71, prose(1, 60) + " write to bob@example.org now"), (72, "word " * 60)] + hard
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert 72 not in seen[0] and {20, 21, 70, 71, 4} <= seen[0]
    assert 21 in seen[1] and 70 not in seen[1]
    redacted = spark.read.parquet(f"{tmp_path}/2").where("doc_id = 71").first()
    assert "[EMAIL]" in redacted["text"] and redacted["n_chars"] == len(redacted["text"])
    assert seen[2] == seen[1] and seen[4] == seen[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == seen[4]
