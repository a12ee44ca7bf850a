from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.api import Database
from corpuslens.operators import collocation, load
from corpuslens.operators.search import indel_ratio
from corpuslens.plans.syntax import SearchRequest
from corpuslens.registry import Registry
from corpuslens.schema import SENTENCE
from corpuslens.sources import tables
from corpuslens.store import corpus, markup_corpus


def test_reports(spark, sf_dir, tmp_path):
    db = Database(corpus(spark, sf_dir), {"n_chars": "int"})
    r = SearchRequest(q="the", metadata={"lang": '"en"'}, per_page=10)
    assert db.concordance(r).count() == db.kwic(r).count() == 10
    assert db.kwic(SearchRequest(q="the", sort_by=("right",), per_page=7)).count() == 7
    assert db.concordance(SearchRequest(q="the", sort_by=("source",), start=3, end=6)).count() == 4
    assert db.total_results(r) == db.hits(r).count() > 0
    assert db.bibliography(SearchRequest(metadata={"lang": "en"})).count() == 25
    assert {t.token for t in db.collocation(r).collect()}.isdisjoint({"the"})
    assert db.time_series(SearchRequest(), "n_chars", 0, 999, 100).count() == 10
    assert db.term_groups('"to be" | x y') == ['"to be" | x', "y"]
    assert db.navigation(1, 1).first().object_text
    assert db.landing_page("lang", "a", "f").count() >= 1 and db.landing_page("n_chars", "0", "500").count() > 0
    assert db.hits(SearchRequest(q="thes", approximate_ratio=80)).count() > 0
    db.functions.register("mine", lambda q: db.query_terms(q))
    db.export("mine", str(tmp_path / "x"), "json", "the")
    assert spark.read.json(str(tmp_path / "x")).count() == 1


def test_reports_of_collocations(spark, sf_dir):
    c = corpus(spark, sf_dir)
    db = Database(c)
    r = SearchRequest(q="the")
    plain = {x.token: x.n for x in collocation.collocates(db.hits(r), c.words, 5, own=("the",)).collect()}
    narrow = {x.token: x.n for x in collocation.counted(collocation.near(c.sentences, "the", 5), own=("the",)).collect()}
    assert plain == narrow and len(plain) > 100
    whole = {x.token: x.n for x in collocation.collocates(db.hits(SearchRequest(q="th.*")), c.words).collect()}
    assert whole == {x.token: x.n for x in collocation.counted(collocation.near(c.sentences, "th.*")).collect()}
    assert {x.side for x in db.comparative_collocation(SearchRequest(q="the", metadata={"source": '"src1"'}), distance=5).collect()} == {"top", "bottom"}
    some = db.comparative_collocation(SearchRequest(q="the", metadata={"source": '"src1"'}), {"source": '"src2"'}, 5)
    assert some.count() > 0
    similar = db.similar_collocations(r, "source", "src1", 5).first()
    assert 0 < similar.similarity < 0.99 and 0 < len(similar.words) <= 20
    assert db.outlier_groups(r, "source", 1, 5).count() > 1 and db.outlier_groups(r, "source", 10**9, 5).count() == 0
    assert db.collocation_periods(r, "n_chars", 2000, 5).count() > 0 and db.collocate_distribution(r, "lang", "en", 5).count() > 0
    stop = spark.createDataFrame([("of 99",), ("and",)], "line string")
    assert {x.token for x in db.collocation(r, choice="stopwords", stopwords=stop).collect()}.isdisjoint({"of", "and", "the"})
    assert db.frequency(SearchRequest(), "lang").count() >= 4 and db.aggregation_rows(r, "lang", "source").count() > 0
    assert db.more_context(r).count() == 25 and db.autocomplete_metadata("source", "src1").first().shown.startswith("<span")
    assert db.kwic(SearchRequest(q="th.*", sort_by=("q", "left"), per_page=9)).count() == 9


def test_load_filters_and_marked_up_reports(spark, tmp_path):
    (tmp_path / "lemmas").write_text("words\tword\nbetter\tgood\n")
    lemmas = tables.lemma_file(spark, str(tmp_path / "lemmas"))
    attrs = lambda w: w.withColumn("attrs", F.create_map(F.lit("n"), F.length("token").cast("string"), F.lit("x"), F.lit("1")))
    filters = [lambda w: load.transformed(w, lambda t: F.regexp_replace(t, "ſ", "s")), lambda w: load.lemmatised(w, lemmas), attrs, lambda w: load.without_attributes(w, ["x"])]
    text = '<TEI><text><body><div1 type="act"><head>One</head><pb n="1" facs="a.jpg b.jpg"/><p>Better wordſ.</p><div2><head>Two</head><p>Words word.</p></div2></div1></body></text></TEI>'
    c = markup_corpus(spark.createDataFrame([(7, text)], "doc long, text string"), load_filters=filters, post_filters=[lambda d: d.withColumn("kind", F.lit("play"))])
    db = Database(c)
    assert {(x.token, x.lemma) for x in c.words.collect()} >= {("better", "good"), ("words", "word"), ("one", "one")}
    assert db.hits(SearchRequest(q="lemma:word")).count() == 3 and db.hits(SearchRequest(q="lemma:word:n:5")).count() == 2
    assert {(x.value, x.n) for x in db.word_property_counts(SearchRequest(q="lemma:word"), "n").collect()} == {("5", 2), ("4", 1)}
    assert db.hits_with_property(SearchRequest(q="wor.*"), "n", "4").count() == 1 and db.word_property_counts(SearchRequest(q="wor.*"), "x").first().value == "NULL"
    assert [(x.depth, x.head, x.parent) for x in db.table_of_contents(7).orderBy("n").collect()] == [(1, "One", 0), (2, "Two", 1)]
    assert {x.image for x in db.page_images().collect()} == {"a.jpg", "b.jpg"}
    assert db.frequency(SearchRequest(q="lemma:word"), "type").collect()[0].value == "act"
    assert "Words word" in db.navigation(7, 1, 2).first().object_text and db.navigation(7, 1).first().next == ""
    with pytest.raises(ValueError):
        db.navigation(7)
    assert db.metadata_export().count() == 1 and db.metadata_export("div2").count() == 1 and '"who"' not in db.metadata_export("para").first().record
    assert {x.completion: x.freq for x in db.autocomplete_key("lemma:wo").collect()} == {"lemma:word": 3, "lemma:word:n:5": 2, "lemma:word:n:4": 1}
    assert c.docs.first().kind == "play"


def test_approximate_search_finds_all_forms_of_each_word(spark, sf_dir):
    db = Database(corpus(spark, sf_dir))
    words = list(map(tuple, db.corpus.words.select(*SENTENCE, "pos", "norm").collect()))
    norms = {w[-1] for w in words}
    like = lambda term, ratio: {n for n in norms if indel_ratio(n, term) >= ratio}
    forms = like("the", 0.15)
    assert len(forms) > 1000 and db.hits(SearchRequest(q="the", approximate_ratio=15)).count() == sum(w[-1] in forms for w in words)
    at = {w[:-1]: w[-1] for w in words}
    follows = Counter((n, m) for (*k, pos), n in at.items() if (m := at.get((*k, pos + 1))) and min(len(n), len(m)) > 3)
    (one, two), _ = follows.most_common(1)[0]
    first, second = like(one + "s", 0.7), like(two + "s", 0.7)
    pairs = sum(n for (x, y), n in Counter((n, at.get((*k, pos + 1))) for (*k, pos), n in at.items()).items() if x in first and y in second)
    assert pairs > 0 and db.hits(SearchRequest(q=f"{one}s {two}s", method="phrase", approximate_ratio=70)).count() == pairs
    wide = set().union(*(like(n, 0.7) for n in norms if n.startswith(one[:3]) and n != one)) - {one}
    assert any(not n.startswith(one[:3]) for n in wide)
    assert db.hits(SearchRequest(q=f"{one[:3]}.* NOT {one}", approximate_ratio=70)).count() == sum(w[-1] in wide for w in words)
    assert db.hits(SearchRequest(q="the qqqqqqqq", approximate_ratio=90)).count() == 0


def test_registry():
    r = Registry({"a": len})
    r.register("a", max)
    assert r["a"] is max and r.names() == ["a"]
