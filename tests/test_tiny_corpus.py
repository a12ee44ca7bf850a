"""A corpus of two documents with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import autocomplete, collocation, load
from corpuslens.operators import search as s
from corpuslens.sources import markup, plain_text
from corpuslens.store import from_sentences, in_sentences

DOCS = [(1, "The cat sat. The cat saw the dog!\nA dog ran 12 miles; the cat slept."), (2, "Été: le chat dort. Dr. Smith paid 3.50 for a cat. the dog barked"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def words(spark):
    return plain_text.words(spark.createDataFrame(DOCS, "doc_id long, text string")).cache()


def test_segmentation(words):
    got = {}
    for r in words.orderBy("doc", "para", "sent", "pos").collect():
        got.setdefault((r.doc, r.para, r.sent), []).append(r.token)
    assert got == {
        (1, 1, 1): ["the", "cat", "sat"], (1, 1, 2): ["the", "cat", "saw", "the", "dog"], (1, 2, 1): ["a", "dog", "ran", "miles", "the", "cat", "slept"],
        (2, 1, 1): ["été", "le", "chat", "dort"], (2, 1, 2): ["dr"], (2, 1, 3): ["smith", "paid", "for", "a", "cat", "the", "dog", "barked"],
    }


def test_starts(words):
    text = dict(DOCS)
    for r in words.collect():
        assert text[r.doc][r.start : r.start + len(r.token)].lower() == r.token


@pytest.mark.parametrize(
    "query, method, arg, ordered, n",
    [("the cat", "phrase", 0, True, 3), ("the cat", "proxy", 3, False, 5), ("the cat", "exact_cooc", 2, False, 1), ("the cat", "sentence", None, True, 3), ("the cat", "sentence", None, False, 5), ("ete", None, None, True, 1), ('"été"', None, None, True, 1), ('"ete"', None, None, True, 0), ("ca.* | do.", None, None, True, 8), ("", None, None, True, 0)],
)
def test_counts(words, query, method, arg, ordered, n):
    assert s.search(words, query, method, arg, ordered).count() == n


def test_collocates(words):
    got = {r.token: r.n for r in collocation.collocates(s.search(words, "cat"), words, own=("cat",)).collect()}
    assert got == {"the": 5, "dog": 3, "a": 2} | dict.fromkeys("barked for miles paid ran sat saw slept smith".split(), 1)


def test_repeated_word_pairs_count_once(words):
    assert s.search(words, "the the", "sentence", ordered=False).count() == 1


def test_paragraph_level(words):
    assert s.search(words, "sat dog", "sentence", ordered=False, level="para").count() == 1
    assert s.search(words, "sat dog", "sentence", ordered=False).count() == 0


ODD = ["a.b A1. X 3. de", "x. Y &amp;c &lt; b;1.\n\n1a. Z \u0130 \u01301. X..", "\u03a3\u03c3. e\u0301te\u0301 \u00bd1\u0663! \U00010400b? \u6f22\u5b57.\r\nq\tr", "\n\n1 2 3", "a" * 201 + " b. " + "\u00e9" * 101 + " C", "&;. ;a& b1;c", ""]


def test_batches_follow_the_rules(spark):
    """Segmentation of batches and by expressions, which a whitelist of all words takes."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*ODD, None, *ODD])], "doc_id long, text string")
    narrow = plain_text.words(docs)
    key = lambda rows: sorted(map(tuple, rows.select(*narrow.columns).collect()))
    assert key(narrow) == key(plain_text.words(docs, whitelist=narrow.select("token").distinct())) == key(from_sentences(plain_text.sentences(docs))) != []
    for rows in (narrow, plain_text.sentences(docs)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_frequencies_of_documents_are_a_narrow_map(spark):
    texts = [(k, t) for k, t in enumerate([*ODD, None, "The the THE &the; a", *ODD])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = lambda d: sorted(map(tuple, load.object_frequencies(plain_text.words(d)).collect()))
    rows = plain_text.frequencies(docs)
    assert sorted(map(tuple, rows.collect())) == want(docs) != []
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    again = docs.unionByName(spark.createDataFrame([(1, "a b a"), (None, "a"), (None, "a")], docs.schema)).repartition(3)
    assert sorted(map(str, plain_text.frequencies(again).collect())) == sorted(map(str, load.object_frequencies(plain_text.words(again)).collect()))


def test_weights_of_known_and_other_words(spark):
    """Words whose df is sent along and those that are dealt by word weigh the same; rows are dealt by document once."""
    counts = load.object_frequencies(plain_text.words(spark.createDataFrame(DOCS, "doc_id long, text string")))
    tf = {(r.doc, r.token): r.n for r in counts.collect()}
    docs = {d for d, _ in tf}
    df = {t: sum((d, t) in tf for d in docs) for _, t in tf}
    raw = {(d, t): (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for (d, t), n in tf.items()}
    want = {(d, t): w / math.sqrt(sum(v * v for (e, _), v in raw.items() if e == d)) for (d, t), w in raw.items()}
    for known in (1, 3, 100):
        got = {(r.doc, r.token): r.weight for r in load.weights(counts, known=known).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    best = load.weights(counts, top=3, known=3)
    assert sorted((r.doc, r.token) for r in best.collect()) == sorted(k for d in docs for k in sorted((k for k in want if k[0] == d), key=lambda k: (-round(want[k], 9), k[1]))[:3])
    plan = best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(doc") <= 2  # one more for the number of documents


def test_counts_are_summed_from_below(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    held = plain_text.sentences(docs)
    by_level = load.counts_by_level(held)
    assert sorted(map(str, by_level.collect())) == sorted(map(str, plain_text.words(docs).rollup("doc", "para", "sent").agg(F.count("*").alias("n")).collect()))
    assert load.counts_by_level(held.where("doc < 0")).count() == 0 and "Expand" not in by_level._jdf.queryExecution().executedPlan().toString()
    forms = load.normal_forms(spark.createDataFrame([("ete", "été"), ("ete", "ete"), ("ete", "été")], "norm string, token string"))
    assert [tuple(r) for r in forms.collect()] == [("ete", "ete,été", 3)]
    assert "collect_set" not in forms._jdf.queryExecution().executedPlan().toString()


def test_whitelist_takes_no_position(spark):
    docs = spark.createDataFrame(DOCS[:1], "doc_id long, text string")
    only = spark.createDataFrame([("cat",), ("saw",)], "token string")
    assert [(r.sent, r.pos, r.token) for r in plain_text.words(docs, whitelist=only).orderBy("start").limit(3).collect()] == [(1, 1, "cat"), (2, 1, "cat"), (2, 2, "saw")]


def test_lemmas_and_attributes(spark, words):
    lemmas = spark.createDataFrame([("sat", "sit"), ("slept", "sleep")], "word string, lemma string")
    rich = load.lemmatised(words, lemmas).withColumn("attrs", F.when(F.col("token") == "dog", F.create_map(F.lit("pos"), F.lit("NOUN"))).otherwise(F.create_map().cast("map<string,string>")))
    assert s.search(rich, "lemma:sit").count() == 1
    assert s.search(rich, "dog:pos:NOUN").count() == 3
    assert s.search(rich, "lemma:dog:pos:NOUN").count() == 3
    assert {r.value: r.n for r in collocation.property_counts(s.search(rich, "dog | cat"), rich, "pos").collect()} == {"NOUN": 3, "NULL": 4}
    near = collocation.around(s.search(rich, "cat"), rich, attribute=("pos", "NOUN"))
    assert {r.token for r in near.collect()} == {"dog:pos:NOUN"}


def test_properties_of_single_words_join_nothing(spark, words):
    rich = words.withColumn("attrs", F.when(F.length("token") > 3, F.create_map(F.lit("size"), F.lit("long"))).otherwise(F.create_map().cast("map<string,string>")))
    some = spark.createDataFrame([(1,)], "doc long")
    for q, within in (("the | s.*", None), ("the | s.*", some), ("the cat", None), ("", None)):
        got = collocation.query_properties(rich, q, "size", within)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, collocation.property_counts(s.search(rich, q, within=within), rich, "size").collect()))
    assert "Join" not in collocation.query_properties(rich, "s.*", "size")._jdf.queryExecution().optimizedPlan().toString()


def test_lemmas_and_attributes_near_a_word(spark, words):
    """Lemmas meet counts, and sentences give words by lemma or attribute as the join of words does."""
    lemmas = spark.createDataFrame([("sat", "sit"), ("slept", "sit"), ("dog", "cat")], "word string, lemma string")
    size = F.when(F.length("token") > 3, F.create_map(F.lit("size"), F.lit("long"))).otherwise(F.create_map().cast("map<string,string>"))
    rich = load.lemmatised(words, lemmas).withColumn("attrs", size)
    held, rows = in_sentences(rich), lambda df: sorted(map(tuple, df.select("token", "n").collect()))
    for distance in (None, 2):
        around = collocation.collocates(s.search(rich, "the"), rich, distance, by="lemma")
        plain = collocation.counted(collocation.near(in_sentences(words), "the", distance))
        assert rows(collocation.counted(collocation.near(held, "the", distance, by="lemma"))) == rows(collocation.by_lemma(plain, lemmas)) == rows(around) != []
        long = collocation.around(s.search(rich, "the"), rich, distance, ("size", "long")).groupBy("token").agg(F.count("*").alias("n"))
        assert rows(collocation.counted(collocation.near(held, "the", distance, attribute=("size", "long")))) == rows(long) != []
    counts = load.word_frequencies(words)
    assert rows(collocation.by_lemma(counts, lemmas)) == rows(rich.groupBy(F.col("lemma").alias("token")).agg(F.count("*").alias("n")))
    key = lambda df: [tuple(r) for r in autocomplete.keys(df, "lemma:s").collect()]
    assert key(load.lemmatised(counts.withColumnRenamed("n", "freq"), lemmas).withColumn("attrs", size)) == key(rich) != []


def test_lemmas_meet_the_words_once(spark):
    lemmas = spark.createDataFrame([("Cats", "Felix"), ("cats", "cat"), ("SAW", "tool"), ("gone", None), (None, "x")], "word string, lemma string")
    rows = load.lemmatised(spark.createDataFrame([("Cats",), ("CATS",), ("cats",), ("SAW",), ("Saw",), ("gone",)], "token string"), lemmas)
    assert {r.token: r.lemma for r in rows.collect()} == {"Cats": "Felix", "CATS": "cat", "cats": "cat", "SAW": "tool", "Saw": "saw", "gone": "gone"}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("query", ["lemma:cat", "lemma:s.*", "lemma:.*", "lemma:saw", "lemma:Cat", "lemma:tool", "lemma:none", "cat NOT lemma:cat", "dog | lemma:sit", "dog | lemma:sit NOT lemma:cat", "lemma:.* NOT lemma:s.*", "dog | cat NOT lemma:none", "lemma:cat:size:long", "lemma:sit:long", "the lemma:cat", "the cat"])
def test_lemmas_from_asked_forms(spark, words, query):
    """The forms that a query asks for give the hits that words with every lemma do."""
    lemmas = spark.createDataFrame([("sat", "sit"), ("slept", "sit"), ("dog", "cat"), ("saw", "tool"), ("Cat", "Cat"), ("CAT", "cat"), ("Barked", "bark"), ("the", "the"), ("the", "a"), ("ran", None), (None, "cat")], "word string, lemma string")
    cased = words.withColumn("token", F.when(F.col("sent") == 2, F.initcap("token")).otherwise(F.col("token")))
    sized = cased.withColumn("attrs", F.when(F.length("token") > 3, F.create_map(F.lit("size"), F.lit("long"))).otherwise(F.create_map().cast("map<string,string>")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(s.search(sized, query, pick=s.lemma_postings(lemmas)))
    assert found == rows(s.search(load.lemmatised(sized, lemmas), query))
    assert bool(found) == (query not in ("lemma:none", "lemma:saw", "lemma:cat:size:long"))


@pytest.mark.parametrize("a, b", [("nation", "nation"), ("nation", "ration"), ("", ""), ("abc", ""), ("kitten", "sitting"), ("aab", "aba")])
def test_indel_ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    want = 1.0 if not a and not b else 1 - row[-1] / (len(a) + len(b))
    assert abs(s.indel_ratio(a, b) - want) < 1e-12


TEI = """<TEI><teiHeader><title>Not text</title></teiHeader><text><body><div1 type="act"><head>Act One</head><pb n="1"/><div2><head>Scene</head>
<sp who="A"><l>To be, or not to be.</l> <l>That is</l></sp><p>Dr. Who ran. Fast!</div2><div2 type="scene"><p>End</p></div2></div1></body></text>"""


def test_tei_is_parsed_tolerantly():
    rows = list(markup.parse(TEI))
    words = [r for r in rows if r["kind"] == "word"]
    assert "text" not in {w["token"] for w in words}
    assert [(r["name"], r["head"]) for r in rows if r["kind"] == "div"] == [("div1", "Act One"), ("div2", "Scene"), ("div2", "scene")]
    be = [w for w in words if w["token"] == "be"]
    assert [(w["div1"], w["div2"], w["page"]) for w in be] == [(1, 2, 1), (1, 2, 1)]  # the heading lies in a virtual division
    assert [w["sent"] for w in words if w["token"] in ("who", "fast")] == [1, 2]  # Dr. doesn't end one
    assert [w["div2"] for w in words if w["token"] == "end"] == [3]
    assert all(TEI[w["start"] : w["end"]].lower() == w["token"] for w in words)


PLAY = """<text><front type="preface"><div1><head>To the reader</head><p>Dear reader.</div1></front>
<body><div1 type="act"><index type="topic" value="love"/><date when="1601">x</date><p>Before.<div2><sp who="#ham"><speaker>HAMLET.</speaker><p>Words, <hi>w</hi>ords.</p></sp>
<lg><l n="1">A line that runs</l><l n="2">on to the next. And ends</l></lg></div2></div1><div1 type="notes"><p>One <p>Two</div1><hyperdiv><p>More</body></text>"""


def test_objects_of_a_play():
    rows = list(markup.parse(PLAY))
    divs = [(r["name"], r["div1"], r["div2"], r["head"]) for r in rows if r["kind"] == "div"]
    assert divs == [("front", 1, 1, "preface"), ("div2", 1, 1, "To the reader"), ("div1", 2, 1, "act"), ("div2", 2, 2, "[NA]"), ("div1", 3, 1, "notes"), ("hyperdiv", 4, 1, "[HyperDiv]")]
    attrs = [(r["name"], r["head"], r["div1"], r["div2"], r["para"]) for r in rows if r["kind"] == "attr"]
    assert attrs == [("topic", "love", 2, 1, 0), ("div_date", "1601", 2, 1, 0), ("speaker", "Hamlet", 2, 2, 1)]
    words = [r for r in rows if r["kind"] == "word"]
    keys = [tuple(w[k] for k in ("div1", "div2", "div3", "para", "sent", "pos")) for w in words]
    assert len(set(keys)) == len(keys) and [w["token"] for w in words if w["para"] == 1 and w["div2"] == 2] == ["hamlet", "words", "words"]
    line = {w["token"]: w["sent"] for w in words if w["para"] == 2 and w["div1"] == 2}
    assert line["a"] == line["runs"] == 1 and line["on"] == line["ends"] == 2  # lines, not stops, end sentences in a group of lines
    assert [w["para"] for w in words if w["token"] in ("one", "two")] == [1, 1]  # no paragraphs among notes
    assert not [w for w in markup.parse("<p>a</p>") if w["kind"] == "div" and w["name"] != "__virtual"]


def test_text_is_tidied_in_place():
    for text in ("a\r\nb", "un&shy;told", "w<hi rend='x'>or</hi>d", "hyphen-<lb/>ated", '<abbr expan="Doctor">Dr.</abbr> No', "plain"):
        assert len(markup.tidied(text)) == len(text)
    token = lambda text: [r["token"] for r in markup.parse(text) if r["kind"] == "word"]
    assert token("un&shy;told w<hi>or</hi>d") == ["untold", "word"] and token("<p>hyphen-<lb/>ated</p>") == ["hyphenated"] and token('<abbr expan="Doctor">Dr.</abbr> No') == ["doctor", "no"]


def test_a_corpus_of_marked_up_texts(spark):
    from corpuslens.operators import metadata, reports
    from corpuslens.operators import search as s
    from corpuslens.store import Corpus, markup_corpus, shared_folder

    head = "<TEI><teiHeader><titleStmt><title>A Play</title><author>Nobody</author></titleStmt></teiHeader>"
    c = markup_corpus(spark.createDataFrame([(1, head + PLAY), (2, "<p>words without a header</p>"), (3, None)], "doc long, text string"))
    docs = {r.doc: r for r in c.docs.collect()}
    assert (docs[1].title, docs[1].author, docs[2].title, docs[3].word_count) == ("A Play", "Nobody", None, 0)
    divs = {(r.doc, r.level, r.div1, r.div2): r for r in c.divisions.collect()}
    assert divs[1, "div1", 2, 0].attrs == {"type": "act", "topic": "love", "div_date": "1601"} and divs[1, "div2", 2, 2].head == "[NA]" and (2, "div1", 1, 0) in divs
    who = metadata.select_objects(c.paragraphs, {"who": '"#ham"'}).select("doc", "div1", "div2", "div3", "para")
    assert [r.doc for r in s.search(c.words, "words", within=who).collect()] == [1, 1] and {r.speaker for r in c.paragraphs.where("name = 'sp'").collect()} == {"Hamlet"}
    typed = c.divisions.withColumn("type", c.divisions["attrs"]["type"])
    facet = reports.facet_of_divisions(s.search(c.words, "words"), c.words, typed, "type")
    assert {r.value: r["count"] for r in facet.collect()} == {"act": 2, "NULL": 1}
    path = shared_folder(spark)
    c.save(path)
    again = Corpus.load(spark, path, with_objects=True)
    assert again.words.count() == c.words.count() and again.divisions.count() == c.divisions.count()


def test_html_divisions_and_empty_input():
    rows = list(markup.parse("<html><head><title>x</title></head><body><h1>One</h1><p>a b<script>bad()</script><h2>Two</h2>c", is_html=True))
    assert [(r["name"], r["head"]) for r in rows if r["kind"] == "div"] == [("div1", "One"), ("div2", "Two")]
    assert [r["token"] for r in rows if r["kind"] == "word"] == ["one", "a", "b", "two", "c"]
    assert list(markup.parse(None)) == list(markup.parse("")) == []


def test_census_difference(spark):
    census = lambda text: markup.tag_census(spark.createDataFrame([(text,)], "html string"), "html")
    assert {r.tag: (r.starts, r.ends, r.flags) for r in markup.census_difference(census("<p>a</p><p><b>x</b>"), census("<b>y</b>")).collect()} == {"p": (2, 1, "*")}


def test_parsed_rows_of_many_texts_share_batches(spark):
    texts = [(k, f"<TEI><text><body><div1><p>Some words, {'more ' * k}here.</p></div1></body></text></TEI>") for k in range(12)]
    rows = markup.parsed(spark.createDataFrame(texts, "doc long, text string").coalesce(1), "doc", "text")
    got = sorted((r.doc, r.start, r.kind, r.name) for r in rows.collect())
    assert got == sorted((k, r["start"], r["kind"], r["name"]) for k, t in texts for r in markup.parse(t))


def test_words_leave_the_parser_alone(spark):
    """Only words do, the same as of all rows; a piece that comes again isn't looked at again."""
    texts = [(1, TEI), (2, PLAY), (3, None), (4, "<p>&eacute;t&eacute; a&b; " + "x" * 201 + " " + "." * 90 + "! Dr. no 1. b. x? _&; </p>")]
    df = spark.createDataFrame(texts, "doc bigint, text string")
    for is_html in (False, True):
        got = markup.parsed_words(df, "doc", "text", is_html)
        want = markup.words_of(markup.parsed(df, "doc", "text", is_html))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    list(markup.parse("<p>" + "again and again. " * 50))
    before = markup._piece.cache_info().misses
    list(markup.parse("<p>" + "again and again. " * 50))
    assert markup._piece.cache_info().misses == before
