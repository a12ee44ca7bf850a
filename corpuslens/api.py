"""Reports and scripts as functions of a corpus and a request."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import folded, rewritten
from corpuslens.operators import autocomplete, collocation, context, export, metadata, objects, reports
from corpuslens.operators import search as s
from corpuslens.plans.syntax import SearchRequest, group_terms, parse_query, split_phrases
from corpuslens.registry import Registry
from corpuslens.schema import KEYS
from corpuslens.store import Corpus


@dataclass
class Database:
    """A corpus with its field kinds; every report gives a lazy DataFrame."""

    corpus: Corpus
    kinds: dict[str, str] = field(default_factory=dict)
    functions: Registry = field(default_factory=Registry)
    #: What is replaced in the texts that concordances put out.
    output_rewrites: tuple[tuple[str, str], ...] = ()

    def documents(self, r: SearchRequest) -> DataFrame:
        return metadata.select_objects(self.corpus.docs, r.metadata, self.kinds)

    def hits(self, r: SearchRequest) -> DataFrame:
        """The request's hits, restricted to the documents that its metadata selects."""
        within = self.documents(r).select("doc") if r.metadata else None
        if r.approximate_ratio < 100:
            return s.search(self.corpus.words, r.q.replace('"', ""), r.method, r.arg, r.ordered, within=within, pick=s.near_postings(self.corpus.lexicon, r.approximate_ratio / 100))
        return s.search(self.corpus.words, r.q, r.method, r.arg, r.ordered, within=within)

    def _page(self, rows: DataFrame, r: SearchRequest, *order) -> DataFrame:
        start = max(1, r.start)
        return metadata.page(rows, [*order], start, r.end or start + r.per_page - 1)

    def _text_order(self) -> tuple:
        return "doc", F.col("starts")[0]

    def concordance(self, r: SearchRequest) -> DataFrame:
        chosen = objects.sort_hits(self.hits(r), self.corpus.docs, list(r.sort_by)).limit(r.end or max(1, r.start) + r.per_page - 1).offset(max(1, r.start) - 1) if r.sort_by else self._page(self.hits(r), r, *self._text_order())
        shown = context.concordance(chosen, self.corpus.texts)
        return shown.withColumn("context", rewritten(F.col("context"), self.output_rewrites)) if self.output_rewrites else shown

    def kwic(self, r: SearchRequest) -> DataFrame:
        if r.sort_by:
            start = max(1, r.start)
            hits = context.with_tokens(self.hits(r), self.corpus.sentences)
            return context.sorted_kwic(hits, r.sort_by, self.corpus.docs, (r.end or start + r.per_page - 1) - start + 1, start)
        return context.kwic(self._page(self.hits(r), r, *self._text_order()), self.corpus.texts)

    def bibliography(self, r: SearchRequest) -> DataFrame:
        docs = self.documents(r)
        return self._page(docs, r, *metadata.ordered(docs, list(r.sort_by), ["doc"]))

    def _own(self, r: SearchRequest) -> tuple[str, ...]:
        return tuple(folded(v.strip('"')) for g in split_phrases(group_terms(parse_query(r.q))) for k, v in g.any_of if k in ("TERM", "QUOTE"))

    def _within(self, r: SearchRequest) -> DataFrame | None:
        return self.documents(r).select("doc") if r.metadata else None

    def collocation(self, r: SearchRequest, filter_words: int = 100, distance: int | None = None, choice: str = "frequency", stopwords: DataFrame | None = None, by: str = "token", attribute: tuple[str, str] | None = None) -> DataFrame:
        """The 100 strongest collocates: words or lemmas (``by``), or words with an attribute's value, less a filter list by frequency or of stopwords."""
        words, without = self.corpus.words, None
        if filter_words or choice == "stopwords":
            without = collocation.filter_list(words, choice, filter_words, stopwords, by)
        near = collocation.near(self.corpus.sentences, r.q, distance, self._within(r), by=by, attribute=attribute)
        counts = collocation.counted(near, without=without, own=self._own(r)) if attribute is None else collocation.counted(near)
        return counts.orderBy(F.col("n").desc(), "token").limit(100)

    def _by_group(self, r: SearchRequest, by: str, distance: int | None = None) -> DataFrame:
        docs = self.documents(r) if r.metadata else self.corpus.docs
        return collocation.near_by_group(self.corpus.sentences, docs, r.q, by, distance, self._own(r))

    def collocate_distribution(self, r: SearchRequest, by: str, group: str, distance: int | None = None) -> DataFrame:
        return self._by_group(r, by, distance).where(F.col("grp") == group).orderBy(F.col("n").desc(), "token")

    def comparative_collocation(self, r: SearchRequest, other: dict[str, str] | None = None, distance: int | None = None) -> DataFrame:
        """Words over- and under-used around the hits of the request's documents, against those of ``other`` documents, or of all others."""
        if other is None:
            z = collocation.compared_within(collocation.near(self.corpus.sentences, r.q, distance, keep=("doc",)), self.documents(r))
        else:
            sides = (metadata.select_objects(self.corpus.docs, m, self.kinds).select("doc") for m in (r.metadata, other))
            z = collocation.compared(*(collocation.counted(collocation.near(self.corpus.sentences, r.q, distance, side)) for side in sides))
        return collocation.both_ends(z)

    def similar_collocations(self, r: SearchRequest, by: str, group: str, distance: int | None = None) -> DataFrame:
        return collocation.similar_groups(self._by_group(r, by, distance), group, words=20)

    def outlier_groups(self, r: SearchRequest, by: str, min_hits: int = 10, distance: int | None = None) -> DataFrame:
        hits = collocation.hits_by_group(self.hits(r), self.corpus.docs, by)
        return collocation.outlier_groups(self._by_group(r, by, distance), hits, min_hits, words=True)

    def collocation_periods(self, r: SearchRequest, year: str, period: int = 10, distance: int | None = None) -> DataFrame:
        by_doc = collocation.counted(collocation.near(self.corpus.sentences, r.q, distance, self._within(r), ("doc",)), ("doc",), own=self._own(r))
        return collocation.over_periods(reports.with_metadata(by_doc, self.corpus.docs, year), year, period)

    def word_property_counts(self, r: SearchRequest, name: str) -> DataFrame:
        return collocation.query_properties(self.corpus.words, r.q, name, self._within(r))

    def hits_with_property(self, r: SearchRequest, name: str, value: str) -> DataFrame:
        return s.search(collocation.with_property(self.corpus.words, name, value), r.q, within=self._within(r))

    def time_series(self, r: SearchRequest, by: str, start: int, end: int, interval: int = 10) -> DataFrame:
        docs = self.documents(r) if r.metadata else self.corpus.docs
        return reports.time_series(self.hits(r) if r.q else None, docs, by, start, end, interval)

    def aggregation(self, r: SearchRequest, by: str, inner: str) -> DataFrame:
        return reports.breakdown(self.hits(r), self.corpus.docs, by, inner)

    def aggregation_rows(self, r: SearchRequest, by: str, inner: str) -> DataFrame:
        return reports.breakdown_rows(self.hits(r), self.corpus.docs, by, inner)

    def frequency(self, r: SearchRequest, by: str) -> DataFrame:
        """A facet by a field of documents, or else of divisions; without a query, of the bibliography."""
        if by in self.corpus.docs.columns:
            return reports.facet(self.hits(r) if r.q else None, self.documents(r), by)
        divs = self.corpus.divisions.withColumn(by, F.col("head") if by == "head" else F.col("attrs")[by])
        return reports.facet_of_divisions(self.hits(r), self.corpus.words, divs, by)

    def hitlist_stats(self, r: SearchRequest, fields: list[str]) -> DataFrame:
        return reports.hitlist_stats(self.hits(r), self.corpus.docs, fields)

    def total_results(self, r: SearchRequest) -> int:
        return (self.hits(r) if r.q else self.documents(r)).count()

    def total_words(self, r: SearchRequest) -> DataFrame:
        return self.documents(r).agg(F.sum("word_count").alias("words"))

    def results_bibliography(self, r: SearchRequest) -> DataFrame:
        return reports.results_bibliography(self.hits(r))

    def table_of_contents(self, doc: int | None = None) -> DataFrame:
        """Divisions of marked-up texts in order, each with the one it lies in; virtual ones and notes aren't shown."""
        divs = self.corpus.divisions.where("name <> '__virtual'")
        divs = divs if doc is None else divs.where(F.col("doc") == doc)
        place = F.row_number().over(Window.partitionBy("doc").orderBy("start"))
        return reports.shown_contents(divs.select("doc", place.alias("n"), F.substring("level", 4, 1).cast("int").alias("depth"), "head", F.col("attrs")["type"].alias("type")))

    def navigation(self, doc: int, *key: int) -> DataFrame:
        """The text of an object below the document, given by its key (div1, div2, div3, para, as far as it goes), with its neighbours; one paragraph number alone is that of a plain text.

        A whole document is refused.
        """
        if not key:
            raise ValueError("Document-level text rendering is not allowed.")
        names = ("para",) if len(key) == 1 and self.corpus.objects is None else KEYS["para"][1 : 1 + len(key)]
        ends = self.corpus.words.where(F.col("doc") == doc).groupBy("doc", *names).agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("token")).alias("end"))
        test = F.lit(True)
        for name, value in zip(names, key):
            test = test & (F.col(name) == value)
        placed = ends.withColumn("place", F.concat_ws(" ", *names))
        return context.text_of(metadata.neighbours(placed, list(names), ["doc"], "place").where(test), self.corpus.texts)

    def more_context(self, r: SearchRequest, size: int = 1000) -> DataFrame:
        """The request's hits with ``size`` characters on either side."""
        return context.concordance(self._page(self.hits(r), r, *self._text_order()), self.corpus.texts, size)

    def term_groups(self, q: str) -> list[str]:
        return [" | ".join(v for _, v in g.any_of) for g in split_phrases(group_terms(parse_query(q)))]

    def query_terms(self, q: str) -> DataFrame:
        return s.expand(self.corpus.lexicon, q)

    def autocomplete_term(self, text: str) -> DataFrame:
        return autocomplete.terms(self.corpus.lexicon, text)

    def autocomplete_metadata(self, field_: str, text: str) -> DataFrame:
        return autocomplete.highlighted(autocomplete.metadata(self.corpus.metadata_index((field_,)), field_, text), text)

    def autocomplete_key(self, text: str) -> DataFrame:
        return autocomplete.keys(self.corpus.words, text)

    def landing_page(self, by: str, first: str, last: str) -> DataFrame:
        return reports.by_numbers(self.corpus.docs, by, int(first), int(last)) if self.kinds.get(by) == "int" else reports.by_letters(self.corpus.docs, by, first, last)

    def pages(self) -> DataFrame:
        """Pages of marked-up texts: (doc, n, start, prev, next), the neighbours by their labels."""
        pages = self.corpus.objects.where("kind = 'page'").select("doc", F.col("name").alias("n"), "start")
        return metadata.neighbours(pages, ["start"], ["doc"], "n")

    def page_images(self) -> DataFrame:
        """Images of the pages of marked-up texts: (doc, page, image)."""
        return objects.page_images(self.corpus.objects.where("kind = 'page'"))

    def metadata_export(self, level: str = "doc") -> DataFrame:
        """Objects of a level as JSON records; those below documents with their document's fields."""
        if level == "doc":
            return export.metadata_export(self.corpus.docs, self.corpus.docs, "doc")
        rows = self.corpus.paragraphs if level == "para" else self.corpus.divisions.where(F.col("level") == level)
        return export.metadata_export(rows.join(self.corpus.docs, "doc"), self.corpus.docs, "doc")

    def export(self, report: str, path: str, kind: str, *args, **more) -> None:
        """Writes a report by name; a registered function of the name stands before the built-in one."""
        fn = self.functions.own.get(report) or getattr(self, report)
        export.write(fn(*args, **more), path, kind)
