"""Toxicity by weak supervision.

Many voters, lexicons and patterns, vote on training documents; the given label
is one voter more, which is silent on documents without one.  A generative label
model estimates each voter's accuracy (how likely it casts each vote on either
class), the label's too, and how voters correlate beyond the class, by
expectation maximisation; correlated voters share their weight.  Its posterior
labels alone train a sparse linear classifier on words and word beginnings,
which scores every document from its text alone.

Words and beginnings that mark a class are found by counting over the sample of
labelled training rows; they make the mined lexicons.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import fold_of, kept_rows, map_slices, sampled, slices, stored, to_arrow

#: Labelled training rows at most, and unlabelled ones, chosen by a hash of the id.
SAMPLE, UNLABELLED = 16_000, 4_000
#: Words and beginnings that the classifier knows at most.
FEATURES = 4000
#: Documents of the sample that must have a feature.
SUPPORT = 4
BEGINNINGS = (4, 5, 6, 7)
#: Mined lexicons; a feature's place among them follows from its beginning.
MINED_VOTERS = 24
#: Numbers of words with one mined beginning that are patterns of their own.
SEVERAL = ("#2", "#3", "#5")
#: Log odds of a toxic feature to be mined.
MINED_ODDS = 4.0
#: What a fixed lexicon's word weighs before any label is seen.
LEXICON_WEIGHT = 5.0
#: Word forms whose features a worker remembers.
CACHE = 200_000

#: Draws the intercept to where one word of a lexicon is enough, so that a sample without toxic documents doesn't take it away.
PULL = 1e-3

# Common insults and abuse, by kind, in four languages.
LEXICONS = {
    "insult_person": "idiot moron loser clown scum fool jerk imbecile cretin dumbass dimwit halfwit coward lowlife creep".split(),
    "insult_quality": "stupid worthless pathetic disgusting dumb ugly filthy useless vile repulsive trash garbage".split(),
    "hate": "vermin subhuman parasite parasites degenerate savages".split(),
    "profanity": "shit fuck fucking bitch bastard asshole crap".split(),
    "german": "idiot trottel dummkopf arschloch scheisse scheiße dreckig widerlich abschaum versager hurensohn".split(),
    "french": "idiot imbécile connard salope merde débile ordure crétin minable dégoûtant".split(),
    "spanish": "idiota imbécil estúpido estúpida mierda puta cabrón basura asqueroso inútil gilipollas".split(),
}
PATTERNS = {
    "threat": re.compile(r"\b(?:kill|hurt|beat|destroy) (?:you|yourself|them all|her|him)\b"),
    "address": re.compile(r"\byou(?: are|'re| absolute| total| complete)? (?:an? )?(?:absolute |total |complete )?(?:idiot|moron|loser|clown|fool|scum|trash|stupid|worthless|pathetic|disgusting)\b"),
    "shout": re.compile(r"!{3,}"),
}
#: One word in so many.
SHARES = (200, 100, 50, 25)
LEVELS = ("#2", "#3", "#5", *(f"#{k}/" for k in SHARES))
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Distinct words of letters in lower case."""
    return sorted(set(_WORD.findall(text.lower()))) if text else []


def features_of(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) > k)]


def levels_of(counts: dict[str, int], n_words: int) -> list[str]:
    """The features of a document: those of its distinct words, and beginnings that several words, or a share of all, have in common."""
    out = list(counts)
    for f, n in counts.items():
        if n > 1 and f[0] != "=":
            out.append(f + "#2")
            if n > 2:
                out.append(f + "#3")
            if n > 4:
                out.append(f + "#5")
            out += [f"{f}#{k}/" for k in SHARES if n * k >= n_words]
    return out


def pattern_votes(text: str | None) -> list[int]:
    lower = (text or "").lower()
    return [int(bool(p.search(lower))) for p in PATTERNS.values()]


@dataclass
class LabelModel:
    """Votes are -1, 0 (none) and 1; chance[c, j, v + 1] is the probability that voter j casts v on class c."""

    prior: float = 0.5
    chance: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 3)))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def fit(self, votes: np.ndarray, rounds: int = 40) -> np.ndarray:
        """Estimates from votes (documents, voters), beginning at the last voter's label, or the majority's where that is silent; returns the posterior."""
        n, m = votes.shape
        cast = np.stack([votes == v for v in (-1, 0, 1)], -1).astype(np.float32)
        total = np.where(votes[:, -1] != 0, 2 * votes[:, -1], votes.sum(1).clip(-1, 1)) if n else np.zeros(0)
        self.share, posterior = np.ones(m), np.array([0.03, 0.1, 0.5, 0.9, 0.97])[(total + 2).astype(int)]
        usual = (cast.sum(0) + 1e-6) / (n + 3e-6)  # a voter without votes says nothing on either class
        for k in range(rounds):
            self.prior = float(np.clip(posterior.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
            on_class = np.stack([1 - posterior, posterior])
            counts = np.einsum("cn,njv->cjv", on_class, cast) + 1.5 * usual
            self.chance = counts / counts.sum(-1, keepdims=True)
            if k >= 2:
                self.correlation = self._correlation(votes.astype(float), posterior)
                beyond = np.clip(self.correlation - 2 / np.sqrt(n), 0, None)  # what chance doesn't explain
                np.fill_diagonal(beyond, 0)
                self.share = 1 / (1 + beyond.sum(1))
            new = self.posterior(votes)
            if not n or np.abs(new - posterior).max() < 1e-4:
                return new
            posterior = new
        return posterior

    def _correlation(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Of voters, within the classes."""
        values = np.array([-1.0, 0.0, 1.0])
        expected = self.chance @ values  # of each class and voter
        left = votes - (np.outer(1 - posterior, expected[0]) + np.outer(posterior, expected[1]))
        cov = left.T @ left / max(1, len(votes))
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return cov / np.outer(scale, scale)

    def accuracy(self) -> np.ndarray:
        """Of each voter, the share of its votes that are right."""
        right = self.chance[0, :, 0] * (1 - self.prior) + self.chance[1, :, 2] * self.prior
        return right / (right + self.chance[0, :, 2] * (1 - self.prior) + self.chance[1, :, 0] * self.prior)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = (np.log(self.chance[1]) - np.log(self.chance[0])) * self.share[:, None]
        total = np.log(self.prior / (1 - self.prior)) + ratio[np.arange(votes.shape[1]), votes + 1].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def logistic(rows: list[np.ndarray], target: np.ndarray, prior: np.ndarray, penalty: float = 3e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sets of features against probabilities (accelerated gradient steps), drawn to ``prior``."""
    n = len(prior)
    if not len(rows):
        return prior.copy(), -LEXICON_WEIGHT / 2
    sizes = np.array([len(r) for r in rows])
    flat, of = (np.concatenate(rows) if sizes.sum() else np.zeros(0, np.int64)).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(np.bincount(flat, minlength=n), 1) / len(rows) + 0.01)  # rare features take larger steps
    w, b, v, vb = prior.copy(), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), np.zeros(n), 0.0
    rate, keep = 0.5, 0.9
    for _ in range(rounds):
        score = b + np.bincount(of, w[flat], len(rows))
        error = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - target
        g = np.bincount(flat, error[of], n) / len(rows) + penalty * (w - prior)
        v, vb = keep * v - rate * scale * g, keep * vb - rate * (error.mean() + PULL * (b + LEXICON_WEIGHT / 2))
        w, b = w + v, b + vb
    return w, b


def boundary(scores: np.ndarray, toxic: np.ndarray, most: float = 3.0) -> float:
    """The log odds that part two classes with the fewest errors: the middle of the widest such gap, within ``most`` of 0."""
    order = np.argsort(scores, kind="stable")
    z, y = scores[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)])  # below each cut
    false = (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])  # above it
    edges = np.concatenate([[-most], np.clip(z, -most, most), [most]])
    gaps = np.where(missed + false == (missed + false).min(), np.diff(edges), -1)
    k = int(gaps.argmax())
    return float((edges[k] + edges[k + 1]) / 2) if gaps[k] > 0 else 0.0


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float
    labels: LabelModel | None = None

    def scorer(self):
        known: dict[str, tuple[str, ...]] = {}
        weights = self.weights | {f: 0.0 for f in {k.split("#")[0] for k in self.weights} - set(self.weights)}

        def score(text: str | None) -> float:
            counts: dict[str, int] = {}
            words = set(_WORD.findall(text.lower())) if text else ()
            for w in words:
                if (fs := known.get(w)) is None:
                    fs = tuple(f for f in features_of(w) if f in weights)
                    if len(known) < CACHE:
                        known[w] = fs
                for f in fs:
                    counts[f] = counts.get(f, 0) + 1
            total = self.intercept + math.fsum(weights.get(f, 0.0) for f in levels_of(counts, len(words)))
            return float(1 / (1 + math.exp(-max(-40.0, min(40.0, total)))))

        return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """Fits on rows outside fold 0, labelled and not; null labels and ids are no labels, and of several labels of an id the highest counts.

    Without labels the lexicons and patterns vote alone; without documents,
    each word of a lexicon has LEXICON_WEIGHT.
    """
    rows = stored(map_slices(_chosen(docs, labels, id_col, text_col, label_col, sample, unlabelled), _cut, "toxic int, words array<string>, patterns array<int>"), "words")
    names, strong = _features(rows)
    number = {f: k for k, f in enumerate(names)}
    sets, patterns, toxic = _vectors(rows, number)
    votes = _votes(sets, patterns, toxic, number, strong)
    model = LabelModel()
    posterior = model.fit(votes)
    lexicon = {"=" + w for words in LEXICONS.values() for w in words}
    weights, intercept = logistic(sets, posterior, np.array([LEXICON_WEIGHT * (f in lexicon) for f in names]))
    if len(sets):
        intercept -= boundary(np.array([intercept + weights[s].sum() for s in sets]), (posterior >= 0.5).astype(int))
    return Model({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, intercept, model)


def _chosen(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, unlabelled: int) -> DataFrame:
    """Rows (toxic, text) of at most ``sample`` labelled ids and ``unlabelled`` others (toxic is null), none of fold 0."""
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = stored(given.where(fold_of("doc_id") != 0), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    others = sampled(texts.select("doc_id").where(fold_of("doc_id") != 0), "doc_id", unlabelled, "unlabelled").join(given, "doc_id", "left_anti")
    ids = stored(sampled(given, "doc_id", sample, "toxicity").unionByName(others.withColumn("toxic", F.lit(None).cast("int"))), "chosen")
    return texts.join(F.broadcast(ids), "doc_id").select("toxic", "text")  # no more than sample + unlabelled ids of 12 bytes


def _cut():
    return lambda part: {"toxic": part["toxic"], "words": [words_of(t) for t in part["text"]], "patterns": [pattern_votes(t) for t in part["text"]]}


def _features(rows: DataFrame) -> tuple[list[str], list[str]]:
    """The classifier's features, sorted, and those of them that mark toxic documents, by the labelled rows' counts."""
    labelled = rows.where("toxic IS NOT NULL").select("toxic", F.explode("words").alias("word"))
    beginnings = F.array(F.concat(F.lit("="), "word"), *(F.when(F.length("word") > k, F.substring("word", 1, k)) for k in BEGINNINGS))
    counted = labelled.select("toxic", F.explode(beginnings).alias("feature"))
    # several words of a document may share a beginning: it counts by words, as an upper bound of documents
    counts = counted.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("pos") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("neg") + 0.5) / (sizes.get(0, 0) + 1))
    telling = counts.where(F.col("pos") + F.col("neg") >= SUPPORT).select("feature", "pos", "neg", odds.alias("odds"), (odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))).alias("z"))
    chosen = telling.orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()
    names = {r.feature for r in chosen} | {"=" + w for words in LEXICONS.values() for w in words}
    names |= {f + level for f in names if f[0] != "=" for level in LEVELS}
    return sorted(names), [r.feature for r in chosen if r.odds > MINED_ODDS and r.pos >= SUPPORT]


def _vectors(rows: DataFrame, number: dict[str, int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sample as sets of feature numbers, pattern votes and labels (-1: none), in an order that doesn't depend on how rows come."""
    arrow = to_arrow("toxic int, features array<int>, patterns array<int>")

    def vectors(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            for part in slices(batch):
                out = []
                for words in part.column(1).to_pylist():
                    counts: dict[str, int] = {}
                    for w in words:
                        if w not in known:
                            if len(known) >= CACHE:
                                known.clear()
                            known[w] = [f for f in features_of(w) if f in number]
                        for f in known[w]:
                            counts[f] = counts.get(f, 0) + 1
                    out.append(sorted(number[f] for f in levels_of(counts, len(words))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, arrow.field(1).type), part.column(2).cast(arrow.field(2).type)], schema=arrow)

    got = rows.mapInArrow(vectors, "toxic int, features array<int>, patterns array<int>").toArrow().combine_chunks()
    toxic = got.column("toxic").fill_null(-1).to_numpy()
    lists = lambda name: [(c.values.to_numpy(), np.asarray(c.offsets)) for c in got.column(name).chunks]
    cut_up = lambda name: [v[i:j] for v, o in lists(name) for i, j in zip(o[:-1], o[1:])]  # noqa: E731  views, not Python numbers
    sets, patterns = cut_up("features"), cut_up("patterns")
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], sets[i].tobytes(), patterns[i].tobytes()))
    return [sets[i] for i in order], np.array([patterns[i] for i in order], int).reshape(-1, len(PATTERNS)), toxic[order]


def _votes(sets: list[np.ndarray], patterns: np.ndarray, toxic: np.ndarray, number: dict[str, int], strong: list[str]) -> np.ndarray:
    """Columns: each lexicon, each pattern, the mined lexicons, several mined words, 'none of them' (votes -1), and the label."""
    kinds = list(LEXICONS)
    member = np.zeros((len(number), len(kinds) + MINED_VOTERS), bool)
    for k, words in enumerate(LEXICONS.values()):
        member[[number["=" + w] for w in words], k] = True
    mined = np.zeros((len(number), len(SEVERAL)), bool)
    for f in strong:
        member[number[f], len(kinds) + zlib.crc32(f.strip("=")[:4].encode()) % MINED_VOTERS] = True
        for k, level in enumerate(SEVERAL):
            if f + level in number:
                mined[number[f + level], k] = True
    hits = np.array([member[s].any(0) for s in sets], bool).reshape(-1, member.shape[1])
    several = np.array([mined[s].any(0) for s in sets], bool).reshape(-1, len(SEVERAL))
    none = -(~hits.any(1)).astype(int)
    return np.column_stack([hits[:, : len(kinds)].astype(int), patterns, hits[:, len(kinds) :].astype(int), several.astype(int), none, np.where(toxic < 0, 0, np.where(toxic == 1, 1, -1))])


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each input row: a probability from the text alone.

    Null and empty texts have the score of a text without features.  Other
    columns are not looked at.
    """

    def make():
        score = model.scorer()
        return lambda part: {"doc_id": part["doc_id"], "score": list(map(score, part["text"]))}

    return map_slices(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id bigint, score double")


def keep_clean(df: DataFrame, model: Model, toxic: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text's score is below ``toxic``; null and empty texts have that of a text without features."""

    def make():
        score = model.scorer()
        return lambda texts: {"kept": [score(t) < toxic for t in texts]}

    return kept_rows(df, text_col, make)
