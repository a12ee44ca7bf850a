"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of one to three signs, with sublinear
term frequency, inverse document frequency and unit length.  Weights are
trained with follow-the-regularised-leader, whose L1 penalty leaves most of them
zero, and L2; a temperature fitted on rows kept out of that calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import fold_of, kept_rows, map_slices, slices, to_arrow

#: Labelled rows outside fold 0 that training takes at most, spread evenly over the languages as far as they go.
SAMPLE = 3000
#: Languages that are learned at most, the most frequent ones; the weights have a column for each.
LANGUAGES = 200
BITS = 14
SIZE = 1 << BITS
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.02
UNKNOWN = "und"
CERTAIN = 0.125

_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)])
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def signs(text: str | None) -> np.ndarray:
    """Code points in lower case; whatever isn't a letter is a blank, one for each run, with one at either end."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), np.uint32)
    letter = (points >= 0x10000) | _LETTER[np.minimum(points, 0xFFFF)]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]  # the first sign behind a letter
    return np.where(letter, points, np.uint32(32))[kept]


def counts(text: str | None) -> np.ndarray | None:
    """Occurrences of each hashed n-gram; None without a letter."""
    s = signs(text)
    if len(s) < 3 and not (s != 32).any():
        return None
    one = s * _MULTIPLIERS[0]
    two = one[:-1] ^ (s[1:] * _MULTIPLIERS[1] + np.uint32(1))
    three = (two[:-1] * np.uint32(31)) ^ (s[2:] * _MULTIPLIERS[2] + np.uint32(2))
    return np.bincount(np.concatenate([(x * _MULTIPLIERS[0]) >> np.uint32(32 - BITS) for x in (one, two, three)]), minlength=SIZE)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (SIZE, languages), mostly zero
    intercept: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        c = counts(text) if self.languages else None
        if c is None:
            return UNKNOWN, 0.0
        at = np.flatnonzero(c)
        logits = self.logits(at, c[at])
        p = softmax(logits / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weighed(self.idf, at, n) @ self.weights[at] + self.intercept


def weighed(idf: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / max(1e-12, float(np.sqrt(v @ v)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates; rows are (features, values)."""
    z, n = np.zeros((SIZE + 1, n_classes)), np.zeros((SIZE + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = np.append(rows[i][0], SIZE), np.append(rows[i][1], 1.0)  # the last is the intercept
            w = weights(at)
            p = softmax(v @ w)
            p[target[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:-1], w[-1]


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> Model:
    """From (features, counts, language) of texts with letters and the inverse document frequencies; every fifth is left for the temperature."""
    languages = sorted({s[2] for s in samples})
    if not languages:
        return Model([], np.zeros(SIZE), np.zeros((SIZE, 0)), np.zeros(0))
    held = np.arange(len(samples)) % 5 == 4
    rows = [(at, weighed(idf, at, n)) for at, n, _ in samples]
    target = np.array([languages.index(s[2]) for s in samples])
    train = [i for i in range(len(rows)) if not held[i]] or list(range(len(rows)))
    weights, intercept = follow_the_leader([rows[i] for i in train], target[train], len(languages))
    model = Model(languages, idf, weights, intercept)
    logits = np.array([rows[i][1] @ weights[rows[i][0]] + intercept for i in np.flatnonzero(held)])
    if len(logits):
        model.temperature = calibrated(logits, target[held])
    return model


def calibrated(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature, of a geometric grid, of the least negative log-likelihood."""

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), target]).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=lambda t: (round(loss(t), 9), abs(np.log(t)))))


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Of the hashed n-grams, over all texts with a letter; each task sends one row for each of its n-grams."""
    schema = "bucket int, n bigint"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE + 1, np.int64)  # the last counts the texts
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column(0).to_pylist():
                    if (c := counts(text)) is not None:
                        seen[:-1] += c > 0
                        seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, arrow.field(0).type), pa.array(seen[at])], schema=arrow)

    got = texts.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(SIZE + 1)
    seen[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1


def shares(there: dict[str, int], sample: int) -> dict[str, float]:
    """How many rows of each language are taken: equally many, and what the smaller ones leave goes to the larger."""
    out, left = {}, float(sample)
    for k, (lang, n) in enumerate(sorted(there.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(float(n), left / (len(there) - k))
        left -= out[lang]
    return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on rows outside fold 0 with a language, a sample of them; n-grams are counted over all texts outside fold 0.  Rows of null ids aren't learned from."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = rows.where(F.col("text").isNotNull() & (fold_of("doc_id") != 0))
    rows = texts.where(F.col("lang").isNotNull())
    there = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    if not there:
        return fit([], np.zeros(SIZE))
    share = shares(there, sample)
    # by their shares of all hashes half as many again as are wanted, one row of an id, then the least hashes of each language
    h = F.xxhash64("doc_id", F.lit("language"))
    cut = {lang: min((1 << 63) - 1, int(min(1.0, 1.5 * share[lang] / n) * (1 << 62)) * 4 - (1 << 63)) for lang, n in there.items()}
    cuts = F.create_map(*(x for lang, c in cut.items() for x in (F.lit(lang), F.lit(c).cast("long"))))
    near = rows.withColumn("h", h).where(F.col("h") <= F.element_at(cuts, F.col("lang"))).groupBy("h").agg(F.min(F.struct("doc_id", "lang", "text")).alias("x")).select("h", "x.*")
    most = F.create_map(*(F.lit(x) for lang in there for x in (lang, int(-(-share[lang] // 1)))))
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= F.element_at(most, F.col("lang"))).select("doc_id", "text", "lang")

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            got = [(lang, doc_id, c) for lang, doc_id, t in zip(part["lang"], part["doc_id"], part["text"]) if (c := counts(t)) is not None]
            at = [np.flatnonzero(c) for _, _, c in got]
            return {"lang": [x for x, _, _ in got], "doc_id": [x for _, x, _ in got], "at": at, "n": [c[a] for a, (_, _, c) in zip(at, got)]}

        return run

    table = map_slices(chosen, make, "lang string, doc_id bigint, at array<int>, n array<int>").toArrow()
    samples = [(np.asarray(at.values), np.asarray(n.values), lang.as_py(), i.as_py()) for lang, i, at, n in zip(*(table.column(k) for k in range(4)))]
    samples.sort(key=lambda s: (s[3] * 0x9E3779B97F4A7C15 & (2**64 - 1), s[2], len(s[0])))  # the same order, however the rows come
    return fit([s[:3] for s in samples], inverse_frequencies(texts))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each input row, from the text alone.

    Texts that are null or have no letter are ``und`` with a score of 0; so is
    every text if nothing could be learned.  Other columns are not looked at.
    """

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            got = [model.predict(t) for t in part["text"]]
            return {"doc_id": part["doc_id"], "lang_pred": [x for x, _ in got], "score": [x for _, x in got]}

        return run

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(texts, make, "doc_id bigint, lang_pred string, score double")


def certain(model: Model) -> float:
    """The least score of an accepted language: an eighth of the way from chance to certainty, whatever the number of languages."""
    chance = 1 / max(1, len(model.languages))
    return chance + CERTAIN * (1 - chance)


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter and an accepted language; null texts have none."""
    least = certain(model)

    def make():
        return lambda texts: {"kept": [lang != UNKNOWN and score >= least for lang, score in map(model.predict, texts)]}

    return kept_rows(df, text_col, make)
