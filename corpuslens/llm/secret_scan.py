"""Secret scans: base rules, and a character convolutional network over every candidate.

Candidates are the base rules' matches, and all runs of MIN_RUN or more key
characters that have a digit, or capitals behind small letters.  The network
reads each candidate with its surrounding bytes, a long one in overlapping
stretches of which the highest score counts: embedding, one convolution, maximum
and mean over the positions, and a dense layer.

It is trained in numpy on labelled findings.  Some are of the documents: what the
base rules find, as it stands and moved into other texts, is labelled as a secret,
numbers are not.  The others are keys and harmless look-alikes by a seeded
generator, put between bytes of the documents, as the tables name no other
secrets.  Scores are calibrated on findings kept out of that, and the threshold
is the highest one that keeps RECALL of their secrets.  Candidates of at least
the threshold are spans of kind ``model``; base spans stay, whatever the network
says, and carry its score.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import fold_of, map_slices, sampled

KINDS = ("assign", "access", "hex", "model")
# The base rules.  On bytes, ignoring case concerns ASCII letters only.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are whole, so shorter ones fail here as they would afterwards
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
MIN_RUN = 12
RUN = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+")  # whole, whatever sign follows: that is the network's to judge
TELLING = re.compile(rb"[0-9]|[a-z][A-Z].*[a-z][A-Z]")
BEFORE, MIDDLE, AFTER = 20, 48, 8
WINDOW = BEFORE + MIDDLE + AFTER
EMBED, WIDTH, FILTERS = 8, 5, 32
#: Generated findings, passes, the share of the secrets that the threshold keeps.
FINDINGS, EPOCHS, RECALL = 5000, 10, 0.99
#: Documents outside fold 0 that give findings and surroundings at most, and how many each gives.
SAMPLE, OF_EACH = 1500, 4
SEED = 20240229


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' findings, in bytes."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(data)]


def other_candidates(data: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs with a digit, or with two capitals behind small letters, that touch no base span; one pass over both."""
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for s, _, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, k = [], 0
    for m in RUN.finditer(data):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if (k == len(taken) or taken[k][0] >= m.end()) and TELLING.search(m[0]):
            out.append(m.span())
    return out


def middles(start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of at most MIDDLE bytes, half overlapping, that cover a candidate."""
    last = end - MIDDLE
    return [(start, end)] if last <= start else [(s, s + MIDDLE) for s in (*range(start, last, MIDDLE // 2), last)]


def window(data: bytes, start: int, end: int) -> np.ndarray:
    """Bytes around and in a stretch of at most MIDDLE; signs beyond ASCII are one."""
    held = data[start:end]
    text = data[max(0, start - BEFORE) : start].rjust(BEFORE, b"\0") + held.ljust(MIDDLE, b"\0") + data[end : end + AFTER].ljust(AFTER, b"\0")
    return np.minimum(np.frombuffer(text, np.uint8), 127)


@dataclass
class Network:
    embed: np.ndarray  # (128, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (2 * FILTERS,)
    offset: float
    scale: float = 1.0  # calibration: probability = sigmoid(scale * logit + shift)
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        e = self.embed[x]
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(WIDTH)], 2)
        h = np.maximum(cols @ self.filters + self.bias, 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return cols, h, top, pooled, pooled @ self.dense + self.offset

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))


# Beginnings of well-known keys, words before one, and syllables of made-up words.
KEY_PREFIXES = ("", "", "", "ghp_", "sk_live_", "xoxb-", "AIza", "AKIA", "eyJ", "glpat-", "key-")
KEY_LEADS = ("", "", "", " ", "password=", "token: ", 'api_key = "', "secret=", "Authorization: Bearer ", "key: ", "credentials ")
SYLLABLES = "th an er on re ti es or in en la de que ch ment ver ci be ca da fi go ha ism ka lo mu no ol pa ra st tr ul vi wa ex yo ing tion ble ness str pre con dis per com sub ate ous ant ist ary ful".split()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PLAIN_NUMBER = re.compile(rb"[0-9/_+=-]+")


def table_findings(data: bytes) -> list[tuple[int, bytes, bytes, bytes]]:
    """(label, before, candidate, after) of a document: at most OF_EACH base findings (1), numbers (0), and blanks between words (-1), spread over the text."""
    base = base_spans(data)
    numbers = [(s, e) for s, e in other_candidates(data, base) if PLAIN_NUMBER.fullmatch(data, s, e)]
    blanks = [m.span() for m in re.finditer(rb"\s+", data)]
    out = []
    for label, spans in ((1, [(s, e) for s, _, e in base]), (0, numbers), (-1, blanks)):
        for s, e in spans[:: max(1, -(-len(spans) // OF_EACH))]:
            out.append((label, data[max(0, s - BEFORE) : s], data[s : e if label >= 0 else s][:4096], data[e : e + AFTER]))
    return out


def gathered(df: DataFrame, id_col: str, text_col: str) -> list[tuple[int, bytes, bytes, bytes]]:
    """table_findings of at most SAMPLE documents outside fold 0, in an order of their own."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    few = sampled(rows.where(fold_of("doc_id") != 0), "doc_id", SAMPLE, "secrets")

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            got = [f for t in part["text"] for f in table_findings((t or "").encode())]
            return {name: [f[k] for f in got] for k, name in enumerate(("label", "before", "held", "after"))}

        return run

    found = map_slices(few, make, "label int, before binary, held binary, after binary").collect()  # OF_EACH of three kinds a document at most
    return sorted((r.label, bytes(r.before), bytes(r.held), bytes(r.after)) for r in found)


def findings(n: int = FINDINGS, seed: int = SEED, table: list[tuple[int, bytes, bytes, bytes]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of the table's findings, and of ``n`` generated ones, of which every other one is a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    word = lambda: "".join(rng.choice(SYLLABLES, rng.integers(1, 5)))
    letters = LOWER + UPPER
    places = [f for f in table if f[0] < 0]

    def secret(least: int = MIN_RUN) -> tuple[str, str, str]:
        k = int(rng.integers(least, 56 if rng.random() < 0.6 else least + 12))
        body = (pick(letters + DIGITS, k), pick(DIGITS + "abcdef", k + 6), pick(letters + DIGITS + "+/", k) + "=" * int(rng.integers(0, 3)), pick(UPPER + DIGITS, k), pick(letters + DIGITS + "-_", k), pick(LOWER + DIGITS, k + 8))[int(rng.integers(6))]
        lead = str(rng.choice(KEY_LEADS))
        if rng.random() < 0.1:  # one part of a dotted key
            parts = ["eyJ" + pick(letters + DIGITS + "-_", int(n)) for n in rng.integers(15, 60, 2)] + [pick(letters + DIGITS + "-_", 43)]
            at = int(rng.integers(3))
            return lead + "".join(p + "." for p in parts[:at]), parts[at], "".join("." + p for p in parts[at + 1 :]) + str(rng.choice([" ", ". ", "\n"]))
        return lead, str(rng.choice(KEY_PREFIXES)) + body, str(rng.choice([" ", '" ', "\n", ", ", ". ", ".\n", "." + word(), "@" + word() + ".example "]))

    def harmless() -> tuple[str, str, str]:
        kind = int(rng.integers(12)) if rng.random() < 0.85 else 9
        body = (
            lambda: "-".join(word() for _ in range(4)) + pick(DIGITS, 2), lambda: word() + "_" + word() + "_" + word() + pick(DIGITS, 4), lambda: "/".join(word() for _ in range(3)) + "/" + pick(DIGITS, 4) + "/" + word(),
            lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{pick(DIGITS, 2)}-{pick(DIGITS, 2)}", lambda: "+" + pick(DIGITS, 2) + "-" + pick(DIGITS, 3) + "-555-" + pick(DIGITS, 4) + "x" + pick(DIGITS, 2),
            lambda: word() + pick(DIGITS, 1) + word() + word() + word(), lambda: "version-" + "-".join(pick(DIGITS, 2) for _ in range(4)), lambda: "x" + "=" * 18 + pick(DIGITS, 1), lambda: "chapter" + pick(DIGITS, 1) + "_" + word() + "-" + word() + "-" + word(),
            lambda: pick(DIGITS, int(rng.integers(MIN_RUN, 40))), lambda: "-".join(pick(DIGITS, 4) for _ in range(4)), lambda: "".join(word().capitalize() for _ in range(rng.integers(3, 7))) + pick(DIGITS, int(rng.integers(3))),
        )[kind]()
        return str(rng.choice(["", "", "http://", "see ", "www/", "id "])), body.ljust(MIN_RUN, "a"), str(rng.choice([" ", ". ", "\n", ", ", "." + word() + " ", ".html ", "@" + word() + ".example "]))

    def around() -> tuple[bytes, bytes]:
        if places and rng.random() < 0.7:
            _, before, _, after = places[int(rng.integers(len(places)))]
            return before, after
        words = lambda k: " ".join(word() for _ in range(k)).encode()
        return words(4), words(2)

    rows, labels = [], []

    def add(before: bytes, held: bytes, after: bytes, label: int) -> None:
        stretches = middles(len(before), len(before) + len(held))
        rows.append(window(before + held + after, *stretches[int(rng.integers(len(stretches)))]))
        labels.append(label)

    for i in range(n):
        inner = rng.random() < 0.3
        lead, body, tail = secret(20 if inner else MIN_RUN) if i % 2 else harmless()
        before, after = around()
        before += b" " + lead.encode()
        data = before + body.encode() + tail.encode() + after
        if inner:  # in a longer run: any stretch of a harmless one, or one that holds most of the key
            joint = str(rng.choice(["/", "_", "-", "="]))
            sides = [joint.join(word() + pick(DIGITS, int(rng.integers(3))) for _ in range(rng.integers(3, 9))) for _ in range(2)]
            data = before + (sides[0] + joint).encode()
            start, end = len(before), len(data) + len(body) + 1 + len(sides[1])
            key = len(data), len(data) + len(body)
            data += (body + joint + sides[1] + tail).encode() + after
            held = middles(start, end)
            stretch = max(held, key=lambda m: min(m[1], key[1]) - max(m[0], key[0])) if i % 2 else held[int(rng.integers(len(held)))]
            rows.append(window(data, *stretch))
            labels.append(i % 2)
        else:
            add(before, body.encode(), tail.encode() + after, i % 2)
    for label, before, held, after in table:
        if label >= 0:
            add(before, held, after, label)
            if label and places:  # the value alone, in another text: what it is, and not only what stands before it
                _, other, _, end = places[int(rng.integers(len(places)))]
                value = re.split(rb"[^A-Za-z0-9+/_=-]", held.rstrip(b"\"'"))[-1]
                if len(value) >= MIN_RUN:
                    add(other + b" ", value, b" " + end, 1)
    return np.array(rows), np.array(labels, float)


def train(df: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> Network:
    """The network, trained on the driver by a bounded number of findings; tasks get it with their function.

    Documents of fold 0 give none.  Without documents, or where they are empty, generated findings stand alone.
    """
    return fitted(*findings(FINDINGS, seed, gathered(df, id_col, text_col) if df is not None else []), seed)


def fitted(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Trained on four fifths of windows and labels, calibrated on the others."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y = x[order], y[order]
    cut = len(x) * 4 // 5
    single = np.float32
    net = Network(rng.normal(0, 0.3, (128, EMBED)).astype(single), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(single), np.zeros(FILTERS, single), rng.normal(0, 0.2, 2 * FILTERS).astype(single), 0.0)
    names = ("embed", "filters", "bias", "dense")
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(cut)
        for at in range(0, cut, 128):
            rows = order[at : at + 128]
            cols, h, top, pooled, logit = net.forward(x[rows])
            error = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[rows]) / len(rows)).astype(single)
            back = error[:, None] * net.dense
            dh = np.repeat(back[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
            np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + back[:, None, :FILTERS], 1)
            dh *= h > 0
            de = np.zeros((len(rows), WINDOW, EMBED), single)
            dcols = dh @ net.filters.T
            for k in range(WIDTH):
                de[:, k : k + h.shape[1]] += dcols[:, :, k * EMBED : (k + 1) * EMBED]
            embed = np.stack([np.bincount(x[rows].ravel(), de[:, :, k].ravel(), 128) for k in range(EMBED)], 1)
            grads = {"embed": embed, "filters": np.tensordot(cols, dh, ((0, 1), (0, 1))), "bias": dh.sum((0, 1)), "dense": pooled.T @ error}
            step += 1
            for n, g in grads.items():
                first[n], second[n] = 0.9 * first[n] + 0.1 * g, 0.999 * second[n] + 0.001 * g * g
                setattr(net, n, (getattr(net, n) - 0.005 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(single))
            net.offset -= 0.05 * float(error.sum())
    _calibrate(net, x[cut:], y[cut:])
    return net


def _calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling by Newton steps, then the highest threshold that keeps RECALL of the secrets."""
    z, theta = net.logits(x), np.array([1.0, 0.0])
    features = np.column_stack([z, np.ones_like(z)])
    soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -40, 40)))
        hessian = features.T @ (features * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, features.T @ (p - soft)), -1, 1)
    net.scale, net.shift = map(float, theta)
    net.threshold = float(np.quantile(net.scores(x[y > 0]), 1 - RECALL, method="lower"))


def scan(text: str | None, net: Network) -> tuple[list[tuple[int, int, int, float]], int]:
    """(start, kind, end, score) in code points, ascending; kind is a place in KINDS.  And the number of candidates that were read."""
    data = (text or "").encode()
    base = base_spans(data)
    more = other_candidates(data, base)
    if not base and not more:
        return [], 0
    parts = [middles(s, e) for s, e in [(s, e) for s, _, e in base] + more]
    first = np.cumsum([0, *map(len, parts[:-1])])
    score = np.maximum.reduceat(net.scores(np.array([window(data, s, e) for p in parts for s, e in p])), first)
    found = [(*b, float(p)) for b, p in zip(base, score)] + [(s, 3, e, float(p)) for (s, e), p in zip(more, score[len(base) :]) if p >= net.threshold]
    if len(data) != len(text):
        point = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        found = [(int(point[s]), k, int(point[e]), p) for s, k, e, p in found]
    return sorted(found), len(parts)


def joined(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def masked(text: str, spans: list[tuple[int, int, int, float]], mask: str = "[SECRET]") -> str:
    """The text with every span, or stretch of overlapping spans, replaced."""
    out, at = [], 0
    for s, _, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_documents(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """Rows (doc_id, spans, n_assign, n_access, n_hex, n_model, n_confirmed, n_read, base_sha256, found, scores[, masked]), one for each input row.

    found: all spans as kind:start:end by start, then kind, comma-joined; in
    code points, end exclusive; scores: the network's, in the same order, to
    three places.  base_sha256: of the base spans alone.  n_confirmed: base
    spans that the network, too, takes for secrets; n_read: all candidates it
    read.  A null text is empty: no spans; its masked text stays null.  A
    narrow map.
    """

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            both = [scan(t, net) for t in part["text"]]
            got = [g for g, _ in both]
            count = lambda k: [sum(s[1] == k for s in g) for g in got]
            out = {
                "doc_id": part["doc_id"], "spans": [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in g] for g in got], "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "n_model": count(3),
                "n_confirmed": [sum(s[1] < 3 and s[3] >= net.threshold for s in g) for g in got], "n_read": [n for _, n in both],
                "base_sha256": [hashlib.sha256(joined([s for s in g if s[1] < 3]).encode()).hexdigest() for g in got], "found": list(map(joined, got)), "scores": [",".join(f"{s[3]:.3f}" for s in g) for g in got],
            }
            return out | ({"masked": [t if t is None else masked(t, g) for t, g in zip(part["text"], got)]} if mask else {})

        return run

    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, n_assign bigint, n_access bigint, n_hex bigint, n_model bigint, n_confirmed bigint, n_read bigint, base_sha256 string, found string, scores string" + ", masked string" * mask
    return map_slices(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)


def mask_column(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with the spans in ``text_col`` replaced; every other column passes through unread."""
    names = df.columns
    at = names.index(text_col)

    def make():
        def run(part: dict[str, list]) -> dict[str, list]:
            key = f"c{at}"
            return part | {key: [t if t is None else masked(t, scan(t, net)[0]) for t in part[key]]}

        return run

    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema))
    return map_slices(plain, make, schema, sized_by=f"c{at}").toDF(*names)
