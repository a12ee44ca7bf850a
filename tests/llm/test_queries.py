"""The registered queries on whole small tables, against libraries, brute force and definitions that share no code with the operators."""

import base64
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpuslens.llm import langid, media, merkle, queries, webp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    return {r.doc_id: r for r in rows}, rows


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, rows = rows_of(spark, "op1_byte_bpe")
    assert len(rows) == len(texts)
    for i, text in texts.items():
        ids = other.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text.encode()))


def test_op2_rules_by_hand(spark):
    """The contract's five rules, written out again: longest first."""
    rules = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op2_url_filter(spark, SF).collect()}
    assert len(got) == len(rows)
    for page_id, url in rows:
        _, there, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if there else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if there else ""
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[page_id].host, got[page_id].path, got[page_id].rule) == (host, path, best[0])
        assert got[page_id].verdict == best[1] or best[1] is None and got[page_id].verdict in ("allow", "block")


def test_op3(spark, texts):
    _, rows = rows_of(spark, "op3_best_fit")
    assert {r.doc_id for r in rows} == set(texts)
    bins, pieces = {}, {}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for i, own in pieces.items():
        units = len(re.findall(r"[^\W\d_]+|\d+|[^\s\w]|_", texts[i]))
        assert sum(p.n_units for p in own) == units and sorted(p.piece for p in own) == list(range(own[0].n_pieces))
    for own in bins.values():
        assert sum(p.n_units for p in own) <= 1024 and len({source[p.doc_id] for p in own}) == len({" ".join(texts[p.doc_id].lower().split()) for p in own}) == len(own)


def test_op6(spark, texts):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got, rows = rows_of(spark, "op6_secret_scan")
    assert len(rows) == len(texts)
    for i, text in texts.items():
        spans = [[(m.start(), k, name, m.end()) for m in pattern.finditer(text) if ok(m)] for k, (name, pattern, ok) in enumerate(kinds)]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(map(len, spans))
        base = [f"{name}:{s}:{e}" for s, _, name, e in sorted(sum(spans, []))]
        assert got[i].base_sha256 == sha(",".join(base).encode()) and set(base) <= set(filter(None, got[i].spans.split(",")))
        assert got[i].n_model == got[i].spans.count("model:") and len(got[i].scores.split(",")) == len(got[i].spans.split(","))


def test_op7(spark, texts):
    from test_operators import brute_components

    got, rows = rows_of(spark, "op7_minhash")
    roots, sets = brute_components(list(texts.items()), 4, 80)
    assert {r.doc_id: (r.component_id, r.kept, r.n_shingles) for r in rows} == {i: (roots[i], roots[i] == i, len(sets[i][0])) for i in texts}


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got, rows = rows_of(spark, "op8_token_files")
    assert len(rows) == len(texts)
    for i in sorted(texts):
        ids = whole.encode(texts[i], add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def plain_feature(payload):
    """Means, entropy and brightness hash from their definitions."""
    means = [sum(payload[k::3]) / len(payload[k::3]) for k in range(3)]
    shares = [payload.count(b) / len(payload) for b in range(256) if payload.count(b)]
    edges = [k * len(payload) // 64 for k in range(65)]
    cells = [sum(payload[a:b]) / (b - a) for a, b in zip(edges, edges[1:])]
    bits = "".join(str(int(c > sum(cells) / 64)) for c in cells)
    return means, max(0.0, -sum(p * math.log2(p) for p in shares)), f"{int(bits, 2):016x}"


def test_op9(spark, texts):
    got, rows = rows_of(spark, "op9_webp")
    assert len(rows) == len(texts)
    stored = {r.doc_id: bytes(r.media) for r in media.store_media(spark.read.parquet(f"{SF}/documents.parquet"), read_back=False).collect()}
    for i, text in texts.items():
        data = text.encode()
        payload = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), sha(stored[i])) and webp.load(stored[i]).tobytes() == payload
        means, entropy, bits = plain_feature(payload)
        read = re.fullmatch(r"mean=([\d.]+)/([\d.]+)/([\d.]+);entropy=([\d.]+);hash=(\w+)", r.feature)
        assert [float(x) for x in read.groups()[:4]] == pytest.approx([*means, entropy], abs=6e-4) and bin(int(read[5], 16) ^ int(bits, 16)).count("1") <= 1


def plain_tree(text):
    """The tree's definition with other means: (root, sections' nodes, paragraphs' nodes by section, leaves with sizes)."""
    node = lambda level, parts: hashlib.blake2b(b"".join(parts), digest_size=16, person=level).digest()
    sections, leaves, now = [], {}, []
    for n, line in enumerate(lines := text.split("\n")):
        cuts = sorted({0, *(x for x in (2, 4, 8, 16, 24, 40, *range(56, len(line), 32)) if x < len(line))} | {len(line)})
        pieces = [line[a:b] for a, b in zip(cuts, cuts[1:])] or [""]
        hashes = [hashlib.blake2b(p.encode(), digest_size=8, person=b"leaf").digest() for p in pieces]
        leaves |= {h: len(p) for h, p in zip(hashes, pieces)}
        now.append(node(b"paragraph", hashes))
        if line == "" or len(now) == 16 or n == len(lines) - 1:
            sections.append(now)
            now = []
    tops = [node(b"section", s) for s in sections]
    return node(b"root", tops), tops, sections, leaves


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    total = sum(a[3].values()) + sum(b[3].values())
    return 2 * sum(a[3][h] for h in a[3] if h in b[3]) / total if total else 0.0


def test_op10(spark, texts):
    got, rows = rows_of(spark, "op10_merkle")
    assert len(rows) == len(texts)
    ids, prints = sorted(texts), {}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, following = texts[i], texts[after]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = map(plain_tree, (text, new, following))
        name = lambda t: t[0].hex() + ":" + ".".join(s.hex()[:8] for s in t[1])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(new.encode()), name(a), name(b))
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(a, b), plain_likeness(a, c)))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert merkle.tree_of(None).fingerprint() == merkle.tree_of("").fingerprint()


def test_language_features_by_definition():
    """n-grams of one to three signs, counted one by one."""
    for text in ("Ab, cd!", "été\n12 ñ", "x", "a b", "\U00010400z"):
        s = " " + "".join(c if c.isalpha() or ord(c) >= 0x10000 else " " for c in text.lower()) + " "
        s = [ord(c) for c in re.sub(" +", " ", s)]
        want = np.zeros(langid.SIZE, int)
        m, low = [int(x) for x in langid._MULTIPLIERS], 0xFFFFFFFF
        for i in range(len(s)):
            one = s[i] * m[0] & low
            grams = [one]
            if i + 1 < len(s):
                grams.append(one ^ (s[i + 1] * m[1] + 1 & low))
            if i + 2 < len(s):
                grams.append((grams[1] * 31 & low) ^ (s[i + 2] * m[2] + 2 & low))
            for g in grams:
                want[(g * m[0] & low) >> (32 - langid.BITS)] += 1
        assert (langid.counts(text) == want).all()
    assert langid.counts("12, 3") is None


def test_follow_the_leader_by_definition():
    """Coordinate by coordinate, as the update is written."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(60)]
    target = rng.integers(0, 3, 60)
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= langid.L1:
            return 0.0
        return -(z[k] - math.copysign(langid.L1, z[k])) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(60):
            features = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), (langid.SIZE, 1.0)]
            score = [sum(v * weight((f, c)) for f, v in features) for c in range(3)]
            exp = [math.exp(x - max(score)) for x in score]
            step = {}
            for c in range(3):
                for f, v in features:
                    g = v * (exp[c] / sum(exp) - (c == target[i]))
                    before = n.get((f, c), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA
                    step[f, c] = z.get((f, c), 0.0) + g - sigma * weight((f, c)), before + g * g
            for k, (new_z, new_n) in step.items():
                z[k], n[k] = new_z, new_n
    weights, intercept = langid.follow_the_leader(rows, target, 3)
    want = np.array([[weight((f, c)) for c in range(3)] for f in range(40)])
    assert np.allclose(weights[:40], want) and np.allclose(intercept, [weight((langid.SIZE, c)) for c in range(3)]) and not weights[40:].any()
