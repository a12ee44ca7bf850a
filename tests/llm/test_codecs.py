"""Tokenizers, token files, WebP and Merkle trees without Spark."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpuslens.llm import bpe, media, merkle, token_files, webp

ODD = [chr(c) for c in [*range(1, 128), 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x301, 0xE9, 0x4E2D, 0x1F600, 0x660, 0xBD, 0x3A3, 0x130, 0x212A, 0x345]] + list(" \n'Σ.,") * 4


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "a" * 3000, "abth" * 300, *("".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n))]


def test_byte_bpe_equals_tiktoken():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, texts = bpe.load(path, public_tokenizers.PATTERN), odd_texts(800)
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    assert codec.encode([None]) == [b""]


def merged_plainly(word, ranks):
    """The definition: the leftmost pair of least rank, one at a time."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_rows_of_every_width_equal_the_definition():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.load(path, public_tokenizers.PATTERN)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rng = random.Random(5)
    sizes = [2, 3, 63, 64, 65, 255, 256, 257, 258, 400, 511, 512, 513, 700, 1024, 1025, 1500]
    words = ["".join(rng.choices("theraniongs", k=k)).encode() for k in sizes * 2] + [b"x" * 300, b"x" * 999, b"abth" * 200, "été".encode() * 150, rng.randbytes(600)]
    for word, ids in zip(words, codec.merge(words)):
        assert np.frombuffer(ids, "<u4").tolist() == merged_plainly(word, ranks)
    assert codec.decode(codec.merge([b"y" * 20_000])[0]) == b"y" * 20_000


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), token_files.load_encoder(path)
    texts = odd_texts(1500) + ["It's so. <|endoftext|> yes, 3.14, ok.", "x?!, y", "İ, "]
    assert encoder.by_word
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_file_gives_single_documents():
    rows = [np.arange(k, dtype="<u4") for k in (1, 500, 70000)]
    for narrow in (rows[:2], rows[2:]):
        packed = [token_files.narrow(r.tobytes()) for r in narrow]
        press = token_files.compressor(b"").compress
        docs = [(i or None, len(r), w, press(b)) for i, (r, (b, w)) in enumerate(zip(narrow, packed))]
        blob = token_files.build(docs, __import__("hashlib").sha256(b"").digest(), 7)
        file = token_files.TokenFile(blob, b"")
        assert len(file) == len(narrow) and file.start == 7
        for k in reversed(range(len(narrow))):
            assert (file.ids(k) == narrow[k]).all()
        with pytest.raises(ValueError):
            token_files.TokenFile(blob, b"other")
        with pytest.raises(ValueError):
            token_files.TokenFile(b"x" * 100, b"")


# A writer of every feature of the format, to hold the decoder against.


def write_image(out, pixels, width, main, cache_bits=0, back=False, meta=None):
    """Entropy-codes ARGB numbers; meta: (bits, groups as a list of ints for the blocks)."""
    pixels = [int(p) for p in pixels]
    tokens, at, cache, shift = [], 0, {}, 32 - cache_bits
    where = lambda i: 0 if meta is None else meta[1][(i // width >> meta[0]) * -(-width >> meta[0]) + (i % width >> meta[0])]
    while at < len(pixels):
        p = pixels[at]
        best = (0, 0)
        if back:
            for gap in {1, 2, width, width + 1, width - 1, 7, 150} - {0}:
                n = 0
                while gap <= at and at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[at + n - gap]:
                    n += 1
                best = max(best, (n, gap))
        slot = (webp.HASH * p & 0xFFFFFFFF) >> shift if cache_bits else None
        if best[0] >= 3:
            tokens.append((where(at), "copy", *best))
            done = best[0]
        elif cache_bits and cache.get(slot) == p:
            tokens.append((where(at), "cache", slot, 0))
            done = 1
        else:
            tokens.append((where(at), "pixel", p, 0))
            done = 1
        for q in pixels[at : at + done] if cache_bits else ():
            cache[(webp.HASH * q & 0xFFFFFFFF) >> shift] = q
        at += done
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(meta is not None), 1)
        if meta:
            out.put(meta[0] - 2, 3)
            write_image(out, [g << 8 for g in meta[1]], -(-width >> meta[0]), False)
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[np.zeros(n, int) for n in sizes] for _ in range(max(meta[1]) + 1 if meta else 1)]

    def codes(gap):
        for k, (x, y) in enumerate(webp.NEAR, 1):
            if max(1, x + y * width) == gap:
                return k
        return gap + 120

    parts = []
    for g, kind, a, b in tokens:
        if kind == "pixel":
            part = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == "cache":
            part = [(0, 280 + a, 0, 0)]
        else:
            x, y = webp.value_prefix(a), webp.value_prefix(codes(b))
            part = [(0, 256 + x[0], x[1], x[2]), (4, y[0], y[1], y[2])]
        parts.append((g, part))
        for which, symbol, _, _ in part:
            groups[g][which][symbol] += 1
    lengths = [[webp.code_lengths(c) for c in g] for g in groups]
    for g in lengths:
        for n in g:
            webp.write_code(out, n if n.any() else np.array([1]))
    canon = [[webp.canonical(n) for n in g] for g in lengths]
    for g, part in parts:
        for which, symbol, extra, bits in part:
            if np.count_nonzero(lengths[g][which]) > 1:
                out.put(int(canon[g][which][symbol]), int(lengths[g][which][symbol]))
            out.put(extra, bits)


def argb(samples):
    return webp.joined(samples[..., [3, 0, 1, 2]].reshape(-1, 4))


def build(samples, transforms=(), seed=0, **how):
    """A WebP file of (height, width, 4) samples through the given transforms."""
    rng = np.random.default_rng(seed)
    height, width, _ = samples.shape
    pixels, out = argb(samples), webp.BitWriter()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    stored = width
    for t in transforms:
        out.put(1, 1)
        out.put(t, 2)
        if t == webp.SUBTRACT_GREEN:
            pixels = webp.green_added(pixels, -1)
        elif t in (webp.PREDICTOR, webp.CROSS_COLOUR):
            block = 2
            n = -(-stored >> block) * -(-height >> block)
            out.put(block - 2, 3)
            if t == webp.PREDICTOR:
                modes = how.get("modes", None) or rng.integers(0, 14, n)
                modes = np.resize(np.asarray(modes), n)
                image = webp.channels(pixels).tolist()
                guess = [webp.predicted(image, i, stored, modes.tolist(), block, -(-stored >> block)) for i in range(len(image))]
                pixels = webp.joined(np.array(image) - np.array(guess))
                write_image(out, modes << 8, -(-stored >> block), False)
            else:
                elements = rng.integers(0, 1 << 24, n) | 0xFF000000
                write_image(out, elements, -(-stored >> block), False)
                pixels = webp.cross_colour(pixels, stored, height, elements, block, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            bits = webp.palette_bits(len(colours))
            out.put(len(colours) - 1, 8)
            write_image(out, webp.joined(np.diff(webp.channels(colours), axis=0, prepend=0)), len(colours), False)
            rows = index.reshape(height, width)
            each = 8 >> bits
            rows = np.pad(rows, ((0, 0), (0, -width % (1 << bits))))
            packed = (rows.reshape(height, -1, 1 << bits) << (np.arange(1 << bits) * each)).sum(2)
            stored = packed.shape[1]
            pixels = packed.ravel() << 8 | 0xFF000000
    out.put(0, 1)
    write_image(out, pixels, stored, True, **{k: v for k, v in how.items() if k != "modes"})
    return webp.riff(out.done())


def picture(height, width, colours=None, seed=1):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (height, width))]
    base = np.cumsum(rng.integers(-3, 4, (height, width, 4)), 1) + 128
    return (base & 255).astype(np.uint8)


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (0, 2), (2, 1, 0), (1, 0)])
@pytest.mark.parametrize("how", [{}, {"back": True}, {"cache_bits": 4}, {"cache_bits": 6, "back": True}])
def test_webp_transforms(transforms, how):
    x = picture(13, 18)
    assert (webp.decode(build(x, transforms, **how)) == x).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_each_predictor(mode):
    x = picture(9, 11, seed=mode)
    assert (webp.decode(build(x, (0,), modes=[mode])) == x).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_webp_palettes(colours):
    x = picture(7, 21, colours)
    assert (webp.decode(build(x, (3,))) == x).all()
    assert (webp.decode(build(x, (3, 0), back=True, cache_bits=3)) == x).all()


def test_webp_meta_prefix_codes():
    x = picture(16, 16, 40)
    assert (webp.decode(build(x, (), meta=(2, [i % 3 for i in range(16)]), back=True)) == x).all()
    assert (webp.decode(build(x, (2,), meta=(3, [0, 1, 1, 0]), cache_bits=5)) == x).all()


@pytest.mark.parametrize("payload", [b" " * 192, bytes(range(192)), b"ab" * 96 * 5, np.random.default_rng(1).bytes(192 * 40), ("été ñ " * 400).encode()[:1920]])
def test_webp_payloads_round_trip(payload):
    stored = webp.store(payload)
    assert webp.load(stored).tobytes() == payload and stored[:4] == b"RIFF"
    assert media.features(webp.load(stored)) == media.features(webp.load(webp.store(payload)))


@pytest.mark.parametrize("transform", ["none", "palette", *webp.TRANSFORMS])
def test_webp_writer_uses_every_feature(transform):
    """Files of each transform, with copies and a cache, read back by the decoder; and a decoder that walks sequentially agrees."""
    rng = np.random.default_rng(4)
    for rows, values in ((1, 3), (5, 2), (9, 40), (40, 256), (700, 7)):
        x = rng.integers(0, values, (rows, webp.WIDTH, 3)).astype(np.uint8)
        x[rows // 2 :] = x[: rows - rows // 2]  # long repeats
        x[: rows // 4] = rng.integers(0, 4, (rows // 4, 1, 1))
        if transform == "palette":
            x = x[..., :1].repeat(3, 2)
        assert (webp.decode(webp.encode_rgb(x, transform))[..., :3] == x).all()


def test_webp_estimate_takes_what_is_cheapest():
    rng = np.random.default_rng(2)
    steps = (np.cumsum(rng.integers(0, 2, (60, 64, 3)), 1) & 255).astype(np.uint8)
    green = (np.repeat(rng.integers(0, 256, (60, 64, 1)), 3, 2) + rng.integers(0, 3, (60, 64, 3))).astype(np.uint8)
    columns = np.tile(rng.integers(0, 256, (1, 64, 3)), (60, 1, 1)).astype(np.uint8) + rng.integers(0, 2, (60, 64, 3)).astype(np.uint8)
    few = rng.integers(0, 256, (5, 3)).astype(np.uint8)[rng.integers(0, 5, (60, 64))]
    for name, x in (("left", steps), ("green", green), ("top", columns), ("palette", few)):
        best = webp.encode_rgb(x)
        assert best == webp.encode_rgb(x, name) and (webp.decode(best)[..., :3] == x).all() and len(best) < len(webp.encode_rgb(x, "none"))
    text = ("It was said that the rain, in the end, would not fall. " * 3 + "Nobody knew. ").encode() * 200
    x = np.frombuffer(text[: len(text) // 192 * 192], np.uint8).reshape(-1, 64, 3)
    assert (webp.decode(webp.encode_rgb(x))[..., :3] == x).all() and len(webp.encode_rgb(x)) < x.size / 20


def test_webp_payload_of_several_images():
    payload = bytes([i % 251 for i in range(192)]) * (webp.MAX_ROWS + 3)
    assert webp.load(webp.store(payload)).tobytes() == payload


def test_webp_rejects_others():
    for bad in (b"", b"RIFF0000WAVE", webp.store(b" " * 192)[:30]):
        with pytest.raises((ValueError, IndexError, __import__("struct").error)):
            webp.decode(bad)


def test_code_lengths_are_bounded_and_complete():
    counts = np.array([1, 1] + [int(1.7**k) for k in range(1, 40)])
    n = webp.code_lengths(counts, 15)
    assert n.max() <= 15 and (2.0 ** -n[n > 0]).sum() == 1


def test_merkle():
    a = "One two three.\nFour five six seven.\n\nEight nine ten eleven twelve."
    t = merkle.tree_of(a)
    assert merkle.tree_of(a).fingerprint() == t.fingerprint() and merkle.differences(t, t) == []
    changed = merkle.tree_of(a.replace("five", "5ive"))
    assert changed.root != t.root and merkle.differences(t, changed) == [(0, 1)]
    assert 0 < merkle.likeness(t, changed) < 1 and merkle.likeness(t, t) == 1
    assert merkle.likeness(merkle.tree_of(""), merkle.tree_of(None)) == 1 and merkle.likeness(t, merkle.tree_of("")) == 0
    roots = {merkle.tree_of(x).root for x in ("", " ", "\n", "\n\n", "a", "a ", "a\n", "\na", "a b", "ab")}
    assert len(roots) == 10
    assert merkle.edited("abcdef", "XY") == "abcXY" and merkle.edited("", "x") == "" and merkle.edited("abc", "xyz") == "abx"


def test_payload_rule():
    assert media.payload_of(None) == b" " * 192 and len(media.payload_of("x" * 192)) == 192 and len(media.payload_of("x" * 193)) == 384
    assert zlib.crc32(media.payload_of("é")[-16:]) == zlib.crc32(b" " * 16)
