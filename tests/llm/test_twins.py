"""Vectorised code against plain twins: jump hashing, the decoders, blocks of odd pages, the parse."""

import itertools
import random

import numpy as np
import pytest

from layerflow.llm import fingerprints, quality
from layerflow.llm.blocks import leaf_blocks, text_features
from layerflow.llm.extraction import Field, default_field
from layerflow.llm.language import SWITCH, viterbi
from layerflow.llm.sharding import jump


def scalar_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop():
    rng = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(500)]
    for shards in (1, 2, 8, 9, 1000):
        assert jump(np.array(keys, dtype=np.int64), shards).tolist() == [scalar_jump(k, shards) for k in keys]


def test_language_path_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(60):
        scores = rng.normal(size=(6, 3)) * SWITCH / 2

        def worth(path):
            return sum(scores[i, p] for i, p in enumerate(path)) - SWITCH * sum(a != b for a, b in zip(path, path[1:]))

        best = max(map(worth, itertools.product(range(3), repeat=6)))
        assert worth(viterbi(scores).tolist()) == pytest.approx(best)


def test_field_path_is_the_best_of_all():
    rng = random.Random(3)
    tags = ["h1", "p", "li", "a", "aside", "div class=ad"]
    for _ in range(40):
        page = "".join(f"<{t}>{'w ' * rng.randint(1, 9)}{k}.</{t.split()[0]}>" for k, t in enumerate(rng.choice(tags) for _ in range(7)))
        weights = {}
        for block in leaf_blocks(page, lambda *_: 0.0, 0.0):
            weights |= {f: rng.uniform(-2, 2) for f in text_features(block)}
        field = Field(weights, [rng.uniform(-1, 1) for _ in range(2)], [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
        blocks = list(leaf_blocks(page, field.weigh, 0.0))

        def worth(path):
            own = [b.above + sum(weights.get(f, 0.0) for f in text_features(b)) for b in blocks]
            steps = sum(field.step[a][b] for a, b in zip(path, path[1:]))
            return field.start[path[0]] + steps + sum(o for o, p in zip(own, path) if p)

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=worth)
        assert field.main_text(page) == " ".join(b.text for b, p in zip(blocks, best) if p)


def texts(page):
    return [b.text for b in leaf_blocks(page, lambda *_: 0.0, 0.0)]


def test_open_and_nested_elements_lose_no_text():
    for name in ("noscript", "canvas", "object", "math", "audio", "svg", "template"):
        assert texts(f"<p>One.</p><{name}><p>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert texts("<p>By <math><mi>E</mi>=<mi>m</mi></math> it <object>falls back</object>.</p>") == ["By E=m it falls back."]
    assert texts("<p>a<svg><svg><text>in</text></svg><text>out</text></svg>b</p>") == ["ab"]
    assert texts("<p>a<svg/>b<template>x<template>y</template>z</template>c</p>") == ["abc"]
    # scripts last to their end tag or the page's end, also with a slash in the start tag
    assert texts("<p>a<script/>var x;</script>b<style>p{}") == ["ab"]
    assert texts("<svg>" * 3000 + "<p>end") == ["end"]


def test_digits_are_counted_over_the_whole_block():
    [block] = leaf_blocks("<p>" + "1234 " * 60 + "word " * 400, lambda *_: 0.0, 0.0)
    assert "digits" not in text_features(block)
    [block] = leaf_blocks("<p>" + "word " * 60 + "1234 " * 400, lambda *_: 0.0, 0.0)
    assert "digits" in text_features(block)


def test_long_pages_stay_linear():
    page = "<div>" * 2000 + "<p>A sentence stands here, and it is long enough.</p>" * 5000
    assert isinstance(default_field().main_text(page), str)


def test_calibration_does_not_hang_on_the_bound():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(1, 1, 4000), rng.normal(-1, 1, 1000)])
    y = np.concatenate([np.ones(4000), np.zeros(1000)])
    whole = quality._logistic(x, y, np.ones(len(x)))
    few = np.concatenate([np.arange(800), 4000 + np.arange(800)])
    weight = np.where(y[few] == 1, 4000 / 800, 1000 / 800)
    bound = quality._logistic(x[few], y[few], weight / weight.mean())
    assert bound == pytest.approx(whole, abs=0.2)
    share = lambda m: float(np.mean(1 / (1 + np.exp(-(m[0] * x + m[1])))))
    assert share(whole) == pytest.approx(0.8, abs=0.01) and share(bound) == pytest.approx(0.8, abs=0.02)


FULL = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & FULL
    return x ^ (x >> 31)


def tossed(names):
    """For each name twice the lowest place where it differs from the one before, and its bit there."""
    out = [names[0] & 1]
    for before, own in zip(names, names[1:]):
        place = 0
        while (before >> place) & 1 == (own >> place) & 1:
            place += 1
        out.append(2 * place + ((own >> place) & 1))
    return out


def parsed(text):
    """All phrase names of one text that count, one name at a time."""
    names, level, out = [ord(c) for c in text], 0, []
    while names:
        runs = []
        for name in names:
            if runs and runs[-1][0] == name:
                runs[-1][1] += 1
            else:
                runs.append([name, 1])
        names = [mixed((name + n * GOLDEN) & FULL) if n > 1 else name for name, n in runs]
        labels = tossed(tossed(tossed(names)))
        phrases, last = [], len(names) - 1
        for i, name in enumerate(names):
            if i == 0 or (i < last and labels[i - 1] < labels[i] > labels[i + 1]):
                phrases.append([])
            phrases[-1].append(name)
        names = [mixed((sum(mixed((i * GOLDEN & FULL) ^ name) for i, name in enumerate(p)) + level + 1) & FULL) for p in phrases]
        level += 1
        if level >= fingerprints.LOWEST or len(names) == 1:
            out += names
        if len(names) == 1:
            break
    return out


def test_parse_by_coin_tossing_against_one_name_at_a_time():
    rng = random.Random(12)
    texts = ["a", "ab", "aaaa", "", "aab" * 40, "é😀\n" * 3, "x" * 3_000, "abababab" * 30]
    texts += ["".join(rng.choice("abc \U0001F600é") for _ in range(rng.randint(1, 1_500))) for _ in range(60)]
    found = [[] for _ in texts]
    for docs, names in fingerprints.phrases(texts):
        for doc, name in zip(docs.tolist(), names.tolist()):
            found[doc].append(name)
    for text, names in zip(texts, found):
        assert sorted(names) == sorted(parsed(text))
    orders = [mixed(k * GOLDEN & FULL) | 1 for k in range(1, fingerprints.VALUES + 1)]
    for text, printed in zip(texts, fingerprints.fingerprint_texts(texts)):
        names = parsed(text)
        assert printed == ("".join(f"{mixed(min(n * o & FULL for n in names)) >> 48:04x}" for o in orders) if text else "")


def test_equal_passages_share_phrases_whatever_their_offset():
    rng = random.Random(13)
    prose = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage = prose(4_000)
    own = set(parsed(passage))
    for offset in (1, 2, 3, 57, 1_001):
        inside = set(parsed(prose(offset) + passage + prose(300)))
        assert len(own & inside) > 0.95 * len(own)
