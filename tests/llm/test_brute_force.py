"""Plain versions of what the models and the transform compute, by loops and definitions."""

import math
import random

import numpy as np
import pytest
from codeloom.llm import media, quality, toxicity


def plain_ftrl(examples, y, epochs):
    z, n = {}, {}
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    bias = math.log(share / (1 - share))

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for example, label in zip(examples, y, strict=True):
            p = 1 / (1 + math.exp(-(sum(weight(i) for i in example) + bias)))
            g = (p - label) * (toxicity.TOXIC_WEIGHT if label else 1.0)
            for i in example:
                old = n.get(i, 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * weight(i), old + g * g
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_matches_plain_loops():
    rng = random.Random(5)
    examples, y = [], []
    for k in range(160):
        label = int(k % 4 == 0)
        picked = {rng.randrange(60) for _ in range(8)} | ({rng.choice([900, 901])} if label and rng.random() < 0.8 else {902 + k})
        examples.append(sorted(picked))
        y.append(label)
    want, bias = plain_ftrl(examples, y, 4)
    got = toxicity.fit([np.array(e, np.int32) for e in examples], np.array(y, float), 4)
    assert got.at.tolist() == sorted(want) and want and abs(got.bias - bias) < 1e-12
    assert np.allclose(got.weight, [want[i] for i in sorted(want)])


@pytest.mark.parametrize("known", [False, True])
def test_features_are_words_pairs_skips_and_stems(known):
    text = b"Bad words baddest baddies badly bad, bad"
    offsets = np.array([0, len(text), len(text)])
    data = np.frombuffer(text, np.uint8)
    row, at = toxicity.features(data, offsets)
    said = [w.lower() for w in text.decode().replace(",", "").split()]
    stems = {(n, t) for n in (4, 5, 6, 7) for t in {w[:n] for w in said if len(w) > n}}
    often = {(n, t) for n, t in stems if sum(w.startswith(t) and len(w) > n for w in said) >= 3}
    size = len(set(said)) + len(set(zip(said, said[1:], strict=False))) + len(set(zip(said, said[2:], strict=False))) + len(stems) + len(often)
    assert set(row) == {0} and len(at) == size == len(set(at.tolist()))
    if known:
        some = np.zeros(1 << toxicity.BITS, bool)
        some[at[::3]] = True
        assert toxicity.features(data, offsets, some)[1].tolist() == [a for a in at.tolist() if some[a]]


def plain_trees(x, y, n_trees, depth, bins, rate, l2):
    n, k = x.shape
    positive = (y.sum() + 0.5) / (n + 1)
    margin = [math.log(positive / (1 - positive))] * n
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(k)]
    least, trees = max(2.0, 0.0005 * n), []
    for _ in range(n_trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes, splits = {0: list(range(n))}, {}
        for node in range(2**depth - 1):
            rows = nodes.get(node, [])
            gt, ht = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
            best = (1e-6, None)
            for j in range(k):
                for cut in cuts[j]:
                    left = [i for i in rows if x[i, j] <= cut]
                    if len(left) >= least and len(rows) - len(left) >= least:
                        gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, cut))
            splits[node] = best[1]
            right = [i for i in rows if best[1] and x[i, best[1][0]] > best[1][1]]
            nodes[2 * node + 1], nodes[2 * node + 2] = [i for i in rows if i not in set(right)], right
        leaves = []
        for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
            rows = nodes[node]
            leaves.append(-rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + l2))
            for i in rows:
                margin[i] += leaves[-1]
        trees.append((splits, leaves))
    return trees


def test_boosting_matches_plain_splits():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    got = quality.fit(x, y, n_trees=4, depth=3, bins=8)
    for t, (splits, leaves) in enumerate(plain_trees(x, y, 4, 3, 8, 0.15, 1.0)):
        for node, split in splits.items():
            if split is None:
                assert np.isinf(got.threshold[t, node])
            else:
                assert (got.feature[t, node], got.threshold[t, node]) == split
        assert np.allclose(got.leaf[t], leaves, atol=1e-6)


def plain_landmarks(payload):
    samples = [b - 128 for b in payload]
    size, hop = media.FRAME, media.HOP
    count = 1 if len(samples) <= size else 1 + -(-(len(samples) - size) // hop)
    samples += [0] * (size + hop * (count - 1) - len(samples))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(size)) / size)
    peaks = []
    for k in range(count):
        frame = np.array(samples[hop * k : hop * k + size], float)
        power = np.abs(turn @ ((frame - frame.mean()) * window)) ** 2
        peaks.append(int(power[1:].argmax()) + 1)
    pairs = [(t << 32) | (peaks[t] << 20) | (peaks[t + d] << 8) | d for t in range(count) for d in range(1, media.FAN_OUT + 1) if t + d < count]
    return sorted(pairs) if pairs else [peaks[0] << 20]


def test_landmarks_match_the_definition_for_every_length():
    rng = np.random.default_rng(4)
    for blocks in range(1, 12):
        payload = rng.integers(0, 256, 64 * blocks, np.uint8).tobytes()
        assert media.landmarks(payload).tolist() == plain_landmarks(payload)
