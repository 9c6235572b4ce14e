"""Linear-chain conditional random field over two tags, for many texts at once.

All words of a batch form one chain in which the first word of a text forgets what came before.  Products of the
2 x 2 step matrices are taken lane by lane, so that a batch of n words costs about 2 sqrt(n) vector operations.
"""

from __future__ import annotations

import numpy as np


def _steps(score: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> list[list[np.ndarray]]:
    """The step matrices as four arrays m[a][b]: from tag a to tag b."""
    push = np.exp(np.clip(score, -30, 30))
    return [[np.where(first, start[b], trans[a, b]) * (push if b else 1.0) for b in (0, 1)] for a in (0, 1)]


def marginals(score: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Probability of tag 1 for each word, by forward and backward passes; with `pairs`, also the joint
    probabilities [a][b] of the tags before and at each word (zero at first words).

    `score`: log weight of tag 1 against tag 0 for each word; `start` and `trans`: weights of first tags and of steps.
    """
    n = len(score)
    if not n:
        return (np.zeros(0), np.zeros((2, 2, 0))) if pairs else np.zeros(0)
    lanes = int(np.ceil(np.sqrt(n)))
    steps = -(-n // lanes)
    pad = lanes * steps - n
    m = [[np.ascontiguousarray(np.concatenate([x, np.full(pad, float(a == b))]).reshape(lanes, steps).T) for b, x in enumerate(row)] for a, row in enumerate(_steps(score, first, start, trans))]
    # the product of each lane's matrices
    p = [[np.ones(lanes), np.zeros(lanes)], [np.zeros(lanes), np.ones(lanes)]]
    for k in range(steps):
        p = [[p[a][0] * m[0][b][k] + p[a][1] * m[1][b][k] for b in (0, 1)] for a in (0, 1)]
        total = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        p = [[x / total for x in row] for row in p]
    # what comes into each lane from the left, and from the right
    left, right = np.empty((lanes, 2)), np.empty((lanes, 2))
    rows = np.array(p).transpose(2, 0, 1).tolist()
    x, y = 0.5, 0.5
    for k, ((a, b), (c, d)) in enumerate(rows):
        left[k] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(lanes - 1, -1, -1):
        right[k] = x, y
        (a, b), (c, d) = rows[k]
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    ahead, behind = np.empty((2, steps, lanes)), np.empty((2, steps, lanes))
    u, v = left[:, 0], left[:, 1]
    for k in range(steps):
        u, v = u * m[0][0][k] + v * m[1][0][k], u * m[0][1][k] + v * m[1][1][k]
        total = u + v
        u, v = u / total, v / total
        ahead[0, k], ahead[1, k] = u, v
    u, v = right[:, 0], right[:, 1]
    for k in range(steps - 1, -1, -1):
        behind[0, k], behind[1, k] = u, v
        u, v = m[0][0][k] * u + m[0][1][k] * v, m[1][0][k] * u + m[1][1][k] * v
        total = u + v
        u, v = u / total, v / total
    flat = lambda x: x.T.reshape(-1)[:n]
    a0, a1, b0, b1 = flat(ahead[0]), flat(ahead[1]), flat(behind[0]), flat(behind[1])
    one = a1 * b1 / (a0 * b0 + a1 * b1)
    if not pairs:
        return one
    before = np.array([np.concatenate([[0.5], a0[:-1]]), np.concatenate([[0.5], a1[:-1]])])
    joint = np.array([[before[a] * flat(m[a][b]) * (b1 if b else b0) for b in (0, 1)] for a in (0, 1)])
    joint /= joint.sum((0, 1))
    return one, np.where(first, 0.0, joint)


def fit(features: np.ndarray, tags: np.ndarray, first: np.ndarray, dims: int, rounds: int = 40, rate: float = 0.4, penalty: float = 1e-7) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights of features, bias, start and step weights of greatest likelihood, by Adagrad on the whole sample.

    `features`: numbers of the features of each word, one row a word; `tags`: 0 or 1 for each word.
    """
    n = len(tags)
    w, bias = np.zeros(dims), -3.0
    start, trans = np.zeros(2), np.zeros((2, 2))
    seen = [np.full(s, 1e-10) for s in (dims, (), 2, (2, 2))]
    steps = np.zeros((2, 2))
    np.add.at(steps, (tags[:-1][~first[1:]], tags[1:][~first[1:]]), 1)
    begun = np.bincount(tags[first], minlength=2).astype(float)
    for _ in range(rounds):
        score = w[features].sum(1) + bias
        one, joint = marginals(score, first, np.exp(start), np.exp(trans), pairs=True)
        slope = (one - tags) / n
        grads = [
            np.bincount(features.reshape(-1), np.repeat(slope, features.shape[1]), dims) + penalty * w, slope.sum(),
            (np.array([(1 - one[first]).sum(), one[first].sum()]) - begun) / n, (joint.sum(2) - steps) / n]
        for s, g in zip(seen, grads):
            s += g * g
        w -= rate * grads[0] / np.sqrt(seen[0])
        bias -= rate * grads[1] / np.sqrt(seen[1])
        start -= rate * grads[2] / np.sqrt(seen[2])
        trans -= rate * grads[3] / np.sqrt(seen[3])
    return w, float(bias), np.exp(start), np.exp(trans)
