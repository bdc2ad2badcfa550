"""A linear-chain conditional random field over sparse features: training by gradient ascent, decoding by Viterbi."""

from collections.abc import Sequence

import numpy as np

OUT, BEGIN, IN = 0, 1, 2
LABELS = 3


def train(lines: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[int]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-5) -> dict:
    """Weights by feature name and transitions, from feature lists and labels of each token of each line.

    The likelihood's gradient comes from scaled forward and backward sums over all lines at once; steps are Adam's.
    """
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))  # the longest first, so that the lines that reach a place are the first ones
    lines, labels = [lines[i] for i in order], [labels[i] for i in order]
    names: dict[str, int] = {}
    for line in lines:
        for token in line:
            for f in token:
                names.setdefault(f, len(names))
    most, width = max(map(len, lines)), max(len(t) for line in lines for t in line)
    n, pad = len(lines), len(names)
    ids = np.full((n, most, width), pad, np.int32)
    gold = np.zeros((n, most), np.int64)
    length = np.array([len(x) for x in lines])
    for i, line in enumerate(lines):
        gold[i, : len(line)] = labels[i]
        for k, token in enumerate(line):
            ids[i, k, : len(token)] = [names[f] for f in token]
    mask = (np.arange(most)[None] < length[:, None]).astype(float)
    w, tr = np.zeros((pad + 1, LABELS)), np.zeros((LABELS, LABELS))
    allowed = np.ones((LABELS, LABELS))
    allowed[OUT, IN] = 0
    first = np.array([1.0, 1.0, 0.0])
    alive = [int((length > k).sum()) for k in range(most)]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    onehot = np.eye(LABELS)[gold]
    seen = np.einsum("nki,nkj->ij", onehot[:, :-1] * mask[:, 1:, None], onehot[:, 1:])
    real = np.flatnonzero(mask.reshape(-1))
    # tokens of equal features are scored once
    kinds, own = np.unique(ids.reshape(-1, width)[real], axis=0, return_inverse=True)
    own = own.ravel()
    e = np.zeros((n * most, LABELS))
    for step in range(1, rounds + 1):
        e = e.reshape(-1, LABELS)
        e[real] = w[kinds].sum(axis=1)[own]
        e = e.reshape(n, most, LABELS)
        t = np.exp(tr) * allowed
        w_e = np.exp(e - e.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
        a, b, c = np.zeros((most, n, LABELS)), np.ones((most, n, LABELS)), np.ones((most, n, 1))
        for k in range(most):
            m = alive[k]
            new = (first if k == 0 else a[k - 1, :m] @ t) * w_e[k, :m]
            c[k, :m] = new.sum(axis=1, keepdims=True)
            a[k, :m] = new / c[k, :m]
        for k in range(most - 2, -1, -1):
            m = alive[k + 1]
            b[k, :m] = (w_e[k + 1, :m] * b[k + 1, :m]) @ t.T / c[k + 1, :m]
        p = (a * b).transpose(1, 0, 2) * mask[:, :, None]
        ge = (onehot * mask[:, :, None] - p).reshape(-1, LABELS)
        gw = np.zeros_like(w)
        for y in range(LABELS):
            gw[:, y] = np.bincount(kinds.ravel(), np.repeat(np.bincount(own, ge[real, y], len(kinds)), width), pad + 1)
        ahead = w_e[1:] * b[1:] / c[1:] * mask.T[1:, :, None]
        gt = seen - t * np.einsum("kni,knj->ij", a[:-1], ahead, optimize=True)
        for x, g, m, v in ((w, gw / n - decay * w, *moments[:2]), (tr, gt / n, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[pad] = 0
    return {"w": {f: w[i].tolist() for f, i in names.items()}, "t": np.where(allowed > 0, tr, -1e4).tolist(), "s": np.where(first > 0, 0.0, -1e4).tolist()}


def viterbi(model: dict, line: Sequence[Sequence[str]]) -> list[int]:
    """The likeliest labels of one line's tokens, given their features; unknown features weigh nothing."""
    w, t = model["w"], model["t"]
    best, back = [0.0, -1e9, -1e9], []
    for k, token in enumerate(line):
        e = [0.0, 0.0, 0.0]
        for f in token:
            x = w.get(f)
            if x:
                e[0] += x[0]
                e[1] += x[1]
                e[2] += x[2]
        if k == 0:
            best = [model["s"][y] + e[y] for y in range(LABELS)]
            continue
        new, frm = [], []
        for y in range(LABELS):
            s = [best[x] + t[x][y] for x in range(LABELS)]
            x = s.index(max(s))
            new.append(s[x] + e[y])
            frm.append(x)
        best = new
        back.append(frm)
    if not line:
        return []
    y = best.index(max(best))
    out = [y]
    for frm in reversed(back):
        y = frm[y]
        out.append(y)
    return out[::-1]
