"""A causal self-attention language model in numpy over subword ids.

A text is its words, each with a space before it, cut by a public byte-level vocabulary, then one end. The
``KNOWN`` most frequent ids of the training words are the model's own; the rest share one class, inside which
an id has its smoothed share. Keys, queries and values are read by id from a table per head; scores get a bias by
distance; the heads' sums and the last id's own vector give the hidden vector. The output has two levels, a
cluster and an id inside it, with a direct term for the last id: the smoothed transitions of all training words,
counted from the table of their counts, which covers the whole corpus and grows with it.

Texts are scored in windows of ``KEYS`` ids of which the last ``SCORED`` are predicted; a window begins where
the one before predicted first, so that each token is predicted once and sees at least ``KEYS - SCORED`` before it.

Gradients come from all training documents: each task goes on from the same start over its own texts, and the
parameters are averaged, weighted by windows. Some texts on the driver only set where all of them start.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np

KNOWN = 1021
BOS, END, RARE = 0, 1, 2
FIRST = 3
SIZE = FIRST + KNOWN
CLUSTERS = 32
WITHIN = SIZE // CLUSTERS
HEADS, WIDTH, HIDDEN = 2, 16, 32
KEYS, SCORED = 32, 16
LOG10 = float(np.log(10))

Params = dict[str, np.ndarray]


class Subwords:
    """Words, as UTF-8 bytes, to ids of the vocabulary, each with a space before it; bytes that are no UTF-8 count as replacement characters."""

    TOGETHER = 4096

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.n_ids = max(table.values()) + 1
        self._begins = np.zeros(self.n_ids, bool)
        self._begins[[i for t, i in table.items() if t[:1] == b" "]] = True

    def ids(self, word: bytes) -> list[int]:
        return self._encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begins) of all words in turn. Words have no space inside, so an id with a space at its head begins one; they are cut together."""
        parts = []
        for at in range(0, len(words), self.TOGETHER):
            some = words[at : at + self.TOGETHER]
            ids = np.array(self._encoding.encode_ordinary(" " + b" ".join(some).decode("utf-8", "replace")), np.int64)
            begins = self._begins[ids]
            if np.count_nonzero(begins) != len(some):  # a rule that joins words
                each = [self.ids(w) for w in some]
                ids = np.array([i for x in each for i in x], np.int64)
                begins = np.zeros(len(ids), bool)
                begins[np.cumsum([0, *map(len, each[:-1])])] = True
            parts.append((ids, begins))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def vocabulary(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each id its class, and the log share of an id inside the rare class (0 for ids of their own)."""
    order = np.argsort(-counts, kind="stable")[:KNOWN]
    order = order[counts[order] > 0]
    cls = np.full(len(counts), RARE, np.uint16)
    cls[order] = FIRST + np.arange(len(order), dtype=np.uint16)
    rare = cls == RARE
    share = np.zeros(len(counts))
    share[rare] = np.log((counts[rare] + 0.5) / (counts[rare].sum() + 0.5 * rare.sum()))
    return cls, share


def transitions(moves: np.ndarray, first: np.ndarray, last: np.ndarray, n_texts: float) -> np.ndarray:
    """Smoothed P(next | id). moves: counts inside words; first, last: counts of words that begin, end with a class; n_texts: number of ends.

    After a word's last id comes a word's first id or the end, whichever word it was.
    """
    begin = first.astype(np.float64).copy()
    begin[END] += n_texts
    begin = (begin + 0.01) / (begin.sum() + 0.01 * SIZE)
    table = moves + np.outer(last, begin)
    table[BOS] = begin * (first.sum() + n_texts)
    overall = table.sum(0) + 0.5
    overall /= overall.sum()
    table += 2.0 * overall
    return table / table.sum(1, keepdims=True)


def clusters(table: np.ndarray) -> np.ndarray:
    """A balanced clustering of the classes by what they follow: halves along the main direction, again and again. Returns the class order."""
    x = np.sqrt(table / np.sqrt((table**2).sum(0, keepdims=True) + 1e-12)).T
    groups = [np.arange(SIZE)]
    while len(groups) < CLUSTERS:
        nxt = []
        for g in groups:
            z = x[g] - x[g].mean(0)
            v = np.ones(z.shape[1]) / z.shape[1]
            for _ in range(12):
                v = z.T @ (z @ v) + 1e-9
                v /= np.linalg.norm(v)
            o = g[np.argsort(z @ v, kind="stable")]
            nxt += [o[: len(o) // 2], o[len(o) // 2 :]]
        groups = nxt
    return np.concatenate(groups)


def start(table: np.ndarray, seed: int = 3) -> tuple[Params, dict[str, np.ndarray]]:
    """Trainable parameters, and what is fixed: the place of each class (cluster, place inside) and the direct terms.

    ``asks`` has a class's queries of all heads side by side, ``keys`` its keys of all heads and then its values.
    """
    order = clusters(table)
    place = np.empty(SIZE, np.int64)
    place[order] = np.arange(SIZE)
    by_place = table[:, order].reshape(SIZE, CLUSTERS, WITHIN)
    whole = by_place.sum(2)
    fixed = {"place": place, "inside": np.log(by_place / whole[:, :, None]).astype(np.float32).reshape(SIZE * CLUSTERS, WITHIN)}
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    distance = np.zeros((HEADS, KEYS), np.float32)
    distance[0] = -0.7 * np.arange(KEYS)
    p: Params = {"bias": distance, "own": small(SIZE, HIDDEN), "mix": small(HEADS * WIDTH, HIDDEN), "up": np.log(whole).astype(np.float32), "cluster": small(HIDDEN, CLUSTERS), "inside": small(CLUSTERS, HIDDEN, WITHIN)}
    q, k, v = zip(*[[small(SIZE, WIDTH) * 2 for _ in "qkv"] for _ in range(HEADS)])
    return p | {"asks": np.concatenate(q, 1), "keys": np.concatenate(k + v, 1)}, fixed


_QUERY, _KEY = np.arange(KEYS - SCORED, KEYS)[:, None], np.arange(KEYS)[None, :]
_AWAY = np.clip(_QUERY - _KEY, 0, None)
_HIDDEN_KEYS = _KEY > _QUERY
_ONES = np.ones((KEYS, 1), np.float32)
_ONE_EACH = np.ones(max(CLUSTERS, WITHIN), np.float32)


def windows(texts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, text) of all windows of class sequences, each ended here; targets past the end are -1."""
    texts = list(texts)
    if not texts:
        return np.zeros((0, KEYS), np.int16), np.zeros((0, SCORED), np.int64), np.zeros(0, np.int64)
    n = np.array([len(t) + 1 for t in texts])
    k = -(-n // SCORED)
    lead = KEYS - SCORED + 1
    sizes = lead + k * SCORED
    at = np.concatenate(([0], np.cumsum(sizes)))
    line = np.full(at[-1] + 1, -1, np.int16)
    for t, a in zip(texts, at[:-1].tolist()):
        line[a : a + lead] = BOS
        line[a + lead : a + lead + len(t)] = t
        line[a + lead + len(t)] = END
    text = np.repeat(np.arange(len(texts)), k)
    first = np.repeat(np.cumsum(k) - k, k)
    begin = at[text] + (np.arange(len(text)) - first) * SCORED
    grid = np.lib.stride_tricks.sliding_window_view(line, KEYS + 1)[begin]
    return np.maximum(grid[:, :KEYS], 0), grid[:, KEYS - SCORED + 1 :].astype(np.int64), text


def distances(p: Params) -> np.ndarray:
    """The heads' terms by distance, at most 40 each, with the future left out."""
    return np.stack([np.where(_HIDDEN_KEYS, np.float32(-1e9), np.minimum(p["bias"][h], 40)[_AWAY]).astype(np.float32) for h in range(HEADS)])


def _at_most(z: np.ndarray, most: float) -> np.ndarray:
    """``z``, in place; what is above ``most`` counts as that. It seldom is."""
    return np.minimum(z, most, out=z) if z.max(initial=0) > most else z


def _attend(p: Params, h: int, x: np.ndarray, lasts: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a head by window: queries, keys, values and weights; by place: the weights' totals and the weighted means of values."""
    of = slice(h * WIDTH, (h + 1) * WIDTH)
    q, k, v = p["asks"][:, of].take(lasts, 0), p["keys"][:, of].take(x, 0), p["keys"][:, HEADS * WIDTH :][:, of].take(x, 0)
    w = _at_most(q @ k.swapaxes(1, 2), 40)
    w += bias[h]
    total = np.exp(w, out=w).reshape(-1, KEYS) @ _ONES
    total += np.float32(1e-30)
    o = (w @ v).reshape(-1, WIDTH)
    o /= total
    return q, k, v, w, total, o


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logits are logarithms of shares plus a bounded term; 60 is far above what they reach."""
    found = np.minimum(z[np.arange(len(z)), at], 60)
    return found - np.log(np.exp(_at_most(z, 60), out=z) @ _ONE_EACH[: z.shape[1]] + np.float32(1e-30))


def log_probs(p: Params, fixed: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each target (0 where there is none), shaped like ``y``. ``bias``: ``distances(p)``, if it is at hand."""
    bias = distances(p) if bias is None else bias
    x = x.astype(np.int64)
    lasts = np.ascontiguousarray(x[:, KEYS - SCORED :])
    u = p["own"].take(lasts.ravel(), 0)
    for h in range(HEADS):
        u += _attend(p, h, x, lasts, bias)[-1] @ p["mix"][h * WIDTH : (h + 1) * WIDTH]
    np.maximum(u, 0, out=u)
    to, last = y.ravel(), lasts.ravel()
    use = np.flatnonzero(to >= 0)
    # the rows of a cluster side by side
    order = use[np.argsort(fixed["place"][to[use]].astype(np.int16), kind="stable")]
    place, last = fixed["place"][to[order]], last[order]
    c, i = place // WITHIN, place % WITHIN
    ends = np.searchsorted(c, np.arange(CLUSTERS + 1))
    u = u.take(order, 0)
    z = u @ p["cluster"]
    z += p["up"].take(last, 0)
    found = _log_softmax_at(z, c)
    for k in range(CLUSTERS):
        np.matmul(u[ends[k] : ends[k + 1]], p["inside"][k], out=z[ends[k] : ends[k + 1]])
    z += fixed["inside"].take(last * CLUSTERS + c, 0)
    found += _log_softmax_at(z, i)
    out = np.zeros(y.size)
    out[order] = found
    return out.reshape(y.shape)


def _scatter(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows by class, columns two by two: sums of complex numbers take half the calls."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    s = at[order]
    edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    out = np.zeros((n, values.shape[1]), values.dtype)
    out[s[edge]] = np.add.reduceat(values.take(order, 0).view(np.result_type(values, np.complex64)), edge, axis=0).view(values.dtype)
    return out


def _shares(z: np.ndarray, at: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Summed negative log share of the entries ``at``, and the gradient by the logits of the mean over ``n``."""
    total = np.exp(_at_most(z, 60), out=z) @ _ONE_EACH[: z.shape[1]] + np.float32(1e-30)
    rows = np.arange(len(z))
    loss = -float(np.log(z[rows, at] / total + np.float32(1e-30)).sum(dtype=np.float64))
    z *= (np.float32(1 / n) / total)[:, None]
    z[rows, at] -= np.float32(1 / n)
    return loss, z


def gradients(p: Params, fixed: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean negative log probability per target and its gradient."""
    x = x.astype(np.int64)
    to, lasts = y.ravel(), np.ascontiguousarray(x[:, KEYS - SCORED :])
    use = np.flatnonzero(to >= 0)
    n = max(1, len(use))
    bias = distances(p)
    heads = [_attend(p, h, x, lasts, bias) for h in range(HEADS)]
    o = np.concatenate([a[-1] for a in heads], 1)
    # the rows of a cluster side by side
    order = use[np.argsort(fixed["place"][to[use]].astype(np.int16), kind="stable")]
    place, last = fixed["place"][to[order]], lasts.ravel()[order]
    c, i = place // WITHIN, place % WITHIN
    ends = np.searchsorted(c, np.arange(CLUSTERS + 1)).tolist()
    u = (o @ p["mix"]).take(order, 0)
    u += p["own"].take(last, 0)
    np.maximum(u, 0, out=u)
    e = u @ p["cluster"]
    e += p["up"].take(last, 0)
    loss, e = _shares(e, c, n)
    g: Params = {"cluster": u.T @ e, "inside": np.zeros_like(p["inside"])}
    parts = [(j, slice(ends[j], ends[j + 1])) for j in range(CLUSTERS) if ends[j] < ends[j + 1]]
    z = np.empty((len(order), WITHIN), u.dtype)
    for j, r in parts:
        np.matmul(u[r], p["inside"][j], out=z[r])
    z += fixed["inside"].take(last * CLUSTERS + c, 0)
    more, z = _shares(z, i, n)
    du = np.empty_like(u)
    for j, r in parts:
        np.matmul(u[r].T, z[r], out=g["inside"][j])
        np.matmul(z[r], p["inside"][j].T, out=du[r])
    du += e @ p["cluster"].T
    du *= u > 0
    # what goes to a last id's own vector, to its shares of clusters and to its queries; and to a key and its value
    full, ups = np.zeros((y.size, HIDDEN), u.dtype), np.zeros((y.size, CLUSTERS), u.dtype)
    full[order], ups[order] = du, e
    g["mix"], g["bias"] = o.T @ full, np.zeros_like(p["bias"])
    asked, keys, values = [], [], []
    for h, (q, k, v, w, total, o) in enumerate(heads):
        d = full @ p["mix"][h * WIDTH : (h + 1) * WIDTH].T
        d /= total
        meant = (d * o) @ _ONE_EACH[:WIDTH]
        d = d.reshape(len(x), SCORED, WIDTH)
        values.append((w.swapaxes(1, 2) @ d).reshape(-1, WIDTH))
        ds = d @ v.swapaxes(1, 2)
        ds -= meant.reshape(len(x), SCORED, 1)
        ds *= w
        keys.append((ds.swapaxes(1, 2) @ q).reshape(-1, WIDTH))
        asked.append((ds @ k).reshape(-1, WIDTH))
        sums = np.ones(len(x), ds.dtype) @ ds.reshape(len(x), -1)
        g["bias"][h] = np.bincount(_AWAY.ravel(), sums * ~_HIDDEN_KEYS.ravel(), KEYS)
    by_key, by_last = np.concatenate(keys + values, 1), np.concatenate([full, ups, *asked], 1)
    g["keys"] = _scatter(SIZE, x.ravel(), by_key)
    lines = _scatter(SIZE, lasts.ravel(), by_last)
    g["own"], g["up"], g["asks"] = lines[:, :HIDDEN], lines[:, HIDDEN : HIDDEN + CLUSTERS], lines[:, HIDDEN + CLUSTERS :]
    return (loss + more) / n, g


def train(p: Params, fixed: dict[str, np.ndarray], texts: list[np.ndarray], steps: int, rate: float, batch: int = 256, seed: int = 5) -> tuple[Params, float]:
    """Adam with a falling rate over shuffled windows; returns new parameters and the last steps' mean loss."""
    x, y, _ = windows(texts)
    if not len(x) or not steps:
        return {k: v.copy() for k, v in p.items()}, float("nan")
    rng = np.random.default_rng(seed)
    order, losses = np.empty(0, np.int64), []
    at = flat(p)
    p = views(at, p)
    m, s, t, d = np.zeros((4, at.size), np.float32)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(x))])
        pick, order = order[:batch], order[batch:]
        loss, g = gradients(p, fixed, x[pick], y[pick])
        losses.append(loss)
        now = rate * min(1.0, step / 20) * (1 - step / (steps + 1))
        for k, v in views(d, p).items():
            v[...] = g[k]
        # m and s are ten and a hundred times the means, which the factors at the end make up for
        m *= 0.9
        m += d
        s *= 0.99
        s += np.multiply(d, d, out=d)
        half = ((1 - 0.99**step) / 0.01) ** 0.5
        np.divide(m, np.add(np.sqrt(s, out=t), 1e-8 * half, out=t), out=t)
        at -= np.multiply(t, now * half * 0.1 / (1 - 0.9**step), out=t)
    return p, float(np.mean(losses[-20:]))


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def views(v: np.ndarray, like: Params) -> Params:
    """The parameters that lie in ``v``, not copied."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def unflat(v: np.ndarray, like: Params) -> Params:
    return views(v.astype(np.float32), like)


def text_scores(p: Params, fixed: dict[str, np.ndarray], texts: list[np.ndarray], batch: int = 512) -> np.ndarray:
    """Natural log probability of each class sequence with its end; windows of many texts share a batch."""
    x, y, text = windows(texts)
    by_window, bias = np.zeros(len(x)), distances(p)
    for at in range(0, len(x), batch):
        part = slice(at, at + batch)
        by_window[part] = log_probs(p, fixed, x[part], y[part], bias).sum(1)
    return np.bincount(text, by_window, len(texts))


def chunked(items: Iterable, most: int, size) -> Iterator[list]:
    """Items in groups of about ``most`` in size."""
    group, n = [], 0
    for x in items:
        group.append(x)
        n += size(x)
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group
