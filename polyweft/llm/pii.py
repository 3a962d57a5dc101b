"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The rules are fixed forms; what they find always stays. The model adds spans: it is trained on generated lines
with labelled spans, among them forms that the rules leave out (national telephone numbers, cards cut by dots)
and numbers that are no personal data. A text is cut into overlapping windows. No kind exists without a digit
or an @, so windows without either are unlabelled by definition and are not run. The label scores of overlapping
windows are averaged and each stretch of covered characters is decoded as a whole, so that a span may cross
windows. A span that the model adds must pass the exact check of its kind and touch no span of the rules.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# fixed values: the forms of the rules; digit runs are entered at their first digit, where a match starts if there is one
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[int, int, str]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def _ip_ok(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in s.split(".")))


def _phone_ok(s: str) -> bool:
    return 10 <= len(_digits(s)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """The leftmost matches, found from their @: the run of local characters before it, no further than the last match."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by start, then kind as listed."""
    if not _TRIGGER.search(text):
        return []
    out = list(_emails(text))
    for kind, form, ok in (("ip", _IP, _ip_ok), ("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok)):
        out += [(m.start(), m.end(), kind) for m in form.finditer(text) if ok(m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the model

WINDOW, STRIDE, HIDDEN = 64, 32, 12
#: Labels: 0 none; 1 + 2k the first character of kind k, 2 + 2k a further one.
LABELS = 1 + 2 * len(KINDS)
SYMBOLS = 100
STEPS, BATCH, LENGTH, RATE, SEED = 320, 48, 56, 0.03, 11


def symbols(text: str) -> np.ndarray:
    """Code points as input symbols: ASCII by itself, other letters one, the rest one, white space one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((c >= 33) & (c < 127), c - 30, np.where(c <= 32, 2, np.where(c >= 0xC0, 98, 99)))
    return out.astype(np.int64)


def _word(rng: np.random.Generator) -> str:
    parts = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 4)))]
    w = "".join(parts)
    return w.upper() if rng.random() < 0.05 else w.capitalize() if rng.random() < 0.15 else w


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(str(int(x)) for x in rng.integers(0, 10, n))


def _luhn_number(rng: np.random.Generator, n: int) -> str:
    head = _number(rng, n - 1)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _datum(rng: np.random.Generator) -> tuple[str, int]:
    """A form and its kind, -1 for numbers that are no personal data."""
    r = int(rng.integers(0, 14))
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    if r <= 2:
        local = pick([_word(rng).lower(), f"{_word(rng).lower()}.{_number(rng, 2)}", f"{_word(rng).lower()}_{_word(rng).lower()}"])
        return f"{local}@{_word(rng).lower()}{pick(['', _number(rng, 1)])}.{pick(['com', 'org', 'example.com', 'net', 'co.uk'])}", 0
    if r <= 4:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4)), 1
    if r <= 6:
        d = _luhn_number(rng, 16)
        sep = pick(["", "", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4)), 2
    if r <= 9:
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{_number(rng, 2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}"]), 3
    return pick([_number(rng, int(rng.integers(1, 7))), f"{_number(rng, 4)}-{_number(rng, 2)}-{_number(rng, 2)}", f"{_number(rng, 1)}.{_number(rng, 1)}", f"{_number(rng, 2)}:{_number(rng, 2)}", f"{_number(rng, 1)}.{_number(rng, 1)}.{_number(rng, 1)}", f"@{_word(rng).lower()}", f"{_number(rng, 2)}%", f"${_number(rng, 3)}"]), -1


def generated(rng: np.random.Generator, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of words and data with their labels, cut at a random place."""
    x, y = np.empty((n, length), np.int64), np.zeros((n, length), np.int64)
    for i in range(n):
        text, labels = "", []
        while len(text) < 2 * length:
            if rng.random() < 0.35:
                s, kind = _datum(rng)
                labels += [0] * len(s) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
            else:
                s = _word(rng)
                labels += [0] * len(s)
            end = (", ", ". ", " ", " ", " ", "%%% ", "!! ", "\n", ".")[int(rng.integers(0, 9))] if rng.random() < 0.5 else " "
            text += s + end
            labels += [0] * len(end)
        at = int(rng.integers(0, length))
        x[i], y[i] = symbols(text[at : at + length]), labels[at : at + length]
    return x, y


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _run(p: dict, side: str, x: np.ndarray, keep: bool = False):
    """Hidden states of one direction, (time, batch, hidden)."""
    steps = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
    h = c = np.zeros((len(x), HIDDEN), np.float32)
    out = np.empty((x.shape[1], len(x), HIDDEN), np.float32)
    trace = {}
    for t in steps:
        z = p["x" + side][x[:, t]] + h @ p["h" + side]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c_before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            trace[t] = (i, f, o, g, before, c_before, tc)
    return out, trace, steps


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    """Label scores, (time, batch, labels)."""
    return np.concatenate([_run(p, "f", x)[0], _run(p, "b", x)[0]], 2) @ p["out"] + p["bias"]


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis, keepdims=True)
    return np.log(np.exp(z - top).sum(axis)) + top.squeeze(axis)


def _crf(e: np.ndarray, y: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of label paths, with its gradients for scores and transitions."""
    n_t, n_b, _ = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, n_t):
        a[t] = e[t] + _lse(a[t - 1][:, :, None] + moves, 1)
    for t in range(n_t - 2, -1, -1):
        b[t] = _lse(moves + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    de = np.exp(a + b - z[:, None])
    rows = np.arange(n_b)
    total, dm = z.sum(), np.zeros_like(moves)
    for t in range(n_t):
        total -= e[t][rows, y[:, t]].sum()
        de[t][rows, y[:, t]] -= 1
        if t:
            dm += np.exp(a[t - 1][:, :, None] + moves + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
            total -= moves[y[:, t - 1], y[:, t]].sum()
            np.subtract.at(dm, (y[:, t - 1], y[:, t]), 1)
    return float(total) / n_b, de / n_b, dm / n_b


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    sides = {s: _run(p, s, x, keep=True) for s in "fb"}
    h = np.concatenate([sides["f"][0], sides["b"][0]], 2)
    loss, de, dm = _crf(h @ p["out"] + p["bias"], y, p["moves"])
    g = {"moves": dm, "bias": de.sum((0, 1)), "out": np.einsum("tbh,tbl->hl", h, de)}
    dh_all = de @ p["out"].T
    for k, s in enumerate("fb"):
        _, trace, steps = sides[s]
        dx, dw = np.zeros_like(p["x" + s]), np.zeros_like(p["h" + s])
        dh_next = dc = np.zeros((len(x), HIDDEN), np.float32)
        for t in reversed(steps):
            i, f, o, c_in, before, c_before, tc = trace[t]
            dh = dh_all[t][:, k * HIDDEN : (k + 1) * HIDDEN] + dh_next
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * c_in * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c_in * c_in)], 1)
            np.add.at(dx, x[:, t], dz)
            dw += before.T @ dz
            dh_next = dz @ p["h" + s].T
            dc = dc * f
        g |= {"x" + s: dx, "h" + s: dw}
    return loss, g


@functools.cache
def trained(seed: int = SEED, steps: int = STEPS) -> dict[str, np.ndarray]:
    """The parameters; made once in a process, the same on every run."""
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
    p = {"out": small(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32), "moves": np.zeros((LABELS, LABELS), np.float32)}
    for s in "fb":
        p |= {"x" + s: small(SYMBOLS, 4 * HIDDEN), "h" + s: small(HIDDEN, 4 * HIDDEN)}
        p["x" + s][:, HIDDEN : 2 * HIDDEN] += 1
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        _, g = _gradients(p, *generated(rng, BATCH, LENGTH))
        norm = max(1.0, float(np.sqrt(sum((d * d).sum() for d in g.values()))) / 5)
        now = RATE * min(1, step / 10) * (1 - step / (steps + 1))
        for k, d in g.items():
            d = d / norm
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    for k in range(len(KINDS)):  # a further character follows its own kind only
        p["moves"][[j for j in range(LABELS) if j not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e4
    return p


def decoded(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label path of scores (time, labels); a further character cannot come first."""
    n = len(e)
    back = np.empty((n, e.shape[1]), np.int64)
    a = e[0] + np.array([-1e4 if k and k % 2 == 0 else 0 for k in range(e.shape[1])])
    for t in range(1, n):
        z = a[:, None] + moves
        back[t] = z.argmax(0)
        a = e[t] + z.max(0)
    path = np.empty(n, np.int64)
    path[-1] = int(a.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @; every place of the text is in two windows, but for its ends."""
    out: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        out.update((max(0, k - 1) * STRIDE, k * STRIDE))
    return sorted(out)


def model_spans(p: dict, texts: list[str]) -> list[list[Span]]:
    """Per text the labelled spans of the model, before any check."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in _window_starts(t)]
    out: list[list[Span]] = [[] for _ in texts]
    scores: dict[int, dict[int, np.ndarray]] = {}
    for at in range(0, len(jobs), 2048):
        part = jobs[at : at + 2048]
        x = np.zeros((len(part), WINDOW), np.int64)
        for r, (i, s) in enumerate(part):
            piece = symbols(texts[i][s : s + WINDOW])
            x[r, : len(piece)] = piece
        e = emissions(p, x)
        for r, (i, s) in enumerate(part):
            scores.setdefault(i, {})[s] = e[:, r]
    for i, by_start in scores.items():
        n = len(texts[i])
        starts = sorted(by_start)
        groups: list[list[int]] = []
        for s in starts:
            if groups and s <= groups[-1][-1] + STRIDE:
                groups[-1].append(s)
            else:
                groups.append([s])
        for g in groups:
            first, last = g[0], min(n, g[-1] + WINDOW)
            total, seen = np.zeros((last - first, LABELS)), np.zeros((last - first, 1))
            for s in g:
                k = min(WINDOW, n - s)
                total[s - first : s - first + k] += by_start[s][:k]
                seen[s - first : s - first + k] += 1
            path = decoded(total / seen, p["moves"])
            t = 0
            while t < len(path):
                if path[t] % 2:
                    end = t + 1
                    while end < len(path) and path[end] == path[t] + 1:
                        end += 1
                    out[i].append((first + t, first + end, KINDS[path[t] // 2]))
                    t = end
                else:
                    t += 1
    return out


def _checked(text: str, span: Span) -> bool:
    """The exact check of a span that the model adds."""
    s, (start, end, kind) = text[span[0] : span[1]], span
    if kind == "email":
        return s.count("@") == 1 and bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}", s))
    if kind == "ip":
        return bool(_IP.fullmatch(s)) and _ip_ok(s)
    inner = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return inner and (_card_ok(s) if kind == "card" else _phone_ok(s)) and bool(re.fullmatch(r"[+(]?[0-9][\x20().0-9-]*[0-9]", s))


def all_spans(p: dict, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the rules, all spans) of each text."""
    out = []
    for text, found in zip(texts, model_spans(p, texts)):
        base = rule_spans(text)
        more = [s for s in found if _checked(text, s) and all(s[1] <= b[0] or s[0] >= b[1] for b in base)]
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind, in code points) of every row.

    Null and empty texts have no spans. Rows that repeat an id are looked at each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            both = all_spans(sent.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in both], span), pa.array([as_rows(a) for _, a in both], span)], names=["doc_id", "base", "spans"])

    spans = "array<struct<start:int,end:int,kind:string>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span's characters replaced by its kind in brackets; overlapping spans count as the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()
