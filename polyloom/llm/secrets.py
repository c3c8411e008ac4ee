"""Secret scan: exact rules, and a character convolutional network over every candidate with its context.

Rules (their spans always stay): an assignment to a password-like name, an access key id, a long hexadecimal run. Candidates are the
rules' own keys and all runs of ``LEAST`` or more key-like characters that hold a letter. The network reads ``INSIDE`` characters of the
candidate with ``LEFT`` before and ``RIGHT`` after them; over a longer candidate it moves on by ``STRIDE``:
one convolution, maximum and mean over the candidate and over its context, one hidden layer. A candidate of which it accepts a part becomes a span
of its own unless a rule's span holds it already; of the rules' spans it says how many it confirms.

Labelled findings come from a bounded sample of the documents (``SAMPLE``): the rules' keys, in their own context and in one without a name,
against the other runs of the sample (but for those that a network trained without them takes for keys); and, as real keys are never published, from a seeded generator that writes keys of common forms and
harmless compounds of the sample's own words into contexts cut from the sample. A third of the findings, chosen by a hash of their text, is
held out: on it the curve is fitted and a threshold set for each kind of candidate, the highest that finds ``RECALL`` of its keys.

Defined results: a null or empty text has no spans; an empty table trains on generated findings alone and gives an empty table; a very
long text is scanned whole; rows that repeat give equal results; other columns are left alone, but a column ``secret_spans`` is replaced.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common

KINDS = ("assign", "access", "hex", "net")
# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=.~-]{16,}")
LEAST = 16
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

LEFT, INSIDE, RIGHT = 24, 44, 8
WIDE = LEFT + INSIDE + RIGHT
STRIDE = INSIDE // 2
RECALL = 0.98
#: Documents whose findings and words train the network, findings of each label taken from them, and findings that are generated.
SAMPLE, FOUND, GENERATED = 6000, 1500, 4800
#: Classes of bytes, then those of other bytes, of all that isn't ASCII, and of padding.
_GROUPS = ("0123456789", "ae", "bcdf", "iouy", "ghjklmnpqrstvwxz", "AE", "BCDF", "IOUY", "GHJKLMNPQRSTVWXZ", "=", "-_", "/+", ".", ":", " \t", "\"'`", "\n\r", "@~", "([{<", ")]}>", ",;")
_CLASSES = len(_GROUPS) + 3


def _classes() -> np.ndarray:
    """A class for each byte; the last for padding."""
    out = np.full(257, _CLASSES - 3)
    for i, group in enumerate(_GROUPS):
        for c in group:
            out[ord(c)] = i
    out[128:256] = _CLASSES - 2
    out[256] = _CLASSES - 1
    return out


_CLASS = _classes()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The rules' spans, by start and then in the order of the rules."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs of key-like characters that hold a letter."""
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0].rstrip(".=-_~") if m[0][-1] in ".-_~" else m[0]
        if len(word) >= LEAST and any(map(str.isalpha, word)):
            out.append((m.start(), m.start() + len(word)))
    return out


def key_of(text: str, span: tuple[int, int, str]) -> tuple[int, int]:
    """The part of a rule's span that the network reads: of an assignment its value."""
    a, b, kind = span
    return (b - len(ASSIGN.match(text, a)[2]), b) if kind == "assign" else (a, b)


def window(text: str, a: int, b: int) -> str:
    """The candidate with its context, padded to ``WIDE`` characters; NUL is padding."""
    left, right = text[max(0, a - LEFT) : a], text[b : b + RIGHT]
    return left.rjust(LEFT, "\0") + text[a : min(b, a + INSIDE)].ljust(INSIDE, "\0") + right.ljust(RIGHT, "\0")


def parts(a: int, b: int) -> Iterator[tuple[int, int]]:
    """The parts of a candidate that the network reads: at most ``INSIDE`` characters each, from its start to its end."""
    last = max(a, b - INSIDE)
    for at in range(a, last, STRIDE):
        yield at, at + INSIDE
    yield last, b


def one_hot(windows: list[str]) -> np.ndarray:
    codes = np.array([[_CLASS[min(ord(c), 255)] if c != "\0" else _CLASSES - 1 for c in w] for w in windows], int).reshape(len(windows), WIDE)
    return np.eye(_CLASSES, dtype=np.float32)[codes]


#: Kinds of candidates: without and with digits, both cases, other characters. Held-out keys that a threshold of a kind's own takes.
KINDS_OF_KEY, ENOUGH = 8, 40


def kinds_of_key(windows: list[str]) -> np.ndarray:
    """The kind of what is read of each candidate."""
    out = np.zeros(len(windows), np.int64)
    for i, w in enumerate(windows):
        own = w[LEFT : LEFT + INSIDE].rstrip("\0")
        out[i] = any(map(str.isdigit, own)) + 2 * (own != own.lower() and own != own.upper()) + 4 * (not own.isalnum())
    return out


class Network:
    """x (n, WIDE, classes) -> convolution of ``width`` -> ReLU -> maximum and mean of candidate and left context -> hidden -> logit."""

    width, filters, hidden = 5, 16, 16

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "w": r.normal(0, 0.25, (self.width * _CLASSES, self.filters)),
            "b": np.zeros(self.filters),
            "u": r.normal(0, 0.25, (4 * self.filters, self.hidden)),
            "c": np.zeros(self.hidden),
            "v": r.normal(0, 0.25, self.hidden),
            "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.slope, self.offset, self.thresholds = 1.0, 0.0, np.full(KINDS_OF_KEY, 0.5)

    def forward(self, x: np.ndarray):
        p = self.p
        t = WIDE - self.width + 1
        cols = np.concatenate([x[:, i : i + t] for i in range(self.width)], axis=2)
        z = cols @ p["w"] + p["b"]
        a = np.maximum(z, 0)
        inside, before = slice(LEFT - 2, LEFT + INSIDE - 2), slice(0, LEFT - 2)
        pooled = np.concatenate([a[:, inside].max(1), a[:, inside].mean(1), a[:, before].max(1), a[:, before].mean(1)], axis=1)
        h = np.tanh(pooled @ p["u"] + p["c"])
        return h @ p["v"] + p["d"][0], (cols, z, a, inside, before, pooled, h)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 4e-3) -> None:
        """Adam on the logistic loss."""
        r = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                logit, (cols, z, a, inside, before, pooled, h) = self.forward(x[pick])
                g = (1 / (1 + np.exp(-logit)) - y[pick]) / len(pick)
                dh = g[:, None] * self.p["v"] * (1 - h * h)
                dp = dh @ self.p["u"].T
                da = np.zeros_like(a)
                f = self.filters
                for part, (top, mean) in ((inside, (dp[:, :f], dp[:, f : 2 * f])), (before, (dp[:, 2 * f : 3 * f], dp[:, 3 * f :]))):
                    view = a[:, part]
                    best = view.argmax(1)
                    own = np.repeat((mean / view.shape[1])[:, None], view.shape[1], 1)
                    n, k = np.indices(best.shape)
                    own[n, best, k] += top
                    da[:, part] += own
                dz = da * (z > 0)
                grads = {"w": cols.reshape(-1, cols.shape[2]).T @ dz.reshape(-1, f), "b": dz.sum((0, 1)), "u": pooled.T @ dh, "c": dh.sum(0), "v": h.T @ g, "d": np.array([g.sum()])}
                step += 1
                for k, v in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, windows: list[str], y: np.ndarray, recall: float = RECALL) -> None:
        """A logistic curve over the logits of held-out findings, and for each kind of candidate the highest threshold that finds ``recall`` of its keys (where it has fewer than ``ENOUGH``: all of them, and that of all keys at most)."""
        from polyloom.llm.quality import fit_curve

        logit = self.forward(one_hot(windows))[0].astype(float)
        self.slope, self.offset = fit_curve(logit, y)
        p, kind = self.probability_of(logit), kinds_of_key(windows)
        highest = lambda x: x[int(np.floor((1 - recall) * len(x)))]
        every = highest(np.sort(p[y == 1]))
        for k in range(KINDS_OF_KEY):
            own = np.sort(p[(y == 1) & (kind == k)])
            self.thresholds[k] = highest(own) if len(own) >= ENOUGH else min([every, *own[:1]])

    def accepts(self, windows: list[str]) -> np.ndarray:
        return self.probability(windows) >= self.thresholds[kinds_of_key(windows)] if windows else np.zeros(0, bool)

    def probability_of(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -50, 50)))

    def probability(self, windows: list[str]) -> np.ndarray:
        out = [self.probability_of(self.forward(one_hot(windows[i : i + 256]))[0].astype(float)) for i in range(0, len(windows), 256)]
        return np.concatenate(out) if out else np.zeros(0)


Finding = tuple[str, str, str, bool]  # what stands before, the candidate, what stands after, whether it is a key


def corpus_findings(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, found: int = FOUND) -> tuple[list[Finding], list[str]]:
    """Labelled findings of a bounded sample of documents, and pieces of their text (at most one of each); what is collected is bounded by ``found``."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in common.texts(batch).to_pylist():
                base = base_spans(t)
                own = [(*key_of(t, s), "key") for s in base]
                own += [(a, b, "other") for a, b in candidates(t) if not any(s < b and a < e for s, e, _ in base)]
                rows += [(kind, t[max(0, a - LEFT) : a], t[a:b][: 4 * INSIDE], t[b : b + RIGHT]) for a, b, kind in own]
                at = len(t) * 5 // 8
                rows.append(("text", "", t[at : at + 120], ""))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["kind", "before", "body", "after"])

        return work

    texts = docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''")
    rows = common.map_arrow(common.bounded_sample(texts, "text", sample), make, "kind string, before string, body string, after string").distinct()
    some = {k: [tuple(r)[1:] for r in rows.where(F.col("kind") == k).orderBy(F.xxhash64("body", "before"), "body", "before", "after").limit(found).collect()] for k in ("key", "other", "text")}
    return [(*r, True) for r in some["key"]] + [(*r, False) for r in some["other"]], [r[1] for r in some["text"]]


def generated_findings(n: int, pieces: list[str], seed: int = 3) -> list[Finding]:
    """Keys of common forms and harmless compounds of words, half of each, in contexts cut from ``pieces`` (of invented words where there are none)."""
    r = np.random.default_rng(seed)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    text = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    pick = lambda *x: x[r.integers(len(x))]
    number = lambda k: str(r.integers(0, k))
    known = [w for w in (re.findall(r"[A-Za-z]{2,12}", " ".join(pieces)) if pieces else [])]
    invented = lambda: "".join(pick(*"bcdfghklmnprstvw") + pick(*"aeiou") for _ in range(int(r.integers(1, 5))))
    word = lambda: known[r.integers(len(known))].lower() if known and r.random() < 0.7 else invented()
    words = lambda k: [word() for _ in range(k)]

    def context() -> tuple[str, str]:
        own = pieces[r.integers(len(pieces))] if pieces and r.random() < 0.7 else " ".join(words(16))
        at = int(r.integers(0, max(1, len(own) - 1)))
        return own[max(0, at - LEFT) : at].rstrip() + pick(" ", "\n", ' "', ": ", "(", ""), pick(" ", "\n", '" ', ". ", ")", "") + own[at : at + RIGHT].lstrip()

    def join(by: str, k: int) -> str:
        return by.join(words(k))

    out = []
    for i in range(n):
        secret = i % 2 == 0
        before, after = context()
        if secret:
            body = pick(
                lambda: pick("ghp_", "gho_", "glpat-", "sk-", "xoxb-", "npm_", "pk_live_", "hf_") + text(low + up + digits, int(r.integers(20, 40))),
                lambda: text(low + up + digits + "+/", int(r.integers(24, 64))) + pick("", "=", "=="),
                lambda: text(low + up + digits + "-_", int(r.integers(20, 48))),
                lambda: "eyJ" + text(low + up + digits, 17) + "." + text(low + up + digits + "-_", 40),
                lambda: text(up + digits, int(r.integers(20, 40))),
                lambda: text(low + digits, int(r.integers(20, 40))),
                lambda: text("0123456789abcdef", int(r.integers(24, 64))),
                lambda: text(low + up, int(r.integers(24, 48))),
            )()
            ahead = ""
            if r.random() < 0.3:  # what stands before the key in one candidate
                ahead = pick(lambda: f"{word()}.{word()}.com/{word()}/{text(digits + up, 8)}/", lambda: join("/", int(r.integers(4, 9))) + "/", lambda: join("_", 3).upper() + "=", lambda: f"{join('/', 3)}/v{number(9)}/{join('.', 2)}=")()
            if r.random() < 0.3:
                before = before[-8:] + pick("Authorization: Bearer ", "credentials: ", "export AUTH=", "pwd: '", "access_key: ", 'key = "')
            body = ahead + body
        else:
            body = pick(
                lambda: join(pick("/", "-", "_", "."), int(r.integers(3, 12))) + pick("", number(9999), f".{word()[:4]}"),
                lambda: pick("www.", "", f"{word()}.") + join(".", 2) + pick(".com/", ".org/", ".net") + join("/", int(r.integers(1, 9))) + pick("", ".html", f"/{number(9999)}"),
                lambda: join("", int(r.integers(3, 9))),
                lambda: pick("", "-", "_", "/").join(w.upper() for w in words(int(r.integers(3, 9)))),
                lambda: pick("", "/", "_", ".").join(w.title() for w in words(int(r.integers(3, 10)))) + pick("", number(999)),
                lambda: f"{word()}-{number(30)}.{number(30)}.{number(30)}-{word()}.tar.gz",
                lambda: f"{r.integers(1900, 2100)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}.{r.integers(10, 60)}Z",
                lambda: f"{word()}.{word()}{number(99)}.{word()}.{pick('com', 'org', 'de')}",
                lambda: "/".join(f"{word()}={number(9999)}" for _ in range(int(r.integers(3, 9)))),
                lambda: pick(".", "=", "-", "_") * int(r.integers(10, 30)) + word() + number(99),
                lambda: pick(up[:4], up[4:8])[:2] + text(digits, 20),
                lambda: pick(*low, *up) * int(r.integers(16, 90)),
                lambda: text(digits, 3) + "-" + word() + "-" + text(digits, 3) + "-" + text(digits, 4) + word(),
            )()
            body = body if len(body) >= LEAST else body + "-" + join("", 6)[: LEAST - len(body)].ljust(LEAST - len(body), "e")
        out.append((before[-LEFT:], body, after, secret))
    return out


def examples(findings: list[Finding], pieces: list[str], generated: int = GENERATED, seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows, labels, and which are held out (by a hash of the candidate). A corpus key stands once in its own context and once in a piece's. Of a long candidate it is the window with the most kinds of characters (for a key), or any."""
    r = np.random.default_rng(seed)
    made = generated_findings(generated, pieces, seed)
    swapped = [(*made[int(r.integers(len(made)))][:1], k, made[int(r.integers(len(made)))][2], True) for _, k, _, secret in findings if secret and len(k) >= LEAST]
    x, y, held = [], [], []
    for before, body, after, secret in [*findings, *swapped, *made]:
        whole, start = before + body + after, len(before)
        read = list(parts(start, start + len(body)))
        a, b = max(read, key=lambda p, t=whole: len(set(t[p[0] : p[1]]))) if secret else read[r.integers(len(read))]
        x.append(window(whole, a, b))
        y.append(secret)
        held.append(int(hashlib.sha256(body.encode()).hexdigest(), 16) % 3 == 0)
    return x, np.array(y, float), np.array(held, bool)


def fitted(findings: list[Finding], pieces: list[str], epochs: int) -> Network:
    x, y, held = examples(findings, pieces)
    network = Network()
    network.train(one_hot([w for w, h in zip(x, held, strict=True) if not h]), y[~held], epochs=epochs)
    network.calibrate([w for w, h in zip(x, held, strict=True) if h], y[held])
    return network


@functools.lru_cache(maxsize=4)
def _trained(findings: tuple[Finding, ...], pieces: tuple[str, ...]) -> Network:
    """Of the corpus's other runs, those that a first network (which has not seen them) takes for keys are unlabelled, not harmless: they train nothing."""
    keys, other = [f for f in findings if f[3]], [f for f in findings if not f[3]]
    if other:
        first = fitted(keys, list(pieces), 4)
        other = [(a, b, c, d) for a, b, c, d in other if not first.accepts([window(a + b + c, x, y) for x, y in parts(len(a), len(a) + len(b))]).any()]
    return fitted(keys + other, list(pieces), 9)


def trained(docs: DataFrame | None = None, text_col: str = "text") -> Network:
    """The network, trained on the findings of ``docs`` and on generated ones; the same wherever these are the same."""
    findings, pieces = corpus_findings(docs, text_col) if docs is not None else ([], [])
    return _trained(tuple(findings), tuple(pieces))


def find(texts: list[str | None], network: Network) -> tuple[list[list[tuple[int, int, str]]], np.ndarray]:
    """The spans of each text, those of the rules and those that the network adds, by start and kind; and how many of the rules' it confirms."""
    base = [base_spans(t) if t else [] for t in texts]
    runs = [(i, a, b, False) for i, t in enumerate(texts) if t for a, b in candidates(t)]
    runs += [(i, *key_of(t, s), True) for i, t in enumerate(texts) if t for s in base[i]]
    out, confirmed = [list(x) for x in base], np.zeros(len(texts), np.int64)
    read = ((k, window(texts[i], x, y)) for k, (i, a, b, _) in enumerate(runs) for x, y in parts(a, b))
    accepted = np.zeros(len(runs), bool)
    while part := list(itertools.islice(read, 4096)):
        np.logical_or.at(accepted, [k for k, _ in part], network.accepts([w for _, w in part]))
    reach = [np.maximum.accumulate([e for _, e, _ in x]) for x in base]  # spans stand by start: the farthest end so far
    for (i, a, b, rule), yes in zip(runs, accepted, strict=True):
        if not yes:
            continue
        if rule:
            confirmed[i] += 1
            continue
        before = bisect.bisect_right(base[i], a, key=lambda s: s[0])
        if not before or reach[i][before - 1] < b:
            out[i].append((a, b, "net"))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for x in out], confirmed


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, *, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``secret_spans`` (array of kind, start, end in code points); with ``redact``, the text's spans are replaced by that string."""
    docs = docs.drop("secret_spans")
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, text_col))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        network = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.texts(batch, text_col).to_pylist()
            spans, _ = find(texts, network)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if redact is not None:
                columns[text_col] = pa.array([redacted(t, s, redact) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            columns["secret_spans"] = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans], kind)
            return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_arrow(docs, make, f"{schema}, secret_spans array<struct<kind:string,start:bigint,end:bigint>>", by=text_col)


def redacted(text: str, spans: list[tuple[int, int, str]], by: str) -> str:
    """The text with every span (overlapping ones as one) replaced."""
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], by]
        at = b
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the rules' spans, base_sha256, all spans, and how many the network adds (n_net) and confirms (n_confirmed), as the query returns them."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs))

    def make():
        network = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans, confirmed = find(common.texts(batch).to_pylist(), network)
            count = lambda k: pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64())
            sha = [hashlib.sha256(written([s for s in x if s[2] != "net"]).encode()).hexdigest() for x in spans]
            columns = {"doc_id": common.column(batch, "doc_id"), "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": pa.array(sha, pa.string()), "spans": pa.array([written(x) for x in spans], pa.string()), "n_net": count("net"), "n_confirmed": pa.array(confirmed)}
            return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

        return work

    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_net bigint, n_confirmed bigint")
