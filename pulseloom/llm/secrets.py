"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags each token (a run without white space) as secret begin, inside or outside. Its
features are the token's own shape, its neighbours' words and shapes, and features of the file
(language, length, how often it assigns). It is trained here, by gradient ascent on the
conditional likelihood, on windows of tokens from a bounded sample: at most SAMPLE_DOCS documents by their
id's hash, at most WINDOWS windows of each kind. Some hold pattern matches, which are the labels. So that the field
learns more than the patterns, drawn secrets (random values, alone or after one of KEYWORDS that no
pattern has) are put into the windows without a match, and drawn look-alikes (numbers, addresses, names,
paths) into others as outside. Everything else covers every whole text.

Decoding is Viterbi over whole documents. A token whose score for "outside" leads by more than
any transitions could make up for is outside on every best path, so paths are only searched
between such tokens; the result is that of the full search. Scores are sums of a token's own, left
and right parts, which are remembered by word.

Base matches always stay; tagged runs that overlap none of them are added. Offsets are code
points, end exclusive. Defined results: null and empty texts have no spans; repeated rows are each
scanned; an empty table gives an empty table and a field that tags nothing; extra columns pass
through where the function says so.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.common import claim, small_batches

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched from its start, so shorter runs only fail
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

#: Bounds of the training sample.
SAMPLE_DOCS, WINDOWS, REACH = 20_000, 1_000, 10
#: Windows taken from one document, and the most characters of one (windows with a longer token are left out of training).
WINDOWS_OF_ONE, WINDOW_CHARS = 8, 4_000
#: How far, in log odds, a tagged run must lead over no secret at all before it is added.
LEAD = 2.0
#: Words before a drawn secret; no fixed pattern has them.
KEYWORDS = ("pwd", "pass", "passcode", "credential", "credentials", "auth", "authorization", "bearer", "access_key", "private_key", "login", "pin", "session", "signature", "key")
STEPS, RATE, L2 = 60, 0.5, 1e-3
WORDS_KEPT = 120_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns, by start and then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def _shape(word: str) -> str:
    out = []
    for c in word[:64]:
        s = "0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:5])


_DIGITS = str.maketrans("123456789", "0" * 9)


def _norm(word: str) -> str:
    return word.lower().strip(".,;:!?()[]{}\"'").translate(_DIGITS)[:24] if not word.isalpha() else word.lower()[:24]


def signature(word: str) -> tuple:
    """What own_features says of a word but for its identity; few words differ in it."""
    n = len(word)
    core = word.rstrip(".,;:!?")
    if core.isalpha() and n - len(core) <= 1:  # most words
        tail = word[len(core) :]
        uppers = 0 if core.islower() else sum(map(str.isupper, core))
        shape = "x" if not uppers else "X" if uppers == len(core) else "Xx" if uppers == 1 and core[0].isupper() else _shape(core)
        return (shape + tail)[:5], min(9, n.bit_length()), 0, min(4, 5 * uppers // n), len(set(word)) // 3, min(10, len(core) // 4), False, tail == ":", ""
    digits, uppers = sum(map(str.isdigit, word)), sum(map(str.isupper, word))
    longest = max(map(len, re.findall(r"[0-9a-zA-Z+/_-]+", word)), default=0)
    head = re.match(r"""["']?([A-Za-z_]+)["']?[:=]""", word)
    shape = _shape(word)[:5]
    return shape, min(9, n.bit_length()), min(4, 5 * digits // n), min(4, 5 * uppers // n), len(set(word)) // 3, min(10, longest // 4), 0 < digits < longest and longest >= 12, "=" in word or ":" in word, head[1].lower() if head else ""


_NAMES = ("s", "l", "d", "u", "v", "r", "dx", "q", "k")


def own_features(word: str) -> list[str]:
    return ["bias", *(f"{a}={b}" for a, b in zip(_NAMES, signature(word), strict=True)), f"w={_norm(word) if len(word) <= 12 else '-'}"]


def left_features(word: str) -> list[str]:
    """Of the token before."""
    return [f"p={_norm(word)}", f"ps={signature(word)[0]}", f"pq={word[-1] in '=:'}"]


def right_features(word: str) -> list[str]:
    """Of the token after."""
    return [f"n={_norm(word)}", f"ns={signature(word)[0]}"]


def file_features(text: str, lang: str) -> list[str]:
    return [f"lang={lang}", f"size={min(8, int(math.log2(len(text) + 1)) // 2)}", f"eq={min(3, text.count('='))}"]


@dataclass
class Field:
    """Weights by feature (rows of begin, inside, outside) and transitions [from, to]."""

    weights: dict[str, np.ndarray] = field(repr=False)
    transitions: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        return cls({"bias": np.array([-10.0, -10.0, 0.0])}, np.zeros((3, 3)))

    @classmethod
    def fit(cls, windows: list[tuple[list[str], list[int], list[str]]]) -> Field:
        """Maximises the conditional log likelihood of (tokens, labels, file features) windows, with L2."""
        if not windows or all(y == OUTSIDE for _, labels, _ in windows for y in labels):
            return cls.blank()
        index: dict[str, int] = {}
        s, t = len(windows), max(len(w[0]) for w in windows)
        rows, cols = [], []
        gold, real = np.full((s, t), OUTSIDE), np.zeros((s, t), bool)
        for i, (tokens, labels, doc) in enumerate(windows):
            n = len(tokens)
            gold[i, :n], real[i, :n] = labels, True
            for k, w in enumerate(tokens):
                feats = own_features(w) + (left_features(tokens[k - 1]) if k else []) + (right_features(tokens[k + 1]) if k + 1 < n else []) + doc
                rows += [i * t + k] * len(feats)
                cols += [index.setdefault(f, len(index)) for f in feats]
        rows_, cols_ = np.array(rows), np.array(cols)
        w, tr = np.zeros((len(index), 3)), np.zeros((3, 3))
        gw, gt = np.full_like(w, 1e-6), np.full_like(tr, 1e-6)
        truth = np.eye(3)[gold] * real[..., None]
        pairs_real = real[:, 1:]
        gold_pairs = np.einsum("sta,stb->ab", truth[:, :-1], truth[:, 1:] * pairs_real[..., None])
        for _ in range(STEPS):
            e = np.stack([np.bincount(rows_, w[cols_, y], s * t) for y in range(3)], axis=1).reshape(s, t, 3)
            marg, pairs = _marginals(e, tr, real)
            diff = (truth - marg).reshape(-1, 3)
            dw = np.stack([np.bincount(cols_, diff[rows_, y], len(w)) for y in range(3)], axis=1) - L2 * s * w
            dt = gold_pairs - pairs - L2 * s * tr
            gw, gt = gw + dw**2, gt + dt**2
            w, tr = w + RATE * dw / np.sqrt(gw), tr + RATE * dt / np.sqrt(gt)
        return cls({f: w[i] for f, i in index.items()}, tr)

    def sum(self, features: list[str]) -> np.ndarray:
        return sum((self.weights[f] for f in features if f in self.weights), np.zeros(3))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _marginals(e: np.ndarray, tr: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all windows side by side: label marginals and summed transition marginals."""
    s, t, _ = e.shape
    e = np.where(real[..., None], e, 0.0)
    a, b = np.zeros((s, t, 3)), np.zeros((s, t, 3))
    a[:, 0] = e[:, 0]
    for k in range(1, t):
        step = _lse(a[:, k - 1, :, None] + tr, 1) + e[:, k]
        a[:, k] = np.where(real[:, k, None], step, a[:, k - 1])
    for k in range(t - 2, -1, -1):
        step = _lse(tr + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        b[:, k] = np.where(real[:, k + 1, None], step, 0.0)
    z = _lse(a[:, -1], 1)
    marg = np.exp(a + b - z[:, None, None]) * real[..., None]
    pairs = np.zeros((3, 3))
    for k in range(1, t):
        x = np.exp(a[:, k - 1, :, None] + tr + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None])
        pairs += (x * real[:, k, None, None]).sum(axis=0)
    return marg, pairs


def viterbi(e: np.ndarray, tr: np.ndarray, bounded: bool) -> list[int]:
    """Best labels of a run of tokens. bounded: what stands before and after the run is outside."""
    best = e[0] + (tr[OUTSIDE] if bounded else 0.0)
    back = []
    for row in e[1:]:
        x = best[:, None] + tr
        back.append(x.argmax(axis=0))
        best = x.max(axis=0) + row
    if bounded:
        best = best + tr[:, OUTSIDE]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Tagger:
    """Decodes whole texts with a field; one per worker."""

    def __init__(self, crf: Field) -> None:
        self.crf = crf
        self.slack = 2 * float(crf.transitions.max() - crf.transitions.min())
        self.number: dict[str, int] = {}
        self.by_signature: dict[tuple, np.ndarray] = {}
        self.scores = np.zeros((WORDS_KEPT + 1, 9), np.float64)  # own, left, right

    def _learn(self, word: str) -> int:
        """Scores of a new word: what its signature gives, remembered by signature, and what its identity gives."""
        n, sig = len(self.number), signature(word)
        row = self.scores[n]
        if (known := self.by_signature.get((sig, word[-1]))) is None:
            plain = ["bias", *(f"{a}={b}" for a, b in zip(_NAMES, sig, strict=True))]
            known = np.concatenate([self.crf.sum(plain), self.crf.sum(left_features(word)[1:]), self.crf.sum(right_features(word)[1:])])
            if len(self.by_signature) >= WORDS_KEPT // 4:
                self.by_signature.clear()
            self.by_signature[sig, word[-1]] = known
        row[:] = known
        name, weights = _norm(word), self.crf.weights
        if (x := weights.get(f"w={name if len(word) <= 12 else '-'}")) is not None:
            row[:3] += x
        if (x := weights.get("p=" + name)) is not None:
            row[3:6] += x
        if (x := weights.get("n=" + name)) is not None:
            row[6:] += x
        self.number[word] = n
        return n

    def emissions(self, tokens: list[str], doc: np.ndarray) -> np.ndarray:
        if len(self.number) + len(tokens) > WORDS_KEPT:
            self.number.clear()
            if len(tokens) > len(self.scores) - 1:
                self.scores = np.zeros((len(tokens) + 1, 9))
        get, learn = self.number.get, self._learn
        ids = np.fromiter((n if (n := get(w)) is not None else learn(w) for w in tokens), np.int64, len(tokens))
        x = self.scores[ids]
        e = x[:, :3] + doc
        e[:, BEGIN] -= LEAD
        e[1:] += x[:-1, 3:6]
        e[:-1] += x[1:, 6:]
        return e

    def labels(self, tokens: list[str], doc: np.ndarray) -> np.ndarray:
        out = np.full(len(tokens), OUTSIDE)
        if not tokens:
            return out
        e = self.emissions(tokens, doc)
        open_ = np.flatnonzero(e[:, OUTSIDE] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= self.slack)
        if len(open_):
            cuts = np.flatnonzero(np.diff(open_) > 1) + 1
            for run in np.split(open_, cuts):
                lo, hi = int(run[0]), int(run[-1]) + 1
                path = e[max(0, lo - 1) : hi + 1].copy()
                # The neighbours are outside; at the text's edges there is none.
                if lo:
                    path[0, :2] = -1e9
                if hi < len(tokens):
                    path[-1, :2] = -1e9
                out[lo:hi] = viterbi(path, self.crf.transitions, False)[int(lo > 0) : int(lo > 0) + hi - lo]
        return out

    def added(self, text: str, lang: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tagged runs that overlap no base span."""
        tokens = _TOKEN.findall(text)
        y = self.labels(tokens, self.crf.sum(file_features(text, lang)))
        hot = np.flatnonzero(y != OUTSIDE)
        if not len(hot):
            return []
        spans: list[list[int]] = []
        wanted, last = iter(hot.tolist()), -2
        at = next(wanted)
        for k, m in enumerate(_TOKEN.finditer(text)):
            if k < at:
                continue
            if y[k] == INSIDE and last == k - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last, at = k, next(wanted, -1)
            if at < 0:
                break
        return [(a, 3, b) for a, b in spans if not any(s < b and a < e for s, _, e in base)]


def _value(r: random.Random) -> str:
    """A drawn secret: a random string, with or without a vendor's kind of prefix."""
    letters = r.choice((string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/_-"))
    body = "".join(r.choices(letters, k=r.randrange(12, 44)))
    if not any(map(str.isdigit, body)):
        body = body[:-3] + str(r.randrange(100, 1000))
    if r.random() < 0.3:
        body = "".join(r.choices(string.ascii_lowercase, k=r.randrange(2, 4))) + r.choice("_-") + body
    return body


def _lookalike(r: random.Random) -> str:
    """A drawn token that is no secret: a number, date, address, path, name, product code or version."""
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=r.randrange(3, 10)))
    return r.choice((
        lambda: str(r.randrange(10 ** r.randrange(1, 14))), lambda: f"{r.randrange(1900, 2100)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", lambda: f"{word()}@{word()}.{word()[:3]}", lambda: f"https://www.{word()}.com/{word()}/{r.randrange(10 ** 5)}",
        lambda: f"{word()}_{word()}", lambda: f"{word().title()}{word().title()}", lambda: f"{word()}={r.randrange(1000)}", lambda: f"{word()}:", lambda: f"+{r.randrange(10, 99)}-{r.randrange(100, 999)}-{r.randrange(10 ** 6, 10 ** 7)}",
        lambda: f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(9)}", lambda: f"{word()[:3].upper()}-{r.randrange(10 ** 4)}", lambda: word() + word() + word(), lambda: f"/{word()}/{word()}/{word()}.py", lambda: f"{word()}-{word()}-{word()}", lambda: f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}",
    ))()


def with_drawn(windows: list[tuple[list[str], list[int], list[str]]], seed: int = 11) -> list[tuple[list[str], list[int], list[str]]]:
    """The windows, and for each one without a label two more: with a drawn secret, and with drawn look-alikes.

    Windows without a label are used as often as it takes to have WINDOWS of each."""
    r, out = random.Random(seed), list(windows)
    clean = [w for w in windows if all(y == OUTSIDE for y in w[1])]
    for tokens, labels, doc in clean * -(-WINDOWS // len(clean)) if clean else []:
        at = r.randrange(len(tokens) + 1)
        word, value = r.choice(KEYWORDS), _value(r)
        word = r.choice((word, word.upper(), word.title()))
        kind = r.random()
        if kind < 0.35:
            new, y = [value], [BEGIN]
        elif kind < 0.55:
            new, y = [word + r.choice("=:") + r.choice(("", "\"")) + value], [BEGIN]
        elif kind < 0.85:
            new, y = [word + r.choice((":", "=", "")), value], [BEGIN, INSIDE]
        else:
            new, y = [word, r.choice(("=", ":", "is", "->")), value], [BEGIN, INSIDE, INSIDE]
        out.append((tokens[:at] + new + tokens[at:], labels[:at] + y + labels[at:], doc))
        tokens, labels = list(tokens), list(labels)
        for _ in range(3):
            at = r.randrange(len(tokens) + 1)
            new = [r.choice((word, word + ":"))] if r.random() < 0.2 else [_lookalike(r)]  # a keyword without a secret, too
            tokens[at:at], labels[at:at] = new, [OUTSIDE] * len(new)
        out.append((tokens, labels, doc))
    return out


def training_windows(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[list[str], list[int], list[str]]]:
    """At most WINDOWS windows of REACH tokens on both sides of base matches, and as many without any."""
    n = df.count()
    picked = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE_DOCS / max(n, 1))))
    docs = df.where(picked).select(F.xxhash64(F.col(key).cast("string"), F.lit(1)).alias("h"), F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    schema = "h long, positive boolean, tokens array<string>, labels array<int>, doc array<string>"

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for h, cell, name in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = cell.as_py() or ""
                base, doc = base_spans(text), file_features(text, name)
                if not base and h % 16:
                    continue
                where = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
                y, first = [OUTSIDE] * len(where), [0] if not base else []
                k = 0
                for a, _, b in base:
                    while k < len(where) and where[k][1] <= a:
                        k += 1
                    j = k
                    while j < len(where) and where[j][0] < b:
                        if y[j] == OUTSIDE:
                            y[j] = BEGIN if j == k else INSIDE
                        j += 1
                    first.append(k)
                if not base and where:
                    first = [abs(h) % len(where)]
                for f in first[:WINDOWS_OF_ONE]:
                    lo, hi = max(0, f - REACH), min(len(where), f + REACH + 2)
                    if lo < hi and where[hi - 1][1] - where[lo][0] <= WINDOW_CHARS:
                        out.append((h, bool(base), [text[a:b] for a, b in where[lo:hi]], y[lo:hi], doc))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2], pa.list_(pa.string())), pa.array(c[3], pa.list_(pa.int32())), pa.array(c[4], pa.list_(pa.string()))],
                    names=["h", "positive", "tokens", "labels", "doc"],
                )

    found = small_batches(docs).mapInArrow(run, schema)
    rows = []
    for kind in (True, False):
        rows += found.where(F.col("positive") == kind).orderBy("h", "tokens").limit(WINDOWS).collect()
    return [(list(r["tokens"]), list(r["labels"]), list(r["doc"])) for r in rows]


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Field:
    return Field.fit(with_drawn(training_windows(df, key, text, lang)))


_TAGGERS: dict[str, Tagger] = {}


def marked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with ``mark`` in place of each stretch that (start, kind, end) spans cover."""
    parts, done = [], 0
    for a, _, b in sorted(spans):
        if a >= done:
            parts += [text[done:a], mark]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def scan(df: DataFrame, crf: Field, text: str = "text", lang: str = "lang", out: str = "spans", mark: str | None = None) -> DataFrame:
    """``df`` with ``out``: array of (kind, start, end), by start and then kind. One scan, no shuffle.

    With ``mark``, the text's spans are also replaced by it; null texts stay null."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    shared = df.sparkSession.sparkContext.broadcast(crf)
    tag = uuid.uuid4().hex
    at, by = df.columns.index(text), df.columns.index(lang)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):  # noqa: ANN001, ANN202
        claim("secrets", _TAGGERS.clear)
        if tag not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[tag] = Tagger(shared.value)
        tagger = _TAGGERS[tag]
        for batch in batches:
            found, clean = [], []
            for cell, name in zip(batch.column(at), batch.column(by).to_pylist(), strict=True):
                text = cell.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + tagger.added(text, "" if name is None else str(name), base))
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
                if mark is not None:
                    clean.append(marked(text, spans, mark) if spans else cell.as_py())
            columns = list(batch.columns)
            if mark is not None:
                columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow)], names=[*batch.schema.names, out])

    return small_batches(df).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))

