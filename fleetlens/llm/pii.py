"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds to them.

The base spans come from the patterns of four kinds. The tagger reads windows of
WINDOW characters that overlap by half; it gives every character scores for
outside, begin and inside of each kind, and the best tag path of a window follows
learned transitions. A span no longer than STRIDE lies whole in some window, so spans
that touch a cut edge are left to the neighbouring window. All windows of a document
are then reconciled at once: base spans first, then the tagger's by score, each only
where it overlaps nothing that stands.

A tagged span must be made like its kind (an email has an @, the others enough digits).
A window without a digit and without an @ therefore has only the outside path, and is
not evaluated; a span's score is the mean probability of its tags, at least SURE.

The tagger is trained in numpy on windows around labelled spans: those that the
patterns find in a bounded sample of SAMPLE_TEXTS texts, written in the usual other
ways as well (no country code, other separators, white space around the @), and as
many windows with nothing in them. Without any labelled span there is no tagger.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Texts of
any length are read whole, window after window. Equal texts get equal spans; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import annotated, two_columns

KINDS = ("email", "ip", "card", "phone")
SAMPLE_TEXTS = 400
SAMPLE_BYTES = 20_000
#: Training windows of one kind.
WINDOWS = 300
WINDOW, STRIDE = 128, 64
HIDDEN, EMBEDDED = 16, 12
STEPS, BATCH, RATE = 400, 32, 0.01
SURE = 0.9

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_TRIGGER = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


# ---- base spans


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From every @ back to where its local part starts, so that no long run is read twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        # A local part that fails is read again for no later @: the @ itself ends it.
        done = found.end() if found else at + 1
        if found:
            out.append((begin, found.end()))
        at = text.find("@", done)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the patterns, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# ---- the tagger

_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0@._%+-() \n:/,;'\"#*&!|"
_OUT, _OTHER, _WIDE = 0, len(_SYMBOLS) + 1, len(_SYMBOLS) + 2


def _symbol_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    for i, c in enumerate(_SYMBOLS):
        table[ord(c)] = table[ord(c.upper())] = i + 1
    table[ord("0"): ord("9") + 1] = table[ord("0")]
    return table


_TABLE = _symbol_table()
_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _TABLE[np.minimum(points, 255)], _WIDE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, one LSTM in each direction, tag scores, and transitions between tags."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        shapes = {"emb": (_WIDE + 1, EMBEDDED), "out": (2 * HIDDEN, _TAGS), "bias": (_TAGS,),
                  "step": (_TAGS, _TAGS), "first": (_TAGS,)}
        for way in "fb":
            shapes |= {f"x{way}": (EMBEDDED, 4 * HIDDEN), f"h{way}": (HIDDEN, 4 * HIDDEN), f"c{way}": (4 * HIDDEN,)}
        return cls({k: (rng.normal(0, 0.25, s) if len(s) > 1 and k != "step" else np.zeros(s)).astype(np.float32)
                    for k, s in shapes.items()})

    def _lstm(self, symbols: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        w, (n, t) = self.w, symbols.shape
        table = w["emb"] @ w["x" + way] + w["c" + way]
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, t, HIDDEN), np.float32)
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            z = table[symbols[:, i]] + h @ w["h" + way]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            new = np.tanh(z[:, 3 * HIDDEN:])
            before, was = c, h
            c = gates[:, HIDDEN: 2 * HIDDEN] * c + gates[:, :HIDDEN] * new
            squashed = np.tanh(c)
            h = gates[:, 2 * HIDDEN:] * squashed
            out[:, i] = h
            if keep is not None:
                keep.append((i, gates, new, before, was, squashed))
        return out

    def scores(self, symbols: np.ndarray, keep: dict | None = None) -> np.ndarray:
        sides = []
        for way in "fb":
            steps = None if keep is None else keep.setdefault(way, [])
            sides.append(self._lstm(symbols, way, steps))
        hidden = np.concatenate(sides, axis=2)
        if keep is not None:
            keep["hidden"] = hidden
        return hidden @ self.w["out"] + self.w["bias"]

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tag path of every window."""
        n, t, _ = scores.shape
        best = scores[:, 0] + self.w["first"]
        back = np.zeros((t, n, _TAGS), np.int8)
        for i in range(1, t):
            grid = best[:, :, None] + self.w["step"][None]
            back[i] = grid.argmax(axis=1)
            best = grid.max(axis=1) + scores[:, i]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][rows, tags[:, i]]
        return tags

    # -- training

    def _chains(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over the paths up to each tag, from each tag on, and over all paths."""
        t, step = scores.shape[1], self.w["step"]
        alpha = np.empty_like(scores)
        beta = np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0] + self.w["first"]
        for i in range(1, t):
            alpha[:, i] = scores[:, i] + _logsum(alpha[:, i - 1][:, :, None] + step, 1)
        for i in range(t - 2, -1, -1):
            beta[:, i] = _logsum(step[None] + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        return alpha, beta, _logsum(alpha[:, -1], 1)[:, None]

    def shares(self, scores: np.ndarray) -> np.ndarray:
        """The probability of every tag at every character."""
        alpha, beta, total = self._chains(scores)
        return np.exp(alpha + beta - total[:, None])

    def _crf(self, scores: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log-likelihood by scores, transitions and first tags."""
        n, t, k = scores.shape
        alpha, beta, total = self._chains(scores)
        grad = np.exp(alpha + beta - total[:, None])
        rows = np.arange(n)
        pair = np.zeros((k, k), np.float32)
        for i in range(1, t):
            pair += np.exp(alpha[:, i - 1][:, :, None] + self.w["step"] + (scores[:, i] + beta[:, i])[:, None, :]
                           - total[:, :, None]).sum(axis=0)
            np.add.at(pair, (tags[:, i - 1], tags[:, i]), -1)
        for i in range(t):
            grad[rows, i, tags[:, i]] -= 1
        return {"scores": grad / n, "step": pair / n, "first": grad[:, 0].sum(axis=0) / n}

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        w, kept = self.w, {}
        crf = self._crf(self.scores(symbols, kept), tags)
        out = {k: np.zeros_like(v) for k, v in w.items()} | {"step": crf["step"], "first": crf["first"]}
        flat = crf["scores"].reshape(-1, _TAGS)
        out["out"] = kept["hidden"].reshape(-1, 2 * HIDDEN).T @ flat
        out["bias"] = flat.sum(axis=0)
        into = (flat @ w["out"].T).reshape(kept["hidden"].shape)
        for side, way in enumerate("fb"):
            d_out = into[:, :, side * HIDDEN: (side + 1) * HIDDEN]
            dh = np.zeros((len(symbols), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for i, gates, new, before, was, squashed in reversed(kept[way]):
                dh = dh + d_out[:, i]
                enter, forget, leave = (gates[:, j * HIDDEN: (j + 1) * HIDDEN] for j in range(3))
                dc = dc + dh * leave * (1 - squashed ** 2)
                dz = np.concatenate([dc * new, dc * before, dh * squashed], axis=1) * gates * (1 - gates)
                dz = np.concatenate([dz, dc * enter * (1 - new ** 2)], axis=1)
                out["h" + way] += was.T @ dz
                out["c" + way] += dz.sum(axis=0)
                out["x" + way] += w["emb"][symbols[:, i]].T @ dz
                np.add.at(out["emb"], symbols[:, i], dz @ w["x" + way].T)
                dh, dc = dz @ w["h" + way].T, dc * forget
        return out

    def fit(self, symbols: np.ndarray, tags: np.ndarray, steps: int | None = None, seed: int = 6) -> Tagger:
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        order: list[int] = []
        for step in range(1, 1 + (STEPS if steps is None else steps)):
            if len(order) < min(BATCH, len(symbols)):
                order = rng.permutation(len(symbols)).tolist()
            rows, order = order[:BATCH], order[BATCH:]
            for k, g in self.gradients(symbols[rows], tags[rows]).items():
                g = np.clip(g, -5, 5)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - RATE * (mean[k] / (1 - 0.9 ** step))
                             / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# ---- training data


def _written_otherwise(kind: str, span: str, rng: np.random.Generator) -> str:
    """The same kind of data in another usual spelling, or as it is."""
    way = rng.integers(4)
    if kind == "phone" and way < 2:
        span = re.sub(r"^\+[0-9]+[ -]?", "", span)
        return span if way else re.sub(r"[()]", "", span).strip().replace(" ", "-")
    if kind == "card" and way == 0:
        return re.sub(r"[ -]", ".", span)
    if kind == "email" and way == 0:
        return span.replace("@", " @ ", 1)
    return span


def windows(texts: Iterable[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and their tags: around labelled spans, and as many without any."""
    rng = np.random.default_rng(seed)
    made: list[tuple[np.ndarray, np.ndarray]] = []
    count = dict.fromkeys([*KINDS, None], 0)
    for text in texts:
        spans = base_spans(text)
        taken = np.zeros(len(text) + 1, bool)
        for _, a, b in spans:
            taken[a:b] = True
        for kind, a, b in spans:
            if count[kind] < WINDOWS and b - a <= STRIDE and taken[a:b].sum() == b - a:
                span = _written_otherwise(kind, text[a:b], rng)
                if not span:
                    continue
                before = text[max(0, a - int(rng.integers(8, WINDOW - STRIDE))): a]
                after = text[b: b + WINDOW]
                if any(_TRIGGER.search(x) for x in (before, after)):  # other data near it: unlabelled here
                    before, after = re.sub(r"\S*[0-9@]\S*", "", before), re.sub(r"\S*[0-9@]\S*", "", after)
                made.append(_labelled(before, span, after, kind))
                count[kind] += 1
        if count[None] < WINDOWS and len(text) > WINDOW:
            at = int(rng.integers(len(text) - WINDOW))
            if not taken[at: at + WINDOW].any():
                made.append(_labelled(text[at: at + WINDOW], "", "", None))
                count[None] += 1
        for m in _TRIGGER.finditer(text):  # digits that are nobody's data
            at = max(0, m.start() - WINDOW // 2)
            if count[None] >= 2 * WINDOWS:
                break
            if not taken[at: at + WINDOW].any():
                made.append(_labelled(text[at: at + WINDOW], "", "", None))
                count[None] += 1
                break
    if not any(count[k] for k in KINDS):
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    symbols, tags = zip(*made, strict=True)
    return np.stack(symbols), np.stack(tags)


def _labelled(before: str, span: str, after: str, kind: str | None) -> tuple[np.ndarray, np.ndarray]:
    symbols, tags = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    found = _symbols((before + span + after)[:WINDOW])
    symbols[: len(found)] = found
    if kind:
        tag = 1 + 2 * KINDS.index(kind)
        a, b = len(before), min(len(before) + len(span), WINDOW)
        tags[a:b] = tag + 1
        tags[a: a + 1] = tag
    return symbols, tags


def trained(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray] | None:
    """A tagger's weights, from the texts with the lowest hashes among those with a digit or an @."""
    rows = two_columns(docs, id_col, text_col)
    rows = rows.filter((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").rlike(r"@|\+[0-9]|[0-9]\.[0-9]|[0-9][0-9 -]{14}"))
    sample = (rows.select("text", F.xxhash64(F.col("doc_id").cast("string")).alias("at"))
              .orderBy("at", "text").limit(SAMPLE_TEXTS).collect())
    symbols, tags = windows(row.text for row in sample)
    return Tagger.fresh().fit(symbols, tags).w if len(symbols) else None


# ---- finding


def _likely(kind: str, span: str) -> bool:
    digits = sum(map(str.isdigit, span))
    if kind == "email":
        return "@" in span and "." in span.split("@", 1)[1].strip()
    if kind == "ip":
        return span.count(".") == 3 and digits >= 4
    return digits >= 13 if kind == "card" else 9 <= digits <= 15


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[float, str, int, int]]]:
    """(score, kind, start, end) of the tagger's spans in each text."""
    out: list[list] = [[] for _ in texts]
    where: list[tuple[int, int]] = []
    for doc, text in enumerate(texts):
        last = -1
        for m in _TRIGGER.finditer(text):
            place = m.start() // STRIDE
            for i in (place - 1, place):  # both windows that hold this character
                if i > last and i >= 0:
                    where.append((doc, i * STRIDE))
                    last = i
    for begin in range(0, len(where), 512):
        some = where[begin: begin + 512]
        symbols = np.zeros((len(some), WINDOW), np.int64)
        for row, (doc, at) in enumerate(some):
            found = _symbols(texts[doc][at: at + WINDOW])
            symbols[row, : len(found)] = found
        scores = tagger.scores(symbols)
        tags = tagger.decode(scores)
        rows = np.flatnonzero((tags > 0).any(axis=1))
        if not len(rows):
            continue
        share = np.take_along_axis(tagger.shares(scores[rows]), tags[rows][:, :, None], 2)[:, :, 0]
        for row, own in zip(rows.tolist(), share, strict=True):
            doc, at = some[row]
            text = texts[doc]
            for kind, a, b in _paths(tags[row]):
                cut = (a == 0 and at > 0) or (b == WINDOW and at + WINDOW < len(text))
                score = float(own[a:b].mean())
                if not cut and score >= SURE and _likely(kind, text[at + a: at + b]):
                    out[doc].append((score, kind, at + a, min(at + b, len(text))))
    return out


def _paths(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """The spans of a tag path: a begin tag and the inside tags of its kind that follow."""
    out = []
    for i in np.flatnonzero((tags % 2 == 1)).tolist():
        end = i + 1
        while end < len(tags) and tags[end] == tags[i] + 1:
            end += 1
        out.append((KINDS[(tags[i] - 1) // 2], i, end))
    return out


def spans_of(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, by kind as listed and then by start."""
    texts = [t or "" for t in texts]
    added = tagged_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, more in zip(texts, added, strict=True):
        base = base_spans(text)
        everything = list(base)
        for _, kind, a, b in sorted(set(more), key=lambda s: (-s[0], s[2], s[3])):
            if all(b <= c or a >= d for _, c, d in everything):
                everything.append((kind, a, b))
        everything.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append((base, everything))
    return out


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FIELDS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, masked string"


def found(docs: DataFrame, weights: dict[str, np.ndarray] | None, *, text_col: str = "text", name: str = "pii",
          mask: bool = False) -> DataFrame:
    """All rows and columns, and a struct `name`: counts and digest of the base spans, all spans as text,
    and the masked text if asked (else null)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def work(texts: pa.Array) -> dict:
        texts = texts.to_pylist()
        both = spans_of(texts, Tagger(sent.value) if sent.value is not None else None)
        out = {f"n_{kind}": pa.array([sum(s[0] == kind for s in base) for base, _ in both], pa.int64()) for kind in KINDS}
        out["base_sha256"] = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in both], pa.string())
        out["spans"] = pa.array([spelled(spans) for _, spans in both], pa.string())
        out["masked"] = pa.array([None if t is None or not mask else masked(t, s)
                                  for t, (_, s) in zip(texts, both, strict=True)], pa.string())
        return out

    return annotated(docs, text_col, work, FIELDS, name)
