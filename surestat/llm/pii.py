"""Operator 9, personal data by a semi-Markov conditional random field over whole spans.

Four base kinds are found by exact rules and always stay. The model adds what the rules' shapes miss: its segments are runs of
at most LONGEST neighbouring tokens that each hold a digit, '@' or '=' or come right after a secret-like name, its features are of the whole span (shape, digits,
check digit, octets, alphabet, the words before), and a dynamic programme over bounded segments chooses boundaries and kinds
together; a token outside any segment is of kind `none`. Other tokens can't be in a segment, so a text falls into
short runs that are solved apart, which is exact. Segments of all kinds are added: `secret`, and those of the base kinds whose
neighbours spoil the rules' greedy match (two card numbers side by side, a phone number before an address). Added spans never
overlap base spans.

Learning takes at most TRAIN_DOCS texts that hold such characters or names (smallest hash first, at most TRAIN_BYTES bytes each), with the
base spans, assignments to secret-like names (a word without such characters only after ':' or '=') and public key formats as
labels. Finding covers every whole text.

Defined results: null and empty texts have no spans; equal spans of one kind are reported once; n_email to n_phone count base spans, and n_spans all spans; repeated rows each give their
own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, only_memory, table

KINDS = ["email", "ip", "card", "phone", "secret"]
LONGEST = 8
TRAIN_DOCS, TRAIN_BYTES, EPOCHS, RATE = 1_500, 20_000, 4, 0.3

# The base patterns, and the characters of an e-mail address before its '@'.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # same matches; a run of digits is tried once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET_NAMES = re.compile(r"(?i)(password|passwd|pwd|secret|token|api_?key|access_?key)")
NAME_PARTS = ["passw", "pwd", "secret", "token", "key"]  # one is in every secret-like name
ASSIGNED = re.compile(rf"{SECRET_NAMES.pattern}[\w-]{{0,20}}+[\"']?\s*[:=]+\s*$")
AFTER_NAME = re.compile(rf"{SECRET_NAMES.pattern}[\w-]{{0,20}}+[\"']?(\s*[:=]+|\s+is\b)?\s+(?=\S)")
SECRET_SHAPES = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abp]-[0-9A-Za-z-]{10,}")

_DIGITS = re.compile("[0-9]")
_TRIGGER = re.compile("[0-9@=]")
_TOKEN = re.compile(r"\S+")


def digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, in linear time: every match has its '@' right after the longest run of local characters
    that begins no earlier than the last match's end."""
    found, at = [], 0
    here = text.find("@")
    while here >= 0:
        begin = at + len(text[at:here].rstrip(LOCAL)) if here > at else here
        if begin < here and (m := DOMAIN.match(text, here + 1)):
            found.append((begin, m.end()))
            at = m.end()
        elif here >= at:
            # the next address can't reach back over this '@'
            at = here + 1
        here = text.find("@", max(here + 1, at))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds in the listed order, each by start."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= len(n := digits(m[0])) <= 19 and luhn(n):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


def core(text: str, begin: int, end: int) -> tuple[int, int]:
    """A token's span without brackets, quotes and stops around it, and without a name that it is assigned to."""
    while begin < end and text[begin] in "\"'([{<":
        begin += 1
    while begin < end and text[end - 1] in "\"')]}>.,;:!?":
        end -= 1
    at = text.rfind("=", begin, end)
    if begin < at < end - 1:
        begin = at + 1
        while begin < end and text[begin] in "\"'":
            begin += 1
    return begin, end


class Run:
    """A run of neighbouring trigger tokens. Its candidate segments are made as they are asked for, so a long run's memory is its tokens'."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], before: str) -> None:
        self.text, self.tokens, self.before, self.n = text, tokens, before, len(tokens)
        self._starts: dict[int, tuple[int, int, bool, bool, str]] = {}

    def _start(self, i: int) -> tuple[int, int, bool, bool, str]:
        """Where a segment from token i begins, alone and with others after it, whether it is named, a plain word, and what is said before it."""
        if i not in self._starts:
            text, (at, end) = self.text, self.tokens[i]
            said = f"{self.before} {text[self.tokens[max(0, i - 3)][0] : at]}"[-40:]
            begin = core(text, at, end)[0]
            named = bool(SECRET_NAMES.search(said) or SECRET_NAMES.search(text[at:begin]))
            self._starts.pop(i - 2 * LONGEST, None)
            self._starts[i] = begin, at if text[at] == "(" else begin, named, not _TRIGGER.search(text, at, end), said
        return self._starts[i]

    def ending(self, j: int) -> Iterator[tuple[int, int, int, int, tuple[str, ...]]]:
        """The segments (i, j, begin, end, features) of tokens i up to j."""
        end = core(self.text, *self.tokens[j - 1])[1]
        for i in range(max(0, j - LONGEST), j):
            alone, joined, named, word, said = self._start(i)
            begin = joined if j - i > 1 else alone
            if begin < end:
                features = span_features(self.text[begin:end], j - i, named)
                if j - i == 1 and word:
                    features += ("word assigned" if ASSIGNED.search(said) else "word",)
                yield i, j, begin, end, features


def span_features(span: str, tokens: int, named: bool) -> tuple[str, ...]:
    number = digits(span)
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", span))
    out = ["bias", f"tokens {min(tokens, 5)}", f"digits {min(len(number), 20)}", f"shape {shape if len(shape) < 16 else 'long'}", f"length {min(len(span), 48) // 4}"]
    if named:
        out.append("named")
    if re.fullmatch(r"[0-9 -]+", span) and 16 <= len(number) <= 19:
        out.append("card number" if luhn(number) else "wrong check digit")
    if re.fullmatch(r"\d+(\.\d+){3}", span):
        out.append("octets" if all(len(p) <= 3 and int(p) <= 255 for p in span.split(".")) else "wrong octets")
    if span.count("@") == 1:
        out.append("address" if "." in span.partition("@")[2] else "at")
    if span[0] == "+":
        out.append("international" if 8 <= len(number) <= 15 else "plus")
    if tokens == 1 and len(span) >= 12 and span.isalnum() and number and len(number) < len(span):
        out.append("mixed alphabet" if not re.fullmatch("[0-9a-f]+", span) else "hexadecimal")
        out.append(f"mixed {span.isupper()}, named {named}")
    return tuple(out)


def runs(text: str) -> list[Run]:
    """Maximal runs of trigger tokens, in order; the word right after a secret-like name is one too."""
    low = text.lower()
    after = {m.end() for m in AFTER_NAME.finditer(text)} if any(x in low for x in NAME_PARTS) else ()
    if not after and not _TRIGGER.search(text):
        return []
    out, held, before, previous = [], [], "", ""
    for m in _TOKEN.finditer(text):
        if m.start() in after or _TRIGGER.search(m[0]):
            if not held:
                before = previous
            held.append(m.span())
        elif held:
            out.append(Run(text, held, before))
            held = []
        previous = f"{previous} {m[0]}"[-40:]
    if held:
        out.append(Run(text, held, before))
    return out


class Model:
    """Weights of each feature for each kind, and of moves between kinds (none is last)."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def score(self, features: tuple[str, ...]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return sum((self.weights.get(f, zero) for f in features), zero)

    def ahead(self, n: int, ending: Callable[[int], Iterable[tuple]], best: bool):
        """Forward sums (or maxima) in logs: at[j][kind] over all ways to cut the first j of n tokens, the last segment being of
        that kind. ending(j) gives the segments that end there, (i, scores, whatever back is to hold)."""
        k = len(KINDS)
        at = np.full((n + 1, k + 1), -np.inf)
        at[0, k] = 0
        back: dict[tuple[int, int], tuple] = {}
        fold = np.max if best else _logsum
        for j in range(1, n + 1):
            step = at[j - 1] + self.moves[:, k]
            ways = [[] for _ in range(k + 1)]
            ways[k].append(fold(step))
            if best:
                back[j, k] = (j - 1, int(np.argmax(step)), None)
            top = [-np.inf] * k
            for i, scores, what in ending(j):
                step = at[i][:, None] + self.moves[:, :k]
                value = fold(step, 0) + scores
                for y in range(k):
                    ways[y].append(value[y])
                    if best and value[y] > top[y]:
                        top[y] = value[y]
                        back[j, y] = (i, int(np.argmax(step[:, y])), what)
            at[j] = [fold(np.array(w)) if w else -np.inf for w in ways]
        return at, back

    def best(self, run: Run) -> list[tuple[str, int, int]]:
        at, back = self.ahead(run.n, lambda j: ((i, self.score(features), (begin, end)) for i, _, begin, end, features in run.ending(j)), True)
        j, y, out = run.n, int(np.argmax(at[-1])), []
        while j:
            i, previous, span = back[j, y]
            if span:
                out.append((KINDS[y], *span))
            j, y = i, previous
        return out[::-1]


def _logsum(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


def gold(segments: list[tuple], text: str, spans: dict[tuple[int, int], str]) -> list[tuple[int, int]]:
    """(segment, kind) for the segments that are labelled spans, from the left, the longer first."""
    out, done = [], 0
    for x in sorted(range(len(segments)), key=lambda x: (segments[x][0], -segments[x][1])):
        i, j, begin, end, features = segments[x]
        if i < done:
            continue
        kind = spans.get((begin, end))
        if kind is None and j - i == 1 and end - begin >= 8 and ("named" in features and "word" not in features or SECRET_SHAPES.fullmatch(text, begin, end)):
            kind = "secret"
        if kind:
            out.append((x, KINDS.index(kind)))
            done = j
    return out


def fit(texts: list[str], seed: int = 0) -> Model:
    """Gradient ascent on the conditional likelihood of the labelled segmentation, run by run."""
    k = len(KINDS)
    model, cases = Model({}, np.zeros((k + 1, k + 1))), []
    for text in texts:
        spans = {(b, e): kind for kind, b, e in base_spans(text)}
        for run in runs(text):
            segments = sorted(s for j in range(1, run.n + 1) for s in run.ending(j))
            cases.append((run.n, segments, gold(segments, text, spans)))
    order = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for c in order.permutation(len(cases)):
            n, segments, right = cases[c]
            scores = [model.score(s[4]) for s in segments]
            starting, ending = defaultdict(list), defaultdict(list)
            for x, s in enumerate(segments):
                starting[s[0]].append(x)
                ending[s[1]].append((s[0], scores[x], x))
            at, _ = model.ahead(n, lambda j, ending=ending: ending[j], False)
            total = _logsum(at[-1])
            after = np.full((n + 1, k + 1), -np.inf)  # after[j][kind]: all ways to go on from j
            after[-1] = 0
            move = np.zeros_like(model.moves)
            for j in range(n - 1, -1, -1):
                on = [model.moves[:, k] + after[j + 1, k]]
                move[:, k] += np.exp(at[j] + on[0] - total)
                for x in starting[j]:
                    go = model.moves[:, :k] + scores[x] + after[segments[x][1], :k]
                    p = np.exp(at[j][:, None] + go - total)
                    move[:, :k] += p
                    for f in segments[x][4]:
                        model.weights.setdefault(f, np.zeros(k))
                        model.weights[f] -= rate * p.sum(0)
                    on.append(_logsum(go, 1))
                after[j] = _logsum(np.stack(on), 0)
            model.moves -= rate * move
            previous, j = k, 0
            for x, y in [*right, (None, k)]:
                upto = segments[x][0] if x is not None else n
                while j < upto:
                    model.moves[previous, k] += rate
                    previous, j = k, j + 1
                if x is not None:
                    model.moves[previous, y] += rate
                    previous, j = y, segments[x][1]
                    for f in segments[x][4]:
                        model.weights[f][y] += rate
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Only hashes are sorted for the draw; a repeated row is drawn once. Driver and tasks hold TRAIN_DOCS texts at most."""
    held = F.col("text").rlike("[0-9@=]")
    for part in NAME_PARTS:
        held |= F.lower("text").contains(part)
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(key, text).alias("h")).where(held & (F.octet_length("text") <= TRAIN_BYTES))
    drawn = rows.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    sample = rows.where(F.col("h") <= drawn).groupBy("h").agg(F.min("text").alias("text")).collect() if drawn is not None else []
    return fit([r["text"] for r in sorted(sample)])


def find(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those and the model's that overlap none of them; by kind, then start."""
    text = text or ""
    base = base_spans(text)
    added = [s for run in runs(text) for s in model.best(run)]
    if added and base:
        covered = sorted((b, e) for _, b, e in base)
        starts = np.array([b for b, _ in covered])
        ends = np.maximum.accumulate([e for _, e in covered])
        added = [s for s in added if not ((at := int(np.searchsorted(starts, s[2]))) and ends[at - 1] > s[1])]
    return base, sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def found(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        only_memory("pii", dict)  # nothing of its own

        def handle(b):
            rows = [find(t, model) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == name for s in base) for base, _ in rows], pa.int64()) for name in KINDS[:4]]
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            every = pa.array([joined(every) for _, every in rows], pa.string()), pa.array([len(every) for _, every in rows], pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0), *counts, sha, *every], ["key", *(x.split()[0] for x in FOUND.split(", "))])

        return handle

    return by_batch(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, {FOUND}").withColumnRenamed("key", key)


def cleaned(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with personal data in `text` replaced; the other columns as they are."""
    at, kinds = docs.columns.index(text), docs.dtypes

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        only_memory("pii", dict)  # nothing of its own

        def handle(b):
            texts = pa.array([redacted(t, find(t, model)[1]) for t in b.column(at).to_pylist()], b.column(at).type)
            return pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1 :]], b.schema.names)

        return handle

    return by_batch(docs, make, ", ".join(f"`{c}` {k}" for c, k in kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return found(docs, train(docs))
