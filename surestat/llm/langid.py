"""Operator 6, language identification by a linear-chain conditional random field over the words of a text.

A word's features are its affixes and inner n-grams (2 to 4 characters, with marks at both ends) and the word itself as a
lexicon entry, all hashed into one table of weights; transitions between the languages of neighbouring words are
learned too. Forward-backward gives each word its marginals, so code-switched text is labelled word by word; a text's language is the
one with the greatest mean over its words, which is the score.

Learning takes every language that a labelled document has, TRAIN_DOCS documents of each at most, fewer if that makes more than TRAIN_TOTAL,
those of smallest hash; of a longer text a window of TRAIN_CHARS characters, whose place a hash draws. This is the documented bound. The
model has at most FEATURES rows, fewer beyond WEIGHTS numbers, so it doesn't grow with the corpus. Prediction covers every
word of every text. Chains are cut into chunks whose transfer matrices are multiplied in step, which is exact.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if nothing can be learned; ties go
to the language first in order; rows with a null doc_id are not held out, take no part in learning and are
predicted; repeated rows each give their own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, only_memory, table

FEATURES = 1 << 17
WEIGHTS, LEAST_FEATURES = 1 << 23, 1 << 12
TRAIN_DOCS, TRAIN_TOTAL, LEAST_DOCS, TRAIN_CHARS = 150, 9_600, 8, 20_000
EPOCHS, PARTS, RATE, DECAY = 4, 5, 0.5, 1e-4
#: Bytes of words and emissions that a worker remembers from batch to batch.
REMEMBERED = 64_000_000
CHUNK = 128
UNDETERMINED = "und"
_U = np.uint64


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in one flat array, and where each word's begin. Words consist of letters, lower case."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    left = np.repeat(start + size, size) - np.arange(len(codes))  # characters up to the word's end
    gram = np.zeros(len(codes), np.uint64)
    columns, there = [], []
    for n in range(1, 5):
        gram[: len(codes) - n + 1] = (gram[: len(codes) - n + 1] * _U(0x100000001B3)) ^ (codes[n - 1 :] + _U(n << 40))
        if n > 1:
            columns.append((gram * _U(0x9E3779B97F4A7C15)) >> _U(47))
            there.append(left >= n)
    weight = codes * _U(0x2545F4914F6CDD1D) ^ (codes >> _U(3))
    weight = (weight + (left.astype(np.uint64) * _U(0xD6E8FEB86659FD93))) * _U(0xBF58476D1CE4E5B9)
    lexicon = np.add.reduceat(weight, start) * _U(0x94D049BB133111EB) >> _U(47)
    columns.append(np.zeros(len(codes), np.uint64))
    columns[-1][start] = lexicon
    there.append(np.zeros(len(codes), bool))
    there[-1][start] = True
    take = np.stack(there, 1)
    flat = np.stack(columns, 1)[take].astype(np.int64)
    per_word = np.add.reduceat(take.sum(1), start)
    return flat, np.concatenate([[0], np.cumsum(per_word)[:-1]])


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    flat, start = word_features(words)
    return np.add.reduceat(weights[folded(flat, len(weights))], start, axis=0)


def folded(flat: np.ndarray, n: int) -> np.ndarray:
    """Features of a table of n rows, a power of two up to FEATURES."""
    return flat >> (FEATURES // n).bit_length() - 1


def letters(piece: str) -> str:
    return (piece if piece.isalpha() else "".join(filter(str.isalpha, piece))).lower()


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Posterior marginals (words x languages) of the chains laid end to end, of which `first` marks the first words.

    With pairs, also the expected counts of moves. A first word's incoming matrix has equal rows, so chains don't mix."""
    n, k = scores.shape
    step = np.exp(moves - moves.max())
    chunks = -(-n // CHUNK)
    psi = np.ones((chunks * CHUNK, k))
    psi[:n] = np.exp(scores - scores.max(1, keepdims=True))
    new = np.zeros(chunks * CHUNK, bool)
    new[:n] = first
    new[n : n + 1] = True  # what fills up the last chunk is a chain of its own
    psi = psi.reshape(chunks, CHUNK, k).transpose(1, 0, 2).copy()
    new = new.reshape(chunks, CHUNK).T.copy()
    product = np.broadcast_to(np.eye(k), (chunks, k, k)).copy()
    for t in range(CHUNK):
        whole = product.sum(2, keepdims=True)
        product = np.where(new[t][:, None, None], whole, product @ step) * psi[t][:, None, :]
        product /= product.max((1, 2), keepdims=True)
    into, out = np.empty((chunks, k)), np.empty((chunks, k))
    row = np.full(k, 1.0 / k)
    for g in range(chunks):
        into[g] = row
        row = row @ product[g]
        row = row / row.sum()
    row = np.ones(k)
    for g in range(chunks - 1, -1, -1):
        out[g] = row
        row = product[g] @ row
        row = row / row.sum()
    ahead = np.empty((CHUNK, chunks, k))
    a = into
    for t in range(CHUNK):
        a = np.where(new[t][:, None], a.sum(1, keepdims=True), a @ step) * psi[t]
        a = ahead[t] = a / a.sum(1, keepdims=True)
    result = np.empty((CHUNK, chunks, k))
    expected = np.zeros((k, k))
    b = out
    for t in range(CHUNK - 1, -1, -1):
        p = ahead[t] * b
        result[t] = p / p.sum(1, keepdims=True)
        c = psi[t] * b
        if pairs:
            before = ahead[t - 1] if t else into
            joint = before[:, :, None] * step[None] * c[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            real = ~new[t] & (np.arange(chunks) * CHUNK + t < n)
            expected += joint[real].sum(0)
        b = np.where(new[t][:, None], c.sum(1, keepdims=True), c @ step.T)
        b = b / b.sum(1, keepdims=True)
    return (result.transpose(1, 0, 2).reshape(-1, k)[:n], expected) if pairs else result.transpose(1, 0, 2).reshape(-1, k)[:n]


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray) -> None:
        self.languages, self.weights, self.moves = languages, weights, moves


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Adaptive-gradient ascent on the likelihood of every word's label, its text's language."""
    languages = sorted(set(labels))
    k = len(languages)
    features = FEATURES
    while features * k > WEIGHTS and features > LEAST_FEATURES:
        features //= 2
    weights, moves = np.zeros((features, k), np.float32), np.zeros((k, k))
    docs = [([w for p in t.split() if (w := letters(p))], languages.index(y)) for t, y in zip(texts, labels, strict=True)]
    docs = [d for d in docs if d[0]]
    if k < 2 or not docs:
        return Model(languages, weights, moves)
    order, seen, seen_moves = np.random.default_rng(seed), np.full((features, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(len(docs)), min(PARTS, len(docs))):
            chosen = [docs[i] for i in part]
            words = [w for d, _ in chosen for w in d]
            types, index = np.unique(np.array(words), return_inverse=True)
            flat, start = word_features(types.tolist())
            flat = folded(flat, features)
            first = np.zeros(len(words), bool)
            first[np.cumsum([0, *(len(d) for d, _ in chosen)])[:-1]] = True
            gold = np.repeat([y for _, y in chosen], [len(d) for d, _ in chosen])
            got, expected = marginals(np.add.reduceat(weights[flat], start, axis=0)[index].astype(np.float64), first, moves, True)
            wrong = -got
            wrong[np.arange(len(gold)), gold] += 1
            n = len(words)
            by_type = np.stack([np.bincount(index, wrong[:, y], len(types)) for y in range(k)], 1)
            spread = np.repeat(by_type, np.diff([*start, len(flat)]), axis=0)
            up = np.stack([np.bincount(flat, spread[:, y], features) for y in range(k)], 1).astype(np.float32) / np.float32(n) - DECAY / n * weights
            seen += up * up
            weights += RATE * up / np.sqrt(seen)
            stay = ~first
            held = np.zeros((k, k))
            np.add.at(held, (gold[:-1][stay[1:]], gold[1:][stay[1:]]), 1)
            up = (held - expected) / n - DECAY * moves
            seen_moves += up * up
            moves += RATE * up / np.sqrt(seen_moves)
    return Model(languages, weights, moves)


class Labeller:
    """Predicts with a model; remembers emissions of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at, self.held = {}, 0
        self.table = np.zeros((1024, len(self.model.languages)), np.float32)  # row 0: no letter
        self.used = 1

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces - self.at.keys())
        words = [letters(p) for p in new]
        some = [i for i, w in enumerate(words) if w]
        rows = emissions([words[i] for i in some], self.model.weights)
        while self.used + len(some) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(some)] = rows
        for p in new:
            self.at[p] = 0
        for i, at in zip(some, range(self.used, self.used + len(some)), strict=True):
            self.at[new[i]] = at
        self.used += len(some)
        self.held += sum(150 + 2 * len(p) for p in new) + 4 * len(some) * self.table.shape[1]

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of each text, their emission rows, whether each has a letter, and the marginals."""
        cut = [t.split() for t in texts]
        if self.held > REMEMBERED:
            self.forget()
        self.learn(set().union(*cut))
        rows = np.fromiter((self.at[p] for pieces in cut for p in pieces), np.int64)
        first = np.zeros(len(rows), bool)
        ends = np.cumsum([len(c) for c in cut])
        starts = ends - [len(c) for c in cut]
        first[starts[starts < ends]] = True
        got = marginals(self.table[rows].astype(np.float64), first, self.model.moves) if len(rows) else np.zeros((0, len(self.model.languages)))
        return cut, starts, rows > 0, got

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        cut, starts, lettered, got = self.words(texts)
        got = got * lettered[:, None]
        out = []
        total = np.vstack([np.zeros(got.shape[1]), np.cumsum(got, 0)])
        count = np.concatenate([[0], np.cumsum(lettered)])
        for s, c in zip(starts.tolist(), cut, strict=True):
            n = int(count[s + len(c)] - count[s])
            if not n:
                out.append((UNDETERMINED, 0.0))
                continue
            share = (total[s + len(c)] - total[s]) / n
            best = int(np.argmax(share))
            out.append((self.model.languages[best], float(min(1.0, max(0.0, share[best])))))
        return out

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """Each piece with the language of greatest marginal: the labelling of code-switched text."""
        cut, _, lettered, got = self.words([text])
        return [(p, self.model.languages[int(np.argmax(g))] if has else UNDETERMINED) for p, has, g in zip(cut[0], lettered, got, strict=True)]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Fits on documents that aren't held out. Each language's share is cut to its number before the shuffle (a window limit)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    rows = rows.where(F.col("key").isNotNull() & F.col("text").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")) & F.col("text").rlike(r"\p{L}"))
    k = rows.select("label").distinct().count()
    each = max(LEAST_DOCS, min(most, TRAIN_TOTAL // max(k, 1)))
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key", F.xxhash64("text"))
    few = rows.select("label", "key", F.row_number().over(order).alias("n")).where(F.col("n") <= each)
    few = few.select("label", "key").distinct()  # languages x each rows
    beyond = F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0))
    window = F.substring("text", (F.pmod(F.xxhash64("key"), beyond + 1) + 1).cast("int"), F.lit(TRAIN_CHARS))
    sample = rows.join(F.broadcast(few), ["label", "key"]).select("label", "key", window.alias("text")).groupBy("label", "key").agg(F.min("text").alias("text")).orderBy("label", "key").collect()
    return fit([r["text"] for r in sample], [r["label"] for r in sample])


_ready: dict[str, Labeller] = {}


def predictor(shared, token: str) -> Labeller:
    """This process's labeller of one model; an earlier model's goes."""
    only_memory("langid", _ready.clear)
    if token not in _ready:
        _ready.clear()
        _ready[token] = Labeller(Model(*shared.value))
    return _ready[token]


def predicted(docs: DataFrame, model: Model, columns: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns, then the predicted language and its score under `names`. The model is broadcast: FEATURES x languages numbers (at most 32 MB)."""
    import uuid

    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.moves))
    token = uuid.uuid4().hex
    taken = docs.select(*columns, F.col(text).alias("__text")) if text not in columns else docs.select(*columns)
    at = len(columns) if text not in columns else columns.index(text)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        labeller = predictor(shared, token)

        def handle(b):
            got = labeller.predict([t or "" for t in b.column(at).to_pylist()])
            return pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*columns, *names])

        return handle

    kinds = dict(taken.dtypes)
    return by_batch(taken, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{names[0]}` string", f"`{names[1]}` double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, train(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
