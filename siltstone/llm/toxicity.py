"""Operator 7: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon that is learnt from labelled rows, nearness of its words to second-person
words, capitals, punctuation and obfuscation rates, length.  Training rows fall into three folds by a hash of the text, so
that exact copies share a fold: the features of a fold's rows come from a lexicon of the other two, and the calibration
from scores by trees of the other two.  Labels are read from rows whose
crc32(doc_id as text) mod 4 is not 2 alone; a score depends on nothing but the text.

About SAMPLE distinct labelled texts at most, spread evenly by hashes, are used for fitting, however often rows, labels or
doc_ids repeat; what reaches the driver is their dense features and at most LEXICON words a lexicon.  Those two and
MOST_LETTERS, beyond which a word isn't learnt (it may still be found by its beginning), are parameters of the fit alone:
scoring takes every word of every whole text, in one pass without a shuffle.

Defined results: a null text counts as empty and is scored like any other; with no labelled rows of one of the two kinds
all scores are the share of toxic rows among them (0 without any); repeated or clashing labels of a doc_id, and those of
equal texts, count as the largest; a null doc_id is not held out.  `classified` reads doc_id and text alone, `clean` passes
all columns through, whatever their names.  A text's words are held while it is scored, about 100 bytes a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import forget
from siltstone.llm.common import free_name, saved

SAMPLE = 30_000  #: labelled texts that are used for fitting, at most (about)
LEXICON = 1_500  #: words
MOST_LETTERS = 40  #: of a word that is learnt
THRESHOLD = 0.3
LEAST_TEXTS = 3  #: distinct toxic texts that a word must be in
LEAST_ODDS = 2.5  #: and its log-odds
FOLDS = 3
SLICE = 256  #: rows of a batch that are taken apart at a time
NEAR = 4  #: words between a lexicon word and a second-person word that count as near

#: Second-person words of the corpus's languages.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr euch usted ustedes ti tus vosotros os".split())
#: Common insults, in the lexicon before anything is learnt.
INSULTS = frozenset("idiot idiots moron morons imbecile stupid dumb fool loser losers scum trash garbage pathetic worthless clown disgusting jerk creep pig filth vermin bastard bitch asshole dumbass retard scumbag coward connard salope idiote crétin imbécile débile ordure pourri arschloch idiotin dummkopf trottel depp schwein abschaum hurensohn imbécil estúpido estúpida tonto tonta basura gilipollas cabrón puta mierda".split())
INSULT_WEIGHT = 4.0
#: Signs that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": "", "+": "t", "€": "e", "|": "l"})
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$*") + "«»“”„‘’…¿¡"
_INNER = re.compile(r"[^\W\d_][0-9@$!*_+|€.-]+[^\W\d_]|[0-9@$][^\W\d_]{2}")

FEATURES = ("hits", "distinct", "density", "weight", "most", "near_second", "hidden_hits", "hidden_rate", "capitals", "shouted", "exclaim", "punctuation", "digits", "second", "log_words", "longest_run")


def tokens(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(_EDGES))]


def entries(word: str) -> list[str]:
    """What a word can be in the lexicon as: itself, and its first five or four letters followed by a star."""
    return [word, *(word[:n] + "*" for n in (5, 4) if len(word) > n)]


class Words(dict):
    """A word as it stands in a text -> 0 for the many that say nothing, else (lexicon entry, weight, hidden, odd, second, shouted)."""

    def __init__(self, lexicon: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def entry(self, word: str) -> str:
        return next((e for e in entries(word) if e in self.lexicon), "")

    def __missing__(self, x: str) -> tuple | int:
        if len(self) >= self.limit:
            self.clear()
        w = x.lower().strip(_EDGES)
        found, hidden, odd = self.entry(w), 0, 0
        if not found and not w.isalpha() and _INNER.search(w):
            odd = 1
            found = self.entry(w.translate(LEET))
            hidden = int(bool(found))
        shouted, second = int(len(x) > 2 and x.isupper()), int(w in SECOND)
        out = (found, self.lexicon.get(found, 0.0), hidden, odd, second, shouted) if found or odd or second or shouted else 0
        if len(x) <= 64:
            self[x] = out
        return out


def features(text: str, words: Words) -> list[float]:
    """The dense features, in the order of FEATURES."""
    raw = text.split()
    said = [(k, c) for k, c in enumerate(map(words.__getitem__, raw)) if c]
    n, chars = max(1, len(raw)), max(1, len(text))
    hits = [(k, c[0], c[1]) for k, c in said if c[0]]
    second = [k for k, c in said if c[4]]
    near = at = 0
    for k, _, _ in hits:
        while at < len(second) and second[at] < k - NEAR:
            at += 1
        near += at < len(second) and second[at] <= k + NEAR
    weights = [w for _, _, w in hits]
    capitals = len(_CAPITALS.findall(text))
    marks = sum(map(text.count, ".,;:?\"'()|#&%"))
    digits = sum(map(text.count, "0123456789"))
    run = max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)
    return [
        len(hits), len({e for _, e, _ in hits}), 100 * len(hits) / n, sum(weights), max(weights, default=0.0), near,
        sum(c[2] for _, c in said), 100 * sum(c[3] for _, c in said) / n, capitals / chars, sum(c[5] for _, c in said) / n,
        100 * text.count("!") / chars, marks / chars, digits / chars, 100 * len(second) / n, math.log1p(len(raw)), run,
    ]


_RUN = re.compile(r"([^\W\d_])\1{3,}")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")


# --- the model ---------------------------------------------------------------------------------------------------


def _bin_edges(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1])) for c in x.T]


@dataclass
class Trees:
    """Additive trees of fixed depth on the log-odds, fitted on binned features by gradients and curvatures."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, threshold per node; values per leaf
    depth: int = 3

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.2, damp: float = 2.0, least: float = 2.0) -> Trees:
        edges = _bin_edges(x)
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, int)
        width = max((len(e) for e in edges), default=0) + 1
        p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start = math.log(p / (1 - p))
        raw = np.full(len(y), self.start)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-raw))
            g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            node = np.zeros(len(y), int)
            which, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                base, n = 2**level - 1, 2**level
                best = np.zeros(n)
                total_g, total_h = np.bincount(node, g, n), np.bincount(node, h, n)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = node * width + codes[:, f]
                    gl, hl = (np.cumsum(np.bincount(key, w, n * width).reshape(n, width), 1)[:, : len(e)] for w in (g, h))
                    gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                    gain = gl**2 / (hl + damp) + gr**2 / (hr + damp) - (total_g**2 / (total_h + damp))[:, None]
                    gain[(hl < least) | (hr < least)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    better = top > best + 1e-9
                    best[better], which[base : base + n][better], cut[base : base + n][better] = top[better], f, e[k[better]]
                node = 2 * node + (x[np.arange(len(y)), which[base + node]] > cut[base + node])
            value = rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + damp)
            self.trees.append((which, cut, value))
            raw = raw + value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for which, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, which[at]] > cut[at])
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing steps that fit y best, by pooling neighbours: each step's largest score, and its (smoothed) share of ones."""
    blocks: list[list[float]] = []  # sum, count, largest score
    for s in np.unique(score):
        here = y[score == s]
        blocks.append([float(here.sum()), float(len(here)), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], last[2]]
    mean = float(y.mean())
    return np.array([b[2] for b in blocks]), np.array([(b[0] + mean) / (b[1] + 1) for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray] | None
    prior: float
    words: Words | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.steps is None or not texts:
            return np.full(len(texts), self.prior)
        self.words = self.words or Words(self.lexicon)
        raw = self.trees.raw(np.array([features(t, self.words) for t in texts], float).reshape(len(texts), -1))
        top, share = self.steps
        if len(top) == 1:
            return np.full(len(texts), share[0])
        # Between two steps the score rises evenly, so that texts with one calibrated share still keep an order.
        return np.clip(np.interp(raw, top, np.maximum.accumulate(share)), 0, 1)


# --- fitting -----------------------------------------------------------------------------------------------------


def held_out():  # noqa: ANN201
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _thinned(rows: DataFrame, by: str, key: list, n: int, most: int) -> DataFrame:
    """About `most` of n rows, by a hash of their key."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(by), *key), F.lit(1 << 20)) < int((1 << 20) * most / n))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic, fold of the sampled labelled texts, a row each.  The keys that may be broadcast are at most about
    `sample`; so are the texts that are shuffled, as rows that share a sampled doc_id are counted, and thinned, before."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    marked = marked.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = _thinned(marked, "sample", ["doc_id"], marked.count(), sample)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = picked.join(F.broadcast(marked), "doc_id")
    rows = _thinned(rows, "rows", ["doc_id", "text"], rows.count(), 2 * sample)
    # Copies of a text would only weigh it more: each counts once.
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int").alias("fold"))


def learn_lexicons(rows: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Entries that distinct toxic texts hold far more often than others, with their log-odds: a lexicon from all but the
    fold k for each k, and last one from all folds.  One grouped count gives them all."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, len(b), SLICE)):
            got = zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True)
            rows = [(e, y, f) for t, y, f in got for e in {e for w in set(tokens(t)) if len(w) <= MOST_LETTERS for e in entries(w)}]
            cols = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["word", "toxic", "fold"])

    per_fold = {r.fold: (float(r.a), float(r.n)) for r in rows.groupBy("fold").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).collect()}
    by_fold = [F.sum(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{name}{k}") for k in range(FOLDS) for name, v in (("a", F.col("toxic")), ("n", F.lit(1)))]
    counts = saved(rows.mapInArrow(words, "word string, toxic int, fold int").groupBy("word").agg(*by_fold).where("a0 + a1 + a2 >= 2"), "toxicity-words")
    out = []
    for left_out in (*range(FOLDS), None):
        folds = [k for k in range(FOLDS) if k != left_out]
        p = sum(per_fold.get(k, (0, 0))[0] for k in folds)
        q = sum(per_fold.get(k, (0, 0))[1] for k in folds) - p
        a, n = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in "an")
        odds = F.log((a + 0.5) / (p + 1)) - F.log((n - a + 0.5) / (q + 1))
        least = F.when(F.col("word").endswith("*"), LEAST_TEXTS + 2).otherwise(LEAST_TEXTS)
        good = counts.withColumns({"a": a, "w": odds}).where((F.col("a") >= least) & (F.col("w") >= LEAST_ODDS))
        top = good.orderBy((F.col("w") * F.sqrt("a")).desc(), "word").limit(size).collect()
        out.append(dict.fromkeys(INSULTS, INSULT_WEIGHT) | {r.word: float(r.w) for r in top})
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = saved(training_rows(docs, labels, sample), "toxicity-rows")
    *partial, lexicon = learn_lexicons(rows)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = [Words(x) for x in partial]
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, len(b), SLICE)):
            folds = batch.column("fold")
            x = [features(t, words[f]) for t, f in zip(batch.column("text").to_pylist(), folds.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic"), folds], ["x", "y", "fold"])

    got = rows.mapInArrow(dense, "x array<double>, y int, fold int").toPandas()  # at most about 2 * `sample` rows
    y, fold = (got.y.to_numpy() > 0).astype(float), got.fold.to_numpy()
    prior = float(y.mean()) if len(y) else 0.0
    if not 0 < prior < 1:
        return Model(lexicon, Trees(), None, prior)
    x = np.array(got.x.tolist(), float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; the sums below shouldn't depend on it
    x, y, fold = x[order], y[order], fold[order]
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        mine, others = fold == k, fold != k
        if mine.any():
            fair = others if 0 < y[others].sum() < others.sum() else fold >= 0
            raw[mine] = Trees().fit(x[fair], y[fair]).raw(x[mine])
    return Model(lexicon, Trees().fit(x, y), isotonic(raw, y), prior)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in `column` (in place of one of that name)."""
    rest = docs.drop(column)
    schema = T.StructType([*rest.schema.fields, T.StructField(column, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by LEXICON and the trees' number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column("text")
            s = [shared.value.scores([t or "" for t in texts.slice(lo, SLICE).to_pylist()]) for lo in range(0, len(batch), SLICE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *s]))], [*batch.schema.names, column])

    return rest.mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, sample)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(picked, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that score THRESHOLD or more."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels, sample), name).where(F.col(name) < THRESHOLD).drop(name)
