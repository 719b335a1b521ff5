"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model also gets the log-odds of all
earlier categories. While training, these are out-of-fold predictions, so a later model sees
earlier probabilities as good as those it will see on new documents, not the earlier model's
own training fit. The models are logistic regressions on the presence of words.

Models are fitted on at most ``TRAIN_ROWS`` labelled documents (those of least hash). Their words
stay on the executors: one aggregate counts each word by fold and label, the words of each fit are
chosen from these counts, and only the chosen columns of the training rows, one category at a
time, reach the driver (at most ``MOST_WORDS`` words a fit). Every document is scored whole.

Defined results: a null or empty text has no words and gets the models' intercepts; a null
label leaves the row out of training for that category, a null ``doc_id`` out of all; of several
labels of a ``doc_id`` the greatest counts, of several texts the one of least digest is trained
on; without labelled rows of both classes a category's probability is the share of its positive
labels (0 if none); repeated rows are scored one by one; ids may be of any type; an empty table
gives an empty result; extra columns are ignored (``drop_toxic`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep_texts, map_slices, materialize, table
from .hashing import mix, word_hashes

#: (category, label column, value that is positive), in the order of the chain.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
TRAIN_ROWS = 8_000
FOLDS = 5
#: The fit on all folds, beside those that leave one out.
ALL = FOLDS
#: Bytes of a word's beginning that make a feature of its own, and the counts that words are told apart by.
PREFIX = 6
LEVELS = (1, 2, 4)
#: Words of a model at most, those whose presence tells most; fewest documents for a word, and
#: least standard score of its log-odds.
MOST_WORDS = 4_000
LEAST_DOCS = 5
LEAST_SCORE = 3.0
STEPS = 150
POWER_STEPS = 12
PENALTY = 1e-4


@dataclass
class Linear:
    words: np.ndarray  # sorted word hashes
    weight: np.ndarray
    chain: np.ndarray  # weights of earlier categories' log-odds
    bias: float

    def score(self, own: np.ndarray, earlier: np.ndarray) -> float:
        z = self.bias + float(self.chain @ earlier)
        if len(self.words) and len(own):
            at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
            z += float(self.weight[at[self.words[at] == own]].sum())
        return z


@dataclass
class Chain:
    names: list[str] = field(default_factory=list)
    models: list[Linear] = field(default_factory=list)

    def log_odds(self, own: np.ndarray) -> np.ndarray:
        z = np.zeros(len(self.models))
        for k, m in enumerate(self.models):
            z[k] = np.clip(m.score(own, z[:k]), -20, 20)
        return z

    def probabilities(self, text: str | None) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(distinct_words(text))))


def distinct_words(text: str | None) -> np.ndarray:
    """Hashes of the words and word beginnings of a text, each with how often it occurs at least."""
    out = []
    for prefix in (0, PREFIX):
        own, count = np.unique(word_hashes(text, letters=True, prefix=prefix), return_counts=True)
        out += [mix(own[count >= least] ^ np.uint64(64 * prefix + least)) for least in LEVELS]
    return np.unique(np.concatenate(out))


def _words(docs: DataFrame, labels: DataFrame, categories, most: int) -> DataFrame:
    """fold, y0, y1, ... and the words of at most ``most`` labelled documents, as a written table."""
    label = [F.max((F.col(c) == v).cast("int")).alias(f"y{k}") for k, (_, c, v) in enumerate(categories)]
    wanted = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(*label).orderBy(F.xxhash64("_id"), "_id").limit(most)
    names = [f"y{k}" for k in range(len(categories))]
    # At most `most` ids and labels: small enough to broadcast whatever the size of the tables.
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("doc_id", *names).agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(words=[distinct_words(t).view(np.int64) for t in b["text"]])[["row", "fold", *names, "words"]]

    kind = "row long, fold int, " + ", ".join(f"{n} int" for n in names) + ", words array<long>"
    own = one.select(F.xxhash64("doc_id").alias("row"), fold.alias("fold"), *names, "text")
    return materialize(map_slices(own, run, kind), "training")


def _chosen(rows: DataFrame, k: int) -> dict[int, np.ndarray]:
    """The words of each fit of category ``k``, those whose presence differs most between the classes.
    They are counted and chosen on the executors."""
    y = F.col(f"y{k}")
    known = rows.where(y.isNotNull())
    sizes = np.zeros((FOLDS, 2))
    for r in known.groupBy("fold").agg(F.count("*"), F.sum(y)).collect():  # FOLDS rows
        sizes[r[0]] = r[1], r[2]
    in_fold = lambda v, f: F.sum(F.when(F.col("fold") == f, v).otherwise(0))
    counts = (known.select("fold", y, F.explode("words").alias("word")).groupBy("word")
              .agg(*[in_fold(F.lit(1), f).alias(f"n{f}") for f in range(FOLDS)], *[in_fold(y, f).alias(f"p{f}") for f in range(FOLDS)]))

    def fit_of(f: int) -> Column:
        rest = [g for g in range(FOLDS) if g != f]
        total, of = (sum((F.col(f"{c}{g}") for g in rest[1:]), F.col(f"{c}{rest[0]}")) for c in "np")
        n, n1 = sizes[rest].sum(axis=0)
        cells = [of + 0.5, F.lit(float(n1)) - of + 0.5, total - of + 0.5, F.lit(float(n - n1)) - (total - of) + 0.5]
        odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
        spread = F.sqrt(sum((F.lit(1.0) / c for c in cells[1:]), F.lit(1.0) / cells[0]))
        score = F.when(total >= LEAST_DOCS, F.abs(odds / spread)).otherwise(F.lit(0.0))
        return F.struct(F.lit(f).alias("fit"), score.alias("score"))

    scored = counts.select("word", F.explode(F.array(*map(fit_of, range(FOLDS + 1)))).alias("f")).select("word", "f.fit", "f.score")
    best = Window.partitionBy("fit").orderBy(F.desc("score"), "word")
    top = scored.where(F.col("score") >= LEAST_SCORE).withColumn("at", F.row_number().over(best)).where(F.col("at") <= MOST_WORDS)
    found: dict[int, list[int]] = {f: [] for f in range(FOLDS + 1)}
    for r in top.select("fit", "word").collect():  # at most (FOLDS + 1) * MOST_WORDS
        found[r[0]].append(r[1])
    return {f: np.sort(np.array(w, np.int64)) for f, w in found.items()}


def _matrix(rows: DataFrame, k: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fold and label (NaN: none) of the training rows, and the (row, column) places of ``words`` (sorted) in them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hold = [np.searchsorted(words, np.intersect1d(w, words, assume_unique=True)).astype(np.uint16).tobytes() for w in b["words"]]
            yield pd.DataFrame({"row": b["row"], "fold": b["fold"], "y": b[f"y{k}"], "at": hold})

    got = sorted(rows.mapInPandas(run, "row long, fold int, y int, at binary").collect())
    at = [np.frombuffer(r["at"], np.uint16) for r in got]
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) for x in at])
    col = np.concatenate(at) if at else np.empty(0, np.uint16)
    y = np.array([np.nan if r["y"] is None else r["y"] for r in got], float)
    return np.array([r["fold"] for r in got], np.int64), y, row, col


def fit(row: np.ndarray, col: np.ndarray, m: int, y: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Penalised logistic regression by accelerated gradient steps: weights of the m words, of the
    earlier log-odds, and the bias. Word ``col[i]`` is in row ``row[i]``."""
    k = earlier.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9)
        return np.zeros(m), np.zeros(k), float(np.log(p / (1 - p)))
    scaled = earlier / 4.0
    ones = np.ones(len(y))
    times = lambda u: np.bincount(row, weights=u[col], minlength=len(y)) + scaled @ u[m : m + k] + u[-1]
    back = lambda e: np.concatenate((np.bincount(col, weights=e[row], minlength=m), scaled.T @ e, [ones @ e]))
    # The greatest curvature, by power iteration, sets the step.
    u = back(ones)
    for _ in range(POWER_STEPS):
        u = back(times(u / np.linalg.norm(u)))
    step = 1 / (1.1 * np.linalg.norm(u) / len(y) / 4 + PENALTY)
    w = np.zeros(m + k + 1)
    w[-1] = np.log(share / (1 - share))
    v, keep = w.copy(), np.append(np.full(m + k, PENALTY), 0.0)
    for i in range(STEPS):
        e = (1 / (1 + np.exp(-np.clip(times(v), -30, 30))) - y) / len(y)
        new = v - step * (back(e) + keep * v)
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:m], w[m : m + k] / 4.0, float(w[-1])


def _fits(spark, data: tuple, chosen: dict[int, np.ndarray], words: np.ndarray) -> list:
    """(weights, chain weights, bias, out-of-fold log-odds) of each fit of a category. The fits run beside
    each other on the executors; ``data`` is bounded by ``TRAIN_ROWS`` and ``MOST_WORDS``."""
    shared = spark.sparkContext.broadcast((data, chosen, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fold, y, row, col, earlier), chosen, words = shared.value
        for b in batches:
            for f in b["id"].tolist():
                mine = np.searchsorted(words, chosen[f])
                place = np.full(len(words), -1)
                place[mine] = np.arange(len(mine))
                here = place[col] >= 0
                trained = ~np.isnan(y) & (fold != f)
                number = np.cumsum(trained) - 1
                use = here & trained[row]
                weight, back, bias = fit(number[row[use]], place[col[use]], len(mine), y[trained], earlier[trained])
                z = np.bincount(row[here], weights=weight[place[col[here]]], minlength=len(y)) + earlier @ back + bias
                yield pd.DataFrame([(f, weight.tobytes(), back.tobytes(), bias, z.tobytes())], columns=["fit", "weight", "back", "bias", "z"])

    many = FOLDS + 1
    got = spark.range(0, many, 1, many).mapInPandas(run, "fit long, weight binary, back binary, bias double, z binary").collect()
    shared.unpersist()
    numbers = lambda x: np.frombuffer(x, float)
    return [(numbers(r["weight"]), numbers(r["back"]), r["bias"], numbers(r["z"])) for r in sorted(got, key=lambda r: r["fit"])]


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, most: int = TRAIN_ROWS) -> Chain:
    """Fit the chain on at most ``most`` labelled documents."""
    rows = _words(docs, labels, categories, most)
    chain, earlier = Chain(), None
    for k, (name, _, _) in enumerate(categories):
        chosen = _chosen(rows, k)
        words = np.unique(np.concatenate(list(chosen.values())))
        fold, y, row, col = _matrix(rows, k, words)
        earlier = np.zeros((len(y), 0)) if earlier is None else earlier
        fits = _fits(docs.sparkSession, (fold, y, row, col, earlier), chosen, words)
        own = chosen[ALL].view(np.uint64)
        order = np.argsort(own)
        weight, back, bias, _ = fits[ALL]
        chain.names.append(name)
        chain.models.append(Linear(own[order], weight[order], back, bias))
        z = np.stack([x[3] for x in fits[:ALL]])
        earlier = np.column_stack((earlier, np.clip(z[fold, np.arange(len(y))], -20, 20)))
    discard(rows)
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability per category, and whether the last category reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most MOST_WORDS numbers a category
    names = list(chain.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.array([shared.value.probabilities(t) for t in b["text"]]).reshape(len(b), len(names))
            yield pd.DataFrame({"doc_id": b["doc_id"], **{f"p_{n}": p[:, k] for k, n in enumerate(names)}})

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"p_{n} double" for n in names)
    return map_slices(docs.select("doc_id", "text"), run, kind).withColumn("rejected", F.col(f"p_{names[-1]}") >= threshold)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The documents whose last category stays below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    return keep_texts(docs, lambda text: shared.value.probabilities(text)[-1] < threshold)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
