"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Two things are judged: whether a text is junk, and whether it is toxic. Each has a few overlapping heuristic
labellers that vote 1 (bad), 0 (good) or -1 (no opinion). Expectation-maximisation over the votes of all
documents estimates how often each labeller is right; from that follows each document's probability of
being bad. With these probabilities as labels a linear scorer over hashed words and votes is trained, and
scores every document. Documents with a score of 1/2 or more in either are rejected.

The toxic labellers weigh the words of a lexicon. It holds stems, which are whole words and their first `STEMS`
bytes, so that rare forms of a word count together. A stem's weight is the lower bound of its log-odds of toxic
against clean documents (smoothed, `DEVIATIONS` standard errors off); there is no least count. The toxic labels are
also what the toxic scorer learns. For that each labelled document gets its votes from a lexicon made without its own
fifth of the labels, so that the scorer sees votes as reliable as those of unseen documents.

The lexicon and the scorer are fitted on at most `SAMPLE` labelled documents, those with the
smallest hashes of doc_id. The votes are counted over all documents.

A null or empty text has no words; it counts as junk. A label row with a null is not used; of repeated labels of
one document the worst counts. Without labels the lexicon is empty, nothing is
toxic, and the scorer is trained on as many documents without labels. Rows with equal doc_id are
scored each by itself; extra columns are carried along by `classify`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cuetrace.llm.jobs import arrow_map, store
from cuetrace.llm.words import PUNCTUATION, SPACE, chunks, words_of
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

SAMPLE = 6_000
BUCKETS = 1 << 16
STEMS = (4, 5, 6, 7, 8)
DEVIATIONS, LEAST_WEIGHT, FOLDS = 2.0, 1.0, 5
FALSE_ALARMS, PRIOR_DOCUMENTS = 0.002, 3
EM_ROUNDS, STEPS, RATE, DECAY = 50, 80, 0.5, 1e-4
SYMBOLS = b"#*$%&@^~<>{}\\"

JUNK = ("symbols", "pipes", "shouting", "repeats", "letters", "bare_marks", "variety", "empty")
TOXIC = ("little_evidence", "some_evidence", "much_evidence", "share_of_words")


@dataclass
class Features:
    """Votes (documents x labellers) and the distinct word hashes of each document."""

    junk: np.ndarray
    toxic: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    stems: np.ndarray  # of each word: itself and its beginnings, 0 for those it is too short for


@dataclass
class Lexicon:
    """Hashes of toxic stems in ascending order, and their weights."""

    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def weigh(self, stems: np.ndarray) -> np.ndarray:
        """The largest weight among each word's stems, 0 without any."""
        best = np.zeros(len(stems))
        if len(self.stems):
            for column in stems.T:
                at = np.minimum(np.searchsorted(self.stems, column), len(self.stems) - 1)
                np.maximum(best, np.where(self.stems[at] == column, self.weights[at], 0.0), out=best)
        return best


def _three(value: np.ndarray, bad: float, good: float) -> np.ndarray:
    return np.where(value >= bad, 1, np.where(value < good, 0, -1)).astype(np.int8)


def features(column: pa.Array, lexicon: Lexicon) -> Features:
    """Votes and words of a column of texts."""
    plain = words_of(column)
    n_docs = len(plain.offsets) - 1

    def per_doc(flags: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=flags, minlength=n_docs)

    sizes = np.maximum(1, np.diff(plain.offsets))
    byte_doc = np.repeat(np.arange(n_docs), np.diff(plain.offsets))
    is_symbol, is_letter = np.zeros(256, bool), np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    is_letter[[*range(65, 91), *range(97, 123), *range(128, 256), *SPACE, *b".,"]] = True
    n_words = np.maximum(1, per_doc(np.ones(len(plain.doc)), plain.doc))
    first, last, length = plain.data[plain.starts], plain.data[plain.ends - 1], plain.ends - plain.starts
    same = np.zeros(len(plain.doc), bool)
    same[1:] = (plain.hashes[1:] == plain.hashes[:-1]) & (plain.doc[1:] == plain.doc[:-1])

    lettered = np.concatenate([[0], np.cumsum(is_letter[plain.data] & (plain.data > 0x2E))])
    bare = lettered[plain.ends] == lettered[plain.starts]

    w = words_of(column, lower=True, separators=SPACE + PUNCTUATION)
    order = np.lexsort((w.hashes, w.doc))
    doc, words = w.doc[order], w.hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (words[1:] != words[:-1])
    doc, words, order = doc[fresh], words[fresh], order[fresh]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    stems = [words]
    begin, end = w.starts[order], w.ends[order]
    for size in STEMS:
        cut = w.span_hashes(begin, np.minimum(begin + size, end)) + np.uint64(size)
        stems.append(np.where(end - begin >= size, cut, np.uint64(0)))
    stems = np.stack(stems, axis=1)
    count = np.maximum(1, per_doc(np.ones(len(w.doc)), w.doc))
    variety = per_doc(np.ones(len(doc)), doc) / np.sqrt(count)
    junk = np.stack([
        _three(per_doc(is_symbol[plain.data], byte_doc) / sizes, 0.01, 0.002),
        _three(per_doc((first == 0x7C) & (length == 1), plain.doc) / n_words, 0.05, 0.005),
        _three(per_doc((last == 0x21), plain.doc) / n_words, 0.1, 0.02),
        _three(per_doc(same, plain.doc) / n_words, 0.15, 0.05),
        _three(1 - per_doc(is_letter[plain.data], byte_doc) / sizes, 0.06, 0.03),
        _three(per_doc(bare, plain.doc) / n_words, 0.1, 0.02),
        np.where(count < 50, -1, np.where(variety < 3.0, 1, 0)).astype(np.int8),
        np.where(np.bincount(w.doc, minlength=n_docs) == 0, 1, -1).astype(np.int8),
    ], axis=1)
    return Features(junk, toxic_votes(lexicon.weigh(stems), doc, n_docs), words, bounds, stems)


def toxic_votes(weights: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Votes of the toxic labellers from the weights of each document's distinct words."""
    count = np.bincount(doc, minlength=n_docs)
    evidence = np.bincount(doc, weights=weights, minlength=n_docs)
    # By chance clean documents hold stems too, and long ones more of them.
    beyond = evidence / np.sqrt(np.maximum(count, 20))
    return np.stack([
        _three(beyond, 0.3, 0.15),
        _three(beyond, 0.4, 0.3),
        _three(beyond, 0.5, 0.4),
        _three(evidence / np.maximum(count, 20), 0.03, 0.01),
    ], axis=1)


@dataclass
class WeakLabels:
    """Share of bad documents, and each labeller's probabilities of its votes in good and bad documents.

    Bad documents are of several kinds, each seen by a few labellers only. So that no kind is taken for good, the
    estimate has a prior: labellers are made such that they seldom call a good document bad.
    """

    prior: float
    votes: np.ndarray  # labeller x (good, bad) x (vote 0, vote 1)

    @classmethod
    def fit(cls, counts: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> WeakLabels:
        """From the number of documents with each pattern of votes. Starts from: a bad vote is right."""
        if not counts:
            return cls(0.0, np.full((max(len(JUNK), len(TOXIC)), 2, 2), 0.5))
        patterns = np.array(list(counts), np.int8)
        number = np.array(list(counts.values()), float)
        bad = np.where((patterns == 1).any(axis=1), 0.9, 0.05)
        for _ in range(rounds):
            weights = np.stack([number * (1 - bad), number * bad])
            votes = np.stack([[[(w * (patterns[:, j] == v)).sum() + 0.1 for v in (0, 1)] for w in weights]
                              for j in range(patterns.shape[1])])
            votes[:, 0] += PRIOR_DOCUMENTS * number.sum() * np.array([1 - FALSE_ALARMS, FALSE_ALARMS])
            model = cls(float((number * bad).sum() / number.sum()), votes / votes.sum(axis=2, keepdims=True))
            bad = model.posterior(patterns)
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of bad for each row of votes."""
        prior = min(max(self.prior, 1e-6), 1 - 1e-6)
        logit = np.full(len(patterns), np.log(prior / (1 - prior)))
        for j in range(patterns.shape[1]):
            ratio = np.log(self.votes[j, 1] / self.votes[j, 0])
            logit += np.where(patterns[:, j] >= 0, ratio[np.maximum(patterns[:, j], 0)], 0.0)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def hashed(votes: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: document, bucket, value. Votes have buckets of their own behind those of the words."""
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(votes)), counts)
    value = (1 / np.sqrt(np.maximum(counts, 1)))[doc]
    at, labeller = np.nonzero(votes >= 0)
    bucket = (words % np.uint64(BUCKETS)).astype(np.int32)
    own = (BUCKETS + 1 + 2 * labeller + votes[at, labeller]).astype(np.int32)
    return (np.concatenate([doc, at, np.arange(len(votes))]).astype(np.int32),
            np.concatenate([bucket, own, np.full(len(votes), BUCKETS, np.int32)]),
            np.concatenate([value, np.ones(len(at) + len(votes))]))


def train(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by full gradients with per-weight rates."""
    weights = np.zeros(BUCKETS + 1 + 2 * max(len(JUNK), len(TOXIC)))
    if not len(target):
        return weights
    squares = np.full(len(weights), 1e-8)
    for _ in range(STEPS):
        score = np.bincount(doc, weights=weights[bucket] * value, minlength=len(target))
        wrong = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / len(target)
        gradient = np.bincount(bucket, weights=wrong[doc] * value, minlength=len(weights)) + DECAY * weights
        squares += gradient ** 2
        weights -= RATE * gradient / np.sqrt(squares)
    return weights


@dataclass
class Classifier:
    lexicon: Lexicon
    weak: dict[str, WeakLabels] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, column: pa.Array) -> dict[str, np.ndarray]:
        found = features(column, self.lexicon)
        out = {}
        for name, votes in (("junk", found.junk), ("toxic", found.toxic)):
            doc, bucket, value = hashed(votes, found.words, found.bounds)
            score = np.bincount(doc, weights=self.weights[name][bucket] * value, minlength=len(votes))
            out[name] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return out


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """From text, label_toxic and fold: for each fold the lexicon of all other folds, at the end that of all."""
    def count(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = features(part.column("text"), Lexicon())
                toxic = part.column("label_toxic").to_numpy() > 0
                fold = part.column("fold").to_numpy()
                doc = np.repeat(np.arange(len(toxic)), np.diff(found.bounds))
                for number in np.unique(fold).tolist():
                    own = fold[doc] == number
                    bad = toxic[doc[own]]
                    stems, at = np.unique(found.stems[own], return_inverse=True)
                    at = at.reshape(-1, len(STEMS) + 1)
                    n_bad, n_all = (np.bincount(at[rows].ravel(), minlength=len(stems)) for rows in (bad, slice(None)))
                    real = stems != 0
                    # Stem 0 stands for all words.
                    yield {"stem": np.append(stems[real].view(np.int64), 0),
                           "fold": np.full(real.sum() + 1, number),
                           "bad": np.append(n_bad[real], bad.sum()),
                           "good": np.append((n_all - n_bad)[real], (~bad).sum())}

    parts = [F.when(F.col("fold") != k, F.col(c)).otherwise(0) for c in ("bad", "good") for k in range(FOLDS + 1)]
    names = [f"{c}{k}" for c in ("bad", "good") for k in range(FOLDS + 1)]
    counts = store(arrow_map(sample, count, "stem long, fold int, bad long, good long").groupBy("stem").agg(
        *(F.sum(part).alias(name) for part, name in zip(parts, names))), "stem-counts")
    total = counts.filter("stem = 0").first()
    if total is None:
        return [Lexicon()] * (FOLDS + 1)

    def bound(k: int) -> Column:
        bad, good = F.col(f"bad{k}") + 0.5, F.col(f"good{k}") + 0.5
        odds = F.log(bad / good) + F.lit(float(np.log((total[f"good{k}"] + 1) / (total[f"bad{k}"] + 1))))
        return F.when(F.col(f"bad{k}") > 0, odds - DEVIATIONS * F.sqrt(1 / bad + 1 / good)).otherwise(-1.0)

    weights = [bound(k).alias(f"w{k}") for k in range(FOLDS + 1)]
    kept = counts.filter("stem <> 0 and bad%d > 0" % FOLDS).select("stem", *weights).filter(
        F.greatest(*(F.col(f"w{k}") for k in range(FOLDS + 1))) >= LEAST_WEIGHT).collect()
    stems = np.array([r["stem"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(stems)
    out = []
    for k in range(FOLDS + 1):
        own = np.array([r[f"w{k}"] for r in kept], float)[order]
        out.append(Lexicon(stems[order][own >= LEAST_WEIGHT], own[own >= LEAST_WEIGHT]))
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` labels by the hashes of their ids, with their documents' texts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label_quality"), F.max("toxic").alias("label_toxic"))
    chosen = store(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "label-sample")
    # Equal texts are in one fold.
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    return store(documents.select("doc_id", "text", fold).join(chosen, "doc_id"), "labelled")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    known = labelled_sample(documents, labels, sample)
    *others, lexicon = learn_lexicons(known)

    def words(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = features(part.column("text"), Lexicon())
                doc = np.repeat(np.arange(len(part)), np.diff(found.bounds))
                fold = part.column("fold").to_numpy()
                weights = np.zeros(len(doc))
                for number in np.unique(fold).tolist():
                    own = fold[doc] == number
                    weights[own] = others[number].weigh(found.stems[own])
                toxic = toxic_votes(weights, doc, len(part))
                yield {"label": part.column("label_toxic"), "junk": pa.array(found.junk.tolist()),
                       "toxic": pa.array(toxic.tolist()),
                       "words": [found.words[a:b].tobytes() for a, b in zip(found.bounds, found.bounds[1:])]}

    schema = "label long, junk array<int>, toxic array<int>, words binary"
    rows = arrow_map(known, words, schema).collect()  # at most `sample` labels
    labelled = bool(rows)
    if not rows:
        some = documents.select("text", F.lit(0).alias("fold"), F.lit(0).alias("label_toxic"))
        rows = arrow_map(some.orderBy(F.xxhash64("text")).limit(sample), words, schema).collect()
    each = [np.frombuffer(r["words"], np.uint64) for r in rows]
    model = Classifier(lexicon)

    def votes(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = features(part.column("text"), lexicon)
                counts = Counter(zip(map(bytes, found.junk + 1), map(bytes, found.toxic + 1)))
                yield {"junk": [list(j) for j, _ in counts], "toxic": [list(t) for _, t in counts],
                       "n": list(counts.values())}

    # As many rows as there are patterns of votes, whatever the number of documents.
    patterns = arrow_map(documents.select("text"), votes, "junk array<int>, toxic array<int>, n long").groupBy(
        "junk", "toxic").agg(F.sum("n").alias("n")).collect()
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in each])]).astype(np.int64)
    sampled = {name: np.array([r[name] for r in rows], np.int8).reshape(-1, len(labellers))
               for name, labellers in (("junk", JUNK), ("toxic", TOXIC))}
    flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
    for name in ("junk", "toxic"):
        counts: Counter = Counter()
        for row in patterns:
            counts[tuple(v - 1 for v in row[name])] += row["n"]
        model.weak[name] = WeakLabels.fit(counts)
        target = model.weak[name].posterior(sampled[name])
        if name == "toxic" and labelled:
            target = np.array([r["label"] > 0 for r in rows], float)
        model.weights[name] = train(*hashed(sampled[name], flat, bounds), target)
    return model


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents with `junk_score` and `toxic_score`."""
    documents = documents.drop("junk_score", "toxic_score")
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample))
    schema = StructType([*documents.schema.fields, StructField("junk_score", DoubleType()),
                         StructField("toxic_score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                scores = model.value.scores(part.column("text"))
                yield pa.record_batch([*part.columns, pa.array(scores["junk"]), pa.array(scores["toxic"])],
                                      schema=arrow)

    return documents.mapInArrow(run, schema)


def accepted() -> Column:
    return (F.col("junk_score") < 0.5) & (F.col("toxic_score") < 0.5)
