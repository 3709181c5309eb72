"""Quality and toxicity classifiers from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns (for each task at most three to the power of its labellers, whatever the corpus) estimates each labeller's
confusion with the hidden class; the posteriors of a bounded sample of documents train a linear scorer on hashed
features, which then scores every document. Bounds: about ``sample_rows`` documents train the scorer, about
``labelled_rows`` of the labelled rows give the learned words, at most LEARNED_WORDS; counts, posteriors and scores cover
all rows.

Labellers of a task look at different things, as the model takes them to err independently: for toxicity a list of
insults, and two halves of the learned words without those.

Defined results: a null or empty text gets the votes of a text without words and the scorer's bias; a text of any length
is read whole; texts that tie in the sample's hash are in it together; repeated rows score alike; rows whose label is
null, and labels of unknown documents, teach nothing; without labels no words are learned and their labellers abstain;
an empty table gives an empty table. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, column, decoded, mapped, texts
from .html import _STOP

BUCKETS = 1 << 16
SAMPLE_ROWS = 6000
LABELLED_ROWS = 20_000
LEARNED_WORDS = 2000
#: Insults by language.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb clown trash garbage pathetic worthless scum loser losers disgusting jerk imbecile filth vermin braindead",
    "de": "idiot idioten trottel dumm dummkopf abschaum versager widerlich wertlos erbärmlich",
    "fr": "idiot idiote crétin imbécile stupide ordure pathétique minable dégoûtant",
    "es": "idiota idiotas imbécil estúpido estúpida basura patético escoria asqueroso inútil",
}
_INSULTS = frozenset(w for ws in INSULTS.values() for w in ws.split())
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_MARKS = b"#*$%&|<>=~^_\\{}[]@+"
GOOD, BAD, NOTHING = 1, 0, 2
#: The most that a labeller is taken to call bad among good documents.
FALSE_ALARMS = 0.005


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NOTHING


class _Words(dict):
    """What is asked of a word, kept for the words seen lately: its plain form and bucket, and whether it is in capitals, without letters, a stop word, an insult, marked."""

    LIMIT, BYTES = 400_000, 100_000_000

    def __init__(self) -> None:
        self.held = 0

    def __missing__(self, w: bytes) -> tuple:
        if len(self) > self.LIMIT or self.held > self.BYTES:
            self.clear()
            self.held = 0
        plain = decoded(w).strip(".,;:!?\"'()*#$%&|<>").lower()
        capitals = len(w) > 2 and w[:3].isupper()
        no_letters = len(w.translate(None, _LETTERS)) == len(w)
        flags = capitals | no_letters << 1 | (plain in _STOP) << 2 | (plain in _INSULTS) << 3 | (len(w.translate(None, _MARKS)) < len(w)) << 4
        self[w] = got = (plain, 16 + xxhash.xxh3_64_intdigest(plain) % (BUCKETS - 16), int(flags))
        self.held += 2 * len(w) + 200
        return got


_KNOWN = _Words()


class View:
    """What labellers and features look at, made once for a text."""

    def __init__(self, raw: bytes, learned: frozenset[str] = frozenset()):
        words = raw.split()
        self.n = max(1, len(words))
        sizes = Counter(words)
        known = list(map(_KNOWN.__getitem__, sizes))
        self.amounts = np.fromiter(sizes.values(), np.int64, len(sizes))
        self.buckets = np.fromiter([k[1] for k in known], np.int64, len(known))
        flags = np.fromiter([k[2] for k in known], np.int64, len(known))
        share = lambda bit: float(self.amounts[flags >> bit & 1 == 1].sum()) / self.n
        letters = len(raw.translate(None, SPACES)) or 1
        self.marks = (len(raw) - len(raw.translate(None, _MARKS))) / letters
        self.shouts = raw.count(b"!") / self.n
        self.capitals, self.no_letters, self.stops, self.marked = share(0), share(1), share(2), share(4)
        self.insults = int(self.amounts[flags >> 3 & 1 == 1].sum())
        found = [k[0] for k in known if k[0] in learned] if learned else []
        self.learned = len(found)
        # Two labellers have a half of the learned words each.
        self.halves = [sum(zlib.crc32(w.encode()) % 2 == k for w in found) if learned else None for k in (0, 1)]
        self.top = int(self.amounts.max(initial=0)) / self.n
        self.distinct = len(sizes) / self.n
        self.pairs = len(set(zip(words, words[1:], strict=False))) / self.n


#: Labellers by task; each gives GOOD, BAD or NOTHING.
LABELLERS = {
    "quality": [
        lambda v: _vote(v.marks > 0.05, v.marks < 0.01),
        lambda v: _vote(v.shouts > 0.2, v.shouts < 0.02),
        lambda v: _vote(v.capitals > 0.3, v.capitals < 0.05),
        lambda v: _vote(v.no_letters > 0.15, v.no_letters < 0.03),
        lambda v: _vote(v.stops < 0.03 and v.n > 20, v.stops > 0.12),
        lambda v: _vote(v.top > 0.2 and v.n > 20, v.top < 0.12 and v.n > 20),
        lambda v: _vote(v.distinct < 0.15 and v.n > 20, v.distinct > 0.3),
        lambda v: _vote(v.pairs < 0.3 and v.n > 20, v.pairs > 0.6),
        lambda v: _vote(v.marked > 0.3, v.marked < 0.05),
    ],
    "toxicity": [
        lambda v: _vote(v.insults > 0, v.insults == 0),
        lambda v: NOTHING if v.halves[0] is None else _vote(v.halves[0] > max(1, 0.005 * v.n), v.halves[0] == 0),
        lambda v: NOTHING if v.halves[1] is None else _vote(v.halves[1] > max(1, 0.005 * v.n), v.halves[1] == 0),
    ],
}
TASKS = list(LABELLERS)


def votes(view: View) -> list[str]:
    return ["".join(str(f(view)) for f in LABELLERS[task]) for task in TASKS]


@dataclass
class LabelModel:
    """Hidden class and conditionally independent votes: ``prior`` of good, ``confusion[labeller, class, vote]``."""

    prior: float
    confusion: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of good for each pattern."""
        votes_ = np.array([[int(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
        logs = np.log(self.confusion)
        lines = np.arange(votes_.shape[1])
        good = np.log(self.prior) + logs[lines, GOOD, votes_].sum(axis=1)
        bad = np.log1p(-self.prior) + logs[lines, BAD, votes_].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit_labels(counts: dict[str, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over pattern counts."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes_ = np.array([[int(c) for c in p] for p in patterns])
    # A labeller for one kind of fault is outvoted by those for others, so one bad vote outweighs them to begin with.
    belief = np.where((votes_ == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        prior = float(np.clip((n * belief).sum() / n.sum(), 1e-3, 1 - 1e-3))
        confusion = np.empty((votes_.shape[1], 2, 3))
        for k in range(votes_.shape[1]):
            for vote in range(3):
                at = votes_[:, k] == vote
                confusion[k, GOOD, vote] = (n * belief)[at].sum() + 1.0
                confusion[k, BAD, vote] = (n * (1 - belief))[at].sum() + 1.0
        confusion /= confusion.sum(axis=2, keepdims=True)
        # Labellers are built to raise few false alarms; this tells the two classes apart.
        confusion[:, GOOD, BAD] = np.minimum(confusion[:, GOOD, BAD], FALSE_ALARMS)
        model = LabelModel(prior, confusion)
        before, belief = belief, model.posterior(patterns)
        if np.abs(belief - before).max() < 1e-6:
            break
    return model


def features(view: View) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of the text by measure, and a hashed bag of words and word endings by share."""
    shares = [1.0, 4 * view.marks, view.shouts, view.capitals, 2 * view.no_letters, 2 * view.stops, view.top, view.distinct, min(1.0, view.n / 50), min(1.0, 50.0 * view.insults / view.n), min(1.0, 20.0 * view.learned / view.n)]
    amounts = view.amounts.astype(float)
    norm = np.sqrt((amounts**2).sum()) or 1.0
    return np.concatenate((np.arange(len(shares)), view.buckets)), np.concatenate((shares, amounts / norm))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad over mini-batches, in a fixed order; classes weigh alike."""
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    if not len(rows):
        return weights
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    emphasis = labels / share + (1 - labels) / (1 - share)
    order = np.random.Generator(np.random.PCG64(11)).permutation(len(rows))
    for _ in range(epochs):
        for k in range(0, len(rows), 64):
            part = order[k : k + 64]
            ids = np.concatenate([rows[i][0] for i in part])
            values = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            margin = np.bincount(of, weights[ids] * values, len(part))
            slope = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[part]) * emphasis[part] / len(part)
            used, place = np.unique(ids, return_inverse=True)
            step = np.bincount(place.reshape(-1), slope[of] * values, len(used)) + decay * weights[used]
            squares[used] += step**2
            weights[used] -= rate * 0.2 * step / np.sqrt(squares[used])
    return weights


@dataclass
class Model:
    labels: dict[str, LabelModel]
    weights: dict[str, np.ndarray]
    learned: frozenset[str] = frozenset()

    def scores(self, view: View) -> list[float]:
        ids, values = features(view)
        return [float(1 / (1 + np.exp(-np.clip((self.weights[t][ids] * values).sum(), -50, 50)))) for t in TASKS]


def learned_words(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str = "toxic", least: int = 4, log_odds: float = 2.0, most: int = LEARNED_WORDS) -> frozenset[str]:
    """Words, but for the listed insults, that toxic documents of a labelled sample have far oftener than others, at most ``most`` by log-odds."""
    known = labels.select(column(doc_id).alias("__id"), F.col(label).cast("int").alias("__bad")).where("__bad IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all(F.lower(column(text)), F.lit(r"[\p{L}]+"), F.lit(0)))
    of_doc = docs.select(column(doc_id).alias("__id"), words.alias("__words")).join(known, "__id")
    n = of_doc.agg(F.sum("__bad").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    if not n["bad"] or n["bad"] == n["all"]:
        return frozenset()
    sizes = of_doc.select(F.explode("__words").alias("w"), "__bad").groupBy("w").agg(F.sum("__bad").alias("bad"), F.sum(1 - F.col("__bad")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (n["all"] - n["bad"] + 1.0))
    rows = sizes.where((F.col("bad") >= least) & ~F.col("w").isin(sorted(_INSULTS))).select("w", odds.alias("o")).where(F.col("o") >= log_odds).orderBy(F.desc("o"), "w").limit(most).collect()
    return frozenset(r["w"] for r in rows)


def _sampled(docs: DataFrame, doc_id: str, text: str, rows: int, n: int, seed: int) -> DataFrame:
    place = F.pmod(F.xxhash64(F.lit(seed), column(doc_id), column(text)), F.lit(1 << 30))
    return docs.where(place < int((1 << 30) * min(1.0, rows / max(1, n))))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labels: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Label models from the votes of all rows; scorers from about ``sample_rows`` rows, chosen by a hash.

    ``labels`` (doc_id, toxic), where given, add labellers on words learned from about ``labelled_rows`` of the labelled rows.
    """
    learned = frozenset()
    if labels is not None:
        slim = docs.select(column(doc_id).alias(doc_id), column(text).alias(text))
        known = slim.join(labels.where("toxic IS NOT NULL").select(column(doc_id).alias("__known")), column(doc_id) == F.col("__known"), "left_semi")
        learned = learned_words(_sampled(known, doc_id, text, labelled_rows, known.count(), 31), labels, doc_id, text)

    def vote_rows(column: pa.Array) -> list[pa.Array]:
        both = [votes(View(raw, learned)) for raw in texts(column)]
        return [pa.array([b[k] for b in both], pa.string()) for k in range(len(TASKS))]

    voted = mapped(docs, [text], [], [(f"v{k}", T.StringType()) for k in range(len(TASKS))], vote_rows)
    each = voted.select(F.posexplode(F.array(*voted.columns)).alias("task", "votes"))
    tables = [Counter() for _ in TASKS]
    for row in each.groupBy("task", "votes").count().collect():
        tables[row["task"]][row["votes"]] = row["count"]
    models = {task: fit_labels(table) if table else LabelModel(0.5, np.full((len(LABELLERS[task]), 2, 3), 1 / 3)) for task, table in zip(TASKS, tables, strict=True)}
    n = sum(tables[0].values())
    chosen = _sampled(docs, doc_id, text, sample_rows, n, 29)

    def feature_rows(column: pa.Array) -> list[pa.Array]:
        views = [View(raw, learned) for raw in texts(column)]
        made = [features(v) for v in views]
        return [pa.array([x.astype(np.int32).tobytes() for x, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary()), pa.array(["|".join(votes(v)) for v in views], pa.string())]

    sample = mapped(chosen, [text], [], [("ids", T.BinaryType()), ("values", T.BinaryType()), ("votes", T.StringType())], feature_rows).collect()
    sample.sort(key=lambda r: (r["votes"], bytes(r["ids"]), bytes(r["values"])))
    rows = [(np.frombuffer(r["ids"], np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(float)) for r in sample]
    weights = {task: train(rows, models[task].posterior([r["votes"].split("|")[k] for r in sample]) if rows else np.zeros(0)) for k, task in enumerate(TASKS)}
    return Model(models, weights, learned)


def with_scores(docs: DataFrame, keep: list[str], model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` and of every row: posteriors of its votes, scores of good quality and of no toxicity, and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [("quality_posterior", T.DoubleType()), ("quality_score", T.DoubleType()), ("toxic_posterior", T.DoubleType()), ("toxic_score", T.DoubleType()), ("kept", T.BooleanType())]

    def rows(column: pa.Array) -> list[pa.Array]:
        m, out, known = shared.value, [], {}
        for raw in texts(column):
            view = View(raw, m.learned)
            of_vote = votes(view)
            for task, pattern in zip(TASKS, of_vote, strict=True):
                if (task, pattern) not in known:
                    known[task, pattern] = float(m.labels[task].posterior([pattern])[0])
            quality, clean = m.scores(view)
            a, b = (known[task, pattern] for task, pattern in zip(TASKS, of_vote, strict=True))
            out.append((a, quality, 1 - b, 1 - clean, quality >= 0.5 and clean >= 0.5))
        return [pa.array(x, pa.bool_() if k == 4 else pa.float64()) for k, x in enumerate(zip(*out, strict=True))]

    return mapped(docs, [text], keep, [(prefix + n, t) for n, t in names], rows)


def classified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return with_scores(docs, [doc_id], fit(docs, doc_id, text, **options), text)
