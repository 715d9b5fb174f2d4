"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import fresh, map_batches, table, utf8_of, with_columns, words
from colweave.storage import broadcast, saved

#: Labelled rows used for fitting at most, those with the smallest hashes of their keys; counts and scores cover all rows.
SAMPLE = 12_000
#: Features of the classifier at most: words, and the first 4 and 5 bytes of longer ones, by 64-bit hashes.
FEATURES = 8192
LEXICONS = 24
THRESHOLD = 0.3
#: Distinct words whose weights a task keeps.
KEPT_WORDS = 200_000


def features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its stems."""
    out = [word]
    if len(word) > 4:
        out.append(b"4 " + word[:4])
    if len(word) > 5:
        out.append(b"5 " + word[:5])
    return tuple(map(hashed, out))


def hashed(x: bytes) -> int:
    h = xxhash.xxh64_intdigest(x, 8)
    return h - (1 << 64) if h >= 1 << 63 else h


MINIMA = 8


def minima(hashes: list[int]) -> list[int]:
    """Pairs of smallest values of the hashes of three words on end under MINIMA scrambles: near copies share a pair, other texts hardly any, even with a passage in common."""
    h = np.array(hashes or [0], dtype=np.int64).view(np.uint64)
    if len(h) > 2:
        h = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xBF58476D1CE4E5B9)
    least = np.array([((h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)).min() for i in range(MINIMA)])
    return (least[::2] * np.uint64(0x94D049BB133111EB) + least[1::2]).view(np.int64).tolist()


def one_per_family(rows: list[tuple[int, list[int]]]) -> list[int]:
    """The smallest key of each family of sampled rows (key, minima) that share a pair of minima."""
    parent = {k: k for k, _ in rows}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    seen: dict[tuple[int, int], int] = {}
    for k, m in sorted(rows):
        for x in enumerate(m):
            a, b = sorted((root(k), root(seen.setdefault(x, k))))
            parent[b] = a
    return [k for k in parent if root(k) == k]


# A lexicon of plain insults.
INSULTS = frozenset(b"idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool jerk bastard filth vermin pig".split())


def fixed_votes(text: bytes, own: list[bytes]) -> list[int]:
    """Votes that know nothing of the labels: of the fixed lexicon, once and twice, and of patterns of style: shouting, runs of marks, very few different words, symbols inside words."""
    insults = sum(w in INSULTS for w in own)
    n = max(1, len(text))
    upper = sum(map(text.count, (b"A", b"E", b"I", b"O", b"N", b"T"))) / n
    marks = (text.count(b"!") + text.count(b"?")) / n
    w = text.split()
    return [int(insults > 0), int(insults > 1), int(upper > 0.2), int(marks > 0.02), int(len(w) > 20 and len(set(w)) < 0.1 * len(w)), int(sum(map(text.count, (b"*", b"$", b"#", b"%"))) / n > 0.02)]


@dataclasses.dataclass
class Model:
    weights: dict[int, float]  # by feature
    bias: float
    accuracies: np.ndarray  # of each voter, for each class: the share that votes 1
    correlations: np.ndarray  # of two voters: their mutual information given the class
    prior: float


class LabelModel:
    """A generative model of votes: an unknown class is drawn, then the votes given it, each by the class and by one other voter that it hangs together with.

    Which voters hang together, and how, is part of the model: given the class the votes form a tree (Chow and Liu), the one with the greatest mutual information given the class;
    branches that chance could explain are cut. Expectation and maximisation, from the voters' majority on and without any label, estimates the class's share, each voter's rates in both
    classes and on each branch the rates given the other's vote. A vote that only repeats another's adds no evidence by this.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 30):
        n, m = votes.shape
        y = np.clip(start.astype(float), 0.02, 0.98)
        for _ in range(rounds):
            weights = np.stack([1 - y, y])
            self.prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
            total = weights.sum(axis=1)
            one = weights @ votes  # by class and voter
            both = np.stack([votes.T @ (w[:, None] * votes) for w in weights])
            self.rates = (one + 0.5) / (total[:, None] + 1)
            # joint shares of two voters' votes by class: [class, own vote, other's vote, own, other]
            cells = np.empty((2, 2, 2, m, m))
            cells[:, 1, 1] = both
            cells[:, 1, 0] = one[:, :, None] - both
            cells[:, 0, 1] = one[:, None, :] - both
            cells[:, 0, 0] = total[:, None, None] - one[:, :, None] - one[:, None, :] + both
            joint = (np.maximum(cells, 0) + 0.25) / (total[:, None, None, None, None] + 1)
            apart = joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)
            share = (total / total.sum())[:, None, None, None, None]
            self.correlations = (share * joint * np.log(joint / apart)).sum(axis=(0, 1, 2))
            np.fill_diagonal(self.correlations, 0)
            self.parent = self.tree(self.correlations, 6.6 / (2 * max(1, n)))  # chance alone exceeds 6.6 / 2n once in a hundred
            child, parent = np.flatnonzero(self.parent >= 0), self.parent[self.parent >= 0]
            given = joint[:, :, :, child, parent]
            self.given = given / given.sum(axis=1, keepdims=True)  # [class, own vote, parent's vote, branch]
            new = self.posterior(votes)
            moved, y = np.abs(new - y).max(initial=0), new
            if moved < 1e-4:
                break
        self.y = y

    @staticmethod
    def tree(strength: np.ndarray, least: float) -> np.ndarray:
        """Each voter's parent in the strongest tree, -1 for a root."""
        m = len(strength)
        parent, best, inside = np.full(m, -1), np.full(m, -np.inf), np.zeros(m, bool)
        for _ in range(m):
            at = int(np.where(inside, -np.inf, np.maximum(best, -1e300)).argmax())
            inside[at] = True
            if best[at] < least:
                parent[at] = -1
            nearer = ~inside & (strength[at] > best)
            best[nearer], parent[nearer] = strength[at][nearer], at
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(np.int64)
        child, root = np.flatnonzero(self.parent >= 0), np.flatnonzero(self.parent < 0)
        logs = []
        for c in (0, 1):
            alone = votes[:, root] @ np.log(self.rates[c, root]) + (1 - votes[:, root]) @ np.log(1 - self.rates[c, root])
            logs.append(alone + np.log(self.given[c, v[:, child], v[:, self.parent[child]], np.arange(len(child))]).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0], -30, 30)))


def majority(votes: np.ndarray) -> np.ndarray:
    """Where voters' votes start from: 1 if a text has more votes than a text mostly has of voters that are silent in most texts, and two at least."""
    n = votes.sum(axis=1)
    return (n >= max(2.0, np.median(n) + 1)).astype(float)


def fit(rows: list[np.ndarray], fixed: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float, LabelModel]:
    """Weights of features and the bias. rows: each text's features by number, in order of how telling they are; fixed: votes of the fixed voters; toxic: which features stand out among rows labelled 1."""
    n, size = len(rows), len(toxic)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row_of = np.repeat(np.arange(n), [len(r) for r in rows])
    # lexicons: the telling features dealt round, so that each has some of every rank
    lexicon = np.full(size, -1)
    lexicon[toxic] = np.arange(int(toxic.sum())) % LEXICONS
    votes = np.zeros((n, LEXICONS + fixed.shape[1]))
    votes[:, LEXICONS:] = fixed
    hit = lexicon[flat] >= 0
    votes[row_of[hit], lexicon[flat[hit]]] = 1
    label_model = LabelModel(votes, majority(votes))
    target = label_model.posterior(votes)
    # gradient descent with momentum and a ridge
    w, velocity, bias, bias_speed = np.zeros(size), np.zeros(size), float(np.log(np.clip(target.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(target.mean(), 1e-3, 1 - 1e-3)))), 0.0
    degree = np.bincount(flat, minlength=size) + 10.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row_of, w[flat], minlength=n) + bias, -30, 30)))
        error = p - target
        velocity = 0.9 * velocity - 0.5 * (np.bincount(flat, error[row_of], minlength=size) + 0.05 * w) / degree
        bias_speed = 0.9 * bias_speed - 0.5 * error.mean()
        w, bias = w + velocity, bias + bias_speed
    return w, bias, label_model


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, held_out: bool = True) -> Model:
    """A model from at most `sample` labelled rows; with held_out, only from those whose crc32(key as text) mod 4 is not 2.

    A feature stands out if, were labels dealt out at random, less than one of all features would deviate as far (Chernoff's bound).
    Voters are a fixed lexicon, patterns of style, and lexicons dealt from features that stand out among rows labelled 1; for these alone the labels are used. The label model (see LabelModel) estimates, without
    labels, how accurate the voters are and how they hang together, and gives each sampled row a posterior label; the linear classifier is trained on these.
    Of rows that are near copies of each other only one is used: else words of a text often copied would seem to tell something.
    Rows labelled twice count once, as 1 if any label is 1; of several texts under one key the one whose features come first counts. Null keys, labels without a text and texts without a label are passed over. Without labels of both kinds all rows get the labels' average.
    Keys are of any type; other columns, whatever they are called, aren't looked at.
    """
    df, labels = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")), labels.select(F.col(key).alias(key), F.col(label).alias(label))
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    marked = (marked.where(crc % 4 != 2) if held_out else marked).groupBy(F.col(key).alias("__k")).agg(F.max(label).alias("__y"))
    chosen = marked.orderBy(F.xxhash64("__k"), "__k").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8_of(batch, "x")]
            split = [words(t) for t in texts]
            known = {w: features(w) for x in split for w in x}
            rows = [sorted({f for w in set(x) for f in known[w]}) for x in split]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64())), pa.array([fixed_votes(t, x) for t, x in zip(texts, split, strict=True)], pa.list_(pa.int32())), pa.array([minima([known[w][0] for w in x]) for x in split], pa.list_(pa.int64()))], ["k", "y", "f", "p", "m"])

    joined = df.join(F.broadcast(chosen), F.col("__key") == F.col("__k")).select(F.xxhash64(F.col("__k").cast("string")).alias("k"), F.col("__y").cast("int").alias("y"), F.col("__text").alias("x"))
    rows = map_batches(joined, run, "k long, y int, f array<long>, p array<int>, m array<long>")
    rows = saved(rows.groupBy("k").agg(F.min(F.struct("y", "f", "p", "m")).alias("r")).select("k", "r.*"))  # a row for each key, however often it comes
    kept = df.sparkSession.createDataFrame([(k,) for k in one_per_family([tuple(r) for r in rows.select("k", "m").collect()])], "k long")  # `sample` at most
    rows = rows.join(F.broadcast(kept), "k").select("k", "y", "f", "p")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n1 or n1 == n:
        share = n1 / n if n else 0.0
        return Model({}, float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros((2, 0)), np.zeros((0, 0)), share)
    counts = saved(rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("c")).where("c >= 3"))
    q, p = F.col("a") / F.col("c"), n1 / n
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    evidence = F.col("c") * (part(q, F.lit(p)) + part(1 - q, F.lit(1 - p)))
    telling = counts.withColumn("e", evidence).where(F.col("e") > float(np.log(max(2, counts.count())) + 1)).orderBy(F.desc("e"), "f").limit(FEATURES).collect()
    number = {r.f: i for i, r in enumerate(telling)}
    shared = broadcast(df.sparkSession, number)  # FEATURES at most

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [[shared.value[x] for x in row if x in shared.value] for row in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(f, pa.list_(pa.int32())), batch.column(3)], ["k", "y", "f", "p"])

    got = map_batches(rows.select("k", "y", "f", "p"), select, "k long, y int, f array<int>, p array<int>").toArrow().sort_by("k").to_pylist()  # bounded by `sample` and FEATURES
    toxic = np.array([r.a * n > r.c * n1 for r in telling], dtype=bool)
    w, bias, model = fit([np.array(r["f"], dtype=np.int64) for r in got], np.array([r["p"] for r in got], dtype=float), toxic)
    return Model({f: float(w[i]) for f, i in number.items()}, bias, model.rates, model.correlations, model.prior)


def scores(df: DataFrame, model: Model, text: str = "text", score: str = "__score") -> DataFrame:
    """df with a column `score`, in the place of one that is called so already, from whole texts alone; null and empty texts have the score of no words."""
    df = df.drop(score)
    shared = broadcast(df.sparkSession, (model.weights, model.bias))  # FEATURES at most
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, bias = shared.value
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for t in batch.column(at).cast(pa.binary()).to_pylist():
                fs: set[int] = set()
                for w in set(words(t or b"")):
                    f = known.get(w)
                    if f is None:
                        f = tuple(x for x in features(w) if x in theta)
                        if len(known) > KEPT_WORDS:
                            known.clear()
                        known[w] = f
                    if f:
                        fs.update(f)
                total = bias + float(sum(theta[x] for x in sorted(fs)))
                out.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, score])

    return map_batches(df, run, with_columns(df.schema, f"`{score}` double"))


def clean_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df without the rows predicted toxic by a model learnt from its labelled rows; all columns stay, whatever they are called."""
    (score,) = fresh(df, "score")
    return scores(df, learn(df, labels), score=score).where(F.col(score) < THRESHOLD).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scores(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
