"""Subject areas of documents, by linear classifiers over hashed word n-grams.

A document deals with a subject if a good part of its sentences does, so the classifiers judge sentences: one linear
classifier against the rest for each subject, over words and word pairs hashed into a fixed number of weights. They learn
from weak labels, which come from three places:

- labels given by hand: each sentence of such a document carries its subjects;
- address paths and section metadata: where most of the hand-labelled documents with a part of the address, a source, a
  kind or a word of a heading have one subject, the other documents with it carry that subject too;
- the subjects' own titles and descriptions.

A first fit tells topical from stock sentences; only those that it finds topical keep the label for the next. Every subject
is fitted in a task of its own. The score from which a sentence deals with a subject is calibrated on hand-labelled documents
that no fit has seen, by counting over all of them. The model has a fixed size and is sent to the executors; every
document is judged by all its sentences.

Fitting reads a bounded sample of labelled rows, taken by a hash of doc_id: ``LABELLED`` documents of each kind of label and
about ``CHARACTERS`` of their texts, whole. Everything else covers all data and behaves alike at every size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import staged

#: The sample of labelled rows for fitting, the share of hand labels kept for calibration (one in so many), and the number
#: of hashed weights of a subject.
LABELLED, CHARACTERS, HELD_OUT, WEIGHTS = 4_000, 32_000_000, 5, 1 << 17
#: The share of sentences that makes a good part, and the scores of a sentence that calibration chooses from.
PART, LEVELS = 0.2, tuple(i / 20 for i in range(4, 19))
#: The share of one subject from which a part of an address or a piece of metadata is a label: a lower bound, at 95 %.
EVIDENCE = 0.5
#: Fits after the first, and gradient steps of each.
REFITS, STEPS = 2, 30

_TAG = re.compile(r"<[^<>]{1,80}>")
_FENCE = re.compile(r"```.*?```", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = r"[.!?](?=\s)|[\r\n]+"
_TOKEN = re.compile(rf"{_WORD.pattern}|{_END}")
_NOISE = re.compile(r"\S{60,}")

_HASHES: dict[str, int] = {}


def _plain(text: str | None) -> str:
    """A text in lower case without markup, fenced logs and long blobs; the line break behind it ends its last sentence."""
    return _NOISE.sub(" ", _TAG.sub(" ", _FENCE.sub("\n", text or ""))).lower() + "\n"


def _hash(token: str) -> int:
    """A word's hash, kept, or -1 for what ends a sentence. A plural s doesn't tell words apart."""
    h = _HASHES.get(token)
    if h is None:
        if len(_HASHES) >= 1 << 20:
            _HASHES.clear()
        h = _HASHES[token] = zlib.crc32((token[:-1] if len(token) > 3 and token.endswith("s") else token).encode()) if token[0].isalpha() else -1
    return h


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lists of words in lower case; those of fewer than three words are left out."""
    found: list[list[str]] = [[]]
    for token in _TOKEN.findall(_plain(text)):
        if token[0].isalpha():
            found[-1].append(token)
        elif found[-1]:
            found.append([])
    return [w for w in found if len(w) >= 3]


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sentences`` of many texts at once: the hashed words of all of them, how many each sentence has, and its text."""
    tokens = [_TOKEN.findall(_plain(t)) for t in texts]
    ids = np.fromiter((_hash(x) for own in tokens for x in own), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, tokens), np.int64, len(texts)))
    word = ids >= 0
    sentence = np.cumsum(~word)[word]
    long = np.bincount(sentence, minlength=1) >= 3
    keep = long[sentence]
    words, sentence = ids[word][keep], sentence[keep]
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(words) else np.zeros(0, np.int64)
    return words, np.diff(np.r_[first, len(words)]), owner[word][keep][first]


@dataclass
class Features:
    """The hashed words and word pairs of sentences: where in the weights, where each sentence starts and how many it has."""

    at: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(words: np.ndarray, sizes: np.ndarray) -> Features:
        """All sentences at once, of hashed words. None may be empty."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        start = 2 * begin - np.arange(len(sizes))
        place = np.arange(len(words)) + (start - begin)[owner]
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(words) else np.zeros(0, np.int64)
        grams = np.empty(max(0, 2 * len(words) - len(sizes)), np.int64)
        grams[place] = words
        grams[place[inside] + sizes[owner[inside]]] = words[inside] * 1_000_003 ^ words[inside + 1]
        return Features((grams ^ (grams >> 17)) & (WEIGHTS - 1), start, 2 * sizes - 1)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # WEIGHTS x subjects
    bias: np.ndarray
    level: np.ndarray = field(default_factory=lambda: np.zeros(0))  # score of a sentence, by subject

    def scores(self, f: Features) -> np.ndarray:
        """The probability of each subject for each sentence."""
        return _probability(np.add.reduceat(self.weights[f.at], f.start, axis=0) / np.sqrt(f.size)[:, None] + self.bias)


@dataclass
class Sample:
    """What a fit reads, with equal sentences once: their features, the sentence and the subjects of every occurrence."""

    features: Features
    occurrence: np.ndarray
    labels: np.ndarray  # occurrences x subjects
    whole: np.ndarray  # whether an occurrence keeps its label in any case

    @staticmethod
    def of(labelled: list[tuple[str, set[str]]], subjects: list[str], words_of: dict[str, str]) -> Sample:
        number = {s: i for i, s in enumerate(subjects)}
        known: dict[str, int] = {}
        occurrence, owner, labels = [], [], []
        told = [*((sentences(t), names) for t, names in labelled), *(([_WORD.findall(text.lower())], {s}) for s, text in words_of.items())]
        for i, (found, names) in enumerate(told):
            occurrence += [known.setdefault(" ".join(w), len(known)) for w in found if w]
            owner += [i] * sum(1 for w in found if w)
            labels.append(np.isin(np.arange(len(subjects)), [number[n] for n in names if n in number]))
        owner_of = np.array(owner, np.int64)
        listed = [k.split(" ") for k in known]
        words = np.fromiter((_hash(w) for own in listed for w in own), np.int64)
        return Sample(Features.of(words, np.fromiter(map(len, listed), np.int64, len(listed))), np.array(occurrence, np.int64), np.array(labels, bool).reshape(-1, len(subjects))[owner_of], owner_of >= len(labelled))


def _fit(sample: Sample, j: int, pull: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights (where, what) and bias of one subject against the rest: weighted logistic regression by full gradients
    with adaptive steps. Equal sentences count by the root of their number."""
    f = sample.features
    used, at = np.unique(f.at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    owner = np.repeat(np.arange(len(f.size)), f.size)[order]
    scale = (1 / np.sqrt(f.size)).astype(np.float32)
    times = np.bincount(sample.occurrence, minlength=len(f.size))
    weight = np.sqrt(times).astype(np.float32)
    shrink = np.float32(pull * weight.sum() / 100)
    mine = sample.labels[:, j]
    told = mine / np.maximum(1, sample.labels.sum(axis=1))  # of a document with several subjects each has its share
    w, b = np.zeros(len(used), np.float32), 0.0
    for _ in range(REFITS + 1):
        target = (np.bincount(sample.occurrence, told, len(times)) / times).astype(np.float32)
        w, b, seen, seen_b = np.zeros(len(used), np.float32), -2.0, np.full(len(used), 1e-8, np.float32), 1e-8
        for _ in range(STEPS):
            slope = (_probability(np.add.reduceat(w[at], f.start) * scale + b) - target) * weight
            g, gb = np.add.reduceat((slope * scale)[owner], firsts) + shrink * w, float(slope.sum())
            seen += g * g
            seen_b += gb * gb
            w -= 0.5 * g / np.sqrt(seen)
            b -= 0.3 * gb / np.sqrt(seen_b)
        score = _probability(np.add.reduceat(w[at], f.start) * scale + b)
        told = (mine & (sample.whole | (score[sample.occurrence] >= 0.3))).astype(float)
    return used, w, b


def train(spark: SparkSession, labelled: list[tuple[str, set[str]]], subjects: list[str], words_of: dict[str, str]) -> Model:
    """A model from labelled texts (with their subjects, or none) and the words that describe each subject."""
    k = len(subjects)
    model = Model(subjects, np.zeros((WEIGHTS, k), np.float32), np.full(k, -30.0), np.full(k, 0.5))
    words_of = {s: t for s, t in words_of.items() if _WORD.search(t)}
    if not k or not (words_of or any(sentences(t) for t, _ in labelled)):
        return model
    sent = spark.sparkContext.broadcast(Sample.of(labelled, subjects, words_of))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for j in b["id"]:
                used, w, bias = _fit(sent.value, int(j))
                yield pd.DataFrame({"j": [j], "used": [used.astype(np.int32).tobytes()], "w": [w.tobytes()], "bias": [bias]})

    for r in spark.range(0, k, 1, k).mapInPandas(run, "j long, used binary, w binary, bias double").toLocalIterator():
        model.weights[np.frombuffer(r.used, np.int32), r.j] = np.frombuffer(r.w, np.float32)
        model.bias[r.j] = r.bias
    sent.unpersist()
    return model


# labels -------------------------------------------------------------------------------------------------------------


def hand_labels(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, names (the subjects, in their own writing), held (kept for calibration): one row per hand-labelled document.

    Labels count trimmed and in lower case; names that are no subject count as none.
    """
    own = subjects.where("subject is not null").select(F.lower(F.trim("subject")).alias("key"), "subject").groupBy("key").agg(F.min("subject").alias("subject"))
    named = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("key")).join(own, "key", "left")
    return named.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("names")).withColumn("held", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(HELD_OUT)) == 0)


def _metadata(documents: DataFrame) -> DataFrame:
    """doc_id, token: the parts of a document's address, its source, its kind, and the words of its headings."""
    column = lambda name: F.lower(F.col(name)) if name in documents.columns else F.lit(None).cast("string")
    parts = lambda text, mark: F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    one = lambda name: F.when(column(name).isNotNull(), F.array(F.concat(F.lit(f"{name}:"), F.array_join(parts(column(name), ""), "-")))).otherwise(F.array().cast("array<string>"))
    headings = F.array_join(F.regexp_extract_all(F.coalesce(column("text"), F.lit("")), F.lit(r"(?m)^#+ *(.+)$"), 1), " ")
    tokens = F.concat(parts(column("repository_url"), "address:"), one("source"), one("doc_kind"), parts(headings, "heading:"))
    return documents.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(tokens)).alias("token"))


def evidence(documents: DataFrame, told: DataFrame) -> DataFrame:
    """token, subject, documents, share: the pieces of metadata of which at least ``EVIDENCE`` of the documents have one
    subject. ``told`` are the hand labels to count (doc_id, names)."""
    tokens = _metadata(documents.join(told.select("doc_id"), "doc_id", "left_semi")).join(told.select("doc_id", "names"), "doc_id")
    total = tokens.groupBy("token").agg(F.count("*").alias("documents"))
    of = tokens.select("token", F.explode("names").alias("subject")).groupBy("token", "subject").agg(F.count("*").alias("k"))
    n, p, z = F.col("documents"), F.col("k") / F.col("documents"), 1.96
    low: Column = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return of.join(total, "token").where(low >= EVIDENCE).select("token", "subject", "documents", p.alias("share"))


def metadata_labels(documents: DataFrame, found: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, names: the documents without hand label that carry a piece of ``evidence``, with its subjects."""
    tokens = _metadata(documents.join(told.select("doc_id"), "doc_id", "left_anti"))
    return tokens.join(found.select("token", "subject"), "token").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("names"))


def _drawn(documents: DataFrame, labelled: DataFrame) -> list[tuple[str, set[str]]]:
    """The texts and subjects of the sample: the first by a hash of doc_id, up to ``LABELLED`` and ``CHARACTERS``."""
    text = documents.select("doc_id", "text").where("text is not null")
    held = staged(text.join(labelled.select("doc_id", "names"), "doc_id").dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id")))
    sizes = held.select("h", "doc_id", F.length("text").alias("n")).orderBy("h", "doc_id").limit(LABELLED).collect()
    total, last = 0, None
    for r in sizes:
        total += r.n
        if last is not None and total > CHARACTERS:
            break
        last = r
    if last is None:
        return []
    rows = held.where((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("doc_id") <= last.doc_id)))
    return [(r.text, set(r.names)) for r in sorted(rows.toLocalIterator(), key=lambda r: (r.h, r.doc_id))]


# use ----------------------------------------------------------------------------------------------------------------


def _shares(model: Model, texts: list[str | None], levels: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For parts of the texts that have sentences: their places, and by level the share of sentences of each subject."""
    begin, held = 0, 0
    for i, text in enumerate(texts, 1):
        held += len(text or "")
        if held > 2_000_000 or i == len(texts):  # bounded, however long the texts of a batch are
            words, sizes, owner = hashed(texts[begin:i])
            if len(sizes):
                score = model.scores(Features.of(words, sizes))
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                count = np.diff(np.r_[starts, len(owner)])[:, None]
                yield owner[starts] + begin, np.array([np.add.reduceat(score >= level, starts, axis=0, dtype=np.int64) / count for level in levels])
            begin, held = i, 0


def calibrated(model: Model, documents: DataFrame, held: DataFrame) -> Model:
    """Set the score of a sentence, by subject, where the labels of ``held`` (doc_id, names) fit best.

    For each level the documents are counted that are found, labelled, and both; a subject's own counts and the mean of all
    subjects' weigh the same, so that a subject of few labels follows the others.
    """
    spark, names = documents.sparkSession, model.subjects
    if not names:
        return model
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            truth = np.array([np.isin(names, list(x)) for x in b["names"]], bool).reshape(len(b), len(names))
            levels = [np.full(len(names), level) for level in LEVELS]
            for at, share in _shares(sent.value, b["text"].tolist(), levels):
                hit, true = share >= PART - 1e-9, truth[at]
                yield pd.DataFrame([(i, j, int((hit[i, :, j] & true[:, j]).sum()), int(hit[i, :, j].sum() + true[:, j].sum())) for i in range(len(LEVELS)) for j in range(len(names))], columns=["i", "j", "both", "either"])

    text = documents.select("doc_id", "text").where("text is not null").join(held.select("doc_id", "names"), "doc_id").dropDuplicates(["doc_id"]).select("text", "names")
    counted = text.mapInPandas(run, "i int, j int, both long, either long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("either").alias("either")).collect()
    both, either = np.zeros((2, len(LEVELS), len(names)))
    for r in counted:
        both[r.i, r.j], either[r.i, r.j] = r.both, r.either
    fits = 2 * (both + both.mean(axis=1, keepdims=True)) / np.maximum(1, either + either.mean(axis=1, keepdims=True))
    middle = np.abs(np.array(LEVELS) - 0.5)
    for j in range(len(names)):
        model.level[j] = LEVELS[max(range(len(LEVELS)), key=lambda i: (round(fits[i, j], 6), -middle[i]))]  # noqa: B023
    return model


def fitted(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model:
    """A calibrated model from tables: documents (doc_id, text; repository_url, source and doc_kind if there are any),
    labels (doc_id, subject) and subjects (subject, title, description). Other columns are ignored; without labels the
    subjects' own words are all that is known."""
    spark = documents.sparkSession
    told = staged(hand_labels(labels, subjects))
    own = {r.subject: f"{r.title or ''}. {r.description or ''}" for r in subjects.where("subject is not null").groupBy(F.lower(F.trim("subject"))).agg(F.min(F.struct("subject", "title", "description")).alias("s")).select("s.*").orderBy("subject").collect()}
    found = staged(evidence(documents, told.where("not held")))
    sample = _drawn(documents, told.where("not held"))
    if not found.isEmpty():
        sample += _drawn(documents, metadata_labels(documents, found, told))
    return calibrated(train(spark, sample, list(own), own), documents, told.where("held"))


def _judge(broadcast):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = broadcast.value
        names = np.array(model.subjects, object)
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for at, (share,) in _shares(model, b["text"].tolist(), [model.level]):
                row, j = np.nonzero(share >= PART - 1e-9)
                yield pd.DataFrame({"doc_id": ids[at[row]], "subject": names[j], "share": share[row, j]})

    return run


def assigned(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject, share (of the document's sentences) of each subject that a document deals with.

    Null, empty and wordless texts have none. Documents are expected once each; other columns are ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(_judge(sent), "doc_id long, subject string, share double")
