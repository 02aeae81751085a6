"""Subjects of documents, by one-versus-rest classifiers of hashed word n-grams over sentences and table rows.

Weak labels: the subject names in a page's categories and templates, and the
marked documents, which weigh more.  They say what a document deals with, not which of its
sentences; so a first fit gives every sentence its document's labels, and a
second one the labels that the first one is sure of.  The thresholds are then
set on the marked documents.  Only the fit uses a sample, of a bounded number of documents,
each with its whole text; every sentence and table row of every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from math import prod
from tempfile import SpooledTemporaryFile
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm import wikitext
from meshloom.runtime import Scratch

BUCKETS = 1 << 20
#: The fit reads the whole text of at most so many weakly labelled documents and so many marked ones.
WEAK_DOCS, MARKED_DOCS = 5000, 3000
#: A longer text counts whole, but weighs as much as one of so many characters, lest a few pages outweigh all others.
FIT_CHARS = 8000
#: The fit holds about so many features at once, and so many bytes of the others; what is beyond waits in a file.
PART_FEATURES, SPOOL_BYTES = 1 << 18, 64 << 20
#: Bytes of features that a task sends on together.
BATCH_BYTES = 8 << 20
#: A marked document weighs as much as so many weak ones.
MARKED_WEIGHT = 4.0
#: A word or pair counts if it is in so many documents (a hundredth of them if that is less, two at least) and one subject has at least this share of them.
LEAST_DOCS, TELLING = 8, 0.4
L2 = 3e-5
#: A document deals with a subject from this share of its units that deal with any.
SHARE = 0.2

_REDIRECT = re.compile(r"[\s﻿]*#\s*(?:redirect|redirection|weiterleitung|redirecci[oó]n|перенаправление)\b", re.I)
_PARAGRAPH = re.compile(r"\n\s*\n|\n(?=[ \t]*[|!=*#:;{])|(?<=[=|])[ \t]*\n")
_SENTENCE = re.compile(r"(?<=[.!?。।])[\"'”»)]?\s+")
_HEADING = re.compile(r"\s*=+[^\n]*=+\s*\Z")
_WORD = re.compile(r"[^\W\d_]+")


def units(text: str | None) -> list[str]:
    """The sentences and table rows of a text as a reader sees it; none of a redirect; headings are neither."""
    if not text or _REDIRECT.match(text):
        return []
    out: list[str] = []
    for part in _PARAGRAPH.split(wikitext.visible(text.replace("\r\n", "\n").replace("\r", "\n"))):
        if not part or _HEADING.match(part):
            continue
        out += [part] if part.lstrip()[:1] in ("|", "!") else _SENTENCE.split(part)
    return [u for u in out if _WORD.search(u)]


def features(rows: list[str]):
    """(bucket, row) of the words and word pairs of each row."""
    import numpy as np

    lists = [[crc32(w.encode()) for w in _WORD.findall(r.lower())] for r in rows]
    size = np.array([len(x) for x in lists], dtype=np.int64)
    one = np.array([h for x in lists for h in x], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    same = row[1:] == row[:-1]
    two = ((one[:-1] * 1_000_003 + one[1:] + 7) & 0x7FFFFFFF)[same]
    return np.concatenate([one, two]) % BUCKETS, np.concatenate([row, row[1:][same]])


class Model:
    """Weights of the buckets that occurred often enough in the fit."""

    def __init__(self, slot, weights, bias, thresholds):
        self.slot, self.weights, self.bias, self.thresholds = slot, weights, bias, thresholds

    def scores(self, rows: list[str]):
        import numpy as np

        bucket, row = features(rows)
        at = self.slot[bucket]
        keep = at >= 0
        return _sigmoid(_sums(self.weights, at[keep], row[keep], len(rows)) + self.bias)

    def subjects(self, deals, doc, n_docs: int):
        """Whether each document has each subject: ``deals`` for its units, ``doc`` their documents."""
        import numpy as np

        per = np.stack([np.bincount(doc, weights=deals[:, c], minlength=n_docs) for c in range(deals.shape[1])], axis=1)
        some = np.bincount(doc, weights=deals.any(axis=1), minlength=n_docs)
        return _enough(per, some[:, None])


class _Parts:
    """Tuples of arrays, read again in the order they came; in a temporary file beyond ``SPOOL_BYTES``."""

    def __init__(self):
        self.file, self.shapes = SpooledTemporaryFile(SPOOL_BYTES), []

    def add(self, *arrays) -> None:
        for a in arrays:
            self.file.write(a.tobytes())
        self.shapes.append([(a.dtype, a.shape) for a in arrays])

    def __iter__(self):
        import numpy as np

        self.file.seek(0)
        for shapes in self.shapes:
            yield [np.frombuffer(self.file.read(dtype.itemsize * prod(shape)), dtype).reshape(shape) for dtype, shape in shapes]


def _enough(per, some):
    return (per > 0) & (per >= SHARE * some - 1e-9)


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(weights, at, row, n: int):
    """Each row's sum of weights, divided by the root of its number of features."""
    import numpy as np

    many = np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))[:, None]
    return np.stack([np.bincount(row, weights=weights[at, c], minlength=n) for c in range(weights.shape[1])], axis=1) / many


def _logistic(parts: Callable[[], Iterable], slots: int, n_subjects: int, steps: int, l2: float):
    """Weights and biases by full gradient steps (Adam); ``parts`` gives, for each step anew, slots and rows of the features, targets and weights of the rows."""
    import numpy as np

    w = np.zeros((slots + 1, n_subjects))
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[slots] = -2.0  # the bias
    for t in range(1, steps + 1):
        g, total = np.zeros((n_subjects, slots + 1)), 0.0
        for at, row, target, weight in parts():
            n = len(target)
            err = (_sigmoid(_sums(w, at, row, n) + w[slots]) - target) * weight[:, None]
            each = err / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))[:, None]
            for c in range(n_subjects):
                g[c, :slots] += np.bincount(at, weights=each[row, c], minlength=slots)
            g[:, slots] += err.sum(axis=0)
            total += weight.sum()
        g = g.T / total + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:slots], w[slots].copy()


def fit(docs: Iterable[tuple[frozenset[int], bool, int, object, object]], n_subjects: int, steps: int = 40) -> Model:
    """``docs``: numbers of its subjects, whether a person marked them, characters, number of features of each unit, their buckets in order."""
    import numpy as np

    read, known = _Parts(), []
    # In how many documents, and of which subjects; a name that one page repeats counts once.
    times, with_subject = np.zeros(BUCKETS, dtype=np.int32), np.zeros((n_subjects, BUCKETS), dtype=np.int32)
    for labels, by_person, chars, sizes, buckets in docs:
        in_doc = np.unique(buckets)
        times[in_doc] += 1
        for c in labels:
            with_subject[c, in_doc] += 1
        read.add(sizes, buckets)
        known.append((labels, by_person, min(1.0, FIT_CHARS / max(1, chars))))
    target = np.zeros((len(known), n_subjects))
    for k, (labels, _, _) in enumerate(known):
        target[k, sorted(labels)] = 1
    marked = np.array([d[1] for d in known], dtype=bool)
    length_weight = np.array([d[2] for d in known])
    often = (times >= max(2, min(LEAST_DOCS, len(known) // 100))) & (with_subject.max(axis=0) >= TELLING * (with_subject.sum(axis=0) + 1))
    slot = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
    model = Model(slot, np.zeros((int(often.sum()), n_subjects)), np.full(n_subjects, -9.0), np.full(n_subjects, 0.5))
    parts = _in_parts(read, slot)
    if not parts.shapes:
        return model
    weight = np.where(marked, MARKED_WEIGHT, 1.0) * length_weight
    w, b = _logistic(lambda: ((at, row, target[doc], weight[doc]) for at, row, doc in parts), len(model.weights), n_subjects, steps, L2)
    sure = _Parts()
    for at, row, doc in parts:
        p = _sigmoid(_sums(w, at, row, len(doc)) + b)
        sure.add((p >= 0.4) & (p >= 0.7 * p.max(axis=1, keepdims=True)))
    w, b = _logistic(lambda: ((at, row, yes, length_weight[doc]) for (at, row, doc), (yes,) in zip(parts, sure)), len(model.weights), n_subjects, steps, L2)
    model.weights, model.bias = w.astype(np.float32), b
    scored = _Parts()
    for at, row, doc in parts:
        p = _sigmoid(_sums(w, at, row, len(doc)) + b)
        scored.add(p[marked[doc]], doc[marked[doc]])
    # Thresholds: for each subject, the one that the marked documents agree with best; 0.5 where they tell no difference.
    for c in range(n_subjects):
        best = -1.0
        for t in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
            tried = model.thresholds.copy()
            tried[c] = t
            per, some = np.zeros(len(known)), np.zeros(len(known))
            for p, doc in scored:
                deals = p >= tried
                per += np.bincount(doc, weights=deals[:, c], minlength=len(known))
                some += np.bincount(doc, weights=deals.any(axis=1), minlength=len(known))
            got = _enough(per, some)[marked]
            want = target[marked, c] > 0
            f1 = 2 * (got & want).sum() / max(1, got.sum() + want.sum())
            if f1 > best + 1e-3:
                best, keep = f1, t
        model.thresholds[c] = keep
    return model


def _in_parts(read: _Parts, slot) -> _Parts:
    """Slots and rows of the features that have a slot, and the documents of the rows, which are units; about ``PART_FEATURES`` features together."""
    import numpy as np

    parts, held, features_held = _Parts(), [], 0

    def close() -> None:
        first = np.cumsum([0] + [len(doc) for _, _, doc in held])
        parts.add(np.concatenate([at for at, _, _ in held]), np.concatenate([row + lo for (_, row, _), lo in zip(held, first)]), np.concatenate([doc for _, _, doc in held]))

    for k, (sizes, buckets) in enumerate(read):
        at, row = slot[buckets], np.repeat(np.arange(len(sizes)), sizes)
        held.append((at[at >= 0], row[at >= 0], np.full(len(sizes), k)))
        features_held += len(at)
        if features_held >= PART_FEATURES:
            close()
            held, features_held = [], 0
    if features_held:
        close()
    return parts


def weak_pattern(subjects: list[str]) -> str:
    """A subject's name at the head of a category, or last before the bar or end of a template's name (Infobox, stubs)."""
    names = "|".join(re.escape(s) for s in subjects)
    # Blanks before the name are left to one place, else a long run of them takes its square in steps.
    return rf"(?i)(?:\[\[[^\[\]|:]*:\s*|\{{\{{(?:[^{{}}|]*\s)?)({names})\b"


def sample(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> dict[int, tuple[frozenset[int], bool]]:
    """The documents of the fit, by a hash of their ids: all marked ones and those with a weak label anywhere in the text, up to the limits.

    For each its subjects' numbers and whether a person marked them.
    """
    number = {s: k for k, s in enumerate(subjects)}
    texts = documents.where("text is not null").select("doc_id", "text")
    marked = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MARKED_DOCS)
    # Only about as many rows as needed are searched for labels: a third of the documents has one.
    rows = documents.count()
    part = min(1.0, 5 * WEAK_DOCS / max(1, rows))
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(part * 1_000_000))
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(weak_pattern(subjects)), F.lit(1)), F.lower))
    weak = drawn.select("doc_id", found.alias("subjects")).where(F.size("subjects") > 0).join(F.broadcast(marked.select("doc_id")), "doc_id", "left_anti")
    weak = weak.orderBy(F.xxhash64("doc_id"), "doc_id").limit(WEAK_DOCS)
    return {r[0]: (frozenset(number[s] for s in r[1] if s in number), by) for df, by in ((weak, False), (marked, True)) for r in df.select("doc_id", "subjects").collect()}


def sampled(documents: DataFrame, picked: dict[int, tuple[frozenset[int], bool]]) -> Iterator[tuple[frozenset[int], bool, int, object, object]]:
    """What :func:`fit` reads of the documents ``picked``, in order of their ids; the tasks read the texts, and the driver one partition of features at a time."""
    import numpy as np

    spark = documents.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("sizes", pa.binary()), ("buckets", pa.binary())])
        as_batch = lambda out: pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
        out, n_bytes = [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                text = text.as_py()
                found = units(text)
                bucket, row = features(found)
                sizes, buckets = np.bincount(row, minlength=len(found)).astype(np.int32), bucket[np.argsort(row, kind="stable")].astype(np.int32)
                out.append((doc_id.as_py(), len(text), sizes.tobytes(), buckets.tobytes()))
                n_bytes += sizes.nbytes + buckets.nbytes
                if n_bytes >= BATCH_BYTES:
                    yield as_batch(out)
                    out, n_bytes = [], 0
        if out:
            yield as_batch(out)

    ids = spark.createDataFrame([(k,) for k in picked], "doc_id long")
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    scratch = Scratch(spark, "subjects")
    try:
        saved = scratch.save(texts.mapInArrow(work, "doc_id long, chars long, sizes binary, buckets binary"), "features")
        for r in saved.orderBy("doc_id").toLocalIterator():
            yield *picked[r.doc_id], r.chars, np.frombuffer(r.sizes, np.int32), np.frombuffer(r.buckets, np.int32)
    finally:
        scratch.close()


def dealt_with(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects of each document, by its whole text."""
    spark = documents.sparkSession
    subjects = [r[0] for r in areas.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]
    if not subjects:
        return spark.createDataFrame([], "doc_id long, subject string")
    sent = spark.sparkContext.broadcast(fit(sampled(documents, sample(documents, labels, subjects)), len(subjects)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model, schema = sent.value, pa.schema([("doc_id", pa.int64()), ("subject", pa.string())])
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows, doc = [], []
                for k, text in enumerate(part["text"].to_pylist()):
                    found = units(text)
                    rows += found
                    doc += [k] * len(found)
                if not rows:
                    continue
                has = model.subjects(model.scores(rows) >= model.thresholds, np.array(doc, dtype=np.int64), part.num_rows)
                k, c = np.nonzero(has)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(k)), pa.array([subjects[x] for x in c], type=pa.string())], schema=schema)

    return documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, subject string")
