"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternion.llm import bytewords
from ternion.llm.common import saved

#: At most this many labelled documents train the classifier (those with the least hash of their id).
MOST_LABELS = 4000
#: At most this many words, seen in toxic and hardly in other labelled documents, are its lexicon.
MOST_WORDS = 500
#: Bytes from which on a text is measured piece by piece.
LONG = 4 * bytewords.SLICE_BYTES
#: Documents with at least this posterior are kept.
KEEP = 0.5

_JUNK = np.zeros(256, bool)
_JUNK[list(b"*&%$#|!<>{}[]\\^~=+_@")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
FEATURES = ("log words", "junk", "upper", "digits", "distinct", "same as before", "word length", "lexicon words", "lexicon share")


def _lexicon_hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(bytewords.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def features(data: np.ndarray, at: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """FEATURES of each row of a text buffer.  lexicon: sorted hashes of words."""
    if len(at) == 2 and len(data) > LONG:
        return _measures(np.diff(at), *_long_counts(data, lexicon))
    counted = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][at])
    n, letters = len(at) - 1, _LETTER[data]
    hashed, row = _hashed(data, at)
    order = np.lexsort((hashed, row))
    new = np.r_[True, (hashed[order][1:] != hashed[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(order)]
    distinct = np.bincount(row[order][new], minlength=n)
    same = np.bincount(row[1:][(hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])], minlength=n)
    bad = np.bincount(row[_listed(hashed, lexicon)], minlength=n)
    return _measures(np.diff(at), np.bincount(row, minlength=n), counted(_JUNK[data]), counted(_UPPER[data]), counted(letters), counted(_DIGIT[data]), distinct, same, bad)


def _measures(size, words, junk, upper, letters, digits, distinct, same, bad) -> np.ndarray:
    many = np.maximum(words, 1)
    return np.column_stack([np.log1p(words), junk / np.maximum(size, 1), upper / np.maximum(letters, 1), digits / np.maximum(size, 1), distinct / many**0.9, same / many, letters / many, np.log1p(bad), bad / many])


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWERED[data]
    starts, ends, row = bytewords.words(low, at, _LETTER[data])
    return bytewords.word_hashes(low, starts, ends), row


def _listed(hashed: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon) or not len(hashed):
        return np.zeros(len(hashed), bool)
    return lexicon[np.minimum(np.searchsorted(lexicon, hashed), len(lexicon) - 1)] == hashed


def _long_counts(data: np.ndarray, lexicon: np.ndarray) -> list[np.ndarray]:
    """The counts of one long text, piece by piece; what is kept beside them is its different words."""
    sums, seen, before = np.zeros(7, np.int64), np.zeros(0, np.uint64), None
    for first, last in bytewords.pieces(data, _LETTER):
        part = data[first:last]
        hashed, _ = _hashed(part, np.array([0, len(part)]))
        chain = hashed if before is None else np.r_[before, hashed]
        sums += [len(hashed), _JUNK[part].sum(), _UPPER[part].sum(), _LETTER[part].sum(), _DIGIT[part].sum(), (chain[1:] == chain[:-1]).sum(), _listed(hashed, lexicon).sum()]
        seen = np.union1d(seen, hashed)
        before = hashed[-1:] if len(hashed) else before
    words, junk, upper, letters, digits, same, bad = (np.array([x]) for x in sums)
    return [words, junk, upper, letters, digits, np.array([len(seen)]), same, bad]


class Classifier:
    """Logistic regression on FEATURES with a lexicon; without training it gives the prior."""

    def __init__(self, lexicon: list[bytes], centre: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.words = lexicon
        self.lexicon = np.sort(np.array([_lexicon_hash(w) for w in lexicon], np.uint64))
        self.centre, self.scale, self.weights = centre, scale, weights

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability that each row's document is good, within [0.001, 0.999]."""
        x = np.clip((features(data, at, self.lexicon) - self.centre) / self.scale, -8, 8)
        z = np.column_stack([np.ones(len(x)), x]) @ self.weights
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.001, 0.999)


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; the first is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS, most_words: int = MOST_WORDS) -> Classifier:
    """Fits a classifier of good documents (quality 1 and not toxic) on a bounded sample of labelled ones.

    labels has id_col, quality and toxic; several labels of a document are averaged, and of several documents with
    one id that with the least hash counts.  Without both
    good and bad documents among them the classifier gives every document the same score: 0.5 if
    there is no label, else almost 1 or almost 0.
    """
    each = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg("quality").alias("quality"), F.avg(F.coalesce("toxic", F.lit(0))).alias("toxic")).filter("quality is not null")
    each = each.orderBy(F.xxhash64("_id"), "_id").limit(most_labels)
    # one document for each labelled id, the one with the least hash
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(each), F.col("id") == F.col("_id"))
    sample = found.groupBy("id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).cast("double").alias("good"), (F.col("toxic") >= 0.5).alias("toxic"))
    sample = saved(sample, "labelled")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                data, at = bytewords.buffer(part.column("text"))
                raw, toxic = _LOWERED[data].tobytes(), part.column("toxic").to_pylist()
                starts, ends, row = bytewords.words(_LOWERED[data], at, _LETTER[data])
                found = sorted({(raw[s:e], r) for s, e, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([int(toxic[r]) for _, r in found], pa.int64())], ["word", "toxic"])

    n_toxic = sample.filter("toxic").count()
    counts = bytewords.mapped(sample, listed, "word binary, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    telling = counts.filter((F.col("t") >= max(3, 0.08 * n_toxic)) & (F.col("t") >= 0.6 * F.col("n"))).orderBy(F.desc("t"), "word").limit(most_words)
    words = [bytes(r.word) for r in telling.collect()] if n_toxic else []
    lexicon = np.sort(np.array([_lexicon_hash(w) for w in words], np.uint64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                x = features(*bytewords.buffer(part.column("text")), lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column("good")], ["x", "good"])

    got = bytewords.mapped(sample, measured, "x array<double>, good double").collect()  # at most most_labels rows
    x = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r.good for r in got])
    centre, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    weights = _regression((x - centre) / scale, y) if 0 < y.sum() < len(y) else np.r_[0.0 if not len(y) else 10.0 * (2 * y[0] - 1), np.zeros(len(FEATURES))]
    return Classifier(words, centre, scale, weights)


def evidence(text: Column, classifier: Classifier) -> Column:
    """The classifier's probability that a text is good; null counts as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                parts = [classifier.score(*bytewords.buffer(part.column("text"))) for part in bytewords.slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
        finally:
            bytewords.tidy()

    # not deterministic: else Spark may put a copy of it into each expression that uses it
    return score.asNondeterministic()(text)


def _strength(groups: DataFrame, mean: Column, n: Column) -> float:
    """How many documents a prior is worth: from the variance of group means beyond chance (method of moments)."""
    r = groups.agg(F.sum(n).alias("n"), F.sum(n * mean).alias("s"), F.sum(n * mean * mean).alias("q"), F.count("*").alias("k")).first()
    if not r.n or r.k < 2:
        return 1e4
    mu = r.s / r.n
    within = mu * (1 - mu)
    between = max(0.0, (r.q / r.n - mu * mu) - (r.k - 1) * within / r.n)
    return float(np.clip(within / between - 1 if between > 0 else 1e4, 1.0, 1e4))


def sites(scores: DataFrame) -> tuple[DataFrame, float]:
    """Posterior of each (host, path), and the global prior, from scores (host, path, p).

    A path's mean is shrunk toward its host's, a host's toward the mean of all documents; how far
    depends on how many documents it has and on how much such groups differ beyond chance.
    """
    paths = saved(scores.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = saved(paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")), "hosts")
    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    mu = total[0] / total[1] if total[1] else 0.5
    strong = _strength(hosts, F.col("hs") / F.col("hn"), F.col("hn"))
    inner = _strength(paths, F.col("s") / F.col("n"), F.col("n"))
    shrunk = hosts.select(F.col("host").alias("_h"), ((F.col("hs") + strong * mu) / (F.col("hn") + strong)).alias("host_posterior"))
    joined = paths.join(shrunk, F.col("host").eqNullSafe(F.col("_h")))
    return joined.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), F.col("s").alias("s_sum"), F.col("n").alias("s_n"), "host_posterior", F.lit(inner).alias("s_strength")), mu


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", keep: float = KEEP, columns: list[str] | None = None) -> DataFrame:
    """The rows of docs whose posterior of being good is at least ``keep``, with all their columns.

    host and path say which site a document is of; null is a site of its own.  The posterior's log
    odds are those of the document's own evidence, moved by how far the shrunk posterior of its path
    (the other documents there) is from the global prior.  ``columns`` names further columns to
    return: evidence, host_posterior, path_posterior, posterior; they replace columns of docs of
    that name.

    A null or empty text has the evidence of a text without words.  Repeated rows are judged each.
    Empty tables give no rows; without labels every document has the same evidence and stays.
    Extra columns, whatever their names, are returned as they are.
    """
    classifier = train(docs, labels, id_col, text_col)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    score = evidence(F.col(text_col), classifier)
    site, mu = sites(docs.select(column(host).alias("host"), column(path).alias("path"), score.alias("p")))
    site, mu = saved(site, "sites"), min(max(mu, 0.001), 0.999)
    rows = docs.select(F.struct(*docs.columns).alias("row"), column(host).alias("host"), column(path).alias("path"), score.alias("evidence"))
    both = rows.join(site, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    others = (F.col("s_sum") - F.col("evidence") + F.col("s_strength") * F.col("host_posterior")) / (F.col("s_n") - 1 + F.col("s_strength"))
    both = both.withColumn("path_posterior", F.greatest(F.lit(0.001), F.least(F.lit(0.999), others)))
    z = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(mu))
    both = both.withColumn("posterior", 1 / (1 + F.exp(-z))).filter(F.col("posterior") >= keep)
    return both.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in (columns or [])), *(columns or []))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))
