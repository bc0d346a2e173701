"""Toxicity by a linear-chain conditional random field over words.

Labels mark whole documents, so token labels come first: in a toxic training document a
word is tagged toxic if it or one of its stems occurs in far more toxic than clean
documents; all other words are tagged clean. A two-state chain over the words of each
sentence is then fitted to those tags. Forward-backward gives each word's marginal
probability; a document's score is a logistic function of its marginals, fitted to the
document labels, and the offending words are those with a marginal of at least one half.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, small_batches, text_batches, texts, within_bytes
from .hashing import GOLDEN, mix

SAMPLE_ROWS = 1000  # the most training documents of each label that the fit reads
SAMPLE_BYTES = 32_000_000  # and the most bytes of their texts, of each label (one text at least)
STRIDE = 5  # of the sample's sentences without a telling word every so manieth trains the field; 1: all of them
LONG = 2000  # words from which a sentence is solved by products of its steps
FOLDS, HELD_OUT = 5, 0
_WORD = re.compile(r"[^\W_]+|[.!?\n]")
_MEMO = 200_000
STEMS = (3, 4, 5, 6, 7, 8)


def features(word: str) -> list[str]:
    """The word, its stems of three to eight letters and its last three."""
    return ["w" + word, *("p" + word[:n] for n in STEMS if len(word) > n), "s" + word[-3:]]


class Model(NamedTuple):
    """Feature weights are log-odds of the toxic state; arcs[i, j] is the weight of state j after i."""

    weights: dict[str, float]
    bias: float
    arcs: tuple[float, float, float, float]  # clean-clean, clean-toxic, toxic-clean, toxic-toxic
    calibration: tuple[float, float, float]  # intercept, largest marginal, log of the expected count


def _unary(model: Model, word: str, memo: dict[str, float]) -> float:
    value = memo.get(word)
    if value is None:
        if len(memo) >= _MEMO:
            memo.clear()
        weights = model.weights
        value = memo[word] = model.bias + sum(weights.get(f, 0.0) for f in features(word))
    return value


def _chains(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of sentences in groups of like length, at most twice as long as the shortest
    and with a bounded number of cells."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        shortest = max(1, lengths[order[at]])
        end = int(np.searchsorted(lengths[order], 2 * shortest + 8, side="right"))
        end = max(at + 1, min(end, at + max(1, 400_000 // int(2 * shortest + 8))))
        yield order[at:end]
        at = end


def log_odds(unary: np.ndarray, lengths: np.ndarray, arcs) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward of a two-state chain, on log-odds, for padded sentences (a row each).
    Returns the log-odds of the toxic state from the left (with the word itself) and from the right."""
    cc, ct, tc, tt = np.exp(np.asarray(arcs, float))
    n, width = unary.shape
    left, right = np.zeros((n, width)), np.zeros((n, width))
    clip = lambda x: np.clip(x, -40, 40)
    left[:, 0] = clip(unary[:, 0])
    for t in range(1, width):
        odds = np.exp(left[:, t - 1])
        left[:, t] = clip(unary[:, t] + np.log((ct + tt * odds) / (cc + tc * odds)))
    for t in range(width - 2, -1, -1):
        odds = np.exp(clip(right[:, t + 1] + unary[:, t + 1]))
        step = np.log((tc + tt * odds) / (cc + ct * odds))
        right[:, t] = np.where(t + 1 < lengths, step, 0.0)
    return left, right


def _products(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """start, steps[0] start, steps[1] steps[0] start, ... for 2 x 2 steps; vectors count up to a factor. The steps are
    cut into as many stretches as a stretch has steps, and all stretches are multiplied side by side."""
    n = len(steps)
    width = max(1, math.isqrt(n))
    rows = -(-n // width)
    padded = np.broadcast_to(np.eye(2), (rows * width, 2, 2)).copy()
    padded[:n] = steps
    grid = padded.reshape(rows, width, 2, 2)
    for j in range(1, width):
        product = grid[:, j] @ grid[:, j - 1]
        grid[:, j] = product / product.max(axis=(1, 2), keepdims=True)
    begins = np.empty((rows, 2))
    now = start / start.max()
    for i in range(rows):
        begins[i] = now
        now = grid[i, -1] @ now
        now = now / now.max()
    return np.concatenate([start[None], np.einsum("rwij,rj->rwi", grid, begins).reshape(-1, 2)[:n]])


def long_log_odds(unary: np.ndarray, arcs) -> tuple[np.ndarray, np.ndarray]:
    """log_odds() of one sentence, without a loop over its words: a step from one word's odds to the next is a quotient
    of linear functions, so a 2 x 2 matrix."""
    cc, ct, tc, tt = np.exp(np.asarray(arcs, float))
    weight = np.exp(np.clip(unary, -40, 40))
    forward, backward = np.empty((len(unary) - 1, 2, 2)), np.empty((len(unary) - 1, 2, 2))
    forward[:, 0, 0], forward[:, 0, 1], forward[:, 1, 0], forward[:, 1, 1] = weight[1:] * tt, weight[1:] * ct, tc, cc
    backward[:, 0, 0], backward[:, 0, 1], backward[:, 1, 0], backward[:, 1, 1] = tt * weight[1:], tc, ct * weight[1:], cc
    odds = lambda v: np.clip(np.log(np.maximum(v[:, 0], 1e-300)) - np.log(np.maximum(v[:, 1], 1e-300)), -40, 40)
    left = odds(_products(forward, np.array([weight[0], 1.0])))
    right = odds(_products(backward[::-1], np.ones(2)))[::-1]
    return left, right


def forward_backward(unary: np.ndarray, counts: np.ndarray, arcs) -> tuple[np.ndarray, np.ndarray]:
    """log_odds() for a flat array of words; counts: words of each sentence, in order."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    left, right = np.zeros(len(unary)), np.zeros(len(unary))
    long = np.flatnonzero(counts > LONG)
    for i in long.tolist():
        own = slice(starts[i], starts[i] + counts[i])
        left[own], right[own] = long_log_odds(unary[own], arcs)
    short = np.flatnonzero(counts <= LONG)
    for group in (short[g] for g in _chains(counts[short])):
        width = int(counts[group].max())
        if not width:
            continue
        cells = np.arange(width)[None, :] < counts[group][:, None]
        places = (starts[group][:, None] + np.arange(width)[None, :])[cells]
        grid = np.zeros(cells.shape)
        grid[cells] = unary[places]
        from_left, from_right = log_odds(grid, counts[group], arcs)
        left[places], right[places] = from_left[cells], from_right[cells]
    return left, right


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def marginals(unary: np.ndarray, counts: np.ndarray, arcs) -> np.ndarray:
    """The probability of the toxic state for each word of a flat array."""
    left, right = forward_backward(unary, counts, arcs)
    return _sigmoid(left + right)


def _telling(toxic: int, clean: int, share: float, ratio: float) -> bool:
    """Whether a feature of so many toxic and clean documents marks toxic words: nine in ten of its
    documents are toxic (a clean one of the sample stands for `ratio`), and by a likelihood ratio that
    rare features do not reach by chance."""
    n = toxic + clean
    if toxic < 3 or toxic < 0.9 * (toxic + ratio * clean) or toxic <= share * n:
        return False
    gain = toxic * math.log(toxic / n / share) + (clean * math.log(clean / n / (1 - share)) if clean else 0.0)
    return gain >= 14.0


class Sample:
    """Training documents as arrays: a word id for each token, sentences and documents by number."""

    def __init__(self, rows: list[tuple[str, int]]):
        vocabulary: dict[str, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(text.lower() + "\n")], np.int32) for text, _ in rows]
        self.words = [*vocabulary]
        marks = np.array([w in ".!?\n" for w in self.words], bool)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = marks[flat] if len(flat) else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        sentence = np.cumsum(ends) - ends
        self.word, self.doc, self.sentence = flat[~ends], doc[~ends], sentence[~ends]
        self.label = np.array([y for _, y in rows], np.int64)
        self.names: list[str] = []
        self.features = self._feature_table()

    def _feature_table(self) -> np.ndarray:
        """Feature ids of each word of the vocabulary, in the order of features(), -1 where it has fewer."""
        known: dict[str, int] = {}
        table = np.full((max(1, len(self.words)), len(STEMS) + 2), -1, np.int32)
        for i, word in enumerate(self.words):
            own = [known.setdefault(f, len(known)) for f in features(word)]
            table[i, : len(own)] = own
        self.names = [*known]
        return table

    def document_counts(self, label: int) -> np.ndarray:
        """In how many documents of a label each feature stands; words that the label has met between the
        same neighbours before do not count, so that copies of one text do not make its words telling."""
        mine = self.label[self.doc] == label
        word, sentence, doc = self.word[mine].astype(np.uint64), self.sentence[mine], self.doc[mine]
        same = np.zeros(len(word) + 1, bool)
        same[1:-1] = sentence[1:] == sentence[:-1]
        before = np.where(same[:-1], np.roll(word, 1), np.uint64(0xFFFFFFFF))
        after = np.where(same[1:], np.roll(word, -1), np.uint64(0xFFFFFFFF))
        key = mix(mix(before * GOLDEN + word) * np.uint64(3) + after)
        fresh = np.unique(key, return_index=True)[1]
        ids = self.features[self.word[mine][fresh]].astype(np.int64)
        pairs = np.unique((doc[fresh][:, None] * np.int64(len(self.names)) + ids)[ids >= 0])
        return np.bincount(pairs % max(1, len(self.names)), minlength=len(self.names))


def fit(rows: list[tuple[str, int]], natural: float | None = None, rounds: int = 40, stride: int = STRIDE) -> Model:
    """rows: text and label; natural: the share of toxic documents where the rows were sampled (by default
    theirs); stride: which sentences without a telling word train the field, all of them with 1. Deterministic for the
    same rows in the same order."""
    sample = Sample(rows)
    clean, toxic = (sample.document_counts(y) for y in (0, 1))
    share = (int((sample.label == 1).sum()) + 0.5) / (len(rows) + 1)
    natural = min(max(natural if natural is not None else share, 1e-6), 1 - 1e-6)
    shift = math.log(natural / (1 - natural)) - math.log(share / (1 - share)) if rows else 0.0
    kinds = np.array([n[0] for n in sample.names])
    telling = np.array([k != "s" and _telling(int(t), int(c), share, math.exp(-shift)) for k, t, c in zip(kinds, toxic, clean, strict=True)], bool)
    table = sample.features
    marked = (np.append(telling, False)[table]).any(axis=1)[sample.word]  # -1 takes the appended False
    n_sentences = int(sample.sentence.max(initial=-1)) + 1
    chosen = np.arange(n_sentences) % stride == 0
    chosen[sample.sentence[marked]] = True  # every sentence with a telling word
    take = chosen[sample.sentence]
    word, truth = sample.word[take], (marked & (sample.label[sample.doc] == 1))[take].astype(float)
    counts = np.bincount(sample.sentence[take], minlength=n_sentences)
    counts = counts[counts > 0]
    ids = table[word]
    kept = np.append((clean + toxic >= 3) | (kinds == "s"), False)[ids]
    odd = np.arange(len(word)) % 2 == 1
    kept &= ~odd[:, None] | np.append(kinds == "p", False)[ids]  # stems must do without the rest
    owner = np.nonzero(kept)[0]
    used, ids = np.unique(ids[kept], return_inverse=True)
    weights, bias, arcs = np.zeros(len(used)), -3.0, np.zeros(4)
    if truth.sum():
        weights, bias, arcs = _train(ids, owner, truth, counts, len(used), rounds)
    model = Model({sample.names[f]: float(w) for f, w in zip(used, weights, strict=True) if abs(w) > 1e-3}, float(bias), tuple(map(float, arcs)), (0.0, 0.0, 0.0))
    del sample, table, ids, owner
    seen, memo = [], {}
    for at in range(0, len(rows), 256):
        seen += [summary(p) for p in document_marginals(model, [t for t, _ in rows[at : at + 256]], memo)]
    a, b, c = _calibrate(np.array(seen).reshape(-1, 2), np.array([y for _, y in rows], float))
    return model._replace(calibration=(a + shift, b, c))


_PAIRS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _train(ids, owner, truth, counts, width, rounds):
    """Gradient ascent on the chain's log-likelihood with per-weight steps (Adam) and L2 decay."""
    n = len(truth)
    ends = np.cumsum(counts)
    first = np.zeros(n, bool)
    first[np.concatenate([[0], ends[:-1]])[counts > 0]] = True
    params = np.zeros(width + 5)
    params[width] = -3.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    inner = np.flatnonzero(~first)
    real = [float((np.where(a, truth[inner - 1], 1 - truth[inner - 1]) * np.where(b, truth[inner], 1 - truth[inner])).sum()) for a, b in _PAIRS]
    for step in range(1, rounds + 1):
        arcs = params[width + 1 :]
        unary = params[width] + np.bincount(owner, params[ids], minlength=n)
        left, right = forward_backward(unary, counts, arcs)
        error = truth - _sigmoid(left + right)
        grad = np.zeros_like(params)
        grad[:width] = np.bincount(ids, error[owner], minlength=width)
        grad[width] = error.sum()
        pair = np.stack([a * left[inner - 1] + arcs[k] + b * (unary[inner] + right[inner]) for k, (a, b) in enumerate(_PAIRS)])
        pair = np.exp(pair - pair.max(axis=0, initial=-1e9))
        grad[width + 1 :] = np.array(real) - (pair / pair.sum(axis=0)).sum(axis=1)
        grad = grad - 0.1 * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        params[width + 1 :] = np.clip(params[width + 1 :], -4, 4)
    return params[:width], params[width], params[width + 1 :]


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on a document's summary, by damped Newton steps."""
    if not len(y):
        return (-3.0, 0.0, 0.0)
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.array([-2.0, 0.0, 0.0])
    ridge = np.diag([1e-3, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    return tuple(map(float, beta))


def document_marginals(model: Model, batch: list[str], memo: dict[str, float]) -> list[np.ndarray]:
    """The marginal of each word of each text. memo: weights of words met before; sentence marks are NaN."""
    for mark in ".!?\n":
        memo[mark] = math.nan
    flat = []
    for text in batch:
        tokens = _WORD.findall(text.lower())
        values = list(map(memo.get, tokens))
        if None in values:
            for mark in ".!?\n":
                memo[mark] = math.nan
            values = [_unary(model, w, memo) if v is None else v for w, v in zip(tokens, values, strict=True)]
        flat.append(np.array(values, float))
    sizes = [len(x) for x in flat]
    values = np.concatenate([x for f in flat for x in (f, [math.nan])]) if flat else np.zeros(0)  # texts end sentences too
    mark = np.isnan(values)
    ends = np.flatnonzero(mark)
    counts = np.diff(ends, prepend=-1) - 1
    p = np.zeros(len(values))
    p[~mark] = marginals(values[~mark], counts[counts > 0], model.arcs)
    out, at = [], 0
    for size in sizes:
        out.append(p[at : at + size][~mark[at : at + size]])
        at += size + 1
    return out


def summary(p: np.ndarray) -> tuple[float, float]:
    """Largest marginal and log of one plus the expected number of words that are more likely toxic than not."""
    return (float(p.max(initial=0.0)), math.log1p(float(p[p >= 0.5].sum())))


def score(model: Model, p: np.ndarray) -> float:
    a, b, c = model.calibration
    largest, many = summary(p)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * largest + c * many))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, most: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], float]:
    """A bounded sample, and the share of toxic ids among all training ids.

    Of the training rows of each label the `sample` first by hash of the id. Only their ids and labels
    (at most 2 * sample) are broadcast, so texts are not shuffled. Ids with both labels are left out; a
    repeated id gives one row, the one with the smallest text. Where the texts of a label hold more than `most`
    bytes, the first that fit are taken, one at least, so the driver's memory does not follow rows."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (crc_fold(id_col, FOLDS) != HELD_OUT))
    usable = usable.groupBy(id_col).agg(F.min("toxic").alias("__low"), F.max("toxic").alias("__toxic")).where("__low = __toxic")
    counted = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("__toxic"), F.lit(0)).alias("toxic")).first()
    order = F.xxhash64(id_col)
    picked = [usable.where(F.col("__toxic") == y).select(F.col(id_col).alias("__id"), "__toxic").orderBy(order, "__id").limit(sample) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts_of = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = texts_of.join(F.broadcast(picked), "__id").groupBy("__id", "__toxic").agg(F.min("__text").alias("__text"))
    rows = within_bytes(rows, "__text", "__toxic", most).collect()
    return [(r["__text"] or "", r["__toxic"]) for r in sorted(rows, key=lambda r: str(r["__id"]))], counted["toxic"] / max(1, counted["n"])


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES, stride: int = STRIDE) -> Model:
    """Fit on training rows only (crc32 of the id modulo 5 is not 0), at most `sample` of each label and `most` bytes of them. Word counts and
    calibration read whole texts; the field is trained on sentences with a telling word and every `stride`-th other one."""
    rows, natural = training_rows(docs, labels, id_col, text_col, sample, most)
    return fit(rows, natural if rows else None, stride=stride)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Returns id_col, score double and spans array<struct<start, end, marginal>>: character offsets
    of words whose marginal is at least one half (of the lower-cased text where that has another length). Null and empty texts score as texts without
    words and have no spans; repeated rows are scored each; other columns are not read. A map
    without a shuffle; the model (bounded by the sample) travels with the plan.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in text_batches(batches, 1, 128):
            read = texts(batch, 1)
            scores, spans = [], []
            for text, p in zip(read, document_marginals(shared.value, read, memo), strict=True):
                scores.append(score(shared.value, p))
                spans.append(_spans(text, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[id_col, "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key_type}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")


def _spans(text: str, p: np.ndarray) -> list[dict]:
    hits = set(np.flatnonzero(p >= 0.5).tolist())
    if not hits:
        return []
    lowered = text.lower()
    exact = len(lowered) == len(text)  # a few letters grow when lowered; then offsets are those of the lowered text
    words = (m for m in _WORD.finditer(lowered if not exact else text.lower()) if m[0] not in ".!?\n")
    return [{"start": m.start(), "end": m.end(), "marginal": float(p[i])} for i, m in enumerate(words) if i in hits]
