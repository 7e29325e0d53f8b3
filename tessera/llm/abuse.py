"""Abusive, hateful or sexual content: a convolutional text classifier trained in numpy.

Words (disguises undone) are embedded by the sum of their hashed forms; filters of several widths run over the
embedded text, each filter keeps its maximum, and a softmax over {clean, abuse, hate, sexual} gives the score
1 - P(clean). Labels have errors, so the fit drops the labelled texts that contradict a confident first fit.
Thresholds are set per language on held-out labels, weighted to the share of such texts in the corpus, which is counted
from the scores of all documents and corrected by the rates of hits and false alarms on the held-out labels.
"""

import math
import pickle
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.abuse_text import BUCKETS, FORMS, Hasher, language, words
from tessera.plans.lineage import cut

CLASSES = ("clean", "abuse", "hate", "sexual")
#: The model is fitted on all labelled texts; a caller may bound their number or their characters in all (taken by hash
#: of doc_id). One in ``HELD_OUT`` is kept for the thresholds.
MAX_LABELLED, MAX_CHARS, HELD_OUT = None, math.inf, 6
DIM, FILTERS, WIDTHS, EPOCHS, BATCH, SEED = 24, 40, (1, 2, 3, 4, 5), 10, 64, 20240305
#: A label that the model gives a smaller probability is taken for an error.
SANE = 0.15
#: Words of one convolution; longer texts are cut with an overlap, which changes no maximum.
SPAN = 4096
#: Texts that are scored at once.
PART = 20_000
LANGUAGES = ("en", "de", "fr", "es", "other")


class Texts(Sequence):
    """Texts as (words, forms) bucket ids in a scratch file, so that their number is not bounded by memory."""

    def __init__(self) -> None:
        self.file, self.ends, self.all = tempfile.TemporaryFile(), [0], np.empty((0, FORMS), np.uint16)

    def append(self, ids: np.ndarray) -> None:
        self.file.write(ids.astype(np.uint16).tobytes())
        self.ends.append(self.ends[-1] + len(ids))

    def close(self) -> "Texts":
        """Ends writing."""
        self.file.flush()
        if self.ends[-1]:
            self.all = np.memmap(self.file, np.uint16, "r", shape=(self.ends[-1], FORMS))
        return self

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.all[self.ends[i] : self.ends[i + 1]]


class Model:
    """Parameters of the network and its forward pass."""

    def __init__(self, rng: np.random.Generator):
        self.emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.emb[0] = 0
        self.w = {w: (rng.standard_normal((w, DIM, FILTERS)) * np.sqrt(1.0 / (w * DIM))).astype(np.float32) for w in WIDTHS}
        self.b = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.out = (rng.standard_normal((n, len(CLASSES))) * np.sqrt(1.0 / n)).astype(np.float32)
        self.bias = np.array([1.0, 0, 0, 0], np.float32)
        #: Score, class and language of the held-out texts.
        self.held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0), np.empty(0, bool), np.empty(0, str))

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """(texts, positions, widest * DIM): the embedded words of the widest window at every position; ``ids`` is (texts, words, forms), 0 for padding."""
        x = self.emb[ids[..., 0]]
        for f in range(1, ids.shape[2]):
            x += self.emb[ids[..., f]]
        n, length, _ = x.shape
        most = max(WIDTHS)
        view = np.lib.stride_tricks.as_strided(x, (n, length - most + 1, most * DIM), x.strides)
        return np.ascontiguousarray(view)

    def responses(self, windows: np.ndarray, w: int) -> np.ndarray:
        """(texts, positions, filters) of one width; narrower filters see the beginning of the window."""
        n, length, _ = windows.shape
        return (windows.reshape(n * length, -1)[:, : w * DIM] @ self.w[w].reshape(w * DIM, FILTERS)).reshape(n, length, FILTERS)

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Activated maxima (texts, widths * filters), their positions, and the windows."""
        x, at, top = self.windows(ids), {}, []
        for w in WIDTHS:
            z = self.responses(x, w)
            at[w] = z.argmax(1)
            top.append(np.maximum(np.take_along_axis(z, at[w][:, None], 1)[:, 0] + self.b[w], 0))
        return np.concatenate(top, 1), at, x

    def maxima(self, ids: np.ndarray) -> np.ndarray:
        """The maxima of :meth:`pooled` alone."""
        x = self.windows(ids)
        return np.concatenate([np.maximum(self.responses(x, w).max(1) + self.b[w], 0) for w in WIDTHS], 1)

    def classify(self, top: np.ndarray) -> np.ndarray:
        z = top @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Class probabilities of texts given as (words, forms) ids, whole whatever their length."""
        step = SPAN - max(WIDTHS) + 1
        spans = [(i, t[a : a + SPAN]) for i, t in enumerate(texts) for a in range(0, max(len(t) - max(WIDTHS) + 1, 1), step)]
        spans.sort(key=lambda s: len(s[1]))
        top = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        at = 0
        while at < len(spans):
            end = at + 1
            while end < len(spans) and (end + 1 - at) * (len(spans[end][1]) + 2 * max(WIDTHS)) <= 4 * SPAN:
                end += 1
            part = spans[at:end]
            np.maximum.at(top, [i for i, _ in part], self.maxima(padded([t for _, t in part])))
            at = end
        return self.classify(top)


def padded(texts: list[np.ndarray]) -> np.ndarray:
    """One block of ids with room for the widest filter on both sides."""
    pad = max(WIDTHS) - 1
    out = np.zeros((len(texts), max(len(t) for t in texts) + 2 * pad, texts[0].shape[1]), np.int32)
    for i, t in enumerate(texts):
        out[i, pad : pad + len(t)] = t
    return out


def scores_of(m: Model, texts: Sequence[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Class probabilities of the texts at these places."""
    return np.concatenate([m.scores([texts[i] for i in at[a : a + PART]]) for a in range(0, len(at), PART)])


def fit(texts: Sequence[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Trains on word ids and class numbers: Adagrad, dropout on the maxima, gradients only through the maxima."""
    rng = np.random.default_rng(seed)
    m = Model(rng)
    state: dict = {}
    n_classes = len(CLASSES)
    weight = np.ones(len(texts))

    def step(name, value, grad, rate):
        acc = state.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        acc += grad * grad
        value -= rate * grad / np.sqrt(acc)

    size = np.array([len(t) for t in texts])
    for epoch in range(epochs):
        if epoch == epochs // 2:  # labels that contradict a confident fit are taken for errors
            p = scores_of(m, texts, np.arange(len(texts)))
            weight = np.where(p[np.arange(len(texts)), labels] < SANE, 0.0, 1.0)
        rate = 0.06 * (1 - 0.7 * epoch / epochs)
        order = np.argsort(size + rng.uniform(0, 1, len(size)) * np.maximum(8, 0.15 * size), kind="stable")
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            rows = batches[k][weight[batches[k]] > 0]
            if not len(rows):
                continue
            ids = padded([texts[i] for i in rows])
            top, at, x = m.pooled(ids)
            keep = (rng.uniform(size=top.shape) > 0.3) / np.float32(0.7)
            p = m.classify(top * keep)
            target = np.full(p.shape, 0.03 / (n_classes - 1), np.float32)
            target[np.arange(len(rows)), labels[rows]] = 0.97
            dz = (p - target) / len(rows)
            dtop = (dz @ m.out.T) * keep * (top > 0)
            step("out", m.out, (top * keep).T @ dz + 1e-5 * m.out, rate)
            step("bias", m.bias, dz.sum(0), rate)
            flat_ids, flat_grad = [], []
            for j, w in enumerate(WIDTHS):
                g = dtop[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                pos = at[w][:, :, None] + np.arange(w)
                seen = x[np.arange(len(rows))[:, None], at[w]][..., : w * DIM].reshape(len(rows), FILTERS, w, DIM)
                step(("b", w), m.b[w], g.sum(0), rate)
                b, f = np.nonzero(g)
                flat_ids.append(ids[b[:, None], pos[b, f]].reshape(-1, ids.shape[2]))
                flat_grad.append((g[b, f][:, None, None] * m.w[w].transpose(2, 0, 1)[f]).reshape(-1, DIM))
                step(("w", w), m.w[w], np.einsum("bf,bfwd->wdf", g, seen) + 1e-5 * m.w[w], rate)
            idx, grad = np.concatenate(flat_ids), np.concatenate(flat_grad)
            order_ = np.argsort(idx, axis=None)
            uniq, first = np.unique(idx.ravel()[order_], return_index=True)
            total = np.add.reduceat(grad[order_ // idx.shape[1]], first, axis=0)
            total[uniq == 0] = 0
            acc = state.setdefault("emb", np.full(m.emb.shape, 1e-6, np.float32))
            acc[uniq] += total * total
            m.emb[uniq] -= rate * total / np.sqrt(acc[uniq])
    return m


def best_threshold(score: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best weighted F1; 0.5 where there is nothing to judge by."""
    if bad.sum() < 8 or (~bad).sum() < 8:
        return 0.5
    order = np.argsort(-score)
    s, b, w = score[order], bad[order], weight[order]
    hit, false = np.cumsum(w * b), np.cumsum(w * ~b)
    f1 = 2 * hit / (hit + false + (w * b).sum())
    i = int(np.argmax(f1))
    low = s[i + 1] if i + 1 < len(s) else 0.0
    return float(np.clip((s[i] + low) / 2, 0.2, 0.9))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int | None = MAX_LABELLED) -> DataFrame:
    """doc_id, text, lang, label (class number) of all reviewed texts; of ``most`` and ``MAX_CHARS`` in all where these are set.

    Labels are read without case and blanks; unknown and NULL labels count for nothing. A text goes by the commonest
    label of its reviewers; a tie between clean and another label, or no label, leaves it out.
    """
    name = F.lower(F.trim("label"))
    votes = labels.filter(name.isin(*CLASSES) & F.col("doc_id").isNotNull()).select("doc_id", "reviewer", name.alias("label")).distinct()
    votes = votes.groupBy("doc_id").agg(*(F.count(F.when(F.col("label") == c, 1)).alias(c) for c in CLASSES))
    bad = F.col("abuse") + F.col("hate") + F.col("sexual")
    number = F.when(F.col("clean") > bad, 0).when(F.col("clean") == bad, None)
    number = number.when((F.col("abuse") >= F.col("hate")) & (F.col("abuse") >= F.col("sexual")), 1).when(F.col("hate") >= F.col("sexual"), 2).otherwise(3)
    votes = votes.select("doc_id", number.alias("label")).filter("label IS NOT NULL")
    votes = votes if most is None else votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text", "lang").join(votes, "doc_id").filter("text IS NOT NULL")
    if MAX_CHARS == math.inf:
        return rows
    sofar = F.sum(F.length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "lang").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_n", sofar).filter(F.col("_n") <= MAX_CHARS).drop("_n")


def trained(rows: Iterator[tuple[int, str, str | None, int]]) -> Model | None:
    """A model fitted on (doc_id, text, lang, label) rows, ordered by them, with its held-out scores; None without labels of both kinds."""
    hasher, kept = Hasher(), (Texts(), Texts())
    labels, langs, hidden = [], [], []
    for doc_id, text, tag, label in rows:
        split = words(text)
        hidden.append(doc_id * 2654435761 % (1 << 32) * HELD_OUT >> 32 == 0)
        kept[hidden[-1]].append(hasher.ids(split))
        labels.append(label), langs.append(language(split, tag))
    y, lang, held = np.array(labels, np.int64), np.array(langs), np.array(hidden, bool)
    if len(set((y > 0).tolist())) < 2:
        return None
    fitted, others = (t.close() for t in kept)
    if held.sum() < 50 or len(set((y[~held] > 0).tolist())) < 2:
        at = iter(range(len(fitted))), iter(range(len(others)))
        both = Texts()
        for h in hidden:
            both.append((others if h else fitted)[next(at[h])])
        fitted, held = both.close(), np.zeros(len(held), bool)
    model = fit(fitted, y[~held])
    if held.any():
        score, bad = 1 - scores_of(model, others, np.arange(len(others)))[:, 0], y[held] > 0
        sane = np.where(bad, score, 1 - score) >= SANE  # as in the fit
        model.held = (score[sane], bad[sane], lang[held][sane])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the reviewed texts, fitted by one task on all of them, which it keeps on disk; None without labels of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for b in batches for a in range(0, b.num_rows, 1000) for r in b.slice(a, 1000).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(rows))], pa.binary())], ["model"])

    rows = labelled_texts(docs, labels).select("doc_id", "text", "lang", "label")
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "text", F.coalesce("lang", F.lit("")))
    got = rows.mapInArrow(run, "model binary").first()
    return pickle.loads(got.model) if got else None


def corpus_share(model: Model | None, above_half: float) -> float:
    """The share of bad texts in a corpus of which ``above_half`` has a score of 0.5 or more, corrected by the hits and
    false alarms on the held-out texts; at least one in a thousand and at most half."""
    if model is None or not len(model.held[0]):
        return float(np.clip(above_half, 0.001, 0.5))
    score, bad, _ = model.held
    hits, false = (float((score[x] >= 0.5).mean()) if x.any() else d for x, d in ((bad, 1.0), (~bad, 0.0)))
    return float(np.clip((above_half - false) / max(hits - false, 0.1), 0.001, 0.5))


def thresholds(model: Model | None, share: float) -> dict[str, float]:
    """The threshold of every language, of all held-out texts where a language has few."""
    if model is None:
        return dict.fromkeys(LANGUAGES, 2.0)
    score, bad, lang = model.held
    weight = np.where(bad, 1.0, (1 - share) / share * bad.sum() / max((~bad).sum(), 1))
    whole, out = best_threshold(score, bad, weight), {}
    for code in LANGUAGES:
        at = lang == code
        enough = min((bad & at).sum(), (~bad & at).sum()) >= 25
        out[code] = best_threshold(score[at], bad[at], weight[at]) if enough else whole
    return out


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, source, language, score and category of every document.

    The score is in 0..1; NULL, empty and wordless texts have 0; without a model so have all.
    ``category`` is the likeliest of abuse, hate, sexual. Repeated rows are scored each, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, Hasher()
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                split = [words(t) if t else [] for t in part.column("text").to_pylist()]
                langs = [language(w, g) for w, g in zip(split, part.column("lang").to_pylist())]
                p = np.tile(np.array([1.0, 0, 0, 0]), (len(split), 1))
                some = [i for i, w in enumerate(split) if w]
                if m is not None and some:
                    p[some] = m.scores([hasher.ids(split[i]) for i in some])
                score = 1 - p[:, 0]
                category = [CLASSES[1 + k] for k in p[:, 1:].argmax(1)]
                cols = [part.column("doc_id"), part.column("source"), pa.array(langs), pa.array(np.round(score, 4)), pa.array(category)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "language", "score", "category"])

    return docs.select("doc_id", "source", "text", "lang").mapInArrow(rows, "doc_id bigint, source string, language string, score double, category string")


def screened(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the reviewed texts, scores all documents (:func:`score_documents`) and adds ``flagged``."""
    model = train(docs, labels)
    scored = cut(score_documents(docs, model))
    above = scored.agg(F.avg((F.col("score") >= 0.5).cast("double"))).first()[0] or 0.0
    limits = thresholds(model, corpus_share(model, above))
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("language")]
    return scored.withColumn("flagged", F.col("score") >= limit)


def rates(scored: DataFrame) -> DataFrame:
    """Per source (NULL sources as one): n_documents, n_flagged, rate, mean_score."""
    n = F.sum(F.col("flagged").cast("bigint"))
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), n.alias("n_flagged"), F.round(n / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"))
