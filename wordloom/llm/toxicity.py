"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's vector is the sum of the embeddings of its hash and of its head's
hash (the first few bytes).  Filters of several widths run over the whole
text, each keeps its maximum, and a logistic layer gives the score.  The
model is fitted on the whole texts of all labelled documents: shards of them
are learnt side by side on the executors, from one model, and what they have
learnt is averaged, round by round.  The driver holds the model only.
Scoring reads every whole text, in Arrow batches on the executors.  Scores
depend on the text alone; the cut above which a document is rejected may
differ by language, as calibrated on all documents that were set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.batches import WordHasher, byte_table, text_slices, utf8_texts
from wordloom.llm.graph import written
from wordloom.llm.sieve import likely_in

# Words are runs of ASCII letters and of all bytes of other characters.
NO_LETTER = byte_table(bytes(b for b in range(128) if not chr(b).isalpha()))
HEAD_BYTES = 5
WIDTHS = (1, 2, 3)
# Bits of the table of labelled ids that rules out the texts that have no label.
LABEL_BITS = 26
PAD = 3  # zero rows behind each text, so that no window reaches into the next


@dataclass(frozen=True)
class FitSizes:
    """What one task learns at a time (documents, words), how many words and heads the model knows (the ones in most texts), passes over all shards."""

    shard_docs: int = 8192
    shard_words: int = 4 << 20
    known: int = 100_000
    rounds: int = 2


def tokens(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, head hashes, first word of each text) as 32-bit values."""
    word, first = hasher(texts)
    short = lambda h: (h >> np.uint64(32)).astype(np.uint32)
    return short(word), short(hasher.heads), first


def word_hasher() -> WordHasher:
    return WordHasher(NO_LETTER, lower=True, prefix=HEAD_BYTES)


@dataclass
class TextCnn:
    word_keys: np.ndarray          # sorted hashes of known words; row i + 1 of word_rows is key i's, row 0 is zero
    head_keys: np.ndarray
    word_rows: np.ndarray
    head_rows: np.ndarray
    filters: list = field(default_factory=list)   # per width: (width, dim, filters)
    bias: list = field(default_factory=list)      # per width: (filters,)
    out: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)       # calibrated logit = a * raw + b
    cuts: dict = field(default_factory=dict)      # language -> score from which a document is rejected

    @staticmethod
    def lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(values), np.int32)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[at] == values, at + 1, 0).astype(np.int32)

    def rows(self, word: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.lookup(self.word_keys, word), self.lookup(self.head_keys, head)

    @staticmethod
    def padded(w: np.ndarray, h: np.ndarray, first: np.ndarray):
        """Row numbers with PAD zeros behind each text; (words, heads, start of each text, whether a window may start there)."""
        n = np.diff(first)
        start = first[:-1] + PAD * np.arange(len(n))
        at = np.arange(len(w)) + PAD * np.repeat(np.arange(len(n)), n)
        ww, hh = np.zeros(len(w) + PAD * len(n), np.int32), np.zeros(len(w) + PAD * len(n), np.int32)
        ww[at], hh[at] = w, h
        opens = np.zeros(len(ww), bool)
        opens[at] = True
        opens[start[n == 0]] = True
        return ww, hh, start, opens

    def responses(self, ww, hh, opens) -> list[np.ndarray]:
        e = self.word_rows[ww] + self.head_rows[hh]
        out = []
        for w, b in zip(self.filters, self.bias):
            z = np.full((len(ww), w.shape[2]), -np.inf, np.float32)
            m = len(ww) - len(w) + 1
            # Sums of a product may depend on its number of rows: a long text has the same steps whole and in pieces.
            for at in range(0, m, STEP_WORDS):
                end = min(m, at + STEP_WORDS)
                z[at:end] = sum(e[at + j:end + j] @ w[j] for j in range(len(w))) + b
            z[~opens] = -np.inf
            out.append(z)
        return out

    def raw(self, word, head, first) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0, np.float32)
        ww, hh, start, opens = self.padded(*self.rows(word, head), first)
        pooled = np.concatenate([np.maximum.reduceat(z, start, axis=0) for z in self.responses(ww, hh, opens)], axis=1)
        return np.maximum(pooled, 0) @ self.out[:-1] + self.out[-1]

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * raw.astype(np.float64) + self.scale[1], -40, 40)))


# Words that one step of fitting or scoring looks at; a longer text is pooled piece by piece.
STEP_WORDS = 1 << 18
# Texts and words of a minibatch.
BATCH, BATCH_WORDS = 32, 1 << 16
# Texts that a model of one shard learns, each as often as it takes; passes over the first shard of several.
VISITS, FIRST_PASSES = 38_400, 3
# Rows of an embedding table that are averaged together, steps of a raw score that calibration tells apart.
BLOCK_ROWS = 8192
RAW_STEPS = 256


def _tops(m: TextCnn, ww, hh, start, opens) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each text's greatest response of every filter and the place of its window, by width."""
    if len(start) > 1 or len(ww) <= STEP_WORDS:
        z = m.responses(ww, hh, opens)
        ends = [*start[1:].tolist(), len(ww)]
        top = [np.stack([x[a:b].argmax(0) + a for a, b in zip(start.tolist(), ends)]) for x in z]
        return [np.take_along_axis(x, t, 0) for x, t in zip(z, top)], top
    best = top = None
    for at in range(0, len(ww), STEP_WORDS):
        end = min(len(ww), at + STEP_WORDS + max(WIDTHS) - 1)
        inside = opens[at:end].copy()
        if end < len(ww):
            inside[STEP_WORDS:] = False
        z = m.responses(ww[at:end], hh[at:end], inside)
        t = [x.argmax(0)[None] for x in z]
        v = [np.take_along_axis(x, y, 0) for x, y in zip(z, t)]
        if best is None:
            best, top = v, t
        else:
            top = [np.where(x > y, a + at, b) for x, y, a, b in zip(v, best, t, top)]
            best = [np.maximum(x, y) for x, y in zip(v, best)]
    return best, top


def new_model(word_keys: np.ndarray, head_keys: np.ndarray, dim: int = 12, filters: int = 12, seed: int = 7) -> TextCnn:
    rng = np.random.default_rng(seed)
    m = TextCnn(word_keys, head_keys, rng.normal(0, 0.1, (len(word_keys) + 1, dim)).astype(np.float32), rng.normal(0, 0.1, (len(head_keys) + 1, dim)).astype(np.float32))
    m.word_rows[0] = m.head_rows[0] = 0
    m.filters = [rng.normal(0, (k * dim) ** -0.5, (k, dim, filters)).astype(np.float32) for k in WIDTHS]
    m.bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
    m.out = np.concatenate([rng.normal(0, 0.1, filters * len(WIDTHS)), [0]]).astype(np.float32)
    return m


def parameters(m: TextCnn) -> dict[str, np.ndarray]:
    """Everything that is learnt, by name; ``w`` and ``h`` have a row a word and a head."""
    return {"w": m.word_rows, "h": m.head_rows, "out": m.out} | {f"f{i}": f for i, f in enumerate(m.filters)} | {f"b{i}": b for i, b in enumerate(m.bias)}


def learn(m: TextCnn, squares: dict[str, np.ndarray], touched: dict[str, np.ndarray], rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray,
          rate: float, rng: np.random.Generator, drop_words: float = 0.5) -> None:
    """One pass of minibatches over the texts (rows of their words and heads), in a random order, by AdaGrad on the model in place."""
    def step(name, x, g, at=None):
        """AdaGrad, on the touched rows only where ``at`` names them."""
        s = squares[name]
        if at is None:
            s += g * g
            x -= rate * g / np.sqrt(s)
        else:
            s[at] += g * g
            x[at] -= rate * g / np.sqrt(s[at])
            touched[name][at] = True

    filters = m.bias[0].shape[0]
    order = rng.permutation(len(rows))
    total = np.cumsum([len(rows[i][0]) for i in order])
    at = 0
    while at < len(order):
        end = min(at + BATCH, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_WORDS, side="right"))))
        pick, at = order[at:end], end
        first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
        w = np.concatenate([rows[i][0] for i in pick])
        h = np.concatenate([rows[i][1] for i in pick])
        drop = rng.random(len(w)) < drop_words  # a text must not hang on a single word
        ww, hh, start, opens = m.padded(np.where(drop, 0, w), np.where(drop, 0, h), first)
        best, top = _tops(m, ww, hh, start, opens)
        pooled = np.concatenate(best, axis=1)
        act = np.maximum(pooled, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ m.out[:-1] + m.out[-1], -30, 30)))
        err = weight[pick] * (p - labels[pick]) / len(pick)
        back = err[:, None] * m.out[:-1] * (pooled > 0)
        step("out", m.out, np.concatenate([act.T @ err + 1e-4 * m.out[:-1], [err.sum()]]).astype(np.float32))
        gw, gh = [], []
        for i, (f, t) in enumerate(zip(m.filters, top)):
            g = back[:, i * filters:(i + 1) * filters].astype(np.float32)
            grad = np.empty_like(f)
            for j in range(len(f)):
                a, b = ww[t + j], hh[t + j]
                e = m.word_rows[a] + m.head_rows[b]
                grad[j] = np.einsum("bfd,bf->df", e, g)
                d = g[:, :, None] * f[j].T
                hot = g != 0
                gw.append((a[hot], d[hot]))
                gh.append((b[hot], d[hot]))
            step(f"f{i}", f, grad + 1e-5 * f)
            step(f"b{i}", m.bias[i], g.sum(0))
        for name, table, parts in (("w", m.word_rows, gw), ("h", m.head_rows, gh)):
            idx = np.concatenate([x for x, _ in parts])
            some, place = np.unique(idx, return_inverse=True)
            sums = np.zeros((len(some), table.shape[1]), np.float32)
            np.add.at(sums, place, np.concatenate([d for _, d in parts]))
            keep = some > 0
            step(name, table, sums[keep], some[keep])


def _known(examples: DataFrame, column: str, most: int) -> np.ndarray:
    """Sorted hashes that occur in at least two of the texts, of more than ``most`` those in most texts."""
    def run(batches):
        for b in batches:
            texts = [np.unique(np.frombuffer(x, np.uint32)) for x in b.column(column).to_pylist()]
            key, n = np.unique(np.concatenate(texts) if texts else np.zeros(0, np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["key", "n"])

    counts = examples.select(column).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()  # ``most`` numbers
    return np.sort(got.column("key").to_numpy().astype(np.uint32))


def _shard_passes(spark, shards: DataFrame, m: TextCnn, squares: dict, weights: tuple[float, float], rates: list[float], sizes: FitSizes, seed: int) -> None:
    """Every partition of ``shards`` (id, y, words, heads) learns from a copy of the model, once for each of ``rates``; the model then moves by the mean of what they learnt.

    An embedding moves by the mean over the shards that touched it.
    """
    shared = spark.sparkContext.broadcast((m, squares))

    def run(batches):
        from copy import deepcopy

        from pyspark import TaskContext
        start, before = shared.value
        own, sq = deepcopy(start), deepcopy(before)
        touched = {name: np.zeros(len(x), bool) for name, x in (("w", own.word_rows), ("h", own.head_rows))}
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, words, n = [], 0, 0

        def pass_over(held):
            held.sort(key=lambda r: (r[0], r[1]))
            y = np.array([r[3] for r in held], np.float32)
            rows = []
            for k, (_, w, h, _) in enumerate(held):  # hashes go as their row numbers come
                rows.append(own.rows(np.frombuffer(w, np.uint32), np.frombuffer(h, np.uint32)))
                held[k] = None
            for rate in rates:
                learn(own, sq, touched, rows, y, np.where(y == 1, weights[1], weights[0]).astype(np.float32), rate, rng)

        for b in batches:
            for i, w, h, y in zip(*(b.column(c).to_pylist() for c in ("id", "words", "heads", "y"))):
                held.append((i, w, h, y))
                words += len(w) // 4
                n += 1
                if words >= sizes.shard_words or len(held) >= sizes.shard_docs:
                    pass_over(held)
                    held, words = [], 0
        if held:
            pass_over(held)
        if n:
            old = parameters(start)
            for name, x in parameters(own).items():
                moved = np.flatnonzero(touched[name]) if name in touched else np.arange(len(x))
                for block in np.unique(moved // BLOCK_ROWS):
                    at = moved[moved // BLOCK_ROWS == block]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(block)]), pa.array([1.0 if name in touched else float(n)]), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                                                      pa.array([(x[at] - old[name][at]).tobytes()], pa.binary()), pa.array([(sq[name][at] - before[name][at]).tobytes()], pa.binary())], names)

    width = {name: int(np.prod(x.shape[1:], dtype=int)) for name, x in parameters(m).items()}

    def mean(key: Tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, base = key[0].as_py(), key[1].as_py() * BLOCK_ROWS
        weight, total = np.zeros(BLOCK_ROWS), np.zeros((2, BLOCK_ROWS, width[name]))
        for t in tables:
            for n, at, *parts in zip(*(t.column(c).to_pylist() for c in names[2:])):
                at = np.frombuffer(at, np.int32) - base
                weight[at] += n
                for side, part in enumerate(parts):
                    total[side, at] += n * np.frombuffer(part, np.float32).reshape(len(at), -1)
        at = np.flatnonzero(weight)
        means = (total[:, at] / weight[at][:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([key[1].as_py()]), pa.array([1.0]), pa.array([(at + base).astype(np.int32).tobytes()], pa.binary()),
                                          *(pa.array([x.tobytes()], pa.binary()) for x in means)], names)

    names = ["name", "block", "n", "at", "moved", "squares"]
    kind = "name string, block long, n double, at binary, moved binary, squares binary"
    done = parameters(m)
    for r in shards.mapInArrow(run, kind).groupBy("name", "block").applyInArrow(mean, kind).collect():  # the model's size
        x, at = done[r["name"]], np.frombuffer(r["at"], np.int32)
        x[at] += np.frombuffer(r["moved"], np.float32).reshape(x[at].shape)
        squares[r["name"]][at] += np.frombuffer(r["squares"], np.float32).reshape(x[at].shape)
    shared.unpersist()


def fit_text_cnn(examples: DataFrame, size: dict[int, int], sizes: FitSizes = FitSizes(), seed: int = 7) -> TextCnn:
    """Fit on all ``examples`` (id, lang, y, aside, words, heads) that aren't set aside, calibrate score and cuts on all that are.

    ``size`` counts the corpus's documents of each label.  The first shard gives
    the start (it is all there is of a small corpus), then all shards are learnt in ``sizes.rounds`` rounds.
    Without both labels every score is the prior.
    """
    prior = size.get(1, 0) / sum(size.values()) if size else 0.5
    shown = examples.where("not aside")
    n, positive, words = shown.agg(F.count(F.lit(1)), F.sum("y"), F.sum(F.length("words")) / 4).first()
    if not n or not 0 < positive < n:
        m = new_model(np.zeros(0, np.uint32), np.zeros(0, np.uint32), seed=seed)
        p = min(max(prior, 1e-6), 1 - 1e-6)
        m.scale = (0.0, float(np.log(p / (1 - p))))
        return m
    m = new_model(_known(shown, "words", sizes.known), _known(shown, "heads", sizes.known), seed=seed)
    squares = {name: np.full(x.shape, 1e-3, np.float32) for name, x in parameters(m).items()}
    # Both labels weigh the same, whatever their shares.
    weights = (0.5 * n / (n - positive), 0.5 * n / positive)
    spark, rows = examples.sparkSession, shown.select("id", "y", "words", "heads")
    shards = int(max(1, -(-n // sizes.shard_docs), -(-words // sizes.shard_words)))
    first = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(shards)) == 0)
    passes = max(8, -(-VISITS // n)) if shards == 1 else FIRST_PASSES
    _shard_passes(spark, first.coalesce(1), m, squares, weights, [0.08 * (1 - 0.8 * i / passes) for i in range(passes)], sizes, seed)
    for r in range(sizes.rounds if shards > 1 else 0):
        _shard_passes(spark, rows.coalesce(shards), m, squares, weights, [0.04 * (1 - 0.8 * r / sizes.rounds)], sizes, seed + 1 + r)

    shared = spark.sparkContext.broadcast(m)

    def raw(batches):
        for b in batches:
            out = []
            for w, h in zip(*(b.column(c).to_pylist() for c in ("words", "heads"))):
                out.append(_raw(shared.value, np.frombuffer(w, np.uint32), np.frombuffer(h, np.uint32), np.array([0, len(w) // 4]))[0])
            step = np.rint(np.clip(np.array(out, np.float64), -1000, 1000) * RAW_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("y"), pa.array(step)], ["lang", "y", "step"])

    # Languages and steps are few.
    got = examples.where("aside").select("lang", "y", "words", "heads").mapInArrow(raw, "lang string, y int, step int").groupBy("lang", "y", "step").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("lang", "y", "step").collect()
    _calibrate(m, np.array([r["step"] / RAW_STEPS for r in got]), np.array([r["y"] for r in got], np.float32), np.array([r["n"] for r in got], float), [r["lang"] for r in got], prior)
    return m


def _calibrate(m: TextCnn, raw: np.ndarray, y: np.ndarray, n: np.ndarray, langs: list, prior: float) -> None:
    """Logistic scaling of the raw scores (``n`` documents each) under the corpus's share of label 1, then one cut a language."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    a, b = 1.0, 0.0
    if len(np.unique(y)) == 2:
        mean = lambda x: float((n * x).sum() / n.sum())
        weight = np.where(y == 1, prior / mean(y), (1 - prior) / (1 - mean(y)))
        x = raw.astype(np.float64)
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g, k = weight * (p - y), weight * p * (1 - p) + 1e-9
            step = np.linalg.solve(np.array([[mean(k * x * x) + 1e-4, mean(k * x)], [mean(k * x), mean(k) + 1e-4]]), [mean(g * x) + 1e-4 * (a - 1), mean(g)])
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
            if abs(step).max() < 1e-9:
                break
    m.scale = (float(a), float(b))
    s = m.score(raw)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        bad, good = own & (y == 1), own & (y == 0)
        if n[bad].sum() >= 5 and n[good].sum() >= 5:
            # The cut with the fewest errors under the prior; of a range of equal cuts the one nearest to 0.5.
            edge = np.unique(np.concatenate([s[own], [0.0, 1.0]]))
            cuts = np.clip(np.concatenate([(edge[1:] + edge[:-1]) / 2, [0.5]]), 0.3, 0.9)
            miss = [(prior * n[bad & (s < c)].sum() / n[bad].sum() + (1 - prior) * n[good & (s >= c)].sum() / n[good].sum(), abs(c - 0.5), c) for c in np.unique(cuts)]
            m.cuts[lang] = float(min(miss)[2])


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_texts(texts: DataFrame, y: DataFrame) -> DataFrame:
    """``texts`` joined with ``y`` (id unique, y); only texts that a bit table of the labelled ids lets through are shuffled.

    Labels are shuffled at every size: the work grows with the corpus, without a jump where they get too many to be broadcast.
    """
    return texts.where(likely_in(y, "id", bits=LABEL_BITS)(F.col("id"))).join(y.hint("shuffle_hash"), "id")


def train(docs: DataFrame, labels: DataFrame, sizes: FitSizes = FitSizes(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", label_col: str = "toxic") -> TextCnn:
    """Fit on the whole texts of all labelled documents; one fifth of them, by a hash of the id, calibrates.

    Held-out rows, null ids and null labels are not learnt from.  The
    documents' hashes of words are written once, on shared storage.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")) \
        .agg(F.max(F.col(label_col).cast("int")).alias("y")).where(~held_out(F.col("id")))
    y = written(y, "labels_learnt")
    size = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                        (F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang"))

    def run(batches):
        hasher = word_hasher()
        for b in batches:
            for a, z in text_slices(b, "text"):
                word, head, first = tokens(hasher, utf8_texts(b.column("text").slice(a, z - a)))
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c).slice(a, z - a) for c in ("id", "lang", "y", "aside")] + [cut(word), cut(head)],
                                                 ["id", "lang", "y", "aside", "words", "heads"])

    labelled = labelled_texts(texts, y).withColumn("aside", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(5)) == 0).select("id", "text", "lang", "y", "aside")
    examples = written(labelled.mapInArrow(run, "id long, lang string, y int, aside boolean, words binary, heads binary"), "labelled_words")
    return fit_text_cnn(examples, size, sizes)


def score_documents(docs: DataFrame, model: TextCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; null texts count as empty, which have a score like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = word_hasher()
        for b in batches:
            for a, z in text_slices(b, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(a, z - a), pa.array(_scores(shared.value, hasher, utf8_texts(b.column("text").slice(a, z - a))))],
                                                 ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def _scores(model: TextCnn, hasher: WordHasher, texts: list[bytes]) -> np.ndarray:
    return model.score(_raw(model, *tokens(hasher, texts)))


def _raw(model: TextCnn, word: np.ndarray, head: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(first) == 2 and len(word) > STEP_WORDS:
        # Pieces overlap by the widest filter; the raw score needs the maximum over all pieces.
        reach = max(WIDTHS) - 1
        pooled = None
        for at in range(0, len(word), STEP_WORDS):
            piece = slice(at, min(len(word), at + STEP_WORDS + reach))
            n = piece.stop - piece.start
            ww, hh, start, opens = model.padded(*model.rows(word[piece], head[piece]), np.array([0, n]))
            if piece.stop < len(word):
                opens[STEP_WORDS:] = False
            part = np.concatenate([np.maximum.reduceat(z, start, axis=0) for z in model.responses(ww, hh, opens)], axis=1)
            pooled = part if pooled is None else np.maximum(pooled, part)
        return np.maximum(pooled, 0) @ model.out[:-1] + model.out[-1]
    return model.raw(word, head, first)


def with_score(docs: DataFrame, model: TextCnn, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of its texts as column ``out``, slice by slice, for filters that keep all other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = word_hasher()
        for b in batches:
            for a, z in text_slices(b, text_col, 1 << 20):
                part = b.slice(a, z - a)
                score = _scores(shared.value, hasher, utf8_texts(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def cut_column(lang: Column, model: TextCnn) -> Column:
    """The score from which a document of that language is rejected; 0.5 for languages without a cut of their own."""
    cut = F.lit(0.5)
    for name, c in sorted(model.cuts.items()):
        cut = F.when(lang == name, F.lit(c)).otherwise(cut)
    return cut
