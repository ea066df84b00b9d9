"""Linear-chain sequence labelling (SEQ-1 fit, SEQ-2 decode, SEQ-3 label a dataset).

Features are (name, value) items, built by JVM expressions over the token
array.  The model is ``W[features, L]`` emission weights plus ``A[L, L]``
transition weights.  Its features are the names that the training texts
have, every name with a number of its own; with the base features these are
a few dozen names and one for each POS tag, with optional word forms as many
as there are words.

* decode: a projection.  A token's scores are sums of products with literal
  weights, those of ``name:value`` features are looked up within the row (see
  `lookup`); the best path is two folds over the scores.  No Python, no
  shuffle, the same on a stream.
* fit: every token's own record is stored once, as numbers and the numbers of
  its ``name:value`` features; a token's score adds the shares of its own and
  both neighbours' records.  Conditional log-likelihood with L2, minimised by
  L-BFGS until the loss no longer falls.  Each evaluation is one distributed
  pass: ``mapInArrow`` runs forward-backward over texts of one length at a time
  and adds up the gradient in blocks of features; a grouped sum adds the
  touched blocks of all tasks, and only that sum (bounded by the model's size)
  reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom import fixed
from wordloom.functions import text as T
from wordloom.operators import batches
from wordloom.operators import features as FE
from wordloom.operators.lookup import bounded_rows, with_lookup
from wordloom.session import stage_path

# ---------------------------------------------------------------------------
# feature encoding
# ---------------------------------------------------------------------------

# Features whose gradients travel as one row.
FEATURE_BLOCK = 2048
_NUMERIC = ["nouns_count", "verbs_count", "length"]
_BOOL = [("is_location", "is_location"), ("is_object", "is_object"), ("has_vowels", "has.vowels"),
         ("period", "period"), ("comma", "comma"), ("prepositions", "prepositions"),
         ("possessive", "possessive")]


def _kv(k, v) -> Column:
    return F.named_struct(F.lit("k"), k, F.lit("v"), v)


def _record_items(rec: Column, prefix: str, optional=()) -> list[Column]:
    """``struct<k, v>`` items of one feature record (string features become ``name:value`` with 1)."""
    items = [_kv(F.lit(prefix + n), rec[n].cast("double")) for n in _NUMERIC]
    items += [_kv(F.lit(prefix + name), rec[f].cast("double")) for f, name in _BOOL]
    items.append(_kv(F.concat(F.lit(prefix + "nltk_tag:"), rec["nltk_tag"]), F.lit(1.0)))
    # optional features by their value as text: name:true, name:upper, ...
    items += [_kv(F.concat(F.lit(f"{prefix}{n}:"), rec[n.replace(".", "_")].cast("string")), F.lit(1.0)) for n in optional]
    return items


def token_items(r: Column, optional=()) -> Column:
    """All ``(feature, value)`` items of one element of ``features.sequence_features``."""
    own = _record_items(r["feat"], "", optional)
    own += [_kv(F.lit("rawstring.start"), r["rawstring_start"].cast("double")),
            _kv(F.lit("rawstring.end"), r["rawstring_end"].cast("double")),
            _kv(F.lit("singleton"), r["singleton"].cast("double")),
            _kv(F.lit("bias"), F.lit(1.0))]
    items = F.array(*own)
    for side in ("previous", "next"):
        nb = r[side]
        side_items = _record_items(nb["f"], side + ":", optional) + [
            _kv(F.lit(side + ":rawstring.start"), nb["rawstring_start"].cast("double")),
            _kv(F.lit(side + ":rawstring.end"), nb["rawstring_end"].cast("double"))]
        items = F.concat(items, F.when(nb.isNotNull(), F.array(*side_items))
                         .otherwise(F.array().cast("array<struct<k:string,v:double>>")))
    return F.filter(items, lambda e: e["v"] != 0)


def with_items(df: DataFrame, tokens_col: str, lexicon: DataFrame | None = None, optional=(), gazetteer: DataFrame | None = None, out: str = "_it") -> DataFrame:
    """Add ``out``: for each token its array of (feature, value) items.

    ``lexicon`` (word, tag[, ord]) supplies the POS features, ``gazetteer``
    (kind, term) the location and object flags instead of the fixed lists.
    """
    pos = None
    st = df
    if lexicon is not None or gazetteer is not None:
        st, pos = FE.with_pos_array(df, tokens_col, lexicon, gazetteer, "_pos"), "_pos"
    st = st.withColumn("_sf", FE.sequence_features(tokens_col, pos, optional))
    return st.withColumn(out, F.transform("_sf", lambda r: token_items(r, optional))).drop("_sf", *([pos] if pos else []))


def with_features(df: DataFrame, tokens_col: str = "tokens", lexicon: DataFrame | None = None, optional=(), gazetteer: DataFrame | None = None) -> DataFrame:
    """Add ``ntok``, ``ftok``, ``fkey`` (the features' names) and ``fval`` for the token array; see `with_items`."""
    st = with_items(df, tokens_col, lexicon, optional, gazetteer)
    st = st.withColumn("ntok", F.size(tokens_col))
    st = st.withColumn("ftok", F.flatten(F.transform("_it", lambda it, t: F.transform(it, lambda e: t))))
    st = st.withColumn("fkey", F.flatten(F.transform("_it", lambda it: F.transform(it, lambda e: e["k"]))))
    st = st.withColumn("fval", F.flatten(F.transform("_it", lambda it: F.transform(it, lambda e: e["v"]))))
    return st.drop("_it")


# ---------------------------------------------------------------------------
# model and numpy kernels
# ---------------------------------------------------------------------------

@dataclass
class SequenceModel:
    features: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=lambda: list(fixed.MODEL_LABELS))
    optional: tuple = ()
    W: np.ndarray | None = None
    A: np.ndarray | None = None

    def __post_init__(self):
        L = len(self.labels)
        if self.W is None:
            self.W = np.zeros((len(self.features), L))
        if self.A is None:
            self.A = np.zeros((L, L))

    def by_role(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Weights by the feature's name without its prefix, as one vector for the token itself, the previous and the next
        token's record: (features with a number or a truth value, ``name:value`` features)."""
        L, plain, text = len(self.labels), {}, {}
        fixed_names = {*_NUMERIC, *(name for _, name in _BOOL), "rawstring.start", "rawstring.end", "singleton", "bias"}
        for i, name in enumerate(self.features):
            # the token before sees this one as its next, the token behind as its previous
            role, own = next(((k, name[len(p):]) for k, p in ((1, "previous:"), (2, "next:")) if name.startswith(p)), (0, name))
            part = plain if own in fixed_names else text
            part.setdefault(own, np.zeros(3 * L))[role * L:(role + 1) * L] = self.W[i]
        return plain, text

    def weights_frame(self, spark) -> DataFrame:
        """``(kind, name, label, w)``: feature weights, transitions (from, to) and the optional features' names."""
        rows = [("feature", n, self.labels[j], float(self.W[i, j])) for i, n in enumerate(self.features) for j in range(len(self.labels))]
        rows += [("transition", a, b, float(self.A[i, j])) for i, a in enumerate(self.labels) for j, b in enumerate(self.labels)]
        rows += [("optional", n, "", 0.0) for n in self.optional]
        return spark.createDataFrame(rows, "kind string, name string, label string, w double")

    def save(self, spark, path: str) -> None:
        """Model as Parquet: the weights frame."""
        self.weights_frame(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, labels=None) -> "SequenceModel":
        rows = spark.read.parquet(path).collect()  # the model: features * labels
        m = cls(features=sorted({r["name"] for r in rows if r["kind"] == "feature"}), labels=list(labels or fixed.MODEL_LABELS),
                optional=tuple(sorted(r["name"] for r in rows if r["kind"] == "optional")))
        pos, num = {x: i for i, x in enumerate(m.labels)}, {x: i for i, x in enumerate(m.features)}
        for r in rows:
            if r["kind"] == "feature":
                m.W[num[r["name"]], pos[r["label"]]] = r["w"]
            elif r["kind"] == "transition":
                m.A[pos[r["name"]], pos[r["label"]]] = r["w"]
        return m


def _segment_sum(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Sum ``rows`` into ``n`` slots by ``keys`` (keys ascending, as feature entries are)."""
    out = np.zeros((n, rows.shape[1]))
    if len(keys):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out[keys[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def emissions(W: np.ndarray, ntok: int, ftok, fidx, fval) -> np.ndarray:
    """Per-token label scores: sum of value * weight over the token's features."""
    if not len(fidx):
        return np.zeros((ntok, W.shape[1]))
    rows = np.asarray(fval)[:, None] * W[np.asarray(fidx, dtype=np.int64)]
    return _segment_sum(rows, np.asarray(ftok, dtype=np.int64), ntok)


def viterbi(E: np.ndarray, A: np.ndarray) -> np.ndarray:
    """Best label path; ties go to the smaller label index."""
    n, L = E.shape
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    score = E[0].copy()
    back = np.zeros((n, L), dtype=np.int64)
    for t in range(1, n):
        cand = score[:, None] + A
        back[t] = cand.argmax(0)
        score = cand.max(0) + E[t]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _lse(x, axis=None):
    m = np.max(x, axis=axis, keepdims=True)
    out = m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))
    return np.squeeze(out, axis=axis) if axis is not None else float(out.squeeze())


def forward_backward(E: np.ndarray, A: np.ndarray):
    """log Z, token marginals [n, L] and summed pair marginals [L, L]."""
    n, L = E.shape
    alpha = np.zeros((n, L))
    beta = np.zeros((n, L))
    alpha[0] = E[0]
    for t in range(1, n):
        alpha[t] = _lse(alpha[t - 1][:, None] + A, axis=0) + E[t]
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(A + (E[t + 1] + beta[t + 1])[None, :], axis=1)
    logz = _lse(alpha[-1], axis=0)
    marg = np.exp(alpha + beta - logz)
    pair = np.zeros((L, L))
    for t in range(1, n):
        pair += np.exp(alpha[t - 1][:, None] + A + (E[t] + beta[t])[None, :] - logz)
    return float(logz), marg, pair


# Scores that lie further apart (as logarithms) are added up as logarithms: products of their exponentials would run out of a double.
PRODUCT_RANGE = 600.0


def _forward_backward_logs(E: np.ndarray, A: np.ndarray):
    B, n, L = E.shape
    alpha = np.zeros((B, n, L))
    beta = np.zeros((B, n, L))
    alpha[:, 0] = E[:, 0]
    for t in range(1, n):
        alpha[:, t] = _lse(alpha[:, t - 1][:, :, None] + A[None], axis=1) + E[:, t]
    for t in range(n - 2, -1, -1):
        beta[:, t] = _lse(A[None] + (E[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
    logz = _lse(alpha[:, -1], axis=1)
    marg = np.exp(alpha + beta - logz[:, None, None])
    pair = np.zeros((L, L))
    for t in range(1, n):
        pair += np.exp(alpha[:, t - 1][:, :, None] + A[None] + (E[:, t] + beta[:, t])[:, None, :]
                       - logz[:, None, None]).sum(0)
    return logz, marg, pair


def forward_backward_batch(E: np.ndarray, A: np.ndarray):
    """``forward_backward`` for a batch of equal-length texts: E is [B, n, L].

    Returns log Z [B], marginals [B, n, L] and pair marginals summed over the batch [L, L].
    A step multiplies by exp(A) and scales to a sum of 1; no label's share of a step falls below exp(-PRODUCT_RANGE).
    """
    B, n, L = E.shape
    top = E.max(axis=2)
    if not A.max() - A.min() + (top - E.min(axis=2)).max() < PRODUCT_RANGE:
        return _forward_backward_logs(E, A)
    P, M = np.exp(E - top[:, :, None]), np.exp(A - A.max())
    alpha, beta, scale = np.empty((B, n, L)), np.ones((B, n, L)), np.empty((B, n))
    for t in range(n):
        alpha[:, t] = P[:, t] if t == 0 else (alpha[:, t - 1] @ M) * P[:, t]
        scale[:, t] = alpha[:, t].sum(axis=1)
        alpha[:, t] /= scale[:, t, None]
    pair = np.zeros((L, L))
    for t in range(n - 1, 0, -1):
        ahead = P[:, t] * beta[:, t] / scale[:, t, None]
        beta[:, t - 1] = ahead @ M.T
        pair += M * (alpha[:, t - 1].T @ ahead)
    return np.log(scale).sum(axis=1) + top.sum(axis=1) + (n - 1) * A.max(), alpha * beta, pair


def label_errors(E: np.ndarray, A: np.ndarray, ntok, y: np.ndarray):
    """Loss of a batch of texts, its derivative by every token's scores, and by the transitions.

    ``E`` and ``y`` hold the texts' tokens one behind the other; texts of one length are worked on together.
    """
    ntok, y = np.asarray(ntok, np.int64), np.asarray(y, np.int64)
    begin = np.cumsum(ntok) - ntok
    loss, D, GA = 0.0, np.zeros_like(E), np.zeros_like(A)
    for n in np.unique(ntok[ntok > 0]):
        rows = begin[ntok == n][:, None] + np.arange(n)  # [B, n]
        e, Y = E[rows], y[rows]
        logz, d, pair = forward_backward_batch(e, A)
        gold = np.take_along_axis(e, Y[:, :, None], 2)[:, :, 0].sum(1) + A[Y[:, :-1], Y[:, 1:]].sum(1)
        loss += float((logz - gold).sum())
        np.put_along_axis(d, Y[:, :, None], np.take_along_axis(d, Y[:, :, None], 2) - 1.0, 2)
        D[rows] = d
        GA += pair - np.bincount((Y[:, :-1] * len(A) + Y[:, 1:]).ravel(), minlength=A.size).reshape(A.shape)
    return loss, D, GA


def walk_errors(E: np.ndarray, A: np.ndarray, sizes: np.ndarray, y: np.ndarray):
    """`label_errors` of texts that are walked side by side (`batches.packed`): ``E`` and the derivative are [labels, places]."""
    out = batches.walk_errors(E, A, sizes, y, PRODUCT_RANGE)
    if out is not None:
        return out
    ntok = (np.asarray(sizes)[None, :] > np.arange(sizes[0])[:, None]).sum(axis=1)  # texts lie the longest first
    rows = batches.packed(ntok)[0]
    by_text = np.argsort(rows)
    loss, d, ga = label_errors(E.T[by_text], A, ntok, y[by_text])
    return loss, d[rows].T, ga


def batch_gradient(W: np.ndarray, A: np.ndarray, ntok, ftok, fidx, fval, ys):
    """Loss and gradients of a batch of texts, given by their features one by one."""
    L = W.shape[1]
    G = np.zeros_like(W)
    offs = np.concatenate([[0], np.cumsum([int(n) for n in ntok])]).astype(np.int64)
    joined = lambda parts, kind: np.concatenate([np.asarray(a, dtype=kind) for a in parts] or [np.zeros(0, kind)])
    tok = joined([np.asarray(a, np.int64) + offs[i] for i, a in enumerate(ftok)], np.int64)
    idx, val = joined(fidx, np.int64), joined(fval, np.float64)
    E = _segment_sum(val[:, None] * W[idx], tok, int(offs[-1])) if len(idx) else np.zeros((int(offs[-1]), L))
    loss, D, GA = label_errors(E, A, ntok, joined(ys, np.int64))
    if len(idx):
        contrib = val[:, None] * D[tok]
        for j in range(L):
            G[:, j] += np.bincount(idx, weights=contrib[:, j], minlength=G.shape[0])
    return loss, G, GA


def sequence_nll(E: np.ndarray, A: np.ndarray, y: np.ndarray) -> float:
    logz, _, _ = forward_backward(E, A)
    s = E[np.arange(len(y)), y].sum() + sum(A[y[t - 1], y[t]] for t in range(1, len(y)))
    return logz - s


# ---------------------------------------------------------------------------
# SEQ-2 / SEQ-3: decode
# ---------------------------------------------------------------------------

# Steps of a text that one inner fold walks: a fold's state is copied at every step, so it must not grow with the text.
STEPS = 128


def score_column(records: Column, model: SequenceModel, find) -> Column:
    """Every token's score for every label, from the tokens' records (`features.token_records`); ``find`` gives the weights of a
    ``name:value`` feature as `SequenceModel.by_role` has them.

    A record's share is worked out once, for the token itself and for both neighbours, as sums of products with literal weights.
    """
    L = len(model.labels)
    plain, _ = model.by_role()
    values = [(n, lambda r, n=n: r["f"][n]) for n in _NUMERIC] + [(name, lambda r, f=f: r["f"][f]) for f, name in _BOOL]
    values += [("rawstring.start", lambda r: r["rawstring_start"]), ("rawstring.end", lambda r: r["rawstring_end"])]
    values = [(plain[n], get) for n, get in values if n in plain and plain[n].any()]
    always = plain.get("bias", np.zeros(3 * L))
    alone = plain.get("singleton", np.zeros(3 * L))

    def total(parts, start: float):
        parts = ([F.lit(float(start))] if start else []) + parts
        out = parts[0] if parts else F.lit(0.0)
        for x in parts[1:]:
            out = out + x
        return out

    def share(r, n):
        def sums(x, found):
            return F.array(*[total([F.lit(float(w[k])) * F.get(x, i) for i, (w, _) in enumerate(values) if w[k]]
                                   + ([F.when(n == 1, float(alone[k])).otherwise(0.0)] if alone[k] else [])
                                   + [F.coalesce(F.get(F.get(found, s), k), F.lit(0.0)) for s in range(1 + len(model.optional))], always[k] if k < L else 0.0)
                             for k in range(3 * L)])

        keys = [F.concat(F.lit("nltk_tag:"), r["f"]["nltk_tag"])] + [F.concat(F.lit(f"{o}:"), r["f"][o.replace(".", "_")].cast("string")) for o in model.optional]
        x = F.array(*[get(r).cast("double") for _, get in values]) if values else F.array(F.lit(0.0))
        return T.let(x, lambda v: T.let(F.array(*[find(k) for k in keys]), lambda found: sums(v, found)))

    def joined(c):
        near = lambda v, k: F.coalesce(F.get(v, k), F.lit(0.0))
        return F.transform(c, lambda v, t: T.let(F.get(c, t - 1), lambda p: T.let(F.get(c, t + 1), lambda q: F.array(
            *[F.get(v, j) + near(p, L + j) + near(q, 2 * L + j) for j in range(L)]))))

    return T.let(F.size(records), lambda n: T.let(F.transform(records, lambda r: share(r, n)), joined))


def viterbi_column(scores: Column, A: np.ndarray) -> Column:
    """Label numbers of the best path over ``scores`` (array<array<double>>); ties go to the smaller number.

    The first fold keeps the labels' best scores and, for each token, the label before; the second walks these back.
    Both go ``STEPS`` tokens at a time: the labels of such a piece are one string, a character each.
    """
    L = len(A)
    none = lambda kind: F.array().cast(kind)
    number = lambda c: F.ascii(c) - ord("0")

    def first_of(value, best):
        """The first i whose ``value(i)`` is the best, as a character."""
        out = F.lit(chr(ord("0") + L - 1))
        for i in reversed(range(L - 1)):
            out = F.when(value(i) >= best, F.lit(chr(ord("0") + i))).otherwise(out)
        return out

    def path(e):
        def forward(acc, x):
            come = lambda i, j: F.get(acc["s"], i) + F.lit(float(A[i, j])) if A[i, j] else F.get(acc["s"], i)
            best = F.array(*[F.greatest(*[come(i, j) for i in range(L)]) if L > 1 else come(0, j) for j in range(L)])
            return T.let(best, lambda b: T.nstruct(s=F.array(*[F.get(b, j) + F.get(x, j) for j in range(L)]),
                                                   tail=F.concat(acc["tail"], *[first_of(lambda i, j=j: come(i, j), F.get(b, j)) for j in range(L)])))

        def forward_piece(acc, at):
            walked = F.aggregate(F.slice(e, at + 1, F.lit(STEPS)), T.nstruct(s=acc["s"], tail=F.lit("")), forward)
            return T.let(walked, lambda w: T.nstruct(s=w["s"], done=F.array_append(acc["done"], w["tail"])))

        def backward_piece(acc, before):
            """Labels of the tokens before those of the piece, from the last to the first."""
            def backward(own, i):
                at = F.substr(before, i * L + number(own["at"]) + 1, F.lit(1))
                return T.let(at, lambda c: T.nstruct(at=c, tail=F.concat(c, own["tail"])))

            steps = F.sequence((F.length(before) / L).cast("int") - 1, F.lit(0), F.lit(-1))
            return T.let(F.aggregate(steps, T.nstruct(at=acc["at"], tail=F.lit("")), backward),
                         lambda w: T.nstruct(at=w["at"], done=F.array_append(acc["done"], w["tail"])))

        pieces = F.when(F.size(e) > 1, F.sequence(F.lit(1), F.size(e) - 1, F.lit(STEPS))).otherwise(none("array<int>"))
        ahead = F.aggregate(pieces, T.nstruct(s=F.get(e, 0), done=none("array<string>")), forward_piece)
        last = lambda v: F.substr(F.lit("".join(chr(ord("0") + i) for i in range(L))), F.array_position(v["s"], F.array_max(v["s"])).cast("int"), F.lit(1))
        back = T.let(ahead, lambda v: T.let(last(v), lambda c: F.aggregate(
            F.reverse(v["done"]), T.nstruct(at=c, done=F.array(c)), backward_piece, lambda acc: F.reverse(acc["done"]))))
        return F.flatten(F.transform(back, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: number(F.substr(s, i, F.lit(1))))))

    return F.when(F.size(scores) == 0, none("array<int>")).otherwise(T.let(scores, path))


def known_words(lexicon: DataFrame | None, gazetteer: DataFrame | None) -> tuple[dict | None, bool] | None:
    """(what the tables say of words, whether that holds the location and object flags) for `batches`, or None beyond the bounds."""
    if lexicon is None and gazetteer is None:
        return None, False
    table = FE.word_table(lexicon, gazetteer)
    return None if bounded_rows(table) is None else (batches.known_words(table.collect()), gazetteer is not None)  # checked above


def decode(df: DataFrame, model: SequenceModel, tokens_col: str = "tokens", lexicon: DataFrame | None = None, gazetteer: DataFrame | None = None,
           out: str = "labels", batched: bool = False) -> DataFrame:
    """Best label sequence of every row's tokens (no tokens -> []), as column ``out``.

    ``batched`` works on Arrow batches of texts (`batches.Decoder`, the same
    sums in the same order) instead of a projection, which takes some 40 us a
    token; optional features and tables beyond the bounds are left to the projection.

    Features without a weight count nothing.  The weights of numbers and
    truth values are literals; those of ``name:value`` features are looked up
    within the row while they have a bounded size, and joined with the texts'
    distinct features beyond it.
    """
    if batched and not model.optional and (known := known_words(lexicon, gazetteer)):
        decoder = batches.Decoder(model, _RECORD, *known)

        def labelled(tokens: pa.Array) -> pa.Array:
            return decoder(tokens)

        return df.withColumn(out, F.arrow_udf(labelled, "array<string>")(F.col(tokens_col).cast("array<string>")))
    pos, st = None, df
    if lexicon is not None or gazetteer is not None:
        st, pos = FE.with_pos_array(df, tokens_col, lexicon, gazetteer, "_pos"), "_pos"
    st = st.withColumn("_r", F.coalesce(FE.token_records(tokens_col, pos, model.optional), F.array()))
    text = model.by_role()[1]
    table = pa.table({"key": pa.array(text, pa.string()), "value": pa.array([v.tolist() for v in text.values()], pa.list_(pa.float64()))})
    names = F.flatten(F.transform("_r", lambda r: F.array(F.concat(F.lit("nltk_tag:"), r["f"]["nltk_tag"]), *[
        F.concat(F.lit(f"{o}:"), r["f"][o.replace(".", "_")].cast("string")) for o in model.optional])))
    st = with_lookup(st, names, df.sparkSession.createDataFrame(table), lambda find: score_column(F.col("_r"), model, find), "_e")
    label = F.array(*[F.lit(x) for x in model.labels])
    return st.withColumn(out, T.let(label, lambda ls: F.transform(viterbi_column(F.col("_e"), model.A), lambda i: F.get(ls, i)))) \
        .drop("_r", "_e", *([pos] if pos else []))


def label_tokens(df: DataFrame, text_col: str, model: SequenceModel, lexicon: DataFrame | None = None,
                 gazetteer: DataFrame | None = None) -> DataFrame:
    """SEQ-2 on a text column: ``tokens`` (TOK-2 of the lower-cased text) and predicted ``labels``, the same on a stream."""
    return decode(df.withColumn("tokens", T.tokenize(F.lower(F.col(text_col)))), model, "tokens", lexicon, gazetteer, batched=True)


# ---------------------------------------------------------------------------
# SEQ-1: fit
# ---------------------------------------------------------------------------

def training_sequences(parsed: DataFrame, id_col: str = "line_id", labels=fixed.MODEL_LABELS) -> DataFrame:
    """Accepted training lines -> ``(id, tokens, y)``: each term tokenised, every token labelled with its term's label."""
    from wordloom.operators.labels import keep_rows
    ok = keep_rows(parsed, F.col("reason").isNull())
    per_term = F.transform("pairs", lambda p: F.transform(T.tokenize(p["term"]), lambda t: T.nstruct(
        t=t, l=p["label"])))
    lab = F.array(*[F.lit(x) for x in labels])
    st = ok.select(id_col, F.flatten(per_term).alias("_tl"))
    seqs = st.select(id_col, F.transform("_tl", lambda e: e["t"]).alias("tokens"),
                     F.transform("_tl", lambda e: (F.array_position(lab, e["l"]) - 1).cast("int")).alias("y"))
    return keep_rows(seqs, F.size("tokens") > 0)


def minimise(evaluate, x: np.ndarray, tolerance: float, memory: int = 8, history: list | None = None) -> np.ndarray:
    """L-BFGS with backtracking until a step lowers the loss by less than ``tolerance`` of it.

    ``evaluate(x)`` gives the loss and its gradient.
    """
    loss, grad = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        if history is not None:
            history.append(loss)
        way, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ way) / (s @ y))
            way -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, float(np.abs(grad).sum()))
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            way += s * (alpha - (y @ way) / (s @ y))
        slope, step = float(grad @ way), 1.0
        if slope <= 0:
            return x
        while True:
            new = x - step * way
            new_loss, new_grad = evaluate(new)
            if new_loss <= loss - 1e-4 * step * slope:
                break
            step /= 2
            if step * np.abs(way).max() < 1e-10:
                return x
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory:], (s, y)]
        first, gain = len(pairs) < 2, loss - new_loss
        x, loss, grad = new, new_loss, new_grad
        if gain < tolerance * max(1.0, abs(loss)) and not first:
            if history is not None:
                history.append(loss)
            return x


# A token's own record as numbers, and what its features are called with the record of the token itself, before and behind it.
_RECORD = [*_NUMERIC, *(name for _, name in _BOOL), "rawstring.start", "rawstring.end"]
ROLES = ("", "previous:", "next:")


def with_record_arrays(df: DataFrame, tokens_col: str, lexicon: DataFrame | None = None, optional=(), gazetteer: DataFrame | None = None) -> DataFrame:
    """Add ``x`` (the numbers of `_RECORD`, token by token) and ``names`` (the ``name:value`` features, as many for each token)."""
    pos, st = None, df
    if lexicon is not None or gazetteer is not None:
        st, pos = FE.with_pos_array(df, tokens_col, lexicon, gazetteer, "_pos"), "_pos"
    st = st.withColumn("_r", F.coalesce(FE.token_records(tokens_col, pos, optional), F.array()))
    fields = [*_NUMERIC, *(f for f, _ in _BOOL)]
    x = F.flatten(F.transform("_r", lambda r: F.array(*[r["f"][f].cast("int") for f in fields], r["rawstring_start"].cast("int"), r["rawstring_end"].cast("int"))))
    names = F.flatten(F.transform("_r", lambda r: F.array(F.concat(F.lit("nltk_tag:"), r["f"]["nltk_tag"]), *[
        F.concat(F.lit(f"{o}:"), r["f"][o.replace(".", "_")].cast("string")) for o in optional])))
    return st.withColumns({"x": x, "names": names}).drop("_r", *([pos] if pos else []))


# Tokens of the training texts that are stored, and worked on, as one row.
TEXTS_TOKENS = 1 << 16


def packed_training(train: DataFrame, tokens_col: str, y_col: str, lexicon: DataFrame | None, optional=(), gazetteer: DataFrame | None = None) -> DataFrame:
    """Training texts as rows of `batches.packed_texts`: ``sizes``, ``code``, ``y``, ``x`` (the records' numbers) and ``names``.

    Tokens are looked at by Arrow batch; with optional features, and with
    tables beyond the bounds, their records come from expressions.
    """
    per_token, width = 1 + len(optional), len(_RECORD) - 2
    known = None if optional else known_words(lexicon, gazetteer)
    source = train.select(F.col(tokens_col).cast("array<string>").alias("tokens"), F.col(y_col).cast("array<int>").alias("y"))
    if known is None:
        source = with_record_arrays(source, "tokens", lexicon, optional, gazetteer).select("tokens", "y", "x", "names")

    def records(b: pa.RecordBatch):
        """(number of every token's record, the records' numbers, their names)."""
        if known is not None:
            words = b.column("tokens").flatten().fill_null("").dictionary_encode()
            x, tag = batches.token_numbers(words.dictionary, *known)
            tag = pc.binary_join_element_wise("nltk_tag:", tag, "").dictionary_encode()
            rows, number = batches.distinct_rows(np.hstack([x, tag.indices.to_numpy(zero_copy_only=False)[:, None]]))
            number = number[words.indices.to_numpy(zero_copy_only=False)]
        else:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_RECORD))[:, :width]
            tag = b.column("names").flatten().dictionary_encode()
            rows, number = batches.distinct_rows(np.hstack([x, tag.indices.to_numpy(zero_copy_only=False).reshape(-1, per_token)]))
        return number, rows[:, :width], tag.dictionary.take(pa.array(rows[:, width:].ravel()))

    def pack(parts):
        for b in parts:
            ntok = pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not ntok.sum():
                continue
            y = b.column("y").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            number, x, names = records(b)
            for texts in batches.groups_of(ntok, TEXTS_TOKENS):
                places = batches.token_places(ntok, texts)
                row = batches.packed_texts(ntok[texts], y[places], number[places], x, names)
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in row[:4]), pa.array([row[4]], pa.list_(pa.string()))],
                                                 ["sizes", "code", "y", "x", "names"])

    return source.mapInArrow(pack, "sizes binary, code binary, y binary, x binary, names array<string>")


def _packed_rows(parts, *columns):
    """Rows of `packed_training`, one after the other: integers, the records' numbers as a table, names as a list."""
    for b in parts:
        for i in range(b.num_rows):
            row = [b.column(c)[i] for c in columns]
            row = [v.as_py() if c == "names" else np.frombuffer(v.as_buffer(), np.int32) for c, v in zip(columns, row)]
            yield [v.reshape(-1, len(_RECORD) + 1) if c == "x" else v for c, v in zip(columns, row)]


class Objective:
    """The CRF's regularised loss and gradient over a training table, as one distributed pass a call.

    ``train`` has token arrays and label indices.  Its features are every
    name that occurs (`features`, sorted); a point is the features' weights by
    label, then the transitions, as one vector.
    """

    def __init__(self, train: DataFrame, labels=fixed.MODEL_LABELS, l2: float = 0.01, tokens_col: str = "tokens", y_col: str = "y",
                 lexicon: DataFrame | None = None, optional=(), gazetteer: DataFrame | None = None):
        spark = train.sparkSession
        per_token = 1 + len(optional)
        path = stage_path(spark, "texts")
        packed_training(train, tokens_col, y_col, lexicon, optional, gazetteer).write.parquet(path)
        self.texts = spark.read.parquet(path)  # read in every pass

        def occurring(parts):
            found = set()
            for x, names in _packed_rows(parts, "x", "names"):
                numbers, alone = x[:, :-1], x[:, -1] != 0
                code, named = np.arange(len(names)).reshape(-1, per_token), np.array(names, object)
                # which records lie behind or before another one
                for role, rows in zip(ROLES, (slice(None), ~alone & (numbers[:, -1] == 0), ~alone & (numbers[:, -2] == 0))):
                    found |= {role + n for n, some in zip(_RECORD, (numbers[rows] != 0).any(axis=0)) if some}
                    found |= {role + n for n in set(named[code[rows].ravel()])}
                found |= {"bias"} | ({"singleton"} if alone.any() else set())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["k"])

        table = self.texts.select("x", "names").mapInArrow(occurring, "k string").distinct().orderBy("k").toArrow()  # the model's size
        self.features = table.column("k").to_pylist()
        number = {k: i for i, k in enumerate(self.features)}
        words = sorted({k[len(p):] for k in self.features for p in ROLES if k.startswith(p)} - {*_RECORD, "bias", "singleton"})
        # where a record's parts lie among the features, for each role; len(features) stands for no feature
        place = lambda names: np.array([[number.get(p + n, len(number)) for n in names] for p in ROLES], np.int64)
        self.places = place(_RECORD), place(words), place(["bias", "singleton"])[0]
        self.words = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # the model's size, as its weights
        self.spark, self.labels, self.l2, self.per_token = spark, list(labels), l2, per_token
        self.size = len(self.features) * len(self.labels) + len(self.labels) ** 2

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features' weights and the transitions of a point."""
        L = len(self.labels)
        return x[:-L * L].reshape(-1, L), x[-L * L:].reshape(L, L)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        L, D, per_token = len(self.labels), len(self.features), self.per_token
        W, A = self.split(x)
        bc = self.spark.sparkContext.broadcast((np.vstack([W, np.zeros((1, L))]), A, *self.places))

        def part_grad(parts, bc=bc, numbered=self.words):
            W, A, plain, words, (bias, singleton) = bc.value
            G, GA, loss = {}, np.zeros_like(A), 0.0

            def add(features, g):
                """Adds rows of gradients to those features' places."""
                own, at = np.unique(features, return_inverse=True)
                total = np.stack([np.bincount(at, weights=g[:, j], minlength=len(own)) for j in range(L)], axis=1)
                own, total = own[own < D], total[own < D]
                for b in np.unique(own // FEATURE_BLOCK).tolist():
                    mine = own // FEATURE_BLOCK == b
                    G.setdefault(b, np.zeros((FEATURE_BLOCK, L)))[own[mine] % FEATURE_BLOCK] += total[mine]

            for sizes, code, y, x, names in _packed_rows(parts, "sizes", "code", "y", "x", "names"):
                numbers, alone, y = x[:, :-1].astype(np.float64), x[:, -1] != 0, y.astype(np.int64)
                name = np.array([numbered.value[n] for n in names], np.int64).reshape(-1, per_token)
                # a record counts for its own token, for the one behind it (as previous) and for the one before it (as next)
                later, before = batches.walk(sizes)
                code, none = code.astype(np.int64), len(x)  # none: there is no token there
                seen = [code, np.full(len(code), none), np.full(len(code), none)]
                seen[1][later], seen[2][before] = code[before], code[later]
                for k in range(3):
                    S = numbers @ W[plain[k]] + W[words[k][name]].sum(axis=1)
                    if k == 0:
                        S += W[bias] + alone[:, None] * W[singleton]
                    scores = np.take(np.ascontiguousarray(np.vstack([S, np.zeros(L)]).T), seen[k], axis=1)
                    E = scores if k == 0 else np.add(E, scores, out=E)
                ls, d, ga = walk_errors(E, A, sizes, y)
                loss += ls
                GA += ga
                for k in range(3):
                    mine = np.stack([np.bincount(seen[k], weights=e, minlength=none + 1)[:none] for e in d], axis=1)
                    add(plain[k], numbers.T @ mine)
                    add(words[k][name].ravel(), np.repeat(mine, per_token, axis=0))
                    if k == 0:
                        add(np.array([bias, singleton]), np.stack([mine.sum(axis=0), mine[alone].sum(axis=0)]))
            rows = [(b, g.tobytes()) for b, g in G.items()] + [(-1, np.concatenate([[loss], GA.ravel()]).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([g for _, g in rows], pa.binary())], ["block", "g"])

        def added(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                for g in b.column("g").to_pylist():
                    total = total + np.frombuffer(g)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "g"])

        grads = self.texts.mapInArrow(part_grad, "block long, g binary")
        G, GA, loss = np.zeros((-(-D // FEATURE_BLOCK) * FEATURE_BLOCK, L)), np.zeros((L, L)), 0.0
        for r in grads.groupBy("block").applyInArrow(added, "block long, g binary").collect():  # the model's size
            g = np.frombuffer(r["g"])
            if r["block"] < 0:
                loss, GA = float(g[0]), g[1:].reshape(L, L)
            else:
                G[r["block"] * FEATURE_BLOCK:(r["block"] + 1) * FEATURE_BLOCK] = g.reshape(FEATURE_BLOCK, L)
        bc.unpersist()
        return loss + 0.5 * self.l2 * float(x @ x), np.concatenate([G[:D].ravel(), GA.ravel()]) + self.l2 * x


def fit(train: DataFrame, labels=fixed.MODEL_LABELS, tolerance: float = 1e-3, l2: float = 0.01, tokens_col: str = "tokens", y_col: str = "y",
        lexicon: DataFrame | None = None, optional=(), gazetteer: DataFrame | None = None, history: list | None = None) -> SequenceModel:
    """Fit a linear-chain CRF on ``(tokens, y)`` rows (y = label indices).

    Ends when an iteration lowers the loss by less than ``tolerance`` of it.
    """
    objective = Objective(train, labels, l2, tokens_col, y_col, lexicon, optional, gazetteer)
    W, A = objective.split(minimise(objective, np.zeros(objective.size), tolerance, history=history))
    return SequenceModel(features=objective.features, labels=list(labels), optional=tuple(optional), W=W.copy(), A=A.copy())
