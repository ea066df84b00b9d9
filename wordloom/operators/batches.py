"""Token records, scores and best paths of whole Arrow batches, as numpy arrays.

The rules are those of `features.token_record`, `sequence.score_column` and
`sequence.viterbi_column`, and so are the orders of the sums: a path is the
one that the projection finds.  A batch's distinct tokens are looked at once.
Texts are walked side by side, the longest first, so that the tokens at one
place of all texts lie one behind the other (`packed`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordloom import fixed

# Tokens that are worked on at a time.
TOKENS = 1 << 18
# Tokens of a batch's texts whose numbers are held at a time.
PIECE = 1 << 20
# Texts whose next scores are worked out at a time.
BLOCK = 1024


def known_words(rows: list[tuple]) -> dict:
    """What a lexicon and a gazetteer say of words (rows of `features.word_table`), as arrays beside the words."""
    kinds = (("nouns", pa.int32()), ("verbs", pa.int32()), ("tag", pa.string()), ("location", pa.bool_()), ("object", pa.bool_()))
    return {"words": pa.array([r["key"] for r in rows], pa.string()),
            **{name: pa.array([r["value"][name] for r in rows], kind) for name, kind in kinds}}


def _lower(tokens: pa.Array) -> pa.Array:
    """Lower case by the full mapping, which may change a text's length."""
    ascii_ = pc.string_is_ascii(tokens)
    if pc.all(ascii_).as_py() in (True, None):
        return pc.ascii_lower(tokens)
    return pa.array([t.lower() for t in tokens.to_pylist()], pa.string())


def token_numbers(tokens: pa.Array, known: dict | None = None, gazetteer: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(numbers and truth values of `features.token_record` in the order of `sequence._RECORD` without the places, tags) of tokens.

    ``gazetteer`` tells whether ``known`` has the location and object flags instead of the fixed lists.
    """
    number = lambda a: pc.cast(a, pa.int32()).to_numpy(zero_copy_only=False)
    one_of = lambda a, values: pc.is_in(a, value_set=pa.array(list(dict.fromkeys(values)), pa.string()))
    amp = pc.equal(tokens, "&")
    clean = pc.replace_substring_regex(pc.replace_substring_regex(_lower(tokens), r"^[^0-9A-Za-z_]+", ""), r"[^.0-9A-Za-z_]+$", "")
    abbrev = pc.if_else(amp, "&", pc.replace_substring_regex(clean, r"[^0-9A-Za-z_]+", ""))
    clean = pc.if_else(amp, "&", clean)
    length = pc.utf8_length(tokens)
    long = pc.greater_equal(length, fixed.GAZETTEER_MIN_LENGTH)
    nothing, tag = np.zeros(len(tokens), np.int32), pa.array([""] * len(tokens), pa.string())
    nouns = verbs = nothing
    location, object_ = (number(pc.and_(long, one_of(tokens, words))) for words in (fixed.LOCATIONS, fixed.OBJECTS))
    if known is not None:
        at = pc.index_in(tokens, value_set=known["words"])
        said = lambda name, other: pc.fill_null(pc.take(known[name], at), other)
        nouns, verbs, tag = number(said("nouns", 0)), number(said("verbs", 0)), said("tag", "")
        if gazetteer:
            location, object_ = number(said("location", False)), number(said("object", False))
    x = np.stack([nouns, verbs, number(length), location, object_, number(pc.match_substring_regex(abbrev, f"^.+[{fixed.VOWELS}]")),
                  number(pc.match_substring(tokens, ".")), number(pc.ends_with(tokens, ",")), number(one_of(abbrev, fixed.PREPOSITIONS)),
                  number(pc.ends_with(clean, "'s"))], axis=1)
    return x, tag


def packed(ntok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How texts, lying one behind the other, are walked side by side.

    (for every place of the walk its token, texts that reach each step, every
    place but those of the first step, the place of the token before each of these).
    """
    ntok = np.asarray(ntok, np.int64)
    begin, order = np.cumsum(ntok) - ntok, np.argsort(-ntok, kind="stable")
    order = order[:np.count_nonzero(ntok)]
    longest = int(ntok[order[0]]) if len(order) else 0
    sizes = np.searchsorted(-ntok[order], -np.arange(longest), side="left")  # texts of more tokens than the step's number
    step, first = np.repeat(np.arange(longest), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    tokens = begin[order][np.arange(len(step)) - first] + step
    later, before = walk(sizes)
    return tokens, sizes, later, before


def walk(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places that have a token before them, the place of that token) of a walk in steps of ``sizes`` texts."""
    later = np.arange(sizes[0] if len(sizes) else 0, int(sizes.sum()))
    return later, later - np.repeat(sizes[:-1], sizes[1:])


def best_paths(E: np.ndarray, A: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best label numbers of a walk; ``E`` is [labels, places].  Ties go to the smaller number, as in `sequence.viterbi`."""
    n = E.shape[1]
    S, path, into = np.empty_like(E), np.empty(n, np.int64), np.ascontiguousarray(A.T)
    if not n:
        return path
    ends = np.cumsum(sizes)
    S[:, :ends[0]] = E[:, :ends[0]]
    for t in range(1, len(sizes)):
        b, at = sizes[t], ends[t - 1]
        s = S[:, at - sizes[t - 1]:at - sizes[t - 1] + b]
        for k in range(0, b, BLOCK):
            np.max(s[None, :, k:k + BLOCK] + into[:, :, None], axis=1, out=S[:, at + k:at + min(b, k + BLOCK)])
        S[:, at:at + b] += E[:, at:at + b]
    for t in range(len(sizes) - 1, -1, -1):
        b, at = sizes[t], ends[t] - sizes[t]
        more = sizes[t + 1] if t + 1 < len(sizes) else 0  # texts that go on; the others end here
        if more < b:
            path[at + more:at + b] = S[:, at + more:at + b].argmax(axis=0)
        if more:
            path[at:at + more] = (S[:, at:at + more] + A[:, path[ends[t]:ends[t] + more]]).argmax(axis=0)
    return path


def groups_of(ntok: np.ndarray, most: int = TOKENS) -> list[np.ndarray]:
    """The numbers of texts of like length, of at most ``most`` tokens together or one text."""
    order = np.argsort(-ntok, kind="stable")
    order = order[:np.count_nonzero(ntok)]
    cuts, total = [], 0
    for i, n in enumerate(ntok[order].tolist()):
        if total and total + n > most:
            cuts.append(i)
            total = 0
        total += n
    return [g for g in np.split(order, cuts) if len(g)]


def token_places(ntok: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The places of the tokens of some texts, text by text."""
    begin, n = (np.cumsum(ntok) - ntok)[texts], ntok[texts]
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def pieces(tokens: pa.Array, most: int = PIECE):
    """(from, to) of the texts that are worked on together, ``most`` tokens at most or one text."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends) or at == 0:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


class Decoder:
    """Labels of an Arrow list of token lists under a model (arrays only, so it travels with a task)."""

    def __init__(self, model, record: list[str], known: dict | None, gazetteer: bool):
        plain, text = model.by_role()
        L = len(model.labels)
        zero = np.zeros(3 * L)
        self.weights = [plain.get(n, zero) for n in record]  # numbers and truth values, then the places
        self.always, self.alone = plain.get("bias", zero).copy(), plain.get("singleton", zero)
        self.always[L:] = 0.0
        self.tags = pa.array(text, pa.string())
        self.tag_weights = np.vstack([*text.values(), zero])  # the last one is for other tags
        self.labels, self.A, self.known, self.gazetteer = list(model.labels), model.A, known, gazetteer

    def shares(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens' scores before places and tags are added, and those of their tags: [labels of the three roles, tokens] each."""
        x, tag = token_numbers(tokens, self.known, self.gazetteer)
        base = np.repeat(self.always[:, None], len(tokens), axis=1)
        for w, values in zip(self.weights, x.T):
            if w.any():
                base += w[:, None] * values
        names = pc.binary_join_element_wise("nltk_tag:", tag, "")
        at = pc.fill_null(pc.index_in(names, value_set=self.tags), len(self.tags)).to_numpy(zero_copy_only=False)
        return base, self.tag_weights[at].T

    def numbers(self, ntok: np.ndarray, words: pa.DictionaryArray) -> np.ndarray:
        """Label numbers of all tokens; ``words`` has them text by text."""
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        base, tag = self.shares(words.dictionary)
        L, n = len(self.labels), len(words.dictionary)
        middle, out = base + tag, np.empty(len(code), np.int64)
        for texts in groups_of(ntok):
            places, own = token_places(ntok, texts), ntok[texts]
            rows, sizes, later, before = packed(own)
            c = code[places][rows]
            # first and last tokens get columns of their own
            size = np.repeat(np.arange(1, len(sizes) + 1), sizes)
            goes_on = np.zeros(len(c), bool)
            goes_on[before] = True
            first, last = size == 1, ~goes_on
            edge = np.flatnonzero(first | last)
            single = (first & last)[edge]
            begins, ends = first[edge] & ~single, last[edge] & ~single
            ce = c[edge]
            at_edge = base[:, ce] + self.weights[-2][:, None] * begins + self.weights[-1][:, None] * ends + self.alone[:, None] * single + tag[:, ce]
            S = np.concatenate([middle, at_edge], axis=1)
            c[edge] = n + np.arange(len(edge))
            E = np.take(S[:L], c, axis=1)
            E[:, later] += np.take(S[L:2 * L], c[before], axis=1)
            E[:, before] += np.take(S[2 * L:], c[later], axis=1)
            path = np.empty(len(c), np.int64)
            path[rows] = best_paths(E, self.A, sizes)
            out[places] = path
        return out

    def __call__(self, tokens: pa.Array) -> pa.Array:
        """Label names for every token (no tokens -> [])."""
        return pa.concat_arrays([self.labelled(tokens[a:b]) for a, b in pieces(tokens)])

    def labelled(self, tokens: pa.Array) -> pa.Array:
        ntok = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.fill_null(tokens.flatten(), "").dictionary_encode()
        names = pa.DictionaryArray.from_arrays(pa.array(self.numbers(ntok, words), pa.int32()), pa.array(self.labels, pa.string())).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ntok)], pa.int32()), names)


def _joined(values: pa.Array, keep: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Of each text the kept values, joined with blanks."""
    counts = np.r_[0, np.cumsum(keep)]
    lists = pa.ListArray.from_arrays(pa.array(counts[np.r_[0, ends]], pa.int32()), values.filter(pa.array(keep)))
    return pc.binary_join(lists, " ")


def label_columns(tokens: pa.Array, labels: pa.Array, columns: list[str], fixes, run_label: str, second: str) -> pa.StructArray:
    """`labels.with_label_columns` for a batch: a text for every label of ``columns`` and one for ``second``."""
    return pa.concat_arrays([_label_columns(tokens[a:b], labels[a:b], columns, fixes, run_label, second) for a, b in pieces(tokens)])


def _label_columns(tokens: pa.Array, labels: pa.Array, columns: list[str], fixes, run_label: str, second: str) -> pa.StructArray:
    ntok = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    nlab = pc.fill_null(pc.list_value_length(labels), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words, names = tokens.flatten(), labels.flatten()
    ends = np.cumsum(ntok)
    begin = ends - ntok
    if not np.array_equal(ntok, nlab):  # a token beyond the labels has none
        place = np.arange(len(words)) - np.repeat(begin, ntok)
        beyond = place >= np.repeat(nlab, ntok)
        names = names.take(pa.array(np.repeat(np.cumsum(nlab) - nlab, ntok) + place, pa.int64(), mask=beyond))
    coded = names.dictionary_encode()
    code = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = coded.dictionary.to_pylist()
    fixed_names = list(raw)
    for bad, good in fixes:
        fixed_names = [x.replace(bad, good) for x in fixed_names]
    number = {c: i for i, c in enumerate(dict.fromkeys([*columns, "object", second]))}
    column = np.array([number.get(x, -1) for x in fixed_names] + [-1])
    # a token starts a run unless it and the one before it may both be of the run's label
    may = np.array([x == run_label for x in raw] + [True])[code]
    start = np.zeros(len(words), bool)
    start[begin[ntok > 0]] = True
    start[1:] |= ~(may[1:] & may[:-1])
    run, heads = np.cumsum(start) - 1, np.flatnonzero(start)
    own = column[code[heads]][run]
    # of a text's runs of objects those behind the first are second ones
    first, text = np.full(len(ntok), -1, np.int64), np.repeat(np.arange(len(ntok)), ntok)
    objects = np.flatnonzero(own == number["object"])[::-1]
    first[text[objects]] = run[objects]
    own = np.where((own == number["object"]) & (run != first[text]), number[second], own)
    if words.null_count:  # a run's null tokens are left out; one of nothing but these is an empty term
        null = words.is_null().to_numpy(zero_copy_only=False)
        some = np.bincount(run, weights=~null, minlength=len(heads)) > 0
        own = np.where(null & (some[run] | ~start), -1, own)
        words = words.fill_null("")
    parts = {c: _joined(words, own == number[c], ends) for c in [*columns, second]}
    return pa.StructArray.from_arrays(list(parts.values()), names=list(parts))


# ---------------------------------------------------------------------------
# training texts
# ---------------------------------------------------------------------------

def distinct_rows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct rows of a table of integers, every row's number among them)."""
    a = np.ascontiguousarray(a, np.int32)
    _, at, number = np.unique(a.view(np.dtype((np.void, a.dtype.itemsize * a.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return a[at], number.ravel()


def place_flags(ntok: np.ndarray) -> np.ndarray:
    """Of every token: whether it is the first of several, the last of several, or alone."""
    ends, n = np.cumsum(ntok), int(np.sum(ntok))
    flags = np.zeros((n, 3), np.int32)
    several = ntok > 1
    flags[(ends - ntok)[several], 0] = flags[ends[several] - 1, 1] = flags[ends[ntok == 1] - 1, 2] = 1
    return flags


def packed_texts(ntok: np.ndarray, y: np.ndarray, record: np.ndarray, numbers: np.ndarray, names: pa.Array) -> list:
    """One stored row for some texts: the steps' sizes, and by place the records' numbers and the labels; the distinct records as numbers and names.

    ``record`` has the number of every token's record without its place in the
    text, ``numbers`` and ``names`` (as many for each) have these records.
    """
    rows, sizes, _, _ = packed(ntok)
    wide, code = distinct_rows(np.hstack([record[:, None], place_flags(ntok)]))
    per = len(names) // max(1, len(numbers))
    places = (wide[:, :1].astype(np.int64) * per + np.arange(per)).ravel()
    x = np.hstack([numbers[wide[:, 0]], wide[:, 1:]]).astype(np.int32)
    as_bytes = lambda a: np.ascontiguousarray(a, np.int32).tobytes()
    return [as_bytes(sizes), as_bytes(code[rows]), as_bytes(y[rows]), as_bytes(x), names.take(pa.array(places)).to_pylist()]


def walk_errors(E: np.ndarray, A: np.ndarray, sizes: np.ndarray, y: np.ndarray, limit: float):
    """Loss of a walk, its derivative by every place's scores ([labels, places], as ``E``), and by the transitions.

    A step multiplies by exp(A) and scales to a sum of 1.  None if some label's
    share of a step may fall below exp(-limit).
    """
    L, n = E.shape
    top = E.max(axis=0)
    if not A.max() - A.min() + (top - E.min(axis=0)).max() < limit:
        return None
    ends = np.cumsum(sizes)
    P, M = np.exp(E - top), np.exp(A - A.max())
    alpha, scale, pair = np.empty_like(E), np.empty(n), np.zeros((L, L))
    into = np.ascontiguousarray(M.T)
    for t, b in enumerate(sizes):
        at, last = ends[t] - b, ends[t - 1] - sizes[t - 1] if t else 0
        a = P[:, at:at + b] if t == 0 else (into @ alpha[:, last:last + b]) * P[:, at:at + b]
        scale[at:at + b] = a.sum(axis=0)
        np.divide(a, scale[at:at + b], out=alpha[:, at:at + b])
    D = alpha.copy()  # times what lies ahead, which is 1 at a text's end
    ahead = P[:, ends[-1] - sizes[-1]:] / scale[ends[-1] - sizes[-1]:]
    for t in range(len(sizes) - 1, 0, -1):
        b, at, last = sizes[t], ends[t] - sizes[t], ends[t - 1] - sizes[t - 1]
        pair += alpha[:, last:last + b] @ ahead.T
        beta = M @ ahead
        D[:, last:last + b] *= beta
        ahead = P[:, last:at] / scale[last:at]
        ahead[:, :b] *= beta
    later, before = walk(sizes)
    place = np.arange(n)
    loss = np.log(scale).sum() + top.sum() + len(later) * A.max() - E[y, place].sum() - A[y[before], y[later]].sum()
    D[y, place] -= 1.0
    return float(loss), D, M * pair - np.bincount(y[before] * L + y[later], minlength=L * L).reshape(L, L)
