"""Byte-level BPE encoding by speculation and verification, and decoding.

A word's greedy longest-match split is a guess at its encoding.  A sequence
of tokens is the BPE encoding exactly if every adjacent pair is compatible,
that is, if the two tokens stay as they are when they are encoded together.
All pairs of all new words of a batch are tested at once in numpy; only words
with an incompatible pair are merged exactly, rule by rule.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import text_slices

# The word pattern of byte-level BPE files and the printable stand-ins of bytes in them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_IN = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(PLAIN))}

# Distinct words that a task keeps the encodings of; beyond it the store starts anew.
KEEP_WORDS = 400_000
NEVER = 1 << 62


class ByteBpe:
    """Vocabulary, merge rules and special tokens of a byte-level BPE JSON file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        raw = lambda s: bytes(STAND_IN[c] for c in s)
        ids = {raw(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for s, i in ids.items():
            self.token[i] = s
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.size = size
        # Rank and halves of each token's rule; -1 where no rule makes the token.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        keys, made = [], []
        for r, rule in enumerate(model["merges"]):
            a, b = rule if isinstance(rule, list) else rule.split(" ")
            x, y, z = ids[raw(a)], ids[raw(b)], ids[raw(a) + raw(b)]
            made.append(z)
            keys.append(x * size + y)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        order = np.argsort(keys)
        self.made = np.array(made, np.int64)
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.key, self.key_rank = np.array(keys, np.int64)[order], order.astype(np.int64)
        # The guess may use a token only if its own bytes are encoded as that token.
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        kept = self.compatible(self.left[made], self.right[made], self.rank[made])
        sound = np.zeros(size, bool)
        sound[[i for s, i in ids.items() if len(s) == 1]] = True
        for z, x, y, ok in zip(made.tolist(), self.left[made].tolist(), self.right[made].tolist(), kept.tolist()):
            sound[z] = ok and sound[x] and sound[y]
        self.guess = {s: i for s, i in ids.items() if sound[i]}
        # Lengths of tokens by their first four bytes, longest first.
        lengths: dict[bytes, set] = {}
        for s in self.guess:
            if len(s) >= 4:
                lengths.setdefault(s[:4], set()).add(len(s))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def _rule(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the rule that joins a and b, NEVER without one."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.key_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until=NEVER) -> np.ndarray:
        """For each pair, whether (among merges of a rank below ``until``) no merge crosses the border between a and b when they are encoded together.

        Goes back in time: the later of the two merges that made the pieces
        at the border is undone, and the border pair before it must not
        join earlier than that merge (at the same rank the left one goes first).
        """
        if not len(self.key):
            return np.ones(len(a), bool)
        good = np.ones(len(a), bool)
        todo = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until = np.full(len(a), until)  # a join of x and y at a rank below this would have happened
        while len(todo):
            join = self._rule(x, y)
            bad = join < until
            good[todo[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            undo_left = rx > ry  # of equal merges the right one happened last
            x, y, until = np.where(undo_left, self.right[x], x)[on], np.where(undo_left, y, self.left[y])[on], np.where(undo_left, rx, ry + 1)[on]
            todo = todo[on]
        return good

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Encodings by the rules themselves, lowest rank first, leftmost first; all words take a step at a time."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), size)
        token = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = self._inner(token, owner, np.arange(len(token)))
        while len(token):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            length = np.diff(np.concatenate([first, [len(token)]]))
            least = np.minimum.reduceat(rank, first)
            done = least >= NEVER
            for w, at, n in zip(owner[first[done]].tolist(), first[done].tolist(), length[done].tolist()):
                out[w] = token[at:at + n]
            low = np.repeat(least, length)
            hit = np.flatnonzero((rank == low) & (low < NEVER))
            # Of hits that overlap (one rule on equal neighbours) every second one counts, from the left.
            run = np.concatenate([[True], np.diff(hit) > 1]) if len(hit) else np.zeros(0, bool)
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            token[hit] = self.made[rank[hit]]
            stay = ~np.repeat(done, length)
            stay[hit + 1] = False
            new = np.cumsum(stay) - 1
            changed = new[hit]
            token, owner, rank = token[stay], owner[stay], rank[stay]
            changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            rank[changed] = self._inner(token, owner, changed)
        return out

    def _inner(self, token: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the rule on the pairs that begin at the given places; NEVER at a word's last token."""
        after = np.minimum(at + 1, len(token) - 1)
        same = (after > at) & (owner[after] == owner[at]) if len(at) else np.zeros(0, bool)
        return np.where(same, self._rule(token[at], token[after]), NEVER)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, guess, lengths, n = [], 0, self.guess, self.lengths, len(word)
        while at < n:
            rest = n - at
            t = None
            for k in lengths.get(word[at:at + 4], ()):
                if k <= rest and (t := guess.get(word[at:at + k])) is not None:
                    break
            else:
                k = min(3, rest)
                while (t := guess.get(word[at:at + k])) is None:
                    k -= 1
            out.append(t)
            at += k
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Encodings of distinct words as little-endian 32-bit ids: guessed, tested all together, and merged exactly where the test fails."""
        raw = [w.encode() for w in words]
        guesses = [self.propose(w) for w in raw]
        count = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(count.sum()))
        owner = np.repeat(np.arange(len(words)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, place = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pair // self.size, pair % self.size)
        failed = np.unique(owner[inner[~good[place]]]).tolist()
        edge = np.concatenate([[0], np.cumsum(count)]) * 4
        data = flat.astype("<u4").tobytes()
        known = {w: data[i:j] for w, i, j in zip(words, edge[:-1].tolist(), edge[1:].tolist())}
        for w, ids in zip(failed, self.merge_all([raw[w] for w in failed])):
            known[words[w]] = ids.astype("<u4").tobytes()
        return known

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian 32-bit integers, special tokens as their strings; bytes that are no UTF-8 become U+FFFD."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def read_tokenizer(path: str) -> ByteBpe:
    with open(path, encoding="utf-8") as f:
        return ByteBpe(f.read())


class BatchEncoder:
    """Encodes batches of texts and keeps the encodings of words between them."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.words = regex.compile(WORDS)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(bpe.special, key=len, reverse=True))) if bpe.special else None
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        split = [self._split(t) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > KEEP_WORDS:
            self.known = {}
            new = {w for words in split for w in words}
        new.difference_update(self.bpe.special)
        self.known.update(self.bpe.encode_words(list(new)))
        self.known.update((s, i.to_bytes(4, "little")) for s, i in self.bpe.special.items())
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]

    def _split(self, text: str) -> list[str]:
        """Words and special tokens.  No word equals a special token's string, as these are cut out first."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.words.findall(text[at:m.start()]), m.group()]
            at = m.end()
        return out + self.words.findall(text[at:])


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded string]) for every row.

    The file is read once on the driver (a vocabulary: fixed size) and
    travels with the tasks.  Null and empty texts have no ids.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches):
        encoder = BatchEncoder(shared.value)
        for b in batches:
            for first, last in text_slices(b, "text", 1 << 20):
                part = b.slice(first, last - first)
                ids = encoder([t or "" for t in part.column("text").to_pylist()])
                texts = [encoder.bpe.decode(x) for x in ids]
                columns = [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                           pa.array([sha256_hex(x) for x in ids]),
                           pa.array([sha256_hex(t.encode()) for t in texts])]
                if keep_ids:
                    columns += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of every row's ids; null ids give an empty text."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches):
        bpe = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()], pa.string())],
                                             ["id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, decoded string")
