"""Byte-level repeats by suffix arrays, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from wordloom.llm import suffix_array, suffix_dedup


def test_difference_cover():
    assert {(a - b) % suffix_array.PERIOD for a in suffix_array.COVER for b in suffix_array.COVER} == set(range(suffix_array.PERIOD))


@pytest.mark.parametrize("alphabet", [1, 2, 26])
@pytest.mark.parametrize("bucket", [50, 1 << 16])
def test_suffixes_in_order(alphabet, bucket, monkeypatch):
    monkeypatch.setattr(suffix_array, "BUCKET", bucket)
    rng = random.Random(alphabet)
    text = bytes(97 + rng.randrange(alphabet) for _ in range(700)) + b"abc" * 100
    data = np.frombuffer(text + bytes(suffix_array.PAD), np.uint8)
    starts = np.array(sorted(rng.sample(range(len(text)), 500)))
    got = np.concatenate(list(suffix_array.sorted_buckets(data, starts, 200)))
    assert sorted(got) == sorted(starts)
    head = [(text + bytes(200))[p:p + 200] for p in got]
    assert head == sorted(head)


def brute(texts, window):
    where = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            where.setdefault(t[i:i + window], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i:i + window] = b"\1" * window
    out = []
    for t, g in zip(texts, gone):
        kept = bytes(x for x, y in zip(t, g) if not y)
        spans = sum(1 for a, b in zip(b"\0" + g, g) if b > a)
        out.append((len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample(rng):
    word = lambda: "".join(rng.choice("abcdeé🙂") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (40, 60, 200)] + ["ab" * 150, "a" * 500]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201]
    for _ in range(50):
        t = [text(rng.randrange(30)) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            t.insert(rng.randrange(4), p[cut:] if rng.random() < .5 else p)
        texts.append(" ".join(t))
    return texts + texts[20:26] + [texts[30] + "!", "?" + texts[31]]


@pytest.mark.parametrize("few", [False, True])
def test_dedup_bytes(docs, monkeypatch, few):
    if few:  # every size of group on its other way
        monkeypatch.setattr(suffix_dedup, "ANCHOR_SEGMENTS", 2)
        monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
        monkeypatch.setattr(suffix_dedup, "PACK", 3)
        monkeypatch.setattr(suffix_dedup, "RANGE_WINDOWS", 1000)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    texts = sample(random.Random(8))
    want = brute([(t or "").encode() for t in texts], 200)
    got = {r.id: r for r in suffix_dedup.dedup_bytes(docs(texts, extra=True)).collect()}
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        data, keep, at = (t or "").encode(), b"", 0
        for s in got[i].spans:
            keep, at = keep + data[at:s.start], s.end
        assert bytes(got[i].kept) == keep + data[at:]


def test_long_texts_and_shared_ids(docs):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    texts = [(1, long), (1, "z" + long[1_048_000:1_049_500]), (None, long[5:300]), (None, None), (2, "short"), (2, "short")]
    want = brute([(t or "").encode() for _, t in texts], 200)
    got = suffix_dedup.dedup_bytes(docs(texts), keep_text=False).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def test_no_rows(docs):
    assert suffix_dedup.dedup_bytes(docs([(1, "x")]).where("doc_id < 0")).count() == 0
