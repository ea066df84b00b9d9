"""SimHash, line, substring and embedding deduplication and top-k search, against brute force on small tables."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from wordloom.llm import line_dedup, simhash, stages, substring_dedup, topk_search, vector_near_dup
from wordloom.llm.batches import SPACE, WordHasher
from wordloom.llm.graph import connected_components
from wordloom.llm.suffix_automaton import SuffixAutomaton

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def components(n, edges):
    root = list(range(n))
    while True:
        before = root[:]
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def fingerprint(text):
    words = text.encode().translate(LOWER).split()
    grams = [b" ".join(words[j:j + 3]) for j in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(grams))


def near_copies(rng, n=60):
    base = [f"w{rng.randrange(40)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
        out.append(" ".join(words))
    return out


def test_simhash(docs):
    rng = random.Random(2)
    texts = ["", None, "\t \n", "A b", "a B", "one", "é É x y z", *near_copies(rng), *[" ".join(f"r{rng.random()}" for _ in range(20)) for _ in range(30)]]
    texts += texts[8:12]
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.simhash_components(docs(texts, extra=True)).collect()}
    fps = [fingerprint(t or "") for t in texts]
    root = components(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert got == {i: (fps[i], root[i]) for i in range(len(texts))}


@pytest.mark.parametrize("hot", [1, 4, 64])
def test_fingerprint_links_at_every_group_size(spark, hot):
    rng = random.Random(hot)
    some = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({f ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for f in some for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, hot)
    pairs = [(signed.index(r.a), signed.index(r.b)) for r in links.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
    true = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert components(len(fps), pairs) == components(len(fps), true)


def test_connected_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = components(400, edges)
    assert got == {i: root[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


def repeated(texts):
    lines, gone = [], set()
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").encode().split(b"\n")):
            words = frozenset(line.translate(LOWER).split())
            if words:
                if any(len(words & w) * 5 >= 4 * len(words | w) for w in lines):
                    gone.add((i, k))
                lines.append(words)
    return gone


def line_texts(seed, n=40):
    rng = random.Random(seed)
    pool = [[f"v{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(1, 25))] for _ in range(30)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(pool))
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"v{rng.randrange(60)}"
            rng.shuffle(words)
            lines.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("offers", [1, 2])
def test_lines(docs, offers, monkeypatch):
    monkeypatch.setattr(line_dedup, "OFFERS", offers)
    monkeypatch.setattr(line_dedup, "WORD_ROWS", 8)  # words of more lines are split over buckets
    texts = [*line_texts(offers), None, "", "\n\n", "v1 v2 v3 v4 v5", "v1 v2 v3 v4", " v4  v3 v2 v1", "q" * 3_000_000]
    got = {(r.doc, r.line) for r in line_dedup.repeated_lines(docs(texts, extra=True)).collect()}
    assert got == repeated(texts)


def test_line_texts_are_rebuilt(docs):
    texts = ["a b c d e\nq r s t u", "A b c d e\nnew line é\n", None, "", "q r s t u"]
    df = docs(texts, extra=True)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: texts[0], 1: "new line é\n", 2: None, 3: "", 4: ""}
    digest = {r.doc_id: r for r in line_dedup.line_digest(df).collect()}
    assert [(digest[i].n_lines, digest[i].n_removed) for i in range(5)] == [(2, 0), (3, 1), (1, 0), (1, 0), (1, 1)]
    assert digest[1].kept_sha256 == hashlib.sha256("new line é\n".encode()).hexdigest()
    assert line_dedup.dedup_lines(docs(["x"]).limit(0)).count() == 0


def test_groups_of_a_hot_word_are_bounded(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "WORD_ROWS", 20)
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", 100)
    seen, meet = [], line_dedup._meet

    def watch(postings, *rest):
        size = line_dedup.POSTING.itemsize
        seen.extend(r.n // size for r in postings.selectExpr("bucket", "length(rows) as n").groupBy("bucket").agg({"n": "sum"}).toDF("bucket", "n").collect())
        return meet(postings, *rest)

    monkeypatch.setattr(line_dedup, "_meet", watch)
    rng = random.Random(5)
    # a family of near copies: every line has the same ten words and two of its own among few
    texts = [" ".join([f"w{k}" for k in range(10)] + [f"x{rng.randrange(40)}", f"y{rng.randrange(40)}"]) for _ in range(300)]
    got = {(r.doc, r.line) for r in line_dedup.repeated_lines(docs(texts)).collect()}
    assert got == repeated(texts)
    assert max(seen) <= 150, sorted(seen)[-5:]


def test_hot_words_meet_as_pairs(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "WORD_ROWS", 6)
    monkeypatch.setattr(line_dedup, "LONG_SET", 8)  # sets on both sides, and those that send words and pairs
    rng = random.Random(11)
    texts = []
    for _ in range(120):
        words = [f"h{k}" for k in range(rng.randrange(3, 16))]
        words[rng.randrange(len(words))] = f"z{rng.randrange(12)}"
        texts.append(" ".join(words))
    assert {(r.doc, r.line) for r in line_dedup.repeated_lines(docs(texts)).collect()} == repeated(texts)
    half = ["a b", "a", "b c d", "b c", "e f g", "f e"]
    assert {(r.doc, r.line) for r in line_dedup.repeated_lines(docs(half), threshold=(1, 2)).collect()} == {(1, 0), (3, 0), (5, 0)}


def removed(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = {}
    for w in words:
        for j in range(len(w) - window + 1):
            count[tuple(w[j:j + window])] = count.get(tuple(w[j:j + window]), 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j:j + window])] > 1:
                gone[j:j + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [1, 4000])
def test_substrings(docs, limit, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ANCHOR_SEGMENTS", limit)  # 1: windows are counted one by one
    rng = random.Random(limit)
    passages = [[f"p{rng.randrange(500)}" for _ in range(rng.randrange(30, 90))] for _ in range(6)]
    texts = []
    for _ in range(50):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
            part = list(rng.choice(passages))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "edit"
            words += part[rng.randrange(10):len(part) - rng.randrange(10)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += [None, "", " ", "a " * 300, "b " * 36, "c " * 35, texts[0], "É é " * 40]
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs(texts, extra=True)).collect()}
    assert got == dict(enumerate(removed(texts, 35)))


def test_rows_that_share_an_id(docs, spark):
    passage, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "pq")
    rows = [(1, f"{passage} tail"), (1, "short"), (1, f"own {other}"), (2, f"{other} end"), (2, f"{other} end"), (3, passage), (None, passage), (None, "solo"), (0, passage)]
    got = sorted((r.id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs(rows)).collect())
    assert got == [(0, 1, 0), (0, 40, 40), (0, 40, 40), (1, 1, 0), (1, 41, 40), (1, 41, 40), (2, 41, 41), (2, 41, 41), (3, 40, 40)]

    rows = [(1, "a b c d e\nf g h i j"), (1, "k l m n o"), (2, "u v w x y\n\nz z1 z2 z3"), (2, "u v w x y\n\nz z1 z2 z3"), (2, "u v w x y\n\nz z1 z2 z3"),
            (3, "k l m n o\nnew one here"), (4, None), (4, None), (None, "k l m n o"), (None, "k l m n o")]
    df = docs(rows, extra=True)
    want = sorted([(1, rows[0][1]), (1, rows[1][1]), (2, rows[2][1]), (2, ""), (2, ""), (3, "new one here"), (4, "-"), (4, "-"), (0, "k l m n o"), (0, "k l m n o")])
    assert sorted((r.doc_id or 0, "-" if r.text is None else r.text) for r in line_dedup.dedup_lines(df).collect()) == want
    digest = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in line_dedup.line_digest(df).collect())
    assert digest == [(0, 1, 0), (0, 1, 0), (1, 1, 0), (1, 2, 0), (2, 3, 0), (2, 3, 2), (2, 3, 2), (3, 2, 1), (4, 1, 0), (4, 1, 0)]

    text = " ".join(f"s{k}" for k in range(60))
    rows = [(1, text), (1, text), (1, "another text with words of its own that nothing else has"), (2, text), (None, text), (None, text)]
    kept = stages.simhash_stage(spark, docs(rows), "")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, text), (0, text), (1, rows[2][1]), (1, text)])


def test_suffix_automaton():
    rng = random.Random(3)
    for _ in range(300):
        seqs = [([rng.randrange(3) for _ in range(rng.randrange(1, 14))], rng.randrange(1, 3)) for _ in range(rng.randrange(1, 6))]
        window = rng.randrange(1, 6)
        a = SuffixAutomaton()
        for s, n in seqs:
            a.add(s, n)
        a.finish()
        count = {}
        for s, n in seqs:
            for i in range(len(s) - window + 1):
                count[tuple(s[i:i + window])] = count.get(tuple(s[i:i + window]), 0) + n
        for s, _ in seqs:
            assert a.repeated(s, window) == [count[tuple(s[i:i + window])] >= 2 for i in range(len(s) - window + 1)]


def test_word_hashes_name_words():
    hasher = WordHasher(SPACE)
    texts = [b"a bb a\tccc", b"", b"  bb", "é a".encode(), b"x" * 2_500_000 + b" a", b"x" * 2_500_000 + b"y"]
    h, first = hasher(texts)
    words = [t.split() for t in texts]
    assert np.diff(first).tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and len({(w, x) for w, x in zip(flat, h.tolist())}) == len(set(flat))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "'x' as key", "2 as id")


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(vector_near_dup, "BLOCK", 16)  # large buckets become pairs of blocks
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 40))):
            rows.append((centre + rng.normal(size=24) * 0.13).astype(np.float32).tolist())
    rows = [(i, v, i % 2) for i, v in enumerate(rows)]
    n = len(rows)
    rows += [(n, rows[3][1], rows[3][2]), (n + 1, rows[3][1], rows[3][2]), (n + 2, None, 0), (n + 3, [0.0] * 24, 0), (n + 4, [float("nan")] * 24, 0),
             (n + 5, rows[0][1], None), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (n + 9, [float("inf")] * 24, 1)]
    rows.append(rows[5])
    got = {r.id: (r.n_links, r.component) for r in vector_near_dup.vector_links(vectors(spark, rows)).collect()}
    rows.pop()
    ok = [i for i, (_, v, label) in enumerate(rows) if v and label is not None and np.isfinite(v).all() and any(v)]
    links = []
    for a, b in itertools.combinations(ok, 2):
        x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
            links.append((a, b))
    assert len(links) > 100
    root = components(len(rows), links)
    found = sum(got[i][0] for i in range(len(rows))) / 2
    assert found >= 0.9 * len(links)
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert all(got[i][0] <= count[i] and got[i][1] >= root[i] for i in range(len(rows)))
    assert sum(got[i] == (count[i], root[i]) for i in range(len(rows))) >= 0.95 * len(rows)


def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(300 + i, [0.25, 0.5, 0.0, 0.0, 1.0, 0.0], 0) for i in range(101)]          # ties
    rows += [(500, None, 0), (501, [float("nan")] * 6, 0), (550, [1.0, -2.0], 0), (551, [], 0)]
    rows.append(rows[7])
    got = topk_search.top_k(vectors(spark, rows), k=5).collect()
    rows.pop()
    ok = [(i, np.floor(256 * np.pad(np.array(v, np.float64), (0, 6 - len(v)))).astype(int)) for i, v, _ in rows if v is not None and np.isfinite(v).all()]
    want = {}
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:5]
            want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in got} == want


def test_top_k_of_few_and_none(spark):
    assert topk_search.top_k(vectors(spark, []), k=5).count() == 0
    assert topk_search.top_k(vectors(spark, [(50, [1.0], 0)]), k=5).count() == 0
    got = topk_search.top_k(vectors(spark, [(50, [1.0], 0), (7, [2.0], 0), (9, [-1.0], 0)]), k=5).collect()
    assert sorted((r["rank"], r.id, r.score) for r in got) == [(1, 7, 256 * 512), (2, 9, -256 * 256)]
    assert vector_near_dup.vector_links(vectors(spark, [])).count() == 0
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bit_table_has_all_keys_and_few_others(spark):
    """Bits merged from many tasks in one job, as many as there are slots; null keys set none."""
    import numpy as np
    from pyspark.sql import functions as F

    from wordloom.llm.sieve import bit_table, has_bit
    keys = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("h")).unionByName(spark.range(3).select(F.lit(None).cast("long").alias("h")))
    h = np.array([r.h for r in keys.where("h is not null").collect()])
    for bits in (20, 24):
        table = bit_table(keys, "h", bits)
        assert len(table) == 1 << bits - 3 and has_bit(table, h).all()
        assert np.unpackbits(table).sum() == len(np.unique(h & (1 << bits) - 1))


def test_word_hashes_take_little_memory():
    """Hashing a megabyte of text holds a few megabytes; words keep their hash at every place, also across chunks."""
    import tracemalloc

    from wordloom.llm.batches import CHUNK, SPACE, WordHasher
    hasher = WordHasher(SPACE, lower=True, prefix=5)
    text = b" ".join(b"word%d" % (i % 1000) for i in range(150_000))
    tracemalloc.start()
    word, first = hasher([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(word) == len(hasher.heads) == 150_000 and first.tolist() == [0, 150_000]
    assert (word.reshape(-1, 1000) == word[:1000]).all() and len(set(word[:1000].tolist())) == 1000
    assert peak < 15 << 20
    long = b"x" * (2 * CHUNK + 5)
    a, b = hasher([b"a  " + long + b" b", b"", b"c " + long, b" A"]), hasher([long + b" q"])
    assert a[1].tolist() == [0, 3, 3, 5, 6] and a[0][1] == a[0][4] == b[0][0] and a[0][0] == a[0][5] and len(hasher.heads) == 2
