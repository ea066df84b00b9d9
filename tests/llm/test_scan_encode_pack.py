"""Secret scans, BPE, packing and page text on small tables, against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wordloom.llm import bpe, html_text, packing, q_llm, secrets
from wordloom.llm.automaton import Dfa, parse

PATH = public_tokenizers.path(q_llm.TOKENIZER)

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def secret_texts():
    rng = random.Random(5)
    parts = ["password", "Token", "secret", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef",
             "deadbeef", "é", "\n", "\U0001F600", "passwd", "token", "/"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(400)] + [
        None, "", "password=token: abcdefgh", "a" * 30, "é" * 70_000 + " secret = 'abcdef'", "-----BEGIN RSA PRIVATE KEY-----"]


def test_secrets_against_regular_expressions(docs):
    texts = secret_texts()
    got = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(docs(texts, extra=True))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert [x for x in got[i].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [f"{k}:{s}:{e}" for k, s, e in want]
    assert got[len(texts) - 1].spans == "private_key:0:31"


def test_redaction(docs):
    texts = ["my password=hunter22 and token: abcdefgh.", "clean é text", None, ""]
    df = docs(texts)
    got = {r.doc_id: r.t for r in secrets.redact(df, "[X]").withColumnRenamed("text", "t").collect()}
    assert got == {0: "my [X] and [X]", 1: "clean é text", 2: None, 3: ""}


def test_automaton_against_re():
    rng = random.Random(1)
    for pattern in ["a(b|c)*d?", "[ab]{2,3}c+", "(ab|a)(bc|c)?", "x?y{2}", "[^a]b"]:
        dfa, want = Dfa([parse(pattern)]), re.compile(pattern)
        for _ in range(300):
            s = "".join(rng.choice("abcdxy") for _ in range(rng.randrange(7)))
            state = 0
            for b in s.encode():
                state = dfa.next[state, b]
            assert bool(dfa.accepts[state]) == bool(want.fullmatch(s)), (pattern, s)


def bpe_texts():
    rng = random.Random(0)
    parts = ["a", "b", " ", "th", "e", "ing", "\n", "é", "ß", "1", "'s", "!!", "==", "日", "<|endoftext|>", "　", "\x1c", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(500)] + [
        "a<|endoftext|>b <|endoftext|>", "a" * 3000, "ab" * 800, "\U0001F600日本語 " * 30, " " * 900, "", "x́ ſt"]


def test_bpe_against_the_library(docs):
    texts = [*bpe_texts(), None]
    tok = Tokenizer.from_file(PATH)
    got = {r.id: r for r in bpe.encode_documents(docs(texts, extra=True), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded == tok.decode(want, skip_special_tokens=False) == (t or "")
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decode_of_any_ids(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [(0, [50256, 100, 200]), (1, []), (2, None), (3, list(range(180, 260)))]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    got = {r.id: r.decoded for r in bpe.decode_documents(df, PATH).collect()}
    assert got == {i: tok.decode(x or [], skip_special_tokens=False) for i, x in rows}


def test_compatible_pairs_are_those_that_stay():
    b = bpe.read_tokenizer(PATH)
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3000, 1500), rng.integers(0, 3000, 1500)
    both = b.merge_all([b.token[i] + b.token[j] for i, j in zip(x, y)])
    assert [list(z) == [i, j] for z, i, j in zip(both, x, y)] == b.compatible(x, y).tolist()


def brute_cost(sizes, lengths):
    """Least total cost over all partitions of the pieces (tiny inputs)."""
    best = None
    for way in itertools.product(range(len(sizes)), repeat=len(sizes)):
        held = [sum(s for s, w in zip(sizes, way) if w == b) for b in set(way)]
        if all(h <= max(lengths.permitted) for h in held):
            cost = sum(lengths.cost(min(c for c in lengths.permitted if c >= h)) for h in held)
            best = cost if best is None else min(best, cost)
    return best


def test_pack_sizes_is_valid_and_near_the_best():
    rng = np.random.default_rng(4)
    lengths = packing.Lengths((4, 8, 16), 2)
    for _ in range(40):
        sizes = rng.integers(1, 17, rng.integers(1, 6))
        place, offset, length = packing.pack_sizes(sizes, lengths)
        held = np.bincount(place, sizes, minlength=len(length))
        assert (held <= length).all() and set(length) <= {4, 8, 16}
        for b in range(len(length)):
            own = np.flatnonzero(place == b)
            spans = sorted(zip(offset[own], sizes[own]))
            assert spans[0][0] == 0 and all(a + s == c for (a, s), (c, _) in zip(spans, spans[1:]))
        assert sum(map(lengths.cost, length.tolist())) <= 1.35 * brute_cost(sizes.tolist(), lengths)


def test_packing_places_every_token(docs, spark):
    texts = ["a b c", "", None, "w " * 20_000, "x y", "x y"] + [f"t{i} " * (i % 90) for i in range(300)]
    got = packing.pack_documents(docs(texts, extra=True)).toPandas()
    words = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == words
    assert got[got.n_tokens == 0].bin_id.isna().all() and got[got.n_tokens > 0].bin_id.notna().all()
    some = got.dropna(subset=["bin_id"])
    bins = some.groupby("bin_id").agg(n=("n_tokens", "sum"), used=("bin_used", "max"), length=("bin_length", "max"))
    assert (bins.n == bins.used).all() and (bins.used <= bins.length).all()
    big = some[some.doc_id == 3].sort_values("piece")
    assert big.start.tolist() == [0, 8192, 16384] and big.n_tokens.tolist() == [8192, 8192, 3616]
    assert packing.pack_documents(docs([]).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div class="header">Top <a href="/">home</a></div>
<div class="post post-%d"><h1>Title &lt;%d&gt;</h1><p>One  two<br>three &amp; four<p>second <b>bold</b> a > b<ul><li>x<li>y</ul>
<form>Send <input name="q"></form><div class="comments"><p>many many many many many many many words of a reader</div></div>
<aside>more</aside><div class="related-links"><p>other other</p></div><script>if(a<b){"</p>"}</script><!-- <p>no</p> --><footer>&copy; me</footer>"""


def test_main_text(spark):
    rows = [(i, f"https://h.example.com:80/p/{i}", PAGE % (i, i)) for i in range(6)]
    rows += [(10, None, None), (11, "", ""), (12, "https://h.example.com/x", "<p>stray <b>text"), (13, "x", "no markup &eacute; at all"),
             (14, "https://h.example.com/y", "<div>" * 3000 + "deep" + "</div>" * 3000), (0, "https://h.example.com:80/p/0", PAGE % (0, 0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "'q' as host", "'z' as paths", "'t' as text")
    out = html_text.extract_main_text(df).collect()
    assert len(out) == len(rows)
    got = {r.id: r.text for r in out}
    for i in range(6):
        assert got[i] == f"Title <{i}>\nOne two three & four\nsecond bold a > b\nx\ny"
    assert (got[10], got[11], got[12], got[13], got[14]) == ("", "", "stray text", "no markup é at all", "deep")
    assert all(r.n_chars == len(r.text) for r in out)


def test_host_consensus_beats_a_page_of_its_own(spark):
    good = '<body><div class="story"><p>%s</p></div><div class="box"><p>%s</p></div></body>'
    rows = [(i, "http://a.b/", good % ("long text " * 9, "short")) for i in range(5)] + [(9, "http://a.b/z", good % ("brief", "a longer boxed note " * 9))]
    got = {r.id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief"


LONG = "many words of the story " * 9


def main_text(source):
    page = html_text.Page(source)
    return page.text([page.paths[page.best()[0]]])


@pytest.mark.parametrize("source, want", [
    ("<article><h1>T</h1><p>intro</p><div class=body><p>%s</p></div></article>", "T\nintro\n%s"),
    ("<article><section class=a><p>%s</p></section><section class=b><p>half</p></section></article>", "%s\nhalf"),
    ("<article><p>one</p><ul><li>%s</li></ul><blockquote>quoted</blockquote><p>two</p></article>", "one\n%s\nquoted\ntwo"),
    ("<div class=post><h1>T</h1><div><div><div class=body><p>%s</p></div></div></div></div><div class=more>other</div>", "T\n%s"),
    ("<div><blockquote>%s</blockquote><p>said</p></div>", "%s\nsaid"),
    ("<article><p>%s</p><nav>menu</nav><ul><li><a href=x>link</a></li></ul></article><div>beside</div>", "%s\nlink"),
])
def test_main_text_is_the_whole_article(source, want):
    assert main_text(source % LONG.strip()) == want % LONG.strip()


def test_main_text_is_whole_on_every_page_of_a_host(spark):
    page = "<body><article><h1>T%d</h1><p>intro</p><div class=body><p>%s</p></div></article></body>"
    rows = [(i, "http://a.b/", page % (i, LONG)) for i in range(4)]
    got = {r.id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\nintro\n{LONG.strip()}" for i in range(4)}


@pytest.mark.parametrize("source", [
    "<html><head><title>x</title><body><p>%s</p></body></html>",
    "<html><head><title>x</title><meta charset=utf-8><p>%s</p>",
    "<head><title>x</head><body><p>%s</p></body>",
    "<p><svg class='i'/><math/>%s</p><p><svg><path d='M0'/></svg></p>",
    "<svg viewBox='0 0 1 1'><path d='M0'><p>%s</p><svg><title>icon</title></svg>",
    "<noscript><iframe src=x><p>%s</p>",
    "<p>%s</p><script>var t = '<p>no';",
    "<p>%s</p><style>p{}</style ><textarea>no <p>no",
])
def test_elements_without_text_end_where_html_ends_them(source):
    assert main_text(source % LONG.strip()) == LONG.strip()


@pytest.mark.parametrize("source", [
    '<div class="layout has-sidebar"><article><p>%s</p></article><div class="sidebar">no</div></div>',
    '<main class="no-sidebar"><p>%s</p></main>',
    '<article class="post has-comments"><p>%s</p></article>',
    '<article class="comments"><p>%s</p></article>',
    '<div id="search-results"><p>%s</p></div><div class="ad">no</div>',
    '<form id="main"><p>%s</p><input name=q></form>',
    '<form><nav>no</nav><article><p>%s</p></article></form>',
    '<article><div class="widget-text"><p>%s</p></div><div class="related">no</div></article>',
    '<article><p>%s</p><div class="share">no</div></article><div class="comments"><article class="comment"><p>no</p></article></div>',
])
def test_marked_containers_with_the_article_stay(source):
    assert main_text(source % LONG.strip()) == LONG.strip()


def test_captions_and_labels_of_the_article_stay():
    source = "<article><p>%s</p><figure><img src=x><figcaption>caption</figcaption></figure><p><label>label</label> text</p></article>"
    assert main_text(source % LONG) == f"{LONG.strip()}\ncaption\nlabel text"


def test_empty_tables(docs, spark):
    none = docs(["x"]).limit(0)
    assert secrets.scan_secrets(none).count() == 0
    assert bpe.encode_documents(none, PATH).count() == 0
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("bad", ["(a", "a)", "é"])
def test_patterns_that_do_not_parse(bad):
    with pytest.raises((ValueError, IndexError)):
        parse(bad)
