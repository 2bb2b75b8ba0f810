"""Extraction, token counts, language spans, quality, line windows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import sentence
from pyspark.sql import functions as F

from quadrille.llm import extract, language, lines, quality, tokens, words


def test_page_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><h1>T &amp; t</h1><p>a\n b&nbsp;c<!-- x --></p><form>no</form></article><footer>f</footer>"), (3, "u", "<p>x"), (None, "u", "<div class=ad>buy now</div><article><p>Be.</p>" + "<p>long text</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = extract.extract_pages(df).collect()
    assert [r.text for r in got[:4]] == ["", "", "T & t\na b c", "x"]
    assert got[4].text == "\n".join(["Be.", *["long text"] * 3000]) and all(r.n_chars == len(r.text) for r in got)
    assert extract.extract_pages(df.limit(0)).collect() == []


def test_tree_fits_its_table():
    tree = extract.trained_tree()
    right = [tree.predict(r) == (b.text[0] == "+") for html in extract.LABELLED_PAGES for page in [extract.blocks(html)] for b, r in zip(page.blocks, extract.features(page))]
    assert sum(right) / len(right) > 0.99


LONG = "a long text of an article that goes on for quite some words so that nobody can doubt what it is about"


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<div class="layout has-sidebar"><article><p>{LONG}<p>{LONG}</article></div>', [LONG, LONG]),
        (f'<div id=content class="content sidebar-right"><p>{LONG}<p>two words<p>{LONG}</div>', [LONG, "two words", LONG]),
        (f"<form id=aspnetForm><div class=header>site name</div><div><h1>T</h1><p>{LONG}</div></form>", ["T", LONG]),
        (f"<form id=aspnetForm><article><p>{LONG}</article></form>", [LONG]),
        (f"<article><p>{LONG}<section id=discussion><p>{LONG}</section><section class=related-work><p>{LONG}</section><div class=social-effects><p>{LONG}</div></article>", [LONG] * 4),
        (f"<svg><article><p>{LONG}</article>", [LONG]),
        (f"<select><article><p>{LONG}</article>", [LONG]),
        (f"<nav>menu</nav><div><h1>Title here</h1><p>short one<p>two words<p>{LONG}</div><footer>foot</footer>", ["Title here", "short one", "two words", LONG]),
        (f"<main><h1>T</h1><p>{LONG}<p>{LONG}<article><p>a teaser</article></main>", ["T", LONG, LONG, "a teaser"]),
        (f"<article><p>{LONG}<p><a href=x>{LONG}</a><p>end</article><section class=comments><p>{LONG}<p>{LONG}</section>", [LONG, LONG, "end"]),
        (f"<article><p>{LONG} <span hidden>unseen</span>and <i style='display:none'>no</i>more</article>", [f"{LONG} and more"]),
        (f'<div class="post comments-open"><p>{LONG}<p>{LONG}</div><div class="comment-list"><p>{LONG}<p>{LONG}</div>', [LONG, LONG]),
    ],
)
def test_names_do_not_drop_the_page(html, want):
    assert extract.main_text(f"<html><body>{html}</body></html>") == "\n".join(want)


def test_hostile_pages_take_linear_time():
    import time

    start = time.time()
    for page in ("<div>" * 80_000 + "text", "<div class=ad>" * 40_000 + "</section></b>" * 40_000, "<svg><a><i><p>" * 30_000 + "x</b>" * 30_000):
        extract.main_text(page)
    assert time.time() - start < 6


def _made_page(rng):
    """A page with random surroundings, its article in a random container, and the article's lines."""

    def text(low, high):
        return sentence(rng, rng.randrange(low, high))

    body, want = [], []
    for tag in ["h1", *[rng.choice(["p", "p", "p", "h2", "li", "blockquote"]) for _ in range(rng.randrange(3, 12))]]:
        line = text(2, 9) if tag in ("h1", "h2") else text(1, 12) if rng.random() < 0.3 else text(20, 90)
        want.append(line.replace("alpha", "a&b"))
        body.append(f"<{tag}>" + line.replace("alpha", "a&amp;b").replace(" beta", "\n <b>beta").replace(" gamma", "</b> gamma") + f"</{tag}>")
        if rng.random() < 0.1:
            body.append(rng.choice([f"<aside>{text(5, 40)}</aside>", "<script>var a = '<p>no</p>';</script>", f"<div class='ad-box'>{text(3, 30)}</div>", "<!-- <p>no</p> -->", f"<form>{text(2, 5)}<button>go</button></form>"]))
    box, end = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>"), ("<main><article class=post>", "</article></main>"), ("<div role=main>", "</div>")])
    menu = "<ul>" + "".join(f"<li><a href=#>{text(1, 3)}</a>" for _ in range(rng.randrange(2, 8))) + "</ul>"
    before = rng.choice(["", f"<nav>{menu}</nav>", f"<div class=menu>{menu}</div>", f"<header><p>{text(2, 6)}</p>{menu}</header>"])
    after = rng.choice(["", f"<footer>{text(3, 20)}</footer>", f"<div id=footer><p>{text(3, 20)}</p></div>", f"<div class='comments'><p>{text(5, 60)}</p><p>{text(5, 60)}</p></div>", f"<aside><h3>{text(1, 3)}</h3>{menu}</aside>"])
    return f"<html><head><title>{text(2, 5)}</title></head><body>{before}{box}{''.join(body)}{end}{after}</body></html>", "\n".join(want)


def test_made_pages_give_their_articles():
    rng = random.Random(31)
    right = [extract.main_text(html) == want for html, want in (_made_page(rng) for _ in range(400))]
    assert sum(right) >= 396


def test_surroundings_go():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'><div class='site-header'><a>Home</a></div><nav>menu</nav>"
        "<div id='cookie-notice'>We use cookies and more cookies on every page that you open here</div><main><article><header><h1>Title</h1></header><p>First <b>bold</b> text</p>"
        "<aside>side note</aside><script>var x='<p>no</p>'</script><p>Second &lt;part&gt;</p><div class='share-buttons'><a>tweet</a></div></article></main>"
        "<section class='comments'><article><p>I like this article very much, thanks a lot to the writer of it</p></article></section><form>name</form><footer>&copy;</footer></body>"
    )
    assert extract.main_text(page) == "Title\nFirst bold text\nSecond <part>"


_LONG = " ".join(f"word{i}" for i in range(48))
_PAGE = f"<html><body><nav><a>home</a> <a>news</a></nav><article><h1>A title here</h1><p>{_LONG}.</p>%s<p>{_LONG}!</p></article>%s</body></html>"


@pytest.mark.parametrize(("name", "times"), [("banner-history", 2), ("menu-of-the-day", 2), ("replies-from-experts", 2), ("menu-list", 0), ("wp-newsletter", 0), ("ad-slot", 0), ("comments-list", 0)])
def test_names_in_an_article_drop_a_part_only_without_a_subject(name, times):
    part = f'<section class="{name}"><p>inside {_LONG}</p><p>inside {_LONG}</p></section>'
    assert extract.main_text(_PAGE % (part, "")).count("inside") == times


@pytest.mark.parametrize("after", ["", "<footer>some words of a footer</footer>", "<div>other</div>"])
def test_equal_comments_in_a_box_of_unknown_name_go_together(after):
    thread = f"<div class=c-thread><p>reader {_LONG}</p><p>reader {_LONG}</p></div>"
    assert "reader" not in extract.main_text(_PAGE % ("", thread + after))


def test_ends_of_markup_comments():
    text = extract.main_text(_PAGE % (f"<!-- unseen --!><p>one {_LONG}</p><!--><p>two {_LONG}</p><!-- unseen --><p>three {_LONG}</p>", "<!-- unseen"))
    assert "unseen" not in text and all(x in text for x in ("one", "two", "three"))


def _greedy(word, vocabulary):
    s, i, n = b" " + word, 0, 0
    while i < len(s):
        j = next((j for j in range(len(s), i, -1) if s[i:j] in vocabulary), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_token_counts_are_greedy(edge_docs, no_docs):
    vocabulary = {bytes([b]) for b in range(256)} | {b" al", b"pha", b"lpha1", b"eta", b"et", b" ze", b"ta1", b" one", b"t", b"wo", b"gam", b"ma5"}
    got = tokens.token_counts(edge_docs, sorted(vocabulary)).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    for r, x in zip(rows, got, strict=True):
        w = (r.text or "").encode().split()
        assert (x.doc_id, x.n_words, x.n_tokens) == (r.doc_id, len(w), sum(_greedy(y, vocabulary) for y in w))
    assert tokens.token_counts(no_docs, sorted(vocabulary)).collect() == []


def test_long_words_are_fast():
    import time

    rng = random.Random(3)
    word = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(100_000)).encode()
    vocabulary = {bytes([b]) for b in range(256)} | {word[i : i + k] for i in range(0, 3000, 3) for k in (2, 3, 6)}
    a = tokens.Automaton.build(sorted(vocabulary))
    raw, ends = np.frombuffer(word, np.uint8), np.array([0, len(word)])
    a.count(raw[:300], np.array([0]), np.array([300]))
    start = time.time()
    got = int(a.count(raw, ends[:1], ends[1:])[0])
    assert len(word) / (time.time() - start) > 2e6
    assert a.count(raw[:3000], np.array([0]), np.array([3000])).tolist() == [_greedy(word[:3000], vocabulary)] and got > 100_000


def test_automaton_on_random_vocabularies(monkeypatch):
    monkeypatch.setattr(tokens, "SHORT", 6)
    rng = random.Random(4)
    for _ in range(150):
        vocabulary = {bytes(rng.choice(b"ab c" if k == 0 else b"abc") for k in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 14))}
        a = tokens.Automaton.build(sorted(vocabulary))
        ws = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(20)]
        end = np.cumsum([len(x) for x in ws])
        got = a.count(np.frombuffer(b"".join(ws), np.uint8), end - [len(x) for x in ws], end)
        assert got.tolist() == [_greedy(x, vocabulary) for x in ws]


def _labelled(spark, n=120):
    rng = random.Random(6)
    de, en = "der die und nicht ein schön über für haben werden".split(), "the and not one with from have was they about".split()
    rows = []
    for i in range(n):
        pool, lang = ((de, "de"), (en, "en"), ([c for c in "αβγδε"], "el"))[i % 3]
        rows.append((i, " ".join(rng.choice(pool) + (rng.choice(pool)[:3] if rng.random() < 0.3 else "") for _ in range(40)), lang))
    return spark.createDataFrame([*rows, (None, None, "de"), (7, "text", None)], "doc_id long, text string, lang string"), de, en


def test_language_held_out_and_spans(spark, edge_docs, no_docs):
    docs, de, en = _labelled(spark)
    model = language.train_languages(docs.where(~language.held_out(F.col("doc_id"))))
    assert model.languages == ["de", "el", "en"]
    got = {r.doc_id: r for r in language.identify(docs.where("lang is not null and text is not null"), model).collect()}
    assert all(got[r.doc_id].lang_pred == r.lang for r in docs.where("lang is not null and text is not null").collect())
    mixed = spark.createDataFrame([(1, " ".join(de * 3 + en * 2)), (2, "123 !!"), (3, None), (4, "αβ γδ")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.identify(mixed, model, spans=True).collect()}
    assert [s.lang for s in rows[1].spans] == ["de", "en"] and rows[1].lang_pred == "de" and 0.5 < rows[1].score < 1
    assert (rows[2].lang_pred, rows[2].score, rows[3].lang_pred, rows[4].lang_pred) == ("und", 0.0, "und", "el")
    assert len(language.identify(edge_docs, model).collect()) == edge_docs.count()
    named = language.with_language(edge_docs, model)
    assert named.columns == [*edge_docs.columns, "lang_pred_", "lang_score_"] and named.count() == edge_docs.count()
    empty = language.train_languages(no_docs)
    assert {r.lang_pred for r in language.identify(edge_docs, empty).collect()} == {"und"}


def test_marks_alone_are_no_letters(spark):
    docs, _, _ = _labelled(spark)
    model = language.train_languages(docs)
    rows = [(1, "\u0301\u0302 12 \u0308"), (2, "\u0301 the and not \u0302 with"), (3, "e\u0301"), (4, "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("en", 1.0) and got[3][0] != "und" and got[4] == ("und", 0.0)


def test_viterbi_like_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, k, penalty = int(rng.integers(1, 7)), int(rng.integers(1, 4)), float(rng.uniform(0, 3))
        s = rng.standard_normal((n, k)) * 2
        worth = {p: sum(s[t, x] for t, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(k), repeat=n)}
        assert abs(worth[tuple(language.viterbi(s, penalty).tolist())] - max(worth.values())) < 1e-9


def test_too_many_languages(spark):
    docs = spark.range(5).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError):
        language.train_languages(docs, language.LangParams(most_languages=4))


def test_shortcut_paths_are_best_paths(spark):
    docs, de, en = _labelled(spark)
    model = language.train_languages(docs)
    rng = random.Random(8)
    texts = [" ".join(rng.choice((de, en)[rng.randrange(2)]) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [" ".join(de * 4 + en * k + de) for k in range(6)]
    w = language._Words(texts, model.params.buckets)
    with np.errstate(over="ignore"):
        for path, s in model._paths(w):
            if len(path):
                best = language.viterbi(s, model.params.penalty)
                worth = lambda p: s[np.arange(len(p)), p].sum() - model.params.penalty * (p[1:] != p[:-1]).sum()
                assert abs(worth(path) - worth(best)) < 1e-6


def test_quality_edges_and_held_out(spark, edge_docs, no_docs):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(300):
        t, bad, toxic = sentence(rng, 50), i % 5 == 0, i % 4 == 0
        t = t.upper().replace(" ", "!! ") if bad else t
        rows.append((i, t + (" vile," if toxic else ""), f"s{i % 2}", "en", len(t)))
        marks.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.train_quality(docs, labels.where("doc_id % 3 <> 1").union(spark.createDataFrame([(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")))
    assert all(model.exchanged.values())
    held = {r.doc_id: r for r in quality.score_quality(docs.where("doc_id % 3 = 1"), model).collect()}
    right = [held[d].keep == bool(q and not t) for d, q, t in marks if d % 3 == 1]
    assert sum(right) / len(right) > 0.95
    assert len(quality.score_quality(edge_docs, model).collect()) == edge_docs.count()
    assert quality.score_quality(no_docs, model).collect() == []
    plain = quality.train_quality(docs, labels.limit(0))
    assert {(r.good, r.toxic) for r in quality.score_quality(edge_docs.select("doc_id", "text"), plain).collect()} == {(0.5, 0.0)}


def _brute_lines(rows):
    """Line removal one text after another, in order of doc_id (nulls first)."""
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        if t is None:
            out[d, t] = (None, 0, 0)
            continue
        ls = t.split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.setdefault(w, (d, i))
        out[d, t] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone))
    return out


def test_line_windows(spark, edge_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "c c"]) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [rows[3], (None, "a\nb\nc c"), (70, None), (71, ""), (72, "\n\n\n"), (73, "\n".join(["same"] * 2000))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, pos int, h1 long")
    truth = _brute_lines(rows)
    got = lines.dedup_lines(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for (d, _), v in truth.items():
        by_id.setdefault(d, []).append(v)
    for r in got:
        assert (r.text, r.n_lines, r.n_removed) in by_id[r.doc_id]
    assert lines.dedup_lines(edge_docs).count() == edge_docs.count() and lines.dedup_lines(no_docs).collect() == []


def test_words_of_long_texts_are_whole():
    text = "ab " * 800_000 + "cd"
    (first, h, at), = words.word_hashes(pa.array([text]))
    assert (first, len(h), at.tolist()) == (0, 800_001, [0, 800_001]) and len(set(h.tolist())) == 2
    (_, h, _), = words.word_hashes(pa.array(['"Hi," hi -- !hi']), bare=True)
    assert len(h) == 3 and len(set(h.tolist())) == 1
