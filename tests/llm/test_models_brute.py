"""The text models against plain re-implementations."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from snapledger.llm import html_main, language_id, quality_knn
from snapledger.llm.common import in_training
from snapledger.llm.html_main import Page, best_region, main_text
from snapledger.llm.language_id import identify
from snapledger.llm.quality_knn import TermSlots, fit, quality


def language_rows():
    rnd = random.Random(3)
    words = {"en": "the and of there that which house water".split(), "de": "der die und nicht über straße haus wasser".split(), "fr": "le la et être où maison eau élève".split()}
    return [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(3, 12))), lang) for i in range(90) for lang in [list(words)[i % 3]]]


def grams(text):
    t = text.lower()
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_language_scores_equal_kernel_ridge_on_string_sets(spark):
    """With every learnable row a landmark, the scores are those of kernel ridge regression on sets of n-grams."""
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = {r["doc_id"] for r in docs.where(in_training("doc_id")).collect()}
    texts = sorted({(t, lang) for i, t, lang in rows if i in learn})
    sets = [grams(t) for t, _ in texts]
    langs = sorted({lang for _, lang in texts})

    def kernel(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(k)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    z = np.c_[k @ root, np.ones(len(k))]
    y = np.where(np.array([lang for _, lang in texts])[:, None] == np.array(langs), 1.0, -1.0)
    penalty = language_id.RIDGE * len(z) / z.shape[1] * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    for i, text, _ in rows:
        f = language_id.SHARPNESS * (np.r_[[kernel(grams(text), b) for b in sets] @ root, 1.0] @ w)
        p = np.exp(f - f.max()) / np.exp(f - f.max()).sum()
        assert got[i]["lang_pred"] == langs[p.argmax()]
        assert got[i]["score"] == pytest.approx(p.max(), abs=2e-3)


def test_repeated_rows_count_once_in_the_language_fit(spark):
    rows = language_rows()
    plain = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {r["doc_id"]: (r["lang_pred"], round(r["score"], 3)) for r in plain.collect()}
    again = [r for r in rows if r[0] in (0, 3, 4, 5)] * 300
    got = identify(spark.createDataFrame(rows + again, "doc_id long, text string, lang string").repartition(5)).collect()
    assert len(got) == len(rows) + len(again)
    assert {(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in got} == {(i, *v) for i, v in want.items()}
    alone = spark.range(20_000).selectExpr("0L AS doc_id", "'some text' AS text", "'en' AS lang")
    assert {(r["lang_pred"], r["n"]) for r in identify(alone).groupBy("lang_pred").count().withColumnRenamed("count", "n").collect()} == {("en", 20_000)}
    many = spark.range(500).selectExpr("0L AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'x' AS held_out")
    assert identify(many).count() == 500


def quality_rows():
    rnd = random.Random(8)
    good, bad = "calm river stone letter garden winter".split(), "buy $$$ click!!! WIN FREE now".split()
    rows = [(i, " ".join(rnd.choice(good if i % 2 else bad) for _ in range(rnd.randrange(1, 9)))) for i in range(200)]
    return rows + [(200 + k, "garden winter stone") for k in range(60)], [(i, i % 2) for i in range(200)] + [(200 + k, 1 if k % 3 else 0) for k in range(60)]


def test_votes_equal_brute_force_and_ties_all_vote(spark):
    rows, marks = quality_rows()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    model = fit(docs, labels, "doc_id", "text", "quality")
    assert len({v.tobytes() for v in model.vectors}) < len(model.vectors)
    known = TermSlots()
    texts = [t for _, t in rows][:40] + ["", "never seen", "garden winter stone"]
    z = model.latent(model.terms(texts, known)).astype(np.float64)
    got = model.score(texts, known)
    for text, q, s in zip(texts, z, got, strict=True):
        near = sorted(((float(q @ v.astype(np.float64)), lab) for v, lab in zip(model.vectors, model.labels, strict=True)), reverse=True)
        last = near[min(quality_knn.NEIGHBOURS, len(near)) - 1][0]
        votes = [(max(c, 0) ** quality_knn.FOCUS, lab) for c, lab in near if c >= last - quality_knn.TIE]
        total = sum(w for w, _ in votes)
        want = sum(w * lab for w, lab in votes) / total if total > 1e-9 else model.prior
        assert s == pytest.approx(want, abs=1e-4), text
    order = np.random.default_rng(0).permutation(len(model.labels))
    model.vectors, model.labels = model.vectors[order], model.labels[order]
    assert model.score(texts, known) == pytest.approx(got, abs=1e-6)


def test_the_latent_directions_are_the_leading_ones(spark):
    rows, marks = quality_rows()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    model = fit(docs, labels, "doc_id", "text", "quality")
    directions = model.project / np.maximum(np.linalg.norm(model.project, axis=0), 1e-12)
    assert model.project.shape[1] <= quality_knn.LATENT and np.isfinite(directions).all()


def test_quality_of_repeated_ids_empty_tables_and_long_tokens(spark):
    rows, marks = quality_rows()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    assert quality(docs.limit(0), labels).collect() == []
    hot = spark.range(3000).selectExpr("1L AS doc_id", "concat('row ', id) AS text", "'x' AS score")
    assert quality(hot, labels).count() == 3000
    long_ = spark.createDataFrame([(1, "word " * 200_000), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    got = quality(docs.unionByName(long_), labels).where("doc_id <= 3").collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    slots = TermSlots()
    assert slots["a" * 80 + "7" * 9] != slots["a" * 80] and slots["a" * 300] == slots["a" * 300] and "a" * 300 not in slots


@pytest.mark.parametrize("seed", range(60))
def test_the_region_has_the_highest_sum(seed):
    rnd = random.Random(seed)
    scores = [rnd.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rnd.randrange(0, 25))]
    sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
    best = max(sums.values(), default=0)
    found = best_region(scores)
    assert (found is None) == (best <= 0)
    if found:
        assert sums[found] == best and found[1] == min(b for (a, b), s in sums.items() if s == best)


ARTICLE = ["The river rose slowly during the night and nobody in the village noticed it.", "By the morning the lower street was under water, and boats were tied to the lamps.", "People carried their books upstairs, one box after the other, until the stairs were full.", "It took nine days before the water fell again and the first shop opened its door."]
LINKS = "".join(f'<a href="/{k}">{w}</a> ' for k, w in enumerate("Home News Sport Weather Contact Login Help".split()))


def plain_pages():
    """(page, main text): layouts without class names and without elements that name their part."""
    prose = "".join(f"<p>{p}</p>" for p in ARTICLE)
    small = "".join(f"<div><a href='/s{k}'>See also {k}</a></div>" for k in range(9))
    yield f"<body><div>{LINKS}</div><div><h1>Flood</h1>{prose}</div><div>{small}</div></body>", ["Flood", *ARTICLE]
    yield f"<body><table><tr><td>{LINKS}</td><td>{prose}</td><td>{small}</td></tr></table></body>", ARTICLE
    yield f"<body><ul>{''.join(f'<li><a>{k}</a></li>' for k in range(30))}</ul><div><div>{prose}</div></div><div><a>Terms</a> <a>Privacy</a></div></body>", ARTICLE
    yield f"<body><div>{small}</div><h1>Flood</h1><div>{prose}<ul><li>{ARTICLE[0]}</li></ul></div></body>", ["Flood", *ARTICLE, ARTICLE[0]]
    yield f"<body><div><b>{'</b><b>'.join('ABCDEFGH')}</b></div><div>{'<br><br>'.join(ARTICLE)}</div></body>", [" ".join(ARTICLE)]
    yield f"<div><select>{''.join(f'<option>{k}' for k in range(40))}</select></div><section><h2>One</h2>{prose}</section><p>{LINKS}</p>", ["One", *ARTICLE]


def f1(got, want):
    a, b = Counter(re.findall(r"\w+", got)), Counter(re.findall(r"\w+", want))
    both = sum((a & b).values())
    return 2 * both / max(sum(a.values()) + sum(b.values()), 1)


def test_the_scan_alone_finds_the_text_of_plain_pages():
    scan = [f1(main_text(Page(p), {}, lists=False), "\n".join(t)) for p, t in plain_pages()]
    both = [f1(main_text(Page(p), {}), "\n".join(t)) for p, t in plain_pages()]
    whole = [f1(" ".join(x for _, _, x in Page(p).pieces if x), "\n".join(t)) for p, t in plain_pages()]
    assert min(both) > 0.95 and np.mean(scan) > 0.9 > np.mean(whole)


def test_class_names_set_aside_only_what_they_name():
    keep = '<div><p class="related">Related work is older.</p><div class="search-tip">Search the shore at low tide.</div><h2 class="share">Shares of land</h2></div>'
    page = f"<main><h1>T</h1><p>{ARTICLE[0]}</p>{keep}<div class='related-posts'>Other story</div><div class='share_buttons'>Tell all</div></main>"
    text = main_text(Page(page), {})
    assert "older" in text and "low tide" in text and "Shares" in text and "Other" not in text and "Tell" not in text
    talk = f"<body><h1>Flood</h1><div><p>{ARTICLE[0]}</p><p>{ARTICLE[1]}</p></div><div class='thread'><div>I was there and saw it all, it was a long night.</div></div></body>"
    assert main_text(Page(talk), {}).split("\n") == ["Flood", *ARTICLE[:2]]


def test_repeated_and_very_long_pages(spark):
    page = f"<article><h1>T</h1><p>{ARTICLE[0]}</p></article>"
    rows = [(1, "u", page)] * 50 + [(2, "u", f"<article>{f'<p>{ARTICLE[1]}</p>' * 5000}</article>"), (3, None, None), (None, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_main.extract(pages.selectExpr("*", "'x' AS text", "1 AS n_chars")).collect()
    assert len(got) == len(rows) and {r["n_chars"] for r in got if r["page_id"] == 2} == {5000 * (len(ARTICLE[1]) + 1) - 1}


@pytest.mark.parametrize("page", ["<b>{n}text{m}", "<p><div>{n}{h}text", "{a}"])
def test_unbalanced_pages_take_time_in_proportion(page):
    """About 1 MB each; every tag once looked through all that is open."""
    import time

    n = 80_000
    source = page.format(n="<b>" * n, m="</i>" * n, h="<h1></h1>" * n, a="<article>x</article>" * 50_000)
    began = time.perf_counter()
    main_text(Page(source), {})
    assert time.perf_counter() - began < 15


def test_tags_close_what_they_name_and_no_more():
    page = Page("<div><p>a<b>c</i>d<p>e<table><tr><td><p>f<td>g</table>h</div>k<ul><li>l<ul><li>m</ul><li>n</ul></u>")
    own = {}
    for element, _, text in page.pieces:
        if text is not None:
            own.setdefault(element, []).append(text)
    path = lambda e: [page.names[e], *(path(page.parents[e]) if page.parents[e] >= 0 else [])]
    found = {text: "/".join(path(e)[:-1][::-1]) for e, texts in own.items() for text in texts}
    assert found == {
        "a": "div/p", "c": "div/p/b", "d": "div/p/b", "e": "div/p", "f": "div/table/tr/td/p", "g": "div/table/tr/td", "h": "div", "k": "",
        "l": "ul/li", "m": "ul/li/ul/li", "n": "ul/li",
    }
