"""Operators 1 to 10 against brute force, round trips and edge cases."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format, decontam, exact_topk, html_extract, license_scan, mixing, near_dup, quality, sharding, url_filter
from quillspark.llm.common import text_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LONG = "word " * 30_000


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", f"src{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


EDGES = [None, "", " \n ", "a", LONG, "same text here, twice.", "same text here, twice."]


# 1
def test_url_parts_and_rules(spark):
    urls = [("HTTPS://WWW.Example.COM/de/X?q#f", "www.example.com", "/de/X", "example.com/de/", "block"), ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://a.net", "a.net", "", None, None), ("http://a.net/x", "a.net", "/x", "net/", "block"), ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), ("no scheme", "", "", None, None), (None, "", "", None, None), ("x://h?p/q", "h", "", None, None)]
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, score string")
    out = {r["page_id"]: r for r in url_filter.judge(df, url_filter.fit(url_filter.labelled(spark))).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] == verdict or (verdict is None and out[i]["verdict"] in ("allow", "block"))


def test_url_model(spark):
    m = url_filter.fit(url_filter.labelled(spark))
    seen = [("http://www.mega-casino.example.com/en/3", "block"), ("http://cheap-viagra-pills.example.org/en/3", "block"), ("https://www.city-museum.example.com/en/3", "allow"), ("http://thertion.example.org/en/3", "allow")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(seen)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(df, m).orderBy("page_id").collect()] == [v for _, v in seen]


# 2
def test_licenses(spark):
    mit = license_scan.TEMPLATES[2][1]
    texts = [prose(200, 1) + " " + mit + " " + prose(200, 2), "x\nReleased under the MIT License.\ny", " ".join(mit.split()[: len(mit.split()) // 2]), prose(300, 3), *EDGES]
    out = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs(spark, texts)).collect()}
    assert out == {(0, "MIT"), (1, "MIT")}
    assert license_scan.scan(docs(spark, []).limit(0)).count() == 0


# 3
def test_quality(spark):
    good, bad = [prose(40, i) + "." for i in range(80)], [" | ".join(prose(40, i + 500).split()) for i in range(80)]
    d = docs(spark, [x for pair in zip(good, bad) for x in pair] + EDGES)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(160)], "doc_id long, quality int")
    out = quality.score(d, quality.fit(d, labels)).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"] and r["doc_id"] < 160]
    assert len(out) == 167 and all(0 <= r["score"] <= 1 for r in out) and len(held) > 10
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.95
    none = quality.score(d, quality.fit(d, labels.limit(0))).select("predicted").distinct().collect()
    assert [r["predicted"] for r in none] == [1]


def test_framing_forms_and_linked_paragraphs():
    one, two = "First paragraph, with some words in it.", "Second paragraph; it has a few more words."
    menu = '<div><a href="/a">Home</a> <a href="/b">About us</a></div>'
    link = '<p><a href="/x">A paragraph that is one link.</a></p>'
    page = f'<html><body><div class="k1">{menu}</div><div class="content"><p>{one}</p>{link}<p>{two}</p></div></body></html>'
    text = f"{one}\nA paragraph that is one link.\n{two}"
    assert html_extract.main_text(page) == text
    framed = f'<html><body><form action="/"><input name="q"><button>Go</button><select><option>en</option></select><div class="content"><p>{one}</p>{link}<p>{two}</p></div></form></body></html>'
    assert html_extract.main_text(framed) == text
    small = f'<html><body><div class="content"><p>{one}</p><p>{two}</p><form>Your name <input></form></div></body></html>'
    assert html_extract.main_text(small) == f"{one}\n{two}"
    related = f'<html><body><div class="content"><p>{one}</p><p>{two}</p></div><div><p><a href="/1">One link</a></p><p><a href="/2">Other link</a></p></div></body></html>'
    assert html_extract.main_text(related) == f"{one}\n{two}"


def test_kept_documents_keep_columns_of_any_name(spark):
    good, bad = [prose(40, i) + "." for i in range(60)], [" | ".join(prose(40, i + 500).split()) for i in range(60)]
    texts = [x for pair in zip(good, bad) for x in pair]
    df = spark.createDataFrame([(i, t, f"own{i}", f"mine{i}", i) for i, t in enumerate(texts)] + [(None, good[0], "own", None, None)], "doc_id long, text string, score string, predicted string, row long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(3, 1), (None, 0)], "doc_id long, quality int")  # one document with both labels
    kept = quality.keep_good(df, labels)
    assert kept.dtypes == df.dtypes
    rows = kept.collect()
    assert len(rows) > 40 and all(r["doc_id"] is None or (r["score"], r["predicted"], r["row"]) == (f"own{r['doc_id']}", f"mine{r['doc_id']}", r["doc_id"]) for r in rows)
    assert [r["score"] for r in rows if r["doc_id"] is None] == ["own"]


def test_ratios_select_where_names_and_tags_tell_nothing(monkeypatch):
    lines = [f"{prose(30, i)}, {prose(20, i + 50)}. {prose(12, i + 90).capitalize()}." for i in range(4)]
    menu = "".join(f'<div class="c1"><a href="/{i}">{prose(2, i + 700)}</a></div>' for i in range(6))
    advert, foot = '<div class="c7">Read our offers <i>now</i></div>', '<div class="c9">(c) somewhere</div>'
    paragraphs = f'<div class="c3"><h2>A heading</h2><p>{lines[0]}</p>{advert}<p>Short one.</p><p>{lines[1]}</p></div>'
    blocks = '<div class="c3">' + "".join(f'<div class="c4">{x}</div>' for x in [lines[2], "Short one.", lines[3]]) + advert + "</div>"
    want = {paragraphs: f"A heading\n{lines[0]}\nShort one.\n{lines[1]}", blocks: f"{lines[2]}\nShort one.\n{lines[3]}"}
    pages = {f'<html><body><div class="c0">{menu}</div>{body}{foot}</body></html>': text for body, text in want.items()}
    for page, text in pages.items():
        assert html_extract.main_text(page) == text
    # the ratios do this: with punctuation and length of no account, the advert stays
    monkeypatch.setattr(html_extract.math, "log1p", lambda x: 1.0)
    for page, text in pages.items():
        assert "Read our offers" in html_extract.main_text(page) != text


# 4
@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain &amp; text", "plain & text"), ("<p>one<p>two", "one\ntwo"),
    ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>Long enough, with points. It goes on.<p>Two&nbsp;\n words.<div class='comments'><p>I say, no.</p></div></article><aside><p>Read more, here.</p></aside><script>var t='</p>'</script><footer>end</footer></body></html>", "Head\nLong enough, with points. It goes on.\nTwo words."),
    ("<body><div class='ad'>Buy now, please.</div><div id=main><p>First, a long paragraph of text. With points.</p><p>Second.</p><form>Mail <input></form></div></body>", "First, a long paragraph of text. With points.\nSecond."),
])
def test_html(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<body><div class='post side-effects'><h1>Side effects</h1><p>A long paragraph, with points. And more.</p></div></body>", "Side effects\nA long paragraph, with points. And more."),
    ("<body><article><p title=it's>One, two. Three.</p><p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, too.</p></article></body>", "One, two. Three.\nThen x=2 holds, too."),
    ("<body><p>One, two. Three.</p><div class='cookie-notice'>We use cookies, you see.</div><div id='relatedPosts'><p>More, here.</p></div></body>", "One, two. Three."),
    ("<p>One, two.<!-- a > b --><p>Three < four, and <b>five</b></i>.<!x><?y><a href='z", "One, two.\nThree < four, and five."),
])
def test_html_odd_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "text, here.", '<a "' * 60_000, '<a ="' * 60_001, "<p>a, b." * 30_000, "<b>x" * 30_000 + "</i>" * 30_000, "<" * 200_000, "<!-- " * 40_000, "<ul><li>a" * 20_000])
def test_html_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 5


def test_html_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a, b</p>")] * 2 + [(None, None, None)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_extract.extract(df).collect()) == ["", "a, b", "a, b"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>a, b</p>", "y")], "page_id long, url string, html string, text string")
    assert [(r["text"], r["n_chars"]) for r in html_extract.extract(df).orderBy("page_id").collect()] == [("", 0), ("a, b", 4)]


# 5
def test_chat_round_trip(spark):
    r = random.Random(5)
    parts = ["</s>", "[INST]", "<|im_end|>\n", chat_format.ESCAPE, chat_format.ESCAPE + "1", "<", "|", ">", "word ", "\n", "é😀 ", "[/INST]", "<<SYS>>"]
    rows = []
    for c in range(25):
        for t in range(r.randint(1, 40) if c else 400):
            role = "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "assistant", None, "to\nol"])
            rows.append((c, t // (1 + c % 2), role, None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randint(0, 60)))))
    rows += [(None, None, "user", "x"), (None, 1, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.windows(df, budget=200, history=50)
    out = {x["conv_id"]: x for x in chat_format.digests(made).collect()}
    own: dict = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(own)
    for c, turns in own.items():
        turns.sort()
        whole, loss = "".join(f"{a}\n{b}\n" for _, a, b in turns), "".join(b for _, a, b in turns if a == "assistant")
        assert out[c]["n_turns"] == len(turns) and out[c]["loss_chars"] == len(loss)
        assert out[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert made.filter("tokens > 200 and size(loss) > 1").count() == 0 and made.filter("n_repeated > 0").count() > 0
    assert chat_format.digests(chat_format.windows(df.limit(0))).count() == 0


# 6
def test_mixing(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), "en" if i % 4 else "fr", "big" if i % 3 else None) for i in range(3000)], "doc_id long, text string, lang string, source string")
    topics = spark.createDataFrame([(i, i % 5) for i in range(0, 3000, 2)], "vec_id long, label int")
    out = mixing.mix(d, topics).toPandas()
    assert len(out) == 3000 and set(out["source"]) == {"big", "(none)"}
    assert abs((out["p"] * out["tokens"]).sum() / out["tokens"].sum() - mixing.KEEP) < 1e-3
    assert abs(out.loc[out["kept"], "tokens"].sum() / out["tokens"].sum() - mixing.KEEP) < 0.05
    cells = mixing.raked(mixing.described(d, topics).groupBy(*mixing.SIDES).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))).toPandas()
    for side in mixing.SIDES:
        own = cells.groupby(side).apply(lambda g: (g["weight"] * g["tokens"]).sum(), include_groups=False)
        goal = cells.groupby(side)["tokens"].sum().astype(float) ** mixing.POWER
        assert np.allclose(own / own.sum(), goal / goal.sum(), rtol=0.02)
    assert mixing.mix(docs(spark, EDGES), topics).count() == len(EDGES)
    assert mixing.mix(d.limit(0), topics).count() == 0


def raked_by_numpy(cells, rounds):
    """(weights, the largest share that a marginal is off its target)."""
    side = [np.unique([c[i] for c in cells], return_inverse=True)[1] for i in range(3)]
    t = np.array([c[3] for c in cells], float)
    goal = [np.bincount(s, t) ** mixing.POWER for s in side]
    goal = [t.sum() * g / g.sum() for g in goal]
    w = np.ones(len(t))
    for _ in range(rounds):
        for s, g in zip(side, goal):
            w = w * (g / np.bincount(s, w * t))[s]
    return w, max(np.abs(np.bincount(s, w * t) / g - 1).max() for s, g in zip(side, goal))


def slow_tables():
    """Sparse tables whose raking converges within 180 rounds, though ten of the first take off less than a tenth of the residual."""
    r = random.Random(8)
    while True:
        at = {(f"s{r.randrange(5)}", f"l{r.randrange(3)}") for _ in range(11)}
        cells = [(s, x, "t", int(10 ** r.uniform(1, 6.8))) for s, x in sorted(at)]
        if raked_by_numpy(cells, 180)[1] < 1e-10:
            off = [raked_by_numpy(cells, n)[1] for n in (10, 20, 30, 40)]
            if any(b > 0.9 * a and b > 0.01 for a, b in zip(off, off[1:])):
                yield cells


def test_raking_reaches_targets_slowly(spark):
    cells = next(slow_tables())
    df = spark.createDataFrame([(*c[:3], 1, c[3]) for c in cells], "source string, lang string, topic string, docs long, tokens long")
    got = {(r["source"], r["lang"]): r for r in mixing.raked(df.coalesce(1)).collect()}
    want, _ = raked_by_numpy(cells, 3000)
    assert all(abs(got[c[0], c[1]]["weight"] / w - 1) < 1e-6 and got[c[0], c[1]]["residual"] <= mixing.RESIDUAL for c, w in zip(cells, want))


def test_targets_that_no_weights_meet_leave_a_residual(spark):
    rows = [("a", "x", "t", 1, 100), ("b", "y", "t", 1, 10_000), ("b", "z", "t", 1, 10), ("a", "z", "u", 1, 0)]
    got = mixing.raked(spark.createDataFrame(rows[:3], "source string, lang string, topic string, docs long, tokens long").coalesce(1)).collect()
    assert len(got) == 3 and got[0]["residual"] > 0.01
    ids = spark.createDataFrame([(None, "w w", "en", "a"), (None, "w", "en", "b"), (1, "w w w", "fr", "a"), (1, "w w w", "fr", "a")], "doc_id long, text string, lang string, source string")
    out = mixing.mix(ids, spark.createDataFrame([], "vec_id long, label int")).collect()
    assert len(out) == 4 and len({r["kept"] for r in out if r["doc_id"] == 1}) == 1 and not any(r["kept"] for r in out if r["doc_id"] is None)


# 7
def test_decontamination(spark):
    items = [prose(n, 900 + n) for n in (16, 25, 40, 60)]
    bench = spark.createDataFrame(list(enumerate([*items, "too short", None])), "item_id long, text string")
    texts, want = [], set()
    for i in range(120):
        body = prose(150, i).split()
        if i < 24:
            item = items[i % 4].split()
            if i % 3 == 1:  # a paraphrase: some words replaced
                item = [w if j % 9 else "other" for j, w in enumerate(item)]
            at = (i * 7) % 140
            body[at:at] = item
            want.add((i, i % 4))
        texts.append(" ".join(body))
    out = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs(spark, texts + EDGES), bench).collect()}
    words = [next(text_words([t])) for t in texts]
    brute = {(i, k) for i, w in enumerate(words) for k, it in enumerate(items) if decontam.common_words(next(text_words([it])), w) >= 0.75 * len(it.split())}
    assert want <= brute and out <= brute | want
    assert len(out & want) >= 0.9 * len(want)
    assert decontam.find_leaks(docs(spark, texts[:3]), bench.limit(0)).count() == 0
    assert decontam.find_leaks(docs(spark, texts[:1]).limit(0), bench).count() == 0


def test_decontamination_recall_with_more_items_than_dimensions(spark):
    r = random.Random(17)
    common = prose(300, 4000).split()
    text = lambda n: [r.choice(common) if r.random() < 0.5 else prose(1, r.random()) for _ in range(n)]
    items = [text(r.choice((15, 20, 30, 45))) for _ in range(150)]
    bodies = []
    for i in range(150):
        item = list(items[i])
        for j in r.sample(range(len(item)), int(len(item) * r.choice((0, 0.1, 0.2, 0.35)))):
            item[j] = r.choice(common)
        body = text(120)
        at = r.randint(0, 120)
        bodies.append(body[:at] + item + body[at:])
    words = list(text_words([" ".join(b) for b in bodies]))
    own = list(text_words([" ".join(b) for b in items]))
    brute = {(i, k) for i, w in enumerate(words) for k, it in enumerate(own) if decontam.common_words(it, w) >= 0.75 * len(it) and any(decontam.common_words(it, w[s : s + 32 + 2 * len(it)]) >= 0.75 * len(it) for s in range(0, len(w), 8))}
    bench = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(items)] + [(500, "exact phrase of"), (501, "Zqx"), (502, "...")], "item_id long, text string")
    more = [" ".join(b) for b in bodies] + ["an exact, phrase of it", "exact phrases of it", "ends with zqx", "exact phrase", "of"]
    out = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs(spark, more), bench).collect()}
    assert len(brute) > 80 and len(brute & out) >= 0.95 * len(brute), (len(brute), len(brute - out))
    assert {(i, k) for i, k in out if i >= 150} == {(150, 500), (152, 501)}


def test_common_words():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randint(1, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.common_words(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


# 8
def test_edit_distances():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randint(1, 5) for _ in range(r.randint(0, 40))]
        b = [x for x in a if r.random() > 0.1] + [r.randint(1, 5) for _ in range(r.randint(0, 3))]
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j - 1] + (x != y), p[j] + 1, c[-1] + 1))
            p = c
        for most in (0, 2, 6, 12):
            want = p[-1] if p[-1] <= most else None
            assert near_dup.few_edits(np.array(a, np.uint64), np.array(b, np.uint64), most) == want
            assert near_dup.banded_edits(np.array(a, np.uint64), np.array(b, np.uint64), most) == want


def test_near_duplicates(spark):
    r = random.Random(2)
    passage = prose(60, 77)
    texts = [prose(120, i) + " " + passage for i in range(40)] + [prose(100, 1000 + i) for i in range(60)]
    base = prose(200, 5000).split()
    for _ in range(40):  # near copies of one text
        copy = list(base)
        for j in r.sample(range(200), 4):
            copy[j] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[45].upper() + "!", texts[46], "b c", "B, c", *EDGES]
    words = list(text_words(texts))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] == texts[j] and texts[i] is not None) or near_dup.similar(words[i], words[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    out = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert out == {i: root(i) for i in range(len(texts))}
    kept = near_dup.drop_near_duplicates(docs(spark, texts))
    assert set(kept.columns) == {"doc_id", "text", "lang", "source", "n_chars", "score"}
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({root(i) for i in range(len(texts))})
    assert near_dup.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def linked_classes(texts, *settings):
    """The smallest index of each text's class, by brute force over the pairs that share a key."""
    words = list(text_words(texts))
    keys = [set(near_dup.text_keys(w, np.array([0, len(w)]), *settings)[0].tolist()) for w in words]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and keys[i] & keys[j] and near_dup.similar(words[i], words[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    return dict(enumerate(up))


def test_near_duplicates_that_share_a_passage_with_many(spark):
    passage = prose(150, 78)
    texts = [passage + " " + prose(50, 6000 + i) for i in range(30)]
    texts += [t + " end" for t in texts]
    want = linked_classes(texts, ((3, 1),), ())  # with one key most meet in the passage's bucket only
    assert len(set(want.values())) < 45
    out = near_dup.near_duplicates(docs(spark, texts), shingles=((3, 1),), short=()).collect()
    assert {x["doc_id"]: x["class_id"] for x in out} == want


def test_near_duplicates_through_a_hub_and_along_versions(spark):
    r = random.Random(8)
    hub = prose(200, 7000).split()
    texts = []
    for i in range(60):  # variants of the hub, unlike each other
        own = list(hub)
        for k, j in enumerate(r.sample(range(200), 30)):
            own[j] = f"v{i}w{k}"
        texts.append(" ".join(own))
    texts.append(" ".join(hub))
    version = prose(200, 7001).split()
    for i in range(20):
        version[i * 10 : i * 10 + 10] = prose(10, 7100 + i).split()
        texts.append(" ".join(version))
    r.shuffle(texts)
    texts.sort(key=lambda t: t == " ".join(hub))  # the hub's id is the largest
    want = linked_classes(texts)
    out = near_dup.near_duplicates(docs(spark, texts)).collect()
    assert {x["doc_id"]: x["class_id"] for x in out} == want
    assert sum(want[i] == want[len(texts) - 1] for i in want) >= 40


def test_keys_meet_at_the_stated_similarity():
    r = random.Random(12)
    for size, least in ((5, 0.9), (10, 0.97), (60, 0.97), (300, 0.97)):
        for even in (False, True):
            met = 0
            for i in range(200):
                a = prose(size, 8000 + i).split()
                b = list(a)
                for j in range(2, size, 5) if even else r.sample(range(size), size // 5):
                    b[j] = f"new{j}"
                x, y = text_words([" ".join(a), " ".join(b)])
                assert near_dup.similar(x, y)
                met += bool(np.isin(*(near_dup.text_keys(w, np.array([0, len(w)]))[0] for w in (x, y))).any())
            assert met >= least * 200, (size, even, met)


# 9
def test_top_k(spark):
    g = np.random.default_rng(4)
    rows = [(i, g.normal(size=16).round(3).tolist()) for i in range(1500)] + [(i, [0.5] * 16) for i in range(2000, 2600)]
    rows += [(3000, None), (3001, [None] * 16), (3050, [float("nan")] * 16), (3100, [1.0, -2.0]), (100, [0.25] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out: dict = {}
    for r in exact_topk.top_k(df).orderBy("query_id", "vec_id", "rank").collect():
        out.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    sound = [(i, np.floor(256 * np.pad(np.array(v), (0, 16 - len(v))))) for i, v in rows if v and not any(x is None or x != x for x in v)]
    x = np.array([v for _, v in sound])
    for q, v in sound:
        if q % 50 == 0 and q != 100:
            best = sorted(((-int(s), i) for (i, _), s in zip(sound, x @ v) if i != q))[:5]
            assert [out[q, k + 1][0] for k in range(5)] == [(i, -s) for s, i in best]
    assert exact_topk.top_k(df.limit(0)).count() == 0
    assert exact_topk.top_k(df.filter("vec_id in (50, 51)")).count() == 1


def test_top_k_of_large_components(spark):
    rows = [(i, [float(r), 1.0]) for i, r in enumerate([9e6, -9e6, 1e15, 3e15 + 1, 1e300, 2.0, 1e20])] + [(50, [9e6, 3.0]), (50, [9e6, 2.0]), (100, [-1e30, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    floor = lambda c: math.floor(min(256.0 * c, 1.7e308))
    out: dict = {}
    for x in exact_topk.top_k(df).orderBy("query_id", "rank").collect():
        out.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    for q, own in ((0, [9e6, 1.0]), (50, [9e6, 2.0]), (100, [-1e30, 0.5])):
        scores = [(max(min(sum(floor(a) * floor(b) for a, b in zip(own, v)), 2**63 - 1), -(2**63)), i) for i, v in rows if i != q]
        assert out[q] == [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:5]]


def test_impact_segments_hold_each_component_once_and_are_read_in_part():
    g = np.random.default_rng(8)
    x = np.floor(256 * g.standard_t(3, (3000, 24)))
    x[:400] = x[0]
    ids = np.arange(3000)
    vid, rows = exact_topk._distinct(ids, x, 5)
    index = exact_topk.segments(0, vid, rows)
    again = np.zeros_like(rows)
    for dim, at, values in index.loc[index["dim"] >= 0, ["dim", "rows", "values"]].itertuples(index=False):
        assert not again[at, dim].any()
        again[at, dim] = values
    assert (again == rows).all()
    assert (np.diff(index["impact"]) <= 0).all()
    low = index[(index["dim"] >= 0)].assign(most=lambda d: d["values"].map(lambda v: np.abs(v).max()), least=lambda d: d["values"].map(lambda v: np.abs(v).min())).groupby("impact")
    most, least = low["most"].max(), low["least"].min()
    assert all(most[i] < least[i + 1] for i in range(exact_topk.IMPACTS - 1) if i in most and i + 1 in least)
    out = exact_topk.best(ids[1000:1050], x[1000:1050], index, 5)
    assert (out["postings"] == np.count_nonzero(rows)).all()
    assert out["read"].mean() < 0.7 * np.count_nonzero(rows)
    for q, own in out.groupby("query_id"):
        scores = sorted((-int(s), i) for i, s in zip(ids, x @ x[q]) if i != q)[:5]
        assert [(-s, i) for s, i in zip(own["score"], own["vec_id"])] == scores


def test_top_k_reads_less_than_the_index_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK_VALUES", 1)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 8)
    g = np.random.default_rng(9)
    rows = [(i, (g.normal(size=12) ** 3).round(3).tolist()) for i in range(1200)] + [(2000, [0.0] * 12), (2001, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = exact_topk.walked(df).select("query_id", "read", "postings").toPandas()
    assert found["read"].sum() < 0.9 * found["postings"].sum()
    x = np.array([np.floor(256 * np.pad(np.array(v), (0, 12 - len(v)))) for _, v in rows])
    out: dict = {}
    for r in exact_topk.top_k(df).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert sorted(out) == [i for i, _ in rows if i % 50 == 0]
    for q, own in out.items():
        at = [i for i, _ in rows].index(q)
        assert own == sorted((-int(s), i) for (i, _), s in zip(rows, x @ x[at]) if i != q)[:5]


# 10
def test_sharding(spark, tmp_path):
    s = sharding.Shards(spark, str(tmp_path / "s"), target=20_000, fan_in=4)
    assert s.version() == 0 and s.manifest().count() == 0
    whole = docs(spark, [prose(60, i) for i in range(400)] + EDGES[:4])
    for i in range(6):
        s.append(whole.filter(F.col("doc_id") % 6 == i).repartition(3))
    before = s.manifest().count()
    n = s.compact()
    after = s.manifest().toPandas()
    assert n == 7 and len(after) < before and after["n_rows"].sum() == 404
    assert after["bytes"].max() < 3 * 20_000
    assert sorted(r["doc_id"] for r in s.read().collect()) == list(range(404))
    assert sorted(r["doc_id"] for r in s.read(6).collect()) == list(range(404))  # the older version still reads
    with pytest.raises(RuntimeError, match="another writer"):
        s._commit(s.manifest(), 7)
    s.vacuum()
    assert s.read().count() == 404
    assert sharding.sharded(whole).select("doc_id", "text", "shard").count() == 404


def test_shards_of_nothing_and_of_clashing_names(spark):
    none = sharding.sharded(docs(spark, ["x"]).limit(0))
    assert none.count() == 0 and {"doc_id", "text", "shard", "version"} <= set(none.columns)
    clash = docs(spark, ["x", "y"]).withColumns({"_shard": F.col("doc_id") * 2, "shard": F.lit("own"), "__file": F.lit(1), "_shard_n": F.lit(7)})
    rows = sharding.sharded(clash.repartition(8)).orderBy("doc_id").collect()
    assert [(r["_shard"], r["__file"], r["_shard_n"]) for r in rows] == [(0, 1, 7), (2, 1, 7)] and rows[0]["shard"] != "own"


def test_two_writers_of_a_version(spark, tmp_path):
    s = sharding.Shards(spark, str(tmp_path / "s"))
    s.append(docs(spark, ["a", "b"]))
    seen = s.manifest()
    one, two = (seen.withColumn("version", F.lit(i)) for i in (5, 6))
    assert s._commit(one, 2) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        s._commit(two, 2)
    assert [r["version"] for r in s.manifest(2).select("version").distinct().collect()] == [5]
    assert s.read().count() == 2


def test_each_target_file_is_one_task(spark, tmp_path):
    s = sharding.Shards(spark, str(tmp_path / "s"), target=30_000, fan_in=4)
    s.append(docs(spark, [prose(60, i) for i in range(800)]).repartition(40))
    plan = s.plan().filter("file is not null")
    goal = {r["file"]: (r["n"], r["b"]) for r in plan.groupBy("file").agg(F.sum("n_rows").alias("n"), F.sum("bytes").alias("b")).collect()}
    assert len(goal) > 3 and all(b < 2 * 30_000 for _, b in goal.values())
    s.compact()
    made = s.manifest().filter("version = 2")
    assert sorted(r["n_rows"] for r in made.collect()) == sorted(n for n, _ in goal.values())
