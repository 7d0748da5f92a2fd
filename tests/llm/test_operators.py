"""The operators against brute force, round trips and held-out labels, and on empty, null and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from prismdex.llm import ann, attention_lm, common, license_scan, packing, quality, revisit, simhash, site_style, toxicity, winnow
from prismdex.llm.common import plain_words, space_words

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double"
ODD = [(1, None, None, 1.0), (2, "", "en", 2.0), (3, " \n\t ", "en", None), (None, "no id here", None, None),
       (4, "A word " * 30_000, "en", 0.0), (5, "same text twice", "x", 0.0), (5, "same text twice", "x", 0.0), (6, "é ß 漢字 \x00!", None, 0.0)]


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def held_out_accuracy(spark, scored, label):
    known = scored.where("held_out").join(table(spark, "labels").where(F.col(label).isNotNull()), "doc_id").select(label, "predicted").collect()
    return sum(r[label] == r["predicted"] for r in known) / len(known)


def test_quality_on_held_out_labels(spark):
    scored = quality.op1_quality(table(spark, "documents"), table(spark, "labels"))
    assert scored.count() == table(spark, "documents").count()
    assert held_out_accuracy(spark, scored, "quality") > 0.9


def test_toxicity_on_held_out_labels(spark):
    scored = toxicity.op7_toxicity(table(spark, "documents"), table(spark, "labels"))
    assert held_out_accuracy(spark, scored, "toxic") > 0.9


def test_label_model_learns_from_unlabelled_votes():
    """Few labels, many rows without: the rates and the correlation of a repeated voter come out of the latter."""
    rng = np.random.default_rng(3)
    hidden = rng.random(20_000) < 0.2
    true = np.array([[0.05, 0.1, 0.02, 0.2, 0.1], [0.8, 0.7, 0.5, 0.6, 0.9]])
    votes = (rng.random((20_000, 5)) < true[hidden.astype(int)]).astype(float)
    votes = np.column_stack([votes, np.where(rng.random(20_000) < 0.95, votes[:, 4], 1 - votes[:, 4])])
    sets, times = np.unique(votes, axis=0, return_counts=True)
    post, rates, correlation = toxicity.label_model(sets, times, votes[:60], hidden[:60].astype(float), 25)
    assert np.abs(rates[:, :5] - true).max() < 0.05
    assert correlation[4, 5] > 0.5 and np.abs(correlation[:4, :4]).max() < 0.2
    every, _, _ = toxicity.label_model(sets, times, votes, hidden.astype(float), 25)
    assert ((every > 0.5) == hidden).mean() > 0.95 and ((post > 0.5) == hidden[:60]).mean() > 0.9


def test_toxicity_counts_the_votes_of_all_documents(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    sets, times = toxicity.vote_counts(docs, model := toxicity.fit(docs, labels))
    crc = [zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in docs.select("doc_id").collect()]
    assert times.sum() == sum(crc) and sets.shape[1] == model.n_voters and len(np.unique(sets, axis=0)) == len(sets)


@pytest.mark.parametrize("operator", [quality.op1_quality, toxicity.op7_toxicity])
def test_classifiers_on_odd_and_empty_tables(spark, odd, none, operator):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = rows(operator(odd, labels))
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert rows(operator(none, labels)) == []
    assert len(rows(operator(odd, labels.where("doc_id < 0")))) == len(ODD)


PAGE = ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div>"
        "<article><h1>A &amp; B</h1><p>one<br>two <b>bold<p>three &nbsp; four</p><script>var x='</p>'</script>"
        "<div id='comments'><p>reader says</p></div></article><footer>f</footer></body></html>")


def test_article_text():
    assert site_style.text_blocks(site_style.Tree(PAGE).root, frozenset()) == ["A & B", "one two bold", "three four"]


def test_low_importance_branches_go(spark):
    page = "<body><div class='x1'><p>read our other sites today</p></div><div class='x2'><p>story number {0} tells of {0}</p></div></body>"
    pages = [(i, "http://a.example/1", page.format(i)) for i in range(12)]
    pages += [(100, None, None), (101, "http://b.example", ""), (102, "http://b.example", "plain text")]
    found = {r["page_id"]: r for r in rows(site_style.op2_site_style(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert found[3]["text"] == "story number 3 tells of 3" and found[3]["n_chars"] == 25
    assert [found[i]["text"] for i in (100, 101, 102)] == ["", "", "plain text"]


def extracted(spark, pages):
    """{page_id: text} of (page_id, url, html) rows."""
    return {r["page_id"]: r["text"] for r in rows(site_style.op2_site_style(spark.createDataFrame(pages, "page_id long, url string, html string")))}


def test_copies_of_a_page_do_not_empty_it(spark):
    page = "<html><head></head><body><article><p>story number {0} tells of {0} and of what came after</p></article></body></html>"
    bare = page.replace("article", "div")
    story = "story number {0} tells of {0} and of what came after"
    pages = [(i, "http://eight.example/", page.format(0)) for i in range(8)]
    pages += [(100 + i, "http://most.example/", page.format(max(0, i - 89))) for i in range(100)]  # 90 copies, 10 others
    pages += [(300 + i, "http://bare.example/", bare.format(max(0, i - 89))) for i in range(100)]
    found = extracted(spark, pages)
    assert {found[i] for i in range(8)} == {story.format(0)}
    for first in (100, 300):
        assert [found[first + i] for i in range(100)] == [story.format(max(0, i - 89)) for i in range(100)]


def test_near_copies_keep_their_text(spark):
    text = "<p>one long passage that all of these pages share, word for word, from the first to the last of it</p>"
    pages = [(i, "http://a.example/", f"<body><div>{text}<p>seen {i}</p></div></body>") for i in range(20)]
    assert all("one long passage" in t and t.endswith(f"seen {i}") for i, t in extracted(spark, pages).items())


def test_the_tree_judges_articles_and_what_is_beside_them(spark):
    body = "number {0} has a text of its own, of {0} and of {0}s, that stands on no other page"
    box = "<div class='c7'><p>leave your address with us</p></div>"
    pages = [(i, "http://box.example/", f"<body><article id='post-{i}'><p>part one {body.format(i)}</p>{box}<p>part two {body.format(i)}</p></article>"
              f"<div>our other sites</div></body>") for i in range(20)]
    pages += [(100 + i, "http://teaser.example/", f"<body><div><p>real {body.format(i)}</p></div><article><p>teaser {i}</p></article>"
               "<ul><li><a href='/'>next</a></li></ul></body>") for i in range(20)]
    pages += [(200, "http://one.example/", f"<body><main><p>begins</p></main><section><p>goes on <a href='/'>here</a> {body.format(1)}</p></section></body>")]
    found = extracted(spark, pages)
    for i in range(20):
        assert found[i] == f"part one {body.format(i)}\n\npart two {body.format(i)}"
        assert found[100 + i] == f"real {body.format(i)}\n\nteaser {i}"
    assert found[200] == f"begins\n\ngoes on here {body.format(1)}"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    import xxhash
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{row: smallest id} over (id, fingerprint) rows."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(prints, group):
        least[g] = min(i, least.get(g, i))
    return [least[g] for g in group]


def test_simhash_against_brute_force(spark, odd, none):
    docs = table(spark, "documents").where("doc_id < 400")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in sorted(texts.items())]
    expected = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(simhash.op3_simhash(docs))} == expected
    assert len(rows(simhash.op3_simhash(odd))) == len(ODD)
    assert rows(simhash.op3_simhash(none)) == []


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_of_crowded_bands_keep_components(spark, tile):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 1 << 63, 6)]
    prints = sorted({b ^ sum(1 << int(k) for k in r.choice(20, r.integers(0, 5), replace=False)) for b in base for _ in range(60)})
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, tile)
    assert all((a["a"] ^ a["b"]).bit_count() <= 3 for a in edges.collect())
    roots = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    assert [roots.get(p, p) for p in prints] == brute_components([(p, p) for p in prints])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def test_language_model(spark, odd, none):
    docs = table(spark, "documents").where("doc_id < 300")
    got = {r["doc_id"]: r for r in rows(attention_lm.op4_attention_lm(docs))}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts: dict = {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*space_words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words = [*space_words(t), None]
        assert got[i]["n_tokens"] == len(words) and got[i]["train_tokens"] == total
        assert got[i]["n_known"] == sum(w in counts for w in words)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in words))
        assert np.isfinite(got[i]["score"]) and got[i]["score"] < 0
    assert len(rows(attention_lm.op4_attention_lm(odd))) == len(ODD)
    assert rows(attention_lm.op4_attention_lm(none)) == []


def small_model():
    s = attention_lm.Settings(width=4, context=8, classes=5, inputs=7, before=3)
    r = np.random.default_rng(0)
    counts = np.array([5.0, 3, 0, 1, 2, 2, 1, 0, 4])
    vocabulary = attention_lm.Vocabulary(counts, s)
    import pandas as pd
    vocabulary.cluster(pd.DataFrame({"side": [0, 0, 1], "near": [0, 1, 1], "id": [0, 1, 4], "n": [2, 3, 1]}))
    vocabulary.follow(np.array([0, 1, 3]), np.array([0, 1, 4]), np.array([2, 3, 1]))
    return attention_lm.Attention(s, np.log(r.dirichlet(np.ones(5), 7))), vocabulary


def plain_log10(ids, model, vocabulary):
    """The model's probability of the ids, one id at a time, with its whole window in plain loops."""
    s, p, total = model.s, {k: v.astype(float) for k, v in model.p.items()}, 0.0
    wq, wk, wv = np.split(p["wqkv"], 3, 1)
    link, after, n = vocabulary.after
    count = {(a, b): k for a, b, k in zip(link, after, n)}
    for i, token in enumerate(ids):
        start = 0 if i < s.context else (i - s.context // 2) // (s.context // 2) * (s.context // 2)
        seen = [0 if k == 0 else vocabulary.row[ids[k - 1]] for k in range(start, i + 1)]
        e = np.array([p["emb"][r] + p["pos"][k] for k, r in enumerate(seen)])
        a = np.array([(e[-1] @ wq) @ (x @ wk) / np.sqrt(s.width) for x in e])
        a = np.exp(a) / np.exp(a).sum()
        h = e[-1] + sum(w * (x @ wv) for w, x in zip(a, e)) @ p["wo"]
        z = h @ p["wc"] + p["bc"] + model.prior[seen[-1]]
        total += np.log10(np.exp(z - z.max())[vocabulary.cls[token]] / np.exp(z - z.max()).sum())
        before = 0 if i == 0 else vocabulary.link[ids[i - 1]]
        same = [x for x in range(vocabulary.size) if vocabulary.cls[x] == vocabulary.cls[token]]
        whole = sum(count.get((before, x), 0) for x in same)
        total += np.log10((count.get((before, token), 0) + 4 * vocabulary.alone[token]) / (whole + 4))
    return total


def test_batched_windows_equal_plain_attention():
    model, vocabulary = small_model()
    r = np.random.default_rng(2)
    model.p = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in model.p.items()}
    docs = [r.integers(0, 9, n) for n in (1, 5, 8, 9, 12, 13, 31, 100)]
    got = attention_lm.log10_probability(docs, model, vocabulary)
    assert got == pytest.approx([plain_log10(d, model, vocabulary) for d in docs], rel=1e-5)


def test_gradients_are_those_of_the_loss():
    model, _ = small_model()
    r = np.random.default_rng(4)
    model.p = {k: (v + r.normal(0, 0.3, v.shape)) for k, v in model.p.items()}
    x, y, real = r.integers(0, 7, (3, 8)), r.integers(0, 5, (3, 8)), r.random((3, 8)) < 0.8

    def loss():
        z = model.forward(x)[0]
        return -((np.take_along_axis(z, y.reshape(-1, 1), 1)[:, 0] - np.log(np.exp(z).sum(1))) * real.ravel()).sum() / real.sum()

    start, slope = {k: v.copy() for k, v in model.p.items()}, {}
    for name in model.NAMES:
        slope[name] = np.zeros(start[name].size)
        for at in range(start[name].size):
            for sign in (1, -1):
                model.p[name].ravel()[at] = start[name].ravel()[at] + sign * 1e-4
                slope[name][at] += sign * loss() / 2e-4
            model.p[name].ravel()[at] = start[name].ravel()[at]
    model.seen = {k: np.zeros(v.shape) for k, v in model.p.items()}
    with np.errstate(all="ignore"):
        model.step(x, y, real)
    for name in model.NAMES:  # the first sum of squares is the squared gradient
        assert np.sqrt(model.seen[name]).ravel() == pytest.approx(np.abs(slope[name]), abs=2e-3)


def test_model_is_a_probability_and_scores_each_id_once():
    model, vocabulary = small_model()
    for size in (1, 8, 9, 12, 13):
        ids = np.random.default_rng(size).integers(0, 9, size)
        whole = attention_lm.log10_probability([ids], model, vocabulary)[0]
        more = [attention_lm.log10_probability([np.append(ids, k)], model, vocabulary)[0] for k in range(9)]
        assert sum(10 ** (m - whole) for m in more) == pytest.approx(1, abs=1e-4)


def test_gradient_step_lowers_the_loss():
    model, _ = small_model()
    r = np.random.default_rng(1)
    x, y, real = r.integers(0, 7, (16, 8)), r.integers(0, 5, (16, 8)), np.ones((16, 8), bool)
    loss = lambda: -model.scored(model.tables(), x, y, 0).mean()
    before = loss()
    for _ in range(40):
        model.step(x, y, real)
    assert loss() < before * 0.9


def test_language_model_learns_from_every_document_and_id(spark):
    import pandas as pd
    s = attention_lm.Settings()
    ids = np.arange(6000) % 5000
    vocabulary = attention_lm.Vocabulary(np.bincount(ids, minlength=5000).astype(float), s)
    assert len(set(vocabulary.row)) == 5000
    vocabulary.cluster(pd.DataFrame({"side": [0, 0, 1], "near": [0, 1, 1], "id": [0, 1, 4], "n": [2, 3, 1]}))
    prior = np.zeros((5001, s.classes))
    for doc_id in (None, 0, 2, 3, 4, 5):
        assert zlib.crc32(str(doc_id).encode()) % 7 != 2
        docs = spark.createDataFrame([(1, doc_id, bytearray(ids.astype("<u2").tobytes()))], "row long, doc_id long, ids binary")
        shared = spark.sparkContext.broadcast((vocabulary, prior))
        start = attention_lm.Attention(s, prior)
        moved = attention_lm.Attention(s, prior).load(*attention_lm.train(docs, shared, s)).p["emb"] != start.p["emb"]
        assert moved.any(1)[1:].all()


def test_language_model_scores_do_not_hang_on_the_layout(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    held = F.sum(F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.col("score")))
    one, eight, many = (attention_lm.score_documents(docs.repartition(n)).agg(held).first()[0] for n in (1, 8, 64))
    off = attention_lm.score_documents(docs, settings=attention_lm.Settings(rate=0.0)).agg(held).first()[0]
    assert eight == pytest.approx(one, rel=0.01) and many == pytest.approx(one, rel=0.01)
    assert min(one, eight, many) > off * 0.98


def test_language_model_looks_each_word_up_once(monkeypatch):
    encoder, hashed = packing.Encoder(packing.default_tokenizer()), []
    plain, whole = packing.Encoder(packing.default_tokenizer()), attention_lm.xxhash.xxh64_intdigest
    monkeypatch.setattr(attention_lm.xxhash, "xxh64_intdigest", lambda w, seed: hashed.append(w) or whole(w, seed))
    head = sorted(attention_lm._signed(whole(w, 42)) for w in (b"a", b"the", b"seldom"))
    for keep in (500_000, 3):
        table, seen = attention_lm.WordTable(encoder, np.array(head), np.array([7, 0, 5]), keep), []
        for words in ([b"the", b"a", b"the", b"\n"], [b"caf\xc3\xa9!", b"a"], [], [b"xyzzy", b"the", b"rare", b"rare"]):
            found = table.places(words)
            assert [table.ids[k] for k in found] == [plain.encoded(w.decode()) for w in words]
            assert [table.h[k] for k in found] == [attention_lm._signed(whole(w, 42)) for w in words]
            counts = dict(zip(head, (7, 0, 5)))
            assert [table.c[k] for k in found] == [counts.get(attention_lm._signed(whole(w, 42)), -1) for w in words]
            seen += words
        if keep > 3:
            assert sorted(hashed) == sorted(set(seen))


def test_lots_are_bounded_and_whole():
    for sizes in ([], [0], [9], [3, 3, 3, 3], [0, 0, 50, 1, 1, 9, 2], [10, 10, 10]):
        cuts = list(attention_lm.lots(sizes, 10))
        assert [k for lo, hi in cuts for k in range(lo, hi)] == list(range(len(sizes)))
        assert all(sum(sizes[lo:hi]) <= 10 or sum(x > 0 for x in sizes[lo:hi]) == 1 for lo, hi in cuts)


def test_language_model_vocabulary_equals_plain_counts(spark, monkeypatch):
    s, size, r = attention_lm.Settings(classes=5, before=4), 30, np.random.default_rng(3)
    texts = [r.integers(0, 28, n) ** 2 % 29 for n in (1, 2, 9, 40, 200)]
    held = [k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2][0]
    learnt = [k for k in range(99) if zlib.crc32(str(k).encode()) % 7 != 2][:len(texts)]
    rows = [(k, bytearray(x.astype("<u2").tobytes())) for k, x in zip([*learnt, held], [*texts, np.arange(30)])]
    cells, whole = [], attention_lm._summed
    monkeypatch.setattr(attention_lm, "_summed", lambda rows, size, n, keys: cells.append(n) or whole(rows, size, n, keys))
    got, prior = attention_lm.learn_vocabulary(spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3), size, s)
    # The last pass counts what follows the ids that are not frequent, and no link a second time.
    assert cells == [size, 2 * s.before * size, s.classes * size + got.inputs * s.classes]
    follow, classes = {}, np.zeros((got.inputs, s.classes))
    for x in texts:
        for before, k in zip([None, *x], x):
            link, row = (0, 0) if before is None else (got.link[before], got.row[before])
            follow[link, k] = follow.get((link, k), 0) + 1
            classes[row, got.cls[k]] += 1
    assert {(a, b): n for a, b, n in zip(*got.after)} == follow
    overall = classes.sum(0) + 0.1
    classes += 0.1 + got.BACK * overall / overall.sum()
    assert prior == pytest.approx(np.log(classes / classes.sum(1, keepdims=True)), abs=1e-5)


def test_packing_words_are_learnt_once(monkeypatch):
    encoder, asked = packing.Encoder(packing.default_tokenizer()), []
    whole = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.extend(texts) or whole(texts))
    texts = [" ".join(f"{a}{b}{marks}" for a in "abcdef" for b in "xyz") for marks in ("***", ".", "%%%", "!?")]
    texts += ["it's* x'd... 's, é. é's%% a1b2* ﬁx, a≮ ≮. Σ. <b a=b> foo@bar.com ***", None, "", "a <|endoftext|> b."]
    found = encoder.encoded_all(texts)
    assert len(asked) < 40  # marks behind a word cost one piece, not one for each word
    assert found == [whole([t or ""])[0] for t in texts]
    asked.clear()
    assert encoder.encoded_all(texts[:-1]) == found[:-1] and not asked


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = table(spark, "documents").where("doc_id < 200").repartition(5)
    pieces = rows(packing.pack(docs))
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rows(packing.op5_packing(docs))}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert crc.get((p["doc_id"], p["start"]), zlib.crc32(p["ids"])) == zlib.crc32(p["ids"]) and p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in mine) == ids.tobytes() and {p["doc_tokens"] for p in mine} == {len(ids)}
    for s, found in by_sequence.items():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 4096 or (at < 4096 and s == max(by_sequence))
    assert {p["doc_id"] for p in rows(packing.pack(odd))} == {r[0] for r in ODD}
    assert rows(packing.pack(none)) == []


def test_license_scan_against_brute_force(spark, odd, none):
    docs = table(spark, "documents")
    extra = spark.createDataFrame([
        (9001, "All rights reserved, all RIGHTS reserved. cc by-nc cc"), (9002, "Released under the MIT License."),
        (9003, "the mit is a place; license needed"), (9004, "GNU General Public License, version 3 all rights"), (9005, None)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r for r in rows(license_scan.op6_license_scan(docs))}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        starts, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            parts = phrase.split()
            found = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
            starts += found
            labels |= {label} if found else set()
        mine = got[r["doc_id"]]
        assert (mine["n_words"], mine["n_base"], mine["first_word"], mine["last_word"], mine["base_labels"]) == (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(mine["labels"].split(",")) and 0 <= mine["score"] <= 1
    assert got[9002]["labels"] == "mit" and got[9003]["labels"] == "" and "gpl" in got[9004]["labels"] and got[9001]["n_base"] == 3
    assert len(rows(license_scan.op6_license_scan(odd))) == len(ODD)
    assert rows(license_scan.op6_license_scan(none)) == []


def test_license_notices_without_the_rarest_word(spark):
    notices = ["licensed under the MIT License", "licensed under CC BY-NC", "licensed under CC BY-NC 3.0"]
    extra = spark.createDataFrame([(9101 + i, t) for i, t in enumerate(notices)], "doc_id long, text string")
    docs = table(spark, "documents").select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.op6_license_scan(docs).where("doc_id > 9100").collect()}
    assert "mit" in got[9101] and "cc-by-nc" in got[9102] and "cc-by-nc" in got[9103]


RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"


def test_revisits(spark):
    records = [
        (1, "http://www.a.example/x?utm_source=q", 10, "response", 'W/"t"', "m1", {"Content-Length": "9", "Date": "d1"}),
        (2, "https://A.example/x#top", 20, "revisit", '"t"', "m2", {"content-length": "0", "date": "d2", "X": "y"}),
        (3, "http://a.example/x", 30, "response", '"u"', None, None),
        (4, "http://a.example/x", 40, "revisit", '"t"', None, None),
        (5, "http://a.example/x", 5, "revisit", '"t"', None, None),
        (6, "http://a.example/x", 41, "revisit", None, None, None),
        (7, None, 41, "revisit", None, None, None),
    ]
    got = {r["record_id"]: r for r in rows(revisit.resolve(spark.createDataFrame(records, RECORDS)))}
    assert {i: r["status"] for i, r in got.items()} == {
        2: "resolved", 4: "validator_mismatch", 5: "no_response", 6: "unverified", 7: "no_response"}
    nowhere = [(1, None, 10, "response", '"t"', None, None), (2, None, 20, "revisit", '"t"', None, None), (3, None, None, "revisit", None, None, None)]
    assert {r["record_id"]: (r["status"], r["refers_to"]) for r in rows(revisit.resolve(spark.createDataFrame(nowhere, RECORDS)))} == {
        2: ("no_response", None), 3: ("no_response", None)}
    assert got[2]["refers_to"] == 1 and got[2]["headers"] == {"Content-Length": "9", "date": "d2", "X": "y"}
    assert rows(revisit.resolve(spark.createDataFrame([], RECORDS))) == []


def test_revisits_of_a_hot_url_over_many_partitions(spark):
    records = [(i, "http://hot.example/", i, "response" if i % 50 == 0 else "revisit", None, "m", None) for i in range(1, 2000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rows(revisit.resolve(spark.createDataFrame(records, RECORDS)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(r["refers_to"] == (r["record_id"] // 50 * 50 or None) for r in got) and len(got) == 1999 - 39


def test_nearest_recall_and_scores(spark):
    vectors = table(spark, "embeddings")
    known = {r["vec_id"]: r["embedding"] for r in vectors.collect() if r["embedding"] and None not in r["embedding"]}
    ids, x = np.array(list(known)), np.array(list(known.values()), float)
    found = {}
    for r in rows(ann.op9_nearest(vectors)):
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, mine in found.items():
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(float(np.dot(known[q], known[r["vec_id"]])), abs=1e-12) for r in mine)
        near = x @ np.array(known[q], float)
        near[ids == q] = -9
        hits += len({r["vec_id"] for r in mine} & set(ids[np.argsort(-near)[:20]].tolist()))
        total += 20
    assert len(found) == len([i for i in known if i % 20 == 0]) and hits / total >= 0.9


def test_nearest_on_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (2, [2.0, 0.0], 2), (20, [0.0, 1.0], 1)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(ann.op9_nearest(spark.createDataFrame(data, kind)).orderBy("query_id", "rank"))]
    # Id 20 lies at a right angle to the query, id 8 has no query of its dimension.
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert rows(ann.op9_nearest(spark.createDataFrame([], kind))) == []


def brute_nearest(data, every, k=20):
    """{query: [(score, vec_id), ...]} by multiplying everything, best score per id."""
    out = {}
    for q, x in data:
        if q % every == 0:
            best = {}
            for v, y in data:
                if v != q and len(y) == len(x):
                    best[v] = max(best.get(v, -1e300), float((np.array(x) * np.array(y)).sum()))
            out[q] = sorted(((-score, v) for v, score in best.items()))[:k]
    return out


@pytest.mark.parametrize("dim, even", [(64, True), (64, False), (128, True), (384, True), (384, False)])
def test_nearest_recall_by_dimension(spark, dim, even):
    """Random vectors, which have no near neighbours to speak of: the hardest case for a hash."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(2500, dim))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if even else x * rng.uniform(0.5, 2, (len(x), 1))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = rows(ann.nearest(frame, frame.where("vec_id % 50 = 0")))
    near = {q: set(np.argsort(-np.where(np.arange(len(x)) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in range(0, len(x), 50)}
    assert len(got) == 20 * len(near)
    recall = sum(r["vec_id"] in near[r["query_id"]] for r in got) / len(got)
    print(f"dimension {dim}, even {even}: recall {recall:.3f}")
    assert recall >= 0.9


def test_nearest_repeated_ids_dimensions_and_hot_vectors(spark):
    """A third of all rows are one vector; ids recur with other vectors; two dimensions; clashing columns."""
    rng = np.random.default_rng(5)
    data = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)] + [(i, rng.normal(size=4).tolist()) for i in range(300, 700)]
    data += [(i, rng.normal(size=3).tolist()) for i in range(700, 900)] + [(i, rng.normal(size=4).tolist()) for i in range(301, 360)]
    kind = "vec_id long, embedding array<double>, score string, query_id int, rank int"
    frame = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in data], kind).repartition(4)
    got = {}
    for r in rows(ann.nearest(frame, frame.where("vec_id % 100 = 0"), settings=ann.Settings(block=4, rows=64, pairs=1000))):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    near = brute_nearest([(i, v) for i, v in data], 100)
    # At four dimensions every axis is probed, so the answer is exact.
    assert got.keys() == near.keys() == {0, 100, 200, 300, 400, 500, 600, 700, 800}
    for q, mine in got.items():
        assert [v for _, v in sorted(mine)] == [v for _, v in near[q]]


def brute_hits(text, items):
    words, hit, found = plain_words(text), set(), set()
    for i, t in items:
        item = plain_words(t)
        size = min(10, len(item))
        grams = {tuple(item[k:k + size]) for k in range(len(item) - size + 1)} if item else set()
        for at in range(len(words) - size + 1) if grams else ():
            if tuple(words[at:at + size]) in grams:
                hit.update(range(at, at + size))
                found.add(i)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("block_chars", [16_000_000, 900])
def test_decontamination_against_brute_force(spark, odd, none, block_chars):
    docs = table(spark, "documents").where("doc_id < 250").select("doc_id", "text")
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    planted = " ".join(items[3][1].split()[2:12])
    items += [(900, "of the"), (901, None), (902, ""), (903, "One"), (904, planted), (905, "a b a b a b a b a b a b a b")]
    extra = [(9000, f"x {planted} y"), (9001, "a b " * 40), (9002, " ".join(planted.split()[:9])), (9003, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in rows(winnow.decontaminate(docs, bench, block_chars=block_chars)):
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute_hits(r["text"], items), r["doc_id"]
        assert r["contaminated"] == (r["n_hit"] > 0)
    assert len(rows(winnow.op10_decontaminate(odd, bench))) == len(ODD)
    assert rows(winnow.op10_decontaminate(none, bench)) == []
    nameless = spark.createDataFrame([(None, planted)], "item_id long, text string")
    hit = {r["doc_id"]: r for r in rows(winnow.decontaminate(docs.where("doc_id >= 9000").withColumn("N_hit", F.lit(7)), nameless, block_chars=block_chars))}
    assert hit[9000]["contaminated"] and hit[9000]["n_hit"] == 10 and hit[9000]["n_items"] == 0
    assert hit[9000]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not hit[9001]["contaminated"]
    assert not any(r["contaminated"] for r in rows(winnow.op10_decontaminate(odd, bench.where("item_id < 0"))))


def test_pipeline_keeps_what_each_stage_keeps(spark):
    import corpus_pipeline
    packed = rows(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))
    assert len({r["doc_id"] for r in packed}) > 100
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline
    docs = odd.drop("score").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == corpus_pipeline.COLUMNS
    kept = rows(corpus_pipeline.near_duplicate_stage(spark, docs, ""))
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "4", "5", "6", "None"]


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_sample_is_bounded_by_rows(spark, label):
    from prismdex.llm.common import labelled_sample

    docs = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(
        spark.range(2, 60).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias(label))
    found = rows(labelled_sample(docs, labels, label, 5, 0, 10))
    assert len(found) == 10 == len({r["doc_id"] for r in found})
    all_of = rows(labelled_sample(docs, labels, label, 5, 0, 1000))
    assert [r["label"] for r in all_of if r["doc_id"] == 1] == [1] and len(all_of) == len({r["doc_id"] for r in all_of})


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    """Exact copies, repeated rows, and different texts under one id, against the groups of equal fingerprints."""
    import corpus_pipeline
    words = [f"word{i}" for i in range(120)]
    a, b, c = " ".join(words[:40]), " ".join(words[40:80]), " ".join(words[80:])
    texts = [(7, a), (3, a), (5, b), (5, b), (5, c), (9, c), (5, a), (None, a), (None, None), (4, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in rows(corpus_pipeline.near_duplicate_stage(spark, docs.repartition(3), "")))
    assert kept == sorted([("3", a), ("5", b), ("5", c), ("None", a), ("None", ""), ("2", "")])


def test_workers_keep_what_one_operator_learnt(spark):
    """Workers outlive an operator: what packing's texts taught is gone when the worker scores quality."""

    def run(batches):
        import gc
        import weakref

        from prismdex.llm import packing, quality

        for _ in batches:
            encoder = packing.encoder_of(packing.default_tokenizer(), 5)
            same = packing.encoder_of(packing.default_tokenizer(), 5) is encoder
            seen = weakref.ref(encoder)
            del encoder
            hasher = common.kept_in_worker(quality.Hasher, 18)
            gc.collect()
            yield pd.DataFrame({"same": [same], "gone": [seen() is None], "kept": [common.kept_in_worker(quality.Hasher, 18) is hasher]})

    assert spark.range(1).mapInPandas(run, "same boolean, gone boolean, kept boolean").collect() == [(True, True, True)]


def test_kept_hashes_are_bytes():
    hasher = quality.Hasher(18)
    slots, _ = hasher("Ab ab 12 Ab")
    codes = np.frombuffer(hasher.seen[b"Ab"], ">u8")
    assert codes.tolist() == [xxhash.xxh64_intdigest(b"Ab"), xxhash.xxh64_intdigest(b"Xx", 7)]
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert set(((mixed ^ (mixed >> np.uint64(32))) & np.uint64((1 << 18) - 1)).tolist()) <= set(slots.tolist())
