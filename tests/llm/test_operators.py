"""Operators against brute force on small tables: nulls, empty, long and repeated texts, clashing columns, empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cellframe.llm import ann, bpe, chat, decontaminate, html_tree, langid, minhash, pii, substring_dedup, toxicity

LONG = " ".join(f"w{k % 700}x{k // 700}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
NEAR = [f"near{k}" for k in range(200)]


def texts():
    changed = [*NEAR[:100], "changed", *NEAR[101:]]
    far = [*NEAR[:60], *(f"other{k}" for k in range(140))]
    return [
        (1, " ".join(NEAR)),
        (2, " ".join(NEAR)),
        (3, " ".join(changed)),
        (4, " ".join(far)),
        (5, f"before {PASSAGE} after"),
        (6, f"elsewhere this {PASSAGE}\nand more"),
        (7, None),
        (8, ""),
        (9, " \n\t "),
        (10, "one two"),
        (11, "one two"),
        (12, LONG),
        (12, LONG),
        (None, "no id here"),
        (13, "!!! 123 ???"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if t and t[0].isalpha() else None, "src", len(t or ""), 1, "x") for d, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, key string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -1")


def test_substring_dedup(docs, none):
    want, seen = [], set()
    for d, t in sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0)):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone[k : k + 20] |= key in seen
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substring_dedup.removed_digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.removed_digests(none).count() == 0


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.n_members): r.class_id for r in minhash.near_duplicates(docs).collect()}
    classes = {d: c for (d, _), c in got.items()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10, 12: 12, 13: 13, None: None}
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9, 10, 12, 13]
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_send_row_numbers_as_bits(spark, monkeypatch):
    docs, sent, send = spark.range(6400).selectExpr("id AS doc_id", "'the same words in every row' AS text"), [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or send(df))
    got = minhash.near_duplicates(docs).groupBy("class_id", "n_members").count().collect()
    assert [tuple(r) for r in got] == [(0, 6400, 6400)]
    assert [r.doc_id for r in minhash.deduplicated(docs).collect()] == [0]
    # row numbers by class are dealt, however small their files are
    assert "BroadcastHashJoin" not in minhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    # at most a word for 64 rows, and one more in each partition
    assert sent and max(sent) <= 6400 // 64 + docs.rdd.getNumPartitions()


@pytest.mark.parametrize("words", [0, 100])
def test_near_duplicates_without_places_sent(docs, monkeypatch, words):
    monkeypatch.setattr(minhash, "MAX_WORDS", words)
    monkeypatch.setattr(minhash, "MAX_PLACES", 0)
    classes = {r.doc_id: (r.class_id, r.n_members) for r in minhash.near_duplicates(docs).collect()}
    more = {1: (1, 3), 2: (1, 3), 3: (1, 3), 5: (5, 2), 6: (5, 2), 10: (10, 2), 11: (10, 2), 12: (12, 2)}
    assert classes == {d: (d, 1) for d in (4, 7, 8, 9, 13, None)} | more
    assert sorted(r.doc_id or 0 for r in minhash.deduplicated(docs).collect()) == [0, 1, 4, 5, 7, 8, 9, 10, 12, 13]


def test_rows_among_row_numbers(spark, monkeypatch):
    numbers = [0, 5, 62, 63, 64, 127, 128, 200, (1 << 33) + 63, (3 << 33) + 64]
    rows = spark.createDataFrame([(k, f"row {k}") for k in numbers], "rid long, text string")
    ids = spark.createDataFrame([(k,) for k in (5, 63, 63, 128, (1 << 33) + 63, 7)], "rid long")
    for words in (100, 0):
        monkeypatch.setattr(minhash, "MAX_WORDS", words)
        there, gone = minhash._among(rows, ids), minhash._among(rows, ids, there=False)
        assert there.columns == gone.columns == rows.columns
        assert sorted(r.rid for r in there.collect()) == [5, 63, 128, (1 << 33) + 63]
        assert sorted(r.rid for r in gone.collect()) == [0, 62, 64, 127, 200, (3 << 33) + 64]
        assert minhash._among(rows, ids.limit(0)).count() == 0
        assert minhash._among(rows, ids.limit(0), there=False).count() == len(numbers)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    cells, doc = np.r_[a, b], np.repeat([0, 1], 300)
    sig = minhash.signatures(cells, doc, 2, np.array([300, 300]))
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.25
    again = minhash.signatures(np.r_[b, a], doc, 2, np.array([300, 300]))
    assert (sig[0] == again[1]).all() and (sig[1] == again[0]).all()


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [("a", "x " + " ".join(PASSAGE.split()[10:30])), ("a", None), ("b", "ONE two"), ("c", ""), ("d", "never seen words here")],
        "item_id string, text string",
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs, items).collect()}
    assert got[5] == (62, 20, 1, True) and got[6][1:] == (20, 1, True)
    assert got[10] == got[11] == (2, 2, 1, True)
    assert got[7] == got[8] == (0, 0, 0, False) and got[1][1] == 0 and got[12] == (30_000, 0, 0, False)
    assert len(decontaminate.report(docs, items).collect()) == 15
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == 11
    assert decontaminate.report(none, items).count() == 0
    assert decontaminate.report(docs, items.filter("item_id = 'z'")).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x x beta y gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "beta alpha gamma")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.proximity(docs, items, 3, 10).collect()] in ([(1, "i", 6)], [(1, "i", 4)], [(1, "i", 2)])


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out[kind].append(m.span())
    return out


def test_personal_data_matches_the_grammars(docs, none):
    rng = np.random.default_rng(3)
    pieces = ["1", "2", "25", "0", "9", ".", ".", "-", " ", "+", "@", "a", "b.", "(", ")", "4111 1111 1111 1111", "é"]
    finder = pii.Finder()
    for _ in range(5000):
        text = "".join(rng.choice(pieces, rng.integers(0, 25)))
        found = finder.spans(text)
        assert {k: found[k] for k in PATTERNS} == base_spans(text), text
    assert finder.spans("mail joe (at) host (dot) org, http://u:pw12@h/ IBAN DE89 3704 0044 0532 0130 00 password=hunter22")["iban"]
    assert finder.spans("9" * 200_000)["card"] == []
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert rows[7].spans == "" and rows[7].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(none).count() == 0


def test_masking_keeps_the_rest(spark):
    df = spark.createDataFrame([("write to a@b.cd now",), (None,), ("clean",)], "text string")
    assert [r[0] for r in df.select(pii.mask(F.col("text"))).collect()] == ["write to <EMAIL> now", None, "clean"]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### x </turn> \\"), (1, None, "system", None), (None, 0, "assistant", "a"), (2, 0, "a:\nb", "c"), (1, 1, "assistant", "### x </turn> \\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(df)).collect()}
    said = "system\n\nuser\nhi\n" + 2 * "assistant\n### x </turn> \\\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 30 and got[None].n_turns == 1
    assert got[2].turns_sha256 == hashlib.sha256(b"a:\nb\nc\n").hexdigest()
    assert chat.digests(chat.render(df.filter("conv_id = 9"))).count() == 0


@pytest.mark.parametrize("bad", ["{{ a.b() }}", "{% for x in range(9) %}{% endfor %}", "{% if a %}", "{{ a | exec }}", "{{ 'x' * 9 }}", "{% import os %}"])
def test_templates_outside_the_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_templates_fold_and_render():
    t = chat.Template("{% if 1 == 1 %}a{{ 'b' + 'c' }}{% endif %}{% for m in messages %}{% if loop.first %}<s>{% endif %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% endfor %}")
    assert t.tree[1] == ("text", "abc") and not t.by_turn
    out = t.render([{"role": "user", "text": " x "}, {"role": "user", "text": "yy"}])
    assert out.text == "abc<s>xyy" and out.spans == [(6, 7), (7, 9)]


def test_html(spark):
    pages = [
        (1, "http://a.b/1", "<html><head><title>t</title></head><body><nav>n</nav><article><h1>H &amp; h</h1><p>x <b>y</b>z<p>w<br>v<script>1<2</script></article><aside>s</aside><footer>f</footer></body></html>"),
        (2, None, None),
        (3, "no url", "plain &lt; text"),
        (4, "http://a.b/2", "<main><p>" + "long " * 50_000 + "</p><section class='comments'>c</section><form>q</form></main>"),
        (4, "http://a.b/2", ""),
    ]
    pages += [(100 + k, "http://site.c/", f"<body><div class=x><p>same line</p></div><div class=body><p>own {k}</p></div></body>") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("removed", F.lit(2))
    got = {(r.page_id, r.n_chars): r.text for r in html_tree.extract(df).collect()}
    assert got[(1, 14)] == "H & h\nx yz\nw\nv"
    assert got[(2, 0)] == "" and "plain < text" in got.values() and got[(4, 0)] == ""
    assert ("long " * 50_000).strip() in got.values()
    assert all(f"own {k}" in got.values() for k in range(12))  # the shared branch goes
    assert html_tree.extract(df.filter("page_id < 0")).count() == 0


def test_html_article_in_a_wrapper_with_shared_text(spark):
    def page(k):
        return f"<body><div class=wrap>Skip to content<article><h1>Title {k}</h1><p>own {k}</p></article></div><div class=box>Shared<div class=text>free {k}</div></div></body>"

    pages = [(k, "http://wrapped.d/", page(k)) for k in range(10)]
    got = {r.page_id: r.text for r in html_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nown {k}\nfree {k}" for k in range(10)}


def test_html_words_of_furniture_inside_an_article():
    inside = (
        "<div class='entry-header'><h1>Title</h1></div><h2 id=search-results>Results</h2><p id=ad-hoc-networks>Ad hoc</p><section id=related-work class=search_results>Work</section>"
        "<h3 class=comments>On comments</h3><figure><img src=x><figcaption>Caption</figcaption></figure><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>"
        "<div class='box share'>Share</div><nav>n</nav>"
    )
    want = "Title\nResults\nAd hoc\nWork\nOn comments\nCaption\nso x=1 holds"
    outside = "<div class=related-posts>More</div><p id=search-box>Find</p>"
    assert html_tree.Page(f"<body>{outside}<article class=has-sidebar>{inside}</article>{outside}</body>").text() == want
    assert html_tree.Page(f"<main id=search-page>{inside}</main>").text() == want


def test_language_model_is_a_code(docs, none):
    grams = {lang: Counter(bytes([b]) + b"" for b in text) for lang, text in (("a", b"abab"), ("b", b"bcbc"))}
    counts = {k: dict(v) for k, v in grams.items()}
    for lang, text in (("a", b"ababab" * 4), ("b", b"bcbcbc" * 4)):
        for n in (2, 3):
            for i in range(len(text) - n + 1):
                counts[lang][text[i : i + n]] = counts[lang].get(text[i : i + n], 0) + 1
    model = langid.build(counts)
    p = 2.0 ** -model.cost.reshape(2, -1, model.width)
    unseen = 256 - (model.width - 1)
    assert np.allclose(p[:, :, 1:].sum(2) + unseen * p[:, :, 0], 1, atol=0.05)
    scorer = langid.Scorer(model)
    assert scorer.predict("ababab")[0] == "a" and scorer.predict("cbcbcb")[0] == "b"
    assert scorer.predict(None) == scorer.predict("1 2!") == ("und", 0.0)
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    assert found[7] == found[8] == found[13] == "und" and found[1] == "en"
    kept = langid.identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 12]
    assert langid.train(none) is None and langid.predict(none, None).count() == 0


def test_contexts_of_small_languages_stay(spark):
    rng = np.random.default_rng(5)

    def language(seed, letters):
        words = ["".join(np.random.default_rng([seed, k]).choice(list(letters), 6)) for k in range(60)]
        return lambda n: " ".join(rng.choice(words, n))

    # twelve large languages and a small one of the same letters, with words of their own
    sizes = [40] * 12 + [3]
    speak = [language(k, "abcdefghijklmnopqrstuvwxyz") for k in range(len(sizes))]
    rows = [(100 * k + i, f"l{k:02}", speak[k](400)) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    scorer = langid.Scorer(langid.train(df))
    for k in (0, len(sizes) - 1):  # the code of a language does not depend on the others
        alone = langid.Scorer(langid.train(df.filter(F.col("lang") == f"l{k:02}")))
        text = speak[k](200)
        assert np.isclose(scorer.bits(text)[k], alone.bits(text)[0], rtol=1e-5)
        assert all(scorer.predict(speak[k](3))[0] == f"l{k:02}" for _ in range(20))


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["", "a" * 3000, "ab" * 1500, "é" * 900, "İΣΑΣ it's DON'T 12³ <|endoftext|>hi<|startoftext|>", " \u2003x\u3000", "th" * 2000 + "an" * 900, "😀👍🏽 ñ\n\t", "a" * 70_000 + " b"]
    encoder = bpe.Encoder(bpe.read_definition(path))
    decoder = bpe.Decoder(encoder.vocab, encoder.added, encoder.merges.suffix)
    for text in odd:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want
        pieces = "".join(decoder.feed([i]) for i in want) + decoder.end()  # one id at a time
        assert pieces == library.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode(docs, path).collect()}
    assert got[7].ids == [] and got[10].ids == library.encode("one two", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path, joined=False).collect()}
    assert back[10] == "one two "


def merge_plainly(merges, word, suffix):
    """All symbols at once, the lowest rank first and the leftmost of equal ones: what the transducer must give."""
    rank = {m: k for k, m in reversed(list(enumerate(merges)))}
    symbols = [*word[:-1], word[-1] + suffix] if word else []
    while len(symbols) > 1:
        best, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best == len(rank):
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def test_transducer_against_plain_merging():
    rng = np.random.default_rng(2)
    lists = [([("a", "b"), ("ab", "ab"), ("b", "a"), ("abab", "abab"), ("c", "ab"), ("a", "c</w>")], "</w>")]
    while len(lists) < 40:
        suffix = "</w>" if rng.random() < 0.5 else ""
        known, merges, made = ["a", "b", "c", *([c + suffix for c in "abc"] if suffix else [])], [], set()
        for _ in range(rng.integers(1, 25)):
            x, y = rng.choice(known, 2)
            if (suffix and x.endswith(suffix)) or x + y in made or len(x + y) > 20:
                continue
            merges.append((str(x), str(y)))
            made.add(x + y)
            known.append(x + y)
        lists.append((merges, suffix))
    for merges, suffix in lists:
        table = bpe.MergeList(merges, suffix)
        for _ in range(40):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 200)))
            want = merge_plainly(merges, word, suffix)
            assert list(table.stream(iter(word))) == want and list(table.tokens(word)) == want
        for word in ("a" * 500, "ab" * 300, "abc" * 200):
            assert list(table.stream(word)) == merge_plainly(merges, word, suffix)
    assert list(bpe.MergeList([]).stream("")) == [] and list(bpe.MergeList([]).tokens("")) == []
    with pytest.raises(ValueError):
        bpe.MergeList([("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError):
        bpe.MergeList([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_transducer_emits_before_the_end():
    encoder = bpe.Encoder(bpe.read_definition(public_tokenizers.path("word_bpe_49k.json")))
    read = 0

    def letters():
        nonlocal read
        for c in "theanerinon" * 20_000:
            read += 1
            yield c

    next(iter(encoder.merges.stream(letters())))
    assert read <= 8 * encoder.merges.lookahead + 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_character_as_the_library(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.read_definition(path))
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b" for c in characters[at : at + 256]) for at in range(0, len(characters), 256)]
    texts += [f"{c} x {c}{c}1" for c in characters[: 1 << 12]]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert [t[:40] for t, w in zip(texts, wanted, strict=True) if encoder.encode(t) != w.ids] == []


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[3]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1)).withColumn("score", F.lit("s"))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:20]
        ranks, ids, scores = zip(*sorted(found), strict=True)
        assert list(ranks) == list(range(1, 21)) and q not in ids and np.allclose(scores, s[list(ids)])
        assert [*ids] == sorted(ids, key=lambda i: (-round(s[i], 12), i))
        hits += len(set(want.tolist()) & set(ids))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(df.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    plain = ["river", "stone", "table", "window", "garden", "letter", "summer", "market", "bridge", "paper"]
    bad = ["blorgface", "snagwit", "fribnut"]
    rows, labels = [], []
    for k in range(400):
        words = list(rng.choice(plain, 12))
        toxic = k % 5 == 0
        if toxic:
            words[int(rng.integers(0, 12))] = str(rng.choice(bad))
        rows.append((k, " ".join(words) + f" {k}"))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "you b*lorgface"), (1003, "s n a g w i t"), (1004, "x" * 100_000)], "doc_id long, text string").withColumn("score", F.lit(1))
    marks = spark.createDataFrame([*labels, (1, None), (5000, 1)], "doc_id long, toxic int").withColumn("text", F.lit("no"))
    known = marks.filter("doc_id % 4 != 1").select("doc_id", "toxic")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert np.mean([got[k] == t for k, t in labels if k % 4 == 1]) >= 0.95
    assert got[1000] == got[1001] == got[1004] == 0 and got[1002] == got[1003] == 1
    nothing = toxicity.train(docs, known.filter("doc_id < 0"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_toxicity_of_a_passage_that_recurs(spark):
    rng = np.random.default_rng(8)
    plain = ["river", "stone", "table", "window", "garden", "letter", "summer", "market", "bridge", "paper"]
    bad = "vurkle nabstow grimplod yexfand quosbit tharnip"
    labels = [(k, int(k % 5 == 0)) for k in range(300)]
    rows = [(k, " ".join([*rng.choice(plain, 10), *([bad] if toxic else []), str(k)])) for k, toxic in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 4 != 1], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert got == dict(labels)
    # half of the documents hold one half of the passage each: both halves are evidence
    has = {w: set(range(10 if w < "o" else 5, 20)) for w in bad.split()} | {f"{w}2": set(range(20, 30)) for w in bad.split()}
    chosen = toxicity._witnesses(has)
    assert len(chosen) == 2 and set().union(*(has[w] for w in chosen)) == set(range(5, 30))


def test_toxicity_of_many_letters():
    rng = np.random.default_rng(9)
    letters = [chr(0x4E00 + k) for k in range(900)]
    words = sorted({"".join(rng.choice(letters, 4)) for _ in range(400)})
    weights, bias = toxicity._machine(words[::2], words[1::2], [])
    scorer = toxicity.Scorer(toxicity.Model(0.5, weights, bias))
    assert len({c for u in weights for c in u}) > 2 * toxicity.CODES
    scorer.learn(set(words))
    assert {w: scorer._cache[w] for w in words} == {w: scorer.string(w) for w in words}
    assert max(scorer._cache[w] for w in words if min(w) > chr(0x4E00 + 450)) > toxicity.CUT
