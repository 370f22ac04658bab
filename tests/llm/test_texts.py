import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amplispark.llm import html_pages, html_text, langid, packing, quality, segmentation, sharding, toxicity

from .conftest import HARD


def packed(rows, docs):
    """Checks the law of packing against the tokenizer itself; returns the share of padding."""
    reference = Tokenizer.from_file(packing.word_bpe())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, text in docs:
        ids = reference.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= packing.WINDOW
    total = sum(r["length"] for r in rows)
    return 1 - total / (packing.WINDOW * len(windows))


def test_packing(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r.asDict() for r in packing.op6_packing(spark, sf).collect()]
    assert packed(rows, docs) < 0.03


def test_packing_odd_texts(spark):
    odd = ["it's you're 'S 'T's", "a<|endoftext|>b <|EndOfText|>", "ét ét", "İx ǅ ẞ", "don't,ok 12,5 x y z", *[t for _, t in HARD]]
    docs = list(enumerate(odd))
    rows = [r.asDict() for r in packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), packing.word_bpe()).collect()]
    packed(rows, docs)


def test_differencing():
    assert sorted(map(sorted, packing.difference([8, 7, 6, 5, 4], 2))) in ([[0, 1], [2, 3, 4]], [[0, 3, 4], [1, 2]], [[0, 2], [1, 3, 4]])
    parts = packing.windows([1500, 1500, 1500, 500, 500, 40], 2048)
    assert sorted(x for p in parts for x in p) == [0, 1, 2, 3, 4, 5] and len(parts) == 3
    assert packing.windows([], 2048) == []


def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.op9_rendezvous_sharding(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def winning(key, weights):
    """The shard with the best bid, each bid written out."""
    unit = lambda k: (int(hashlib.md5(f"{key}|{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return max(range(len(weights)), key=lambda k: (math.log(unit(k)) / weights[k], -k))


def test_shards_against_every_bid(spark, sf):
    for r in sharding.op9_rendezvous_sharding(spark, sf).collect():
        assert (r.shard, r.grown_shard) == (winning(r.doc_id, [1.0] * 16), winning(r.doc_id, [1.0] * 17))
    docs = spark.createDataFrame([(k, "x" * k) for k in range(50)], "doc_id long, text string")
    assert all(r.shard == winning(r.doc_id, [0.5, 3.0, 1.0]) for r in sharding.shard_records(docs, weights=[0.5, 3.0, 1.0]).collect())


def test_slots_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 20)
    docs = [(None, None)] * 30 + [(5, "same")] * 45 + [(5, f"other {k}") for k in range(25)] + [(k, "t") for k in range(40)]
    rows = sharding.shard_records(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert {r.shard for r in rows if r.doc_id is None} == {winning("", [1.0] * 16)}
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_weighted_shards_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 50)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.createDataFrame([(5, "x")] * 30 + [(None, None)], "doc_id long, text string"))
    rows = sharding.shard_records(docs, weights=[1.0, 2.0, 3.0]).collect()
    n = [sum(r.shard == s for r in rows) for s in range(3)]
    assert 1.7 < n[1] / n[0] < 2.4 and 2.5 < n[2] / n[0] < 3.6 and sum(n) == 6031
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in range(3))
    with pytest.raises(ValueError, match="positive"):
        sharding.shard_records(docs, weights=[0.0])


def repeated_words(text):
    w = (text or "").replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)})


def test_repeated_words(spark):
    texts = ["a b c a b c", "a a a a", "a b c d", "x y", "a b c x a b c y a b c", "", None]
    got = quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: repeated_words(t) for i, t in enumerate(texts)}


def test_quality_stage_keeps_columns(spark):
    good = "The cat is on the mat and the dog of the house was there. " * 1 + " ".join(f"word{k} the" for k in range(60))
    docs = spark.createDataFrame([(1, good, 5), (2, "x", 6), (3, None, 7)], "doc_id long, text string, kept int")
    assert [tuple(r) for r in quality.quality_stage(docs).collect()] == [(1, good, 5)]


LANGS = {"en": "the house and the river with stone of wood", "de": "das haus und der fluss mit stein aus holz", "fr": "la maison et le fleuve avec pierre en bois"}


def test_language(spark):
    rng = np.random.default_rng(0)
    rows = [(n, " ".join(rng.choice(LANGS[lang].split(), 12)), lang) for n, lang in enumerate(list(LANGS) * 60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(0, "the stones and rivers"), (1, "häuser und flüsse, das Holz!"), (2, "les maisons avec le bois"), (3, None), (4, "12 ... ²"), (5, ""), (6, "zzz")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "fr", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[6][0] in LANGS
    assert model.of("the").tolist() == model.words.logs[model.words.rows["the"]].tolist() and model.of("holzhaus").any()


def plain_scores(word, counted, langs):
    """A word's score in each language from (lang, word, count) rows, written out."""
    def logs(of):
        keys = {g for _, w, _ in counted for g in of(w)}
        sums = {(lang, g): 0.0 for lang in langs for g in keys}
        for lang, w, n in counted:
            for g in of(w):
                sums[lang, g] += n
        total = {lang: sum(v for (x, _), v in sums.items() if x == lang) for lang in langs}
        return keys, lambda g: [np.log((sums[lang, g] + 0.1) / (total[lang] + 0.1 * len(keys))) for lang in langs]

    keys, of = logs(lambda w: [w])
    if word in keys:
        return of(word)
    for n in range(5, 0, -1):
        cut = lambda w, n=n: list(w) if n == 1 else [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
        keys, of = logs(cut)
        if rows := [of(g) for g in cut(word) if g in keys]:
            return np.mean(rows, axis=0).tolist()
    return [0.0] * len(langs)


def test_language_against_plain_sums(spark):
    docs = [(0, "the the house ends", "en"), (1, "das haus endet das", "de"), (2, "la maison, la fin", "fr"), (3, "The HOUSE again", "en"), (None, "ignored", None)]
    counted = [("en", "the", 3), ("en", "house", 2), ("en", "ends", 1), ("en", "again", 1), ("de", "das", 2), ("de", "haus", 1), ("de", "endet", 1), ("fr", "la", 2), ("fr", "maison", 1), ("fr", "fin", 1)]
    model, langs = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string")), ["de", "en", "fr"]
    for word in ("the", "houses", "endlich", "zz", "q", "fin", "ain"):
        assert np.allclose(model.of(word), plain_scores(word, counted, langs))
    asked = [(k, t) for k, t in enumerate(["the houses again", "haus endlich!", "maisons fin fin", "q", "Das again das", None])] * 2
    for r in langid.identify(spark.createDataFrame(asked, "doc_id int, text string"), model).collect():
        words = re.findall("[a-z]+", (asked[r.doc_id][1] or "").lower())
        sums = np.sum([plain_scores(w, counted, langs) for w in words], axis=0) if words else None
        assert r.lang_pred == (langs[int(np.argmax(sums))] if words else "und")
        if words:
            z = np.exp((sums - sums.max()) / len(words) * min(len(words), 25))
            assert r.score == pytest.approx(z.max() / z.sum())


def test_language_stage(spark):
    docs = [(n, f"{LANGS[lang]} {LANGS[lang]}", lang, n) for n, lang in enumerate(list(LANGS) * 20)]
    odd = [(900, None, "en", 1), (901, "", "en", 2), (902, "12 34", None, 3), (None, LANGS["de"], None, 4)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score int")
    kept = langid.language_stage(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} | {None}
    assert langid.language_stage(df.limit(0)).count() == 0 and langid.language_stage(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    with pytest.raises(ValueError, match="lang"):
        langid.language_stage(df.drop("lang"))


def test_held_out_language(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in langid.op10_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_held_out_toxicity(spark):
    from .conftest import SF

    sf = SF.replace("sf0.001", "sf0.01")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op3_toxicity(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([toxic[r.doc_id] == r.predicted for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def binary(x):
    return toxicity.Rows.of([np.flatnonzero(r) for r in x], np.arange(x.shape[1]))


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)) < 0.3
    y = x[:, 0] & x[:, 1]
    w, b = toxicity.non_negative_pu(binary(x[y][:150]), binary(x[150:]), float(y.mean()))
    assert ((x @ w + b > 0) == y).mean() > 0.97


def test_risk_and_gradient():
    """One step's gradient against differences of the non-negative risk written out on dense rows."""
    rng = np.random.default_rng(2)
    p, u = rng.random((30, 4)) < 0.5, rng.random((50, 4)) < 0.3
    w, b = toxicity.non_negative_pu(binary(p), binary(u), 0.2, steps=3000, decay=0.0)
    loss = lambda t, x, y: np.logaddexp(0, (1 - 2 * y) * (x @ t[:-1] + t[-1])).mean()
    risk = lambda t: 0.2 * loss(t, p, 1) + max(0.0, loss(t, u, 0) - 0.2 * loss(t, p, 0))
    best = np.append(w, b)
    assert all(risk(best) <= risk(best + d) + 1e-3 for d in rng.normal(size=(200, 5)) * 0.3)


def test_words_are_counted_over_all_texts(spark):
    texts = ["Bad words here", "bad, bad day", None, "", "a day here"] * 7
    buckets = np.sort(np.array([toxicity.bucket_of(x) for x in ("bad", "day", "here", "never")]))
    n, got = toxicity.document_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), buckets)
    assert n == len(texts) and got.tolist() == [sum(int(k) in {toxicity.bucket_of(w) for w in toxicity.words_of(t)} for t in texts) for k in buckets]


def test_toxicity_scores_against_the_model(spark):
    """Scores of the query's operator against the classifiers applied to whole texts one by one; positives stay among the unlabelled."""
    docs = [(i, f"plain text number {i} of some length " + ("vile slur here" if i % 5 == 0 else "nice word there")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int"))
    assert {int(b) for b in model.buckets} == {toxicity.bucket_of(x) for x in ("vile", "slur", "here")}
    for r in toxicity.score(df, model).collect():
        words = {toxicity.bucket_of(x) for x in docs[r.doc_id][1].split()}
        z = [sum(w for w, k in zip(ws, model.buckets, strict=True) if int(k) in words) + b for ws, b in zip(model.weights, model.bias, strict=True)]
        assert r.score == pytest.approx(np.mean([1 / (1 + np.exp(-x)) for x in z])) and (r.score >= 0.5) == (r.doc_id % 5 == 0)


def test_pages():
    model = html_text.train(html_pages.labelled_pages())
    wrong = total = 0
    for page in html_pages.labelled_pages(60, seed=77):
        nodes, _ = html_text.parse(page)
        kept = html_text.marginals(nodes, [model.own(f) for f in html_text.features(nodes)], model.pair)
        for n, want, p in zip(nodes, html_text.labels(nodes), kept, strict=True):
            if n.chars:
                total += 1
                wrong += (p >= 0.5) != want
    assert wrong < 0.02 * total
    page = "<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text, here.<p>Second &lt;b&gt; one.<script>var a='</p>'</script></article><footer>&copy; x</footer>"
    assert html_text.main_text(page, model) == "Title & more\nFirst bold text, here.\nSecond <b> one."
    for odd in (None, "", "<", "<p", "</p></div>", "<div>" * 3000, "<!-- x", "plain", "<a href='x\">y</a>", "<script>x"):
        assert isinstance(html_text.main_text(odd, model), str)


def test_unclosed_head_and_controls():
    model = html_text.train(html_pages.labelled_pages())
    body = "<article><h1>Title</h1><p>First text, here.</p><p>Second one.</p></article>"
    want = "Title\nFirst text, here.\nSecond one."
    for head in ("<head><title>x</title>", "<head><meta charset=utf-8><script>a()</script>", "<head><template><p>no</p></template>"):
        for start in ("<body>", ""):
            assert html_text.main_text(f"<html>{head}{start}{body}</html>", model) == want
    own = lambda page: "".join(t for _, _, t in html_text.parse(page)[1]).split()
    assert own("<head><title>x</title> loose <b>text</b>") == ["loose", "text"]
    for tag in ("button", "select", "svg", "object", "video", "math", "canvas", "option"):
        assert html_text.main_text(f"<html><body><{tag}>no{body}</body></html>", model) == want
        assert own(f"<body><{tag}>no<div>no</div></{tag}><p>yes</p>") == ["yes"]
        assert own(f"<body><div><{tag}>no</div><p>yes</p><{tag}><div>no</div></{tag}>") == ["yes"]
    assert own("<body><select><option>no<div>no</div><option>no</select><p>yes") == ["yes"]


def brute_marginals(nodes, own, pair):
    import itertools

    total, on = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        w = np.exp(sum(own[i] * y[i] for i in range(len(nodes))) + sum(pair[y[n.parent]][y[i]] for i, n in enumerate(nodes) if i))
        total += w
        on += w * np.array(y)
    return on / total


def test_messages_are_exact():
    rng = np.random.default_rng(2)
    nodes = [html_text.Node("x", p) for p in (-1, 0, 0, 1, 1, 4, 2, 6)]
    own, pair = rng.normal(size=8).tolist(), rng.normal(size=(2, 2)).tolist()
    assert np.allclose(html_text.marginals(nodes, own, pair), brute_marginals(nodes, own, pair))


def test_pages_of_the_driver(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html_text.op4_html_text(spark, sf).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert all("track(" not in r.text and "©" not in r.text and r.text for r in rows)


@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.Vocabulary(segmentation.piece_bpe())


def enumerated(v, text):
    """ids -> probability of every segmentation."""
    pieces, weights = {p: i for i, p in v.piece_of.items()}, dict(zip(v.ids.tolist(), v.weights.tolist(), strict=True))

    def of(s):
        if not s:
            yield (), 0.0
        for n in range(1, min(v.longest, len(s)) + 1):
            if (i := pieces.get(s[:n])) is not None:
                head, x = (i,), weights[i]
            elif n == 1:
                head = tuple(v.byte_ids[b] for b in s[0].encode())
                x = v.byte_weight * len(head)
            else:
                continue
            for rest, y in of(s[n:]):
                yield head + rest, x + y

    found = dict(of(v.normalize(text)))
    z = np.logaddexp.reduce(list(found.values()))
    return {ids: float(np.exp(x - z)) for ids, x in found.items()}


def test_sampling_law(vocabulary):
    p = enumerated(vocabulary, "a cat\nné")
    rows = defaultdict(list)
    for key, n, ids, logp, inclusion in segmentation.encode_task(iter([(k, "a cat\nné") for k in range(4000)]), vocabulary, 2, 0):
        rows[key].append((tuple(ids.tolist()), logp, inclusion))
    first, second = (defaultdict(int) for _ in range(2))
    for got in rows.values():
        assert len({g[0] for g in got}) == 2 and all(abs(g[1] - np.log(p[g[0]])) < 1e-6 and 0 <= g[2] <= 1 for g in got)
        first[got[0][0]] += 1
        second[got[1][0]] += 1
    for ids in sorted(p, key=p.get)[-3:]:
        assert abs(first[ids] / 4000 - p[ids]) < 0.03
        assert abs(second[ids] / 4000 - sum(p[j] * p[ids] / (1 - p[j]) for j in p if j != ids)) < 0.03


def test_the_query_searches_among_regions(spark, tables):
    at = tables(documents=([(1, "a cat\nné"), (2, ""), (3, "some words and more of them")], "doc_id long, text string"))
    got = defaultdict(list)
    for r in segmentation.op8_sampled_segmentation(spark, at).collect():
        got[r.doc_id].append((r.sample, r.ids_crc32, r.text_crc32))
    assert len(got[2]) == 1
    for i in (1, 3):
        assert sorted(x[0] for x in got[i]) == list(range(len(got[i]))) and len(got[i]) > 3
        assert len({x[1] for x in got[i]}) == len(got[i]) and len({x[2] for x in got[i]}) == 1


def test_law_of_further_samples(vocabulary):
    p = enumerated(vocabulary, "a cat")
    seen = [defaultdict(int) for _ in range(4)]
    for key, n, ids, logp, _ in segmentation.encode_task(iter([(k, "a cat") for k in range(6000)]), vocabulary, 4, 0):
        assert abs(logp - np.log(p[tuple(ids.tolist())])) < 1e-6
        seen[n][tuple(ids.tolist())] += 1
    law, drawn = [defaultdict(float) for _ in range(4)], {(): 1.0}
    for n in range(4):  # each further one in proportion to the probabilities of those not drawn
        grown = defaultdict(float)
        for before, x in drawn.items():
            rest = 1 - sum(p[j] for j in before)
            for ids in p.keys() - before:
                law[n][ids] += x * p[ids] / rest
                grown[frozenset([*before, ids])] += x * p[ids] / rest
        drawn = grown
    assert all(abs(seen[n][ids] / 6000 - law[n][ids]) < 0.03 for n in range(4) for ids in p)


def test_draws_do_not_depend_on_the_texts_beside(vocabulary):
    rows = [(k, " ".join(f"w{j % 7} other" for j in range(k % 90))) for k in range(200)]
    tell = lambda found: {(key, n): (ids.tolist(), logp, inclusion) for key, n, ids, logp, inclusion in found}
    whole = tell(segmentation.encode_task(iter(rows), vocabulary, 4, 0))
    alone = {}
    for i in range(0, 200, 40):
        alone |= tell(segmentation.encode_task(iter(rows[i : i + 40][::-1]), vocabulary, 4, 0))
    assert whole.keys() == alone.keys() and all(whole[x] == alone[x] for x in whole)


def test_round_trip(spark, vocabulary):
    docs = [(i, t) for i, (_, t) in enumerate(HARD) if t is not None and len(t) < 5000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sampled = segmentation.sample_segmentations(df, segmentation.piece_bpe(), k=3)
    texts = dict(docs)
    assert all(texts[r.doc_id] == r.text for r in segmentation.decode(sampled, segmentation.piece_bpe()).collect())
    again = segmentation.sample_segmentations(df, segmentation.piece_bpe(), k=3)
    assert sorted(sampled.collect(), key=str) == sorted(again.collect(), key=str)
    assert {r.doc_id: r.inclusion for r in sampled.collect()}[1] == 1.0  # the empty text has one segmentation


@pytest.mark.parametrize("mix", [segmentation.mixed, np.zeros_like])
def test_units_are_exact_even_where_hashes_are_equal(vocabulary, monkeypatch, mix):
    monkeypatch.setattr(segmentation, "mixed", mix)
    rng, split = random.Random(1), re.compile("\n|▁*[^▁\n]+|▁+")
    texts = ["".join(rng.choice(["▁", "\n", "a", "bc", "é", "漢", "▁▁"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "▁", "\n\n"]
    units = segmentation.Units(vocabulary)
    for _ in range(2):  # new units, then known ones
        got, la = units.of(texts), units.lattice
        shown = lambda k: "".join(map(chr, la.codes[la.starts[k] : la.starts[k] + la.left[la.starts[k]]]))
        assert [[shown(k) for k in g] for g in got] == [split.findall(t) for t in texts]


def test_tokenizers_that_join_words_are_refused():
    import public_tokenizers

    packing.Words(packing.word_bpe())
    with pytest.raises(ValueError, match="are not those of"):
        packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
