import zlib
from itertools import product

import numpy as np

from lexistrata.llm import langid
from lexistrata.llm.langid import identify_languages, keep_identified, posteriors, train, train_languages, word_languages
from lexistrata.llm.queries import op4_language_id

D = "/root/testdata/sf0.01"


def plain(em, tr):
    k = em.shape[1]
    e, t = np.exp(em - em.max(1, keepdims=True)), np.exp(tr - tr.max())
    ahead, v = [], None
    for row in e:
        v = row if v is None else (v @ t) * row
        v /= v.sum()
        ahead.append(v)
    out, b = np.empty_like(em), np.ones(k)
    for i in range(len(em) - 1, -1, -1):
        out[i] = ahead[i] * b / (ahead[i] * b).sum()
        b = t @ (e[i] * b)
        b /= b.sum()
    return out


def test_forward_backward_is_exact_across_blocks():
    rnd = np.random.default_rng(0)
    lengths = np.array([5, 0, langid.BLOCK, langid.BLOCK + 1, 1, 300, 2 * langid.BLOCK, 0])
    em, tr = rnd.standard_normal((lengths.sum(), 4)) * 2, rnd.standard_normal((4, 4))
    got, at = posteriors(em, tr, lengths), 0
    for n in lengths.tolist():
        if n:
            assert np.allclose(got[at : at + n], plain(em[at : at + n], tr))
        at += n
    assert posteriors(np.zeros((0, 4)), tr, np.array([0, 0])).shape == (0, 4)


def log_sum(em, tr, lengths):
    """The logarithm of the sum over all labellings, by enumeration."""
    total, at = 0.0, 0
    for n in lengths.tolist():
        if n:
            scores = [sum(em[at + i, y[i]] for i in range(n)) + sum(tr[a, b] for a, b in zip(y, y[1:], strict=False)) for y in product(range(em.shape[1]), repeat=n)]
            total += np.log(np.sum(np.exp(scores)))
        at += n
    return total


def test_gradient_by_finite_differences():
    """Posteriors and pair sums are the derivatives of the log partition function."""
    rnd = np.random.default_rng(1)
    lengths = np.array([4, 0, 1, 3])
    em, tr = rnd.standard_normal((8, 3)), rnd.standard_normal((3, 3)) * 1.5
    probs, pairs = posteriors(em, tr, lengths, pairs=True)
    step = 1e-5
    for x, grad in ((em, probs), (tr, pairs)):
        for i in np.ndindex(x.shape):
            x[i] += step
            up = log_sum(em, tr, lengths)
            x[i] -= 2 * step
            down = log_sum(em, tr, lengths)
            x[i] += step
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-6
    long = np.array([langid.BLOCK * 2 + 5, 7])
    em = rnd.standard_normal((long.sum(), 3))
    assert np.isclose(posteriors(em, tr, long, pairs=True)[1].sum(), (long - 1).sum())


def test_middle_of_an_unspaced_text_decides():
    """Two texts that differ in the middle only, without a blank, have different features."""
    a, b = "x" * 30 + "abcdefgh" * 600 + "y" * 30, "x" * 30 + "ابتث" * 1200 + "y" * 30
    fa, fb = (langid.features(langid.words_of(t), np.empty(0, np.uint64)) for t in (a, b))
    assert fa[0].tolist() != fb[0].tolist() and len(fa[0]) > len(a) and len(fb[0]) > len(b)


def test_word_accuracy_in_mixed_texts(spark):
    """Stretches of 5 to 25 words of held-out documents, two languages in turn: README gives this figure."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = train_languages(docs)
    held = docs.where("crc32(cast(doc_id as string)) % 3 = 1 and n_chars between 300 and 6000 and text not like '%|%'").select("text", "lang").orderBy("doc_id").collect()
    rnd = np.random.default_rng(2)
    right = total = 0
    for a, b in zip(held, held[1:], strict=False):
        if a.lang == b.lang:
            continue
        words, truth = [], []
        for k in range(6):
            r = (a, b)[k % 2]
            w = r.text.split()
            at, n = rnd.integers(0, max(1, len(w) - 25)), rnd.integers(5, 26)
            words += w[at : at + n]
            truth += [r.lang] * len(w[at : at + n])
        probs, lettered, _ = model.label_words([" ".join(words)])
        got = [model.languages[k] for k in probs.argmax(axis=1)]
        if len(got) == len(truth):
            right += sum(x == y for x, y, s in zip(got, truth, lettered, strict=True) if s)
            total += int(lettered.sum())
    print("word accuracy", right / total, total)
    assert total > 2000 and right / total > 0.9


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    out = op4_language_id(spark, D).collect()
    assert {r.doc_id for r in out} == langs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97


def test_edges_and_switches(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = train_languages(docs)
    en, de = (docs.where(f"lang = '{x}' and n_chars between 800 and 3000 and text not like '%|%'").orderBy("doc_id").first().text for x in ("en", "de"))
    rows = [(1, None), (2, ""), (3, "123 !? 45"), (None, en), (5, de), (5, de), (6, (en + " ") * 300), (7, "x" * 100_000)]
    df = spark.createDataFrame([(t, i, "zz", "clash") for i, t in rows], "text string, doc_id long, lang string, lang_pred string")
    out = [(r.doc_id, r.lang_pred) for r in identify_languages(df, model).collect()]
    assert out[:7] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de"), (5, "de"), (6, "en")] and out[7][1] in model.languages
    kept = keep_identified(df, model, 0.35)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {None, 5, 6}
    assert identify_languages(df.limit(0), model).collect() == []
    mixed = spark.createDataFrame([(1, " ".join(en.split()[:40] + ["12"] + de.split()[:40]))], "doc_id long, text string")
    langs = word_languages(mixed, model).first().langs
    assert langs[40] is None and langs[:40].count("en") > 34 and langs[41:].count("de") > 34
    none = train([], [])
    assert [r.lang_pred for r in identify_languages(df, none).collect()] == ["und"] * 8
    assert {x for r in word_languages(df, none).collect() for x in r.langs} == {None}


def test_every_letter_of_a_run_without_blanks_counts(spark):
    """Texts joined without blanks, or by other signs: what lies between begin and end decides, and counts by its length."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = train_languages(docs)
    en, de = (docs.where(f"lang = '{x}' and n_chars between 800 and 3000 and text not like '%|%'").orderBy("doc_id").first().text.split() for x in ("en", "de"))
    for sign in ("", ",", "/", "_", "\u200b"):
        run = sign.join([*en[:3], *de[:100], *en[3:6]])
        assert model.predict([run])[0] == ["de"]
        assert model.predict([" ".join(en[6:16]) + " " + run])[0] == ["de"]
        assert "".join(langid.words_of(run)) == run
    thai = "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e17\u0e35\u0e48" * 50
    words = langid.words_of(thai)
    slots, counts = langid.features(words, model.lexicon)
    assert "".join(words) == thai and (counts > 0).all() and max(map(len, words)) <= langid.PIECE
    assert langid.words_of("short, words stay-as they're " + "a" * 24) == ["short,", "words", "stay-as", "they're", "a" * 24]


def test_every_language_is_learned(spark):
    """70 languages, each with letters of its own; the rarest are labelled too, and the draw is bounded in total."""
    rnd = np.random.default_rng(3)

    def text(n):
        letters = [chr(0x4E00 + 6 * n + j) for j in range(6)]
        return " ".join("".join(rnd.choice(letters, 4)) for _ in range(30))

    rows = [(1000 * n + i, text(n), f"l{n:02}") for n in range(70) for i in range(12 if n < 64 else 4)]
    model = train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), total=210)
    assert model.languages == [f"l{n:02}" for n in range(70)]
    assert np.mean([a == f"l{n:02}" for n, a in enumerate(model.predict([text(n) for n in range(70)])[0])]) > 0.95


def test_forward_backward_and_sums_of_many_labels(monkeypatch):
    rnd = np.random.default_rng(4)
    lengths = np.array([3, 0, 2 * langid.BLOCK + 7, 1])
    em, tr = rnd.standard_normal((lengths.sum(), 40)) * 2, rnd.standard_normal((40, 40))
    got, at = posteriors(em, tr, lengths), 0
    for n in lengths.tolist():
        if n:
            assert np.allclose(got[at : at + n], plain(em[at : at + n], tr))
        at += n
    weights, counts = rnd.standard_normal((langid.SLOTS, 40)), np.array([0, 5, 0, 2, 9, 0])
    slots = rnd.integers(0, langid.SLOTS, counts.sum())
    whole = langid._sums(weights, slots, counts)
    monkeypatch.setattr(langid, "WORK", 100)
    assert np.allclose(langid._sums(weights, slots, counts), whole)
    assert np.allclose(whole[1], weights[slots[:5]].sum(axis=0)) and not whole[[0, 2, 5]].any()
