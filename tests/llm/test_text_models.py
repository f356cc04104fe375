import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, licenses, toxicity


def test_license_base_against_a_plain_scan(spark):
    rng = random.Random(5)
    words = ["mit", "MIT", "license", "License,", "apache", "general", "public", "the", "é", "x9", "version", "gnu"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "MIT-License\nmit license"), (203, "z " * 50000 + "MIT License"), (None, "mit license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as labels", "1 as id")).collect()}
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at, labels = [], set()
        for p, label in licenses.BASE.items():
            p = p.split()
            found = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
            at += found
            if found:
                labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_notice_needs_its_key_phrase(spark):
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    rows = [(1, body), (2, body.replace("free of charge", "for a fee")), *((k, "other words here") for k in range(3, 60))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "mit" and got[2] == "" and set(got[k] for k in range(3, 60)) == {""}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_notices_do_not_crowd_each_other_out(spark):
    text = {label: notice for label, notice, _ in licenses.TEMPLATES}
    sets = [["mit", "bsd"], ["bsd", "mit", "gpl"], list(text)]
    text["mit"] = next(t for label, t, _ in licenses.TEMPLATES if label == "mit" and t.startswith("Permission"))
    rows = [(k, "\nand also\n".join(text[label] for label in ls)) for k, ls in enumerate(sets)] + [(k, "other words here") for k in range(10, 60)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(set(ls) <= got[k] for k, ls in enumerate(sets))


def test_license_notice_in_any_share_of_the_rows(spark):
    for label, notice, _ in licenses.TEMPLATES:
        if label in ("bsd", "isc", "mpl", "unlicense", "cc-by", "cc-by-sa", "cc-by-nc"):
            rows = [(k, notice if k % 3 == 0 or label == "bsd" else "other words here") for k in range(30)]
            got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
            assert {r.labels for r in got if rows[r.doc_id][1] == notice} == {label}


def brute_labels(text, index, idf, coverage=0.6, share=0.6, drift=25):
    """Labels and score by comparing every two votes and trying every key phrase at every place."""
    ws = licenses.words_of(text.encode())
    stands = lambda p: any(ws[k : k + len(p)] == p for k in range(len(ws)))
    labels = {label for p, label in index.base if stands(p)}
    score = 0.5 * bool(labels)
    for label, own, keys in index.templates:
        rare = sorted(set(own), key=lambda w: (-idf[w], w))[: max(8, -int(-share * len(set(own)) // 1))]
        votes = sorted((p, k) for p in range(len(ws)) for k in range(len(own)) if ws[p] == own[k] and own[k] in rare)
        sums = []
        for n, (p, k) in enumerate(votes):
            before = [sums[m] for m, (q, j) in enumerate(votes[:n]) if q < p and j < k and abs((p - k) - (q - j)) <= drift]
            sums.append(max(before, default=0.0) + idf[own[k]] / own.count(own[k]))
        best = max(sums, default=0.0) / sum(idf[w] for w in rare)
        if best >= coverage - 1e-12 and any(stands(k) for k in keys):
            labels.add(label)
            score = max(score, min(1.0, best))
    return labels, score


def test_license_labels_against_every_position():
    rng = random.Random(12)
    index = licenses.Index(licenses.TEMPLATES, licenses.BASE)
    idf = {w: 1 + rng.random() * 5 for w in index.vocabulary}
    rare = licenses.rarest_words(index, idf, 0.6)
    some = [w.decode() for w in sorted(index.vocabulary)]
    for _ in range(25):
        ws = []
        for _ in range(2):
            own = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [rng.choice(some)] * rng.randrange(2)
            ws += own[rng.randrange(3) :] + [rng.choice(some) for _ in range(rng.randrange(4))]
        labels, score = brute_labels(" ".join(ws), index, idf)
        _, _, mine, own_score = licenses.scan_words(licenses.words_of(" ".join(ws).encode()), index, idf, rare, 0.6)
        assert set(mine) == labels and abs(own_score - score) < 1e-9


def test_license_shifts_add_up_over_a_notice():
    """Twenty words put in at each of three places."""
    index = licenses.Index(licenses.TEMPLATES, licenses.BASE)
    idf = dict.fromkeys(index.vocabulary, 1.0)
    rare = licenses.rarest_words(index, idf, 0.6)
    own = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd").split()
    # behind its key phrase
    for at in range(8, 18):
        ws = list(own)
        for k in (at, at + 28, at + 56):
            ws[k:k] = ["extra"] * 20
        _, _, labels, score = licenses.scan_words(licenses.words_of(" ".join(ws).encode()), index, idf, rare, 0.6)
        broken = licenses.scan_words(licenses.words_of(" ".join(ws).encode()), index, idf, rare, 0.6, drift=10)[3]
        assert "bsd" in labels and score > 0.95 > 0.9 > broken
    # words in another order don't chain
    assert licenses.best_chain([(10 - k, k, b"w") for k in range(10)], {b"w": 1.0}, 25) == 1.0


def test_license_notices_with_words_put_in(spark):
    """Notices of 20 words or more with 1 to 3 words put in anywhere outside their key phrases are found in 9 of 10 places."""
    rng = random.Random(2)
    rows, want = [], []
    for label, notice, keys in licenses.TEMPLATES:
        own = notice.split()
        if len(own) >= 20:
            for n in (1, 2, 3):
                for _ in range(30):
                    ws = list(own)
                    for _ in range(n):
                        ws.insert(rng.randrange(len(ws)), rng.choice(["really", "any", "such", "new"]))
                    if any(" ".join(k.split()) in " ".join(w.decode() for w in licenses.words_of(" ".join(ws).encode())) for k in keys):
                        want.append((len(rows), label, n))
                        rows.append((len(rows), "some words before " + " ".join(ws) + " and some after"))
    df = spark.createDataFrame(rows * 2 + [(-1, "other words of no notice")] * 300, "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(df).collect()}
    assert got[-1] == {""}
    for n in (1, 2, 3):
        of = [label in got[i] for i, label, m in want if m == n]
        assert len(of) > 200 and sum(of) >= 0.9 * len(of), (n, sum(of), len(of))


def test_language_grams_do_not_depend_on_pieces():
    text = "ab c déf. " * 60000
    whole = language.grams(text, 64)
    assert whole.sum() > len(text) and (language.grams("ab c déf. " * 3, 64) > 0).tolist() == (whole > 0).tolist()
    assert language.grams("123 . !", 64).sum() == 0


def test_language_held_out(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "and", "ing", "tion"], "de": ["der", "ung", "sch", "ein"], "xx": ["ñaz", "río", "que"]}
    rows = [(k, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang) for k in range(300) for lang in [rng.choice(list(stems))]]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 !", None), (None, "the tion and", None), (903, "the and " * 40000, "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as held_out", "2 as t")
    got = {r.doc_id: r for r in language.identify_by_folds(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify_by_folds(empty).count() == 0
    assert [r.lang_pred for r in language.identify_by_folds(df.withColumn("lang", F.lit(None).cast("string"))).take(2)] == ["und"] * 2


def test_toxicity_folds_and_learns(spark):
    assert toxicity.folded("1d10t, ІDІОТ! íd­iot") == " idiot idiot idiot "
    rng = random.Random(4)
    plain = ["alpha", "beta", "gamma", "delta", "omega"] + ["w%s" % (chr(97 + a) * 3) for a in range(26)]
    rows, labels = [], []
    for k in range(600):
        ws = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = k % 5 == 0
        if bad:
            ws[rng.randrange(len(ws))] = rng.choice(["grubber", "GRUBB3R", "grυbber", "snolk" + rng.choice(plain)])
        rows.append((k, " ".join(ws)))
        labels.append((k, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "a grubber"), (1002, "beta " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as t", "3 as predicted")
    out = toxicity.score_by_folds(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")).collect()
    got = {r.doc_id: r for r in out}
    assert all(got[k].predicted == y for k, y in labels)
    assert [got[k].score for k in (1000, 1001, 1002)] == [0, 0, 0] and got[None].predicted == 1
    m = toxicity.Matcher(toxicity.Lexicon({"trash ": 7.0}, ("trash can",)))
    assert m.score("in the trash can") == 0 and m.score("you trash") > 0.3 and m.score("trash can, you trash") > 0.3
    assert toxicity.score_by_folds(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_learns_exceptions(spark):
    """A listed word is excused in the company that it keeps in clean training rows, and only there."""
    rng = random.Random(5)
    plain = ["w%s" % (chr(97 + a) * 3) for a in range(26)]
    rows, labels = [], []
    for k in range(900):
        ws = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = k % 3 == 0
        if bad:
            ws[rng.randrange(len(ws))] = "grubber"
        elif k % 90 == 1:
            at = rng.randrange(len(ws))
            ws[at : at + 1] = ["grubber", "fish"]
        rows.append((k, " ".join(ws)))
        labels.append((k, int(bad)))
    # held-out rows repeat both kinds
    docs = spark.createDataFrame(rows + [(5000, "wqqq grubber fish wrrr"), (5001, "wqqq grubber wrrr"), (5001, "wqqq grubber wrrr")], "doc_id long, text string")
    from tidemark.llm.common import fold

    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), fold(F.col("id"), 4) != 2)
    assert "grubber fish" in lexicon.exceptions and any("grubber".startswith(f.strip()) for f in lexicon.weights)
    got = sorted((r.doc_id, r.predicted) for r in toxicity.scored(docs, lexicon).where("doc_id >= 5000").collect())
    assert got == [(5000, 0), (5001, 1), (5001, 1)]


def test_language_rejects_what_is_far_from_all(spark):
    rng = random.Random(3)
    stems = {"en": ["the", "and", "ing", "tion"], "de": ["der", "ung", "sch", "ein"]}
    rows = [(k, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang) for k in range(300) for lang in [rng.choice(list(stems))]]
    usual = next(t for _, t, lang in rows if lang == "en")
    odd = [(900, "zzyzx qoph wux vyx " * 10, None), (901, usual, None), (901, usual, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.rejected, r.lang_pred) for r in language.identify_by_folds(df).collect()]
    assert [r[1] for r in got if r[0] == 900] == [True] and [r[1:] for r in got if r[0] == 901] == [(False, "en")] * 2
    assert sum(r[1] for r in got if r[0] < 300) <= 9


def test_repeated_rows_have_equal_results(spark):
    df = spark.createDataFrame([(7, "Released under the MIT License. " * 3), (7, "Released under the MIT License. " * 3), (None, None), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan(df).collect()]
    assert len(got) == 4 and len(set(got)) == 2 and sum(r[2] for r in got) == 6


def plain_weigh(text, lexicon):
    """Every entry at every word of the folded text, by slices."""
    ws = toxicity.folded(text).split()
    line = " ".join(ws) + " "
    starts = [0]
    for w in ws[:-1]:
        starts.append(starts[-1] + len(w) + 1)
    best = {s: max((w for f, w in lexicon.weights.items() if line[s : s + len(f)] == f), default=0.0) for s in starts if ws}
    for p in lexicon.exceptions:
        for k, s in enumerate(starts):
            if ws and line[s:].startswith(f"{p} "):
                for t in starts[k : k + len(p.split())]:
                    best[t] = 0.0
    return sum(best.values()), len(ws)


def test_toxicity_matches_equal_slices():
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({"trash ": 5.0, "tras": 2.0, "idiot": 4.0, "scum ": 7.0, "id": 0.5}, ("trash can", "idiot proof"), 0.5, 1.0)
    m = toxicity.Matcher(lexicon)
    words = ["trash", "can", "TR4SH", "trasher", "idiots", "1d1ot", "proof", "scum", "scummy", "good", "-", "", "identity", "an", "ѕсum"]
    for n in range(200):
        text = " ".join(rng.choice(words) for _ in range(n % 20))
        (w, k), (want, words_) = m.weigh(text), plain_weigh(text, lexicon)
        assert abs(w - want) < 1e-9 and (k == words_ or not text.strip(" -"))


def test_toxicity_length_and_exceptions_decide():
    lexicon = toxicity.Lexicon({"trash ": 6.0}, ("trash can",), 0.5, 0.6)
    m = toxicity.Matcher(lexicon)
    at = lambda n: m.score(" ".join(["trash"] + ["word"] * (n - 1)))
    # 6 / sqrt(100) is the cut
    assert at(100) == pytest.approx(0.3) and at(99) > 0.3 > at(101) > 0.0 and at(40_000) < 0.05
    assert m.score("a trash can") == 0.0 and m.score("") == m.score(None) == 0.0 and m.score("trash can trash") > 0.3
    # rows of the training sample: short ones with a match are toxic, long ones aren't
    w, n, y = np.array([4.0] * 8), np.array([10, 20, 30, 40, 900, 1600, 2500, 3600]), np.array([True] * 4 + [False] * 4)
    power, cut = toxicity.best_cut(w, n, y, 1)
    assert ((w / n**power >= cut) == y).all()
    # where length tells nothing, all matches count
    power, cut = toxicity.best_cut(w, n, np.ones(8, bool), 0)
    assert (w / n**power >= cut).all()


def test_one_row_many_times_takes_no_other_languages_place(spark):
    """One document of `en` on thousands of rows; the other languages keep their centroids."""
    rng = random.Random(6)
    letters = {"en": "abcdefgh", "fr": "ijklmnop", "zz": "qrstuvwx"}
    text = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(30))
    rows = [(7, text("en"), "en")] * 5000 + [(100 + n, text(k), k) for n in range(120) for k in letters]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, "doc_id", "text", "lang", sample_rows=120)
    assert set(model.langs) == set(letters)
    # nearest centroid in plain Python
    texts = [text(k) for k in letters for _ in range(5)]
    counts = np.stack([language.grams(t, len(model.idf)) for t in texts])
    lang, _, _ = model.predict(counts)
    v = language.vectors(counts.astype(float), model.idf)
    want = []
    for x in v:
        near = [sum(float(a) * float(b) for a, b in zip(x, c, strict=True)) for c in model.centroids]
        want.append(model.langs[max(range(len(near)), key=lambda k: (near[k], -k))])
    assert list(lang) == want == [k for k in letters for _ in range(5)]
