"""Classifiers, language evidence and surrogates: held-out quality, brute-force checks, odd rows."""

import random
import re

import numpy as np
import pytest

from phonoframe.llm import classifier, features, languages, surrogates, toxicity
from phonoframe.llm import words as WD

UTTERANCES = "utterance_id bigint, transcript string, score string, label int, mark string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "m") for i, t in rows], UTTERANCES)


# -- features --------------------------------------------------------------------------


def test_features_are_distinct_and_normalised():
    row, place, value = features.features([b"", b"One two one two", b"x"], 16)
    assert set(row.tolist()) == {1, 2}
    assert np.allclose(np.bincount(row, weights=value * value), [0, 1, 1])
    assert len({(r, p) for r, p in zip(row, place)}) == len(row)
    shapes = features.shapes(WD.find([b"ab12 cde345 ab 1a"], WD.BLANK))
    assert shapes[0] == shapes[1] and len(set(shapes.tolist())) == 3


def test_ftrl_learns_a_separable_problem_sparsely():
    rng = np.random.default_rng(0)
    examples, labels = [], []
    for _ in range(600):
        y = rng.integers(0, 2)
        examples.append((np.unique(np.append(rng.integers(10, 500, 8), 1 if y else 2)), None))
        labels.append(y)
    examples = [(p, np.ones(len(p))) for p, _ in examples]
    w = features.train(examples, np.array(labels, float), np.arange(500), 500, 3, alpha=0.5, l1=1.0)
    p = [features.sigmoid(w[e[0]].sum()) for e in examples[500:]]
    assert np.mean((np.array(p) > 0.5) == np.array(labels[500:])) > 0.97 and (w == 0).mean() > 0.3


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.3
        words = [f"w{rng.randrange(400)}" + ("###" if bad and rng.random() < 0.5 else "") for _ in range(40)]
        if toxic:
            words.insert(rng.randrange(40), rng.choice(["idiot", "scum", "böse", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = corpus(random.Random(4), 700)
    odd = [(900, None), (901, ""), (None, "w1 w2"), (0, rows[0][1])]
    marks = labels[:500] + [(None, 1, 1), (600, None, None), (0, 1, labels[0][2]), (9999, 1, 1)]
    return (frame(spark, rows + odd),
            spark.createDataFrame(marks, "utterance_id bigint, label int, toxic int"), labels[500:])


def test_quality_is_learnt_for_held_out_rows(spark, labelled):
    docs, labels, held = labelled
    found = classifier.score_quality(docs, classifier.train_quality(docs, labels, bits=14)).collect()
    score = {r.utterance_id: r.score for r in found}
    assert len(found) == 704 and all(0 <= r.score <= 1 for r in found) and score[900] == score[901] == 0
    assert np.mean([(score[i] > 0.5) == bool(q) for i, q, _ in held if i != 600]) > 0.95


def test_the_sample_is_bounded_and_the_same_each_time(spark, labelled):
    docs, labels, _ = labelled
    a = [classifier.labelled_sample(docs, labels, ["label"], 50).toPandas().sort_values("utterance_id") for _ in range(2)]
    assert 45 <= len(a[0]) <= 50 and a[0].equals(a[1].set_index(a[0].index))


def test_the_chain_finds_held_out_toxic_rows(spark, labelled):
    docs, labels, held = labelled
    models = toxicity.train_toxicity(docs, labels, bits=14)
    found = toxicity.score_toxicity(docs, models).collect()
    p = {r.utterance_id: r for r in found}
    assert len(models) == 3 and found[0].__fields__ == ["utterance_id", "insult", "degrading", "toxic"]
    assert p[900].toxic == p[901].insult == 0
    assert np.mean([(p[i].toxic > 0.5) == bool(t) for i, _, t in held]) > 0.95
    # later models see one weight more for each earlier category
    assert [len(m) // 4 - (1 << 14) for m in models] == [1, 2, 3]


def test_models_without_labels_and_empty_tables(spark, labelled):
    docs, labels, _ = labelled
    none = labels.limit(0)
    weights = classifier.train_quality(docs, none, bits=10)
    assert {r.score for r in classifier.score_quality(docs, weights).collect()} == {0.0, 0.5}
    assert classifier.score_quality(docs.limit(0), weights).collect() == []
    models = toxicity.train_toxicity(docs, none, bits=10)
    assert {r.toxic for r in toxicity.score_toxicity(docs, models).collect()} == {0.0, 0.5}


# -- languages -------------------------------------------------------------------------


def test_markup_and_addresses(spark):
    html = "<!DOCTYPE html><HTML dir=ltr lang='fr-CA'><script>var a='<p>no</p>'</script><p>Bon&eacute; <!-- x -->jour</p>"
    df = spark.createDataFrame([(html, "https://u:p@www.A.example.co:8080/x?y"), ("plain", "nothing"), (None, None)], "h string, u string")
    got = df.select(languages.visible_text(df.h), languages.declared_language(df.h), languages.host_of(df.u)).collect()
    assert got[0][0].split() == ["Bon", "jour"] and got[0][1:] == ("fr", "www.a.example.co")
    assert tuple(got[1]) == ("plain", None, None) and tuple(got[2]) == (None, None, None)


def test_evidence_is_fused(spark):
    rng = random.Random(1)
    alphabet = {"aa": "abcde", "bb": "vwxyz"}
    say = lambda lang, n: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(5)) for _ in range(n))
    samples = spark.createDataFrame([(say(k, 30), k) for k in ("aa", "bb") for _ in range(20)] + [(None, "aa"), ("x", None)],
                                    "text string, lang string")
    model = languages.train_languages(samples)
    assert sorted(model) == ["aa", "bb"]
    rows = [(k, say("bb", 30), "bb", "b.site.org", "keep") for k in range(60)] + [(100 + k, say("aa", 30), "aa", "a.site.com", "keep") for k in range(60)]
    rows += [(200, "", None, "b.site.org", "k"), (201, None, "aa", None, "k"), (202, "", "zz", "a.site.com", "k"),
             (203, None, None, "new.site.org", "k"), (204, say("aa", 50), "bb", "b.site.org", "k"), (204, say("aa", 50), "bb", "b.site.org", "k")]
    df = spark.createDataFrame(rows, "page_id int, text string, declared string, host string, lang string")
    found = languages.identify_languages(df, model).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(rows) and sorted(found[0].__fields__) == ["declared", "lang", "page_id", "posterior", "text_lang"]
    assert all(by[k].lang == "bb" and by[100 + k].lang == "aa" for k in range(60))
    assert [by[k].lang for k in (200, 201, 202, 203, 204)] == ["bb", "aa", "aa", "bb", "aa"]
    assert by[200].posterior < by[0].posterior
    assert languages.identify_languages(df.limit(0), model).collect() == []
    assert [r.lang for r in languages.identify_languages(df.limit(2), {}).collect()] == [None, None]


# -- surrogates ------------------------------------------------------------------------

KEY = b"test key"


def test_permutations_are_bijections():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(surrogates.permute(KEY, "t", x, size) for x in range(size)) == list(range(size))


def test_surrogates_keep_type_format_and_coreference(spark):
    text = ("Mail Ann.5@Mail3.example.com, ann.5@mail3.example.com or joe@mail3.example.com. Card 4111 1111 1111 1111 or "
            "4111-1111-1111-1111, not 1234567812345678. Call +44 (377) 555-0271. Host 10.20.30.40, not 300.1.1.1. "
            "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Anna Schmidt saw Иван Петров, Anna Schmidt left.")
    found = surrogates.replace_entities(frame(spark, [(1, text), (2, text), (3, None), (4, ""), (None, "no data")]), KEY).collect()
    out = {r.utterance_id: r for r in found}
    assert out[1].transcript == out[2].transcript and out[3].transcript is None and out[4].transcript == ""
    assert out[None].transcript == "no data" and out[None].entities == []
    kinds = [e.kind for e in out[1].entities]
    assert kinds == ["email"] * 3 + ["card"] * 2 + ["phone", "ip", "secret", "person", "person", "person"]
    s = [e.surrogate for e in out[1].entities]
    assert s[0].lower() == s[1] and s[1] != s[2] and s[1].split("@")[1] == s[2].split("@")[1] and s[1].endswith(".com")
    assert s[3].replace(" ", "-") == s[4] and surrogates.luhn_digit(re.sub(r"\D", "", s[3])[:-1]) == s[3][-1]
    assert re.fullmatch(r"\+44 \(\d{3}\) \d{3}-\d{4}", s[5]) and re.fullmatch(r"[0-9a-f]{40}", s[7])
    assert s[8] == s[10] and s[8].split()[0] in surrogates.GIVEN_NAMES["latin", "f"]
    assert s[9].split()[0] in surrogates.GIVEN_NAMES["cyrillic", "m"]
    for e in out[1].entities:
        assert text[e.start:e.end] not in out[1].transcript
    assert "1234567812345678" in out[1].transcript and "300.1.1.1" in out[1].transcript
    at, plain = 0, []
    for e in out[1].entities:
        plain += [text[at:e.start], e.surrogate]
        at = e.end
    assert "".join([*plain, text[at:]]) == out[1].transcript
    assert surrogates.replace_entities(frame(spark, []), KEY).collect() == []


@pytest.mark.parametrize("text, wanted", [
    ("4111111111111111 12/27", [("card", "4111111111111111")]),
    ("4111 1111 1111 1111 123", [("card", "4111 1111 1111 1111")]),
    ("4111-1111-1111-1111-123", [("card", "4111-1111-1111-1111")]),
    ("12 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
    ("123-45-6789 2024-01-15", [("national_id", "123-45-6789")]),
    ("555-123-4567 2024-01-15", [("phone", "555-123-4567")]),
    ("555-123-4567 12345", [("phone", "555-123-4567")]),
    ("123-45-6789 123-45-6780", [("national_id", "123-45-6789"), ("national_id", "123-45-6780")]),
    ("4111 1111 1111 1112.bob@x.com", [("email", "1112.bob@x.com")]),
    ("1234567812345678 1", []),
])
def test_entities_before_other_numbers_are_found(text, wanted):
    for before, after in (("", ""), ("Pay ", ", today")):
        whole = before + text + after
        assert [(e[0], whole[e[1]:e[2]]) for e in surrogates.find_entities(whole)] == wanted


def test_mixed_case_addresses_keep_all_letters_of_longer_surrogates():
    for attempt in range(8):
        new = surrogates.surrogate(KEY, "email", "jo@mail.com", attempt)
        assert surrogates.dressed("email", "Jo@Mail.com", new).lower() == new


def test_collisions_are_redrawn(spark):
    # all mail addresses of one letter at two domains that are each other's likely images
    here, there = "a.com", surrogates.surrogate(KEY, "email", "x@a.com").split("@")[1]
    rows = [("email", f"{c}@{d}") for c in "abcdefghijklmnopqrstuvwxyz" for d in (here, there)]
    rows += [("national_id", f"{k:09d}") for k in range(40)] + [("person:latin:f", f"Anna A{k}") for k in range(300)]
    rows += [("phone", surrogates.surrogate(KEY, "phone", "12345")), ("phone", "12345")]
    entities = spark.createDataFrame(rows, "kind string, canonical string").distinct()
    redrawn = {(r.kind, r.canonical): r.attempt for r in surrogates.redrawn_entities(entities, KEY).collect()}
    final = {}
    for kind, canonical in set(rows):
        s = (kind.split(":")[0], surrogates.surrogate(KEY, kind, canonical, redrawn.get((kind, canonical), 0)))
        assert s not in final and s not in {(k.split(":")[0], c) for k, c in rows}
        final[s] = canonical
    assert ("phone", "12345") in redrawn and ("email", "q@a.com") in redrawn
