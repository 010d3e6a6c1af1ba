"""Tokens, lines, leaks, rules and licenses against brute-force versions."""

import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from phonoframe.llm import leaks, licenses, lines, pieces, rules

MODEL = public_tokenizers.path("piece_bpe_32k.model")
UTTERANCES = "utterance_id bigint, transcript string, n_words string, spans int, mark string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "m") for i, t in rows], UTTERANCES)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- tokens ----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeth  \n.▁é的😀\x00Ω<s>01"), max_size=60), max_size=6))
def test_encoding_equals_the_library(texts):
    model = pieces.pieces(MODEL)
    ids, total = model.encode([t.encode() for t in texts])
    back, at = model.decode(ids, total), 0
    for text, n, decoded in zip(texts, total, back):
        wanted = model.library.encode(text, add_bos=True, add_eos=True)
        assert ids[at:at + n].tolist() == wanted and decoded == model.library.decode(wanted)
        at += n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(3, 258), max_size=12))
def test_decoding_of_any_ids_equals_the_library(ids):
    model = pieces.pieces(MODEL)
    assert model.decode(np.array(ids, np.int64), np.array([len(ids)])) == [model.library.decode(ids)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "er", "th", "tion", "a", "q", "é", "日", "xx"]), max_size=400), st.integers(1, 3))
def test_words_without_a_break_equal_the_library(parts, rounds):
    model = pieces.pieces(MODEL)
    text = "".join(parts)
    before, pieces.ROUNDS = pieces.ROUNDS, rounds  # words that are left go on alone
    try:
        alone = model.encode([text.encode()])[0].tolist()
    finally:
        pieces.ROUNDS = before
    assert model.encode([text.encode()])[0].tolist() == alone == model.library.encode(text, add_bos=True, add_eos=True)


def test_long_words_take_no_longer_than_prose():
    model = pieces.pieces(MODEL)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    size = 1_000_000
    prose = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(size // 6))[:size]
    words = ["the" * (size // 3), "ing" * (size // 3), "er" * (size // 2), "".join(rng.choice(letters) for _ in range(size))]

    def seconds(text):
        start = time.process_time()
        ids = model.encode([text.encode()])[0]
        took = time.process_time() - start
        assert ids.tolist() == model.library.encode(text, add_bos=True, add_eos=True)
        return took

    usual = seconds(prose)
    assert all(seconds(w) < 2 * usual + 1 for w in words)


def test_texts_with_byte_pieces_are_decoded_whole(monkeypatch):
    model = pieces.pieces(MODEL)
    texts = ["", "\n", " \n a\n\nb\t\x00", "日 😀\n" * 50, "⁇ ▁x\n"]
    wanted = [model.library.decode(model.library.encode(t)) for t in texts]
    monkeypatch.setattr(pieces.Pieces, "_spell", lambda *a: pytest.fail("a valid text is spelled id by id"))
    assert model.decode(*model.encode([t.encode() for t in texts])) == wanted


def test_memory_of_a_slice_is_bounded():
    model = pieces.pieces(MODEL)
    rng = random.Random(2)
    texts = pa.array(["".join(rng.choice("abcdefgh éж日 \n") for _ in range(1000)) for _ in range(4000)])
    tracemalloc.start()
    try:
        for _, part in pieces.slices(texts, pieces.SLICE):
            model.decode(*model.encode(part))
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()


def test_tokens_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "." * 50_000), (3, "." * 50_000), (4, "thé cat " * 20_000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = pieces.encode_transcripts(frame(spark, rows), MODEL).collect()
    assert [r.utterance_id for r in found] == [i for i, _ in rows]
    for r, (_, text) in zip(found, rows):
        wanted = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.tokens, "<u4").tolist() == wanted and r.n_tokens == len(wanted)
        assert r.decoded == library.decode(wanted)
    assert pieces.encode_transcripts(frame(spark, []), MODEL).collect() == []


# -- lines -----------------------------------------------------------------------------


def brute_lines(rows, least=10, holders=3):
    space = " \t\n\x0b\x0c\r"
    keys = [[lower(line.strip(space)) for line in (t or "").split("\n")] for _, t in rows]
    held = {}
    for (i, _), ks in zip(rows, keys):
        for k in ks:
            if len(k) >= least:
                held.setdefault(k, set()).add(i)
    out = []
    for (i, t), ks in zip(rows, keys):
        stays = [not (len(held.get(k, ())) >= holders and i != max(held[k], key=lambda x: (x is not None, x))) for k in ks]
        kept = "\n".join(line for line, s in zip((t or "").split("\n"), stays) if s)
        out.append((i, kept, len(ks), len(ks) - sum(stays)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    pool = [f"Line {k} of the POOL é{'x' * k}" for k in range(12)] + ["short", "", "a" * 9, "é" * 10, "  é" + "é" * 9 + "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(None, pool[3]), (7, rows[7][1]), (8, pool[4] + "\n" + pool[4]), (99, None), (98, ""), (97, pool[2] * 9000)]
    for held in (1, lines.HELD_ROWS):
        monkeypatch.setattr(lines, "HELD_ROWS", held)
        df = frame(spark, rows)
        plain = df.select("utterance_id", "transcript")
        found = lines.apply_bitmaps(plain, lines.line_bitmaps(df, 10, 3)).collect()
        got = sorted([(r.utterance_id, r.transcript or "", r.n_lines, r.n_dropped) for r in found], key=str)
        assert got == brute_lines(rows)
    empty = frame(spark, [])
    assert lines.line_bitmaps(empty).collect() == [] == lines.apply_bitmaps(empty, lines.line_bitmaps(empty)).collect()


# -- leaks -----------------------------------------------------------------------------

PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_leaks(rows, items, window):
    split = [(name, re.findall(PLAIN, lower(t))) for name, t in items]
    out = []
    for i, t in rows:
        words, hit, names = re.findall(PLAIN, lower(t)), set(), set()
        for name, item in split:
            size = min(window, len(item))
            for p in range(len(item) - size + 1) if item else ():
                for q in range(len(words) - size + 1):
                    if words[q:q + size] == item[p:p + size]:
                        hit.update(range(q, q + size))
                        names.add(str(name) if name is not None else "")
        out.append((i, len(words), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_leaks_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    rng = random.Random(11)
    letters = ["a", "B", "ç", "d4"]
    say = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 5, 8, 12]) if k else 6)) for k in range(7)] + [(50, None), (51, "--"), (None, say(5))]
    rows = [(i, say(rng.randint(0, 25)).replace(" ", rng.choice([" ", ", ", "\n"]))) for i in range(60)]
    rows += [(None, "a B"), (1, None), (2, ""), (3, say(3000))]
    items = [x for x in items if x[1] is None or len(x[1].split()) != 1]
    found = leaks.find_leaks(frame(spark, rows), spark.createDataFrame(items, "id int, text string"), 4).collect()
    assert [(r.utterance_id, r.n_words, r.n_hit, r.item_ids) for r in found] == brute_leaks(rows, items, 4)


def test_one_block_of_items_is_held_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 40)
    texts = [" ".join(f"i{k}w{j}" for j in range(12)) for k in range(6)]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plan = leaks.find_leaks(frame(spark, [(1, texts[0] + " x " + texts[5])]), items)
    assert [(r.n_hit, r.item_ids) for r in plan.collect()] == [(24, ["0", "5"])]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_one_word_items_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "zebra")], "id int, text string")
    rows = [(1, "a Zebra, zebra b"), (2, "zebras")]
    found = leaks.find_leaks(frame(spark, rows), items).collect()
    assert [(r.n_hit, r.item_ids, [tuple(s) for s in r.spans]) for r in found] == [(2, ["1"], [(1, 2)]), (0, [], [])]
    assert leaks.find_leaks(frame(spark, []), items).collect() == []
    assert [r.n_hit for r in leaks.find_leaks(frame(spark, rows), items.limit(0)).collect()] == [0, 0]


def test_removal_cuts_passages_and_repeats_until_none_is_left(spark):
    item = "one two three four five six"
    clean = " ".join(f"c{k}" for k in range(40))
    rows = [(1, f"{clean}\n{item}. {clean}"), (2, f"{clean} one two three {item} four five six {clean}"), (3, item), (4, clean),
            (5, None), (6, "")]
    items = spark.createDataFrame([("i", item)], "id string, text string")
    df = frame(spark, rows)
    found = {r.utterance_id: r for r in leaks.remove_leaks(df, items).collect()}
    assert leaks.remove_leaks(df, items).columns == df.columns
    assert sorted(found) == [1, 2, 4, 5, 6] and found[4].transcript == clean and found[5].transcript is None
    assert found[1].transcript == f"{clean}\n. {clean}" and "one" not in found[2].transcript
    assert [r.n_hit for r in leaks.find_leaks(leaks.remove_leaks(df, items), items).collect()] == [0] * 5


def brute_removal(text, items, window, most=0.5):
    """The words left of a text, or None if it falls out."""
    words = re.findall(PLAIN, lower(text))
    for turn in range(len(words) + 1):
        hit = set()
        for item in items:
            size = min(window, len(item))
            wanted = {tuple(item[p:p + size]) for p in range(len(item) - size + 1)}
            for q in range(len(words) - size + 1):
                if tuple(words[q:q + size]) in wanted:
                    hit.update(range(q, q + size))
        if turn == 0 and len(hit) > most * len(words):
            return None
        if not hit:
            return words
        words = [w for q, w in enumerate(words) if q not in hit]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_removal_does_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    texts = [" ".join(f"i{k}w{j}" for j in range(10)) for k in range(8)]
    rest = lambda n: " ".join(f"c{j}" for j in range(n))
    rows = [(a * 8 + b, f"{x} {y} {rest(15)}") for a, x in enumerate(texts) for b, y in enumerate(texts) if a != b]  # 20 of 35
    for a, x in enumerate(texts):  # a cut of y joins the halves of x
        for b, y in enumerate(texts):
            if a != b:
                rows.append((100 + a * 8 + b, f"{rest(40)} {x[:24]} {y} {x[25:]} {rest(40)}"))
    items = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    left = {r.utterance_id: r.transcript.split() for r in leaks.remove_leaks(frame(spark, rows), items).collect()}
    brute = {i: brute_removal(t, [x.split() for x in texts], leaks.WINDOW) for i, t in rows}
    assert left == {i: words for i, words in brute.items() if words is not None}
    assert len(left) == 56 and all(words == [*rest(40).split()] * 2 for words in left.values())


# -- rules -----------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [lower(w) for w in words]
    grams = [tuple(low[i:i + 3]) for i in range(len(low) - 2)]
    repeat = {i + j for i, g in enumerate(grams) for j in range(3) if grams.count(g) > 1}
    kept = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(kept) - len(set(kept)), len(repeat))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é#|\n\t .的"), max_size=80), min_size=1, max_size=5))
def test_counts_match_brute_force(texts):
    found = rules.count_texts([t.encode() for t in texts])
    assert [tuple(r[:5]) for r in found.tolist()] == [brute_counts(t) for t in texts]


def test_repeats_are_words_as_they_stand():
    found = rules.count_texts([b"The cat sat. the cat sat. THE CAT SAT.", b"The cat sat. x The cat sat.", b"THE The the"])
    assert found[:, 4].tolist() == [0, 6, 0] and found[:, 6].tolist() == [3, 2, 3]


def test_estimation_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    right_good, right_bad = np.array([0.97, 0.95, 0.9, 0.99]), np.array([0.7, 0.8, 0.6, 0.5])
    right = rng.random((len(good), 4)) < np.where(good[:, None], right_good, right_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((len(good), 4)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = rules.estimate(patterns, counts.astype(float), turns=2000)
    assert abs(found["share"] - 0.8) < 0.03
    assert np.abs(found["good"] - right_good).max() < 0.03 and np.abs(found["bad"] - right_bad).max() < 0.08


def test_estimation_ends_at_convergence_or_raises():
    # two rules that vote weakly against each other move the estimate for long
    votes = np.array([[1, 1], [1, -1], [-1, 1], [-1, -1]])
    counts = np.array([500.0, 240.0, 230.0, 130.0])
    found, more = rules.estimate(votes, counts), rules.estimate(votes, counts, turns=10**6)
    assert all(np.array_equal(found[k], more[k]) for k in found)
    with pytest.raises(RuntimeError):
        rules.estimate(votes, counts, turns=200)


def test_judgement_of_odd_rows(spark):
    good = ". ".join(f"The w{k} of a{k} is in b{k} and c{k}" for k in range(12)) + "."
    rows = [(k, good.replace("w", f"v{k}")) for k in range(30)] + [(50, "### $$$ " * 60), (51, None), (52, ""), (None, good), (0, good)]
    df = frame(spark, rows)
    found = rules.judge_quality(df).collect()
    assert [r.kept for r in found] == [True] * 30 + [False, False, False, True, True]
    kept = rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 32
    assert rules.judge_quality(frame(spark, [])).collect() == [] == rules.keep_good(frame(spark, [])).collect()


# -- licenses --------------------------------------------------------------------------


def brute_phrases(text):
    words = re.findall(PLAIN, lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i:i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return len(words), sorted(places), sorted(labels)


def test_phrases_match_brute_force(spark):
    rng = random.Random(2)
    pool = ["MIT", "license", "apache", "general", "public", "x", "mit-license", "Apache  License", "général", "\n"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(50)] + [(None, None), (1, ""), (1, "")]
    found = licenses.scan_licenses(frame(spark, rows)).collect()
    assert [(r.n_words, r.places, r.base_labels) for r in found] == [brute_phrases(t) for _, t in rows]
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in found)
    assert licenses.scan_licenses(frame(spark, [])).collect() == []


def test_notices_are_found_with_edits_and_spans(spark):
    filler = "some words that stand before "
    rows = [(1, filler + "Relesed under the M.I.T license"), (2, filler + "Licenced under CC-BY-NC 4.0!"),
            (3, filler + "licensed under the apache lisense, version 2.0"), (4, "a licensed driver under the bridge " * 50)]
    found = licenses.scan_licenses(frame(spark, rows)).collect()
    assert found[1].labels == ["cc-by-nc"] and found[1].spans[0].first_word == 5 and found[1].spans[0].errors == 1
    assert found[2].labels == ["apache"] and found[2].base_labels == [] and 0.9 < found[2].score < 1
    assert found[3].labels == [] and found[3].score == 0


def test_naming_words_of_notices_stand_unedited(spark):
    cases = [("licensed under the mpl license", []), ("licensed under the mit lisense", ["mit"]),
             ("under the terms of the xyz general public license", []),
             ("licensed under cc by nd 4 0", ["cc-by-nd"]), ("licenced under CC BY-SA 4.0", ["cc-by-sa"]),
             ("licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa"]), ("licensed under cc by nx 4 0", []),
             ("licensed under the mpl license, licensed under the mit license", ["mit"])]
    found = licenses.scan_licenses(frame(spark, [(k, f"words before {t} and after") for k, (t, _) in enumerate(cases)]))
    got = {r.utterance_id: [s.label for s in r.spans] for r in found.collect()}
    assert [got[k] for k in range(len(cases))] == [labels for _, labels in cases]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, len(licenses.NOTICES) - 1), st.data())
def test_every_notice_within_its_edits_is_found(which, data):
    notice, label = licenses.NOTICES[which]
    k = len(notice) // licenses.CHARACTERS_PER_ERROR
    text = list(notice)
    for place in data.draw(st.lists(st.integers(0, len(notice) - 1), max_size=k, unique=True)):
        text[place] = data.draw(st.sampled_from(["", "q", "7q"[:1]]))
    scan = licenses.scanner(tuple(licenses.NOTICES), licenses.CHARACTERS_PER_ERROR).scan("zz " + "".join(text) + " zz")
    assert label in {s[0] for s in scan}
