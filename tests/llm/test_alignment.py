"""Tokenizer alignment against plain loops over the libraries' tokens."""

import hashlib
import random
import sys
import unicodedata
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from phonoframe.llm import alignment, queries

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
UTTERANCES = "utterance_id bigint, transcript string, row string, links int"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def token_bytes(libraries):
    a, b = libraries
    letters = alignment.byte_letters()

    def of_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return of_a, of_b


def brute(libraries, texts):
    a, b = libraries
    of_a, of_b = token_bytes(libraries)
    aligned, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            left = [(i, of_a(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(i, of_b(i)) for i in b.encode(text)]
            if all(b"".join(t for _, t in side) == (" " + text).encode() for side in (left, right)):
                ends = []
                for side in (left, right):
                    at, out = 0, []
                    for i, t in side:
                        at += len(t)
                        out.append((i, at))
                    ends.append(out)
                shared = {e for _, e in ends[0]} & {e for _, e in ends[1]}
                groups = [[[], []] for _ in shared]
                for k, side in enumerate(ends):
                    at = 0
                    for i, e in side:
                        groups[at][k].append(i)
                        at += e in shared
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        aligned.append((groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in aligned:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
            sum(n for (x, y), n in links.items() if held[x, y] == best[x]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


TEXTS = [
    "The cat sat on the mat.", "the  cat\n\nsat\t on", None, "", " ", "   ", "▁ held", "<|endoftext|> <s></s> <0x41>", "é日本語 😀 naïve",
    "\u0000 a\u0001", "The cat sat on the mat.", "a" * 3000, " " * 2000 + "x", "." * 1500, "don't I'LL we've", "日本" * 400, "Zürich Straße ﬁ Ω",
]


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], UTTERANCES)
    aligned = alignment.align_tokens(df, BYTE, PIECE)
    scores = {r.row: r for r in alignment.score_links(aligned, alignment.pair_counts(aligned), **options).collect()}
    out = []
    for r in aligned.collect():
        s = scores.get(r.row)
        out.append((r.utterance_id, r.n_a, r.n_b, r.n_groups, r.n_links, s.n_best if s else 0, s.count_sum if s else 0,
                    hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_pairs", [0, 1 << 19])
def test_alignment_equals_loops(spark, libraries, broadcast_pairs):
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(TEXTS)]
    wanted = sorted(((i, *b) for (i, _), b in zip(rows, brute(libraries, TEXTS))), key=str)
    assert found(spark, rows, broadcast_pairs=broadcast_pairs) == wanted


def test_hot_pairs_are_the_same_by_shuffle(spark, libraries, monkeypatch):
    texts = [f"the cat {k} sat." for k in range(60)]
    monkeypatch.setattr(alignment, "HOT_SHARE", 20)
    wanted = sorted(((k, *b) for k, b in enumerate(brute(libraries, texts))), key=str)
    assert found(spark, list(enumerate(texts)), broadcast_pairs=0) == wanted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeth  \n.\t▁é的😀\x00Ω<s>01'"), max_size=50), max_size=5))
def test_slices_equal_loops(texts):
    tokens = alignment.tokenizers(BYTE, PIECE)
    got = alignment.align_slice(tokens, [t.encode() for t in texts])
    wanted = brute((tokens.library, tokens.pieces), texts)
    assert list(zip(*(got[c].to_pylist() for c in alignment.COUNTS))) == [w[:4] for w in wanted]
    assert [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"].to_pylist()] == [w[6] for w in wanted]


def test_ranks_give_the_ids_of_the_file(libraries):
    tokens = alignment.tokenizers(BYTE, PIECE)
    assert tokens.fast is not None
    chars = [chr(c) for c in range(0, sys.maxunicode + 1, 53) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    rng = random.Random(1)
    for k in range(0, len(chars), 200):
        text = "".join(f" {c}{c}1{c}a {c}{rng.choice(' .x')}" for c in chars[k:k + 200])
        assert tokens.encode_a(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_very_long_text(spark, libraries):
    text = "".join(random.Random(3).choice(["the ", "cat", "  ", "日", "x9", ".\n"]) for _ in range(60_000))
    got = found(spark, [(1, text), (2, "z" * 150_000)])
    assert got == sorted(((k + 1, *b) for k, b in enumerate(brute(libraries, [text, "z" * 150_000]))), key=str)


def test_query(spark, libraries, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_tokenizer_alignment(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((k, *b) for (k, _), b in zip(rows, brute(libraries, TEXTS)))
    assert got[0].asDict().keys() == {
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


@pytest.mark.parametrize("kind", [T.LongType(), T.StringType()])
def test_empty_table(spark, kind):
    df = spark.createDataFrame([], T.StructType([
        T.StructField("utterance_id", kind), T.StructField("transcript", T.StringType())]))
    aligned = alignment.align_tokens(df, BYTE, PIECE)
    assert aligned.collect() == [] and alignment.score_links(aligned, alignment.pair_counts(aligned)).collect() == []
