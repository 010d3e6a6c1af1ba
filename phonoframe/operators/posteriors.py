"""Scores from frame posteriors.

An utterance carries its log-probabilities as array<array<double>> [frame][token], so
every score is a projection over one row: nothing is shuffled and a busy utterance
costs no more than its own frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.align import ctc_path
from phonoframe.functions.scalar import col, first_argmax, let, lookup, mean, total

FLOOR = -1e9


def log_softmax(logits: Column | str) -> Column:
    """Log-probabilities of every frame."""

    def frame(xs: Column) -> Column:
        return let(F.array_max(xs), lambda top: let(
            top + F.ln(total(F.transform(xs, lambda x: F.exp(x - top)))),
            lambda lse: F.transform(xs, lambda x: x - lse)))

    return F.transform(col(logits), frame)


def hop_seconds(frames: Column | str, duration: Column | str) -> Column:
    return F.try_divide(col(duration), F.size(col(frames)).cast("double"))


def explode_frames(df: DataFrame, frames: str, keys: list[str]) -> DataFrame:
    """Long form (keys, t, token, logp)."""
    rows = df.select(*keys, F.posexplode(frames).alias("t", "_f"))
    return rows.select(*keys, "t", F.posexplode("_f").alias("token", "logp"))


def pack_frames(df: DataFrame, key: str) -> DataFrame:
    """Long rows (key, t, token, logp) -> one row per utterance with ``frames``.

    Frames are packed first, utterances second; an utterance is one recording.
    """
    per_frame = df.groupBy(key, "t").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("token", "logp"))), lambda x: x["logp"]).alias("f"))
    return per_frame.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "f"))), lambda x: x["f"]).alias("frames"))


def _at(frames: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(frames, i))


def _mass(selected: Column, token: Column) -> Column:
    return mean(F.transform(selected, lambda f: F.exp(F.get(f, token))))


def _normal(mass: Column) -> Column:
    """Mass divided by its sum, dust kept back."""
    return let(mass, lambda m: let(total(m) + K.EPS, lambda z: F.transform(m, lambda x: x / z)))


def _closed_share(chosen: Column, closed: Column) -> Column:
    return _normal(F.transform(closed, lambda c: _mass(chosen, c)))


def contrast_mean(frames: Column, indices: Column, target: Column, confusions: Column) -> Column:
    """struct(posteriors, score, best): mean probability mass over the label frames,
    renormalised on target and confusions; posteriors follow [target, *confusions]."""

    def scores(share: Column) -> Column:
        rivals = F.slice(share, F.lit(2), F.size(confusions))
        score = F.ln((F.array_max(rivals) + K.EPS) / (F.get(share, F.lit(0)) + K.EPS))
        return F.struct(
            share.alias("posteriors"), score.alias("score"),
            F.get(confusions, first_argmax(rivals).cast("int")).alias("best"))

    closed = F.concat(F.array(target), confusions)
    return let(_at(frames, indices), lambda chosen: let(_closed_share(chosen, closed), scores))


def _frame_odds(frames: Column, indices: Column, target: Column, confusions: Column) -> Column:
    """Per label frame the renormalised struct(rival, own) probabilities."""
    closed = F.concat(F.array(target), confusions)

    def odds(f: Column) -> Column:
        logp = F.transform(closed, lambda c: F.get(f, c))
        weights = lambda xs: let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top)))
        return let(let(logp, weights), lambda p: F.struct(
            (F.array_max(F.slice(p, F.lit(2), F.size(confusions))) / total(p)).alias("rival"),
            (F.get(p, F.lit(0)) / total(p)).alias("own")))

    return F.transform(_at(frames, indices), odds)


def contrast_spike(frames: Column, indices: Column, target: Column, confusions: Column) -> Column:
    """Log ratio of the frame that favours a confusion most."""
    odds = _frame_odds(frames, indices, target, confusions)
    return F.array_max(F.transform(odds, lambda o: F.ln((o["rival"] + K.EPS) / (o["own"] + K.EPS))))


def contrast_vote(frames: Column, indices: Column, target: Column, confusions: Column) -> Column:
    """Share of label frames where a confusion strictly beats the target."""
    odds = _frame_odds(frames, indices, target, confusions)
    return mean(F.transform(odds, lambda o: (o["rival"] > o["own"]).cast("double")))


def heard(
    frames: Column, indices: Column, target: Column, confusions: Column, blank: int, table: Column
) -> Column:
    """struct(token, hearing_score): argmax over the whole vocabulary without the blank.

    A winner outside the phone table falls back to the closed set.
    """
    vocab = F.sequence(F.lit(0), F.size(F.get(frames, F.lit(0))) - 1)
    names = F.concat(F.array(target), confusions)

    def pick(full: Column, share: Column) -> Column:
        winner = first_argmax(full).cast("int")
        known = F.array_contains(table, winner) & (F.array_max(full) > 0)
        token = F.when(known, winner).otherwise(F.get(names, first_argmax(share).cast("int")))
        p = F.when(known, F.array_max(full) / (total(full) + K.EPS)).otherwise(F.array_max(share))
        return F.struct(
            token.alias("token"), F.ln((p + K.EPS) / (1.0 - p + K.EPS)).alias("hearing_score"))

    return let(_at(frames, indices), lambda chosen: let(
        F.transform(vocab, lambda v: F.when(v == blank, 0.0).otherwise(_mass(chosen, v))),
        lambda full: let(_closed_share(chosen, names), lambda share: pick(full, share))))


def gop(frames: Column, indices: Column, target: Column) -> Column:
    """struct(gop, confidence) of one phone over its label frames."""
    pairs = F.transform(_at(frames, indices), lambda f: F.struct(
        F.array_max(f).alias("best"), (F.get(f, target) - F.array_max(f)).alias("gap")))

    def scores(p: Column) -> Column:
        sure = F.exp(mean(F.transform(p, lambda x: x["best"])))
        return F.struct(
            mean(F.transform(p, lambda x: x["gap"])).alias("gop"),
            F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)).alias("confidence"))

    return let(pairs, scores)


def realized_class(
    frames: Column, indices: Column, classes: Column, min_mass: float = 0.6
) -> Column:
    """Class with the dominant mass, or null below ``min_mass``.

    ``classes`` is array<struct<name, tokens>>; a class of several tokens takes its
    strongest token in every frame.
    """
    def shifted(f: Column) -> Column:
        logp = F.transform(classes, lambda c: F.coalesce(
            F.array_max(F.transform(c["tokens"], lambda k: F.get(f, k))), F.lit(FLOOR)))
        return let(logp, lambda xs: let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top))))

    def winner(share: Column) -> Column:
        name = F.get(classes, first_argmax(share).cast("int"))["name"]
        return F.when((F.size(indices) > 0) & (F.array_max(share) >= min_mass), name)

    return let(F.transform(_at(frames, indices), shifted), lambda per_frame: let(
        _normal(F.transform(classes, lambda _, i: mean(F.transform(per_frame, lambda p: F.get(p, i))))), winner))


# -- forced alignment -----------------------------------------------------------------------


def align_problem(frames: Column, targets: Column) -> Column:
    """Why a sequence cannot be aligned, or null."""
    n = F.size(targets)
    vocab = F.size(F.get(frames, F.lit(0)))
    repeats = F.size(F.filter(targets, lambda x, i: (i > 0) & (x == F.get(targets, i - 1))))
    outside = F.exists(targets, lambda x: (x < 0) | (x >= vocab))
    short = F.size(frames) < n + repeats
    return (
        F.when(n == 0, "empty target phone sequence")
        .when(outside, "target contains a token outside the model vocabulary")
        .when(short, F.concat(
            F.lit("audio is too short to contain "), n.cast("string"), F.lit(" phones ("),
            F.size(frames).cast("string"), F.lit(" frames < "), (n + repeats).cast("string"),
            F.lit(" required)"))))


def forced_align(frames: Column, targets: Column, blank: int = 0) -> Column:
    """Best CTC path as extended-state index per frame (label i is state 2i + 1).

    Ties keep the smaller step. Null when no path exists.
    """
    return ctc_path(blank)(frames, targets)


def phone_segments(path: Column, n_phones: Column) -> Column:
    """array<struct<index, start_frame, end_frame, frames>> that tile the spoken part.

    Blank frames between two phones are split at their midpoint; leading and trailing
    blanks stay outside.
    """
    labels = F.sequence(F.lit(0), n_phones - 1)
    times = F.transform(path, lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    own = lambda pairs: F.transform(labels, lambda i: F.transform(
        F.filter(pairs, lambda p: p["s"] == 2 * i + 1), lambda p: p["t"]))
    head = lambda xs: F.get(xs, F.lit(0))
    tail = lambda xs: F.get(xs, F.size(xs) - 1)

    def tile(spans: Column) -> Column:
        middle = lambda a, b: F.floor((tail(a) + head(b)) / 2).cast("int") + 1
        start = lambda xs, i: F.when(i == 0, head(xs)).otherwise(middle(F.get(spans, i - 1), xs))
        end = lambda xs, i: F.when(i == F.size(spans) - 1, tail(xs) + 1).otherwise(
            middle(xs, F.get(spans, i + 1)))
        return F.transform(spans, lambda xs, i: F.struct(
            i.alias("index"), start(xs, i).alias("start_frame"),
            F.greatest(end(xs, i), start(xs, i) + 1).alias("end_frame"), xs.alias("frames")))

    return let(let(times, own), tile)


def clip_time(frame: Column, hop: Column, offset: Column, duration: Column) -> Column:
    return F.round(F.least(offset + frame * hop, duration), 4)


def ctc_greedy(tokens: Column | str, blank: int = 0) -> Column:
    """Greedy decode: repeats collapse, blanks go."""
    xs = col(tokens)
    return F.filter(xs, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(xs, i - 1))))


def token_name(token: Column, names: dict[int, str]) -> Column:
    return lookup(names, token)
