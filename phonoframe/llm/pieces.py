"""SentencePiece encoding and decoding of transcripts by vectorised merge rounds.

A text becomes symbols (one per character, blanks as U+2581). Symbols are cut into words that no
piece crosses, equal words are merged once, and all words of a slice advance together: in a round
every word finds the smallest rank among its neighbouring pairs, its leftmost occurrences of that
pair merge, and the flat symbol array is compacted. Where a merge makes a neighbour pair of a smaller
rank, the later ones of its word wait for the next round. Words without a pair leave; the rounds end when
none is left. Nothing is shuffled: texts go through Arrow tasks, where the model file is read once
for each Python worker.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm.words import mix, slices

BLANK = "▁"
_NONE = np.int64(1 << 62)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 19
"""Bytes of texts that are encoded together; flat arrays of more would stay with the worker."""
ROUNDS = 96
"""Rounds of all words together; a word that is not done by then (no word of prose) goes on alone."""


class Pieces:
    """The pieces of a BPE model file as arrays: rank of a pair, bytes of a piece, bytes fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = sp
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size)
                   if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.has_bytes = sp.is_byte(int(self.byte_ids[0]))
        self.ids = {p: i for i, p in enumerate(names) if i not in special}
        letters = sorted({c for p in self.ids for c in p})
        # symbols: ids of pieces, then letters that are no piece, then any other character
        self.symbol = {c: self.ids.get(c, size + k) for k, c in enumerate(letters)}
        self.other = size + len(letters)
        self.piece_count = size
        # number of a letter by its code point, and symbol by its number; the last ones are of any other character
        self.letter_number = np.full(0x110000, len(letters), np.int32)
        self.letter_number[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letter_symbol = np.array([*(self.symbol[c] for c in letters), self.other], np.int64)
        known = {**{c: s for c, s in self.symbol.items()}, **self.ids}
        order = {p: r for r, p in enumerate(sorted(self.ids, key=lambda p: (-sp.get_score(self.ids[p]), self.ids[p])))}
        self.base = self.other + 1
        keys, ranks, merged = [], [], []
        # a merge into one of these pieces can make a neighbour pair of a smaller rank
        hasty: set[str] = set()
        for piece, rank in order.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in known and right in known:
                    keys.append(known[left] * self.base + known[right])
                    ranks.append(rank)
                    merged.append(self.ids[piece])
                    hasty.update(p for p in (left, right) if len(p) > 1 and order[p] > rank)
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[by_key], _NONE)
        self.ranks = np.append(np.array(ranks, np.int64)[by_key], _NONE)
        self.merged = np.append(np.array(merged, np.int64)[by_key], 0)
        self.slot = self._hash_table(self.keys[:-1])
        self.hasty = np.zeros(size, bool)
        self.hasty[[self.ids[p] for p in hasty]] = True
        # a word ends between two letters that stand together in no piece
        self.letters = len(letters) + 1
        number = {c: k for k, c in enumerate(letters)}
        inside = np.zeros(self.letters * self.letters, bool)
        inside[[number[a] * self.letters + number[b] for p in self.ids for a, b in zip(p, p[1:])]] = True
        self.inside = np.packbits(inside, bitorder="little")
        self.surface = [p.replace(BLANK, " ").encode() if i not in special else b"" for i, p in enumerate(names)]
        self.surface[self.unknown] = " ⁇ ".encode() if self.unknown >= 0 else b""
        for b, i in enumerate(self.byte_ids.tolist()):
            if self.has_bytes:
                self.surface[i] = bytes([b])
        self.is_byte = np.zeros(size, bool)
        if self.has_bytes:
            self.is_byte[self.byte_ids] = True
        self.surface_size = np.array([len(s) for s in self.surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        plain = sp.encode("a  b ", out_type=str)
        self.verbatim = sp.encode("Ω ﬁ", out_type=str) == sp.encode("Ω ﬁ".replace(" ", BLANK), out_type=str)
        self.verbatim &= "".join(plain) == f"{BLANK}a{BLANK}{BLANK}b{BLANK}" and sp.decode(sp.encode("ﬁ")) == "ﬁ"

    # -- encoding ----------------------------------------------------------------------

    def _hash_table(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys by open addressing, the last place (that of no key) where a slot is free."""
        bits = max(4, len(keys).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        slot = np.full(1 << bits, len(keys), np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(todo):
            free = slot[at] == len(keys)
            slot[at[free]] = todo[free]  # of several keys the last one stays
            todo, at = todo[slot[at] != todo], at[slot[at] != todo]
            at = (at + 1) & (len(slot) - 1)
        return slot

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * _STEP) >> self.shift).view(np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Place of each pair among the keys; the last one where it is no key."""
        at = self._home(keys)
        place = self.slot[at]
        none = len(self.keys) - 1
        todo = np.flatnonzero((place != none) & (self.keys[place] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
            place[todo] = self.slot[at[todo]]
            todo = todo[(place[todo] != none) & (self.keys[place[todo]] != keys[todo])]
        return place

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of every word (``word`` never decreases) until no pair remains."""
        done_symbols, done_words = [], []
        rounds = 0
        while len(symbols):
            rank, found = self._pairs(symbols, word)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(word)))
            active = np.repeat(least < _NONE, length)
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
            rounds += 1
            if rounds > ROUNDS:
                symbols, word = symbols[active], word[active]
                for w in np.split(np.arange(len(word)), np.flatnonzero(np.diff(word)) + 1) if len(word) else []:
                    merged = self._merge_one(symbols[w].tolist())
                    done_symbols.append(np.array(merged, np.int64))
                    done_words.append(np.full(len(merged), word[w[0]]))
                break
            at = np.flatnonzero((rank == np.repeat(least, length)) & (rank < _NONE))
            # of pairs that overlap, as in "aaa", every second one from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            at = at[self._certain(symbols, word, at, rank[at], self.merged[found[at]])]
            symbols = symbols.copy()
            symbols[at] = self.merged[found[at]]
            active[at + 1] = False
            symbols, word = symbols[active], word[active]
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that begins at each symbol (or none) and its place among the keys."""
        rank, place = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(word[1:] == word[:-1])
        place[at] = self._place(symbols[at] * self.base + symbols[at + 1])
        rank[at] = self.ranks[place[at]]  # that of no key is none
        return rank, place

    def _certain(self, symbols, word, at, rank, merged) -> np.ndarray:
        """Which of the merges, taken from the left, come before any other: those of a word up to the first one that
        makes a neighbour pair of no larger rank. At that time its left neighbour is merged and its right one is not."""
        risky = np.flatnonzero(self.hasty[merged])
        if not len(risky):
            return np.ones(len(at), bool)
        left, right = at[risky] - 1, at[risky] + 2
        beside = np.maximum(risky - 1, 0)
        joined = (risky > 0) & (at[beside] == at[risky] - 2)
        before = np.where(joined, merged[beside], symbols[left])
        after = symbols[np.minimum(right, len(symbols) - 1)]
        inside_left = (left >= 0) & (word[left] == word[at[risky]])
        inside_right = (right < len(symbols)) & (word[np.minimum(right, len(symbols) - 1)] == word[at[risky]])
        unsafe = np.zeros(len(at), bool)
        for inside, key in ((inside_left, before * self.base + merged[risky]), (inside_right, merged[risky] * self.base + after)):
            unsafe[risky] |= inside & (self.ranks[self._place(key)] <= rank[risky])
        earlier = np.cumsum(unsafe) - unsafe
        first = np.flatnonzero(np.diff(word[at], prepend=-1))
        return earlier == np.repeat(earlier[first], np.diff(np.append(first, len(at))))

    def _merge_one(self, symbols: list[int]) -> list[int]:
        """The same for one word that is left after many rounds: a heap of (rank, place) over linked symbols."""
        known = self.by_pair
        behind, ahead = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        size, base = len(symbols), self.base
        heap = [(known[k][0], i, k) for i, k in enumerate(a * base + b for a, b in zip(symbols, symbols[1:])) if k in known]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = ahead[i]
            if symbols[i] < 0 or j >= size or symbols[i] * base + symbols[j] != key:
                continue
            symbols[i], symbols[j] = known[key][1], -1
            ahead[i] = ahead[j]
            if ahead[i] < size:
                behind[ahead[i]] = i
            for x, y in ((behind[i], i), (i, ahead[i])):
                if x >= 0 and y < size:
                    made = symbols[x] * base + symbols[y]
                    if made in known:
                        heapq.heappush(heap, (known[made][0], x, made))
        return [s for s in symbols if s >= 0]

    @functools.cached_property
    def by_pair(self) -> dict[int, tuple[int, int]]:
        """Rank and result of each pair, by its key."""
        return dict(zip(self.keys[:-1].tolist(), zip(self.ranks[:-1].tolist(), self.merged[:-1].tolist())))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each); begin and end ids included."""
        shown = [" " + t.decode("utf-8", "replace") if t else "" for t in texts]
        code = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32).copy()
        sizes = np.fromiter(map(len, shown), np.int64, len(shown))
        code[code == 32] = ord(BLANK)
        if len(code):
            number = self.letter_number[code]
            pair = number[:-1].astype(np.int64) * self.letters + number[1:]
            head = np.ones(len(code), bool)
            head[1:] = (self.inside[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0
            ends = np.cumsum(sizes)
            head[(ends - sizes)[sizes > 0]] = True
            begin = np.flatnonzero(head)
            ids, count = self._encode_words(self.letter_symbol[number], code, begin, np.diff(np.append(begin, len(code))))
            per_row = np.diff(np.append(0, np.cumsum(count))[np.searchsorted(begin, ends)], prepend=0)
        else:
            ids, per_row = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        total = per_row + 2
        out = np.empty(int(total.sum()), np.int64)
        ends = np.cumsum(total)
        inner = np.ones(len(out), bool)
        inner[ends - total] = inner[ends - 1] = False
        out[ends - total], out[ends - 1], out[inner] = self.bos, self.eos, ids
        return out, total

    def _encode_words(self, symbols, code, begin, length) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and their number per word; equal words are merged once."""
        sample, which = _distinct(code, begin, length)
        size = length[sample]
        place = np.repeat(begin[sample] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        merged, word = self.merge(symbols[place], np.repeat(np.arange(len(sample)), size))
        if len(merged) and merged.max() >= self.piece_count:  # characters that are no piece
            merged, word = self._fall_back(merged, word, code[place], np.repeat(np.arange(len(sample)), size))
        count = np.bincount(word, minlength=len(sample))
        first = np.cumsum(count) - count
        need = count[which]
        take = np.repeat(first[which] - (np.cumsum(need) - need), need) + np.arange(int(need.sum()))
        return merged[take], need

    def _fall_back(self, merged, word, code, owner) -> tuple[np.ndarray, np.ndarray]:
        """Replace symbols that are no piece by the byte pieces of their character, or the unknown id."""
        lost = merged >= self.piece_count
        # such characters never merge, so those of a word keep their order
        odd = code[self.letter_symbol[self.letter_number[code]] >= self.piece_count]
        del owner
        if not self.has_bytes:
            merged = merged.copy()
            merged[lost] = self.unknown
            keep = np.ones(len(merged), bool)
            keep[1:] = ~(lost[1:] & lost[:-1] & (word[1:] == word[:-1]))  # a run is one unknown piece
            return merged[keep], word[keep]
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in odd.tolist()]
        width = np.ones(len(merged), np.int64)
        width[lost] = np.fromiter(map(len, spelled), np.int64, len(spelled))
        out = np.repeat(merged, width)
        out[np.repeat(lost, width)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.repeat(word, width)

    # -- decoding ----------------------------------------------------------------------

    def decode(self, ids: np.ndarray, total: np.ndarray) -> list[str]:
        """Texts of id sequences that lie one after another, ``total`` ids each."""
        size = self.surface_size[ids]
        place = np.repeat(self.surface_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        data = self.surface_bytes[place].tobytes()
        ends = np.cumsum(total)
        row_bytes = np.append(0, np.cumsum(size))[ends]
        shown = np.flatnonzero(size)
        lead = np.append(shown, len(ids))[np.searchsorted(shown, ends - total)]
        # the blank in front goes, unless it was spelled as a byte or belongs to the unknown piece
        first = np.append(ids, -1)[lead]
        strip = (lead < ends) & (first != self.unknown) & ~self.is_byte[first]
        out, at = [], 0
        for i, end in enumerate(row_bytes.tolist()):
            try:  # pieces are whole characters, so a text is valid just when each of its byte runs is
                text = data[at:end].decode()
                out.append(text.removeprefix(" ") if strip[i] else text)
            except UnicodeDecodeError:
                out.append(self._spell(ids[int(ends[i] - total[i]):int(ends[i])]))
            at = end
        return out

    def _spell(self, ids: np.ndarray) -> str:
        """Text of one sequence; every byte of a byte run that is no character is U+FFFD."""
        parts, run = [], bytearray()
        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.surface[i]
            elif self.surface[i]:
                shown = self.surface[i].decode()
                parts += [_characters(bytes(run)), shown if parts or run or i == self.unknown else shown.removeprefix(" ")]
                run.clear()
        return "".join([*parts, _characters(bytes(run))])


def _distinct(code: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one word of each kind, kind of every word) of words given as ranges of ``code``.

    Words are compared by hash, and then each with the one that stands for it, so a collision cannot join two.
    """
    first = np.repeat(begin, length)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(length.max()) + 1, _STEP, np.uint64))
        value = mix(code.astype(np.uint64)) * power[np.arange(len(code)) - first]
        hashes = mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * _STEP)
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    stands = sample[which]
    if (length == length[stands]).all() and (code == code[np.arange(len(code)) - first + np.repeat(begin[stands], length)]).all():
        return sample, which
    raw = code.astype(np.uint32).tobytes()
    known: dict[bytes, int] = {}
    which = np.fromiter(
        (known.setdefault(raw[4 * a:4 * (a + n)], len(known)) for a, n in zip(begin.tolist(), length.tolist())),
        np.int64, len(begin))
    sample = np.zeros(len(known), np.int64)
    sample[which[::-1]] = np.arange(len(begin))[::-1]
    return sample, which


def _characters(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for width in (1, 2, 3, 4):
            try:
                out.append(run[at:at + width].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            width = 1
        at += width
    return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_transcripts(utterances: DataFrame, model_path: str) -> DataFrame:
    """Encode transcripts with a SentencePiece BPE model and decode the ids again.

    ``utterances`` has ``utterance_id`` and ``transcript``; other columns are ignored. ``model_path``
    is a model file that every executor can open, such as one of an installed package.

    Returns one row per input row: ``utterance_id``, ``tokens`` (the ids as little-endian unsigned
    32-bit integers, the layout of token shards, with begin and end ids), ``n_tokens`` (all ids) and
    ``decoded`` (the text of the ids).

    Defined cases: a null or empty transcript has the begin and end ids only and decodes to the empty
    text; repeated rows give repeated results; a null utterance_id stays null; very long texts are
    handled whole, one text being the unit of memory. The model must keep texts verbatim (no
    normalisation, blanks kept, a blank put in front), else a ValueError is raised.
    """
    if not pieces(model_path).verbatim:
        raise ValueError(f"{model_path} normalises texts; only verbatim models are supported")
    id_type = utterances.schema["utterance_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for first, texts in slices(batch.column(1), SLICE):
                ids, total = model.encode(texts)
                ends = (np.append(0, np.cumsum(total)) * 4).astype(np.int64)
                tokens = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), tokens.cast(pa.binary()),
                     pa.array(total.astype(np.int64)), pa.array(model.decode(ids, total), pa.string())],
                    names=["utterance_id", "tokens", "n_tokens", "decoded"])

    return utterances.select("utterance_id", F.col("transcript").cast("string").alias("transcript")).mapInArrow(
        run, T.StructType([
            T.StructField("utterance_id", id_type), T.StructField("tokens", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]))
