"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Merges are applied in the order of their list. Suppose that a merge list has been applied to a buffer B and to B with
more text behind it. Both results agree but for a stretch at the end of B, which grows to the left by |a| bytes only
when a merge (a, b) takes the last token a in front of it and a token b that begins it in one result alone. After that
the stretch begins with a token whose left derivation has a. So the ranks of such merges rise along a chain, and the
longest chain, found in one pass over the list, bounds the stretch: tokens that end so many bytes before the end of a
buffer are stable and may be emitted.
"""

from __future__ import annotations

import codecs
import json
import re
from functools import cached_property

import numpy as np

from .words import MARK, OTHER, SPACE, WordTable, classes, joined, spread

NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next free from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def kinds(data: np.ndarray) -> np.ndarray:
    """Classes of bytes as words know them: marks are like any other character."""
    out = classes(data)
    out[out == MARK] = OTHER
    return out


def word_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the stretches begin that merges don't cross, in texts joined by words.joined; together they are the texts.

    Such a word is a run of one class with a space in front of it; a run of white space but for its last character,
    where something follows; that character, if it is no space; and an apostrophe with s, t, m, d, re, ve or ll.
    """
    n = int(edges[-1])
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = kinds(data[:n])
    start, first = np.ones(n, dtype=bool), np.zeros(n + 3, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    first[edges[:-1]] = True
    start |= first[:n]
    at = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
    at = at[~first[at]]
    last = at - 1
    for _ in range(2):  # the first byte of the white space in front
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[at[data[at - 1] == 0x20]] = False
    mark = np.flatnonzero((data[:n] == 0x27) & start)
    if len(mark):
        mark = mark[~first[mark + 1]]
        a, b = data[mark + 1], data[mark + 2]
        one = np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
        two = ~first[mark + 2] & (((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C)))
        end = mark + 2 + two
        some = one | two
        start[mark[some] + 1] = False
        start[end[some & (end < n)]] = True
    return np.flatnonzero(start)


class Merges:
    """A merge list with its vocabulary, from a tokenizer file's text."""

    def __init__(self, described: str):
        model = json.loads(described)
        vocabulary: dict[str, int] = model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.byte_ids = np.array([vocabulary[c] for c in alphabet], dtype=np.int32)
        self.token_bytes = {i: bytes(back[c] for c in s) for s, i in vocabulary.items()} | {i: s.encode() for s, i in self.special.items()}
        rows = []
        for m in model["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            rows.append((vocabulary[a], vocabulary[b], vocabulary[a + b]))
        self.merges = np.array(rows, dtype=np.int64).reshape(-1, 3)
        self.size = 1 + max(self.token_bytes)
        each = [self.token_bytes.get(i, b"") for i in range(self.size)]
        self.blob, self.width = np.frombuffer(b"".join(each), dtype=np.uint8), np.array([len(x) for x in each], dtype=np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        bits = max(4, (4 * len(rows)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        for rank, (a, b, _) in enumerate(rows):  # the first of equal pairs counts
            key, at = a * self.size + b, self._slot(np.array([a * self.size + b]))[0]
            while self._keys[at] not in (-1, key):
                at = (at + 1) & self._mask
            if self._keys[at] == -1:
                self._keys[at], self._ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        there = self._keys[at]
        out = np.where(there == keys, self._ranks[at], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            there = self._keys[at[open_]]
            same = there == keys[open_]
            out[open_[same]] = self._ranks[at[open_[same]]]
            open_ = open_[~same & (there != -1)]
        return out

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another; an id that isn't in the vocabulary has none."""
        return spread(self.blob, self.place[ids], self.width[ids])

    @cached_property
    def lookahead(self) -> int:
        """Bytes at the end of a buffer whose tokens may still change; see the module's text."""
        left_of: dict[int, int] = {}
        for a, _, made in self.merges.tolist():
            left_of.setdefault(made, a)
        longest: dict[int, int] = {}
        for a, b, _ in self.merges.tolist():
            most, t = 0, b
            while t is not None:
                most, t = max(most, longest.get(t, 0)), left_of.get(t)
            longest[a] = max(longest.get(a, 0), len(self.token_bytes[a]) + most)
        return max(longest.values(), default=0)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The token ids of all words, one after another, and where each word's begin (and the last's end)."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids, counts = self.merged(data, np.array([len(w) for w in words], dtype=np.int64))
        return ids, [0, *np.cumsum(counts).tolist()]

    def merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of words of these sizes, one after another, and how many each has."""
        ids, word = self.byte_ids[data], np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(ids), NONE, dtype=np.int32)  # of a token and the next
        rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(ids[:-1], ids[1:]), NONE)
        done_ids, done_words = [ids[:0]], [word[:0]]
        while len(ids):  # in each word all pairs of its lowest rank are merged
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            over = lowest == NONE
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                ids, word, rank, lowest = ids[~over], word[~over], rank[~over], lowest[~over]
                if not len(ids):
                    break
            hit = rank == lowest
            at = np.flatnonzero(hit)
            if (hit[1:] & hit[:-1]).any():  # equal tokens in a row: every other one, from the left of the run
                begins = np.r_[True, np.diff(at) != 1]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.merges[rank[at], 2]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))  # where the merged tokens are now
            rank[at] = NONE
            near = np.concatenate([at, at - 1])
            near = near[(near >= 0) & (near + 1 < len(ids))]
            rank[near] = np.where(word[near] == word[near + 1], self.ranks(ids[near], ids[near + 1]), NONE)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


class Run:
    """A word that comes in pieces: its tokens leave once they are stable, so the buffer stays bounded."""

    def __init__(self, merges: Merges):
        self.merges, self.buffer = merges, b""
        self.window = 2 * merges.lookahead + 512

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(piece), self.window):
            self.buffer += piece[k : k + self.window]
            if len(self.buffer) > self.window:
                settled, taken = len(self.buffer) - self.merges.lookahead, 0
                for i in self.merges.merge_words([self.buffer])[0].tolist():
                    if taken + len(self.merges.token_bytes[i]) > settled:
                        break
                    taken += len(self.merges.token_bytes[i])
                    out.append(i)
                self.buffer = self.buffer[taken:]
        return out

    def finish(self) -> list[int]:
        out, self.buffer = self.merges.merge_words([self.buffer])[0].tolist() if self.buffer else [], b""
        return out


class Encoder:
    """Texts to token ids, with the tokens of words seen before kept up to a bound."""

    #: Words kept, ids of all of them, and bytes of those longer than words.SHORT: some 50 MB in all, for each worker of
    #: an executor; bytes of the longest word merged with others; characters handled at once.
    KEPT, IDS, BYTES, LONG, PART = 480_000, 1_900_000, 1 << 23, 256, 1 << 18

    def __init__(self, merges: Merges):
        self.merges, self.table = merges, WordTable()
        self._forget()

    def _forget(self) -> None:
        self.table.clear()
        self.pool, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.first, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)

    def _learn(self, known: int, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Takes the ids of words whose rows follow those known."""
        size = end - begin
        short = size <= self.LONG
        ids, counts = self.merges.merged(spread(data, begin[short], size[short]), size[short])
        if not short.all():
            parts, at = [], 0
            sizes = iter(counts.tolist())
            for plain, a, b in zip(short.tolist(), begin.tolist(), end.tolist(), strict=True):
                if plain:
                    n = next(sizes)
                    parts.append(ids[at : at + n])
                    at += n
                else:
                    run = Run(self.merges)
                    parts.append(np.array([*run.feed(data[a:b].tobytes()), *run.finish()], dtype=np.int32))
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        stop = known + len(begin)
        self.pool = _roomy(self.pool, self.used, self.used + len(ids))
        self.first, self.size = _roomy(self.first, known, stop), _roomy(self.size, known, stop)
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[known:stop] = counts
        self.first[known:stop] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def of_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        if self.table.n > self.KEPT or self.used > self.IDS or self.table.long_bytes > self.BYTES:
            self._forget()
        known = self.table.n
        rows, new = self.table.rows(data, begin, end)
        if len(new):
            self._learn(known, data, begin[new], end[new])
        sizes = self.size[rows]
        return spread(self.pool, self.first[rows], sizes), sizes

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        names = self.merges.special
        pieces: list[str] = []
        owner, name = [], []  # the text that a piece is of, and the special token behind it
        for k, text in enumerate(texts):
            split = self.merges.special_pattern.split(text) if any(s in text for s in names) else [text]
            pieces += split[::2]
            owner += [k] * len(split[::2])
            name += [*(names[s] for s in split[1::2]), -1]
        data, edges = joined([p.encode("utf-8", "surrogatepass") for p in pieces])
        begin = word_starts(data, edges)
        ids, sizes = self.of_words(data, begin, np.append(begin[1:], edges[-1]))
        before = np.append(0, np.cumsum(sizes))[np.searchsorted(begin, edges)]
        counts, named = np.diff(before), np.array(name, dtype=np.int32)
        has = np.flatnonzero(named >= 0)
        if len(has):
            ids = np.insert(ids, before[1:][has], named[has])
            counts[has] += 1
            counts = np.bincount(owner, counts, minlength=len(texts)).astype(np.int64)
        return ids, counts

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each text its ids, as stretches in order."""
        ids, counts = self.ids(texts)
        ends = np.cumsum(counts).tolist()
        return [[ids[a:b]] for a, b in zip([0, *ends], ends, strict=False)]

    def stream(self, texts: list[str]):
        """(places of texts, their ids one after another, how many each has), so that every text's ids come in order.

        Texts of up to PART characters come together; a longer one goes through a transducer, PART at a time, and its
        ids come as they are stable.
        """
        short = [k for k, t in enumerate(texts) if len(t) <= self.PART]
        if short:
            yield (short, *self.ids([texts[k] for k in short]))
        for k, text in enumerate(texts):
            if len(text) > self.PART:
                one = Stream(self)
                for at in range(0, len(text), self.PART):
                    ids = one.feed(text[at : at + self.PART])
                    yield [k], np.array(ids, dtype=np.int32), np.array([len(ids)])
                ids = one.finish()
                yield [k], np.array(ids, dtype=np.int32), np.array([len(ids)])


def _roomy(values: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """values, in an array of twice the room if they are to be more than it holds."""
    if wanted <= len(values):
        return values
    out = np.zeros(max(wanted, 2 * len(values)), dtype=values.dtype)
    out[:used] = values[:used]
    return out


class Stream:
    """One text that comes in pieces: feed() gives the ids that are stable, finish() the rest.

    Held are at most two unfinished words, and of a longer run of one kind of character what the lookahead needs.
    A special token's name is looked for as long as the held text can be its beginning.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.merges, self.held = encoder, encoder.merges, ""
        self.run: Run | None = None
        self.kind = OTHER

    def _plain(self, text: str, last: bool) -> list[int]:
        """Ids of the settled words of text; what isn't settled is held."""
        out: list[int] = []
        raw = text.encode("utf-8", "surrogatepass")
        if self.run is not None:
            other = np.flatnonzero(kinds(np.frombuffer(raw, dtype=np.uint8)) != self.kind)
            end = int(other[0]) if len(other) else len(raw)
            if self.kind == SPACE and end and not (last and end == len(raw)):
                end = _before_last(raw, end)  # it belongs to what follows, or may
            out += self.run.feed(raw[:end])
            if not len(other) and not last:
                self.held = raw[end:].decode("utf-8", "surrogatepass")
                return out
            out += self.run.finish()
            self.run, raw = None, raw[end:]
        data, edges = joined([raw])
        begin = word_starts(data, edges)
        end = np.append(begin[1:], len(raw))
        settled = len(begin) if last else max(0, len(begin) - 2)
        long = settled < len(begin) and end[-1] - begin[-1] > self.encoder.LONG
        if long:
            settled = len(begin) - 1
        out += self.encoder.of_words(data, begin[:settled], end[:settled])[0].tolist()
        rest = raw[begin[settled] if settled < len(begin) else len(raw) :]
        if long:
            self.kind, self.run = int(kinds(data[: len(raw)])[-1]), Run(self.merges)
            cut = _before_last(rest, len(rest)) if self.kind == SPACE else len(rest)
            out += self.run.feed(rest[:cut])
            rest = rest[cut:]
        self.held = rest.decode("utf-8", "surrogatepass")
        return out

    def feed(self, piece: str) -> list[int]:
        return self._take(self.held + piece, False)

    def finish(self) -> list[int]:
        return self._take(self.held, True)

    def _take(self, text: str, last: bool) -> list[int]:
        self.held, out = "", []
        pieces = self.merges.special_pattern.split(text) if self.merges.special else [text]
        for name_at in range(1, len(pieces), 2):
            out += self._plain(pieces[name_at - 1], True) + [self.merges.special[pieces[name_at]]]
        rest, back = pieces[-1], 0
        if not last:
            back = max((k for s in self.merges.special for k in range(1, len(s)) if rest.endswith(s[:k])), default=0)
        rest, maybe = rest[: len(rest) - back], rest[len(rest) - back :]
        out += self._plain(rest, last)
        self.held += maybe
        return out


def _before_last(raw: bytes, end: int) -> int:
    """Where the character begins that ends at `end`."""
    end -= 1
    while raw[end] & 0xC0 == 0x80:
        end -= 1
    return end


class Decoder:
    """Token ids to text, a piece at a time: bytes wait until they make a character; what can't becomes U+FFFD."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.take(self.merges.bytes_of(np.asarray(ids, dtype=np.int64)).tobytes())

    def take(self, raw: bytes) -> str:
        """The text of bytes of tokens."""
        return self.state.decode(raw)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out
