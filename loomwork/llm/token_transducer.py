"""A subword tokenizer compiled to a deterministic transducer.

A rank-ordered BPE gives a string the only token sequence whose neighbouring tokens, taken two by
two, would each be left as they are by the merges. So the tokens of every prefix of a word follow
from the last tokens of its shorter prefixes, and what must be remembered of those is finite: for
each earlier position from which some vocabulary entry could still continue, the place reached in
the vocabulary trie, the last token of the prefix before it and how many tokens fewer it has.
That tuple is a state; states and transitions are made when first needed and kept. A transition
carries the number of tokens by which the prefix's count changes (it may be negative) and the last
token of the longer prefix. The last symbol of a word is another letter of the alphabet ("d</w>"
instead of "d"), so the state lags one symbol behind the input.

Around it stands the splitter, whose state is the kind of characters the current piece consists of.
White space always leads back to the start state, so the state map of a chunk is short: the entry
state matters up to the chunk's first white space (head) alone, and from there on the exit state
and the number of tokens are fixed. Maps compose associatively (the exit state of one goes through
the head of the next); `scan` combines them as a balanced tree. Chunks end before ASCII characters,
where no normalisation reaches across.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

END = "</w>"
#: States kept; a table that is full starts anew.
MAX_STATES = 200_000
#: So few words of more than as many symbols left are finished one by one.
FEW = 32
#: Characters of a chunk; it ends before the next ASCII character, which never combines with one before.
CHUNK = 1 << 13
#: Bytes of text whose words are looked up together, and texts whose ids are put together at once.
WINDOW_BYTES, GATHER = 8 << 20, 400
_ALL, _SPREAD = (1 << 64) - 1, 0x9E3779B97F4A7C15
_ASCII = re.compile(r"[\x00-\x7f]")
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The contractions split off, then letters, single digits and the rest.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\n\p{L}\p{N}]+|\n")
_RUNS = {"l": regex.compile(r"\p{L}+"), "o": regex.compile(r"[^\p{L}\p{N}]+")}
_HALF = ("'r", "'v", "'l")
#: Kinds of ASCII characters: 0 letters, 1 digits, 2 line feed, 3 the rest.
_KIND = np.array([0 if chr(c).isalpha() else 1 if chr(c).isdigit() else 2 if c == 10 else 3 for c in range(128)], np.uint8)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free
    code point from 256."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordTransducer:
    """Counts and lists the tokens of words. Many words advance in lockstep, one symbol at a time;
    a transition that is still missing is made first. A symbol is a byte, plus 256 for the last one
    of a word. Transitions stand in an open-addressed table of (state, symbol), which takes memory
    for those that were made alone."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        by_text = {pair: r for r, pair in enumerate(merges)}
        letters = byte_letters()
        symbol_of = {c + END * end: b + 256 * end for b, c in enumerate(letters) for end in (False, True)}
        top = max(vocab.values()) + 1
        #: the merge of two tokens, by (left << 20 | right), and each token's last merge
        self.ranks = {vocab[a] << 20 | vocab[b]: r for (a, b), r in by_text.items() if a in vocab and b in vocab}
        self.left, self.right, self.taken = [-1] * top, [-1] * top, [0] * top
        #: the trie of the vocabulary: (node << 9 | symbol) to node; the token and the children of a node
        self.trie: dict[int, int] = {}
        self.token_at, self.inner = [-1], bytearray(1)
        self.length = np.zeros(top, np.int64)
        for token, number in vocab.items():
            marked = token.endswith(END) and len(token) > len(END)
            symbols = [*token[: -len(END) - 1], token[-len(END) - 1 :]] if marked else list(token)
            if len(symbols) > 1:
                left, right = _last_merge(symbols, by_text)
                if left + right != token:
                    continue  # the merges never produce it
                self.left[number], self.right[number], self.taken[number] = vocab[left], vocab[right], by_text[left, right]
            node = 0
            for s in symbols:
                key = node << 9 | symbol_of[s]
                nxt = self.trie.get(key)
                if nxt is None:
                    nxt = self.trie[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = nxt
            self.token_at[node] = number
            self.length[number] = len(symbols)
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (0, -1, 0)
        #: a state: for each earlier position still open the trie's node, the last token, the depth
        self.states = [start]
        self.numbers = {start: 0}
        self.fits.clear()
        self._allot(16)

    def _allot(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.key = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.emit = np.zeros(1 << bits, np.int8)
        self.last = np.zeros(1 << bits, np.uint16 if len(self.length) < 65536 else np.int32)

    def _fit(self, a: int, b: int) -> bool:
        """True if the merges leave token a followed by token b as they are: no merge across the
        border outranks those that take up the parts beside it."""
        pair = a << 20 | b
        known = self.fits.get(pair)
        if known is None:
            known = True
            xs, ys = self._spine(a, self.right), self._spine(b, self.left)
            i, j, ranks = len(xs) - 1, len(ys) - 1, self.ranks
            while True:
                (x, taken_x), (y, taken_y) = xs[i], ys[j]
                rank = ranks.get(x << 20 | y)
                if rank is not None and rank < taken_x and rank <= taken_y:
                    known = False
                    break
                if i == 0 and j == 0:
                    break
                if taken_x <= taken_y:
                    i -= 1
                else:
                    j -= 1
            if len(self.fits) > MAX_STATES:
                self.fits.clear()
            self.fits[pair] = known
        return known

    def _spine(self, token: int, side: list[int]) -> list[tuple[int, int]]:
        """The parts of a token that touch its left or right end while it is merged, the whole
        first, each with the rank of the merge that takes it up."""
        found, above = [], 1 << 40
        while token >= 0:
            found.append((token, above))
            above, token = self.taken[token], side[token]
        return found

    def _number(self, state: tuple) -> int:
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        return to

    def _made(self, number: int, symbol: int) -> tuple[int, int, int]:
        """A transition: next state, change of the count, last token."""
        state, get, token_at, fits = self.states[number], self.trie.get, self.token_at, self.fits
        chosen, depth, moved = -1, 0, []
        for i in range(0, len(state), 3):  # longest candidate first
            nxt = get(state[i] | symbol)
            if nxt is None:
                continue
            last = state[i + 1]
            moved.append((nxt, last, state[i + 2]))
            if chosen < 0:
                token = token_at[nxt]
                if token >= 0:
                    if last >= 0:
                        fit = fits.get(last << 20 | token)
                        if fit is None:
                            fit = self._fit(last, token)
                        if not fit:
                            continue
                    chosen, depth = token, state[i + 2] + 1
        if chosen < 0:
            raise ValueError(f"the vocabulary cannot spell {symbol & 255:#x}")
        if symbol >= 256:
            return 0, depth, chosen
        inner, after = self.inner, []
        for node, last, d in moved:
            if inner[node]:
                after += (node << 9, last, d - depth)
        after += (0, chosen, 0)
        return self._number(tuple(after)), depth, chosen

    def _store(self, keys: np.ndarray, made: list[tuple[int, int, int]]) -> None:
        """Put new transitions into the table, which doubles when it is half full."""
        while 2 * (self.used + len(keys)) > len(self.key):
            old, full = (self.key, self.next, self.emit, self.last), np.flatnonzero(self.key >= 0)
            self._allot(self.bits + 1)
            at = self._free(old[0][full])
            self.next[at], self.emit[at], self.last[at] = (x[full] for x in old[1:])
            self.used = len(full)
        at = self._free(keys)
        self.next[at], self.emit[at], self.last[at] = np.array(made, np.int64).T
        self.used += len(keys)

    def _free(self, keys: np.ndarray) -> np.ndarray:
        """A place for each of these keys, none of which was in the table yet."""
        slot, mask = (keys.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64), len(self.key) - 1
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.key[slot[free]] = keys[free]  # of several for one place the last one has it
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = slot[todo] + 1 & mask
        return slot

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or -1."""
        slot, mask = (keys.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64), len(self.key) - 1
        here = self.key[slot]
        todo = np.flatnonzero((here != keys) & (here >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & mask
            here[todo] = self.key[slot[todo]]
            todo = todo[(here[todo] != keys[todo]) & (here[todo] >= 0)]
        slot[here < 0] = -1
        return slot

    def _along(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The transitions of these states at these symbols; missing ones are made."""
        keys = state << 9 | symbols
        slot = self._find(keys)
        missing = slot < 0
        if missing.any():
            new = np.unique(keys[missing])
            self._store(new, [self._made(key >> 9, key & 511) for key in new.tolist()])
            slot = self._find(keys)
        return slot

    def step(self, number: int, symbol: int) -> int:
        """The place of one transition."""
        key, mask = number << 9 | symbol, len(self.key) - 1
        slot = (key * _SPREAD & _ALL) >> (64 - self.bits)
        while (here := self.key[slot]) != key:
            if here < 0:
                self._store(np.array([key], np.int64), [self._made(number, symbol)])
                return int(self._find(np.array([key], np.int64))[0])
            slot = slot + 1 & mask
        return slot

    def walk(self, number: int, data: bytes) -> tuple[int, int]:
        """From a state along inner symbols of a word: the state reached and the change of count."""
        n = 0
        for byte in data:
            slot = self.step(number, byte)
            n += int(self.emit[slot])
            number = int(self.next[slot])
        return number, n

    def end(self, number: int, byte: int) -> int:
        """The change of count at a word's last symbol."""
        return int(self.emit[self.step(number, byte + 256)])

    def _finish(self, data: np.ndarray, state: int, at: int, stop: int, tokens: np.ndarray | None) -> int:
        """The rest of one word, symbol by symbol: long words are too few to go in lockstep."""
        n, rest = 0, data[at:stop].tolist()
        rest[-1] += 256
        for symbol in rest:
            if len(self.states) > 4 * MAX_STATES:  # a word of many states: only the current one stays
                now = self.states[state]
                self.reset()
                state = self._number(now)
            slot = self.step(state, symbol)
            n += int(self.emit[slot])
            if tokens is not None:
                tokens[at] = self.last[slot]
                at += 1
            state = int(self.next[slot])
        return n

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Words are data[start : start + length], not empty. Returns the tokens of each; with
        want_ids also the last token of the prefix ending at each byte, and a mark at the last byte
        of each token of the word."""
        if len(self.states) > MAX_STATES:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order].astype(np.int64), lengths[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        tokens = np.zeros(len(data), np.int32) if want_ids else None
        longest = int(size[0]) if len(size) else 0
        symbols = data.astype(np.int16)
        symbols[starts + lengths - 1] += 256
        for k in range(longest):
            live = int(np.searchsorted(-size, -(k + 1), side="right"))
            if live <= FEW and size[0] - k > FEW:
                for i in range(live):
                    count[i] += self._finish(data, int(state[i]), int(begin[i]) + k, int(begin[i] + size[i]), tokens)
                    if len(self.states) > MAX_STATES:  # the others' states have gone with it
                        for j in range(i + 1, live):
                            state[j], _ = self.walk(0, data[begin[j] : begin[j] + k].tobytes())
                break
            at = begin[:live] + k
            slot = self._along(state[:live], symbols[at])
            count[:live] += self.emit[slot]
            if want_ids:
                tokens[at] = self.last[slot]
            state[:live] = self.next[slot]
        result = np.zeros(len(order), np.int64)
        result[order] = count
        if not want_ids:
            return result, None, None
        mark = np.zeros(len(data), bool)
        at, begin = starts + lengths, starts
        while len(at):
            mark[at - 1] = True
            at = at - self.length[tokens[at - 1]]
            alive = at > begin
            at, begin = at[alive], begin[alive]
        return result, tokens, mark


def _last_merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> tuple[str, str]:
    """Merge by rank, as defined; returns the two parts of the last merge, or empty strings."""
    parts = list(symbols)
    while len(parts) > 2:
        best = min(ranks.get(p, 1 << 40) for p in zip(parts, parts[1:]))
        if best == 1 << 40:
            return "", ""
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return (parts[0], parts[1]) if len(parts) == 2 and tuple(parts) in ranks else ("", "")


class Place(NamedTuple):
    """A state of the whole machine within a stretch without white space. mode: "" between words,
    "l" in letters, "o" in other characters, "a" after an apostrophe that a contraction may begin
    with. number: the word transducer's state before the last symbol; held: the UTF-8 bytes that it
    has not read yet (one in a word, all in mode "a")."""

    mode: str
    number: int
    held: bytes


START = Place("", 0, b"")


class ChunkMap(NamedTuple):
    """The state map of a chunk. head: what it reads before its first white space, from whatever
    state; after that it counts `count` tokens and ends in state `exit`, whatever the entry was.
    Without white space there is only head (open)."""

    head: str
    count: int
    exit: Place
    open: bool


class TextTokenizer:
    """The compiled tokenizer of a tokenizers JSON file with byte-level BPE and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError(f"{path} is not a lower-casing byte-level BPE with word ends")
        self.words = WordTransducer(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    # --- normaliser and splitter -------------------------------------------------------------
    def _cut(self, fields: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words of the fields, their starts and lengths, and each one's field."""
        data, lengths, owner = [], [], []
        ascii_only = np.fromiter(map(str.isascii, fields), bool, len(fields))
        for group, plain in ((np.flatnonzero(ascii_only), True), (np.flatnonzero(~ascii_only), False)):
            if not len(group):
                continue
            joined = self._plain("\n".join(map(fields.__getitem__, group.tolist())))
            raw = np.frombuffer(joined.encode(), np.uint8)
            if plain:
                starts = _ascii_pieces(raw)
                size = np.diff(starts, append=len(raw))
            else:
                found = _PIECES.findall(joined)
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
                ends = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[ends]
                size = np.diff(ends, prepend=0)
                starts = ends - size
            gap = raw[starts] == 10
            data.append(raw[np.repeat(~gap, size)])
            lengths.append(size[~gap])
            owner.append(group[np.cumsum(gap)[~gap]])
        if not data:
            return (np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 3)
        lengths = np.concatenate(lengths)
        return np.concatenate(data), np.cumsum(lengths) - lengths, lengths, np.concatenate(owner)

    def _fields(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split() alone
            return [x for x in _SPACES.split(text) if x]
        return text.split()

    def word_counts(self, fields: list[str]) -> np.ndarray:
        """The number of tokens of each field, all in lockstep."""
        data, starts, lengths, owner = self._cut(fields)
        return np.bincount(owner, self.words.run(data, starts, lengths, False)[0], len(fields)).astype(np.int64)

    def word_ids(self, fields: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each field, and all ids in the fields' order."""
        data, starts, lengths, owner = self._cut(fields)
        counts, tokens, mark = self.words.run(data, starts, lengths, True)
        order, flat = np.argsort(owner, kind="stable"), tokens[mark]  # the words of a field stand together and in order
        if len(order) and (np.diff(order) != 1).any():
            begin, per = np.cumsum(counts) - counts, counts[order]
            flat = flat[np.repeat(begin[order] - (np.cumsum(per) - per), per) + np.arange(len(flat))]
        return np.bincount(owner, counts, len(fields)).astype(np.int64), flat.astype("<u4")

    # --- chunk maps --------------------------------------------------------------------------
    def _plain(self, text: str) -> str:
        """Normalised text. Lower case character by character: no final sigma."""
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def _pieces_count(self, pieces: list[str]) -> int:
        return sum(self.words.end(*self._into(p)[:2]) + self._into(p)[2] for p in pieces)

    def _into(self, piece: str) -> tuple[int, int, int]:
        """A word but for its last symbol: the state reached, that symbol, the count so far."""
        raw = piece.encode()
        number, n = self.words.walk(0, raw[:-1])
        return number, raw[-1], n

    def advance(self, place: Place, text: str) -> tuple[Place, int]:
        """Read normalised text without white space from a state on: the state reached and the
        tokens counted; those of a word count when the next one begins."""
        n, at = 0, 0
        if place.mode == "a":
            text, place = place.held.decode() + text, START
        if place.mode:
            run = _RUNS[place.mode].match(text)
            if run is not None:
                raw = place.held + run[0].encode()
                number, n = self.words.walk(place.number, raw[:-1])
                place, at = Place(place.mode, number, raw[-1:]), run.end()
            if at == len(text):
                return place, n
            n += self.complete(place)
        pieces = _PIECES.findall(text, at)
        last = pieces.pop()
        if last == "'" or (pieces and pieces[-1] == "'" and "'" + last in _HALF):
            held = last if last == "'" else pieces.pop() + last
            return Place("a", 0, held.encode()), n + self._pieces_count(pieces)
        n += self._pieces_count(pieces)
        number, byte, more = self._into(last)
        if last[0].isalpha() and _RUNS["l"].match(last):
            return Place("l", number, bytes([byte])), n + more
        if len(last) > 1 and last[0] == "'" and last[1].isalpha() or not _RUNS["o"].match(last):  # a contraction, a digit
            return START, n + more + self.words.end(number, byte)
        return Place("o", number, bytes([byte])), n + more

    def complete(self, place: Place) -> int:
        """The tokens still to be counted where the text or the word ends in this state."""
        if place.mode == "a":
            return self._pieces_count(_PIECES.findall(place.held.decode()))
        return self.words.end(place.number, place.held[0]) if place.mode else 0

    def _through(self, entry: Place, head: str) -> tuple[Place, int]:
        return self.advance(entry, head) if head else (entry, 0)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b: a's exit state goes through b's head."""
        if a.open:
            return ChunkMap(a.head + b.head, b.count, b.exit, b.open)
        place, n = self._through(a.exit, b.head)
        if b.open:
            return ChunkMap(a.head, a.count + n, place, False)
        return ChunkMap(a.head, a.count + n + self.complete(place) + b.count, b.exit, False)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Combine maps pairwise, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def _cuts(self, text: str, chunk: int) -> list[str]:
        """Chunks of at least `chunk` characters that end before an ASCII character."""
        out, at = [], 0
        while at < len(text):
            found = _ASCII.search(text, at + chunk)
            stop = found.start() if found else len(text)
            out.append(text[at:stop])
            at = stop
        return out

    def _sides(self, chunk: str) -> tuple[str, list[str], str, bool]:
        """Head, whole words between, tail, and whether the map is open."""
        first = _SPACES.search(chunk)
        if first is None:
            return self._plain(chunk), [], "", True
        last = len(chunk)
        while not _SPACES.match(chunk, last - 1):
            last -= 1
        return self._plain(chunk[: first.start()]), self._fields(chunk[first.end() : last]), self._plain(chunk[last:]), False

    # --- texts -------------------------------------------------------------------------------
    def _parts(self, text: str) -> list[str]:
        return self._special.split(text) if "<|" in text else [text]

    def _words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Texts as places among their distinct words (an empty one may be among them): where each
        text begins and ends, all places, and the words."""
        lists = pc.utf8_split_whitespace(texts)
        encoded = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), encoded.indices.to_numpy(), encoded.dictionary.to_pylist()

    def _plain_ones(self, texts: pa.Array, longest: int | None) -> np.ndarray:
        """Which texts hold no special token, no character that is white space for the splitter's
        library alone, and at most so many characters."""
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\x1c-\x1f]"))
        if longest is not None:
            odd = pc.or_(odd, pc.greater(pc.utf8_length(texts), longest))
        return ~odd.to_numpy(zero_copy_only=False)

    def count_texts(self, texts: list[str] | pa.Array, chunk: int = CHUNK) -> list[int]:
        """Tokens of each text: the state maps of its chunks, then one scan over them. A text of
        one chunk has whole words only."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        plain = self._plain_ones(column, chunk)
        n = np.zeros(len(column), np.int64)
        starts, places, words = self._words_of(column.filter(pa.array(plain)))
        sums = np.concatenate([[0], np.cumsum(self.word_counts(words)[places])]) if len(words) else np.zeros(1, np.int64)
        n[plain] = sums[starts[1:]] - sums[starts[:-1]]
        rest = np.flatnonzero(~plain)
        n[rest] = self._count_odd(column.take(pa.array(rest)).to_pylist(), chunk)
        return n.tolist()

    def _count_odd(self, texts: list[str], chunk: int) -> list[int]:
        cut, fields, n = [], set(), [0] * len(texts)
        for i, text in enumerate(texts):
            for part in self._parts(text):
                if part in self.special:
                    n[i] += 1
                elif part:
                    cut.append((i, chunks := [self._sides(c) for c in self._cuts(part, chunk)]))
                    for _, inner, _, _ in chunks:
                        fields.update(inner)
        inner_words = list(fields)
        known = dict(zip(inner_words, self.word_counts(inner_words).tolist())).__getitem__
        for i, chunks in cut:
            maps = []
            for head, inner, tail, open_ in chunks:
                place, more = self._through(START, tail)
                maps.append(ChunkMap(head, more + sum(map(known, inner)), place, open_))
            total = self.scan(maps)
            place, more = self._through(START, total.head)
            n[i] += more + self.complete(place) + (0 if total.open else total.count + self.complete(total.exit))
        return n

    def codes_of_texts(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        plain = self._plain_ones(column, None)
        out: list[bytes] = [b""] * len(column)
        starts, places, words = self._words_of(column.filter(pa.array(plain)))
        if len(words):
            size, ids = self.word_ids(words)
            begin, per = (np.cumsum(size) - size)[places], size[places]
            stops = np.concatenate([[0], np.cumsum(per)])
            edge = stops[starts]
            rows = np.flatnonzero(plain)
            for k in range(0, len(rows), GATHER):  # a part of the texts at a time
                a, b = int(starts[k]), int(starts[min(k + GATHER, len(rows))])
                flat = ids[np.repeat(begin[a:b] - (stops[a:b] - stops[a]), per[a:b]) + np.arange(int(stops[b] - stops[a]))].tobytes()
                cut = (4 * (edge[k : k + GATHER + 1] - stops[a])).tolist()
                for i, x, y in zip(rows[k : k + GATHER].tolist(), cut, cut[1:]):
                    out[i] = flat[x:y]
        rest = np.flatnonzero(~plain).tolist()
        for i, code in zip(rest, self._codes_odd(column.take(pa.array(rest, pa.int64())).to_pylist())):
            out[i] = code
        return out

    def _codes_odd(self, texts: list[str]) -> list[bytes]:
        parts = [[(p, None if p in self.special else self._fields(p)) for p in self._parts(t)] for t in texts]
        words = list({f for text in parts for _, fields in text for f in fields or ()})
        size, ids = self.word_ids(words)
        raw, stop = ids.tobytes(), (4 * np.cumsum(size)).tolist()
        known = {w: raw[a:b] for w, a, b in zip(words, [0, *stop], stop)}
        return [b"".join(b"".join(map(known.__getitem__, fields)) if fields is not None else self.special[p].to_bytes(4, "little") for p, fields in text) for text in parts]


def _ascii_pieces(raw: np.ndarray) -> np.ndarray:
    """Where the pieces of lower-case ASCII text begin: as _PIECES would split it."""
    kind = _KIND[raw]
    begins = np.ones(len(raw), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1) | (kind[1:] == 2)
    at = np.flatnonzero(begins & (raw == 39))
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    one, two = padded[at + 1], padded[at + 2]
    short = at[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    long_ = at[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]  # re, ve, ll
    for place, size in ((short, 2), (long_, 3)):
        begins[place + 1] = False
        after = place + size
        begins[after[after < len(raw)]] = True
    return np.flatnonzero(begins)


@lru_cache(maxsize=4)
def compiled(path: str) -> TextTokenizer:
    """The compiled tokenizer of a file, once per Python process; it keeps vocabulary and states."""
    return TextTokenizer(path)


def windows(batches: Iterator[pa.RecordBatch], column: int, size: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to so many bytes of text: a word costs once per window."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, GATHER):
            held.append(b.slice(at, GATHER))
            n += pc.sum(pc.binary_length(held[-1].column(column))).as_py() or 0
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
