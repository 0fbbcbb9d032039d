"""Token ids of whole texts by the tokenizers library, common words encoded once per worker and looked up in arrays after that."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from faultline.llm.shared import worker_state

#: Entries after which a worker's word table takes no more, and the share of words it may then lack before it is emptied.
CACHE_WORDS = 600_000
STALE = 0.25
SLOTS = 1 << 21
#: Text bytes whose words are looked up together.
LOOK_BYTES = 1 << 19
#: Eight-byte numbers that hold a word of the table. Longer words are encoded each time.
LANES = 3
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
CUT = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: ASCII punctuation: a run of it after letters is one unit. How many such runs are remembered.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHED_TAILS = 5_000
#: Words encoded in one call.
WORDS_A_CALL = 2_000
#: What byte-level vocabularies write for each byte: itself where it is printable, else the next character from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
HIDDEN = [b for b in range(256) if b not in PRINTABLE]
SHOWN = {b: b if b in PRINTABLE else 256 + HIDDEN.index(b) for b in range(256)}


def lowered(core: bytes) -> bytes | None:
    """``core`` in lower case if it is letters below U+0250 only, whose lower case does not depend on what is around."""
    text = core.decode(errors="replace")
    if text.isalpha() and max(text) < "ɐ" and "İ" not in text:
        return text.lower().encode()
    return None


class WordTable:
    """Ids by word, as arrays that are looked up for many words at once; a word is known by all its bytes and their number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.entries = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.size = self.n_ids = 0
        # zeros cost no memory before they are written
        self.words, self.ends = np.zeros((CACHE_WORDS, LANES + 1), np.uint64), np.zeros(CACHE_WORDS + 1, np.int64)
        self.ids = np.zeros(8 * CACHE_WORDS, np.uint32)

    @staticmethod
    def hashed(words: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(words), np.uint64)
        for lane, mixer in zip(words.T, MIXERS, strict=True):
            mixed ^= (lane ^ (lane >> np.uint64(29))) * mixer
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIXERS[0]
        return np.maximum(mixed ^ (mixed >> np.uint64(29)), np.uint64(1))  # zero marks free slots

    def find(self, words: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        hashes, out = self.hashed(words), np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        slots = (hashes % np.uint64(SLOTS)).astype(np.int64)
        while len(left):
            there = self.hashes[slots[left]]
            same = there == hashes[left]
            out[left[same]] = self.entries[slots[left[same]]]
            left = left[~same & (there != 0)]
            slots[left] = (slots[left] + 1) % SLOTS
        hit = np.flatnonzero(out >= 0)
        out[hit[(self.words[out[hit]] != words[hit]).any(axis=1)]] = -1
        return out

    def add(self, words: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Takes in distinct words that it lacks, CACHE_WORDS in all, with how many of ``ids`` each has."""
        n, m = len(words), len(ids)
        if self.n_ids + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(m, len(self.ids)), np.uint32)])
        self.words[self.size : self.size + n] = words
        self.ends[self.size + 1 : self.size + n + 1] = self.n_ids + np.cumsum(counts)
        self.ids[self.n_ids : self.n_ids + m] = ids
        hashes, left = self.hashed(words), np.arange(n)
        slots = (hashes % np.uint64(SLOTS)).astype(np.int64)
        while len(left):
            free = left[self.hashes[slots[left]] == 0]
            _, one = np.unique(slots[free], return_index=True)
            placed = free[one]
            self.hashes[slots[placed]], self.entries[slots[placed]] = hashes[placed], self.size + placed
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = (slots[left] + 1) % SLOTS
        self.size, self.n_ids = self.size + n, self.n_ids + m


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of the whole text in one call.

    White space separates the vocabulary's units and is dropped, so a text's ids are those of its ASCII-space separated
    words one after the other; A-Z count as a-z. Letters (below U+0250) are one unit each, as is punctuation after them;
    they go to the library many at a time, in the vocabulary's own characters, without the steps that leave them as they
    are, and are told apart by the end-of-word tokens. All other words go through the whole pipeline one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.last[number] = token.endswith("</w>")
        self.table = WordTable()
        self.tails = {b"": b""}

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(texts), WORDS_A_CALL):  # the library's results take far more than the ids in them
            encoded = self.whole.encode_batch_fast(texts[start : start + WORDS_A_CALL], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in encoded]
        return out

    def plain_ids(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(words), WORDS_A_CALL):
            joined = b"\n".join(words[start : start + WORDS_A_CALL])
            shown = joined.decode() if joined.isascii() else " ".join(w.decode("latin-1").translate(SHOWN) for w in joined.split(b"\n"))
            ids = np.array(self.plain.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def end_of(self, tail: bytes) -> bytes:
        end = self.tails.get(tail)
        if end is None:
            end = self.ids([tail.decode()])[0]
            if len(self.tails) < CACHED_TAILS:
                self.tails[tail] = end
        return end

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words (A-Z in lower case) that the table lacks."""
        plain: dict[bytes, list[bytes]] = {}
        other: list[bytes] = []
        for word in new:
            core = word.rstrip(MARKS)
            low = core if core.isalpha() else lowered(core)  # isalpha of bytes: ASCII letters only
            if low is None:
                other.append(word)
            else:
                plain.setdefault(low, []).append(word)
        found = dict(zip(other, self.ids([w.decode(errors="replace") for w in other]), strict=True))
        for ids, words in zip(self.plain_ids(list(plain)), plain.values(), strict=True):
            for word in words:
                found[word] = ids + self.end_of(word[len(word.rstrip(MARKS)) :])
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, looked up for about LOOK_BYTES of text at a time; a longer text is looked at part by part."""
        out: list[bytes] = []
        some: list[bytes] = []
        held = 0
        for text in texts:
            if len(text) > 2 * LOOK_BYTES:
                out += self.encode_together(some)
                out.append(b"".join(self.encode_together([part])[0] for part in parts_of(text)))
                some, held = [], 0
                continue
            some.append(text)
            held += len(text)
            if held >= LOOK_BYTES:
                out += self.encode_together(some)
                some, held = [], 0
        return out + self.encode_together(some)

    def encode_together(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        joined = b"\n".join(texts).lower() + b"\n" + bytes(8 * LANES)
        codes = np.frombuffer(joined, np.uint8)[: -8 * LANES]
        space = SPACE[codes]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        sizes = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]])) - starts
        eights = np.ndarray(len(codes) + 8 * (LANES - 1), "<u8", joined, strides=(1,))  # the eight bytes from each one on
        words = np.stack([eights[starts + 8 * k] & FIRST_BYTES[np.clip(sizes - 8 * k, 0, 8)] for k in range(LANES)] + [sizes.astype(np.uint64)], axis=1)
        entry = np.where(sizes <= 8 * LANES, self.table.find(words), -1)

        missing = np.flatnonzero(entry < 0)
        own = [joined[a : a + n] for a, n in zip(starts[missing].tolist(), sizes[missing].tolist(), strict=True)]
        place: dict[bytes, int] = {}
        first = []
        for i, word in zip(missing.tolist(), own, strict=True):
            if word not in place:
                place[word] = len(first)
                first.append(i)
        found = self.learn(set(place))
        learned = [found[word] for word in place]
        new_counts = np.fromiter(map(len, learned), np.int64, len(learned)) // 4
        new_ids = np.frombuffer(b"".join(learned), "<u4")

        table = self.table
        source = np.concatenate([table.ids[: table.n_ids], new_ids])
        ends = np.concatenate([table.ends[: table.size + 1], table.n_ids + np.cumsum(new_counts)])
        entry[missing] = table.size + np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        counts = ends[entry + 1] - ends[entry]
        upto = np.cumsum(counts)
        at = np.repeat(ends[entry] - upto + counts, counts) + np.arange(int(upto[-1]) if len(upto) else 0)
        data = source[at].astype("<u4", copy=False).tobytes()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        text_ends = np.concatenate([[0], upto])[np.searchsorted(starts, np.cumsum(lengths))] * 4
        self.remember(words[first], sizes[first], new_counts, new_ids, len(missing), len(starts))
        return [data[a:b] for a, b in zip([0, *text_ends[:-1].tolist()], text_ends.tolist(), strict=True)]

    def remember(self, words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, ids: np.ndarray, misses: int, seen: int) -> None:
        """Keeps new words until the table is full; a full one starts anew when it has stopped to fit the texts."""
        if self.table.size >= CACHE_WORDS and misses > STALE * seen:
            self.table.clear()
        if self.table.size < CACHE_WORDS and len(words):
            kept = (sizes <= 8 * LANES) & (np.arange(len(sizes)) < CACHE_WORDS - self.table.size)
            self.table.add(words[kept], counts[kept], ids[np.repeat(kept, counts)])


def parts_of(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about LOOK_BYTES, cut at white space."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + LOOK_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which outlives a task."""
    encoders = worker_state().setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]
