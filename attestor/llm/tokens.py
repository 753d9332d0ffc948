"""Exact encoding by a public tokenizer, with a bounded cache of white-space-delimited chunks."""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np

#: ASCII that is neither letter, digit nor white space.
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Of each byte: 0 for white space, 1 for an ASCII letter or digit, 2 for an ASCII sign, 3 for any other.
KIND = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if chr(b).isalnum() and b < 128 else 2 if b in _SIGNS else 3 for b in range(256)], np.uint8)
#: The longest chunk whose bytes and length make two integers.
SHORT = 15
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)], np.uint64)
#: The signs for bytes that byte-level vocabularies use: printable Latin-1 stands for itself, the rest follow from 256 on.
_ITSELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _ITSELF)}
DEFAULT = "word_bpe_49k.json"
_encoders: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def pairs_of(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers that hold the bytes (at most SHORT) at starts, and their number."""
    words = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    return words[starts] & _LOW[length], words[starts + 8] & _HIGH[length] | (length << 56).astype(np.uint64)


def _spread(at: np.ndarray, more: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(at) + len(more), np.int64)
    out[at], out[more] = a, b
    return out


class ShortTable:
    """Pairs of integers -> index, by open addressing over arrays, so that many are looked up at once."""

    def __init__(self, entries: int):
        self.least = max(10, (2 * entries).bit_length() - 1)
        self.clear()

    def clear(self) -> None:
        self._make(self.least)

    def _make(self, bits: int) -> None:
        self.bits, self.count, n = bits, 0, 1 << bits
        self.low, self.high, self.index = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        return (((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The index of each pair, or -1."""
        slot = self._slots(low, high)
        out = self.index[slot]
        todo = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.index) - 1)
            out[todo] = self.index[slot]
            other = (out[todo] >= 0) & ((self.low[slot] != low[todo]) | (self.high[slot] != high[todo]))
            todo, slot = todo[other], slot[other]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, index: np.ndarray) -> None:
        """Distinct pairs that aren't in the table yet, with distinct indexes."""
        if (self.count + len(low)) * 4 > 3 << self.bits:
            had = self.index >= 0
            old = self.low[had], self.high[had], self.index[had]
            self._make(max(self.bits + 1, (2 * (self.count + len(low))).bit_length()))
            self.add(*old)
        self.count += len(low)
        slot, todo = self._slots(low, high), np.arange(len(low))
        while len(todo):
            free = self.index[slot] < 0
            self.index[slot[free]] = index[todo[free]]  # of those that meet in a slot one stays
            mine = self.index[slot] == index[todo]
            self.low[slot[mine]], self.high[slot[mine]] = low[todo[mine]], high[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & (len(self.index) - 1)


class ChunkEncoder:
    """encode(texts) equals Tokenizer.encode(text, add_special_tokens=False).ids for each text.

    The vocabulary's pre-tokenizer never lets a token span white space, and its normalizer
    works character by character, so each chunk between ASCII white space encodes alone, and A-Z are as a-z.
    So do a chunk's ASCII signs at its end and what stands before them, if that ends in a letter or digit.
    Chunks recur, so their ids are kept in one pool; the cache starts afresh at its limit. A lower-case word of
    letters alone goes straight to the vocabulary's merges, as nothing would change or part it before them.
    Only DEFAULT has these rules; with another file every text is encoded whole.
    """

    def __init__(self, path: str | None = None, entries: int = 1_000_000, pool: int = 8_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.by_chunk = path is None or os.path.basename(path) == DEFAULT
        self.special = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.entries, self.pool_limit = entries, pool
        self.short = ShortTable(entries)
        self._clear()

    def _clear(self) -> None:
        self.long: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i]..ends[i + 1] is chunk i
        self.used = self.count = 0
        self.short.clear()

    def forget(self) -> None:
        """Drop the cache, and what it holds."""
        self._clear()

    def _find(self, joined: bytes, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The index of each chunk of joined (which ends in SHORT + 1 more bytes), or -1."""
        raw = np.frombuffer(joined, np.uint8)
        out = np.empty(len(starts), np.int64)
        brief, long = np.flatnonzero(length <= SHORT), np.flatnonzero(length > SHORT)
        out[brief] = self.short.find(*pairs_of(raw, starts[brief], length[brief]))
        out[long] = np.fromiter((self.long.get(joined[a : a + n], -1) for a, n in zip(starts[long].tolist(), length[long].tolist())), np.int64, len(long))
        return out

    def _indexes(self, names: list[bytes]) -> np.ndarray:
        length = np.fromiter(map(len, names), np.int64, len(names))
        return self._find(b"".join([*names, b" " * (SHORT + 1)]), np.cumsum(length) - length, length)

    def _add(self, chunks: list[bytes]) -> None:
        """Index new chunks: those that end in signs from their two parts, the others by the tokenizer."""
        whole, parted = {}, []
        for c in chunks:
            base = c.rstrip(_SIGNS)
            if len(base) == len(c) or not self._parts(c, base):
                whole[c] = None
            else:
                parted.append((c, base, c[len(base) :]))
        both = [x for _, *two in parted for x in two]
        whole.update(dict.fromkeys(both))
        names = list(whole)
        fresh = [names[i] for i in np.flatnonzero(self._indexes(names) < 0).tolist()]
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            found = [self._plain(c) for c in part]
            hard = [i for i, f in enumerate(found) if f is None]
            for i, e in zip(hard, self.tokenizer.encode_batch_fast([part[i].decode() for i in hard], add_special_tokens=False)):
                found[i] = e.ids
            self._keep(part, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(part)))
        if parted:
            ids, lengths = self._gather(self._indexes(both))
            self._keep([c for c, *_ in parted], ids, lengths.reshape(-1, 2).sum(axis=1))

    def _parts(self, chunk: bytes, base: bytes) -> bool:
        """Whether the signs after base are tokens of their own."""
        if not self.by_chunk or not base or any(s in chunk for s in self.special):
            return False
        if base.isascii():
            return base[-1:].isalnum()
        word = base.decode()
        return word[-1].isalnum() and word.lower() == word and unicodedata.is_normalized("NFC", word)

    def _keep(self, chunks: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        at, n = self.count, len(chunks)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while at + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.ends[at + 1 : at + n + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.count += n
        size = np.fromiter(map(len, chunks), np.int64, n)
        brief = np.flatnonzero(size <= SHORT)
        raw = np.frombuffer(b"".join([*chunks, b" " * (SHORT + 1)]), np.uint8)
        self.short.add(*pairs_of(raw, (np.cumsum(size) - size)[brief], size[brief]), (at + brief).astype(np.int32))
        self.long.update((chunks[i], at + i) for i in np.flatnonzero(size > SHORT).tolist())

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the indexed chunks in order, and how many each has."""
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        stops = np.cumsum(lengths)
        return self.pool[np.repeat(starts - stops + lengths, lengths) + np.arange(int(stops[-1]) if len(stops) else 0)], lengths

    def _plain(self, chunk: bytes) -> list[int] | None:
        """Ids of a lower-case word of letters; None for any other chunk."""
        if not self.by_chunk:
            return None
        word = chunk.decode()
        if not (chunk.isalpha() and chunk.islower()):  # ASCII
            if not word.isalpha() or word.lower() != word or not unicodedata.is_normalized("NFC", word):
                return None
            word = chunk.decode("latin-1").translate(_BYTE_SIGNS)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _split(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The index of each chunk of texts without special tokens, and how many chunks each text has."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        joined = b" ".join([b"", *(t or b"" for t in texts), b" " * (SHORT + 1)]).lower()
        raw = np.frombuffer(joined, np.uint8)
        kind = KIND[raw]
        edges = np.flatnonzero((kind[1:] != 0) != (kind[:-1] != 0)) + 1
        starts, stops = edges[::2], edges[1::2]
        sign = stops.copy()  # where the signs at a chunk's end begin, if there are a few of them
        for _ in range(4):
            sign -= (kind[sign - 1] == 2) & (sign > starts)
        cut = (sign < stops) & (kind[sign - 1] == 1)
        if cut.any():
            at = np.arange(len(starts)) + np.cumsum(cut) - cut
            more = at[cut] + 1
            starts, stops = _spread(at, more, starts, sign[cut]), _spread(at, more, np.where(cut, sign, stops), stops[cut])
        per_text = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1) + 1])))
        length = stops - starts
        out = self._find(joined, starts, length)
        if len(missing := np.flatnonzero(out < 0)):
            self._add(sorted({joined[a:z] for a, z in zip(starts[missing].tolist(), stops[missing].tolist())}))
            out[missing] = self._find(joined, starts[missing], length[missing])
        return out, per_text

    def _whole(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """As _split, for texts that may hold special tokens (A-Z could turn into their letters) or another file's rules."""
        chunks = [[] if not t else t.split() if self.by_chunk else [t] for t in texts]
        names = sorted(set(chain.from_iterable(chunks)))
        self._add([names[i] for i in np.flatnonzero(self._indexes(names) < 0).tolist()])
        index = dict(zip(names, self._indexes(names).tolist()))
        at = [index[c] for c in chain.from_iterable(chunks)]
        return np.array(at, np.int64), np.fromiter(map(len, chunks), np.int64, len(chunks))

    def encode(self, texts: list[bytes | None], end: int | None = None, some: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of each text (one more than texts); end is appended to each text. Texts go `some`
        at a time, as what is held beside them is many times their size."""
        parts = [self._encode(texts[k : k + some], end) for k in range(0, len(texts), some)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        bounds = [np.zeros(1, np.int64), *(b[1:] + n for (_, b), n in zip(parts, before))]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate(bounds)

    def _encode(self, texts: list[bytes | None], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self.count > self.entries or self.used > self.pool_limit:
            self._clear()
        plain = self.by_chunk and not any(s in t for t in texts if t for s in self.special)
        at, per_text = (self._split if plain else self._whole)(texts)
        ids, lengths = self._gather(at)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per_text)])]
        if end is None:
            return ids, bounds
        out = np.empty(len(ids) + len(texts), np.uint32)
        stops = bounds[1:] + np.arange(len(texts))
        keep = np.ones(len(out), bool)
        keep[stops] = False
        out[keep], out[stops] = ids, end
        return out, bounds + np.arange(len(bounds))


def encoder(path: str | None = None) -> ChunkEncoder:
    """One for each path and worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
