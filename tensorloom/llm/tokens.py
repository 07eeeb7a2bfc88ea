"""Token ids from public tokenizer files, fast enough for whole corpora.

White space never lies inside a token of the vocabulary used here, so texts are
cut at white space and each distinct chunk is encoded once; what is new is
encoded for a whole batch at a time by byte-pair merges in numpy. Texts with
characters outside a safe set go through the tokenizer library itself, so ids
always equal the library's.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Characters whose lower-casing and composition do not depend on the library: ASCII and the letters of Latin-1 and Latin Extended-A (but for U+0130).
SAFE = re.compile("[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ſ]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-ſ]+")
#: Characters of text handled at once, so that a huge text never becomes one huge list.
BLOCK = 1 << 19
#: Chunks whose ids a worker remembers, a block's new ones more; the table of their keys has 14 MB.
MEMO = 100_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class PairTable:
    """(left, right) -> (rank, merged id): open addressing in numpy arrays."""

    SIZE = 1 << 20

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.keys = np.full(self.SIZE, -1, np.int64)
        self.rank = np.full(self.SIZE, np.iinfo(np.int32).max, np.int32)
        self.merged = np.full(self.SIZE, -1, np.int32)
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        todo, place, self.probes = np.arange(len(keys)), self._home(keys), 1
        while len(todo):
            free = self.keys[place] == -1
            _, first = np.unique(place[free], return_index=True)
            won = np.nonzero(free)[0][first]
            self.keys[place[won]] = keys[todo[won]]
            self.rank[place[won]] = rank[todo[won]]
            self.merged[place[won]] = merged[todo[won]]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, place = todo[stay], (place[stay] + 1) % self.SIZE
            self.probes += bool(len(todo))

    @classmethod
    def _home(cls, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs; of pairs that don't merge, a place whose rank is the largest number."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        place = self._home(keys)
        for _ in range(self.probes):
            got = self.keys[place]
            wrong = (got != keys) & (got != -1)
            if not wrong.any():
                break
            place = np.where(wrong, (place + 1) % self.SIZE, place)
        return np.where(self.keys[place] == keys, place, self.none)

    @property
    def none(self) -> int:
        if not hasattr(self, "_none"):
            self._none = int(np.nonzero(self.keys == -1)[0][0])
        return self._none


class WordTokenizer:
    """Ids of texts under a lower-casing byte-pair vocabulary with word ends; add_special_tokens is False."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.fast = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"]
        if not self.fast:
            return
        vocab, letters = model["vocab"], _byte_letters()
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids), dtype=np.int32), ids[:, 2].astype(np.int32))
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.flat, self.start, self.size, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chunks = ChunkTable()
        self.long: dict[bytes, int] = {}

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word: again and again, in all words at once, the pair of lowest rank, leftmost first."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        out_n = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(length[order]))[0] + 1):
            n = int(length[rows[0]]) if len(rows) else 0
            if not n:
                continue
            raw = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(-1, n)
            s = self.inner[raw]
            s[:, -1] = self.final[raw[:, -1]]
            live, count = rows, n
            while True:
                if count > 1:
                    place = self.pairs.find(s[:, :-1], s[:, 1:])
                    rank = self.pairs.rank[place]
                    at = rank.argmin(axis=1)
                    row = np.arange(len(s))
                    some = rank[row, at] != np.iinfo(np.int32).max
                else:
                    some = np.zeros(len(s), bool)
                if not some.all():
                    done = ~some
                    out_n[live[done]] = count
                    parts.append((live[done], s[done]))
                    s, live = s[some], live[some]
                    if not len(s):
                        break
                    at, place = at[some], place[some]
                    row = np.arange(len(s))
                s[row, at] = self.pairs.merged[place[row, at]]
                keep = np.arange(count)[None, :] != (at + 1)[:, None]
                count -= 1
                s = s[keep].reshape(-1, count)
        start = np.cumsum(out_n) - out_n
        flat = np.zeros(int(out_n.sum()), np.int32)
        for rows, ids in parts:
            flat[start[rows][:, None] + np.arange(ids.shape[1])[None, :]] = ids
        return flat, out_n

    def _learn(self, chunks: list[bytes]) -> None:
        """Adds the ids of these chunks to the store, in this order."""
        known: dict[str, int] = {}
        uses, counts = [], []
        for c in chunks:
            own = PIECES.findall(c.decode())
            counts.append(len(own))
            for p in own:
                uses.append(known.setdefault(p, len(known)))
        flat, n = self._merge([p.encode() for p in known])
        ids, size = gather(flat, np.cumsum(n) - n, n, np.array(uses, np.int64))
        ends = np.append(0, np.cumsum(size))
        at = np.append(0, np.cumsum(counts))
        per = ends[at[1:]] - ends[at[:-1]]
        self.start = np.append(self.start, len(self.flat) + np.cumsum(per) - per)
        self.size = np.append(self.size, per)
        self.flat = np.append(self.flat, ids)
        self.uses = np.append(self.uses, np.zeros(len(chunks), np.int64))

    def _shrink(self) -> None:
        """Keeps the chunks met most often, half of the memo at most."""
        order = np.argsort(-self.uses, kind="stable")[: MEMO // 2]
        order = np.sort(order[self.uses[order] > 1])
        place = np.full(len(self.uses), -1, np.int64)
        place[order] = np.arange(len(order))
        kept, size = gather(self.flat, self.start, self.size, order)
        self.flat, self.size, self.start, self.uses = kept, size, np.cumsum(size) - size, self.uses[order] // 2
        self.chunks = self.chunks.renumbered(place)
        self.long = {k: int(place[v]) for k, v in self.long.items() if place[v] >= 0}

    def _entries(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The store's entry of each chunk buf[start:end]; new ones are learnt."""
        keys = chunk_keys(buf, start, end)
        short = end - start <= CHUNK
        index = np.full(len(start), -1, np.int64)
        index[short] = self.chunks.find(keys[short])
        missing = np.nonzero(short & (index < 0))[0]
        if len(missing):
            h = mix(keys[missing])
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            same = (keys[missing[first]][inverse] == keys[missing]).all(axis=1)
            base = len(self.size)
            self._learn([buf[start[i] : end[i]].tobytes() for i in missing[first]])
            self.chunks.add(keys[missing[first]], base + np.arange(len(first)))
            index[missing[same]] = base + inverse[same]
        for i in np.nonzero(index < 0)[0]:
            chunk = buf[start[i] : end[i]].tobytes()
            if chunk not in self.long:
                self.long[chunk] = len(self.size)
                self._learn([chunk])
            index[i] = self.long[chunk]
        return index

    def _encode_safe(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (lower-cased bytes), and how many each has."""
        joined = b" " + b" ".join(texts) + b" " * (CHUNK + 8)
        buf = np.frombuffer(joined, np.uint8)
        inside = buf > 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        if len(start):
            long = np.flatnonzero(end - start > CHUNK)
            new = list(dict.fromkeys(c for i in long if (c := buf[start[i] : end[i]].tobytes()) not in self.long))
            if new:
                base = len(self.size)
                self._learn(new)
                self.long.update(zip(new, range(base, base + len(new)), strict=True))
        index = self._entries(buf, start, end)
        self.uses += np.bincount(index, minlength=len(self.uses))
        ids, size = gather(self.flat, self.start, self.size, index)
        begins = np.cumsum([1] + [len(x) + 1 for x in texts])
        ends = np.append(0, np.cumsum(size))[np.searchsorted(start, begins)]
        if len(self.size) > MEMO:
            self._shrink()
        return ids, np.diff(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        parts: list[np.ndarray] = []
        total = np.zeros(len(texts), np.int64)
        held: list[bytes] = []
        owner: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal held, owner, chars
            if held:
                ids, size = self._encode_safe(held)
                parts.append(ids)
                np.add.at(total, owner, size)
            held, owner, chars = [], [], 0

        for i, text in enumerate(texts):
            if self.fast and SAFE.fullmatch(text) and not any(x in text for x in self.special):
                for block in blocks(text):
                    held.append(block.lower().encode())
                    owner.append(i)
                    chars += len(block)
                    if chars >= BLOCK:
                        flush()
            else:
                flush()
                ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
                parts.append(ids)
                total[i] = len(ids)
        flush()
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), total


#: Bytes of a chunk that fit its key.
CHUNK = 24
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def chunk_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 24 bytes of each chunk as three numbers, zero-filled; buf ends with 32 bytes to spare."""
    view = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    size = end - start
    out = np.empty((len(start), 3), np.uint64)
    for j in range(3):
        out[:, j] = view[start + 8 * j] & _MASK[np.clip(size - 8 * j, 0, 8)]
    return out


def mix(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


class ChunkTable:
    """Chunk key -> entry: open addressing in numpy arrays, at most half full."""

    def __init__(self):
        self.bits = (2 * MEMO - 1).bit_length() + 1
        self.keys = np.zeros((1 << self.bits, 3), np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.value[place].astype(np.int64)
        wrong = np.flatnonzero((self.keys[place] != keys).any(axis=1) & (out >= 0))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.value[place[wrong]]
            wrong = wrong[(self.keys[place[wrong]] != keys[wrong]).any(axis=1) & (out[wrong] >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys, none of them here yet; a full block of new keys still fits."""
        while (self.value >= 0).sum() + len(keys) > 3 << (self.bits - 2):
            self._grow()
        place = (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.value[place] < 0)
            _, first = np.unique(place[free], return_index=True)
            won = free[first]
            self.keys[place[won]] = keys[todo[won]]
            self.value[place[won]] = values[todo[won]]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, place = todo[stay], (place[stay] + 1) & ((1 << self.bits) - 1)

    def _grow(self) -> None:
        used = self.value >= 0
        keys, values = self.keys[used], self.value[used]
        self.bits += 1
        self.keys = np.zeros((1 << self.bits, 3), np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        self.add(keys, values)

    def renumbered(self, place: np.ndarray) -> ChunkTable:
        used = np.flatnonzero(self.value >= 0)
        now = place[self.value[used]]
        out = ChunkTable()
        out.add(self.keys[used[now >= 0]], now[now >= 0])
        return out


def blocks(text: str, size: int = BLOCK):
    """text in pieces of about size characters, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = SPACE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


SPACE = re.compile(r"\s")


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that index names, one after the other, and their sizes."""
    n = size[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[index] - ends + n, n) + np.arange(total)], n


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
