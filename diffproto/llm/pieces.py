"""Texts encoded piece by piece, each distinct piece once.

A text is cut before white space that follows something else; where neither
tokenizer merges anything across such a place, the ids of a text are those of
its pieces, one after the other.  Cutting and telling pieces apart is done on a
whole batch's bytes with numpy and Arrow; only pieces that are not yet known
are encoded, and known ones are looked up in a memory of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

CACHE = 400_000  # pieces that a worker remembers
# The code points beyond ASCII that patterns take for white space.
WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[0] .. starts[0]+counts[0]-1, then those of the next, and so on."""
    ends = np.cumsum(counts)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    out += np.repeat(starts - (ends - counts), counts)
    return out


_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in WIDE_SPACE])
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = ~_ALNUM[33:127]


def cut(data: np.ndarray, ends: np.ndarray, glue: bytes = b"", marks: bool = False) -> np.ndarray:
    """Where the pieces of the texts begin that lie one after the other in
    ``data`` and end at ``ends``: at a text's first byte, and at ASCII white
    space (but the bytes in ``glue``) that follows anything but white space;
    with ``marks`` also at ASCII punctuation after an ASCII letter or digit."""
    begins = np.zeros(len(data), dtype=bool)
    space = _SPACE[data]
    begins[1:] = space[1:] & ~space[:-1]
    for g in glue:
        begins &= data != g
    # the character before may be wide white space
    at = np.flatnonzero(begins)
    at = at[data[at - 1] >= 0x80]
    before = np.concatenate([np.zeros(3, dtype=np.int64), data.astype(np.int64)]) if len(at) else data
    last = before[at + 2] | before[at + 1] << 8 if len(at) else at
    wide = np.isin(last, _WIDE) | np.isin(last | before[at] << 16, _WIDE) if len(at) else at
    begins[at[wide.astype(bool)]] = False
    if marks:
        begins[1:] |= _MARK[data[1:]] & _ALNUM[data[:-1]]
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, dtype=np.int64)
    begins[first[first < len(data)]] = True
    return np.flatnonzero(begins)


class Pieces:
    """The memory: ``learn`` takes pieces (bytes) and gives, for each of its
    streams, flat ids and counts; ``streams`` names the ids' types."""

    def __init__(self, learn: Callable[[list[bytes]], Sequence[tuple[np.ndarray, np.ndarray]]], types: Sequence[str],
                 glue: bytes = b"", marks: bool = False, most: int = CACHE):
        self.learn, self.types, self.glue, self.marks, self.most = learn, types, glue, marks, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = [np.zeros(1 << 16, dtype=t) for t in self.types]
        self.begin = [np.zeros(1 << 16, dtype=np.int64) for _ in self.types]
        self.count = [np.zeros(1 << 16, dtype=np.int32) for _ in self.types]
        self.used = [0] * len(self.types)
        self.uses = np.zeros(1 << 16, dtype=np.int32)  # batches in which a piece was met

    def _forget(self) -> None:
        """Keeps the pieces met in several batches, half of what may be remembered at most."""
        n, least = len(self.slot), 2
        while (stays := np.flatnonzero(self.uses[:n] >= least)).size > self.most // 2:
            least *= 2
        names, old = list(self.slot), (self.ids, self.begin, self.count, self.uses)
        self.clear()
        self._store([names[i] for i in stays], [(ids[ragged(begin[stays], count[stays])], count[stays])
                                                for ids, begin, count in zip(*old[:3], strict=True)])
        self.uses[: len(stays)] = old[3][stays] // 2

    def _store(self, pieces: list[bytes], streams: Sequence[tuple[np.ndarray, np.ndarray]]) -> None:
        start = len(self.slot)
        if start + len(pieces) > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(max(len(pieces), len(self.uses)), dtype=np.int32)])
        for k, (ids, counts) in enumerate(streams):
            n, need = len(counts), self.used[k] + len(ids)
            if need > len(self.ids[k]):
                self.ids[k] = np.concatenate([self.ids[k], np.zeros(max(need, len(self.ids[k])), dtype=self.types[k])])
            if start + n > len(self.begin[k]):
                more = max(start + n, len(self.begin[k]))
                self.begin[k] = np.concatenate([self.begin[k], np.zeros(more, dtype=np.int64)])
                self.count[k] = np.concatenate([self.count[k], np.zeros(more, dtype=np.int32)])
            self.ids[k][self.used[k]: need] = ids
            self.begin[k][start: start + n] = self.used[k] + np.cumsum(counts) - counts
            self.count[k][start: start + n] = counts
            self.used[k] = need
        self.slot.update(zip(pieces, range(start, start + len(pieces)), strict=True))

    def slots(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slots, begins): each piece's place in the memory and where it begins."""
        begins = cut(data, ends, self.glue, self.marks)
        bounds = np.append(begins, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        words = found.dictionary.to_pylist()
        known = np.array([self.slot.get(w, -1) for w in words], dtype=np.int64)
        missing = np.flatnonzero(known < 0)
        if len(self.slot) + len(missing) > self.most and self.slot:
            self._forget()
            known = np.array([self.slot.get(w, -1) for w in words], dtype=np.int64)
            missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = len(self.slot) + np.arange(len(missing))
            new = [words[i] for i in missing]
            self._store(new, self.learn(new))
        self.uses[known] += 1
        return known[found.indices.to_numpy()], begins

    def gather(self, slots: np.ndarray, stream: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of the pieces one after the other, and how many each has."""
        n = self.count[stream][slots]
        return self.ids[stream][ragged(self.begin[stream][slots], n)], n


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other as bytes, and where each ends."""
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))


_PLAIN = re.compile(rb"[ \n]?[^ \t\n\x0b\x0c\r]+")
_HAS_WIDE = re.compile(b"|".join(chr(c).encode() for c in WIDE_SPACE))


# Letters from U+0041 to U+027F, after one blank or none: one word of the pattern, whatever its version.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf])+")


def byte_signs() -> dict[int, str]:
    """A byte-level vocabulary's sign for each byte: printable Latin-1 stands
    for itself, the other bytes for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizers file, its pieces encoded many at a time: a
    newline is never merged with what stands beside it, so it keeps them
    apart.  Words of letters skip the pattern: they are handed over as the
    model's signs, cut at white space."""

    def __init__(self, tokenizer):
        self.tok = tokenizer
        spec = json.loads(tokenizer.to_str())
        model = spec["model"]
        self.words = None
        if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and model.get("type") == "BPE" and not any(
                model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            spec |= {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
            self.words = type(tokenizer).from_str(json.dumps(spec))
            self.signs = {b: c for b, c in byte_signs().items() if b != 10}
            self.size = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=np.int64)
            for entry, i in tokenizer.get_vocab().items():
                self.size[i] = len(entry)
        newline = tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None

    def whole(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)] if texts else []
        n = np.fromiter(map(len, got), dtype=np.int32, count=len(got))
        return np.fromiter((i for g in got for i in g), dtype=np.int32, count=int(n.sum())), n

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after the other, and how many each has."""
        if self.words is None:
            return self._learn(pieces)
        letters = np.fromiter((_LETTERS.fullmatch(p) is not None for p in pieces), dtype=bool, count=len(pieces))
        if not letters.any():
            return self._learn(pieces)
        text = b"\n".join([p for p, ok in zip(pieces, letters, strict=True) if ok])
        # line ends stay; every other byte becomes its sign
        got = self.words.encode_batch_fast([text.decode("latin-1").translate(self.signs)], add_special_tokens=False)[0]
        easy = np.array(got.ids, dtype=np.int32)
        # an entry has a sign for each of its bytes
        sizes = np.array([len(p) for p, ok in zip(pieces, letters, strict=True) if ok])
        n_easy = np.diff(np.searchsorted(np.cumsum(self.size[easy]), np.cumsum(sizes), side="right"), prepend=0)
        rest, n_rest = self._learn([p for p, ok in zip(pieces, letters, strict=True) if not ok])
        counts, begin = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        counts[letters], counts[~letters] = n_easy, n_rest
        begin[letters], begin[~letters] = np.cumsum(n_easy) - n_easy, len(easy) + np.cumsum(n_rest) - n_rest
        return np.concatenate([easy, rest])[ragged(begin, counts)], counts.astype(np.int32)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.newline is None:
            return self.whole([p.decode() for p in pieces])
        plain = np.fromiter((_PLAIN.fullmatch(p) is not None and _HAS_WIDE.search(p) is None for p in pieces), dtype=bool, count=len(pieces))
        line = np.fromiter((p[:1] == b"\n" for p in pieces), dtype=bool, count=len(pieces)) & plain
        easy = [p[1:] if x else p for p, x, ok in zip(pieces, line, plain, strict=True) if ok]
        texts = b"\n".join(easy).decode()
        ids = np.array(self.tok.encode_batch_fast([texts], add_special_tokens=False)[0].ids, dtype=np.int32) if easy else np.zeros(0, np.int32)
        at = np.flatnonzero(ids == self.newline)
        if easy and len(at) != len(easy) - 1:
            return self.whole([p.decode() for p in pieces])
        own = np.delete(ids, at)
        n_easy = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1 if easy else np.zeros(0, np.int64)
        rest, n_rest = self.whole([p.decode() for p, ok in zip(pieces, plain, strict=True) if not ok])
        # a plain piece after a newline gets its id in front
        counts = np.zeros(len(pieces), dtype=np.int64)
        counts[plain] = n_easy
        counts[~plain] = n_rest
        begin = np.zeros(len(pieces), dtype=np.int64)
        begin[plain] = np.cumsum(n_easy) - n_easy
        begin[~plain] = len(own) + np.cumsum(n_rest) - n_rest
        store = np.append(np.concatenate([own, rest]), np.int32(self.newline))
        # per piece two runs: the newline, if there is one, and the piece's own ids
        starts = np.stack([np.full(len(pieces), len(store) - 1), begin], axis=1).ravel()
        each = np.stack([line.astype(np.int64), counts], axis=1).ravel()
        return store[ragged(starts, each)], (counts + line).astype(np.int32)
