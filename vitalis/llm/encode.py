"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash
from tokenizers import Tokenizer

from vitalis.llm.decontam import _MIX, _pow, mix

#: Pieces remembered by a worker (some 60 bytes each); beyond it the memory starts anew.
REMEMBER = 1_000_000
#: Bytes of text encoded at once, and hashed at once: a worker holds some dozens of bytes for each of them.
STEP = 1 << 18

#: Bytes of a piece beyond which it is hashed on its own.
LONG = 256

#: Letters that every version of Unicode and both engines agree on, which neither NFC nor case folding splits or joins,
#: are A-Z, a-z and U+00C0 to U+00FF without the signs at D7 and F7; marks are ASCII punctuation.
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SECOND = np.zeros(256, bool)
_SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: White space that is not ASCII: a run of it may go on into a space, so such texts are encoded whole.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Kinds of pieces.
OTHER, WORD, MARKS = range(3)


#: The end of a chunk: what follows begins with white space.
_TURN = re.compile(r"[^ \t\n\v\f\r](?=[ \t\n\v\f\r])")


def _known(norm: dict | None) -> bool:
    """Whether a normalizer composes characters, joins white space and lower-cases at most: words stay words."""
    if norm is None:
        return True
    if norm.get("type") == "Sequence":
        return all(map(_known, norm["normalizers"]))
    return norm.get("type") in ("NFC", "Lowercase") or norm.get("type") == "Replace" and norm.get("pattern") == {"Regex": "\\s+"} and norm.get("content") == " "


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _visible() -> dict[int, str]:
    """The characters that byte-level models write bytes as: visible ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


_VISIBLE = _visible()
_BLANK = _VISIBLE[32]


def _reordered(flat: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (those of ``last`` stand after the others) in the order of ``last``, and their sizes."""
    at = np.cumsum(sizes) - sizes
    order = np.empty(len(last), np.int64)
    order[np.concatenate([np.flatnonzero(~last), np.flatnonzero(last)])] = np.arange(len(last))
    n = sizes[order]
    return flat[np.repeat(at[order] - np.cumsum(n) + n, n) + np.arange(len(flat))], n


def _pieces(raw: np.ndarray, begins: np.ndarray, kind: str, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of texts in a row begin and end, and their kinds.

    ``begins`` are the texts' first bytes (one more at the end) and ``whole`` the texts
    that are one piece.  A chunk of letters, or of letters and then marks, is a word
    (with the space before it, where white space counts) and its marks; any other chunk is one piece.
    """
    n = len(raw)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    first = np.zeros(n + 1, bool)
    first[begins[:-1]] = True
    if kind == "words":
        s = np.flatnonzero(~space & (before | first[:n]))
        after = np.concatenate([space[1:], [True]])
        e = np.flatnonzero(~space & (after | np.concatenate([first[1:n], [True]]))) + 1
    else:
        start = space & ~before | first[:n]
        for i in np.flatnonzero(whole).tolist():
            start[begins[i] + 1 : begins[i + 1]] = False
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
    letter = _LETTER[raw]
    two = np.flatnonzero(raw[:-1] == 0xC3)
    two = two[_SECOND[raw[two + 1]]]
    letter[two] = letter[two + 1] = True
    letters, marks = (np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)]) for x in (letter, _MARK[raw]))
    lead = (raw[s] == 0x20).astype(np.int64) if kind == "bytes" else np.zeros(len(s), np.int64)
    word = letters[e] - letters[s]
    cut = np.minimum(s + lead + word, e)
    plain = (word > 0) & (lead + word + marks[e] - marks[s] == e - s) & (letters[cut] - letters[np.minimum(s + lead, e)] == word)
    if whole.any() and len(s):
        plain &= ~whole[np.searchsorted(begins, s, side="right") - 1]
    split = np.flatnonzero(plain & (cut < e))
    kinds = np.insert(np.where(plain, WORD, OTHER), split + 1, MARKS)
    return np.insert(s, split + 1, cut[split]), np.insert(e, split, cut[split]), kinds


def _hashes(text: bytes, raw: np.ndarray, s: np.ndarray, e: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces, by differences of one running polynomial; of long ones by xxHash."""
    h = np.zeros(len(s), np.uint64)
    long = e - s > LONG
    at = np.flatnonzero(~long)
    cut = np.searchsorted(s[at], np.arange(0, len(raw) + STEP, STEP))
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        if x < y:
            a, b = s[at[x:y]], e[at[x:y]]
            base, end = int(a[0]), int(b[-1])
            power, inverse = _pow(end - base + 1)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[raw[base:end]] * power[: end - base])])
            h[at[x:y]] = (run[b - base] - run[a - base]) * inverse[a - base]
    for i in np.flatnonzero(long).tolist():
        h[i] = xxhash.xxh64_intdigest(text[s[i] : e[i]])
    return mix(h + (kinds + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _heads(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each piece as a number."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    bits = np.minimum(e - s, 8).astype(np.uint64) * np.uint64(8)
    mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
    return np.ascontiguousarray(view[s]).view("<u8")[:, 0] & mask


class ChunkEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` for many texts.

    The pre-tokenizers of the two kinds known here never join what stands on both
    sides of a white-space boundary, so a text's ids are those of its chunks in a row:

    * ``words``: white space is dropped (a Split that keeps matches without white
      space); chunks are what stands between ASCII white space.
    * ``bytes``: byte-level with its usual pattern; a chunk is a run of ASCII white
      space and the run of other characters after it.

    A chunk of letters, or of letters and then ASCII punctuation, is one or two
    pre-tokens, which go to the library's model at once.  Any other tokenizer (one with
    a normalizer that is not known here, too), and a text with other white space under
    ``bytes``, is encoded whole.  Pieces are told apart by 64-bit hashes, their lengths
    and first 8 bytes; where hashes meet, texts are encoded whole.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.remember = remember
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers", [pre])
        first = parts[0]
        if norm is None and len(parts) == 1 and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
            self.kind = "bytes"
        elif _known(norm) and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s" in first["pattern"].get("Regex", "") and all(p.get("type") == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in parts[1:]):
            self.kind = "words"
        else:
            self.kind = "whole"
        self.lower = self.kind == "words" and "Lowercase" in str(norm)
        self.odd = re.compile("|".join([r"\0", *(re.escape(t["content"]) for t in spec.get("added_tokens") or ())]))
        self.mark = self.tok.encode(" \0", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.heads = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.uint64)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)
        self.known = 0

    def _alone(self, chunk: str) -> bool:
        """Whether a chunk can't stand between marks, where white space or other characters might join them."""
        return self.odd.search(chunk) is not None or self.kind == "bytes" and (chunk[-1].isspace() or not chunk[0].isspace())

    def _ids(self, chunks: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and their numbers: words and marks by the model, others by the tokenizer."""
        plain = kinds != OTHER
        tokenize = self.model.tokenize
        words = [c for c, x in zip(chunks, plain, strict=True) if x]
        if self.lower:
            words = [c.lower() for c in words]
        # letters and marks of ASCII stand for themselves, but for the space before a word
        seen = [(_BLANK + w[1:] if w[0] == " " else w) if w.isascii() else w.encode().decode("latin-1").translate(_VISIBLE) for w in words]
        got = [[t.id for t in tokenize(w)] for w in seen]
        flat, sizes = self._others([c for c, x in zip(chunks, plain, strict=True) if not x])
        own = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(got), np.uint32, int(own.sum()))])
        return _reordered(flat, np.concatenate([sizes, own]), plain)

    def _others(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks and their numbers.  Most are encoded in one call, each followed by a space and
        a null character (and a space where white space is dropped), whose last id nothing else yields."""
        alone = [self.kind == "whole" or not c or self._alone(c) for c in chunks]
        own = [e.ids for e in self.tok.encode_batch_fast([c for c, x in zip(chunks, alone, strict=True) if x], add_special_tokens=False)]
        rest = [c for c, x in zip(chunks, alone, strict=True) if not x]
        mark = " \0 " if self.kind == "words" else " \0"
        joined = [mark.join([*rest[i : i + 300], ""]) for i in range(0, len(rest), 300)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)), *(np.array(x, np.uint32) for x in own)])
        cut = np.flatnonzero(flat[: len(flat) - sum(map(len, own))] == self.mark[-1])
        sizes = np.concatenate([np.diff(cut, prepend=-1) - len(self.mark), np.fromiter(map(len, own), np.int64, len(own))])
        keep = np.ones(len(flat), bool)
        for i in range(len(self.mark)):
            keep[cut - i] = False
        return _reordered(flat[keep], sizes, np.array(alone, bool))

    def _learn(self, chunks: list[str], kinds: np.ndarray, length: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The new pieces' codes."""
        flat, sizes = self._ids(chunks, kinds)
        n, begin = self.known, int(self.start[self.known])
        need = begin + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        if n + len(sizes) >= len(self.start):
            more = max(n + len(sizes), len(self.start))
            self.start, self.sizes = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.sizes))
            self.heads = np.concatenate([self.heads, np.zeros(more, np.uint64)])
        self.flat[begin:need] = flat
        self.start[n + 1 : n + 1 + len(sizes)] = begin + np.cumsum(sizes)
        self.sizes[n : n + len(sizes)], self.heads[n : n + len(sizes)] = length, head
        self.known += len(sizes)
        return np.arange(n, self.known)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the tokenizer alone."""
        got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(g) for g in got], dtype=np.int64)])

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        text = b"".join(parts)
        raw = np.frombuffer(text, np.uint8)
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts], dtype=np.int64)])
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        whole = np.array([self.kind == "bytes" and not t.isascii() and _WIDE.search(t) is not None for t in texts], bool)
        s, e, kinds = _pieces(raw, begins, self.kind, whole)
        if self.known > self.remember:
            self._clear()
        h, head, length = _hashes(text, raw, s, e, kinds), _heads(raw, s, e), e - s
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, u)
        met = np.zeros(len(u), bool)
        inside = place < len(self.keys)
        met[inside] = self.keys[place[inside]] == u[inside]
        code = np.empty(len(u), np.int64)
        code[met] = self.codes[place[met]]
        alike = (length[at][back] == length).all() and (head[at][back] == head).all()
        if not (alike and (self.sizes[code[met]] == length[at][met]).all() and (self.heads[code[met]] == head[at][met]).all()):
            return self._whole(texts)
        new = np.flatnonzero(~met)
        if len(new):
            x, y = s[at[new]].tolist(), e[at[new]].tolist()
            chunks = [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(x, y, strict=True)]
            code[new] = self._learn(chunks, kinds[at[new]], length[at[new]], head[at[new]])
            self.keys, self.codes = np.insert(self.keys, place[new], u[new]), np.insert(self.codes, place[new], code[new])
        code = code[back]
        a = self.start[code]
        n = self.start[code + 1] - a
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = self.flat[np.repeat(a - to[:-1], n) + np.arange(to[-1])]
        return ids, to[np.searchsorted(s, begins)]

    def _cut(self, text: str) -> Iterator[str]:
        """A long text in slices that begin where a chunk does."""
        at = 0
        while at < len(text):
            m = _TURN.search(text, at + STEP) if at + STEP < len(text) else None
            to = m.start() + 1 if m else len(text)
            yield text[at:to]
            at = to

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and where each text's ids begin (one more at the end)."""
        if self.kind == "whole":
            return self._whole(texts)
        if not any(len(t) > 2 * STEP for t in texts):
            return self._block(texts)
        flat, to = [np.zeros(0, np.uint32)], [0]
        for t in texts:
            whole = self.kind == "bytes" and not t.isascii() and _WIDE.search(t) is not None
            got = [self._whole([t])[0]] if whole else [self._block([x])[0] for x in self._cut(t)]
            flat += got
            to.append(to[-1] + sum(map(len, got)))
        return np.concatenate(flat), np.array(to, np.int64)

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, ids, starts) of slices of bounded size; a null text is empty."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= STEP or i == len(texts) - 1:
                yield first, i + 1 - first, *self.encode([x or "" for x in texts[first : i + 1]])
                first, size = i + 1, 0


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, to: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text, and the new starts."""
    out = np.insert(ids, to[1:], end)
    return out, to + np.arange(len(to))
