"""Removal of repeated byte strings by prefix-free parsing.

A window is a string of MATCH bytes.  Triggers are the least of the rolling hashes of GRAM
bytes in some window; they depend on the text alone, so equal windows hold the same trigger
at the same place.  A phrase is what the windows of one trigger cover: phrases follow one
another, neighbours overlap by MATCH - 1 bytes, and every window lies in exactly one phrase.

* The parse asks, for every trigger, whether it occurs in other documents, and whether
  its whole phrase occurs in an earlier one: then all its windows go.
* Of the dictionary, only first occurrences of phrases whose trigger has other phrases
  too are left.  Their suffixes are sorted to a depth of MATCH bytes, which brings equal
  windows of different phrases together.  No window has to be looked up beyond its phrase.

Texts stay in parts of a few megabytes, with their phrases; what is asked moves in packed
arrays, one per part and bucket of hashes, and the answers go back to the part.  A part asks
once for each of its (trigger, phrase) pairs, with the least id that it has there, however
many of its documents share them.  Triggers and phrases are compared by 64 bits each, windows
by their bytes, and windows of hot triggers by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import saved, table
from vitalis.llm.decontam import _MIX, _pow, mix

MATCH = 50
GRAM = 16
#: Bytes of text of a part (a longer text is a part of its own), and of text per bucket of hashes.
PART = 1 << 21
BUCKET = 1 << 24
#: A trigger with more phrases than this has its windows dealt out by their own hashes instead of sorted in one bucket.
HOT = 4096
#: Order of a null id: after all others.
LAST = (1 << 63) - 1


def rolling(raw: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n bytes from each place on, by doubling."""
    base = 0x9E3779B97F4A7C15
    power, size, got, done = _MIX[raw], 1, None, 0
    while n:
        if n & 1:
            if got is None:
                got, done = power, size
            else:
                m = max(len(raw) - done - size + 1, 0)
                got = got[:m] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + m]
                done += size
        n >>= 1
        if n:
            m = max(len(power) - size, 0)
            power = power[:m] * np.uint64(pow(base, size, 1 << 64)) + power[size : size + m]
            size *= 2
    return mix(got)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


class Phrases:
    """The phrases of a part: ``first`` and ``last`` window, ``trigger`` place, ``doc`` (row in the part)."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, trigger: np.ndarray) -> None:
        self.raw, self.first, self.last, self.trigger = raw, first, last, trigger
        self.doc = np.searchsorted(np.cumsum(sizes), first, side="right")

    @classmethod
    def found(cls, raw: np.ndarray, sizes: np.ndarray) -> Phrases:
        row = np.repeat(np.arange(len(sizes)), sizes)
        n = len(raw) - MATCH + 1
        ok = row[:n] == row[MATCH - 1 :] if n > 0 else np.zeros(0, bool)
        starts = np.flatnonzero(ok)
        if not len(starts):
            return cls(raw, sizes, *[np.zeros(0, np.int64)] * 3)
        h = rolling(raw, GRAM)
        bits = len(raw).bit_length()
        mask = np.uint64((1 << bits) - 1)
        place = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
        at = (mask - (_least(place, MATCH - GRAM + 1)[starts] & mask)).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        return cls(raw, sizes, starts[new], starts[np.append(new[1:], len(at)) - 1], at[new])

    def hashes(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the triggers and of the phrases (with the trigger's place in it)."""
        power, inverse = _pow(max(len(self.raw), PART))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[self.raw] * power[: len(self.raw)])])
        first, last, at = self.first[rows], self.last[rows], self.trigger[rows]
        key = mix((sums[at + GRAM] - sums[at]) * inverse[at] + np.uint64(0x632BE59BD9B4E019))
        body = (sums[last + MATCH] - sums[first]) * inverse[first]
        return key, mix(body + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def entries(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (trigger, phrase) of the part the occurrence with the least id, in trigger order; and each phrase's entry."""
        key, own = self.hashes()
        by = np.lexsort((ids[self.doc], own, key))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(key[by]) != 0) | (np.diff(own[by]) != 0)
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        return by[new], entry

    def packed(self, one: np.ndarray, entry: np.ndarray) -> bytes:
        steps = np.diff(self.first, prepend=0), self.last - self.first, self.trigger - self.first, entry
        return zstandard.ZstdCompressor(level=1).compress(_packed(*steps) + _packed(one))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers of 0 and more in as few bytes each as the largest needs: the width, then the numbers."""
    x = np.ascontiguousarray(x).astype("<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(raw: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """``n`` numbers back from _narrow, and what follows them."""
    width = raw[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, 1).reshape(n, width)
    return out.view("<u8")[:, 0], raw[1 + n * width :]


def _packed(*cols: np.ndarray) -> bytes:
    return len(cols[0]).to_bytes(8, "little") + b"".join(map(_narrow, cols))


def _unpacked(raw: bytes, cols: int) -> tuple[list[np.ndarray], bytes]:
    n, raw, out = int.from_bytes(raw[:8], "little"), raw[8:], []
    for _ in range(cols):
        x, raw = _wide(raw, n)
        out.append(x)
    return out, raw


def _ordered(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


# ---- parts


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    ids, texts, size, part, number = [], [], 0, 0, 0

    def closed() -> pa.RecordBatch:
        nonlocal size, number
        body, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        p = Phrases.found(np.frombuffer(body, np.uint8), sizes)
        row = [[(part << 32) + number], [list(ids)], [sizes.tolist()], [squeeze(body)], [p.packed(*p.entries(_order(ids)))]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        ids.clear(), texts.clear()
        size, number = 0, number + 1
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "ids", "sizes", "body", "phrases"])

    for b in batches:
        for p, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            part = p
            t = t.as_py() or b""
            if texts and size + len(t) > PART:
                yield closed()
            ids.append(i), texts.append(t)
            size += len(t)
    if texts:
        yield closed()


def _order(ids: list) -> np.ndarray:
    """Ids as unsigned numbers of the same order, a null after all others."""
    return _ordered(np.array([LAST if i is None else i for i in ids], np.int64))


class _Part:
    """A row of the table of parts: the order of its ids, its texts' sizes, its phrases and their entries."""

    def __init__(self, b: pa.RecordBatch, i: int) -> None:
        self.part, self.ids = b.column(0)[i].as_py(), b.column(1)[i].as_py()
        self.order, self.sizes = _order(self.ids), np.array(b.column(2)[i].as_py(), np.int64)
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column(3)[i].as_py()), np.uint8)
        (step, n, at, entry), rest = _unpacked(zstandard.ZstdDecompressor().decompress(b.column(4)[i].as_py()), 4)
        first = np.cumsum(step.astype(np.int64))
        self.p = Phrases(self.raw, self.sizes, first, first + n.astype(np.int64), first + at.astype(np.int64))
        self.entry, self.one = entry.astype(np.int64), _unpacked(rest, 1)[0][0].astype(np.int64)
        self.doc = self.order[self.p.doc]

    def codes(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Each entry's code and bucket: entries stand in the order of their buckets."""
        got = [(a["bucket"], int.from_bytes(a["body"][:8], "little"), a["body"][8:]) for a in sorted(answers, key=lambda a: a["bucket"]) if a["kind"] == 0]
        if not got:
            return np.zeros(0, np.uint8), np.zeros(0, np.int64)
        return np.concatenate([_codes(x, n) for _, n, x in got]), np.repeat([k for k, _, _ in got], [n for _, n, _ in got])


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_ASK = "bucket long, part long, kind int, body binary"


def _rows(cols: list[list], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _asked(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
    return _rows(cols, ["bucket", "part", "kind", "body"], (pa.int64(), pa.int64(), pa.int32(), pa.binary()))


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of a sorted array."""
    if len(bucket):
        at = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


def _ask_triggers(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _Part(b, i)
                key, own = x.p.hashes(x.one)
                doc, low = x.doc[x.one], key & np.uint64(0xFFFFFFFF)
                base = doc.min(initial=np.uint64((1 << 64) - 1))
                yield _asked([(k, x.part, 0, int(base).to_bytes(8, "little") + _packed(low[s], own[s], doc[s] - base)) for k, s in _cut(_bucket(key, buckets))])

    return run


def _by_bucket(answer: Callable):
    """Runs ``answer`` on all rows of a bucket at once: rows come sorted by bucket and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, bodies = None, [], []

        def done() -> pa.RecordBatch:
            rows = [(key[0], p, key[1], a) for p, a in zip(parts, answer(key[1], bodies), strict=True)]
            parts.clear(), bodies.clear()
            return _asked(rows)

        for b in batches:
            for bucket, part, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if parts and (bucket, kind) != key:
                    yield done()
                key = (bucket, kind)
                parts.append(part), bodies.append(body)
        if parts:
            yield done()

    return run


def _groups(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by ``cols``: where groups begin, and each row's group."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _answer_triggers(hot: int, bodies: list[bytes]) -> list[bytes]:
    """Per entry 0: nothing to remove; 1: the phrase is in an earlier document; 2: to be compared; 3: so, and hot."""
    got = [_unpacked(x[8:], 3)[0] for x in bodies]
    low, own = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    doc = np.concatenate([g[2] + np.uint64(int.from_bytes(x[:8], "little")) for g, x in zip(got, bodies, strict=True)])
    by = np.lexsort((doc, own, low))
    at, phrase = _groups(low[by], own[by])
    earliest = doc[by][at][phrase] if len(by) else doc
    begin, group = _groups(low[by])
    starts = np.zeros(len(by), np.int64)
    starts[at] = 1
    phrases = np.add.reduceat(starts, begin) if len(by) else starts
    code = np.where(doc[by] > earliest, 1, np.where(phrases[group] > hot, 3, np.where(phrases[group] > 1, 2, 0))).astype(np.uint8)
    out = np.empty(len(by), np.uint8)
    out[by] = code
    parts = np.split(out, np.cumsum([len(g[0]) for g in got])[:-1])
    return [len(c).to_bytes(8, "little") + np.packbits(np.unpackbits(c[:, None], axis=1)[:, 6:].ravel()).tobytes() for c in parts]


def _codes(body: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(body, np.uint8))[: 2 * n].reshape(n, 2)
    return bits[:, 0] * 2 + bits[:, 1]


def _bodies(p: Phrases, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some phrases in a row, and where each begins (one more at the end)."""
    size = p.last[rows] + MATCH - p.first[rows]
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return p.raw[np.repeat(p.first[rows] - to[:-1], size) + np.arange(to[-1])], to


def _hot_windows(x: _Part, code: np.ndarray, buckets: int) -> tuple[tuple, tuple]:
    """Windows of hot phrases: hashes (128 bits), least id and bucket of each distinct one, in the order asked; and place, distinct one and id of every one."""
    p, rows = x.p, np.flatnonzero(code[x.entry] == 3) if len(code) else np.zeros(0, np.int64)
    n = p.last[rows] - p.first[rows] + 1
    at = np.repeat(p.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
    d = np.repeat(x.doc[rows], n)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return (none, none, none, np.zeros(0, np.int64)), (at, at, d)
    h, g = rolling(p.raw, MATCH)[at], rolling(p.raw ^ np.uint8(0x5A), MATCH)[at]
    by = np.lexsort((d, g, h))
    begin, group = _groups(h[by], g[by])
    which = np.empty(len(by), np.int64)
    which[by] = group
    h, g, low = h[by][begin], g[by][begin], d[by][begin]
    return (h, g, low, _bucket(h, buckets)), (at, which, d)


def _ask_phrases(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for i in range(b.num_rows):
                x = _Part(b, i)
                code, bucket = x.codes(b.column(5)[i].as_py() or [])
                rows = x.one[code == 2]
                raw, to = _bodies(x.p, rows)
                out = []
                for k, s in _cut(bucket[code == 2]):
                    body = _packed(x.doc[rows[s]], np.diff(to[s.start : s.stop + 1]))
                    out.append((k, x.part, 1, squeeze(body + raw[to[s.start] : to[s.stop]].tobytes())))
                (h, g, low, bucket), _ = _hot_windows(x, code, buckets)
                out += [(k, x.part, 2, _packed(h[s], g[s], low[s])) for k, s in _cut(bucket)]
                yield _asked(out)

    return run


def _window_hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of all windows of phrases that stand in a row, some megabytes of phrases at once."""
    out, step = [], 1 << 20
    cut = np.unique(np.searchsorted(begin, np.arange(0, len(raw) + step, step)))
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        a, b = int(begin[x]), int(begin[y - 1] + size[y - 1])
        power, inverse = _pow(max(b - a, PART))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[raw[a:b]] * power[: b - a])])
        n = size[x:y] - MATCH + 1
        at = np.repeat(begin[x:y] - a - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(mix((sums[at + MATCH] - sums[at]) * inverse[at]))
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _same_bytes(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the windows at ``x`` and ``y`` are equal, by 8 bytes at a time (the last ones overlapping)."""
    out = np.ones(len(x), bool)
    for o in (*range(0, MATCH - 8, 8), MATCH - 8):
        out &= (words[x + o] == words[y + o]).all(1)
    return out


def _later(words: np.ndarray, at: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Windows whose bytes are in a document with a smaller id.

    Equal hashes bring candidates together and their bytes are compared with the earliest's;
    windows of different bytes and one hash are put in suffix order to a depth of MATCH bytes.
    """
    gone = np.zeros(len(at), bool)
    by = np.argsort(h)
    again = h[by[1:]] == h[by[:-1]]
    multi = np.zeros(len(by), bool)
    multi[1:] |= again
    multi[:-1] |= again
    rows = by[multi]
    if not len(rows):
        return gone
    rows = rows[np.lexsort((doc[rows], h[rows]))]
    begin, group = _groups(h[rows])
    first = rows[begin][group]
    equal = _same_bytes(words, at[rows], at[first])
    gone[rows] = equal & (doc[rows] > doc[first])
    mixed = np.zeros(len(begin), bool)
    mixed[group[~equal]] = True
    if mixed.any():
        rows = rows[mixed[group]]
        cols = [np.ascontiguousarray(words[at[rows] + o]).view(">u8")[:, 0].astype(np.uint64) for o in (*range(0, MATCH - 8, 8), MATCH - 8)]
        order = np.lexsort((doc[rows], *cols[::-1]))
        begin, group = _groups(*(c[order] for c in cols))
        rows = rows[order]
        gone[rows] = doc[rows] > doc[rows][begin][group]
    return gone


def _answer_phrases(kind: int, bodies: list[bytes]) -> list[bytes]:
    """Per phrase the windows (a bit each) that an earlier document has; per hot window whether one has it."""
    if kind == 2:
        got = [_unpacked(x, 3)[0] for x in bodies]
        h, g, d = (np.concatenate([x[k] for x in got]) for k in (0, 1, 2))
        by = np.lexsort((d, g, h))
        at, group = _groups(h[by], g[by])
        gone = np.empty(len(by), bool)
        gone[by] = d[by] > d[by][at][group]
        return [np.packbits(x).tobytes() for x in np.split(gone, np.cumsum([len(x[0]) for x in got])[:-1])]
    docs, sizes, raws = [], [], []
    for x in bodies:
        (d, n), raw = _unpacked(zstandard.ZstdDecompressor().decompress(x), 2)
        docs.append(d), sizes.append(n.astype(np.int64)), raws.append(np.frombuffer(raw, np.uint8))
    size, raw = np.concatenate(sizes), np.concatenate([*raws, np.zeros(8, np.uint8)])
    raws.clear()
    begin = np.cumsum(size) - size
    n = size - MATCH + 1
    start = np.cumsum(n) - n
    at = np.repeat(begin - start, n) + np.arange(n.sum())
    doc = np.repeat(np.concatenate(docs), n)
    gone = _later(np.lib.stride_tricks.sliding_window_view(raw, 8), at, doc, _window_hashes(raw[:-8], begin, size))
    bit = np.uint64(1) << (np.arange(len(at)) - np.repeat(start, n)).astype(np.uint64)
    marks = np.bitwise_or.reduceat(np.where(gone, bit, np.uint64(0)), start) if len(start) else np.zeros(0, np.uint64)
    return [_packed(x) for x in np.split(marks, np.cumsum([len(x) for x in sizes])[:-1])]


def _remove(buckets: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _Part(b, i)
                code, bucket = x.codes(b.column(5)[i].as_py() or [])
                more = b.column(6)[i].as_py() or []
                # windows that go, as a bit per window of each entry's phrase
                marks = np.where(code == 1, np.uint64((1 << 64) - 1), np.uint64(0))
                rows = np.flatnonzero(code == 2)
                of = {a["bucket"]: a["body"] for a in more if a["kind"] == 1}
                for k, s in _cut(bucket[rows]):
                    marks[rows[s]] = _unpacked(of[k], 1)[0][0]
                # a phrase goes whole where a document of this part with a smaller id has it
                own = np.where(x.doc > x.doc[x.one][x.entry], np.uint64((1 << 64) - 1), marks[x.entry]) if len(code) else marks
                n = np.where(own > 0, x.p.last - x.p.first + 1, 0)
                at = np.repeat(x.p.first - np.cumsum(n) + n, n) + np.arange(n.sum())
                bit = (at - np.repeat(x.p.first, n)).astype(np.uint64)
                gone = at[np.repeat(own, n) >> bit & np.uint64(1) > 0]
                (_, _, low, bucket), (place, which, doc) = _hot_windows(x, code, buckets)
                if len(place):
                    of = {a["bucket"]: a["body"] for a in more if a["kind"] == 2}
                    bad = np.zeros(len(low), bool)
                    for k, s in _cut(bucket):
                        bad[s] = np.unpackbits(np.frombuffer(of[k], np.uint8))[: s.stop - s.start]
                    gone = np.concatenate([gone, place[(doc > low[which]) | bad[which]]])
                size = len(x.raw) + 1
                step = np.bincount(gone, minlength=size) - np.bincount(gone + MATCH, minlength=size)
                yield _results(x.ids, x.sizes, x.raw, np.cumsum(step[:-1]) > 0, keep_text)

    return run


def _results(ids: list, sizes: np.ndarray, raw: np.ndarray, out: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    removed, spans, digest, texts = [], [], [], []
    for a, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        x = out[a : a + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8)))
        kept = raw[a : a + n][~x].tobytes() if len(edge) else raw[a : a + n].tobytes()
        removed.append(n - len(kept))
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
        digest.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept if keep_text else None)
    cols = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(digest, pa.string())]
    return pa.RecordBatch.from_arrays([*cols, *[pa.array(texts, pa.binary())] * keep_text], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", *["kept"] * keep_text])


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id whole number, text): doc_id, n_bytes, n_removed, spans, kept_sha256 (and kept bytes).

    Removed is each byte covered by a string of MATCH bytes that also starts in a row
    with a smaller doc_id; spans are the maximal removed runs (bytes, end exclusive).
    Null and empty texts have no bytes.  A null doc_id is larger than all others; rows of
    one doc_id (repeated ones too) don't remove from each other.
    """
    src = docs.select(F.spark_partition_id().alias("p"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = saved(src.mapInArrow(_parts, "part long, ids array<long>, sizes array<long>, body binary, phrases binary"), "parts")
    total = parts.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def answered(asked: DataFrame, answer: Callable, name: str) -> DataFrame:
        got = asked.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_by_bucket(answer), _ASK)
        return saved(got.select("part", F.struct("bucket", "kind", "body").alias("a")), name).groupBy("part").agg(F.collect_list("a").alias(name))

    first = answered(parts.mapInArrow(_ask_triggers(buckets), _ASK), lambda _, bodies: _answer_triggers(hot, bodies), "answers")
    known = parts.join(first.hint("shuffle_hash"), "part", "left")
    second = answered(known.mapInArrow(_ask_phrases(buckets), _ASK), _answer_phrases, "more")
    out = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * keep_text)
    return known.join(second.hint("shuffle_hash"), "part", "left").mapInArrow(_remove(buckets, keep_text), out)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes removed from every document."""
    r = remove_repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# Every string of 50 bytes by its place, in hex; its smallest doc_id; the union of what larger ones cover.
OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
low AS (SELECT s, min(doc_id) AS lo, max(doc_id) AS hi FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i FROM w JOIN low USING (s) WHERE doc_id > lo),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b
         FROM (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS run
               FROM (SELECT doc_id, i, CASE WHEN i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 50 THEN 1 ELSE 0 END AS brk FROM gone))
         GROUP BY doc_id, run),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k
         FROM (SELECT doc_id, h, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b
               FROM (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, len(h) // 2, NULL FROM d) JOIN d USING (doc_id))
         GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS r, count(*) AS n FROM runs GROUP BY doc_id) USING (doc_id)
"""
