"""MinHash near-duplicates with SetSketch registers: banded registers, likelihood estimates, exact check, components.

A register is the minimum of exponential variables over a set, kept as the exponent of
its place on a grid of powers of ``base`` and truncated to two bytes (Ertl, SetSketch,
2021).  Registers of a union are the maxima of the registers, and two sets agree on a
register with a probability that grows with their Jaccard similarity.  Sets that agree
on all registers of a band are candidates; their similarity is estimated jointly from
all registers by likelihood, and what could reach the threshold is checked on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.llm.common import components, discard, saved, small, table, text_key

SHINGLE = 5
#: Pairs with 100 * intersection >= PERCENT * union are linked.
PERCENT = 85
#: Registers a band and bands.  A pair at similarity 0.85 shares none of the bands with probability (1 - 0.85 ** 6) ** 40 < 1e-8.
ROWS = 6
BANDS = 40
#: Registers are exponents of BASE; RATE is the rate of an element's exponential variable; LIMIT the largest exponent.
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
#: A pair goes on unless the likelihood at the threshold is worse than the best by so many standard deviations.
DEVIATIONS = 6.0
#: Bytes of text hashed at once; a longer word is hashed on its own.
STEP = 1 << 20
#: Members of a bucket up to which its pairs become rows; members and bytes of sets of a chunk: two chunks meet in a task.
FEW = 8
CHUNK = 512
GROUP_BYTES = 1 << 24
#: Elements whose memberships are multiplied at once.
COLUMNS = 4096

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class ShingleHasher:
    """64-bit hashes of the word shingles of texts, by polynomials over their bytes.

    Bytes become random numbers; a word's hash is the polynomial of its numbers at an
    odd point (differences of one running sum, scaled back), mixed; a shingle's is the
    polynomial of its words' hashes, mixed.  All are numpy passes over STEP bytes.
    """

    def __init__(self, shingle: int = SHINGLE, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        self.k = shingle
        self.letter = rng.integers(0, 1 << 64, 256, np.uint64)
        self.point = int(rng.integers(0, 1 << 62)) * 2 + 1
        self.at = (rng.integers(0, 1 << 62, shingle, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 64, shingle + 1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(p: int) -> np.ndarray:
            steps = np.full(n, p & (1 << 64) - 1, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        self.up, self.down = powers(self.point), powers(pow(self.point, -1, 1 << 64))

    def _block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of a block that is cut at white space, and where the words begin."""
        b = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~self.space[b]
        turn = np.diff(inside)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        long = end - begin > STEP
        if long.any():
            out = np.zeros(len(begin), np.uint64)
            out[long] = [xxhash.xxh64_intdigest(raw[x:y]) for x, y in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
            for i in np.flatnonzero(~long).tolist():
                out[i] = self._block(raw[begin[i] : end[i]])[0][0]
            return out, begin
        if len(b) > len(self.up):
            self._grow(2 * len(b))
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.letter[b] * self.up[: len(b)], out=run[1:])
        return _mixed((run[end] - run[begin]) * self.down[begin]), begin

    def words(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of a text (its UTF-8 bytes), lower-cased A-Z."""
        raw = raw.lower()
        if len(raw) <= STEP:
            return self._block(raw)[0]
        parts, at = [], 0
        while at < len(raw):
            to = min(at + STEP, len(raw))
            while to < len(raw) and not self.space[raw[to]]:
                to += 1
            parts.append(self._block(raw[at:to])[0])
            at = to
        return np.concatenate(parts)

    def _combined(self, w: np.ndarray, k: int) -> np.ndarray:
        s = np.full(len(w) - k + 1, self.salt[k], np.uint64)
        for i in range(k):
            s += w[i : len(w) - k + 1 + i] * self.at[i]
        return _mixed(s)

    def sets(self, raws: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; texts of up to STEP bytes in all share a pass."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if group:
                w, begin = self._block(b" ".join(group).lower())
                ends = np.cumsum([len(r) + 1 for r in group])
                cut = np.concatenate([[0], np.searchsorted(begin, ends)])
                out.extend(self.shingles(w[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True))
            group.clear()
            size = 0

        for r in raws:
            r = r or b""
            if size + len(r) > STEP:
                flush()
            if len(r) > STEP:
                out.append(self.shingles(self.words(r)))
            else:
                group.append(r)
                size += len(r) + 1
        flush()
        return out

    def shingles(self, w: np.ndarray) -> np.ndarray:
        """Sorted distinct shingles of word hashes: the whole sequence if it is shorter, none of no word."""
        return np.unique(self._combined(w, min(self.k, len(w)))) if len(w) else np.zeros(0, np.uint64)


class Sketcher:
    """SetSketch registers of sets of 64-bit hashes."""

    def __init__(self, size: int = ROWS * BANDS, base: float = BASE, rate: float = RATE, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        self.base, self.rate, self.size = base, rate, size
        self.factor = rng.integers(0, 1 << 32, size, np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, size, np.uint32)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """Registers (uint16) of a set; all 0 for the empty set."""
        if not len(hashes):
            return np.zeros(self.size, np.uint16)
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.size, (1 << 32) - 1, np.uint32)
        for i in range(0, len(h), 128):
            x = h[i : i + 128, None] * self.factor
            x += self.shift
            np.minimum(low, x.min(0), out=low)
        # the least uniform number gives the least exponential variable
        least = -np.log1p(-(low + 0.5) / 2.0**32) / self.rate
        return np.clip(np.floor(1 - np.log(least) / np.log(self.base)), 0, LIMIT).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray, base: float) -> np.ndarray:
    return -np.log1p(-x * (base - 1) / base) / np.log(base)


def log_likelihood(more: np.ndarray, less: np.ndarray, size: int, na: np.ndarray, nb: np.ndarray, j: np.ndarray, base: float = BASE) -> np.ndarray:
    """Log-likelihood of similarity ``j`` of sets of ``na`` and ``nb`` elements, where the first set's register is greater ``more`` and smaller ``less`` times."""
    u = na / (na + nb)
    p = np.clip(_p(np.maximum(u - (1 - u) * j, 0), base), 1e-12, 1)
    q = np.clip(_p(np.maximum(1 - u - u * j, 0), base), 1e-12, 1)
    return more * np.log(p) + less * np.log(q) + (size - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, base: float = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest similarity of each pair of register rows, and the deviations by which ``least`` is off (0 if it is below the estimate)."""
    size = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    na, nb = na.astype(float), nb.astype(float)
    top = np.minimum(na, nb) / np.maximum(na, nb)
    lo, hi = np.zeros(len(na)), top.copy()
    g = (5**0.5 - 1) / 2
    for _ in range(16):  # golden section, to a thousandth; the likelihood has one maximum
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        up = log_likelihood(more, less, size, na, nb, x, base) < log_likelihood(more, less, size, na, nb, y, base)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    best = (lo + hi) / 2
    lost = log_likelihood(more, less, size, na, nb, best, base) - log_likelihood(more, less, size, na, nb, np.minimum(least, top), base)
    off = np.where((best >= least), 0.0, np.sqrt(2 * np.maximum(lost, 0)))
    return best, np.where(top < least, np.inf, off)


def _sets_of(b: pa.RecordBatch, k: int, hasher: ShingleHasher) -> list[np.ndarray]:
    return hasher.sets(b.column(k).to_pylist())


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, tkey, n_shingles, skey, regs) per row: the set's size, 128-bit key and registers (uint16, little-endian)."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tkey"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc_id", "tkey", "n_shingles", "skey", "regs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketcher = ShingleHasher(shingle), Sketcher(rows * bands)
        last: dict[bytes, bytes] = {}
        for b in batches:
            sets = _sets_of(b, 2, hasher)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            regs = []
            for k, s in zip(keys, sets, strict=True):
                if k not in last:
                    if len(last) > 4096:
                        last.clear()
                    last[k] = sketcher.registers(s).astype("<u2").tobytes()
                regs.append(last[k])
            cols = [b.column(0), b.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = T.StructType([src.schema["doc_id"], src.schema["tkey"], T.StructField("n_shingles", T.LongType()), T.StructField("skey", T.BinaryType()), T.StructField("regs", T.BinaryType())])
    return src.mapInArrow(run, kind)


def band_rows(classes: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, cid) for every band of every class: classes with equal registers in a band have its key in common."""
    factor = np.random.default_rng(19).integers(0, 1 << 64, (bands, rows), np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, bands, rows).astype(np.uint64)
            keys = np.full(r.shape[:2], np.arange(bands, dtype=np.uint64))
            for i in range(rows):  # one register after the other, each mixed in
                keys = _mixed((keys + r[:, :, i]) * factor[:, i])
            cid = np.repeat(np.asarray(b.column(0), np.int64), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(cid)], ["key", "cid"])

    return classes.select("cid", "regs").mapInArrow(run, "key long, cid long")


def _close(regs: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows whose likelihood doesn't rule out ``percent`` percent, as a square of booleans."""
    out = np.zeros((len(n), len(n)), bool)
    size = regs.shape[1]
    # registers agree with a probability of the similarity at least; fewer than this are out of any likelihood's reach
    least = size * percent / 100 - 12 * np.sqrt(size) / 2
    held: list[tuple[int, np.ndarray]] = []

    def settled() -> None:
        if held:
            i, j = np.repeat([x for x, _ in held], [len(y) for _, y in held]), np.concatenate([y for _, y in held])
            ok = estimate(regs[i], regs[j], n[i], n[j], percent / 100)[1] <= DEVIATIONS
            out[i[ok], j[ok]] = out[j[ok], i[ok]] = True
            held.clear()

    for i in range(len(n) - 1):
        held.append((i, i + 1 + np.flatnonzero((regs[i + 1 :] == regs[i]).sum(1) >= least)))
        if sum(len(y) for _, y in held) >= 1 << 14:
            settled()
    settled()
    return out


def _forest(cid: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of each member to the first of its component of ``near``."""
    label = np.arange(len(cid))
    near = near | np.eye(len(cid), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(cid)).min(1)
        if (new == label).all():
            break
        label = new
    odd = label != np.arange(len(cid))
    return pa.RecordBatch.from_arrays([pa.array(cid[odd]), pa.array(cid[label[odd]])], ["a", "b"])


def _meetings(rows: DataFrame, group: str, members: list[str], cut: Column) -> DataFrame:
    """Arrays ``m`` of a group's members (cid and ``members``); a group of several chunks gives one for every pair of them."""
    own = F.pmod(F.xxhash64("cid"), cut).cast("int")
    r = rows.withColumn("cut", cut).withColumn("own", own)
    r = r.select(group, "cid", *members, "own", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    r = r.groupBy(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return r.agg(F.collect_list(F.struct("cid", *members)).alias("m")).where(F.size("m") > 1).select("m")


def _each(kernel: Callable[[np.ndarray, list], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that runs ``kernel`` (ids, further fields) on each array of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(0)
            off = np.asarray(m.offsets).tolist()
            fields = [m.values.field(k) for k in range(m.type.value_type.num_fields)]
            for x, y in zip(off[:-1], off[1:], strict=True):
                yield kernel(np.asarray(fields[0].slice(x, y - x), np.int64), [f.slice(x, y - x) for f in fields[1:]])

    return run


def _alike(percent: int):
    """Links that hold together what the registers may find alike."""

    def kernel(cid: np.ndarray, fields: list) -> pa.RecordBatch:
        regs = np.frombuffer(b"".join(fields[1].to_pylist()), "<u2").reshape(len(cid), -1)
        return _forest(cid, _close(regs, np.asarray(fields[0], np.int64), percent))

    return _each(kernel)


def _linked(percent: int):
    """Links of the sets that reach ``percent`` percent, by their full intersections."""

    def kernel(cid: np.ndarray, fields: list) -> pa.RecordBatch:
        sets = [np.frombuffer(v, "<u8") for v in fields[0].to_pylist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        common = np.zeros((len(sets), len(sets)))
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # only elements of two sets or more count
        row, keep = np.repeat(np.arange(len(sets)), n), times[place] > 1
        row, place = row[keep], shared[place[keep]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            x, y = np.searchsorted(place, [at, at + COLUMNS])
            block = np.zeros((len(sets), COLUMNS), np.float32)
            block[row[x:y], place[x:y] - at] = 1
            common += block @ block.T
        return _forest(cid, 100 * common >= percent * (n[:, None] + n[None, :] - common))

    return _each(kernel)


def _set_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(cid, hashes) of the classes ``wanted`` (cid, rep_id, rep_key; a saved table), each from one document with that set."""
    d = docs.select(F.col(id_col).alias("__i"), text_key(text_col).alias("__t"), F.col(text_col).cast("binary").alias("text"))
    w = small(wanted.select("cid", "rep_id", "rep_key"))
    j = d.join(w, (d["__t"] == w["rep_key"]) & d["__i"].eqNullSafe(w["rep_id"])).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(shingle)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype("<u8").tobytes() for s in _sets_of(b, 1, hasher)], pa.binary())], ["cid", "hashes"])

    return j.mapInArrow(run, "cid long, hashes binary")


def candidates(classes: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all classes (cid, n_shingles, regs) that share a band and that the likelihood finds alike.

    A bucket of at most ``few`` classes gives its pairs, each compared once over all
    bands.  A larger one has its registers compared where they meet, in chunks, and gives
    no more links than it has members, whatever the number of its pairs.
    """
    every = saved(band_rows(classes, rows, bands), "bands")
    keys = saved(every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")
    met = saved(every.join(keys, "key"), "buckets")
    discard(every, keys)
    side = classes.select("cid", "n_shingles", "regs")
    lists = met.where(F.col("size") <= few).groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    pairs = lists.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b")).where("a < b").distinct()
    both = saved(pairs, "pairs")
    for x in "ab":
        both = both.join(side.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")), x)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                na, nb = (np.asarray(b.column(k), np.int64) for k in (2, 3))
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(b.num_rows, -1) for k in (4, 5))
                yield b.select(["a", "b"]).filter(pa.array(estimate(x, y, na, nb, percent / 100)[1] <= DEVIATIONS))

    found = both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(likely, "a long, b long")
    large = saved(met.where(F.col("size") > few), "large")
    if large.limit(1).count():
        groups = _meetings(large.join(side, "cid"), "key", ["n_shingles", "regs"], F.ceil(F.col("size") / chunk).cast("int"))
        found = found.union(groups.mapInArrow(_alike(percent), "a long, b long"))
    return saved(found.distinct(), "alike")


def links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect the classes (cid, n_shingles, regs, rep_id, rep_key) as all their links do.

    What the candidates connect is one group; the full sets of a group meet in one task,
    or those of every two of its chunks, where all intersections are counted.
    """
    comp = components(candidates(classes, percent, rows, bands, few, chunk))
    group = saved(comp.join(classes, comp["node"] == classes["cid"]).select("root", "cid", "n_shingles", "rep_id", "rep_key"), "groups")
    size = group.groupBy("root").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_shingles") * 8).alias("bytes"))
    cut = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int").alias("cut")
    sizes = saved(size.select("root", cut), "sizes")
    sets = _set_table(docs, group, id_col, text_col, shingle).join(group.select("root", "cid").join(sizes, "root"), "cid")
    # a document that is there twice gives its set twice, which makes no further link
    return saved(_meetings(sets, "root", ["hashes"], F.col("cut")).mapInArrow(_linked(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey (its text's key), n_shingles, component_id, kept.

    component_id is the smallest id that links of at least ``percent`` percent similarity
    lead to.  Texts without a word (null, empty, white space) have no shingle and stand
    alone.  Equal sets are one class whatever their texts; repeated rows stay.  A null id
    is passed over in the minimum (a component of null ids only has component_id null and
    is kept).  Shingles are compared by 64-bit hashes: a false match needs two of some
    thousand shingles of one pair to collide.  Other columns of ``docs`` are not read.
    """
    s = saved(sketches(docs, id_col, text_col, shingle, rows, bands), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("rep")
    c = s.where("n_shingles > 0").groupBy("skey").agg(F.min("doc_id").alias("low"), first, F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    c = c.select(F.monotonically_increasing_id().alias("cid"), "skey", "low", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key"), "n_shingles", "regs")
    classes = saved(c, "classes")
    comp = components(links(docs, classes, id_col, text_col, shingle, percent, rows, bands, few, chunk))
    label = classes.select("cid", "skey", "low")
    rooted = saved(label.join(comp, label["cid"] == comp["node"], "left").select("skey", "low", F.coalesce("root", "cid").alias("root")), "rooted")
    lows = saved(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "roots")
    label = saved(rooted.join(lows, "root").select("skey", "component_id"), "labels")
    out = s.select("doc_id", "tkey", "n_shingles", "skey").join(label, "skey", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tkey", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and survival of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
classes AS MATERIALIZED (SELECT min(r) AS r, min(doc_id) AS low, g, len(g) AS n FROM (SELECT r, doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
x AS MATERIALIZED (SELECT r, n, unnest(g) AS e FROM classes),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM x AS a JOIN x AS b ON a.e = b.e AND a.r < b.r
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM classes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comp AS (SELECT reach.a AS r, min(c.low) AS low FROM reach JOIN classes AS c ON reach.b = c.r GROUP BY reach.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE comp.low END AS component_id,
    s.doc_id IS NOT DISTINCT FROM CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE comp.low END AS kept
FROM s LEFT JOIN classes AS k ON list_sort(s.g) = k.g LEFT JOIN comp ON k.r = comp.r
"""
