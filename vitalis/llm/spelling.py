"""Spelling variants: sorted vocabulary scanned with banded edit-matrix rows that words with a common prefix share.

Words one edit apart agree before and after the edited place.  A window (size, a, b) holds
the words of ``size`` code points and those one shorter, cut by their first ``a`` and last
``b`` code points: words of one cut are sorted, and the rest of each word is compared with
the others.  A cut that holds too much is cut again, on either half of what it leaves free,
down to a single place, where the alphabet bounds it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.llm.common import discard, saved, small, table

MIN_LENGTH = 6
MIN_COUNT = 5
#: A word's form is at least so many times as frequent.
RATIO = 5
#: A run's last code point goes at one of so many (document, run) pairs, by their checksum.
DAMAGE = 199
#: Code points of the words of a cut, beyond which it is cut again.
CUT = 1 << 16
#: Places of the words that are scanned side by side; what is left of longer words is compared whole.
DEPTH = 48
#: Words that a task holds at once, those of them that scan side by side, and code points of text searched at once.
SLICE = 1 << 14
QUERIES = 1 << 10
STEP = 1 << 20
#: Words a task counts before it hands the counts on.
COUNTED = 1 << 18

_RUNS = re.compile("[a-z\xc0-\xff]+")


def runs_of(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters in slices of a text, lower-cased A-Z."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if len(low) <= STEP:
        yield _RUNS.findall(low)
        return
    at = 0
    while at < len(low):
        to = min(at + STEP, len(low))
        rest = _RUNS.match(low, to)
        to = rest.end() if rest and to < len(low) else to
        yield _RUNS.findall(low, at, to)
        at = to


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of all words of ``docs``; ``damage`` 0 leaves the runs as they are.

    With damage d, a run whose crc32 (with ``<id>:`` before it; a null id is empty) is a
    multiple of d loses the code point at that checksum modulo its length.
    """
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words, counts = list(total.keys()), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                base = zlib.crc32(f"{i.as_py()}:".encode())
                for found in runs_of(t.as_py()):
                    for w, n in Counter(w for w in found if len(w) >= min_length).items():
                        if damage:
                            h = zlib.crc32(w.encode(), base)
                            if h % damage == 0:
                                p = h % len(w)
                                w = w[:p] + w[p + 1 :]
                                if len(w) < min_length:
                                    continue
                        total[w] += n
                if len(total) > COUNTED:
                    yield out()
        yield out()

    part = src.mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _cut(word: Column, a: Column, b: Column) -> Column:
    """The first ``a`` and last ``b`` code points of a word."""
    return F.concat(F.substr(word, F.lit(1), a), F.lit("\n"), F.substr(word, F.length(word) - b + 1, b))


def _halves(size: Column, a: Column, b: Column) -> Column:
    """The two windows in which the places that (a, b) leaves free are cut in half."""
    left = F.floor((size - a - b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), (size - a - left).alias("b")), F.struct((a + left).alias("a"), b.alias("b")))


def windows(words: DataFrame, cut: int = CUT) -> Iterator[DataFrame]:
    """Frames of groups (size, a, b, words array of (word, n)): two words one edit apart are together in one at least."""
    size = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    rows = words.select("word", "n", size).withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    while True:
        rows = rows.select("word", "n", "size", F.explode(_halves(F.col("size"), F.col("a"), F.col("b"))).alias("w"))
        rows = rows.select("word", "n", "size", "w.a", "w.b", _cut(F.col("word"), F.col("w.a"), F.col("w.b")).alias("key"))
        rows = saved(rows, "windows")
        keys = ["size", "a", "b", "key"]
        count = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("word")).alias("chars"))
        many = saved(count.where((F.col("m") > 1) & (F.col("chars") > cut) & (F.col("size") - F.col("a") - F.col("b") > 1)).select(*keys), "hot")
        some = many.limit(1).count() > 0
        rest = rows.join(many, keys, "left_anti") if some else rows
        yield rest.groupBy(*keys).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1).select("size", "a", "b", "words")
        if not some:
            return
        rows = rows.join(many, keys, "left_semi").drop("key")


def _common(x: str, y: str) -> int:
    """Code points that two words begin with alike."""
    lo, hi = 0, min(len(x), len(y))
    if x[:hi] == y[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
    return lo


class _Sorted:
    """Words of several groups, each group sorted, with the codes of their places and the common prefixes of neighbours."""

    def __init__(self, groups: list[list[str]]) -> None:
        self.words = [w for g in groups for w in g]
        size = np.fromiter(map(len, groups), np.int64, len(groups))
        ends = np.cumsum(size)
        self.lo, self.hi = np.repeat(ends - size, size), np.repeat(ends, size)
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.width = min(int(self.length.max(initial=0)), DEPTH) + 2
        text = "".join(w[: self.width].ljust(self.width, "\0") for w in self.words)
        self.code = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(self.words), self.width)
        self.lcp = np.append(-1, self.common(np.arange(1, len(self.words)), np.arange(len(self.words) - 1)))[: len(self.words)]
        self.lcp[ends - size] = -1

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places (up to the width) that words ``x`` and ``y`` begin with alike; no word holds the 0 that follows a word."""
        differ = self.code[x] != self.code[y]
        return np.where(differ.any(1), differ.argmax(1), self.width)


def _scanned(s: _Sorted, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs (query, word) of the queries ``q`` and the words of their groups that are one edit apart."""
    lo, hi = s.lo[q], s.hi[q]
    # the band of row d of the edit matrix: d - 1, d and d + 1 code points of the query
    band = np.tile(np.array([2, 0, 1], np.int8), (len(q), 1))
    first, second = [], []
    for d in range(DEPTH + 1):
        done = s.length[lo] == d  # a word that ends here is the first of its range
        rest = s.length[q] - d
        hit = np.flatnonzero(done & (np.abs(rest) <= 1))
        hit = hit[band[hit, rest[hit] + 1] == 1]
        first.append(q[hit])
        second.append(lo[hit])
        lo = lo + done
        keep = lo < hi
        q, lo, hi, band = q[keep], lo[keep], hi[keep], band[keep]
        if d == DEPTH or not len(q):
            break
        # ranges with one more place in common begin where neighbours share no more than d
        start = np.append(np.flatnonzero(s.lcp <= d), len(s.words))
        at, to = np.searchsorted(start, lo), np.searchsorted(start, hi)
        e = np.repeat(np.arange(len(q)), to - at)
        k = np.arange(len(e)) + np.repeat(at - np.cumsum(to - at) + (to - at), to - at)
        q, lo, hi, old = q[e], start[k], np.minimum(start[k + 1], hi[e]), band[e]
        c = s.code[lo, d]
        left = np.minimum(old[:, 0] + ((c != s.code[q, d - 1]) if d else 1), old[:, 1] + 1)
        mid = np.minimum(np.minimum(old[:, 1] + (c != s.code[q, np.minimum(d, s.width - 1)]), old[:, 2] + 1), left + 1)
        right = np.minimum(old[:, 2] + (c != s.code[q, np.minimum(d + 1, s.width - 1)]), mid + 1)
        band = np.minimum(np.stack([left, mid, right], 1), 2).astype(np.int8)
        keep = band.min(1) <= 1
        q, lo, hi, band = q[keep], lo[keep], hi[keep], band[keep]
    for x, a, b in zip(q.tolist(), lo.tolist(), hi.tolist(), strict=True):  # longer words that agree so far
        near = [y for y in range(a, b) if _one_edit(s.words[x], s.words[y])]
        first.append(np.full(len(near), x))
        second.append(np.array(near, np.int64))
    return first, second


def near_pairs(groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one group that are one edit apart: places (query, word) in the groups in a row, in both directions,
    and the places that the two begin with alike.

    Each group is sorted and without repeats.  QUERIES queries scan their sorted lists at
    once, place by place: words that share a prefix (by the common prefixes of neighbours)
    are one range, whose row of the banded edit matrix is computed once, from the row of
    the range that holds it; ranges whose row has no entry of one or less are skipped.
    """
    s = _Sorted(groups)
    got = [_scanned(s, np.arange(i, min(i + QUERIES, len(s.words)))) for i in range(0, len(s.words), QUERIES)]
    x, y = (np.concatenate([np.zeros(0, np.int64), *(v for g in got for v in g[k])]).astype(np.int64) for k in (0, 1))
    place = s.common(x, y)
    for i in np.flatnonzero(place == s.width).tolist():
        place[i] = _common(s.words[x[i]], s.words[y[i]])
    return x, y, place


def _one_edit(x: str, y: str) -> bool:
    if len(x) < len(y):
        x, y = y, x
    if x == y or len(x) - len(y) > 1:
        return False
    p = _common(x, y)
    return x[p + 1 :] == (y[p + 1 :] if len(x) == len(y) else y[p:])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each group's words: (word, n_near, form, form_n), the form among this group's near words alone."""
    windows: list[tuple[int, int, int]] = []
    groups: list[list[tuple[str, str, int]]] = []

    def out() -> pa.RecordBatch:
        rows = [r for g in groups for r in g]
        size, a, b = np.repeat(np.array(windows, np.int64), [len(g) for g in groups], axis=0).T
        length = np.fromiter((len(r[1]) for r in rows), np.int64, len(rows))
        x, y, place = near_pairs([[r[0] for r in g] for g in groups])
        # a pair counts in one window alone: that of its longer word's size, and of the first place where the
        # whole words differ; where one middle begins the other, that place may lie in what follows
        ok = np.maximum(length[x], length[y]) == size[x]
        x, y, place = x[ok], y[ok], place[ok] + a[x[ok]]
        for i in np.flatnonzero(place == np.minimum(length[x], length[y]) - b[x]).tolist():
            place[i] = _common(rows[x[i]][1], rows[y[i]][1])
        ok = place < size[x] - b[x]
        n: Counter[int] = Counter()
        best: dict[int, tuple[int, str]] = {}
        for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            n[i] += 1
            this = (-rows[j][2], rows[j][1])
            if i not in best or this < best[i]:
                best[i] = this
        cols = [pa.array([rows[i][1] for i in n], pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([best[i][1] for i in n], pa.string()), pa.array([-best[i][0] for i in n], pa.int64())]
        windows.clear(), groups.clear()
        return pa.RecordBatch.from_arrays(cols, ["word", "n_near", "form", "form_n"])

    held = 0
    for b in batches:
        m = b.column(3)
        off = np.asarray(m.offsets).tolist()
        words, counts = (m.values.field(k).to_pylist() for k in (0, 1))
        for g, w in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
            members = [(x[w[1] : len(x) - w[2]], x, n) for x, n in zip(words[off[g] : off[g + 1]], counts[off[g] : off[g + 1]], strict=True)]
            windows.append(w)
            groups.append(sorted(members))
            held += len(members)
            if held >= SLICE:
                yield out()
                held = 0
    if groups:
        yield out()


def near_words(words: DataFrame, cut: int = CUT) -> DataFrame:
    """(word, n_near, form, form_n): the number of words one edit away and the most frequent of them (ties: the least)."""
    parts = None
    for g in windows(words, cut):
        p = saved(g.mapInArrow(_scan, "word string, n_near long, form string, form_n long"), "near")
        parts = p if parts is None else parts.union(p)
    top = F.min(F.struct((-F.col("form_n")).alias("c"), "form")).alias("top")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", F.col("top.form").alias("form"), (-F.col("top.c")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form): forms followed to the last, by doubling steps.

    A form is at least RATIO times as frequent, so a chain is short and has no circle.
    """
    r = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = r.select(F.col("word").alias("root"), F.col("root").alias("far"))
        j = saved(r.join(small(nxt), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        discard(r)
        r = j.select("word", "root")
        if j.where("moved").limit(1).count() == 0:
            return r


def variants(words: DataFrame, ratio: int = RATIO, cut: int = CUT) -> DataFrame:
    """One row per row of ``words`` (word, n; distinct words): word, n, n_near, form, form_n, root.

    Two words are near if one inserted, deleted or replaced code point makes them equal.
    A word's form is its near word of largest n (ties: the least in code-point order) if
    that is at least ``ratio`` times its own n, else null; the root follows forms to the
    last.  Other columns are not read; no word gives no row.
    """
    w = saved(words.select("word", "n"), "words")
    near = saved(near_words(w, cut), "near")
    j = w.join(near, "word", "left")
    ok = F.col("form_n") >= ratio * F.col("n")
    j = saved(j.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("form")).alias("form"), F.when(ok, F.col("form_n")).alias("form_n")), "forms")
    r = roots(j.where("form is not null"))
    return j.join(r, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))


OP11_SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
found AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
raw AS (SELECT w, n, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END
    FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, '')]) AS b FROM found),
sums AS (SELECT w, n, xor(list_reduce(list_concat([4294967295::BIGINT], b::BIGINT[]), lambda c, x: xor(c >> 8,
    list_reduce([xor(c, x) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda d, k: xor(d >> 1, 3988292384 * (d & 1))))), 4294967295) AS h FROM raw),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM sums)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT less.word, less.n, words.word AS other, words.n AS other_n FROM less JOIN words ON less.d = words.word),
pairs AS (SELECT a.word, b.word AS form, b.n AS form_n FROM less AS a JOIN less AS b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
    UNION SELECT word, other, other_n FROM shorter UNION SELECT other, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(form_n) AS top FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN (SELECT min(p.form) FROM pairs AS p WHERE p.word = w.word AND p.form_n = b.top) END AS form,
    CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n FROM words AS w LEFT JOIN best AS b ON w.word = b.word),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, f.form FROM chain JOIN forms AS f ON chain.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN forms AS f ON chain.root = f.word WHERE f.form IS NULL)
SELECT forms.word, n, n_near, form, form_n, root FROM forms JOIN ends ON forms.word = ends.word
"""
