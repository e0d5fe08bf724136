"""Spelling variants, conversation repair and set sketches against plain versions, on odd rows, ties, copies and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import helpers as H
from vitalis.llm import repair, setsketch, spelling

COLUMNS = {
    "op11_spelling": ("word", "form", "root", "n", "n_near", "form_n"),
    "op12_conversations": ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"),
    "op13_setsketch": ("doc_id", "n_shingles", "component_id", "kept"),
}


def written_tables(spark, tmp_path, name, df) -> str:
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- spelling variants


def misspelt(seed: int) -> list[tuple]:
    """Words with copies one edit away, chains of them, accents, doubled letters and a run without end."""
    r = random.Random(seed)
    base = ["balloon", "committee", "résumés", "aaaaaaa", "naïveté", "wordings" * 9]
    rows = list(H.edge_rows())
    rows = [(x[0], x[1]) for x in rows]
    for i in range(260):
        words = []
        for _ in range(40):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                p, k = r.randrange(len(w)), r.random()
                w = w[:p] + r.choice("abé") + w[p:] if k < 0.3 else w[:p] + w[p + 1 :] if k < 0.6 else w[:p] + r.choice("ae") + w[p + 1 :]
            words.append(r.choice([w, w.upper(), w.title()]))
        rows.append((100 + i, r.choice([" ", "-", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("cut", [spelling.CUT, 40])
def test_variants_equal_a_plain_version(spark, cut):
    rows = misspelt(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = H.rows_of(spelling.variants(spelling.vocabulary(docs), cut=cut), *COLUMNS["op11_spelling"])
    want = H.variants(rows)
    assert any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1])
    assert got == want


def test_pairs_of_long_words_and_groups():
    r = random.Random(3)
    for n in (6, 12, 47, 48, 49, 50, 51, 70):
        base = "".join(r.choice("ab") for _ in range(n))
        words = {base}
        for _ in range(30):
            w = base
            for _ in range(r.randrange(3)):
                p, k = r.randrange(len(w)), r.random()
                w = w[:p] + r.choice("abé") + w[p:] if k < 0.4 else w[:p] + w[p + 1 :] if k < 0.7 else w[:p] + r.choice("abé") + w[p + 1 :]
            words.add(w)
        groups = [sorted(words), ["", "a", "aa", "b"], ["x"]]
        x, y, place = spelling.near_pairs(groups)
        flat = [w for g in groups for w in g]

        def near(v, w):
            return v != w and w in {v[:i] + c + v[i + k :] for i in range(len(v) + 1) for c in ("", "a", "b", "é") for k in (0, 1)}

        assert sorted((flat[i], flat[j]) for i, j in zip(x, y, strict=True)) == sorted((v, w) for g in groups for v in g for w in g if near(v, w))
        assert all(flat[i][:p] == flat[j][:p] and flat[i][p : p + 1] != flat[j][p : p + 1] for i, j, p in zip(x, y, place, strict=True))


def test_runs_of_a_long_text_are_those_of_the_whole(monkeypatch):
    text = H.prose(5, 3000) + " É" + "x" * 500 + "ÀÉ1é" + H.prose(6, 50)
    whole = [w for part in spelling.runs_of(text) for w in part]
    monkeypatch.setattr(spelling, "STEP", 97)
    assert [w for part in spelling.runs_of(text) for w in part] == whole


def test_spelling_query_on_files(spark, tmp_path):
    rows = [(*x[:2], None, None, None) for x in misspelt(2)]
    sf = written_tables(spark, tmp_path, "documents", H.frame(spark, rows))
    assert H.rows_of(spelling.op11_spelling(spark, sf), *COLUMNS["op11_spelling"]) == H.variants([x[:2] for x in rows])


def test_no_word_no_variant(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "short one")], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(docs)).count() == 0
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_a_chain_of_forms_ends_at_its_last(spark):
    n = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 15625)]
    got = dict(H.rows_of(spelling.variants(spark.createDataFrame(n, "word string, n long")), "word", "root"))
    assert set(got.values()) == {"abbbbb"}


# ---- conversations


def talks(seed: int, n: int = 150) -> list[tuple]:
    """Conversations with odd roles, nulls in every column, ties, repeated rows and gaps."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 12)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "umpire"])
            text = r.choice(["Yes.", "No?", "cut", " ", "", None, f"text {t}!", f"long {t} \n", "é."])
            rows.append((c if c else None, r.choice([t, t, t, t + 1, None]), role, text))
    return rows + rows[:7]


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long, segment", [(repair.LONG, repair.SEGMENT), (2, 3), (0, 1), (5, 64)])
def test_repairs_equal_all_edits(spark, long, segment):
    rows = talks(1)
    df = spark.createDataFrame(rows, TALK).repartition(3).withColumn("m", F.lit(1)).withColumn("ck", F.lit("x"))
    got = repair.repair(repair.damaged(df), long=long, segment=segment)
    assert H.rows_of(got, *COLUMNS["op12_conversations"]) == H.conversation_rows(rows)


def test_repaired_rows_are_the_text_of_the_digest(spark):
    rows = talks(2, 40)
    want = [(c, *x) for c, r in H.damage(rows).items() for x in H.repaired(r)[-1]]
    for long in (repair.LONG, 3):
        got = repair.repaired_rows(repair.damaged(spark.createDataFrame(rows, TALK)), long=long, segment=4)
        assert sorted(((r.conv_id, r.role, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
        assert got.groupBy("conv_id", "place").count().where("count > 1").count() == 0


def test_searches_of_pieces_give_the_least_cheapest_edits():
    r = random.Random(7)
    for n in [0, 1, 2, 5, 9, 31, 32, 33, 64, 65, 100]:
        for _ in range(6):
            rows = [(i, r.choice(["system", "user", "assistant", "tool"]), r.choice([f"a{i}.", f"b{i}", "", "same."])) for i in range(n)]
            codes, faults = repair._coded([(t, role, text, {"s": 1, "u": 2, "a": 3}.get(role[0], 0) + (4 if not text else 8 if text[-1] != "." else 0)) for t, role, text in rows])
            want = H.repaired(rows)
            cost, audit, _ = repair.solve(codes)
            assert (tuple(faults), cost, audit) == (want[1:4], want[5], want[6])
            assert repair.costs(codes, None)[0] == cost


def test_conversation_query_on_files(spark, tmp_path):
    rows = talks(3)
    df = spark.createDataFrame(rows, TALK).withColumn("gone", F.lit(1)).withColumn("cost", F.lit("x"))
    sf = written_tables(spark, tmp_path, "conversations", df)
    assert H.rows_of(repair.op12_conversations(spark, sf), *COLUMNS["op12_conversations"]) == H.conversation_rows(rows)
    sf = written_tables(spark, tmp_path / "none", "conversations", df.limit(0))
    assert repair.op12_conversations(spark, sf).count() == 0


def test_a_hot_conversation_is_split(spark):
    rows = [(1, i % 700, ["user", "assistant", "system"][i % 3], f"text {i % 900}" + "." * (i % 5 > 0)) for i in range(6000)] + [(2, 0, "user", "Hello.")]
    got = repair.repair(repair.damaged(spark.createDataFrame(rows, TALK)), long=1000, segment=512)
    r = {x.conv_id: x for x in got.collect()}
    w = H.damage(rows)[1]
    codes, faults = repair._coded([(t, role, text, {"s": 1, "u": 2, "a": 3}[role[0]] + (4 if not text.strip() else 0 if text[-1] in ".!?" else 8)) for t, role, text in w])
    cost, audit, _ = repair.solve(codes)
    assert (r[1].cost, r[1].audit, [r[1].blank, r[1].duplicate, r[1].truncated], r[1].illegal) == (cost, audit, faults, repair._illegal(codes))


# ---- set sketches


def copies(seed: int) -> list[tuple]:
    """Texts with exact and near copies around the threshold, from one word to thousands."""
    r = random.Random(seed)
    rows = [(x[0], x[1]) for x in H.edge_rows()]
    k = 1000
    for size in (1, 4, 5, 6, 30, 100, 400, 3000):
        base = H.prose(seed + size, size).split()
        for _ in range(14):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, max(1, size // 120)])):
                w[r.randrange(len(w))] = r.choice(["changed", "CHANGED", "other"])
            rows.append((k, r.choice([" ", "\n", " \t"]).join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("few, chunk", [(setsketch.FEW, setsketch.CHUNK), (1, 4), (100, 4)])
def test_near_sets_equal_all_pairs(spark, few, chunk):
    rows = copies(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit(1)).withColumn("skey", F.lit("x"))
    got = setsketch.near_duplicates(docs, few=few, chunk=chunk)
    assert H.rows_of(got, *COLUMNS["op13_setsketch"]) == H.near_sets(rows)


def test_near_sets_query_on_files(spark, tmp_path):
    rows = [(*x, None, "s", 3) for x in copies(4)]
    sf = written_tables(spark, tmp_path, "documents", H.frame(spark, rows))
    assert H.rows_of(setsketch.op13_setsketch(spark, sf), *COLUMNS["op13_setsketch"]) == H.near_sets([x[:2] for x in rows])


def test_no_row_and_no_bucket(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " \n"), (3, "a lone text")], "doc_id long, text string")
    assert H.rows_of(setsketch.near_duplicates(docs), *COLUMNS["op13_setsketch"]) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (None, 0, None, True)]
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_bucket_makes_no_more_links_than_members(spark):
    rows = [(i, H.prose(30, 200) + f" end {i}") for i in range(120)]
    s = setsketch.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = s.select(F.col("doc_id").alias("cid"), "n_shingles", "regs")
    got = setsketch.candidates(classes, few=4)
    assert setsketch.BANDS * len(rows) > got.count() >= len(rows) - 1
    met = setsketch._meetings(spark.createDataFrame([(k, i) for k in range(2) for i in range(40)], "key long, cid long"), "key", [], F.lit(5))
    together = {(x, y) for r in met.collect() for x in (m.cid for m in r.m) for y in (m.cid for m in r.m)}
    assert together == {(x, y) for x in range(40) for y in range(40)}


def test_registers_merge_and_tell_similarity():
    s = setsketch.Sketcher(1024)
    r = np.random.default_rng(1)
    for j in (0.1, 0.5, 0.85, 0.95):
        n = 4000
        x = r.integers(0, 1 << 64, 2 * n, np.uint64)
        shared = int(2 * n * j / (1 + j))
        a, b = x[:n], x[n - shared : 2 * n - shared]
        ra, rb = s.registers(a), s.registers(b)
        assert (setsketch.merged(ra, rb) == s.registers(np.union1d(a, b))).all()
        got, off = setsketch.estimate(ra[None], rb[None], np.array([n]), np.array([n]), 0.85)
        assert abs(got[0] - j) < 0.06
        assert (off[0] <= setsketch.DEVIATIONS) == (j >= 0.85)


def test_hashes_of_long_texts_equal_those_of_pieces(monkeypatch):
    text = (H.prose(8, 4000) + " " + "y" * 700 + " end of it").encode()
    whole = setsketch.ShingleHasher().sets([text, b"", None, b"One two"])
    monkeypatch.setattr(setsketch, "STEP", 900)
    cut = setsketch.ShingleHasher().sets([text, b"", None, b"One two"])
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and [len(x) for x in whole[1:]] == [0, 0, 1]
