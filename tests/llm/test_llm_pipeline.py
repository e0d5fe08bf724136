"""The pipeline against its stages by brute force, and the registration of the queries."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from llm import helpers as H
from vitalis.llm import common, encode, langid, secrets

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = E.queries()
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scans", "packing"]
    for i in range(1, 11):
        assert sum(re.match(rf"op{i}_", n) is not None for n in names) == 1


def test_pipeline(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    table = common.table(spark, SMALL, "documents")
    bad = {r["doc_id"] for r in langid.identify(table).where("rejected").collect()}
    kept = [d for d in docs if d["doc_id"] not in bad]
    comp = H.closest([H.simhash(d["text"]) for d in kept], [d["doc_id"] for d in kept])
    kept = [d for d, c in zip(kept, comp, strict=True) if d["doc_id"] == c]
    kept = [d for d in kept for n, h, _, _ in [H.contamination(d["text"], items)] if not (h and 20 * h >= n)]
    tok = Tokenizer.from_file(encode.tokenizer_path("word_bpe_49k.json"))
    want = []
    for d in kept:
        s = H.spans(d["text"])
        ids = [*tok.encode(secrets.masked(d["text"], [(a, b) for _, a, b in s]), add_special_tokens=False).ids, 0]
        want += [(d["doc_id"], i // 2048, i, len(ids[i : i + 2048]), H.crc(ids[i : i + 2048])) for i in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, SMALL)
    assert 0 < len(kept) < len(docs)
    assert H.rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    used = len({r[0] for r in got.select("sequence_id").collect()})
    assert used == -(-sum(w[3] for w in want) // 2048) or used <= 1.02 * np.ceil(sum(w[3] for w in want) / 2048) + 1


@pytest.mark.parametrize("i", range(5))
def test_stages_on_edge_rows_and_empty_tables(spark, i):
    name, stage = corpus_pipeline.STAGES[i]
    for rows in (H.edge_rows(), []):
        docs = H.frame(spark, rows)
        out = stage(spark, common.saved(docs, "in"), SMALL)
        if i < 4:
            assert out.columns == docs.columns
            assert common.saved(out, "out").count() <= len(rows)
        else:
            assert out.count() >= len(rows)
