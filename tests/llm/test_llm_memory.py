"""What a Python worker holds besides its texts."""

import random
import tracemalloc

from vitalis.llm import encode


def test_an_encoder_works_in_small_blocks():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(2000)]  # about 4 MB, as much as an Arrow batch
    e = encode.ChunkEncoder(encode.tokenizer_path("word_bpe_49k.json"))
    e.encode(texts[:200])
    tracemalloc.start()
    try:
        rows = sum(n for _, n, _, _ in e.batches(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 12e6, peak
