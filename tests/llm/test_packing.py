import random
import zlib

import numpy as np
import pytest

from gristmill.llm import packing
from gristmill.llm.queries import tokenizer_definition

SCHEMA = "doc_id long, text string, n long, g string, row int"
END = 2


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_definition())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, END]


def test_words_give_the_ids_of_whole_texts(reference):
    texts = ["", None, "Hello, world! it's", "a\x1cb\x1dc d", "né NÉ \u0301 x\u0301 ΣΑΣ σας İ", "1²Ⅷ ３", "a\u00a0b\u2003c\u3000d\x85e", "<|endoftext|> x<|startoftext|>", "\x01", "a\x01b \x01 c", "tab\tnew\r\nline\x0b\x0c", "😀👍🏽 ñ\u200bz", " lead and trail "]
    texts += ["".join(chr(c) for c in range(a, a + 40)) for a in range(0, 256, 8)] + ["a" + chr(c) + "b" + chr(c) + " " + chr(c) for c in range(256)]
    texts += ["It'S can't I'LL we've x'd 'sa ''t", "v1.2-beta_3, (see: [x])...!?", "</w> <|endoftext|>", "½x² 3³", "ß ẞ Ÿ ÿ µ"]
    texts.append(" ".join(random.Random(3).choice(["Über", "l'été", "don't", "x_y", "--", "日本語"]) for _ in range(3000)))
    got = packing.WordTokenizer(tokenizer_definition(), END).encode(texts)
    assert [g.tolist() for g in got] == [reference(t) for t in texts]
    rng = random.Random(7)
    signs = "ab stmdrevl'' \t\n12é²µ×\u00a0\x85.,-A\u00c9"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(4000)]
    got = packing.WordTokenizer(tokenizer_definition(), END).encode(texts)
    assert [g.tolist() for g in got] == [reference(t) for t in texts]


def test_windows_hold_every_item_once():
    rng = random.Random(5)
    for n in (0, 1, 2, 300):
        sizes = [rng.randrange(1, 100) for _ in range(n)]
        found = packing.windows(sizes, 100)
        assert sorted(i for w in found for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= 100 for w in found)
    assert sorted(map(sorted, packing.windows([60, 60, 60], 100))) == [[0], [1], [2]]  # the least count is two


def test_differencing_is_near_equal():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 4096) for _ in range(1000)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 100)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 0.02 * max(sums)
    assert [sorted(w) for w in packing.differencing([4, 5, 6, 7, 8], 2)] in ([[0, 1, 3], [2, 4]], [[2, 4], [0, 1, 3]], [[1, 2, 0], [3, 4]], [[0, 1, 2], [3, 4]], [[3, 4], [0, 1, 2]])


def test_pieces(spark, reference):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["cat", "Dog's", "été", "zzqx", "12"]) for _ in range(rng.choice([0, 3, 50, 900, 5000]))) for _ in range(60)] + [None, "", "x y"]
    rows = [(i, t, 1, "", 2) for i, t in enumerate(texts)]
    got = packing.with_checksums(packing.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_definition(), capacity=512, group_rows=16)).collect()
    ids = {i: reference(t) for i, t in enumerate(texts)}
    for i, want in ids.items():
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512


def test_odd_rows(spark, reference):
    rows = [(None, "a b", 1, "", 2), (1, "a b", 1, "", 2), (1, "a b", 1, "", 2), (2, None, 1, "", 2)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_definition()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 1)]
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_definition()).collect() == []
