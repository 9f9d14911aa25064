import zlib

import numpy as np
import pytest

from tallyscope.llm.packing import WordTokens, pack_documents, plan_group, step_groups
from tallyscope.llm.queries import tokenizer_path


def check_plan(tokens):
    d, s, n, q, o, tier = plan_group(np.array(tokens))
    for i, t in enumerate(tokens):
        mine = sorted((a, b) for a, b in zip(s[d == i], n[d == i]))
        at = 0
        for a, b in mine:
            assert a == at and b > 0
            at += b
        assert at == t
    padded = 0
    for k in range(len(tier)):
        mine = sorted((a, b) for a, b in zip(o[q == k], n[q == k]))
        at = 0
        for a, b in mine:
            assert a == at
            at += b
        assert 0 < at <= tier[k] <= 2048
        padded += at != tier[k]
    assert padded <= 1
    return tier


@pytest.mark.parametrize("seed", range(8))
def test_every_token_once_and_one_padded_sequence(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.choice([1, 2, 255, 256, 257, 2047, 2048, 2049, 9000, *rng.integers(1, 4000, 20)], rng.integers(1, 200))
    tier = check_plan(tokens.tolist())
    steps = step_groups(tier, 8192)
    loads = np.bincount(steps, weights=tier)
    assert loads.max() - loads.min() <= 2 * 2048


def test_single_tokens_and_exact_windows():
    check_plan([1])
    check_plan([1] * 5000)
    check_plan([2048] * 3)
    check_plan([256, 512, 1024, 2048, 4096])


def texts():
    return ["Hello, WORLD 12 abc-def's ok", "", None, "don't \t ÉCOLE ßtraße × naïve\nline", "日本語 ΣΑΣ", "<|endoftext|> x", "word " * 3000, " \n ", "a\x0bb\x1cc", "Hello, WORLD 12 abc-def's ok"]


def test_words_looked_up_are_the_tokenizers(words):
    import pyarrow as pa

    w = WordTokens(tokenizer_path(), known=50)
    for batch in (texts(), [words(300) for _ in range(5)], texts()):
        ids, bounds = w.encode(pa.array(batch))
        for t, a, b in zip(batch, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == w.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_names_of_special_tokens():
    import pyarrow as pa
    from tokenizers import Tokenizer

    batch = ["a <|endoftext|> b", "<|startoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "plain", "<|endof text|>"]
    for as_text in (False, True):
        t = Tokenizer.from_file(tokenizer_path())
        t.encode_special_tokens = as_text
        ids, bounds = WordTokens(tokenizer_path(), special_as_text=as_text).encode(pa.array(batch))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [t.encode(x, add_special_tokens=False).ids for x in batch]


def test_pieces_spell_the_documents(spark, words):
    rows = [(i, t, "x", 5) for i, t in enumerate(texts() + [words(700) for _ in range(30)])] + [(None, "no id", "x", 1), (0, texts()[0], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    out = pack_documents(docs, tokenizer_path(), group_tokens=4000).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, text, *_ in rows:
        want.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    for i, copies in want.items():
        mine = [r for r in out if r.doc_id == i]
        assert {r.doc_tokens for r in mine} == {len(copies[0])}
        assert sum(r.length for r in mine) == sum(map(len, copies))
        for r in mine:
            assert r.ids == copies[0][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(sum(r.length for r in rs) != rs[0].tier for rs in by.values()) <= 12


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
