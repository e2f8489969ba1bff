"""Operators 2, 3 and 6 against the libraries over whole texts."""

import random
import zlib

import numpy as np
import pytest

from arborq.llm import bestfit, bitpack, common, tokencount, tokenizing
from arborq.llm.tokenizing import Encoder, encoder, le_bytes, tokenizer_path

STRANGE = "ab cdé'sÉ\n\t  .,!<|endoftext|>09İKſ\x1c\x85\xa0ﬁΣς漢字é’“”–…'ll ▁ <s> </s>"


def strange(seed, n=4000):
    r = random.Random(seed)
    return ["".join(r.choice(STRANGE) for _ in range(r.randrange(40))) for _ in range(n)] + ["<|endoftext|>", "a<|endoftext|>b", " a  b   \n c", "\n\n", " "]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_encoder_gives_the_librarys_ids(name):
    e = Encoder(tokenizer_path(name))
    for text in strange(3):
        assert e.encode(text) == le_bytes(e.tokenizer.encode(text, add_special_tokens=False).ids), text
    assert e.encode(None) == b""


def test_packing_bits_is_lossless():
    r = np.random.default_rng(1)
    for width in range(1, 33):
        for n in (0, 1, 63, 64, 65, 5000):
            ids = r.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
            data = bitpack.pack(ids, width)
            assert len(data) == -(-n // 64) * 8 * width and (bitpack.unpack(data, n, width) == ids).all()
    assert [bitpack.width_for(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        bitpack.pack(np.array([4], np.uint32), 2)


def test_chunks_give_any_range_and_notice_damage():
    r = np.random.default_rng(2)
    docs = [r.integers(0, 50257, n).astype(np.uint32) for n in (1, 5000, 0, 4096, 9000, 3)]
    for width in (16, 17):
        data = bitpack.write_chunk([7, None, 9, 9, 11, 12], docs, width, first=100)
        chunk = bitpack.Chunk(data)
        flat = np.concatenate(docs)
        for a, b in ((0, 1), (4090, 4100), (0, len(flat)), (8192, 8192), (len(flat) - 1, len(flat))):
            assert (chunk.ids(a, b) == flat[a:b]).all()
        assert [d for d, _, _ in chunk.docs()] == [7, None, 9, 9, 11, 12]
        assert all((x == y).all() for (_, _, x), y in zip(chunk.docs(), docs, strict=True))
        assert (chunk.doc(4) == docs[4]).all()
        with pytest.raises(ValueError):
            bitpack.Chunk(data[:-1])


def brute_ids(rows, end):
    e = encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    start, out = 0, []
    for d, text in rows:
        ids = e.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(le_bytes(ids))))
        start += len(ids)
    return out


def test_packed_ids_match_the_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in documents(spark, sf).collect())
    got = sorted(map(tuple, bitpack.op2_bit_packed_ids(spark, sf).collect()))
    assert got == brute_ids(rows, 0)


def test_packed_ids_of_odd_rows(spark, odd, none):
    for df in (odd, none):
        path = common.new_path(spark, "t")
        bitpack.write(df, path, tokenizer_path("byte_bpe_50k.json"))
        got = sorted((r.start, r.n_tokens) for r in bitpack.read(spark, path).collect())
        assert len(got) == df.count() and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))


def optimum(lengths, capacity):
    """The fewest sequences, by trying all."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0] if lengths else 0


def used(patterns, capacity):
    total, n = {}, 0
    for content, times in patterns:
        assert sum(a * b for a, b in content) <= capacity and times > 0
        n += times
        for a, b in content:
            total[a] = total.get(a, 0) + b * times
    return total, n


def test_reduction_keeps_an_optimum():
    r = random.Random(4)
    fixed_some = 0
    for _ in range(300):
        capacity = r.choice([10, 20, 37])
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 10))]
        counts = {x: lengths.count(x) for x in lengths}
        fixed, rest = bestfit.reduce_dominated(counts, capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert used(fixed, capacity)[1] + optimum(left, capacity) == optimum(lengths, capacity)
        fixed_some += bool(fixed)
        solved, n = used(bestfit.solve(counts, capacity), capacity)
        assert solved == counts and n <= optimum(lengths, capacity) + 1
    assert fixed_some > 200


def test_large_counts_stay_small_work():
    r = random.Random(6)
    counts = {x: r.randrange(1, 10**9) for x in range(1, 4097)}
    patterns = bestfit.solve(counts, 4096)
    total, n = used(patterns, 4096)
    assert total == counts and len(patterns) < 4 * 4096
    assert n <= 1.02 * (sum(x * c for x, c in counts.items()) / 4096) + 1 or n <= sum(c for x, c in counts.items() if x > 2048) * 1.02


def check_packing(rows, got, tokenizer, end, capacity):
    e = encoder(tokenizer_path(tokenizer)).tokenizer
    want = []
    for d, text in rows:
        ids = e.encode(text or "", add_special_tokens=False).ids + [end]
        want += [(d, k, at, len(ids[at : at + capacity]), zlib.crc32(le_bytes(ids[at : at + capacity]))) for k, at in enumerate(range(0, len(ids), capacity))]
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted((tuple(x[:5]) for x in got), key=key) == sorted(want, key=key)
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_documents_are_packed_whole(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = bestfit.op3_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, got, "word_bpe_49k.json", 1, 4096)
    assert n <= 1.05 * sum(x.length for x in got) / 4096 + 1


def test_packing_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = bestfit.best_fit_pack(odd, tokenizer_path("word_bpe_49k.json"), 1, 64).collect()
    check_packing(rows, got, "word_bpe_49k.json", 1, 64)
    assert bestfit.best_fit_pack(none, tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def test_pretoken_counts_sum_to_the_librarys():
    path = tokenizer_path("piece_bpe_32k.model")
    assert tokencount.splits_safely(path)
    sp = tokencount.model(path)
    for text in strange(5):
        assert sum(tokencount.count_each(tokencount.pretokens(text), path)) == len(sp.encode(text)), text


def test_token_counts(spark, sf, odd, none):
    sp = tokencount.model(tokenizer_path("piece_bpe_32k.model"))
    for df in (documents(spark, sf), odd.repartition(3)):
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 4096) for r in df.collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in tokencount.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect())
        assert got == want
    assert tokencount.token_counts(none, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_packed_arrays_and_words():
    a, b = np.arange(5, dtype=np.uint32), np.array([2**32 - 1], np.uint32)
    assert all((x == y).all() for x, y in zip(tokencount.unpacked(tokencount.packed(a, b, a[:0])), (a, b, a[:0]), strict=True))
    words = ["", "é\x00", " a", "\n"]
    assert tokencount.unpack_words(tokencount.pack_words(words)) == words


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_plain_character_is_encoded_as_by_the_library(name):
    e = tokenizing.Encoder(tokenizer_path(name))
    r = random.Random(1)
    texts = [a + c + b for c in tokenizing.PLAIN for a, b in (("", ""), ("a", "b"), (" ", " "), ("1", "'s"))]
    texts += ["".join(r.choice(tokenizing.PLAIN) if r.random() < 0.5 else r.choice("abc  '\n\tLDs1²ª") for _ in range(r.randrange(40))) for _ in range(4000)]
    assert type(e.find.__self__).__module__ == "re"
    for text in texts:
        assert e.encode(text) == tokenizing.le_bytes(e.tokenizer.encode(text, add_special_tokens=False).ids), text
