"""Token counts, token ids and packing, against the tokenizers library's own encoding of whole texts."""

import random
import zlib

import numpy as np
import pytest

from facet.llm import queries
from facet.llm.common import table
from facet.llm.op1_token_counts import CountedText, counted, number_edits, op1_token_counts
from facet.llm.id_coder import decode_block, encode_block
from facet.llm.op5_token_ids import blocks_of, decode_segment, encode_segment, op5_token_ids
from facet.llm.op6_packing import op6_packing, plan
from facet.llm.tokens import CachedEncoder, ColumnEncoder

from .conftest import rows

SF = "/root/testdata/sf0.001"
WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")


def whole(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("path, drops", [(WORD, True), (BYTE, False)])
def test_cached_encoding_equals_the_librarys(path, drops):
    r, one = random.Random(2), whole(path)
    enc = CachedEncoder(path, drops, cache_entries=500)
    texts = odd_texts(r, 3000)
    assert list(enc.encode(texts, batch_chars=1000)) == [raw(one(t)) for t in texts]


def odd_texts(r, n):
    """White space of all kinds, combining marks, letters whose case is special, contractions, and special tokens' strings, as they are and in other letters."""
    signs = [chr(c) for c in [9, 10, 11, 12, 13, 28, 29, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x301, 0x307, 0x345, 0x130, 0x3A3, 0x212A, 39, 0x1F600, 0xDF]]
    signs += [*"abI1's,.;!  \n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", "text|>", "word, ", "it's. ", "a" * 50]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_column_encoding_equals_the_librarys():
    import pyarrow as pa

    r, one, enc = random.Random(7), whole(WORD), ColumnEncoder(WORD, most=300)
    assert one("a <|endoftext|> b")[1] == 49_407
    for k in range(20):
        texts = [None, "", *odd_texts(r, 150)] if k else [None, ""]
        ids, lengths = enc.encode(pa.array(["gone, ", *texts], pa.string()).slice(1))
        assert ids.tolist() == [i for t in texts for i in one(t or "")] and lengths.tolist() == [len(one(t or "")) for t in texts]
    assert len(enc.encode(pa.array([], pa.string()))[0]) == 0


def test_column_encoding_with_spaces_equals_the_librarys(spark):
    import pyarrow as pa

    from facet.llm.op6_packing import pieces
    from facet.llm.tokens import SpacedColumnEncoder

    r = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "\u2003", "\u3000", "\u2028", "\u205f", "\u1680", "\x0b", "\x1c", "a", "word", "The", "don't", "'s", "é", "ª", "×", "½", "23", ".", ",", "...", "!!!", "#", "<|endoftext|>", "<|endo", "漢字", "\U0001f600", "İ", "\0", "\u200b", "\u0300"]
    texts = [None, "", *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000))]
    library = whole(BYTE)
    want = [library(t) for t in texts]
    enc = SpacedColumnEncoder(BYTE, 500)  # words are dropped and learnt again
    for first, size in ((0, 4002), (3, 100)):
        for k in range(first, len(texts), size):
            ids, n = enc.encode(pa.array(texts, pa.string()).slice(k, size), 0)
            assert ids.tolist() == [i for w in want[k : k + size] for i in [*w, 0]] and n.tolist() == [len(w) + 1 for w in want[k : k + size]]
    # a worker meets each different word once, however often it stands in a text
    asked = []
    enc._new, new = lambda words: (asked.extend(words), new(words))[1], enc._new
    enc.encode(pa.array([" qqjx" * 50, "qqjx qqjx, qqjx!!! qqjx"], pa.string()))
    assert sorted(w for w in asked if "qqjx" in w) == [" qqjx", "qqjx"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:300])], "doc_id long, text string")
    got = rows(pieces(docs, BYTE, 0, 5), "doc_id", "piece", "start", "length", "ids_crc32")
    for i, _, a, n, crc in got:
        assert zlib.crc32(raw([*want[i], 0][a : a + n])) == crc
    assert sum(x[3] for x in got) == sum(len(w) + 1 for w in want[:300])


def test_edits_count_as_if_encoded_anew():
    r, one, enc = random.Random(3), whole(BYTE), CachedEncoder(BYTE, False)
    signs = [*"ab1 \n\t.,'é\xa0　", "<|endoftext|>"]
    for _ in range(60):
        t = "".join(r.choice(signs) for _ in range(r.choice([0, 1, 5, 50, 3000])))
        c = CountedText(t, enc)
        for _ in range(8):
            a = r.randint(0, len(c.text))
            b = min(len(c.text), a + r.choice([0, 0, 1, 3, 40, 2500]))
            put = "".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 10, 600])))
            want = c.text[:a] + put + c.text[b:]
            c.edit(a, b, put)
            assert c.crc32() == zlib.crc32(want.encode())
            assert c.text == want and c.count == len(one(want)) and c.tree.characters == len(want)


def test_an_edit_encodes_its_neighbourhood_alone():
    enc = CachedEncoder(BYTE, False)
    c = CountedText("some words and more " * 5000, enc)
    before = c.encoded
    c.edit(50_000, 50_003, "new")
    assert c.encoded - before < 100


def test_many_edits_take_linear_time():
    """4000 edits of a text of a million characters: neither the text is copied nor the tree built anew each time."""
    import time

    enc, built = CachedEncoder(BYTE, False), []
    c = CountedText("some words and more " * 50_000, enc)
    rebuild = type(c.tree)._rebuild
    c.tree._rebuild = lambda: (built.append(1), rebuild(c.tree))
    began = time.perf_counter()
    for k in range(4000):
        c.edit(200 * k, 200 * k + 8, "other")
    assert time.perf_counter() - began < 8 and len(built) < 100


def test_token_counts_over_documents(spark, edge, empty):
    one = whole(BYTE)
    import re

    for docs in (edge, table(spark, SF, "documents")):
        texts = sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in docs.collect()))
        got = sorted(rows(op1_token_counts(spark, docs, BYTE), "doc_id", "n_tokens", "n_edits", "n_tokens_after", "crc32_after"), key=lambda g: (g[0] is None, g[0] or 0, g[1:]))
        want = []
        for _, i, t in texts:
            new = re.sub("[0-9]{4,}", "<num>", t)
            want.append((i, len(one(t)), len(re.findall("[0-9]{4,}", t)), len(one(new)), zlib.crc32(new.encode())))
        assert got == sorted(want, key=lambda g: (g[0] is None, g[0] or 0, g[1:]))
    assert op1_token_counts(spark, empty, BYTE).count() == 0


def test_edits_of_a_caller(spark):
    docs = spark.createDataFrame([(1, "abc def", [(0, 1, "X"), (4, 7, None)]), (2, "abc", None)], "doc_id long, text string, edits array<struct<start:int,end:int,put:string>>")
    assert sorted(rows(counted(docs, BYTE), "doc_id", "n_edits", "crc32_after")) == [(1, 2, zlib.crc32(b"Xbc ")), (2, 0, zlib.crc32(b"abc"))]
    assert number_edits("12345 é 6789")[1] == {"start": 8, "end": 12, "put": "<num>"}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4095, 4096, 4097, 20_000])
def test_segments_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.zipf(1.3, n) % 49_408, np.zeros(n), r.integers(0, 49_408, n), np.arange(n) % 3, np.full(n, 300_000)):
        ids = ids.astype(np.uint32)
        lengths = np.array([n // 2, 0, n - n // 2])
        for block in (512, 1 << 20):
            data = encode_segment(ids, np.array([-1, 0, 2**60 + 1]), lengths, np.array([False, True, False]), block)
            got, names, sizes, nulls = decode_segment(data)
            assert (got == ids).all() and names.tolist() == [-1, 0, 2**60 + 1] and sizes.tolist() == lengths.tolist() and nulls.tolist() == [False, True, False]


def test_damage_is_noticed():
    data = encode_segment(np.arange(5000, dtype=np.uint32) % 100, np.array([1]), np.array([5000]))
    for at in (-3, 10, 30):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            decode_segment(bytes(bad))


def document_ids(sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet").column("text").combine_chunks()
    return ColumnEncoder(WORD).encode(texts)[0]


def entropy(ids):
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    return float(-(p * np.log2(p)).sum())


def test_predictions_save_bits_of_documents():
    """Real documents, nothing tiled: the contexts must save bits that the frequencies of ids don't."""
    ids = document_ids("sf0.01")
    bits, order0 = 8 * len(encode_segment(ids, np.array([1]), np.array([len(ids)]))) / len(ids), entropy(ids)
    print(f"sf0.01 documents: {bits:.3f} bits an id, {order0:.3f} bits of order-0 entropy")
    assert bits < order0 - 0.8


def test_a_block_is_decoded_alone():
    ids = document_ids("sf0.001")
    blocks = blocks_of(encode_segment(ids, np.array([1]), np.array([len(ids)]), block=10_000))[0]
    assert len(blocks) > 5
    for k in (3, 0, len(blocks) - 1):
        assert (decode_block(bytes(blocks[k])) == ids[10_000 * k : 10_000 * (k + 1)]).all()
        assert encode_block(ids[10_000 * k : 10_000 * (k + 1)]) == bytes(blocks[k])


def test_token_ids_over_documents(spark, edge, empty):
    one = whole(WORD)
    for docs in (edge, table(spark, SF, "documents")):
        hashed = docs.selectExpr("doc_id", "text", "xxhash64(text) h")
        held = [r[:2] for r in sorted(rows(hashed, "doc_id", "text", "h"), key=lambda d: (d[0] is not None, d[0], d[2]))]
        start, want = 0, []
        for i, t in held:
            ids = [*one(t), 1]
            want.append((i, start, len(ids), zlib.crc32(raw(ids))))
            start += len(ids)
        assert sorted(rows(op5_token_ids(spark, docs, WORD), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1]) == want
    assert op5_token_ids(spark, empty, WORD).count() == 0


def test_ranges_of_doc_ids(spark):
    """Few and many bounds, one doc_id or null for most rows: partitions ascend, and a hot doc_id is split."""
    from facet.llm.op5_token_ids import _by_ranges

    for n, ids in ((1, range(9)), (7, range(5000)), (40, [*range(300), None]), (4, [5] * 3000 + [*range(20)]), (4, [None] * 3000 + [*range(20)])):
        docs = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string")
        parts = _by_ranges(docs, n).selectExpr("doc_id", "spark_partition_id() p").collect()
        assert len(parts) == len(ids) and max(r["p"] for r in parts) < n
        key = lambda i: (i is not None, i or 0)
        ends = [(min(x, key=key), max(x, key=key)) for p in range(n) if (x := [r["doc_id"] for r in parts if r["p"] == p])]
        assert all(key(a[1]) <= key(b[0]) for a, b in zip(ends, ends[1:]))
        if n > 1:
            assert max(sum(r["p"] == p for r in parts) for p in range(n)) < 0.7 * len(parts)


def packed(got, room=2048):
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= room
    return len(at)


def test_packing_over_documents(spark, edge, empty):
    one = whole(BYTE)
    for docs in (edge, table(spark, SF, "documents")):
        want = []
        for i, t in rows(docs, "doc_id", "text"):
            ids = [*one(t), 0]
            first, a, k = len(ids) % 2048 or 2048, 0, 0
            while a < len(ids):
                b = a + (2048 if k else first)
                want.append((i, k, a, b - a, zlib.crc32(raw(ids[a:b]))))
                a, k = b, k + 1
        got = op6_packing(spark, docs, BYTE).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=key) == sorted(want, key=key)
        n = packed(got)
        assert n <= 1.05 * sum(w[3] for w in want) / 2048 + 2
    assert op6_packing(spark, empty, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    r = np.random.default_rng(seed)
    n, room = int(r.choice([1, 10, 300, 5000])), int(r.choice([64, 2048]))
    counts = {}
    for x in np.minimum(room, r.lognormal(5, 1.5, n).astype(int) + 1):
        counts[int(x)] = counts.get(int(x), 0) + 1
    got, total = {}, 0
    for t, take in plan(counts, room):
        assert sum(take) <= room
        total += t
        for x in take:
            got[x] = got.get(x, 0) + t
    assert got == counts
    assert total <= 1.2 * -(-sum(k * v for k, v in counts.items()) // room) + 2


BIG = [(2**60 + 1, "one 12345"), (2**60 + 2, "two words"), (None, "no name"), (2**53 + 1, None)]


@pytest.mark.parametrize("operator", [lambda s, d: op1_token_counts(s, d, BYTE), lambda s, d: op5_token_ids(s, d, WORD), lambda s, d: op6_packing(s, d, BYTE)])
def test_large_doc_ids_beside_a_null_keep_their_digits(spark, operator):
    docs = spark.createDataFrame(BIG, "doc_id long, text string").coalesce(1)
    assert sorted((r[0] for r in rows(operator(spark, docs), "doc_id")), key=lambda i: i or 0) == [None, 2**53 + 1, 2**60 + 1, 2**60 + 2]
