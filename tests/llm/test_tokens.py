"""Codec, token files and packing against the libraries themselves."""

import hashlib
import json
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import packing, sentencepiece_codec, token_files, tokens
from tessella.llm.common import new_folder, written
from tessella.llm.queries import model_text, packed

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return sentencepiece_codec.PieceModel(f.read())


def raw(ids):
    return array("I", ids).tobytes()


def test_codec_equals_library(library, model):
    random.seed(5)
    alphabets = ["abcde ▁ \n\té日<>0xfn😀", "the in er on ▁an", "aaab  "]
    texts = ["".join(random.choice(a) for _ in range(random.randint(0, 70))) for a in alphabets for _ in range(700)]
    for text in [*texts, "", " ", "   ", "a" * 500, "<s></s><unk><0x0A>", " " * 90 + "x"]:
        ids = library.encode(text)
        assert model.encode(text) == raw(ids), text
        assert model.decode(raw(ids)) == library.decode(ids), text


def test_any_ids_decode_as_the_library_does(library, model):
    random.seed(6)
    odd = [*model.byte_set, 0, 1, 2]
    for _ in range(1500):
        ids = [random.choice(odd) if random.random() < 0.6 else random.randrange(3, 32000) for _ in range(8)]
        assert model.decode(raw(ids)) == library.decode(ids)


def test_failed_places_are_left_again(model):
    # longest pieces first do not fit here, so the walk has to go back
    for text in ("▁" + "ab" * 40, "▁xyzzyaaaa", "▁" + "eren" * 30):
        assert model.split(text) == model.merge(text)


def test_codec_on_messy_rows(spark, messy, empty, library):
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(messy, PIECES), PIECES)
    assert set(messy.columns) <= set(coded.columns)
    rows = coded.collect()
    assert len(rows) == messy.count()
    for r in rows:
        ids = [1, *library.encode(r["text"] or ""), 2]
        assert bytes(r["ids"]) == raw(ids)
        assert r["decoded"] == library.decode(ids)
    assert sentencepiece_codec.encode(empty, PIECES).count() == 0


@pytest.mark.parametrize("make, file", [(tokens.word_encoder, "word_bpe_49k.json"), (tokens.byte_encoder, "byte_bpe_50k.json")])
def test_part_encoder_equals_library(make, file, messy):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    random.seed(7)
    alphabet = ["a", "B", "word", "é", ",", ".", " ", "  ", "\n", " \n", " ", " ", "\x1c", "'s", "12", "日", "Σ", "!", "\t", "é", "\v", "“", "’s", "<|endoftext|>", "<|", "½"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 25))) for _ in range(1500)] + [r["text"] or "" for r in messy.collect()]
    encoder = make("test " + file, model_text(file))
    for i in range(0, len(texts), 100):
        part = texts[i:i + 100]
        assert encoder.encode(part) == [raw(tokenizer.encode(t, add_special_tokens=False).ids) for t in part]
    plain = ["a", "Word", "é", ",", " ", "  ", "\n", "\t", "'s", "'S", "12", "!", "“", "—", "x" * 700, " " * 40, "don't", "<|endoftext|>"]
    texts = ["".join(random.choice(plain) for _ in range(random.randint(0, 25))) for _ in range(1500)] + ["<|ENDOFTEXT|> <|startoftext|>x", " ", "\n \n"]
    assert encoder.encode(texts) == [raw(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_plain_texts_are_encoded_whole_and_their_words_not_remembered():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    random.seed(11)
    characters = [*map(chr, range(32, 0x250)), *"‘’“”–—…«»€", "\t", "\n", "\r"]
    plain = [c for c in characters if not tokens.NOT_PLAIN.search(c) and c != tokens.DOTTED_I]
    common = ["'", "'s", "'LL", "n't", "''", "_'s", "1's", " ", " ", "The", "of", "a"] * 20
    texts = [x for c in plain for x in (c, f"a{c}b", f"don{c}t_{c}{c}9{c}")]
    texts += ["".join(random.choice(plain + common) for _ in range(random.randint(0, 40))) for _ in range(5000)]
    encoder = tokens.word_encoder("plain texts", model_text("word_bpe_49k.json"))
    assert encoder.encode(texts) == [raw(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert not encoder.parts.kept["later"]
    odd = [f"a{tokens.DOTTED_I}b {tokens.DOTTED_I}", "e\u0301 \u00a0x", "日本 don't", "\0's"]
    assert encoder.encode(odd) == [raw(tokenizer.encode(t, add_special_tokens=False).ids) for t in odd]


def test_special_tokens_as_text():
    for kind, file in ((tokens.PartEncoder, "word_bpe_49k.json"), (tokens.ByteEncoder, "byte_bpe_50k.json")):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        tokenizer.encode_special_tokens = True
        more = (tokens.words_of, "", "", "</w>") if kind is tokens.PartEncoder else ()
        encoder = kind("as text " + file, model_text(file), *more, special_is_text=True)
        assert encoder.encode(["a <|endoftext|> b"]) == [raw(tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids)]


def test_merging_needs_ids_in_order():
    said = json.loads(model_text("byte_bpe_50k.json"))
    assert tokens._merger(json.dumps(said)) is not None
    said["model"]["merges"] = said["model"]["merges"][::-1]
    assert tokens._merger(json.dumps(said)) is None


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_documents_encode_as_the_library_does(spark, file):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder = (tokens.word_encoder if file[0] == "w" else tokens.byte_encoder)("documents " + file, model_text(file))
    assert encoder.encode(texts) == [raw(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    ids = rng.choice([0, 5, 255, 256, 40_000, 70_000, 2**32 - 1], 5000).astype(np.uint32)
    starts = np.array([0, 0, 10, 4096, 5000])
    segment = token_files.Segment(token_files.pack(ids, [3, None, 4, 5], starts))
    assert segment.docs == [3, None, 4, 5]
    assert [segment.id_at(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    for a, b in [(0, 0), (0, 5000), (511, 513), (1023, 4001), (4999, 5000)]:
        assert (segment.ids(a, b) == ids[a:b]).all()
    assert token_files.Segment(token_files.pack(ids[:0], [], np.array([0]))).n_ids == 0


def test_token_files_on_messy_rows(spark, messy, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = model_text("word_bpe_49k.json")

    def run(df):
        path = new_folder(spark, "test-files")
        token_files.write(df, path, lambda: tokens.word_encoder("test files", text), end_id=2, segment_ids=3000)
        return token_files.documents(spark.read.parquet(path), "ids string", lambda ids: [" ".join(map(str, ids.tolist()))])

    got = sorted(run(messy.repartition(4)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in got][:2] == [True, True]
    assert [r["doc_id"] for r in got[2:]] == sorted(i["doc_id"] for i in messy.collect() if i["doc_id"] is not None)
    at = 0
    for r in got:
        assert (r["start"], len(r["ids"].split())) == (at, r["n_tokens"])
        at += r["n_tokens"]
    expected = sorted(" ".join(map(str, [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in messy.collect())
    assert sorted(r["ids"] for r in got) == expected
    assert run(empty).count() == 0


def test_patterns_place_everything():
    random.seed(2)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(100, int(random.expovariate(0.05)) + 1)] += 1
    packs = packing.patterns(dict(histogram), 100)
    placed = defaultdict(int)
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 100
        for n in lengths:
            placed[n] += count
    assert placed == histogram
    used = sum(n * c for n, c in histogram.items())
    assert used / (100 * sum(c for c, _ in packs)) > 0.95
    assert packing.patterns({}, 100) == []


def test_packing_on_messy_rows(messy, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packed(messy, 64).collect()
    expected, got = defaultdict(int), defaultdict(int)
    for r in messy.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 64):
            piece = ids[start:start + 64]
            expected[r["doc_id"], start, len(piece), zlib.crc32(raw(piece)), len(ids)] += 1
    sequences = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packed(empty, 64).count() == 0


def test_pieces_keep_their_ids(messy):
    text = model_text("byte_bpe_50k.json")
    cut = written(packing.pieces(messy, lambda: tokens.byte_encoder("test pieces", text), 1, 64, with_ids=True), "test-pieces")
    for r in cut.collect():
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert "ids" in packing.assign(cut, 64).columns


def test_query_digests(spark, library):
    from tessella.catalog.base import Tables
    from tessella.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op1_sentencepiece"](Tables(spark, folder)).collect():
        ids = [1, *library.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(raw(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
