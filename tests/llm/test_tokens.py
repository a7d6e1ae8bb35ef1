"""Token files, counts, encoding and packing against the libraries on whole texts."""

import base64
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from brute import digest, packed, token_stream
from tokenizers import Tokenizer

from shardloom.llm import byte_bpe, chunk_encoder, jaccard_join, packing, token_counts, token_files, toxicity
from shardloom.llm.chunk_encoder import ChunkEncoder, cut_rule
from shardloom.llm.common import staged
from shardloom.session import fresh_dir

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES, RANKS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
GIVEN = ["documents", "odd"]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def own_tiktoken():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(request, name):
    return request.getfixturevalue(name), request.getfixturevalue("document_rows" if name == "documents" else "odd_rows")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_join_to_whole_texts(path, odd_rows):
    """Around every kind of character, cut texts give the library's ids."""
    encoder, whole = ChunkEncoder(path), library(path)
    assert cut_rule(path) in ("byte", "word")
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [0xFEFF, 0xFF21, 0x1D518, 0x1F600]
    texts = [f"a{chr(c)}b {chr(c)}!1 {chr(c)} {chr(c)}{chr(c)} x" for c in points] + [r[1] or "" for r in odd_rows]
    for text in texts:
        assert encoder.encode(text) == packed(whole(text)), repr(text[:50])


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_memo_is_trimmed(path, monkeypatch, odd_rows):
    texts = [r[1] or "" for r in odd_rows]
    whole, encoder = library(path), ChunkEncoder(path)
    monkeypatch.setattr(chunk_encoder, "MEMO", 10)
    monkeypatch.setattr(chunk_encoder, "MEMO_CHARS", 5_000)
    for _ in range(2):
        for text in texts:
            data, sizes = encoder.encode_array(pa.array([text, "", text]), 2)
            ids = [*whole(text), 2]
            assert data.to_pylist() == [packed(ids), packed([2]), packed(ids)] and sizes.tolist() == [len(ids), 1, len(ids)]
    assert encoder.n < 20_000


def test_a_worker_holds_little(monkeypatch):
    """The library gets few pieces at once, pieces that came again outlast those that came once."""
    encoder, asked = ChunkEncoder(WORDS), []
    asks = encoder.library
    monkeypatch.setattr(encoder, "library", lambda pieces: asked.append(len(pieces)) or asks(pieces))
    words = [f"q{i}" for i in range(10_000)]
    encoder.encode(" ".join(words))
    assert sum(asked) == 10_000 and max(asked) <= 4096
    often = words[-100:]
    encoder.encode(" ".join(often))
    monkeypatch.setattr(chunk_encoder, "MEMO", 9_000)
    asked.clear()
    assert encoder.encode(" ".join(often)) == packed(library(WORDS)(" ".join(often)))
    assert not asked and encoder.n == 100


def test_encoder_goes_before_other_operators():
    """A worker that the join or the toxicity score begins in has no tokenizer and no memo of pieces left."""
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"], "toxic": [0]})
    for run in (jaccard_join._describe(5), jaccard_join._sets(5), toxicity._count):
        kept = weakref.ref(ChunkEncoder.of_worker(WORDS))
        assert kept() is not None
        list(run(iter([rows])))
        assert kept() is None


def test_batches_of_staged_tables_are_small(spark):
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 5000) text")
    sizes = staged(rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long"),
                   "sizes")
    found = [r.n for r in sizes.collect()]
    assert sum(found) > 20_000_000 and max(found) < 4_000_000


def test_parts_are_read_by_a_task_each(spark, documents):
    path = fresh_dir(spark, "token-files")
    token_files.write_token_files(documents, path, BYTES, file_bytes=10_000)
    parts = spark.read.parquet(f"{path}/manifest").count()
    assert parts > 16 and token_files.read_token_files(spark, path).rdd.getNumPartitions() == parts


@pytest.mark.parametrize("given", GIVEN)
def test_token_files(spark, request, given):
    frame, rows = rows_of(request, given)
    path = fresh_dir(spark, "token-files")
    token_files.write_token_files(frame, path, BYTES, file_bytes=40_000)
    found = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert found == token_stream(rows, library(BYTES))
    manifest = spark.read.parquet(f"{path}/manifest")
    assert manifest.count() > 1
    ids, offsets, keys, nulls = token_files.open_part(path, manifest.first().part)
    assert ids.dtype == np.uint16 and offsets[-1] == len(ids) and isinstance(ids, np.memmap)


def test_token_files_reject_damage(spark, odd):
    path = fresh_dir(spark, "token-files")
    token_files.write_token_files(odd, path, BYTES)
    plain = path.removeprefix("file:")
    with open(f"{plain}/part-000000.bin", "ab") as file:
        file.write(b"\0\0")
    with pytest.raises(Exception, match="do not agree"):
        token_files.read_token_files(spark, path).collect()


@pytest.mark.parametrize("given", GIVEN)
@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 256), (300, 8)])
def test_token_counts(request, given, chunk, overlap):
    frame, rows = rows_of(request, given)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), len(model.encode(r[1] or "")))
                      for r in rows)
    found = token_counts.count_tokens(frame, PIECES, chunk=chunk, overlap=overlap).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in found) == expected


def test_counts_need_wider_overlaps(spark):
    """Texts without a stable place in the first overlap, among them one without any."""
    text = ["ab" * 900, "x" * 3000 + " y" * 500, "é" * 1000 + " " * 800 + "end"]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    frame = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    texts = frame.selectExpr("sha2(text, 256) text_key", "text")
    assert token_counts.splice(texts, PIECES, 200, 16).filter("n_tokens is null").count() > 0
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, PIECES, chunk=200, overlap=16).collect()}
    assert found == {i: len(model.encode(t)) for i, t in enumerate(text)}


@pytest.mark.parametrize("given", GIVEN)
def test_byte_bpe(request, given):
    frame, rows = rows_of(request, given)
    whole = own_tiktoken()
    expected = []
    for r in rows:
        ids = whole.encode_ordinary(r[1] or "")
        expected.append((r[0] is not None, r[0] or 0, len(ids), digest(packed(ids)), digest((r[1] or "").encode())))
    found = byte_bpe.encode_decode(frame, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in map(tuple, found)) == sorted(expected)


def test_perfect_hash():
    keys = [b"key%d" % i for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert table.lookup(keys).tolist() == list(range(5000))
    assert len(table.owner) == 5000 and sorted(table.owner) == list(range(5000))
    assert all(0 <= k < 5000 for k in table.lookup([b"stranger%d" % i for i in range(100)]))


def test_heap_merges_like_the_library():
    bpe, whole = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), own_tiktoken()
    generator = np.random.default_rng(1)
    for alphabet in ("ab", "aethinos", "abcdefghijklmnopqrstuvwxyzéñ"):
        for n in (1, 2, 3, 7, 40, 3000):
            text = "".join(generator.choice(list(alphabet), n))
            if text.encode() not in bpe.ranks:
                assert bpe.merge(text.encode()) == whole.encode_ordinary(text)


@pytest.mark.parametrize("given", GIVEN)
@pytest.mark.parametrize("window", [4096, 100])
def test_packing(request, given, window):
    frame, rows = rows_of(request, given)
    whole = library(WORDS)
    pieces = packing.pack(packing.token_stream(frame, WORDS), window, keep_ids=True).collect()
    filled = defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
    total = 0
    for s, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        total += at
        assert at == window or s == max(filled)
    assert sorted(filled) == list(range(-(-total // window)))
    by_doc = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        by_doc[p.doc_id].append(p)
    expected = defaultdict(list)
    for r in rows:
        expected[r[0]].append(packed([*whole(r[1] or ""), 2]))
    for doc_id, texts in expected.items():
        # Documents that share an id come one after another only by chance; their pieces restart at 0.
        joined = []
        for p in by_doc[doc_id]:
            if p.start == 0:
                joined.append(b"")
            assert len(joined[-1]) == 4 * p.start
            joined[-1] += bytes(p.ids)
        assert sorted(joined) == sorted(texts)
        assert sorted(p.doc_tokens for p in by_doc[doc_id] if p.start == 0) == sorted(len(t) // 4 for t in texts)


def test_empty_tables(spark, none):
    path = fresh_dir(spark, "token-files")
    token_files.write_token_files(none, path, BYTES)
    assert token_files.read_token_files(spark, path).count() == 0
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert byte_bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(packing.token_stream(none, WORDS)).count() == 0
