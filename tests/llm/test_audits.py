"""Token alignment, filter audit and benchmark index against plain loops and SQL."""

from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import benchmark_hits, filter_steps, token_groups, token_links
from oracle import connect, differences
from tokenizers import Tokenizer

from shardloom.llm import benchmark_index, catalog, filter_audit, token_alignment

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
GIVEN = ["documents", "odd"]
LABELS = "doc_id long, quality int, toxic int, text string, mask int"


def rows_of(request, name):
    return request.getfixturevalue(name), request.getfixturevalue("document_rows" if name == "documents" else "odd_rows")


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def tokens():
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    chars = token_alignment.byte_of_char()

    def both(text):
        text = text or ""
        left = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                 for i in b.encode(text)]
        return left, right
    return both


EDGES = ["▁", "a ▁ b", " ", "  ", "a  b", "a \n b\n", "\n a", "x\t \ty ", "<s> </s> <unk> <0x41> <|endoftext|>", "aé́ é", "\x00 \x1c \x85 x",
         "the the the", "ﬁ １２ x", "𝔘𝔫𝔦 日本語 テキスト", "z" * 3000, "don't I'LL we've 'S  's", " nbsp  x", "abab" * 900]


def test_pieces_align_like_whole_texts(tokens):
    pieces = token_alignment.Pieces(token_alignment.Vocabularies(BYTES, PIECES))
    assert pieces.words.cuts
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [0xFEFF, 0xFF21, 0x1D518, 0x1F600]
    texts = EDGES + [f"a{chr(c)}b {chr(c)}!1 {chr(c)} {chr(c)}{chr(c)} x" for c in points]
    import pyarrow as pa

    numbers, digests, regular, pairs = token_alignment.aligned(pieces, pa.array(texts))
    expected, _ = token_links([token_groups(t, *tokens(t)) for t in texts])
    for i, (text, wanted) in enumerate(zip(texts, expected)):
        assert tuple(int(n[i]) for n in numbers) == wanted[:4], repr(text[:40])
        assert (digests[i].hex() if wanted[0] else "") == wanted[6], repr(text[:40])


@pytest.mark.parametrize("given,group_pairs", [("documents", 5_000), ("odd", 1), ("odd", 1 << 30)])
def test_alignment(spark, request, tokens, given, group_pairs):
    frame, rows = rows_of(request, given)
    if given == "odd":
        edges = [(100 + i, t, "en", "src", len(t)) for i, t in enumerate(EDGES)]
        frame = frame.select("doc_id", "text").union(spark.createDataFrame([e[:2] for e in edges], "doc_id long, text string"))
        rows = rows + edges
    linked, counts = token_alignment.align(frame, BYTES, PIECES, group_pairs=group_pairs)
    expected, docs = token_links([token_groups(r[1], *tokens(r[1])) for r in rows])
    assert by_key(map(tuple, linked.collect())) == by_key((r[0], *e) for r, e in zip(rows, expected))
    assert {(r.a, r.b): r.docs for r in counts.collect()} == docs
    words = token_alignment.Vocabularies(BYTES, PIECES)
    assert any(words.identity[a] == b for a, b in docs) and any(words.identity[a] != b for a, b in docs)


def test_wide_groups_pair_distinct_ids(monkeypatch):
    a, b = np.array([1, 1, 2, 9]), np.array([5, 6, 5, 8])
    ends = dict(piece=np.array([0, 1]), a=a, b=b, first_a=np.array([0, 3]), first_b=np.array([0, 3]),
                size_a=np.array([3, 1]), size_b=np.array([3, 1]), links=np.array([9, 1]), chosen=np.array([0, 1]))
    narrow = token_alignment.Pieces.pairs(**ends)
    monkeypatch.setattr(token_alignment, "WIDE", 2)
    for x, y in zip(narrow, token_alignment.Pieces.pairs(**ends)):
        assert x.tolist() == y.tolist()


def test_memo_is_trimmed(monkeypatch):
    import pyarrow as pa

    words = token_alignment.Vocabularies(BYTES, PIECES)
    texts = pa.array([" ".join(f"w{i * j}x" for j in range(40)) for i in range(30)])
    whole = token_alignment.aligned(token_alignment.Pieces(words), texts)
    monkeypatch.setattr(token_alignment, "MEMO", 20)
    small = token_alignment.Pieces(words)
    for i in range(30):
        small.trim()
        part = token_alignment.aligned(small, texts[i:i + 1])
        assert part[1][0] == whole[1][i] and [int(n[0]) for n in part[0]] == [int(n[i]) for n in whole[0]]
        for got, all_of in zip(part[2:], whole[2:]):
            assert [x.tolist() for x in got[1:]] == [x[all_of[0] == i].tolist() for x in all_of[1:]]


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for at in filter_audit.adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_diagram_shares_equal_subtrees():
    diagram = filter_audit.Diagram({0: (4, 1, 0), 31: (2, 0, 1)}, 5)
    # Three leaves (two weights and nothing), and per level the path of either mask and at most one node of nothing.
    assert len(diagram.nodes) <= 3 + 3 * 5
    before = diagram.weight[diagram.root]
    for at in filter_audit.adjacent_swaps(5):
        diagram.swap(at)
        assert diagram.weight[diagram.root] == before


@pytest.mark.parametrize("given", GIVEN)
def test_filter_audit(spark, request, given):
    frame, rows = rows_of(request, given)
    labels = [(r[0], k % 2, k % 3 == 0, "x", 1) for k, r in enumerate(rows) if k % 4] + [
        (1, None, None, "x", 1), (None, 1, 1, "x", 1), (6, 1, 0, "x", 1), (6, 0, 1, "x", 1), (99_999, 1, 1, "x", 1)]
    labels = [(i, q, None if t is None else int(t), x, m) for i, q, t, x, m in labels]
    extra = [(900 + k, "same text % twice", lang, "s", 1) for k, lang in enumerate(["en", None, "", "fr", "fr"])] * 2
    frame = frame.select("doc_id", "text", "lang", "source", "n_chars").union(
        spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    counts = filter_audit.mask_counts(frame.withColumn("mask", frame.source).withColumn("n", frame.source),
                                      spark.createDataFrame(labels, LABELS))
    found = filter_audit.audit(counts).collect()
    assert by_key(map(tuple, found)) == by_key(filter_steps(rows + extra, [x[:3] for x in labels]))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir), catalog.ORACLES[name]) == []


@pytest.fixture(scope="module")
def items(spark, odd_rows):
    long = odd_rows[5][1].split()
    rows = [(1, " ".join(long[3:25])), (1, " ".join(long[100:112])), (2, "PLAIN words; and"), (3, None), (4, " .,- "), (5, "one"),
            (None, "a b c d"), (6, " ".join(long[20:40])), (7, "日本語 テキスト"), (8, "absent words here"), (8, "absent words here"),
            (9, "w1 w1"), (10, " ".join(long[50:60]))]
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "item_id long, text string, term string, words string, shard int"), rows


@pytest.mark.parametrize("given,shard_words", [("documents", 20_000), ("odd", 1), ("odd", 1 << 30)])
def test_benchmark_index(spark, request, sf_dir, items, given, shard_words):
    frame, rows = rows_of(request, given)
    asked, listed = items
    if given == "documents":
        asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        listed = [tuple(r) for r in asked.collect()]
    found = benchmark_index.decontaminate(frame, asked, shard_words=shard_words)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.spans) for r in found.collect()]
    expected = benchmark_hits(rows, listed)
    assert sum(e[2] > 0 for e in expected) > 2
    assert by_key(got) == by_key(expected)


def test_no_items(spark, odd, odd_rows, items):
    none = items[0].limit(0)
    found = benchmark_index.decontaminate(odd, none).collect()
    assert len(found) == len(odd_rows) and not any(r.n_hit or r.n_items or r.spans for r in found)


def test_proximity(spark):
    words = [f"t{i}" for i in range(10)]
    near = words[:4] + ["x"] + words[4:]  # the later words are one place off
    far = words[:4] + ["x"] * 3 + words[4:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "t0 rare"),
                                  (5, " ".join(words[:5])), (6, " ".join(words[5:]))], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_near) for r in benchmark_index.decontaminate(docs, asked, slop=2).collect()}
    assert found == {1: (10, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
    with pytest.raises(ValueError, match="slop"):
        benchmark_index.decontaminate(docs, asked, slop=8)


@pytest.mark.parametrize("run", ["alignment", "audit", "index"])
def test_empty_tables(spark, none, items, run):
    if run == "alignment":
        found = token_alignment.align(none, BYTES, PIECES)[0]
    elif run == "audit":
        found = filter_audit.audit(filter_audit.mask_counts(none, spark.createDataFrame([], LABELS)))
    else:
        found = benchmark_index.decontaminate(none, items[0])
    assert found.collect() == []
