"""The pipeline, stage by stage and as a whole, against plain loops; the registered queries."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from brute import jaccard_components, live_spans, packed
from tokenizers import Tokenizer

from shardloom.llm import catalog

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def live_values(rows):
    """Values that look live, per text; sources own them, and a source's languages are its repositories."""
    of = lambda r: "/".join(c for c in (r[3], r[2]) if c is not None)
    return [{v for _, _, v in found} for found in live_spans(rows, lambda r: r[3], of)]


@pytest.fixture(scope="module")
def folder(spark, odd_rows, tmp_path_factory):
    """The documents of the next larger table, which has enough labels to learn from, and odd rows under other ids."""
    sf_dir = "/root/testdata/sf0.01"
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    odd = [(None if r[0] is None else r[0] + 10_000_000, *r[1:]) for r in odd_rows]
    docs.union(spark.createDataFrame(odd, docs.schema)).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = catalog.toxicity_model(spark, docs, folder)
    expected = [r for r in rows if model.score(r[1] or "") < 0.5]
    assert len(expected) < len(rows)
    stages = dict(corpus_pipeline.STAGES)
    got = stages["toxicity"](spark, docs, folder)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(expected)

    linked = jaccard_components(expected, 5, 80)
    kept = {r[0] for r in linked if r[0] == r[2]}
    # Of rows with one id and text the least of the other columns stays.
    least = {}
    for r in sorted((r for r in expected if r[0] in kept), key=lambda r: r[2:4]):
        least.setdefault(r[:2], r)
    second = list(least.values())
    assert len(second) < len(expected)
    frame = spark.createDataFrame(expected, docs.schema)
    got = stages["ngram_jaccard_join"](spark, frame, folder)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(second)

    third = []
    for r, live in zip(second, live_values(second)):
        text = r[1]
        for v in sorted(live, key=lambda v: (-len(v), v)):
            text = text.replace(v, "[secret]")
        third.append((r[0], text, *r[2:4], None if text is None else len(text)))
    assert sum("[secret]" in (r[1] or "") for r in third) > 0
    got = stages["secret_scan"](spark, spark.createDataFrame(second, docs.schema), folder)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == Counter(third)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in third)
    got = stages["packing"](spark, spark.createDataFrame(third, docs.schema), folder).collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in got if p.start == 0) == sizes
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sum(p.length for p in whole) == sum(n for (_, n), c in sizes.items() for _ in range(c))
    by_id = {r[0]: r[1] for r in third}
    for p in whole:
        if p.length == p.doc_tokens and p.doc_id is not None and p.doc_id != 10_000_015:
            ids = tokenizer.encode(by_id[p.doc_id] or "", add_special_tokens=False).ids
            assert zlib.crc32(packed([*ids, 2])) == p.ids_crc32


def test_clashing_columns_are_kept(spark, odd_rows):
    """Columns under the names that a stage uses itself, and none of those it can do without."""
    mine = "doc_id long, text string, kept_key string, key string, row string, copy string, stays string, digest string"
    rows = [(r[0], r[1], *[f"{c}{r[0]}" for c in "abcdef"]) for r in odd_rows]
    docs = spark.createDataFrame(rows, mine)
    got = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    kept = {r[0] for r in jaccard_components(odd_rows, 5, 80) if r[0] == r[2]}
    assert Counter(map(tuple, got.collect())) == Counter({r: 1 for r in rows if r[0] in kept})


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_contract():
    import __spark_entry__ as contract

    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if re.match(r"op\d+_", k)}
    assert names["pipeline"] is corpus_pipeline.run
    assert set(catalog.ORACLES) <= set(contract.oracle_sql())


CONTRACT = {
    "op1": ["query_id bigint", "rank int", "vec_id bigint", "score double"],
    "op2": ["doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint"],
    "op3": ["doc_id bigint", "n_bytes bigint", "n_tokens bigint", "over_limit boolean"],
    "op4": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
    "op5": ["doc_id bigint", "n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string", "spans string"],
    "op6": ["doc_id bigint", "n_shingles bigint", "component_id bigint"],
    "op7": ["doc_id bigint", "held_out boolean", "n_tokens bigint", "n_known bigint", "train_tokens bigint",
            "base_score double", "score double"],
    "op8": ["doc_id bigint", "n_chars bigint", "edited_sha256 string", "fingerprint string", "edited_fingerprint string",
            "near_edited double", "near_next double"],
    "op9": ["doc_id bigint", "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint",
            "sequence_id bigint", "offset bigint"],
    "op10": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op11": [f"{c} bigint" for c in "doc_id n_a n_b n_groups n_links n_best count_sum".split()] + ["groups_sha256 string"],
    "op12": ["part string", "filter_order string", "step int", *(f"{c} bigint" for c in (
        "kept removed redundant unique_fails good_lost toxic_lost shapley").split())],
    "op13": ["doc_id bigint", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string",
             "contaminated boolean"],
}


@pytest.mark.parametrize("op", CONTRACT)
def test_columns_of_queries(spark, sf_dir, op):
    name = next(n for n in catalog.QUERIES if n.split("_")[0] == op)
    found = catalog.QUERIES[name](spark, sf_dir)
    types = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields]
    assert [t for t in types if t.split()[0] in {c.split()[0] for c in CONTRACT[op]}] == CONTRACT[op]
    assert found.count() > 0
