from collections import Counter

import corpus_pipeline
from graphloom.llm import queries, secret_scan, simhash_dedup
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.word_tokens import WordTokenizer

CLEAN = "the quick survey of plain words number {0} goes on about topic{0} and place{0} with detail{0} until every sentence{0} has enough different{0} words{0} to count{0} as prose{0} of its own{0} kind{0}"


def test_every_query_is_registered_once():
    import re

    names = [re.match(r"op(\d+)_", n) for n in queries.QUERIES]
    assert sorted(int(m[1]) for m in names) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_stages(spark, tmp_path):
    clean = [CLEAN.format(i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[0]), (102, clean[1].replace("survey", "surveys")), (103, "short"), (104, None), (105, "### " * 60), (106, clean[5] + " password=hunter2xyz"), (107, "same words again " * 40)]
    data = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    data.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == data.columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = seen["quality rules"]
    assert set(judged) == set(range(12)) | {100, 101, 102, 106}
    exact = seen["exact dedup"]
    assert set(exact) == set(judged) - {0, 100}
    prints = {i: simhash_dedup.fingerprint(t) for i, t in exact.items()}
    classes = {i: {i} for i in prints}
    for i in prints:
        for j in prints:
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and classes[i] is not classes[j]:
                classes[i] |= classes[j]
                for x in classes[j]:
                    classes[x] = classes[i]
    near = seen["SimHash near-dedup"]
    assert set(near) == {min(c) for c in classes.values()}
    masked = seen["secret scans"]
    assert masked == {i: secret_scan.redact(t) for i, t in near.items()}
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    tokenizer = WordTokenizer(tokenizer_path())
    assert Counter(r["doc_id"] for r in packed) == Counter(list(masked))
    assert {r["doc_id"]: r["length"] for r in packed} == {i: len(ids) + 1 for i, ids in zip(masked, tokenizer.encode_many(list(masked.values())))}


def test_contract_columns(spark):
    want = {
        "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
        "op2_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
        "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
        "op5_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
        "op6_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
        "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op8_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    }
    for name, columns in want.items():
        got = dict(queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
        for column in columns.split(", "):
            key, kind = column.split(" ")
            assert got[key] == kind, (name, key)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, length long, __row string, kept string, piece string"


def test_stages_with_odd_tables(spark, tmp_path):
    """Empty tables, very long texts, nulls in every column and columns that clash go through every stage."""
    long = " ".join(f"term{i} of{i * 7} a{i * 13}" for i in range(60_000))
    rows = [(1, long, "en", "s", len(long), 1, "r", "k", "p"), (2, None, None, None, None, None, None, None, None), (None, CLEAN.format(77), None, None, None, None, None, None, None), (3, CLEAN.format(3), "en", "s", 1, 1, "r", "k", "p")]
    for name, data in (("some", rows), ("none", [])):
        table = spark.createDataFrame(data, EXTRA)
        table.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"file://{tmp_path}/{name}")
            assert docs.columns == table.columns
        want = {1, None, 3} if data else set()
        assert {r["doc_id"] for r in docs.collect()} == want
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()} == want
