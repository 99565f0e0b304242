"""The pipeline's stages, each on its own input."""

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_lines long, n_removed long, copy_id long, c0 string, component_id long"


def clashing(spark):
    """Nulls, empty texts, ties, repeats and a long text, with columns named like what the operators add."""
    a, b = "the rain fell on the old town and nobody spoke", "a second line of many words that stands for itself"
    texts = [(0, a), (1, a + "\n" + b), (2, a), (2, a), (3, None), (4, ""), (None, b), (None, None), (5, "... 123 !"), (6, " ".join(f"word{k}" for k in range(9000))), (7, b.upper())]
    more = (1.5, "x", 7, 8, 9, "y", 10)
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "s" if k % 3 else None, None if t is None else len(t), *more) for k, (i, t) in enumerate(texts)], CLASHING)


def test_stages_take_clashing_columns_nulls_repeats_and_empty_tables(spark):
    import corpus_pipeline as p

    docs = clashing(spark)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all((r["score"], r["lang_pred"], r["n_lines"], r["n_removed"], r["copy_id"], r["c0"], r["component_id"]) == (1.5, "x", 7, 8, 9, "y", 10) for r in rows), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert p.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
    one = Counter(r["doc_id"] for r in p.STAGES[2][1](spark, docs, "").collect())
    assert one == Counter({0: 1, 1: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1})


def test_last_stages_match_a_plain_restatement(spark):
    import corpus_pipeline as p
    from panelspark.llm.mixing import mix_sizes

    docs = clashing(spark)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    mixed = p.STAGES[3][1](spark, docs, "").collect()
    want = Counter()
    for r in mix_sizes(docs).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixed:
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert +got == +want
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokenizer.no_truncation(), tokenizer.no_padding()
    texts = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in p.STAGES[4][1](spark, docs, "").collect()) == texts


def test_stages_keep_clean_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    kept = p.STAGES[0][1](spark, docs, "")
    assert kept.columns == docs.columns and kept.count() >= 0.98 * n
    lines = p.STAGES[1][1](spark, docs, "")
    assert lines.columns == docs.columns and lines.count() >= 0.9 * n
    one = p.STAGES[2][1](spark, docs, "")
    assert one.columns == docs.columns and one.select("doc_id").distinct().count() == one.count() < n


def test_run(spark):
    import corpus_pipeline as p

    out = p.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "token_ids", "n_tokens"} <= set(out.columns) and out.count() > 100


def test_line_dedup_leaves_no_stump_of_a_copy(spark):
    import corpus_pipeline as p

    text = "Haanth.\n\none two three four five six seven eight\nIt is so.\nnine ten eleven twelve thirteen fourteen"
    rows = [(0, text), (1, text), (2, text.upper() + "\n"), (3, "It is so.\nbut these are words that no other document holds")]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in p.STAGES[1][1](spark, docs, "").collect()}
    rest = rows[3][1].split("\n")[1]
    assert got == {0: (text, len(text)), 3: (rest, len(rest))}
