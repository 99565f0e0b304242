"""Round trips: tokens, media, archives, ledgers, vectors, and the pipeline."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def test_encoder_equals_the_library_on_odd_texts():
    from panelspark.llm.bpe import Decoder, Encoder

    ours, theirs = Encoder(PATH), Tokenizer.from_file(PATH)
    decoder = Decoder(ours.names)
    rng = random.Random(1)
    pool = [*"abc ABC 123 ''''stdlmrve!?.,;\t\n\x1c\x85\xa0　ΣσςİıßẞéÉñ你好한글🎉‍̀ǅﬁ²½_|<>", "<|endoftext|>", "the", "ing", "'re", "é", "\r\n"]
    pieces = [w.replace("</w>", "") for w in ours.names[256:40000:7] if w.isascii()]
    for k in range(6000):
        text = "".join(rng.choices(pool if k % 2 else pieces, k=rng.randint(0, 12)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == " ".join(map(str, ids)), text
        assert decoder.decode(np.array(ids, np.int64)).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_token_columns(docs, rows, empty):
    from panelspark.llm.bpe import encode, round_trip_digests

    theirs = Tokenizer.from_file(PATH)
    for r in encode(docs, PATH).collect():
        assert r["token_ids"] == theirs.encode(r["text"] or "", add_special_tokens=False).ids
    assert round_trip_digests(docs, PATH).count() == len(rows)
    assert encode(empty, PATH).count() == 0


def test_jpeg_round_trip_and_decoder_generality():
    from panelspark.llm import media

    rng = np.random.default_rng(0)
    data = [b"", rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"\x80" * 1700, bytes(rng.choice([126, 127, 128, 129, 130], 8000).astype(np.uint8)), rng.choice(np.r_[np.full(30, 128), 0:256], 9000).astype(np.uint8).tobytes(), b"x" * (media.CHUNK + 5)]
    payloads = [media.payload_of(d) for d in data]
    files = media.write_files(payloads)
    assert [f for p in payloads for f in media.write_files([p])] == files  # a batch changes nothing
    for p, (back, pictures) in zip(payloads, media.read_back(files)):
        assert back == p.tobytes() and all(t.ndim == 3 and t.shape[2] == 3 and t.dtype == np.uint8 for t in pictures)
    with pytest.raises(ValueError):
        media.read_images([b"no image"])


def test_inverse_transform_is_a_cosine_transform():
    from panelspark.llm import media

    flat = np.zeros((1, 64))
    flat[0, 0] = 80
    assert np.allclose(flat @ media.inverse_matrix() / 8192, 10, atol=0.01)
    full = media.inverse_matrix() / 8192
    assert np.allclose(full @ full.T, np.eye(64), atol=2e-3)


def test_media_columns(docs, rows, empty):
    from panelspark.llm.media import media_digests, store, tensors

    got = media_digests(docs).toPandas()
    assert len(got) == len(rows) and (got["payload_bytes"] % 576 == 0).all() and (got["payload_bytes"] >= got["n_bytes"]).all()
    assert tensors(store(docs)).count() >= len(rows)
    assert media_digests(empty).count() == 0


def test_archives(spark):
    from panelspark.llm import warc

    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c d", None), (4, "http://d", ""), (5, "http://e", "é" * 5000), (None, "http://f", "<p>x</p>"), (6, "http://g", "only"), (6, "http://g", "only")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(0, 8, "response", None), (1, 8, "revisit", 2), (2, 8, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 10000, "response", None), (6, 4, "response", None), (6, 4, "response", None)]
    table = warc.archives(pages).collect()
    assert all(int.from_bytes(t["content"][:4], "little") == warc.SKIPPABLE for t in table)
    assert warc.round_trip(pages.limit(0)).count() == 0
    records = [warc.record(k, "u", b"body %d" % (k % 7), "D", None) for k in range(300)]
    assert list(warc.read_archive(warc.write_archive(records))) == records


def test_ledger_is_idempotent_and_additive(spark):
    from panelspark.llm.shared import shared_dir
    from panelspark.llm.token_rollup import Ledger

    schema = "doc_id long, source string, lang string, version string, op string, n_tokens long, old_tokens long"
    ledger = Ledger(spark, shared_dir(spark) + "/ledger-test")
    assert ledger.totals().count() == 0
    load = spark.createDataFrame([(1, "a", "en", "v1", "insert", 10, None), (2, "a", "en", "v1", "insert", 5, None), (3, None, None, "v1", "insert", None, None)], schema)
    change = spark.createDataFrame([(1, "a", "en", "v1", "delete", 10, None), (2, "a", "en", "v1", "revise", 9, 5)], schema)
    assert ledger.commit("load", load) and ledger.commit("change", change) and not ledger.commit("change", change)
    want = {("a", "en", 1, 9), (None, None, 1, 0)}
    say = lambda: {(r["source"], r["lang"], r["documents"], r["tokens"]) for r in ledger.totals().collect()}
    assert say() == want
    ledger.compact("base")
    assert say() == want
    with pytest.raises(Exception, match="unknown change"):
        ledger.commit("bad", spark.createDataFrame([(1, "a", "en", "v1", "move", 1, None)], schema))
    assert say() == want


def test_vector_links_match_brute_force(spark):
    from panelspark.llm.vector_graph import link

    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[0] + rng.normal(0, 0.12, (120, 16)), base[1] + rng.normal(0, 0.2, (40, 16)), base[:3], 2 * base[3:4]])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, [1.0], 1), (None, base[0].tolist(), 1)]
    got = {r["vec_id"]: r for r in link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=60, per_centroid=50).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = np.array([got[k]["n_links"] for k in range(len(x))])
    assert links.sum() >= 0.95 * near.sum() and (links <= near.sum(1)).all()
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in (900, 901, 902, 903, 904)) and got[None]["component_id"] is None
    assert link(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_languages_are_told_apart(spark, docs, rows, empty):
    from panelspark.llm.language_id import fit, identify, predicted

    texts = {"de": "der die und nicht ist das von mit sich auf", "en": "the of and to in is that it was for", "es": "que el la los de en un por con una"}
    rng = np.random.default_rng(1)
    sample = [(k, " ".join(rng.choice(texts[lang].split(), 40)), lang) for k, lang in enumerate(list(texts) * 60)]
    df = spark.createDataFrame(sample, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(df).collect()}
    assert np.mean([got[k]["lang_pred"] == lang for k, _, lang in sample if got[k]["held_out"]]) > 0.95
    assert len({r["lang_pred"] for r in predicted(df.limit(0), fit(df)).collect()}) == 0
    told = identify(docs).collect()
    assert len(told) == len(rows) and all(0 <= r["score"] <= 1 for r in told)
    assert {r["lang_pred"] for r in told if r["doc_id"] in (150, 151, 152, 157)} == {"und"}
    assert identify(empty).count() == 0


def test_rollup_query_matches_brute_force(spark, tmp_path):
    import base64
    from collections import Counter

    import public_tokenizers
    import tiktoken

    from panelspark.llm.queries import op9_token_rollup

    docs = [(0, "one two", "s0", "en"), (1, "three, four five", "s0", "en"), (2, None, None, None), (3, "", "s1", "fr"), (4, "six" * 5000, "s1", "fr"), (5, "seven eight", "s1", "fr"), (5, "seven eight", "s1", "fr"), (None, "nine", "s1", None)]
    labels = [(0, 1, 0), (1, 0, 1), (4, 1, None), (5, 1, 1), (6, 1, 0), (None, 1, 1)]
    spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, lang string, version int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, toxic, good = {}, {1, 5}, {0, 4}
    for v in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{v}.tiktoken"), "rb"))}
        e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for i, text, source, lang in docs:
            if i not in toxic:
                c = want.setdefault((source, lang, v), Counter())
                c["documents"] += 1
                c["tokens"] += len(e.encode_ordinary(text or "")) + (i in good)
    got = {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in op9_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {k: (c["documents"], c["tokens"]) for k, c in want.items()}


def test_encoder_refuses_files_that_it_does_not_know(tmp_path):
    import json

    import public_tokenizers
    from panelspark.llm.bpe import Encoder

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    faults = [("normalizer", None), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}), ("pre_tokenizer", {"type": "ByteLevel"}), ("model", spec["model"] | {"byte_fallback": True})]
    for key, value in faults:
        (tmp_path / "t.json").write_text(json.dumps(spec | {key: value}), encoding="utf-8")
        with pytest.raises(ValueError, match="known"):
            Encoder(str(tmp_path / "t.json"))
