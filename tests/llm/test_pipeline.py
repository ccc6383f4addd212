import hashlib
import os

import pytest
import sentencepiece

import corpus_pipeline as P
from lexirun.llm.common import shared_dir
from lexirun.llm.decontaminate import find_contamination
from lexirun.llm.queries import QUERIES, tokenizer_path
from lexirun.llm.toxicity import score


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_do_what_their_operators_decide(spark, sf_dir, docs, tmp_path):
    from test_jaccard_join import brute

    seen, before = [], docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, before, after))
        before = after
    assert [s[0] for s in seen] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    rows = [{r.doc_id: r.text for r in docs.collect()}] + [{r.doc_id: r.text for r in a.select("doc_id", "text").collect()} for _, _, a in seen[:4]]
    for _, _, after in seen[:4]:
        assert after.columns == docs.columns

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert set(rows[1]) == {r.doc_id for r in score(docs, labels).collect() if not r.toxic}
    best = {}
    for d, t in rows[1].items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        best[key] = max(d, best.get(key, -1))
    assert set(rows[2]) == set(best.values())
    assert set(rows[3]) == {c for _, _, c in brute(sorted(rows[2].items()))}
    held = {r.doc_id for r in find_contamination(seen[3][1], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert set(rows[4]) == set(rows[3]) - held
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    coded = seen[4][2].collect()
    assert sorted(r.doc_id for r in coded) == sorted(rows[4])
    for r in coded:
        assert list(r.ids) == library.encode(rows[4][r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(list(r.ids)).encode()).hexdigest()
    before = set(os.listdir(shared_dir(spark)))
    whole = {r.doc_id: r.ids_sha256 for r in P.run(spark, sf_dir).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in coded}
    assert len(set(os.listdir(shared_dir(spark))) - before) == 1  # what the last stage reads


def test_the_last_stage_keeps_offsets(spark, sf_dir, docs):
    """Every piece has the bytes of the text that it came from: those that the library says, and together the whole text."""
    odd = [(-1, None), (-2, ""), (-3, "  a  b "), (-4, "日本 \U0001f600 é\x00<unk>▁x"), (-5, "x é\n" * 20_000)]
    texts = spark.createDataFrame(odd, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text").limit(300)).collect()
    found = {r.doc_id: r for r in P.encoded(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), sf_dir).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    assert len(found) == len(texts) > len(odd)
    for d, text in texts:
        spans, data = list(zip(found[d].spans[::2], found[d].spans[1::2], strict=True)), (text or "").encode()
        pieces = library.encode(text or "", return_type="proto").pieces
        assert len(spans) == found[d].n_tokens == len(pieces) and b"".join(data[a:b] for a, b in spans) == data
        # bytes of one character have a span each; the library gives the last of them all of it
        assert [s for s, p in zip(spans, pieces, strict=True) if not p.piece.startswith("<0x")] == [(p.begin, p.end) for p in pieces if not p.piece.startswith("<0x")]


def test_stages_stand_odd_rows(spark, sf_dir):
    text = "one two three four five six seven"
    odd = [(1, None, None, None, None), (None, text, "en", "a", 1), (2, text, "en", "b", 2), (2, text, "en", "b", 2), (3, "", None, None, 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for data in (odd, []):
        df = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            df = stage(spark, df, sf_dir)
            rows = df.collect()
            assert bool(rows) == bool(data), name
            df = spark.createDataFrame(rows, df.schema)


def test_all_queries_are_registered():
    import __spark_entry__

    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{k}" for k in range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
