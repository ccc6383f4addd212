import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer, models, pre_tokenizers

from lexirun.llm.pieces import SPACE, CharacterMap, Encoder, Rules, encode_documents, normalise
from lexirun.llm.queries import op8_offset_preserving, op9_count_only_viterbi, tokenizer_path
from lexirun.llm.token_counts import Counter, count_tokens, unigram_vocabulary

MODEL = tokenizer_path()
ODD = ["", "a", " a", "a  b", "\n", "▁x", "é\x00b", "😀 ok", "<s> hi", "a▁b", "   ", "  a   b ", "<unk>", "x<unk>y", "日<unk>", "<0x41>😀😀", " <unk> ", "a　b", "x" * 3000, "é ﬁ Ⅳ"]


def texts(seed=1, n=1500):
    rng = random.Random(seed)
    parts = ["a", "th", "e", " ", "  ", "▁", "é", "😀", "\n", "<unk>", "<", "日本", "퟿", "zq", "ﬁ", "Ａ", " ", "\t", "é"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_spans():
    e, library = Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in texts():
        ids, spans = e.encode(text)
        assert ids == library.encode(text) == e.encode(text, False)[0] and e.decode(ids) == library.decode(ids)
        spans, data = spans.tolist(), text.encode()
        proto = library.encode(text, return_type="proto").pieces
        # bytes of one character have a span each here; the library gives the last of them all of it
        assert [s for s, p in zip(spans, proto, strict=True) if not p.piece.startswith("<0x")] == [[p.begin, p.end] for p in proto if not p.piece.startswith("<0x")]
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)))
        assert b"".join(data[a:b] for a, b in spans) == data


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalising_by_character_map(rule, prefix, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    spec = proto.normalizer_spec
    rules = Rules(CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    for text in texts(2, 600):
        data, source = normalise(text, rules)
        assert data.decode() == library.normalize(text)
        assert len(source) == len(data) + 1 and (source[1:] >= source[:-1]).all() and source[-1] <= len(text.encode())


@pytest.mark.parametrize("rule, prefix, squeeze, symbols", [("nmt_nfkc", True, True, ()), ("nmt_nfkc_cf", False, True, ()), ("nfkc", True, False, ("ﬁx", "ａb", "ｃ")), ("identity", True, True, ("e  f",))])
def test_models_with_a_character_map(spark, tmp_path, rule, prefix, squeeze, symbols):
    """The public pieces with other rules: ids, text and spans of whole tables, all by way of our normalisation."""
    own, model = pb.ModelProto(), pb.ModelProto()
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze).serialized_model_proto())
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.CopyFrom(own.normalizer_spec)
    for k, symbol in enumerate(symbols):
        piece = model.pieces[-1 - k]
        piece.piece, piece.type = symbol, pb.ModelProto.SentencePiece.USER_DEFINED
    path = tmp_path / "rules.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    every = texts(4, 400) + ["Ａｂｃ ﬁn  Ⅳ", " ①②  ", "ｶﾞ", "e\u0301", "x ﬁx yaｃａb", "the  f  e  f"]
    found = {r.doc_id: r for r in encode_documents(spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string"), str(path)).collect()}
    changed = 0
    for k, text in enumerate(every):
        r, data = found[k], text.encode()
        assert list(r.ids) == library.encode(text) and r.decoded == library.decode(list(r.ids))
        spans = list(zip(r.spans[::2], r.spans[1::2], strict=True))
        assert all(a <= b <= len(data) for a, b in spans) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        pieces = library.encode(text, return_type="proto").pieces
        plain = [(s, (p.begin, p.end)) for s, p in zip(spans, pieces, strict=True) if not p.piece.startswith("<0x")]
        assert rule != "identity" or all(s == t for s, t in plain[1:-1])
        changed += library.normalize(text) != Encoder(MODEL).decoder.normalize(text)
    assert changed > 50


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("escape", [True, False])
def test_empty_map_as_walked(prefix, escape):
    """Where the map is empty, text and alignment are those of the walk with a map in which no key is found."""
    nothing = CharacterMap(b"")
    nothing.units = np.zeros(256, "<u4")
    for text in texts(5, 600):
        data, source = normalise(text, Rules(CharacterMap(b""), prefix, False, escape))
        walked, at = normalise(text, Rules(nothing, prefix, False, escape))
        starts = [k for k, c in enumerate(text.encode()) if c & 0xC0 != 0x80]  # the walk gives all bytes of a character its start
        assert data == walked and len(source) == len(at)
        assert [max(s for s in starts if s <= a) for a in source[:-1]] == at[:-1].tolist() and source[-1] == at[-1]


def test_counts_against_the_library():
    vocabulary = unigram_vocabulary(MODEL)
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    own, every = Counter(vocabulary), texts(3)
    assert [own.count(t) for t in every] == [len(x.ids) for x in library.encode_batch(every, add_special_tokens=False)]


def test_ties_go_to_the_longer_last_piece():
    vocabulary = [("<unk>", 0.0), *[(f"<0x{k:02X}>", -9.0) for k in range(256)], (SPACE, -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)]
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    for k in range(12):
        for text in ("a" * k, "a" * k + "é" * (k % 3) + "a"):
            assert Counter(vocabulary).count(text) == len(library.encode(text).ids)


def test_tables(spark):
    df = spark.createDataFrame([(1, "ab c", 0), (None, None, 1), (1, "", 2), (2, "x é" * 40_000, 3)], "doc_id bigint, text string, ids int")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = encode_documents(df, MODEL).collect()
    assert len(found) == 4
    for r in found:
        assert r.decoded == library.decode(r.ids) and len(r.spans) == 2 * len(r.ids)
    assert {r.n_tokens for r in count_tokens(df, MODEL).filter("doc_id is null").collect()} == {0}
    assert encode_documents(df.limit(0), MODEL).count() == count_tokens(df.limit(0), MODEL).count() == 0


def test_queries(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    import hashlib

    for r in op8_offset_preserving(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    own = Counter(unigram_vocabulary(MODEL))
    found = op9_count_only_viterbi(spark, sf_dir).collect()
    assert len(found) == len(docs) and all(r.n_tokens == own.count(docs[r.doc_id]) for r in found)
