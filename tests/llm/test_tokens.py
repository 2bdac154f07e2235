import hashlib
import itertools

import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from helixframe.llm import pieces, queries, token_counts
from helixframe.llm.queries import MODEL_PATH

TEXTS = ["", None, " ", "  a  b ", "\n\n x\ty ▁ z ▁▁q", "日本語 テスト 🎉🎉 é", "<s></s><0x0A>[INST]", "a" * 3000, "\x00 x", " " * 50 + "x", "The quick, brown fox!! jumps 123 times...", "word " * 20_000, "x" * 200_000]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL_PATH)


def test_ids_and_decoding_equal_the_library(spark, library, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op3_pieces(spark, str(tmp_path)).collect():
        ids = [*library.encode(TEXTS[r.doc_id] or ""), library.eos_id()]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), r.doc_id
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.spans_cover_text


def test_spans_are_the_source_bytes_of_pieces(library):
    encoder = pieces.Encoder(pieces.PieceModel(MODEL_PATH))
    for text in filter(None, TEXTS[:11]):
        ids, edges = encoder.text(text)
        raw = text.encode()
        assert edges[0] == 0 and edges[-1] == len(raw) and (edges[1:] >= edges[:-1]).all()
        for i, a, b in zip(ids.tolist(), edges[:-1], edges[1:]):
            piece = library.id_to_piece(i)
            if not library.is_byte(i):
                assert raw[a:b].decode().replace(" ", "▁") == (piece if a else piece.removeprefix("▁") if not raw[a:b].decode().replace(" ", "▁") == piece else piece)


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 2)], "text string, ids int, Ends int")
    out = pieces.encode_texts(df, "text", MODEL_PATH)
    assert out.columns == ["text", "ids", "Ends", "ids_", "begins", "ends_", "decoded"] and out.first()["ids"] == 1
    assert pieces.encode_texts(df.limit(0), "text", MODEL_PATH).count() == 0
    assert token_counts.count_tokens(df.limit(0), "text", MODEL_PATH).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_map_normalises_as_the_library(rule):
    own = SentencePieceNormalizer(rule_name=rule)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(own.serialized_model_proto())
    model = pieces.PieceModel(MODEL_PATH)
    model.map = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    spec = proto.normalizer_spec
    model.dummy, model.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
    for text in ["ＡＢＣ ㍿ ﬁne", "①② ｶﾞ", "e\u0301 x", "plain", "Ⅳ¼", "한글", "日本", "A  B ", "  x\u3000 y", ""]:
        normal, starts = model.normalized(text)
        assert normal == own.normalize(text), text
        assert len(starts) == len(normal) + 1 and starts[-1] <= len(text.encode()) and (starts[1:] >= starts[:-1]).all()
    model.dummy = False
    assert model.normalized("㍿x")[1].tolist()[:5] == [0, 0, 0, 0, 3]


def best_counts(word, scores, unknown):
    """The least and greatest token counts among all segmentations of the highest score."""
    found = []
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in scores or len(p) == 1 for p in parts):
            found.append((sum(scores.get(p, unknown) for p in parts), sum(1 if p in scores else len(p.encode()) for p in parts)))
    top = max(s for s, _ in found)
    return {n for s, n in found if abs(s - top) < 1e-9}


def test_unigram_counts_against_all_segmentations():
    scores = {"a": -1.0, "b": -2.5, "ab": -2.0, "ba": -3.0, "aba": -2.9, "bab": -9.0, "é": -4.0}
    counter = token_counts.UnigramCounter(scores)
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abx", repeat=n)] + ["é", "aé日b"]
    counter.learn(words)
    for w in words:
        assert counter[w] in best_counts(w, scores, counter.unknown), w
    # Every prefix of these words is a word: the trie has one node for each, and each was computed once.
    assert counter.steps == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_token_counts_of_rows(spark):
    model = pieces.PieceModel(MODEL_PATH)
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "The", "The"]], "text string")
    got = [(r.n_tokens, r.n_pretokens) for r in token_counts.count_tokens(df, "text", MODEL_PATH).collect()]
    assert got[0] == got[1] == (0, 0) and got[-1] == got[-2] and len(got) == len(TEXTS) + 2
    counter = token_counts.UnigramCounter(token_counts.unigram_scores(model))
    for text, (tokens, parts) in zip(TEXTS, got):
        chunks = model.chunk.findall(model.normalized(text or "")[0])
        counter.learn(chunks)
        assert tokens == sum(counter[c] for c in chunks) and parts == len(chunks)


def test_counts_equal_the_library_on_a_unigram_model(spark, tmp_path):
    """A unigram model file made of the vocabulary and the probabilities that the counts go by."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL_PATH, "rb").read())
    scores = token_counts.unigram_scores(pieces.PieceModel(MODEL_PATH))
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = scores.get(p.piece, p.score) if p.type == pieces.NORMAL else p.score
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    own = SentencePieceProcessor(model_file=str(path))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TEXTS[:11]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = [len(own.encode(t or "")) for t in texts]
    for model in (str(path), MODEL_PATH):
        assert [r.n_tokens for r in token_counts.count_tokens(df, "text", model).collect()] == expected
    with pytest.raises(ValueError, match="BPE"):
        pieces._encoder(str(path))
