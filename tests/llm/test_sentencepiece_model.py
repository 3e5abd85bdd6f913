import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from barlake.llm import queries
from barlake.llm import sentencepiece_model as sp

TEXTS = ["", "  two  spaces ", " lead", "tab\tnew\nline", "emoji 😀 \u0000 x", "▁meta ▁ x", "日本語テスト", "a" * 1000, "   ", "\n", "<s> </s> <unk> <0x41>"]
TEXTS += ["x<unk>y", "▁", "▁▁ ▁", "The quick brown fox jumps over the lazy dog. " * 40, "ﬁ ① ＡＢＣ é"]


@pytest.fixture(scope="module")
def data():
    with open(queries.MODEL, "rb") as file:
        return file.read()


def test_parity_and_round_trip(data):
    encoder = sp.Encoder(data)
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = [list(memoryview(packed).cast("i")) for packed in encoder.encode(TEXTS)]
    assert ids == own.encode(TEXTS) == [found.ids for found in encoder.made.encode_batch(TEXTS, add_special_tokens=False)]
    assert encoder.decode(ids) == [encoder.plain_text(t) for t in TEXTS] == own.decode(ids)
    assert encoder.made.decode_batch(ids, skip_special_tokens=False) == encoder.decode(ids)


def handmade(kind, byte_fallback):
    """A small model written down piece by piece; nothing is trained."""
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = kind
    model.trainer_spec.byte_fallback = byte_fallback
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    words = ["▁", "t", "h", "e", "a", "n", "▁t", "he", "▁the", "an", "▁a", "▁an", "th", "hen", "▁then", "the"]
    pieces += [(w, -1.0 - 0.37 * k if kind == sp.UNIGRAM else -float(k), 1) for k, w in enumerate(words)]
    for piece, score, type_ in pieces:
        added = model.pieces.add()
        added.piece, added.score, added.type = piece, score, type_
    return model.SerializeToString()


@pytest.mark.parametrize("kind", [sp.UNIGRAM, sp.BPE])
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_handmade_models(kind, byte_fallback):
    data = handmade(kind, byte_fallback)
    parsed = sp.Model.parse(data)
    assert parsed.kind == kind and parsed.byte_fallback == byte_fallback and not parsed.remove_extra_spaces
    encoder, own = sp.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the then an ant", "then  the", "", "hat", "thenthe a", "an é the" if byte_fallback else "an the", "tttthhhee nnn aaa"]
    ids = [list(memoryview(packed).cast("i")) for packed in encoder.encode(texts)]
    assert ids == own.encode(texts)
    assert encoder.decode(ids) == texts


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, made):
        self.made, self.texts = made, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.made.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.made, name)


def test_new_words_are_encoded_together(data):
    encoder, own = sp.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder.core = Counted(encoder.core)
    pick = random.Random(5)
    word = lambda: "".join(pick.choices("abcdeénostr😀▁中", k=pick.randint(1, 9)))
    texts = [(" " * pick.randint(1, 3)).join(word() for _ in range(40)) + " " * pick.randint(0, 2) for _ in range(100)]
    for batch in (texts, texts[::-1], ["", ""], ["", texts[3], ""]):
        assert [list(memoryview(packed).cast("i")) for packed in encoder.encode(batch)] == own.encode(batch)
    assert len(encoder.known) > 3000 and encoder.core.texts < len(encoder.known) / 4


def test_decoding_is_that_of_the_library(data):
    encoder, pick = sp.Encoder(data), random.Random(7)
    # mostly byte pieces and control pieces at first, so that many runs of bytes are no text
    ids = [[pick.randrange(300 if k < 60 else len(encoder.model.pieces)) for _ in range(k % 30)] for k in range(120)]
    ids += [*([i] for i in range(300)), [encoder.core.token_to_id(f"<0x{b:02X}>") for b in "é▁😀".encode()], []]
    assert encoder.decode(ids) == encoder.made.decode_batch(ids, skip_special_tokens=False)
    assert encoder.decode([]) == []


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 50_000, "a"), (3, "word " * 50_000, "a"), (None, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = sp.tokenize(docs, queries.MODEL).collect()
    assert all(r.tokens.round_trip and r.tokens.parity for r in got)
    assert sorted(len(r.tokens.ids) for r in got)[:2] == [0, 0] and len(got) == 5
    assert sp.tokenize(docs.limit(0), queries.MODEL).count() == 0
    back = sp.decode(sp.tokenize(docs, queries.MODEL).selectExpr("doc_id", "text", "tokens.ids"), queries.MODEL).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_query(spark):
    got = queries.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in got)
