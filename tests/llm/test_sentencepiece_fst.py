import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from quarry.llm.sentencepiece_fst import Transducer, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces, declared as unigram model, with scores like log-probabilities."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -5 - (i * 7919 % 10007) / 1024 - 3 / len(p.piece)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def texts():
    r = random.Random(3)
    words = "the of retention Überraschung él niño 日本語 zzqx 🙂 x\ny  two   gaps . ,,, 1234 café \u0001".split(" ")
    out = ["", None, " ", "  lead", "trail ", "a\n\nb", "\n", "🙂🙂", "é"]
    return out + [" ".join(r.choices(words, k=r.randint(1, 20))) for _ in range(150)]


def test_ids_of_a_unigram_model_match_the_library(spark, unigram):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    ts = texts()
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id int, text string")
    got = {r.doc_id: r.ids for r in encode(docs, unigram).collect()}
    for i, t in enumerate(ts):
        assert got[i] == library.encode(t or ""), t


def test_paths_of_the_public_model_are_cheapest():
    fst = Transducer(MODEL)
    pieces = {b: i for i, b in enumerate(fst.out) if b and i not in set(fst.byte_id)}

    def shortest(word):
        """Every piece at every position, leftmost start first on ties."""
        text = word.decode()
        cost, back = [0.0] + [float("inf")] * len(text), [None] * (len(text) + 1)
        for s in range(len(text)):
            for e in range(s + 1, len(text) + 1):
                b = text[s:e].encode()
                if b in pieces or e == s + 1:
                    ids = [pieces[b]] if b in pieces else [int(fst.byte_id[x]) for x in b]
                    c = cost[s] + (fst.weight[pieces[b]] if b in pieces else fst.unknown_weight)
                    if c < cost[e]:
                        cost[e], back[e] = c, (s, ids)
        out, e = [], len(text)
        while e:
            e, ids = back[e]
            out = ids + out
        return out

    words = [(" " + w).encode() for t in texts() if t for w in t.split(" ") if w]
    ids, counts = fst.paths(words)
    at = 0
    for w, c in zip(words, counts):
        assert list(ids[at : at + c]) == shortest(w), w
        at += c


def test_round_trip_and_digest(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts() + ["▁a", "w" * 30000])], "doc_id int, text string, ids string")
    back = {r.doc_id: r.text for r in decode(encode(docs)).collect()}
    flags = {r.doc_id: r.round_trip for r in encode(docs, digest=True).collect()}
    for r in docs.collect():
        same = "▁" not in (r.text or "")
        assert flags[r.doc_id] == same
        assert (back[r.doc_id] == (r.text or "")) == same


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id int, text string")).count() == 0
