import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.token_files import open_shard, read_manifest, read_tokens, tokenizer_coder, whole_tokens, word_starts, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(5)
    parts = ["the", "don't", " ", "  ", "\n", "\t", "a b", " ", "　", "é", "ñandú", "日本", "🙂", "12", "3.5", "%%%", "'s", "<|endoftext|>", " x", "\u0085", "\r\n", "\x1c"]
    return ["", None, " ", " a", "a ", *("".join(r.choice(parts) + r.choice([" ", " ", ""]) for _ in range(r.randint(1, 25))) for _ in range(300))]


@pytest.mark.parametrize("special_is_text", [False, True])
def test_cutting_into_words_changes_no_id(special_is_text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = special_is_text
    coder, whole = tokenizer_coder(PATH, special_is_text), whole_tokens(PATH, special_is_text)
    ts = [s or "" for s in texts()] + ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n y", "a'<|endoftext|>s", "<|endof", "text|>b"]
    for s in ts:
        data = np.frombuffer(s.encode(), np.uint8)
        ids, _ = coder(data, word_starts(data, np.array([0, len(data)]), whole), len(data))
        assert list(ids) == t.encode(s, add_special_tokens=False).ids, s
    # all of them in one buffer: no cut depends on the next document
    data, off = np.frombuffer("".join(ts).encode(), np.uint8), np.cumsum([0, *(len(s.encode()) for s in ts)])
    ids, _ = coder(data, word_starts(data, off, whole), len(data))
    assert list(ids) == [i for s in ts for i in t.encode(s, add_special_tokens=False).ids]


def test_files_round_trip(spark, tmp_path):
    ts = texts()
    rows = [(7 * (i % 50) - 40 + i, s, i) for i, s in enumerate(ts)] + [(None, "null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    folder = f"file://{tmp_path}/tokens"
    manifest = write_tokens(docs, folder, PATH)
    assert read_manifest(folder) == manifest
    t = Tokenizer.from_file(PATH)
    want = sorted((((i is not None, i or 0), [*t.encode(s or "", add_special_tokens=False).ids, 0]) for i, s, _ in rows))
    flat = np.concatenate([open_shard(folder, s, manifest["dtype"])[2] for s in manifest["shards"]])
    assert len(flat) == manifest["ids"] == sum(len(ids) for _, ids in want)
    ends = np.concatenate([open_shard(folder, s, manifest["dtype"])[1][:-1] for s in manifest["shards"]])
    assert (np.diff(ends) > 0).all()
    got = read_tokens(spark, folder).collect()
    assert sorted((((r.doc_id is not None, r.doc_id or 0), r.ids) for r in got)) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda x: (x is not None, x or 0))
    for r in read_tokens(spark, folder, digest=True).collect():
        assert r.ids_crc32 == zlib.crc32(flat[r.start : r.start + r.n_tokens].astype("<u4").tobytes())


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)["ids"] == 0
    assert read_tokens(spark, folder, digest=True).count() == 0
