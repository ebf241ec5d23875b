"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Layout of a folder (all numbers little-endian):
  ids-*.u16      ids of the documents of one shard, one document after the other; .u32 where
                 the vocabulary has ids above 65,535
  offsets-*.u64  n + 1 positions of a shard's n documents, counted over all shards
  docs-*.i64     doc_id of each document; the lowest 64-bit integer stands for null
  manifest.json  shards in doc_id order: files, documents, ids and first position

One job range-partitions the documents by doc_id and writes a shard per partition; the
number of ids per shard gives every shard's base by a prefix sum over the shards; a second
job writes the offsets. File names differ by attempt, and only those that a finished task
reports enter the manifest, so a lost executor costs its own shards.
"""

from __future__ import annotations

import json
import mmap
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary, blocks
from .words import WordCoder, per_row

NULL_ID = -(2**63)
BLOCK = 16 << 20


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_buffer(uri: str) -> memoryview:
    """A file's bytes: memory-mapped where it is local, else read."""
    store, path = _store(uri)
    if store.type_name == "local":
        with open(path, "rb") as f:
            size = f.seek(0, 2)
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b"")
    with store.open_input_file(path) as f:
        return memoryview(f.readall())


def write_bytes(uri: str, *parts) -> None:
    store, path = _store(uri)
    with store.open_output_stream(path) as f:
        for p in parts:
            f.write(p)


# cuts between words


def word_starts(text: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Starts of parts between which this byte-level BPE never merges; none lies inside a string
    of `whole`, the tokens that the library takes out of a text first.

    Its pattern takes letters, digits, other signs and white space in runs of one kind, a run
    with the single space in front of it. So a text may be cut
    - before a single space and around a single newline, between two characters that are no
      white space,
    - between a letter and an ASCII sign, in either order; but not behind an apostrophe,
      which the pattern joins to some letters.
    Letters are A-Z, a-z and the two-byte characters of Latin-1 except its two signs; a
    character of any other kind is left undecided, which costs a cut only.
    """
    n = len(text)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        kind = _KIND[text]  # 1 letter, 2 sign, 3 digit, 0 anything else
        latin = np.flatnonzero((text[:-1] == 0xC3) & (text[1:] != 0x97) & (text[1:] != 0xB7))
        kind[latin] = kind[latin + 1] = 1
        solid = kind > 0
        between = solid[:-2] & solid[2:]
        middle = text[1:-1]
        cut[1 : n - 1] = between & ((middle == 0x20) | (middle == 0x0A))
        cut[2:n] |= between & (middle == 0x0A)
        a, b = kind[:-1], kind[1:]
        cut[1:n] |= ((a == 1) & (b == 2)) | ((a == 2) & (b == 1) & (text[:-1] != 0x27))
    if whole:
        for m in re.finditer(b"|".join(map(re.escape, sorted(whole, key=len, reverse=True))), text.tobytes()):
            i, j = m.span()
            cut[i + 1 : j] = False
            if np.searchsorted(offsets, i, "right") == np.searchsorted(offsets, j, "left"):  # not from two documents
                cut[i] = cut[j] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


_KIND = np.zeros(256, np.int8)
_KIND[0x21:0x7F] = 2
_KIND[0x30:0x3A] = 3
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1


_CODERS: dict[tuple[str, bool], WordCoder] = {}


def worker_coder(path: str, special_is_text: bool) -> WordCoder:
    """One coder per worker process: the words it knows serve its next tasks too."""
    key = (path, special_is_text)
    if key not in _CODERS:
        _CODERS[key] = tokenizer_coder(path, special_is_text)
    return _CODERS[key]


def tokenizer_coder(path: str, special_is_text: bool = False) -> WordCoder:
    """Ids of words by the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_is_text

    def code(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = [e.ids for e in t.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, done), np.int64, len(done))
        return np.fromiter((i for ids in done for i in ids), np.int32, int(sizes.sum())), sizes

    return WordCoder(code)


def whole_tokens(path: str, special_is_text: bool) -> tuple[bytes, ...]:
    """Strings that the library takes out of a text before anything else."""
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(path).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise NotImplementedError("added tokens that depend on what is around them")
    return tuple(t.content.encode() for t in added if not (t.special and special_is_text))


def id_type(path: str, end_id: int | None) -> str:
    """The narrowest type that holds every id of a tokenizer, and end_id."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    return "u16" if max(most, end_id or 0) < 1 << 16 else "u32"


DTYPES = {"u16": "<u2", "u32": "<u4"}


def _shards(folder: str, path: str, end_id: int | None, special_is_text: bool, kind: str):
    def run(batches):
        from pyspark import TaskContext

        coder = out = None
        tag = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        ids_total, keys, counts_all = 0, [], []
        for b in batches:
            if not b.num_rows:
                continue
            if coder is None:
                coder, whole = worker_coder(path, special_is_text), whole_tokens(path, special_is_text)
                store, place = _store(f"{folder}/ids-{tag}.{kind}")
                out = store.open_output_stream(place)
            data, offsets = binary(b.column(1))
            keys.append(b.column(0).fill_null(NULL_ID).to_numpy().astype("<i8"))
            for i, j in blocks(offsets, BLOCK):
                text = data[offsets[i] : offsets[j]]
                off = offsets[i : j + 1] - offsets[i]
                starts = word_starts(text, off, whole)
                ids, sizes = coder(text, starts, len(text))
                counts = per_row(starts, sizes, off)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                out.write(ids.astype(DTYPES[kind]))
                counts_all.append(counts)
                ids_total += len(ids)
        if out is not None:
            out.close()
            counts, key = np.concatenate(counts_all), np.concatenate(keys)
            write_bytes(f"{folder}/docs-{tag}.i64", key)
            write_bytes(f"{folder}/counts-{tag}.u64", counts.astype("<u8"))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, "tag": tag, "docs": len(counts), "ids": ids_total}])

    return run


def _offsets(folder: str):
    def run(batches):
        for b in batches:
            for shard in b.to_pylist():
                counts = np.frombuffer(read_buffer(f"{folder}/counts-{shard['tag']}.u64"), "<u8")
                write_bytes(f"{folder}/offsets-{shard['tag']}.u64", (shard["base"] + np.append(0, np.cumsum(counts))).astype("<u8"))
                yield pa.RecordBatch.from_pylist([{"tag": shard["tag"]}])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, special_is_text: bool = False) -> dict:
    """Encode every whole text of docs (doc_id, text) in doc_id order into `folder`; the manifest.

    A null text is empty; a null doc_id comes first; rows with equal ids stay next to each
    other. An empty table writes a manifest without shards. Strings of special tokens in a
    text become those tokens, as the library does it, or with special_is_text ordinary text.
    Other columns take no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    kind = id_type(tokenizer, end_id)
    made = scratch.save(ordered.mapInArrow(_shards(folder, tokenizer, end_id, special_is_text, kind), "part bigint, tag string, docs bigint, ids bigint"), "shards")
    shards, base = [], 0
    for r in made.orderBy("part").collect():  # one row per partition
        shards.append({"tag": r.tag, "docs": r.docs, "ids": r.ids, "base": base})
        base += r.ids
    if shards:
        frame = spark.createDataFrame(shards, "tag string, docs bigint, ids bigint, base bigint").repartition(len(shards), "tag")
        frame.mapInArrow(_offsets(folder), "tag string").count()
    manifest = {"version": 1, "dtype": kind, "ids": base, "docs": sum(s["docs"] for s in shards), "end_id": end_id, "shards": shards}
    write_bytes(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    return json.loads(bytes(read_buffer(f"{folder}/manifest.json")))


def open_shard(folder: str, shard: dict, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, offsets over all shards, token ids), memory-mapped."""
    return tuple(np.frombuffer(read_buffer(f"{folder}/{name}-{shard['tag']}.{ext}"), dt) for name, ext, dt in (("docs", "i64", "<i8"), ("offsets", "u64", "<u8"), ("ids", dtype, DTYPES[dtype])))


def _read(folder: str, digest: bool, dtype: str):
    def run(batches):
        for b in batches:
            for shard in b.to_pylist():
                keys, off, ids = open_shard(folder, shard, dtype)
                local = (off - off[0]).astype(np.int64)
                for i in range(0, len(keys), 2048):
                    j = min(len(keys), i + 2048)
                    key = pa.array(keys[i:j], pa.int64(), mask=keys[i:j] == NULL_ID)
                    head = [key, pa.array(off[i:j].astype(np.int64)), pa.array(np.diff(local[i : j + 1]))]
                    if digest:
                        crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(local[i:j], local[i + 1 : j + 1])]
                        yield pa.RecordBatch.from_arrays([*head, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    else:
                        part = pa.ListArray.from_arrays(pa.array((local[i : j + 1] - local[i]).astype(np.int32)), pa.array(ids[local[i] : local[j]].astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([*head, part], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids or ids_crc32, from the files.

    Each document written is a row, repeated ones too; a null doc_id is null again. A folder
    without shards gives an empty result."""
    schema = "tag string, docs bigint, ids bigint, base bigint"
    manifest = read_manifest(folder)
    shards = manifest["shards"]
    frame = spark.createDataFrame(shards, schema).repartition(len(shards), "tag") if shards else spark.createDataFrame([], schema)
    return frame.mapInArrow(_read(folder, digest, manifest["dtype"]), "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<bigint>"))
