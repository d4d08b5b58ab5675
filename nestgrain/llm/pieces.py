"""SentencePiece encoding and decoding through a table of distinct marked words.

A model whose pieces hold the white-space marker only at their start, or hold nothing else, never
merges across "letter, marker". A text is then a row of chunks, each a run of markers with what
follows up to the next marker, and the library's segmentation of the text is that of its chunks,
one after the other. Splitting tasks number the distinct chunks of every block of texts and keep
a text as numbers; each block sends its distinct chunks, packed, to the task that owns their
hash, where every distinct chunk of the corpus is segmented once, and gets their ids back by
number. Ids are joined by position; texts never travel, numbered or not: blocks are stored in
buckets, and the ids come to them. A word that is everywhere travels once a block. Decoding works on the same chunks, each decoded by the library.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MARKER = "▁"
BLOCK_BYTES = 16 << 20  # text numbered together; a longer text is a block of its own
OWNED_BYTES = 64 << 20  # text bytes for each task that segments chunks
BUCKETS = (16, 10_000)  # least and most buckets of the stored blocks; between, one for each block
PARTS = "block long, owner int, doc_ids array<long>, codes binary, chunks binary"


def load_model(model_path: str):
    """The processor of a model whose chunks are independent; ValueError for any other model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        proto.ParseFromString(file.read())
    rules, trainer = proto.normalizer_spec, proto.trainer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
    if not plain or rules.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or trainer.model_type != trainer.BPE:
        raise ValueError("the model changes characters or spaces, marks words at their end, or is no BPE model")
    for piece in proto.pieces:
        if piece.type == piece.USER_DEFINED:
            raise ValueError("user-defined symbols may cross words")
        if piece.type == piece.NORMAL and MARKER in piece.piece.lstrip(MARKER):
            raise ValueError(f"piece {piece.piece!r} crosses words")
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def chunk_keys(text: str) -> list[str]:
    """The chunks of ``text``, each without its first marker (the first chunk's is the one that the library puts in front)."""
    if not text:
        return []
    parts = text.replace(MARKER, " ").split(" ")
    if "" not in parts:
        return parts
    keys, waiting = [], 0
    for part in parts:
        if part:
            keys.append(MARKER * waiting + part)
            waiting = 0
        else:
            waiting += 1
    if waiting:
        keys.append(MARKER * (waiting - 1))
    return keys


def _packed(ids, top: int) -> bytes:
    return np.asarray(ids, np.uint16 if top <= 65535 else np.uint32).tobytes()


def _numbers(packed: bytes, top: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint16 if top <= 65535 else np.uint32)


def _short(numbers: np.ndarray) -> bytes:
    """Numbers in few bytes where they are small: as characters in UTF-8, or plainly if one is no character."""
    plain = numbers.astype("<u4").tobytes()
    if numbers.max(initial=0) > 0x10FFFF:
        return b"w" + plain
    return b"u" + plain.decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def _long(short: bytes) -> np.ndarray:
    plain = short[1:] if short[:1] == b"w" else short[1:].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(plain, "<u4")


def _squeezed(data: bytes, width: int = 1) -> bytes:
    """Compressed, with the bytes of ``width``-byte numbers apart by place."""
    planes = np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _opened(data: bytes, width: int = 1) -> bytes:
    planes = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.tobytes()


class _Numbered(dict):
    """Chunk to its number, in order of first sight."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        return number


def _split(owners: int):
    """Rows of two kinds: a block's documents as chunk numbers (owner null), and the chunks of it that one owner segments."""

    def block_rows(block: int, ids: list, coded: list, known: _Numbered) -> pa.RecordBatch:
        codes = np.concatenate(coded).astype(np.int64)
        order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")  # frequent chunks get small numbers
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        names = list(known)
        shares: dict[int, tuple[list, list]] = {}
        for number, at in enumerate(order.tolist()):
            numbers, chunks = shares.setdefault(xxhash.xxh3_64_intdigest(names[at]) % owners, ([], []))
            numbers.append(number)
            chunks.append(names[at])
        lengths = np.array([len(c) for c in coded], "<u4")
        docs = np.concatenate([lengths, rank[codes].astype("<u4")])
        rows = 1 + len(shares)
        return pa.RecordBatch.from_arrays([
            pa.array([block] * rows, pa.int64()), pa.array([None, *shares], pa.int32()), pa.array([ids] + [None] * len(shares), pa.list_(pa.int64())),
            pa.array([_squeezed(docs.tobytes(), 4)] + [_short(np.diff(n, prepend=0)) for n, _ in shares.values()], pa.binary()),
            pa.array([None] + [_squeezed(" ".join(c).encode()) for _, c in shares.values()], pa.binary())],
            ["block", "owner", "doc_ids", "codes", "chunks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, coded, known, size = [], [], _Numbered(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                text = text.as_py() or ""
                coded.append(np.array([known[k] for k in chunk_keys(text)], np.uint32))
                size += len(text) + 16
                if size >= BLOCK_BYTES:
                    yield block_rows(block, ids, coded, known)
                    block, ids, coded, known, size = block + 1, [], [], _Numbered(), 0
        if ids:
            yield block_rows(block, ids, coded, known)

    return run


def _segmented(model_path: str):
    """Ids of every chunk row; an owner's rows come one after the other, and each of its chunks is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        top = model.get_piece_size()
        owner, known = None, {}
        for batch in batches:
            out = {"block": [], "codes": [], "lengths": [], "ids": []}
            for block, own, codes, chunks in zip(*(batch.column(c).to_pylist() for c in ("block", "owner", "codes", "chunks"))):
                if own != owner:
                    owner, known = own, {"": _packed([model.piece_to_id(MARKER)], top)}
                keys = _opened(chunks).decode().split(" ")
                new = [k for k in keys if k not in known]
                for key, ids in zip(new, model.encode(new, num_threads=1)):
                    known[key] = _packed(ids, top)
                found = [known[k] for k in keys]
                out["block"].append(block)
                out["codes"].append(codes)
                out["lengths"].append(_short(np.array([len(f) for f in found])))
                out["ids"].append(_squeezed(b"".join(found), 2 if top <= 65535 else 4))
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64())] + [pa.array(out[c], pa.binary()) for c in ("codes", "lengths", "ids")], list(out))

    return run


def _joined(model_path: str, keep: bool):
    """All documents of one block: ids by position, and the text that they decode to."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        model = load_model(model_path)
        top = model.get_piece_size()
        wide = 2 if top <= 65535 else 4
        ids_of: dict[int, bytes] = {}
        for codes, lengths, ids in zip(*(table.column(c).to_pylist() for c in ("codes", "lengths", "ids"))):
            at, ids = 0, _opened(ids, 2 if top <= 65535 else 4)
            for code, length in zip(np.cumsum(_long(codes)).tolist(), _long(lengths).tolist()):
                ids_of[code] = ids[at : at + length]
                at += length
        guard = model.encode("a")  # a word in front, so that decoding keeps the chunk's first marker
        order = list(ids_of)
        texts = model.decode([guard + _numbers(ids_of[c], top).tolist() for c in order], num_threads=1) if order else []
        text_of = {c: t[1:] for c, t in zip(order, texts)}
        first, last = _packed([model.bos_id()], top), _packed([model.eos_id()], top)
        out = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        doc_ids = docs.column("doc_ids")[0].as_py()
        both = np.frombuffer(_opened(docs.column("codes")[0].as_py(), 4), "<u4")
        ends = len(doc_ids) + np.cumsum(both[: len(doc_ids)], dtype=np.int64)
        for doc_id, low, high in zip(doc_ids, [len(doc_ids), *ends[:-1].tolist()], ends.tolist()):
            numbers = both[low:high].tolist()
            ids = first + b"".join(map(ids_of.__getitem__, numbers)) + last
            full = np.frombuffer(ids, np.uint16 if wide == 2 else np.uint32).astype("<u4").tobytes()
            decoded = "".join(map(text_of.__getitem__, numbers))[1:]
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(ids) // wide)
            out["ids_sha256"].append(hashlib.sha256(full).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            out["ids"].append(full if keep else None)
            out["decoded"].append(decoded if keep else None)
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return run


def _bucketed(df: DataFrame, key: str, buckets: int, folder: str) -> DataFrame:
    """``df`` stored in ``folder`` in buckets of ``key``; grouping what is read back by ``key`` needs no shuffle."""
    name = "nestgrain_" + uuid.uuid4().hex
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", folder).format("parquet").saveAsTable(name)
    stored = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the name alone: a table with its own path leaves the files where they are
    return stored


def encoded(docs: DataFrame, model_path: str, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) of every row of ``docs``.

    Ids are those of the library on the whole text, with begin and end ids and without sampling.
    ``ids`` (little-endian 32-bit) and ``decoded`` are filled with ``keep`` only. A null text is
    an empty one: begin and end alone, decoded to an empty text. Equal rows and rows with equal
    or null ids stay apart; columns beside doc_id and text play no part. An empty table gives an
    empty result. ``model_path`` must exist wherever tasks run.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    load_model(model_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(32, -(-size // OWNED_BYTES))
    folder = f"{spark.sparkContext.getCheckpointDir()}/chunks-{uuid.uuid4().hex}"
    parts = _bucketed(rows.mapInArrow(_split(owners), PARTS), "block", min(max(BUCKETS[0], size // BLOCK_BYTES), BUCKETS[1]), folder)
    chunks = parts.where("owner IS NOT NULL").select("block", "owner", "codes", "chunks")
    table = chunks.repartition(owners, "owner").sortWithinPartitions("owner").mapInArrow(
        _segmented(model_path), "block long, codes binary, lengths binary, ids binary")
    texts = parts.where("owner IS NULL").select("block", "doc_ids", "codes")
    return texts.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(
        _joined(model_path, keep), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
