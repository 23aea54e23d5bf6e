"""Token-ID output: length-delimited binary records with masked checksums and an offset index.

A data file is a header and frames, one per document::

    frame = length u64 | masked crc of length u32 | payload | masked crc of payload u32
    payload = doc_id i64 | has_id u8 | token ids, little-endian u16 or u32

All numbers are little-endian.  The checksum is CRC-32 (zlib's), masked by
rotation and a constant, so that a checksum of data holding checksums stays
sound.  The index file holds, per frame, its byte offset, the global number of
the first token and the token count; a shuffled reader seeks with it.

Documents are range-partitioned on doc_id and sorted, so that files in name
order hold ascending ids; null ids come first, ties are ordered by text.
``start`` is the running count of ids before a document: each task reports its
total, the driver adds up one number per file.  Files are written under a
name of the task attempt and only those in the manifest of finished tasks
count, so a lost executor leaves at most an orphan.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import file_system, fresh_path, frugal, materialise
from .wordgrams import byte_chunks

#: Fixed values of the format.
MAGIC, MASK_DELTA, END_ID = b"PLTOK1\0\0", 0xA282EAD8, 0
INDEX_TYPE = np.dtype([("offset", "<u8"), ("start", "<u8"), ("n_tokens", "<u8")])
#: How byte-level vocabularies spell a space.
SPACE_MARK = "\u0120"
#: Letters of scripts whose classes are settled, then stop marks: two parts for a byte-level vocabulary.
PLAIN_CHUNK = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿĀ-ſА-Яа-яЁё]+)(?P<mark>[.,;:!?]*)$"
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
BATCH_BYTES = 8 << 20


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(*parts: bytes) -> bytes:
    """One length-delimited record of a payload in parts."""
    payload = b"".join(parts)
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of every frame; raises on a bad checksum or a cut file."""
    at = stream.tell()
    while head := stream.read(12):
        size, crc = struct.unpack("<QI", head)
        if masked_crc(head[:8]) != crc:
            raise ValueError(f"bad length checksum at byte {at}")
        body = stream.read(size + 4)
        payload = body[:size]
        if len(body) != size + 4 or masked_crc(payload) != struct.unpack("<I", body[size:])[0]:
            raise ValueError(f"bad payload checksum at byte {at}")
        yield at, payload
        at += 16 + size


def _strings(values: pa.Array) -> list[str]:
    """The texts of an array without nulls; by way of numpy, which makes no scalar of each."""
    return values.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Ids of whole texts, with repeated chunks encoded once per batch.

    A byte-level vocabulary splits "ab cd" before the space whatever surrounds
    it, as long as the space stands between two characters that are not white
    space.  So texts are cut at spaces, each distinct chunk of the batch is
    encoded once (with its space, or without where it opens a text) and a text's
    ids are its chunks' ids in a row.  A text with an irregular chunk (empty,
    edged by other white space, or holding a special token) is encoded whole.
    Chunks of letters and a stop mark, which split between the two, go to the
    vocabulary's model directly.  Nothing is kept from batch to batch, so memory
    is bounded by the batch.
    """

    def __init__(self, tokenizer, kind: np.dtype):
        self.tokenizer, self.kind = tokenizer, kind
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        pre = tokenizer.pre_tokenizer
        words = tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(tokenizer.get_vocab_size(), *words.values()) + 1, bool)  # ids whose token begins with a space
        self.opens[[k for w, k in words.items() if w.startswith(SPACE_MARK)]] = True
        self.by_chunk = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and tokenizer.normalizer is None and not any(" " in x for x in self.special)
        self.model = tokenizer.model
        # printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.spelling = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(plain)))}

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the number of each."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((k for ids in found for k in ids), self.kind), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_chunks(self, chunks: list[str], run: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of each chunk with a space before it; many chunks go in one
        text and part where a token begins with a space, as no chunk holds one inside."""
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for a in range(0, len(chunks), run):
            part = chunks[a : a + run]
            [made] = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids.append(np.array(made.ids, self.kind))
            cuts = np.flatnonzero(self.opens[ids[-1]])
            if len(cuts) != len(part):
                raise ValueError("chunks and ids do not line up")
            sizes.append(np.diff(cuts, append=len(ids[-1])))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_words(self, words: list[str], marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of each word with a space before it and its stop marks after it."""
        tokenize, of_marks = self.model.tokenize, {"": []}
        ids, sizes = [], []
        for word, mark in zip(words, marks, strict=True):
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
            if mark not in of_marks:
                of_marks[mark] = [t.id for t in tokenize(mark)]
            made = [t.id for t in tokenize(SPACE_MARK + spelled)] + of_marks[mark]
            ids += made
            sizes.append(len(made))
        return np.array(ids, self.kind), np.array(sizes, np.int64)

    def _irregular(self, chunks: pa.Array) -> np.ndarray:
        """Which chunks may split otherwise inside a text than alone."""
        bad = pc.or_(pc.equal(chunks, ""), pc.not_equal(pc.utf8_trim_whitespace(chunks), chunks))
        for special in self.special:
            bad = pc.or_(bad, pc.match_substring(chunks, special))
        return bad.to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and the number of each text's."""
        if not self.by_chunk:
            return self._encode(_strings(texts))
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        chunks = cut.flatten().dictionary_encode()
        del cut
        names, code = chunks.dictionary, chunks.indices.to_numpy()
        bad = self._irregular(names)
        whole = np.logical_or.reduceat(bad[code], starts)
        alone = np.flatnonzero(whole)
        parts = pc.extract_regex(names, PLAIN_CHUNK)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False) & ~bad
        word_ids, word_sizes = self._encode_words(*(_strings(parts.field(k).filter(pa.array(plain))) for k in (0, 1)))
        other_ids, other_sizes = self._encode_chunks(_strings(names.filter(pa.array(~plain & ~bad))))
        heads = names.take(pa.array(code[starts[~whole]])).dictionary_encode()
        head_ids, head_sizes = self._encode(_strings(heads.dictionary))
        own_ids, own_sizes = self._encode(_strings(texts.take(pa.array(alone))))
        # one list of ids per plain chunk, other chunk, opening chunk and whole text
        lists = np.concatenate((word_sizes, other_sizes, head_sizes, own_sizes)).astype(np.int32)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lists))).astype(np.int32))
        every = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate((word_ids, other_ids, head_ids, own_ids))))
        where = np.zeros(len(names), np.int32)
        where[plain] = np.arange(len(word_sizes))
        where[~plain & ~bad] = len(word_sizes) + np.arange(len(other_sizes))
        n = len(word_sizes) + len(other_sizes)
        place = where[code]
        place[starts[~whole]] = n + heads.indices.to_numpy()
        place[starts[whole]] = n + len(head_sizes) + np.arange(len(alone))
        of_whole = np.repeat(whole, np.diff(starts, append=len(code)))
        of_whole[starts] = False
        place = place[~of_whole]  # a text that is encoded whole is one entry
        del chunks, of_whole
        first = np.cumsum(np.concatenate(([0], np.where(whole, 1, np.diff(starts, append=len(code))))))[:-1]
        return every.take(pa.array(place)).flatten().to_numpy(), np.add.reduceat(lists[place], first, dtype=np.int64)


_loaded: dict = {}


def _encoder(path: str) -> ChunkEncoder:
    """One tokenizer per Python worker; ids are u16 where the vocabulary allows."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = ChunkEncoder(tokenizer, np.dtype("<u4" if tokenizer.get_vocab_size() > 1 << 16 else "<u2"))
    return _loaded[path]


def default_path() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def _writer(folder: str, tokenizer_path: str | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path or default_path())
        kind, end = encode.kind, np.array([END_ID], encode.kind).tobytes()
        fs, root = file_system(folder)
        name = f"{uuid.uuid4().hex}.tok"
        path, offsets, counts, first = f"{root}/{name}", [], [], None
        out, at, total = None, len(MAGIC) + 1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path)
                out.write(MAGIC + bytes([kind.itemsize]))
                first = batch.column("part")[0].as_py()
            doc_ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
            for a, b in byte_chunks(texts, BATCH_BYTES):
                ids, sizes = encode(texts.slice(a, b - a))
                ids, done = memoryview(ids.astype(kind, copy=False)).cast("B"), 0
                for doc_id, n in zip(doc_ids.slice(a, b - a).to_pylist(), sizes.tolist(), strict=True):
                    record = frame(struct.pack("<qB", doc_id or 0, doc_id is not None), ids[done : (done := done + n * kind.itemsize)], end)
                    out.write(record)
                    offsets.append(at)
                    counts.append(n + 1)
                    at, total = at + len(record), total + n + 1
        if out is None:
            return
        out.close()
        index = np.zeros(len(offsets), INDEX_TYPE)
        index["offset"], index["n_tokens"] = offsets, counts
        index["start"] = np.concatenate(([0], np.cumsum(counts)[:-1]))
        with fs.open_output_stream(f"{path}.idx") as side:
            side.write(index.tobytes())
        yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([first], pa.int32()), "n_docs": [len(offsets)], "n_tokens": [total], "n_bytes": [at]})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None, files: int | None = None) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text); returns the manifest, one row per file.

    The manifest (file, part, n_docs, n_tokens, n_bytes, base) is a written table;
    ``base`` is the number of tokens in the files before.  A null text is empty.
    An empty table writes no file.  More columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    done = materialise(
        ordered.mapInArrow(frugal(_writer(folder, tokenizer_path)), "file string, part int, n_docs long, n_tokens long, n_bytes long"), "token-manifest"
    )
    # one row per file, so the running sum is over a handful of rows
    rows, base = [], 0
    for r in sorted(done.collect(), key=lambda r: r.part):
        rows.append((*r, base))
        base += r.n_tokens
    return spark.createDataFrame(rows, "file string, part int, n_docs long, n_tokens long, n_bytes long, base long")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{file}.idx") as side:
                    index = np.frombuffer(side.read(), INDEX_TYPE)
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with fs.open_input_file(f"{root}/{file}") as data:
                    head = data.read(len(MAGIC) + 1)
                    if head[:-1] != MAGIC:
                        raise ValueError(f"{file} is no token file")
                    kind = np.dtype("<u4" if head[-1] == 4 else "<u2")
                    for k, (at, payload) in enumerate(read_frames(data)):
                        doc_id, known = struct.unpack_from("<qB", payload)
                        ids = np.frombuffer(payload, kind, offset=9)
                        if index["offset"][k] != at or index["n_tokens"][k] != len(ids):
                            raise ValueError(f"{file}: index and data differ at record {k}")
                        rows["doc_id"].append(doc_id if known else None)
                        rows["start"].append(base + int(index["start"][k]))
                        rows["n_tokens"].append(len(ids))
                        rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        if len(rows["doc_id"]) == 4096:
                            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})
                            rows = {c: [] for c in rows}
                    if k + 1 != len(index):
                        raise ValueError(f"{file}: the index has {len(index)} records, the data {k + 1}")
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    return read


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: (doc_id, start, n_tokens, ids_crc32); checks every checksum and the index."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "file").mapInArrow(frugal(_reader(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """Encode all of ``documents``, write the files in doc_id order and read them back."""
    folder = fresh_path(spark, "tokens")
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
