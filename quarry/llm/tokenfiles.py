"""Token-id files: independent zstandard frames with a trailing seek table.

File layout (all integers little-endian):

* data frames: each an independent zstd frame holding the uint32 token ids of whole documents,
  about ``frame_ids`` ids per frame (one long document may make a longer frame);
* one zstd frame with the document table: ``(doc_id int64, frame uint32, at uint32, n uint32, null
  uint8)`` per document, ``at`` and ``n`` counted in ids inside the frame;
* a skippable frame (magic 0x184D2A5E) with the seek table of the zstd seekable format: per frame
  its compressed size, decompressed size and the low 32 bits of the content's XXH64, then the
  footer ``n_frames uint32, descriptor uint8, magic 0x8F92EAB1``.

A plain zstd decoder can read such a file from front to back; :func:`read_documents` fetches the
tail and then only the frames that hold the documents asked for, checking their checksums.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import fresh_dir, partitions_for, text_batches, worker_state

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY, FOOTER = "<III", "<IBI"
ENTRY_SIZE, FOOTER_SIZE = struct.calcsize(ENTRY), struct.calcsize(FOOTER)

DOC = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4"), ("null_id", "u1")])
CACHE_WORDS, TEXTS, FILE_MB = 450_000, 32, 256
#: Latin letters: letters to the tokenizer, each already in composed form and lowered to one letter.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts from the ``tokenizers`` library, one library call per new word.

    The tokenizer's rules never join characters across ASCII white space, so the ids of a text are
    the ids of its white-space separated words in order; each new word is encoded by the library and
    its ids are kept as little-endian bytes. A word of plain letters is its own single pre-token, and so
    is a full stop or comma behind it: such words go to the library's model directly, without its regular
    expressions, lowered as it does; all others take its whole pipeline as they stand. At ``CACHE_WORDS`` words the cache becomes the older
    generation, from which words in use are taken over; the generation before it goes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        from tokenizers import normalizers, pre_tokenizers

        # The shortcut needs a tokenizer that lowers its input and maps bytes to characters.
        self.plain = isinstance(self.whole.normalizer, normalizers.Sequence) and "Lowercase" in str(self.whole.normalizer)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.whole.model
        self.tails = {x: self.of_model(x) for x in ".,"}
        self.letters = re.compile(LETTERS)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """One encoder per Python worker, shared by its tasks."""
        kept = worker_state().setdefault("encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        missing = set().union(*split).difference(self.cache)
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache, missing = self.cache, {}, set().union(*split)
        new = []
        for w in missing:
            ids = self.older.get(w)
            if ids is None:
                ids = self.plain_ids(w)
            if ids is None:
                new.append(w)
            else:
                self.cache[w] = ids
        for w, e in zip(new, self.whole.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.cache[w] = np.asarray(e.ids, "<u4").tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, found)) for found in split]

    def plain_ids(self, word: bytes) -> bytes | None:
        """Ids of a word of letters with at most one full stop or comma behind it; None for any other."""
        if not self.plain:
            return None
        text = word.decode("utf-8", "surrogatepass")
        stem, tail = (text[:-1], text[-1]) if text[-1] in ".," else (text, "")
        if not self.letters.fullmatch(stem):
            return None
        stem = stem.lower()
        key = stem.encode()
        own = self.cache.get(key)
        if own is None:
            own = self.cache[key] = self.of_model(stem if stem.isascii() else self.bytes.pre_tokenize_str(stem)[0][0])
        return own + self.tails[tail] if tail else own

    def of_model(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)


class Writer:
    """Collects documents and writes one file."""

    def __init__(self, out, frame_ids: int, level: int = 3):
        self.out, self.frame_bytes = out, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.size = self.written = self.n_ids = 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append((0 if doc_id is None else doc_id, len(self.entries), self.size // 4, len(ids) // 4, doc_id is None))
        self.held.append(ids)
        self.size += len(ids)
        self.n_ids += len(ids) // 4

    def frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.written += len(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.held:
            self.frame(b"".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> int:
        """Write the document table and the seek table; the file's size."""
        self.flush()
        self.frame(np.array(self.docs, DOC).tobytes())
        table = b"".join(struct.pack(ENTRY, *e) for e in self.entries) + struct.pack(FOOTER, len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        return self.written + 8 + len(table)


class Reader:
    """Random access to one open file."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack(FOOTER, self._at(size - FOOTER_SIZE, FOOTER_SIZE))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(size - FOOTER_SIZE - n * ENTRY_SIZE, n * ENTRY_SIZE), "<u4").reshape(n, 3)
        self.entries = table
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.frame(n - 1), DOC)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def frame(self, k: int) -> bytes:
        packed, size, check = map(int, self.entries[k])
        content = self.zstd.decompress(self._at(self.starts[k], packed), max_output_size=size) if size else b""
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids as little-endian uint32) in file order; only frames that hold a wanted one."""
        last, content = -1, b""
        for d in self.docs if wanted is None else self.docs[np.isin(self.docs["doc_id"], list(wanted)) & (self.docs["null_id"] == 0)]:
            if d["frame"] != last:
                last, content = int(d["frame"]), self.frame(int(d["frame"]))
            at = 4 * int(d["at"])
            yield None if d["null_id"] else int(d["doc_id"]), content[at : at + 4 * int(d["n"])]


def _store(uri: str):
    """(file system, path): through Arrow, so that a cluster's own store works as well as a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, frame_ids: int = 65_536, level: int = 3) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into token files under ``path``; returns their manifest.

    Documents go in ascending doc_id (then text) order, range partitioned, one file per non-empty
    partition; nulls in doc_id come first. A null or empty text is the end id alone. Repeated rows are
    kept. A file holds about ``FILE_MB`` MB of text, or less where more shuffle partitions are set. It is written
    under a name of its own attempt and then moved, so that a repeated task replaces it with the same bytes; an
    attempt that fails removes what it wrote, and that of a lost executor is removed at the end. Manifest: file, first_id, n_docs, n_ids, bytes, base (ids in all
    files before).
    """
    text_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context, encoder, writer = TaskContext.get(), Encoder.of_worker(tokenizer), None
        store, root = _store(path)
        name = f"part-{context.partitionId():06d}"
        attempt = f"{root}/_attempt-{name}-{context.taskAttemptId()}"
        try:
            for b in batches:
                for at in range(0, len(b), TEXTS):
                    part = b.iloc[at : at + TEXTS]
                    for doc_id, null, ids in zip(part["doc_id"], part["null_id"], encoder(list(part["text"])), strict=True):
                        if writer is None:
                            store.create_dir(root, recursive=True)
                            out, first = store.open_output_stream(attempt), None if null else int(doc_id)
                            writer = Writer(out, frame_ids, level)
                        writer.add(None if null else int(doc_id), ids + end)
            if writer is not None:
                size = writer.close()
                out.close()
                store.move(attempt, f"{root}/{name}.zst")
        except BaseException:
            if writer is not None:
                out.close()
                store.delete_file(attempt)
            raise
        if writer is not None:
            yield pd.DataFrame({"file": [f"{path}/{name}.zst"], "part": [context.partitionId()], "first_id": pd.array([first], "Int64"), "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "bytes": [size]})

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), F.col("text").cast("string").alias("text"))
    n = partitions_for(docs, "text", FILE_MB)
    dealt = slim.repartitionByRange(n, F.desc("null_id"), "doc_id").sortWithinPartitions(F.desc("null_id"), "doc_id", "text")
    listed = dealt.mapInPandas(encode, "file string, part int, first_id long, n_docs long, n_ids long, bytes long")
    manifest = fresh_dir(docs.sparkSession, "token-manifest")
    listed.write.parquet(manifest)
    _clear_attempts(path)
    # One row per file: the running sum is over the list of files, never over documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return docs.sparkSession.read.parquet(manifest).withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _clear_attempts(path: str) -> None:
    """Remove the unfinished files that lost executors left."""
    from pyarrow import fs

    store, root = _store(path)
    for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("_attempt-"):
            store.delete_file(found.path)


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, ids binary."""

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, base in zip(b["file"], b["base"], strict=True):
                store, at = _store(file)
                with store.open_input_file(at) as source:
                    rows, held, start = [], 0, int(base)
                    for doc_id, ids in Reader(source, source.size()).documents():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 4_000_000:
                            yield _frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows)

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return manifest.select("file", "base").repartition(n).mapInPandas(scan, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def read_documents(file: str, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of the wanted documents of one file; reads the tail and their frames only."""
    store, at = _store(file)
    with store.open_input_file(at) as source:
        return {d: np.frombuffer(ids, "<u4") for d, ids in Reader(source, source.size()).documents(set(wanted)) if d is not None}
