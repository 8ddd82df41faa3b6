"""Token ids in Arrow files of fixed-size lists, for random access without copying.

Documents go in ascending order of their ids; each gets the end id after its own.  The stream of a
file is cut into sequences of ``SEQUENCE`` ids; a file's columns are ``input_ids`` and
``mask``, fixed-size lists of that length, so that sequence i of a batch lies at a known place
of the mapped file.  The last sequence is padded and its mask is false there.  A second
Arrow file beside it says where each document starts.

Documents are dealt by range of their ids; each task writes the files of its range
and returns one row about them.  Those rows are few and numbered in order; tasks that read the files
map them and take slices.

White space cannot be crossed by this tokenizer's words, so a text with single blanks and line ends
is encoded word by word, each distinct word once; any other text is encoded whole.  The ids are the
same, and the tests compare them.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import slices
from parlance.session import materialise, work_dir

SEQUENCE, BATCH = 1024, 64
END = 0
#: Words of which an encoder remembers the ids, in each of two generations.
REMEMBERED = 500_000
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 8 << 20
#: Classes of bytes: 1 blank and line end, 2 other white space, 3 first bytes of other white space, 4 first bytes of special tokens.
BYTES = np.zeros(256, np.uint8)
BYTES[[32, 10]] = 1
BYTES[[9, 11, 12, 13, 28, 29, 30, 31]] = 2
BYTES[[0xC2, 0xE1, 0xE2, 0xE3]] = 3
#: White space beyond ASCII, as UTF-8.
WIDE_SPACE = frozenset(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = BYTES.copy()
        self.bytes[[x[0] for x in self.special if not self.bytes[x[0]]]] = 4
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line = self.whole(["\n"])[0][-1]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lookup(self, units: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        known = self.known
        if len(known) > REMEMBERED:
            self.older, self.known = known, {}
            known = self.known
        missing = [u for u in units if u not in known]
        if self.older:
            known.update((u, self.older[u]) for u in missing if u in self.older)
            missing = [u for u in missing if u not in known]
        # a line end is an id of its own between words, so many words go in one text
        groups = [missing[a : a + 1_000] for a in range(0, len(missing), 1_000)]
        for group, ids in zip(groups, self.whole(["\n".join(g) + "\n" for g in groups])):
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(group):
                raw, width = ids.tobytes(), ids.itemsize
                known.update(zip(group, [raw[a:b] for a, b in zip([0, *((ends[:-1] + 1) * width).tolist()], (ends * width).tolist())]))
            else:
                known.update(zip(group, [x.tobytes() for x in self.whole(group)]))
        return [known[u] for u in units]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a text's white space is single blanks and line ends between words, places of all blanks and line ends)."""
        kind = self.bytes[data]
        places = np.flatnonzero(kind)
        kind = kind[places]
        blanks = places[kind == 1]
        odd = [places[kind == 2], blanks[1:][np.diff(blanks) == 1], blanks[np.isin(blanks, offsets) | np.isin(blanks + 1, offsets)]]
        for i in places[kind >= 3].tolist():
            piece = data[i : i + 3].tobytes()
            if piece[:2] in WIDE_SPACE or piece in WIDE_SPACE or any(data[i : i + len(x)].tobytes() == x for x in self.special):
                odd.append(np.array([i]))
        plain = np.diff(offsets) > 0
        plain[np.searchsorted(offsets, np.concatenate(odd), "right") - 1] = False
        return plain, blanks

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text), nulls as empty texts, without end ids."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
        plain, blanks = self._plain(data, offsets - offsets[0])
        at = np.flatnonzero(~plain)
        if len(at):
            others = self.whole([texts[int(i)].as_py() for i in at])
            ids, lengths = self.encode(texts.filter(pa.array(plain))) if plain.any() else (np.empty(0, self.dtype), np.empty(0, np.int64))
            ends, sizes = np.cumsum(lengths), np.zeros(len(texts), np.int64)
            sizes[plain], sizes[at] = lengths, [len(x) for x in others]
            pieces: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
            for i, a, b in zip(np.flatnonzero(plain), ends - lengths, ends):
                pieces[i] = ids[a:b]
            for i, x in zip(at, others):
                pieces[i] = x
            return np.concatenate(pieces), sizes
        offsets = offsets - offsets[0]
        # words lie between blanks; they are copied together without them
        firsts = np.sort(np.concatenate([offsets[:-1], blanks + 1]))
        joined = data[self.bytes[data] != 1]
        gone = np.searchsorted(blanks, firsts, "left")
        bounds = np.append(firsts - gone, len(joined)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(bounds), pa.py_buffer(joined))
        starts = np.searchsorted(firsts, offsets[:-1])
        before = np.zeros(len(firsts), np.int64)  # 0: first of its text, 1 after a blank, 2 after a line end
        inner = np.ones(len(firsts), bool)
        inner[starts] = False
        before[inner] = np.where(data[firsts[inner] - 1] == 32, 1, 2)
        coded = words.dictionary_encode()
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 3 + before
        seen = np.zeros(3 * len(coded.dictionary), bool)
        seen[key] = True
        keys = np.concatenate([np.flatnonzero(seen[k::3]) * 3 + k for k in range(3)])
        number = np.empty(len(seen), np.int64)
        number[keys] = np.arange(len(keys))
        which = number[key]
        names = coded.dictionary.to_pylist()
        # the first words of texts, then those after a blank, then those after a line end, whose id goes before theirs
        cut, line = np.searchsorted(keys % 3, [1, 2]), self.line.tobytes()
        own = (keys // 3).tolist()
        known = self._lookup([*(names[k] for k in own[: cut[0]]), *(f" {names[k]}" for k in own[cut[0] : cut[1]]), *(names[k] for k in own[cut[1] :])])
        known[cut[1] :] = [line + x for x in known[cut[1] :]]
        size = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.dtype).itemsize
        first, pool = np.cumsum(size) - size, np.frombuffer(b"".join(known), self.dtype)
        n = size[which]
        ends = np.cumsum(n)
        out = pool[np.repeat(first[which] - (ends - n), n) + np.arange(int(ends[-1]))]
        return out, np.add.reduceat(n, starts)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    fs, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return (pa.fs.LocalFileSystem(use_mmap=True), at) if isinstance(fs, pa.fs.LocalFileSystem) else (fs, at)


class SequenceFile:
    """Writes a stream of ids as batches of fixed-size lists."""

    def __init__(self, path: str, dtype, sequence: int = SEQUENCE, batch: int = BATCH):
        self.sequence, self.room, self.dtype = sequence, sequence * batch, dtype
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        fs, at = _store(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(at)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def _put(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.sequence) * self.sequence
        full, mask = np.zeros(n, self.dtype), np.zeros(n, bool)
        full[: len(ids)], mask[: len(ids)] = ids, True
        self.writer.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(full), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.room:
            whole = np.concatenate(self.held)
            cut = len(whole) // self.room * self.room
            for a in range(0, cut, self.room):
                self._put(whole[a : a + self.room])
            self.held, self.size = [whole[cut:]], len(whole) - cut

    def close(self) -> None:
        if self.size:
            self._put(np.concatenate(self.held))
        self.writer.close()
        self.out.close()


class SequenceReader:
    """Slices of a mapped file by position; ``mask`` and ``input_ids`` of a sequence are views."""

    def __init__(self, path: str):
        fs, at = _store(path)
        self.file = pa.ipc.open_file(fs.open_input_file(at))
        self.sequence = self.file.schema.field("input_ids").type.list_size
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.starts = np.cumsum([0, *(b.num_rows * self.sequence for b in self.batches)])

    def row(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence ``i``; the ids are a view of the file."""
        k = int(np.searchsorted(self.starts, i * self.sequence, "right")) - 1
        j = i - int(self.starts[k]) // self.sequence
        return (self.batches[k].column("input_ids").flatten().to_numpy()[j * self.sequence : (j + 1) * self.sequence],
                self.batches[k].column("mask")[j].values)

    def ids(self, start: int, n: int) -> np.ndarray:
        out, end = [], start + n
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        while start < end:
            stop = min(end, int(self.starts[k + 1]))
            out.append(self.batches[k].column("input_ids").flatten().to_numpy()[start - self.starts[k] : stop - self.starts[k]])
            start, k = stop, k + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)

    def valid(self) -> int:
        return sum(pc.sum(b.column("mask").flatten()).as_py() or 0 for b in self.batches)


FILES = "part int, path string, tokens long, docs long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, sequence: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    # each attempt has files of its own; only those of the attempt whose row is kept count
    part = TaskContext.get().partitionId()
    path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex[:12]}"
    enc, out, index, total, docs = encoder(tokenizer), None, None, 0, 0
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    for batch in slices(batches, limit=ENCODE_BYTES):
        if out is None:
            out = SequenceFile(f"{path}.arrow", enc.dtype, sequence)
            fs, at = _store(f"{path}.index.arrow")
            sink = fs.open_output_stream(at)
            index = pa.ipc.new_file(sink, schema)
        ids, lengths = enc.encode(batch.column("text"))
        stops = np.cumsum(lengths)
        full = np.insert(ids, stops, END)
        starts = total + stops - lengths + np.arange(len(lengths))
        index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(lengths + 1, pa.int64())], schema=schema))
        out.add(full)
        total, docs = total + len(full), docs + len(lengths)
    if out is not None:
        out.close()
        index.close()
        sink.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([total], pa.int64()), pa.array([docs], pa.int64())],
                              names=["part", "path", "tokens", "docs"])


def write_ids(docs: DataFrame, folder: str, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text) below ``folder``; (part, path, tokens, docs, first) of each, in order of part.

    Null texts are empty and have the end id alone; null ids come first; rows that repeat an id are
    ordered by their text's hash.  An empty table writes nothing.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = slim.withColumn("_h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    made = materialise(ordered.mapInArrow(lambda it: _write(it, folder, tokenizer, sequence), FILES), "ids-files")
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return materialise(made.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "ids-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, tokens in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), batch.column("tokens").to_pylist()):
            reader = SequenceReader(f"{path}.arrow")
            if reader.valid() != tokens:
                raise ValueError(f"{path}: {reader.valid()} ids where {tokens} were written")
            fs, at = _store(f"{path}.index.arrow")
            index = pa.ipc.open_file(fs.open_input_file(at))
            for i in range(index.num_record_batches):
                b = index.get_batch(i)
                starts, sizes = b.column("start").to_pylist(), b.column("n_tokens").to_pylist()
                crc = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                yield pa.record_batch([b.column("doc_id"), pc.add(b.column("start"), pa.scalar(first, pa.int64())), b.column("n_tokens"),
                                       pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files that ``write_ids`` named."""
    files = max(1, manifest.count())
    return manifest.repartition(files, "part").select("path", "first", "tokens").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_ids(write_ids(docs, work_dir(docs.sparkSession, "token-ids"), tokenizer))
