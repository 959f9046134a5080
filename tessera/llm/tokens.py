"""Token ids as flat binary files.

Documents are range-partitioned by id, so partition order is id order. A task encodes its documents
and streams three flat little-endian files: the ids (unsigned 16 or 32 bits), the document offsets
(unsigned 64 bits, one more than documents) and the document ids (signed 64 bits). A manifest row
for each part goes to Parquet; the part's base comes from the prefix sum of the parts before it.
Files have a name of the attempt, which the manifest row holds: of a repeated task, the attempt that Spark
commits is the one that is read. Readers map the files into memory.
"""

from __future__ import annotations

import json
import math
import os
import sys
import threading
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, cut, fresh_path, give_back, read_table

END_ID = 2
#: Bytes of words and ids, with what Python adds for each, that a worker remembers before it starts afresh; longer words
#: than LONG characters are never kept. Both bound memory, not results.
REMEMBERED, EACH, LONG = 110 << 20, 200, 48
#: Seconds after a task for which a worker that gets no other keeps its encoder.
KEPT_S = 5.0
#: Bytes of text that are cut into pieces together, bytes of new pieces that go to the library together, pieces whose ids are
#: copied together, and documents that are taken from Arrow together.
TOGETHER, STREAMED, JOINED, ROWS = 2 << 20, 1 << 18, 1 << 18, 8192
#: Bytes of text in a part: as many as give each core one part, within these limits.
PART_BYTES = (4 << 20, 32 << 20)
#: Marks at which a word is cut when they follow a letter.
MARKS = ".,;:!?$&*%#"
#: Pieces that the library's pattern leaves whole, wherever they stand: letters that need no look at a Unicode table, or marks.
PLAIN = rf"^(?: ?(?:[A-Za-z\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{27F}}\x{{400}}-\x{{47F}}]+|[{MARKS}]+)|\n)$"
#: Parts whose prefix sums one task makes.
BLOCK_PARTS = 4096
MANIFEST = "part long, path string, docs long, ids long, bits long, null_docs long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def by_words(tokenizer) -> bool:
    """True if a tokenizer is byte-level BPE with the usual pattern, without a normaliser, and its added tokens hold no white space or marks, and more than letters."""
    told = json.loads(tokenizer.to_str())
    cut, model = told["pre_tokenizer"] or {}, told["model"]
    plain = told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    plain = plain and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"]
    added = [t["content"] for t in told["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
    return bool(plain) and len(added) == len(told["added_tokens"]) and not any(t.isalpha() or any(c.isspace() or c in MARKS for c in t) for t in added)


def _table(chars: bytes) -> np.ndarray:
    """For each byte whether it is one of these."""
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


#: White space of one byte, first bytes of what may be longer white space, marks, letters of one byte, and first bytes of letters of two.
BLANK, BLANKS, MARK = _table(b"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f "), _table(b"\xc2\xe1\xe2\xe3"), _table(MARKS.encode())
LETTER, LETTERS = _table(bytes([*range(65, 91), *range(97, 123)])), _table(bytes([*range(0xC3, 0xCA), 0xD0, 0xD1]))


def _white(b: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether it is of a white space character."""
    white = BLANK[b]
    at = np.flatnonzero(BLANKS[b])
    if len(at):
        first, second, third = b[at].astype(np.int32), *(b[np.minimum(at + k, len(b) - 1)] for k in (1, 2))
        two = first << 8 | second
        three = two << 8 | third
        white[np.add.outer(at[(two == 0xC285) | (two == 0xC2A0)], range(2))] = True
        wide = (three >= 0xE28080) & (three <= 0xE2808B) | np.isin(three, (0xE19A80, 0xE1A08E, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
        white[np.add.outer(at[wide], range(3))] = True
    return white


def _cuts(b: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8, and for the end, whether a piece may begin there. What is left and right of it does not depend on what else stands there."""
    cut = np.zeros(len(b) + 1, bool)
    seen, mid = ~_white(b), b[1:-1]
    alone = seen[:-2] & seen[2:]
    cut[1:-2] = alone & (mid == 32)
    line = alone & (mid == 10)
    cut[1:-2] |= line
    cut[2:-1] |= line
    at = np.flatnonzero(MARK[b[1:]]) + 1
    last, lead = b[at - 1], b[np.maximum(at - 2, 0)]
    times = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7))  # between the letters of Latin-1
    cut[at[LETTER[last] | (last >= 0x80) & LETTERS[lead] & ~times]] = True
    return cut


def _pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of all texts one after the other, and before how many of them each text begins, with the end."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(ends[0], ends[-1] - ends[0])
    cut, ends = _cuts(np.frombuffer(data, np.uint8)), ends - ends[0]
    cut[ends] = True
    at = np.flatnonzero(cut)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), data), np.searchsorted(at, ends)


class WordwiseEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, remembering words.

    Such a tokenizer never joins what a single space between two visible characters parts, so a text's ids are
    the ids of its words, each with the space before it. Nor does it join a letter and the mark after it, or
    anything with a single line end between visible characters: words are cut there too. Where white space meets
    white space there is no cut. Many texts are cut at once, as bytes, and each distinct piece is looked up once
    for all its places; it goes through the library once in a while. New pieces of letters or of marks alone
    go there as one text, spelt in the vocabulary's characters, so that the library needs no pattern for them; the bytes
    that each token stands for tell where pieces end. Others go one by one. The ids are the same as for whole texts
    (see the tests). A tokenizer that is not of that kind, by its own description, gets whole texts.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wordwise = by_words(self.tokenizer)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.bare = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # In a byte-level vocabulary each character stands for one byte; a byte that shows nothing has the next spare character.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        spare = iter(range(256, 512))
        self.shown = np.array([b if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else next(spare) for b in range(256)], "<u4")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _each(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece or text, by itself."""
        return [np.asarray(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _streamed(self, pieces: pa.StringArray) -> list[bytes]:
        """As _each() for PLAIN pieces, in one call. The array has no offset."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[1 : len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: ends[-1]]
        text = np.insert(self.shown[data], ends[:-1], 32).tobytes().decode("utf-32-le")
        ids = np.asarray(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
        reached = np.cumsum(self.width[ids])
        after = np.searchsorted(reached, ends) + 1
        if after[-1] != len(ids) or (reached[after - 1] != ends).any():
            return self._each(pieces.to_pylist())
        packed, at = ids.tobytes(), (after * self.type.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def _found(self, pieces: pa.StringArray) -> list[bytes]:
        """The packed ids of distinct pieces. New ones are remembered from now on, if they are not too long."""
        words, size = pieces.to_numpy(zero_copy_only=False).tolist(), pc.binary_length(pieces).to_numpy()
        found = list(map(self.known.get, words))
        new = np.flatnonzero([x is None for x in found])
        plain = pc.match_substring_regex(pieces.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False)
        for at, way in ((new[plain], self._streamed), (new[~plain], lambda some: self._each(some.to_pylist()))):
            turn = np.cumsum(size[at]) // STREAMED
            for some in np.split(at, np.flatnonzero(np.diff(turn)) + 1) if len(at) else ():
                for i, packed in zip(some.tolist(), way(pieces.take(pa.array(some))), strict=True):
                    found[i], w = packed, words[i]
                    if len(w) <= LONG:
                        self.known[w] = packed
                        self.held += EACH + len(w) + len(packed)
        return found

    def encode(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """The packed ids of each text, none of which is null."""
        if not self.wordwise:
            return self._each(texts if isinstance(texts, list) else texts.to_pylist())
        if not len(texts):
            return []
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        pieces, begins = _pieces(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        distinct, width = pieces.dictionary_encode(), self.type.itemsize
        found, places = self._found(distinct.dictionary), distinct.indices.to_numpy()
        flat = np.frombuffer(b"".join(found), self.type)
        count = np.fromiter(map(len, found), np.int32, len(found)) // width
        many = count[places]
        reached = np.concatenate(([0], np.cumsum(many, dtype=np.int64)))
        shift = (np.cumsum(count, dtype=np.int64) - count)[places] - reached[:-1]
        out = []
        for lo in range(0, len(places), JOINED):
            hi = min(lo + JOINED, len(places))
            out.append(flat[np.repeat(shift[lo:hi], many[lo:hi]) + np.arange(reached[lo], reached[hi])].tobytes())
        ids, at = b"".join(out), (reached[begins] * width).tolist()
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _kept() -> dict:
    """What this Python worker keeps between tasks. Functions that are sent by value get their module's names anew in each task, so a module of the worker's own holds it."""
    return vars(sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")))


def worker_encoder(vocabulary: str, job: str) -> WordwiseEncoder:
    """This Python worker's encoder. Spark gives a worker task after task: the vocabulary is read once, and a job's words stay known until another job, or until leave_encoder()'s time is over."""
    held = _kept()
    if "timer" in held:
        held["timer"].cancel()
    encoder = held.get(vocabulary) or WordwiseEncoder(vocabulary)
    if held.get("job") != job:
        encoder.known.clear()
        encoder.held = 0
    held.update({vocabulary: encoder, "job": job})
    return encoder


def leave_encoder() -> None:
    """At a task's end: if no other follows in KEPT_S seconds, the encoder and its words go. Spark keeps idle workers for other queries, beside whose memory theirs would count."""

    def forget() -> None:
        held.clear()  # a task that just began has its encoder, and goes on with it
        give_back()

    held = _kept()
    if "timer" in held:
        held["timer"].cancel()
    held["timer"] = threading.Timer(KEPT_S, forget)
    held["timer"].daemon = True
    held["timer"].start()


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _mapped(path: str, kind: str) -> np.ndarray:
    store, at = _store(path)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(at, kind, "r") if os.path.getsize(at) else np.empty(0, kind)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _groups(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Runs of texts of about TOGETHER bytes."""
    ends, lo = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1], 0
    while lo < len(texts):
        hi = min(max(int(np.searchsorted(ends, int(ends[lo]) + TOGETHER, "right")) - 1, lo + 1), len(texts))
        yield texts.slice(lo, hi - lo)
        lo = hi


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, parts: int | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files below path and returns their manifest, read back from path/manifest.

    A null text counts as empty: its document has the end id alone. Repeated ids are kept, ordered by
    text; null ids come first. An empty table writes no parts. Other columns are not read.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    store, at = _store(path)
    store.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, at = _store(path)
        stem, encoder, streams = f"part-{part:08d}-{uuid.uuid4().hex}", None, []
        n = total = nulls = 0
        try:
            for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
                if encoder is None:
                    encoder = worker_encoder(vocabulary, path)
                    streams = [store.open_output_stream(f"{at}/{stem}.{kind}") for kind in ("ids", "offsets", "docs")]
                    streams[1].write(bytes(8))
                end, width = np.asarray([end_id], encoder.type).tobytes(), encoder.type.itemsize
                names = batch.column(0).to_pylist()
                nulls += names.count(None)
                streams[2].write(np.asarray([doc or 0 for doc in names], "<i8").tobytes())
                for texts in _groups(batch.column(1).cast(pa.string())):
                    packed = encoder.encode(texts.fill_null(""))
                    ends = total + np.cumsum([len(x) // width + 1 for x in packed])
                    streams[0].write(end.join(packed) + end)
                    streams[1].write(ends.astype("<u8").tobytes())
                    n, total = n + len(texts), int(ends[-1])
        finally:
            for s in streams:
                s.close()
            if encoder is not None:
                leave_encoder()
            pa.default_memory_pool().release_unused()
        if encoder is not None:
            made = {"part": part, "path": f"{path}/{stem}", "docs": n, "ids": total, "bits": encoder.type.itemsize * 8, "null_docs": nulls}
            yield pa.RecordBatch.from_pylist([made])

    ordered = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    if parts is None:
        size = ordered.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
        parts = max(1, math.ceil(size / min(max(size / spark.sparkContext.defaultParallelism, PART_BYTES[0]), PART_BYTES[1])))
    dealt = ordered.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the ids of all parts before: prefix sums inside blocks of parts and over the blocks."""
    block = F.floor(F.col("part") / BLOCK_PARTS).alias("block")
    rows = manifest.select("*", block)
    totals = rows.groupBy(F.col("block").alias("b")).agg(F.sum("ids").alias("total"))
    earlier = F.coalesce(F.sum("total").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = rows.withColumn("within", within).join(totals.select("b", earlier.alias("earlier")), F.col("block") == F.col("b"))
    based = based.select(*manifest.columns, (F.col("within") + F.col("earlier")).cast("long").alias("base"))
    return cut(based.repartitionByRange(max(1, manifest.count()), "part"), "token-bases")


def read_token_files(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files that `parts` (with_bases()) lists, one part at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets, names = _mapped(r["path"] + ".ids", f"<u{r['bits'] // 8}"), _mapped(r["path"] + ".offsets", "<u8"), _mapped(r["path"] + ".docs", "<i8")
                for lo in range(0, len(names), 4096):
                    hi = min(lo + 4096, len(names))
                    at = offsets[lo : hi + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                    null = np.arange(lo, hi) < r["null_docs"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(names[lo:hi], np.int64), mask=null), pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(parts: DataFrame) -> DataFrame:
    """(doc_id, ids) from the files that `parts` (with_bases()) lists: the documents' token ids, the end id included, in the files' order.

    A document whose text was null or empty has the end id alone; a null id comes back as null; repeated rows come back each; without parts there are no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, at, names = _mapped(r["path"] + ".ids", f"<u{r['bits'] // 8}"), _mapped(r["path"] + ".offsets", "<u8").astype(np.int64), _mapped(r["path"] + ".docs", "<i8")
                for k, name in enumerate(names):
                    yield pa.RecordBatch.from_arrays([pa.array([None if k < r["null_docs"] else int(name)], pa.int64()), pa.array([ids[at[k] : at[k + 1]].astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return parts.mapInArrow(read, "doc_id long, ids array<long>")


def tokenized(docs: DataFrame, **options) -> DataFrame:
    """Writes docs' token files to a new path in the shared folder and returns what reading them back gives.

    Null texts and ids, repeated rows and empty tables are as for write_token_files(); other columns are not read.
    """
    return read_token_files(with_bases(write_token_files(docs, fresh_path(docs.sparkSession, "tokens"), **options)))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(read_table(spark, sf_dir, "documents"))
