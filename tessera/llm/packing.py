"""Best-fit packing of token pieces into sequences of one capacity, planned on a histogram of lengths.

Documents are encoded and cut where they are longer than a sequence; a task also tells each piece's rank among its own pieces
of the same length. Only the number of pieces of each length, at most `capacity` numbers, reaches the driver. There best fit runs
over the counts, longest first: all bins with the same room form groups, and a step puts as many pieces of one length as fit into all bins of a group.
The plan is a list of such steps. A piece finds its place by its length and its rank within that length, which is its rank in
its task plus what earlier tasks hold of that length; so pieces are never sorted or moved.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, cut, looked_up, read_table
from .tokens import EACH, LONG, REMEMBERED

CAPACITY, END_ID = 4096, 1
#: Characters of a text that are cut into words together.
SLICE = 1 << 18
#: Marks at a word's end that are a token group of their own.
MARKS = ".,;:!?$&*%#"
#: The only normaliser and the word pattern that WordEndEncoder takes apart.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_word_ends(tokenizer) -> bool:
    """True if white space only parts words and is dropped, and a word's last token has a word end, by the tokenizer's own description."""
    told = json.loads(tokenizer.to_str())
    norm, cutter, model = told["normalizer"] or {}, told["pre_tokenizer"] or {}, told["model"]
    steps, cuts = norm.get("normalizers", []), cutter.get("pretokenizers", [])
    plain = [s["type"] for s in steps] == NORMALIZERS and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
    plain = plain and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": PATTERN} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    plain = plain and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"] and model["type"] == "BPE" and model["end_of_word_suffix"] and not model["dropout"]
    return bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in told["added_tokens"])


#: True for text of letters from Latin-1 and Latin Extended-A, but for the one that lower-cases to two characters; they are in composed form.
_PLAIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")


def is_plain(word: str) -> bool:
    return word.isascii() or _PLAIN.fullmatch(word) is not None


class WordEndEncoder:
    """Encodes texts word by word with a tokenizer that drops white space, remembering words.

    New words of letters go through the library as one text: each gives exactly one token with a word end, which tells where the next begins. Words of plain
    Latin letters are lower-cased and spelt in the vocabulary's bytes here, so that the library needs neither normaliser nor pattern for them. Should
    the word ends not be as many as the words (letters that lower-case to a letter and a mark), all go one by one. Other words are encoded each for
    itself. The ids are the same as for whole texts (see the tests); a tokenizer of another kind gets whole texts.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wordwise = by_word_ends(self.tokenizer)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.wordwise:
            told = json.loads(self.tokenizer.to_str())
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(told["model"]["end_of_word_suffix"])
            bare = told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            spare = iter(range(256, 512))  # in a byte-level vocabulary a byte that shows nothing stands as the next spare character
            self.shown = {b: b if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else next(spare) for b in range(256)} | {32: 32}
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _letters(self, words: list[str], plain: bool) -> list[bytes]:
        if not words:
            return []
        text = " ".join(words)
        if plain:
            text = text.lower().encode().decode("latin-1").translate(self.shown)
        ids = np.asarray((self.bare if plain else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        packed, at = ids.tobytes(), (ends * self.type.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def _learn(self, words: set[str]) -> None:
        known, plain, odd, marked, others = self.known, set(), [], [], []
        for w in words:
            stem = w.rstrip(MARKS)
            if not stem.isalpha():
                others.append(w)
            elif not is_plain(stem):
                (odd if len(stem) == len(w) else others).append(w)
            elif len(stem) == len(w):
                plain.add(w)
            else:
                marked.append((w, stem, w[len(stem) :]))
        plain.update(stem for _, stem, _ in marked)
        plain = [w for w in plain if w not in known]
        others += {m for _, _, m in marked if m not in known and m not in words}
        known.update(zip(plain, self._letters(plain, True), strict=True))
        known.update(zip(odd, self._letters(odd, False), strict=True))
        known.update(zip(others, self._each(others), strict=True))
        known.update((w, known[stem] + known[m]) for w, stem, m in marked)
        self.held += sum(EACH + len(w) + len(known[w]) for w in (*plain, *odd, *others)) + sum(EACH + 2 * len(w) for w, _, _ in marked)

    def _slices(self, text: str) -> Iterator[str]:
        """The text in slices that end at a space, a few at least."""
        lo = 0
        while len(text) - lo > SLICE:
            hi = text.rfind(" ", lo, lo + SLICE)
            hi = text.find(" ", lo + SLICE) if hi <= lo else hi
            if hi < 0:
                break
            yield text[lo:hi]
            lo = hi + 1
        yield text[lo:] if lo else text

    def encode(self, text: str) -> bytes:
        """A text's packed ids."""
        if not self.wordwise:
            return self._each([text])[0]
        out = []
        for part in self._slices(text):
            words = part.replace("\n", " ").split(" ")
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
                continue
            except KeyError:
                pass
            if self.held > REMEMBERED:
                self.known, self.held = {"": b""}, 0
            new = set(words).difference(self.known)
            self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, words)))
            for w in new:
                if len(w) > LONG:
                    self.held -= EACH + len(w) + len(self.known.pop(w))
        return b"".join(out)


def worker_encoder(vocabulary: str, job: str) -> WordEndEncoder:
    """This Python worker's encoder; a job's words stay known until another job. Functions sent by value get their module's names anew in each task, so a module of the worker's own holds it."""
    held = vars(sys.modules.setdefault("_piece_encoders", types.ModuleType("_piece_encoders")))
    if held.get("job") != (vocabulary, job):
        held["encoder"], held["job"] = WordEndEncoder(vocabulary), (vocabulary, job)
    return held["encoder"]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): every document's pieces of at most `capacity` tokens, its end id included.

    part and place: the piece's rank among the pieces of its length in its part. ids: with the ids themselves, as unsigned 32-bit
    little-endian bytes. A null text counts as empty: it has the end id alone. Rows without id and repeated rows have pieces of their own.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    vocabulary, job = vocabulary or vocabulary_path(), uuid.uuid4().hex
    names = PIECES.replace(" long", "").replace(" int", "").split(", ") + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        encoder = None
        for batch in batches:
            encoder = encoder or worker_encoder(vocabulary, job)
            end, width = np.asarray([end_id], encoder.type).tobytes(), encoder.type.itemsize
            step, out, held = capacity * width, [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = encoder.encode(text.as_py() or "") + end
                for k, lo in enumerate(range(0, len(packed), step)):
                    wide = np.frombuffer(packed[lo : lo + step], encoder.type).astype("<u4").tobytes()
                    n = len(wide) // 4
                    out.append((doc, k, k * capacity, n, zlib.crc32(wide), part, seen[n], *([wide] * ids)))
                    seen[n] += 1
                    held += len(wide) * ids
                if held > 32 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], _schema(ids))
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _schema(ids), strict=True)], schema=_schema(ids)) if out else pa.RecordBatch.from_pylist([], _schema(ids))

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * ids)


def _schema(ids: bool) -> pa.Schema:
    kinds = {"piece": pa.int32()}
    return pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in PIECES.split(", ")] + [("ids", pa.binary())] * ids)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over the number of pieces of each length: (steps, number of sequences).

    A step (length, first, per, sequence, offset): pieces of a length from rank `first` to the next step's take places, `per` in each of
    the sequences from `sequence` on, from `offset` on. Pieces of one length that fit a bin follow each other there: after one, that bin has the least room that still fits.
    There are at most three groups of bins for each length, and a group meets a length once, so the number of steps depends on the capacity, not on the data.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    free, made, steps = 0, 0, []  # free: bit r is set if there are bins with room r

    def keep(room: int, first: int, n: int) -> None:
        nonlocal free
        if room and n:
            rooms.setdefault(room, []).append((first, n))
            free |= 1 << room

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"no piece of {length} tokens fits into {capacity}")
        while left:
            fits = free >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, n = rooms[room].pop()
                if not rooms[room]:
                    free &= ~(1 << room)
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            for per in (min(left, room // length), left % (room // length)):
                bins = min(n, left // per) if per else 0
                if bins:
                    steps.append((length, rank, per, first, capacity - room))
                    keep(room - per * length, first, bins)
                    rank, left, first, n = rank + per * bins, left - per * bins, first + bins, n - bins
            keep(room, first, n)
    return steps, made


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table with length, part and place) with sequence_id and offset. An empty table gives no rows."""
    shares = cut(found.groupBy("part", "length").agg(F.count("*").alias("pieces")), "lengths")
    counts = {r[0]: r[1] for r in shares.groupBy("length").agg(F.sum("pieces")).collect()}  # at most `capacity` lengths
    steps, _ = best_fit(counts, capacity)
    length, first, per, sequence, offset = np.array(steps, np.int64).reshape(-1, 5).T.copy()
    by = np.lexsort((first, length))
    length, first, per, sequence, offset = (x[by] for x in (length, first, per, sequence, offset))
    key = (length << 48) + first
    earlier = F.coalesce(F.sum("pieces").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cut(shares.select("part", "length", earlier.cast("long").alias("before")), "bases")
    kept = [c for c in found.columns if c not in ("part", "place")]
    ranked = looked_up(found, bases, ["part", "length"], spread=1).select(*kept, (F.col("before") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (size << 48) + rank, "right") - 1
            nth = rank - first[at]
            made = [pa.array(sequence[at] + nth // per[at]), pa.array(offset[at] + nth % per[at] * size)] if batch.num_rows else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, "sequence_id", "offset"])

    kinds = dict(found.dtypes)
    return ranked.mapInArrow(place, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "sequence_id bigint", "offset bigint"]))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, ids: bool = False, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), with `ids` if asked for: every piece of every document and its place.

    Nulls, repeated rows and empty tables are as for pieces(); other columns are not read.
    """
    return packed(cut(pieces(docs, capacity, ids=ids, **options), "pieces"), capacity)


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, offsets) from packed_documents(ids=True): the sequences to train on. A sequence has at most `capacity` pieces."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    found = placed_pieces.groupBy("sequence_id").agg(rows.alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda acc, r: F.concat(acc, r["ids"]))
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + r["length"])
    return found.select("sequence_id", total.alias("n_tokens"), ids.alias("ids"), F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"), F.transform("rows", lambda r: r["offset"]).alias("offsets"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))
