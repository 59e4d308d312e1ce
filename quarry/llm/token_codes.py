"""Token ids in directly addressable codes.

Format: the ids of all documents, in ascending document order, form one sequence. It is stored as
segments (one binary value each, rows of a parquet table in the shared store, written by Spark's
committer). A segment splits each id into chunks of ``BITS`` bits: level 0 holds the lowest chunk of
every id, and one bit for each id tells whether the id continues in level 1, and so on. A rank
directory (ones before each 512-bit block of a bitmap) leads from a place in one level to the place
in the next, so any id is read in O(levels) without decoding its neighbours.

Segment layout, little-endian: 8 bytes magic ``DACSEG01``; uint32 n_docs, uint32 n_levels, uint64
n_ids; n_docs x (int64 doc id, uint8 1 if the id is null, uint64 end offset in ids), stored as three
arrays; then for each level: uint64 entries, uint8 chunks, bitmap (uint64 words), rank directory
(uint32 for each 8 words). Arrays are padded to 8 bytes.

Defined results: null text is empty (only the end id is stored); a null id sorts first; equal ids
are ordered by a hash of the text, then all are kept; an empty table gives no segments; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import arrow_slices, col, give_back, scratch, small_batches

BITS = 8
MAGIC = b"DACSEG01"
#: A segment is closed once it holds this many ids; documents are not split, so a segment is at
#: most this plus one document.
SEGMENT_IDS = 1 << 18
#: Words whose ids a worker remembers in its young memory, and the bytes of these words with their ids;
#: when it is full by either it becomes the old one, from which words in use move back.
CACHE_WORDS = 125_000
CACHE_BYTES = 4 << 20
#: Bytes of an Arrow batch here: workers and the JVM's buffers hold several at a time.
BATCH_BYTES = 1 << 20
#: Words that one call to the library encodes.
CALL_WORDS = 100
SEPARATOR = "<|endoftext|>"
#: A word up to its last ASCII (or Latin-1) small letter or digit, and the ASCII punctuation after it,
#: without apostrophes, which pre-tokenizers may join to letters.
TAIL = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf]))[!-&(-/:-@\[-`{-~]+", re.S)
#: The commonest tails: a comma or full stop between such a letter or digit and white space.
COMMON_TAIL = re.compile(rb"[,.](?=[ \n])(?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))")
#: The ASCII and Latin-1 small letters, and a word of them only.
SMALL = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
LETTERS = re.compile(rb"(?:[a-z]+|\xc3[\x9f-\xb6\xb8-\xbf])+")


class _Memory(dict):
    """Words with their ids. A missing word is moved here from ``old``; if it is not there either, it
    is noted in ``new`` and has no ids (None) yet. Words are looked up one by one: a difference with
    the memory's keys would walk through all of the memory."""

    def __init__(self, old: dict[bytes, bytes]):
        super().__init__()
        self.old, self.new, self.size = old, set(), 0

    def __setitem__(self, word: bytes, ids: bytes) -> None:
        super().__setitem__(word, ids)
        self.size += len(word) + len(ids)

    def __missing__(self, word: bytes) -> bytes | None:
        ids = self.old.get(word)
        if ids is None:
            self.new.add(word)
        else:
            self[word] = ids
        return ids

    def take_new(self) -> set[bytes]:
        new, self.new = self.new, set()
        return new


class WordEncoder:
    """Ids of whole texts with a tokenizers file whose pre-tokenizer drops white space and never
    joins across it. Texts are cut at ASCII white space, each distinct word is encoded once by the
    library (many words in one call) and remembered. A-Z are lower-cased first only where
    ``lowercase`` says that the tokenizer does so itself; punctuation behind a letter or digit is then
    a word of its own, since it is a pre-token of its own."""

    def __init__(self, path: str, lowercase: bool):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.sep = self.tok.token_to_id(SEPARATOR)
        specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.specials = [s for s in specials if b"<|" not in s]  # all words with <| are encoded apart anyway
        self.lowercase = lowercase
        self.common_tails = lowercase and not any(s.endswith((b",", b".")) for s in specials)
        self.letters, self.last = self._for_letters() if lowercase else (None, None)
        self.old: dict[bytes, bytes] = {}
        self.known = _Memory(self.old)

    def _for_letters(self):
        """The tokenizer's model with nothing before it but a cut at white space, and for each id whether
        it ends a pre-token; for tokenizers that mark those ids and leave small letters as they are, in
        one pre-token (else two None)."""
        from tokenizers import Tokenizer, pre_tokenizers as P
        whole, model = self.tok, self.tok.model
        suffix = getattr(model, "end_of_word_suffix", None)
        tok = Tokenizer(model)
        tok.pre_tokenizer = P.Sequence([P.WhitespaceSplit(), P.ByteLevel(add_prefix_space=False, use_regex=False)])
        if not (suffix and whole.normalizer and whole.pre_tokenizer and whole.normalizer.normalize_str(SMALL) == SMALL
                and whole.pre_tokenizer.pre_tokenize_str(SMALL) == tok.pre_tokenizer.pre_tokenize_str(SMALL)):
            return None, None
        vocab = whole.get_vocab(with_added_tokens=False)
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return tok, last

    def learn(self, words: set[bytes]) -> None:
        """Remember the ids of words. A word that ends in punctuation after a letter or digit is
        two pre-tokens at least, so its ids are those of both parts (where ``lowercase`` holds)."""
        tails = {w: m.end(1) for w in words if not w.isalnum() and self.lowercase and b"<|" not in w and (m := TAIL.fullmatch(w))}
        if tails:
            for w, n in tails.items():
                self.known[w[:n]], self.known[w[n:]]
            words = self.known.take_new().union(w for w in words if w not in tails)
        self._encode_new(words)
        for w, n in tails.items():
            self.known[w] = self.known[w[:n]] + self.known[w[n:]]

    def _encode_new(self, words: set[bytes]) -> None:
        # of small letters: white space between them, cut behind the ids that end a pre-token
        letters = [w for w in words if LETTERS.fullmatch(w)] if self.letters else []
        if letters and self.specials:
            letters = [w for w in letters if not any(s in w for s in self.specials)]
        for i in range(0, len(letters), CALL_WORDS):
            part = letters[i:i + CALL_WORDS]
            ids = self._call(self.letters, " ", part)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._remember(part, ids, ends, 0)
        # others: a special token between them
        words = {w for w in words if w not in self.known}
        plain = [w for w in words if b"<|" not in w]
        if self.specials:
            plain = [w for w in plain if not any(s in w for s in self.specials)]
        for i in range(0, len(plain), CALL_WORDS):
            part = plain[i:i + CALL_WORDS]
            ids = self._call(self.tok, SEPARATOR, part)
            self._remember(part, ids, np.append(np.flatnonzero(ids == self.sep), len(ids)), 1)
        if len(plain) < len(words):
            for w in words.difference(plain):
                ids = self.tok.encode(w.decode(), add_special_tokens=False).ids
                self.known[w] = np.array(ids, "<u4").tobytes()

    @staticmethod
    def _call(tok, between: str, words: list[bytes]) -> np.ndarray:
        text = between.encode().join(words).decode()
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _remember(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        """Words with their ids up to ``ends``, ``skip`` ids standing between two words."""
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep words apart")
        raw, a = ids.astype("<u4").tobytes(), 0
        for w, b in zip(words, (4 * ends).tolist(), strict=True):
            self.known[w] = raw[a:b]
            a = b + 4 * skip

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        if len(self.known) > CACHE_WORDS or self.known.size > CACHE_BYTES:
            self.old, self.known.old = self.known, {}
            self.known = _Memory(self.old)
        cut = pc.ascii_split_whitespace(pa.array([self._plain(t) for t in texts], pa.string()))
        words = cut.values.dictionary_encode()
        ids = self._ids(words.dictionary.cast(pa.binary()).to_pylist())
        # each place takes its word's ids out of the distinct words' ids one after the other
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        at = words.indices.to_numpy()
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[cut.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in pairwise(bounds)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        known = self.known
        ids = list(map(known.__getitem__, words))
        new = known.take_new()
        if new:
            self.learn(new)
            ids = [known[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        return ids

    def _plain(self, text: bytes | None) -> bytes:
        """The text as it is cut at white space."""
        if not text:
            return b""
        if self.lowercase:
            text = text.lower()
            if self.common_tails:
                text = COMMON_TAIL.sub(rb" \g<0>", text)
        return text


@cache
def encoder(path: str, lowercase: bool) -> WordEncoder:
    """One for each Python worker, so that its memory serves all tasks of the worker."""
    made = WordEncoder(path, lowercase)
    give_back()  # what reading the file took
    return made


def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment from the ids (uint32) of consecutive documents."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        chunk = (rest & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(BITS)
        more = rest > 0
        bits = np.packbits(more, bitorder="little").tobytes()
        words = np.frombuffer(bits + bytes(-len(bits) % 64), np.uint64)
        ones = np.bitwise_count(words).reshape(-1, 8).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(struct.pack("<Q", len(chunk)) + _pad(chunk.tobytes()) + words.tobytes() + _pad(rank.tobytes()))
        if not more.any():
            break
        rest = rest[more]
    head = MAGIC + struct.pack("<IIQ", len(doc_ids), len(levels), len(ids))
    null = np.array([d is None for d in doc_ids], np.uint8)
    key = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return head + key.tobytes() + _pad(null.tobytes()) + np.asarray(ends, "<u8").tobytes() + b"".join(levels)


class Segment:
    """Reads a segment's bytes in place."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a segment")
        n_docs, n_levels, self.n_ids = struct.unpack_from("<IIQ", raw, 8)
        at = 24

        def take(kind, n):
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes + -a.nbytes % 8
            return a

        key, null = take("<i8", n_docs), take(np.uint8, n_docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(key, null, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            words = -(-n // 512) * 8
            self.levels.append((take(np.uint8, n), take("<u8", words), take("<u4", words // 8)))

    def get(self, i: int) -> int:
        """The id at place ``i``: one bit test and one rank for each level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunk, words, rank) in enumerate(self.levels):
            value |= int(chunk[i]) << (BITS * k)
            w, bit = i >> 6, i & 63
            word = int(words[w])
            if not word >> bit & 1:
                return value
            block = w >> 3
            i = int(rank[block]) + sum(int(x).bit_count() for x in words[block * 8:w]) + (word & (1 << bit) - 1).bit_count()
        raise ValueError("an id runs past the last level")

    def all(self) -> np.ndarray:
        """All ids (uint32), level by level."""
        out = np.zeros(self.n_ids, np.uint64)
        at = np.arange(self.n_ids)
        for k, (chunk, words, _) in enumerate(self.levels):
            out[at] |= chunk.astype(np.uint64) << np.uint64(BITS * k)
            at = at[np.unpackbits(words.view(np.uint8), bitorder="little")[:len(at)].astype(bool)]
        return out.astype(np.uint32)


_SEGMENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                         T.StructField("local_start", T.LongType()), T.StructField("n_ids", T.LongType()),
                         T.StructField("payload", T.BinaryType())])


def write_codes(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id",
                text_col: str = "text", lowercase: bool = True, path: str | None = None) -> str:
    """Encode every document, append ``end_id``, and write the segments; returns the table's path.

    Documents are dealt out by ranges of (id, text hash) and sorted within each, so part numbers
    ascend with ids; one text at a time is encoded and no part is held whole."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-codes")
    src = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(col(text_col)).alias("h"),
                      col(text_col).cast("binary").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer_path, lowercase).encode
        ids, held, parts = [], 0, []

        def close():
            nonlocal seq, start, ids, held, parts
            flat = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum([len(p) // 4 for p in parts])
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "local_start": start, "n_ids": len(flat),
                                               "payload": pack(ids, ends, flat)}],
                                             schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("local_start", pa.int64()),
                                                               ("n_ids", pa.int64()), ("payload", pa.binary())]))
            seq, start, ids, held, parts = seq + 1, start + len(flat), [], 0, []
            return out

        for b in arrow_slices(batches, 1):
            for key, code in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids.append(key)
                parts.append(code + tail)
                held += len(code) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield close()
        if ids:
            yield close()
        give_back()

    small_batches(spark, BATCH_BYTES)
    src.mapInArrow(run, _SEGMENT).write.parquet(path)
    return path


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their global start. Only one row for each written part is totalled on the way
    to the offsets."""
    small_batches(spark, BATCH_BYTES)
    seg = spark.read.schema(_SEGMENT).parquet(path)
    totals = {r["part"]: r["n"] for r in seg.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    run, rows = 0, []
    for part in sorted(totals):
        rows.append((part, run))
        run += totals[part]
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    return seg.join(offsets, "part").withColumn("start", F.col("base") + F.col("local_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        encoder.cache_clear()  # reading needs no words: workers that have written give their memory back
        give_back()
        for b in batches:
            for start, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seg = Segment(raw.as_buffer().to_pybytes())
                ids = seg.all().astype("<u4")
                first = np.concatenate([[0], seg.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(first, seg.ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(first + start, pa.int64()),
                                                  pa.array(seg.ends - first, pa.int64()), pa.array(crc, pa.int64())],
                                                 names=schema.names)

    return _segments(spark, path).select("start", "payload").mapInArrow(run, schema)


def lookup(spark: SparkSession, path: str, places: DataFrame, place_col: str = "place") -> DataFrame:
    """Random access: the id at each global place (``place``, ``id``); places outside the sequence
    (or null) give no row. Segments are found by equal grid cells, then read in place."""
    cell = SEGMENT_IDS
    seg = _segments(spark, path).withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("n_ids") - 1) / cell))))
    want = places.select(col(place_col).cast("long").alias("place")).where("place >= 0")
    want = want.groupBy(F.floor(F.col("place") / cell).alias("cell"), F.pmod(F.xxhash64("place"), F.lit(64)).alias("salt")).agg(F.collect_list("place").alias("places"))
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("id", T.LongType())])

    def run(batches):
        for b in batches:
            for start, n, raw, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                seg = Segment(raw)
                inside = [p for p in wanted if start <= p < start + n]
                yield pa.RecordBatch.from_arrays([pa.array(inside, pa.int64()), pa.array([seg.get(p - start) for p in inside], pa.int64())],
                                                 names=schema.names)

    return seg.join(want, "cell").select("start", "n_ids", "payload", "places").mapInArrow(run, schema)
