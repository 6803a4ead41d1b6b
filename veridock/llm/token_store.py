"""Token-ID output: documents compressed one by one with a shared dictionary.

The file format is a table of blocks. A block is one binary image: a header with
the hash of the dictionary, an offset index, then a zstandard frame per document.
So one document is read by fetching its block's index and inflating one frame.
Blocks lie in ascending doc_id order; a partition's blocks are numbered.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import map_slices, slices
from .common import broadcast_if_small, checkpoint, pick, shared_dir
from .memo import Memo

MAGIC = b"TIDB"
END_ID = 2
BLOCK_BYTES = 4 * 1024 * 1024
BLOCK_DOCS = 1024
#: The dictionary is trained on at most so many documents of at most so many ids each.
DICT_DOCS, DICT_IDS, DICT_BYTES = 4000, 4096, 64 * 1024
LEVEL = 3

#: A slice of rows is encoded at a time: at most so many rows, and so many bytes of text unless one text has more.
SLICE_DOCS, SLICE_BYTES = 4096, 8 * 1024 * 1024
#: Bytes of words and their ids that a worker process remembers, and of what follows a first word.
MEMO_BYTES, REST_BYTES = 320 * 1024 * 1024, 64 * 1024 * 1024
#: The library gets so many new words in one call; ids are put in place for so many strings at a time.
CALL_PARTS, STEP = 8192, 1 << 15
#: Bytes that end a first word: ASCII but for letters. Bytes that no word to be cut has: all lead bytes but those of U+00C0 to U+023F.
ENDS_WORD = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
FOREIGN = np.array([b >= 0xC0 and not 0xC3 <= b <= 0xC8 for b in range(256)])
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of the tokenizers library as little-endian unsigned 32-bit integers, with bounded memos of words.

    The byte-level pattern treats what begins at a single space between two
    characters that aren't white space alone. So Arrow finds the distinct segments
    of a slice of texts, and only those are encoded, many in one call: only the
    first id of a segment stands for a string that begins with a space, which
    keeps them apart. The pattern also cuts where a run of letters ends, so a
    segment's first word and the rest are looked up and remembered by themselves,
    never the two together. Ids go from distinct segments to texts by numpy. Texts
    of other spacing, those that hold an added token, and all texts of a tokenizer
    of another kind go to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.memo, self.rests = Memo(MEMO_BYTES), Memo(REST_BYTES)
        made = json.loads(self.tokenizer.to_str())
        kind = made["pre_tokenizer"] or {}
        byte_level = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and made["normalizer"] is None
        # Segments are joined by spaces and rests stand behind an "a": neither may complete an added token.
        self.cuts = byte_level and made["model"]["type"] == "BPE" and not any(t.startswith("a") or " " in t for t in self.added)
        words = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(words.values(), default=0) + 1, bool)
        # Byte-level vocabularies write a space as this letter.
        self.opens[[k for w, k in words.items() if w.startswith("\u0120")]] = True
        self.before_rest = len(self.ids(" a").tobytes())

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def many(self, parts: list[str]) -> list[bytes]:
        """Ids of every part, each a space and what holds none, by one call for many where their ids can be told apart."""
        out = []
        for at in range(0, len(parts), CALL_PARTS):
            some = parts[at : at + CALL_PARTS]
            found = self.ids("".join(some))
            starts = np.flatnonzero(self.opens[found])
            if len(starts) == len(some):
                edges = [*(4 * starts).tolist(), 4 * len(found)]
                data = found.tobytes()
                out += [data[a:b] for a, b in zip(edges, edges[1:])]
            else:
                out += [self.ids(p).tobytes() for p in some]
        return out

    def after_space(self, words: list[str]) -> list[bytes]:
        """Ids of first words, or of segments that weren't cut, behind their space; nothing for those of irregular spacing."""
        fine = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        known = dict(zip(fine, self.many([" " + w for w in fine]), strict=True))
        return [known.get(w, b"") for w in words]

    def after_word(self, rests: list[str]) -> list[bytes]:
        """Ids of what follows a first word; nothing where white space ends it."""
        fine = [r for r in rests if not r[-1].isspace()]
        known = dict(zip(fine, [ids[self.before_rest :] for ids in self.many([" a" + r for r in fine])], strict=True))
        return [known.get(r, b"") for r in rests]

    def distinct_ids(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments one after the other, and their numbers; none for segments of irregular spacing."""
        pieces = halves(segments).dictionary_encode()
        texts, codes = pieces.dictionary, pieces.indices.to_numpy()
        # A piece stands for a word in the first place of a segment and for a rest in the second.
        place = np.zeros((2, len(texts)), bool)
        place[0, codes[0::2]] = place[1, codes[1::2]] = True
        words, rests = np.flatnonzero(place[0]), np.flatnonzero(place[1] & (pc.binary_length(texts).to_numpy() > 0))
        got = [*recall(self.memo, texts.take(pa.array(words)).to_pylist(), self.after_space), *recall(self.rests, texts.take(pa.array(rests)).to_pylist(), self.after_word), b""]
        at = np.full((2, len(texts)), len(got) - 1, np.int32)
        at[0, words] = np.arange(len(words), dtype=np.int32)
        at[1, rests] = np.arange(len(words), len(got) - 1, dtype=np.int32)
        order = np.stack([at[0, codes[0::2]], at[1, codes[1::2]]], axis=1)
        lens = lengths(got)
        none = (lens[order] == 0) & np.stack([np.ones(len(segments), bool), order[:, 1] < len(got) - 1], axis=1)
        order[none.any(axis=1)] = len(got) - 1
        return gather(np.frombuffer(b"".join(got), "<u4"), lens, order.ravel()), lens[order].sum(axis=1, dtype=np.int32)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        out: list[bytes | None] = [None] * len(texts)
        cut = [k for k, t in enumerate(texts) if self.cuts and t and not t[0].isspace() and not any(x in t for x in self.added)]
        if cut:
            parts = pc.split_pattern(pa.array([texts[k] for k in cut], pa.string()), " ")
            # No space stands before the first segment of a text.
            edges, segments = parts.offsets.to_numpy(), parts.flatten()
            spaced = np.ones(len(segments), bool)
            spaced[edges[:-1]] = False
            others = segments.filter(pa.array(spaced)).dictionary_encode()
            first = segments.take(pa.array(edges[:-1])).dictionary_encode()
            data, lens = self.distinct_ids(others.dictionary)
            firsts = [b"" if t[-1].isspace() else self.ids(t).tobytes() for t in first.dictionary.to_pylist()]
            codes = np.empty(len(segments), np.int32)
            codes[spaced] = others.indices.to_numpy()
            codes[edges[:-1]] = len(lens) + first.indices.to_numpy()
            lens = np.concatenate([lens, lengths(firsts)])
            found = gather(np.concatenate([data, np.frombuffer(b"".join(firsts), "<u4")]), lens, codes)
            sizes = lens[codes]
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[edges]
            whole = np.add.reduceat(sizes == 0, edges[:-1])
            for k, a, b, w in zip(cut, ends[:-1].tolist(), ends[1:].tolist(), whole.tolist(), strict=True):
                if not w:
                    out[k] = found[a:b].tobytes()
            self.memo.turn()
            self.rests.turn()
        return [self.ids(t).tobytes() if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def halves(segments: pa.Array) -> pa.Array:
    """Of every segment the first word and the rest, one after the other; a segment that can't be cut is followed by nothing.

    A first word has letters of ASCII and U+00C0 to U+023F alone, and an ASCII
    character that is no letter follows.
    """
    if not len(segments):
        return segments
    edges = np.frombuffer(segments.buffers()[1], np.int32)[segments.offset : segments.offset + len(segments) + 1]
    data = np.frombuffer(segments.buffers()[2] or b"", np.uint8)[: edges[-1]]
    starts, ends = edges[:-1], edges[1:]
    stops = np.append(np.flatnonzero(ENDS_WORD[data]), len(data))
    middles = np.minimum(stops[np.searchsorted(stops, starts)], ends)
    # The signs for times and divided by lie among the letters.
    signs = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    foreign = np.append(0, np.cumsum(FOREIGN[data] | np.append(signs, np.zeros(min(len(data), 1), bool)), dtype=np.int32))
    cut = (middles > starts) & (foreign[middles] == foreign[starts])
    out = np.empty(2 * len(segments) + 1, np.int32)
    out[0::2], out[1::2] = edges, np.where(cut, middles, ends)
    return pa.Array.from_buffers(pa.string(), len(out) - 1, [None, pa.py_buffer(out), segments.buffers()[2]])


def recall(memo: Memo, keys: list[str], compute: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Values of distinct keys, remembered or computed."""
    got = list(map(memo.new.get, keys))
    value = memo.learn([k for k, v in zip(keys, got, strict=True) if v is None], compute)
    return [value(k) if v is None else v for k, v in zip(keys, got, strict=True)]


def lengths(ids: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, ids), np.int32, len(ids)) // 4


def gather(data: np.ndarray, lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of ``data`` with lengths ``lens``, as ``order`` names them."""
    starts = np.cumsum(lens, dtype=np.int64) - lens
    out, at = np.empty(int(lens[order].sum(dtype=np.int64)), data.dtype), 0
    for k in range(0, len(order), STEP):
        some = order[k : k + STEP]
        n = lens[some]
        ends = np.cumsum(n, dtype=np.int64)
        out[at : at + ends[-1]] = data[np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1])]
        at += ends[-1]
    return out


def encoder(tokenizer_file: str) -> Encoder:
    """One per worker process."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def narrow(ids: bytes) -> bytes:
    """Width byte and ids, in 16 bits where all fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u2" if data[0] == 2 else "<u4").astype("<u4")


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; empty where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def dict_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()


def pack_block(frames: list[bytes], dictionary: bytes) -> bytes:
    """Magic, dictionary hash, count, count + 1 offsets, frames."""
    ends = np.cumsum([0, *map(len, frames)], dtype="<u8")
    return MAGIC + dict_hash(dictionary) + struct.pack("<I", len(frames)) + ends.tobytes() + b"".join(frames)


def frame_of(block: bytes, k: int) -> bytes:
    """Document k's frame, by the offset index alone."""
    n = struct.unpack_from("<I", block, 36)[0]
    a, b = struct.unpack_from("<QQ", block, 40 + 8 * k)
    body = 40 + 8 * (n + 1)
    return block[body + a : body + b]


def open_frame(frame: bytes, dictionary: bytes) -> np.ndarray:
    inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return widen(inflate.decompress(frame))


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID) -> bytes:
    """Encode whole texts, append ``end_id``, write blocks in doc_id order under ``path``; returns the dictionary."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)
    keys = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_DOCS)
    chosen = rows.join(F.broadcast(keys.distinct()), "doc_id").select("text")
    sampled = map_slices(chosen, lambda texts: [[narrow((ids + end)[: 4 * DICT_IDS]) for ids in encoder(tokenizer_file).encode_all(texts)]], "ids binary", most=SLICE_BYTES)
    dictionary = train_dictionary(sorted(bytes(r[0]) for r in sampled.limit(2 * DICT_DOCS).collect()))
    schema = "part int, block int, before long, doc_ids array<long>, counts array<int>, dict_sha256 string, image binary"
    arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("dict_sha256", pa.string()), ("image", pa.binary())])

    def run(batches):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        encode_all, named = encoder(tokenizer_file).encode_all, dict_hash(dictionary).hex()
        part, block, before, size = 0, 0, 0, 0
        ids, counts, frames = [], [], []

        def flush():
            cols = [[part], [block], [before], [ids], [counts], [named], [pack_block(frames, dictionary)]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for parts, doc_ids, texts in slices(batches, SLICE_DOCS, SLICE_BYTES):
            part = parts[0]
            for doc_id, packed in zip(doc_ids, encode_all(texts), strict=True):
                data = packed + end
                ids.append(doc_id)
                counts.append(len(data) // 4)
                frames.append(squeeze.compress(narrow(data)))
                size += len(frames[-1])
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    before += sum(counts)
                    block, size, ids, counts, frames = block + 1, 0, [], [], []
        if ids:
            yield flush()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(dict_hash(dictionary).hex(), dictionary)], "dict_sha256 string, dictionary binary").coalesce(1).write.option("compression", "none").parquet(f"{path}/dictionary")
    return dictionary


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    blocks = spark.read.parquet(f"{path}/blocks")
    named, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(dictionary)
    totals = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # One row per partition of the writer: their number is a setting and doesn't follow the documents.
    totals = checkpoint(totals)
    earlier = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    earlier, _ = broadcast_if_small(checkpoint(earlier))
    placed = blocks.join(earlier, "part").select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "counts", "dict_sha256", "image")

    def run(starts, doc_ids, counts, hashes, images):
        out = [[], [], [], []]
        inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for start, ids, ns, h, image in zip(starts, doc_ids, counts, hashes, images, strict=True):
            if h != named or image[:4] != MAGIC or image[4:36].hex() != named:
                raise ValueError("block and dictionary don't belong together")
            for k, doc_id in enumerate(ids):
                tokens = widen(inflate.decompress(frame_of(image, k)))
                if len(tokens) != ns[k]:
                    raise ValueError(f"document {doc_id}: {len(tokens)} ids, {ns[k]} in the index")
                for col, v in zip(out, (doc_id, start, len(tokens), zlib.crc32(tokens.tobytes())), strict=True):
                    col.append(v)
                start += len(tokens)
        return out

    return map_slices(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=4)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """Ids of one document: its block by the id list, its frame by the offset index."""
    row = spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", doc_id)).first()
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[1])
    return open_frame(frame_of(bytes(row["image"]), row["doc_ids"].index(doc_id)), dictionary).tolist() if row else []


def token_output(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write all documents to the shared folder and report what the files hold.

    Null and empty texts are the end id alone. Rows that repeat a doc_id lie side
    by side in order of text; null ids come first. An empty table gives no rows.
    """
    path = f"{shared_dir(docs.sparkSession)}/veridock/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_file, path)
    spark = docs.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return read_tokens(spark, path)
