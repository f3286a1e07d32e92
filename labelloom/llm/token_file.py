"""Token ids in binary files of Simple-8b words.

A 64-bit word is a 4-bit selector and 60 bits of payload. Selectors 1 to 14 pack from 60 ids of 1 bit down to one id
of 60 bits; selector 0 stands for 240 zero ids; selector 15 is an escape, after which a whole word holds one
id of more than 60 bits. A block holds the ids of whole documents, with the place of every
``FRAME`` th word and the ids before it, so any part can be decoded alone. Decoding handles all words of one
selector at a time.

A file is a Parquet file of blocks in ascending document order, one file per range of document ids, in the shared
folder, so writing, retrying and reading are Spark's.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.scale.staging import StagingScope

# Fixed values of Simple-8b: ids per word and bits per id of selectors 1 to 14.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ZEROS = 240
ESCAPE = 15
MAGIC = b"S8B1"
FRAME = 256
BLOCK_IDS = 1 << 18
END_ID = 0
_HEADER = "<4sQQQQ"


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes): greedy packing, each word taking as many ids as fit; escapes are the places of raw words."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    selector = np.full(n, ESCAPE, dtype=np.uint8)
    step = np.ones(n, dtype=np.int64)
    # From the narrowest payload that every id fits to narrower ones; one that fits holds more ids and overwrites it.
    largest = int(ids.max())
    first = next((c for c in range(len(BITS) + 1) if largest < 1 << (BITS[c - 1] if c else 0)), len(BITS))
    if largest < 1 << 32:
        ids = ids.astype(np.uint32)
    for code in range(first, -1, -1):
        bits, count = (BITS[code - 1], PER_WORD[code - 1]) if code else (0, ZEROS)
        # Ids that fit, and as many more beyond the end, where a word may be partly filled. A word can start
        # at one if the next count - 1 follow it without a gap.
        narrow = np.append(np.flatnonzero(ids < ids.dtype.type(1 << bits) if bits < 32 or ids.itemsize == 8 else np.ones(n, dtype=bool)), np.arange(n, n + count - 1))
        if len(narrow) < count:
            continue
        fits = narrow[: len(narrow) - count + 1][narrow[count - 1 :] - narrow[: len(narrow) - count + 1] == count - 1]
        selector[fits], step[fits] = code, count
    taken = _walk(step)
    chosen = selector[taken]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, dtype=np.uint64)]).astype(np.uint64)
    for code in np.unique(chosen):
        if code in (0, ESCAPE):
            continue
        rows = np.flatnonzero(chosen == code)
        bits, start = np.uint64(BITS[code - 1]), taken[rows]
        total = np.zeros(len(rows), dtype=np.uint64)
        for i in range(PER_WORD[code - 1]):
            total |= padded[start + i] << (bits * np.uint64(i))
        words[rows] |= total
    raw = np.flatnonzero(chosen == ESCAPE)
    if len(raw):
        words = np.insert(words, raw + 1, ids[taken[raw]])
        raw = raw + 1 + np.arange(len(raw))
    return words, raw


def _walk(step: np.ndarray) -> np.ndarray:
    """Places met when going from 0 by ``step`` to the end: every eighth one by one, those between by composed steps."""
    n = len(step)
    after = np.append(np.minimum(np.arange(n) + step, n), n)
    twice = after[after]
    fourth = twice[twice]
    eighth = memoryview(fourth[fourth])
    met, at = [], 0
    while at < n:
        met.append(at)
        at = eighth[at]
    places = np.array(met, dtype=np.int64)[:, None]
    for hop in (fourth, twice, after):
        places = np.stack([places, hop[places]], axis=2).reshape(len(places), -1)
    places = places.ravel()
    return places[places < n]


def decode_ids(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of a run of words; ``escapes`` holds the places of raw words."""
    coded = np.ones(len(words), dtype=bool)
    coded[escapes] = False
    selectors = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.array([ZEROS, *PER_WORD, 1], dtype=np.int64)[selectors]
    sizes[~coded] = 0
    starts = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), dtype=np.uint64)
    for code in range(1, ESCAPE):
        rows = np.flatnonzero(coded & (selectors == code))
        if not len(rows):
            continue
        bits = np.uint64(BITS[code - 1])
        mask = (np.uint64(1) << bits) - np.uint64(1)
        start, body = starts[rows], words[rows]
        for i in range(PER_WORD[code - 1]):
            ids[start + i] = (body >> (bits * np.uint64(i))) & mask
    ids[starts[escapes - 1]] = words[escapes]
    return ids[:n]


def pack_block(documents: list[np.ndarray]) -> bytes:
    """One block: counts, ids per document, frame places, escape places, words."""
    lengths = np.array([len(d) for d in documents], dtype=np.uint64)
    ids = np.concatenate(documents) if documents else np.empty(0, dtype=np.uint64)
    words, escapes = encode_ids(ids)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.array([ZEROS, *PER_WORD, 1], dtype=np.int64)[selectors]
    sizes[escapes] = 0
    coded = np.ones(len(words), dtype=bool)
    coded[escapes] = False
    heads = np.flatnonzero(coded)[::FRAME]
    frames = np.stack([heads, (np.cumsum(sizes) - sizes)[heads]], axis=1).astype(np.uint64)
    head = struct.pack(_HEADER, MAGIC, len(lengths), len(frames), len(escapes), len(words))
    return b"".join([head, lengths.tobytes(), frames.tobytes(), escapes.astype(np.uint64).tobytes(), words.tobytes()])


def _parts(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    magic, n_docs, n_frames, n_escapes, n_words = struct.unpack_from(_HEADER, block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    values = np.frombuffer(block, dtype="<u8", offset=struct.calcsize(_HEADER))
    cuts = np.cumsum([n_docs, 2 * n_frames, n_escapes, n_words])
    lengths, frames, escapes, words = values[: cuts[0]], values[cuts[0] : cuts[1]], values[cuts[1] : cuts[2]], values[cuts[2] : cuts[3]]
    return lengths.astype(np.int64), frames.reshape(-1, 2).astype(np.int64), escapes.astype(np.int64), words


def unpack_block(block: bytes) -> list[np.ndarray]:
    lengths, _, escapes, words = _parts(block)
    total = int(lengths.sum())
    return np.split(decode_ids(words, escapes, total), np.cumsum(lengths)[:-1]) if len(lengths) else []


def unpack_range(block: bytes, low: int, high: int) -> np.ndarray:
    """Ids [low, high) of a block, decoding only the frames that hold them."""
    lengths, frames, escapes, words = _parts(block)
    high = min(high, int(lengths.sum()))
    if low >= high:
        return np.empty(0, dtype=np.uint64)
    first = int(np.searchsorted(frames[:, 1], low, side="right")) - 1
    last = int(np.searchsorted(frames[:, 1], high, side="left"))
    start, base = frames[first]
    end = frames[last, 0] if last < len(frames) else len(words)
    inside = escapes[(escapes >= start) & (escapes < end)] - start
    ids = decode_ids(words[start:end], inside, high - int(base))
    return ids[low - int(base) :]


class PieceTokenizer:
    """Ids of whole texts by the tokenizers library, encoding every distinct piece once while it stays cached.

    A byte-level tokenizer never joins text across a single space between two other characters, so the pieces
    between such spaces, each with its leading space, can be encoded alone. It also never joins a letter
    or digit with the stop or comma after it, or anything with a single line feed between two other characters, so
    texts, or else the single pieces, are cut there too before they are looked up. New pieces of many texts are encoded in one string
    and told apart by the leading space of their first id; pieces without one are encoded one by one.
    An added token is one id wherever its content stands, so texts that hold one are encoded whole, without the cache.
    """

    GENERATION = 600_000  # pieces in either half of the cache; the older half is dropped when the newer is full
    _OTHER_SPACE = re.compile(r"[^\S \n]")
    _GAP = re.compile(r"(?<=\S) (?=\S)")
    _OTHER_STOP = re.compile(r"[.,](?<![^\W_][.,])(?:[ \n]|\Z)")  # one that ends a piece and follows no letter or digit

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        # Ids of a piece as little-endian 32-bit values, so that a text's ids are its pieces' values joined.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self._holds_added(t)]
        if whole:
            rest = iter(self.encode([t for t in texts if not self._holds_added(t)]))
            made = dict(zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)))
            return [np.array(made[i].ids, dtype="<u4") if i in made else next(rest) for i in range(len(texts))]
        pieces = [self._pieces(t) for t in texts]
        if len(self.young) > self.GENERATION:
            self.young, self.old = {}, self.young
        wanted = set().union(*pieces).difference(self.young)
        if wanted:
            self._learn(wanted)
        known = self.young.__getitem__
        return [np.frombuffer(b"".join(map(known, own)), dtype="<u4") for own in pieces]

    def _holds_added(self, text: str) -> bool:
        return any(content in text for content in self.added)

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        pairs = "  " in text or "\n " in text or " \n" in text
        if pairs or text[0].isspace() or text[-1].isspace() or self._OTHER_SPACE.search(text):
            parts = self._GAP.split(text)
            return [parts[0], *(" " + p for p in parts[1:])]
        if "\0" in text:
            return [text]
        marked = text.replace(" ", "\0 ")
        if "\n\n" not in text:
            marked = marked.replace("\n", "\0\n\0")
            if not self._OTHER_STOP.search(text):
                return (marked + "\0").replace(",\0", "\0,\0").replace(".\0", "\0.\0").split("\0")[:-1]
        return marked.split("\0")

    def _cut(self, piece: str) -> list[str]:
        """The piece as parts that the tokenizer never joins."""
        before, feed, after = piece.partition("\n")
        if feed:
            if before and after and not before[-1].isspace() and not after[0].isspace():
                return [*self._cut(before), "\n", *self._cut(after)]
            return [piece]
        if len(piece) > 2 and piece[-1] in ".," and piece[-2].isalpha():
            return [piece[:-1], piece[-1]]
        return [piece]

    def _recall(self, wanted: set[str]) -> set[str]:
        """Take what the older half knows over; the rest is new."""
        kept = wanted & self.old.keys()
        self.young.update(zip(kept, map(self.old.__getitem__, kept)))
        return wanted - kept

    def _learn(self, wanted: set[str]) -> None:
        wanted = self._recall(wanted)
        made = [(p, self._cut(p)) for p in wanted if p[-1] in ".," or "\n" in p]
        made = [(p, parts) for p, parts in made if len(parts) > 1]
        parts = set(chain.from_iterable(parts for _, parts in made))
        new = (wanted.difference(p for p, _ in made) | parts).difference(self.young)
        new = self._recall(new)
        # Only the leading character is white space: other white space is not printable.
        plain = [p for p in new if p[0] == " " and p.isprintable() and p.count(" ") == 1]
        alone = list(new.difference(plain))
        for low in range(0, len(plain), 5_000):
            alone += self._joined(plain[low : low + 5_000])
        for part, got in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.young[part] = np.array(got.ids, dtype="<u4").tobytes()
        known = self.young.__getitem__
        self.young.update((piece, b"".join(map(known, own))) for piece, own in made)

    def _joined(self, pieces: list[str]) -> list[str]:
        """Encode pieces in one string; returns them if some piece does not begin with a leading-space id."""
        joined = "".join(pieces)
        if self._holds_added(joined):
            return pieces
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.leads[ids])
        if len(cuts) != len(pieces):
            return pieces
        raw, bounds = ids.tobytes(), (np.append(cuts, len(ids)) * 4).tolist()
        self.young.update(zip(pieces, map(raw.__getitem__, map(slice, bounds, bounds[1:]))))
        return []


def worker_tokenizer(path: str) -> PieceTokenizer:
    """The tokenizer of this worker process, with what it has learned in earlier tasks."""
    store = sys.modules.setdefault("_labelloom_worker", ModuleType("_labelloom_worker"))
    kept = getattr(store, "tokenizer", None)
    if kept is None or kept.path != path:
        kept = store.tokenizer = PieceTokenizer(path)
    return kept


def _blocks(path: str, chunk: int = 512):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        held: list[np.ndarray] = []
        count, number = 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids_held], pa.list_(doc_type)), pa.array([count]), pa.array([pack_block(held)], pa.binary())],
                names=["block", "doc_ids", "n_ids", "payload"],
            )

        ids_held: list = []
        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for low in range(0, batch.num_rows, chunk):
                part = batch.slice(low, chunk)
                encoded = tokenizer.encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), encoded):
                    held.append(np.append(ids, np.uint32(END_ID)))
                    ids_held.append(doc)
                    count += len(held[-1])
                    if count >= BLOCK_IDS:
                        yield block()
                        held, ids_held, count, number = [], [], 0, number + 1
        if held:
            yield block()

    return packed


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, docs, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids = unpack_block(payload)
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, batch.schema.field(1).type.value_type),
                    pa.array(start + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array(sums, pa.int64()),
                ],
                names=["id", "start", "n_tokens", "ids_crc32"],
            )


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of every whole text, each followed by the end id 0, as files in ascending id order.

    Null texts are empty. Rows that repeat an id follow each other, ordered by text; null ids come first. Ranges of
    ids are dealt evenly by Spark's sampling, texts move once, and a task holds one block and one Arrow batch.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ranged = chosen.repartitionByRange("id").sortWithinPartitions("id", tie)
    kind = dict(chosen.dtypes)["id"]
    blocks = ranged.mapInArrow(_blocks(tokenizer_path), f"block long, doc_ids array<{kind}>, n_ids long, payload binary")
    blocks.withColumn("file", F.spark_partition_id()).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it: block counts are added up per file, and files (one row
    each) in order.
    """
    blocks = spark.read.parquet(folder)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    places = blocks.select("file", "block", F.coalesce(F.sum("n_ids").over(in_file), F.lit(0)).alias("_inner"))
    starts = places.join(files, "file").select("file", "block", (F.col("_base") + F.col("_inner")).alias("start"))
    placed = blocks.join(F.broadcast(starts), ["file", "block"]).select("start", "doc_ids", "payload")
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return placed.mapInArrow(_read, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_file_digest(
    docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and read them back: (id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    folder = StagingScope(spark, "tokens").folder
    write_token_files(docs, tokenizer_path or default_tokenizer(), folder, id_col, text_col)
    return read_token_files(spark, folder).withColumnRenamed("id", id_col)
