"""Best-fit packing with swap-based local search.

Texts are tokenised (every run between white space once per worker; its ids
are kept in a bounded table, from which a group of texts is put together at once), an
end id is appended, and only longer documents are cut. Pieces are dealt by a hash of a row number into
shards of about SHARD pieces, so no document, source or copy group can make a
shard large. Each shard is packed best-fit decreasing and then improved: the
emptiest bins give documents away by moves, one-for-one and two-for-one
exchanges with fuller bins, each of which raises the sum of squared fills, until
bins empty or no exchange is left. A shard wastes at most about one sequence.

Defined cases: null and empty texts are one piece, the end id alone. Repeated
rows and rows with a null doc_id are packed as documents of their own. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, checkpoint, lean, table, text_batches, worker_cache
from .tokens import public_path

TOKENIZER = "word_bpe_49k.json"
LENGTH = 2048
END = 0
SHARD = 8192
#: Emptiest bins that the local search tries to dissolve at a time, and its rounds.
DONORS, ROUNDS = 32, 8
#: Words whose ids a worker keeps, and their bytes together.
CACHE, CACHE_BYTES = 200_000, 1 << 23
#: Latin letters and marks after them: the tokenizer parts them, so each is encoded once.
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+"
ENDED = re.compile(rb"(" + LETTERS + rb")([.,;:!?*#$%&|]+)")
WORD = re.compile(LETTERS)
#: The one of these letters that is more than one when lower-cased.
TWOFOLD = "İ".encode()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Index(dict):
    """Numbers of words in the order in which they are first asked for; `new` has those without ids yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes for the code points from 256 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        self.letters = {i: x for i, x in enumerate(letters)}
        self.clear()

    def clear(self) -> None:
        self.index, self.bytes, self.used = _Index(), 0, 0
        self.flat = np.empty(1 << 16, "<u4")
        self.start, self.size, self.seen = (np.zeros(1 << 16, np.int32) for _ in range(3))

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, encoded apart."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode_letters(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words of letters alone: each is one word to the tokenizer, so its
        model takes their lower-cased bytes without another search for words."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        return [[t.id for t in tokenize(w.decode().lower().encode().decode("latin-1").translate(letters))] for w in words]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered words one after the other, where each word's end)."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(total)], ends

    def put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of the numbered words, given one after the other."""
        if (need := self.used + len(ids)) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * need)
        if (most := len(self.index)) > len(self.start):
            self.start, self.size, self.seen = (np.concatenate([x, np.zeros(2 * most - len(x), np.int32)]) for x in (self.start, self.size, self.seen))
        self.flat[self.used : need] = ids
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used = need

    def learn(self) -> None:
        """Ids of the new words."""
        new, first = self.index.new, len(self.index) - len(self.index.new)
        ended: dict[int, tuple[int, int]] = {}
        for k, w in enumerate(new):  # bodies and ends of words join the list behind
            if not w.isalpha() and (m := ENDED.fullmatch(w)):
                ended[k] = self.index[m[1]], self.index[m[2]]
        self.bytes += sum(map(len, new))
        plain = [k for k in range(len(new)) if k not in ended]
        letters = [k for k in plain if new[k].isalpha() or (WORD.fullmatch(new[k]) and TWOFOLD not in new[k])]
        others = sorted(set(plain).difference(letters))
        for places, encode in ((letters, self.encode_letters), (others, self.encode)):
            for at in range(0, len(places), 4096):
                some = places[at : at + 4096]
                ids = encode([new[k] for k in some])
                self.put(np.array(some) + first, np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))
        if ended:
            parts = np.array([*ended.values()], np.int64)
            ids, _ = self.gather(parts.reshape(-1))
            self.put(np.array([*ended]) + first, ids, self.size[parts].sum(axis=1))
        new.clear()

    def shrink(self) -> None:
        """Keep the words that were seen most, at most half as many as the table holds."""
        n, least = len(self.index), 2
        while (often := np.flatnonzero(self.seen[:n] >= least)).size > CACHE // 2:
            least *= 2
        words = [*self.index]
        words = [words[i] for i in often]
        ids, sizes, seen = self.gather(often)[0], self.size[often], self.seen[often]
        self.clear()
        if sum(map(len, words)) > CACHE_BYTES // 2:
            return
        for w in words:
            self.index[w]
        self.index.new.clear()
        self.bytes = sum(map(len, words))
        self.put(np.arange(len(words)), ids, sizes)
        self.seen[: len(words)] = seen // 2

    def batches(self, texts: list[bytes], most: int = 1 << 18) -> Iterator[bytes]:
        """Ids of each text. White space parts the tokenizer's words, so runs between it
        are encoded apart; A-Z are lower-cased first, as the tokenizer does itself, but
        for texts that may hold a special token."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append((text if b"<|" in text else text.lower()).split())
            size += len(text)
            if size >= most or i == len(texts) - 1:
                if len(self.index) > CACHE or self.bytes > CACHE_BYTES:
                    self.shrink()
                counts = np.fromiter(map(len, group), np.int64, len(group))
                numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(group)), np.int64, counts.sum())
                if self.index.new:
                    self.learn()
                found = np.bincount(numbers)
                self.seen[: len(found)] = np.minimum(self.seen[: len(found)] + found, 1 << 30)
                ids, ends = self.gather(numbers)
                ends = np.r_[0, ends][np.cumsum(counts)].tolist()
                for a, b in zip([0, *ends], ends):
                    yield ids[a:b].tobytes()
                group, size = [], 0


def ids_of(path: str) -> Ids:
    return worker_cache(f"packing {path}", lambda: Ids(path))


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each document; with keep_ids also ids, little-endian unsigned 32-bit."""
    stop = np.array([end], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ids_of(path or public_path(TOKENIZER))
        for batch in batches:
            rows: list[tuple] = []
            names = batch.column(0).to_pylist()
            for name, ids in zip(names, coder.batches(batch.column(1).to_pylist()), strict=True):
                ids += stop
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, length)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((name, k, start, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
            if rows:
                columns = [*zip(*rows, strict=True)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data")).mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of item numbers."""
    bins: list[list[int]] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        k = bisect_left(open_bins, (n, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            insort(open_bins, (room - n, b))
    return bins


def _improve(taker: list[int], donor: list[int], room: int, lengths: list[int], gap: int) -> int:
    """One exchange that moves up to `room` tokens from donor to taker; tokens moved, 0 if none.

    gap: the taker's fill less the donor's. Moving t tokens raises the squares
    by 2t(gap + t), so any t > max(0, -gap) raises them."""
    least = max(0, -gap)
    sizes = sorted((lengths[i], i) for i in donor)
    k = bisect_right(sizes, (room, len(lengths)))
    best = (sizes[k - 1][0], (), (sizes[k - 1][1],)) if k and sizes[k - 1][0] > least else (least, (), ())
    for x in taker:
        if best[0] == room:
            break
        top = lengths[x] + room
        k = bisect_right(sizes, (top, len(lengths)))
        if k and sizes[k - 1][0] - lengths[x] > best[0]:
            best = (sizes[k - 1][0] - lengths[x], (x,), (sizes[k - 1][1],))
        low, high = 0, len(sizes) - 1  # two for one, by two pointers
        while low < high:
            both = sizes[low][0] + sizes[high][0]
            if both > top:
                high -= 1
                continue
            if both - lengths[x] > best[0]:
                best = (both - lengths[x], (x,), (sizes[low][1], sizes[high][1]))
            low += 1
    moved, out, into = best
    if not into:
        return 0
    for i in into:
        donor.remove(i)
        taker.append(i)
    for i in out:
        taker.remove(i)
        donor.append(i)
    return moved


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins until the emptiest dissolve."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fills) // capacity)
    for _ in range(ROUNDS):
        if len(bins) <= least:
            break
        order = sorted((b for b in range(len(bins)) if fills[b] < capacity), key=lambda b: fills[b])
        donors, takers = order[:DONORS], order[:0:-1]
        changed = False
        for d in donors:
            for t in takers:
                if not bins[d]:
                    break
                if t == d or not bins[t] or fills[t] == capacity:
                    continue
                moved = _improve(bins[t], bins[d], capacity - fills[t], lengths, fills[t] - fills[d])
                if moved:
                    fills[t] += moved
                    fills[d] -= moved
                    changed = True
        kept = [b for b in range(len(bins)) if bins[b]]
        bins, fills = [bins[b] for b in kept], [fills[b] for b in kept]
        if not changed:
            break
    return bins


def pack_lengths(lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    full = [[i] for i, n in enumerate(lengths) if n == capacity]
    rest = [i for i, n in enumerate(lengths) if n < capacity]
    sizes = [lengths[i] for i in rest]
    return full + [[rest[i] for i in b] for b in local_search(best_fit(sizes, capacity), sizes, capacity)]


def place(parts: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """pieces() with sequence_id and offset."""
    held = checkpoint(parts)
    n = max(1, -(-held.count() // shard))
    dealt = held.withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_pylist()
        base = group.column("__shard")[0].as_py() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, items in enumerate(pack_lengths(lengths, length)):
            at = 0
            for i in items:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        return group.drop_columns(["__shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    return place(pieces(docs, path, length, end, keep_ids), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
