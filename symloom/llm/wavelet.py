"""Token-id output as wavelet matrices.

A shard holds the ids of consecutive documents, in ascending doc_id order, as one blob: a wavelet matrix of succinct bit planes (most significant
bit first, each stably partitioned by the bit) with rank and select directories, and the documents' ids and token counts. ``Shard`` reads
one blob and answers token access, counting (rank) and occurrence lookup (select); each touches some stretches of the planes,
which are compressed one by one, so a lookup unpacks a bounded part of the blob. ``tokens`` unpacks all of it.

Layout of a blob, little-endian: 8 bytes ``WMTX0002``; 32-bit lengths of the header and of the directory; the header, the directory (a zstd frame each); the
stretches (a zstd frame each). The header is JSON: documents, counts, n, levels, zeros (of each plane) and ends (of the stretches' frames). A plane is ceil(n /
8) bytes, bits in big-endian order, cut into stretches of STRETCH bits. The directory holds for each plane the ones before each
stretch (32 bits each), the ones before each BLOCK bits within its stretch (16 bits each), and for ones, then zeros, the block that holds each
SAMPLE-th (32 bits each).

Writing is one range exchange by doc_id. A task streams its sorted texts, and starts a new shard when one has
``shard_tokens`` ids, so memory is bounded by a shard and the longest text. A null text is an empty text. Rows with the
same doc_id stand in the order of their texts and are documents of their own. An empty table gives no shard.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.common import small

MAGIC = b"WMTX0002"
BLOCK, STRETCH, SAMPLE = 512, 65_536, 8192
_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)


def build(ids: np.ndarray, levels: int) -> tuple[list[bytes], list[int]]:
    """(planes, zeros of each plane)."""
    now, planes, zeros = ids, [], []
    for level in range(levels - 1, -1, -1):
        one = (now & now.dtype.type(1 << level)) != 0
        planes.append(np.packbits(one).tobytes())
        zeros.append(len(now) - int(np.count_nonzero(one)))
        up = np.empty_like(now)
        np.compress(~one, now, out=up[: zeros[-1]])
        np.compress(one, now, out=up[zeros[-1] :])
        now = up
    return planes, zeros


def directory(plane: bytes, n: int) -> list[bytes]:
    """Ones before each stretch, ones before each block in its stretch, and the blocks of the sampled ones and zeros."""
    blocks = -(-n // BLOCK)
    whole = np.zeros(blocks * BLOCK // 64, np.uint64)
    whole.view(np.uint8)[: len(plane)] = np.frombuffer(plane, np.uint8)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(whole).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64))))
    per = STRETCH // BLOCK
    coarse = ones[:blocks:per]
    fine = ones[:blocks] - np.repeat(coarse, per)[:blocks]
    zeros = np.minimum(np.arange(blocks + 1) * BLOCK, n) - ones
    samples = [np.searchsorted(x, np.arange(0, max(1, x[-1]), SAMPLE), "right") - 1 for x in (ones, zeros)]
    return [coarse.astype("<u4").tobytes(), fine.astype("<u2").tobytes(), *(x.clip(0).astype("<u4").tobytes() for x in samples)]


def pack(docs: list[int | None], counts: list[int], ids: np.ndarray, levels: int) -> bytes:
    planes, zeros = build(ids, levels)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    step = STRETCH // 8
    frames = [squeeze(plane[at : at + step]) for plane in planes for at in range(0, len(plane), step)]
    ends = np.cumsum([len(f) for f in frames]).tolist()
    head = squeeze(json.dumps({"docs": docs, "counts": counts, "n": len(ids), "levels": levels, "zeros": zeros, "ends": ends}).encode())
    index = squeeze(b"".join(part for plane in planes for part in directory(plane, len(ids))))
    return MAGIC + struct.pack("<II", len(head), len(index)) + head + index + b"".join(frames)


class Shard:
    """``unpacked`` counts the stretches that have been unpacked."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC or len(blob) < 16:
            raise ValueError("not a wavelet matrix file")
        head, index = struct.unpack_from("<II", blob, 8)
        if len(blob) < 16 + head + index:
            raise ValueError("not a whole wavelet matrix file")
        own = json.loads(zstandard.ZstdDecompressor().decompress(blob[16 : 16 + head]))
        self.docs, self.counts, self.n, self.levels, self.zeros, ends = (own[k] for k in ("docs", "counts", "n", "levels", "zeros", "ends"))
        self.body = memoryview(blob)[16 + head + index :]
        if len(self.body) != (ends[-1] if ends else 0):
            raise ValueError("not a whole wavelet matrix file")
        self.ends = [0, *ends]
        self.wide, self.unpacked = -(-self.n // STRETCH), 0
        self.stretches: dict[int, np.ndarray] = {}
        self._index = blob[16 + head : 16 + head + index]

    @functools.cached_property
    def ranks(self) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of each plane: ones before each stretch, ones before each block in its stretch, blocks of the sampled zeros and ones."""
        raw, at, out = zstandard.ZstdDecompressor().decompress(self._index), 0, []
        for z in self.zeros:
            parts = []
            for kind, size in (("<u4", self.wide), ("<u2", -(-self.n // BLOCK)), ("<u4", -(-max(1, self.n - z) // SAMPLE)), ("<u4", -(-max(1, z) // SAMPLE))):
                parts.append(np.frombuffer(raw, kind, size, at))
                at += parts[-1].nbytes
            out.append((parts[0], parts[1], [parts[3], parts[2]]))
        return out

    def _bytes(self, level: int, stretch: int) -> np.ndarray:
        k = level * self.wide + stretch
        if k not in self.stretches:
            self.stretches[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.body[self.ends[k] : self.ends[k + 1]]), np.uint8)
            self.unpacked += 1
        return self.stretches[k]

    def _plane(self, level: int) -> np.ndarray:
        return np.concatenate([self._bytes(level, k) for k in range(self.wide)])

    def _before(self, level: int, block: int) -> int:
        """Ones before a block (or all, for the one after the last)."""
        if block * BLOCK >= self.n:
            return self.n - self.zeros[level]
        coarse, fine, _ = self.ranks[level]
        return int(coarse[block * BLOCK // STRETCH]) + int(fine[block])

    def _ones(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        if at >= self.n:
            return self.n - self.zeros[level]
        block = at // BLOCK
        part = self._bytes(level, at // STRETCH)
        first, last = block * BLOCK % STRETCH // 8, at % STRETCH // 8
        n = self._before(level, block) + int(np.bitwise_count(part[first:last]).sum())
        return n + (int(part[last] >> (8 - at % 8)).bit_count() if at % 8 else 0)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane: its samples bound the blocks, the ranks of blocks are halved, one block is read."""
        samples = self.ranks[level][2][bit]
        low, high = int(samples[k // SAMPLE]), int(samples[k // SAMPLE + 1]) + 1 if k // SAMPLE + 1 < len(samples) else -(-self.n // BLOCK)
        ahead = lambda b: self._before(level, b) if bit else min(b * BLOCK, self.n) - self._before(level, b)
        while high - low > 1:
            mid = (low + high) // 2
            if ahead(mid) <= k:
                low = mid
            else:
                high = mid
        part = self._bytes(level, low * BLOCK // STRETCH)
        first = low * BLOCK % STRETCH // 8
        bits = np.unpackbits(part[first : first + BLOCK // 8])
        return low * BLOCK + int(np.flatnonzero(bits == bit)[k - ahead(low)])

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.levels):
            bit = int(self._bytes(level, at // STRETCH)[at % STRETCH // 8] >> (7 - at % 8)) & 1
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, high: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first ``high`` ids stand after the last plane."""
        low = 0
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` among the first ``at`` ids."""
        low, high = self._range(token, at)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def places(self, token: int) -> np.ndarray:
        """Places of all occurrences: ``select`` of each, plane by plane from the last up."""
        low, high = self._range(token, self.n)
        at = np.arange(low, high)
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            k = at - self.zeros[level] if bit else at
            coarse, fine, _ = self.ranks[level]
            first = np.arange(len(fine)) * BLOCK
            ahead = coarse[first // STRETCH].astype(np.int64) + fine
            if not bit:
                ahead = first - ahead
            block = np.searchsorted(ahead, k, "right") - 1
            plane = np.zeros(len(fine) * BLOCK // 8, np.uint8)
            raw = self._plane(level)
            plane[: len(raw)] = raw if bit else ~raw
            rows = plane.reshape(-1, BLOCK // 8)[block]
            sums = np.cumsum(_ONES[rows], 1, dtype=np.int32)
            left = k - ahead[block]
            byte = (sums <= left[:, None]).sum(1)
            left -= np.where(byte > 0, sums[np.arange(len(k)), byte - 1], 0)
            bits = np.cumsum(np.unpackbits(rows[np.arange(len(k)), byte][:, None], axis=1), 1, dtype=np.int32)
            at = block * BLOCK + byte * 8 + (bits <= left[:, None]).sum(1)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1) if self.n else ():
            one = np.unpackbits(self._plane(level), count=self.n).view(bool)
            up, z = np.empty_like(now), self.zeros[level]
            now[z:] |= kind(1 << (self.levels - 1 - level))
            up[np.flatnonzero(~one)] = now[:z]
            up[np.flatnonzero(one)] = now[z:]
            now = up
        return now

    def check(self, end_id: int) -> None:
        """Every document ends where select places the end id, and rank counts as many there. Raises where the file contradicts itself."""
        found = self.places(end_id)
        last = np.cumsum(self.counts) - 1
        at = np.searchsorted(found, last)
        if sum(self.counts) != self.n or len(found) != self.count(end_id) or (at >= len(found)).any() or (found[at] != last).any():
            raise ValueError("the documents' counts and the planes differ")
        for k in {0, len(found) // 2, len(found) - 1} if len(found) else ():
            if self.select(end_id, k) != found[k] or self.rank(end_id, int(found[k])) != k or self.access(int(found[k])) != end_id:
                raise ValueError("the directories and the planes differ")


class Encoder:
    """The tokenizers library over the stretches between blanks, each remembered.

    This holds for files whose pre-tokens cross no white space, join no letters or digits with marks, and do not depend on the case of ASCII
    letters; a file is probed for that when it is loaded, and with any other the library gets whole texts. Where it holds, a stop or comma after a letter or digit may stand apart, a plain ASCII word is known by its lower-case
    form, and many plain words go to the library as one text, whose ids are parted where a token ends a word. Words that the file's
    normalizer leaves as they are go to a copy without it. Two generations are kept, of ``limit`` pieces each; a piece of the
    older one that is met again moves to the newer.
    """

    #: A stop or comma after anything but a blank, a digit or an old letter: the text's stops and commas stay where they are.
    JOINED = r"[^A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F} \n][.,]"

    def __init__(self, path: str, limit: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        self.size = self.of.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.of.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(self.of.get_vocab().values()) + 1, bool)
        for token, i in self.of.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.parted = bool(suffix) and self.parts()
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit

    def parts(self) -> bool:
        """Whether texts may be cut at blanks and marks, and ASCII words be lower-cased."""
        of = lambda x: self.of.encode(x, add_special_tokens=False).ids
        words = ("a", "the", "Alpha", "ZED", "Bravo", "don", "x", "7", "42", "naïve", "слово", "字")
        marked = all(of(w + m) == of(w) + of(m) and of(m + w) == of(m) + of(w) for w in words for m in (".", ",") if w != "don")
        blanks = all(of(f"{a}{gap}{b}") == of(a) + of(b) for a in words for b in words for gap in (" ", "\n", "  "))
        return marked and blanks and all(of(w) == of(w.lower()) for w in words if w.isascii())

    def words(self, tokenizer, words: list[str]) -> list[str]:  # noqa: ANN001
        """Learns plain words; gives back those that the library does not take as one word each."""
        if not words:
            return []
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(words):
            return words
        raw, at = ids.tobytes(), 0
        for word, stop in zip(words, stops.tolist(), strict=True):
            self.known[word] = raw[at:stop]
            at = stop
        return []

    def learn(self, pieces: set[str]) -> None:
        known, old, same, other, odd, built = self.known, self.old, set(), [], [], []
        for piece in pieces:
            got = old.get(piece)
            if got is not None:
                known[piece] = got
            elif not piece.isalpha():
                odd.append(piece)
            elif piece.isascii():
                low = piece.lower()
                if low != piece:
                    built.append((piece, low))
                if low not in known:
                    same.add(low)
            elif piece == piece.lower() and unicodedata.is_normalized("NFC", piece):
                same.add(piece)
            else:
                other.append(piece)
        odd += self.words(self.plain, list(same)) + self.words(self.of, other)
        for piece, got in zip(odd, self.of.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[piece] = np.asarray(got.ids, "<u4").tobytes()
        for piece, low in built:
            known[piece] = known[low]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text).

        Arrow cuts the texts and numbers their distinct pieces; each distinct piece is looked up once for the whole batch.
        """
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        known = self.known
        texts = pc.fill_null(texts, "")
        if not self.parted:
            each = [np.asarray(x.ids, "<u4") for x in self.of.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        apart = pc.replace_substring(pc.replace_substring(texts, ".", " ."), ",", " ,")
        texts = pc.if_else(pc.match_substring_regex(texts, self.JOINED), texts, apart)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(known.get, names))
        asked = {x for x, y in zip(names, got, strict=True) if y is None}
        if asked:
            self.learn(asked)
            got = list(map(known.__getitem__, names))
            for piece in asked:
                if len(piece) > 256:
                    known.pop(piece, None)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        first = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        n = size[index]
        ends = np.cumsum(n)
        at = np.repeat(first[index] - (ends - n), n)
        at += np.arange(len(at))
        bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy()]
        return flat[at], np.diff(bounds)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Encoder:
    return Encoder(path)


SHARDS = "part int, before long, n_tokens long, blob binary"
SHARDS_ARROW = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])


def write(docs: DataFrame, path: str, out: str, *, end_id: int = 1, shard_tokens: int = 1 << 20, partitions: int | None = None) -> None:
    """Write shards of ``docs`` (doc_id, text) as a Parquet folder of blobs: part, tokens before in the part, n_tokens, blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = loaded(path), TaskContext.get().partitionId()
        levels = max(1, max(enc.size - 1, end_id).bit_length())
        kind = np.uint16 if levels <= 16 else np.uint32
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        counts: list[int] = []
        n = before = 0

        def flush() -> pa.RecordBatch:
            blob = pack(ids, counts, np.concatenate(held).astype(kind), levels)
            return pa.RecordBatch.from_pydict({"part": [part], "before": [before], "n_tokens": [n], "blob": [blob]}, schema=SHARDS_ARROW)

        for batch in small(batches):
            got, own = enc.encode_all(batch.column(1))
            with_end = np.full(len(got) + len(own), end_id, got.dtype)
            with_end[np.arange(len(got)) + np.repeat(np.arange(len(own)), own)] = got
            stops = np.cumsum(own + 1).tolist()
            at = first = 0
            for k, (doc, stop) in enumerate(zip(batch.column(0).to_pylist(), stops, strict=True)):
                ids.append(doc)
                counts.append(stop - at)
                n += counts[-1]
                at = stop
                if n >= shard_tokens or k == len(stops) - 1:
                    held.append(with_end[first:stop])
                    first = stop
                if n >= shard_tokens:
                    yield flush()
                    before, n, held, ids, counts = before + n, 0, [], [], []
        if ids:
            yield flush()

    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(out)


READ = "part int, before long, doc_id long, n_tokens long, ids_crc32 long, ids binary"
READ_ARROW = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def read(spark, out: str, *, end_id: int = 1, keep_ids: bool = False) -> DataFrame:  # noqa: ANN001
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document in a folder that ``write`` made; each shard's documents are first
    held against the places of the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, blob in (tuple(batch.column(c)[k].as_py() for c in range(3)) for k in range(batch.num_rows)):
                shard = Shard(blob)
                shard.check(end_id)
                raw = memoryview(shard.tokens().astype("<u4").tobytes())
                at, rows = 0, []
                for doc, n in zip(shard.docs, shard.counts, strict=True):
                    own = raw[at * 4 : (at + n) * 4]
                    rows.append((part, before + at, doc, n, zlib.crc32(own), bytes(own) if keep_ids else None))
                    at += n
                yield pa.RecordBatch.from_pydict(dict(zip(READ_ARROW.names, map(list, zip(*rows, strict=True)), strict=True)), schema=READ_ARROW)

    stored = spark.read.schema(SHARDS).parquet(out)
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each part of the write
    ahead = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    rows = stored.select("part", "before", "blob").mapInArrow(run, READ)
    cols = ["doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.join(F.broadcast(ahead), "part").select(*cols, *(["ids"] if keep_ids else []))
