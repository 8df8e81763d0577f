"""Benchmark decontamination by SimHash over item-sized windows.

A window of a document is as long (in words) as a benchmark item. For every item the weight that a window shares with it, as multisets, is known
at every start of the document (``overlaps``), and windows that share less than the threshold's part of the item's weight are left out, because no similarity can
reach the threshold there. Each other window and each item has a 128-bit SimHash of its weighted shingles. Multi-index
Hamming lookup: the fingerprint is cut into eight blocks of 16 bits; within ``radius`` 31 at least one block differs in three bits or
fewer, so looking up each block's neighbourhood finds every fingerprint within the radius. Candidates are then verified by exact weighted
Jaccard similarity of the shingle multisets; a shingle weighs as many as its words have characters.

Rows: doc_id, item_id, start_word, n_words, hamming, similarity, start_char, end_char; for one item, windows that overlap a
better one are left out (ties: the first). Words are ``\\w+`` of the lower-cased text, shingles five words; an item of one to
four words is one shingle of its length. Null, empty and wordless texts and items match nothing. Repeated rows are matched each. Items are
broadcast in slices of about ``slice_chars`` characters (one item at least), which bounds their words in any script, so a benchmark of any size is
scanned in bounded memory; slices are read in turn. Windows are fingerprinted and looked up ``WINDOWS`` at a time and meetings of shingles ``HITS`` at a time, so a very long text takes
memory for its words alone, whatever it repeats. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import SHINGLE, SIMILARITY, WORD, WordHashes, map_rows, mixed, shingles, small, word_hashes, worker_words

BLOCKS, WIDTH, RADIUS = 8, 16, 31
SPREAD = RADIUS // BLOCKS
#: Of the SPREAD bits so many are changed in the items' blocks when the index is built, the others in a window's.
STORED = 1
WINDOWS, HITS, ITEM = 2048, 1 << 18, 60


@functools.lru_cache(maxsize=4)
def neighbourhood(bits: int) -> np.ndarray:
    """Masks of at most ``bits`` of 16 bits."""
    return np.array([sum(1 << b for b in own) for k in range(bits + 1) for own in itertools.combinations(range(WIDTH), k)], np.uint16)


def signs(grams: np.ndarray) -> np.ndarray:
    """(n, 128) of 1 and -1."""
    two = np.stack([grams, mixed(grams + np.uint64(0x9E3779B97F4A7C15))], 1)
    return np.unpackbits(np.ascontiguousarray(two).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """(n, 8) blocks of 16 bits."""
    return np.packbits(totals > 0, axis=1).view(np.uint16)


def weights(lengths: np.ndarray, k: int) -> np.ndarray:
    """Characters of each run of k words."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    return total[k:] - total[:-k]


@dataclass
class Grams:
    """The items' shingles of one length: sorted names with their weights, and for each a run of (item, times)."""

    names: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    seen: np.ndarray


@dataclass
class Index:
    ids: list
    sizes: np.ndarray
    weights: np.ndarray
    prints: np.ndarray
    places: dict[int, Grams]
    starts: list[np.ndarray]
    owners: list[np.ndarray]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        masks, found = neighbourhood(SPREAD - STORED), []
        for b in range(BLOCKS):
            value = (prints[:, b, None] ^ masks).ravel()
            first, n = self.starts[b][value], self.starts[b][value.astype(np.int64) + 1]
            n = n - first
            hit = np.flatnonzero(n)
            if len(hit):
                n = n[hit]
                at = np.repeat(first[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                found.append(np.repeat(hit // len(masks), n) * len(self.ids) + self.owners[b][at])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        w, i = pairs // len(self.ids), pairs % len(self.ids)
        d = np.bitwise_count(prints[w] ^ self.prints[i]).sum(1)
        ok = d <= RADIUS
        return w[ok], i[ok], d[ok]


def index(items: list[tuple[object, str | None]]) -> Index | None:
    known = WordHashes()
    ids, sizes, total, prints = [], [], [], []
    by_k: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
    for item, text in items:
        words = word_hashes(text, known)
        if not len(words):
            continue
        k = min(SHINGLE, len(words))
        g = shingles(words)
        w = weights(np.array([len(x) for x in WORD.findall(text.lower())]), k)
        by_k.setdefault(k, []).append((g, w, len(ids)))
        ids.append(item)
        sizes.append(len(words))
        total.append(int(w.sum()))
        prints.append(fingerprints(sum((signs(g[at : at + WINDOWS]) * w[at : at + WINDOWS, None]).sum(0, keepdims=True, dtype=np.float64) for at in range(0, len(g), WINDOWS)))[0])
    if not ids:
        return None
    places = {}
    for k, held in by_k.items():
        flat, heavy = (np.concatenate([h[x] for h in held]) for x in (0, 1))
        item = np.concatenate([np.full(len(g), i) for g, _, i in held])
        order = np.lexsort((item, flat))
        flat, heavy, item = flat[order], heavy[order], item[order]
        new = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]))))
        names, first = np.unique(flat[new], return_index=True)
        seen = np.zeros(1 << 20, bool)
        seen[names & np.uint64((1 << 20) - 1)] = True
        places[k] = Grams(names, heavy[new][first], np.append(first, len(new)), item[new], np.diff(np.append(new, len(flat))), seen)
    prints_ = np.array(prints)
    starts, owners = [], []
    masks = neighbourhood(STORED)
    for b in range(BLOCKS):
        value = (prints_[:, b, None] ^ masks).ravel()
        order = np.argsort(value, kind="stable")
        starts.append(np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)))
        owners.append((order // len(masks)).astype(np.int32))
    return Index(ids, np.array(sizes), np.array(total), prints_, places, starts, owners)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def overlaps(g: np.ndarray, held: Grams, ix: Index, n_words: int, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, start, shared weight) of all windows that share ``least`` of the item's weight or more, by items.

    An item of which the whole document holds too little is left out first. For the rest, of a shingle that an item has r times an occurrence counts
    in the windows that hold it and hold fewer than r occurrences before it: one stretch of starts. Summing the stretches' ends gives the shared weight at every start."""
    if n_words < k:
        return
    spot = np.flatnonzero(held.seen[g & np.uint64((1 << 20) - 1)])
    at = np.searchsorted(held.names, g[spot])
    at[at == len(held.names)] = 0
    ok = held.names[at] == g[spot]
    spot, at = spot[ok], at[ok]
    if not len(spot):
        return
    order = np.argsort(at, kind="stable")
    spot, at = spot[order], at[order]
    grams, begun, often = np.unique(at, return_index=True, return_counts=True)
    n = held.first[grams + 1] - held.first[grams]
    entry = spread(held.first[grams], n)
    gram = np.repeat(np.arange(len(grams)), n)
    item, times = held.item[entry], np.minimum(held.times[entry], often[gram])
    heavy = held.weight[grams][gram]
    need = least * ix.weights - 1e-9
    whole = np.bincount(item, weights=times * heavy, minlength=len(ix.ids)) >= need
    mine = np.flatnonzero(whole[item])
    mine = mine[np.argsort(item[mine], kind="stable")]
    item, gram, times, heavy = item[mine], gram[mine], times[mine], heavy[mine]
    hits = np.cumsum(often[gram])
    low = 0
    while low < len(item):
        high = int(np.searchsorted(hits, (hits[low - 1] if low else 0) + HITS, "right"))
        high = int(np.searchsorted(item, item[max(high - 1, low)], "left")) if high < len(item) else high
        high = high if high > low else int(np.searchsorted(item, item[low], "right"))
        own = slice(low, high)
        low = high
        n = often[gram[own]]
        place = spread(begun[gram[own]], n)  # into spot, which is sorted by gram and place
        which = np.repeat(np.arange(len(n)), n)
        i, r = item[own][which], times[own][which]
        p, nth = spot[place], place - begun[gram[own]][which]
        before = np.where(nth >= r, spot[place - np.minimum(nth, r)], -1)
        size = np.minimum(ix.sizes[i], n_words)
        start = np.maximum(np.maximum(before, p - (size - k + 1)) + 1, 0)
        stop = np.minimum(p, n_words - size) + 1
        ok = start < stop
        i, start, stop, w = i[ok], start[ok], stop[ok], heavy[own][which][ok]
        ends, owner, change = np.concatenate((start, stop)), np.concatenate((i, i)), np.concatenate((w, -w))
        order = np.lexsort((ends, owner))
        ends, owner, total = ends[order], owner[order], np.cumsum(change[order])
        long = np.append(np.where(owner[1:] == owner[:-1], np.diff(ends), 0), 0)
        keep = np.flatnonzero((long > 0) & (total >= need[owner]))
        if len(keep):
            yield np.repeat(owner[keep], long[keep]), spread(ends[keep], long[keep]), np.repeat(total[keep], long[keep])


def prints_of(g: np.ndarray, w: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of shingles from ``begin`` (sorted) to ``stop``, 16 bits of the stretch that they cover at a time."""
    low, high = int(begin.min()), int(stop.max())
    two = np.stack([g[low:high], mixed(g[low:high] + np.uint64(0x9E3779B97F4A7C15))], 1)
    octets, out = np.ascontiguousarray(two).view(np.uint8), np.empty((len(begin), BLOCKS), np.uint16)
    for b in range(BLOCKS):
        total = np.zeros((high - low + 1, WIDTH), np.int64)
        plus = np.unpackbits(octets[:, 2 * b : 2 * b + 2], axis=1).astype(np.int64) * 2 - 1
        np.cumsum(plus * w[low:high, None], axis=0, out=total[1:])
        out[:, b] = np.packbits(total[stop - low] > total[begin - low], axis=1).view(np.uint16)[:, 0]
    return out


def matches(text: str | None, ix: Index, known: WordHashes, least: float) -> list[tuple]:
    words = word_hashes(text, known)
    out: list[tuple] = []
    spans, lengths = None, None
    for k, held in ix.places.items():
        g = shingles(words, k)
        for item, start, shared in overlaps(g, held, ix, len(words), k, least) if len(g) else ():
            if spans is None:
                spans = np.fromiter((x for m in WORD.finditer(text.lower()) for x in m.span()), np.int64).reshape(-1, 2)
                lengths = spans[:, 1] - spans[:, 0]
            w = weights(lengths, k)
            weigh = np.concatenate(([0], np.cumsum(w)))
            size = np.minimum(ix.sizes[item], len(words))
            windows, of = np.unique(np.stack([size, start], 1), axis=0, return_inverse=True)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(windows) + 1))
            got = []
            low = 0
            while low < len(windows):
                high = min(low + WINDOWS, int(np.searchsorted(windows[:, 0], windows[low, 0], "right")))
                own_size, begin = windows[low:high].T
                stop = begin + own_size - k + 1
                a, near, distance = ix.near(prints_of(g, w, begin, stop))
                # the pairs that both the lookup and the shared weight name; their similarity is exact
                pair = order[ends[low] : ends[high]]
                name = (of[pair] - low) * len(ix.ids) + item[pair]
                by = np.argsort(name, kind="stable")
                key = a * len(ix.ids) + near
                at = np.minimum(np.searchsorted(name[by], key), len(name) - 1)
                ok = name[by][at] == key
                pair, distance = pair[by][at[ok]], distance[ok]
                all_of = weigh[start[pair] + size[pair] - k + 1] - weigh[start[pair]]
                same = shared[pair] / (all_of + ix.weights[item[pair]] - shared[pair])
                ok = same >= least - 1e-12
                got.append((item[pair][ok], -same[ok], start[pair][ok], size[pair][ok], distance[ok]))
                low = high
            got = [np.concatenate(x) for x in zip(*got, strict=True)]
            taken: dict[int, list[int]] = {}
            for i, s, begin, n, d in zip(*(x[np.lexsort(got[2::-1])].tolist() for x in got), strict=True):
                mine = taken.setdefault(i, [])
                at = bisect.bisect_left(mine, begin)
                if (at == len(mine) or begin + n <= mine[at]) and (at == 0 or mine[at - 1] + n <= begin):
                    mine.insert(at, begin)
                    out.append((ix.ids[i], begin, n, d, -s, int(spans[begin, 0]), int(spans[begin + n - 1, 1])))
    return out


SCHEMA = "doc_id long, item_id long, start_word long, n_words long, hamming long, similarity double, start_char long, end_char long"
ARROW = pa.schema([(n, pa.float64() if n == "similarity" else pa.int64()) for n in ("doc_id", "item_id", "start_word", "n_words", "hamming", "similarity", "start_char", "end_char")])


def slices_of(benchmark: DataFrame, slice_chars: int) -> Iterator[Index | None]:
    """Indexes over the benchmark, each of about ``slice_chars`` characters, where every item counts ``ITEM`` more for its fingerprint's places; what is collected for one is bounded by that."""
    sized = benchmark.select("item_id", "text").filter("text is not null")
    chars = sized.agg(F.sum(F.length("text").cast("long") + ITEM)).first()[0] or 0
    slices = max(1, -(-int(chars) * 5 // (slice_chars * 4)))
    for k in range(slices):
        mine = sized if slices == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        yield index([tuple(r) for r in mine.orderBy("item_id", "text").collect()])


def find(docs: DataFrame, benchmark: DataFrame, *, least: float = SIMILARITY, slice_chars: int = 12_000_000) -> DataFrame:
    """All contaminated spans; one scan of ``docs`` for each slice of the benchmark, no shuffle."""
    return functools.reduce(DataFrame.unionByName, [_scan(docs, ix, least) for ix in slices_of(benchmark, slice_chars)])


def _scan(docs: DataFrame, ix: Index | None, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(ix)

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        if sent.value is not None:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, *m) for m in matches(text, sent.value, worker_words(), least)]
        return dict(zip(ARROW.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in ARROW.names}

    return map_rows(docs.select("doc_id", "text"), run, SCHEMA, ARROW)


def clean(docs: DataFrame, benchmark: DataFrame, *, least: float = SIMILARITY, slice_chars: int = 12_000_000) -> DataFrame:
    """The rows of ``docs`` without a contaminated span, with the columns they had; rows are judged where they are read, no shuffle."""
    at = docs.columns.index("text")
    for ix in slices_of(benchmark, slice_chars):
        if ix is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in small(batches):
                yield batch.filter(pa.array([not matches(t, sent.value, worker_words(), least) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
