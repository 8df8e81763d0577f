"""BPE encoding and decoding.

Each pre-token is a doubly linked list of symbols. A priority queue holds (rank, position) of every adjacent pair that
has a merge rank; popping the smallest merges the pair in place, unlinks its right half and queues the two new pairs.
An entry whose symbols have changed since it was queued is stale and is skipped. Decoding concatenates vocabulary
strings. The tokenizer file (a ``tokenizers`` JSON with a byte alphabet, NFC + lower case, and an end-of-word suffix)
is a parameter and is read in each worker, so nothing of it is shipped or copied.

Which characters are letters, digits or blanks, and how they are lowered and composed, is taken from this interpreter's Unicode tables for the
characters that they assign, which is stable between versions. For all others the ``tokenizers`` library is asked, character by character, once a worker.

Null and empty texts have no ids. Repeated rows are encoded each; extra columns pass by. Ties cannot occur: equal ranks
mean the same pair, and the leftmost position is merged first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from symloom.llm.common import held, map_rows


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it is visible Latin-1, else the next free one from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Classes(dict):
    """Character -> itself, or for one that this interpreter's tables do not assign, a character of the class that the library gives it."""

    #: Unicode classes, and a character of each that no pattern names by itself.
    SHOWN = ((r"\p{L}", "é"), (r"\p{N}", "²"), (r"\s", "\u2003"))

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Regex, Tokenizer, normalizers

        whole = Tokenizer.from_file(path).normalizer
        self.normal = whole.normalize_str if whole is not None else str
        self.marks = [normalizers.Replace(Regex(pattern), shown) for pattern, shown in self.SHOWN]

    def __missing__(self, c: str) -> str:
        got = c
        if unicodedata.category(c) == "Cn":
            got = next((shown for mark, (_, shown) in zip(self.marks, self.SHOWN, strict=True) if mark.normalize_str(c) == shown), "\uffff")
        self[c] = got
        return got

    def knows(self, text: str) -> bool:
        return text.isascii() or all(self[c] == c for c in text)


class Pieces(dict):
    """Stretch of raw text without blanks -> its ids. Two generations of at most ``limit`` are kept; what is met again moves to the newer.

    Letters and marks are never one pre-token and ASCII case does not matter, so a plain word with a last mark is its word
    and its mark, and a plain ASCII word is its lower-case form.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        got = self.old.get(piece)
        if got is not None:
            self[piece] = got
            return got
        word, mark = piece[:-1], piece[-1:]
        if mark in (".", ",") and word.isalpha():
            got = self[word] + self[mark]
        elif piece.isascii() and piece.isalpha() and (low := piece.lower()) != piece:
            got = self[low]
        else:
            got = self.encode(piece)
        if len(piece) <= 256:
            self[piece] = got
        return got


def refuse(spec: dict, path: str) -> None:
    """Raises where a file asks for steps that are not taken here; ids would silently differ."""
    kinds = lambda part, many: [x["type"] for x in (part or {}).get(many, [part] if part else [])]
    model = spec["model"]
    odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or odd or kinds(spec["normalizer"], "normalizers") != ["NFC", "Replace", "Lowercase"] or kinds(spec["pre_tokenizer"], "pretokenizers") != ["Split", "ByteLevel"] or spec["decoder"]:
        raise ValueError(f"{path}: not a file of byte-alphabet BPE over words of NFC, lower-cased text")


class Bpe:
    """``limit`` bounds the cache of encoded pieces."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec, path)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids.update(special)
        self.strings = [""] * (max(self.ids.values()) + 1)
        for s, i in self.ids.items():
            self.strings[i] = s
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left in self.ids and right in self.ids and left + right in self.ids:
                self.ranks[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.special = special
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.alphabet = byte_alphabet()
        self.classes = Classes(path)
        self.pieces = Pieces(self.piece, limit)

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        live = [True] * n
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (found := self.ranks.get((symbols[i], symbols[j]))):
                heapq.heappush(queue, (found[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i] if live[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # stale
            symbols[i] = self.ranks[a, b][1]
            live[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        out, i = [], 0
        while 0 <= i < n:
            out.append(symbols[i])
            i = right[i]
        return out

    def split(self, text: str) -> list[str]:
        """Pre-tokens."""
        shown = text if text.isascii() else "".join(map(self.classes.__getitem__, text))
        return [text[m.start() : m.end()] for m in self.words.finditer(shown)]

    def piece(self, raw: str) -> bytes:
        """Little-endian 32-bit ids of a stretch of raw text that holds no plain blank at a cut."""
        out: list[int] = []
        for part in self.cut_special.split(raw) if self.cut_special else [raw]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if self.classes.knows(part):
                # each character is lowered on its own: a final capital sigma has no word-end form
                text = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            else:
                text = self.classes.normal(part)
            for word in self.split(text):
                symbols = [self.alphabet[b] for b in word.encode("utf-8", "replace")]
                symbols[-1] += self.suffix
                out += self.merge([self.ids[s] for s in symbols if s in self.ids])
        return np.asarray(out, "<u4").tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """No pre-token crosses white space, so stretches between blanks are encoded (and remembered) on their own."""
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int], between: str = " ") -> str:
        """Vocabulary strings in order. ``between``: the library sets a blank between tokens where a file has no decoder."""
        return between.join(map(self.strings.__getitem__, ids))


def loaded(path: str) -> Bpe:
    return held(f"bpe {path}", lambda: Bpe(path))


SCHEMA = "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str, *, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit; null unless ``keep_ids``), n_tokens and digests of ids and decoded text.

    One scan, no shuffle: a document is encoded, decoded back and digested where it is read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path)
        packed, n, ids_sha, dec_sha = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode_bytes(text)
            packed.append(ids if keep_ids else None)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            dec_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
        return {"doc_id": batch.column(0), "ids": packed, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": dec_sha}

    return map_rows(docs.select("doc_id", "text"), run, SCHEMA, ARROW)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded from ``encode``'s ids."""

    def run(batch: pa.RecordBatch) -> dict:
        bpe = loaded(path)
        return {"doc_id": batch.column(0), "decoded": [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, decoded string", pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())]))
