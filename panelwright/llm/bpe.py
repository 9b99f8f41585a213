"""Byte-pair encoding by speculation and verification, and decoding.

A word is first cut by greedy longest match against the vocabulary. That guess is right exactly
when every adjacent pair of its tokens is *compatible*, that is, when byte-pair merging of the
two joined strings gives back these two tokens. All pairs of a batch are tested at once
against a sorted table of known pairs; unknown pairs are worked out once and remembered. Only
words with a failing pair are merged exactly.

Texts are cut into words first (normalised, lower-cased, split). A task remembers the words it has met
lately, so the cost per word of running text is a dictionary look-up for all but rare words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words a task remembers before those not met since the last turn go; bounds its memory only.
MEMORY = 100_000
#: Pairs of tokens it remembers.
PAIRS = 200_000
#: Words learnt together (texts stay whole).
CHUNK = 50_000
#: Texts of a batch taken out of Arrow together.
ROWS = 1_000

#: Symbols of a word beyond which merging keeps its pairs in a heap; short words are faster without.
LONG = 100

# Fixed by the vocabulary's format: the cut into words. White space only separates.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters and digits younger than Unicode 16, which the vocabulary's cutter takes for
# signs, and capitals younger than Python's tables with the distance to their small letters.
YOUNG = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed
1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
CAPITALS = {
    "1c89": 1, "a7cb": 0x264 - 0xA7CB, "a7cc": 1, "a7ce": 1, "a7d2": 1, "a7d4": 1, "a7da": 1,
    "a7dc": 0x19B - 0xA7DC, "10d50-10d65": 32, "16ea0-16eb8": 27,
}


def _span(text: str) -> range:
    first, _, last = text.partition("-")
    return range(int(first, 16), int(last or first, 16) + 1)


def _class(spans: Iterable[str]) -> str:
    """The inside of a character class."""
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in map(_span, spans))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _near_words() -> str:
    """The cut into words for texts below ``FAR``, spelled out so that the faster matcher can run it."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "Z": []}
    for c in map(chr, range(FAR)):
        kind = "Z" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind].append(c)
    letter, number, space = ("".join(map(re.escape, kinds[k])) for k in "LNZ")
    return f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{space}{letter}{number}]+"


#: Below this code point all tables agree, and one class holds the alphabets of western languages.
FAR = 0x558


class Codec:
    """Encoder and decoder of one vocabulary file (byte-level BPE with word ends)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.pieces = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(map(len, self.vocab))
        self.alphabet = dict(enumerate(byte_alphabet()))
        young = _class(YOUNG.split())
        self.near = re.compile(_near_words())
        self.far = re.compile(f"[\\U{FAR:08x}-\U0010ffff]")
        self.words = regex.compile(WORDS)
        self.careful = regex.compile(
            WORDS.replace(r"[\p{L}]", rf"[\p{{L}}--[{young}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{young}]]")
            .replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{young}])"), regex.V1,
        )
        self.rare = re.compile(f"[{young}{_class(CAPITALS)}]")
        self.small = {c: c + step for span, step in CAPITALS.items() for c in _span(span)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.compatible: dict[int, bool] = {}
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.turn()

    def turn(self) -> None:
        """Start afresh; words met again before the next turn come back, the others are forgotten by it."""
        self.past = self.ids, self.shown
        self.ids, self.shown = {}, {}

    # -- words ------------------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        """Normalise, lower-case and cut."""
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:  # lower-casing goes character by character here: no final sigma
            text = text.replace("\u03a3", "\u03c3")
        if text.isascii() or not self.far.search(text):
            return self.near.findall(text.lower())
        if not self.rare.search(text):
            return self.words.findall(text.lower())
        return self.careful.findall(text.lower().translate(self.small))

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens are found in the raw text and stay whole."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._words(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out.extend([part] if i % 2 else self._words(part))
        return out

    def symbols(self, word: str) -> str:
        """One printable character per byte."""
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)

    # -- exact merging ------------------------------------------------------------

    def base(self, symbols: str) -> list[int]:
        """The ids merging starts from; the last one carries the word's end."""
        return [*map(self.vocab.__getitem__, symbols[:-1]), self.vocab[symbols[-1] + self.suffix]]

    def merge(self, ids: list[int], log: dict[int, tuple[int, int, int]] | None = None) -> list[int]:
        """Exact merging: always the best-ranked adjacent pair, leftmost first."""
        merges = self.merges
        if log is None and len(ids) > LONG:
            return self._merge_long(ids)
        pairs = [merges.get(p) for p in zip(ids, ids[1:])]
        while True:
            found = [p for p in pairs if p is not None]
            if not found:
                return ids
            best = min(found)
            i = pairs.index(best)
            if log is not None:
                log[best[1]] = (best[0], ids[i], ids[i + 1])
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get((ids[i - 1], ids[i]))
            if i < len(pairs):
                pairs[i] = merges.get((ids[i], ids[i + 1]))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap of pairs over a linked list. A pair that has changed since is passed over."""
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*found, i) for i, pair in enumerate(zip(ids, ids[1:])) if (found := merges.get(pair))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return [t for t in ids if t >= 0]

    # -- speculation and verification -----------------------------------------------

    def speculate(self, symbols: str) -> list[int]:
        """Greedy longest match (each symbol itself is in the vocabulary)."""
        vocab, suffix, out, at, n = self.vocab, self.suffix, [], 0, len(symbols)
        while at < n:
            if n - at <= self.longest and (token := vocab.get(symbols[at:] + suffix)) is not None:
                out.append(token)
                break
            end = min(n - 1, at + self.longest)
            while (token := vocab.get(symbols[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def spine(self, token: int) -> tuple[list, list] | None:
        """How a token grows while its bytes are merged, seen from its right and its left edge.

        Each edge is a list of (token at the edge, rank of the merge that swallows it), the last
        with an infinite rank. None if merging its bytes does not give the token.
        """
        if token in self.spines:
            return self.spines[token]
        piece = self.pieces[token]
        closed = bool(self.suffix) and piece.endswith(self.suffix)
        symbols = piece[: len(piece) - len(self.suffix)] if closed else piece
        log: dict[int, tuple[int, int, int]] = {}
        ids = self.base(symbols) if closed else [*map(self.vocab.__getitem__, symbols)]
        edges = None
        if self.merge(ids, log) == [token]:
            edges = ([(token, math.inf)], [(token, math.inf)])
            for side, edge in zip((2, 1), edges):
                at = token
                while at in log:
                    rank, at = log[at][0], log[at][side]
                    edge.append((at, rank))
                edge.reverse()
        self.spines[token] = edges
        return edges

    def pair_ok(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between two adjacent tokens alone.

        At any time the border lies between the then outermost parts of both; it is crossed if
        those can merge at a better rank than the next merge inside either (of equal ranks the
        left one goes first).
        """
        left, right = self.spine(a), self.spine(b)
        if left is None or right is None:
            return False
        left, right, i, j = left[0], right[1], 0, 0
        while True:
            (x, end_x), (y, end_y) = left[i], right[j]
            cross = self.merges.get((x, y))
            if cross is not None and cross[0] < end_x and cross[0] <= end_y:
                return False
            if end_x == end_y == math.inf:
                return True
            if end_x <= end_y:
                i += 1
            else:
                j += 1

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words: guess all, test all adjacent pairs together, merge the failures."""
        past, shown = self.past
        words = [w for w in words if w not in self.ids]
        for w in words:
            if w in past:
                self.ids[w], self.shown[w] = past[w], shown[w]
        words = [w for w in words if w not in past]
        if not words:
            return
        if len(self.compatible) > PAIRS:
            self.compatible = {}
        symbols = [self.symbols(w) for w in words]
        guesses = [[self.special[w]] if w in self.special else self.speculate(s) for w, s in zip(words, symbols)]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        known = self.compatible
        for p in pairs.tolist():
            if p not in known:
                known[p] = self.pair_ok(p >> 32, p & 0xFFFFFFFF)
        fine = np.fromiter(map(known.__getitem__, pairs.tolist()), bool, len(pairs))
        failing = np.zeros(len(guesses), bool)
        failing[owner[inner[~fine[which]]]] = True
        # a guess of one token has no pair: it holds if merging can reach that token at all
        for k in np.flatnonzero(sizes == 1).tolist():
            failing[k] = words[k] not in self.special and self.spine(guesses[k][0]) is None
        for k in np.flatnonzero(failing).tolist():
            guesses[k] = self.merge(self.base(symbols[k]))
        pieces = self.pieces
        for word, guess in zip(words, guesses):
            self.ids[word] = struct.pack(f"<{len(guess)}I", *guess)
            self.shown[word] = " ".join([pieces[i] for i in guess])

    # -- texts --------------------------------------------------------------------

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, int, list[str]]]:
        """Per text: ids as little-endian unsigned 32-bit integers, their number, its words."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and size < CHUNK:
                cut.append(self.split(texts[at]))
                size += len(cut[-1])
                at += 1
            if len(self.ids) > MEMORY:
                self.turn()
            self.learn(dict.fromkeys(chain.from_iterable(cut)))
            for words in cut:
                coded = b"".join(map(self.ids.__getitem__, words))
                yield coded, len(coded) // 4, words

    def decode_words(self, words: list[str]) -> str:
        """What decoding the words' ids gives: this format has no decoder, tokens are joined by spaces."""
        return " ".join(map(self.shown.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit, binary) and ``decoded``.

    ``vocabulary`` is a file on the driver; it travels with the job as a broadcast of its size
    (1.7 MB). A null or empty text has no ids and decodes to an empty text. Repeated rows are
    coded one by one; other columns are not read. With ``with_ids`` false, ``ids_sha256`` and
    ``decoded_sha256`` stand for the two long columns.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()

    def code(batches):
        codec = Codec(spec.value)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, left, right = [], [], []
            for ids, n, words in codec.encode(texts):
                decoded = codec.decode(ids) if with_ids else codec.decode_words(words)
                counts.append(n)
                left.append(ids if with_ids else hashlib.sha256(ids).hexdigest())
                right.append(
                    decoded if with_ids else hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()),
                 pa.array(left, pa.binary() if with_ids else pa.string()), pa.array(right, pa.string())],
                names=["doc_id", "n_tokens", *names],
            )

    names = ["ids", "decoded"] if with_ids else ["ids_sha256", "decoded_sha256"]
    schema = f"doc_id {id_type}, n_tokens bigint, {names[0]} {'binary' if with_ids else 'string'}, {names[1]} string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(code, schema)
