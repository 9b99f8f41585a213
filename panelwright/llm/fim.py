"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of ``UNITS`` code points each, with the number of
code points up to the end of every frame. A cut at any place then opens one frame: the frames
between the cuts go into the rearranged text as they are, only the frames that hold a cut are
decompressed, split and packed again. Digests and the way back stream the frames in order, so that
no text is ever laid out whole a second time.

Rows are drawn by a digest of their id alone, so that the result does not depend on the place of a
row, and a rearranged text can be restored from itself and its form.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a frame. Small enough to open cheaply, large enough to pack well.
UNITS = 8192
LEVEL = 3
#: Rows packed or opened together by a task.
ROWS = 200


@dataclass(frozen=True)
class Markers:
    """What stands before each part. Every marker starts with a sign that occurs nowhere else in it,
    so none can arise across a border."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for m in self.all:
            if not m or m[0] in m[1:] or any(m[0] != o[0] for o in self.all) or len(set(self.all)) < 3:
                raise ValueError("markers must differ, and start with one sign that does not occur again in them")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def order(self, form: str) -> tuple[str, ...]:
        """The markers of a form from left to right."""
        return (self.prefix, self.suffix, self.middle) if form == "psm" else (self.suffix, self.prefix, self.middle)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogatepass")


class Press:
    """Packs and opens single frames; one for each task."""

    def __init__(self, units: int = UNITS, level: int = LEVEL):
        self.units = units
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.open = zstandard.ZstdDecompressor().decompress

    def store(self, text: str) -> tuple[list[int], list[bytes]]:
        """Cumulative counts and frames of a text; an empty one has none."""
        starts = range(0, len(text), self.units)
        return [min(s + self.units, len(text)) for s in starts], [self.pack(_bytes(text[s : s + self.units])) for s in starts]

    def select(self, ends: Sequence[int], frames: Sequence[bytes], start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(code points, frame) of what lies between two places; whole frames are not opened."""
        k = bisect_right(ends, start)
        while start < stop:
            first, last = (ends[k - 1] if k else 0), ends[k]
            to = min(stop, last)
            if start == first and to == last:
                yield last - first, frames[k]
            else:
                yield to - start, self.pack(_bytes(_text(self.open(frames[k]))[start - first : to - first]))
            start, k = to, k + 1

    def stream(self, ends: Sequence[int], frames: Sequence[bytes], start: int, stop: int) -> Iterator[bytes]:
        """The same stretch as plain bytes, frame after frame."""
        k = bisect_right(ends, start)
        while start < stop:
            first, last = (ends[k - 1] if k else 0), ends[k]
            to = min(stop, last)
            data = self.open(frames[k])
            yield data if start == first and to == last else _bytes(_text(data)[start - first : to - first])
            start, k = to, k + 1

    def places(self, ends: Sequence[int], frames: Sequence[bytes], signs: Sequence[str]) -> list[int]:
        """Where each sign first stands after the one before it, in code points. Read frame by frame."""
        found, tail, at, k = [], "", 0, 0
        keep = max(map(len, signs)) - 1
        for frame in frames:
            text = tail + _text(self.open(frame))
            base, seen = at - len(tail), 0
            while k < len(signs) and (spot := text.find(signs[k], seen)) >= 0:
                found.append(base + spot)
                seen = spot + len(signs[k])
                k += 1
            at = base + len(text)
            tail = text[max(seen, len(text) - keep) :]
        if k < len(signs):
            raise ValueError("the text lacks a marker of its form")
        return found

    def rearrange(self, ends, frames, form: str, a: int, b: int, markers: Markers) -> tuple[list[int], list[bytes]]:
        """The output of a form as frames of its own."""
        if form == "plain":
            return list(ends), list(frames)
        parts = {markers.prefix: (0, a), markers.middle: (a, b), markers.suffix: (b, ends[-1])}
        counts, out = [], []
        for sign in markers.order(form):
            counts.append(len(sign))
            out.append(self.pack(_bytes(sign)))
            for n, frame in self.select(ends, frames, *parts[sign]):
                counts.append(n)
                out.append(frame)
        total, sums = 0, []
        for n in counts:
            total += n
            sums.append(total)
        return sums, out

    def restore(self, ends, frames, form: str, markers: Markers) -> Iterator[bytes]:
        """The exact text again, from the output and its form alone."""
        whole = ends[-1] if len(ends) else 0
        if form == "plain":
            yield from self.stream(ends, frames, 0, whole)
            return
        signs = markers.order(form)
        spots = self.places(ends, frames, signs)
        parts = {s: (at + len(s), to) for s, at, to in zip(signs, spots, [*spots[1:], whole])}
        for sign in (markers.prefix, markers.middle, markers.suffix):
            yield from self.stream(ends, frames, *parts[sign])


def _sha256(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS,
          markers: Markers = Markers()) -> DataFrame:
    """``doc_id, n, marked, ends, frames`` per row: its text as frames.

    ``n`` counts code points; ``marked`` says that the text holds a marker. Null counts as empty;
    an empty text has no frames. Repeated rows are stored one by one; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    signs = markers.all

    def work(batches):
        press = Press(units)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, marked, ends, frames = [], [], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    held = press.store(text)
                    n.append(len(text))
                    marked.append(any(s in text for s in signs))
                    ends.append(held[0])
                    frames.append(held[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(marked, pa.bool_()),
                     pa.array(ends, pa.list_(pa.int64())), pa.array(frames, pa.list_(pa.binary()))],
                    names=["doc_id", "n", "marked", "ends", "frames"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        work, f"doc_id {kind}, n bigint, marked boolean, ends array<bigint>, frames array<binary>")


def draws(key: Column, salt: str, n: int = 4) -> list[Column]:
    """The first 8-digit groups of the sha256 of ``salt:key`` as unsigned integers; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def choose(stored: DataFrame, salt: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """Adds ``form, prefix_chars, middle_chars``: how a text is to be rearranged, from its id and length alone.

    ``plain`` in a hundred texts stay as they are, as do empty texts and those that hold a marker; of
    the others ``spm`` in a hundred give the suffix first. Both counts are null for plain texts.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), salt)
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    stays = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    return stored.withColumns({
        "form": form,
        "prefix_chars": F.when(~stays, F.least(one, two)),
        "middle_chars": F.when(~stays, F.greatest(one, two) - F.least(one, two)),
    })


def rearranged(chosen: DataFrame, units: int = UNITS, markers: Markers = Markers()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the output's own ``ends, frames``."""
    kind = chosen.schema["doc_id"].dataType.simpleString()
    heads = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def work(batches):
        press = Press(units)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ends, frames = [], []
                forms, first, middle = (part.column(k).to_pylist() for k in (2, 3, 4))
                for k, form in enumerate(forms):
                    cut = first[k] or 0
                    held = press.rearrange(part.column(5)[k].as_py(), part.column(6)[k].as_py(), form, cut, cut + (middle[k] or 0), markers)
                    ends.append(held[0])
                    frames.append(held[1])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:5], pa.array(ends, pa.list_(pa.int64())), pa.array(frames, pa.list_(pa.binary()))],
                    names=[*heads, "ends", "frames"])

    return chosen.select(*heads, "ends", "frames").mapInArrow(
        work, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
        "ends array<bigint>, frames array<binary>")


def _streamed(output: DataFrame, columns: dict[str, str], read) -> DataFrame:
    """The head columns with some that ``read(press, ends, frames, form)`` gives."""
    kind = output.schema["doc_id"].dataType.simpleString()
    heads = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def work(batches):
        press = Press()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                forms = part.column(2).to_pylist()
                got = [read(press, part.column(5)[k].as_py(), part.column(6)[k].as_py(), f) for k, f in enumerate(forms)]
                more = [pa.array(list(c), pa.string()) for c in zip(*got)] if got else [pa.array([], pa.string())] * len(columns)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *more], names=[*heads, *columns])

    return output.select(*heads, "ends", "frames").mapInArrow(
        work, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
        + ", ".join(f"{k} {v}" for k, v in columns.items()))


def digests(output: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``output_sha256`` and ``restored_sha256`` per row: frames streamed in order, and the text rebuilt from them."""

    def read(press, ends, frames, form):
        whole = ends[-1] if ends else 0
        return _sha256(press.stream(ends, frames, 0, whole)), _sha256(press.restore(ends, frames, form, markers))

    return _streamed(output, {"output_sha256": "string", "restored_sha256": "string"}, read)


def texts(output: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """``output`` and ``restored`` per row, as plain text."""

    def read(press, ends, frames, form):
        whole = ends[-1] if ends else 0
        return (_text(b"".join(press.stream(ends, frames, 0, whole))),
                _text(b"".join(press.restore(ends, frames, form, markers))))

    return _streamed(output, {"output": "string", "restored": "string"}, read)


def fill_in_middle(stored: DataFrame, salt: str = "1", plain: int = 10, spm: int = 20, units: int = UNITS,
                   markers: Markers = Markers()) -> DataFrame:
    """Rearranged texts of a frame store (see ``store``), as frames again.

    Cuts lie at code points. An empty text stays plain; very long texts are never laid out whole;
    a null id is drawn like an empty one; repeated rows are treated alike; an empty table gives an
    empty result.
    """
    return rearranged(choose(stored, salt, plain, spm), units, markers)
