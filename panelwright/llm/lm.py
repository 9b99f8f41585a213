"""Language-model scores from a hashed maximum-entropy model.

The probability of a word is that of its class given the history, times that of the word within
its class given the history. Both are softmaxes over sums of hashed features: the word before
and the one two before (a skip), for classes also the pair of both. Every word of a history counts as
itself, by its own hash, whether known or not. Frequent words have classes of ``PER_CLASS`` words by
rank; all others share one class, in which the history chooses among ``PER_CLASS`` groups by hash. Only
within its group does a word's probability come from its count, so that every text has a proper probability.

Training reads all training texts once, in two rounds: a share of ``WARM`` first, then the rest.
In a round every task takes minibatch gradient steps from the shared weights on its own texts;
the weights are then averaged row by row, weighted by how many tokens touched a row. What
travels is a fixed number of weights per task. Token counts cover all training texts; the most
frequent ``KNOWN`` tokens travel to the tasks as a dictionary, and every other token is counted
by a join, so no token is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stash, unit_draw

CLASSES, PER_CLASS = 32, 32
HEAD = CLASSES * PER_CLASS  # words with a class of their own, by rank
KNOWN = 100_000  # tokens whose counts travel as a dictionary
SLOTS = 1 << 15
WARM, RATE, BATCH, CHUNK = 0.125, 0.15, 16_384, 65_536
END = b" "  # no word has white space in it
SEED = 42  # of xxhash64 in SQL
START = np.uint64(2**64 - 2)  # stands before a text's first word
BLOCKS = 16
FINE = 60.0  # logits up to this size need no shift in single precision
FEW = 4


class Ranks(dict):
    """Token to rank; an unknown token has rank -1."""

    def __missing__(self, token: bytes) -> int:
        return -1


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def hashes(words: Iterable[bytes], size: int) -> np.ndarray:
    """What stands for each word in histories; SQL's ``xxhash64`` gives the same."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, size)


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[list[list[bytes]]]:
    """Token lists of a batch's texts, some texts at a time."""
    held, size = [], 0
    for text in batch.column(column).to_pylist():
        held.append(tokens(text))
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


# -- counts ------------------------------------------------------------------------


def token_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """``token, n`` over all texts, the end included; summed within tasks first."""

    def work(batches):
        tally: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(tally.keys(), pa.binary()), pa.array(tally.values(), pa.int64())], names=["token", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.update(tokens(text))
                if len(tally) > 300_000:
                    yield out()
                    tally.clear()
        if tally:
            yield out()

    parts = train.select(F.col(text_col).alias("t")).mapInArrow(work, "token binary, n bigint")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def group_of(word: np.ndarray) -> np.ndarray:
    """Group of a word outside the head, by its hash."""
    return (word % np.uint64(PER_CLASS)).astype(np.int64)


@dataclass
class Vocabulary:
    """The known tokens by rank with their counts, and totals over all tokens.

    ``groups``: (tokens, distinct tokens) by group, over all tokens.
    """

    known: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    groups: np.ndarray | None = None

    def __post_init__(self):
        head = self.counts[:HEAD]
        self.rest_total = self.total - int(head.sum())
        self.rest = np.zeros((PER_CLASS, 2)) if self.groups is None else np.array(self.groups, float)
        if self.groups is not None:
            own = group_of(hashes(self.known[:HEAD], len(head)))
            self.rest -= np.stack([np.bincount(own, head, PER_CLASS), np.bincount(own, minlength=PER_CLASS)], axis=1)
        # base logits: classes and, within them, words by count; one more class for the rest
        padded = np.zeros(HEAD)
        padded[: len(head)] = head
        by_class = padded.reshape(CLASSES, PER_CLASS)
        self.class_logit = np.log(np.append(by_class.sum(axis=1), self.rest_total) + 1.0).astype(np.float32)
        filled = np.arange(HEAD).reshape(CLASSES, PER_CLASS) < len(head)
        logits = np.where(filled, np.log(by_class + 1.0), -60.0)
        self.word_logit = np.vstack([logits, np.log(self.rest[:, 0] + 1.0)]).astype(np.float32)

    def ranks(self, most: int = KNOWN) -> Ranks:
        """Ranks of the ``most`` most frequent tokens."""
        return Ranks(zip(self.known[:most], range(most)))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """The most frequent tokens, ``known`` at most, and totals over all.

    They are those of a least count, which the numbers of tokens per count give: no task has to
    send its own best tokens.
    """
    per_count = sorted((r.n, r.m) for r in counts.groupBy("n").agg(F.count("*").alias("m")).collect())
    total, distinct = sum(n * m for n, m in per_count), sum(m for _, m in per_count)
    least, room = None, known
    while per_count and per_count[-1][1] <= room:
        least, m = per_count.pop()
        room -= m
    top = counts.where(F.col("n") >= least).collect() if least is not None else []
    top = sorted(((r.n, bytes(r.token)) for r in top), key=lambda x: (-x[0], x[1]))
    groups = np.zeros((PER_CLASS, 2), np.int64)
    by_group = counts.groupBy(F.pmod(F.xxhash64("token"), F.lit(PER_CLASS)).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    for r in by_group.collect():
        groups[r.g] = r.n, r.m
    return Vocabulary([t for _, t in top], np.array([n for n, _ in top], np.int64), total, distinct, groups)


# -- the model -----------------------------------------------------------------------


@dataclass
class Weights:
    classes: np.ndarray  # SLOTS x (CLASSES + 1)
    words: np.ndarray  # SLOTS x PER_CLASS

    @staticmethod
    def zero() -> Weights:
        return Weights(np.zeros((SLOTS, CLASSES + 1), np.float32), np.zeros((SLOTS, PER_CLASS), np.float32))


def plain(v: Vocabulary, w: Weights) -> tuple:
    """As values that tasks can read without this package."""
    return v.known, v.counts, v.total, v.distinct, v.groups, w.classes, w.words


def made(values: tuple) -> tuple[Vocabulary, Weights]:
    return Vocabulary(*values[:5]), Weights(*values[5:])


_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _PRIMES[salt % 4]
    x ^= x >> np.uint64(32)
    x *= _PRIMES[(salt + 1) % 4]
    return x >> np.uint64(65 - SLOTS.bit_length())


def histories(rank: np.ndarray, ends: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
    """Keys of the features (word before, two before, pair) at every position of texts laid end to end (``ends``: last places).

    ``word``: hashes of the words, so that every word has keys of its own; without them ranks stand for words.
    """
    word = rank.astype(np.int64).view(np.uint64) if word is None else word
    start = np.zeros(len(rank), np.int64)
    start[ends[:-1] + 1] = ends[:-1] + 1
    place = np.arange(len(rank)) - np.maximum.accumulate(start)
    back = []
    for k in (1, 2):
        before = np.full_like(word, START)
        before[k:] = word[:-k]
        back.append(np.where(place >= k, before, START))
    one, two = back
    return np.stack([one, two, one * _PRIMES[0] + two])


def _soft(logits: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place. Rows are shifted by their greatest logit only if one may be out of range."""
    if logits.size and (logits.max() > FINE or logits[:, 0].min() < -FINE):
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= np.einsum("ij->i", logits)[:, None]
    return logits


def sums_by_slot(slots: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots that occur, in order, the sum of their rows of ``slope``, and how many they are.

    Most slots of a batch have few rows; these are added for all slots together.
    """
    order = np.argsort(slots.astype(np.uint16), kind="stable")  # slots have 16 bits at most: sorted by counting
    own = slots[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    many = np.diff(np.append(first, len(own)))
    sums = np.take(slope, order[first], axis=0)
    for k in range(1, FEW):
        more = np.flatnonzero(many > k)
        sums[more] += np.take(slope, order[first[more] + k], axis=0)
    left = np.flatnonzero(many > FEW)
    if len(left):
        sizes = many[left] - FEW
        starts = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) + np.repeat(first[left] + FEW - starts, sizes)
        sums[left] += np.add.reduceat(np.take(slope, order[places], axis=0), starts, axis=0)
    return own[first], sums, many


class Net:
    """Class and word probabilities of one batch of positions; gradient steps."""

    def __init__(self, vocabulary: Vocabulary, weights: Weights):
        self.v = vocabulary
        self.w = Weights(weights.classes.copy(), weights.words.copy())
        self.touched = [np.zeros(SLOTS), np.zeros(SLOTS)]
        self.squares = [np.full((SLOTS, 1), 1e-6, np.float32) for _ in range(2)]

    def forward(self, table: np.ndarray, base: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        logits = base + np.take(table, slots[0], axis=0)
        for s in slots[1:]:
            logits += np.take(table, s, axis=0)
        return _soft(logits)

    def step(self, which: int, table: np.ndarray, slots: list[np.ndarray], slope: np.ndarray) -> None:
        """One adaptive step: each row by its summed gradient."""
        for s in slots:
            rows, gradient, many = sums_by_slot(s, slope)
            squares = self.squares[which][rows] + (np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1])[:, None]
            self.squares[which][rows] = squares
            gradient *= RATE / np.sqrt(squares)
            table[rows] -= gradient
            self.touched[which][rows] += many

    def run(self, rank: np.ndarray, keys: np.ndarray, learn: bool, group: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the modelled part of each token's probability.

        For a word outside the head that is its class and, with ``group``, its group in it.
        """
        v = self.v
        head = (rank >= 0) & (rank < HEAD)
        cls = np.where(head, rank // PER_CLASS, CLASSES)
        slots = [_mix(k, j).astype(np.int64) for j, k in enumerate(keys)]
        p = self.forward(self.w.classes, v.class_logit, slots)
        at = np.arange(len(rank))
        out = np.log(np.maximum(p[at, cls], 1e-30)).astype(np.float64)
        if learn:
            p[at, cls] -= 1.0
            self.step(0, self.w.classes, slots, p)
        inside = np.flatnonzero(head) if group is None else at
        if len(inside):
            c = cls[inside]
            word = rank % PER_CLASS if group is None else np.where(head, rank % PER_CLASS, group)
            word = word[inside]
            slots = [_mix(k[inside] * np.uint64(CLASSES + 1) + c.astype(np.uint64), j + 4).astype(np.int64) for j, k in enumerate(keys[:2])]
            p = self.forward(self.w.words, v.word_logit[c], slots)
            at = np.arange(len(inside))
            out[inside] += np.log(np.maximum(p[at, word], 1e-30))
            if learn:
                p[at, word] -= 1.0
                self.step(1, self.w.words, slots, p)
        return out

    def pass_over(self, rank: np.ndarray, ends: np.ndarray, learn: bool, word: np.ndarray | None = None) -> np.ndarray:
        keys = histories(rank, ends, word)
        group = None if word is None else group_of(word)
        return np.concatenate([
            self.run(rank[a : a + BATCH], keys[:, a : a + BATCH], learn, None if group is None else group[a : a + BATCH])
            for a in range(0, len(rank), BATCH)
        ])


def _ranked(ranks: Ranks, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, last places and hashes of the tokens of texts laid end to end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    size = int(sizes.sum())
    rank = np.fromiter(map(ranks.get, chain.from_iterable(texts), repeat(-1)), np.int64, size)
    return rank, np.cumsum(sizes) - 1, hashes(chain.from_iterable(texts), size)


def train_round(texts: DataFrame, vocabulary: Vocabulary, weights: Weights) -> Weights:
    """Gradient steps on every text of ``texts(t)`` from shared weights, then the weighted mean."""
    shared = texts.sparkSession.sparkContext.broadcast(plain(vocabulary, weights))

    def learn(batches):
        v, w = made(shared.value)
        net, ranks = None, v.ranks(HEAD)
        for batch in batches:
            for held in chunks(batch, 0):
                net = net or Net(v, w)
                rank, ends, word = _ranked(ranks, held)
                net.pass_over(rank, ends, True, word)
        if net is None:
            return
        for which, (own, old) in enumerate(((net.w.classes, w.classes), (net.w.words, w.words))):
            many = net.touched[which]
            moved = ((own - old) * many[:, None]).astype(np.float32)
            for block, (a, b) in enumerate(zip(np.array_split(moved, BLOCKS), np.array_split(many, BLOCKS))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([which * BLOCKS + block]), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())],
                    names=["block", "moved", "many"],
                )

    def add(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, moved, many in zip(*(batch.column(i).to_pylist() for i in range(3))):
                new = [np.frombuffer(moved, np.float32).astype(np.float64), np.frombuffer(many, np.float64)]
                old = sums.get(block)
                sums[block] = [a + b for a, b in zip(old, new)] if old else new
        for block, (moved, many) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([moved.tobytes()], pa.binary()), pa.array([many.tobytes()], pa.binary())],
                names=["block", "moved", "many"],
            )

    schema = "block bigint, moved binary, many binary"
    moves = texts.mapInArrow(learn, schema).repartition(2 * BLOCKS, "block").mapInArrow(add, schema).collect()
    out = Weights(weights.classes.copy(), weights.words.copy())
    for which, table in enumerate((out.classes, out.words)):
        blocks = np.array_split(np.arange(SLOTS), BLOCKS)
        for r in moves:
            if r.block // BLOCKS == which:
                rows = blocks[r.block % BLOCKS]
                moved = np.frombuffer(r.moved, np.float64).reshape(len(rows), -1)
                many = np.frombuffer(r.many, np.float64)
                table[rows] += moved / np.maximum(1.0, many)[:, None]
    return out


def fit(train: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        known: int = KNOWN) -> tuple[Vocabulary, Weights]:
    """Counts and weights from all rows of ``train``. No rows give a model that knows nothing."""
    v = vocabulary(counts, known)
    warm = unit_draw(F.xxhash64(id_col, text_col), "lm") < WARM
    weights = Weights.zero()
    for part in (train.where(warm), train.where(~warm)):
        weights = train_round(part.select(F.col(text_col).alias("t")), v, weights)
    return v, weights


# -- scores --------------------------------------------------------------------------


def score(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``learn_from`` is a condition on the rows that are learnt from; where it is not true the row
    is held out. ``base_score`` is the add-one unigram log10 probability, ``score`` the model's. A
    null text counts as empty: its only token is the end. Repeated rows score alike, other columns
    are not read, an empty table gives an empty result.
    """
    learn = F.coalesce(learn_from, F.lit(False))
    train = docs.where(learn)
    counts = stash(token_counts(train, text_col), "token-counts")
    v, w = fit(train, counts, id_col, text_col, known)
    shared = docs.sparkSession.sparkContext.broadcast(plain(v, w))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        v, w = made(shared.value)
        net, ranks = Net(v, w), v.ranks(len(v.known))
        logs = np.append(np.log10(v.counts + 1.0), 0.0)  # the last place stands for unknown tokens
        units = np.log10(v.rest.sum(axis=1) + 1.0)
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in ("n", "known", "logs", "model", "rest_logs", "out", "out_n")}
            for held in chunks(batch, 2):
                rank, ends, word = _ranked(ranks, held)
                first = np.append(0, ends[:-1] + 1)
                model = net.pass_over(rank, ends, False, word) / np.log(10)
                rest = (rank < 0) | (rank >= HEAD)
                each = logs[rank]
                columns["n"] += np.diff(np.append(first, len(rank))).tolist()
                for name, values in (
                    ("known", (rank >= 0).astype(np.int64)), ("logs", each), ("model", model),
                    ("rest_logs", np.where(rest, each - units[group_of(word)], 0.0)),
                ):
                    columns[name] += np.add.reduceat(values, first).tolist()
                for a, words in zip(first.tolist(), held):
                    unknown = Counter(words[k] for k in np.flatnonzero(rank[a : a + len(words)] < 0).tolist())
                    columns["out"].append(list(unknown))
                    columns["out_n"].append(list(unknown.values()))
            rows = len(columns["n"])
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(place, place + rows)), batch.column(0), batch.column(1)]
                + [pa.array(c, t) for c, t in zip(columns.values(), types)],
                names=["row", "doc_id", "held_out", *columns],
            )
            place += rows

    rows = stash(docs.select(F.col(id_col).alias("doc_id"), (~learn).alias("held_out"), F.col(text_col).alias("t")).mapInArrow(
        work,
        f"row bigint, doc_id {kind}, held_out boolean, n bigint, known bigint, logs double, model double, "
        "rest_logs double, out array<binary>, out_n array<bigint>",
    ), "lm-rows")

    # tokens beyond the dictionary, once per text, meet the full counts
    beyond = rows.select("row", F.explode(F.arrays_zip("out", "out_n")).alias("o")).select("row", "o.out", "o.out_n")
    beyond = beyond.join(counts.select(F.col("token").alias("out"), F.col("n").alias("c")), "out").groupBy("row").agg(
        F.sum("out_n").alias("more"), F.sum(F.col("out_n") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs")
    )
    base_unit = float(np.log10(v.total + v.distinct + 1))
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return rows.drop("out", "out_n").join(beyond, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + more).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n") * base_unit).alias("base_score"),
        (F.col("model") + F.col("rest_logs") + more_logs).alias("score"),
    )
