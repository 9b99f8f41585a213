"""Language identification of texts that may mix languages.

Every word is scored under each language by its letters (hashed character n-grams, naive
Bayes). The scripts of a word narrow its candidate languages to those seen with that script in
training. A Viterbi pass with a switching penalty then labels spans: staying costs nothing,
each change of language costs ``PENALTY``. The language with most letters is the prediction.

Most texts are in one language. For them a vectorised test proves that staying with the best
language is optimal: if no stretch of words gains more than one penalty by going to another
language, no path with changes can win, because each foreign stretch needs a change. The others
take the pass together: their words are laid out in blocks that all advance one word at a time.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import unit_draw

#: Labelled texts per language that the scores are fitted on (drawn by id); the documented bound.
FIT_PER_LANGUAGE = 2000
PENALTY = 8.0
SLOTS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Share of a language's letters a script needs for the language to be a candidate there.
SCRIPT_SHARE = 0.02
MEMORY = 300_000
CHUNK = 100_000  # words looked up together; texts stay whole
#: A text whose spans fit their own languages no surer than this is in none: junk, or a heap of scraps.
LEAST = 0.25

# First code points of script ranges, in order (Unicode blocks; letters only matter).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0x10000, "other"), (0x20000, "han"), (0x40000, "other"),
]
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])

#: Signs that belong to the letter before them.
MARKS = "".join(c for c in map(chr, chain(range(0x300, 0x20000), range(0xE0100, 0xE01F0))) if unicodedata.category(c)[0] == "M")
NEAR = re.compile("[^\\W\\d_]+(?:[\u0300-\u036f'\u2019][^\\W\\d_]+)*[\u0300-\u036f]*")
WORD = re.compile(f"[^\\W\\d_]+(?:[{MARKS}]+[^\\W\\d_]*|['\u2019][^\\W\\d_]+)*")
#: Below these there are no marks but the common accents, and a simpler pattern finds the words.
FAR = re.compile("[\u0483-\u1fff\u20d0-\U000e01ef]")
#: Words of a block of the joint pass.
BLOCK = 32


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    text = text.lower()
    return (NEAR if text.isascii() or not FAR.search(text) else WORD).findall(text)


def scripts(words: list[str]) -> np.ndarray:
    """Index of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, "right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all n-grams of all words (with edges), and how many each word has."""
    line = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    slots, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        slots.append((h[inside] % np.uint64(SLOTS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    slot, own = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return slot[order], np.bincount(own, minlength=len(words))


@dataclass
class Model:
    """Log scores per (slot, language), and which languages each script may have."""

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """Words x languages; candidates of another script stay far behind."""
        slot, counts = grams(words)
        ends = np.cumsum(counts)
        total = np.add.reduceat(self.table[slot], ends - counts, axis=0)
        fits = self.allowed[scripts(words)]
        fits[~fits.any(axis=1)] = True  # a script of no language rules nothing out
        # a word's n-grams overlap: temper their joint evidence
        return np.where(fits, total / len(ORDERS), total.min(axis=1, keepdims=True) / len(ORDERS) - 50.0)


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        per_language: int = FIT_PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` labelled texts of each language, drawn by a hash of the id."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = {r.lang: min(1.0, per_language / r.n) for r in sizes.collect()}  # one row per language
    if not share:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    known = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    drawn = rows.where(unit_draw(F.col("i"), "langid") < known[F.col("lang")])

    def count(batches):
        tally: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                own = tally.setdefault(lang, np.zeros(SLOTS + len(_NAMES), np.int64))
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    own[:SLOTS] += np.bincount(grams(part)[0], minlength=SLOTS)
                    own[SLOTS:] += np.bincount(scripts(part), [len(w) for w in part], len(_NAMES)).astype(int)
        for lang, own in tally.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "slot", "n"]
            )

    counted = drawn.select("lang", "t").mapInArrow(count, "lang string, slot bigint, n bigint")
    totals = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS per language
    languages = sorted(totals["lang"].unique())
    counts = np.zeros((SLOTS + len(_NAMES), len(languages)))
    counts[totals["slot"].to_numpy(), [languages.index(x) for x in totals["lang"]]] = totals["n"].to_numpy()
    grams_n, scripts_n = counts[:SLOTS], counts[SLOTS:]
    table = np.log((grams_n + 0.5) / (grams_n.sum(axis=0) + 0.5 * SLOTS))
    allowed = scripts_n > SCRIPT_SHARE * np.maximum(1, scripts_n.sum(axis=0))
    return Model(languages, table.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language per word, word by word: stay for free, change for ``penalty``."""
    n, k = scores.shape
    best = np.zeros(k)
    came = np.empty((n, k), np.int16)
    own = np.arange(k)
    for t in range(n):
        top = int(best.argmax())
        jump = best[top] - penalty
        came[t] = np.where(best >= jump, own, top)
        best = np.maximum(best, jump) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def viterbi_many(texts: list[np.ndarray], penalty: float = PENALTY, size: int = BLOCK) -> list[np.ndarray]:
    """``viterbi`` of many texts at once.

    All texts are cut into blocks of ``size`` words. What a block makes of each language it may be entered in
    is worked out for all blocks together, word by word; these tables are chained along each text, which
    tells how every block is really entered and, backwards, left. Blanks at the end of a text change nothing.
    """
    if not texts:
        return []
    k = texts[0].shape[1]
    counts = np.array([-(-len(t) // size) for t in texts])
    ends = np.cumsum(counts)
    scores = np.zeros((int(ends[-1]), size, k))
    flat = scores.reshape(-1, k)
    for t, end, n in zip(texts, ends.tolist(), counts.tolist()):
        flat[(end - n) * size : (end - n) * size + len(t)] = t

    table = np.full((len(scores), k, k), -np.inf)  # block, language before it, language at its end
    table[:, np.arange(k), np.arange(k)] = 0.0
    for w in range(size):
        table = np.maximum(table, table.max(axis=2, keepdims=True) - penalty) + scores[:, w, None, :]
    enters = np.zeros((len(scores), k))
    firsts = set((ends - counts).tolist())
    for b in range(1, len(scores)):
        if b not in firsts:
            enters[b] = (enters[b - 1][:, None] + table[b - 1]).max(axis=0)

    best, held = enters, np.empty((size, len(scores), k))
    for w in range(size):
        held[w] = best
        best = np.maximum(best, best.max(axis=1, keepdims=True) - penalty) + scores[:, w]
    tops = held.argmax(axis=2)
    came = np.where(held >= held.max(axis=2, keepdims=True) - penalty, np.arange(k), tops[:, :, None])
    rows = np.arange(len(scores))
    state = np.broadcast_to(np.arange(k), (len(scores), k))
    for w in range(size - 1, -1, -1):
        state = np.take_along_axis(came[w], state, axis=1)
    leave, back = best.argmax(axis=1), state.tolist()
    lasts = set((ends - 1).tolist())
    for b in range(len(scores) - 2, -1, -1):
        if b not in lasts:
            leave[b] = back[b + 1][leave[b + 1]]
    path, now = np.empty((len(scores), size), np.int64), leave
    for w in range(size - 1, -1, -1):
        path[:, w] = now
        now = came[w][rows, now]
    path = path.ravel()
    return [path[(end - n) * size : (end - n) * size + len(t)] for t, end, n in zip(texts, ends.tolist(), counts.tolist())]


def one_language(scores: np.ndarray, penalty: float = PENALTY) -> int | None:
    """The language of all words, if a vectorised test proves that no path with changes can win.

    Stretches outside the best single language gain at most what their languages do in any stretch.
    Neighbours among them are in different languages, and k in a row take k - 1 changes at
    least (one, if k is 1): they can't win while the two largest gains sum to no more than a penalty.
    """
    run = np.cumsum(scores, axis=0, dtype=np.float64)
    top = int(run[-1].argmax())
    gain = run - run[:, [top]]
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    low = np.vstack([np.zeros((1, gain.shape[1])), low[:-1]])
    return top if np.sort((gain - low).max(axis=0))[-2:].sum() <= penalty else None


def label(texts: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best language per word of each text; only texts that may change language take the pass."""
    found = [one_language(t, penalty) for t in texts]
    open_ = [i for i, top in enumerate(found) if top is None]
    passed = dict(zip(open_, viterbi_many([texts[i] for i in open_], penalty)))
    return [np.full(len(t), top) if top is not None else passed[i] for i, (t, top) in enumerate(zip(texts, found))]


class Labeller:
    """Labels texts with a model; remembers the scores of words it has met."""

    def __init__(self, model: Model, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self.memo: dict[str, int] = {}
        self.held = np.empty((1024, len(model.languages)), np.float32)

    def _learn(self, found: list[list[str]]) -> None:
        """Score the words of some texts that are new, together."""
        if len(self.memo) > MEMORY:
            self.memo.clear()
        memo, have = self.memo, len(self.memo)
        new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in memo]
        need = have + len(new)
        if need > len(self.held):
            self.held = np.concatenate([self.held[:have], np.empty((2 * need - have, self.held.shape[1]), np.float32)])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.held[have + at : have + at + len(part)] = self.model.score(part)
        memo.update(zip(new, range(have, need)))

    def many(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """Language, score, spans as (first word, words, language), and fit of each text.

        The fit is how sure the words are of their own spans' languages, by letters.
        """
        out, at = [], 0
        known = bool(self.model.languages)
        while at < len(texts):
            found, size = [], 0
            while at < len(texts) and size < CHUNK:
                text = texts[at]
                found.append(words(text) if text and known and any(map(str.isalpha, text)) else [])
                size += len(found[-1])
                at += 1
            self._learn(found)
            scores = [self.held[np.fromiter(map(self.memo.__getitem__, f), np.int64, len(f))] for f in found if f]
            said = zip(scores, label(scores, self.penalty))
            out.extend(self._one(f, *next(said)) if f else ("und", 0.0, [], 0.0) for f in found)
        return out

    @staticmethod
    def _sure(scores: np.ndarray, path: np.ndarray, lang: int) -> float:
        """How sure the words labelled with a language are of it, against every other one."""
        mine = path == lang
        lead = (scores[mine, lang].astype(np.float64)[:, None] - scores[mine]).sum(axis=0)
        return float(1.0 / (1.0 + np.exp(-np.clip(np.delete(lead, lang), -30, 30)).sum()))

    def _one(self, found: list[str], scores: np.ndarray, path: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]], float]:
        names = self.model.languages
        letters = np.fromiter(map(len, found), np.float64, len(found))
        weight = np.bincount(path, letters, len(names))
        top = int(weight.argmax())
        share = weight / letters.sum()
        sure = {k: self._sure(scores, path, k) for k in np.flatnonzero(weight).tolist()}
        cuts = np.flatnonzero(np.diff(path)) + 1
        firsts = np.append(0, cuts)
        sizes = np.diff(np.append(firsts, len(path)))
        spans = [(int(a), int(n), names[path[a]]) for a, n in zip(firsts, sizes)]
        return names[top], float(share[top] * sure[top]), spans, float(sum(share[k] * sure[k] for k in sure))


SPANS = "array<struct<first: bigint, words: bigint, lang: string>>"


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY
) -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, spans``.

    ``score`` is the share of the text's letters under the predicted language, weighted by how
    sure the scores of those words are. ``spans`` lists (first word, words, language). A null
    text or one without a letter is ``und`` with score 0 and no spans, and so is every text if
    nothing was learnt. Repeated rows are judged alike; other columns are not read.
    """
    # plain values: tasks need no package
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.allowed))
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def work(batches):
        judge = Labeller(Model(*shared.value), penalty)
        for batch in batches:
            said = judge.many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()),
                 pa.array([[dict(zip(("first", "words", "lang"), s)) for s in x[2]] for x in said], spans)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        work, f"doc_id {kind}, lang_pred string, score double, spans {SPANS}"
    )


def keep_identified(
    docs: DataFrame, model: Model, least: float = LEAST, text_col: str = "text", penalty: float = PENALTY
) -> DataFrame:
    """The rows whose text is in a known language, with all their columns.

    Rejected are texts without a letter and those whose spans fit their languages less than ``least``,
    however many languages they are in.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.allowed))
    at = docs.columns.index(text_col)

    def work(batches):
        judge = Labeller(Model(*shared.value), penalty)
        for batch in batches:
            said = judge.many(batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != "und" and fit >= least for name, _, _, fit in said], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
