"""Scoring by a class-based n-gram model whose classes come from exchange clustering.

Words are counted over all training texts. Exchange clustering moves each word to the class
that raises the likelihood of the class bigrams most. It starts with the CORE most frequent
words, one after another, from their bigram counts; then every word of the head that occurs
MIN_COUNT times is placed, and in each of ROUNDS further passes over all training texts half
of the words, the core's too, are exchanged again: a pass counts each word's neighbours by
their present classes, tasks work out the exact gain of every move against the class bigrams
as they stand, and the round with the highest likelihood holds. The head is the most frequent
words, as many as HEAD takes without parting words of nearly equal counts. Rarer and unknown
words take the class that most tokens with their ending have. A token's probability is the
class transition, interpolated with the class's share, times the word's share of its class;
the share of unknown words of a class is that of the words it has seen once (Good and
Turing), taken from its known ones. The probabilities of the known words and of one unknown
type sum to one.

Only bounded tables are collected and broadcast: the head with counts and classes, a class
per ending, the class transitions. Neighbour counts and counts of all other words stay
distributed; documents' rare tokens are joined with them by word. Words are known by a
64-bit hash.

Tokens are words with A-Z lower-cased, then one end per text. Null and empty texts hold
the end alone. Rows without a doc_id belong to the training part. Repeated rows count and
are scored one by one. Extra columns are ignored. Without any training row a score is that
of unknown words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, saved, text_blocks, thrifty
from tidemark.llm.words import block_words, mix

HEAD, CORE, CLASSES, SWEEPS, ROUNDS = 1 << 18, 1 << 10, 48, 6, 4
#: A word that occurs less often shows too few neighbours to be clustered by them.
MIN_COUNT = 4
ENDINGS = 1 << 12
END, OTHER = 0, 1  # classes of the end and, while clustering, of words that aren't clustered (yet)
#: Words whose gains are worked out at a time.
CHUNK = 512
END_HASH = mix(np.array([0x0E0D], np.uint64))[0]
#: Weight of a class's share in its transitions.
BACK_OFF = 20.0
#: Distinct words that a task holds before it gives their counts out.
FLUSH = 1_500_000


class Index:
    """Positions of 64-bit hashes by open addressing; -1 if absent."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(4, int(4 * len(hashes)).bit_length())
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.kept: np.ndarray | None = None
        left = np.arange(len(hashes))
        spot = self._spot(hashes)
        while len(left):
            free = self.at[spot[left]] < 0
            mine = left[free]
            self.at[spot[mine]] = mine  # of several the last one stays
            self.slots[spot[mine]] = hashes[mine]
            lost = self.at[spot[left]] != left
            left = left[lost]
            spot[left] = (spot[left] + 1) & ((1 << self.bits) - 1)

    def _spot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        spot = self._spot(hashes)
        left = np.arange(len(hashes))
        while len(left):
            s = spot[left]
            at = self.at[s]
            hit = (at >= 0) & (self.slots[s] == hashes[left])
            out[left[hit]] = at[hit]
            left = left[(at >= 0) & ~hit]
            spot[left] = (spot[left] + 1) & ((1 << self.bits) - 1)
        return out


class Tokens(NamedTuple):
    """Of a block: token hashes with an end after each text, their endings, each text's first token (one entry more than texts)."""

    hashes: np.ndarray
    endings: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    w = block_words(texts)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    hashes = np.empty(len(w.hashes) + n, np.uint64)
    endings = np.zeros(len(hashes), np.int64)
    word = np.ones(len(hashes), bool)
    word[first[1:] - 1] = False
    hashes[word], hashes[~word] = w.hashes, END_HASH
    code = np.zeros(len(w.starts), np.uint64)
    for k in (1, 2, 3):
        inside = w.ends - k >= w.starts
        code = code * np.uint64(257) + np.where(inside, w.data[np.maximum(w.ends - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    endings[word] = (mix(code) % np.uint64(ENDINGS)).astype(np.int64)
    return Tokens(hashes, endings, first)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    for block in text_blocks(batches):
        yield block, tokens(block.column(block.schema.get_field_index("text")))


def word_counts(texts: DataFrame) -> DataFrame:
    """h, ending, c of every distinct token of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h = np.concatenate([x[0] for x in held])
            kinds, at, back = np.unique(h, return_index=True, return_inverse=True)
            return kinds, np.concatenate([x[1] for x in held])[at], np.bincount(back, weights=np.concatenate([x[2] for x in held])).astype(np.int64)

        def out(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["h", "ending", "c"])

        for _, t in _parts(batches):
            kinds, at, counts = np.unique(t.hashes, return_index=True, return_counts=True)
            held.append((kinds, t.endings[at], counts.astype(float)))
            size += len(kinds)
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield from out(held.pop())
                    size = 0
        if held:
            yield from out(merged())

    partial = texts.select("text").mapInArrow(run, "h long, ending int, c long")
    return partial.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def cell_sums(texts: DataFrame, cells: int, add: Callable[[Tokens, np.ndarray], None], unit: int = 1) -> DataFrame:
    """unit, cell, n: a table of counts, at most cells of them. Each task adds up its own, then tasks' counts are summed by cell, all cells of a unit (so many in a row) in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for _, t in _parts(batches):
            add(t, total)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 17):
            some = at[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array((some // unit).astype(np.int32)), pa.array((some % unit).astype(np.int32)), pa.array(total[some].astype(np.int64))], names=["unit", "cell", "n"])

    partial = texts.select("text").mapInArrow(thrifty(run), "unit int, cell int, n long")
    return (partial.repartition("unit") if unit > 1 else partial).groupBy("unit", "cell").agg(F.sum("n").alias("n"))


def summed_cells(texts: DataFrame, cells: int, add: Callable[[Tokens, np.ndarray], None]) -> np.ndarray:
    """cell_sums() of a small table, collected."""
    got = cell_sums(texts, cells, add).toArrow()
    out = np.zeros(cells)
    out[got.column("unit").to_numpy()] = got.column("n").to_numpy()
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of words from their bigram counts; the last row and column stand for all other words, word 0 is the end. Both keep classes of their own."""
    n = len(counts) - 1
    of = np.concatenate([[END], 2 + np.arange(n - 1) % max(classes - 2, 1), [OTHER]]).astype(int)
    one = np.eye(classes)[of]
    grid = one.T @ bigrams @ one
    mass = one.T @ counts
    for _ in range(sweeps):
        moved = 0
        for w in range(1, n):
            a, own = of[w], bigrams[w, w]
            right, left = bigrams[w].copy(), bigrams[:, w].copy()
            right[w] = left[w] = 0
            right, left = np.bincount(of, right, classes), np.bincount(of, left, classes)
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= own
            mass[a] -= counts[w]
            diagonal = np.diag(grid)
            gain = (_f(grid + right) - _f(grid)).sum(1) + (_f(grid + left[:, None]) - _f(grid)).sum(0)
            gain -= _f(diagonal + right) + _f(diagonal + left) - 2 * _f(diagonal)
            gain += _f(diagonal + right + left + own) - _f(diagonal)
            gain -= 2 * (_f(mass + counts[w]) - _f(mass))
            gain[:2] = -np.inf
            b = int(gain.argmax())
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += own
            mass[b] += counts[w]
            of[w] = b
            moved += a != b
        if not moved:
            break
    return of


def gains(right: np.ndarray, left: np.ndarray, own: np.ndarray, counts: np.ndarray, of: np.ndarray, grid: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Of each word (a row) what the likelihood gains if it joins each class (a column), once taken out of its own.

    right, left: its neighbours after and before it by class, itself left out; own: how often it follows itself. No two words move together.
    """
    m, classes = right.shape
    rows = np.arange(m)
    out = np.zeros((m, classes))
    for here, back, table in ((right, left, grid), (left, right, grid.T)):
        w, c = np.nonzero(here)
        n = here[w, c][:, None]
        base = table[:, c].T.copy()  # of every class, its bigrams with the neighbours' class
        base[np.arange(len(w)), of[w]] -= n[:, 0]
        same = np.flatnonzero(c == of[w])
        base[same] -= back[w[same]]
        base[same, c[same]] -= own[w[same]]
        base = np.maximum(base, 0)
        change = _f(base + n) - _f(base)
        starts = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, int)
        if len(starts):
            out[w[starts]] += np.add.reduceat(change, starts)
    diagonal = np.tile(np.diag(grid), (m, 1))
    diagonal[rows, of] -= right[rows, of] + left[rows, of] + own
    diagonal = np.maximum(diagonal, 0)
    out -= _f(diagonal + right) + _f(diagonal + left) - 2 * _f(diagonal)
    out += _f(diagonal + right + left + own[:, None]) - _f(diagonal)
    rest = np.tile(mass, (m, 1))
    rest[rows, of] -= counts
    rest = np.maximum(rest, 0)
    out -= 2 * (_f(rest + counts[:, None]) - _f(rest))
    out[:, :OTHER + 1] = -np.inf
    return out


def before(x: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token; start (the end) before a text's first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = start
    return out


def neighbours(texts: DataFrame, sent: Broadcast, words: int, of: np.ndarray) -> DataFrame:
    """unit, cells: of each of the first words of the broadcast head, how often which class stands before it (cell: the class), after it (CLASSES more), and itself (2 * CLASSES)."""
    classes = texts.sparkSession.sparkContext.broadcast(np.append(of, OTHER).astype(np.int64))
    unit = 2 * CLASSES + 1

    def add(t: Tokens, cells: np.ndarray) -> None:
        at = _index(sent).find(t.hashes).astype(np.int64)
        at = np.where((at < 0) | (at >= words), words, at)
        prior, mine = before(at, t.first, END), classes.value[at]
        theirs, twice = classes.value[prior], at == prior
        keys = np.concatenate([(at * unit + theirs)[(at < words) & ~twice], (prior * unit + CLASSES + mine)[(prior < words) & ~twice], (at * unit + 2 * CLASSES)[(at < words) & twice]])
        found, n = np.unique(keys, return_counts=True)
        cells[found] += n.astype(np.int32)

    return cell_sums(texts, words * unit, add, unit).groupBy("unit").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most one unit's cells


def _class_bigrams(seen: DataFrame, of: np.ndarray) -> np.ndarray:
    """Bigrams of classes from neighbours(); the cell of OTHER with itself stays 0."""
    classes = seen.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            word, cell, n = _cells(batch)
            mine = classes.value[word]
            after, own = (cell >= CLASSES) & (cell < 2 * CLASSES) & (mine != OTHER), cell == 2 * CLASSES
            np.add.at(total, (mine[after], cell[after] - CLASSES), n[after])
            np.add.at(total, (mine[own], mine[own]), n[own])
            other = (cell == OTHER) & (mine != OTHER)
            np.add.at(total, (np.full(int(other.sum()), OTHER), mine[other]), n[other])
        total[OTHER, OTHER] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at].astype(np.int64))], names=["cell", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in seen.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, cell and count of every entry of rows of neighbours()."""
    lists = batch.column(1)
    flat = lists.flatten()
    word = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
    return word, flat.field("cell").to_numpy(), flat.field("n").to_numpy()


def _moved(seen: DataFrame, of: np.ndarray, counts: np.ndarray, grid: np.ndarray, turn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The classes after one exchange of the words whose turn it is, each against the bigrams as they stand."""
    mass = np.bincount(of, counts, CLASSES)
    state = seen.sparkSession.sparkContext.broadcast((of, counts, grid, mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, grid, mass = state.value
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                words = part.column(0).to_numpy()
                word, cell, n = _cells(part)
                row = np.repeat(np.arange(len(words)), part.column(1).value_lengths().to_numpy())
                dense = np.zeros((len(words), 2 * CLASSES + 1))
                dense[row, cell] = n
                mine = turn(words)
                words, dense, own = words[mine], dense[mine], of[words[mine]]
                gain = gains(dense[:, CLASSES : 2 * CLASSES], dense[:, :CLASSES], dense[:, -1], counts[words], own, grid, mass)
                gain[:, mass == 0] = -np.inf  # all words would take an empty class at once
                best = gain.argmax(1)
                moves = gain[np.arange(len(words)), best] > gain[np.arange(len(words)), own] + 1e-9
                yield pa.RecordBatch.from_arrays([pa.array(words[moves]), pa.array(best[moves].astype(np.int32))], names=["word", "class"])

    got = seen.mapInArrow(run, "word int, class int").toArrow()  # at most one row a word of the head
    out = of.copy()
    out[got.column("word").to_numpy()] = got.column("class").to_numpy()
    return out


def clustered(texts: DataFrame, sent: Broadcast, counts: np.ndarray, core_class: np.ndarray) -> np.ndarray:
    """Classes of the first len(counts) words of the broadcast head, of which the core's are given; word 0 is the end."""
    words, core = len(counts), len(core_class)
    of = np.full(words, OTHER)
    of[:core] = core_class
    best, highest = of, -np.inf
    for k in range(ROUNDS + 2):  # the first places words, the last only measures
        seen = saved(neighbours(texts, sent, words, of))
        grid = _class_bigrams(seen, of)
        mass = np.bincount(of, counts, CLASSES)
        mass[OTHER] = 0
        likelihood = _f(grid).sum() - 2 * _f(mass).sum()
        if k and likelihood <= highest:
            drop(seen)
            break
        if k:
            best, highest = of, likelihood
        if k <= ROUNDS:
            turn = (lambda w: (w >= core) & (w > 0)) if not k else (lambda w, k=k: ((w + k) % 2 == 0) & (w > 0))
            of = _moved(seen, of, counts, grid, turn)
        drop(seen)
    return best


class Model(NamedTuple):
    hashes: np.ndarray  # of the head words
    counts: np.ndarray
    classes: np.ndarray
    by_ending: np.ndarray  # class of other words
    transitions: np.ndarray  # log10 of probabilities, row: class before
    masses: np.ndarray  # tokens of each class
    unknown: np.ndarray  # share of unknown words in each class
    train_tokens: int
    types: int

    def class_of(self, index: Index, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        at = index.find(t.hashes)
        return at, np.where(at >= 0, self.classes[at] if len(self.classes) else 0, self.by_ending[t.endings])


def frequent(vocabulary: DataFrame) -> DataFrame:
    """The most frequent words, at most HEAD and the end: the words of whole ranges of counts, of which a histogram tells how many fit."""
    ranged = vocabulary.withColumn("range", F.floor(64 * F.log2("c")))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n")).orderBy(F.desc("range")).collect()  # 64 ranges for each doubling of a count
    least, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > HEAD:
            break
        least = r["range"]
    end = F.col("h") == F.lit(int(END_HASH.view(np.int64)))
    return ranged.where(end if least is None else (F.col("range") >= least) | end).drop("range")


def train(texts: DataFrame, vocabulary: DataFrame) -> Model:
    """texts: the training texts; vocabulary: h, ending, c, their word_counts()."""
    spark = texts.sparkSession
    total = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    head = frequent(vocabulary).toArrow()
    hashes, counts, endings = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy(), head.column("ending").to_numpy()
    order = np.lexsort((hashes, -counts, hashes != END_HASH))  # the end first
    hashes, counts, endings = hashes[order], counts[order], endings[order]
    if not len(hashes):
        return Model(hashes, counts, np.zeros(0, int), np.full(ENDINGS, 2), np.full((CLASSES, CLASSES), -np.log10(CLASSES)), np.zeros(CLASSES), np.ones(CLASSES), 0, 0)
    core, words = min(CORE, len(hashes)), max(1, int((counts >= MIN_COUNT).sum()) + (counts[0] < MIN_COUNT))
    core = min(core, words)
    sent = spark.sparkContext.broadcast(hashes[:words])

    def core_bigrams(t: Tokens, cells: np.ndarray) -> None:
        at = _index(sent).find(t.hashes)
        at = np.where((at < 0) | (at >= core), core, at).astype(np.int64)
        found, n = np.unique(before(at, t.first, 0) * (core + 1) + at, return_counts=True)
        cells[found] += n.astype(np.int32)

    bigrams = summed_cells(texts, (core + 1) ** 2, core_bigrams).reshape(core + 1, core + 1)
    core_class = exchange(bigrams, bigrams.sum(0), CLASSES, SWEEPS)
    classes = np.full(len(hashes), -1)
    classes[:words] = clustered(texts, sent, counts[:words], core_class[:core])
    votes = np.zeros((ENDINGS, CLASSES))
    np.add.at(votes, (endings[1:words], classes[1:words]), counts[1:words])
    by_ending = np.where(votes.sum(1) > 0, votes.argmax(1), int(votes.sum(0).argmax()) if votes.any() else 2)
    classes[words:] = by_ending[endings[words:]]
    model = Model(hashes, counts, classes, by_ending, np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES), np.zeros(CLASSES), int(total["n"]), int(total["v"]))
    whole = spark.sparkContext.broadcast(model)

    def class_bigrams(t: Tokens, cells: np.ndarray) -> None:
        _, c = whole.value.class_of(_index(whole), t)
        cells += np.bincount(before(c, t.first, END) * CLASSES + c, minlength=CLASSES**2).astype(np.int32)

    grid = summed_cells(texts, CLASSES**2, class_bigrams).reshape(CLASSES, CLASSES)
    mass = grid.sum(0)
    share = mass / mass.sum()
    transitions = (grid + BACK_OFF * share) / (grid.sum(1, keepdims=True) + BACK_OFF)
    transitions = np.log10(np.maximum(transitions, 1e-12))
    single = np.zeros(CLASSES)
    for r in vocabulary.where("c = 1").groupBy("ending").agg(F.count("*").alias("n")).collect():
        single[by_ending[r["ending"]]] += r["n"]
    unknown = np.clip((single + 0.5) / (mass + 1), 1e-6, 0.5)
    return model._replace(transitions=transitions, masses=mass, unknown=unknown)


_indexes: dict[int, Index] = {}


def _index(sent: Broadcast) -> Index:
    """A worker's index of the words that a broadcast holds; the last few are kept."""
    value = sent.value
    hashes = value.hashes if isinstance(value, Model) else value
    key = id(hashes)
    if key not in _indexes:
        if len(_indexes) > 3:
            _indexes.clear()
        _indexes[key] = Index(hashes)
        _indexes[key].kept = hashes  # so that no other array gets its id
    return _indexes[key]


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs; learns from rows that are not held_out."""
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    training = marked.where("NOT held_out")
    vocabulary = saved(word_counts(training))
    model = train(training, vocabulary)
    sent = spark.sparkContext.broadcast(model)
    n, v = model.train_tokens, model.types
    floor = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = sent.value
        index, row = _index(sent), TaskContext.get().partitionId() << 40
        with np.errstate(divide="ignore"):
            word = np.log10(m.counts) + (np.log10(1 - m.unknown) - np.log10(np.maximum(m.masses, 1)))[m.classes] if len(m.counts) else np.zeros(0)
        base = np.log10(m.counts + 1) - floor
        for block, t in _parts(batches):
            at, c = m.class_of(index, t)
            prior = np.empty_like(c)
            prior[1:] = c[:-1]
            prior[t.first[:-1]] = END
            known = at >= 0

            def per_text(x: np.ndarray, first: np.ndarray = t.first) -> np.ndarray:
                return np.add.reduceat(x, first[:-1], dtype=float)  # no text is without its end

            own = m.transitions[prior, c]
            own[known] += word[at[known]]
            rare = np.flatnonzero(~known)
            texts = np.searchsorted(t.first, rare, side="right") - 1
            order = np.lexsort((t.hashes[rare], texts))
            rare, texts = rare[order], texts[order]
            h = t.hashes[rare]
            begins = np.ones(len(rare), bool)
            begins[1:] = (h[1:] != h[:-1]) | (texts[1:] != texts[:-1])
            kinds = np.flatnonzero(begins)
            times = np.diff(np.append(kinds, len(rare)))
            offsets = pa.array(np.searchsorted(texts[kinds], np.arange(block.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(h[kinds].view(np.int64)), pa.array(times.astype(np.int32)), pa.array(c[rare][kinds].astype(np.int32)))]
            size = np.diff(t.first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(block.num_rows)), block.column(0), block.column(1), pa.array(size.astype(np.int64)), pa.array(per_text(known).astype(np.int64)),
                    pa.array(per_text(np.where(known, base[at] if len(base) else 0.0, 0.0))), pa.array(per_text(own)), *lists,
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "h", "times", "class"],
            )
            row += block.num_rows

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, h array<long>, times array<int>, class array<int>"
    scored = saved(marked.mapInArrow(run, schema))
    rare = scored.select("row", F.explode(F.arrays_zip("h", "times", "class")).alias("x")).select("row", "x.h", "x.times", F.col("x.class").alias("class"))
    joined = rare.join(vocabulary.select("h", "c"), "h", "left")
    seen = [float(np.log10(max(1 - u, 1e-12)) - np.log10(max(m, 1))) for u, m in zip(model.unknown, model.masses, strict=True)]
    unseen = [float(np.log10(u)) for u in model.unknown]
    lookup = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("class") + 1)
    word = F.when(F.col("c").isNull(), lookup(unseen)).otherwise(F.log10("c") + lookup(seen))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).cast("long").alias("rare_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - floor)).alias("rare_base"),
        F.sum(F.col("times") * word).alias("rare_own"),
    )
    out = scored.drop("h", "times", "class").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("known", "rare_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "rare_base").alias("base_score"), plus("own", "rare_own").alias("score"))
