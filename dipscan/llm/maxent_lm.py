"""Operator 13: scores of texts by a hashed maximum-entropy model with a class-factored softmax.

    P(word | history) = P(class(word) | history) * P(number(word) | class, history) * share of the word in its number

The class of the next word follows a log-linear model over hashed features of the
history: the word before, the two before, and, skipping one, the second word back.
So does the word's number inside the class: a class falls into two parts, these into two each, down to single numbers,
and each choice of a part is a softmax over the same features, hashed with the place of the choice.
A frequent word has a number of its own; rare words of one spelling key share one, each by its count raised by one.
Every class of rare words keeps one share of its mass, whatever the history, for unknown words.  All
probabilities of a history add up to one.  With zero weights the model is
the add-one unigram model, up to the shares of unknown words: (c + 1) / mass(class) inside a class.

Passes over the corpus:

1.  *Counts* of all training words, summed in the tasks and then by word.
2.  *Encoding.*  Texts become 16-bit word numbers, written once: the ``TABLE`` most frequent
    words have one each, all others that of their spelling key (last three bytes).  The
    table's counts are broadcast; those of all other words come by a join.
3.  *Classes.*  Every number sums signs of its frequent neighbours over the training
    texts; the driver splits the numbers, of which there are ``TABLE + KEYS`` at any size, by those sums.
4.  *Training.*  Documents are dealt to ``ROUNDS`` rounds.  In each, tasks sum the gradient of the log-likelihood
    over the round's documents in integers (2**-16 of a count), the sums meet by
    slabs of weight rows, and the driver takes one AdaGrad step and broadcasts the weights:
    ``ROWS`` x ``CLASSES`` numbers and ``BRANCHES`` of choices inside classes, whatever the corpus.
5.  *Scoring* of all documents in numpy batches that gather the weight rows of their features.

Words are told apart by 52 bits of their hash and the 12 bits of their spelling key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import shared_folder, width, written

KEYS = 1 << 12  # spelling keys, one number each
TABLE = (1 << 16) - KEYS  # frequent words, one number each; their counts are broadcast
SIGNS = 16  # signs of one neighbour
CLASSES, FREQUENT = 32, 19  # class 0 is the end alone, FREQUENT classes of frequent words, the rest by spelling keys
ROWS = 1 << 14  # hashed features, at most 1 << 16
BRANCHES = 1 << 18  # hashed features of the choices inside classes
ROUNDS = 8
RATE, DAMPING = 0.7, 8.0  # AdaGrad: step RATE * g / (sqrt(sum of g * g) + DAMPING), g in counts
TOKENS, STEP = 1 << 17, 1 << 12  # of one batch, and of one step of it that stays in the cache
ONE = 1 << 16  # a whole count in gradients
SLAB = 16  # weight rows that travel together
HELD = 1 << 20  # distinct words that a counting task holds
SHRUNK = 20  # counts at which half of a word's neighbours are believed
END = np.uint64(0)
_U = np.uint64


@dataclass
class Tree:
    """Choices between the two parts of a class, of each part, and so on; of fixed size."""

    start: np.ndarray  # of each number's choices in path
    depth: np.ndarray  # their number; 0 for a class of one number, and numbers without known words
    path: np.ndarray  # twice the choice, and 1 for its second part
    bias: np.ndarray  # of each choice: log of the second part's mass over the first's
    prior: np.ndarray  # log of each number's share of its class


@dataclass
class Model:
    """All of fixed size but ``words`` (code, n), which stays a table."""

    words: DataFrame
    tokens: int  # N, training tokens
    distinct: int  # V
    table: np.ndarray  # codes of frequent words, sorted; a word's number is its place
    counts: np.ndarray  # of the table
    kinds: np.ndarray  # class of each number
    mass: np.ndarray  # of each class
    weights: np.ndarray  # float32[ROWS, CLASSES]
    own: np.ndarray | None = None  # mass of each number, without unknown words
    tree: Tree | None = None
    branches: np.ndarray | None = None  # float32[BRANCHES]

    @property
    def rare(self) -> DataFrame:
        """Words that the table may lack, and those of it that are as rare."""
        others = self.counts[self.table != END]
        return self.words.where((F.col("n") <= int(others.min() if len(others) else 0)) & (F.col("code") != int(END)))

    @property
    def bias(self) -> np.ndarray:
        return np.log(self.mass / self.mass.sum()).astype(np.float32)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words with an end after each text, first token of each text and the end of the last)."""
    w = tb.words(texts)
    n = len(texts)
    length = w.end - w.start
    last = np.zeros(len(w.start), dtype=np.uint64)
    for back in range(3):
        has = length > back
        last[has] |= w.lowered[w.end[has] - 1 - back].astype(np.uint64) << _U(8 * back)
    word = w.hash & ~_U(KEYS - 1) | tb.mix(last) & _U(KEYS - 1)
    codes = np.full(len(word) + n, END, dtype=np.uint64)
    codes[np.arange(len(word)) + w.doc] = word
    return codes, w.first + np.arange(n + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, room = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate(held), return_inverse=True)
        return code, np.bincount(at, np.concatenate(n), len(code)).astype(np.int64)

    def out(code: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[at: at + 100_000].view(np.int64)), pa.array(count[at: at + 100_000])], names=["code", "n"])

    for batch in batches:
        for _, texts in tb.blocks(batch.column(0)):
            code, count = np.unique(tokens(texts)[0], return_counts=True)
            held.append(code)
            n.append(count)
            room += len(code)
            if room > 2 * HELD:
                code, count = merged()
                if len(code) > HELD:
                    yield from out(code, count)
                    code, count = code[:0], count[:0]
                held, n, room = [code], [count], len(code)
    if held:
        yield from out(*merged())


def _slabs(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (slab, bytes) of an int64 matrix; slabs of zeros are left out."""
    cut = sums.reshape(-1, SLAB * sums.shape[1])
    some = np.flatnonzero(cut.any(axis=1))
    for at in range(0, len(some), 256):
        yield pa.RecordBatch.from_arrays([pa.array(some[at: at + 256], pa.int32()), pa.array([cut[i].tobytes() for i in some[at: at + 256]], pa.binary())], names=["slab", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            value = np.frombuffer(sums.as_buffer(), np.int64)
            if slab in found:
                found[slab] += value
            else:
                found[slab] = value.copy()
    for slab, value in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([value.tobytes()], pa.binary())], names=["slab", "sums"])


def _gathered(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of all tasks' matrices; a reducing task holds its own slabs, the driver one matrix."""
    found = parts.repartition(width(parts.sparkSession), "slab").mapInArrow(_added, "slab int, sums binary").toArrow()
    out = np.zeros((rows // SLAB, SLAB * columns), dtype=np.int64)
    for slab, sums in zip(found["slab"].to_pylist(), found["sums"].to_pylist()):
        out[slab] = np.frombuffer(sums, np.int64)
    return out.reshape(rows, columns)


def _neighbours(frequent: int):
    """Encoded training rows to the sums of neighbours' signs, for every number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * SIGNS, TABLE + KEYS))
        for piece in _pieces(batches, 0):
            number, first, _ = _numbers(piece, 0)
            inner = np.ones(len(number), dtype=bool)
            inner[first[first < len(number)]] = False  # no word before
            bits = tb.mix(number)
            number = number.astype(np.intp)
            known = number < frequent
            for j in range(SIGNS):
                sign = np.where(known, ((bits >> _U(j)) & _U(1)).astype(np.float64) * 2 - 1, 0)
                total[j] += np.bincount(number[1:], sign[:-1] * inner[1:], TABLE + KEYS)
                total[SIGNS + j] += np.bincount(number[:-1], sign[1:] * inner[1:], TABLE + KEYS)
        yield from _slabs(total.T.astype(np.int64))

    return run


def split(points: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """At most k classes: the class with the most weighted scatter is cut at its mean, along its widest direction."""
    own = np.zeros(len(points), dtype=np.int64)

    def spread(c: int) -> tuple[float, np.ndarray | None, np.ndarray]:
        some = np.flatnonzero(own == c)
        x, w = points[some], weight[some]
        x = x - (w @ x) / max(w.sum(), 1e-9)
        scatter = (x * w[:, None]).T @ x
        if len(some) < 2 or np.trace(scatter) <= 1e-9:
            return 0.0, None, some
        along = np.linalg.eigh(scatter)[1][:, -1]
        return float(np.trace(scatter)), x @ (along * np.sign(along[np.abs(along).argmax()])) > 0, some

    found = [spread(0)]
    for c in range(1, k):
        widest = max(range(c), key=lambda i: found[i][0])
        _, far, some = found[widest]
        if far is None or far.all() or not far.any():
            break
        own[some[far]] = c
        found[widest] = spread(widest)
        found.append(spread(c))
    return own


def halved(kinds: np.ndarray, mass: np.ndarray, order: np.ndarray) -> Tree:
    """The numbers of each class in their order, cut where their mass is halved, and the parts again down to single numbers."""
    some = np.flatnonzero(mass > 0)
    some = some[np.lexsort((some, order[some], kinds[some]))]
    cum = np.append(0.0, np.cumsum(mass[some]))
    edge = np.append(np.flatnonzero(np.diff(kinds[some], prepend=-1)), len(some))
    lo, hi = edge[:-1], edge[1:]
    prior = np.zeros(len(mass))
    prior[some] = np.log(mass[some]) - np.repeat(np.log(cum[hi] - cum[lo]), hi - lo)
    at, codes, bias, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    while True:
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        if not len(lo):
            break
        middle = (cum[lo] + cum[hi]) / 2
        cut = np.searchsorted(cum, middle)
        cut = np.clip(np.where(cum[cut] - middle > middle - cum[cut - 1], cut - 1, cut), lo + 1, hi - 1)
        size = hi - lo
        place = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        at.append(place)
        codes.append(2 * np.repeat(made + np.arange(len(lo)), size) + (place >= np.repeat(cut, size)))
        bias.append(np.log((cum[hi] - cum[cut]) / (cum[cut] - cum[lo])))
        made += len(lo)
        lo, hi = np.concatenate([lo, cut]), np.concatenate([cut, hi])
    place = some[np.concatenate(at)]
    by_number = np.argsort(place, kind="stable")
    depth = np.bincount(place, minlength=len(mass)).astype(np.int32)
    return Tree((np.cumsum(depth) - depth).astype(np.int32), depth, np.concatenate(codes)[by_number].astype(np.int32), np.concatenate(bias).astype(np.float32), prior)


def fit_words(texts: DataFrame) -> Model:
    """Counts of the training words; one class of the table's words and one of all others, weights zero."""
    words = written(texts.mapInArrow(_counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.col("code") != int(END), F.desc("n"), "code").limit(TABLE).toArrow()  # the end is in the table in any case
    code, count = top["code"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(code)
    kinds = np.ones(TABLE + KEYS, dtype=np.uint8)
    kinds[TABLE:] = 1 + FREQUENT
    return with_mass(Model(words, n, v, code[order], count[order], kinds, np.zeros(CLASSES), np.zeros((ROWS, CLASSES), np.float32)))


def with_mass(model: Model) -> Model:
    """Sets the classes' masses: counts raised by one, and one for the unknown words of each class of keys."""
    known = len(model.table)
    end = model.table == END
    model.kinds[:known][end] = 0
    mass = np.bincount(model.kinds[:known], model.counts + 1.0, CLASSES).astype(float)  # an empty table gives integers
    by_key = model.rare.groupBy(F.col("code").bitwiseAND(KEYS - 1).cast("int").alias("key")).agg(F.sum(F.col("n") + 1).alias("mass")).toArrow()
    key_mass = np.zeros(KEYS)
    key_mass[by_key["key"].to_numpy()] = by_key["mass"].to_numpy()
    equal = ~end & (model.counts <= model.counts[~end].min(initial=np.iinfo(np.int64).max))  # of the table, in the sums of the rare as well
    key_mass -= np.bincount((model.table[equal] & _U(KEYS - 1)).astype(np.int64), model.counts[equal] + 1.0, KEYS)
    mass += np.bincount(model.kinds[TABLE:], key_mass, CLASSES)
    model.own = np.zeros(TABLE + KEYS)
    model.own[:known] = model.counts + 1.0
    model.own[TABLE:] = key_mass
    mass[np.unique(model.kinds[TABLE:])] += 1
    mass[0] = max(mass[0], 1)
    model.mass = np.maximum(mass, 1e-9)
    return model


def fit_classes(encoded: DataFrame, model: Model) -> Model:
    """Classes of words and of spelling keys by their neighbours in the training texts."""
    rows = encoded.where("round >= 0").select("numbers")
    total = _gathered(rows.mapInArrow(_neighbours(len(model.table)), "slab int, sums binary"), TABLE + KEYS, 2 * SIGNS)
    seen = np.zeros(TABLE + KEYS)
    seen[: len(model.table)] = model.counts
    # a key's words are counted through its neighbours' signs: no sum of them exceeds the words' number
    seen[TABLE:] = np.abs(total[TABLE:]).max(axis=1)
    points = total / (seen + SHRUNK)[:, None]
    for part, first, k in ((slice(0, len(model.table)), 1, FREQUENT), (slice(TABLE, TABLE + KEYS), 1 + FREQUENT, CLASSES - 1 - FREQUENT)):
        model.kinds[part] = first + split(points[part], seen[part], k)
    model = with_mass(model)
    order = np.zeros(len(points))  # inside a class along its widest direction: neighbours take part in the same choices
    for c in np.unique(model.kinds):
        x, w = points[model.kinds == c], seen[model.kinds == c]
        x = x - (w @ x) / max(w.sum(), 1e-9)
        along = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
        order[model.kinds == c] = np.round(x @ (along * np.sign(along[np.abs(along).argmax()])), 9)
    model.tree = halved(model.kinds, model.own, order)
    model.branches = np.zeros(BRANCHES, np.float32)
    return model


ENCODED = "uid bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, numbers binary, rare array<bigint>, round int"


def _encoded(table: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, texts in tb.blocks(batch.column(1)):
                code, first = tokens(texts)
                word, at = np.unique(code, return_inverse=True)
                place = np.minimum(np.searchsorted(table, word), max(0, len(table) - 1))
                known = table[place] == word if len(table) else np.zeros(len(word), bool)
                number = np.where(known, place, TABLE + (word & _U(KEYS - 1)).astype(np.int64)).astype("<u2")[at]
                log = np.zeros(len(word))
                log[known] = np.log10(counts[place[known]] + 1.0)
                rare = ~(known | (word == END))[at]
                size = np.diff(first)
                doc = np.repeat(np.arange(len(texts)), size)
                ahead = np.append(0, np.cumsum(rare))[first]
                lists = pa.ListArray.from_arrays(pa.array(ahead, pa.int32()), pa.array(code[rare].view(np.int64)))
                per = lambda x: np.bincount(doc, x, len(texts))
                own = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(len(texts))), own.column(0), own.column(2), pa.array(size, pa.int64()), pa.array(per(known[at]).astype(np.int64)), pa.array(per(log[at])),
                        pa.array([number[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()), lists, own.column(3),
                    ],
                    names=["uid", "id", "held_out", "n_tokens", "known", "logs", "numbers", "rare", "round"],
                )
                uid += len(texts)

    return run


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about TOKENS tokens, or of one document."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64) // 2
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + TOKENS, side="right")))
            yield batch.slice(row, stop - row)
            row = stop


def _numbers(piece: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, first token of each document, its tokens)."""
    size = pc.binary_length(piece.column(column)).to_numpy() // 2
    return np.frombuffer(b"".join(piece.column(column).to_pylist()), "<u2"), np.cumsum(size) - size, size


def histories(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint32[3, n]: hashes of each token's history, the word before, the two before and the second before."""
    before = [numbers.astype(np.uint32) + np.uint32(1)]
    for _ in range(2):
        x = np.zeros_like(before[0])
        x[1:] = before[-1][:-1]
        x[first] = 0  # nothing before the first
        before.append(x)
    _, one, two = before
    out = np.empty((3, len(numbers)), dtype=np.uint32)
    for j, x in enumerate((one, one * np.uint32(0x9E3779B1) + two, two)):
        h = (x + np.uint32(0x632BE5A7 * (j + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        out[j] = h
    return out


def features(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """intp[3, n]: the weight rows of each token's history."""
    return _rows(histories(numbers, first))


def _rows(history: np.ndarray) -> np.ndarray:
    return (history >> np.uint32(33 - ROWS.bit_length())).astype(np.intp)


def _choices(tree: Tree, branches: np.ndarray, number: np.ndarray, history: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first token, token of each choice, its weights' places as rows, whether its second part is taken, score of the second part) of STEP tokens at a time."""
    for at in range(0, len(number), STEP):
        some = number[at: at + STEP]
        depth = tree.depth[some]
        ends = np.cumsum(depth)
        of = np.repeat(np.arange(len(some), dtype=np.int32), depth)
        code = tree.path[np.arange(ends[-1], dtype=np.int32) + np.repeat(tree.start[some] - ends.astype(np.int32) + depth, depth)]
        node = code >> 1
        mark = node.astype(np.uint32) * np.uint32(0x9E3779B1)
        score = tree.bias[node]
        place = np.empty((3, len(of)), dtype=np.intp)
        for j in range(3):
            x = history[j, at: at + STEP][of]
            x += mark
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            x >>= np.uint32(33 - BRANCHES.bit_length())
            place[j] = x
            score += branches[place[j]]
        yield at, of, place, (code & 1).astype(bool), score


def _steps(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first token, exponentials of the classes' scores as rows, their sums) of STEP tokens at a time; the arrays are used again."""
    one = np.ones(CLASSES, dtype=np.float32)
    x, y = np.empty((STEP, CLASSES), np.float32), np.empty((STEP, CLASSES), np.float32)
    for at in range(0, rows.shape[1], STEP):
        row = rows[:, at: at + STEP]
        n = row.shape[1]
        np.take(weights, row[0], axis=0, out=x[:n], mode="clip")
        for r in row[1:]:
            np.take(weights, r, axis=0, out=y[:n], mode="clip")
            x[:n] += y[:n]
        x[:n] += bias
        x[:n] -= x[:n].max(axis=1, keepdims=True)
        np.exp(x[:n], out=x[:n])
        yield at, x[:n], x[:n] @ one


def _gradients(weights, bias: np.ndarray, kinds: np.ndarray, inner=None):
    """Slabs of the classes' rows; with ``inner``, a broadcast (Tree, branches), those of the choices inside classes after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        tree, branches = inner.value if inner else (None, None)
        total = np.zeros((CLASSES, ROWS))  # sums of integers
        within = np.zeros(BRANCHES if inner else 0)
        left = np.empty((CLASSES, TOKENS))
        for piece in _pieces(batches, 0):
            number, first, _ = _numbers(piece, 0)
            kind, history = kinds[number], histories(number, first)
            for lo in range(0, len(kind), TOKENS):
                some, past = kind[lo: lo + TOKENS], history[:, lo: lo + TOKENS]
                row = _rows(past)
                n = len(some)
                for at, x, whole in _steps(w, bias, row):
                    x *= (-ONE / whole)[:, None]
                    left[:, at: at + len(x)] = np.rint(x, out=x).T
                left[some, np.arange(n)] += ONE
                for r in row:
                    for c in range(CLASSES):
                        total[c] += np.bincount(r, left[c, :n], ROWS)
                if inner:
                    places, missed = [], []
                    for _, _, place, second, score in _choices(tree, branches, number[lo: lo + TOKENS], past):
                        places.append(place)
                        missed.append(np.rint((second - 1 / (1 + np.exp(np.clip(-score, -80, 80)))) * ONE))
                    missed = np.concatenate(missed).astype(float)
                    for j in range(3):
                        within += np.bincount(np.concatenate([p[j] for p in places]), missed, BRANCHES)
        yield from _slabs(np.concatenate([total.T.astype(np.int64), within.astype(np.int64).reshape(-1, CLASSES)]))

    return run


def _scored(weights, bias: np.ndarray, kinds: np.ndarray, mass: np.ndarray, inner):
    """(uid, share, rare, gain): natural logarithms with rare words' shares of their class, and what each gains by its history if it is known."""
    log_mass = np.log(mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        tree, branches = inner.value if inner else (None, None)
        for piece in _pieces(batches, 1):
            number, first, size = _numbers(piece, 1)
            kind, history = kinds[number], histories(number, first)
            log = -log_mass[kind]
            gain = np.zeros(len(number))
            for at, x, whole in _steps(w, bias, _rows(history)):
                log[at: at + len(x)] += np.log(x[np.arange(len(x)), kind[at: at + len(x)]].astype(np.float64) / whole)
            if inner:
                for at, of, _, second, score in _choices(tree, branches, number, history):
                    score = np.where(second, score, -score)
                    chosen = np.minimum(score, 0) - np.log(1 + np.exp(-np.abs(score)))
                    n = len(number[at: at + STEP])
                    gain[at: at + n] = np.bincount(of, chosen, n) - tree.prior[number[at: at + n]]
            rare = number >= TABLE
            rare[first + size - 1] = False  # ends
            log[~rare] += gain[~rare]
            by_doc = np.bincount(np.repeat(np.arange(len(size)), size), log, len(size))
            ahead = np.append(0, np.cumsum(rare))[np.append(first, len(number))]
            gains = pa.ListArray.from_arrays(pa.array(ahead, pa.int32()), pa.array((gain[rare] / np.log(10)).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(by_doc / np.log(10)), piece.column(2), gains], names=["uid", "share", "rare", "gain"])

    return run


def encode(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> DataFrame:
    """Encoded rows of (id, text, held_out), written by round; round -1 holds what is not learned from."""
    spark = docs.sparkSession
    deal = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(rounds))).cast("int")
    made = docs.select("id", "text", "held_out", deal.alias("round")).mapInArrow(_encoded(model.table, model.counts), ENCODED)
    path = shared_folder(spark, "encoded")
    made.write.partitionBy("round").parquet(path)
    return spark.read.schema(ENCODED).parquet(path)


def train(encoded: DataFrame, model: Model, rounds: int = ROUNDS, rate: float = RATE, damping: float = DAMPING) -> Model:
    """One AdaGrad step for each round, over the documents of the round."""
    context = encoded.sparkSession.sparkContext
    squares = np.zeros((ROWS + BRANCHES // CLASSES, CLASSES))
    for k in range(rounds):
        weights, inner = context.broadcast(model.weights), context.broadcast((model.tree, model.branches))
        rows = encoded.where(F.col("round") == k).select("numbers")
        g = _gathered(rows.mapInArrow(_gradients(weights, model.bias, model.kinds, inner), "slab int, sums binary"), len(squares), CLASSES) / ONE
        weights.unpersist()
        inner.unpersist()
        squares += g * g
        step = rate * g / (np.sqrt(squares) + damping)
        model.weights = (model.weights + step[:ROWS]).astype(np.float32)
        model.branches = (model.branches + step[ROWS:].ravel()).astype(np.float32)
    return model


def score_encoded(encoded: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of encoded rows."""
    context = encoded.sparkSession.sparkContext
    weights, inner = context.broadcast(model.weights), context.broadcast((model.tree, model.branches)) if model.tree else None
    made = encoded.select("uid", "numbers", "rare").mapInArrow(_scored(weights, model.bias, model.kinds, model.mass, inner), "uid bigint, share double, rare array<bigint>, gain array<float>")
    shares = written(made, "shares")
    rare = shares.select("uid", F.inline(F.arrays_zip(F.col("rare").alias("code"), F.col("gain").alias("gain")))).join(model.rare, "code")
    rare = rare.groupBy("uid").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_logs"), F.sum("gain").alias("rare_gain"))
    rows = encoded.select("uid", "id", "held_out", "n_tokens", "known", "logs").join(shares.select("uid", "share"), "uid").join(rare, "uid", "left")
    log = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return rows.select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (log - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.distinct + 1)))).alias("base_score"), (log + F.col("share") + F.coalesce("rare_gain", F.lit(0.0))).alias("score"),
    )


def held_out(id_col: str, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id's decimal text leaves ``part``; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each document.

    Words are lower-cased (A-Z) runs of bytes other than space; each text has an
    end after its last word.  A null or empty text has its end alone.  Repeated ids
    and rows count and give rows each; a null id is learned from.  Without training texts
    nothing is known and the weights are zero.  Other columns are not read.  An
    empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(id_col).alias("held_out"))
    model = fit_words(source.where("NOT held_out").select("text"))
    encoded = encode(source, model)
    return score_encoded(encoded, train(encoded, fit_classes(encoded, model)))

