"""Language-model scores: a smoothed unigram base and a hidden Markov model of word classes.

Word counts over all training texts are one grouped table, as large as the
vocabulary. The FREQUENT most frequent words are sent to the workers; other words
of a text join the table by hash. Classes of the hidden Markov model are the words
seen OWN_COUNT times or more, one each, as many as are sent, and groups of other
words by their last two bytes; a word's probability is its class's in a state times
its share of the class. The model starts from a bounded sample of sequences from
anywhere in the texts; then every round of Baum-Welch takes expected counts over
all training texts, summed across partitions. A text's forward and backward values
are exact over its whole length; of a very long one segments are advanced together,
and the product of a segment's matrices carries values from one to the next. Scores are exact: the
scaled forward recursion over the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import look_up
from .session import bound_batches, cut

#: Words whose counts the workers hold (16 bytes each, and 16 for each state of those with a class of their own), and how often such words are seen at least.
FREQUENT, OWN_COUNT = 1 << 19, 128
#: Classes of other words.
GROUPS = 512
STATES = 8
#: Tokens of the sequences that start the model, and of the segments of texts of more than LONG tokens.
SEGMENT, LONG = 64, 1 << 16
#: Rows of expected counts that are summed across partitions as one.
PIECE = 1024
#: Tokens whose forward values are held at once, but for those of one text.
TOKENS = 1 << 20
#: Sequences that the first parameters come from, about, and rounds over them.
START_SEGMENTS, START_ROUNDS = 8192, 15
ADD = 0.1
#: The end token. Hashes of words are 64 bits of a mixing function; none is told apart from it.
END = np.uint64(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and groups of all tokens, each text's with an end token, and their offsets."""
    lower = K.LOWER[data]
    starts, ends, of = K.words(lower, offsets, K.SPACED)
    n = len(of) - 1
    count = np.diff(of)
    to = of + np.arange(n + 1)
    hashes = np.full(int(to[-1]), END, np.uint64)
    group = np.zeros(int(to[-1]), np.int32)
    at = np.arange(len(starts)) + np.repeat(np.arange(n), count)
    hashes[at] = K.word_hashes(lower, starts, ends)
    last = lower[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, lower[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    group[at] = (K.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(GROUPS)).astype(np.int32)
    return hashes, group, to


class Table:
    """Values of hashes; looked up by their first bits, then step by step in a sorted array."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, missing: int):
        order = np.argsort(hashes)
        self.bits = max(1, min(20, int(len(hashes)).bit_length()))
        self.hashes = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.append(values[order], missing)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.missing = missing

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(hashes), self.missing, self.values.dtype)
        rest = np.arange(len(hashes))
        while len(rest):
            have = self.hashes[at]
            same = have == hashes[rest]
            out[rest[same]] = self.values[at[same]]
            on = have < hashes[rest]
            rest, at = rest[on], at[on] + 1
        return out


@dataclass
class Vocabulary:
    """Totals, the counts of frequent words and the classes: own words, then groups; spread: by group, log10 of what a word's share is divided by."""

    total: int
    kinds: int
    count: Table
    top: Table
    own: int
    prior: np.ndarray
    spread: np.ndarray

    def classes(self, hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
        found = self.top(hashes)
        return np.where(found >= 0, found, self.own + group)


@dataclass
class Hidden:
    """start of a text, transitions, and emissions by class and state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def forward(model: Hidden, classes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of classes; all sequences advance together."""
    out = np.zeros(len(of) - 1)
    length = np.diff(of)
    order = np.argsort(-length, kind="stable")
    starts, length = of[:-1][order], length[order]
    active = int(np.searchsorted(-length, 0, "left"))
    logs = np.zeros(len(order))
    alpha = model.start[None, :] * model.emit[classes[starts[:active]]]
    for t in range(1, int(length[0]) + 1 if len(length) else 0):
        going = int(np.searchsorted(-length[:active], -t, "left"))
        if t % 8 == 0 or going < active:
            scale = alpha.sum(axis=1)
            logs[:active] += np.log10(scale)
            alpha = alpha[:going] / scale[:going, None]
            active = going
        if active:
            alpha = (alpha @ model.move) * model.emit[classes[starts[:active] + t]]
    out[order] = logs
    return out


def segments(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and place in its text, of all runs of at most SEGMENT tokens."""
    length = np.diff(of)
    n = -(-length // SEGMENT)
    rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(of[:-1], n) + rank * SEGMENT
    return starts, np.minimum(SEGMENT, np.repeat(of[1:], n) - starts), rank


def _products(model: Hidden, classes: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """By segment: the product of moves and emissions of its tokens, scaled."""
    states = len(model.start)
    out = np.empty((len(starts), states, states))
    for lo in range(0, len(starts), 4096):
        order = lo + np.argsort(-length[lo : lo + 4096], kind="stable")
        n = length[order]
        part = np.broadcast_to(np.eye(states), (len(order), states, states)).copy()
        for t in range(int(n[0])):
            g = int(np.searchsorted(-n, -t, "left"))
            part[:g] = (part[:g].reshape(-1, states) @ model.move).reshape(g, states, states) * model.emit[classes[starts[order[:g]] + t]][:, None, :]
            if t % 8 == 7:
                part[:g] /= part[:g].max(axis=(1, 2))[:, None, None]
        out[order] = part / part.max(axis=(1, 2))[:, None, None]
    return out


def _borders(model: Hidden, classes: np.ndarray, starts: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By segment: the forward values before it (of the text's last token there; none for a text's first) and the backward values at its end."""
    states = len(model.start)
    before, after = np.zeros((len(starts), states)), np.ones((len(starts), states))
    later = np.flatnonzero(rank > 0)
    if not len(later):
        return before, after
    product = np.zeros((len(starts), states, states))
    product[later] = _products(model, classes, starts[later], length[later])
    # first segments that others follow
    first = later[rank[later] == 1] - 1
    alpha = np.broadcast_to(model.start, (len(first), states)) * model.emit[classes[starts[first]]]
    for t in range(1, SEGMENT):
        alpha = (alpha @ model.move) * model.emit[classes[starts[first] + t]]
        alpha /= alpha.sum(axis=1, keepdims=True)
    before[first + 1] = alpha / alpha.sum(axis=1, keepdims=True)
    # texts advance together, from segment to segment
    by_rank = np.argsort(rank[later], kind="stable")
    cuts = np.searchsorted(rank[later][by_rank], np.arange(1, int(rank.max()) + 2))
    for r in range(2, int(rank.max()) + 1):
        at = later[by_rank[cuts[r - 1] : cuts[r]]]
        x = np.einsum("ij,ijk->ik", before[at - 1], product[at - 1])
        before[at] = x / x.sum(axis=1, keepdims=True)
    for r in range(int(rank.max()), 0, -1):
        at = later[by_rank[cuts[r - 1] : cuts[r]]]
        x = np.einsum("ijk,ik->ij", product[at], after[at])
        after[at - 1] = x / x.max(axis=1, keepdims=True)
    return before, after


def expect(model: Hidden, classes: np.ndarray, of: np.ndarray, into: list[np.ndarray]) -> float:
    """Adds expected counts of starts, moves and emissions (as in Hidden) given whole texts; returns their log10 probability."""
    length = np.diff(of)
    # of very long texts segments advance together, given the values at their borders
    total = 0.0
    for t in np.flatnonzero(length > LONG).tolist():
        own = classes[of[t] : of[t + 1]]
        starts, n, rank = segments(np.array([0, len(own)]))
        before, after = _borders(model, own, starts, n, rank)
        for lo in range(0, len(starts), TOKENS // SEGMENT):
            part = slice(lo, lo + TOKENS // SEGMENT)
            total += _expect(model, own, starts[part], n[part], into, rank[part] == 0, before[part], after[part])
    order = np.argsort(-length, kind="stable")
    order = order[(length[order] > 0) & (length[order] <= LONG)]
    held = np.cumsum(length[order])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + TOKENS, "right")))
        total += _expect(model, classes, of[:-1][order[lo:hi]], length[order[lo:hi]], into)
        lo = hi
    return total


def _expect(model: Hidden, classes: np.ndarray, starts: np.ndarray, length: np.ndarray, into: list[np.ndarray], first: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None) -> float:
    """expect() of runs of tokens that advance together: of whole texts; or of segments, of which `first` begin one, between these values."""
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    most, states = int(length[0]), len(model.start)
    going = np.searchsorted(-length, -np.arange(most), "left")  # runs longer than t
    at = np.concatenate([[0], np.cumsum(going)])
    # tokens in the order in which they are read
    symbol = np.empty(int(at[-1]), classes.dtype)
    for t in range(most):
        symbol[at[t] : at[t + 1]] = classes[starts[: going[t]] + t]
    alpha, scale = np.empty((int(at[-1]), states)), np.empty(int(at[-1]))
    begin = np.broadcast_to(model.start, (len(starts), states))
    if first is not None:
        first, before, after = first[order], before[order], after[order]
        begin = np.where(first[:, None], model.start, before @ model.move)
    for t in range(most):
        own = slice(at[t], at[t + 1])
        a = begin if t == 0 else alpha[at[t - 1] : at[t - 1] + going[t]] @ model.move
        a = a * model.emit[symbol[own]]
        scale[own] = a.sum(axis=1)
        np.divide(a, scale[own, None], out=alpha[own])
    # backward values are scaled so that forward times backward adds up to 1
    beta = np.ones((len(starts), states))
    if after is not None:
        beta = after / (alpha[at[length - 1] + np.arange(len(starts))] * after).sum(axis=1, keepdims=True)
    moves = np.zeros((states, states))
    for t in range(most - 1, -1, -1):
        own = slice(at[t], at[t + 1])
        if t + 1 < most:
            h = int(going[t + 1])
            next_ = beta[:h] * model.emit[symbol[at[t + 1] : at[t + 2]]] / scale[at[t + 1] : at[t + 2], None]
            moves += alpha[at[t] : at[t] + h].T @ next_
            beta[:h] = next_ @ model.move.T
        if t == 0 and first is not None:
            # from the segment before
            next_ = (beta * model.emit[symbol[own]] / scale[own, None])[~first]
            moves += before[~first].T @ next_
        alpha[own] *= beta[: going[t]]
    into[0] += (alpha[: at[1]] if first is None else alpha[: at[1]][first]).sum(axis=0)
    into[1] += model.move * moves
    kinds, which = np.unique(symbol, return_inverse=True)
    for k in range(states):
        into[2][kinds, k] += np.bincount(which, alpha[:, k], len(kinds))
    return float(np.log10(scale).sum())


def blank(states: int, kinds: int) -> list[np.ndarray]:
    return [np.zeros(states), np.zeros((states, states)), np.zeros((kinds, states))]


def maximise(counts: list[np.ndarray], prior: np.ndarray) -> Hidden:
    """Parameters of the expected counts; each state's emissions are drawn towards the classes' overall shares a little."""
    start, move, emit = counts
    share = lambda x, add: (x + add) / (x + add).sum(axis=-1, keepdims=True)
    pull = np.maximum(emit.sum(axis=0) * 1e-4, 1.0)
    return Hidden(share(start, 0.01), share(move, 0.01), (emit + prior[:, None] * pull) / (emit.sum(axis=0) + pull))


def begin(sample: list[tuple[np.ndarray, np.ndarray]], prior: np.ndarray, states: int, seed: int) -> Hidden:
    """A model from noise, then rounds over the sample; states seldom change at first."""
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), states))
    model = Hidden(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + np.eye(states) * 0.9, emit / emit.sum(axis=0))
    if not sample:
        return model
    classes = np.concatenate([c for c, _ in sample])
    of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in sample]))])
    for _ in range(START_ROUNDS):
        counts = blank(states, len(prior))
        expect(model, classes, of, counts)
        model = maximise(counts, prior)
    return model


def vocabulary(train: DataFrame, text_col: str) -> tuple[DataFrame, Vocabulary]:
    """The table (hash, kind, n) of all training tokens, and what the workers need of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                hashes, group, _ = tokens(data, offsets)
                found, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(group[at]), pa.array(n)], names=["hash", "kind", "n"])

    counted = train.select(F.col(text_col).cast("string")).mapInArrow(count, "hash bigint, kind int, n bigint")
    words = cut(counted.groupBy("hash").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")))
    size = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(size.n or 0), int(size.v)
    # words by size of their count, in steps of an eighth of a power of two: 512 rows at most, and no task sorts all words
    step = F.floor(F.log2("n") * 8).cast("int")
    least, room = 1 << 30, FREQUENT
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if r["count"] > room:
            break
        least, room = r.step, room - r["count"]
    top = words.where(step >= least).select("hash", "n").toArrow()
    hashes, n = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -n))
    order = order[(n[order] >= OWN_COUNT) | (hashes[order] == END)]
    own_hashes = hashes[order]
    if END not in own_hashes:
        own_hashes = np.append(own_hashes, END)
    count_of = Table(hashes, n, -1)
    own = len(own_hashes)
    prior = np.full(own + GROUPS, ADD)  # of a group: its unseen word
    prior[:own] += np.maximum(count_of(own_hashes), 0)
    # a step has words of OWN_COUNT times or more only, or of fewer, or both
    for r in words.where((step < least) | (F.col("n") < OWN_COUNT)).where(F.col("hash") != int(END)).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        prior[own + r.kind] += r.n + ADD * r.v
    spread = np.log10(prior[own:])
    return words, Vocabulary(total, kinds, count_of, Table(own_hashes, np.arange(own), -1), own, prior / prior.sum(), spread)


def train(docs: DataFrame, words: Vocabulary, text_col: str, states: int = STATES, rounds: int = 2, seed: int = 0) -> Hidden:
    """Baum-Welch: first parameters from about START_SEGMENTS sequences chosen by hash, then rounds over all texts."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(words)
    share = min(1.0, START_SEGMENTS * SEGMENT / max(1, words.total))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                hashes, group, of = tokens(data, offsets)
                found = held.value.classes(hashes, group).astype(np.int32)
                starts, length, _ = segments(of)
                draw = K.mix(hashes[starts] ^ K.mix(hashes[starts + length - 1] + length.astype(np.uint64)))
                chosen = np.flatnonzero((draw >> np.uint64(32)) < np.uint64(int(share * (1 << 32))))
                yield pa.RecordBatch.from_arrays([pa.array([found[s : s + n].tobytes() for s, n in zip(starts[chosen].tolist(), length[chosen].tolist(), strict=True)], pa.binary())], names=["c"])

    # of copies one starts the model, so the number is near what is expected; more are cut by hash, which bounds the driver
    drawn = docs.select(F.col(text_col).cast("string")).mapInArrow(classes, "c binary").distinct().orderBy(F.xxhash64("c"), "c").limit(10 * START_SEGMENTS).collect()
    sample = [np.frombuffer(r.c, np.int32).astype(np.int64) for r in drawn]
    sample.sort(key=lambda c: (len(c), c.tobytes()))
    model = begin([(c, np.array([0, len(c)])) for c in sample], words.prior, states, seed)
    size = 1 + states + len(words.prior)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        # counts of starts, moves from each state and emissions of each class, in pieces of so many rows
        def expected(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            counts = blank(states, len(held.value.prior))
            for batch in batches:
                classes, lengths = [], [np.zeros(1, np.int64)]
                for _, _, data, offsets in K.blocks(batch.column(0)):
                    hashes, group, of = tokens(data, offsets)
                    classes.append(held.value.classes(hashes, group).astype(np.int32))
                    lengths.append(np.diff(of))
                if classes:
                    expect(now.value, np.concatenate(classes), np.cumsum(np.concatenate(lengths)), counts)
            rows = np.concatenate([counts[0][None, :], counts[1], counts[2]])
            for lo in range(0, size, PIECE):
                if (piece := rows[lo : lo + PIECE]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["at", "x"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[at] = sums.get(at, 0) + np.frombuffer(x)
            for at, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["at", "x"])

        parts = docs.select(F.col(text_col).cast("string")).mapInArrow(expected, "at bigint, x binary")
        sums = parts.repartition("at").mapInArrow(summed, "at bigint, x binary").toArrow()
        rows = np.zeros((size, states))
        for at, x in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
            piece = np.frombuffer(x).reshape(-1, states)
            rows[at : at + len(piece)] = piece
        model = maximise([rows[0], rows[1 : 1 + states], rows[1 + states :]], words.prior)
        now.unpersist()
    return model


def score(docs: DataFrame, words_table: DataFrame, words: Vocabulary, model: Hidden, id_col: str, text_col: str) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast((words, model))
    kind = docs.schema[id_col].dataType.simpleString()
    log_total = math.log10(words.total + ADD * (words.kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = held.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            classes, lengths = [], [np.zeros(1, np.int64)]
            for _, _, data, offsets in K.blocks(batch.column(1)):
                hashes, group, of = tokens(data, offsets)
                found = words.classes(hashes, group)
                count = words.count(hashes)
                known = count > 0
                logs = np.where(known, np.log10(np.maximum(count, 0) + ADD), 0.0)
                own = np.where(found < words.own, 0.0, logs - words.spread[np.maximum(found - words.own, 0)])
                text = of[:-1]
                out[0].append(np.diff(of))
                out[1].append(np.add.reduceat(known.astype(np.int64), text))
                out[2].append(np.add.reduceat(logs, text))
                out[3].append(np.add.reduceat(own, text))
                rest = np.flatnonzero(~known)
                row = np.searchsorted(of, rest, "right") - 1
                cuts = np.searchsorted(row, np.arange(len(of)))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    h, n = np.unique(hashes[rest[a:b]], return_counts=True) if b > a else (hashes[:0], np.zeros(0, np.int64))
                    out[4].append(h.view(np.int64))
                    out[5].append(n)
                classes.append(found.astype(np.int32))
                lengths.append(np.diff(of))
            if not batch.num_rows:
                continue
            of = np.cumsum(np.concatenate(lengths))
            hidden = forward(model, np.concatenate(classes), of) + np.concatenate(out[3])
            lists = np.cumsum([0, *map(len, out[4])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])), pa.array(hidden), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(np.concatenate(out[4]))), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(np.concatenate(out[5])))],
                names=[id_col, "n_tokens", "known", "logs", "hidden", "rare", "times"],
            )

    scanned = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, known bigint, logs double, hidden double, rare array<bigint>, times array<bigint>")
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    # words that the workers don't hold: their counts join by hash, and are 0 where training has none
    rare = scanned.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    asked = rare.groupBy("hash").agg(F.count("*").alias("n")).join(words_table.select("hash", F.col("n").alias("count")), "hash", "left")
    sizes = scanned.agg(F.sum(F.size("rare"))).first()[0] or 0
    found = look_up(rare, asked, "hash", sizes).groupBy("row").agg(F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("seen"), F.sum(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + ADD)).alias("more"))
    all_rows = scanned.drop("rare", "times").join(found, "row", "left").withColumns({"seen": F.coalesce("seen", F.lit(0)), "more": F.coalesce("more", F.lit(0.0))})
    return all_rows.select(id_col, "n_tokens", (F.col("known") + F.col("seen")).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), (F.col("hidden") + F.col("more")).alias("score"))


def report(docs: DataFrame, folds: int = 10, held_out: int = 0, states: int = STATES, rounds: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from rows whose crc32(id as text) modulo folds isn't held_out. A null
    text counts as empty: its one token is the end. Without training rows all
    words are unseen. Repeated rows have equal scores. Other columns aren't read.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == held_out, F.lit(False))
    bound_batches(docs.sparkSession)
    learn = docs.where(~out).select(id_col, text_col)
    table, words = vocabulary(learn, text_col)
    model = train(learn, words, text_col, states, rounds, seed)
    scored = score(docs, table, words, model, id_col, text_col)
    return scored.select(id_col, out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
