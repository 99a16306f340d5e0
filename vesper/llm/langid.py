"""Language identification by interpolated Kneser-Ney character models.

One model of character n-grams for each language, over all letters. The n-grams of
all languages are stored in arrays sorted by their hash, with their probability in
each language that has them, and contexts with the weight of the next lower order. A text's language is the one of lowest
cross-entropy per character; where that is higher than what the language's own
held-back texts reach, the text is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .session import bound_batches

#: Rows that the models are fitted on, about, chosen by hash of the id: of each language, and of all together.
SAMPLE_ROWS, SAMPLE_ALL = 3000, 120_000
#: Characters of an n-gram; six at most, as three code points are packed in a long.
ORDER = 4
#: Bytes of text that are scored at once.
BLOCK_BYTES = 1 << 20
#: Probabilities that a worker keeps at most, and those that it works on at once.
KEPT, AT_ONCE = 1 << 25, 1 << 22


def _fold_table() -> np.ndarray:
    """Code point to lower-case code point; what isn't a letter becomes 0."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(ch)[0] == "M":
            table[c] = c
    return table


_fold: list[np.ndarray] = []


def fold() -> np.ndarray:
    if not _fold:
        _fold.append(_fold_table())
    return _fold[0]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of the texts, runs of anything else as one 0 before and after each word, and each text's offsets.

    Every text begins with a 0; a text of more than that ends with one.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offsets]
    folded = fold()[points]
    n = len(at) - 1
    # a 0 between texts
    put = np.zeros(len(folded) + n, np.int32)
    own = np.arange(len(folded)) + 1 + np.repeat(np.arange(n), np.diff(at))
    put[own] = folded
    starts = at[:-1] + np.arange(n)
    keep = np.ones(len(put), bool)
    keep[1:] = (put[1:] != 0) | (put[:-1] != 0)
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return put[keep], np.append(kept[starts], kept[-1])


def _hash(symbols: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, given their code points from the last one back."""
    out = np.full(len(symbols[0]), len(symbols), np.uint64)
    for c in symbols:
        out = out * np.uint64(0x9FB21C651E98DF25) + K.mix(c.astype(np.uint64) + np.uint64(1))
    return K.mix(out)


def _back(letters: np.ndarray, of: np.ndarray, order: int) -> list[np.ndarray]:
    """Each position's character and those before it, `order` in all; those before a text's start count as space."""
    out = [letters]
    for j in range(1, order):
        x = np.zeros(len(letters), letters.dtype)
        x[j:] = letters[:-j]
        for k in range(j):
            at = of[:-1] + k
            x[at[at < of[1:]]] = 0
        out.append(x)
    return out


@dataclass
class Sparse:
    """Values by hash and language: hashes are sorted, and those of the i-th are at[i] to at[i + 1] of the others."""

    hashes: np.ndarray
    at: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        """parts: hashes and values by language."""
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
        language = np.concatenate([np.zeros(0, np.int32), *(np.full(len(h), i, np.int32) for i, (h, _) in enumerate(parts))])
        order = np.argsort(hashes, kind="stable")
        found, first = np.unique(hashes[order], return_index=True)
        value = np.concatenate([np.zeros(0), *(v for _, v in parts)])
        return Sparse(found, np.append(first, len(hashes)).astype(np.int32), language[order], value[order].astype(np.float32))

    def fill(self, into: np.ndarray, hashes: np.ndarray) -> None:
        """Puts the values of hashes into their rows, beside what else is there."""
        if not len(self.hashes):
            return
        i, there = _find(self.hashes, hashes)
        row = np.flatnonzero(there)
        count = self.at[i[row] + 1] - self.at[i[row]]
        start = np.cumsum(count) - count
        which = np.repeat(self.at[i[row]] - start, count) + np.arange(int(count.sum()))
        into[np.repeat(row, count), self.language[which]] = self.value[which]


@dataclass
class Models:
    """All languages' models: p[m] of m-grams, back[m] the weight of what follows a context of m characters."""

    languages: list[str]
    order: int
    #: different characters that were learnt, and one for all others
    size: int = 1
    p: dict[int, Sparse] = field(default_factory=dict)
    back: dict[int, Sparse] = field(default_factory=dict)
    #: cross-entropy in bits that own texts stay under, and how margins become scores
    worst: np.ndarray | None = None
    slope: float = 1.0

    def probabilities(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Of the last character after those before it, for each n-gram and language."""
        n = len(symbols[0])
        p = np.full((n, len(self.languages)), 1.0 / self.size)
        for m in range(1, self.order + 1):
            weight = np.ones_like(p)
            self.back[m - 1].fill(weight, _hash(symbols[1:m]) if m > 1 else np.zeros(n, np.uint64))
            own = np.zeros_like(p)
            self.p[m].fill(own, _hash(symbols[:m]))
            p = own + weight * p
        return p


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def kneser_ney(counted: list[tuple[list[np.ndarray], np.ndarray]], languages: list[str], order: int = ORDER) -> Models:
    """Models of counted n-grams: by language, the code points of each from the last one back, and how often it is there.

    The highest order has counts, lower ones the numbers of different characters
    before; one discount an order and language, n1 / (n1 + 2 n2).
    """
    p: dict[int, list] = {m: [] for m in range(1, order + 1)}
    back: dict[int, list] = {m: [] for m in range(order)}
    for symbols, number in counted:
        number = number.astype(np.float64)
        for m in range(order, 0, -1):
            contexts = _hash(symbols[1:m]) if m > 1 else np.zeros(len(number), np.uint64)
            firsts, of = np.unique(contexts, return_inverse=True)
            total, kinds = np.bincount(of, number, len(firsts)), np.bincount(of, minlength=len(firsts))
            n1, n2 = (number == 1).sum(), (number == 2).sum()
            discount = float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.9))
            p[m].append((_hash(symbols[:m]), (number - discount) / total[of] if len(number) else number))
            back[m - 1].append((firsts, discount * kinds / total if len(number) else total))
            if m > 1:
                _, one, times = np.unique(_hash(symbols[: m - 1]), return_index=True, return_counts=True)
                symbols, number = [c[one] for c in symbols[: m - 1]], times.astype(np.float64)
    seen = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for symbols, _ in counted for c in symbols[:1])]))
    return Models(languages, order, len(seen) + 1, {m: Sparse.of(x) for m, x in p.items()}, {m: Sparse.of(x) for m, x in back.items()})


class Scorer:
    """Cross-entropies of texts; n-grams are looked up once and then kept."""

    def __init__(self, models: Models):
        self.models = models
        self.known = np.zeros(0, np.uint64)
        self.bits = np.zeros((0, len(models.languages)), np.float32)

    def rows(self, hashes: np.ndarray, symbols: list[np.ndarray]) -> np.ndarray:
        """Each n-gram's row of bits."""
        asked, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~_find(self.known, asked)[1]) if len(self.known) else np.arange(len(asked))
        if len(new):
            languages = self.bits.shape[1]
            if (len(self.known) + len(new)) * languages > KEPT:
                new, self.known, self.bits = np.arange(len(asked)), self.known[:0], self.bits[:0]
            step = max(1, AT_ONCE // (8 * languages))
            at = first[new]
            found = [-np.log2(np.maximum(self.models.probabilities([c[at[lo : lo + step]] for c in symbols]), 1e-30)).astype(np.float32) for lo in range(0, len(at), step)]
            every = np.concatenate([self.known, asked[new]])
            order = np.argsort(every)
            self.known, self.bits = every[order], np.concatenate([self.bits, *found])[order]
        return np.searchsorted(self.known, asked)[of]

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by text and language, and the number of characters."""
        letters, of = characters(data, offsets)
        symbols = _back(letters, of, self.models.order)
        n = np.diff(of) - 1
        total = np.zeros((len(n), self.bits.shape[1]))
        # so many positions that neither their rows nor the n-grams new among them are too many
        step = max(1, AT_ONCE // self.bits.shape[1])
        for lo in range(0, len(letters), step):
            part = [c[lo : lo + step] for c in symbols]
            rows = self.rows(_hash(part), part)
            each = self.bits[rows]
            first = int(np.searchsorted(of, lo, "right")) - 1
            last = int(np.searchsorted(of, lo + len(rows), "left"))
            starts = of[first:last] - lo
            each[starts[starts >= 0]] = 0  # the space before a text isn't predicted
            total[first:last] += np.add.reduceat(each, np.maximum(starts, 0), axis=0, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, order: int = ORDER) -> Models:
    """Models of all languages that docs name, from about `rows` rows of each, chosen by a hash of the id.

    Of more than SAMPLE_ALL / rows languages each has an equal share of SAMPLE_ALL
    rows. Rows without text or language teach nothing. Every fifth of the chosen
    rows is held back to calibrate rejection. Raises ValueError where no language
    is left. The driver holds the sample's n-grams, whatever the input.
    """
    if not 2 <= order <= 6:
        raise ValueError("n-grams have two to six characters")
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        raise ValueError("no labelled text to learn from")
    languages = sorted(sizes)
    rows = min(rows, max(1, SAMPLE_ALL // len(languages)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rows / sizes[lang])))])
    number = {lang: i for i, lang in enumerate(languages)}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(draw < F.element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col), F.lit("held back")), F.lit(5)).alias("fold"), F.col(text_col).alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            fold_of = np.array(batch.column(1).to_pylist())
            for first, end, data, offsets in K.blocks(batch.column(2)):
                letters, of = characters(data, offsets)
                symbols = _back(letters, of, order)
                use = np.repeat(fold_of[first:end] > 0, np.diff(of))
                use[of[:-1]] = False
                lang = np.repeat(np.array([number[x] for x in names[first:end]]), np.diff(of))[use]
                symbols = [c[use].astype(np.int64) for c in symbols]
                _, one, n = np.unique(_hash([*symbols, lang]), return_index=True, return_counts=True)
                halves = [sum((c[one] << (21 * i) for i, c in enumerate(symbols[k : k + 3])), np.zeros(len(one), np.int64)) for k in (0, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(lang[one].astype(np.int32)), pa.array(halves[0]), pa.array(halves[1]), pa.array(n)], names=["lang", "late", "early", "n"])

    counted = sample.mapInArrow(grams, "lang int, late bigint, early bigint, n bigint").groupBy("lang", "late", "early").agg(F.sum("n").alias("n")).toArrow()
    lang, late, early, n = (counted.column(i).to_numpy() for i in range(4))
    by = []
    for i in range(len(languages)):
        own = lang == i
        points = [half >> (21 * k) & 0x1FFFFF for half in (late[own], early[own]) for k in range(3)]
        by.append((points[:order], n[own]))
    models = kneser_ney(by, languages, order)

    # held-back texts: what entropy own texts reach, and how margins go with errors
    held = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, data, offsets in K.blocks(batch.column(2)):
                bits, chars = scorer.entropies(data, offsets)
                lang = np.array([number[x] for x in names[first:end]])
                own = bits[np.arange(len(lang)), lang]
                others = bits.copy()
                others[np.arange(len(lang)), lang] = np.inf
                margin = np.minimum(others.min(1) - own, 99.0)
                some = chars > 0
                yield pa.RecordBatch.from_arrays([pa.array(lang[some], pa.int32()), pa.array(own[some]), pa.array(margin[some]), pa.array(chars[some])], names=["lang", "own", "margin", "chars"])

    measured = sample.where("fold = 0").mapInArrow(measure, "lang int, own double, margin double, chars bigint").toArrow().to_pandas()
    whole = measured[measured.chars >= 100]
    spread = whole.groupby("lang").own.agg(["mean", "std"]) if len(whole) else None
    ceiling = np.log2(models.size)
    models.worst = np.array([ceiling if spread is None or i not in spread.index else min(ceiling, spread["mean"][i] + max(8 * np.nan_to_num(spread["std"][i]), 2.0)) for i in range(len(languages))])
    wrong = measured[(measured.margin < 0) & (measured.margin > -99)]
    # the score is 1/2 at no margin; a typical wrong margin is a score of about 0.73
    models.slope = float(np.clip(1 / max(1e-3, -wrong.margin.mean()) if len(wrong) else 20.0, 1.0, 50.0))
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), entropy (bits a character) and lang_rejected; columns of these names are replaced.

    A text that is null or has no letter is `und`, score 0, and rejected; so is
    one of 100 characters or more that its best language's model finds stranger
    than its own held-back texts by over eight standard deviations and two bits
    at least. Ties go to the first language in code point order.
    """
    docs = docs.drop("lang_pred", "score", "entropy", "lang_rejected")
    held = docs.sparkSession.sparkContext.broadcast(models)
    names = docs.columns
    at = [n.lower() for n in names].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        known = np.array([*held.value.languages, "und"], object)
        for batch in batches:
            best, score, bits_of, rejected = [], [], [], []
            letters = batch.column(len(names)).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in K.blocks(batch.column(at), BLOCK_BYTES):
                bits, chars = scorer.entropies(data, offsets)
                order = np.argsort(bits, axis=1, kind="stable")
                top = order[:, 0]
                rows = np.arange(len(top))
                own = bits[rows, top]
                margin = bits[rows, order[:, 1]] - own if bits.shape[1] > 1 else np.full(len(top), 99.0)
                none = ~letters[first:end]
                best.append(np.where(none, len(known) - 1, top))
                score.append(np.where(none, 0.0, 1 / (1 + np.exp(-np.minimum(held.value.slope * margin, 50)))))
                bits_of.append(np.where(none, np.nan, own))
                rejected.append(none | ((own > held.value.worst[top]) & (chars >= 100)))
            cat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
            entropy = cat(bits_of, float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(known[cat(best, int)], pa.string()), pa.array(cat(score, float)), pa.array(entropy, mask=np.isnan(entropy)), pa.array(cat(rejected, bool))], names=[*names, "lang_pred", "score", "entropy", "lang_rejected"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    bound_batches(docs.sparkSession)
    # marks alone don't make a language
    letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    return docs.withColumn("_vesper_letters", letters).mapInArrow(run, schema)


def report(docs: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """id_col, held_out, lang_pred, score, entropy, rejected; learnt from rows whose crc32(id as text) modulo folds isn't held_out.

    A row without an id teaches nothing. Where no row teaches a language, all
    texts are `und`, score 0 and rejected; an empty table has no rows.
    """
    out = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == held_out
    if docs.where(~out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).isEmpty():
        return docs.select(id_col, F.coalesce(out, F.lit(False)).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    models = train(docs.select(id_col, text_col, lang_col).where(~out), id_col, text_col, lang_col, rows)
    found = identify(docs.select(id_col, text_col), models, id_col, text_col)
    return found.select(id_col, F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", F.col("lang_rejected").alias("rejected"))
