"""Benchmark decontamination by a generalised suffix automaton over the words of all test items.

The automaton reads the words of training documents as a stream and keeps the
longest match that ends at each word. Before that, words whose neighbours can't
be part of a match (a pair of words that no item has) are skipped by array
operations; the automaton decides on all others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .session import bound_batches

#: Words of items in one automaton: the driver builds one at a time, from dictionaries of about 650 bytes a word.
AUTOMATON_WORDS = 100_000
#: Words of items in one pass over the documents: automata of about 60 bytes a word are sent to the workers; more items take further passes.
PASS_WORDS = 1_000_000


def item_words(text: str | None) -> list[bytes]:
    """Normalised words of a text: A-Z in lower case, runs of digits, letters and all that isn't ASCII."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    lower = K.LOWER[raw]
    starts, ends, _ = K.words(lower, np.array([0, len(raw)]), K.ALNUM)
    text_bytes = lower.tobytes()
    return [text_bytes[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _extended(sequences: list[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, suffix links and lengths of the suffix automaton of sequences of numbers."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def clone(p: int, w: int, q: int) -> int:
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    for ids in sequences:
        last = 0
        for w in ids:
            if w in nxt[last]:
                q = nxt[last][w]
                last = q if length[q] == length[last] + 1 else clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else clone(p, w, q)
            last = cur
    return nxt, link, length


class Automaton:
    """Suffix automaton of many word sequences, with the items that each window of words occurs in; all in flat arrays."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        vocabulary: dict[bytes, int] = {}
        held = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for name, words in items if words]
        self.shortest = min((min(len(ids), window) for _, ids in held), default=0)
        nxt, link, length = _extended([ids for _, ids in held])
        # transitions by state and word, sorted
        self.size = max(1, len(vocabulary))
        keys = np.fromiter((state * self.size + w for state, out in enumerate(nxt) for w in out), np.int64)
        targets = np.fromiter((to for out in nxt for to in out.values()), np.int32)
        del nxt
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], targets[order]
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        del link, length
        # words by hash; equal hashes are told apart by the words
        self.text = b"".join(vocabulary)
        self.word_ends = np.cumsum([0, *map(len, vocabulary)])
        hashed = np.array([_hash(w) for w in vocabulary], np.uint64)
        self.order = np.argsort(hashed, kind="stable").astype(np.int32)
        self.words = hashed[self.order]
        pairs = [hashed[ids[:-1]] * np.uint64(3) ^ hashed[ids[1:]] for _, ids in held]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]))
        # (state, words, item): of windows, and of items of fewer words
        self.names: list[str | None] = sorted({name for name, _ in held}, key=lambda n: (n is None, n))
        number = {name: i for i, name in enumerate(self.names)}
        self.short = np.zeros(0, bool)
        self._views()
        found = set()
        for name, ids in held:
            state, n = 0, 0
            for w in ids:
                state, n = self.step(state, n, w)
                if n >= window:
                    found.add((self.narrow(state, window), window, number[name]))
            if len(ids) < window:
                found.add((self.narrow(state, len(ids)), len(ids), number[name]))
        at = np.array(sorted(found), np.int32).reshape(-1, 3)
        self.at, self.at_words, self.at_item = (np.ascontiguousarray(at[:, i]) for i in range(3))
        self.short = np.zeros(len(self.link) if (self.at_words < window).any() else 0, bool)
        self.short[self.at[self.at_words < window]] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._views()

    def _views(self) -> None:
        # single values come faster from these than from arrays
        self._keys, self._targets, self._link, self._length = (memoryview(x) for x in (self.keys, self.targets, self.link, self.length))

    def _to(self, state: int, w: int) -> int:
        key = state * self.size + w
        i = bisect_left(self._keys, key)
        return self._targets[i] if i < len(self._keys) and self._keys[i] == key else -1

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while (to := self._to(state, w)) < 0 and state:
            state = self._link[state]
            n = self._length[state]
        return (to, n + 1) if to >= 0 else (0, 0)

    def narrow(self, state: int, n: int) -> int:
        """The state of the last n words of a match."""
        while self._length[self._link[state]] >= n:
            state = self._link[state]
        return state

    def numbers(self, words: list[bytes], hashes: np.ndarray) -> list[int]:
        """The numbers of words, -1 for those that no item has."""
        out = []
        for word, i in zip(words, np.searchsorted(self.words, hashes).tolist(), strict=True):
            h, found = _hash(word) if i + 1 < len(self.words) and self.words[i] == self.words[i + 1] else None, -1
            while i < len(self.words):
                w = int(self.order[i])
                if self.text[self.word_ends[w] : self.word_ends[w + 1]] == word:
                    found = w
                    break
                if h is None or self.words[i] != h:
                    break
                i += 1
            out.append(found)
        return out

    def items(self, state: int) -> Iterator[tuple[int, int]]:
        """(words, item) of the windows and short items of a state."""
        for i in range(int(np.searchsorted(self.at, state)), int(np.searchsorted(self.at, state, "right"))):
            yield int(self.at_words[i]), int(self.at_item[i])

    def read(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, end) of every window that occurs, in words, and the numbers of the items that they are from."""
        spans, found = [], set()
        state = n = 0
        for i, w in enumerate(self.numbers(words, hashes), 1):
            if w < 0:
                state = n = 0
                continue
            state, n = self.step(state, n, w)
            if n >= self.window:
                spans.append((i - self.window, i))
                found.update(item for m, item in self.items(self.narrow(state, self.window)) if m == self.window)
            if len(self.short):
                at = state
                while at > 0:
                    if self.short[at]:
                        for m, item in self.items(at):
                            if m <= n and m < self.window:
                                spans.append((i - m, i))
                                found.add(item)
                    at = self._link[at]
        return spans, found


def _hash(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return K.word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    coarse = np.zeros(1 << 16, bool)
    coarse[(table >> np.uint64(48)).astype(np.int64)] = True
    out = coarse[(values >> np.uint64(48)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(table, values[some]), len(table) - 1)
    out[some] = table[at] == values[some]
    return out


def _runs(machine: Automaton, hashes: np.ndarray, of: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By document: runs of words of which each two neighbours are neighbours in an item."""
    runs: dict[int, list[tuple[int, int]]] = {}
    if not len(hashes) or not machine.shortest:
        return runs
    if machine.shortest == 1:
        inside = _member(hashes, machine.words)
        lo = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        hi = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    else:
        joined = _member(hashes[:-1] * np.uint64(3) ^ hashes[1:], machine.pairs)
        lo = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]]))
        hi = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]])) + 2
    # a run is of at least so many words; it may reach over documents, which are then read apart
    keep = hi - lo >= machine.shortest
    for a, b in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True):
        d = int(np.searchsorted(of, a, "right")) - 1
        while d < len(of) - 1 and of[d] < b:
            x, y = max(a, int(of[d])), min(b, int(of[d + 1]))
            if y - x >= machine.shortest:
                runs.setdefault(d, []).append((x, y))
            d += 1
    return runs


def scan(texts: pa.Array, machines: list[Automaton]) -> Iterator[tuple[int, int, list[tuple[int, int]], set]]:
    """(row, words, merged hit spans in words, items) for each text."""
    for first, end, data, offsets in K.blocks(texts):
        lower = K.LOWER[data]
        starts, ends, of = K.words(lower, offsets, K.ALNUM)
        count = np.diff(of).tolist()
        hashes = K.word_hashes(lower, starts, ends)
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set] = {}
        text = None
        for machine in machines:
            for d, runs in _runs(machine, hashes, of).items():
                text = text if text is not None else lower.tobytes()
                for x, y in runs:
                    got, items = machine.read([text[s:e] for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)], hashes[x:y])
                    base = x - int(of[d])
                    spans.setdefault(d, []).extend((s + base, e + base) for s, e in got)
                    found.setdefault(d, set()).update(machine.names[i] for i in items)
        for d in range(end - first):
            yield first + d, count[d], merge(spans.get(d, [])), found.get(d, set())


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _passes(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[Automaton]]:
    """Automata of all items, those of about PASS_WORDS words at a time: the driver holds the words of one pass and builds one automaton."""
    size = items.agg(F.sum(F.octet_length(text_col)).alias("b")).first().b or 0
    # a word and what parts it take two bytes at least; real text takes five or more
    n = max(1, -(-size // (5 * PASS_WORDS)))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k) if n > 1 else items
        rows = part.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct().toLocalIterator()
        held = sorted(((r.i, item_words(r.t)) for r in rows), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        machines: list[Automaton] = []
        block: list[tuple[str | None, list[bytes]]] = []
        room = AUTOMATON_WORDS
        for item in held:
            if block and room < len(item[1]):
                machines.append(Automaton(block, window))
                block, room = [], AUTOMATON_WORDS
            block.append(item)
            room -= len(item[1])
        yield [*machines, Automaton(block, window)]


def hits(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hit_spans (array of start and end in words, merged) and hit_items (ids as strings, sorted).

    A window is `window` words in a row of an item, or a whole item of fewer
    words; a null or wordless text or item has none. Items without an id are one
    item, whose id is a null at the end of hit_items. Without items nothing is hit;
    an empty table of docs has no rows. Columns of docs with the added names are
    replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    passes = [_apply(docs, docs.sparkSession.sparkContext.broadcast(machines), text_col) for machines in _passes(items, item_id, item_text, window)]
    if len(passes) == 1:
        return passes[0]

    # what further passes found joins by the row's id and text, and is united
    empty = F.array().cast("array<struct<start:int,end:int>>")
    more = reduce(DataFrame.unionByName, [p.select(F.col(id_col).alias("_vesper_id"), F.xxhash64(text_col).alias("_vesper_hash"), F.col("hit_spans").alias("_vesper_spans"), F.col("hit_items").alias("_vesper_items")) for p in passes[1:]])
    more = more.groupBy("_vesper_id", "_vesper_hash").agg(F.flatten(F.collect_set("_vesper_spans")).alias("_vesper_spans"), F.flatten(F.collect_set("_vesper_items")).alias("_vesper_items"))
    both = passes[0].join(more, F.col(id_col).eqNullSafe(F.col("_vesper_id")) & (F.xxhash64(text_col) == F.col("_vesper_hash")), "left")

    def add(out, x):
        last = F.try_element_at(out, F.lit(-1))
        longer = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(out) == 0, F.array(x)).when(x["start"] <= last["end"], longer).otherwise(F.concat(out, F.array(x)))

    united = F.aggregate(F.array_sort(F.concat("hit_spans", F.coalesce("_vesper_spans", empty))), empty, add)
    names = F.array_sort(F.array_union("hit_items", F.coalesce("_vesper_items", F.array().cast("array<string>"))))
    return both.withColumn("hit_spans", united).withColumn("hit_items", names).drop("_vesper_id", "_vesper_hash", "_vesper_spans", "_vesper_items")


def _apply(docs: DataFrame, machines, text_col: str) -> DataFrame:
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", spans_type), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    names = docs.columns
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(scan(batch.column(names.index(text_col)), machines.value))
            spans = pa.array([[{"start": s, "end": e} for s, e in r[2]] for r in rows], pa.list_(span))
            found = pa.array([sorted(r[3], key=lambda n: (n is None, n or "")) for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[1] for r in rows], pa.int64()), spans, found], names=[*names, "n_words", "hit_spans", "hit_items"])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, n_words, n_hit (words inside windows), n_items, items_sha256, contaminated, for each row.

    contaminated: some word is hit, and those that are hit are at least that
    share of the words. Rows that repeat an id or have none keep a row each; a null
    text has no words. Items without an id count as one item, which the digest
    leaves out. Empty tables as in hits(). Other columns aren't read.
    """
    found = hits(docs.select(id_col, text_col), items, window, id_col, text_col, item_id, item_text)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(round(1 / share)) >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: float = 0.05, longest: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without benchmark passages, with its own columns.

    A row whose hit words reach that share of its words goes. Of other rows, hit
    spans of more than `longest` words are cut out of the text (None: they stay);
    a text without such spans is left as it is, null included.
    """
    found = hits(docs, items, window, id_col, text_col, item_id, item_text)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = found.where(~((n_hit > 0) & (n_hit * F.lit(round(1 / share)) >= F.col("n_words"))))
    if longest is not None:
        names = kept.columns

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, spans_at = names.index(text_col), names.index("hit_spans")
            for batch in batches:
                texts = batch.column(at).to_pylist()
                for i, spans in enumerate(batch.column(spans_at).to_pylist()):
                    long = [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] > longest]
                    if long:
                        texts[i] = without(texts[i], long)
                columns = batch.columns
                columns[at] = pa.array(texts, batch.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        kept = kept.mapInArrow(cut, kept.schema)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends, _ = K.words(K.LOWER[raw], np.array([0, len(raw)]), K.ALNUM)
    out, at = [], 0
    for s, e in spans:
        out.append(data[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, data[at:]]).decode()


#: DuckDB SQL of report() with its defaults over the tables documents and benchmark.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (
  SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.k = x.k
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
