"""Ranked lexical search: impact-ordered lists and the Best Position Algorithm.

One pass over the documents keeps, for each, its number of terms and the places of the query set's terms in it (``postings``);
two aggregations over these give the number of documents, of all terms, and of documents that hold each term. Documents then stay
where they are: a task takes a block of them at a time, makes for every term the list of its documents by falling impact, and
answers every query over the block. The task's k best of earlier blocks are carried on, so later blocks stop sooner; k rows a
query and task go to the last ranking.

The Best Position Algorithm reads the lists of a query side by side from their tops. Each document it meets is looked up in all
lists of the query at once (direct access), which scores it and marks its place in each list. The best position of a list is
the end of the stretch of places, from the top, that have been seen, in whatever order; a document not met yet lies behind it in
every list. So no such document scores more than the sum of the impacts there, a tighter bound than that of the last places read.
Reading stops when this sum is strictly below the k-th score: documents of the same score are still met, and the smaller key wins.

Queries are answered in blocks of about ``QUERY_BYTES`` of text, so neither the driver nor a task holds more of them than that
(a longer query stands alone); each block passes over the documents once.

Terms are maximal runs of letters and digits of ASCII and of all other characters, ``A-Z`` lower-cased; they are told
apart by 64-bit hashes. Null and empty texts have no terms: such documents don't count and are not found, such queries have no
rows. Repeated documents are ranked each; a null key comes last among equal scores. Repeated query rows are answered each.
Other columns are not read. An empty table of documents or of queries gives no rows. Keys of documents are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.functions.skew import top_n
from mapweave.llm.common import materialize, slices
from mapweave.llm.shingles import hash_words

#: bytes that are in no term
SEPARATORS = tuple([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
QUERY_BYTES = 4 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 2_000_000
STEP = 64


@dataclass
class Queries:
    """A block of queries: their ids, the hashes of all their terms in order, and for each its terms and how often it has them."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]


def parse_queries(rows: list[tuple]) -> Queries:
    hashes, at = hash_words(pa.array([r[1] for r in rows], type=pa.string()), SEPARATORS)
    vocabulary, entry = np.unique(hashes[0], return_inverse=True)
    split = [np.unique(entry[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
    return Queries([r[0] for r in rows], vocabulary, [s[0] for s in split], [s[1].astype(np.int64) for s in split])


def _postings_of(batch: pa.RecordBatch, vocabulary: np.ndarray) -> pa.RecordBatch:
    hashes, at = hash_words(batch.column("text"), SEPARATORS)
    words, docs = hashes[0], len(at) - 1
    entry = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    hit = vocabulary[entry] == words
    pairs, tf = np.unique(np.repeat(np.arange(docs), np.diff(at))[hit] * len(vocabulary) + entry[hit], return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(docs + 1) * len(vocabulary)).astype(np.int32))
    return pa.record_batch(
        [batch.column("key"), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array((pairs % len(vocabulary)).astype(np.int32))),
         pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], names=["key", "n", "terms", "tf"])


def postings(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """(key, n, terms, tf) of every document: its number of terms, and of the vocabulary's terms it holds, how often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                yield _postings_of(batch.slice(a, b - a), vocabulary)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        scan, "key long, n long, terms array<int>, tf array<long>")


@dataclass
class Corpus:
    """Counts of all documents: those with terms, their terms, and each vocabulary term's weight."""

    documents: int
    terms: int
    weights: np.ndarray


def corpus_counts(found: DataFrame, size: int) -> Corpus:
    documents, terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(size, dtype=np.int64)
    # one row for each term of the block of queries
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = n
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()]
    return Corpus(documents, terms, np.array(weights, dtype=np.int64))


class Block:
    """Impact lists of a block of documents."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, corpus: Corpus):
        m = 100 - 75 + (75 * n * corpus.documents) // corpus.terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.size = len(n)
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(len(corpus.weights) + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents met and their scores; among them all that are of the k best with a score of ``floor`` or more, ties included."""
        low, high = self.at[terms], self.at[terms + 1]
        use = (high > low) & (weights > 0)
        low, high, weights = low[use], high[use], weights[use]
        if not len(low):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.full((len(low), self.size), -1, dtype=np.int64)  # direct access: each document's place in each list
        for row, a, b in zip(place, low, high, strict=True):
            row[self.doc[a:b]] = np.arange(a, b)
        seen = np.zeros(len(self.doc) + 1, dtype=bool)
        met = np.zeros(self.size, dtype=bool)
        best, docs, scores, step = low.copy(), [], [], STEP
        kth = floor
        while True:
            read = np.concatenate([self.doc[a: min(a + step, b)] for a, b in zip(best, high, strict=True)])
            new = np.unique(read[~met[read]])
            met[new] = True
            at = place[:, new]
            held = at >= 0
            seen[at[held]] = True
            docs.append(new)
            scores.append((np.where(held, self.impact[at], 0) * weights[:, None]).sum(axis=0))
            for i, (a, b) in enumerate(zip(best, high, strict=True)):
                behind = seen[a:b]
                best[i] = b if behind.all() else a + int(np.argmin(behind))
            left = best < high
            bound = int((self.impact[best[left]] * weights[left]).sum())
            known = np.concatenate(scores)
            if len(known) >= k:
                kth = max(kth, int(np.partition(known, -k)[-k]))
            if bound < kth or not left.any():
                return np.concatenate(docs), known
            step *= 2


def _first(k: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k first rows of (key, null key, score): highest score, then smallest key, null keys last."""
    key, null, score = columns
    order = np.lexsort((key, null, -score))[:k]
    return key[order], null[order], score[order]


def best_of_tasks(found: DataFrame, queries: Queries, corpus: Corpus, k: int) -> DataFrame:
    """(query, key, score): of every task, for every query (by its place in the block) the k best."""
    weights = [corpus.weights[t] * n for t, n in zip(queries.terms, queries.times, strict=True)]
    empty = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [empty] * len(queries.ids)
        for rows in _blocks(batches):
            key, null = rows.column("key").fill_null(0).to_numpy(), rows.column("key").is_null().to_numpy(zero_copy_only=False)
            terms = rows.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))
            block = Block(rows.column("n").to_numpy(), doc, terms.flatten().to_numpy().astype(np.int64),
                          rows.column("tf").combine_chunks().flatten().to_numpy(), corpus)
            for i, (t, w) in enumerate(zip(queries.terms, weights, strict=True)):
                floor = int(top[i][2][k - 1]) if len(top[i][2]) == k else 1
                docs, score = block.best(t, w, k, floor)
                good = score >= floor
                docs, score = docs[good], score[good]
                if len(docs):
                    top[i] = _first(k, *(np.concatenate(c) for c in zip(top[i], (key[docs], null[docs], score), strict=True)))
        for i, (key, null, score) in enumerate(top):
            if len(key):
                yield pa.record_batch([pa.array(np.full(len(key), i)), pa.array(key, mask=null), pa.array(score)], names=["query", "key", "score"])

    return found.where("n > 0").mapInArrow(search, "query long, key long, score long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in blocks of at most BLOCK_DOCS documents and about BLOCK_POSTINGS postings."""
    kept, docs, size = [], 0, 0
    for batch in batches:
        at = np.concatenate(([0], np.cumsum(batch.column("terms").value_lengths().to_numpy())))
        low = 0
        while low < len(batch):
            room = int(np.searchsorted(at, at[low] + BLOCK_POSTINGS - size, side="right")) - 1
            high = min(len(batch), low + BLOCK_DOCS - docs, max(room, low if kept else low + 1))
            if high > low:
                kept.append(batch.slice(low, high - low))
                docs, size = docs + high - low, size + int(at[high] - at[low])
            if high < len(batch):
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, docs, size = [], 0, 0
            low = high
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def query_blocks(queries: DataFrame, key: str, text: str, query_bytes: int = QUERY_BYTES) -> Iterator[list[tuple]]:
    """The query rows, dealt to blocks of about ``query_bytes`` of text."""
    total = queries.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / query_bytes))
    block = F.pmod(F.xxhash64(key, text), F.lit(n))
    for i in range(n):
        rows = queries.where(block == i).select(key, F.coalesce(text, F.lit(""))).collect()
        if rows:
            yield [tuple(r) for r in rows]


def search(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 10,
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_key, rank, key, score): of every query row the k documents that score highest, ranked from 1."""
    id_field = queries.schema[query_key]
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_key", id_field.dataType)])
    parts = []
    for rows in query_blocks(queries, query_key, query_text, query_bytes):
        block = parse_queries(rows)
        if not len(block.vocabulary):
            continue
        found = materialize(postings(docs, key, text, block.vocabulary))
        corpus = corpus_counts(found, len(block.vocabulary))
        if not corpus.documents:
            continue
        # cut once by groups of tasks, so that no task gets a query's rows of all tasks
        best = best_of_tasks(found, block, corpus, k).withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(64)))
        order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
        best = top_n(top_n(best, ["query", "cell"], order, k), ["query"], order, k, "rank")
        ids = queries.sparkSession.createDataFrame(list(enumerate(block.ids)), schema)
        parts.append(best.join(F.broadcast(ids), "query"))  # a block of queries is bounded
    if not parts:
        names = queries.sparkSession.createDataFrame([], schema)
        parts = [names.select("query_key", F.lit(0).alias("rank"), F.col("query").alias("key"), F.col("query").alias("score"))]
    out = reduce(DataFrame.unionByName, [p.select("query_key", F.col("rank").cast("int").alias("rank"), "key", "score") for p in parts])
    return out
