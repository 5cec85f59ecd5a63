"""Ranked lexical search: the ten best documents of each query by an inner product of impacts, all in integers.

Documents' vectors (impacts of the queries' terms) are put in order of length
and dealt to buckets. The longest of them give every query a first threshold;
below it, Cauchy-Schwarz prunes whole buckets for a query, and inside a bucket
the coordinates on which a query weighs most bound what a document can reach.
What the bounds leave is scored exactly, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, removed, written
from .words import pieces, words

#: Best documents of each query.
BEST = 10
#: Fixed values of the impact: saturation in thousandths, and the share of length in hundredths.
SATURATION, LENGTH = 1000, 90
#: Documents in a bucket, terms of the queries bounded at once, coordinates of a query looked at in one step.
BUCKET, TERMS_AT_ONCE, FOCUS = 512, 4096, 6
#: The share of the documents, the longest vectors, that give first thresholds.
HEAD = 1 / 32
#: Different terms of all queries that are searched for together; more queries are further blocks.
BLOCK_TERMS = 1 << 19

_BYTES = np.arange(256)
_ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_IN_TERM = _ALNUM | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def _inside(data: np.ndarray) -> np.ndarray:
    return _IN_TERM[data]


def _counts(column: pa.Array, vocabulary: pa.Array | None) -> tuple[np.ndarray, np.ndarray, pa.Array | np.ndarray, np.ndarray]:
    """For each text the number of its terms, repeats included; then (text, term, occurrences) of its different terms, in order of texts.

    With a vocabulary only its terms, as places in it; else all, as binary values.
    """
    sizes = np.zeros(len(column), np.int64)
    texts, terms, times = [np.empty(0, np.int64)], [], [np.empty(0, np.int64)]
    for numbers, offsets, data in pieces(column, _inside):
        found, place = words(offsets, _LOWER[data], _inside(data))
        sizes += np.bincount(numbers[place], minlength=len(column))
        if vocabulary is None:
            coded = found.dictionary_encode()
            known, ids, span = np.ones(len(found), bool), coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        else:
            at = pc.index_in(found, value_set=vocabulary)
            known, ids, span = at.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy(zero_copy_only=False), len(vocabulary)
        keys, n = np.unique(numbers[place[known]] * max(1, span) + ids[known], return_counts=True)
        texts.append(keys // max(1, span))
        terms.append(keys % max(1, span) if vocabulary is not None else coded.dictionary.take(pa.array(keys % max(1, span))))
        times.append(n)
    text, n = np.concatenate(texts), np.concatenate(times)
    if vocabulary is None:
        return sizes, text, pa.concat_arrays(terms) if terms else pa.array([], pa.binary()), n
    term = np.concatenate([np.empty(0, np.int64), *terms])
    if len(texts) > 2:  # parts of one text may share terms
        keys, at = np.unique(text * len(vocabulary) + term, return_inverse=True)
        text, term, n = keys // len(vocabulary), keys % len(vocabulary), np.bincount(at, n, len(keys)).astype(np.int64)
    return sizes, text, term, n


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term) of every query, terms as UTF-8 and once each."""
    rows = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, text, terms, _ = _counts(b.column(1), None)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), terms.cast(pa.binary())], ["item_id", "term"])

    return rows.mapInArrow(task, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, times) of every row: its number of terms, and places and occurrences of those in the vocabulary."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = rows.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.binary())
        for b in batches:
            sizes, text, term, times = _counts(b.column(1), known)
            first = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(v.astype(np.int32))) for v in (term, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), *lists], ["doc_id", "n", "terms", "times"])

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, times array<int>")


def weight(documents: int, containing: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * containing + 1)))


class Queries:
    """Queries as sparse rows over the vocabulary, each in order of falling weight; lengths with a weight's root as coordinate.

    Slices of them have few enough different terms for a bucket's impacts to stand in one dense table.
    """

    def __init__(self, first: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.size = np.diff(first)
        number = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((terms, -weights[terms], number))
        terms = terms[order]
        self.first, self.weights = first, weights[terms]
        self.squares = np.concatenate([[0], np.cumsum(self.weights)]).astype(float)
        self.length = np.sqrt(self.squares[first[1:]] - self.squares[first[:-1]])
        # (first query, last query, its terms in order), and each entry's place among its slice's terms
        self.slices, self.column, lo = [], np.zeros(len(terms), np.int64), 0
        while lo < len(self.size):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + TERMS_AT_ONCE, "right")) - 1)
            known, self.column[first[lo] : first[hi]] = np.unique(terms[first[lo] : first[hi]], return_inverse=True)
            self.slices.append((lo, hi, known))
            lo = hi

    def __len__(self) -> int:
        return len(self.size)


class Bucket:
    """Documents of like length, their entries in order of terms."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, norms: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.doc, self.term, self.impact, self.norms = doc[order], term[order], impact[order].astype(np.int32), norms

    def impacts(self, known: np.ndarray) -> np.ndarray:
        """A table of documents by some terms, row by row."""
        low, high = (np.searchsorted(self.term, known, side) for side in ("left", "right"))
        n = high - low
        column = np.repeat(np.arange(len(known)), n)
        at = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n) + low[column]
        out = np.zeros(len(self.norms) * len(known), np.int32)
        out[self.doc[at] * len(known) + column] = self.impact[at]
        return out

    def scored(self, q: Queries, number: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, queries, scores) of a slice of queries: all pairs that reach the query's `least`, exactly, and perhaps others.

        Step by step more coordinates are exact, and the rest of both vectors is
        bounded by their lengths; bounds are floats, rounded up. What is left is
        added up in integers.
        """
        lo, hi, known = q.slices[number]
        alive = lo + np.flatnonzero(q.length[lo:hi] * self.norms.max(initial=0) * (1 + 1e-9) >= least[lo:hi])
        doc, place = np.nonzero(self.norms[:, None] * q.length[alive] * (1 + 1e-9) >= least[alive])
        query = alive[place]
        if not len(query):
            return doc, query, np.empty(0, np.int64)
        table, base = self.impacts(known), doc * len(known)
        score, rest, done = np.zeros(len(doc), np.int64), self.norms[doc] ** 2, 0
        most = int(q.size[query].max())
        while done < most:
            for k in range(done, min(most, done + FOCUS)):
                held = np.flatnonzero(k < q.size[query])
                entry = q.first[query[held]] + k
                x, w = table[base[held] + q.column[entry]].astype(np.int64), q.weights[entry]
                score[held] += w * x
                rest[held] -= (w * x) * x.astype(float)
            done += FOCUS
            upto = np.minimum(q.first[query] + done, q.first[query + 1])
            tail = q.squares[q.first[query + 1]] - q.squares[upto]
            near = score + np.sqrt(np.maximum(rest, 0) * tail) + 1e-6 * self.norms[doc] * q.length[query] * (tail > 0) >= least[query]
            doc, query, base, score, rest = doc[near], query[near], base[near], score[near], rest[near]
        return doc, query, score


class Best:
    """For each query the best of what came so far, by score and then by id; `least` is what a further document needs."""

    def __init__(self, least: np.ndarray, best: int):
        self.floor, self.best = least, best
        self.least = least.copy()
        self.query, self.doc, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray, rank: np.ndarray) -> None:
        """doc: numbers of documents, whose order by id is rank[doc]."""
        query, doc, score = (np.concatenate(x) for x in ((self.query, query), (self.doc, doc), (self.score, score)))
        order = np.lexsort((rank[doc], -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.best
        self.query, self.doc, self.score = query[keep], doc[keep], score[keep]
        last = place[keep] == self.best - 1
        self.least[self.query[last]] = np.maximum(self.floor[self.query[last]], self.score[last])


def searched(found: DataFrame, q: Queries, least: np.ndarray, best: int) -> DataFrame:
    """(query, doc_id, score): of each batch of vectors, in order of falling length, the best of each query that reach its `least` score, above 0."""
    held = found.sparkSession.sparkContext.broadcast((q, least))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = held.value
        floor = np.maximum(floor, 1)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids, norms = b.column("doc_id"), b.column("norm").to_numpy(zero_copy_only=False)
            lists, impacts = b.column("terms"), b.column("impacts").flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            first, terms = np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.empty(n, np.int64)
            rank[pc.array_sort_indices(ids, null_placement="at_end").to_numpy(zero_copy_only=False).astype(np.int64)] = np.arange(n)
            top = Best(floor, best)
            for at in range(0, n, BUCKET):
                to = min(n, at + BUCKET)
                doc = np.repeat(np.arange(to - at), sizes[at:to])
                bucket = Bucket(doc, terms[first[at] : first[to]], impacts[first[at] : first[to]], norms[at:to])
                for number in range(len(q.slices)):
                    d, query, score = bucket.scored(q, number, top.least)
                    good = score >= top.least[query]
                    top.add(query[good], at + d[good], score[good], rank)
            yield pa.RecordBatch.from_arrays([pa.array(top.query), ids.take(pa.array(top.doc)), pa.array(top.score)], ["query", "doc_id", "score"])

    return found.select("doc_id", "norm", "terms", "impacts").mapInArrow(task, f"query long, doc_id {found.schema['doc_id'].dataType.simpleString()}, score long")


def _top(rows: DataFrame, best: int) -> DataFrame:
    """The best rows of each query with rank; Spark limits each task's before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).filter(F.col("rank") <= best)


def _blocks(terms: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray, pa.Array]]:
    """(ids, query of each entry, terms of the entries) of the queries in blocks of `most` terms and one query more at most; a block is what is collected and broadcast."""
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"))
    order = F.struct(F.xxhash64("item_id").alias("hash"), "item_id")
    longest = sizes.agg(F.max("terms")).first()[0] or 0
    if longest > most:
        raise ValueError(f"a query has {longest} different terms; at most {most} can be searched for")
    total = sizes.agg(F.sum("terms")).first()[0] or 0
    share = max(1, math.ceil(2 * total / most))  # hashed to blocks of half the size on average
    sizes = written(sizes.withColumn("part", F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(share))), "search-queries")
    for part in range(share):
        inside = sizes.filter(F.col("part") == part).withColumn("upto", F.sum("terms").over(Window.partitionBy("part").orderBy(order)))
        cut = written(inside.select(F.col("item_id").alias("_id"), F.floor(F.col("upto") / most).alias("cut")), "search-block")
        for (at,) in sorted(cut.select("cut").distinct().collect()):
            here = cut.filter(F.col("cut") == at)
            rows = terms.join(if_small(here), F.col("item_id").eqNullSafe(F.col("_id"))).select("item_id", "term").toArrow()
            ids = rows.column("item_id").combine_chunks()
            coded = ids.dictionary_encode(null_encoding="encode")
            yield coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.column("term").combine_chunks()
        removed(cut)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's `best` documents with a score above 0, equal scores by ascending id, null last.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A
    to Z in lower case; whole texts count. Null, empty and blank texts have no
    term and are in no result, nor do they count as documents. Rows that repeat
    are ranked one by one; queries of one id are one query with the terms of
    all. No documents or no queries: no rows. Queries are searched for in
    blocks of `block_terms` different terms at most; one query with more is an
    error. Other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    kinds = {"item_id": queries.schema[item_id_col].dataType.simpleString(), "doc_id": docs.schema[id_col].dataType.simpleString()}
    terms = written(query_terms(queries, item_id_col, item_text_col), "search-terms")
    results = []
    for ids, query, entries in _blocks(terms, block_terms):
        results.append(_search_block(docs, id_col, text_col, ids, query, entries, best, kinds))
    if not results:
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _search_block(docs: DataFrame, id_col: str, text_col: str, ids: pa.Array, query: np.ndarray, entries: pa.Array, best: int, kinds: dict[str, str]) -> DataFrame:
    spark = docs.sparkSession
    coded = entries.dictionary_encode()
    vocabulary, term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counted = written(vectors(docs, id_col, text_col, vocabulary), "search-counts")
    n, total = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    containing = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[containing.column("term").to_numpy()] = containing.column("count").to_numpy()
    weights = np.array([weight(n, d) for d in df.tolist()], np.int64)
    order = np.argsort(query, kind="stable")
    q = Queries(np.searchsorted(query[order], np.arange(len(ids) + 1)), term[order], weights)

    size = f"({100 - LENGTH} + div({LENGTH} * n * {n}L, {max(1, total)}L))"
    impact = f"transform(times, x -> div({SATURATION}000000L * x, {SATURATION}L * x + 8 * {size}))"
    held = spark.sparkContext.broadcast(weights)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            impacts = b.column("impacts").flatten().to_numpy(zero_copy_only=False).astype(float)
            squares = held.value[b.column("terms").flatten().to_numpy(zero_copy_only=False)] * impacts * impacts
            sizes = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)
            norm = np.sqrt(np.bincount(np.repeat(np.arange(b.num_rows), sizes), squares, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm)], [*b.schema.names, "norm"])

    found = counted.filter(F.size("terms") > 0).select("doc_id", "terms", F.expr(impact).alias("impacts"))
    found = found.mapInArrow(lengths, f"doc_id {kinds['doc_id']}, terms array<int>, impacts array<long>, norm double").filter("norm > 0")
    # copies are of one length: their ids deal them to several ranges
    dealt = found.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("norm"))
    ordered = written(dealt, "search-vectors")
    removed(counted)
    cut = ordered.agg(F.percentile_approx("norm", 1 - HEAD)).first()[0]
    if cut is None:
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")

    least = np.zeros(len(q), np.int64)
    head = written(_top(searched(ordered.filter(F.col("norm") >= cut), q, least, best), best), "search-head")
    full = head.filter(F.col("rank") == best).select("query", "score").toArrow()
    least[full.column("query").to_numpy()] = full.column("score").to_numpy()
    # no shorter vector can reach any query's threshold
    shortest = float((np.maximum(least, 1) / np.maximum(q.length, 1e-300)).min()) * (1 - 1e-9)
    rest = searched(ordered.filter((F.col("norm") < cut) & (F.col("norm") >= shortest)), q, least, best)
    top = _top(head.drop("rank").unionByName(rest), best)
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids))), "item_id": ids}))
    named = top.join(F.broadcast(names), "query").select(F.col("item_id").cast(kinds["item_id"]).alias("item_id"), "rank", "doc_id", "score")
    return written(named, "search-found")


#: The same in DuckDB: all terms of all documents.
ORACLE_SQL = r"""
with t as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
total as (select count(*) as n, cast(sum(len(ws)) as bigint) as l from t where len(ws) > 0),
item as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
tf as (select r, doc_id, len(ws) as size, unnest(ws) as term from t),
counted as (select r, any_value(doc_id) as doc_id, cast(any_value(size) as bigint) as size, term, count(*) as tf from tf where term in (select term from item) group by r, term),
df as (select term, count(*) as df from counted group by 1),
w as (select term, cast(floor(1000 * ln((2 * total.n + 2) / cast(2 * df + 1 as double))) as bigint) as w from df, total),
impact as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * total.n) // total.l))) as x from counted join w using (term), total),
score as (select item_id, r, any_value(doc_id) as doc_id, cast(sum(x) as bigint) as score from item join impact using (term) group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from score where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
