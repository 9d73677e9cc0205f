"""The best documents of many queries over one block of postings: exact, without a row for each document and query.

A document's score is the sum of its parts over the query's terms. A query's terms are taken by their greatest part; documents
that hold none of the terms before a term can't pass the sum of the greatest parts from there on (MaxScore), so lists are cut,
or left out, as soon as that falls below the query's last place so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents of a slice; entries of the dense columns a slice keeps; terms from which a query is summed over all documents at once.
SLICE, DENSE, LONG = 16_384, 8_000_000, 9
#: Scores are compared by so many parts of one, as ``round(score, 9)`` does; sums that differ less than SLACK may be equal.
UNIT, SLACK = 1e9, 2e-9


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's number in the order of the values, nulls last; the values in that order."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


class _Slice:
    """Postings of some documents by term, each term's by part, the greatest first."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, terms: int, documents: int, used: np.ndarray):
        order = np.lexsort((-part, term))
        self.doc, self.part, self.documents = doc[order], part[order], documents
        self.less = -self.part
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))]).tolist()
        self.most = np.zeros(terms)
        np.maximum.at(self.most, term, part)
        self.dense = {}
        for t in np.argsort(-used * (self.most > 0), kind="stable")[: max(1, DENSE // documents)].tolist():
            self.dense[t] = np.zeros(documents)
            lo, hi = self.start[t], self.start[t + 1]
            self.dense[t][self.doc[lo:hi]] = self.part[lo:hi]

    def parts(self, t: int, docs: np.ndarray) -> np.ndarray:
        """The parts of a term in some documents, 0 where it isn't held."""
        column = self.dense.get(t)
        if column is None:
            column = np.zeros(self.documents)
            column[self.doc[self.start[t] : self.start[t + 1]]] = self.part[self.start[t] : self.start[t + 1]]
        return column.take(docs)

    def reaching(self, terms: list[int], most: list[float], least: float, top: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Documents that may be among the ``top`` and their scores; ``terms`` by ``most``, the greatest first."""
        if len(terms) >= LONG:
            total = np.zeros(self.documents)
            for t in terms:
                total[self.doc[self.start[t] : self.start[t + 1]]] += self.part[self.start[t] : self.start[t + 1]]
            docs = np.flatnonzero(total)
            return self._cut(docs, total[docs], least, top)
        found, scores, rest = [], [], sum(most)
        for i, t in enumerate(terms):
            if rest < least - SLACK:
                break
            rest -= most[i]
            lo, hi = self.start[t], self.start[t + 1]
            if (need := least - SLACK - rest) > 0:
                hi = lo + int(self.less[lo:hi].searchsorted(-need, "right"))
            docs, score = self.doc[lo:hi], self.part[lo:hi]
            for other in terms[i + 1 :]:
                score = score + self.parts(other, docs)
            docs, score, _ = self._cut(docs, score, least, top)
            for before in terms[:i]:
                if not len(docs):
                    break
                new = self.parts(before, docs) == 0
                docs, score = docs[new], score[new]
            if len(docs):
                found.append(docs)
                scores.append(score)
                if len(docs) >= top:
                    least = max(least, float(np.partition(score, len(score) - top)[len(score) - top]))
        return (np.concatenate(found), np.concatenate(scores), least) if found else (np.zeros(0, np.int64), np.zeros(0), least)

    @staticmethod
    def _cut(docs: np.ndarray, score: np.ndarray, least: float, top: int) -> tuple[np.ndarray, np.ndarray, float]:
        hit = np.flatnonzero(score >= least - SLACK)
        return docs[hit], score[hit], least


def best(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """``query, key, score``: each query's ``top`` documents of one block, ties to the lesser key. Rows ``term, part, key, query``; those of queries have no part."""
    rows = list(batches)
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    del rows
    is_query = pc.is_null(table["part"])
    term, words = _numbered(table["term"])
    asks = is_query.to_numpy()
    held, asked = table.filter(pc.invert(is_query)), table.filter(is_query)
    if not held.num_rows or not asked.num_rows:
        return
    doc, keys = _numbered(held["key"])
    query, names = _numbered(asked["query"])
    part, term, wants = held["part"].to_numpy(), term[~asks], term[asks]
    del table, held, asked
    used = np.bincount(wants, minlength=len(words))
    scores, docs, filled = np.zeros((len(names), top)), np.zeros((len(names), top), np.int64), np.zeros(len(names), np.int64)
    least = np.zeros(len(names))
    # documents of the greatest sums first: they set high last places, after which little of the other slices is read
    by_sum = np.argsort(-np.bincount(doc, part * used[term], len(keys)), kind="stable")
    at = np.empty(len(keys), np.int64)
    at[by_sum] = np.arange(len(keys))
    at = at[doc]
    for begin in range(0, len(keys), SLICE):
        mine = np.flatnonzero((at >= begin) & (at < begin + SLICE))
        ids = by_sum[begin : begin + SLICE]
        s = _Slice(at[mine] - begin, term[mine], part[mine], len(words), len(ids), used)
        bound = s.most[wants]
        can = np.bincount(query, bound, len(names)) >= least - SLACK
        rows = np.flatnonzero(can[query] & (bound > 0))
        rows = rows[np.lexsort((-bound[rows], query[rows]))]
        each, first = np.unique(query[rows], return_index=True)
        last = np.append(first[1:], len(rows)).tolist()
        terms, most = wants[rows].tolist(), bound[rows].tolist()
        for q, lo, hi in zip(each.tolist(), first.tolist(), last):
            d, score, _ = s.reaching(terms[lo:hi], most[lo:hi], float(least[q]), top)
            if not len(d):
                continue
            if len(d) > top:
                kth = np.partition(score, len(score) - top)[len(score) - top]
                near = score >= kth - SLACK
                d, score = d[near], score[near]
            n = filled[q]
            d, score = np.concatenate([docs[q, :n], ids[d]]), np.concatenate([scores[q, :n], score])
            order = np.lexsort((d, -np.floor(score * UNIT + 0.5)))[:top]
            filled[q] = n = len(order)
            docs[q, :n], scores[q, :n] = d[order], score[order]
            if n == top:
                least[q] = scores[q, :n].min()
        del s
    there = np.arange(top) < filled[:, None]
    out = pa.table({"query": names.take(pa.array(np.repeat(np.arange(len(names)), filled))), "key": keys.take(pa.array(docs[there])), "score": scores[there]})
    yield from out.to_batches(max_chunksize=100_000)
