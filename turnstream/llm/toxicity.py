"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

The vocabulary is every word, and every stem of a longer word, that LEAST_EXAMPLES labelled examples hold, toxic
or not; every document is a vector over it, with document frequencies over all documents.  Weights also
carry the relevance frequency of a term - how much more often toxic examples hold it than others do -, which only
stretches the axes: no term is left out for its label.  The examples' vectors form an inverted index in blocks,
with the largest weight of each term in each block; a document's blocks are scored in the order of their upper
bounds until none left can reach the K-th neighbour, so the neighbours are exact.  Similarity-weighted votes
of the neighbours, calibrated on the examples (each voted on by the examples of other folds, whose labels alone
weigh the terms), give the score; the neighbours are the evidence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialize, row_key, row_slices, sum_tables, table_rows, text_buffer, without, word_hashes

#: Most labelled rows that examples are learnt from: those with the least hash of the id, while their texts
#: take EXAMPLE_BYTES together at most.  Together they bound the vocabulary and the index.
EXAMPLES = 8192
EXAMPLE_BYTES = 32 << 20
#: Examples that hold a term, at least.
LEAST_EXAMPLES = 2
#: Lengths in bytes of the stems of longer words.
STEMS = (5, 7)
NEIGHBOURS = 25
#: Examples in a block of the index: most terms are in few examples, so smaller blocks would bound little and cost as much as they save.
BLOCK = 1024
#: Most terms that are held as rows of a matrix, of those that one in DENSE_SHARE of the examples has; and texts that are multiplied with it together.
DENSE, DENSE_SHARE, TOGETHER = 1024, 16, 64
#: Folds of the examples for calibration.
FOLDS = 3
#: Similarity of a vote against, that every document has: weak evidence scores low.
DOUBT = 0.15
CUT = 0.7


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all rows and the row of each."""
    data, offsets = text_buffer(column)
    hashes, bounds = word_hashes(data, offsets, STEMS)
    rows = np.repeat(np.arange(len(column)), np.diff(bounds))
    rows = np.tile(rows, len(hashes))
    flat = hashes.ravel()
    real = flat != 0
    return flat[real], rows[real]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    _, offsets = text_buffer(batch.column(text))
    for lo, hi in row_slices(offsets):
        yield batch.slice(lo, hi - lo)


def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task, how many toxic and other examples hold each feature."""
    for whole in batches:
        found = {0: [], 1: []}
        for batch in _slices(whole, 0):
            hashes, rows = _features(batch.column(0))
            label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            hashes, rows = hashes[first], rows[first]
            for y in (0, 1):
                found[y].append(hashes[label[rows] == y])
        for y in (0, 1):
            values, counts = np.unique(np.concatenate(found[y]), return_counts=True)
            zero = np.zeros(len(values), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts if y else zero), pa.array(zero if y else counts)], ["term", "pos", "neg"])


class Vocabulary:
    """Numbers of terms by hash: keys, sorted, and where those of each 22-bit prefix begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.first: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.keys)

    def __getstate__(self):
        return {"keys": self.keys, "first": None}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, or -1."""
        if self.first is None:
            self.first = np.searchsorted(self.keys >> np.uint64(42), np.arange((1 << 22) + 1, dtype=np.uint64)).astype(np.int32)
        prefix = (hashes >> np.uint64(42)).astype(np.int64)
        at, end = self.first[prefix], self.first[prefix + 1]
        found = np.full(len(hashes), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == hashes[live]
            found[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return found

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, counts, offsets by row) of a column of texts; a row's terms ascend."""
        hashes, rows = _features(column)
        terms = self.find(hashes)
        known = terms >= 0
        size = max(len(self), 1)
        pairs, counts = np.unique(rows[known] * size + terms[known], return_counts=True)
        return pairs % size, counts, np.searchsorted(pairs // size, np.arange(len(column) + 1))


def _frequencies(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs = np.zeros(len(vocabulary.value), np.int64), 0
        for whole in batches:
            for batch in _slices(whole, 0):
                table += np.bincount(vocabulary.value.vectors(batch.column(0))[0], minlength=len(table))
            docs += whole.num_rows
        yield from table_rows(table, docs)

    return count


def _vectorise(vocabulary):
    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, toxic, and terms and counts as packed numbers."""
        for whole in batches:
            for batch in _slices(whole, 0):
                terms, counts, bounds = vocabulary.value.vectors(batch.column(0))
                cut = lambda values, kind: pa.array([values[a:b].astype(kind).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), cut(terms, "<i4"), cut(np.minimum(counts, 65535), "<u2")], ["doc_id", "toxic", "terms", "counts"])

    return vectorise


def relevance(pos: np.ndarray, neg: np.ndarray, toxic: float, others: float) -> np.ndarray:
    """Relevance frequency of terms that pos of `toxic` examples hold and neg of the others; 1 at least."""
    return np.log2(2 + (pos / max(toxic, 1)) / ((neg + 1) / max(others, 1)))


Example = tuple[int, np.ndarray, np.ndarray, int]


class Index:
    """A block-max inverted index of examples, and votes of their labels."""

    def __init__(self, examples: list[Example], idf: np.ndarray, base: float = 0.0):
        """examples: (doc_id, terms, counts, label), each with a term; idf: weight of each term; base: score without terms."""
        self.idf, self.base = idf, base
        vectors = [self.vector(t, c).astype(np.float32) for _, t, c, _ in examples]
        # alike examples share blocks, so that the bounds are tight
        order = sorted(range(len(examples)), key=lambda i: (int(examples[i][1][np.argmax(vectors[i])]), examples[i][0]))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = np.array([examples[i][3] for i in order], np.float64)
        self.blocks = -(-len(order) // BLOCK)
        # narrow types and views, as every worker holds an index
        rows = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i]) for i in order])
        terms = np.concatenate([np.asarray(examples[i][1], np.int32) for i in order]) if order else np.zeros(0, np.int32)
        weights = np.concatenate([vectors[i] for i in order]) if order else np.zeros(0, np.float32)
        del vectors
        # the commonest terms, which would have the longest lists, are rows of a matrix
        held = np.bincount(terms, minlength=len(idf))
        common = np.argsort(-held, kind="stable")[:DENSE]
        common = common[held[common] * DENSE_SHARE >= max(len(order), DENSE_SHARE)]
        self.matrix_row = np.full(len(idf), -1, np.int16)
        self.matrix_row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(order)), np.float32)
        dense = self.matrix_row[terms] >= 0
        self.matrix[self.matrix_row[terms[dense]], rows[dense]] = weights[dense]
        rows, terms, weights = rows[~dense], terms[~dense], weights[~dense]
        by_term = np.argsort(terms, kind="stable").astype(np.int32)  # rows ascend already
        self.rows, self.weights, terms = rows[by_term], weights[by_term], terms[by_term]
        del rows, weights, by_term
        # where the postings of each term in each block begin, and the largest weight among them
        blocks = max(self.blocks, 1)
        cells = terms.astype(np.int64) * blocks + self.rows // BLOCK
        self.starts = np.searchsorted(cells, np.arange(len(idf) * blocks + 1)).astype(np.int32)
        begin = np.flatnonzero(np.r_[len(cells) > 0, cells[1:] != cells[:-1]])
        self.most = np.zeros(len(idf) * blocks, np.float32)
        self.most[cells[begin]] = np.maximum.reduceat(self.weights, begin) if len(begin) else 0.0
        self.most = self.most.reshape(len(idf), blocks)
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((weights * weights).sum())
        return weights / norm if norm else weights

    def _read(self, lo: np.ndarray, hi: np.ndarray, share: np.ndarray, sims: np.ndarray) -> None:
        """Add what runs of postings, each with its term's share of the query, give to the examples' cosines."""
        size = hi - lo
        places = np.repeat(lo - np.cumsum(size, dtype=np.int32) + size, size)
        places += np.arange(len(places), dtype=np.int32)
        sims += np.bincount(self.rows[places], np.repeat(share, size) * self.weights[places], minlength=len(sims))

    def common(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the commonest terms give to the cosines of some texts (terms, counts) and all examples: one product of matrices."""
        queries = np.zeros((len(rows), len(self.matrix)), np.float32)
        for i, (terms, counts) in enumerate(rows):
            row = self.matrix_row[terms]
            queries[i, row[row >= 0]] = self.vector(terms, counts)[row >= 0]
        return queries @ self.matrix

    def nearest(self, terms: np.ndarray, counts: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the NEIGHBOURS nearest examples with a common term; ties by row."""
        query = self.vector(terms, counts).astype(np.float32)
        row = self.matrix_row[terms]
        sims = (self.common([(terms, counts)])[0] if common is None else common).astype(np.float64)
        query, terms = query[row < 0], terms[row < 0]
        # what rounding can add stays within the margin
        known = np.maximum.reduceat(sims, np.arange(0, len(sims), BLOCK))
        bounds = (known + query @ self.most[terms]) * (1 + 1e-5)
        # what the matrix gives alone is at most the cosine, so the K-th neighbour is no worse than this
        least = np.partition(sims, -NEIGHBOURS)[-NEIGHBOURS] if len(sims) > NEIGHBOURS else 0.0
        chosen = (bounds >= least) & (bounds > 0)
        at = terms * self.blocks
        if chosen.all():
            self._read(self.starts[at], self.starts[at + self.blocks], query, sims)
        elif chosen.any():
            cells = (at[:, None] + np.flatnonzero(chosen)).ravel()
            self._read(self.starts[cells], self.starts[cells + 1], np.repeat(query, chosen.sum()), sims)
            sims[~np.repeat(chosen, BLOCK)[: len(sims)]] = 0.0
        # so that equal texts tie, whatever they were multiplied with
        sims = np.round(sims, 6)
        if len(sims) > NEIGHBOURS:
            best = np.argpartition(sims, -NEIGHBOURS)[-NEIGHBOURS:]
            least = sims[best].min()
            if least > 0:  # of equal ones the first rows
                best = np.flatnonzero(sims >= least)
            else:
                best = np.flatnonzero(sims)
        else:
            best = np.flatnonzero(sims)
        best = best[np.lexsort((best, -sims[best]))[:NEIGHBOURS]]
        return best, sims[best]

    def votes(self, rows: np.ndarray, sims: np.ndarray) -> float:
        return float((sims * self.labels[rows]).sum() / (sims.sum() + DOUBT)) if len(rows) else 0.0

    def score(self, terms: np.ndarray, counts: np.ndarray, common: np.ndarray | None = None) -> tuple[float, list[int], list[float]]:
        if not len(terms) or not len(self.ids):
            return self.base, [], []
        rows, sims = self.nearest(terms, counts, common)
        vote = self.votes(rows, sims)
        calibrated = float(np.interp(vote, *self.steps))
        return min(1.0, max(0.0, 0.98 * calibrated + 0.02 * vote)), self.ids[rows[:5]].tolist(), sims[:5].tolist()


def calibrated(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and the scores that they stand for, by pooling adjacent violators."""
    if not len(raw):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.lexsort((labels, raw))
    pools: list[list[float]] = []  # sum of labels, size, sum of votes
    for v, y in zip(raw[order], labels[order], strict=True):
        pools.append([y, 1.0, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    # a fifth of a vote for the pool's own mean vote keeps the ends off 0 and 1 and the order strict
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.2 * p[2] / p[1]) / (p[1] + 0.2) for p in pools])


class Examples:
    """The labelled examples, packed; indexes of them are built where they are asked for, and kept there."""

    def __init__(self, examples: list[Example], idf: np.ndarray):
        self.ids = np.array([x[0] for x in examples], np.int64)
        self.labels = np.array([x[3] for x in examples], np.int8)
        self.bounds = np.concatenate([[0], np.cumsum([len(x[1]) for x in examples])]).astype(np.int64)
        self.terms = np.concatenate([x[1] for x in examples] or [np.zeros(0)]).astype(np.int32)
        self.counts = np.concatenate([x[2] for x in examples] or [np.zeros(0)]).astype(np.uint16)
        self.folds = np.array([int.from_bytes(hashlib.blake2b(str(x[0]).encode(), digest_size=4).digest(), "big") % FOLDS for x in examples], np.int8)
        self.idf = idf.astype(np.float32)
        self.built: Index | None = None

    def __getstate__(self):
        return self.__dict__ | {"built": None}

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and counts of an example."""
        part = slice(self.bounds[i], self.bounds[i + 1])
        return self.terms[part].astype(np.int64), self.counts[part].astype(np.float64)

    def index(self, without: int = -1) -> Index:
        """The index of all examples with a term but those of a fold, weighed by their labels."""
        if without < 0 and self.built is not None:
            return self.built
        keep = np.flatnonzero((self.folds != without) & (np.diff(self.bounds) > 0))
        examples = [(int(self.ids[i]), self.terms[a:b], self.counts[a:b], int(self.labels[i])) for i, a, b in zip(keep, self.bounds[keep], self.bounds[keep + 1], strict=True)]
        toxic = sum(x[3] for x in examples)
        pos, neg = (np.zeros(len(self.idf), np.int32) for _ in range(2))
        for x in examples:  # an example holds a term once
            (pos if x[3] else neg)[x[1]] += 1
        built = Index(examples, self.idf * relevance(pos, neg, toxic, len(examples) - toxic).astype(np.float32), self.base())
        if without < 0:
            self.built = built
        return built

    def base(self) -> float:
        """Score of documents without a term: the share of toxic examples among those without, drawn to that of all."""
        none = self.labels[np.diff(self.bounds) == 0]
        return float((none.sum() + (self.labels.mean() if len(self.labels) else 0.0)) / (len(none) + 1.0))


#: Tasks for each fold, and so parts of its examples, in calibration.
FOLD_PARTS = 4


def _fold_votes(examples):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Votes and labels of a part of a fold's examples, by the examples of the other folds."""
        for batch in batches:
            for part in batch.column(0).to_pylist():
                x = examples.value
                index = x.index(part % FOLDS)
                some = np.flatnonzero((x.folds == part % FOLDS) & (np.diff(x.bounds) > 0))[part // FOLDS :: FOLD_PARTS]
                votes = [index.votes(*index.nearest(*x.of(i))) if len(index.ids) else 0.0 for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(x.labels[some].astype(np.float64))], ["vote", "label"])

    return vote


def _scorer(vocabulary, examples, steps):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        index = examples.value.index()
        index.steps = steps
        for whole in batches:
            for batch in _slices(whole, 0):
                terms, counts, bounds = vocabulary.value.vectors(batch.column(0))
                texts = [(terms[a:b], counts[a:b].astype(np.float64)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                keys = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() for t, c in texts]
                if len(known) > 50_000:
                    known.clear()
                fresh = {key: text for key, text in zip(keys, texts, strict=True) if key not in known}
                for at in range(0, len(fresh), TOGETHER):
                    some = list(fresh.items())[at : at + TOGETHER]
                    common = index.common([x for _, x in some])
                    known |= {key: index.score(*x, row) for (key, x), row in zip(some, common, strict=True)}
                out = [known[key] for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(1, batch.num_columns)), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))],
                    [*batch.schema.names[1:], "score", "neighbours", "similarities"],
                )

    return score


def learnable(doc_id: str = "doc_id"):
    """Rows whose labels may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def labelled_examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text of the examples: at most EXAMPLES rows, of EXAMPLE_BYTES of text together; of these rows,
    in the order of the hash of their ids, each that still fits is taken.

    Of rows that repeat a doc_id, the greatest text counts; a label repeated counts as toxic if one is.
    """
    known = labels.where(learnable() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES), "labelled")
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    found = materialize(docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "found")
    # ids and lengths of at most EXAMPLES rows; a text that does not fit leaves room for those after it
    sizes = found.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("at")).toPandas().sort_values(["at", "doc_id"])
    left, chosen = EXAMPLE_BYTES, []
    for doc_id, size in zip(sizes["doc_id"], sizes["size"], strict=True):
        if size <= left:
            left -= size
            chosen.append((int(doc_id),))
    fitting = docs.sparkSession.createDataFrame(chosen, "doc_id long")
    return found.join(F.broadcast(fitting), "doc_id", "left_semi")


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, similarities, and carried columns, for every row of docs.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored.  Labels are learnt from the ids that
    `learnable` allows, see labelled_examples.  Documents without a term - null and empty ones too - score as the
    examples without one do, and where there are none as the share of toxic examples.  Very long texts are scored
    whole, in slices.  Repeated rows score alike.  Without labels, every score is 0.  A null doc_id is not held out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    train = materialize(labelled_examples(docs, labels).repartition(16), "examples")
    held = train.select("text", F.col("toxic").cast("long")).mapInArrow(_associations, "term long, pos long, neg long").groupBy("term").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
    # bounded by the bytes of the examples
    terms = held.where(F.col("n") >= LEAST_EXAMPLES).select("term").toArrow().column(0).to_numpy()
    vocabulary = Vocabulary(terms.astype(np.int64).view(np.uint64))
    words = spark.sparkContext.broadcast(vocabulary)
    table, total = sum_tables(docs.select(text), _frequencies(words), len(vocabulary))
    idf = np.log((total + 1.0) / (table + 1.0)) + 1e-6

    rows = train.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(_vectorise(words), "doc_id long, toxic int, terms binary, counts binary")
    examples = [(r.doc_id, np.frombuffer(bytes(r.terms), "<i4"), np.frombuffer(bytes(r.counts), "<u2"), int(r.toxic)) for r in rows.collect()]  # bounded likewise
    shared = spark.sparkContext.broadcast(Examples(sorted(examples, key=lambda x: x[0]), idf))
    del examples
    found = spark.range(0, FOLDS * FOLD_PARTS, 1, FOLDS * FOLD_PARTS).mapInArrow(_fold_votes(shared), "vote double, label double").toArrow()
    steps = calibrated(found.column(0).to_numpy(), found.column(1).to_numpy())

    extra = [F.col(c) for c in carry]
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    scored = docs.select(text, F.col("doc_id").cast("long").alias("doc_id"), *extra).mapInArrow(_scorer(words, shared, steps), f"doc_id long{kinds}, score double, neighbours array<long>, similarities array<double>")
    return scored.select(
        "doc_id",
        (~F.coalesce(learnable(), F.lit(True))).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "neighbours",
        "similarities",
        *carry,
    )


@in_small_batches
def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    scored = score_toxicity(docs.withColumn("__key", row_key(docs)), labels, ("__key",))
    return without(docs, materialize(scored.where("predicted = 1").select("__key").distinct(), "toxic"))
