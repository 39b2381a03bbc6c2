"""Subject areas of documents.

Hand labels spread by label propagation over the graph of documents that share verified terms. The
similarity of two documents is the sum, over the verified terms their sentences share, of how far the
term's subject mix departs from the corpus; a term links documents only if that departure is beyond
chance (a likelihood-ratio test) and its documents are reached by the labels. The graph is kept in its
factored form, documents and terms: a step from document to document runs over their terms, so no pair
of documents is ever made and a term in a third of all documents costs no more than its occurrences.
Trusted seeds are clamped in every round and in the result; each document keeps a share for every
subject its sentences speak of. The rounds end when hardly any document changes its likeliest
subject. Sentence patterns whose subject is that of the rest of their document no more often than
by chance are passing mentions and don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize, small_enough, spread

#: A sentence is taken to be of the best subject from this sum of log odds and this lead over the next one.
LEAST, MARGIN = 2.5, 0.7
#: A hand label is trusted if this share of its document's subject-bearing sentences bears it out.
BORNE_OUT = 0.12
_CHUNK = 500_000


def _hashed(words: pa.Array) -> np.ndarray:
    """64-bit ids of words; only distinct ones are hashed."""
    import xxhash

    coded = words.dictionary_encode()
    ids = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64).view(np.int64)
    return ids[coded.indices.to_numpy()] if len(ids) else np.zeros(0, np.int64)


def _pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.view(np.uint64) ^ (b.view(np.uint64) >> np.uint64(29)))
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def document_words(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, doc_id, words, lens, given): the word ids of the whole texts in order, the number of words per sentence,
    and the numbers of the hand labels.

    A word is two letters or more, in small letters. NULL and blank texts have no row. ``labels``: (doc_id, given).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.replace_substring_regex(pc.utf8_lower(batch.column(2).cast(pa.string())), r"([.?!…:;])\s+", "\\1\n")
            parts = pc.split_pattern_regex(text, r"\n+")
            words = pc.split_pattern_regex(parts.flatten(), r"[^\pL-]+")
            flat = words.flatten()
            keep = pc.greater_equal(pc.utf8_length(flat), 2)
            sentence = pc.list_parent_indices(words).filter(keep).to_numpy()
            lens = np.bincount(sentence, minlength=len(words))
            doc = pc.list_parent_indices(parts).to_numpy()
            full = lens > 0
            per_doc = np.bincount(doc[full], minlength=len(batch))
            words_per_doc = np.bincount(doc, weights=lens, minlength=len(batch)).astype(np.int64)
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets(words_per_doc), pa.array(_hashed(flat.filter(keep)))), pa.ListArray.from_arrays(offsets(per_doc), pa.array(lens[full].astype(np.int32)))],
                names=["row_id", "doc_id", "words", "lens"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    worded = documents.where(F.col("text").rlike(r"\p{L}")).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    split = worded.mapInArrow(run, f"row_id bigint, doc_id {kind}, words array<bigint>, lens array<int>").where(F.size("lens") > 0)
    return split.join(labels, "doc_id", "left")


class _Docs:
    """Some documents as flat arrays: terms (words, then pairs of adjoining words) with their sentence and document."""

    def __init__(self, words: pa.ListArray, lens: pa.ListArray, given: pa.ListArray, k: int):
        self.n, self.k = len(words), k
        w, self.lens = words.flatten().to_numpy(), lens.flatten().to_numpy()
        self.doc_of_sent = pc.list_parent_indices(lens).to_numpy()
        sent = np.repeat(np.arange(len(self.lens)), self.lens)
        inside = sent[1:] == sent[:-1]
        self.words = len(w)
        self.terms = np.concatenate([w, _pair_ids(w[:-1][inside], w[1:][inside])])
        # Each distinct term is looked at once; hashing is several times as fast as sorting here.
        self.code, self.distinct = pd.factorize(self.terms)
        self.sent = np.concatenate([sent, sent[:-1][inside]])
        self.given = np.zeros((self.n, k))
        listed = pc.list_parent_indices(given).to_numpy()
        if len(listed):
            self.given[listed, given.flatten().to_numpy()] = 1.0

    def said(self, weights: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(subject of each sentence, -1 for none; which terms are verified)."""
        if weights is None or not len(weights[0]):
            return np.full(len(self.lens), -1), np.zeros(len(self.terms), bool)
        known, w = weights
        at = np.minimum(np.searchsorted(known, self.distinct), len(known) - 1)
        hit = (known[at] == self.distinct)[self.code] if len(self.distinct) else np.zeros(0, bool)
        once = pd.unique(self.sent[hit] * np.int64(len(known)) + at[self.code[hit]])
        sent, term = once // len(known), once % len(known)
        score = np.column_stack([np.bincount(sent, weights=w[term, i], minlength=len(self.lens)) for i in range(self.k)])
        return _best(score), hit

    def counts(self, subject: np.ndarray) -> np.ndarray:
        """(documents, subjects): sentences on each subject."""
        has = subject >= 0
        return np.bincount(self.doc_of_sent[has] * self.k + subject[has], minlength=self.n * self.k).reshape(self.n, self.k).astype(float)

    def posteriors(self, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors, whether a trusted seed): shares of the sentences, clamped to the labels for trusted seeds."""
        given = self.given
        if counts is not None:
            given = given * (counts >= BORNE_OUT * counts.sum(axis=1, keepdims=True)) * (counts > 0)
        seed = given.sum(axis=1) > 0
        post = np.where(seed[:, None], given, 0.0 if counts is None else counts)
        return post / np.maximum(post.sum(axis=1, keepdims=True), 1e-12), seed

    def patterns(self, hit: np.ndarray) -> np.ndarray:
        """What each sentence says beside verified words: the sum of its other distinct words' ids."""
        rest = np.flatnonzero(~hit[: self.words])
        many = np.int64(max(len(self.distinct), 1))
        pair = pd.unique(self.sent[rest] * many + self.code[rest])
        out = np.zeros(len(self.lens), np.int64)
        with np.errstate(over="ignore"):
            np.add.at(out, pair // many, self.distinct[pair % many])
        return out


def _best(score: np.ndarray) -> np.ndarray:
    top = score.argmax(axis=1)
    best = score[np.arange(len(score)), top]
    score[np.arange(len(score)), top] = -np.inf
    lead = best - score.max(axis=1) if score.shape[1] > 1 else np.full(len(score), np.inf)
    return np.where((best >= LEAST) & (lead >= MARGIN), top, -1)


def _chunks(batch: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of documents that hold about _CHUNK words, so memory does not hang on the documents' lengths."""
    size = np.cumsum(pc.list_value_length(batch.column(first)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + _CHUNK, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _small_weights(weights: DataFrame | None, k: int):
    """(ids in order, log odds) if the table is proven small; None else."""
    if weights is None:
        return np.zeros(0, np.int64), np.zeros((0, k))
    if not small_enough(weights):
        return None
    rows = weights.toPandas()
    order = np.argsort(rows["term"].to_numpy())
    return rows["term"].to_numpy()[order], (np.vstack(rows["w"].to_numpy()) if len(rows) else np.zeros((0, k)))[order]


def sentence_subjects(docs: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(row_id, doc_id, sent, subject, pattern): the subject of each sentence that has one, and its pattern.

    The weights (materialized) go to the workers only if proven small; else the sentences' terms are joined with them.
    """
    small = _small_weights(weights, k)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if small is not None:
        shared = docs.sparkSession.sparkContext.broadcast(small)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _chunks(batch, 2):
                    own = _Docs(part.column(2), part.column(3), part.column(4), k)
                    subject, hit = own.said(shared.value)
                    has = np.flatnonzero(subject >= 0)
                    doc = pa.array(own.doc_of_sent[has])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(has.astype(np.int32)), pa.array(subject[has].astype(np.int32)), pa.array(own.patterns(hit)[has])], names=["row_id", "doc_id", "sent", "subject", "pattern"])

        return docs.select("row_id", "doc_id", "words", "lens", "given").mapInArrow(run, f"row_id bigint, doc_id {kind}, sent int, subject int, pattern bigint")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 2):
                own = _Docs(part.column(2), part.column(3), part.column(4), k)
                doc = pa.array(own.doc_of_sent[own.sent])
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(own.sent.astype(np.int32)), pa.array(own.terms), pa.array(np.arange(len(own.terms)) < own.words)], names=["row_id", "doc_id", "sent", "term", "word"])

    each = docs.select("row_id", "doc_id", "words", "lens", "given").mapInArrow(terms, f"row_id bigint, doc_id {kind}, sent int, term bigint, word boolean").distinct()
    sums = [F.sum(F.coalesce(F.col("w")[i], F.lit(0.0))).alias(f"s{i}") for i in range(k)]
    pattern = F.sum(F.when(F.col("w").isNull() & F.col("word"), F.col("term").cast("decimal(38,0)"))).alias("pattern")
    scored = each.join(weights, "term", "left").groupBy("row_id", "doc_id", "sent").agg(*sums, pattern)
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"s{i}").alias("score"), (-F.lit(i)).alias("minus")) for i in range(k)])))
    top = scored.select("row_id", "doc_id", "sent", "pattern", ranked.alias("r"))
    lead = F.col("r")[0]["score"] - F.col("r")[1]["score"] >= MARGIN if k > 1 else F.lit(True)
    pattern = F.pmod(F.coalesce("pattern", F.lit(0)), F.lit("9223372036854775808").cast("decimal(38,0)")).cast("bigint")
    return top.where((F.col("r")[0]["score"] >= LEAST) & lead).select("row_id", "doc_id", "sent", (-F.col("r")[0]["minus"]).cast("int").alias("subject"), pattern.alias("pattern"))


def _with_counts(docs: DataFrame, weights: DataFrame | None, k: int, name: str) -> DataFrame:
    """``docs`` with the sentences per subject of each in the column ``name``, for weights too large to broadcast."""
    none = F.array_repeat(F.lit(0.0), k)
    if weights is None:
        return docs.withColumn(name, none)
    per = sentence_subjects(docs, weights, k).groupBy("row_id").agg(F.array(*[F.sum((F.col("subject") == i).cast("double")) for i in range(k)]).alias(name))
    return docs.join(per, "row_id", "left").withColumn(name, F.coalesce(name, none))


def term_sums(docs: DataFrame, weights: DataFrame | None, k: int, before: DataFrame | None = None) -> DataFrame:
    """(term, n, seeds, s, changed): per term the documents that hold it, the trusted seeds among them, and the sums of their posteriors.

    The row without a term has the whole corpus; its ``changed`` counts the documents whose likeliest subject
    is not the one ``before`` gave. Every document counts once per term; sums are combined before the shuffle.
    """
    small, old = _small_weights(weights, k), _small_weights(before, k)
    by_counts, learned, compared = small is None or old is None, weights is not None, before is not None
    if by_counts:
        docs = _with_counts(_with_counts(docs, weights, k, "counts"), before, k, "was")
    shared = docs.sparkSession.sparkContext.broadcast((small, old))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, moved, documents, seeds = np.zeros(k), 0, 0, 0
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64()]
        names = ["term", "n", "seeds", "s", "changed"]
        for batch in batches:
            for part in _chunks(batch, 0):
                own = _Docs(part.column(0), part.column(1), part.column(2), k)
                if by_counts:
                    counts, was = (part.column(c).flatten().to_numpy().reshape(-1, k) for c in (3, 4))
                else:
                    now, prior = shared.value
                    counts, was = own.counts(own.said(now)[0]), own.counts(own.said(prior)[0])
                post, seed = own.posteriors(counts if learned else None)
                if compared:
                    moved += int((was.argmax(axis=1) != counts.argmax(axis=1)).sum())
                    # The mean of two rounds: without it, documents between two subjects swing for ever.
                    post = (post + own.posteriors(was)[0]) / 2
                distinct = own.distinct
                pair = pd.unique(own.doc_of_sent[own.sent] * np.int64(len(distinct)) + own.code)
                doc, term = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
                n = np.bincount(term, minlength=len(distinct))
                held = np.bincount(term, weights=seed[doc], minlength=len(distinct)).astype(np.int64)
                sums = np.column_stack([np.bincount(term, weights=post[doc, i], minlength=len(distinct)) for i in range(k)])
                whole, documents, seeds = whole + post.sum(axis=0), documents + own.n, seeds + int(seed.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(distinct) * k + 1, k, dtype=np.int32)), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n.astype(np.int64)), pa.array(held), lists, pa.array(np.zeros(len(distinct), np.int64))], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, documents, seeds, whole.tolist(), moved), types)], names=names)

    columns = ["words", "lens", "given", *(["counts", "was"] if by_counts else [])]
    partial = docs.select(*columns).mapInArrow(run, "term bigint, n bigint, seeds bigint, s array<double>, changed bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"), F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s"), F.sum("changed").alias("changed"))


def term_weights(sums: DataFrame, k: int, least_gain: float = 4.0, least_reach: float = 0.2) -> tuple[DataFrame, int, int]:
    """((term, w): log odds per subject of the verified terms; documents; documents that changed).

    The gain is the information of the term's subject mix against the corpus' (half a likelihood-ratio
    statistic), so a threshold on it is a significance test. A term seen in one document links none. A term
    that labelled documents hold much less often than documents at large (under ``least_reach`` of their
    rate) belongs to texts outside the closed list; where that is beyond chance it speaks against all subjects.
    A term whose documents have a posterior much less often than documents at large links none either: it
    would carry subjects into texts that have none.
    """
    overall = sums.where("term IS NULL").first()
    documents, seeds, s = (overall["n"], overall["seeds"], overall["s"]) if overall else (0, 0, [0.0] * k)
    rate = seeds / max(documents, 1)
    total = sum(s) + k
    base = [(x + 1.0) / total for x in s]
    mass = sum((F.col("s")[i] for i in range(k)), F.lit(0.0))
    share = [(F.col("s")[i] + base[i]) / (mass + 1.0) for i in range(k)]
    gain = sum((F.col("s")[i] * F.log(share[i] / base[i]) for i in range(k)), F.lit(0.0))
    reached = F.col("seeds") >= F.greatest(F.lit(1.0), least_reach * rate * F.col("n"))
    reached = reached & (mass >= 0.5 * sum(s) / max(documents, 1) * F.col("n"))
    verified = (gain >= least_gain) & (F.greatest(*share) if k > 1 else share[0]).__ge__(0.5) & reached
    expected = rate * F.col("n")
    outside = (expected >= 6.0) & (F.col("seeds") < least_reach * expected)
    w = F.when(outside, F.array(*[F.lit(-1.5)] * k)).otherwise(F.array(*[F.log(x / b) for x, b in zip(share, base)]))
    return sums.where("term IS NOT NULL AND n > 1").where(verified | outside).select("term", w.alias("w")), documents, overall["changed"] if overall else 0


def document_shares(said: DataFrame) -> DataFrame:
    """(doc_id, subject, n, total): how many of a document's subject-bearing sentences speak of each."""
    per = said.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("doc_id").agg(F.sum("n").alias("total"))
    return per.join(total, "doc_id")


def passing_patterns(said: DataFrame, shares: DataFrame, least_seen: int = 4, agreement: float = 0.35) -> DataFrame:
    """(pattern): the sentence patterns whose subject seldom is that of the rest of their document."""
    rest = said.join(shares, ["doc_id", "subject"]).where("total >= 3")
    agrees = ((F.col("n") - 1) / (F.col("total") - 1)).alias("agrees")
    return rest.select("pattern", agrees).groupBy("pattern").agg(F.count(F.lit(1)).alias("seen"), F.avg("agrees").alias("agreed")).where((F.col("seen") >= least_seen) & (F.col("agreed") < agreement)).select("pattern")


class Propagation:
    """The outcome of :func:`propagate`: ``said`` (materialized), the subjects' ``names`` in order, the word rows, ``rounds``, ``changed`` share, ``converged``."""

    def __init__(self, docs: DataFrame, names: list[str]):
        self.docs, self.names = docs, names
        self.rounds, self.changed, self.converged = 0, 1.0, False
        self.said: DataFrame = None


def propagate(documents: DataFrame, areas: DataFrame, labels: DataFrame, most_rounds: int = 10, tolerance: float = 0.002) -> Propagation:
    """Label propagation until at most ``tolerance`` of the documents change their likeliest subject in a round.

    A round runs from the documents' posteriors (trusted seeds clamped) to the terms and back to the
    documents' sentences, in one pass over the word ids and one shuffle of distinct terms. ``areas`` is the
    closed list of subjects (a few rows); an empty list or no labels give no subjects.
    """
    names = sorted(r["subject"] for r in areas.where("subject IS NOT NULL").select("subject").distinct().collect())
    k = max(len(names), 1)
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else None
    numbered = labels.where(F.col("subject").isin(names)).select("doc_id", (number[F.col("subject")] if names else F.lit(0)).alias("i")) if names else labels.select("doc_id", F.lit(0).alias("i")).limit(0)
    given = numbered.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("i").alias("given"))
    docs = materialize(document_words(spread(documents.select("doc_id", "text")), given))
    out = Propagation(docs, names)
    weights, before = None, None
    while True:
        sums = materialize(term_sums(docs, weights, k, before))
        new, count, moved = term_weights(sums, k)
        before, weights = weights, materialize(new)
        out.rounds += 1
        if before is not None and out.rounds > 2:
            out.changed = moved / max(count, 1)
            out.converged = out.changed <= tolerance
        if out.converged or out.rounds >= most_rounds:
            break
    out.said = materialize(sentence_subjects(docs, weights, k))
    return out


def document_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame, least_share: float = 0.15, most_rounds: int = 10) -> DataFrame:
    """(doc_id, subject, sentences, share): what each document's statements are about.

    Sentences on a passing pattern don't count; a subject needs ``least_share`` of the others. Trusted hand
    labels stay in the result whatever the sentences say. Repeated document ids are taken together. A
    hand-labelled document whose sentences speak of no subject keeps its labels, with 0 sentences and equal
    shares; one without words has none.
    """
    done = propagate(documents, areas, labels, most_rounds)
    passing = passing_patterns(done.said, document_shares(done.said))
    meant = materialize(document_shares(done.said.join(passing, "pattern", "left_anti")))
    name = F.element_at(F.array(*[F.lit(n) for n in done.names or [""]]), F.col("subject") + 1)
    kept = meant.where(F.col("n") >= least_share * F.col("total"))
    given = done.docs.where("doc_id IS NOT NULL").select("doc_id", F.explode("given").alias("subject")).distinct()
    # Clamped: labels that the document's own sentences bear out.
    clamped = given.join(meant.where(F.col("n") >= BORNE_OUT * F.col("total")), ["doc_id", "subject"])
    found = kept.unionByName(clamped).groupBy("doc_id", "subject").agg(F.max("n").alias("sentences"), F.max(F.col("n") / F.col("total")).alias("share"))
    silent = given.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    alone = silent.join(silent.groupBy("doc_id").agg(F.count(F.lit(1)).alias("all")), "doc_id").select("doc_id", "subject", F.lit(0).cast("bigint").alias("sentences"), (1 / F.col("all")).alias("share"))
    return found.unionByName(alone).select("doc_id", name.alias("subject"), "sentences", "share")


def propagation_report(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(rounds, changed, converged): how the propagation ended; ``changed`` is a share of the documents."""
    done = propagate(documents, areas, labels)
    return documents.sparkSession.createDataFrame([(done.rounds, float(done.changed), bool(done.converged))], "rounds int, changed double, converged boolean")


def corpus_make_up(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """Per subject (and NULL for documents with none): documents, and characters by the documents' shares."""
    found = document_subjects(documents, areas, labels)
    base = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    total = found.groupBy("doc_id").agg(F.sum("share").alias("all"))
    part = F.coalesce(F.col("share") / F.col("all"), F.lit(1.0))
    return (
        base.join(found, "doc_id", "left")
        .join(total, "doc_id", "left")
        .groupBy("subject")
        .agg(F.count_distinct("doc_id").alias("documents"), F.sum(F.col("chars") * part).alias("chars"))
    )
