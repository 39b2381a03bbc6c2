"""Mixing sources to target weights.

A classifier trained on a bounded sample of documents with a source predicts a posterior over the
sources from the text of every document; a document is always predicted by a model that was not
trained on it. A distributed projected gradient then fits rates between 0 and the repeats allowed, by
least squares on two sets of totals: the expected tokens per source by the text's posterior, and the
tokens per recorded source, both at the targets. Where the texts of two sources differ little (the
held-out accuracy tells), the second set is what makes the shares hold. Rates are rounded to whole
repeats by carrying the error along, so each document keeps the whole part of its rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import VOCABULARY, with_token_counts
from folioscope.session import materialize, spread

FEATURES = 1 << 12


def featured_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, features): sizes in tokens and hashed words of the whole texts."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    hashed = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))))
    base = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", "text", hashed.alias("features"))
    return with_token_counts(base, "text", path)


def labelled_sample(docs: DataFrame, names: list[str], per_source: int = 2000) -> list:
    """Rows (source, features, fold, weight) of about ``per_source`` documents of each source, chosen by hash.

    The sample is bounded by that parameter, whatever the corpus; the fold (0 or 1) is the hash's parity.
    """
    sizes = {r["source"]: r["count"] for r in docs.where(F.col("source").isin(names)).groupBy("source").count().collect()}
    if not sizes:
        return []
    share = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(min(1.0, per_source / n)))])
    h = F.xxhash64("doc_id")
    near = docs.where(F.col("source").isin(*sizes)).where((F.pmod(F.shiftrightunsigned(h, 8), F.lit(1 << 20)) / float(1 << 20)) <= share[F.col("source")])
    return near.select("source", "features", _fold().alias("fold"), (1 / share[F.col("source")]).alias("weight")).collect()


def _fold():
    return F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(2)).cast("int")


def _scores(weights: np.ndarray, features: list) -> np.ndarray:
    """Softmax over the sources of each list of hashed words."""
    size = np.array([len(f) for f in features])
    flat = np.concatenate([np.append(np.asarray(f, np.int64), FEATURES) for f in features]) if len(features) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
    score = np.add.reduceat(weights[flat], begin, axis=0) / np.sqrt(size + 1)[:, None] if len(features) else np.zeros((0, weights.shape[1]))
    p = np.exp(score - score.max(axis=1, keepdims=True)) if len(features) else score
    return p / p.sum(axis=1, keepdims=True) if len(features) else p


def train_classifier(rows: list, names: list[str], epochs: int = 80, rate: float = 0.5, momentum: float = 0.9, decay: float = 1e-3) -> np.ndarray:
    """Softmax weights (FEATURES + 1, sources); sources count by their rows, so that posteriors keep their shares."""
    k = len(names)
    w = np.zeros((FEATURES + 1, k))
    if not rows:
        return w
    y = np.array([names.index(r["source"]) for r in rows])
    flat = np.concatenate([np.asarray([*r["features"], FEATURES]) for r in rows])
    length = np.array([len(r["features"]) + 1 for r in rows])
    row = np.repeat(np.arange(len(rows)), length)
    value = np.repeat(1.0 / np.sqrt(length), length)
    # A bounded sample holds small sources whole and large ones in part: rows weigh what they stand for.
    onehot = np.eye(k)[y] * np.array([r["weight"] for r in rows])[:, None]
    onehot *= len(rows) / onehot.sum()
    scale = onehot.sum(axis=1, keepdims=True)
    speed = np.zeros_like(w)
    for _ in range(epochs):
        score = np.column_stack([np.bincount(row, weights=w[flat, j] * value, minlength=len(rows)) for j in range(k)])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = onehot - p * scale
        for j in range(k):
            speed[:, j] = momentum * speed[:, j] + rate * np.bincount(flat, weights=error[row, j] * value, minlength=FEATURES + 1) / np.sqrt(len(rows))
        w += speed
        w[:FEATURES] *= 1 - decay
    return w


def cross_fitted(docs: DataFrame, names: list[str], per_source: int = 2000) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights for fold 0, weights for fold 1, held-out accuracy): each model is trained on the other fold's sample."""
    rows = labelled_sample(docs, names, per_source)
    models = [train_classifier([r for r in rows if r["fold"] != fold], names) for fold in (0, 1)]
    right = sum(int((_scores(models[f], [r["features"] for r in rows if r["fold"] == f]).argmax(axis=1) == [names.index(r["source"]) for r in rows if r["fold"] == f]).sum()) for f in (0, 1) if any(r["fold"] == f for r in rows))
    return models[0], models[1], right / max(len(rows), 1)


def with_posteriors(docs: DataFrame, names: list[str], caps: np.ndarray, models: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, source, n_tokens, domain, cap, post): the posterior over ``names`` from the text.

    ``domain`` is the number of the recorded source, of the likeliest one where none is recorded, -1
    where the source has no target; ``cap`` the repeats allowed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {s: i for i, s in enumerate(names)}
        for batch in batches:
            post = np.zeros((len(batch), len(names)))
            for fold in (0, 1):
                own = np.flatnonzero(batch["fold"].to_numpy() == fold)
                if len(own):
                    post[own] = _scores(shared.value[fold], [batch["features"].iloc[i] for i in own])
            likely = post.argmax(axis=1)
            domain = np.array([at.get(s, -1) if s is not None else int(i) for s, i in zip(batch["source"], likely)], np.int32)
            cap = np.where(domain >= 0, caps[domain], 0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": batch["n_tokens"], "domain": domain, "cap": cap, "post": post.tolist()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "n_tokens", "features", _fold().alias("fold")).mapInPandas(run, f"doc_id {kind}, source string, n_tokens bigint, domain int, cap double, post array<double>")


class Rates:
    """The rates as a function of a document: a start per source, then the steps of the gradient, each projected to [0, cap]."""

    def __init__(self, start: np.ndarray):
        self.start, self.steps = start, []

    def __call__(self, domain: np.ndarray, cap: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, memberships): a membership has the text's posterior, then the recorded source."""
        k = len(self.start)
        member = np.concatenate([post, np.eye(k)[domain]], axis=1)
        rate = cap * self.start[domain]
        for step in self.steps:
            rate = np.clip(rate - cap * (member @ step), 0.0, cap)
        return rate, member


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    post = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float), post


def _pass(docs: DataFrame, rates: Rates) -> tuple[np.ndarray, np.ndarray]:
    """Tokens drawn per membership, and how they answer to a step: sums over all documents, one row per task."""
    k = len(rates.start)
    shared = docs.sparkSession.sparkContext.broadcast(rates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, answer = np.zeros(2 * k), np.zeros((2 * k, 2 * k))
        for batch in batches:
            domain, cap, tokens, post = _columns(batch, k)
            rate, member = shared.value(domain, cap, post)
            totals += (rate * tokens) @ member
            free = np.where((rate > 0) & (rate < cap), cap * tokens, 0.0)
            answer += member.T @ (member * free[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([totals, answer.ravel()]).tolist()], pa.list_(pa.float64()))], names=["x"])

    rows = docs.select("domain", "cap", "n_tokens", "post").mapInArrow(run, "x array<double>").collect()
    x = np.sum([r["x"] for r in rows], axis=0) if rows else np.zeros(2 * k + 4 * k * k)
    return x[: 2 * k], x[2 * k :].reshape(2 * k, 2 * k)


def fit_rates(docs: DataFrame, shares: np.ndarray, rounds: int = 40, tolerance: float = 1e-4, step: float = 0.5, firm: float = 100.0) -> tuple[Rates, dict]:
    """The fitted rates, and a report (total, rounds, converged, text_gap, source_gap).

    The total is the largest that every source can fill within its repeats. Projected gradient on the
    squared gaps of both sets of totals (those of the recorded sources weigh ``firm`` times), preconditioned
    by how the totals answer, until the squared gaps fall by less than 1 % in a round; then steps on
    the recorded sources alone until their gap is below ``tolerance``. A round is one pass that brings a few
    sums to the driver; a document's rate is folded from the steps so far, so nothing per document is
    stored or shuffled between rounds. Gaps are shares of the total.
    """
    k = len(shares)
    most = _pass(docs, Rates(np.ones(k)))[0][k:]
    total = float(min((most[i] / shares[i] for i in range(k) if shares[i] > 0), default=0.0))
    target = np.concatenate([shares, shares]) * total
    rates = Rates(np.divide(target[k:], most, out=np.zeros(k), where=most > 0))
    report = {"total": total, "rounds": 0, "converged": total <= 0, "text_gap": 0.0, "source_gap": 0.0}
    # The two sets have the same sum, so the answer is singular: the shortest step of the weighted least squares.
    weigh = np.concatenate([np.ones(k), np.full(k, np.sqrt(firm))])
    before, settled = np.inf, rounds == 0
    while total > 0:
        drawn, answer = _pass(docs, rates)
        gap = drawn - target
        report |= {"text_gap": float(np.abs(gap[:k]).max() / total), "source_gap": float(np.abs(gap[k:]).max() / total)}
        size = np.square(gap * weigh).sum() / total**2
        settled = settled or size > 0.99 * before
        report["converged"] = settled and report["source_gap"] <= tolerance
        if report["converged"] or report["rounds"] >= rounds:
            return rates, report
        if settled:
            move = np.concatenate([np.zeros(k), np.divide(gap[k:], np.diag(answer)[k:], out=np.zeros(k), where=np.diag(answer)[k:] > 0)])
        else:
            move, before = step * np.linalg.lstsq(answer * weigh[:, None], gap * weigh, rcond=1e-4)[0], size
        rates.steps.append(move)
        report["rounds"] += 1
    return rates, report


def _prepared(documents: DataFrame, targets: DataFrame, path: str) -> tuple[DataFrame, list[str], np.ndarray, float]:
    rows = targets.where("source_name IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source_name").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source_name").collect()
    names = [r["source_name"] for r in rows]
    shares = np.array([r["share"] for r in rows], float)
    shares = shares / shares.sum() if len(rows) else shares
    caps = np.array([r["cap"] for r in rows], float)
    docs = materialize(featured_documents(documents, path))
    *models, accuracy = cross_fitted(docs, names)
    posted = with_posteriors(docs, names, caps, tuple(models)) if names else with_posteriors(docs.limit(0), ["-"], np.ones(1), (np.zeros((FEATURES + 1, 1)),) * 2)
    return materialize(posted.where("n_tokens > 0 AND domain >= 0")), names, shares, accuracy


def mixture(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, rounds: int = 40) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the documents drawn, 1 to ``max_repeats`` times each.

    Targets are a short closed list; repeated names count once (largest share), shares are scaled to
    sum to one, a source without a positive share is not drawn. Blank texts have no tokens and are not drawn.
    ``source`` is the source a document counts for: the recorded one, else the likeliest. If a source has no
    tokens at all nothing can be mixed and the result is empty.
    """
    docs, names, shares, _ = _prepared(documents, targets, path)
    if not names:
        return docs.select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats")).limit(0)
    return _rounded(docs, fit_rates(docs, shares, rounds)[0], names)


def fit_report(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(accuracy, total, rounds, converged, text_gap, source_gap): one row on how the fit went; gaps are shares of all tokens."""
    docs, names, shares, accuracy = _prepared(documents, targets, path)
    report = fit_rates(docs, shares)[1] if names else {"total": 0.0, "rounds": 0, "converged": False, "text_gap": 0.0, "source_gap": 0.0}
    row = (float(accuracy), *(report[x] for x in ("total", "rounds", "converged", "text_gap", "source_gap")))
    return documents.sparkSession.createDataFrame([row], "accuracy double, total double, rounds int, converged boolean, text_gap double, source_gap double")


def _rounded(docs: DataFrame, rates: Rates, names: list[str], group: int = 5000) -> DataFrame:
    """Whole repeats: the floor of each rate or one more, the error in tokens carried to the next document.

    Documents of a source are dealt by hash to groups of about ``group``, each rounded on its own, the
    longest first, so a group's tokens miss its rates' by less than half its shortest documents.
    """
    k = len(names)
    sizes = {r["domain"]: r["count"] for r in docs.groupBy("domain").count().collect()}
    groups = F.create_map(*[x for d, n in (sizes or {0: 1}).items() for x in (F.lit(d), F.lit(max(1, n // group)))])
    dealt = docs.withColumn("h", F.xxhash64("doc_id", "n_tokens")).withColumn("group", F.pmod("h", groups[F.col("domain")]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(rates)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["n_tokens", "h"], ascending=[False, True], kind="stable")
        post = np.vstack(batch["post"].to_numpy()).reshape(-1, k)
        rate, _ = shared.value(batch["domain"].to_numpy(), batch["cap"].to_numpy(), post)
        carried, repeats = 0.0, []
        for r, n, c in zip(rate.tolist(), batch["n_tokens"].tolist(), batch["cap"].tolist()):
            low = int(r + 1e-9)
            carried += r * n
            take = min(max(round(carried / n), low), min(low + 1, int(c)))
            carried -= take * n
            repeats.append(take)
        out = batch[["doc_id", "n_tokens"]].assign(source=[names[d] for d in batch["domain"]], repeats=repeats)
        return out[out["repeats"] > 0][["doc_id", "source", "n_tokens", "repeats"]]

    return dealt.select("doc_id", "n_tokens", "domain", "cap", "post", "h", "group").groupBy("domain", "group").applyInPandas(run, f"doc_id {kind}, source string, n_tokens bigint, repeats int")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, documents, tokens) per target, 0 where nothing was drawn."""
    tokens = F.sum(F.col("n_tokens") * F.col("repeats"))
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), tokens.alias("tokens"))
    all_ = per.agg(F.sum("tokens").alias("all"))
    wanted = targets.where("source_name IS NOT NULL").groupBy(F.col("source_name").alias("source")).agg(F.max("target_share").alias("target_share"))
    total = all_.first()["all"] or 0
    return wanted.join(per, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("reached_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
