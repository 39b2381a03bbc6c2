"""Filling fixed-capacity containers with whole documents.

Documents are dealt to shards by content: a tree of two-way splits, fitted on a bounded sample, sends
texts that share telling terms to the same shard. Each shard holds a BM25 inverted index over hashed
terms with corpus-wide document frequencies. The longest unused document seeds a container, its
nearest unused neighbours that still fit are packed behind it, and the room then left is filled with
the largest unused documents that fit. Containers a shard could not fill are opened again and their
contents packed across shards.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import VOCABULARY, encoder
from folioscope.session import materialize, spread

#: Terms are hashed to so many buckets; the table of document frequencies has that size for any corpus.
BUCKETS = 1 << 15
K1, B = 1.2, 0.75
#: Width of the random projection of term weights that the shards' tree splits.
WIDTH = 256
_WORD = re.compile(r"[^\W_]{3,}")


def _terms(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms and how often each occurs."""
    import xxhash

    codes = np.fromiter((xxhash.xxh64_intdigest(w) % BUCKETS for w in words), np.int32, len(words))
    return np.unique(codes, return_counts=True)


def capacities(sizes: DataFrame) -> list[tuple[str, int]]:
    """(profile, capacity) in order of profile: a short closed list. A profile without a positive capacity holds nothing."""
    rows = sizes.where("capacity_tokens > 0").groupBy("profile").agg(F.max("capacity_tokens").cast("bigint").alias("capacity")).collect()
    return sorted(((r["profile"], r["capacity"]) for r in rows), key=lambda x: (x[0] is None, x[0] or ""))


def packed_items(documents: DataFrame, caps: list[tuple[str, int]], path: str = VOCABULARY) -> DataFrame:
    """(row_id, doc_id, n_tokens, part, start_token, terms, counts): the whole of each document (``part`` -1), and for each
    profile it is too large for, the rest behind its full pieces (``part``: the profile's number), with the terms of just that text.

    ``row_id`` is a row's own, so NULL and repeated document ids are rows like others. It is fixed
    only once the result is materialized.
    """
    every = [c for _, c in caps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                text = text or ""
                tokens = encode.encode_ordinary(text)
                rows.append((i, len(tokens), -1, 0, *_terms(_WORD.findall(text.lower()))))
                for k, c in enumerate(every):
                    start = len(tokens) // c * c
                    if start and start < len(tokens):
                        rows.append((i, len(tokens), k, start, *_terms(_WORD.findall(encode.decode(tokens[start:]).lower()))))
            at = pa.array([r[0] for r in rows], pa.int64())
            lists = lambda j: pa.array([r[j] for r in rows], pa.list_(pa.int32()))
            numbers = lambda j, t: pa.array([r[j] for r in rows], t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), numbers(1, pa.int64()), numbers(2, pa.int32()), numbers(3, pa.int64()), lists(4), lists(5)], names=["row_id", "doc_id", "n_tokens", "part", "start_token", "terms", "counts"])

    base = spread(documents.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return base.mapInArrow(run, "row_id bigint, doc_id bigint, n_tokens bigint, part int, start_token bigint, terms array<int>, counts array<int>")


def term_idf(items: DataFrame) -> tuple[np.ndarray, int]:
    """(BM25 weight of each hashed term over all documents, documents): BUCKETS numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            df[:BUCKETS] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=BUCKETS)
            df[BUCKETS] += len(batch)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used])], names=["t", "n"])

    df = np.zeros(BUCKETS + 1, np.int64)
    for r in items.where("part = -1").select("terms").mapInArrow(run, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect():
        df[r["t"]] = r["n"]
    n = int(df[BUCKETS])
    return np.log1p((n - df[:BUCKETS] + 0.5) / (df[:BUCKETS] + 0.5)).clip(min=0.0), n


def _vectors(terms: pa.ListArray, counts: pa.ListArray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors: a fixed random projection of the saturated term weights."""
    table = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, WIDTH))
    t, c = terms.flatten().to_numpy(), counts.flatten().to_numpy()
    size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    out = np.zeros((len(terms), WIDTH), np.float32)
    ends = np.cumsum(size)
    weight = (idf[t] * c * (K1 + 1) / (c + K1)).astype(np.float32)
    at = 0
    while at < len(terms):
        # So many documents at a time as hold some 50 000 terms (one at least): the rows of the table are WIDTH wide.
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + 50_000, side="right")))
        full = at + np.flatnonzero(size[at:to])
        if len(full):
            piece = slice(done, int(ends[to - 1]))
            out[full] = np.add.reduceat(table[t[piece]] * weight[piece, None], ends[full] - size[full] - done, axis=0)
        at = to
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class ShardTree:
    """Two-way splits of unit vectors: inner node i sends a vector to the nearer of its two centres."""

    def __init__(self, sample: np.ndarray, leaves: int, least: int = 30):
        """Splits the largest node until there are ``leaves`` or none has ``least`` sampled vectors to spare on each side."""
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 1
        rng = np.random.default_rng(11)
        open_ = [(len(sample), 0, np.arange(len(sample)), None)]
        while open_ and self.leaves < leaves:
            open_.sort(key=lambda x: (x[0], -x[1]))
            _, leaf, rows, place = open_.pop()
            side, centres = _halves(sample[rows], rng) if len(rows) >= 2 * least else (None, None)
            if side is None or min(side.sum(), (~side).sum()) < least:
                continue
            node = len(self.centres)
            self.centres.append(centres)
            # Leaves are kept as -1 - number.
            self.children.append([-1 - leaf, -1 - self.leaves])
            if place is not None:
                self.children[place[0]][place[1]] = node
            open_ += [(int(side.sum()), leaf, rows[side], (node, 0)), (int((~side).sum()), self.leaves, rows[~side], (node, 1))]
            self.leaves += 1

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            side = vectors[rows] @ self.centres[node].T
            near = side[:, 0] >= side[:, 1]
            for child, own in zip(self.children[node], (rows[near], rows[~near])):
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out


def _halves(vectors: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Spherical two-means, begun along the direction of largest spread."""
    spread_ = vectors - vectors.mean(axis=0)
    along = rng.normal(size=vectors.shape[1])
    for _ in range(20):
        along = spread_.T @ (spread_ @ along)
        along /= max(float(np.linalg.norm(along)), 1e-12)
    side = spread_ @ along >= 0
    for _ in range(10):
        if side.all() or not side.any():
            return None, None
        centres = np.stack([vectors[side].mean(axis=0), vectors[~side].mean(axis=0)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        score = vectors @ centres.T
        side = score[:, 0] >= score[:, 1]
    return side, centres


def with_shards(items: DataFrame, idf: np.ndarray, count: int, shard_items: int, sample: int = 20_000) -> DataFrame:
    """``items`` with ``shard``: the tree's leaf, and where a leaf is over twice the size (copies) a number by hash.

    The tree is fitted on about ``sample`` documents (chosen by hash, bounded by that parameter), so it has
    at most ``sample`` / 60 leaves; leaves of a larger corpus are dealt on by hash.
    """
    shared = items.sparkSession.sparkContext.broadcast(idf)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(0), batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=["v"])

    share = min(1.0, sample / max(count, 1))
    chosen = items.where("part = -1").where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = chosen.select("terms", "counts").mapInArrow(embed, "v array<float>").collect()
    tree = ShardTree(np.array([r["v"] for r in rows], np.float32).reshape(-1, WIDTH), max(1, round(count / shard_items)))
    planted = items.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = planted.value.leaf_of(_vectors(batch.column(5), batch.column(6), shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    dealt = materialize(items.mapInArrow(deal, "row_id bigint, doc_id bigint, n_tokens bigint, part int, start_token bigint, terms array<int>, counts array<int>, leaf bigint"))
    # One row per leaf, as many as the tree has.
    large = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).withColumn("ways", F.when(F.col("size") > 2 * shard_items, F.ceil(F.col("size") / shard_items)).otherwise(1)).select("leaf", "ways")
    way = F.pmod(F.xxhash64("row_id", "part"), F.col("ways"))
    return dealt.join(F.broadcast(large), "leaf").withColumn("shard", F.concat_ws(".", "leaf", way)).drop("leaf", "ways")


class _Shard:
    """Inverted index of one shard. Postings are arrays of (item, weight) per hashed term.

    Terms that a sixteenth of the items hold or more are kept as rows of a matrix instead: the scores they give to
    the next seeds come from one product for many seeds.
    """

    AHEAD = 64

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray):
        self.n = len(terms)
        size = np.array([len(t) for t in terms], np.int64)
        length = np.array([c.sum() for c in counts], np.float64)
        mean = float(length.mean()) if self.n and length.mean() > 0 else 1.0
        self.kept = np.arange(self.n)
        key = np.concatenate(terms) if self.n else np.zeros(0, np.int32)
        tf = np.concatenate(counts) if self.n else np.zeros(0, np.int32)
        item = np.repeat(np.arange(self.n), size)
        weight = idf[key] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        order = np.argsort(key, kind="stable")
        self.query, self.key, self.items, self.weights = terms, key[order], item[order], weight[order]
        self._find_spans()

    def _find_spans(self) -> None:
        used, start = np.unique(self.key, return_index=True)
        end = np.append(start[1:], len(self.key)) if len(start) else start
        common = (end - start) * 16 >= max(len(self.kept), 1)
        self.spans = dict(zip(used[~common].tolist(), zip(start[~common].tolist(), end[~common].tolist())))
        self.row = np.full(BUCKETS, -1)
        self.row[used[common]] = np.arange(int(common.sum()))
        self.common = np.zeros((int(common.sum()), len(self.kept)), np.float32)
        for r, (a, b) in enumerate(zip(start[common].tolist(), end[common].tolist())):
            self.common[r, self.items[a:b]] = self.weights[a:b]
        self.ahead: dict[int, np.ndarray] = {}

    def foresee(self, seeds: list[int]) -> None:
        """The part of the scores that common terms give, for the seeds that may come next."""
        asks = np.zeros((len(seeds), len(self.common)), np.float32)
        for i, seed in enumerate(seeds):
            rows = self.row[self.query[seed]]
            asks[i, rows[rows >= 0]] = 1.0
        self.ahead = dict(zip(seeds, asks @ self.common))

    def drop(self, unused: np.ndarray) -> None:
        """Leaves the postings of used items out; scores of the others stay the same."""
        kept = np.flatnonzero(unused[self.kept])
        still = np.full(len(self.kept), -1)
        still[kept] = np.arange(len(kept))
        keep = still[self.items] >= 0
        self.key, self.items, self.weights = self.key[keep], still[self.items[keep]], self.weights[keep]
        self.kept = self.kept[kept]
        self._find_spans()

    def scores(self, seed: int, first: int | None = None) -> np.ndarray:
        """The scores of the items in ``kept`` (the ``first`` so many of them) for an item's terms."""
        count = len(self.kept) if first is None else first
        picked = []
        for t in self.query[seed].tolist():
            if t in self.spans:
                start, end = self.spans[t]
                picked.append(slice(start, end if first is None else start + int(self.items[start:end].searchsorted(count))))
        known = self.ahead[seed][:count].astype(np.float64) if seed in self.ahead else np.zeros(count)
        if not picked:
            return known
        return known + np.bincount(np.concatenate([self.items[s] for s in picked]), weights=np.concatenate([self.weights[s] for s in picked]), minlength=count)


def pack(tokens: list[int], terms: list[np.ndarray], counts: list[np.ndarray], capacity: int, idf: np.ndarray) -> list[list[int]]:
    """Containers (lists of item numbers) by retrieval: see the module's first lines. Every item is placed once.

    Inside, items are numbered by size, so that what fits into a room is the beginning of every posting list.
    """
    order = np.argsort(np.asarray(tokens, np.int64), kind="stable")
    size = np.asarray(tokens, np.int64)[order]
    index = _Shard([terms[i] for i in order], [counts[i] for i in order], idf)
    unused = np.ones(len(order), bool)
    left = list(range(len(order)))
    out: list[list[int]] = []

    def take(i: int) -> None:
        unused[i] = False
        del left[bisect_left(left, i)]

    while left:
        seed = left[-1]
        take(seed)
        box, room = [seed], capacity - int(size[seed])
        if room > 0 and left and size[left[0]] <= room:
            if 2 * len(left) < len(index.kept):
                index.drop(unused)
            sizes = size[index.kept]
            fit = int(np.searchsorted(sizes, room, side="right"))
            if seed not in index.ahead:
                index.foresee([seed, *left[-index.AHEAD :]])
            score = index.scores(seed, fit) * unused[index.kept[:fit]]
            # The nearest neighbour that still fits, again and again; a box takes a few, so nothing is sorted.
            while fit and room > 0:
                at = int(np.argmax(score[:fit]))
                if score[at] <= 0:
                    break
                score[at] = 0.0
                i = int(index.kept[at])
                take(i)
                box.append(i)
                room -= int(size[i])
                fit = int(np.searchsorted(sizes[:fit], room, side="right"))
        while left and size[left[0]] <= room:
            i = left[bisect_right(left, int(np.searchsorted(size, room, side="right")) - 1) - 1]
            take(i)
            box.append(i)
            room -= int(size[i])
        out.append([int(order[i]) for i in box])
    return out


_PLACED = "profile string, capacity bigint, container_id string, slot int, row_id bigint, part int, piece int, start_token bigint, tokens bigint, fill bigint"


def _packed(items: DataFrame, idf: np.ndarray, caps: list[tuple[str, int]], stage: int) -> DataFrame:
    """(profile, capacity, container_id, slot, row_id, part, piece, start_token, tokens, fill) by packing each shard on its own.

    A shard's items come once and serve every profile: wholes that fit, and the rests of those that don't.
    With a column ``only`` (a profile's number) an item serves that profile alone.
    """
    shared = items.sparkSession.sparkContext.broadcast(idf)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row_id", "ascending"), ("part", "ascending")]).combine_chunks()
        number = lambda c: table[c].to_numpy()
        lists = lambda c: np.split(table[c].combine_chunks().flatten().to_numpy(), ends)
        row, part, start, length = number("row_id"), number("part"), number("start_token"), number("n_tokens") - number("start_token")
        ends = np.cumsum(pc.list_value_length(table["terms"]).to_numpy())[:-1]
        terms, counts, shard = lists("terms"), lists("counts"), table["shard"][0].as_py()
        names = ("profile", "capacity", "container_id", "slot", "item", "fill")
        out: dict[str, list] = {n: [] for n in names}
        for k, (profile, capacity) in enumerate(caps):
            mine = (part < 0) & (length < capacity) | (part == k)
            if "only" in table.column_names:
                mine &= number("only") == k
            mine = np.flatnonzero(mine)
            tokens = length[mine]
            for n, box in enumerate(pack(tokens.tolist(), [terms[i] for i in mine], [counts[i] for i in mine], capacity, shared.value)):
                fill = int(tokens[box].sum())
                for values, new in zip(out.values(), ([profile] * len(box), [capacity] * len(box), [f"{stage}-{k}-{shard}-{n}"] * len(box), range(len(box)), mine[box].tolist(), [fill] * len(box))):
                    values.extend(new)
        at = np.array(out["item"], np.int64)
        capacity = np.array(out["capacity"], np.int64)
        return pa.table(
            [pa.array(out["profile"], pa.string()), pa.array(capacity), pa.array(out["container_id"], pa.string()), pa.array(out["slot"], pa.int32()), pa.array(row[at]), pa.array(part[at], pa.int32()),
             pa.array((start[at] // np.maximum(capacity, 1)).astype(np.int32)), pa.array(start[at]), pa.array(length[at]), pa.array(out["fill"], pa.int64())],
            names=[c.split()[0] for c in _PLACED.split(", ")],
        )

    columns = ["shard", "row_id", "n_tokens", "part", "start_token", "terms", "counts", *(["only"] if "only" in items.columns else [])]
    return items.select(*columns).groupBy("shard").applyInArrow(run, _PLACED)


def packed_containers(documents: DataFrame, sizes: DataFrame, shard_items: int = 25_000, full: float = 0.99, path: str = VOCABULARY) -> DataFrame:
    """(profile, capacity, container_id, slot, doc_id, piece, start_token, tokens): every text in one container per profile.

    ``shard_items``: the mean number of items of a shard. A text longer than the capacity is cut into pieces of
    the capacity and a rest. An empty or NULL text takes no room and goes where its shard has a container.
    Rows with a NULL or a repeated id are packed like others, each on its own.
    """
    caps = capacities(sizes)
    items = materialize(packed_items(documents, caps, path))
    idf, count = term_idf(items)
    dealt = materialize(with_shards(items, idf, count, shard_items))
    placed = materialize(_packed(dealt, idf, caps, 1))
    settled = placed.where(F.col("fill") >= full * F.col("capacity"))
    # What no shard could fill is little: repacked in shards of the same size across the old ones.
    number = F.create_map(*[x for k, (p, _) in enumerate(caps) for x in (F.lit(p), F.lit(k))]) if caps else F.create_map(F.lit(""), F.lit(0))
    loose = placed.where(F.col("fill") < full * F.col("capacity")).select("row_id", "part", number[F.col("profile")].alias("only"))
    loose = materialize(loose.join(items.drop("doc_id"), ["row_id", "part"]))
    again = max(1, round(loose.count() / shard_items))
    second = _packed(loose.withColumn("shard", F.pmod(F.xxhash64("row_id", "part", "only"), F.lit(again)).cast("string")), idf, caps, 2)
    # A full-size piece fills its container alone and needs no neighbours.
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity")) for p, c in caps]) if caps else F.expr("cast(array() AS array<struct<profile:string,capacity:bigint>>)"))
    wholes = items.where("part = -1").select("row_id", "doc_id", "n_tokens", each.alias("kind")).select("kind.*", "row_id", "doc_id", "n_tokens").where("n_tokens >= capacity")
    pieces = wholes.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_tokens") / F.col("capacity")).cast("bigint") - 1)).alias("p"))
    alone = pieces.select("profile", "capacity", F.concat_ws("-", F.lit("w"), "row_id", "p").alias("container_id"), F.lit(0).alias("slot"), "doc_id", F.col("p").cast("int").alias("piece"), (F.col("p") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("tokens"))
    ids = items.where("part = -1").select("row_id", "doc_id")
    columns = ["profile", "capacity", "container_id", "slot", "doc_id", "piece", "start_token", "tokens"]
    return settled.unionByName(second).join(ids, "row_id").select(*columns).unionByName(alone)


def neighbour_recall(documents: DataFrame, sizes: DataFrame, queries: int = 200, top: int = 10, shard_items: int = 25_000, path: str = VOCABULARY) -> float:
    """The share of the corpus-wide BM25 neighbours (brute force, ``top`` each) that lie in their query's shard.

    For measuring: ``queries`` documents (chosen by hash) against all, in one task.
    """
    items = materialize(packed_items(documents, capacities(sizes), path))
    idf, count = term_idf(items)
    rows = with_shards(items, idf, count, shard_items).where("part = -1").select("row_id", "terms", "counts", "shard").toPandas()
    index = _Shard([np.asarray(t, np.int32) for t in rows["terms"]], [np.asarray(c, np.int32) for c in rows["counts"]], idf)
    shard, hits, asked = rows["shard"].to_numpy(), 0, 0
    for i in np.random.default_rng(3).permutation(len(rows))[:queries]:
        index.foresee([int(i)])
        score = index.scores(int(i))
        score[i] = -1.0
        best = np.argsort(-score, kind="stable")[:top]
        best = best[score[best] > 0]
        hits, asked = hits + int((shard[best] == shard[i]).sum()), asked + len(best)
    return hits / max(asked, 1)


def fill_report(containers: DataFrame) -> DataFrame:
    """Per profile: containers, items, tokens, and the share of the room that is used."""
    return (
        containers.groupBy("profile")
        .agg(F.max("capacity").alias("capacity"), F.count_distinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
        .withColumn("share_used", F.col("tokens") / (F.col("containers") * F.col("capacity")))
    )
