"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents with the same set of 5-word shingles are one class, found by an aggregation; only classes are
compared. ``BANDS`` bands of ``ROWS`` MinHash values propose pairs: at similarity 0.8 a pair misses all
bands with probability below 1e-7. A proposed pair's MinHash values are compared ``STEP`` at a time and
it is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold
falls below ``EPSILON``; what is left is verified by exact shingle sets.

Buckets of up to ``BUCKET`` classes are expanded into pairs. Larger ones (many near copies of one text)
are not: classes that such buckets link form clusters. Each class of a cluster is described by how it
differs from the cluster's leader. What two classes keep of the leader bounds their similarity from below;
all classes that by this are linked with each other (near copies with few edits) are counted by a sum.
Only the rest is compared with the cluster's classes, in pairs of blocks of about ``BLOCK`` classes, which
get signatures and differences and return a row for each class, not for each pair. No cap applies: every
pair that shares a band is compared in one way or the other, and pairs within a cluster only there.

Defined cases: null text is empty; a text without words is a class of its own and has no links; a text of
fewer than 5 words is a single shingle; repeated rows and copies are in one class and count as links of
each other; an empty table gives an empty result; the class id is the smallest doc_id of the group that
isn't null; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, join_hot, odd_numbers, row_key, shingle_hashes, text_of, word_hashes, written
from .graph import components

THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
EPSILON = 1e-7
BUCKET = 64
#: most classes of a block, and most shingles in which they differ from their leader, on average
BLOCK, BLOCK_SHINGLES = 512, 400_000
SALTS = 64

_A = (odd_numbers(HASHES, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (odd_numbers(HASHES, 22) >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES 32-bit values; the 64-bit shingle hashes are folded, and each function multiplies, adds and folds again."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 1024):  # all functions at once, over as many shingles as fit a core's cache
            part = s[lo : lo + 1024]
            x = part.astype(np.uint32)[None, :] * _A[:, None]
            x += _B[:, None]
            x ^= x >> np.uint32(15)
            x += (part >> np.uint64(32)).astype(np.uint32)[None, :] * np.roll(_A, 1)[:, None]
            np.minimum(out, x.min(axis=1), out=out)
    return out


def least_matches(threshold: float = THRESHOLD, epsilon: float = EPSILON) -> np.ndarray:
    """For n = STEP, 2 STEP, ...: the fewest equal values of n for which P(similarity >= threshold) is at least epsilon.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t equals
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= epsilon:
                break
        out.append(m)
    return np.array(out)


_LEAST = least_matches()


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of signatures stay, comparing STEP values at a time and only rows still alive."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), np.int64)
    for i, least in enumerate(_LEAST):
        cut = slice(i * STEP, (i + 1) * STEP)
        same[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
        alive = alive[same[alive] >= least]
    return alive


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, class (hash of the shingle set, or of the row where there are no words), n shingles, signature."""

    def run(batches):
        for b in batches:
            cls, n, sig = [], [], []
            for key, t in zip(b.column(1).to_pylist(), text_of(b.column(2))):
                s = shingle_set(t)
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else key)
                sig.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "row_key", "class", "n", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, class long, n long, signature binary")


def _class_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _prune(batches):
    for b in batches:
        alive = survivors(_sigs(b.column(2)), _sigs(b.column(3))) if b.num_rows else []
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(alive, pa.int64())), b.column(1).take(pa.array(alive, pa.int64()))], names=["a", "b"])


def _verify(batches):
    for b in batches:
        x, y = ([np.frombuffer(s, np.uint64) for s in c.to_pylist()] for c in (b.column(2), b.column(3)))
        common = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)]
        keep = pa.array([5 * c >= 4 * (len(p) + len(q) - c) for c, p, q in zip(common, x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def linked(apart: list[np.ndarray], n: np.ndarray, lost: np.ndarray, leader: int, sigs: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The 0/1 matrix of links between the classes rows and cols of a block pair.

    Each set A is given by its size n and ``apart``, where it differs from its cluster's leader L (of size
    ``leader``): ``lost`` shingles of L are not in A. Two sets have leader - lost - lost' + |apart and apart'|
    shingles in common, whatever L is.
    """
    pairs = np.zeros((len(rows), len(cols)), bool)
    for i, r in enumerate(rows):
        pairs[i, survivors(np.broadcast_to(sigs[r], (len(cols), HASHES)), sigs[cols])] = True
    common = leader - lost[rows][:, None] - lost[cols][None, :]
    enough = 4 * (n[rows][:, None] + n[cols][None, :])
    certain = 9 * common >= enough
    unsure = pairs & ~certain
    if unsure.any():
        _, at = np.unique(np.concatenate([apart[i] for i in (*rows, *cols)]), return_inverse=True)
        ends = np.cumsum([len(apart[i]) for i in (*rows, *cols)])
        own = [at[e - len(apart[i]) : e] for i, e in zip((*rows, *cols), ends)]
        left, right = own[: len(rows)], own[len(rows) :]
        mark = np.zeros(int(at.max(initial=0)) + 1, bool)
        flat, stop = np.concatenate(right), np.cumsum([0, *map(len, right)])
        for i in np.flatnonzero(unsure.any(axis=1)):
            mark[left[i]] = True
            upto = np.concatenate([[0], np.cumsum(mark[flat])])
            common[i] += upto[stop[1:]] - upto[stop[:-1]]
            mark[left[i]] = False
        certain |= unsure & (9 * common >= enough)
    return pairs & certain


def _against_leader(batches):
    """How each class differs from its cluster's leader."""
    names = ["cluster", "class", "members", "n", "n_leader", "lost", "near", "apart"]
    for b in batches:
        n, n_leader, lost, apart = [], [], [], []
        for own, leader in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            x, y = np.frombuffer(own, np.uint64), np.frombuffer(leader, np.uint64)
            d = np.setxor1d(x, y, assume_unique=True)
            n.append(len(x))
            n_leader.append(len(y))
            lost.append((len(d) + len(y) - len(x)) // 2)
            apart.append(d.tobytes())
        near = [9 * (m - 2 * k) >= 8 * size for size, m, k in zip(n, n_leader, lost)]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(x, pa.int64()) for x in (n, n_leader, lost)), pa.array(near, pa.bool_()), pa.array(apart, pa.binary())], names=names)


def _blocks(table: pa.Table) -> pa.Table:
    """One pair of blocks of a cluster: for each class its links in the pair, and an edge to the smallest class it is connected with there."""
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    block, cls, members, n, lost = (table.column(c).to_numpy() for c in ("block", "class", "members", "n", "lost"))
    apart = [np.frombuffer(s, np.uint64) for s in table.column("apart").to_pylist()]
    sigs = _sigs(table.column("signature"))
    rows, cols = np.flatnonzero(block == first), np.flatnonzero(block == second)
    links, root = np.zeros(len(cls), np.int64), cls.copy()
    if len(rows) and len(cols):
        m = linked(apart, n, lost, table.column("n_leader")[0].as_py(), sigs, rows, cols)
        if first == second:
            np.fill_diagonal(m, False)
            links[rows] = m @ members[cols]
        else:
            links[rows] = m @ members[cols]
            links[cols] = members[rows] @ m
        big = np.iinfo(np.int64).max
        while True:  # the smallest label spreads over the links of this pair
            before = root.copy()
            root[rows] = np.minimum(root[rows], np.where(m, root[cols][None, :], big).min(axis=1))
            root[cols] = np.minimum(root[cols], np.where(m, root[rows][:, None], big).min(axis=0))
            if (root == before).all():
                break
    return pa.table({"class": cls, "links": links, "root": root})


def _spread(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Join rows (cluster, class, ...) with a row for each cluster, of which each of SALTS parts of a cluster gets a copy."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(salted, ["cluster", "salt"]).drop("salt")


def _cluster_links(clusters: DataFrame, classes: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (class, links, root) within clusters (class, cluster, weight).

    A cluster's leader is the class that shares most buckets. Classes near it are all linked with each other,
    as the shingles that they have in common with the leader suffice for any two of them: they are counted by
    a sum. Each of the others is compared with all classes of its cluster, in blocks.
    """
    leaders = clusters.groupBy("cluster").agg(F.max_by("class", F.struct("weight", "class")).alias("class")).join(sets, "class").select("cluster", F.col("shingles").alias("leader"))
    full = clusters.join(classes.select("class", "members"), "class").join(sets, "class").select("cluster", "class", "members", "shingles")
    against = written(_spread(full, leaders).select("cluster", "class", "members", "shingles", "leader").mapInArrow(_against_leader, "cluster long, class long, members long, n long, n_leader long, lost long, near boolean, apart binary"))
    size = lambda near: F.ceil(F.greatest(F.count_if(near) / BLOCK, F.coalesce(F.sum(F.when(near, F.length("apart") / 8)), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    near = F.col("near")
    facts = written(against.groupBy("cluster").agg(F.coalesce(F.sum(F.when(near, F.col("members"))), F.lit(0)).alias("near_members"), F.min(F.when(near, F.col("class"))).alias("near_root"), size(~near).alias("far_blocks"), size(near).alias("near_blocks")))
    known = _spread(against, facts)
    sums = known.where("near").select("class", (F.col("near_members") - F.col("members")).alias("links"), F.col("near_root").alias("root"))
    part = lambda blocks: F.pmod(F.xxhash64("class", F.lit(1)), F.greatest(F.col(blocks), F.lit(1))).cast("int")
    rest = known.where("far_blocks > 0").join(sigs, "class").withColumn("block", F.when(near, F.col("far_blocks") + part("near_blocks")).otherwise(part("far_blocks")))
    last = F.col("far_blocks") - 1 + F.when(near, 0).otherwise(F.col("near_blocks"))
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    inside = dealt.select("cluster", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "class", "members", "n", "n_leader", "lost", "signature", "apart")
    return sums.unionByName(inside.groupBy("cluster", "first", "second").applyInArrow(_blocks, "class long, links long, root long"))


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their class, classes with members and smallest doc_id, links): links are rows (a, b, weight_a, weight_b, root) as used below."""
    rows = written(signatures(docs))
    classes = written(rows.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least_doc"), F.coalesce(F.min_by("row_key", "doc_id"), F.min("row_key")).alias("least_key")))
    sigs = written(rows.where("n > 0").groupBy("class").agg(F.any_value("signature").alias("signature")))
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)])).alias("bucket")
    banded = sigs.select("class", band)
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
    members = written(banded.join(shared, "bucket"))
    small, hot = members.where(F.col("in_bucket") <= BUCKET), members.where(F.col("in_bucket") > BUCKET)
    l, r = small.select("bucket", F.col("class").alias("a")), small.select("bucket", F.col("class").alias("b"))
    pairs = l.join(r, "bucket").where("a < b").select("a", "b").distinct()

    # clusters: buckets are nodes beside classes, both 64-bit hashes
    clusters = None
    if hot.limit(1).count():
        roots = components(hot.select(F.col("bucket").alias("a"), F.col("class").alias("b")))
        weights = hot.groupBy(F.col("class").alias("node")).agg(F.sum("in_bucket").alias("weight"))
        clusters = written(roots.join(weights, "node").select(F.col("node").alias("class"), F.col("root").alias("cluster"), "weight"))
        for side in ("a", "b"):
            pairs = pairs.join(clusters.select(F.col("class").alias(side), F.col("cluster").alias(f"cluster_{side}")), side, "left")
        pairs = pairs.where("cluster_a is null or cluster_b is null or cluster_a != cluster_b").select("a", "b")

    s = lambda c: sigs.select(F.col("class").alias(c), F.col("signature").alias(f"signature_{c}"))
    alive = written(pairs.join(s("a"), "a").join(s("b"), "b").select("a", "b", "signature_a", "signature_b").mapInArrow(_prune, "a long, b long"))

    needed = alive.select(F.explode(F.array("a", "b")).alias("class"))
    if clusters is not None:
        needed = needed.unionByName(clusters.select("class"))
    wanted = classes.join(needed.distinct(), "class").select("class", F.col("least_key").alias("row_key"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).tobytes() for t in text_of(b.column(1))], pa.binary())], names=["class", "shingles"])

    texts = docs.select(row_key("doc_id", "text").alias("row_key"), "text").join(wanted, "row_key").select("class", "text")
    sets = written(texts.mapInArrow(run, "class long, shingles binary")).dropDuplicates(["class"])  # repeated rows
    t = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"shingles_{c}"))
    edges = written(alive.join(t("a"), "a").join(t("b"), "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(_verify, "a long, b long"))
    m = lambda c: classes.select(F.col("class").alias(c), F.col("members").alias(f"members_{c}"))
    weighted = edges.join(m("a"), "a").join(m("b"), "b")
    links = weighted.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("members_b").alias("links"), F.least("a", "b").alias("root")), F.struct(F.col("b").alias("class"), F.col("members_a").alias("links"), F.least("a", "b").alias("root")))).alias("x")).select("x.class", "x.links", "x.root")
    if clusters is not None:
        links = links.unionByName(_cluster_links(clusters, classes, sigs, sets))
    return rows, classes, written(links)


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, row_key, class_id (smallest doc_id of its group), n_links, n_copies, first_key (the row_key that stands for the group)."""
    rows, classes, links = similar_classes(docs)
    groups = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    count = links.groupBy("class").agg(F.sum("links").alias("links"))
    c = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").join(count, "class", "left").withColumn("root", F.coalesce("root", "class"))
    c = written(c.select("class", "members", "root", "least_doc", "least_key", F.coalesce("links", F.lit(0)).alias("links")))
    # of a group, the smallest doc_id stays; nulls come last
    first = c.groupBy("root").agg(F.min(F.struct(F.col("least_doc").isNull(), F.col("least_doc"), F.col("least_key"))).alias("s"), F.count(F.lit(1)).alias("n_classes"))
    total = c.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("members"), F.lit(0)).alias("rows")).first()
    c = join_hot(c, first, "root", "n_classes", total.classes).select("class", "members", "links", F.col("s.least_doc").alias("class_id"), F.col("s.least_key").alias("first_key"))
    return join_hot(rows, written(c), "class", "members", total.rows).select("doc_id", "row_key", "class_id", (F.col("links") + F.col("members") - 1).alias("n_links"), F.col("members").alias("n_copies"), "first_key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, of which one stays for each group."""
    key = free_name(docs, "content_key")
    groups = written(near_groups(docs))
    stay = written(groups.select(F.col("first_key").alias(key)).distinct())
    kept = docs.withColumn(key, row_key("doc_id", "text")).join(stay, key, "left_semi")
    keys = groups.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_key").alias("keys")).first()
    if keys.rows != keys.keys:  # rows that are repeated whole; else no shuffle of texts
        kept = kept.dropDuplicates([key])
    return kept.select(*docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")
