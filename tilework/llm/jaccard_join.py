"""N-gram Jaccard join by chosen paths.

Documents are sets of SHINGLE-word runs; the join finds every pair of texts
with Jaccard similarity of at least SIMILARITY.

1. A scan hashes the shingles of each text into TOKENS minhash tokens; two
   sets share each token with a chance equal to their similarity. Texts with
   the same set are one class, joined through its smallest id.
2. Chosen paths: at each node a set follows those of its tokens that a hash of
   the node picks, 1 / SIMILARITY of them on average, so a similar pair takes
   one step together on average and dissimilar ones part. Nodes with more than
   BUCKET sets are split again, to DEPTH steps at most; smaller ones are
   compared by brute force on their tokens. Runs are repeated with other
   hashes until a pair at the threshold meets with the target recall. A node
   that is still large at full depth holds sets that are nearly all alike: it
   is dealt into blocks, sets near a block's leader are tied to it, and
   leaders are compared with a margin as wide as their sets are away from them
   (tokens that differ are a metric, so no tie between two sets is lost).
3. Ties become candidate clusters. In each cluster all pairs whose sizes allow
   a link are verified exactly on whole shingle sets, block against block, and
   only counts of links and a set of spanning trees leave a task, never the
   pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import UPPER_TO_LOWER, id_order, portions, rolling, scramble, settle, table, texts, whole_groups, word_bounds, word_hashes
from tilework.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
TOKENS, RECALL, DEPTH = 64, 0.999, 3
#: Sets in a node that are compared with each other at once.
BUCKET = 1000
#: Sets in a block of exact verification, and shingles multiplied at once.
BLOCK, COLUMNS = 512, 1 << 14
#: Ratio of the sizes of neighbouring bands; a little over 1 / SIMILARITY, so that
#: linked sets are in one band or in two neighbouring ones.
BAND = 1.0001 / SIMILARITY
BROADCAST_IDS = 1_000_000
KEY = ["o", "tk"]
_STEP = 0xD6E8FEB86659FD93
_MULT = scramble(np.arange(TOKENS, dtype=np.uint64), 51) | np.uint64(1)
_ADD = scramble(np.arange(TOKENS, dtype=np.uint64), 52)


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets with the recall.

    A run of one step meets it with 1 - 1/e; of d steps with
    q_d = 1 - exp(-q_(d-1)).
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def shingle_sets(part: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs without ASCII white space, A-Z in lower case. A text of
    fewer than n words, but not none, is one shingle.
    """
    buf = np.frombuffer(b"\n".join(part).translate(UPPER_TO_LOWER), np.uint8)
    start, end = word_bounds(buf)
    first = np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in part]))
    h = word_hashes(buf, start, end, 61)
    g = rolling(h, n, _STEP, 62)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(rolling(h[a:b], b - a, _STEP, 63 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash tokens, a row of TOKENS 32-bit values per set (none: zeros)."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        h = np.concatenate([sets[i] for i in full])
        cut = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for j in range(TOKENS):
            mixed = ((h * _MULT[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(mixed, cut)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", id_order(docs).alias("o"), F.xxhash64("text").alias("tk"), "text")


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, o, tk, s1, s2 (hashes of the set), n (its size), tokens, sig (their low bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, size, full, low = [], [], [], [], []
            for _, part in portions(texts(batch, "text")):
                sets = shingle_sets(part)
                for s in sets:
                    s1.append(int(scramble(s, 64).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    s2.append(int(scramble(s, 65).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    size.append(len(s))
                found = tokens(sets)
                full += [t.tobytes() for t in found]
                low += [t.tobytes() for t in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", *KEY)], pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int64()), pa.array(full, pa.binary()), pa.array(low, pa.binary())],
                ["doc_id", *KEY, "s1", "s2", "n", "tokens", "sig"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, o long, tk long, s1 long, s2 long, n long, tokens binary, sig binary")


def steps(rows: DataFrame, runs: int, level: int) -> DataFrame:
    """The children (node, rep) of each (node, rep, tokens) row.

    At level 0 every set starts at the root of every run.
    """
    share = 1 / (SIMILARITY * TOKENS)
    limit = np.uint64(int(share * 2**32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            rep = batch.column("rep").to_numpy()
            named = scramble(sig.astype(np.uint64) | place, 71)
            starts = [np.full(len(sig), r, np.uint64) for r in range(runs)] if level == 0 else [batch.column("node").to_numpy().view(np.uint64)]
            for start in starts:
                child = scramble(named ^ scramble(start, 72)[:, None], 73 + level)
                row, at = np.nonzero((child >> np.uint64(32)) < limit)
                node = scramble(child[row, at], 90 + level).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rep[row])], ["node", "rep"])

    return rows.mapInArrow(run, "node long, rep long")


def _roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Least row that each row is tied to, after ties (i, j) more."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def compare(nodes: DataFrame, least: float) -> DataFrame:
    """Ties (a, b) between sets of a node whose tokens agree so often.

    Where nodes have a column ``away``, a pair may miss as many tokens more as
    its two rows are away. All pairs in a node are compared, many nodes at a time: each row with the
    next, then with the one after it, and so on. Only spanning trees of the ties of
    each node are given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "node"):
            node, rep = group["node"].to_numpy(), group["rep"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(-1, TOKENS)
            away = group["away"].to_numpy()
            root, row = np.arange(len(node)), np.arange(len(node))
            for ahead in range(1, len(node)):
                row = row[row + ahead < len(node)]
                row = row[node[row] == node[row + ahead]]
                if not len(row):
                    break
                apart = row[root[row] != root[row + ahead]]
                agreed = (sig[apart] == sig[apart + ahead]).sum(axis=1)
                near = apart[agreed + away[apart] + away[apart + ahead] >= least * TOKENS]
                if len(near):
                    root = _roots(len(node), near, near + ahead, root)
            tied = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[root[tied]]), pa.array(rep[tied])], ["a", "b"])

    away = F.col("away") if "away" in nodes.columns else F.lit(0).alias("away")
    return nodes.select("node", "rep", "sig", away).repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def lead(nodes: DataFrame, near: float) -> DataFrame:
    """For each block of a node, (node, a, b, sig, away): each set b with its leader a, the leader's tokens, and how many of them the farthest of its sets has not."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        full = pdf["sig"].to_numpy()
        sig = np.frombuffer(b"".join(full), np.uint8).reshape(-1, TOKENS)
        rep = pdf["rep"].to_numpy()
        leader = np.full(len(rep), -1)
        for i in range(len(rep)):
            if leader[i] < 0:
                free = i + np.flatnonzero(leader[i:] < 0)
                leader[free[(sig[free] == sig[i]).mean(axis=1) >= near]] = i
                leader[i] = i
        away = np.zeros(len(rep), np.int32)
        np.maximum.at(away, leader, (sig != sig[leader]).sum(axis=1).astype(np.int32))
        return pd.DataFrame({"node": pdf["node"].to_numpy(), "a": rep[leader], "b": rep, "sig": full[leader], "away": away[leader]})

    return nodes.groupBy("node", "block").applyInPandas(run, "node long, a long, b long, sig binary, away int")


def leader_pairs(leaders: DataFrame, bucket: int) -> DataFrame:
    """(node, rep, sig, away) rows dealt anew, so that all pairs of a node's leaders meet in nodes of two blocks at most.

    A node may keep many leaders where a passage is shared by texts that are
    not alike; a task compares about 2 * bucket of them at once.
    """
    blocks = leaders.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("blocks"))
    dealt = leaders.join(blocks, "node").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), *[c for c in leaders.columns if c != "node"])


def candidates(sets: DataFrame, recall: float = RECALL, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """Ties (a, b) over (rep, tokens, sig) rows by chosen paths.

    Tokens are compared at the threshold less four standard deviations of the
    estimate; every tie is only a candidate for exact verification.
    """
    least = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / TOKENS)
    runs = runs_needed(recall, depth)
    rows, ties = sets, []
    for level in range(depth):
        paths = settle(steps(rows, runs, level), f"paths_{level}")
        sizes = settle(paths.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), f"nodes_{level}")
        small = paths.join(sizes.filter(F.col("size") <= bucket), "node").join(sets.select("rep", "sig"), "rep")
        ties.append(settle(compare(small, least), f"ties_{level}"))
        large = sizes.filter(F.col("size") > bucket)
        if large.isEmpty():
            break
        rows = settle(paths.join(large, "node").join(sets, "rep"), f"large_{level}")
        if level == depth - 1:
            dealt = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / bucket).cast("long")))
            led = settle(lead(dealt, 0.85), "leaders")
            ties.append(led.filter("a <> b").select("a", "b"))
            ties.append(compare(leader_pairs(led.filter("a = b").select("node", F.col("a").alias("rep"), "sig", "away"), bucket), least))
    out = ties[0]
    for more in ties[1:]:
        out = out.union(more)
    return out


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """rep, cluster, band of the set's size, and the numbers of blocks in it and in the bands below and above.

    Clusters of more than ``block`` sets are cut into bands of size, as sets
    of which one is less than SIMILARITY of the other cannot be linked; a band is cut by a
    hash, and meets itself and the next bands.
    """
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    band = F.when(F.col("size") > block, F.floor(F.log("n") / F.lit(math.log(BAND)))).otherwise(0).cast("long")
    banded = members.join(whole, "cluster").select("rep", "cluster", band.alias("band"))
    cuts = banded.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    for side, step in (("below", 1), ("above", -1)):
        near = cuts.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(side))
        banded = banded.join(near, ["cluster", "band"], "left")
    return banded.join(cuts, ["cluster", "band"])


def _clusters(sets_of: DataFrame) -> DataFrame:
    """Rows (cluster, i, j, left, rep, grams): each block of a cluster in each task that needs it; blocks are numbered band by band."""

    def of(band: Column, blocks: str) -> Column:
        first = band * F.lit(1 << 32)
        return F.when(F.col(blocks) > 0, F.sequence(first, first + F.col(blocks) - 1)).otherwise(F.array().cast("array<bigint>"))

    band = F.col("band")
    mine = band * F.lit(1 << 32) + F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = sets_of.withColumn("mine", mine).withColumn("other", F.explode(F.concat(of(band - 1, "below"), of(band, "blocks"), of(band + 1, "above"))))
    return dealt.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), "rep", "grams")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    every, at = np.unique(np.concatenate(a + b), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    left = owner < len(a)
    seen_a, seen_b = (np.bincount(at[side], minlength=len(every)) > 0 for side in (left, ~left))
    place = np.cumsum(seen_a & seen_b) - 1
    keep = (seen_a & seen_b)[at]
    at, owner = place[at[keep]], owner[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        s, e = np.searchsorted(at, (first, first + columns))
        grid = np.zeros((len(a) + len(b), min(columns, int(at[-1]) + 1 - first)), np.float32)
        grid[owner[s:e], at[s:e] - first] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out


def verify(docs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Exact links inside clusters: rows (rep, n_links, other).

    members: (o, tk, rep, n, cluster). One row per set and task with its links
    there, and rows with n_links 0 whose ``other`` ties the set to another
    (spanning trees of the task).
    """

    names = ["rep", "cluster", "band", "below", "blocks", "above"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in portions(texts(batch, "text")):
                sets = [s.view(np.int64) for s in shingle_sets(part)]
                rows = batch.slice(i, len(part))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "grams"])

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"rep": [], "n_links": [], "other": []}, dtype="int64")
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        a = pdf if same else pdf[pdf["left"]]
        b = pdf if same else pdf[~pdf["left"]]
        sets_a, sets_b = ([np.frombuffer(g, np.int64) for g in x["grams"]] for x in (a, b))
        na, nb = (np.array([len(s) for s in x], np.float64) for x in (sets_a, sets_b))
        if not len(na) or not len(nb):
            return pd.DataFrame({"rep": [], "n_links": [], "other": []}, dtype="int64")
        both = shared_counts(sets_a, sets_b).astype(np.float64)
        # both / union >= 4/5 in whole numbers
        linked = both * 5 >= (na[:, None] + nb[None, :] - both) * 4
        if same:
            np.fill_diagonal(linked, False)
        ra, rb = a["rep"].to_numpy(), b["rep"].to_numpy()
        out = [(r, n, r) for r, n in zip(ra, linked.sum(1)) if n]
        if not same:
            out += [(r, n, r) for r, n in zip(rb, linked.sum(0)) if n]
        # Spanning trees: breadth first over what is linked.
        free_a, free_b = linked.any(1), np.ones(len(rb), bool)
        for i in range(len(ra)):
            if not free_a[i]:
                continue
            free_a[i] = False
            queue = [i]
            if same:
                free_b[i] = False
            while queue:
                x = queue.pop()
                for y in np.flatnonzero(linked[x] & free_b):
                    free_b[y] = False
                    out.append((ra[x], 0, rb[y]))
                    more = [y] if same else np.flatnonzero(linked[:, y] & free_a)
                    for z in more:
                        if free_a[z]:
                            free_a[z] = False
                            queue.append(z)
                            if not same:
                                out.append((ra[z], 0, rb[y]))
        return pd.DataFrame(out, columns=["rep", "n_links", "other"], dtype="int64")

    few = members.count() <= BROADCAST_IDS
    rows = _keyed(docs).drop("doc_id")
    dealt = settle(members.select(*KEY, "rep").join(_blocks(members, block), "rep"), "blocks")
    found = rows.join(F.broadcast(dealt) if few else dealt, KEY).dropDuplicates(["rep"])
    sets_of = found.select(*names, "text").mapInArrow(grams, "rep long, cluster long, band long, below long, blocks long, above long, grams binary")
    return _clusters(sets_of).groupBy("cluster", "i", "j").applyInPandas(links, "rep long, n_links long, other long")


def named_classes(docs: DataFrame, recall: float = RECALL, depth: int = DEPTH, bucket: int = BUCKET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The surveyed rows (doc_id, o, tk, rep) and the classes (rep, o, tk, head, head_tk, n_links)."""
    rows = settle(survey(docs), "survey")
    # A class is named by a hash of its set's two sums; ids come in at the end.
    rep = F.xxhash64("s1", "s2", "n")
    classes = rows.withColumn("rep", rep).groupBy("rep").agg(F.min(F.struct(*KEY, "n", "tokens", "sig")).alias("m"))
    classes = settle(classes.select("rep", "m.*"), "classes")
    sets = classes.filter("n > 0")
    ties = settle(candidates(sets.select("rep", "tokens", "sig"), recall, depth, bucket), "ties")
    clusters = components(ties).withColumnRenamed("node", "rep").withColumnRenamed("root", "cluster")
    members = settle(sets.select(*KEY, "rep", "n").join(clusters, "rep"), "members")
    found = settle(verify(docs, members, block), "links")
    linked = components(found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    named = classes.select("rep", *KEY).join(linked.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    named = settle(named.withColumn("root", F.coalesce("root", "rep")), "linked")
    heads = named.groupBy("root").agg(F.min(F.struct(*KEY)).alias("h"))
    heads = settle(heads.select("root", F.col("h.o").alias("head"), F.col("h.tk").alias("head_tk")), "heads")
    named = named.join(heads, "root").select("rep", *KEY, "head", "head_tk", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.select("doc_id", *KEY, rep.alias("rep")), settle(named, "named")


def jaccard_join(docs: DataFrame, **how) -> DataFrame:
    """One row per input row: doc_id, class_id, text_class, n_links.

    text_class is the smallest doc_id with the same shingle set; class_id is
    the smallest doc_id that is reached over links of similarity 0.8 or more;
    n_links counts the other text classes that a row's is linked to. Null and
    empty texts (and texts of white space) are one text class without links.
    A null id is larger than any other. Rows with one id but different texts
    are told apart by their text. Extra columns are not read; an empty table
    gives no rows. Ids that are no whole numbers raise ValueError.
    """
    rows, named = named_classes(docs, **how)
    back = rows.select("doc_id", "rep").join(named, "rep")
    null_id = F.lit(2**63 - 1)
    return back.select(
        "doc_id",
        F.when(F.col("head") < null_id, F.col("head")).alias("class_id"),
        F.when(F.col("o") < null_id, F.col("o")).alias("text_class"),
        "n_links",
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns: one of each class, that of the smallest doc_id.

    Rows repeated with that same id and text leave one of them.
    """
    rows, named = named_classes(docs, **how)
    back = rows.join(named.select("rep", "head", "head_tk"), "rep")
    stays = (F.col("o") == F.col("head")) & (F.col("tk") == F.col("head_tk"))
    counts = settle(back.groupBy(*KEY).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not stays"), "fates")
    cols = [F.col(c) for c in docs.columns]
    marked = docs.select(F.struct(*cols).alias("row"), id_order(docs).alias("o"), F.xxhash64("text").alias("tk"))
    few = counts.count() <= BROADCAST_IDS
    kept = marked.join(F.broadcast(counts) if few else counts, KEY, "left_anti")
    twice = counts.filter("stays and n > 1").select(*KEY)
    if not twice.isEmpty():
        kept = kept.unionByName(marked.join(twice, KEY, "left_semi").dropDuplicates(KEY))
    return kept.select("row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and links at a similarity of 0.8 over five-word shingles."""
    return jaccard_join(table(spark, sf_dir, "documents"))
