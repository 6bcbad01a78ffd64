"""Near duplicates by a chosen-path set similarity join.

A document is its set of distinct word shingles; documents with equal sets are one node. Every node has MINS minwise tokens, and MORE
further ones of eight bits. In each of TREES independent trees a node follows one or two paths: a path is extended by the minwise token of
its tree and level (of two tokens with chance 1/4, so that two sets with similarity 0.8 share one path a level in the mean); no two trees or
levels look at the same token. Groups of nodes on one path that are larger than LEAF branch again, up to LEVELS deep; smaller ones are compared
exhaustively, first by a 128-bit sketch of the minwise tokens, then on full sets. Nodes that branch more than SHALLOW times in any tree walk
DEEP_TREES further trees among themselves. So a pair that is missed either parted within SHALLOW levels in each of TREES trees, or in
each of TREES + DEEP_TREES trees; at similarity 0.8 each has a chance of about 1e-4 at most, whatever the depth (1e-8 where groups do not
branch); tests hold the tokens against this.

What matters is which documents are connected, so a group need not list its pairs, and **a group whose members already are one component is
closed**: no link inside it can join anything. The trees are walked in turn, and what a turn proposes is confirmed on full sets and joined to
components before the next begins:
(1) the first look takes the first level of FIRST trees, cuts its groups into blocks of about LEAF and proposes a maximum spanning forest of
each block's sketch-alike pairs, and pairs of a large group's members with its smallest; a large group of copies is one component after it,
often with a fringe of others that are nearly, but not, similar to it. Such a family (`families`: members alike with the root of a component
of more than LEAF nodes that makes up half of them) is searched whole, once, as in (4), and its pairs are never compared again: a group of
members of one family is closed, too, and one with LEAF others at most is closed when these are set down to be compared with the family in (4).
(2) TREES trees, then (3) DEEP_TREES further ones walk as said above over groups that still hold several components, and propose between
different components only. (4) Groups in which more than one component is left are looked at again, each once (it is named by its smallest
member, whatever trees it was met in): every member outside the commonest component is compared with every member of another component, in
blocks of BLOCK by BLOCK, by sketches, and those with an alike partner on full sets. So no link between components is lost in a group of any
size, and a group of copies costs about its size."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from boutline.llm.bytesops import LOWER, mix, segment_hashes, text_bytes, words
from boutline.llm.common import arrow_map, lean, pieces, skew_join, staged

SHINGLE, PERCENT = 5, 80
TREES, LEVELS, MINS, LEAF, BLOCK = 10, 6, 64, 200, 256
SHALLOW, DEEP_TREES = 3, 10
FIRST = 2
MORE = 2 * (TREES * (LEVELS - SHALLOW) + DEEP_TREES * LEVELS)
ALIKE = 40  # of 64 two-bit tokens; expected 54 at similarity 0.8, 20 for strangers
_rng = np.random.default_rng(77)
MULTIPLY = _rng.integers(1, 2**31, MINS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _rng.integers(0, 2**32, MINS, dtype=np.uint32)
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PAIRS = np.uint64(0x5555555555555555)
EDGE_BLOCK = 200
FEW = 200_000  # rows of two or three numbers that are broadcast at most; more are joined by a shuffle
MULTIPLY_MORE = _rng.integers(1, 2**31, MORE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT_MORE = _rng.integers(0, 2**32, MORE, dtype=np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: ``width`` lower-cased (A-Z) words, or all words if there are fewer."""
    raw, bounds = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, per = words(raw, bounds)
    word = segment_hashes(raw, starts, ends)
    n = len(word) - width + 1
    if n > 0:
        joined = mix(sum(word[i:n + i] * PLACE[i % 64] for i in range(width)))
    out = []
    for a, b in zip(per.tolist(), per[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(joined[a:b - width + 1]))
        elif b > a:
            out.append(mix((word[a:b] * PLACE[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(items: np.ndarray, multiply: np.ndarray = MULTIPLY, shift: np.ndarray = SHIFT) -> np.ndarray:
    """A minimum hash of a set (32 bits) for each of ``multiply``."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multiply), 2**32 - 1, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(out, (multiply[:, None] * x[None, a:a + 1024] + shift[:, None]).min(1), out=out)
    return out


def short_tokens(items: np.ndarray) -> np.ndarray:
    """MORE minwise tokens of eight bits, four in a word: a chance match of two of them adds a path to look at, and loses none."""
    return (mix(minwise(items, MULTIPLY_MORE, SHIFT_MORE).astype(np.uint64)) & np.uint64(255)).astype(np.uint8).view(np.int32)


def sketch(mins: np.ndarray) -> tuple[int, int]:
    """Two bits of each minwise token, in two words."""
    two = mix(mins.astype(np.uint64)) & np.uint64(3)
    place = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return tuple(int(w) for w in np.stack([(two[:32] << place).sum(), (two[32:] << place).sum()]).view(np.int64))


def matches(a1, a2, b1, b2) -> np.ndarray:
    """How many two-bit tokens of two sketches are equal."""
    x, y = a1 ^ b1, a2 ^ b2
    return 64 - np.bitwise_count((x | (x >> np.uint64(1))) & PAIRS).astype(np.int64) - np.bitwise_count((y | (y >> np.uint64(1))) & PAIRS)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (a digest of the set), ``s1, s2`` (sketch), ``mins`` (minwise and short tokens) per row."""

    def run(batch):
        out = {k: [] for k in ("n_shingles", "d1", "d2", "s1", "s2", "mins")}
        for items in shingle_sets(batch.column("text"), width):
            m = minwise(items)
            d = np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64)
            for name, v in zip(out, (len(items), int(d[0]), int(d[1]), *sketch(m), np.concatenate([m.view(np.int32), short_tokens(items)]))):
                out[name].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run,
                     "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, s1 bigint, s2 bigint, mins array<int>")


def coordinate(tree: np.ndarray, level: int, option: int) -> np.ndarray:
    """The token that a level of a tree looks at: under MINS a minwise token, from there on a short one. Each has one use."""
    first = (tree * SHALLOW + level - 1) * 2 if level <= SHALLOW else MINS + (tree * (LEVELS - SHALLOW) + level - SHALLOW - 1) * 2
    further = MINS + 2 * TREES * (LEVELS - SHALLOW) + ((tree - TREES) * LEVELS + level - 1) * 2
    return np.where(tree < TREES, first, further) + option


def branch(tokens: np.ndarray, at: np.ndarray, tree: np.ndarray, path: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, trees and paths one level further: ``at`` are rows of ``tokens``, with their tree and path."""
    take, went, new = [], [], []
    for option in (0, 1):
        go = np.arange(len(at)) if option == 0 else np.flatnonzero((mix(path ^ PLACE[0]) & np.uint64(3)) == 0)
        value = tokens[at[go], coordinate(tree[go], level, option)].astype(np.uint64)
        take.append(at[go])
        went.append(tree[go])
        new.append(mix(path[go] * PLACE[1] + ((np.uint64(option) << np.uint64(32)) | value) * PLACE[2]))
    return np.concatenate(take), np.concatenate(went), np.concatenate(new)


def entered(rows: int, trees: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, tree, path`` of rows that enter every one of ``trees``."""
    tree = np.tile(np.arange(trees.start, trees.stop), rows)
    return np.repeat(np.arange(rows), len(trees)), tree, mix(tree.astype(np.uint64) + np.uint64(1))


def spelled_out(mins: np.ndarray) -> np.ndarray:
    """All tokens of rows of ``mins`` (32-bit words), one a column."""
    return np.concatenate([mins[:, :MINS], np.ascontiguousarray(mins[:, MINS:]).view(np.uint8)], axis=1)


def branched(rows: DataFrame, level: int, trees: range) -> DataFrame:
    """``node, root, seen, tree, path, s1, s2`` one level further for rows with ``mins``; at level 1 every node enters every one of ``trees``."""

    def run(batch):
        n = batch.num_rows
        tokens = spelled_out(np.asarray(batch.column("mins").flatten(), dtype=np.int32).view(np.uint32).reshape(n, MINS + MORE // 4))
        if level == 1:
            at, tree, path = entered(n, trees)
        else:
            at, tree, path = np.arange(n), batch.column("tree").to_numpy().astype(np.int64), batch.column("path").to_numpy().view(np.uint64)
        take, tree, path = branch(tokens, at, tree, path, level)
        return {"node": batch.column("node").take(take), "root": batch.column("root").take(take), "seen": batch.column("seen").take(take), "tree": tree, "path": path.view(np.int64),
                "s1": batch.column("s1").take(take), "s2": batch.column("s2").take(take)}

    return arrow_map(rows, run, "node bigint, root bigint, seen bigint, tree int, path bigint, s1 bigint, s2 bigint", text=None)


def forest(pairs: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    """Pairs (a, b) of a maximum spanning forest of (likeness, a, b, root of a, root of b) over the roots."""
    head: dict[int, int] = {}

    def find(x):
        while head.get(x, x) != x:
            head[x] = head.get(head[x], head[x])
            x = head[x]
        return x

    out = []
    for _, a, b, ra, rb in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        x, y = find(ra), find(rb)
        if x != y:
            head[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def leaf_pairs(rows: DataFrame) -> DataFrame:
    """``key, a, b``: a spanning forest of each path's sketch-alike nodes of different roots and families; key is the smallest of these nodes.
    Each of the nodes is also given alone (a = b). Every path is compared exhaustively, so paths must be small."""

    def groups(batches):
        kept = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("path", "node", "root", "seen", "s1", "s2")]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last path may go on
            kept = [c[cut:] for c in cols]
            yield [c[:cut] for c in cols]
        if kept is not None:
            yield kept

    def run(batches):
        for path, node, root, seen, s1, s2 in groups(batches):
            s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
            found, d = [], 1
            while len(path) > d and len(i := np.flatnonzero(path[d:] == path[:-d])):
                m = matches(s1[i], s2[i], s1[i + d], s2[i + d])
                ok = (m >= ALIKE) & (root[i] != root[i + d]) & (seen[i] != seen[i + d])
                found.append(np.stack([path[i[ok]], m[ok], node[i[ok]], node[i[ok] + d], root[i[ok]], root[i[ok] + d]]))
                d += 1
            if not found:
                continue
            all_ = np.concatenate(found, 1)
            all_ = all_[:, np.argsort(all_[0], kind="stable")]
            if not all_.shape[1]:
                continue
            out = []
            for part in np.split(all_, np.flatnonzero(np.diff(all_[0])) + 1, axis=1):
                alike_ones = np.unique(part[2:4]).tolist()
                key = alike_ones[0]
                out += [(key, a, a) for a in alike_ones]
                out += [(key, a, b) for a, b in forest(list(zip(*part[1:].tolist())))]
            yield pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in out], pa.int64()) for k, name in enumerate(("key", "a", "b"))})

    narrow = rows.select("path", "node", "root", "seen", "s1", "s2").repartition("path").sortWithinPartitions("path", "node")
    return narrow.mapInArrow(lean(run), "key bigint, a bigint, b bigint")


def grouped(paths: DataFrame) -> DataFrame:
    """Rows of ``paths`` in open groups (several roots and not all of one family), with the group's size ``_n`` and its smallest member
    (pn, pr, ps, p1, p2)."""
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("node", "root", "seen", "s1", "s2")).alias("p"),
                                      F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("seen").alias("s1"), F.max("seen").alias("s2")).filter("r1 < r2 and s1 < s2")
    sizes = staged(sizes.select("path", "_n", *[F.col(f"p.{c}").alias(n) for c, n in (("node", "pn"), ("root", "pr"), ("seen", "ps"), ("s1", "p1"), ("s2", "p2"))]), "sizes")
    return staged(skew_join(paths, sizes, "path", paths.count()), "groups")


def with_smallest(large: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of ``large`` groups with the group's smallest member b, if they are alike and of different roots and families."""
    return large.filter((F.col("pr") != F.col("root")) & (F.col("ps") != F.col("seen")) & (alike() >= ALIKE)).select(F.col("node").alias("a"), F.col("pn").alias("b"))


def first_look(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposed pairs (a, b) of the groups on the first level of FIRST trees, and the rows of the large ones; see the module."""
    here = grouped(staged(branched(nodes, 1, range(FIRST)), "paths"))
    block = F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("_n") / LEAF))
    blocks = here.withColumn("path", F.when(F.col("_n") <= LEAF, F.col("path")).otherwise(F.xxhash64("path", block)))
    large = here.filter(F.col("_n") > LEAF)
    return proposed([leaf_pairs(blocks).filter("a <> b").select("a", "b"), with_smallest(large)]), large


def families(large: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, node``: members of ``large`` groups that are alike with the root (key) of the group's largest component, where that component has more than
    LEAF of the group's nodes and is half of them or more."""
    placed = staged(large.select("path", "node", "s1", "s2").join(few(known), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    most = placed.groupBy("path", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("path").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("_n")).filter(F.col("m.k") > LEAF)
    hubs = most.select("path", "_n", F.col("m.root").alias("key")).join(nodes.select(F.col("node").alias("key"), F.col("s1").alias("p1"), F.col("s2").alias("p2")).dropDuplicates(["key"]), "key")
    near = skew_join(placed, staged(hubs, "hubs"), "path", placed.count()).filter((alike() >= ALIKE) | (F.col("root") == F.col("key")))
    near = staged(near.groupBy("key", "node").agg(F.max(F.col("root") == F.col("key")).alias("own")), "near")
    firm = near.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.count_if("own").alias("k")).filter(2 * F.col("k") >= F.col("_n"))
    return staged(skew_join(near.select("key", "node"), staged(firm.select("key", "_n"), "firm"), "key", near.count()).select("key", "node"), "families")


def without_families(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``large`` without groups that are one family but for LEAF members at most, and these members (key of the family, node)."""
    most = large.filter("seen <> node").groupBy("path", "seen", "_n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("_n") - F.col("k") <= LEAF)
    closed = few(staged(most.groupBy("path").agg(F.max(F.struct("k", "seen")).alias("m")).select("path", F.col("m.seen").alias("key")), "closed"))
    others = large.join(closed, "path").filter(F.col("seen") != F.col("key")).select("key", "node")
    return large.join(closed, "path", "left_anti"), others


def walked(nodes: DataFrame, trees: range) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame], DataFrame | None]:
    """Walks ``trees`` over ``nodes`` (node, root, seen, s1, s2, mins), along open groups. Gives leaves (path, node, root, seen, s1, s2),
    proposed pairs (a, b), members (key, node) of groups that are large to the end, and the nodes (node) that branch more than SHALLOW times,
    if any. Every level reads the tokens of its nodes again, so ``nodes`` should be a staged table."""
    paths = staged(branched(nodes, 1, trees), "paths")
    pairs, leaves, members, deep = [], [], [], None
    for level in range(1, LEVELS + 1):
        here = grouped(paths)
        leaves.append(here.filter(F.col("_n") <= LEAF).select("path", "node", "root", "seen", "s1", "s2"))
        large, others = without_families(here.filter(F.col("_n") > LEAF))
        members.append(others)
        if large.isEmpty():
            break
        pairs.append(with_smallest(large))
        if level == LEVELS:
            members.append(large.select(F.col("pn").alias("key"), "node"))
            break
        if level == SHALLOW:
            deep = staged(large.select("node").distinct(), "deep")
        further = large.select("node", "root", "seen", "tree", "path", "s1", "s2")
        paths = staged(branched(further.join(nodes.select("node", "mins"), "node"), level + 1, trees), "paths")
    return leaves, pairs, members, deep


def turn(nodes: DataFrame, trees: range) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One walk: proposed pairs (a, b), members (key, node) of groups to be looked at again, and nodes that went deep."""
    leaves, pairs, members, deep = walked(nodes, trees)
    found = staged(leaf_pairs(union(leaves)), "leaves")
    members.append(found.filter("a = b").select("key", F.col("a").alias("node")))
    return proposed([*pairs, found.filter("a <> b").select("a", "b")]), union(members).distinct(), deep


def proposed(frames: list[DataFrame]) -> DataFrame:
    """Each pair once, whichever way it was proposed; a pair with a group's smallest member keeps it as its b."""
    both = union(frames).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.col("b") < F.col("a")).alias("turned"))
    return staged(both.select(F.when(F.col("turned"), F.col("y")).otherwise(F.col("x")).alias("a"), F.when(F.col("turned"), F.col("x")).otherwise(F.col("y")).alias("b")), "pairs")


def few(df: DataFrame) -> DataFrame:
    """A staged narrow table, to be broadcast if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def alike():
    """``matches`` of the columns s1, s2 with p1, p2."""
    def differ(x):
        return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))

    return 64 - differ(F.col("s1").bitwiseXOR(F.col("p1"))) - differ(F.col("s2").bitwiseXOR(F.col("p2")))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar. Each a's text goes to its b; a b with many pairs (a group's smallest member)
    is shared by tasks, and its text is sent once to each."""
    total = pairs.count()
    degree = staged(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")), "degree")
    dealt = skew_join(pairs, degree, "b", total).withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("_n") / EDGE_BLOCK)).cast("int"))
    dealt = staged(dealt.select("a", "b", "part"), "dealt")
    first = dealt.join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "part", "a", "text")
    second = dealt.select("b", "part").distinct().join(texts.select(F.col("node").alias("b"), "text"), "b").select("b", "part", F.lit(None).cast("bigint").alias("a"), "text")

    def run(batches):
        held, own = None, None
        for batch in batches:
            for some in pieces(batch):
                out = []
                for b, part, a, items in zip(*[some.column(c).to_pylist() for c in ("b", "part", "a")], shingle_sets(some.column("text"), width)):
                    if a is None:
                        held, own = (b, part), items
                    elif held == (b, part) and similar(own, items, percent):
                        out.append((a, b))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = first.unionByName(second).repartition("b", "part")
    return rows.sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()).mapInArrow(lean(run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (a, b): the smallest node of its component. Every round each node points to its
    smallest neighbour, pointers are followed some steps, and the links between the places they lead to are the next round's."""
    links, rounds = staged(links.filter("a <> b").distinct(), "links"), []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "points")
        for _ in range(2):
            further = to.select(F.col("node").alias("to"), F.col("to").alias("far"))
            to = staged(to.join(further, "to").select("node", F.col("far").alias("to")), "points")
        rounds.append(to)
        for end in ("a", "b"):
            links = links.join(to.select(F.col("node").alias(end), F.col("to").alias("_to")), end).drop(end).withColumnRenamed("_to", end)
        links = staged(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].withColumnRenamed("to", "root")
    for to in rounds[1:]:
        step = to.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return staged(out, "components")


def joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root`` after ``links`` (a, b) were added to the components ``known``."""
    if known is None:
        return components(links)
    for end in ("a", "b"):
        of = known.select(F.col("node").alias(end), F.col("root").alias("_r"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    step = components(links)
    if step.isEmpty():
        return known
    moved = known.join(step.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return staged(moved.unionByName(step.join(known.select("node"), "node", "left_anti")), "components")


def places(known: DataFrame, family: DataFrame | None = None) -> DataFrame:
    """``node, root, seen`` of every node that has a root in ``known`` (node, root) or a family in ``family`` (node, seen); what it lacks is null."""
    if family is None:
        return known.select("node", "root", F.lit(None).cast("bigint").alias("seen"))
    return staged(known.join(family, "node", "full_outer"), "places")


def second_look(members: DataFrame, at: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components of one group; see the module. ``at`` are their ``places``; ``nodes`` have node, s1, s2."""
    named = members.join(few(at), "node", "left").join(nodes.select("node", "s1", "s2"), "node")
    placed = staged(named.select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("seen", "node").alias("seen"), "s1", "s2"), "members")
    total = placed.count()

    def most(by):
        """The value of ``by`` that most of a group share: its rows need no look among themselves."""
        return placed.groupBy("key", by).agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.sum("k").alias("_n"), F.max(F.struct("k", by)).alias(f"of_{by}"))

    # a group of two nodes is a pair that was compared already
    sizes = most("root").join(most("seen").drop("_n"), "key").withColumn("most", F.greatest("of_root.k", "of_seen.k")).filter((F.col("_n") > F.col("most")) & (F.col("_n") > 2))
    sizes = staged(sizes.select("key", "_n", F.when(F.col("of_root.k") == F.col("most"), F.col("of_root.root")).alias("main"), F.col("of_seen.seen").alias("main_seen"),
                                F.ceil(F.col("_n") / BLOCK).alias("nm"), F.ceil((F.col("_n") - F.col("most")) / BLOCK).alias("nq")), "open")
    if sizes.isEmpty():
        return sizes.select(F.col("key").alias("a"), F.col("key").alias("b"))
    rows = staged(skew_join(placed, sizes, "key", total), "looked")
    many = rows.select("key", "node", "root", "seen", "s1", "s2", F.pmod(F.xxhash64("node"), "nm").alias("mb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1)).alias("qb"), F.lit(False).alias("asks"))
    asks = rows.filter("if(main is not null, root <> main, seen <> main_seen)").select("key", "node", "root", "seen", "s1", "s2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nm") - 1)).alias("mb"),
                                              F.pmod(F.xxhash64("node", F.lit(7)), "nq").alias("qb"), F.lit(True).alias("asks"))

    fields = ("key", "mb", "qb", "asks", "node", "root", "seen", "s1", "s2")
    kinds = [pa.bool_() if c == "asks" else pa.int64() for c in fields]

    def narrow(batches):
        """Those of a cell that have an alike partner of another root and family on the other side."""
        def answer(cell):
            ask, _, root, seen, s1, s2 = (np.array(c) for c in zip(*[r[3:] for r in cell]))
            s1, s2, hit = s1.astype(np.int64).view(np.uint64), s2.astype(np.int64).view(np.uint64), np.zeros(len(ask), bool)
            held = np.flatnonzero(~ask)
            for i in np.flatnonzero(ask):
                ok = held[(root[held] != root[i]) & (seen[held] != seen[i]) & (matches(s1[held], s2[held], s1[i], s2[i]) >= ALIKE)]
                hit[ok] = True
                hit[i] = len(ok) > 0
            out = [cell[i] for i in np.flatnonzero(hit)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=list(fields))

        cell = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in fields]):
                if cell and cell[0][:3] != row[:3]:
                    yield answer(cell)
                    cell = []
                cell.append(row)
        if cell:
            yield answer(cell)

    cells = many.unionByName(asks).select(*fields).repartition("key", "mb", "qb").sortWithinPartitions("key", "mb", "qb")
    alike_rows = staged(cells.mapInArrow(lean(narrow), "key bigint, mb bigint, qb bigint, asks boolean, node bigint, root bigint, seen bigint, s1 bigint, s2 bigint"), "alike")
    full = alike_rows.join(texts_of(docs, alike_rows.select("node")), "node")

    def run(batches):
        key, held = None, []
        for batch in batches:
            for some in pieces(batch):
                links = []
                cols = [some.column(c).to_pylist() for c in fields]
                for group, mb, qb, ask, node, root, seen, s1, s2, items in zip(*cols, shingle_sets(some.column("text"), width)):
                    if key != (group, mb, qb):
                        key, held, head = (group, mb, qb), [], {}
                    if not ask:
                        held.append((node, root, seen, s1, s2, items))
                    elif held:
                        links += compared((node, root, seen, s1, s2, items), held, head, percent)
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return full.repartition("key", "mb", "qb").sortWithinPartitions("key", "mb", "qb", "asks", "node").mapInArrow(lean(run), "a bigint, b bigint")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the ``wanted`` nodes, each once."""
    wanted = staged(wanted.distinct(), "wanted")
    named = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(few(wanted), "node", "left_semi")
    return staged(named, "texts")


def compared(one, held, head: dict, percent: int) -> list[tuple[int, int]]:
    """Links of one node with those held that are not yet known to be connected with it, most alike first; none within a family."""

    def find(x):
        while head.get(x, x) != x:
            x = head[x]
        return x

    node, root, seen, s1, s2, items = one
    marks = np.array([h[3:5] for h in held], np.int64).view(np.uint64)
    mine = np.array([s1, s2], np.int64).view(np.uint64)
    m = matches(marks[:, 0], marks[:, 1], mine[0], mine[1])
    out = []
    for i in np.argsort(-m, kind="stable").tolist():
        if m[i] < ALIKE:
            break
        x, y = find(root), find(held[i][1])
        if x != y and seen != held[i][2] and similar(items, held[i][5], percent):
            head[max(x, y)] = min(x, y)
            out.append((min(node, held[i][0]), max(node, held[i][0])))
    return out


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``: documents are linked if 100 * intersection >= percent * union of
    their shingle sets; component_id is the smallest doc_id that links reach, kept says that it is the row's own.

    A text that is null or has no words has an empty set and is linked with nothing, as is a row without doc_id (component_id null, kept).
    Rows that share a doc_id count as one document. An empty table gives nothing; other columns are not read. doc_id must be an integer."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    marks = staged(signatures(docs, width), "marks")
    able = marks.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(able.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n"), F.first("s1").alias("s1"),
                                                  F.first("s2").alias("s2"), F.first("mins").alias("mins")), "classes")
    nodes = classes.select("node", "s1", "s2", "mins")

    def rooted(some, at):
        """``some`` nodes with their roots and families so far, staged for the levels of a walk."""
        placed = some.join(few(at), "node", "left")
        return staged(placed.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("seen", "node").alias("seen"), "s1", "s2", "mins"), "rooted")

    def settle(pairs, known):
        """The components after those of ``pairs`` that are similar are added."""
        links = confirmed(pairs, texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("node"))), width, percent)
        return joined(known, links)

    pairs, large = first_look(nodes.withColumns({"root": F.col("node"), "seen": F.col("node")}))
    known = settle(pairs, None)
    family = families(large, known, nodes)
    held, named = not family.isEmpty(), None
    if held:
        known = joined(known, staged(second_look(family, places(known), nodes, docs, width, percent), "more"))
        named = staged(family.groupBy("node").agg(F.min("key").alias("seen")), "family")
    pairs, members, deep = turn(rooted(nodes, places(known, named)), range(TREES))
    known = settle(pairs, known)
    if deep is not None and not deep.isEmpty():
        pairs, further, _ = turn(rooted(nodes.join(few(deep), "node", "left_semi"), places(known, named)), range(TREES, TREES + DEEP_TREES))
        members = members.unionByName(further).distinct()
        known = settle(pairs, known)
    if held:
        members = staged(members, "members")
        members = members.unionByName(family.join(few(staged(members.select("key").distinct(), "keys")), "key", "left_semi")).distinct()
    known = joined(known, staged(second_look(members, places(known, named), nodes, docs, width, percent), "more"))
    ends = classes.select("d1", "d2", "node", "_n").join(known, "node", "left").select("d1", "d2", "_n", F.coalesce("root", "node").alias("component_id"))
    linked = skew_join(able.select("doc_id", "n_shingles", "d1", "d2"), staged(ends, "ends"), ["d1", "d2"], marks.count())
    alone = marks.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: one of each group, the one with the smallest doc_id. Repeated rows of that
    doc_id are one row, the one whose columns come first as JSON text; rows without doc_id stay."""
    ids = near_duplicates(docs, width, percent).filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    # only ids that need a look: those that go and those that stand on several rows
    ids = staged(ids.agg(F.count(F.lit(1)).alias("_rows"), F.bool_or("kept").alias("_stays")).filter("_rows > 1 or not _stays"), "ids")
    some, several = few(ids.select("_id")), few(ids.filter("_stays").select("_id"))
    known = docs.filter(docs["doc_id"].isNotNull())
    once = known.join(some, known["doc_id"] == some["_id"], "left_anti")
    again = known.join(several, known["doc_id"] == several["_id"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = again.groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return once.unionByName(again).unionByName(docs.filter(docs["doc_id"].isNull()))
