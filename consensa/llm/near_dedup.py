"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its five-word shingles; documents with equal sets are one class from the start.
TREES independent trees branch the classes by minwise tokens.  The root of each has a coordinate of the
minwise signature of its own; at a node below, one coordinate is chosen, with a chance of 1 / similarity - 1
a second one (so that a pair as similar as the limit goes down together on average).  A class goes to the
child of the token that its signature has there.

Only components are asked for, so a node is done as soon as its classes are in one component:

* a node of at most SMALL classes and SETS shingles is compared exhaustively, between components;
* of the larger ones those of the first FIRST trees are dealt out in chunks of that size, each compared exhaustively;
* one that still holds classes of different components after that is compared whole, as blocks of those outside its
  largest component against all of it, if that makes no more than BLOCKS blocks; otherwise its classes branch on.

Branching ends for certain: if it does not halve the rows of such nodes, they are compared in blocks however many.  What one
node has compared is known in the nodes of other trees, which compare the rest.

No pairs are passed on.  A group (a node, chunk or block) gives its members that have a candidate beside them, one row each,
under the name of their connected set, so that the same set from several trees is confirmed once; confirming it finds the
candidates again, and gives links that span each component.  A candidate is a pair whose signatures (the low byte of each
token, which is all that travels) agree in as many coordinates as a pair of the asked similarity does but less than once in a million times.  A pair as similar as
the limit shares its first token in one of TREES trees but for a chance of (1 - similarity) ** TREES.  Below a branching
node it is lost the likelier the more levels follow, so the node branches several times independently: as often as
holds the chance that all trees miss such a pair at MISS, with the spread of its signatures' agreement.

Defined cases: null text and texts without words have an empty set and are linked with nothing; texts with
fewer words than a shingle have their whole word sequence as one; repeated rows and ties are in one class; a
null id never is a component's least id while there is another; an empty table gives an empty result; other
columns are kept (the results' own names are replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from consensa.llm.common import SHINGLE, Words, chunks, freed, narrowed, read, sequence_hash, text_buffers, text_or_empty, written

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
TREES = 12
#: Chance that a pair as similar as the limit, whose nodes all are large, is in no small node together.
MISS = 1e-3
#: Levels in one go for which the repeats are worked out (0.85 ** -64 is 33,000 times SMALL classes).
LEVELS = 64
SIGNATURE = 128
SMALL = 1024
#: Shingles of a node that is compared in one place.
SETS = 4_000_000
#: Trees whose large nodes are dealt out in chunks at once; the others mostly find them in one component then.
FIRST = 2
#: Blocks (SMALL classes against SMALL) of a node that is compared whole rather than branched.
BLOCKS = 1024
#: Parts over which the rows of one node are split where they get the node's size.
SALTS = 8
#: Of the signature, how far below PERCENT the agreement may be: five standard deviations.
SLACK = 5.0
_A = np.random.default_rng(11).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    w = Words(buf, offsets)
    hashes, _ = w.windows(SHINGLE)
    first = w.first.tolist()
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(hashes[lo:hi - SHINGLE + 1])
        elif hi > lo:
            yield np.array([sequence_hash(w.hash[lo:hi])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SIGNATURE minwise tokens (32 bits each)."""
    low = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at:at + 4096, None] * _A + _B).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _described(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        buf, off = text_buffers(batch.column(2))
        for i, j in chunks(np.diff(off)):
            n, cls, sig, low = [], [], [], []
            for s in shingle_sets(buf, off[i:j + 1]):
                tokens = signature(s) if len(s) else None
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else None)
                sig.append(tokens.tobytes() if len(s) else None)
                low.append(tokens.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, j - i) for k in (0, 1, 3)), pa.array(n, pa.int64()),
                 pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())],
                names=["k1", "k2", "key", "n_shingles", "cls", "sig", "low"])


def _class_of(shingles: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sets(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        buf, off = text_buffers(batch.column(0))
        for i, j in chunks(np.diff(off)):
            sets = list(shingle_sets(buf, off[i:j + 1]))
            yield pa.RecordBatch.from_arrays([pa.array([_class_of(x) for x in sets], pa.binary()),
                                              pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "set"])


class Union:
    """Disjoint sets of 0 to n - 1; a set's root is its least number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x


def _candidates(least: float):
    """The members of each group that have a candidate of another component beside them: their connected set and class."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            name, cls = [], []
            for row in range(batch.num_rows):
                own = sorted((x["cls"], x["comp"], x["known"] or x["comp"], not x["probe"], x["low"]) for x in batch.column(1)[row].as_py())
                sig = np.frombuffer(b"".join(x[4] for x in own), np.uint8).reshape(-1, SIGNATURE)
                comp, known = (np.unique([x[i] for x in own], return_inverse=True)[1] for i in (1, 2))
                sets = Union(len(own))
                for i in range(len(own)):
                    if i and own[i][0] == own[i - 1][0]:  # a probe, and again among all
                        sets.join(i, i - 1)
                    if own[i][3]:
                        continue
                    other = np.flatnonzero((comp != comp[i]) & (known != known[i]))
                    for j in other[(sig[other] == sig[i]).mean(1) >= least].tolist():
                        sets.join(i, j)
                of: dict[int, set] = {}
                for i in range(len(own)):
                    of.setdefault(sets.find(i), set()).add(own[i][0])
                for members in of.values():
                    if len(members) > 1:
                        members = sorted(members)
                        name += [xxhash.xxh3_128_digest(b"".join(members))] * len(members)
                        cls += members
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (name, cls)], names=["set_id", "cls"])
    return run


def _confirmed(percent: int, least: float):
    """Of each connected set of candidates the links that span its components."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                own = sorted(((x["cls"], x["comp"], x["low"], np.frombuffer(x["set"], np.uint64)) for x in batch.column(0)[row].as_py()),
                             key=lambda x: x[0])
                sig = np.frombuffer(b"".join(x[2] for x in own), np.uint8).reshape(-1, SIGNATURE)
                size = np.array([len(x[3]) for x in own])
                number = np.unique(np.concatenate([x[3] for x in own]), return_inverse=True)[1]
                ids = np.split(number, np.cumsum(size)[:-1])
                sets, first, has = Union(len(own)), {}, np.zeros(len(number), bool)
                for i, x in enumerate(own):  # what is linked already
                    sets.join(first.setdefault(x[1], i), i)
                for i in range(len(own)):
                    root = np.array([sets.find(j) for j in range(i + 1, len(own))])
                    fits = 100 * np.minimum(size[i], size[i + 1:]) >= percent * np.maximum(size[i], size[i + 1:])
                    other = i + 1 + np.flatnonzero(fits & (root != sets.find(i)))
                    other = other[(sig[other] == sig[i]).mean(1) >= least] if len(other) else other
                    if not len(other):
                        continue
                    has[ids[i]] = True
                    both = np.add.reduceat(has[np.concatenate([ids[j] for j in other])].astype(np.int64), np.cumsum([0, *size[other][:-1]]))
                    has[ids[i]] = False
                    for j in other[100 * both >= percent * (size[i] + size[other] - both)].tolist():
                        if sets.find(i) != sets.find(j):
                            sets.join(i, j)
                            a.append(own[i][0]), b.append(own[j][0])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (a, b)], names=["a", "b"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node of its component) for every node of ``edges`` (a, b), by alternating large-star
    and small-star rounds.  A node's least neighbour is found by a partial aggregate and joined back, so a hub's edges
    are never together in one task."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, written(small, "edges")
        freed(before)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _token(sig: Column, at: Column) -> Column:
    """The minwise token (4 bytes) at a coordinate."""
    return F.substr(sig, at * 4 + 1, F.lit(4))


def _children(path: Column, sig: Column, percent: int) -> Column:
    """Paths (array) of the children of a node that a class of this signature goes to."""
    coordinate = lambda name: F.pmod(F.xxhash64(F.lit(name), path), F.lit(SIGNATURE)).cast("int")
    two = F.pmod(F.xxhash64(F.lit("two"), path), F.lit(10_000)) < F.lit(int(1e4 * (100 / percent - 1)))
    first, second = coordinate("first"), coordinate("second")
    chosen = F.when(two & (first != second), F.array(first, second)).otherwise(F.array(first))
    return F.transform(chosen, lambda at: F.xxhash64(path, at, _token(sig, at)))


def repeats(percent: int, trees: int, rounds: int) -> list[int]:
    """How often a large node branches, by its levels (1 to LEVELS), that a pair as similar as the limit gets lost in all trees
    with a chance of MISS at most.  Its signatures agree in a binomial number of coordinates; a pair goes down one level as a
    branching process.  A node that is large again after ``rounds`` rounds has a smaller share of what may be lost."""
    s, d = min(percent / 100, 0.999), SIGNATURE
    agree = np.arange(d + 1) / d
    weight = np.array([math.comb(d, k) * s ** k * (1 - s) ** (d - k) for k in range(d + 1)])
    power = 4 / 3 * 4 ** rounds  # the shares 1 / power of all rounds sum to one
    two, lost, out, most = (1 / s - 1) * (d - 1) / d, np.zeros(d + 1), [], 1
    for _ in range(LEVELS):
        one = 1 - agree + agree * lost
        lost = (1 - two) * one + two * one * one
        missed = lambda n: weight @ (1 - agree * (1 - lost ** n) ** power) ** trees  # noqa: B023, E731
        least = most
        while missed(most) > MISS:
            least, most = most + 1, 2 * most
        while least < most:
            middle = (least + most) // 2
            least, most = (middle + 1, most) if missed(middle) > MISS else (least, middle)
        out.append(most)
    return out


def link(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_shingles, component_id (the least key of those linked), kept (it is the row's own key) and stays
    (true for exactly one row of every component, also if rows repeat, and for all rows without words)."""
    t = text_or_empty(text)
    names = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept", "stays")]
    row = [F.xxhash64(t).alias("__k1"), F.xxhash64(F.lit(1), F.col(key), t).alias("__k2")]
    source = docs.select(*[F.col(f"`{c}`") for c in names], *row)
    texts = docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), F.col(key), t).alias("k2"), t.alias("text"),
                        F.col(key).alias("key"))
    key_type = docs.schema[key].dataType.simpleString()
    known = written(texts.mapInArrow(
        _described, f"k1 long, k2 long, key {key_type}, n_shingles long, cls binary, sig binary, low binary"), "sets")
    classes = written(known.where("cls is not null").groupBy("cls").agg(
        F.min("key").alias("key"), F.min(F.struct(F.col("key").isNull(), "key", "k1", "k2")).alias("row"),
        F.min("sig").alias("sig"), F.min("low").alias("low"), F.min("n_shingles").alias("n_shingles")).withColumn("row", F.struct("row.k1", "row.k2")), "classes")
    whole, known = known, written(known.select("k1", "k2", "n_shingles", "cls"), "rows")
    freed(whole)
    labels, used = joined(texts.drop("key"), classes, percent)
    members = classes.select("cls", "key", "row").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "key", "row", F.coalesce("comp", "cls").alias("comp"))
    least = members.groupBy("comp").agg(F.min("key").alias("component_id"), F.min(F.struct(
        F.col("key").isNull(), "key", "row")).alias("first"))
    of_class = members.join(least, "comp").select("cls", "component_id", F.col("first.row").alias("first"))
    one_each = written(known.join(of_class, "cls", "left").groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
        F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component_id"),
        F.first(F.col("first").isNull() | (F.col("first") == F.struct("k1", "k2"))).alias("__first"),
        F.first(F.col("first").isNull()).alias("__alone")), "linked")
    freed(known, classes, *used)
    out = source.join(one_each, ["__k1", "__k2"], "left")
    repeat = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy(F.lit(1)))  # as the join has dealt the rows
    return out.select(
        *[F.col(f"`{c}`") for c in names], "n_shingles", F.coalesce("component_id", F.col(f"`{key}`")).alias("component_id"),
        F.coalesce("component_id", F.col(f"`{key}`")).eqNullSafe(F.col(f"`{key}`")).alias("kept"),
        (F.col("__first") & (F.col("__alone") | (repeat == 1))).alias("stays"))


def joined(texts: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """node (a class) and comp of every class that is linked with another, and what was written of any size for them."""
    least = max(0.0, percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / SIGNATURE) ** 0.5)
    signatures = classes.select("cls", "sig", "n_shingles")
    # more of them where so many could not hold MISS
    trees = min(SIGNATURE, max(TREES, math.ceil(math.log(MISS / 4) / math.log(1 - min(percent / 100, 0.999)))))
    roots = signatures.select("cls", "sig", "n_shingles", F.explode(F.array([F.lit(i) for i in range(trees)])).alias("tree"))
    sized = written(_sized(roots.select("tree", F.xxhash64("tree", _token(F.col("sig"), F.col("tree"))).alias("path"), "cls", "n_shingles")),
                    "nodes")
    rows = sized.withColumn("comp", F.col("cls")).withColumn("known", F.lit(None).cast("binary"))
    is_large = (F.col("n") > SMALL) | (F.col("shingles") > SETS)
    state = Comparison(texts, classes, percent, least)
    state.compare(_chunks(rows.where(~is_large | (F.col("tree") < FIRST))))
    large = _unsettled(rows.where(is_large), state.comps, None)
    known, before, branched = None, None, 0
    while True:
        large = written(large, "large-nodes")
        nodes = _judged(large)
        per_tree = nodes.where(F.col("blocks") <= BLOCKS).groupBy("tree").agg(F.sum("blocks").alias("blocks")).orderBy("tree").collect()
        total = large.count()
        if not total:
            return state.comps, [sized, *state.written]
        forced = branched > 0 and before is not None and 2 * total > before
        if forced or per_tree:
            trees_now, sum_ = [], 0
            for r in per_tree:  # a row for each tree
                sum_ += r["blocks"]
                if not trees_now or sum_ <= BLOCKS:
                    trees_now.append(r["tree"])
            whole = nodes if forced else nodes.where(F.col("tree").isin(trees_now) & (F.col("blocks") <= BLOCKS))
            blocks = written(_by_path(large.drop("n", "shingles", "tree"), whole), "whole-nodes")
            state.compare(_blocks(blocks))
            if not forced and trees_now[0] >= 0:  # the nodes of one tree have no class in common, so a class has one name here
                new = blocks.where(F.col("tree") == trees_now[0]).select("cls", F.unhex(F.hex("path")).alias("known"))
                known = new if known is None else known.unionByName(new.join(known, "cls", "left_anti"))
                known = written(known, "compared")
            done = large.join(whole.select("path"), "path", "left_anti")
            large = _unsettled(done, state.comps, known)
        else:
            over = F.greatest(F.col("n") / SMALL, F.col("shingles") / SETS)
            # so many levels that a node of classes as similar as the limit, which lose the least at each, becomes small
            levels = F.greatest(F.lit(1), F.ceil(F.log(over) / -math.log(percent / 100))).cast("int")
            down = _branched(large.withColumn("levels", levels).join(signatures.select("cls", "sig"), "cls"), percent, trees, branched)
            below = written(_sized(down.join(signatures.select("cls", "n_shingles"), "cls").withColumn("tree", F.lit(-1))), "nodes")
            below = _unsettled(below, state.comps, known)
            state.compare(_chunks(below.where(~is_large)))
            before, branched = total, branched + 1
            large = _unsettled(below.where(is_large), state.comps, known)


class Comparison:
    """What has been compared so far: the links found and the components (node, comp) that they make."""

    def __init__(self, texts: DataFrame, classes: DataFrame, percent: int, least: float):
        self.texts, self.classes, self.percent, self.least = texts, classes, percent, least
        self.sets = self.edges = self.confirmed = None
        self.written: list[DataFrame] = []  # shingles, which no one reads at the end
        self.comps = classes.select(F.col("cls").alias("node"), F.col("cls").alias("comp")).limit(0)

    def compare(self, dealt: DataFrame) -> None:
        """Compare the groups of ``dealt`` (g, cls, comp, known, probe): the probes with all of their group."""
        groups = dealt.join(self.classes.select("cls", "low"), "cls").groupBy("g").agg(  # of bounded size
            F.collect_list(F.struct("cls", "comp", "known", "probe", "low")).alias("l"))
        members = groups.mapInArrow(_candidates(self.least), "set_id binary, cls binary").dropDuplicates(["set_id", "cls"])
        if self.confirmed is not None:
            members = members.join(self.confirmed, "set_id", "left_anti")
        members = written(members, "candidates")
        new = members.select("set_id").distinct()
        self.confirmed = new if self.confirmed is None else self.confirmed.unionByName(new)
        wanted = self.classes.join(members.select("cls").distinct(), "cls", "left_semi")
        wanted = wanted if self.sets is None else wanted.join(self.sets.select("cls"), "cls", "left_anti")
        wanted = written(wanted.select("row.k1", "row.k2"), "wanted")  # so that few of them are sent to the texts instead
        asked = narrowed(self.texts, wanted, ["k1", "k2"]).join(wanted, ["k1", "k2"]).select("text")
        sets = written(asked.mapInArrow(
            _sets, "cls binary, set binary").dropDuplicates(["cls"]).join(self.classes.select("cls", "low"), "cls"), "shingles")
        self.written.append(sets)
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        labelled = members.join(self.comps.withColumnRenamed("node", "cls"), "cls", "left")
        given = labelled.join(self.sets, "cls").groupBy("set_id").agg(
            F.collect_list(F.struct("cls", F.coalesce("comp", "cls").alias("comp"), "low", "set")).alias("l"))
        links = written(given.select("l").mapInArrow(_confirmed(self.percent, self.least), "a binary, b binary"), "links")
        if links.limit(1).count():
            self.edges = links if self.edges is None else self.edges.unionByName(links)
            self.comps = components(self.edges)


def _by_path(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with what ``nodes`` has for their path; a node's rows are split over SALTS tasks."""
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(salted, ["path", "salt"]).drop("salt")


def _parts(n: Column, shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / SMALL), F.ceil(shingles / SETS))


def _chunks(rows: DataFrame) -> DataFrame:
    """Groups of nodes, the large ones dealt out in chunks; all are probes."""
    parts = _parts(F.col("n"), F.col("shingles"))
    group = F.when(parts == 1, F.col("path")).otherwise(F.xxhash64("path", F.pmod(F.xxhash64("cls", "path"), parts)))
    return rows.select(group.alias("g"), "cls", "comp", "known", F.lit(True).alias("probe"))


def _judged(large: DataFrame) -> DataFrame:
    """Nodes with their classes and shingles, the largest part that is known within itself, and the blocks that comparing
    the others (probes) with all of the node takes."""
    key = F.coalesce("known", "comp").alias("key")
    by_key = large.select("path", "tree", "cls", "n", "shingles", key).groupBy("path", "key").agg(
        F.count(F.lit(1)).alias("k"), F.min("tree").alias("tree"), F.first("n").alias("n_then"), F.first("shingles").alias("s_then"))
    nodes = by_key.groupBy("path").agg(F.min("tree").alias("tree"), F.sum("k").alias("n"), F.max(F.struct("k", "key")).alias("most"),
                                       F.first("n_then").alias("n_then"), F.first("s_then").alias("s_then"))
    shingles = F.ceil(F.col("s_then") * F.col("n") / F.col("n_then"))
    nodes = nodes.select("path", "tree", "n", shingles.alias("shingles"), F.col("most.key").alias("main"), F.col("most.k").alias("k"))
    share = (F.col("n") - F.col("k")) / F.col("n")
    nodes = nodes.withColumn("probe_parts", _parts(F.col("n") - F.col("k"), F.col("shingles") * share)).withColumn(
        "all_parts", _parts(F.col("n"), F.col("shingles")))
    return nodes.withColumn("blocks", F.col("probe_parts") * F.col("all_parts"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Groups of a chunk of the classes outside the node's main part and a chunk of all its classes."""
    name = lambda i, j: F.xxhash64(F.lit("block"), "path", i, j).alias("g")
    own = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "cls"), parts)
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    kept = ["cls", "comp", "known", "path", "probe_parts", "all_parts"]
    probes = rows.where(~F.coalesce("known", "comp").eqNullSafe(F.col("main"))).select(*kept, each(F.col("all_parts")).alias("j")).select(
        name(own("probe", F.col("probe_parts")), F.col("j")), "cls", "comp", "known", F.lit(True).alias("probe"))
    others = rows.select(*kept, each(F.col("probe_parts")).alias("i")).select(
        name(F.col("i"), own("all", F.col("all_parts"))), "cls", "comp", "known", F.lit(False).alias("probe"))
    return probes.unionByName(others)


def _branched(large: DataFrame, percent: int, trees: int, rounds: int) -> DataFrame:
    """path and cls of the nodes ``levels`` levels below those of ``large`` (path, cls, sig, levels)."""
    often = F.element_at(F.array([F.lit(n) for n in repeats(percent, trees, rounds)]), F.least("levels", F.lit(LEVELS)))
    again = large.select("cls", "sig", "levels", "path", F.explode(F.sequence(F.lit(1), often)).alias("again")).withColumn(
        "path", F.xxhash64("path", "again"))
    below = F.aggregate(F.sequence(F.lit(1), F.col("levels")), F.array("path"), lambda paths, _: F.flatten(
        F.transform(paths, lambda p: _children(p, F.col("sig"), percent))))
    return again.select(F.explode(below).alias("path"), "cls")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with more than one class, with the node's classes and shingles."""
    rows = rows.dropDuplicates(["path", "cls"])
    size = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    return _by_path(rows.drop("n_shingles"), size)


def _unsettled(rows: DataFrame, comps: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows of the nodes that hold classes of different components which no node has compared whole (``known``)."""
    labelled = rows.drop("comp", "known").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls"))
    labelled = labelled.withColumn("known", F.lit(None).cast("binary")) if known is None else labelled.join(known, "cls", "left")
    key = F.coalesce("known", "comp")
    open_ = labelled.groupBy("path").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min(key).alias("u"), F.max(key).alias("v"))
    return _by_path(labelled, open_.where("x <> y and u <> v").select("path"))


def q_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op8_near_dedup": q_near_dedup}
ORACLE: dict[str, str] = {}
