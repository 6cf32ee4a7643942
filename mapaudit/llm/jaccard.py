"""N-gram Jaccard join by set-relation skipping over block-skip index lists.

Every text becomes the set of its shingle hashes. A set can only link with another one if they share a
shingle of their prefixes, taken in one global order (rare shingles first), so the inverted index holds
prefixes only. Most sets need no index at all: too few of the shingles in a fixed part of the hash space
occur anywhere else. Two relations between sets then replace most of the comparing:

* Lists are cut into blocks of one hub and one band of positions. A block knows the range of its sizes
  and the most shingles that can still follow, so two blocks that cannot reach the overlap are skipped
  without looking at their entries (index-level skipping).
* The smallest set id of a list is its leader. A set found to link with a leader takes it as its hub,
  and the part of it outside the hub is known. The overlap of two sets is at most the overlap of their
  hubs plus both parts outside, so one computed hub pair answers for all pairs of their members, and
  only members that can still reach the threshold are compared (answer-level skipping). Sets that are
  already in one component are not compared at all.

Equal sets collapse first and are never compared. An id with several different texts is one node, but
takes no hub, as the known part of one text says nothing about another. No step pairs up all members of a list or group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapaudit.llm.components import components
from mapaudit.llm.text import U64, chunks, mix, row_edges, shingles
from mapaudit.session import cut


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 5
    percent: int = 80  # links have 100 * intersection >= percent * union
    counted: float = 0.27  # part of the hash space in which shared shingles are counted first
    band: int = 32  # positions in one index block
    broadcast_ids: int = 1_000_000  # id lists up to this many rows are broadcast
    broadcast_shingles: int = 4_000_000  # and lists of shared shingles (8 bytes each)

    @property
    def cut_at(self) -> int:
        return int(self.counted * 2**64)

    def spare(self, n: str) -> str:
        """SQL: how many shingles of a set of ``n`` may be missing from another one that it links with."""
        return f"cast(floor({100 - self.percent} * {n} / 100) as int)"


DEFAULT = JaccardConfig()


def _sets(batches: Iterator[pa.RecordBatch], cfg: JaccardConfig):
    """Of each chunk: its rows, and the distinct shingles with their row, sorted by both."""
    for batch, data, offsets in chunks(batches):
        grams, row = shingles(data, offsets, cfg.words)
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        yield batch, grams[fresh], row[fresh]


def _digests(grams: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two independent 64-bit sums of each row's set."""
    edges = row_edges(row, rows)
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams ^ U64(salt)))]) for salt in (0x1F83D9AB, 0x5BE0CD19137E2179)]
    return np.diff(edges), *(s[edges[1:]] - s[edges[:-1]] for s in sums)


def _first_of_task(seen: set, n: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """True for sets of ``n`` > 0 that this task has not met before."""
    out = np.zeros(len(n), bool)
    for i, key in enumerate(zip(one.tolist(), two.tolist())):
        if n[i] and key not in seen:
            seen.add(key)
            out[i] = True
    return out


def signatures(docs: DataFrame, cfg: JaccardConfig = DEFAULT) -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` of every row, and ``low``: its shingles in the counted part of the hash
    space, where its task has not met the set before (rows without doc_id do not count)."""

    def run(batches):
        seen: set = set()
        for batch, grams, row in _sets(batches, cfg):
            n, one, two = _digests(grams, row, batch.num_rows)
            fresh = _first_of_task(seen, n * pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False), one, two)
            keep = fresh[row] & (grams < U64(cfg.cut_at))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows))])
            low = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(grams[keep].view(np.int64)), mask=pa.array(~fresh))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), low],
                ["doc_id", "n_shingles", "d1", "d2", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, low array<long>")


def _small(ids: DataFrame, most: int) -> DataFrame:
    """A stored table, broadcast only when counted small."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _promising(marks: DataFrame, copies: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """``doc_id, d1`` of the sets that may link with another one. A set that links misses few of its shingles in
    the other one, so all but that many of its counted ones must occur in some other set."""
    sets = marks.where("low is not null and doc_id is not null")
    nodes = sets.join(_small(copies, cfg.broadcast_ids), _copied(sets, copies), "left")
    nodes = nodes.select("doc_id", F.coalesce("rep", "doc_id").alias("node"), F.explode("low").alias("shingle"))
    shared = nodes.groupBy("shingle").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("shingle")
    shared = _small(cut(shared, "shared"), cfg.broadcast_shingles)
    met = nodes.join(shared, "shingle").groupBy("doc_id").agg(F.count("*").alias("met"))
    needed = F.size("low") - F.expr(cfg.spare("n_shingles"))
    return sets.select("doc_id", "d1", needed.alias("needed")).join(met, "doc_id", "left").where("coalesce(met, 0) >= needed").select("doc_id", "d1").distinct()


def _copied(sets: DataFrame, copies: DataFrame) -> Column:
    return (sets["doc_id"] == copies["doc"]) & (sets["d1"] == copies["mark"])


def _pick(docs: DataFrame, ids: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Sets ``doc, n, mark, grams`` of the rows whose id is listed; ``mark`` tells texts of one id apart."""

    def run(batches):
        for batch, grams, row in _sets(batches, cfg):
            n, one, _ = _digests(grams, row, batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(row_edges(row, batch.num_rows).astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(one.view(np.int64)), lists],
                                             ["doc", "n", "mark", "grams"])

    rows = docs.select("doc_id", "text").join(_small(ids, cfg.broadcast_ids), "doc_id", "left_semi")
    return rows.mapInArrow(run, "doc long, n int, mark long, grams array<long>").where("n > 0")


def _entries(sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Index entries ``shingle, doc, n, pos``: each set's prefix in the order of rising document counts.
    Shingles of one set only come first and make no entry, so many sets have none."""
    grams = sets.select("doc", "n", "mark", F.explode("grams").alias("shingle"))
    counts = grams.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    lists = (grams.join(counts, "shingle").groupBy("doc", "n", "mark")
             .agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("common")))
    alone = F.greatest(F.col("n") - F.size("common"), F.lit(0))
    lists = lists.withColumn("alone", alone).withColumn("take", F.expr(f"{cfg.spare('n')} + 1 - alone")).where("take > 0")
    return (lists.select("doc", "n", "alone", F.posexplode(F.slice("common", F.lit(1), F.col("take"))).alias("at", "entry"))
            .select("entry.shingle", "doc", "n", (F.col("alone") + F.col("at")).alias("pos")))


def _overlaps(pairs: DataFrame, sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """``a, b, na, nb, both`` for every pair (a, b) of ids, by comparing the whole sets."""
    pairs = pairs.select("a", "b").distinct()
    sides = (pairs.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), "a")
             .join(sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b")
             .select("a", "b", "na", "nb", "ga", "gb"))

    def run(batches):
        for batch in batches:
            (x, xs), (y, ys) = ((np.asarray(c.flatten()), np.asarray(c.offsets) - c.offsets[0].as_py()) for c in (batch.column("ga"), batch.column("gb")))
            both = [len(np.intersect1d(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], assume_unique=True)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(both, pa.int32())],
                                             ["a", "b", "na", "nb", "both"])

    return cut(sides.mapInArrow(run, "a long, b long, na int, nb int, both int"), "overlaps")


def _reach(both: str, sizes: str, cfg: JaccardConfig) -> str:
    """SQL: an overlap of ``both`` is enough for two sets of together ``sizes`` shingles."""
    return f"{100 + cfg.percent} * ({both}) >= {cfg.percent} * ({sizes})"


def jaccard_components(docs: DataFrame, cfg: JaccardConfig = DEFAULT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    component_id is the smallest doc_id reachable over links. A null or wordless text has no shingles
    and links with nothing, not even another empty one: its component is itself. Rows that share a
    doc_id are one node, linked with whatever any of their texts is linked with; repeated rows stay.
    A row without doc_id takes no part in links and has a null component. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    marks = cut(signatures(docs, cfg), "signatures")
    key = ["n_shingles", "d1", "d2"]
    full = marks.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    groups = cut(classes.where("copies > 1").drop("copies"), "groups")
    copies = full.where("low is not null").join(groups, key).where("rep <> doc_id")
    copies = cut(copies.select(F.col("doc_id").alias("doc"), F.col("d1").alias("mark"), "rep").distinct(), "copies")
    several = cut(full.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x < y").select("doc_id"), "several")
    same = full.join(_small(several, cfg.broadcast_ids), "doc_id").join(groups, key).where("rep <> doc_id")
    same = cut(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same")
    chosen = _promising(marks, copies, cfg)
    chosen = chosen.join(copies, _copied(chosen, copies), "left")
    chosen = cut(chosen.select(F.coalesce("rep", "doc_id").alias("doc_id")).distinct(), "chosen")
    sets = cut(_pick(docs, chosen, cfg), "sets")
    entries = cut(_entries(sets, cfg), "entries")

    # Each set against the leader of its lists.
    leaders = (entries.groupBy("shingle").agg(F.min(F.struct("doc", "n", "pos")).alias("lead"), F.max("doc").alias("last"))
               .where("lead.doc < last").drop("last"))
    near = (entries.join(leaders, "shingle").where("doc <> lead.doc")
            .where(_reach("least(n - pos, lead.n - lead.pos)", "n + lead.n", cfg))
            .select(F.col("doc").alias("a"), F.col("lead.doc").alias("b")))
    linked = _reach("both", "na + nb", cfg)
    first = _overlaps(near, sets, cfg).where(linked)
    found = first.select("a", "b").unionByName(same)
    labels = components(found)

    # Sets of one list in different components: hub against hub, block by block.
    hubs = (first.groupBy(F.col("a").alias("doc"))
            .agg(F.max(F.struct((F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("like"),
                                (-F.col("b")).alias("less"), (F.col("na") - F.col("both")).alias("out"))).alias("best"))
            .select("doc", (-F.col("best.less")).alias("hub"), F.col("best.out").alias("out"))
            .join(several.withColumnRenamed("doc_id", "doc"), "doc", "left_anti"))
    placed = (entries.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").join(hubs, "doc", "left")
              .select("shingle", "doc", "n", "pos", F.coalesce("label", "doc").alias("comp"),
                      F.coalesce("hub", "doc").alias("hub"), F.coalesce("out", F.lit(0)).alias("out")))
    placed = cut(placed, "placed")
    mixed = placed.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("shingle")
    blocks = (placed.join(mixed, "shingle").groupBy("shingle", "comp", "hub", F.floor(F.col("pos") / cfg.band).alias("band"))
              .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest")))
    blocks = cut(blocks, "blocks")
    one, two = (blocks.select("shingle", *(F.col(c).alias(f"{c}{i}") for c in ("comp", "hub", "low", "high", "rest"))) for i in (1, 2))
    meet = (one.join(two, "shingle").where("hub1 < hub2 and comp1 <> comp2")
            .where(f"100 * high1 >= {cfg.percent} * low2 and 100 * high2 >= {cfg.percent} * low1")
            .where(_reach("least(rest1, rest2)", "low1 + low2", cfg))
            .select(F.col("hub1").alias("a"), F.col("hub2").alias("b")))
    hub_pairs = _overlaps(meet, sets, cfg)
    links = found.unionByName(hub_pairs.where(linked).select("a", "b"))
    labels = components(links)

    # Members of hubs whose overlap leaves a link possible.
    members = cut(placed.groupBy("hub", "doc", "n", "out").agg(F.max(F.col("n") - F.col("pos")).alias("rest")), "members")
    ranges = members.groupBy("hub").agg(F.min("n").alias("least_n"), F.max("out").alias("most_out"))
    sides = [ranges.select(F.col("hub").alias(x), F.col("least_n").alias(f"least_{x}"), F.col("most_out").alias(f"most_{x}")) for x in "ab"]
    names = [labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab"]
    still = (hub_pairs.join(sides[0], "a").join(sides[1], "b").join(names[0], "a", "left").join(names[1], "b", "left")
             .where("coalesce(label_a, a) <> coalesce(label_b, b)")
             .where(_reach("both + most_a + most_b", "least_a + least_b", cfg)))
    still = cut(still.select("a", "b", "both", "least_b", "most_b"), "still")
    if still.limit(1).count():
        left = members.select(F.col("hub").alias("a"), F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("out").alias("ox"), F.col("rest").alias("rx"))
        right = members.select(F.col("hub").alias("b"), F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("out").alias("oy"), F.col("rest").alias("ry"))
        more = (still.join(left, "a").where(_reach("both + ox + most_b", "nx + least_b", cfg)).join(right, "b")
                .where(_reach("least(both + ox + oy, rx, ry)", "nx + ny", cfg))
                .where(f"100 * least(nx, ny) >= {cfg.percent} * greatest(nx, ny) and (x <> a or y <> b)")
                .select(F.col("x").alias("a"), F.col("y").alias("b")))
        links = links.unionByName(_overlaps(more, sets, cfg).where(linked).select("a", "b"))
        labels = components(links)

    return (marks.drop("low").join(groups, key, "left").withColumn("rep", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id"))
            .join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).alias("component_id")))


def keep_one(docs: DataFrame, cfg: JaccardConfig = DEFAULT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with all columns; of repeated
    rows (same doc_id and text) one. Rows without doc_id stay. Texts are not shuffled while the ids to
    remove are counted few."""
    found = cut(jaccard_components(docs, cfg), "components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    again = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1").select("again_id")

    gone, again = cut(gone, "gone"), cut(again, "again")
    repeated = again.limit(1).count()
    gone, again = _small(gone, cfg.broadcast_ids), _small(again, cfg.broadcast_ids)
    rest = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    if not repeated:
        return rest
    same = rest["doc_id"] == again["again_id"]
    return rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
