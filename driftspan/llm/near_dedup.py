"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each text's distinct word shingles are hashed once; the k smallest hashes are its sketch.
   Texts with equal shingle sets become one class, so copies cost one row from here on.
2. Inverted lists of retained values generate overlaps. Linked sketches share LEAST values at
   least (all but a fifth, if the sketch is the whole set), so a class is listed only under its
   rarest values: so many that any such partner is listed under one of them too. Values that no
   other class retains count, but have no list; most classes have none but these.
3. Members of a short list are paired with each other. Members of a long list are paired with a
   hub of it, in HUB_TURNS turns; from the second on the hub is of the list's largest component
   and only members outside it are paired. So a group of near copies costs its size, not its square.
4. Members outside, and all in whose lists they are, are then compared by whole sets: each is
   listed under its rarest shingles among these classes, so many that any partner is listed
   under one of them too, by size. Two meet only where the shingles left from there on can still
   reach the threshold, and only if their components differ. This step loses no link.
5. The union sketch of a pair estimates its similarity; pairs far below the threshold go.
6. The exact Jaccard coefficient of the full sets confirms each link.
7. Links are contracted to components with tables in the shared folder; nothing is collected.

What a link can be lost by: of the union's 64 smallest values a linked pair shares each with
probability 0.8 at least, and LEAST of them or the pair is lost: that fails once in 30 million
(in the sets of over 51 shingles; smaller ones are compared whole). Shingles are compared by
64-bit hashes from random tables, so two shingles of a pair are confused once in 2**64.

Defined cases: null text and text without words have an empty set, linked with nothing; texts
of fewer words than a shingle have one shingle, their whole sequence; a row with a null id is
linked to its equals but represents none that have an id; rows that repeat an id are one
document, linked by any of its texts; a very long text is one set; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import FOLD, SPACE_BYTES, Scratch, byte_class, frugal, gram_hashes, keep_rows, mix, read_table, text_slices, word_hashes, word_spans

SHINGLE = 5
#: The contract's query takes shorter shingles.
CONTRACT_SHINGLE = 4
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Values of a sketch.
SKETCH = 64
#: Of the union's smallest values so many are shared by a linked pair at least; a linked partner of a set of up to WHOLE shingles has a whole sketch, too.
LEAST = 33
WHOLE = SKETCH * PERCENT // 100
#: Members of a list that are paired with each other; a longer list has hubs.
SHORT_LIST = 16
HUB_TURNS = 3
#: Sets are listed by size, in steps of this ratio.
SIZE_STEP = 1.05
#: Estimates this far below the threshold are believed (six standard deviations).
MARGIN = 0.3
#: Links that one union-find of components() holds.
LINKS_TOGETHER = 400_000
#: Ids that are broadcast at most, to read the texts of pairs without a shuffle of all texts.
BROADCAST_IDS = 500_000
_WORD = ~byte_class(SPACE_BYTES)
_FOLD = np.frombuffer(FOLD, np.uint8)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending (as signed 64-bit)."""
    for lo, hi, data, off in text_slices(texts):
        starts, ends, rows = word_spans(data, off, _WORD)
        words = word_hashes(data, starts, ends, _FOLD)
        grams = gram_hashes(words, size)
        at = np.searchsorted(rows, np.arange(hi - lo + 1))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1].view(np.int64))
            elif b > a:
                yield mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def text_key(text: Column) -> Column:
    """Tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, digest, sketch) of every row; text_key is a hash of the text as it is."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch = [], [], []
            for s in shingle_sets(batch.column(2), size):
                n.append(len(s))
                digest.append(set_digest(s))
                sketch.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _long_lists(sketch)], ["id", "text_key", "n", "digest", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    return rows.mapInArrow(frugal(run), f"id {kind}, text_key long, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, items) of the documents in ids (one column, id); ids is a stored table."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = ids.select(F.col("id").alias("wanted"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(wanted, F.col("id") == F.col("wanted"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_digest(s) for s in sets], pa.binary()), _long_lists(sets)], ["id", "digest", "items"])

    return rows.mapInArrow(frugal(run), f"id {kind}, digest binary, items array<long>")


def similar_sizes(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def estimate_passes(a: Column, b: Column) -> Column:
    """Whether the bottom k values of the union of two sketches leave the threshold possible."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return both >= F.size(union) * F.lit(PERCENT / 100 - MARGIN)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the same nodes, each node's with the smallest of those it is known to be connected with."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars(kind: pa.DataType) -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], kind), pa.array(nodes, kind)], ["a", "b"])
        parent.clear()
        return out

    seen, kind = 0, None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= LINKS_TOGETHER:
            yield stars(kind)
            seen = 0
    if seen:
        yield stars(kind)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame | None:
    """(node, comp) of every node of edges (a, b): the smallest node that it is connected with. None without edges.

    Links are first thinned out where they lie, by union-find over so many at a time. While more
    are left than one union-find holds, every node that has a smaller neighbour is contracted into
    its smallest one; the pointers, which always descend, are followed to their ends by doubling,
    and the links between the ends are thinned out again. A hub's links are one key of partial
    aggregates, and one side of joins between stored tables that Spark can split. What one
    union-find holds (a bounded number of links) it finishes.
    """
    schema = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in "ab")
    ordered = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.save(ordered(edges).mapInArrow(frugal(_forest), schema))
    found: DataFrame | None = None
    while (left := edges.count()) > LINKS_TOGETHER:
        down = scratch.save(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")))
        while True:
            up = down.select(F.col("node").alias("via"), F.col("comp").alias("end"))
            down = scratch.save(down.join(up, F.col("comp") == F.col("via"), "left").select("node", F.coalesce("end", "comp").alias("comp"), F.col("end").isNotNull().alias("moved")))
            if down.where("moved").isEmpty():
                break
            down = down.drop("moved")
        down = down.select("node", "comp")
        found = down if found is None else scratch.save(_moved(found, down))
        ends = down.select(F.col("node").alias("via"), F.col("comp").alias("end"))
        rest = edges.join(ends, F.col("a") == F.col("via"), "left").select(F.coalesce("end", "a").alias("a"), "b")
        rest = rest.join(ends, F.col("b") == F.col("via"), "left").select("a", F.coalesce("end", "b").alias("b"))
        edges = scratch.save(ordered(rest).distinct().mapInArrow(frugal(_forest), schema))
    if left:
        last = scratch.save(edges.coalesce(1).mapInArrow(frugal(_forest), schema).select(F.col("b").alias("node"), F.col("a").alias("comp")))
        found = last if found is None else _moved(found, last)
    if found is None:
        return None
    roots = found.select(F.col("comp").alias("node")).distinct().withColumn("comp", F.col("node"))
    return scratch.save(found.unionByName(roots))


def _moved(found: DataFrame, down: DataFrame) -> DataFrame:
    """Pointers found, led on along those found later, and these."""
    ends = down.select(F.col("node").alias("via"), F.col("comp").alias("end"))
    return found.join(ends, F.col("comp") == F.col("via"), "left").select("node", F.coalesce("end", "comp").alias("comp")).unionByName(down)


def _fewest(n: Column) -> Column:
    """Of a set of n shingles, how many a linked one shares at least."""
    return F.floor((n * PERCENT + 99) / 100)


def _reaches(common: Column, n: Column, m: Column) -> Column:
    """Whether so many common shingles link sets of n and m: 100 * common >= PERCENT * (n + m - common)."""
    return (100 + PERCENT) * common >= PERCENT * (n + m)


class _Linker:
    """The stages between classes and links. classes: (rep, n, sketch), a stored table."""

    def __init__(self, scratch: Scratch, docs: DataFrame, classes: DataFrame, size: int, id_col: str, text_col: str):
        self.scratch, self.docs, self.classes = scratch, docs, classes
        self.size, self.id_col, self.text_col = size, id_col, text_col

    def lists(self) -> None:
        """keys: (v, rep, n, m) of each class's rarest values that others list, too; m is the list's length. sets: (id, digest, items) of these classes."""
        entries = self.classes.select("rep", "n", F.explode("sketch").alias("v"))
        counts = entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
        shared = entries.join(counts, "v").groupBy("rep", "n").agg(F.collect_list(F.struct("c", "v")).alias("e"))  # at most SKETCH a class
        need = F.when(F.col("n") <= WHOLE, _fewest(F.col("n"))).otherwise(LEAST).cast("int")
        shared = shared.where(F.size("e") >= need)
        rarest = F.slice(F.array_sort("e"), F.lit(1), F.size("e") - need + 1)
        listed = self.scratch.save(shared.select("rep", "n", F.explode(F.transform(rarest, lambda x: x["v"])).alias("v")), release=True)
        lengths = listed.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
        self.keys = self.scratch.save(listed.join(lengths, "v"))
        self.scratch.drop(listed)
        ids = self.scratch.save(self.keys.select(F.col("rep").alias("id")).distinct())
        sets = full_sets(self.docs, ids, self.size, self.id_col, self.text_col)
        self.sets = self.scratch.save(sets.dropDuplicates(["id", "digest"]))
        self.long = self.keys.where(F.col("m") > SHORT_LIST).select("v", "rep", "n")

    def short_pairs(self) -> DataFrame:
        """The pairs (a, b) of short lists."""
        short = self.keys.where(F.col("m") <= SHORT_LIST)
        x = short.select("v", F.col("rep").alias("a"), F.col("n").alias("na"))
        y = short.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"))
        return x.join(y, "v").where((F.col("a") < F.col("b")) & similar_sizes(F.col("na"), F.col("nb"))).select("a", "b")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose union sketches pass and whose full sets are similar, a stored table."""
        one = self.sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        two = self.sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        both = pairs.distinct().join(one, "a").join(two, "b")
        both = both.where(estimate_passes(F.slice("x", 1, SKETCH), F.slice("y", 1, SKETCH)))
        return self.scratch.save(both.where(_reaches(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"))

    def placed(self, comps: DataFrame | None) -> DataFrame:
        """(v, rep, n, comp) of the members of long lists."""
        if comps is None:
            return self.long.withColumn("comp", F.col("rep"))
        known = comps.select(F.col("node").alias("of"), "comp")
        return self.long.join(known, F.col("rep") == F.col("of"), "left").select("v", "rep", "n", F.coalesce("comp", "rep").alias("comp"))

    def hub_pairs(self, members: DataFrame, turn: int) -> DataFrame:
        """(a, b): members of long lists outside a list's largest component with one member of it, drawn by a hash; in turn 0 all with a hub."""
        draw = F.min(F.struct(F.xxhash64("rep", "v", F.lit(turn)).alias("h"), F.col("rep").alias("hub"), F.col("n").alias("hub_n")))
        if turn == 0:
            hubs = members.groupBy("v").agg(draw.alias("x")).select("v", "x.hub", "x.hub_n")
            pairs = members.join(hubs, "v")
        else:
            by_comp = members.groupBy("v", "comp").agg(F.count("*").alias("size"), draw.alias("x"))
            hubs = by_comp.groupBy("v").agg(F.max_by(F.struct("x", "comp"), F.struct("size", "comp")).alias("y"))
            hubs = hubs.select("v", "y.x.hub", "y.x.hub_n", F.col("y.comp").alias("hub_comp"))
            pairs = members.join(hubs, "v").where("comp <> hub_comp")
        pairs = pairs.where((F.col("rep") != F.col("hub")) & similar_sizes(F.col("n"), F.col("hub_n")))
        return pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))

    def rest_pairs(self, members: DataFrame) -> DataFrame:
        """(a, b): all pairs of members of long lists with several components that can still be linked, by whole sets."""
        sizes = members.groupBy("v", "comp").agg(F.count("*").alias("size"))
        lists = sizes.groupBy("v").agg(F.max(F.struct("size", "comp")).alias("x"), F.count("*").alias("comps")).where("comps > 1").select("v", F.col("x.comp").alias("largest"))
        active = members.join(lists, "v").groupBy("rep", "n", "comp").agg(F.max(F.col("comp") != F.col("largest")).alias("outside"))
        active = self.scratch.save(active)
        items = active.join(self.sets, (F.col("rep") == F.col("id")) & (F.col("n") == F.size("items"))).select("rep", "n", "digest", F.explode("items").alias("item"))
        shared = items.groupBy("item").agg(F.count("*").alias("c")).where("c > 1")
        own = items.join(shared, "item").groupBy("rep", "n", "digest").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("e"))  # one class's shingles
        # a shingle's place among the set's by rarity, those of this class alone coming first
        ranked = own.select("rep", "n", (F.col("n") - F.size("e")).alias("alone"), F.posexplode(F.slice("e", F.lit(1), F.greatest(F.size("e") - _fewest(F.col("n")).cast("int") + 1, F.lit(0)))).alias("k", "x"))
        ranked = ranked.select("rep", "n", "x.item", (F.col("n") - F.col("alone") - F.col("k")).alias("left"))  # shingles from this one on
        ranked = self.scratch.save(ranked.join(active.select(F.col("rep").alias("of"), "comp", "outside"), F.col("rep") == F.col("of")).drop("of"))
        step = lambda n: F.floor(F.log(n) / F.log(F.lit(SIZE_STEP)) + 1e-9)
        listed = ranked.select("item", step(F.col("n")).alias("size"), F.col("rep").alias("y"), F.col("n").alias("y_n"), F.col("left").alias("y_left"), F.col("comp").alias("y_comp"))
        least, most = F.floor(F.col("n") * PERCENT / 100), F.floor(F.col("n") * 100 / PERCENT)
        probes = ranked.where("outside").withColumn("size", F.explode(F.sequence(step(F.greatest(least, F.lit(1))), step(most))))
        smallest = F.greatest(F.floor(F.pow(F.lit(SIZE_STEP), F.col("size")) - 1e-6), least)  # of this size step
        probes = probes.where(_reaches(F.col("left"), F.col("n"), smallest))
        near = probes.join(listed, ["item", "size"]).where(
            (F.col("comp") != F.col("y_comp")) & similar_sizes(F.col("n"), F.col("y_n")) & _reaches(F.least("left", "y_left"), F.col("n"), F.col("y_n"))
        )
        return near.select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b"))

    def links(self) -> DataFrame | None:
        """(node, comp) of all classes that are linked with another; None if none is."""
        self.lists()
        if self.long.isEmpty():
            return components(self.scratch, self.linked(self.short_pairs()))
        links = self.linked(self.short_pairs().unionByName(self.hub_pairs(self.placed(None), 0)))
        for turn in range(1, HUB_TURNS):
            comps = components(self.scratch, links)
            links = links.unionByName(self.linked(self.hub_pairs(self.scratch.save(self.placed(comps)), turn)))
        members = self.scratch.save(self.placed(components(self.scratch, links)))
        return components(self.scratch, links.unionByName(self.linked(self.rest_pairs(members))))


def near_dedup(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, class_id, component_id, kept, text_key) of every row: the smallest id of equal sets, and of the component."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = scratch.save(sketches(docs, size, id_col, text_col), release=True)
    classes = rows.where("n > 0").groupBy("n", "digest").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes)
    comps = _Linker(scratch, docs, classes.where("rep IS NOT NULL").select("rep", "n", "sketch"), size, id_col, text_col).links()
    scratch.drop_all_but(*(t for t in (rows, classes, comps) if t is not None))
    named = classes.select("n", "digest", "rep")
    if comps is None:
        named = named.withColumn("comp", F.col("rep"))
    else:
        named = named.join(comps, F.col("rep") == F.col("node"), "left").select("n", "digest", "rep", F.coalesce("comp", "rep").alias("comp"))
    named = scratch.save(named)
    scratch.drop_all_but(rows, named)
    out = rows.drop("sketch").join(named, ["n", "digest"], "left")
    comp = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("class_id"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"), "text_key")


def keep_one(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that represent their component; of repeated rows one."""
    verdicts = near_dedup(docs, size, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_key").alias("key"), "kept", "n_shingles")
    verdicts = verdicts.where("n_shingles > 0").drop("n_shingles")  # rows without words are linked with nothing
    return keep_rows(docs, verdicts, text_key(docs[text_col]), id_col)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents."""
    return near_dedup(read_table(spark, sf_dir, "documents"), CONTRACT_SHINGLE).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < {CONTRACT_SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {CONTRACT_SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {CONTRACT_SHINGLE - 1}], ' ')) END) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, comp) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT e.y, r.comp FROM r JOIN e ON r.doc_id = e.x WHERE r.comp < e.y
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(comp) AS component_id, r.doc_id = min(comp) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
