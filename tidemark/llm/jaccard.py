"""Exact join of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more.

Jaccard distance (1 - similarity) is a metric, so pivots cut the sets into Voronoi regions, and two sets
within r of each other have distances to any pivot that differ by r at most: a set belongs to its nearest pivot's region
and, within 2r of that border, to the neighbours'. Among unrelated texts a pivot document is at distance 1 from
nearly everything and cuts nothing, so the join goes from coarse to fine:

1. Equal sets are one (their smallest id stands for them). Only different sets are compared.
2. Coarse regions. The universe of n-grams is dealt into m parts by hash, where m - 1 is the largest symmetric
   difference that two linked sets of a size class can have: the part of the universe is the pivot, and sets whose
   contents of it are equal (distance 0 there) share a cell. Linked sets differ in fewer parts than there are, so they
   meet in some cell, even if each asks only in the cells of its larger parts and is silent in the others. Sets within a link of the next size class belong to both. Sets of at most ``PREFIX``
   n-grams meet by their first n-grams in hash order instead (linked sets share one among the first
   ``n - ceil(t n) + 1``). Cells that share sets are joined to coarse regions.
3. A coarse region of at most ``TASK_SETS`` sets is solved in one task: the distances to each pivot in turn, where
   sets already connected or outside the triangle inequality's window of the pivots before need no comparison.
4. A larger region is first cut by single n-grams as pivots, its common ones last: linked sets share one among their first, so
   passages that many sets hold bring none together. What is still large then is cut by pivots of its own members into
   Voronoi regions with borders of 2r on each side, in blocks over many tasks; regions whose sets are all connected are
   done, small ones go to step 3, others are cut again. A region that pivots cannot cut is compared block by
   block: nothing is dropped at any size.

A link is decided on the whole sets by integers: 100 * |A and B| >= percent * |A or B|. N-grams are compared
by 64-bit hashes.

Nulls and odd inputs: a null, empty or blank text has no n-grams and links to nothing; a shorter text than one n-gram is one
n-gram of its own. Rows that repeat an id are separate documents; a null id never names a component (a
component of null ids only has a null id). Columns beyond id and text are not read. No rows: no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import BROADCAST_ROWS, ROWS_AT_ONCE, components, runs, scan, small_or_not
from tidemark.session import stage

NGRAM, PERCENT = 4, 85
PREFIX, CLASS = 32, 1.3
#: Sets and n-grams that one task compares at once; larger regions are cut.
TASK_SETS, TASK_GRAMS = 2_000, 4_000_000
PIVOTS, BLOCK = 24, 1_000
#: N-grams in so many sets of a region count as common there, as long as they are no more than so many (16 bytes each).
COMMON, MOST_COMMON = 2, 2_000_000
#: Sets that a task remembers to have sent (16 bytes each).
REMEMBERED = 1_000_000

#: Largest size of each class.
_TOPS = [PREFIX]
while _TOPS[-1] < 1 << 40:
    _TOPS.append(int(_TOPS[-1] * CLASS))

_M1, _M2, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, ngram: int = NGRAM) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of ``text``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, ngram)
    with np.errstate(over="ignore"):
        grams = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            grams = _mix(grams * _M1 + hashes[k:n - size + 1 + k])
    return np.unique(grams)


def _class_of(n: int) -> int:
    """0 for sizes up to PREFIX, then one class per factor of CLASS."""
    return bisect.bisect_left(_TOPS, n)


def _most_apart(sizes: int, percent: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add up to ``sizes``."""
    return sizes * (100 - percent) // (100 + percent)


def cells(grams: np.ndarray, percent: int = PERCENT) -> list[int]:
    """Keys of the cells of a set, doubled, plus 1 in those that it does not ask in: of two linked sets, each
    asks in a cell that the other is in, too. Small parts of the universe, which sets share by chance, are not asked in
    as long as more parts are left than linked sets can differ in."""
    n = len(grams)
    if not n:
        return []
    widest = n * 100 // percent
    out = []
    with np.errstate(over="ignore"):
        for c in range(_class_of(n), _class_of(widest) + 1):
            if c == 0:
                first = grams[:n - -(-n * percent // 100) + 1]
                out.append(_mix(first ^ _M1) & ~_ONE)
                continue
            top = _TOPS[c]
            most = _most_apart(2 * top, percent)
            parts = most + 2 + most // 16
            part = ((grams * _M1) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, mixed = part[order], _mix(grams[order] + _M2)
            at = np.flatnonzero(np.diff(part, prepend=part[:1] + _ONE))
            sums, held = np.add.reduceat(mixed, at), part[at]
            asks = _most_apart(n + min(top, widest), percent) + 1
            silent = np.zeros(len(held), np.uint64)
            if len(held) >= asks:
                silent[np.argsort(-np.diff(np.append(at, n)), kind="stable")[asks:]] = _ONE
            else:  # so many parts are empty that equal contents might be the empty ones only
                full = np.zeros(parts, np.uint64)
                full[held.astype(np.int64)] = sums
                sums, held, silent = full, np.arange(parts, dtype=np.uint64), np.zeros(parts, np.uint64)
            out.append((_mix(sums + _mix(held * _M1 + np.uint64(c))) & ~_ONE) | silent)
    return np.concatenate(out).view(np.int64).tolist()


def _digest(grams: np.ndarray) -> tuple[int, bytes]:
    whole = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(whole[:8], "little", signed=True), whole


def _linked(inter: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def solve(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the first one connected with it by links."""
    m = len(sets)
    root = np.arange(m)
    if m < 2:
        return root
    sizes = np.fromiter(map(len, sets), np.int64, m)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flag = np.zeros(ids.max() + 1, np.int32)
    seen: list[np.ndarray] = []  # distances to the first pivots
    radius = 1 - percent / 100 + 1e-9
    for p in range(m - 1):
        rest = root != root[p]
        rest[:p] = False
        rest &= (100 * np.minimum(sizes, sizes[p]) >= percent * np.maximum(sizes, sizes[p])) if len(seen) >= 8 else True
        for d in seen:
            if len(seen) >= 8:
                rest &= np.abs(d - d[p]) <= radius
        if not rest.any():
            if (root == root[0]).all():
                break
            continue
        mine = ids[offsets[p]:offsets[p + 1]]
        flag[mine] = 1
        inter = np.add.reduceat(flag[ids], offsets[:-1])
        flag[mine] = 0
        if len(seen) < 8:
            seen.append(1 - inter / (sizes + sizes[p] - inter))
        for q in np.flatnonzero(rest & _linked(inter, sizes[p], sizes, percent)):
            low, high = sorted((root[p], root[q]))
            if low != high:
                root[root == high] = low
    return root


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _solved(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the sets (region, key, grams) of each region like all its links do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, 1):
            own = sorted(dict(rows).items())
            if len(own) < 2:
                continue
            keys = [k for k, _ in own]
            root = solve([_set(g) for _, g in own], percent)
            at = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_pydict({"a": pa.array([keys[i] for i in at], pa.int64()),
                                              "b": pa.array([keys[root[i]] for i in at], pa.int64())})

    return (sets.select("region", "key", "grams").repartition("region").sortWithinPartitions("region")
            .mapInArrow(run, "a long, b long"))


def _met(dealt: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the keys of each cell (cell, key) that a set asks in: each with the cell's first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, head = None, 0  # rows come sorted, those that ask first, and a cell may span batches
        asked = False
        for batch in batches:
            at, keys = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(keys):
                continue
            own, asks = at >> 1, at & 1 == 0
            new = np.concatenate([[own[0] != cell], own[1:] != own[:-1]])
            begins = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
            heads = np.where(begins >= 0, keys[begins], head)
            open_ = np.where(begins >= 0, asks[begins], asked)
            cell, head, asked = own[-1], heads[-1], open_[-1]
            pairs = np.unique(np.stack([keys, heads], 1)[open_ & (keys != heads)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return (dealt.select("cell", "key").repartition(F.shiftright("cell", 1)).sortWithinPartitions("cell", "key")
            .mapInArrow(run, "a long, b long").distinct())


def _dealt(texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Cells (cell, key) of the sets of ``texts`` (_text). A task sends those of equal sets once as long as it remembers them, so a
    group of copies of any size is a few rows per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                own, keys = [], []
                for text in batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist():
                    grams = gram_set(text, ngram)
                    if not len(grams):
                        continue
                    key, whole = _digest(grams)
                    if whole in seen:
                        continue
                    seen.add(whole)
                    own.append(np.array(cells(grams, percent), np.int64))
                    keys.append(np.full(len(own[-1]), key, np.int64))
                if len(seen) >= REMEMBERED:
                    seen.clear()
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(keys))], names=["cell", "key"])

    return texts.select("_text").mapInArrow(run, "cell long, key long")


def _by_rarest(members: DataFrame, percent: int) -> DataFrame:
    """Smaller regions (region, key) for the members (region, key, grams): sets that share one of their first n-grams, the
    region's common ones last. What many sets hold then brings no sets together that differ in the rest. Any order
    is exact as long as all sets of a region use the same, so only the most common n-grams need be told apart: at most
    ``MOST_COMMON`` of them go to the tasks, the others follow their hashes."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_in_region(_set(raw), region).view(np.int64))], names=["gram"])

    held = members.select("region", "grams").mapInArrow(spread, "gram long").groupBy("gram").agg(F.count("*").alias("sets"))
    least = COMMON
    held = stage(held.filter(F.col("sets") >= least), "jaccard-held")
    while held.filter(F.col("sets") >= least).count() > MOST_COMMON:
        least *= 2
    common = held.filter(F.col("sets") >= least).toArrow()
    grams = common["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    sent = members.sparkSession.sparkContext.broadcast((grams[order], common["sets"].to_numpy()[order]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets = sent.value
        for batch in batches:
            for region, key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _in_region(_set(raw), region)
                at = np.searchsorted(known, own)
                weight = np.zeros(len(own), np.int64)
                if len(known):
                    at[at == len(known)] = 0
                    weight = np.where(known[at] == own, sets[at], 0)
                n = len(own)
                chosen = own[np.lexsort((own, weight))[:n - -(-n * percent // 100) + 1]]
                yield pa.RecordBatch.from_arrays([pa.array((chosen & ~_ONE).view(np.int64)), pa.array(np.full(len(chosen), key, np.int64))],
                                                 names=["cell", "key"])

    met = stage(_met(members.select("region", "key", "grams").mapInArrow(first, "cell long, key long")), "jaccard-met")
    sent.unpersist()
    return components(met, "jaccard-rare").select(F.col("node").alias("key"), F.col("root").alias("region"))


def _in_region(grams: np.ndarray, region: int) -> np.ndarray:
    """Hashes of (region, n-gram)."""
    with np.errstate(over="ignore"):
        return _mix(grams ^ _mix(np.array([region], np.int64).view(np.uint64) + _M1))


def _to_pivots(members: DataFrame, sizes: DataFrame, salt: int) -> DataFrame:
    """Distances (region, key, pivots, distances) of each member (region, key, grams) to its region's pivots."""
    place = F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(1 << 30))
    sized = members.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, "region")
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("sets") / BLOCK))).drop("sets")
    pivots = (sized.filter(place * F.col("sets") < F.lit(PIVOTS * (1 << 30)))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("sets") / BLOCK) - 1))).drop("sets"))
    columns = ["region", "block", "kind", "key", "grams"]
    both = (dealt.withColumn("kind", F.lit(1)).select(columns)
            .union(pivots.withColumn("kind", F.lit(0)).select(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (region, _), rows in runs(batches, 2):
            centres = sorted({k: g for kind, k, g in rows if not kind}.items())
            universe, inverse = np.unique(np.concatenate([_set(g) for _, g in centres] or [np.zeros(0, np.uint64)]),
                                          return_inverse=True)
            holds = np.zeros((len(centres), len(universe) + 1), np.int32)
            owner = np.repeat(np.arange(len(centres)), [len(g) // 8 for _, g in centres])
            holds[owner, inverse] = 1
            sizes = holds.sum(1)
            keys, inters, lengths = [], [], []
            for kind, key, raw in rows:
                if not kind:
                    continue
                grams = _set(raw)
                at = np.searchsorted(universe, grams)
                at[at < len(universe)] = np.where(universe[at[at < len(universe)]] == grams[at < len(universe)],
                                                  at[at < len(universe)], len(universe))
                keys.append(key)
                inters.append(holds[:, at].sum(1))
                lengths.append(len(grams))
            yield pa.RecordBatch.from_arrays([
                pa.array([region] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([[k for k, _ in centres]] * len(keys), pa.list_(pa.int64())),
                pa.array([sizes.tolist()] * len(keys), pa.list_(pa.int64())),
                pa.array([i.tolist() for i in inters], pa.list_(pa.int64()))],
                names=["region", "key", "n", "pivots", "sizes", "inters"])

    return (both.repartition("region", "block").sortWithinPartitions("region", "block", "kind")
            .mapInArrow(run, "region long, key long, n long, pivots array<long>, sizes array<long>, inters array<long>"))


def _block_pairs(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links of regions that pivots do not cut: every two blocks meet in one task."""
    blocks = F.ceil(F.col("sets") / (BLOCK // 2))
    dealt = members.join(sizes, "region").withColumn("own", F.pmod(F.xxhash64("key"), blocks))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return _solved(met.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"),
                              "key", "grams"), percent)


def _cut(members: DataFrame, links: list[DataFrame], percent: int) -> list[DataFrame]:
    """Links of regions too large for a task, cut by pivots until each part is connected or small."""
    width = 2 * (1 - percent / 100) + 1e-9
    salt = 0
    while not members.isEmpty():
        salt += 1
        sizes = stage(members.groupBy("region").agg(F.count("*").alias("sets")), "jaccard-sizes")
        told = stage(_to_pivots(members, sizes, salt), "jaccard-pivots")
        each = told.select("region", "key", "n", F.explode(F.arrays_zip("pivots", "sizes", "inters")).alias("p")).select(
            "region", "key", F.col("p.pivots").alias("pivot"),
            (F.col("p.inters") * 100 >= percent * (F.col("n") + F.col("p.sizes") - F.col("p.inters"))).alias("linked"),
            (1 - F.col("p.inters") / (F.col("n") + F.col("p.sizes") - F.col("p.inters"))).alias("distance"))
        links.append(stage(each.filter("linked and key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")),
                           "jaccard-links"))
        all_links = links[0]
        for more in links[1:]:
            all_links = all_links.union(more)
        roots = components(all_links, "jaccard-cut")
        near = told.select("region", "key", F.array_min(F.transform(
            F.arrays_zip("sizes", "inters"), lambda p: 1 - p["inters"] / (F.col("n") + p["sizes"] - p["inters"]))).alias("near"))
        inside = (each.join(near, ["region", "key"]).filter(F.col("distance") <= F.col("near") + width)
                  .select("region", "key", F.xxhash64("region", "pivot").alias("sub")))
        # Regions that had no pivot by chance stay as they are and get others next time.
        inside = inside.union(told.filter(F.size("pivots") == 0).select("region", "key", F.xxhash64("region").alias("sub")))
        inside = stage(inside, "jaccard-inside")
        state = (inside.join(roots.withColumnRenamed("node", "key"), "key", "left")
                 .withColumn("root", F.coalesce("root", "key")).groupBy("region", "sub")
                 .agg(F.count("*").alias("sets"), (F.min("root") != F.max("root")).alias("open")))
        state = stage(state.filter("open").join(sizes.withColumnRenamed("sets", "parent"), "region"), "jaccard-open")
        stuck = state.filter(f"sets > {TASK_SETS} and sets > 0.8 * parent").select("region").distinct()
        again = inside.join(state.select("region", "sub", "sets"), ["region", "sub"])
        sub = again.join(stuck, "region", "left_anti").join(members, ["region", "key"]).select(
            F.col("sub").alias("region"), "sets", "key", "grams")
        sub = stage(sub, "jaccard-sub")
        links.append(stage(_block_pairs(members.join(stuck, "region", "left_semi"), sizes, percent), "jaccard-links"))
        links.append(stage(_solved(sub.filter(f"sets <= {TASK_SETS}"), percent), "jaccard-links"))
        members = sub.filter(f"sets > {TASK_SETS}").select("region", "key", "grams")
    return links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
                   percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, and ``first``: the row is the one to keep of
    its component (smallest id; among rows that repeat it, smallest text hash)."""
    texts = docs.select(F.col(id_col).alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_row"), F.col(text_col).alias("_text"))

    def describe(ids: list, rows: list, texts: list) -> dict[str, list]:
        out = {"doc_id": ids, "_row": rows, "n": [], "key": [], "digest": []}
        for text in texts:
            grams = gram_set(text, ngram)
            key, whole = _digest(grams) if len(grams) else (None, None)
            for name, value in (("n", len(grams)), ("key", key), ("digest", whole)):
                out[name].append(value)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    first = stage(scan(texts, describe, f"doc_id {kind}, _row long, n long, key long, digest binary"), "jaccard-sets")
    # One row per different set. Copies meet in the map tasks, so a group of any size sends a row per task.
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    classes = stage(first.filter("n > 0").groupBy("digest", "key").agg(lowest.alias("low")), "jaccard-classes")
    # Cells are made from the texts a second time: carried along, they would be written three times, and 98 % hold a single set.
    near = stage(_met(_dealt(texts, ngram, percent)), "jaccard-near")
    coarse = components(near, "jaccard-coarse").select(F.col("node").alias("key"), F.col("root").alias("region"))
    member = stage(coarse.join(classes.select("key", "low"), "key")
                   .select("key", "region", F.col("low.doc_id").alias("_id"), F.col("low._row").alias("_key")), "jaccard-member")
    # Ids of a few columns go to the texts, not the texts through a shuffle, as long as there are not too many.
    light = F.broadcast if member.count() <= BROADCAST_ROWS else (lambda df: df)

    def grams_of(keys: list, regions: list, texts: list) -> dict[str, list]:
        sets = [gram_set(t, ngram) for t in texts]
        return {"region": regions, "key": keys, "n": [len(s) for s in sets], "grams": [s.tobytes() for s in sets]}

    def sets_of(chosen: DataFrame) -> DataFrame:
        same = texts["doc_id"].eqNullSafe(chosen["_id"]) & (texts["_row"] == chosen["_key"])
        return scan(texts.join(light(chosen), same).select("key", "region", "_text"), grams_of,
                    "region long, key long, n long, grams binary")

    sizes = stage(member.join(first.filter("n > 0").groupBy("key").agg(F.max("n").alias("n")), "key")
                  .groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")), "jaccard-regions")
    wide = small_or_not(stage(sizes.filter(f"sets > {TASK_SETS} or (grams > {TASK_GRAMS} and sets > 2)").select("region"),
                              "jaccard-wide"))
    links = [stage(_solved(sets_of(member.join(wide, "region", "left_anti")), percent), "jaccard-links")]
    if not wide.isEmpty():
        large = stage(sets_of(member.join(wide, "region", "left_semi")).dropDuplicates(["region", "key"]), "jaccard-large")
        # Regions are ids: they go to the sets where these are read, and only sets that are still to be cut are written again.
        rarer = small_or_not(_by_rarest(large, percent))
        sizes = stage(large.select("key", "n").join(rarer, "key").groupBy("region").agg(
            F.count("*").alias("sets"), F.sum("n").alias("n")), "jaccard-regions")
        is_wide = (F.col("sets") > TASK_SETS) | ((F.col("n") > TASK_GRAMS) & (F.col("sets") > 2))
        chosen = lambda which: large.drop("region").join(small_or_not(stage(
            rarer.join(sizes.filter(which).select("region"), "region"), "jaccard-rarer")), "key").select("region", "key", "grams")
        links.append(stage(_solved(chosen(~is_wide), percent), "jaccard-links"))
        links = _cut(stage(chosen(is_wide), "jaccard-larger"), links, percent)
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.union(more)
    groups = components(all_links, "jaccard-groups")

    named = classes.select("key", "low").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    lows = stage(named.groupBy("root").agg(F.min("low").alias("least")), "jaccard-lows")
    named = stage(named.join(lows, "root").select("key", "least"), "jaccard-named")
    out = first.select("doc_id", "_row", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        "_row", (F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
                                          & (F.col("_row") == F.col("least._row")))).alias("first"))
