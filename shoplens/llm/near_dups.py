"""Operator 8 — near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, each a 64-bit hash; its
sketch is the ``k`` least ones. Two documents are linked if the exact Jaccard
of their full sets reaches the threshold ``num / den``.

1. Equal sets (128-bit digest) are one class; one representative goes on.
2. Inverted lists of retained values. A link shares at least ``m`` of the ``k``
   values but for a chance of 1e-8 (Chernoff bound); sketches of small sets are
   the sets, and the bound is exact. So a representative with fewer values that
   occur elsewhere is done; the others enter the lists of their rarest values
   only, as many as the prefix principle asks for (``k - m + 1``, values without
   another holder counted first).
3. Short lists (up to ``SHORT``) give their pairs: linear, a bounded number for
   each entry. The estimate from the union sketch, then exact Jaccard, decide.
4. Long lists give no pairs. Their members form a family; its consensus is the
   set of shingles that more than half of them hold, and each member is
   written as its difference from that. With ``F = (den+num)*|difference| -
   (den-num)*|set|``, two members whose F add up to 0 or less are linked for
   certain (triangle inequality on full sets): a star around the least F gives
   all of these. First the lists that overlap are one family together, so that each
   representative's set is looked at once; most members are in the star of theirs.
   What is left are lists with a member that isn't: each of these lists is a
   family of its own. There any pair that isn't in the star needs ``(F1+F2) / (2*(den+num))`` common
   differences, so what is left are inverted lists over differences: members
   with too few differences that anyone shares are done, the others enter the
   lists of their rarest differences, and the join of these lists lets a pair out
   only if it has enough, once. That is exact whatever the consensus is.
5. Links and classes give components (``components.py``).

The result's links hold on full sets; a link can be missed only with the
sketch chance above. Cases: null texts, empty ones and those without a word have the empty set and
link with nothing; under five words the whole sequence is the one shingle; a
null doc_id is passed over when the least id of a component is taken; rows
alike in doc_id and text are one document; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import discard, written
from shoplens.llm.components import components

SHINGLE, K, SHORT = 5, 96, 8
#: representatives whose keys may be broadcast
FEW = 500_000

_SETS = "doc_id long, key long, n int, cls binary, sketch array<long>"


def shingle_set(text: str, words_each: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # of bytes: A-Z only, and the six white space characters only
    if not words:
        return np.zeros(0, np.int64)
    h = xxhash.xxh3_64_intdigest
    if len(words) < words_each:
        return np.array([h(b" ".join(words))], np.uint64).view(np.int64)
    ids: dict = {}
    code = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, len(words))
    token = np.fromiter(map(h, ids), np.uint64, len(ids))[code]
    n = len(words) - words_each + 1
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words_each):  # order matters: multiply, add, and stir between the words
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + token[k:n + k]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def least_shared(k: int, num: int, den: int, miss: float = 1e-8) -> int:
    """Most values that two sketches of ``k`` share but for a chance of ``miss``,
    if the Jaccard of their sets is ``num / den`` or more (Chernoff bound of the
    binomial, which is wider than the hypergeometric that applies)."""
    t = num / den
    for m in range(int(k * t), 0, -1):
        x = m / k
        d = x * math.log(x / t) + ((1 - x) * math.log((1 - x) / (1 - t)) if t < 1 and x < 1 else 0.0)
        if math.exp(-k * d) <= miss:
            return m
    return 1


#: rows whose sets a task holds at a time
_ROWS = 500


def _sketches(k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            sets = [shingle_set(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "cls", "sketch"])

    return run


def _full(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
        sets = [shingle_set(t.as_py() or "") for t in b.column(2)]
        same = [len(s) > 0 and _digest(s) == c for s, c in zip(sets, b.column(1).to_pylist())]
        keep = pa.array(same, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).filter(keep), pa.array([len(s) for s, ok in zip(sets, same) if ok], pa.int32()),
             pa.array([s for s, ok in zip(sets, same) if ok], pa.list_(pa.int64()))], names=["rid", "n", "full"])


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(float(b))).cast("long")


def _prefix_entries(df: DataFrame, lists: str, length: Column) -> DataFrame:
    """The first ``length`` values of the sorted array ``lists`` of (count, value), as
    rows; ``left`` is the number of values from there on to the array's end."""
    first = F.slice(F.col(lists), 1, F.greatest(length, F.lit(0)).cast("int"))
    return (df.select("*", F.posexplode(first).alias("place", "at"))
            .withColumn("value", F.col("at.v")).withColumn("left", F.size(lists) - F.col("place")))


def _sketch_entries(reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(v, rid): the inverted lists that have more than one holder."""
    postings = reps.select("rid", F.explode("sketch").alias("v"))
    common = written(postings.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"), "nd_common")
    held = (postings.join(common, "v").groupBy("rid")
            .agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("held")).join(reps.select("rid", "n"), "rid"))
    size, m = F.least(F.col("n"), F.lit(k)), least_shared(k, num, den)
    need = F.when(F.col("n") * den < F.lit(k * num), _ceil_div(F.col("n") * num, den)).otherwise(
        F.least(F.lit(m), _ceil_div(size * num, den)))
    alone = size - F.size("held")
    entries = _prefix_entries(held.filter(F.size("held") >= need), "held", size - need + 1 - alone)
    return entries.select(F.col("value").alias("v"), "rid")


def _apart(members: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (fam, rid, n, full) as differences from their family's consensus:
    (fam, rid, n, diff, f, f0, r0, near), and the written table (fam, rid, n, diff, f) in it."""
    up, down = den + num, den - num
    counts = members.groupBy("fam").agg(F.count("*").alias("members"))
    shared = members.select("fam", F.explode("full").alias("v")).groupBy("fam", "v").agg(F.count("*").alias("c"))
    consensus = (shared.join(counts, "fam").filter("c * 2 > members").groupBy("fam")
                 .agg(F.collect_list("v").alias("core")))
    empty = F.array().cast("array<bigint>")
    core = F.coalesce("core", empty)
    apart = written(
        members.join(written(consensus, "nd_core"), "fam", "left")
        .select("fam", "rid", "n", F.concat(F.array_except("full", core), F.array_except(core, "full")).alias("diff"))
        .withColumn("f", F.size("diff") * up - F.col("n") * down), "nd_apart")
    least = written(apart.groupBy("fam").agg(F.min(F.struct("f", "rid")).alias("x")), "nd_least").select(
        "fam", F.col("x.f").alias("f0"), F.col("x.rid").alias("r0"))
    return apart.join(least, "fam").withColumn("near", F.col("f") + F.col("f0") <= 0), apart


def _star(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("near") & (F.col("rid") != F.col("r0"))).select(F.col("r0").alias("a"), F.col("rid").alias("b"))


def _family_links(entries: DataFrame, long_lists: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among the members of long lists, as many as their components need."""
    held = written(entries.join(long_lists, "v").select("v", "fam", "rid"), "nd_held")
    # overlapping lists together: every representative is in one family
    whole = components(held.select(F.col("fam").alias("a"), F.col("rid").alias("b")))
    of = written(held.select("rid").distinct().join(whole, F.col("rid") == F.col("node"))
                 .select("rid", F.col("root").alias("fam")).join(full, "rid"), "nd_members")
    placed, apart = _apart(of, num, den)
    placed = written(placed.select("rid", "r0", "near"), "nd_placed")
    first = written(_star(placed), "nd_star")
    discard(of, apart)
    # lists that hold someone outside of the star: families of their own
    far = written(held.join(placed.filter(~F.col("near")).select("rid"), "rid", "left_semi").select("v").distinct(), "nd_far")
    members = written(held.join(far, "v", "left_semi").select("fam", "rid").distinct().join(full, "rid"), "nd_members")
    discard(held, placed, far)
    rest = written(_difference_links(members, num, den), "nd_rest")
    discard(members)
    return first.union(rest)


def _difference_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """All links of ``members`` (fam, rid, n, full) within their families, those of a
    star by its centre."""
    up = den + num
    placed, apart = _apart(members, num, den)
    star, near = _star(placed), F.col("near")

    # differences that more than one member has; a member's differences are in their order of rarity
    common = written(apart.select("fam", F.explode("diff").alias("v")).groupBy("fam", "v").agg(F.count("*").alias("c"))
                     .filter("c > 1"), "nd_diffs")
    held = (apart.select("fam", "rid", F.explode("diff").alias("v")).join(common, ["fam", "v"])
            .groupBy("fam", "rid").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("held")))
    able = written(placed.join(held, ["fam", "rid"]).select(
        "fam", "rid", "f", "f0", "near", F.size("diff").alias("d"), "held",
        (F.size("held") * (2 * up) - F.col("f")).alias("g")), "nd_able")
    # with f of the partner at most g, and of the two at least one not in the star
    reach = able.groupBy("fam").agg(F.max("g").alias("g_most"), F.min(F.when(~F.col("near"), F.col("f"))).alias("f_far"))
    able = able.join(written(reach, "nd_reach"), "fam")
    partner = F.when(F.col("near"), F.col("f_far")).otherwise(F.col("f0"))
    able = able.withColumn("partner", partner).filter((F.col("f") <= F.col("g_most")) & (F.col("partner") <= F.col("g")))
    need = F.greatest(F.lit(1), _ceil_div(F.col("f") + F.col("partner"), 2 * up))
    narrow = written(_prefix_entries(able, "held", F.size("held") - need + 1)
                     .select("fam", "value", "rid", "f", "g", "near", "left"), "nd_narrow")
    # values that meet no other entry, or only members of the star, are done
    met = narrow.groupBy("fam", "value").agg(F.count("*").alias("c"), F.min("near").alias("all_near")).filter("c > 1 AND NOT all_near")
    lists = narrow.join(written(met.select("fam", "value"), "nd_met"), ["fam", "value"], "left_semi")
    other = lists.toDF("fam", "value", "rid2", "f2", "g2", "near2", "left2")
    # The sizes decide first: at their first common difference both still have all the common
    # ones ahead of them. What passes is compared in full, each pair once.
    enough = f"{2 * up} >= f + f2"
    likely = written(lists.join(other, ["fam", "value"])
                     .filter(f"rid < rid2 AND f <= g2 AND f2 <= g AND NOT (near AND near2) AND least(left, left2) * {enough}")
                     .select("fam", "rid", "rid2", "f", "f2").distinct(), "nd_likely")
    own = able.select("fam", "rid", F.transform("held", lambda x: x["v"]).alias("own"))
    linked = (likely.join(own, ["fam", "rid"]).join(own.toDF("fam", "rid2", "own2"), ["fam", "rid2"])
              .filter(f"size(array_intersect(own, own2)) * {enough}").select(F.col("rid").alias("a"), F.col("rid2").alias("b")))
    return star.union(linked)


def _verified(pairs: DataFrame, reps: DataFrame, full: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs that pass the union-sketch estimate, then the exact Jaccard of full sets."""
    side = lambda c: reps.select(F.col("rid").alias(c), F.col("sketch").alias(f"sk_{c}"))
    union = F.slice(F.array_sort(F.array_union("sk_a", "sk_b")), 1, k)
    x = F.size(F.array_intersect(F.array_intersect("sk_a", "sk_b"), "u"))
    likely = (pairs.join(side("a"), "a").join(side("b"), "b").withColumn("u", union)
              .filter(F.when(F.size("u") < k, x * den >= F.size("u") * num).otherwise(x >= least_shared(k, num, den)))
              .select("a", "b"))
    likely = written(likely, "nd_likely")
    whole = lambda c: full.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("full").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (likely.join(whole("a"), "a").join(whole("b"), "b").withColumn("both", both)
            .filter(F.col("both") * den >= (F.col("n_a") + F.col("n_b") - F.col("both")) * num).select("a", "b"))


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_shingles, component_id, kept, root of ``docs`` (doc_id, text).

    ``root`` is one number for each group, also where ids are null or repeated (null: a text without shingles).

    Documents are linked from a Jaccard of ``num / den`` on.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"),
                       F.col("text").cast("string").alias("text"))
    sets = written(rows.mapInArrow(_sketches(k), _SETS), "nd_sets")
    reps = written(sets.filter("n > 0").groupBy("cls")
                   .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"),
                        F.first("n").alias("n"), F.first("sketch").alias("sketch"))
                   .select("cls", "n", "sketch", F.col("least.doc_id").alias("least_id"), F.col("least.key").alias("least_key"),
                           F.monotonically_increasing_id().alias("rid")), "nd_reps")

    entries = written(_sketch_entries(reps, k, num, den), "nd_entries")
    lists = entries.groupBy("v").agg(F.count("*").alias("c"), F.min("rid").alias("fam")).filter("c > 1")
    lists = written(lists, "nd_lists")
    short = entries.join(lists.filter(F.col("c") <= SHORT).select("v"), "v")
    pairs = (short.join(short.select("v", F.col("rid").alias("rid2")), "v").filter("rid < rid2")
             .select(F.col("rid").alias("a"), F.col("rid2").alias("b")))
    long_lists = lists.filter(F.col("c") > SHORT).select("v", "fam")

    # full sets of the representatives that are in any list, from their texts
    alive = written(entries.join(lists.select("v"), "v", "left_semi").select("rid").distinct()
                    .join(reps.select("rid", "cls", "least_id", "least_key"), "rid"), "nd_alive")
    # few of them: their keys go to the texts, at most about 50 MB; else the texts are shuffled to them
    near = F.broadcast(alive) if alive.count() <= FEW else alive
    found = (rows.join(near, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("key") == F.col("least_key")))
             .select("rid", "cls", "text")
             .mapInArrow(_full, "rid long, n int, full array<bigint>").dropDuplicates(["rid"]))
    full = written(found, "nd_full")

    in_families = written(_family_links(entries, long_lists, full, num, den), "nd_families")
    links = written(in_families.union(_verified(pairs.distinct(), reps, full, k, num, den)), "nd_links")
    discard(full, entries, lists, alive)
    roots = components(links)

    named = reps.select("cls", "rid", "least_id").join(roots, F.col("rid") == F.col("node"), "left")
    named = named.select("cls", F.coalesce("root", "rid").alias("root"), "least_id")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = written(named.join(least, "root").select("cls", "component_id", "root"), "nd_classes")
    out = sets.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), "cls").join(of_class, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"),
                      component.eqNullSafe(F.col("doc_id")).alias("kept"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))
