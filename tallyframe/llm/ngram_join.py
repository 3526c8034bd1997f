"""N-gram Jaccard join over a prefix tree of globally ordered shingle sets.

1. Every text becomes its set of k-word shingles (64-bit hashes); equal sets are one class.
2. A fixed table of shingle counts by hash bucket gives a global order, rare buckets first. Two sets
   that reach the threshold share one of their first few shingles in that order.
3. Classes that share such a shingle are candidates if their lengths and places allow the overlap.
   First one class of each shingle is tried against the others; what is linked then needs no more
   comparing. Pairs of classes that are still apart are compared in full, at once if they are few, or
   else in rounds: each class of a shingle has a fixed turn to lead, and is done once it has led. So a
   group of near copies costs about its size, no link between groups is lost, and the rounds end.
   A parity sketch (as many bits as the set has members) rules out most false candidates: sets that
   reach the threshold cannot differ in more bits than in members.
4. Candidates of one class are stored as a prefix tree (their ordered sets, sorted, with the length
   shared with the set before). The class's own set walks the tree once: overlaps of shared
   prefixes are counted once, and subtrees end where the rest cannot reach the threshold.

Shingles take more room than the texts they come from, so they are not stored: a task builds them from
the texts where it needs them. ``docs`` is read once for each such step.

Set ids are 64-bit hashes: two different sets among n share one with odds of n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Words, bit_table, in_table, materialize, mix, shingle_sets, signed, slices, small_batches
from tallyframe.llm.components import components
from tallyframe.llm.line_dedup import bit_filter, may_hold
from tallyframe.scratch import discard, shuffles_dropped

ORDER_BITS = 16
#: Candidates of one class that one prefix tree holds; more of them go to further trees.
TREE_SETS = 512


def parity(shingles: np.ndarray) -> bytes:
    """A bit per hash bucket, set where the set has an odd number of members; as many buckets as members, in powers of two."""
    width = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """At most as many members as two sets of these parities differ in."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # halves of the wider one share the buckets of the narrower
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_id(shingles: np.ndarray) -> int | None:
    return int(mix(np.bitwise_xor.reduce(mix(shingles + np.uint64(len(shingles)))).reshape(1)).view(np.int64)[0]) if len(shingles) else None


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key (the xxhash64 of the text), n (set size), sid (id of the set, null if empty), parity."""

    def work(batches):
        for part in slices(batches):
            sets = shingle_sets(Words(part.column("text")), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())],
                names=["doc_id", "text_key", "n", "sid", "parity"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        work, "doc_id long, text_key long, n long, sid long, parity binary"
    )


def bucket_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """Rank of each hash bucket by its number of shingles; 2**ORDER_BITS numbers whatever the input."""
    size = 1 << ORDER_BITS

    def count(batches):
        total = np.zeros(size, np.int64)
        for part in slices(batches):
            sets = shingle_sets(Words(part.column("text")), k)
            total += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    with small_batches(docs.sparkSession), shuffles_dropped(docs.sparkSession):
        found = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    ranks = np.empty(size, np.uint64)
    ranks[np.lexsort((np.arange(size), total))] = np.arange(size, dtype=np.uint64)
    return ranks


def ordered(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in global order, as numbers that sort by it; one number stands for one shingle."""
    low = shingles & np.uint64((1 << ORDER_BITS) - 1)
    return np.sort(ranks[low] << np.uint64(64 - ORDER_BITS) | shingles >> np.uint64(ORDER_BITS))


def prefixes(docs: DataFrame, k: int, ranks: np.ndarray, percent: int) -> DataFrame:
    """key, sid, n, at, before, p0-p3: the first shingles of each class, as many as a partner must hit at least one of.

    ``before`` is the key at the place before."""

    def work(batches):
        done: set[int] = set()
        for part in slices(batches):
            columns = [[] for _ in PREFIX_TYPES]
            for s in shingle_sets(Words(part.column("text")), k):
                sid = set_id(s)
                if sid is None or sid in done:
                    continue
                done.add(sid)
                n = len(s)
                first = n - (percent * n + 99) // 100 + 1
                odd = np.packbits((np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8), bitorder="little")
                keys = signed(ordered(s, ranks)[:first])
                values = [keys, np.full(first, sid), np.full(first, n, np.int32), np.arange(first, dtype=np.int32), np.roll(keys, 1)]
                for column, value in zip(columns, values + [np.full(first, w) for w in odd.view(np.int64)]):
                    column.append(value)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=list(PREFIX_TYPES))

    return docs.select("text").mapInArrow(work, ", ".join(f"{k} {v}" for k, v in PREFIX_TYPES.items()))


#: Pairs per row up to which all pairs of a key are looked at, rather than those with some more leaders.
PAIRS_A_ROW = 200
#: How much the leaders of a key grow in number from round to round.
LEADERS = 16
#: Classes of one key that its leaders meet in one task.
BLOCK_ROWS = 4096
PREFIX_TYPES = {"key": "long", "sid": "long", "n": "int", "at": "int", "before": "long", "p0": "long", "p1": "long", "p2": "long", "p3": "long"}
PREFIX_COLUMNS = [c for c in PREFIX_TYPES if c != "key"]


def fits(percent: int) -> str:
    """SQL: sets a and b may reach the threshold if this key is the first they share."""
    bits = " + ".join(f"bit_count(a.p{i} ^ b.p{i})" for i in range(4))
    return (
        "a.key = b.key and a.sid <> b.sid and a.comp <> b.comp "
        f"and least(a.n - a.at, b.n - b.at) * {100 + percent}L >= {percent}L * (a.n + b.n) "
        f"and least(a.n, b.n) * 100L >= {percent}L * greatest(a.n, b.n) "
        f"and ({bits}) * {100 + percent}L <= {100 - percent}L * (a.n + b.n)"
    )


#: SQL: sets a and b do not share the keys right before this one too. Where they do, they meet there, and all that ``fits`` asks holds there.
FIRST_OF_RUN = "(a.at = 0 or b.at = 0 or a.before <> b.before)"


def walk(probe: np.ndarray, members: list[tuple[int, bytes]], percent: int) -> list[int]:
    """Members whose sets reach the threshold against ``probe``, by one walk over their prefix tree.

    ``members`` hold ordered sets as big-endian bytes, whose byte order is the tree's order.
    """
    members = sorted(members, key=lambda m: m[1])
    p, out = len(probe), []
    before = np.zeros(0, np.uint64)
    depth_overlap = np.zeros(1, np.int64)  # overlap of each prefix of the set before, as far as it was walked
    step = 64
    for sid, raw in members:
        s = np.frombuffer(raw, ">u8").astype(np.uint64)
        m = min(len(s), len(before))
        differ = np.flatnonzero(s[:m] != before[:m])
        shared = min(int(differ[0]) if len(differ) else m, len(depth_overlap) - 1)
        overlap = depth_overlap[: shared + 1]
        need = -(-percent * (p + len(s)) // (100 + percent))
        alive = True
        while True:
            d = len(overlap) - 1
            rest_probe = p - (int(np.searchsorted(probe, s[d - 1], "right")) if d else 0)
            if overlap[-1] + min(len(s) - d, rest_probe) < need:
                alive = False
                break
            if d == len(s):
                break
            part = s[d : d + step]
            at = np.minimum(np.searchsorted(probe, part), p - 1)
            overlap = np.concatenate((overlap, overlap[-1] + np.cumsum(probe[at] == part)))
        if alive and overlap[-1] * 100 >= percent * (p + len(s) - int(overlap[-1])):
            out.append(sid)
        before, depth_overlap = s, overlap
    return out


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, ranks: np.ndarray, percent: int) -> DataFrame:
    """Those of the distinct candidate ``pairs`` (a, b) that reach the threshold."""
    sketch = classes.select("sid", "text_key", "n", "parity")
    both = pairs.join(sketch.toDF("a", "a_key", "a_n", "a_parity"), "a").join(sketch.toDF("b", "b_key", "b_n", "b_parity"), "b")

    def near(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_parity", "b_parity"))
            good = [differing(x, y) * (100 + percent) <= (100 - percent) * (n + m) for n, m, x, y in zip(*columns)]
            yield batch.select(["a", "b", "a_key", "b_key"]).filter(pa.array(good, pa.bool_()))

    both = both.select("a", "b", "a_key", "b_key", "a_n", "b_n", "a_parity", "b_parity").mapInArrow(
        near, "a long, b long, a_key long, b_key long"
    )
    both = materialize(both, "near-pairs")
    ends = both.select(F.col("a").alias("sid"), F.col("a_key").alias("key")).union(both.select("b", "b_key")).distinct()
    table = bit_table(ends, "sid")

    def fetch(batches):
        done: set[int] = set()
        for part in slices(batches):
            sets = {sid: s for s in shingle_sets(Words(part.column("text")), k) if (sid := set_id(s)) is not None and sid not in done}
            done.update(sets)
            sids = np.array(list(sets), np.int64)
            sids = sids[in_table(table, sids)]
            items = [ordered(sets[sid], ranks).astype(">u8").tobytes() for sid in sids.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(items, pa.binary())], names=["sid", "items"])

    some = docs.where(may_hold(bit_filter(ends.select("key")), F.xxhash64("text"))).select("text")  # one text of each class will do
    items = some.mapInArrow(fetch, "sid long, items binary").join(ends.select("sid"), "sid", "left_semi")
    items = materialize(items.groupBy("sid").agg(F.first("items").alias("items")), "candidate-sets")
    trees = both.groupBy("a").agg(F.ceil(F.count("*") / TREE_SETS).cast("long").alias("trees"))
    members = both.select("a", "b").join(trees, "a").join(items, F.col("b") == items["sid"]).select(
        "a", F.pmod(F.xxhash64("b"), F.col("trees")).alias("tree"), "b", "items"
    )
    probes = trees.join(items, F.col("a") == items["sid"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"), F.lit(None).cast("long").alias("b"), "items"
    )

    def join(rows: pa.Table) -> pa.Table:
        probe, others = None, []
        a = rows.column("a")[0].as_py() if rows.num_rows else None
        for b, raw in zip(rows.column("b").to_pylist(), rows.column("items").to_pylist()):
            if b is None:
                probe = np.frombuffer(raw, ">u8").astype(np.uint64)
            else:
                others.append((b, raw))
        hit = walk(probe, others, percent) if probe is not None and others else []
        return pa.table({"a": pa.array([a] * len(hit), pa.int64()), "b": pa.array(hit, pa.int64())})

    return members.union(probes).groupBy("a", "tree").applyInArrow(join, "a long, b long")


def with_turns(rows: DataFrame) -> DataFrame:
    """``rows`` (key, sid) with turn, the round (from 1) in which a class leads its key, and blocks, in how many its key is dealt.

    About LEADERS**t classes of a key have led by turn t, so a key of m classes takes log(m) rounds.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"))
    drawn = F.shiftrightunsigned(F.xxhash64("key", "sid"), 11) / F.lit(float(1 << 53))
    turn = F.greatest(F.lit(1), F.ceil(F.log(float(LEADERS), drawn * F.col("m"))).cast("int"))
    return rows.join(sizes, "key").withColumns({"turn": turn, "blocks": F.ceil(F.col("m") / BLOCK_ROWS).cast("long")}).drop("m")


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """node, component: the classes (sid) that the threshold connects; None if there are none.

    ``classes`` (sid, text_key, n, parity) are those of the sets of ``docs``, one row for each sid.
    """
    ranks = bucket_ranks(docs, k)
    first = materialize(prefixes(docs, k, ranks, percent), "prefixes")
    keys = first.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("key")
    keys = materialize(keys, "shared-keys")
    table = bit_table(keys, "key")

    def may_share(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_table(table, batch.column("key").to_numpy())))

    shared = first.mapInArrow(may_share, first.schema).join(keys, "key")
    shared = materialize(shared.distinct(), "shared-prefixes")
    discard(first)
    discard(keys)
    found, comp, rounds = None, None, 0
    while True:
        if comp is None:
            now = shared.withColumn("comp", F.col("sid"))
        else:
            now = shared.join(comp, shared["sid"] == comp["node"], "left").select(
                *[shared[c] for c in shared.columns], F.coalesce("component", "sid").alias("comp")
            )
        apart = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        now = stored = materialize(now.join(apart.select("key"), "key"), "apart")
        # pairs of a key in different components: all pairs less those within a component
        sizes = now.groupBy("key", "comp").agg(F.count("*").alias("m"))
        left = sizes.groupBy("key").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("pairs"), F.sum("m").alias("rows"))
        with shuffles_dropped(now.sparkSession):
            left = left.agg(F.sum("pairs").alias("pairs"), F.sum("rows").alias("rows")).first()
        if not left["pairs"]:
            break
        # looking at a pair costs far less than a round over all rows; either way every pair gets settled
        last = left["pairs"] <= (PAIRS_A_ROW if rounds else 1) * left["rows"]
        if last:
            a, b = now.alias("a"), now.alias("b")
            pairs = a.join(b, F.expr(f"a.sid < b.sid and {FIRST_OF_RUN} and {fits(percent)}"))
            pairs = pairs.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))
        elif not rounds:
            lead = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("sid").alias("h"), *PREFIX_COLUMNS, "comp")).alias("l"))
            a = lead.select("key", "l.*").alias("a")
            pairs = now.alias("b").join(a, F.expr(fits(percent)))
            pairs = pairs.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))
        else:
            if rounds == 1:  # keys that are settled by now stay so
                shared = materialize(with_turns(now.drop("comp")), "turns")
                now = now.join(shared.select("key", "sid", "turn", "blocks"), ["key", "sid"])
            lead = now.where(F.col("turn") == rounds).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
            rest = now.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
            a, b = lead.alias("a"), rest.alias("b")
            pairs = b.join(a, F.expr(f"a.block = b.block and (a.turn < b.turn or a.sid < b.sid) and {fits(percent)}"))
            pairs = pairs.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))
            shared = shared.where(F.col("turn") > rounds)  # all others have led: every pair of theirs was looked at
        new = materialize(verified(pairs.distinct(), classes, docs, k, ranks, percent), "links")
        discard(stored)
        found = new if found is None else found.union(new)
        comp = materialize(components(found), "components")
        rounds += 1
        if last:
            break
    return comp


def set_components(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """sid, comp (a sid of its component), component_id (the component's smallest doc_id) for every set of ``sets``, the ``shingled`` ``docs``."""
    # every class of equal sets, with its smallest id and one of its texts
    classes = sets.where("sid is not null").groupBy("sid").agg(
        F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.max("n").alias("n"), F.first("parity").alias("parity")
    )
    classes = materialize(classes, "set-classes")
    comp = links(docs, classes, k, percent)
    classes = classes.select("sid", "least")
    if comp is None:
        return classes.select("sid", F.col("sid").alias("comp"), F.col("least").alias("component_id"))
    classes = classes.join(comp, classes["sid"] == comp["node"], "left").select(
        "sid", "least", F.coalesce("component", "sid").alias("comp")
    )
    names = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    return materialize(classes.join(names, "comp").select("sid", "comp", "component_id"), "components")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, sid for every row of ``docs``.

    Words are runs without white space, A-Z in lower case; a set holds distinct ``k``-word shingles,
    or the whole sequence of a shorter text. Rows link when 100 * common >= ``percent`` * union;
    ``component_id`` is the smallest doc_id reachable over links. Null and empty texts have an empty
    set and are linked with nothing (component_id is their own doc_id). Repeated rows and rows under
    one doc_id are rows of their own; a null doc_id takes part but is never a component's name, unless
    no row of it has one. No rows give no rows; other columns are not read.
    """
    sets = materialize(shingled(docs, k), "shingles")
    classes = set_components(docs, sets, k, percent).drop("comp")
    linked = sets.select("doc_id", "n", "sid").where("sid is not null").join(classes, "sid").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "sid"
    )
    alone = sets.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sid")
    return linked.union(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the later members of each group of near copies: one row of a group stays, unchanged.

    That is the row of the smallest doc_id, of the smallest xxhash64 of its text where one doc_id has
    several texts in a group; rows without a doc_id come last. Rows are told apart by doc_id and
    text, so another text under a removed row's doc_id stays. Rows that repeat both are one document
    and stay once. Null texts and texts without words are nobody's copy. No rows give no rows; other columns are kept
    whatever their names.
    """
    sets = materialize(shingled(docs, k), "shingles")
    classes = set_components(docs, sets, k, percent)
    members = sets.where("sid is not null").select("doc_id", "text_key", "sid").join(classes, "sid")
    members = materialize(members.select("comp", "doc_id", "text_key"), "members")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = members.groupBy("comp").agg(F.min(place).alias("first"))
    later = members.join(first, "comp").where(~place.eqNullSafe(F.col("first")))
    gone = materialize(later.select("doc_id", "text_key").distinct(), "near-copies")
    key = F.xxhash64(docs["text"])
    same = lambda some: docs["doc_id"].eqNullSafe(some["doc_id"]) & (key == some["text_key"])
    out = docs.join(gone, same(gone), "left_anti")
    again = sets.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).where("rows > 1")
    again = materialize(again.select("doc_id", "text_key"), "repeats")
    if again.isEmpty():
        return out
    once = out.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(again, same(again), "left_anti").union(once)
