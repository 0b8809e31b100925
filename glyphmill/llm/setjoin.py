"""Exact similarity join of token sets: candidate pairs and their verification, in DataFrame functions.

Items are token sets with a node id; tokens are 64-bit hashes. Two sets are similar
when they share at least ``SHARE`` of their union. The tokens have one global order,
rare before frequent and by hash among equals, and a set of n tokens is looked up
by its prefix, the first n - ceil(SHARE n) + 1 of them: similar sets share a token of
both prefixes.

Which tokens are frequent shows while prefixes are taken: a token that more than
``FREQUENT`` sets list is frequent, and those sets extend their prefixes by as many
further tokens, until nothing changes. So the lists of rare tokens are bounded,
and all pairs within them may be formed. A set that runs out of rare tokens lies
within a crowd of similar sets; two such sets meet by combinations of two tokens
instead, neighbours in the order of rarity within the crowd. Sets that are similar
share at least ceil(0.6 n) - 1 such pairs of n - 1, as each token in which they
differ parts one pair, so again a prefix of the pairs does, the rarest ones. Lists
of combinations are not bounded; their users compare members with few leaders
first. Members that this leaves look for a partner a few places off in their list, then
farther, eight times as far each time, until they are settled or the list ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.running import with_rank
from glyphmill.session import discard, materialise

#: Similarity in hundredths, and sets that may list a token before it counts as frequent.
SHARE = 80
FREQUENT = 50
#: Distance in a list that members look at first for a partner, and how much farther each next time.
WINDOW = 8
Full = Callable[[DataFrame], DataFrame]


def ceil_share(n: Column) -> Column:
    """ceil(0.8 n) in whole numbers."""
    return ((n * SHARE + 99) / 100).cast("int")


def prefix_length(n: Column) -> Column:
    return F.when(n > 0, n - ceil_share(n) + 1).otherwise(0)


def reserve_length(n: Column) -> Column:
    """The tokens kept beside a set: its prefix and a quarter more to extend it by."""
    return F.least(n, (prefix_length(n) * 1.25).cast("int") + 2)


def listing(kept: DataFrame, start, length) -> DataFrame:
    """(node, n, pos, token) for ``length`` tokens of each set from place ``start`` on."""
    rows = kept.select("node", "n", start.alias("_s"), F.posexplode(F.slice("tokens", start + 1, length)).alias("_i", "token"))
    return rows.select("node", "n", (F.col("_s") + F.col("_i")).alias("pos"), "token")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def frequent_in(rows: DataFrame, frequent: int) -> DataFrame:
    return rows.groupBy("token").count().filter(F.col("count") > frequent).select("token")


def candidates(base: DataFrame, full: Full, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (x, y) by rare tokens, and lists (key, node, n, v) of token combinations.

    ``base`` has rows of node, n and tokens, the first ``reserve_length(n)`` in
    ascending order; equal sets may repeat. ``full(nodes)`` gives (node, n, tokens)
    with all tokens, once for each id in the column ``node`` of its argument.
    """
    kept = base.select("node", "n", "tokens")
    written: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        written.append(materialise(df, name))
        return written[-1]

    size = F.col("n")
    prefix = prefix_length(size)
    first = listing(kept, F.lit(0), prefix)
    hot = [keep(frequent_in(first, frequent), "frequent-tokens")]
    extended: list[DataFrame] = []  # tokens listed beyond the prefixes
    hits: list[DataFrame] = []  # frequent tokens in lists
    near: list[DataFrame] = []  # reserves of the sets that list frequent tokens
    crowd: list[DataFrame] = []  # all tokens of those whose reserve does not do
    near_ids: list[DataFrame] = []
    crowd_ids: list[DataFrame] = []
    state = None
    while True:
        found = [first.join(hot[-1], "token", "left_semi")] + [e.join(hot[-1], "token", "left_semi") for e in extended]
        if extended and len(hot) > 1:
            found.append(extended[-1].join(union(hot[:-1]), "token", "left_semi"))
        hits.append(keep(union(found).select("node", "n", "token").distinct(), "frequent-hits"))
        counted = union(hits).groupBy("node", "n").agg(F.count_distinct("token").alias("hits"))
        want = F.least(size, prefix + F.col("hits")).cast("int").alias("upto")
        if crowd_ids:
            counted = counted.join(union(crowd_ids).withColumn("_c", F.lit(True)), "node", "left")
            want = F.when(F.col("_c"), size).otherwise(F.least(size, prefix + F.col("hits"))).cast("int").alias("upto")
        new = keep(counted.select("node", "n", "hits", want), "prefixes")
        before = new.withColumn("from", prefix.cast("int"))
        if state is not None:
            old = state.select("node", F.col("upto").alias("_upto"))
            before = new.join(old, "node", "left").withColumn("from", F.coalesce("_upto", prefix.cast("int")))
        grown = keep(before.filter(F.col("upto") > F.col("from")).select("node", "n", "from", "upto"), "grown")
        state = new
        if grown.limit(1).count() == 0:
            break
        ids = grown.select("node")
        fresh = keep(ids.join(union(near_ids), "node", "left_anti") if near_ids else ids, "near-sets")
        near_ids.append(fresh)
        # The ids grow with the table, so both sides are dealt by them at every size.
        near.append(keep(kept.join(fresh.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "reserves"))
        short = grown.filter(F.col("upto") > reserve_length(size)).select("node")
        short = keep(short.join(union(crowd_ids), "node", "left_anti") if crowd_ids else short, "crowd-sets")
        longer = union(near).join(grown, ["node", "n"]).join(union([*crowd_ids, short]), "node", "left_anti")
        parts = [listing(longer, F.col("from"), F.col("upto") - F.col("from"))]
        if short.limit(1).count():
            # What lies within a crowd is read again, whole, and lists all its tokens at once.
            crowd_ids.append(short)
            crowd.append(keep(full(short), "crowd-tokens"))
            parts.append(listing(crowd[-1], F.lit(0), size))
        extended.append(keep(union(parts), "extensions"))
        hot.append(keep(frequent_in(extended[-1], frequent).join(union(hot), "token", "left_anti"), "frequent-tokens"))
    lists = keep(token_lists(union([first, *extended]).join(union(hot), "token", "left_anti")), "token-lists")
    pairs = materialise(rare_pairs(lists), "rare-pairs")
    combined = base.sparkSession.createDataFrame([], "key long, node long, n int, v int")
    if crowd:
        out = state.filter(size - F.col("hits") < prefix).select("node")
        combined = materialise(combinations(union(crowd).join(out, "node", "left_semi")), "combinations")
    discard(*written)
    return pairs, combined


def token_lists(listed: DataFrame) -> DataFrame:
    """The rows of tokens that several sets list, once for each set."""
    several = Window.partitionBy("token")
    return listed.withColumn("_c", F.count("*").over(several)).filter("_c > 1").drop("_c").dropDuplicates(["token", "node"])


def rare_pairs(lists: DataFrame) -> DataFrame:
    """Pairs x < y of sets that list a token, sizes and places allowing similarity."""
    x = lists.select("token", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    y = lists.select("token", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    met = x.join(y, "token").filter((F.col("x") < F.col("y")) & sizes_allow(F.col("nx"), F.col("ny")))
    # With the shared token at places px and py, at most this many tokens can be shared in all.
    most = F.least("px", "py") + 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1
    union = F.col("nx") + F.col("ny") - most
    return met.filter(100 * most >= SHARE * union).select("x", "y").distinct()


def sizes_allow(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SHARE * F.greatest(a, b)


def could(na: Column, va: Column, nb: Column, vb: Column) -> Column:
    """Whether two sets of sizes n can be similar when v of their tokens occur in another set of the crowd at all."""
    most = F.least(va, vb)
    return 100 * most >= SHARE * (na + nb - most)


def combinations(crowd: DataFrame) -> DataFrame:
    """(key, node, n, v): keys of token pairs of which two similar sets of the crowd share at least one.

    ``v`` counts the tokens that another set of the crowd has too; a set with too few of them is in no list.
    """
    each = crowd.select("node", "n", F.explode("tokens").alias("t"))
    ranked = each.join(each.groupBy("t").agg(F.count("*").alias("c")), "t")
    ordered = ranked.filter("n > 1").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("a"))
    ordered = ordered.withColumn("v", F.size(F.filter("a", lambda x: x["c"] > 1))).filter(100 * F.col("v") >= SHARE * F.col("n"))
    size = F.col("n")

    def pair(i: Column) -> Column:
        low, high = F.col("a")[i], F.col("a")[i + 1]
        return F.struct(high["c"].alias("high"), low["c"].alias("low"), F.xxhash64(low["t"], high["t"]).alias("key"))

    rarest = F.sort_array(F.transform(F.sequence(F.lit(0), size - 2), pair))
    length = size - ((size * 60 + 99) / 100).cast("int") + 1
    return ordered.select(F.explode(F.slice(rarest, F.lit(1), length)).alias("p"), "node", "n", "v").select("p.key", "node", "n", "v")


def led(lists: DataFrame, rank: DataFrame) -> DataFrame:
    """Pairs (x, y) of each list's leader, the member of lowest rank, with each other member.

    ``rank`` has (node, rank), any type that has an order.
    """
    ranked = lists.join(rank, "node").select("key", "node", "n", "v", "rank")
    first = ranked.groupBy("key").agg(F.min(F.struct("rank", "node", "n", "v")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    met = ranked.join(first, "key").filter((F.col("node") != F.col("f.node")) & could(F.col("n"), F.col("v"), F.col("f.n"), F.col("f.v")))
    return met.select(F.col("f.node").alias("x"), F.col("node").alias("y")).distinct()


def placed(lists: DataFrame) -> DataFrame:
    """(key, node, n, v, at, c): the members of each list in the order of a hash, counted from 1 to c; single ones go.

    Places are ranked in buckets, so a list need not fit a task.
    """
    once = lists.dropDuplicates(["key", "node"]).withColumn("h", F.xxhash64("node"))
    once = materialise(once.join(once.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key"), "long-lists")
    return materialise(with_rank(once, ["key"], ["h", "node"], "at").drop("h"), "placed-lists")


def windows(places: DataFrame):
    """Growing distances (from, to) between places that together reach over the longest list."""
    longest = places.agg(F.max("c")).first()[0] or 0
    low, high = 1, WINDOW
    while low < longest:
        yield low, high
        low, high = high, high * WINDOW


def met_within(left: DataFrame, places: DataFrame, low: int, high: int) -> DataFrame:
    """Members of ``left``, part of ``places``, with those of their list that stand ``low`` to ``high`` - 1 places off.

    Each row of ``left`` gives at most twice the window's length, whatever the list's length. The partner's columns end in ``_y``.
    """
    steps = F.sequence(F.lit(low), F.least(F.lit(high), F.col("c")) - 1)
    asked = left.filter(F.col("c") > low).withColumn("_d", F.explode(steps))
    asked = asked.withColumn("_at", F.explode(F.array(F.col("at") + F.col("_d"), F.col("at") - F.col("_d")))).filter("_at between 1 and c").drop("_d")
    other = places.select(*[F.col(x).alias(f"{x}_y") for x in places.columns])
    return asked.join(other, (F.col("key") == F.col("key_y")) & (F.col("_at") == F.col("at_y")))


def similar(pairs: DataFrame, full: Full) -> DataFrame:
    """The pairs (x, y) whose sets are similar, by all their tokens."""
    pairs = materialise(pairs.select("x", "y"), "pairs")
    nodes = materialise(pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct(), "paired-nodes")
    sets = materialise(full(nodes), "paired-sets")
    a = sets.select(F.col("node").alias("x"), F.col("tokens").alias("a"))
    b = sets.select(F.col("node").alias("y"), F.col("tokens").alias("b"))
    both = pairs.join(a, "x").join(b, "y").select("x", "y", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("c"))
    return both.filter(100 * F.col("c") >= SHARE * (F.col("na") + F.col("nb") - F.col("c"))).select("x", "y")
